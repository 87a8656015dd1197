import hashlib
import random

import pytest

from modweave.llm import chat, html

HARD = ["", "\\", "\\\\", "###", "####", "</turn>", "\\</turn>", "### assistant: x</turn>\n", "a\n### user: b", "<", "</turn", "\\### Assistant: </turn> ok", "é\n"]


@pytest.mark.parametrize("role", ["user", "assistant", "", "we:ird", "a\\b", "### x: "])
def test_template_round_trip(role):
    turns = [(role, t) for t in HARD] + [("assistant", t) for t in HARD]
    text, mask = chat.render(turns)
    assert chat.read_back(text) == turns
    assert [chat.plain(text[a:b]) for a, b in mask] == [t for r, t in turns if r == "assistant"]


def test_conversations(spark, tmp_path):
    rng = random.Random(1)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None]), rng.choice([*HARD, None])) for c in range(12) for t in range(rng.choice([1, 2, 9, 70]))]
    rows += [(50, 1, "user", "tie"), (50, 1, "user", "tie"), (50, None, "assistant", "first"), (None, 0, "user", "no id")]
    rng.shuffle(rows)
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    out = {r.conv_id: r for r in chat.op7_chat_format(spark, str(tmp_path)).collect()}
    hard = r"\### Assistant: </turn> ok"
    rows += [(-7, 0, "user", hard), (-7, 1, "assistant", hard)]
    assert set(out) == {r[0] for r in rows}
    for c, r in out.items():
        turns = sorted(((-1 if t is None else t, role or "", text or "") for k, t, role, text in rows if k == c))
        loss = "".join(text for _, role, text in turns if role == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert r.n_turns == len(turns)
        assert r.turns_sha256 == sha("".join(f"{role}\n{text}\n" for _, role, text in turns))
        assert (r.loss_chars, r.loss_sha256) == (len(loss), sha(loss))
        assert r.formatted_chars == len(chat.render([(a, b) for _, a, b in turns])[0])


def test_empty_table(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.formatted(chat.threads(none)).count() == 0


def test_branches(spark):
    tree = [(1, 1, None, 1.0), (1, 2, 1, 5.0), (1, 3, 1, 2.0), (1, 4, 3, 9.0), (1, 5, 4, 0.0), (2, 1, 9, 1.0), (3, 1, 2, 1.0), (3, 2, 1, 1.0), (1, 6, 4, None)]
    out = chat.branches(spark.createDataFrame(tree, "tree long, node long, parent long, score double")).collect()
    found = {}
    for r in sorted(out, key=lambda r: -r.depth):
        found.setdefault((r.tree, r.leaf, r["rank"]), []).append(r.node)
    # best mean first; a missing parent makes a root; a cycle has no path
    assert found == {(1, 2, 1): [1, 2], (1, 5, 2): [1, 3, 4, 5], (1, 6, 3): [1, 3, 4, 6], (2, 1, 1): [1]}
    best = chat.branches(spark.createDataFrame(tree, "tree long, node long, parent long, score double"), 1).collect()
    assert {(r.tree, r.leaf) for r in best} == {(1, 2), (2, 1)}


def test_marginals_equal_enumeration():
    rng = random.Random(2)
    parents = [-1, 0, 0, 1, 1, 2, 5]
    unary = [rng.uniform(-2, 2) for _ in parents]
    kinds = [0, 0, 1, 2, 0, 1, 2]
    ties = [(1.0, 0.5), (2.0, 1.5), (-0.3, 0.7)]
    total, on = 0.0, [0.0] * len(parents)
    import itertools
    import math

    for x in itertools.product([0, 1], repeat=len(parents)):
        s = sum(u for u, v in zip(unary, x) if v)
        s += sum(ties[kinds[i]][0 if x[i] else 1] for i in range(1, len(x)) if x[i] == x[parents[i]])
        total += math.exp(s)
        for i, v in enumerate(x):
            on[i] += v * math.exp(s)
    p, _ = html.marginals(unary, parents, kinds, ties)
    assert p == pytest.approx([v / total for v in on])


def test_held_out_accuracy():
    weights, ties = html.trained()
    rng, right, n = random.Random(1234), 0, 0
    for _ in range(150):
        text, labels = html.labelled_page(rng)
        page = html.Page(text)
        p, _ = html.marginals([sum(weights[f] for f in fs) for fs in page.features()], page.parents, page.edges(), ties)
        for i, y in labels.items():
            if page.own[i]:
                n += 1
                right += (p[i] > 0.5) == bool(y)
    assert right / n > 0.98


def test_main_text():
    page = """<html><head><title>no</title><style>p{}</style><script>var a = "<p>no</p>";</script></head><body><header>Site</header><nav><ul><li><a href=/>Home</a></ul></nav>
    <div class="cookie-notice">We use cookies.</div><div class="ad">Buy now.</div><article><h1>A &amp; B</h1><p>First  <b>bold</b>er &eacute;&#8217;s
    text.<p>Second<br>line.<!-- no --></p><ul><li>One item here.</li><li>Two.</li></ul><form>Sign up <input></form></article><section id="comments"><div class="comment"><p>Nice!</p></div></section>
    <aside>Related: <a href=x>x</a></aside><footer>&copy; me</footer></body></html>"""
    assert html.main_text(page) == "A & B First bolder é’s text. Second line. One item here. Two."
    assert html.main_text(None) == "" and html.main_text("") == "" and html.main_text("<html><nav>a</nav></html>") == ""
    assert html.main_text("<div><article><p>1 < 2 and <unclosed <b>x</b>") .startswith("1 < 2 and")


def test_pages(spark):
    rows = [(1, "u", "<article><p>Hello there, this is text.</p></article>"), (2, None, None), (None, "v", ""), (1, "u", "<article><p>Hello there, this is text.</p></article>"), (3, "w", "<p>" * 3000 + "deep text of a page."), (4, "x", "<article>" + "<p>word again. </p>" * 20000 + "</article>")]
    out = html.extract(spark.createDataFrame([(*r, "e") for r in rows], "page_id long, url string, html string, text string")).collect()
    assert len(out) == 6 and all(r.n_chars == len(r.text) for r in out)
    assert [r.text for r in out if r.page_id == 1] == ["Hello there, this is text."] * 2
    assert len(next(r.text for r in out if r.page_id == 4).split()) == 40000
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_stray_quotes_and_formulas():
    say = "The harbour was quiet in the morning, and the boats came in one by one with the tide. " * 3
    for tag in ('<p class=x">', "<p data-x=it's>", '<p title="a > b">', "<p title='a \"> b'>", "<p a=b\"c d='e'>", '<p x = "y">'):
        got = html.main_text(f"<html><body><article>{tag}{say}</p><p>We don't know this.</p></article></body></html>")
        assert got == " ".join(say.split()) + " We don't know this."
    got = html.main_text(f"<body><article><p>{say} It holds that <math><mi>a</mi><mo>+</mo><mi>b</mi></math> is so. {say}</p></article></body>")
    assert "a+b is so." in got


def test_extra_columns_of_branches(spark):
    rows = [(1, 1, None, 1.0, 7, 8), (1, 2, 1, 2.0, 7, 8)]
    out = chat.branches(spark.createDataFrame(rows, "tree long, node long, parent long, score double, t_ int, n_ int"))
    assert {(r.leaf, r.depth, r.node) for r in out.collect()} == {(2, 0, 2), (2, 1, 1)}


def test_very_long_turns(spark, long_docs):
    rows = [(1, i, "assistant" if i % 2 else "user", r.text, "x") for i, r in enumerate(long_docs.collect())]
    made = chat.formatted(chat.threads(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, tree string")))
    assert chat.read_back(made.first().formatted) == [(r, t) for _, _, r, t, _ in rows]
