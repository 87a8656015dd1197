import random

import pytest

from modweave.llm import line_dedup


def brute(docs, min_words):
    """Lines of each document in a run that stands earlier too, by comparing every start with every earlier one."""
    docs = sorted({(i, t) for i, t in docs})
    lines = [t.split("\n") for _, t in docs]
    starts = [(a, b) for a in range(len(docs)) for b in range(len(lines[a]))]
    out = {d: set() for d in docs}
    for n, (a, b) in enumerate(starts):
        best = 0
        for a2, b2 in starts[:n]:
            m = 0
            while b + m < len(lines[a]) and b2 + m < len(lines[a2]) and lines[a][b + m] == lines[a2][b2 + m]:
                m += 1
            best = max(best, m)
        if best and sum(len(x.split()) for x in lines[a][b : b + best]) >= min_words:
            out[docs[a]].update(range(b, b + best))
    return out


@pytest.mark.parametrize("seed,min_words", [(1, 4), (2, 3)])
def test_runs(spark, seed, min_words):
    rng, docs = random.Random(seed), []
    for i in range(22):
        if docs and rng.random() < 0.4:
            old = rng.choice(docs)[1].split("\n")
            at = rng.randrange(len(old))
            lines = [rng.choice(["a", "b c", ""]) for _ in range(rng.randint(0, 2))] + old[at:] + [rng.choice("xyz") for _ in range(rng.randint(0, 2))]
        else:
            lines = [" ".join(rng.choice("ab") for _ in range(rng.randint(0, 2))) for _ in range(rng.randint(1, 13))]
        docs.append((i, "\n".join(lines)))
    docs += [(30, docs[3][1]), (31, "q r\n" + docs[5][1] + "\nzz\n" + docs[5][1]), (32, "\n".join(["same line of five words"] * 6))]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.k: {x for u in r.runs for x in range(u.start, u.end)} for r in line_dedup.repeated_runs(frame, min_words).collect()}
    assert got == {i: s for (i, _), s in brute(docs, min_words).items()}


def test_rows_left(spark, docs, no_docs):
    out = line_dedup.dedup(docs)
    assert out.columns == docs.columns
    want = brute([(r.doc_id if r.doc_id is not None else -(2**63), r.text or "") for r in docs.collect()], line_dedup.MIN_WORDS)
    texts = []
    for r in docs.collect():
        gone = want[(r.doc_id if r.doc_id is not None else -(2**63), r.text or "")]
        lines = (r.text or "").split("\n")
        if len(gone) < len(lines):
            texts.append((r.doc_id if r.doc_id is not None else -1, r.text if not gone else "\n".join(x for i, x in enumerate(lines) if i not in gone)))
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.text or "") for r in out.collect()) == sorted((i, t or "") for i, t in texts)
    assert all(r.text is None or r.text == "" or r.n_chars == len(r.text) or r.n_chars == 1 for r in out.collect())
    assert line_dedup.dedup(no_docs).count() == 0


def test_clean_documents_are_left_alone(spark):
    rng = random.Random(4)
    rows = [(i, "\n".join(" ".join(f"w{rng.randrange(10**6)}" for _ in range(9)) for _ in range(8))) for i in range(20)]
    passage = " ".join(f"p{i}" for i in range(60))
    rows += [(100, rows[0][1] + "x"), (101, "intro line one\n" + passage), (102, passage + "\nother end of it")]
    out = {r.doc_id: r.text for r in line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(out[i] == t for i, t in rows[:20])
    assert out[101].endswith(passage) and out[102] == "other end of it"
    assert out[100] == rows[0][1].split("\n")[-1] + "x"


def test_registered_query(spark, tmp_path):
    rng = random.Random(6)
    rows = [(i, "\n".join(rng.choice(["one two three", "a b", "four five six seven", "z"]) for _ in range(rng.randint(1, 6)))) for i in range(30)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = brute(rows, line_dedup.MIN_WORDS)
    for r in line_dedup.op2_line_dedup(spark, str(tmp_path)).collect():
        text = dict(rows)[r.doc_id]
        runs = [tuple(map(int, x.split("-"))) for x in r.runs.split(",") if x]
        assert {x for a, b in runs for x in range(a, b)} == want[r.doc_id, text] and r.n_deleted == len(want[r.doc_id, text])
        assert r.n_lines == len(text.split("\n")) and all(a[1] < b[0] for a, b in zip(runs, runs[1:]))


def test_lines_that_share_an_id_are_told_apart(spark):
    row = lambda k, ln, h, h2: (k, 0, 9, ln, h, h2)
    rows = [row(1, 0, 5, 50), row(2, 0, 5, 51), row(3, 0, 5, 50), row(1, 1, 6, 60), row(2, 1, 6, 60), row(3, 1, 7, 70)]
    own, met = line_dedup.distinct_ids(spark.createDataFrame(rows, "k long, d long, z int, ln int, h long, h2 long"))
    ids = {(r.k, r.ln): r.h for r in own.collect()}
    assert ids[1, 0] == ids[3, 0] != ids[2, 0] and ids[1, 1] == ids[2, 1] == 6 and ids[3, 1] == 7
    assert {(r.h_, r.c, r.f.k) for r in met.collect()} == {(ids[1, 0], 2, 1), (6, 2, 1)}


def test_very_long_texts(long_docs):
    texts = {r.doc_id: r.text for r in long_docs.collect()}
    out = {r.doc_id: r.text for r in line_dedup.dedup(long_docs).collect()}
    assert out[1] == texts[1] and out[3] == texts[3]
    assert out[2] == texts[2].split("\n")[-1] and 4 not in out or len(out[4].split("\n")) == 1
