import random
import re
from collections import defaultdict

import numpy as np
import pytest

from modweave.llm import near_dups


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + 4]) for i in range(len(w) - 3)) if len(w) >= 4 else frozenset([tuple(w)] if w else [])


def brute(rows):
    """Component of each id; rows of one id are one document."""
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, u in sets[:a]:
            if s and u and 100 * len(s & u) >= 80 * len(s | u):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in parent}


def check(spark, rows):
    out = near_dups.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = brute(rows)
    assert len(out) == len(rows)
    for r in out:
        if r.doc_id is not None:
            assert r.component_id == want[r.doc_id] and r.kept == (r.component_id == r.doc_id)
    key = lambda i: -1 if i is None else i
    assert sorted((key(r.doc_id), r.n_shingles) for r in out) == sorted((key(i), len(shingles(t))) for i, t in rows)


def test_chains_and_groups(spark):
    rng = random.Random(3)
    vocabulary = [f"v{i}" for i in range(300)]
    rows, base = [], None
    for i in range(150):
        if base and rng.random() < 0.7:
            words = base[:]
            for _ in range(rng.randint(0, 3)):  # drift: neighbours are near, ends of a chain are not
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            base = words
        else:
            base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 5, 9, 40, 120]))]
        rows.append((i, " ".join(base)))
    check(spark, rows)


def test_hard_rows(spark, docs, no_docs):
    check(spark, [(r.doc_id, r.text) for r in docs.collect()])
    assert near_dups.near_duplicates(no_docs).count() == 0
    kept = near_dups.one_of_each(docs)
    assert kept.columns == docs.columns
    assert near_dups.one_of_each(no_docs).count() == 0


def test_links_across_a_band_beyond_its_first_member(spark):
    # b and c are near, both too far from a, which comes first in their common bands
    a = [f"x{i}" for i in range(60)]
    b = a[:48] + [f"y{i}" for i in range(12)]
    c = b[:]
    c[0] = "z"
    check(spark, [(1, " ".join(a)), (2, " ".join(b)), (3, " ".join(c))])


def test_shared_passages_with_and_without_links(spark, monkeypatch):
    """Many documents of one passage and some text of their own fall into the same bands; few are near."""
    rng = random.Random(8)
    passage = [f"p{i}" for i in range(60)]
    rows = []
    for i in range(160):
        own = [f"o{i}.{k}" for k in range(rng.choice([8, 18, 30]))]
        rows.append((2 * i, " ".join(passage + own)))
        if i % 4 == 0:
            own[-1] = "changed"
            rows.append((2 * i + 1, " ".join(passage + own)))
    seen = []
    monkeypatch.setattr(near_dups, "_rest", lambda *a, whole=near_dups._rest: seen.append(1) or whole(*a))
    check(spark, rows)
    assert seen


def test_rest_is_exact(spark):
    """Prefix filtering alone finds every pair of different components that is near."""
    rng = random.Random(2)
    passage = [f"p{i}" for i in range(20)]
    texts = {}
    for i in range(120):
        words = passage[: rng.randint(0, 20)] + [f"w{rng.randrange(60)}" for _ in range(rng.randint(1, 30))]
        texts[10 * i] = " ".join(words)
        for k in range(rng.randint(0, 2)):
            words[rng.randrange(len(words))] = f"c{k}"
            texts[10 * i + 1 + k] = " ".join(words)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    left = docs.selectExpr("doc_id AS id", "doc_id AS comp")
    found = {(r.c, r.id) for r in near_dups._rest(left, docs, 4, lambda a, b: a > 0).collect()}
    sets = {i: shingles(t) for i, t in texts.items()}
    near = {(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    assert near and near <= found and len(found) < len(sets) ** 2 / 10


def test_clashing_columns(spark):
    rows = [(1, "a b c d e f", 1, 2, 3), (2, "a b c d e f", 1, 2, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, gone_ int, gone int, id int")
    assert [tuple(r) for r in near_dups.one_of_each(docs).collect()] == rows[:1]


def test_very_long_texts(spark):
    rng = random.Random(4)
    long = [f"v{rng.randrange(5000)}" for _ in range(120_000)]
    other = long[:]
    other[60_000:66_000] = [f"n{i}" for i in range(6000)]
    check(spark, [(1, " ".join(long)), (2, " ".join(other)), (3, " ".join(long[:50_000]))])


def test_case_and_white_space(spark):
    check(spark, [(1, "A b C d E f"), (2, "a B\tc\nD e F"), (3, "Ä b c d e f"), (4, "ä b c d e f"), (5, "a\u00a0b c d e f")])


def test_superminhash_estimates_jaccard():
    rng = np.random.default_rng(0)
    errors = []
    for j in (0.2, 0.5, 0.8):
        n = 600
        common = int(2 * n * j / (1 + j))
        x = rng.integers(0, 2**63, 2 * n - common, dtype=np.uint64)
        sig = near_dups.superminhash([np.sort(x[:n]), np.sort(x[n - common :])], 256)
        true = common / (2 * n - common)
        errors.append(abs((sig[0] == sig[1]).mean() - true))
    assert max(errors) < 0.1
    tiny = near_dups.superminhash([np.array([7], np.uint64), np.array([], np.uint64)])
    assert (tiny[0] != 2**64 - 1).all() and (tiny[1] == 2**64 - 1).all()


@pytest.mark.parametrize("n", [0, 1, 5])
def test_signature_is_that_of_slow_superminhash(n):
    """Element by element, as the algorithm is written down."""
    m = 16
    e = np.arange(100, 100 + n, dtype=np.uint64)
    want = [2**64 - 1] * m
    for x in e:
        p = list(range(m))
        for j in range(m):
            r = near_dups.mixed(np.array([x + np.uint64((j + 1) * 0x9E3779B97F4A7C15 % 2**64)], np.uint64))
            k = j + int(r[0] & np.uint64(0xFFFFFFFF)) % (m - j)
            p[j], p[k] = p[k], p[j]
            want[p[j]] = min(want[p[j]], j << 57 | int(near_dups.mixed(r)[0]) >> 7)
    assert near_dups.superminhash([e], m)[0].tolist() == want


def test_sizes_of_hot_groups(spark):
    base = " ".join(f"w{i}" for i in range(50))
    rows = [(i, base) for i in range(700)] + [(1000 + i, base + f" e{i}") for i in range(300)]
    out = near_dups.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    sizes = defaultdict(int)
    for r in out.collect():
        sizes[r.component_id] += 1
    assert dict(sizes) == {0: 1000}


def test_stage_takes_five_words(spark):
    a = [f"w{i}" for i in range(84)]
    b = a[:]
    b[20] = b[50] = "x"  # in common: 73 of 89 shingles of four words (0.82), 70 of 90 of five (0.78)
    texts = {1: " ".join(a), 2: " ".join(b)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id for r in near_dups.one_of_each(docs, 4).collect()} == {1}
    assert {r.doc_id for r in near_dups.one_of_each(docs).collect()} == {1, 2}


def test_classes_of_one_id_are_joined(spark):
    x, y, z = (" ".join(f"{c}{i}" for i in range(20)) for c in "xyz")
    # 5 is the least id of neither class, 7 has a text without words too
    rows = [(1, x), (2, y), (5, x), (5, y), (6, z), (7, None), (7, z), (8, None), (8, " ")]
    check(spark, rows)
    out = near_dups.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id for r in out.collect()} == {1, 6, 8}
