import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from modweave.llm import packing, tokens


@pytest.fixture(scope="module")
def reference():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


TEXTS = ["", "a", "  two  spaces ", "x\n\n\ny \n z", "don't stop 123 !?", "é ß ü 漢字 かな 🙂", "a<|endoftext|>b", "tab\tand\x0bmore\u00a0nbsp\u2003em", "word " * 3000, "x" * 3000]


def test_ids_are_those_of_tokenizers(reference):
    encode = tokens.encoder()
    for t in TEXTS:
        assert list(encode(t)) == reference.encode(t, add_special_tokens=False).ids


def test_pieces(spark, docs, no_docs, reference):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(r.doc_id, r.text) for r in docs.collect()]
    rows = [(100 + i, t) for i, (_, t) in enumerate(rows)]
    out = packing.pack(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in out:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for i, t in rows:
        ids = np.array([*reference.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for p in sorted(by_doc[i], key=lambda p: p.start):
            assert (p.start, p.doc_tokens) == (at, len(ids))
            assert p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    for pieces in by_seq.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        assert at <= 2048
    assert packing.pack(no_docs).count() == 0
    total = packing.pack(docs).selectExpr("sum(length)").first()[0]
    assert total == sum(len(reference.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in docs.collect())


def test_filler_wastes_little():
    rng, filler = random.Random(1), packing.Filler(0)
    sizes = [rng.randint(1, 5000) for _ in range(2000)]
    for n in sizes:
        filler.add(n)
    assert sum(sizes) / ((filler.sequence + 1) * packing.WINDOW) > 0.98


def sketched(spark, sketches, stretch=lambda i: 0):
    rows = [(i, stretch(i), [int(v) for v in x]) for i, x in enumerate(sketches)]
    return spark.createDataFrame(rows, "rid long, stretch long, sketch array<int>")


def test_walks_visit_all_and_keep_relatives_together(spark):
    rng = np.random.default_rng(2)
    families = rng.integers(1, 2**31 - 1, (30, packing.SKETCH), dtype=np.int32)
    sketches = np.repeat(families, 4, axis=0)
    blurred = rng.random(sketches.shape) < 0.2
    sketches[blurred] = rng.integers(1, 2**31 - 1, blurred.sum(), dtype=np.int32)
    order = rng.permutation(len(sketches))
    found = {r.rid: [(z.common, z.b) for z in r.near] for r in packing.neighbours(sketched(spark, sketches[order])).collect()}
    assert all(order[b] // 4 == order[a] // 4 for a, zs in found.items() for _, b in zs)
    rids = list(range(len(order)))
    walk = packing.paths(rids, [found.get(r, []) for r in rids])
    assert sorted(walk) == rids
    family = [int(order[x]) // 4 for x in walk]
    assert sum(a == b for a, b in zip(family, family[1:])) > 80  # of 90


def test_neighbours_in_hot_groups(spark):
    """Hundreds with one minimum in common, pairs of which are close; and no links between stretches."""
    rng = np.random.default_rng(3)
    sketches = rng.integers(1, 2**31 - 1, (600, packing.SKETCH), dtype=np.int32)
    sketches[:, 0] = 77
    sketches[1::2, 3:6] = sketches[::2, 3:6]
    found = {r.rid: [z.b for z in r.near] for r in packing.neighbours(sketched(spark, sketches)).collect()}
    assert sum(found.get(i, [])[:1] == [i ^ 1] for i in range(600)) > 590
    apart = packing.neighbours(sketched(spark, sketches, stretch=lambda i: i % 2))
    assert apart.count() == 0


def crowded(n, seed):
    """Sketches of few different minima, each in many rows; some rows are alike, some have no minimum at some places."""
    rng = np.random.default_rng(seed)
    sketches = rng.choice(rng.integers(1, 2**31 - 1, 6, dtype=np.int32), (n, packing.SKETCH), p=[0.5, 0.3, 0.1, 0.05, 0.03, 0.02])
    sketches[::7] = sketches[1]
    sketches[rng.random(sketches.shape) < 0.05] = 0
    return sketches


def nearest(sketches, a, rows):
    """The minima that ``a`` has in common with each other row of ``rows``."""
    common = ((sketches == sketches[a]) & (sketches != 0)).sum(axis=1)
    return {int(b): int(common[b]) for b in rows if b != a and common[b] >= packing.COMMON}


@pytest.mark.parametrize("stretches", [1, 3])
def test_neighbours_are_those_of_all_pairs(spark, stretches):
    """Every minimum is in hundreds of rows, yet none of the nearest is left out."""
    sketches = crowded(900, 4)
    found = {r.rid: [(z.common, z.b) for z in r.near] for r in packing.neighbours(sketched(spark, sketches, stretch=lambda i: i % stretches)).collect()}
    for a in range(len(sketches)):
        common = nearest(sketches, a, range(a % stretches, len(sketches), stretches))
        mine = found.get(a, [])
        assert [c for c, _ in mine] == sorted(common.values(), reverse=True)[: packing.NEIGHBOURS]
        assert all(common[b] == c for c, b in mine) and len({b for _, b in mine}) == len(mine)


@pytest.mark.parametrize("ties", [packing.TIES, 5])
def test_nearest_block_by_block(monkeypatch, ties):
    monkeypatch.setattr(packing, "TIES", ties)
    sketches = crowded(1500, 5)
    rows = np.empty(len(sketches), packing._ROW)
    rows["rid"], rows["sketch"] = np.arange(len(rows)), sketches
    search = packing.Nearest(rows[300:700])
    for lo in range(0, len(rows), 130):
        search.meet(rows[lo : lo + 130])
    found = {r["rid"]: [(z["common"], z["b"]) for z in r["near"]] for batch in search.found() for r in batch.to_pylist()}
    for a in range(300, 700):
        common = nearest(sketches, a, range(len(rows)))
        assert [c for c, _ in found[a]] == sorted(common.values(), reverse=True)[: packing.NEIGHBOURS]
        assert all(common[b] == c for c, b in found[a])


def test_links_between_blocks_are_walked(spark):
    """One path of 60 rows whose ids are shuffled, and three rows without links; blocks hold four rows."""
    at = np.random.default_rng(6).permutation(60).tolist()
    near = [(a, [(9, b)]) for a, b in zip(at, at[1:])]
    rows = spark.createDataFrame([(i, 0) for i in range(63)], "rid long, stretch long")
    out = packing.ordered(rows, spark.createDataFrame(near, f"rid long, near {packing._NEAR}"), block=4).orderBy("label", "chain", "link", "place", "rid").collect()
    assert sorted(r.rid for r in out) == list(range(63))
    whole = [r.rid for r in out if r.rid < 60]
    assert whole in (at, at[::-1]) and len({r.chain for r in out if r.rid < 60}) == 1


def test_no_link_is_left_between_ends(spark):
    sketches = np.random.default_rng(8).choice(np.arange(1, 5, dtype=np.int32), (300, packing.SKETCH))
    rows = sketched(spark, sketches, stretch=lambda i: i % 2)
    near = packing.neighbours(rows).localCheckpoint()
    out = packing.ordered(rows, near, block=16).orderBy("stretch", "label", "chain", "link", "place").collect()
    assert sorted(r.rid for r in out) == list(range(300)) and all(r.stretch == r.rid % 2 for r in out)
    chains = defaultdict(list)
    for r in out:
        chains[r.stretch, r.chain].append(r.rid)
    links = {(r.rid, z.b) for r in near.collect() for z in r.near}
    links |= {(b, a) for a, b in links}
    ends = {x: chain for chain, own in chains.items() for x in (own[0], own[-1])}
    assert not [(a, b) for a, b in links if a in ends and b in ends and ends[a] != ends[b]]
    steps = [(a, b) in links for own in chains.values() for a, b in zip(own, own[1:])]
    assert all(steps) and len(steps) > 250


def test_copies_stay_together_and_hide_no_other_text(spark):
    rng = random.Random(9)
    say = lambda n: [rng.choice("abcdefghij") * rng.randint(1, 4) + str(rng.randint(0, 99)) for _ in range(n)]
    base = say(200)
    texts = [" ".join(base)] * 12 + [" ".join(base[:150] + say(50))] * 12 + [" ".join(say(200)) for _ in range(40)]
    order = list(range(len(texts)))
    rng.shuffle(order)
    out = packing.pack(spark.createDataFrame([(i, texts[i]) for i in order], "doc_id long, text string").coalesce(1)).orderBy("sequence_id", "offset").collect()
    family = [r.doc_id // 12 for r in out if r.start == 0 and r.doc_id < 24]
    assert sum(a != b for a, b in zip(family, family[1:])) == 1
    place = [i for i, r in enumerate(r for r in out if r.start == 0) if r.doc_id < 24]
    assert place[-1] - place[0] == 23


@pytest.mark.parametrize("vocabulary,least", [(1764, 0.9), (42, 0.8)])
def test_neighbours_against_brute_force(spark, reference, vocabulary, least):
    """Nearest neighbours by the token pairs of whole texts, of documents in families of changing likeness.

    With 42 words, unrelated long texts have a third of their pairs in common, which a sketch can't tell from 0.4.
    """
    rng, texts = random.Random(12), []
    words = [f"{a}{b}" for a in "ka ro mi te su lo ne".split() for b in "na rit ol es um da".split()]
    words = (words + [a + b for a in words for b in words])[-vocabulary:]
    for _ in range(70):
        base = [rng.choice(words) for _ in range(rng.choice([60, 150, 400]))]
        for _ in range(rng.randint(1, 4)):
            texts.append(" ".join(rng.choice(words) if rng.random() < 0.12 else w for w in base))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = docs.mapInArrow(packing._measured(packing.VOCABULARY), "doc_id long, rid long, n long, crcs binary, sketch array<int>").selectExpr("doc_id AS rid", "0L AS stretch", "sketch")
    found = {r.rid: {z.b for z in r.near} for r in packing.neighbours(rows).collect()}
    ids = [reference.encode(t, add_special_tokens=False).ids + [1] for t in texts]
    pairs = [set(zip(x, x[1:])) for x in ids]
    like = lambda a, b: len(pairs[a] & pairs[b]) / len(pairs[a] | pairs[b])
    asked = hits = 0
    for a in range(len(texts)):
        best = max(like(a, b) for b in range(len(texts)) if b != a)
        if best >= 0.4:
            asked += 1
            hits += any(like(a, b) >= best - 0.05 for b in found.get(a, ()))
    assert asked > 100 and hits / asked >= least


def test_very_long_text(spark, long_docs, reference):
    out = packing.pack(long_docs).collect()
    for r in long_docs.collect():
        n = len(reference.encode(r.text, add_special_tokens=False).ids) + 1
        mine = [p for p in out if p.doc_id == r.doc_id]
        assert sum(p.length for p in mine) == n and {p.doc_tokens for p in mine} == {n}


def test_slice_crc():
    ids = np.arange(5000, dtype="<u4")
    for a, b in ((0, 7), (32, 2048), (64, 65), (3000, 5000)):
        before, through = (zlib.crc32(ids[:k].tobytes()) for k in (a, b))
        got = packing.slice_crc(np.array([before if a else 0], np.uint32), np.array([through], np.uint32), np.array([b - a]))
        assert int(got[0]) == zlib.crc32(ids[a:b].tobytes())


@pytest.mark.parametrize("seed", range(6))
def test_edited_counts_equal_a_full_encoding(seed):
    rng, encode = random.Random(seed), tokens.encoder()
    bits = ["word ", "it's ", "  ", "\n", "12 ", "é", "<|end", "oftext|>", "<|endoftext|>", ". ", "漢字", "\t", "\u00a0x ", "A" * 50]
    make = lambda n: "".join(rng.choice(bits) for _ in range(n))
    text = make(rng.choice([0, 3, 400, 2000]))
    tree = tokens.TokenTree(text, encode)
    assert tree.chars[1] == len(text) and tree.tokens[1] == len(encode(text))
    for _ in range(12):
        a = rng.randint(0, len(text) + 2)
        edit = (a, a + rng.choice([0, 1, 5, 700]), make(rng.choice([0, 1, 4, 300])))
        tree.replace(*edit)
        text = tokens.edited(text, [edit])
        assert "".join(tree.leaf) == text
        assert (tree.chars[1], tree.tokens[1]) == (len(text), len(encode(text)))


def test_small_edits_encode_little():
    tree = tokens.TokenTree("some words here " * 20000, tokens.encoder())
    tree.replace(100_000, 100_010, "x")
    assert tree.encoded < 4 * tokens.LEAF


def test_counts(spark, docs, no_docs):
    from pyspark.sql import functions as F

    edits = tokens.standard_edits(F.coalesce("text", F.lit("")), F.coalesce("doc_id", F.lit(0)))
    out = tokens.count_edited(docs, edits).collect()
    assert len(out) == docs.count()
    encode = tokens.encoder()
    for r, d in zip(out, docs.select("doc_id", "text", edits.alias("e")).collect()):
        text = tokens.edited(d.text or "", [(e.start, e.end, e.text) for e in d.e])
        assert (r.doc_id, r.n_tokens, r.edited_chars, r.edited_tokens) == (d.doc_id, len(encode(d.text or "")), len(text), len(encode(text)))
    assert tokens.count_edited(no_docs, edits).count() == 0
    assert tokens.count_edited(docs, F.lit(None).cast("array<struct<start:int,end:int,text:string>>")).count() == docs.count()


def test_counts_of_very_long_texts(long_docs):
    from pyspark.sql import functions as F

    edits = tokens.standard_edits(F.col("text"), F.col("doc_id"))
    encode = tokens.encoder()
    rows = {r.doc_id: r for r in long_docs.select("doc_id", "text", edits.alias("e")).collect()}
    for r in tokens.count_edited(long_docs, edits).collect():
        text = tokens.edited(rows[r.doc_id].text, [(e.start, e.end, e.text) for e in rows[r.doc_id].e])
        assert (r.n_tokens, r.edited_tokens) == (len(encode(rows[r.doc_id].text)), len(encode(text)))
