import random
from collections import defaultdict

import corpus_pipeline
from modweave.llm import line_dedup, mixing, near_dups, packing, quality, tokens


def corpus():
    rng = random.Random(11)
    say = lambda n: "\n".join(" ".join(f"w{rng.randrange(5000)}" for _ in range(12)) for _ in range(n))
    clean = [(i, say(8)) for i in range(40)]
    copies = [(100 + i, clean[i][1]) for i in range(5)]
    near = [(200 + i, clean[10 + i][1].replace("\n", " ") + " tail") for i in range(5)]  # no line in common, so line dedup leaves them
    near_of = [(210 + i, t.replace(" tail", " other")) for i, (_, t) in enumerate(near)]
    junk = [(300, "too short"), (301, "again and again " * 60), (302, None), (303, "")]
    passage = " ".join(f"p{i}" for i in range(60))
    passages = [(400 + i, say(4) + "\n" + passage + "\n" + say(3)) for i in range(3)]
    return clean, copies, near, near_of, junk, passages


def test_stages(spark, tmp_path):
    clean, copies, near, near_of, junk, passages = corpus()
    rows = [(i, t, "en", f"s{i % 3}", None if t is None else len(t)) for part in (clean, copies, near, near_of, junk, passages) for i, t in part]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = {r.doc_id: r.text for r in docs.collect()}
    ids = lambda part: {i for i, _ in part}
    assert set(seen["quality_rules"]) == ids(clean + copies + near + near_of + passages)
    assert set(seen["line_dedup"]) == ids(clean + near + near_of + passages)
    texts = dict(clean + near + near_of)
    assert all(seen["line_dedup"][i] == t for i, t in texts.items())
    assert [("p0 p1 " in seen["line_dedup"][i]) for i in (400, 401, 402)] == [True, False, False]
    # a copy without line ends has the same words as its original, up to the tail
    assert set(seen["near_duplicates"]) == ids(clean + passages)
    assert set(seen["mix_sources"]) == set(seen["near_duplicates"])
    pieces = defaultdict(int)
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        pieces[r.doc_id] += r.length
    encode = tokens.encoder()
    assert dict(pieces) == {i: len(encode(t)) + 1 for i, t in seen["mix_sources"].items()}


def test_hard_rows_pass_through(spark, docs, no_docs):
    for start in (docs, no_docs):
        at = start
        for stage in (quality.keep_good, line_dedup.dedup, near_dups.one_of_each, mixing.in_order):
            out = stage(at)
            assert out.columns == start.columns
            at = spark.createDataFrame(out.collect(), out.schema)
        assert packing.pack(at).count() >= at.count()


def test_sequences_follow_the_mix(spark):
    rng = random.Random(4)
    say = lambda: " ".join(f"w{rng.randrange(3000)}" for _ in range(200))
    source = {i: "big" if i % 10 else "small" for i in range(1500)}
    docs = spark.createDataFrame([(i, say(), s) for i, s in source.items()], "doc_id long, text string, source string")
    docs = mixing.in_order(docs)
    pieces = sorted(corpus_pipeline.pack(spark, docs, "").collect(), key=lambda r: (r.sequence_id, r.offset))
    assert {r.doc_id for r in pieces} == set(source)
    # nine to one in the input, three to one in the mix until the small source is used up, at 0.4
    total, at, small = sum(r.length for r in pieces), 0, 0
    for r in pieces:
        at, small = at + r.length, small + r.length * (source[r.doc_id] == "small")
        if 0.05 < at / total < 0.38:
            assert abs(small / at - 0.25) < 0.05
