import hashlib
import re
from collections import Counter

import pytest

from modweave.llm import fingerprints, quality


def measures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    at = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {i + k for i in range(len(words) - 7) if at[tuple(words[i : i + 8])] > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_measures(spark, docs, no_docs):
    extra = ["a b c d e f g h i j a b c d e f g h i", "x " * 30, "q\nq\n\n \nq\nw", "a b c d e f g h " * 2 + "z " + "a b c d e f g h"]
    more = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(extra)], "doc_id long, text string")
    both = docs.selectExpr("doc_id", "text", "source").unionByName(more.selectExpr("doc_id", "text", "'s9' AS source"))
    got = sorted((r.doc_id or -1, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality.score(both).collect())
    want = [(r.doc_id or -1, *measures(r.text)) for r in both.collect()]
    assert got == sorted((*w, w[1] < 20 or 100 * w[5] > 30 * w[1]) for w in want)
    assert quality.score(no_docs).count() == 0


def test_host_verdict(spark):
    good = " ".join(f"w{i}" for i in range(40))
    rows = [(i, good if i % 10 else "short", "good") for i in range(60)] + [(100 + i, good if i == 0 else "short", "bad") for i in range(40)] + [(200, good, "new")]
    out = {r.doc_id: r for r in quality.score(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert out[1].kept and not out[0].kept and out[200].kept
    assert not out[100].base_failed and not out[100].kept  # its host fails
    kept = quality.keep_good(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert {r.doc_id for r in kept.collect()} == {k for k, r in out.items() if r.kept}


def test_keep_good_returns_whole_rows(docs, no_docs):
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns
    scored = [r.doc_id for r in quality.score(docs).collect() if r.kept]
    assert Counter(r.doc_id for r in kept.collect()) == Counter(scored)
    assert quality.keep_good(no_docs).count() == 0


def sketch(spark, text):
    from pyspark.sql import functions as F

    return set(spark.createDataFrame([(text,)], "t string").select(fingerprints.sketch(F.col("t"))).first()[0])


def by_hand(text, hashed):
    words = [hashed(w) for w in re.findall(r"[^\x20\x09-\x0D]+", text.lower())]
    shingles = [words[i : i + 5] for i in range(len(words) - 4)] if len(words) >= 5 else [words] if words else []
    return {h for h in (hashed(*s) for s in shingles) if h < -(2**63) + 2**64 // fingerprints.SCALE}


def hexed(hashes):
    return "".join(f"{h % 2**64:016x}" for h in sorted(hashes))


def jaccard(a, b, same):
    return len(a & b) / len(a | b) if a | b else float(same)


def test_hot_id_is_cut_by_its_ties(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "BLOCK_ROWS", 8)
    rows = [(i, f"t{i} a b c d e") for i in range(30)] + [(50, f"of one id {i}") for i in range(60)] + [(50, "same")] * 20
    df = spark.createDataFrame(rows, "k long, t string").selectExpr("k", "t", "xxhash64(t) AS tie")
    seen = []
    out = fingerprints.with_next(df, "k", "tie", ["t"], lambda x: seen.append(x.groupBy("block_").count().collect()) or x).collect()
    order = sorted((r.k, r.tie, r.t) for r in df.collect())
    assert sorted((r.k, r.tie, r.t, r.next_t) for r in out) == sorted((*a, b[2]) for a, b in zip(order, order[1:] + order[:1]))
    assert max(r["count"] for r in seen[0]) < 50


def test_contained_texts_are_found(spark):
    words = [f"w{i}" for i in range(3000)]
    rows = [(2 * i, " ".join(words[9 * i : 9 * i + 9])) for i in range(200)] + [(2 * i + 1, " ".join(words)) for i in range(200)]
    out = fingerprints.fingerprint(spark.createDataFrame(rows, "doc_id long, text string")).where("doc_id % 2 = 0").collect()
    assert all(r.within_next == (1.0 if r.fingerprint else None) for r in out)
    assert sum(r.within_next == 1.0 for r in out) > 60


def test_sketches_merge(spark):
    from pyspark.sql import functions as F

    words = [f"w{i}" for i in range(400)]
    parts = [" ".join(words[:204]), " ".join(words[200:])]
    row = spark.createDataFrame([(*parts, " ".join(words))], "a string, b string, c string")
    got = row.select(fingerprints.merged(fingerprints.sketch(F.col("a")), fingerprints.sketch(F.col("b"))), fingerprints.sketch(F.col("c"))).first()
    assert got[0] == got[1] and len(got[0]) > 20


def test_very_long_texts(long_docs, hashed):
    out = {r.doc_id: r for r in fingerprints.fingerprint(long_docs).collect()}
    texts = {r.doc_id: r.text for r in long_docs.collect()}
    assert all(out[i].fingerprint == hexed(by_hand(t, hashed)) for i, t in texts.items())
    got = {r.doc_id: r for r in quality.score(long_docs).collect()}
    for i, t in texts.items():
        assert (got[i].n_words, got[i].word_chars, got[i].n_symbols, got[i].n_dup_lines, got[i].n_repeat_words) == measures(t)


def test_fingerprints(docs, no_docs, monkeypatch, hashed):
    monkeypatch.setattr(fingerprints, "BLOCK_ROWS", 4)
    rows = sorted(((r.doc_id, r.text or "") for r in docs.dropDuplicates(["doc_id", "text"]).collect() if r.doc_id is not None and r.doc_id != 15))
    clean = docs.where("doc_id IS NOT NULL AND doc_id != 15").dropDuplicates(["doc_id", "text"])
    out = {r.doc_id: r for r in fingerprints.fingerprint(clean).collect()}
    assert len(out) == len(rows)
    for (i, t), (_, nxt) in zip(rows, rows[1:] + rows[:1]):
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        assert out[i].n_chars == len(t) and out[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        a, e, b = (by_hand(x, hashed) for x in (t, edited, nxt))
        assert out[i].fingerprint == hexed(a) and out[i].edited_fingerprint == hexed(e)
        assert out[i].near_edited == pytest.approx(jaccard(a, e, t == edited)) and out[i].near_next == pytest.approx(jaccard(a, b, t == nxt))
        assert out[i].within_next == (pytest.approx(len(a & b) / len(a)) if a else None)
        assert out[i].within_edited == (pytest.approx(len(a & e) / len(a)) if a else None)
    assert sum(r.fingerprint != "" for r in out.values()) > 5
    assert fingerprints.fingerprint(docs).count() == docs.count()
    assert fingerprints.fingerprint(no_docs).count() == 0
    assert fingerprints.fingerprint(clean.where("doc_id = 18")).count() == 1


def test_sketch_estimates(spark):
    from pyspark.sql import functions as F

    words = [f"w{i}" for i in range(4000)]
    a, b = " ".join(words), " ".join(words[:2000] + [f"v{i}" for i in range(2000)])
    row = spark.createDataFrame([(a, b)], "a string, b string").select(fingerprints.sketch(F.col("a")).alias("a"), fingerprints.sketch(F.col("b")).alias("b"))
    got = row.select(fingerprints.likeness(F.col("a"), F.col("b")), fingerprints.containment(F.col("a"), F.col("b")), F.size("a")).first()
    assert got[0] == pytest.approx(1 / 3, abs=0.06) and got[1] == pytest.approx(0.5, abs=0.07) and got[2] == pytest.approx(500, abs=90)
    assert sketch(spark, "Two words") == sketch(spark, "two  WORDS\n") and sketch(spark, "two words") != sketch(spark, "two word")
    assert sketch(spark, " ") == set()
