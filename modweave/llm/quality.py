"""Quality rules by host: rule failures of each domain, shrunk by an empirical beta prior, decide with the document's own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from modweave.llm.common import cut, join_sized, let, table, words_of

#: Words in a window that counts as repeated.
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
MAX_SYMBOL_PERCENT = 50
#: A host whose shrunk failure rate is above this loses all its documents.
MAX_HOST_RATE = 0.5


def _repeat_words(hashes: Column) -> Column:
    """Words lying in windows that occur twice or more, from the hash of each word.

    Sorting (window hash, place) brings equal windows together; the places of those with an equal neighbour,
    sorted again, cover ``min(WINDOW, distance to the next)`` words each. n log n for a text of n words.
    """

    def covered(places: Column) -> Column:
        width = F.transform(places, lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get(places, j + 1) - p, F.lit(WINDOW))))
        return F.aggregate(width, F.lit(0).cast("long"), lambda a, x: a + x)

    def equal_neighbour(pairs: Column) -> Column:
        same = lambda e, j: F.coalesce(F.get(pairs, j)["h"] == e["h"], F.lit(False))
        twice = F.filter(pairs, lambda e, j: same(e, j + 1) | F.when(j > 0, same(e, j - 1)).otherwise(F.lit(False)))
        return let(F.sort_array(F.transform(twice, lambda e: e["i"])), covered)

    def of(windows: Column) -> Column:
        pairs = F.sort_array(F.transform(windows, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(windows)) < F.size(windows), let(pairs, equal_neighbour)).otherwise(F.lit(0).cast("long"))

    window = lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(WINDOW)])
    windows = F.transform(F.sequence(F.lit(0), F.size(hashes) - WINDOW), window)
    return F.when(F.size(hashes) > WINDOW, let(windows, of)).otherwise(F.lit(0).cast("long"))


def measured(docs: DataFrame) -> DataFrame:
    """``docs`` with a struct column ``quality_``: the base measures and the base verdict of each whole text (null: none).

    All of it is JVM-side array work on the row itself; nothing is shuffled.
    """
    text = F.coalesce(docs["text"], F.lit(""))
    inner = let(words_of(text), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        let(F.transform(w, lambda x: F.xxhash64(x)), _repeat_words).alias("n_repeat_words"),
    ))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    dup = let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))
    symbols = F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long")
    out = docs.withColumn("quality_", F.struct(inner.alias("w"), symbols.alias("n_symbols"), dup.alias("n_dup_lines")))
    q = F.col("quality_")
    failed = (q["w"]["n_words"] < MIN_WORDS) | (100 * q["w"]["n_repeat_words"] > MAX_REPEAT_PERCENT * q["w"]["n_words"])
    return out.withColumn("quality_", F.struct(
        q["w"]["n_words"].alias("n_words"), q["w"]["word_chars"].alias("word_chars"), q["n_symbols"].alias("n_symbols"),
        q["n_dup_lines"].alias("n_dup_lines"), q["w"]["n_repeat_words"].alias("n_repeat_words"), failed.alias("base_failed"),
        (failed | (100 * q["n_symbols"] > MAX_SYMBOL_PERCENT * q["w"]["n_words"])).alias("rule_failed"),
    ))


def host_verdicts(measures: DataFrame) -> DataFrame:
    """``host, n, failures, rate, host_ok`` from ``measures(host, rule_failed)``.

    The prior Beta(a, b) comes from the hosts' own rates by moments: their mean m and variance v give
    a + b = m(1 - m)/v - 1. Without spread (one host, or all alike) the prior is as strong as the largest host.
    A host fails if (failures + a)/(n + a + b) exceeds ``MAX_HOST_RATE``. Counting is pre-aggregated before the
    shuffle, so a host with a third of all rows is no hot key; only the prior's two numbers come to the driver.
    """
    hosts = cut(measures.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("rule_failed").cast("long")).alias("failures")))
    r = F.col("failures") / F.col("n")
    got = hosts.agg(F.avg(r).alias("m"), F.var_pop(r).alias("v"), F.max("n").alias("most")).first()
    m, v, most = got["m"] or 0.0, got["v"] or 0.0, float(got["most"] or 1)
    strength = min(most, max(m * (1 - m) / v - 1, 1e-6)) if v > 0 else most
    rate = (F.col("failures") + F.lit(m * strength)) / (F.col("n") + F.lit(strength))
    return hosts.withColumn("rate", rate).withColumn("host_ok", F.col("rate") <= MAX_HOST_RATE)


def _joined(rows: DataFrame, hosts: DataFrame) -> DataFrame:
    verdict = hosts.select(F.col("host").alias("host_"), "host_ok")
    return join_sized(rows, verdict, rows["host"].eqNullSafe(F.col("host_")), "left").drop("host_")


def score(docs: DataFrame, host: str = "source") -> DataFrame:
    """The base measures, ``base_failed``, the host's shrunk failure verdict and ``kept`` for each row of ``docs``.

    Null text: no words, hence failed. A null host is a host of its own. Repeated rows count as often as they
    occur. An empty table gives an empty result. Extra columns, of any name, are not read.
    """
    rows = measured(docs.select("doc_id", "text", F.col(host).alias("host")))
    rows = cut(rows.select("doc_id", "host", "quality_.*"))
    return _joined(rows, host_verdicts(rows)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & F.col("host_ok")).alias("kept"), "host_ok",
    )


def keep_good(docs: DataFrame, host: str = "source") -> DataFrame:
    """The rows of ``docs`` that the rules keep, all their columns, extra ones of any name too.

    The texts are measured twice, once for the hosts and once for the rows themselves, rather than written or
    shuffled between. Nulls, repeated rows and empty tables as in ``score``.
    """
    columns = [docs[c] for c in docs.columns]
    slim = measured(docs.select("text", F.col(host).alias("host"))).select("host", "quality_.rule_failed")
    hosts = host_verdicts(slim)
    whole = docs.select(F.struct(*columns).alias("row_"), F.col("text"), F.col(host).alias("host"))
    rows = measured(whole).where(~F.col("quality_.base_failed"))
    return _joined(rows, hosts).where("host_ok").select("row_.*")


def op10_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
