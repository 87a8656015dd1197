"""Document fingerprints: a threshold-scaled sketch of word shingles."""

from __future__ import annotations

import json
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from modweave.llm.common import let, table, words_of

#: Words in a shingle, and one over the fraction of the hash range that is kept.
SHINGLE, SCALE = 5, 8
#: Rows in a block of neighbouring ids, and the most such blocks; beyond both together blocks grow.
BLOCK_ROWS, MAX_BLOCKS = 1024, 10_000


def sketch(text: Column, shingle: int = SHINGLE, scale: int = SCALE) -> Column:
    """The sorted distinct shingle hashes of a text (not null) below the fixed fraction 1/``scale`` of the hash range.

    A text with fewer words than a shingle is one shingle; one without words has no shingle. A short text may have no
    hash below the threshold, so its sketch is empty and says nothing. Sketches of parts merge by union (``merged``)
    to the sketch of all their shingles.
    """
    bound = F.lit(-(2**63) + 2**64 // scale).cast("long")

    def of(h: Column) -> Column:
        all_ = F.when(F.size(h) >= shingle, F.transform(F.sequence(F.lit(0), F.size(h) - shingle), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(shingle)])))
        all_ = all_.when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<long>"))
        return F.sort_array(F.array_distinct(F.filter(all_, lambda x: x < bound)))

    return let(F.transform(words_of(F.lower(text)), lambda x: F.xxhash64(x)), of)


def merged(a: Column, b: Column) -> Column:
    """The sketch of the shingles of both."""
    return F.sort_array(F.array_union(a, b))


def likeness(a: Column, b: Column, same: Column | None = None) -> Column:
    """Estimated resemblance (Jaccard) of two sketches. Of two empty ones nothing is known but whether the texts are the ``same``: 1 or 0 (null if not given)."""
    both = F.size(F.array_intersect(a, b))
    none = F.lit(None).cast("double") if same is None else same.cast("double")
    return F.when(F.size(a) + F.size(b) == 0, none).otherwise(both / (F.size(a) + F.size(b) - both))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of ``a``'s shingles that ``b`` has; null (unknown) if ``a``'s sketch is empty."""
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a))


def as_text(s: Column) -> Column:
    return F.lower(F.array_join(F.transform(s, lambda x: F.lpad(F.hex(x), 16, "0")), ""))


def with_next(docs: DataFrame, key: str, tie: str, columns: list[str], derive=lambda df: df) -> DataFrame:
    """Each row with ``next_<column>`` of the row that follows by (key, tie), both long; the first follows the last.

    Rows are cut at approximate quantiles of the key into blocks of about ``BLOCK_ROWS``; a key that fills several
    is cut on by its ties (a hash, so evenly). Each block gets a copy of the next block's first row, so one shuffle
    by block and a sort within blocks suffice, with no global order on one task. To the driver come the block bounds
    (``MAX_BLOCKS`` at most). ``derive`` adds columns between the shuffle and the look-ahead.
    """
    n = docs.count()
    count = max(1, min(MAX_BLOCKS, -(-n // BLOCK_ROWS)))
    got = docs.agg(F.percentile_approx(key, [i / count for i in range(1, count)] or [0.5], 4 * MAX_BLOCKS)).first()[0] or []
    fills = Counter(got) if count > 1 else {}
    bounds = sorted((b, -(2**63) + i * 2**64 // r) for b, r in fills.items() for i in range(r))
    wide = max(1, int(len(bounds) ** 0.5))
    rows = [bounds[i : i + wide] for i in range(0, len(bounds), wide)]
    k, t = F.col(key), F.col(tie)
    # a few rows at a time, so that the plan's literals stay small
    literal = lambda x: F.from_json(F.lit(json.dumps(x)), "array<array<long>>" if x and isinstance(x[0], tuple) else "array<array<array<long>>>")
    if bounds:  # two short scans instead of one long one
        above = lambda xs: F.size(F.filter(xs, lambda b: (b[0] < k) | ((b[0] == k) & (b[1] <= t))))
        row = F.greatest(above(literal([r[0] for r in rows])) - 1, F.lit(0))
        block = row * wide + above(F.element_at(literal(rows), row + 1))
    else:
        block = F.lit(0)
    docs = docs.withColumn("block_", block.cast("int"))
    heads = sorted((r["block_"], r["m"]["k"], r["m"]["t"]) for r in docs.groupBy("block_").agg(F.min(F.struct(k.alias("k"), t.alias("t"))).alias("m")).collect())
    order = ["block_", "copy_", key, tie]
    all_ = docs.withColumn("copy_", F.lit(False))
    if heads:  # the first row goes to the last block
        before = [(k_, t_, heads[i - 1][0]) for i, (_, k_, t_) in enumerate(heads)]
        firsts = docs.where(k.isin(sorted({b[0] for b in before})))
        to = F.filter(literal(before), lambda b: (b[0] == k) & (b[1] == t))
        firsts = firsts.withColumn("to_", F.transform(to, lambda b: b[2].cast("int"))).where(F.size("to_") > 0)
        # of equal rows one is enough
        firsts = firsts.dropDuplicates([key, tie]).withColumn("block_", F.explode("to_")).drop("to_")
        all_ = all_.unionByName(firsts.withColumn("copy_", F.lit(True)))
    # rows of one block, in order, are already together when the window asks for them
    all_ = derive(all_.repartition("block_").sortWithinPartitions(*order))
    w = Window.partitionBy("block_").orderBy("copy_", key, tie)
    return all_.withColumns({f"next_{c}": F.lead(c).over(w) for c in columns}).where(~F.col("copy_")).drop("block_", "copy_")


def fingerprint(docs: DataFrame, shingle: int = SHINGLE, scale: int = SCALE) -> DataFrame:
    """Sketches of each whole text and of its half-replaced text, with their likeness to each other and to the next text's.

    Null text: the empty text. A null id comes first; equal ids follow in the order of a hash of the text. Rows
    repeated whole follow each other and share a block. With a single row, the next one is itself. ``within_next``
    and ``within_edited`` are null where the text's sketch is empty; likeness of two empty sketches is 1 for equal
    texts, else 0. An empty table gives an empty result. Extra columns are not read.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t"), F.coalesce("doc_id", F.lit(-(2**63))).alias("k"))
    rows = rows.withColumn("tie", F.xxhash64("t"))
    sketched = lambda df: df.withColumn("s", sketch(F.col("t"), shingle, scale))
    rows = with_next(rows, "k", "tie", ["t", "s"], sketched).withColumn("n_chars", F.length("t").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    rows = rows.withColumn("edited", F.concat(F.left("t", (F.col("n_chars") - half).cast("int")), F.left("next_t", half)))
    rows = rows.withColumn("e", sketch(F.col("edited"), shingle, scale))
    s, e, x, t = F.col("s"), F.col("e"), F.col("next_s"), F.col("t")
    return rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), as_text(s).alias("fingerprint"), as_text(e).alias("edited_fingerprint"),
        likeness(s, e, t == F.col("edited")).alias("near_edited"), likeness(s, x, t == F.col("next_t")).alias("near_next"), containment(s, e).alias("within_edited"), containment(s, x).alias("within_next"),
    )


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint(table(spark, sf_dir, "documents"))
