"""Mixing sources to target weights by Pfair scheduling of equal blocks."""

from __future__ import annotations

import heapq
from bisect import bisect_left
from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from modweave.llm.common import cut, inline, join_sized, table

#: Blocks into which all bytes are cut (each source has one part-filled more), and parts of a source's prefix sum.
BLOCKS, PARTS = 4096, 1024
#: Without given weights, a source's weight is its bytes to this power.
ALPHA = 0.5
#: Streams into which sources smaller than a block are pooled, and what their names begin with.
POOLS, POOL = 64, "\0pool "


def windows(blocks: dict[str, int], weights: dict[str, int]) -> list[tuple[int, int, str, int]]:
    """``(release, deadline, source, block)`` of each block under the ideal fluid mix.

    Sources run at their target weights, scaled to 1 over those that still have blocks; when one is used up the
    others share its part, so that everything is placed once. Block k of a source is released at the floor of the
    time at which the fluid mix has given the source k blocks, its deadline is the ceiling of that for k + 1.
    Sources without weight come after all others, with equal shares.

    A source of weight w has had v * w blocks when the common clock shows v, and is used up at v = blocks / w. So the
    time at v is the sum of min(v * w, blocks): with the sources in the order in which they are used up, one sum of
    blocks before and one of weights after it. All in integers; the work is that of sorting.
    """
    out, start = [], 0
    for live in ([s for s in blocks if weights[s] > 0], [s for s in blocks if weights[s] <= 0]):
        rate = {s: max(weights[s], 1) for s in live}
        live = sorted((s for s in live if blocks[s]), key=lambda s: (Fraction(blocks[s], rate[s]), s))
        ends = [Fraction(blocks[s], rate[s]) for s in live]
        used, running = [start], [sum(rate[s] for s in live)]
        for s in live:
            used.append(used[-1] + blocks[s])
            running.append(running[-1] - rate[s])
        for s in live:
            w, i = rate[s], 0
            before = (start, 1)  # time as numerator and denominator
            for k in range(1, blocks[s] + 1):
                i = bisect_left(ends, Fraction(k, w), lo=i)
                now = (used[i] * w + k * running[i], w)
                out.append((before[0] // before[1], -(-now[0] // now[1]), s, k - 1))
                before = now
        start = used[-1]
    return out


def earliest_deadline_first(jobs: list[tuple[int, int, str, int]]) -> list[dict]:
    """A slot for each block: of those released, the one with the earliest deadline. Every deadline is met."""
    jobs = sorted(jobs)
    ready, out, i = [], [], 0
    for slot in range(len(jobs)):
        while i < len(jobs) and jobs[i][0] <= slot:
            release, deadline, source, block = jobs[i]
            heapq.heappush(ready, (deadline, release, source, block))
            i += 1
        deadline, release, source, block = heapq.heappop(ready)
        if slot >= deadline:
            raise AssertionError(f"block {block} of {source} misses its deadline")
        out.append({"src": source, "b": block, "release": release, "deadline": deadline, "slot": slot})
    return out


def sized(docs: DataFrame, source: str = "source") -> list[Column]:
    """What the schedule of a row depends on: ``src, size, h``."""
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    return [F.coalesce(docs[source].cast("string"), F.lit("")).alias("src"), (F.octet_length(text) + 1).cast("long").alias("size"), F.xxhash64(docs["doc_id"], text).alias("h")]


def mix(docs: DataFrame, weights: dict[str, float] | None = None, blocks: int = BLOCKS, source: str = "source", carry: list[str] | None = None) -> DataFrame:
    """``row_`` (struct of the columns ``carry``, by default all), ``src, size, block, release, deadline, slot, start``.

    Each source's rows, in the order of a hash, are cut into blocks of equal bytes (total over ``blocks``), and
    the blocks are interleaved so that at every slot a source is less than one block from its target. All rows
    are kept, once. ``weights`` may name target weights; a source without one comes after all that have one.
    By default a weight is bytes to the power ``ALPHA``.

    A source's prefix sum is made in ``PARTS`` parts, so that a source with a third of all rows is not one task.
    A source of less than a block is no stream of its own: such sources are pooled by a hash of their names into
    ``POOLS`` streams, each with its sources' weights together. So there are at most ``blocks + POOLS`` streams, and
    to the driver come their totals and the schedule, of at most ``2 * blocks + POOLS`` rows, however many sources
    there are. Null text counts one byte; a null source is the source ''. Rows equal in id and text are placed next
    to each other, in one part. ``carry`` keeps columns of any name, as they are inside ``row_``. An empty table
    gives an empty result.
    """
    columns = [docs[c] for c in carry or docs.columns]
    return scheduled(docs.select(F.struct(*columns).alias("row_"), *sized(docs, source)), weights, blocks)


def scheduled(rows: DataFrame, weights: dict[str, float] | None = None, blocks: int = BLOCKS) -> DataFrame:
    """``mix`` of rows ``row_, src, size, h``; ``row_`` has a ``doc_id``."""
    spark = rows.sparkSession
    rows = rows.withColumn("part", F.pmod("h", F.lit(PARTS)).cast("int"))
    parts = cut(rows.groupBy("src", "part").agg(F.sum("size").alias("bytes")))
    total = parts.agg(F.sum("bytes")).first()[0] or 0
    block_bytes = max(1, -(-total // blocks))
    sources = parts.groupBy("src").agg(F.sum("bytes").alias("bytes"))
    given = F.create_map(*[F.lit(x) for kv in (weights or {"": 0.0}).items() for x in kv])
    weight = F.coalesce(F.try_element_at(given, F.col("src")), F.lit(0.0)).cast("double") if weights else F.pow("bytes", F.lit(ALPHA))
    small = F.col("bytes") < block_bytes
    pool = F.concat(F.lit(POOL), F.pmod(F.xxhash64("src"), F.lit(POOLS)).cast("string"))
    sources = sources.withColumn("stream", F.when(small, pool).otherwise(F.col("src"))).withColumn("weight", weight)
    sources = cut(sources.select(F.col("src").alias("of_"), "stream", "bytes", "weight"))
    streams = {r["stream"]: r for r in sources.groupBy("stream").agg(F.sum("bytes").alias("bytes"), F.sum("weight").alias("weight")).collect()}
    totals = {s: r["bytes"] for s, r in streams.items()}
    top = max((r["weight"] for r in streams.values()), default=0.0) or 1.0
    w = {s: max(int(r["weight"] > 0), round(1e6 * r["weight"] / top)) for s, r in streams.items()}
    n = {s: -(-b // block_bytes) for s, b in totals.items()}
    plan = inline(spark, earliest_deadline_first(windows(n, w)), "src string, b long, release long, deadline long, slot long")
    # streams times PARTS rows in all; each stream's are summed in order
    parts = parts.join(sources.select("of_", "stream"), F.col("src") == F.col("of_")).groupBy("stream", "part").agg(F.sum("bytes").alias("bytes"))
    base = parts.withColumn("base", F.sum("bytes").over(Window.partitionBy("stream").orderBy("part")) - F.col("bytes")).select(F.col("stream").alias("s_"), F.col("part").alias("p_"), "base")
    rows = join_sized(rows, sources.select("of_", "stream"), F.col("src") == F.col("of_"))
    rows = rows.join(base, (F.col("stream") == F.col("s_")) & (F.col("part") == F.col("p_")))
    inner = Window.partitionBy("stream", "part").orderBy("h", "src", "row_.doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("start", F.col("base") + F.sum("size").over(inner) - F.col("size"))
    rows = rows.withColumn("block", F.expr(f"start div {block_bytes}L"))
    # the schedule's length doesn't grow with the rows
    plan = plan.withColumnRenamed("src", "ps_")
    rows = rows.join(F.broadcast(plan), (F.col("stream") == F.col("ps_")) & (F.col("block") == F.col("b")))
    return rows.select("row_", "src", "size", "block", "release", "deadline", "slot", "start")


def positions(mixed: DataFrame) -> DataFrame:
    """``mixed`` with the gapless place of each row in the whole mix. One row a slot is summed in order."""
    mixed = cut(mixed)
    per = mixed.groupBy("slot").agg(F.count(F.lit(1)).alias("rows_"))
    per = per.select(F.col("slot").alias("sl_"), (F.sum("rows_").over(Window.orderBy("slot")) - F.col("rows_")).alias("before_"))
    at = F.row_number().over(Window.partitionBy("slot").orderBy("start", "doc_id")) - 1
    return mixed.join(F.broadcast(per), F.col("slot") == F.col("sl_")).withColumn("position", F.col("before_") + at)


def in_order(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, whole, sorted into the mix: files written from it follow the schedule."""
    return mix(docs, **options).repartitionByRange(F.col("slot"), F.col("start")).sortWithinPartitions("slot", "start").select("row_.*")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    slim = mix(table(spark, sf_dir, "documents"), carry=["doc_id"]).select("row_.doc_id", F.col("src").alias("source"), "size", "block", "release", "deadline", "slot", "start")
    return positions(slim).select("doc_id", "source", "size", "block", "release", "deadline", "slot", "position")
