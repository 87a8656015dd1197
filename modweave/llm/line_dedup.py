"""Line dedup by a suffix array over line ids: later copies of maximal repeated line runs are deleted."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from modweave.llm.common import cut, join_sized, table

#: Words a repeated run must have for its later copies to go.
MIN_WORDS = 5

#: A document: its id (null: the least long), the hash and the length of its text.
DOC = ["k", "d", "z"]
AT = [*DOC, "ln"]


def line_table(docs: DataFrame) -> DataFrame:
    """``k, d, z, ln, h, h2, nw``: each line of each document with its id (a 64-bit hash), a second hash and its words."""
    t = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(*doc_key(t), F.posexplode(F.split(t, "\n")).alias("ln", "line"))
    return rows.select(*AT, F.xxhash64("line").alias("h"), F.xxhash64(F.lit(1), "line").alias("h2"), F.regexp_count("line", F.lit(r"[^\x20\x09-\x0D]+")).alias("nw"))


def doc_key(text) -> list:
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("k"), F.xxhash64(text).alias("d"), F.octet_length(text).alias("z")]


def _ranked(f: DataFrame) -> DataFrame:
    """Prefix doubling. ``f``: all lines of some documents with ``h0, h1`` (this line's id and the next's) and ``act``
    (others begin with the same two lines). Adds ``subs``: a suffix's rank among those with its first two lines,
    by its first 4, 8, 16 ... lines.

    In each round, suffixes equal in their first w lines are ordered by the rank of what follows these. Only
    suffixes that still have equals take part. Rounds end when there are none, or w passes the longest document.
    """
    longest = f.agg(F.max("ln")).first()[0] or 0
    f = f.withColumn("subs", F.array().cast("array<long>"))
    w = 2
    while w <= longest and not f.where("act").isEmpty():
        last = F.coalesce(F.get("subs", F.size("subs") - 1), F.lit(0).cast("long"))
        there = F.lead(F.struct("h0", "h1", last.alias("s")), w).over(Window.partitionBy(*DOC).orderBy("ln"))
        f = f.withColumn("next", there).withColumn("s", last)
        same = Window.partitionBy("h0", "h1", "s")
        rank = F.col("s") + F.rank().over(same.orderBy("next")) - 1
        equals = F.count(F.lit(1)).over(Window.partitionBy("h0", "h1", "s", "next"))
        on = f.where("act").withColumn("rank", rank).withColumn("act", equals > 1)
        on = on.withColumn("subs", F.concat("subs", F.array("rank"))).drop("rank")
        f = cut(on.unionByName(f.where("not act")).drop("next", "s"))
        w *= 2
    return f


def _with_lcp(f: DataFrame) -> DataFrame:
    """The suffix array of each two-line class with ``lcp``: lines in common with the suffix before it (0: first of its class).

    Where neighbours part is known to a power of two from their ranks; the rest comes by descent over the smaller
    powers, by looking up the ranks at the places reached.
    """
    end = F.max("ln").over(Window.partitionBy(*DOC)) + 1
    f = cut(f.withColumn("rem", end - F.col("ln")))
    sub = F.get("subs", F.size("subs") - 1)
    order = Window.partitionBy("h0", "h1").orderBy(sub, *AT)
    me = F.struct(*AT, "subs", "rem")
    pairs = f.where("inclass").withColumn("sub", F.coalesce(sub, F.lit(0).cast("long"))).withColumn("prev", F.lag(me).over(order))
    both = F.arrays_zip(F.col("subs").alias("a"), F.col("prev.subs").alias("b"))
    agreed = F.size(F.filter(both, lambda x: x["a"] == x["b"]))  # ranks agree up to where neighbours part
    pairs = pairs.withColumn("agreed", F.when(F.col("prev").isNull(), F.lit(-1)).otherwise(agreed))
    pairs = pairs.withColumn("lcp", F.expr("if(agreed < 0, 0, shiftleft(1, agreed + 1))"))
    pairs = pairs.withColumn("end", F.least("rem", "prev.rem"))
    pairs = cut(pairs.select("h0", "h1", "sub", *AT, F.struct("prev.k", "prev.d", "prev.z", "prev.ln").alias("p"), "agreed", "lcp", "end"))
    top = pairs.agg(F.max("agreed")).first()[0]
    names = f.select(*AT, "h0", "h1", "subs")
    for q in range(top if top is not None else -1, -1, -1):
        # level q names 2**q lines; only neighbours that part at this level or above, and are not at an end, are looked up
        if q == 0:
            name = [F.col("h0")]
        elif q == 1:
            name = [F.col("h0"), F.col("h1")]
        else:
            name = [F.col("h0"), F.col("h1"), F.get("subs", F.lit(q - 2))]
        known = names.select(*AT, F.struct(*name).alias("name"))
        if q:
            known = known.where(name[-1].isNotNull())
        open_ = (F.col("agreed") + 1 > q) & (F.col("lcp") < F.col("end"))
        mine = known.select(*[F.col(c).alias(f"a_{c}") for c in AT], F.col("name").alias("a_name"))
        theirs = known.select(*[F.col(c).alias(f"b_{c}") for c in AT], F.col("name").alias("b_name"))
        ask = pairs.where(open_)
        got = ask.join(mine, [F.col(c) == F.col(f"a_{c}") for c in DOC] + [F.col("ln") + F.col("lcp") == F.col("a_ln")], "left")
        got = got.join(theirs, [F.col(f"p.{c}") == F.col(f"b_{c}") for c in DOC] + [F.col("p.ln") + F.col("lcp") == F.col("b_ln")], "left")
        grown = F.when(F.col("a_name") == F.col("b_name"), F.col("lcp") + (1 << q)).otherwise(F.col("lcp"))
        got = got.withColumn("lcp", grown).select(*pairs.columns)
        pairs = cut(got.union(pairs.where(~open_ | open_.isNull())))
    return pairs.withColumn("lcp", F.when(F.col("agreed") < 0, F.lit(0)).otherwise(F.least("lcp", "end")))


def _longest_previous(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Longest earlier match of each suffix, from classes in suffix-array order with their LCPs (0 begins a class).

    One pass with a stack of open LCP intervals. A suffix that comes later in the corpus than the one on top, with
    no more in common with what follows, is settled and leaves; so equal runs don't pile up, and the stack is no
    deeper than the longest common run.
    """
    stack: list[tuple[tuple, int]] = []
    for df in batches:
        out: list[tuple] = []

        def settle(top: tuple[tuple, int], m: int) -> None:
            if m > 1:
                out.append((*top[0], m))

        for k, d, z, ln, lcp in zip(df["k"].tolist(), df["d"].tolist(), df["z"].tolist(), df["ln"].tolist(), df["lcp"].tolist()):
            me = (k, d, z, ln)
            if lcp == 0:
                for top in stack:
                    settle(top, top[1])
                stack = []
            while stack and (me < stack[-1][0] or lcp <= stack[-1][1]):
                top = stack.pop()
                if me < top[0]:
                    settle(top, max(top[1], lcp))
                    lcp = min(top[1], lcp)
                else:
                    settle(top, top[1])
            stack.append((me, lcp))
        yield pd.DataFrame(out, columns=[*AT, "m"])
    yield pd.DataFrame([(*p, m) for p, m in stack if m > 1], columns=[*AT, "m"])


def _deleted(min_words: int):
    def deleted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for b in batches:
            runs = []
            for lines in b.column("lines").to_pylist():
                n = len(lines)
                words = np.concatenate([[0], np.cumsum([x["nw"] for x in lines])])
                m = np.array([x["m"] for x in lines])
                s = np.flatnonzero(m)
                s = s[words[s + m[s]] - words[s] >= min_words]
                cover = np.zeros(n + 1, np.int64)
                np.add.at(cover, s, 1)
                np.add.at(cover, s + m[s], -1)
                edge = np.flatnonzero(np.diff(np.concatenate([[0], np.cumsum(cover[:-1]) > 0, [0]]).astype(np.int8)))
                runs.append([{"start": x, "end": y} for x, y in edge.reshape(-1, 2).tolist()])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in DOC), pa.array(runs, runs_type)], [*DOC, "runs"])

    return deleted


def distinct_ids(own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``own`` and its ids ``h_`` met more than once, with their count ``c`` and first place ``f``.

    Where different lines share a 64-bit id, as the second hash shows, the id is made anew of both; so lines are
    taken for equal on 128 bits, while only 64 are carried through the suffix array.
    """
    ids = own.groupBy("h").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct(*AT)).alias("f"), F.min("h2").alias("a"), F.max("h2").alias("b"))
    met = cut(ids.where("c > 1").withColumnRenamed("h", "h_"))
    mixed = met.where("a < b").select(F.col("h_").alias("mixed_"))
    if mixed.isEmpty():
        return own, met.select("h_", "c", "f")
    own = join_sized(own, cut(mixed), F.col("h") == F.col("mixed_"), "left")
    own = own.withColumn("h", F.when(F.col("mixed_").isNull(), F.col("h")).otherwise(F.xxhash64("h2", "h"))).drop("mixed_")
    return own, own.groupBy("h").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct(*AT)).alias("f")).where("c > 1").withColumnRenamed("h", "h_")


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``k, d, z, n_lines, runs``: each document's deleted line runs (start, end), by id and text.

    Documents are in the order of their ids; a run of lines goes if the same lines stand in a row earlier, in
    another document or this one, and the longest such run from some line on has ``min_words`` words or more.

    Copies of a whole text stand for one document first. Lines met once begin no repeated run, so the suffix
    array is made only for documents in which two lines in a row are repeated in a row elsewhere; runs of one
    line need only each line's first place. Counts and first places are pre-aggregated, so a line on a third of
    the rows is no hot group. Extra columns are not read. Null text: one empty line. An empty table: no rows.
    """
    lines = cut(line_table(docs.select("doc_id", "text")))
    whole = lines.groupBy(*DOC).agg(F.count(F.lit(1)).cast("int").alias("n_lines"), F.sum("nw").alias("words"))
    first = whole.groupBy("d", "z").agg(F.min("k").alias("k"), F.count(F.lit(1)).alias("copies"))
    whole = cut(whole.join(first.select("d", "z", F.col("k").alias("of"), "copies"), ["d", "z"]))
    copied = whole.where("k != of").select(*DOC, "n_lines", F.when(F.col("words") >= min_words, F.array(F.struct(F.lit(0).alias("start"), F.col("n_lines").alias("end")))).otherwise(F.array().cast("array<struct<start:int,end:int>>")).alias("runs"))
    own = lines.join(whole.where("copies > 1 and k != of").select(*DOC), DOC, "left_anti") if not copied.isEmpty() else lines
    own = own.dropDuplicates(AT)
    own, met = distinct_ids(own)
    rows = own.join(met, F.col("h") == F.col("h_"), "left")
    rows = rows.select(*AT, "h", "nw", F.col("h_").isNotNull().alias("rep"), F.coalesce(F.struct(*AT) != F.col("f"), F.lit(False)).alias("again"))
    doc = Window.partitionBy(*DOC)
    rows = rows.withColumn("any", F.max("rep").over(doc)).where("any")
    rows = cut(rows.withColumn("h1", F.lead("h").over(doc.orderBy("ln"))).withColumn("two", F.col("rep") & F.coalesce(F.lead("rep").over(doc.orderBy("ln")), F.lit(False))))
    classes = rows.where("two").groupBy("h", "h1").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select(F.col("h").alias("g0"), F.col("h1").alias("g1"))
    f = rows.select(*AT, F.col("h").alias("h0"), "h1", "two").join(classes, (F.col("h0") == F.col("g0")) & (F.col("h1") == F.col("g1")) & F.col("two"), "left")
    f = f.withColumn("act", F.col("g0").isNotNull()).withColumn("any", F.max("act").over(doc)).where("any")
    f = cut(f.select(*AT, "h0", "h1", "act", F.col("act").alias("inclass")))
    longer = None
    if not f.isEmpty():
        array = _with_lcp(_ranked(f)).repartition("h0", "h1").sortWithinPartitions("h0", "h1", "sub", *AT)
        longer = array.select(*AT, "lcp").mapInPandas(_longest_previous, "k long, d long, z int, ln int, m int")
        longer = cut(longer.groupBy(*AT).agg(F.max("m").alias("m")))
    m = F.when(F.col("again"), F.lit(1)).otherwise(F.lit(0))
    if longer is not None:
        rows = rows.join(longer, AT, "left")
        m = F.coalesce("m", m)
    line = F.struct("ln", "nw", m.cast("int").alias("m"))
    per = rows.groupBy(*DOC).agg(F.sort_array(F.collect_list(line)).alias("lines"), F.max("again").alias("hit")).where("hit")
    runs = per.drop("hit").mapInArrow(_deleted(min_words), "k long, d long, z int, runs array<struct<start:int,end:int>>")
    none = F.array().cast("array<struct<start:int,end:int>>")
    kept = whole.where("k = of").join(runs, DOC, "left").select(*DOC, "n_lines", F.coalesce("runs", none).alias("runs"))
    return kept.union(copied)


def dedup(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The rows of ``docs``, all columns, without later copies of repeated line runs; ``n_chars``, if there, is brought up to date.

    A row of which nothing is left goes; one whose text had no lines to delete stays as it is. Extra columns, of any name, stay. Null text: no
    lines. Rows equal in id and text are treated alike, as one document. A null id comes first. An empty table
    gives an empty result.
    """
    found = cut(repeated_runs(docs, min_words).where(F.size("runs") > 0))
    t = F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = F.struct(*doc_key(t))
    names = docs.columns
    rows = docs.select(F.struct(*[docs[c] for c in names]).alias("row_"), F.col("text"), key.alias("key_"))
    cond = [F.col(f"key_.{c}") == F.col(f"r_{c}") for c in DOC]
    small = found.select(*[F.col(c).alias(f"r_{c}") for c in DOC], F.col("runs").alias("runs_"), "n_lines")
    rows = rows.join(small, cond, "left")  # each key is on one side once, so texts are shuffled by it at any size
    gone = F.aggregate("runs_", F.lit(0), lambda a, r: a + r["end"] - r["start"])
    rows = rows.where(F.col("runs_").isNull() | (gone < F.col("n_lines")))
    left = F.filter(F.split("text", "\n"), lambda x, i: ~F.exists("runs_", lambda r: (r["start"] <= i) & (i < r["end"])))
    text = F.when(F.col("runs_").isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))
    rows = rows.select("row_", text.alias("new_"))
    put = {"text": F.col("new_")}
    if "n_chars" in names:
        put["n_chars"] = F.when(F.col("new_").isNull(), F.col("row_.n_chars")).otherwise(F.length("new_").cast(docs.schema["n_chars"].dataType))
    return rows.select(*[put.get(c, F.col("row_").getField(c)).alias(c) for c in names])


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, n_lines, n_deleted, runs`` of every document; a run is ``start-end``, joined by commas."""
    docs = table(spark, sf_dir, "documents")
    runs = repeated_runs(docs)
    rows = docs.select("doc_id", *doc_key(F.coalesce(F.col("text"), F.lit(""))))
    found = rows.join(runs, DOC)
    gone = F.aggregate("runs", F.lit(0), lambda a, r: a + r["end"] - r["start"])
    text = F.array_join(F.transform("runs", lambda r: F.concat_ws("-", r["start"].cast("string"), r["end"].cast("string"))), ",")
    return found.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), gone.cast("long").alias("n_deleted"), text.alias("runs"))
