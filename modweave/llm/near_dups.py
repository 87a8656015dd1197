"""Near-duplicate documents: SuperMinHash signatures, banding, exact verification and union-find."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modweave.llm.common import cut, join_sized, table
from modweave.operators.components import components

#: Words of a shingle in the query and in the pipeline's stage (8 at most), and the likeness of near-duplicates.
SHINGLE, STAGE_SHINGLE, PERCENT = 4, 5, 80
#: 32 bands of 4 rows: of two sets just at 0.8, (1 - 0.8**4)**32 = 5e-8 share no band.
BANDS, BAND_ROWS = 32, 4
ROWS = BANDS * BAND_ROWS
#: Slots of two signatures (one byte each) that must agree before full sets are compared: at 0.8 some 102 of 128 do,
#: and 77 are 5.7 standard deviations below.
AGREE = 77
#: Shingles whose permutations are held at a time, and members compared with one copy of a centre.
ELEMENTS, CHUNK = 150_000, 256

_U = np.uint64
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], _U)
_NONE = _U(2**64 - 1)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingle_sets(texts: list[bytes | None], shingle: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's shingles of ``shingle`` words."""
    split = [(t or b"").lower().split() for t in texts]  # bytes: A-Z only, ASCII white space only
    counts = np.array([len(w) for w in split], np.int64)
    h = np.fromiter((x for w in split for x in map(xxhash.xxh3_64_intdigest, w)), _U, int(counts.sum()))
    ends = np.cumsum(counts)
    rolled = np.zeros(len(h), _U)
    if len(h) >= shingle:
        n = len(h) - shingle + 1
        s = np.zeros(n, _U)
        for k in range(shingle):
            s += h[k : k + n] * _MULTIPLIERS[k]
        rolled[:n] = mixed(s)
    out = []
    for end, n in zip(ends.tolist(), counts.tolist()):
        if n >= shingle:
            out.append(np.unique(rolled[end - n : end - shingle + 1]))
        elif n:
            out.append(mixed((h[end - n : end] * _MULTIPLIERS[:n]).sum(keepdims=True) + _U(n)))
        else:
            out.append(np.empty(0, _U))
    return out


def superminhash(sets: list[np.ndarray], m: int = ROWS) -> np.ndarray:
    """SuperMinHash signatures, one row a set (an empty set: all ones).

    Each element draws a random permutation of the m slots step by step (Fisher-Yates): in step j it offers
    ``j + u`` (here j in the top bits of an integer) to its j-th slot, and a slot keeps its least offer. All
    elements of all sets take step j together; a set is done once every slot has an offer from a step up to j,
    as later ones can only be larger.
    """
    low = np.full((len(sets), m), _NONE, _U)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    if not len(owner):
        return low
    e = np.concatenate(sets)
    p = np.empty((len(e), m), np.uint8)
    p[:] = np.arange(m, dtype=np.uint8)
    at = np.arange(len(e))
    flat = low.reshape(-1)
    for j in range(m):
        r = mixed(e + _U((j + 1) * 0x9E3779B97F4A7C15 % 2**64))
        k = j + ((r & _U(0xFFFFFFFF)) % _U(m - j)).astype(np.int64)
        slot = p[at, k]
        p[at, k] = p[at, j]
        np.minimum.at(flat, owner * m + slot, (_U(j) << _U(57)) | (mixed(r) >> _U(7)))
        done = (low.max(axis=1) >> _U(57)) <= j
        go = ~done[owner]
        if not go.all():
            e, owner, at = e[go], owner[go], at[go]
            if not len(e):
                break
    return low


def band_keys(signatures: np.ndarray) -> np.ndarray:
    s = signatures.reshape(len(signatures), BANDS, BAND_ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=_U) * _MULTIPLIERS[0], s.shape[:2])
    for k in range(BAND_ROWS):
        key = mixed(key + s[:, :, k])
    return key.view(np.int64)


def _signed(shingle: int):
    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            ids = batch.column("doc_id")
            lo = 0
            while lo < len(texts):
                hi, size = lo, 0
                while hi < len(texts) and (hi == lo or size < ELEMENTS * 6):
                    size += len(texts[hi] or b"")
                    hi += 1
                sets = shingle_sets(texts[lo:hi], shingle)
                low = superminhash(sets)
                keys = band_keys(low)
                yield pa.RecordBatch.from_arrays([
                    ids.slice(lo, hi - lo), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                    pa.ListArray.from_arrays(np.arange(0, (hi - lo + 1) * BANDS, BANDS, dtype=np.int32), pa.array(keys.reshape(-1))),
                    pa.array([x.tobytes() for x in low.astype(np.uint8)], pa.binary()),
                ], ["doc_id", "n_shingles", "digest", "bands", "sig"])
                lo = hi

    return signed


def _with_sets(shingle: int):
    def with_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()  # rows repeated within a task go no further
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                b = batch.slice(lo, 256)
                out = []
                for i, s in zip(b.column("doc_id").to_pylist(), shingle_sets(b.column("text").cast(pa.binary()).to_pylist(), shingle)):
                    digest = xxhash.xxh3_128_digest(raw := s.tobytes())
                    if (i, digest) not in seen:
                        seen.add((i, digest))
                        out.append((i, digest, raw))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out) if out else ((), (), ()), (pa.int64(), pa.binary(), pa.binary()))], ["id", "digest", "set"])

    return with_sets


def sets_of(docs: DataFrame, ids: DataFrame, shingle: int) -> DataFrame:
    """``id, digest, set`` of the texts with these ids, partitioned by id; equal sets of one id once."""
    slim = docs.select("doc_id", "text").where("doc_id is not null")
    texts = join_sized(slim, ids, F.col("doc_id") == F.col("id"), "left_semi")
    sets = texts.mapInArrow(_with_sets(shingle), "id long, digest binary, set binary")
    return sets.repartition("id").dropDuplicates(["id", "digest"])


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    a, b = (a, b) if len(a) <= len(b) else (b, a)
    if 100 * len(a) < PERCENT * len(b):
        return False
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = int(np.count_nonzero(b[at] == a))
    return 100 * both >= PERCENT * (len(a) + len(b) - both)


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (centre, salt), the centre's own first: one centre's sets are in memory at a time.

    A centre has more than one set only where rows of one id have several texts.
    """
    centre, of, was_own = None, [], False
    for batch in batches:
        c, own, ids, sets = (batch.column(x) for x in ("c", "own", "id", "set"))
        out_c, out_id = [], []
        for row_c, is_own, i, raw in zip(c.to_pylist(), own.to_pylist(), ids.to_pylist(), sets.to_pylist()):
            s = np.frombuffer(raw, _U)
            if is_own:
                of = [*of, s] if was_own and centre == row_c else [s]
                centre, was_own = row_c, True
                continue
            was_own = False
            if centre != row_c:
                raise AssertionError("a member came before its centre")
            if any(alike(s, x) for x in of):
                out_c.append(row_c)
                out_id.append(i)
        yield pa.RecordBatch.from_arrays([pa.array(out_c, pa.int64()), pa.array(out_id, pa.int64())], ["src", "dst"])


def verified(pairs: DataFrame, docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """The pairs ``(c, id)`` whose full sets are alike. A centre goes with each chunk of about ``CHUNK`` of its members."""
    chunks = pairs.groupBy("c").agg((F.ceil(F.count(F.lit(1)) / CHUNK)).cast("int").alias("chunks"))
    wide = pairs.join(chunks, "c")
    members = wide.select("id", "c", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int").alias("salt"), F.lit(False).alias("own"))
    centres = chunks.select(F.col("c").alias("id"), "c", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("salt"), F.lit(True).alias("own"))
    asked = cut(members.union(centres))
    sets = sets_of(docs, cut(asked.select("id").distinct()), shingle)
    rows = asked.join(sets, "id").select("c", "own", "id", "salt", "set")
    rows = rows.repartition("c", "salt").sortWithinPartitions("c", "salt", F.col("own").desc())
    return rows.mapInArrow(_verified, "src long, dst long")


def _agreeing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            a, b = (np.frombuffer(b"".join(batch.column(x).to_pylist()), np.uint8).reshape(-1, ROWS) for x in ("sig_c", "sig_id"))
            keep = np.count_nonzero(a == b, axis=1) >= AGREE
            yield pa.RecordBatch.from_arrays([batch.column(x).filter(pa.array(keep)) for x in ("c", "id")], ["c", "id"])


def agreeing(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs ``(c, id)`` whose signatures agree in ``AGREE`` slots or more, so that few full sets are shuffled in vain."""
    sigs = classes.select("rep", "sig")
    wide = pairs.join(sigs.select(F.col("rep").alias("c"), F.col("sig").alias("sig_c")), "c")
    wide = wide.join(sigs.select(F.col("rep").alias("id"), F.col("sig").alias("sig_id")), "id").select("c", "id", "sig_c", "sig_id")
    return cut(wide.mapInArrow(_agreeing, "c long, id long").distinct())


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for each row of ``docs(doc_id, text)``, by shingles of ``shingle`` words.

    Texts with equal shingle sets are one class, stood for by its least id, so copies are never paired. A band's
    classes are compared with the least one of them (a star, not all pairs); links are confirmed on full sets and
    joined up. The classes of bands that then still hold several components are joined exactly, whatever their
    bands, by the rarest fifth of their shingles (``_rest``), so no link that any band shows is lost. Pairs whose
    signatures are too far apart for 0.8 are put aside before that. Exact links only: 100 * common >= 80 * union.

    Null text or no words: n_shingles 0, linked with nothing. Rows with one id are one document, linked as any
    of them is. A null id links with nothing and is kept. An empty table gives an empty result. Extra columns
    are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = cut(docs.mapInArrow(_signed(shingle), "doc_id long, n_shingles long, digest binary, bands array<long>, sig binary"))
    classes = signed.where("n_shingles > 0 and doc_id is not null").groupBy("digest")
    classes = cut(classes.agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("sig").alias("sig")))
    spread = classes.select(F.explode("bands").alias("key"), "rep", "n").repartition("key")
    least = spread.groupBy("key").agg(F.count(F.lit(1)).alias("in_band"), F.min(F.struct("rep", "n")).alias("first")).where("in_band > 1")
    shared = cut(spread.join(least, "key").select("key", "rep", "n", "first"))
    near = lambda a, b: 100 * F.least(a, b) >= PERCENT * F.greatest(a, b)
    star = shared.where((F.col("rep") != F.col("first.rep")) & near(F.col("n"), F.col("first.n")))
    star = agreeing(star.select(F.col("first.rep").alias("c"), F.col("rep").alias("id")).distinct(), classes)
    several = _several(signed, classes)
    own = several.where("rep != least").select(F.col("least").alias("src"), F.col("rep").alias("dst"))
    links = cut(verified(star, docs, shingle).union(own))
    grouped = components(links)
    rest = _rest(_left(shared, grouped), docs, shingle, near).join(star, ["c", "id"], "left_anti")
    rest = agreeing(rest, classes)
    if not rest.isEmpty():
        links = cut(links.union(verified(rest, docs, shingle)))
        grouped = components(links)
    found = signed.join(classes.select("digest", "rep"), "digest", "left").join(grouped, F.col("rep") == F.col("node"), "left")
    whole = several.select(F.col("doc_id").alias("several_"), "least").distinct().join(grouped, F.col("least") == F.col("node"), "left")
    whole = cut(whole.select("several_", F.coalesce("component", "least").alias("whole_")))
    found = join_sized(found, whole, F.col("doc_id") == F.col("several_"), "left")
    c = F.when(F.col("doc_id").isNull(), F.col("doc_id")).otherwise(F.coalesce("whole_", "component", "rep", "doc_id"))
    found = found.select("doc_id", "n_shingles", c.alias("component_id"))
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _several(signed: DataFrame, classes: DataFrame) -> DataFrame:
    """``doc_id, rep, least`` for the classes of each id that has several texts: the least class joins its others."""
    ids = signed.where("doc_id is not null").groupBy("doc_id").agg(F.min("digest").alias("a"), F.max("digest").alias("b"))
    ids = cut(ids.where("a != b").select(F.col("doc_id").alias("id")))
    rows = join_sized(signed, ids, F.col("doc_id") == F.col("id"), "left_semi")
    reps = rows.join(classes.select("digest", "rep"), "digest").select("doc_id", "rep").distinct()
    return cut(reps.join(reps.groupBy("doc_id").agg(F.min("rep").alias("least")), "doc_id"))


def _left(shared: DataFrame, grouped: DataFrame) -> DataFrame:
    """``id, comp`` of the classes in bands that hold members of more than one component."""
    rows = shared.join(grouped, F.col("rep") == F.col("node"), "left").select("key", "rep", F.coalesce("component", "rep").alias("comp"))
    open_ = rows.groupBy("key").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).where("a < b").select("key")
    return cut(rows.join(open_, "key", "left_semi").select(F.col("rep").alias("id"), "comp").distinct())


def _rest(left: DataFrame, docs: DataFrame, shingle: int, near) -> DataFrame:
    """Candidates ``(c, id)`` of different components among ``left(id, comp)``, by prefix filtering; exact.

    Of two sets at 0.8 or more, each has at least ceil(0.8 n) of its n shingles in common with the other; so if all
    shingles are put in one order, the first n - ceil(0.8 n) + 1 of both have one in common. The order is rarest
    first, so a passage that thousands of documents share makes no candidates of those that have a fifth of other
    text. Shingles met once come first and match nothing: they are counted, not carried. The work grows with the
    shingles of ``left``; no pair is made before a rare shingle shows it.
    """
    words = cut(sets_of(docs, left.select("id"), shingle).mapInArrow(_exploded, "id long, doc long, n int, h long"))
    often = words.groupBy("h").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    first = words.join(often, "h").groupBy("id", "doc", "n").agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("common"))
    room = (F.col("n") - F.expr(f"({PERCENT} * CAST(n AS BIGINT) + 99) DIV 100") + 1 - (F.col("n") - F.size("common"))).cast("int")
    first = first.withColumn("room", room).where("room > 0")
    first = first.select("id", "n", F.explode(F.slice("common", 1, F.col("room"))).alias("w")).select("id", "n", "w.h")
    first = cut(first.distinct().join(left, "id"))
    other = first.select("h", F.col("id").alias("r"), F.col("n").alias("m"), F.col("comp").alias("d"))
    pairs = first.join(other, "h").where((F.col("id") < F.col("r")) & (F.col("comp") != F.col("d")) & near(F.col("n"), F.col("m")))
    return pairs.select(F.col("id").alias("c"), F.col("r").alias("id")).distinct()


def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, digest, raw in zip(*(batch.column(x).to_pylist() for x in ("id", "digest", "set"))):
            h = np.frombuffer(raw, np.int64)
            fixed = [np.full(len(h), i), np.full(len(h), int.from_bytes(digest[:8], "little", signed=True)), np.full(len(h), len(h), np.int32)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, fixed), pa.array(h)], ["id", "doc", "n", "h"])


def one_of_each(docs: DataFrame, shingle: int = STAGE_SHINGLE) -> DataFrame:
    """The rows of ``docs``, all columns, without those of which a near-duplicate with a smaller id is there."""
    gone = cut(near_duplicates(docs, shingle).where("not kept").select(F.col("doc_id").alias("gone")).distinct())
    whole = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["doc_id"].alias("id"))
    return join_sized(whole, gone, F.col("id") == F.col("gone"), "left_anti").select("row.*")


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
