"""Related-document packing: a nearest-neighbour graph, greedy low-degree-first paths, windows filled along them."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from modweave.llm import mixing
from modweave.llm.common import cut, table
from modweave.llm.tokens import VOCABULARY, encoder

#: Tokens in a sequence, the id that ends a document, and the places (in tokens) at which a document may be cut.
WINDOW, END, GRAIN = 2048, 1, 32
#: Minima in a document's sketch, nearest neighbours that count, and minima a link must have in common.
SKETCH, NEIGHBOURS, COMMON = 16, 4, 3
#: Rows in a block of the search, words of 64 rows in a part of it, such parts counted at a time, and rows in a chunk
#: that is shuffled; rows that bound each other's search, and rows in a block of the walk.
BLOCK, WORDS, AT_ONCE, CHUNK, FEW, WALK = 4096, 8, 2048, 64, 512, 1 << 16
#: Rows on which the order of the search is fitted, and minima that are known to it. They bear on its speed alone.
SAMPLE, HOT = 8192, 4096
#: The most rows asked by one task of a search; all others pass by it.
MOST = 1 << 19
#: Rows as near as a row's last neighbour, among which a hash has chosen, after which only nearer ones replace it.
TIES = 1024
#: Slots of a mix whose documents are packed before those of later slots.
STRETCH = 64

_U = np.uint64
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def sketch(ids: np.ndarray) -> np.ndarray:
    """Least hash of the token pairs in each of ``SKETCH`` parts of the hash range (0: none)."""
    h = (ids[:-1].astype(_U) << _U(20)) + ids[1:]
    h = (h ^ (h >> _U(17))) * _U(0x9E3779B97F4A7C15)
    h = (h ^ (h >> _U(29))) * _U(0xBF58476D1CE4E5B9)
    low = np.full(SKETCH, 2**32 - 1, np.uint32)
    np.minimum.at(low, (h >> _U(60)).astype(np.intp), (h >> _U(20)).astype(np.uint32))
    return low.view(np.int32) + np.int32(1)


def _measured(vocabulary: str):
    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        rid = TaskContext.get().partitionId() << 40
        for batch in batches:
            n, crcs, sketches = [], [], []
            for text in batch.column("text").to_pylist():
                ids = np.array([*encode(text or ""), END], "<u4")
                raw, crc, step = memoryview(ids.tobytes()), 0, 4 * GRAIN
                marks = []
                for lo in range(0, len(raw), step):
                    crc = zlib.crc32(raw[lo : lo + step], crc)
                    marks.append(crc)
                n.append(len(ids))
                crcs.append(np.array(marks, "<u4").tobytes())
                sketches.append(sketch(ids))
            flat = pa.array(np.concatenate(sketches)) if sketches else pa.array([], pa.int32())
            carried = [c for c in batch.schema.names if c != "text"]
            rid += len(n)
            yield pa.RecordBatch.from_arrays([
                *map(batch.column, carried), pa.array(np.arange(rid - len(n), rid, dtype=np.int64)), pa.array(n, pa.int64()), pa.array(crcs, pa.binary()),
                pa.ListArray.from_arrays(np.arange(0, SKETCH * len(n) + 1, SKETCH, dtype=np.int32), flat),
            ], [*carried, "rid", "n", "crcs", "sketch"])

    return measured


@lru_cache(1)
def zero_steps() -> np.ndarray:
    """For each number of tokens up to ``WINDOW``, the images of the 32 bits of a CRC after so many zero tokens."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    out = np.empty((WINDOW + 1, 32), np.uint32)
    c = out[0] = np.uint32(1) << np.arange(32, dtype=np.uint32)
    for k in range(1, WINDOW + 1):
        for _ in range(4):
            c = (c >> 8) ^ t[c & 255]
        out[k] = c
    return out


def slice_crc(before: np.ndarray, through: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """The CRC of the last ``tokens`` tokens of a prefix, from the CRCs of the prefix and of what comes before them."""
    bits = (before[:, None] >> np.arange(32, dtype=np.uint32)) & 1
    return through ^ np.bitwise_xor.reduce(zero_steps()[tokens] * bits, axis=1)


_ROW = np.dtype([("rid", "<i8"), ("sketch", "<i4", SKETCH)])
_NEAR = "array<struct<common:int,b:long>>"


def _minima(rows: np.ndarray) -> np.ndarray:
    """One number for each minimum of each row, the same for the same minimum at the same place (-1: none)."""
    sketches = np.ascontiguousarray(rows["sketch"])
    out = (np.arange(SKETCH, dtype=np.int64) << 32) + sketches.view(np.uint32)
    out[sketches == 0] = -1
    return out


def bit_counts(rows: list[np.ndarray]) -> list[np.ndarray]:
    """How many of ``rows`` have each bit, as the binary digits of that count, the lowest first: bitwise full adders."""
    digits = []
    while rows:
        total, carries = rows[0], []
        for b, c in zip(rows[1::2], rows[2::2]):
            odd = total ^ b
            carry = total & b
            total = odd ^ c
            odd &= c
            carry |= odd
            carries.append(carry)
        if len(rows) % 2 == 0:
            carries.append(total & rows[-1])
            total = total ^ rows[-1]
        digits.append(total)
        rows = carries
    return digits


def at_least(digits: list[np.ndarray], k: int) -> np.ndarray:
    """The bits whose count is ``k`` (1 or more) or above."""
    out = None
    for i, digit in enumerate(digits):
        if k >> i & 1:
            out = digit if out is None else digit & out
        elif out is not None:
            out = digit | out
    return out


class Nearest:
    """The nearest of each of some rows among all rows that pass by (``meet``), exactly: no row is left out.

    A block's rows that have a minimum are one bit set for each minimum; the minima that a row has in common with
    each row of the block are counted by adding its 16 sets bitwise. ``least`` is what a row must have in common with
    one asked to become one of its ``NEIGHBOURS``; a part of a block in which fewer of the asked row's minima occur
    needs no counting. Between equally near rows a hash of both decides, so that rows alike don't all choose the
    same few; where ``TIES`` have been looked at, those chosen stay until nearer ones come.
    """

    def __init__(self, asked: np.ndarray):
        self.rid = asked["rid"].copy()
        self.minima, at = np.unique(_minima(asked), return_inverse=True)
        self.at = at.reshape(-1, SKETCH).astype(np.int32)
        self.score = np.zeros((len(asked), NEIGHBOURS), np.int64)  # minima in common, then 32 bits of the hash
        self.near = np.full((len(asked), NEIGHBOURS), -1, np.int64)
        self.least = np.full(len(asked), COMMON)
        self.ties = np.zeros(len(asked), np.int64)
        self.bounded = False

    def bound(self, asked: np.ndarray) -> None:
        """Sets ``least`` by what each row has in common with the nearest of a small block of those asked."""
        for lo in range(0, len(asked), FEW):
            own = Nearest(asked[lo : lo + FEW])
            own.meet(asked[lo : lo + FEW])
            self.least[lo : lo + FEW] = np.maximum(COMMON, own.score[:, -1] >> 32)
        self.bounded = True

    def meet(self, rows: np.ndarray) -> None:
        keys = _minima(rows).ravel()
        place = np.minimum(np.searchsorted(self.minima, keys), len(self.minima) - 1)
        known = np.flatnonzero((self.minima[place] == keys) & (keys >= 0))
        used, which = np.unique(place[known], return_inverse=True)
        parts, row = -(-len(rows) // (64 * WORDS)), known // SKETCH
        sets = np.zeros((len(used) + 1) * parts * WORDS, _U)  # the first is empty
        np.bitwise_or.at(sets, (which + 1) * parts * WORDS + row // 64, _U(1) << (row % 64).astype(_U))
        sets = sets.reshape(-1, WORDS)
        some = sets.any(axis=1).view(np.uint8).reshape(-1, parts)
        at = np.zeros(len(self.minima), np.int32)
        at[used] = np.arange(1, len(used) + 1)
        at = at[self.at]
        held = np.zeros((len(at), parts), np.uint8)
        for z in at.T:
            held += some.take(z, axis=0)
        x, part = np.divmod(np.flatnonzero(held >= self.least[:, None].astype(np.uint8)), parts)
        order = np.argsort(self.least[x].astype(np.int16), kind="stable")
        x, part = x[order], part[order]
        for lo in range(0, len(x), AT_ONCE):
            y, z = x[lo : lo + AT_ONCE], part[lo : lo + AT_ONCE]
            digits = bit_counts([sets.take(w, axis=0) for w in at[y].T * parts + z])
            self._take(y, z * WORDS, digits, rows["rid"])

    def _take(self, x: np.ndarray, word: np.ndarray, digits: list[np.ndarray], rids: np.ndarray) -> None:
        k = SKETCH
        while not self.bounded and k > self.least[x].min():  # where one part alone has enough at k, no row below k counts
            enough = x[np.bitwise_count(at_least(digits, k)).sum(axis=1) > NEIGHBOURS]
            self.least[enough] = np.maximum(self.least[enough], k)
            k -= 1
        bits = at_least(digits, int(self.least[x].min()))
        words = np.flatnonzero(bits)
        found = np.flatnonzero(np.unpackbits(bits.ravel()[words].astype("<u8").view(np.uint8), bitorder="little"))
        words, bit = words[found >> 6], found & 63
        q, w = np.divmod(words, WORDS)
        common = np.zeros(len(q), np.int64)
        for i, digit in enumerate(digits):
            common |= (digit.ravel()[words] >> bit.astype(_U) & _U(1)).astype(np.int64) << i
        b, q = rids[(word[q] + w) * 64 + bit], x[q]
        keep = (common >= self.least[q]) & (b != self.rid[q])
        q, b, common = q[keep], b[keep], common[keep]
        mixed = (np.minimum(b, self.rid[q]).astype(_U) * _U(0x9E3779B97F4A7C15)) ^ (np.maximum(b, self.rid[q]).astype(_U) * _U(0xC2B2AE3D27D4EB4F))
        score = common << 32 | ((mixed ^ (mixed >> _U(29))) * _U(0xBF58476D1CE4E5B9) >> _U(32)).astype(np.int64)
        last = self.score[q, -1]
        tied = q[common == last >> 32]
        np.add.at(self.ties, tied, 1)
        self.least[tied] += self.ties[tied] > TIES
        better = score > last
        if not better.any():
            return
        q, b, score = q[better], b[better], score[better]
        old = np.unique(q)
        last = self.score[old, -1] >> 32
        q = np.concatenate([np.repeat(old, NEIGHBOURS), q])
        score = np.concatenate([self.score[old].ravel(), score])
        b = np.concatenate([self.near[old].ravel(), b])
        order = np.lexsort((-score, q))  # best first
        q, b, score = q[order], b[order], score[order]
        best = np.searchsorted(q, old)[:, None] + np.arange(NEIGHBOURS)
        self.near[old], self.score[old] = b[best], score[best]
        now = self.score[old, -1] >> 32
        self.ties[old[now != last]] = 0
        self.least[old] = np.maximum(now, self.least[old])

    def found(self) -> Iterator[pa.RecordBatch]:
        has = np.flatnonzero(self.near[:, 0] >= 0)
        for lo in range(0, len(has), BLOCK):
            x = has[lo : lo + BLOCK]
            full = self.near[x] >= 0
            pairs = pa.StructArray.from_arrays([pa.array((self.score[x][full] >> 32).astype(np.int32)), pa.array(self.near[x][full])], ["common", "b"])
            ends = np.concatenate([[0], full.sum(axis=1).cumsum()]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(self.rid[x]), pa.ListArray.from_arrays(pa.array(ends), pairs)], ["rid", "near"])


def _hot(rows: np.ndarray) -> np.ndarray:
    """The ``HOT`` most frequent minima of some rows, from the most frequent on."""
    minima, n = np.unique(_minima(rows), return_counts=True)
    n[minima < 0] = 0
    return minima[np.argsort(-n, kind="stable")[:HOT]]


def _rows(batch: pa.RecordBatch) -> np.ndarray:
    rows = np.empty(batch.num_rows, _ROW)
    rows["rid"] = batch.column("rid").to_numpy()
    rows["sketch"] = batch.column("sketch").flatten().to_numpy().reshape(-1, SKETCH)
    return rows


def _keyed(hot: np.ndarray):
    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """``stretch, key, row``: the key brings rows together that share minima of ``hot``, then makes them distinct."""
        by = np.argsort(hot)
        for batch in batches:
            rows = _rows(batch)
            keys = np.full((len(rows), SKETCH), 2**16 - 1, ">u2")
            if len(hot):
                minima = _minima(rows)
                place = by[np.minimum(np.searchsorted(hot, minima, sorter=by), len(hot) - 1)]
                keys[:] = np.sort(np.where((hot[place] == minima) & (minima >= 0), place, 2**16 - 1), axis=1)
            whole = np.concatenate([keys.view(np.uint8), rows["rid"].astype(">i8").view(np.uint8).reshape(-1, 8)], axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("stretch"), pa.array([z.tobytes() for z in whole], pa.binary()), pa.array([z.tobytes() for z in rows], pa.binary())], ["stretch", "key", "row"])

    return keyed


def _chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by ``stretch, key`` in chunks of up to ``CHUNK`` of one stretch."""
    for batch in batches:
        if not batch.num_rows:
            continue
        stretch, keys, rows = batch.column("stretch").to_numpy(), batch.column("key"), batch.column("row").to_pylist()
        edges = [0, *(np.flatnonzero(np.diff(stretch)) + 1).tolist(), len(rows)]
        at = [(lo, min(lo + CHUNK, z)) for y, z in zip(edges, edges[1:]) for lo in range(y, z, CHUNK)]
        first = [lo for lo, _ in at]
        yield pa.RecordBatch.from_arrays([pa.array(stretch[first]), keys.take(pa.array(first)), pa.array([b"".join(rows[lo:hi]) for lo, hi in at], pa.binary())], ["stretch", "first", "chunk"])


def _searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks sorted by ``stretch, part, passes, first``: in each part, those asked, then all of the stretch in blocks."""
    key, search, held, rows = None, None, [], 0

    def joined() -> np.ndarray:
        return np.frombuffer(b"".join(held), _ROW)

    for batch in batches:
        for *at, passes, chunk in zip(*(batch.column(c).to_pylist() for c in ("stretch", "part", "passes", "chunk"))):
            if at != key:
                if search:
                    search.meet(joined())
                    yield from search.found()
                key, search, held, rows = at, None, [], 0
            if passes and not search:
                if not held:
                    continue  # nothing is asked in this part
                search = Nearest(joined())
                search.bound(joined())
                held, rows = [], 0
            if passes and rows + len(chunk) > BLOCK * _ROW.itemsize:
                search.meet(joined())
                held, rows = [], 0
            held.append(chunk)
            rows += len(chunk)
    if search:
        search.meet(joined())
        yield from search.found()


def neighbours(rows: DataFrame) -> DataFrame:
    """``rid, near``: the ``NEIGHBOURS`` nearest of each row of ``rows(rid, stretch, sketch)``, as ``(common, b)``, most alike first.

    Near are the rows of a stretch with most minima in common, ``COMMON`` at least; between equally near ones a hash
    decides. The search is exact: the rows are dealt out to tasks, and all rows of the stretch, 72 bytes
    each, pass by each task in blocks. There are no candidate groups, so no phrase that many share can make one
    too large, and none is cut. In an order by their most frequent minima, rows that share them are mostly in the same
    parts of blocks, and more parts need no counting. The work still grows with the pairs of a stretch; what is shuffled is the rows' sketches times the tasks, whose number follows the cores, not the rows (unless
    a task would be asked more than ``MOST``). Stretches are few: their counts are broadcast.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    counts = cut(rows.groupBy("stretch").agg(F.count(F.lit(1)).alias("n_")))
    n = counts.agg(F.sum("n_")).first()[0] or 0
    size = min(max(BLOCK, -(-n // (2 * cores))), MOST)
    counts = counts.select("stretch", F.ceil(F.col("n_") / size).cast("long").alias("parts"))
    tasks = min(counts.agg(F.sum("parts")).first()[0] or 1, 4 * cores)
    slim = rows.select("stretch", "rid", "sketch")
    sample = slim.sample(min(1.0, SAMPLE / max(n, 1)), 1).limit(2 * SAMPLE).toArrow().to_batches()
    hot = _hot(np.concatenate([np.empty(0, _ROW), *map(_rows, sample)]))
    keyed = slim.mapInArrow(_keyed(hot), "stretch long, key binary, row binary")
    chunks = keyed.repartitionByRange("stretch", "key").sortWithinPartitions("stretch", "key").mapInArrow(_chunked, "stretch long, first binary, chunk binary")
    asked = F.array(F.struct(F.pmod(F.xxhash64("first"), "parts").alias("part"), F.lit(0).alias("passes")))
    passing = F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda p: F.struct(p.alias("part"), F.lit(1).alias("passes")))
    dealt = chunks.join(F.broadcast(counts), "stretch").select("stretch", "first", "chunk", F.inline(F.concat(asked, passing)))
    dealt = dealt.repartitionById(tasks, F.pmod(F.col("stretch") + F.col("part"), F.lit(tasks)).cast("int"))
    return dealt.sortWithinPartitions("stretch", "part", "passes", "first").mapInArrow(_searched, f"rid long, near {_NEAR}")


def labels(near: DataFrame, rounds: int = 2) -> DataFrame:
    """``rid, label``: the least hash within ``rounds`` steps over links, so that neighbours mostly have one label."""
    ties = near.select("rid", F.explode("near.b").alias("b"))
    ties = cut(ties.union(ties.select("b", "rid")).distinct())
    out = ties.select("rid").distinct().select("rid", F.xxhash64("rid").alias("label"))
    for _ in range(rounds):
        offers = ties.join(out.select(F.col("rid").alias("b"), "label"), "b").groupBy("rid").agg(F.min("label").alias("offer"))
        out = out.join(offers, "rid").select("rid", F.least("label", "offer").alias("label"))
    return out


def walks(rids: list[int], near: list[list[tuple[int, int]]]) -> list[list[int]]:
    """All documents of a block in greedy walks over their nearest-neighbour graph.

    ``near``: ``(common, rid)`` of each one's neighbours; those outside the block don't count, and a link holds both
    ways. A walk begins at an unvisited document of least degree and goes on to the unvisited neighbour most alike
    (then of least degree) until there is none.
    """
    at = {r: i for i, r in enumerate(rids)}
    links: list[dict[int, int]] = [{} for _ in rids]
    for x, mine in enumerate(near):
        for common, rid in mine:
            if (y := at.get(rid)) is not None and y != x:
                links[x][y] = links[y][x] = -common
    degree = [len(z) for z in links]
    order = sorted(range(len(rids)), key=lambda x: (degree[x], x))
    seen, out = [False] * len(rids), []
    for x in order:
        walk = []
        while x is not None and not seen[x]:
            seen[x] = True
            walk.append(x)
            x = min(((c, degree[y], y) for y, c in links[x].items() if not seen[y]), default=(0, 0, None))[2]
        if walk:
            out.append(walk)
    return out


def paths(rids: list[int], near: list[list[tuple[int, int]]]) -> list[int]:
    """All documents of a block in one order: its ``walks`` one after the other."""
    return [x for walk in walks(rids, near) for x in walk]


def _walked(block: int):
    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by ``stretch, label, rid``: the walks of each block of up to ``block`` rows of a stretch."""

        def done(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            near = rows.column("near")
            pairs = list(zip(*(z.to_pylist() for z in near.flatten().flatten())))
            ends = near.value_lengths().fill_null(0).to_numpy().cumsum().tolist()
            rids = rows.column("rid").to_pylist()
            found = walks(rids, [pairs[lo:hi] for lo, hi in zip([0, *ends], ends)])
            size = np.array([len(w) for w in found])
            start = size.cumsum() - size
            order = np.concatenate(found)
            first, last = (np.repeat(order[z], size) for z in (start, start + size - 1))
            end = (order == first) | (order == last)
            rid, label = (rows.column(c).to_numpy() for c in ("rid", "label"))
            columns = [pa.array(z) for z in (rid[order], rows.column("stretch").to_numpy()[order], rid[first], rid[last], label[first], np.arange(len(order)) - np.repeat(start, size), end)]
            return pa.RecordBatch.from_arrays([*columns, near.take(pa.array(order, mask=~end))], ["rid", "stretch", "walk", "last", "label", "place", "end", "near"])

        held: list[pa.RecordBatch] = []
        rows, now = 0, None
        for batch in batches:
            stretch, at = batch.column("stretch").to_numpy(), 0
            while at < len(stretch):
                if rows and (rows == block or stretch[at] != now):
                    yield done(held)
                    held, rows = [], 0
                now = stretch[at]
                k = min(block - rows, int(stretch[at:].searchsorted(now, "right")))
                held.append(batch.slice(at, k))
                rows, at = rows + k, at + k
        if rows:
            yield done(held)

    return walked


def chains(links: pd.DataFrame) -> pd.DataFrame:
    """Walks joined end to end by ``links(common, a, walk_a, last_a, label_a, b, walk_b, last_b, label_b)`` between ends.

    Links are taken from the most alike on, wherever both ends are still free and the walks not yet in one chain, so
    none is left between free ends of two chains. For each walk in a chain: ``walk, chain`` (its first walk),
    ``chain_label, link`` (its place in the chain), ``flip`` (it is walked backwards).
    """
    columns = ["walk", "chain", "chain_label", "link", "flip"]
    lo, hi = links[["a", "b"]].min(axis=1), links[["a", "b"]].max(axis=1)
    links = links.assign(lo=lo, hi=hi).sort_values(["common", "lo", "hi"], ascending=[False, True, True]).drop_duplicates(["lo", "hi"])
    root: dict[int, int] = {}
    last: dict[int, int] = {}
    label: dict[int, int] = {}
    joined: dict[int, list[tuple[int, int, int]]] = {}  # (own end, the other's end, its walk)
    free: dict[int, int] = {}

    def top(w: int) -> int:
        while root[w] != w:
            root[w] = w = root[root[w]]
        return w

    for a, wa, za, la, b, wb, zb, lb in links[["a", "walk_a", "last_a", "label_a", "b", "walk_b", "last_b", "label_b"]].itertuples(index=False, name=None):
        for x, w, z, v in ((a, wa, za, la), (b, wb, zb, lb)):
            if w not in root:
                root[w], last[w], label[w], joined[w] = w, z, v, []
            free.setdefault(x, 2 if w == z else 1)  # a document alone is both ends
        if free[a] and free[b] and top(wa) != top(wb):
            free[a] -= 1
            free[b] -= 1
            root[top(wa)] = top(wb)
            joined[wa].append((a, b, wb))
            joined[wb].append((b, a, wa))
    out, seen = [], set()
    for start in sorted(w for w, z in joined.items() if len(z) == 1):
        if start in seen:
            continue
        own = joined[start][0][0]
        w, flip, k = start, own == start and last[start] != start, 0
        while w is not None:
            seen.add(w)
            out.append((w, start, label[start], k, flip))
            k += 1
            on = next(((mine, b, v) for mine, b, v in joined[w] if v not in seen), None)
            w = None
            if on:
                _, b, w = on
                flip = b != w
    return pd.DataFrame(out, columns=columns)


def ordered(rows: DataFrame, near: DataFrame, block: int = WALK) -> DataFrame:
    """``rid, stretch, label, chain, link, place`` of ``rows(rid, stretch)``: sorted by all but the first, related rows are neighbours.

    Walks are made in blocks of ``block`` rows of a stretch, ranged by a label that neighbours share (``labels``), so
    that nearly all links are met there. The links that remain between ends of two walks, of any blocks, then
    join the walks end to end (``chains``), in one task a stretch, which holds nothing else.
    """
    rows = rows.select("rid", "stretch").join(near, "rid", "left").join(labels(near), "rid", "left")
    rows = rows.withColumn("label", F.coalesce("label", F.xxhash64("rid")))
    by = ["stretch", "label", "rid"]
    schema = f"rid long, stretch long, walk long, last long, label long, place long, end boolean, near {_NEAR}"
    walked = cut(rows.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(_walked(block), schema))
    ends = walked.where("end")
    one = ends.select("stretch", F.col("rid").alias("a"), *(F.col(c).alias(f"{c}_a") for c in ("walk", "last", "label")), F.inline("near"))
    other = ends.select(F.col("rid").alias("b"), *(F.col(c).alias(f"{c}_b") for c in ("walk", "last", "label")))
    rest = one.join(other, "b").where("walk_a != walk_b")
    joined = rest.groupBy("stretch").applyInPandas(lambda df: chains(df), "walk long, chain long, chain_label long, link long, flip boolean")
    placed = walked.select("rid", "stretch", "label", "walk", "place").join(joined, "walk", "left")
    place = F.when(F.col("flip"), -F.col("place")).otherwise(F.col("place"))
    return placed.select("rid", "stretch", F.coalesce("chain_label", "label").alias("label"), F.coalesce("chain", "walk").alias("chain"), F.coalesce("link", F.lit(0).cast("long")).alias("link"), place.alias("place"))


class Filler:
    """Fills windows with documents in the order they come, cutting them at multiples of ``GRAIN``."""

    def __init__(self, first: int):
        self.sequence, self.used = first, 0

    def add(self, n: int) -> list[tuple[int, int, int, int]]:
        """``(start, length, sequence, offset)`` of the pieces of a document of ``n`` tokens."""
        out, at = [], 0
        while at < n:
            room = WINDOW - self.used
            take = n - at if n - at <= room else room // GRAIN * GRAIN
            if take:
                out.append((at, take, self.sequence, self.used))
                at, self.used = at + take, self.used + take
            if at < n or self.used == WINDOW:
                self.sequence, self.used = self.sequence + 1, 0
        return out


def _packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One sorted partition: its documents cut into windows as they come."""
    filler = Filler(TaskContext.get().partitionId() << 40)
    for df in batches:
        cols: list[list] = [[] for _ in range(8)]
        for doc, n, crcs in zip(df["doc_id"].tolist(), df["n"].tolist(), df["crcs"].tolist()):
            marks = np.frombuffer(crcs, "<u4")
            for start, length, sequence, offset in filler.add(n):
                values = (doc, start, length, n, sequence, offset, marks[start // GRAIN - 1] if start else 0, marks[-(-(start + length) // GRAIN) - 1])
                for c, value in zip(cols, values):
                    c.append(value)
        crc = slice_crc(np.array(cols[6], np.uint32), np.array(cols[7], np.uint32), np.array(cols[2], np.int64))
        names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset"]
        out = pd.DataFrame(dict(zip(names, cols[:6])))
        out["doc_id"] = pd.array([None if pd.isna(v) else int(v) for v in cols[0]], "Int64")
        out["ids_crc32"] = crc.astype(np.int64)
        yield out[["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]]


def pack(docs: DataFrame, vocabulary: str = VOCABULARY, mixed: bool = False) -> DataFrame:
    """The pieces of every row of ``docs(doc_id, text)`` in sequences of at most ``WINDOW`` tokens.

    Each text is tokenized once. What goes on is a row's length, a sketch of 16 numbers and the checksum of its
    ids up to each place where it may be cut, from which any piece's checksum follows; the ids themselves are
    never shuffled. Rows with one sketch (copies) stay together and are one row of the neighbour graph, so they push
    no other text out of it. The graph is exact and made over the whole table (``neighbours``); it is walked in
    blocks, and what links remain between ends of walks join them (``ordered``). A window is left open only at the
    end of a partition, and loses fewer than ``GRAIN`` tokens where a document is cut.

    ``mixed``: sequences, in the order of their ids, follow the mix of ``docs(doc_id, text, source)`` (the schedule
    of ``mixing.mix``, worked out again from what is not the text). Graph and paths are made inside stretches of
    ``STRETCH`` consecutive slots, so any prefix has the schedule's shares up to one stretch.

    Null text: the end id alone. Null ids and repeated rows are packed like others. An empty table gives an
    empty result. Extra columns are not read.
    """
    schedule = mixing.sized(docs) if mixed else []
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *schedule, F.col("text").cast("string").alias("text"))
    carried = "doc_id long, src string, size long, h long" if mixed else "doc_id long"
    rows = cut(slim.mapInArrow(_measured(vocabulary), f"{carried}, rid long, n long, crcs binary, sketch array<int>"))
    if mixed:
        row = F.struct("doc_id", "rid", "n", "crcs", "sketch").alias("row_")
        rows = mixing.scheduled(rows.select(row, "src", "size", "h")).select("row_.*", F.expr(f"slot div {STRETCH}").cast("long").alias("stretch"))
        rows = cut(rows)
    else:
        rows = rows.withColumn("stretch", F.lit(0).cast("long"))
    head = F.min("rid").over(Window.partitionBy("stretch", "sketch"))
    slim = cut(rows.select("rid", "stretch", "sketch", head.alias("head")))
    heads = slim.where("rid = head").select("rid", "stretch", "sketch")
    place = ordered(heads, cut(neighbours(heads))).withColumnRenamed("rid", "head")
    rows = rows.select("rid", "doc_id", "n", "crcs").join(slim.select("rid", "head").join(place, "head").drop("head"), "rid")
    by = ["label", "chain", "link", "place", "rid"]
    # a stretch is never split, and the ranges are numbered in the order of the slots
    spread = rows.repartitionByRange("stretch") if mixed else rows.repartitionByRange(*by)
    return spread.sortWithinPartitions("stretch", *by).select("doc_id", "n", "crcs").mapInPandas(_packed, PIECES)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
