"""Token ids by public vocabularies, and edit-aware token counts over per-document segment trees."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from modweave.llm.common import table

#: The tokenizer file by name; a path may be given instead.
VOCABULARY = "byte_bpe_50k.json"
SPECIAL = "<|endoftext|>"


@lru_cache(4)
def encoder(vocabulary: str = VOCABULARY):
    """``text -> ids``, as ``tokenizers`` gives them without added special tokens.

    The rank file beside it holds the same vocabulary in a form that is encoded five times faster; only a text
    with the special token's own string goes through ``tokenizers``, which reads it as that token.
    """
    path = Path(vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary))
    lines = path.with_suffix(".tiktoken").read_bytes().split(b"\n")
    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x)}
    fast = tiktoken.Encoding(path.stem, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    whole = lru_cache(1)(lambda: Tokenizer.from_file(str(path)))
    return lambda text: whole().encode(text, add_special_tokens=False).ids if SPECIAL in text else fast(text)


#: Characters in a leaf, about.
LEAF = 512
_CUT = re.compile(r"(?<=\S) (?=\S)")


def leaves(text: str, size: int = LEAF) -> list[str]:
    """``text`` in pieces of about ``size`` characters, cut where every tokenizer of this family begins a pre-token.

    That is before a single space between two other characters, not inside the special token's string (which has
    no space). A stretch without such a place stays whole.
    """
    out, lo = [], 0
    while len(text) - lo > size:
        cut = _CUT.search(text, lo + size)
        if not cut:
            break
        out.append(text[lo : cut.start()])
        lo = cut.start()
    out.append(text[lo:])
    return out


class TokenTree:
    """A segment tree over a text's pre-token leaves; every node has the characters and tokens below it."""

    def __init__(self, text: str, encode):
        self.encode = encode
        self.leaf = leaves(text)
        self.n = 1 << (len(self.leaf) - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * self.n), [0] * (2 * self.n)
        self.encoded = 0  # characters that went through the tokenizer after the first build
        for i, s in enumerate(self.leaf):
            self.chars[self.n + i], self.tokens[self.n + i] = len(s), len(encode(s))
        for i in range(self.n - 1, 0, -1):
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    def _set(self, i: int, text: str, tokens: int) -> None:
        self.leaf[i] = text
        i += self.n
        dc, dt = len(text) - self.chars[i], tokens - self.tokens[i]
        while i:
            self.chars[i] += dc
            self.tokens[i] += dt
            i //= 2

    def replace(self, start: int, end: int, text: str) -> None:
        """Put ``text`` for the characters from ``start`` to ``end`` and re-encode the leaves touched, with their context.

        The leaves from the one that holds the character before the edit to the one that holds the character
        after it are joined, and more are taken in while an end of the joined text is no safe place to cut.
        """
        total = self.chars[1]
        start = min(max(start, 0), total)
        end = min(max(end, start), total)
        a = self._leaf_at(max(0, start - 1))
        b = self._leaf_at(min(max(total - 1, 0), end))
        first = self._before(a)
        old = "".join(self.leaf[a : b + 1])
        new = old[: start - first] + text + old[end - first :]
        while b + 1 < len(self.leaf) and not self._safe(new, self._next_text(b)):
            b += 1
            new += self.leaf[b]
        while a > 0 and not self._safe(self._last_text(a), new):
            a -= 1
            new = self.leaf[a] + new
        self.encoded += len(new)
        self._set(a, new, len(self.encode(new)))
        for i in range(a + 1, b + 1):
            if self.chars[self.n + i]:
                self._set(i, "", 0)

    @staticmethod
    def _safe(left: str, right: str) -> bool:
        if not right:
            return True
        return bool(left) and len(right) > 1 and right[0] == " " and not left[-1].isspace() and not right[1].isspace()

    def _next_text(self, b: int) -> str:
        got = ""
        for s in self.leaf[b + 1 :]:
            got += s
            if len(got) > 1:
                break
        return got

    def _last_text(self, a: int) -> str:
        for s in reversed(self.leaf[:a]):
            if s:
                return s
        return ""

    def _leaf_at(self, place: int) -> int:
        i = 1
        while i < self.n:
            i *= 2
            if place >= self.chars[i] and self.chars[i + 1]:
                place -= self.chars[i]
                i += 1
        return i - self.n

    def _before(self, leaf: int) -> int:
        i, got = leaf + self.n, 0
        while i > 1:
            if i & 1:
                got += self.chars[i - 1]
            i //= 2
        return got


def edited(text: str, edits: list[tuple[int, int, str]]) -> str:
    """The text after the edits, one after the other, each in places of the text it finds."""
    for start, end, new in edits:
        start = min(max(start, 0), len(text))
        end = min(max(end, start), len(text))
        text = text[:start] + new + text[end:]
    return text


def count_edited(docs: DataFrame, edits: Column, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id, n_chars, n_tokens, n_leaves, edited_chars, edited_tokens, reencoded_chars`` of each row of ``docs``.

    ``edits`` is an array of structs (start, end, text) in code points, applied in order. A tree is built once
    for each text; an edit re-encodes only the leaves it touches and the sums above them. Null text: the empty
    text; null edits: none; null parts of an edit: 0 and ''. Rows are worked on one by one, so repeated rows give
    repeated results, and one document's tree is in memory at a time. An empty table gives an empty result. Extra
    columns, of any name, are not read.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        for batch in batches:
            rows = []
            for doc_id, text, todo in zip(*(c.to_pylist() for c in batch.columns)):
                tree = TokenTree(text or "", encode)
                before = (tree.chars[1], tree.tokens[1], len(tree.leaf))
                for e in todo or []:
                    tree.replace(e["start"] or 0, e["end"] or 0, e["text"] or "")
                rows.append((doc_id, *before, tree.chars[1], tree.tokens[1], tree.encoded))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)] if rows else [pa.array([], pa.int64())] * 7, COUNTED)

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), edits.alias("edits"))
    return slim.mapInArrow(counted, ", ".join(f"{c} long" for c in COUNTED))


COUNTED = ["doc_id", "n_chars", "n_tokens", "n_leaves", "edited_chars", "edited_tokens", "reencoded_chars"]


def standard_edits(text: Column, doc_id: Column) -> Column:
    """Three edits of any text: its 60 characters from the middle go, its id is put in at a quarter, its first
    40 characters replace those from three quarters on."""
    n = F.length(text)
    edit = lambda a, b, t: F.struct(a.cast("int").alias("start"), b.cast("int").alias("end"), t.alias("text"))
    return F.array(
        edit(n / 2, n / 2 + 60, F.lit("")),
        edit(n / 4, n / 4, F.concat(F.lit(" #"), doc_id.cast("string"))),
        edit(n * 3 / 4, n * 3 / 4 + 40, F.left(text, F.lit(40))),
    )


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return count_edited(docs, standard_edits(F.coalesce("text", F.lit("")), F.coalesce("doc_id", F.lit(0))))
