"""Source edits as rows: which of overlapping changes hold, what a file becomes, and fixes of unused exports.

Nothing is written; :func:`write_files` is the explicit step that does.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHANGES = "path string, start int, end int, text string"


def pick_changes(changes: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """The changes that hold: longer ones first, then earlier ones; what overlaps one already taken goes."""
    taken: list[tuple[int, int, str]] = []
    for c in sorted(changes, key=lambda c: (c[0] - c[1], c[0])):
        if not any(c[0] < p[1] and p[0] < c[1] for p in taken):
            taken.append(c)
    return sorted(taken, key=lambda c: c[0])


def apply_to(content: bytes, changes: list[tuple[int, int, str]]) -> bytes:
    out, at = [], 0
    for start, end, text in pick_changes(changes):
        if start < 0 or end < start or start > len(content):
            continue
        out += [content[at:start] if start > at else b"", text.encode()]
        at = end
    return b"".join([*out, content[at:]])


def apply_changes(files: DataFrame, changes: DataFrame) -> DataFrame:
    """``path, content, new_content`` of each file that has changes; one file's changes are one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new = [apply_to(c, [(x["start"], x["end"], x["text"]) for x in xs]) for c, xs in zip(b.column("content").to_pylist(), b.column("changes").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("path"), b.column("content"), pa.array(new, pa.binary())], ["path", "content", "new_content"])

    per = changes.groupBy("path").agg(F.collect_list(F.struct("start", "end", "text")).alias("changes"))
    rows = files.select("path", "content").join(per, "path").select("path", "content", "changes")
    return rows.mapInArrow(run, "path string, content binary, new_content binary")


def write_files(planned: DataFrame) -> DataFrame:
    """Writes planned contents, each by the task that holds it; returns the paths written when it is run."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b["path"], b["new_content"]):
                part = f"{path}.part"
                with open(part, "wb") as f:
                    f.write(content)
                os.replace(part, path)
            yield b[["path"]]

    return planned.select("path", "new_content").mapInPandas(run, "path string")


def whole_line(source: bytes, start: int, end: int) -> tuple[int, int]:
    """The span, or all of its lines with the line end if nothing else is on them."""
    a = source.rfind(b"\n", 0, start) + 1
    b = source.find(b"\n", end)
    b = len(source) if b < 0 else b
    if source[a:start].strip(b" \t") or source[end:b].strip(b" \t"):
        return start, end
    return a, min(b + 1, len(source))


@dataclass
class Export:
    """A statement that exports names: its kind, places and keywords (name, alias, start, end, comma after)."""

    local: bool
    places: tuple[int, int, int, int, int, int]
    keywords: list[tuple[str, str, int, int, int]]


def export_fix(source: bytes, e: Export, unused: set[str]) -> tuple[int, int, str] | None:
    """The change that takes the unused names out of an export statement, if one is safe.

    A declaration loses its ``export`` (a default one only before a name or declaration); a list with no used
    name goes as a whole, with its line if that is then empty; otherwise only its unused names go.
    """
    key, _, decl, brace, brace_end, stmt = e.places
    shown = [a or n for n, a, *_ in e.keywords]
    if e.local and not brace:
        if "default" in unused and not (source[decl : decl + 1].isalnum() or source[decl : decl + 1] == b"_"):
            return None
        return key, decl, ""
    if all(n in unused for n in shown) and stmt:
        return (*whole_line(source, key, stmt), "")
    if not brace:
        return None
    out, at, n = b"", brace, len(e.keywords)
    spans = []
    for i, (_, _, start, end, comma) in enumerate(e.keywords):
        if shown[i] not in unused:
            continue
        if comma and i < n - 1:
            span = (start, e.keywords[i + 1][2])
        elif comma:
            span = (start, comma + 1)
        else:
            span = (e.keywords[i - 1][3] if i else start, end)
        spans.append(whole_line(source, *span))
    for a, b in sorted(spans):
        a, b = max(a, brace), min(b, brace_end)
        out += source[at:a] if a > at else b""
        at = max(at, b)
    return brace, brace_end, (out + source[at:brace_end]).decode("utf-8", "replace")


def export_fixes(files: DataFrame, edges: DataFrame, unused: DataFrame) -> DataFrame:
    """The ``changes`` relation for ``unused(path, name)``; a file's statements and text meet in one group."""
    stmts = edges.where("export IS NOT NULL AND keywords IS NOT NULL").select(F.col("src").alias("path"), "is_local_export", "export", "keywords")
    names = unused.groupBy("path").agg(F.collect_set("name").alias("names"))
    rows = stmts.join(names, "path").groupBy("path").agg(F.first("names").alias("names"), F.collect_list(F.struct("is_local_export", "export", "keywords")).alias("stmts"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for path, content, wanted, statements in zip(b["path"], b["content"], b["names"], b["stmts"]):
                for s in statements:
                    e, ks = s["export"], s["keywords"]
                    places = tuple(int(e[c]) for c in ("key_start", "key_end", "decl_start", "brace_start", "brace_end", "stmt_end"))
                    kws = [(k["name"], k["alias"], int(k["start"]), int(k["end"]), int(k["comma_after"])) for k in ks]
                    mine = {a or n for n, a, *_ in kws} & set(wanted)
                    fix = export_fix(bytes(content), Export(bool(s["is_local_export"]), places, kws), mine) if mine else None
                    if fix:
                        out.append((path, *fix))
            yield pd.DataFrame(out, columns=["path", "start", "end", "text"])

    return files.select("path", "content").join(rows, "path").select("path", "content", "names", "stmts").mapInPandas(run, CHANGES)


def locations(issues: DataFrame, files: DataFrame) -> DataFrame:
    """``issues(path, start, end, ...)`` with 1-based lines and byte columns of both places."""
    content = F.decode(F.col("content"), "ISO-8859-1")  # a byte is a character
    head = lambda o: F.substr(content, F.lit(1), F.col(o))
    line = lambda o: (F.length(head(o)) - F.length(F.replace(head(o), F.lit("\n"), F.lit(""))) + 1).cast("int")
    col = lambda o: (F.length(F.substring_index(head(o), "\n", -1)) + 1).cast("int")
    out = issues.join(files.select("path", "content"), "path", "left")
    return out.withColumns({"start_line": line("start"), "start_col": col("start"), "end_line": line("end"), "end_col": col("end")}).drop("content")
