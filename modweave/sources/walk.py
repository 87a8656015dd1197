"""Discovery of source files below a directory, and their contents."""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modweave.functions.globs import Matcher, compile_globs, dir_excluded, matches

EXTENSIONS = (".ts", ".tsx", ".mts", ".js", ".jsx", ".mjs", ".cjs", ".mjsx", ".vue", ".svelte")


@dataclass
class Found:
    files: list[str] = field(default_factory=list)
    excluded: list[str] = field(default_factory=list)
    pruned: list[str] = field(default_factory=list)


def tree_order(path: str) -> str:
    """A sort key under which a directory's files stand together: the slash comes before all else."""
    return path.replace("/", "\0")


def gitignore(text: str, root: str) -> list[Matcher]:
    """The patterns of an ignore file; lines that begin with # are comments."""
    return compile_globs([x for x in text.splitlines() if x.strip() and not x.startswith("#")], root)


def _read(path: str) -> str:
    try:
        with open(path, encoding="utf-8", errors="replace") as f:
            return f.read()
    except OSError:
        return ""


def ancestor_ignores(root: str) -> list[Matcher]:
    """Ignore files from ``root`` up to the repository's top; without a ``.git`` above, only those of ``root``."""
    chain, at = [], root.rstrip("/") or "/"
    while True:
        chain.append(at)
        if os.path.exists(os.path.join(at, ".git")):
            break
        up = os.path.dirname(at)
        if up == at:
            chain = chain[:1]
            break
        at = up
    return [m for d in chain for m in gitignore(_read(os.path.join(d, ".gitignore")), d)]


def walk(root: str, exclude: list[Matcher] | None = None, include: list[Matcher] | None = None, extensions: tuple[str, ...] = EXTENSIONS, ignores: bool = True) -> Found:
    """Source files in tree order, what was excluded, and directories not entered.

    A directory is entered unless all below it is sure to be excluded; with include patterns that is never so.
    Ignore files below ``root`` hold for their own subtrees.
    """
    out = Found()
    root = root.rstrip("/") or "/"
    base = [*(exclude or []), *(ancestor_ignores(root) if ignores else [])]

    def enter(directory: str, rules: list[Matcher]) -> None:
        if ignores and directory != root and os.path.exists(os.path.join(directory, ".gitignore")):
            rules = [*rules, *gitignore(_read(os.path.join(directory, ".gitignore")), directory)]
        try:
            entries = sorted(os.scandir(directory), key=lambda e: e.name)
        except OSError:
            return
        for e in entries:
            if e.is_dir(follow_symlinks=False):
                if e.name == ".git":
                    continue
                if not include and dir_excluded(e.path, rules, root):
                    out.pruned.append(e.path)
                    continue
                enter(e.path, rules)
            elif e.name.endswith(extensions):
                hidden = matches(e.path, rules) and not (include and matches(e.path, include))
                (out.excluded if hidden else out.files).append(e.path)

    enter(root, base)
    out.files.sort(key=tree_order)
    out.excluded.sort(key=tree_order)
    return out


def files_frame(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``path, ext, content, size``: contents are read by the tasks, from storage that all executors see.

    The file readers of Spark pass over names that begin with ``_`` or ``.``, so files are opened by name.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 64):
                rows = []
                for p in b.column("path").slice(lo, 64).to_pylist():
                    try:
                        with open(p, "rb") as f:
                            rows.append((p, f.read()))
                    except OSError:
                        continue
                if rows:
                    ps, cs = zip(*rows)
                    yield pa.RecordBatch.from_arrays([pa.array(ps), pa.array(["." + p.rsplit(".", 1)[-1] for p in ps]), pa.array(cs, pa.binary()), pa.array([len(c) for c in cs], pa.int64())], ["path", "ext", "content", "size"])

    listed = spark.createDataFrame([(p,) for p in paths], "path string") if paths else spark.createDataFrame([], "path string")
    parts = max(1, min(len(paths) // 200 + 1, spark.sparkContext.defaultParallelism * 4))
    return listed.repartition(parts, F.xxhash64("path")).mapInArrow(read, "path string, ext string, content binary, size long")


def discover(spark: SparkSession, root: str, exclude: list[str] | None = None, include: list[str] | None = None, with_exclusions: bool = False):
    """The ``files`` relation; with exclusions also the lists of excluded files and pruned directories."""
    found = walk(root, compile_globs(exclude, root), compile_globs(include, root) if include else None)
    frame = files_frame(spark, found.files)
    if not with_exclusions:
        return frame
    one = lambda xs: spark.createDataFrame([(x,) for x in xs], "path string")
    return frame, one(found.excluded), one(found.pruned)
