"""Reports of a run: text, JSON and per-file lists. These collect what they print, within the limit on issues."""

from __future__ import annotations

import json
import os

from pyspark.sql import functions as F

from modweave.operators import edits
from modweave.plans.run import ORDER, Results

LIMIT = 5


def _rel(value, root: str):
    if isinstance(value, str):
        return os.path.relpath(value, root) if value.startswith(root + "/") else value
    if isinstance(value, list):
        return [_rel(v, root) for v in value]
    return value


def text(results: Results, limit: int | None = LIMIT) -> str:
    """Each check of each rule with its first issues and how many more there are."""
    root, out = results.graph.root, []
    for r in results.rules:
        out.append(f"{r.rule.path} ({r.files} files)")
        for name in sorted(r.checks, key=ORDER.index):
            df = r.checks[name]
            n = df.count()
            out.append(f"  {name}: {n or 'none'}")
            body = [c for c in df.columns if c not in ("start", "end", "seq")]
            shown = df.select(*body).orderBy(*body)
            for row in (shown.limit(limit) if limit else shown).collect():
                values = [_rel(v, root) for v in row]
                out.append("    " + "  ".join(" -> ".join(v) if isinstance(v, list) else str(v) for v in values if v not in ("", None)))
            if limit and n > limit:
                out.append(f"    ... and {n - limit} more")
    return "\n".join(out) + "\n"


VERSION = "1.2"
#: What the columns of each check are called in JSON; others keep out.
_PLACE = {"start_line": "startLine", "start_col": "startCol", "end_line": "endLine", "end_col": "endCol"}
_FIELDS = {
    "circularDependencies": {"cycle": "cycle"},
    "orphanFiles": {"path": "filePath"},
    "moduleBoundaries": {"rule": "ruleName", "path": "filePath", "import_path": "importPath", "violation": "violationType"},
    "unusedNodeModules": {"module": "moduleName", "path": "filePath"},
    "missingNodeModules": {"module": "moduleName", "paths": "importedFrom"},
    "importConventions": {"path": "filePath", "request": "importRequest", "violation": "violationType"},
    "unresolvedImports": {"path": "filePath", "request": "request"},
    "unusedExports": {"path": "filePath", "name": "exportName", "is_type": "isType"},
    "restrictedDevDependenciesUsage": {"dependency": "devDependency", "path": "filePath", "entry": "entryPoint"},
    "restrictedImports": {"type": "violationType", "importer": "importerFile", "entry": "entryPoint", "file": "deniedFile", "module": "deniedModule", "request": "importRequest"},
    "restrictedImporters": {"entry": "entryPoint", "file": "file", "module": "module"},
    "restrictedDirectImporters": {"type": "violationType", "importer": "importerFile", "file": "file", "module": "module", "request": "importRequest"},
}
#: Fields that are left out where they are empty.
_OPTIONAL = {"deniedFile", "deniedModule", "importRequest", "file", "module", *_PLACE.values()}


def _named(check: str, row: dict, root: str) -> dict:
    named = {new: _rel(row[old], root) for old, new in {**_FIELDS[check], **_PLACE}.items() if old in row}
    return {k: v for k, v in named.items() if v not in ("", None) or k not in _OPTIONAL or (k == "importRequest" and check == "importConventions")}


def to_json(results: Results) -> str:
    """All issues, with line and column where they have a place, and the summary of fixes."""
    root, rules, failed = results.graph.root, [], False
    for r in results.rules:
        checks = {}
        for name in sorted(r.checks, key=ORDER.index):
            df = r.checks[name]
            if "start" in df.columns:
                df = edits.locations(df, results.graph.files).drop("start", "end")
            rows = [_named(name, row.asDict(recursive=True), root) for row in df.orderBy(*df.columns).collect()]
            checks[name] = {"status": "fail" if rows else "pass", "issues": rows}
            failed = failed or bool(rows)
        rules.append({"path": r.rule.path, "fileCount": r.files, "checks": checks})
    per = results.changes.groupBy("path").count().agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("count"), F.lit(0)).alias("imports")).first()
    deleted = results.deletions.count()
    summary = {
        "fixedFilesCount": per["files"], "fixedImportsCount": per["imports"], "deletedFilesCount": deleted,
        "fixableIssuesCount": per["imports"] + deleted, "unfixableAliasingCount": results.unfixable(),
    }
    return json.dumps({"version": VERSION, "hasFailures": failed, "rules": rules, "fixSummary": summary}, indent=2)


def table(df, columns: dict[str, str], order: list[str]) -> str:
    """A relation as aligned columns under the given headings."""
    rows = [[str(x) for x in r] for r in df.select(*columns).orderBy(*order).collect()]
    heads = list(columns.values())
    lines = [heads, ["-" * len(h) for h in heads], *rows]
    wide = [max(len(x[i]) for x in lines) for i in range(len(heads))]
    return "".join("  ".join(c.ljust(w) for c, w in zip(line, wide)).rstrip() + "\n" for line in lines)


def grouped(df, key: str, values: str, root: str) -> str:
    """``key`` with an array of ``values`` below it."""
    rows = df.select(key, values).orderBy(key).collect()
    return "".join(f"\n {_rel(r[0], root)}\n" + "".join(f"    ➞ {_rel(v, root)}\n" for v in r[1]) + "\n" for r in rows)


def issues_list(results: Results) -> str:
    """Files with their issues below them."""
    root = results.graph.root
    rows = results.issues().where("path != ''").groupBy("path").agg(F.array_sort(F.collect_list(F.concat_ws(" ", "check", "issue"))).alias("found")).orderBy("path").collect()
    return "".join(f"{_rel(r.path, root)}\n" + "".join(f"  {x}\n" for x in r.found) for r in rows)


def tree(path: list[str], root: str) -> str:
    """A resolution path, one step deeper a line."""
    return "".join("  " * i + ("-> " if i else "") + _rel(p, root) + "\n" for i, p in enumerate(path))


def cycle(hops: list[tuple[str, str]], root: str) -> str:
    """A cycle with the request of each hop: ``(file, request)``."""
    return "".join(f"{_rel(f, root)} ({q})\n" for f, q in hops)
