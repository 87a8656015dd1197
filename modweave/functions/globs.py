"""Gitignore-like glob patterns as Spark predicates.

A pattern is translated once, on the driver, into a regular expression and plain string tests; what runs on the
data is ``rlike``, ``startswith``, ``contains`` and ``endswith``, all inside generated code.
"""

from __future__ import annotations

import posixpath
import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPECIAL = set(".^$+()|{}[]\\*?")


def _quote(c: str) -> str:
    return "\\" + c if c in _SPECIAL else c


def glob_regex(pattern: str, sep: str = "") -> str:
    """The regular expression of a glob. Without ``sep``, ``*`` and ``?`` also match slashes; with it only ``**`` does."""
    one = f"[^{sep}]" if sep else "."
    out, i, depth = [], 0, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            stars = 1
            while i + stars < len(pattern) and pattern[i + stars] == "*":
                stars += 1
            out.append(".*" if stars > 1 else one + "*")
            i += stars
            continue
        if c == "?":
            out.append(one)
        elif c == "\\" and i + 1 < len(pattern):
            i += 1
            out.append(_quote(pattern[i]))
        elif c == "[":
            end = pattern.find("]", i + 2)
            if end < 0:
                raise ValueError(f"unclosed [ in {pattern!r}")
            body = pattern[i + 1 : end]
            negated = body[:1] in ("!", "^")
            body = body[1:] if negated else body
            out.append("[" + "^" * negated + body.replace("\\", "\\\\").replace("[", "\\[").replace("^", "\\^").replace("&", "\\&") + "]")
            i = end
        elif c == "{":
            depth += 1
            out.append("(?:")
        elif c == "}" and depth:
            depth -= 1
            out.append(")")
        elif c == "," and depth:
            out.append("|")
        else:
            out.append(_quote(c))
        i += 1
    if depth:
        raise ValueError(f"unclosed {{ in {pattern!r}")
    return "".join(out)


@dataclass(frozen=True)
class Matcher:
    text: str
    root: str
    anchored: bool = False
    plain: bool = False
    negated: bool = False

    def strip(self, path: str) -> str:
        return path[len(self.root) :] if self.root and path.startswith(self.root) else path

    def test(self, path: str) -> bool:
        path = self.strip(path)
        if re.fullmatch(glob_regex(self.text), path, re.S):
            return True
        if not self.plain:
            return False
        if self.anchored:
            return path.startswith(self.text + "/")
        return path.endswith("/" + self.text) or f"/{self.text}/" in path or path.startswith(self.text + "/")

    def column(self, path: Column) -> Column:
        if self.root:
            path = F.when(path.startswith(self.root), F.substr(path, F.lit(len(self.root) + 1))).otherwise(path)
        hit = path.rlike(f"(?s)^(?:{glob_regex(self.text)})$")
        if not self.plain:
            return hit
        hit = hit | path.startswith(self.text + "/")
        return hit if self.anchored else hit | path.endswith("/" + self.text) | path.contains(f"/{self.text}/")


def _rebase(pattern: str, root: str) -> tuple[str, str] | None:
    if not (pattern in (".", "..") or pattern.startswith(("./", "../"))):
        return None
    slash = pattern.endswith("/")
    parts = posixpath.normpath(pattern).split("/")
    up = next((i for i, p in enumerate(parts) if p != ".."), len(parts))
    rest = "/".join(parts[up:]) or "."
    slash = slash or rest == "."
    base = root.rstrip("/")
    for _ in range(up):
        base = posixpath.dirname(base)
    base = base + "/" if base else ""
    if slash:
        rest = "**" if rest == "." else rest.rstrip("/") + "/"
    return base, rest


def compile_globs(patterns: list[str] | None, root: str = "") -> list[Matcher]:
    """Matchers of a pattern list. ``!`` negates, a leading ``/`` anchors at the root, ``./`` and ``../`` move it."""
    out = []
    root = root + "/" if root and not root.endswith("/") else root
    for pattern in patterns or []:
        pattern = pattern.strip()
        negated = pattern.startswith("!")
        if negated or pattern.startswith("\\!"):
            pattern = pattern[1:]
        if negated and not pattern:
            continue
        base, anchored = root, pattern.startswith("/")
        if anchored:
            pattern = pattern[1:]
        elif moved := _rebase(pattern, root):
            (base, pattern), anchored = moved, True
        plain = "/" not in pattern and "*" not in pattern
        if pattern.endswith("/") and "*" not in pattern:
            pattern = pattern + "**" if anchored else "**" + pattern + "**"
        out.append(Matcher(pattern, base, anchored, plain, negated))
        if pattern.startswith("**/"):
            out.append(Matcher(pattern[3:], base, anchored, False, negated))
    return out


def matches(path: str, matchers: list[Matcher]) -> bool:
    """Any positive pattern and no negated one, in whatever order they stand."""
    return any(m.test(path) for m in matchers if not m.negated) and not any(m.test(path) for m in matchers if m.negated)


def _any(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, cols) if cols else F.lit(False)


def glob_col(path: Column, patterns: list[str] | None, root: str = "") -> Column:
    """:func:`matches` as a column."""
    ms = compile_globs(patterns, root)
    hit = _any([m.column(path) for m in ms if not m.negated])
    against = [m.column(path) for m in ms if m.negated]
    return hit & ~_any(against) if against else hit


def excluded_col(path: Column, exclude: list[str] | None, include: list[str] | None = None, root: str = "") -> Column:
    """In the exclude set and not in the include set."""
    out = glob_col(path, exclude, root)
    return out & ~glob_col(path, include, root) if include else out


def value_glob_col(value: Column, patterns: list[str] | None) -> Column:
    """Raw globs on a value such as a module name: no roots, no negation."""
    return _any([value.rlike(f"(?s)^(?:{glob_regex(p.strip())})$") for p in patterns or [] if p.strip()])


def module_policy_col(name: Column, request: Column, patterns: list[str] | None) -> Column:
    """A module policy holds for the package name or for the whole request. Patterns that don't compile are skipped."""
    good = []
    for p in patterns or []:
        try:
            glob_regex(p.strip())
            good.append(p)
        except ValueError:
            continue
    return value_glob_col(name, good) | value_glob_col(request, good)


def module_filter_col(name: Column, include: list[str] | None = None, exclude: list[str] | None = None) -> Column:
    """Exclusion wins; without an include list everything is in."""
    kept = value_glob_col(name, include) if include else F.lit(True)
    return kept & ~value_glob_col(name, exclude) if exclude else kept


def ignore_col(path: Column, value: Column, pairs: dict[str, str | list[str]] | None = None, files: list[str] | None = None, values: list[str] | None = None, root: str = "") -> Column:
    """A finding is ignored by its value, by its file, or by a file pattern with value patterns of its own."""
    out = value_glob_col(value, values) | glob_col(path, files, root)
    for pattern, of in (pairs or {}).items():
        out = out | glob_col(path, [pattern], root) & value_glob_col(value, [of] if isinstance(of, str) else of)
    return out


def dir_excluded(path: str, matchers: list[Matcher], root: str) -> bool:
    """Whether everything below a directory is sure to be excluded, so that a walk needn't enter it."""
    if any(m.negated for m in matchers):
        return False
    for m in matchers:
        rel = m.strip(path if not m.root or path.startswith(m.root) else path)
        if m.text == "**":
            return path.startswith(m.root)
        if m.plain and (rel == m.text or not m.anchored and rel.endswith("/" + m.text)):
            return True
        if m.text.endswith("/**") and re.fullmatch(glob_regex(m.text[:-3]), rel, re.S):
            return True
    return False
