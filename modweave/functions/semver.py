"""Version ranges in the npm manner, as an Arrow-batched predicate."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_VERSION = re.compile(r"^[v=\s]*(\d+)(?:\.(\d+|[xX*]))?(?:\.(\d+|[xX*]))?(?:-([0-9A-Za-z.-]+))?(?:\+[0-9A-Za-z.-]+)?$")


def parse(text: str) -> tuple[list[int | None], tuple] | None:
    m = _VERSION.match(text.strip())
    if not m:
        return None
    parts = [None if p is None or p in "xX*" else int(p) for p in m.groups()[:3]]
    pre = tuple((0, int(x), "") if x.isdigit() else (1, 0, x) for x in (m[4] or "").split(".") if x)
    return parts, pre


def _key(parts: list[int | None], pre: tuple) -> tuple:
    return (*[p or 0 for p in parts], 0 if pre else 1, pre)


def _up(parts: list[int | None], at: int) -> tuple:
    fixed = [p or 0 for p in parts]
    return (*fixed[:at], fixed[at] + 1, *[0] * (2 - at), 0, ())


def _bounds(token: str) -> tuple[tuple | None, tuple | None, bool, bool] | None:
    """(low, high, low open, high open) of one comparator."""
    m = re.match(r"^(\^|~>?|>=|<=|>|<|=)?\s*(.*)$", token)
    op, rest = m[1] or "", m[2]
    if rest in ("", "*", "x", "X"):
        return None, None, False, False
    got = parse(rest)
    if got is None or got[0][0] is None:
        return (None, None, False, False) if got else ("bad", None, False, False)
    parts, pre = got
    low = _key(parts, pre)
    known = next((i for i, p in enumerate(parts) if p is None), 3)
    if op == "^":
        at = next((i for i in range(min(known, 3)) if parts[i]), min(known, 3) - 1)
        return low, _up(parts, at), False, True
    if op.startswith("~"):
        return low, _up(parts, min(known - 1, 1)), False, True
    if op == ">":
        return (low, None, True, False) if known == 3 else (_up(parts, known - 1), None, False, False)
    if op == ">=":
        return low, None, False, False
    if op == "<":
        return None, low, False, True
    if op == "<=":
        return (None, low, False, False) if known == 3 else (None, _up(parts, known - 1), False, True)
    return (low, low, False, False) if known == 3 else (low, _up(parts, known - 1), False, True)


def fits(version: str | None, wanted: str | None) -> bool:
    """Whether a version is in a range; '' and * take any, what can't be read takes none."""
    wanted = (wanted or "").strip()
    if wanted in ("", "*"):
        return True
    got = parse(version or "")
    if got is None or None in got[0]:
        return False
    v = _key(*got)
    for part in wanted.split("||"):
        part = part.strip()
        if h := re.match(r"^(\S+)\s+-\s+(\S+)$", part):
            part = f">={h[1]} <={h[2]}"
        part = re.sub(r"(\^|~>?|>=|<=|>|<|=)\s+", r"\1", part)
        ok, same_pre = True, not got[1]
        for token in re.split(r"[\s,]+", part) if part else ["*"]:
            low, high, open_low, open_high = _bounds(token)
            if low == "bad":
                return False
            if low is not None and (v < low or open_low and v == low) or high is not None and (v > high or open_high and v == high):
                ok = False
            for edge in (low, high):
                same_pre = same_pre or edge is not None and edge[3] == 0 and edge[:3] == v[:3] and bool(edge[4])
        if ok and same_pre:
            return True
    return False


@F.pandas_udf(T.BooleanType())
def satisfies(version: pd.Series, wanted: pd.Series) -> pd.Series:
    known: dict[tuple, bool] = {}
    return pd.Series([known[k] if k in known else known.setdefault(k, fits(*k)) for k in zip(version, wanted)])
