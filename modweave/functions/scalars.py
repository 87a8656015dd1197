"""Scalar functions on requests, paths and texts, as columns of built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SOURCE_EXTENSIONS = [".d.ts", ".ts", ".tsx", ".mts", ".js", ".jsx", ".mjs", ".cjs", ".vue", ".svelte"]
ASSET_EXTENSIONS = ["json", "png", "jpeg", "webp", "jpg", "svg", "gif", "ttf", "otf", "woff", "woff2", "css", "scss", "yml", "yaml"]
_CORE = (
    "assert assert/strict async_hooks buffer child_process cluster console constants crypto dgram diagnostics_channel dns dns/promises domain events fs fs/promises http http2 https inspector "
    "module net os path path/posix path/win32 perf_hooks process punycode querystring readline readline/promises repl stream stream/consumers stream/promises stream/web string_decoder "
    "sys timers timers/promises tls trace_events tty url util util/types v8 vm wasi worker_threads zlib"
).split()
BUILTINS = sorted({*_CORE, *(f"node:{x}" for x in _CORE), "node:test", "node:sqlite", "node:sea"})


def module_name(request: Column) -> Column:
    """The package of a request: its first segment, or two where it is scoped. A bare scope gets a slash."""
    scoped = F.when(F.instr(request, "/") > 0, F.substring_index(request, "/", 2)).otherwise(F.concat(request, F.lit("/")))
    return F.when(request.startswith("@"), scoped).otherwise(F.substring_index(request, "/", 1))


def valid_module(name: Column) -> Column:
    return (name != "") & ~name.startswith(".")


def is_builtin(request: Column) -> Column:
    return request.isin(BUILTINS)


def is_relative(request: Column) -> Column:
    return request.rlike(r"^\.\.?(/|$)")


def without_query(request: Column) -> Column:
    return F.substring_index(request, "?", 1)


def strip_extension(path: Column) -> Column:
    """Without ``/index`` and a source extension; of two that fit, the one further left."""
    return F.regexp_replace(path, r"^(.*?)(/index)?\.(?:d\.ts|[cm]?jsx?|[cm]?tsx?|vue|svelte)$", "$1")


def is_asset(path: Column, custom: list[str] | None = None) -> Column:
    ext = F.lower(F.substring_index(path, ".", -1))
    return (F.instr(path, ".") > 0) & ext.isin([*ASSET_EXTENSIONS, *(x.lstrip(".").lower() for x in custom or [])])


def loc(text: Column) -> Column:
    """Lines of code: newlines after each pair of newlines has become one, once."""
    once = F.replace(text, F.lit("\n\n"), F.lit("\n"))
    return (F.length(once) - F.length(F.replace(once, F.lit("\n"), F.lit("")))).cast("long")


def thousands(n: Column) -> Column:
    return F.replace(F.format_number(n, 0), F.lit(","), F.lit("_"))


def percent(part: Column, whole: Column) -> Column:
    return F.format_string("%.2f%%", F.when(whole == 0, F.lit(0.0)).otherwise(100.0 * part / whole))


def wildcard_fill(target: Column, value: Column) -> Column:
    """The target with its ``*`` replaced by what the key's star matched; a suffix already there isn't doubled."""
    head, tail = F.substring_index(target, "*", 1), F.substring_index(target, "*", -1)
    fits = (F.length(tail) > 0) & value.endswith(tail)
    cut = F.when(fits, F.substr(value, F.lit(1), F.length(value) - F.length(tail))).otherwise(value)
    return F.when(F.instr(target, "*") > 0, F.concat(head, cut, tail)).otherwise(target)


def compound_suffix(path: Column) -> Column:
    """``test.ts`` of ``a.test.ts``: the last two parts of a file name that has three or more."""
    name = F.substring_index(path, "/", -1)
    return F.when(F.size(F.split(name, r"\.")) >= 3, F.substring_index(name, ".", -2)).otherwise(F.lit(""))


_IGNORED_DIRS = ["node_modules", "dist", "build", "coverage", ".next", ".git", ".turbo", ".cache", "vendor"]
_DEV_DIRS = ["test", "tests", "__tests__", "__mocks__", "e2e", "cypress", "scripts", "stories", "storybook", ".storybook", "examples", "example", "benchmarks", "fixtures", "__fixtures__", "mocks", "playground", "tools"]
_DEV_NAME = r"(^|[./_-])(test|tests|spec|stories|story|mock|mocks|fixture|bench|e2e|config|setup|cy)\.[a-z.]+$"


def entry_class(relative: Column) -> Column:
    """``ignore``, ``dev`` or ``prod``, in this order of precedence; segments count in any case."""
    low = F.lower(relative)
    dirs = F.slice(F.split(low, "/"), 1, F.greatest(F.size(F.split(low, "/")) - 1, F.lit(0)))
    has = lambda names: F.arrays_overlap(dirs, F.array(*map(F.lit, names)))
    dev = low.endswith(".d.ts") | low.rlike(_DEV_NAME) | has(_DEV_DIRS)
    return F.when(has(_IGNORED_DIRS), F.lit("ignore")).when(dev, F.lit("dev")).otherwise(F.lit("prod"))


def restyle(path: Column, original: Column) -> Column:
    """A new request in the style of the old: without extension or ``/index`` unless that had them."""
    ends = lambda c, tail: c.rlike(tail + "$")
    ext = r"(\.d\.ts|\.tsx?|\.mts|\.jsx?|\.mjs|\.cjs|\.vue|\.svelte)"
    out = F.when(ends(original, ext), path).otherwise(F.regexp_replace(path, ext + "$", ""))
    return F.when(ends(original, f"/index{ext}?"), out).otherwise(F.regexp_replace(out, "/index$", ""))


def line_of(content: Column, offset: Column) -> Column:
    """The 1-based line of a 0-based offset."""
    head = F.substr(content, F.lit(1), offset)
    return (F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit(""))) + 1).cast("int")


def column_of(content: Column, offset: Column) -> Column:
    """The 1-based column of a 0-based offset."""
    return (F.length(F.substring_index(F.substr(content, F.lit(1), offset), "\n", -1)) + 1).cast("int")
