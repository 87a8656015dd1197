"""Package manifests, TypeScript settings, workspaces and installed packages, read on the driver."""

from __future__ import annotations

import json
import os
import posixpath
import re
from dataclasses import dataclass, field

from modweave.functions.globs import compile_globs, glob_regex, matches

_JSONC = re.compile(r'"(?:\\.|[^"\\])*"|//[^\n]*|/\*.*?\*/|,(?=(?:\s|//[^\n]*|/\*.*?\*/)*[}\]])', re.S)


def parse_jsonc(text: str):
    """JSON with comments and trailing commas."""
    return json.loads(_JSONC.sub(lambda m: m[0] if m[0][0] == '"' else ("" if m[0] == "," else " "), text.lstrip("\ufeff")))


def read_json(path: str):
    try:
        with open(path, encoding="utf-8") as f:
            return parse_jsonc(f.read())
    except (OSError, ValueError):
        return None


@dataclass
class Package:
    root: str
    name: str = ""
    version: str = ""
    deps: dict[str, str] = field(default_factory=dict)
    dev_deps: dict[str, str] = field(default_factory=dict)
    exports: object = None
    imports: dict = field(default_factory=dict)
    main: str = ""
    module: str = ""
    raw: dict = field(default_factory=dict)

    @property
    def declared(self) -> set[str]:
        return {*self.deps, *self.dev_deps}


def _strings(x) -> dict[str, str]:
    return {str(k): v if isinstance(v, str) else "" for k, v in x.items()} if isinstance(x, dict) else {}


def read_package(root: str) -> Package | None:
    raw = read_json(os.path.join(root, "package.json"))
    if not isinstance(raw, dict):
        return None
    text = lambda k: raw[k] if isinstance(raw.get(k), str) else ""
    return Package(root.rstrip("/"), text("name"), text("version"), _strings(raw.get("dependencies")), _strings(raw.get("devDependencies")), raw.get("exports"), raw.get("imports") if isinstance(raw.get("imports"), dict) else {}, text("main"), text("module"), raw)


_TOKEN = re.compile(r'"(?:\\.|[^"\\])*"|//[^\n]*|/\*.*?\*/|[{}\[\]:,]', re.S)


def dependency_place(text: str, name: str, fields: tuple[str, ...] = ("dependencies", "devDependencies")) -> tuple[int, int] | None:
    """Where a manifest's text has a dependency's key, without its quotes, in characters; the first field that has it.

    Tokens are read with a stack of open objects, so the same name elsewhere (in scripts, say) isn't taken.
    """
    found: dict[str, tuple[int, int]] = {}
    stack: list[str] = []
    last, key = None, ""
    for m in _TOKEN.finditer(text):
        t = m[0]
        if t[0] == "/":
            continue
        if t[0] == '"':
            last = m
        elif t == ":" and last is not None:
            key = json.loads(last[0])
            if len(stack) == 2 and stack[1] in fields and key == name:
                found.setdefault(stack[1], (last.start() + 1, last.end() - 1))
        elif t in "{[":
            stack.append(key)
            key = ""
        elif t in "}]" and stack:
            stack.pop()
    return next((found[f] for f in fields if f in found), None)


# --- tsconfig ------------------------------------------------------------------------------------------------------


@dataclass
class TsConfig:
    aliases: dict[str, str] = field(default_factory=dict)
    suffixes: list[str] = field(default_factory=list)
    types: list[str] = field(default_factory=list)


def _extended(base: str, name: str) -> str | None:
    if name.startswith((".", "/")):
        path = posixpath.normpath(posixpath.join(base, name))
        tries = [path, path + ".json", path + "/tsconfig.json"]
    else:
        tries, at = [], base
        while True:
            inside = posixpath.join(at, "node_modules", name)
            tries += [inside, inside + ".json", inside + "/tsconfig.json"]
            if posixpath.dirname(at) == at:
                break
            at = posixpath.dirname(at)
    return next((t for t in tries if os.path.isfile(t)), None)


def merged_tsconfig(path: str, seen: frozenset[str] = frozenset()) -> dict:
    """Compiler options with those of the extended file below them: paths key by key, types child first; absolute targets."""
    raw = read_json(path)
    if not isinstance(raw, dict) or path in seen:
        return {}
    base = posixpath.dirname(path)
    own = raw.get("compilerOptions") if isinstance(raw.get("compilerOptions"), dict) else {}
    out = dict(own)
    url = own.get("baseUrl")
    if isinstance(url, str):
        out["baseUrl"] = posixpath.normpath(posixpath.join(base, url))
    if isinstance(own.get("paths"), dict):
        at = out.get("baseUrl") if isinstance(url, str) else base
        out["paths"] = {k: [_absolute(at, t) for t in v] if isinstance(v, list) else [] for k, v in own["paths"].items()}
    if isinstance(raw.get("extends"), str) and (parent := _extended(base, raw["extends"])):
        below = merged_tsconfig(parent, seen | {path})
        paths = {**below.get("paths", {}), **out.get("paths", {})}
        types = list(dict.fromkeys([*(own.get("types") or []), *(below.get("types") or [])]))
        out = {**below, **out}
        if paths:
            out["paths"] = paths
        if types:
            out["types"] = types
    return out


def _absolute(base: str, target: object) -> str:
    """'' for targets outside of the sources: absolute ones, addresses, packages."""
    if not isinstance(target, str) or target.startswith(("/", "node_modules/", "@")) or "://" in target:
        return ""
    return posixpath.normpath(posixpath.join(base, target))


def read_tsconfig(path: str) -> TsConfig:
    options = merged_tsconfig(path)
    aliases = {k: v[0] for k, v in options.get("paths", {}).items() if v and v[0]}
    if isinstance(options.get("baseUrl"), str):
        aliases.setdefault("*", options["baseUrl"] + "/*")
    strings = lambda x: [s for s in x if isinstance(s, str)] if isinstance(x, list) else []
    return TsConfig(aliases, strings(options.get("moduleSuffixes")), strings(options.get("types")))


# --- workspaces ----------------------------------------------------------------------------------------------------


def workspace_patterns(root: str) -> list[str] | None:
    """The package patterns of a workspace root; None if it is none."""
    for name in ("pnpm-workspace.yaml", "pnpm-workspace.yml"):
        path = os.path.join(root, name)
        if os.path.isfile(path):
            with open(path, encoding="utf-8") as f:
                return _yaml_packages(f.read())
    raw = read_json(os.path.join(root, "package.json"))
    spaces = raw.get("workspaces") if isinstance(raw, dict) else None
    spaces = spaces.get("packages") if isinstance(spaces, dict) else spaces
    return [s for s in spaces if isinstance(s, str)] if isinstance(spaces, list) else None


def _yaml_packages(text: str) -> list[str]:
    out, on = [], False
    for line in text.splitlines():
        bare = re.sub(r"\s+#.*$", "", line).rstrip()
        if not bare.strip() or bare.lstrip().startswith("#"):
            continue
        if re.match(r"packages\s*:", bare):
            on = True
            if m := re.search(r"\[(.*)\]", bare):
                return [x.strip().strip("'\"") for x in m[1].split(",") if x.strip()]
        elif on and (m := re.match(r"\s*-\s*(.+)$", bare)):
            out.append(m[1].strip().strip("'\""))
        elif not bare.startswith((" ", "-")):
            on = False
    return out


def workspace_root(start: str) -> str | None:
    at = start.rstrip("/") or "/"
    while True:
        if workspace_patterns(at) is not None:
            return at
        if os.path.dirname(at) == at:
            return None
        at = os.path.dirname(at)


def package_dirs(root: str, skip: tuple[str, ...] = ("node_modules", ".git")) -> list[str]:
    """Directories with a manifest below ``root``, which is not one of them."""
    out = []
    for at, dirs, names in os.walk(root):
        dirs[:] = sorted(d for d in dirs if d not in skip)
        if "package.json" in names and at != root:
            out.append(at)
    return out


def workspace_packages(root: str, exclude: list[str] | None = None, include: list[str] | None = None, explicit: list[str] | None = None) -> list[Package]:
    """Named packages that the workspace patterns match (``*`` stays within a directory), and explicit ones."""
    patterns = workspace_patterns(root) or []
    clean = lambda p: re.sub(r"^\./", "", p).rstrip("/")
    wanted = [re.compile(_workspace_regex(clean(p))) for p in patterns if not p.startswith("!")]
    against = [re.compile(_workspace_regex(clean(p[1:]))) for p in patterns if p.startswith("!")]
    out, hidden, shown = [], compile_globs(exclude, root), compile_globs(include, root)
    for d in package_dirs(root):
        rel = os.path.relpath(d, root)
        if not any(r.fullmatch(rel) for r in wanted) or any(r.fullmatch(rel) for r in against):
            continue
        if matches(d + "/package.json", hidden) and not matches(d + "/package.json", shown):
            continue
        if (p := read_package(d)) and p.name:
            out.append(p)
    known = {p.root for p in out}
    for d in explicit or []:
        full = posixpath.normpath(posixpath.join(root, d))
        if full not in known and full != root.rstrip("/") and (p := read_package(full)) and p.name:
            out.append(p)
    return sorted(out, key=lambda p: p.root)


def _workspace_regex(pattern: str) -> str:
    return glob_regex(pattern, "/").replace("/.*", "/.*") if pattern != "**" else ".*"


def standalone_packages(root: str, exclude: list[str] | None = None) -> list[str]:
    """Package directories that no workspace has."""
    mine = {p.root for p in workspace_packages(root)}
    hidden = compile_globs(exclude, root)
    return [d for d in package_dirs(root) if d not in mine and not matches(d + "/package.json", hidden)]


# --- installed packages --------------------------------------------------------------------------------------------


def node_modules_dirs(root: str) -> list[str]:
    """Top-level ``node_modules`` directories, not those inside others."""
    out = []
    for at, dirs, _ in os.walk(root):
        if "node_modules" in dirs:
            out.append(os.path.join(at, "node_modules"))
        dirs[:] = sorted(d for d in dirs if d not in ("node_modules", ".git"))
    return sorted(out)


def installed_packages(root: str) -> list[dict]:
    """``name, version, path, size, leaf, top``: packages one or two levels below any ``node_modules``, links passed over."""
    out = []
    for top in node_modules_dirs(root):
        for at, dirs, names in os.walk(top):
            dirs.sort()
            parts = at.split("/node_modules/")[-1].split("/")
            if "package.json" in names and len(parts) == (2 if parts[0].startswith("@") else 1) and not os.path.islink(at):
                p = read_package(at)
                if p and p.name and p.version:
                    size, leaf = _size(at)
                    out.append({"name": p.name, "version": p.version, "path": at, "size": size, "leaf": leaf, "top": top})
    return sorted(out, key=lambda r: r["path"])


def _size(root: str) -> tuple[int, bool]:
    total, leaf = 0, True
    for at, dirs, names in os.walk(root):
        leaf = leaf and "node_modules" not in dirs
        dirs[:] = [d for d in dirs if d != "node_modules"]
        total += sum(os.lstat(os.path.join(at, n)).st_size for n in names if not os.path.islink(os.path.join(at, n)))
    return total, leaf


def binaries(package: dict) -> list[str]:
    """The names of a manifest's ``bin`` field: the package's own name for a string, its keys for an object."""
    found = package.get("bin")
    if isinstance(found, str):
        return [str(package.get("name", ""))] if found else []
    return sorted(found) if isinstance(found, dict) else []


def dir_bytes(root: str) -> int:
    """Bytes of all files below a directory, links left out."""
    return sum(os.lstat(p).st_size for at, _, names in os.walk(root) for n in names if not os.path.islink(p := os.path.join(at, n)))


# --- rules ---------------------------------------------------------------------------------------------------------


def pick_condition(target: object, conditions: list[str]) -> str:
    """The path of a conditional target: the first configured name it has, else ``default``; '' if none or blocked."""
    if isinstance(target, list):
        return next((p for t in target if (p := pick_condition(t, conditions))), "")
    while isinstance(target, dict):
        target = next((target[name] for name in [*conditions, "default"] if name in target), "")
    return target if isinstance(target, str) else ""


def match_keys(table: dict, request: str) -> tuple[object, str] | None:
    """The entry of an exact key, or of the longest wildcard key that fits, with what its star stands for."""
    if request in table and "*" not in request:
        return table[request], ""
    for key in sorted((k for k in table if "*" in k), key=lambda k: (-len(k), k)):
        head, tail = key.split("*", 1)
        if request.startswith(head) and request.endswith(tail) and len(request) >= len(head) + len(tail):
            return table[key], request[len(head) : len(request) - len(tail)]
    return None


def fill(target: str, star: str) -> str:
    if "*" not in target:
        return target
    head, tail = target.split("*", 1)
    return head + (star[: -len(tail)] if tail and star.endswith(tail) else star) + tail


class Rules:
    """What a request may stand for, by the settings of the package it is in. Small, and sent to the tasks whole."""

    def __init__(self, root: str, packages: list[Package], conditions: list[str] | None = None, follow: list[str] | None = None):
        self.root = root.rstrip("/")
        self.conditions = conditions or []
        top = read_package(self.root) or Package(self.root)
        self.packages = {p.root: p for p in [top, *packages]}
        self.by_name = {p.name: p for p in packages}
        self.follow = None if follow is None else set(follow)
        self.settings = {r: read_tsconfig(os.path.join(r, "tsconfig.json")) for r in self.packages}

    def owner(self, path: str) -> Package:
        at = posixpath.dirname(path)
        while at and at != "/":
            if at in self.packages:
                return self.packages[at]
            at = posixpath.dirname(at)
        return self.packages[self.root]

    def candidates(self, src: str, request: str) -> list[tuple[str, str]]:
        """``(kind, path without certain extension)`` in the order in which they are tried."""
        request = request.split("?", 1)[0]
        if re.match(r"^\.\.?(/|$)", request):
            return [("user", posixpath.normpath(posixpath.join(posixpath.dirname(src), request)))]
        mine = self.owner(src)
        if request.startswith("#") and (hit := match_keys(mine.imports, request)):
            target = fill(pick_condition(hit[0], self.conditions), hit[1])
            if target.startswith("."):
                return [("user", posixpath.normpath(posixpath.join(mine.root, target)))]
            return (self.workspace(mine, target) or [("node", target)]) if target else []
        if found := self.workspace(mine, request):
            return found
        if hit := match_keys(self.settings[mine.root].aliases, request):
            target = fill(hit[0], hit[1])
            rel = posixpath.relpath(target, mine.root)
            return [("user", target), *self.workspace(mine, rel)]
        return []

    def workspace(self, mine: Package, request: str) -> list[tuple[str, str]]:
        parts = request.split("/")
        name = "/".join(parts[: 2 if request.startswith("@") else 1])
        p = self.by_name.get(name)
        if p is None or self.follow is not None and name not in self.follow:
            return []
        if not (p is mine or mine.root == self.root or name in mine.declared):
            return []
        sub = "." + request[len(name) :]
        if p.exports is not None:
            table = p.exports
            if not (isinstance(table, dict) and any(k.startswith(".") for k in table)):
                table = {".": table}
            hit = match_keys(table, sub)
            target = fill(pick_condition(hit[0], self.conditions), hit[1]) if hit else ""
            return [("monorepo", posixpath.normpath(posixpath.join(p.root, target)))] if target else []
        if sub != ".":
            return [("monorepo", posixpath.normpath(posixpath.join(p.root, sub)))]
        return [("monorepo", posixpath.normpath(posixpath.join(p.root, x))) for x in (p.module, p.main, "index") if x]

    def suffixes(self, src: str) -> list[str]:
        return self.settings[self.owner(src).root].suffixes

    def resolved_elsewhere(self, src: str, request: str) -> bool:
        return request.split("/")[0] in self.by_name or "/".join(request.split("/")[:2]) in self.by_name
