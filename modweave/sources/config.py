"""The check configuration: JSON with comments, validated, with the defaults of its rules filled in."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field

from modweave.functions.globs import compile_globs
from modweave.sources.manifests import _JSONC, _TOKEN, parse_jsonc

VERSIONS = [f"1.{i}" for i in range(13)]
#: Each check with the options it takes.
CHECKS = {
    "circularImportsDetection": {"ignoreTypeImports": bool, "algorithm": str},
    "orphanFilesDetection": {"validEntryPoints": list, "ignoreTypeImports": bool, "graphExclude": list, "autofix": bool},
    "unusedNodeModulesDetection": {"includeModules": list, "excludeModules": list, "pkgJsonFieldsWithBinaries": list, "filesWithBinaries": list, "filesWithModules": list, "outputType": str},
    "missingNodeModulesDetection": {"includeModules": list, "excludeModules": list, "outputType": str},
    "unusedExportsDetection": {"validEntryPoints": list, "ignoreTypeExports": bool, "graphExclude": list, "ignore": dict, "ignoreFiles": list, "ignoreExports": list, "autofix": bool},
    "unresolvedImportsDetection": {"ignore": dict, "ignoreFiles": list, "ignoreImports": list},
    "devDepsUsageOnProdDetection": {"prodEntryPoints": list, "ignoreTypeImports": bool},
    "restrictedImportsDetection": {"entryPoints": list, "graphExclude": list, "denyFiles": list, "denyModules": list, "ignoreMatches": list, "ignoreTypeImports": bool},
    "restrictedImportersDetection": {"files": list, "modules": list, "allowedEntryPoints": list, "graphExclude": list, "ignoreMatches": list, "ignoreTypeImports": bool},
    "restrictedDirectImportersDetection": {"files": list, "modules": list, "allowImporters": list, "denyImporters": list, "ignoreMatches": list, "ignoreTypeImports": bool},
}
_TOP = {"configVersion", "$schema", "conditionNames", "customAssetExtensions", "ignoreFiles", "processIgnoredFiles", "nodeModulesResolution", "rules"}
_RULE = {"path", "prodEntryPoints", "devEntryPoints", "ignoreEntryPoints", "followMonorepoPackages", "moduleBoundaries", "importConventions", *CHECKS}
_BOUNDARY = {"name", "pattern", "allow", "deny", "denyIgnore", "mutuallyExclusive"}


class ConfigError(ValueError):
    pass


@dataclass
class Rule:
    path: str
    prod: list[str] = field(default_factory=list)
    dev: list[str] = field(default_factory=list)
    ignored: list[str] = field(default_factory=list)
    follow: str | list[str] = "all"
    boundaries: list[dict] = field(default_factory=list)
    conventions: list[dict] = field(default_factory=list)
    checks: dict[str, list[dict]] = field(default_factory=dict)

    @property
    def entries(self) -> list[str]:
        return list(dict.fromkeys([*self.prod, *self.dev, *self.ignored]))


@dataclass
class Config:
    version: str
    rules: list[Rule]
    conditions: list[str] = field(default_factory=list)
    assets: list[str] = field(default_factory=list)
    ignore: list[str] = field(default_factory=list)
    process_ignored: list[str] = field(default_factory=list)
    resolution: str = "entry-package"
    root_dev_deps: bool = False


def _known(raw: dict, names: set[str] | dict, where: str) -> None:
    if not isinstance(raw, dict):
        raise ConfigError(f"{where} must be an object")
    if extra := sorted(set(raw) - set(names)):
        raise ConfigError(f"{where} has an unknown field {extra[0]!r}")


def _strings(raw: dict, key: str, where: str) -> list[str]:
    value = raw.get(key) or []
    if not isinstance(value, list) or not all(isinstance(x, str) for x in value):
        raise ConfigError(f"{where}.{key} must be a list of strings")
    return value


def _globs(patterns: list[str], where: str) -> list[str]:
    try:
        compile_globs(patterns)
    except ValueError as e:
        raise ConfigError(f"{where}: {e}") from None
    return patterns


def _detectors(name: str, raw: object, where: str) -> list[dict]:
    """A check is on or off, an object (on unless it says otherwise), or a list of these."""
    out = []
    for i, one in enumerate(raw if isinstance(raw, list) else [raw]):
        at = f"{where}.{name}[{i}]" if isinstance(raw, list) else f"{where}.{name}"
        if isinstance(one, bool):
            one = {"enabled": one}
        _known(one, {"enabled", *CHECKS[name]}, at)
        for key, kind in CHECKS[name].items():
            if key in one and one[key] is not None and not isinstance(one[key], kind):
                raise ConfigError(f"{at}.{key} must be a {kind.__name__}")
            if kind is list:
                _globs(_strings(one, key, at), f"{at}.{key}")
        out.append({"enabled": True, **one})
    return out


def _validate(name: str, d: dict, where: str) -> None:
    if not d["enabled"]:
        return
    if name == "circularImportsDetection":
        d["algorithm"] = (d.get("algorithm") or "dfs").strip().lower()
        if d["algorithm"] not in ("dfs", "scc"):
            raise ConfigError(f"{where}.algorithm must be DFS or SCC")
    if name == "restrictedImportsDetection" and not (d.get("entryPoints") and (d.get("denyFiles") or d.get("denyModules"))):
        raise ConfigError(f"{where} needs entryPoints and denyFiles or denyModules")
    if name == "restrictedImportersDetection" and not (d.get("allowedEntryPoints") and (d.get("files") or d.get("modules"))):
        raise ConfigError(f"{where} needs allowedEntryPoints and files or modules")
    if name == "restrictedDirectImportersDetection":
        if bool(d.get("files")) == bool(d.get("modules")):
            raise ConfigError(f"{where} needs either files or modules")
        if bool(d.get("allowImporters")) == bool(d.get("denyImporters")):
            raise ConfigError(f"{where} needs either allowImporters or denyImporters")


def _domains(raw: object, where: str) -> list[dict]:
    out = []
    for d in raw if isinstance(raw, list) else []:
        d = {"path": d} if isinstance(d, str) else d
        _known(d, {"path", "alias", "enabled"}, where)
        if not d.get("path"):
            raise ConfigError(f"{where} has a domain without path")
        out.append({"alias": "", "enabled": True, **d})
    if not out:
        raise ConfigError(f"{where} needs domains")
    plain = [d["path"].strip("./").rstrip("/") for d in out if "*" not in d["path"]]
    for a in plain:
        for b in plain:
            if a != b and b.startswith(a + "/"):
                raise ConfigError(f"{where} has nested domains {a} and {b}")
    return out


def parse_config(text: str) -> Config:
    try:
        raw = parse_jsonc(text)
    except ValueError as e:
        raise ConfigError(f"not valid JSON: {e}") from None
    _known(raw, _TOP, "config")
    version = raw.get("configVersion")
    if version not in VERSIONS:
        raise ConfigError(f"unsupported configVersion {version!r}; supported: {', '.join(VERSIONS)}")
    resolution = raw.get("nodeModulesResolution") or {}
    resolution = {"resolutionType": resolution} if isinstance(resolution, str) else resolution
    kind = resolution.get("resolutionType") or "entry-package"
    if kind not in ("entry-package", "nearest-package"):
        raise ConfigError(f"unknown nodeModulesResolution {kind!r}")
    rules = []
    for i, r in enumerate(raw.get("rules") or []):
        where = f"rules[{i}]"
        _known(r, _RULE, where)
        if not isinstance(r.get("path"), str) or not r["path"]:
            raise ConfigError(f"{where}.path is required")
        follow = r.get("followMonorepoPackages", True)
        follow = "all" if follow is True else "" if follow is False else follow
        rule = Rule(r["path"], *(_globs(_strings(r, k, where), f"{where}.{k}") for k in ("prodEntryPoints", "devEntryPoints", "ignoreEntryPoints")), follow)
        for j, b in enumerate(r.get("moduleBoundaries") or []):
            at = f"{where}.moduleBoundaries[{j}]"
            _known(b, _BOUNDARY, at)
            if not b.get("name") or bool(b.get("pattern")) == bool(b.get("mutuallyExclusive")):
                raise ConfigError(f"{at} needs a name and either a pattern or mutuallyExclusive")
            rule.boundaries.append(b)
        for j, c in enumerate(r.get("importConventions") or []):
            at = f"{where}.importConventions[{j}]"
            _known(c, {"rule", "domains", "autofix"}, at)
            if c.get("rule") != "relative-internal-absolute-external":
                raise ConfigError(f"{at}.rule is unknown")
            rule.conventions.append({**c, "domains": _domains(c.get("domains"), at)})
        for name in CHECKS:
            if name in r:
                rule.checks[name] = _detectors(name, r[name], where)
                for d in rule.checks[name]:
                    _validate(name, d, f"{where}.{name}")
                    if name in ("orphanFilesDetection", "unusedExportsDetection") and d.get("validEntryPoints") is None:
                        d["validEntryPoints"] = rule.entries
                    if name == "devDepsUsageOnProdDetection" and d.get("prodEntryPoints") is None:
                        d["prodEntryPoints"] = rule.prod
        rules.append(rule)
    return Config(version, rules, *(_strings(raw, k, "config") for k in ("conditionNames", "customAssetExtensions", "ignoreFiles", "processIgnoredFiles")), kind, bool(resolution.get("includeDevDepsFromRoot")))


def load_config(path: str, names: tuple[str, ...] = ("modweave.config.json", "modweave.config.jsonc", ".modweave.config.json", ".modweave.config.jsonc")) -> Config:
    """The configuration file at ``path``, or the one of the known names in that directory; two of them are an error."""
    if os.path.isdir(path):
        found = [n for n in names if os.path.isfile(os.path.join(path, n))]
        if len(found) != 1:
            raise ConfigError(f"{'no' if not found else 'more than one'} configuration file in {path}" + (f": {', '.join(found)}" if found else ""))
        path = os.path.join(path, found[0])
    with open(path, encoding="utf-8") as f:
        return parse_config(f.read())


def select_rules(config: Config, paths: list[str]) -> Config:
    """Only the rules of these paths; none of them is an error."""
    norm = lambda p: os.path.normpath(p)
    kept = [r for r in config.rules if norm(r.path) in {norm(p) for p in paths}]
    if paths and not kept:
        raise ConfigError(f"no rule has path {', '.join(paths)}; rules: {', '.join(r.path for r in config.rules)}")
    return Config(config.version, kept if paths else config.rules, config.conditions, config.assets, config.ignore, config.process_ignored, config.resolution, config.root_dev_deps)


def compact(raw: dict) -> dict:
    """Checks in their shortest form: ``true`` for one that is only enabled, an object instead of a list of one."""
    out = dict(raw)
    out["rules"] = []
    for r in raw.get("rules", []):
        r = dict(r)
        for name in CHECKS:
            if name not in r:
                continue
            items = []
            for d in r[name] if isinstance(r[name], list) else [r[name]]:
                if isinstance(d, dict):
                    on = d.get("enabled", True)
                    rest = {k: v for k, v in d.items() if k != "enabled" and v not in (None, False, "", {})}
                    d = on if not rest else rest if on else {"enabled": False, **rest}
                items.append(d)
            r[name] = items[0] if len(items) == 1 else items
        out["rules"].append(r)
    return out


def trailing_commas(text: str, fix: bool = False) -> tuple[int, str]:
    """How many trailing commas a configuration has, and its text, without them if ``fix``."""
    spans = [m.span() for m in _JSONC.finditer(text) if m[0] == ","]
    out = text
    for a, b in reversed(spans) if fix else []:
        out = out[:a] + out[b:]
    return len(spans), out


def drop_patterns(text: str, dead: list[str]) -> str:
    """A configuration's text without these strings in its lists; comments and the rest stay as they are.

    With a string goes the comma after it, or the one before it if it is the last.
    """
    tokens = [m for m in _TOKEN.finditer(text) if m[0][0] != "/"]
    stack: list[str] = []
    cuts: list[tuple[int, int]] = []
    comma: tuple[int, int] | None = None  # the one before, if still there
    gone = set(dead)
    for i, m in enumerate(tokens):
        t = m[0]
        if t in "{[":
            stack.append(t)
            comma = None
        elif t in "}]":
            stack.pop()
            comma = None
        elif t == ",":
            comma = m.span() if not (cuts and cuts[-1][1] >= m.end()) else comma
        elif t[0] == '"' and stack and stack[-1] == "[" and json.loads(t) in gone:
            after = tokens[i + 1] if i + 1 < len(tokens) else None
            if after is not None and after[0] == ",":
                space = len(text[after.end() :]) - len(text[after.end() :].lstrip(" "))
                cuts.append((m.start(), after.end() + space))
            else:
                cuts.append(m.span())
                if comma:
                    cuts.append(comma)
    for a, b in sorted(cuts, reverse=True):
        text = text[:a] + text[b:]
    return text
