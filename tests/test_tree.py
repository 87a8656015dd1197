import json
import os

import pytest

from modweave.operators import edits, graph
from modweave.plans import commands, render
from modweave.plans.run import run_config
from modweave.sources import config, manifests
from modweave.sources.tree import Options, build_graph
from modweave.sources.walk import walk

FILES = {
    "package.json": '{"name": "top", "workspaces": ["packages/*"], "dependencies": {"react": "^18.0.0", "idle": "1"}, "devDependencies": {"tool": "1", "@types/react": "1"}, "scripts": {"go": "tool --x"}, "imports": {"#in/*": "./src/*", "#ui": "react", "#gone": "nowhere"}}',
    "tsconfig.json": '{ // comment\n "extends": "./base.json", "compilerOptions": {"paths": {"~/*": ["./src/*"],}}}',
    "base.json": '{"compilerOptions": {"paths": {"exact": ["./src/a.ts"]}}}',
    ".gitignore": "dist/\n# no\n",
    ".git/HEAD": "",
    "src/index.ts": "import {a} from './a';\nimport React from 'react';\nimport * as u from '~/util';\nimport 'missing-pkg';\nimport './nowhere';\nimport fs from 'node:fs';\n",
    "src/a.ts": "import type {B} from './b';\nimport {h} from 'lib/helper';\nexport const a = 1;\nexport const unused = 2;\nexport { x, y };\nconst x = 1, y = 2;\n",
    "src/b.ts": "import {a} from 'exact';\nexport type B = string;\n",
    "src/util/index.ts": "import '#in/_hidden';\nexport default function () {}\n",
    "src/_hidden.ts": "import x from '../dist/late';\nimport './logo.svg';\nimport '#ui';\nimport '#gone';\nimport {x as z} from './a';\n",
    "src/logo.svg": "<svg/>",
    "src/orphan.ts": "require('tool');\n",
    "src/Comp.vue": "<template>import 'no'</template>\n<script>import './util'</script>\n",
    "dist/late.js": "import '../src/index';\n",
    "packages/lib/package.json": '{"name": "lib", "exports": {".": "./main.ts", "./*": {"import": "./src/*.ts", "default": "./no.ts"}, "./blocked": null}}',
    "packages/lib/main.ts": "export {};",
    "packages/lib/src/helper.ts": "import {a} from '../../../src/a';\nexport const h = 1;\n",
}


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    base = tmp_path_factory.mktemp("tree")
    for name, text in FILES.items():
        path = base / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    return str(base)


@pytest.fixture(scope="module")
def tree(spark, root):
    return build_graph(spark, root, Options(conditions=["import"]))


def test_walk(root):
    found = walk(root)
    names = [f[len(root) + 1 :] for f in found.files]
    assert names == ["packages/lib/main.ts", "packages/lib/src/helper.ts", "src/Comp.vue", "src/_hidden.ts", "src/a.ts", "src/b.ts", "src/index.ts", "src/orphan.ts", "src/util/index.ts"]
    assert [p[len(root) + 1 :] for p in found.pruned] == ["dist"]


def test_edges(tree, root):
    got = {(r.src[len(root) + 1 :], r.request): (r.dst[len(root) + 1 :], r.resolved_type) for r in tree.edges.where("not is_local_export").collect()}
    assert got == {
        ("src/index.ts", "./a"): ("src/a.ts", "user"), ("src/index.ts", "react"): ("", "node"), ("src/index.ts", "~/util"): ("src/util/index.ts", "user"),
        ("src/index.ts", "missing-pkg"): ("", "unresolved"), ("src/index.ts", "./nowhere"): ("", "unresolved"), ("src/index.ts", "node:fs"): ("", "builtin"),
        ("src/a.ts", "./b"): ("src/b.ts", "user"), ("src/a.ts", "lib/helper"): ("packages/lib/src/helper.ts", "monorepo"), ("src/b.ts", "exact"): ("src/a.ts", "user"),
        ("src/util/index.ts", "#in/_hidden"): ("src/_hidden.ts", "user"), ("src/_hidden.ts", "../dist/late"): ("dist/late.js", "user"), ("src/_hidden.ts", "./logo.svg"): ("", "asset"),
        ("src/_hidden.ts", "./a"): ("src/a.ts", "user"), ("src/_hidden.ts", "#ui"): ("", "node"), ("src/_hidden.ts", "#gone"): ("", "unresolved"), ("src/orphan.ts", "tool"): ("", "node"), ("src/Comp.vue", "./util"): ("src/util/index.ts", "user"),
        ("dist/late.js", "../src/index"): ("src/index.ts", "user"), ("packages/lib/src/helper.ts", "../../../src/a"): ("src/a.ts", "user"),
    }


def test_cycles_and_paths(spark, tree, root):
    cycles = [[p[len(root) + 1 :] for p in r.cycle] for r in graph.cycles_scc(tree.nodes, tree.edges).collect()]
    assert sorted(cycles) == [["dist/late.js", "src/index.ts", "src/util/index.ts", "src/_hidden.ts", "dist/late.js"], ["packages/lib/src/helper.ts", "src/a.ts", "packages/lib/src/helper.ts"]]
    (row,) = commands.resolve(spark, tree, "src/b.ts", ["src/Comp.vue"]).collect()
    assert [p[len(root) + 1 :] for p in row.path][0] == "src/Comp.vue" and row.path[-1].endswith("src/b.ts")
    assert {r.path[len(root) + 1 :] for r in commands.entry_points(spark, tree).collect()} == {"packages/lib/main.ts", "src/Comp.vue", "src/orphan.ts"}


RULES = """{
  // checks
  "configVersion": "1.12", "conditionNames": ["import"],
  "rules": [{
    "path": ".", "prodEntryPoints": ["src/Comp.vue"], "devEntryPoints": ["src/orphan.ts"],
    "circularImportsDetection": {"algorithm": "SCC"}, "orphanFilesDetection": {"autofix": true},
    "unusedNodeModulesDetection": true, "missingNodeModulesDetection": [true], "unresolvedImportsDetection": {"ignoreImports": ["./now*", "#gone"]},
    "unusedExportsDetection": {"autofix": true}, "devDepsUsageOnProdDetection": {"prodEntryPoints": ["src/*.ts"]},
    "moduleBoundaries": [{"name": "core", "pattern": "src/a.ts", "deny": ["packages/**"]}],
    "restrictedImportsDetection": {"entryPoints": ["src/Comp.vue"], "denyModules": ["react"], "denyFiles": ["src/b.ts"]},
    "restrictedDirectImportersDetection": {"files": ["src/util/"], "denyImporters": ["**/*.vue"]},
    "restrictedImportersDetection": {"files": ["src/b.ts"], "allowedEntryPoints": ["src/orphan.ts"]},
  }],
}"""


def test_run(spark, root):
    results = run_config(spark, config.parse_config(RULES), root)
    (rule,) = results.rules
    short = lambda df, *cs: sorted(tuple(str(r[c]).replace(root + "/", "") for c in cs) for r in df.collect())
    c = rule.checks
    assert short(c["orphanFiles"], "path") == [("packages/lib/main.ts",)]
    assert short(c["unusedNodeModules"], "module") == [("idle",)]
    assert short(c["missingNodeModules"], "module") == [("#gone",), ("#ui",), ("missing-pkg",)]
    assert short(c["unresolvedImports"], "request") == [("missing-pkg",)]
    assert short(c["unusedExports"], "path", "name") == [("src/a.ts", "unused"), ("src/a.ts", "y"), ("src/util/index.ts", "default")] or short(c["unusedExports"], "path", "name") == [("src/a.ts", "unused"), ("src/a.ts", "y")]
    assert short(c["restrictedDevDependenciesUsage"], "dependency", "path") == [("tool", "src/orphan.ts")]
    assert short(c["moduleBoundaries"], "import_path", "violation") == [("packages/lib/src/helper.ts", "denied")]
    assert short(c["restrictedImports"], "type", "file", "module") == [("file", "src/b.ts", ""), ("module", "", "react")]
    assert short(c["restrictedDirectImporters"], "importer", "file") == [("src/Comp.vue", "src/util/index.ts")]
    assert short(c["restrictedImporters"], "entry", "file") == [("src/Comp.vue", "src/b.ts")]
    assert c["circularDependencies"].count() == 2
    new = {r.path[len(root) + 1 :]: bytes(r.new_content).decode() for r in results.planned().collect()}
    assert new["src/a.ts"] == "import type {B} from './b';\nimport {h} from 'lib/helper';\nexport const a = 1;\nconst unused = 2;\nexport { x };\nconst x = 1, y = 2;\n"
    report = json.loads(render.to_json(results))
    assert report["hasFailures"] and report["rules"][0]["checks"]["unresolvedImports"]["issues"][0]["startLine"] == 4
    assert report["version"] and report["rules"][0]["checks"]["unresolvedImports"]["issues"][0]["filePath"].startswith("src/")
    assert {"fixedImportsCount", "unfixableAliasingCount"} <= set(report["fixSummary"])
    assert "missing-pkg" in render.text(results) and "src/a.ts" in render.issues_list(results)
    assert results.exit_code() == 1


def test_config_errors():
    for bad, message in (
        ('{"configVersion": "9"}', "unsupported"), ('{"configVersion": "1.0", "x": 1}', "unknown field 'x'"), ('{"configVersion": "1.0", "rules": [{}]}', "path"),
        ('{"configVersion": "1.0", "rules": [{"path": ".", "circularImportsDetection": {"algorithm": "bfs"}}]}', "algorithm"),
        ('{"configVersion": "1.0", "rules": [{"path": ".", "importConventions": [{"rule": "relative-internal-absolute-external", "domains": ["a", "a/b"]}]}]}', "nested"),
    ):
        with pytest.raises(config.ConfigError, match=message):
            config.parse_config(bad)
    assert config.trailing_commas('{"a": [1,], // x,}\n}', True) == (2, '{"a": [1] // x,}\n}')
    assert config.compact({"rules": [{"path": ".", "orphanFilesDetection": [{"enabled": True}]}]})["rules"][0]["orphanFilesDetection"] is True
    drop = config.drop_patterns
    assert drop('["a", /* c */ "dead", "b"]', ["dead"]) == '["a", /* c */ "b"]'
    assert drop('["a", "dead" // c\n]', ["dead"]) == '["a"  // c\n]' and drop('["dead"]', ["dead"]) == "[]" and drop('["dead", "dead", "x"]', ["dead"]) == '["x"]'
    assert drop('{"k": ["dead", "gone"], "dead": "dead"}', ["dead", "gone"]) == '{"k": [], "dead": "dead"}'


def test_edits():
    assert edits.apply_to(b"0123456789", [(1, 3, "a"), (2, 8, "LONG"), (8, 9, "")]) == b"01LONG9"
    assert edits.whole_line(b"a\n  b  \nc", 4, 5) == (2, 8)


def test_dependency_places():
    text = '{"scripts": {"a": "1"}, /* "a": */ "dependencies": {"b": "1", // "a": 2\n "a": "^1"}, "devDependencies": {"a": "2"}}'
    start, end = manifests.dependency_place(text, "a")
    assert text[start:end] == "a" and text[end:].startswith('": "^1"')
    assert manifests.dependency_place(text, "c") is None


def test_manifests(tmp_path):
    assert manifests.parse_jsonc('{"a": "//x", /* c */ "b": [1,2,],}') == {"a": "//x", "b": [1, 2]}
    table = {"./*": "./all/*.js", "./x/*": "./x/*.ts", "./x": {"import": "./i.ts", "default": "./d.ts"}}
    assert manifests.match_keys(table, "./x/y") == ("./x/*.ts", "y") and manifests.pick_condition(table["./x"], ["import"]) == "./i.ts" and manifests.pick_condition(table["./x"], []) == "./d.ts"
    assert manifests.fill("a/*.ts", "b.ts") == "a/b.ts"
    (tmp_path / "pnpm-workspace.yaml").write_text("packages:\n  - 'a/*'\n  # no\n  - \"!a/b\"\nother: 1\n")
    assert manifests.workspace_patterns(str(tmp_path)) == ["a/*", "!a/b"]


def test_installed_and_sizes(spark, tmp_path):
    def put(path, name, version, deps=None, size=10):
        d = tmp_path / path
        d.mkdir(parents=True)
        body = json.dumps({"name": name, "version": version, "dependencies": deps or {}})
        (d / "package.json").write_text(body)
        (d / "x.js").write_text("x" * (1000 * size))
        (d / "README.md").write_text("doc")

    put("node_modules/a", "a", "1.0.0", {"b": "^1.0.0"})
    put("node_modules/b", "b", "1.2.0", {"c": "*"})
    put("node_modules/@s/c", "@s/c", "3.0.0")
    put("node_modules/a/node_modules/b", "b", "2.0.0")
    put("node_modules/c", "c", "1.0.0")
    put("sub/node_modules/c", "c", "1.0.0")
    (tmp_path / "package.json").write_text(json.dumps({"name": "r", "dependencies": {"a": "1", "@s/c": "*"}}))
    assert sorted(r.path[len(str(tmp_path)) + 1 :] for r in commands.installed_duplicates(spark, str(tmp_path)).collect()) == ["node_modules/c", "sub/node_modules/c"]
    report = {r.name + r.version: r for r in commands.analyze_size(spark, str(tmp_path)).collect()}
    # a names b ^1: the copy inside a is 2.0.0 and doesn't fit, so the outer one is meant; it and its c go with a
    a = report["a1.0.0"]
    assert a.exclusive > 19_000 and a.total == a.own + a.exclusive + a.shared
    assert commands.prune_docs(spark, str(tmp_path)).count() == 6
    assert commands.prune_docs(spark, str(tmp_path), ["**/*.js"]).count() == 6 and commands.prune_docs(spark, str(tmp_path), ["**/*.js"], defaults=True).count() == 12
    plan, sizes = commands.dedupe_installed(spark, str(tmp_path))
    base = str(tmp_path) + "/"
    assert [(r.keep.removeprefix(base), r.link.removeprefix(base)) for r in plan.collect()] == [("node_modules/c", "sub/node_modules/c")]
    by = {r.top.removeprefix(base): r for r in sizes.collect()}
    assert by["sub/node_modules"].after == 0 < by["sub/node_modules"].before and by["node_modules"].after == by["node_modules"].before
    (tmp_path / "node_modules" / ".bin").mkdir()
    (tmp_path / "node_modules" / ".bin" / "tool").write_text("y" * 500)
    os.symlink(base + "node_modules/a", base + "node_modules/linked")
    assert {r.top.removeprefix(base): r.bytes for r in commands.dirs_size(spark, str(tmp_path)).collect()}["node_modules"] == by["node_modules"].before + 500


def test_uses_beyond_imports(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.ts").write_text("import x from 'imported';\n\n\n// note\nconst t = css`\nred\n`;\n")
    (tmp_path / "ci.yml").write_text("run: listed --now\n")
    (tmp_path / "babel.js").write_text("presets: ['mentioned']\n")
    deps = ["imported", "@x/tool", "listed", "mentioned", "typed", "idle", "hooked"]
    body = {"name": "r", "dependencies": {d: "1" for d in deps}, "scripts": {"build": "@x/tool --fast"}, "hooks": {"pre": "hooked run"}}
    (tmp_path / "package.json").write_text(json.dumps(body))
    (tmp_path / "tsconfig.json").write_text(json.dumps({"compilerOptions": {"types": ["typed"]}}))
    for d in ("@x/tool", "listed", "hooked"):
        (tmp_path / "node_modules" / d).mkdir(parents=True)
        (tmp_path / "node_modules" / d / "package.json").write_text(json.dumps({"name": d, "version": "1.0.0", "bin": "./cli.js"}))
    root = str(tmp_path)
    assert manifests.binaries({"name": "@x/tool", "bin": "./cli.js"}) == ["@x/tool"] and manifests.binaries({"name": "y", "bin": {"b": "", "a": ""}}) == ["a", "b"]
    assert sorted(r.module for r in commands.unused_modules(spark, root).collect()) == ["hooked", "idle", "listed", "mentioned"]
    more = dict(fields=["hooks"], binaries=["ci.yml"], mentions=["babel.js"])
    assert [r.module for r in commands.unused_modules(spark, root, **more).collect()] == ["idle"]
    assert sorted({r.module for r in commands.used_modules(spark, root, **more).collect()}) == sorted(set(deps) - {"idle"})
    by = {r.module: r["paths"] for r in commands.used_modules(spark, root, group_by="module", **more).collect()}
    assert by["imported"] == [root + "/src/a.ts"] and by["listed"] == [root + "/ci.yml"]
    assert [(r.entry, r.modules) for r in commands.used_modules(spark, root, group_by="entry").where("entry LIKE '%a.ts'").collect()] == [(root + "/src/a.ts", ["imported"])]
    assert "➞" in render.grouped(commands.used_modules(spark, root, group_by="file"), "path", "modules", root)
    counts = commands.lines_of_code(spark, root)
    assert [tuple(r)[1:] for r in counts.where("path LIKE '%/a.ts'").collect()] == [(6, 5, 3)]
    totals = commands.line_totals(counts)
    assert [r.metric for r in totals.collect()][0] == "Total lines" and totals.first().percentage == "100.00%"
    assert render.table(totals, {"metric": "Metric", "lines": "Lines"}, ["metric"]).startswith("Metric")


def test_lint(spark, tree):
    from modweave.plans.lint import lint_config, lint_fix

    text = '{"configVersion": "1.12", "rules": [{"path": ".", "prodEntryPoints": ["src/*.ts", "src/a.ts", /* gone */ "none/**", "!never/"], "missingNodeModulesDetection": {"excludeModules": ["missing-*", "left-pad"]}}]}'
    dead, over = lint_config(config.parse_config(text), tree)
    assert sorted((r.place, r.pattern, r.severity) for r in dead.collect()) == [
        ("rules[0].missingNodeModulesDetection.excludeModules", "left-pad", "error"), ("rules[0].prodEntryPoints", "!never/", "warning"), ("rules[0].prodEntryPoints", "none/**", "error"),
    ]
    assert [(r.a, r.b, r.kind, r.shared) for r in over.collect()] == [("src/a.ts", "src/*.ts", "contained", 1)]
    fixed = lint_fix(text, dead)
    assert "none/**" not in fixed and "left-pad" not in fixed and "!never/" in fixed
    config.parse_config(fixed)
