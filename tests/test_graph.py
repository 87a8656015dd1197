import random

import pytest

from modweave.functions.semver import fits
from modweave.operators import detectors, graph, kernels, modules
from modweave.operators.components import components

EDGE = "src string, seq int, request string, dst string, resolved_type string, kind string"


def edges(spark, pairs):
    rows, n = [], {}
    for a, b, *kind in pairs:
        n[a] = n.get(a, -1) + 1
        rows.append((a, n[a], "./" + b, b, "user", kind[0] if kind else "mixed"))
    return spark.createDataFrame(rows, EDGE)


def nodes(spark, pairs):
    return spark.createDataFrame(sorted({(x,) for p in pairs for x in p[:2]}), "path string")


def cycles(df):
    return [r.cycle for r in df.collect()]


SCC = [("A", "B"), ("A", "C"), ("B", "C"), ("C", "A"), ("D", "E"), ("E", "D")]


def test_cycles_are_the_same_in_any_edge_order(spark):
    for pairs in (SCC, SCC[::-1]):
        assert sorted(cycles(graph.cycles_scc(nodes(spark, pairs), edges(spark, pairs)))) == [["A", "B", "C", "A"], ["D", "E", "D"]]


def test_type_edges_and_self_loops(spark):
    pairs = [("A", "B"), ("B", "A", "only_type"), ("S", "S")]
    n, e = nodes(spark, pairs), edges(spark, pairs)
    assert sorted(cycles(graph.cycles_scc(n, e))) == [["A", "B", "A"], ["S", "S"]]
    assert cycles(graph.cycles_scc(n, e, ignore_types=True)) == [["S", "S"]]
    assert sorted(cycles(graph.cycles_dfs(n, e))) == [["A", "B", "A"], ["S", "S"]]


def test_complete_graph(spark):
    pairs = [(a, b) for a in "abc" for b in "abc" if a != b]
    assert cycles(graph.cycles_scc(nodes(spark, pairs), edges(spark, pairs))) == [["a", "b", "a"]]


def test_back_edges_are_no_parents(spark):
    pairs = [("A", "B"), ("B", "A")]
    e = edges(spark, pairs)
    roots, target = nodes(spark, pairs), spark.createDataFrame([("A",)], "path string")
    assert {r.entry for r in graph.reach_targets(graph.followed(e), roots, target).collect()} == {"A", "B"}
    assert {r.entry for r in graph.reach_targets(e, roots, target, exact=False).collect()} == {"A"}


def test_parents_keep_duplicates_and_order():
    adj = {"r": ["a", "b", "a"], "b": ["a", "r"]}
    assert kernels.dfs_parents(adj, ["r"]) == {"r": [], "a": ["r", "b", "r"], "b": ["r"]}
    assert kernels.resolution_paths(kernels.dfs_parents(adj, ["r"]), "a", True)[0] == [["r", "a"], ["r", "b", "a"], ["r", "a"]]
    assert kernels.resolution_paths(kernels.dfs_parents(adj, ["r"]), "r", False) == ([], False)


def test_paths(spark):
    e = edges(spark, [("r", "a"), ("a", "b"), ("b", "t"), ("r", "c"), ("c", "t"), ("q", "z")])
    roots = spark.createDataFrame([("r",), ("q",)], "path string")
    assert [(x.entry, x.path) for x in graph.paths(e, roots, "t").collect()] == [("r", ["r", "a", "b", "t"])]
    assert sorted(x.path for x in graph.paths(e, roots, "t", all_paths=True).collect()) == [["r", "a", "b", "t"], ["r", "c", "t"]]
    assert [x.path for x in graph.shortest_paths(e, "r", "t").collect()] == [["r", "c", "t"]]
    assert graph.shortest_paths(e, "r", "z").count() == 0
    assert [x.path for x in graph.shortest_paths(e, "r", "r").collect()] == [["r"]]


def test_long_chains_do_not_recurse():
    adj = {str(i): [str(i + 1)] for i in range(30_000)}
    adj["30000"] = ["0"]
    assert len(kernels.dfs_cycles(adj, ["0"])[0]) == 30_002
    assert len(kernels.strong_components(adj, ["0"])[0]) == 30_001
    assert len(kernels.dfs_parents(adj, ["0"])) == 30_001


def brute_least(adj, start, inside):
    def walk(path):
        for b in sorted(adj.get(path[-1], [])):
            if b == start:
                return [*path, start]
            if b in inside and b not in path and (got := walk([*path, b])):
                return got
        return None

    return walk([start])


@pytest.mark.parametrize("seed", range(30))
def test_least_cycle_equals_backtracking(seed):
    rng = random.Random(seed)
    names = "abcdefg"
    adj = {a: [b for b in names if rng.random() < 0.3] for a in names}
    for c in kernels.strong_components(adj, names):
        if len(c) > 1 or c[0] in adj[c[0]]:
            assert kernels.least_cycle(adj, c) == brute_least(adj, c[0], set(c))


def test_strategies_agree(spark, monkeypatch):
    rng = random.Random(7)
    pairs = [(f"n{rng.randrange(60)}", f"n{rng.randrange(60)}") for _ in range(70)] + [("x1", "x2"), ("x2", "x3")]
    e, n = edges(spark, pairs), nodes(spark, pairs)
    adj = kernels.adjacency(pairs)
    want = {(a, b) for (a,) in n.collect() for b in kernels.reached(adj, a)}
    for bound in (10**6, 40, 0):
        assert {tuple(r) for r in graph.reach_pairs(e, n, bound).collect()} == want
    doubled = {tuple(r) for r in graph.doubled_pairs(e).collect()}
    assert doubled | {(a, a) for a, _ in want} == want
    first = pairs[0][0]
    roots = spark.createDataFrame([(first,), ("x1",)], "path string")
    set_ = {r.path for r in graph.reachable(e, roots).collect()}
    before = {(r.path, r.component, r.size) for r in graph.scc(n, e).collect()}
    monkeypatch.setattr(graph, "LOCAL_EDGES", 0)
    assert {r.path for r in graph.reachable(e, roots).collect()} == set_ == {b for a, b in want if a in (first, "x1")}
    assert {(r.path, r.component, r.size) for r in graph.scc(n, e).collect()} == before
    mutual = {a: min(b for b in {y for x, y in want if x == a} if (b, a) in want) for a, _ in want}
    assert {p: c for p, c, _ in before} == mutual


def test_tasks_are_bounded_and_agree(spark):
    rng = random.Random(9)
    pairs = [(f"n{rng.randrange(50)}", f"n{rng.randrange(50)}") for _ in range(75)] + [(f"m{i}", f"m{(i + 1) % 6}") for i in range(6)]
    e, n = edges(spark, pairs), nodes(spark, pairs)
    adj = kernels.adjacency(pairs)
    names = sorted({x for p in pairs for x in p})
    want = {(a, b) for a in names for b in kernels.reached(adj, a)}
    for bounds in ((10**6, 500), (40, 100)):
        assert {tuple(r) for r in graph.reach_pairs(e, n, *bounds).collect()} == want
    strong = {(p, c[0], len(c)) for c in kernels.strong_components(adj, names) for p in c}
    cycles = sorted(r.cycle for r in graph.cycles_scc(n, e).collect())
    assert sorted({c[0] for c in cycles}) == sorted({c for _, c, k in strong if k > 1} | {a for a, b in pairs if a == b})
    for bound in (10**6, 10):  # one task; by component and, for the largest, by colours
        assert {tuple(r) for r in graph.scc(n, e, False, bound).collect()} == strong


def test_size_report_in_parts_and_by_hand(spark):
    rng = random.Random(4)
    names = [f"p{i}" for i in range(30)]
    size = {x: rng.randrange(1, 50) for x in names}
    links = [(a, b) for a, b in ((rng.choice(names[:15]), rng.choice(names[:15])) for _ in range(14)) if a != b] + [("p20", "p21"), ("p21", "p22"), ("p23", "p22")]
    links = sorted(set(links))
    roots = ["p0", "p3", "p20", "p23", "p29"]
    have = spark.createDataFrame([(x, "1", x, size[x]) for x in names], "name string, version string, path string, size long")
    ties = spark.createDataFrame(links + [("", r) for r in roots], "src string, dst string")
    adj = kernels.adjacency(links)

    def gone_with(c):  # take the roots' name for c away, then again and again what nothing names
        left, named, gone = list(links), [r for r in roots if r != c], set()
        new = {c} if c not in [b for _, b in left] + named else set()
        while new:
            gone |= new
            touched = {b for a, b in left if a in new}
            left = [(a, b) for a, b in left if a not in new]
            new = {b for b in touched if b not in [y for _, y in left] + named} - gone
        return gone

    want = {c: (size[c], sum(size[x] for x in gone_with(c) - {c}), sum(size[x] for x in kernels.reached(adj, c))) for c in names}
    for bounds in ((10**6, 20), (0, 5)):
        got = modules.size_report(have, ties, None, *bounds).collect()
        assert {r.path: (r.own, r.exclusive, r.total) for r in got} == want and all(r.shared == r.total - r.own - r.exclusive for r in got)


def test_first_issues(spark):
    rows = [("a", f"f{i:02}") for i in range(9)] + [("b", "f1")]
    out = modules.first_issues(spark.createDataFrame(rows, "check string, path string"), ["path"], 3).collect()
    assert sorted((r.check, r.path, r.remaining) for r in out) == [("a", "f00", 6), ("a", "f01", 6), ("a", "f02", 6), ("b", "f1", 0)]


def test_nearest_package_answers(spark):
    e = spark.createDataFrame([("/r/a/x", 0, "m", "", "node", "mixed"), ("/r/ab/x", 0, "m", "", "node", "mixed"), ("/r/a/in/x", 0, "m", "", "node", "mixed")], EDGE)
    n = spark.createDataFrame([("/r/a/x",), ("/r/ab/x",), ("/r/a/in/x",)], "path string")
    dev = spark.createDataFrame([("/r/a", "m")], "package_root string, module string")
    packages = spark.createDataFrame([("/r",), ("/r/a",), ("/r/a/in",)], "root string")
    find = lambda **more: sorted(r.path for r in detectors.dev_deps_in_prod(n, e, ["**"], dev, root="/r", **more).collect())
    assert find(packages=packages) == ["/r/a/x"] and find() == ["/r/a/in/x", "/r/a/x"]
    everywhere = spark.createDataFrame([("", "m")], "package_root string, module string")
    assert len(detectors.dev_deps_in_prod(n, e, ["**"], everywhere, root="/r", packages=packages).collect()) == 3


def test_components(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)]
    parent = list(range(200))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "src long, dst long")).collect()}
    assert got == {x: find(x) for p in pairs if p[0] != p[1] for x in p}
    assert components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_orphans(spark):
    pairs = [("X", "Y"), ("Y", "X"), ("S", "S"), ("R", "T", "only_type")]
    n, e = nodes(spark, pairs), edges(spark, pairs)
    assert [r.path for r in detectors.orphans(n, e).collect()] == ["R"]  # neither the dead cycle nor the self-import
    assert sorted(r.path for r in detectors.orphans(n, e, ignore_types=True).collect()) == ["R", "T"]


def test_boundary_must_allow_itself(spark):
    e = edges(spark, [("a/x", "a/y"), ("a/x", "b/z")])
    out = detectors.boundaries(e, [detectors.Boundary("m", "a/**", allow=["b/**"])]).collect()
    assert [(r.import_path, r.violation) for r in out] == [("a/y", "not_allowed")]


def test_unused_exports(spark):
    exports = spark.createDataFrame([("m", 0, "a", False), ("m", 1, "b", False), ("m", 2, "b", True), ("n", 0, "c", False)], "path string, seq long, name string, is_type boolean")
    uses = spark.createDataFrame([("k", "m", "a"), ("k", "n", "*")], "src string, path string, name string")
    assert [tuple(r) for r in detectors.unused_exports(exports, uses).collect()] == [("m", "b", True)]
    assert detectors.unused_exports(exports, uses, ignore_types=True).count() == 0


def test_relative_paths(spark):
    rows = [("/a/b/c.ts", "/a/b/d.ts", "./d.ts"), ("/a/b/c.ts", "/a/x.ts", "../x.ts"), ("/a/b/c.ts", "/a/b/e/f.ts", "./e/f.ts"), ("/a.ts", "/q/r.ts", "./q/r.ts")]
    from pyspark.sql import functions as F

    for s, d, want in rows:
        assert spark.createDataFrame([(s, d)], "s string, d string").select(detectors.relative_path(F.col("s"), F.col("d"))).first()[0] == want


@pytest.mark.parametrize(
    "version,wanted,ok",
    [("1.2.3", "^1.0.0", True), ("2.0.0", "^1.0.0", False), ("0.2.5", "^0.2.3", True), ("0.3.0", "^0.2.3", False), ("1.2.9", "~1.2.3", True), ("1.3.0", "~1.2.3", False), ("1.9.0", "1.x", True), ("2.0.0", "1.x || >=2 <3", True),
     ("1.5.0", "1.2 - 1.6", True), ("1.0.0", "", True), ("1.0.0", "*", True), ("1.0.0", "latest", False), ("bad", "^1", False), ("1.0.0-beta.2", "^1.0.0", False), ("1.0.0-beta.2", "^1.0.0-beta.1", True), ("1.0.0", ">= 1.0.0", True), ("3.0.0", "=3", True)],
)
def test_ranges(version, wanted, ok):
    assert fits(version, wanted) is ok


def test_exclusive_cascade():
    adj = {"a": ["b", "c"], "b": ["d"], "c": ["d"], "e": ["c"]}
    assert kernels.exclusive(adj, {"a": 1, "e": 1}, "a") == {"a", "b"}
    assert kernels.exclusive(adj, {"a": 1}, "a") == {"a", "b"}  # e still refers to c
    assert kernels.exclusive(adj, {"a": 1, "e": 1, "b": 1}, "b") == set()
