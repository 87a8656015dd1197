"""Graph algorithms on one worker's adjacency lists; all are iterative, so that long chains don't overflow a stack."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable

Adjacency = dict[str, list[str]]


def adjacency(rows: Iterable[tuple[str, str]]) -> Adjacency:
    out: Adjacency = {}
    for a, b in rows:
        out.setdefault(a, []).append(b)
    return out


def reached(adj: Adjacency, root: str) -> list[str]:
    """What ``root`` reaches, itself included, breadth first."""
    seen, queue = {root}, deque([root])
    while queue:
        for b in adj.get(queue.popleft(), ()):
            if b not in seen:
                seen.add(b)
                queue.append(b)
    return list(seen)


def closed(adj: dict[int, list[int]], start: Iterable[int], seen: set[int] | None = None) -> set[int]:
    """What is reached from ``start``, itself included, and not ``seen`` before; ``seen`` is added to."""
    seen = set() if seen is None else seen
    new = set(start) - seen
    out = set(new)
    seen |= new
    while new:
        step: set[int] = set()
        for a in new:
            if a in adj:
                step.update(adj[a])
        new = step - seen
        seen |= new
        out |= new
    return out


def dfs_parents(adj: Adjacency, roots: Iterable[str]) -> dict[str, list[str]]:
    """Parent links in the order in which a depth-first build meets them, duplicates kept.

    An edge to a node that is still being built leaves only a placeholder, which the node replaces when it is
    finished; so back edges give no parent. A node's first parent is the one it was discovered from.
    """
    parents: dict[str, list[str]] = {}
    own: dict[str, list[str]] = {}
    done: set[str] = set()
    for root in roots:
        if root in done:
            continue
        own[root] = []
        stack = [(root, iter(adj.get(root, ())))]
        open_ = {root}
        while stack:
            node, it = stack[-1]
            for child in it:
                if child in done:
                    parents[child].append(node)
                elif child in open_:
                    continue
                else:
                    own[child] = [node]
                    open_.add(child)
                    stack.append((child, iter(adj.get(child, ()))))
                    break
            else:
                stack.pop()
                open_.discard(node)
                done.add(node)
                parents[node] = own[node]
    return parents


def resolution_paths(parents: dict[str, list[str]], target: str, all_paths: bool, most: int = 1000) -> tuple[list[list[str]], bool]:
    """Paths root to target along the parent links (the first ones only, unless ``all_paths``); whether the limit cut them."""
    if target not in parents:
        return [], False
    if not all_paths:
        path, seen = [target], {target}
        while parents[path[-1]] and parents[path[-1]][0] not in seen:
            path.append(parents[path[-1]][0])
            seen.add(path[-1])
        return ([path[::-1]] if len(path) > 1 else []), False
    out: list[list[str]] = []
    stack: list[tuple[str, ...]] = [(target,)]
    while stack:
        path = stack.pop()
        above = parents.get(path[0], [])
        if not above:
            if len(path) > 1:
                out.append(list(path))
                if len(out) > most:
                    return out, True
            continue
        stack += [(p, *path) for p in reversed(above) if p not in path]
    return out, False


def dfs_cycles(adj: Adjacency, order: Iterable[str]) -> list[list[str]]:
    """One cycle for each back edge of a depth-first walk from the nodes in order; repeated ones once."""
    out, visited, path, at = [], set(), [], {}
    for root in order:
        if root in visited:
            continue
        visited.add(root)
        path, at = [root], {root: 0}
        stack = [iter(adj.get(root, ()))]
        while stack:
            for child in stack[-1]:
                if child in at:
                    out.append([*path[at[child] :], child])
                elif child not in visited:
                    visited.add(child)
                    at[child] = len(path)
                    path.append(child)
                    stack.append(iter(adj.get(child, ())))
                    break
            else:
                stack.pop()
                del at[path.pop()]
    return [list(c) for c in dict.fromkeys(map(tuple, out))]


def strong_components(adj: Adjacency, nodes: Iterable[str]) -> list[list[str]]:
    """Strongly connected components (Tarjan), each sorted."""
    index: dict[str, int] = {}
    low: dict[str, int] = {}
    held: list[str] = []
    on: set[str] = set()
    out = []
    for root in nodes:
        if root in index:
            continue
        index[root] = low[root] = len(index)
        held.append(root)
        on.add(root)
        stack = [(root, iter(adj.get(root, ())))]
        while stack:
            node, it = stack[-1]
            for child in it:
                if child not in index:
                    index[child] = low[child] = len(index)
                    held.append(child)
                    on.add(child)
                    stack.append((child, iter(adj.get(child, ()))))
                    break
                if child in on:
                    low[node] = min(low[node], index[child])
            else:
                stack.pop()
                if stack:
                    low[stack[-1][0]] = min(low[stack[-1][0]], low[node])
                if low[node] == index[node]:
                    one = []
                    while not one or one[-1] != node:
                        one.append(held.pop())
                        on.discard(one[-1])
                    out.append(sorted(one))
    return out


def least_cycle(adj: Adjacency, component: list[str]) -> list[str]:
    """The first cycle through the least node of a component that a search in name order finds.

    At each step it is the least neighbour from which the start can still be reached off the path; so the search
    never has to turn back.
    """
    start, inside = component[0], set(component)
    back = adjacency((b, a) for a in component for b in adj.get(a, ()) if b in inside)
    path, used = [start], {start}
    while True:
        home, queue = {start}, deque([start])
        while queue:
            for b in back.get(queue.popleft(), ()):
                if b not in home and b not in used:
                    home.add(b)
                    queue.append(b)
        for b in sorted(adj.get(path[-1], ())):
            if b == start:
                return [*path, start]
            if b in inside and b not in used and b in home:
                path.append(b)
                used.add(b)
                break
        else:
            return [start, start]


def references(adj: Adjacency, roots: dict[str, int]) -> dict[str, int]:
    """How often each package is referred to, by roots and by others."""
    refs = dict(roots)
    for bs in adj.values():
        for b in bs:
            refs[b] = refs.get(b, 0) + 1
    return refs


def exclusive(adj: Adjacency, roots: dict[str, int], candidate: str, refs: dict[str, int] | None = None) -> set[str]:
    """What would go if the roots no longer referred to ``candidate``: it, and what then has no reference left.

    ``refs`` may be given for many candidates; only what goes is visited.
    """
    refs = references(adj, roots) if refs is None else refs
    less = {candidate: roots.get(candidate, 0)}
    gone, queue = set(), deque([candidate] if refs.get(candidate, 0) <= less[candidate] else [])
    while queue:
        a = queue.popleft()
        if a in gone:
            continue
        gone.add(a)
        for b in adj.get(a, ()):
            less[b] = less.get(b, 0) + 1
            if refs[b] <= less[b]:
                queue.append(b)
    return gone
