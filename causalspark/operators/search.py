"""Graph searches: constraint-based, with latent variables, score-based, hybrid, and local.

Searches ask a test or a score and never touch rows; variables are taken in the test's order
and skeletons are stable (adjacencies are frozen for each depth), so results do not depend
on the order of execution. `skeleton_fan_out` spreads the tests of a depth over a cluster.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa

from .graph import ARROW, CIRCLE, TAIL, Graph, cpdag, dag_from_pattern, inducing_path, meek
from .independence import DSeparation, FisherZ, Test
from .knowledge import Knowledge


# skeletons


def _sets(others: list[str], depth: int):
    return combinations(others, depth)


def skeleton(test: Test, depth: int = -1, knowledge: Knowledge | None = None, stable: bool = True, start: Graph | None = None):
    """(undirected graph, {pair: separating set}) by tests of growing depth among adjacent nodes."""
    g = start.copy().reorient(TAIL) if start is not None else Graph.complete(test.variables)
    sepsets: dict[frozenset, tuple] = {}
    if knowledge:
        for a, b in combinations(g.nodes, 2):
            if g.adjacent(a, b) and knowledge.no_edge(a, b):
                g.remove_edge(a, b)
    d = 0
    while depth < 0 or d <= depth:
        adj = {v: g.adj(v) for v in g.nodes}
        if all(len(a) - 1 < d for a in adj.values()):
            break
        for x in g.nodes:
            for y in list(adj[x]):
                if not g.adjacent(x, y) or knowledge and (knowledge.required(x, y) or knowledge.required(y, x)):
                    continue
                near = adj[x] if stable else g.adj(x)
                others = [v for v in near if v != y and (not knowledge or knowledge.may_condition(v, x, y))]
                for z in _sets(others, d):
                    if test.independent(x, y, z):
                        g.remove_edge(x, y)
                        sepsets[frozenset((x, y))] = z
                        break
        d += 1
    return g, sepsets


def skeleton_fan_out(spark, stats, alpha: float = 0.05, depth: int = -1):
    """The stable skeleton of Gaussian data with each depth's pairs tested by Spark tasks.

    Tasks get the covariance (p * p numbers) and the frozen adjacencies; what comes back is
    one row for each pair that was separated.
    """
    g, sepsets, d = Graph.complete(stats.names), {}, 0
    parallelism = spark.sparkContext.defaultParallelism
    while depth < 0 or d <= depth:
        adj = {v: g.adj(v) for v in g.nodes}
        pairs = [(x, y) for x in g.nodes for y in adj[x] if len(adj[x]) - 1 >= d]
        if not pairs:
            break

        def run(batches, adj=adj, d=d):
            test = FisherZ(stats, alpha)
            for b in batches:
                found = []
                for x, y in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    z = next((z for z in _sets([v for v in adj[x] if v != y], d) if test.independent(x, y, z)), None)
                    if z is not None:
                        found.append((x, y, list(z)))
                yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.string()), pa.array([f[2] for f in found], pa.list_(pa.string()))], names=["x", "y", "z"])

        rows = spark.createDataFrame(pairs, "x string, y string").repartition(min(parallelism * 4, max(1, len(pairs) // 8)))
        order = {v: k for k, v in enumerate(g.nodes)}
        for r in sorted(rows.mapInArrow(run, "x string, y string, z array<string>").collect(), key=lambda r: (order[r["x"]], order[r["y"]])):
            if g.adjacent(r["x"], r["y"]):
                g.remove_edge(r["x"], r["y"])
                sepsets[frozenset((r["x"], r["y"]))] = tuple(r["z"])
        d += 1
    return g, sepsets


# PC and relatives


def _orient_knowledge(g: Graph, knowledge: Knowledge | None, free: str = TAIL) -> None:
    if not knowledge:
        return
    for a, b, _, _ in g.edges():
        for u, v in ((a, b), (b, a)):
            if knowledge.required(u, v) or knowledge.forbidden(v, u) and not knowledge.forbidden(u, v):
                g.set_mark(u, v, ARROW)
                g.set_mark(v, u, TAIL)


def _may_collide(g: Graph, a: str, b: str, c: str, knowledge: Knowledge | None, free: str) -> bool:
    for u in (a, c):
        if g.mark(b, u) == ARROW and free == TAIL or g.mark(u, b) == TAIL and g.mark(b, u) == ARROW:
            return False  # an arrow already leaves b
        if knowledge and (knowledge.forbidden(u, b) or knowledge.required(b, u)):
            return False
    return True


def _collide(g: Graph, a: str, b: str, c: str) -> None:
    g.set_mark(a, b, ARROW)
    g.set_mark(c, b, ARROW)


def _triple_sets(test: Test, g: Graph, a: str, c: str, depth: int):
    """Every conditioning set among the neighbours of a, then of c, once each."""
    seen = set()
    for v, other in ((a, c), (c, a)):
        near = [u for u in g.adj(v) if u != other]
        for d in range(len(near) + 1 if depth < 0 else min(depth, len(near)) + 1):
            for z in _sets(near, d):
                if frozenset(z) not in seen:
                    seen.add(frozenset(z))
                    yield z


def orient_colliders(g: Graph, test: Test, sepsets: dict, rule: str = "sepset", knowledge: Knowledge | None = None, depth: int = -1, free: str = TAIL) -> Graph:
    """Mark unshielded colliders by the separating set, by all sets (conservative, majority), or by the best one (max_p)."""
    ranked = []
    for a, b, c in g.unshielded():
        if rule == "sepset":
            z = sepsets.get(frozenset((a, c)))
            if z is not None and b not in z:
                ranked.append((0.0, a, b, c))
            continue
        votes = [(test.score(a, c, z), b in z) for z in _triple_sets(test, g, a, c, depth) if rule == "max_p" or test.independent(a, c, z)]
        if not votes:
            continue
        if rule == "max_p":
            best = min(votes, key=lambda v: v[0])
            if not best[1]:
                ranked.append((best[0], a, b, c))
        else:
            inside = sum(v for _, v in votes)
            if inside == 0 or rule == "majority" and 2 * inside < len(votes):
                ranked.append((0.0, a, b, c))
            elif inside < len(votes) and not (rule == "majority" and 2 * inside > len(votes)):
                g.ambiguous.add((b, frozenset((a, c))))
    for _, a, b, c in sorted(ranked, key=lambda r: r[0]):
        if _may_collide(g, a, b, c, knowledge, free):
            _collide(g, a, b, c)
    return g


def pc(test: Test, depth: int = -1, knowledge: Knowledge | None = None, rule: str = "sepset", stable: bool = True) -> Graph:
    """The pattern of a DAG without latent variables."""
    g, sepsets = skeleton(test, depth, knowledge, stable)
    _orient_knowledge(g, knowledge)
    orient_colliders(g, test, sepsets, rule, knowledge, depth)
    return meek(g, knowledge)


def cpc(test: Test, depth: int = -1, knowledge: Knowledge | None = None) -> Graph:
    return pc(test, depth, knowledge, "conservative")


def pc_max(test: Test, depth: int = -1, knowledge: Knowledge | None = None) -> Graph:
    return pc(test, depth, knowledge, "max_p")


# latent variables


def possible_d_sep(g: Graph, x: str) -> list[str]:
    """Nodes that x reaches by paths whose every inner node is a collider or stands in a triangle."""
    seen: set = set()
    todo = [(x, u) for u in g.adj(x)]
    out = set()
    while todo:
        a, b = step = todo.pop()
        if step in seen:
            continue
        seen.add(step)
        out.add(b)
        for c in g.adj(b):
            if c not in (a, x) and (g.is_collider(a, b, c) or g.adjacent(a, c)):
                todo.append((b, c))
    return [v for v in g.nodes if v in out and v != x]


def fci_rules(g: Graph, sepsets: dict, complete: bool = True, knowledge: Knowledge | None = None) -> Graph:
    """Orientation rules R1-R4, and R5-R10 if complete, to the fix-point, in place."""

    def put(a: str, b: str, mark: str) -> bool:
        if g.mark(a, b) != CIRCLE or mark == ARROW and knowledge and (knowledge.forbidden(a, b) and knowledge.forbidden(b, a) or knowledge.required(b, a)):
            return False
        g.set_mark(a, b, mark)
        return True

    def clear(a: str, b: str, c: str) -> bool:
        return (b, frozenset((a, c))) not in g.ambiguous

    def discriminating(a: str, b: str, c: str):
        """(first node, path) of a discriminating path for b that ends a, b, c; a is a parent of c."""
        back = {a: b}
        todo = [a]
        while todo:
            v = todo.pop(0)
            for u in g.adj(v):
                if u in back or u in (b, c) or g.mark(u, v) != ARROW:
                    continue
                if v != a and not (g.mark(back[v], v) == ARROW):
                    continue
                if not g.adjacent(u, c):
                    return u
                if g.directed(u, c) and g.mark(v, u) == ARROW:
                    back[u] = v
                    todo.append(u)
        return None

    def open_paths(start: str, step, goal: str, first: str | None = None):
        """Uncovered paths start..goal whose every step (u, v) passes `step`."""
        todo = [[start, first]] if first else [[start, v] for v in g.adj(start) if step(start, v)]
        while todo:
            path = todo.pop()
            if path[-1] == goal:
                yield path
                continue
            for v in g.adj(path[-1]):
                if v not in path and step(path[-1], v) and not g.adjacent(path[-2], v):
                    todo.append([*path, v])

    can_point = lambda u, v: g.mark(u, v) != TAIL and g.mark(v, u) != ARROW
    changed = True
    while changed:
        changed = False
        for b in g.nodes:
            for a in g.adj(b):
                for c in g.adj(b):
                    if a == c:
                        continue
                    if g.mark(a, b) == ARROW and not g.adjacent(a, c) and g.mark(c, b) == CIRCLE and clear(a, b, c):  # R1
                        if put(b, c, ARROW) | (g.mark(b, c) == ARROW and put(c, b, TAIL)):
                            changed = True
                            put(c, b, TAIL)
                    if g.adjacent(a, c) and g.mark(a, c) == CIRCLE and g.mark(a, b) == ARROW and g.mark(b, c) == ARROW and (g.mark(b, a) == TAIL or g.mark(c, b) == TAIL):  # R2
                        changed |= put(a, c, ARROW)
        for b in g.nodes:  # R3
            for d in [v for v in g.adj(b) if g.mark(v, b) == CIRCLE and g.mark(b, v) is not None]:
                sides = [a for a in g.adj(b) if g.mark(a, b) == ARROW and g.adjacent(a, d) and g.mark(a, d) == CIRCLE]
                if any(not g.adjacent(a, c) and clear(a, d, c) for a, c in combinations(sides, 2)):
                    changed |= put(d, b, ARROW)
        for b in g.nodes:  # R4
            for c in [v for v in g.adj(b) if g.mark(v, b) == CIRCLE]:
                for a in [v for v in g.adj(b) if g.mark(b, v) == ARROW and g.directed(v, c)]:
                    end = discriminating(a, b, c)
                    if end is None:
                        continue
                    if b in sepsets.get(frozenset((end, c)), ()):
                        changed |= put(c, b, TAIL)
                        g.set_mark(b, c, ARROW)
                    else:
                        _collide(g, a, b, c)
                        g.set_mark(b, c, ARROW)
                        changed = True
                    break
        if not complete:
            continue
        for a, b, x, y in g.edges():
            if x == y == CIRCLE:  # R5
                for path in open_paths(a, lambda u, v: g.mark(u, v) == CIRCLE and g.mark(v, u) == CIRCLE, b):
                    if len(path) > 3 and not g.adjacent(a, path[-2]) and not g.adjacent(path[1], b):
                        for u, v in [*zip(path, path[1:], strict=False), (a, b)]:
                            g.set_mark(u, v, TAIL)
                            g.set_mark(v, u, TAIL)
                        changed = True
                        break
        for b in g.nodes:
            for a in g.adj(b):
                for c in [v for v in g.adj(b) if v != a and g.mark(v, b) == CIRCLE]:
                    if g.undirected(a, b):  # R6
                        changed |= put(c, b, TAIL)
                    elif g.mark(b, a) == TAIL and g.mark(a, b) == CIRCLE and not g.adjacent(a, c):  # R7
                        changed |= put(c, b, TAIL)
        for a in g.nodes:
            for c in [v for v in g.adj(a) if g.mark(a, v) == ARROW and g.mark(v, a) == CIRCLE]:
                if any((g.directed(a, b) or g.mark(b, a) == TAIL and g.mark(a, b) == CIRCLE) and g.directed(b, c) for b in g.adj(a) if b != c):  # R8
                    changed |= put(c, a, TAIL)
                    continue
                if any(len(p) > 3 and not g.adjacent(p[1], c) for b in g.adj(a) if b != c and can_point(a, b) and not g.adjacent(b, c) for p in open_paths(a, can_point, c, b)):  # R9
                    changed |= put(c, a, TAIL)
                    continue
                into = [b for b in g.adj(c) if b != a and g.directed(b, c)]
                starts = {b: {p[1] for p in [[a, b]] if g.adjacent(a, b) and can_point(a, b)} | {p[1] for p in open_paths(a, can_point, b)} for b in into}
                if any(u != v and not g.adjacent(u, v) for b, d in combinations(into, 2) for u in starts[b] for v in starts[d]):  # R10
                    changed |= put(c, a, TAIL)
    return g


def fci(test: Test, depth: int = -1, knowledge: Knowledge | None = None, rule: str = "sepset", complete: bool = True, possible: bool = True) -> Graph:
    """A partial ancestral graph, allowing latent common causes. possible=False leaves out the possible-d-sep step."""
    g, sepsets = skeleton(test, depth, knowledge)
    if possible:
        marked = g.copy().reorient(CIRCLE)
        orient_colliders(marked, test, sepsets, "sepset", knowledge, depth, CIRCLE)
        for a, b, _, _ in marked.edges():
            for x, y in ((a, b), (b, a)):
                near = [v for v in possible_d_sep(marked, x) if v != y and (not knowledge or knowledge.may_condition(v, x, y))]
                z = next((z for d in range(len(near) + 1 if depth < 0 else min(depth, len(near)) + 1) for z in _sets(near, d) if test.independent(x, y, z)), None)
                if z is not None and g.adjacent(x, y):
                    g.remove_edge(x, y)
                    sepsets[frozenset((x, y))] = z
                    break
    g.reorient(CIRCLE)
    _orient_knowledge(g, knowledge, CIRCLE)
    orient_colliders(g, test, sepsets, rule, knowledge, depth, CIRCLE)
    return fci_rules(g, sepsets, complete, knowledge)


def rfci(test: Test, depth: int = -1, knowledge: Knowledge | None = None) -> Graph:
    """FCI without the possible-d-sep step."""
    return fci(test, depth, knowledge, possible=False)


def cfci(test: Test, depth: int = -1, knowledge: Knowledge | None = None) -> Graph:
    return fci(test, depth, knowledge, "conservative")


def fci_max(test: Test, depth: int = -1, knowledge: Knowledge | None = None) -> Graph:
    return fci(test, depth, knowledge, "max_p")


def gfci(test: Test, score, depth: int = -1, knowledge: Knowledge | None = None, rule: str = "sepset") -> Graph:
    """Score-based skeleton, less what the test separates within triangles; colliders of either, then the rules of FCI.

    rule "max_p" takes colliders from the best separating sets instead.
    """
    first = fges(score, knowledge)
    g, sepsets = first.copy(), {}
    for a, b, _, _ in first.edges():
        if any(first.adjacent(a, c) and first.adjacent(b, c) for c in first.nodes):
            for x, y in ((a, b), (b, a)):
                near = [v for v in g.adj(x) if v != y]
                z = next((z for d in range(len(near) + 1 if depth < 0 else min(depth, len(near)) + 1) for z in _sets(near, d) if test.independent(x, y, z)), None)
                if z is not None and g.adjacent(x, y):
                    g.remove_edge(x, y)
                    sepsets[frozenset((x, y))] = z
    g.reorient(CIRCLE)
    _orient_knowledge(g, knowledge, CIRCLE)
    if rule == "max_p":
        orient_colliders(g, test, sepsets, rule, knowledge, depth, CIRCLE)
        return fci_rules(g, sepsets, True, knowledge)
    for a, b, c in g.unshielded():
        if first.adjacent(a, c):
            z = sepsets.get(frozenset((a, c)))
            collide = z is not None and b not in z
        else:
            collide = first.is_collider(a, b, c)
        if collide and _may_collide(g, a, b, c, knowledge, CIRCLE):
            _collide(g, a, b, c)
    return fci_rules(g, sepsets, True, knowledge)


def gfci_max(test: Test, score, depth: int = -1, knowledge: Knowledge | None = None) -> Graph:
    return gfci(test, score, depth, knowledge, "max_p")


def dag_to_pag(dag: Graph) -> Graph:
    """The partial ancestral graph of a DAG's measured nodes."""
    test = DSeparation(dag)
    g = Graph(test.variables)
    for a, b in combinations(test.variables, 2):
        if inducing_path(dag, a, b):
            g.add_edge(a, b, CIRCLE, CIRCLE)
    sepsets = {}
    for a, b in combinations(test.variables, 2):
        if not g.adjacent(a, b):
            sepsets[frozenset((a, b))] = tuple(v for v in test.variables if v in dag.ancestors([a, b]) - {a, b})
    orient_colliders(g, test, sepsets, free=CIRCLE)
    return fci_rules(g, sepsets)


# score-based


def fges(score, knowledge: Knowledge | None = None, max_degree: int = 100, min_gain: float = 0.0) -> Graph:
    """Greedy equivalence search: best insertions, then best deletions, each followed by a return to a pattern."""
    g = Graph(score.variables)
    at = {v: k for k, v in enumerate(g.nodes)}

    def allowed(x: str, y: str) -> bool:
        return not (knowledge and knowledge.forbidden(x, y))

    def naf(x: str, y: str) -> list[str]:
        return [v for v in g.adj(y) if g.undirected(v, y) and g.adjacent(v, x)]

    def clique(nodes) -> bool:
        return all(g.adjacent(a, b) for a, b in combinations(nodes, 2))

    def semi_path(start: str, goal: str, blocked: set[str]) -> bool:
        seen, todo = {start}, [start]
        while todo:
            v = todo.pop()
            for u in g.adj(v):
                if u not in seen and u not in blocked and g.mark(u, v) != ARROW:
                    if u == goal:
                        return True
                    seen.add(u)
                    todo.append(u)
        return False

    def subsets(items: list[str]):
        for d in range(len(items) + 1):
            yield from combinations(items, d)

    def best_insert(x: str, y: str):
        best, base = None, naf(x, y)
        free = [v for v in g.adj(y) if g.undirected(v, y) and not g.adjacent(v, x)]
        for t in subsets(free):
            s = {*base, *t}
            if not clique(s):
                continue
            parents = {*s, *g.parents(y)} - {x}
            if len(parents) + 1 > max_degree:
                continue
            gain = score.diff(x, y, parents)
            if gain > (best[0] if best else min_gain) and not semi_path(y, x, s):
                best = (gain, t)
        return best

    def best_delete(x: str, y: str):
        best, base = None, naf(x, y)
        for h in subsets(base):
            s = set(base) - set(h)
            if not clique(s):
                continue
            parents = (s | set(g.parents(y))) - {x}
            gain = -score.diff(x, y, parents)
            if gain > (best[0] if best else 0.0):
                best = (gain, h)
        return best

    def rebuild() -> None:
        nonlocal g
        g = cpdag(dag_from_pattern(g)) if not knowledge else meek(_with_knowledge(cpdag(dag_from_pattern(g)), knowledge), knowledge)

    # effects of single edges; a pair without gain alone may gain later, when its ends have neighbours
    while True:
        options = []
        for x in g.nodes:
            for y in g.nodes:
                if x != y and not g.adjacent(x, y) and allowed(x, y):
                    b = best_insert(x, y)
                    if b:
                        options.append((-b[0], at[x], at[y], b[1], x, y))
        if not options:
            break
        _, _, _, t, x, y = min(options)
        g.add_edge(x, y, TAIL, ARROW)
        for v in t:
            g.set_mark(v, y, ARROW)
            g.set_mark(y, v, TAIL)
        rebuild()
    while True:
        options = []
        for a, b, _, _ in g.edges():
            for x, y in ((a, b), (b, a)):
                if (g.directed(x, y) or g.undirected(x, y)) and not (knowledge and knowledge.required(x, y)):
                    d = best_delete(x, y)
                    if d:
                        options.append((-d[0], at[x], at[y], d[1], x, y))
        if not options:
            return g
        _, _, _, h, x, y = min(options)
        g.remove_edge(x, y)
        for v in h:
            g.set_mark(y, v, ARROW)
            g.set_mark(v, y, TAIL)
            if g.adjacent(x, v) and g.undirected(x, v):
                g.set_mark(x, v, ARROW)
                g.set_mark(v, x, TAIL)
        rebuild()


def _with_knowledge(g: Graph, knowledge: Knowledge) -> Graph:
    for a, b, _, _ in g.edges():
        for u, v in ((a, b), (b, a)):
            if g.undirected(u, v) and (knowledge.required(u, v) or knowledge.forbidden(v, u)):
                g.set_mark(u, v, ARROW)
    return g


# Markov blankets


def iamb(test: Test, target: str) -> list[str]:
    """Grow by the strongest remaining dependence, then shrink once."""
    mb: list[str] = []
    while True:
        rest = [v for v in test.variables if v != target and v not in mb]
        dependent = [(test.score(target, v, mb), -k, v) for k, v in enumerate(rest) if not test.independent(target, v, mb)]
        if not dependent:
            break
        mb.append(max(dependent)[2])
    for v in list(mb):
        if test.independent(target, v, [u for u in mb if u != v]):
            mb.remove(v)
    return sorted(mb, key=test.variables.index)


def grow_shrink(test: Test, target: str) -> list[str]:
    """Grow in order until nothing is dependent, then shrink to a fix-point."""
    mb: list[str] = []
    for phase in ("grow", "shrink"):
        changed = True
        while changed:
            changed = False
            for v in [u for u in test.variables if u != target and (u in mb) == (phase == "shrink")]:
                given = [u for u in mb if u != v]
                if test.independent(target, v, given) == (phase == "shrink"):
                    mb.remove(v) if phase == "shrink" else mb.append(v)
                    changed = True
    return sorted(mb, key=test.variables.index)


def mb_from_pattern(test: Test, target: str, depth: int = -1) -> list[str]:
    """Adjacent nodes of the target's pattern, and parents of its possible children."""
    g = pc(test, depth)
    near = set(g.adj(target))
    return sorted(near | {p for c in near if g.mark(target, c) == ARROW for p in g.parents(c)} - {target}, key=test.variables.index)


# non-Gaussian


def fast_ica(x: np.ndarray, seed: int = 0, steps: int = 500) -> np.ndarray:
    """Unmixing matrix of centred rows x (n, p), by symmetric fixed-point steps with tanh."""
    n, p = x.shape
    values, vectors = np.linalg.eigh(np.cov(x.T))
    white = vectors / np.sqrt(values)
    z = x @ white
    w = np.linalg.qr(np.random.default_rng(seed).normal(size=(p, p)))[0]
    for _ in range(steps):
        y = z @ w.T
        t = np.tanh(y)
        new = t.T @ z / n - (1 - t * t).mean(axis=0)[:, None] * w
        u, _, v = np.linalg.svd(new)
        new = u @ v
        done = np.abs(np.abs((new * w).sum(axis=1)) - 1).max() < 1e-9
        w = new
        if done:
            break
    return w @ white.T


def assignment(cost: np.ndarray) -> list[int]:
    """The row of each column in a pairing of least total cost, by shortest augmenting paths."""
    p = len(cost)
    row_of = [-1] * p
    row_price, col_price = np.zeros(p), np.zeros(p)
    for start in range(p):
        far, came, done = np.full(p, np.inf), [-1] * p, np.zeros(p, dtype=bool)
        row, reach, col = start, 0.0, -1
        while True:  # Dijkstra over columns until a free one
            step = reach + cost[row] - row_price[row] - col_price
            for j in np.flatnonzero(~done & (step < far - 1e-15)):
                far[j], came[j] = step[j], row
            col = int(np.argmin(np.where(done, np.inf, far)))
            reach = far[col]
            if row_of[col] < 0:
                break
            done[col], row = True, row_of[col]
        for j in np.flatnonzero(done):
            row_price[row_of[j]] += reach - far[j]
            col_price[j] -= reach - far[j]
        row_price[start] += reach
        while col >= 0:  # shift the path
            row = came[col]
            before = row_of.index(row) if row in row_of else -1
            row_of[col], col = row, before
            if row == start:
                break
    return row_of


def lingam(x: np.ndarray, names: list[str], threshold: float = 0.05, seed: int = 0) -> tuple[Graph, np.ndarray]:
    """(DAG, coefficients b[i, j] of j in i) of a linear non-Gaussian acyclic model of rows x."""
    p = len(names)
    w = fast_ica(x - x.mean(axis=0), seed)
    # rows to places, so that no diagonal entry is small
    place = assignment(1 / np.maximum(np.abs(w), 1e-12))
    w = w[place]
    b = np.eye(p) - w / np.diag(w)[:, None]
    left, order = list(range(p)), []
    while left:  # the row with the least dependence on those left is the next cause
        k = min(left, key=lambda i: sum(b[i, j] ** 2 for j in left if j != i))
        order.append(k)
        left.remove(k)
    coef = np.zeros((p, p))
    xc = x - x.mean(axis=0)
    for k, i in enumerate(order[1:], 1):
        coef[i, order[:k]] = np.linalg.lstsq(xc[:, order[:k]], xc[:, i], rcond=None)[0]
    g = Graph(names)
    for i in range(p):
        for j in range(p):
            if abs(coef[i, j]) > threshold:
                g.add_edge(names[j], names[i])
            else:
                coef[i, j] = 0.0
    return g, coef
