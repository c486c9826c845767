"""Searches that allow feedback: equivalence classes of directed cyclic graphs.

`ccd` follows Richardson's procedure for d-separation in linear systems in equilibrium. What it
returns is a `CyclicClass`: a graph with tails, arrows and circles, triples that are underlined
(the middle is a cause of one of the ends or of both) and triples that are underlined with dots
(an unshielded collider whose middle is no descendant of a common child of the ends).
`ccd_max` orients colliders by their best separating sets and marks pairs in feedback.

The rows of a table are read once, for sufficient statistics. The tests of unshielded triples,
which grow fastest with the number of variables, can be spread over Spark tasks.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import chain, combinations

import pyarrow as pa

from .graph import ARROW, CIRCLE, TAIL, Graph
from .independence import Test
from .knowledge import Knowledge
from .search import _triple_sets, orient_colliders, skeleton

Triple = tuple[str, frozenset]  # the middle and both ends


class CyclicSeparation(Test):
    """d-separation in a directed graph that may have cycles, two-cycles too: separation in the moral graph of ancestors."""

    def __init__(self, edges: Iterable[tuple[str, str]], variables: list[str]) -> None:
        self.variables, self.alpha = list(variables), 0.05
        self.into: dict[str, set[str]] = {v: set() for v in variables}
        for a, b in edges:
            self.into[b].add(a)

    def _above(self, targets: Iterable[str]) -> set[str]:
        out, todo = set(targets), list(targets)
        while todo:
            more = self.into[todo.pop()] - out
            out |= more
            todo += more
        return out

    def independent(self, x, y, z=()):
        above = self._above({x, y, *z})
        near: dict[str, set[str]] = {v: set() for v in above}
        for child in above:
            for a, b in combinations({child, *self.into[child]}, 2):
                near[a].add(b)
                near[b].add(a)
        reached, todo = {x, *z}, [x]
        while todo:
            more = near[todo.pop()] - reached
            reached |= more
            todo += more
        return y not in reached - set(z)

    def p_value(self, x, y, z=()):
        return 1.0 if self.independent(x, y, z) else 0.0


@dataclass
class CyclicClass:
    """A graph with its triples, and the pairs that cause each other (their edge is neither way in the graph)."""

    graph: Graph
    underlined: set[Triple] = field(default_factory=set)
    dotted: set[Triple] = field(default_factory=set)
    feedback: set[frozenset] = field(default_factory=set)

    def rows(self) -> list[tuple[str, str, str, str, str]]:
        """(kind, first, second, third, marks): edges, feedback both ways, and triples with the middle second."""
        at = {v: k for k, v in enumerate(self.graph.nodes)}
        order = lambda names: sorted(names, key=at.get)
        out = []
        for a, b, x, y in self.graph.edges():
            both = frozenset((a, b)) in self.feedback
            out += [("feedback", *order((a, b)), "", "")] if both else [("edge", a, b, "", f"{x}-{y}")]
        for kind, triples in (("underlined", self.underlined), ("dotted", self.dotted)):
            out += [(kind, order(ends)[0], b, order(ends)[1], "") for b, ends in triples]
        return sorted(out)

    def to_df(self, spark):
        return spark.createDataFrame(self.rows(), "kind string, first string, second string, third string, marks string")


def best_sets(test: Test, g: Graph, pairs: list[tuple[str, str]], depth: int = -1, spark=None) -> dict[frozenset, tuple]:
    """{pair: the best set among the neighbours of either end}.

    The best is the surest of the smallest sets that separate the pair, as two ends of a cycle
    may be separated by larger ones that hold a collider, too; without such a set that which
    comes nearest. With a session the pairs are shared out to tasks, which get the test and the adjacencies;
    one row a pair comes back.
    """

    def best(a: str, b: str) -> tuple:
        found = ((z, test.independent(a, b, z)) for z in _triple_sets(test, g, a, b, depth))
        return min(found, key=lambda f: (not f[1], len(f[0]) if f[1] else 0, test.score(a, b, f[0])), default=((), False))[0]

    if spark is None or not pairs:
        return {frozenset(p): best(*p) for p in pairs}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [list(best(x, y)) for x, y in zip(*(c.to_pylist() for c in b.columns), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.list_(pa.string()))], names=["a", "b", "z"])

    rows = spark.createDataFrame(pairs, "a string, b string").repartition(min(4 * spark.sparkContext.defaultParallelism, len(pairs)))
    return {frozenset((r["a"], r["b"])): tuple(r["z"]) for r in rows.mapInArrow(run, "a string, b string, z array<string>").collect()}


class _Search:
    """The state of one cyclic search: the graph in progress, its triples, and the sets that separate its pairs."""

    def __init__(self, test: Test, depth: int, knowledge: Knowledge | None, spark) -> None:
        self.test, self.knowledge = test, knowledge
        self.g, self.separating = skeleton(test, depth, knowledge)
        self.g.reorient(CIRCLE)
        self.underlined: set[Triple] = set()
        self.dotted: set[Triple] = set()
        self.wider: dict[Triple, set[str]] = {}  # sets with the middle of a dotted triple that separate its ends, too
        self.depth, self.spark = depth, spark
        self.away = True

    def point(self, a: str, b: str) -> None:
        self.g.set_mark(a, b, ARROW)
        self.g.set_mark(b, a, TAIL)

    def may_point(self, a: str, b: str) -> bool:
        return not (self.knowledge and (self.knowledge.forbidden(a, b) or self.knowledge.required(b, a)))

    def carry_on(self) -> None:
        """a *-> b with an underlined triple a, b, c and nothing known of b, c: b --> c."""
        todo = [(a, b) for a in self.g.nodes for b in self.g.adj(a) if self.g.mark(a, b) == ARROW] if self.away else []
        while todo:
            a, b = todo.pop()
            for c in self.g.adj(b):
                open_edge = self.g.mark(b, c) == CIRCLE and self.g.mark(c, b) == CIRCLE
                if c != a and open_edge and (b, frozenset((a, c))) in self.underlined and self.may_point(b, c):
                    self.point(b, c)
                    todo.append((b, c))

    def local(self, v: str) -> list[str]:
        """Neighbours, and nodes with which v has a common effect among its neighbours."""
        near = set(self.g.adj(v))
        near |= {u for b in self.g.adj(v) for u in self.g.adj(b) if u != v and self.g.is_collider(v, b, u)}
        return [u for u in self.g.nodes if u in near]

    # the steps of the procedure

    def colliders(self) -> None:
        triples = self.g.unshielded()
        best = best_sets(self.test, self.g, sorted({(a, c) for a, _, c in triples}), -1, self.spark)
        ranked = []
        for a, b, c in triples:
            z = best[frozenset((a, c))]
            if b in z:
                self.underlined.add((b, frozenset((a, c))))
            else:
                ranked.append((self.test.score(a, c, z), a, b, c))
        for _, a, b, c in sorted(ranked, key=lambda r: -r[0]):  # the surest come last, so that their marks stay
            if self.may_point(a, b) and self.may_point(c, b):
                self.point(a, b)
                self.point(c, b)

    def shielded_from_afar(self) -> None:
        """x <-- y where some node, adjacent to neither, is separated from y by a set without x that leaves it joined to x."""
        for x in self.g.nodes:
            for y in self.g.adj(x):
                if self.g.mark(y, x) != CIRCLE or self.g.mark(x, y) == ARROW or not self.may_point(y, x):
                    continue
                if any(self.g.mark(u, x) == ARROW and (x, frozenset((u, y))) in self.underlined for u in self.g.adj(x)):
                    continue
                for a in self.g.nodes:
                    if a in (x, y) or self.g.adjacent(a, x) or self.g.adjacent(a, y):
                        continue
                    z = self.separating.get(frozenset((a, y)))
                    if z is not None and x not in z and not self.test.independent(a, x, z):
                        self.point(y, x)
                        self.carry_on()
                        break

    def dots(self) -> None:
        near = {v: self.local(v) for v in self.g.nodes}
        for a, b, c in self.g.unshielded():
            z = self.separating.get(frozenset((a, c)))
            if z is None or not self.g.is_collider(a, b, c):
                continue
            for end, other in ((a, c), (c, a)):
                extra = [v for v in near[end] if v not in z and v not in (b, other)]
                sets = chain.from_iterable(combinations(extra, k) for k in range(len(extra) + 1))
                wider = next((w for w in ({*t, *z, b} for t in sets) if self.test.independent(a, c, tuple(v for v in self.g.nodes if v in w))), None)
                if wider is not None:
                    self.dotted.add((b, frozenset((a, c))))
                    self.wider[b, frozenset((a, c))] = wider
                    break

    def _sorted_dotted(self) -> list[tuple[str, str, str]]:
        at = {v: k for k, v in enumerate(self.g.nodes)}
        return sorted(((b, *sorted(ends, key=at.get)) for b, ends in self.dotted), key=lambda t: [at[v] for v in t])

    def beside_dots(self) -> None:
        """Edges from the middle of a dotted triple to what is adjacent to both ends: a tail there if the wider set has it, else an arrow."""
        for b, a, c in self._sorted_dotted():
            for d in self.g.adj(b):
                if self.g.mark(b, d) != CIRCLE or not (self.g.adjacent(a, d) and self.g.adjacent(c, d)):
                    continue
                if d in self.wider[b, frozenset((a, c))]:
                    self.g.set_mark(b, d, TAIL)
                elif self.g.mark(d, b) != ARROW and self.may_point(b, d):
                    self.point(b, d)
                    self.carry_on()

    def past_dots(self) -> None:
        """b --> d where d, not adjacent to both ends, joins them when it is added to the wider set."""
        for b, a, c in self._sorted_dotted():
            for d in self.g.adj(b):
                if d in (a, c) or self.g.mark(b, d) != CIRCLE or self.g.mark(d, b) == ARROW or not self.may_point(b, d):
                    continue
                if self.g.adjacent(a, d) and self.g.adjacent(c, d):
                    continue
                z = self.wider[b, frozenset((a, c))] | {d}
                if not self.test.independent(a, c, tuple(v for v in self.g.nodes if v in z)):
                    self.point(b, d)
                    self.carry_on()


def ccd(test: Test, depth: int = -1, knowledge: Knowledge | None = None, away: bool = False, spark=None) -> CyclicClass:
    """The class of directed graphs, cycles allowed, that have the independences of the test; no latent common causes.

    A tail at a says that a causes b in every graph of the class, an arrow at b that b does not
    cause a. away: unshielded triples whose middle is no collider carry an arrow on, which
    holds where their edges are on no cycle. spark: a session over which the tests of triples
    are spread (the test must be picklable).
    """
    s = _Search(test, depth, knowledge, spark)
    s.away = away
    s.colliders()
    s.shielded_from_afar()
    s.dots()
    s.beside_dots()
    s.past_dots()
    s.carry_on()
    return CyclicClass(s.g, s.underlined, s.dotted)


def ccd_max(
    test: Test, depth: int = -1, knowledge: Knowledge | None = None, feedback: bool = True, colliders: bool = True, away: bool = True, toward: bool = True
) -> CyclicClass:
    """A mixed graph with directed edges, undirected ones, and pairs in feedback.

    feedback: two nodes with two common neighbours that are not adjacent are in feedback if
    these are separated both by a set with neither and by a set with both. colliders: by the
    best separating set. away: no new collider behind an arrow. toward: what separates far
    nodes from one end of an edge and not from the other orients it.
    """
    g, separating = skeleton(test, depth, knowledge)
    out = CyclicClass(g)
    for a, b, _, _ in g.edges():
        for u, v in ((a, b), (b, a)):
            if knowledge and (knowledge.required(u, v) or knowledge.forbidden(v, u) and not knowledge.forbidden(u, v)):
                g.set_mark(u, v, ARROW)
                g.set_mark(v, u, TAIL)

    def free(a: str, b: str) -> bool:
        return g.undirected(a, b) and frozenset((a, b)) not in out.feedback

    def separated(a: str, b: str, with_: set[str], without: set[str]) -> bool:
        near = [v for v in g.nodes if v in (set(g.adj(a)) | set(g.adj(b))) - {a, b} - with_ - without]
        limit = len(near) if depth < 0 else min(depth, len(near))
        return any(test.independent(a, b, (*z, *sorted(with_))) for d in range(limit + 1) for z in combinations(near, d))

    def collide(a: str, b: str, c: str) -> None:
        ends = (a, c)
        if any(frozenset((e, b)) in out.feedback or knowledge and knowledge.forbidden(e, b) for e in ends):
            return
        if any(g.is_collider(e, b, u) for e in ends for u in g.adj(b) if u != e):
            return
        for e in ends:
            g.set_mark(e, b, ARROW)
            g.set_mark(b, e, TAIL)

    if feedback:
        for a, b in combinations(g.nodes, 2):
            if g.adjacent(a, b):
                continue
            common = [v for v in g.adj(a) if g.adjacent(v, b)]
            for c, d in combinations(common, 2):
                if not free(c, d) or any(g.directed(v, e) for v in (c, d) for e in (a, b)):
                    continue
                if separated(a, b, set(), {c, d}) and separated(a, b, {c, d}, set()):
                    collide(a, c, b)
                    collide(a, d, b)
                    out.feedback.add(frozenset((c, d)))

    def carry_on(todo: list[tuple[str, str]]) -> None:
        while away and todo:
            a, b = todo.pop()
            for c in g.adj(b):
                if c == a or not free(b, c) or g.adjacent(a, c) or knowledge and knowledge.forbidden(b, c):
                    continue
                if not any(g.mark(u, c) == ARROW for u in g.adj(c) if u != b and not g.adjacent(u, b)):
                    g.set_mark(b, c, ARROW)
                    todo.append((b, c))

    if colliders:
        marks = dict(g.marks)
        orient_colliders(g, test, separating, "max_p", knowledge, depth)
        for pair in out.feedback:  # these have no single direction
            a, b = tuple(pair)
            g.marks[a, b], g.marks[b, a] = marks[a, b], marks[b, a]
    carry_on([(a, b) for a in g.nodes for b in g.adj(a) if g.directed(a, b)])
    if not toward:
        return out
    for c, b in [(x, y) for x in g.nodes for y in g.adj(x)]:
        if not free(b, c) or knowledge and knowledge.forbidden(c, b):
            continue
        ring = {v for u in g.adj(b) for v in [u, *g.adj(u)]} - {b, c} - set(g.adj(b)) - set(g.adj(c))
        far = [v for v in g.nodes if v in ring]
        best = best_sets(test, g, [(a, v) for a in far for v in (b, c)], depth)
        sets = [(set(best[frozenset((a, b))]), set(best[frozenset((a, c))])) for a in far]
        nested = [x > y for x, y in sets if x != y]
        found = bool(nested) and all(nested)
        for a in far:
            x, y = (separating.get(frozenset((a, v))) for v in (b, c))
            if not found and x is not None and y is not None and b not in y and not set(x) <= set(y):
                found = not test.independent(a, b, y)
        if found:
            g.set_mark(c, b, ARROW)
            carry_on([(c, b)])
    return out
