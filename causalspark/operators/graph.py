"""Mixed graphs: endpoints, paths, separation, equivalence classes, orientation and comparison.

A graph of a search has as many nodes as a table has columns, so it lives in the driver; the
tables of its edges and the statistics of its recovery are DataFrames.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterable

TAIL, ARROW, CIRCLE = "-", ">", "o"
_LEFT = {TAIL: "-", ARROW: "<", CIRCLE: "o"}


class Graph:
    """Nodes in order and, for each adjacent pair, the mark at either end."""

    def __init__(self, nodes: Iterable[str] = (), latent: Iterable[str] = ()) -> None:
        self.nodes = list(nodes)
        self.latent = set(latent)
        self.marks: dict[tuple[str, str], str] = {}  # (a, b): mark at b of the edge a-b
        self.ambiguous: set[tuple[str, frozenset]] = set()
        self.underlines: set[tuple[str, frozenset]] = set()
        self._adj: dict[str, set[str]] = {v: set() for v in self.nodes}

    # building
    @classmethod
    def parse(cls, text: str) -> Graph:
        """From "X1-->X2,X2o->X3,Latent(L)-->X1"; a bare name is a node."""
        g = cls()
        for part in filter(None, (p.strip() for p in text.split(","))):
            m = re.fullmatch(r"(.+?)\s*([<o-])-([>o-])\s*(.+)", part)
            ends = [m[1], m[4]] if m else [part]
            names = []
            for e in ends:
                hidden = re.fullmatch(r"Latent\((.+)\)", e.strip())
                names.append(hidden[1] if hidden else e.strip())
                g.add_node(names[-1])
                if hidden:
                    g.latent.add(names[-1])
            if m:
                g.add_edge(names[0], names[1], {"<": ARROW, "o": CIRCLE, "-": TAIL}[m[2]], {">": ARROW, "o": CIRCLE, "-": TAIL}[m[3]])
        return g

    def copy(self) -> Graph:
        g = Graph(self.nodes, self.latent)
        g.marks = dict(self.marks)
        g.ambiguous, g.underlines = set(self.ambiguous), set(self.underlines)
        g._adj = {v: set(a) for v, a in self._adj.items()}
        return g

    def add_node(self, v: str) -> None:
        if v not in self._adj:
            self.nodes.append(v)
            self._adj[v] = set()

    def add_edge(self, a: str, b: str, at_a: str = TAIL, at_b: str = ARROW) -> None:
        self.add_node(a)
        self.add_node(b)
        self.marks[b, a], self.marks[a, b] = at_a, at_b
        self._adj[a].add(b)
        self._adj[b].add(a)

    def remove_edge(self, a: str, b: str) -> None:
        self.marks.pop((a, b), None)
        self.marks.pop((b, a), None)
        self._adj[a].discard(b)
        self._adj[b].discard(a)

    def set_mark(self, a: str, b: str, mark: str) -> None:
        """The mark at b of the edge a-b."""
        self.marks[a, b] = mark

    @classmethod
    def complete(cls, nodes: Iterable[str], mark: str = TAIL) -> Graph:
        g = cls(nodes)
        for a, b in itertools.combinations(g.nodes, 2):
            g.add_edge(a, b, mark, mark)
        return g

    def reorient(self, mark: str) -> Graph:
        for k in self.marks:
            self.marks[k] = mark
        return self

    # reading
    def adj(self, v: str) -> list[str]:
        a = self._adj[v]
        return [u for u in self.nodes if u in a] if len(a) * 4 > len(self.nodes) else sorted(a, key=self.nodes.index)

    def adjacent(self, a: str, b: str) -> bool:
        return b in self._adj[a]

    def mark(self, a: str, b: str) -> str | None:
        return self.marks.get((a, b))

    def directed(self, a: str, b: str) -> bool:
        return self.marks.get((a, b)) == ARROW and self.marks.get((b, a)) == TAIL

    def undirected(self, a: str, b: str) -> bool:
        return self.marks.get((a, b)) == TAIL and self.marks.get((b, a)) == TAIL

    def bidirected(self, a: str, b: str) -> bool:
        return self.marks.get((a, b)) == ARROW and self.marks.get((b, a)) == ARROW

    def parents(self, v: str) -> list[str]:
        return [u for u in self.adj(v) if self.directed(u, v)]

    def children(self, v: str) -> list[str]:
        return [u for u in self.adj(v) if self.directed(v, u)]

    def edges(self) -> list[tuple[str, str, str, str]]:
        """(a, b, mark at a, mark at b), each once; an arrow points to b where only one does."""
        at = {v: k for k, v in enumerate(self.nodes)}
        out = []
        for (a, b), m in self.marks.items():
            back = self.marks[b, a]
            first = at[a] < at[b] if (m == ARROW) == (back == ARROW) else m == ARROW
            if first:
                out.append((a, b, back, m))
        return sorted(out, key=lambda e: (at[e[0]], at[e[1]]))

    def edge_text(self) -> list[str]:
        return [f"{a} {_LEFT[x]}-{y} {b}" for a, b, x, y in self.edges()]

    def __str__(self) -> str:
        return ",".join(t.replace(" ", "") for t in self.edge_text())

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Graph) and set(self.nodes) == set(other.nodes) and self.marks == other.marks

    __hash__ = None

    def to_df(self, spark):
        return spark.createDataFrame(self.edges(), "src string, dst string, ep_src string, ep_dst string")

    # paths
    def ancestors(self, targets: Iterable[str]) -> set[str]:
        """Nodes with a directed path to a target, targets included."""
        out = set(targets)
        todo = list(out)
        while todo:
            v = todo.pop()
            for u in self._adj[v]:
                if u not in out and self.directed(u, v):
                    out.add(u)
                    todo.append(u)
        return out

    def descendants(self, sources: Iterable[str]) -> set[str]:
        out = set(sources)
        todo = list(out)
        while todo:
            v = todo.pop()
            for u in self._adj[v]:
                if u not in out and self.directed(v, u):
                    out.add(u)
                    todo.append(u)
        return out

    def has_directed_cycle(self) -> bool:
        return len(self.topological_order()) < len(self.nodes)

    def topological_order(self) -> list[str]:
        """Nodes with causes first; those on or behind a cycle are left out."""
        waits = {v: len(self.parents(v)) for v in self.nodes}
        ready = [v for v in self.nodes if not waits[v]]
        out = []
        while ready:
            v = ready.pop(0)
            out.append(v)
            for u in self.children(v):
                waits[u] -= 1
                if not waits[u]:
                    ready.append(u)
        return out

    def connected_components(self) -> list[set[str]]:
        left, out = set(self.nodes), []
        for v in self.nodes:
            if v in left:
                part, todo = {v}, [v]
                while todo:
                    for u in self._adj[todo.pop()] - part:
                        part.add(u)
                        todo.append(u)
                left -= part
                out.append(part)
        return out

    def d_connected(self, x: str, z: Iterable[str]) -> set[str]:
        """Nodes that some path from x reaches given z; marks of arrows at both ends collide."""
        z = set(z)
        above = self.ancestors(z)
        seen, out = set(), {x}
        todo = [(x, u) for u in self._adj[x]]
        while todo:
            a, b = step = todo.pop()
            if step in seen:
                continue
            seen.add(step)
            out.add(b)
            for c in self._adj[b]:
                if c == a:
                    continue
                collider = self.marks[a, b] == ARROW and self.marks[c, b] == ARROW
                if b in above if collider else b not in z:
                    todo.append((b, c))
        return out

    def d_separated(self, x: str, y: str, z: Iterable[str] = ()) -> bool:
        return y not in self.d_connected(x, z)

    def markov_blanket(self, v: str) -> set[str]:
        kids = self.children(v)
        return (set(self.parents(v)) | set(kids) | {p for c in kids for p in self.parents(c)}) - {v}

    def unshielded(self) -> list[tuple[str, str, str]]:
        return [(a, b, c) for b in self.nodes for a, c in itertools.combinations(self.adj(b), 2) if not self.adjacent(a, c)]

    def is_collider(self, a: str, b: str, c: str) -> bool:
        return self.marks.get((a, b)) == ARROW and self.marks.get((c, b)) == ARROW

    def moral(self) -> Graph:
        g = Graph(self.nodes)
        for a, b, _, _ in self.edges():
            g.add_edge(a, b, TAIL, TAIL)
        for v in self.nodes:
            for a, b in itertools.combinations(self.parents(v), 2):
                g.add_edge(a, b, TAIL, TAIL)
        return g

    def subgraph(self, nodes: Iterable[str]) -> Graph:
        keep = set(nodes)
        g = Graph([v for v in self.nodes if v in keep], self.latent & keep)
        for a, b, x, y in self.edges():
            if a in keep and b in keep:
                g.add_edge(a, b, x, y)
        return g


# equivalence classes


def meek(g: Graph, knowledge=None) -> Graph:
    """Orient what colliders and acyclicity imply: Meek's four rules to the fix-point, in place."""

    def point(a: str, b: str) -> bool:
        if knowledge is not None and (knowledge.forbidden(a, b) or knowledge.required(b, a)):
            return False
        g.set_mark(a, b, ARROW)
        return True

    def unclear(a: str, b: str, c: str) -> bool:
        return (b, frozenset((a, c))) in g.ambiguous

    changed = True
    while changed:
        changed = False
        for a in g.nodes:
            for b in g.adj(a):
                if not g.undirected(a, b):
                    continue
                into = [c for c in g.adj(a) if c != b and g.directed(c, a)]
                rule = any(not g.adjacent(c, b) and not unclear(c, a, b) for c in into)  # away from a collider
                rule = rule or any(g.directed(c, b) for c in g.children(a))  # away from a cycle
                if not rule:
                    sides = [c for c in g.adj(a) if g.undirected(a, c) and g.directed(c, b)]
                    rule = any(not g.adjacent(c, d) and not unclear(c, a, d) for c, d in itertools.combinations(sides, 2))
                if not rule and knowledge is not None:
                    rule = any(
                        g.undirected(a, d) and not g.adjacent(c, b) and g.directed(d, b) and g.directed(c, d)
                        for c in g.adj(a) if g.undirected(a, c) for d in g.adj(a) if d not in (b, c)
                    )
                if rule and point(a, b):
                    changed = True
    return g


def cpdag(dag: Graph) -> Graph:
    """The pattern of a DAG: its skeleton, its unshielded colliders, and what they imply."""
    g = Graph(dag.nodes)
    for a, b, _, _ in dag.edges():
        g.add_edge(a, b, TAIL, TAIL)
    for a, b, c in dag.unshielded():
        if dag.is_collider(a, b, c):
            g.set_mark(a, b, ARROW)
            g.set_mark(c, b, ARROW)
    return meek(g)


def dag_from_pattern(pattern: Graph) -> Graph:
    """A DAG of the class, after Dor and Tarsi: remove sinks whose neighbours form a clique."""
    out, left = pattern.copy(), pattern.copy()
    todo = set(left.nodes)
    while todo:
        for v in [v for v in left.nodes if v in todo]:
            adj = [u for u in left.adj(v) if u in todo]
            if any(left.directed(v, u) for u in adj):
                continue
            near = [u for u in adj if left.undirected(v, u)]
            if all(left.adjacent(u, w) for u in near for w in adj if u != w):
                for u in near:
                    out.set_mark(u, v, ARROW)
                    out.set_mark(v, u, TAIL)
                todo.discard(v)
                break
        else:
            raise ValueError("the pattern has no DAG in its class")
    return out


def inducing_path(dag: Graph, a: str, b: str) -> bool:
    """Whether a path joins a and b on which every measured inner node is a collider and every collider an ancestor of an end."""
    above = dag.ancestors([a, b])
    seen: set = set()
    todo = [(a, u) for u in dag._adj[a]]
    while todo:
        p, v = step = todo.pop()
        if v == b:
            return True
        if step in seen or v == a:
            continue
        seen.add(step)
        for w in dag._adj[v]:
            if w == p:
                continue
            collider = dag.marks[p, v] == ARROW and dag.marks[w, v] == ARROW
            if (collider and v in above) or (not collider and v in dag.latent):
                todo.append((v, w))
    return False


def random_dag(nodes: int | list[str], edges: int, seed: int = 0, max_degree: int = 10**9) -> Graph:
    """A DAG with this many random forward edges (fewer if degrees forbid)."""
    import random

    names = [f"X{k + 1}" for k in range(nodes)] if isinstance(nodes, int) else list(nodes)
    g, r = Graph(names), random.Random(seed)
    pairs = list(itertools.combinations(names, 2))
    r.shuffle(pairs)
    for a, b in pairs:
        if edges <= 0:
            break
        if len(g._adj[a]) < max_degree and len(g._adj[b]) < max_degree:
            g.add_edge(a, b)
            edges -= 1
    return g


# text forms


def to_text(g: Graph) -> str:
    lines = ["Graph Nodes:", ";".join(g.nodes), "", "Graph Edges:"]
    return "\n".join(lines + [f"{k}. {t}" for k, t in enumerate(g.edge_text(), 1)]) + "\n"


def from_text(text: str) -> Graph:
    nodes, edges = re.split(r"Graph Edges:", text)
    g = Graph([v for v in re.split(r"[;,\s]+", nodes.split(":", 1)[1].strip()) if v])
    marks = {"<": ARROW, ">": ARROW, "o": CIRCLE, "-": TAIL}
    for m in re.finditer(r"^\s*\d+\.\s+(\S+)\s+([<o-])-([>o-])\s+(\S+)", edges, re.M):
        g.add_edge(m[1], m[4], marks[m[2]], marks[m[3]])
    return g


def to_dot(g: Graph) -> str:
    head = {TAIL: "none", ARROW: "normal", CIRCLE: "odot"}
    rows = [f' "{a}" -> "{b}" [dir=both, arrowtail={head[x]}, arrowhead={head[y]}];' for a, b, x, y in g.edges()]
    return "digraph g {\n" + "\n".join(rows) + "\n}\n"


def to_json(g: Graph) -> str:
    import json

    return json.dumps({"nodes": [{"name": v, "latent": v in g.latent} for v in g.nodes], "edges": [dict(zip(("node1", "node2", "endpoint1", "endpoint2"), e, strict=True)) for e in g.edges()]})


def from_json(text: str) -> Graph:
    import json

    d = json.loads(text)
    g = Graph([v["name"] for v in d["nodes"]], [v["name"] for v in d["nodes"] if v["latent"]])
    for e in d["edges"]:
        g.add_edge(e["node1"], e["node2"], e["endpoint1"], e["endpoint2"])
    return g


def to_matrix(g: Graph) -> list[list[int]]:
    """Cell (i, j): the mark at j of the edge i-j; 0 none, 1 circle, 2 arrow, 3 tail."""
    code = {None: 0, CIRCLE: 1, ARROW: 2, TAIL: 3}
    return [[code[g.mark(a, b)] for b in g.nodes] for a in g.nodes]


def to_xml(g: Graph) -> str:
    from xml.sax.saxutils import escape

    rows = [f"<variable>{escape(v)}</variable>" for v in g.nodes] + [f"<edge>{escape(t)}</edge>" for t in g.edge_text()]
    return "<graph>" + "".join(rows) + "</graph>"


# comparison


def shd(est: Graph, truth: Graph) -> int:
    """Structural distance: a missing or extra edge costs 1 (undirected) or 2 (directed), a wrong direction 1."""
    cost = 0
    for a, b in itertools.combinations(sorted(set(est.nodes) | set(truth.nodes)), 2):
        e, t = (a in g._adj and b in g._adj and g.adjacent(a, b) for g in (est, truth))
        if e != t:
            cost += 1 if (est if e else truth).undirected(a, b) else 2
        elif e and (est.mark(a, b), est.mark(b, a)) != (truth.mark(a, b), truth.mark(b, a)):
            cost += 1
    return cost


def adjacency_confusion(est: Graph, truth: Graph) -> dict[str, int]:
    pairs = lambda g: {frozenset(e[:2]) for e in g.edges()}
    e, t = pairs(est), pairs(truth)
    p = len(truth.nodes)
    return {"tp": len(e & t), "fp": len(e - t), "fn": len(t - e), "tn": p * (p - 1) // 2 - len(e | t)}


def arrow_confusion(est: Graph, truth: Graph) -> dict[str, int]:
    arrows = lambda g: {k for k, m in g.marks.items() if m == ARROW}
    e, t = arrows(est), arrows(truth)
    p = len(truth.nodes)
    return {"tp": len(e & t), "fp": len(e - t), "fn": len(t - e), "tn": p * (p - 1) - len(e | t)}


def recovery(est: Graph, truth: Graph) -> dict[str, float]:
    """Precision, recall, F1 and Matthews correlation of adjacencies and arrowheads, and the structural distance."""
    out: dict[str, float] = {"shd": float(shd(est, truth))}
    for name, c in (("adj", adjacency_confusion(est, truth)), ("arrow", arrow_confusion(est, truth))):
        tp, fp, fn, tn = (c[k] for k in ("tp", "fp", "fn", "tn"))
        ratio = lambda a, b: a / b if b else float("nan")
        out |= {f"{name}_precision": ratio(tp, tp + fp), f"{name}_recall": ratio(tp, tp + fn), f"{name}_f1": ratio(2 * tp, 2 * tp + fp + fn)}
        out[f"{name}_mcc"] = ratio(tp * tn - fp * fn, ((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)) ** 0.5)
    return out
