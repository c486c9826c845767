"""Effects of interventions in graphs with hidden common causes, and manipulated models.

`identify` turns P(y | do(x)) into an expression of observed probabilities, by c-components, or
says that there is none. `effect` evaluates it as Spark joins: every term is a grouped sum of the
table of counts, every product a join on shared variables.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.suffstats import SuffStats
from ..plans.tables import written
from .graph import ARROW, Graph
from .models import SemFit, _times


class NotIdentified(ValueError):
    """No expression of observed probabilities gives the effect; `hedge` names the two sets that show it."""

    def __init__(self, whole: set[str], part: set[str]) -> None:
        super().__init__(f"the effect is not identified: {sorted(part)} within {sorted(whole)}")
        self.hedge = whole, part


@dataclass(frozen=True)
class Observed:
    """P(variables), from the rows."""

    over: frozenset[str]

    def __str__(self) -> str:
        return f"P({', '.join(sorted(self.over))})"


@dataclass(frozen=True)
class Sum:
    """A distribution with variables summed out."""

    of: object
    over: frozenset[str]
    gone: frozenset[str]

    def __str__(self) -> str:
        return f"sum[{', '.join(sorted(self.gone))}] {self.of}"


@dataclass(frozen=True)
class Ratio:
    """A distribution of one variable given others: a distribution over both, divided by its sum over the variable."""

    of: object
    over: frozenset[str]
    variable: str

    def __str__(self) -> str:
        given = ", ".join(sorted(self.over - {self.variable}))
        shown = f"P({self.variable} | {given})" if given else f"P({self.variable})"
        return shown if isinstance(self.of, Observed) else f"{shown} of [{self.of}]"


@dataclass(frozen=True)
class Product:
    terms: tuple
    over: frozenset[str]

    def __str__(self) -> str:
        return " * ".join(f"({t})" if isinstance(t, Sum) else str(t) for t in self.terms)


def _summed(e, keep: Iterable[str]):
    keep = frozenset(keep)
    gone = e.over - keep
    if not gone:
        return e
    return Observed(e.over & keep) if isinstance(e, Observed) else Sum(e, e.over & keep, gone)


def _given(e, variable: str, given: Iterable[str]):
    over = frozenset({variable, *given})
    return Ratio(_summed(e, over), over, variable)


@dataclass
class Mixed:
    """Measured nodes in an order of causes, their measured causes, and pairs with a hidden common cause."""

    order: list[str]
    into: dict[str, set[str]]
    joined: set[frozenset]

    def within(self, keep: set[str]) -> Mixed:
        return Mixed([v for v in self.order if v in keep], {v: self.into[v] & keep for v in keep}, {e for e in self.joined if e <= keep})

    def above(self, targets: set[str], cut: frozenset[str] | set[str] = frozenset()) -> set[str]:
        """Targets and their causes, without edges into what is cut."""
        out, todo = set(targets), list(targets)
        while todo:
            v = todo.pop()
            for u in (set() if v in cut else self.into[v]) - out:
                out.add(u)
                todo.append(u)
        return out

    def components(self) -> list[set[str]]:
        """Sets of nodes that hidden causes join."""
        left, out = set(self.order), []
        for v in self.order:
            if v in left:
                part, todo = {v}, [v]
                while todo:
                    u = todo.pop()
                    more = {w for e in self.joined if u in e for w in e} - part
                    part |= more
                    todo += more
                left -= part
                out.append(part)
        return out


def projected(graph: Graph) -> Mixed:
    """The graph over measured nodes: paths through hidden nodes become edges, hidden common causes joined pairs.

    Bidirected edges count as hidden causes, too.
    """
    seen = [v for v in graph.topological_order() if v not in graph.latent]
    if len(graph.topological_order()) < len(graph.nodes):
        raise ValueError("the graph has a cycle")

    def reached(v: str) -> set[str]:
        """Measured nodes that directed paths through hidden nodes reach."""
        out, todo, met = set(), [v], {v}
        while todo:
            for c in graph.children(todo.pop()):
                if c in graph.latent:
                    if c not in met:
                        met.add(c)
                        todo.append(c)
                else:
                    out.add(c)
        return out

    into: dict[str, set[str]] = {v: set() for v in seen}
    for v in seen:
        for c in reached(v):
            into[c].add(v)
    joined = set()
    for hidden in graph.latent:
        ends = sorted(reached(hidden))
        joined |= {frozenset((a, b)) for k, a in enumerate(ends) for b in ends[k + 1 :]}
    for (a, b), mark in graph.marks.items():
        if mark == ARROW and graph.marks[b, a] == ARROW and a not in graph.latent and b not in graph.latent:
            joined.add(frozenset((a, b)))
    return Mixed(seen, into, joined)


def _identify(y: frozenset[str], x: frozenset[str], e, g: Mixed):
    nodes = set(g.order)
    held = e.over - nodes  # variables outside the graph at hand that e depends on
    if not x:
        return _summed(e, y | held)
    causes = g.above(set(y))
    if causes != nodes:
        return _identify(y, x & causes, _summed(e, causes | held), g.within(causes))
    idle = nodes - x - g.above(set(y), x)
    if idle:
        return _identify(y, x | idle, e, g)
    parts = g.within(nodes - x).components()
    if len(parts) > 1:
        terms = tuple(_identify(frozenset(p), frozenset(nodes - p), e, g) for p in parts)
        # terms depend on what is set, too
        return _summed(Product(terms, frozenset().union(*(t.over for t in terms))), y | x | held)
    part = parts[0]
    whole = g.components()
    if len(whole) == 1:
        raise NotIdentified(nodes, part)

    def factors(members: set[str]) -> tuple:
        return tuple(_given(e, v, held.union(g.order[: g.order.index(v)])) for v in g.order if v in members)

    if part in whole:
        terms = factors(part)
        return _summed(Product(terms, frozenset().union(*(t.over for t in terms))), y | (nodes - part) | held)
    wide = next(c for c in whole if part < c)
    terms = factors(wide)
    return _identify(y, x & wide, Product(terms, frozenset().union(*(t.over for t in terms))), g.within(wide))


def identify(graph: Graph, outcome: Iterable[str], do: Iterable[str]):
    """P(outcome | do(...)) as an expression of observed probabilities; its variables may include those that are set."""
    g = projected(graph)
    y, x = frozenset(outcome), frozenset(do)
    if not (y | x) <= set(g.order) or y & x:
        raise ValueError("outcomes and what is set are different measured variables")
    return _identify(y, x, Observed(frozenset(g.order)), g)


def evaluated(e, cells: DataFrame) -> DataFrame:
    """(variables..., p) of an expression; cells has a row for each combination of values of all variables, with p."""
    if isinstance(e, Observed):
        return cells.groupBy(*sorted(e.over)).agg(F.sum("p").alias("p"))
    if isinstance(e, Sum):
        return evaluated(e.of, cells).groupBy(*sorted(e.over)).agg(F.sum("p").alias("p"))
    if isinstance(e, Product):
        return reduce(_times, (evaluated(t, cells) for t in e.terms))
    both = evaluated(e.of, cells)
    given = sorted(e.over - {e.variable})
    total = both.groupBy(*given).agg(F.sum("p").alias("total")) if given else both.agg(F.sum("p").alias("total"))
    joined = both.join(total, given) if given else both.crossJoin(total)  # one row
    return joined.select(*sorted(e.over), (F.col("p") / F.col("total")).alias("p"))


def effect(df: DataFrame, graph: Graph, outcome: list[str], do: dict[str, object]) -> DataFrame:
    """(outcome..., p): the distribution of the outcome when the variables of `do` are set, from rows of the measured ones.

    Values of other variables must occur with the set ones wherever the expression asks for it.
    """
    e = identify(graph, outcome, do)
    names = projected(graph).order
    counts = df.dropna(subset=names).groupBy(*names).agg(F.count("*").alias("n"))
    cells = written(counts.crossJoin(counts.agg(F.sum("n").alias("total"))).select(*names, (F.col("n") / F.col("total")).alias("p")))  # one row
    out = evaluated(e, cells)
    for v, value in do.items():
        if v in out.columns:
            out = out.where(F.col(v) == F.lit(value))
    extra = [c for c in out.columns if c not in (*outcome, *do, "p")]
    if not extra:
        return out.select(*outcome, "p")
    # any values of these serve; those of the rows are weighted by how often they occur
    weights = cells.groupBy(*extra).agg(F.sum("p").alias("weight"))
    return out.join(weights, extra).groupBy(*outcome).agg((F.sum(F.col("p") * F.col("weight")) / F.sum("weight")).alias("p"))


def manipulated(fit: SemFit, do: dict[str, float], means: dict[str, float] | None = None) -> SuffStats:
    """Means and covariances of a linear Gaussian model when variables are set: their own causes no longer count."""
    names = fit.graph.nodes
    at = {v: k for k, v in enumerate(names)}
    b, errors = np.zeros((len(names), len(names))), np.array([0.0 if v in do else fit.variances[v] for v in names])
    full = np.zeros_like(b)
    for (a, c), w in fit.edges.items():
        full[at[c], at[a]] = w
        if c not in do:
            b[at[c], at[a]] = w
    before = np.array([(means or {}).get(v, 0.0) for v in names])
    constant = before - full @ before
    for v, value in do.items():
        constant[at[v]] = value
    paths = np.linalg.inv(np.eye(len(names)) - b)
    return SuffStats(list(names), 0, paths @ np.diag(errors) @ paths.T, paths @ constant)
