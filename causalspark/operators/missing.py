"""Bayesian networks from discrete tables with missing cells and hidden variables.

Equal rows are counted once and stay distributed. A round is one pass over these counts: for
each pattern of missing cells a task lists the completions, weighs them by the present network
and sums expected counts of the families that are asked for. Arrays of the size of these
families come back, merged in the executors.

`fit_tables` estimates probabilities of a known graph; `structural_em` also looks for the graph,
by a search over patterns whose scores come from the expected counts of whole sets of families,
gathered in one pass.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.special import log_gamma
from ..plans.suffstats import merged_sums
from ..plans.tables import fresh, written
from .graph import Graph, dag_from_pattern
from .models import BayesNet
from .scores import Score
from .search import fges

#: Completions of rows that a task weighs at once.
CELLS = 1 << 20
Family = tuple[str, ...]  # parents in order, then the node


@dataclass
class Network:
    """A DAG, the values of its variables in order, and an array (parents..., node) of probabilities for each node."""

    dag: Graph
    values: dict[str, list]
    tables: dict[str, np.ndarray]
    log_likelihood: float = float("nan")
    converged: bool = True
    rounds: int = 0
    history: list[str] = field(default_factory=list)

    def family(self, v: str) -> Family:
        return (*self.dag.parents(v), v)

    def bayes_net(self, spark) -> BayesNet:
        """The same with tables as DataFrames."""
        out = {}
        for v in self.dag.nodes:
            family = self.family(v)
            rows = [(*(self.values[c][k] for c, k in zip(family, at, strict=True)), float(p)) for at, p in np.ndenumerate(self.tables[v])]
            out[v] = spark.createDataFrame(rows, [*family, "p"])
        return BayesNet(self.dag, out)

    def to_df(self, spark) -> DataFrame:
        """(node, given, value, p), where given is parent=value, ... in the order of parents."""
        rows = []
        for v in self.dag.nodes:
            *parents, _ = self.family(v)
            for at, p in np.ndenumerate(self.tables[v]):
                given = ", ".join(f"{c}={self.values[c][k]}" for c, k in zip(parents, at[:-1], strict=True))
                rows.append((v, given, str(self.values[v][at[-1]]), float(p)))
        return spark.createDataFrame(rows, "node string, given string, value string, p double")


@dataclass
class CountedRows:
    """Distinct rows as codes (-1 for a missing cell, and for all cells of a hidden variable) with how often each occurs."""

    table: DataFrame
    count: str
    variables: list[str]
    values: dict[str, list]


def counted_rows(df: DataFrame, variables: list[str], hidden: dict[str, list] | None = None) -> CountedRows:
    """The distinct rows of the variables, written once. hidden: values of variables that have no column."""
    hidden = hidden or {}
    seen = [v for v in variables if v not in hidden]
    lists = df.agg(*[F.sort_array(F.collect_set(c)).alias(c) for c in seen]).first()  # as many as a variable has values
    values = {v: list(hidden[v]) if v in hidden else list(lists[v]) for v in variables}
    code = lambda v: F.coalesce(F.array_position(F.array(*map(F.lit, values[v])), F.col(v)).cast("int") - 1, F.lit(-1)) if values[v] else F.lit(-1)
    n = fresh(df, "n")
    rows = df.select(*[code(v).alias(v) for v in seen]).groupBy(*seen).agg(F.count("*").alias(n))
    for v in hidden:
        rows = rows.withColumn(v, F.lit(-1))
    return CountedRows(written(rows.select(*variables, n)), n, list(variables), values)


def _weighed(codes: np.ndarray, n: np.ndarray, tables: list[tuple[tuple[int, ...], np.ndarray]], families: list[tuple[int, ...]], cards: list[int]) -> tuple[list[np.ndarray], float]:
    """(expected counts of each family, log-likelihood) of rows with one pattern of missing cells."""
    missing = np.flatnonzero(codes[0] < 0).tolist()
    shape = [cards[k] for k in missing]
    many = math.prod(shape)
    out, like = [np.zeros(math.prod(cards[k] for k in f)) for f in families], 0.0
    step, piece = max(CELLS // many, 1), min(many, CELLS)

    def columns(rows: np.ndarray, at: int) -> dict[int, np.ndarray]:
        """Codes of each variable, rows x completions."""
        grid = np.unravel_index(np.arange(at, min(at + piece, many)), shape) if missing else ()
        held = {k: rows[:, k][:, None] for k in range(codes.shape[1])}
        return held | {k: g[None, :] for k, g in zip(missing, grid, strict=True)}

    def joint(held: dict[int, np.ndarray]) -> np.ndarray:
        return reduce(np.multiply, (t[tuple(held[k] for k in f)] for f, t in tables))

    for first in range(0, len(codes), step):
        rows, times = codes[first : first + step], n[first : first + step]
        total = sum(joint(columns(rows, at)).sum(axis=1) for at in range(0, many, piece))
        total = np.broadcast_to(total, len(rows))
        possible = total > 0
        like += float((times[possible] * np.log(total[possible])).sum()) if possible.all() else -math.inf
        for at in range(0, many, piece):
            held = columns(rows, at)
            weight = joint(held) * np.where(possible, times / np.where(possible, total, 1.0), 0.0)[:, None]
            for counts, f in zip(out, families, strict=True):
                place = np.ravel_multi_index(np.broadcast_arrays(*(held[k] for k in f)), [cards[k] for k in f])
                if place.shape != weight.shape:
                    some = weight.sum(axis=1, keepdims=True) if place.shape[1] == 1 else weight
                    place = np.broadcast_to(place, some.shape)
                else:
                    some = weight
                counts += np.bincount(place.ravel(), weights=some.ravel(), minlength=len(counts))
    return out, like


def expected_counts(data: CountedRows, net: Network, families: list[Family]) -> tuple[dict[Family, np.ndarray], float]:
    """({family: expected counts}, log-likelihood of the rows) under the network; one pass."""
    at = {v: k for k, v in enumerate(data.variables)}
    cards = [len(data.values[v]) for v in data.variables]
    tables = [(tuple(at[c] for c in net.family(v)), net.tables[v]) for v in net.dag.nodes]
    wanted = [tuple(at[c] for c in f) for f in families]
    sizes = [math.prod(cards[k] for k in f) for f in wanted]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, like = np.zeros(sum(sizes)), 0.0
        for b in batches:
            if not b.num_rows:
                continue
            codes = np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns[:-1]], axis=1)
            n = b.column(b.num_columns - 1).to_numpy().astype(np.float64)
            _, pattern = np.unique(codes < 0, axis=0, return_inverse=True)
            for k in range(int(pattern.max()) + 1):
                rows = pattern.ravel() == k
                counts, part = _weighed(codes[rows], n[rows], tables, wanted, cards)
                total += np.concatenate(counts)
                like += part
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary()), pa.array([like])], names=["total", "like"])

    r = next(iter(merged_sums(data.table.mapInArrow(run, "total binary, like double"))), None)
    flat, like = (np.frombuffer(r["total"]), r["like"]) if r else (np.zeros(sum(sizes)), 0.0)
    parts = np.split(flat, np.cumsum(sizes)[:-1])
    return {f: p.reshape([cards[k] for k in w]) for f, w, p in zip(families, wanted, parts, strict=True)}, like


def _shares(counts: np.ndarray, prior: float) -> np.ndarray:
    """Probabilities of the last axis; even ones where there is nothing to go by."""
    full = counts + prior
    total = full.sum(axis=-1, keepdims=True)
    return np.where(total > 0, full / np.where(total > 0, total, 1.0), 1.0 / counts.shape[-1])


def starting_network(data: CountedRows, dag: Graph, seed: int = 0) -> Network:
    """Nearly even tables that differ by seeded draws, so that hidden values are told apart."""
    r, tables = np.random.default_rng(seed), {}
    for v in dag.nodes:
        shape = [len(data.values[c]) for c in (*dag.parents(v), v)]
        tables[v] = _shares(1.0 + 0.3 * r.random(shape), 0.0)
    return Network(dag, data.values, tables)


def fit_tables(data: CountedRows, dag: Graph, start: Network | None = None, prior: float = 0.0, tolerance: float = 1e-6, rounds: int = 500) -> Network:
    """Expectation-maximisation for a known graph, until the log-likelihood gains less than tolerance times its size.

    `converged` of the result tells whether it did within so many rounds. A prior adds so much to
    each expected count.
    """
    net, before = start or starting_network(data, dag), -math.inf
    families = [net.family(v) for v in dag.nodes]
    for k in range(rounds):
        counts, like = expected_counts(data, net, families)
        net = Network(dag, data.values, {f[-1]: _shares(counts[f], prior) for f in families}, like, False, k + 1)
        if like - before <= tolerance * abs(like):
            net.converged = True
            break
        before = like
    return net


def family_score(counts: np.ndarray, sample: float) -> float:
    """Dirichlet marginal likelihood of (expected) counts, an even prior of so many rows in all."""
    rows = counts.reshape(-1, counts.shape[-1])
    cell, row = sample / rows.size, sample / len(rows)
    n = rows.sum(axis=1)
    return float((log_gamma(np.array(row)) - log_gamma(row + n)).sum() + (log_gamma(cell + rows) - log_gamma(np.array(cell))).sum())


class ExpectedScore(Score):
    """Marginal likelihoods of families from expected counts under a network.

    All families of two parents or fewer are counted in one pass; where a search asks for a
    larger one, one more pass counts those that add any variable to the same parents but one.
    """

    def __init__(self, data: CountedRows, net: Network, sample: float = 1.0) -> None:
        super().__init__()
        self.data, self.net, self.sample, self.variables = data, net, sample, data.variables
        self.found: dict[Family, np.ndarray] = {}
        self.count([(*p, v) for v in self.variables for k in range(3) for p in combinations(sorted(set(self.variables) - {v}), k)])

    def count(self, families: list[Family]) -> None:
        self.found |= expected_counts(self.data, self.net, [f for f in families if f not in self.found])[0]

    def _local(self, y, parents):
        if (*parents, y) not in self.found:
            self.count([(*sorted({*parents[:-1], u}), y) for u in self.variables if u != y and u not in parents[:-1]])
        return family_score(self.found[*parents, y], self.sample)


def structural_em(
    data: CountedRows, start: Graph | None = None, sample: float = 1.0, find: Callable[[Score], Graph] = fges, tolerance: float = 1e-5, rounds: int = 20, seed: int = 0
) -> Network:
    """A DAG and its tables from rows with missing cells.

    A round fits the tables of the present graph and then searches a pattern with the counts that
    these lead to expect. It ends where the pattern stays; `converged` tells whether that was
    within so many rounds. `history` has the patterns found. Hidden variables need a start graph
    that joins them to others.
    """
    dag, history = start.copy() if start is not None else Graph(data.variables), []
    net = fit_tables(data, dag, starting_network(data, dag, seed), tolerance=tolerance)
    for k in range(rounds):
        pattern = find(ExpectedScore(data, net, sample))
        settled = bool(history) and history[-1] == str(pattern)
        history.append(str(pattern))
        if not settled:
            dag = dag_from_pattern(pattern)
            net = fit_tables(data, dag, starting_network(data, dag, seed), tolerance=tolerance)
        net.converged, net.rounds, net.history = settled, k + 1, history
        if settled:
            break
    return net
