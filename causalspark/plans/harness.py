"""Comparison of searches: algorithms x parameters x simulated data sets, fanned out as rows.

Each row names a configuration and a seed; a task simulates, searches and returns statistics
of recovery, so that the driver sees the table of results only.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import search as S
from ..operators.graph import Graph, cpdag, random_dag, recovery
from ..operators.independence import FisherZ
from ..operators.scores import SemBic
from .suffstats import SuffStats

ALGORITHMS = {
    "pc": lambda s, p: S.pc(FisherZ(s, p.get("alpha", 0.01)), p.get("depth", -1), stable=False),
    "pc_stable": lambda s, p: S.pc(FisherZ(s, p.get("alpha", 0.01)), p.get("depth", -1)),
    "cpc": lambda s, p: S.cpc(FisherZ(s, p.get("alpha", 0.01)), p.get("depth", -1)),
    "pc_max": lambda s, p: S.pc_max(FisherZ(s, p.get("alpha", 0.01)), p.get("depth", -1)),
    "fges": lambda s, p: S.fges(SemBic(s, p.get("penalty", 1.0))),
    "fci": lambda s, p: S.fci(FisherZ(s, p.get("alpha", 0.01)), p.get("depth", -1)),
    "gfci": lambda s, p: S.gfci(FisherZ(s, p.get("alpha", 0.01)), SemBic(s, p.get("penalty", 1.0))),
}
#: Statistics that count against an algorithm in the utility.
COSTS = ("shd", "seconds")


def simulate(dag: Graph, n: int, seed: int) -> SuffStats:
    """Statistics of n rows of a random linear Gaussian model."""
    r = np.random.default_rng(seed)
    order = dag.topological_order()
    x: dict[str, np.ndarray] = {}
    for v in order:
        x[v] = r.normal(size=n) * r.uniform(0.8, 1.2) + sum((x[p] * r.uniform(0.5, 1.5) * r.choice([-1, 1]) for p in dag.parents(v)), np.zeros(n))
    data = np.stack([x[v] for v in dag.nodes], axis=1)
    return SuffStats(list(dag.nodes), n, np.cov(data.T), data.mean(axis=0))


def compare(spark: SparkSession, algorithms: dict[str, dict[str, list]], simulations: dict[str, list], runs: int = 10, seed: int = 0) -> DataFrame:
    """(algorithm, parameters, simulation, run, statistic, value) of every configuration."""
    expand = lambda d: [dict(zip(d, v, strict=True)) for v in product(*d.values())]
    rows = [
        (a, json.dumps(p, sort_keys=True), json.dumps(m, sort_keys=True), r)
        for a, grid in algorithms.items() for p in expand(grid) for m in expand(simulations) for r in range(runs)
    ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for a, p, m, r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                spec = json.loads(m)
                dag = random_dag(spec.get("nodes", 10), spec.get("edges", 10), seed * 100_003 + r)
                stats = simulate(dag, spec.get("n", 1000), seed * 7 + r)
                began = time.perf_counter()
                est = ALGORITHMS[a](stats, json.loads(p))
                took = time.perf_counter() - began
                truth = S.dag_to_pag(dag) if a in ("fci", "gfci") else cpdag(dag)
                out += [(a, p, m, r, k, float(v)) for k, v in (recovery(est, truth) | {"seconds": took}).items()]
            cols = list(zip(*out, strict=True)) or [[]] * 6
            kinds = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["algorithm", "parameters", "simulation", "run", "statistic", "value"])

    todo = spark.createDataFrame(rows, "algorithm string, parameters string, simulation string, run int")
    return todo.repartition(min(len(rows), spark.sparkContext.defaultParallelism * 4)).mapInArrow(run, "algorithm string, parameters string, simulation string, run int, statistic string, value double")


def averages(results: DataFrame) -> DataFrame:
    """Mean, deviation and worst value of each statistic."""
    v = F.when(~F.isnan("value"), F.col("value"))
    worst = F.when(F.first("statistic").isin(*COSTS), F.max(v)).otherwise(F.min(v))
    return results.groupBy("algorithm", "parameters", "simulation", "statistic").agg(F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"), worst.alias("worst"))


def utilities(results: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Weighted mean of normed statistics: costs become 1 / (1 + cost)."""
    mean = averages(results).where(F.col("statistic").isin(*weights))
    norm = F.when(F.col("statistic").isin(*COSTS), 1 / (1 + F.col("mean"))).otherwise(F.col("mean"))
    w = F.element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]), F.col("statistic"))
    return mean.groupBy("algorithm", "parameters", "simulation").agg((F.sum(w * norm) / len(weights)).alias("utility"))
