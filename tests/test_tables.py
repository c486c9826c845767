"""Graph tables, readers and transforms on awkward inputs."""

import numpy as np

from causalspark.operators import graph_tables as gt
from causalspark.operators import transforms as tr
from causalspark.operators import statistics as st
from causalspark.operators.statistics import moments
from causalspark.plans.suffstats import grouped_stats, sufficient_stats
from causalspark.sources.tabular import infer_types, read_table


def test_closure_of_a_long_path_a_ladder_and_a_cycle(spark):
    path = spark.createDataFrame([(k, k + 1) for k in range(500)], "src long, dst long")
    assert gt.closure(path).count() == 500 * 501 // 2
    ladder = spark.createDataFrame([(2 * k + a, 2 * k + 2 + b) for k in range(66) for a in (0, 1) for b in (0, 1)], "src long, dst long")
    assert gt.closure(ladder).count() == 4 * 66 * 67 // 2
    cycle = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (None, 3)], "src long, dst long")
    assert gt.closure(cycle).count() == 9
    assert gt.closure(cycle.limit(0)).count() == 0


def test_components_of_a_long_path(spark):
    order = np.random.default_rng(3).permutation(300).tolist()
    edges = list(zip(order[:-1], order[1:])) + [(1000, 1001), (2000, 2000), (5, None)]
    got = {r.node: r.component for r in gt.components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {k: 0 for k in range(300)} | {1000: 1000, 1001: 1000, 2000: 2000}
    assert gt.components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_a_line_like_the_header_is_data(spark, tmp_path):
    (tmp_path / "x.txt").write_text("// note\na\tb\nx\ty\na\tb\n")
    got = read_table(spark, str(tmp_path / "x.txt"))
    assert got.columns == ["a", "b"] and sorted(map(tuple, got.collect())) == [("a", "b"), ("x", "y")]
    raw = spark.createDataFrame([(str(k % 20), str(k % 21)) for k in range(420)], "a string, b string")
    assert [t for _, t in infer_types(raw, 20).dtypes] == ["string", "double"]


def test_columns_that_look_like_helpers(spark):
    df = spark.createDataFrame([(1.0, 5.0, 1.0, 0.0), (3.0, 6.0, 2.0, 0.0), (None, 7.0, 4.0, 0.0)], "x double, _m_x double, stats double, value double")
    assert [tuple(r) for r in tr.center(df, ["x"]).orderBy("stats").collect()] == [(-1.0, 5.0, 1.0, 0.0), (1.0, 6.0, 2.0, 0.0), (None, 7.0, 4.0, 0.0)]
    assert tr.standardize(df, ["x", "stats"]).columns == df.columns
    assert tr.impute_mean(df, ["x"]).where("x is null").count() == 0
    assert sorted(r["b"] for r in tr.equal_intervals(df, "stats", 3, "b").collect()) == [0, 1, 2]
    ranks = tr.average_ranks(df.unionByName(df), "x", "r")
    assert sorted(map(str, (r["r"] for r in ranks.collect()))) == ["1.5", "1.5", "3.5", "3.5", "None", "None"]
    assert tr.average_ranks(df.limit(0), "x", "r").count() == 0
    z = tr.nonparanormal(spark.range(50).selectExpr("cast(id * id as double) as x", "id as value"), "x", "z").orderBy("value").toPandas().z
    assert abs(z.std() - np.std(np.arange(50.0) ** 2, ddof=1)) < 1e-6 and z.is_monotonic_increasing


def test_moments_of_a_column_far_from_zero(spark):
    x = np.random.default_rng(2).exponential(1, 2000)
    df = spark.createDataFrame([(float(v) + 1e6, None) for v in x] + [(None, None)], "x double, y double")
    r = moments(df, ["x", "y"]).collect()
    assert [a["var"] for a in r] == ["x"]
    d = x - x.mean()
    assert abs(r[0]["skewness"] - (d**3).sum() / (len(x) - 1) / (d**2).mean() ** 1.5) < 1e-5


def test_partial_results_meet_in_executors(spark):
    """The number of Spark jobs does not depend on the number of partitions, and results do not either."""
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(*map(float, rng.normal(1e5, 1, 3)), "ab"[k % 2]) for k in range(300)], "x double, y double, z double, g string")
    tracker = spark.sparkContext.statusTracker()
    seen, jobs = [], []
    for n in (2, 70):
        spark.sparkContext.setJobGroup(f"stats-{n}", "")
        seen.append(sufficient_stats(df.repartition(n), ["x", "y", "z"]))
        jobs.append(len(tracker.getJobIdsForGroup(f"stats-{n}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[0] == jobs[1]
    assert seen[0].n == seen[1].n == 300 and np.allclose(seen[0].cov, seen[1].cov)
    groups = grouped_stats(df.repartition(40), "g", ["x", "y"])
    assert sorted(groups) == ["a", "b"] and groups["a"].n == 150
    assert sufficient_stats(df.limit(0), ["x", "y"]).n == 0


def test_kendall_matches_all_pairs(spark, monkeypatch):
    r = np.random.default_rng(6)
    for k, (x, y) in enumerate([(r.integers(0, 9, 300), r.integers(0, 5, 300)), (r.normal(size=250), r.normal(size=250)), (np.arange(40), np.arange(40)[::-1]), (np.ones(5), np.arange(5))]):
        x, y = x.astype(float), y.astype(float)
        s = float((np.sign(x[:, None] - x) * np.sign(y[:, None] - y)).sum() / 2)
        assert st.concordance(x, y, np.ones(len(x))) == s
        tied = lambda v: sum(c * (c - 1) / 2 for c in np.unique(v, return_counts=True)[1])
        n = len(x) * (len(x) - 1) / 2
        scale = ((n - tied(x)) * (n - tied(y))) ** 0.5
        df = spark.createDataFrame([*zip(x.tolist(), y.tolist()), (None, 1.0)], "x double, y double")
        tau = st.kendall(df, "x", "y").first()["tau"]
        assert tau is None if not scale else abs(tau - s / scale) < 1e-12, k
    assert st.kendall(df.limit(0), "x", "y").first()["tau"] is None
