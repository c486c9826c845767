"""Cases that once gave wrong answers."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from causalspark.functions.special import fdr_cutoff
from causalspark.operators import marked_tables, models, more_search, statistics, transforms
from causalspark.plans.suffstats import SuffStats

EDGE = "src string, dst string, ep_src string, ep_dst string"


def test_a_graph_with_a_two_cycle_is_no_distance_from_itself(spark):
    g = spark.createDataFrame([("a", "b", "-", ">"), ("b", "a", "-", ">"), ("b", "c", "-", ">"), ("b", "c", "-", ">")], EDGE)
    h = spark.createDataFrame([("a", "b", "-", ">"), ("c", "b", ">", "-")], EDGE)
    assert marked_tables.hamming(g, g).first()["shd"] == 0
    assert marked_tables.hamming(g, h).first()["shd"] == 1  # the two-cycle; b --> c is the same either way round
    assert all(r["true_form"] == r["estimated_form"] for r in marked_tables.misclassification(g, g).collect())


def test_nan_counts_as_missing(spark):
    df = spark.createDataFrame([(1, 2.0), (2, float("nan")), (3, None), (4, 5.0), (5, 9.0)], "id int, x double")
    ranks = {r["id"]: r["r"] for r in transforms.average_ranks(df, "x", "r").collect()}
    assert ranks == {1: 1.0, 2: None, 3: None, 4: 2.0, 5: 3.0}
    scores = {r["id"]: r["z"] for r in transforms.nonparanormal(df, "x", "z").collect()}
    assert scores[2] is None and scores[3] is None and scores[1] < scores[4] < scores[5]
    bins = {r["id"]: r["x_bin"] for r in transforms.equal_counts(df, "x", 3).collect()}
    assert bins == {1: 0, 2: None, 3: None, 4: 1, 5: 2}


def test_what_does_not_settle_is_an_error(spark):
    df = spark.createDataFrame([(float(k), float(k > 5)) for k in range(12)], "x double, y double")
    with pytest.raises(RuntimeError):
        models.logistic(df, "y", ["x"])
    stats = SuffStats(["a", "b"], 50, [[1.0, 0.5], [0.5, 1.0]])
    import numpy as np

    stats.cov = np.array(stats.cov)
    with pytest.raises(RuntimeError):
        more_search.graphical_lasso(stats, 0.1, rounds=1)


@pytest.mark.parametrize("dependent", [True, False])
def test_false_discovery_cutoff_of_a_table(spark, dependent):
    r = random.Random(1)
    values = [r.random() ** 4 for _ in range(400)] + [0.001] * 5
    df = spark.createDataFrame([(v,) for v in values], "p double").repartition(6)
    got = tuple(statistics.false_discovery_cutoff(df, "p", 0.05, dependent).first())
    assert got == pytest.approx(fdr_cutoff(0.05, values, dependent))
    assert tuple(statistics.false_discovery_cutoff(spark.createDataFrame([(0.9,)], "p double"), "p", 0.05).first()) == (None, -1)


@pytest.mark.parametrize("sent", [0, 10**6])
def test_ranks_of_several_columns_in_one_pass(spark, monkeypatch, sent):
    monkeypatch.setattr(transforms, "SENT_RANKS", sent)
    rows = [(3.0, 1), (1.0, 1), (float("nan"), 2), (3.0, None), (None, 5), (2.0, 5)]
    df = spark.createDataFrame(rows, "x double, y int").repartition(3)
    got = sorted(((r["x"], r["y"], r["x_rank"], r["y_rank"]) for r in transforms.average_ranks_of(df, ["x", "y"]).collect()), key=str)
    want = [(3.0, 1, 3.5, 1.5), (1.0, 1, 1.0, 1.5), (float("nan"), 2, None, 3.0), (3.0, None, 3.5, None), (None, 5, None, 4.5), (2.0, 5, 2.0, 4.5)]
    assert list(map(str, got)) == list(map(str, sorted(want, key=str)))


def test_members_of_a_class_with_hidden_causes():
    from itertools import combinations

    from causalspark.operators.graph import Graph, random_dag
    from causalspark.operators.graph_more import is_ancestral, pag_to_mag
    from causalspark.operators.search import dag_to_pag

    g = pag_to_mag(Graph.parse("Y3o->Y1,Y1<->Y2,Y4o->Y2"))
    assert set(str(g).split(",")) == {"Y3-->Y1", "Y1<->Y2", "Y4-->Y2"} and is_ancestral(g)
    assert not is_ancestral(Graph.parse("A-->B,B-->C,A<->C"))
    for seed in range(40):  # the member has the separations of the DAG it comes from
        dag = random_dag(6, 8, seed)
        dag.latent = set(dag.nodes[:2])
        mag = pag_to_mag(dag_to_pag(dag))
        assert is_ancestral(mag)
        for a, b in combinations(mag.nodes, 2):
            for z in ([], [v for v in mag.nodes if v not in (a, b)][:1], [v for v in mag.nodes if v not in (a, b)]):
                assert mag.d_separated(a, b, z) == dag.d_separated(a, b, z), (seed, a, b, z)


def test_summary_of_odd_columns_equals_percentile(spark):
    r = np.random.default_rng(11)
    odd = [None, float("nan"), float("inf"), -float("inf"), -0.0, 0.0, 1e300, -1e-300]
    rows = [(float(x), float(k % 7), odd[k % 8] if k < 60 else None, int(k % 3), None, float("nan")) for k, x in enumerate(r.normal(size=1001))]
    df = spark.createDataFrame(rows, "a double, b float, c double, d int, e double, f double").repartition(5)
    got = {x["var"]: x.asDict() for x in statistics.summary(df, list("abcdef")).collect()}
    assert sorted(got) == list("abcdf")
    for c in got:
        v = F.col(c).cast("double")
        quartiles = [F.percentile(v, F.lit(p)).alias(q) for q, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))]
        want = df.where(F.col(c).isNotNull()).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"), F.min(v).alias("min"), F.max(v).alias("max"), *quartiles).first().asDict()
        assert got[c].pop("var") == c and got[c].pop("n") == want.pop("n")
        for k, x in want.items():
            assert np.isclose(got[c][k], x, rtol=1e-12, atol=0, equal_nan=True), (c, k)
    one = statistics.summary(spark.createDataFrame([(3.0,)], "x double"), ["x"]).first()
    assert (one["n"], one["sd"], one["q1"], one["median"], one["q3"]) == (1, None, 3.0, 3.0, 3.0)
    assert statistics.summary(df.limit(0), ["a"]).count() == 0


def test_summary_gathers_no_column_in_one_record(spark):
    """A percentile keeps all distinct values of a column in one state, which one task merges."""
    df = spark.range(40_000).select((F.xxhash64("id") / 2.0**40).alias("x")).repartition(4)

    def stages():
        store, gateway = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        found = store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
        return {s.stageId(): s.shuffleReadBytes() / max(s.shuffleReadRecords(), 1) for s in (found.apply(i) for i in range(found.size()))}

    old = stages()
    assert len(statistics.summary(df, ["x"]).collect()) == 1
    assert max(size for k, size in stages().items() if k not in old) < 2_000
