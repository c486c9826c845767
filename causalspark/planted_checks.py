"""Queries that read files, draw numbers, and print and compare graphs, with answers typed by hand or in SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import calculator as calc
from .operators import clusters, model_io
from .operators import graph as gr
from .operators import graph_more as gm
from .operators import independence as ind
from .operators import scores, search
from .operators.graph import Graph
from .operators.models import BayesNet, fit_sem
from .planted import ALPHA, DAG, DISCRETE_DAG, LATENT_DAG, ORACLES, QUERIES, discrete, known, measured, stats, with_latent
from .plans.suffstats import sufficient_stats
from .plans.tables import shared_folder
from .sources import tabular


def asked(sql: str):
    """Registers a query with its SQL."""

    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


# files


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/files-{uuid.uuid4().hex[:12]}"


@asked("""
SELECT d AS delimiter, count(*) AS n, count(DISTINCT s_name) AS names, round(sum(CAST(s_acctbal AS DOUBLE)), 2) AS balance, count(*) FILTER (s_suppkey % 7 = 0) AS missing, 'double string double' AS kinds
FROM supplier, (VALUES ('tab'), ('comma'), ('colon'), ('whitespace')) v(d) GROUP BY d
""")
def tables_written_and_read(spark, sf):
    """Suppliers as delimited files, one cell in seven missing, read again with inferred types."""
    rows = spark.read.parquet(f"{sf}/supplier.parquet").select("s_suppkey", "s_name", F.col("s_acctbal").cast("double").alias("s_acctbal"), F.when(F.col("s_suppkey") % 7 != 0, F.col("s_suppkey") * 0.5).alias("half"))
    out: DataFrame | None = None
    for name, sep in (("tab", "\t"), ("comma", ","), ("colon", ":"), ("whitespace", " ")):
        path = _folder(spark)
        tabular.write_table(rows, path, sep)
        back = tabular.read_table(spark, path, name)
        kinds = " ".join(dict(back.dtypes)[c] for c in ("s_suppkey", "s_name", "s_acctbal"))
        one = back.agg(F.count("*").alias("n"), F.count_distinct("s_name").alias("names"), F.round(F.sum("s_acctbal"), 2).alias("balance"), F.count_if(F.col("half").isNull()).alias("missing"))
        one = one.select(F.lit(name).alias("delimiter"), "*", F.lit(kinds).alias("kinds"))
        out = one if out is None else out.unionByName(one)
    return out


@asked("""
SELECT a AS var_i, b AS var_j, round(v, 6) AS value FROM (
  SELECT 'q' AS a, 'q' AS b, var_samp(l_quantity) AS v FROM lineitem UNION ALL SELECT 'd', 'd', var_samp(CAST(l_discount AS DOUBLE)) FROM lineitem
  UNION ALL SELECT 'd', 'q', covar_samp(CAST(l_discount AS DOUBLE), l_quantity) FROM lineitem UNION ALL SELECT 'q', 'd', covar_samp(CAST(l_discount AS DOUBLE), l_quantity) FROM lineitem)
""")
def covariances_written_and_read(spark, sf):
    """A covariance file of two columns: rows, names, lower triangle."""
    s = sufficient_stats(spark.read.parquet(f"{sf}/lineitem.parquet").select(F.col("l_quantity").alias("q"), F.col("l_discount").alias("d")))
    path = _folder(spark)
    spark.createDataFrame([(tabular.format_covariance(s),)], "value string").coalesce(1).write.text(path)
    return tabular.read_covariance(spark, path).to_df(spark).withColumn("value", F.round("value", 6))


@known("src dst", [("X1", "X3"), ("X2", "X3"), ("X3", "X4"), ("X4", "X5"), ("X2", "X5")])
def knowledge_written_and_read(spark, sf):
    """Required edges of a known graph, by a knowledge file, and what a search makes of them."""
    path = _folder(spark)
    spark.createDataFrame([(gm.knowledge_of(DAG).text(),)], "value string").coalesce(1).write.text(path)
    g = search.pc(ind.FisherZ(stats(spark, sf), ALPHA), knowledge=tabular.read_knowledge(spark, path))
    return spark.createDataFrame([e[:2] for e in g.edges() if g.directed(*e[:2])], "src string, dst string")


@known("node value p", [("A", "1", 0.5), ("B", "1", 0.4), ("C", "1", 0.45), ("D", "1", 0.45)])
def networks_written_and_read(spark, sf):
    """Shares of ones by a fitted network that went through its XML form (to the nearest twentieth)."""
    net = BayesNet.fit(discrete(spark, sf), DISCRETE_DAG)
    back = model_io.bayes_net_from_xml(spark, model_io.bayes_net_to_xml(net))
    rows = [(v, r[v], round(round(20 * r["p"]) / 20, 2)) for v in back.dag.nodes for r in back.marginal([v]).collect() if r[v] == "1"]
    return spark.createDataFrame(rows, "node string, value string, p double")


@known("src dst value", [("X1", "X3", 0.8), ("X2", "X3", 0.9), ("X3", "X4", 0.8), ("X4", "X5", 0.7), ("X2", "X5", 0.8)])
def models_written_and_read(spark, sf):
    """Coefficients of a fitted linear model that went through its XML form."""
    g, edges, _ = model_io.sem_from_xml(model_io.sem_to_xml(fit_sem(stats(spark, sf), DAG)))
    return spark.createDataFrame([(a, b, round(edges[a, b], 1)) for a, b, _, _ in g.edges()], "src string, dst string, value double")


# draws: the share of rows up to each quartile of the distribution, typed from its closed form

_QUARTILES = {
    "Cauchy(1, 2)": (-1.0, 1.0, 3.0),
    "FDist(2, 2)": (1 / 3, 1.0, 3.0),
    "Gumbel(1, 2)": (0.346732, 1.733026, 3.491799),
    "Levy(1)": (0.755684, 2.198109, 9.849204),
    "LogNormal(0, 1)": (0.509416, 1.0, 1.963031),
    "Nakagami(1, 2)": (0.758528, 1.177410, 1.665109),
    "Pareto(2, 3)": (2.201285, 2.519842, 3.174802),
    "Split(0, 1, 3, 5)": (0.75, 3.5, 4.25),
    "StudentT(5)": (-0.726687, 0.0, 0.726687),
    "TruncNormal(0, 1, -1, 1)": (-0.674490, 0.0, 0.674490),
    "Weibull(2, 3)": (1.320284, 1.769994, 2.230052),
    "random()": (0.25, 0.5, 0.75),
}
_STEPS = {  # values and the shares up to each
    "Discrete(1, 2, 1)": ((0.0, 0.25), (1.0, 0.75), (2.0, 1.0)),
    "DiscError(3, 1)": ((0.0, 0.75), (1.0, 1.0)),
    "Indicator(0.3)": ((0.0, 0.7), (1.0, 1.0)),
    "Mixture(1, 5, 3, 7)": ((5.0, 0.25), (7.0, 1.0)),
}
_POINTS = [(f, q, s) for f, qs in _QUARTILES.items() for q, s in zip(qs, (0.25, 0.5, 0.75), strict=True)] + [(f, v, s) for f, steps in _STEPS.items() for v, s in steps]


@known("formula point share", _POINTS)
def draws_up_to_points(spark, sf):
    """Draws by row ids: which share of rows is at or below points of known probability (to the nearest twentieth)."""
    li = spark.read.parquet(f"{sf}/lineitem.parquet").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"))
    at = {f: k for k, f in enumerate(dict.fromkeys(f for f, _, _ in _POINTS))}
    drawn = li.select(*[calc.compile_expression(f, 1000 + 50 * k, "id").alias(f"d{k}") for f, k in at.items()])
    shares = drawn.agg(*[F.avg((F.col(f"d{at[f]}") <= p + 1e-9).cast("double")).alias(f"s{k}") for k, (f, p, _) in enumerate(_POINTS)]).first()
    return spark.createDataFrame([(f, p, round(round(20 * shares[f"s{k}"]) / 20, 2)) for k, (f, p, _) in enumerate(_POINTS)], "formula string, point double, share double")


@asked("""
SELECT l_orderkey, l_linenumber, round(CAST(2 * l_quantity + 2 * l_tax AS DOUBLE), 4) AS total, round(CAST((1 + l_quantity) * (1 + l_tax) AS DOUBLE), 4) AS product,
  CASE l_linenumber WHEN 1 THEN 10.0 WHEN 2 THEN 20.0 WHEN 3 THEN 30.0 END AS switched FROM lineitem
""")
def formula_templates(spark, sf):
    """Sums and products over variables, and a switch by a value."""
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    formula = lambda text: F.round(calc.compile_expression(calc.expand_templates(text, ["l_quantity", "l_tax"])), 4)
    switched = calc.compile_expression("Switch(l_linenumber - 1, 10, 20, 30)").cast("double")
    return li.select("l_orderkey", "l_linenumber", formula("TSUM(2 * $)").alias("total"), formula("TPROD(1 + $)").alias("product"), switched.alias("switched"))


# graphs found in tables, in text and by their paths


def _pattern(spark: SparkSession, sf: str) -> Graph:
    return search.pc(ind.FisherZ(stats(spark, sf), ALPHA))


@known("form line", [
    ("dot", ' "X1" -> "X3" [dir=both, arrowtail=none, arrowhead=normal];'), ("dot", ' "X2" -> "X3" [dir=both, arrowtail=none, arrowhead=normal];'),
    ("dot", ' "X2" -> "X5" [dir=both, arrowtail=none, arrowhead=normal];'), ("dot", ' "X3" -> "X4" [dir=both, arrowtail=none, arrowhead=normal];'),
    ("dot", ' "X4" -> "X5" [dir=both, arrowtail=none, arrowhead=normal];'), ("dot", "digraph g {"), ("dot", "}"),
    ("text", "1. X1 --> X3"), ("text", "2. X2 --> X3"), ("text", "3. X2 --> X5"), ("text", "4. X3 --> X4"), ("text", "5. X4 --> X5"),
    ("text", "Graph Edges:"), ("text", "Graph Nodes:"), ("text", "X1;X2;X3;X4;X5"),
    ("xml", "<graph><variable>X1</variable><variable>X2</variable><variable>X3</variable><variable>X4</variable><variable>X5</variable><edge>X1 --&gt; X3</edge><edge>X2 --&gt; X3</edge>"
            "<edge>X2 --&gt; X5</edge><edge>X3 --&gt; X4</edge><edge>X4 --&gt; X5</edge></graph>"),
])
def graph_texts_planted(spark, sf):
    """The forms of a found graph, line by line."""
    g = _pattern(spark, sf)
    g = g.subgraph(sorted(g.nodes)) if g.nodes != sorted(g.nodes) else g
    h = Graph(sorted(g.nodes))
    for a, b, x, y in g.edges():
        h.add_edge(a, b, x, y)
    forms = {"dot": gr.to_dot(h), "text": gr.to_text(h), "xml": gr.to_xml(h)}
    return spark.createDataFrame([(n, line) for n, t in forms.items() for line in t.split("\n") if line], "form string, line string")


@known("question answer", [
    ("blanket of X4", "X2 X3 X4 X5"), ("inducing Y1 Y2", "true"), ("inducing Y3 Y2", "false"), ("members of the class", "1"), ("semidirected X1 X5", "X1 X3 X4 X5"), ("semidirected X5 X1", ""),
    ("separating X1 X4", "X3"), ("separating X1 X5", "X2 X4"), ("separating X3 X4", ""), ("treks X4 X5", "X4 X3 X2 X5 | X4 X5"),
])
def graph_paths_planted(spark, sf):
    """Paths and sets of a found graph, and paths through a hidden node of the graph that a second table follows."""
    g = _pattern(spark, sf)
    hidden = LATENT_DAG.subgraph({*sufficient_stats(with_latent(spark, sf), ["Y1", "Y2", "Y3", "Y4"]).names, "L"})
    path = lambda a, b: " ".join(gm.semidirected_path(g, a, b) or [])
    rows = {
        "blanket of X4": " ".join(sorted(gm.blanket_graph(g, "X4").nodes)),
        "inducing Y1 Y2": str(gr.inducing_path(hidden, "Y1", "Y2")).lower(),
        "inducing Y3 Y2": str(gr.inducing_path(hidden, "Y3", "Y2")).lower(),
        "members of the class": str(len(list(gm.dags_in_pattern(g)))),
        "semidirected X1 X5": path("X1", "X5"),
        "semidirected X5 X1": path("X5", "X1"),
        "separating X1 X4": " ".join(sorted(gm.separating_set(g, "X1", "X4") or [])),
        "separating X1 X5": " ".join(sorted(gm.separating_set(g, "X1", "X5") or [])),
        "separating X3 X4": " ".join(gm.separating_set(g, "X3", "X4") or []),
        "treks X4 X5": " | ".join(" ".join(t) for t in gm.treks(g, "X4", "X5")),
    }
    return spark.createDataFrame(sorted(rows.items()), "question string, answer string")


@known("measure value", [
    ("adj_f1", 0.888889), ("adj_mcc", 0.816497), ("adj_precision", 1.0), ("adj_recall", 0.8), ("arrow_f1", 0.888889), ("arrow_mcc", 0.866025), ("arrow_precision", 1.0), ("arrow_recall", 0.8), ("shd", 2.0),
])
def recovery_planted(spark, sf):
    """How a found graph without its edge X4 --> X5 compares with the planted one: 4 of 5 edges, none wrong, of 10 pairs and 20 places of arrows."""
    g = _pattern(spark, sf)
    g.remove_edge("X4", "X5")
    return spark.createDataFrame([(k, round(v, 6)) for k, v in sorted(gr.recovery(g, DAG).items())], "measure string, value double")


@known("cluster members", [(1, "M1 M2 M3 M8"), (2, "M4 M5 M6")])
def purified_planted(spark, sf):
    """Two variables of another cluster spoil tetrads together, so one goes; three variables have no tetrad to spoil."""
    found = clusters.purify(sufficient_stats(measured(spark, sf).drop("id")), [["M1", "M2", "M3", "M7", "M8"], ["M4", "M5", "M6"]], 1e-6)
    return spark.createDataFrame([(k, " ".join(c)) for k, c in enumerate(found, 1)], "cluster int, members string")


@known("question independent", [("X1 X2 |", True), ("X1 X2 | X3", False), ("X1 X4 | X3", True), ("X1 X5 | X4", False), ("X1 X5 | X2 X4", True), ("X3 X5 |", False)])
def separation_in_found_graph(spark, sf):
    """d-separation in a found graph as a test, the answers read off the planted one by hand."""
    test = ind.DSeparation(_pattern(spark, sf))
    rows = []
    for q in ("X1 X2 |", "X1 X2 | X3", "X1 X4 | X3", "X1 X5 | X4", "X1 X5 | X2 X4", "X3 X5 |"):
        ends, given = q.split("|")
        rows.append((q, test.independent(*ends.split(), tuple(given.split()))))
    return spark.createDataFrame(rows, "question string, independent boolean")


@asked("""
SELECT n_nationkey AS case_key, CAST(n_regionkey AS DOUBLE) AS region, CASE WHEN n_nationkey % 2 = 0 THEN 'even' ELSE 'odd' END AS parity, 'even odd' AS declared, true AS tiers FROM nation
""")
def sections_written_and_read(spark, sf):
    """Nations as one file with declared variables, data with case ids, and knowledge."""
    rows = spark.read.parquet(f"{sf}/nation.parquet").select("n_nationkey", "n_regionkey").orderBy("n_nationkey").collect()  # 25 nations at every size
    lines = ["/variables", "region: Continuous", "parity: even, odd", "/data", "region,parity"]
    lines += [f"k{r['n_nationkey']},{r['n_regionkey']},{'odd' if r['n_nationkey'] % 2 else 'even'}" for r in rows]
    lines += ["/knowledge", "addtemporal", "1 region", "2 parity"]
    path = _folder(spark)
    spark.createDataFrame([("\n".join(lines),)], "value string").coalesce(1).write.text(path)
    df, values, known = tabular.read_sections(spark, path, "comma", ids=True)
    key = F.substring("id", 2, 10).cast("int").alias("case_key")
    return df.select(key, "region", "parity", F.lit(" ".join(values["parity"])).alias("declared"), F.lit(known.tiers == [["region"], ["parity"]]).alias("tiers"))


@known("graph src dst ep_src ep_dst", [
    ("gfci_max", "Y3", "Y1", "o", ">"), ("gfci_max", "Y1", "Y2", ">", ">"), ("gfci_max", "Y4", "Y2", "o", ">"),
    ("mag", "Y3", "Y1", "-", ">"), ("mag", "Y1", "Y2", ">", ">"), ("mag", "Y4", "Y2", "-", ">"),
])
def hidden_cause_members(spark, sf):
    """A class found with best-set colliders, and a member of it."""
    s = sufficient_stats(with_latent(spark, sf), ["Y1", "Y2", "Y3", "Y4"])
    pag = search.gfci_max(ind.FisherZ(s, ALPHA), scores.SemBic(s, 4.0))
    rows = [(n, *e) for n, g in (("gfci_max", pag), ("mag", gm.pag_to_mag(pag))) for e in g.edges()]
    return spark.createDataFrame(rows, "graph string, src string, dst string, ep_src string, ep_dst string")
