"""Models as XML text, and random discrete and mixed models to simulate from."""

from __future__ import annotations

import xml.etree.ElementTree as ET

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import Graph
from .models import BayesNet, SemFit


def bayes_net_to_xml(net: BayesNet) -> str:
    root = ET.Element("bayesNet")
    variables = ET.SubElement(root, "bnVariables")
    rows = {v: t.select(*net.dag.parents(v), v, "p").collect() for v, t in net.tables.items()}
    for v in net.dag.nodes:
        node = ET.SubElement(variables, "discreteVariable", name=v)
        for label in sorted({str(r[v]) for r in rows[v]}):
            ET.SubElement(node, "value", name=label)
    tables = ET.SubElement(root, "cpts")
    for v in net.dag.nodes:
        t = ET.SubElement(tables, "cpt", variable=v)
        for p in net.dag.parents(v):
            ET.SubElement(t, "parent", name=p)
        for r in sorted(rows[v], key=str):
            ET.SubElement(t, "row", p=repr(r["p"]), **{f"v{k}": str(x) for k, x in enumerate(tuple(r)[:-1])})
    return ET.tostring(root, encoding="unicode")


def bayes_net_from_xml(spark: SparkSession, text: str) -> BayesNet:
    """The network of an XML text; values are strings."""
    root = ET.fromstring(text)
    dag, tables = Graph([v.get("name") for v in root.find("bnVariables")]), {}
    for t in root.find("cpts"):
        v, parents = t.get("variable"), [p.get("name") for p in t.findall("parent")]
        for p in parents:
            dag.add_edge(p, v)
    for t in root.find("cpts"):
        v = t.get("variable")
        named = [p.get("name") for p in t.findall("parent")] + [v]
        rows = [(*(r.get(f"v{k}") for k in range(len(named))), float(r.get("p"))) for r in t.findall("row")]
        tables[v] = spark.createDataFrame(rows, ", ".join(f"`{c}` string" for c in named) + ", p double")
    return BayesNet(dag, tables)


def sem_to_xml(fit: SemFit) -> str:
    root = ET.Element("sem")
    for v in fit.graph.nodes:
        ET.SubElement(root, "node", name=v, variance=repr(float(fit.variances[v])))
    for (a, b), c in fit.edges.items():
        ET.SubElement(root, "edge", causeNode=a, effectNode=b, value=repr(float(c)))
    return ET.tostring(root, encoding="unicode")


def sem_from_xml(text: str) -> tuple[Graph, dict[tuple[str, str], float], dict[str, float]]:
    root = ET.fromstring(text)
    g = Graph([n.get("name") for n in root.findall("node")])
    edges = {(e.get("causeNode"), e.get("effectNode")): float(e.get("value")) for e in root.findall("edge")}
    for a, b in edges:
        g.add_edge(a, b)
    return g, edges, {n.get("name"): float(n.get("variance")) for n in root.findall("node")}


def simulate_discrete(spark: SparkSession, dag: Graph, n: int, levels: int = 3, seed: int = 0) -> DataFrame:
    """`row_id` and a code for each node, from random conditional probabilities, in topological order."""
    r = np.random.default_rng(seed)
    df = spark.range(n).withColumnRenamed("id", "row_id")
    for k, v in enumerate(dag.topological_order()):
        parents = dag.parents(v)
        config = F.lit(0)
        for p in parents:
            config = config * levels + F.col(p)
        cum = np.cumsum(r.dirichlet(np.full(levels, 0.7), levels ** len(parents)), axis=1)
        table = F.array(*[F.array(*map(F.lit, row[:-1].tolist())) for row in cum])
        u = F.pmod(F.xxhash64(F.col("row_id"), F.lit(seed * 1000 + k)), F.lit(1 << 53)).cast("double") / float(1 << 53)
        row = F.element_at(table, (config + 1).cast("int"))
        df = df.withColumn("_u", u).withColumn(v, F.size(F.filter(row, lambda c: F.col("_u") >= c))).drop("_u")
    return df.select("row_id", *dag.nodes)


def simulate_mixed(spark: SparkSession, dag: Graph, discrete: list[str], n: int, levels: int = 3, seed: int = 0) -> DataFrame:
    """Continuous nodes are linear in their parents' values or codes with noise; discrete ones cut such a sum at fixed points."""
    r = np.random.default_rng(seed)
    df = spark.range(n).withColumnRenamed("id", "row_id")
    for k, v in enumerate(dag.topological_order()):
        total = F.randn(seed * 1000 + k)
        for p in dag.parents(v):
            total = total + F.col(p) * float(r.uniform(0.5, 1.5) * r.choice([-1, 1]))
        if v in discrete:
            cuts = [-1 + 2 * (i + 1) / levels for i in range(levels - 1)]
            df = df.withColumn("_t", total).withColumn(v, sum(((F.col("_t") >= c).cast("int") for c in cuts), F.lit(0))).drop("_t")
        else:
            df = df.withColumn(v, total)
    return df.select("row_id", *dag.nodes)
