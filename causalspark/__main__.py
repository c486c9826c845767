"""Command line: python -m causalspark -data FILE -algorithm NAME [options]; prints the graph."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .operators import search as S
from .operators.clusters import measurement_graph, one_factor_clusters
from .operators.graph import random_dag, to_text
from .operators.independence import ChiSquare, FisherZ
from .operators.scores import BDeu, SemBic
from .plans.suffstats import sufficient_stats
from .sources.tabular import read_covariance, read_knowledge, read_table

SEARCHES = ("pc", "pc.stable", "cpc", "pc.max", "fci", "cfci", "rfci", "gfci", "fges", "fofc", "randomDag")


def main(argv: list[str] | None = None) -> str:
    p = argparse.ArgumentParser(prog="causalspark")
    p.add_argument("-data")
    p.add_argument("-covariance")
    p.add_argument("-datatype", choices=("continuous", "discrete"), default="continuous")
    p.add_argument("-algorithm", choices=SEARCHES, required=True)
    p.add_argument("-depth", type=int, default=-1)
    p.add_argument("-significance", type=float, default=0.05)
    p.add_argument("-knowledge")
    p.add_argument("-penaltydiscount", type=float, default=1.0)
    p.add_argument("-delimiter", default="tab")
    p.add_argument("-numNodes", type=int, default=5)
    p.add_argument("-numEdges", type=int, default=5)
    p.add_argument("-seed", type=int, default=0)
    p.add_argument("-outfile")
    a = p.parse_args(argv)
    if a.algorithm == "randomDag":
        text = to_text(random_dag(a.numNodes, a.numEdges, a.seed))
    else:
        if not (a.data or a.covariance):
            p.error("-data or -covariance is needed")
        spark = SparkSession.builder.getOrCreate()
        knowledge = read_knowledge(spark, a.knowledge) if a.knowledge else None
        if a.datatype == "discrete":
            df = read_table(spark, a.data, a.delimiter, max_discrete=10**9)
            test, score = ChiSquare(df, alpha=a.significance), BDeu(df)
        else:
            s = read_covariance(spark, a.covariance) if a.covariance else sufficient_stats(read_table(spark, a.data, a.delimiter))
            test, score = FisherZ(s, a.significance), SemBic(s, a.penaltydiscount)
        match a.algorithm:
            case "pc":
                g = S.pc(test, a.depth, knowledge, stable=False)
            case "pc.stable":
                g = S.pc(test, a.depth, knowledge)
            case "cpc":
                g = S.cpc(test, a.depth, knowledge)
            case "pc.max":
                g = S.pc_max(test, a.depth, knowledge)
            case "fci":
                g = S.fci(test, a.depth, knowledge)
            case "cfci":
                g = S.cfci(test, a.depth, knowledge)
            case "rfci":
                g = S.rfci(test, a.depth, knowledge)
            case "gfci":
                g = S.gfci(test, score, a.depth, knowledge)
            case "fges":
                g = S.fges(score, knowledge)
            case _:
                g = measurement_graph(one_factor_clusters(test.stats, a.significance))
        text = to_text(g)
    if a.outfile:
        with open(a.outfile, "w") as f:
            f.write(text)
    else:
        sys.stdout.write(text)
    return text


if __name__ == "__main__":
    main()
