"""Delimited tables, covariance files and knowledge files; loaders infer and writers keep types."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.knowledge import Knowledge
from ..plans.suffstats import SuffStats

DELIMITERS = {"whitespace": r"\s+", "tab": "\t", "comma": ",", "colon": ":"}
_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def _lines(spark: SparkSession, path: str, comment: str) -> DataFrame:
    """(value, file, at) of the lines that are no comment and not empty; `at` orders the lines of a file."""
    block = F.col("_metadata.file_block_start")
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.struct(block.alias("block"), F.monotonically_increasing_id().alias("line")).alias("at"))
    return lines.where(~F.col("value").startswith(comment) & (F.trim("value") != ""))


def _table(lines: DataFrame, delimiter: str, header: bool, missing: str, quote: str, ids: bool | str) -> DataFrame:
    """Columns of strings of data lines; see `read_table`."""
    sep = DELIMITERS.get(delimiter, delimiter)
    split = lambda s: [x.strip().strip(quote) for x in re.split(sep, s.strip() if delimiter == "whitespace" else s.rstrip("\t\r\n"))]
    tops = lines.groupBy("file").agg(F.min_by("value", "at").alias("value"), F.min("at").alias("at"))
    first = next((r["value"] for r in tops.orderBy("file").take(1)), "")
    names = split(first) if header else [f"X{k + 1}" for k in range(len(split(first)) - (ids is True))]
    if ids is True:
        names = ["id", *names]
    body = lines.join(tops.where(F.col("value") == first).select("file", "at"), ["file", "at"], "left_anti") if header else lines
    clean = F.trim("value") if delimiter == "whitespace" else F.col("value")
    parts = body.select(F.split(clean, sep).alias("p"))
    cell = [F.trim(F.regexp_replace(F.trim(F.get("p", F.lit(k))), rf"^{quote}|{quote}$", "")) for k in range(len(names))]
    return parts.select(*[F.when((c != missing) & (c != ""), c).alias(n) for n, c in zip(names, cell, strict=True)])


def read_table(
    spark: SparkSession, path: str, delimiter: str = "tab", header: bool = True, missing: str = "*", comment: str = "//", quote: str = '"', max_discrete: int = 0, declared: dict[str, str] | None = None,
    ids: bool | str = False,
) -> DataFrame:
    """Columns typed from their values unless declared.

    A column with a value that is no number is discrete (string); one with a fraction is
    continuous (double); one of whole numbers is discrete with at most max_discrete different
    values, else continuous. Lines that start with the comment mark and empty lines go. The
    header is the first line left of a file; of several files, each may begin with the same one.
    ids: lines begin with a case id that the header does not name (it becomes the column `id`), or
    the name of the column that holds it; ids stay strings.
    """
    raw = _table(_lines(spark, path, comment), delimiter, header, missing, quote, ids)
    return infer_types(raw, max_discrete, {**(declared or {}), **_id_kind(raw, ids)})


def _id_kind(raw: DataFrame, ids: bool | str) -> dict[str, str]:
    name = "id" if ids is True else ids
    if name and name not in raw.columns:
        raise ValueError(f"no column of ids called {name}")
    return {name: "discrete"} if name else {}


def read_sections(
    spark: SparkSession, path: str, delimiter: str = "tab", header: bool = True, missing: str = "*", comment: str = "//", quote: str = '"', max_discrete: int = 0, ids: bool | str = False
) -> tuple[DataFrame, dict[str, list[str]], Knowledge]:
    """(table, values of declared discrete columns in order, knowledge) of one file with sections.

    /variables lists `name: Continuous` or `name: value, value, ...` (or 0=value, 1=value, ...);
    /data begins the table, /knowledge what may follow it; the first and the last may lack. A
    cell with a value that its column does not declare is an error. The driver sees the lines of
    headings, variables and knowledge only.
    """
    lines = _lines(spark, path, comment)
    heads = sorted((r["at"], r["value"].strip().lower()) for r in lines.where(F.col("value").startswith("/")).select("at", "value").collect())
    places = {h.split()[0]: at for at, h in heads}
    if "/data" not in places:
        raise ValueError("a file with sections has a /data section")

    def between(start, end):
        place = lambda at: F.struct(*[F.lit(x).cast("long").alias(n) for n, x in zip(("block", "line"), at, strict=True)])
        out = lines.where(F.col("at") > place(start))
        return out.where(F.col("at") < place(end)) if end is not None else out

    declared, values = {}, {}
    if "/variables" in places:
        for r in sorted(between(places["/variables"], places["/data"]).select("at", "value").collect()):
            name, _, kind = r["value"].partition(":")
            name, kind = name.strip().strip(quote), kind.strip()
            if kind.lower() == "continuous":
                declared[name] = "continuous"
            else:
                declared[name] = "discrete"
                values[name] = [re.sub(r"^\d+\s*=\s*", "", v.strip()).strip(quote) for v in kind.split(",") if v.strip()]
    known = Knowledge()
    if "/knowledge" in places:
        known = Knowledge.parse("\n".join(r["value"] for r in sorted(between(places["/knowledge"], None).select("at", "value").collect())))
    raw = _table(between(places["/data"], places.get("/knowledge")), delimiter, header, missing, quote, ids)
    out = infer_types(raw, max_discrete, {**declared, **_id_kind(raw, ids)})
    for name, allowed in values.items():
        cell = F.col(f"`{name}`")
        fault = F.raise_error(F.concat(F.lit(f"{name} does not have the value "), cell)).cast("string")
        out = out.withColumn(name, F.when(cell.isNull() | cell.isin(allowed), cell).otherwise(fault))
    return out, values, known


def infer_types(raw: DataFrame, max_discrete: int = 0, declared: dict[str, str] | None = None) -> DataFrame:
    """Typed columns of a table of strings, from one aggregation; exact counts of values where these decide."""
    q = lambda n: F.col(f"`{n}`")
    checks = []
    for k, n in enumerate(raw.columns):
        number = F.coalesce(q(n).rlike(_NUMBER), F.lit(True))
        whole = F.coalesce(q(n).rlike(r"^\s*[+-]?\d+\s*$"), F.lit(True))
        checks += [F.bool_and(number).alias(f"n{k}"), F.bool_and(whole).alias(f"w{k}"), F.approx_count_distinct(q(n)).alias(f"d{k}")]
    one = raw.agg(*checks).first().asDict()
    close = [k for k in range(len(raw.columns)) if one[f"w{k}"] and max_discrete and one[f"d{k}"] <= 1.5 * max_discrete + 10]
    if close:
        one |= raw.agg(*[F.count_distinct(q(raw.columns[k])).alias(f"d{k}") for k in close]).first().asDict()
    out = []
    for k, n in enumerate(raw.columns):
        kind = (declared or {}).get(n) or ("discrete" if not one[f"n{k}"] or one[f"w{k}"] and one[f"d{k}"] <= max_discrete else "continuous")
        out.append((F.expr(f"try_cast(`{n}` AS double)") if kind == "continuous" else q(n)).alias(n))
    return raw.select(*out)


def write_table(df: DataFrame, path: str, sep: str = "\t", missing: str = "*") -> None:
    df.write.option("sep", sep).option("header", True).option("nullValue", missing).csv(path)


def parse_covariance(text: str) -> SuffStats:
    """Number of rows, names, lower triangle; an optional heading line goes."""
    words = re.sub(r"//.*", "", text).replace(",", " ").split()
    if words and words[0].startswith("/"):
        words = words[1:]
    n, rest = int(words[0]), words[1:]
    k = next(i for i, w in enumerate(rest) if re.fullmatch(_NUMBER, w))
    names, values = rest[:k], [float(w) for w in rest[k:]]
    if len(values) < k * (k + 1) // 2:
        raise ValueError(f"{k} variables need {k * (k + 1) // 2} values, not {len(values)}")
    cov = np.zeros((k, k))
    cov[np.tril_indices(k)] = values[: k * (k + 1) // 2]
    return SuffStats(names, n, cov + np.tril(cov, -1).T)


def read_covariance(spark: SparkSession, path: str) -> SuffStats:
    return parse_covariance("\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect()))


def format_covariance(s: SuffStats) -> str:
    rows = ["\t".join(f"{v:.10g}" for v in s.cov[i, : i + 1]) for i in range(len(s.names))]
    return "\n".join([str(s.n), "\t".join(s.names), *rows]) + "\n"


def read_knowledge(spark: SparkSession, path: str) -> Knowledge:
    return Knowledge.parse("\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect()))
