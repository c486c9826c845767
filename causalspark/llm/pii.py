"""Personal data: base patterns, and further spans from generated candidates scored by boosted trees.

All work on texts is DataFrame operations. Generators propose spans with high recall; spans
may overlap. Each has a few small features of its format and its surroundings, never its
check digits. The labels are what the formats' own checks say (check digits, number of
digits, mixture of characters). Counts of (features, label, fold) over all documents are the
whole training input: the feature domain bounds them, whatever the corpus. Trees of depth two
are boosted on fold 0; on fold 1 each kind gets the lowest score at which precision holds.

Defined results: null and empty texts have no spans. Positions are code points, the end is
exclusive. Repeated rows give repeated rows. An empty table trains nothing. Base spans always
stay. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (kind, pattern, text that any match needs). Possessive forms of the contract's patterns: they
#: match the same spans, and neither recursion nor time grows with a long run of such characters.
BASE = [
    ("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    ("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "."),
    ("card", r"[0-9](?:[\x20-]?[0-9])++", ""),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+"),
]
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
_IP = rf"^{_PART}(?:\.{_PART}){{3}}$"

#: High-recall generators: (kind, pattern, text that any match needs).
GENERATORS = [
    ("card", r"(?<![0-9])[0-9]{4}[\x20.-]?[0-9]{4}[\x20.-]?[0-9]{4}[\x20.-]?[0-9]{1,7}(?![0-9])", ""),
    ("phone", r"(?<![0-9])\+?[0-9]{1,3}[\x20.-]?\(?[0-9]{2,4}\)?[\x20.-]?[0-9]{3}[\x20.-]?[0-9]{4}(?![0-9])", ""),
    ("account", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,4})?(?![A-Za-z0-9])", ""),
    ("secret", r"(?<![A-Za-z0-9])(?:[A-Z]{4}[A-Z0-9]{16}|[0-9a-f]{16,}+|[A-Za-z0-9_-]{32,}+)(?![A-Za-z0-9])", ""),
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?(?:\(at\)|\[at\])\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|\(dot\)|\[dot\])\x20?[A-Za-z0-9-]++)++", "at"),
]
#: Words shortly before a span that speak for its kind.
CUES = r"(?i)(?:tel|phone|call|fax|mobile|card|visa|iban|account|mail|contact|pass(?:word|wd)?|token|secret|key)[^A-Za-z]{0,4}$"
CONTEXT = 24
#: Names and numbers of values of the features; their product with kinds and folds bounds the training counts.
FEATURES = {"generator": len(GENERATORS), "digits": 8, "length": 6, "seps": 4, "plus": 2, "left": 3, "right": 3, "cue": 2, "upper": 2, "letters": 2}
PRECISION = 0.9
ROUNDS = 30
RATE = 0.3


#: Elements of an array that are scanned one by one; running values of longer arrays are made of these chunks.
CHUNK = 128


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), where value is computed once however often f uses it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _before(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """For each of an array of ints the result of op over those before it, from nought on.

    Arrays grow by copying, so an array is only ever grown to a chunk, or to the number of chunks.
    """
    none = F.array().cast("array<int>")

    def grown(part: Column, first: Column) -> Column:
        step = lambda acc, x: F.struct(op(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
        return F.aggregate(part, F.struct(first.alias("at"), none.alias("out")), step)["out"]

    def of(v: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.ceil(F.size(v) / CHUNK).cast("int") - 1), lambda c: F.slice(v, c * CHUNK + 1, F.lit(CHUNK)))
        return _let(chunks, lambda parts: F.flatten(F.zip_with(parts, grown(F.transform(parts, lambda p: F.aggregate(p, F.lit(0), op)), F.lit(0)), grown)))

    return _let(values, lambda v: F.when(F.size(v) > 0, of(v)).otherwise(none))


def matches(text: Column, pattern: str, needs: str) -> Column:
    """array<struct<start, end, s>>: leftmost non-overlapping matches with their code points."""
    sized = F.zip_with(
        F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda gap, s: F.struct(F.coalesce(F.length(gap), F.lit(0)).alias("gap"), s.alias("s"))
    )

    def placed(found: Column) -> Column:
        ends = _before(F.transform(found, lambda x: x["gap"] + F.length(x["s"])), lambda at, x: at + x)
        return F.zip_with(found, ends, lambda x, at: F.struct((at + x["gap"]).alias("start"), (at + x["gap"] + F.length(x["s"])).alias("end"), x["s"].alias("s")))

    # the split is only made for the few texts with a match
    has = text.contains(needs) & text.rlike(pattern) if needs else text.rlike(pattern)
    none = F.array().cast("array<struct<start:int,end:int,s:string>>")
    return F.when(has, _let(F.filter(sized, lambda x: x["s"].isNotNull()), placed)).otherwise(none)


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _luhn(s: Column) -> Column:
    return F.coalesce(F.call_function("luhn_check", _digits(s)), F.lit(False))


def _valid(kind: str, s: Column) -> Column:
    n = F.length(_digits(s))
    return {
        "email": F.lit(True),
        "ip": s.rlike(_IP),
        "card": n.between(12, 19) & _luhn(s),
        "phone": n.between(9, 15),
    }[kind]


def _base_of(found: Column, kind: str, k: int) -> Column:
    good = F.filter(found, lambda m: _valid(kind, m["s"]))
    return F.transform(good, lambda m: F.struct(m["start"].alias("start"), F.lit(k).alias("k"), m["end"].alias("end")))


def base_spans(text: Column) -> Column:
    """array<struct<start, k, end>> of the base kinds in order of start, then kind; k is the kind's place in BASE."""
    parts = []
    for k, (kind, pattern, needs) in enumerate(BASE):
        parts.append(_base_of(matches(text, pattern, needs), kind, k))
    return F.array_sort(F.concat(*parts))


def _bucket(x: Column, bounds: list[int]) -> Column:
    return reduce(lambda acc, b: acc + (x >= b).cast("int"), bounds, F.lit(0))


def _side(c: Column) -> Column:
    return F.when(c == "", 0).when(c.rlike(r"^\s$"), 0).when(c.rlike(r"^[\p{L}\p{N}]$"), 1).otherwise(2)


def candidates(text: Column) -> Column:
    """array<struct<start, end, features..., good>> of all generators' spans."""
    return F.concat(*(_described(text, g) for g in range(len(GENERATORS))))


def _described(text: Column, g: int) -> Column:
    kind, pattern, needs = GENERATORS[g]

    def describe(m):
        s = m["s"]
        n, size = F.length(_digits(s)), m["end"] - m["start"]
        before = F.substring(text, F.greatest(m["start"] - CONTEXT, F.lit(0)) + 1, F.least(m["start"], F.lit(CONTEXT)))
        good = {
            "card": n.between(12, 19) & _luhn(s),
            "phone": n.between(9, 15) & s.rlike(r"^\+|^[0-9(]{3,5}[\x20.-]"),
            "account": n >= 8,
            "secret": s.rlike("[0-9]") & s.rlike("[A-Za-z]") & (n * 8 >= size),
            "email": s.rlike(r"[A-Za-z]{2,}$"),
        }[kind]
        return F.struct(
            m["start"].alias("start"),
            m["end"].alias("end"),
            F.lit(g).alias("generator"),
            _bucket(n, [1, 8, 10, 12, 13, 16, 20]).alias("digits"),
            _bucket(size, [11, 14, 18, 24, 36]).alias("length"),
            F.least(F.length(F.regexp_replace(s, r"[^\x20().-]", "")), F.lit(3)).alias("seps"),
            s.startswith("+").cast("int").alias("plus"),
            _side(F.when(m["start"] > 0, F.substring(text, m["start"], F.lit(1))).otherwise("")).alias("left"),
            _side(F.substring(text, m["end"] + 1, F.lit(1))).alias("right"),
            before.rlike(CUES).cast("int").alias("cue"),
            s.rlike("[A-Z]").cast("int").alias("upper"),
            s.rlike("[A-Za-z]").cast("int").alias("letters"),
            good.alias("good"),
        )

    return F.transform(matches(text, pattern, needs), describe)


class Boosted:
    """Trees of depth two on small integer features, fitted to weighted counts."""

    def __init__(self) -> None:
        self.bias = 0.0
        self.trees: list[tuple] = []  # (feature, bound, [(feature, bound, low, high) for either side])
        self.bounds: dict[int, float] = {}

    def fit(self, x: np.ndarray, good: np.ndarray, total: np.ndarray) -> Boosted:
        rate = np.clip(good.sum() / total.sum(), 1e-3, 1 - 1e-3)
        self.bias = float(np.log(rate / (1 - rate)))
        score = np.full(len(x), self.bias)
        for _ in range(ROUNDS):
            p = 1 / (1 + np.exp(-score))
            grad, hess = good - total * p, total * p * (1 - p) + 1e-9
            tree = self._grow(x, grad, hess)
            if tree is None:
                break
            self.trees.append(tree)
            score = score + self._apply(tree, x)
        return self

    @staticmethod
    def _split(x, grad, hess):
        best = None
        for f in range(x.shape[1]):
            for b in range(int(x[:, f].min()) + 1, int(x[:, f].max()) + 1):
                low = x[:, f] < b
                gl, hl, gh, hh = grad[low].sum(), hess[low].sum() + 1.0, grad[~low].sum(), hess[~low].sum() + 1.0
                gain = gl * gl / hl + gh * gh / hh
                if best is None or gain > best[0] + 1e-12:
                    best = (gain, f, b, float(RATE * gl / hl), float(RATE * gh / hh))
        return best

    def _grow(self, x, grad, hess):
        top = self._split(x, grad, hess)
        if top is None:
            return None
        low, sides = x[:, top[1]] < top[2], []
        for side, value in ((low, top[3]), (~low, top[4])):
            s = self._split(x[side], grad[side], hess[side])
            sides.append(s[1:] if s else (top[1], 0, value, value))
        return (top[1], top[2], sides)

    @staticmethod
    def _apply(tree, x):
        f, b, sides = tree
        low, high = (np.where(x[:, g] < c, u, v) for g, c, u, v in sides)
        return np.where(x[:, f] < b, low, high)

    def score(self, x: np.ndarray) -> np.ndarray:
        return self.bias + sum((self._apply(t, x) for t in self.trees), np.zeros(len(x)))

    def calibrate(self, x: np.ndarray, good: np.ndarray, total: np.ndarray) -> Boosted:
        """For each generator the lowest score from which on the precision is PRECISION."""
        s = self.score(x)
        for g in range(len(GENERATORS)):
            own = np.flatnonzero(x[:, 0] == g)
            own = own[np.argsort(-s[own], kind="stable")]
            right, every = np.cumsum(good[own]), np.cumsum(total[own])
            last = np.append(s[own][1:] != s[own][:-1], True) if len(own) else np.empty(0, bool)
            fit = np.flatnonzero(last & (right >= PRECISION * every))
            if len(fit):  # no bound where it holds for all
                self.bounds[g] = float(s[own][fit[-1]]) if fit[-1] < len(own) - 1 else -1e300
        return self

    def column(self, c: Column) -> Column:
        """Whether a candidate is taken: the trees and bounds as one expression."""
        names = list(FEATURES)
        total = F.lit(self.bias)
        for f, b, sides in self.trees:
            low, high = (F.when(c[names[g]] < k, u).otherwise(v) for g, k, u, v in sides)
            total = total + F.when(c[names[f]] < b, low).otherwise(high)
        bound = reduce(lambda acc, x: acc.when(c["generator"] == x[0], x[1] - 1e-9), self.bounds.items(), F.when(F.lit(False), 0.0))
        return F.coalesce(total >= bound, F.lit(False))


def train(docs: DataFrame, text: str = "text") -> Boosted:
    """Trees and thresholds from the candidates of all documents.

    The driver gets counts of feature vectors: not more rows than the product of FEATURES.
    """
    counts = (
        docs.where(F.col(text).rlike("[0-9]|at[])]"))
        .select(F.explode(candidates(F.col(text))).alias("c"), (F.pmod(F.xxhash64(text), F.lit(2))).alias("fold"))
        .select(*[F.col(f"c.{f}").alias(f) for f in FEATURES], F.col("c.good").cast("long").alias("good"), "fold")
        .groupBy(*FEATURES, "fold")
        .agg(F.sum("good").alias("good"), F.count("*").alias("total"))
        .collect()
    )
    rows = sorted(tuple(r) for r in counts)
    model, k = Boosted(), len(FEATURES)
    data = np.array(rows, dtype=np.float64) if rows else np.empty((0, k + 3))
    for fold, use in ((0, model.fit), (1, model.calibrate)):
        part = data[data[:, k] == fold]
        if len(part):
            use(part[:, :k].astype(int), part[:, k + 1], part[:, k + 2])
    return model


_KINDS = [k for k, _, _ in BASE] + sorted({k for k, _, _ in GENERATORS} - {k for k, _, _ in BASE})


def with_spans(docs: DataFrame, model: Boosted, text: str = "text") -> DataFrame:
    """docs with `base` and `spans`: arrays of struct<start, k, end>, sorted; k is a place in kinds()."""
    taken = F.transform(
        F.filter("_cands", model.column),
        lambda c: F.struct(c["start"].alias("start"), reduce(lambda acc, g: acc.when(c["generator"] == g[0], _KINDS.index(g[1][0])), enumerate(GENERATORS), F.when(F.lit(False), 0)).alias("k"), c["end"].alias("end")),
    )
    full = F.coalesce(F.col(text), F.lit(""))
    distinct = lambda a: F.filter(a, lambda x, i: (i == 0) | (F.get(a, i - 1) != x))  # noqa: E731  a is sorted
    return (
        docs.withColumn("base", base_spans(full))
        .withColumn("_cands", F.when(full.rlike("[0-9]|at[])]"), candidates(full)))
        .withColumn("spans", _let(F.array_sort(F.concat("base", F.coalesce(taken, F.array().cast("array<struct<start:int,k:int,end:int>>")))), distinct))
        .drop("_cands")
    )


def kinds() -> list[str]:
    return list(_KINDS)


def count_kind(spans: Column, k: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["k"] == k)).cast("long")


def rendered(spans: Column) -> Column:
    """kind:start:end of the spans, comma-joined."""
    names = F.array(*[F.lit(k) for k in _KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["k"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with each span of the text replaced by its kind in angle brackets; spans that overlap are one, of the first one's kind.

    The columns are those of docs, whatever their names. Null texts stay null, repeated rows
    stay repeated, an empty table stays empty.
    """
    names = F.array(*[F.lit(k) for k in _KINDS])

    def merged(spans: Column) -> Column:
        """Spans that overlap those before them joined; a joined one ends where the furthest of its spans does."""
        far = _before(F.transform(spans, lambda s: s["end"]), lambda a, b: F.greatest(a, b))  # the furthest end before each
        marked = F.zip_with(spans, far, lambda s, at: F.struct(s.alias("s"), at.alias("far"), (s["start"] >= at).alias("new")))

        def joined(m: Column) -> Column:
            firsts = F.filter(m, lambda x: x["new"])
            last = lambda x, i: (i == F.size(m) - 1) | F.coalesce(F.get(m, i + 1)["new"], F.lit(True))
            ends = F.transform(F.filter(m, last), lambda x: F.greatest(x["far"], x["s"]["end"]))
            return F.zip_with(firsts, ends, lambda f, e: F.struct(f["s"]["start"].alias("start"), f["s"]["k"].alias("k"), e.alias("end")))

        return _let(marked, joined)

    def cut_out(cuts: Column) -> Column:
        since = lambda i: F.when(i > 0, F.get(cuts, i - 1)["end"]).otherwise(0)
        pieces = F.transform(cuts, lambda c, i: F.concat(F.substring(F.col("text"), since(i) + 1, c["start"] - since(i)), F.lit("<"), F.element_at(names, c["k"] + 1), F.lit(">")))
        return F.concat(F.array_join(pieces, ""), F.substring(F.col("text"), F.element_at(cuts, -1)["end"] + 1, F.length("text")))

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{text}`").alias("text"))
    out = with_spans(rows, train(rows)).withColumn("text", F.when(F.size("spans") > 0, _let(merged(F.col("spans")), cut_out)).otherwise(F.col("text")))
    return out.select(*[F.col("text").alias(c) if c == text else F.col("row").getField(c).alias(c) for c in docs.columns])
