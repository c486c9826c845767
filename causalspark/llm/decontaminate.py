"""Benchmark decontamination: prefix-filtered set join over item-sized windows, in DataFrame operations only.

A document word is hit if it lies in an occurrence of a window (13 consecutive words of an
item, or all words of a shorter one). Containment of a window is total, so its prefix is one
token: its rarest word over all documents. Document words are joined with these prefix words;
length and position bounds drop windows that would begin before the document or end after
it; what stays is verified word by word.

Defined results: null and empty texts have no words, and an item without words has no window.
Items of one text count each by their own id; a null item_id counts in n_hit but not among
the items. Repeated documents give repeated rows with equal results. Empty tables give no
hits. Further columns of either table are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, fresh, hinted, materialize

WINDOW = 13
_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Up to so many windows (some 200 bytes each) are broadcast; more of them join by shuffle.
BROADCAST_ROWS = 200_000


def words(text):
    """Column: words of the lower-cased text (A-Z only); null gives none."""
    return F.filter(F.split(ascii_lower(text), _SEPARATORS, -1), lambda w: w != "")


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(words, items): the distinct windows of all items, each with the ids of its items."""
    n = F.size("w")
    starts = F.when(n > 0, F.sequence(F.lit(0), F.greatest(n - window, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    return (
        items.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("w"))
        .select("item_id", "w", F.explode(starts).alias("s"))
        .select("item_id", F.slice("w", F.col("s") + 1, F.lit(window)).alias("words"))
        .groupBy("words")
        .agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    )


def _prefixes(wins: DataFrame, norm: DataFrame, small: bool) -> DataFrame:
    """(word, wins): the windows by their rarest word; words that no document has drop their windows."""
    hint = F.broadcast if small else (lambda df: df)
    vocabulary = wins.select(F.explode("words").alias("word")).distinct()
    tokens = norm.select(F.explode(F.split("norm", " ")).alias("word"))
    frequency = materialize(
        tokens.join(hint(vocabulary), "word", "left_semi").groupBy("word").agg(F.count("*").alias("df")), "word-frequency"
    )
    rarest = (
        wins.select("words", "items", F.posexplode("words").alias("offset", "word"))
        .join(hint(frequency), "word", "left")
        .groupBy("words", "items")
        .agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "word", "offset")).alias("token"))
        .where("token.df > 0")
    )
    wins_of = F.collect_list(F.struct(F.col("token.offset").alias("offset"), "words", "items"))
    return materialize(rarest.groupBy(F.col("token.word").alias("word")).agg(wins_of.alias("wins")), "prefixes")


def occurrences(norm: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, h, start, length, items): every place where a window occurs."""
    wins = materialize(item_windows(items, window), "windows")
    small = wins.count() <= BROADCAST_ROWS
    prefixes = _prefixes(wins, norm, small)
    # the words that any window with this token can cover, and the token's place among them
    near = F.slice("w", F.greatest(F.col("pos") + 2 - window, F.lit(1)), F.least(F.col("pos"), F.lit(window - 1)) + window)
    at = F.least(F.col("pos"), F.lit(window - 1))
    full = norm.select("doc_id", "h", F.split("norm", " ").alias("w"))
    if small:
        hits = (
            full.select("doc_id", "h", "w", F.posexplode("w").alias("pos", "word"))
            .join(F.broadcast(prefixes), "word")
            .select("doc_id", "h", "pos", "wins", near.alias("near"), at.alias("at"))
        )
    else:  # a row that a shuffle copies must not carry the document
        places = (
            full.select(F.col("doc_id").alias("of"), F.col("h").alias("oh"), F.posexplode("w").alias("pos", "word"))
            .join(prefixes.select("word"), "word")
            .groupBy("of", "oh")
            .agg(F.collect_set(F.struct("pos", "word")).alias("places"))
        )
        hits = (
            full.join(places, F.col("doc_id").eqNullSafe(F.col("of")) & F.col("h").eqNullSafe(F.col("oh")))
            .select("doc_id", "h", "w", F.inline("places"))
            .select("doc_id", "h", "pos", "word", near.alias("near"), at.alias("at"))
            .join(prefixes, "word")
        )
    size, offset = F.size("x.words"), F.col("x.offset")
    return (
        hits.select("doc_id", "h", "pos", "near", "at", F.explode("wins").alias("x"))
        .where((F.col("at") >= offset) & (F.col("at") - offset + size <= F.size("near")))
        .where(F.slice("near", F.col("at") - offset + 1, size) == F.col("x.words"))
        .select("doc_id", "h", (F.col("pos") - offset).alias("start"), size.alias("length"), F.col("x.items").alias("items"))
    )


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, h, n_words, n_hit, item_ids, contaminated of every row of docs; h is a hash of its text."""
    norm = materialize(
        docs.select("doc_id", F.xxhash64("text").alias("h"), words(F.col("text")).alias("w")).select(
            "doc_id", "h", F.size("w").cast("long").alias("n_words"), F.array_join("w", " ").alias("norm")
        ),
        "normalized",
    )
    merged = F.aggregate(
        F.array_sort("spans"),
        F.struct(F.lit(0).alias("hit"), F.lit(0).alias("end")),
        lambda acc, s: F.struct(
            (acc["hit"] + F.greatest(F.lit(0), s["start"] + s["length"] - F.greatest(acc["end"], s["start"]))).alias("hit"),
            F.greatest(acc["end"], s["start"] + s["length"]).alias("end"),
        ),
    )["hit"]
    found = (
        occurrences(norm, items, window)
        .groupBy("doc_id", "h")
        .agg(F.collect_set(F.struct("start", "length")).alias("spans"), F.collect_set("items").alias("lists"))
        .select("doc_id", "h", merged.cast("long").alias("n_hit"), F.array_sort(F.array_distinct(F.flatten("lists"))).alias("item_ids"))
    )
    rows = norm.select("doc_id", "h", "n_words")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return (
        rows.join(found, [rows[c].eqNullSafe(found[c]) for c in ("doc_id", "h")], "left")
        .select(rows["doc_id"], rows["h"], "n_words", n_hit.alias("n_hit"), F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"))
        .withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
    )


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs that are not contaminated, with all their columns, whatever their names.

    Contaminated rows are found by id and text, so rows that share an id are judged each by
    its own text; a row that nothing is found in always stays, as do null texts and ids.
    """
    doc, h = fresh(docs, "doc"), fresh(docs, "hash")
    bad = contamination(docs.select("doc_id", "text"), items).where("contaminated").select(F.col("doc_id").alias(doc), F.col("h").alias(h)).distinct()
    return docs.join(hinted(materialize(bad, "contaminated")), F.col("doc_id").eqNullSafe(F.col(doc)) & (F.xxhash64("text") == F.col(h)), "left_anti")
