"""Benchmark decontamination by a prefix-filtered containment join over item-sized windows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, durable

WIDTH = 10
#: Windows in one broadcast; a larger benchmark is taken in blocks of this size, each joined with all documents.
BLOCK_WINDOWS = 200_000
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_GAP_OF_ANY_CASE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def item_words(text: Column) -> Column:
    """A-Z lower-cased words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of text in order; none for null."""
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), _GAP), lambda w: w != "")


def windows(items: DataFrame, width: int = WIDTH, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """The distinct windows of all items: ``__win`` (words) and ``__items`` (sorted ids, as strings, of its items)."""
    own = items.select(F.col(id_col).cast("string").alias("__item"), item_words(F.col(text_col)).alias("__iw")).where(F.size("__iw") > 0)
    span = F.least(F.lit(width), F.size("__iw"))
    each = own.select("__item", F.explode(F.transform(F.sequence(F.lit(1), F.size("__iw") - span + 1), lambda i: F.slice("__iw", i, span))).alias("__win"))
    return each.groupBy("__win").agg(F.sort_array(F.collect_set("__item")).alias("__items"))


def _index(wins: DataFrame, docs: DataFrame, text_col: str) -> DataFrame:
    """Windows filed under their rarest word: ``__token``, its place ``__off``, ``__len``, and the window.

    Words are ordered by how often they occur in all documents. Containment is exact and whole, so a window occurs only
    where each of its words does: the necessary prefix is one token, of any shingle width, and the rarest word makes
    few candidates without counts of longer shingles. A window with a word that no document holds is left out.
    """
    spots = wins.select("__win", F.posexplode("__win").alias("__off", "__token"))
    vocabulary = spots.select("__token").distinct()
    spoken = docs.select(F.explode(item_words(F.col(text_col))).alias("__token"))
    if vocabulary.count() <= BLOCK_WINDOWS * WIDTH:
        counts = spoken.join(F.broadcast(vocabulary), "__token", "left_semi").groupBy("__token").agg(F.count(F.lit(1)).alias("__df"))
    else:
        counts = spoken.groupBy("__token").agg(F.count(F.lit(1)).alias("__df")).join(vocabulary, "__token", "left_semi")
    ranked = spots.join(counts, "__token", "left").groupBy("__win").agg(F.min(F.struct(F.coalesce("__df", F.lit(0)).alias("df"), F.col("__token").alias("token"), F.col("__off").alias("off"))).alias("__first"))
    filed = ranked.where(F.col("__first.df") > 0).join(wins, "__win")
    return filed.select(F.col("__first.token").alias("__token"), F.col("__first.off").alias("__off"), F.size("__win").alias("__len"), "__win", "__items")


def matches(docs: DataFrame, items: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents with hits: id, __h (hash of the text), spans (word places, end exclusive, sorted) and items (sorted)."""
    filed = durable(_index(durable(windows(items, width)), docs, text_col))
    n = filed.count()
    blocks = max(1, -(-n // BLOCK_WINDOWS))
    said = docs.select(F.col(id_col).alias("__id"), F.xxhash64(text_col).alias("__h"), item_words(F.col(text_col)).alias("__w"))
    spoken = said.select("__id", "__h", "__w", F.posexplode("__w").alias("__pos", "__token"))

    def block(k: int) -> DataFrame:
        part = filed if blocks == 1 else filed.where(F.pmod(F.hash("__win"), F.lit(blocks)) == k)
        start = F.col("__pos") - F.col("__off")
        found = spoken.join(F.broadcast(part), "__token").where((start >= 0) & (start + F.col("__len") <= F.size("__w")))
        found = found.where(F.slice("__w", start + 1, F.col("__len")) == F.col("__win"))
        return found.select("__id", "__h", F.struct(start.alias("start"), (start + F.col("__len")).alias("end")).alias("span"), "__items")

    found = reduce(DataFrame.unionAll, [block(k) for k in range(blocks)])
    hits = found.groupBy("__id", "__h").agg(F.sort_array(F.collect_set("span")).alias("spans"), F.collect_set("__items").alias("items"))
    return hits.select("__id", "__h", "spans", F.sort_array(F.array_distinct(F.flatten("items"))).alias("items"))


def _covered(spans: Column) -> Column:
    """How many places the sorted spans cover together."""
    def add(acc: Column, s: Column) -> Column:
        more = F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], acc["reach"]))
        return F.struct((acc["total"] + more).alias("total"), F.greatest(acc["reach"], s["end"]).alias("reach"))

    return F.aggregate(spans, F.struct(F.lit(0).alias("total"), F.lit(0).alias("reach")), add)["total"]


def find(docs: DataFrame, items: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, n_words, n_hit, n_items, items, spans, contaminated.

    A word is hit if it lies in an occurrence of a window of an item: ``width`` consecutive words, or all words of a
    shorter item. Null and blank texts have no words and are clean; items without words have no window; a window of
    an item with a null id counts for hits, not for items. Repeated rows each get the same result; ids may repeat
    (rows are told apart by id and text). No documents, no rows; no items, no hits. Other columns are not read.
    """
    hits = matches(docs, items, width, id_col, text_col)
    base = docs.select(F.col(id_col).alias("__d"), F.xxhash64(text_col).alias("__dh"), F.size(F.filter(F.split(F.coalesce(text_col, F.lit("")), _GAP_OF_ANY_CASE), lambda w: w != "")).cast("long").alias("n_words"))
    out = base.join(hits, base["__d"].eqNullSafe(hits["__id"]) & (base["__dh"] == hits["__h"]), "left")
    ids = F.coalesce("items", F.array().cast("array<string>"))
    spans = F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>"))
    return out.select(
        F.col("__d").alias(id_col), "n_words", _covered(spans).cast("long").alias("n_hit"), F.size(ids).cast("long").alias("n_items"),
        ids.alias("items"), spans.alias("spans"), (F.size(spans) > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without any hit, as they came.

    Null and blank texts have no words and stay, as do all texts when there are no items; rows alike in id and text go
    or stay together; no documents, no rows. Texts are whole, however long; columns of the items do not clash.
    """
    hits = matches(docs, items, width, id_col, text_col).select("__id", "__h")
    return docs.join(hits, docs[id_col].eqNullSafe(hits["__id"]) & (F.xxhash64(docs[text_col]) == hits["__h"]), "left_anti")
