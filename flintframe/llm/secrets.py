"""Secret scans with an incremental ledger of content-addressed blobs."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import durable

LEDGER = T.StructType([
    T.StructField("blob", T.BinaryType()),
    T.StructField("rules", T.ArrayType(T.StringType())),
    T.StructField("findings", T.ArrayType(T.StructType([T.StructField("rule", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))),
])
#: Bits that tell which texts may have to be scanned: 8 MB in all, however many blobs there are.
FILTER_BITS = 1 << 26
_HEX = bytes(104 if chr(k) in "0123456789abcdef" else 32 for k in range(256))


@dataclass(frozen=True)
class Rule:
    """A kind of secret. hint: cheap test that is true of every text with a match; a match's group has least characters."""

    kind: str
    version: int
    pattern: str
    hint: Callable[[str, str], bool]
    group: int = 0
    least: int = 0

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


def _has_assign(text: str, lowered: str) -> bool:
    return any(k in lowered for k in ("passw", "secret", "token", "apikey", "api_key"))


def _has_hex(text: str, lowered: str) -> bool:
    return b"h" * 32 in text.encode("utf-8", "replace").translate(_HEX)


#: The base kinds come first, in the order in which spans that start alike are listed.
RULES = (
    Rule("assign", 1, r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", _has_assign, 1, 8),
    Rule("access", 1, r"AKIA[A-Z0-9]+", lambda text, lowered: "AKIA" in text, 0, 16),
    Rule("hex", 1, r"[0-9a-f]+", _has_hex, 0, 32),
    Rule("private_key", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", lambda text, lowered: "PRIVATE KEY-----" in text),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", lambda text, lowered: "eyJ" in text),
    Rule("forge_token", 1, r"gh[pousr]_[A-Za-z0-9]{36,}", lambda text, lowered: "gh" in text),
)
BASE = ("assign", "access", "hex")


def scan_text(text: str, rules: list[Rule]) -> list[tuple[str, int, int]]:
    """(rule key, start, end) of all matches, leftmost and not overlapping by kind; code points, end exclusive."""
    lowered = text.lower()
    found = []
    for r in rules:
        if r.hint(text, lowered):
            found += [(r.key, m.start(), m.end()) for m in re.finditer(r.pattern, text, re.ASCII) if len(m[r.group]) >= r.least]
    return found


def _scan(rules: tuple[Rule, ...]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        by_key = {r.key: r for r in rules}
        for batch in batches:
            found = [scan_text(text, [by_key[k] for k in todo]) for text, todo in zip(batch["text"], batch["rules"], strict=True)]
            batch["findings"] = [[{"rule": key, "start": a, "end": b} for key, a, b in own] for own in found]
            yield batch[["blob", "rules", "findings"]]

    return run


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger at path; made empty where there is none."""
    spark.createDataFrame([], LEDGER).write.mode("append").parquet(path)
    return spark.read.schema(LEDGER).parquet(path)


def _maybe(texts: DataFrame, todo: DataFrame) -> DataFrame:
    """The rows of texts whose (blob, path) may be in todo: all that are, and others as far as they share a bit of FILTER_BITS.

    The bits are small enough to be sent to every task, so texts of blobs that are known already never leave theirs.
    """
    bit = lambda path: F.pmod(F.xxhash64("blob", path), F.lit(FILTER_BITS)) + 1
    marks = todo.withColumn("__bit", bit("__one")).groupBy(F.bitmap_bucket_number("__bit").alias("__bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("__bit")).alias("__marks"))
    at = texts.withColumn("__bit", bit("__path"))
    at = at.withColumn("__bucket", F.bitmap_bucket_number("__bit")).withColumn("__at", F.bitmap_bit_position("__bit"))
    byte = F.conv(F.hex(F.substring("__marks", F.floor(F.col("__at") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    own = at.join(F.broadcast(marks), "__bucket").where(F.getbit(byte, (F.col("__at") % 8).cast("int")) == 1)
    return own.select(*texts.columns)


def scan(versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, path_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a version: path_col, blob (SHA-256 of the text) and findings (kind, start, end), sorted by start and rule order.

    The ledger (a Parquet folder all machines reach) holds which rule versions have scanned which blob, and what they
    found. Each blob that lacks a rule version is scanned by one of its copies and only by the rules it lacks; the
    rows are appended before findings are joined back to every path. A null text counts as empty; repeated rows and
    paths each get a row (a row that repeats with its path may be scanned again); no versions, no rows. Other columns
    are not read.

    What to scan is found on hashes and paths alone. Of the texts, only those that _maybe() lets through are moved to be
    scanned; with a ledger that knows all blobs, none. Blobs are told apart by content, so a text that fills a third
    of the table is scanned once.
    """
    spark = versions.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = versions.select(F.col(path_col).alias("__path"), F.unhex(F.sha2(text, 256)).alias("blob"), text.alias("text"))
    paths = durable(texts.select("__path", "blob"))
    known = read_ledger(spark, ledger).groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("__seen"))
    wanted = F.array(*[F.lit(r.key) for r in rules])
    todo = paths.groupBy("blob").agg(F.min(F.struct("__path")).alias("__one")).join(known, "blob", "left")
    todo = todo.select("blob", F.col("__one.__path").alias("__one"), F.array_except(wanted, F.coalesce("__seen", F.array().cast("array<string>"))).alias("rules")).where(F.size("rules") > 0)
    todo = durable(todo)
    texts = _maybe(texts, todo)
    todo = todo.withColumnRenamed("blob", "__blob").hint("shuffle_hash")
    unseen = texts.join(todo, (texts["blob"] == todo["__blob"]) & texts["__path"].eqNullSafe(todo["__one"]))
    unseen.select("blob", "text", "rules").mapInPandas(_scan(rules), LEDGER).write.mode("append").parquet(ledger)
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    place = lambda f: F.array_position(wanted, f["rule"]).cast("int")
    current = F.filter("findings", lambda f: place(f) > 0)
    ordered = F.transform(current, lambda f: F.struct(f["start"].alias("start"), place(f).alias("ord"), f["end"].alias("end"), F.element_at(kinds, place(f)).alias("kind")))
    found = read_ledger(spark, ledger).where(F.size("findings") > 0).groupBy("blob").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list(ordered)))).alias("findings"))
    empty = F.array().cast("array<struct<start:int,ord:int,end:int,kind:string>>")
    return paths.join(found, "blob", "left").select(F.col("__path").alias(path_col), "blob", F.coalesce("findings", empty).alias("findings"))


def spans(findings: Column, kinds: tuple[str, ...] | None = None) -> Column:
    """``kind:start:end`` of the findings (of some kinds), comma-joined."""
    own = findings if kinds is None else F.filter(findings, lambda f: f["kind"].isin(*kinds))
    return F.array_join(F.transform(own, lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string"))), ",")
