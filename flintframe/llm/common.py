"""Helpers shared by the training-data operators."""

from __future__ import annotations

import string
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WHITESPACE = "[\\x20\\x09-\\x0D]+"
_BLANKS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, read lazily so that only used columns are scanned."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all machines share: spark.checkpoint.dir; where it is unset on one machine (tests), a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        folder = tempfile.mkdtemp(prefix="flintframe-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def durable(df: DataFrame) -> DataFrame:
    """df computed once and kept in the shared folder, so a lost executor costs no recomputation of what came before."""
    spark = df.sparkSession
    folder = shared_dir(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


class Scratch:
    """Intermediate tables as compressed Parquet in the shared folder; each goes when nothing needs it any more."""

    def __init__(self, spark: SparkSession) -> None:
        self._spark, self._folder, self._made = spark, f"{shared_dir(spark)}/work-{uuid.uuid4().hex}", 0

    def keep(self, df: DataFrame) -> DataFrame:
        """df written and read again."""
        self._made += 1
        path = f"{self._folder}/{self._made}"
        df.write.parquet(path)
        made = self._spark.read.schema(df.schema).parquet(path)
        made._scratch = path
        return made

    def drop(self, *tables: DataFrame) -> None:
        """Delete what keep() has written for these tables."""
        for df in tables:
            path = self._spark._jvm.org.apache.hadoop.fs.Path(df._scratch)
            path.getFileSystem(self._spark._jsc.hadoopConfiguration()).delete(path, True)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once; Catalyst would otherwise inline it into every use, lambdas included."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ascii_lower(text: Column) -> Column:
    """text with A-Z lower-cased and every other character left alone."""
    ascii_only = F.length(text) == F.octet_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def words(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of text in order; an empty array for null or blank text."""
    return let(
        F.btrim(F.coalesce(text, F.lit("")), F.lit(_BLANKS)),
        lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, WHITESPACE)),
    )
