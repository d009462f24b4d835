"""A training corpus from raw documents: five stages, each written and read again as the next one's documents."""

from __future__ import annotations

import uuid

from flintframe.llm import decontaminate, jaccard, mixing, sharding, toxicity
from flintframe.llm.common import shared_dir, table
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest labelled examples do not call toxic.

    Null and blank texts are judged as examples of that sort are; texts are whole; repeated rows stay or go together;
    without labels all stay; no documents, no rows. Columns of the labels do not clash.
    """
    index = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return docs.withColumn("__r", toxicity.judged(F.col("text"), index)).where("__r.predicted = 0").drop("__r")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links by five-word shingles at a similarity of 0.8: the one with the smallest id.

    Texts without words (null, blank) all stay; of rows alike in id and text one stays; a null id comes last.
    """
    return jaccard.representatives(docs, width=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item; null and blank texts hold none."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mix: source blocks interleave to their target weights.

    A null source counts with those without a weight; repeated rows have places of their own.
    """
    placed = mixing.mix(docs)
    return placed.repartitionByRange("position").sortWithinPartitions("position").select(*docs.columns)


def place_on_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their slot and shard, by id (without one, by their other columns); columns of these names are replaced."""
    return sharding.assign_shards(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("jaccard_join", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("source_mixing", mix_sources),
    ("sharding", place_on_shards),
]

#: No SQL gives the toxicity stage; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is kept as Parquet in the shared folder.

    The result has the place of each row in the mix (mix_source, block, position) beside its slot and shard: files
    are read in no order, so the order of rows says nothing. Placing again gives what the mixing stage sorted by.
    """
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/corpus-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return STAGES[-1][1](spark, mixing.mix(docs).drop("phase", "slot"), sf_dir)
