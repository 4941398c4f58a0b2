"""The corpus pipeline: stages that each take and return documents.

Each function takes (spark, docs, sf_dir). All but the last return the columns of
``documents``; the last adds shard and slot. Further columns, whatever their names, are
carried along. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import stored
from quire.llm.decontaminate import without_contaminated
from quire.llm.language_id import with_language
from quire.llm.mixing import WEIGHTS, document_path, mix
from quire.llm.near_text import one_of_each_group
from quire.llm.sharding import shuffle_into_shards

#: Share of all tokens that the mix takes. Weights that the sources can't meet are
#: made up for by their siblings.
SHARE = 0.8
SHARDS = 40


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; ``lang`` becomes that language.

    Null and empty texts, and those without letters, have none and go, as do all where no row
    has both an id and a language to learn from. Null ids and languages are no reason to go.
    Very long texts are read whole; repeated rows are judged alike.
    """
    rows = with_language(docs, docs.columns).where("accepted")
    return rows.select(*[(F.col("lang_pred") if c == "lang" else F.col("rec")[c]).alias(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8).

    The one with the smallest id stays; of several texts under it, or where all ids are null, the
    text of the smallest hash. Rows that repeat a kept id and text stay; so do null and empty
    texts and those without words. Very long texts are compared whole.
    """
    return one_of_each_group(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage.

    Null and empty texts hold none and stay; very long ones are searched whole. Repeated rows
    are judged alike; ids play no part.
    """
    return without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the weighted mix, each at most once.

    A document of which the mix takes some tokens stays whole. Null and empty texts have no
    tokens and go. Null languages and sources are groups of their own. Rows alike in id and
    text stay or go together. Ties of the seeded order go by id and text.
    """
    used = mix(docs, document_path(), WEIGHTS, share=SHARE, max_epochs=1).select("doc_id", "text_key").distinct()
    left = docs.select(F.struct(*docs.columns).alias("rec"), F.xxhash64("text").alias("own"))
    return left.join(used, left["rec.doc_id"].eqNullSafe(used["doc_id"]) & (left["own"] == used["text_key"]), "left_semi").select("rec.*")


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with shard and slot in a random order, and the shard files behind them.

    Null ids, null and empty texts and repeated rows are records like any others.
    """
    return shuffle_into_shards(docs, SHARDS)


STAGES = [
    ("language id", language_id),
    ("simhash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("mixing to weights", mixing),
    ("sharding", sharding),
]
#: SQL can express neither the classifier nor the fingerprints.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
