"""From raw documents to training shards: five stages, each over all that its predecessor kept.

1. language: documents whose language can't be told go (no letters, or no language above the floor).
2. near_duplicates: one document of each class linked by 5-word shingle similarity of 0.8 or more stays, the smallest doc_id.
3. decontaminate: documents that hold a window of a benchmark item go.
4. mix: sources are brought to their target weights; a document stays as often as the mix takes it.
5. shards: every row gets its shard and slot by the keyed permutation.

Edge cases: null texts and texts without letters go at the first stage; null
doc_ids take part like others (a class keeps its smallest id, nulls last); of
rows that repeat, near_duplicates keeps one and mix may take it twice; rows with
equal doc_ids and different texts are judged apart; texts of any length are read
whole; ties are broken by id, then by place in the input; an empty table gives
an empty result; extra columns stay as they are, whatever their names, except
that shards replaces columns with the names of its outputs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm import decontam, langid, mixing, sharding, simhash
from quillgraph.llm.tables import table
from quillgraph.storage import materialize


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs, width=5, similarity=0.8)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.apply_mix(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = sharding.shard(docs)
    made = [F.col(c) for c in sharding.MADE]
    return rows.select(*(c for c in docs.columns if c not in sharding.MADE), *made)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("mix", mix), ("shards", shards)]

#: The first stage is a trained network, so SQL can't give the rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
