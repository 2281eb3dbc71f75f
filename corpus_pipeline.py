"""From raw documents to a training set of token ids, stage by stage.

Each stage takes all rows its predecessor kept, and its result is written as
Parquet and read again before the next one begins. All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from contexture.llm import decontaminate, mixing, ngram_join, queries, token_store, toxicity
from contexture.llm.tables import table, written

#: Tokens of the mix, as a share of what came in; a source may be seen twice.
SHARE = 1.0
EPOCHS = 2


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5 for toxicity."""
    return toxicity.clean(docs, table(spark, sf_dir, "labels"), held_out=queries.held_out())


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by n-gram Jaccard similarity."""
    return ngram_join.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents to the target weights; one seen twice is there twice."""
    return mixing.mix_documents(docs, queries.WEIGHTS, SHARE, EPOCHS, queries.SEED)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' places in the binary store, read back through its index."""
    return token_store.stored(docs, token_store.default_tokenizer()).drop("shard")


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("token_binary", token_ids),
]

#: The toxicity model is no SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
