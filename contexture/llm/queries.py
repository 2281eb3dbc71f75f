"""The operators over the given tables, as named queries, and SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contexture.llm import (
    chat,
    decontaminate,
    licenses,
    mixing,
    ngram_join,
    repair,
    search,
    spelling,
    sql,
    token_counts,
    token_store,
    toxicity,
    vector_dedup,
    warc,
)
from contexture.llm.tables import table, written
from contexture.session import shared_dir

#: Words of letters, digits and everything beyond ASCII.
ALNUM_WORDS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

Query = Callable[[SparkSession, str], DataFrame]


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scanned(table(spark, sf_dir, "documents"))


def held_out() -> Column:
    """Rows that no label is learnt from."""
    return F.crc32(F.col("doc_id").cast("string")) % 5 == 0


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), held_out=held_out())
    return toxicity.scored(docs, model).select(
        "doc_id",
        held_out().alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.archived(table(spark, sf_dir, "pages"))
    return found.select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["conv_id", "turn", "role", "text"]
    turns = table(spark, sf_dir, "conversations").select(names)
    return chat.formatted(turns.unionByName(chat.control_conversation(spark)))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after four batches, each delivered twice.

    All documents are inserted with their blank-separated words (``words``), these
    counts are revised to words of letters and digits, the same documents are
    inserted with their characters (``chars``), and exact copies of a document
    with a smaller doc_id are deleted under both.
    """
    docs = table(spark, sf_dir, "documents")
    counted = written(
        docs.select(
            "doc_id",
            "source",
            "lang",
            F.md5(F.coalesce("text", F.lit(""))).alias("print"),
            mixing.token_count().alias("blank"),
            F.coalesce(F.regexp_count("text", F.lit(ALNUM_WORDS)), F.lit(0)).alias("alnum"),
            F.coalesce(F.char_length("text"), F.lit(0)).alias("chars"),
        ),
        "counted",
    )
    first = counted.groupBy("print").agg(F.min("doc_id").alias("first"))
    copies = counted.join(first, "print").where("doc_id > first")

    def change(rows: DataFrame, version: str, tokens: str, op: str) -> DataFrame:
        return rows.selectExpr(
            "doc_id",
            f"'{version}' AS version",
            "source",
            "lang",
            f"CAST({tokens} AS BIGINT) AS tokens",
            f"'{op}' AS op",
            "0 AS seq",
        )

    batches = [
        lambda: change(counted, "words", "blank", "insert"),
        lambda: change(counted, "words", "alnum", "revise"),
        lambda: change(counted, "chars", "chars", "insert"),
        lambda: change(copies, "words", "alnum", "delete").unionByName(
            change(copies, "chars", "chars", "delete")
        ),
    ]
    return token_counts.replayed(
        token_counts.Rollup(spark, shared_dir(spark, "token-counts")), batches
    )


#: Targets of the mix: names without a weight have 1.
WEIGHTS = {
    "domain": {"a": 5, "b": 3, "c": 2},
    "language": {"en": 4, "de": 2, "es": 2, "fr": 2},
}
SHARE = 0.75
EPOCHS = 2
SEED = "mix"


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    own = mixing.with_leaves(docs, mixing.source_family(), mixing.token_count())
    own = written(own.drop("_row"), "counted")
    return mixing.mixed(own, own, WEIGHTS, SHARE, EPOCHS, SEED).selectExpr(
        "doc_id",
        "epoch",
        "_domain AS domain",
        "_language AS lang",
        "_origin AS source",
        "_tokens AS tokens",
    )


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = decontaminate.build_index(table(spark, sf_dir, "documents"))
    wanted = decontaminate.windows(table(spark, sf_dir, "benchmark"))
    found = decontaminate.hits(index, wanted)
    return decontaminate.summary(found, wanted).drop("doc_print")


def benchmark_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with all words of a benchmark window within a few words of each other."""
    return decontaminate.proximity(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    )


def op1_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.stored(table(spark, sf_dir, "documents"), token_store.default_tokenizer())


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.linked(table(spark, sf_dir, "documents"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op12_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.linked(table(spark, sf_dir, "embeddings"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repaired(repair.damaged(table(spark, sf_dir, "conversations")))


QUERIES: dict[str, Query] = {
    "op1_token_binary": op1_token_binary,
    "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
    "op3_license_scan": op3_license_scan,
    "op4_toxicity": op4_toxicity,
    "op5_exact_top_k": op5_exact_top_k,
    "op6_mixing": op6_mixing,
    "op7_chat_format": op7_chat_format,
    "op8_warc": op8_warc,
    "op9_token_counts": op9_token_counts,
    "op10_benchmark_decontamination": op10_benchmark_decontamination,
    "benchmark_proximity": benchmark_proximity,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_vector_dedup": op12_vector_dedup,
    "op13_conversation_repair": op13_conversation_repair,
}

ORACLE: dict[str, str] = {
    "op2_ngram_jaccard_join": sql.NGRAM_JACCARD_JOIN,
    "op5_exact_top_k": sql.EXACT_TOP_K,
    "op7_chat_format": sql.CHAT_FORMAT,
    "op8_warc": sql.WARC,
    "op9_token_counts": sql.TOKEN_COUNTS,
    "op10_benchmark_decontamination": sql.BENCHMARK_DECONTAMINATION,
    "op11_spelling_variants": sql.SPELLING_VARIANTS,
    "op12_vector_dedup": sql.VECTOR_DEDUP,
    "op13_conversation_repair": sql.CONVERSATION_REPAIR,
    "op6_mixing": sql.mixing(WEIGHTS, SHARE, EPOCHS, SEED),
}
