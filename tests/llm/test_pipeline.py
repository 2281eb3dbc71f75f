import pyarrow as pa

import corpus_pipeline
from contexture.llm import queries, toxicity, words
from contexture.llm.tables import written
from tests.compare import oracle_connection, spark_rows, sql_rows
from tests.conftest import TESTDATA
from tests.llm import test_decontaminate, test_mixing, test_ngram_join, test_token_store
from tests.llm.helpers import SCHEMA

SF = TESTDATA / "sf0.001"


def test_stages_do_what_they_say(spark):
    """Every stage on all its predecessor kept, against brute force on its input."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    names = [part.split()[0] for part in SCHEMA.split(", ")]
    for name, stage in corpus_pipeline.STAGES:
        before = [tuple(r) for r in docs.select(names).collect()]
        docs_before = docs
        docs = written(stage(spark, docs, str(SF)), f"test-{name}")
        if name == "token_binary":
            path = queries.token_store.default_tokenizer()
            found = sorted((tuple(r) for r in docs.collect()), key=repr)
            assert found == test_token_store.brute(before, path)
            return
        assert docs.columns == names
        after = [tuple(r) for r in docs.collect()]
        assert set(after) <= set(before)
        if name == "toxicity":
            labels = spark.read.parquet(f"{SF}/labels.parquet")
            model = toxicity.train(docs_before, labels, held_out=queries.held_out())
            scores = [model.scores(*words.text_bytes(pa.array([r[1]], pa.string())))[0] for r in before]
            clean = [r for r, score in zip(before, scores, strict=True) if score < 0.5]
            assert sorted(after, key=repr) == sorted(clean, key=repr)
            assert len(clean) < len(before)
        if name == "mixing":
            share, epochs, seed = corpus_pipeline.SHARE, corpus_pipeline.EPOCHS, queries.SEED
            mix = test_mixing.brute(before, share, epochs, seed, queries.WEIGHTS)
            assert sorted(r[0] for r in after) == sorted(r[0] for r in mix)
        if name == "ngram_jaccard_join":
            kept = {c for *_, c in test_ngram_join.brute(before)}
            assert sorted(r[0] for r in after) == sorted(kept)
        if name == "benchmark_decontamination":
            clean = {r[0] for r in test_decontaminate.brute(before, items) if not r[-1]}
            assert sorted(r[0] for r in after) == sorted(clean)


def test_queries_equal_their_sql(spark):
    con = oracle_connection(SF)
    for name, sql in queries.ORACLE.items():
        assert spark_rows(queries.QUERIES[name](spark, str(SF))) == sql_rows(con, sql), name
