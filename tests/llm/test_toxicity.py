import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from contexture.llm import queries, toxicity, words
from tests.conftest import TESTDATA
from tests.llm.helpers import awkward, frame, prose

SF = TESTDATA / "sf0.1"

INSULTS = ["blockhead", "numbskull", "dimwit"]


def labelled(count=600):
    texts, toxic = [], []
    for k in range(count):
        own = prose(k, 60).split()
        if k % 2:
            own[10:10] = [INSULTS[k // 2 % 3]]
            own[40:40] = [INSULTS[k // 3 % 3]]
        texts.append(" ".join(own))
        toxic.append(k % 2)
    return texts, toxic


@pytest.fixture(scope="module")
def model():
    return toxicity.fit(*labelled())


def scores(model, texts):
    return model.scores(*words.text_bytes(pa.array(texts, pa.string())))


def test_unseen_texts_are_told_apart(model):
    clean = [prose(1000 + k, 200) for k in range(50)]
    bad = [f"{text[:300]} dimwit {text[300:]}" for text in clean]
    assert (scores(model, clean) < 0.5).mean() >= 0.95
    assert (scores(model, bad) >= 0.5).mean() >= 0.95


@pytest.mark.parametrize("said", ["b.l.o.c.k.h.e.a.d", "b l o c k h e a d", "BLOCKhead", "bloxckhead", "block-head"])
def test_gaps_and_inserted_characters_are_tolerated(model, said):
    assert scores(model, [f"{prose(7, 30)} {said} {prose(8, 30)}"])[0] >= 0.5


def test_awkward_texts_have_scores(model):
    found = scores(model, [None, "", " ", "a", prose(1, 40_000), "é" * 100_000])
    assert np.isfinite(found).all() and ((found >= 0) & (found <= 1)).all()
    assert found[0] == found[1] == found[2]


def test_kernel_table_is_the_kernel():
    """The table gives the same as subsequences counted one by one."""
    raw, offsets = words.text_bytes(pa.array(["abcdxe"]))
    coded = toxicity.Coded.of(raw, offsets)
    table = np.zeros(1 << 20, dtype=np.float32)
    for at, value in toxicity._features("abcde").items():
        table[at] = value
    expected = sum(v * toxicity._features("abcde").get(k, 0) for k, v in toxicity._features("abcdxe").items())
    assert toxicity._scan(coded.codes, table).sum() == pytest.approx(expected, rel=1e-5)


def test_rows_pass_through_and_labels_are_not_inputs(spark, model):
    docs = frame(spark, awkward()).withColumn("score", F.lit("mine"))
    found = toxicity.scored(docs, model, score="score")
    assert found.columns == [*docs.columns, "score_"] and found.count() == len(awkward())


def test_training_leaves_out_what_is_held_out(spark):
    docs = frame(spark, awkward())
    labels = spark.createDataFrame([(k, 1, k % 2) for k in range(12)] + [(None, 1, 1), (3, 0, None)], "doc_id bigint, quality int, toxic int")
    held = F.col("doc_id") % 3 == 0
    rows = toxicity.training_rows(docs, labels, max_docs=2, held_out=held).collect()
    assert all(r["doc_id"] % 3 for r in rows) and sum(r["toxic"] for r in rows) <= 2


def test_without_labels_nothing_is_toxic(spark):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    docs = frame(spark, awkward())
    assert toxicity.clean(docs, labels).count() == len(awkward())
    assert toxicity.clean(frame(spark, []), labels).collect() == []


def test_the_sample_is_of_documents_with_a_text_and_fits_its_characters(spark):
    """Labels without documents, null texts and texts without room do not shrink it."""
    rows = [(k, "w" * (10 + k % 5), "en", "a", 1) for k in range(200)]
    rows += [(500, None, "en", "a", 1), (501, "x" * 5000, "en", "a", 1), (None, "y", "en", "a", 1)]
    labels = [(k, 1, k % 2) for k in range(200)] + [(k, 1, 1) for k in range(500, 900)]
    labels = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    docs = frame(spark, rows)
    found = toxicity.training_rows(docs, labels, max_docs=10).collect()
    assert sum(r["toxic"] for r in found) == 10 and len(found) == 70
    found = toxicity.training_rows(docs, labels, max_docs=10, max_chars=400).collect()
    assert all(len(r["text"]) < 5000 for r in found)
    for kind, room in ((0, 300), (1, 100)):
        used = sum(len(r["text"]) for r in found if r["toxic"] == kind)
        assert room - 15 < used <= room


def test_whole_long_texts_are_learnt_from(spark):
    long = prose(3, 30_000)
    labels = spark.createDataFrame([(1, 1, 1), (2, 1, 0)], "doc_id bigint, quality int, toxic int")
    docs = frame(spark, [(1, long, "en", "a", 1), (2, prose(4, 5), "en", "a", 1)])
    found = {r["toxic"]: r["text"] for r in toxicity.training_rows(docs, labels).collect()}
    assert found[1] == long and len(long) > 65_536


def test_one_class_alone_warns(spark):
    labels = spark.createDataFrame([(0, 1, 0), (1, 1, 0)], "doc_id bigint, quality int, toxic int")
    docs = frame(spark, awkward())
    with pytest.warns(UserWarning, match="both classes"):
        found = toxicity.scored(docs, toxicity.train(docs, labels))
    assert all(0 <= r["score"] < 1e-200 for r in found.collect())


def test_margin_of_a_text_is_that_of_its_worst_word(model):
    """A text scores like the worst of its words, each scored with what follows it."""
    text = f"{prose(70, 40)} numbskull {prose(71, 40)}"
    parts = text.split(" ")
    alone = [scores(model, [" ".join(parts[k:])])[0] for k in range(len(parts))]
    assert scores(model, [text])[0] == pytest.approx(max(alone), abs=1e-6)


def test_held_out_rows_are_told_apart(spark):
    """The query on whole tables, held against labels it has not seen.

    On these tables 71 of 83 toxic rows were found, and 67 of 742 others taken for toxic.
    """
    found = queries.op4_toxicity(spark, str(SF)).where("held_out")
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic")
    rows = found.join(labels, "doc_id").where("toxic IN (0, 1)").collect()
    said = {kind: [r["predicted"] for r in rows if r["toxic"] == kind] for kind in (0, 1)}
    assert len(said[1]) > 50 and np.mean(said[1]) >= 0.8
    assert len(said[0]) > 500 and np.mean(said[0]) <= 0.12


def test_the_fit_holds_few_copies_of_its_examples():
    import tracemalloc

    rng = np.random.default_rng(1)
    z = rng.standard_normal((20_000, 129)).astype(np.float32)
    z[:, -1] = 1
    y = np.where(z[:, 0] + rng.standard_normal(len(z)) > 0, 1.0, -1.0)
    tracemalloc.start()
    w = toxicity._machine(z, y, np.ones(len(y)), 0.001, None)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.mean((z @ w > 0) == (y > 0)) > 0.7
    # The rows within the margin as they are, weighted, and that in double precision.
    assert peak < 4.5 * z.nbytes


def test_words_are_summed_alike_in_parts(monkeypatch):
    raw, offsets = words.text_bytes(pa.array(["you are an idiot, i d i o t", "", None, "fine day"] * 20))
    coded = toxicity.Coded.of(raw, offsets)
    table = np.random.default_rng(1).random(1 << 20).astype(np.float32)
    whole = coded.sums(table)
    monkeypatch.setattr(toxicity, "_PART", 16)
    assert len(list(coded.parts())) > 20
    assert (coded.sums(table) == whole).all()
