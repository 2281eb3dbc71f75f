"""Token counts by source, language and tokenizer version, kept by deltas.

Every batch of changes (documents inserted, deleted, or counted anew) becomes a
signed delta of the totals: an insert adds a document and its tokens, a delete
takes away what the document counted, a revision adds the difference. Totals are
the sum of all committed deltas, so they are additive and a batch is never
worked through again.

What each document counts now stands in a ledger, one part per batch, newest
batch last; deltas are worked out against it, so a delete need not say what it
deletes. A batch commits by its number: ledger part and delta are written to a
folder of this attempt, and then one small marker naming that folder. A batch whose
marker is there is not applied again, and an attempt without a marker is not read.

Defined results: within a batch the change with the largest ``seq`` holds for a
document and tokenizer version, ties by operation, source, language and tokens;
inserting a document that is there revises it; revising one that is not inserts
it; deleting one that is not does nothing; null source or language is a group of
its own; a null doc_id is a document; null tokens are 0; an empty batch commits and
changes nothing; extra columns are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contexture.sources.storage import exists

KEY = ("doc_id", "version")
LEDGER = "doc_id bigint, version string, source string, lang string, tokens bigint, alive boolean, batch int"
DELTA = "source string, lang string, version string, documents bigint, tokens bigint"
MARKER = "batch int, attempt string"
GROUP = ("source", "lang", "version")


class Rollup:
    """The counts kept below ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _commits(self) -> list[tuple[int, str]]:
        """Batch and attempt of every commit: one small row each."""
        if not exists(self.spark, f"{self.path}/commits"):
            return []
        rows = self.spark.read.schema(MARKER).parquet(f"{self.path}/commits").collect()
        first: dict[int, str] = {}
        for row in sorted(rows, key=lambda row: (row["batch"], row["attempt"])):
            first.setdefault(row["batch"], row["attempt"])
        return sorted(first.items())

    def _parts(self, kind: str, schema: str) -> DataFrame:
        paths = [f"{self.path}/{kind}/{attempt}" for _, attempt in self._commits()]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)

    def ledger(self) -> DataFrame:
        """What each document counts now; one row for each it has ever counted."""
        return (
            self._parts("ledger", LEDGER)
            .groupBy(*KEY)
            .agg(F.max_by(F.struct("source", "lang", "tokens", "alive"), "batch").alias("now"))
            .select(*KEY, "now.*")
        )

    def commit(self, batch: int, changes: DataFrame) -> bool:
        """Applies ``changes`` (doc_id, version, source, lang, tokens, op, seq) once.

        ``op`` is insert, delete or revise. False if the batch was applied before.
        """
        if any(done == batch for done, _ in self._commits()):
            return False
        if any(done > batch for done, _ in self._commits()):
            raise ValueError(f"batch {batch} comes after one that is committed")
        attempt = f"{batch:09d}-{uuid.uuid4().hex}"
        new = changes.select(
            F.col("doc_id").cast("bigint").alias("doc_id"),
            F.col("version").cast("string").alias("version"),
            F.struct(
                "seq",
                "op",
                F.col("source").cast("string").alias("source"),
                F.col("lang").cast("string").alias("lang"),
                F.coalesce(F.col("tokens").cast("bigint"), F.lit(0)).alias("tokens"),
            ).alias("change"),
        )
        new = new.groupBy(*KEY).agg(F.max("change").alias("change")).alias("n")
        old = self.ledger().alias("o")
        same = F.col("n.doc_id").eqNullSafe(F.col("o.doc_id")) & F.col("n.version").eqNullSafe(
            F.col("o.version")
        )
        alive = F.col("change.op") != "delete"
        rows = new.join(old, same, "left").select(
            "n.doc_id",
            "n.version",
            *(
                F.when(alive, F.col(f"change.{name}")).otherwise(F.col(f"o.{name}")).alias(name)
                for name in ("source", "lang")
            ),
            F.when(alive, F.col("change.tokens")).otherwise(F.lit(0)).alias("tokens"),
            alive.alias("alive"),
            F.lit(batch).alias("batch"),
            F.struct(
                F.col("o.source").alias("source"),
                F.col("o.lang").alias("lang"),
                F.col("o.tokens").alias("tokens"),
                F.coalesce(F.col("o.alive"), F.lit(False)).alias("alive"),
            ).alias("was"),
        )
        ledger = f"{self.path}/ledger/{attempt}"
        rows.write.parquet(ledger)
        rows = self.spark.read.schema(rows.schema).parquet(ledger)
        sign = F.expr("array(named_struct('on', alive, 'by', 1L), named_struct('on', was.alive, 'by', -1L))")
        signed = rows.withColumn("sign", F.explode(sign)).where("sign.on")
        side = lambda name: F.when(F.col("sign.by") > 0, F.col(name)).otherwise(
            F.col(f"was.{name}")
        )
        delta = (
            signed.select(
                side("source").alias("source"),
                side("lang").alias("lang"),
                "version",
                F.col("sign.by").alias("documents"),
                (F.col("sign.by") * side("tokens")).alias("tokens"),
            )
            .groupBy(*GROUP)
            .agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
        )
        delta.write.parquet(f"{self.path}/delta/{attempt}")
        marker = self.spark.createDataFrame([(batch, attempt)], MARKER)
        marker.coalesce(1).write.mode("append").parquet(f"{self.path}/commits")
        return True

    def totals(self) -> DataFrame:
        """Documents and tokens by source, language and version, from the deltas alone."""
        sums = self._parts("delta", DELTA).groupBy(*GROUP)
        sums = sums.agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
        return sums.where("documents <> 0 OR tokens <> 0")


def replayed(rollup: Rollup, batches: list[Callable[[], DataFrame]]) -> DataFrame:
    """The totals after all batches, each delivered twice."""
    for number, changes in enumerate(batches):
        rollup.commit(number, changes())
        rollup.commit(number, changes())
    return rollup.totals()
