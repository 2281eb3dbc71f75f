"""Session settings and the shared folder used for written tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

ROCKSDB_PROVIDER = (
    "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
)

# Runtime SQL settings. Safe to apply to a session that already exists.
SQL_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Splits a hot join key (a third of all incidents at one instant, say)
    # into many tasks by measured shuffle size.
    "spark.sql.adaptive.skewJoin.enabled": "true",
}

# Settings of the Python side: no call site is recorded per column expression.
PYTHON_CONF = {"spark.python.sql.dataFrameDebugging.enabled": "false"}

# Settings of stateful queries. State lives off-heap and on local disk, and a
# checkpoint uploads the changelog instead of whole snapshots.
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": ROCKSDB_PROVIDER,
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


# Settings of the context itself. Beyond 2000 shuffle partitions a map task
# reports block sizes as an average, which would hide a hot key from the skew
# handling; blocks this many times the median are reported as they are.
CORE_CONF = {"spark.shuffle.accurateBlockSkewedFactor": "5.0"}


def build_session(
    app_name: str, master: str | None = None, conf: dict[str, str] | None = None
) -> SparkSession:
    """A session with the settings above; ``conf`` overrides them."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {**CORE_CONF, **SQL_CONF, **PYTHON_CONF, **STATE_CONF, **(conf or {})}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def pin_utc(spark: SparkSession) -> SparkSession:
    """Event time is UTC everywhere; a local zone would shift every bucket."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def state_session(spark: SparkSession, partitions: int | None = None) -> SparkSession:
    """A sibling session for stateful queries, leaving the caller's settings alone.

    The number of state partitions is fixed by a query's first run. Unless
    given, it is the number of cores there are now; give it where executors may
    still be on their way.
    """
    session = spark.newSession()
    for key, value in {**SQL_CONF, **STATE_CONF}.items():
        session.conf.set(key, value)
    count = partitions or max(1, spark.sparkContext.defaultParallelism)
    session.conf.set("spark.sql.shuffle.partitions", str(count))
    return session


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh path in the folder all executors share.

    That is ``spark.checkpoint.dir``, or what the context was told instead.

    Only a local master may do without the setting: there driver and executors
    are one machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    root = root or spark.sparkContext.getCheckpointDir()
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local"):
            raise ValueError(
                "set spark.checkpoint.dir to a folder that all executors share"
            )
        root = tempfile.mkdtemp(prefix="contexture-")
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
