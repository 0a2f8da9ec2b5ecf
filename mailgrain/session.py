"""Session settings and the few session-level helpers the operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

ARROW_BYTES = 8 << 20
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"

# Settings the operators are planned for.  None of them is required for right
# results except the UTC time zone, which every hour/weekday feature reads.
RECOMMENDED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a hot join key even when the aggregate above it must shuffle again
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # texts may be long: an Arrow batch is 10,000 rows otherwise, and Python holds several copies of it
    "spark.sql.execution.arrow.maxBytesPerBatch": str(ARROW_BYTES),
    "spark.sql.parquet.filterPushdown": "true",
}


def build_session(app_name: str = "mailgrain", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the recommended settings; ``conf`` entries win over them."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**RECOMMENDED_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def bound_batches(spark: SparkSession) -> None:
    """Bound the bytes of the Arrow batches that Python gets, unless the session does so."""
    if spark.conf.get(_BATCH_BYTES, None) in (None, str((1 << 63) - 1), f"{(1 << 63) - 1}b", "-1"):
        spark.conf.set(_BATCH_BYTES, str(ARROW_BYTES))


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Make ``DataFrame.checkpoint`` usable.

    The shared folder named by ``spark.checkpoint.dir`` always wins.  Only a
    single-JVM session that names none gets a temporary folder; on a cluster a
    missing setting is an error, because a machine-local folder is lost with
    its executor.
    """
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
    if shared:
        context.setCheckpointDir(shared)
    elif context.master.startswith("local") and not context.master.startswith("local-cluster"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="mailgrain-checkpoint-"))
    else:
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint of ``df`` in the shared checkpoint folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def settled(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back, for loops.

    A checkpointed frame keeps what Spark knows about its columns (the constraints of its plan).  Where each round joins
    frames of the round before, these multiply and planning takes longer than the work; a table of files has none.
    """
    path = shared_folder(df.sparkSession, "settled")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Round-robin a table whose files may be single row groups, which no scan can split."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def loose(lookup: DataFrame) -> DataFrame:
    """A grouped lookup that meets its join by a shuffle of its own.

    The partitioning of an aggregate satisfies a join on its key; the join then has no exchange on that side, and
    adaptive execution cannot duplicate the lookup for the pieces of a hot key.  Dealing out the (small) lookup once
    more frees the join, so a key with a third of the large side is split over many tasks.
    """
    return lookup.hint("rebalance")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name below the checkpoint folder, reachable by all executors."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
