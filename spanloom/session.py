"""Session defaults and durable cut points for long plans."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: settings the jobs rely on; every one may also be set by the cluster
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    # stateful operators of live traces
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}

#: Before a join runs, Spark knows a table by the compressed size of its files, shared out among columns: 1 MB of that were up to 117 MB
#: of rows on the driver. So only tiny tables are sent to all executors on that ground; others by measured rows, while the join runs, and
#: also where these lie in few partitions: one row per trace joins rows of a single trace, which would all go to one task.
JOINS = {
    "spark.sql.autoBroadcastJoinThreshold": str(1 << 15),
    "spark.sql.adaptive.autoBroadcastJoinThreshold": str(2 << 20),
    "spark.sql.adaptive.nonEmptyPartitionRatioForBroadcastJoin": "0",
}

#: Settings of jobs on traces. Java never compiles a method over 8000 bytes; Spark then generates one method per expression instead.
TRACES = {**JOINS, "spark.sql.codegen.hugeMethodLimit": "8000"}

#: rows of a file whose lines cost much more to read than their few bytes tell
FILE_ROWS = 1 << 16


def build_session(app: str = "spanloom", master: str | None = None, **conf: str) -> SparkSession:
    """Build (or fetch) a session with the defaults above."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in {**DEFAULTS, **TRACES, **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def configure(spark: SparkSession, joins: dict[str, str] = TRACES) -> SparkSession:
    """Apply the defaults to a session made elsewhere."""
    for k, v in {**DEFAULTS, **joins}.items():
        spark.conf.set(k, v)
    return spark


def scratch_dir(spark: SparkSession) -> str:
    """Shared folder for intermediate tables: the cluster's ``spark.checkpoint.dir``.

    Only a local session that names none (tests, a laptop) gets a private folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        set_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = set_dir.get() if set_dir.isDefined() else None
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spanloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def cut(df: DataFrame, rows: int = 0) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    The plan runs once, its lineage ends, lost executors lose nothing, and later
    readers get column pruning and real sizes for join planning. The tables of one application lie in
    one folder below, which may be deleted when the application has ended. ``rows``: most rows of a file (0: any); files are
    dealt to tasks whole or in few pieces, however many rows they hold.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/spanloom-{spark.conf.get('spark.app.id', 'local')}/cut-{uuid.uuid4().hex}"
    df.write.option("maxRecordsPerFile", rows).option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
