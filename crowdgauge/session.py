"""Session helpers: one place that knows how this library wants Spark configured."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    # Texts cost far more work per byte than a scan does: read them in small splits.
    "spark.sql.files.maxPartitionBytes": "32m",
}


def local_session(cores: str | int = "*", shuffle_partitions: int = 8,
                  memory: str = "8g") -> SparkSession:
    """A local session for tests and the benchmark. On a cluster, submit with DEFAULTS instead."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("crowdgauge")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
    )
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the shared folder named by ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own; on a cluster a
    machine-local folder would be lost with its executor, so that case is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        configured = tempfile.mkdtemp(prefix="crowdgauge-checkpoint-")
    sc.setCheckpointDir(configured)
    return configured


def checkpointed(df):
    """Write ``df`` to the checkpoint folder and continue from there: short lineage, and a
    lost executor re-reads files instead of replaying the loop."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small_table(spark: SparkSession, rows, ddl: str):
    """Configuration rows as a local relation: its size is known to the planner, so Spark
    decides by itself whether to broadcast it."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL(ddl)
    names = schema.fieldNames()
    data = [dict(zip(names, row, strict=True)) for row in rows]
    return spark.createDataFrame(pa.Table.from_pylist(data, to_arrow_schema(schema)), schema)
