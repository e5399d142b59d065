"""Session defaults and table loading."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def session(master: str | None = None, **conf) -> SparkSession:
    """A session with what the operators rely on; a cluster's own settings win where they are set."""
    builder = SparkSession.builder.appName("weftline").config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if master:
        builder = builder.master(master)
    for k, v in conf.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: What may be broadcast: rows and bytes, both counted before.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 32 << 20


def if_small(rows: DataFrame) -> DataFrame:
    """``rows`` marked for broadcast if they were counted to be few and small; else as they are, for Spark to join by shuffling."""
    size = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length(F.to_json(F.struct(*rows.columns)))), F.lit(0)).alias("bytes")).collect()[0]
    return F.broadcast(rows) if size["n"] <= BROADCAST_ROWS and size["bytes"] <= BROADCAST_BYTES else rows


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is named and all run in one process."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="weftline-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def keep(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` written to the shared folder and read from there: worked out once however often they are read, and whatever executors get lost."""
    path = f"{shared_folder(rows.sparkSession)}/{name}-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
