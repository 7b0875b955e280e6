"""Session and table access shared by queries, tests and the bench."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def local_session(cpus: str | int = 8, memory: str = "12g", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("formloom")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; the schema comes from parquet, pruning from Catalyst."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def dealt(df: DataFrame, key: str, rows_per_task: int = 20_000, counted: DataFrame | None = None) -> DataFrame:
    """Narrow rows dealt by ``key`` over the tasks before they grow, so that no later group by that key moves what they grew into.

    A count of its own, because Spark would put the few bytes of such rows together into one task; ``counted`` has as
    many rows as ``df`` where that is a join. Sides that are counted alike meet by ``key`` where they are.
    """
    rows = (df if counted is None else counted).count()
    tasks = max(2 * df.sparkSession.sparkContext.defaultParallelism, -(-rows // rows_per_task))
    return df.repartition(tasks, key)


def joined_within(rows: DataFrame, side: DataFrame, record: str, field: str) -> DataFrame:
    """``rows`` with the columns of ``side`` for the same record and field, a left join.

    Both meet by the record alone, whose fields of ``side`` are one array: rows
    dealt by record stay where they are, which a join on both columns would move.
    """
    rest = [c for c in side.columns if c not in (record, field)]
    held = side.groupBy(record).agg(F.collect_list(F.struct(field, *rest)).alias("__side"))
    same = F.filter("__side", lambda x: x[field] == F.col(field))
    met = rows.join(held, record, "left").withColumn("__met", F.explode_outer(same))
    return met.select(*rows.columns, *[F.col(f"__met.{c}").alias(c) for c in rest])


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared checkpoint folder of the session.

    Only where driver and executors are one process (tests) may that folder be
    unset; a temporary one is used then.
    """
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-shared-"))
    return df.checkpoint()
