"""Cutting lineage of iterative plans: tables in the folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def shared_dir(spark) -> str:
    """spark.checkpoint.dir; where it is unset, as in tests, a local folder if all runs on one machine."""
    context = spark.sparkContext
    where = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = os.path.join(tempfile.gettempdir(), "palimpsest-shared")
    return where.rstrip("/")


def cut(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again; a lost executor costs nothing of it."""
    path = f"{shared_dir(df.sparkSession)}/{df.sparkSession.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Members of a class that stand in one row.
MEMBERS = 1024


def members(df: DataFrame, key: str, item: str, most: int = MEMBERS) -> DataFrame:
    """(key, <item>s): the items of each key in rows of about `most`, however many it has; stored."""
    sizes = df.groupBy(key).agg(F.ceil(F.count("*") / most).alias("_rows"))
    rows = df.join(sizes, key).groupBy(key, F.pmod(F.xxhash64(item), "_rows").alias("_row")).agg(F.collect_list(item).alias(f"{item}s"))
    return cut(rows.select(key, f"{item}s"), "members")
