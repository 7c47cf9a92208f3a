"""Writers. None reads and overwrites one path: rows go to a staging folder first."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _rename(df: DataFrame, old: str, new: str) -> None:
    """Puts old in the place of new. What was there is moved aside first and deleted last,
    so one of the two is whole at any time."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    src, dst, aside = (jvm.org.apache.hadoop.fs.Path(x) for x in (old, new, f"{new.rstrip('/')}.old-{uuid.uuid4().hex}"))
    fs = dst.getFileSystem(conf)
    before = fs.exists(dst)
    if before and not fs.rename(dst, aside):
        raise OSError(f"{new} can't be moved aside")
    if not fs.rename(src, dst):
        if before:
            fs.rename(aside, dst)
        raise OSError(f"{old} can't be moved to {new}")
    if before:
        fs.delete(aside, True)


def replace_parquet(df: DataFrame, path: str) -> None:
    """Overwrites a folder that df itself may be read from."""
    staged = f"{path.rstrip('/')}.staged-{uuid.uuid4().hex}"
    df.write.parquet(staged)
    _rename(df, staged, path)


def vocab_json(words: DataFrame, meta: DataFrame, path: str) -> None:
    """One JSON document for each work: metadata, and words in id order."""
    cols = [c for c in words.columns if c != "work_id"]
    lists = words.groupBy("work_id").agg(F.sort_array(F.collect_list(F.struct(*cols))).alias("words"))
    fields = [c for c in meta.columns if c != "work_id"]
    meta.select("work_id", F.struct("work_id", *fields).alias("metadata")).join(lists, "work_id").write.partitionBy("work_id").mode("overwrite").json(path)


def append_status(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)
