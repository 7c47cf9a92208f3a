"""A keyed state store: puts and deletes as a log of commits, read merged by key.

Each write is a commit of its own, a Parquet folder that counts once Spark has marked it
whole; so a write is there entirely or not at all, and none changes what others wrote. A
delete writes tombstones. Readers take the last row of each key over the last snapshot and
the commits behind it (`max_by`, which Spark aggregates before it shuffles); a tombstone of
a prefix hides every key with that prefix that was put before. `compact` writes the merged
rows as a snapshot and removes what it replaces.

One writer at a time, as a store of one user's state has; readers at any time.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.session import files

#: Keys of an application's state. Fixed values of the format.
PROGRESS, SESSION, SETTINGS = "flash_progress_", "flash_session_", "flash_settings"
_SCHEMA = "key string, value string, kind string, place long, commit long"


class Store:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _numbers(self, name: str) -> list[int]:
        """Numbers of the whole folders name=<number>."""
        fs, root = files(self.spark, self.path)
        if not fs.exists(root):
            return []
        named = [f.getPath().getName() for f in fs.listStatus(root) if f.getPath().getName().startswith(f"{name}=")]
        return sorted(int(n.split("=")[1]) for n in named if fs.exists(files(self.spark, f"{self.path}/{n}/_SUCCESS")[1]))

    def _next(self) -> int:
        return max([-1, *self._numbers("commit"), *self._numbers("snapshot")]) + 1

    def _commit(self, rows: DataFrame, quiet: bool) -> None:
        n = self._next()
        try:
            rows.withColumn("commit", F.lit(n).cast("long")).write.mode("overwrite").parquet(f"{self.path}/commit={n}")
        except Exception as e:  # noqa: BLE001  state that can't be kept must not stop who keeps it
            if not quiet:
                raise
            warnings.warn(f"state wasn't written: {e}", stacklevel=3)

    def put(self, rows: DataFrame, quiet: bool = False) -> None:
        """Values of keys. rows: key, value and, where a key comes twice, place. A null value
        is kept as one; a null key is left out."""
        place = F.col("place").cast("long") if "place" in rows.columns else F.lit(0).cast("long")
        own = rows.where("key IS NOT NULL").select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"), F.lit("put").alias("kind"), place.alias("place"))
        self._commit(own, quiet)

    def delete(self, keys: DataFrame, quiet: bool = False) -> None:
        """The keys (column key) go."""
        own = keys.where("key IS NOT NULL").select(F.col("key").cast("string").alias("key"), F.lit(None).cast("string").alias("value"), F.lit("gone").alias("kind"), F.lit(0).cast("long").alias("place"))
        self._commit(own.distinct(), quiet)

    def delete_work(self, works: DataFrame, quiet: bool = False) -> None:
        """Progress and session of works (column work_id) go."""
        keys = works.select(F.explode(F.array(*[F.concat(F.lit(p), F.col("work_id").cast("string")) for p in (PROGRESS, SESSION)])).alias("key"))
        self.delete(keys, quiet)

    def delete_prefixes(self, *prefixes: str, quiet: bool = False) -> None:
        """Every key with one of the prefixes goes."""
        rows = self.spark.createDataFrame([(p, None, "prefix", 0) for p in prefixes], "key string, value string, kind string, place long")
        self._commit(rows, quiet)

    def delete_all(self, quiet: bool = False) -> None:
        """All progress, sessions and settings go; other keys stay."""
        rows = self.spark.createDataFrame([(PROGRESS, None, "prefix", 0), (SESSION, None, "prefix", 0), (SETTINGS, None, "gone", 0)], "key string, value string, kind string, place long")
        self._commit(rows, quiet)

    def log(self) -> DataFrame:
        """The last snapshot and the commits behind it."""
        snapshot = self._numbers("snapshot")[-1:]
        behind = [n for n in self._numbers("commit") if not snapshot or n > snapshot[0]]
        paths = [f"{self.path}/snapshot={n}" for n in snapshot] + [f"{self.path}/commit={n}" for n in behind]
        if not paths:
            return self.spark.createDataFrame([], _SCHEMA)
        return self.spark.read.schema(_SCHEMA).parquet(*paths)

    def read(self) -> DataFrame:
        """key, value of every key that is there."""
        return self._merged().select("key", "value")

    def get(self, key: str) -> str | None:
        """The value of one key; the filter on it reaches the files."""
        row = self._merged(F.col("key") == key).select("value").first()
        return row["value"] if row else None

    def _merged(self, only: Column | None = None) -> DataFrame:
        log = self.log()
        own = log.where("kind <> 'prefix'")
        own = own if only is None else own.where(only)
        last = own.groupBy("key").agg(F.max_by(F.struct("value", "kind", "commit"), F.struct("commit", "place", "kind")).alias("x"))
        there = last.where("x.kind = 'put'").select("key", "x.value", "x.commit")
        gone = log.where("kind = 'prefix'").groupBy(F.col("key").alias("prefix")).agg(F.max("commit").alias("at"))
        lengths = [r.n for r in gone.select(F.length("prefix").alias("n")).distinct().collect()]  # no more than the longest prefix has characters
        if not lengths:
            return there
        begins = F.array(*[F.when(F.length("key") >= n, F.substring("key", 1, n)) for n in lengths])
        hidden = there.select("key", "commit", F.explode(begins).alias("prefix")).join(gone, "prefix").where("at > commit").select("key")
        return there.join(hidden.distinct(), "key", "left_anti")

    def compact(self) -> None:
        """Writes the merged rows as a snapshot and removes what it replaces. Broken off, it
        leaves the store as it was, or with folders that no reader looks at any more."""
        done = self._numbers("commit")
        n = max([-1, *done, *self._numbers("snapshot")])
        if n < 0 or not done:
            return
        rows = self._merged().select("key", "value", F.lit("put").alias("kind"), F.lit(0).cast("long").alias("place"), F.lit(n).cast("long").alias("commit"))
        rows.write.mode("overwrite").parquet(f"{self.path}/snapshot={n}")
        old = [f"commit={m}" for m in done if m <= n] + [f"snapshot={m}" for m in self._numbers("snapshot") if m < n]
        for name in old:
            fs, p = files(self.spark, f"{self.path}/{name}")
            fs.delete(p, True)


def settings(rows: DataFrame, defaults: dict[str, str | None]) -> DataFrame:
    """Saved settings (column value, JSON objects) over the defaults, as map settings: a
    field that is there wins, also a null one; what is no object gives the defaults."""
    names, values = F.array(*[F.lit(k) for k in defaults]), F.array(*[F.lit(v).cast("string") for v in defaults.values()])
    base = F.map_from_arrays(names, values)
    got = F.from_json("value", "map<string,string>")
    got = F.when(F.startswith(F.ltrim("value"), F.lit("{")) & got.isNotNull(), got)
    kept = F.map_filter(base, lambda k, _: ~F.array_contains(F.map_keys(F.coalesce(got, F.create_map().cast("map<string,string>"))), k))
    return rows.withColumn("settings", F.map_concat(kept, F.coalesce(got, F.create_map().cast("map<string,string>"))))
