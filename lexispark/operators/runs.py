"""Runs of an enrichment provider over chunks: resume, deadline, poison rows, status."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pending(chunks: DataFrame, done: DataFrame, key: str = "chunk") -> DataFrame:
    """Chunks without a saved answer."""
    return chunks.join(done.select(key).distinct(), key, "left_anti")


def run(requests: DataFrame, provider: Callable[[list[str]], list[str]], deadline: float | None = None, batch: int = 5) -> DataFrame:
    """word_id, response, error. The provider answers a batch of requests; a batch that
    fails is tried row by row, so that one bad row spoils no other. Nothing is asked
    after the deadline (epoch seconds). requests: word_id, request."""

    def ask(rows: list[dict]) -> list[dict]:
        try:
            got = provider([r["request"] for r in rows])
            if len(got) != len(rows):
                raise ValueError(f"{len(got)} answers to {len(rows)} requests")
            return [{"word_id": r["word_id"], "response": g, "error": None} for r, g in zip(rows, got, strict=True)]
        except Exception as e:  # noqa: BLE001  whatever a provider raises is its rows' error
            if len(rows) == 1:
                return [{"word_id": rows[0]["word_id"], "response": None, "error": f"{type(e).__name__}: {e}"}]
            return [x for r in rows for x in ask([r])]

    schema = pa.schema([("word_id", pa.int64()), ("response", pa.string()), ("error", pa.string())])

    def over(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            rows = b.to_pylist()
            out: list[dict] = []
            for i in range(0, len(rows), batch):
                part = rows[i : i + batch]
                late = deadline is not None and time.time() >= deadline
                out += [{"word_id": r["word_id"], "response": None, "error": "deadline"} for r in part] if late else ask(part)
            yield pa.RecordBatch.from_pylist(out, schema)

    return requests.select(F.col("word_id").cast("long").alias("word_id"), F.col("request").cast("string").alias("request")).mapInArrow(over, "word_id long, response string, error string")


def canary(requests: DataFrame, provider: Callable[[list[str]], list[str]], tries: int = 3) -> bool:
    """Whether one request is answered within so many tries."""
    first = requests.orderBy("word_id").limit(1).select("word_id", "request").collect()
    return not first or any(run(requests.sparkSession.createDataFrame(first, "word_id long, request string"), provider).where("error IS NULL").count() for _ in range(tries))


def status(chunks: DataFrame, answers: DataFrame) -> DataFrame:
    """completed, failed and pending chunks, counted. chunks: chunk, word_id."""
    j = chunks.join(answers.select("word_id", F.lit(True).alias("asked"), F.col("error").isNotNull().alias("bad")), "word_id", "left")
    per = j.groupBy("chunk").agg(F.bool_and(F.coalesce("asked", F.lit(False))).alias("asked"), F.bool_or(F.coalesce("bad", F.lit(False))).alias("bad"))
    state = F.when(~F.col("asked"), "pending").when(F.col("bad"), "failed").otherwise("completed")
    return per.groupBy(state.alias("status")).agg(F.count("*").alias("chunks"))
