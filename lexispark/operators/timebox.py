"""Enrichment runs in a time box: staged chunks, a canary, deadlines, checkpoints, restaging.

A run has a folder: `requests/chunk=<n>` is staged once, `answers/chunk=<n>` appears when a
chunk is answered. An answer is written aside by one Spark job and moved to its place when
every word has one, so a chunk is there whole or not at all, and a run that was killed
asks for no chunk twice (`stage` and `run` may be called again).

Each chunk is a job of its own group. Its rows are asked in one task, whose failure is the
provider's own; Spark repeats none. A chunk over its time, or one still running when the
grace after the deadline is over, is cancelled with its group. Spark ends the task then, but
not what its Python worker is doing, so the worker has an alarm of its own a little later,
which breaks off the provider. Nothing is launched after the deadline.

The first open chunk is the canary: it is tried alone, and if it fails each time, nothing
else is asked; the chunks can be restaged in smaller ones. After every `merge_every` answered
chunks, and at the end, the answers so far are handed to `merge`.
"""

from __future__ import annotations

import signal
import threading
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lexispark.session import files

Provider = Callable[[list[str]], list[str]]
#: Seconds after which a worker whose task was cancelled breaks off the provider.
ALARM = 2.0
_ANSWERS = "word_id long, response string"
STATUS = "run_id string, chunk long, status string, phase string, attempt int, reason string, at double"


@dataclass
class Limits:
    """Seconds, and counts."""

    time_limit: float
    grace: float = 900.0
    chunk_timeout: float = 3600.0
    concurrency: int = 6
    canary_tries: int = 2
    merge_every: int = 5
    poll: float = 0.05


@dataclass
class Failure:
    chunk: int
    reason: str
    phase: str
    attempt: int = 1


@dataclass
class Report:
    """completed and pending chunks; failures in the order they were seen; notes."""

    run_id: str
    completed: list[int] = field(default_factory=list)
    pending: list[int] = field(default_factory=list)
    failures: list[Failure] = field(default_factory=list)
    notes: list[str] = field(default_factory=list)
    asked: list[int] = field(default_factory=list)
    canary_failed: bool = False

    def rows(self, spark: SparkSession, at: float) -> DataFrame:
        """A row for each chunk that completed, waits or failed."""
        out = [(self.run_id, c, "completed", None, None, None, at) for c in self.completed]
        out += [(self.run_id, c, "pending", None, None, None, at) for c in self.pending]
        out += [(self.run_id, f.chunk, "failed", f.phase, f.attempt, f.reason, at) for f in self.failures]
        return spark.createDataFrame(out, STATUS)


def stage(requests: DataFrame, path: str) -> None:
    """Puts chunks in a run's folder, once. requests: chunk, word_id, request."""
    spark = requests.sparkSession
    fs, done = files(spark, f"{path}/requests/_SUCCESS")
    if not fs.exists(done):
        own = requests.select(F.col("chunk").cast("long").alias("chunk"), F.col("word_id").cast("long").alias("word_id"), F.col("request").cast("string").alias("request"))
        own.repartition("chunk").sortWithinPartitions("chunk", "word_id").write.mode("overwrite").partitionBy("chunk").parquet(f"{path}/requests")


def split(requests: DataFrame, size: int) -> DataFrame:
    """Each chunk cut into chunks of at most size rows, by word_id; the first one's number is
    the old number times the most parts a chunk is cut in."""
    ranked = requests.withColumn("_i", F.row_number().over(W.partitionBy("chunk").orderBy("word_id")) - 1)
    most = requests.groupBy("chunk").agg(F.count("*").alias("n")).agg(F.ceil(F.max("n") / F.lit(size))).first()[0] or 1
    return ranked.withColumn("chunk", F.col("chunk") * most + F.floor(F.col("_i") / F.lit(size))).drop("_i")


def _numbers(spark: SparkSession, folder: str) -> list[int]:
    fs, root = files(spark, folder)
    if not fs.exists(root):
        return []
    return sorted(int(n.split("=")[1]) for n in (f.getPath().getName() for f in fs.listStatus(root)) if n.startswith("chunk="))


def answers(spark: SparkSession, path: str) -> DataFrame:
    """chunk, word_id, response of every answered chunk."""
    if not _numbers(spark, f"{path}/answers"):
        return spark.createDataFrame([], f"chunk long, {_ANSWERS}")
    got = spark.read.schema(f"{_ANSWERS}, chunk long").parquet(f"{path}/answers")
    return got.select("chunk", "word_id", "response")


class Chunk:
    """One try to answer a chunk, in a thread and a job group of its own."""

    def __init__(self, spark: SparkSession, path: str, n: int, provider: Provider, now: float, most: float) -> None:
        self.spark, self.path, self.n, self.provider, self.started, self.most = spark, path, n, provider, now, most
        self.group, self.failed = f"{path}#{n}#{uuid.uuid4().hex}", None
        self._over, self._lock = False, threading.Lock()
        self.thread = InheritableThread(target=self._ask, daemon=True)
        self.thread.start()

    def _ask(self) -> None:
        spark, aside = self.spark, f"{self.path}/answers/_{uuid.uuid4().hex}"
        spark.sparkContext.setJobGroup(self.group, f"chunk {self.n}", interruptOnCancel=True)
        try:
            rows = spark.read.schema("word_id long, request string").parquet(f"{self.path}/requests/chunk={self.n}")
            _asked(rows.coalesce(1), self.provider, self.most + ALARM).write.parquet(aside)
            bad = spark.read.parquet(aside).where("error IS NOT NULL").select("error").first()
            if bad:
                raise RuntimeError(bad["error"])
            with self._lock:  # a try that was given up must not count after all
                if not self._over:
                    fs, old = files(spark, aside)
                    if not fs.rename(old, files(spark, f"{self.path}/answers/chunk={self.n}")[1]):
                        raise RuntimeError("the answer can't be moved to its place")
                    return
        except Exception as e:  # noqa: BLE001  whatever went wrong is this chunk's reason
            self.failed = str(e).strip().split("\n")[0]
        fs, old = files(spark, aside)
        fs.delete(old, True)

    def running(self) -> bool:
        return self.thread.is_alive()

    def cancel(self) -> bool:
        """Ends the try; False if its answer is there already."""
        with self._lock:
            fs, there = files(self.spark, f"{self.path}/answers/chunk={self.n}")
            if fs.exists(there):
                return False
            self._over = True
        self.spark.sparkContext.cancelJobGroup(self.group)
        return True


class Alarm(BaseException):
    """Breaks off a provider, whatever exceptions it keeps to itself."""


def _asked(requests: DataFrame, provider: Provider, seconds: float) -> DataFrame:
    """word_id, response, error of all rows of a partition, asked at once, within seconds."""

    def ring(*_: object) -> None:
        raise Alarm

    schema = pa.schema([("word_id", pa.int64()), ("response", pa.string()), ("error", pa.string())])

    def over(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in it for r in b.to_pylist()]  # one chunk
        before = signal.signal(signal.SIGALRM, ring)
        signal.setitimer(signal.ITIMER_REAL, seconds, 1.0)  # and again each second
        try:
            got = provider([r["request"] for r in rows])
            if len(got) != len(rows):
                raise ValueError(f"{len(got)} answers to {len(rows)} requests")
            out = [{"word_id": r["word_id"], "response": g, "error": None} for r, g in zip(rows, got, strict=True)]
        except (Exception, Alarm) as e:  # noqa: BLE001
            out = [{"word_id": None, "response": None, "error": f"{type(e).__name__}: {e}"}]
        finally:
            signal.setitimer(signal.ITIMER_REAL, 0)
            signal.signal(signal.SIGALRM, before)
        yield pa.RecordBatch.from_pylist(out, schema)

    return requests.mapInArrow(over, "word_id long, response string, error string")


def run(spark: SparkSession, path: str, provider: Provider, limits: Limits, merge: Callable[[DataFrame], object] | None = None, canary: bool = True, run_id: str | None = None) -> Report:
    """Asks for the open chunks of a staged run. merge takes the answers so far."""
    path = path.rstrip("/")
    report = Report(run_id or path.rsplit("/", 1)[-1])
    started = time.monotonic()
    deadline = started + limits.time_limit
    end = deadline + limits.grace
    chunks, done = _numbers(spark, f"{path}/requests"), set(_numbers(spark, f"{path}/answers"))
    if done:
        report.notes.append(f"resumed with {len(done)} answered chunks")
    ended: list[Chunk] = []

    def launch(n: int) -> Chunk:
        report.asked.append(n)
        now = time.monotonic()
        return Chunk(spark, path, n, provider, now, min(limits.chunk_timeout, max(0.0, end - now)))

    def closed(c: Chunk, phase: str, attempt: int = 1) -> bool:
        """Whether a chunk that runs no more, or is out of time, was answered."""
        late = c.running() and c.cancel()
        ended.append(c)
        if late:
            report.failures.append(Failure(c.n, f"timed out after {limits.chunk_timeout:g} seconds", phase, attempt))
        elif c.failed:
            report.failures.append(Failure(c.n, c.failed, phase, attempt))
        else:
            done.add(c.n)
        return c.n in done

    def checkpoint() -> None:
        if merge is not None and done:
            merge(answers(spark, path))

    def finished() -> Report:
        for c in ended:
            c.thread.join()  # a cancelled job ends; nothing of it is left running
        report.completed, report.pending = sorted(done), [n for n in chunks if n not in done and n not in {f.chunk for f in report.failures}]
        return report

    first = next((n for n in chunks if n not in done), None)
    if canary and first is not None:
        for attempt in range(1, limits.canary_tries + 1):
            c = launch(first)
            while c.running() and time.monotonic() - c.started <= limits.chunk_timeout:
                time.sleep(limits.poll)
            if closed(c, "canary", attempt):
                report.notes.append(f"canary answered at try {attempt}")
                checkpoint()
                break
        else:
            report.canary_failed = True
            return finished()

    waiting, active, since, late = iter(chunks), {}, 0, False
    more = True
    while True:
        now = time.monotonic()
        while more and len(active) < limits.concurrency and now < deadline:
            n = next((n for n in waiting if n not in done), None)
            if n is None:
                more = False
            else:
                active[n] = launch(n)
        if now >= deadline and not late:
            late = True
            report.notes.append("deadline reached")
        for n, c in list(active.items()):
            if not c.running() or now - c.started > limits.chunk_timeout:
                del active[n]
                since += closed(c, "run")
        if since >= limits.merge_every:
            checkpoint()
            since = 0
        if now >= end and active:
            for n, c in active.items():
                if c.cancel():
                    report.failures.append(Failure(n, "ended after the grace period", "grace"))
                elif not c.failed:
                    done.add(n)
                ended.append(c)
            break
        if not active and (late or not more):
            break
        time.sleep(limits.poll)
    checkpoint()
    return finished()


def run_restaged(spark: SparkSession, path: str, provider: Provider, limits: Limits, fallback: int, merge: Callable[[DataFrame], object] | None = None) -> list[Report]:
    """A run and, if its canary failed, one of smaller chunks in a folder beside it, within
    what is left of the time. Words answered before aren't asked again."""
    started = time.monotonic()
    reports = [run(spark, path, provider, limits, merge)]
    if reports[0].canary_failed and fallback:
        beside = f"{path.rstrip('/')}-fallback{fallback}"
        requests = spark.read.schema("word_id long, request string, chunk long").parquet(f"{path}/requests")
        stage(split(requests.join(answers(spark, path).select("word_id"), "word_id", "left_anti"), fallback), beside)
        rest = Limits(**{**vars(limits), "time_limit": max(0.0, limits.time_limit - (time.monotonic() - started))})
        reports.append(run(spark, beside, provider, rest, merge))
    return reports
