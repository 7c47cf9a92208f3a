"""Saved sessions brought to the present form, with the session they return to, and streams
that go on from them.

The state of a word in a session has grown: version 1 counts answers and the streak, version
2 adds urgency, version 3 the last prompt and time. A stream of any version may be stopped
and started again with a later one on the same checkpoint: Spark evolves the stored rows (in
Avro encoding), and fields they lack take their defaults when a row is read.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType, TimestampType

from lexispark.functions.text import let, truthy
from lexispark.streaming import answers as SA

#: The version of restored sessions, and how many recent words they keep. Fixed values.
VERSION, RECENT = 3, 4

_WORD = "struct<seen:int,correct:int,incorrect:int,streak:int,urgency:int,lastPromptText:string,lastSeenAt:long>"
_ANSWER = "struct<questionId:string,questionIndex:int,wordId:long,userAnswer:string,correct:boolean,answeredAt:long>"
_QUESTION = "struct<id:string,type:string,wordId:long,prompt:struct<text:string,subtext:string>,correctAnswer:string,choices:array<string>>"
_FIELDS = (
    f"id:string,workId:string,level:int,mode:string,kind:string,questions:array<{_QUESTION}>,currentIndex:double,nextQuestionOrdinal:double,"
    f"answersById:map<string,{_ANSWER}>,stats:struct<seen:int,correct:int,incorrect:int,streak:int,bestStreak:int>,wordStats:map<string,{_WORD}>,"
    "recentWordIds:array<long>,reviewSourceQuestionIds:array<string>,startTime:long,updatedAt:long,endedAt:long,ended:string"
)
#: What a saved session has; all fields may be absent.
SAVED = f"struct<{_FIELDS},returnToSession:struct<{_FIELDS}>>"


def _one(s: Column, now: Column, parent: Column | None) -> Column:
    none = lambda t: F.expr(f"cast({'map()' if t.startswith('map') else 'array()'} as {t})")
    some = lambda n: F.when((n > 0) | (n < 0), n)  # noqa: E731  JavaScript's ||: 0 is none
    number = lambda c: F.when(c == F.floor(c), c.cast("long"))
    questions = F.transform(s["questions"], lambda q, i: q.withField("id", F.coalesce(truthy(q["id"]), F.concat(F.lit("q"), (i + 1).cast("string")))))
    size = F.size(s["questions"]).cast("long")
    index = F.coalesce(F.greatest(F.lit(0).cast("long"), F.least(number(s["currentIndex"]), F.greatest(size - 1, F.lit(0).cast("long")))), F.lit(0).cast("long"))
    index = F.when(number(s["currentIndex"]).isNull(), F.lit(0).cast("long")).otherwise(index)
    stats = F.struct(*[F.coalesce(s["stats"][c], F.lit(0)).alias(c) for c in ("seen", "correct", "incorrect", "streak", "bestStreak")])
    recent = F.coalesce(s["recentWordIds"], none("array<bigint>"))
    begun = F.coalesce(some(s["startTime"]), now)
    fields = {
        "version": F.lit(VERSION),
        "id": F.coalesce(truthy(s["id"]), F.concat(F.coalesce(truthy(s["workId"]), F.lit("session")), F.lit("-"), begun.cast("string"))),
        "workId": s["workId"], "level": s["level"], "mode": s["mode"], "kind": F.coalesce(truthy(s["kind"]), F.lit("study")),
        "questions": questions, "currentIndex": index, "nextQuestionOrdinal": F.coalesce(number(s["nextQuestionOrdinal"]), size),
        "answersById": F.coalesce(s["answersById"], none(f"map<string,{_ANSWER}>")), "stats": stats, "wordStats": F.coalesce(s["wordStats"], none(f"map<string,{_WORD}>")),
        "recentWordIds": F.slice(recent, F.greatest(F.size(recent) - RECENT + 1, F.lit(1)), RECENT),
        "reviewSourceQuestionIds": F.coalesce(s["reviewSourceQuestionIds"], none("array<string>")),
        "startTime": begun, "updatedAt": F.coalesce(some(s["updatedAt"]), begun), "endedAt": some(s["endedAt"]),
        "ended": ~F.coalesce(s["ended"], F.lit("")).isin("", "0", "false", "null"),
    }
    if parent is not None:
        fields["returnToSession"] = parent
    return F.when(s["questions"].isNotNull(), F.struct(*[c.alias(n) for n, c in fields.items()]))


def restored(text: Column, now: Column) -> Column:
    """A saved session (JSON) in the present form, as a struct; null if it is none, that is,
    if it has no list of questions. So is the session it returns to; reviews are not
    reviewed, so that one returns to none. now: milliseconds, for sessions without a time."""
    # a name for the parsed text, which Spark would else parse anew for each field
    return let(F.from_json(text, SAVED), lambda s: _one(s, now, let(s["returnToSession"], lambda r: _one(r, now, None))))


def word_stats(sessions: DataFrame, session: str = "session") -> DataFrame:
    """session_id, word_id, the state of each word, and answered: the ids of the questions on
    it that have an answer. sessions: session_id, and restored sessions."""
    words = sessions.select("session_id", F.explode(f"{session}.wordStats").alias("w", "s"))
    asked = sessions.select("session_id", F.explode(f"{session}.answersById").alias("q", "a")).groupBy("session_id", F.col("a.wordId").alias("word_id")).agg(F.collect_list("q").alias("answered"))
    zero = lambda c: F.coalesce(F.col(f"s.{c}"), F.lit(0)).alias(c)
    own = words.select("session_id", F.col("w").cast("long").alias("word_id"), *[zero(c) for c in ("seen", "correct", "incorrect", "streak", "urgency")], F.col("s.lastPromptText").alias("last_prompt"), F.timestamp_millis("s.lastSeenAt").alias("last_seen"))
    return own.join(asked, ["session_id", "word_id"], "left")


_COUNTS = ["seen", "correct", "incorrect", "streak"]
_ALL = [*[StructField(c, IntegerType()) for c in (*_COUNTS, "urgency")], StructField("last_prompt", StringType()), StructField("last_seen", TimestampType())]
#: Fields of a word's state by version.
STATES = {1: StructType(_ALL[:4]), 2: StructType(_ALL[:5]), 3: StructType(_ALL)}
_DEFAULTS = (0, 0, 0, 0, 0, None, None)
OUT = StructType([StructField("session_id", LongType()), StructField("word_id", LongType()), *_ALL])


class Words(StatefulProcessor):
    """Folds answers into the states of a block of words in a session. Of a question on a
    word the first answer counts, as long as it is remembered."""

    def __init__(self, version: int, remember_ms: int | None) -> None:
        self.size, self.remember_ms = len(STATES[version]), remember_ms
        self.schema = StructType([StructField("word_id", LongType()), *STATES[version]])

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.totals = handle.getListState("totals", self.schema)
        self.answered = handle.getListState("answered", SA.ANSWERED, self.remember_ms)

    def _read(self) -> dict[int | None, list]:
        out = {}
        for w, *found in self.totals.get():
            found += [None] * (len(_DEFAULTS) - len(found))
            out[w] = [d if x is None else x for x, d in zip(found, _DEFAULTS, strict=True)]
        return out

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        states = self._read()
        known, new, met = SA.pairs(self.answered.get()) if states else set(), [], {}
        for row in SA.in_order(rows).itertuples(index=False):
            w, q, ok = row.word_id, row.question_id, bool(row.correct)
            met[w] = None
            if (w, q) in known:
                continue
            known.add((w, q))
            new.append((w, q))
            seen, right, wrong, streak, urgency, _, _ = states.get(w, _DEFAULTS)
            streak, urgency = (streak + 1, max(urgency - 1, 0)) if ok else (0, min(urgency + 3, 12))
            states[w] = (seen + 1, right + ok, wrong + (not ok), streak, urgency, row.prompt, row.ts.to_pydatetime())
        if new:
            self.answered.appendValue(tuple(map(list, zip(*new, strict=True))))
            self.totals.put([(w, *state[: self.size]) for w, state in states.items()])
        yield pd.DataFrame([(key[0], w, *states.get(w, _DEFAULTS)) for w in met], columns=OUT.names, dtype=object)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        states, asked = [], []
        for row in initialState.itertuples(index=False):
            w = None if pd.isna(row.word_id) else int(row.word_id)
            prompt, last = (None if pd.isna(x) else x for x in (row.last_prompt, row.last_seen))
            state = (*(int(row[row._fields.index(c)]) for c in (*_COUNTS, "urgency")), prompt, last.to_pydatetime() if last is not None else None)
            states.append((w, *state[: self.size]))
            asked += [(w, str(q)) for q in (row.answered if row.answered is not None else ())]
        if states:
            self.totals.appendList(states)
        if asked:
            self.answered.appendValue(tuple(map(list, zip(*asked, strict=True))))

    def close(self) -> None:
        pass


@contextmanager
def settings(spark: SparkSession) -> Iterator[None]:
    """What the state needs when a stream starts: a store that keeps rows on disk, in an
    encoding that can evolve. The session is then as before; other streams can't use it."""
    wanted = {"providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "encodingFormat": "avro"}
    wanted = {f"spark.sql.streaming.stateStore.{k}": v for k, v in wanted.items()}
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def word_sessions(answers: DataFrame, saved: DataFrame | None = None, version: int = VERSION, remember_ms: int | None = None) -> DataFrame:
    """The state of each word after each batch that has answers to it. answers: session_id,
    word_id, question_id, event_id, ts, correct, prompt. saved: rows of word_stats(), which a
    new stream begins with. remember_ms: how long an answered question is remembered (for
    ever, if not given); such a stream always has another batch, so let it go on, or run it
    with trigger(once=True). Start it within settings()."""
    mode = "None" if remember_ms is None else "ProcessingTime"
    first = None if saved is None else SA.by_blocks(saved)
    return SA.by_blocks(answers).transformWithStateInPandas(Words(version, remember_ms), OUT, "Update", mode, initialState=first)
