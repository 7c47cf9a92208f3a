"""Answer events as streams: long-term progress, and per-word session state."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType


def progress(answers: DataFrame, *key: str, kind: str | None = "kind") -> DataFrame:
    """correct, incorrect, last_seen by key; answers of review sessions don't count."""
    own = answers if kind is None else answers.where(F.col(kind) == "study")
    return own.groupBy(*key).agg(F.count_if("correct").alias("correct"), F.count_if(~F.col("correct")).alias("incorrect"), F.max("ts").alias("last_seen"))


#: Words of a session whose states are kept together: states are asked for by session and
#: block of this many word ids, since each asking costs as much as folding many answers.
BLOCK = 64
STATE = StructType([StructField(c, IntegerType()) for c in ("seen", "correct", "incorrect", "streak", "urgency")])
#: What one batch answered first: a question's word and id have the same place.
ANSWERED = StructType([StructField("words", ArrayType(LongType())), StructField("questions", ArrayType(StringType()))])
OUT = StructType([StructField("session_id", LongType()), StructField("word_id", LongType()), *STATE.fields])


def by_blocks(df: DataFrame) -> GroupedData:
    """Rows with session_id and word_id by session and block of words."""
    return df.withColumn("_block", F.floor(F.col("word_id") / BLOCK)).groupBy("session_id", "_block")


def pairs(answered: Iterable[tuple]) -> set[tuple]:
    """(word, question) of all batches."""
    return {x for words, questions in answered for x in zip(words, questions, strict=True)}


def in_order(rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
    """Answers by time, then id; a word without an id has None."""
    out = pd.concat(list(rows)).sort_values(["ts", "event_id"])
    return out.assign(word_id=[None if pd.isna(w) else int(w) for w in out["word_id"]], question_id=out["question_id"].astype(str)).astype({"word_id": object})


class WordState(StatefulProcessor):
    """Folds the answers to the words of a block in one session. Only the first answer to a
    question on a word counts; within a batch answers go by time, then id."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.totals = handle.getListState("totals", StructType([StructField("word_id", LongType()), *STATE.fields]))
        self.answered = handle.getListState("answered", ANSWERED)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        states = {w: state for w, *state in self.totals.get()}
        known, new, met = pairs(self.answered.get()) if states else set(), [], {}
        for w, q, ok in in_order(rows)[["word_id", "question_id", "correct"]].itertuples(index=False):
            met[w] = None
            if (w, q) in known:
                continue
            known.add((w, q))
            new.append((w, q))
            seen, right, wrong, streak, urgency = states.get(w, (0, 0, 0, 0, 0))
            streak, urgency = (streak + 1, max(urgency - 1, 0)) if ok else (0, min(urgency + 3, 12))
            states[w] = (seen + 1, right + bool(ok), wrong + (not ok), streak, urgency)
        if new:
            self.answered.appendValue(tuple(map(list, zip(*new, strict=True))))
            self.totals.put([(w, *state) for w, state in states.items()])
        yield pd.DataFrame([(key[0], w, *states[w]) for w in met], columns=OUT.names, dtype=object)

    def close(self) -> None:
        pass


def word_states(answers: DataFrame) -> DataFrame:
    """State after each batch. answers: session_id, word_id, question_id, event_id, ts,
    correct. Needs the RocksDB state store."""
    return by_blocks(answers).transformWithStateInPandas(WordState(), OUT, "Update", "None")
