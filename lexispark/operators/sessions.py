"""Sessions: reviews of wrong answers, the cursor, seeded question queues, history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lexispark.operators import questions as K
from lexispark.operators import study as S
from lexispark.session import saved


def wrong_answers(answers: DataFrame) -> DataFrame:
    """Answers that were wrong, in the order of their questions."""
    return answers.where(~F.col("correct")).orderBy("session_id", "question_index")


def review(answers: DataFrame, questions: DataFrame, sessions: DataFrame) -> DataFrame:
    """Questions of a review session for each study session with wrong answers: the
    same questions in order, numbered anew, with the session to return to. Reviews are
    not reviewed. sessions: session_id, kind; questions: question_id, ..."""
    study = sessions.where("kind <> 'review'").select("session_id")
    asked = answers.where(~F.col("correct")).join(study, "session_id", "left_semi").select("session_id", "question_index", "question_id")
    ranked = asked.groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct("question_index", "question_id"))).alias("q"))
    listed = ranked.select(F.col("session_id").alias("parent_session_id"), F.posexplode("q").alias("question_index", "q")).select("parent_session_id", "question_index", "q.question_id")
    return listed.join(questions, "question_id").withColumn("kind", F.lit("review"))


def cursor(questions: Column, index: Column, ended: Column) -> Column:
    """The current question; null if the session has ended or the index is out of range."""
    return F.when(~ended & (index >= 0), F.get(questions, index))


def step(index: Column, n: Column, answered: Column, ended: Column, forward: bool = True) -> Column:
    """The next index: forward only past an answered question, never past the ends."""
    if forward:
        return F.when(answered & ~ended, F.least(index + 1, n - 1)).otherwise(index)
    return F.greatest(index - 1, F.lit(0))


#: How many of the last words are not asked again, and the weights of words without
#: statistics (never drawn, and drawn before). Fixed values.
RECENT, UNSEEN_WEIGHT, DRAWN_WEIGHT = 3, 1.5, 1.0


def uniform(*parts: Column, seed: int = 0) -> Column:
    """A number between 0 and 1 that follows from the seed and the parts."""
    text = F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts])
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 1) / F.lit(float(1 << 52) + 2)


def seed_queue(states: DataFrame, part: str, item: str, k: int = 5, seed: int = 0) -> DataFrame:
    """part, queue: k draws by weight. A draw leaves out the last three words, those in the
    column recent (a list, if states has one) and those drawn before; if that leaves none, all
    words may be drawn. states: part, item, weight (null: no statistics).

    A draw takes the least -log(u) / weight, u from seed, part, item and the draw's number.
    At most three words are left out and k have a lower weight than before, so the first
    3 + k of each draw decide it; Spark limits each task to those before it shuffles, so no
    row ever holds more."""
    recent = F.col("recent") if "recent" in states.columns else F.expr(f"cast(array() as array<{states.schema[item].dataType.simpleString()}>)")
    keep = RECENT + k
    own = states.select(part, F.col(item).alias("item"), F.coalesce("weight", F.lit(UNSEEN_WEIGHT)).alias("w"), F.col("weight").isNull().alias("fresh"), recent.alias("recent"))
    drawn = own.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    e = -F.log(uniform(F.col(part), F.col("item"), F.col("i"), seed=seed))
    drawn = drawn.select(part, "i", "item", "fresh", "recent", e.alias("e"), (e / F.col("w")).alias("place"))
    first = drawn.withColumn("r", F.row_number().over(W.partitionBy(part, "i").orderBy("place", "item"))).where(F.col("r") <= keep)
    draws = first.groupBy(part, "i").agg(F.collect_list(F.struct("place", "item", "e", "fresh")).alias("x"), F.first("recent").alias("recent"))
    by = draws.groupBy(part).agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("draws"), F.first("recent").alias("recent"))

    def draw(acc: Column, d: Column) -> Column:
        # of words drawn here before, those without statistics weigh less from now on
        again = F.transform(d["x"], lambda x: F.struct(F.when(x["fresh"] & F.array_contains(acc["queue"], x["item"]), x["e"] / DRAWN_WEIGHT).otherwise(x["place"]).alias("place"), x["item"].alias("item")))
        free = F.filter(again, lambda x: ~F.array_contains(acc["last"], x["item"]))
        one = F.array_min(F.when(F.size(free) > 0, free).otherwise(again))["item"]
        last = F.concat(acc["last"], F.array(one))
        return F.struct(F.concat(acc["queue"], F.array(one)).alias("queue"), F.slice(last, F.greatest(F.size(last) - RECENT + 1, F.lit(1)), RECENT).alias("last"))

    start = F.struct(F.slice("recent", 1, 0).alias("queue"), F.slice("recent", F.greatest(F.size("recent") - RECENT + 1, F.lit(1)), RECENT).alias("last"))
    return by.select(part, F.aggregate("draws", start, draw)["queue"].alias("queue"))


def adaptive(states: DataFrame, part: str, item: str, seed: int = 0) -> DataFrame:
    """part, item: the next word to ask, drawn by weight without the last three words; no
    row for a part without words."""
    return seed_queue(states, part, item, 1, seed).select(part, F.get("queue", F.lit(0)).alias(item))


def adaptive_questions(states: DataFrame, words: DataFrame, part: str, mode: str, seed: int = 0) -> DataFrame:
    """The next question of each session (part): a word drawn by weight, asked in a mode, but
    not by the form it was asked by last. states: part, id, weight, recent, last_prompt;
    words: as questions.build() takes them. In form-id only words that have such forms are
    drawn; a session without a word has no question. A word of several sessions is asked the
    same in those that last asked it by the same form."""
    can = words.where(K.eligible(F.col("forms"))) if mode == "form-id" else words
    own = states.join(can.select("id"), "id", "left_semi")
    picked = saved(adaptive(own, part, "id", seed).join(states.select(part, "id", "last_prompt"), [part, "id"]))  # a row for each session, read several times
    # sessions that ask one word in one way share its question
    ways = picked.select("id", "last_prompt").distinct()
    asked = ways.join(words, "id").withColumn("exclude_forms", F.when(F.col("last_prompt").isNotNull(), F.array("last_prompt")).otherwise(F.expr("cast(array() as array<string>)")))
    questions = K.ask(asked, mode, seed, words, carry=("last_prompt",))
    same = (picked["id"] == questions["word_id"]) & picked["last_prompt"].eqNullSafe(questions["last_prompt"])
    return picked.join(questions, same).select(part, *[questions[c] for c in ("word_id", "type", "prompt", "correct_answer", "choices")])


def appended(queue: DataFrame, more: DataFrame, part: str, order: str) -> DataFrame:
    """The questions of a session and further ones (order tells theirs), numbered on."""
    base = queue.groupBy(part).agg((F.max("question_index") + 1).alias("_base"))
    new = more.withColumn("_i", F.row_number().over(W.partitionBy(part).orderBy(order))).join(base, part, "left")
    new = new.withColumn("question_index", (F.coalesce("_base", F.lit(0)) + F.col("_i") - 1).cast(queue.schema["question_index"].dataType))
    return queue.unionByName(new.select(*queue.columns))


def restored(saved: DataFrame) -> DataFrame:
    """Saved sessions in the present form: absent fields take their defaults, the index is
    clamped to the questions. saved: session_id, version, kind, questions, question_index, ended."""
    questions = F.coalesce("questions", F.expr(f"cast(array() as {saved.schema['questions'].dataType.simpleString()})"))
    index = F.greatest(F.lit(0), F.least(F.coalesce("question_index", F.lit(0)), F.size(questions) - 1)).cast("int")
    return saved.select("session_id", F.lit(VERSION).alias("version"), F.coalesce("kind", F.lit("study")).alias("kind"), questions.alias("questions"), index.alias("question_index"), F.coalesce("ended", F.lit(False)).alias("ended"))


#: The version of saved sessions.
VERSION = 3


def resumable(saved: DataFrame) -> DataFrame:
    """Saved sessions that can go on: they have questions, an index and haven't ended."""
    return saved.where(F.coalesce(F.size("questions") > 0, F.lit(False)) & F.col("question_index").isNotNull() & ~F.coalesce("ended", F.lit(False)))


def history(sessions: DataFrame, n: int = 10) -> DataFrame:
    """The last n finished sessions, newest first."""
    return sessions.orderBy(F.desc("finished_ord")).limit(n)


def summary(answers: DataFrame) -> DataFrame:
    """Statistics of each session with its answers in order."""
    detail = F.sort_array(F.collect_list(F.struct("question_index", "question_id", "correct"))).alias("answers")
    return S.session_summary(answers, "session_id").join(answers.groupBy("session_id").agg(detail), "session_id")
