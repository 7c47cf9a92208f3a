"""Study engine: answers folded into streaks, urgency, mastery, weights and picks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lexispark.functions import text as T
from lexispark.session import saved

#: answer columns used throughout: session, item, correct, and the order (ts, id)
ORDER = ("ts", "event_id")


def first_answers(answers: DataFrame, *question: str) -> DataFrame:
    """The first answer to each question; later ones are ignored."""
    first = answers.groupBy(*question).agg(F.min_by(F.struct(*[c for c in answers.columns if c not in question]), F.struct(*ORDER)).alias("_a"))
    return first.select(*question, "_a.*")


def streaks(answers: DataFrame, key: str) -> DataFrame:
    """streak after each answer: correct answers in a row, ended by a wrong one."""
    ordered = W.partitionBy(key).orderBy(*ORDER)
    islands = answers.withColumn("_island", F.sum(F.when(F.col("correct"), 0).otherwise(1)).over(ordered))
    inside = W.partitionBy(key, "_island").orderBy(*ORDER)
    return islands.withColumn("streak", F.sum(F.when(F.col("correct"), 1).otherwise(0)).over(inside)).drop("_island")


def urgency(answers: DataFrame, *key: str, up: int = 3, most: int = 12) -> DataFrame:
    """Clamped walk: a wrong answer adds ``up`` to at most ``most``, a correct one takes 1
    to at least 0.

    A run of answers is a map u -> min(hi, max(lo, u + s)), and so are two in a row: answers
    become maps by key and minute, then by key and day, and the days' maps one of a key, so
    that no row holds all answers of a key."""
    second = F.unix_seconds(F.col(ORDER[0]).cast("timestamp"))
    blocks = answers.select(*key, *ORDER, "correct", F.floor(second / 60).alias("_m"), F.floor(second / 86400).alias("_d"))
    none = F.struct(F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("lo"), F.lit(most).cast("long").alias("hi"))

    def step(f: Column, a: Column) -> Column:
        down = lambda c: F.greatest(c - 1, F.lit(0))
        rise = lambda c: F.least(c + up, F.lit(most))
        moved = lambda c: F.when(a["correct"], down(c)).otherwise(rise(c))
        return F.struct(F.when(a["correct"], f["s"] - 1).otherwise(f["s"] + up).cast("long").alias("s"), moved(f["lo"]).cast("long").alias("lo"), moved(f["hi"]).cast("long").alias("hi"))

    def joined(f: Column, x: Column) -> Column:
        at = lambda c: F.least(x["f"]["hi"], F.greatest(x["f"]["lo"], c + x["f"]["s"]))
        return F.struct((f["s"] + x["f"]["s"]).alias("s"), at(f["lo"]).alias("lo"), at(f["hi"]).alias("hi"))

    minutes = blocks.groupBy(*key, "_d", "_m").agg(F.aggregate(F.sort_array(F.collect_list(F.struct(*ORDER, "correct"))), none, step).alias("f"))
    days = minutes.groupBy(*key, "_d").agg(F.aggregate(F.sort_array(F.collect_list(F.struct("_m", "f"))), none, joined).alias("f"))
    whole = days.groupBy(*key).agg(F.aggregate(F.sort_array(F.collect_list(F.struct("_d", "f"))), none, joined).alias("f"))
    return whole.select(*key, F.least(F.col("f.hi"), F.greatest(F.col("f.lo"), F.col("f.s"))).cast("int").alias("urgency"))


def recent(answers: DataFrame, key: str, item: str, n: int = 4) -> Column:
    """The last n items up to this answer."""
    return F.collect_list(item).over(W.partitionBy(key).orderBy(*ORDER).rowsBetween(1 - n, 0))


def mastered(correct: Column, total: Column) -> Column:
    return (correct >= 3) & (correct / F.nullif(total, F.lit(0)) >= 0.75)


def progress(answers: DataFrame, *key: str) -> DataFrame:
    return answers.groupBy(*key).agg(F.count_if("correct").alias("correct"), F.count_if(~F.col("correct")).alias("incorrect"), F.max("ts").alias("last_seen"))


def mastery(items: DataFrame, done: DataFrame, key: str, by: str) -> DataFrame:
    """total, mastered and percent of items by group. done: correct, incorrect by key."""
    m = items.join(done, key, "left").select(by, F.coalesce(mastered(F.col("correct"), F.col("correct") + F.col("incorrect")), F.lit(False)).alias("_m"))
    out = m.groupBy(by).agg(F.count("*").alias("total"), F.count_if("_m").alias("mastered"))
    return out.withColumn("percent", T.percent(F.col("mastered"), F.col("total")))


def weight(seen: Column, correct: Column, incorrect: Column, streak: Column, urgency_: Column) -> Column:
    """Sampling weight of a word; one without state weighs 1.5."""
    w = 1 + 0.8 * urgency_ + F.when(seen == 0, 0.4).otherwise(0.0)
    w = w * F.when(correct > incorrect, 0.75).otherwise(1.0) * F.when(incorrect > correct, 1.2).otherwise(1.0) * F.when(streak >= 2, 0.7).otherwise(1.0)
    return F.when(seen.isNull(), F.lit(1.5)).otherwise(F.greatest(w, F.lit(0.2)))


def weighted_pick(pool: DataFrame, part: str, item: str, weight_col: str, r: Column) -> DataFrame:
    """The first item, in order, at which the running weight reaches r of the total.

    Items are put in ranges, whose sums tell the range that has the item; only its rows are
    summed one by one, so no task sees a part as a whole."""
    own = saved(pool.select(part, item, F.col(weight_col).alias("_w"), r.alias("_r")))  # ranges are drawn from a sample: a second reading
    own = saved(own.repartitionByRange(part, item).withColumn("_range", F.spark_partition_id()))  # ranges hold from here on
    sums = own.groupBy(part, "_range").agg(F.sum("_w").alias("_sum"), F.max("_r").alias("_r"))
    upto = sums.withColumn("_upto", F.sum("_sum").over(W.partitionBy(part).orderBy("_range"))).withColumn("_total", F.sum("_sum").over(W.partitionBy(part)))
    chosen = upto.where(F.col("_upto") >= F.col("_r") * F.col("_total")).groupBy(part).agg(F.min_by(F.struct("_range", (F.col("_upto") - F.col("_sum")).alias("_before"), (F.col("_r") * F.col("_total")).alias("_at")), "_range").alias("c"))
    inside = own.join(chosen.select(part, "c.*"), [part, "_range"])
    run = inside.withColumn("_cum", F.col("_before") + F.sum("_w").over(W.partitionBy(part, "_range").orderBy(item)))
    return run.where(F.col("_cum") >= F.col("_at")).groupBy(part).agg(F.min(item).alias(item))


def session_summary(answers: DataFrame, key: str) -> DataFrame:
    """seen, correct, accuracy, best streak and duration in seconds."""
    s = streaks(answers, key)
    out = s.groupBy(key).agg(F.count("*").alias("seen"), F.count_if("correct").alias("correct"), F.max("streak").cast("long").alias("best_streak"), (F.unix_seconds(F.max("ts").cast("timestamp")) - F.unix_seconds(F.min("ts").cast("timestamp"))).alias("duration_s"))
    return out.withColumn("accuracy", T.percent(F.col("correct"), F.col("seen")))
