"""Fill-missing merge of chunk answers into words, and rewriting only what it changes.

Chunks are folded in order (chunk, then row). A word's own value stays where it has one:

* context_definition, etymology: the first chunk that has a value fills an empty one;
* translation of context i: likewise, from the chunk's context i;
* morphology of a form: while it is bare, each chunk with a morphology for the form replaces
  it, so the first detailed one ends the walk, or else the last one stays.

A row of a chunk changes its word if it fills or replaces anything. Words no chunk knows,
ids no word has, and chunks that don't exist change nothing.

No list of a word's rows is made: every value is a row (id, slot, place, value); by slot the
first closing place and its value, or the last value, decide, which Spark aggregates before
it shuffles, so a word may be in any number of chunks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.functions.text import truthy
from lexispark.operators.enrich import bare
from lexispark.session import saved

#: Columns of a word that a chunk may fill. Fixed names of the format.
SCALARS = ("context_definition", "etymology")


def _values(rows: DataFrame, key: str, place: list[Column]) -> DataFrame:
    """key, slot, value, place and name of each value of words or chunk rows. Slots:
    a scalar's name, t<i> for context i, f<form> for a form."""
    slot = lambda s, v: F.struct(s.alias("slot"), v.alias("value"))
    scalars = F.array(*[slot(F.lit(c), F.col(c)) for c in SCALARS])
    contexts = F.coalesce(F.transform("contexts", lambda c, i: slot(F.concat(F.lit("t"), i.cast("string")), c["translation"])), F.array())
    later = lambda i: F.slice("forms", i + 2, F.size("forms"))
    last = F.filter("forms", lambda f, i: ~F.exists(later(i), lambda g: g["form"] == f["form"]))
    forms = F.coalesce(F.transform(last, lambda f: slot(F.concat(F.lit("f"), f["form"]), f["morphology"])), F.array())
    return rows.select(key, *place, F.explode(F.concat(scalars, contexts, forms)).alias("v")).select(key, *[p for p in ("chunk", "row") if place], "v.slot", "v.value")


def open_slots(words: DataFrame, key: str = "id") -> DataFrame:
    """key, slot of what a chunk may fill: empty values, and forms of bare morphology."""
    slot = lambda cond, s: F.when(cond, s)
    scalars = F.array(*[slot(truthy(F.col(c)).isNull(), F.lit(c)) for c in SCALARS])
    contexts = F.coalesce(F.transform("contexts", lambda c, i: slot(truthy(c["translation"]).isNull(), F.concat(F.lit("t"), i.cast("string")))), F.array())
    forms = F.coalesce(F.transform("forms", lambda f: slot(bare(f["morphology"]), F.concat(F.lit("f"), f["form"]))), F.array())
    return words.select(key, F.explode(F.concat(scalars, contexts, forms)).alias("slot")).where("slot IS NOT NULL").distinct()


def merge_chunks(words: DataFrame, chunks: DataFrame, key: str = "id") -> DataFrame:
    """The words, filled, with n_changes: how many rows of chunks changed each.

    words and chunks: key, context_definition, etymology, contexts (structs with a
    translation), forms (structs of form and morphology); chunks also chunk and row, which
    order them. A null key takes nothing. Words of one key all take the same."""
    own = _values(chunks.where(F.col(key).isNotNull()), key, [F.col("chunk"), F.col("row")])
    own = own.where(truthy(F.col("value")).isNotNull() & F.col("slot").isNotNull())
    place = F.struct("chunk", "row")
    closes = ~F.startswith("slot", F.lit("f")) | ~bare(F.col("value"))
    first = F.when(closes, place)
    by = own.groupBy(key, "slot").agg(
        F.min(first).alias("end"), F.min_by("value", first).alias("closing"), F.max_by("value", place).alias("last")
    )
    won = by.join(open_slots(words, key), [key, "slot"], "left_semi").select(key, "slot", "end", F.when(F.col("end").isNotNull(), F.col("closing")).otherwise(F.col("last")).alias("new"))
    won = saved(won)
    filled = won.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("slot", "new"))).alias("_new"))  # a word's own slots
    applied = own.join(won.select(key, "slot", "end"), [key, "slot"]).where(F.col("end").isNull() | (place <= F.col("end")))
    changes = applied.select(key, "chunk", "row").distinct().groupBy(key).agg(F.count("*").alias("n_changes"))
    j = words.join(filled, key, "left").join(changes, key, "left")
    new = lambda s: F.try_element_at("_new", s)
    contexts = F.transform("contexts", lambda c, i: c.withField("translation", F.when(truthy(c["translation"]).isNull(), F.coalesce(new(F.concat(F.lit("t"), i.cast("string"))), c["translation"])).otherwise(c["translation"])))
    forms = F.transform("forms", lambda f: f.withField("morphology", F.when(bare(f["morphology"]), F.coalesce(new(F.concat(F.lit("f"), f["form"])), f["morphology"])).otherwise(f["morphology"])))
    value = {"contexts": contexts, "forms": forms} | {c: F.coalesce(truthy(F.col(c)), new(F.lit(c)), F.col(c)) for c in SCALARS}
    return j.select(*[value.get(c, F.col(c)).alias(c) for c in words.columns], F.coalesce("n_changes", F.lit(0)).cast("long").alias("n_changes"))


def merge_into(spark: SparkSession, path: str, chunks: DataFrame, part: str, key: str = "id") -> int:
    """Merges chunks into the table of words at a path, which is partitioned by part, and
    returns how many rows of chunks changed a word. Only partitions with a changed word are
    written again, each swapped for its new rows at once; a merge that is broken off and run
    again gives the same table."""
    words = spark.read.parquet(path)
    open_ = open_slots(words, key).join(_values(chunks, key, []).where(truthy(F.col("value")).isNotNull()), [key, "slot"], "left_semi")
    touched = words.join(open_.select(key).distinct(), key, "left_semi").select(part).distinct()
    merged = merge_chunks(words.join(touched, part, "left_semi"), chunks, key)
    staged = saved(merged)  # rows are read to the end before any of their files goes
    n = staged.agg(F.coalesce(F.sum("n_changes"), F.lit(0)).alias("n")).first()["n"]
    if n:
        changed = staged.join(staged.where("n_changes > 0").select(part).distinct(), part, "left_semi")
        changed.drop("n_changes").select(*words.columns).repartition(part).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(part).parquet(path)
    return n
