"""Data quality: each check is a predicate; what fails it is a row of violations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexispark.operators.enrich import detailed
from lexispark.operators.highlight import CONFIDENCE


def blank(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit(""))) == ""


def violations(df: DataFrame, row_id: list[str], checks: dict[str, Column]) -> DataFrame:
    """row_id, code: a row for each failed check; a check that is null has not failed."""
    codes = F.array_compact(F.array(*[F.when(bad, F.lit(code)) for code, bad in checks.items()]))
    return df.select(*row_id, F.explode(codes).alias("code"))


def bad_span(start: Column, end: Column, size: Column) -> Column:
    return ~F.coalesce((start >= 0) & (start < end) & (end <= size), F.lit(False))


def check_metadata(meta: DataFrame) -> DataFrame:
    checks = {f"metadata.{c}": blank(F.col(c)) for c in ("title", "author", "work_id")}
    checks |= {f"metadata.{c}": ~F.coalesce(F.col(c) > 0, F.lit(False)) for c in ("total_words", "unique_lemmas")}
    return violations(meta, ["work_id"], checks)


def check_words(words: DataFrame) -> DataFrame:
    """work_id, id, code of every word that breaks the contract."""
    twice = words.where("id IS NOT NULL").groupBy("work_id", "id").agg(F.count("*").alias("_n")).where("_n > 1")
    own = words.join(twice, ["work_id", "id"], "left")
    any_form = lambda bad: F.coalesce(F.exists("forms", bad), F.lit(False))
    any_context = lambda bad: F.coalesce(F.exists("contexts", bad), F.lit(False))
    has = lambda c: ~blank(c["translation"])
    method, sure = lambda c: c["translation_highlight_method"], lambda c: c["translation_highlight_confidence"]
    bounds = lambda c: (c["translation_highlight_start"], c["translation_highlight_end"])
    checks = {
        "id.missing": F.col("id").isNull(),
        "id.duplicate": F.col("_n").isNotNull(),
        "lemma": blank(F.col("lemma")),
        "definition": blank(F.col("definition")),
        "pos": blank(F.col("pos")),
        "level": ~F.coalesce(F.col("level").between(1, 3), F.lit(False)),
        "frequency": ~F.coalesce(F.col("frequency") > 0, F.lit(False)),
        "forms.empty": F.coalesce(F.size("forms"), F.lit(0)) <= 0,
        "forms.form": any_form(lambda f: blank(f["form"])),
        "forms.morphology": any_form(lambda f: f["morphology"].isNull()),
        "forms.occurrences": any_form(lambda f: ~F.coalesce(f["occurrences"] > 0, F.lit(False))),
        "contexts.text": any_context(lambda c: blank(c["ref"]) | blank(c["form"]) | blank(c["sentence"])),
        "contexts.span": any_context(lambda c: bad_span(c["highlight_start"], c["highlight_end"], F.length(c["sentence"]))),
        "context_definition": F.col("context_definition").isNotNull() & blank(F.col("context_definition")),
        "etymology": F.col("etymology").isNotNull() & blank(F.col("etymology")),
        "translation": any_context(lambda c: c["translation"].isNotNull() & blank(c["translation"])),
        "highlight.method": any_context(lambda c: has(c) & ~F.coalesce(method(c).isin(*CONFIDENCE), F.lit(False))),
        "highlight.confidence": any_context(lambda c: has(c) & ~F.coalesce(sure(c).isin("high", "medium", "low"), F.lit(False))),
        "highlight.bounds": any_context(lambda c: has(c) & F.when(method(c) == "none", bounds(c)[0].isNotNull() | bounds(c)[1].isNotNull()).otherwise(bad_span(*bounds(c), F.length(c["translation"])))),
    }
    return violations(own, ["work_id", "id"], checks)


def check_works(words: DataFrame, meta: DataFrame, index: DataFrame | None = None, levels: int = 3) -> DataFrame:
    """work_id, code of checks on whole works: levels, counts, presence in the index."""
    per = words.groupBy("work_id").agg(F.collect_set("level").alias("levels"), F.count("*").alias("n"))
    all_levels = F.array(*[F.lit(i) for i in range(1, levels + 1)])
    j = meta.join(per, "work_id", "left")
    checks = {"words.empty": F.col("n").isNull(), "levels.missing": F.size(F.array_except(all_levels, "levels")) > 0, "unique_lemmas.count": F.col("unique_lemmas") != F.col("n")}
    out = violations(j, ["work_id"], checks)
    if index is not None:
        out = out.unionByName(meta.join(index.select(F.col("id").alias("work_id")), "work_id", "left_anti").select("work_id", F.lit("index.missing").alias("code")))
    return out


def verdict(meta: DataFrame, *found: DataFrame) -> DataFrame:
    """work_id, has_reference_system (told, never a failure), failures, ok: whether no check
    of the work failed. found: frames of violations with a work_id."""
    rows = found[0].select("work_id")
    for f in found[1:]:
        rows = rows.unionByName(f.select("work_id"))
    per = rows.groupBy("work_id").agg(F.count("*").alias("failures"))
    failures = F.coalesce("failures", F.lit(0))
    known = (~blank(F.col("reference_system"))).alias("has_reference_system")
    return meta.join(per, "work_id", "left").select("work_id", known, failures.alias("failures"), (failures == 0).alias("ok"))


def run_verdict(works: DataFrame) -> DataFrame:
    """One row over all works of verdict(): works, failed, failures, ok; nothing is ok of no
    works."""
    return works.agg(F.count("*").alias("works"), F.count_if(~F.col("ok")).alias("failed"), F.coalesce(F.sum("failures"), F.lit(0)).cast("long").alias("failures"), F.coalesce(F.bool_and("ok"), F.lit(False)).alias("ok"))


def coverage(words: DataFrame) -> DataFrame:
    """One row: words with gloss, etymology, contexts; translated contexts; detail."""
    many = F.coalesce(F.size("forms") >= 2, F.lit(False))
    translated = lambda c: F.trim(F.coalesce(c["translation"], F.lit(""))) != ""
    return words.agg(
        F.count("*").alias("words"),
        F.count_if(~blank(F.col("context_definition"))).alias("glossed"),
        F.count_if(~blank(F.col("etymology"))).alias("etymologies"),
        F.count_if(F.coalesce(F.size("contexts") > 0, F.lit(False))).alias("with_contexts"),
        F.coalesce(F.sum(F.when(F.col("contexts").isNotNull(), F.size("contexts"))), F.lit(0)).alias("contexts"),
        F.coalesce(F.sum(F.size(F.filter("contexts", translated))), F.lit(0)).alias("translated"),
        F.count_if(many).alias("multi_form"),
        F.count_if(detailed(F.col("forms"))).alias("detailed"),
    )
