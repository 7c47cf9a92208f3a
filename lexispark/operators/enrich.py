"""Enrichment dataflow: selection, chunks, contract checks, merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexispark.functions.text import truthy


def bare(morphology: Column) -> Column:
    """A morphology without any detail."""
    m = F.trim(F.coalesce(morphology, F.lit("")))
    return (m == "") | ~m.rlike("[ ,]")


def detailed(forms: Column) -> Column:
    """Two forms or more, one of them with detail."""
    return F.coalesce((F.size(forms) >= 2) & F.exists(forms, lambda f: ~bare(f["morphology"])), F.lit(False))


def needs_enrichment(mode: str, forms: Column, contexts: Column, context_definition: Column, etymology: Column) -> Column:
    some_bare = F.coalesce(F.exists(forms, lambda f: bare(f["morphology"])), F.lit(False))
    if mode == "etymology-only":
        return truthy(etymology).isNull()
    if mode == "morph-only":
        return some_bare
    untranslated = F.coalesce(F.exists(contexts, lambda c: truthy(c["translation"]).isNull()), F.lit(False))
    return truthy(context_definition).isNull() | untranslated | some_bare


def ordered_semi_join(df: DataFrame, ids: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows of df with the place of their id in the list (pos), and the ids not found.
    ids: pos, key; of an id listed twice the first place counts."""
    first = ids.groupBy(key).agg(F.min("pos").alias("pos"))
    return df.join(first, key), first.join(df.select(key), key, "left_anti")


def chunked(df: DataFrame, rank: Column, size: Column) -> DataFrame:
    """chunk number (0, 1, ...) of rows ranked from 1."""
    return df.withColumn("chunk", F.floor((rank - 1) / size).cast("long"))


def balanced_size(n: Column, workers: int) -> Column:
    return F.greatest(F.ceil(n / workers), F.lit(1))


def one_to_one(expected: DataFrame, got: DataFrame, key: str) -> DataFrame:
    """key, status: ok, missing, extra or duplicate."""
    e = expected.select(key).distinct().withColumn("_e", F.lit(True))
    g = got.groupBy(key).agg(F.count("*").alias("_g"))
    status = F.when(F.col("_g").isNull(), "missing").when(F.col("_e").isNull(), "extra").when(F.col("_g") > 1, "duplicate").otherwise("ok")
    return e.join(g, key, "full_outer").select(key, status.alias("status"))


def fill_missing(original: DataFrame, chunk: DataFrame, key: str, columns: list[str], overwrite: bool = False) -> DataFrame:
    """Columns taken from the chunk where the original is empty, and changed."""
    c = chunk.select(key, *[F.col(x).alias(f"_c_{x}") for x in columns])
    out = original.join(c, key, "left")
    old, new = {x: truthy(F.col(x)) for x in columns}, {x: truthy(F.col(f"_c_{x}")) for x in columns}
    value = {x: F.coalesce(new[x], old[x]) if overwrite else F.coalesce(old[x], new[x]) for x in columns}
    changed = F.lit(False)
    for x in columns:
        changed = changed | ~F.coalesce(value[x], F.lit("")).eqNullSafe(F.coalesce(old[x], F.lit("")))
    return out.select(*[c for c in original.columns if c not in columns], *[value[x].alias(x) for x in columns], changed.alias("changed"))


def zip_translations(contexts: Column, translations: Column) -> Column:
    """Context i takes translation i where there is one."""
    return F.transform(contexts, lambda c, i: c.withField("translation", F.coalesce(truthy(F.get(translations, i)), c["translation"])))


def merge_morphology(forms: Column, answer: Column, only_bare: bool) -> Column:
    """Forms take the morphology that an answer gives for the same form."""
    known = F.map_from_entries(F.transform(F.filter(answer, lambda a: a["morphology"] != ""), lambda a: F.struct(a["form"], a["morphology"])))
    new = lambda f: F.try_element_at(known, f["form"])
    take = lambda f: new(f).isNotNull() & (bare(f["morphology"]) if only_bare else F.lit(True))
    return F.transform(forms, lambda f: f.withField("morphology", F.when(take(f), new(f)).otherwise(f["morphology"])))


def id_list(c: Column) -> Column:
    """Comma-separated ids; blanks are skipped, an empty list is null."""
    ids = F.transform(F.filter(F.split(c, ","), lambda x: F.trim(x) != ""), lambda x: F.trim(x).cast("long"))
    return F.when(F.size(ids) > 0, ids)


def unwrap_response(c: Column) -> Column:
    """The JSON array of an answer, out of its code fence or wrapping object."""
    bare_text = F.regexp_replace(F.regexp_replace(F.trim(c), r"^```[a-zA-Z]*\s*", ""), r"\s*```$", "")
    lists = [F.get_json_object(bare_text, f"$.{k}") for k in ("enrichments", "response", "results")]
    quoted = [F.get_json_object(bare_text, f"$.{k}[0]").isNotNull() | (x == "[]") for k, x in zip(("enrichments", "response", "results"), lists, strict=True)]
    wrapped = F.coalesce(*[F.when(is_list, x) for is_list, x in zip(quoted, lists, strict=True)])
    return F.when(F.startswith(bare_text, F.lit("[")), bare_text).otherwise(wrapped)


def unresolved(words: DataFrame) -> DataFrame:
    """Contexts that have a translation but no highlight in it: the word's columns with
    context_id ("id:place"), context and gloss (its own, else the definition)."""
    own = words.select("*", F.posexplode("contexts").alias("_i", "context"))
    some = F.trim(F.coalesce("context.translation", F.lit(""))) != ""
    gloss = F.coalesce(F.when(F.trim("context_definition") != "", F.col("context_definition")), F.col("definition"))
    found = own.where(some & (F.col("context.translation_highlight_method") == "none"))
    return found.withColumn("context_id", F.concat_ws(":", "id", "_i")).withColumn("gloss", gloss).drop("_i")


def methods(words: DataFrame) -> DataFrame:
    """method, n: how many translated contexts each highlight method has found."""
    c = words.select(F.explode("contexts").alias("c"))
    c = c.where(F.trim(F.coalesce("c.translation", F.lit(""))) != "")
    return c.groupBy(F.col("c.translation_highlight_method").alias("method")).agg(F.count("*").alias("n"))


def requests(words: DataFrame, mode: str) -> DataFrame:
    """What a provider is asked about each word: full mode has forms and contexts, morph-only
    no contexts, etymology-only neither."""
    forms = F.transform("forms", lambda f: F.struct(f["form"].alias("form"), f["morphology"].alias("morphology"))).alias("forms")
    contexts = F.transform("contexts", lambda c: F.struct(c["ref"].alias("ref"), c["form"].alias("form"), c["sentence"].alias("sentence"))).alias("contexts")
    more = {"full": [forms, contexts], "morph-only": [forms], "etymology-only": []}
    if mode not in more:
        raise ValueError(f"no mode {mode!r}")
    return words.select("work_id", "id", "lemma", "definition", "pos", *more[mode])


def id_union(a: Column, b: Column) -> Column:
    """The ids of both lists in order, each once."""
    return F.array_distinct(F.concat(a, b))
