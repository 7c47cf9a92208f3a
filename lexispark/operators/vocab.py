"""Corpus to graded vocabulary: tokens, counts, ranks, levels, contexts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lexispark.functions import text as T

# Lemmas and parts of speech that carry no content (Greek).
STOP_LEMMAS = tuple(
    "ὁ ἡ τό ὅ μέν δέ γάρ ἄν γε δή οὖν τε ἄρα τοι τοίνυν μήν που πω πώποτε καί ἀλλά ἤ εἰ ὅτι ὡς ὥστε ἐπεί ἐπειδή ἐπειδάν ὅτε ὅταν ἕως πρίν "
    "ἐν ἐκ ἐξ εἰς πρός ἀπό ὑπό κατά μετά περί παρά ἐπί διά σύν ἀνά πρό οὐ οὐκ οὐχ μή οὐδέ μηδέ ἐγώ σύ αὐτός ἑαυτοῦ οὗτος ἐκεῖνος ὅς ὅστις τις τί οὐδείς μηδείς πᾶς εἰμί φημί".split()
)
STOP_POS = ("PART", "CONJ", "SCONJ", "DET", "ADP", "INTJ")


def drop_stop_words(df: DataFrame, stop: tuple[str, ...] = STOP_LEMMAS, lemma: str = "lemma", pos: str | None = None, stop_pos: tuple[str, ...] = STOP_POS) -> DataFrame:
    """Anti join with the stop list, then with the stop parts of speech."""
    out = df.where(~F.col(lemma).isin(*stop))
    return out if pos is None else out.where(~F.coalesce(F.col(pos), F.lit("")).isin(*stop_pos))


def tokens(docs: DataFrame, id_col: str, text_col: str, *keep: str) -> DataFrame:
    """A row for each token with its place."""
    return docs.select(id_col, *keep, F.posexplode(T.words(F.coalesce(F.col(text_col), F.lit("")))).alias("token_ord", "token"))


def frequencies(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.count("*").alias("frequency"))


def ranked(df: DataFrame, part: list[str], measure: str, name: str, prefix: int = 2) -> DataFrame:
    """rank (1, 2, ...) by measure descending, then name, and n, the rows of the part.

    No window holds a whole part: rows are ranked among those of equal measure and name
    prefix, and the counts of these small groups, cumulated, give the ranks before. Groups
    grow in number with the rows, so they don't go through the driver (the hint)."""
    own = df.withColumn("_p", F.substring(name, 1, prefix))
    groups = own.groupBy(*part, measure, "_p").agg(F.count("*").alias("_c"))
    measures = groups.groupBy(*part, measure).agg(F.sum("_c").alias("_m"))
    by_measure = W.partitionBy(*part).orderBy(F.desc(measure))
    measures = measures.select(*part, measure, (F.sum("_m").over(by_measure) - F.col("_m")).alias("_before"), F.sum("_m").over(W.partitionBy(*part)).alias("n"))
    inside = W.partitionBy(*part, measure).orderBy("_p")
    groups = groups.withColumn("_inside", F.sum("_c").over(inside) - F.col("_c")).join(measures.hint("merge"), [*part, measure]).select(*part, measure, "_p", (F.col("_before") + F.col("_inside")).alias("_before"), "n")
    row = F.row_number().over(W.partitionBy(*part, measure, "_p").orderBy(name))
    return own.withColumn("_r", row).join(groups.hint("merge"), [*part, measure, "_p"]).withColumn("rank", (F.col("_r") + F.col("_before")).cast("long")).drop("_r", "_p", "_before")


def level(rank: Column, n: Column, k: int = 3) -> Column:
    """Level 1 to k of the row with this rank."""
    return F.least(F.lit(k), F.floor((rank - 1) * k / n) + 1).cast("int")


def first_value(value: Column, order: Column) -> Column:
    """The first non-empty value."""
    return F.min_by(F.when(value != "", value), F.when(value != "", order))


def nested_forms(forms: DataFrame, *by: str) -> DataFrame:
    """Per lemma its forms, most frequent first, then by first place. forms: form,
    morphology, occurrences, first_ord."""
    s = F.sort_array(F.collect_list(F.struct((-F.col("occurrences")).alias("o"), "first_ord", "form", "morphology", "occurrences")))
    return forms.groupBy(*by).agg(F.transform(s, lambda x: F.struct(x["form"].alias("form"), x["morphology"].alias("morphology"), x["occurrences"].alias("occurrences"))).alias("forms"))


def context_candidates(candidates: DataFrame, *by: str, most: int = 3, ref_first: bool = False) -> DataFrame:
    """The candidates that may be among the first ``most`` contexts of their lemma whose ref
    and form are both new: of each ref and form the first, and of these (2 most - 1)(most - 1)
    + 1 a lemma at most. candidates: ord, ref, form, and sentence or start.

    A row behind ``most`` rows of its ref can't be chosen: none of theirs was (or the ref is
    taken), so ``most`` other forms are. The same holds of forms. What is left of a ref or a
    form is ``most`` rows, so a chosen row shuts out 2 most - 2 others. Each limit is kept in
    the tasks before the shuffle too. ref_first says that ord goes by ref first, so that the
    first ``most`` refs of a form are known before rows of the same ref are joined up."""
    carry = ["sentence"] if "sentence" in candidates.columns else []
    found = candidates.withColumn("start", T.find_form(F.col("sentence"), F.col("form"))) if carry else candidates
    found = found.where("start >= 0")
    if ref_first:
        found = found.withColumn("_r", F.dense_rank().over(W.partitionBy(*by, "form").orderBy(F.asc_nulls_last("ref")))).where(F.col("_r") <= most).drop("_r")
    first = found.groupBy(*by, "ref", "form").agg(F.min_by(F.struct("ord", *carry, "start"), "ord").alias("c")).select(*by, "ref", "form", "c.*")
    for part, n in ((["ref"], most), (["form"], most), ([], (2 * most - 1) * (most - 1) + 1)):
        first = first.withColumn("_r", F.row_number().over(W.partitionBy(*by, *part).orderBy("ord", "ref", "form"))).where(F.col("_r") <= n).drop("_r")
    return first


def select_contexts(candidates: DataFrame, *by: str, most: int = 3, ref_first: bool = False) -> DataFrame:
    """Per lemma the first contexts whose ref and form are both new, at most ``most``; a ref
    that is missing is always new. candidates: ord, ref, form, sentence; or start, the form's
    place, in place of sentence, and the contexts have none.

    Forms not found in their sentence are no candidates. The lists are short, however many
    candidates a lemma has (context_candidates)."""
    first = context_candidates(candidates, *by, most=most, ref_first=ref_first)
    carry = ["sentence"] if "sentence" in first.columns else []
    item = F.struct("ord", "ref", "form", *carry, F.col("start").alias("highlight_start"), (F.col("start") + F.length("form")).alias("highlight_end"))
    lists = first.groupBy(*by).agg(F.sort_array(F.collect_list(item)).alias("_c"))
    seen = lambda acc, x: F.coalesce(F.exists(acc, lambda y: (y["ref"] == x["ref"]) | (y["form"] == x["form"])), F.lit(False))
    new = lambda acc, x: (F.size(acc) < most) & ~seen(acc, x)
    return lists.withColumn("contexts", F.aggregate("_c", F.slice("_c", 1, 0), lambda acc, x: F.when(new(acc, x), F.concat(acc, F.array(x))).otherwise(acc))).drop("_c")


def apply_overrides(rows: DataFrame, overrides: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Columns replaced where an override gives a value."""
    o = overrides.select(*keys, *[F.col(c).alias(f"_o_{c}") for c in columns])
    out = rows.join(o, keys, "left")
    return out.withColumns({c: F.coalesce(f"_o_{c}", c) for c in columns}).drop(*[f"_o_{c}" for c in columns])


def upsert(index: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of the index updated in place by key, others appended."""
    cols = [c for c in index.columns if c != key]
    n = new.select(key, *[F.col(c).alias(f"_n_{c}") for c in cols], F.lit(True).alias("_new"))
    out = index.join(n, key, "full_outer")
    return out.select(key, *[F.when(F.col("_new"), F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c) for c in cols])


def totals(lemmas: DataFrame, *by: str) -> DataFrame:
    """total_words and unique_lemmas of each work, of lemmas with their frequency."""
    return lemmas.groupBy(*by).agg(F.sum("frequency").alias("total_words"), F.count("*").alias("unique_lemmas"))
