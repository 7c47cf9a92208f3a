"""Operator 4: quality rules as a short-circuit cascade, in DataFrame functions alone.

Base figures come from one pass over the words of each text. The further rules are tried
on a bounded sample of rows, drawn from all of the table: each is timed over so many copies
of the sample that it takes a fifth of a second more than a run without rules. The cascade
asks first the rule that rejects most per cost, then the one that rejects most per cost of
the rows that this leaves, and so on; a row is asked no more once rejected. The order
changes the work, never the verdict, since a row is kept only if no rule rejects it.

Rows: null and empty texts have no words and fail the base; repeated rows give a row
each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexispark.llm import common as C

BLANKS = r"[\x20\x09-\x0D]+"


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with the value computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _repeat_words(hashes: Column, k: int) -> Column:
    """Words covered by windows of k words that occur twice or more."""

    def of_grams(grams: Column) -> Column:
        def of_sorted(s: Column) -> Column:
            same = lambda i, j: F.get(s, i)["g"] == F.get(s, j)["g"]
            twin = lambda x, i: F.coalesce(same(i, i - 1), F.lit(False)) | F.coalesce(same(i, i + 1), F.lit(False))
            places = F.sort_array(F.transform(F.filter(s, twin), lambda x: x["i"]))
            return let(places, lambda p: F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(k), F.coalesce(F.get(p, i + 1) - x, F.lit(k)))), F.lit(0).cast("long"), lambda a, x: a + x))

        ranked = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0).cast("long")).otherwise(let(ranked, of_sorted))

    grams = let(hashes, lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - k), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(k)])))
    return F.when(F.size(hashes) < k + 1, F.lit(0).cast("long")).otherwise(let(grams, of_grams))


def base_figures(docs: DataFrame, id_col: str, text_col: str, k: int = 5) -> DataFrame:
    """doc_id, text and the base figures, each text split once."""
    source = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    text = F.coalesce("text", F.lit(""))
    words = F.array_remove(F.split(text, BLANKS), "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    figures = F.struct(
        let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: F.struct(F.size(h).cast("long").alias("n_words"), _repeat_words(h, k).alias("n_repeat_words"))).alias("w"),
        F.length(F.regexp_replace(text, BLANKS, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))).alias("l"),
    )
    # a generator is no projection that could be merged into those above, so its value is made once
    return source.select("doc_id", "text", F.inline(F.array(figures))).select("doc_id", "text", "w.n_words", "word_chars", "n_symbols", "l.n_dup_lines", "w.n_repeat_words", "l.n_lines")


def rules() -> dict[str, Column]:
    """Name -> rejects. Figures of base_figures() and the text may be used."""
    n, text = F.col("n_words"), F.coalesce("text", F.lit(""))
    letters = F.length(F.regexp_replace(text, r"\P{L}+", ""))
    return {
        "symbols": 10 * F.col("n_symbols") > n,
        "word_length": (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 20 * n),
        "dup_lines": 10 * F.col("n_dup_lines") > 3 * F.col("n_lines"),
        "letters": 10 * letters < 6 * F.col("word_chars"),
        "shouting": 2 * F.length(F.regexp_replace(text, r"\P{Lu}+", "")) > letters,
        "exclamation": 5 * F.length(F.regexp_replace(text, r"[^!?]+", "")) > n,
    }


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def rule_costs(sample: DataFrame, found: dict[str, Column], least: float = 0.2, floor: float = 1e-7) -> dict[str, float]:
    """Seconds of one core a row of each rule, less those of reading the row. The sample is
    repeated four times as often until a rule takes ``least`` seconds by itself. Rules that
    compare figures take no longer than the clock is unsure of: none costs less than
    ``floor``, so such rules go by what they reject alone."""
    rows = max(sample.count(), 1)
    one = sample.coalesce(1)

    def timed(reject: Column, copies: int) -> float:
        many = one.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.lit(copies))))
        t = time.perf_counter()
        many.agg(F.count_if(reject)).first()
        return time.perf_counter() - t

    nothing: dict[int, float] = {}
    costs = {}
    for name, reject in found.items():
        copies = max(1, 4000 // rows)
        timed(reject, 1)  # its code is made
        while True:
            if copies not in nothing:
                nothing[copies] = min(timed(F.col("n_words") < 0, copies) for _ in range(2))
            own = timed(reject, copies) - nothing[copies]
            if own >= least or rows * copies * floor >= least:
                break
            copies *= 4
        costs[name] = max(own / (rows * copies), floor)
    return costs


def cascade_order(kinds: dict[tuple[bool, ...], int], costs: dict[str, float]) -> list[str]:
    """Names of rules, best first: most rejections per cost of the rows that the rules before
    leave. kinds: how many rows are rejected by just these rules (in the order of costs)."""
    names, left, order = list(costs), dict(kinds), []
    while len(order) < len(names):
        rows = sum(left.values())
        share = lambda i: (sum(n for k, n in left.items() if k[i]) + 0.5) / (rows + 1)  # noqa: B023, E731
        best = max((i for i in range(len(names)) if names[i] not in order), key=lambda i: share(i) / costs[names[i]])
        order.append(names[best])
        left = {k: n for k, n in left.items() if not k[best]}
    return order


def order_rules(sample: DataFrame, found: dict[str, Column]) -> list[str]:
    """The order of the rules for rows like those of the sample (base figures)."""
    asked = sample.where(~base_failed())
    flags = [F.coalesce(reject, F.lit(False)).alias(f"r{i}") for i, reject in enumerate(found.values())]
    kinds = asked.select(*flags).groupBy(*[f"r{i}" for i in range(len(found))]).agg(F.count("*").alias("n"))
    kinds = {tuple(r)[:-1]: r.n for r in kinds.collect()}  # as many rows as the sample at most
    return cascade_order(kinds, rule_costs(asked, found)) if kinds else list(found)


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = 1000) -> DataFrame:
    """Base figures, base_failed, rejected_by (the first rule of the cascade that
    rejects, if any) and kept. The order of the rules is estimated on about sample_rows
    rows (never more than twice as many) of all parts of docs, which is counted for it."""
    found = rules()
    figures = base_figures(docs, id_col, text_col)
    share = min(1.0, sample_rows / max(docs.count(), 1))
    order = order_rules(C.written(base_figures(docs.sample(share, seed=7).limit(2 * sample_rows), id_col, text_col)), found)
    cascade = F.when(F.col("base_failed"), F.lit("base"))
    for name in order:
        cascade = cascade.when(found[name], F.lit(name))
    out = figures.withColumn("base_failed", base_failed()).withColumn("rejected_by", cascade)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "rejected_by", F.col("rejected_by").isNull().alias("kept"))
