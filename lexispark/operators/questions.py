"""Questions: distractors, choices and forms, with seeded picks.

Random choices follow md5 of seed and id, so that they can be repeated anywhere. A word's
distractors are its next neighbours on a ring in md5 order, first of its own part of
speech, then of all, as far as it takes: equi joins in rounds, never a join of all with all.
Joins with tables that grow with the words have a hint, since Spark would send such tables
through the driver, one a join, for as long as their files are small."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lexispark.functions import text as T
from lexispark.operators import vocab as V
from lexispark.session import saved


def shade(*parts: Column, seed: int = 0) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def shuffled(items: Column, seed_parts: list[Column], seed: int = 0) -> Column:
    """The array in an order that follows from the seed."""
    keyed = F.transform(items, lambda x, i: F.struct(F.md5(F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in seed_parts], i.cast("string"))).alias("k"), x.alias("x")))
    return F.transform(F.sort_array(keyed), lambda s: s["x"])


#: Neighbours that a word looks at one by one, and ranks of a block of a ring.
_STEPS, _BLOCK = 128, 256


def _ring(own: DataFrame, todo: DataFrame, ring: str, far: bool, n: int, reach: int) -> DataFrame:
    """id, overlap, far, step, other_id: for each word of todo (id, need) its neighbours on
    the ring: the first that don't overlap, as many as it needs, and the first n that do.
    Words that still need some go on, twice as far each time; beyond ``_STEPS`` neighbours the
    ring is searched by classes of words that have equal definitions."""
    r = saved(V.ranked(own, [ring], "one", "h", prefix=4).select("id", "pos", "definition", "class", F.col(ring).alias("ring"), "rank", "n"))
    right = r.select("ring", "rank", F.col("id").alias("other_id"), F.col("pos").alias("other_pos"), F.col("definition").alias("other_def"))
    todo = saved(todo.join(r.hint("merge"), "id").select("id", "need", F.col("pos").alias("own_pos"), F.col("definition").alias("own_def"), F.col("class").alias("own_class"), "ring", F.col("rank").alias("at"), "n"))
    found, low, high = [], 1, reach
    while True:
        steps = todo.withColumn("step", F.explode(F.sequence(F.lit(low), F.lit(high)))).where("step < n")
        j = steps.withColumn("rank", F.pmod(F.col("at") - 1 + F.col("step"), F.col("n")) + 1).join(right.hint("merge"), ["ring", "rank"])
        j = j.where("own_pos <> other_pos") if far else j
        j = j.select("id", "need", F.lit(int(far)).alias("far"), "step", T.fold_overlap(F.col("other_def"), F.col("own_def")).alias("overlap"), "other_id")
        row = F.struct("overlap", "far", "step", "other_id")
        lists = j.groupBy("id", "need").agg(F.sort_array(F.collect_list(row)).alias("all"))  # high - low + 1 rows at most
        free, rest = F.filter("all", lambda x: ~x["overlap"]), F.filter("all", lambda x: x["overlap"])
        got = saved(lists.select("id", "need", F.size(free).alias("free"), F.concat(F.slice(free, 1, n), F.slice(rest, 1, n)).alias("found")))
        found.append(got.select("id", F.explode("found").alias("x")).select("id", "x.*"))
        todo = todo.join(got.select("id", "free").hint("merge"), "id", "left").withColumn("need", F.col("need") - F.coalesce("free", F.lit(0))).drop("free")
        todo = saved(todo.where((F.col("need") > 0) & (F.col("n") > high + 1)))
        if todo.isEmpty():
            break
        if high >= _STEPS:
            found.append(_by_class(r, todo, far, n, high))
            break
        low, high = high + 1, 2 * high
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


def _by_class(r: DataFrame, todo: DataFrame, far: bool, n: int, past: int) -> DataFrame:
    """id, overlap, far, step, other_id: the first n words on the ring, more than ``past``
    steps away, that don't overlap with a word of todo.

    Overlap is found once for two classes, not for each two words. What a class may take are
    its targets, put in blocks of ranks (twice, so that a ring goes on at its start); a word
    looks at the first block behind its place that has a target, and at the first n targets
    of the blocks behind that one."""
    key = ["ring", "own_class", "own_pos"] if far else ["ring", "own_class"]
    kinds = r.groupBy("ring", "class").agg(F.first("definition").alias("other_def"))
    asking = todo.groupBy(*key).agg(F.first("own_def").alias("own_def"))
    open_ = asking.join(kinds, "ring").where(~T.fold_overlap(F.col("other_def"), F.col("own_def"))).select(*key, "class")
    targets = saved(open_).join(r.select("ring", "class", "rank", "n", F.col("id").alias("other_id"), F.col("pos").alias("other_pos")).hint("merge"), ["ring", "class"])
    targets = targets.where("own_pos <> other_pos") if far else targets
    twice = targets.select(*key, "other_id", F.explode(F.array(F.col("rank"), F.col("rank") + F.col("n"))).alias("rank"))
    block = lambda c: F.floor(c / _BLOCK)
    rows = twice.groupBy(*key, block(F.col("rank")).alias("block")).agg(F.sort_array(F.collect_list(F.struct("rank", "other_id"))).alias("here"))  # _BLOCK targets at most
    behind = F.collect_list(F.slice("here", 1, n)).over(W.partitionBy(*key).orderBy("block").rowsBetween(1, n))
    rows = saved(rows.withColumn("behind", F.slice(F.flatten(behind), 1, n)))
    asked = todo.withColumn("from", F.col("at") + past).withColumn("block", block(F.col("from")))
    # the first block, at or behind a word's own, that has targets
    both = rows.select(*key, "block", F.col("block").alias("full")).unionByName(asked.select(*key, "block").distinct().withColumn("full", F.lit(None).cast("long")))
    next_full = F.min("full").over(W.partitionBy(*key).orderBy("block").rangeBetween(0, W.unboundedFollowing))
    at = both.withColumn("next", next_full).where("full IS NULL").select(*key, "block", "next")
    j = asked.join(at.hint("merge"), [*key, "block"]).join(rows.select(*key, F.col("block").alias("next"), "here", "behind").hint("merge"), [*key, "next"])
    inside = F.filter(F.concat("here", "behind"), lambda x: (x["rank"] > F.col("from")) & (x["rank"] < F.col("at") + F.col("n")))
    # if nothing of the first block is left, its followers are n already
    some = j.select("id", "at", F.explode(F.slice(inside, 1, n)).alias("x"))
    return some.select("id", F.lit(False).alias("overlap"), F.lit(int(far)).alias("far"), (F.col("x.rank") - F.col("at")).alias("step"), "x.other_id")


def distractors(words: DataFrame, n: int = 3, reach: int = 8, seed: int = 0, of: DataFrame | None = None) -> DataFrame:
    """id, k, other_id: n others of each word, those whose definition overlaps its own
    only after all that don't, then its own part of speech first, then ring order. The first
    ``reach`` neighbours settle nearly all words; the others go on around their rings, as far
    as it takes, and only they look at other parts of speech. words: id, pos, definition; of:
    the ids whose others are asked for, if not all words'."""
    own = words.select("id", "pos", "definition", shade(F.col("id"), seed=seed).alias("h"))
    own = own.withColumn("one", F.lit(1)).withColumn("all", F.lit("all")).withColumn("class", F.coalesce(F.sort_array(T.fold_bag(F.col("definition"))), F.expr("cast(array() as array<string>)")))
    asked = (own if of is None else own.join(of.select("id").distinct(), "id", "left_semi")).select("id")
    near = saved(_ring(own, asked.withColumn("need", F.lit(n)), "pos", False, n, reach))
    free = near.where("NOT overlap").groupBy("id").agg(F.least(F.count("*"), F.lit(n)).cast("int").alias("free"))
    short = saved(asked.join(free.hint("merge"), "id", "left").select("id", (n - F.coalesce("free", F.lit(0))).alias("need")).where("need > 0"))
    found = near if short.isEmpty() else near.unionByName(_ring(own, short, "all", True, n, reach))
    best = F.slice(F.sort_array(F.collect_list(F.struct("overlap", "far", "step", "other_id"))), 1, n)
    return found.groupBy("id").agg(best.alias("b")).select("id", F.posexplode("b").alias("k", "b")).select("id", "k", "b.other_id")


def pick_form(forms: Column, lemma: Column, preferred: Column, excluded: Column, pick: Column, need_morphology: bool = False) -> Column:
    """A form by preference: the preferred one, one that isn't the lemma, any not
    excluded, any. pick: a number that chooses among equals."""
    pool = F.filter(forms, lambda f: f["morphology"] != "") if need_morphology else forms
    free = F.filter(pool, lambda f: ~F.array_contains(excluded, f["form"]))
    some = lambda a: F.when(F.size(a) > 0, F.get(a, F.pmod(pick, F.size(a)).cast("int")))
    wanted = F.filter(free, lambda f: f["form"] == preferred)
    inflected = F.filter(free, lambda f: f["form"] != lemma)
    return F.coalesce(F.get(wanted, F.lit(0)), some(inflected), some(free), some(pool))


def morphology_choices(words: DataFrame, correct: DataFrame, n: int = 3, seed: int = 0, keep: bool = False) -> DataFrame:
    """id, choices: n morphologies other than the correct one that other words have, in
    seeded order, padded with placeholders. correct: id, morphology (kept if keep).

    A morphology is of another word if more than one word has it or its one word is another.
    Of the shared ones the first n + 1 in seeded order are enough for any word. Of those of
    one word alone, the first n of other words belong to the n + 1 words whose first one
    comes earliest; so both lists are short whatever the grammar."""
    own = words.select("id", F.explode("forms").alias("f")).select("id", F.col("f.morphology").alias("m")).where("m <> ''").distinct()
    known = saved(own.groupBy("m").agg(F.count("*").alias("owners"), F.min("id").alias("owner")).withColumn("k", shade(F.col("m"), seed=seed)))
    shared = known.where("owners > 1").orderBy("k", "m").limit(n + 1)
    single = known.where("owners = 1")
    firsts = single.groupBy("owner").agg(F.min(F.struct("k", "m")).alias("x"))  # one of each owner: n + 1 owners give n of others
    alone = firsts.orderBy("x").limit(n + 1).select("owner")
    alone = single.join(F.broadcast(alone), "owner", "left_semi").select("k", "m", F.lit(1).cast("long").alias("owners"), "owner")
    most = W.partitionBy("owner").orderBy("k", "m")
    alone = alone.withColumn("i", F.row_number().over(most)).where(F.col("i") <= n + 1).drop("i")
    listed = shared.select("k", "m", "owners", "owner").unionByName(alone)  # (n + 1) * (n + 2) rows at most
    listed = listed.agg(F.sort_array(F.collect_list(F.struct("k", "m", "owners", "owner"))).alias("all")).withColumn("one", F.lit(1))
    fit = F.filter("all", lambda x: (x["m"] != F.col("morphology")) & ((x["owners"] > 1) | (x["owner"] != F.col("id"))))
    taken = F.slice(F.transform(fit, lambda x: x["m"]), 1, n)
    pad = F.array(*[F.lit(f"morphology option {i + 1}") for i in range(n)])
    own_cols = ["id", "morphology"] if keep else ["id"]
    return correct.withColumn("one", F.lit(1)).join(F.broadcast(listed), "one").select(*own_cols, F.concat(taken, F.slice(pad, F.size(taken) + 1, n)).alias("choices"))


KINDS = ("greek-to-english", "english-to-greek", "form-id")


def _draw(key: Column) -> Column:
    return F.conv(F.substring(key, 1, 8), 16, 10).cast("long")


def build(words: DataFrame, kind: str, seed: int = 0, others: DataFrame | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """word_id, type, prompt, correct_answer, choices and the columns to carry. kind: one of
    KINDS. words: id, lemma, pos, definition, context_definition, forms, and exclude_forms if
    some are not to be asked again. Wrong choices are drawn from others (words, if not given)."""
    if kind not in KINDS:
        raise ValueError(f"no question of kind {kind!r}")
    pool = words if others is None else others
    none = F.expr("cast(array() as array<string>)")
    excluded = F.coalesce("exclude_forms", none) if "exclude_forms" in words.columns else none
    pick, lemma, no_form = _draw(shade(F.col("id"), seed=seed)), F.col("lemma"), F.lit(None).cast("string")
    if kind == "form-id":
        form = F.coalesce(*[pick_form(F.col("forms"), lemma, no_form, excluded, pick, need) for need in (True, False)])
        correct = F.coalesce(T.truthy(form["morphology"]), F.lit("Unknown morphology"))
        w = words.select("id", *carry, F.coalesce(form["form"], lemma).alias("prompt"), correct.alias("morphology"))
        j = w.join(morphology_choices(pool, w.select("id", "morphology").distinct(), seed=seed, keep=True), ["id", "morphology"])
        choices, answer, prompt = F.concat(F.array("morphology"), F.col("choices")), F.col("morphology"), F.col("prompt")
    else:
        gloss = F.coalesce(T.truthy(F.col("context_definition")), F.col("definition"))
        shown = gloss if kind == "greek-to-english" else lemma
        d = distractors(pool, seed=seed, of=None if others is None else words).join(pool.select(F.col("id").alias("other_id"), shown.alias("shown")).hint("merge"), "other_id")
        lists = d.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "shown"))), lambda s: s["shown"]).alias("others"))
        form = pick_form(F.col("forms"), lemma, no_form, excluded, pick)
        prompt, answer = (F.coalesce(form["form"], lemma), gloss) if kind == "greek-to-english" else (gloss, lemma)
        j, choices = words.join(lists.hint("merge"), "id", "left"), F.concat(F.array(answer), F.coalesce("others", none))
    return j.select(*carry, F.col("id").alias("word_id"), F.lit(kind).alias("type"), prompt.alias("prompt"), answer.alias("correct_answer"), shuffled(choices, [F.col("id")], seed).alias("choices"))


def ask(words: DataFrame, mode: str, seed: int = 0, others: DataFrame | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """A question on each word in a mode; in form-id only on words that have such forms."""
    w = words.where(eligible(F.col("forms"))) if mode == "form-id" else words
    w = w.withColumn("_type", question_type(mode, F.col("forms"), shade(F.col("id"), F.lit("type"), seed=seed)))
    parts = [build(w.where(F.col("_type") == kind), kind, seed, words if others is None else others, carry) for kind in KINDS if mode in ("mixed", kind)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def graded(answers: DataFrame, questions: DataFrame) -> DataFrame:
    """answers with correct: whether they equal their question's answer to the letter."""
    own = questions.select("question_id", "correct_answer")
    return answers.join(own, "question_id").withColumn("correct", F.coalesce(F.col("user_answer") == F.col("correct_answer"), F.lit(False)))


def metadata(words: DataFrame) -> DataFrame:
    """What a question shows of its word; absent lists are empty."""
    lists = [F.coalesce(c, F.expr(f"cast(array() as {words.schema[c].dataType.simpleString()})")).alias(c) for c in ("forms", "contexts")]
    return words.select("id", "lemma", "definition", "context_definition", *lists)


def eligible(forms: Column) -> Column:
    """Whether a question on forms can be asked."""
    return F.coalesce(F.exists(forms, lambda f: f["morphology"] != ""), F.lit(False))


def question_type(mode: str, forms: Column, key: Column) -> Column:
    """Type of a question in a mode; mixed draws among the types the word is eligible for."""
    if mode in ("english-to-greek", "form-id"):
        return F.lit(mode)
    if mode != "mixed":
        return F.lit("greek-to-english")
    kinds = F.when(eligible(forms), F.array(*map(F.lit, ("greek-to-english", "english-to-greek", "form-id")))).otherwise(F.array(F.lit("greek-to-english"), F.lit("english-to-greek")))
    return F.get(kinds, F.pmod(F.conv(F.substring(key, 1, 8), 16, 10).cast("long"), F.size(kinds)).cast("int"))
