"""Spans of a translation that render a gloss, found by ordered fallbacks: phrases of the
gloss, longest first; then the first word of the translation that shares a form with a
single-word candidate.

A gloss is compiled once (``compiled``) to its phrases and to all words that it finds, by
undoing the stemmer; a text is then cut into words once and looked up (``spot``), so no word
of a text is stemmed. Where glosses repeat, compile the table of distinct ones and join it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexispark.functions import text as T

WORD = r"([A-Za-z]+(?:'[A-Za-z]+)?)"
# Function words that are no candidates of their own.
FUNCTION_WORDS = (
    "a about after all also an and are as at be been being both but by did do does further for from hence if in indeed into is it kind not of on one "
    "or out over since so sort that the their then there therefore these this those to under up what when whenever where which who with"
).split()
# Irregular forms of a word in a translation.
SURFACE = {
    "began": "begin began beginning",
    "came": "come came",
    "cities": "city cities",
    "constitutions": "constitution constitutions",
    "had": "have has had",
    "held": "hold holds held",
    "said": "say says said",
    "spoke": "speak speaks spoke spoken",
    "told": "tell tells told",
}
# Words that may render a candidate word.
RENDERINGS = {
    "able": "able capable",
    "beginning": "beginning begin began origin source first",
    "case": "case condition state status",
    "city": "city cities",
    "community": "community communities association partnership sharing",
    "constitution": "constitution constitutions republic",
    "great": "great large considerable",
    "happen": "happen happens happened occur occurs occurred",
    "have": "have has had hold holds held possess possesses possessed",
    "human": "human humans man men person people being beings",
    "many": "many much more numerous considerable",
    "necessary": "necessary must should ought need required just fitting proper appropriate",
    "other": "other another else",
    "person": "person persons people human humans man men being beings",
    "political": "political civic civil",
    "position": "position status place",
    "principle": "principle principles source sources beginning beginnings",
    "ruling": "ruling rule rules governing govern governs authoritative",
    "say": "say says said speak speaks spoke spoken tell tells told",
    "speak": "speak speaks spoke spoken said",
    "tell": "tell tells told said",
}
# Phrases that may render a candidate.
PHRASES = {
    "come to be": ("come to be", "came to be", "come into being"),
    "happen": ("take place", "takes place", "took place"),
    "say": ("story goes",),
}
# Confidence of each method.
CONFIDENCE = {"exact_phrase": "high", "phrase_override": "high", "exact_token": "medium", "model_align": "high", "none": "low"}
_IRREGULAR = {form: min(forms.split()) for form, forms in SURFACE.items()}
#: Words of an irregular base, and words that stand for a form.
_IRREGULAR_OF = {base: tuple(sorted(w for w, b in _IRREGULAR.items() if b == base)) for base in _IRREGULAR.values()}
_STANDS_FOR = {form: tuple(sorted(w for w, fs in SURFACE.items() if form in fs.split())) for fs in SURFACE.values() for form in fs.split()}


def _lookup(table: dict[str, tuple[str, ...]], key: Column) -> Column:
    pairs = [x for k, v in table.items() for x in (F.lit(k), F.array(*map(F.lit, v)))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), F.expr("cast(array() as array<string>)"))


def _listed(table: dict[str, str]) -> dict[str, tuple[str, ...]]:
    return {k: tuple(v.split()) for k, v in table.items()}


def variants(word: Column) -> Column:
    """Forms that a word of the translation stands for."""
    w, s = F.lower(word), T.stem(word, _IRREGULAR)
    return F.array_distinct(F.concat(F.array(w, s), _lookup(_listed(SURFACE), w), _lookup(_listed(SURFACE), s)))


def renderings(word: Column) -> Column:
    """Forms that may render a candidate word."""
    w, s = F.lower(word), T.stem(word, _IRREGULAR)
    return F.array_distinct(F.concat(variants(word), _lookup(_listed(RENDERINGS), w), _lookup(_listed(RENDERINGS), s)))


def candidates(gloss: Column) -> Column:
    """Phrases of a gloss, longest first, equals in order."""
    parts = F.transform(F.split(F.lower(F.coalesce(gloss, F.lit(""))), "[,;/()]"), lambda p: F.trim(F.regexp_replace(p, r"\s+", " ")))
    plain = lambda p: F.replace(p, F.lit("-"), F.lit(" "))

    def of_part(p: Column) -> Column:
        content = F.filter(F.regexp_extract_all(plain(p), F.lit(WORD), 1), lambda w: ~w.isin(*FUNCTION_WORDS))
        pairs = F.transform(F.slice(content, F.lit(2), F.greatest(F.size(content) - 1, F.lit(0))), lambda w, i: F.concat(F.get(content, i), F.lit(" "), w))
        more = F.when(F.size(content) >= 2, F.concat(F.array(F.array_join(content, " ")), pairs)).otherwise(F.expr("cast(array() as array<string>)"))
        return F.concat(F.array(p, plain(p)), content, more)

    found = F.flatten(F.transform(F.filter(parts, lambda p: p != ""), of_part))
    clean = F.array_distinct(F.filter(F.transform(found, lambda v: F.trim(F.regexp_replace(v, r"\s+", " "))), lambda v: F.length(v) >= 3))
    return F.transform(F.sort_array(F.transform(clean, lambda v, i: F.struct((-F.length(v)).alias("n"), i.alias("i"), v.alias("v")))), lambda s: s["v"])


def spellings(forms: Column) -> Column:
    """All lower-case words that have one of the forms among their variants: words that the
    stemmer may cut to a form, or to a word that stands for one, less those it doesn't."""
    none = F.expr("cast(array() as array<string>)")
    endings = [s for s, _ in T.SUFFIXES if s not in ("ied", "ies")]

    def inflected(b: Column) -> Column:
        of_y = F.concat(F.substr(b, F.lit(1), F.length(b) - 1), F.lit("i"))
        more = F.when(F.endswith(b, F.lit("y")), F.array(F.concat(of_y, F.lit("ed")), F.concat(of_y, F.lit("es")))).otherwise(none)
        return F.concat(F.array(b, *[F.concat(b, F.lit(s)) for s in endings]), more, _lookup(_IRREGULAR_OF, b))

    bases = F.array_distinct(F.concat(forms, F.flatten(F.transform(forms, lambda f: _lookup(_STANDS_FOR, f)))))
    words = F.array_distinct(F.flatten(F.transform(bases, inflected)))
    return F.filter(words, lambda w: F.arrays_overlap(variants(w), forms))


def compiled(gloss: Column, definition: Column | None = None) -> Column:
    """struct(phrases, words) of a gloss: phrases (p, its method m) in the order they are
    tried, and the words that its single-word candidates find. The dictionary's definition
    counts only where the gloss has no candidates."""
    own = candidates(gloss)
    cands = own if definition is None else F.when(F.size(own) > 0, own).otherwise(candidates(definition))
    as_phrase = lambda p, m: F.struct(p.alias("p"), F.lit(m).alias("m"))
    tried = lambda x: F.concat(F.array(as_phrase(x, "exact_phrase")), F.transform(_lookup(PHRASES, x), lambda p: as_phrase(p, "phrase_override")))

    def index(c: Column) -> Column:
        single = F.filter(F.transform(c, lambda x: F.regexp_extract_all(x, F.lit(WORD), 1)), lambda w: F.size(w) == 1)
        forms = F.array_distinct(F.flatten(F.transform(single, lambda w: renderings(F.get(w, F.lit(0))))))
        return F.struct(F.flatten(F.transform(c, tried)).alias("phrases"), T.let(forms, spellings).alias("words"))

    return T.let(cands, index)


def spot(translation: Column, index: Column) -> Column:
    """struct(method, confidence, start, end) of a compiled gloss in a translation; no bounds
    if the method is none, as for a null translation, a null index or a gloss without
    candidates."""
    result = lambda m, start, size: F.struct(m.alias("method"), F.when(m == "exact_token", "medium").when(m == "none", "low").otherwise("high").alias("confidence"), start.cast("int").alias("start"), (start + size).cast("int").alias("end"))
    nothing = result(F.lit("none"), F.lit(None).cast("int"), F.lit(0))

    def by_phrase(low: Column) -> Column:
        at = lambda p: F.regexp_instr(low, F.concat(F.lit(r"(?U)\b\Q"), p, F.lit(r"\E\b")))
        there = F.filter(index["phrases"], lambda x: F.contains(low, x["p"]))  # a plain search first: few phrases need the pattern
        placed = F.transform(there, lambda x: F.struct(x["m"].alias("m"), (at(x["p"]) - 1).alias("s"), F.length(x["p"]).alias("n")))
        return F.get(F.filter(placed, lambda x: x["s"] >= 0), F.lit(0))

    def by_token(tokens: Column) -> Column:
        lowered = F.split(F.lower(F.array_join(tokens, " ")), " ")
        first = T.let(lowered, lambda t: F.array_position(t, F.get(F.array_intersect(t, index["words"]), F.lit(0))).cast("int"))
        size = lambda parts, n: F.length(F.array_join(F.slice(parts, F.lit(1), n), ""))
        start = lambda k: size(F.split(translation, WORD, -1), k) + size(tokens, k - 1)
        return T.let(first, lambda k: F.when(k > 0, result(F.lit("exact_token"), start(k), F.length(F.get(tokens, k - 1)))).otherwise(nothing))

    token = F.when(F.size(index["words"]) > 0, T.let(F.regexp_extract_all(translation, F.lit(WORD), 1), by_token)).otherwise(nothing)
    found = T.let(T.let(F.lower(translation), by_phrase), lambda h: F.when(h.isNotNull(), result(h["m"], h["s"], h["n"])).otherwise(token))
    return F.when(F.coalesce(translation.rlike("[A-Za-z]") & index.isNotNull(), F.lit(False)), found).otherwise(nothing)


def find(translation: Column, gloss: Column, definition: Column | None = None) -> Column:
    """struct(method, confidence, start, end) of a gloss in a translation, see spot()."""
    return T.let(compiled(gloss, definition), lambda index: spot(translation, index))


def locate_occurrence(text: Column, needle: Column, k: Column) -> Column:
    """0-based place of the k-th occurrence, as written, else whatever the case; null if
    there is none."""

    def place(t: Column, n: Column) -> Column:
        quoted = F.replace(n, F.lit(r"\E"), F.lit(r"\E\\E\Q"))  # the needle may end the quotation itself
        pieces = F.split(t, F.concat(F.lit(r"\Q"), quoted, F.lit(r"\E")), -1)
        before = F.aggregate(F.slice(pieces, F.lit(1), k), F.lit(0), lambda a, x: a + F.length(x)) + (k - 1) * F.length(n)
        return F.when((F.length(n) > 0) & (F.size(pieces) > k), before)

    return F.coalesce(place(text, needle), place(F.lower(text), F.lower(needle)))


def align(unresolved: DataFrame, results: DataFrame) -> DataFrame:
    """Alignment answers applied: context_id, method, confidence, start, end. Unknown ids
    are ignored; contexts without an answer, or with an unsure or unplaced one, get none.
    unresolved: context_id, translation; results: context_id, matched_text, occurrence,
    confidence."""
    j = unresolved.join(results, "context_id", "left")
    sure = F.when(F.col("confidence").isin("high", "medium"), F.col("confidence")).otherwise("low")
    at = F.when((sure != "low") & (F.col("matched_text") != ""), locate_occurrence(F.col("translation"), F.col("matched_text"), F.coalesce(F.nullif(F.col("occurrence"), F.lit(0)), F.lit(1))))
    ok = at.isNotNull()
    return j.select("context_id", F.when(ok, "model_align").otherwise("none").alias("method"), F.when(ok, sure).otherwise("low").alias("confidence"), at.alias("start"), (at + F.length("matched_text")).alias("end"))
