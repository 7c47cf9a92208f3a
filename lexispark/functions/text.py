"""Column functions on texts, words and glosses. All stay in the JVM."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Abbreviations that are no gloss.
JUNK_GLOSSES = ("cf", "v", "f", "al", "ib", "sq", "prob", "dub", "perh", "sc")
# Suffixes of the stemmer, each with the shortest word it is cut from.
SUFFIXES = (("ingly", 6), ("edly", 6), ("ing", 5), ("ied", 5), ("ies", 5), ("ed", 4), ("es", 4), ("s", 4))

#: Blanks that sentences are trimmed of: Unicode's space separators.
BLANKS = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"

# Letters of Unicode 14 and 15, which Java 17 doesn't know.
_NEWER = (
    "870-887 889-88e 8b5 8c8-8c9 c5d cdd 170d 171f 1b4c 2c2f 2c5f 9ffd-9fff a7c0-a7c1 a7d0-a7d1 a7d3 a7d5-a7d9 a7f2-a7f4 10570-1057a 1057c-1058a "
    "1058c-10592 10594-10595 10597-105a1 105a3-105b1 105b3-105b9 105bb-105bc 10780-10785 10787-107b0 107b2-107ba 10f70-10f81 11071-11072 11075 1123f-11240 "
    "11740-11746 11ab0-11abf 11f02 11f04-11f10 11f12-11f33 12f90-12ff0 1342f 13441-13446 16a70-16abe 1aff0-1aff3 1aff5-1affb 1affd-1affe 1b11f-1b122 1b132 "
    "1b155 1df00-1df1e 1df25-1df2a 1e030-1e06d 1e290-1e2ad 1e4d0-1e4eb 1e7e0-1e7e6 1e7e8-1e7eb 1e7ed-1e7ee 1e7f0-1e7fe 2a6de-2a6df 2b735-2b739 31350-323af"
)
#: A letter, as a class of Java's expressions; the newer ones are looked for behind their first alone.
LETTER = r"[\p{L}[\x{870}-\x{323af}&&[" + re.sub(r"\w+", r"\\x{\g<0>}", _NEWER).replace(" ", "") + "]]]"
#: What parts sentences: white space behind a delimiter.
SENTENCE_END = r"(?<=[.;·])\s+"


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with the value computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def truthy(c: Column) -> Column:
    """Empty text is missing."""
    return F.nullif(c, F.lit(""))


def lower(c: Column) -> Column:
    """Lower case code point by code point: places stay, and a word is the same in any
    surroundings. (Java makes two of İ, and of Σ what its neighbours ask for.)"""
    return F.lower(F.replace(F.replace(c, F.lit("İ"), F.lit("i")), F.lit("Σ"), F.lit("σ")))


def letter_runs(c: Column) -> Column:
    """Runs of letters."""
    return F.regexp_extract_all(c, F.lit(f"({LETTER}+)"), 1)


def words(c: Column) -> Column:
    """Lower-cased runs of letters."""
    return letter_runs(lower(c))


def greek_words(c: Column) -> Column:
    """Runs of Greek letters and combining marks of an NFC text, without brackets and
    quotes; a run that begins with a capital is lower-cased if longer than a character."""
    runs = F.regexp_extract_all(F.regexp_replace(c, r'[\[\]"]', ""), F.lit(r"([Ͱ-Ͽἀ-῿̀-ͯ]+)"), 1)
    capital = lambda w: F.substr(w, F.lit(1), F.lit(1)).rlike(r"^\p{Lu}")
    return F.transform(runs, lambda w: F.when(capital(w) & (F.length(w) > 1), F.lower(w)).otherwise(w))


def sentences(c: Column, end: str = SENTENCE_END) -> Column:
    """Sentences end behind a delimiter that white space follows."""
    # F.trim itself has a second parameter, which F.transform would take for the place
    return F.filter(F.transform(F.split(c, end), lambda s: F.trim(s, F.lit(BLANKS))), lambda s: s != "")


def usable_gloss(c: Column) -> Column:
    """Two characters or more, half of them ASCII letters, and no junk abbreviation."""
    ascii_letters = F.length(F.regexp_replace(c, "[^A-Za-z]", ""))
    bare = F.regexp_replace(F.lower(c), r"[.:,]+$", "")
    return F.coalesce((F.length(c) >= 2) & (ascii_letters >= F.length(c) * 0.5) & ~bare.isin(*JUNK_GLOSSES), F.lit(False))


def short_definition(c: Column, most: int = 80) -> Column:
    """A definition that fits a card: its first clause, else its first sentence, else cut
    behind the last whole word."""
    t = F.trim(F.regexp_replace(c, r"\s+", " "))
    clause = F.trim(F.substring_index(t, ";", 1))
    sentence = F.trim(F.element_at(F.split(t, r"(?U)(?<!\b[A-Z])\.(?!\w)", 2), 1))
    fits = lambda x: (F.length(x) > 2) & (F.length(x) <= most)
    head = F.substring(t, 1, most)
    spaces = F.length(head) - F.length(F.replace(head, F.lit(" "), F.lit("")))
    cut = F.when(spaces > 0, F.regexp_extract(head, r"^(.*) ", 1)).otherwise(head)
    return (
        F.when(F.coalesce(c, F.lit("")) == "", F.lit(""))
        .when(F.contains(t, F.lit(";")) & fits(clause), clause)
        .when((sentence != t) & fits(sentence), sentence)
        .when(F.length(t) <= most, t)
        .otherwise(F.concat(cut, F.lit("…")))
    )


def stem(c: Column, irregular: dict[str, str] | None = None) -> Column:
    """A rule stemmer for English; irregular forms go before the rules."""
    t = F.lower(c)
    out = F.when(F.lit(False), t)
    for form, base in sorted((irregular or {}).items()):
        out = out.when(t == form, F.lit(base))
    for suffix, shortest in SUFFIXES:
        cut = F.substr(t, F.lit(1), F.length(t) - (3 if suffix in ("ied", "ies") else len(suffix)))
        out = out.when(F.endswith(t, F.lit(suffix)) & (F.length(t) >= shortest), F.concat(cut, F.lit("y")) if suffix in ("ied", "ies") else cut)
    return out.otherwise(t)


def fold_bag(c: Column) -> Column:
    """The distinct words of a definition."""
    return F.array_distinct(F.filter(F.split(F.lower(c), r"[\s,;]+"), lambda x: x != ""))


def fold_overlap(a: Column, b: Column) -> Column:
    """Whether two definitions share more than half of the words of the shorter one."""
    x, y = fold_bag(a), fold_bag(b)
    least = F.least(F.size(x), F.size(y))
    return F.coalesce((least > 0) & (F.size(F.array_intersect(x, y)) > 0.5 * least), F.lit(False))


def find_form(sentence: Column, form: Column) -> Column:
    """0-based place of a form in a sentence whatever the case; -1 if it isn't there."""
    return F.position(F.lower(form), F.lower(sentence)) - 1


def mark_span(text: Column, start: Column, end: Column, left: str = "[[", right: str = "]]") -> Column:
    """The text with marks around [start, end); unchanged if that is no span of it."""
    ok = (start >= 0) & (start < end) & (end <= F.length(text))
    marked = F.concat(F.substr(text, F.lit(1), start), F.lit(left), F.substr(text, start + 1, end - start), F.lit(right), F.substr(text, end + 1, F.length(text)))
    return F.when(F.coalesce(ok, F.lit(False)), marked).otherwise(text)


def escape_html(c: Column, attribute: bool = False) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return F.replace(F.replace(c, F.lit('"'), F.lit("&quot;")), F.lit("'"), F.lit("&#39;")) if attribute else c


def percent(part: Column, whole: Column) -> Column:
    """Rounded half up in doubles; 0 of nothing."""
    return F.when(whole > 0, F.floor(part / whole * 100 + F.lit(0.5))).otherwise(F.lit(0)).cast("long")


def preview(names: Column, n: int = 3) -> Column:
    """The first n names, with dots if there are more."""
    return F.concat(F.array_join(F.slice(names, 1, n), ", "), F.when(F.size(names) > n, F.lit("...")).otherwise(F.lit("")))


def reference_system(div_type: Column, subtype: Column) -> Column:
    """Citation scheme from a text's first division."""
    t, s = F.lower(F.coalesce(div_type, F.lit(""))), F.lower(F.coalesce(subtype, F.lit("")))
    return (
        F.when(F.contains(t, F.lit("stephanus")), "stephanus")
        .when(F.contains(t, F.lit("bekker")), "bekker")
        .when((t == "book") | (t.isin("textpart", "section", "chapter") & (s == "book")), "book-chapter")
        .when(t.isin("textpart", "section", "chapter"), "section")
        .otherwise("unknown")
    )


#: Names of levels. Fixed values.
LEVELS = {1: "Beginner", 2: "Intermediate", 3: "Advanced"}


def level_label(level: Column) -> Column:
    out = F
    for n, name in LEVELS.items():
        out = out.when(level == n, F.lit(name))
    return out.otherwise(F.concat(F.lit("Level "), level.cast("string")))


def morphology(pos: Column, features: Column) -> Column:
    """Part of speech in lower case and the features that are there, joined by commas."""
    some = F.filter(features, lambda f: F.coalesce(f, F.lit("")) != "")
    return F.concat_ws(", ", F.lower(F.when(pos != "", pos)), some)
