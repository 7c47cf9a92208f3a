"""Operator 3: toxicity by a weighted finite-state pattern grammar.

A text is read clause by clause. Five transducers run over a clause's words, each reading
the tags and weights that the one before it wrote:

1. insult: a word of the learned lexicon, or one that begins with a learned stem, emits
   its weight; other words emit 0;
2. threat: a modal followed within a few words by a verb of harm emits a weight;
3. target: a pronoun in reach of a match raises its weight (names are no targets). For
   pronouns behind the match the clause is first read from right to left;
4. negation: a negator lowers the matches of the next few words;
5. reported speech: after a verb of saying, or inside quotes, matches count less. A quote
   goes on over the ends of clauses up to its closing mark, at most to the end of the line
   (marks are double or angle ones; single ones are read as apostrophes);
   a verb of saying reaches over ':' and an opening quote mark.

The last four are composed: one machine whose states are tuples of theirs and whose arcs
have the product of their weights.

Apostrophes inside words are dropped before any lookup ("don't" is "dont", "i'll" "ill"),
but contractions with will are a modal as long as the apostrophe is there.

A clause scores the sum of its matches. A text's clause scores give a few figures, which
a logistic model turns into a score from 0 to 1. Lexicon and model are learned from a
bounded sample of labelled rows (``sample_rows``, those with the smallest hash), exact
copies once; the word counts of the sample are summed in Spark. Labels, language, source
and id are never inputs.

Rows: null and empty texts have no clauses and take the score of that; without labels
the score rests on the fixed lists alone; repeated rows give a row each; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.llm import common as C

# Fixed word classes of the grammar.
THREAT_MODALS = frozenset("will gonna going shall werde werden vais allons voy vamos".split())
CONTRACTED_MODALS = frozenset("i'll you'll he'll she'll it'll we'll they'll who'll that'll there'll".split())
HARM_VERBS = frozenset(
    "kill kills killed killing hurt hurts hurting murder murders murdered murdering destroy destroys destroyed destroying beat beats beaten beating stab stabs stabbed stabbing shoot shoots shot shooting "
    "töten tötet tötete getötet umbringen umbringt umgebracht schlagen schlägt schlug geschlagen tuer tue tues tuent tué frapper frappe frappes frappent frappé matar mata matas matan mató matado golpear golpea golpean golpeó golpeado".split()
)
TARGETS = frozenset("you your youre u he she they them him her du dich dir ihr euch tu toi vous il elle ils tú ti usted ustedes él ella ellos".split())
NEGATORS = frozenset("not no never isnt arent dont doesnt didnt wasnt werent cant cannot couldnt wont wouldnt shouldnt hasnt havent hadnt aint mustnt neednt nicht kein keine nie pas jamais nunca jamás tampoco".split())
REPORTERS = frozenset("said say says saying wrote writes called calls claimed claims quoted quotes reported reports according sagte schrieb nannte laut dit écrit appelé selon dijo escribió llamó según".split())

CLAUSE = re.compile(r"[.!?;\n]+")
WORD = re.compile(r"[^\W\d_]+")
#: a word, with apostrophes inside it, or a mark that the reported-speech transducer reads
TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|[\"“”„«»:]")
APOSTROPHE = re.compile("['’]")
INNER = re.compile(r"(?<=[^\W\d_])['’](?=[^\W\d_])")
OPENING, CLOSING, MARKS = frozenset("“„«"), frozenset("”»"), frozenset('"“”„«»:')
STEMS = (4, 5, 6)
#: reach in words, and factor or weight, of each transducer
REACH = {"threat": 6, "target": 4, "negation": 3, "report": 6}
FACTOR = {"threat": 3.0, "target": 1.25, "negation": 0.6, "report": 0.7}
N_FIGURES = 8

#: Tags that a symbol of a tape may have, as bits.
LEXICON, HARM, MODAL, TARGET, NEGATOR, REPORTER, QUOTED, START, AHEAD, THREAT, AIMED, NEGATED, REPORTED = (1 << i for i in range(13))
MATCH = LEXICON | THREAT
CLASSES = ((HARM, HARM_VERBS), (MODAL, THREAT_MODALS), (TARGET, TARGETS), (NEGATOR, NEGATORS), (REPORTER, REPORTERS))
TAGS = {w: sum(tag for tag, words in CLASSES if w in words) for _, own in CLASSES for w in own}


@dataclass(frozen=True)
class Transducer:
    """Its state is the number of words since the last one tagged ``opens``, up to
    ``reach``; the state beyond that is the one it begins in, and a word tagged ``reset``
    leads back there. An arc reads a symbol and writes it; where the symbol has a tag of
    ``reads`` and none of ``unless``, and the state entered is within reach or the symbol
    is tagged ``anyway``, it adds the tag ``writes``, and has a weight: x becomes
    (x + add) * times."""

    opens: int
    reach: int
    reads: int
    writes: int
    unless: int = 0
    anyway: int = 0
    reset: int = START
    add: float = 0.0
    times: float = 1.0

    @property
    def begin(self) -> int:
        return self.reach + 1

    def arc(self, state: int, symbol: int) -> tuple[int, int, float, float]:
        """The state entered, the symbol written, and the weight (add, times)."""
        if symbol & self.reset:
            state = self.begin
        state = 0 if symbol & self.opens else min(state + 1, self.begin)
        if symbol & self.reads and not symbol & self.unless and (state <= self.reach or symbol & self.anyway):
            return state, symbol | self.writes, self.add, self.times
        return state, symbol, 0.0, 1.0


class Lookahead(Transducer):
    """A transducer that reads from right to left: what it writes depends on the words
    behind the one read, up to the next ``reset``, not on that word itself."""

    def arc(self, state: int, symbol: int) -> tuple[int, int, float, float]:
        out = symbol | self.writes if state <= self.reach else symbol
        near = 1 if symbol & self.opens else min(state + 1, self.begin)
        return self.begin if symbol & self.reset else near, out, 0.0, 1.0


class Composition:
    """Transducers as one, each reading what the one before it writes. Its states are
    tuples of theirs, its weights (times, plus) map x to x * times + plus. An arc is made
    when it is first read, so there are no more than states times symbols of them."""

    def __init__(self, *parts: Transducer) -> None:
        self.parts, self.begin = parts, tuple(p.begin for p in parts)
        self.arcs: dict[tuple, tuple] = {}

    def arc(self, state: tuple[int, ...], symbol: int) -> tuple[tuple[int, ...], int, float, float]:
        found = self.arcs.get((state, symbol))
        if found is None:
            entered, out, times, plus = [], symbol, 1.0, 0.0
            for part, s in zip(self.parts, state, strict=True):
                s, out, add, by = part.arc(s, out)
                entered.append(s)
                times, plus = times * by, (plus + add) * by
            found = self.arcs[state, symbol] = (tuple(entered), out, times, plus)
        return found


AHEAD_OF = Lookahead(TARGET, REACH["target"], 0, AHEAD)
FORWARD = (
    Transducer(MODAL, REACH["threat"], HARM, THREAT, add=FACTOR["threat"]),
    Transducer(TARGET, REACH["target"], MATCH, AIMED, anyway=AHEAD, times=FACTOR["target"]),
    Transducer(NEGATOR, REACH["negation"], MATCH, NEGATED, times=FACTOR["negation"]),
    Transducer(REPORTER, REACH["report"], MATCH, REPORTED, unless=NEGATED, anyway=QUOTED, reset=0, times=FACTOR["report"]),
)


class Grammar:
    """The composed transducers over a learned lexicon of words and stems ("abcd*")."""

    def __init__(self, lexicon: dict[str, float]) -> None:
        self.words = {w: x for w, x in lexicon.items() if not w.endswith("*")}
        self.stems = {w[:-1]: x for w, x in lexicon.items() if w.endswith("*")}
        self.known: dict[str, float] = {}
        self.ahead, self.forward = Composition(AHEAD_OF), Composition(*FORWARD)

    def insult(self, word: str) -> float:
        x = self.known.get(word)
        if x is None:
            x = self.words.get(word) or max((self.stems.get(word[:k], 0.0) for k in STEMS if len(word) > k), default=0.0)
            if len(self.known) >= 300_000:
                self.known.clear()
            self.known[word] = x
        return x

    def tape(self, words: list[str], weights: list[float], quoted: set[int], starts: set[int], modals: set[int]) -> list[int]:
        """The tags of each word, as the insult transducer and the clause's marks write them."""
        tape = [TAGS.get(w, 0) | (LEXICON if x > 0 else 0) for w, x in zip(words, weights, strict=True)]
        for places, tag in ((quoted, QUOTED), (starts, START), (modals, MODAL)):
            for i in places:
                if i < len(tape):
                    tape[i] |= tag
        return tape

    def clause(self, words: list[str], weights: list[float], quoted: set[int] = frozenset(), starts: set[int] = frozenset(), modals: set[int] = frozenset()) -> tuple[float, int, int]:
        """Score, matches, and matches that negation or report lowered. quoted: places inside
        quotes; starts: those behind a ':', where all but the report begins anew; modals: contractions with will."""
        tape = self.tape(words, weights, quoted, starts, modals)
        state = self.ahead.begin
        for i in range(len(tape) - 1, -1, -1):
            state, tape[i], _, _ = self.ahead.arc(state, tape[i])
        score, n, lowered, state = 0.0, 0, 0, self.forward.begin
        for symbol, x in zip(tape, weights, strict=True):
            state, out, times, plus = self.forward.arc(state, symbol)
            if out & MATCH:
                score, n = score + x * times + plus, n + 1
                if out & (NEGATED | REPORTED):
                    lowered += 1
        return score, n, lowered

    def figures(self, text: str | None) -> list[float]:
        """What the model sees of a text: matches (at least 1, 2, 3), clause scores."""
        total = top = 0.0
        n = low = clauses = 0
        insult = self.insult
        for line in (text or "").lower().split("\n"):
            inside = False
            # a quote counts only where the line closes it
            left = {'"': line.count('"') // 2 * 2, "”": line.count("”") + line.count("“"), "»": line.count("»")}
            for part in CLAUSE.split(line):
                words, quoted, starts, modals = [], set(), set(), set()
                for t in TOKEN.findall(part):
                    if t in MARKS:
                        if t == ":":
                            starts.add(len(words))
                        elif t == '"':
                            if left[t]:
                                left[t] -= 1
                                inside = not inside
                        elif inside and (t in CLOSING or t == "“"):
                            left["»" if t == "»" else "”"] -= 1
                            inside = False
                        elif t in OPENING and left["»" if t == "«" else "”"] > 0:
                            inside = True
                            if t == "“":
                                left["”"] -= 1
                        continue
                    if inside:
                        quoted.add(len(words))
                    if len(t) > 2 and ("'" in t or "’" in t):
                        if t.replace("’", "'") in CONTRACTED_MODALS:
                            modals.add(len(words))
                        t = APOSTROPHE.sub("", t)
                    words.append(t)
                weights = list(map(insult, words))
                if not any(weights) and HARM_VERBS.isdisjoint(words):
                    continue
                s, k, lowered = self.clause(words, weights, quoted, starts, modals)
                if k:
                    total, top, n, low, clauses = total + s, max(top, s), n + k, low + lowered, clauses + 1
        return [float(n >= 1), float(n >= 2), float(n >= 3), float(np.log1p(total)), top / 5, float(np.log1p(clauses)), low / (n + 1), min(n, 8) / (1 + np.log1p(len(text or "") / 200))]


def held_out(id_col):
    """crc32 of the id's digits, modulo 5, is 0."""
    return F.pmod(F.crc32(id_col.cast("string")), F.lit(5)) == 0


def learn_lexicon(rows: DataFrame, most: int, least_weight: float) -> dict[str, float]:
    """Words and stems of toxic texts with their log ratio, at most ``most`` of them. A
    word must lie in so many toxic texts that, among the words of that many texts, none
    is expected there by chance. rows: text, toxic."""

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        n = [0, 0]
        for texts, toxic in C.batches(it):
            for t, y in zip(texts, toxic, strict=True):
                words = set(WORD.findall(INNER.sub("", (t or "").lower())))
                seen[y].update(words | {w[:k] + "*" for w in words for k in STEMS if len(w) > k})
                n[y] += 1
        names = [w for w in seen[1]]
        yield pa.RecordBatch.from_arrays([pa.array(["", *names], pa.string()), pa.array([n[0], *(seen[0][w] for w in names)], pa.int64()), pa.array([n[1], *(seen[1][w] for w in names)], pa.int64())], names=["name", "n0", "n1"])
        rest = [w for w in seen[0] if w not in seen[1]]
        yield pa.RecordBatch.from_arrays([pa.array(rest, pa.string()), pa.array([seen[0][w] for w in rest], pa.int64()), pa.array([0] * len(rest), pa.int64())], names=["name", "n0", "n1"])

    sums = rows.select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(count, "name string, n0 long, n1 long").groupBy("name").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    sums = C.written(sums)
    total = sums.where("name = ''").first()
    if not total or not total["n0"] or not total["n1"]:
        return {}
    least_docs = int(np.ceil(np.log10(total["n0"] + total["n1"]))) + 1
    weight = F.log((F.col("n1") + 0.5) / (total["n1"] + 1)) - F.log((F.col("n0") + 0.5) / (total["n0"] + 1))
    found = sums.where((F.col("name") != "") & (F.col("n1") >= least_docs)).select("name", weight.alias("weight")).where(F.col("weight") >= least_weight)
    return {r["name"]: r["weight"] for r in found.orderBy(F.desc("weight"), "name").limit(most).collect()}


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 60) -> np.ndarray:
    """Logistic regression by Newton steps; the last weight is the intercept."""
    x = np.hstack([x, np.ones((len(x), 1))])
    b = np.zeros(x.shape[1])
    keep = np.full(x.shape[1], ridge * max(1, len(x)) ** 0.5)
    keep[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        g = x.T @ (p - y) + keep * b
        h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(keep)
        d = np.linalg.solve(h, g)
        b -= d
        if np.abs(d).max() < 1e-8:
            break
    return b


#: The model where nothing can be learned: two matches make a text toxic.
PRIOR = np.array([2.0, 2.0, 1.0, 0.5, 0.0, 0.0, -0.5, 0.0, -3.5])


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id_col: str = "doc_id", label_col: str = "toxic", sample_rows: int = 20_000, most_words: int = 5000, least_weight: float = 3.4, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, score, predicted, and a struct, row, of the columns of docs named in carry.
    sample_rows bounds what is learned from; every row is scored."""
    lab = labels.select(labels[label_id_col].alias("k"), labels[label_col].cast("int").alias("toxic")).where(F.col("k").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("k")))
    lab = lab.groupBy("k").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("k"), "k").limit(sample_rows)
    text = F.coalesce(docs[text_col], F.lit(""))
    sample = docs.select(docs[id_col].alias("k"), text.alias("text")).join(F.broadcast(lab), "k").select("text", "toxic")  # lab has sample_rows rows at most
    sample = C.written(sample.groupBy(F.sha2("text", 256).alias("key")).agg(F.first("text").alias("text"), F.max("toxic").alias("toxic")))
    grammar = Grammar(learn_lexicon(sample, most_words, least_weight))

    def seen(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts, toxic in C.batches(it):
            yield pa.RecordBatch.from_arrays([pa.array([grammar.figures(t) for t in texts], pa.list_(pa.float64())), pa.array(toxic, pa.int32())], names=["x", "toxic"])

    rows = sample.select("text", "toxic").mapInArrow(seen, "x array<double>, toxic int").collect()  # sample_rows rows at most
    y = np.array([r["toxic"] for r in rows], float)
    b = fit(np.array([r["x"] for r in rows]).reshape(-1, N_FIGURES), y) if len(rows) and 0 < y.sum() < len(y) else PRIOR

    def score(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            x = np.array([grammar.figures(t) for t in batch.column(0).to_pylist()]).reshape(-1, N_FIGURES)
            p = 1 / (1 + np.exp(-np.clip(x @ b[:-1] + b[-1], -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(p, pa.float64())], names=[*batch.schema.names[1:], "score"])

    own = docs.select(docs[text_col].alias("_text"), docs[id_col].alias("_id"), *[docs[c].alias(f"_c{i}") for i, c in enumerate(carry)])
    out = own.mapInArrow(score, ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema[1:]] + ["score double"]))
    flag = F.coalesce(held_out(F.col("_id")), F.lit(False))
    return out.select(F.col("_id").alias("doc_id"), flag.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), *([F.struct(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(carry)]).alias("row")] if carry else []))
