"""Operator 6: n-gram Jaccard join by T-occurrence search with DivideSkip.

A document's set holds its distinct runs of ``k`` words; exact copies of a set are one
node. Two nodes link if ``100 * |A and B| >= percent * |A or B|``, that is, if they occur
together in at least T = ``required(a, b)`` inverted lists. Every set is ordered by one
global order, frequent shingles last: the lists at its head are short, those at its tail
long. Of sets that link, the first shingle they share lies at a place of each that leaves
room for T, so it is among the first ``n - ceil(n * percent / 100) + 1`` of both.

1. Shingles seen in several documents of one read block go to fixed-size bitmaps, one for
   each level of frequency, which make the order (it changes the work, never the result).
2. Inverted lists are kept for the heads alone; a bitmap drops lists of one before that.
3. The short lists are merged by a Spark join, which counts how often two nodes meet.
   Pairs whose first meeting leaves no room for T are dropped.
4. The long lists are probed, not merged: b is in the list of h if h is in b's sorted set,
   where binary search finds it. Occurrences add up to those counted by the merge, and
   the probe ends once T is reached or out of reach.
5. A head list of more than ``long_list`` nodes isn't merged: its nodes are probed with
   one of them, and only those that this leaves outside the list's main component meet
   the list's nodes of other components. No link between components is lost.
   Before any text is moved, candidates whose parity bitmaps differ in more bits than
   sets that link can differ in shingles are dropped: each shingle flips one bit of its
   set's bitmap, so this never drops a link.
6. Components come from large-star and small-star rounds over the links.

Rows: ids must be integers (anything that casts to long); null and empty texts, and texts
without words, have no shingles and link with nothing; shorter texts have one shingle,
their words; rows of equal ids are nodes of their own with one id; a component of null
ids alone has a null id; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexispark.llm import common as C
from lexispark.llm import words as W

BITS = 26
#: 64-bit words of a set's parity bitmap (a power of 2), and their columns.
PARITY_WORDS = 8
PARITY = [f"p{i}" for i in range(PARITY_WORDS)]
LONG, LONGS = pa.int64(), pa.list_(pa.int64())


class Sets:
    """Shingle sets of a few texts as sorted 64-bit hashes, end to end: set i is
    flat[at[i] : at[i + 1]]."""

    def __init__(self, words: W.Words, k: int) -> None:
        grams, parts = C.gram_hashes(words.h, k), []
        for i, (first, n) in enumerate(zip(words.first.tolist(), words.counts().tolist())):
            if n >= k:
                s = np.sort(grams[first : first + n - k + 1])
                new = np.empty(len(s), bool)
                new[0] = True
                np.not_equal(s[1:], s[:-1], out=new[1:])
                parts.append(s[new])
            else:
                parts.append(C.gram_hashes(words.of(i), n) ^ np.uint64(n) if n else np.empty(0, np.uint64))
        self.flat = np.concatenate(parts)
        self.n = np.fromiter(map(len, parts), np.int64, len(parts))
        self.at = np.concatenate(([0], np.cumsum(self.n)))

    def of(self, i: int) -> np.ndarray:
        return self.flat[self.at[i] : self.at[i + 1]]

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """128 bits that name each set (of 64-bit shingle hashes)."""
        out = []
        for salt in (0, 0x5851F42D4C957F2D):
            sums = np.concatenate(([np.uint64(0)], np.cumsum(C.mix(self.flat ^ np.uint64(salt)))))
            out.append(C.signed(sums[self.at[1:]] - sums[self.at[:-1]]))
        return out[0], out[1]


    def parities(self) -> list[np.ndarray]:
        """A bitmap of each set, in words of 64 bits: each shingle flips one bit."""
        bit = np.left_shift(np.uint64(1), self.flat & np.uint64(63))
        word, out = (self.flat >> np.uint64(6)) & np.uint64(PARITY_WORDS - 1), []
        for w in range(PARITY_WORDS):
            upto = np.concatenate(([np.uint64(0)], np.bitwise_xor.accumulate(np.where(word == w, bit, np.uint64(0)))))
            out.append(C.signed(upto[self.at[1:]] ^ upto[self.at[:-1]]))
        return out


def sets_of(column: pa.Array, k: int) -> Iterator[tuple[int, Sets]]:
    for lo, words in W.chunks(column, W.LOWER):
        yield lo, Sets(words, k)


def prefix_length(n: int, percent: int) -> int:
    return n + (-n * percent) // 100 + 1


def required(a, b, percent: int):
    """T: the least number of lists in which linking sets of a and b shingles meet."""
    return -(-percent * (a + b) // (100 + percent))


#: A shingle's level is the number of these counts it reaches, in documents of read blocks
#: that have it twice or more; and the bits of each level's bitmap.
LEVELS = ((2, BITS), (8, 23), (32, 23), (128, 23), (512, 22), (2048, 22))


def level_bitmaps(base: DataFrame) -> list[bytes]:
    seen = C.written(base.where("h IS NOT NULL").groupBy("h").agg(F.sum("seen").alias("seen")))
    return [C.key_filter(seen.where(F.col("seen") >= least), "h", bits) for least, bits in LEVELS]


class Order:
    """The global order: shingles of low levels first, those of a level by hash."""

    def __init__(self, bitmaps: list[bytes]) -> None:
        self.filters = [C.KeyFilter(b, bits) for b, (_, bits) in zip(bitmaps, LEVELS, strict=True)]

    def levels(self, flat: np.ndarray) -> np.ndarray:
        out = self.filters[0].has(flat).astype(np.uint8)
        late = np.flatnonzero(out)
        for f in self.filters[1:]:
            out[late] += f.has(flat[late])
        return out

    def places(self, sets: Sets) -> list[np.ndarray]:
        """For each set the places in flat of its shingles in order."""
        level = self.levels(sets.flat)
        bounds = zip(sets.at[:-1].tolist(), sets.at[1:].tolist())
        return [np.argsort(level[lo:hi], kind="stable") + lo for lo, hi in bounds]

    def heads(self, sets: Sets, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """The shingles of the short lists of all sets, end to end, and how many each has."""
        parts = [p[: prefix_length(len(p), percent) if len(p) else 0] for p in self.places(sets)]
        return sets.flat[np.concatenate(parts)], np.fromiter(map(len, parts), np.int64, len(parts))


def _batch(names: list[str], *cols: pa.Array | np.ndarray | list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, LONG) for c in cols], names=names)


def base_sets(source: DataFrame, k: int) -> DataFrame:
    """A row for each document (doc_id, n, k1, k2, uid, a key of the row, and the columns
    that source has behind id and text), and rows (h, seen) of shingles that lie in two
    documents or more of a read block."""
    names = ["doc_id", "n", "k1", "k2", "h", "seen", "uid", *source.columns[2:]]

    def frequent(block: list[np.ndarray], extra: list[pa.Array]) -> pa.RecordBatch:
        h, n = np.unique(np.concatenate(block), return_counts=True)
        h, n = h[n > 1], n[n > 1]
        none = pa.nulls(len(h), LONG)
        return _batch(names, none, none, none, none, C.signed(h), n, none, *[pa.nulls(len(h), c.type) for c in extra])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = TaskContext.get().partitionId() << 36
        for batch in it:
            extra, block, known, size = batch.columns[2:], [], set(), 0
            sizes, keys = [], ([], [])
            for _, sets in sets_of(batch.column(1), k):
                k1, k2 = sets.keys()
                sizes.append(sets.n)
                keys[0].append(k1)
                keys[1].append(k2)
                for i, key in enumerate(zip(k1.tolist(), k2.tolist())):
                    if key not in known:  # copies don't make their shingles frequent
                        known.add(key)
                        block.append(sets.of(i))
                        size += len(block[-1])
                if size > 2_000_000:
                    yield frequent(block, extra)
                    block, size = [], 0
            if block:
                yield frequent(block, extra)
            if batch.num_rows:
                none, uids = pa.nulls(batch.num_rows, LONG), np.arange(uid, uid + batch.num_rows)
                found = [np.concatenate(x) for x in (sizes, *keys)]
                yield _batch(names, batch.column(0), *found, none, none, uids, *extra)
            uid += batch.num_rows

    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema[2:]]
    own = "doc_id long, n long, k1 long, k2 long, h long, seen long, uid long"
    return C.written(source.mapInArrow(run, ", ".join([own, *kept])))


def shared_heads(source: DataFrame, k: int, percent: int, frequent) -> DataFrame:
    """h of shingles that are at the head of two different sets or more."""

    def ends(hs: list[np.ndarray], keys: list[np.ndarray]) -> pa.RecordBatch:
        h, key = np.concatenate(hs), np.concatenate(keys)
        order = np.argsort(h, kind="stable")
        h, key = h[order], key[order]
        new = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        low, high = np.minimum.reduceat(key, new), np.maximum.reduceat(key, new)
        return _batch(["h", "low", "high"], C.signed(h[new]), low, high)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, hs, keys, size = Order(frequent.value), [], [], 0
        for batch in it:
            for _, sets in sets_of(batch.column(1), k):
                head, n = order.heads(sets, percent)
                hs.append(head)
                keys.append(np.repeat(sets.keys()[0], n))
                size += len(head)
                if size > 1_000_000:
                    yield ends(hs, keys)
                    hs, keys, size = [], [], 0
        if size:
            yield ends(hs, keys)

    found = source.mapInArrow(run, "h long, low long, high long")
    return found.groupBy("h").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low <> high").select("h")


def nodes_with_lists(source: DataFrame, k: int, percent: int, frequent, shared) -> tuple[DataFrame, DataFrame]:
    """One row for each distinct set that has a list in common with another: node, k1, k2,
    n, its parity bitmap, and hs and at, its shingles of shared lists and their places; and
    the texts (node, text), which stay where they were written until a pair asks for them."""
    names = ["node", "k1", "k2", "n", "text", "hs", "at", *PARITY]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, known = Order(frequent.value), C.KeyFilter(shared.value, BITS)
        uid = TaskContext.get().partitionId() << 36
        for batch in it:
            seen: set = set()
            for lo, sets in sets_of(batch.column(1), k):
                head, n = order.heads(sets, percent)
                hit = known.has(head)
                begin = np.cumsum(n) - n
                place = (np.arange(len(head)) - np.repeat(begin, n))[hit]
                upto = np.concatenate(([0], np.cumsum(hit)))
                met = upto[begin + n] - upto[begin]
                k1, k2 = sets.keys()
                rows = []
                for i in np.flatnonzero(met).tolist():
                    if (key := (int(k1[i]), int(k2[i]))) not in seen:
                        seen.add(key)
                        rows.append(i)
                if not rows:
                    continue
                keep = np.array(rows)
                chosen = np.zeros(len(n), bool)
                chosen[keep] = True
                inside = np.repeat(chosen, met)
                at = pa.array(np.concatenate(([0], np.cumsum(met[keep]))), pa.int32())
                lists = [pa.ListArray.from_arrays(at, pa.array(x[inside], LONG)) for x in (C.signed(head[hit]), place)]
                text = batch.column(1).take(pa.array(keep + lo))
                parities = [p[keep] for p in sets.parities()]
                yield _batch(names, np.arange(uid, uid + len(keep)), k1[keep], k2[keep], sets.n[keep], text, *lists, *parities)
                uid += len(keep)

    schema = "node long, k1 long, k2 long, n long, text string, hs array<long>, at array<long>"
    schema += "".join(f", {p} long" for p in PARITY)
    found = C.written(source.mapInArrow(run, schema))
    once = found.groupBy("k1", "k2").agg(F.min("node").alias("node"))
    C.release(source.sparkSession)
    return C.written(found.drop("text").join(once, ["k1", "k2", "node"])), found.select("node", "text")


def texts_of(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """Rows of texts that a pair may ask for; a bitmap drops nearly all others before they
    are shuffled."""
    asked = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node")))
    sent = pairs.sparkSession.sparkContext.broadcast(C.key_filter(asked.select(F.xxhash64("node").alias("key")), "key"))

    def keep(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = C.KeyFilter(sent.value)
        for b in it:
            yield b.filter(pa.array(known.has(b.column(0).to_numpy()))).select(["node", "text"])

    return texts.select(F.xxhash64("node").alias("key"), "node", "text").mapInArrow(keep, "node long, text string")


def divide_skip(head: np.ndarray, tail: np.ndarray, b: np.ndarray, met: int, need: int, step: int = 256) -> bool:
    """Whether a set and b occur together in ``need`` lists or more. head and tail: the
    set's shingles of short and of long lists; met: occurrences that the merge of short
    lists counted. The long lists are probed by binary search in b, until need is reached
    or out of reach; the head is probed only if lists of it may have been left unmerged."""
    got = met
    for lo in range(0, len(tail), step):
        part = tail[lo : lo + step]
        got += _found(part, b)
        if got >= need:
            return True
        if got + len(tail) - lo - len(part) + len(head) - met < need:
            return False
    return got - met + _found(head, b) >= need


def _found(part: np.ndarray, b: np.ndarray) -> int:
    at = np.searchsorted(b, part)
    return int((b[np.minimum(at, len(b) - 1)] == part).sum())


def verified(pairs: DataFrame, texts: DataFrame, k: int, percent: int, frequent) -> DataFrame:
    """Those of the pairs (a, b, met) that link."""
    pairs = C.written(pairs.select("a", "b", "met"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = Order(frequent.value)
        for batch in it:
            a, b, met = (batch.column(i).to_numpy() for i in range(3))
            new = np.concatenate(([True], a[1:] != a[:-1])) if len(a) else np.empty(0, bool)
            which, good = np.cumsum(new) - 1, np.zeros(len(a), bool)
            queries = batch.column(3).take(pa.array(np.flatnonzero(new)))
            own = ((lo + i, s, p) for lo, s in sets_of(queries, k) for i, p in enumerate(order.places(s)))
            number, sets, place = -1, None, None
            for lo, others in sets_of(batch.column(4), k):
                for i in range(len(others.n)):
                    while number < which[lo + i]:
                        number, sets, place = next(own)
                        n = len(place)
                        cut = prefix_length(n, percent)
                        head, tail = sets.flat[place[:cut]], sets.flat[place[cut:]]
                    need = required(n, int(others.n[i]), percent)
                    good[lo + i] = divide_skip(head, tail, others.of(i), int(met[lo + i]), need)
            yield _batch(["a", "b"], a[good], b[good])

    text = texts_of(texts, pairs)
    full = pairs.join(text.withColumnsRenamed({"node": "a", "text": "text_a"}), "a")
    full = full.join(text.withColumnsRenamed({"node": "b", "text": "text_b"}), "b")
    return full.select("a", "b", "met", "text_a", "text_b").sortWithinPartitions("a").mapInArrow(run, "a long, b long")


def joined_up(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of a task as links of each node to the smallest node it reaches by them;
    that node links to itself."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    for b in it:
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            x, y = top(_own(up, x)), top(_own(up, y))
            if x != y:
                up[max(x, y)] = min(x, y)
    nodes = list(up)
    for lo in range(0, len(nodes), 50_000):
        part = nodes[lo : lo + 50_000]
        yield _batch(["a", "b"], part, [top(x) for x in part])


def _own(up: dict[int, int], x: int) -> int:
    up.setdefault(x, x)
    return x


def components(edges: DataFrame, block: int = 500_000) -> DataFrame:
    """node, comp (the smallest node of its component, which has no row itself). Links are
    first joined up within tasks of about ``block`` links each; where that takes several
    tasks, large-star and small-star rounds join up the rest. Each round's links are
    written, so that none is made twice. edges: a, b."""
    links = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    links = C.written(links.where("a <> b").distinct())
    tasks = -(-links.count() // block)
    dealt = links.repartition(tasks) if tasks > 1 else links.coalesce(1)
    links = C.written(dealt.mapInArrow(joined_up, "a long, b long")).where("a <> b")
    if tasks <= 1:
        return links.select(F.col("a").alias("node"), F.col("b").alias("comp"))
    before = None
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        own, other = F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b"))
        small = large.join(low, "a").select(F.explode(F.array(own, other)).alias("e")).select("e.a", "e.b")
        links = C.written(small.where("a <> b").distinct())
        now = tuple(links.agg(F.count("*"), F.sum(F.hash("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            return links.groupBy("a").agg(F.min("b").alias("comp")).withColumnRenamed("a", "node")
        before = now


def entry(name: str, at: str | None = None) -> list[Column]:
    """The columns of a list's entry as node ``name``, its size and its place."""
    pre = f"{at}." if at else ""
    return [F.col(f"{pre}node").alias(name), F.col(f"{pre}n").alias(f"{name}n"), F.col(f"{pre}at").alias(f"{name}at")]


def room(percent: int) -> Column:
    """Whether T lists are left in both sets from this one on, so that it may be the first
    in which a and b meet."""
    t = least_overlap(percent)
    return (F.least(F.col("an") - F.col("aat"), F.col("bn") - F.col("bat")) >= t) & near_sizes(percent)


def least_overlap(percent: int) -> Column:
    """T of sets of an and bn shingles."""
    return F.ceil(F.lit(percent) * (F.col("an") + F.col("bn")) / F.lit(100 + percent))


def near_sizes(percent: int) -> Column:
    return 100 * F.least("an", "bn") >= percent * F.greatest("an", "bn")


def alike(percent: int) -> Column:
    """Whether the parity bitmaps of a and b differ in no more bits than sets that link
    can differ in shingles."""
    bits = sum((F.bit_count(F.col(f"a{p}").bitwiseXOR(F.col(f"b{p}"))) for p in PARITY), F.lit(0))
    return bits <= F.col("an") + F.col("bn") - 2 * least_overlap(percent)


def with_parity(rows: DataFrame, nodes: DataFrame, name: str) -> DataFrame:
    """rows with the size and parity bitmap of the node in column ``name``."""
    own = nodes.select(F.col("node").alias(name), F.col("n").alias(f"{name}n"), *[F.col(p).alias(f"{name}{p}") for p in PARITY])
    return rows.join(own, name)


def plausible(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b, met) that their parity bitmaps let through."""
    both = with_parity(with_parity(pairs, nodes, "a"), nodes, "b")
    return both.where(alike(percent)).select("a", "b", "met")


def candidates(entries: DataFrame, percent: int, long_list: int) -> DataFrame:
    """Pairs (a, b, met) of the merged short lists, and of long lists' nodes with one of
    theirs: the one that has the fewest rarer shingles, so the nearest to what they share."""
    short = entries.where(F.col("size") <= long_list)
    both = short.select("h", *entry("a")).join(short.select("h", *entry("b")), "h")
    both = both.where((F.col("a") < F.col("b")) & near_sizes(percent))
    merged = both.groupBy("a", "b").agg(F.count("*").alias("met"), F.max(room(percent)).alias("fits"))
    long = entries.where(F.col("size") > long_list)
    star = long.select(*entry("a", "pivot"), *entry("b")).where((F.col("a") != F.col("b")) & room(percent))
    star = star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.lit(0).cast("long").alias("met"))
    pairs = merged.where("fits").select("a", "b", "met").unionByName(star.distinct())
    return pairs.groupBy("a", "b").agg(F.max("met").alias("met"))


def left_over(long: DataFrame, nodes: DataFrame, links: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, met) of long lists between nodes outside the list's main component
    and those of its other components."""
    placed = long.join(components(links), "node", "left")
    placed = C.written(placed.select("h", "node", "n", "at", F.coalesce("comp", "node").alias("comp")))
    per = placed.groupBy("h", "comp").agg(F.count("*").alias("m")).groupBy("h")
    per = per.agg(F.max(F.struct("m", "comp")).alias("main"), F.count("*").alias("comps")).where("comps > 1")
    per = per.select("h", F.col("main.comp").alias("main"))
    outside = placed.join(per, "h").where("comp <> main").select("h", *entry("a")[::2], F.col("comp").alias("ac"))
    others = placed.join(per, "h").select("h", *entry("b")[::2], F.col("comp").alias("bc"))
    outside, others = with_parity(outside, nodes, "a"), with_parity(others, nodes, "b")
    more = outside.join(others, "h").where((F.col("ac") != F.col("bc")) & room(percent) & alike(percent))
    return more.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.lit(0).cast("long").alias("met")).distinct()


#: Parts into which the sets of a component are dealt where they meet its smallest id.
SALTS = 16


def named_sets(base: DataFrame, nodes: DataFrame, links: DataFrame, first: bool) -> DataFrame:
    """k1, k2, component_id, and with first the uid of the component's first row."""
    # null ids come last, as first says: a struct of (is null, id, uid) is the order of rows
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "uid")
    own = [F.min("doc_id").alias("low"), *([F.min(place).alias("first_row")] if first else [])]
    named = base.where("h IS NULL AND n > 0").groupBy("k1", "k2").agg(*own)
    found = components(links)
    found = found.unionByName(found.select(F.col("comp").alias("node"), "comp").distinct())
    comps = nodes.select("node", "k1", "k2").join(found, "node").select("k1", "k2", "comp")
    sets = C.written(named.join(comps, ["k1", "k2"], "left"))
    salt = F.pmod(F.col("k1"), F.lit(SALTS)).alias("salt")
    least = [F.min("low").alias("comp_low"), *([F.min("first_row").alias("comp_first")] if first else [])]
    lows = sets.where("comp IS NOT NULL").groupBy("comp").agg(*least)
    lows = lows.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<long>")))
    linked = sets.where("comp IS NOT NULL").select("*", salt).join(lows, ["comp", "salt"])
    got = [F.col("comp_low").alias("component_id"), *([F.col("comp_first.uid").alias("first_uid")] if first else [])]
    alone = [F.col("low").alias("component_id"), *([F.col("first_row.uid").alias("first_uid")] if first else [])]
    rest = sets.where("comp IS NULL").select("k1", "k2", *alone)
    return linked.select("k1", "k2", *got).unionByName(rest)


def jaccard_components(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    k: int = 4,
    percent: int = 85,
    long_list: int = 16,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """doc_id, n_shingles, component_id. With columns of docs named in carry also these, as
    a struct, row, and first: whether the row is the one of its component with the smallest
    id (null ids last, then the first row read); always true without shingles."""
    spark = docs.sparkSession
    own = [docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")]
    source = docs.select(*own)
    base = base_sets(docs.select(*own, *[docs[c].alias(f"_c{i}") for i, c in enumerate(carry)]), k)
    frequent = spark.sparkContext.broadcast(level_bitmaps(base))
    shared = spark.sparkContext.broadcast(C.key_filter(shared_heads(source, k, percent, frequent), "h", BITS))
    C.release(spark)
    nodes, texts = nodes_with_lists(source, k, percent, frequent, shared)

    lists = nodes.select("node", "n", F.explode(F.arrays_zip("hs", "at")).alias("p"))
    lists = lists.select(F.col("p.hs").alias("h"), "node", "n", F.col("p.at").alias("at"))
    pivot = F.min(F.struct("at", F.xxhash64("node").alias("by"), "node", "n")).alias("pivot")
    sizes = lists.groupBy("h").agg(F.count("*").alias("size"), pivot).where("size > 1")
    entries = C.written(lists.join(sizes, "h"))
    C.release(spark)
    pairs = plausible(candidates(entries, percent, long_list), nodes, percent)
    links = C.written(verified(pairs, texts, k, percent, frequent))
    C.release(spark)
    more = C.written(left_over(entries.where(F.col("size") > long_list), nodes, links, percent))
    if not more.isEmpty():
        links = C.written(links.unionByName(verified(more, texts, k, percent, frequent)))

    sets, rows = C.written(named_sets(base, nodes, links, bool(carry))), base.where("h IS NULL")
    row = [F.struct(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(carry)]).alias("row")] if carry else []
    shown = [F.col("doc_id"), F.col("n").alias("n_shingles")]
    is_first = [(F.col("uid") == F.col("first_uid")).alias("first")] if carry else []
    full = rows.where("n > 0").join(sets, ["k1", "k2"]).select(*shown, "component_id", *is_first, *row)
    alone = [F.lit(True).alias("first")] if carry else []
    return full.unionByName(rows.where("n = 0").select(*shown, F.col("doc_id").alias("component_id"), *alone, *row))
