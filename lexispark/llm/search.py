"""Operator 13: ranked lexical search over a clustered index.

Recursive graph bisection orders the documents: the graph of documents and their terms is
halved again and again, documents trading sides while that makes gaps between a term's
documents cheaper to encode. The halving is fitted on at most ``sample_docs`` documents (the
smallest hashes) and their ``sample_terms`` most common terms; every document then walks
down the tree, to the side on which its terms cost less. The leaves are the clusters; large
ones are dealt into shards of about ``shard_docs`` documents or ``shard_terms`` postings.
The fit decides which documents are neighbours, never what is found.

A shard is one row: its documents by doc_id, and for each term its documents, their impacts
and the largest impact. An item's bound in a shard is the sum of its terms' weights times
their largest impacts. An item visits its best shards by bound, a few, then more, then all
whose bound is not below the ``k``-th score found so far: no other shard can have a document
that belongs among the first k, so the result is exact. Within a shard positions follow
doc_id, so ties map back to it.

Score of a document: for each occurrence of a term in the item, weight * impact, where
weight = floor(1000 ln((2 N + 2) / (2 df + 1))) and impact = 10**9 tf div (1000 tf + 12 m),
m = 75 + 25 n N div L; N counts documents with a term, L their terms, n the document's.

Rows: a null text has no terms; documents without terms are not found; rows with equal
doc_ids are documents of their own, and a null doc_id comes after all others among equal
scores; items of equal or null item_id are queries of their own; an item without terms, or
with none that is found, has no rows; extra columns are not read; empty tables give no rows.
Items are searched in batches of about ``batch``, whose terms the driver holds.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexispark.llm import common as C
from lexispark.llm import words as W

#: Postings that a task holds before it hands them on.
_HELD = 200_000
_LAST = (1 << 63) - 1


def texts(column: pa.Array) -> Iterator[bytes]:
    """The bytes of each text of a column; null is empty."""
    raw, at = W.texts_of(column)
    for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        yield raw[lo:hi].tobytes()


def terms_of(text: bytes) -> list[bytes]:
    """Terms: digits, letters with A-Z lower-cased, and all beyond ASCII."""
    return text.translate(C.ALNUM).split()


# -- the order of documents


@dataclass
class Tree:
    """Halvings of documents. Node i has the halves 2 i and 2 i + 1; costs[i] says of each
    known term how much dearer it is on the right."""

    codes: dict[bytes, int]
    costs: np.ndarray
    depth: int

    def leaf(self, terms: Iterator[bytes]) -> int:
        known = np.array([c for c in map(self.codes.get, terms) if c is not None], np.int64)
        node = 1
        for _ in range(self.depth):
            node = 2 * node + int(self.costs[node][known].sum() < 0)
        return node - (1 << self.depth)


def _cost(n: float, d: np.ndarray) -> np.ndarray:
    """Bits of the gaps between d of n documents."""
    return d * np.log2(n / (d + 1.0))


def _halved(docs: np.ndarray, first: np.ndarray, codes: np.ndarray, n_codes: int, rounds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two halves of docs, and what each term costs more on the right. Document d has
    codes[first[d] : first[d + 1]]."""
    sizes = first[docs + 1] - first[docs]
    own = np.repeat(np.arange(len(docs)), sizes)
    at = np.arange(len(own)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(first[docs], sizes)
    term = codes[at]
    right = np.arange(len(docs)) >= len(docs) // 2
    n_left, n_right = float((~right).sum()), float(right.sum())

    def degrees() -> tuple[np.ndarray, np.ndarray]:
        on = right[own]
        return np.bincount(term[~on], minlength=n_codes).astype(float), np.bincount(term[on], minlength=n_codes).astype(float)

    left_d, right_d = degrees()
    for _ in range(rounds):
        now = _cost(n_left, left_d) + _cost(n_right, right_d)
        over = now - _cost(n_left, np.maximum(left_d - 1, 0)) - _cost(n_right, right_d + 1)  # gain of moving right
        back = now - _cost(n_left, left_d + 1) - _cost(n_right, np.maximum(right_d - 1, 0))
        gain = np.bincount(own, weights=np.where(right[own], back[term], over[term]), minlength=len(docs))
        ls, rs = np.flatnonzero(~right), np.flatnonzero(right)
        ls, rs = ls[np.argsort(-gain[ls], kind="stable")], rs[np.argsort(-gain[rs], kind="stable")]
        m = min(len(ls), len(rs))
        trade = int((gain[ls[:m]] + gain[rs[:m]] > 1e-9).sum())
        if not trade:
            break
        right[ls[:trade]], right[rs[:trade]] = True, False
        left_d, right_d = degrees()
    dearer = (_cost(n_right, right_d + 1) - _cost(n_right, right_d)) - (_cost(n_left, left_d + 1) - _cost(n_left, left_d))
    return docs[~right], docs[right], dearer


def bisect(sample: list[list[bytes]], sample_terms: int, depth: int, rounds: int = 20, least: int = 8) -> Tree:
    """The halvings of a sample, each document a list of its distinct terms."""
    df = Counter(t for doc in sample for t in doc)
    common = sorted((t for t, n in df.items() if n > 1), key=lambda t: (-df[t], t))[:sample_terms]
    codes = {t: i for i, t in enumerate(common)}
    lists = [[codes[t] for t in doc if t in codes] for doc in sample]
    first = np.concatenate(([0], np.cumsum([len(x) for x in lists], dtype=np.int64))).astype(np.int64)
    flat = np.array([c for x in lists for c in x], np.int64)
    costs = np.zeros((1 << depth, len(codes)), np.float32)
    open_nodes = {1: np.arange(len(sample))}
    for node in range(1, 1 << depth):
        docs = open_nodes.pop(node, np.empty(0, np.int64))
        if len(docs) >= 2 * least:  # fewer stay together, and what walks down keeps left
            open_nodes[2 * node], open_nodes[2 * node + 1], costs[node] = _halved(docs, first, flat, len(codes), rounds)
    return Tree(codes, costs, depth)


def order(docs: DataFrame, id_col: str, text_col: str, sample_docs: int, sample_terms: int, depth: int) -> Tree:
    """The halvings, fitted on the documents of the smallest hashes."""
    hashed = docs.select(F.xxhash64(docs[id_col], docs[text_col]).alias("h"), docs[text_col].alias("text")).where("text IS NOT NULL")
    last = [r.h for r in hashed.select("h").orderBy("h").limit(sample_docs).collect()][-1:]

    def distinct(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            yield pa.RecordBatch.from_arrays([pa.array([list(set(terms_of(t))) for t in texts(b.column(0))], pa.list_(pa.binary()))], names=["terms"])

    chosen = hashed.where(F.col("h") <= (last[0] if last else 0)).orderBy("h").limit(sample_docs).select("text")
    sample = [sorted(bytes(t) for t in r.terms) for r in chosen.mapInArrow(distinct, "terms array<binary>").collect()]
    return bisect(sample, sample_terms, depth)


# -- the index


@dataclass
class Index:
    """shards: shard, doc_ids, terms, sizes (documents of each term), best (its largest
    impact), docs and impacts (of the terms one after another)."""

    shards: DataFrame
    n_docs: int


def build(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    sample_docs: int = 2048,
    sample_terms: int = 16_384,
    depth: int = 6,
    shard_docs: int = 1024,
    shard_terms: int = 400_000,
) -> Index:
    """An index of every document that has a term. Ids must be integers."""
    spark = docs.sparkSession
    tree = spark.sparkContext.broadcast(order(docs, id_col, text_col, sample_docs, sample_terms, depth))  # depth x sample_terms numbers at most

    def forward(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = TaskContext.get().partitionId() << 36

        def rows(held: list[tuple]) -> pa.RecordBatch:
            at = np.concatenate(([0], np.cumsum([len(h[3]) for h in held]))).astype(np.int32)
            terms = pa.array([t for h in held for t in h[3]], pa.binary())
            tfs = pa.array([n for h in held for n in h[3].values()], pa.int32())
            head = [pa.array(x, pa.int64()) for x in zip(*[(h[0], h[1], h[2], h[4]) for h in held], strict=True)]
            lists = [pa.ListArray.from_arrays(pa.array(at), x) for x in (terms, tfs)]
            return pa.RecordBatch.from_arrays([*head, *lists], names=["uid", "doc_id", "leaf", "n", "terms", "tfs"])

        for b in it:
            held, size = [], 0
            for doc, text in zip(b.column(0).to_pylist(), texts(b.column(1)), strict=True):
                words = terms_of(text)
                uid += 1
                if words:
                    n = Counter(words)
                    held.append((uid, doc, tree.value.leaf(n), n, len(words)))
                    size += len(n)
                if size > _HELD:
                    yield rows(held)
                    held, size = [], 0
            if held:
                yield rows(held)

    source = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    known = C.written(source.mapInArrow(forward, "uid long, doc_id long, leaf long, n long, terms array<binary>, tfs array<int>"))
    leaves = known.groupBy("leaf").agg(F.count("*").alias("docs"), F.sum("n").alias("n"), F.sum(F.size("terms")).alias("terms")).collect()  # 2**depth rows at most
    n_docs, total = sum(r.docs for r in leaves), sum(r.n for r in leaves)
    into = {r.leaf: max(1, -(-r.docs // shard_docs), -(-r.terms // shard_terms)) for r in leaves}
    shards_of = F.coalesce(*[F.when(F.col("leaf") == leaf, F.lit(n)) for leaf, n in into.items()], F.lit(1))
    shard = F.col("leaf") * (1 << 40) + F.pmod(F.xxhash64("uid"), shards_of)

    def invert(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        ids = t["doc_id"].fill_null(_LAST).to_numpy()
        t = t.take(pa.array(np.lexsort((t["uid"].to_numpy(), np.asarray(t["doc_id"].is_null()), ids)))).combine_chunks()
        sizes = pc.list_value_length(t["terms"]).to_numpy()
        coded = pc.list_flatten(t["terms"]).combine_chunks().dictionary_encode()
        coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
        code, tf = coded.indices.to_numpy(), pc.list_flatten(t["tfs"]).to_numpy().astype(np.int64)
        doc = np.repeat(np.arange(len(sizes)), sizes)
        m = 75 + 25 * t["n"].to_numpy() * n_docs // total
        impact = 1_000_000_000 * tf // (1000 * tf + 12 * m[doc])
        by = np.argsort(code, kind="stable")
        count = np.bincount(code, minlength=len(coded.dictionary))
        best = np.maximum.reduceat(impact[by], np.cumsum(count) - count)
        cols = [t["doc_id"].combine_chunks(), coded.dictionary, pa.array(count, pa.int32()), pa.array(best, pa.int32()), pa.array(doc[by], pa.int32()), pa.array(impact[by], pa.int32())]
        lists = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in cols]
        return pa.Table.from_arrays([t["shard"][:1].combine_chunks(), *lists], names=["shard", "doc_ids", "terms", "sizes", "best", "docs", "impacts"])

    schema = "shard long, doc_ids array<long>, terms array<binary>, sizes array<int>, best array<int>, docs array<int>, impacts array<int>"
    return Index(C.written(known.withColumn("shard", shard).groupBy("shard").applyInArrow(invert, schema)), n_docs)


# -- search


def queries_of(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """query (a number of its own), item_id, term, n of the items' terms."""

    def split(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = TaskContext.get().partitionId() << 36
        for b in it:
            for item, text in zip(b.column(0).to_pylist(), texts(b.column(1)), strict=True):
                uid += 1
                n = Counter(terms_of(text))
                if n:
                    cols = pa.array([uid] * len(n)), pa.array([item] * len(n), pa.int64()), pa.array(list(n), pa.binary()), pa.array(list(n.values()), pa.int64())
                    yield pa.RecordBatch.from_arrays(list(cols), names=["query", "item_id", "term", "n"])

    source = items.select(items[id_col].cast("long").alias("item_id"), items[text_col].cast("string").alias("text"))
    return source.mapInArrow(split, "query long, item_id long, term binary, n long")


class _Scorer:
    """Scores the documents of a shard for the queries that visit it."""

    def __init__(self, queries: dict[int, tuple[list[bytes], list[int]]], k: int) -> None:
        self.k = k
        self.vocabulary = pa.array(sorted({t for terms, _ in queries.values() for t in terms}), pa.binary())
        code = {t: i for i, t in enumerate(self.vocabulary.to_pylist())}
        self.queries = {q: (np.array([code[t] for t in terms], np.int64), weights) for q, (terms, weights) in queries.items()}

    def score(self, ids: pa.Array, terms: pa.Array, sizes: np.ndarray, docs: np.ndarray, impacts: np.ndarray, visits: list[tuple[int, int]]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """query, places of its best documents, their scores."""
        at = pc.index_in(self.vocabulary, value_set=terms).fill_null(-1).to_numpy()
        end = np.cumsum(sizes)
        begin = end - sizes
        for query, floor in visits:
            score = np.zeros(len(ids), np.int64)
            codes, weights = self.queries[query]
            for place, weight in zip(at[codes].tolist(), weights, strict=True):
                if place >= 0:
                    own = slice(begin[place], end[place])
                    score[docs[own]] += weight * impacts[own]
            some = np.flatnonzero(score >= max(floor, 1))
            best = some[np.argsort(-score[some], kind="stable")[: self.k]]
            if len(best):
                yield query, best, score[best]


def search(index: Index, items: DataFrame, k: int = 20, id_col: str = "item_id", text_col: str = "text", visits: tuple[int, ...] = (4, 32), batch: int = 1024) -> DataFrame:
    """item_id, rank, doc_id, score of the k best documents of each item. visits: shards that
    an item visits in each round but the last."""
    spark = items.sparkSession
    asked = C.written(queries_of(items, id_col, text_col))
    batches = max(1, -(-asked.select("query").distinct().count() // batch))
    own = F.pmod(F.xxhash64("query"), F.lit(batches))
    found = [_search(index, C.written(asked.where(own == i)) if batches > 1 else asked, k, visits) for i in range(batches)]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    C.release(spark)
    return out


def bounds(index: Index, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The queries' terms with weights (query, item_id, term, weight), and each query's
    bound in each shard (query, shard, bound)."""
    each = index.shards.select("shard", F.explode(F.arrays_zip("terms", "sizes", "best")).alias("t"))
    hits = C.written(each.select("shard", F.col("t.terms").alias("term"), F.col("t.sizes").alias("size"), F.col("t.best").alias("best")).join(asked.select("term").distinct(), "term", "left_semi"))
    df = hits.groupBy("term").agg(F.sum("size").alias("df"))
    weight = F.floor(1000 * F.log((2 * F.lit(float(index.n_docs)) + 2) / (2 * F.col("df") + 1))).cast("long")
    weighted = C.written(asked.join(df.withColumn("weight", weight), "term").select("query", "item_id", "term", (F.col("weight") * F.col("n")).alias("weight")))
    bound = hits.join(weighted, "term").groupBy("query", "shard").agg(F.sum(F.col("weight") * F.col("best")).alias("bound"))
    return weighted, C.written(bound.where("bound > 0"))


def _search(index: Index, asked: DataFrame, k: int, visits: tuple[int, ...]) -> DataFrame:
    spark = asked.sparkSession
    weighted, bound = bounds(index, asked)
    terms: dict[int, tuple[list[bytes], list[int]]] = {}
    item: dict[int, int | None] = {}
    for r in weighted.toLocalIterator():  # the terms of one batch of items
        own = terms.setdefault(r.query, ([], []))
        own[0].append(bytes(r.term))
        own[1].append(r.weight)
        item[r.query] = r.item_id
    scorer = spark.sparkContext.broadcast(_Scorer(terms, k))
    best = Window.partitionBy("query").orderBy(F.desc("bound"), "shard")
    ranked = Window.partitionBy("query").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    state = spark.createDataFrame([(q, 0, _LAST, -1) for q in terms], "query long, floor long, cut long, cut_shard long")
    top: DataFrame | None = None
    schema = "query long, doc_id long, score long"

    def scored(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for i in range(b.num_rows):
                ids, names, sizes, docs, impacts, asks = (b.column(j)[i].values for j in range(1, 7))
                pairs = list(zip(asks.field(0).to_pylist(), asks.field(1).to_pylist(), strict=True))
                for query, at, score in scorer.value.score(ids, names, sizes.to_numpy().astype(np.int64), docs.to_numpy(), impacts.to_numpy().astype(np.int64), pairs):
                    yield pa.RecordBatch.from_arrays([pa.array([query] * len(at)), ids.take(pa.array(at)), pa.array(score)], names=["query", "doc_id", "score"])

    for r in (*visits, None):
        # shards behind those visited, in the order of their bounds, that may hold a better document
        left = bound.join(state, "query").where("bound < cut OR (bound = cut AND shard > cut_shard)").where(F.col("bound") >= F.col("floor"))
        if r is not None:
            left = left.withColumn("i", F.row_number().over(best)).where(F.col("i") <= r)
        left = C.written(left.select("query", "shard", "bound", "floor"))
        asks = left.groupBy("shard").agg(F.collect_list(F.struct("query", "floor")).alias("asks"))
        new = index.shards.select("shard", "doc_ids", "terms", "sizes", "docs", "impacts").join(asks, "shard").mapInArrow(scored, schema)
        merged = new if top is None else top.unionByName(new)
        top = C.written(merged.withColumn("i", F.row_number().over(ranked)).where(F.col("i") <= k).select("query", "doc_id", "score"))
        if r is not None:
            floor = top.groupBy("query").agg(F.when(F.count("*") >= k, F.min("score")).otherwise(0).alias("floor"))
            end = left.groupBy("query").agg(F.min(F.struct("bound", (-F.col("shard")).alias("shard"))).alias("end"))
            cuts = end.select("query", F.col("end.bound").alias("cut"), (-F.col("end.shard")).alias("cut_shard"))
            state = cuts.join(floor, "query", "left").select("query", F.coalesce("floor", F.lit(0)).alias("floor"), "cut", "cut_shard")
            state = C.written(state)  # a query without shards left is done
    names = spark.createDataFrame(list(item.items()), "query long, item_id long")
    placed = top.withColumn("rank", F.row_number().over(ranked).cast("int"))
    return placed.join(names, "query").select("item_id", "rank", "doc_id", "score")
