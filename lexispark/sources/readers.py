"""Readers of texts, dictionaries, vocabularies, id lists and answers."""

from __future__ import annotations

import re
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.functions import greek
from lexispark.functions import text as T
from lexispark.operators import lexicon as L
from lexispark.operators.enrich import id_list, unwrap_response

# Fixed names of the format.
FORM = "struct<form:string,morphology:string,occurrences:bigint>"
CONTEXT = "struct<ref:string,form:string,sentence:string,highlight_start:int,highlight_end:int,translation:string,translation_highlight_method:string,translation_highlight_confidence:string,translation_highlight_start:int,translation_highlight_end:int>"
WORD = f"struct<id:bigint,lemma:string,definition:string,level:int,frequency:bigint,pos:string,forms:array<{FORM}>,contexts:array<{CONTEXT}>,context_definition:string,etymology:string>"
VOCAB = f"metadata struct<title:string,author:string,work_id:string,reference_system:string,total_words:bigint,unique_lemmas:bigint>, words array<{WORD}>"
SECTIONS = "title string, author string, reference_system string, div_type string, div_subtype string, section_ord int, ref string, text string, error string"
#: Genre marks behind an author's name
_GENRE = re.compile(r"\s+(?:Phil|Hist|Trag|Comic)\.\s*$")


def _local(tag: object) -> str:
    return tag.rpartition("}")[2] if isinstance(tag, str) else ""


def _inner_text(node: ElementTree.Element, skip: tuple[str, ...]) -> str:
    """Text in document order; skipped elements lose their content, not their tail."""
    out, stack = [], [(node, False)]
    while stack:
        e, tail = stack.pop()
        if tail:
            out.append(e.tail or "")
            continue
        if e is not node:
            stack.append((e, True))
        if _local(e.tag) in skip:
            continue
        out.append(e.text or "")
        stack += [(c, False) for c in reversed(e)]
    return "".join(out)


def text_sections(xml: str) -> list[dict]:
    """Leaf sections of a TEI document, in order: the text of their paragraphs as it is,
    joined by blanks. Without divisions, or if all are blank, the body is one section."""
    root = ElementTree.fromstring(xml)
    by_name = lambda e, name: (x for x in e.iter() if _local(x.tag) == name)
    head = next(by_name(root, "titleStmt"), root)
    own = lambda name: (next(by_name(head, name)).text or "").strip() or "Unknown" if any(True for _ in by_name(head, name)) else "Unknown"
    title, author = own("title"), own("author")
    body = next(by_name(root, "body"), None)
    if body is None:
        raise ValueError("no body")
    first = next((c for c in body if _local(c.tag) == "div"), next(by_name(body, "div"), None))
    base = {"title": title, "author": _GENRE.sub("", author), "div_type": first.get("type") if first is not None else None, "div_subtype": first.get("subtype") if first is not None else None}
    paragraphs = lambda e: " ".join(_inner_text(p, ("label", "pb")) for p in by_name(e, "p"))
    rows: list[dict] = []
    stack = [(c, ()) for c in reversed(body) if _local(c.tag) == "div"]
    while stack:
        e, names = stack.pop()
        names = (*names, e.get("n") or "")
        inner = [c for c in e if _local(c.tag) == "div"]
        if inner:
            stack += [(c, names) for c in reversed(inner)]
            continue
        text = paragraphs(e)
        if text.strip():
            rows.append({"section_ord": len(rows), "ref": "".join(names), "text": text})
    if not rows:
        rows = [{"section_ord": 0, "ref": "1", "text": paragraphs(body)}]
    return [base | r for r in rows]


def tei(docs: DataFrame, id_col: str = "work_id", xml_col: str = "xml") -> DataFrame:
    """A row for each section of each document; a document that can't be read gives one
    row with the error. docs: work_id, xml."""

    def parse(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            rows = []
            for r in batch.to_pylist():
                try:
                    rows += [{"id": r["id"]} | x for x in text_sections(r["xml"] or "")]
                except (ElementTree.ParseError, ValueError) as e:
                    rows.append({"id": r["id"], "error": str(e)})
            yield pa.RecordBatch.from_pylist(rows, schema)

    names = [("id", pa.string()), *((c.split()[0], pa.int32() if c.endswith(" int") else pa.string()) for c in SECTIONS.split(", "))]
    schema = pa.schema(names)
    out = docs.select(F.col(id_col).cast("string").alias("id"), F.col(xml_col).cast("string").alias("xml")).mapInArrow(parse, f"id string, {SECTIONS}")
    return out.withColumn("reference_system", T.reference_system(F.col("div_type"), F.col("div_subtype"))).withColumnRenamed("id", id_col)


def tei_files(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").load(path)
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.xml$", "")
    return tei(files.select(name.alias("work_id"), F.decode("content", "utf-8").alias("xml")))


#: How an entry of a dictionary begins, and what ends one. Fixed values of the format.
_ENTRY, ENTRY_END = re.compile(r"<(entry(?:Free)?)(?=[\s/>])"), "</entry"
_DEFINED = ("amp", "lt", "gt", "quot", "apos")


def _entry(record: str) -> tuple[ElementTree.Element | None, str | None]:
    """The entry that begins in a record and ends with it, and the fault that it has. Of a
    faulty one what comes before the fault counts; undefined entities are left out."""
    begin = list(_ENTRY.finditer(record))
    if not begin:
        return None, None
    xml = re.sub(r"&([\w.-]+);", lambda m: m[0] if m[1] in _DEFINED else "", record[begin[-1].start() :]) + f"</{begin[-1][1]}>"
    try:
        return ElementTree.fromstring(xml), None
    except ElementTree.ParseError as e:
        fault = str(e)
    parser, root = ElementTree.XMLPullParser(("start",)), None
    try:
        parser.feed(xml)
        parser.close()
    except ElementTree.ParseError:
        pass
    try:
        for _, x in parser.read_events():
            root = x if root is None else root
    except ElementTree.ParseError:  # the fault comes after the events before it
        pass
    return root, fault


def _read_entries(records: DataFrame) -> DataFrame:
    """file, entry_ord, key, orth, first_sense, all_glosses, error of each entry. records:
    file, entry_ord (an order within the file), record."""
    strings = pa.list_(pa.string())
    schema = pa.schema([("file", pa.string()), ("entry_ord", pa.int64()), ("key", pa.string()), ("orth", pa.string()), ("first_sense", strings), ("all_glosses", strings), ("error", pa.string())])

    def glosses(e: ElementTree.Element) -> list[str]:
        return [(t.text or "").strip().strip(",;.: ") for t in e.iter() if _local(t.tag) == "tr"]

    def parse(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            rows = []
            for r in batch.to_pylist():
                e, fault = _entry(r["record"] or "")
                if e is not None:
                    orth = next((o.text or "".join(o.itertext()).strip() for o in e.iter() if _local(o.tag) == "orth"), None)
                    sense = next((x for x in e.iter() if _local(x.tag) == "sense"), None)
                    rows.append({"file": r["file"], "entry_ord": r["entry_ord"], "key": e.get("key", ""), "orth": orth, "first_sense": [] if sense is None else glosses(sense), "all_glosses": glosses(e), "error": fault})
            yield pa.RecordBatch.from_pylist(rows, schema)

    return records.mapInArrow(parse, "file string, entry_ord long, key string, orth string, first_sense array<string>, all_glosses array<string>, error string")


def dictionary_entries(docs: DataFrame, file_col: str = "file", xml_col: str = "xml") -> DataFrame:
    """Entries of dictionaries that are rows of a frame, record by record: a fault spoils its
    own entry alone, and error tells it."""
    cut = docs.select(F.col(file_col).cast("string").alias("file"), F.posexplode(F.split(F.col(xml_col).cast("string"), ENTRY_END)).alias("entry_ord", "record"))
    return _read_entries(cut.select("file", F.col("entry_ord").cast("long").alias("entry_ord"), "record"))


def dictionary_files(spark: SparkSession, path: str) -> DataFrame:
    """Entries of the dictionary files of a folder. Spark cuts the files where entries end,
    so a large file is read by many tasks. entry_ord orders the entries of a file."""
    t = spark.read.option("recursiveFileLookup", "true").option("lineSep", ENTRY_END).text(path)
    at = t.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("i"), F.col("value").alias("record"))
    # within a file records are ordered by split, then by their place in it
    return _read_entries(at.select("file", (F.col("split") * F.lit(1 << 22) + F.col("i")).alias("entry_ord"), "record"))


def dictionary(entries: DataFrame, fallback_most: int = 5) -> DataFrame:
    """headword, definition: the first entry of a file, the last file of them all."""
    usable = lambda c: F.filter(c, lambda g: T.usable_gloss(g))
    own = usable("first_sense")
    glosses = F.when(F.size(own) > 0, own).otherwise(F.slice(usable("all_glosses"), 1, fallback_most))
    name = F.coalesce(T.truthy(greek.from_beta(F.col("key"))), F.col("orth"))
    e = entries.select("file", "entry_ord", greek.headword(name).alias("headword"), T.short_definition(L.join_glosses(glosses)).alias("definition")).where("headword <> '' AND definition <> ''")
    first = e.groupBy("file", "headword").agg(F.min_by("definition", "entry_ord").alias("definition"))
    return L.last_wins(first, "headword", "definition", "file")


def stripped_index(lex: DataFrame, order: str | None = None) -> DataFrame:
    """stripped, headword: the first headword, in order, of those that differ by marks."""
    keyed = lex.withColumn("stripped", greek.strip_marks(F.col("headword")))
    return keyed.groupBy("stripped").agg(F.min_by("headword", F.col(order) if order else F.col("headword")).alias("headword"))


def vocab_json(spark: SparkSession, path: str) -> DataFrame:
    """Vocabulary files with the declared schema, whatever fields a file has."""
    return spark.read.schema(VOCAB).option("multiLine", True).json(path)


def words_of(vocab: DataFrame) -> DataFrame:
    return vocab.select(F.col("metadata.work_id").alias("work_id"), F.explode("words").alias("w")).select("work_id", "w.*")


def id_file(spark: SparkSession, path: str) -> DataFrame:
    """pos, id of a JSON array or of one number a line; an empty file has none."""
    t = spark.read.text(path, wholetext=True)
    return t.select(F.posexplode(ids_of("value")).alias("pos", "id"))


def ids_of(col: str) -> Column:
    """The ids of a JSON array or of one number a line."""
    return id_list(F.regexp_replace(F.regexp_replace(col, r"[\[\]]", ""), r"\s+", ","))


def responses(df: DataFrame, schema: str, text_col: str = "response") -> DataFrame:
    """Answers parsed to rows; error is set where there is no array."""
    arr = unwrap_response(F.col(text_col))
    parsed = F.from_json(arr, f"array<{schema}>")
    out = df.withColumn("error", F.when(parsed.isNull(), F.lit("no array")))
    return out.select(*[c for c in df.columns if c != text_col], "error", F.explode_outer(parsed).alias("r"))


def state(c, schema: str, default: str):
    """Stored JSON, or the default where it is malformed."""
    return F.coalesce(F.from_json(c, schema), F.from_json(F.lit(default), schema))
