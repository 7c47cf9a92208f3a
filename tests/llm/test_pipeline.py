"""The pipeline, stage by stage, against the operators' plain Python versions."""

import corpus_pipeline
from tests.llm import test_op1_op8 as packs
from tests.llm import test_op6 as near
from tests.llm import test_op10 as lines

SF = "/root/testdata/sf0.01"


def rows(df):
    return [tuple(r) for r in df.select("doc_id", "text").collect()]


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    cols = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}

    one = stages["toxicity"](spark, docs, SF).cache()
    assert one.columns == cols
    kept = {d for d, _ in rows(one)}
    judged = [(d in kept, y) for d, y in labels.items()]
    assert sum(k for k, y in judged if y == 0) >= 0.98 * sum(y == 0 for _, y in judged)
    assert sum(not k for k, y in judged if y == 1) >= 0.7 * sum(y == 1 for _, y in judged)

    two = stages["line dedup"](spark, one, SF).cache()
    assert two.columns == cols
    assert sorted(((d, t) for d, t in rows(two)), key=repr) == [(d, t) for d, t, _ in lines.brute(rows(one))]

    three = stages["n-gram Jaccard join"](spark, two, SF).cache()
    assert three.columns == cols
    assert sorted(d for d, _ in rows(three)) == sorted(d for d, n, c in near.brute(rows(two), 5, 80) if n == 0 or c == d)

    four = stages["benchmark decontamination"](spark, three, SF).cache()
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    assert four.columns == cols
    assert sorted(d for d, _ in rows(four)) == sorted(d for d, _, h, _ in packs.brute_decontaminate(rows(three), items) if h == 0)

    packs.check_packing(spark, rows(four), stages["packing"](spark, four, SF).drop("ids").collect())
    whole = corpus_pipeline.run(spark, SF)
    assert {r.doc_id for r in whole.select("doc_id").collect()} == {d for d, _ in rows(four)}


def test_rows_of_null_and_repeated_ids(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first().text
    near = " ".join(f"near{i}" for i in range(60))
    other = " ".join(f"other{i}" for i in range(60))
    clean = " ".join(f"clean{i}" for i in range(30))
    made = [(None, near), (None, near + " more"), (5, near), (5, near), (5, other), (3, other), (3, other), (None, item), (7, item), (7, clean), (None, None), (8, ""), (8, "")]
    made += [(None, " ".join(f"alone{i}" for i in range(40))), (None, " ".join(f"alone{i}" for i in range(40))), (None, " ".join(f"single{i}" for i in range(40)))]
    d = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in made], docs.select("doc_id", "text", "lang", "source", "n_chars").schema).select(*docs.columns).repartition(3)
    stages = dict(corpus_pipeline.STAGES)
    key = lambda x: sorted(x, key=repr)

    one = stages["n-gram Jaccard join"](spark, d, SF)
    assert one.columns == docs.columns
    # a row with an id goes before one without
    assert key(rows(one)) == key([(5, near), (3, other), (7, item), (7, clean), (None, None), (8, ""), (8, ""), made[13], made[15]])

    two = stages["benchmark decontamination"](spark, d, SF)
    assert two.columns == docs.columns
    assert key(rows(two)) == key([x for x in made if x[1] != item])


def test_columns_of_any_name_and_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    names = ["score", "predicted", "held_out", "n_lines", "n_dropped", "row", "uid"]
    more = docs.selectExpr("*", *[f"doc_id AS {n}" for n in names]).cache()
    for name, stage in corpus_pipeline.STAGES[:2]:
        out = stage(spark, more, SF)
        assert out.columns == more.columns, name
        assert all(r[n] == r.doc_id for r in out.collect() for n in names), name
        assert stage(spark, more.limit(0), SF).count() == 0


def test_later_stages_with_columns_of_any_name_ties_long_texts_and_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    long = " ".join(f"long{i}" for i in range(60_000))
    made = [(900_002, long), (900_001, long + " end"), (900_003, None), (900_004, ""), (900_005, "one two"), (900_005, "one two")]
    d = docs.limit(40).unionByName(spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in made], docs.schema))
    names = ["n", "node", "k1", "h", "first", "row", "component_id", "uid", "n_hit", "n_words", "start", "length", "sequence_id", "ids"]
    more = d.selectExpr("*", *[f"doc_id AS {n}" for n in names]).cache()
    for name, stage in corpus_pipeline.STAGES[2:4]:
        out = stage(spark, more, SF)
        assert out.columns == more.columns, name
        got = out.collect()
        assert all(r[n] == r.doc_id for r in got for n in names), name
        own = sorted(r.doc_id for r in got if r.doc_id >= 900_000)
        tied = [900_001, 900_003, 900_004, 900_005] if name == "n-gram Jaccard join" else sorted(i for i, _ in made)
        assert own == tied, name
        assert stage(spark, more.limit(0), SF).count() == 0
    plain = [(r.doc_id, r.text) for r in more.select("doc_id", "text").collect()]
    name, stage = corpus_pipeline.STAGES[4]
    pieces = stage(spark, more.where("doc_id <> 900005"), SF).drop("ids").collect()
    packs.check_packing(spark, [x for x in plain if x[0] != 900_005], pieces)
    assert stage(spark, more.limit(0), SF).count() == 0
