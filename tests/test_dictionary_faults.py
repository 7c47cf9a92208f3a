"""Dictionary files that aren't well formed."""

from lexispark.sources import readers


def test_faulty_files_keep_their_entries(spark):
    a, b = "<entry key='a'><orth>a</orth><sense><tr>one</tr></sense></entry>", "<entry key='b'><orth>b</orth><sense><tr>two&mdash;2</tr></sense></entry>"
    files = [("whole", f"<d>{a}</d>"), ("entity", f"<d>{b}{a}</d>"), ("cut", f"<d>{a}{b}<entry key='c'><orth>c"), ("empty", ""), ("null", None)]
    rows = readers.dictionary_entries(spark.createDataFrame(files, "file string, xml string")).collect()
    got = sorted((r["file"], r["entry_ord"], r["key"], *r["first_sense"]) for r in rows)
    assert got == [("cut", 0, "a", "one"), ("cut", 1, "b", "two2"), ("cut", 2, "c"), ("entity", 0, "b", "two2"), ("entity", 1, "a", "one"), ("whole", 0, "a", "one")]


def test_entries_after_a_fault_are_read(spark, tmp_path):
    """A fault spoils its own entry alone, in frames and in files that many tasks read."""
    entry = "<entryFree key='{0}'><orth>{0}</orth><sense><tr>gloss {0}</tr></sense></entryFree>\n".format
    bad = ["<entryFree key='x1'><orth>x1</orth><sense><tr>kept</tr><b></sense></entryFree>", "<entry key=x2><tr>lost</tr></entry>", "<entry><orth>x3</orth>a & b<tr>lost</tr></entry>"]
    words = [f"w{i:03d}" for i in range(60)]
    xml = "<?xml version='1.0'?><d>" + "".join(entry(w) + (bad[i // 10] if i in (5, 15, 25) else "") for i, w in enumerate(words)) + "</d>"
    rows = readers.dictionary_entries(spark.createDataFrame([("f", xml)], "file string, xml string")).orderBy("entry_ord").collect()
    assert [r.key for r in rows if r.error is None] == words
    assert [(r.key, r.all_glosses) for r in rows if r.error] == [("x1", ["kept"]), ("", [])]
    (tmp_path / "a.xml").write_text(xml)
    (tmp_path / "b.xml").write_text(xml.replace("w00", "v00"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700b")
    try:
        files = readers.dictionary_files(spark, str(tmp_path))
        assert files.rdd.getNumPartitions() > 4
        got = files.orderBy("file", "entry_ord").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r.key for r in got if r.error is None and r.file.endswith("a.xml")] == words
    assert len([r for r in got if r.file.endswith("b.xml") and r.key.startswith("v00")]) == 10
