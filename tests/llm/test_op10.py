"""Operator 10 against plain Python."""

import re
from collections import defaultdict

from lexispark.llm import registry, templates

SF = "/root/testdata/sf0.01"
INF = 1 << 63


def own_templates(line):
    t = [b"<*>" if re.search(rb"[0-9]", x) else x for x in line.encode().split()]
    n = len(t)
    if n < 3:
        return []
    out = [(n, tuple(t))]
    if n >= 8:
        cuts = [2 + (n - 2) * j // 4 for j in range(5)]
        out += [(n, j, tuple(t[: cuts[j]]), tuple(t[cuts[j + 1] :])) for j in range(4)]
    return out


def brute(docs):
    seen = defaultdict(set)
    lines = []
    for r, (d, t) in enumerate(docs):
        for i, line in enumerate((t or "").split("\n")):
            own = own_templates(line)
            lines.append(((INF if d is None else d, i), r, own))
            for k in own:
                seen[k].add(r)
    gone, kept = set(), {}
    for place, r, own in sorted(lines, key=lambda x: x[0]):  # one by one, in order
        own = [k for k in own if len(seen[k]) >= 3]
        if any(kept.get(k, place) < place for k in own):
            gone.add((r, place[1]))
        else:
            kept |= {k: min(kept.get(k, place), place) for k in own}
    out = []
    for r, (d, t) in enumerate(docs):
        all_ = (t or "").split("\n")
        left = [x for i, x in enumerate(all_) if (r, i) not in gone]
        out.append((d, t if t is None or len(left) == len(all_) else "\n".join(left), len(all_) - len(left)))
    return sorted(out, key=repr)


def test_on_sf(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    docs = [tuple(r) for r in d.select("doc_id", "text").collect()]
    got = sorted(((r.doc_id, r.text, r.n_dropped) for r in templates.dedup_lines(d).collect()), key=repr)
    want = brute(docs)
    assert got == want and sum(x[2] for x in want) > 50
    assert registry.op10_lines(spark, SF).count() == len(docs)


def test_odd_cases(spark):
    a = "the user {} logged in from {} at noon on a quiet day"
    docs = [(i, "\n".join([a.format(f"u{i}", f"10.0.0.{i}"), "All rights reserved.", "ok", f"only here {'xyz'[i % 3] * (i + 1)} stays"]), 1) for i in range(8)]
    docs += [(20 + i, f"a plain long line of words with one {w} field in it\n\n ", 1) for i, w in enumerate(["red", "green", "blue"])]
    docs += [(30, None, 1), (31, "", 1), (None, "All rights reserved.", 1), (5, docs[5][1], 1), (40, "z " * 40_000, 1), (41, "x\n" * 5000 + "All  rights\treserved.", 1)]
    d = spark.createDataFrame(docs, "doc_id long, text string, n_lines int").repartition(4)
    got = templates.dedup_lines(d)
    assert got.columns == ["doc_id", "text", "n_lines", "n_dropped"]
    assert sorted(((r.doc_id, r.text, r.n_dropped) for r in got.collect()), key=repr) == brute([x[:2] for x in docs])
    assert templates.dedup_lines(d.limit(0)).count() == 0


def test_a_line_goes_only_for_one_that_stays(spark):
    """Lines of one template, whose first goes for another template whose first is elsewhere."""
    line = "a b {} d e f g h i {}".format
    docs = [(i, line(x, y)) for i, (x, y) in enumerate(zip("rsqqq", "11vwx", strict=True))]
    docs = [(i, t.replace("1", "k")) for i, t in docs] + [(10 + i, line("r", "k") + "\n" + line("s", "k")) for i in range(2)]
    got = {r.doc_id: r.n_dropped for r in templates.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {0: 0, 1: 1, 2: 0, 3: 1, 4: 1, 10: 2, 11: 2}
    got = templates.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string"))
    assert sorted(((r.doc_id, r.text, r.n_dropped) for r in got.collect()), key=repr) == brute(docs)
    chain = [(i, line(f"w{chr(97 + (i + 1) // 2)}", f"v{chr(97 + i // 2)}")) for i in range(6)]
    chain += [(100 + i, t) for i, t in chain] + [(200 + i, t) for i, t in chain] + [(None, t) for _, t in chain[:3]]
    got = templates.dedup_lines(spark.createDataFrame(chain, "doc_id long, text string").repartition(3))
    assert sorted(((r.doc_id, r.text, r.n_dropped) for r in got.collect()), key=repr) == brute(chain)
