"""Operator 12: round trips, revisits, and damage of every kind."""

import base64
import gzip
import hashlib
import random
import re
import uuid

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexispark.llm import warc

PAGES = "page_id long, url string, html string, digest int, bytes string"


def plain(i, payload, refers_to=None):
    return warc.record(str(i), f"http://x/{i}", payload, hashlib.sha256(payload).hexdigest(), refers_to, "2024-01-01T00:00:00Z")


def brute(pages):
    first = {}
    for i, _, html, *_ in pages:
        data = (html or "").encode()
        if len(data) >= 100:
            first[data] = min(x for x in (first.get(data), i) if x is not None) if i is not None or first.get(data) is not None else None
    out = []
    for i, _, html, *_ in pages:
        data = (html or "").encode()
        again = len(data) >= 100 and first[data] is not None and first[data] != i
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first[data] if again else None))
    return sorted(out, key=repr)


def test_round_trip_and_revisits(spark, tmp_path):
    same, other = "<p>é€\U0001f600 same\r\n\r\nWARC/1.1\r\n" * 9, "x" * 100
    pages = [(5, "http://a", same, 1, "b"), (3, "http://a", same, 1, "b"), (9, None, same, 1, "b"), (3, "http://c", same, 1, "b"), (None, "u\r\nX: 1", same, 1, "b")]
    pages += [(20, "a", other, 1, "b"), (21, "b", other, 1, "b"), (22, "c", other[:99], 1, "b"), (23, "d", other[:99], 1, "b"), (24, "e", None, 1, "b"), (25, "f", "", 1, "b")]
    pages += [(None, "n", "only null ids" * 20, 1, "b"), (None, "m", "only null ids" * 20, 1, "b"), (30, "l", "long " * 900_000, 1, "b")]
    pages += [(100 + i, "h", "hot " * 50, 1, "b") for i in range(300)]
    d = spark.createDataFrame(pages, PAGES).repartition(5)
    path = f"{tmp_path}/a"
    warc.write(warc.planned(d), path, rows_per_file=1)
    back = warc.read(spark, path).cache()
    assert back.where("gap IS NOT NULL").count() == 0
    assert sorted((tuple(r) for r in warc.page_ids(back).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=repr) == brute(pages)
    got = {r.record_id: bytes(r.payload) for r in back.where("record_type = 'response'").collect()}
    assert got["urn:page:3"] == same.encode() and got["urn:page:30"] == ("long " * 900_000).encode() and got["urn:page:24"] == b""
    files = [f for f in (tmp_path / "a").iterdir() if f.name.startswith("part-")]
    whole = b"".join(gzip.decompress(f.read_bytes()) for f in files)  # any gzip reader can read them
    assert whole.count(b"WARC/1.1\r\nWARC-Type: ") == len(pages)
    empty = f"{tmp_path}/b"
    warc.write(warc.planned(d.limit(0)), empty)
    assert warc.read(spark, empty).count() == 0


def test_damaged_files_of_a_folder(spark, tmp_path):
    """Every record that damage leaves whole is there, and gaps, records and parts cover a file."""
    members = [warc.member(plain(i, (f"page {i} " * 40).encode())) for i in range(40)]
    at = [sum(map(len, members[:i])) for i in range(41)]
    data = bytearray(b"".join(members))
    for i in (0, 7, 8, 39):  # first, two neighbours, last
        data[at[i] + len(members[i]) // 2] ^= 0x55
    data[at[20] : at[20]] = b"noise WARC/1.0 \x1f\x8b\x08 noise"
    folder = tmp_path / uuid.uuid4().hex
    folder.mkdir()
    (folder / "one.warc.gz").write_bytes(bytes(data))
    (folder / "cut.warc.gz").write_bytes(b"".join(members[:3])[: -len(members[2]) // 2])
    (folder / "one-member.warc.gz").write_bytes(gzip.compress(b"".join(plain(100 + i, b"p%d" % i * 50) for i in range(5)))[:-20])
    (folder / "noise.bin").write_bytes(b"nothing here")
    (folder / "empty.warc").write_bytes(b"")
    rows = warc.read(spark, str(folder)).collect()
    by = lambda n: [r for r in rows if r.path.endswith(n)]
    one = by("one.warc.gz")
    assert sorted(int(r.record_id.split(":")[-1]) for r in one if r.gap is None) == sorted(set(range(40)) - {0, 7, 8, 39})
    spans = sorted((r.offset, r.length) for r in one)
    assert all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:], strict=False)) and sum(n for _, n in spans) == len(data)
    assert {r.gap for r in one if r.gap} and len([r for r in one if r.gap]) == 4
    cut = by("cut.warc.gz")
    assert [r.record_id for r in cut if r.gap is None] == ["urn:page:0", "urn:page:1"] and [r.gap for r in cut if r.gap] == ["gzip: cut off"]
    member = [r for r in by("one-member.warc.gz") if r.gap is None]
    assert [r.record_id for r in member] == [f"urn:page:{100 + i}" for i in range(4)] and all(r.length == 0 for r in member)
    assert [r.length for r in by("noise.bin")] == [12] and not by("empty.warc")


def test_plain_files_with_broken_heads():
    nested = plain(99, b"inner page")
    records = [plain(1, b"a" * 200), plain(2, nested), plain(3, b"c" * 300), plain(4, b"d" * 10), plain(5, b"e" * 10)]
    whole = warc.salvage(b"".join(records))
    assert [r.headers["warc-record-id"] for r in whole.records] == [f"<urn:page:{i}>" for i in range(1, 6)] and not whole.gaps  # the inner one is no record
    records[2] = records[2].replace(b"Content-Length: 3", b"Content-Length: 9", 1)  # too long: reaches into the next ones
    records[3] = records[3].replace(b"WARC/1.1", b"WARX/1.1")
    found = warc.salvage(b"".join(records))
    assert [r.headers["warc-record-id"][-2] for r in found.records] == ["1", "2", "5"]
    assert [g[:2] for g in found.gaps] == [(len(records[0]) + len(records[1]), len(records[2]) + len(records[3]))]
    for wrong, why in ((b"Content-Length: x", "no Content-Length"), (b"Content-Length  9", "a header line without a colon"), (b"Content-Length: 9", "the block does not end where Content-Length says")):
        assert warc.salvage(re.sub(rb"Content-Length: \d+", wrong, records[4], count=1)).gaps[0][2] == why
    assert warc.salvage(plain(1, b"abc").replace(b"abc", b"abd")).gaps[0][2] == "wrong block digest"
    digest = base64.b32encode(hashlib.sha1(b"a").digest())
    old = b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Block-Digest: sha1:%s\r\nContent-Length: 1\r\n\r\n%s\r\n\r\n"
    assert warc.salvage(old % (digest, b"a")).records[0].payload() == b"a" and not warc.salvage(old % (digest, b"b")).records


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=300), min_size=1, max_size=6), st.booleans(), st.integers(0, 1 << 30), st.integers(0, 3))
def test_any_damage(payloads, packed, seed, kind):
    """Cuts, flips and added bytes: no wrong record, no lost one outside of the damage, all bytes told of."""
    rng = random.Random(seed)
    parts = [plain(i, p) for i, p in enumerate(payloads)]
    if packed:
        parts = [warc.member(p) for p in parts]
    ends = [sum(map(len, parts[: i + 1])) for i in range(len(parts))]
    data = bytearray(b"".join(parts))
    at = rng.randrange(len(data))
    hurt = range(at, at + 1)
    if kind == 1:
        data[at] ^= 1 + rng.randrange(255)
    elif kind == 2:
        data[at:at] = rng.randbytes(5)
    elif kind == 3:
        del data[at:]
        hurt = range(at, ends[-1])
    found = warc.salvage(bytes(data))
    got = {r.headers["warc-record-id"]: r.payload() for r in found.records}
    true = {f"<urn:page:{i}>": p for i, p in enumerate(payloads)}
    whole = {f"<urn:page:{i}>" for i, e in enumerate(ends) if kind == 0 or e - len(parts[i]) > hurt[-1] or e <= hurt[0]}
    assert whole <= set(got)
    assert all(got[k] == true[k] for k in whole)
    spans = sorted({(r.offset, r.length) for r in found.records if r.length} | {g[:2] for g in found.gaps})
    assert sum(n for _, n in spans) == len(data) and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:], strict=False))


@pytest.mark.parametrize("name", ["md5", "sha1", "sha256", "sha-512"])
def test_digests(name):
    d = hashlib.new(name.replace("-", ""), b"x").hexdigest()
    assert warc._same(f"{name}:{d}", b"x") and not warc._same(f"{name}:{d}", b"y") and warc._same("crc:1", b"y")
