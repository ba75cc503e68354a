"""Rows that agree in id and text but not in other columns, the largest id, and archives that this library didn't write."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from hopmine.llm import exact_dedup, fingerprints, mixing, ngram_join, warc

LAST = 2**63 - 1


def rows_with_ties():
    text = "one two three four five six seven eight nine ten"
    out = [(i, t, s) for i in (1, None, LAST) for t in (text, text + " ", " " + text) for s in "abcd"]
    return [*out, (5, "other words here that stay", "z"), (5, "other words here that stay", "y"), *[(None, "no id at all here", s) for s in "abc"]]


@pytest.mark.parametrize("drop", [exact_dedup.drop_exact_duplicates, ngram_join.drop_near_duplicates, mixing.mixed_documents])
def test_what_stays_does_not_depend_on_the_input_order(spark, drop):
    rows, found = rows_with_ties(), set()
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        got = drop(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(1 + seed))
        found.add(tuple(sorted(map(str, got.collect()))))
    assert len(found) == 1


def test_a_map_column_is_no_hindrance(spark):
    df = spark.createDataFrame(rows_with_ties(), "doc_id long, text string, source string").withColumn("m", F.create_map(F.lit("k"), "source"))
    assert exact_dedup.drop_exact_duplicates(df).count() == 3


@pytest.mark.parametrize("ranges", [1, 6])
def test_the_largest_id_is_no_missing_one(spark, ranges):
    rows = rows_with_ties()
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = exact_dedup.exact_duplicates(df, ranges=ranges).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in rows)
    alone = exact_dedup.exact_duplicates(df.filter("doc_id is null or doc_id > 5"), ranges=ranges).collect()
    assert {(r.keep_id, r.group_size) for r in alone} == {(LAST, 24), (None, 3)}
    assert sum(r.kept for r in alone) == 2
    prints = fingerprints.edited_fingerprints(df, ranges=ranges).collect()
    assert sorted(str(r.doc_id) for r in prints) == sorted(str(r[0]) for r in rows)


def test_null_ids_follow_the_largest_one(spark):
    rows = [(LAST, "a b c d e f " * 3), (None, "x y z " * 5), (1, "k l m n " * 4)]
    got = {r.doc_id: r for r in fingerprints.edited_fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    text = {i: t for i, t in rows}
    for i, after in ((1, LAST), (LAST, None), (None, 1)):
        half = len(text[i]) // 2
        assert got[i].edited_sha256 == hashlib.sha256((text[i][: len(text[i]) - half] + text[after][:half]).encode()).hexdigest()


def member(kind, block, content_type=None, name="<urn:uuid:1>", length=None, more=()):
    head = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: {name}", f"Content-Length: {len(block) if length is None else length}", *more]
    if content_type:
        head.append(f"Content-Type: {content_type}")
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


HTTP = b"HTTP/1.1 200 OK\r\nContent-Length: %s\r\nX: y\r\n\r\n"


def test_records_of_all_kinds_and_heads(spark, tmp_path):
    get = b"GET / HTTP/1.1\r\nHost: a\r\n\r\nbody"
    records = [
        (member("warcinfo", b"software: x\r\n\r\nformat: y", "application/warc-fields"), b"software: x\r\n\r\nformat: y", None),
        (member("resource", b"\x00\x01 plain\r\n\r\nbytes", "image/png"), b"\x00\x01 plain\r\n\r\nbytes", None),
        (member("metadata", b"a: b\r\n\r\n", None), b"a: b\r\n\r\n", None),
        (member("conversion", b"", "text/plain"), b"", None),
        (member("request", get, "application/http; msgtype=request"), b"body", None),
        (member("response", HTTP % b"3" + b"abc", "application/http; msgtype=response", "<urn:page:7>"), b"abc", 7),
        (member("response", b"1 2 3\r\n\r\n4", "text/dns"), b"1 2 3\r\n\r\n4", None),
        (member("response", b"HTTP/1.1 204 No Content\r\n", "application/http"), b"", None),
        (member("revisit", HTTP % b"abc", "application/http", "<urn:page:8>"), None, 8),
        (member("revisit", HTTP % b"-5", "application/http", "<urn:page:-9>"), None, -9),
        (member("revisit", HTTP % b"12", "application/http", "<urn:page:123456789012345678901234567890>"), None, None),
        (member("revisit", b"", None, "<urn:uuid:5>", more=["WARC-Refers-To: <urn:page:99999999999999999999>"]), None, None),
    ]
    bad = [member("resource", b"abc", length="-1"), member("resource", b"abc", length="x"), member("resource", b"abc", length="99")]
    whole = b"".join(r[0] + (bad[i % 3] if i % 2 else b"") for i, r in enumerate(records))
    (tmp_path / "a.warc.gz").write_bytes(whole)
    for size in (97, 1000, 1 << 20):
        got = sorted(warc.read_warc(spark, str(tmp_path), split_bytes=size).collect(), key=lambda r: r.offset)
        assert [None if r.payload is None else bytes(r.payload) for r in got] == [r[1] for r in records]
        assert [r.page_id for r in got] == [r[2] for r in records]
        assert [r.payload_bytes for r in got] == [None if p is None else len(p) for _, p, _ in records[:8]] + [None, None, 12, None]
        assert {r.refers_to for r in got} == {None}
