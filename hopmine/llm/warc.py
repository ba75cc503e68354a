"""WARC archives: a writer with revisit records, and a splittable reader.

Writing: one gzip member per record, so a file can be cut anywhere. Reading: a task takes a byte range of a file, looks
for the gzip magic in it, accepts a candidate only if it is a complete member, by its own checksum, that decodes to a
WARC header, and owns the records that start inside its range. The records of a file are those that a reader meets who
starts at its first byte and, after each, goes on at the next candidate; so a member that lies stored inside another one
is no record, and what follows a member doesn't matter. A first pass over the ranges finds the members that reach over
a range's end (a few numbers a range), which tell each range where its first record may start.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import MAX_LONG, cut, fair_share, hot_join, shared_folder

MAGIC = b"\x1f\x8b\x08"
BLOCK = 1 << 20
SPLIT_BYTES = 4 << 20
MIN_REVISIT_BYTES = 100
RECORD = "page_id long, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long, file string, offset long"


def open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


# -- writing -----------------------------------------------------------------------------------------------------------


def _record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    kind = "revisit" if revisit else "response"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date: 2024-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=';/?:@&=+$,#%[]!~*().-_' + chr(39))}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def plan_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """page_id, url, payload, digest, refers_to, revisit for every row.

    Among rows with equal payloads of at least 100 bytes those with the smallest page_id are responses and the others
    revisit it. Null payloads are empty. A null page_id counts as the largest. Repeated rows stay repeated.
    """
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.col(url_col).cast("string").alias("url"),
        F.encode(F.coalesce(F.col(payload_col).cast("string"), F.lit("")), "UTF-8").alias("payload"),
    ).withColumn("digest", F.sha2("payload", 256))
    shared = (
        rows.filter(F.octet_length("payload") >= MIN_REVISIT_BYTES)
        .groupBy("digest")
        .agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
        .filter("n > 1 and first_id is not null")
    )
    share = fair_share(pages.sparkSession, pages.count())
    joined = hot_join(rows, shared, "digest", "n", share, F.struct("page_id", "url", F.monotonically_increasing_id()), "left")
    revisit = F.coalesce(F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id")), F.lit(False))
    return joined.select("page_id", "url", "payload", "digest", F.when(revisit, F.col("first_id")).alias("refers_to"), revisit.alias("revisit"))


def write_warc(records: DataFrame, folder: str) -> DataFrame:
    """One file per task in folder, which all executors share; (file, length, records) of the files.

    A task attempt writes under a name of its own and renames it when done, so repeated attempts leave one file each in
    the table that this returns; only listed files belong to the archive.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = open_folder(folder)
        task = TaskContext.get()
        name = f"part-{task.partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
        out, n = None, 0
        for batch in batches:
            for r in batch.to_pylist():
                if out is None:
                    store.create_dir(path, recursive=True)
                    out = store.open_output_stream(f"{path}/{name}.tmp", compression=None)
                out.write(_record(r["page_id"], r["url"], r["payload"], r["digest"], r["refers_to"], r["revisit"]))
                n += 1
        if out is not None:
            length = out.tell()
            out.close()
            store.move(f"{path}/{name}.tmp", f"{path}/{name}")
            yield pa.RecordBatch.from_pydict({"file": [name], "length": pa.array([length], pa.int64()), "records": pa.array([n], pa.int64())})

    return cut(records.mapInArrow(write, "file string, length long, records long"))


# -- reading -----------------------------------------------------------------------------------------------------------


class _Window:
    """Bytes of a file from a position on, read in blocks and dropped once passed."""

    def __init__(self, file: pa.NativeFile, size: int, at: int):
        self.file, self.size, self.base, self.data = file, size, at, bytearray()

    def ensure(self, upto: int) -> None:
        while self.base + len(self.data) < min(upto, self.size):
            self.file.seek(self.base + len(self.data))
            got = self.file.read(min(BLOCK, self.size - self.base - len(self.data)))
            if not got:
                self.size = self.base + len(self.data)
            self.data += got

    def drop(self, before: int) -> None:
        if before - self.base > BLOCK:
            del self.data[: before - self.base]
            self.base = before

    def get(self, at: int, n: int) -> bytes:
        self.ensure(at + n)
        return bytes(self.data[at - self.base : at - self.base + n])

    def find(self, what: bytes, at: int, end: int) -> int:
        """The first place of what that starts in [at, end), or -1."""
        while at < end:
            self.ensure(min(at + BLOCK, end) + len(what))
            stop = min(at + BLOCK, end)
            if (k := self.data.find(what, at - self.base, stop - self.base + len(what) - 1)) >= 0:
                return self.base + k
            at = stop
            self.drop(at)
        return -1


def _member(window: _Window, at: int) -> tuple[bytes, int] | None:
    """The content and end of the complete gzip member at a place, if it begins as a WARC record."""
    unpacker, out, pos, begun = zlib.decompressobj(31), [], at, False
    try:
        while not unpacker.eof:
            # a candidate's first bytes tell most others off
            piece = window.get(pos, 1 << 16 if begun else 1 << 10)
            if not piece:
                return None
            got = unpacker.decompress(piece)
            if got and not out and not got.startswith(b"WARC/"[: len(got)]):
                return None
            if got:
                out.append(got)
                begun = True
            pos += len(piece)
    except zlib.error:
        return None
    content = b"".join(out)
    return (content, pos - len(unpacker.unused_data)) if content.startswith(b"WARC/") else None


def _header(content: bytes) -> tuple[dict[str, str], bytes] | None:
    head, sep, rest = content.partition(b"\r\n\r\n")
    if not sep:
        return None
    fields = {}
    for line in head.split(b"\r\n")[1:]:
        k, colon, v = line.partition(b":")
        if not colon:
            return None
        fields[k.decode("latin-1").strip().lower()] = v.decode("utf-8", "replace").strip()
    n = _number(fields.get("content-length", ""))
    return (fields, rest[:n]) if n is not None and len(rest) >= n and "warc-type" in fields else None


def _number(text: str) -> int | None:
    """A length as headers write it; null for whatever else stands there, or is too large for a long."""
    text = text.strip()
    return int(text) if text.isascii() and text.isdigit() and len(text) < 20 and int(text) <= MAX_LONG else None


def _body(fields: dict[str, str], block: bytes) -> tuple[bytes | None, int | None]:
    """(payload, its length) of a record: the block behind the HTTP head where there is one, else all of it.

    Only requests, responses and revisits of application/http have an HTTP head. A revisit has no payload; its length is
    the one that its HTTP head tells, null if that is unreadable or not there.
    """
    kind = fields["warc-type"].lower()
    http = kind in ("request", "response", "revisit") and fields.get("content-type", "").lower().startswith("application/http")
    head, _, rest = block.partition(b"\r\n\r\n") if http else (b"", b"", block)
    if kind != "revisit":
        return rest, len(rest)
    told = [x.partition(b":")[2].decode("latin-1") for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")]
    return None, _number(told[0]) if told else None


def candidates_in(file: pa.NativeFile, size: int, start: int, end: int, chained: bool) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, end, header fields, block) of the candidates that start in [start, end): all, or if chained those that begin after the one before has ended."""
    window, at = _Window(file, size, start), start
    while at < end:
        if (at := window.find(MAGIC, at, end)) < 0:
            return
        window.drop(at)
        if (found := _member(window, at)) and (parsed := _header(found[0])):
            yield at, found[1], *parsed
            at = found[1] if chained else at + 1
        else:
            at += 1


def _page(urn: str) -> int | None:
    """The page id in the names that this module's writer gives; null for all other names."""
    name = urn.strip("<>").strip()
    digits = name.removeprefix("urn:page:")
    number = _number(digits.removeprefix("-")) if digits != name else None
    return number if number is None or not digits.startswith("-") else -number


def _first_starts(splits: DataFrame, folder: str, split_bytes: int) -> DataFrame:
    """splits (file, length, start) with `first`: where the last record that starts before the range ends, if it is inside the range or behind it.

    Of the candidates that reach over the end of their range, those are records that start at or after the end of the
    record before; so one running maximum over a file's few such members decides.
    """

    def reach(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, path = open_folder(folder)
        for frame in frames:
            rows = []
            for name, length, start in zip(frame["file"], frame["length"], frame["start"], strict=True):
                stop = min(int(start) + split_bytes, int(length))
                if stop == length:
                    continue
                with store.open_input_file(f"{path}/{name}") as file:
                    rows += [(name, a, b) for a, b, _, _ in candidates_in(file, int(length), int(start), stop, False) if b > stop]
            yield pd.DataFrame(rows, columns=["file", "a", "b"]).astype({"a": "int64", "b": "int64"})

    over = splits.mapInPandas(reach, "file string, a long, b long")
    # one row a range at most, but for members that lie inside others: (reached so far, those that are records)
    state = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<a:bigint,b:bigint>>").alias("kept"))
    fold = F.aggregate("all", state, lambda s, x: F.when(x["a"] >= s["at"], F.struct(x["b"].alias("at"), F.array_append(s["kept"], x).alias("kept"))).otherwise(s), lambda s: s["kept"])
    kept = over.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("all")).select("file", F.explode(fold).alias("k")).select("file", "k.a", "k.b")
    # the ranges that a kept member reaches: from the one after its own to the one where it ends
    grid = lambda c: F.floor(c / split_bytes).cast("long") * split_bytes
    reached = kept.select("file", F.explode(F.sequence(grid(F.col("a")) + split_bytes, grid(F.col("b") - 1), F.lit(split_bytes).cast("long"))).alias("start"), F.col("b").alias("first"))
    return splits.join(reached, ["file", "start"], "left").withColumn("first", F.greatest("start", F.coalesce("first", F.lit(0))))


def read_warc(spark: SparkSession, folder: str, files: DataFrame | None = None, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """The records of the archives in folder, or of the listed (file, length) in it; the same ones for every split size.

    payload is the HTTP body of HTTP records and the whole block of all others, null for revisit records; payload_digest is
    computed from the payload where there is one. page_id and refers_to are null for names that this module didn't give,
    payload_bytes for revisits whose HTTP head has no readable length. Records without a readable Content-Length, damaged members and bytes between members are passed over. An archive without records has no rows.
    """
    if files is None:
        names = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder)
        files = names.select(F.element_at(F.split("path", "/"), -1).alias("file"), "length")
    splits = files.filter("length > 0").select(
        "file", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(split_bytes).cast("long"))).alias("start")
    )
    parts = min(max(1, splits.count()), 100_000)
    splits = cut(_first_starts(splits.repartition(parts), folder, split_bytes))

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, path = open_folder(folder)
        for frame in frames:
            for name, length, start, first in zip(frame["file"], frame["length"], frame["start"], frame["first"], strict=True):
                rows, held, stop = [], 0, min(int(start) + split_bytes, int(length))
                if first >= stop:
                    continue
                with store.open_input_file(f"{path}/{name}") as file:
                    for offset, _, h, block in candidates_in(file, int(length), int(first), stop, True):
                        payload, size = _body(h, block)
                        digest = h.get("warc-payload-digest", "").partition(":")[2] if payload is None else hashlib.sha256(payload).hexdigest()
                        rows.append((_page(h.get("warc-record-id", "")), h.get("warc-target-uri"), h["warc-type"], payload, size, digest, _page(h.get("warc-refers-to", "")), name, offset))
                        held += len(payload or b"")
                        if held > BLOCK * 4:
                            yield _frame(rows)
                            rows, held = [], 0
                if rows:
                    yield _frame(rows)

    return splits.select("file", "length", "start", "first").repartition(parts).mapInPandas(read, RECORD)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=[c.split()[0] for c in RECORD.split(", ")])
    for c in ("page_id", "payload_bytes", "refers_to"):
        out[c] = out[c].astype("Int64")
    return out


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """All rows written as WARC records into the shared folder and read back; see plan_records for the choice of revisits."""
    folder = f"{shared_folder(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    files = write_warc(plan_records(pages), folder)
    return read_warc(spark, folder, files)
