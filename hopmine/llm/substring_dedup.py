"""Removal of passages that an earlier document has, by matching statistics over compressed full-text indexes of shards.

A window is WINDOW consecutive words of one document; a word goes if a window that covers it also starts in a document
with a smaller id. Shards are cut by content, so that a window needs to be looked for in one of them only: the window's
anchor is the smallest hash of its GRAM-word pieces, consecutive windows of a document with one anchor form a segment, and
a segment goes to the shard of its anchor. Equal windows have equal anchors. Only anchors that several ids have matter;
of equal segments one, that of the smallest id, is sent as text. An anchor that many different segments have (the edge
of a passage that is everywhere) is no anchor any more: windows of its segments go by the hash of the whole window.

Each shard builds the index of its segments (Burrows-Wheeler transform in a wavelet tree) and streams the segments
through it by backward search; where the statistics reach the threshold, the smallest document of the matching rows tells
whether the window goes. Texts are shuffled twice, those that own segments of a shared anchor and those that lose words.

Words are compared as their 64-bit hashes while segments are told apart, and as texts in the index.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Shelf, maybe_in
from .fm_index import FMIndex
from .shingles import _BYTES, _POWERS, _SPACE, _powers, mix

WINDOW, GRAM = 50, 10
SHARD_WORDS = 1_000_000
MOST_SEGMENTS = 4096
BATCH_BYTES = 1 << 20
_B1, _B2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
SEGMENT = "anchor long, d1 long, d2 long, start int, n int"
SPANS = "array<struct<start:int,n:int>>"
OUT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def _batches(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[pa.RecordBatch]:
    """The same rows, about BATCH_BYTES of text at a time."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            held = ends[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(ends, held + BATCH_BYTES, "right")))
            yield batch.slice(at, end - at)
            at = end


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash per word of all texts, and where each text's words begin (one more entry at the end)."""
    raw = [(t or "").encode() for t in texts.to_pylist()]
    data = np.frombuffer(b" ".join([*raw, b""]), np.uint8)
    ends = np.cumsum([len(r) + 1 for r in raw])
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(raw) + 1, np.int64)
    word = ~_SPACE[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    starts = np.flatnonzero(first)
    offsets = np.append(0, np.searchsorted(starts, ends))
    if not len(starts):
        return np.zeros(0, np.uint64), offsets
    tail = slice(starts[0], None)
    place = np.arange(starts[0], len(data)) - np.repeat(starts, np.diff(np.append(starts, len(data))))
    powers = _POWERS if place.max() < len(_POWERS) else _powers(int(place.max()) + 1)
    value = _BYTES[data[tail]] * powers[place]
    value[~word[tail]] = 0
    return mix(np.add.reduceat(value, starts - starts[0])), offsets


def _smallest(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each `width` values in a row."""
    reach = 1
    while reach * 2 <= width:
        x = np.minimum(x[:-reach], x[reach:])
        reach *= 2
    return x if reach == width else np.minimum(x[: len(x) - (width - reach)], x[width - reach :])


def _powers_of(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _digests(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each stretch of words."""
    out = []
    for base in (_B1, _B2):
        back = np.uint64(pow(int(base), -1, 1 << 64))
        sums = np.append(np.uint64(0), np.cumsum(hashes * _powers_of(base, len(hashes))))
        out.append(mix((sums[ends] - sums[starts]) * _powers_of(back, len(hashes) + 1)[starts] + (ends - starts).astype(np.uint64)).view(np.int64))
    return out[0], out[1]


def segments(hashes: np.ndarray, offsets: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """(document, first window, windows, anchor, two digests) of every segment; windows are numbered by their first word in the document."""
    last = np.repeat(offsets[1:], np.diff(offsets)) - window  # the last window of the document that a word is in
    n = len(hashes) - window + 1
    if n < 1:
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    grams = np.zeros(len(hashes) - gram + 1, np.uint64)
    scale = _powers_of(_B1, gram)
    for i in range(gram):
        grams += hashes[i : len(hashes) - gram + 1 + i] * scale[i]
    anchor = _smallest(mix(grams), window - gram + 1).view(np.int64)
    whole = np.arange(n) <= last[:n]
    new = whole.copy()
    new[1:] &= ~whole[:-1] | (anchor[1:] != anchor[:-1]) | (last[1:n] != last[: n - 1])
    starts = np.flatnonzero(new)
    counts = np.add.reduceat(whole, starts) if len(starts) else np.zeros(0, np.int64)
    doc = np.searchsorted(offsets, starts, "right") - 1
    d1, d2 = _digests(hashes, starts, starts + counts + window - 1)
    return doc, starts - offsets[doc], counts, anchor[starts], d1, d2


def _segmented(texts: DataFrame, window: int, gram: int) -> DataFrame:
    """The segments of (key, id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _batches(batches, 2):
            doc, start, n, anchor, d1, d2 = segments(*word_hashes(part.column(2)), window, gram)
            who = part.select(["key", "id"]).take(pa.array(doc))
            yield pa.RecordBatch.from_arrays([*who.columns, pa.array(anchor), pa.array(d1), pa.array(d2), pa.array(start, pa.int32()), pa.array(n, pa.int32())], ["key", "id", "anchor", "d1", "d2", "start", "n"])

    return texts.mapInArrow(run, f"key binary, id long, {SEGMENT}")


def _windows(asked: DataFrame, window: int) -> DataFrame:
    """The windows of the segments `spans` of (key, id, text, spans) as segments of their own, with the window's hash as their anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _batches(batches, 2):
            hashes, offsets = word_hashes(part.column(2))
            doc, start = [], []
            for i, spans in enumerate(part.column(3).to_pylist()):
                for s in spans:
                    start.append(np.arange(s["start"], s["start"] + s["n"]))
                    doc.append(np.full(s["n"], i))
            doc, start = np.concatenate(doc), np.concatenate(start)
            at = offsets[doc] + start
            d1, d2 = _digests(hashes, at, at + window)
            who = part.select(["key", "id"]).take(pa.array(doc))
            yield pa.RecordBatch.from_arrays([*who.columns, pa.array(d1), pa.array(d1), pa.array(d2), pa.array(start, pa.int32()), pa.array(np.ones(len(doc)), pa.int32())], ["key", "id", "anchor", "d1", "d2", "start", "n"])

    return asked.mapInArrow(run, f"key binary, id long, {SEGMENT}")


def _cut_out(asked: DataFrame, window: int) -> DataFrame:
    """(anchor, d1, d2, none, id, words) of the segments `spans` of (key, id, text, spans); words are joined by one space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _batches(batches, 2):
            out: dict[str, list] = {c: [] for c in ("anchor", "d1", "d2", "id", "words")}
            for i, text, spans in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                words = text.encode().split()
                for s in spans:
                    out["id"].append(i)
                    out["words"].append(b" ".join(words[s["start"] : s["start"] + s["n"] + window - 1]))
                    for c in ("anchor", "d1", "d2"):
                        out[c].append(s[c])
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)], list(out))

    return asked.mapInArrow(run, "anchor long, d1 long, d2 long, id long, words binary")


def _searched(cut_out: DataFrame, shards: int, window: int) -> DataFrame:
    """(anchor, d1, d2, flags): in which of a segment's windows, counted from its first, an id smaller than its own has that window too."""

    def search(shard: pa.Table) -> pa.Table:
        ids = shard["id"].to_pylist()
        # ids by their order in this shard, null last
        order = {i: k for k, i in enumerate(sorted({i for i in ids if i is not None}))}
        owner = np.array([order.get(i, len(order)) for i in ids])
        words = pc.split_pattern(shard["words"].combine_chunks(), b" ")
        coded = words.flatten().dictionary_encode()
        # the more often a word comes the smaller its number
        codes = coded.indices.to_numpy().astype(np.int64)
        place = np.empty(len(coded.dictionary), np.int64)
        place[np.argsort(-np.bincount(codes), kind="stable")] = np.arange(1, len(place) + 1)
        ends = words.offsets.to_numpy()
        sequences = np.split(place[codes], ends[1:-1])
        found = FMIndex(sequences, owner, window).smallest_owners(sequences)
        flags = []
        for best, own in zip(found, owner.tolist(), strict=True):
            hit = np.flatnonzero(np.diff(best < own, prepend=False, append=False)).reshape(-1, 2).tolist()
            flags.append([{"start": a, "n": b - a} for a, b in hit])
        kept = shard.select(["anchor", "d1", "d2"]).append_column("flags", pa.array(flags, pa.list_(pa.struct([("start", pa.int32()), ("n", pa.int32())]))))
        return kept.filter(pc.greater(pc.list_value_length(kept["flags"]), 0))

    shard = F.pmod(F.xxhash64("anchor"), F.lit(shards))
    return cut_out.groupBy(shard.alias("shard")).applyInArrow(search, f"anchor long, d1 long, d2 long, flags {SPANS}")


def _kept(docs: DataFrame, window: int) -> DataFrame:
    """The result of (id, text, spans); spans are the windows to remove, null for none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _batches(batches, 1):
            n_words, n_removed, digests = [], [], []
            for text, spans in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                words = (text or "").encode().split()
                n_words.append(len(words))
                if spans:
                    change = np.zeros(len(words) + 1, np.int64)
                    np.add.at(change, [s["start"] for s in spans], 1)
                    np.add.at(change, [s["start"] + s["n"] + window - 1 for s in spans], -1)
                    words = [w for w, covered in zip(words, np.cumsum(change).tolist(), strict=False) if not covered]
                n_removed.append(n_words[-1] - len(words))
                digests.append(hashlib.sha256(b" ".join(words)).hexdigest())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string())], [c.split(" ")[0] for c in OUT.split(", ")])

    return docs.mapInArrow(run, OUT)


def _before(id_: Column, other: Column) -> Column:
    """Whether an id is smaller than another; null is larger than all."""
    return F.coalesce(id_ < other, id_.isNotNull() & other.isNull())


def _asked(texts: DataFrame, spans: DataFrame) -> DataFrame:
    """(key, id, text, spans) for the keys of spans; one text a key, however many rows have it."""
    one = maybe_in(texts, spans.select("key"), "key").filter("_maybe").groupBy("key").agg(F.first("id").alias("id"), F.first("text").alias("text"))
    return one.join(spans, "key").select("key", "id", "text", "spans")


def removed_windows(docs: DataFrame, shelf: Shelf, window: int = WINDOW, gram: int = GRAM, most: int = MOST_SEGMENTS, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(key, spans) for documents (key, id, text) that lose words: the windows that a smaller id has too."""
    found = shelf.keep(_segmented(docs, window, gram))
    lowest = lambda *c: F.min(F.struct(F.col("id").isNull().alias("none"), "id", *c))
    several = lambda df, *by: df.groupBy(*by).agg(lowest().alias("lo"), F.max(F.struct(F.col("id").isNull().alias("none"), "id")).alias("hi")).filter("lo <> hi").select(*by)
    shared = shelf.keep(several(found, "anchor"))
    occurrences = maybe_in(found, shared, "anchor").filter("_maybe").drop("_maybe").join(shared, "anchor")

    def owned(rows: DataFrame) -> DataFrame:
        """One row a different segment: its windows, and the smallest id that has it, with the place there."""
        return rows.groupBy("anchor", "d1", "d2").agg(lowest("key", "start").alias("own"), F.first("n").alias("n"))

    whole = shelf.keep(owned(occurrences))
    crowded = shelf.keep(whole.groupBy("anchor").count().filter(F.col("count") > most).select("anchor"))
    parts, owners = occurrences, whole
    if crowded.limit(1).count():
        crowd = occurrences.join(crowded, "anchor", "left_semi").groupBy("key").agg(F.collect_set(F.struct("start", "n")).alias("spans"))
        singles = shelf.keep(_windows(_asked(docs, shelf.keep(crowd)), window))
        again = shelf.keep(several(singles, "anchor"))
        singles = maybe_in(singles, again, "anchor").filter("_maybe").drop("_maybe").join(again, "anchor")
        parts = occurrences.join(crowded, "anchor", "left_anti").unionByName(singles)
        owners = shelf.keep(whole.join(crowded, "anchor", "left_anti").unionByName(owned(singles)))
    places = owners.groupBy(F.col("own.key").alias("key")).agg(F.collect_list(F.struct("anchor", "d1", "d2", F.col("own.start").alias("start"), "n")).alias("spans"))
    words = owners.agg(F.coalesce(F.sum(F.col("n") + window - 1), F.lit(0))).first()[0]
    flags = shelf.keep(_searched(_cut_out(_asked(docs, shelf.keep(places)), window), max(1, math.ceil(words / shard_words)), window))
    judged = owners.select("anchor", "d1", "d2", F.col("own.id").alias("own_id")).join(flags, ["anchor", "d1", "d2"], "left")
    # a copy of a smaller id's segment goes as a whole, the segment of the smallest id where the index says so
    fate = F.when(_before(F.col("own_id"), F.col("id")), F.array(F.struct("start", "n"))).otherwise(F.transform("flags", lambda s: F.struct((s["start"] + F.col("start")).alias("start"), s["n"].alias("n"))))
    gone = parts.join(judged, ["anchor", "d1", "d2"]).select("key", F.explode(fate).alias("span"))
    out = shelf.keep(gone.groupBy("key").agg(F.collect_set("span").alias("spans")))
    shelf.drop(found, shared, whole)
    return out


def remove_repeated_passages(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, most: int = MOST_SEGMENTS, shard_words: int = SHARD_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for every row.

    Words are runs outside [\\x20\\x09-\\x0D]. Each word is removed that is covered by a window whose words also start in
    a document with a smaller id; kept words are joined by one space. A null id is larger than all others. Rows that share
    an id, or have none, are of one rank: none removes words of another, and repeated rows give repeated results. Null,
    empty and short texts lose nothing. An empty table has no rows.
    """
    shelf = Shelf(docs.sparkSession)
    id_, text = F.col(f"`{id_col}`").cast("long"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    key = F.unhex(F.md5(F.encode(F.concat(F.coalesce(id_.cast("string"), F.lit("null")), F.lit(":"), text), "UTF-8")))
    texts = docs.select(key.alias("key"), id_.alias("id"), text.alias("text"))
    gone = removed_windows(texts, shelf, window, gram, most, shard_words)
    marked = maybe_in(texts, gone, "key")
    met = marked.filter("_maybe").join(gone, "key", "left").select("id", "text", "spans")
    return _kept(marked.filter("not _maybe").select("id", "text", F.lit(None).cast(SPANS).alias("spans")).unionByName(met), window)
