"""Alignment of two tokenizers over a corpus by inverted pair bitmaps.

Each document's tokens of vocabulary A (byte-level BPE) and B (merge-type pieces with byte fallback) lie over the same
bytes. Where tokens of both end, the text is cut into groups; an A and a B token whose bytes overlap are linked. For each
pair of ids the documents that hold it linked form a bitmap over the documents of a block, and further bitmaps, its
planes, hold the binary digits of how many links more than one each of them has. Batches of documents give partial
bitmaps, which are OR-merged per block; the popcounts of a pair's bitmaps over all blocks are its document count. The
counts then go back to the blocks that asked for them, and there the postings return them to their documents.

Bitmaps are compressed like this: a list of 16-bit places while that is shorter, the plain bits else.

Both tokenizers are run on units only, stretches of a text that no token of either crosses: they begin before a space or
line feed that follows no white space. A unit's tokens, groups and links are found once and remembered.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Shelf
from .token_counts import byte_symbols

MARK = "▁"
UNITS = re.compile(r"\s*\S+(?:[^\S \n]\s*\S*)*|\s+")
CACHE_UNITS = 200_000
RUN_UNITS = 500
BATCH_BYTES = 1 << 20
BLOCK_DOCS, BLOCK_BYTES = 1 << 13, 12 << 20
PLACE_BITS = 13
DOCS = -1  # the plane number of rows that are documents
OUT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
BLOCKS = "block long, plane int, pair long, n int, bits binary, place int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
_NAMES = [c.split(" ")[0] for c in BLOCKS.split(", ")]


def _ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of each start, count of them."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + counts, counts)


class Aligner:
    """Tokens, groups and links of units, of which it remembers a bounded number."""

    def __init__(self, a_path: str, b_path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        with open(a_path, encoding="utf-8") as f:
            spec = json.load(f)
        level = spec["pre_tokenizer"]
        if spec["normalizer"] or spec["model"]["type"] != "BPE" or level["type"] != "ByteLevel" or level["add_prefix_space"] or not level["use_regex"]:
            raise ValueError("vocabulary A must be plain byte-level BPE")
        self.a, self.b = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a.encode_special_tokens = True  # their strings are text like other text
        byte = {s: i for i, s in enumerate(byte_symbols())}
        tokens = spec["model"]["vocab"]
        self.a_raw = [b""] * (max(tokens.values()) + 1)
        for token, i in tokens.items():
            self.a_raw[i] = bytes(byte[c] for c in token if c in byte)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        if any("\n" in p for p in pieces) or any(y == MARK != x for p in pieces for x, y in zip(p, p[1:], strict=False)) or self.b.normalize("  a ﬁ ") != f"{MARK * 3}a{MARK}ﬁ{MARK}":
            raise ValueError("vocabulary B must have no line feeds, no mark behind other characters, and no normalisation")
        self.b_raw = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else b"" if self.b.is_control(i) or self.b.is_unknown(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        self.digits = np.array([len(str(i)) for i in range(max(len(self.a_raw), len(self.b_raw)))], np.int64)
        self.a_len, self.b_len = (np.array([len(r) for r in raw], np.int64) for raw in (self.a_raw, self.b_raw))
        # what the library puts in front of a unit that follows a line feed
        self.before = len(self.b.encode("\n"))
        self._forget()

    def _forget(self) -> None:
        self.places: dict[str, int] = {}
        self.groups: list[str] = []
        # per unit: tokens of A and of B, groups, whether the bytes differ, where its links start, how many there are
        self.units, self.links = np.zeros((0, 6), np.int32), np.zeros(0, np.int64)

    def _encoded(self, runs: list[list[str]]) -> list[tuple[list[str], np.ndarray, np.ndarray]]:
        """(units, ids of A, ids of B) of runs of units, of which each but the last of a run ends without white space; no ids where the bytes differ."""
        texts = ["".join(units) for units in runs]
        a_ids = [np.array(e.ids, np.int64) for e in self.a.encode_batch(texts, add_special_tokens=False)]
        b_ids = [np.array(ids[self.before :], np.int64) for ids in self.b.encode(["\n" + t for t in texts], num_threads=1)]
        out = []
        for units, text, a, b in zip(runs, texts, a_ids, b_ids, strict=True):
            if b"".join(map(self.a_raw.__getitem__, a.tolist())) == text.encode() == b"".join(map(self.b_raw.__getitem__, b.tolist())):
                out.append((units, a, b))
            elif len(units) > 1:
                out += self._encoded([[u] for u in units])
            else:
                out.append((units, a[:0], b[:0]))
        return out

    def _learn(self, units: list[str]) -> None:
        # units that end in white space stand at the end of their text
        inner = [u for u in units if not u[-1].isspace()]
        encoded = self._encoded([*(inner[i : i + RUN_UNITS] for i in range(0, len(inner), RUN_UNITS)), *([u] for u in units if u[-1].isspace())])
        units = list(chain.from_iterable(e[0] for e in encoded))
        a, b = (np.concatenate([e[k] for e in encoded]) for k in (1, 2))
        sizes = np.concatenate([[len(u.encode()) for u in own] if len(x) else [0] for own, x, _ in encoded])
        unit_end = np.cumsum(sizes)
        a_end, b_end = np.cumsum(self.a_len[a]), np.cumsum(self.b_len[b])
        # all units end to end: a common end closes a group, every end of either closes the stretch of one link
        both = np.sort(np.concatenate([a_end, b_end]))
        twice = np.diff(both, append=-1) == 0
        common, every = both[twice], both[~twice]
        links = a[np.searchsorted(a_end, every)] * len(self.b_raw) + b[np.searchsorted(b_end, every)]
        n_a, n_b, n_groups, n_links = (np.diff(np.searchsorted(ends, unit_end, "right"), prepend=0) for ends in (a_end, b_end, common, every))
        # groups written out: in each its A ids, then its B ids, each with the sign behind it
        a_upto, b_upto = (np.searchsorted(ends, common, "right") for ends in (a_end, b_end))
        ids = np.empty(len(a) + len(b), np.int64)
        sign = np.full(len(ids), ord(","), np.uint8)
        a_group, b_group = np.searchsorted(common, a_end), np.searchsorted(common, b_end)
        ids[np.arange(len(a)) + np.append(0, b_upto)[a_group]] = a
        ids[np.arange(len(b)) + a_upto[b_group]] = b
        sign[a_upto + np.append(0, b_upto)[:-1] - 1] = ord("|")
        sign[a_upto + b_upto - 1] = ord(";")
        digits = self.digits[ids]
        ends = np.cumsum(digits + 1)
        text = np.empty(ends[-1] if len(ends) else 0, np.uint8)
        text[ends - 1] = sign
        at = ends - 2
        for _ in range(int(digits.max(initial=0))):
            text[at] = ord("0") + ids % 10
            ids = ids // 10
            on = ids > 0
            ids, at = ids[on], at[on] - 1
        written = text.tobytes().decode("ascii")
        tokens = np.cumsum(n_a + n_b)
        cuts = np.append(0, ends)[np.append(0, tokens)].tolist()
        self.groups += [written[i:j] for i, j in zip(cuts, cuts[1:], strict=False)]
        self.places.update(zip(units, range(len(self.places), len(self.places) + len(units)), strict=True))
        starts = len(self.links) + np.cumsum(n_links) - n_links
        self.units = np.concatenate([self.units, np.stack([n_a, n_b, n_groups, sizes == 0, starts, n_links], 1).astype(np.int32)])
        self.links = np.concatenate([self.links, links])

    def aligned(self, texts: list[str]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
        """Per text (tokens of A, of B, groups, links) and digest of the groups; per link its text's place and its pair."""
        split = [UNITS.findall(" " + t) if t else [] for t in texts]
        distinct = set(chain.from_iterable(split))
        new = distinct.difference(self.places)
        if len(self.places) + len(new) > CACHE_UNITS:
            self._forget()
            new = distinct
        if new:
            self._learn(list(new))
        listed = list(map(self.places.__getitem__, chain.from_iterable(split)))
        places = np.array(listed, np.int64)
        owner = np.repeat(np.arange(len(texts)), [len(u) for u in split])
        facts = self.units[places].astype(np.int64)
        wrong = np.bincount(owner, facts[:, 3], len(texts)) > 0
        counts = np.stack([np.bincount(owner, facts[:, c], len(texts)) for c in (0, 1, 2, 5)], 1).astype(np.int64)
        counts[wrong] = 0
        digests, at = [], 0
        for units, bad in zip(split, wrong.tolist(), strict=True):
            own = listed[at : at + len(units)]
            at += len(units)
            digests.append("" if bad or not units else hashlib.sha256("".join(map(self.groups.__getitem__, own))[:-1].encode()).hexdigest())
        kept = ~wrong[owner]
        starts, n = facts[kept, 4], facts[kept, 5]
        return counts, digests, np.repeat(owner[kept], n), self.links[_ragged(starts, n)]


@lru_cache(maxsize=2)
def aligner(a_path: str, b_path: str) -> Aligner:
    return Aligner(a_path, b_path)


def _width(n_docs: int) -> int:
    """The bytes of a plain bitmap over so many documents."""
    return (n_docs + 7) // 8


def bitmaps(pairs: np.ndarray, places: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(pairs, popcounts, compressed bitmaps) of places (sorted by pair, then place): those that are lists, then the plain ones."""
    width = _width(n_docs)
    starts = np.flatnonzero(np.diff(pairs, prepend=-1))
    n = np.diff(np.append(starts, len(pairs)))
    dense = 2 * n > width
    of = np.repeat(dense, n)
    lists = places[~of].astype("<u2")
    ends = np.append(0, np.cumsum(2 * n[~dense])).astype(np.int32)
    short = pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(lists)])
    bits = np.zeros((int(dense.sum()), width * 8), bool)
    bits[np.repeat(np.arange(len(bits)), n[dense]), places[of]] = True
    plain = pa.array([row.tobytes() for row in np.packbits(bits, axis=1)], pa.binary())
    return np.concatenate([pairs[starts][~dense], pairs[starts][dense]]), np.concatenate([n[~dense], n[dense]]), pa.concat_arrays([short, plain])


def postings(n: np.ndarray, maps: pa.Array, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """(number of the bitmap, place) of every bit that is set in bitmaps with popcounts n."""
    width = _width(n_docs)
    dense = 2 * n > width
    raw = lambda keep: b"".join(maps.filter(pa.array(keep)).to_pylist())
    lists, plain = np.frombuffer(raw(~dense), "<u2"), np.frombuffer(raw(dense), np.uint8).reshape(-1, width)
    row, place = np.nonzero(np.unpackbits(plain, axis=1))
    return np.concatenate([np.repeat(np.flatnonzero(~dense), n[~dense]), np.flatnonzero(dense)[row]]), np.concatenate([lists.astype(np.int64), place])


def _rows(count: int, /, **columns: object) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}
    out = []
    for name, kind in (c.split(" ") for c in BLOCKS.split(", ")):
        value = columns.get(name)
        out.append(pa.nulls(count, kinds[kind]) if value is None else pa.array(np.full(count, value), kinds[kind]) if isinstance(value, int) else value if isinstance(value, pa.Array) else pa.array(value, kinds[kind]))
    return pa.RecordBatch.from_arrays(out, _NAMES)


class _Block:
    """Documents that share bitmaps, as they come; `rows` are theirs and their bitmaps'."""

    def __init__(self, number: int):
        self.number, self.docs, self.held = number, 0, 0
        self.parts: list[pa.RecordBatch] = []
        self.keys: list[np.ndarray] = []
        self.times: list[np.ndarray] = []

    def add(self, own: Aligner, ids: pa.Array, texts: list[str]) -> None:
        counts, digests, owner, pairs = own.aligned(texts)
        # the batch's part of each bitmap: its places, ascending
        keys = np.sort((pairs << PLACE_BITS) | (self.docs + owner))
        first = np.flatnonzero(np.diff(keys, prepend=-1))
        keys, times = keys[first], np.diff(np.append(first, len(keys)))
        self.keys.append(keys)
        self.times.append(times)
        a, b, groups, links = counts.T
        self.parts.append(_rows(len(texts), block=self.number, plane=DOCS, place=np.arange(self.docs, self.docs + len(texts)), doc_id=ids, n_a=a, n_b=b, n_groups=groups, n_links=links, groups_sha256=digests))
        self.docs += len(texts)
        self.held += sum(map(len, texts))

    def rows(self) -> Iterator[pa.RecordBatch]:
        yield from self.parts
        # batches hold different documents, so the OR of their parts is the places of all of them
        keys, times = np.concatenate(self.keys), np.concatenate(self.times) - 1
        order = np.argsort(keys, kind="stable")
        keys, times = keys[order], times[order]
        more = int(times.max(initial=0)).bit_length()
        for plane in range(more + 1):
            # plane 0 has all documents, plane j those whose number of further links has the digit 2 ** (j - 1)
            own = keys if not plane else keys[(times >> (plane - 1)) & 1 == 1]
            pairs, n, maps = bitmaps(own >> PLACE_BITS, own & ((1 << PLACE_BITS) - 1), self.docs)
            for at in range(0, len(pairs), 1 << 16):
                part = slice(at, at + (1 << 16))
                yield _rows(len(pairs[part]), block=self.number, plane=plane, pair=pairs[part], n=n[part], bits=maps[part])


def _blocks(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Documents and bitmaps of all blocks; docs has (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(a_path, b_path)
        number = TaskContext.get().partitionId() << 32
        block = _Block(number)
        for batch in batches:
            at = 0
            sizes = [n or 0 for n in pc.binary_length(batch.column(1)).to_pylist()]
            while at < batch.num_rows:
                end, held = at, 0
                while end < batch.num_rows and (end == at or held + sizes[end] <= BATCH_BYTES) and block.docs + end - at < BLOCK_DOCS:
                    held += sizes[end]
                    end += 1
                part = batch.slice(at, end - at)
                block.add(own, part.column(0), [t or "" for t in part.column(1).to_pylist()])
                at = end
                if block.docs >= BLOCK_DOCS or block.held >= BLOCK_BYTES:
                    yield from block.rows()
                    number += 1
                    block = _Block(number)
        if block.docs:
            yield from block.rows()

    return docs.mapInArrow(run, BLOCKS)


def _returned(block: pa.Table, scores: pa.Table) -> pa.Table:
    """The documents of a block, with what the postings bring them; scores has (pair, docs, best)."""
    is_doc = pc.equal(block["plane"], DOCS)
    docs = block.filter(is_doc).sort_by("place")
    maps = block.filter(pc.invert(is_doc))
    scores = scores.sort_by("pair")
    n = maps["n"].to_numpy().astype(np.int64)
    row, place = postings(n, maps["bits"].combine_chunks(), docs.num_rows)
    plane, pair = maps["plane"].to_numpy().astype(np.int64), maps["pair"].to_numpy()
    at = np.searchsorted(scores["pair"].to_numpy(), pair)
    times = np.where(plane > 0, 1 << np.maximum(plane - 1, 0), 1)
    brought = np.zeros((2, docs.num_rows), np.int64)
    for total, worth in zip(brought, (scores["best"].to_numpy(zero_copy_only=False).astype(np.int64), scores["docs"].to_numpy()), strict=True):
        np.add.at(total, place, (times * worth[at] if len(worth) else times)[row])
    return docs.select(["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]).append_column("n_best", pa.array(brought[0])).append_column("count_sum", pa.array(brought[1])).select([c.split(" ")[0] for c in OUT.split(", ")])


def pair_counts(blocks: DataFrame, b_size: int) -> DataFrame:
    """(pair, docs, best): in how many documents a pair of ids is linked, and whether no pair of its A id is in more."""
    counts = blocks.filter("plane = 0").groupBy("pair").agg(F.sum("n").cast("long").alias("docs"))
    # one row an id of A: never more than its vocabulary has
    top = counts.groupBy(F.floor(F.col("pair") / b_size).alias("a")).agg(F.max("docs").alias("most"))
    return counts.withColumn("a", F.floor(F.col("pair") / b_size)).join(F.broadcast(top), "a").select("pair", "docs", (F.col("docs") == F.col("most")).alias("best"))


def alignment(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for every row.

    Space and text are encoded by A, the text by B, without special tokens. n_links counts pairs of tokens whose bytes
    overlap, n_best those whose pair of ids is in as many documents as any pair of its A id, and count_sum adds up, over
    the links, how many documents hold their pair. Null and empty texts, and texts whose tokens' bytes are not the text's
    (those with the character that B writes for spaces), have no tokens: zeros, and '' for the digest. Rows are documents
    of their own, whatever their ids: repeated rows count once each, null ids stay null. An empty table has no rows.
    """
    shelf = Shelf(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    blocks = shelf.keep(_blocks(rows, a_path, b_path))
    scored = pair_counts(blocks, aligner(a_path, b_path).b.vocab_size())
    asked = blocks.filter("plane = 0").select("pair", "block").join(scored, "pair")
    asked = asked.select(*[F.col(c).alias(c) for c in ("block", "pair", "docs", "best")])
    return blocks.groupBy("block").cogroup(asked.groupBy("block")).applyInArrow(_returned, OUT)
