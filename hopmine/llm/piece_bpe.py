"""SentencePiece encoding and decoding for merge-type vocabularies.

A text is normalised (spaces become ▁, one is put in front) and cut into units that no piece of the vocabulary can
cross. Each distinct unit is encoded by an agenda of adjacent symbol pairs: the pair whose merged piece scores best, the
leftmost of equals, is merged first. Each document's ids are decoded, all of them, from the pieces' bytes. New units of
an Arrow batch are checked against the sentencepiece library, ids and decoded text both; the library's answer is never
taken in place of the own one: n_mismatch counts the units of a document on which the two disagree.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
LETTERS = "A-Za-zÀ-ÖØ-öø-ʯ"
CACHE_UNITS = 250_000
CUT = "\x1f"
PART_ROWS = 500
SHORT = 48
NONE = 1 << 30
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_mismatch long"


class PieceCoder:
    """Encoder and decoder of one model file; also holds the units seen so far, a bounded number of them."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.library.vocab_size()
        self.pieces = [self.library.id_to_piece(i) for i in range(n)]
        self.bytes = {i: int(self.pieces[i][3:5], 16) for i in range(n) if self.library.is_byte(i)}
        self.byte_ids = {b: i for i, b in self.bytes.items()}
        special = {i for i in range(n) if self.library.is_control(i) or self.library.is_unknown(i)}
        self.ids = {p: i for i, p in enumerate(self.pieces) if i not in special and i not in self.bytes}
        self.scores = {p: self.library.get_score(i) for p, i in self.ids.items()}
        if len(self.byte_ids) != 256 or self.library.normalize("  a ﬁ ") != f"{MARK * 3}a{MARK}ﬁ{MARK}":
            raise ValueError("only vocabularies with byte fallback and without text normalisation are supported")
        # cuts that no piece crosses: before marks, around line feeds, and between a letter and a sign that follows no letter in any piece
        joined = {pair for p in self.ids for pair in zip(p, p[1:], strict=False)}
        line = "\n" * (not any("\n" in pair for pair in joined))
        letter = re.compile(f"[{LETTERS}]")
        signs = "".join(c for c in ".,;:!?" if not any(y == c and letter.match(x) for x, y in joined))
        crossing = any(y == MARK != x for x, y in joined)
        whole = f"{line}|" * bool(line) + (f"{MARK}*[{LETTERS}]+(?=[{signs}])|" if signs else "") + f"{MARK}*[^{MARK}{line}]+|{MARK}+"
        self.units = re.compile(r"(?s).+" if crossing else whole)
        self.cuts, self.line, self.signs = not crossing, line, signs
        self._tables()
        self.ids_of: dict[str, str] = {}
        self.wrong: set[str] = set()
        # for each id the bytes that it decodes to
        raw = [bytes([self.bytes[i]]) if i in self.bytes else b"" if i in special else p.replace(MARK, " ").encode() for i, p in enumerate(self.pieces)]
        self.raw = pa.array(raw, pa.binary())
        # what goes before a unit without a mark, so that the library sees it where it stands in texts
        self.before = self.line or "a"
        self.n_before = len(self.library.encode(self.before))
        # the library's text of every piece, after a first one that keeps its mark
        plain = [i for i in range(n) if i not in special and i not in self.bytes]
        lead = self.ids[MARK]
        for i, text in zip(plain, self.library.decode([[lead, lead, i] for i in plain], num_threads=1), strict=True):
            if text != " " + self.read[i]:
                raise ValueError(f"piece {i} decodes to {text!r}")

    def _tables(self) -> None:
        """Arrays for the agenda of many units at once: symbols are piece ids, then characters that are no pieces."""
        self.symbols = dict(self.ids)
        self.written = [str(i) for i in range(len(self.pieces))]
        self.read = [p.replace(MARK, " ") for p in self.pieces]
        self.spelled: dict[int, list[int]] = {}
        best = {x: i for i, x in enumerate(sorted(set(self.scores.values()), reverse=True))}
        pairs = []
        for p, i in self.ids.items():
            for k in range(1, len(p)):
                if (k == 1 or p[:k] in self.ids) and (k == len(p) - 1 or p[k:] in self.ids):
                    pairs.append((self.symbol(p[:k]) << 32 | self.symbol(p[k:]), best[self.scores[p]], i))
        pairs.sort()
        self.of_point = np.full(0x110000, -1, np.int32)
        for c, i in self.symbols.items():
            if len(c) == 1:
                self.of_point[ord(c)] = i
        self.keys, self.ranks, self.made = (np.array(x, np.int64) for x in zip(*pairs, strict=True))

    def symbol(self, char: str) -> int:
        """The symbol of a piece or of a character; one that is no piece is spelled by its bytes' ids in the end."""
        if (i := self.symbols.get(char)) is None:
            i = self.symbols[char] = len(self.written)
            self.written.append("")
            self.spelled[i] = [self.byte_ids[b] for b in char.encode()]
        return i

    def normalise(self, text: str) -> str:
        return MARK + text.replace(" ", MARK) if text else ""

    def encode_unit(self, unit: str) -> list[int]:
        """The agenda: adjacent pairs by (score of the merged piece descending, place), stale entries skipped."""
        symbols, scores = list(unit), self.scores
        n = len(symbols)
        if unit in scores and n == 1:
            return [self.ids[unit]]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = []
        for i in range(n - 1):
            merged = symbols[i] + symbols[i + 1]
            if merged in scores:
                agenda.append((-scores[merged], i, merged))
        heapify(agenda)
        while agenda:
            _, i, merged = heappop(agenda)
            j = after[i] if symbols[i] else n
            if j >= n or symbols[i] + symbols[j] != merged:
                continue
            symbols[i], symbols[j] = merged, ""
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (right := merged + symbols[k]) in scores:
                    heappush(agenda, (-scores[right], i, right))
            if (h := before[i]) >= 0 and (left := symbols[h] + merged) in scores:
                heappush(agenda, (-scores[left], h, left))
        out: list[int] = []
        for s in symbols:
            if s:
                if (known := self.ids.get(s)) is not None:
                    out.append(known)
                else:
                    out += [self.byte_ids[b] for b in s.encode()]
        return out

    def decode(self, ids: pa.ListArray) -> pa.Array:
        """The texts of lists of ids; the space in front that stands for the mark which encoding puts there goes."""
        texts = pc.binary_join(pa.ListArray.from_arrays(ids.offsets, self.raw.take(ids.values)), b"")
        return pc.if_else(pc.starts_with(texts, b" "), pc.binary_replace_slice(texts, 0, 1, b""), texts)

    def _priority(self, left: np.ndarray, right: np.ndarray, same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        good = (self.keys[at] == key) & same
        return np.where(good, self.ranks[at], NONE), self.made[at]

    def encode_units(self, units: list[str]) -> list[list[int]]:
        """The final symbols of many units: in each round every unit merges the first entry of its agenda.

        An entry is (rank of the merged piece's score, place), kept for each adjacent pair; a merge renews its neighbours' entries.
        """
        if not units:
            return []
        points = np.frombuffer("".join(units).encode("utf-32-le"), np.uint32)
        sym = self.of_point[points]
        if (sym < 0).any():
            for c in np.unique(points[sym < 0]).tolist():
                self.of_point[c] = self.symbol(chr(c))
            sym = self.of_point[points]
        sym = sym.astype(np.int64)
        owner = np.repeat(np.arange(len(units)), np.fromiter(map(len, units), np.int64, len(units)))
        rank, made = np.full(len(sym), NONE), np.zeros(len(sym), np.int64)
        rank[:-1], made[:-1] = self._priority(sym[:-1], sym[1:], owner[:-1] == owner[1:])
        ended: list[tuple[np.ndarray, np.ndarray]] = []
        while len(sym):
            starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            sizes = np.diff(np.append(starts, len(sym)))
            first = np.minimum.reduceat(rank << 32 | np.arange(len(sym)), starts)
            done = first >> 32 == NONE
            over = np.repeat(done, sizes)
            ended.append((owner[over], sym[over]))
            at = first[~done] & 0xFFFFFFFF
            sym[at] = made[at]
            stay = ~over
            stay[at + 1] = False
            moved = np.cumsum(stay) - 1
            sym, owner, rank, made, at = sym[stay], owner[stay], rank[stay], made[stay], moved[at]
            for place in (at, at[at > 0] - 1):
                place = place[place < len(sym) - 1]
                rank[place], made[place] = self._priority(sym[place], sym[place + 1], owner[place] == owner[place + 1])
            rank[-1:] = NONE
        owner, sym = (np.concatenate(x) for x in zip(*ended, strict=True))
        order = np.argsort(owner, kind="stable")
        ends = np.cumsum(np.bincount(owner, minlength=len(units))).tolist()
        symbols = sym[order].tolist()
        return [symbols[x:y] for x, y in zip([0, *ends[:-1]], ends, strict=True)]

    def learn(self, units: list[str]) -> None:
        """Units encoded, checked and remembered.

        Long units take their agenda from a heap, one unit at a time. The library puts a mark in front of each text:
        units that begin with one lose it for the check, the others go behind a text whose ids are known and at whose
        end there is a cut. The library's text of the ids must be the unit's.
        """
        written, spelled, pieces = self.written, self.spelled, len(self.pieces)
        marked = [u for u in units if u[0] == MARK and u != MARK]
        other = [u for u in units if u[0] != MARK]
        for group in (marked, other, [u for u in units if u == MARK]):
            short = [u for u in group if len(u) <= SHORT] if any(len(u) > SHORT for u in group) else group
            coded = self.encode_units(short)
            if len(self.written) > pieces:
                coded = [own if max(own) < pieces else [i for x in own for i in (spelled[x] if x >= pieces else (x,))] for own in coded]
            if short is not group:
                found = dict(zip(short, coded, strict=True))
                coded = [found[u] if len(u) <= SHORT else self.encode_unit(u) for u in group]
            if group is marked:
                theirs = self.library.encode([u[1:].replace(MARK, " ") for u in group], num_threads=1) if group else []
            elif group is other:
                theirs = [x[self.n_before :] for x in self.library.encode([self.before + u.replace(MARK, " ") for u in group], num_threads=1)] if group else []
            else:
                theirs = [[self.ids[MARK]]] * len(group)
            if theirs != coded:
                self.wrong.update(u for u, x, y in zip(group, coded, theirs, strict=True) if x != y)
            self.ids_of.update(zip(group, [",".join([written[i] for i in ids]) for ids in coded], strict=True))
            if group is not marked or not group:
                continue
            texts = self.library.decode(coded, num_threads=1)
            self.wrong.update(u for u, t in zip(group, texts, strict=True) if " " + t != u.replace(MARK, " "))

    def _cut(self, texts: pa.Array) -> pa.ListArray:
        """The units of each text with spaces for marks; empty strings may stand between them."""
        full = pc.binary_join_element_wise(" ", texts, "")
        t = pc.if_else(pc.equal(texts, ""), "", full)
        t = pc.replace_substring(t, MARK, " ")
        if not self.cuts:
            return pa.ListArray.from_arrays(pa.array(np.arange(len(t) + 1), pa.int32()), t)
        t = pc.replace_substring(t, " ", CUT + " ")
        while pc.any(pc.match_substring(t, f" {CUT} ")).as_py():  # a run of spaces is not cut
            t = pc.replace_substring(t, f" {CUT} ", "  ")
        if self.line:
            t = pc.replace_substring(t, self.line, CUT + self.line + CUT)
        if self.signs:
            t = pc.replace_substring_regex(t, f"([{LETTERS}])([{self.signs}])", rf"\1{CUT}\2")
        return pc.split_pattern(t, CUT)

    def code(self, texts: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array, pa.Array]:
        """(number of ids, ids joined by commas, text that these ids decode to, number of mismatches) of each text, by the distinct units of all."""
        texts = texts.cast(pa.string()).fill_null("")
        if self.cuts and pc.any(pc.match_substring(texts, CUT)).as_py():  # texts that hold the separator are cut one by one
            cut = pa.array([self.units.findall(self.normalise(t)) for t in texts.to_pylist()], pa.list_(pa.string()))
        else:
            cut = self._cut(texts)
        coded = cut.flatten().dictionary_encode()
        units = pc.replace_substring(coded.dictionary, " ", MARK).to_pylist()
        if len(self.ids_of) > CACHE_UNITS:
            self.ids_of.clear()
        if new := [u for u in units if u and u not in self.ids_of]:
            self.learn(new)
        ids = pa.array([self.ids_of[u] if u else None for u in units], pa.string()).take(coded.indices)
        there = pc.is_valid(ids).to_numpy(zero_copy_only=False)
        places = cut.offsets.to_numpy() - cut.offsets[0].as_py()
        ends = np.concatenate([[0], np.cumsum(there)])[places]
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), ids.drop_null()), ",")
        counts, listed = _numbers(joined)
        wrong = np.zeros(len(texts), np.int64)
        if self.wrong:
            bad = np.array([u in self.wrong for u in units], np.int64)[coded.indices.to_numpy()]
            wrong = np.diff(np.concatenate([[0], np.cumsum(bad)])[places])
        return counts, joined, self.decode(listed), pa.array(wrong, pa.int64())


def _numbers(joined: pa.Array) -> tuple[pa.Array, pa.ListArray]:
    """Lists of ids out of their texts, and their lengths."""
    parts = pc.split_pattern(joined, ",")
    full = pc.not_equal(joined, "").to_numpy(zero_copy_only=False)
    counts = np.where(full, pc.list_value_length(parts).to_numpy(zero_copy_only=False), 0)
    values = pc.cast(parts.flatten().filter(pc.not_equal(parts.flatten(), "")), pa.int32())
    return pa.array(counts, pa.int64()), pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), values)


@lru_cache(maxsize=2)
def coder(path: str) -> PieceCoder:
    return PieceCoder(path)


def encode_decode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, n_mismatch of every row's whole text; null texts are empty.

    Repeated rows and rows without an id are rows of their own; an empty table has no rows. n_mismatch is the number of
    the text's units on which the sentencepiece library disagrees with the agenda or with the decoded text: 0, or the row
    is not to be trusted. model is a file that every executor can open at that path.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(model)
        for batch in batches:
            for at in range(0, batch.num_rows, PART_ROWS):
                part = batch.slice(at, PART_ROWS)
                n, ids, texts, wrong = own.code(part.column(1))
                digests = [pa.array([hashlib.sha256(x.as_buffer()).hexdigest() for x in col], pa.string()) for col in (ids, texts)]
                yield pa.RecordBatch.from_arrays([part.column(0), n, *digests, wrong], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_mismatch"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, SCHEMA)


def token_ids(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, decoded) of every row's whole text: its ids and the text that they decode to.

    Null and empty texts have no ids. Repeated rows repeat their result, null ids stay null. An empty table has no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(model)
        for batch in batches:
            for at in range(0, batch.num_rows, PART_ROWS):
                part = batch.slice(at, PART_ROWS)
                _, joined, texts, _ = own.code(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), _numbers(joined)[1], texts.cast(pa.string())], ["doc_id", "ids", "decoded"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>, decoded string")
