"""Token counts of a word-end BPE vocabulary by rank-synchronous merging of ragged arrays.

Pre-tokens of a batch lie end to end in one array of symbols. In each round every sequence merges all places of its own
lowest-ranked pair at once, left to right; a sequence without a pair in the table is done and its symbols are counted.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CACHE_WORDS = 1_000_000
ROUND_SYMBOLS = 1 << 20
LIMIT = 2048
SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself, or the next free one from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(free)) for b in range(256)]


class WordCounter:
    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, (splitter, level) = spec["model"], spec["pre_tokenizer"]["pretokenizers"]
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        if model["type"] != "BPE" or splitter["behavior"] != "Removed" or not splitter["invert"] or level["type"] != "ByteLevel" or kinds != ["NFC", "Replace", "Lowercase"]:
            raise ValueError("only lower-casing word-end BPE vocabularies are supported")
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        self.words = regex.compile(splitter["pattern"]["Regex"])
        self.special = regex.compile("|".join(regex.escape(t["content"]) for t in spec["added_tokens"]))
        symbols = byte_symbols()
        self.inner = np.array([vocab[s] for s in symbols], np.int64)
        self.last = np.array([vocab[s + end] for s in symbols], np.int64)
        self.base = max(vocab.values()) + 1
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([vocab[a] * self.base + vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made[order]
        self.none = len(pairs)
        self.seen: dict[str, int] = {}

    def merged_counts(self, words: list[str]) -> np.ndarray:
        """The number of symbols that each word ends up with."""
        out = np.zeros(len(words), np.int64)
        raw = [w.encode() for w in words]
        lengths = np.array([len(r) for r in raw], np.int64)
        data = np.frombuffer(b"".join(raw), np.uint8)
        ends = np.cumsum(lengths)
        symbols = self.inner[data]
        symbols[ends - 1] = self.last[data[ends - 1]]
        owner = np.repeat(np.arange(len(words)), lengths)
        while len(symbols):
            # the rank of the pair that starts at each place; none at the end of a word
            key = symbols[:-1] * self.base + symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, key), self.none - 1)
            good = (self.keys[at] == key) & (owner[:-1] == owner[1:])
            rank = np.append(np.where(good, self.ranks[at], self.none), self.none)
            starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            sizes = np.diff(np.append(starts, len(owner)))
            low = np.minimum.reduceat(rank, starts)
            done = low == self.none
            out[owner[starts[done]]] = sizes[done]
            active = np.repeat(~done, sizes)
            hit = (rank == np.repeat(low, sizes)) & active
            # of places in a row (a pair of equal symbols) every second one is merged, from the left
            where = np.flatnonzero(hit)
            begins = np.append(True, np.diff(where) != 1) if len(where) else np.zeros(0, bool)
            run = where[begins][np.cumsum(begins) - 1] if len(where) else where
            where = where[(where - run) % 2 == 0]
            symbols = symbols.copy()
            if len(where):
                symbols[where] = self.made[at[where]]
                active[where + 1] = False
            symbols, owner = symbols[active], owner[active]
        return out

    def learn(self, words: list[str]) -> None:
        if len(self.seen) + len(words) > CACHE_WORDS:
            self.seen.clear()
        start = held = 0
        for i, w in enumerate(words):
            held += len(w) * 2
            if held > ROUND_SYMBOLS or i == len(words) - 1:
                part = words[start : i + 1]
                self.seen.update(zip(part, self.merged_counts(part).tolist(), strict=True))
                start, held = i + 1, 0

    def pretokens(self, text: str) -> tuple[list[str], int]:
        """The pre-tokens of a text, and the number of special strings in it."""
        parts = self.special.split(text) if "<|" in text else [text]
        out: list[str] = []
        for part in parts:
            if not part.isascii():
                part = unicodedata.normalize("NFC", part).replace("Σ", "σ")  # no final sigma: characters are lower-cased one by one
            out += self.words.findall(part.lower())
        return out, len(parts) - 1

    def counts(self, texts: list[str]) -> list[int]:
        split = [self.pretokens(t) for t in texts]
        seen = self.seen
        if new := list({w for words, _ in split for w in words if w not in seen}):
            self.learn(new)
            if len(self.seen) < len(new):
                raise RuntimeError("words were lost")
        out = []
        for words, special in split:
            try:
                out.append(sum(map(seen.__getitem__, words)) + special)
            except KeyError:  # the table of words was emptied meanwhile
                self.learn(list({w for w in words if w not in seen}))
                out.append(sum(seen[w] if w in seen else int(self.merged_counts([w])[0]) for w in words) + special)
        return out


@lru_cache(maxsize=2)
def counter(path: str) -> WordCounter:
    return WordCounter(path)


def token_counts(docs: DataFrame, vocabulary: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row's whole text.

    Null and empty texts have no bytes and no tokens. A row is counted for itself, so repeated rows have repeated
    results, and null ids stay null. An empty table has no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [x or "" for x in part.column(1).to_pylist()]
                n = own.counts(texts)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, SCHEMA)
