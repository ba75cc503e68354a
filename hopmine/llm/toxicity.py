"""Toxicity by multiple-instance learning.

A document is a bag of sentences and is toxic if one of them is. A sentence's probability is sigmoid(bias + sum of its
words' weights) less what a sentence without evidence has, a document's is the noisy-or of its sentences', and the weights
are fitted to document labels alone, in the same form that scores: 1 - product of (1 - sigmoid(z)) / (1 - sigmoid(bias)). So
a long document of clean sentences scores 0. A word's weight is the sum over its hashed features (the word, its
beginnings and its end), so unseen forms of a known stem score too.
"""

from __future__ import annotations

import math
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 1 << 18
BIAS = -5.0
PART_ROWS = 500
PREFIXES = (3, 4, 5, 6)
SUFFIX = 4
SENTENCE_END = re.compile(r"[.!?\n]+")
WORD = re.compile(r"\w+")
THRESHOLD = 0.7
MAX_TRAIN_ROWS = 3000
MAX_TRAIN_CHARS = 20_000
EPOCHS = 100
MIN_DOCS = 6
STEEPEST = 50.0
SCHEMA = "doc_id long, held_out boolean, score double, predicted int, worst_sentence int, worst_score double"


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from. A null id counts as the text ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def word_features(word: str) -> list[int]:
    keys = ["=" + word, *["^" + word[:n] for n in PREFIXES if len(word) >= n]]
    if len(word) > SUFFIX:
        keys.append("$" + word[-SUFFIX:])
    return [zlib.crc32(k.encode()) % BUCKETS for k in keys]


def sentences(text: str) -> list[tuple[int, int]]:
    """(start, end) of the sentences, in order: what lies between runs of . ! ? and line feeds."""
    out, at = [], 0
    for m in SENTENCE_END.finditer(text):
        out.append((at, m.start()))
        at = m.end()
    out.append((at, len(text)))
    return out


def lowered(text: str) -> str:
    """The text in lower case, place by place: a letter whose lower case is longer stays as it is."""
    low = text.lower()
    return low if len(low) == len(text) else "".join([x if len(x := c.lower()) == 1 else c for c in text])


def fit(texts: list[str], labels: np.ndarray, epochs: int = EPOCHS, rate: float = 0.2, decay: float = 5e-5) -> tuple[np.ndarray, float]:
    """Feature weights and bias, by full-batch Adam on the document log loss of the noisy-or with a little L1.

    Features that few training documents have tell documents apart, not classes, and get no weight. Weights are not
    negative: words are evidence for toxicity or none, so a long clean context can't hide an offending word.
    """
    vocabulary: dict[str, int] = {}
    sent_of, word_of, doc_of = array("i"), array("i"), array("i")
    for d, text in enumerate(texts):
        low = lowered(text)
        for a, b in sentences(low):
            words = set(WORD.findall(low, a, b))
            word_of.extend([vocabulary.setdefault(w, len(vocabulary)) for w in words])
            sent_of.extend([len(doc_of)] * len(words))
            if words:
                doc_of.append(d)
    weights, bias = np.zeros(BUCKETS), BIAS
    if not doc_of or len(set(labels.tolist())) < 2:
        return weights.astype(np.float32), bias
    sent_of, word_of, doc_of = np.frombuffer(sent_of, np.int32), np.frombuffer(word_of, np.int32), np.frombuffer(doc_of, np.int32)
    feature, sizes = array("i"), array("i")
    for w in vocabulary:
        own = word_features(w)
        feature.extend(own)
        sizes.append(len(own))
    feature, sizes = np.frombuffer(feature, np.int32), np.frombuffer(sizes, np.int32)
    n_words = len(vocabulary)
    vocabulary.clear()
    feature_word = np.repeat(np.arange(n_words, dtype=np.int32), sizes)
    # documents that have each feature; a document's words lie together
    begin = np.concatenate([[0], np.cumsum(sizes)])
    have = np.zeros(BUCKETS, np.int32)
    edges = np.searchsorted(doc_of[sent_of], np.arange(len(texts) + 1))
    for x, y in zip(edges[:-1], edges[1:], strict=True):
        own = np.unique(word_of[x:y])
        if len(own):
            have[np.unique(np.concatenate([feature[begin[w] : begin[w + 1]] for w in own.tolist()]))] += 1
    common = have >= MIN_DOCS
    feature_word, feature = feature_word[common[feature]], feature[common[feature]]
    n_docs, n_sents = len(texts), len(doc_of)
    first, second = np.zeros(BUCKETS), np.zeros(BUCKETS)
    balance = np.where(labels == 1, 0.5 / max(labels.mean(), 1e-3), 0.5 / max(1 - labels.mean(), 1e-3))
    for step in range(1, epochs + 1):
        word_weight = np.bincount(feature_word, weights[feature], n_words)
        z = np.clip(bias + np.bincount(sent_of, word_weight[word_of], n_sents), -30, 30)
        p = 1 / (1 + np.exp(-z))
        # log of the product of the sentences' (1 - p) / (1 - sigmoid(bias))
        clean = np.minimum(0.0, np.bincount(doc_of, np.logaddexp(0, bias) - np.logaddexp(0, z), n_docs))
        toxic = -np.expm1(clean)
        # of the loss by z: p for clean documents, -p (1 - toxic) / toxic for toxic ones, bounded where there is no evidence yet
        grad_z = p * (balance * np.where(labels == 1, -np.minimum(np.exp(clean) / np.maximum(toxic, 1e-9), STEEPEST), 1.0))[doc_of]
        grad_word = np.bincount(word_of, grad_z[sent_of], n_words)
        grad = np.bincount(feature, grad_word[feature_word], BUCKETS) / n_docs + decay
        first = 0.9 * first + 0.1 * grad
        second = 0.99 * second + 0.01 * grad**2
        weights = np.maximum(0.0, weights - rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-7))
    return weights.astype(np.float32), bias


class Scorer:
    """Scores of texts under fitted weights; words' weights are remembered, a bounded number of them."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias
        self.leak = 1 / (1 + math.exp(-min(30.0, max(-30.0, bias))))
        self.seen: dict[str, float] = {}

    def weight(self, word: str) -> float:
        if len(self.seen) > 100_000:
            self.seen.clear()
        w = self.seen[word] = float(sum(self.weights[f] for f in word_features(word)))
        return w

    def sentence_scores(self, text: str) -> list[tuple[int, int, float]]:
        """(start, end, score) of each sentence with words, in code points of the text."""
        low, seen, out = lowered(text), self.seen, []
        for a, b in sentences(low):
            words = set(WORD.findall(low, a, b))
            if not words:
                continue
            try:
                z = self.bias + sum([seen[w] for w in words])
            except KeyError:
                z = self.bias + sum([seen[w] if w in seen else self.weight(w) for w in words])
            out.append((a, b, max(0.0, (1 / (1 + math.exp(-min(30.0, z))) - self.leak) / (1 - self.leak))))
        return out

    def score(self, text: str) -> tuple[float, int | None, float]:
        """The document's score, the number of its worst sentence and that sentence's score."""
        found = self.sentence_scores(text)
        if not found:
            return 0.0, None, 0.0
        s = np.array([x[2] for x in found])
        return max(0.0, float(-np.expm1(np.log1p(-np.minimum(s, 1 - 1e-12)).sum()))), int(s.argmax()), float(s.max())


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = MAX_TRAIN_ROWS, max_chars: int = MAX_TRAIN_CHARS
) -> tuple[np.ndarray, float]:
    """Weights and bias from at most about max_rows labelled rows outside the held-out third, of texts of up to max_chars code points.

    These two parameters bound the sample: rows are chosen by a hash of their id. Rows with a null id, a null or other
    label than 0 and 1, or a null text aren't learned from; of several texts under one id one is, and an id labelled both
    ways counts twice. Without rows of both labels all weights are 0.
    """
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).filter("id is not null and label in (0, 1)").filter(~held_out(F.col("id"))).distinct()
    n = known.count()
    share = min(1.0, max_rows / n) if n else 0.0
    known = known.filter(F.pmod(F.xxhash64("id", F.lit(17)), F.lit(1 << 50)) < F.lit(round(share * (1 << 50))))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).filter(F.char_length("text") <= max_chars)
    # known has at most about max_rows rows of two numbers
    rows = texts.join(F.broadcast(known), "id").groupBy("id", "label").agg(F.min("text").alias("text"))

    def learn(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = [f for f in frames if len(f)]
        pdf = pd.concat(found).sort_values(["id", "label", "text"]) if found else pd.DataFrame({"text": [], "label": []})
        weights, bias = fit(pdf["text"].tolist(), pdf["label"].to_numpy(np.int64))
        yield pd.DataFrame({"weights": [weights.tobytes()], "bias": [bias]})

    # the bounded sample meets in one task; the driver sees the weights only
    model = rows.repartition(1).mapInPandas(learn, "weights binary, bias double").collect()
    if not model:
        return fit([], np.zeros(0, np.int64))
    return np.frombuffer(bytes(model[0].weights), np.float32), model[0].bias


def _scored(batches: Iterator[pa.RecordBatch], text: int, raw: bytes, bias: float) -> Iterator[tuple[pa.RecordBatch, Scorer, list[str]]]:
    """(rows, scorer, texts), some rows at a time; the words that a scorer remembers go with the task."""
    own = Scorer(np.frombuffer(raw, np.float32), bias)
    for batch in batches:
        for at in range(0, batch.num_rows, PART_ROWS):
            part = batch.slice(at, PART_ROWS)
            yield part, own, [t or "" for t in part.column(text).to_pylist()]


def scores(docs: DataFrame, model: tuple[np.ndarray, float], threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted, worst_sentence, worst_score for every row's whole text.

    A text without words (null, empty) scores 0 and has no worst sentence. The input of a score is the text alone, so
    rows with one text have one score. An empty table has no rows.
    """
    raw, bias = model[0].tobytes(), model[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, own, texts in _scored(batches, 2, raw, bias):
            score, worst, high = map(list, zip(*[own.score(t) for t in texts], strict=True))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(score, pa.float64()), pa.array([int(s >= threshold) for s in score], pa.int32()), pa.array(worst, pa.int32()), pa.array(high, pa.float64())],
                ["doc_id", "held_out", "score", "predicted", "worst_sentence", "worst_score"],
            )

    ids = F.col(id_col).cast("long")
    return docs.select(ids.alias("doc_id"), held_out(ids).alias("held_out"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, SCHEMA)


def offending_sentences(docs: DataFrame, model: tuple[np.ndarray, float], threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, end, score, sentence) of every sentence that alone reaches threshold; places in code points of the text.

    Null and empty texts have no sentences. Rows are read one by one: repeated rows repeat their sentences, null ids stay
    null. An empty table has no rows.
    """
    raw, bias = model[0].tobytes(), model[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, own, texts in _scored(batches, 1, raw, bias):
            rows = [(i, a, b, s, t[a:b]) for i, t in zip(part.column(0).to_pylist(), texts, strict=True) for a, b, s in own.sentence_scores(t) if s >= threshold]
            cols = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.string()), strict=True)], ["doc_id", "start", "end", "score", "sentence"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, start int, end int, score double, sentence string")


def drop_toxic(docs: DataFrame, model: tuple[np.ndarray, float], threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of docs that score below threshold, with all their columns, whatever their names.

    Null and empty texts, and those without words, score 0 and stay. Only the text decides, so rows that share it stay or
    go together, with or without an id. An empty table stays empty.
    """
    raw, bias = model[0].tobytes(), model[1]
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, own, texts in _scored(batches, place, raw, bias):
            yield part.filter(pa.array([own.score(t)[0] < threshold for t in texts], pa.bool_()))

    # columns go by number meanwhile: their names may hold dots
    numbered = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    return numbered.mapInArrow(run, numbered.schema).toDF(*docs.columns)


def train_from(spark: SparkSession, sf_dir: str) -> tuple[np.ndarray, float]:
    return train(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
