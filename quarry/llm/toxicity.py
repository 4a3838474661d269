"""Toxicity by multiple-instance learning: sentences are instances, documents are bags.

A sentence with evidence scores p = sigmoid(w.x + b) over its words and word beginnings; a document scores the leaky
noisy-or 1 - exp(-leak) * prod(1 - p). The weights are trained from document labels alone by the noisy-or's likelihood,
and afterwards tell which sentences offend.

Training takes at most ``max_docs`` labelled documents of the training fold (the smallest by a hash of the id), so what
reaches the driver is bounded; scoring covers every row and every whole text.

Defined results: null or empty text scores the leak alone and has no sentence; a null doc_id is scored and not held
out; repeated rows are scored each; an empty table gives an empty result; further columns are ignored; without labels
of both classes every score is the share of toxic labels (0 without any).
"""

from __future__ import annotations

import json
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import UNSPACED, bounded_batches, char_class, in_fold, map_batches, table, written

SENTENCE = re.compile(f"[^.!?\n{char_class('61f-61f 964-964 3002-3002 ff01-ff01 ff1f-ff1f')}]+")
WORD = re.compile(r"\w+")
_RUN = re.compile(f"{UNSPACED.pattern}+|[^{UNSPACED.pattern[1:-1]}]+")
#: Lengths of word beginnings that are features beside the whole word.
BEGINNINGS = (3, 4, 5, 6)
#: Words remembered by a Python worker before it starts anew.
_REMEMBERED = 200_000


def words_of(text: str) -> list[str]:
    """Words in lower case. In scripts that write no spaces between words each two neighbouring characters are one."""
    found = WORD.findall(text.lower())
    if text.isascii() or not UNSPACED.search(text):
        return found
    out = []
    for run in (r for w in found for r in _RUN.findall(w)):
        out += [run[i : i + 2] for i in range(max(1, len(run) - 1))] if UNSPACED.match(run) else [run]
    return out


def word_features(word: str) -> list[str]:
    """The whole word and its beginnings; very long words count by their beginnings only."""
    out = [word[:k] + "*" for k in BEGINNINGS if len(word) > k]
    return [word, *out] if len(word) <= 40 else out


class Reader:
    """Turns sentences into sorted ids of the features of a fixed vocabulary."""

    def __init__(self, vocabulary: dict[str, int]):
        self.vocabulary, self.known = vocabulary, {}

    def word(self, word: str) -> tuple[int, ...]:
        if len(self.known) > _REMEMBERED:
            self.known.clear()
        got = tuple(self.vocabulary[f] for f in word_features(word) if f in self.vocabulary)
        if len(word) <= 40:
            self.known[word] = got
        return got

    def sentences(self, text: str):
        """(start, end, ids) of each sentence with evidence, and the number of all sentences last."""
        known, n = self.known, 0
        for m in SENTENCE.finditer(text):
            n += 1
            ids: set[int] = set()
            for w in words_of(m.group()):
                got = known.get(w)
                if got is None:
                    got = self.word(w)
                if got:
                    ids.update(got)
            if ids:
                yield m.start(), m.end(), sorted(ids)
        yield n


def labelled_sample(docs: DataFrame, labels: DataFrame, max_docs: int) -> DataFrame:
    """doc_id, text, toxic of at most max_docs labelled documents outside the held-out fold."""
    chosen = (
        labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~in_fold("doc_id", 5, 0))
        .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs)
    )
    # At most max_docs rows of 12 bytes: a proven size.
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")


def fit(docs: DataFrame, labels: DataFrame, max_docs: int = 12_000, max_features: int = 6_000, rounds: int = 300) -> dict:
    """Train the model: {"vocabulary": [...], "weights": [...], "bias": b, "leak": l}."""
    bounded_batches(docs.sparkSession)
    sample = written(labelled_sample(docs, labels, max_docs), "toxicity-sample")
    n, n_toxic = sample.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if n == 0 or n_toxic in (0, n):
        return {"vocabulary": [], "weights": [], "bias": 0.0, "leak": 40.0 if n and n_toxic else 0.0}

    def count(batches):
        seen: tuple[Counter, Counter] = Counter(), Counter()
        for b in batches:
            for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                seen[toxic].update({f for w in set(words_of(text or "")) for f in word_features(w)})
        names = list(seen[0].keys() | seen[1].keys())
        for i in range(0, len(names), 50_000):
            part = names[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), *(pa.array([c[f] for f in part], pa.int64()) for c in seen)], ["f", "clean", "toxic"])

    counts = sample.select("text", F.when(F.col("toxic") > 0, 1).otherwise(0).alias("toxic")).mapInArrow(count, "f string, clean long, toxic long")
    odds = F.log((F.col("toxic") + 0.5) / n_toxic) - F.log((F.col("clean") + 0.5) / (n - n_toxic))
    top = (
        counts.groupBy("f").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).filter("toxic >= 3")
        .withColumn("odds", odds).filter("odds > 0.7").orderBy((F.col("odds") * F.col("toxic")).desc(), "f").limit(max_features).collect()
    )
    vocabulary = {r.f: i for i, r in enumerate(top)}

    def read(batches):
        reader = Reader(vocabulary)
        for b in batches:
            bags = [json.dumps([s[2] for s in list(reader.sentences(t or ""))[:-1]]) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(bags, pa.string())], ["toxic", "bag"])

    rows = sample.orderBy("doc_id").select("text", "toxic").mapInArrow(read, "toxic int, bag string").collect()
    y = np.array([r.toxic > 0 for r in rows], float)
    bags = [json.loads(r.bag) for r in rows]
    return {"vocabulary": list(vocabulary), **train(bags, y, np.array([r.odds for r in top]), rounds)}


def train(bags: list[list[list[int]]], y: np.ndarray, odds: np.ndarray, rounds: int = 300) -> dict:
    """Noisy-or weights from bags of instances (lists of feature ids) and bag labels, by Adam on the likelihood."""
    owner = np.array([d for d, bag in enumerate(bags) for _ in bag], np.int64)
    sizes = np.array([len(s) for bag in bags for s in bag], np.int64)
    feature = np.array([f for bag in bags for s in bag for f in s], np.int64)
    instance = np.repeat(np.arange(len(sizes)), sizes)
    k = len(odds)
    theta = np.concatenate([np.minimum(odds, 4) / 2, [-5.0, np.log(np.expm1(max(1e-3, -np.log1p(-min(0.2, y.mean())) / 4)))]])
    m, v = np.zeros(k + 2), np.zeros(k + 2)
    for step in range(1, rounds + 1):
        z = np.bincount(instance, theta[feature], len(sizes)) + theta[k]
        total = np.bincount(owner, np.logaddexp(0, z), len(y)) + np.logaddexp(0, theta[k + 1])
        slope = (1 - y) - y / np.expm1(np.clip(total, 1e-9, 700))
        by_instance = slope[owner] / (1 + np.exp(-z))
        grad = np.concatenate([np.bincount(feature, by_instance[instance], k) + 0.05 * theta[:k], [by_instance.sum(), (slope / (1 + np.exp(-theta[k + 1]))).sum()]]) / len(y)
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta -= 0.08 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    return {"weights": theta[:k].tolist(), "bias": float(theta[k]), "leak": float(np.logaddexp(0, theta[k + 1]))}


class Scorer:
    """Scores whole texts with a fitted model, and locates sentences."""

    def __init__(self, model: dict):
        self.reader = Reader({f: i for i, f in enumerate(model["vocabulary"])})
        self.weights, self.bias, self.leak = np.array(model["weights"]), model["bias"], model["leak"]

    def sentences(self, text: str | None) -> tuple[list[tuple[int, int, float]], int]:
        """(start, end, probability) of each sentence with evidence, and the number of all sentences."""
        *found, n = self.reader.sentences(text or "")
        return [(a, b, float(1 / (1 + np.exp(-(self.weights[ids].sum() + self.bias))))) for a, b, ids in found], n

    def score(self, text: str | None):
        """score, number of sentences, start and end of the most offending one (None without evidence), its probability."""
        found, n = self.sentences(text)
        log_clean = -self.leak + sum(np.log1p(-min(p, 1 - 1e-12)) for _, _, p in found)
        worst = max(found, key=lambda s: s[2], default=(None, None, None))
        return float(-np.expm1(log_clean)), n, *worst


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, held_out, score, predicted, n_sentences and the worst sentence's worst_start, worst_end (code points), worst_score."""
    bounded_batches(docs.sparkSession)

    def run(batches):
        scorer = Scorer(model)
        for b in batches:
            got = list(zip(*(scorer.score(t) for t in b.column(1).to_pylist()), strict=True)) or [[]] * 5
            kinds = [pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(got, kinds, strict=True))], ["doc_id", "score", "n_sentences", "worst_start", "worst_end", "worst_score"])

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, n_sentences long, worst_start long, worst_end long, worst_score double")
    return out.select("doc_id", in_fold("doc_id", 5, 0).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), "n_sentences", "worst_start", "worst_end", "worst_score")


def offending(docs: DataFrame, model: dict, threshold: float = 0.5) -> DataFrame:
    """doc_id, start, end, sentence, score of each sentence at or above the threshold."""
    bounded_batches(docs.sparkSession)

    def run(batches):
        scorer = Scorer(model)
        for b in batches:
            rows = [(d, s, e, t[s:e], p) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for s, e, p in scorer.sentences(t)[0] if p >= threshold]
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64()], strict=True)], ["doc_id", "start", "end", "sentence", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, start long, end long, sentence string, score double")


def drop_toxic(docs: DataFrame, model: dict, threshold: float = 0.5) -> DataFrame:
    """The rows of docs, in the same columns, that score below the threshold."""
    bounded_batches(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches):
        scorer = Scorer(model)
        for b in batches:
            yield b.filter(pa.array([scorer.score(t)[0] < threshold for t in b.column(at).to_pylist()], pa.bool_()))

    return map_batches(docs, run)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
