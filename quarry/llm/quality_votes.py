"""Quality rules under weak supervision.

Each rule looks at a document's counts and votes good (1), bad (-1) or abstains (0). Expectation-maximisation over
the counts of vote patterns estimates how each rule votes on good and on bad documents, and the posterior probability
of quality decides, in place of a demand that all rules pass. The patterns are at most 3 ** len(RULES), however many
documents there are, so what reaches the driver is bounded.

Defined results: null or empty text has no words, zero counts and fails the base rules; a null doc_id keeps its row;
repeated rows are judged alike; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import bounded_batches, table, written

_SPACE = b" \t\n\v\f\r"
_SYMBOLS = b"#*$%&|<>"
_LATER_BYTES = bytes(range(0x80, 0xC0))
_UPPER = re.compile(r"[^\W\d_a-zß-öø-ÿ]")
_MARKS = re.compile(rb"[#*$%&|<>]+")
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_upper", "n_stops", "longest_run", "n_marks", "n_exclaims"]


def repeated(words: list[bytes]) -> int:
    """Words that lie in a 3-word window found at least twice."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    found, total, covered = Counter(windows), 0, 0
    for i, w in enumerate(windows):
        if found[w] > 1:
            total += i + 3 - max(i, covered)
            covered = i + 3
    return total


def counts(text: str | None) -> tuple[int, ...]:
    """COUNTS of one text. Words end at the six ASCII white-space characters alone."""
    text = text or ""
    raw = text.encode("utf-8")
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip(_SPACE)]
    return (
        len(words), len(raw.translate(None, _SPACE + _LATER_BYTES)), len(raw) - len(raw.translate(None, _SYMBOLS)), len(lines) - len(set(lines)), repeated(words),
        len(lines), len(set(words)), len(_UPPER.findall(text)), sum(map(raw.count, (b".", b"!", b"?"))), max((sum(1 for _ in g) for _, g in groupby(words)), default=0),
        len(_MARKS.findall(raw)), raw.count(b"!"),
    )


#: A rule's measure over a document's counts, the bound up to which it votes good, and from which it votes bad.
RULES = {
    "symbols": (lambda c: c["n_symbols"] / c["n_words"], 0.02, 0.1),
    "marked_words": (lambda c: c["n_marks"] / c["n_words"], 0.02, 0.15),
    "exclaiming": (lambda c: c["n_exclaims"] / c["n_words"], 0.05, 0.5),
    "few_words": (lambda c: 1 - c["n_distinct"] / c["n_words"] ** 0.8, 0.2, 0.75),
    "duplicate_lines": (lambda c: c["n_dup_lines"] / c["n_lines"], 0.1, 0.5),
    "repeats": (lambda c: c["n_repeat_words"] / c["n_words"], 0.1, 0.3),
    "capitals": (lambda c: c["n_upper"] / c["word_chars"], 0.08, 0.3),
    "long_words": (lambda c: c["word_chars"] / c["n_words"], 9.0, 14.0),
    "short_words": (lambda c: c["n_words"] / c["word_chars"], 0.34, 0.5),
    "run": (lambda c: c["longest_run"] / (c["n_words"] ** 0.5 + 1), 0.4, 1.0),
    "unpunctuated": (lambda c: 1 - c["n_stops"] * 50 / c["n_words"], 0.0, 0.9),
}


def votes(c: dict[str, np.ndarray]) -> np.ndarray:
    """The rules' votes on each row of counts with words; all abstain on a row without."""
    some = c["n_words"] > 0
    c = {k: np.where(some, v, 1) for k, v in c.items()}
    out = np.stack([np.where((x := measure(c)) <= good, 1, np.where(x >= bad, -1, 0)) for measure, good, bad in RULES.values()], axis=1)
    return np.where(some[:, None], out, 0)


def estimate(patterns: np.ndarray, weights: np.ndarray, rounds: int = 100, strength: float = 0.05) -> dict:
    """Prior of quality and the rules' log odds for each vote, from vote patterns and how often each occurs.

    strength is the weight, as a share of the corpus, of the belief that a rule seldom votes bad on a good document.
    """
    total = weights.sum() + 1
    n_rules = patterns.shape[1] if patterns.size else len(RULES)
    onehot = np.stack([patterns == v for v in (-1, 0, 1)], axis=2).astype(float) if patterns.size else np.zeros((0, n_rules, 3))
    good = np.where((patterns == -1).any(axis=1), 0.2, 0.95) if patterns.size else np.zeros(0)
    for _ in range(rounds):
        prior = (np.dot(good, weights) + 0.9 * strength * total) / (weights.sum() + strength * total)
        shares = []
        for g, pseudo in ((1 - good, (0.35, 0.15, 0.5)), (good, (0.01, 0.09, 0.9))):
            s = np.einsum("p,prv->rv", g * weights, onehot) + strength * total * np.array(pseudo)
            shares.append(s / s.sum(axis=1, keepdims=True))
        bad_shares, good_shares = shares
        # A rule may be useless, but its votes never speak for the other side.
        good_shares[:, 0], good_shares[:, 2] = np.minimum(good_shares[:, 0], bad_shares[:, 0]), np.maximum(good_shares[:, 2], bad_shares[:, 2])
        model = {"prior": float(prior), "odds": np.log(good_shares) - np.log(bad_shares)}
        new = posterior(patterns, model) if patterns.size else good
        if np.abs(new - good).max(initial=0) < 1e-9:
            break
        good = new
    return model


def posterior(votes: np.ndarray, model: dict) -> np.ndarray:
    """Probability of quality for each row of votes."""
    logit = np.log(model["prior"] / (1 - model["prior"])) + model["odds"][np.arange(votes.shape[1]), votes + 1].sum(axis=1)
    return 1 / (1 + np.exp(-np.clip(logit, -500, 500)))


def counted(docs: DataFrame) -> DataFrame:
    """doc_id, COUNTS, and votes (one digit a rule: 0 bad, 1 abstains, 2 good) of every row."""
    bounded_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            rows = np.array([counts(t) for t in b.column(1).to_pylist()], np.int64).reshape(-1, len(COUNTS))
            got = votes(dict(zip(COUNTS, rows.T.astype(float), strict=True)))
            said = ["".join(map(str, v)) for v in (got + 1).tolist()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x) for x in rows.T), pa.array(said, pa.string())], ["doc_id", *COUNTS, "votes"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, f"doc_id long, {', '.join(f'{c} long' for c in COUNTS)}, votes string")


def judged(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, the counts, base_failed, kept, quality (the posterior probability) of every row."""
    spark = docs.sparkSession
    rows = written(counted(docs), "votes")
    found = rows.filter("n_words > 0").groupBy("votes").agg(F.count("*").alias("n")).orderBy("votes").collect()  # at most 3 ** len(RULES) rows
    patterns = np.array([[int(x) - 1 for x in r.votes] for r in found], np.int64).reshape(-1, len(RULES))
    model = estimate(patterns, np.array([r.n for r in found], float))
    quality = posterior(patterns, model) if len(found) else []
    known = spark.createDataFrame([*((r.votes, float(q)) for r, q in zip(found, quality, strict=True)), ("", 0.0)], "votes string, quality double")
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = rows.join(F.broadcast(known), "votes", "left").withColumn("base_failed", base).withColumn("quality", F.coalesce("quality", F.lit(0.0)))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.col("quality") >= threshold)).alias("kept"), "quality",
    )


def op6_quality_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents"))
