"""Quality classifier: random Fourier features over document statistics, ridge scores, isotonic calibration.

Every row's statistics are taken once and written. Labelled rows of the training fold give normal equations, summed by
partition; cosines of fixed random projections approximate a Gaussian kernel. The scores of either half of the labelled
rows under the other half's model give the counts from which pool-adjacent-violators learns the calibration.

Defined results: null or empty text has all-zero statistics and is scored; a null doc_id is scored and not held out;
repeated rows are scored each; an empty table gives an empty result; further columns are ignored; without labels
every score is 0.5, with one class its smoothed share. The driver receives at most ``FIT_PARTS`` sums of fixed size
and ``BINS`` counts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import bounded_batches, in_fold, table, written
from .quality_votes import COUNTS, counts

N_WAVES, SEED, FIT_PARTS, BINS, RIDGE = 256, 7, 24, 400, 1e-3
STATS = ["log_words", "word_length", "symbols", "marks", "duplicate_lines", "repeats", "distinct", "capitals", "stops", "exclaims", "run", "line_words"]


def statistics(text: str | None) -> list[float]:
    """STATS of one text."""
    c = dict(zip(COUNTS, counts(text), strict=True))
    n = c["n_words"]
    if not n:
        return [0.0] * len(STATS)
    return [
        np.log1p(n), np.log(c["word_chars"] / n), min(1.0, c["n_symbols"] / n) ** 0.5, min(1.0, c["n_marks"] / n) ** 0.5, c["n_dup_lines"] / c["n_lines"], c["n_repeat_words"] / n,
        np.log(c["n_distinct"]) / np.log(n + 1), (c["n_upper"] / c["word_chars"]) ** 0.5, min(1.0, c["n_stops"] / n) ** 0.5, min(1.0, c["n_exclaims"] / n) ** 0.5, np.log1p(c["longest_run"]), np.log1p(n / c["n_lines"]),
    ]


def waves(z: np.ndarray, n_waves: int = N_WAVES, seed: int = SEED) -> np.ndarray:
    """Random Fourier features of standardised rows, with a constant."""
    rng = np.random.default_rng(seed)
    w = rng.normal(size=(z.shape[1], n_waves)) / np.sqrt(z.shape[1])
    return np.hstack([np.sqrt(2 / n_waves) * np.cos(z @ w + rng.uniform(0, 2 * np.pi, n_waves)), np.ones((len(z), 1))])


def standard(batch, names, mean, scale) -> np.ndarray:
    x = np.stack([batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in names], axis=1) if batch.num_rows else np.zeros((0, len(names)))
    return np.clip((x - mean) / scale, -4, 4)


def isotonic(hits: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """Nondecreasing rates over bins by pooling adjacent violators; empty bins are filled between their neighbours.

    Two rows at the smoothed share of all rows are spread over the bins in use, so no rate is 0 or 1.
    """
    blocks: list[list[float]] = []  # sum of hits, weight, bins
    used = np.nonzero(totals)[0]
    share, more = (hits.sum() + 0.5) / (totals.sum() + 1), 2 / max(1, len(used))
    for i in used:
        blocks.append([hits[i] + more * share, totals[i] + more, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            h, t, n = blocks.pop()
            blocks[-1] = [blocks[-1][0] + h, blocks[-1][1] + t, blocks[-1][2] + n]
    rates = np.concatenate([[h / t] * n for h, t, n in blocks])
    return np.interp(np.arange(len(totals)), used, rates)


def fit(stats: DataFrame, labels: DataFrame) -> dict:
    """The model from the labelled rows of the training fold."""
    first = stats.agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in STATS], *[F.stddev_pop(c).alias(f"{c}_sd") for c in STATS]).first()
    mean = np.array([first[c] or 0.0 for c in STATS])
    scale = np.array([first[f"{c}_sd"] or 1.0 for c in STATS])
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~in_fold("doc_id", 3, 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("int").alias("y"))
    rows = written(stats.join(known, "doc_id").withColumn("half", F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit("half")).cast("binary")) % 2), "quality-labelled")
    k = N_WAVES + 1

    def sums(batches):
        gram, moment = np.zeros((2, k, k)), np.zeros((2, k))
        for b in batches:
            f, half, y = waves(standard(b, STATS, mean, scale)), b.column(b.schema.get_field_index("half")).to_numpy(), b.column(b.schema.get_field_index("y")).to_numpy()
            for h in (0, 1):
                part = f[half == h]
                gram[h] += part.T @ part
                moment[h] += part.T @ y[half == h]
        yield pa.RecordBatch.from_arrays([pa.array([gram.tobytes()]), pa.array([moment.tobytes()])], ["gram", "moment"])

    gram, moment = np.zeros((2, k, k)), np.zeros((2, k))
    for r in rows.repartition(FIT_PARTS).mapInArrow(sums, "gram binary, moment binary").toLocalIterator():
        gram += np.frombuffer(r.gram).reshape(2, k, k)
        moment += np.frombuffer(r.moment).reshape(2, k)
    n = gram.sum(axis=0)[k - 1, k - 1]
    if not n:
        return {"mean": mean, "scale": scale, "weights": np.zeros(k), "rates": np.full(BINS, 0.5)}

    def solve(g, m):
        return np.linalg.solve(g + RIDGE * (g[k - 1, k - 1] + 1) * np.eye(k), m)

    crossed = [solve(gram[1 - h], moment[1 - h]) for h in (0, 1)]

    def bins(batches):
        hits, totals = np.zeros(BINS), np.zeros(BINS)
        for b in batches:
            f, half, y = waves(standard(b, STATS, mean, scale)), b.column(b.schema.get_field_index("half")).to_numpy(), b.column(b.schema.get_field_index("y")).to_numpy()
            at = binned(np.where(half == 0, f @ crossed[0], f @ crossed[1]))
            hits += np.bincount(at, y, BINS)
            totals += np.bincount(at, minlength=BINS)
        yield pa.RecordBatch.from_arrays([pa.array([hits.tobytes()]), pa.array([totals.tobytes()])], ["hits", "totals"])

    hits, totals = np.zeros(BINS), np.zeros(BINS)
    for r in rows.repartition(FIT_PARTS).mapInArrow(bins, "hits binary, totals binary").toLocalIterator():
        hits, totals = hits + np.frombuffer(r.hits), totals + np.frombuffer(r.totals)
    return {"mean": mean, "scale": scale, "weights": solve(gram.sum(axis=0), moment.sum(axis=0)), "rates": isotonic(hits, totals)}


def binned(ridge: np.ndarray) -> np.ndarray:
    """Bins of ridge scores from -0.5 to 1.5."""
    return np.clip(((ridge + 0.5) / 2 * BINS).astype(np.int64), 0, BINS - 1)


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and STATS of every row."""
    bounded_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            rows = np.array([statistics(t) for t in b.column(1).to_pylist()], float).reshape(-1, len(STATS))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x) for x in rows.T)], ["doc_id", *STATS])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, f"doc_id long, {', '.join(f'{c} double' for c in STATS)}")


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    stats = written(measured(docs), "quality-stats")
    model = fit(stats, labels)

    def run(batches):
        for b in batches:
            ridge = waves(standard(b, STATS, model["mean"], model["scale"])) @ model["weights"]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model["rates"][binned(ridge)])], ["doc_id", "score"])

    out = stats.mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", in_fold("doc_id", 3, 1).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def op5_quality_rff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
