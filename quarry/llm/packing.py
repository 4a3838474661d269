"""Conflict-constrained best-fit packing of documents into sequences of a fixed length.

A document's words (what white space separates, in every script) and its end mark take n + 1 places. Documents longer than
a sequence are cut into pieces; full pieces fill sequences of their own. Pieces are packed in descending length. Open bins are ordered by residual and carry bitmaps
of the sources and duplicate clusters that they have enough of: from the tightest bin that the piece fits in, the search
goes on to its successors until a bin has room for the piece's source and its cluster. Bins with equal bitmaps of sources
are kept in lists of their own, so a source with a third of all documents costs no long search.

A bin has one document of a source and one of a cluster, unless a source or a cluster has more documents than there are
sequences: where its n documents need n * capacity / words documents a sequence to fit in the sequences that the words
fill, up to ``SLACK`` times that many may stand in one. Counted over all documents; at most SLACK * capacity sources and as
many clusters can need it. ``per_source`` and ``per_cluster`` fix the numbers instead. Clusters are the components of op9's
fingerprints (or exact copies but for case and white space, with near=False, which needs no search); documents without a
word have none.

Documents are dealt by a hash of the row to shards of about ``SHARD_DOCS``, each packed by one task; bins are never shared
between shards, which leaves at most the shard's last bins partly filled. A shard's size depends on no key: rows that
repeat go to different shards too.

Defined results: null or empty text takes one place; a null doc_id is packed and reported as null; a null source is a
source of its own; repeated rows are packed each; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import bounded_batches, table, written
from .simhash import _signed, components, fingerprint, links

CAPACITY, SHARD_DOCS, SLACK = 2048, 4096, 1.5
END = "<|end|>"


class Bins:
    """Open bins of one shard. A bin's class is its bitmap of full sources; each class keeps its bins ordered by residual."""

    def __init__(self, capacity: int):
        self.capacity, self.n = capacity, 0
        self.sources: list[int] = []
        self.clusters: list[int] = []
        self.held: list[dict[tuple[int, int], int]] = []
        self.by_class: dict[int, list[tuple[int, int]]] = defaultdict(list)

    def place(self, size: int, source: int, cluster: int | None, of_source: int = 1, of_cluster: int = 1) -> tuple[int, int]:
        """Bin and offset for a piece; source and cluster are bit numbers, with how many of them a bin may have."""
        best: tuple[int, int] | None = None
        for full, bins in self.by_class.items():
            if full >> source & 1:
                continue
            i = bisect_left(bins, (size, -1))
            while i < len(bins) and (best is None or bins[i] < best):
                if cluster is None or not self.clusters[bins[i][1]] >> cluster & 1:
                    best = bins[i]
                    break
                i += 1
        if best is None:
            b, free = self.n, self.capacity
            self.n += 1
            self.sources.append(0)
            self.clusters.append(0)
            self.held.append({})
        else:
            free, b = best
            bins = self.by_class[self.sources[b]]
            del bins[bisect_left(bins, best)]
            if not bins:
                del self.by_class[self.sources[b]]
        if self._full(b, (0, source), of_source):
            self.sources[b] |= 1 << source
        if cluster is not None and self._full(b, (1, cluster), of_cluster):
            self.clusters[b] |= 1 << cluster
        if free > size:
            insort(self.by_class[self.sources[b]], (free - size, b))
        return b, self.capacity - free

    def _full(self, b: int, key: tuple[int, int], most: int) -> bool:
        if most == 1:
            return True
        self.held[b][key] = n = self.held[b].get(key, 0) + 1
        return n >= most


def pack(rows: list[tuple], capacity: int, of_sources: dict | None = None, of_clusters: dict | None = None) -> list[tuple]:
    """(bin, doc_id, source, piece, first, n, offset, ...) from (doc_id, source, cluster, n, ...) of one shard."""
    of_sources, of_clusters = of_sources or {}, of_clusters or {}
    pieces, out = [], []
    for doc_id, source, cluster, n, *more in rows:
        for piece, first in enumerate(range(0, n, capacity)):
            pieces.append((min(capacity, n - first), doc_id is not None, doc_id or 0, piece, first, source, cluster, doc_id, more))
    pieces.sort(key=lambda p: (-p[0], p[1], p[2], p[3], p[6] is not None, p[6] or 0, p[5] is not None, p[5] or ""))
    bins, sources, clusters = Bins(capacity), {}, {}
    for n, _, _, piece, first, source, cluster, doc_id, more in pieces:
        c = None if cluster is None else clusters.setdefault(cluster, len(clusters))
        b, offset = bins.place(n, sources.setdefault(source, len(sources)), c, of_sources.get(source, 1), of_clusters.get(cluster, 1))
        out.append((b, doc_id, source, piece, first, n, offset, *more))
    return out


def sized(docs: DataFrame, near: bool = True) -> DataFrame:
    """doc_id, source, cluster (a hash of the text without case and white space, or its fingerprint), n, copy (a hash of the
    text) of every row."""
    bounded_batches(docs.sparkSession)
    source = F.col("source").cast("string") if "source" in docs.columns else F.lit(None).cast("string")

    def run(batches):
        for b in batches:
            texts = [t or "" for t in b.column(2).to_pylist()]
            words = [t.split() for t in texts]
            key = lambda t, w: _signed(fingerprint(t)) if near else xxhash.xxh64_intdigest(" ".join(w).lower()) >> 1
            clusters = [key(t, w) if w else None for t, w in zip(texts, words, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(clusters, pa.int64()), pa.array([len(w) + 1 for w in words], pa.int64()), b.column(3)], ["doc_id", "source", "cluster", "n", "copy"])

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), source.alias("source"), "text", F.xxhash64("text").alias("copy"))
    return found.mapInArrow(run, "doc_id long, source string, cluster long, n long, copy long")


def clustered(rows: DataFrame) -> DataFrame:
    """rows with the least fingerprint of its component for cluster."""
    fps = written(rows.filter("cluster is not null").select(F.col("cluster").alias("fp")).distinct(), "packing-fps")
    roots = written(components(links(fps)), "packing-roots").withColumnRenamed("node", "cluster")
    return rows.join(roots, "cluster", "left").withColumn("cluster", F.coalesce("root", "cluster")).select(*rows.columns)


def allowed(rows: DataFrame, key: str, capacity: int) -> dict:
    """For each source (or cluster) that needs more than one document in a sequence, how many it may have."""
    rest = F.col("n") % capacity  # full pieces are alone
    words = rows.agg(F.sum(rest)).first()[0] or 0
    need = F.sum((rest > 0).cast("long")) * capacity * SLACK / max(1, words)
    found = rows.groupBy(key).agg(F.ceil(need).cast("long").alias("most")).filter("most > 1")
    return {r[key]: r.most for r in found.collect()}  # at most SLACK * capacity of them


#: What packed() returns.
PACKED = "shard long, bin long, doc_id long, source string, piece long, first long, n long, offset long, copy long, fill double"


class _Always:
    """The same number for every key."""

    def __init__(self, most: int):
        self.most = most

    def get(self, key, default=None):
        return self.most


def packed(docs: DataFrame, capacity: int = CAPACITY, shard_docs: int = SHARD_DOCS, near: bool = True, per_source: int | None = None, per_cluster: int | None = None) -> DataFrame:
    """shard, bin, doc_id, source, piece, first (place in the document), n, offset (place in the bin), copy (xxhash64 of the
    document's text) and fill (share of the bin's places in use) of every piece.

    A long document's pieces are words [first, first + n) of it, the last of them its end mark.
    """
    rows = written(sized(docs, near).withColumn("row", F.monotonically_increasing_id()), "sizes")
    if near:
        rows = written(clustered(rows), "clustered-sizes")
    n_shards = max(1, -(-rows.count() // shard_docs))
    of_sources = allowed(rows, "source", capacity) if per_source is None else _Always(per_source)
    of_clusters = allowed(rows.filter("cluster is not null"), "cluster", capacity) if per_cluster is None else _Always(per_cluster)
    names = [f.split()[0] for f in PACKED.split(", ")]
    kinds = [pa.string() if " string" in f else pa.float64() if " double" in f else pa.int64() for f in PACKED.split(", ")]

    def run(batches):
        at, held = None, []

        def done():
            placed = pack(held, capacity, of_sources, of_clusters)
            used: dict[int, int] = defaultdict(int)
            for x in placed:
                used[x[0]] += x[5]
            out = [(at, *x, used[x[0]] / capacity) for x in placed]
            for i in range(0, len(out), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out[i : i + 10_000], strict=True), kinds, strict=True)], names)

        for b in batches:
            for shard, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if shard != at:
                    if held:
                        yield from done()
                    at, held = shard, []
                held.append(tuple(row))
        if held:
            yield from done()

    dealt = rows.select(F.pmod(F.xxhash64("doc_id", "copy", "row"), F.lit(n_shards)).alias("shard"), "doc_id", "source", "cluster", "n", "copy")
    return dealt.repartition(n_shards, "shard").sortWithinPartitions("shard").mapInArrow(run, PACKED)


def sequences(docs: DataFrame, pieces: DataFrame, end: str = END) -> DataFrame:
    """shard, bin, n, fill, doc_ids (of the pieces, in order), pieces (doc_id, piece, first, n, offset) and text (their words
    and end marks) of every sequence. pieces are those of packed(docs)."""
    pieces = written(pieces, "pieces")
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("text").alias("hash"))
    # Rows that repeat an id and its text are the same to a sequence. Only where there are such is it worth moving texts once more.
    if not pieces.filter("piece = 0").groupBy("doc_id", "copy").agg(F.count("*").alias("rows")).filter("rows > 1").isEmpty():
        texts = texts.dropDuplicates(["id", "hash"])
    both = pieces.join(texts, pieces["doc_id"].eqNullSafe(texts["id"]) & (pieces["copy"] == texts["hash"]))

    def cut(batches):
        for b in batches:
            found = [" ".join([*t.split(), end][first : first + n]) for t, first, n in zip(*(b.column(i).to_pylist() for i in (5, 3, 4)), strict=True)]
            cols = [*(b.column(i) for i in (0, 1, 2, 3, 4, 6, 7, 8)), pa.array(found, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, ["shard", "bin", "piece", "first", "n", "offset", "doc_id", "fill", "words"])

    said = both.select("shard", "bin", "piece", "first", "n", "text", "offset", "doc_id", "fill").mapInArrow(cut, "shard long, bin long, piece long, first long, n long, offset long, doc_id long, fill double, words string")
    held = said.groupBy("shard", "bin").agg(F.sort_array(F.collect_list(F.struct("offset", "doc_id", "piece", "first", "n", "words"))).alias("held"), F.sum("n").alias("n"), F.first("fill").alias("fill"))
    return held.select(
        "shard", "bin", "n", "fill", F.transform("held", lambda p: p["doc_id"]).alias("doc_ids"),
        F.transform("held", lambda p: F.struct(*(p[c].alias(c) for c in ("doc_id", "piece", "first", "n", "offset")))).alias("pieces"),
        F.array_join(F.transform("held", lambda p: p["words"]), " ").alias("text"),
    )


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))
