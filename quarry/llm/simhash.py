"""SimHash near-duplicate groups by pigeonhole blocks.

A fingerprint of 64 bits is cut into ``BLOCKS`` blocks. Two fingerprints that differ in at most ``max_bits``
bits agree in at least ``BLOCKS - max_bits`` blocks, so they meet under some choice of that many blocks. Rows are
joined on those blocks and the Hamming distance is verified.

Defined results: null or empty text has fingerprint zero and is linked like any other; a null ``doc_id`` keeps its
row with a fingerprint, and its ``component_id`` is the smallest id in the group that isn't null; repeated rows are
kept as they are; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import bounded_batches, drop_written, free_names, n_written, table, written

BLOCKS = 4
#: Members of a block up to which its pairs are joined; a fuller block links by neighbours instead, with the same result.
FULL_BLOCK = 32
#: Shingles hashed between two additions to the bit counts, so that a very long text needs little memory.
_CHUNK = 65536
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The SimHash of one text: a bit is 1 if it is set in over half the shingles' XXH64 (seed 42)."""
    words = text.encode("utf-8").translate(_LOWER).split() if text else []
    if not words:
        return 0
    if len(words) <= shingle:
        grams = [b" ".join(words)]
    else:
        grams = list(map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)))
    ones, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(grams), _CHUNK):
        part = np.fromiter((digest(g, 42) for g in grams[at : at + _CHUNK]), np.uint64)
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(grams), bitorder="little").view(np.uint64)[0])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) of every row."""
    bounded_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            fps = [_signed(fingerprint(t, shingle)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def _blocks(max_bits: int) -> list[int]:
    """Masks of each choice of BLOCKS - max_bits blocks, as signed longs."""
    width = 64 // BLOCKS
    block = [((1 << width) - 1) << (width * i) for i in range(BLOCKS)]
    return [_signed(sum(block[i] for i in pick)) for pick in combinations(range(BLOCKS), BLOCKS - max_bits)]


def links(fps: DataFrame, max_bits: int = 2) -> DataFrame:
    """Links (a, b), a < b, that join the same groups as all pairs of distinct fingerprints at max_bits or fewer bits do.

    Blocks with few members give each verified pair. In a fuller block every member offers itself and the values one
    bit away: two members differ in at most two bits just when they offer a common value, and all who offer a value are
    linked to the smallest of them after the same verification. That needs no pairs within the block.
    """
    if not 0 <= max_bits <= 2:
        raise ValueError("max_bits is 0, 1 or 2")
    distinct = fps.select("fp").distinct()
    masks = F.array(*[F.lit(m).cast("long") for m in _blocks(max_bits)])
    keyed = written(
        distinct.select("fp", F.posexplode(masks).alias("pick", "mask")).select("fp", "pick", F.col("fp").bitwiseAND(F.col("mask")).alias("key")), "blocks"
    )
    sizes = written(keyed.groupBy("pick", "key").agg(F.count("*").alias("n")).filter("n > 1"), "block-sizes")
    members = written(keyed.join(sizes, ["pick", "key"]).select("pick", "key", "n", "fp"), "members")
    few, full = members.filter(F.col("n") <= FULL_BLOCK), members.filter(F.col("n") > FULL_BLOCK)
    x, y = few.select("pick", "key", F.col("fp").alias("a")), few.select("pick", "key", F.col("fp").alias("b"))
    pairs = x.join(y, ["pick", "key"]).filter((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)).select("a", "b")
    if max_bits == 0:
        return pairs.distinct()
    # Members that differ in the remaining bits only: those outside the block's mask flip.
    flips = F.array(F.lit(0).cast("long"), *[F.lit(_signed(1 << i)).cast("long") for i in range(64)])
    full = full.select("fp").distinct()
    offers = full.select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("value"))
    least = offers.groupBy("value").agg(F.min("fp").alias("a"), F.max("fp").alias("most")).filter("a < most").select("value", "a")
    stars = offers.join(written(least, "stars"), "value").filter((F.col("a") < F.col("fp")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("fp"))) <= max_bits))
    return pairs.union(stars.select("a", F.col("fp").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node reachable) of every node in edges (a, b), by star contraction in rounds."""
    edges = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), "edges")
    while True:
        # Large star: every larger neighbour of a node moves to the least node around it.
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = written(both.filter("b > a").join(written(least, "least"), "a").select(F.col("m").alias("a"), "b").filter("a < b").distinct(), "large")
        # Small star: a node and its smaller neighbours move to the least of them.
        least = written(large.groupBy("b").agg(F.min("a").alias("m")), "least")
        small = large.join(least, "b").select(F.col("m").alias("x"), F.explode(F.array("a", "b")).alias("y")).filter("x < y").distinct()
        small = written(small.select(F.col("x").alias("a"), F.col("y").alias("b")), "small")
        if edges.exceptAll(small).isEmpty() and small.exceptAll(edges).isEmpty():
            return small.select(F.col("b").alias("node"), F.col("a").alias("root"))
        edges = small


def near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reachable over links)."""
    fps = written(fingerprints(docs, shingle), "fps")
    ids = written(fps.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "ids")
    roots = written(components(links(ids.select("fp"), max_bits)), "roots")
    grouped = ids.join(roots, ids.fp == roots.node, "left").select("fp", F.coalesce("root", "fp").alias("root"), "least_id")
    tops = grouped.groupBy("root").agg(F.min("least_id").alias("component_id"))
    known = written(grouped.join(tops, "root").select("fp", "component_id"), "components")
    return fps.join(known, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


# Groups by similarity of texts. Fingerprints of texts with a similarity of 0.8 lie ten bits apart and more, beyond what
# blocks can find; fingerprints of small samples of their shingles are equal often enough.

#: Sampled fingerprints a text has, and shingles in the sample of each. Texts with a similarity of s share one of them with
#: a probability of 1 - (1 - s ** SAMPLED) ** SAMPLES: 0.999 at 0.8.
SAMPLES, SAMPLED = 14, 4
#: Members in a block of those compared with one another, and shingles counted at once there.
SIDE, _SHARED_AT_ONCE = 128, 8192
_ODD = np.random.default_rng(9).integers(0, 1 << 63, SAMPLES * SAMPLED, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACES = np.random.default_rng(10).integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """A hash of each different shingle of a text; shorter texts are one shingle."""
    words = text.encode("utf-8").translate(_LOWER).split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    h = _mixed(np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)))
    n = max(1, len(h) - shingle + 1)
    out = np.zeros(n, np.uint64)
    for k in range(min(shingle, len(h))):
        out += h[k : k + n] * _PLACES[k]
    return np.unique(_mixed(out))


def sampled_fingerprints(hashes: np.ndarray) -> list[int]:
    """SAMPLES fingerprints, each of the SAMPLED shingles that are the least in an order of their own."""
    if not len(hashes):
        return []
    least = np.array([_mixed(hashes * odd).min() for odd in _ODD]).reshape(SAMPLES, SAMPLED)
    mixed = np.bitwise_xor.reduce(_mixed(least * _PLACES[:SAMPLED]), axis=1) + np.arange(SAMPLES, dtype=np.uint64)
    return _mixed(mixed).view(np.int64).tolist()


def similarity(a: str | None, b: str | None, shingle: int) -> float:
    """Share of common shingles in those of either text."""
    x, y = shingle_hashes(a, shingle), shingle_hashes(b, shingle)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / max(1, len(x) + len(y) - both)


def _linked(sizes: np.ndarray, hashes: list[np.ndarray], left: np.ndarray, right: np.ndarray, least: float) -> np.ndarray:
    """Which of the texts at left have at least this similarity to which of those at right."""
    both = np.zeros((len(left), len(right)), np.float32)
    x, y = (np.concatenate([hashes[i] for i in side]) for side in (left, right))
    shared = np.intersect1d(x, y)
    of_x, of_y = np.repeat(np.arange(len(left)), sizes[left]), np.repeat(np.arange(len(right)), sizes[right])
    for at in range(0, len(shared), _SHARED_AT_ONCE):
        part = shared[at : at + _SHARED_AT_ONCE]
        ones = []
        for h, of, n in ((x, of_x, len(left)), (y, of_y, len(right))):
            place = np.minimum(np.searchsorted(part, h), len(part) - 1)
            there = part[place] == h
            m = np.zeros((n, len(part)), np.float32)
            m[of[there], place[there]] = 1
            ones.append(m)
        both += ones[0] @ ones[1].T
    common = both.astype(np.float64)
    return common / np.maximum(1, sizes[left][:, None] + sizes[right][None, :] - common) >= least


def _rest(one: DataFrame, texts: DataFrame, links: DataFrame, shingle: int, least: float) -> DataFrame:
    """Links within groups of a sampled fingerprint whose members links leave in several components.

    In such a group every member outside its largest component is compared with every member of another component. Both
    sides are dealt to blocks of about ``SIDE`` members by a hash; each two blocks are a unit of work of bounded size.
    """
    roots = written(components(links), "similar-roots")
    rooted = one.join(roots, one.doc_id == roots.node, "left").select("sample", "doc_id", F.coalesce("root", "doc_id").alias("root"))
    rooted = written(rooted, "rooted")
    by_root = rooted.groupBy("sample", "root").agg(F.count("*").alias("n"))
    open_ = by_root.groupBy("sample").agg(F.sum("n").alias("n"), F.max(F.struct("n", "root")).alias("top"), F.count("*").alias("n_roots"))
    # Of three members the ends and the one between have met.
    open_ = open_.filter("n_roots > 1 and n > 3").select("sample", F.col("top.root").alias("top"), F.ceil((F.col("n") - F.col("top.n")) / SIDE).cast("int").alias("n_left"), F.ceil(F.col("n") / SIDE).cast("int").alias("n_right"))
    members = written(rooted.join(written(open_, "open-samples"), "sample"), "open-members")

    def hashed(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingle_hashes(t, shingle).tobytes() for t in b.column(1).to_pylist()], pa.binary())], ["id", "hashes"])

    ids = members.select("doc_id").distinct()
    held = texts.join(ids, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
    held = written(held.select("doc_id", "text").mapInArrow(hashed, "id long, hashes binary"), "open-hashes")
    side = lambda n: F.pmod(F.xxhash64("doc_id", F.lit(n)), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = members.filter("root <> top").select("sample", "doc_id", "root", side("n_left").alias("i"), each("n_right").alias("j"), F.lit(True).alias("is_left"))
    right = members.select("sample", "doc_id", "root", each("n_left").alias("i"), side("n_right").alias("j"), F.lit(False).alias("is_left"))
    dealt = left.unionByName(right).join(held, F.col("doc_id") == F.col("id")).drop("id")

    def compare(rows: pa.Table) -> pa.Table:
        ids, roots, is_left = (rows.column(c).to_numpy() for c in ("doc_id", "root", "is_left"))
        left, right = np.nonzero(is_left)[0], np.nonzero(~is_left)[0]
        out = []
        if len(left) and len(right) and len(np.unique(roots)) > 1:
            hashes = [np.frombuffer(h, np.uint64) for h in rows.column("hashes").to_pylist()]
            found = _linked(np.array([len(h) for h in hashes]), hashes, left, right, least) & (roots[left][:, None] != roots[right][None, :])
            up = {}

            def top(v):
                while up.get(v, v) != v:
                    up[v] = v = up.get(up[v], up[v])
                return v

            # Links that join components; more of them would join nothing.
            for k, m in zip(*(x.tolist() for x in np.nonzero(found)), strict=True):
                u, v = top(int(roots[left[k]])), top(int(roots[right[m]]))
                if u != v:
                    up[max(u, v)] = min(u, v)
                    a, b = int(ids[left[k]]), int(ids[right[m]])
                    out.append((min(a, b), max(a, b)))
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    return dealt.groupBy("sample", "i", "j").applyInArrow(compare, "a long, b long").distinct()


def similar(docs: DataFrame, shingle: int = 5, least: float = 0.8) -> DataFrame:
    """Links (a, b), a < b, between doc_ids of different texts with at least this similarity.

    They join the same components as all such pairs that share a sampled fingerprint do. Equal texts stand together under
    their least id. Those that share a sampled fingerprint are first compared with the first and the last id of its group,
    word for word, which is all there is to do for most; where that leaves a group in several components, all its members
    that aren't in one component yet are compared.
    """
    bounded_batches(docs.sparkSession)

    def run(batches):
        kind = pa.list_(pa.int64())
        for b in batches:
            rows = [sampled_fingerprints(shingle_hashes(t, shingle)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(rows, kind)], ["doc_id", "copy", "samples"])

    texts = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("copy"))
    rows = written(texts.mapInArrow(run, "doc_id long, copy long, samples array<long>"), "samples")
    one = written(rows.groupBy("copy").agg(F.min(F.struct("doc_id", "samples")).alias("r")).select("r.doc_id", F.explode("r.samples").alias("sample")), "sampled")
    ends = written(one.groupBy("sample").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("z")).filter("a < z"), "sample-ends")
    pairs = one.join(ends, "sample").select("doc_id", F.explode(F.array("a", "z")).alias("other")).filter("doc_id <> other")
    pairs = written(pairs.select(F.least("doc_id", "other").alias("a"), F.greatest("doc_id", "other").alias("b")).distinct(), "sample-pairs")
    ids = written(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "sample-ids")
    held = texts.join(ids, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
    held = written(held, "sample-texts")
    both = pairs.join(held.select(F.col("doc_id").alias("a"), F.col("text").alias("left")), "a").join(held.select(F.col("doc_id").alias("b"), F.col("text").alias("right")), "b")

    def compare(batches):
        for b in batches:
            keep = [similarity(x, y, shingle) >= least for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    found = written(both.select("a", "b", "left", "right").mapInArrow(compare, "a long, b long"), "similar-to-ends")
    in_groups = one.join(ends, "sample").select("sample", "doc_id")
    return found.unionByName(_rest(in_groups, texts, found, shingle, least))


def keep_one(docs: DataFrame, shingle: int = 3, max_bits: int = 2, similar_shingle: int = 5, least: float = 0.8) -> DataFrame:
    """Rows of docs without near duplicates, in the same columns: of each group the row with the smallest doc_id stays.

    Documents are linked by their fingerprints, as near_duplicates() does, and by a similarity of at least ``least``. Of rows
    that repeat an id the least (by all columns in order, maps as JSON) stays. Rows with a null id go if their fingerprint's group has
    another row; else the least of them stays.

    Of the tables written on the way only the last two, which the result reads, stay.
    """
    before = n_written(docs.sparkSession)
    found = written(near_duplicates(docs, shingle, max_bits), "near-duplicates")
    by_bits = found.filter("doc_id <> component_id").select(F.col("component_id").alias("a"), F.col("doc_id").alias("b"))
    gone_id, again_id, row = free_names(docs.columns, "gone_id", "again_id", "row")
    gone = components(by_bits.union(similar(docs, similar_shingle, least))).select(F.col("node").alias(gone_id))
    if not found.filter("doc_id is null and component_id is not null").isEmpty():
        gone = gone.union(docs.sparkSession.createDataFrame([(None,)], "gone_id long"))
    gone = written(gone, "gone")
    out = docs.join(gone, F.col("doc_id").eqNullSafe(F.col(gone_id)), "left_anti")
    again = written(found.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("doc_id").alias(again_id)), "again")
    drop_written(docs.sparkSession, before, keep_last=2)
    if again.isEmpty():
        return out
    same = F.col("doc_id").eqNullSafe(F.col(again_id))
    names = [f"`{c.replace('`', '``')}`" for c in docs.columns]
    first = out.join(again, same, "left_semi").groupBy("doc_id").agg(F.min_by(F.struct(*names), F.struct(*(_ordered(f) for f in docs.schema.fields))).alias(row)).select(f"{row}.*")
    return out.join(again, same, "left_anti").union(first)


def _ordered(field) -> Column:
    """The column as something that has an order, which maps and variants lack."""
    name = F.col(f"`{field.name.replace('`', '``')}`")
    kind = field.dataType.simpleString()
    return F.to_json(F.struct(name)) if re.search(r"map<|variant|interval", kind) else name
