"""Benchmark decontamination by latent semantic retrieval.

Documents are searched in windows of words for passages of benchmark items:
  1. document frequencies of all documents, counted in one pass for all items, give inverse document frequencies (words of
     the items by themselves, other words in hash buckets);
  2. a randomised SVD of the TF-IDF rows of passages, run as partition sums of A'(A Omega), gives a latent space. It is
     fitted on the items and all passages of all documents. For it words are known by 32 bits of a hash, which the pass
     of step 1 writes, and passages are four neighbouring blocks of eight words (fewer at the end of a short text; of a
     text of more than ``PART`` words, within a part of so many);
  3. the windows of every document are embedded and compared with the items by cosine;
  4. candidates are checked by the longest common subsequence of words with the item, and paraphrases also by whether the
     item's answer (its last sentence, at most its last third) is there.
Where fewer words of an item, or of its answer, lie together than step 4 takes, it can't pass. That is cheaper to see than
a cosine, so steps 3 and 4 are done for the stretches of a document and the items for which it isn't so; nothing is lost.
Items of fewer than ``PHRASE_WORDS`` words have too little weight in a window for a cosine to tell; an Aho-Corasick
automaton finds them as phrases, word for word.

Words are runs of letters and digits; in scripts that write no spaces between words each character is one.

Items come in blocks of at most ``BLOCK_WORDS`` words (or one item), so what is broadcast is bounded; each block is one
search of all documents.

Defined results: null or empty texts hold no passage; items without a word are never found; items of fewer than
``LEAST_DROPPED`` words are found, but documents that hold them are no benchmark documents and stay in
``without_benchmark``; a null doc_id is reported as null; repeated rows are searched alike; empty tables give an empty
result; further columns are ignored, or passed on by ``without_benchmark``.
"""

from __future__ import annotations

import re
from collections import Counter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import UNSPACED, bounded_batches, char_class, drop_written, map_batches, n_written, table, written

#: Of ASCII, letters, digits and _ are parts of words; beyond it all but the marks of _MARKS.
_FOLD = bytes(c if c >= 128 or chr(c).isalnum() or c == 95 else 32 for c in range(256))


# Code points of punctuation and spaces beyond ASCII, and of marks that end a sentence.
_MARKS = re.compile(f"[{char_class('80-a9 ab-b4 b6-b9 bb-bf 2000-206f 2e00-2e7f 3000-3004 3008-3020 3030-3030 303d-303f 30a0-30a0 30fb-30fb ff01-ff0f ff1a-ff20 ff3b-ff40 ff5b-ff65')}]")
_STOPS = re.compile(f"[{char_class('a-a 21-21 2e-2e 3f-3f 3002-3002 ff01-ff01 ff1f-ff1f')}]")
BUCKETS, FOLDED, RANK, BLOCK_WORDS, PHRASE_WORDS, LEAST_DROPPED = 1 << 16, 1 << 13, 96, 200_000, 5, 3
#: Bits in the filter of the items' words; it only spares work.
FILTER_BITS = 1 << 22
#: Windows by the length of the passage they look for, their step, and the longest passage of one query.
SHORT, LONG, LONG_FROM, CHUNK = (10, 3), (32, 8), 20, 40
MIN_COSINE, SURE, LIKELY, ANSWER = 0.45, 0.8, 0.5, 0.8
#: Words embedded at once, and words in a stretch of a document.
WORDS_AT_ONCE, STRETCH = 1024, 512
#: Words in a block and blocks in a passage of the fit, words of a text taken at once, blocks summed at once, and pieces of a sum.
STEP, PASSAGE, PART, BLOCKS_AT_ONCE, PIECES = 8, 4, 1 << 17, 128, 64
#: Tasks of a pass of the fit for each core. Each of them sends a whole matrix, so their number doesn't follow the input's partitions.
FIT_TASKS = 2
#: Fixed values of the words' hashes, and how many bytes are hashed at once.
BYTES_AT_ONCE, _BASE = 1 << 16, 0x9E3779B97F4A7C15
_VALUES, _MIX = np.random.default_rng(29).integers(0, 1 << 64, 256, np.uint64), np.array([0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53], np.uint64)


class Places:
    """Places of some words by their hashes. A word is looked up in a table of slots, and where another word has its slot, by bisection."""

    def __init__(self, hashes: np.ndarray):
        self.size, self.mask = len(hashes), (1 << max(12, (16 * len(hashes)).bit_length())) - 1
        self.place = np.argsort(hashes, kind="stable").astype(np.int32)
        self.held, self.slots = hashes[self.place], np.full(self.mask + 1, -1, np.int32)
        self.slots[self.held & self.mask] = np.arange(self.size, dtype=np.int32)

    def __call__(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the hashes are some of the words', and their places."""
        slots = self.slots[hashes & self.mask]
        at = np.flatnonzero(slots >= 0)
        found, sought = slots[at], hashes[at]
        missed = np.flatnonzero(self.held[found] != sought)
        if len(missed):
            found[missed] = np.searchsorted(self.held[:-1], sought[missed])
            same = self.held[found] == sought
            at, found = at[same], found[same]
        return at, self.place[found]


class Coder:
    """Codes words, given by their hashes: those of the items by their place, others by hash bucket after them."""

    def __init__(self, vocabulary: list[bytes]):
        self.size, self.places = len(vocabulary), Places(hashes_of(b" ".join(vocabulary))[0])

    def own(self, hashes: np.ndarray) -> np.ndarray:
        """Places of the items' words; other words have the number of these."""
        out = np.full(len(hashes), self.size, np.int32)
        at, places = self.places(hashes)
        out[at] = places
        return out

    def coded(self, hashes: np.ndarray, own: np.ndarray) -> np.ndarray:
        return np.where(own < self.size, own, self.size + (hashes & (BUCKETS - 1)).astype(np.int32))

    def codes(self, words: list[bytes]) -> np.ndarray:
        hashes = hashes_of(b" ".join(words))[0]
        return self.coded(hashes, self.own(hashes))


def _powers(base: int, n: int) -> np.ndarray:
    """base ** i for i below n, modulo 2 ** 64."""
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_UP, _DOWN = _powers(_BASE, BYTES_AT_ONCE), _powers(pow(_BASE, -1, 1 << 64), BYTES_AT_ONCE)


def _sums_of_bytes(line: bytes) -> tuple[np.ndarray, np.ndarray]:
    """For each word of a line, the sum of its bytes' values times powers of _BASE, and where it begins."""
    codes = np.frombuffer(line, np.uint8)
    space = np.ones(len(codes) + 2, bool)
    np.equal(codes, 32, out=space[1:-1])
    edges = np.flatnonzero(space[1:] != space[:-1])
    first, past = edges[::2], edges[1::2]
    up, down = (_UP, _DOWN) if len(codes) <= BYTES_AT_ONCE else (_powers(_BASE, len(codes)), _powers(pow(_BASE, -1, 1 << 64), len(codes)))
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(_VALUES[codes] * up[: len(codes)], out=sums[1:])
    return (sums[past] - sums[first]) * down[first], first


def hashes_of(line: bytes) -> tuple[np.ndarray, np.ndarray]:
    """48 bits of a hash of each word of a line of words with spaces between them, and where each begins."""
    hashes, starts, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
    while at < len(line):
        end = len(line)
        if end - at > BYTES_AT_ONCE:  # to the last space, or, of a longer word, the next one
            end = line.rfind(b" ", at, at + BYTES_AT_ONCE) + 1 or line.find(b" ", at + BYTES_AT_ONCE) + 1 or end
        sums, first = _sums_of_bytes(line[at:end])
        hashes.append(sums)
        starts.append(first + at)
        at = end
    h = np.concatenate(hashes)
    for shift, by in ((32, _MIX[0]), (29, _MIX[1])):
        h ^= h >> np.uint64(shift)
        h *= by
    return (h >> np.uint64(16)).view(np.int64), np.concatenate(starts)


def folded(text: str | None) -> bytes:
    """A text's words with spaces between them."""
    text = (text or "").lower()
    if not text.isascii():
        text = _MARKS.sub(" ", text)
        if UNSPACED.search(text):
            text = UNSPACED.sub(r" \g<0> ", text)
    return text.encode("utf-8").translate(_FOLD)


def words_of(text: str | None) -> list[bytes]:
    return folded(text).split()


def hashed(texts: list[str | None]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Texts folded, the hashes of all their words in order, and how many words each has."""
    lines = [folded(t) for t in texts]
    hashes, starts = hashes_of(b" ".join(lines))
    past = np.cumsum([len(line) + 1 for line in lines])
    return lines, hashes, np.diff(np.searchsorted(starts, past), prepend=0)


def windows(n: int, size: int, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the windows of n words; the last one ends with them."""
    starts = np.arange(0, max(1, n - size + step), step)
    starts = np.minimum(starts, max(0, n - size))
    return starts, np.minimum(starts + size, n)


def rows_of(codes: np.ndarray, size: int) -> np.ndarray:
    """Rows of the latent basis: buckets are folded once more."""
    return np.where(codes < size, codes, size + (codes - size) % FOLDED)


def lcs(a: list[bytes], b: list[bytes]) -> int:
    """Length of the longest common subsequence, by bits."""
    at: dict[bytes, int] = {}
    for i, w in enumerate(a):
        at[w] = at.get(w, 0) | 1 << i
    row, full = (1 << len(a)) - 1, (1 << len(a)) - 1
    for w in b:
        m = at.get(w, 0)
        if m:
            u = row & m
            row = ((row + u) | (row - u)) & full
    return len(a) - row.bit_count()


class Items:
    """A block of items: their words, answers, queries (passages of at most CHUNK words), and short items as phrases."""

    def __init__(self, rows: list[tuple[int | None, str | None]]):
        self.ids, self.words, self.answers, self.phrases = [], [], [], []
        for i, text in rows:
            w = words_of(text)
            if 0 < len(w) < PHRASE_WORDS:
                self.phrases.append((i, w))
            if len(w) < PHRASE_WORDS:
                continue
            last = next(filter(None, map(words_of, reversed(_STOPS.split(text)))))
            self.ids.append(i)
            self.words.append(w)
            self.answers.append(w[-max(3, min(len(last), -(-len(w) // 3))) :])
        self.vocabulary = sorted({w for x in self.words for w in x})
        self.queries = []  # item, its words, and whether it is looked for in long windows
        for k, w in enumerate(self.words):
            parts = -(-len(w) // CHUNK)
            self.queries += [(k, w[len(w) * p // parts : len(w) * (p + 1) // parts], len(w) >= LONG_FROM) for p in range(parts)]


def in_documents(hashes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different hashes of words of some texts of these lengths, in order, and in how many of the texts each is."""
    found, past = [np.zeros(0, np.uint64)], np.cumsum(lengths)
    for a in range(0, len(lengths), 1 << 16):  # a text's number takes the 16 bits beside a hash
        own = lengths[a : a + (1 << 16)]
        keys = hashes[past[a] - lengths[a] : past[a + len(own) - 1]].view(np.uint64) << np.uint64(16)
        keys |= np.repeat(np.arange(len(own), dtype=np.uint64), own)
        keys.sort()
        found.append(keys[np.flatnonzero(np.diff(keys, prepend=keys[:1] + np.uint64(1)))] >> np.uint64(16))
    each = np.sort(np.concatenate(found)) if len(found) > 2 else found[-1]
    first = np.flatnonzero(np.diff(each, prepend=each[:1] + np.uint64(1)))
    return each[first].view(np.int64), np.diff(first, append=len(each))


def frequencies(docs: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """code, n: in how many documents each word of an item is (by its hash) and, as -1 - bucket, words of each hash bucket
    are; the number of documents stands under -1 - BUCKETS. And hashes, lengths: 32 bits of all words of the documents in
    order, and how many are of one text, or of a part of it. One pass over the documents for all items."""
    bounded_batches(docs.sparkSession)

    def item_words(batches):
        for b in batches:
            found = np.unique(hashed(b.column(0).to_pylist())[1])
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], ["code"])

    bits = np.zeros(FILTER_BITS, bool)
    places = benchmark.select("text").mapInArrow(item_words, "code long").select(F.expr(f"pmod(code, {FILTER_BITS})").cast("int").alias("at")).distinct()
    for r in places.toLocalIterator():
        bits[r.at] = True
    held = docs.sparkSession.sparkContext.broadcast(np.packbits(bits))
    names, kinds = ["code", "n", "hashes", "lengths"], [pa.int64(), pa.int64(), pa.binary(), pa.binary()]

    def run(batches):
        some, n, total, buckets = np.unpackbits(held.value).view(bool), 0, Counter(), np.zeros(BUCKETS)
        for b in batches:
            n += b.num_rows
            _, hashes, lengths = hashed(b.column(0).to_pylist())
            lengths = lengths[lengths > 0]
            if len(lengths):
                codes, counts = in_documents(hashes, lengths)
                buckets += np.bincount(codes % BUCKETS, counts, BUCKETS)
                own = some[codes % FILTER_BITS]
                for code, count in zip(codes[own].tolist(), counts[own].tolist(), strict=True):
                    total[code] += count
                parts = lengths if lengths.max() <= PART else np.array([min(PART, m - at) for m in lengths.tolist() for at in range(0, m, PART)])
                yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip((None, None, hashes.astype(np.uint32).tobytes(), parts.astype(np.int32).tobytes()), kinds, strict=True)], names)
        used = np.nonzero(buckets)[0]
        codes = np.concatenate([np.fromiter(total, np.int64, len(total)), -1 - used, [-1 - BUCKETS]]).astype(np.int64)
        counts = np.concatenate([np.fromiter(total.values(), np.int64, len(total)), buckets[used], [n]]).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(counts), *(pa.nulls(len(codes), k) for k in kinds[2:])], names)

    read = written(docs.select("text").mapInArrow(run, "code long, n long, hashes binary, lengths binary"), "words")
    counted = read.filter("code is not null").groupBy("code").agg(F.sum("n").alias("n"))
    return written(counted, "frequencies"), read.filter("code is null").select("hashes", "lengths")


def inverse(counted: DataFrame, vocabulary: list[bytes]) -> np.ndarray:
    """Inverse document frequencies by code, for the words of a block of items."""
    spark, places = counted.sparkSession, {h: i for i, h in enumerate(hashes_of(b" ".join(vocabulary))[0].tolist())}
    # A block's words: at most BLOCK_WORDS, or those of one item.
    own = F.broadcast(spark.createDataFrame([(h,) for h in places], "own long"))
    df, n = np.zeros(len(vocabulary) + BUCKETS), 0
    for r in counted.join(own, counted["code"] == own["own"], "left").filter("own is not null or code < 0").select("code", "n").toLocalIterator():
        if r.code == -1 - BUCKETS:
            n = r.n
        else:
            df[places[r.code] if r.code >= 0 else len(vocabulary) - 1 - r.code] = r.n
    return np.maximum(np.log((n + 1) / (df + 1)) + 0.05, 0.05).astype(np.float32)


class Folded:
    """Rows of the latent basis and weights of words known by 32 bits of their hashes."""

    def __init__(self, vocabulary: list[bytes], idf: np.ndarray):
        self.places, self.idf = Places(hashes_of(b" ".join(vocabulary))[0].astype(np.uint32)), idf
        self.rows = rows_of(np.arange(len(idf), dtype=np.int32), len(vocabulary))

    def __call__(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        codes = (hashes & (BUCKETS - 1)).astype(np.int32) + np.int32(self.places.size)
        at, places = self.places(hashes)
        codes[at] = places
        return self.rows[codes], self.idf[codes]


def _sums(source: np.ndarray, lengths: np.ndarray, at: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums of weight * source[at] over blocks of STEP, none of which is of two of the groups that have these lengths; a row
    of zeros comes last. And how many blocks are of each group, and of which block each place is."""
    n_blocks = -(-lengths // STEP)
    gap = n_blocks * STEP - lengths
    place = np.arange(len(at)) + np.repeat(np.cumsum(gap) - gap, lengths)
    n = int(n_blocks.sum())
    spread, by = np.zeros(n * STEP, np.intp), np.zeros(n * STEP, np.float32)
    spread[place], by[place] = at, weight
    spread, by = spread.reshape(n, STEP), by.reshape(n, 1, STEP)
    out, held = np.zeros((n + 1, 1, source.shape[1]), np.float32), np.empty((BLOCKS_AT_ONCE, STEP, source.shape[1]), np.float32)
    for a in range(0, n, BLOCKS_AT_ONCE):
        z = min(a + BLOCKS_AT_ONCE, n)
        # All indices are within source; another mode would copy what it takes.
        part = np.take(source, spread[a:z], axis=0, out=held[: z - a], mode="clip")
        np.matmul(by[a:z], part, out=out[a:z])
    out = out[:, 0]
    return out, n_blocks, place // STEP


def add_product(out: np.ndarray, omega: np.ndarray, rows: np.ndarray, weight: np.ndarray, lengths: np.ndarray) -> None:
    """out += A'(A omega), where A has a row for each passage of texts of these lengths: its words' weights, as a unit vector."""
    blocks, n_blocks, block_of = _sums(omega, lengths, rows, weight)
    n = len(blocks) - 1
    end = np.repeat(np.cumsum(n_blocks), n_blocks)
    begin, at = end - np.repeat(n_blocks, n_blocks), np.arange(n)
    norms = np.bincount(block_of, weight.astype(np.float64) ** 2, n)
    # A passage begins at each block after which there are enough. A text of fewer blocks is one passage.
    squared = np.convolve(norms, np.ones(PASSAGE))[PASSAGE - 1 :]
    by = np.where(at + PASSAGE <= end, 1 / np.maximum(squared, 1e-30), 0).astype(np.float32)
    few = np.flatnonzero(end - begin < PASSAGE)
    short = blocks[few]
    passages = np.zeros((n + PASSAGE - 1, omega.shape[1]), np.float32)  # after as many that are none
    for a in range(0, n, BLOCKS_AT_ONCE):
        z = min(a + BLOCKS_AT_ONCE, n)
        part = passages[a + PASSAGE - 1 : z + PASSAGE - 1]
        part[:] = blocks[a:z]
        for j in range(1, min(PASSAGE, n - a)):
            more = blocks[a + j : min(z + j, n)]
            part[: len(more)] += more
        part *= by[a:z, None]
        # All passages of these blocks are known: they begin no later.
        blocks[a:z] = part
        for j in range(1, PASSAGE):
            blocks[a:z] += passages[a + PASSAGE - 1 - j : z + PASSAGE - 1 - j]
    if len(few):
        first = np.flatnonzero(few == begin[few])
        sums = np.add.reduceat(short, first, axis=0) / np.add.reduceat(norms[few], first)[:, None].astype(np.float32)
        blocks[few] = np.repeat(sums, np.diff(first, append=len(few)), axis=0)
    order = np.argsort((rows & 0xFFFF).astype(np.uint16), kind="stable")
    if len(out) > 1 << 16:
        order = order[np.argsort((rows[order] >> 16).astype(np.uint16), kind="stable")]
    of, at, by = rows[order], block_of[order], weight[order]
    first = np.flatnonzero(np.diff(of, prepend=-1))
    used, times = of[first], np.diff(first, append=len(of))
    while True:  # Blocks of blocks, until each row of out has its sum.
        blocks, n_blocks, _ = _sums(blocks, times, at, by)
        at = np.cumsum(n_blocks) - n_blocks
        done = n_blocks == 1
        out[used[done]] += blocks[at[done]]
        used, times, left = used[~done], n_blocks[~done], np.repeat(~done, n_blocks)
        if not len(used):
            return
        at = np.flatnonzero(left)
        by = np.ones(len(at), np.float32)


def latent_basis(words: DataFrame, items: Items, idf: np.ndarray, rank: int = RANK) -> np.ndarray:
    """An orthonormal basis (terms by rank) of the main directions of all passages, by a randomised SVD with a power step;
    words are hashes and lengths, as frequencies has them."""
    spark, size = words.sparkSession, len(items.vocabulary)
    words = words.coalesce(FIT_TASKS * spark.sparkContext.defaultParallelism)
    n_rows = size + FOLDED
    rank = min(rank, n_rows)
    vocabulary, pieces = items.vocabulary, np.linspace(0, n_rows, PIECES + 1).astype(int).tolist()

    def multiplied(omega: np.ndarray) -> np.ndarray:
        held = spark.sparkContext.broadcast(omega.astype(np.float32))

        def run(batches):
            folded, o, out = Folded(vocabulary, idf), held.value, np.zeros((n_rows, rank), np.float32)
            for b in batches:
                for hashes, lengths in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    hashes, lengths = np.frombuffer(hashes, np.uint32), np.frombuffer(lengths, np.int32)
                    past = np.cumsum(lengths)
                    for some in np.split(np.arange(len(lengths)), np.flatnonzero(np.diff((past - 1) // PART)) + 1):
                        part = hashes[past[some[0]] - lengths[some[0]] : past[some[-1]]]
                        add_product(out, o, *folded(part), lengths[some])
            yield pa.RecordBatch.from_arrays([pa.array(range(PIECES), pa.int32()), pa.array([TaskContext.get().partitionId()] * PIECES, pa.int32()), pa.array([out[a:z].tobytes() for a, z in zip(pieces[:-1], pieces[1:], strict=True)])], ["piece", "task", "part"])

        def summed(batches):
            sums = {}
            for b in batches:
                for piece, part in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                    sums[piece] = sums.get(piece, 0) + np.frombuffer(part, np.float32).astype(np.float64)
            yield pa.RecordBatch.from_arrays([pa.array(sums, pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["piece", "part"])

        total = np.zeros((n_rows, rank))
        parts = words.mapInArrow(run, "piece int, task int, part binary").repartition(PIECES, "piece").sortWithinPartitions("piece", "task")
        for r in parts.mapInArrow(summed, "piece int, part binary").toLocalIterator():
            total[pieces[r.piece] : pieces[r.piece + 1]] = np.frombuffer(r.part).reshape(-1, rank)
        # The items weigh as much as the documents: the space must tell them apart.
        coder, own = Coder(vocabulary), np.zeros((n_rows, rank))
        for _, words_of_query, _ in items.queries:
            part = coder.codes(words_of_query)
            weight = idf[part] / np.sqrt((idf[part] ** 2).sum())
            np.add.at(own, part, weight[:, None] * (weight @ omega[part]))
        scale = np.linalg.norm(total) / max(np.linalg.norm(own), 1e-12)
        held.unpersist()
        return total + max(1.0, scale) * own

    q = np.random.default_rng(17).normal(size=(n_rows, rank))
    for _ in range(2):
        q, _ = np.linalg.qr(multiplied(q))
    return q.astype(np.float32)


class Search:
    """Finds a block's items in one document's words."""

    def __init__(self, items: Items, idf: np.ndarray, basis: np.ndarray):
        self.items, self.size = items, len(items.vocabulary)
        self.coder = Coder(items.vocabulary)
        self.scratch = np.zeros(self.size + 1, bool)
        self.weighted = idf[:, None] * basis[rows_of(np.arange(len(idf)), self.size)]
        own = [np.unique(self.coder.codes(w), return_counts=True) for w in items.words]
        self.item_codes = [codes for codes, _ in own]
        self.answer_codes = [np.unique(self.coder.codes(w)) for w in items.answers]
        # Of each word the items that have it, and how often: rows of a sparse matrix.
        words, of, times = (np.concatenate([[], *x]).astype(np.int64) for x in ([c for c, _ in own], [np.full(len(c), k) for k, (c, _) in enumerate(own)], [n for _, n in own]))
        order = np.argsort(words, kind="stable")
        self.of, self.times, self.first = of[order], times[order].astype(float), np.searchsorted(words[order], np.arange(self.size + 2))
        in_answer = [dict(zip(*np.unique(self.coder.codes(w), return_counts=True), strict=True)) for w in items.answers]
        self.in_answer = np.array([in_answer[k].get(w, 0) for w, k in zip(words[order].tolist(), self.of.tolist(), strict=True)], float)
        self.n_words, self.n_answer = np.array([len(w) for w in items.words]), np.array([len(w) for w in items.answers])
        self.kinds = []
        for long, (size, step) in ((False, SHORT), (True, LONG)):
            queries = [(k, w) for k, w, is_long in items.queries if is_long == long]
            if queries:
                rows = np.stack([self.weighted[self.coder.codes(w)].sum(axis=0) for _, w in queries])
                self.kinds.append((size, step, np.array([k for k, _ in queries]), (rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)).T.astype(np.float32)))
        self.longest = max((size for size, *_ in self.kinds), default=0)
        self.reach = max((len(w) + max(2, len(w) // 4) for w in items.words), default=0)
        self.stretch = max(STRETCH, self.reach)
        self.phrases, self.automaton = items.phrases, None
        if items.phrases:
            by_text: dict[str, list[int]] = {}
            for at, (_, w) in enumerate(items.phrases):
                by_text.setdefault(f" {b' '.join(w).decode()} ", []).append(at)
            self.automaton = ahocorasick.Automaton()
            for phrase, at in by_text.items():
                self.automaton.add_word(phrase, at)
            self.automaton.make_automaton()

    def possible(self, codes: np.ndarray) -> np.ndarray:
        """Which items have as many words, of their own and of their answer, in a stretch of a document as a finding takes."""
        self.scratch[codes] = True
        there = np.flatnonzero(self.scratch[: self.size])
        self.scratch[codes] = False
        first = self.first[there]
        n = self.first[there + 1] - first
        total = int(n.sum())
        at = np.repeat(first - np.cumsum(n) + n, n) + np.arange(total)
        held = np.bincount(self.of[at], self.times[at], len(self.n_words))
        likely = held >= LIKELY * self.n_words
        if likely.any():
            answered = np.bincount(self.of[at], self.in_answer[at], len(self.n_words)) >= ANSWER * self.n_answer
            likely &= answered | (held >= SURE * self.n_words)
        return likely

    def candidates(self, codes: np.ndarray, low: int, high: int, items: np.ndarray) -> tuple[np.ndarray, ...]:
        """Windows of a document within [low, high) near some items: item, start, end, cosine, sorted by item."""
        out = [(np.zeros(0, np.int64),) * 3 + (np.zeros(0),)]
        for at in range(low, high, WORDS_AT_ONCE):
            part = self.weighted[codes[at : min(at + WORDS_AT_ONCE + self.longest, high)]]
            ahead = np.zeros((len(part) + 1, part.shape[1]), np.float32)
            np.cumsum(part, axis=0, out=ahead[1:])
            for size, step, of, queries in self.kinds:
                some = np.flatnonzero(items[of])
                if not len(some):
                    continue
                # The windows of the document that begin here; the last one ends with it.
                end = max(len(codes) - size, 0)
                first = np.append(np.arange(-(-at // step) * step, min(at + WORDS_AT_ONCE, end), step), [end] if at <= end < at + WORDS_AT_ONCE else []).astype(np.int64)
                past = np.minimum(first + size, len(codes))
                inside = past <= high
                first, past = first[inside], past[inside]
                x = ahead[past - at] - ahead[first - at]
                cosines = x @ queries[:, some]
                norms = np.sqrt(np.einsum("wr,wr->w", x, x))
                w, q = np.nonzero(cosines >= MIN_COSINE * norms[:, None])
                out.append((of[some[q]], first[w], past[w], cosines[w, q] / np.maximum(norms[w], 1e-9)))
        item, start, end, cosine = (np.concatenate(x) for x in zip(*out, strict=True))
        order = np.argsort(item, kind="stable")
        return item[order], start[order], end[order], cosine[order]

    def _counts(self, own: np.ndarray, words: np.ndarray, begin: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
        """Which words are among some, and how many of them lie within reach of each place."""
        self.scratch[words] = True
        part = self.scratch[own]
        self.scratch[words] = False
        count = np.zeros(len(part) + 1, np.int32)
        np.cumsum(part, out=count[1:])
        return part, count[np.minimum(begin + reach, len(part))] - count[begin]

    def places(self, k: int, own: np.ndarray, n_begin: int) -> tuple[np.ndarray, np.ndarray]:
        """Where item k may begin among the first n_begin words: enough of its words, and of its answer's, follow in reach;
        and how many follow."""
        n = len(self.items.words[k])
        reach, begin = n + max(2, n // 4), np.arange(n_begin)
        part, held = self._counts(own, self.item_codes[k], begin, reach)
        fits = part[:n_begin] & (held >= LIKELY * n)
        if fits.any():
            fits &= (held >= SURE * n) | (self._counts(own, self.answer_codes[k], begin, reach)[1] >= ANSWER * len(self.items.answers[k]))
        found = np.flatnonzero(fits)
        return found, held[found]

    def find(self, texts: list[str | None]):
        """For each text: item_id, cosine, share of the item in common, whether the answer is there, first and last word, n_words
        of each item found."""
        lines, hashes, lengths = hashed(texts)
        own, past = self.coder.own(hashes), np.cumsum(lengths)
        for line, a, z in zip(lines, (past - lengths).tolist(), past.tolist(), strict=True):
            yield self._find(line, hashes[a:z], own[a:z])

    def _find(self, line: bytes, hashes: np.ndarray, own: np.ndarray) -> list[tuple]:
        """What is found in one text; only where its hashes allow something are its words looked at."""
        out = self._phrases(line.split()) if self.automaton and len(own) else []
        if not len(own) or not self.kinds:
            return out
        words, codes, best = None, None, {}
        for begin in range(0, len(own), self.stretch):
            # A passage that begins in the stretch ends within the longest reach after it.
            part = own[begin : begin + self.stretch + self.reach]
            n_begin = min(self.stretch, len(part))
            fits = {}
            for k in np.flatnonzero(self.possible(part)).tolist():
                at, held = self.places(k, part, n_begin)
                if len(at):
                    fits[k] = at + begin, held
            if fits:
                if words is None:
                    words, codes = line.split(), self.coder.coded(hashes, own)
                self._search(words, codes, begin, begin + len(part), fits, best)
        for k, (share, answered, at, cosine) in sorted(best.items()):
            if share >= SURE or answered:
                n = len(self.items.words[k])
                out.append((self.items.ids[k], cosine, share, answered, -at, min(-at + n + max(2, n // 4), len(words)) - 1, n))
        return out

    def _search(self, words: list[bytes], codes: np.ndarray, begin: int, high: int, fits: dict, best: dict) -> None:
        """Passages that begin in a stretch of a document; best has, by item, share, answer, - place and cosine of the best."""
        items = np.zeros(len(self.items.words), bool)
        items[list(fits)] = True
        item, start, end, cosine = self.candidates(codes, max(begin - self.longest, 0), high, items)
        at = np.flatnonzero(np.diff(item, prepend=-1, append=-1)) if len(item) else []
        for a, z in zip(at[:-1], at[1:], strict=True):
            k = int(item[a])
            own, answer, (places, held) = self.items.words[k], self.items.answers[k], fits[k]
            n, reach = len(own), len(own) + max(2, len(own) // 4)
            # An item begins where it lies at least half in one of its windows.
            low_of, high_of = end[a:z] - reach, np.minimum(np.maximum(start[a:z], end[a:z] - n // 2), len(words) - 1)
            near = ((low_of[:, None] <= places) & (places <= high_of[:, None])).any(axis=0)
            places, held = places[near], held[near]
            # The most words first: what is left can't share more than the words it has.
            for i in np.argsort(-held, kind="stable").tolist():
                if k in best and held[i] < best[k][0] * n:
                    break
                p = int(places[i])
                there = words[p : p + reach]
                share = lcs(own, there) / n
                if share >= LIKELY:
                    found = (share, lcs(answer, there) >= ANSWER * len(answer), -p, float(cosine[a:z].max()))
                    best[k] = max(best.get(k, found), found)

    def _phrases(self, words: list[bytes]) -> list[tuple]:
        """Short items word for word, each where it comes first."""
        line = f" {b' '.join(words).decode()} "
        first: dict[int, int] = {}
        for end, ats in self.automaton.iter(line):
            for at in ats:
                first.setdefault(at, end)
        out = []
        for at, end in sorted(first.items()):
            i, w = self.phrases[at]
            last = line.count(" ", 0, end) - 1
            out.append((i, 1.0, 1.0, True, last - len(w) + 1, last, len(w)))
        return out


class Prepared:
    """What is broadcast for a block; a Python worker makes one search of it for all its tasks."""

    def __init__(self, items: Items, idf: np.ndarray, basis: np.ndarray):
        self.parts, self.made = (items, idf, basis), None

    def search(self) -> Search:
        if self.made is None:
            self.made = Search(*self.parts)
        return self.made


def blocks_of(benchmark: DataFrame):
    """Items in blocks of at most BLOCK_WORDS words, or of one item, in the order of their ids."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").distinct().orderBy("item_id", "text")
    block, n = [], 0
    for r in rows.toLocalIterator():
        size = len(words_of(r.text))
        if block and n + size > BLOCK_WORDS:
            yield Items(block)
            block, n = [], 0
        if size:
            block.append((r.item_id, r.text))
            n += size
    if block:
        yield Items(block)


def prepared(docs: DataFrame, benchmark: DataFrame):
    """The search of each block of items, broadcast: its size is bounded by the block's. After the last one what was written
    for the fits goes."""
    context, counted, words, before = docs.sparkSession.sparkContext, None, None, n_written(docs.sparkSession)
    for items in blocks_of(benchmark):
        if counted is None:
            counted, words = frequencies(docs, benchmark)
        idf = inverse(counted, items.vocabulary)
        yield context.broadcast(Prepared(items, idf, latent_basis(words, items, idf)))
    drop_written(docs.sparkSession, before)


FOUND = "doc_id long, item_id long, cosine double, share double, answer boolean, first_word long, last_word long"


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, cosine, share, answer, first_word, last_word of each item found in a document."""
    spark = docs.sparkSession
    bounded_batches(spark)
    texts, out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), None
    for held in prepared(texts, benchmark):

        def run(batches, held=held):
            search = held.value.search()
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.bool_(), pa.int64(), pa.int64()]
            for b in batches:
                rows = [(d, *x[:-1]) for d, found in zip(b.column(0).to_pylist(), search.find(b.column(1).to_pylist()), strict=True) for x in found]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows, strict=True)) or [[]] * 7, kinds, strict=True)], [f.split()[0] for f in FOUND.split(", ")])

        found = texts.mapInArrow(run, FOUND)
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], FOUND) if out is None else out


def without_benchmark(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, in the same columns, in which no benchmark item of LEAST_DROPPED words or more is found."""
    at, out = docs.columns.index("text"), docs
    bounded_batches(docs.sparkSession)
    for held in prepared(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), benchmark):

        def run(batches, held=held):
            search = held.value.search()
            for b in batches:
                yield b.filter(pa.array([all(x[-1] < LEAST_DROPPED for x in found) for found in search.find(b.column(at).to_pylist())], pa.bool_()))

        out = map_batches(out, run)
    return out


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
