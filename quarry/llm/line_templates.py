"""Line dedup by a template tree of fixed depth.

A line goes down a tree: first by its number of tokens, then by its ``DEPTH`` leading tokens, in which a token with a
digit counts as the variable field ``<*>``. At the leaf lines are grouped by their constant tokens: of the tokens that a
share of the leaf's lines have at a position, from ``LEVELS[0]`` of them down to ``LEVELS[-1]``, a line's template has
those that it has itself, other positions being variable, at the first share at which at least ``ALIKE`` of its positions
are constant. So a leaf holds as many templates as its lines form families. A leaf with over ``LEAF_LINES`` lines, in
which a family may lie below the least share, goes down twice as many leading tokens with the lines that found no template.
A line without a general template has its own tokens, fields generalised, for one.

Templates that recur across documents are dropped from all but the document where they come first (the smallest
doc_id, with its exact copies). Exact copies count as one document. How many documents make a template recur depends on
its length: ``MIN_DOCS_SHORT`` below ``SHORT_TOKENS`` tokens, which prose repeats by chance, ``MIN_DOCS_LONG`` from
``LONG_TOKENS`` on, between them ``MIN_DOCS`` for a line's own tokens and ``MIN_DOCS_GENERAL`` for a general template.
A document that would lose ``COPY_LINES`` different lines or more, with at least half of its words, stays whole if it is a
near copy, by a similarity of at least ``COPY_SIMILARITY`` on shingles of ``COPY_SHINGLE`` words, of the one document that
keeps most of those lines: document deduplication, not line deduplication, should judge it.

A template is known by 64 bits of a hash, and so is a token. Lines go through Spark as hashes; only lines in leaves where
several documents meet are carried token by token, and only documents that lose lines are joined with what they lose.

Defined results: null text stays null, empty text, lines without a token and lines in which no token but fields has a
letter stay; a null doc_id counts as the smallest; repeated rows count as one document; an empty table gives an empty
result; further columns are passed on, whatever their names.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import UNSPACED, bounded_batches, free_names, map_batches, table, written
from .simhash import similarity

DEPTH, FIELD = 3, "<*>"
SHORT_TOKENS, LONG_TOKENS = 5, 20
MIN_DOCS, MIN_DOCS_SHORT, MIN_DOCS_GENERAL, MIN_DOCS_LONG = 3, 20, 5, 2
#: Shares of a leaf's lines that make a token constant; below 1 / LEAF_LINES of them two lines wouldn't do in a full leaf.
LEVELS, ALIKE, LEAF_LINES = (0.8, 0.4, 0.2, 0.1, 0.05, 0.03125), 0.7, 64
COPY_LINES, COPY_SHARE, COPY_SIMILARITY, COPY_SHINGLE = 3, 0.5, 0.8, 5
#: Bits in the filter of leaves in use (2 MB, whatever the corpus), and rows in that of documents that lose lines. They only
#: spare work; the joins after them are exact.
FILTER_BITS, BUCKETS = 1 << 24, 1 << 18
#: Tokens whose hashes a task remembers at least before it begins anew.
_REMEMBERED = 20_000
#: White space but for spaces and ends of line.
_SPACES = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]
_DIGIT, _LETTER = re.compile(r"\d"), re.compile(r"[^\W\d_]")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _hash(text: str) -> int:
    return _signed(xxhash.xxh64_intdigest(text.encode("utf-8"), 11))


def masked(line: str) -> list[str]:
    """The line's tokens, those with a digit as fields. In scripts without spaces between words each character is one."""
    if not line.isascii() and UNSPACED.search(line):
        line = UNSPACED.sub(r" \g<0> ", line)
    tokens = line.split()
    return [t if t.isalpha() or not _DIGIT.search(t) else FIELD for t in tokens] if _DIGIT.search(line) else tokens


def leaf(tokens: list[str], n_tokens: int | None = None) -> int:
    """The leaf of the tree: number of tokens (by default, of those given), then leading tokens."""
    return _hash("\n".join([str(len(tokens) if n_tokens is None else n_tokens), *tokens[:DEPTH]]))


def _tells(tokens: list[str]) -> bool:
    return tokens[0].isalpha() or any(_LETTER.search(t) for t in tokens)


def _lines(text: str | None):
    """The tokens of each line with a letter."""
    for line, _, _ in _cut(text):
        yield line.split(" ")


def _plain(text: str) -> bool:
    """Whether all tokens stand between single spaces or ends of line, and none has a digit."""
    if "  " in text or any(x in text for x in _SPACES):
        return False
    try:
        there = text.encode("latin-1")  # in which only these are digits
    except UnicodeEncodeError:
        return not _DIGIT.search(text) and not UNSPACED.search(text)
    return len(there.translate(None, b"0123456789")) == len(there)


def _cut(text: str | None):
    """Of each line with a letter: its tokens with a space between them, how many there are, and the leading ones."""
    plain = _plain(text or "")
    for line in (text or "").split("\n"):
        if plain and line:
            line = line.strip(" ")
            if _LETTER.search(line):
                yield line, line.count(" ") + 1, line.split(" ", DEPTH)[:DEPTH]
        elif not plain:
            tokens = masked(line)
            if tokens and _tells(tokens):
                yield " ".join(tokens), len(tokens), tokens[:DEPTH]


def _copy():
    """What a text is known by; null and empty texts are the same."""
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def _bucket(column: str):
    return F.expr(f"pmod(`{column}`, {BUCKETS})")


def _split(docs: DataFrame, ids: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """docs whose column may be among ids (all that are, and few others while ids are few), and the rest, by a filter of at most
    BUCKETS rows."""
    (bucket,) = free_names(docs.columns, "bucket")
    some = F.broadcast(ids.select(_bucket(ids.columns[0]).alias(bucket)).distinct())  # at most BUCKETS rows
    keyed = _bucket(column) == F.col(bucket)
    return docs.join(some, keyed, "left_semi"), docs.join(some, keyed, "left_anti")


def hashed(docs: DataFrame) -> DataFrame:
    """doc_id, copy (a hash of the text), key (of the template), leaf, n_tokens, n_words (of all its lines), of each different
    line of every row."""
    bounded_batches(docs.sparkSession)
    names = ["doc_id", "copy", "key", "leaf", "n_tokens", "n_words"]

    def run(batches):
        for b in batches:
            keys, leaves, sizes, n_lines, n_words = [], [], [], [], []
            for t in b.column(1).to_pylist():
                found = {}
                for line, n, leading in _cut(t):
                    if (key := _hash(line)) not in found:
                        found[key] = n
                        leaves.append(leaf(leading, n))
                lengths = list(found.values())
                keys += found
                sizes += lengths
                n_lines.append(len(lengths))
                n_words.append(sum(lengths))
            of = np.repeat(np.arange(b.num_rows), n_lines)
            cols = [b.column(0).take(pa.array(of)), b.column(2).take(pa.array(of)), *(pa.array(np.array(c, np.int64)) for c in (keys, leaves)), pa.array(np.array(sizes, np.int32)), pa.array(np.array(n_words, np.int64)[of])]
            yield pa.RecordBatch.from_arrays(cols, names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", _copy()).mapInArrow(run, "doc_id long, copy long, key long, leaf long, n_tokens int, n_words long")


def _recurs(min_docs: int):
    least = F.when(F.col("n_tokens") < SHORT_TOKENS, MIN_DOCS_SHORT).when(F.col("n_tokens") >= LONG_TOKENS, MIN_DOCS_LONG).otherwise(min_docs)
    return F.col("n_docs") >= least


def _counted(lines: DataFrame, template: str) -> DataFrame:
    """Of each template: the copies (documents by text) it is in, the smallest doc_id and the copy that has it, the tokens, and
    a leaf of its lines with the least and the most of the copies."""
    by_copy = lines.groupBy(template, "copy").agg(F.min(F.coalesce("doc_id", F.lit(-(1 << 63)).cast("long"))).alias("first_doc"), F.first("n_tokens").alias("n_tokens"), F.first("leaf").alias("leaf"))
    return by_copy.groupBy(template).agg(
        F.count("*").alias("n_docs"), F.min(F.struct("first_doc", "copy"))["copy"].alias("first_copy"), F.first("n_tokens").alias("n_tokens"), F.first("leaf").alias("leaf"), F.min("copy").alias("least_copy"), F.max("copy").alias("most_copy")
    )


def _filter_of(hashes: DataFrame):
    """A bit map of hashes, broadcast: FILTER_BITS bits, or-ed over partitions."""

    def run(batches):
        words = np.zeros(FILTER_BITS // 8, np.uint8)
        for b in batches:
            at = b.column(0).to_numpy().astype(np.uint64) % FILTER_BITS
            np.bitwise_or.at(words, at // 8, np.uint8(1) << (at % 8).astype(np.uint8))
        used = np.nonzero(words)[0]
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(words[used].astype(np.int32))], ["at", "bits"])

    out = np.zeros(FILTER_BITS // 8, np.uint8)
    got = hashes.mapInArrow(run, "at int, bits int").groupBy("at").agg(F.bit_or("bits").alias("bits"))
    for r in got.toLocalIterator():
        out[r.at] |= r.bits
    return hashes.sparkSession.sparkContext.broadcast(out.tobytes())


class _Hashes(dict):
    """Hashes of tokens met before."""

    def __missing__(self, token: str) -> int:
        self[token] = found = _hash(token)
        return found


def _in_filter(some: bytes, x: int) -> bool:
    bit = x % FILTER_BITS
    return bool(some[bit >> 3] >> (bit & 7) & 1)


def _grouped(texts: DataFrame) -> DataFrame:
    """texts (key, leaf, tokens) with total (lines of the leaf) and general: the template of the lines that have one there."""
    each = written(texts.select("leaf", F.posexplode("tokens").alias("pos", "token")).groupBy("leaf", "pos", "token").agg(F.count("*").alias("n")), "leaf-tokens")
    # Of any position at most 1 / LEVELS[-1] tokens are frequent, so a leaf's list is bounded by its lines' length.
    totals = each.filter("pos = 0").groupBy("leaf").agg(F.sum("n").alias("total"))
    often = F.when((F.col("n") > 1) & (F.col("n") >= LEVELS[-1] * F.col("total")), F.struct("token", "n"))
    at_pos = each.join(totals, "leaf").groupBy("leaf", "pos").agg(F.collect_list(often).alias("often"), F.first("total").alias("total"))
    leaves = written(at_pos.groupBy("leaf").agg(F.sort_array(F.collect_list(F.struct("pos", "often"))).alias("at"), F.first("total").alias("total")), "leaf-templates")
    seen = F.zip_with("tokens", "at", lambda t, a: F.coalesce(F.get(F.filter(a.often, lambda o: o.token == t), 0).n, F.lit(0).cast("long")))
    counted = texts.join(leaves, "leaf").select("key", "leaf", "tokens", "total", seen.alias("seen"))

    def template(level: float):
        least = F.greatest(F.lit(2.0), level * F.col("total"))
        constant = F.zip_with("tokens", "seen", lambda t, n: F.when(n >= least, t).otherwise(0))
        return F.when(F.size(F.filter("seen", lambda n: n >= least)) >= ALIKE * F.size("tokens"), F.xxhash64("leaf", constant))

    general = [template(level) for level in LEVELS]
    return written(counted.select("key", "leaf", "tokens", "total", F.coalesce(*general).alias("general")), "general")


def general_templates(docs: DataFrame, counted: DataFrame) -> DataFrame | None:
    """key, general: the general template of each line that has one. None if no leaf calls for one."""
    # Leaves with different lines of several documents.
    of_leaf = counted.filter(F.col("n_tokens") > DEPTH + 1).groupBy("leaf").agg(F.count("*").alias("n"), F.min("least_copy").alias("a"), F.max("most_copy").alias("b"))
    shared = of_leaf.filter("n > 1 and a < b").select("leaf")
    shared = written(shared, "leaves")
    if shared.isEmpty():
        return None
    bits = _filter_of(shared)

    def run(batches):
        some, known = bits.value, _Hashes()
        for b in batches:
            keys, leaves, tokens, ends = {}, [], [], [0]
            for t in b.column(0).to_pylist():
                for line, n, leading in _cut(t):
                    if n > DEPTH + 1 and _in_filter(some, at := leaf(leading, n)) and (key := _hash(line)) not in keys:
                        keys[key] = None
                        leaves.append(at)
                        tokens += map(known.__getitem__, line.split(" "))
                        ends.append(len(tokens))
            if len(known) > _REMEMBERED:
                known = _Hashes()
            found = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.array(tokens, np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(leaves, pa.int64()), found], ["key", "leaf", "tokens"])

    texts = docs.select("text").mapInArrow(run, "key long, leaf long, tokens array<long>").groupBy("key").agg(F.first("leaf").alias("leaf"), F.first("tokens").alias("tokens"))
    texts, depth, out = written(texts.join(shared, "leaf", "left_semi"), "leaf-lines"), DEPTH, None
    while True:
        found = _grouped(texts)
        of_lines = found.filter("general is not null").select("key", "general")
        out = of_lines if out is None else out.unionByName(of_lines)
        rest = found.filter((F.col("total") > LEAF_LINES) & F.col("general").isNull() & (F.size("tokens") > depth))
        rest = written(rest.select("key", F.xxhash64("leaf", F.slice("tokens", depth + 1, depth)).alias("leaf"), "tokens"), "full-leaves")
        meet = rest.groupBy("leaf").agg(F.count("*").alias("n")).filter("n > 1").select("leaf")
        texts, depth = written(rest.join(meet, "leaf", "left_semi").select("key", "leaf", "tokens"), "deeper-lines"), 2 * depth
        if texts.isEmpty():
            return out


def recurring(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The table of lines, and of lines to drop: key, first_copy (the document by text that keeps it)."""
    lines = written(hashed(docs), "lines")
    counted = written(_counted(lines, "key"), "line-counts")
    dropped = counted.filter(_recurs(MIN_DOCS)).select("key", "first_copy")
    general = general_templates(docs, counted)
    if general is not None:
        of_leaf = _counted(lines.join(general, "key"), "general").filter(_recurs(MIN_DOCS_GENERAL)).select("general", "first_copy")
        # A line's general template says no less than its own one.
        more = general.join(written(of_leaf, "general-drops"), "general").select("key", F.col("first_copy").alias("general_copy"))
        dropped = written(dropped, "own-drops").join(written(more, "more-drops"), "key", "full").select("key", F.coalesce("general_copy", "first_copy").alias("first_copy"))
    return lines, written(dropped, "drops")


def near_copies(texts: DataFrame, hits: DataFrame) -> DataFrame:
    """copy: texts that lose COPY_LINES lines and COPY_SHARE of their words or more and are near copies of the one that keeps
    most of these."""
    by_keeper = hits.groupBy("copy", "first_copy").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("n_lines"), F.first("n_words").alias("n_words"))
    keepers = by_keeper.groupBy("copy").agg(F.sum("n").alias("n"), F.sum("n_lines").alias("n_lines"), F.first("n_words").alias("n_words"), F.max(F.struct("n", "first_copy"))["first_copy"].alias("keeper"))
    keepers = written(keepers.filter((F.col("n_lines") >= COPY_LINES) & (F.col("n") >= COPY_SHARE * F.col("n_words"))).select("copy", "keeper"), "keepers")
    ids = written(keepers.select(F.explode(F.array("copy", "keeper")).alias("copy")).distinct(), "keeper-ids")
    held = written(texts(ids).groupBy("copy").agg(F.min("text").alias("text")), "keeper-texts")
    both = keepers.join(held.withColumnRenamed("text", "left"), "copy").join(held.select(F.col("copy").alias("keeper"), F.col("text").alias("right")), "keeper")

    def compare(batches):
        for b in batches:
            keep = [similarity(x, y, COPY_SHINGLE) >= COPY_SIMILARITY for x, y in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield b.select(["copy"]).filter(pa.array(keep, pa.bool_()))

    return both.select("copy", "left", "right").mapInArrow(compare, "copy long")


def without_templates(docs: DataFrame) -> DataFrame:
    """docs with recurring lines taken out of text, in the same columns; n_chars, where there is one, follows the text."""
    bounded_batches(docs.sparkSession)
    lines, dropped = recurring(docs)
    # A copy's own lines go too unless it is the first; keyed by the text's hash, so copies cost one row.
    hits = written(lines.join(dropped, "key").filter(F.col("copy") != F.col("first_copy")).select("copy", "key", "first_copy", "n_tokens", "n_words").distinct(), "hits")
    at, n_at = docs.columns.index("text"), docs.columns.index("n_chars") if "n_chars" in docs.columns else None
    copy, of, drop = free_names([*docs.columns, "bucket"], "copy", "of", "drop")
    keyed = docs.withColumn(copy, _copy())

    def texts(ids):
        found, _ = _split(keyed.select(F.col(copy).alias("copy"), F.col("text")), ids, "copy")
        return found.join(ids, "copy", "left_semi")

    def cut(batches):
        for b in batches:
            out, drops = [], b.column(b.num_columns - 1).to_pylist()
            for t, gone in zip(b.column(at).to_pylist(), drops, strict=True):
                out.append(without(t, set(gone)) if gone and t else t)
            cols = b.columns
            cols[at] = pa.array(out, pa.string())
            if n_at is not None:
                n = [None if t is None else len(t) for t in out]
                cols[n_at] = pa.array([m if d is None else c for c, m, d in zip(n, cols[n_at].to_pylist(), drops, strict=True)], cols[n_at].type)
            yield pa.RecordBatch.from_arrays(cols, names=b.schema.names)

    by_text = hits.join(written(near_copies(texts, hits), "near-copies"), "copy", "left_anti").groupBy("copy").agg(F.collect_list("key").alias(drop)).withColumnRenamed("copy", of)
    by_text = written(by_text, "text-drops")
    some, plain = _split(keyed, by_text.select(of), copy)
    some = some.join(by_text, F.col(copy) == F.col(of), "left").drop(copy, of)
    return plain.drop(copy).union(map_batches(some, cut).drop(drop))


def without(text: str, drop: set[int]) -> str:
    """The text without lines whose template is in drop."""
    kept = []
    for line in text.split("\n"):
        tokens = masked(line)
        if not tokens or not _tells(tokens) or _hash(" ".join(tokens)) not in drop:
            kept.append(line)
    return "\n".join(kept)


def op3_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text (without recurring templates), n_chars, n_dropped (code points taken out) of every document."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.length("text").cast("long").alias("n_before"))
    out = without_templates(docs)
    return out.select("doc_id", "text", F.length("text").cast("long").alias("n_chars"), (F.col("n_before") - F.length("text")).alias("n_dropped"))
