"""Token ids in files of independent zstandard frames with a trailing seek table.

A file is, in order:
  data frames: each an independent zstandard frame of about FRAME_BYTES before compression. Its content is n_docs (u32),
      then for each document doc_id (i64), whether it has one (u8), its number of ids (u32), then all ids (u32 each);
      everything little-endian.
  an index, in a skippable frame: for each data frame its first id, last id (i64) and number of documents (u32).
  a seek table, in a skippable frame, as the public seekable format lays it out: for each frame before it the compressed
      size, the content's size and the low 32 bits of the content's XXH64 (0 for the index), then the number of
      frames (u32), a descriptor (0x80: with checksums) and the closing magic number.
A reader needs the tail of the file and then only the frames that hold the documents it wants.

Defined results: null text counts as empty (the end id alone); rows with a null doc_id come first and come back null;
repeated rows are each encoded, ordered by text; an empty table gives no file and an empty result; further columns are
ignored. What reaches the driver is one row for each file.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from array import array
from functools import cache
from itertools import accumulate

import pyarrow as pa
import regex
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import bounded_batches, new_path, table, written

FRAME_BYTES = 1 << 20
# Fixed values of the public seekable format: its two skippable magics and the closing one.
INDEX_MAGIC, SEEK_MAGIC, CLOSING_MAGIC, WITH_CHECKSUMS = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1, 0x80
_DOC, _SEEK, _INDEX = struct.Struct("<qBI"), struct.Struct("<III"), struct.Struct("<qqI")
#: Pieces of text remembered with their ids by a Python worker in each of two generations; the older one then goes.
_REMEMBERED = 300_000
#: White space that touches a space: the pre-tokenizer then looks beyond a single piece.
_LOOSE, _ODD_SPACE, _MARKS = re.compile(r" \s|\s "), re.compile(r"[^\S\n ]"), frozenset(".,!?;:")
#: Pre-tokens of the public byte-level scheme between white space: the first, which a space stands before, and the next ones.
_FIRST, _NEXT = regex.compile(r"\p{L}+|\p{N}+|[^\s\p{L}\p{N}]+"), regex.compile(r"'(?:s|t|re|ve|m|ll|d)|\p{L}+|\p{N}+|[^\s\p{L}\p{N}]+")


def _loose(text: str) -> bool:
    return "  " in text or "\n " in text or " \n" in text or (_ODD_SPACE.search(text) is not None and _LOOSE.search(text) is not None)


class _Known(dict):
    """Pieces with their ids; one that is met for the first time is encoded, unless the generation before knew it."""

    def __init__(self, encode, older: dict):
        self.encode, self.older = encode, older

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            ids = self.encode(piece)
        # A piece over an end of line is rarely met again; its parts are remembered.
        if len(piece) <= 40 and "\n" not in piece:
            self[piece] = ids
        return ids


class Encoder:
    """Encodes whole texts to ids as bytes.

    The pre-tokenizer splits before every single space between other characters, so a text's pieces between such spaces
    are encoded once and remembered. A piece of characters up to U+024F without other white space than ends of line is split
    as it does, into runs of letters, of numbers and of others; runs go straight to the tokenizer's model. Texts in which a space
    touches white space, and texts that spell out one of the tokenizer's added tokens (as the library does by default, that
    is then one id), are encoded in one call.
    """

    def __init__(self, path: str):
        # Tasks share the cores already, and threads for a few pieces cost more than the pieces.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.known = Tokenizer.from_file(path), _Known(self._piece, {})
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.split = self.tokenizer.model.tokenize
        self.bytes_of = [struct.pack("<I", i) for i in range(self.tokenizer.get_vocab_size(with_added_tokens=True))]
        self.runs: dict[str, bytes] = {}  # within pieces: not after a space
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        hidden = [b for b in range(256) if b not in shown]
        self.shown = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}  # the public byte-level alphabet

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids).tobytes()

    def _run(self, run: str, before: str = "") -> bytes:
        """One pre-token, with the space before it if there is one."""
        spelled = run if run.isascii() and run.isprintable() else run.encode().decode("latin-1").translate(self.shown)
        return b"".join([self.bytes_of[t.id] for t in self.split(before + spelled)])

    def _piece(self, piece: str) -> bytes:
        """A piece with the space before it."""
        if piece.isascii() and piece.isalpha():
            return b"".join([self.bytes_of[t.id] for t in self.split("\u0120" + piece)])
        if not piece or not (piece.isascii() or max(piece) < "\u0250"):
            return self._whole(f" {piece}")
        if piece.isalpha():
            return self._run(piece, "\u0120")
        if piece[-1] in _MARKS and piece[:-1].isalpha():
            return self.known[piece[:-1]] + self._held(piece[-1])
        lines = piece.split("\n")
        if not lines[-1] or _ODD_SPACE.search(piece):
            return self._whole(f" {piece}")
        out, gap = [], 0
        for i, line in enumerate(lines):
            if line and not i:
                if len(lines) > 1:
                    out.append(self.known[line])
                else:
                    at = _FIRST.match(line).end()
                    first = line[:at]
                    out.append(self.known[first] if first.isalpha() and at < len(piece) else self._run(first, "\u0120"))
                    out += map(self._held, _NEXT.findall(line, at))
            elif line:
                out += [self._held(line)] if line.isalpha() else map(self._held, _NEXT.findall(line))
            if i + 1 < len(lines):
                # Of several ends of line the last is a pre-token of its own, and those before it are one.
                gap += 1
                if lines[i + 1]:
                    out += [self._held("\n" * (gap - 1)), self._held("\n")] if gap > 1 else [self._held("\n")]
                    gap = 0
        return b"".join(out)

    def _held(self, run: str) -> bytes:
        """A pre-token without a space before it."""
        ids = self.runs.get(run)
        if ids is None:
            ids = self._run(run)
            if len(run) <= 16 and len(self.runs) < _REMEMBERED:
                self.runs[run] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if _loose(text) or any(t in text for t in self.added):
            return self._whole(text)
        if len(self.known) > _REMEMBERED:
            self.known.older = {}
            self.known = _Known(self._piece, self.known)
        head, *rest = text.split(" ")
        return b"".join([self._whole(head) if head else b"", *map(self.known.__getitem__, rest)])


@cache
def encoder(path: str) -> Encoder:
    """One encoder for all tasks of a Python worker, so that they share what is remembered."""
    return Encoder(path)


class Writer:
    """Writes one file, holding one frame at a time."""

    def __init__(self, out):
        self.out, self.pack = out, zstandard.ZstdCompressor(level=3)
        self.heads, self.ids, self.size = [], [], 0
        self.seek, self.index = [], []
        self.n_docs = self.n_tokens = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.heads.append((doc_id, len(ids) // 4))
        self.ids.append(ids)
        self.size += len(ids) + _DOC.size
        self.n_docs, self.n_tokens = self.n_docs + 1, self.n_tokens + len(ids) // 4
        if self.size >= FRAME_BYTES:
            self._flush()

    def _flush(self) -> None:
        if not self.heads:
            return
        content = b"".join([struct.pack("<I", len(self.heads)), *(_DOC.pack(d or 0, d is not None, n) for d, n in self.heads), *self.ids])
        frame = self.pack.compress(content)
        self.out.write(frame)
        self.seek.append((len(frame), len(content), xxhash.xxh64_intdigest(content) & 0xFFFFFFFF))
        known = [d for d, _ in self.heads if d is not None] or [0]
        self.index.append((known[0], known[-1], len(self.heads)))
        self.heads, self.ids, self.size = [], [], 0

    def close(self) -> None:
        self._flush()
        body = b"".join(_INDEX.pack(*x) for x in self.index)
        self.out.write(struct.pack("<II", INDEX_MAGIC, len(body)) + body)
        entries = [*self.seek, (len(body) + 8, 0, 0)]
        body = b"".join(_SEEK.pack(*x) for x in entries) + struct.pack("<IBI", len(entries), WITH_CHECKSUMS, CLOSING_MAGIC)
        self.out.write(struct.pack("<II", SEEK_MAGIC, len(body)) + body)


class Reader:
    """Reads documents of one file; decompresses a frame only when one of its documents is asked for."""

    def __init__(self, source):
        self.source = source
        source.seek(0, 2)
        end = source.tell()
        source.seek(end - 9)
        n, flags, magic = struct.unpack("<IBI", source.read(9))
        if magic != CLOSING_MAGIC or not flags & WITH_CHECKSUMS:
            raise ValueError("no seek table with checksums at the end of the file")
        size = 9 + n * _SEEK.size
        source.seek(end - size - 8)
        tail = source.read(size + 8)
        if struct.unpack_from("<II", tail) != (SEEK_MAGIC, size):
            raise ValueError("the seek table is damaged")
        entries = list(_SEEK.iter_unpack(tail[8:-9]))
        starts = [0, *accumulate(x[0] for x in entries)]
        self.frames = list(zip(starts, entries[:-1], strict=False))
        source.seek(starts[-2])
        self.index = list(_INDEX.iter_unpack(source.read(entries[-1][0])[8:]))

    def frame(self, k: int):
        """(doc_id, ids as bytes) of each document of frame k."""
        at, (size, length, check) = self.frames[k]
        self.source.seek(at)
        content = zstandard.ZstdDecompressor().decompress(self.source.read(size), max_output_size=length)
        if len(content) != length or xxhash.xxh64_intdigest(content) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {k} doesn't match its checksum")
        (n,) = struct.unpack_from("<I", content)
        at = 4 + n * _DOC.size
        for d, there, m in _DOC.iter_unpack(content[4:at]):
            yield d if there else None, content[at : at + 4 * m]
            at += 4 * m

    def documents(self, doc_ids: set[int] | None = None):
        """All documents in order, or those asked for."""
        for k, (first, last, _) in enumerate(self.index):
            if doc_ids is None or any(first <= d <= last for d in doc_ids):
                yield from ((d, ids) for d, ids in self.frame(k) if doc_ids is None or d in doc_ids)


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0) -> DataFrame:
    """Write docs' ids in ascending doc_id order to files in folder; part, path, n_docs, n_tokens of each file.

    A lost executor's task writes a new file under a new name, and only the files listed here count.
    """
    bounded_batches(docs.sparkSession)
    end = struct.pack("<I", end_id)

    def run(batches):
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        part = TaskContext.get().partitionId()
        path, out, coder = f"{root}/part-{part:06d}-{uuid.uuid4().hex}.zst", None, encoder(tokenizer)
        for b in batches:
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if out is None:
                    stream = store.open_output_stream(path, compression=None)
                    out = Writer(stream)
                out.add(d, coder.encode(t or "") + end)
        if out is not None:
            out.close()
            stream.close()
            yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([path]), pa.array([out.n_docs]), pa.array([out.n_tokens])], ["part", "path", "n_docs", "n_tokens"])

    order = [F.col("doc_id").asc_nulls_first(), F.col("h")]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h")).repartitionByRange(*order).sortWithinPartitions(*order, "text")
    return written(rows.select("doc_id", "text").mapInArrow(run, "part long, path string, n_docs long, n_tokens long"), "token-files")


def read(spark: SparkSession, folder: str, files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files that write() listed."""
    listed = files.orderBy("part").collect()  # one row for each file
    starts = accumulate([0, *(r.n_tokens for r in listed)])
    rows = [(r.path, s) for r, s in zip(listed, starts, strict=False)]

    def run(batches):
        store, _ = fs.FileSystem.from_uri(folder)
        for b in batches:
            for path, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with store.open_input_file(path) as source:
                    reader = Reader(source)
                    for k in range(len(reader.frames)):
                        found = list(reader.frame(k))
                        counts = [len(ids) // 4 for _, ids in found]
                        at = list(accumulate([start, *counts]))
                        start = at.pop()
                        cols = [[d for d, _ in found], at, counts, [zlib.crc32(ids) for _, ids in found]]
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "start", "n_tokens", "ids_crc32"])

    given = spark.createDataFrame(rows, "path string, start long").repartition(max(1, len(rows)))
    return given.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = new_path(spark, "tokens")
    files = write(table(spark, sf_dir, "documents"), folder, str(public_tokenizers.path("byte_bpe_50k.json")))
    return read(spark, folder, files)
