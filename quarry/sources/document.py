"""One PDF file in memory: its objects, pages and what was repaired."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from ..functions import codecs
from .crypt import Handler, WrongPassword
from .objects import Keyword, Name, Reader, Ref, Stream, SyntaxProblem, Text, operations, references


class LoadError(ValueError):
    pass


_HEADER = re.compile(rb"%PDF-(\d\.\d)")
_STREAM_WORD = re.compile(rb"(?<![A-Za-z])stream(\r\n|\n)")
_END_WORD = re.compile(rb"(?<![A-Za-z])endobj(?![A-Za-z])")
_AFTER_BODY = re.compile(rb"\s*endstream")
#: Plain forms, without comments: an object's head, a cross-reference entry, and a section's head.
_HEAD = re.compile(rb"[\0\t\n\f\r ]*(\d+)[\0\t\n\f\r ]+(\d+)[\0\t\n\f\r ]*obj")
_ENTRY = re.compile(rb"[\0\t\n\f\r ]*(\d+)[\0\t\n\f\r ]+(\d+)[\0\t\n\f\r ]*([nf])")
_SECTION = re.compile(rb"[\0\t\n\f\r ]*(\d+)[\0\t\n\f\r ]+(\d+)[\0\t\n\f\r ]")


@dataclass
class Recovery:
    object: int
    generation: int
    file_offset: int
    declared_length: int | None
    actual_length: int


@dataclass
class Document:
    version: str = "1.4"
    trailer: dict = field(default_factory=dict)
    objects: dict[Ref, object] = field(default_factory=dict)
    offsets: dict[Ref, int] = field(default_factory=dict)
    recovery: list[Recovery] = field(default_factory=list)
    encrypted: bool = False
    decrypted: bool = False
    #: Rows of the part page_text, once they were made.
    page_text: list[dict] | None = field(default=None, repr=False, compare=False)

    # Lookup.

    def get(self, value):
        """What a value stands for, through references; None for a missing one."""
        for _ in range(32):
            if not isinstance(value, Ref):
                return value
            value = self.objects.get(value)
        return None

    def dict_of(self, value) -> dict | None:
        value = self.get(value)
        return value if isinstance(value, dict) else value.dict if isinstance(value, Stream) else None

    def list_of(self, value) -> list | None:
        value = self.get(value)
        return value if isinstance(value, list) else None

    @property
    def catalog(self) -> dict:
        root = self.trailer.get("Root")
        found = self.objects.get(root) if isinstance(root, Ref) else None
        return found if isinstance(found, dict) else {}

    def pages(self) -> list[Ref]:
        """Page objects in the order of the page tree; a node that is seen again is passed over."""
        out, seen, stack = [], set(), [self.catalog.get("Pages")]
        while stack:
            ref = stack.pop()
            if not isinstance(ref, Ref) or ref in seen:
                continue
            seen.add(ref)
            node = self.objects.get(ref)
            if not isinstance(node, dict):
                continue
            kids = self.list_of(node.get("Kids"))
            if node.get("Type") == "Pages" or (node.get("Type") != "Page" and kids is not None):
                stack.extend(reversed(kids or []))
            elif node.get("Type", "Page") == "Page":
                out.append(ref)
        return out

    # Streams.

    @staticmethod
    def filters(stream: Stream) -> list[str]:
        f = stream.dict.get("Filter")
        return [str(f)] if isinstance(f, Name) else [str(x) for x in f if isinstance(x, Name)] if isinstance(f, list) else []

    def decode(self, stream: Stream) -> tuple[bytes, str | None]:
        return codecs.decode(stream.raw, self.filters(stream))

    def content(self, page: Ref) -> tuple[bytes, list[str]]:
        """A page's content streams one after the other, and warnings."""
        node = self.objects.get(page)
        contents = node.get("Contents") if isinstance(node, dict) else None
        if contents is None:
            return b"", []
        parts = contents if isinstance(contents, list) else self.get(contents) if isinstance(self.get(contents), list) else [contents]
        out, warnings, failed = [], [], False
        for part in parts:
            stream = self.get(part)
            where = f"{part.num} {part.gen}" if isinstance(part, Ref) else "inline"
            if not isinstance(stream, Stream):
                warnings.append(f"Content stream {where} {'not found' if stream is None else 'is not a stream object'}")
                failed |= stream is not None
                continue
            data, warning = self.decode(stream)
            if warning:
                warnings.append(f"Content stream {where}: {warning}")
                failed = True
            out.append(data)
        if failed and not any(out):
            warnings.append("Content stream could not be decoded")
        return b"".join(out), warnings

    def operations(self, page: Ref) -> tuple[list[tuple[str, list]], list[str]]:
        data, warnings = self.content(page)
        try:
            return operations(data), warnings
        except SyntaxProblem:
            return [], [*warnings, "Content stream has syntax errors"]

    def inherited(self, page: Ref, key: str):
        """The nearest value of a key on a page or above it; a chain that returns to itself ends."""
        seen: set[Ref] = set()
        at: object = page
        while isinstance(at, Ref) and at not in seen:
            seen.add(at)
            node = self.dict_of(at)
            if node is None:
                return None
            if key in node:
                return node[key]
            at = node.get("Parent")
        return None

    # Graph.

    def reachable(self) -> set[Ref]:
        seen: set[Ref] = set()
        stack = [r for _, r in references(self.trailer)]
        while stack:
            ref = stack.pop()
            if ref in seen or ref not in self.objects:
                continue
            seen.add(ref)
            stack.extend(r for _, r in references(self.objects[ref]))
        return seen

    def name_tree(self, root, key: str = "Names", kinds: type = Text):
        """(key, value) pairs of a name tree, or of a number tree with key "Nums" and kinds int."""
        out, seen, stack = [], set(), [root]
        while stack:
            at = stack.pop()
            if isinstance(at, Ref):
                if at in seen:
                    continue
                seen.add(at)
            node = self.dict_of(at)
            if node is None:
                continue
            pairs = self.list_of(node.get(key)) or []
            out.extend((k, v) for k, v in zip(pairs[::2], pairs[1::2], strict=False) if isinstance(k, kinds) and not isinstance(k, bool))
            stack.extend(reversed(self.list_of(node.get("Kids")) or []))
        return out


class _Loader:
    def __init__(self, data: bytes):
        self.data, self.doc = data, Document()
        self.entries: dict[Ref, int | tuple[int, int]] = {}
        self.waiting: set[Ref] = set()

    def load(self, password: bytes | None, recovery: str) -> Document:
        m = _HEADER.search(self.data[:1024])
        if not m:
            raise LoadError("no PDF header")
        doc = self.doc
        doc.version = m[1].decode()
        self._xrefs()
        for ref, at in sorted(self.entries.items()):
            if isinstance(at, int) and ref not in doc.objects:
                self._load(ref, at)
        encrypt = doc.get(doc.trailer.get("Encrypt"))
        handler = None
        if isinstance(encrypt, dict):
            doc.encrypted = True
            ids = doc.trailer.get("ID")
            first = bytes(ids[0]) if isinstance(ids, list) and ids and isinstance(ids[0], Text) else b""
            try:
                handler = Handler({k: doc.get(v) for k, v in encrypt.items()}, first, password or b"")
            except WrongPassword as e:
                if password is not None:
                    raise LoadError(f"wrong password: {e}") from e
                return doc
            held = doc.trailer.get("Encrypt")
            for ref, value in doc.objects.items():
                if ref != held:
                    doc.objects[ref] = handler.opened(value, *ref)
            doc.decrypted = True
        self._object_streams()
        doc.objects = dict(sorted(doc.objects.items()))
        if recovery != "none":
            self._recover(recovery == "lenient")
        return doc

    # Cross references.

    def _xrefs(self) -> None:
        at = self.data.rfind(b"startxref")
        if at < 0:
            raise LoadError("no startxref")
        try:
            todo, seen = [Reader(self.data, at + 9).integer()], set()
        except SyntaxProblem as e:
            raise LoadError("startxref has no offset") from e
        while todo:
            at = todo.pop(0)
            if at in seen or not 0 <= at < len(self.data):
                if not seen:
                    raise LoadError("startxref points outside the file")
                continue
            seen.add(at)
            read = Reader(self.data, at)
            try:
                trailer = self._table(read) if read.keyword(b"xref") else self._xref_stream(at)
            except (SyntaxProblem, IndexError) as e:
                raise LoadError(f"the cross-reference table can't be read: {e}") from e
            for k, v in trailer.items():
                self.doc.trailer.setdefault(k, v)
            todo += [trailer[k] for k in ("XRefStm", "Prev") if isinstance(trailer.get(k), int)]
        if "Root" not in self.doc.trailer and not self.entries:
            raise LoadError("the trailer is empty")

    def _table(self, read: Reader) -> dict:
        data, entries = self.data, self.entries
        while not read.keyword(b"trailer"):
            if m := _SECTION.match(data, read.pos):
                first, n, read.pos = int(m[1]), int(m[2]), m.end()
            else:
                first, n = read.integer(), read.integer()
            for num in range(first, first + n):
                if m := _ENTRY.match(data, read.pos):
                    read.pos = m.end()
                    if m[3] == b"n":
                        entries.setdefault(Ref(num, int(m[2])), int(m[1]))
                    continue
                at, gen = read.integer(), read.integer()
                if read.keyword(b"n"):
                    entries.setdefault(Ref(num, gen), at)
                elif not read.keyword(b"f"):
                    raise SyntaxProblem("an entry is neither used nor free")
        trailer = read.object()
        if not isinstance(trailer, dict):
            raise SyntaxProblem("the trailer isn't a dictionary")
        return trailer

    def _xref_stream(self, at: int) -> dict:
        ref, stream = self._indirect(at)
        if not isinstance(stream, Stream):
            raise SyntaxProblem("no cross-reference table where startxref points")
        self.doc.objects[ref] = stream
        data, warning = self.doc.decode(stream)
        parms = self.doc.get(stream.dict.get("DecodeParms"))
        if isinstance(parms, list):
            parms = next((p for p in parms if isinstance(p, dict)), None)
        if isinstance(parms, dict) and parms.get("Predictor", 1) >= 10:
            data = _unpredicted(data, parms.get("Columns", 1))
        if warning:
            raise SyntaxProblem(warning)
        widths = [int(w) for w in stream.dict["W"]]
        index = stream.dict.get("Index") or [0, stream.dict.get("Size", 0)]
        nums = [n for first, count in zip(index[::2], index[1::2], strict=False) for n in range(first, first + count)]
        step, pos = sum(widths), 0
        for num in nums:
            row, pos = data[pos : pos + step], pos + step
            if len(row) < step:
                break
            a, b = widths[0], widths[0] + widths[1]
            kind = int.from_bytes(row[:a], "big") if a else 1
            x, y = int.from_bytes(row[a:b], "big"), int.from_bytes(row[b:], "big")
            if kind == 1:
                self.entries.setdefault(Ref(num, y), x)
            elif kind == 2 and Ref(num, 0) not in self.entries:
                self.entries[Ref(num, 0)] = (x, y)
        return stream.dict

    # Objects.

    def _load(self, ref: Ref, at: int) -> None:
        try:
            found, value = self._indirect(at)
        except SyntaxProblem:
            return
        if found.num == ref.num:
            self.doc.objects[ref] = value
            self.doc.offsets[ref] = at

    def _length(self, value) -> int | None:
        if isinstance(value, Ref):
            if value in self.waiting:
                return None
            at = self.entries.get(value)
            if value not in self.doc.objects and isinstance(at, int):
                self.waiting.add(value)
                self._load(value, at)
                self.waiting.discard(value)
            value = self.doc.objects.get(value)
        return value if isinstance(value, int) and not isinstance(value, bool) and value >= 0 else None

    def _indirect(self, at: int) -> tuple[Ref, object]:
        read = Reader(self.data, at)
        if m := _HEAD.match(self.data, at):
            ref, read.pos = Ref(int(m[1]), int(m[2])), m.end()
        else:
            ref = Ref(read.integer(), read.integer())
            if not read.keyword(b"obj"):
                raise SyntaxProblem(f"no object at {at}")
        value = read.object()
        if isinstance(value, Keyword):
            return ref, None
        if isinstance(value, dict) and read.keyword(b"stream"):
            start = read.pos + (2 if self.data.startswith(b"\r\n", read.pos) else 1 if self.data[read.pos : read.pos + 1] in (b"\n", b"\r") else 0)
            n = self._length(value.get("Length"))
            # A body counts as a stream only where endstream follows its declared length.
            if n is not None and start + n <= len(self.data) and _AFTER_BODY.match(self.data, start + n):
                return ref, Stream(value, self.data[start : start + n])
        return ref, value

    def _object_streams(self) -> None:
        held: dict[int, list] = {}
        for ref, at in sorted(self.entries.items(), key=lambda x: x[0]):
            if isinstance(at, int) or ref in self.doc.objects:
                continue
            stream = self.doc.objects.get(Ref(at[0], 0))
            if not isinstance(stream, Stream):
                continue
            if at[0] not in held:
                held[at[0]] = self._unpacked(stream)
            for num, value in held[at[0]]:
                if num == ref.num:
                    self.doc.objects[ref] = value
                    break

    def _unpacked(self, stream: Stream) -> list:
        data, _ = self.doc.decode(stream)
        n, first = (self.doc.get(stream.dict.get(k)) for k in ("N", "First"))
        out, read = [], Reader(data)
        try:
            heads = [(read.integer(), read.integer()) for _ in range(n)]
            for num, at in heads:
                out.append((num, Reader(data, first + at).object()))
        except (SyntaxProblem, TypeError):
            pass
        return out

    # Streams whose length is wrong.

    def _recover(self, repair: bool) -> None:
        doc = self.doc
        for ref, value in list(doc.objects.items()):
            if not isinstance(value, dict) or "Length" not in value or ref not in doc.offsets:
                continue
            body = stream_body(self.data, doc.offsets[ref])
            if body is None:
                continue
            declared = doc.get(value["Length"])
            doc.recovery.append(Recovery(ref.num, ref.gen, doc.offsets[ref], declared if isinstance(declared, int) else None, len(body)))
            if repair:
                doc.objects[ref] = Stream({**value, "Length": len(body)}, body)


def stream_body(data: bytes, at: int) -> bytes | None:
    """The body between an object's stream and endstream keywords, without the end of line before the latter."""
    end = _END_WORD.search(data, at)
    m = _STREAM_WORD.search(data, at, end.start() if end else len(data))
    if not m:
        return None
    stop = data.find(b"endstream", m.end())
    if stop < 0:
        return None
    body = data[m.end() : stop]
    return body[:-2] if body.endswith(b"\r\n") else body[:-1] if body.endswith((b"\n", b"\r")) else body


def _unpredicted(data: bytes, columns: int) -> bytes:
    """Undo PNG's predictors, none and up, which cross-reference streams use."""
    out, last = [], bytes(columns)
    for at in range(0, len(data), columns + 1):
        kind, row = data[at], bytearray(data[at + 1 : at + 1 + columns])
        if kind == 1:
            for i in range(1, len(row)):
                row[i] = (row[i] + row[i - 1]) & 255
        elif kind == 2:
            row = bytearray((a + b) & 255 for a, b in zip(row, last, strict=False))
        out.append(last := bytes(row))
    return b"".join(out)


def load(data: bytes, password: bytes | None = None, recovery: str = "lenient") -> Document:
    """Parse a file. recovery: lenient repairs streams of a wrong length, strict only records them, none looks for none."""
    try:
        return _Loader(bytes(data)).load(password, recovery)
    except LoadError:
        raise
    except (SyntaxProblem, ValueError, TypeError, KeyError, IndexError, RecursionError, AttributeError) as e:
        raise LoadError(f"{type(e).__name__}: {e}") from e
