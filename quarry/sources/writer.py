"""Writes PDF files from objects."""

from __future__ import annotations

import re
import struct
import zlib
from functools import lru_cache
from hashlib import md5, sha256

from ..functions.codecs import ENCODERS
from .crypt import PADDING, aes_encrypt, rc4
from .objects import Name, Ref, Stream, Text, number


_NO_NAME, _NO_LITERAL = re.compile(rb"[^!-~]|[#()<>\[\]{}/%]"), re.compile(rb"[()\\\r\n]")


@lru_cache(4096)
def name(text: str) -> bytes:
    return b"/" + _NO_NAME.sub(lambda m: b"#%02X" % m[0][0], text.encode("utf-8"))


def literal(data: bytes) -> bytes:
    """A literal string; ends of line and brackets are escaped."""
    return b"(" + (_NO_LITERAL.sub(lambda m: {b"\r": b"\\r", b"\n": b"\\n"}.get(m[0], b"\\" + m[0]), data) if _NO_LITERAL.search(data) else data) + b")"


def syntax(value) -> bytes:
    """An object's bytes; of a stream only its dictionary."""
    kind = type(value)
    if kind is Ref:
        return b"%d %d R" % value
    if kind is Name:
        return name(value)
    if kind is int:
        return b"%d" % value
    if kind is dict:
        return b"<<" + b"".join([name(k) + b" " + syntax(v) for k, v in value.items()]) + b">>"
    if value is None:
        return b"null"
    if isinstance(value, bool):
        return b"true" if value else b"false"
    if isinstance(value, Ref):
        return b"%d %d R" % value
    if isinstance(value, (int, float)):
        return number(value).encode()
    if isinstance(value, Name):
        return name(value)
    if isinstance(value, Text):
        return b"<" + bytes(value).hex().encode() + b">" if value.hex else literal(bytes(value))
    if isinstance(value, (bytes, str)):
        return literal(value if isinstance(value, bytes) else value.encode("utf-8"))
    if isinstance(value, (list, tuple)):
        return b"[" + b" ".join(map(syntax, value)) + b"]"
    value = value.dict if isinstance(value, Stream) else value
    return b"<<" + b"".join(name(k) + b" " + syntax(v) for k, v in value.items()) + b">>"


def stream(data: bytes, filters: tuple[str, ...] = (), **entries) -> Stream:
    """A stream of data put through filters, the last named applied first."""
    for f in reversed(filters):
        data = ENCODERS[f](data)
    named = {} if not filters else {"Filter": Name(filters[0]) if len(filters) == 1 else [Name(f) for f in filters]}
    return Stream({**entries, **named, "Length": len(data)}, data)


#: Ways to encrypt a file, by the public specification's revisions 2, 3, 4 and 5.
METHODS = ("RC4-40", "RC4-128", "AES-128", "AES-256")


class Builder:
    """Collects objects and writes the file."""

    def __init__(self, version: str = "1.5"):
        self.version, self.objects, self.trailer, self.last = version, {}, {}, 0

    def add(self, value, num: int | None = None, gen: int = 0) -> Ref:
        """The value as an object of this number, or of the one after the largest so far."""
        ref = Ref(num or self.last + 1, gen)
        self.last = max(self.last, ref.num)
        self.objects[ref] = value
        return ref

    def _sealed(self, password: bytes, method: str) -> tuple[dict, bytes]:
        """The encryption dictionary and the file's key, by one of METHODS."""
        file_id, padded = bytes(self.trailer["ID"][0]), (password + PADDING)[:32]
        if method == "RC4-40":
            owner = rc4(md5(padded).digest()[:5], padded)
            key = md5(padded + owner + (0xFFFFFFFC).to_bytes(4, "little") + file_id).digest()[:5]
            return {"Filter": Name("Standard"), "V": 1, "R": 2, "O": Text(owner), "U": Text(rc4(key, PADDING)), "P": -4}, key
        if method == "AES-256":
            key, salts = sha256(b"key" + file_id).digest(), [sha256(bytes([i]) + file_id).digest()[:8] for i in range(4)]
            user = sha256(password + salts[0]).digest() + salts[0] + salts[1]
            owner = sha256(password + salts[2] + user).digest() + salts[2] + salts[3]
            sealed = {"UE": aes_encrypt(sha256(password + salts[1]).digest(), bytes(16), key), "OE": aes_encrypt(sha256(password + salts[3] + user).digest(), bytes(16), key)}
            entries = {"V": 5, "R": 5, "Length": 256, "O": Text(owner), "U": Text(user), **{k: Text(v) for k, v in sealed.items()}}
        else:
            by = padded
            for _ in range(51):
                by = md5(by).digest()
            owner = padded
            for i in range(20):
                owner = rc4(bytes(b ^ i for b in by), owner)
            key = md5(padded + owner + (0xFFFFFFFC).to_bytes(4, "little") + file_id).digest()
            for _ in range(50):
                key = md5(key).digest()
            user = md5(PADDING + file_id).digest()
            for i in range(20):
                user = rc4(bytes(b ^ i for b in key), user)
            entries = {"V": 2 if method == "RC4-128" else 4, "R": 3 if method == "RC4-128" else 4, "Length": 128, "O": Text(owner), "U": Text(user + bytes(16))}
        filters = {} if method == "RC4-128" else {"CF": {"StdCF": {"CFM": Name("AESV2" if method == "AES-128" else "AESV3"), "AuthEvent": Name("DocOpen")}}, "StmF": Name("StdCF"), "StrF": Name("StdCF")}
        return {"Filter": Name("Standard"), **entries, "P": -4, **filters}, key

    def write(self, password: bytes | None = None, packed: bool = False, method: str = "RC4-40") -> bytes:
        """The file's bytes. packed: plain objects in an object stream, and a cross-reference stream. method: one of METHODS."""
        objects = dict(sorted(self.objects.items()))
        if password is not None:
            encrypt, key = self._sealed(password, method)
            objects = {r: _locked(v, _lock(key, method, r)) for r, v in objects.items()}
            held = Ref(max((r.num for r in objects), default=0) + 1, 0)
            objects[held] = encrypt
            self.trailer["Encrypt"] = held
        out, at = bytearray(b"%PDF-" + self.version.encode() + b"\n%\xe2\xe3\xcf\xd3\n"), {}
        inner = {}
        if packed:
            small = [r for r, v in objects.items() if not isinstance(v, Stream) and not r.gen]
            holder = Ref(max(r.num for r in objects) + 1, 0)
            bodies, heads, pos = [], [], 0
            for i, r in enumerate(small):
                body = syntax(objects.pop(r)) + b"\n"
                heads.append(b"%d %d" % (r.num, pos))
                inner[r], pos = (holder.num, i), pos + len(body)
                bodies.append(body)
            head = b" ".join(heads) + b"\n"
            objects[holder] = stream(head + b"".join(bodies), ("FlateDecode",), Type=Name("ObjStm"), N=len(small), First=len(head))
        for r, v in objects.items():
            at[r] = len(out)
            out += b"%d %d obj\n" % r + syntax(v)
            if isinstance(v, Stream):
                out += b"\nstream\n" + v.raw + b"\nendstream"
            out += b"\nendobj\n"
        start = len(out)
        size = max((r.num for r in [*at, *inner]), default=0) + 1
        if packed:
            own = Ref(size, 0)
            at[own] = start
            rows = {r.num: struct.pack(">BIH", 1, pos, r.gen) for r, pos in at.items()} | {r.num: struct.pack(">BIH", 2, *where) for r, where in inner.items()}
            data = zlib.compress(b"".join(rows.get(n, struct.pack(">BIH", 0, 0, 65535)) for n in range(size + 1)))
            entries = {"Type": Name("XRef"), "Size": size + 1, "W": [1, 4, 2], **self.trailer, "Filter": Name("FlateDecode"), "Length": len(data)}
            out += b"%d 0 obj\n" % own.num + syntax(entries) + b"\nstream\n" + data + b"\nendstream\nendobj\n"
        else:
            out += b"xref\n"
            rows = sorted([(0, b"%010d %05d f\r\n" % (0, 65535)), *((r.num, b"%010d %05d n\r\n" % (pos, r.gen)) for r, pos in at.items())])
            for num, row in rows:
                out += b"%d 1\n" % num + row
            out += b"trailer\n" + syntax({"Size": size, **self.trailer}) + b"\n"
        return bytes(out + b"startxref\n%d\n%%%%EOF\n" % start)


def _lock(key: bytes, method: str, ref: Ref):
    """What encrypts strings and streams of one object."""
    if method != "AES-256":
        salt = ref.num.to_bytes(3, "little") + ref.gen.to_bytes(2, "little") + (b"sAlT" if method == "AES-128" else b"")
        key = md5(key + salt).digest()[: min(16, len(key) + 5)]
    if method.startswith("RC4"):
        return lambda data: rc4(key, data)

    def seal(data: bytes) -> bytes:
        iv, rest = md5(key + data).digest(), 16 - len(data) % 16
        return iv + aes_encrypt(key, iv, data + bytes([rest]) * rest)

    return seal


def _locked(value, lock):
    if isinstance(value, Text):
        out = Text(lock(bytes(value)))
        out.hex = value.hex
        return out
    if isinstance(value, list):
        return [_locked(v, lock) for v in value]
    if isinstance(value, dict):
        return {k: _locked(v, lock) for k, v in value.items()}
    if isinstance(value, Stream):
        raw = lock(value.raw)
        return Stream({**_locked(value.dict, lock), "Length": len(raw)}, raw)
    return value


def page_content(lines: list[bytes], font: str = "F1", hexed: bool = False) -> bytes:
    """Shows lines of text one below the other."""
    shown = [b"<" + x.hex().encode() + b">" if hexed else literal(x) for x in lines]
    return b"BT /" + font.encode() + b" 12 Tf 14 TL 50 742 Td " + b" Tj T* ".join([*shown]) + b" Tj ET" if shown else b""


def with_pages(build: Builder, pages: list[Stream], resources: dict, **catalog) -> list[Ref]:
    """Adds a page for each content, the page tree and the catalog; the pages."""
    tree = build.add(None)
    shared = build.add(resources)
    made = [build.add({"Type": Name("Page"), "Parent": tree, "Contents": build.add(c), "Resources": shared, "MediaBox": [0, 0, 612, 792]}) for c in pages]
    build.objects[tree] = {"Type": Name("Pages"), "Count": len(made), "Kids": made}
    build.trailer["Root"] = build.add({"Type": Name("Catalog"), "Pages": tree, **catalog})
    return made


def file_id(seed: str) -> list[Text]:
    one = Text(md5(seed.encode()).digest())
    one.hex = True
    return [one, one]
