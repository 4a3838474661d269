"""Stream filters: bytes in, bytes and perhaps a warning out."""

from __future__ import annotations

import re
import string
import zlib

import numpy as np

#: A decoded stream of this many bytes or more is refused.
LIMIT = 256 * 1024 * 1024
_WHITE = b" \t\n\r\f"
_TEXT_BYTES = bytes(string.digits + string.ascii_letters + string.punctuation, "ascii") + _WHITE


#: Digits of base 85, what their places stand for, and the first entries of a table of codes.
_BASE85, _POWERS85 = bytes(range(0x21, 0x76)), np.array([85**k for k in (4, 3, 2, 1, 0)], np.int64)
_BYTES = [bytes([i]) for i in range(256)]
_CODES = {b: i for i, b in enumerate(_BYTES)}


class DecodeError(ValueError):
    pass


def flate(data: bytes) -> bytes:
    unpack, out = zlib.decompressobj(), b""
    try:
        out = unpack.decompress(data, LIMIT)
    except zlib.error as e:
        raise DecodeError("FlateDecode decompression failed") from e
    if len(out) >= LIMIT:
        raise DecodeError(f"FlateDecode: decoded size exceeds {LIMIT} byte limit")
    if not unpack.eof:
        raise DecodeError("FlateDecode decompression failed")
    return out


def ascii85(data: bytes) -> bytes:
    body = data.translate(None, _WHITE)
    body = body.removeprefix(b"<~")
    end = body.find(b"~>")
    body = body if end < 0 else body[:end]
    if not body.translate(None, _BASE85):
        # No z and nothing else outside of the alphabet: whole groups at once.
        whole = len(body) // 5 * 5
        values = (np.frombuffer(body, np.uint8, whole).reshape(-1, 5).astype(np.int64) - 0x21) @ _POWERS85
        rest = [c - 0x21 for c in body[whole:]]
        return (values & 0xFFFFFFFF).astype(">u4").tobytes() + (_base85(rest + [84] * (5 - len(rest)))[: len(rest) - 1] if rest else b"")
    out, group = bytearray(), []
    for c in body:
        if c == 0x7A and not group:
            out += b"\0\0\0\0"
            continue
        if not 0x21 <= c <= 0x75:
            raise DecodeError(f"ASCII85Decode: byte {c:#04x} isn't in the alphabet")
        group.append(c - 0x21)
        if len(group) == 5:
            out += _base85(group)
            group = []
    if group:
        out += _base85(group + [84] * (5 - len(group)))[: len(group) - 1]
    return bytes(out)


def _base85(group: list[int]) -> bytes:
    value = 0
    for digit in group:
        value = value * 85 + digit
    return (value & 0xFFFFFFFF).to_bytes(4, "big")


def ascii_hex(data: bytes) -> bytes:
    body = data.translate(None, _WHITE).removesuffix(b">")
    if bad := body.translate(None, string.hexdigits.encode()):
        raise DecodeError(f"ASCIIHexDecode: byte {bad[0]:#04x} isn't a digit")
    return bytes.fromhex((body + b"0" * (len(body) % 2)).decode())


def lzw(data: bytes) -> bytes:
    """Codes of 9 to 12 bits from the highest bit on; the width grows one code early."""
    fresh = [*_BYTES, b"", b""]
    out, table, n, width, grows, held, bits, last = [], list(fresh), 258, 9, 511, 0, 0, None
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & ((1 << bits) - 1)
        if code == 256:
            table, n, width, grows, last = list(fresh), 258, 9, 511, None
            continue
        if code == 257:
            break
        if code < n:
            entry = table[code]
        elif code == n and last is not None:
            entry = last + last[:1]
        else:
            raise DecodeError(f"LZWDecode: code {code} isn't in the table")
        out.append(entry)
        if last is not None and n < 4096:
            table.append(last + entry[:1])
            n += 1
            if n >= grows and width < 12:
                width, grows = width + 1, grows * 2 + 1
        last = entry
    if sum(map(len, out)) >= LIMIT:
        raise DecodeError("LZWDecode: decompressed data is too large")
    return b"".join(out)


def run_length(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        if n == 128:
            break
        if n < 128:
            part, at = data[at + 1 : at + n + 2], at + n + 2
            if at > len(data):
                raise DecodeError("RunLengthDecode: a literal run is cut off")
            out += part
        else:
            if at + 1 >= len(data):
                raise DecodeError("RunLengthDecode: a repeated byte is missing")
            out += data[at + 1 : at + 2] * (257 - n)
            at += 2
    return bytes(out)


FILTERS = {"FlateDecode": flate, "ASCII85Decode": ascii85, "ASCIIHexDecode": ascii_hex, "LZWDecode": lzw, "RunLengthDecode": run_length}


def decode(data: bytes, filters: list[str]) -> tuple[bytes, str | None]:
    """Undo the filters in order; at a failure, what was reached so far and a warning."""
    for name in filters:
        step = FILTERS.get(name)
        if step is None:
            return data, f"unsupported filter: {name}"
        try:
            data = step(data)
        except DecodeError as e:
            return data, str(e)
    return data, None


def is_binary(data: bytes) -> bool:
    """Whether any byte isn't an ASCII letter, digit, white space or punctuation."""
    return bool(data.translate(None, _TEXT_BYTES))


def hex_dump(data: bytes) -> str:
    """Sixteen bytes a line: offset, two groups of eight, and what is printable."""
    lines = []
    for at in range(0, len(data), 16):
        row = data[at : at + 16]
        left, right = (" ".join(f"{b:02x}" for b in part) for part in (row[:8], row[8:]))
        shown = "".join(chr(b) if 0x20 <= b <= 0x7E else "." for b in row)
        lines.append(f"{at:08x}  {left:<23}  {right:<23}  |{shown}|\n")
    return "".join(lines)


# The writer's side: what these filters undo.


def to_ascii85(data: bytes) -> bytes:
    pad = -len(data) % 4
    values = np.frombuffer(data + bytes(pad), ">u4").astype(np.int64)
    digits = (values[:, None] // _POWERS85 % 85 + 0x21).astype(np.uint8)
    whole = len(data) // 4
    if values[:whole].all():
        return digits.tobytes()[: len(digits) * 5 - pad] + b"~>"
    # A whole group of zeros is one letter.
    return b"".join(b"z" if i < whole and not v else d.tobytes() for i, (v, d) in enumerate(zip(values, digits, strict=True)))[: -pad or None] + b"~>"


def to_ascii_hex(data: bytes) -> bytes:
    return data.hex().encode() + b">"


_RUN = re.compile(rb"(.)\1{2,127}", re.DOTALL)


def to_run_length(data: bytes) -> bytes:
    out, at = [], 0
    for m in [*_RUN.finditer(data), None]:
        # What lies before a run goes in pieces of 128 bytes at most.
        stop = m.start() if m else len(data)
        for i in range(at, stop, 128):
            part = data[i : min(i + 128, stop)]
            out += (_BYTES[len(part) - 1], part)
        if m:
            at = m.end()
            out += (_BYTES[257 - (at - stop)], m[1])
    return b"".join(out) + b"\x80"


def to_lzw(data: bytes) -> bytes:
    value, bits, width, grows = 256, 9, 9, 511
    out, table, n, last = bytearray(), dict(_CODES), 258, b""
    for byte in map(_BYTES.__getitem__, data):
        grown = last + byte
        if grown in table:
            last = grown
            continue
        value, bits = value << width | table[last], bits + width
        if bits > 512:
            # Whole bytes leave, so that numbers stay short.
            bits, rest = bits & 7, bits >> 3
            out += (value >> bits).to_bytes(rest, "big")
            value &= (1 << bits) - 1
        if n < 4096:
            table[grown] = n
            n += 1
        # The reader is one entry behind, and widens one code early.
        if n > grows and width < 12:
            width, grows = width + 1, grows * 2 + 1
        if n >= 4094:
            value, bits = value << width | table[byte], bits + width
            value, bits = value << 12 | 256, bits + 12
            table, n, width, grows, last = dict(_CODES), 258, 9, 511, b""
            continue
        last = byte
    if last:
        value, bits = value << width | table[last], bits + width
        width = 9 if n < 511 else 10 if n < 1023 else 11 if n < 2047 else 12
    value, bits = value << width | 257, bits + width
    pad = -bits % 8
    return bytes(out) + (value << pad).to_bytes((bits + pad) // 8, "big")


ENCODERS = {"FlateDecode": zlib.compress, "ASCII85Decode": to_ascii85, "ASCIIHexDecode": to_ascii_hex, "LZWDecode": to_lzw, "RunLengthDecode": to_run_length}
