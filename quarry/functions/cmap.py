"""ToUnicode character maps."""

from __future__ import annotations

import re
import struct
from functools import lru_cache

_TOKEN = re.compile(rb"%[^\r\n]*|<<|>>|<([0-9A-Fa-f\s]*)>|(\[)|(\])|\((?:\\.|[^\\)])*\)|/?([^\s<>\[\]()/%]+)", re.DOTALL)
OPEN, CLOSE = object(), object()


def _tokens(data: bytes) -> list:
    """Hex strings as bytes, brackets, and keywords as text."""
    out: list = []
    for m in _TOKEN.finditer(data):
        if m[1] is not None:
            digits = re.sub(rb"\s", b"", m[1])
            out.append(bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()))
        elif m[2]:
            out.append(OPEN)
        elif m[3]:
            out.append(CLOSE)
        elif m[4]:
            out.append(m[4].decode("latin-1"))
    return out


def _text(units: bytes) -> str:
    return (units[:-1] if len(units) % 2 and len(units) > 1 else units.rjust(2, b"\0") if len(units) == 1 else units).decode("utf-16-be", "replace")


#: Codes whose text, and parts whose code space, a map remembers, and bytes of a map that is kept for the next file with the same.
MOST_MET, MOST_KEPT = 1 << 13, 1 << 16


class CMap:
    """Code spaces, single codes and ranges. A range costs the same however many codes it spans."""

    def __init__(self, data: bytes):
        self.spaces: list[tuple[bytes, bytes]] = []
        self.single: dict[int, str] = {}
        self.ranges: list[tuple[int, int, bytes | list[str]]] = []
        self.met: dict[int, str | None] = {}
        self.spaced: dict[bytes, bool] = {}
        tokens, at = _tokens(data), 0
        readers = {"begincodespacerange": self._space, "beginbfchar": self._char, "beginbfrange": self._range}
        while at < len(tokens):
            read = readers.get(tokens[at]) if isinstance(tokens[at], str) else None
            at += 1
            if read:
                at = self._section(tokens, at, read)
        self.widths = sorted({len(low) for low, _ in self.spaces})

    @staticmethod
    def _section(tokens: list, at: int, read) -> int:
        while at < len(tokens):
            if isinstance(tokens[at], str) and tokens[at].startswith("end"):
                return at + 1
            at = read(tokens, at) if isinstance(tokens[at], bytes) else at + 1
        return at

    def _space(self, tokens: list, at: int) -> int:
        low, high = tokens[at], tokens[at + 1] if at + 1 < len(tokens) else None
        if isinstance(high, bytes):
            width = min(4, max(1, len(low)))
            self.spaces.append((low[:width].ljust(width, b"\0"), high[:width].ljust(width, b"\xff")))
        return at + 2

    def _char(self, tokens: list, at: int) -> int:
        to = tokens[at + 1] if at + 1 < len(tokens) else None
        if isinstance(to, bytes):
            self.single[int.from_bytes(tokens[at], "big")] = _text(to)
        return at + 2

    def _range(self, tokens: list, at: int) -> int:
        low, high, to = (*tokens[at : at + 3], None, None)[:3]
        if not isinstance(high, bytes):
            return at + 1
        bounds = int.from_bytes(low, "big"), int.from_bytes(high, "big")
        if isinstance(to, bytes):
            self.ranges.append((*bounds, to))
            return at + 3
        if to is not OPEN:
            return at + 2
        end = at + 3
        while end < len(tokens) and tokens[end] is not CLOSE:
            end += 1
        self.ranges.append((*bounds, [_text(t) for t in tokens[at + 3 : end] if isinstance(t, bytes)]))
        return end + 1

    @property
    def empty(self) -> bool:
        return not self.single and not self.ranges

    def get(self, code: int) -> str | None:
        """The text of a code; one that was met is remembered."""
        if code not in self.met:
            if len(self.met) >= MOST_MET:
                self.met.clear()
            self.met[code] = self._find(code)
        return self.met[code]

    def texts(self, data: bytes, default_width: int) -> list[str | None]:
        """The text of each code in a shown string."""
        met, get = self.met, self.get
        return [met[c] if c in met else get(c) for c in self.codes(data, default_width)]

    def _in_space(self, part: bytes) -> bool:
        """Whether a code space of the part's width holds it."""
        if (found := self.spaced.get(part)) is None:
            if len(self.spaced) >= MOST_MET:
                self.spaced.clear()
            w = len(part)
            found = self.spaced[part] = any(len(a) == w and all(x <= c <= y for x, c, y in zip(a, part, b, strict=True)) for a, b in self.spaces)
        return found

    def _find(self, code: int) -> str | None:
        if code in self.single:
            return self.single[code]
        for low, high, to in self.ranges:
            if low <= code <= high:
                if isinstance(to, list):
                    return to[code - low] if code - low < len(to) else None
                if len(to) < 2:
                    return chr((to[0] if to else 0) + code - low)
                last = int.from_bytes(to[-2:], "big") + code - low
                return _text(to[:-2] + (last & 0xFFFF).to_bytes(2, "big"))
        return None

    def codes(self, data: bytes, default_width: int):
        """The codes in a shown string: of one width, or by the shortest code space that holds them."""
        widths = self.widths
        if len(widths) <= 1:
            w = widths[0] if widths else default_width
            if w == 1:
                return list(data)
            if w == 2:
                n = len(data) // 2
                return [*struct.unpack_from(f">{n}H", data), *data[2 * n :]]
            return [int.from_bytes(data[at : at + w], "big") for at in range(0, len(data), w)]
        out, at, number = [], 0, int.from_bytes
        while at < len(data):
            for w in widths:
                part = data[at : at + w]
                if len(part) == w and self._in_space(part):
                    break
            else:
                part = data[at : at + widths[0]]
            out.append(number(part, "big"))
            at += len(part)
        return out


_kept = lru_cache(8)(CMap)


def cmap_of(data: bytes) -> CMap:
    """The map that is spelled so; small ones are kept for further files."""
    return _kept(data) if len(data) <= MOST_KEPT else CMap(data)


