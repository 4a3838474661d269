"""PDF objects and the reader of their syntax."""

from __future__ import annotations

import re
from typing import NamedTuple


class SyntaxProblem(ValueError):
    pass


class Name(str):
    __slots__ = ()


class Text(bytes):
    """A string object; hex tells how it was written."""

    hex = False


class Ref(NamedTuple):
    num: int
    gen: int


class Keyword(bytes):
    __slots__ = ()


class Stream:
    __slots__ = ("dict", "raw")

    def __init__(self, dictionary: dict, raw: bytes):
        self.dict, self.raw = dictionary, raw


def lossy(data: bytes) -> str:
    return bytes(data).decode("utf-8", "replace")


_SKIP = re.compile(rb"(?:[\0\t\n\f\r ]+|%[^\r\n]*)*")
_NUMBER = re.compile(rb"[+-]?(?:\d+\.?\d*|\.\d+)")
_REF = re.compile(rb"(\d{1,10})[\0\t\n\f\r ]+(\d{1,5})[\0\t\n\f\r ]+R(?![^\0\t\n\f\r ()<>\[\]{}/%])")
_NAME = re.compile(rb"/([^\0\t\n\f\r ()<>\[\]{}/%]*)")
_WORD = re.compile(rb"[^\0\t\n\f\r ()<>\[\]{}/%]+")
_HEX_NAME = re.compile(rb"#([0-9A-Fa-f]{2})")
_STRING_PART = re.compile(rb"[^()\\\r]+")
_OCTAL = re.compile(rb"[0-7]{1,3}")
# What a backslash means before these letters.
_ESCAPES = {0x6E: b"\n", 0x72: b"\r", 0x74: b"\t", 0x62: b"\b", 0x66: b"\f", 0x28: b"(", 0x29: b")", 0x5C: b"\\"}
#: Arrays and dictionaries nested deeper than this are refused.
MAX_DEPTH = 100


#: A token after white space and comments: a dictionary's end and beginning, a name, a reference (with it, a number is none), a
#: number, a string without brackets and escapes, an array's beginning and end, a word. What isn't one of these is read by the rules.
_BEFORE, _ENDS = rb"(?>(?:[\0\t\n\f\r ]+|%[^\r\n]*)*)", rb"\0\t\n\f\r ()<>\[\]{}/%"
_PLAIN = rb"|([+-]?(?:\d+\.?\d*|\.\d+))|\(([^()\\\r]*)\)|(\[)|(\])|([^" + _ENDS + rb"]+))"
_TOKEN = re.compile(_BEFORE + rb"(?:(>>)|(<<)|/([^" + _ENDS + rb"]*)|(\d{1,10})[\0\t\n\f\r ]+(\d{1,5})[\0\t\n\f\r ]+R(?![^" + _ENDS + rb"])" + _PLAIN)
_CONTENT_TOKEN = re.compile(_BEFORE + rb"(?:/([^" + _ENDS + rb"]*)" + _PLAIN)
_FIXED = {b"true": True, b"false": False, b"null": None}
#: Names and operators met before, by their bytes; they start anew at so many.
_NAMES: dict[bytes, Name] = {}
_OPERATORS: dict[bytes, str] = {}
_MOST_MET = 4096


def _name(raw: bytes) -> Name:
    """The name that is spelled so."""
    if (out := _NAMES.get(raw)) is None:
        if len(_NAMES) >= _MOST_MET:
            _NAMES.clear()
        out = _NAMES[raw] = Name(lossy(_HEX_NAME.sub(lambda h: bytes([int(h[1], 16)]), raw) if b"#" in raw else raw))
    return out


class Reader:
    """Reads objects from bytes; pos is where it stands."""

    def __init__(self, data: bytes, pos: int = 0, references: bool = True):
        self.data, self.pos, self.references = data, pos, references

    def skip(self) -> None:
        self.pos = _SKIP.match(self.data, self.pos).end()

    def at_end(self) -> bool:
        self.skip()
        return self.pos >= len(self.data)

    def keyword(self, word: bytes) -> bool:
        self.skip()
        if self.data.startswith(word, self.pos):
            self.pos += len(word)
            return True
        return False

    def integer(self) -> int:
        self.skip()
        m = _NUMBER.match(self.data, self.pos)
        if not m or b"." in m[0]:
            raise SyntaxProblem(f"an integer is missing at {self.pos}")
        self.pos = m.end()
        return int(m[0])

    def object(self, depth: int = 0):
        """The next object; a Keyword for a bare word."""
        self.skip()
        data, at = self.data, self.pos
        if at >= len(data):
            raise SyntaxProblem("the data ends where an object should be")
        if depth > MAX_DEPTH:
            raise SyntaxProblem("objects are nested too deeply")
        c = data[at]
        if c == 0x2F:
            m = _NAME.match(data, at)
            self.pos = m.end()
            return _name(m[1])
        if c == 0x28:
            return self._literal()
        if c == 0x3C:
            return self._dictionary(depth) if data.startswith(b"<<", at) else self._hex()
        if c == 0x5B:
            self.pos += 1
            out = []
            while not self.keyword(b"]"):
                item = self.object(depth + 1)
                if isinstance(item, Keyword):
                    raise SyntaxProblem(f"{item!r} in an array at {self.pos}")
                out.append(item)
            return out
        if c in b"+-.0123456789":
            if self.references and (m := _REF.match(data, at)):
                self.pos = m.end()
                return Ref(int(m[1]), int(m[2]))
            if m := _NUMBER.match(data, at):
                self.pos = m.end()
                return float(m[0]) if b"." in m[0] else int(m[0])
        m = _WORD.match(data, at)
        if not m:
            raise SyntaxProblem(f"unexpected {data[at : at + 1]!r} at {at}")
        self.pos = m.end()
        return _FIXED[m[0]] if m[0] in _FIXED else Keyword(m[0])

    def _dictionary(self, depth: int) -> dict:
        self.pos += 2
        out: dict = {}
        if self.references and depth < MAX_DEPTH and self._plain(out, depth):
            return out
        while not self.keyword(b">>"):
            key = self.object(depth + 1)
            if not isinstance(key, Name):
                raise SyntaxProblem(f"a dictionary's key isn't a name at {self.pos}")
            value = self.object(depth + 1)
            if isinstance(value, Keyword):
                raise SyntaxProblem(f"{value!r} in a dictionary at {self.pos}")
            out[key] = value
        return out

    def _plain(self, out: dict, depth: int) -> bool:
        """Reads a dictionary's entries, those of dictionaries and arrays in it too, token by token, as long as they are plain. False
        leaves pos after the last entry of this dictionary that was; what follows is read by the rules."""
        data, match, held = self.data, _TOKEN.match, out
        stack: list = []  # what is open around held, with its key
        pos, key = self.pos, None
        while m := match(data, pos):
            pos, kind = m.end(), m.lastindex
            if kind == 3 and key is None and type(held) is dict:
                key = _name(m[3])
                continue
            if kind == 5:
                value = tuple.__new__(Ref, (int(m[4]), int(m[5])))
            elif kind == 3:
                value = _name(m[3])
            elif kind == 6:
                value = float(m[6]) if b"." in m[6] else int(m[6])
            elif kind == 7:
                value = Text(m[7])
            elif kind == 10 and m[10] in _FIXED:
                value = _FIXED[m[10]]
            elif kind in (2, 8) and (key is not None or type(held) is list):
                if depth + len(stack) + 1 >= MAX_DEPTH:
                    break
                stack.append((held, key))
                held, key = {} if kind == 2 else [], None
                continue
            elif kind == 1 and key is None and type(held) is dict or kind == 9 and type(held) is list:
                if not stack:
                    self.pos = pos
                    return True
                value = held
                held, key = stack.pop()
            else:
                break
            if type(held) is list:
                held.append(value)
            elif key is not None:
                held[key] = value
                key = None
            else:
                break
            if not stack:
                self.pos = pos
        return False

    def _hex(self) -> Text:
        end = self.data.find(b">", self.pos)
        if end < 0:
            raise SyntaxProblem("a hexadecimal string isn't closed")
        digits = self.data[self.pos + 1 : end].translate(None, b"\0\t\n\f\r ")
        self.pos = end + 1
        try:
            out = Text(bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode("ascii")))
        except ValueError as e:
            raise SyntaxProblem("a hexadecimal string has other characters") from e
        out.hex = True
        return out

    def _literal(self) -> Text:
        data, at, depth, out = self.data, self.pos + 1, 1, []
        while True:
            if m := _STRING_PART.match(data, at):
                out.append(m[0])
                at = m.end()
            if at >= len(data):
                raise SyntaxProblem("a string isn't closed")
            c = data[at]
            at += 1
            if c == 0x28:
                depth += 1
            elif c == 0x29:
                depth -= 1
                if not depth:
                    break
            elif c == 0x0D:
                at += data[at : at + 1] == b"\n"
                out.append(b"\n")
                continue
            else:
                c = data[at] if at < len(data) else 0x5C
                at += 1
                if c in _ESCAPES:
                    out.append(_ESCAPES[c])
                elif 0x30 <= c <= 0x37:
                    m = _OCTAL.match(data, at - 1)
                    out.append(bytes([int(m[0], 8) & 0xFF]))
                    at = m.end()
                elif c == 0x0D:
                    at += data[at : at + 1] == b"\n"
                elif c != 0x0A:
                    out.append(bytes([c]))
                continue
            out.append(bytes([c]))
        self.pos = at
        return Text(b"".join(out))


def operations(data: bytes) -> list[tuple[str, list]]:
    """Operators of a content stream, each with its operands. Raises SyntaxProblem where it can't be read."""
    read, out, operands = Reader(data, references=False), [], []
    match, pos = _CONTENT_TOKEN.match, 0
    while True:
        # Plain tokens at once; what isn't one is read by the rules.
        while m := match(data, pos):
            kind = m.lastindex
            if kind == 3:
                operands.append(Text(m[3]))
            elif kind == 6:
                word = m[6]
                if word in _FIXED:
                    operands.append(_FIXED[word])
                elif word == b"BI":
                    break
                else:
                    if (name := _OPERATORS.get(word)) is None:
                        if len(_OPERATORS) >= _MOST_MET:
                            _OPERATORS.clear()
                        name = _OPERATORS[word] = word.decode("latin-1")
                    out.append((name, operands))
                    operands = []
            elif kind == 2:
                operands.append(float(m[2]) if b"." in m[2] else int(m[2]))
            elif kind == 1:
                operands.append(_name(m[1]))
            else:
                break
            pos = m.end()
        read.pos = pos
        if read.at_end():
            break
        item = read.object()
        pos = read.pos
        if not isinstance(item, Keyword):
            operands.append(item)
            continue
        if item == b"BI":
            out.append(("BI", [_inline_image(read)]))
            pos = read.pos
        else:
            out.append((item.decode("latin-1"), operands))
        operands = []
    if operands:
        raise SyntaxProblem("operands without an operator")
    return out


_IMAGE_END = re.compile(rb"[\0\t\n\f\r ]EI(?=[\0\t\n\f\r ]|$)")


def _inline_image(read: Reader) -> Stream:
    entries: dict = {}
    while not read.keyword(b"ID"):
        key = read.object()
        if not isinstance(key, Name):
            raise SyntaxProblem("an inline image's key isn't a name")
        entries[key] = read.object()
    m = _IMAGE_END.search(read.data, read.pos)
    if not m:
        raise SyntaxProblem("an inline image doesn't end")
    raw, read.pos = read.data[read.pos + 1 : m.start()], m.end()
    return Stream(entries, raw)


# Text forms of objects.


def number(x: float) -> str:
    """A number as written in PDF, from single precision."""
    if isinstance(x, int):
        return str(x)
    import numpy as np

    short = np.format_float_positional(np.float32(x), trim="-")
    return short


def shown(value, top: bool = True) -> str:
    """One line of text for a value in a list or dictionary."""
    if value is None:
        return "null"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, (int, float)) and not isinstance(value, Ref):
        return number(value)
    if isinstance(value, Name):
        return f"/{value}"
    if isinstance(value, Text):
        return f"({lossy(value)})"
    if isinstance(value, Ref):
        return f"{value.num} {value.gen} R"
    if isinstance(value, list):
        return "[" + " ".join(map(shown, value)) + "]"
    return "<<...>>"


_KINDS: dict[type, str] = {}


def kind_of(value) -> str:
    """The variant's name."""
    if (found := _KINDS.get(type(value))) is None:
        found = _KINDS[type(value)] = _kind_of(value)
    return found


def _kind_of(value) -> str:
    for kind, name in ((bool, "Boolean"), (Ref, "Reference"), (int, "Integer"), (float, "Real"), (Name, "Name"), (Text, "String"), (list, "Array"), (dict, "Dictionary"), (Stream, "Stream")):
        if isinstance(value, kind):
            return name
    return "Null"


def tagged(value, deref=None) -> dict:
    """A JSON-ready value with its type; deref(ref) adds one level of what a reference points at."""
    if value is None:
        return {"type": "null"}
    if isinstance(value, bool):
        return {"type": "boolean", "value": value}
    if isinstance(value, Ref):
        out = {"generation": value.gen, "object_number": value.num, "type": "reference"}
        if deref is not None:
            out["resolved"] = tagged(deref(value))
        return out
    if isinstance(value, int):
        return {"type": "integer", "value": value}
    if isinstance(value, float):
        return {"type": "real", "value": float(number(value))}
    if isinstance(value, Name):
        return {"type": "name", "value": str(value)}
    if isinstance(value, Text):
        return {"type": "string", "value": lossy(value)}
    if isinstance(value, list):
        return {"items": [tagged(v, deref) for v in value], "type": "array"}
    if isinstance(value, dict):
        return {"entries": {k: tagged(v, deref) for k, v in sorted(value.items())}, "type": "dictionary"}
    return {"dict": tagged(value.dict, deref), "type": "stream"}


#: Values that are a reference or may hold some.
_HOLDERS = (Ref, dict, list)


def references(value, path: str = "", deep: bool = True):
    """(path, Ref) of each reference in a value, in order."""
    stack = [(path, value.dict if isinstance(value, Stream) else value)]
    while stack:
        at, v = stack.pop()
        if isinstance(v, Ref):
            yield at, v
        elif isinstance(v, dict):
            stack.extend([(f"{at}/{k}", x) for k, x in reversed(v.items()) if isinstance(x, _HOLDERS)])
        elif isinstance(v, list):
            stack.extend([(f"{at}[{i}]", v[i]) for i in range(len(v) - 1, -1, -1) if isinstance(v[i], _HOLDERS)])
