"""Text of pages: fonts choose how shown bytes become characters, and how far to trust the result."""

from __future__ import annotations

import re
from codecs import charmap_decode
from dataclasses import dataclass, field
from functools import cache

from ..sources.document import Document
from ..sources.objects import Name, Ref, Stream, SyntaxProblem, Text, operations
from . import encodings
from .cmap import cmap_of

RELIABLE, DEGRADED, UNRELIABLE = "reliable", "degraded", "unreliable"
ORDER = {RELIABLE: 0, DEGRADED: 1, UNRELIABLE: 2}
#: Share of codes without a character above which a document's text is degraded.
UNMAPPED_SHARE = 0.20
MAX_FORM_DEPTH = 15
_UNPRINTABLE = re.compile(r"[^ -~]+")
LOST = "�"


@dataclass
class FontReport:
    name: str
    base_font: str
    subtype: str
    classification: str
    has_to_unicode: bool
    reason: str


@dataclass
class PageText:
    text: str = ""
    warnings: list[str] = field(default_factory=list)
    fonts: list[FontReport] = field(default_factory=list)
    total: int = 0
    unmapped: int = 0


def name_at(d: dict, key: str, default: str = "") -> str:
    v = d.get(key)
    return str(v) if isinstance(v, Name) else default


def differences(doc: Document, font: dict) -> tuple[dict[int, str], int, int]:
    """Texts by code, names in all, and names without a text, of a font's /Differences."""
    encoding = doc.dict_of(font.get("Encoding"))
    items = doc.list_of(encoding.get("Differences")) if encoding else None
    out, code, total, lost = {}, 0, 0, 0
    for item in items or []:
        if isinstance(item, Name):
            text = encodings.glyph(item)
            total, lost = total + 1, lost + (text is None)
            if 0 <= code <= 255:
                out[code] = LOST if text is None else text
            code += 1
        elif isinstance(item, int):
            code = item
    return out, total, lost


@cache
def _whole_table(named: str) -> tuple[dict[int, str], str | None]:
    """A base encoding's texts of all 256 codes, and the same in one string if each is one character."""
    base = encodings.table(named)
    out = {c: base.get(c, LOST) for c in range(256)}
    spelled = "".join(out[c] for c in range(256))
    # U+FFFE in a table means to Python's decoder that there is no character.
    return out, spelled if all(len(t) == 1 for t in out.values()) and "\ufffe" not in spelled else None


class Font:
    """How a font's codes are read: a map to Unicode, tables of single bytes, or bytes as they are."""

    def __init__(self, doc: Document, resource: str, font: dict):
        subtype, base_font = name_at(font, "Subtype"), name_at(font, "BaseFont", "-")
        cid = subtype in ("Type0", "CIDFontType0", "CIDFontType2")
        self.cmap, self.table, self.spelled, self.width = None, None, None, 2 if cid else 1
        said = (RELIABLE, "")
        to_unicode = font.get("ToUnicode")
        stream = doc.objects.get(to_unicode) if isinstance(to_unicode, Ref) else None
        if isinstance(stream, Stream):
            cmap = cmap_of(doc.decode(stream)[0])
            self.cmap = None if cmap.empty else cmap
        if self.cmap is None and cid:
            said = (UNRELIABLE, "CID/Type0 font without a ToUnicode map")
        elif self.cmap is None:
            said = self._simple(doc, font, base_font)
        self.report = FontReport(f"/{resource}", base_font, subtype, said[0], "ToUnicode" in font, said[1])

    def _simple(self, doc: Document, font: dict, base_font: str) -> tuple[str, str]:
        encoding = doc.get(font.get("Encoding"))
        named = str(encoding) if isinstance(encoding, Name) else name_at(encoding, "BaseEncoding") if isinstance(encoding, dict) else None
        base = encodings.table(named)
        if base is None and base_font in encodings.STANDARD_14_TEXT:
            named, base = "StandardEncoding", encodings.table("StandardEncoding")
        own, total, lost = differences(doc, font)
        if own or base is not None:
            if base is None:
                self.table = {c: bytes([c]).decode("utf-8", "replace") for c in range(256)} | own
            elif own:
                self.table = _whole_table(named)[0] | own
            else:
                self.table, self.spelled = _whole_table(named)
            return (DEGRADED, f"{lost} of {total} /Differences glyph name(s) unresolved by the Adobe Glyph List") if lost else (RELIABLE, "")
        if base_font in ("Symbol", "ZapfDingbats"):
            return DEGRADED, "symbolic font without a ToUnicode map"
        return DEGRADED, "no ToUnicode map or recognized encoding"

    def show(self, data: bytes) -> list[str] | str:
        """The text of each code; where each is one character, as a string."""
        if self.cmap is not None:
            return [LOST if t is None else t for t in self.cmap.texts(data, self.width)]
        if self.spelled is not None:
            return charmap_decode(data, "strict", self.spelled)[0]
        if self.table is not None:
            return [self.table[b] for b in data]
        return data.decode("utf-8", "replace")


class Interpreter:
    """Reads pages of one document. Fonts are built once for each font object."""

    def __init__(self, doc: Document):
        self.doc, self.fonts = doc, {}

    def page(self, page: Ref) -> PageText:
        doc, out = self.doc, PageText()
        data, warnings = doc.content(page)
        out.warnings += warnings
        resources = doc.dict_of(doc.inherited(page, "Resources"))
        self.parts: list[str] = []
        self.began = False
        self._run(data, resources, out, [], 0)
        out.text = "".join(self.parts)
        out.warnings += legacy_warnings(doc, page)
        return out

    def _table(self, resources: dict | None, out: PageText) -> dict[str, Font]:
        fonts = self.doc.dict_of(resources.get("Font")) if resources else None
        made = {}
        for resource, value in (fonts or {}).items():
            font = self.doc.dict_of(value)
            if font is None:
                continue
            key = (value, resource) if isinstance(value, Ref) else None
            made[resource] = self.fonts.get(key) or Font(self.doc, resource, font)
            if key:
                self.fonts[key] = made[resource]
            out.fonts.append(made[resource].report)
        return made

    def _newline(self) -> None:
        if self.parts and not self.parts[-1].endswith("\n"):
            self.parts.append("\n")

    def _show(self, value, font: Font | None, out: PageText) -> None:
        if not isinstance(value, Text):
            return
        shown = font.show(value) if font else value.decode("utf-8", "replace")
        out.total += len(shown)
        out.unmapped += shown.count(LOST)
        if text := shown if type(shown) is str else "".join(shown):
            self.parts.append(text)

    def _run(self, data: bytes, resources: dict | None, out: PageText, active: list[Ref], depth: int) -> None:
        try:
            found = operations(data)
        except SyntaxProblem:
            out.warnings.append("Content stream has syntax errors")
            return
        fonts, font = self._table(resources, out), None
        for operator, operands in found:
            if operator == "BT":
                if self.began:
                    self._newline()
                self.began = True
            elif operator == "Tf":
                font = fonts.get(operands[0]) if operands and isinstance(operands[0], Name) else None
            elif operator in ("Td", "TD"):
                if len(operands) >= 2 and isinstance(operands[1], (int, float)) and operands[1] < 0:
                    self.parts.append("\n")
            elif operator == "T*":
                self.parts.append("\n")
            elif operator == "Tj":
                self._show(operands[0] if operands else None, font, out)
            elif operator == "TJ":
                for item in operands[0] if operands and isinstance(operands[0], list) else []:
                    if isinstance(item, Text):
                        self._show(item, font, out)
                    elif isinstance(item, (int, float)) and item < -100:
                        self.parts.append(" ")
            elif operator == "'":
                self.parts.append("\n")
                self._show(operands[0] if operands else None, font, out)
            elif operator == '"':
                self.parts.append("\n")
                self._show(operands[2] if len(operands) > 2 else None, font, out)
            elif operator == "Do":
                self._form(operands, resources, out, active, depth)

    def _form(self, operands: list, resources: dict | None, out: PageText, active: list[Ref], depth: int) -> None:
        forms = self.doc.dict_of(resources.get("XObject")) if resources and operands else None
        ref = forms.get(operands[0]) if forms else None
        form = self.doc.get(ref)
        if not isinstance(form, Stream) or form.dict.get("Subtype") != "Form" or ref in active:
            return
        if depth >= MAX_FORM_DEPTH:
            out.warnings.append(f"form XObjects are nested deeper than {MAX_FORM_DEPTH}")
            return
        data, warning = self.doc.decode(form)
        if warning:
            out.warnings.append(f"form XObject /{operands[0]}: {warning}")
        own = self.doc.dict_of(form.dict.get("Resources"))
        self._run(data, own if own is not None else resources, out, [*active, ref], depth + 1)


def legacy_warnings(doc: Document, page: Ref) -> list[str]:
    """Warnings on fonts in a page's own resources whose codes nothing explains."""
    node = doc.objects.get(page)
    resources = doc.dict_of(node.get("Resources")) if isinstance(node, dict) else None
    fonts = doc.dict_of(resources.get("Font")) if resources else None
    out = []
    for resource, value in (fonts or {}).items():
        font = doc.dict_of(value)
        if font is None or "ToUnicode" in font:
            continue
        encoding = doc.get(font.get("Encoding"))
        if isinstance(encoding, dict) or isinstance(encoding, Name) and (isinstance(font["Encoding"], Ref) or encodings.table(encoding) is not None):
            continue
        subtype, base_font = name_at(font, "Subtype"), name_at(font, "BaseFont", resource)
        if subtype in ("Type0", "CIDFontType0", "CIDFontType2"):
            out.append(f"Font /{resource} ({base_font}) uses CID encoding without ToUnicode map. Text may be inaccurate.")
        elif subtype in ("Type1", "TrueType", "Type3") and base_font not in encodings.STANDARD_14_TEXT | {"Symbol", "ZapfDingbats"}:
            out.append(f"Font /{resource} ({base_font}) has no explicit encoding or ToUnicode map. Text may be inaccurate.")
    return out


def verdict(fonts: list[FontReport], total: int, unmapped: int) -> str:
    """A document's reliability: its worst font's, and degraded at best where many codes have no character."""
    worst = max((f.classification for f in fonts), key=ORDER.__getitem__, default=RELIABLE)
    return DEGRADED if worst == RELIABLE and total and unmapped / total > UNMAPPED_SHARE else worst


def garbled(text: str, warnings: list[str]) -> bool:
    """Whether the text is to be doubted: fonts without a map were warned of, or most of it is outside printable ASCII."""
    shown = "".join(text.split())
    if shown and any(w in s.lower() for s in warnings for w in ("cid", "encoding", "tounicode")):
        return True
    return 2 * sum(map(len, _UNPRINTABLE.findall(shown))) > len(shown)


def snippets(text: str, pattern: str, reach: int = 40) -> list[str]:
    """Each place of pattern, without regard to case, with reach bytes of context on both sides."""
    if not pattern:
        return []
    raw, low, sought, n = text.encode(), text.lower().encode(), pattern.lower().encode(), len(pattern.encode())
    out, at = [], low.find(sought)
    while at >= 0:
        start, end = min(max(0, at - reach), len(raw)), min(at + n + reach, len(raw))
        while start > 0 and start < len(raw) and raw[start] & 0xC0 == 0x80:
            start -= 1
        while end < len(raw) and raw[end] & 0xC0 == 0x80:
            end += 1
        body = raw[start:end].decode("utf-8", "replace").replace("\n", " ").strip()
        out.append(("..." if start else "") + body + ("..." if end < len(raw) else ""))
        at = low.find(sought, at + n)
    return out
