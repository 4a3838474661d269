"""Single-byte base encodings, and glyph names."""

from __future__ import annotations

import re
import unicodedata
from functools import cache

from .glyphs import by_rule

# Codes 0xA1 to 0xFB of StandardEncoding, by the public specification's table of Latin character sets.
STANDARD_HIGH = {
    0xA1: "¡", 0xA2: "¢", 0xA3: "£", 0xA4: "⁄", 0xA5: "¥", 0xA6: "ƒ", 0xA7: "§", 0xA8: "¤", 0xA9: "'", 0xAA: "“", 0xAB: "«", 0xAC: "‹", 0xAD: "›", 0xAE: "fi", 0xAF: "fl",
    0xB1: "–", 0xB2: "†", 0xB3: "‡", 0xB4: "·", 0xB6: "¶", 0xB7: "•", 0xB8: "‚", 0xB9: "„", 0xBA: "”", 0xBB: "»", 0xBC: "…", 0xBD: "‰", 0xBF: "¿",
    0xC1: "`", 0xC2: "´", 0xC3: "ˆ", 0xC4: "˜", 0xC5: "¯", 0xC6: "˘", 0xC7: "˙", 0xC8: "¨", 0xCA: "˚", 0xCB: "¸", 0xCD: "˝", 0xCE: "˛", 0xCF: "ˇ", 0xD0: "—",
    0xE1: "Æ", 0xE3: "ª", 0xE8: "Ł", 0xE9: "Ø", 0xEA: "Œ", 0xEB: "º", 0xF1: "æ", 0xF5: "ı", 0xF8: "ł", 0xF9: "ø", 0xFA: "œ", 0xFB: "ß",
}
# Glyphs of MacExpertEncoding that stand for ordinary text, by the same specification.
MAC_EXPERT = {
    0x20: " ", 0x2B: "⁄", 0x2C: ",", 0x2D: "-", 0x2E: ".", 0x2F: "⁄", **{0x30 + d: str(d) for d in range(10)}, 0x3A: ":", 0x3B: ";", 0x3D: "—",
    0x47: "¼", 0x48: "½", 0x49: "¾", 0x4A: "⅛", 0x4B: "⅜", 0x4C: "⅝", 0x4D: "⅞", 0x4E: "⅓", 0x4F: "⅔", 0x56: "ff", 0x57: "fi", 0x58: "fl", 0x59: "ffi", 0x5A: "ffl",
    **{0x61 + i: chr(0x41 + i) for i in range(26)},
}
#: The fourteen standard fonts that show text; without an encoding they use StandardEncoding.
STANDARD_14_TEXT = frozenset(
    "Helvetica Helvetica-Bold Helvetica-Oblique Helvetica-BoldOblique Courier Courier-Bold Courier-Oblique Courier-BoldOblique "
    "Times-Roman Times-Bold Times-Italic Times-BoldItalic".split()
)
# Glyph names that neither a letter's own name nor its Unicode name gives.
NAMES = {
    "space": " ", "exclam": "!", "quotedbl": '"', "numbersign": "#", "dollar": "$", "percent": "%", "ampersand": "&", "quotesingle": "'", "parenleft": "(", "parenright": ")",
    "asterisk": "*", "plus": "+", "comma": ",", "hyphen": "-", "period": ".", "slash": "/", "colon": ":", "semicolon": ";", "less": "<", "equal": "=", "greater": ">",
    "question": "?", "at": "@", "bracketleft": "[", "backslash": "\\", "bracketright": "]", "asciicircum": "^", "underscore": "_", "grave": "`", "braceleft": "{", "bar": "|",
    "braceright": "}", "asciitilde": "~", "quoteleft": "‘", "quoteright": "’", "quotedblleft": "“", "quotedblright": "”", "quotesinglbase": "‚", "quotedblbase": "„",
    "bullet": "•", "ellipsis": "…", "endash": "–", "emdash": "—", "dagger": "†", "daggerdbl": "‡", "perthousand": "‰", "guilsinglleft": "‹", "guilsinglright": "›",
    "guillemotleft": "«", "guillemotright": "»", "fi": "fi", "fl": "fl", "ff": "ff", "ffi": "ffi", "ffl": "ffl", "fraction": "⁄", "florin": "ƒ", "Euro": "€", "trademark": "™",
    "copyright": "©", "registered": "®", "degree": "°", "paragraph": "¶", "section": "§", "currency": "¤", "cent": "¢", "sterling": "£", "yen": "¥", "exclamdown": "¡",
    "questiondown": "¿", "ordfeminine": "ª", "ordmasculine": "º", "onesuperior": "¹", "twosuperior": "²", "threesuperior": "³", "onequarter": "¼", "onehalf": "½",
    "threequarters": "¾", "multiply": "×", "divide": "÷", "plusminus": "±", "logicalnot": "¬", "mu": "µ", "periodcentered": "·", "brokenbar": "¦", "macron": "¯", "dieresis": "¨",
    "acute": "´", "cedilla": "¸", "circumflex": "ˆ", "tilde": "˜", "breve": "˘", "dotaccent": "˙", "ring": "˚", "hungarumlaut": "˝", "ogonek": "˛", "caron": "ˇ", "minus": "−",
    "germandbls": "ß", "AE": "Æ", "ae": "æ", "OE": "Œ", "oe": "œ", "Oslash": "Ø", "oslash": "ø", "Lslash": "Ł", "lslash": "ł", "Eth": "Ð", "eth": "ð", "Thorn": "Þ", "thorn": "þ",
    "dotlessi": "ı", "nbspace": " ", "sfthyphen": "­", "infinity": "∞", "notequal": "≠", "lessequal": "≤", "greaterequal": "≥", "summation": "∑", "product": "∏",
    "radical": "√", "integral": "∫", "partialdiff": "∂", "lozenge": "◊", "approxequal": "≈", "Omega": "Ω", "Delta": "∆",
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
}
_ACCENTS = {
    "acute": "ACUTE", "grave": "GRAVE", "circumflex": "CIRCUMFLEX", "dieresis": "DIAERESIS", "tilde": "TILDE", "ring": "RING ABOVE", "cedilla": "CEDILLA", "caron": "CARON",
    "macron": "MACRON", "breve": "BREVE", "ogonek": "OGONEK", "dotaccent": "DOT ABOVE", "hungarumlaut": "DOUBLE ACUTE", "commaaccent": "CEDILLA",
}


@cache
def table(name: str | None) -> dict[int, str] | None:
    """Code to text for a base encoding's name; None for a name that isn't one."""
    if name == "WinAnsiEncoding":
        out = {c: bytes([c]).decode("cp1252", "ignore") for c in range(0x20, 0x100) if c != 0x7F}
    elif name == "MacRomanEncoding":
        out = {c: bytes([c]).decode("mac_roman") for c in range(0x20, 0x100) if c != 0x7F} | {0xDE: "fi", 0xDF: "fl", 0xCA: " "}
    elif name == "StandardEncoding":
        out = {c: chr(c) for c in range(0x20, 0x7F)} | {0x27: "’", 0x60: "‘"} | STANDARD_HIGH
    elif name == "MacExpertEncoding":
        out = MAC_EXPERT
    else:
        return None
    return {c: t for c, t in out.items() if t}


@cache
def glyph(name: str) -> str | None:
    """Text of a glyph name: known names, those that follow from Unicode's, then uniXXXX and uXXXXXX; parts joined by _."""
    parts = [_component(p) for p in name.split(".")[0].split("_")]
    return "".join(parts) if name and all(p is not None for p in parts) and any(parts) else None


def _component(name: str) -> str | None:
    if name in NAMES:
        return NAMES[name]
    if len(name) == 1 and name.isascii() and name.isalpha():
        return name
    for accent, said in _ACCENTS.items():
        if name.endswith(accent) and len(base := name.removesuffix(accent)) == 1 and base.isascii() and base.isalpha():
            try:
                return unicodedata.lookup(f"LATIN {'CAPITAL' if base.isupper() else 'SMALL'} LETTER {base} WITH {said}")
            except KeyError:
                return None
    try:
        if name[:1].isascii() and name.isalpha():
            return unicodedata.lookup(f"GREEK {'CAPITAL' if name[0].isupper() else 'SMALL'} LETTER {name}")
    except KeyError:
        pass
    if (found := by_rule(name)) is not None:
        return found
    if re.fullmatch(r"uni(?:[0-9A-F]{4})+", name):
        try:
            return bytes.fromhex(name[3:]).decode("utf-16-be")
        except UnicodeDecodeError:
            return None
    if re.fullmatch(r"u[0-9A-F]{4,6}", name):
        code = int(name[1:], 16)
        return chr(code) if code <= 0x10FFFF and not 0xD800 <= code < 0xE000 else None
    return None
