"""Glyph names of the public list that follow from the names of Unicode characters, by rule."""

from __future__ import annotations

import unicodedata
from functools import cache

# How the public list spells scripts: its suffix, the beginning of the characters' names, first and last code point.
SCRIPTS = [
    ("hiragana", "HIRAGANA LETTER", 0x3041, 0x309F), ("katakana", "KATAKANA LETTER", 0x30A0, 0x30FF), ("katakanahalfwidth", "HALFWIDTH KATAKANA LETTER", 0xFF65, 0xFF9F),
    ("bopomofo", "BOPOMOFO LETTER", 0x3105, 0x312F), ("arabic", "ARABIC LETTER", 0x0600, 0x06FF), ("arabic", "ARABIC LETTER", 0xFB50, 0xFEFF), ("arabic", "ARABIC", 0x0600, 0x06FF),
    ("arabic", "ARABIC-INDIC DIGIT", 0x0660, 0x0669), ("persian", "EXTENDED ARABIC-INDIC DIGIT", 0x06F0, 0x06F9), ("", "HEBREW LETTER", 0x05D0, 0x05EA), ("", "HEBREW POINT", 0x05B0, 0x05C4),
    ("hebrew", "HEBREW LETTER", 0x05D0, 0x05EA), ("hebrew", "HEBREW POINT", 0x05B0, 0x05C4), ("hebrew", "HEBREW ACCENT", 0x0591, 0x05AF), ("thai", "THAI CHARACTER", 0x0E01, 0x0E5B), ("thai", "THAI DIGIT", 0x0E50, 0x0E59),
    *((f"{before}{suffix}", f"{name} {kind}", first, first + 0x7F) for suffix, name, first in (("deva", "DEVANAGARI", 0x0900), ("bengali", "BENGALI", 0x0980), ("gurmukhi", "GURMUKHI", 0x0A00), ("gujarati", "GUJARATI", 0x0A80))
      for before, kind in (("", "LETTER"), ("", "DIGIT"), ("", "SIGN"), ("vowelsign", "VOWEL SIGN"))),
    ("circle", "CIRCLED DIGIT", 0x2460, 0x2468), ("circle", "CIRCLED NUMBER", 0x2469, 0x2473), ("paren", "PARENTHESIZED DIGIT", 0x2474, 0x247C), ("paren", "PARENTHESIZED NUMBER", 0x247D, 0x2487),
    ("superior", "SUPERSCRIPT", 0x2070, 0x208E), ("inferior", "SUBSCRIPT", 0x2080, 0x208E), ("roman", "SMALL ROMAN NUMERAL", 0x2170, 0x217B), ("monospace", "FULLWIDTH DIGIT", 0xFF10, 0xFF19),
    ("monospace", "FULLWIDTH", 0xFF01, 0xFF5E), ("cmb", "COMBINING", 0x0300, 0x0345),
]
CASED = [
    ("cyrillic", "CYRILLIC {} LETTER", 0x0400, 0x04FF), ("armenian", "ARMENIAN {} LETTER", 0x0531, 0x0587), ("", "GREEK {} LETTER", 0x0370, 0x03CE), ("circle", "CIRCLED LATIN {} LETTER", 0x24B6, 0x24E9),
    ("paren", "PARENTHESIZED LATIN {} LETTER", 0x249C, 0x24B5), ("monospace", "FULLWIDTH LATIN {} LETTER", 0xFF21, 0xFF5A), ("", "LATIN {} LETTER", 0x00C0, 0x024F), ("", "LATIN {} LETTER", 0x1E00, 0x1EFF),
]
#: Words of character names as the public list has them.
SAID = {"DIAERESIS": "dieresis", "DOUBLE ACUTE": "hungarumlaut", "DOT ABOVE": "dotaccent", "DOT BELOW": "dotbelow", "RING ABOVE": "ring", "HOOK ABOVE": "hookabove", "LINE BELOW": "linebelow", "DOUBLE GRAVE": "dblgrave", "TONOS": "tonos", "DIALYTIKA": "dieresis"}
#: Numbered names: first and last number, and the first one's code point.
NUMBERED = [
    (10017, 10022, 0x0410), (10023, 10023, 0x0401), (10024, 10049, 0x0416), (10050, 10050, 0x0490), (10051, 10061, 0x0402), (10062, 10062, 0x040E), (10145, 10145, 0x040F), (10146, 10146, 0x0462),
    (10147, 10147, 0x0472), (10148, 10148, 0x0474), (10065, 10070, 0x0430), (10071, 10071, 0x0451), (10072, 10097, 0x0436), (10098, 10098, 0x0491), (10099, 10109, 0x0452), (10110, 10110, 0x045E),
    (10193, 10193, 0x045F), (10194, 10194, 0x0463), (10195, 10195, 0x0473), (10196, 10196, 0x0475), (57388, 57388, 0x060C), (57392, 57401, 0x0660), (57403, 57403, 0x061B), (57407, 57407, 0x061F),
    (57409, 57434, 0x0621), (57440, 57440, 0x0640), (57441, 57450, 0x0641), (57451, 57458, 0x064B), (57664, 57690, 0x05D0), (61352, 61352, 0x2116), (61289, 61289, 0x2113), (61248, 61248, 0x2105),
]
SYMBOLS = {
    "arrowleft": 0x2190, "arrowup": 0x2191, "arrowright": 0x2192, "arrowdown": 0x2193, "arrowboth": 0x2194, "arrowupdn": 0x2195, "arrowupdnbse": 0x21A8, "carriagereturn": 0x21B5, "arrowdblleft": 0x21D0,
    "arrowdblup": 0x21D1, "arrowdblright": 0x21D2, "arrowdbldown": 0x21D3, "arrowdblboth": 0x21D4, "universal": 0x2200, "existential": 0x2203, "emptyset": 0x2205, "gradient": 0x2207, "element": 0x2208,
    "notelement": 0x2209, "suchthat": 0x220B, "asteriskmath": 0x2217, "proportional": 0x221D, "orthogonal": 0x221F, "angle": 0x2220, "logicaland": 0x2227, "logicalor": 0x2228, "intersection": 0x2229,
    "union": 0x222A, "therefore": 0x2234, "similar": 0x223C, "congruent": 0x2245, "equivalence": 0x2261, "propersubset": 0x2282, "propersuperset": 0x2283, "notsubset": 0x2284, "reflexsubset": 0x2286,
    "reflexsuperset": 0x2287, "circleplus": 0x2295, "circlemultiply": 0x2297, "perpendicular": 0x22A5, "dotmath": 0x22C5, "house": 0x2302, "revlogicalnot": 0x2310, "integraltp": 0x2320, "integralbt": 0x2321,
    "angleleft": 0x2329, "angleright": 0x232A, "upblock": 0x2580, "dnblock": 0x2584, "block": 0x2588, "lfblock": 0x258C, "rtblock": 0x2590, "ltshade": 0x2591, "shade": 0x2592, "dkshade": 0x2593,
    "filledbox": 0x25A0, "H22073": 0x25A1, "H18543": 0x25AA, "H18551": 0x25AB, "filledrect": 0x25AC, "triagup": 0x25B2, "triagrt": 0x25BA, "triagdn": 0x25BC, "triaglf": 0x25C4, "circle": 0x25CB,
    "H18533": 0x25CF, "invbullet": 0x25D8, "invcircle": 0x25D9, "openbullet": 0x25E6, "smileface": 0x263A, "invsmileface": 0x263B, "sun": 0x263C, "female": 0x2640, "male": 0x2642, "spade": 0x2660,
    "club": 0x2663, "heart": 0x2665, "diamond": 0x2666, "musicalnote": 0x266A, "musicalnotedbl": 0x266B, "weierstrass": 0x2118, "Ifraktur": 0x2111, "Rfraktur": 0x211C, "aleph": 0x2135, "prescription": 0x211E,
    "estimated": 0x212E, "onethird": 0x2153, "twothirds": 0x2154, "oneeighth": 0x215B, "threeeighths": 0x215C, "fiveeighths": 0x215D, "seveneighths": 0x215E, "colonmonetary": 0x20A1, "lira": 0x20A4,
    "peseta": 0x20A7, "dong": 0x20AB, "minute": 0x2032, "second": 0x2033, "exclamdbl": 0x203C, "underscoredbl": 0x2017, "figuredash": 0x2012, "quotereversed": 0x201B, "theta1": 0x03D1, "phi1": 0x03D5,
    "omega1": 0x03D6, "sigma1": 0x03C2, "Upsilon1": 0x03D2, "longs": 0x017F, "kgreenlandic": 0x0138, "napostrophe": 0x0149, "Eng": 0x014A, "eng": 0x014B, "Tbar": 0x0166, "tbar": 0x0167, "Hbar": 0x0126,
    "hbar": 0x0127, "IJ": 0x0132, "ij": 0x0133, "Ldot": 0x013F, "ldot": 0x0140, "Ohorn": 0x01A0, "ohorn": 0x01A1, "Uhorn": 0x01AF, "uhorn": 0x01B0, "Aringacute": 0x01FA, "aringacute": 0x01FB,
    "AEacute": 0x01FC, "aeacute": 0x01FD, "Oslashacute": 0x01FE, "oslashacute": 0x01FF, "franc": 0x20A3, "won": 0x20A9, "newsheqelsign": 0x20AA, "anoteleia": 0x0387, "tonos": 0x0384, "dieresistonos": 0x0385,
}


def _squeezed(rest: str) -> str:
    """What the public list calls a character from the rest of its name."""
    for said, short in SAID.items():
        rest = rest.replace(said, short)
    rest = rest.removesuffix(" FORM").removesuffix(" ACCENT")
    if rest.startswith("SMALL "):
        rest = rest[6:] + " SMALL"
    return "".join(w for w in rest.lower().replace("-", " ").split() if w not in ("with", "and"))


@cache
def _by_name() -> dict[str, str]:
    out: dict[str, str] = {}
    for suffix, prefix, first, last in SCRIPTS:
        for code in range(first, last + 1):
            name = unicodedata.name(chr(code), "")
            if name.startswith(f"{prefix} "):
                out.setdefault(_squeezed(name[len(prefix) + 1 :]) + suffix, chr(code))
    for suffix, pattern, first, last in CASED:
        for case in ("CAPITAL", "SMALL"):
            prefix = pattern.format(case)
            for code in range(first, last + 1):
                name = unicodedata.name(chr(code), "")
                if name.startswith(f"{prefix} "):
                    rest = _squeezed(name[len(prefix) + 1 :])
                    out.setdefault((rest[:1].upper() + rest[1:] if case == "CAPITAL" else rest) + suffix, chr(code))
    for n in range(9):
        said = _squeezed(unicodedata.name(chr(0x2488 + n)).split()[1])
        out.setdefault(f"{said}period", chr(0x2488 + n))
    for code in range(0x2160, 0x216C):
        rest = _squeezed(unicodedata.name(chr(code)).removeprefix("ROMAN NUMERAL "))
        out.setdefault(f"{rest[:1].upper()}{rest[1:]}roman", chr(code))
    return out


def by_rule(name: str) -> str | None:
    """The text of a glyph name that follows a rule of the public list."""
    if name in SYMBOLS:
        return chr(SYMBOLS[name])
    if name.startswith("afii") and name[4:].isascii() and name[4:].isdigit():
        n = int(name[4:])
        return next((chr(code + n - first) for first, last, code in NUMBERED if first <= n <= last), None)
    known = _by_name()
    if name in known:
        return known[name]
    # A Hebrew letter with a point after it is both.
    for k in range(len(name) - 3, 1, -1):
        letter, point = known.get(name[:k], ""), known.get(name[k:].removesuffix("hebrew"), "")
        if 0x05D0 <= ord(letter or " ") <= 0x05EA and 0x05B0 <= ord(point or " ") <= 0x05BC:
            return letter + point
    return None
