"""Glyph names against entries of the public list."""

import pytest

from quarry.functions import encodings, glyphs

# Entries of the public list, as name and code points.
ENTRIES = """A 0041;Aacute 00C1;abreveacute 1EAF;abrevedotbelow 1EB7;Acircumflexgrave 1EA6;acircle 24D0;Acircle 24B6;aparen 249C;Acyrillic 0410;acyrillic 0430;afii10017 0410;afii10023 0401;afii10049 042F
afii10051 0402;afii10061 040C;afii10065 0430;afii10071 0451;afii10097 044F;afii10110 045E;afii10145 040F;afii57388 060C;afii57392 0660;afii57409 0621;afii57450 064A;afii57664 05D0;afii57690 05EA
ahiragana 3042;asmallhiragana 3041;kakatakana 30AB;kakatakanahalfwidth FF76;kadeva 0915;aavowelsigndeva 093E;onedeva 0967;anusvaradeva 0902;kabengali 0995;kagujarati 0A95;abopomofo 311A
alef 05D0;alefhebrew 05D0;alefarabic 0627;alefmaddaabovearabic 0622;alefmaddaabovefinalarabic FE82;dalethatafpatah 05D3 05B2;sheva 05B0;kokaithai 0E01;onearabic 0661;onecircle 2460;oneparen 2474
oneperiod 2488;onesuperior 00B9;oneinferior 2081;oneroman 2170;Oneroman 2160;amonospace FF41;onemonospace FF11;arrowright 2192;arrowdblleft 21D0;club 2663;alpha 03B1;alphatonos 03AC;iotadieresistonos 0390
gravecmb 0300;germandbls 00DF;Scaron 0160;Eng 014A;tcommaaccent 0163;Lslash 0141;uni0041 0041;u1F600 1F600;f_i 0066 0069;A.swash 0041"""


@pytest.mark.parametrize("entry", [e for line in ENTRIES.split("\n") for e in line.split(";")])
def test_entries(entry):
    name, *codes = entry.split()
    assert encodings.glyph(name) == "".join(chr(int(c, 16)) for c in codes)


@pytest.mark.parametrize("name", ["", ".notdef", "nosuchname", "afii99999", "uniD800", "uni12", "u110000", "zzhiragana"])
def test_names_that_are_none(name):
    assert encodings.glyph(name) is None


def test_the_rules_reach_far():
    assert len(glyphs._by_name()) + len(glyphs.SYMBOLS) > 2800
