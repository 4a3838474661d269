import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.functions import encodings, structure, text, validate
from quarry.functions.cmap import CMap
from quarry.sources import corpora, crypt
from quarry.sources.document import LoadError, load, stream_body
from quarry.sources.objects import Keyword, Name, Reader, Ref, Stream, SyntaxProblem, Text, operations, references, shown, tagged
from quarry.sources.writer import Builder, file_id, page_content, stream, syntax, with_pages


def read(data: bytes):
    return Reader(data).object()


@pytest.mark.parametrize("data, value", [
    (b"true", True), (b"null", None), (b"-12", -12), (b"+3.5", 3.5), (b".5", 0.5), (b"/A#20b", "A b"), (b"(a(b)c\\)\\n\\101)", b"a(b)c)\nA"), (b"(a\\\nb\r\nc)", b"ab\nc"), (b"<48 6>", b"H`"),
    (b"[1 /A (x) 2 0 R]", [1, "A", b"x", Ref(2, 0)]), (b"<</A 1/B<</C [2]>>>>", {"A": 1, "B": {"C": [2]}}), (b"% note\n 7", 7), (b"12 0", 12),
])
def test_objects(data, value):
    assert read(data) == value


@pytest.mark.parametrize("data", [b"", b"(open", b"<41", b"<<1 2>>", b"[1 2", b"<</A", b"]", b"<4x>", b"[" * 500])
def test_broken_objects(data):
    with pytest.raises(SyntaxProblem):
        read(data)


VALUES = st.recursive(
    st.one_of(st.none(), st.booleans(), st.integers(-(2**31), 2**31), st.text(max_size=8).map(Name), st.binary(max_size=12).map(Text), st.builds(Ref, st.integers(1, 99), st.integers(0, 9))),
    lambda inner: st.one_of(st.lists(inner, max_size=4), st.dictionaries(st.text(min_size=1, max_size=6).filter(lambda k: "\0" not in k).map(Name), inner, max_size=4)), max_leaves=12,
)


@given(VALUES)
@settings(deadline=None)
def test_written_objects_read_back(value):
    def clean(v):
        if isinstance(v, Name):
            return Name(v.replace("\0", ""))
        return [clean(x) for x in v] if isinstance(v, list) else {k: clean(x) for k, x in v.items()} if isinstance(v, dict) else v

    value = clean(value)
    assert read(syntax(value) + b" ") == value


@given(st.binary(max_size=400))
@settings(deadline=None, max_examples=200)
def test_the_loader_never_fails_otherwise(data):
    for whole in (data, b"%PDF-1.4\n" + data + b"\nstartxref\n9\n%%EOF"):
        try:
            load(whole)
        except LoadError:
            pass


@given(st.integers(0, 1200), st.binary(min_size=1, max_size=6))
@settings(deadline=None, max_examples=200)
def test_damage_anywhere(at, damage):
    whole = corpora.text_file({"doc_id": 1, "text": "some\ntext"}, packed=bool(at % 2))
    try:
        doc = load(whole[:at] + damage + whole[at + len(damage) :])
    except LoadError:
        return
    for make in (validate.issues, structure.tree, structure.fonts, lambda d: [text.Interpreter(d).page(p) for p in d.pages()]):
        make(doc)


def one_page(content: bytes, resources: dict | None = None, **entries):
    build = Builder()
    pages = with_pages(build, [stream(content)], resources or {})
    build.objects[pages[0]] |= entries
    return build, pages[0]


def page_text(content: bytes, resources: dict | None = None) -> text.PageText:
    build, _ = one_page(content, resources)
    doc = load(build.write())
    return text.Interpreter(doc).page(doc.pages()[0])


@pytest.mark.parametrize("content, said", [
    (b"BT (a) Tj ET BT (b) Tj ET", "a\nb"), (b"BT (a) Tj 0 -5 Td (b) Tj 5 0 Td (c) Tj ET", "a\nbc"), (b"BT [(a) -50 (b) -101 (c)] TJ ET", "ab c"), (b"BT (a) Tj (b) ' 1 2 (c) \" ET", "a\nb\nc"),
    (b"BT (a) Tj T* T* (b) Tj ET", "a\n\nb"), (b"q 1 0 0 1 5 5 cm BT 1 0 0 1 0 0 Tm (x) Tj ET Q", "x"), (b"BI /W 1 ID abc EI BT (a) Tj ET", "a"),
])
def test_text_operators(content, said):
    assert page_text(content).text == said


def test_syntax_errors_give_a_warning():
    got = page_text(b"BT (a Tj ET")
    assert got.text == "" and "syntax" in got.warnings[0]


def test_forms_and_their_cycles():
    build, page = one_page(b"BT (a) Tj ET /F Do")
    form = build.add(None)
    build.objects[form] = stream(b"BT (in form) Tj ET /F Do", Subtype=Name("Form"), Resources={"XObject": {"F": form}})
    build.objects[page]["Resources"] = {"XObject": {"F": form}}
    doc = load(build.write())
    assert text.Interpreter(doc).page(page).text == "a\nin form"


def test_fonts():
    def report(**entries):
        build, page = one_page(b"BT /F 1 Tf (\x27\xe9A) Tj ET")
        font = build.add({"Type": Name("Font"), "Subtype": Name("Type1"), **{k: build.add(v) if isinstance(v, Stream) else v for k, v in entries.items()}})
        build.objects[page]["Resources"] = {"Font": {"F": font}}
        doc = load(build.write())
        got = text.Interpreter(doc).page(page)
        return got.text, got.fonts[0].classification, got.unmapped

    assert report(BaseFont=Name("X"), Encoding=Name("WinAnsiEncoding")) == ("'éA", "reliable", 0)
    assert report(BaseFont=Name("X"), Encoding=Name("MacRomanEncoding"))[0] == "'ÈA"
    assert report(BaseFont=Name("Helvetica")) == ("’ØA", "reliable", 0)
    assert report(BaseFont=Name("Symbol"))[1] == "degraded"
    assert report(BaseFont=Name("X"), Encoding={"BaseEncoding": Name("WinAnsiEncoding"), "Differences": [39, Name("alpha"), 233, Name("g99")]}) == ("α�A", "degraded", 1)
    assert report(BaseFont=Name("X"), Subtype=Name("Type0"))[1] == "unreliable"
    assert report(BaseFont=Name("X"), ToUnicode=stream(b"1 beginbfchar <41> <00480069> endbfchar")) == ("��Hi", "reliable", 2)


def test_verdict():
    good = text.FontReport("/F", "X", "Type1", "reliable", False, "")
    bad = text.FontReport("/G", "Y", "Type0", "unreliable", False, "")
    assert text.verdict([good], 10, 2) == "reliable" and text.verdict([good], 10, 3) == "degraded" and text.verdict([good, bad], 10, 3) == "unreliable" and text.verdict([], 0, 0) == "reliable"


def test_cmap():
    cmap = CMap(b"2 begincodespacerange <00> <80> <8140> <9FFC> endcodespacerange 1 beginbfchar <41> <D83DDE00> endbfchar 2 beginbfrange <42> <50> <0061> <8140> <8141> [<0041>] endbfrange")
    assert list(cmap.codes(b"\x41\x81\x40\xff\x42", 1)) == [0x41, 0x8140, 0xFF, 0x42]
    assert [cmap.get(c) for c in (0x41, 0x43, 0x8140, 0x8141, 0xFF)] == ["😀", "b", "A", None, None]
    assert CMap(b"beginbfrange <00> <FFFF> <FFFF> endbfrange").get(1) == "\0" and CMap(b"nothing").empty


@given(st.binary(max_size=200))
@settings(deadline=None)
def test_cmaps_never_fail(data):
    cmap = CMap(b"begincodespacerange " + data + b" beginbfrange " + data)
    [cmap.get(c) for c in cmap.codes(data, 2)]


@pytest.mark.parametrize("name, said", [("A", "A"), ("eacute", "é"), ("f_i", "fi"), ("a.alt", "a"), ("uni00E9", "é"), ("u1F600", "😀"), ("uniD83DDE00", "😀"), ("quoteright", "’"), ("beta", "β"), ("g12", None), ("", None), (".notdef", None), ("uD800", None)])
def test_glyphs(name, said):
    assert encodings.glyph(name) == said


def test_encodings():
    assert encodings.table("WinAnsiEncoding")[0x80] == "€" and encodings.table("MacRomanEncoding")[0xDE] == "fi" and encodings.table("StandardEncoding")[0xAE] == "fi"
    assert encodings.table("MacExpertEncoding")[0x57] == "fi" and encodings.table("Other") is None
    assert 0x07 not in encodings.table("WinAnsiEncoding") and sum(c >= 0xA0 for c in encodings.table("StandardEncoding")) == 54


def test_snippets():
    assert text.snippets("abc", "") == [] and text.snippets("x" * 50 + "Needle" + "y" * 50, "needle") == ["..." + "x" * 40 + "Needle" + "y" * 40 + "..."]
    assert text.snippets("é" * 30 + "abc\nd", "ABC") == ["..." + "é" * 20 + "abc d"] and len(text.snippets("aaaa", "aa")) == 2


def test_passwords():
    build, _ = one_page(page_content([b"hidden"]), {"Font": {"F1": {"Type": Name("Font"), "BaseFont": Name("Helvetica")}}})
    build.trailer["ID"] = file_id("x")
    data = build.write(password=b"key")
    locked = load(data)
    assert locked.encrypted and not locked.decrypted and validate.issues(locked)[0]["rule"] == "encryption"
    with pytest.raises(LoadError, match="password"):
        load(data, b"wrong")
    doc = load(data, b"key")
    assert doc.decrypted and text.Interpreter(doc).page(doc.pages()[0]).text == "hidden"


def test_ciphers_by_public_vectors():
    assert crypt.rc4(b"Key", b"Plaintext").hex() == "bbf316e8d940af0ad3"
    key, plain = bytes.fromhex("000102030405060708090a0b0c0d0e0f"), bytes.fromhex("00112233445566778899aabbccddeeff")
    assert crypt.aes_encrypt(key, bytes(16), plain).hex() == "69c4e0d86a7b0430d8cdb78070b4c55a"
    long = bytes(range(32))
    assert crypt.aes_encrypt(long, bytes(16), plain).hex() == "8ea2b7ca516745bfeafc49904b496089"
    for k in (key, long):
        assert crypt.aes_decrypt(k, b"i" * 16, crypt.aes_encrypt(k, b"i" * 16, b"sixteen byte msg" + b"\x10" * 16)) == b"sixteen byte msg"


def test_aes256_password():
    from hashlib import sha256

    file_key, user = b"f" * 32, b"open"
    vs, ks = b"validate", b"key salt"
    entries = {"V": 5, "R": 5, "P": -4, "Length": 256, "CF": {"StdCF": {"CFM": Name("AESV3")}}, "StmF": Name("StdCF"), "O": Text(b"o" * 48),
               "U": Text(sha256(user + vs).digest() + vs + ks), "UE": Text(crypt.aes_encrypt(sha256(user + ks).digest(), bytes(16), file_key))}
    handler = crypt.Handler(entries, b"", user)
    sealed = Text(b"v" * 16 + crypt.aes_encrypt(file_key, b"v" * 16, b"hello" + b"\x0b" * 11))
    assert handler.key == file_key and handler.opened(sealed, 3, 0) == b"hello"
    with pytest.raises(crypt.WrongPassword):
        crypt.Handler(entries, b"", b"no")


def test_recovery():
    whole = corpora.text_file({"doc_id": 11, "text": "a\nb"}, faults=True)
    assert len(load(whole).recovery) == 1 and text.Interpreter(d := load(whole)).page(d.pages()[0]).text == "a\nb"
    strict = load(whole, recovery="strict")
    assert len(strict.recovery) == 1 and text.Interpreter(strict).page(strict.pages()[0]).text == ""
    assert load(whole, recovery="none").recovery == []
    assert stream_body(b"1 0 obj <</Length 9>> stream\r\nabc\r\nendstream endobj", 0) == b"abc" and stream_body(b"1 0 obj <<>> endobj stream\nx\nendstream", 0) is None


def test_labels():
    assert [structure.roman(n) for n in (4, 9, 14, 1994, 3999)] == ["iv", "ix", "xiv", "mcmxciv", "mmmcmxcix"] and [structure.alpha(n) for n in (1, 26, 27, 52, 703)] == ["a", "z", "aa", "az", "aaa"]
    assert structure.label("R", "p", 4) == "pIV" and structure.label("a", "", 0) == "0" and structure.label("-", "x", 3) == "x" and structure.label("D", "", -2) == "-2"


def test_trees_with_cycles_end():
    build, page = one_page(b"")
    a, b = build.add(None), build.add(None)
    build.objects[a] = {"Title": Text(b"a"), "Next": b, "First": a}
    build.objects[b] = {"Next": a}
    top = build.add({"First": a})
    field = build.add(None)
    build.objects[field] = {"T": Text(b"f"), "Kids": [field]}
    names = build.add(None)
    build.objects[names] = {"Kids": [names]}
    build.objects[build.trailer["Root"]] |= {"Outlines": top, "AcroForm": {"Fields": [field]}, "Names": {"Dests": names}}
    build.objects[page]["Parent"] = page
    doc = load(build.write())
    assert [(r["title"], r["depth"]) for r in structure.bookmarks(doc)] == [("a", 0), ("(untitled)", 0)]
    assert structure.forms(doc) == []
    rules = {i["rule"] for i in validate.issues(doc)}
    assert {"name_trees", "parent_cycles"} <= rules


def test_validation_of_fonts_and_names():
    build, _ = one_page(b"BT (x Tj")
    build.objects[build.trailer["Root"]]["Names"] = {"Dests": {}, "AP": {"Names": [Text(b"a")]}, "Held": [build.add({"Type": Name("Font"), "Subtype": Name("TrueType"), "FirstChar": 1}), build.add({"Type": Name("Font"), "BaseFont": Name("B"), "FirstChar": 1, "LastChar": 3, "Widths": [1]})]}
    messages = [i["message"] for i in validate.issues(load(build.write()))]
    for part in ("invalid syntax", "missing /BaseFont", "has /FirstChar but not /LastChar", "/Widths has 1 entries but /FirstChar..=/LastChar expects 3", "neither /Names nor /Kids", "odd length (1)"):
        assert any(part in m for m in messages), part


def test_tree_statuses():
    build, _ = one_page(b"")
    build.objects[build.trailer["Root"]]["Lost"] = Ref(77, 0)
    doc = load(build.write())
    assert {n["status"] for n in structure.tree(doc)} == {None, "visited", "missing"}
    assert "depth limit reached" in {n["status"] for n in structure.tree(doc, 1)}
    lines = structure.dot(doc)
    assert lines[0].startswith("digraph") and lines[-1] == "}" and any("dashed" in x for x in lines)


def test_value_forms():
    assert shown([Name("A"), Text(b"x"), 1, 0.5, Ref(1, 0), {}, None, True]) == "[/A (x) 1 0.5 1 0 R <<...>> null true]"
    assert tagged({"B": Ref(1, 0), "A": [1, Name("n")]})["entries"] == {"A": {"items": [{"type": "integer", "value": 1}, {"type": "name", "value": "n"}], "type": "array"}, "B": {"generation": 0, "object_number": 1, "type": "reference"}}
    assert tagged(Ref(1, 0), lambda r: 5)["resolved"] == {"type": "integer", "value": 5}
    assert list(references({"K": [Ref(1, 0), {"A": Ref(2, 0)}]})) == [("/K[0]", Ref(1, 0)), ("/K[1]/A", Ref(2, 0))]


def test_operations():
    assert operations(b"1 0 0 RG (a) Tj") == [("RG", [1, 0, 0]), ("Tj", [b"a"])] and isinstance(read(b"Tj"), Keyword)
    with pytest.raises(SyntaxProblem):
        operations(b"1 2 3")
