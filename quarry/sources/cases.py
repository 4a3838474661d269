"""PDF files made from tables that hold one case each: faults, paths that text takes, destinations, and rich structure."""

from __future__ import annotations

from .corpora import LINES_A_PAGE, shown_lines
from .objects import Name, Ref, Stream, Text
from .writer import METHODS, Builder, file_id, page_content, stream, with_pages


def _font(build: Builder, **more) -> Ref:
    return build.add({"Type": Name("Font"), "Subtype": Name("Type1"), "BaseFont": Name("Helvetica"), "Encoding": Name("WinAnsiEncoding"), **more})


def _pages_of(text: str) -> list[list[str]]:
    lines = (text or "").split("\n")
    return [lines[i : i + LINES_A_PAGE] for i in range(0, len(lines), LINES_A_PAGE)]


#: Faults by the remainder of a number by their count. Objects: font 1, page tree 2, resources 3, content 4, page 5, catalog 6.
FAULTS = ("no_pages", "no_box", "syntax", "no_base_font", "first_char", "widths", "parents", "odd_names", "empty_names", "name_cycle", "locked", "no_root", "none")


def fault_file(number: int) -> bytes:
    """A file with the fault that its number tells."""
    fault, build = FAULTS[number % len(FAULTS)], Builder()
    font = _font(build)
    (page,) = with_pages(build, [stream(b"BT (open" if fault == "syntax" else page_content([b"x"]))], {"Font": {"F1": font}})
    root, at = build.trailer["Root"], build.objects
    if fault == "no_pages":
        del at[root]["Pages"]
    elif fault == "no_box":
        del at[page]["MediaBox"]
    elif fault == "no_base_font":
        del at[font]["BaseFont"]
    elif fault == "first_char":
        at[font]["FirstChar"] = 32
    elif fault == "widths":
        at[font] |= {"FirstChar": 32, "LastChar": 34, "Widths": [1, 2]}
    elif fault == "parents":
        at[at[page]["Parent"]]["Parent"] = at[page]["Parent"]
    elif fault == "odd_names":
        at[root]["Names"] = {"Dests": {"Names": [Text(b"a")]}}
    elif fault == "empty_names":
        at[root]["Names"] = {"JavaScript": {"Limits": []}}
    elif fault == "name_cycle":
        tree = build.add(None)
        at[tree] = {"Kids": [tree]}
        at[root]["Names"] = {"AP": tree}
    elif fault == "no_root":
        build.trailer["Root"] = None
    build.trailer["ID"] = file_id(str(number))
    return build.write(b"secret" if fault == "locked" else None)


def split_file(row: dict) -> bytes:
    """Text whose pages have their content in three streams, cut anywhere, and their resources from the page tree."""
    build = Builder()
    font = _font(build)
    contents = [shown_lines(x, "win") for x in _pages_of(row["text"])]
    pages = with_pages(build, [stream(b"") for _ in contents], {"Font": {"F1": font}})
    tree = build.objects[pages[0]]["Parent"]
    build.objects[tree]["Resources"] = build.objects[pages[0]]["Resources"]
    for page, data in zip(pages, contents, strict=True):
        del build.objects[page]["Resources"]
        cuts = [0, len(data) // 3, len(data) // 2, len(data)]
        build.objects[page]["Contents"] = [build.add(stream(data[a:b], ("FlateDecode",) if a else ())) for a, b in zip(cuts, cuts[1:], strict=False)]
    return build.write()


def form_file(row: dict) -> bytes:
    """Text in a form within a form; the inner one has resources of its own if the id is odd, else it has its caller's."""
    build = Builder()
    font = _font(build)
    contents = [shown_lines(x, "win") for x in _pages_of(row["text"])]
    pages = with_pages(build, [stream(b"q 1 0 0 1 0 0 cm /Outer Do Q") for _ in contents], {})
    form = {"Type": Name("XObject"), "Subtype": Name("Form"), "BBox": [0, 0, 612, 792]}
    for page, data in zip(pages, contents, strict=True):
        own = {"Resources": {"Font": {"F1": font}}} if row["doc_id"] % 2 else {}
        inner = build.add(stream(data, **form, **own))
        held = {"XObject": {"Inner": inner}} | ({} if own else {"Font": {"F1": font}})
        outer = build.add(stream(b"/Inner Do", ("ASCIIHexDecode",), **form, Resources=held))
        build.objects[page]["Resources"] = {"XObject": {"Outer": outer}}
    return build.write()


#: Glyph names for codes 65 to 90 in turn: Cyrillic letters by number, Greek by name, ligatures by part, and one that is unknown.
GLYPHS = [*(f"afii{n}" for n in range(10065, 10071)), "alpha", "beta", "gamma", "delta", "epsilon", "f_i", "uni0416", "u1F600", "arrowright", "club", "ahiragana", "onecircle", "Aacute.alt", "alefhebrew", "kadeva", "nosuchglyph",
          "space", "hyphen", "zero", "germandbls"]
GLYPH_TEXTS = ["а", "б", "в", "г", "д", "е", "α", "β", "γ", "δ", "ε", "fi", "Ж", "\U0001f600", "→", "♣", "あ", "①", "Á", "א", "क", "�",
               " ", "-", "0", "ß"]


def glyph_file(text: str) -> bytes:
    """Text in a font whose codes 65 to 90 stand for GLYPHS, shown by TJ with a wide gap after each word."""
    build = Builder()
    font = _font(build)
    build.objects[font]["Encoding"] = {"Type": Name("Encoding"), "BaseEncoding": Name("WinAnsiEncoding"), "Differences": [65, *map(Name, GLYPHS)]}
    words = b" -250 ".join(b"(" + w.encode() + b")" for w in text.split(" "))
    with_pages(build, [stream(b"BT /F1 12 Tf [" + words + b"] TJ ET")], {"Font": {"F1": font}})
    return build.write()


#: Fonts by the remainder of a number by four: their entries.
WARNED = (
    {"Subtype": Name("Type1"), "BaseFont": Name("Own")}, {"Subtype": Name("Type0"), "BaseFont": Name("Wide"), "Encoding": Name("Identity-H")},
    {"Subtype": Name("TrueType"), "BaseFont": Name("Held"), "Encoding": Name("MacRomanEncoding")}, {"Subtype": Name("Type1"), "BaseFont": Name("Symbol")},
)


def warned_file(number: int, text: str) -> bytes:
    """Text under two names for a font that may be warned of."""
    build = Builder()
    font = build.add({"Type": Name("Font"), **WARNED[number % 4]})
    data = text.encode("utf-16-be" if number % 4 == 1 else "mac_roman", "replace")
    with_pages(build, [stream(page_content([data], "F1", hexed=True) + b" " + page_content([data], "F2", hexed=True))], {"Font": {"F1": font, "F2": font}})
    return build.write()


def link_file(number: int, url: str) -> bytes:
    """A link of the kind that its number tells: a destination, or an action."""
    build = Builder()
    (page,) = with_pages(build, [stream(b"")], {})
    said = Text(url.encode())
    to = [page, Name("XYZ"), 0, 792, None]
    actions = ({"S": Name("GoTo"), "D": to}, {"S": Name("GoToR"), "F": said, "D": Name("there")}, {"S": Name("URI"), "URI": said}, {"S": Name("Named"), "N": Name("NextPage")}, {"S": Name("Launch"), "F": said}, {"S": Name("Hide")})
    kind = number % 9
    how = {"Dest": Text(b"chapter")} if kind == 0 else {"Dest": to} if kind == 1 else {} if kind == 2 else {"A": build.add(actions[kind - 3]) if number % 2 else actions[kind - 3]}
    note = build.add({"Type": Name("Annot"), "Subtype": Name("Link"), "Rect": [0, 0.5, 10, 20], "Contents": said, **how})
    seen = build.add({"Type": Name("Annot"), "Subtype": Name("Text"), "Rect": [0, 0, 1, 1]})
    build.objects[page]["Annots"] = build.add([note, seen, {"Subtype": Name("Link")}])
    return build.write()


def rich_file(number: int) -> bytes:
    """Outline entries, fields, layers, attachments, labels and tags, as many as remainders of the number tell."""
    build = Builder()
    (page,) = with_pages(build, [stream(b"")], {})
    catalog = build.objects[build.trailer["Root"]]
    if number % 2:
        catalog["PageLabels"] = build.add({"Nums": [0, {"S": Name("D")}]})
    if number % 3 == 0:
        catalog["MarkInfo"] = {"Marked": True}
    if n := number % 4:
        top, items = build.add({"Type": Name("Outlines")}), [build.add({}) for _ in range(n)]
        for i, item in enumerate(items):
            build.objects[item] = {"Title": Text(b"part %d" % i), "Parent": top, "A": {"S": Name("URI"), "URI": Text(b"u%d" % i)}} | ({"Next": items[i + 1]} if i + 1 < n else {})
        build.objects[top] |= {"First": items[0], "Last": items[-1]}
        catalog["Outlines"] = top
    if n := number % 5:
        catalog["AcroForm"] = {"Fields": [build.add({"T": Text(b"f%d" % i), "FT": Name("Btn"), "V": Name("On")}) for i in range(n)]}
    if n := number % 6:
        groups = [build.add({"Type": Name("OCG"), "Name": Text(b"layer")}) for _ in range(n)]
        catalog["OCProperties"] = {"OCGs": groups, "D": {"BaseState": Name("OFF"), "ON": groups[:1]}}
    if n := number % 7:
        pairs = [x for i in range(n) for held in (build.add(stream(b"x" * i, Type=Name("EmbeddedFile"))),) for x in (Text(b"n%d" % i), build.add({"Type": Name("Filespec"), "EF": {"F": held}}))]
        catalog["Names"] = {"EmbeddedFiles": {"Kids": [build.add({"Names": pairs})]}}
    build.objects[page]["Rotate"] = 90 * (number % 4)
    return build.write()


def font_file(number: int) -> bytes:
    """A TrueType font with the kind of font file that its number tells, or none; objects: font 1, descriptor 2, file 3."""
    build = Builder()
    font, descriptor = build.add(None), build.add({"Type": Name("FontDescriptor"), "FontName": Name("Kept")})
    if key := (None, "FontFile", "FontFile2", "FontFile3")[number % 4]:
        build.objects[descriptor][key] = build.add(stream(b"glyphs", ("FlateDecode", "ASCII85Decode")))
    build.objects[font] = {"Type": Name("Font"), "Subtype": Name("TrueType"), "BaseFont": Name("Kept"), "FontDescriptor": descriptor, "FirstChar": 32, "LastChar": 32 + number % 3, "Widths": [1] * (1 + number % 3)}
    with_pages(build, [stream(b"")], {"Font": {"F1": font}})
    return build.write()


def binary_file(data: bytes) -> bytes:
    """Bytes as the content of object 1, through two filters."""
    build = Builder()
    build.add(stream(data, ("ASCII85Decode", "FlateDecode")))
    with_pages(build, [stream(b"")], {})
    return build.write()


def content_file(data: bytes) -> bytes:
    """Bytes as a page's content."""
    build = Builder()
    with_pages(build, [stream(data)], {})
    return build.write()


def image_file(number: int) -> bytes:
    """An image, object 1, whose filter and colour space its number tells."""
    build = Builder()
    filters = (None, Name("DCTDecode"), [Name("FlateDecode"), Name("DCTDecode")], [Name("FlateDecode"), 1])[number % 4]
    space = (Name("DeviceRGB"), [Name("ICCBased"), Ref(9, 0)], [Name("Indexed"), Name("DeviceCMYK"), 1, Text(b"ab")], None)[number // 4 % 4]
    entries = {"Subtype": Name("Image"), "Width": number, "Height": 1, "BitsPerComponent": 1 << number % 4} | ({"Filter": filters} if filters else {}) | ({"ColorSpace": space} if space else {})
    image = build.add(Stream({**entries, "Length": 3}, b"abc"))
    with_pages(build, [stream(b"")], {"XObject": {"Im1": image}})
    return build.write()


def locked_file(number: int, text: str) -> bytes:
    """Text encrypted by the method that a number tells."""
    build = Builder()
    font = _font(build)
    with_pages(build, [stream(shown_lines([text], "win"))], {"Font": {"F1": font}})
    build.trailer["ID"] = file_id(str(number))
    build.trailer["Info"] = build.add({"Title": Text(text.encode())})
    return build.write(b"open sesame", method=METHODS[number % 4])


def encoded_file(number: int) -> bytes:
    """Eight codes, from a place that a number tells on, in one of three base encodings (an encoding's name, or its dictionary)."""
    name, first = ("WinAnsiEncoding", "MacRomanEncoding", "StandardEncoding")[number % 3], 0x20 + number // 3 % 28 * 8
    build = Builder()
    font = _font(build, Encoding=Name(name) if number % 2 else {"Type": Name("Encoding"), "BaseEncoding": Name(name)})
    with_pages(build, [stream(page_content([bytes(range(first, first + 8))], hexed=True))], {"Font": {"F1": font}})
    return build.write()


#: A map to Unicode with codes of one and two bytes: letters by ranges and by a list, digits by a range, a space and a ligature by themselves.
MAP = b"""/CIDInit /ProcSet findresource begin begincmap
2 begincodespacerange <20> <7F> <8000> <FFFF> endcodespacerange
2 beginbfchar <20> <0020> <8001> <006600660069> endbfchar
4 beginbfrange <41> <5A> <0410> <61> <7A> <03B1> <8030> <8039> <0660> <8100> <8102> [<D83DDE00> <0041 0042> <00E9>] endbfrange
endcmap end"""


def mapped_file(text: str) -> bytes:
    """Letters and spaces as codes of one byte, digits and # as codes of two, through MAP."""
    build = Builder()
    codes = b"".join(bytes([ord(c)]) if c.isalpha() or c == " " else bytes([0x80, 0x30 + int(c)]) if c.isdigit() else b"\x80\x01" for c in text) + b"\x81\x00\x81\x01\x81\x02\x81\x03"
    font = build.add({"Type": Name("Font"), "Subtype": Name("Type1"), "BaseFont": Name("Own"), "ToUnicode": build.add(stream(MAP, ("LZWDecode",)))})
    with_pages(build, [stream(page_content([codes], hexed=True))], {"Font": {"F1": font}})
    return build.write()


def described_file(row: dict) -> bytes:
    """All keys of the information dictionary and the settings of the catalog, from a customer."""
    build, said = Builder(), lambda k: Text(str(row[k]).encode())
    with_pages(build, [stream(b"")], {}, PageLayout=Name("TwoColumnLeft"), PageMode=Name("UseOutlines"), Lang=said("c_mktsegment"))
    keys = {"Title": "c_name", "Author": "c_mktsegment", "Subject": "c_custkey", "Keywords": "c_nationkey", "Creator": "c_name", "Producer": "c_mktsegment"}
    dates = {"CreationDate": Text(b"D:2024%06d" % row["c_custkey"]), "ModDate": Text(b"D:2025%06d" % row["c_custkey"])}
    build.trailer["Info"] = build.add({**{k: said(v) for k, v in keys.items()}, **dates, "Other": said("c_name"), "Trapped": Name("False")})
    return build.write()


def roles_file(number: int) -> bytes:
    """An object of every role."""
    build = Builder()
    named = lambda kind, **more: build.add({"Type": Name(kind), **more})
    held = [
        named("Annot", Subtype=Name("Text"), Rect=[0, 0, number, 1]), named("Action", S=Name("GoTo")), named("FontDescriptor", FontName=Name("Own")), named("Encoding", BaseEncoding=Name("WinAnsiEncoding")),
        named("ExtGState", CA=1), named("Font", Subtype=Name("TrueType"), BaseFont=Name("Own")), build.add({"Subtype": Name("CIDFontType2"), "BaseFont": Name("Wide")}),
        build.add(stream(b"abc", Subtype=Name("Image"), Width=number, Height=2, ColorSpace=Name("DeviceGray"))), build.add(stream(b"q Q", Subtype=Name("Form"), BBox=[0, 0, 1, 1])), build.add(stream(b"xyz", Kind=Name("Other"))),
        build.add([1, 2, number]), build.add(number), build.add(0.5), build.add(True), build.add(Text(b"said")), build.add(Name("Called")), build.add(None), build.add({"A": 1}),
    ]
    with_pages(build, [stream(b"")], {"All": held})
    return build.write()


def handwritten_file(text: str) -> bytes:
    """A file spelled out byte by byte, without the writer: comments, escapes, names with numbers, an indirect length, a section
    that an update replaces, and ends of line of every kind."""
    old = b"BT /F1 12 Tf (replaced by the update) Tj ET"
    first = [
        b"1 0 obj % the catalog\r<</Type/Catalog/Pages 2 0 R>>\rendobj\r",
        b"2 0 obj\n<< /Type /Pages\t/Kids [ 3 0 R ]\n/Count 1 >>\nendobj\n",
        b"3 0 obj<</Type/Page/Parent 2 0 R/MediaBox[0 0 612 792]/Resources<</Font<</F#31 4 0 R>>>>/Contents 5 0 R>>endobj\n",
        b"4 0 obj <</Type/Font/Subtype/Type1/BaseFont/Helvetica/Encoding/Win#41nsiEncoding>> endobj\n",
        b"5 0 obj\r\n<</Length 6 0 R>>\r\nstream\r\n" + old + b"\r\nendstream\r\nendobj\r\n",
        b"6 0 obj %d endobj\n" % len(old),
    ]
    out, at = b"%PDF-1.3\n%\xe2\xe3\xcf\xd3\n", []
    for body in first:
        at.append(len(out))
        out += body
    begins = len(out)
    out += b"xref\n0 7\n0000000000 65535 f\r\n" + b"".join(b"%010d 00000 n\r\n" % x for x in at)
    out += b"trailer\n<</Size 7/Root 1 0 R>>\nstartxref\n%d\n%%%%EOF\n" % begins
    shown = b"".join(b"\\%03o" % b for b in text.encode("cp1252"))
    new = b"q BT/F1 12 Tf 14 TL 50 700 Td(" + shown + b")Tj T*(a \\(b\\) (nested (twice)) c\\\nd)Tj% a comment)\nT*<48 65\n6C6c 6F2>Tj[(to)-300(ge)20(ther)]TJ ET Q"
    fifth, sixth = len(out), len(out) + len(b"5 0 obj<</Length 6 0 R>>stream\n" + new + b"\nendstream endobj\n")
    out += b"5 0 obj<</Length 6 0 R>>stream\n" + new + b"\nendstream endobj\n6 0 obj\n%d\nendobj\n" % len(new)
    again = len(out)
    out += b"xref\n5 2\n%010d 00000 n \n%010d 00000 n \ntrailer <</Size 7/Root 1 0 R/Prev %d>>\nstartxref\n%d\n%%%%EOF" % (fifth, sixth, begins, again)
    return out
