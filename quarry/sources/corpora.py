"""PDF files made from tables: a deterministic file for each row or group, for tests and for sample data."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import bounded, sliced
from .objects import Name, Ref, Stream, Text
from .writer import Builder, file_id, page_content, stream, with_pages

LINES_A_PAGE = 8
FILTERS = ((), ("FlateDecode",), ("ASCII85Decode",), ("ASCIIHexDecode",), ("LZWDecode",), ("RunLengthDecode",))


class Kept:
    """Files written to a folder when they are first made for a name, and read from it when they are made for it again: for timing
    reading alone. A name's files are known by the order in which they are made."""

    def __init__(self, folder: str):
        self.folder, self.name, self.n = folder, "", 0

    def named(self, name: str) -> None:
        self.name, self.n = name, 0

    def held(self, made: DataFrame) -> DataFrame:
        path, self.n = f"{self.folder}/{self.name}-{self.n}", self.n + 1
        if not Path(path).exists():
            made.write.parquet(path)
        return made.sparkSession.read.parquet(path)


_KEPT: Kept | None = None


def keep(kept: Kept | None) -> None:
    """From now on files are kept; None ends that."""
    global _KEPT
    _KEPT = kept


def built(rows: DataFrame, make: Callable[[dict], bytes], key: str) -> DataFrame:
    """doc_key and content: make's file of each row."""
    names = rows.columns
    at = names.index(key)
    cores = rows.sparkSession.sparkContext.defaultParallelism
    # A small table may have all its rows in one of few splits; making and parsing its files is worth all cores.
    rows = rows.repartition(4 * cores) if rows.rdd.getNumPartitions() < 4 * cores else rows
    bounded(rows.sparkSession)

    def run(batches):
        for b in sliced(batches):
            cols = [c.to_pylist() for c in b.columns]
            made = [make(dict(zip(names, row, strict=True))) for row in zip(*cols, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([str(k) for k in cols[at]]), pa.array(made, pa.binary())], ["doc_key", "content"])

    made = rows.mapInArrow(run, "doc_key string, content binary")
    return made if _KEPT is None else _KEPT.held(made)


def font(kind: str, build: Builder) -> Ref:
    """A font: win and standard show single bytes, mapped and unmapped are composite with and without a map to Unicode."""
    if kind == "win":
        return build.add({"Type": Name("Font"), "Subtype": Name("Type1"), "BaseFont": Name("Helvetica"), "Encoding": Name("WinAnsiEncoding")})
    if kind == "standard":
        return build.add({"Type": Name("Font"), "Subtype": Name("Type1"), "BaseFont": Name("Times-Roman")})
    below = build.add({"Type": Name("Font"), "Subtype": Name("CIDFontType2"), "BaseFont": Name("Sample"), "CIDSystemInfo": {"Registry": Text(b"Adobe"), "Ordering": Text(b"Identity"), "Supplement": 0}})
    entries = {"Type": Name("Font"), "Subtype": Name("Type0"), "BaseFont": Name("Sample"), "Encoding": Name("Identity-H"), "DescendantFonts": [below]}
    if kind == "mapped":
        entries["ToUnicode"] = build.add(stream(b"1 begincodespacerange <0000> <FFFF> endcodespacerange 1 beginbfrange <0000> <FFFF> <0000> endbfrange", ("FlateDecode",)))
    return build.add(entries)


def shown_lines(lines: list[str], kind: str) -> bytes:
    """Content that shows lines in a font of this kind."""
    if kind in ("mapped", "unmapped"):
        return page_content([x.encode("utf-16-be") for x in lines], hexed=True)
    return page_content([x.encode("cp1252", "replace") for x in lines])


def text_pages(text: str) -> list[list[str]]:
    lines = (text or "").split("\n")
    return [lines[i : i + LINES_A_PAGE] for i in range(0, len(lines), LINES_A_PAGE)]


def text_file(row: dict, kind: str = "win", filters: tuple[str, ...] = (), packed: bool = False, password: bytes | None = None, faults: bool = False) -> bytes:
    """doc_id and text as pages of LINES_A_PAGE lines. Objects: the font, then content and page for each page, tree,
    shared resources and catalog. faults adds damage that the id tells: a dangling reference if it divides by 7, an
    orphan by 5, a wrong length by 11, a wrong page count by 3, a second generation by 13."""
    build, doc_id = Builder(), row["doc_id"]
    made = font(kind, build)
    pages = with_pages(build, [stream(shown_lines(x, kind), filters) for x in text_pages(row["text"])], {"Font": {"F1": made}})
    catalog = build.objects[build.trailer["Root"]]
    if faults:
        if doc_id % 7 == 0:
            catalog["Dangling"] = Ref(999999, 0)
        if doc_id % 5 == 0:
            build.add({"Orphan": True})
        if doc_id % 3 == 0:
            build.objects[catalog["Pages"]]["Count"] += 1
        if doc_id % 13 == 0:
            build.add({"Second": True}, num=made.num, gen=1)
        if doc_id % 11 == 0:
            first = build.objects[pages[0]]["Contents"]
            held = build.objects[first]
            build.objects[first] = Stream({**held.dict, "Length": len(held.raw) + 7}, held.raw)
    build.trailer["ID"] = file_id(str(doc_id))
    info = {k.capitalize(): Text(str(row[k]).encode()) for k in ("title", "author") if k in row}
    if "lang" in row:
        catalog["Lang"] = Text(row["lang"].encode())
    if "source" in row:
        info["Author"] = Text(row["source"].encode())
    if info:
        build.trailer["Info"] = build.add({"Title": Text(f"Document {doc_id}".encode()), **info})
    return build.write(password, packed)


def part_file(row: dict) -> bytes:
    """A part's picture: width p_size, height twice that."""
    build = Builder()
    image = build.add(Stream({"Type": Name("XObject"), "Subtype": Name("Image"), "Width": row["p_size"], "Height": 2 * row["p_size"], "ColorSpace": Name("DeviceGray"), "BitsPerComponent": 8, "Length": row["p_size"]}, bytes(row["p_size"])))
    with_pages(build, [stream(b"/Im1 Do")], {"XObject": {"Im1": image}})
    return build.write()


def customer_file(row: dict) -> bytes:
    """A form with one field, below a parent field named c."""
    build = Builder()
    pages = with_pages(build, [stream(b"")], {})
    field = build.add({"T": Text(str(row["c_custkey"]).encode()), "FT": Name("Tx"), "V": Text(row["c_name"].encode()), "Ff": 2, "Subtype": Name("Widget")})
    build.objects[pages[0]]["Annots"] = [field]
    top = build.add({"T": Text(b"c"), "Kids": [field]})
    build.objects[build.trailer["Root"]]["AcroForm"] = build.add({"Fields": [top], "NeedAppearances": True})
    return build.write()


def link_file(row: dict) -> bytes:
    """A page that links to its url."""
    build = Builder()
    pages = with_pages(build, [stream(b"")], {})
    note = build.add({"Type": Name("Annot"), "Subtype": Name("Link"), "Rect": [10, 20, 110, 40], "A": {"S": Name("URI"), "URI": Text((row["url"] or "").encode())}})
    build.objects[pages[0]]["Annots"] = [note]
    return build.write()


def conversation_file(row: dict) -> bytes:
    """A tagged file: an element for each turn, its role as the tag."""
    build = Builder()
    pages = with_pages(build, [stream(b"")], {}, MarkInfo={"Marked": True})
    kids = [build.add({"S": Name(role), "Pg": pages[0], "K": turn, "T": Text(f"turn {turn}".encode())}) for turn, role in sorted(row["turns"])]
    top = build.add({"S": Name("Document"), "K": kids})
    build.objects[build.trailer["Root"]]["StructTreeRoot"] = build.add({"Type": Name("StructTreeRoot"), "K": top})
    return build.write()


def turn_file(row: dict) -> bytes:
    """A tagged file: a document element, below it one for a turn, its role as the tag, and a span with the text's length."""
    build = Builder()
    pages = with_pages(build, [stream(b"")], {}, MarkInfo={"Marked": True})
    span = build.add({"S": Name("Span"), "K": [{"Type": Name("MCR"), "MCID": 7}], "Alt": Text(str(row["n_chars"]).encode())})
    turn = build.add({"S": Name(row["role"]), "Pg": pages[0], "K": [row["turn"], span], "T": Text(f"turn {row['turn']}".encode())})
    top = build.add({"S": Name("Document"), "K": turn})
    build.objects[build.trailer["Root"]]["StructTreeRoot"] = build.add({"Type": Name("StructTreeRoot"), "K": top})
    return build.write()


def label_file(row: dict) -> bytes:
    """Ten pages: the first three in roman numbers, then letters after a prefix, and from the seventh decimal numbers."""
    build = Builder()
    with_pages(build, [stream(b"") for _ in range(10)], {})
    n = row["doc_id"]
    ranges = [0, {"S": Name("r")}, 3, {"S": Name("A"), "P": Text(b"p-"), "St": n % 30 + 1}, 6, {"S": Name("D"), "St": n}]
    build.objects[build.trailer["Root"]]["PageLabels"] = build.add({"Nums": ranges})
    return build.write()


def layer_file(row: dict) -> bytes:
    """Two layers, quality and toxic, on where the label is 1."""
    build = Builder()
    groups = {k: build.add({"Type": Name("OCG"), "Name": Text(k.encode())}) for k in ("quality", "toxic")}
    with_pages(build, [stream(b"")], {"Properties": {k: v for k, v in groups.items()}}, OCProperties=build.add({"OCGs": [*groups.values()], "D": {"OFF": [v for k, v in groups.items() if not row[k]]}}))
    return build.write()


def attachment_file(row: dict) -> bytes:
    """The item's text as an embedded file."""
    build, data = Builder(), (row["text"] or "").encode()
    held = build.add(stream(data, ("FlateDecode",), Type=Name("EmbeddedFile"), Subtype=Name("text/plain"), Params={"Size": len(data)}))
    name = Text(f"item-{row['item_id']}.txt".encode())
    spec = build.add({"Type": Name("Filespec"), "F": name, "UF": name, "EF": {"F": held}})
    with_pages(build, [stream(b"")], {}, Names={"EmbeddedFiles": build.add({"Names": [name, spec]})})
    return build.write()


def outline_file(row: dict) -> bytes:
    """A customer's outline: region, nation and customer below one another, and the segment beside the region."""
    return outlined([(row["r_name"], [(row["n_name"], [(row["c_name"], [])])]), (row["c_mktsegment"], [])])


def outlined(items: list) -> bytes:
    """A file with an outline of (title, items below)."""
    build = Builder()
    pages = with_pages(build, [stream(b"")], {})
    root = build.add({"Type": Name("Outlines")})

    def level(up: Ref, items: list) -> None:
        refs = [build.add({"Title": Text(title.encode()), "Parent": up, "Dest": [pages[0], Name("Fit")]}) for title, _ in items]
        for i, (ref, (_, below)) in enumerate(zip(refs, items, strict=True)):
            if i + 1 < len(refs):
                build.objects[ref]["Next"] = refs[i + 1]
            level(ref, below)
        if refs:
            build.objects[up] |= {"First": refs[0], "Last": refs[-1], "Count": len(refs)}

    level(root, items)
    build.objects[build.trailer["Root"]]["Outlines"] = root
    return build.write()


def documents(df: DataFrame, **options) -> DataFrame:
    """text_file of every row of documents."""
    return built(df.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), lambda row: text_file(row, **options), "doc_id")
