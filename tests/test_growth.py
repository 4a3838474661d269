"""What a file costs to make and to read, counted in calls, and what a worker holds: neither may grow faster than the input."""

import sys

from quarry.functions import codecs, text
from quarry.functions.cmap import cmap_of
from quarry.operators import objects
from quarry.operators import text as text_operators
from quarry.plans import queries as plans
from quarry.sources import cases, corpora, crypt, reader
from quarry.sources.batches import BATCH_BYTES
from quarry.sources.document import load
from quarry.sources.objects import Stream, operations
from quarry.sources.writer import Builder

LINES = [f"line {i} of a text with some words in it" for i in range(800)]
FILE = {"doc_id": 1001, "text": "\n".join(LINES)}  # the id divides by 7, 11 and 13


def calls(f, *args) -> int:
    """Calls that Python makes while f runs."""
    n = 0

    def count(frame, event, arg):
        nonlocal n
        n += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        f(*args)
    finally:
        sys.setprofile(None)
    return n


def executed(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_snippets_need_no_worker_of_their_own(spark, data):
    """Matches come from the parse; where text is held, its condition isn't a second evaluation."""
    plan = executed(plans.queries()["find_text_snippets"](spark, data))
    assert "EvalPython" not in plan and plan.count("MapInArrow") == 2
    pages = spark.createDataFrame([("a", 1, "The other"), ("b", 2, None), ("c", 1, "none")], "doc_key string, page_number int, text string")
    found = text_operators.find_text(pages, "the")
    assert executed(found).count("EvalPython") == 0 and [tuple(r) for r in found.collect()] == [("a", 1, ["The other", "The other"])]


def test_base85_by_array_operations():
    held = bytes(range(256)) * 40
    made = codecs.to_ascii85(held)
    assert calls(codecs.to_ascii85, held) < 100 and calls(codecs.ascii85, made) < 100
    for data in (held, held + b"x", b"\0" * 8 + b"abc", b"\0\0\0", b"", b"ab\0\0\0\0cd\0"):
        assert codecs.ascii85(codecs.to_ascii85(data)) == data
    assert codecs.to_ascii85(bytes(8) + b"a\0") == b"zz@/p~>"


def test_search_of_files_leaves_streams_where_they_are(spark, data):
    plan = executed(plans.queries()["search_streams"](spark, data))
    assert "translate" not in plan and "raw: binary" not in plan and "data#" not in plan
    rows = [(str(i), corpora.text_file({"doc_id": i, "text": t}, filters=corpora.FILTERS[i])) for i, t in enumerate(["a License\nb", "none", "LICENSE É", "license É x", "é", "licens"])]
    found = spark.createDataFrame(rows, "doc_key string, content binary")
    for said in ("stream=LICENSE", "stream=É", "stream=license,stream=\xc9", "stream=x,stream=X,Length=1", "stream=T*,key=Length", "stream=é,regex=F1"):
        want = objects.search(reader.parse(found, objects.search_parts(said)), said).collect()
        assert sorted(map(tuple, objects.search_files(found, said).collect())) == sorted(map(tuple, want))
    assert objects.search_files(found, "stream=LICENSE").count() == 3


def test_a_map_is_read_once_for_all_files():
    files = [cases.mapped_file(f"Customer#{i:09d} BUILDING") for i in range(2)]
    reader.PARTS["page_text"][1](load(files[0]))
    assert calls(lambda: reader.PARTS["page_text"][1](load(files[1]))) < 1800
    assert cmap_of(cases.MAP) is cmap_of(bytes(bytearray(cases.MAP)))
    cmap = cmap_of(cases.MAP)
    assert cmap.texts(b"A \x80\x31\x81\x01\x01", 1) == ["А", " ", "١", "AB", None]


def test_lzw_without_calls_for_each_byte():
    held = FILE["text"].encode()
    made = codecs.to_lzw(held)
    assert codecs.lzw(made) == held and calls(codecs.to_lzw, held) < len(held) // 8 and calls(codecs.lzw, made) < 2.5 * len(made)


def test_batches_hold_few_bytes(spark, data):
    """A worker's batches are small beside what a worker takes anyhow, so that its memory hardly grows with the input."""
    plans.queries()["largest_streams"](spark, data)
    assert BATCH_BYTES <= 2 << 20 and int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= BATCH_BYTES


def test_rc4_without_calls_for_each_byte():
    held = FILE["text"].encode()
    for key in (b"Key", bytes(range(16)), b"\0" * 5):
        for data in (b"", b"x", held[:255], held[:256], held[:257], held):
            assert crypt.rc4(key, data) == crypt.plain_rc4(key, data) and crypt.plain_rc4(key, crypt.rc4(key, data)) == data
    assert crypt.plain_rc4(b"Key", b"Plaintext").hex() == "bbf316e8d940af0ad3"
    assert calls(crypt.rc4, b"Key", held) < 100 or crypt._library_rc4() is None


def test_generations_in_the_row(spark, data):
    assert "hashpartitioning" not in executed(plans.queries()["duplicate_generations"](spark, data))
    doc = load(corpora.text_file({"doc_id": 13, "text": "a"}, faults=True))
    assert reader.PARTS["generations"][1](doc) == [{"obj_num": 1, "gens": [0, 1]}]


def test_content_is_read_token_by_token():
    data = corpora.shown_lines(LINES, "win")
    assert len(operations(data)) == 4 + 2 * len(LINES) and calls(operations, data) < 16 * len(LINES)
    assert operations(b"%)\n(a)Tj[1(b)]TJ/N gs true x") == [("Tj", [b"a"]), ("TJ", [[1, b"b"]]), ("gs", ["N"]), ("x", [True])]


def test_streams_are_decrypted_when_they_are_read():
    doc = load(corpora.text_file(FILE, password=b""))
    streams = [v for v in doc.objects.values() if isinstance(v, Stream)]
    reader.PARTS["documents"][1](doc)
    assert len(streams) == 100 and all(s.key is not None for s in streams)
    assert streams[0].raw.startswith(b"BT /F1 12 Tf") and streams[0].key is None and streams[0].raw.endswith(b"ET")


def test_loading_repaired_files():
    made = corpora.text_file(FILE, faults=True)
    assert load(made).recovery and calls(load, made) < 250 * 100


def test_numbers_of_objects_are_given_without_a_search():
    def added():
        build = Builder()
        for i in range(500):
            build.add(i)
        return build

    build = added()
    assert calls(added) < 10 * 500 and build.add(None) == (501, 0)
    assert build.add(None, num=7, gen=1) == (7, 1) and build.add(None, num=900) == (900, 0) and build.add(None) == (901, 0)


def test_rich_files():
    made = cases.rich_file(3 * 5 * 6 * 7 - 1)
    assert calls(load, made) < 3500


def test_pages_are_interpreted_once_for_text_and_matches(monkeypatch):
    met, page = [], text.Interpreter.page
    monkeypatch.setattr(text.Interpreter, "page", lambda self, ref: met.append(ref) or page(self, ref))
    doc = load(corpora.text_file(FILE))
    shown, found = reader.PARTS["page_text"][1](doc), reader.PARTS["matches"][1](doc, pattern="OF A")
    assert len(met) == len(shown) == len(found) == 100 and len(found[0]["snippets"]) == 8


def test_split_content():
    doc = load(cases.split_file(FILE))
    assert calls(reader.PARTS["page_text"][1], doc) < 65 * len(LINES)


def test_single_bytes_are_decoded_as_a_string():
    doc = load(corpora.text_file(FILE))
    font = text.Font(doc, "F1", doc.objects[(1, 0)])
    assert font.show(b"a\x80\x7f") == "a€�"
    standard = load(corpora.text_file(FILE, kind="standard"))
    assert "".join(text.Font(standard, "F1", standard.objects[(1, 0)]).show(b"`\xae\x80")) == "‘fi�"


def test_cross_references_are_read_an_entry_at_a_time():
    build = Builder()
    for i in range(500):
        build.add(i)
    build.trailer["Root"] = build.add({})
    assert calls(load, build.write()) < 50 * 500


def test_tables_of_base_encodings_are_shared():
    fonts = [text.Font(doc, "F1", doc.objects[(1, 0)]) for doc in (load(corpora.text_file({"doc_id": i, "text": "a"}, kind="standard")) for i in range(2))]
    assert fonts[0].table is fonts[1].table and fonts[0].table[0xAE] == "fi"


def test_streams_through_each_filter():
    held = FILE["text"].encode() + b"a" * 300 + b"bb" + bytes(131)
    made = codecs.to_run_length(held)
    assert codecs.run_length(made) == held and made.endswith(b"\x81a\x81a\xd5a\x01bb\x81\x00\xfe\x00\x80")
    assert calls(lambda: [reader.PARTS["streams"][1](load(corpora.text_file(FILE, filters=f))) for f in corpora.FILTERS]) < 12 * len(FILE["text"])


def test_streams_without_their_bytes():
    doc = load(corpora.text_file(FILE, filters=("LZWDecode",)))
    rows = reader.PARTS["streams"][1](doc)
    assert rows[0]["data"] and reader.PARTS["streams"][1](doc, held=False) == [r | {"raw": None, "data": None} for r in rows]


def test_making_and_reading_a_text():
    def there_and_back():
        return reader.PARTS["page_text"][1](load(corpora.text_file(FILE)))

    assert "\n".join(p["text"] for p in there_and_back()) == FILE["text"] and calls(there_and_back) < 110 * len(LINES)


def test_parts_of_one_object():
    doc = load(corpora.text_file(FILE))
    for part in ("values", "roles"):
        rows = reader.PARTS[part][1](doc)
        assert len(rows) > 200 and reader.PARTS[part][1](doc, only=2) == [r for r in rows if r["obj_num"] == 2]
    refs = reader.PARTS["refs"][1](doc)
    assert reader.PARTS["refs"][1](doc, only=2) == [r for r in refs if 2 in (r["src_num"], r["dst_num"])]
