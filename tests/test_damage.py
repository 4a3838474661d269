"""Files with numbers out of every range, references to nowhere and damaged bytes never fail a job."""

import random
import re

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.sources import corpora, reader
from quarry.sources.batches import array_of, fitted
from quarry.sources.objects import Name, Ref
from quarry.sources.writer import Builder, stream, with_pages

PARTS = sorted(reader.PARTS)


def sample_files() -> list[bytes]:
    return [
        corpora.text_file({"doc_id": 30, "text": "some text\non two lines", "lang": "en", "source": "s"}, faults=True),
        corpora.text_file({"doc_id": 1, "text": "other text\n" * 20}, kind="mapped", packed=True),
        corpora.text_file({"doc_id": 2, "text": "filtered"}, filters=("LZWDecode",)),
        corpora.text_file({"doc_id": 3, "text": "locked"}, password=b""),
        corpora.part_file({"p_size": 9}), corpora.customer_file({"c_custkey": 1, "c_name": "n"}), corpora.link_file({"url": "http://x"}),
        corpora.conversation_file({"turns": [(1, "user"), (2, "other")]}), corpora.label_file({"doc_id": 7}), corpora.layer_file({"quality": 1, "toxic": 0}),
        corpora.attachment_file({"item_id": 1, "text": "attached"}), corpora.outlined([("n", [("a", []), ("b", [])])]),
    ]


def damaged(data: bytes, rng: random.Random) -> bytes:
    kind = rng.randrange(5)
    if kind == 0:  # a number out of range
        at = rng.choice(list(re.finditer(rb"(?<![\w.])\d+(?![\w.])", data)))
        return data[: at.start()] + str(rng.choice([10**30, 4294967295, 99999999999, 2**31, 2**63, -1, -(10**20)])).encode() + data[at.end() :]
    if kind == 1:  # a reference to another object
        refs = list(re.finditer(rb"\d+ \d+ R", data))
        if refs:
            at = rng.choice(refs)
            return data[: at.start()] + f"{rng.choice([0, 1, 2, 5, 4294967295, 10**12])} {rng.choice([0, 1, 70000])} R".encode() + data[at.end() :]
    if kind == 2:
        return data[: rng.randrange(len(data))]
    if kind == 3:  # other types in a dictionary's place
        keys = list(re.finditer(rb"/(Kids|Contents|Resources|Font|Annots|Rect|W|Index|Length|Filter|Nums|Names|First|Pages|Root|Count|MediaBox)\b", data))
        if keys:
            at = rng.choice(keys)
            return data[: at.end()] + rng.choice([b" null ", b" [1 2 ", b" << /A ", b" (x) ", b" true ", b" -3.5 "]) + data[at.end() :]
    out = bytearray(data)
    for _ in range(rng.randrange(1, 12)):
        out[rng.randrange(len(out))] = rng.randrange(256)
    return bytes(out)


def test_damaged_files_never_fail_the_job(spark):
    rng, good = random.Random(5), sample_files()
    bad = [damaged(rng.choice(good), rng) for _ in range(600)]
    rows = [(f"good-{i}", bytearray(x)) for i, x in enumerate(good)] + [(f"bad-{i}", bytearray(x)) for i, x in enumerate(bad)] + [("none", None), ("empty", bytearray())]
    rng.shuffle(rows)
    alone = {r.doc_key: r for r in reader.parse(spark.createDataFrame([x for x in rows if x[0].startswith("good")], "doc_key string, content binary"), PARTS).collect()}
    got = {r.doc_key: r for r in reader.parse(spark.createDataFrame(rows, "doc_key string, content binary").coalesce(2), PARTS).collect()}
    assert set(got) == {k for k, _ in rows}
    assert all(got[k] == alone[k] and got[k].load_error is None and not got[k].part_errors for k in alone)
    assert got["none"].load_error and got["empty"].load_error


@pytest.mark.parametrize("part, column, value", [("pages", "rotate", None), ("refs", "dst_num", 2**31 - 1), ("fonts", "first_char", None)])
def test_numbers_out_of_range(spark, part, column, value):
    build = Builder()
    pages = with_pages(build, [stream(b"")], {})
    build.objects[pages[0]] |= {"Rotate": 99999999999, "Odd": Ref(4294967295, 0)}
    build.add({"Type": Name("Font"), "Subtype": Name("Type1"), "FirstChar": 10**30})
    (row,) = reader.parse(spark.createDataFrame([("a", bytearray(build.write()))], "doc_key string, content binary"), [part, "objects"]).collect()
    assert row.load_error is None and not row.part_errors and row.objects
    assert value in [r[column] for r in row[part]]


def test_a_part_that_fails_is_named(spark, monkeypatch):
    def fails(doc):
        raise OverflowError("too much")

    monkeypatch.setitem(reader.PARTS, "layers", (reader.PARTS["layers"][0], fails))
    (row,) = reader.parse(spark.createDataFrame([("a", bytearray(sample_files()[0]))], "doc_key string, content binary"), ["layers", "objects"]).collect()
    assert row.part_errors == {"layers": "OverflowError: too much"} and row.load_error is None and row.objects and not row.layers


ANY = st.recursive(st.one_of(st.none(), st.booleans(), st.integers(), st.floats(), st.text(), st.binary(), st.just("\ud800")), lambda x: st.one_of(st.lists(x, max_size=3), st.dictionaries(st.sampled_from(["obj_num", "gen", "name", "x"]), x, max_size=4)), max_leaves=8)
KIND = pa.list_(pa.struct([("obj_num", pa.int32()), ("gen", pa.int32()), ("name", pa.string()), ("x", pa.list_(pa.float64())), ("m", pa.map_(pa.string(), pa.int32())), ("b", pa.bool_()), ("d", pa.binary())]))


@given(st.lists(st.lists(st.dictionaries(st.sampled_from(["obj_num", "gen", "name", "x", "m", "b", "d"]), ANY, max_size=5), max_size=3), max_size=3))
@settings(deadline=None, max_examples=300)
def test_whatever_fits(rows):
    found = array_of(rows, KIND)
    assert isinstance(found, pa.Array) and len(found) == len(rows)


def test_fitted_keeps_what_fits():
    row = [{"obj_num": 3, "gen": 2**40, "name": "n", "x": [1.0, 2.0], "m": {"a": 1, "b": 2**50}, "b": True, "d": b"x"}]
    assert fitted(row, KIND) == [{"obj_num": 3, "gen": 2**31 - 1, "name": "n", "x": [1.0, 2.0], "m": [("a", 1), ("b", None)], "b": True, "d": b"x"}]
