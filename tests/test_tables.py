import json

import duckdb
import pytest

import __spark_entry__
from quarry.api import Corpus
from quarry.functions import validate
from quarry.operators import objects, sinks
from quarry.plans import queries as plans
from quarry.sources import corpora, reader
from quarry.sources.document import Document
from quarry.sources.objects import Ref, Stream
from quarry.streaming import ingest


def normal(rows, columns):
    return sorted(tuple("NULL" if v is None else str(v).removesuffix(".0") for v in (r[c] for c in columns)) for r in rows)


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"create view {t} as select * from '{data}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_against_sql(spark, data, duck, name):
    got = plans.queries()[name](spark, data)
    want = duck.sql(plans.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = [dict(zip(want.columns, r, strict=True)) for r in want.fetchall()]
    assert normal(got.collect(), columns) == normal(rows, columns)


@pytest.mark.parametrize("name", sorted(set(plans.queries()) - {"permissions"}))
def test_one_parse(spark, data, name):
    """Files are made once and parsed once; two readings take two."""
    plan = plans.queries()[name](spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == {"encryption_status": 4, "load_errors": 1}.get(name, 2)


def test_declared_lengths():
    doc = Document(objects={Ref(1, 0): Stream({"Length": 5}, b"abc"), Ref(2, 0): Stream({"Length": 3}, b"abc"), Ref(3, 0): Stream({"Length": Ref(9, 0)}, b"")})
    assert list(validate.lengths(doc)) == [("warn", "Object 1 0: /Length is 5 but stream content is 3 bytes")]


def test_entry(spark, data):
    assert set(plans.queries()) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).limit(3).count() == 3


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    out = tmp_path_factory.mktemp("pdf")
    for i, lines in enumerate(["hello world\nsecond line", "another file", "third with Hello"]):
        (out / f"{i}.pdf").write_bytes(corpora.text_file({"doc_id": i, "text": lines}))
    (out / "bad.pdf").write_bytes(b"nothing")
    return out


def test_corpus_of_files(spark, folder, tmp_path):
    corpus = Corpus(spark, str(folder))
    for held in (corpus, Corpus(spark, str(folder)).saved(str(tmp_path / "silver"))):
        assert held.overview().filter("status = 1").count() == 1 and held.overview().filter("page_count = 1").count() == 3
        assert held.find_text("HELLO").count() == 2 and held.text("2-").count() == 0
        assert held.search("Type=Page").count() == 3 and held.object("1-2,9").count() == 12
        assert held.inspect(1).filter("role = 'Font'").count() == 3 and held.validate().count() == 0
        assert held.tree(1).filter("status = 'depth limit reached'").count() > 0
        assert held.content(as_hex=True).filter("content like '%Tj%'").count() == 3
    assert list(corpus.combined("text", "fonts", "list")) == ["list", "fonts", "text"]
    for wrong in (("text", "search"), ("nonsense",)):
        with pytest.raises(ValueError):
            corpus.combined(*wrong)
    said = {r.doc_key.rsplit("/", 1)[-1]: json.loads(r.json) for r in corpus.combined_json("text", "find_text", "list", pattern="hello", pages="1").filter("load_error is null").collect()}
    assert list(said["0.pdf"]) == ["list", "text", "find_text"] and said["1.pdf"]["find_text"] == [] and said["2.pdf"]["find_text"][0]["snippets"] == ["third with Hello"]
    assert json.loads(corpus.combined_json("text").filter("load_error is null").first().json)[0]["page_number"] == 1
    assert [(r.ord, r.title) for r in corpus.sections("images", "fonts").filter("doc_key like '%0.pdf'").collect()] == [(0, "Fonts"), (1, "Images")]
    for wrong in (("text", "search"), ("nonsense",)):
        with pytest.raises(ValueError):
            corpus.combined_json(*wrong)
    corpus.register_views()
    assert spark.sql("select count(*) from pdf_page_text where contains(text, 'file')").first()[0] == 1


def test_every_part_has_its_schema(spark, folder):
    found = reader.parse(reader.files(spark, str(folder)), list(reader.PARTS)).collect()
    assert len(found) == 4 and sum(r.load_error is not None for r in found) == 1


def test_sinks(spark, folder, tmp_path):
    corpus = Corpus(spark, str(folder))
    sinks.write_lines(corpus.table("dot"), str(tmp_path / "dot"))
    sinks.write_json(corpus.overview(), str(tmp_path / "json"))
    sinks.write_streams(corpus.table("streams"), str(tmp_path / "streams"))
    assert spark.read.text(str(tmp_path / "dot")).filter("value like 'digraph%'").count() == 3 and spark.read.json(str(tmp_path / "json")).count() == 4
    assert spark.read.parquet(str(tmp_path / "streams")).count() == 3
    assert sinks.with_recovery(corpus.overview(), corpus.table("documents")).filter("recovery.count = 0").count() == 3


def test_strict_statuses(spark):
    made = spark.createDataFrame([(str(i), corpora.text_file({"doc_id": i, "text": "a"}, faults=True)) for i in (1, 11)], "doc_key string, content binary")
    parsed = reader.parse(made, ["documents", "issues", "reliability"], recovery="strict")
    assert {r.doc_key: r.status for r in sinks.statuses(parsed, strict=True).collect()} == {"1": 0, "11": 3}


def test_arriving_files(spark, folder, tmp_path):
    for n in (4, 4):  # a second run finds nothing new
        ingest.ingest(spark, str(folder), str(tmp_path / "out"), str(tmp_path / "done")).awaitTermination()
        assert spark.read.parquet(str(tmp_path / "out")).count() == n


@pytest.mark.parametrize("spec, numbers", [("3", [3]), ("5,1-3,2", [1, 2, 3, 5]), (" 4 - 5 ", [4, 5])])
def test_object_specs(spec, numbers):
    assert objects.parse_object_spec(spec) == numbers


@pytest.mark.parametrize("spec", ["", "a", "3-1", "1,,2", "1-"])
def test_wrong_object_specs(spec):
    with pytest.raises(objects.SpecError):
        objects.parse_object_spec(spec)


@pytest.mark.parametrize("spec, pages", [("2", (2, 2)), ("2-4", (2, 4)), ("3-", (3, None))])
def test_page_specs(spec, pages):
    assert objects.parse_page_spec(spec) == pages


@pytest.mark.parametrize("spec", ["0", "4-2", "x", "-3", ""])
def test_wrong_page_specs(spec):
    with pytest.raises(objects.SpecError):
        objects.parse_page_spec(spec)


def test_search_conditions():
    assert objects.parse_search("Type=Font,KEY=A,value=x=y, regex=^a$") == [("equals", "Type", "Font"), ("key", "", "A"), ("value", "", "x=y"), ("regex", "", "^a$")]
    for wrong in ("", "Type", "Type=", "=x"):
        with pytest.raises(objects.SpecError):
            objects.parse_search(wrong)
