"""Every operator on tables with nulls, empty and very long texts, repeated rows, no rows, and further columns."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quarry.llm import decontaminate, html_template, license_scan, line_templates, packing, quality_rff, quality_votes, simhash, token_store, toxicity
from quarry.llm._common import drop_written, new_path, written

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, key string, n long, words string, bin long, host string"
LONG = "one two three four five. " * 20_000


def rows():
    texts = [None, "", " \n\t ", "one", "a b", "Licensed under the MIT License.", LONG, "x" * 200_000, "same text here again", "same text here again", "ünïcode \x00 ß 日本 ​", "line one is here now\nline one is here now"]
    out = [(i, t, "en", "s" if i % 2 else None, len(t or ""), 1.0, "k", 3, "w", 9, "h") for i, t in enumerate(texts)]
    return [*out, out[8], out[8], (None, "no id", None, None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, (i + 1) % 2, "x") for i in range(12)] + [(None, 1, 1, "x"), (3, None, None, "x"), (3, 1, 0, "x")], "doc_id long, quality int, toxic int, text string")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, "same text here again today for everyone. yes it is", 1), (2, None, 1), (3, "", 1), (None, "four words only here", 1), (1, "same text here again today for everyone. yes it is", 1)], "item_id long, text string, doc_id long")


def both(spark, docs, labels, benchmark):
    def token_rows(d):
        import public_tokenizers

        folder = new_path(spark, "test-tokens")
        return token_store.read(spark, folder, token_store.write(d, folder, str(public_tokenizers.path("byte_bpe_50k.json"))))

    return {
        "toxicity": lambda d: toxicity.score(d, toxicity.fit(d, labels)),
        "tokens": token_rows,
        "quality": lambda d: quality_rff.scored(d, labels),
        "votes": quality_votes.judged,
        "licences": license_scan.scanned,
        "simhash": simhash.near_duplicates,
    }


@pytest.mark.parametrize("name", ["toxicity", "tokens", "quality", "votes", "licences", "simhash"])
def test_row_for_row(spark, docs, none, labels, benchmark, name):
    run = both(spark, docs, labels, benchmark)[name]
    got = run(docs).collect()
    assert len(got) == len(rows())
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted((r[0] is None, r[0] or 0) for r in rows())
    assert run(none).count() == 0


def test_scores_stay_within_bounds(docs, labels):
    for df in (toxicity.score(docs, toxicity.fit(docs, labels)), quality_rff.scored(docs, labels)):
        for r in df.collect():
            assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and r.held_out in (True, False)


def test_no_labels(docs, labels):
    empty = labels.limit(0)
    assert {r.score for r in toxicity.score(docs, toxicity.fit(docs, empty)).collect()} == {0.0}
    assert {r.score for r in quality_rff.scored(docs, empty).collect()} == {0.5}


def test_empty_texts(docs, labels):
    by_id = {r.doc_id: r for r in quality_votes.judged(docs).collect()}
    assert by_id[0].n_words == by_id[1].n_words == by_id[2].n_words == 0 and by_id[0].base_failed and not by_id[0].kept
    found = {r.doc_id: r for r in license_scan.scanned(docs).collect()}
    assert (found[0].n_words, found[0].n_base, found[0].first_word, found[0].labels, found[0].score) == (0, 0, None, "", 0.0)
    assert found[5].base_labels == "mit"
    fps = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    assert fps[0].fingerprint == fps[1].fingerprint == "0" * 16 and fps[1].component_id == 0


def test_line_templates(docs, none):
    got = line_templates.without_templates(docs)
    assert got.columns == docs.columns and got.count() == docs.count() and line_templates.without_templates(none).count() == 0
    assert {r.doc_id: r.text for r in got.collect()}[6] == LONG


def test_line_templates_with_clashing_columns(spark):
    line = "this line is on every one of the pages here"
    rows = [(i, f"own words {'abcdef'[i]} of this document only\n{line}", "c", "o", "d", {"a": i}, [i], "x") for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, copy string, of string, `drop` string, m map<string, int>, n array<int>, `a.b` string")
    docs = docs.withColumn("__copy", F.lit(1)).withColumn("_copy", F.lit(1)).withColumn("key", F.lit(2)).withColumn("leaf", F.lit(3))
    got = line_templates.without_templates(docs)
    assert got.schema == docs.schema
    assert {r.doc_id: line in r.text for r in got.collect()} == {0: True} | {i: False for i in range(1, 6)}


def test_keep_one(docs, none):
    got = simhash.keep_one(docs)
    kept = [r.doc_id for r in got.collect()]
    assert got.columns == docs.columns and len(kept) == len(set(kept)) and 8 in kept and 9 not in kept and 0 in kept and 1 not in kept
    assert simhash.keep_one(none).count() == 0


def odd_columns(spark):
    """Repeated ids, map columns and names that are awkward or that operators use themselves."""
    rows = [(i % 4, f"text number {'abcd'[i % 4]} with some words of its own kind here", {"k": i}, [{"z": i}], i, "v") for i in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, m map<string, int>, l array<map<string, int>>, `a.b` int, `tick``s` string")
    for name in ("gone_id", "again_id", "row", "n", "node", "root", "fp", "copy", "cluster", "shard", "c0", "m0"):
        docs = docs.withColumn(name, F.lit(1))
    return docs


def test_stages_with_odd_columns(spark, labels, benchmark):
    docs = odd_columns(spark)
    for got in (simhash.keep_one(docs), line_templates.without_templates(docs), decontaminate.without_benchmark(docs, benchmark), toxicity.drop_toxic(docs, toxicity.fit(docs, labels))):
        assert got.schema.simpleString() == docs.schema.simpleString()
        assert {r[0] for r in got.collect()} == {0, 1, 2, 3}
    assert sorted((r[0], r[4]) for r in simhash.keep_one(docs).collect()) == [(i, i) for i in range(4)]
    assert packing.sequences(docs, packing.packed(docs)).selectExpr("sum(size(doc_ids))").first()[0] == 8


def test_decontaminate(docs, none, benchmark):
    got = decontaminate.without_benchmark(docs, benchmark)
    assert got.columns == docs.columns and got.count() == docs.count()
    assert decontaminate.contaminated(none, benchmark).count() == 0 and decontaminate.contaminated(docs, benchmark.limit(0)).count() == 0
    hit = docs.withColumn("text", F.when(F.col("doc_id") == 3, "before that. Same text here, again today for everyone! Yes: it is. after").otherwise(F.col("text")))
    assert [(r.doc_id, r.item_id) for r in decontaminate.contaminated(hit, benchmark).collect()] == [(3, 1)]


def test_packing(docs, none):
    got = packing.packed(docs, capacity=100).collect()
    assert packing.packed(none).count() == 0
    assert sum(r.n for r in got) == sum(len((r[1] or "").split()) + 1 for r in rows())


def test_drop_toxic(docs, none, labels):
    model = toxicity.fit(docs, labels)
    assert toxicity.drop_toxic(docs, model).columns == docs.columns and toxicity.drop_toxic(none, model).count() == 0


def test_pages(spark):
    pages = spark.createDataFrame([(1, None, None, "x"), (2, "http://[bad", "", "x"), (None, "http://a.b/c", "<p>hi &amp; <b>you", "x"), (4, "http://a.b/d", "<article>" + "<p>long " * 50_000, "x"), (4, "http://a.b/d", "<", "x")], "page_id long, url string, html string, text string")
    got = html_template.main_text(pages).collect()
    assert len(got) == 5 and {r.text for r in got if r.page_id in (1, 2)} == {""} and {r.text for r in got if r.page_id is None} == {"hi & you"}
    assert all(r.n_chars == len(r.text) for r in got)
    assert html_template.main_text(pages.limit(0)).count() == 0


def test_pipeline_shape(spark, data):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "packing"]
    got = corpus_pipeline.run(spark, data)
    assert got.count() > 0


def test_written_tables_can_be_dropped(spark):
    held = written(spark.range(3), "test")
    assert held.count() == 3
    (path,) = {f.rpartition("/")[0] for f in held.inputFiles()}
    drop_written(spark)
    assert not spark._jvm.java.io.File(path.removeprefix("file:").replace("///", "/")).exists()
