"""Operators against brute-force versions, exact round trips and held-out accuracy."""

import io
import re
import struct
import sys
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.llm import decontaminate, html_template, license_scan, line_templates, packing, quality_rff, quality_votes, simhash, token_store, toxicity
from quarry.llm._common import new_path, table

MIDDLE = "/root/testdata/sf0.01"
WORDS = st.text(alphabet=st.sampled_from("abAB \t\n\x1c\xa0é,.#"), max_size=60)


# SimHash


def slow_fingerprint(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


@given(WORDS)
@settings(deadline=None)
def test_fingerprint(text):
    assert simhash.fingerprint(text) == slow_fingerprint(text)


def slow_components(values, max_bits):
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a in values:
        for b in values:
            if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= max_bits:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {v: find(v) for v in values}


def test_links_in_sparse_and_full_blocks(spark):
    rng = np.random.default_rng(3)
    values = {int(v) for v in rng.integers(-(1 << 62), 1 << 62, 60)}
    base = int(rng.integers(0, 1 << 60))
    values |= {base ^ (1 << int(i)) ^ (1 << int(j)) for i, j in rng.integers(0, 60, (150, 2))}  # one full block
    values |= {v ^ 5 for v in list(values)[:20]}
    fps = spark.createDataFrame([(v,) for v in values], "fp long")
    for max_bits in (0, 1, 2):
        edges = simhash.links(fps, max_bits).collect()
        assert all(((r.a ^ r.b) & (1 << 64) - 1).bit_count() <= max_bits for r in edges)
        found = {v: v for v in values}
        if edges:
            found |= {r.node: r.root for r in simhash.components(spark.createDataFrame(edges)).collect()}
        assert found == slow_components(values, max_bits)


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r.node: r.root for r in simhash.components(edges).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {101: 100}


@pytest.mark.parametrize("share", [1.0, 0.95, 0.85, 0.7])
def test_similar_texts(spark, share):
    rng = np.random.default_rng(int(share * 100))
    rows, truth = [], set()
    for i in range(30):
        words = [f"w{x}" for x in rng.integers(0, 5000, 300)]
        other = list(words)
        for at in range(0, 300, max(1, int(5 / (1 - share)) if share < 1 else 10**6)):
            other[at] = "changed"
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
        a, b = ({tuple(x[k : k + 5]) for k in range(296)} for x in (words, other))
        if a != b and len(a & b) / len(a | b) >= 0.8:
            truth.add((2 * i, 2 * i + 1))
    got = {(r.a, r.b) for r in simhash.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got <= truth and len(got) >= 0.95 * len(truth)


def test_a_large_group_of_near_copies(spark):
    rng = np.random.default_rng(8)
    words = [f"w{x}" for x in rng.integers(0, 5000, 200)]
    rows = []
    for i in range(400):
        w = list(words)
        if i:
            w[int(rng.integers(0, 200))] = f"x{i % 37}"
        rows.append((i, " ".join(w), "s"))
    docs = spark.createDataFrame([*rows, (900, "quite another text", "s")], "doc_id long, text string, source string")
    assert sorted(r.doc_id for r in simhash.keep_one(docs).collect()) == [0, 900]


@pytest.mark.parametrize("edits", [(2, 5), (3, 6)])
def test_a_large_family_of_edited_copies(spark, edits):
    rng = np.random.default_rng(31)
    words, rows = [f"w{x}" for x in rng.integers(0, 5000, 200)], []
    for i in range(400):
        w = list(words)
        for at in rng.choice(200, int(rng.integers(*edits)), replace=False):
            w[at] = f"x{i}y{at}"
        rows.append((i, " ".join(w)))
    hashes = [simhash.shingle_hashes(t, 5) for _, t in rows]
    codes = {h: k for k, h in enumerate(np.unique(np.concatenate(hashes)).tolist())}
    ones = np.zeros((400, len(codes)), np.float32)
    for i, h in enumerate(hashes):
        ones[i, [codes[x] for x in h.tolist()]] = 1
    common, n = ones @ ones.T, ones.sum(axis=1)
    near = common / (n[:, None] + n[None, :] - common) >= 0.8
    root = list(range(400))
    for _ in range(400):
        again = [min(root[j] for j in np.nonzero(near[i])[0]) for i in range(400)]
        if again == root:
            break
        root = again
    links = simhash.similar(spark.createDataFrame(rows, "doc_id long, text string"))
    assert all(near[r.a, r.b] for r in links.collect())
    got = {r.node: r.root for r in simhash.components(links).collect()}
    assert [got.get(i, i) for i in range(400)] == root and 1 < len(set(root)) < 400


# Token files


@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(-(2**63), 2**63 - 1)), st.binary(max_size=40).map(lambda b: b[: len(b) // 4 * 4])), max_size=30))
@settings(deadline=None)
def test_file_round_trip(rows):
    out = io.BytesIO()
    writer = token_store.Writer(out)
    for d, ids in rows:
        writer.add(d, ids)
    writer.close()
    assert list(token_store.Reader(io.BytesIO(out.getvalue())).documents()) == rows


def test_reader_skips_frames_and_checks_them(monkeypatch):
    monkeypatch.setattr(token_store, "FRAME_BYTES", 64)
    out = io.BytesIO()
    writer = token_store.Writer(out)
    for d in range(50):
        writer.add(d, struct.pack("<5I", *range(d, d + 5)))
    writer.close()
    data = bytearray(out.getvalue())
    reader = token_store.Reader(io.BytesIO(data))
    opened = []
    whole = reader.frame
    reader.frame = lambda k: opened.append(k) or whole(k)
    assert [d for d, _ in reader.documents({7, 30})] == [7, 30] and len(opened) == 2 < len(reader.frames)
    at, (size, _, _) = reader.frames[3]
    data[at + size - 3] ^= 0xFF
    with pytest.raises(Exception):
        list(token_store.Reader(io.BytesIO(data)).frame(3))


def test_seek_table_is_the_public_format():
    out = io.BytesIO()
    writer = token_store.Writer(out)
    writer.add(1, b"\1\0\0\0")
    writer.close()
    n, flags, magic = struct.unpack("<IBI", out.getvalue()[-9:])
    assert (n, flags, magic) == (2, 0x80, 0x8F92EAB1)
    import zstandard

    assert zstandard.ZstdDecompressor().stream_reader(io.BytesIO(out.getvalue())).read() == struct.pack("<I", 1) + struct.pack("<qBI", 1, 1, 1) + b"\1\0\0\0"


@pytest.fixture(scope="module")
def encoder():
    import public_tokenizers

    return token_store.Encoder(str(public_tokenizers.path("byte_bpe_50k.json")))


@pytest.fixture(scope="module")
def library():
    """The tokenizers library as a user calls it."""
    import public_tokenizers
    from tokenizers import Tokenizer

    fresh = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    return lambda text: b"".join(struct.pack("<I", i) for i in fresh.encode(text, add_special_tokens=False).ids)


PIECES = st.one_of(st.sampled_from(list("ab'sé ,.\n\t\xa0\x85\x1c日3½ʼ<|>") + ["<|", "endoftext", "|>", "<|endoftext|>", " the", "The", "'ll", "\u200b", "Ǆ", "ɐ"]), st.characters(exclude_categories=["Cs"]))


@given(st.lists(PIECES, max_size=40).map("".join))
@settings(deadline=None, max_examples=1000)
def test_pieces_encode_as_the_library_does(encoder, library, text):
    assert encoder.encode(text) == library(text)


def test_added_tokens(encoder, library):
    assert encoder.encode("a<|endoftext|>b") == library("a<|endoftext|>b") == struct.pack("<3I", 64, 50256, 65)


def test_what_an_encoder_remembers_is_bounded(library):
    import public_tokenizers

    coder, held = token_store.Encoder(str(public_tokenizers.path("byte_bpe_50k.json"))), 0
    texts = [" ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676 % 26)}{chr(97 + i // 17576 % 26)}{chr(97 + i // 456976)}" for i in range(at, at + 10_000)) for at in range(0, 900_000, 10_000)]
    for i, text in enumerate(texts):
        ids = coder.encode(text)
        assert i % 30 or ids == library(text)
        if i % 10 == 9:
            held = max(held, sum(sys.getsizeof(x) + sum(sys.getsizeof(k) + sys.getsizeof(v) for k, v in x.items()) for x in (coder.known, coder.known.older, coder.runs)))
    assert held < 100e6  # two Python workers of an executor each remember so much


@pytest.mark.parametrize("text", ["a word.\nNext", " a,\n\nb.", "x don't's.\nIt's 3,5.\n\n\nüb, Äb;", "a b'\n'll", "a ., .b. !?", "a Ab\u0250.\nc ½,\nd", "a \x1c. b\x1c,\nc"])
def test_pieces_over_ends_of_lines(encoder, library, text):
    for _ in range(2):
        assert encoder.encode(text) == library(text)
    assert not any("\n" in piece for piece in encoder.known)


def test_tokens_in_order(spark, data, library):
    import public_tokenizers

    docs = table(spark, data, "documents")
    folder = new_path(spark, "test-tokens")
    files = token_store.write(docs, folder, str(public_tokenizers.path("byte_bpe_50k.json")))
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_store.read(spark, folder, files).collect()}
    start = 0
    for r in docs.orderBy("doc_id").collect():
        ids = library(r.text) + bytes(4)
        assert got[r.doc_id] == (start, len(ids) // 4, zlib.crc32(ids))
        start += len(ids) // 4


# Quality votes


def slow_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    found = Counter(windows)
    covered = {j for i, w in enumerate(windows) if found[w] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


@given(WORDS)
@settings(deadline=None, max_examples=300)
def test_base_counts(text):
    assert quality_votes.counts(text)[:5] == slow_counts(text)




def test_votes_separate_quality(spark):
    labels = table(spark, MIDDLE, "labels").select("doc_id", F.col("quality").alias("truth"))
    got = quality_votes.judged(table(spark, MIDDLE, "documents")).join(labels, "doc_id").filter("NOT base_failed").collect()
    assert sum(r.kept == (r.truth == 1) for r in got) > 0.97 * len(got)


def test_estimate_finds_the_informative_rule():
    rng = np.random.default_rng(1)
    y = rng.random(4000) < 0.8
    n = len(quality_votes.RULES)
    votes = np.where(rng.random((4000, n)) < np.where(y[:, None], 0.03, 0.6), -1, 1)
    patterns, weights = np.unique(votes, axis=0, return_counts=True)
    model = quality_votes.estimate(patterns, weights.astype(float))
    assert ((quality_votes.posterior(votes, model) > 0.5) == y).mean() > 0.97 and abs(model["prior"] - 0.8) < 0.05


# Licences


@pytest.mark.parametrize("said, value, labels", [
    ("MIT", 0.9, {"mit"}), ("MIT OR GPL-3.0-only", 0.9, {"mit", "gpl"}), ("MIT AND GPL-3.0-only", 0.4, {"mit", "gpl"}), ("GPL-2.0-only WITH Classpath-exception-2.0", 0.5, {"gpl"}),
    ("(MIT OR GPL-2.0+) AND CC-BY-NC-4.0", 0.2, {"mit", "gpl", "cc-by-nc"}), ("MIT OR GPL-3.0-only AND CC-BY-NC-4.0", 0.9, {"mit", "gpl", "cc-by-nc"}), ("mit or Unheard-1.0", 0.9, {"mit", "unheard"}),
])
def test_expressions(said, value, labels):
    got, freedom = license_scan.evaluate(said)
    assert got == labels and freedom == pytest.approx(value)


@pytest.mark.parametrize("said", ["MIT OR", "(MIT", "MIT)", "AND MIT", "MIT GPL-2.0", "()"])
def test_broken_expressions(said):
    assert license_scan.postfix(said) is None and license_scan.evaluate(said)[1] is None


def slow_base(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    hits = [(i, license_scan.BASE[p]) for p in license_scan.BASE for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    at = [i for i, _ in hits]
    return len(words), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in hits}))


@given(st.lists(st.sampled_from(["MIT", "mit-", "License", "license,", "apache", "GENERAL", "public", "é", "x", "\n", "lesser"]), max_size=30).map(" ".join))
@settings(deadline=None, max_examples=300)
def test_base_phrases(text):
    assert license_scan.scan(text, license_scan.automaton())[:5] == slow_base(text)


def test_tags():
    got = license_scan.scan("/* SPDX-License-Identifier: (Apache-2.0 OR GPL-2.0-only) */\nLicensed under CC BY-NC 4.0.", license_scan.automaton())
    assert got[5] == "apache,cc-by-nc,gpl" and got[6] == 0.2


# Pages


def test_blocks():
    page = """<html><head><title>T</title></head><body><nav><ul><li><a href=x>menu</a></ul></nav><div class="ad">buy</div>
    <article><header><h1>Head &amp; line</h1></header><p>one <b>two<br>three</b>\n four<p>five<script>var x="</p>"</script></p><div class=comments>no</div></article><footer>&copy;</footer>"""
    assert [t for _, t, _, _ in html_template.blocks(page)] == ["Head & line", "one two three four", "five"]


def test_template_texts_go_where_no_element_tells(spark):
    def page(i):
        return f"<body><div class=top><p>Site name and slogan</p></div><div><p>own text of page {i}</p><p>more {i * i}</p></div><table><tr><td>Contact us here</td></tr></table>"

    pages = spark.createDataFrame([(i, f"http://host.example/{i}", page(i)) for i in range(6)] + [(9, "http://other.example/", page(9))], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_template.main_text(pages).collect()}
    assert got[3] == "own text of page 3\n\nmore 9" and "Site name" in got[9]


def test_articles_keep_repeated_paragraphs(spark):
    pages = spark.createDataFrame([(i, f"http://host.example/{i}", f"<article><p>the same</p><p>page {i}</p></article>") for i in range(5)], "page_id long, url string, html string")
    assert {r.text for r in html_template.main_text(pages).collect()} == {f"the same\n\npage {i}" for i in range(5)}


def slow_main_text(rows, min_pages=html_template.MIN_PAGES):
    """By whole occurrence vectors, host by host: {(page_id, url): text} of (page_id, url, html)."""
    hosts = {}
    for _, url, page in rows:
        if page:
            hosts.setdefault(html_template.host_of(url), {})[page] = html_template.Page(page, html_template.host_of(url))
    fixed = {}
    for host, pages in hosts.items():
        containers, words, of = {}, {}, {}
        for i, page in enumerate(pages.values()):
            for path, n in page.counts.items():
                containers.setdefault(path, {})[i] = n
                of[path] = page.chain(path)
            for token, n in page.words().items():
                words.setdefault(token, {})[i] = n
        fixed[host] = {html_template._token(*t): len(v) for t, v in words.items() if len(v) >= min_pages and any(containers[c] == v for c in of[t[0]])}
    out = {}
    for page_id, url, page in rows:
        host = html_template.host_of(url)
        blocks = html_template.Page(page, host).blocks
        out[page_id, url] = "\n\n".join(b.text for b in html_template.chosen(blocks, fixed.get(host, {})))
    return out


def site(rng, host, n, n_items=6):
    """Pages without an article element or a telling class, and the main text of each."""
    vocabulary = [f"{chr(97 + int(a))}{chr(97 + int(b))}{chr(97 + int(c))}" for a, b, c in rng.integers(0, 26, (400, 3))]
    said = lambda k: " ".join(vocabulary[int(x)] for x in np.minimum(rng.zipf(1.3, k), 400) - 1)
    names = ["".join(chr(97 + int(x)) for x in rng.integers(0, 26, 7)) for _ in range(6)]
    motto, notice, items = said(8), said(25), [said(2) for _ in range(n_items)]
    out = []
    for i in range(n):
        main = [said(6), *[said(int(rng.integers(15, 60))) for _ in range(int(rng.integers(2, 6)))]]
        links = "".join(f"<li><a href=/{j}>{x}</a></li>" for j, x in enumerate(items))
        extra = f"<table><tr><td>{said(20)}</td><td>{said(9)}</td></tr></table>" if i % 3 == 0 else ""
        more = [b for b in re.findall("<td>(.*?)</td>", extra)]
        page = f"""<html><body><div class={names[0]}><p>{motto}</p><ul>{links}</ul></div><div class={names[1]}><h2>{main[0]}</h2>{"".join(f"<p>{x}</p>" for x in main[1:])}{extra}</div>
        <div class={names[2]}>Page {i + 1} of {n}</div><div class={names[3]}><p>{notice}</p></div></body></html>"""
        out.append((page, "\n\n".join([*main, *more])))
    return [(f"http://{host}/{i}", page, text) for i, (page, text) in enumerate(out)]


def f1(got, want):
    a, b = Counter(got.split()), Counter(want.split())
    return 2 * sum((a & b).values()) / max(1, sum(a.values()) + sum(b.values()))


@pytest.mark.parametrize("way", ["broadcast", "joined"])
def test_sites_without_telling_elements(spark, monkeypatch, way):
    monkeypatch.setattr(html_template, "FAN", 3)
    if way == "joined":
        monkeypatch.setattr(html_template, "BROADCAST_WORDS", 0)
        monkeypatch.setattr(html_template, "HELD", 900)
    rng = np.random.default_rng(9)
    made = [x for h, n in (("a.example", 60), ("b.example", 25), ("c.example", 7), ("d.example", 3), ("e.example", 1), ("www.f.example", 12)) for x in site(rng, h, n)]
    rows = [(i, url, page) for i, (url, page, _) in enumerate(made)]
    rows += [(i + 10_000, url, page) for i, url, page in rows[:9]] + [(20_000, None, "<p>no host"), (20_001, "http://a.example/x", None), (20_002, "http://a.example/y", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(7)
    got = {(r.page_id, r.url): r.text for r in html_template.main_text(pages).collect()}
    assert got == slow_main_text(rows)
    scores = [f1(got[i, url], text) for i, (url, _, text) in enumerate(made) if "d.example" not in url and "e.example" not in url]
    assert min(scores) >= 0.8 and sum(scores) / len(scores) >= 0.97, (min(scores), sum(scores) / len(scores))
    off = {(r.page_id, r.url): r.text for r in html_template.main_text(pages, min_pages=10**6).collect()}
    assert sum(off[k] != got[k] for k in got) > 90 and sum(f1(off[i, u], t) for i, (u, _, t) in enumerate(made)) / len(made) < 0.9


def test_classes_nest(spark):
    rng = np.random.default_rng(3)
    pages = spark.createDataFrame([(i, url, page) for i, (url, page, _) in enumerate(site(rng, "a.example", 12))], "page_id long, url string, html string")
    found = html_template.template(pages).collect()
    top = max(found, key=lambda r: r.n_pages)
    assert top.n_pages == 12 and len(top.words) > 20 and len(top.containers) >= 4
    own = {c: r.vector for r in found for c in r.containers}
    assert all(a not in r.containers for r in found for a in r.around) and len(own) == sum(len(r.containers) for r in found)


@pytest.mark.parametrize("page, want", [
    ("<body class='single has-sidebar'><h1>Head</h1><p>Body text", "Head|Body text"),
    ("<form id=aspnet><h1>Head</h1><p>All of the page is in a form</p><input><select><option>x</select></form>", "Head|All of the page is in a form"),
    ("<p>the long main text of this page is here</p><form><label>Your name</label><input></form>", "the long main text of this page is here"),
    ("<article class='post comments-open'><p>kept</p></article>", "kept"),
    ("<article><p>one</p><p id=share-price>two</p><div class=related-work>three</div><p class='share-buttons'>no</p></article>", "one|two|three"),
    ("<p>where <math><mi>x</mi><mo>=</mo><mn>2</mn></math> and <object>shown</object> hold", "where x=2 and shown hold"),
    ("<p title=Bob's>first</p><p title='a>b'>second</p><p title=\"it's\">third", "first|second|third"),
    ("<main><p>a text outside of it</p><article><p>inside</p></article><p>and after</p></main>", "a text outside of it|inside|and after"),
    ("<article><p>the article</p><div class=comment-list><article class=comment><p>said a reader</p></article></div><article class='user-comment'>so</article></article>", "the article"),
    ("<div class=site-header>Site</div><header>Top</header><h1>Head</h1><p>Text of it</p><aside>Side</aside><div class='alert alert-info'>Notice</div><footer>End</footer>", "Head|Text of it"),
    ("<div class=widget><h1>Head</h1><p>Text</p></div><div class=widget>No</div>", "Head|Text"),
    ("<article><header><h1>Head</h1></header><p>Text<nav>No</nav><ul><li>one<li>two<ul><li>three</ul></ul>tail</article>", "Head|Text|one|two|three|tail"),
    ("<h1>Head</h1><p>Text</p><div id=disqus_thread>no</div><ol class=commentlist><li>no</ol><div class='social-media-links'>no</div><ins class=adsbygoogle>no</ins>", "Head|Text"),
    ("<p>Text <span class=ad>buy</span> goes on</p><div class=leftSidebar>no</div><div class=thread>kept</div><div class='media-text'>kept too</div>", "Text goes on|kept|kept too"),
    ("<x-page><p>own <x-word>element</x-word> names</x-page>", "own element names"),
    ("<p>a<table><tr><td><p>b</td><td>c</table>d", "a|b|c|d"),
    ("<div>" * 3000 + "deep" + "</div>" * 3000 + "<p>after", "deep|after"),
    ("x < y &amp; z<br>next &lt;b&gt;<!-- no --><script>no()</script><style>no</style>", "x < y & z next <b>"),
])
def test_single_pages(page, want):
    assert [b.text for b in html_template.chosen(html_template.Page(page).blocks, {})] == want.split("|")


def test_boilerplate_inside_articles(spark):
    words = [f"{chr(97 + i % 26)}{chr(97 + i // 26)}x" for i in range(400)]
    own = lambda i: " ".join(words[(i * 37 + 11 * k) % 400] for k in range(20))
    pages = [(i, f"http://h.example/{i}", f"<article><p>{own(i)}</p><p>Get all our letters by post each week</p></article>") for i in range(12)]
    pages += [(100 + i, f"http://copies.example/{i}", f"<article><p>the very same text of twelve pages is here</p><p>but for number {i}</p></article>") for i in range(12)]
    got = {r.page_id: r.text for r in html_template.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert all(got[i] == own(i) for i in range(12))
    assert all(got[100 + i] == f"the very same text of twelve pages is here\n\nbut for number {i}" for i in range(12))


# Lines


@given(st.lists(st.sampled_from(["a", "b ", "\u00e9", " ", "\n", "  ", "\t", "1", "\u0663", "\u65e5", "\x1c", "\xa0", ".", "Ab", "_", "\u00b2", "\u0436", "\u3000"]), max_size=30).map("".join))
@settings(deadline=None, max_examples=500)
def test_lines_are_cut_as_their_tokens(text):
    """Texts without digits and odd white space aren't split into tokens; the result is as if they were."""
    tokens = [x for x in map(line_templates.masked, text.split("\n")) if any(re.search(r"[^\W\d_]", t) for t in x)]
    assert list(line_templates._cut(text)) == [(" ".join(x), len(x), x[:3]) for x in tokens]


def test_templates_across_documents(spark):
    passage = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(55))
    rows = [(i, f"own line {'abcdefghij'[i]} of this document only here {'abcdefghij'[i]}\n{passage}\nsession opened for {"abcdefghij"[i] * 3} logged in from home at {i}:0{i} today\ntail {'abcdefghij'[i]}", "n", 1) for i in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars int")
    got = {r.doc_id: r for r in line_templates.without_templates(docs).collect()}
    assert passage in got[0].text and not any(passage in got[i].text for i in range(1, 8))
    assert "logged in" in got[0].text and not any("logged in" in got[i].text for i in range(1, 8))
    assert all(r.text.startswith("own line") and r.text.endswith(f"tail {'abcdefghij'[r.doc_id]}") for r in got.values())
    assert all(r.n_chars == len(r.text) for i, r in got.items() if i)


def test_copies_stay_whole(spark):
    body = "\n".join(f"line number {w} of a text that has several of them" for w in ("one", "two", "three", "four", "five"))
    docs = spark.createDataFrame([(1, body), (2, body), (3, body + "\nand one line more that others do not have"), (4, "something else altogether in this one")], "doc_id long, text string")
    assert {r.doc_id: r.text for r in line_templates.without_templates(docs).collect()} == {r.doc_id: r.text for r in docs.collect()}


def test_a_long_line_with_a_changed_word(spark):
    passage = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    lines = [" ".join([*passage[:150], f"name{chr(97 + i)}", *passage[150:]]) for i in range(6)]
    docs = spark.createDataFrame([(i, f"own line {'abcdef'[i]} of this document only\n{line}") for i, line in enumerate(lines)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in line_templates.without_templates(docs).collect()}
    assert lines[0] in got[0] and not any(lines[i] in got[i] for i in range(1, 6))


def test_a_document_of_several_others_lines(spark):
    """Three fourths of its words are passages, each of another document: it is a copy of none of them."""
    passages = [" ".join(f"{name}{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(30)) for name in ("red", "blue", "green")]
    own = [" ".join(f"{name}{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(30)) for name in ("one", "two", "three", "four")]
    rows = [(i, f"{own[i]}\n{passages[i]}") for i in range(3)] + [(9, "\n".join([own[3], *passages]))]
    got = {r.doc_id: r.text for r in line_templates.without_templates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {**dict(rows[:3]), 9: own[3]}


def test_two_families_in_one_leaf(spark):
    """Same length and same leading words: each family loses all lines but its first."""
    hosts = [f"host{chr(97 + i)}" for i in range(20)]
    lines = [f"connection to host {h} was refused by its peer today" for h in hosts] + [f"connection to host {h} has been opened once again today" for h in hosts]
    lines = [x for i in range(20) for x in (lines[i], lines[20 + i])]
    docs = spark.createDataFrame([(i, f"own words of document {chr(97 + i % 26) * (i // 26 + 1)} and no other\n{x}") for i, x in enumerate(lines)], "doc_id long, text string")
    kept = [r.doc_id for r in line_templates.without_templates(docs).collect() if "connection" in r.text]
    assert sorted(kept) == [0, 1]


def test_mostly_boilerplate(spark):
    """Three recurring lines are most of each document, and they go: the documents are no near copies."""
    own = [" ".join(f"{'abcdefgh'[i]}{chr(97 + j)}" for j in range(12)) for i in range(8)]
    shared = ["All the news that was fit to print this week", "Read more about our offers and our partners here", "Terms of use and privacy are told on another page"]
    docs = spark.createDataFrame([(i, "\n".join([own[i], *shared])) for i in range(8)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in line_templates.without_templates(docs).collect()}
    assert got == {0: "\n".join([own[0], *shared])} | {i: own[i] for i in range(1, 8)}


def test_lines_without_spaces(spark):
    said = lambda first, n: "".join(chr(0x4E00 + (first * 37 + 11 * i) % 2000) for i in range(n))
    passage = said(3, 60)
    docs = spark.createDataFrame([(i, f"{said(100 + i, 40)}\n{passage}\n{passage[:30]}{chr(0x5B57 + i)}{passage[31:]}x") for i in range(4)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in line_templates.without_templates(docs).collect()}
    assert passage in got[0] and all(got[i] == said(100 + i, 40) for i in range(1, 4))


def test_short_lines(spark):
    docs = spark.createDataFrame([(i, f"own words of document {chr(97 + i)} are here\nShare this\n***\n{i}\nrarely {'x' if i < 5 else chr(97 + i)}") for i in range(24)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in line_templates.without_templates(docs).collect()}
    assert "Share this" in got[0] and not any("Share this" in got[i] for i in range(1, 24))
    assert all(f"***\n{i}\nrarely" in got[i] for i in got)


def slow_lines(rows):
    """Line dedup as its docstring says it, in plain loops over (doc_id, text)."""
    lt, copy_of = line_templates, lambda t: simhash._signed(xxhash.xxh64_intdigest(t.encode(), 42))
    texts, by_text = {}, {}
    for d, t in rows:
        texts.setdefault(t, d)
        texts[t] = min(texts[t], d)
    said = {t: list(dict.fromkeys(tuple(x) for x in lt._lines(t))) for t in texts}
    holders = {}
    for t, lines in said.items():
        for x in lines:
            holders.setdefault(x, set()).add(t)
    general = {}

    def group(lines, depth):
        for x in lines:
            same = [[y[i] == x[i] for y in lines] for i in range(len(x))]
            for level in lt.LEVELS:
                often = [sum(s) >= max(2, level * len(lines)) for s in same]
                if sum(often) >= lt.ALIKE * len(x):
                    general[x] = (depth, lines[0][:depth], tuple(w if o else None for w, o in zip(x, often, strict=True)))
                    break
        if len(lines) > lt.LEAF_LINES and len(lines[0]) > depth:
            deeper = {}
            for x in lines:
                if x not in general:
                    deeper.setdefault(x[: 2 * depth], []).append(x)
            for some in deeper.values():
                if len(some) > 1:
                    group(some, 2 * depth)

    leaves = {}
    for x in holders:
        if len(x) > lt.DEPTH + 1:
            leaves.setdefault((len(x), x[: lt.DEPTH]), []).append(x)
    for lines in leaves.values():
        if len(lines) > 1 and len(set().union(*(holders[x] for x in lines))) > 1:
            group(lines, lt.DEPTH)
    of_general = {}
    for x, g in general.items():
        of_general.setdefault(g, set()).update(holders[x])

    def first(docs, n, least):
        least = lt.MIN_DOCS_SHORT if n < lt.SHORT_TOKENS else lt.MIN_DOCS_LONG if n >= lt.LONG_TOKENS else least
        return min(docs, key=lambda t: (texts[t], copy_of(t))) if len(docs) >= least else None

    keeper = {}
    for x, docs in holders.items():
        kept = first(of_general[general[x]], len(x), lt.MIN_DOCS_GENERAL) if x in general else None
        keeper[x] = kept if kept is not None else first(docs, len(x), lt.MIN_DOCS)
    out = {}
    for t in texts:
        gone = {x: keeper[x] for x in said[t] if keeper[x] not in (None, t)}
        by_keeper = Counter()
        for x, k in gone.items():
            by_keeper[k] += len(x)
        if len(gone) >= lt.COPY_LINES and sum(map(len, gone)) >= lt.COPY_SHARE * sum(map(len, said[t])):
            most = max(by_keeper, key=lambda k: (by_keeper[k], copy_of(k)))
            a, b = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (x.lower().split() for x in (t, most)))
            if len(a & b) / len(a | b) >= lt.COPY_SIMILARITY:
                gone = {}
        out[t] = "\n".join(line for line in t.split("\n") if tuple(lt.masked(line)) not in gone)
    return {d: out[t] for d, t in rows}


def test_lines_against_plain_loops(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(r.doc_id, r.text) for r in table(spark, MIDDLE, "documents").limit(400).collect()]
    words = [f"w{chr(97 + i)}" for i in range(12)]
    families = [[str(x) for x in rng.choice(words, 9)] for _ in range(6)]
    for i in range(300):  # a leaf with over LEAF_LINES lines, and families in it
        own = " ".join(f"u{chr(97 + int(x))}{chr(97 + int(y))}" for x, y in rng.integers(0, 26, (10, 2)))
        family = families[int(rng.integers(6))]
        line = ["in", "the", "log", *[w if rng.random() > 0.12 else f"v{chr(97 + int(rng.integers(26)))}{chr(97 + i % 26)}" for w in family]]
        noise = ["in", "the", "log", *[f"n{chr(97 + int(x))}{chr(97 + int(y))}" for x, y in rng.integers(0, 26, (9, 2))]]
        rows.append((100_000 + i, "\n".join([own, " ".join(line), " ".join(noise), f"Share {'this' if i % 2 else 'it'}", f"seen {i} times by all who came"])))
    got = {r.doc_id: r.text for r in line_templates.without_templates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = slow_lines(rows)
    assert got == want and sum(got[d] != t for d, t in rows) > 300


# Decontamination


def test_lcs():
    @given(st.lists(st.sampled_from("abcd"), max_size=14), st.lists(st.sampled_from("abcd"), max_size=14))
    @settings(deadline=None)
    def check(a, b):
        rows = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                rows[i + 1][j + 1] = rows[i][j] + 1 if x == y else max(rows[i][j + 1], rows[i + 1][j])
        assert decontaminate.lcs(a, b) == rows[-1][-1]

    check()


@given(st.lists(st.one_of(st.none(), st.text(alphabet=st.sampled_from("abB1_ .,\n\u65e5\u0451\u2014"), max_size=40)), max_size=6))
@settings(deadline=None)
def test_hashes_of_words_at_once(texts):
    """All words of a batch are hashed and counted in a few array operations, and are the words that words_of splits."""
    words = [decontaminate.words_of(t) for t in texts]
    _, hashes, lengths = decontaminate.hashed(texts)
    assert lengths.tolist() == list(map(len, words))
    hash_of = {w: int(decontaminate.hashes_of(w)[0][0]) for x in words for w in x}
    assert hashes.tolist() == [hash_of[w] for x in words for w in x] and len(set(hash_of.values())) == len(hash_of)
    codes, counts = decontaminate.in_documents(hashes, lengths[lengths > 0]) if len(hashes) else (hashes, lengths[:0])
    assert dict(zip(codes.tolist(), counts.tolist(), strict=True)) == {hash_of[w]: n for w, n in Counter(w for x in words for w in set(x)).items()}
    places = decontaminate.Coder(sorted(hash_of)[::2])
    assert places.own(hashes).tolist() == [sorted(hash_of)[::2].index(w) if w in sorted(hash_of)[::2] else places.size for x in words for w in x]


def test_hashes_of_long_lines():
    words = [str(i).encode() for i in range(30_000)] + [b"x" * 200_000, b"y", b"17"]
    hashes, starts = decontaminate.hashes_of(b" ".join(words))
    assert len(set(hashes.tolist())) == len(words) - 1 and hashes[-1] == hashes[17]
    assert starts.tolist() == np.cumsum([0, *(len(w) + 1 for w in words[:-1])]).tolist()


def test_recall_against_brute_force(spark):
    docs, items = table(spark, MIDDLE, "documents"), table(spark, MIDDLE, "benchmark")
    texts = {r.doc_id: decontaminate.words_of(r.text) for r in docs.collect()}
    truth = set()
    for r in items.collect():
        w = decontaminate.words_of(r.text)
        truth |= {(d, r.item_id) for d, t in texts.items() if b" ".join(w) in b" ".join(t)}
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, items).collect()}
    assert len(truth & got) >= 0.9 * len(truth) and len(got - truth) <= 0.1 * len(truth) + 2


def test_paraphrase(spark):
    item = "The harvest festival of the northern valley begins when the first lanterns are lit beside the river. Its oldest song is called morning frost"
    told = "Everyone knows that the harvest festival in this northern valley starts when first lanterns get lit beside the old river. Its oldest song is called morning frost"
    other = "The old song of the river is about lanterns. " * 5
    docs = spark.createDataFrame([(1, "x y z. " * 30 + told + " q r s." * 30), (2, other), (3, "nothing of it " * 50)], "doc_id long, text string")
    docs = docs.union(table(spark, "/root/testdata/sf0.001", "documents").select(F.col("doc_id") + 1000, "text"))
    items = spark.createDataFrame([(7, item)], "item_id long, text string")
    got = decontaminate.contaminated(docs, items).collect()
    assert [(r.doc_id, r.item_id, r.answer) for r in got] == [(1, 7, True)] and got[0].share < 0.9


def test_a_passage_that_keeps_only_the_common_words(spark):
    """Two thirds of the item's words in order, with its answer, but a quarter of its TF-IDF weight."""
    rng = np.random.default_rng(5)
    common, rare, filler = [f"mid{i}" for i in range(16)], [f"rare{i}" for i in range(8)], [f"f{i}" for i in range(10)]
    item = [w for i in range(8) for w in (common[i], rare[i])] + common[8:]
    told = [filler[i % 10] if w in rare else w for i, w in enumerate(item)]
    held = [set(rng.choice(200, 20, replace=False).tolist()) for _ in common]
    rows = [(i, " ".join(filler * 3 + [w for w, at in zip(common, held, strict=True) if i in at] + filler * 3)) for i in range(200)]
    rows.append((900, " ".join(filler * 4 + told + filler * 4)))
    items = spark.createDataFrame([(7, " ".join(item[:16]) + ". " + " ".join(item[16:]))], "item_id long, text string")
    got = decontaminate.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), items).collect()
    assert [(r.doc_id, r.item_id, r.answer) for r in got] == [(900, 7, True)] and abs(got[0].share - 2 / 3) < 1e-9


def slow_found(item, text):
    """Whether an item's words are found, by the longest common subsequence from every place of a text."""
    own, words = decontaminate.words_of(item), decontaminate.words_of(text)
    held = decontaminate.Items([(0, item)])
    if len(own) < decontaminate.PHRASE_WORDS:
        return bool(own) and any(words[i : i + len(own)] == own for i in range(len(words)))
    reach = len(own) + max(2, len(own) // 4)
    for i in range(len(words)):
        there = words[i : i + reach]
        share = decontaminate.lcs(own, there) / len(own)
        if share >= decontaminate.SURE or share >= decontaminate.LIKELY and decontaminate.lcs(held.answers[0], there) >= decontaminate.ANSWER * len(held.answers[0]):
            return True
    return False


def test_recall_of_planted_items_in_four_scripts(spark):
    """Verbatim, with a quarter of the words replaced, and short; against a search of every item at every place."""
    rng = np.random.default_rng(12)
    letters = {"latin": (97, 26, 6, " ", ". "), "cyrillic": (0x430, 32, 6, " ", ". "), "arabic": (0x627, 20, 5, " ", ". "), "han": (0x4E00, 900, 1, "", "\u3002")}
    items, docs, planted = [], [], {}
    for script, (base, n_letters, size, space, stop) in letters.items():
        spelled = lambda: "".join(chr(base + int(x)) for x in rng.integers(0, n_letters, size))
        pool = [spelled() for _ in range(400)]
        some = lambda n: [pool[int(x)] for x in (rng.pareto(0.6, n) * 8).astype(int) % len(pool)]
        for kind, n in (("verbatim", 24), ("replaced", 30), ("short", 4)):
            for _ in range(20):
                words = [spelled() for _ in range(n)] if kind == "short" else some(n)
                item_id, answer = len(items), words[-5:] if n > 5 else []
                items.append((item_id, space.join(words[: n - 5]) + stop + space.join(answer) if answer else space.join(words)))
                told = [w if kind != "replaced" or i >= n - 5 or rng.random() > 0.25 else spelled() for i, w in enumerate(words)]
                docs.append((item_id, space.join([*some(150), *told, *some(80)])))
                planted[item_id, item_id] = (script, kind)
            docs += [(10_000 + len(docs) + i, space.join(some(200))) for i in range(5)]
    truth = {(d, i) for d, t in docs for i, x in items if slow_found(x, t)}
    assert set(planted) <= truth
    found = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = {(r.doc_id, r.item_id) for r in found.collect()}
    assert got <= truth and len(got) >= 0.9 * len(truth)
    n, hit = Counter(planted.values()), Counter(planted[x] for x in got if x in planted)
    assert all(hit[k] >= 0.9 * n[k] for k in n), (n, hit)


def test_short_items_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 6)
    rows = [(1, "They said the Capital of France: Paris, of course."), (2, "the capital of France and Paris"), (3, "\u5317\u4eac\u662f\u4e2d\u56fd\u7684\u9996\u90fd\u3002"), (4, "yes it is so"), (None, "capital of france paris"), (5, None), (6, "one two three four five six seven eight nine")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(1, "capital of France Paris"), (2, "\u4e2d\u56fd\u7684\u9996\u90fd"), (3, "Yes."), (4, ""), (5, "one two three four five six seven eight nine"), (None, "said the capital")], "item_id long, text string")
    got = decontaminate.contaminated(docs, items).collect()
    assert sorted((r.doc_id or 0, r.item_id or 0, r.first_word, r.last_word) for r in got) == [(0, 1, 0, 3), (1, 0, 1, 3), (1, 1, 3, 6), (3, 2, 3, 7), (4, 3, 0, 0), (6, 5, 0, 8)]
    kept = {r.doc_id for r in decontaminate.without_benchmark(docs, items).collect()}
    assert kept == {2, 4, 5}


def test_latent_space_is_fitted_on_all_documents(spark):
    """Against A'(A omega) by plain sums over every passage of 2,300 documents: long ones, short ones and one without a word."""
    rng = np.random.default_rng(8)
    topics = [[f"t{k}w{i}" for i in range(12)] for k in range(40)]
    texts = [" ".join(rng.choice(topics[int(rng.integers(40))], int(n))) for n in rng.integers(3, 90, 2300)] + ["", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    items = spark.createDataFrame([(k, " ".join(topics[k][:9]) + ". " + topics[k][11]) for k in range(3)], "item_id long, text string")
    (held,) = decontaminate.prepared(docs, items)
    block, idf, got = held.value.parts
    size, n_rows, coder = len(block.vocabulary), len(got), decontaminate.Coder(block.vocabulary)
    passages = []
    for t in texts:
        codes = coder.codes(decontaminate.words_of(t))
        n = -(-len(codes) // 8)
        passages += [codes[8 * i : 8 * i + 32] for i in range(max(1, n - 3)) if n]
    used = np.unique(decontaminate.rows_of(np.concatenate(passages), size))
    a = np.zeros((len(passages), len(used)))
    for i, codes in enumerate(passages):
        np.add.at(a[i], np.searchsorted(used, decontaminate.rows_of(codes, size)), idf[codes])
        a[i] /= np.sqrt((idf[codes].astype(float) ** 2).sum())
    b = np.zeros((len(block.queries), n_rows))
    for i, (_, words, _) in enumerate(block.queries):
        codes = coder.codes(words)
        np.add.at(b[i], codes, idf[codes] / np.sqrt((idf[codes].astype(float) ** 2).sum()))
    q = np.random.default_rng(17).normal(size=got.shape)
    for _ in range(2):
        total, own = np.zeros(q.shape), b.T @ (b @ q)
        total[used] = a.T @ (a @ q[used])
        q, _ = np.linalg.qr(total + max(1.0, np.linalg.norm(total) / np.linalg.norm(own)) * own)
    assert np.linalg.svd(got.T @ q, compute_uv=False).min() > 0.999



def test_the_pipeline_fits_on_every_word_of_every_document(spark, monkeypatch, tmp_path):
    """What the pipeline's stage gives the fit: 2,300 documents, more than any sample it once took."""
    import corpus_pipeline

    spark.createDataFrame([(1, "one two three four five six seven. eight nine")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(i, "alpha beta " * (i % 9)) for i in range(2300)], "doc_id long, text string")
    fit, got = decontaminate.latent_basis, []
    monkeypatch.setattr(decontaminate, "latent_basis", lambda words, *a: got.extend(words.collect()) or fit(words, *a))
    assert dict(corpus_pipeline.STAGES)["decontamination"](spark, docs, str(tmp_path)).count() == 2300
    lengths = [n for r in got for n in np.frombuffer(r.lengths, np.int32).tolist()]
    assert sorted(lengths) == sorted(2 * (i % 9) for i in range(2300) if i % 9)
    assert sum(len(r.hashes) for r in got) == 4 * sum(lengths)


def test_tasks_of_the_fit_do_not_follow_partitions(spark, monkeypatch):
    """Each task of a pass sends a whole matrix; every word counts, however the words are dealt."""
    rng = np.random.default_rng(6)
    docs = spark.createDataFrame([(i, " ".join(f"w{k}" for k in rng.integers(0, 400, 30))) for i in range(600)], "doc_id long, text string").repartition(60)
    items = spark.createDataFrame([(1, "one alpha w3 w5 five six seven. eight nine")], "item_id long, text string")
    kind, seen = type(docs), []
    deal = kind.repartition
    monkeypatch.setattr(kind, "repartition", lambda self, *a: seen.append(self.rdd.getNumPartitions()) or deal(self, *a))
    spark.conf.set("spark.sql.files.openCostInBytes", "1g")  # a task for each file
    try:
        (held,) = decontaminate.prepared(docs, items)
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len(seen) == 2 and max(seen) <= 2 * spark.sparkContext.defaultParallelism
    (one,) = decontaminate.prepared(docs.coalesce(1), items)
    assert np.linalg.svd(held.value.parts[2].T @ one.value.parts[2], compute_uv=False).min() > 0.999


def test_stages_leave_only_tables_that_their_results_read(spark, tmp_path):
    import corpus_pipeline
    from quarry.llm import _common

    spark.createDataFrame([(1, "one two three four five six seven. eight nine")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    texts = [f"a{i % 30} b{i % 30} c{i % 30} d{i % 30} e{i % 30}" for i in range(90)] + ["say one two three four five six seven. eight nine now"]
    docs, stages = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), dict(corpus_pipeline.STAGES)
    made = _common._made(spark)
    before = len(made)
    out = stages["near_dedup"](spark, docs, str(tmp_path))
    assert [re.search("quarry-(.*)-", p)[1] for p in made[before:]] == ["gone", "again"]
    assert sorted(r.doc_id for r in out.collect()) == [*range(30), 90]
    before = len(made)
    out = stages["decontamination"](spark, out, str(tmp_path))
    assert not made[before:]
    assert sorted(r.doc_id for r in out.collect()) == list(range(30))



# Packing


def slow_pack(rows, capacity):
    """Best fit by looking at every bin."""
    pieces = sorted(((min(capacity, n - f), d is not None, d or 0, f // capacity, c, s, d, f) for d, s, c, n in rows for f in range(0, n, capacity)), key=lambda p: (-p[0], p[1], p[2], p[3], p[4], p[5] or ""))
    bins, out = [], []
    for n, _, _, piece, cluster, source, d, first in pieces:
        fit = [(free, i) for i, (free, sources, clusters) in enumerate(bins) if free >= n and source not in sources and cluster not in clusters]
        if not fit:
            bins.append([capacity, set(), set()])
            fit = [(capacity, len(bins) - 1)]
        free, i = min(fit)
        out.append((i, d, source, piece, first, n, capacity - free))
        bins[i][0] -= n
        bins[i][1].add(source)
        bins[i][2].add(cluster)
    return out


@given(st.lists(st.tuples(st.integers(0, 30), st.sampled_from(["a", "b", "c", "d"]), st.integers(0, 8), st.integers(1, 25)), max_size=40))
@settings(deadline=None)
def test_best_fit(rows):
    assert packing.pack(rows, 10) == slow_pack(rows, 10)


def test_packed_sequences(spark, data):
    docs = table(spark, data, "documents")
    got = packing.packed(docs, capacity=512).collect()
    fill, sources = Counter(), Counter()
    for r in got:
        fill[r.shard, r.bin] += r.n
        sources[r.shard, r.bin, r.source] += 1
    assert max(fill.values()) <= 512 and max(sources.values()) == 1
    sizes = Counter()
    for r in got:
        sizes[r.doc_id] += r.n
    assert sizes == {r.doc_id: len((r.text or "").split()) + 1 for r in docs.collect()}


def slow_pack_limited(rows, capacity, of_source, of_cluster):
    pieces = sorted(((min(capacity, n - f), d is not None, d or 0, f // capacity, c is not None, c or 0, s, d, f, c) for d, s, c, n in rows for f in range(0, n, capacity)), key=lambda p: (-p[0], *p[1:6], p[6] or ""))
    bins, out = [], []
    for n, _, _, piece, _, _, source, d, first, cluster in pieces:
        fit = [(free, i) for i, (free, sources, clusters) in enumerate(bins) if free >= n and sources[source] < of_source.get(source, 1) and (cluster is None or clusters[cluster] < of_cluster.get(cluster, 1))]
        if not fit:
            bins.append([capacity, Counter(), Counter()])
            fit = [(capacity, len(bins) - 1)]
        free, i = min(fit)
        out.append((i, d, source, piece, first, n, capacity - free))
        bins[i][0] -= n
        bins[i][1][source] += 1
        bins[i][2][cluster] += 1
    return out


@given(
    st.lists(st.tuples(st.integers(0, 30), st.sampled_from(["a", "b", "c", "d"]), st.one_of(st.none(), st.integers(0, 4)), st.integers(1, 25)), max_size=40),
    st.dictionaries(st.sampled_from("abcd"), st.integers(1, 4)), st.dictionaries(st.integers(0, 4), st.integers(1, 3)),
)
@settings(deadline=None)
def test_best_fit_with_limits(rows, of_source, of_cluster):
    assert packing.pack(rows, 10, of_source, of_cluster) == slow_pack_limited(rows, 10, of_source, of_cluster)


def test_fill_with_one_large_source(spark):
    docs = table(spark, MIDDLE, "documents").withColumn("source", F.when(F.col("doc_id") % 10 != 0, "hot").otherwise(F.col("source")))
    got = packing.packed(docs).collect()
    used = {(r.shard, r.bin): r.fill for r in got}
    n = Counter((r.shard, r.bin, r.source) for r in got)
    assert sum(used.values()) / len(used) >= 0.9
    assert all(x == 1 for (_, _, source), x in n.items() if source != "hot")
    alone = packing.packed(docs, per_source=1, per_cluster=1, near=False).collect()
    assert max(Counter((r.shard, r.bin, r.source) for r in alone).values()) == 1


def test_repeated_rows_are_spread(spark):
    docs = spark.createDataFrame([(None, None, "s")] * 600 + [(1, "the same words", "s")] * 600, "doc_id long, text string, source string")
    got = packing.packed(docs, capacity=64, shard_docs=100).collect()
    assert len({r.shard for r in got}) == 12 and len(got) == 1200
    used = {(r.shard, r.bin): r.fill for r in got}
    assert sum(used.values()) / len(used) > 0.8


def test_near_duplicates_stand_in_different_sequences(spark):
    words = [f"w{i}" for i in range(4000)]
    rows = [(i, " ".join([*words[:-1], f"w{3999 + i % 2}"]), f"s{i}") for i in range(4)] + [(10 + i, f"a b c {i}", f"t{i}") for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    bits = simhash.near_duplicates(docs).filter("doc_id < 4").select("component_id").distinct().count()
    got = packing.packed(docs, capacity=20_000, per_source=1, per_cluster=1).collect()
    assert bits == 1 and len({r.bin for r in got if r.doc_id < 4}) == 4


def test_sequences_hold_the_words(spark, data):
    docs = table(spark, data, "documents").union(table(spark, data, "documents").limit(3)).union(spark.createDataFrame([(None, None, "en", "s", 0), (None, None, "en", "s", 0), (5, None, "en", "s", 0)], table(spark, data, "documents").schema))
    pieces = packing.packed(docs, capacity=512)
    got = packing.sequences(docs, pieces).collect()
    texts = Counter()
    for r in got:
        words = r.text.split(" ")
        assert r.n == len(words) <= 512 and abs(r.fill - r.n / 512) < 1e-9 and r.doc_ids == [p.doc_id for p in r.pieces]
        for p in r.pieces:
            texts[p.doc_id, p.first, " ".join(words[p.offset : p.offset + p.n])] += 1
    want = Counter()
    for r in docs.collect():
        words = [*(r.text or "").split(), packing.END]
        want.update((r.doc_id, f, " ".join(words[f : f + 512])) for f in range(0, len(words), 512))
    assert texts == want


# Classifiers


def accuracy(df, labels, column):
    got = df.join(labels.withColumnRenamed(column, "truth"), "doc_id").filter("held_out").select("predicted", "truth").collect()
    return sum(r.predicted == r.truth for r in got) / len(got)


def test_toxicity_on_held_out_labels(spark):
    docs, labels = table(spark, "/root/testdata/sf0.1", "documents"), table(spark, "/root/testdata/sf0.1", "labels")
    model = toxicity.fit(docs, labels)
    assert accuracy(toxicity.score(docs, model), labels, "toxic") > 0.95
    found = toxicity.offending(docs.limit(2000), model).collect()
    assert found and all(0.5 <= r.score <= 1 for r in found)


def test_noisy_or_learns_instances_from_bags():
    rng = np.random.default_rng(2)
    bags = [[sorted({int(x) for x in rng.integers(1, 20, 3)}) for _ in range(rng.integers(1, 8))] for _ in range(400)]
    y = rng.random(400) < 0.3
    for bag, toxic in zip(bags, y, strict=True):
        if toxic:
            bag[0] = sorted({0, *bag[0]})
    model = toxicity.train(bags, y.astype(float), np.zeros(20))
    assert model["weights"][0] > 3 + max(model["weights"][1:])


def test_toxicity_in_a_script_without_spaces(spark):
    rng = np.random.default_rng(6)
    said = lambda n: "".join(chr(0x4E00 + int(x)) for x in rng.integers(0, 300, n))
    rows, labels = [], []
    for i in range(400):
        toxic = int(rng.random() < 0.3)
        sentences = [said(12) for _ in range(6)]
        if toxic:
            sentences[2] = said(5) + chr(0x6BD2) + chr(0x836F) + said(5)
        rows.append((i, chr(0x3002).join(sentences) + chr(0x3002)))
        labels.append((i, toxic))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(docs, known)
    assert accuracy(toxicity.score(docs, model), known, "toxic") > 0.9
    worst = [r for r in toxicity.score(docs, model).collect() if r.predicted]
    assert worst and all(rows[r.doc_id][1][r.worst_start : r.worst_end].count(chr(0x6BD2) + chr(0x836F)) == 1 for r in worst if labels[r.doc_id][1])


def test_quality_on_held_out_labels(spark):
    docs, labels = table(spark, MIDDLE, "documents"), table(spark, MIDDLE, "labels")
    assert accuracy(quality_rff.scored(docs, labels), labels, "quality") > 0.95


def test_isotonic():
    rates = quality_rff.isotonic(np.array([0.0, 3, 1, 0, 9]), np.array([5.0, 5, 5, 0, 10]))
    assert all(a <= b + 1e-12 for a, b in zip(rates, rates[1:], strict=False)) and rates[1] == pytest.approx(rates[2])
    assert 0 < rates[0] < 0.1 and rates[1] == pytest.approx((4 + 4 * 13.5 / 26 / 4) / (10 + 1)) and 0.85 < rates[4] < 0.9
    assert 0 < quality_rff.isotonic(np.array([0.0, 0]), np.array([3.0, 1])).max() < 0.2


@given(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 9)), min_size=1, max_size=12).filter(lambda x: any(a + b for a, b in x)))
@settings(deadline=None)
def test_isotonic_against_every_mean(rows):
    """The rate of a bin is the largest least mean: max over starts up to it, min over ends from it."""
    hits, misses = (np.array(x, float) for x in zip(*rows, strict=True))
    totals = hits + misses
    used = [i for i in range(len(rows)) if totals[i]]
    more, share = 2 / len(used), (hits.sum() + 0.5) / (totals.sum() + 1)
    mean = lambda a, z: sum(hits[i] + more * share for i in used[a : z + 1]) / sum(totals[i] + more for i in used[a : z + 1])
    rates = quality_rff.isotonic(hits, totals)
    for k, i in enumerate(used):
        assert rates[i] == pytest.approx(max(min(mean(a, z) for z in range(k, len(used))) for a in range(k + 1)))


def test_waves_approximate_a_gaussian_kernel():
    z = np.random.default_rng(5).normal(size=(40, 12))
    f = quality_rff.waves(z, 4096)[:, :-1]
    near = np.exp(-((z[:, None] - z[None]) ** 2).sum(2) / (2 * 12))
    assert np.abs(f @ f.T - near).max() < 0.1


def slow_toxicity(text, model):
    """The noisy-or over sentences, sentence by sentence."""
    weights, clean = dict(zip(model["vocabulary"], model["weights"], strict=True)), np.exp(-model["leak"])
    for m in toxicity.SENTENCE.finditer(text or ""):
        found = {f for w in toxicity.words_of(m.group()) for f in toxicity.word_features(w)} & weights.keys()
        if found:
            clean *= 1 - 1 / (1 + np.exp(-(model["bias"] + sum(weights[f] for f in found))))
    return 1 - clean


def test_toxicity_scores_by_hand(spark):
    docs, labels = table(spark, MIDDLE, "documents"), table(spark, MIDDLE, "labels")
    model = toxicity.fit(docs, labels)
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(texts) and len(model["vocabulary"]) > 10
    assert all(r.score == pytest.approx(slow_toxicity(texts[r.doc_id], model), abs=1e-9) for r in got)


def crc(text):
    return zlib.crc32(text.encode())


def test_quality_scores_by_hand(spark):
    """The classifier again, with whole matrices in place of sums by partition."""
    docs, labels = table(spark, MIDDLE, "documents"), table(spark, MIDDLE, "labels")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    known = {r.doc_id: r.quality for r in labels.collect() if r.quality is not None and crc(str(r.doc_id)) % 3 != 1}
    stats = np.array([quality_rff.statistics(t) for _, t in rows])
    spread = stats.std(axis=0)
    z = np.clip((stats - stats.mean(axis=0)) / np.where(spread > 0, spread, 1), -4, 4)
    f = quality_rff.waves(z)
    at = [i for i, (d, _) in enumerate(rows) if d in known]
    y, half = np.array([known[rows[i][0]] for i in at], float), np.array([crc(f"{rows[i][0]}half") % 2 for i in at])
    k = f.shape[1]

    def solved(some):
        x = f[np.array(at)[some]]
        return np.linalg.solve(x.T @ x + quality_rff.RIDGE * (len(x) + 1) * np.eye(k), x.T @ y[some])

    crossed = np.where(half == 0, f[at] @ solved(half == 1), f[at] @ solved(half == 0))
    place = quality_rff.binned(crossed)
    rates = quality_rff.isotonic(np.bincount(place, y, quality_rff.BINS), np.bincount(place, minlength=quality_rff.BINS).astype(float))
    want = dict(zip((d for d, _ in rows), rates[quality_rff.binned(f @ solved(np.full(len(at), True)))], strict=True))
    got = {r.doc_id: r.score for r in quality_rff.scored(docs, labels).collect()}
    assert got.keys() == want.keys() and sum(abs(got[d] - want[d]) > 1e-6 for d in got) <= 2  # a sum's rounding may change a bin


def slow_estimate(votes, strength=0.05, rounds=100):
    """Expectation-maximisation over single documents, rule by rule."""
    n, n_rules, belief = len(votes), len(votes[0]), ({-1: 0.35, 0: 0.15, 1: 0.5}, {-1: 0.01, 0: 0.09, 1: 0.9})
    good = [0.2 if -1 in v else 0.95 for v in votes]
    for _ in range(rounds):
        pull = strength * (n + 1)
        prior = (sum(good) + 0.9 * pull) / (n + pull)
        shares = [[{} for _ in range(n_rules)] for _ in (0, 1)]
        for side in (0, 1):
            held = [g if side else 1 - g for g in good]
            for r in range(n_rules):
                raw = {v: sum(h for h, x in zip(held, votes, strict=True) if x[r] == v) + pull * belief[side][v] for v in (-1, 0, 1)}
                shares[side][r] = {v: x / sum(raw.values()) for v, x in raw.items()}
        for r in range(n_rules):
            shares[1][r][-1], shares[1][r][1] = min(shares[1][r][-1], shares[0][r][-1]), max(shares[1][r][1], shares[0][r][1])
        new = []
        for v in votes:
            odds = prior / (1 - prior) * np.prod([shares[1][r][x] / shares[0][r][x] for r, x in enumerate(v)])
            new.append(odds / (1 + odds))
        if max(abs(a - b) for a, b in zip(new, good, strict=True)) < 1e-9:
            break
        good = new
    return new


@given(st.lists(st.tuples(*[st.sampled_from([-1, 0, 1])] * 4), min_size=1, max_size=25))
@settings(deadline=None, max_examples=40)
def test_estimate_against_single_documents(rows):
    patterns, n = np.unique(np.array(rows), axis=0, return_counts=True)
    model = quality_votes.estimate(patterns, n.astype(float))
    assert np.allclose(quality_votes.posterior(np.array(rows), model), slow_estimate(rows), atol=1e-6)


def test_votes_by_hand(spark):
    docs = table(spark, MIDDLE, "documents").limit(300)
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = [(d, dict(zip(quality_votes.COUNTS, quality_votes.counts(t), strict=True))) for d, t in texts.items()]
    said = {d: tuple(1 if (x := measure(c)) <= good else -1 if x >= bad else 0 for measure, good, bad in quality_votes.RULES.values()) for d, c in rows if c["n_words"]}
    want = dict(zip(said, slow_estimate([*said.values()]), strict=True))
    for r in quality_votes.judged(docs).collect():
        assert r.quality == pytest.approx(want.get(r.doc_id, 0.0), abs=1e-6)
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and r.kept == (not r.base_failed and want[r.doc_id] >= 0.5)


# The pipeline


def test_stages_take_effect(spark, data):
    import corpus_pipeline

    docs = table(spark, data, "documents")
    planted = "zig zag passage " * 20
    item = table(spark, data, "benchmark").filter(F.length("text") > 150).first().text
    extra = [(10**6 + i, f"unique beginning {'abcdefgh'[i]} goes here with words of its own kind {'abcdefgh'[i]}\n{planted.strip()}", "en", "src0", 1) for i in range(5)]
    extra += [(10**6 + 10, docs.first().text, "en", "src1", 1), (10**6 + 20, "lead in words come before it all. " * 9 + item, "en", "src2", 1)]
    at = spark.createDataFrame(extra, docs.schema).union(docs)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, at = at, stage(spark, at, data)
        assert at.columns == docs.columns, name
        if name == "line_dedup":
            held = {r.doc_id: r.text for r in at.filter("doc_id between 1000000 and 1000004").collect()}
            assert sum(planted.strip() in t for t in held.values()) == 1
        if name == "near_dedup":
            assert at.count() < before.count() and at.filter(f"doc_id = {10**6 + 10}").count() == 0
        if name == "decontamination":
            assert at.filter(f"doc_id = {10**6 + 20}").count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, at, data)
    said = Counter()
    for r in packed.collect():
        words = r.text.split(" ")
        assert len(words) == r.n <= packing.CAPACITY
        said.update((p.doc_id, p.first, " ".join(words[p.offset : p.offset + p.n])) for p in r.pieces)
    want = Counter()
    for r in at.select("doc_id", "text").collect():
        words = [*(r.text or "").split(), packing.END]
        want.update((r.doc_id, f, " ".join(words[f : f + packing.CAPACITY])) for f in range(0, len(words), packing.CAPACITY))
    assert said == want


def slow_near_duplicates(rows):
    """doc_ids that stay: groups by fingerprints at two bits or fewer and by shingle similarity, over all pairs."""
    root = {d: d for d, _ in rows}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    fps = {d: slow_fingerprint(t) for d, t in rows}
    shingles = {}
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        shingles[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    for i, (a, _) in enumerate(rows):
        for b, _ in rows[i + 1 :]:
            common = len(shingles[a] & shingles[b])
            if (fps[a] ^ fps[b]).bit_count() <= 2 or common and common >= 0.8 * len(shingles[a] | shingles[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d for d, _ in rows if find(d) == d}


def test_near_duplicates_over_all_pairs(spark):
    rows = sorted((r.doc_id, r.text) for r in table(spark, MIDDLE, "documents").collect())
    kept = {r.doc_id for r in simhash.keep_one(table(spark, MIDDLE, "documents")).select("doc_id").collect()}
    want = slow_near_duplicates(rows)
    assert kept >= want and len(kept) <= 1.002 * len(want) and len(want) < len(rows)


def test_the_pipeline_by_hand(spark, data):
    """Each stage against its plain version, on what the stage before it kept."""
    import corpus_pipeline

    stages = dict(corpus_pipeline.STAGES)
    docs = table(spark, data, "documents").limit(150)
    model = toxicity.fit(docs, table(spark, data, "labels"))
    clean = stages["toxicity"](spark, docs, data)
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in docs.collect() if slow_toxicity(r.text, model) < 0.5}
    lines = stages["line_dedup"](spark, clean, data)
    assert {r.doc_id: r.text for r in lines.collect()} == slow_lines([(r.doc_id, r.text) for r in clean.collect()])
    single = stages["near_dedup"](spark, lines, data)
    assert {r.doc_id for r in single.collect()} == slow_near_duplicates(sorted((r.doc_id, r.text) for r in lines.collect()))
    items = [r.text for r in table(spark, data, "benchmark").collect()]
    free = stages["decontamination"](spark, single, data)
    found = {r.doc_id for r in single.collect() if any(slow_found(x, r.text) for x in items)}
    assert {r.doc_id for r in free.collect()} == {r.doc_id for r in single.collect()} - found
    packed = stages["packing"](spark, free, data).collect()
    used = Counter()
    for r in packed:
        for p in r.pieces:
            used[p.doc_id] += p.n
    assert used == {r.doc_id: len((r.text or "").split()) + 1 for r in free.collect()} and max(r.n for r in packed) <= packing.CAPACITY
