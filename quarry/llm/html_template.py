"""Main text of web pages by equivalence-class template deduction.

A page is a row of tokens: containers (paths of block elements with their classes) and words, each with the path that it
stands in and how many equal words of its block stand before it. Over all pages of a host each token has an occurrence
vector, its count on every page; the sum of hashes of (page, count) stands for the vector, so a host with any number of
pages costs a sum a token. Tokens with the same vector are an equivalence class. A class is valid if it holds on at least
``MIN_PAGES`` different pages and its words nest in a container of the class; valid classes nest in one another as their
containers do, and their words are the template. What is left are the slots:
  a block all of whose words are template is template; one at least half of whose words are, too, if other slots are left;
  in an article or main element a class must hold on ``MIN_PAGES_INSIDE`` pages to take a block, and where it would take
  half the words there the pages are copies of one another, and it takes none.
Slots in menus, headers, footers, sidebars, notices, adverts, forms and comments, as elements and class names tell, are no
main text. Of the others those in article and main elements (or like-named ones) are chosen if they have at least half of
the slots' words; else all that aren't mere links.

A word whose vector over some of a host's pages is that of no container around it can't share a class with one over all
of them. So every task keeps, of each host among its pages, the containers and the words for which that still holds (from a
host's second page on few). Those of ``FAN`` tasks each are merged, and what is left is summed token by token: no task ever
holds all of a host, and no page's text moves. The template is broadcast where it has at most ``BROADCAST_WORDS`` words;
where it has more, pages are joined with the part of it at their paths, and only pages for which there is one are shuffled.

Defined results: null or empty html gives empty text; a null url has the host ''; repeated pages are read alike, and count as
one page of those a class must hold on; an empty table gives an empty result; further columns are ignored; markup that
isn't closed ends with the page; a host with fewer than MIN_PAGES different pages has no template.
"""

from __future__ import annotations

import html as entities
import re
from bisect import insort
from collections import Counter
from typing import NamedTuple
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import bounded_batches, table, written

MIN_PAGES, MIN_PAGES_INSIDE, MAX_LINKS = 3, 10, 0.8
#: Different pages of a class that are told apart: no less than the numbers above ask for.
SUPPORT = 16
#: Tokens that a task holds before it gives them out, tasks merged at once, and words of a template that is broadcast.
HELD, FAN, BROADCAST_WORDS = 400_000, 256, 200_000
#: Bits in the filter of pages that hold words of a template; it only spares work.
FILTER_BITS = 1 << 24

# Elements by how they are treated; all others run within a line.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup html legend li "
    "listing main menu nav noframes ol optgroup option p plaintext pre search section summary table tbody td tfoot th thead tr ul xmp".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg select button canvas audio video annotation annotation-xml".split())
#: Elements within which an open paragraph outside isn't closed by a block.
SCOPES = frozenset("table td th caption object html".split())
#: Elements that an opening tag of the same group closes.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
NOISE_ELEMENTS = frozenset("nav footer aside head menu dialog search".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert".split())
NOISE_WORDS = frozenset(
    "ad ads adsbygoogle advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar menu nav navbar navigation breadcrumb breadcrumbs header footer "
    "comment comments disqus respond replies cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share "
    "sharing social related recommended widget masthead toolbar topbar topnav sidenav subnav pagination pager hidden search announcement copyright skip commentlist leaderboard skyscraper "
    "taboola outbrain addthis sharedaddy".split()
)
#: Words that may stand beside a noise word in a class name without telling of something else.
PLAIN_WORDS = frozenset(
    "area article articles bar block bottom box button buttons col component container content desktop first fixed footer form global group header inner item items last left link links list "
    "local main media mobile module outer page panel post posts primary reader region right row secondary section site slot small sticky stories story text thread title top unit user wrap wrapper zone".split()
)
ARTICLE_WORDS = frozenset("article content post entry story main".split())
BESIDE_ARTICLE = frozenset("body text inner wrapper area page single the full".split())
COMMENT_WORDS = frozenset("comment comments reply replies".split())

_TAG = re.compile(r"</?([a-zA-Z][^\s/>]*)((?:=\s*(?:\"[^\"]*\"|'[^']*')|[^>])*+)>")
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_SPACE = re.compile(r"\s+")
_NOT_SHOWN = re.compile(r"display\s*:\s*none")


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def _seeded(text: str, seed: int) -> int:
    """63 bits of a hash."""
    return xxhash.xxh64_intdigest(text.encode(), seed) >> 1


class Block(NamedTuple):
    path: int
    text: str
    inside: bool  # an article or main element, or a like-named one
    links: float  # the share of its characters in links
    noise: bool


class _Element:
    __slots__ = ("inside", "link", "name", "noise", "path", "suspects")

    def __init__(self, name, path, noise, inside, link, suspects):
        self.name, self.path, self.noise, self.inside, self.link, self.suspects = name, path, noise, inside, link, suspects


class _Suspect:
    """An element that may be noise: a form, or one whose class says so. It isn't if it holds what makes it the article."""

    __slots__ = ("form", "heads", "n_chars")

    def __init__(self, form: bool):
        self.form, self.heads, self.n_chars = form, False, 0

    def noise(self, total: int) -> bool:
        return not (self.heads or (self.form and 2 * self.n_chars >= total))


def _told(name: str, tokens: list[list[str]], inside: bool) -> bool:
    """Whether a class or id names noise: words for it, and no word for anything else."""
    if name in ("html", "body", "main"):
        return False
    if name == "article":
        return any(t and set(t) <= COMMENT_WORDS | {"user", "reader"} and not COMMENT_WORDS.isdisjoint(t) for t in tokens)
    if any(_names_article(t) for t in tokens):
        return False
    words = NOISE_WORDS - {"header"} if inside else NOISE_WORDS
    return any(not words.isdisjoint(t) and words.issuperset(set(t) - PLAIN_WORDS) for t in tokens)


def _names_article(words: list[str]) -> bool:
    return not ARTICLE_WORDS.isdisjoint(words) and ARTICLE_WORDS.issuperset(set(words) - BESIDE_ARTICLE)


class Page:
    """A page's blocks, and the paths of its containers with their counts and the paths they stand in."""

    def __init__(self, page: str | None, host: str = ""):
        self.found: list[tuple[int, str, bool, float, bool, tuple]] = []
        self.counts: Counter[int] = Counter()
        self.up: dict[int, int] = {}
        self._paths: dict[tuple[int, str, str], int] = {}
        self.root = _seeded(host, 1)
        self.total = 0
        self._read(page or "")
        self.blocks = [Block(p, t, i, s, n or any(x.noise(self.total) for x in some)) for p, t, i, s, n, some in self.found]

    def _opened(self, name: str, attributes: str, up: _Element) -> _Element:
        got = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)} if attributes.strip(" /") else {}
        said, role = f"{got.get('class', '')} {got.get('id', '')}", got.get("role", "").lower()
        tokens = [[w.lower() for w in _WORDS.findall(t)] for t in said.split()] if said != " " else []
        own = name in ("article", "main") or role in ("article", "main") or (name in BLOCK and name != "body" and any(_names_article(t) for t in tokens))
        inside = up.inside or own
        noise = (
            up.noise or name in NOISE_ELEMENTS or (role in NOISE_ROLES and name not in ("body", "main", "article", "form")) or "hidden" in got or got.get("aria-hidden") == "true"
            or (name == "header" and not up.inside) or ("style" in got and _NOT_SHOWN.search(got["style"]) is not None)
        )
        suspects = up.suspects
        if not noise:
            if name in ("form", "fieldset"):
                suspects = (*suspects, _Suspect(True))
            elif tokens and _told(name, tokens, up.inside):
                noise = name not in BLOCK or any("header" in t for t in tokens)
                suspects = suspects if noise else (*suspects, _Suspect(False))
        path = up.path
        if name in BLOCK:
            key = (up.path, name, " ".join(sorted({" ".join(t) for t in tokens})))
            path = self._paths.get(key)
            if path is None:
                path = self._paths[key] = _seeded(f"{name} {key[2]}", up.path)
                self.up[path] = up.path
            self.counts[path] += 1
        return _Element(name, path, noise, inside, up.link or name == "a", suspects)

    def _read(self, page: str) -> None:
        stack = [_Element("", self.root, False, False, False, ())]
        self.up[self.root], self.counts[self.root] = self.root, 1
        n_open: Counter[str] = Counter()
        parts: list[str] = []
        owner, linked, headed = stack[0], 0, False

        def flush():
            nonlocal linked
            if parts:
                text = _SPACE.sub(" ", "".join(parts)).strip()
                if text:
                    self.found.append((owner.path, text, owner.inside, min(1.0, linked / len(text)), owner.noise, owner.suspects))
                    self.total += len(text)
                    for s in owner.suspects:
                        s.n_chars += len(text)
                parts.clear()
            linked = 0

        def say(raw: str):
            nonlocal owner, linked
            top = stack[-1]
            if top.noise:
                return
            text = entities.unescape(raw) if "&" in raw else raw
            if not parts:
                owner = top
            parts.append(text)
            if top.link:
                linked += len(text.strip())

        def close():
            n_open[stack.pop().name] -= 1

        at, end = 0, len(page)
        while at < end:
            i = page.find("<", at)
            if i < 0:
                say(page[at:])
                break
            if i > at:
                say(page[at:i])
            at = i
            if page.startswith("<!--", i):
                j = page.find("-->", i + 4)
                at = end if j < 0 else j + 3
                continue
            follows = page[i + 1 : i + 2]
            if follows and follows in "!?":
                j = page.find(">", i)
                at = end if j < 0 else j + 1
                continue
            if not (follows.isascii() and follows.isalpha()) and not (follows == "/" and page[i + 2 : i + 3].isalpha()):
                say("<")
                at = i + 1
                continue
            m = _TAG.match(page, i)
            if m is None:  # the page ends inside a tag
                break
            at, name = m.end(), m[1].lower()
            if follows == "/":
                if name in BLOCK:
                    if n_open[name] > 0:
                        flush()
                        while stack[-1].name != name:
                            close()
                        close()
                    elif name == "p":
                        flush()
                elif n_open[name] > 0:
                    for k in range(len(stack) - 1, 0, -1):
                        if stack[k].name == name:
                            del stack[k]
                            n_open[name] -= 1
                            break
                        if stack[k].name in BLOCK:
                            break
                continue
            if name == "br":
                say(" ")
            elif name in RAW:
                if not m[2].rstrip().endswith("/"):
                    ends = re.compile(f"</{name}[^>]*>", re.IGNORECASE).search(page, at)
                    at = ends.end() if ends else end
            elif name == "hr":
                flush()
            elif name not in VOID:
                if name in BLOCK:
                    flush()
                    if n_open["p"] > 0:
                        k = len(stack) - 1
                        while stack[k].name != "p" and stack[k].name not in SCOPES and k > 0:
                            k -= 1
                        if stack[k].name == "p":
                            while len(stack) > k:
                                close()
                    if name in CLOSES:
                        while len(stack) > 1 and (stack[-1].name not in BLOCK or stack[-1].name in CLOSES[name]):
                            close()
                stack.append(self._opened(name, m[2], stack[-1]))
                n_open[name] += 1
                if name == "h1" and not headed and not stack[-1].noise:
                    headed = True
                    for s in stack[-1].suspects:
                        s.heads = True
        flush()

    def chain(self, path: int) -> list[int]:
        """A container and those around it, up to the page."""
        out = [path]
        while self.up[path] != path:
            path = self.up[path]
            out.append(path)
        return out

    def words(self) -> Counter:
        """Count of each word token (path, word, which one of its block) outside noise."""
        counts: Counter[tuple[int, str, int]] = Counter()
        for b in self.blocks:
            if not b.noise:
                counts.update(_numbered(b))
        return counts


def _numbered(block: Block):
    """The block's word tokens."""
    seen: dict[str, int] = {}
    for w in block.text.split():
        seen[w] = k = seen.get(w, 0) + 1
        yield block.path, w, k


def _token(path: int, word: str, k: int) -> int:
    return _seeded(word, path + k)


def blocks(page: str | None) -> list[tuple[int, str, bool, float]]:
    """(container path, text, whether in an article, share of its characters in links) of each text block outside noise."""
    return [b[:4] for b in Page(page).blocks if not b.noise]


def chosen(blocks: list[Block], fixed: dict[int, int], max_links: float = MAX_LINKS, min_pages_inside: int = MIN_PAGES_INSIDE, paths=None) -> list[Block]:
    """The main text's blocks; fixed has the template's word tokens, with the number of pages of their classes, and paths the
    paths that have any, if that is known."""
    live = [b for b in blocks if not b.noise]
    size = lambda some: sum(len(b.text) for b in some)
    slots, mixed = live, []
    if fixed:
        slots = []
        for b in live:
            found = [fixed.get(_token(*t), 0) >= (min_pages_inside if b.inside else 1) for t in _numbered(b)] if paths is None or b.path in paths else [False]
            if 2 * sum(found) < len(found):
                slots.append(b)
            elif not all(found):
                mixed.append(b)
        inside = [b for b in live if b.inside]
        if inside and 2 * size(b for b in slots if b.inside) < size(inside):
            own = set(map(id, inside)) | set(map(id, slots))
            slots = [b for b in live if id(b) in own]
        slots = slots or mixed or live
    inside = [b for b in slots if b.inside]
    if inside and 2 * size(inside) >= size(slots):
        return inside
    return [b for b in slots if b.links < max_links] or slots


HELD_KIND = (
    "host long, task long, paths array<long>, up array<int>, vectors array<long>, pages array<long>, some array<array<long>>, words array<long>, at array<int>, same array<int>"
)
_KINDS = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.list_(pa.int64())), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32())]
SPREAD = "host long, path long, token long, chain array<long>, vector long, pages long, some array<long>"
_SPREAD_KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.list_(pa.int64())]
_MASK = (1 << 62) - 1


def _mixed(page: int, n: int) -> int:
    return xxhash.xxh64_intdigest(n.to_bytes(8, "little") + page.to_bytes(8, "little"), 5) & _MASK


class Tokens:
    """Tokens of some pages of a host: of each the sum that stands for its vector, and its number of pages."""

    def __init__(self, host: int):
        self.host, self.n_words = host, 0
        self.containers: dict[int, list] = {}  # path: sum, pages, the path around it, the least hashes of different pages
        self.words: dict[int, dict[object, list]] = {}  # path: token: sum, pages

    def size(self) -> int:
        return self.n_words + len(self.containers)

    def chain(self, path: int) -> list[int]:
        out = [path]
        while (up := self.containers[path][2]) != path:
            out.append(path := up)
        return out

    def _count(self, path: int, token, vector: int, n: int, new: bool) -> None:
        """Count a word; one that comes first after all containers around it can't have their vectors, and isn't new."""
        held = self.words.get(path)
        got = held.get(token) if held else None
        if got is not None:
            got[0] = (got[0] + vector) & _MASK
            got[1] += n
        elif new:
            self.words.setdefault(path, {})[token] = [vector, n]
            self.n_words += 1

    def add(self, page: Page, key: int) -> None:
        """Count a page."""
        hashes = {n: _mixed(key, n) for n in set(page.counts.values())}
        fresh = set()
        for path, n in page.counts.items():
            got = self.containers.get(path)
            if got is None:
                fresh.add(path)
                self.containers[path] = [hashes[n], 1, page.up[path], [key]]
            else:
                got[0] = (got[0] + hashes[n]) & _MASK
                got[1] += 1
                _less(got[3], key)
        open_ = {path: [c for c in page.chain(path) if c in fresh] for path in page.counts} if fresh else {}
        counts: Counter = Counter()
        for b in page.blocks:
            if not b.noise and (b.path in self.words or open_.get(b.path)):
                counts.update(_numbered(b))
        for token, n in counts.items():
            self._count(token[0], token, hashes.get(n) or _mixed(key, n), 1, any(page.counts[c] == n for c in open_.get(token[0], ())))
        self._prune(page.counts)

    def merge(self, paths, up, vectors, pages, some, words, at, same) -> None:
        """Count what another of these holds."""
        fresh = set()
        for path, u, vector, n, keys in zip(paths, up, vectors, pages, some, strict=True):
            got = self.containers.get(path)
            if got is None:
                fresh.add(path)
                self.containers[path] = [vector, n, paths[u], list(keys)]
            else:
                got[0] = (got[0] + vector) & _MASK
                got[1] += n
                for key in keys:
                    _less(got[3], key)
        here = dict(zip(paths, zip(vectors, pages, strict=True), strict=True))
        for token, a, s in zip(words, at, same, strict=True):
            new = bool(fresh) and any(c in fresh and here[c] == (vectors[s], pages[s]) for c in self.chain(paths[a]))
            self._count(paths[a], token, vectors[s], pages[s], new)
        self._prune(paths)

    def _same(self, chain: list[int], word: list) -> int | None:
        """A container around a word with its vector."""
        return next((c for c in chain if self.containers[c][0] == word[0] and self.containers[c][1] == word[1]), None)

    def _prune(self, paths) -> None:
        """Words at some paths that have no container's vector any more go."""
        for path in paths:
            held = self.words.get(path)
            if held:
                chain = self.chain(path)
                for token in [t for t, w in held.items() if self._same(chain, w) is None]:
                    del held[token]
                    self.n_words -= 1
                if not held:
                    del self.words[path]

    def row(self, task: int) -> tuple:
        self._prune([*self.words])
        order = {path: i for i, path in enumerate(self.containers)}
        held = [*self.containers.values()]
        words = [(t if isinstance(t, int) else _token(*t), order[path], order[self._same(chain, w)]) for path, some in self.words.items() for chain in (self.chain(path),) for t, w in some.items()]
        return self.host, task, [*order], [order[c[2]] for c in held], [c[0] for c in held], [c[1] for c in held], [c[3] for c in held], [t for t, _, _ in words], [a for _, a, _ in words], [s for _, _, s in words]


def _less(keys: list[int], key: int) -> None:
    """Keep a list of the SUPPORT least different keys."""
    if key not in keys and (len(keys) < SUPPORT or key < keys[-1]):
        insort(keys, key)
        del keys[SUPPORT:]


def _table(rows: list[tuple], names: str, kinds: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows, strict=True)) or [[]] * len(kinds), kinds, strict=True)], re.findall(r"(\w+) (?:long|array)", names))


def page_tokens(pages: DataFrame) -> DataFrame:
    """Of each host in a task's pages the containers and the words that may share a class with one."""
    bounded_batches(pages.sparkSession)

    def run(batches):
        held: dict[int, Tokens] = {}
        task, n = TaskContext.get().partitionId(), 0

        def given():
            rows = [h.row(task) for h in held.values()]
            held.clear()
            for i in range(0, len(rows), 256):
                yield _table(rows[i : i + 256], HELD_KIND, _KINDS)

        for b in batches:
            for url, page in zip(*(c.to_pylist() for c in b.columns), strict=True):
                p = Page(page, host_of(url))
                tokens = held.setdefault(p.root, Tokens(p.root))
                n -= tokens.size()
                tokens.add(p, _seeded(page, 3))
                n += tokens.size()
                if n > HELD:
                    yield from given()
                    n = 0
        yield from given()

    return pages.select("url", "html").filter("html <> ''").mapInArrow(run, HELD_KIND)


def _merged(batches):
    """Tokens of a host and a number of tasks, in rows of at most about HELD of them."""
    at, held = None, None
    for b in batches:
        for host, task, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if (host, task) != at or held.size() > HELD:
                if held is not None:
                    yield _table([held.row(at[1])], HELD_KIND, _KINDS)
                at, held = (host, task), Tokens(host)
            held.merge(*row)
    if held is not None:
        yield _table([held.row(at[1])], HELD_KIND, _KINDS)


def _spread(batches):
    """A row for each token: a container's token is its path."""
    for b in batches:
        for host, _, paths, up, vectors, pages, some, words, at, same in zip(*(c.to_pylist() for c in b.columns), strict=True):
            chains = []
            for i in range(len(paths)):
                chain = [i]
                while up[chain[-1]] != chain[-1]:
                    chain.append(up[chain[-1]])
                chains.append([paths[c] for c in chain])
            rows = [(host, p, p, c, v, n, k) for p, c, v, n, k in zip(paths, chains, vectors, pages, some, strict=True)]
            rows += [(host, paths[a], t, chains[a], vectors[s], pages[s], []) for t, a, s in zip(words, at, same, strict=True)]
            for i in range(0, len(rows), 10_000):
                yield _table(rows[i : i + 10_000], SPREAD, _SPREAD_KINDS)


def template(pages: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """The valid classes of all hosts: host, vector, n_pages, support (different pages, counted up to SUPPORT), containers
    (paths), around (the nearest containers around them, of the classes it nests in) and words (path, token)."""
    rows = page_tokens(pages).withColumn("task", F.floor(F.col("task") / FAN).cast("long"))
    rows = rows.repartition("host", "task").sortWithinPartitions("host", "task").mapInArrow(lambda batches: _spread(_merged(batches)), SPREAD)
    # Vectors of 62 bits are summed in halves. A container has a few keys from each of the rows above.
    half = [F.sum(F.col("vector").bitwiseAND(F.lit((1 << 31) - 1))).alias("low"), F.sum(F.shiftright("vector", 31)).alias("high")]
    keys = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("some")))), 1, SUPPORT)
    summed = rows.groupBy("host", "path", "token").agg(*half, F.sum("pages").alias("n_pages"), F.first("chain").alias("chain"), F.size(keys).alias("support")).filter(F.col("n_pages") >= min_pages)
    # A class is on each of its pages, so it is no longer than one.
    own = F.col("token") == F.col("path")
    held = summed.groupBy("host", "low", "high", "n_pages").agg(
        F.collect_list(F.when(own, F.struct("path", "chain", "support"))).alias("own"), F.collect_list(F.when(~own, F.struct("path", "token", "chain"))).alias("words")
    )
    held = held.withColumn("containers", F.transform("own", lambda c: c["path"])).withColumn("support", F.coalesce(F.array_max(F.transform("own", lambda c: c["support"])), F.lit(0)).cast("long"))
    around = F.array_distinct(F.filter(F.transform("own", lambda c: F.get(F.array_except(c["chain"], F.col("containers")), F.lit(0))), lambda p: p.isNotNull()))
    nested = F.transform(F.filter("words", lambda w: F.arrays_overlap(w["chain"], F.col("containers"))), lambda w: F.struct(w["path"].alias("path"), w["token"].alias("token")))
    out = held.select("host", F.xxhash64("low", "high").alias("vector"), "n_pages", "support", "containers", around.alias("around"), nested.alias("words"))
    return out.filter((F.size("words") > 0) & (F.col("support") >= min_pages))


def _key():
    return F.xxhash64("url", "html")


FIXED = "array<struct<token: bigint, support: bigint>>"


def _held_by_page(pages: DataFrame, by_path: DataFrame) -> DataFrame:
    """key (of url and html), fixed (the template's words at the page's paths), of pages that have such."""

    def run(batches):
        for b in batches:
            rows = [(key, path) for url, page, key in zip(*(c.to_pylist() for c in b.columns), strict=True) for path in {x.path for x in Page(page, host_of(url)).blocks if not x.noise}]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int64()), pa.array([p for _, p in rows], pa.int64())], ["key", "path"])

    at = pages.select("url", "html", _key().alias("key")).filter("html <> ''").mapInArrow(run, "key long, path long")
    return written(at.distinct().join(by_path, "path").groupBy("key").agg(F.flatten(F.collect_list("fixed")).alias("fixed")), "page-templates")


def main_text(pages: DataFrame, min_pages: int = MIN_PAGES, max_links: float = MAX_LINKS, min_pages_inside: int = MIN_PAGES_INSIDE) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    bounded_batches(pages.sparkSession)
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    found = template(pages, min_pages).select("support", F.explode("words").alias("w"))
    # Words at one path belong to classes of containers around it: as many as its depth, none longer than a page.
    by_path = found.groupBy(F.col("w.path").alias("path")).agg(F.collect_list(F.struct(F.col("w.token").alias("token"), "support")).alias("fixed"))
    by_path = written(by_path, "template")
    size = by_path.agg(F.sum(F.size("fixed"))).first()[0] or 0
    shared = None
    if size <= BROADCAST_WORDS:
        shared = pages.sparkSession.sparkContext.broadcast({r.path: {f.token: f.support for f in r.fixed} for r in by_path.toLocalIterator()})

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part, texts = b.slice(i, 256), []
                for url, html, *some in zip(*(part.column(k).to_pylist() for k in range(1, part.num_columns)), strict=True):
                    page = Page(html, host_of(url))
                    if shared is None:
                        fixed, paths = {f["token"]: f["support"] for f in some[0] or ()}, None
                    else:
                        paths = {x.path for x in page.blocks} & shared.value.keys()
                        fixed = {t: n for path in paths for t, n in shared.value[path].items()}
                    texts.append("\n\n".join(x.text for x in chosen(page.blocks, fixed, max_links, min_pages_inside, paths)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    out = "page_id long, url string, text string, n_chars long"
    if shared is not None:
        return pages.mapInArrow(run, out)
    fixed = _held_by_page(pages, by_path)
    bits = pages.sparkSession.sparkContext.broadcast(_filter_of(fixed))

    def split(batches):
        held = np.unpackbits(bits.value).view(bool)
        for b in batches:
            yield b.append_column("hit", pa.array(held[b.column(3).to_numpy(zero_copy_only=False) % FILTER_BITS]))

    # Pages without a word of the template stay where they are.
    marked = pages.select("page_id", "url", "html", _key().alias("own")).mapInArrow(split, "page_id long, url string, html string, own long, hit boolean")
    plain = marked.filter("NOT hit").select("page_id", "url", "html", F.lit(None).cast(FIXED).alias("fixed"))
    hit = marked.filter("hit").join(fixed, F.col("own") == F.col("key"), "left").select("page_id", "url", "html", "fixed")
    return plain.unionByName(hit).mapInArrow(run, out)


def _filter_of(fixed: DataFrame) -> np.ndarray:
    """A bit map of the pages' keys, of a fixed size."""
    out = np.zeros(FILTER_BITS, bool)
    for r in fixed.select(F.expr(f"pmod(key, {FILTER_BITS})").cast("int").alias("at")).distinct().toLocalIterator():
        out[r.at] = True
    return np.packbits(out)


def op2_html_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))
