"""Main text of web pages: a suffix array of each host's page streams, guarded by markup rules.

A page is parsed into blocks. Scripts, styles, menus, headers, footers, sidebars, notices,
adverts, forms and comments are marked by their elements and class names; an article (else
a main, else a content container) holds the main text if the page has one, else all blocks
that are not marked. A main area's title beside its article belongs to it. These are the
page's kept blocks. The words of all blocks, kept or not,
are its token stream, with breaks where kept blocks, headings and others meet.

A run of RUN words or more that is on enough different pages of its host is boilerplate, and
goes from the kept blocks of every page. The words of such runs are those of their windows
of RUN words, so classes of suffixes that agree in RUN words find them all, however long.
Streams are concatenated, in bounded batches, and their suffixes sorted; the classes of all
batches meet in one aggregation. Before it, each window is known by the least hash of its
short grams: windows whose least gram is on too few pages are on too few themselves, and are
left out. Runs on two pages only are followed to LONG words. How many pages are enough depends on the host's pages, see `enough`. Articles that
are repeated with small changes are not boilerplate: pages that would lose more than COPY of
their kept words, less those in runs on most pages of the host, to other runs do not count.

On pages without a container covered words go in whole blocks or in RUN or more words of a
block; fewer at a block's edge stay. In containers, text that other articles repeat is text:
there only whole blocks go, if runs on most pages of the host hold them, and headings never.
Defined results: null and empty html give an empty text. Pages of one content
count once, so that copies of a page do not erase each other. Repeated rows give repeated
rows. An empty table gives none. Other columns are ignored. Words are equal if they differ
in the case of A-Z only.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .minhash import _mix, _Powers, word_hashes

#: Words in a row that make a repeated run; words of the grams that stand for a run's windows.
RUN = 10
GRAM = 4
#: Words in a row where the run is on two pages only, as can be enough on hosts of two or three.
LONG = 15
#: A run is boilerplate on this share of a host's pages, see `enough`.
SHARE = 0.1
#: A page counts as a copy of others if runs hold more than this share of its kept words.
COPY = 0.8
#: Words of streams whose suffixes are sorted together.
BATCH_WORDS = 200_000
#: Pages that are hashed together.
PAGES = 64
#: Grams or runs, 8 or 16 bytes each, that are sent to all executors; more are not, see `main_text`.
SENT = 2_000_000

# fixed values: element names by role
_RAW = frozenset(["script", "style", "textarea", "title", "iframe", "noembed", "noframes", "xmp"])
_VOID = frozenset(["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"])
_SKIPPED = frozenset(["nav", "footer", "aside", "form", "head", "noscript", "template", "svg", "button", "select", "dialog", "menu", "object", "canvas"])
_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html "
    "legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
_HEADINGS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])
_NAMES = (
    "ad|ads|advert|adverts|advertisement|advertising|sponsor|sponsored|promo|promotion|banner|sidebar|side-bar|aside|menu|nav|navbar|navigation|breadcrumb|breadcrumbs|topbar|"
    "masthead|site-header|page-header|header|footer|site-footer|page-footer|cookie|cookies|consent|gdpr|notice|notices|alert|disclaimer|popup|modal|overlay|newsletter|subscribe|"
    "signup|login|search|share|sharing|social|related|recommended|recommendations|comment|comments|comment-list|commentlist|respond|disqus|discussion|replies|widget|toolbar|pagination|pager"
)
_BOILER = re.compile(rf"^(?:js-|site-|page-|post-|article-|user-|reader-)?(?:{_NAMES})(?:[-_]?\d*|[-_](?:section|area|box|block|wrapper|container|list|inner|bar|bottom|top|left|right|unit|slot))$")
_CONTENT = re.compile(r"^(?:content|main|main-content|maincontent|article|article-body|articlebody|article-content|post|post-body|post-content|entry|entry-content|story|story-body|page-content|body-text)$")
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
_ATTR = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")


def _role(name: str, attrs: str, inside: int) -> tuple[bool, int]:
    """(boilerplate, container rank) of an element; inside is the rank that it stands in."""
    rank = 3 if name == "article" else 2 if name == "main" else 0
    drop = name in _SKIPPED or name == "header" and inside < 2
    if not attrs or attrs == "/":
        return drop, rank
    values = {k.lower(): v.strip("\"'").lower() for k, v in _ATTR.findall(attrs)}
    names = values.get("class", "").split() + values.get("id", "").split()
    role = values.get("role", "")
    if "hidden" in values or values.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", values.get("style", "")):
        drop = True
    if role in ("navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog"):
        drop = True
    if name not in ("html", "body", "main"):
        drop = drop or any(_BOILER.match(x) and not (inside >= 2 and x.endswith("header")) for x in names)
    if role == "main":
        rank = max(rank, 2)
    if values.get("itemprop") == "articlebody" or role == "article":
        rank = 3
    if not rank and name in ("div", "section", "td") and any(_CONTENT.match(x) for x in names):
        rank = 1
    return drop, rank


#: Rank of a title in the main area: kept beside an article there, and where the main area is.
TITLE = 2.5


def parse(page: str | None) -> list[tuple[float, str]]:
    """[(rank, text)] of a page's blocks in order: -1 for boilerplate, else the rank of the container (0: none)."""
    return [(rank, text) for rank, _, text in _blocks_of(page)]


def _blocks_of(page: str | None) -> list[tuple[float, bool, str]]:
    """(rank, whether it is a heading, text) of a page's blocks."""
    out: list[tuple[float, bool, str]] = []
    stack: list[tuple[str, bool, int]] = []  # element, boilerplate in force, rank in force
    parts: list[str] = []
    page, at = page or "", 0

    def flush() -> None:
        if parts:
            text = " ".join("".join(parts).split())
            parts.clear()
            if text:
                drop, rank = stack[-1][1:] if stack else (False, 0)
                title = rank == 2 and any(x[0] == "h1" for x in stack)
                heading = any(x[0] in _HEADINGS for x in stack)
                out.append((-1 if drop else TITLE if title else rank, heading, text))

    for m in iter(lambda: _TAG.search(page, at), None):
        if m.start() > at:
            parts.append(html.unescape(page[at : m.start()]))
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        name, closing, attrs = name.lower(), bool(m[1] or m[4]), (m[3] or m[6] or "").strip()
        if name == "br":
            parts.append(" ")
        if name in _VOID:
            if name == "hr":
                flush()
            continue
        if name in _RAW and not closing:
            if name in _BLOCKS:
                flush()
            end = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        inside = stack[-1][2] if stack else 0
        dropped = stack[-1][1] if stack else False
        if closing:
            if any(x[0] == name for x in stack):
                if name in _BLOCKS:
                    flush()
                while True:
                    gone = stack.pop()
                    if (stack[-1][1:] if stack else (False, 0)) != gone[1:]:
                        stack.append(gone)
                        flush()
                        stack.pop()
                    if gone[0] == name:
                        break
            elif name in _BLOCKS:
                flush()
            continue
        if name in _BLOCKS:
            flush()
            if stack and (stack[-1][0] == "p" or stack[-1][0] == name and name in ("li", "dt", "dd", "tr", "td", "th", "option")):
                stack.pop()
                inside = stack[-1][2] if stack else 0
                dropped = stack[-1][1] if stack else False
        drop, rank = _role(name, attrs, inside)
        if (drop and not dropped) or rank > inside:
            flush()
        if not attrs.endswith("/") or name in _BLOCKS:
            stack.append((name, dropped or drop, max(inside, rank)))
    if at < len(page):
        parts.append(html.unescape(page[at:]))
    flush()
    return out


def _host(url: str | None) -> str:
    m = re.match(r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", url or "")
    return (m[1] if m else "").lower()


def _suffix_ranks(tokens: np.ndarray, length: int) -> np.ndarray:
    """Ranks of all suffixes by their first `length` tokens, by prefix doubling; equal ranks agree in these."""
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    have = 1
    while have < length:
        step = min(have, length - have)
        ahead = np.concatenate((rank[step:] + 1, np.zeros(step, dtype=np.int64)))
        rank = np.unique(rank * (len(rank) + 2) + ahead, return_inverse=True)[1].astype(np.int64)
        have += step
    return rank


def enough(pages: Column) -> Column:
    """On how many pages of a host, of so many different ones, a run is boilerplate.

    A tenth, but three at least; on hosts of up to three pages two.
    """
    return F.greatest(F.lit(2), F.least(F.floor(pages / 2) + 1, F.greatest(F.lit(3), F.ceil(pages * SHARE)))).cast("int")


def _hash(*parts: str) -> int:
    return xxhash.xxh3_64_intdigest("\x00".join(parts).encode("utf-8", "surrogatepass")) - 2**63


def _mark(rank: float, heading: bool, top: int) -> str:
    """0: not kept; kept blocks are 1 on pages without a container, 2 in one, 3 headings in one."""
    if rank != TITLE and rank != top:
        return "0"
    return "1" if not top else "3" if heading else "2"


def _parsed(pages: DataFrame) -> DataFrame:
    """(page_id, url, host, content, page, text, kept): text has a block a line, kept a mark for each block, see `_mark`; page is a hash of all these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, kepts, numbers = [], [], []
            for url, page in zip(b.column(1), b.column(2), strict=True):
                blocks = _blocks_of(page.as_py())
                top = max((int(r) for r, _, _ in blocks if r >= 0), default=0)
                text, kept = "\n".join(t for _, _, t in blocks), "".join(_mark(r, heading, top) for r, heading, _ in blocks)
                host = _host(url.as_py())
                texts.append(text)
                kepts.append(kept)
                numbers.append((_hash(host), _hash(host, text), _hash(host, text, kept)))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), *(pa.array([x[k] for x in numbers], pa.int64()) for k in range(3)), pa.array(texts, pa.string()), pa.array(kepts, pa.string())],
                names=["page_id", "url", "host", "content", "page", "text", "kept"],
            )

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, host long, content long, page long, text string, kept string")


def _windows(hosts: list[int], texts: list[str], kepts: list[str], powers: _Powers) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(words, places of windows of RUN words, their hashes, least hashes of their grams) of each page; no window holds a break.

    Some pages are hashed together, as short arrays are slow.
    """
    for at in range(0, len(texts), PAGES):
        yield from _windows_together(hosts[at : at + PAGES], texts[at : at + PAGES], kepts[at : at + PAGES], powers)


def _windows_together(hosts: list[int], texts: list[str], kepts: list[str], powers: _Powers) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    blocks = [_sizes(t) for t in texts]
    counts = np.array([int(b.sum()) for b in blocks])
    ids = word_hashes("\n".join(texts), powers) + np.repeat(np.array(hosts, dtype=np.int64).view(np.uint64), counts)
    ends = np.cumsum(counts)
    n = len(ids) - RUN + 1
    at, runs, least = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.uint64)
    if n > 0:
        up, down = powers.upto(len(ids) + 1)
        sums = np.zeros(len(ids) + 1, dtype=np.uint64)
        np.cumsum(ids * up[:-1], dtype=np.uint64, out=sums[1:])
        grams = _mix((sums[GRAM:] - sums[:-GRAM]) * down[: len(ids) - GRAM + 1])
        have, wanted = 1, RUN - GRAM + 1
        while have < wanted:  # least of ever more grams in a row
            step = min(have, wanted - have)
            grams, have = np.minimum(grams[:-step], grams[step:]), have + step
        runs = _mix((sums[RUN:] - sums[:-RUN]) * down[:n])
        marks = np.frombuffer("".join(kepts).encode(), dtype=np.uint8)
        breaks = marks[1:] != marks[:-1]
        starts = np.cumsum([len(b) for b in blocks])[:-1]
        breaks[starts[(starts > 0) & (starts < len(marks))] - 1] = True  # another page
        part = np.repeat(np.concatenate(([0], np.cumsum(breaks))), np.concatenate(blocks))
        at = np.flatnonzero(part[:n] == part[RUN - 1 :])
        runs, least = runs[at], grams[at]
    cuts = np.searchsorted(at, ends)
    first = 0
    for end, size, cut in zip(ends.tolist(), counts.tolist(), cuts.tolist(), strict=True):
        yield ids[end - size : end], at[first:cut] - (end - size), runs[first:cut], least[first:cut]
        first = cut


def _sizes(text: str) -> np.ndarray:
    """Words of each block; blocks are lines, and single blanks part words."""
    return np.array([t.count(" ") + 1 for t in text.split("\n")] if text else [], dtype=np.int64)


_SHIFT = np.uint64(24)  # 40 bits of a gram are kept: equal ones only let more windows through


def _common_grams(pages: DataFrame) -> DataFrame:
    """(gram): least grams of windows that are on enough pages, copies of pages counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = _Powers()
        for b in batches:
            grams, host_pages = [np.empty(0, np.uint64)], [np.empty(0, np.int32)]
            hosts, texts, kepts, sizes = (b.column(k).to_pylist() for k in range(4))
            for size, found in zip(sizes, _windows(hosts, texts, kepts, powers), strict=True):
                grams.append(np.unique(found[3] >> _SHIFT))
                host_pages.append(np.full(len(grams[-1]), size, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(grams).view(np.int64)), pa.array(np.concatenate(host_pages))], names=["gram", "size"])

    rows = pages.select("host", "text", "kept", "size").mapInArrow(run, "gram long, size int")
    return rows.groupBy("gram").agg(F.count("*").alias("n"), F.min("size").alias("size")).where(F.col("n") >= enough(F.col("size"))).select("gram")


def _classes(pages: DataFrame, grams: Broadcast | None) -> DataFrame:
    """(run, content, size of the host): each class of suffixes, by a hash of host and RUN words, with each page content that it is in; grams: those of windows that may be common."""

    def sort_batch(held: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        runs, contents, host_pages = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int32)
        if held:
            words = np.unique(np.concatenate([x[2] for x in held]), return_inverse=True)[1].astype(np.int64)
            sizes = np.array([len(x[2]) for x in held])
            base = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
            tokens = np.empty(len(words) + len(held), dtype=np.int64)
            ends = base + sizes
            inner = np.ones(len(tokens), dtype=bool)
            inner[ends] = False
            tokens[inner] = words
            tokens[ends] = -1 - np.arange(len(held))  # ends a page: no other is equal
            rank = _suffix_ranks(tokens, RUN)
            starts = np.concatenate([x[3] + f for x, f in zip(held, base, strict=True)])
            counts = [len(x[3]) for x in held]
            content = np.repeat(np.array([x[0] for x in held], dtype=np.int64), counts)
            order = np.lexsort((content, rank[starts]))
            r, c = rank[starts[order]], content[order]
            first = order[np.concatenate(([True], (r[1:] != r[:-1]) | (c[1:] != c[:-1])))]
            runs, contents = np.concatenate([x[4] for x in held])[first], content[first]
            host_pages = np.repeat(np.array([x[1] for x in held], dtype=np.int32), counts)[first]
        return pa.RecordBatch.from_arrays([pa.array(runs.view(np.int64)), pa.array(contents), pa.array(host_pages)], names=["run", "content", "size"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, held, size = _Powers(), [], 0
        for b in batches:
            hosts, contents, texts, kepts, host_pages = (b.column(k).to_pylist() for k in range(5))
            for content, pages_, (words, at, runs, least) in zip(contents, host_pages, _windows(hosts, texts, kepts, powers), strict=True):
                if grams is not None:
                    may = _places(least >> _SHIFT, grams.value) >= 0
                    at, runs = at[may], runs[may]
                if len(at):
                    held.append((content, pages_, words, at, runs))
                    size += len(words)
                if size >= BATCH_WORDS:
                    yield sort_batch(held)
                    held, size = [], 0
        yield sort_batch(held)

    return pages.select("host", "content", "text", "kept", "size").mapInArrow(run, "run long, content long, size int")


def _places(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Place of each value in a sorted table, -1 if it is not there."""
    at = np.searchsorted(table, values)
    at[at == len(table)] = 0
    return np.where(table[at] == values, at, -1) if len(table) else np.full(len(values), -1)


_FEW, _SOME, _MOST = 0, 1, 2  # runs on two pages, on more, on most pages of the host


def _long(places: np.ndarray, runs: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, runs, whether on most pages), without runs on two pages that do not follow each other for LONG words."""
    if not len(places):
        return places, runs, kinds == _MOST
    follows = np.diff(places, prepend=-9) == 1
    size = np.bincount(stretch := np.cumsum(~follows)) + RUN - 1
    keep = (kinds != _FEW) | (size[stretch] >= LONG)
    return places[keep], runs[keep], kinds[keep] == _MOST


def _words_on(text: str, places: np.ndarray) -> np.ndarray:
    """Whether a run at these places holds the word, for each word."""
    on = np.zeros(text.count(" ") + text.count("\n") + 1 if text else 0, dtype=bool)
    for k in range(RUN):
        on[places + k] = True
    return on


def unique_words(text: str, kept: str, places: np.ndarray, most: np.ndarray) -> str:
    """The kept blocks less the words that runs at these places hold; in containers less whole blocks that runs on most pages hold."""
    if not len(places):
        return "\n".join(t for t, keep in zip(text.split("\n"), kept, strict=False) if keep != "0")
    gone, everywhere, out, at = _words_on(text, places), _words_on(text, places[most]), [], 0
    for block, size, keep in zip(text.split("\n"), _sizes(text), kept, strict=False):
        here = gone[at : at + size]
        if keep in "23":
            if keep == "3" or not everywhere[at : at + size].all():
                out.append(block)
        elif keep == "1":
            if not here.any():
                out.append(block)
            elif not here.all():
                edge = np.flatnonzero(np.diff(here, prepend=False, append=False))
                stay = np.ones(size, dtype=bool)
                for a, b in zip(edge[::2], edge[1::2], strict=True):
                    stay[a:b] = b - a < RUN
                words = block.split(" ")
                out.append(" ".join(words[k] for k in np.flatnonzero(stay)))
        at += size
    return "\n".join(out)


def is_copy(text: str, kept: str, places: np.ndarray, most: np.ndarray) -> bool:
    """Whether runs at these places hold more than the share COPY of the kept words, less those that runs on most pages hold."""
    if most.all():
        return False
    own = np.repeat(np.frombuffer(kept.encode(), dtype=np.uint8) != ord("0"), _sizes(text)) & ~_words_on(text, places[most])
    return bool((_words_on(text, places[~most]) & own).sum() > COPY * own.sum())


def _mapped(pages: DataFrame, boiler: DataFrame, f: Callable, schema: str, sent: int) -> DataFrame:
    """f(batch, hits) of the pages' batches (page, host, text, kept, others); hits: for each row the places of the runs of boiler, the runs, and whether most pages have them."""
    if boiler.count() <= sent:
        both = boiler.select("run", "kind").toArrow()
        order = np.argsort(runs := both["run"].to_numpy().view(np.uint64))
        known = pages.sparkSession.sparkContext.broadcast((runs[order], both["kind"].to_numpy()[order]))

        def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            powers = _Powers()
            for b in batches:
                hits = []
                for _, at, runs, _ in _windows(*(b.column(k).to_pylist() for k in (1, 2, 3)), powers):
                    place = _places(runs, known.value[0])
                    hit = place >= 0
                    hits.append(_long(at[hit], runs[hit].view(np.int64), known.value[1][place[hit]]))
                yield f(b, hits)

        return pages.mapInArrow(look, schema)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = _Powers()
        for b in batches:
            for page, (_, at, runs, _) in zip(b.column(0).to_pylist(), _windows(*(b.column(k).to_pylist() for k in (1, 2, 3)), powers), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), page, dtype=np.int64)), pa.array(at), pa.array(runs.view(np.int64))], names=["page", "place", "run"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hits = []
            for x in b.column(b.num_columns - 1).to_pylist():
                at = np.array(sorted((y["place"], y["run"], y["kind"]) for y in x or []), dtype=np.int64).reshape(-1, 3)
                hits.append(_long(*at.T))
            yield f(b, hits)

    places = pages.select("page", "host", "text", "kept").mapInArrow(spread, "page long, place long, run long").distinct()
    covered = places.join(boiler, "run").groupBy("page").agg(F.collect_list(F.struct("place", "run", "kind")).alias("covered"))
    return pages.join(covered, "page", "left").select(*pages.columns, "covered").mapInArrow(joined, schema)


def _uncopied(streams: DataFrame, boiler: DataFrame, sent: int) -> DataFrame:
    """The runs of boiler that are on most pages of a host, or on enough pages that are not copies."""

    def run(b: pa.RecordBatch, hits: list) -> pa.RecordBatch:
        runs, contents = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for text, kept, content, (at, found, most) in zip(*(b.column(k).to_pylist() for k in (2, 3, 4)), hits, strict=True):
            if not is_copy(text, kept, at, most):
                runs.append(np.unique(found[~most]))
                contents.append(np.full(len(runs[-1]), content, dtype=np.int64))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(runs)), pa.array(np.concatenate(contents))], names=["run", "content"])

    rows = _mapped(streams.select("page", "host", "text", "kept", "content"), boiler, run, "run long, content long", sent)
    counted = rows.distinct().groupBy("run").agg(F.count("*").alias("others"))
    return boiler.join(counted, "run", "left").where((F.col("kind") == _MOST) | (F.col("others") >= enough(F.col("size")))).select("run", "kind")


def main_text(pages: DataFrame, sent: int = SENT) -> DataFrame:
    """page_id, url, text of every row of pages (page_id, url, html).

    Up to `sent` common grams and runs go to all executors. With more grams every window is
    counted; more runs are joined to the pages' windows.
    """
    parsed = materialize(_parsed(pages), "parsed-pages")
    hosts = parsed.select("host", "content").distinct().groupBy("host").agg(F.count("*").cast("int").alias("size"))
    streams = parsed.join(materialize(hosts, "hosts"), "host")

    found = materialize(_common_grams(streams), "common-grams")
    grams = None
    if found.count() <= sent:
        grams = pages.sparkSession.sparkContext.broadcast(np.sort(found.toArrow()["gram"].to_numpy()).view(np.uint64))
    counted = _classes(streams, grams).distinct().groupBy("run").agg(F.count("*").alias("pages"), F.min("size").alias("size"))
    most = F.col("pages") >= F.greatest(F.lit(4), F.floor(F.col("size") / 2) + 1)
    kind = F.when(F.col("pages") == 2, _FEW).when(most, _MOST).otherwise(_SOME)
    common = materialize(counted.where(F.col("pages") >= enough(F.col("size"))).select("run", "size", kind.alias("kind")), "common-runs")
    boiler = materialize(_uncopied(streams, common, sent), "boilerplate-runs")

    def run(b: pa.RecordBatch, hits: list) -> pa.RecordBatch:
        text = [unique_words(t, k, at, most) for t, k, (at, _, most) in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), hits, strict=True)]
        return pa.RecordBatch.from_arrays([b.column(4), b.column(5), pa.array(text, pa.string())], names=["page_id", "url", "text"])

    id_kind = pages.schema["page_id"].dataType.simpleString()
    return _mapped(parsed.select("page", "host", "text", "kept", "page_id", "url"), boiler, run, f"page_id {id_kind}, url string, text string", sent)
