"""Main text of web pages: what a host's pages do not repeat, with markup as evidence.

A page is cut into blocks.  Its markup places each block: inside the article's
container (``article``, ``main`` and their like), open, or in a part that never
belongs to the article (menus, headers, footers, sidebars, adverts, forms, comments).
A class or id that only partly reads like such a part (``share-price``) makes a
block doubtful, no more.  A page with a container is its container's blocks,
another one its open ones.

All blocks of all pages enter their host's token streams: those inside containers
one, all others, the never wanted ones too, the other.  The streams are concatenated, page by page, and a suffix array over them finds the
long substrings that occur on several pages.  Outside containers two pages make a
substring boilerplate, whatever the host's size: open and doubtful blocks lose
the tokens it covers.  Inside, where markup speaks for the text, it takes half
of the host's pages with a container, and three.

Hosts with many pages are dealt over groups of bounded size by a hash of the page.
Each group counts the pages of its runs of tokens by their hashes, and the counts
are summed over the host before anything is decided, so the groups' number and
size change nothing.  What no decision needs is not counted: outside containers
the runs of a host none of whose pages has an open or doubtful block in its text,
inside those that are on less than the share of pages in every group, or whose
counts can't add up to it.  The rest is counted exactly.

Rows: a null or empty html has an empty text; a null url is a host of its own.
Unclosed tags, comments, scripts and cut-off pages are read as far as they go.
Repeated rows with one id are pages of their own, but not distinct ones.
"""

from __future__ import annotations

import hashlib
import html as _html
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import materialize, ship
from .common import slices

#: Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul title".split()
)
RAW = frozenset("script style textarea noscript template iframe svg object canvas video audio select xmp noembed noframes".split())
#: An opening tag of the first closes open ones of the others.
CLOSES = {k: v for ks, v in ((("li",), ("li", "p")), (("dd", "dt"), ("dd", "dt", "p")), (("tr",), ("tr", "p")), (("option",), ("option",)), (("tbody", "thead", "tfoot"), ("tr", "tbody", "thead", "tfoot", "p"))) for k in ks}
#: Tags that keep an inner tag from closing outer ones.
WALLS = frozenset("article aside blockquote body details dialog div dl fieldset figure footer form header html main nav ol section table td th ul menu".split())
#: Parts that are not the article, by tag, role and by words of class and id.  A name of such words and of filling ones is a part's, another one with such a word is doubtful.
OFF_TAGS = frozenset("nav footer aside form dialog menu head title button label fieldset".split())
OFF_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
OFF_WORDS = frozenset(
    "ad ads adslot adbox adsbygoogle adv advert adverts advertisement advertising sponsor sponsored promoted promo promotion banner cookie cookies consent gdpr notice notification alert newsletter subscribe subscription signup popup modal overlay paywall toast "
    "sidebar widget widgets related recommended recommendations share sharing social breadcrumb breadcrumbs pagination pager menu nav navbar navigation toolbar footer masthead comment comments commentlist respond disqus reply replies "
    "copyright disclaimer login signin skip".split()
)
DOUBTFUL_WORDS = frozenset("legal search discussion responses".split())
FILLING_WORDS = frozenset(
    "area articles bar block body bottom box button buttons card center column container content count feed fixed form free global group header icon icons inline inner item items large left link links list local main meta mobile module outer page panel posts primary "
    "right row secondary section side site slot small sticky sub text thread title top unit up wide wrap wrapper".split()
) | DOUBTFUL_WORDS
#: Of these, what makes an article element no article of the page.
OFF_ARTICLES = frozenset("comment comments reply replies related recommended recommendations sponsored promoted promo advert advertisement widget sidebar teaser".split())
#: Classes that name a subject, not a part.
SUBJECT_CLASSES = ("category-", "tag-", "topic-")
MAIN_WORDS = frozenset("article-body articlebody article-content post-content entry-content post-body story-body main-content".split())

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*+)>")
_ATTR = re.compile(r"""(?:^|(?<=[\s/"']))(class|id|role|hidden|itemprop|style|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s/>]|$)""", re.I)
_PART = re.compile(r"[^a-zA-Z0-9]+|(?<=[a-z])(?=[A-Z])")

MAIN, OFF, OPEN, MAYBE_MAIN, MAYBE_OPEN = "main", "off", "open", "main?", "open?"
#: A large host's pages are looked up under so many keys.
SALTS = 64


def _place(tag: str, attrs: str, in_main: bool, in_text: bool = False) -> tuple[bool, bool, bool]:
    """(is off, is a main container, is doubtful) of an opening tag; a button amid a sentence is its text."""
    off, main, doubt = tag in OFF_TAGS and not (in_text and tag in ("button", "label")) or tag == "header" and not in_main, tag in ("article", "main"), False
    if attrs and "=" in attrs or "hidden" in attrs:
        for name, a, b, c in _ATTR.findall(attrs):
            name, value = name.lower(), a or b or c
            if name in ("class", "id"):
                if tag not in ("html", "body"):
                    names = [{y.lower() for y in _PART.split(x) if y and not y.isdigit()} for x in value.split() if not x.lower().startswith(SUBJECT_CLASSES)]
                    if main:
                        off = off or any(not OFF_ARTICLES.isdisjoint(words) for words in names)
                    else:
                        off = off or any(not OFF_WORDS.isdisjoint(words) and words <= OFF_WORDS | FILLING_WORDS for words in names) or not in_main and "header" in value.lower().split()
                        doubt = doubt or any(not (OFF_WORDS | DOUBTFUL_WORDS).isdisjoint(words) for words in names)
                    main = main or not MAIN_WORDS.isdisjoint(value.lower().split())
            elif name == "role":
                off, main = off or value.lower() in OFF_ROLES, main or value.lower() in ("main", "article")
            elif name == "itemprop":
                main = main or value.lower() == "articlebody"
            elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                off = True
    return off, main and not off, doubt and not off


def blocks(page: str) -> list[tuple[str, str]]:
    """(place, text) of a page's blocks in order; white space is one space, and trimmed."""
    out: list[tuple[str, str]] = []
    stack: list[tuple[str, bool, bool, bool]] = []
    count: Counter = Counter()
    off = main = doubt = 0
    buf: list[str] = []
    pos, end, lower = 0, len(page), None

    def flush():
        if buf:
            text = " ".join("".join(buf).split())
            if text:
                out.append((OFF if off else (MAYBE_MAIN if doubt else MAIN) if main else MAYBE_OPEN if doubt else OPEN, text))
            buf.clear()

    def pop():
        nonlocal off, main, doubt
        tag, o, m, d = stack.pop()
        count[tag] -= 1
        off -= o
        main -= m
        doubt -= d

    while pos < end:
        at = page.find("<", pos)
        if at < 0:
            at = end
        if at > pos:
            chunk = page[pos:at]
            buf.append(_html.unescape(chunk) if "&" in chunk else chunk)
        if at >= end:
            break
        if page.startswith("<!--", at):
            close = page.find("-->", at + 4)
            pos = end if close < 0 else close + 3
            continue
        nxt = page[at + 1 : at + 2]
        if nxt in ("!", "?"):
            close = page.find(">", at)
            pos = end if close < 0 else close + 1
            continue
        m = _TAG.match(page, at) or _LOOSE.match(page, at)
        if m is None:
            if nxt == "/" or nxt.isalpha():
                if page.find(">", at) < 0:  # a tag that the page's end cuts off
                    break
            buf.append("<")
            pos = at + 1
            continue
        pos = m.end()
        tag = m.group(2).lower()
        if m.group(1):
            if tag == "br":
                buf.append(" ")
            if tag in ("td", "th"):
                buf.append(" ")
            if count[tag]:
                if tag in BLOCK or tag in ("td", "th"):
                    flush()
                while stack[-1][0] != tag:
                    pop()
                pop()
            elif tag in BLOCK:
                flush()
            continue
        if tag in RAW:
            if not m.group(3).endswith("/") or tag in ("script", "style"):
                if lower is None:
                    lower = page.lower()
                    if len(lower) != end:  # lower case may change the length; then only ASCII is lowered
                        lower = page.translate({c: c + 32 for c in range(65, 91)})
                close = lower.find(f"</{tag}", pos)
                if close < 0:
                    break
                shut = page.find(">", close)
                pos = end if shut < 0 else shut + 1
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            else:
                buf.append(" " if tag == "br" else "")
            continue
        o, mn, dt = _place(tag, m.group(3), main > 0, any(not x.isspace() for x in buf))
        dt = dt and tag in BLOCK
        if tag in BLOCK or o or mn:
            if tag in BLOCK:
                flush()
            closes = CLOSES.get(tag, ("p",) if tag in BLOCK else ())
            while closes and stack:
                k = len(stack) - 1
                while k >= 0 and stack[k][0] not in WALLS and stack[k][0] not in closes:
                    k -= 1
                if k < 0 or stack[k][0] not in closes:
                    break
                while len(stack) > k:
                    pop()
        elif tag in ("td", "th"):
            buf.append(" ")
        if tag in BLOCK or tag in ("td", "th", "option") or o or mn:
            if o and not off and tag not in BLOCK and tag not in ("td", "th"):
                pos = _skip(page, pos, tag)  # an advert inside a sentence: what comes before and after stays one block
                continue
            stack.append((tag, o, mn, dt))
            count[tag] += 1
            off += o
            main += mn
            doubt += dt
    flush()
    return out


def _skip(page: str, pos: int, tag: str) -> int:
    """Past the end tag that matches an inline element opened before ``pos``."""
    depth, at = 1, pos
    for m in re.compile(rf"<(/?){re.escape(tag)}\b[^>]*>", re.I).finditer(page, pos):
        depth += -1 if m.group(1) else 1
        at = m.end()
        if not depth:
            break
    return at


def covered(pages: list[list[list[int]]], run: int, share: float, least: int = 2) -> list[list[np.ndarray]]:
    """For each page's blocks of token numbers, which tokens a repeated substring covers.

    Prefix doubling sorts all suffixes of the concatenated streams by their first
    ``run`` tokens, the next power of two at most; neighbours of equal rank are
    the places of one substring, which is boilerplate if the places lie on at
    least ``least`` pages and on a share of all.
    """
    flat = [np.concatenate([np.array(b, np.int64) for b in p]) if p else np.zeros(0, np.int64) for p in pages]
    sizes = np.array([len(f) for f in flat])
    n = int(sizes.sum())
    need = max(least, int(np.ceil(share * len(pages))))
    mask = np.zeros(n + len(pages), bool)
    if n >= run and len(pages) > 1:
        top = max((int(f.max()) for f in flat if len(f)), default=0) + 1
        # a page ends with a number of its own, so no substring crosses pages
        stream = np.concatenate([x for i, f in enumerate(flat) for x in (f, [top + i])])
        page = np.repeat(np.arange(len(pages)), sizes + 1)
        rank, k = np.unique(stream, return_inverse=True)[1], 1
        while k < run:
            step = min(k, run - k)
            tail = np.full(len(rank), -1)
            tail[:-step] = rank[step:]
            key = rank * (len(rank) + 2) + tail + 1
            rank = np.unique(key, return_inverse=True)[1]
            k += step
        order = np.lexsort((page, rank))
        sorted_rank, sorted_page = rank[order], page[order]
        new = np.r_[True, sorted_rank[1:] != sorted_rank[:-1]]
        other = np.r_[True, (sorted_page[1:] != sorted_page[:-1]) | new[1:]]
        groups = np.cumsum(new) - 1
        pages_of = np.bincount(groups, weights=other)
        hit = np.zeros(len(rank), bool)
        hit[order] = pages_of[groups] >= need
        left = np.r_[sizes[0] + 1, sizes[1:] + 1].cumsum()[page] - 1 - np.arange(len(rank))  # tokens up to the page's end
        hit &= left >= run
        edge = np.zeros(len(rank) + run + 1, np.int64)
        starts = np.flatnonzero(hit)
        np.add.at(edge, starts, 1)
        np.add.at(edge, starts + run, -1)
        mask = edge.cumsum()[: len(rank)] > 0
    out, at = [], 0
    for p in pages:
        rows = []
        for b in p:
            rows.append(mask[at : at + len(b)])
            at += len(b)
        at += 1
        out.append(rows)
    return out


def host(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1)), F.lit(""))


def run_hashes(pages: list[list[list[str]]], run: int) -> list[np.ndarray]:
    """The hash of the run of words at each place of each page, the same in every task."""
    memo: dict[str, int] = {}

    def number(w: str) -> int:
        if w not in memo:
            memo[w] = int.from_bytes(hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        return memo[w]

    out = []
    for p in pages:
        x = np.array([number(w) for b in p for w in b], np.uint64)
        n = max(0, len(x) - run + 1)
        h = np.zeros(n, np.uint64)
        for k in range(run):
            h = (h ^ h >> np.uint64(29)) * np.uint64(0x9E3779B97F4A7C15) + x[k : k + n]
        out.append(h.view(np.int64))
    return out


def covered_by(pages: list[list[list[str]]], run: int, repeated: np.ndarray) -> list[list[np.ndarray]]:
    """Like ``covered``, by the hashes of the runs that are boilerplate."""
    out = []
    for p, h in zip(pages, run_hashes(pages, run)):
        edge = np.zeros(sum(map(len, p)) + 1, np.int64)
        starts = np.flatnonzero(np.isin(h, repeated))
        np.add.at(edge, starts, 1)
        np.add.at(edge, starts + run, -1)
        mask = edge.cumsum()[:-1] > 0
        out.append(np.split(mask, np.cumsum([len(b) for b in p])[:-1]) if p else [])
    return out


def extract(
    df: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", *, run: int = 8, pages: int = 2, main_pages: int = 3, main_share: float = 0.5, group_pages: int = 400
) -> DataFrame:
    """(page_id, url, text) of every row.

    Outside containers what ``pages`` pages of a host have is boilerplate, inside
    what ``main_pages`` have and the share ``main_share`` of those with a container.
    """
    spark = df.sparkSession
    ship(spark)
    d = df.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.coalesce(html, F.lit("")).alias("html"))

    def placed(batches):
        for b in (x for batch in batches for x in slices(batch)):
            rows = []
            for i, u, page, h, slot in zip(*(c.to_pylist() for c in b.columns)):
                found = blocks(page)
                rows.append((i, u, h, slot, [t for _, t in found], [place for place, _ in found]))
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["page_id", "url", "host", "slot", "blocks", "places"])

    # rows of one page meet in one group
    hosted = d.withColumn("host", host(F.col("url"))).withColumn("slot", F.xxhash64("page_id", F.when(F.col("page_id").isNull(), F.col("url"))))
    all_ = hosted.mapInArrow(placed, "page_id long, url string, host string, slot long, blocks array<string>, places array<string>")
    # only hosts of several groups need a lookup, and their pages are salted for it; written first, so that a short list is known as such and no page is shuffled for it
    sizes = materialize(d.select(host(F.col("url")).alias("h")).groupBy("h").agg(F.ceil(F.count("*") / group_pages).alias("groups")).where("groups > 1"), "html-hosts")
    sizes = sizes.select("h", "groups", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("s"))
    dealt = all_.join(sizes, (all_.host == sizes.h) & (F.pmod(all_.slot, F.lit(SALTS)) == sizes.s), "left")
    dealt = dealt.withColumn("groups", F.coalesce("groups", F.lit(1))).withColumn("group", F.pmod("slot", F.col("groups"))).drop("h", "s", "slot")

    def streams(t: pa.Table, inside: bool) -> tuple[list[list[list[str]]], list[list[tuple[int, int]]]]:
        """The blocks' words of each page, and the (row, block) of each; rows of one page are one stream."""
        by_page: dict = {}
        for k, (i, texts, places) in enumerate(zip(*(t.column(c).to_pylist() for c in ("page_id", "blocks", "places")))):
            got = by_page.setdefault(i, ([], []))
            for at, (text, place) in enumerate(zip(texts, places)):
                if (place == MAIN) == inside:
                    got[0].append(text.lower().split())
                    got[1].append((k, at))
        used = [x for x in by_page.values() if x[0]]
        return [x[0] for x in used], [x[1] for x in used]

    def counted(t: pa.Table, inside: bool) -> tuple[np.ndarray, np.ndarray, int]:
        """Each run of the group's pages, on how many of them it is, and the number of pages."""
        hashes = [np.unique(h) for h in run_hashes(streams(t, inside)[0], run)]
        runs, n = np.unique(np.concatenate(hashes), return_counts=True) if hashes else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        return runs, n, len(hashes)

    def wanted_of(places: list[str]) -> tuple[str, str]:
        return (MAIN, MAYBE_MAIN) if MAIN in places or MAYBE_MAIN in places else (OPEN, MAYBE_OPEN)

    def asks(t: pa.Table, inside: bool) -> bool:
        """Whether a block of some page's text depends on this stream."""
        return any((x == MAIN) == inside and x in wanted_of(p) for p in t.column("places").to_pylist() for x in p)

    def propose(t: pa.Table) -> pa.Table:
        """Runs on the share of a group's pages with a container, and a row without a run that tells of the group."""
        kinds = [("host", pa.string()), ("groups", pa.int64()), ("run", pa.int64()), ("above", pa.int64()), ("of", pa.int64()), ("under", pa.int64()), ("asks", pa.bool_())]
        if not t.num_rows or t.column("groups")[0].as_py() == 1:
            return pa.schema(kinds).empty_table()
        runs, n, of = counted(t, True)
        under = max(1, int(np.ceil(main_share * of))) - 1  # what a run that is left out is on, at most
        runs, n = runs[n > under], n[n > under]
        size = len(runs)
        host_, groups = (t.column(c)[0].as_py() for c in ("host", "groups"))
        rows = [[host_] * (size + 1), [groups] * (size + 1), [None, *runs.tolist()], [0, *(n - under).tolist()], [of] + [0] * size, [under] + [0] * size, [asks(t, False)] + [False] * size]
        return pa.table([pa.array(x, k) for x, (_, k) in zip(rows, kinds)], schema=pa.schema(kinds))

    def count(t: pa.Table, open_: pa.Table) -> pa.Table:
        """On how many of a group's pages the host's open runs are; outside containers all are open, if any page asks."""
        kinds = [("host", pa.string()), ("group", pa.int64()), ("inside", pa.bool_()), ("run", pa.int64()), ("n", pa.int64()), ("need", pa.int64())]
        out = [pa.schema(kinds).empty_table()]
        for inside in (False, True) if t.num_rows else ():
            mine = open_.filter(pc.equal(open_.column("inside"), inside))
            if mine.num_rows:
                runs, n, _ = counted(t, inside)
                if inside:
                    some = np.isin(runs, mine.column("run").to_numpy())
                    runs, n = runs[some], n[some]
                rows = [[t.column("host")[0].as_py()] * len(runs), [t.column("group")[0].as_py()] * len(runs), [inside] * len(runs), runs, n, [mine.column("need")[0].as_py()] * len(runs)]
                out.append(pa.table([pa.array(x, k) for x, (_, k) in zip(rows, kinds)], schema=pa.schema(kinds)))
        return pa.concat_tables(out)

    # a run on the share of a host's pages is on that share of some group's; what the groups left out of its count is bounded, so few runs stay open
    proposed = dealt.groupBy("host", "group").applyInArrow(propose, "host string, groups long, run long, above long, of long, under long, asks boolean")
    proposed = proposed.groupBy("host", "groups", "run").agg(*(F.sum(c).alias(c) for c in ("above", "of", "under")), F.max("asks").alias("asks"))
    whole = W.partitionBy("host")
    proposed = proposed.withColumn("need", F.greatest(F.lit(main_pages), F.ceil(main_share * F.sum("of").over(whole)))).withColumn("most", F.col("above") + F.sum("under").over(whole))
    open_ = proposed.where(F.when(F.col("run").isNull(), F.col("asks")).otherwise(F.col("most") >= F.col("need")))
    inside = F.col("run").isNotNull()
    open_ = open_.select("host", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("group"), inside.alias("inside"), "run", F.when(inside, F.col("need")).otherwise(pages).cast("long").alias("need"))
    counts = dealt.groupBy("host", "group").cogroup(open_.groupBy("host", "group")).applyInArrow(count, "host string, group long, inside boolean, run long, n long, need long")
    total = counts.withColumn("total", F.sum("n").over(W.partitionBy("host", "inside", "run")))
    known_ = total.where("total >= need").select("host", "group", "inside", "run")

    def decide(t: pa.Table, known: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        ids, urls, texts, places = (t.column(c).to_pylist() for c in ("page_id", "url", "blocks", "places"))
        out = {"page_id": ids, "url": urls, "text": []}
        wanted = [wanted_of(p) for p in places]
        gone: dict[tuple[int, int], np.ndarray] = {}
        for inside in (False, True):
            if not asks(t, inside):
                continue
            words, at = streams(t, inside)
            if t.num_rows and t.column("groups")[0].as_py() > 1:
                k = known.filter(pc.equal(known.column("inside"), inside))
                masks = covered_by(words, run, k.column("run").to_numpy())
            else:
                number: dict[str, int] = {}
                numbers = [[[number.setdefault(w, len(number)) for w in b] for b in p] for p in words]
                masks = covered(numbers, run, main_share, main_pages) if inside else covered(numbers, run, 0.0, pages)
            gone.update(zip((k for p in at for k in p), (m for p in masks for m in p)))
        for k in range(len(ids)):
            got = []
            for b, (text, place) in enumerate(zip(texts[k], places[k])):
                if place in wanted[k]:
                    mask = gone[k, b]
                    left = " ".join(w for w, c in zip(text.split(), mask) if not c) if mask.any() else text
                    if left:
                        got.append(left)
            out["text"].append("\n\n".join(got))
        return pa.table(out, schema=pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string())]))

    return dealt.groupBy("host", "group").cogroup(known_.groupBy("host", "group")).applyInArrow(decide, "page_id long, url string, text string")
