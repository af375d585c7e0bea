"""Operator 3, HTML extraction: consensus host paths.

Every page is parsed into blocks of text with the path of their containers. Each container is scored by its
text against its links and its names; the paths, generalised (tag and class, digits out), get votes of all
pages of a host, summed in Spark; then each page is read again and the text of the host's winning path is
taken. A page without that path falls back to its own best container.

Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments are left
out by tag, role or class, in the winning container as well. Character references are decoded, white space
inside a block becomes one space, blocks follow in page order with one space between.

Nulls: a null html is an empty page with an empty text; a null or odd url belongs to the host ''. Very long
and very deep pages are taken whole, in time proportional to their length. Of paths with equal votes the
deepest wins, then the one with the greater digest. Repeated rows are treated alike and each returned. An
empty table gives an empty result. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections import defaultdict
from dataclasses import dataclass, field
from hashlib import blake2b
from html import unescape

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, ship

#: Elements whose content is no text of the article.
DROPPED = frozenset("nav header footer aside form script style noscript template iframe object embed svg math canvas audio video button select option textarea input label dialog menu head title".split())
RAW = frozenset("script style textarea title noscript iframe template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that do not break the text into blocks.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var".split())
CONTAINERS = frozenset("article main section div td body center".split())
#: An open paragraph ends where one of these begins.
ENDS_P = frozenset("address article aside blockquote center details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: End tags that do not reach beyond the container they stand in.
_SHALLOW = INLINE | {"p", "li"}
_NOT_TEXT = re.compile(
    r"(?:^|[-_ ])(?:ad|ads|advert\w*|adsense|banner|sponsor\w*|promo\w*|nav\w*|menu\w*|breadcrumbs?|header|masthead|footer|foot|sidebar\w*|side|widget\w*|cookie\w*|consent|notice\w*|gdpr|popup|modal|newsletter|subscribe|signup|login|search|share\w*|social\w*|related\w*|recommend\w*|comments?|commentlist|respond|disqus|replies|reply|pagination|pager|toolbar|skip\w*|copyright|legal|disclaimer|alert)(?:$|[-_ ])",
    re.I,
)
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
_TEXTY = re.compile(r"article|content|entry|post|story|body|main|text", re.I)
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_EDGE = re.compile(r"[>\"']")
_ATTR = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'<>`]+)))?""")
_SPACE = re.compile(r"[\s ]+")
_DIGITS = re.compile(r"\d+")
_BARRIERS = CONTAINERS | {"ul", "ol", "table"}


class _Container:
    """An open element that text is summed over. ``up`` is the container around it; ``path`` a digest of the generalised tags from the root."""

    __slots__ = ("tag", "path", "up", "depth", "dropped", "hint", "text", "link")

    def __init__(self, tag: str, path: bytes, up: int, depth: int, dropped: bool, hint: float):
        self.tag, self.path, self.up, self.depth, self.dropped, self.hint = tag, path, up, depth, dropped, hint
        self.text = self.link = 0


@dataclass
class Page:
    """Containers in page order (so that ``up`` is always before), and blocks: (text, innermost container or -1, left out)."""

    containers: list[_Container] = field(default_factory=list)
    blocks: list[tuple[str, int, bool]] = field(default_factory=list)


class _Finder:
    """find() that remembers what does not occur any more, so that a page of openings without ends is read once."""

    def __init__(self, html: str):
        self.html, self.none = html, {}

    def __call__(self, what: str, at: int) -> int:
        if at >= self.none.get(what, len(self.html) + 1):
            return -1
        k = self.html.find(what, at)
        if k < 0:
            self.none[what] = min(at, self.none.get(what, at))
        return k

    def closing(self, tag: str, at: int) -> re.Match | None:
        key = f"</{tag}"
        if at >= self.none.get(key, len(self.html) + 1):
            return None
        m = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(self.html, at)
        if m is None:
            self.none[key] = min(at, self.none.get(key, at))
        return m


def _attrs(s: str) -> dict[str, str]:
    return {k.lower(): unescape(a or b or c or "") for k, a, b, c in _ATTR.findall(s)} if s.strip() else {}


def _tag_end(find: _Finder, at: int) -> int:
    """Place of the ``>`` that ends a tag, quoted values skipped; the page's end without one."""
    html, from_ = find.html, at
    while m := _EDGE.search(html, from_):
        if m.group() == ">":
            return m.start()
        k = find(m.group(), m.end())
        if k < 0:  # an open quote: the tag ends at the next >
            k = find(">", m.end())
            return k if k >= 0 else len(html)
        from_ = k + 1
    return len(html)


def parse(html: str | None) -> Page:
    """One pass over the page, in time proportional to its length whatever its depth and faults."""
    html = html or ""
    find, page, end = _Finder(html), Page(), len(html)
    tags: list[str] = [""]  # open elements, outermost first
    paths, dropped, inner = [b""], [False], [-1]  # of each: path, left out, innermost container
    places: dict[str, list[int]] = {}  # where each tag is open
    holders: list[int] = [0]  # where containers are open
    barriers: list[int] = [0]  # ... and lists and tables
    broken: list[int] = [0]  # where elements are open that break blocks
    interned: dict[tuple[bytes, str], bytes] = {}
    held: list[str] = []
    linked = 0

    def flush():
        nonlocal linked
        if held:
            t = _SPACE.sub(" ", unescape("".join(held))).strip(" ")
            if t:
                page.blocks.append((t, inner[-1], dropped[-1]))
                if not dropped[-1] and inner[-1] >= 0:
                    c = page.containers[inner[-1]]
                    c.text += len(t)
                    c.link += min(linked, len(t))
            held.clear()
        linked = 0

    def close(k: int):
        if broken[-1] >= k:
            flush()
        for tag in reversed(tags[k:]):
            places[tag].pop()
        for marks in (holders, barriers, broken):
            while marks[-1] >= k:
                marks.pop()
        del tags[k:], paths[k:], dropped[k:], inner[k:]

    def top(tag: str) -> int:
        return places[tag][-1] if places.get(tag) else 0

    def text(to: int):
        nonlocal linked
        if to > at:
            held.append(html[at:to])
            if "a" in tags[-3:]:
                linked += to - at

    at = 0
    while at < end:
        k = find("<", at)
        if k < 0:
            text(end)
            break
        name = _NAME.match(html, k + 2 if html.startswith("/", k + 1) else k + 1)
        if name is None:
            if html.startswith("<!--", k):
                text(k)
                stop = find("-->", k + 4)
                at = stop + 3 if stop >= 0 else end
            elif html.startswith("<![CDATA[", k) and (stop := find("]]>", k + 9)) >= 0:
                text(k)
                held.append(html[k + 9 : stop])
                at = stop + 3
            elif html.startswith(("<!", "<?"), k):
                text(k)
                stop = find(">", k + 2)
                at = stop + 1 if stop >= 0 else end
            else:  # a sign, no tag
                text(k + 1)
                at = k + 1
            continue
        text(k)
        stop = _tag_end(find, name.end())
        inside, at = html[name.end() : stop], stop + 1
        tag = name.group().lower()
        if html[k + 1] == "/":
            k = top(tag)
            if k and not (tag in _SHALLOW and holders[-1] > k):
                close(k)
            continue
        if tag in VOID:
            if tag not in ("wbr", "img", "link", "meta", "base", "input"):
                flush()
            continue
        if tag not in INLINE:
            flush()
        if tag in ENDS_P or tag == "li":
            k = top("li" if tag == "li" else "p")
            if k > barriers[-1]:
                close(k)
        attrs = _attrs(inside)
        names = f"{attrs.get('class', '')} {attrs.get('id', '')}".strip()
        out = dropped[-1] or tag in DROPPED or "hidden" in attrs or attrs.get("aria-hidden") == "true" or attrs.get("role", "").lower() in _ROLES
        if not out and names and tag not in ("html", "body", "main", "article") and _NOT_TEXT.search(names):
            out = True
        if inside.rstrip().endswith("/") and tag not in INLINE | CONTAINERS | {"p"}:
            continue
        if tag in RAW:
            m = find.closing(tag, at)
            if tag == "title" and m is None:
                m = re.compile(r"</head|<body", re.I).search(html, at)
                at = m.start() if m else end
            else:
                at = m.end() if m else end
            continue
        path = paths[-1]
        if tag not in INLINE:
            kind = ".".join([tag, *sorted(_DIGITS.sub("", x) for x in attrs.get("class", "").lower().split())]).rstrip(".")
            path = interned.get((path, kind)) or interned.setdefault((path, kind), blake2b(path + kind.encode("utf-8", "surrogatepass"), digest_size=12).digest())
        here = len(tags)
        places.setdefault(tag, []).append(here)
        own = inner[-1]
        if tag in CONTAINERS:
            hint = (1.0 if tag in ("article", "main") else 0.0) + (0.5 if names and _TEXTY.search(names) else 0.0)
            page.containers.append(_Container(tag, path, own, page.containers[own].depth + 1 if own >= 0 else 0, out, hint))
            own = len(page.containers) - 1
            holders.append(here)
        if tag in _BARRIERS:
            barriers.append(here)
        if tag not in INLINE:
            broken.append(here)
        tags.append(tag)
        paths.append(path)
        dropped.append(out)
        inner.append(own)
    flush()
    for c in reversed(page.containers):  # a container has what those inside it have
        if c.up >= 0:
            page.containers[c.up].text += c.text
            page.containers[c.up].link += c.link
    return page


Path = tuple[int, str]


def _path(c: _Container) -> Path:
    return c.depth, c.path.hex()


def scores(page: Page) -> dict[Path, float]:
    """Score of each generalised path: own text that is no link, kept from going to the outermost container by what names and tags say."""
    best: dict[Path, float] = defaultdict(float)
    whole = max((c.text for c in page.containers if not c.dropped), default=0)
    for c in page.containers:
        if c.text and not c.dropped:
            best[_path(c)] += c.text / whole * (1 - c.link / c.text) * (1.0 + c.hint) - (0.15 if c.tag in ("body", "center", "td") else 0.0)
    return dict(best)


def take(page: Page, path: Path | None) -> str:
    """The text in containers of a path, or all that is not left out."""
    hit = [False] * len(page.containers)
    for i, c in enumerate(page.containers):
        hit[i] = path is None or (c.up >= 0 and hit[c.up]) or _path(c) == path
    return " ".join(t for t, i, out in page.blocks if not out and (path is None or (i >= 0 and hit[i])))


def best_path(votes: dict[Path, float]) -> Path | None:
    """Of equal votes the deepest path, then by its digest."""
    return max(votes, key=lambda p: (votes[p], p)) if votes else None


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages."""
    spark = pages.sparkSession
    ship(spark)
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1)), F.lit(""))

    def vote(batches):
        for batch in batches:
            sums: dict[tuple[str, int, str], float] = defaultdict(float)
            for h, html in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
                for (depth, path), s in scores(parse(html)).items():
                    sums[h, depth, path] += s
            hosts, depths, paths = zip(*sums, strict=True) if sums else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(depths, pa.int32()), pa.array(paths, pa.string()), pa.array([round(x * 1e6) for x in sums.values()], pa.int64())], ["host", "depth", "path", "votes"])

    votes = pages.select(host.alias("host"), "html").mapInArrow(vote, "host string, depth int, path string, votes long").groupBy("host", "depth", "path").agg(F.sum("votes").alias("votes"))
    won = votes.groupBy("host").agg(F.max(F.struct("votes", "depth", "path")).alias("w"))
    won = Scratch(spark, "html").keep(won.select(F.col("host").alias("_host"), "w.depth", "w.path"))
    rows = pages.select("page_id", "url", "html", host.alias("host"))
    rows = rows.join(won, F.col("host") == F.col("_host"), "left")  # the planner broadcasts the hosts if they are few, and deals hot hosts anew if not

    @F.pandas_udf("string")
    def read(html: pd.Series, depth: pd.Series, path: pd.Series) -> pd.Series:
        out = []
        for h, d, p in zip(html, depth, path, strict=True):
            page = parse(h)
            text = take(page, (int(d), p)) if isinstance(p, str) else ""
            out.append(text or take(page, best_path(scores(page))))
        return pd.Series(out, dtype=object)

    return rows.select("page_id", "url", read("html", "depth", "path").alias("text")).withColumn("n_chars", F.char_length("text").cast("long"))
