"""Main text of web pages by consensus paths of their hosts.

Each page's containers are scored by the running text they hold.  In Spark, the
pages of a host vote on generalised tag and class paths with these scores, and
every page is read again along the path that won on its host, in the whole article
around it.  A page without text there is read along the best of its own paths.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.plans.joins import attach
from skein.plans.scratch import materialize
from skein.plans.ship import map_batches

#: Attributes of a tag; a quote that is never closed is part of an unquoted value.
_ATTRS = r"""(?:[\s/]++|=?+[^\s/>=]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>]++)?+)?+|=)*+"""
_MARKUP = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    rf"|<svg(?=[\s/]){_ATTRS}(?<=/)>"
    rf"|<(?P<raw>script|style|noscript|template|iframe|title|textarea|object|canvas|svg)(?=[\s/>]|\Z){_ATTRS}(?:\Z|>.*?(?:</(?P=raw)(?=[\s/>]|\Z)[^>]*+(?:>|\Z)|\Z))"
    rf"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>{_ATTRS})(?:>|\Z)",
    re.S | re.I,
)
_ATTR = re.compile(r"""([^\s/>=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]++)))?+""")
# What HTML calls these elements.
_CONTAINERS = frozenset("html body main article section div td th center table tbody tr nav header footer aside form dialog menu ul ol dl li dt dd figure blockquote details fieldset hgroup address".split())
_BLOCKS = _CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 pre hr br figcaption caption summary option legend thead tfoot".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_NEVER = frozenset("nav header footer aside form dialog menu head button select fieldset".split())
_MAIN = frozenset("article main".split())
_BODY = frozenset(("", "html", "body"))
#: Elements that belong to the text around them.
_PARTS = frozenset("ul ol dl li dt dd table tbody tr blockquote figure details address hgroup".split())
#: What ends where one of these begins right inside it.
_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr",)}
#: Words of class, id and role that mark what is not the article, and those that also name layouts.
_OTHER = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs footer sidebar aside ad ads advert adverts advertisement sponsor sponsored promo promotion notice cookie cookies consent gdpr newsletter subscribe signup "
    "login share sharing related recommended comment comments commentlist replies disqus respond pagination pager skip contentinfo complementary".split()
)
_LAYOUT = frozenset("header masthead banner side widget popup modal overlay search social toolbar".split())
#: Words before or after which a name tells of a state or of what else is on the page.
_STATES_BEFORE = frozenset("has no not non with without is show hide js".split())
_STATES_AFTER = frozenset("open opened closed enabled disabled on off active visible hidden".split())
#: Whose header holds the headline.
_CONTENT = frozenset("entry article post story content section".split())
_WORDS = re.compile(r"[\s_\-]+")
_HUMPS = re.compile(r"(?<=[a-z])(?=[A-Z])")
_DIGITS = re.compile(r"\d+")
#: Paths beyond this length go by a digest, so that deep pages need no more memory than their elements do.
PATH_CHARS = 500


def _names(attrs: str) -> tuple[str, int]:
    """Class of a tag, and how surely class, id and role say that it is not the article: 0, 1 (a word of layouts) or 2."""
    return _short_names(attrs) if len(attrs) <= 500 else _short_names.__wrapped__(attrs)


@lru_cache(8192)
def _short_names(attrs: str) -> tuple[str, int]:
    found: dict[str, str] = {}
    for m in _ATTR.finditer(attrs):
        name = m[1].lower()
        if name in ("class", "id", "role"):
            found.setdefault(name, m[2] or m[3] or m[4] or "")
    return found.get("class", ""), max((_mark(token) for value in found.values() for token in value.split()), default=0)


def _mark(token: str) -> int:
    words = [w for w in _WORDS.split(_DIGITS.sub("", _HUMPS.sub("-", token)).lower()) if w]
    if not words or words == ["side", "by", "side"] or (len(words) > 1 and (words[0] in _STATES_BEFORE or words[-1] in _STATES_AFTER)):
        return 0
    if any(w in _OTHER for w in words):
        return 2
    if words[-1] == "header" and _CONTENT & set(words):
        return 0
    return int(any(w in _LAYOUT for w in words))


class Page:
    """Text runs of a page with the container that holds each; memory is in proportion to the source."""

    def __init__(self, source: str) -> None:
        #: Of each container: its tag, path, parent, and how surely it is not the article.
        self.tags, self.path_of, self.parents, self.other = [""], [0], [-1], [0]
        # Paths are shared by containers; each is its parent path and one segment.
        self._ids: dict[tuple[int, str], int] = {}
        self._path_parents, self._segments, self._lengths, self._digests = [-1], [""], [0], [""]
        #: (container, text, its characters inside links)
        self.runs: list[tuple[int, str, int]] = []
        self._read(source)
        held = [0, 0, 0]
        for c, text, linked in self.runs:
            held[self.other[c]] += max(0, len(text) - 2 * linked)
        # Names of layouts prove nothing where most of the page has them.
        self.most = 1 if held[1] > 2 * held[0] else 0

    def _path(self, parent: int, segment: str) -> int:
        key = parent, segment
        if key not in self._ids:
            self._ids[key] = len(self._segments)
            length = self._lengths[parent] + 1 + len(segment)
            digest = blake2b(f"{self.path(parent)}/{segment}".encode(errors="replace"), digest_size=16).hexdigest() if length > PATH_CHARS else ""
            self._path_parents.append(parent)
            self._segments.append(segment)
            self._lengths.append(length)
            self._digests.append(digest)
        return self._ids[key]

    def path(self, p: int) -> str:
        """A path as text: all its segments, or the digest of a long one."""
        if self._digests[p]:
            return "~" + self._digests[p]
        out = []
        while p > 0:
            out.append(self._segments[p])
            p = self._path_parents[p]
        return "".join("/" + x for x in reversed(out))

    def _read(self, source: str) -> None:
        stack: list[tuple[str, int]] = []
        opened: Counter[str] = Counter()
        parts: list[str] = []
        linked, links, here, muted = 0, 0, 0, False
        hush: list | None = None  # of a marked inline element: tag, how often it is open, elements around it

        def close_block() -> None:
            nonlocal linked, muted
            if parts:
                text = " ".join("".join(parts).split())
                if text and not muted:
                    self.runs.append((here, text, linked))
                parts.clear()
            linked, muted = 0, False

        def add(raw: str) -> None:
            nonlocal linked
            if raw and not hush:
                text = entities.unescape(raw) if "&" in raw else raw
                parts.append(text)
                if links:
                    linked += len(text.strip())

        def close_to(depth: int) -> None:
            nonlocal here, links, hush
            here = stack[depth][1]
            for name, _ in stack[depth:]:
                opened[name] -= 1
            del stack[depth:]
            links = 0
            if hush and hush[2] > depth:
                hush = None

        at = 0
        for m in _MARKUP.finditer(source):
            add(source[at : m.start()])
            at = m.end()
            tag = m["tag"]
            if tag is None:
                continue
            tag = tag.lower()
            if tag not in _BLOCKS and tag not in _NEVER:
                if tag == "a":
                    links = 0 if m["end"] else 1
                if hush:
                    if tag == hush[0]:
                        hush[1] += -1 if m["end"] else 1
                        hush = hush if hush[1] else None
                elif m["attrs"] and not m["end"] and tag not in _VOID and _names(m["attrs"])[1] == 2:
                    hush = [tag, 1, len(stack)]
                continue
            was = muted
            close_block()
            if tag in _VOID:
                muted = was
                continue
            if m["end"]:
                # An end tag closes the innermost element of its name, and what that holds.
                if opened[tag]:
                    close_to(next(d for d in range(len(stack) - 1, -1, -1) if stack[d][0] == tag))
                elif tag not in _CONTAINERS and hush and hush[2] == len(stack):
                    hush = None  # the paragraph that it began in is over
            elif tag in _CONTAINERS or tag in _NEVER:
                if stack and stack[-1][0] in _ENDS.get(tag, ()):
                    close_to(len(stack) - 1)
                classes, mark = _names(m["attrs"]) if m["attrs"] else ("", 0)
                if tag in ("html", "body") or tag in _MAIN:
                    mark = 0
                if tag in _NEVER and not (tag == "header" and opened["article"]):
                    mark = 2
                segment = tag + "".join("." + c for c in sorted(_DIGITS.sub("#", classes).lower().split()))
                stack.append((tag, here))
                opened[tag] += 1
                self.tags.append(tag)
                self.path_of.append(self._path(self.path_of[here], segment))
                self.parents.append(here)
                self.other.append(max(self.other[here], mark))
                here = len(self.tags) - 1
            elif m["attrs"]:  # a paragraph or the like; what it says of itself holds until the next block
                muted = _names(m["attrs"])[1] > 0
        add(source[at:])
        close_block()

    def _spread(self, keep: frozenset[str]) -> list[int]:
        """Of each container, itself or the nearest around it whose tag is not in ``keep``."""
        out = [0] * len(self.tags)
        for c in range(1, len(self.tags)):
            out[c] = out[self.parents[c]] if self.tags[c] in keep else c
        return out

    def _scores(self) -> dict[int, float]:
        out: dict[int, float] = {}
        base = self._spread(_PARTS)
        for c, text, linked in self.runs:
            if self.other[c] > self.most:
                continue
            score = max(0.0, len(text) - 2.0 * linked) * (1.0 if len(text) > 25 else 0.25)
            for share in (1.0, 0.5):
                c = base[c]
                p = self.path_of[c]
                out[p] = out.get(p, 0.0) + score * share * (1.5 if self.tags[c] in _MAIN else 1.0)
                c = self.parents[c]
                if c < 0:
                    break
        return {p: s for p, s in out.items() if s > 0}

    def scores(self) -> dict[str, float]:
        """For each path, the running text that its containers hold directly, and half of what their children do."""
        return {self.path(p): s for p, s in self._scores().items()}

    def _around(self, path: int) -> set[int]:
        """The containers with this path, each widened to the article that it is in: the nearest article or main element, else the nearest below the body that holds further running text."""
        n = len(self.tags)
        held, main, wider = [0] * n, [0] * n, [0] * n
        for c, text, linked in self.runs:
            if self.other[c] <= self.most:
                held[c] += len(text) > 2 * linked
        for c in range(n - 1, 0, -1):
            held[self.parents[c]] += held[c]
        out = set()
        for c in range(n):
            if c:
                a = self.parents[c]
                main[c] = c if self.tags[c] in _MAIN else main[a]
                wider[c] = a if self.tags[a] in _BODY or held[a] != held[c] else wider[a]
            if self.path_of[c] == path and self.other[c] <= self.most:
                a = wider[c]
                out.add(main[c] or (c if self.tags[c] in _BODY or self.tags[a] in _BODY else a))
        return out

    def _inside(self, path: int) -> str:
        roots = self._around(path)
        inside = [False] * len(self.tags)
        for c in range(len(self.tags)):
            inside[c] = self.other[c] <= self.most and (c in roots or (c > 0 and inside[self.parents[c]]))
        return " ".join(t for c, t, _ in self.runs if inside[c])

    def text(self, path: str | None) -> str:
        """What the articles around the containers with this path hold, in page order; on a page where that is nothing, those around the best of its own paths."""
        if path is not None:
            own = next((p for p in range(len(self._segments)) if (self._digests[p] or path.endswith(self._segments[p])) and self.path(p) == path), None)
            if own is not None and (found := self._inside(own)):
                return found
        scores = self._scores()
        return self._inside(max(scores, key=lambda p: (scores[p], self.path(p)))) if scores else ""


def host_of(url: str = "url") -> Column:
    """Lower-case host of a URL, without port; empty if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        hosts, paths, shares = [], [], []
        for host, source in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            scores = Page(source).scores()
            total = sum(scores.values())
            for path, s in scores.items():
                hosts.append(host)
                paths.append(path)
                shares.append(s / total)
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(shares, pa.float64())], names=["host", "path", "share"])


def _extracts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [Page(source).text(path) for source, path in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), b.column(3)], names=["page_id", "url", "text", "n_chars", "path"])


def host_paths(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``(host, path, share double)``: the path that each host's pages vote for.

    A page's vote is split by its scores.  Votes are summed before the shuffle, so
    a host with any number of pages is one row for each path and task.  Ties go
    to the longer, then the greater path.
    """
    ballots = pages.where(F.length(html) > 0).select(host_of(url).alias("host"), F.col(html).alias("html")).transform(map_batches, _votes, "host string, path string, share double")
    summed = ballots.groupBy("host", "path").agg(F.round(F.sum("share"), 6).alias("share"))
    best = summed.groupBy("host").agg(F.max(F.struct("share", F.length("path").alias("n"), "path")).alias("best"))
    return best.select("host", F.col("best.path").alias("path"), F.col("best.share").alias("share"))


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``(page_id, url, text, n_chars long, path)``, one row for each page.

    Null, empty and text-free pages have an empty text; a null or unreadable URL
    belongs to the nameless host; broken markup is read as far as it goes;
    repeated rows give repeated results; pages of any length are read whole; an
    empty table gives no rows; other columns are not read.  ``path`` is the
    host's winner (null on a host without any).  Elements go by whole words of
    class, id and role, not by words that tell of a state (``has-sidebar``), and
    by names of layouts only where most of the page has no such name.
    """
    winners = materialize(host_paths(pages, url, html), "host-paths").select("host", "path")
    source = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"), host_of(url).alias("host"))
    joined = attach(source, winners, ["host"], rows=50_000).select("page_id", "url", "html", "path")
    kinds = ", ".join(f"{c} {joined.schema[c].dataType.simpleString()}" for c in ("page_id", "url"))
    return joined.transform(map_batches, _extracts, f"{kinds}, text string, n_chars long, path string")
