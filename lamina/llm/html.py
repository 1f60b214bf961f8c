"""Main text of web pages by site template removal.

Pass 1 parses every page and hashes its element subtrees (tags and text, no
attributes).  Spark counts, for each host, in how many different contexts a
subtree occurs; one that recurs on many pages of the host is template.  Pass 2
parses again, deletes template subtrees and whatever names itself as no part
of the article (menus, forms, notices, ...: by element, role, class or id), and
writes the blocks of what is left of the article.

Paragraphs inside an article are never template: passages that pages share and
copies of whole articles are text.  Outside an article each subtree counts once
per page content.  Inside it, and on pages that mark no article, only containers
count, by the text of the article around them: SALTS min-hashes of its word shingles each have to take many values,
so near copies of an article, which share most shingles, do not make what they
share a template.
"""

from __future__ import annotations

import bisect
import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.llm.common import materialize
from lamina.llm.urls import host_of

#: A subtree is template if it has at least MANY contexts on its host.
MANY = 4
#: Min-hashes of an article's text around a container, and words of a shingle.
SALTS, WORDS = 8, 3
#: Templates that may be sent to all tasks (some 100 bytes each).
MOST_SENT = 300_000

#: Element kinds.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre "
    "section summary table tbody td tfoot th thead title tr ul caption".split()
)
HEAD = frozenset("base basefont bgsound link meta title style script noscript template".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: Elements that are never part of an article's text.
DROPPED = frozenset(
    "script style noscript template head title nav aside footer form button input select option textarea label fieldset legend iframe object embed applet svg canvas audio video map menu dialog "
    "xmp noembed noframes datalist".split()
)
#: Start tags that end an open element: tag -> elements that it closes, and where the search for them stops.
CLOSES = {
    "li": ("li", ("ul", "ol", "menu", "dir")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")),
    "thead": ("thead tbody tfoot tr td th", ("table",)), "tbody": ("thead tbody tfoot tr td th", ("table",)), "tfoot": ("thead tbody tfoot tr td th", ("table",)), "option": ("option", ("select",)),
}
#: Words of a class, id or role that name something else than the article.
NAMES = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense adbox adslot banner sponsor sponsors sponsored promo promos promotion promotions cookie cookies consent gdpr notice notices "
    "notification notifications alert newsletter newsletters subscribe subscription signup sidebar sidebars menu menus navbar navigation nav breadcrumb breadcrumbs share sharing social comment comments "
    "commentlist disqus respond reply replies related recommended recommendations popup popups modal overlay widget widgets toolbar pagination pager login search skiplink masthead footer copyright "
    "complementary contentinfo dialog teaser teasers paywall".split()
)
#: Words that place or shape a named part.
PLACES = frozenset("area bar block bottom box button buttons column container content footer form group header icons inline inner item items left link links list outer posts right row section title top wrap wrapper".split())
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt figcaption td th".split())
CONTAINERS = frozenset("div section ul ol dl table details figure header center article address".split())

_token = re.compile(r"<!--(?:.*?-->|.*)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']+|\"[^\"]*\"|'[^']*'|[\"'])*)>?|<[!?/][^>]*>?", re.S)
_attribute = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_split = re.compile(r"[^A-Za-z0-9]+|(?<=[a-z0-9])(?=[A-Z])")
_raw_end = {tag: re.compile(rf"</{tag}(?=[\s/>]|$)", re.I) for tag in RAW}
_text_raw = frozenset({"textarea", "title"})


class Page:
    """A parsed page: elements in document order, and events (element started, text, ~element ended)."""

    def __init__(self, source: str) -> None:
        self.tags: list[str] = []
        self.parents: list[int] = []
        self.raw: list[str] = []
        self.events: list[int | str] = []
        self._parse(source)

    def _parse(self, source: str) -> None:
        tags, events, stack = self.tags, self.events, []
        self._stack = stack
        self._open: dict[str, list[int]] = {}  # depths of the open elements of each tag
        self._blocks: list[int] = []  # depths of the open blocks
        at, size = 0, len(source)
        while at < size:
            found = _token.search(source, at)
            if not found:
                events.append(source[at:])
                break
            if found.start() > at:
                events.append(source[at : found.start()])
            at = found.end()
            name = found[2]
            if not name:
                continue
            tag = name.lower()
            if found[1]:
                self._end(tag)
                continue
            self._imply(tag)
            self.parents.append(stack[-1] if stack else -1)
            element = len(tags)
            tags.append(tag)
            self.raw.append(found[3])
            events.append(element)
            if tag in VOID or (found[3].endswith("/") and tag not in BLOCK and tag not in RAW):
                events.append(~element)
            elif tag in RAW:
                stop = _raw_end[tag].search(source, at)
                end = stop.start() if stop else size
                if tag in _text_raw:
                    events.append(source[at:end])
                events.append(~element)
                at = end
            else:
                self._open.setdefault(tag, []).append(len(stack))
                if tag in BLOCK:
                    self._blocks.append(len(stack))
                stack.append(element)
        self._pop(0)

    def _pop(self, depth: int) -> None:
        while len(self._stack) > depth:
            element = self._stack.pop()
            self._open[self.tags[element]].pop()
            if self._blocks and self._blocks[-1] == len(self._stack):
                self._blocks.pop()
            self.events.append(~element)

    def _imply(self, tag: str) -> None:
        """Ends the elements that a start tag ends; open elements are found by tag, so deep nesting costs nothing."""
        stack, tags, open_ = self._stack, self.tags, self._open
        if tag not in HEAD and tag != "html" and open_.get("head"):
            self._pop(open_["head"][0])
        if tag in ("article", "main", "body"):  # a menu or the like that nobody closed
            outer = min((at[0] for kind, at in open_.items() if at and (kind in DROPPED or kind == "header")), default=len(stack))
            self._pop(outer)
        if tag in BLOCK:
            if self._blocks and tags[stack[self._blocks[-1]]] == "p":
                self._pop(self._blocks[-1])
            if tag in HEADINGS and stack and tags[stack[-1]] in HEADINGS:
                self._pop(len(stack) - 1)
        if tag in CLOSES:
            closed, stops = CLOSES[tag]
            stop = max((open_[kind][-1] for kind in stops if open_.get(kind)), default=-1)
            lowest = len(stack)
            for kind in closed.split():
                at = open_.get(kind, [])
                first = bisect.bisect_right(at, stop)
                if first < len(at):
                    lowest = min(lowest, at[first])
            self._pop(lowest)

    def _end(self, tag: str) -> None:
        at = self._open.get(tag)
        if at and (tag in BLOCK or not self._blocks or self._blocks[-1] < at[-1]):
            self._pop(at[-1])

    def attributes(self, element: int) -> dict[str, str]:
        raw = self.raw[element]
        return {k.lower(): html.unescape((v or "").strip("\"'")) for k, v in _attribute.findall(raw)} if raw.strip(" /\t\r\n") else {}

    def named(self, element: int, large: bool = False, inside: bool = False) -> bool:
        """Whether role, class, id or hiding says that the element is no part of the article.

        Of a large element (most of the text) a third of the words has to say so.  Inside an article an id
        counts as a whole only, as slugs of headings are ids; of headings and paragraphs it never counts, and
        their classes and roles count as wholes; any other class counts if all its words name or place a part.
        """
        if not self.raw[element].strip(" /\t\r\n"):
            return False
        own = self.attributes(element)
        if "hidden" in own or own.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", own.get("style", ""), re.I):
            return True
        if not inside:
            words = {w.lower() for key in ("class", "id", "role") for w in _split.split(own.get(key, "")) if w}
        elif self.tags[element] in PARAGRAPHS or self.tags[element] in HEADINGS:
            words = {w.lower() for key in ("class", "role") for w in own.get(key, "").split()}
        else:
            parts = [[w.lower() for w in _split.split(token) if w] for key in ("class", "role") for token in own.get(key, "").split()]
            words = {w for token in parts if all(w in NAMES or w in PLACES for w in token) for w in token} | ({own["id"].lower()} if own.get("id") else set())
        hits = len(words & NAMES)
        return hits > 0 and (not large or 3 * hits >= len(words))

    def roots(self) -> list[int]:
        """The outermost articles that no dropped element holds; else the mains; else none (what is left of the whole page counts)."""
        tags, parents = self.tags, self.parents
        bad = [False] * len(tags)
        inside = {"article": [False] * len(tags), "main": [False] * len(tags)}
        found: dict[str, list[int]] = {"article": [], "main": []}
        for element, tag in enumerate(tags):
            up = parents[element]
            if up >= 0:
                bad[element] = bad[up]
                for kind in inside:
                    inside[kind][element] = inside[kind][up]
            if tag in DROPPED:
                bad[element] = True
            kind = "article" if tag == "article" else "main" if tag == "main" or ("main" in self.raw[element] and self.attributes(element).get("role") == "main") else None
            if kind and not bad[element] and not inside[kind][element] and not self.named(element):
                found[kind].append(element)
                inside[kind][element] = True
        return found["article"] or found["main"]

    def spans(self) -> list[int]:
        """For each element, the number of the first element after its subtree."""
        ends = [0] * len(self.tags)
        for event in self.events:
            if not isinstance(event, str):
                if event >= 0:
                    seen = event + 1
                else:
                    ends[~event] = seen
        return ends

    def hashes(self) -> tuple[list[int], list[int]]:
        """Hash of each element's subtree, and length of its text; white space and attributes do not count."""
        out, lengths = [0] * len(self.tags), [0] * len(self.tags)
        digests: list[xxhash.xxh3_64] = []
        sizes: list[int] = []
        for event in self.events:
            if isinstance(event, str):
                text = " ".join(event.split())
                if text and digests:
                    digests[-1].update(text.encode("utf-8", "surrogatepass") + b"\x00")
                    sizes[-1] += len(text)
            elif event >= 0:
                digests.append(xxhash.xxh3_64(self.tags[event].encode("utf-8", "surrogatepass") + b"\x01"))
                sizes.append(0)
            else:
                digest, size = digests.pop(), sizes.pop()
                out[~event], lengths[~event] = digest.intdigest(), size
                if digests:
                    digests[-1].update(digest.digest())
                    sizes[-1] += size
        return out, lengths


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


_mixers = np.random.default_rng(7).integers(0, 1 << 63, SALTS, np.uint64) * np.uint64(2) + np.uint64(1)


def _around(page: Page, wanted: list[int], inside: np.ndarray) -> dict[int, list[int]]:
    """For each wanted element inside the article, min-hashes of the article's text outside its subtree; zeros without such text."""
    words: list[str] = []
    begin, end = [0] * len(page.tags), [0] * len(page.tags)
    stack: list[int] = []
    for event in page.events:
        if isinstance(event, str):
            if stack and inside[stack[-1]] and page.tags[stack[-1]] not in RAW:
                words += event.split()
        elif event >= 0:
            begin[event] = len(words)
            stack.append(event)
        else:
            end[~event] = len(words)
            stack.pop()

    text = lambda some: xxhash.xxh3_64_intdigest(" ".join(some).encode("utf-8", "surrogatepass"))
    raw = np.array([text(words[at : at + WORDS]) for at in range(len(words) - WORDS + 1)], np.uint64)
    mixed = raw[:, None] * _mixers
    mixed = (mixed ^ (mixed >> np.uint64(31))) * _mixers
    ahead, behind = np.minimum.accumulate(mixed, axis=0), np.minimum.accumulate(mixed[::-1], axis=0)[::-1]
    out = {}
    for element in wanted:
        first, last = begin[element], end[element]
        sides = [ahead[first - WORDS]] if first >= WORDS else []
        sides += [behind[last]] if len(words) - last >= WORDS else []
        few = words[:first] + words[last:] if not sides else []
        out[element] = [int(x) for x in np.min(sides, axis=0)] if sides else [text(few) if few else 0] * SALTS
    return out


def candidates(source: str) -> list[tuple[int, int, int]]:
    """(subtree hash, salt, context hash) of the elements of a page that may be template; salt 0 outside the article.

    On a page without an article the whole page is taken for one: what its containers say is told from the
    article by the count alone.
    """
    page = Page(source)
    if not page.tags:
        return []
    hashes, lengths = page.hashes()
    ends, roots = page.spans(), page.roots()
    inside, holds = np.zeros(len(page.tags), bool), np.zeros(len(page.tags), bool)
    for root in roots:
        inside[root : ends[root]] = True
        up = root
        while up >= 0 and not holds[up]:
            holds[up], up = True, page.parents[up]
    held = inside.copy()
    inside[roots] = False
    if not roots:
        held[:] = inside[:] = True
    content = xxhash.xxh3_64_intdigest(b"".join(hashes[root].to_bytes(8, "little") for root in roots))
    rows, within = set(), []
    for element, tag in enumerate(page.tags):
        if holds[element] or not lengths[element] or tag not in BLOCK or tag in ("html", "head", "body", "title"):
            continue
        if not inside[element]:
            rows.add((_signed(hashes[element]), 0, _signed(content)))
        elif tag in CONTAINERS:
            within.append(element)
    if within:
        for element, values in _around(page, within, held).items():
            rows.update((_signed(hashes[element]), salt, _signed(value)) for salt, value in enumerate(values, 1))
    return list(rows)


def main_text(source: str | None, templates: frozenset[int] | set[int] = frozenset()) -> str:
    """The blocks of the article, two line feeds between them; `templates` are subtree hashes of the page's host.

    Null, empty and text-free pages give an empty text, pages without elements their text.  Markup that
    nobody closed ends where its parent does.
    """
    if not source:
        return ""
    page = Page(source)
    if not page.tags:
        return " ".join(html.unescape("".join(page.events)).split())
    roots, ends = set(page.roots()), page.spans()
    hashes, lengths = page.hashes()
    gone, linked = [False] * len(page.tags), [0] * len(page.tags)
    inside = np.zeros(len(page.tags), bool)
    for root in roots:
        inside[root : ends[root]] = True
    heads = np.concatenate([[0], np.cumsum([tag in HEADINGS for tag in page.tags])])
    if not roots:
        for element in range(len(page.tags) - 1, -1, -1):
            if page.tags[element] == "a":
                linked[element] = lengths[element]
            if page.parents[element] >= 0:
                linked[page.parents[element]] += linked[element]
    holder = max(1, sum(lengths[root] for root in roots))
    total = max(1, max(lengths[0], sum(lengths[e] for e, up in enumerate(page.parents) if up < 0)))
    for element, tag in enumerate(page.tags):
        up = page.parents[element]
        if up >= 0 and gone[up]:
            gone[element] = True
            continue
        if element in roots or (roots and not inside[element]):
            continue
        recurs = tag in CONTAINERS and _signed(hashes[element]) in templates
        if tag in DROPPED or recurs:
            gone[element] = True
        elif roots:
            gone[element] = page.named(element, lengths[element] > holder / 2, inside=True) or (tag == "header" and heads[ends[element]] == heads[element + 1])
        elif tag not in ("html", "body"):
            most = lengths[element] > total / 2
            menu = tag in CONTAINERS and lengths[element] and linked[element] > 0.6 * lengths[element]
            gone[element] = tag == "header" or (not most and (page.named(element) or menu))
    blocks: list[str] = []
    held: list[str] = []
    kept = 0 if roots else 1

    def flush() -> None:
        if held:
            text = " ".join("".join(held).split())
            if text:
                blocks.append(text)
            held.clear()

    stack: list[int] = []
    for event in page.events:
        if isinstance(event, str):
            if kept and not (stack and gone[stack[-1]]):
                held.append(html.unescape(event) if "&" in event else event)
        elif event >= 0:
            tag = page.tags[event]
            kept += event in roots
            if kept and tag in BLOCK:
                flush()
            elif tag in ("br", "wbr", "img", "hr"):
                held.append(" " if tag != "wbr" else "")
            stack.append(event)
        else:
            if kept and page.tags[~event] in BLOCK:
                flush()
            kept -= ~event in roots
            stack.pop()
    flush()
    return "\n\n".join(blocks)


def templates_of(pages: DataFrame) -> DataFrame:
    """host, hash: the template subtrees of each host, from all pages (host, html).

    Contexts are counted in two steps, so that neither a host nor a subtree with a third of all rows meets
    in one task; the least count is the same on every host, and tables too large to broadcast are joined.
    """

    def emit(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for at in range(0, part.num_rows, 512):
                hosts, found = part.column(0).slice(at, 512), [candidates(x) if x else [] for x in part.column(1).slice(at, 512).to_pylist()]
                index = np.repeat(np.arange(len(found)), [len(x) for x in found])
                yield pa.RecordBatch.from_pydict(
                    {"host": hosts.take(pa.array(index)), "hash": pa.array([h for rows in found for h, _, _ in rows], pa.int64()), "salt": pa.array([s for rows in found for _, s, _ in rows], pa.int32()), "context": pa.array([c for rows in found for _, _, c in rows], pa.int64())}
                )

    rows = pages.select("host", "html").mapInArrow(emit, "host string, hash long, salt int, context long")
    counts = rows.distinct().groupBy("host", "hash", "salt").agg(F.count("*").alias("contexts")).where(F.col("contexts") >= MANY)
    return counts.groupBy("host", "hash").agg(F.count_if(F.col("salt") == 0).alias("out"), F.count_if(F.col("salt") > 0).alias("in")).where(f"out > 0 or in = {SALTS}").select("host", "hash")


def extract(pages: DataFrame, broadcast_rows: int = MOST_SENT) -> DataFrame:
    """page_id, url, text, n_chars: one row per row of `pages` (page_id, url, html).

    Up to `broadcast_rows` templates are sent to all tasks, more are joined to their pages, with the same result.

    text is empty for null, empty or text-free pages, n_chars counts its code points; pages without a host
    share the host "".  Null ids and urls stay null, repeated rows are extracted each, an empty table gives
    no rows.  Pages are read whole.  Other columns are ignored.
    """
    rows = pages.select("page_id", "url", F.col("html").cast("string").alias("html"), host_of(F.col("url").cast("string")).alias("host"))
    templates = materialize(templates_of(rows), "html-templates")
    few = templates.toArrow() if templates.count() <= broadcast_rows else None
    if few is not None:
        known: dict[str, set[int]] = {}
        for host, value in zip(few.column(0).to_pylist(), few.column(1).to_pylist(), strict=True):
            known.setdefault(host, set()).add(value)
        shared = pages.sparkSession.sparkContext.broadcast(known)

        @F.arrow_udf("string")
        def written(sources: pa.Array, hosts: pa.Array) -> pa.Array:
            return pa.array([main_text(x, shared.value.get(h, frozenset())) for x, h in zip(sources.to_pylist(), hosts.to_pylist(), strict=True)], pa.string())

        texts = rows.withColumn("text", written("html", "host"))
    else:
        texts = _by_page(rows, templates)
    return texts.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def _by_page(rows: DataFrame, templates: DataFrame) -> DataFrame:
    """As many templates as may not be broadcast reach their pages by a join: each page meets those it contains."""

    def emit(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            found = [{h for h, _, _ in candidates(x)} if x else set() for x in part.column(2).to_pylist()]
            index = pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found]))
            yield pa.RecordBatch.from_pydict({"host": part.column(0).take(index), "page": part.column(1).take(index), "hash": pa.array([h for x in found for h in x], pa.int64())})

    keyed = rows.withColumn("page", F.md5(F.coalesce("html", F.lit("")).cast("binary")))
    own = keyed.select("host", "page", "html").mapInArrow(emit, "host string, page string, hash long").join(templates, ["host", "hash"], "left_semi")
    hits = own.groupBy("host", "page").agg(F.collect_set("hash").alias("hits"))

    @F.arrow_udf("string")
    def written(sources: pa.Array, own_hits: pa.Array) -> pa.Array:
        return pa.array([main_text(x, frozenset(h or ())) for x, h in zip(sources.to_pylist(), own_hits.to_pylist(), strict=True)], pa.string())

    return keyed.join(hits, ["host", "page"], "left").withColumn("text", written("html", "hits"))
