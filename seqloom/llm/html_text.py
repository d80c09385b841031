"""HTML main text by equivalence-class template deduction over the pages of a host.

1. Every page is cut into tokens: tags with their class, id and role, told apart by the path they stand on, and text
   nodes. A token's occurrence vector (its count in each different page of the host) is kept as a sum of hashes of (page,
   count), and its place as a sum of places, so that both are added up by a plain aggregate; a host's pages never meet in one
   task. Copies of a page count once.
2. Tokens of a host with equal vectors, present in most of its pages, form a class. A class is valid if it has several
   tokens, each once a page. The valid classes, in order of their mean places, are the host's template; on a page the longest
   run of its tokens that keeps that order is the frame (what stands out of order there nests in no class), and what lies between
   frame tokens are the slots.
3. Text of frame tokens is template text. The text in slots is added up by the template's elements around it; the core is the innermost
   element that holds CORE of a host's slot text. From there the article grows to the element around, short of body, while
   what that adds is not mostly links: so headings, leads and closing blocks beside the core belong to it, and slots elsewhere
   do not, whatever their names.
4. Each page is read again: the blocks with any text of their own inside the article, and a page's own h1, are its text. Names, roles and
   classes are further evidence: inside the article they tell scripts, forms, notices and reader comments from text.

Hosts of fewer than PAGES different pages have no template, nor have pages without the article's element; there names, roles and
classes decide alone: the elements that say so (article, main, articleBody), else all that is not marked.

The template of a host is bounded: a token must be in SHARE of the pages, so a host has at most mean tokens / SHARE of
them. Templates are broadcast while they are under TEMPLATE_ROWS rows, else joined by host, which splits large hosts by itself.

Defined cases: null or empty html gives an empty text; unclosed elements end with their parent, unclosed tags at the next one, an
unclosed quote is a letter of its tag; repeated rows get equal results; a null url is the host ""; character references are
decoded once, in each text node by itself; an empty table gives no rows; other columns are not read. Time is linear in the page.
"""

from __future__ import annotations

import html as _html
import re
from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, with_free_name, written

#: Part of a host's pages that have a template token, pages that a host needs for a template, and tokens of a valid class.
SHARE, PAGES, CLASS = 0.6, 5, 2
#: Part of a host's slot text that its core holds, and part of what a larger article adds that may be links.
CORE, LINKS = 0.75, 0.5
TEMPLATE_ROWS = 100_000
#: A task sends its counts on when it holds so many tokens.
HELD = 200_000
#: Bits of the bitmap that tells pages with copies.
COPY_BITS = 1 << 20

BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp template".split())
DROPPED = frozenset("script style noscript template head title nav footer aside form button select option textarea input label iframe object embed svg math canvas audio video menu dialog noembed noframes search".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert dialog alertdialog form menu menubar toolbar tablist".split())
#: Words of a class or id that mark what is not the article.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adbox adsense adslot banner banners breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright disclaimer disqus footer gdpr header masthead menu menus modal nav navbar navigation newsletter notice notices overlay paywall popup promo promos promotion recommended related replies reply respond share sharing sidebar sidebars signup skip social sponsor sponsored sponsors subscribe subscription toolbar topbar widget widgets".split()
)
#: Words that speak for the article, where only weaker marks speak against it; and marks that always count.
ARTICLE_WORDS = frozenset("article articlebody body content entry main post story text".split())
COMMENTS = frozenset("comment comments commentlist disqus replies respond ad ads advert adverts advertisement sponsored".split())
#: What may end an open element of the same or another name when it starts.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("article aside body div footer header html main nav ol section table td th tr ul form blockquote dl".split())


_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z](?:[^<>\"']|\"[^\"]*\"|'[^']*'|[\"'])*+(?:>|(?=<)|\Z)|[^<]+|<", re.S)
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_ATTR = re.compile(r"([a-zA-Z_:][-\w:.]*)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


def _attributes(tag: str) -> dict[str, str]:
    return {m[1].lower(): _html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(tag, _NAME.match(tag).end())}


class Element:
    __slots__ = ("name", "chain", "token", "parent", "dropped", "article", "inside", "linked", "at", "plain", "link")

    def __init__(self, name: str, tag: str, parent: Element | None):
        self.name, self.parent = name, parent
        own = _attributes(tag) if "=" in tag else {}
        words = {w.lower() for a in ("class", "id") for w in _WORD.findall(own.get(a, ""))}
        base = parent.chain if parent is not None else "-"
        self.chain = xxhash.xxh64_hexdigest(f"{base}/{name}")
        key = " ".join([name, own.get("class", ""), own.get("id", ""), own.get("role", "")]).strip()
        self.token = _hash("tag", base, key)
        within = parent is not None and parent.article
        says = name in ("article", "main") or own.get("itemprop", "").lower() == "articlebody"
        marks = words & MARKS
        marked = name not in ("html", "body") and (bool(marks & COMMENTS or marks and not words & ARTICLE_WORDS and not says) or own.get("role", "").lower() in ROLES or "hidden" in own or own.get("aria-hidden") == "true")
        self.dropped = bool(parent is not None and parent.dropped) or name in DROPPED or marked or (name == "header" and not within)
        self.article = within or (not self.dropped and (says or own.get("role", "").lower() in ("main", "article")))
        self.inside = False
        self.linked = name == "a" or (parent is not None and parent.linked)
        self.at, self.plain, self.link = -1, 0, 0


def tokens(page: str):
    """(kind, text, element) in page order: kind "open" and "close" for tags, "text" for text nodes in their element; what is inside raw elements is left out."""
    stack: list[Element] = []
    opened: Counter[str] = Counter()
    at, n = 0, len(page)

    def leave():
        opened[stack[-1].name] -= 1
        stack.pop()

    while at < n:
        m = _TOKEN.match(page, at)
        part = m[0]
        at = m.end()
        if part[0] != "<" or part == "<":
            yield "text", part, stack[-1] if stack else None
            continue
        if part[1] in "!?":
            if part.startswith("<![CDATA["):
                yield "text", part[9:].removesuffix("]]>"), stack[-1] if stack else None
            continue
        name = _NAME.match(part)[1].lower()
        if part[1] == "/":
            depth = -1
            if opened[name] > 0:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i].name == name:
                        depth = i
                        break
                    if stack[i].name in SCOPES and name not in SCOPES:
                        break
            if depth >= 0:
                while len(stack) > depth:
                    yield "close", stack[-1].name, stack[-1]
                    leave()
            elif name in BLOCKS:
                yield "stray", name, None
            continue
        ends = {"p", *CLOSES.get(name, ())} if name in BLOCKS else CLOSES.get(name, ())
        if any(opened[e] > 0 for e in ends):
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].name in ends:
                    while len(stack) > i:
                        yield "close", stack[-1].name, stack[-1]
                        leave()
                    break
                if stack[i].name in SCOPES:
                    break
        stack.append(Element(name, part, stack[-1] if stack else None))
        opened[name] += 1
        yield "open", name, stack[-1]
        if name in VOID or part.endswith("/>") and name not in BLOCKS:
            yield "close", name, stack[-1]
            leave()
        elif name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else n
            yield "close", name, stack[-1]
            leave()
    while stack:
        yield "close", stack[-1].name, stack[-1]
        leave()


def _hash(*parts: str) -> int:
    """64 bits, signed."""
    h = xxhash.xxh64_intdigest("\x00".join(parts).encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >> 63 else h


def _text_token(what: str) -> int | None:
    t = " ".join(what.split())
    return _hash("text", t) if t else None


def page_tokens(events) -> list[tuple[int, bool]]:
    """Hashed tokens of a page (its text, or its events) in order, and whether each is a tag."""
    out = []
    for kind, what, top in tokens(events) if isinstance(events, str) else events:
        if kind == "open":
            out.append((top.token, True))
        elif kind == "text" and (h := _text_token(what)) is not None:
            out.append((h, False))
    return out


def _counts(pages: DataFrame) -> DataFrame:
    """(host, token, tag, pages, count, places, low, high): sums over this task's pages; low and high are the halves of the sum of hash(page, count)."""
    names = ["host", "token", "tag", "pages", "count", "places", "low", "high"]

    def run(batches):
        held: dict[tuple[str, int], list[int]] = {}

        def send():
            values = list(held.values())
            cols = [pa.array([k[0] for k in held], pa.string()), pa.array([k[1] for k in held], pa.int64()), pa.array([v[0] for v in values], pa.bool_())]
            cols += [pa.array([v[i] for v in values], pa.int64()) for i in (1, 2, 3)]
            cols += [pa.array([(v[4] >> s) & 0xFFFFFFFF for v in values], pa.int64()) for s in (0, 32)]
            held.clear()
            return pa.RecordBatch.from_arrays(cols, names)

        for b in batches:
            for host, page in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                page = page.as_py() or ""
                name = str(_hash(page))
                found = page_tokens(page)
                times = Counter(h for h, _ in found)
                first = {}
                for i, (h, tag) in enumerate(found):
                    first.setdefault(h, (i, tag))
                for h, (i, tag) in first.items():
                    v = held.setdefault((host, h), [tag, 0, 0, 0, 0])
                    v[1] += 1
                    v[2] += times[h]
                    v[3] += (i << 20) // len(found)  # a place in the page, whatever its length
                    v[4] = (v[4] + _hash(name, str(times[h]))) & 0xFFFFFFFFFFFFFFFF
                if len(held) > HELD:
                    yield send()
        yield send()

    return pages.mapInArrow(lean(run), "host string, token long, tag boolean, pages long, count long, places long, low long, high long")


def different(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(host, html) of each different page once, and (host, size): how many there are. Only pages that may have copies, by a bitmap of fixed size, are dealt out to find them."""
    keyed = pages.select("host", "html", F.xxhash64("html").alias("h"))
    counts = keyed.groupBy("host", "h").agg(F.count(F.lit(1)).alias("n"))
    size = counts.groupBy("host").agg(F.count(F.lit(1)).alias("size"))
    bit = F.pmod(F.xxhash64("host", "h"), F.lit(COPY_BITS))
    words = counts.where("n > 1").groupBy(F.floor(bit / 64).cast("int").alias("i")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(bit, F.lit(64)).cast("int"))).alias("b"))
    held = {r.i: r.b for r in words.collect()}  # COPY_BITS / 64 rows at most
    if not held:
        return pages.select("host", "html"), size
    bitmap = F.expr(f"from_json('[{','.join(str(held.get(i, 0)) for i in range(COPY_BITS // 64))}]', 'array<bigint>')")
    copied = F.call_function("shiftright", F.get(bitmap, F.floor(bit / 64).cast("int")), F.pmod(bit, F.lit(64)).cast("int")).bitwiseAND(F.lit(1)) == 1
    marked = keyed.withColumn("copied", copied)
    once = marked.where("copied").dropDuplicates(["host", "h"])
    return marked.where("not copied").select("host", "html").unionByName(once.select("host", "html")), size


def templates(pages: DataFrame) -> DataFrame:
    """(host, template): the tokens of each host's valid classes in order, as (token, tag)."""
    once, size = different(pages)
    summed = _counts(once).groupBy("host", "token").agg(F.first("tag").alias("tag"), *[F.sum(c).alias(c) for c in ("pages", "count", "places", "low", "high")])
    frequent = summed.join(size, "host").where((F.col("size") >= PAGES) & (F.col("pages") >= SHARE * F.col("size")) & (F.col("count") == F.col("pages")))
    one = F.struct((F.col("places") / F.col("pages")).alias("place"), "token", "tag")
    classes = frequent.groupBy("host", "pages", "low", "high").agg(F.count(F.lit(1)).alias("k"), F.collect_list(one).alias("v")).where(F.col("k") >= CLASS)
    ordered = F.array_sort(F.flatten(F.collect_list("v")))
    return classes.groupBy("host").agg(F.transform(ordered, lambda x: F.struct(x["token"].alias("token"), x["tag"].alias("tag"))).alias("template"))


class Template:
    """A host's template: places of its tokens, and the place of the article's element (None: not known)."""

    def __init__(self, found: list[tuple[int, bool]] = (), article: int | None = None):
        self.place = {token: i for i, (token, _) in enumerate(found)}
        self.article = article

    def frame(self, page: list[tuple[int, bool]]) -> dict[int, int]:
        """Of a page's tokens those of the frame, token to place: the longest run in the template's order of tokens that stand there once."""
        times = Counter(h for h, _ in page)
        seen = [(self.place[h], h) for h, _ in page if h in self.place and times[h] == 1]
        tails: list[int] = []
        last: list[int] = []
        before: list[int] = []
        for i, (place, _) in enumerate(seen):
            k = bisect_left(tails, place)
            before.append(last[k - 1] if k else -1)
            tails[k : k + 1] = [place]
            last[k : k + 1] = [i]
        out, i = {}, last[-1] if last else -1
        while i >= 0:
            out[seen[i][1]] = seen[i][0]
            i = before[i]
        return out


def slot_sums(page: str, template: Template) -> list[tuple[int, int, int, int]]:
    """(place, plain, link, up) of each template element of a page: letters of its own text outside and inside links, and the template element around it short of body (-1: none)."""
    events = list(tokens(page))  # parsed once: for the frame, and then for the sums
    frame = template.frame(page_tokens(events))
    out = []
    for kind, what, top in events:
        if kind == "open":
            top.at = frame.get(top.token, -1)
        elif kind == "text" and top is not None and not top.dropped:
            h = _text_token(what)
            if h is not None and h not in frame:
                n = len("".join(what.split()))
                if top.linked:
                    top.link += n
                else:
                    top.plain += n
        elif kind == "close":
            around = top.parent
            if around is not None:
                around.plain += top.plain
                around.link += top.link
            if top.at >= 0:
                out.append((top.at, top.plain, top.link, around.at if around is not None and around.name not in ("body", "html") else -1))
    return out


def article_of(sums: list[tuple[int, int, int, int]]) -> int | None:
    """The place of the article's element from a host's sums (place, plain, link, up)."""
    by = {place: (plain, link, up) for place, plain, link, up in sums}
    every = max((v[0] for v in by.values()), default=0)
    if not every:
        return None
    at = max(place for place, v in by.items() if v[0] >= CORE * every)  # elements of more than half lie in each other
    while (up := by[at][2]) in by:
        plain, link = by[up][0] - by[at][0], by[up][1] - by[at][1]
        if plain + link and link > LINKS * (plain + link):
            break
        at = up
    return at


def main_text(page: str, template: Template | None = None) -> str:
    """The article of a page, a line for each block; by the template where there is one, by names without."""
    events = tokens(page) if template is None else list(tokens(page))
    frame = template.frame(page_tokens(events)) if template is not None else {}
    framed = template is not None and (template.article is None or template.article in frame.values())
    blocks: list[list] = []  # in an article by name, inside the template's, parts, whether any text is not the template's
    open_block = False
    for kind, what, top in events:
        if kind == "text":
            if top is not None and top.dropped and not (framed and template.article is None):
                continue
            if not open_block:
                blocks.append([bool(top and top.article), bool(top and top.inside), [], not framed])
                open_block = True
            blocks[-1][2].append(_html.unescape(what))
            if not blocks[-1][3] and (h := _text_token(what)) is not None:
                blocks[-1][3] = h not in frame
        elif kind == "open":
            if framed and template.article is not None:
                top.inside = (top.parent is not None and top.parent.inside) or what == "h1" or frame.get(top.token) == template.article
            if what in BLOCKS:
                open_block = False
            elif what == "br" and open_block:
                blocks[-1][2].append(" ")
        elif what in BLOCKS:
            open_block = False
    lines = [(a, i, own, t) for a, i, parts, own in blocks if (t := " ".join("".join(parts).split()))]
    if framed:
        return "\n".join(t for _, i, own, t in lines if own and (i or template.article is None))
    inside = any(a for a, _, _, _ in lines)
    return "\n".join(t for a, _, _, t in lines if a == inside)


def _with_templates(pages: DataFrame, known: DataFrame, rows: int) -> DataFrame:
    return pages.join(F.broadcast(known) if rows <= TEMPLATE_ROWS else known, "host", "left")


def _read(cell: pa.Scalar, article: int | None = None) -> Template | None:
    return Template([(x["token"], x["tag"]) for x in cell.as_py()], article) if cell.is_valid else None


def articles(pages: DataFrame, known: DataFrame, rows: int) -> DataFrame:
    """(host, template, article): the place of the article's element for each host with a template."""

    def sums(batches):
        held: dict[tuple[str, int], list[int]] = {}
        templates_: dict[str, Template] = {}
        for b in batches:
            for i, host in enumerate(b.column(0).to_pylist()):
                if host not in templates_:
                    templates_[host] = _read(b.column(2)[i])
                for place, plain, link, up in slot_sums(b.column(1)[i].as_py() or "", templates_[host]):
                    v = held.setdefault((host, place), [0, 0, -1])
                    held[host, place] = [v[0] + plain, v[1] + link, max(v[2], up)]
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in held], pa.string()), pa.array([k[1] for k in held], pa.int64()), *[pa.array([v[i] for v in held.values()], pa.int64()) for i in range(3)]], ["host", "place", "plain", "link", "up"])

    def choose(batches):
        for b in batches:
            chosen = [article_of([(x["place"], x["plain"], x["link"], x["up"]) for x in v]) for v in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(chosen, pa.int64())], ["host", "article"])

    framed = _with_templates(pages, known, rows).where("template is not null").select("host", "html", "template")
    summed = framed.mapInArrow(lean(sums), "host string, place long, plain long, link long, up long").groupBy("host", "place").agg(F.sum("plain").alias("plain"), F.sum("link").alias("link"), F.max("up").alias("up"))
    per = summed.groupBy("host").agg(F.collect_list(F.struct("place", "plain", "link", "up")).alias("v"))  # as long as the host's template
    return known.join(per.mapInArrow(choose, "host string, article long"), "host").where("article is not null")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    p = with_free_name(pages, "page_id", "url", "html").withColumn("host", F.lower(F.coalesce(F.regexp_extract("url", r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)", 1), F.lit(""))))
    known = written(templates(p.select("host", "html")), "templates")
    rows = known.agg(F.coalesce(F.sum(F.size("template") + 1), F.lit(0))).first()[0]
    known = written(articles(p.select("host", "html"), known, rows), "articles")

    def run(batches):
        held: dict[str, Template | None] = {}
        for b in batches:
            out = []
            for i, host in enumerate(b.column(3).to_pylist()):
                if host not in held:
                    if len(held) > 1000:
                        held.clear()
                    held[host] = _read(b.column(4)[i], b.column(5)[i].as_py())
                out.append(main_text(b.column(2)[i].as_py() or "", held[host]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return _with_templates(p, known, rows).select("page_id", "url", "html", "host", "template", "article").mapInArrow(lean(run), "page_id long, url string, text string, n_chars long")
