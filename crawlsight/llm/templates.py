"""Main text of HTML pages, by the template that the pages of a host share.

A page is read as a sequence of tokens: starts of elements, ends of blocks, the words of
short texts, and each longer text as a whole. A token's role is its place in the element
tree, so a word in the menu differs from the same word in the article. Tokens of a host that
occur equally often in every page have one occurrence vector; they form an equivalence
class. Classes of two and more tokens that enough pages hold are valid if their tokens keep
one order in every page and the classes nest in one another. The valid classes are the host's
template; what varies between their tokens are slots.

The template tells which element, found once in a page, holds the text of the slots: the
article, if there is such an element, else the innermost one that still holds most of the
text and the headline. From it a page's text is read, without menus, footers, asides,
notices, adverts, forms and comments (by element, class or id), and without texts of the
template itself. A page whose host has too few pages for a template, or that lacks the
element, is read by its elements alone: ``article``, else ``main``, else the body.

A vector is kept as checksum of (page, count) pairs, combined by exclusive or, so vectors of any
length are added up in the partitions before the shuffle, and a host's pages are never brought together.
Templates go to all tasks if they are few; beyond ``broadcast_tokens`` pages and templates
are dealt out by host, large hosts salted, and each task reads a template before its pages.

* NULL and empty html have no text; long pages are read whole, in linear time.
* NULL urls, and urls without ``://``, belong to no host: their pages are read by themselves.
* Repeated rows count as pages of their own and get a text each. Of elements or classes that fit
  equally well the one with the smaller role decides.
* An empty table gives no rows; further columns are ignored. Text that a host repeats in nearly
  every page, inside the article too, counts as template.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlsight.session import stage

_HOST = r"://([^/?#]*)"


@dataclass(frozen=True)
class TemplateOptions:
    least_pages: int = 4  # of a host that has a template
    share: float = 0.5  # of the host's pages that hold a token of the template
    text_share: float = 0.9  # of the host's pages that hold a text of the template
    text_pages: int = 8  # of a host whose template may hold texts
    short: int = 12  # words of a text that is read word by word
    most: float = 0.6  # of an element's text that the element holds into which it is narrowed
    broadcast_tokens: int = 300_000  # of all templates, for which they go to all tasks
    salts: int = 64  # parts of a host with more than a thousandth of all pages


# Kinds of elements; a role's code is a sum of them.
BLOCK, ROOT, BODY, ARTICLE, MAIN, HEADING, DROPPED, ASIDE, COMMENTS = (1 << k for k in range(9))

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe xmp template svg math object canvas".split())
_NO_TEXT = frozenset(
    "head nav aside footer form menu dialog button select option input label fieldset audio video".split()
) | _RAW
_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure"
    " footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre"
    " search section summary table tbody td tfoot th thead title tr ul".split()
)
_HEADINGS = frozenset("h1 h2".split())
_HEADS = frozenset("h1 h2 h3 h4 h5 h6".split())
_ENDS_P = _BLOCKS - frozenset("body caption dd dt head html legend li optgroup option tbody td tfoot th thead title tr".split())
#: Elements that a start tag ends, and those in which it looks no further.
_ENDS = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dd": (("dd", "dt"), ("dl",)),
    "dt": (("dd", "dt"), ("dl",)),
    "option": (("option",), ("select",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "tbody": (("tbody", "thead", "tfoot", "tr", "td", "th"), ("table",)),
    "tfoot": (("tbody", "thead", "tr", "td", "th"), ("table",)),
    "body": (("head",), ("html",)),
}
#: Words of classes and ids of what stands beside an article.
_BESIDE = frozenset(
    "ad ads adv advert advertisement adsense banner breadcrumb breadcrumbs consent cookie cookies footer gdpr login masthead menu"
    " modal nav navbar navigation newsletter notice pager pagination popup promo promoted related recommended share"
    " sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar topbar trending widget".split()
)
_TALK = frozenset("comment comments commentlist discussion disqus replies reply respond".split())
_ROLES = {"navigation": DROPPED, "banner": ASIDE, "contentinfo": DROPPED, "complementary": DROPPED, "search": DROPPED, "main": MAIN}

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<end>/)?(?P<name>[A-Za-z][^\s/>]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<end2>/)?(?P<name2>[A-Za-z][^\s/>]*+)(?P<attrs2>[^>]*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)",
    re.S,
)
_ATTR = re.compile(r"""\b(class|id|role)\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>"']++)""", re.I)
_SPLIT = re.compile(r"[^a-z]+")


class Element:
    """An open element: ``role`` of its place, ``code`` of its kind, ``parent`` block."""

    __slots__ = ("name", "role", "code", "parent", "chars")

    def __init__(self, name: str, role: int, code: int, parent: Element | None):
        self.name, self.role, self.code, self.parent, self.chars = name, role, code, parent, 0


def _hash(text: str, seed: int) -> int:
    h = xxhash.xxh64_intdigest(text.encode("utf-8", "replace"), seed & 0xFFFFFFFFFFFFFFFF)
    return h - (1 << 64) if h >> 63 else h


@lru_cache(1 << 16)
def _kind(name: str, named: tuple, around: int) -> tuple[int, int]:
    """Role and code of an element by its name, its class, id and role attributes, and the block around it.

    Digits in classes and ids are left out, so that numbered elements share a role.
    """
    code = BLOCK if name in _BLOCKS else 0
    if name in _NO_TEXT:
        code |= DROPPED
    elif name == "article":
        code |= ARTICLE
    elif name == "main":
        code |= MAIN
    elif name in _HEADINGS:
        code |= HEADING
    elif name == "body":
        code |= BODY
    elif name == "html":
        code |= ROOT
    key = ""
    if name not in ("html", "body"):
        for attr, value in named:
            words = [w for w in _SPLIT.split(value.lower()) if w]
            attr = attr.lower()
            if attr == "role":
                code |= _ROLES.get(" ".join(words), 0)
                continue
            key += f" {attr}=" + " ".join(words)
            if _TALK.intersection(words):
                code |= COMMENTS
            elif code & (ARTICLE | MAIN) == 0 and _BESIDE.intersection(words):
                code |= ASIDE
    return _hash(name + key, around), code


@lru_cache(256)
def _raw_end(name: str) -> re.Pattern:
    return re.compile(rf"</{name}\s*+(?:>|\Z)", re.I)


def parse(html: str) -> list[tuple[str, Element, str]]:
    """Events of a page in order: ("+", element), ("-", element), ("t", element, text), ("br", element).

    Every start has its end: ends that are missing come where the next element or the
    page implies them. A text comes with the element it stands in.
    """
    block = top = Element("", 0, BLOCK, None)
    stack, events = [top], []
    add = events.append
    at, size = 0, len(html)

    def close(depth: int) -> Element:
        """Ends all open elements from this place of the stack on; the block that is open then."""
        while len(stack) > depth:
            add(("-", stack.pop(), ""))
        k = depth - 1
        while not stack[k].code & BLOCK:
            k -= 1
        return stack[k]

    def nearest(names: tuple, walls: tuple) -> int:
        """Lowest place on the stack of an open element of the names, above the walls."""
        found = 0
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].name in names:
                found = k
            elif stack[k].name in walls:
                break
        return found

    while at < size:
        tag = _TAG.search(html, at)
        if tag is None:
            add(("t", stack[-1], html[at:]))
            break
        begin = tag.start()
        if begin > at:
            add(("t", stack[-1], html[at:begin]))
        at = tag.end()
        end, name, attrs, end2, name2, attrs2 = tag.groups()
        name = name or name2
        if not name:
            continue
        name = name.lower()
        if end or end2:
            inline = name not in _BLOCKS
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name == name:
                    block = close(k)
                    break
                if inline and stack[k].code & BLOCK:
                    break
            continue
        if name in _VOID:
            if name in ("br", "hr"):
                add(("br", stack[-1], ""))
            continue
        shut = 0
        if name in _ENDS_P:
            shut = nearest(("p",), ("td", "th", "button", "table", "caption", "object"))
            if not shut and name in _HEADS and stack[-1].name in _HEADS:
                shut = len(stack) - 1
        if name in _ENDS:
            shut = nearest(*_ENDS[name]) or shut
        if shut:
            block = close(shut)
        attrs = attrs or attrs2 or ""
        named = tuple(_ATTR.findall(attrs)) if "=" in attrs and name != "a" else ()
        role, code = _kind(name, named, block.role)
        element = Element(name, role, code, block)
        if name in _RAW:
            close_ = _raw_end(name).search(html, at)
            add(("+", element, ""))
            add(("-", element, ""))
            at = close_.end() if close_ else size
            continue
        if attrs.endswith("/") and not code & BLOCK:
            continue
        stack.append(element)
        if code & BLOCK:
            block = element
        add(("+", element, ""))
    close(1)
    return events


_END = 0x5BD1E995  # makes an end's token of its start's


def text_tokens(element: Element, text: str, short: int) -> list[int]:
    """Tokens of a text: its words, or the whole if it is long."""
    words = (unescape(text) if "&" in text else text).split()
    block = element if element.code & BLOCK else element.parent
    if len(words) <= short:
        return [_hash(w, block.role + 1) for w in words]
    return [_hash(" ".join(words), block.role + 2)]


def tokens(html: str, options: TemplateOptions) -> tuple[list, list, list, list, list, list]:
    """Distinct tokens of a page by first occurrence with counts, characters of text, parents and codes; the sequence of their numbers."""
    numbers: dict[int, int] = {}
    counts: list[int] = []
    chars: list[int] = []
    parents: list[int] = []
    codes: list[int] = []
    sequence: list[int] = []

    def add(token: int, parent: int, code: int) -> int:
        k = numbers.get(token)
        if k is None:
            numbers[token] = k = len(counts)
            counts.append(1)
            chars.append(0)
            parents.append(parent)
            codes.append(code)
        else:
            counts[k] += 1
        sequence.append(k)
        return k

    link = 0
    for event, element, text in parse(html):
        if event == "t":
            if text.isspace():
                continue
            if not link:
                (element if element.code & BLOCK else element.parent).chars += len(text)
            for token in text_tokens(element, text, options.short):
                add(token, 0, -1)
        elif event == "+":
            link += element.name == "a"
            add(element.role, element.parent.role, element.code)
        elif event == "-":
            if not element.code & BLOCK:
                link -= element.name == "a"
                continue
            add(element.role ^ _END, 0, -2)
            if element.chars:
                chars[numbers[element.role]] += element.chars
                # What stands beside the text does not count for the elements around it.
                if not element.code & (DROPPED | ASIDE | COMMENTS):
                    element.parent.chars += element.chars
    return list(numbers), counts, chars, parents, codes, sequence


class Template:
    """A host's template: classes of tokens, the element of the main text, texts of its own."""

    def __init__(self, pages: int, entries: list, invalid: frozenset = frozenset(), options: TemplateOptions = TemplateOptions()):
        """``entries`` are (token, vector, pages, occurrences, chars, parent, code); ``invalid`` vectors are left out."""
        vectors = Counter(e[1] for e in entries)
        kept = sorted(e for e in entries if vectors[e[1]] > 1 and e[1] not in invalid)
        self.pages, self.options = pages, options
        self.vector_of = {e[0]: e[1] for e in kept}
        self.size_of = {v: n for v, n in vectors.items() if n > 1 and v not in invalid}
        self.support = {e[1]: e[2] for e in kept}
        self.chars = {e[0]: e[4] for e in kept if e[6] >= 0}
        often = options.text_share * pages
        self.texts = {e[0] for e in kept if e[6] == -1 and e[2] >= often} if pages >= options.text_pages else set()
        self.main = self._main({e[0]: e for e in kept if e[6] >= 0 and e[3] == e[2]})

    def _main(self, once: dict[int, tuple]) -> int | None:
        """The element of the main text, among those that a page holds once."""
        beside = DROPPED | ASIDE | COMMENTS

        def around(token: int) -> Iterator[int]:
            while token in once:
                yield token
                token = once[token][5]

        def named(kind: int) -> list[int]:
            found = [t for t, e in once.items() if e[6] & kind and e[4] and not any(once[x][6] & (DROPPED | COMMENTS) for x in around(t))]
            return sorted(found, key=lambda t: (-once[t][4], t))

        for kind in (ARTICLE, MAIN):
            if found := named(kind):
                return found[0]
        inner = defaultdict(list)
        for token, e in once.items():
            if e[6] & BLOCK and not e[6] & beside:
                inner[e[5]].append(token)
        at = next((t for t, e in sorted(once.items()) if e[6] & BODY), None)
        while at is not None:
            best = min(inner[at], key=lambda t: (-once[t][4], t), default=None)
            if best is None or once[best][4] < self.options.most * once[at][4] or once[best][6] & HEADING:
                break
            if any(once[t][6] & HEADING and once[t][4] for t in inner[at]):  # the headline stands beside it
                break
            at = best
        return at

    def keeps(self, element: Element, main: int) -> bool:
        """Whether an element within the main one belongs to its text."""
        if element.code & (DROPPED | COMMENTS):
            return False
        # An element that is named like an advert but holds most of what the host writes is the text.
        return not element.code & ASIDE or self.chars.get(element.role, 0) > self.chars.get(main, 0)

    def checked(self, tokens_: list[int], sequence: list[int]) -> list[tuple[int, int, bool]]:
        """(vector, order, nests) for every class that the page holds: a checksum of its tokens' order, and whether it crosses no other."""
        vectors = [self.vector_of.get(t) for t in tokens_]
        seen: dict[int, list[int]] = defaultdict(list)
        place: dict[int, int] = {}
        crossing: set[int] = set()
        open_: list[int] = []  # vectors of the classes begun
        broken: set[int] = set()
        for k in sequence:
            v = vectors[k]
            if v is None or v in broken:
                continue
            row, size = seen[v], self.size_of[v]
            turn = place.get(v, 0)
            if len(row) < size:
                row.append(k)
            elif row[turn] != k:
                broken.add(v)
                open_ = [o for o in open_ if o != v]
                continue
            if turn == 0 or v not in open_:
                open_.append(v)
            while open_[-1] != v:  # what began within must have ended
                crossing.add(min(open_[-1], v, key=lambda x: (self.support[x], self.size_of[x], x)))
                open_.pop()
            turn += 1
            if turn == size:
                turn = 0
                open_.pop()
            place[v] = turn
        out = []
        for v, row in seen.items():
            whole = v not in broken and place.get(v, 0) == 0 and len(set(row)) == self.size_of[v]
            order = _hash(",".join(str(tokens_[k]) for k in row), 7) if whole else 0
            out.append((v, order, whole and v not in crossing))
        return out


_NONE = Template(0, [])


def main_text(html: str, template: Template | None = None) -> str:
    """The main text of a page, by its host's template if there is one."""
    template = template or _NONE
    events = parse(html)
    target = template.main
    if target is None or not any(e == "+" and x.role == target for e, x, _ in events):
        target = None
        for kind in (ARTICLE, MAIN, BODY):
            if any(e == "+" and x.code & kind and not x.code & COMMENTS for e, x, _ in events):
                break
        else:
            kind = 0
    whole = kind in (BODY, 0) if target is None else any(x.role == target and x.code & BODY for _, x, _ in events)
    blocks: list[str] = []
    now: list[str] = []
    inside = skipped = 0

    def flush() -> None:
        if now:
            text = " ".join("".join(now).split())
            now.clear()
            if text:
                blocks.append(text)

    for event, element, text in events:
        if event == "t":
            if (inside or target is None and kind == 0) and not skipped and not (template.texts and _own(text, element, template)):
                now.append(unescape(text))
            continue
        if event == "br":
            flush()
            continue
        step = 1 if event == "+" else -1
        if element.code & BLOCK:
            flush()
        is_main = element.role == target if target is not None else bool(element.code & kind) and not element.code & COMMENTS
        if is_main and not skipped:
            inside += step
        elif (inside or target is None) and (not template.keeps(element, target or 0) or whole and element.name == "header"):
            skipped += step
    flush()
    return " ".join(blocks)


def _own(text: str, element: Element, template: Template) -> bool:
    """Whether every token of a text belongs to the template."""
    found = text_tokens(element, text, template.options.short)
    return bool(found) and all(t in template.texts for t in found)


def _pages(pages: DataFrame) -> DataFrame:
    """row (its number), page_id, url, site (0: none), html."""
    host = F.lower(F.coalesce(F.regexp_extract("url", _HOST, 1), F.lit("")))
    return pages.select(
        F.monotonically_increasing_id().alias("row"),
        F.col("page_id").cast("bigint").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.when(host == "", 0).otherwise(F.xxhash64(host)).alias("site"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
    )


_TOKENS = (
    "row bigint, site bigint, token array<bigint>, n array<int>, chars array<int>, parent array<bigint>, code array<int>, seq array<int>"
)


def _tokenized(rows: DataFrame, options: TemplateOptions) -> DataFrame:
    long, int_ = pa.list_(pa.int64()), pa.list_(pa.int32())
    kinds = [long, int_, int_, long, int_, int_]
    names = ["token", "n", "chars", "parent", "code", "seq"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [tokens(h, options) for h in batch.column(2).to_pylist()]
            more = [pa.array([f[k] for f in found], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *more], names=["row", "site", *names])

    return rows.select("row", "site", "html").mapInArrow(run, _TOKENS)


def candidates(tokenized: DataFrame, options: TemplateOptions) -> DataFrame:
    """site, pages, entries: the tokens of each host that enough of its pages hold.

    A host has no more of them than a page holds tokens, divided by ``share``.
    """
    each = tokenized.filter("site <> 0").select("row", "site", F.explode(F.arrays_zip("token", "n", "chars", "parent", "code")).alias("t"))
    stats = (
        each.groupBy("site", "t.token")
        .agg(
            F.bit_xor(F.xxhash64("row", "t.n")).alias("vector"),
            F.count("*").alias("held"),
            F.sum("t.n").alias("occurrences"),
            F.sum("t.chars").alias("chars"),
            F.max("t.parent").alias("parent"),
            F.max("t.code").alias("code"),
        )
        .filter(F.col("held") >= options.least_pages * options.share)
    )
    sites = tokenized.filter("site <> 0").groupBy("site").agg(F.count("*").alias("pages")).filter(F.col("pages") >= options.least_pages)
    entry = F.struct("token", "vector", "held", "occurrences", "chars", "parent", "code")
    return (
        stats.join(sites, "site")
        .filter(F.col("held") >= options.share * F.col("pages"))
        .groupBy("site", "pages")
        .agg(F.collect_list(entry).alias("entries"))
    )


def _beside_templates(
    rows: DataFrame, value: str, templates: DataFrame, each: Callable, schema: str, arrow: pa.Schema, options: TemplateOptions
) -> DataFrame:
    """``each(row values, Template or None)`` for rows of row, site and further columns; a list of output tuples each."""
    columns = rows.columns
    site_at = columns.index("site")
    tokens_, total = templates.agg(F.coalesce(F.sum(F.size("entries")), F.lit(0)), F.coalesce(F.sum("pages"), F.lit(0))).first()

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], f.type) for k, f in enumerate(arrow)], schema=arrow)

    def built(r) -> Template:
        invalid = frozenset(r["invalid"] or ())
        return Template(r["pages"], [tuple(e.values()) if isinstance(e, dict) else tuple(e) for e in r["entries"]], invalid, options)

    if tokens_ <= options.broadcast_tokens:
        known = {r["site"]: r.asDict(recursive=True) for r in templates.collect()}
        shared = rows.sparkSession.sparkContext.broadcast(known)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ready: dict[int, Template] = {}
            for batch in batches:
                out = []
                for row in zip(*(c.to_pylist() for c in batch.columns)):
                    site = row[site_at]
                    if site not in ready:
                        ready[site] = built(shared.value[site]) if site in shared.value else None
                    out += each(row, ready[site])
                yield batch_of(out)

        return rows.mapInArrow(run, schema)

    # Pages and templates dealt out by host; a template comes before its pages. The few hosts
    # with more than a thousandth of all pages get several parts.
    large = F.broadcast(templates.filter(F.col("pages") * 1000 > total).select("site", F.lit(options.salts).alias("salts")))

    def salted(df: DataFrame, part: str) -> DataFrame:
        return df.join(large, "site", "left").withColumn("part", F.expr(part)).drop("salts")

    kinds = {c: t for c, t in rows.dtypes}
    pages = salted(rows, f"if(site = 0, pmod(row, {options.salts}), coalesce(pmod(row, salts), 0))").selectExpr(
        "site", "cast(part as int) as part", "1 as kind", *(c for c in columns if c != "site"), "cast(null as bigint) as pages",
        "cast(null as array<struct<token:bigint,vector:bigint,held:bigint,occurrences:bigint,chars:bigint,parent:bigint,code:int>>) as entries",
        "cast(null as array<bigint>) as invalid",
    )
    first = salted(templates, "explode(sequence(0, coalesce(salts, 1) - 1))").selectExpr(
        "site", "cast(part as int) as part", "0 as kind", *(f"cast(null as {kinds[c]}) as {c}" for c in columns if c != "site"),
        "pages", "entries", "invalid",
    )
    dealt = first.unionByName(pages).repartition("site", "part").sortWithinPartitions("site", "part", "kind")
    order = dealt.columns

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        site, template = None, None
        for batch in batches:
            out = []
            for values in zip(*(c.to_pylist() for c in batch.columns)):
                r = dict(zip(order, values))
                if r["kind"] == 0:
                    site, template = r["site"], built(r)
                else:
                    out += each(tuple(r[c] for c in columns), template if r["site"] == site else None)
            yield batch_of(out)

    return dealt.mapInArrow(merged, schema)


def induce(tokenized: DataFrame, options: TemplateOptions = TemplateOptions()) -> DataFrame:
    """site, pages, entries, invalid: candidate tokens of each host, and the vectors whose classes are not valid."""
    found = stage(candidates(tokenized, options).withColumn("invalid", F.expr("cast(array() as array<bigint>)")), "template_candidates")
    arrow = pa.schema([("site", pa.int64()), ("vector", pa.int64()), ("order", pa.int64()), ("nests", pa.bool_())])

    def check(row: tuple, template: Template | None) -> list[tuple]:
        _, site, token, seq = row
        return [] if template is None else [(site, *c) for c in template.checked(token, seq)]

    checks = _beside_templates(
        tokenized.select("row", "site", "token", "seq"), "seq", found, check,
        "site bigint, vector bigint, order bigint, nests boolean", arrow, options,
    )
    wrong = (
        checks.groupBy("site", "vector")
        .agg(F.min("order").alias("low"), F.max("order").alias("high"), F.min("nests").alias("nests"))
        .filter("low <> high or not nests")
        .groupBy("site")
        .agg(F.collect_list("vector").alias("wrong"))
    )
    joined = found.drop("invalid").join(wrong, "site", "left")
    return joined.select("site", "pages", "entries", F.coalesce("wrong", F.expr("cast(array() as array<bigint>)")).alias("invalid"))


def extract(pages: DataFrame, options: TemplateOptions = TemplateOptions()) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    rows = _pages(pages)
    tokenized = stage(_tokenized(rows, options), "page_tokens")
    templates = stage(induce(tokenized, options), "templates")
    arrow = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def read(row: tuple, template: Template | None) -> list[tuple]:
        _, page_id, url, _, html = row
        text = main_text(html, template)
        return [(page_id, url, text, len(text))]

    return _beside_templates(rows, "html", templates, read, "page_id bigint, url string, text string, n_chars bigint", arrow, options)
