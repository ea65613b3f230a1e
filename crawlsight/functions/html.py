"""HTML expressions: staged string and array operations over the page source.

Every quantifier over page text is possessive or ends at the end of input, so
one pass stays linear and cannot exhaust the regex stack on hostile pages.
"""

from __future__ import annotations

from crawlsight.functions.sql import NO_STRINGS, let, lit, strings
from crawlsight.functions.text import SPACE, decode_entities, strip

# Marks a place where markup stood; removed from the source beforehand.
MARK = "\x01"

_ATTRS = r"""(?:[^>"'=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|=|["'])*+"""
_START = rf"[A-Za-z]{_ATTRS}"
_MARKUP = rf"(?:{_START}|[/!?][^>]*+)(?:>|\z)"
_ANY_MARKUP = rf"<{_MARKUP}"


def _element(names: str) -> str:
    """An element, after its ``<``, up to its end tag or the end of the page; ``/>`` ends it at once.

    Patterns start with the one ``<`` so that other characters are passed over quickly.
    """
    return rf"({names})(?=[\s/>]){_ATTRS}(?<!/)>(?s:.*?)(?:</\1\s*+>|\z)"


_BLOCK = rf"(?i)<(?:!--(?s:.*?)(?:-->|\z)|{_element('script|style')})"
# Markup together with the elements whose text is not shown.
_VISIBLE_CUT = rf"(?i)<(?:{_element('noscript|svg|template')}|{_MARKUP})"
_NOSCRIPT_CUT = rf"(?i)<(?:{_element('noscript')}|{_MARKUP})"
_PICTURE = rf"(?i)<{_element('picture')}"
_FACT_TAGS = rf"(?i)<(?:html|meta|link|img|picture|a)(?=[\s/>]){_ATTRS}>"
_SOURCE_TAG = rf"(?i)<source(?=[\s/>]){_ATTRS}>"
_ALL_TAGS = rf"<{_START}>"
_SCRIPT_TAG = rf"(?i)^<script{_ATTRS}>"
_HEADING = rf"(?i)<h[1-6](?=[\s/>]){_ATTRS}>(?s:.*?)(?:</h[1-6]\s*+>|(?=<h[1-6][\s>]|</h[1-6]|</body|</html|\z))"
# A heading without an end tag of its own ends where a block begins.
_BLOCK_NAMES = (
    "address|article|aside|blockquote|dl|div|fieldset|figure|footer|form|header|hr|main|nav|ol|p|pre|section|table|ul"
)
_OPEN_HEADING = rf"(?i)^(<h[1-6]{_ATTRS}>(?s:.*?))(?:<(?:{_BLOCK_NAMES})[\s/>]|\z)"
_VOID_NAMES = "area|base|br|col|embed|hr|img|input|link|meta|param|picture|source|track|wbr"
# Elements inside a picture: what they hold are no children of the picture.
_INSIDE = rf"(?i)<(?!(?:{_VOID_NAMES})[\s/>]){_element('[A-Za-z][A-Za-z0-9-]*+')}"
_TITLE = rf"(?i)<title(?=[\s/>]){_ATTRS}>((?s:.*?))(?:</title|\z)"
_ATTR = r"""([^\s/>="'][^\s/>=]*+)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)?+)?+"""

# Where an image address may be, in order of preference.
IMAGE_SOURCES = (
    "src", "data-src", "data-lazy-src", "data-original", "data-lazy", "data-url", "data-image",
)
# Ids of client-side application roots.
APP_ROOT_IDS = ("root", "app", "__next", "___gatsby")


def source_text(html: str) -> str:
    return f"replace({html}, {lit(MARK)}, '')"


def _cut(src: str, pattern: str) -> str:
    return f"regexp_replace({src}, {lit(pattern)}, {lit(MARK)})"


def dom(src: str) -> str:
    """Source with comments and script/style elements turned into marks."""
    return _cut(src, _BLOCK)


def _names(tag: str) -> str:
    return f"transform(regexp_extract_all({tag}, {lit(_ATTR)}, 1), n -> lower(n))"


def _values(tag: str) -> str:
    """Attribute values without quotes, references not yet decoded; empty if there is none."""
    return (
        f"transform(regexp_extract_all({tag}, {lit(_ATTR)}, 2),"
        """ v -> if(substr(v, 1, 1) in ('"', "'"), substr(v, 2, length(v) - 2), v))"""
    )


def parsed_tags(tags: str) -> str:
    """Structs ``k`` (first letter of the tag), ``n`` and ``v`` (attribute names and values)."""
    raw = (
        f"transform({tags}, t -> named_struct('k', lower(substr(t, 2, 1)),"
        f" 'n', {_names('t')}, 'v', {_values('t')}))"
    )
    return (
        f"transform({raw}, t -> named_struct('k', t.k, 'n', t.n,"
        f" 'v', transform(t.v, v -> {decode_entities('v', attribute=True)})))"
    )


def fact_tags(dom_: str) -> str:
    """Start tags of html, meta, link, img, picture and a, in document order.

    The first letter tells the six kinds apart.
    """
    return parsed_tags(f"regexp_extract_all({dom_}, {lit(_FACT_TAGS)}, 0)")


def of_kind(tags: str, letter: str) -> str:
    return f"filter({tags}, t -> t.k = '{letter}')"


def attr(tag: str, name: str) -> str:
    """Value of the first attribute of that name: NULL if absent, empty if it has no value."""
    return f"get({tag}.v, cast(array_position({tag}.n, '{name}') as int) - 1)"


def picture_sources(dom_: str, tags_: str) -> str:
    """srcset values of the sources that are children of picture elements, if the page has any."""
    blocks = f"regexp_extract_all({dom_}, {lit(_PICTURE)}, 0)"
    own = f"regexp_replace(b, {lit(_INSIDE)}, '')"
    tags = f"flatten(transform({blocks}, b -> regexp_extract_all({own}, {lit(_SOURCE_TAG)}, 0)))"
    sets = f"transform({parsed_tags(tags)}, t -> {attr('t', 'srcset')})"
    return f"if(exists({tags_}, t -> t.k = 'p'), {sets}, {NO_STRINGS})"


def has_app_root(dom_: str) -> str:
    ids = (
        f"transform(regexp_extract_all({dom_}, {lit(_ALL_TAGS)}, 0),"
        f" t -> named_struct('n', {_names('t')}, 'v', {_values('t')}))"
    )
    return f"coalesce(exists({ids}, t -> coalesce(lower({attr('t', 'id')}) in ({strings(APP_ROOT_IDS)}), false)), false)"


def json_ld_texts(src: str) -> str:
    """Bodies of the scripts whose type is exactly ``application/ld+json``, in order."""
    scripts = f"filter(regexp_extract_all({src}, {lit(_BLOCK)}, 0), b -> b rlike '(?i)^<script')"
    opened = (
        f"transform({scripts}, b -> named_struct('tag', regexp_extract(b, {lit(_SCRIPT_TAG)}, 0), 'block', b))"
    )
    body = "regexp_replace(substr(s.block, length(s.tag) + 1), '(?i)</script\\\\s*+>\\\\z', '')"
    typed = (
        f"transform({opened}, s -> named_struct('n', {_names('s.tag')}, 'v', {_values('s.tag')},"
        f" 'body', {body}))"
    )
    kept = f"filter({typed}, s -> coalesce({attr('s', 'type')}, '') = 'application/ld+json')"
    return f"if(contains({src}, 'ld+json'), transform({kept}, s -> s.body), {NO_STRINGS})"


def _text(fragment: str, joiner: str, cut: str = _ANY_MARKUP) -> str:
    """Stripped, non-empty text nodes of a fragment, joined.

    Nearly all nodes begin and end with a printable ASCII character, which is told without a pattern.
    """
    decoded = let("mk", _cut(fragment, cut), decode_entities("mk"))
    nodes = f"filter(split({decoded}, {lit(MARK)}), n -> n <> '')"
    tight = "substr(n, 1, 1) between '!' and '~' and substr(n, -1, 1) between '!' and '~'"
    stripped = f"transform({nodes}, n -> if({tight}, n, {strip('n')}))"
    return f"array_join(filter({stripped}, n -> n <> ''), '{joiner}')"


def node_text(fragment: str) -> str:
    return _text(fragment, " ")


def visible_text(dom_: str) -> str:
    """Text of a page without noscript, svg and template elements."""
    return _text(dom_, " ", _VISIBLE_CUT)


def text_without_noscript(dom_: str) -> str:
    return _text(dom_, " ", _NOSCRIPT_CUT)


def title_text(dom_: str) -> str:
    """Text of the first title element; NULL if blank."""
    return f"nullif({_text(f'regexp_extract({dom_}, {lit(_TITLE)}, 1)', '')}, '')"


def headings(dom_: str) -> str:
    """Structs of level and text for every non-blank heading, in document order."""
    whole = f"if(f rlike '(?i)</h[1-6]\\\\s*+>$', f, regexp_extract(f, {lit(_OPEN_HEADING)}, 1))"
    texts = (
        f"transform(transform(regexp_extract_all({dom_}, {lit(_HEADING)}, 0), f -> {whole}),"
        f" f -> named_struct('level', substr(f, 3, 1), 'text', {node_text('f')}))"
    )
    return f"filter({texts}, s -> s.text <> '')"


def level(headings_: str, n: int) -> str:
    return f"transform(filter({headings_}, s -> s.level = '{n}'), s -> s.text)"


def first_srcset_url(srcset: str) -> str:
    """First address of a srcset; NULL if there is none."""
    pattern = rf"^[{SPACE}]*+([^{SPACE}]*+)"
    return f"nullif(regexp_extract(substring_index({srcset}, ',', 1), {lit(pattern)}, 1), '')"
