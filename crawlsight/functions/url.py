"""URL expressions. Built from string functions only: bad URLs become NULL, never an error."""

from __future__ import annotations

from crawlsight.functions.sql import let, lit
from crawlsight.functions.text import SPACE, strip

# Link prefixes that are no page links.
SKIPPED_SCHEMES = ("javascript:", "mailto:", "tel:", "sms:", "data:", "blob:")
UNRESOLVED_PREFIXES = ("mailto:", "tel:", "javascript:", "data:")

_SCHEME = r"^[A-Za-z][A-Za-z0-9+.\-]*+:"
_ORIGIN = r"^[A-Za-z][A-Za-z0-9+.\-]*+://[^/?#]*+"
_HOST = r"^[^:/?#]+://([^/?#]*)"
_SKIP = r"(?i)^(?:#|" + "|".join(SKIPPED_SCHEMES) + ")"
_UNRESOLVED = "^(?:" + "|".join(UNRESOLVED_PREFIXES) + ")"
_PARAMS = r";[^/]*+\z"
# Most links: a plain path from the root, or a plain absolute address.
_PLAIN_PATH = rf"^/(?!/)[^?#;{SPACE}]*+$"
_PLAIN_ADDRESS = rf"(?i)^https?://[^/?#;{SPACE}]++(?:/[^?#;{SPACE}]*+)?$"
_DOT_SEGMENT = r"(?:^|/)\.\.?(?:/|$)"


def _clean(u: str) -> str:
    """Stripped, without line breaks, tabs and fragment."""
    return f"substring_index(translate({strip(u)}, '\\t\\r\\n', ''), '#', 1)"


def _path(tail: str) -> str:
    return f"regexp_replace(substring_index({tail}, '?', 1), {lit(_PARAMS)}, '')"


def _query(tail: str) -> str:
    return f"substr({tail}, length(substring_index({tail}, '?', 1)) + 2)"


def _finish(origin_: str, path: str, query: str) -> str:
    """Origin, path and query put together in normal form."""
    body = "case when pq.p in ('', '/') then '/' else rtrim('/', pq.p) end"
    return let(
        "pq",
        f"named_struct('p', {path}, 'q', {query})",
        f"concat(lower({origin_}), {body}, if(pq.q <> '', concat('?', pq.q), ''))",
    )


def origin(u: str) -> str:
    """``scheme://netloc`` as written; empty if the URL has none."""
    return f"regexp_extract({u}, {lit(_ORIGIN)}, 0)"


def host(u: str) -> str:
    """Lower-cased netloc with port and userinfo; empty if there is none."""
    return f"lower(regexp_extract({u}, {lit(_HOST)}, 1))"


def same_host(a: str, b: str) -> str:
    return f"({host(a)} = {host(b)})"


def _split(u: str) -> str:
    return let(
        "su", _clean(u), f"named_struct('u', su, 'o', {origin('su')}, 't', regexp_replace(su, {lit(_ORIGIN)}, ''))"
    )


def normalize_url(u: str) -> str:
    """Form used as a page key. NULL for text without scheme and authority."""
    return let("nu", _split(u), f"if(nu.o <> '', {_finish('nu.o', _path('nu.t'), _query('nu.t'))}, null)")


def is_page_href(href: str) -> str:
    """True for a stripped href that may lead to a page."""
    return f"({href} <> '' and not {href} rlike {lit(_SKIP)})"


def normal_host(u: str) -> str:
    """Host of an address in normal form, without a regular expression."""
    return f"substring_index(substring_index(substring_index({u}, '/', 3), '/', -1), '?', 1)"


def sitemap_url(seed: str) -> str:
    return f"concat({origin(seed)}, '/sitemap.xml')"


def robots_url(u: str) -> str:
    return f"concat({origin(u)}, '/robots.txt')"


def base_parts(base: str) -> str:
    """What ``resolve_url`` needs of the base, computed once per page."""
    return let(
        "bp",
        _split(base),
        f"named_struct('origin', bp.o, 'web', bp.o rlike '(?i)^https?:', 'lower', lower(bp.o), 'scheme', lower(regexp_extract(bp.o, {lit(_SCHEME)}, 0)),"
        f" 'path', {_path('bp.t')}, 'dir', regexp_replace({_path('bp.t')}, '[^/]*+\\\\z', ''),"
        f" 'query', {_query('bp.t')})",
    )


def _no_dots(path: str) -> str:
    """Path with its dot segments applied; it always starts with a slash."""
    folded = (
        f"aggregate(split({path}, '/'), cast(array() as array<string>),"
        " (a, s) -> case when s = '..' then slice(a, 1, greatest(size(a) - 1, 0))"
        " when s = '.' then a else concat(a, array(s)) end)"
    )
    slash = f"if({path} rlike {lit(r'(?:^|/)[.][.]?$')}, '/', '')"
    return f"if({path} rlike {lit(_DOT_SEGMENT)}, regexp_replace(concat('/', array_join({folded}, '/'), {slash}), '^//', '/'), {path})"


def resolve_url(base: str, href: str) -> str:
    """``href`` against ``base`` (a struct of ``base_parts``) in normal form.

    NULL if it is empty, not http(s), or has a scheme without authority.
    """
    relative = f"regexp_replace(concat('/', {base}.dir, {_path('rh.h')}), '/{{2,}}', '/')"
    bound = let("rp", _path("rh.h"), _finish(f"{base}.origin", _no_dots("rp"), _query("rh.h")))
    joined = let("rp", relative, _finish(f"{base}.origin", _no_dots("rp"), _query("rh.h")))
    own_query = f"if({_query('rh.h')} <> '', {_query('rh.h')}, {base}.query)"
    body = (
        f"case when rh.h is null or {href} = '' or {href} rlike {lit(_UNRESOLVED)} or {base}.origin = '' then null"
        f" when rh.h rlike '(?i)^https?://' then {normalize_url('rh.h')}"
        f" when rh.h rlike {lit(_SCHEME)} or {base}.scheme not in ('http:', 'https:') then null"
        f" when startswith(rh.h, '//') then {normalize_url(f'concat({base}.scheme, rh.h)')}"
        f" when substring_index(rh.h, '?', 1) = '' then {_finish(f'{base}.origin', f'{base}.path', own_query)}"
        f" when startswith(rh.h, '/') then {bound}"
        f" else {joined} end"
    )
    general = let("rh", f"named_struct('h', {_clean(href)})", body)
    tidy = f"if({href} = '/', '/', rtrim('/', {href}))"
    parts = f"named_struct('o', {origin(href)}, 'p', regexp_replace({href}, {lit(_ORIGIN)}, ''))"
    address = let("pa", parts, "concat(lower(pa.o), if(pa.p in ('', '/'), '/', rtrim('/', pa.p)))")
    return (
        f"case when {base}.web and {href} rlike {lit(_PLAIN_PATH)} and not contains({href}, '/.')"
        f" then concat({base}.lower, {tidy})"
        f" when {base}.web and {href} rlike {lit(_PLAIN_ADDRESS)} then {address} else {general} end"
    )
