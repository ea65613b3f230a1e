"""Text expressions: Unicode strip, entity decoding, word count, exact one-decimal rounding."""

from __future__ import annotations

from html.entities import html5

from crawlsight.functions.sql import lit

# Whitespace as a Unicode-aware strip sees it, and word characters.
SPACE = r"\s\x0B\x1c-\x1f\x85\p{Z}"
WORD = r"[\p{L}\p{N}_]++"

_STRIP = rf"(?s)^[{SPACE}]*+(.*[^{SPACE}])"
# Names of the HTML standard, those of everyday use first since a map is searched in
# order; one literal that the optimizer folds into a map.
_EVERYDAY = ("amp", "lt", "gt", "quot", "apos", "nbsp", "copy", "middot")
_NAMES = {n[:-1]: c for n, c in html5.items() if n.endswith(";")}
_NAMED = "\x02".join(f"{n}\x03{c}" for n, c in ({n: _NAMES[n] for n in _EVERYDAY} | _NAMES).items())
# Names that older pages may write without the semicolon, longest first.
_LEGACY = sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n))
_REFERENCE = r"^(#[0-9]++;?|#[xX][0-9a-fA-F]++;?|[A-Za-z][A-Za-z0-9]*+;)"
_SHORT = "^(" + "|".join(_LEGACY) + ")"
# Numbers 128 to 159 mean Windows-1252 characters.
_WINDOWS = [ord(bytes([k]).decode("cp1252", "ignore") or chr(k)) for k in range(128, 160)]


def strip(x: str) -> str:
    return f"regexp_extract({x}, {lit(_STRIP)}, 1)"


def blank_to_null(x: str) -> str:
    return f"nullif({strip(x)}, '')"


def is_blank(x: str) -> str:
    """True for NULL, empty and whitespace-only text."""
    return f"({strip(f'coalesce({x}, {lit(str())})')} = '')"


def filled(x: str) -> str:
    """True where the string is neither NULL nor empty."""
    return f"(coalesce({x}, '') <> '')"


def split_blank(x: str) -> str:
    """Whitespace-separated tokens, without empty ones."""
    return f"filter(split({x}, {lit(f'[{SPACE}]++')}), w -> w <> '')"


def _char(digits: str, base: int) -> str:
    """Character of a number; U+FFFD for zero, surrogates and numbers beyond Unicode.

    Controls other than tab and line ends decode to nothing.
    """
    code = f"cast(conv({digits}, {base}, 10) as bigint)"
    windows = f"get(array({', '.join(map(str, _WINDOWS))}), cast(c as int) - 128)"
    char = "decode(unhex(lpad(hex({}), 8, '0')), 'UTF-32')"
    text = (
        f"case when c is null or c = 0 or c > 1114111 or c between 55296 and 57343 then '\\uFFFD'"
        f" when c between 128 and 159 then {char.format(windows)}"
        f" when c in (9, 10, 12, 13) or c >= 32 and c <> 127 then {char.format('c')} else '' end"
    )
    # Seven significant digits are beyond Unicode in either base, or decimal and still small.
    return f"get(transform(array(if(length({digits}) > 7, null, {code})), c -> {text}), 0)"


def _reference(n: str) -> str:
    """Text of a reference such as ``amp;``, ``#38`` or ``#x26;``; NULL if unknown."""
    bare = f"rtrim(';', {n})"
    named = f"str_to_map({lit(_NAMED)}, '\\u0002', '\\u0003')"
    return (
        f"case when {n} = '' then null"
        f" when substr({n}, 1, 2) in ('#x', '#X') then {_char(f'ltrim(chr(48), substr({bare}, 3))', 16)}"
        f" when startswith({n}, '#') then {_char(f'ltrim(chr(48), substr({bare}, 2))', 10)}"
        f" else try_element_at({named}, {bare}) end"
    )


def decode_entities(x: str, attribute: bool = False) -> str:
    """Character references replaced in one pass, so ``&amp;lt;`` becomes ``&lt;``.

    In an attribute, an old name without its semicolon stays if a letter, digit or
    ``=`` follows: it is a query parameter. ``x`` is used several times: give a column
    or a bound name.
    """
    short = _SHORT + ("(?![A-Za-z0-9=])" if attribute else "")
    pieces = (
        f"transform(split({x}, '&'), (p, i) -> named_struct('p', p, 'i', i,"
        f" 'n', if(i > 0, regexp_extract(p, {lit(_REFERENCE)}, 1), '')))"
    )
    pieces = f"transform({pieces}, e -> named_struct('p', e.p, 'i', e.i, 'n', e.n, 't', {_reference('e.n')}))"
    pieces = (
        f"transform({pieces}, e -> named_struct('p', e.p, 'i', e.i, 'n', e.n, 't', e.t,"
        f" 's', if(e.i > 0 and e.t is null, regexp_extract(e.p, {lit(short)}, 1), '')))"
    )
    known = f"try_element_at(str_to_map({lit(_NAMED)}, '\\u0002', '\\u0003'), e.s)"
    joined = (
        f"array_join(transform({pieces}, e -> case when e.i = 0 then e.p"
        " when e.t is not null then concat(e.t, substr(e.p, length(e.n) + 1))"
        f" when e.s <> '' then concat({known}, substr(e.p, length(e.s) + 1))"
        " else concat('&', e.p) end), '')"
    )
    return f"if(contains({x}, '&'), {joined}, {x})"


def word_count(x: str) -> str:
    return f"regexp_count({x}, {lit(WORD)})"


def size0(x: str) -> str:
    return f"coalesce(size({x}), 0)"


def round1(x: str) -> str:
    """Non-negative ``x`` to one decimal by its exact binary value, ties to even.

    Compares 20x with the odd integer at the midpoint; 20x = 16x + 4x is kept
    exact as a sum and its rounding error.
    """
    parts = f"named_struct('a', cast({x} as double) * 16, 'b', cast({x} as double) * 4)"
    total = f"transform(array({parts}), r -> named_struct('a', r.a, 'b', r.b, 's', r.a + r.b))"
    exact = (
        f"transform({total}, r -> named_struct('s', r.s, 'n', cast(floor(r.s / 2) as double),"
        " 'e', (r.a - (r.s - (r.s - r.a))) + (r.b - (r.s - r.a))))"
    )
    rounded = (
        f"transform({exact}, r -> (case"
        " when r.s > 2 * r.n + 1 or (r.s = 2 * r.n + 1 and r.e > 0) then r.n + 1"
        " when r.s = 2 * r.n + 1 and r.e = 0 then r.n + r.n % 2 else r.n end) / 10)"
    )
    return f"get({rounded}, 0)"


def fixed1(x: str) -> str:
    """``x`` printed with one decimal."""
    return f"concat(if({x} < 0, '-', ''), format_string('%.1f', {round1(f'abs({x})')}))"


def signed1(x: str) -> str:
    return f"concat(if({x} < 0, '-', '+'), format_string('%.1f', {round1(f'abs({x})')}))"
