"""Personal data and secrets: patterns propose spans, validators confirm them, context adjusts their score.

Kinds ``email``, ``ip``, ``card`` and ``phone`` are found leftmost and without overlap,
each for itself; a proposal that its validator refuses is dropped. Card numbers must
pass Luhn's checksum. These stay whatever their score. The other kinds count from
``MIN_SCORE`` on: words nearby that speak for the kind raise a score, words that speak
of examples or of other numbers lower it.

* ``iban``: mod 97. ``ssn``: an area, group and serial number that are given out, and context.
* ``national_id``: Spanish DNI and NIE (letter by mod 23), French NIR (mod 97), Italian tax code
  (letter by mod 26), Brazilian CPF (two digits by mod 11), German tax id (ISO 7064 mod 11, 10; context).
* ``npi``: American health provider, Luhn with its prefix, and context.
* ``ip6``: an IPv6 address as the standard library reads it, not loopback or a bare prefix.
* ``local_phone``: ten digits of the North American plan in groups; without brackets only with context.
* ``birth_date``: a date that exists, and context.
* ``token``: prefixes of well-known issuers with length and entropy. ``jwt``: three base64url
  parts, the first of which decodes to a JSON object with ``alg``. ``private_key``: a PEM block
  up to its end line, or to the end of the text if there is none.
* ``password``: the value after a name like ``password`` or ``api_key`` and ``:`` or ``=``, of two
  classes of characters and enough entropy.

A span of these that lies inside one found before is left out. All patterns take time in
proportion to the text: runs are entered at their beginning only, and never given back.

* NULL text is empty and has no spans. Bytes that aren't UTF-8 count as one replacement
  character for each broken sequence.
* Whole texts are searched, however long. Of equal spans the kind listed first counts.
* Positions are code points, ends exclusive. Repeated rows are returned as often as they
  occur; an empty table gives no rows; further columns are ignored, or kept by ``redacted``.
"""

from __future__ import annotations

import base64
import datetime
import ipaddress
import json
import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Base kinds first, in the order of the spans.
KINDS = (
    "email", "ip", "card", "phone", "iban", "ssn", "national_id", "npi", "ip6", "local_phone", "birth_date",
    "private_key", "jwt", "token", "password",
)
BASE = KINDS[:4]

MIN_SCORE = 0.6
#: Code points before and after a span that are searched for context words.
NEARBY = 40

#: Score of a confirmed span without context, and the words that raise it.
SCORES = {
    "email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.9, "ssn": 0.3, "national_id": 0.8, "npi": 0.3, "ip6": 0.7,
    "local_phone": 0.5, "birth_date": 0.3, "private_key": 1.0, "jwt": 1.0, "token": 0.9, "password": 0.8,
}
RAISE = 0.4
CONTEXT = {
    "email": ("mail", "contact", "write"),
    "ip": ("ip", "address", "host", "server"),
    "card": ("card", "visa", "credit", "payment", "karte", "carte", "tarjeta"),
    "phone": ("phone", "call", "tel", "mobile", "fax"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
    "ssn": ("ssn", "social security", "tax id", "taxpayer"),
    "national_id": ("dni", "nie", "nir", "cpf", "codice fiscale", "steuer", "identit", "tax", "sécurité sociale"),
    "npi": ("npi", "provider", "physician"),
    "ip6": ("ip", "ipv6", "address", "host", "server"),
    "local_phone": ("phone", "call", "tel", "mobile", "fax", "cell", "text me", "dial"),
    "birth_date": ("born", "birth", "birthday", "dob", "geboren", "geburtsdatum", "naissance", "nacimiento", "nacid"),
    "token": ("token", "key", "secret", "auth"),
}
#: Words that lower a score, of all kinds and of some; whole words, as ``order`` must not match ``border``.
LOWER = 0.4
AGAINST = ("example", "sample", "dummy", "placeholder", "fictitious")
AGAINST_KIND = {
    "ip": ("version", "release", "section"),
    "card": ("isbn", "serial", "part no", "order", "tracking"),
    "ssn": ("part", "part no", "serial", "order", "model", "sku"),
    "npi": ("order", "isbn", "serial"),
    "local_phone": ("part no", "serial", "order", "model", "isbn", "sku"),
    "birth_date": ("released", "published", "founded"),
    "password": ("choose", "forgot", "your password is required"),
}

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
# The first character is read before the look-behind, so the search can skip to it.
_SPANISH = re.compile(r"[0-9XYZ](?<![0-9A-Za-z].)[0-9]{6,7}-?[A-Z](?![0-9A-Za-z])")
_FRENCH = re.compile(r"[12](?<![0-9A-Za-z].) ?[0-9]{2} ?(?:0[1-9]|1[0-2]) ?(?:[0-9]{2}|2[AB]) ?[0-9]{3} ?[0-9]{3} ?[0-9]{2}(?![0-9A-Za-z])")
_ITALIAN = re.compile(r"[A-Z](?<![0-9A-Za-z].)[A-Z]{5}[0-9]{2}[A-EHLMPRST][0-9]{2}[A-Z][0-9]{3}[A-Z](?![0-9A-Za-z])")
_BRAZILIAN = re.compile(r"[0-9](?<![0-9A-Za-z].)[0-9]{2}\.[0-9]{3}\.[0-9]{3}-[0-9]{2}(?![0-9A-Za-z])")
_GERMAN = re.compile(r"[1-9](?<![0-9A-Za-z].)[0-9](?:[0-9]{9}| [0-9]{3} [0-9]{3} [0-9]{3})(?![0-9A-Za-z])")
_NPI = re.compile(r"[12](?<![0-9A-Za-z].)[0-9]{9}(?![0-9A-Za-z])")
_IP6 = re.compile(r"(?<![0-9A-Za-z:.])[0-9A-Fa-f]{0,4}+(?::[0-9A-Fa-f]{0,4}+){2,7}+(?![0-9A-Za-z:.])")
_LOCAL_PHONE = re.compile(r"[(2-9](?<![0-9A-Za-z+(].)(?:(?<=\()[2-9][0-9]{2}\) ?|(?<=[2-9])[0-9]{2}[-. ])[2-9][0-9]{2}[-. ][0-9]{4}(?![0-9A-Za-z])")
_DATE = re.compile(r"[0-9](?<![0-9A-Za-z].)[0-9]{0,3}([-/.])([0-9]{1,2})\1([0-9]{4}|[0-9]{1,2})(?![0-9A-Za-z])")
_PEM = re.compile(r"-----BEGIN ((?:[A-Z0-9]{1,20} ){0,3}PRIVATE KEY(?: BLOCK)?)-----")
_JWT = re.compile(r"eyJ(?<![A-Za-z0-9_.-]...)[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++")
# Prefixes that issuers publish for their keys, with the lengths of what follows.
_TOKEN = re.compile(
    r"(?:AKIA|ASIA)[A-Z0-9]{16}|AIza[A-Za-z0-9_-]{35}|gh[pousr]_[A-Za-z0-9]{36,251}|github_pat_[A-Za-z0-9_]{22,255}|glpat-[A-Za-z0-9_-]{20,64}"
    r"|xox[abprs]-[A-Za-z0-9-]{10,250}|[sr]k_(?:live|test)_[A-Za-z0-9]{16,250}|sk-[A-Za-z0-9_-]{20,250}|npm_[A-Za-z0-9]{36}"
    r"|SG\.[A-Za-z0-9_-]{22}\.[A-Za-z0-9_-]{43}|hf_[A-Za-z0-9]{34,64}|pypi-[A-Za-z0-9_-]{50,250}"
)
_PAIR = re.compile(r"[:=]")
_NAME = re.compile(r"(?:password|passwd|passphrase|pwd|secret|api[_-]?key|access[_-]?key|token)[\"']?[\x20\t]{0,3}$", re.I)
_VALUE = re.compile(r"[\x20\t]{0,3}[\"']?([^\s\"',;<>]{6,128}+)(?![^\s\"',;<>])")


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """Country and check digits go to the end, letters become two digits; the rest by 97 is 1."""
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def _digits(text: str) -> str:
    return re.sub(r"[^0-9]", "", text)


def entropy(text: str) -> float:
    """Bits per character by the text's own frequencies."""
    return -sum(n / len(text) * math.log2(n / len(text)) for n in Counter(text).values())


def _given_out(ssn: str) -> bool:
    area, group, serial = ssn.split("-")
    return area not in ("000", "666") and area < "900" and group != "00" and serial != "0000"


def _spanish(code: str) -> bool:
    code = code.replace("-", "")
    digits = str("XYZ".find(code[0])) + code[1:-1] if code[0] in "XYZ" else code[:-1]
    # Fixed value: the letters by remainder.
    return len(digits) == 8 and "TRWAGMYFPDXBNJZSQVHLCKE"[int(digits) % 23] == code[-1]


def _french(code: str) -> bool:
    code = code.replace(" ", "").replace("2A", "19").replace("2B", "18")
    return 97 - int(code[:13]) % 97 == int(code[13:])


def _italian(code: str) -> bool:
    # What a digit, or the letter of the same number, counts at odd places.
    odd = (1, 0, 5, 7, 9, 13, 15, 17, 19, 21, 2, 4, 18, 20, 11, 3, 6, 8, 12, 14, 16, 10, 22, 25, 24, 23)
    places = [int(c) if c.isdigit() else ord(c) - 65 for c in code[:15]]
    return (sum(odd[p] for p in places[::2]) + sum(places[1::2])) % 26 == ord(code[15]) - 65


def _brazilian(code: str) -> bool:
    d = [int(c) for c in _digits(code)]
    check = lambda n: sum(x * (n + 1 - k) for k, x in enumerate(d[:n])) * 10 % 11 % 10
    return len(set(d)) > 1 and d[9] == check(9) and d[10] == check(10)


def _german(code: str) -> bool:
    d = [int(c) for c in _digits(code)]
    product = 10
    for x in d[:10]:
        product = ((product + x) % 10 or 10) * 2 % 11
    # Of the first ten digits one occurs twice or three times, the others once at most.
    twice = sorted(Counter(d[:10]).values())[-2:]
    return twice[1] in (2, 3) and twice[0] == 1 and (11 - product) % 10 == d[10]


def _address6(text: str) -> bool:
    if text.count(":") < 2 or sum(map(text.count, "0123456789abcdefABCDEF")) < 6:
        return False
    try:
        address = ipaddress.IPv6Address(text)
    except ValueError:
        return False
    return not (address.is_loopback or address.is_unspecified)


def _date(m: re.Match) -> bool:
    """Year first or last; of the other two numbers, either may be the month."""
    first = m[0].split(m[1])[0]
    year, day = (first, m[3]) if len(first) == 4 else (m[3], first)
    if len(year) != 4 or len(day) > 2 or not 1900 <= int(year) <= 2100:
        return False
    for month, other in ((int(m[2]), int(day)), (int(day), int(m[2]))):
        try:
            datetime.date(int(year), month, other)
            return True
        except ValueError:
            pass
    return False


def _jwt(text: str) -> bool:
    head = text.split(".")[0]
    try:
        got = json.loads(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4)))
    except (ValueError, RecursionError):
        return False
    return isinstance(got, dict) and "alg" in got


def _strong(value: str) -> bool:
    """A secret rather than a word: two classes of characters, and no run of one or two."""
    classes = sum(bool(re.search(c, value)) for c in ("[a-z]", "[A-Z]", "[0-9]", r"[^a-zA-Z0-9.():\[\]{}\u2026]"))
    return classes >= 2 and entropy(value) >= 2.3 and not value.startswith(("http:", "https:", "//", "${", "{{", "$("))


def _secrets(text: str) -> Iterator[tuple[str, int, int]]:
    upto = 0
    while m := _PEM.search(text, upto):
        line = f"-----END {m[1]}-----"
        end = text.find(line, m.end())
        upto = end + len(line) if end >= 0 else len(text)
        yield "private_key", m.start(), upto
    for m in _JWT.finditer(text):
        if _jwt(m[0]):
            yield "jwt", *m.span()
    for m in _TOKEN.finditer(text):
        before, after = text[m.start() - 1 : m.start()], text[m.end() : m.end() + 1]
        if not (before.isalnum() or after.isalnum()) and entropy(m[0]) >= 3.0:
            yield "token", *m.span()
    for m in _PAIR.finditer(text):
        if _NAME.search(text, max(0, m.start() - 16), m.start()):
            v = _VALUE.match(text, m.end())
            if v and _strong(v[1].rstrip(".)")):
                yield "password", v.start(1), v.start(1) + len(v[1].rstrip(".)"))


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """By their @: the local part reaches back over its characters, not into the last match."""
    end = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def _proposed(text: str) -> Iterator[tuple[str, int, int]]:
    """Spans that their validators confirm, by kind and start."""
    for start, end in _emails(text):
        yield "email", start, end
    for m in _IP.finditer(text):
        if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in m[0].split(".")):
            yield "ip", *m.span()
    for m in _CARD.finditer(text):
        if len(m[0]) <= 37 and 13 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            yield "card", *m.span()
    for m in _PHONE.finditer(text):
        if 9 <= len(_digits(m[0])) <= 15:
            yield "phone", *m.span()
    for m in _IBAN.finditer(text):
        if mod97(m[0].replace(" ", "")):
            yield "iban", *m.span()
    for m in _SSN.finditer(text):
        if _given_out(m[0]):
            yield "ssn", *m.span()
    national = ((_SPANISH, _spanish), (_FRENCH, _french), (_ITALIAN, _italian), (_BRAZILIAN, _brazilian), (_GERMAN, _german))
    for start, end in sorted(m.span() for pattern, holds in national for m in pattern.finditer(text) if holds(m[0])):
        yield "national_id", start, end
    for m in _NPI.finditer(text):
        if luhn("80840" + m[0]):
            yield "npi", *m.span()
    if "::" in text or text.count(":") >= 7:
        for m in _IP6.finditer(text):
            if _address6(m[0]):
                yield "ip6", *m.span()
    for m in _LOCAL_PHONE.finditer(text):
        yield "local_phone", *m.span()
    for m in _DATE.finditer(text):
        if _date(m):
            yield "birth_date", *m.span()
    yield from _secrets(text)


def _base_score(kind: str, found: str) -> float:
    """Weaker or stronger than the kind's score by the form of the span."""
    if kind == "local_phone" and found[0] == "(":
        return 0.7
    if kind == "national_id" and found.replace(" ", "").isdigit() and len(_digits(found)) == 11:
        return 0.3  # eleven digits with one checksum: by context only
    return SCORES[kind]


def _listed(words: tuple[str, ...], text: str, end: str = "") -> bool:
    return bool(words) and re.search(rf"\b(?:{'|'.join(words)}){end}", text) is not None


def spans(text: str) -> list[Span]:
    out: list[Span] = []
    covered = bytearray()
    for kind, start, end in _proposed(text):
        covered = covered or bytearray(len(text))
        if kind not in BASE and covered.find(0, start, end) < 0:
            continue
        around = (text[max(0, start - NEARBY) : start] + " " + text[end : end + NEARBY]).lower()
        score = _base_score(kind, text[start : end]) + RAISE * _listed(CONTEXT.get(kind, ()), around)
        score -= LOWER * _listed(AGAINST + AGAINST_KIND.get(kind, ()), around, r"\b")
        score = max(0.0, min(1.0, score))
        if kind in BASE or score >= MIN_SCORE:
            out.append(Span(kind, start, end, score))
            covered[start:end] = b"\1" * (end - start)
    return out


def find(docs: DataFrame, carry: str = "doc_id", text: str = "text") -> DataFrame:
    """``carry`` and its spans, an array of (kind, start, end, score), for every row."""

    @F.pandas_udf("array<struct<kind: string, start: int, end: int, score: double>>")
    def run(texts):
        return texts.map(lambda t: [s._asdict() for s in spans(bytes(t or b"").decode("utf-8", "replace"))])

    once = run.asNondeterministic()  # a filter on spans must not repeat the search
    return docs.select(carry, F.expr(f"cast(coalesce({text}, '') as binary)").alias("t")).select(carry, once("t").alias("spans"))


def redacted(docs: DataFrame, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """The documents with ``[KIND]`` in place of each span; of overlapping spans the first counts."""

    @F.pandas_udf("string")
    def run(texts):
        def one(t):
            if t is None:
                return None
            t = bytes(t).decode("utf-8", "replace")
            out, upto = [], 0
            for s in sorted((s for s in spans(t) if s.kind in kinds), key=lambda s: (s.start, -s.end)):
                if s.start >= upto:
                    out += [t[upto : s.start], f"[{s.kind.upper()}]"]
                    upto = s.end
            return "".join(out) + t[upto:]

        return texts.map(one)

    return docs.withColumn("text", run(F.col("text").cast("binary")))


def digest(found: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256, spans as text."""
    as_text = "concat_ws(',', transform({}, s -> concat_ws(':', s.kind, s.start, s.end)))"
    base = "filter(spans, s -> s.kind in (" + ", ".join(f"'{k}'" for k in BASE) + "))"
    return found.select(
        "doc_id",
        *(F.expr(f"cast(size(filter(spans, s -> s.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in BASE),
        F.sha2(F.expr(as_text.format(base)), 256).alias("base_sha256"),
        F.expr(as_text.format("spans")).alias("spans"),
    )
