"""Text statistics per document as column expressions, shared by rules and classifier.

A chain of projections without a shuffle; each costly array is its own column, so it
is computed once. NULL text has no words and all counts 0.

Repeated windows: hashes tell whether any window of a text can repeat. Only then are
its windows themselves sorted and compared with their neighbours, so equal hashes of
different windows do no harm. This takes n log n steps for a text of any length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlsight.llm.common import SPACE, sql_pattern, words

#: Words of a window.
WINDOW = 5

#: Rates that rules and classifier learn from.
RATES = (
    "log_words",
    "mean_word",
    "symbol_rate",
    "dup_line_rate",
    "repeat_rate",
    "upper_rate",
    "bang_rate",
    "stop_rate",
    "digit_rate",
    "line_words",
    "short_word_rate",
)


def _without(chars: str) -> str:
    """SQL: how many characters of ``t`` are in the class ``chars``."""
    return f"length(t) - length(regexp_replace(t, {sql_pattern('[' + chars + ']+')}, ''))"


def base_counts(docs: DataFrame, *, more: bool = False, carry: str = "doc_id", text: str = "text") -> DataFrame:
    """``carry``, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, with ``more`` also counts for ``RATES``.

    ``carry`` is a column to keep, ``text`` the column to read.
    """
    rows = docs.select(carry, F.expr(f"coalesce({text}, '')").alias("t"))
    rows = rows.select(carry, "t", F.expr(words("t")).alias("w"))
    rows = rows.select(carry, "t", "w", F.expr("transform(w, x -> xxhash64(x))").alias("wh"))
    last = WINDOW - 1
    hashes = ", ".join(f"element_at(wh, i + {k})" for k in range(WINDOW))
    rows = rows.select(
        carry,
        "t",
        "w",
        "wh",
        F.expr(f"if(size(wh) > {last}, transform(sequence(1, size(wh) - {last}), i -> xxhash64({hashes})), array())").alias("h"),
        F.expr(f"filter(split(t, '\\n'), x -> x rlike {sql_pattern('[^' + SPACE + ']')})").alias("lines"),
    )
    counts = [
        F.expr("cast(size(w) as bigint)").alias("n_words"),
        F.expr("cast(length(array_join(w, '')) as bigint)").alias("word_chars"),
        F.expr(f"cast({_without('#*$%&|<>')} as bigint)").alias("n_symbols"),
        F.expr("cast(size(lines) - size(array_distinct(lines)) as bigint)").alias("n_dup_lines"),
    ]
    if more:
        counts += [
            F.expr("cast(size(lines) as bigint)").alias("n_lines"),
            F.expr(f"cast({_without(chr(92) + 'p{Lu}')} as bigint)").alias("n_upper"),
            F.expr(f"cast({_without('!?')} as bigint)").alias("n_bang"),
            F.expr(f"cast({_without('.,;:')} as bigint)").alias("n_stops"),
            F.expr(f"cast({_without('0-9')} as bigint)").alias("n_digits"),
            F.expr("cast(size(filter(w, x -> length(x) <= 3)) as bigint)").alias("n_short"),
        ]
    named = [c for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines")] + (
        ["n_lines", "n_upper", "n_bang", "n_stops", "n_digits", "n_short"] if more else []
    )
    rows = rows.select(carry, F.when(F.expr("size(h) > size(array_distinct(h))"), F.col("w")).alias("w"), *counts)
    # Windows of the few texts with a repeat, sorted: equal ones are neighbours.
    window = "array_join(slice(w, i, " + str(WINDOW) + "), ' ')"
    rows = rows.select(
        carry,
        *named,
        F.expr(
            f"if(w is not null, array_sort(transform(sequence(1, size(w) - {last}), i -> struct({window} as x, i as i))), array())"
        ).alias("s"),
    )
    rows = rows.select(
        carry,
        *named,
        F.expr(
            "array_sort(transform(filter(s, (e, k) -> e.x <=> get(s, k - 1).x or e.x <=> get(s, k + 1).x), e -> e.i))"
        ).alias("at"),
    )
    repeat = F.expr(
        f"aggregate(at, struct(cast(-{WINDOW} as int) as last, 0L as n),"
        f" (a, i) -> struct(i as last, a.n + cast(least({WINDOW}, i - a.last) as bigint) as n), a -> a.n)"
    ).alias("n_repeat_words")
    return rows.select(carry, *named[:4], repeat, *named[4:])


def rates() -> list:
    """Columns ``RATES`` from the counts; 0 where nothing is counted."""

    def over(a: str, b: str) -> str:
        return f"coalesce(try_divide(cast({a} as double), {b}), 0D)"

    sql = {
        "log_words": "ln(1D + n_words)",
        "mean_word": over("word_chars", "n_words"),
        "symbol_rate": over("n_symbols", "word_chars"),
        "dup_line_rate": over("n_dup_lines", "n_lines"),
        "repeat_rate": over("n_repeat_words", "n_words"),
        "upper_rate": over("n_upper", "word_chars"),
        "bang_rate": over("n_bang", "n_words"),
        "stop_rate": over("n_stops", "n_words"),
        "digit_rate": over("n_digits", "word_chars"),
        "line_words": over("n_words", "n_lines"),
        "short_word_rate": over("n_short", "n_words"),
    }
    return [F.expr(sql[k]).alias(k) for k in RATES]
