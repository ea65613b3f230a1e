"""Small helpers for expressions written as SQL text.

Expressions are text because a page pipeline has thousands of nodes: Spark
parses one string much faster than it receives the nodes one by one.
"""

from __future__ import annotations


def lit(value: str) -> str:
    """A SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def let(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` bound to ``value``, which is computed once."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def strings(values) -> str:
    return ", ".join(lit(v) for v in values)


NO_STRINGS = "cast(array() as array<string>)"
