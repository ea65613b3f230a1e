"""Types named in JSON-LD. Nesting is unbounded, which column expressions cannot follow."""

from __future__ import annotations

import json
import re
import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The helper travels with the task, so executors need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

TYPES_SCHEMA = T.StructType(
    [
        T.StructField("types", T.ArrayType(T.StringType())),
        T.StructField("parsed", T.BooleanType()),
    ]
)

# Keys that are not searched for nested nodes.
_NOT_NESTED = ("@type", "@context", "@graph")


def _parse(text: str):
    """Parsed value in a 1-tuple, or None. Comments and trailing commas are forgiven."""
    repaired = re.sub(r",\s*([}\]])", r"\1", re.sub(r"(?s)/\*.*?\*/", "", text))
    for candidate in (text, repaired):
        try:
            return (json.loads(candidate),)
        except (ValueError, RecursionError):
            pass
    return None


def _types(root) -> list[str]:
    """Types in pre-order: a node's own, its @graph, then its other members."""
    found: list[str] = []
    pending = [root]
    while pending:
        node = pending.pop()
        if isinstance(node, list):
            pending.extend(reversed(node))
        elif isinstance(node, dict):
            own = node.get("@type")
            found += [str(t) for t in (own if isinstance(own, list) else [own]) if t]
            members = [v for k, v in node.items() if k not in _NOT_NESTED]
            pending.extend(reversed([node.get("@graph"), *members]))
    return found


@F.pandas_udf(TYPES_SCHEMA)
def json_ld_types(blocks: pd.Series) -> pd.DataFrame:
    rows = []
    for texts in blocks:
        docs = []
        if texts is not None and len(texts):
            docs = [d for d in (_parse(t.strip()) for t in texts if t.strip()) if d]
        types = dict.fromkeys(t for (d,) in docs for t in _types(d))
        rows.append((list(types), bool(docs)))
    return pd.DataFrame(rows, columns=["types", "parsed"])
