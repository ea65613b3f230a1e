"""Packing token streams into sequences: concatenate and cut.

First pass: each partition tokenizes its documents and counts from its own start.
Prefix sums over the partition totals give every document's place in one stream.
Second pass: the stream is cut into fixed windows; a document that crosses a border
leaves one piece in each window. Only the last window is padded.

* NULL text is empty and leaves only its end id.
* Bytes that aren't UTF-8 are read as replacement characters.
* A text of any length is cut into as many pieces as it needs; one document's ids are in memory at a time.
* Repeated rows are packed as often as they occur. An empty table gives no rows.
* Further columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crawlsight.session import stage


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@dataclass(frozen=True)
class PackOptions:
    length: int = 2048
    end_id: int = 1
    #: Vocabulary as ranks; the same ids as the JSON form of the same name, several times faster.
    vocabulary: str = "byte_bpe_50k.tiktoken"
    special: tuple[tuple[str, int], ...] = (("<|endoftext|>", 50256),)
    rows: int = 256  # of one output batch


def encoder(options: PackOptions):
    """Text -> array of ids; special tokens are recognised in texts, as the JSON form does."""
    import public_tokenizers
    import tiktoken

    with open(public_path(options.vocabulary), "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    special = dict(options.special)
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
    allowed = set(special)
    return lambda text: own.encode_to_numpy(text, allowed_special=allowed, disallowed_special=())


_TOKENS = pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("before", pa.int64()), ("n", pa.int64()), ("ids", pa.binary())])


def tokens(docs: DataFrame, options: PackOptions = PackOptions()) -> DataFrame:
    """doc_id, part (partition), before (ids before it in the partition), n, ids (little-endian 32 bits)."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_one, part, before = encoder(options), TaskContext.get().partitionId(), 0
        end = np.array([options.end_id], "<u4").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, options.rows):
                rows = batch.slice(at, options.rows)
                ids = []
                for text in rows.column(1).cast(pa.binary()):
                    body = (text.as_py() or b"").decode("utf-8", "replace")
                    ids.append(encode_one(body).astype("<u4").tobytes() + end)
                n = np.array([len(x) // 4 for x in ids], np.int64)
                upto = np.cumsum(n)
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), pa.array(np.full(len(n), part, np.int32)), pa.array(before + upto - n), pa.array(n), pa.array(ids, pa.binary())],
                    schema=_TOKENS,
                )
                before += int(upto[-1])

    return docs.selectExpr("cast(doc_id as bigint) as doc_id", "text").mapInArrow(
        encode, "doc_id bigint, part int, before bigint, n bigint, ids binary"
    )


def pack(docs: DataFrame, options: PackOptions = PackOptions()) -> DataFrame:
    """One row per piece: doc_id, start, length, ids, doc_tokens, sequence_id, offset."""
    rows = stage(tokens(docs, options), "pack_tokens", compression="zstd")
    totals = rows.groupBy("part").agg(F.sum("n").alias("total"))
    every = Window.partitionBy(F.lit(1)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per input partition: bounded by the number of tasks of the first pass.
    offsets = F.broadcast(totals.select("part", F.coalesce(F.sum("total").over(every), F.lit(0)).alias("offset")))
    size = options.length
    placed = rows.join(offsets, "part").select("doc_id", "n", "ids", (F.col("offset") + F.col("before")).alias("g"))
    piece = f"""
    transform(sequence(g div {size}, (g + n - 1) div {size}), q -> struct(
      greatest(g, q * {size}) - g as start,
      least(g + n, (q + 1) * {size}) - greatest(g, q * {size}) as length,
      substring(ids, cast(greatest(g, q * {size}) - g as int) * 4 + 1, cast(least(g + n, (q + 1) * {size}) - greatest(g, q * {size}) as int) * 4) as ids,
      q as sequence_id,
      greatest(g, q * {size}) % {size} as offset))"""
    return placed.select("doc_id", F.col("n").alias("doc_tokens"), F.inline(F.expr(piece))).select(
        "doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"
    )


def packed(docs: DataFrame, options: PackOptions = PackOptions()) -> DataFrame:
    """``pack`` with the checksum of the ids beside them."""
    return pack(docs, options).select("*", F.crc32("ids").alias("ids_crc32"))


def pieces(docs: DataFrame, options: PackOptions = PackOptions()) -> DataFrame:
    """``pack`` with the checksum of the ids in their place."""
    return pack(docs, options).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )
