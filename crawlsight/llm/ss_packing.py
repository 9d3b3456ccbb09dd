"""Packing documents into token sequences by the sum-of-squares rule.

A document's ids are cut into pieces of at most `capacity` ids, whole pieces but for the last.
Each piece goes to the open sequence that leaves the squared counts of open sequences per
residual gap smallest in sum, in ties the fullest; where none has room, a new one is opened. Long
pieces are placed first.

Pieces are dealt evenly over groups of about `GROUP_TOKENS` ids, whatever their source or
document, and each group is packed on its own; only lengths are shuffled. The pieces of sequences
that a group left short are packed again in fewer groups, as long as that halves the groups.

Defined results: a null or empty text is one piece with the end id alone. Every row is a document
of its own, repeated rows and ids included. Other columns are not read. An empty table gives an
empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import checkpointed, text_bytes

CAPACITY = 4096
END_ID = 1
GROUP_TOKENS = 2_000_000
SHORT = 0.98  # sequences filled less than this are packed again

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID,
           id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """A row for each piece of each document: doc_id, piece, start, length, ids_crc32.

    With `with_ids` also `ids`, the piece's ids as little-endian unsigned 32-bit integers.
    """
    name = tokens.ship(docs.sparkSession, tokenizer)
    end = int(end_id).to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoder(name).encode
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode(text.as_py()) + end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at:at + 4 * capacity]
                    for column, value in zip(out, (doc, piece, at // 4, len(part) // 4, zlib.crc32(part),
                                                   part if with_ids else None)):
                        column.append(value)
            arrays = [pa.array(c, t) for c, t in zip(out, (
                pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            width = 5 + with_ids
            yield pa.RecordBatch.from_arrays(arrays[:width], names[:width])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("text")
                       ).mapInArrow(cut, PIECES + (", ids binary" if with_ids else ""))


def place(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each piece, for pieces in the order given."""
    counts = np.zeros(capacity + 1)
    counts[0] = -0.5  # filling a sequence adds no open one: its term 2 * counts + 1 is zero
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    opened = 0
    for i, size in enumerate(lengths.tolist()):
        before, after = counts[size:], counts[:capacity + 1 - size]
        fits = np.flatnonzero(before > 0)
        if len(fits):
            left = int(fits[np.argmin(after[fits] - before[fits])])
            gap = left + size
            where = open_at[gap].pop()
            counts[gap] -= 1
        else:
            gap, where = capacity, opened
            left, opened = gap - size, opened + 1
        sequence[i], offset[i] = where, capacity - gap
        if left:
            open_at[left].append(where)
            counts[left] += 1
    return sequence, offset


def pack(items: DataFrame, capacity: int = CAPACITY, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """(row_no, sequence_id, offset) for checkpointed items (row_no, length), 1 to `capacity` each."""

    def pack_group(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "row_no"], ascending=[False, True], kind="stable")
        sequence, offset = place(pdf["length"].to_numpy(), capacity)
        filled = np.bincount(sequence, weights=pdf["length"]).astype(np.int64)
        return pd.DataFrame({
            "row_no": pdf["row_no"], "length": pdf["length"], "offset": offset,
            "sequence_id": (int(pdf["level"].iloc[0]) << 56) + (pdf["grp"].to_numpy() << 24) + sequence,
            "filled": filled[sequence]})

    def groups_of(rows: DataFrame) -> int:
        return int((rows.agg(F.sum("length")).first()[0] or 0) // group_tokens) + 1

    done, level, left = [], 0, items.select("row_no", "length")
    groups = groups_of(left)
    while True:
        packed = checkpointed(left.select(
            "row_no", "length", F.lit(level).alias("level"),
            F.pmod(F.xxhash64("row_no", F.lit(level)), F.lit(groups)).cast("long").alias("grp")
        ).groupBy("grp").applyInPandas(
            pack_group, "row_no long, length long, offset long, sequence_id long, filled long"))
        short = packed.filter(F.col("filled") < F.lit(int(SHORT * capacity)))
        fewer = groups_of(short) if groups > 1 else groups
        if 2 * fewer > groups:  # nothing to gain: one group, or lengths that never fill a sequence
            done.append(packed)
            break
        done.append(packed.filter(F.col("filled") >= F.lit(int(SHORT * capacity))))
        left, level, groups = short.select("row_no", "length"), level + 1, fewer
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select("row_no", "sequence_id", "offset")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every piece with its sequence: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    cut = checkpointed(pieces(docs, tokenizer, capacity, end_id, id_col, text_col)
                       .withColumn("row_no", F.monotonically_increasing_id()))
    return cut.join(pack(cut, capacity), "row_no").drop("row_no")
