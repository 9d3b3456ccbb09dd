"""Packed token-id matrices for training: best-fit-decreasing sequences as binary rows.

Documents are tokenised, an end id is appended, and overlong ones are cut into pieces of at most
`capacity` ids, none lost. Each task packs the pieces it reads, `CHUNK_TOKENS` ids at a time, by
best fit on falling length; a segment tree over residual capacities finds the tightest sequence
with room. Sequences that a chunk leaves short are packed again with the next chunk. At most
`CARRIED_TOKENS` ids are carried over, so where more are in short sequences the fullest of these
are written. Ids are never shuffled.

A row is one sequence: `ids` and `position_ids` are rows of capacity little-endian unsigned
integers (16 bits each where ids and capacity fit, else 32), padded with `pad_id`; positions
restart at zero with every segment and in the padding. `cu_seqlens` has the segments' cumulative
lengths from 0 on, without the padding. `doc_ids`, `pieces` and `starts` say what each segment is.

Defined results: a null or empty text is the end id alone. Every row is a document of its own. A
null id stays null. Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import text_bytes

CAPACITY = 4096
END_ID = 1
PAD_ID = 0
CHUNK_TOKENS = 2_000_000
CARRIED_TOKENS = CHUNK_TOKENS // 2
SHORT = 0.98

SCHEMA = ("sequence_id long, n_tokens int, ids binary, position_ids binary, cu_seqlens array<int>, "
          "doc_ids array<long>, pieces array<int>, starts array<long>")


class GapTree:
    """Segment tree over gaps 0 to capacity; a leaf counts the sequences with that gap."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, gap: int, change: int) -> None:
        at = gap + self.leaves
        while at:
            self.count[at] += change
            at >>= 1

    def tightest(self, size: int) -> int:
        """The smallest gap of at least `size`, or -1."""
        count, at = self.count, size + self.leaves
        if not count[at]:
            # up to the first right sibling that holds a sequence, then down its left edge
            while at > 1 and (at & 1 or not count[at + 1]):
                at >>= 1
            if at <= 1:
                return -1
            at += 1
            while at < self.leaves:
                at *= 2
                at += not count[at]
        return at - self.leaves


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Sequences as lists of positions in `lengths`."""
    tree, at_gap = GapTree(capacity), [[] for _ in range(capacity + 1)]
    sequences: list[list[int]] = []
    for i in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        gap = tree.tightest(lengths[i])
        if gap < 0:
            gap, where = capacity, len(sequences)
            sequences.append([])
        else:
            where = at_gap[gap].pop()
            tree.add(gap, -1)
        sequences[where].append(i)
        if left := gap - lengths[i]:
            at_gap[left].append(where)
            tree.add(left, 1)
    return sequences


def packed_matrices(docs: DataFrame, tokenizer: str, vocabulary: int, capacity: int = CAPACITY,
                    end_id: int = END_ID, pad_id: int = PAD_ID, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """One row per sequence, see the module. `vocabulary` is the number of ids."""
    name = tokens.ship(docs.sparkSession, tokenizer)
    kind = "<u2" if max(vocabulary, capacity) <= 1 << 16 else "<u4"
    end = int(end_id).to_bytes(4, "little")

    def rows(segments: list[tuple], sequences: list[list[int]], first: int) -> pa.RecordBatch:
        out: list[list] = [[] for _ in range(8)]
        for number, members in enumerate(sequences):
            ids, positions = np.full(capacity, pad_id, kind), np.zeros(capacity, kind)
            bounds = [0]
            for i in members:
                part = segments[i][3]
                to = bounds[-1] + len(part)
                ids[bounds[-1]:to] = part
                positions[bounds[-1]:to] = np.arange(len(part))
                bounds.append(to)
            positions[bounds[-1]:] = np.arange(capacity - bounds[-1])
            for column, value in zip(out, (
                    first + number, bounds[-1], ids.tobytes(), positions.tobytes(), bounds,
                    *([segments[i][k] for i in members] for k in range(3)))):
                column.append(value)
        kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int32()),
                 pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(out, kinds)], [f.split()[0] for f in SCHEMA.split(", ")])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoder(name).encode
        next_id = TaskContext.get().partitionId() << 32
        waiting: list[tuple] = []
        held = 0

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal waiting, held, next_id
            lengths = [len(s[3]) for s in waiting]
            sequences = best_fit_decreasing(lengths, capacity)
            kept: list[tuple] = []
            if not last:
                sizes = [sum(lengths[i] for i in s) for s in sequences]
                order = sorted(range(len(sequences)), key=lambda k: -sizes[k])
                left, n = held, 0
                # the fullest go out: all full ones, and others until what stays is within the bound
                while n < len(order) and (sizes[order[n]] >= SHORT * capacity or left > CARRIED_TOKENS):
                    left -= sizes[order[n]]
                    n += 1
                kept = [waiting[i] for k in order[n:] for i in sequences[k]]
                sequences = [sequences[k] for k in order[:n]]
            for at in range(0, len(sequences), 256):
                some = sequences[at:at + 256]
                yield rows(waiting, some, next_id)
                next_id += len(some)
            waiting, held = kept, sum(len(s[3]) for s in kept)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.frombuffer(encode(text.as_py()) + end, "<u4").astype(kind)
                for piece, at in enumerate(range(0, len(ids), capacity)):
                    waiting.append((doc, piece, at, ids[at:at + capacity]))
                held += len(ids)
                if held >= CHUNK_TOKENS:
                    yield from flush(False)
        if waiting:
            yield from flush(True)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("text")
                       ).mapInArrow(pack, SCHEMA)


def write(sequences: DataFrame, path: str) -> None:
    sequences.write.parquet(path)


def segments(sequences: DataFrame, kind: str = "<u2") -> DataFrame:
    """The packed segments again: doc_id, piece, start, ids (array), positions (array)."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(5)]
            for row in batch.to_pylist():
                ids, positions = (np.frombuffer(row[c], kind) for c in ("ids", "position_ids"))
                for k, (a, b) in enumerate(zip(row["cu_seqlens"], row["cu_seqlens"][1:])):
                    for column, value in zip(out, (row["doc_ids"][k], row["pieces"][k], row["starts"][k],
                                                   ids[a:b].tolist(), positions[a:b].tolist())):
                        column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)],
                                             ["doc_id", "piece", "start", "ids", "positions"])

    return sequences.mapInArrow(
        cut, "doc_id long, piece int, start long, ids array<int>, positions array<int>")
