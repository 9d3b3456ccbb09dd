"""Corpus word counts, and the words frequent enough to be sent to every task."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_bytes

_HELD = 300_000  # distinct words a task holds before it passes their counts on


def word_counts(docs: DataFrame, words_of: Callable[[bytes], list[bytes]],
                text_col: str = "text") -> DataFrame:
    """(word binary, n long) over whole texts; tasks count before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(counted: Counter) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(counted.keys(), pa.binary()), pa.array(counted.values(), pa.int64())], ["word", "n"])

        held: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                held.update(words_of(text.as_py()))
                if len(held) > _HELD:
                    yield batch_of(held)
                    held = Counter()
        yield batch_of(held)

    return (docs.select(text_bytes(text_col).alias("text")).mapInArrow(count, "word binary, n long")
            .groupBy("word").agg(F.sum("n").alias("n")))


def frequent(counts: DataFrame, total: int, share: int) -> dict[bytes, int]:
    """Words with at least 1/share of all `total` occurrences; there are `share` of them at most."""
    rows = counts.filter(F.col("n") * share >= F.lit(total)).toPandas()
    return dict(sorted(zip(map(bytes, rows["word"]), rows["n"].tolist()), key=lambda r: (-r[1], r[0])))


def most_frequent(counts: DataFrame, most: int) -> tuple[dict[bytes, int], int]:
    """The most frequent words, `most` at most and those of one count together, and the least count among them."""
    by_count = counts.groupBy("n").agg(F.count(F.lit(1)).alias("kinds")).toPandas().sort_values("n", ascending=False)
    fits = by_count["n"][by_count["kinds"].cumsum() <= most]
    least = int(fits.iloc[-1]) if len(fits) else int(by_count["n"].max()) + 1 if len(by_count) else 1
    rows = counts.filter(F.col("n") >= least).toPandas()
    return dict(sorted(zip(map(bytes, rows["word"]), rows["n"].tolist()), key=lambda r: (-r[1], r[0]))), least
