"""Near-duplicate groups by SimHash fingerprints and multi-index hashing.

A fingerprint has 64 bits: over a text's word shingles (repeats included) a bit is set if it is
set in more than half of their XXH64 values. Two fingerprints link if they differ in at most two
bits, so within one of their two 32-bit segments they differ in at most one. Every fingerprint
looks up the Hamming ball of radius one around each of its segments in a table of segments, and
matches are verified on all 64 bits. Of two segments one bit apart only the one without the bit
looks up the other, which halves the ball.

A segment value with more than `BUCKET` fingerprints is a hot bucket: matching there would give a
pair for every two of them. All fingerprints that hold or look up a hot segment are linked exactly
in another way: each names the 65 values at most one bit away from it, and those that name the
same value lie within two bits of each other. A value has 65 such fingerprints at most, so the
work is in proportion to the fingerprints.

Only distinct fingerprints are matched; copies count once. Groups are connected components.

Defined results: lower-casing is of A-Z, words are runs of other characters than
`[\\x20\\x09-\\x0D]`. A text of fewer words than a shingle is one shingle; a null, empty or blank
text has the fingerprint zero, which links like any other. A repeated row links to itself. A null
id never names a group unless all of its ids are null. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, lookup, text_bytes
from .components import components

SHINGLE_WORDS = 3
SEED = 42
BITS = 2       # most differing bits of a link
BUCKET = 64    # fingerprints of one segment value that are still matched one by one
_SLICE = 1 << 16


def fingerprint(text: bytes, n: int = SHINGLE_WORDS) -> int:
    """Unsigned 64-bit SimHash of a UTF-8 text."""
    words = text.lower().split()  # of bytes: A-Z and the six ASCII blanks only
    if not words:
        return 0
    if len(words) <= n:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    count, ones = len(words) - n + 1, np.zeros(64, np.int64)
    for at in range(0, count, _SLICE):
        parts = [words[at + k:at + k + min(_SLICE, count - at)] for k in range(n)]
        hashes = np.array([digest(join(p), SEED) for p in zip(*parts)], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(
            axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > count, bitorder="little").view("<u8")[0])


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = np.array([fingerprint(t.as_py()) for t in batch.column(2)], np.uint64)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(values.view(np.int64))],
            ["doc_id", "text_key", "fp"])


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> list:
    return [F.col(id_col).cast("long").alias("doc_id"),
            F.xxhash64(text_bytes(text_col)).alias("text_key")]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_key, fp) of every row: fp is the fingerprint as a signed long, text_key a
    hash of the text that tells apart rows of one id."""
    return docs.select(*_keyed(docs, id_col, text_col), text_bytes(text_col).alias("text")
                       ).mapInArrow(_fingerprint_batches, "doc_id long, text_key long, fp long")


# a segment key is the segment's number above its 32 bits
_SEGMENTS = "array(fp & 4294967295L, shiftrightunsigned(fp, 32) | 4294967296L)"
_BALL = ("concat(array(s), transform(filter(sequence(0, 31), i -> (shiftrightunsigned(s, i) & 1L) = 0),"
         " i -> s | shiftleft(1L, i)))")
_NEAR = "concat(array(fp), transform(sequence(0, 63), i -> fp ^ shiftleft(1L, i)))"


def links(distinct: DataFrame) -> DataFrame:
    """Edges (u, v) whose components are those of all links among distinct fingerprints `fp`."""
    table = distinct.select("fp", F.explode(F.expr(_SEGMENTS)).alias("s"))
    probes = table.select("fp", F.explode(F.expr(_BALL)).alias("s"))
    hot = checkpointed(table.groupBy("s").count().filter(F.col("count") > BUCKET).select("s"))
    no_hot = hot.isEmpty()
    if not no_hot:
        crowded = table.join(hot, "s", "left_semi").select("fp").unionByName(
            probes.join(hot, "s", "left_semi").select("fp")).distinct()
        table = table.join(hot, "s", "left_anti")
    other = table.select(F.col("fp").alias("v"), "s")
    near = probes.join(other, "s").filter(
        f"fp <> v AND bit_count(fp ^ v) <= {BITS}").select(
        F.least("fp", "v").alias("u"), F.greatest("fp", "v").alias("v"))
    if no_hot:
        return near.distinct()
    balls = crowded.select("fp", F.explode(F.expr(_NEAR)).alias("near"))
    stars = (balls.groupBy("near").agg(F.collect_set("fp").alias("fps")).filter(F.size("fps") > 1)
             .select(F.array_min("fps").alias("u"), F.explode("fps").alias("v")).filter("u <> v"))
    return near.unionByName(stars).distinct()


def groups(prints: DataFrame) -> DataFrame:
    """Checkpointed rows (doc_id, text_key, fp) with component_id and root, the component's
    smallest fingerprint."""
    by_print = checkpointed(prints.groupBy("fp").agg(
        F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id")))
    total = by_print.agg(F.sum("n")).first()[0] or 0
    roots = components(links(by_print.select("fp"))).withColumnRenamed("node", "fp")
    linked = checkpointed(by_print.join(roots, "fp").select("fp", "first_id", "root"))
    smallest = linked.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = by_print.join(linked.drop("first_id").join(smallest, "root"), "fp", "left").select(
        "fp", "n", F.coalesce("root", "fp").alias("root"),
        F.when(F.col("root").isNull(), F.col("first_id")).otherwise(F.col("component_id")).alias("component_id"))
    return lookup(prints, checkpointed(named), "fp", "n", total).drop("n")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_key, fp, component_id, root) of every row."""
    return groups(checkpointed(fingerprints(docs, id_col, text_col)))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group, the one with the smallest id, with all its columns.

    Of rows that repeat that id with one text, any one stays.
    """
    found = near_duplicates(docs, id_col, text_col)
    best = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key"))
    stay = checkpointed(found.groupBy("root").agg(best.alias("best")).select("best.doc_id", "best.text_key"))
    keyed = docs.select(F.struct("*").alias("row"), *_keyed(docs, id_col, text_col))
    kept = keyed.join(stay, keyed["doc_id"].eqNullSafe(stay["doc_id"])
                      & (keyed["text_key"] == stay["text_key"]), "left_semi")
    repeated = found.join(stay, found["doc_id"].eqNullSafe(stay["doc_id"])
                          & (found["text_key"] == stay["text_key"]), "left_semi").groupBy(
        found["doc_id"], found["text_key"]).count().filter("count > 1")
    if not repeated.isEmpty():
        kept = kept.dropDuplicates(["doc_id", "text_key"])
    return kept.select("row.*")
