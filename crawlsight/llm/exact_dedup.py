"""Exact deduplication against a persistent digest index, bucketed and sorted by digest.

A text's digest is the SHA-256 of its UTF-8 bytes after every character of `[\\x20\\x09-\\x0D]`
is deleted. `DigestIndex.add` keeps, of the new rows with a digest that the index does not hold,
one each (found by a sort-merge anti-join whose index side is not shuffled) and
appends it under the name of its batch. A batch that runs again does not count what it had
appended itself, so it gives the same rows and appends none twice. DataFrame operations only.

Defined results: a null text counts as empty, and empty texts equal each other. Of equal texts
the row with most code points stays, then the smallest id, a null id last; where an earlier batch
has the text, the row that it kept stays and no new one. `group_size` counts the rows of the
batch, those that repeat one id and text included; one of them is kept. Columns beside id and
text are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, lookup

BLANKS = " \t\n\x0b\f\r"


def digest(text: Column) -> Column:
    return F.sha2(F.translate(F.coalesce(text.cast("string"), F.lit("")), BLANKS, ""), 256)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns doc_id, n_code_points, digest, row_no, one row per document, read once."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return checkpointed(docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.length(text).cast("long").alias("n_code_points"),
        digest(text).alias("digest"), F.monotonically_increasing_id().alias("row_no")))


def representatives(rows: DataFrame) -> DataFrame:
    """One row per digest: the id, length and row that stay, and the size of the group."""
    best = F.min(F.struct((-F.col("n_code_points")).alias("neg_length"), F.col("doc_id").isNull().alias("no_id"),
                          "doc_id", "row_no"))
    return rows.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"), best.alias("best")).select(
        "digest", "group_size", F.col("best.doc_id").alias("keep_id"),
        (-F.col("best.neg_length")).alias("keep_length"), F.col("best.row_no").alias("keep_row"))


class DigestIndex:
    """A table of all digests seen so far, as Parquet in buckets of the digest, each sorted by it.

    The catalog keeps the table; with a persistent catalog the index outlives the session. The
    number of buckets is fixed when the index is made, by default the session's number of shuffle
    partitions, so that new rows are shuffled once for grouping, join and append alike.
    """

    COLUMNS = ("digest", "keep_id", "group_size", "batch")

    def __init__(self, spark: SparkSession, table: str, buckets: int | None = None):
        self.spark, self.table = spark, table
        buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        spark.sql(f"""CREATE TABLE IF NOT EXISTS {table} (digest STRING, keep_id BIGINT, group_size BIGINT, batch STRING)
                      USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS""")
        self.buckets = spark.sql(f"DESCRIBE EXTENDED {table}").filter("col_name = 'Num Buckets'").first().data_type

    def read(self) -> DataFrame:
        return self.spark.table(self.table)

    def earlier(self, batch: str) -> DataFrame:
        """What batches other than this one have appended."""
        return self.read().filter(F.col("batch") != batch)

    def add(self, rows: DataFrame, batch: str) -> DataFrame:
        """Append the digests of `rows` (see `digests`) that are new; returns their representatives.

        The result is checkpointed before the append, so a job that fails in between may be run
        again under the same name.
        """
        new = representatives(rows).join(self.earlier(batch).select("digest").hint("merge"), "digest", "left_anti")
        new = checkpointed(new)
        fresh = new
        if not self.read().filter(F.col("batch") == batch).isEmpty():
            fresh = new.join(self.read().select("digest").hint("merge"), "digest", "left_anti")
        (fresh.withColumn("batch", F.lit(batch)).select(*self.COLUMNS).write.format("parquet")
         .bucketBy(int(self.buckets), "digest").sortBy("digest").mode("append").saveAsTable(self.table))
        return new

    def known(self, rows: DataFrame, batch: str) -> DataFrame:
        """Digests of `rows` that earlier batches hold, with the id that stays; no row of `rows` does."""
        held = self.earlier(batch).select("digest", F.col("keep_id").alias("held_id")).hint("merge")
        return checkpointed(representatives(rows).join(held, "digest").select(
            "digest", "group_size", F.col("held_id").alias("keep_id"), F.lit(None).cast("long").alias("keep_length"),
            F.lit(None).cast("long").alias("keep_row")))

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")


def judged(rows: DataFrame, index: DigestIndex, batch: str) -> DataFrame:
    """Every row with the id that stays for it; new digests are added to the index.

    A digest's hot group is looked up by broadcast. Nothing of the result is read from the index."""
    found = index.add(rows, batch)
    total, answered = rows.count(), found.agg(F.sum("group_size")).first()[0] or 0
    if answered < total:
        found = found.unionByName(index.known(rows, batch))
    return lookup(rows, found, "digest", "group_size", total).select(
        "doc_id", "keep_id", "group_size", F.coalesce(F.col("row_no") == F.col("keep_row"), F.lit(False)).alias("kept"),
        F.col("digest").alias("text_sha256"))


def dedup(docs: DataFrame, index: DigestIndex, batch: str, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """Rows of `docs` whose text no earlier batch has, one of each group, all their columns.

    The rows that stay are found by digest, id and length. Only where some group's best row is
    repeated under one id does a last step take one of the repeated rows.
    """
    rows = digests(docs, id_col, text_col)
    found = index.add(rows, batch)

    def stays(left: DataFrame):
        return ((left["digest"] == found["digest"]) & left["doc_id"].eqNullSafe(found["keep_id"])
                & (left["n_code_points"] == found["keep_length"]))

    repeated = rows.join(found, stays(rows)).groupBy(rows["digest"]).count().filter("count > 1")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keyed = docs.select(F.struct("*").alias("row"), digest(F.col(text_col)).alias("digest"),
                        F.col(id_col).cast("long").alias("doc_id"),
                        F.length(text).cast("long").alias("n_code_points"))
    kept = keyed.join(found, stays(keyed), "left_semi")
    if not repeated.isEmpty():
        kept = kept.dropDuplicates(["digest"])
    return kept.select("row.*")


def scratch_index(spark: SparkSession) -> DigestIndex:
    """A new, empty index in the warehouse."""
    return DigestIndex(spark, f"digest_index_{uuid.uuid4().hex}")
