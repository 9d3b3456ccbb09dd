"""Benchmark decontamination: which windows of benchmark items occur in which documents, exactly.

A prefix-filtered set join on DataFrame functions alone. Words are runs of digits, letters and all
characters beyond ASCII, A-Z lower-cased. An item's windows are its runs of WINDOW words; an item with
fewer words is one window. A window is a set of positioned shingles of SHINGLE words (one shingle of
all its words where it is shorter). As a whole window has to occur, its necessary prefix is one
shingle: the one that the documents hold least often. Documents are cut into shingles once, and those
of any window are kept with their place. Only places of a window's prefix shingle are candidates; the
length bound and the place of the shingle in the window fix where the window must begin and whether it
fits the document. What is left is verified by an equality join of the document's own words there with
the windows' words.

Defined results: a null or wordless text has no words and no hits; a null or wordless item has no
window. Rows of one item id add up to one item; items without id count for `n_hit` and
`contaminated`, not for `n_items`. Each document row is answered on its own, also where an id is
repeated or null. Windows that items share are looked up once. A text that is one long word is one
word. Empty tables give no rows, or documents without hits. Columns beside id and text are not read.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SENT_ROWS, Scratch, checkpointed, sent

WINDOW = 10
SHINGLE = 5
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The text's words; null and wordless texts give an empty array."""
    lowered = F.translate(F.coalesce(text.cast("string"), F.lit("")), ascii_uppercase, ascii_lowercase)
    return F.array_remove(F.split(lowered, NOT_WORD), "")


def _starts(n_words: Column, length: Column) -> Column:
    """0 ... n_words - length, for n_words >= length."""
    return F.sequence(F.lit(0), n_words - length)


def _run(of: Column, start: Column, length: Column) -> Column:
    """`length` entries from `start`, taken one by one; `slice` would copy the whole array each time."""
    return F.transform(F.sequence(start, start + length - F.lit(1)), lambda i: of[i])


def _shingles(of: Column, width: int) -> Column:
    """array of (shingle, at): hashes of all runs of `width` words; null for fewer words."""
    return F.when(F.size(of) >= width, F.transform(_starts(F.size(of), F.lit(width)), lambda at: F.struct(
        F.xxhash64(*[of[at + F.lit(i)] for i in range(width)]).alias("shingle"), at.alias("at"))))


def windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id string, words array<string>), one row per item and different window of it."""
    split = (items.select(F.col(id_col).cast("string").alias("item_id"), words(F.col(text_col)).alias("all"))
             .filter(F.size("all") > 0))
    length = F.least(F.size("all"), F.lit(WINDOW))
    cut = F.transform(_starts(F.size("all"), length), lambda at: _run(F.col("all"), at, length))
    return split.select("item_id", F.explode(cut).alias("words")).distinct()


def occurrences(tokens: DataFrame, wanted: DataFrame, keep) -> DataFrame:
    """(row_no, start, words): where the windows `wanted` (distinct `words`) occur in `tokens` (row_no, words)."""
    n_windows, n_bytes = wanted.agg(
        F.count(F.lit(1)), F.coalesce(F.sum(F.length(F.array_join("words", " ")) * 4), F.lit(0))).first()
    lengths = sorted(r[0] for r in wanted.select(
        F.least(F.size("words"), F.lit(SHINGLE))).distinct().collect())  # SHINGLE values at most

    # every shingle of every window and its place there
    empty = F.array().cast("array<struct<shingle:bigint,at:int>>")
    parts = wanted.select("words", F.inline(F.coalesce(*[
        F.when(F.least(F.size("words"), F.lit(SHINGLE)) == k, _shingles(F.col("words"), k)) for k in lengths], empty)))
    parts = keep(parts.withColumnRenamed("at", "place"), "window-shingles")
    n_parts = n_windows * (WINDOW - SHINGLE + 1)
    known = sent(parts.select("shingle").distinct(), n_parts, 0)

    # every place of such a shingle in the documents; the texts' words are not carried along
    cut = F.concat(empty, *[F.coalesce(_shingles(F.col("words"), k), empty) for k in lengths])
    found = tokens.select("row_no", F.size("words").alias("n_words"), F.inline(cut))
    found = keep(found.join(known, "shingle", "left_semi"), "shingle-places")

    # the rarest shingle of each window is its necessary prefix; ties go to the first place
    rarity = found.groupBy("shingle").agg(F.count(F.lit(1)).alias("n"))
    prefix = (parts.join(sent(rarity, n_parts, 0), "shingle", "left")
              .groupBy("words").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "place", "shingle")).alias("p"))
              .filter("p.n > 0")
              .select(F.col("p.shingle").alias("shingle"), F.col("p.place").alias("place"),
                      F.size("words").alias("length")).distinct())
    begin = F.col("at") - F.col("place")
    candidates = keep(found.join(sent(prefix, n_windows), "shingle")
                      .filter((begin >= 0) & (begin + F.col("length") <= F.col("n_words")))
                      .select("row_no", begin.alias("start"), "length").distinct(), "candidates")
    # where few documents have candidates, the words of the others are not shuffled
    candidate_rows = candidates.select("row_no").distinct()
    n_rows = candidate_rows.count()
    if n_rows <= SENT_ROWS:
        tokens = tokens.join(F.broadcast(candidate_rows), "row_no", "left_semi")

    # the document's own words at each candidate place; a document's places are no more than its words
    at_rows = candidates.groupBy("row_no").agg(F.collect_list(F.struct("start", "length")).alias("places"))
    seen = tokens.join(at_rows, "row_no").select("row_no", F.inline(F.transform("places", lambda p: F.struct(
        p["start"].alias("start"), _run(F.col("words"), p["start"], p["length"]).alias("words")))))
    return seen.join(sent(wanted, n_windows, n_bytes), "words")


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, item_ids."""
    scratch = Scratch(docs.sparkSession)
    tokens = scratch.keep(docs.select(F.monotonically_increasing_id().alias("row_no"), F.col(id_col).alias("doc_id"),
                                      words(F.col(text_col)).alias("words")), "document-words")
    per_item = scratch.keep(windows(items, item_id_col, item_text_col), "item-windows")
    # the window's number stands for its words from here on
    wanted = scratch.keep(per_item.groupBy("words").agg(
        F.array_sort(F.collect_set("item_id")).alias("item_ids")).withColumn(
        "window_no", F.monotonically_increasing_id()), "windows")
    hits = scratch.keep(occurrences(tokens.select("row_no", "words"), wanted.select("words", "window_no"),
                                    scratch.keep)
                        .select("row_no", "start", F.size("words").alias("length"), "window_no"), "hits")

    # words inside any window: the parts of each window beyond where the earlier ones reach
    reach = lambda covered, w: F.greatest(covered["end"], w["start"] + w["length"])
    more = lambda covered, w: F.greatest(
        F.lit(0), w["start"] + w["length"] - F.greatest(covered["end"], w["start"]))
    n_hit = F.aggregate(
        F.array_sort("spans"), F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda covered, w: F.struct(reach(covered, w).alias("end"), (covered["n"] + more(covered, w)).alias("n")),
        lambda covered: covered["n"].cast("long"))
    spans = (hits.select("row_no", "start", "length").distinct().groupBy("row_no")
             .agg(F.collect_list(F.struct("start", "length")).alias("spans")).select("row_no", n_hit.alias("n_hit")))
    named = (hits.select("row_no", "window_no").distinct()
             .join(wanted.select("window_no", "item_ids"), "window_no")
             .select("row_no", F.explode("item_ids").alias("item_id")).distinct()
             .groupBy("row_no").agg(F.array_sort(F.collect_list("item_id")).alias("item_ids")))
    result = checkpointed(
        tokens.select("row_no", "doc_id", F.size("words").cast("long").alias("n_words"))
        .join(spans, "row_no", "left").join(named, "row_no", "left")
        .select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
                F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids")))
    scratch.drop()
    return result.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"), "item_ids")


def clean(docs: DataFrame, items: DataFrame, **columns: str) -> DataFrame:
    """Ids of documents without any window of an item."""
    return contamination(docs, items, **columns).filter("NOT contaminated").select("doc_id")
