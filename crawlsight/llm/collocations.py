"""Phrase collocations by SON partitioning: phrases of 2 to 4 words that recur, scored by their weakest cut.

A text is lower-cased in A-Z, split into pieces at `. , ; : ! ?` and line ends, and those at blanks
and tabs into words; all counts are per language. Documents are dealt into SHARDS shards by their id.
Each shard is mined completely at the support that is its share of the language's words: level by
level, a phrase of k words is counted only where both its parts of k - 1 words are frequent in the
shard. Such parts are known to the tasks by a bit table of fixed size, whose false positives add
candidates and lose none; hashes that collide do the same. A first pass stores the words as hashes, a row per
shard and quarter of a million words; the levels read these and no text. Mining is a shuffle of counted keys, so a
shard is not bounded by a task's memory. A phrase with MIN_COUNT occurrences overall has its share of
them in some shard, so the union of the shards' phrases holds all of them. A last pass counts every word and phrase
of the union by its text, over all documents, exactly.

Defined results: a null text has no words, a null language is `und`. Texts of repeated rows count
each time. Words of any length and pieces of any length are whole; long pieces are worked through in
overlapping blocks. Ties in the score order by count, then by the phrase's bytes. Documents without id
share a shard. An empty table gives no rows. Columns beside id, text and language are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from itertools import count as numbered

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, arrow_batches, checkpointed, sent, text_bytes

MIN_COUNT, LONGEST, TOP, INSIDE = 30, 4, 2000, 80
SHARDS = 4
BITS = 26             # the bit table has 2^26 bits, 8 MB, whatever the corpus
BLOCK_BITS = 20       # of one group that packs its part
WORDS = 1 << 18       # words of a task's chunk
PIECE = 1 << 20       # bytes of a piece that are split at once
BATCH = 1 << 22       # bytes that go to Python at once, but one row at least
SPELT = 1 << 16       # phrases that come back from Python at once

_SHARD_COLUMNS = ["lang", "shard", "grp", "n", "hashes", "lengths", "carried"]

_TABLE = bytes.maketrans(bytes(range(65, 91)) + b".,;:!?\x0b\x0c\r\t", bytes(range(97, 123)) + b"\n" * 9 + b" ")


def pieces(text: bytes) -> Iterator[tuple[list[bytes], int]]:
    """Words of every piece, and how many of them were in the block before; a long piece has several blocks."""
    for piece in text.translate(_TABLE).split(b"\n"):
        if len(piece) <= PIECE:
            yield piece.split(), 0
            continue
        start, carried = 0, []
        while start < len(piece):
            end = piece.find(b" ", start + PIECE)
            end = len(piece) if end < 0 else end
            words = carried + piece[start:end].split()
            yield words, len(carried)
            carried, start = words[1 - LONGEST:], end


class Places:
    """Hashes of the words of many pieces, and for every place what phrases may begin there."""

    def _lay(self, hashes: np.ndarray, lengths: np.ndarray, carried: np.ndarray) -> None:
        ends, at = np.cumsum(lengths), np.arange(len(hashes))
        self.left = (np.repeat(ends, lengths) - at).astype(np.int32)
        # places up to the first new word
        self.new = (np.repeat(ends - lengths + carried, lengths) - at).astype(np.int32)
        self._hashes = [hashes]

    def hashes(self, k: int) -> np.ndarray:
        """A hash of the k words from each place on."""
        while len(self._hashes) < k:
            self._hashes.append(_mixed(self._hashes[-1], self._ahead(self._hashes[0], len(self._hashes))))
        return self._hashes[k - 1]

    @staticmethod
    def _ahead(values: np.ndarray, by: int) -> np.ndarray:
        out = np.zeros_like(values)
        out[:len(values) - by] = values[by:]
        return out

    def grown(self, k: int, seed: np.uint64, table: np.ndarray | None) -> np.ndarray:
        """Places where a phrase of k words begins whose both parts are in the bit table, not counted before."""
        if k == 1:
            return np.flatnonzero(self._whole(1))
        part = in_table(table, self.hashes(k - 1) ^ seed)
        return np.flatnonzero(part & self._ahead(part, 1) & self._whole(k))

    def _whole(self, k: int) -> np.ndarray:
        return (self.left >= k) & (self.new < k)

    def members(self, k: int, seeds: np.ndarray, table: np.ndarray) -> np.ndarray:
        """Places where a phrase of k words in the bit table begins."""
        return np.flatnonzero(self._whole(k) & in_table(table, self.hashes(k) ^ seeds))


class Stored(Places):
    """Places of one stored row of a shard."""

    def __init__(self, hashes: pa.Scalar, lengths: pa.Scalar, carried: pa.Scalar):
        self._lay(np.frombuffer(hashes.as_buffer(), np.uint64), np.frombuffer(lengths.as_buffer(), np.int32),
                  np.frombuffer(carried.as_buffer(), np.int32))


class Chunk(Places):
    """Places of many documents, with their words as numbers."""

    def __init__(self):
        self.numbers: dict[bytes, int] = defaultdict(numbered().__next__)
        self.ids: list[int] = []
        self.lengths: list[int] = []
        self.carried: list[int] = []
        self.owner: list[int] = []

    def add(self, words: list[bytes], carried: int, owner: int) -> None:
        self.ids.extend(map(self.numbers.__getitem__, words))
        self.lengths.append(len(words))
        self.carried.append(carried)
        self.owner.append(owner)

    def close(self) -> None:
        self.words = list(self.numbers)
        self.ids = np.array(self.ids, np.int64)
        self.lengths, self.carried = np.array(self.lengths, np.int32), np.array(self.carried, np.int32)
        self.owner = np.array(self.owner, np.int32)
        hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in self.words], np.uint64)
        self._lay(hashes[self.ids], self.lengths, self.carried)
        self.owners = np.repeat(self.owner, self.lengths)

    def exact(self, k: int, places: np.ndarray) -> np.ndarray:
        """One number per different phrase of k words among the places, without hashing."""
        code = self.ids[places]
        for step in range(1, k):
            _, code = np.unique(code << 32 | self.ids[places + step], return_inverse=True)
        return code


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = (a * np.uint64(0x9E3779B97F4A7C15)) ^ b
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def _bits(keys: np.ndarray) -> Iterator[np.ndarray]:
    mask = np.uint64((1 << BITS) - 1)
    yield keys & mask
    yield (keys >> np.uint64(BITS)) & mask


def in_table(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    out = np.ones(len(keys), bool)
    for bit in _bits(keys):
        out &= (table[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return out


def bit_table(keys: DataFrame) -> np.ndarray:
    """Bits of all `key`s, packed block by block on the executors; 2^BITS bits come back at most."""

    def pack(group: pa.Table) -> pa.Table:
        bits = np.zeros(1 << BLOCK_BITS, np.uint8)
        bits[group["bit"].to_numpy() & ((1 << BLOCK_BITS) - 1)] = 1
        packed = np.packbits(bits, bitorder="little").tobytes()
        return pa.table({"block": pa.array([group["block"][0].as_py()], pa.int32()), "packed": pa.array([packed], pa.binary())})

    mask = (1 << BITS) - 1
    places = keys.select(F.explode(F.array(
        F.col("key").bitwiseAND(F.lit(mask)), F.shiftrightunsigned("key", BITS).bitwiseAND(F.lit(mask)))).alias("bit")).distinct()
    rows = (places.withColumn("block", F.shiftright("bit", BLOCK_BITS).cast("int"))
            .groupBy("block").applyInArrow(pack, "block int, packed binary").collect())
    table = np.zeros(1 << (BITS - 3), np.uint8)
    size = 1 << (BLOCK_BITS - 3)
    for block, packed in rows:
        table[block * size:(block + 1) * size] = np.frombuffer(packed, np.uint8)
    return table


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Chunk, list[tuple]]]:
    """Chunks of about WORDS words, with the leading columns of each document they hold."""
    chunk, owners = Chunk(), []
    for batch in batches:
        *keys, texts = batch.columns
        for i in range(batch.num_rows):
            owners.append(tuple(k[i].as_py() for k in keys))
            for words, carried in pieces(texts[i].as_py()):
                if words:
                    chunk.add(words, carried, len(owners) - 1)
                if len(chunk.ids) >= WORDS:
                    chunk.close()
                    yield chunk, owners
                    chunk, owners = Chunk(), owners[-1:]
    if chunk.ids:
        chunk.close()
        yield chunk, owners


def _shard_rows(texts: DataFrame) -> DataFrame:
    """The words of all texts as hashes: rows of one shard of one language, each of at most about WORDS words.

    `n` is without words of a block before. Texts are split into words here and in the last pass only.
    """

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, owners in _chunks(batches):
            numbers = {key: i for i, key in enumerate(dict.fromkeys(owners))}
            of_piece = np.array([numbers[o] for o in owners])[chunk.owner]
            of_word = np.repeat(of_piece, chunk.lengths)
            rows = []
            for (lang, shard, grp), i in numbers.items():
                lengths, carried = chunk.lengths[of_piece == i], chunk.carried[of_piece == i]
                if len(lengths):
                    rows.append((lang, shard, grp, int(lengths.sum() - carried.sum()), chunk.hashes(1)[of_word == i].tobytes(),
                                 lengths.tobytes(), carried.tobytes()))
            kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
            for row in rows:  # one row a batch, so that a batch is small
                yield pa.RecordBatch.from_arrays([pa.array([v], kind) for v, kind in zip(row, kinds)], _SHARD_COLUMNS)

    return texts.select("lang", "shard", "grp", "text").mapInArrow(
        split, "lang string, shard int, grp long, n long, hashes binary, lengths binary, carried binary")


def _level_keys(rows: DataFrame, k: int, table=None) -> DataFrame:
    """(grp, key, n): phrases of k words whose parts are frequent in their shard; every word for k = 1."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = table.value if table else None
        for batch in batches:
            for grp, *stored in zip(*batch.columns):
                seed, places = np.array([grp.as_py()], np.int64).view(np.uint64), Stored(*stored)
                # a key holds its group's seed; where two groups met in one key, one takes both counts
                keys, n = np.unique(places.hashes(k)[places.grown(k, seed, bits)] ^ seed, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(keys), grp.as_py())), pa.array(keys.view(np.int64)), pa.array(n, pa.int64())],
                    ["grp", "key", "n"])

    return (rows.select("grp", "hashes", "lengths", "carried").mapInArrow(count, "grp long, key long, n long")
            .groupBy("key").agg(F.min("grp").alias("grp"), F.sum("n").alias("n")))


def _phrase_counts(texts: DataFrame, table) -> DataFrame:
    """(lang, phrase, words, n) of every word and phrase in the bit table, counted by its text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, owners in _chunks(batches):
            seeds = np.array([s for _, s in owners], np.int64)[chunk.owners].view(np.uint64)
            langs = {lang: i for i, lang in enumerate(dict.fromkeys(o[0] for o in owners))}
            names, lang_of = pa.array(list(langs), pa.string()), np.array([langs[o[0]] for o in owners])[chunk.owners]
            words = pa.array(chunk.words, pa.binary())
            for k in range(1, LONGEST + 1):
                places = chunk.members(k, seeds, table.value)
                _, first, n = np.unique(chunk.exact(k, places) * len(names) + lang_of[places],
                                        return_index=True, return_counts=True)
                # the more phrases the corpus has, the more places are members, up to all of a chunk
                for start in range(0, len(first), SPELT):
                    at = places[first[start:start + SPELT]]
                    spelt = [words.take(pa.array(chunk.ids[at + step])) for step in range(k)]
                    yield pa.RecordBatch.from_arrays([
                        names.take(pa.array(lang_of[at])), pc.binary_join_element_wise(*spelt, b" "),
                        pa.array(np.full(len(at), k, np.int32)), pa.array(n[start:start + SPELT], pa.int64())],
                        ["lang", "phrase", "words", "n"])

    return (texts.select("lang", "lang_seed", "text")
            .mapInArrow(count, "lang string, phrase binary, words int, n long")
            .groupBy("lang", "phrase", "words").agg(F.sum("n").alias("n")))


def _seed(*of: Column) -> Column:
    return F.xxhash64(*of)


def counts(docs: DataFrame, keep, id_col: str, text_col: str, lang_col: str) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, f) of all words and phrases with MIN_COUNT occurrences; (lang, n) of all words."""
    sc = docs.sparkSession.sparkContext
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit("und"))
    shard = F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(SHARDS)).cast("int")
    texts = docs.select(lang.alias("lang"), shard.alias("shard"), _seed(lang, shard).alias("grp"),
                        _seed(lang).alias("lang_seed"), text_bytes(text_col).alias("text"))

    rows = keep(_shard_rows(texts), "shard-words")
    by_shard = rows.groupBy("lang", "shard", "grp").agg(F.sum("n").alias("shard_n"))
    totals = by_shard.groupBy("lang").agg(F.sum("shard_n").alias("n"))
    shares = (by_shard.join(totals, "lang")
              .select("grp", _seed(F.col("lang")).alias("lang_seed"), F.expr(f"({MIN_COUNT} * shard_n + n - 1) div n").alias("support")))
    # two groups of one seed have the lower support: more candidates, none lost
    shares = keep(shares.groupBy("grp").agg(F.min("support").alias("support"), F.min("lang_seed").alias("lang_seed")), "shard-shares")
    support = sent(shares, shares.count())

    union, table = [], None
    for k in range(1, LONGEST + 1):
        level = keep(_level_keys(rows, k, table).join(support, "grp").filter("n >= support")
                     .select("key", F.col("key").bitwiseXOR(F.col("grp")).bitwiseXOR(F.col("lang_seed")).alias("lang_key")),
                     f"shard-phrases-{k}")
        if table:
            table.destroy()
        table = sc.broadcast(bit_table(level.select("key"))) if k < LONGEST else None
        union.append(level.select(F.col("lang_key").alias("key")))
    table = sc.broadcast(bit_table(reduce(DataFrame.unionByName, union)))
    phrases = keep(_phrase_counts(texts, table).filter(F.col("n") >= MIN_COUNT)
                   .select("lang", F.col("phrase").cast("string").alias("phrase"), "words", F.col("n").alias("f")), "frequent")
    table.destroy()
    return phrases, totals


def _part(words: str, start: Column, length: Column) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def collocations(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's TOP phrases."""
    scratch = Scratch(docs.sparkSession)
    with arrow_batches(docs.sparkSession, BATCH):
        frequent, totals = counts(docs, scratch.keep, id_col, text_col, lang_col)
    phrases = frequent.filter("words >= 2").withColumn("w", F.split("phrase", " "))

    cuts = phrases.select("lang", "phrase", F.col("f").alias("a"), "w", "words", F.explode(
        F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", _part("w", F.lit(1), F.col("k")).alias("first"),
                       _part("w", F.col("k") + 1, F.col("words") - F.col("k")).alias("rest"))
    side = lambda name, count: frequent.select("lang", F.col("phrase").alias(name), F.col("f").alias(count))
    score = F.expr("cast(a as decimal(20,0)) * 2000000 div (cast(l as decimal(20,0)) + r)").alias("score")
    weakest = (cuts.join(side("first", "l"), ["lang", "first"]).join(side("rest", "r"), ["lang", "rest"])
               .groupBy("lang", "phrase", "a").agg(F.min(F.struct(score, "k", "l", "r")).alias("cut")))

    size, at = F.col("size"), F.col("at")
    longer = (phrases.filter("words >= 3")
              .select("lang", "f", "w", "words", F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("size"))
              .select("lang", "f", "w", "size", F.explode(F.sequence(F.lit(1), F.col("words") - size + 1)).alias("at"))
              .groupBy("lang", _part("w", at, size).alias("phrase")).agg(F.max("f").alias("longest")))
    kept = (weakest.join(longer, ["lang", "phrase"], "left")
            .filter(F.col("longest").isNull() | (F.col("longest") * 100 < F.col("a") * INSIDE))
            .select("lang", "phrase", "a", "cut.score", "cut.l", "cut.r"))

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # a language's best are taken within parts of its phrases first, so that few of them meet in one task
    part = F.pmod(F.xxhash64("phrase"), F.lit(64))
    best = kept.withColumn("part", part).withColumn(
        "in_part", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("in_part") <= TOP)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    result = checkpointed(ranked.filter(F.col("rank") <= TOP).join(totals, "lang").select(
        "lang", "rank", "phrase", "a", "l", "r", "n", "score"))
    scratch.drop()
    return result
