"""Language-model scores by Brown class bigrams.

Words fall into classes by exchange clustering: a word moves to the class that raises the
likelihood of the corpus' class bigrams most, until few words move. A text's probability is the
product of class transitions and of word emissions within the class.

The driver finds first classes by exchange over symbols: the `CLUSTERED` most frequent words are
symbols of their own, all others go by the hash of their last two bytes. From these, in rounds over
the corpus, every other word seen `LEAST` times or more moves to the class under which its own
neighbours' classes are likeliest. A round's moves are kept if they raise the likelihood of the class
bigrams over the whole corpus; the first round that does not ends the moves, `MOVES` rounds at most.
Words seen less often stay with their ending.

The training texts are split into words for the counts and once more into stored rows of codes, which first classes and
rounds read.

Tasks need a word's class at hand. Up to `SENT` of the most frequent words, `LONGEST` bytes long at
most, are sent with their counts and classes. The class of any other word lies in a table of 2^`BITS`
bytes, the same at every size of the corpus, under the word's hash: words of one place in it move
together by the sum of their neighbours. Classes never need a join of texts; only the counts of the
words that were not sent are joined by shuffle, for the score.

P(c | b) = (n(b, c) + T(b) P(c)) / (n(b) + T(b)), T(b) the number of classes seen after b;
P(w | c) = (n(w) + 1) / (n(c) + V(c) + 1), V(c) the number of known words of the class.

Defined results: tokens are runs of other characters than `[\\x20\\x09-\\x0D]` with A-Z lower-cased,
then one end token; a null or empty text is the end token alone. Texts start after an end. Every
row is a document of its own, and repeated rows count as often as they come. A null id counts as
the empty text for the fold. Without training texts both scores are those of a model of one
unknown word, zero. Columns beside id and text are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count as numbered

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, freed_shuffles, text_bytes, whole_groups
from .vocabulary import most_frequent, word_counts

CLASSES = 64
CLUSTERED = 512
SENT = 1 << 18
LONGEST = 64
BITS = 24
BLOCK_BITS = 16       # of the part of the class table that one group packs
LEAST = 2
MOVES = 2
CHUNK = 200_000       # words worked on at a time
HELD = 1 << 21        # neighbours of frequent words a task holds before it adds them up; twice as many of others before they are passed on
FREQUENT = 1 << 15    # codes whose neighbours a task counts in an array, without sorting
ENDINGS = 256
ROUNDS = 12


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()


def ending(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % ENDINGS


def place_of(word: bytes) -> int:
    """A word's place in the class table."""
    return xxhash.xxh3_64_intdigest(word) & ((1 << BITS) - 1)


class Codes(dict):
    """Codes of words: the number of those sent, else `base` plus the place. The end of a text is the empty word, 0."""

    def __init__(self, sent: list[bytes]):
        super().__init__({w: i for i, w in enumerate([b"", *sent])})
        self.base = len(self)

    def __missing__(self, word: bytes) -> int:
        return self.base + place_of(word)

    def __reduce__(self):
        return Codes, (list(self)[1:],)


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange(pairs: np.ndarray, classes: int = CLASSES, rounds: int = ROUNDS) -> np.ndarray:
    """Class of each symbol from the matrix of symbol bigrams.

    The likelihood of class bigrams is the sum of n log n over pairs of classes, less that over
    classes before and after; moving a symbol changes one row and one column of each class.
    """
    size = len(pairs)
    before, after = pairs.sum(1), pairs.sum(0)
    # symbols by falling frequency, dealt over the classes
    order = np.argsort(-(before + after), kind="stable")
    group = np.empty(size, np.int64)
    group[order] = np.arange(size) % classes
    member = np.zeros((size, classes))
    member[np.arange(size), group] = 1
    table = member.T @ pairs @ member
    for _ in range(rounds):
        moved = 0
        for w in order:
            if not before[w] and not after[w]:
                continue
            old, own = group[w], pairs[w, w]
            to = np.bincount(group, pairs[w], classes)
            frm = np.bincount(group, pairs[:, w], classes)
            to[old] -= own
            frm[old] -= own
            table[old] -= to
            table[:, old] -= frm
            table[old, old] -= own
            rows, columns = table.sum(1), table.sum(0)
            # likelihood gained by adding the symbol to each class
            gain = (_xlogx(table + to) - _xlogx(table)).sum(1) + (_xlogx(table + frm[:, None]) - _xlogx(table)).sum(0)
            inner = np.diagonal(table)
            gain += (_xlogx(inner + to + frm + own) - _xlogx(inner + to) - _xlogx(inner + frm) + _xlogx(inner))
            gain -= _xlogx(rows + before[w]) - _xlogx(rows) + _xlogx(columns + after[w]) - _xlogx(columns)
            new = int(gain.argmax())
            if gain[new] <= gain[old] + 1e-9:
                new = old
            moved += new != old
            group[w] = new
            table[new] += to
            table[:, new] += frm
            table[new, new] += own
        if moved * 200 < size:
            break
    return group


@dataclass
class BrownModel:
    """What tasks need: codes of words, counts of those sent, the class of every code, and the classes' tables."""

    codes: Codes
    least: int                    # count from which words are sent
    log_count: np.ndarray         # log10(n + 1) by number
    group: np.ndarray             # class by code; places that no word of LEAST counts has hold NONE
    ending_group: np.ndarray      # class by ending
    log_move: np.ndarray          # log10 P(class | class before)
    log_class: np.ndarray         # log10(n(c) + V(c) + 1)
    tokens: int
    vocabulary: int

    @property
    def log_total(self) -> float:
        return float(np.log10(self.tokens + self.vocabulary + 1))


NONE = 255  # of the class table: the word's ending decides


def classes_of(codes: np.ndarray, endings: np.ndarray, base: int, group: np.ndarray, ending_group: np.ndarray) -> np.ndarray:
    """Class of every code; `endings` has those of the words that were not sent, in order."""
    found = group[codes]
    unsent = np.flatnonzero(codes >= base)
    by_ending = found[unsent] == NONE
    found[unsent[by_ending]] = ending_group[endings[by_ending]]
    return found.astype(np.int64)


def coded(words: list[bytes], codes: Codes) -> tuple[np.ndarray, np.ndarray]:
    """Codes of words, and the endings of those that were not sent."""
    row = np.fromiter(map(codes.__getitem__, words), np.int64, len(words))
    endings = [ending(words[i]) for i in np.flatnonzero(row >= codes.base).tolist()]
    return row, np.array(endings, np.int64)


def _coded_texts(docs: DataFrame, codes, text_col: str) -> DataFrame:
    """The texts as codes, an end before each and after the last, in rows of CHUNK words that begin with the last
    word of the row before; and the endings of the words that were not sent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = [b""]

        def rows(least: int) -> Iterator[pa.RecordBatch]:
            while len(row) > least:
                found, endings = coded(row[:CHUNK], codes.value)
                del row[:min(CHUNK, len(row)) - 1]
                yield pa.RecordBatch.from_arrays([pa.array([found.astype("<u4").tobytes()], pa.binary()),
                                                  pa.array([endings.astype(np.uint8).tobytes()], pa.binary())], ["codes", "endings"])

        for batch in batches:
            for text in batch.column(0):
                row += words_of(text.as_py())
                row.append(b"")
                yield from rows(CHUNK)
        yield from rows(1)

    return docs.select(text_bytes(text_col).alias("text")).mapInArrow(run, "codes binary, endings binary")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Codes and endings of each row of `_coded_texts`."""
    for batch in batches:
        for row, endings in zip(batch.column(0), batch.column(1)):
            yield tuple(np.frombuffer(x.as_py(), kind).astype(np.int64) for x, kind in ((row, "<u4"), (endings, np.uint8)))


def _pair_counts(texts: DataFrame, base: int, clustered: int, sent_endings) -> np.ndarray:
    """Counts of symbol bigrams: the end, the `clustered` - 1 most frequent words, then endings."""
    size = clustered + ENDINGS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(size * size, np.int64)
        for row, endings in _read(batches):
            unsent = row >= base
            row[unsent] = clustered + endings
            rest = ~unsent & (row >= clustered)
            row[rest] = clustered + sent_endings.value[row[rest]]
            table += np.bincount(row[:-1] * size + row[1:], minlength=size * size)
        used = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(table[used])], ["pair", "n"])

    return _square(texts.mapInArrow(count, "pair long, n long"), size)


def _square(cells: DataFrame, size: int) -> np.ndarray:
    """Summed cells (pair, n) as a matrix; size squared of them come back at most."""
    found = cells.groupBy("pair").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(size * size)
    out[found["pair"].to_numpy(np.int64)] = found["n"].to_numpy()
    return out.reshape(size, size)


_NEAR = "code long, cells binary, n binary"


def _binaries(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    """A binary value per start, up to the next."""
    ends = np.append(starts, len(values)).astype(np.int64) * values.itemsize
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(values.tobytes())])


def _near_rows(keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """A row per code of counts by neighbour: class before, or CLASSES + class after; `keys` ascend."""
    owner = keys // (2 * CLASSES)
    cuts = np.flatnonzero(np.diff(owner, prepend=-1))
    return pa.RecordBatch.from_arrays(
        [pa.array(owner[cuts]), _binaries((keys % (2 * CLASSES)).astype(np.uint8), cuts), _binaries(n.astype("<u4"), cuts)],
        ["code", "cells", "n"])


def _neighbours(texts: DataFrame, base: int, shared, near: bool) -> DataFrame:
    """Counts of every code's neighbours' classes (if `near`), and of class bigrams under code -1; tasks add up first.

    `shared` has the class of every code, the class of every ending, and the first code that moves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, ending_group, fixed = shared.value
        moves = np.zeros(CLASSES * CLASSES, np.int64)
        bound = FREQUENT * 2 * CLASSES
        frequent = np.zeros(bound if near else 0, np.int64)
        held: list[np.ndarray] = []
        rare: list[np.ndarray] = []
        waiting = rare_waiting = 0

        def rare_rows() -> Iterator[pa.RecordBatch]:
            yield _near_rows(*np.unique(np.concatenate([*rare, np.zeros(0, np.int64)]), return_counts=True))
            rare.clear()

        for row, endings in _read(batches):
            found = classes_of(row, endings, base, group, ending_group)
            left, right = row[:-1], row[1:]
            moves += np.bincount(found[:-1] * CLASSES + found[1:], minlength=CLASSES * CLASSES)
            if not near:
                continue
            a, b = right >= fixed, left >= fixed
            for keys in (right[a] * 2 * CLASSES + found[:-1][a], left[b] * 2 * CLASSES + CLASSES + found[1:][b]):
                often = keys < bound
                held.append(keys[often])
                rare.append(keys[~often])
                rare_waiting += len(rare[-1])
            waiting += 2 * len(row)
            if waiting > HELD:
                np.add(frequent, np.bincount(np.concatenate(held), minlength=bound), out=frequent)
                held, waiting = [], 0
            if rare_waiting > 2 * HELD:
                yield from rare_rows()
                rare_waiting = 0
        if near:
            if held:
                np.add(frequent, np.bincount(np.concatenate(held), minlength=bound), out=frequent)
            used = np.flatnonzero(frequent)
            yield _near_rows(used, frequent[used])
            yield from rare_rows()
        # a number of 8 bytes per class bigram, so that sums of tasks pass no limit
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int64()), pa.array([None], pa.binary()),
                                          pa.array([moves.tobytes()], pa.binary())], ["code", "cells", "n"])

    return texts.mapInArrow(run, _NEAR)


def _bigrams(near: DataFrame) -> np.ndarray:
    """The class bigrams among the rows of `_neighbours`."""

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES * CLASSES, np.int64)
        for batch in batches:
            for raw in batch.column(0):
                total += np.frombuffer(raw.as_py(), np.int64)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["pair", "n"])

    return _square(near.filter("code < 0").select("n").mapInArrow(cells, "pair long, n long"), CLASSES)


def likeliest(near: np.ndarray, old: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The class under which each word's neighbours are likeliest, the word itself left out of its old class; -1 is none.

    `near` has a row per word: counts of classes before, then of classes after.
    """
    def logs(t: np.ndarray) -> np.ndarray:
        t = np.maximum(t, 0) + 0.1
        return np.log(t / t.sum(-1, keepdims=True))

    # by class: neighbours before it, then after it; shares of the class's own count, as in the gain of `exchange`
    around = np.hstack([table.T, table])
    fit = near @ np.hstack([logs(table.T), logs(table)]).T
    for i in np.flatnonzero(old >= 0).tolist():
        rest = around[old[i]] - near[i]
        fit[i, old[i]] = near[i] @ np.concatenate([logs(rest[:CLASSES]), logs(rest[CLASSES:])])
    return fit.argmax(1)


def _moved(near: DataFrame, shared, table: np.ndarray) -> DataFrame:
    """(code, class) of the codes that occur LEAST times or more, by their neighbours."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in whole_groups(batches):
            codes = part.column("code").to_numpy()
            first = np.flatnonzero(np.diff(codes, prepend=-2))
            index = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(codes))))
            for at in range(0, len(first), 8192):
                to = min(at + 8192, len(first))
                a, b = first[at], first[to] if to < len(first) else len(codes)
                some = part.slice(a, b - a)
                cells = some.column("cells").to_pylist()
                n = np.frombuffer(b"".join(some.column("n").to_pylist()), "<u4")
                owner = np.repeat(index[a:b] - at, [len(x) for x in cells])
                sums = np.bincount(owner * 2 * CLASSES + np.frombuffer(b"".join(cells), np.uint8), n,
                                   (to - at) * 2 * CLASSES).reshape(-1, 2 * CLASSES)
                often = sums.sum(1) >= 2 * LEAST  # an occurrence has two neighbours
                names = codes[first[at:to]][often]
                old = shared.value[0][names].astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names), pa.array(likeliest(sums[often], np.where(old == NONE, -1, old), table), pa.int32())],
                    ["code", "class"])

    return (near.filter("code >= 0").repartition("code").sortWithinPartitions("code")
            .mapInArrow(run, "code long, class int"))


def _regrouped(moved: DataFrame, group: np.ndarray) -> np.ndarray:
    """The class of every code after the moves, packed block by block on the executors."""

    def pack(rows: pa.Table) -> pa.Table:
        out = np.full(1 << BLOCK_BITS, NONE, np.uint8)
        out[rows["code"].to_numpy() & ((1 << BLOCK_BITS) - 1)] = rows["class"].to_numpy()
        return pa.table({"block": pa.array([rows["block"][0].as_py()], pa.int64()),
                         "packed": pa.array([out.tobytes()], pa.binary())})

    blocks = (moved.withColumn("block", F.shiftright("code", BLOCK_BITS)).groupBy("block")
              .applyInArrow(pack, "block long, packed binary").collect())  # a byte per code at most
    out = group.copy()
    for block, packed in blocks:
        start = block << BLOCK_BITS
        new = np.frombuffer(packed, np.uint8)[:len(out) - start]
        out[start:start + len(new)] = np.where(new == NONE, out[start:start + len(new)], new)
    return out


def likelihood(bigrams: np.ndarray) -> float:
    """Of the class bigrams, but for a term that no move changes."""
    return float(_xlogx(bigrams).sum() - _xlogx(bigrams.sum(0)).sum() - _xlogx(bigrams.sum(1)).sum())


def _classed(counts: DataFrame, codes, shared) -> DataFrame:
    """(word, n, class) of every known word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, endings, _ = shared.value
        for batch in batches:
            words = batch.column(0).to_pylist()
            row, last = coded(words, codes.value)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(classes_of(row, last, codes.value.base, group, endings), pa.int32())],
                ["word", "n", "class"])

    return counts.select("word", "n").mapInArrow(run, "word binary, n long, class int")


def train(docs: DataFrame, text_col: str = "text", rounds: int = MOVES) -> tuple[BrownModel, DataFrame]:
    """The model, and the table (word, n, class) of all words of the training texts."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    with freed_shuffles(spark):
        counts = scratch.keep(word_counts(docs, words_of, text_col), "word-counts")
    n_texts = docs.count()
    n_words, n_distinct = counts.agg(F.sum("n"), F.count(F.lit(1))).first()
    tokens, distinct = (n_words or 0) + n_texts, n_distinct + bool(n_texts)
    sent, least = most_frequent(counts.filter(F.length("word") <= LONGEST), SENT)
    clustered = 1 + min(CLUSTERED, len(sent))  # symbol 0 is the end
    codes = spark.sparkContext.broadcast(Codes(list(sent)))

    with freed_shuffles(spark):
        texts = scratch.keep(_coded_texts(docs, codes, text_col), "coded-texts")
    base = 1 + len(sent)
    sent_endings = np.array([ending(w) for w in (b"", *sent)], np.int64)
    pairs = _pair_counts(texts, base, clustered, spark.sparkContext.broadcast(sent_endings))
    by_symbol = exchange(pairs)
    ending_group = by_symbol[clustered:]
    group = np.full(base + (1 << BITS), NONE, np.uint8)
    group[:base] = np.append(by_symbol[:clustered], ending_group[sent_endings[clustered:]])

    # each round counts neighbours and class bigrams under the classes it starts from
    best, bigrams = None, None
    for step in range(rounds + 1):
        shared = spark.sparkContext.broadcast((group, ending_group, clustered))
        with freed_shuffles(spark):
            near = scratch.keep(_neighbours(texts, base, shared, step < rounds), "class-neighbours")
            found = _bigrams(near)
            if best is not None and likelihood(found) <= likelihood(bigrams):
                break
            best, bigrams = group, found
            if step < rounds:
                group = _regrouped(_moved(near, shared, bigrams), group)
    shared = spark.sparkContext.broadcast((best, ending_group, clustered))
    with freed_shuffles(spark):
        known = Scratch(spark).keep(_classed(counts, codes, shared), "classed-words")
    scratch.drop()

    share = (bigrams.sum(0) + 1) / (bigrams.sum() + CLASSES)
    seen = np.maximum((bigrams > 0).sum(1, keepdims=True), 1)
    log_move = np.log10((bigrams + seen * share) / (bigrams.sum(1, keepdims=True) + seen))
    kinds, used = np.zeros(CLASSES), np.zeros(CLASSES)
    kinds[best[0]] += 1
    used[best[0]] += n_texts
    for c, k, n in known.groupBy("class").agg(F.count(F.lit(1)), F.sum("n")).collect():
        kinds[c] += k
        used[c] += n
    log_class = np.log10(used + kinds + 1)
    if not tokens:
        log_move, log_class = np.zeros_like(log_move), np.zeros_like(log_class)
    log_count = np.log10(np.array([n_texts, *sent.values()], float) + 1)
    return BrownModel(codes.value, least, log_count, best, ending_group, log_move, log_class, tokens, distinct), known


_PARTS = ("text_no long, word binary, times int, doc_id long, n_tokens long, known long, base double, model double")


def score(docs: DataFrame, model: BrownModel, counts: DataFrame, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score, perplexity of every row.

    A task adds up what it knows of a text, and passes on the words whose counts were not sent to it,
    each once per text, to be joined with them.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rare = counts.filter((F.col("n") < model.least) | (F.length("word") > LONGEST)).select("word", "n")
    kinds = [pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
    names = [f.split()[0] for f in _PARTS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: BrownModel = shared.value
        base = m.codes.base
        text_no = TaskContext.get().partitionId() << 40

        def scored(words: list[bytes], docs_of: list, first: int) -> Iterator[pa.RecordBatch]:
            """Rows of texts that lie one after the other in `words`, an end before each and after the last."""
            row, endings = coded(words, m.codes)
            found = classes_of(row, endings, base, m.group, m.ending_group)
            inner, sent = row[1:], row[1:] < base
            stops = np.flatnonzero(inner == 0)
            starts = np.append(0, stops[:-1] + 1)
            add = lambda values: np.add.reduceat(values, starts)
            rest = add(np.where(sent, m.log_count[np.where(sent, inner, 0)], 0.0))
            model = add(m.log_move[found[:-1], found[1:]] - m.log_class[found[1:]])
            known, sizes, text_no = add(sent.astype(np.int64)), stops - starts + 1, first + np.arange(len(stops))
            # a text's own row goes under a key that no word has, so that these rows spread evenly
            columns = [text_no, [b" " + n.to_bytes(8, "little") for n in text_no.tolist()], [None] * len(stops), docs_of, sizes,
                       known - (not m.tokens), rest - sizes * m.log_total, rest + model]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)
            unsent = np.flatnonzero(~sent)
            here: dict[bytes, int] = defaultdict(numbered().__next__)
            ids = np.array([here[words[i + 1]] for i in unsent.tolist()], np.int64)
            pairs, times = np.unique(np.searchsorted(stops, unsent) * len(here) + ids, return_counts=True)
            text, word = np.divmod(pairs, max(len(here), 1))
            kept = pa.array(list(here), pa.binary()).take(pa.array(word))
            yield pa.RecordBatch.from_arrays([pa.array(first + text), kept, pa.array(times, pa.int32()),
                                              *(pa.nulls(len(kept), t) for t in kinds[3:])], names)

        words, docs_of = [b""], []
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words += words_of(text.as_py())
                words.append(b"")
                docs_of.append(doc)
                if len(words) >= CHUNK:
                    yield from scored(words, docs_of, text_no)
                    text_no += len(docs_of)
                    words, docs_of = [b""], []
        if docs_of:
            yield from scored(words, docs_of, text_no)

    parts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("text")
                        ).mapInArrow(run, _PARTS)
    n = F.coalesce("n", F.lit(0))
    rest, total = F.coalesce(F.sum(F.col("times") * F.log10(n + 1)), F.lit(0.0)), F.sum("n_tokens")
    scored = parts.join(rare, "word", "left").groupBy("text_no").agg(
        F.max("doc_id").alias("doc_id"), total.alias("n_tokens"),
        (F.sum("known") + F.coalesce(F.sum(F.when(n > 0, F.col("times"))), F.lit(0))).alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.sum("base") + rest).alias("base_score"), (F.sum("model") + rest).alias("score"))
    return scored.select("doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score",
                         F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))
