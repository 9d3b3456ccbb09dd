"""Quality scores from random-indexing word vectors and a small network.

Every token has a fixed sparse index vector of +1 and -1 drawn from its bytes. Its context vector is
the sum of the index vectors of its neighbours, up to `WINDOW` away, over the whole corpus: tasks add
up whole numbers and Spark adds the tasks' sums, so the result does not depend on their order. A text
is the mean of its tokens' context and index vectors, frequent tokens weighing less. A two-layer
network learns labels from it, and a temperature fitted on rows kept back from its training
calibrates the probabilities.

All tokens have index vectors of their own, and all that are seen `LEAST` times or more context vectors,
whatever their share; a token seen once has no neighbours but those of its own text. Up to `SENT` of
the most frequent ones are sent to the tasks; the contexts of all others are joined by shuffle and summed
by text, for scores after the network's first layer, which is linear up to there. Which tokens to join a
task reads from a bit table of fixed size; its false positives find no context and change nothing. Texts are scored in
`SLICES` by a hash of their id, one after the other. The network is fitted on at
most `SAMPLE` labelled rows, those with the smallest hash of their id; counts and vectors are taken
over all texts.

Defined results: tokens are runs of letters, of digits or of other characters than white space.
A null or empty text has the zero vector and is scored like any other. Rows are scored one by one,
repeated rows alike. Without labels of both kinds the score is the share of label 1 among the
labels, or 0.5 without any. Null labels are not used; of clashing labels of one id the least is taken. Columns beside id and text are not read. An
empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .collocations import bit_table, in_table
from .common import Scratch, freed_shuffles, text_bytes, whole_groups
from .vocabulary import most_frequent

SAMPLE = 20_000
SENT = 1 << 17
LEAST = 2
HELD = 6_000_000  # tokens whose sums a task passes on at once
SORTED = 500_000  # of these, places sorted at a time, unless one token has more
CHUNK = 50_000    # tokens added up at a time
ROWS = 20_000     # rows passed on at a time
SPLIT = 1 << 21   # bytes of texts split at a time
DIMENSIONS = 64
NONZERO = 8
WINDOW = 2
FEW = 3          # occurrences up to which a token's neighbours are sent as hashes, in fewer bytes than their sum
LONGEST = 64     # bytes of a token that is sent to the tasks; longer ones go by shuffle, whatever their number
SLICES = 3       # of the texts, scored one after the other so that only one slice's shuffles lie on disk
HIDDEN = 32
EPOCHS = 300

tokens_of = re.compile(rb"[A-Za-z\x80-\xff]+|[0-9]+|[^\sA-Za-z0-9\x80-\xff]+").findall  # of one text; `_split` is the same for many

# 0 for white space, 1 for letters, 2 for digits, 3 for others, by byte
_KINDS = bytes(0 if b in b" \t\n\r\f\v" else 1 if b > 127 or chr(b).isalpha() else 2 if chr(b).isdigit() else 3
               for b in range(256))


def _binary(ends: np.ndarray, data) -> pa.Array:
    """Values that lie one after the other in `data`, each from one of `ends` to the next."""
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])


def _ends(values: pa.Array) -> np.ndarray:
    """Where the values of a binary array without nulls begin, and where the last one ends."""
    if not len(values):
        return np.zeros(1, np.int32)
    return np.frombuffer(values.buffers()[1], np.int32)[values.offset:values.offset + len(values) + 1]


def _data(values: pa.Array) -> np.ndarray:
    """The bytes of a binary array, one value after the other."""
    ends = _ends(values)
    return np.frombuffer(values.buffers()[2], np.uint8)[ends[0]:ends[-1]] if ends[-1] > ends[0] else np.zeros(0, np.uint8)


def _pieces(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.Table]:
    """All rows in order, some at a time: up to the one with which the texts of `column` reach `SPLIT` bytes."""
    held, size = [], 0
    for batch in batches:
        # a row counts for its text and a little, so that empty ones do not pile up
        ends = np.cumsum(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False).astype(np.int64) + 64)
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = min(int(np.searchsorted(ends, before + SPLIT - size)) + 1, batch.num_rows)
            held.append(batch.slice(at, to - at))
            size += ends[to - 1] - before
            at = to
            if size >= SPLIT:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _split(texts: pa.ChunkedArray) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The tokens of all texts as numbers of distinct ones, one text after the other, and how many each text has."""
    texts = texts.combine_chunks().cast(pa.binary())
    raw, ends = _data(texts), _ends(texts).astype(np.int64)
    ends -= ends[0]
    if not len(raw):
        return pa.array([], pa.binary()).dictionary_encode(), np.zeros(len(texts), np.int64)
    kinds = np.frombuffer(raw.tobytes().translate(_KINDS), np.uint8)
    begins = np.append(True, kinds[1:] != kinds[:-1])
    begins[ends[ends < len(raw)]] = True
    runs = np.flatnonzero(begins)
    of_token = kinds[runs] > 0
    tokens = _binary(np.append(runs, len(raw)), raw).filter(pa.array(of_token))
    return tokens.dictionary_encode(), np.diff(np.searchsorted(runs[of_token], ends))


def _listed(values: pa.Array) -> list[bytes]:
    """As `to_pylist`, but many times faster."""
    return values.to_numpy(zero_copy_only=False).tolist()


def _hashes(names: pa.Array) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, _listed(names)), np.uint32, len(names))


def _stretches() -> np.ndarray:
    """By byte, the two stretches of an index vector that its low and its high four bits stand for."""
    width = DIMENSIONS // NONZERO
    low_high = np.arange(256)[:, None] >> np.array([0, 4]) & 15
    out = np.zeros((256, 2, width), np.int8)
    out[np.arange(256)[:, None], np.arange(2), low_high % width] = low_high // width * 2 - 1
    return out.reshape(256, 2 * width)


_STRETCHES = _stretches()


def index_vectors(names: list[bytes]) -> np.ndarray:
    """A row per name."""
    return index_of_hashes(_hashes(pa.array(names, pa.binary())))


def index_of_hashes(hashes: np.ndarray) -> np.ndarray:
    """A row per hash: one +1 or -1 in each of `NONZERO` stretches of dimensions, by four mixed bits; hash 0, which
    nothing between texts has, is the zero vector."""
    h = hashes.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    h ^= h >> np.uint64(31)
    vectors = _STRETCHES[h.astype("<u4").view(np.uint8).reshape(-1, NONZERO // 2)].reshape(-1, DIMENSIONS)
    vectors[hashes == 0] = 0
    return vectors


def _raised(hashes: np.ndarray) -> np.ndarray:
    """Index vectors plus 1, so that no byte is negative and eight bytes add up as one word without a carry."""
    vectors = index_of_hashes(hashes)
    vectors += 1
    return vectors.view(np.uint64)


def _packed(sums: np.ndarray) -> Iterator[tuple[np.ndarray, pa.Array]]:
    """Rows of whole numbers in the fewest bytes, some rows at a time; the length tells the kind."""
    top = np.abs(sums).max(1, initial=0)
    for kind, low, high in (("<i1", -1, 127), ("<i2", 127, 32767), ("<i8", 32767, np.inf)):
        every = np.flatnonzero((top > low) & (top <= high))
        for at in range(0, len(every), ROWS):
            some = every[at:at + ROWS]
            yield some, _binary(np.arange(len(some) + 1) * (DIMENSIONS * int(kind[2])), sums[some].astype(kind).tobytes())


def _unpacked(rows: list[bytes] | pa.Array) -> np.ndarray:
    """Sums of whole numbers from `_packed` rows, or from neighbours' hashes where there are few."""
    rows = rows if isinstance(rows, pa.Array) else pa.array(rows, pa.binary())
    out, sizes = np.zeros((len(rows), DIMENSIONS), np.int64), np.diff(_ends(rows))
    few = np.flatnonzero((sizes > 0) & (sizes < DIMENSIONS))
    if len(few):
        number = sizes[few] // 4
        sums = np.add.reduceat(_raised(_data(rows.take(pa.array(few))).view("<u4")), np.cumsum(number) - number, axis=0)
        out[few] = sums.view(np.uint8) - number[:, None]
    for width in (1, 2, 8):
        some = np.flatnonzero(sizes == width * DIMENSIONS)
        out[some] = _data(rows.take(pa.array(some))).view(f"<i{width}").reshape(-1, DIMENSIONS)
    return out


_SUMS = "word binary, n long, context binary"


def _sums_batch(words: pa.Array, n: np.ndarray, context: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([words, pa.array(n.astype(np.int64)), context], ["word", "n", "context"])


def _run_sums(near: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums over each run of `near`, whose rows are the sums of all neighbours' `_raised` index vectors.

    Runs are cut into parts so short that bytes do not carry; parts are added after.
    """
    part = 255 // (4 * WINDOW)
    place = np.arange(len(near)) - np.repeat(starts, np.diff(np.append(starts, len(near))))
    cuts = np.flatnonzero(place % part == 0)
    sizes = np.diff(np.append(cuts, len(near)))
    sums = np.add.reduceat(near.view(np.uint64), cuts, axis=0).view(np.uint8).astype(np.int32)
    sums -= (2 * WINDOW * sizes).astype(np.int32)[:, None]
    first = np.searchsorted(cuts, starts)
    many = np.diff(np.append(first, len(cuts))) > 1
    out = sums[first]
    if many.any():
        inside = np.repeat(many, np.diff(np.append(first, len(cuts))))
        heads = np.cumsum(np.append(0, np.diff(np.append(first, len(cuts)))[many]))[:-1]
        out[many] = np.add.reduceat(sums[inside], heads, axis=0)
    return out


_AROUND = np.array([k for k in range(-WINDOW, WINDOW + 1) if k])


def _sums(tokens: list[pa.DictionaryArray], sizes: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Per token its count, and its neighbours' hashes if it is seen `FEW` times or less, else their sum.

    `tokens` and `sizes` are those of `_split`; `tokens` is emptied. Equal tokens are brought together by sorting their
    places, those of some names at a time, and added up.
    """
    spare = pa.default_memory_pool()
    spare.release_unused()  # what splitting has used
    coded = pa.chunked_array(tokens).unify_dictionaries().chunks
    tokens.clear()
    names = coded[0].dictionary
    n = np.zeros(len(names), np.int64)
    row = np.full(sum(map(len, coded)) + WINDOW * (sum(map(len, sizes)) + 1), len(names), np.int32)
    at = 0
    while coded:
        ids, size = coded.pop(0).indices.to_numpy(), sizes.pop(0)
        row[at + np.arange(len(ids)) + WINDOW * np.repeat(np.arange(1, len(size) + 1), size)] = ids
        at += len(ids) + WINDOW * len(size)
        n += np.bincount(ids, minlength=len(names))
        del ids
    spare.release_unused()
    hashes = np.append(_hashes(names), np.uint32(0))  # the last one is between texts
    vectors = _raised(hashes)
    up_to = np.cumsum(n)
    first = 0
    while first < len(names):
        last = max(first + 1, int(np.searchsorted(up_to, up_to[first] - n[first] + SORTED, side="right")))
        at = np.flatnonzero((row >= first) & (row < last))
        at |= row[at].astype(np.int64) << 32
        at.sort()
        at &= 0xFFFFFFFF
        yield from _sums_of(names[first:last], n[first:last], at, row, hashes, vectors)
        first = last


def _sums_of(names: pa.Array, n: np.ndarray, places: np.ndarray, row: np.ndarray, hashes: np.ndarray,
             vectors: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The same for some names, whose places in `row` lie one name after the other."""
    is_few = n <= FEW
    of_few = np.repeat(is_few, n)
    few, at = np.flatnonzero(is_few), places[of_few]
    ends = np.append(0, np.cumsum(n[few]))
    for a in range(0, len(few), ROWS):
        some = few[a:a + ROWS]
        b = ends[a:a + ROWS + 1]
        near = hashes.take(row.take(at[b[0]:b[-1], None] + _AROUND))
        filled = near != 0
        stop = np.append(0, np.cumsum(np.add.reduceat(filled.sum(1), b[:-1] - b[0]))) * 4
        yield _sums_batch(names.take(pa.array(some)), n[some], _binary(stop, near[filled].tobytes()))

    dense, at = np.flatnonzero(~is_few), places[~of_few]
    sums = np.zeros((len(dense), DIMENSIONS), np.int32)
    ends = np.cumsum(n[dense])
    for a in range(0, len(at), CHUNK):
        some = at[a:a + CHUNK]
        own = np.searchsorted(ends, np.arange(a, a + len(some)), side="right")
        near = vectors.take(row.take(some + _AROUND[0]), axis=0)
        for k in _AROUND[1:]:
            near += vectors.take(row.take(some + k), axis=0)
        starts = np.flatnonzero(np.diff(own, prepend=-1))
        sums[own[starts]] += _run_sums(near, starts)
    for some, context in _packed(sums):
        yield _sums_batch(names.take(pa.array(dense[some])), n[dense[some]], context)


def context_sums(docs: DataFrame, text_col: str = "text", least: int = 1) -> DataFrame:
    """(word, n, context) of all tokens seen `least` times or more: their count, and the sums of their neighbours'
    index vectors.

    The context of a token seen `FEW` times or less is its neighbours' hashes, which give the same sums.
    """
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, sizes, held = [], [], 0
        for piece in _pieces(batches, "text"):
            found, size = _split(piece.column("text"))
            tokens.append(found)
            sizes.append(size)
            held += len(found)
            if held >= HELD:
                yield from _sums(tokens, sizes)
                tokens, sizes, held = [], [], 0
        if held:
            yield from _sums(tokens, sizes)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches):
            words, context = table.column("word").combine_chunks(), table.column("context").combine_chunks()
            first = np.flatnonzero(np.append(True, pc.not_equal(words[1:], words[:-1]).to_numpy(zero_copy_only=False)))
            size = np.diff(np.append(first, len(words)))
            counts = np.add.reduceat(table.column("n").to_numpy(), first)
            is_dense = (size > 1) & (counts > FEW)
            # one row as it came, and hashes one after the other
            ends = _ends(context)
            joined = _binary(np.append(ends[first], ends[-1]) - ends[0], _data(context))
            rest = np.flatnonzero(~is_dense & (counts >= least))
            yield _sums_batch(words.take(pa.array(first[rest])), counts[rest], joined.take(pa.array(rest)))
            dense = np.flatnonzero(is_dense & (counts >= least))
            if len(dense):
                rows = np.flatnonzero(np.repeat(is_dense & (counts >= least), size))
                sums = np.add.reduceat(_unpacked(context.take(pa.array(rows))), np.cumsum(size[dense]) - size[dense], axis=0)
                for some, packed in _packed(sums):
                    yield _sums_batch(words.take(pa.array(first[dense[some]])), counts[dense[some]], packed)

    return (docs.select(text_bytes(text_col).alias("text")).mapInArrow(add, _SUMS)
            .repartition("word").sortWithinPartitions("word").mapInArrow(total, _SUMS))


def token_vectors(words: list[bytes] | pa.Array, n: np.ndarray, context: list[bytes] | pa.Array, total: int) -> np.ndarray:
    """Weighted context and index vectors, side by side; a token that the corpus lacks has no context."""
    return hashed_vectors(_hashes(words if isinstance(words, pa.Array) else pa.array(words, pa.binary())), n, context, total)


def hashed_vectors(hashes: np.ndarray, n: np.ndarray, context: list[bytes] | pa.Array, total: int) -> np.ndarray:
    """The same from the tokens' hashes."""
    sums = _unpacked(context).astype(float)
    sums /= np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1)
    weight = 1e-2 / (1e-2 + n / max(total, 1))
    return np.hstack([sums, index_of_hashes(hashes) / np.sqrt(NONZERO)]) * weight[:, None]


class Sent:
    """The tokens sent to the tasks, their counts and packed contexts, from which a task makes their vectors."""

    def __init__(self, words: pa.Array, n: np.ndarray, context: pa.Array, total: int):
        self.words, self.n, self.context, self.total = words, n, context, total
        self._made: dict[bytes, np.ndarray] = {}

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_made": {}}

    def numbers(self, names: pa.Array) -> np.ndarray:
        """The places of `names` among the tokens, -1 for those not sent."""
        return pc.fill_null(pc.index_in(names, value_set=self.words), -1).to_numpy()

    def vectors(self, matrix: np.ndarray) -> np.ndarray:
        """Vectors times `matrix`, made once in a worker."""
        key = matrix.tobytes()
        if key not in self._made:
            out = np.zeros((len(self.words), matrix.shape[1]), np.float32)
            for at in range(0, len(self.words), 10_000):
                to = at + 10_000
                out[at:to] = token_vectors(self.words[at:to], self.n[at:to], self.context[at:to], self.total) @ matrix
            self._made = {key: out}
        return self._made[key]


@dataclass
class Space:
    """What is sent to the tasks, and the table (word, n, context) of all other tokens."""

    sent: Broadcast
    rare: DataFrame
    rare_bits: Broadcast
    total: int
    scratch: Scratch

    def drop(self) -> None:
        """Remove the stored table, when nothing is scored in this space any more."""
        self.scratch.drop()


def build_space(docs: DataFrame, text_col: str = "text") -> Space:
    spark = docs.sparkSession
    scratch = Scratch(spark)
    with freed_shuffles(spark):
        table = scratch.keep(context_sums(docs, text_col, LEAST), "token-contexts")
    with freed_shuffles(spark):
        total = table.agg(F.sum("n")).first()[0] or 0
        short = F.length("word") <= LONGEST
        _, least = most_frequent(table.filter(short).select("word", "n"), SENT)
        rows = table.filter((F.col("n") >= least) & short).toPandas()
    sent = Sent(pa.array(map(bytes, rows["word"]), pa.binary()), rows["n"].to_numpy(float),
                pa.array(map(bytes, rows["context"]), pa.binary()), total)
    rare = table.filter((F.col("n") < least) | ~short)
    with freed_shuffles(spark):
        bits = bit_table(rare.select("word").mapInArrow(_keys, "key long"))
    return Space(spark.sparkContext.broadcast(sent), rare, spark.sparkContext.broadcast(bits), total, scratch)


def _key(words: list[bytes]) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(_key(_listed(batch.column(0))).view(np.int64))], ["key"])


_PARTS = "text_no long, local int, word binary, times int, doc_id long, label int, vector binary"
_POOLED = "doc_id long, label int, vector binary"


def pooled(texts: DataFrame, space: Space, matrix: np.ndarray | None = None) -> DataFrame:
    """(doc_id, label, vector) of every row of (doc_id, label, text): its mean vector, times `matrix` if given."""
    spark, total = texts.sparkSession, space.total
    matrix = np.eye(2 * DIMENSIONS) if matrix is None else matrix
    shared, space_bits, by_part = space.sent, space.rare_bits, spark.sparkContext.broadcast(matrix)
    kinds = [pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.int64(), pa.int32(), pa.binary()]
    names_of, width = [f.split()[0] for f in _PARTS.split(", ")], matrix.shape[1]

    def rows_of(tokens: pa.DictionaryArray, sizes: np.ndarray, docs_of: pa.Array, labels_of: pa.Array, text_no: int) -> Iterator[pa.RecordBatch]:
        """Rows of texts whose tokens lie one after the other."""
        vectors = shared.value.vectors(by_part.value)
        ids, names = tokens.indices.to_numpy(), tokens.dictionary
        number = shared.value.numbers(names)
        rest = np.flatnonzero(number < 0)
        unsent = _listed(names.take(pa.array(rest)))
        joined = np.zeros(len(names), bool)
        joined[rest] = in_table(space_bits.value, _key(unsent))
        # a token that is neither sent nor joined is seen once: its index vector alone
        bare = np.flatnonzero(~joined[rest])
        place = np.where(number >= 0, number, 0)
        place[rest[bare]] = np.arange(len(bare))
        hashes = np.array([zlib.crc32(unsent[i]) for i in bare.tolist()], np.uint32)
        pairs, times = np.unique(np.repeat(np.arange(len(sizes)), sizes) * len(names) + ids, return_counts=True)
        text, name = np.divmod(pairs, max(len(names), 1))
        own = np.zeros((len(sizes), width))

        def add(some: np.ndarray, values: Callable[[np.ndarray], np.ndarray]) -> None:
            for at in range(0, len(some), 20_000):
                part = some[at:at + 20_000]
                starts = np.flatnonzero(np.diff(text[part], prepend=-1))
                own[text[part[starts]]] += np.add.reduceat(values(place[name[part]]) * times[part, None], starts, axis=0)

        seen = joined[name]
        add(np.flatnonzero(number[name] >= 0), lambda at: vectors[at].astype(float))
        add(np.flatnonzero((number[name] < 0) & ~seen),
            lambda at: hashed_vectors(hashes[at], np.zeros(len(at)), [b""] * len(at), total) @ by_part.value)
        # a text's own row goes under a key that no token has, so that these rows spread evenly
        number_of = text_no + np.arange(len(sizes))
        columns = [number_of, np.full(len(sizes), -1), [b" " + n.to_bytes(8, "little") for n in number_of.tolist()], sizes, docs_of,
                   labels_of, _binary(np.arange(len(sizes) + 1) * (8 * width), own.tobytes())]
        yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, kinds)], names_of)
        text, name, times = text[seen], name[seen], times[seen]
        for at in range(0, len(text), ROWS):
            some = slice(at, at + ROWS)
            words = names.take(pa.array(name[some]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(text_no + text[some]), pa.array(name[some], pa.int32()), words, pa.array(times[some], pa.int32()),
                 *(pa.nulls(len(words), t) for t in kinds[4:])], names_of)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text_no = TaskContext.get().partitionId() << 40
        for piece in _pieces(batches, "text"):
            tokens, sizes = _split(piece.column("text"))
            yield from rows_of(tokens, sizes, *(piece.column(c).combine_chunks() for c in ("doc_id", "label")), text_no)
            text_no += len(sizes)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches):
            local = table.column("local").to_numpy()
            heads, rest = np.flatnonzero(local < 0), np.flatnonzero(local >= 0)
            values = np.zeros((len(local), width))
            values[heads] = _data(table.column("vector").take(heads).combine_chunks()).view("<f8").reshape(-1, width)
            for at in range(0, len(rest), 20_000):
                some = rest[at:at + 20_000]
                part = table.select(["hash", "n", "context", "times"]).take(some)
                vectors = hashed_vectors(part.column("hash").to_numpy().astype(np.uint32),
                                         part.column("n").fill_null(0).to_numpy().astype(float),
                                         part.column("context").fill_null(b"").combine_chunks(), total)
                values[some] = vectors * part.column("times").to_numpy()[:, None] @ by_part.value
            values = np.add.reduceat(values, heads, axis=0)
            values /= np.maximum(table.column("times").take(heads).to_numpy(), 1)[:, None]
            own = table.take(heads)
            yield pa.RecordBatch.from_arrays(
                [own.column("doc_id").combine_chunks(), own.column("label").combine_chunks(),
                 _binary(np.arange(len(values) + 1) * (8 * width), values.tobytes())], ["doc_id", "label", "vector"])

    # a token's index vector follows from its hash, so its bytes stay behind
    return (texts.select("doc_id", "label", "text").mapInArrow(split, _PARTS)
            .join(space.rare, "word", "left")
            .select(*[c for c in names_of if c != "word"], F.crc32("word").alias("hash"), "n", "context")
            .repartition("text_no").sortWithinPartitions("text_no", "local").mapInArrow(summed, _POOLED))


@dataclass
class Network:
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -50, 50)))


def constant(width: int, share: float) -> Network:
    """The network that gives every row the same probability."""
    share = min(max(share, 1e-6), 1 - 1e-6)
    return Network(np.zeros(width), np.ones(width), np.zeros((width, 1)), np.zeros(1), np.zeros(1),
                   float(np.log(share / (1 - share))))


def train(x: np.ndarray, y: np.ndarray, kept_back: np.ndarray, epochs: int = EPOCHS,
          rate: float = 0.01, decay: float = 1e-3) -> Network:
    """Adam on the logistic loss; the temperature minimises the loss of the rows kept back."""
    if len(np.unique(y)) < 2:
        return constant(x.shape[1], float(y.mean()) if len(y) else 0.5)
    if len(np.unique(y[~kept_back])) < 2:
        kept_back = np.zeros(len(y), bool)
    draw = np.random.default_rng(7)
    fit, width = ~kept_back, x.shape[1]
    scale = np.maximum(x[fit].std(0), 1e-6)
    net = Network(x[fit].mean(0), scale, draw.normal(0, 1 / np.sqrt(width), (width, HIDDEN)), np.zeros(HIDDEN),
                  draw.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), 0.0)
    z, t = (x[fit] - net.mean) / scale, y[fit]
    parts = [net.w1, net.b1, net.w2, np.zeros(1)]
    first, second = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
    for step in range(1, epochs + 1):
        w1, b1, w2, b2 = parts
        h = np.tanh(z @ w1 + b1)
        wrong = (1 / (1 + np.exp(-np.clip(h @ w2 + b2[0], -50, 50))) - t) / len(t)
        back = np.outer(wrong, w2) * (1 - h * h)
        slopes = [z.T @ back + decay * w1, back.sum(0), h.T @ wrong + decay * w2, np.array([wrong.sum()])]
        for p, g, m, v in zip(parts, slopes, first, second):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    net.b2 = float(parts[3][0])
    if kept_back.any():
        logits, truth = net.logits(x[kept_back]), y[kept_back]
        tries = np.exp(np.linspace(np.log(0.25), np.log(8), 81))
        loss = [np.logaddexp(0, np.where(truth == 1, -1, 1) * logits / k).mean() for k in tries]
        net.temperature = float(tries[int(np.argmin(loss))])
    return net


def fit(docs: DataFrame, labels: DataFrame, space: Space, label_col: str = "quality", id_col: str = "doc_id",
        text_col: str = "text", sample: int = SAMPLE) -> Network:
    """The network from at most `sample` rows of `labels`; every fifth is kept back to calibrate."""
    chosen = (labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
              .filter("doc_id IS NOT NULL AND label IS NOT NULL").groupBy("doc_id").agg(F.min("label").alias("label"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("text"))
    with freed_shuffles(docs.sparkSession):
        rows = (pooled(texts.join(F.broadcast(chosen), "doc_id"), space)
                .orderBy(F.xxhash64("doc_id"), "doc_id", "vector").limit(2 * sample).toPandas())
    x = np.frombuffer(b"".join(map(bytes, rows["vector"])), "<f8").reshape(len(rows), 2 * DIMENSIONS)
    kept_back = np.array([zlib.crc32(b"kept back %d" % i) % 5 == 0 for i in rows["doc_id"]], bool)
    return train(x, (rows["label"].to_numpy() == 1).astype(float), kept_back)


def score(docs: DataFrame, space: Space, network: Network, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """doc_id and score (the probability of label 1) of every row."""
    first = network.w1 / network.scale[:, None]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _data(batch.column(2)).view("<f8").reshape(batch.num_rows, first.shape[1])
            hidden = np.tanh(x - network.mean @ first + network.b1)
            logits = (hidden @ network.w2 + network.b2) / network.temperature
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(logits, -50, 50))))],
                                             ["doc_id", "score"])

    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.lit(None).cast("int").alias("label"),
                        text_bytes(text_col).alias("text"))
    scores = []
    for k in range(SLICES):
        with freed_shuffles(spark):
            some = texts.filter(F.pmod(F.xxhash64("doc_id"), F.lit(SLICES)) == k)
            scores.append(Scratch(spark).keep(pooled(some, space, first).mapInArrow(run, "doc_id long, score double"),
                                              "quality-scores"))
    return reduce(DataFrame.unionAll, scores)
