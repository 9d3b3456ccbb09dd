"""Byte-level BPE: encoding by a lazily determinised transducer, decoding by a UTF-8 machine.

Encoding. A rank file gives the tokens; pairs merge by the rank of what they give, lowest first
and leftmost in ties. A token sequence is the encoding of its bytes exactly if every two
neighbours are the encoding of theirs, so the encoding of a prefix ends in the one token that
agrees with what the encoding of the shorter prefix ends in. The transducer reads a byte at a
time. Its nondeterministic part holds every position from which a longer token may still start:
the place in the trie of tokens and the token before it. A state is the set of these; each
transition gives the token that ends at its byte. Tokens on which all positions of the set agree,
walking back from each, are written after every `LOOKAHEAD` bytes. States and transitions are
made when they are first met, and dropped all at once when there are more than `STATES_KEPT`.

The text is first split by a pattern, and each match is encoded on its own, without special
tokens. Workers remember up to `MATCHES_KEPT` matches of at most `MATCH_LENGTH_KEPT` characters.

Decoding. `StreamDecoder` takes ids in any portions and returns the text that is complete so far;
at most three bytes wait between portions. Bytes that are not UTF-8 become U+FFFD, one for each
maximal part of a character.

Defined results: a null or empty text has no ids, no or null ids give the empty text. An id that
the rank file does not have raises. Other columns stay as they are.
"""

from __future__ import annotations

import base64
import os
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STATES_KEPT = 300_000
LOOKAHEAD = 256
PAIRS_KEPT = 500_000
MATCHES_KEPT = 600_000
MATCH_LENGTH_KEPT = 64  # characters

_ROOT = 0
_PLACE = 24  # a place is a node above these bits, which hold the token before it plus one, or zero


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Transducer:
    """Encodes the bytes of one match at a time."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.child: dict[int, int] = {}
        self.ends: list[int] = [-1]
        self.depth: list[int] = [0]  # of a node, which is how many bytes ago its token started
        for token, rank in ranks.items():
            node = _ROOT
            for byte in token:
                step = node << 8 | byte
                node = self.child.get(step, -1)
                if node < 0:
                    node = self.child[step] = len(self.ends)
                    self.ends.append(-1)
                    self.depth.append(self.depth[step >> 8] + 1)
            self.ends[node] = rank
        self.grows = [False] * len(self.ends)  # whether a longer token goes on from the node
        for step in self.child:
            self.grows[step >> 8] = True
        self.size = {rank: len(token) for rank, token in self.tokens.items()}
        self.pairs: dict[int, bool] = {}
        self.spines: dict[tuple[int, bool], list[tuple[bytes, int, int]]] = {}
        self._forget()

    def _forget(self) -> None:
        start = (_ROOT,)
        self.numbers = {start: 0}
        self.states = [start]
        self.last = [-1]  # the token that ends where the state is reached
        self.step: dict[int, int] = {}

    def _spine(self, token: int, right: bool) -> list[tuple[bytes, int, int]]:
        """The tokens that stand at the edge of `token` while it is merged: bytes, and the ranks
        at which each comes and goes. The bytes' own rank for a single byte counts as -1."""
        known = self.spines.get((token, right))
        if known is None:
            known, gone, top = [], 1 << 30, token
            while True:
                data = self.tokens[token]
                if len(data) == 1:
                    known.append((data, -1, gone))
                    break
                known.append((data, token, gone))
                gone, token = token, self._halves(data)[right]
            self.spines[top, right] = known
        return known

    def _halves(self, data: bytes) -> tuple[int, int]:
        """The two tokens whose merge gives the token `data`."""
        parts = [data[i:i + 1] for i in range(len(data))]
        while len(parts) > 2:
            _, at = min((self.ranks.get(a + b, 1 << 30), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return self.ranks[parts[0]], self.ranks[parts[1]]

    def agree(self, left: int, right: int) -> bool:
        """Whether the two tokens are the encoding of their bytes.

        They are not if some merge across their border comes before the merges that take the two
        tokens at the border away. Of equal ranks the leftmost merge is first.
        """
        pair = left << _PLACE | right
        known = self.pairs.get(pair)
        if known is None:
            if len(self.pairs) > PAIRS_KEPT:
                self.pairs.clear()
            known = self.pairs[pair] = self._agree(left, right)
        return known

    def _agree(self, left: int, right: int) -> bool:
        rank_of, none, after = self.ranks.get, 1 << 30, self._spine(right, False)
        for a, a_comes, a_goes in self._spine(left, True):
            for b, b_comes, b_goes in after:
                rank = rank_of(a + b, none)
                if rank < none and a_comes < rank < a_goes and b_comes < rank <= b_goes:
                    return False
        return True

    def _advance(self, number: int, byte: int) -> int:
        """The next state."""
        live, end, child = [], -1, self.child.get
        for place in self.states[number]:
            node = child(place >> _PLACE << 8 | byte)
            if node is None:
                continue
            before = place & (1 << _PLACE) - 1
            token = self.ends[node]
            if end < 0 and token >= 0 and (not before or self.agree(before - 1, token)):
                end = token
            if self.grows[node]:
                live.append(node << _PLACE | before)
        if end < 0:
            raise ValueError("a byte that no token covers")
        live.append(end + 1)  # at the root
        state = tuple(live)
        to = self.numbers.get(state)
        if to is None:
            to = self.numbers[state] = len(self.states)
            self.states.append(state)
            self.last.append(end)
        return to

    def encode(self, data: bytes) -> list[int]:
        if len(self.states) > STATES_KEPT:
            self._forget()
        out: list[int] = []
        path: list[int] = []  # the states after each byte not yet written
        state, known, add = 0, self.step.get, path.append
        for at in range(0, len(data), LOOKAHEAD):
            if at:
                written = self._common(path, [self.depth[p >> _PLACE] for p in self.states[state]])
                out += self._back(path, written)
                del path[:written]
            for byte in data[at:at + LOOKAHEAD]:
                move = state << 8 | byte
                state = known(move)
                if state is None:
                    state = self.step[move] = self._advance(move >> 8, byte)
                add(state)
        return out + self._back(path, len(path))

    def _back(self, path: list[int], at: int) -> list[int]:
        tokens, last, size = [], self.last, self.size
        while at:
            token = last[path[at - 1]]
            tokens.append(token)
            at -= size[token]
        tokens.reverse()
        return tokens

    def _common(self, path: list[int], ages: list[int]) -> int:
        """The last boundary that lies on the ways back from all live positions."""
        at = {len(path) - age for age in ages}
        while len(at) > 1:
            far = max(at)
            at.remove(far)
            at.add(far - self.size[self.last[path[far - 1]]])
        return at.pop()


class Matches(dict):
    """The ids of each match, as bytes; short ones are remembered."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.transducer = Transducer(ranks)

    def __missing__(self, match: str) -> bytes:
        ids = array("i", self.transducer.encode(match.encode())).tobytes()
        if len(match) <= MATCH_LENGTH_KEPT:
            self[match] = ids
        return ids


class Encoder:
    """Ids of whole texts: the pattern's matches, each by the transducer."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.known = Matches(ranks)
        self.split = regex.compile(pattern).findall

    def encode(self, text: str) -> np.ndarray:
        if len(self.known) > MATCHES_KEPT:
            self.known.clear()
        return np.frombuffer(b"".join(map(self.known.__getitem__, self.split(text))), "<i4")


class StreamDecoder:
    """Text of a stream of ids, as far as its characters are complete."""

    def __init__(self, tokens: dict[int, bytes]):
        self.tokens = tokens
        self.waiting = b""
        self.known: dict[tuple[bytes, int], tuple[str, bytes]] = {}
        self.whole: dict[int, str] = {}  # tokens that are whole characters

    @staticmethod
    def _bounds(lead: int) -> tuple[int, int, int]:
        """Bytes that follow a lead byte, and the range of the first of them."""
        if 0xC2 <= lead <= 0xDF:
            return 1, 0x80, 0xBF
        if 0xE0 <= lead <= 0xEF:
            return 2, 0xA0 if lead == 0xE0 else 0x80, 0x9F if lead == 0xED else 0xBF
        if 0xF0 <= lead <= 0xF4:
            return 3, 0x90 if lead == 0xF0 else 0x80, 0x8F if lead == 0xF4 else 0xBF
        return 0, 0, 0

    def _run(self, data: bytes) -> tuple[str, bytes]:
        text, at = [], 0
        while at < len(data):
            lead = data[at]
            if lead < 0x80:
                text.append(chr(lead))
                at += 1
                continue
            follow, low, high = self._bounds(lead)
            to = at + 1
            while follow and to < len(data) and low <= data[to] <= high:
                follow, low, high, to = follow - 1, 0x80, 0xBF, to + 1
            if follow and to == len(data):
                return "".join(text), data[at:]
            whole = not follow and to > at + 1
            text.append(data[at:to].decode() if whole else "�")
            at = to
        return "".join(text), b""

    def feed(self, ids) -> str:
        known, waiting, whole, text = self.known, self.waiting, self.whole.get, []
        if not waiting:
            text = list(map(whole, ids))
            if None not in text:
                return "".join(text)
            text = []
        for i in ids:
            if not waiting and (part := whole(i)) is not None:
                text.append(part)
                continue
            to = known.get((waiting, i))
            if to is None:
                to = known[waiting, i] = self._run(waiting + self.tokens[i])
                if not waiting and not to[1]:
                    self.whole[i] = to[0]
            part, waiting = to
            text.append(part)
        self.waiting = waiting
        if len(known) > STATES_KEPT:
            known.clear()
        return "".join(text)

    def close(self) -> str:
        """What is left: an unfinished character."""
        rest, self.waiting = self.waiting, b""
        return "�" if rest else ""


_of_worker: dict[tuple[str, str], Encoder] = {}
_decoders: dict[str, StreamDecoder] = {}


def _ship(spark: SparkSession, path: str) -> str:
    spark.sparkContext.addFile(path)
    return os.path.basename(path)


def encode(docs: DataFrame, ranks: str, pattern: str, text_col: str = "text",
           out_col: str = "ids") -> DataFrame:
    """`docs` with the ids of its text as array<int>. `ranks` is the path of a rank file."""
    name = _ship(docs.sparkSession, ranks)

    @F.arrow_udf("array<int>")
    def ids_of(texts: pa.Array) -> pa.Array:
        key = (name, pattern)
        if key not in _of_worker:
            _of_worker[key] = Encoder(read_ranks(SparkFiles.get(name)), pattern)
        run = _of_worker[key].encode
        parts = [run(t.as_py()) for t in texts]
        offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts], dtype=np.int64)])
        values = np.concatenate(parts) if parts else np.empty(0, np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32()))

    return docs.withColumn(out_col, ids_of(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))


def decode(docs: DataFrame, ranks: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """`docs` with the text of its ids."""
    name = _ship(docs.sparkSession, ranks)

    @F.arrow_udf("string")
    def text_of(ids: pa.Array) -> pa.Array:
        if name not in _decoders:
            _decoders[name] = StreamDecoder({i: t for t, i in read_ranks(SparkFiles.get(name)).items()})
        decoder, out = _decoders[name], []
        flat, offsets = ids.values.to_numpy(), ids.offsets.to_numpy()
        for a, b in zip(offsets[:-1], offsets[1:]):
            out.append("".join([decoder.feed(flat[at:min(b, at + 65536)].tolist())
                                for at in range(a, b, 65536)]) + decoder.close())
        return pa.array(out, pa.string())

    return docs.withColumn(out_col, text_of(F.coalesce(F.col(ids_col), F.array().cast("array<int>"))))
