"""Token ids of the tokenizers library, learnt per word.

The tokenizers files used here drop white space and never merge across it, so a text's ids are
those of its words one after the other. Workers keep the ids of words and word parts they have
met, up to a fixed number and size, and only new parts go through the library. The file's added
tokens hold no white space either, and get their own ids where a text holds them.
"""

from __future__ import annotations

import os
from array import array
from unicodedata import is_normalized

import regex
from pyspark import SparkFiles
from pyspark.sql import SparkSession

WORDS_KEPT = 700_000
PARTS_KEPT = 300_000
BYTES_KEPT = 64_000_000  # of words; few words may be very long

_encoders: dict = {}


def ship(spark: SparkSession, path: str) -> str:
    """Send a tokenizer file to the executors; the name by which `encoder` finds it there."""
    spark.sparkContext.addFile(path)
    return os.path.basename(path)


def encoder(name: str) -> WordEncoder:
    """This worker's encoder of a shipped file."""
    if name not in _encoders:
        _encoders[name] = WordEncoder(SparkFiles.get(name))
    return _encoders[name]


def _byte_chars() -> dict[int, int]:
    """How byte-level vocabularies write bytes: printable Latin-1 as it is, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: 256 + i for i, b in enumerate(others)}


_BYTE_CHARS = _byte_chars()


class WordEncoder:
    """Ids of UTF-8 texts as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        # the file's added tokens count as such in a text; words that hold one go through the library whole
        added = sorted((t.content for t in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.added = regex.compile("|".join(map(regex.escape, added)) or r"(?!)")
        self.words: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.held = 0  # bytes of the words kept
        # letters are merged together; digits stand alone and so need no part of their own
        self.split = regex.compile(r"\p{L}+|[^\s\p{L}]+")

    def _of_parts(self, parts: list[str]) -> None:
        """Letters are one word of the model and need none of the library's splitting."""
        model, known, mixed = self.tokenizer.model.tokenize, self.parts, []
        for part in parts:
            if not part.isalpha():
                mixed.append(part)
                continue
            shown = part if part.isascii() else part.encode().decode("latin-1").translate(_BYTE_CHARS)
            known[part] = array("I", [t.id for t in model(shown)]).tobytes()
        for part, found in zip(mixed, self.tokenizer.encode_batch_fast(mixed, add_special_tokens=False)):
            known[part] = array("I", found.ids).tobytes()

    def _parts_of(self, word: bytes) -> list[str]:
        """Stretches of letters and of other characters, in the tokenizer's normal form."""
        text = word.decode("utf-8", "replace")
        if self.added.search(text):
            return [text]
        if text.isascii():
            normal = text.lower()
        elif is_normalized("NFC", text) and "\u03a3" not in text:  # a sigma's lower case depends on its place
            normal = text.lower()
        else:
            normal = self.tokenizer.normalizer.normalize_str(text)
        if normal.isalpha():
            return [normal]
        if "'" in text or not text.isprintable():  # contractions; blanks beyond ASCII
            return [text]
        return self.split.findall(normal)

    def _learn(self, words: list[bytes]) -> None:
        if len(self.parts) > PARTS_KEPT:
            self.parts.clear()
        known, split = self.parts, list(map(self._parts_of, words))
        new = list({p for parts in split for p in parts if p not in known})
        for at in range(0, len(new), 20_000):
            self._of_parts(new[at:at + 20_000])
        for word, parts in zip(words, split):
            self.held += len(word)
            self.words[word] = known[parts[0]] if len(parts) == 1 else b"".join([known[p] for p in parts])

    def encode(self, text: bytes) -> bytes:
        if self.held > BYTES_KEPT:
            self.parts.clear()
        if len(self.words) > WORDS_KEPT or self.held > BYTES_KEPT:
            self.words.clear()
            self.held = 0
        words, known = text.split(), self.words
        if new := set(words).difference(known):
            self._learn(list(new))
        return b"".join(map(known.__getitem__, words))
