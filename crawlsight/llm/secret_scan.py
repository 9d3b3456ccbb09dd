"""Secrets in texts: pattern candidates, of which a random forest takes out the false ones.

Candidates are long runs of key characters with a digit or with changes of case, values of any
length assigned to a name that holds a secret-like one (a quoted value up to its closing quote, an
unquoted one up to a blank, quote or `<>|,;`), what follows Bearer, passwords in URLs, private
keys in PEM, and tokens with a provider's prefix. The forest sees a candidate's length, how it moves between
kinds of characters, how much of it words of the dictionary cover, its path, and the words around
it. It learns from labelled findings: (text, start, stop, label, path).

`derived_findings` labels candidates of a corpus where their form leaves no doubt: a provider's
prefix with the right length and a random-looking value assigned to a secret-like name are
secrets; numbers, hosts and mail addresses, words, placeholders and values directly named as a
digest or the like are not. The others are left to the forest, among them values whose name is
both secret-like and harmless. The forest is fitted on at most `SAMPLE` findings. It never takes
out a provider's token in full form, whatever the words before it, since the corpus may hold none
to learn from; only a token that is itself a placeholder is none.

The dictionary holds words of letters with at least 1/`DICTIONARY` of all words.

Defined results: a null or empty text has no candidates. Spans are in code points, half open, and
do not overlap. Every row is scanned on its own, repeated rows alike; rows stay apart by id only.
Without findings of both labels nothing is taken out: every candidate counts as a secret. Columns
beside id, text and path are not read, and `redact` leaves them as they are, but for a length
column it is told to renew. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_bytes
from .forest import Forest, grow
from .vocabulary import frequent, word_counts

SAMPLE = 20_000
DICTIONARY = 1 << 14
THRESHOLD = 0.5
MASK = "[SECRET]"

# Names that secrets are assigned to, and names of harmless values.
SECRET_NAMES = ("token", "secret", "password", "passwd", "pwd", "passphrase", "apikey", "api_key", "api-key",
                "access_key", "access-key", "private_key", "client_secret", "credential", "credentials",
                "auth", "bearer", "authorization")
HARMLESS_NAMES = ("sha", "sha1", "sha256", "md5", "checksum", "digest", "hash", "commit", "uuid", "guid", "isbn",
                  "version", "phone", "card", "order", "invoice", "id", "ref", "build", "rev", "revision")
PLACEHOLDERS = ("example", "changeme", "placeholder", "dummy", "xxxx", "your_", "your-", "sample", "test", "1234567")
# A token is a placeholder by these: shorter ones turn up in random tokens by chance.
TOKEN_PLACEHOLDERS = ("example", "changeme", "placeholder", "xxxxxx", "your_", "your-", "sample", "1234567")
PATH_HINTS = ("test", "example", "sample", "doc", "mock", "spec", "fixture")
# Prefixes of providers' tokens.
PREFIXED = (r"AKIA[0-9A-Z]{16}", r"ASIA[0-9A-Z]{16}", r"gh[pousr]_[0-9A-Za-z]{36,}", r"github_pat_[0-9A-Za-z_]{22,}",
            r"glpat-[0-9A-Za-z_-]{20,}", r"xox[abeoprs]-[0-9A-Za-z-]{10,}", r"xapp-[0-9A-Za-z-]{20,}",
            r"[sr]k_(?:live|test)_[0-9A-Za-z]{16,}", r"whsec_[0-9A-Za-z+/=]{24,}", r"AIza[0-9A-Za-z_-]{35}",
            r"ya29\.[0-9A-Za-z_-]{20,}", r"sk-(?=[\w-]*[0-9])(?=[\w-]*[A-Z])[0-9A-Za-z_-]{20,}",
            r"npm_[0-9A-Za-z]{36}", r"pypi-[0-9A-Za-z_-]{50,}", r"hf_[0-9A-Za-z]{30,}", r"shp(?:at|ca|pa|ss)_[0-9a-fA-F]{32}",
            r"dop_v1_[0-9a-f]{64}", r"SG\.[0-9A-Za-z_-]{16,}\.[0-9A-Za-z_-]{32,}",
            r"eyJ[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]{8,}")

_NAMES = "|".join(sorted((re.escape(n) for n in SECRET_NAMES), key=len, reverse=True))
_PREFIXED = re.compile(rf"(?<![0-9A-Za-z])(?:{'|'.join(PREFIXED)})(?![0-9A-Za-z])")
_ANY_NAME = re.compile(_NAMES, re.I)
_SEPARATOR = re.compile(r"=>|:=|={1,3}|:")
_VALUE = re.compile(r"""(?x) \s{0,3}
    (?: \\? (?P<quote>["'`]) (?: (?i:bearer|basic) \s+ )? (?P<quoted> (?: \\. | (?!(?P=quote)) [^\\\n] )++ ) (?P=quote)
      | ["'`]? (?: (?i:bearer|basic) \s+ )? (?P<bare> [^\s"'<>|,;]+ ) )""")
_BEARER = re.compile(r"(?i)(?<![0-9a-z])bearer\s+([0-9a-z+/_=.~-]{8,})")
_URL = re.compile(r"://[^\s/@:\"'<>]*+:([^\s/@\"'<>]++)@")
_PEM = re.compile(r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY[A-Z ]*-----")
_PEM_END = re.compile(r"-----END [A-Z0-9 ]*PRIVATE KEY[A-Z ]*-----")
_PEM_LINES = re.compile(r"(?:(?:\s|\\[rn])*[0-9A-Za-z+/=]{16,})*+")
_RUN = re.compile(r"(?<![0-9A-Za-z+/_=.-])(?=[0-9A-Za-z+/_=.-]*[0-9])[0-9A-Za-z+/_=.-]{16,}"
                  r"|(?<![0-9A-Za-z+/_=.-])(?=[0-9A-Za-z+/_=.-]*[a-z][A-Z]+[a-z]+[A-Z])[0-9A-Za-z+/_=.-]{16,}")
_WORDS = re.compile(r"[^\W\d_]+")
_NAME_BEFORE = re.compile(r"([\w.-]+)[\"'`]?(?:\s{0,3}(?:=>|[:=])\s{0,3}|\s{1,3})(?:bearer\s+|basic\s+)?[\"'`]?$", re.I)
_CASES = re.compile(r"[a-z][A-Z]+[a-z]+[A-Z]")
_NAME_PARTS = re.compile(r"[A-Z]?[a-z]+[0-9]*|[A-Z]+[0-9]*")
_SECRET_NAME = re.compile(rf"(?:.*(?:{'|'.join(n for n in SECRET_NAMES if len(n) > 4)})|.*(?<![a-z])(?:auth|pwd))$")

FEATURES = ("length", "letters", "digits", "kinds", "moves", "entropy", "hex", "dictionary", "longest_word",
            "path_depth", "path_hint", "secret_before", "harmless_before", "assigned", "quoted", "at_sign",
            "placeholder", "word_after")


def assigned_values(text: str) -> Iterator[tuple[int, int]]:
    """Spans of values after a separator and a name that holds a secret-like one."""
    for m in _SEPARATOR.finditer(text):
        stop = m.start()
        while stop and m.start() - stop < 3 and text[stop - 1].isspace():
            stop -= 1
        for c in ("\"'`", "\\"):
            stop -= bool(stop and text[stop - 1] in c)
        start = stop
        while start and (text[start - 1].isalnum() or text[start - 1] in "_.-"):
            start -= 1
        if start < stop and _ANY_NAME.search(text, start, stop) and (v := _VALUE.match(text, m.end())):
            yield v.span("quoted" if v["quoted"] else "bare")


def pem_blocks(text: str) -> Iterator[tuple[int, int]]:
    """Private keys up to their end line, or without one up to the last line of the key."""
    at, ends = 0, True
    while m := _PEM.search(text, at):
        end = _PEM_END.search(text, m.end()) if ends else None
        ends = end is not None
        at = end.end() if end else _PEM_LINES.match(text, m.end()).end()
        yield m.start(), at


def candidates(text: str) -> list[tuple[int, int, str]]:
    """(start, stop, pattern) in order, without overlaps; the more telling pattern wins."""
    found: list[tuple[int, int, str]] = [(*m.span(), "prefix") for m in _PREFIXED.finditer(text)]
    found += [(*span, "pem") for span in pem_blocks(text)]
    found += [(*span, "assigned") for span in assigned_values(text)]
    for pattern, group, name in ((_BEARER, 1, "assigned"), (_URL, 1, "assigned"), (_RUN, 0, "run")):
        for m in pattern.finditer(text):
            found.append((*m.span(group), name))
    taken: list[tuple[int, int, str]] = []
    rank = {"pem": 0, "prefix": 1, "assigned": 2, "run": 3}
    last = -1
    # sweep from the left: of candidates that overlap the best one is kept
    for start, stop, name in sorted(found):
        if start >= last:
            taken.append((start, stop, name))
        elif "run" not in (name, taken[-1][2]):  # a provider's token within a value and the like: all of both
            taken[-1] = (taken[-1][0], max(stop, taken[-1][1]), min(name, taken[-1][2], key=rank.get))
        elif rank[name] < rank[taken[-1][2]]:
            taken[-1] = (start, stop, name)
        last = taken[-1][1]
    return taken


def kind(c: str) -> int:
    return 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3


def secret_name(name: str) -> bool:
    """Whether a name has a part, or two, that secrets are assigned to."""
    parts = [p.lower() for p in _NAME_PARTS.findall(name)]
    return any(w in SECRET_NAMES or _SECRET_NAME.match(w) for w in parts) or any(
        f"{a}_{b}" in SECRET_NAMES for a, b in zip(parts, parts[1:]))


def harmless_name(before: str) -> bool:
    """Whether what follows `before` is directly named as something harmless."""
    m = _NAME_BEFORE.search(before)
    parts = _NAME_PARTS.findall(m[1]) if m else []
    return bool(parts) and parts[-1].lower() in HARMLESS_NAMES


def placeholder_token(token: str) -> bool:
    return len(set(token)) < 6 or any(p in token.lower() for p in TOKEN_PLACEHOLDERS)


def features(text: str, start: int, stop: int, path: str, dictionary: frozenset[str]) -> list[float]:
    """`FEATURES` of a candidate."""
    value = text[start:stop]
    size = max(len(value), 1)
    kinds = [kind(c) for c in value]
    before, after = text[max(0, start - 60):start], text[stop:stop + 40]
    near = re.findall(r"[\w-]+", before)[-3:]
    words = [w.lower() for w in _WORDS.findall(value)]
    known = [w for w in words if w in dictionary]
    shares = [value.count(c) / size for c in set(value)]
    low, places = value.lower(), path.lower()
    follow = _WORDS.findall(after)
    return [float(len(value)), sum(k < 2 for k in kinds) / size, kinds.count(2) / size, float(len(set(kinds))),
            sum(a != b for a, b in zip(kinds, kinds[1:])) / size, -sum(p * math.log2(p) for p in shares),
            sum(c in "0123456789abcdefABCDEF" for c in value) / size, sum(map(len, known)) / size,
            float(max(map(len, words), default=0)), float(places.count("/")),
            float(any(h in places for h in PATH_HINTS)), float(any(map(secret_name, near))),
            float(harmless_name(before)), float(before.rstrip().rstrip("\"'").rstrip().endswith(("=", ":"))),
            float(before.endswith(("\"", "'"))), float("@" in value + after[:1]),
            float(any(p in low for p in PLACEHOLDERS)),
            float(follow[0].lower() in dictionary) if follow else 0.0]


def certain_label(text: str, start: int, stop: int, pattern: str) -> int | None:
    """1 or 0 where a candidate's form leaves no doubt."""
    value, low = text[start:stop], text[start:stop].lower()
    if pattern == "pem":
        return 1
    if pattern == "prefix":
        return int(not all(placeholder_token(m[0]) for m in _PREFIXED.finditer(value)))
    if any(p in low for p in PLACEHOLDERS):
        return 0
    before = text[max(0, start - 60):start]
    if harmless_name(before):
        return None if any(map(secret_name, re.findall(r"[\w-]+", before)[-3:])) else 0
    mixed = any(c.isdigit() for c in value) and any(c.isalpha() for c in value)
    if pattern == "assigned":
        named = [w for w in re.findall(r"[\w-]+", before)[-2:] if secret_name(w)]
        if mixed and len(set(value)) >= 6:
            return 1 if named or text[start - 1:start] == ":" and text[stop:stop + 1] == "@" else None
        # only words are beyond doubt: a short value, or one of letters in no word's case, may be a password
        return 0 if re.fullmatch(r"[^\W\d_]?[^\W\d_A-Z]+|[A-Z]+", value) and len(value) < 16 else None
    if _CASES.search(value):
        return None
    if re.fullmatch(r"[\d.+/_=-]+|[^\W\d_]+", value) or re.search(r"@|[a-z]\.[a-z]{2,}", low):
        return 0
    return None


@dataclass
class Scanner:
    forest: Forest | None
    dictionary: frozenset[str]

    def findings(self, text: str, path: str = "") -> list[tuple[int, int, str, float]]:
        """(start, stop, pattern, probability) of every candidate."""
        spans = candidates(text)
        if not spans:
            return []
        if self.forest is None:
            return [(*s, 1.0) for s in spans]
        x = np.array([features(text, a, b, path, self.dictionary) for a, b, _ in spans])
        certain = [s[2] in ("pem", "prefix") and certain_label(text, *s) == 1 for s in spans]
        return [(*s, 1.0 if sure else float(p))
                for s, sure, p in zip(spans, certain, self.forest.probabilities(x))]

    def redacted(self, text: str, path: str = "", mask: str = MASK) -> str:
        out, at = [], 0
        for start, stop, _, p in self.findings(text, path):
            if p >= THRESHOLD:
                out += [text[at:start], mask]
                at = stop
        return "".join(out) + text[at:] if out else text


def _words(text: bytes) -> list[bytes]:
    return _LETTERS(text.lower())


_LETTERS = re.compile(rb"[a-z\x80-\xff]{2,}").findall


def dictionary_of(docs: DataFrame, text_col: str = "text") -> frozenset[str]:
    counts = word_counts(docs, _words, text_col).persist()
    total = counts.agg(F.sum("n")).first()[0] or 0
    words = frequent(counts, total, DICTIONARY)
    counts.unpersist()
    return frozenset(w.decode("utf-8", "replace") for w in words)


def _path(docs: DataFrame, path_col: str | None):
    return F.coalesce(F.col(path_col).cast("string"), F.lit("")) if path_col else F.lit("")


def derived_findings(docs: DataFrame, text_col: str = "text", path_col: str | None = None,
                     around: int = 100) -> DataFrame:
    """Labelled findings (text, start, stop, label, path) of a corpus; text is what lies around."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string())
        for batch in batches:
            out: list[list] = [[] for _ in kinds]
            for raw, path in zip(batch.column(0), batch.column(1).to_pylist()):
                text = raw.as_py().decode("utf-8", "replace")
                for start, stop, pattern in candidates(text):
                    label = certain_label(text, start, stop, pattern)
                    if label is not None:
                        first = max(0, start - around)
                        for column, v in zip(out, (text[first:stop + around], start - first, stop - first, label, path)):
                            column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)],
                                             ["text", "start", "stop", "label", "path"])

    return docs.select(text_bytes(text_col).alias("text"), _path(docs, path_col).alias("path")).mapInArrow(
        run, "text string, start int, stop int, label int, path string")


def train(findings: DataFrame, dictionary: frozenset[str], sample: int = SAMPLE) -> Scanner:
    """A scanner from at most `sample` labelled findings, equal ones once."""
    rows = (findings.filter("text IS NOT NULL AND label IS NOT NULL").distinct()
            .orderBy(F.xxhash64("text", "start", "path"), "text", "start", "stop", "label", "path")
            .limit(sample).collect())
    x = np.array([features(r.text, r.start, r.stop, r.path or "", dictionary) for r in rows]).reshape(-1, len(FEATURES))
    y = np.array([r.label for r in rows], float)
    return Scanner(grow(x, y) if len(set(y.tolist())) == 2 else None, dictionary)


def scanner_of(docs: DataFrame, text_col: str = "text", path_col: str | None = None) -> Scanner:
    """A scanner that has learnt from the corpus it will scan."""
    return train(derived_findings(docs, text_col, path_col), dictionary_of(docs, text_col))


def scan(docs: DataFrame, scanner: Scanner, id_col: str = "doc_id", text_col: str = "text",
         path_col: str | None = None) -> DataFrame:
    """A row per candidate: doc_id, start, stop, pattern, crc32 of the value, probability, is_secret."""
    shared = docs.sparkSession.sparkContext.broadcast(scanner)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.float64(), pa.bool_())
        for batch in batches:
            out: list[list] = [[] for _ in kinds]
            for doc, raw, path in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                text = raw.as_py().decode("utf-8", "replace")
                for start, stop, pattern, p in shared.value.findings(text, path):
                    for column, v in zip(out, (doc, start, stop, pattern, zlib.crc32(text[start:stop].encode()),
                                               p, p >= THRESHOLD)):
                        column.append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(out, kinds)],
                ["doc_id", "start", "stop", "pattern", "value_crc32", "probability", "is_secret"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("text"),
                       _path(docs, path_col).alias("path")).mapInArrow(
        run, "doc_id long, start int, stop int, pattern string, value_crc32 long, probability double, is_secret boolean")


def redact(docs: DataFrame, scanner: Scanner, text_col: str = "text", path_col: str | None = None,
           length_col: str | None = None, mask: str = MASK) -> DataFrame:
    """`docs` with every secret in the text replaced by `mask`; all rows and columns stay.

    A null text stays null. `length_col`, where given, becomes the length of the new text in
    code points, where the text has changed.
    """
    shared = docs.sparkSession.sparkContext.broadcast(scanner)

    @F.arrow_udf("string")
    def masked(texts: pa.Array, paths: pa.Array) -> pa.Array:
        return pa.array([None if t is None else shared.value.redacted(t, p, mask)
                         for t, p in zip(texts.to_pylist(), paths.to_pylist())], pa.string())

    text = F.col(text_col).cast("string")
    new = docs.select(F.struct("*").alias("row"), masked(text, _path(docs, path_col)).alias("masked"))
    columns = []
    for name in docs.columns:
        old = F.col(f"row.`{name}`")
        if name == text_col:
            old = F.col("masked")
        elif name == length_col:
            same = F.col("masked").eqNullSafe(F.col(f"row.`{text_col}`"))
            old = F.when(same, old).otherwise(F.length("masked").cast(docs.schema[name].dataType))
        columns.append(old.alias(name))
    return new.select(*columns)
