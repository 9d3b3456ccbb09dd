"""Quality rules: decision lists learnt by sequential covering.

Statistics of a text are columns. From labelled statistics a list of rules is learnt, each a
conjunction of thresholds: a rule is grown condition by condition by information gain on two
thirds of the rows, pruned from its end on the other third, and the rows it covers are taken
away before the next one. Rules come out as one ordered Spark conditional expression, with
unmatched rows kept.

Fitting reads at most `SAMPLE` labelled rows, those with the smallest hash of their id; all
other work is on all rows.

Defined results: words are runs of other characters than `[\\x20\\x09-\\x0D]`; a null text has none,
every count is zero and it fails the base rules. Rows are judged one by one, so repeated rows get
equal results. Of clashing labels of one id the least is taken. Without labels, or with labels of one kind only, no rules are learnt and the base
rules alone decide. Labels that are null are not used. An empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, text_bytes

SAMPLE = 20_000
SLACK = 0.02
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

_CAPITALS = bytes(range(65, 91))
_DIGITS = bytes(range(48, 58))
_BLANKS = b" \t\n\x0b\f\r"
_SYMBOLS = b"#*$%&|<>"

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_distinct_words",
          "n_lines", "n_capitals", "n_digits", "n_marks")

# What rules may be about: a name, and its value from the counts as SQL.
FEATURES = {
    "words": "double(n_words)",
    "symbol_share": "n_symbols / greatest(word_chars, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "distinct_share": "n_distinct_words / greatest(n_words, 1)",
    "mean_word": "word_chars / greatest(n_words, 1)",
    "capital_share": "n_capitals / greatest(word_chars, 1)",
    "digit_share": "n_digits / greatest(word_chars, 1)",
    "mark_share": "n_marks / greatest(word_chars, 1)",
    "words_per_line": "n_words / greatest(n_lines, 1)",
}


def counts(text: bytes) -> tuple[int, ...]:
    """`COUNTS` of a UTF-8 text."""
    words = text.split()
    n = len(words)
    dense = text.translate(None, _BLANKS)
    chars = len(dense.decode("utf-8", "replace"))
    lines = [line for line in text.split(b"\n") if line.strip()]
    windows = list(zip(words, words[1:], words[2:]))
    times = Counter(windows)
    repeated = covered = 0
    if len(times) < len(windows):
        for at, window in enumerate(windows):
            if times[window] > 1:
                repeated += at + 3 - max(at, covered)
                covered = at + 3
    size = len(dense)
    return (n, chars, size - len(dense.translate(None, _SYMBOLS)), len(lines) - len(set(lines)),
            repeated, len(set(words)), len(lines), size - len(dense.translate(None, _CAPITALS)),
            size - len(dense.translate(None, _DIGITS)), size - len(dense.translate(None, b"!?")))


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = np.array([counts(t.as_py()) for t in batch.column(batch.num_columns - 1)],
                        np.int64).reshape(-1, len(COUNTS))
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:-1], *(pa.array(rows[:, k]) for k in range(len(COUNTS)))],
            [*batch.schema.names[:-1], *COUNTS])


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_key (a hash of the text) and `COUNTS` of every row."""
    fields = "doc_id long, text_key long, " + ", ".join(f"{c} long" for c in COUNTS)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.xxhash64(text_bytes(text_col)).alias("text_key"),
                       text_bytes(text_col).alias("text")).mapInArrow(_count_batches, fields)


def base_failed() -> Column:
    return ((F.col("n_words") < MIN_WORDS)
            | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, table: dict[str, np.ndarray]) -> np.ndarray:
        values = table[self.feature]
        return values > self.threshold if self.above else values <= self.threshold

    def column(self) -> Column:
        value = F.expr(FEATURES[self.feature])
        return value > F.lit(self.threshold) if self.above else value <= F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def covers(rule: Rule, table: dict[str, np.ndarray], size: int) -> np.ndarray:
    held = np.ones(size, bool)
    for condition in rule:
        held &= condition.holds(table)
    return held


def _best_condition(table: dict[str, np.ndarray], bad: np.ndarray, held: np.ndarray,
                    cuts: dict[str, np.ndarray]) -> Condition | None:
    """The condition with the largest FOIL gain on the rows held so far.

    Of thresholds that gain almost as much the middle one is taken, away from either kind of row.
    """
    p0, n0 = int((bad & held).sum()), int((~bad & held).sum())
    if not p0 or not n0:
        return None
    before, best, found = np.log2(p0 / (p0 + n0)), 1e-9, None
    for feature, edges in cuts.items():
        at = np.searchsorted(edges, table[feature][held], side="left")  # values <= edges[at]
        p_low = np.cumsum(np.bincount(at[bad[held]], minlength=len(edges) + 1))[:-1]
        n_low = np.cumsum(np.bincount(at[~bad[held]], minlength=len(edges) + 1))[:-1]
        for above, p, n in ((False, p_low, n_low), (True, p0 - p_low, n0 - n_low)):
            gain = np.where(p > 0, p * (np.log2(np.maximum(p, 1) / np.maximum(p + n, 1)) - before), -1)
            if gain.max() > best:
                best = float(gain.max())
                near = np.flatnonzero(gain >= (1 - SLACK) * best)
                found = Condition(feature, above, float(edges[near[len(near) // 2]]))
    return found


def _edges(values: np.ndarray, bad: np.ndarray) -> np.ndarray:
    """Candidate thresholds: quantiles of either kind of row, and an even grid between them."""
    share = np.linspace(0.005, 0.995, 100)
    found = [np.quantile(v, share) for v in (values[bad], values[~bad]) if len(v)]
    return np.unique(np.concatenate([*found, np.linspace(values.min(), values.max(), 101)]))


def learn(table: dict[str, np.ndarray], bad: np.ndarray, fold: np.ndarray, max_rules: int = 12,
          max_conditions: int = 4, min_precision: float = 0.9, min_covered: int = 5) -> list[Rule]:
    """Rules whose rows are bad. `fold` is 0, 1 or 2 per row; fold 2 prunes.

    The list ends when no rule keeps `min_precision` on the rows that prune it.
    """
    size, rules, left = len(bad), [], np.ones(len(bad), bool)
    cuts = {f: _edges(v, bad) for f, v in table.items()} if size else {}
    while len(rules) < max_rules and (bad & left).sum() >= min_covered:
        grow, prune = left & (fold < 2), left & (fold == 2)
        rule: Rule = ()
        held = grow.copy()
        while len(rule) < max_conditions:
            condition = _best_condition(table, bad, held, cuts)
            if condition is None:
                break
            rule += (condition,)
            held &= condition.holds(table)
        if not rule:
            break

        def worth(candidate: Rule) -> tuple[float, int]:
            on = covers(candidate, table, size) & prune
            p, n = int((bad & on).sum()), int((~bad & on).sum())
            return ((p - n) / (p + n) if p + n else -1.0, p)

        rule = max((rule[:k] for k in range(len(rule), 0, -1)), key=worth)
        on = covers(rule, table, size) & left
        if on.sum() < min_covered or bad[on].mean() < min_precision or worth(rule)[0] < 2 * min_precision - 1:
            break
        rules.append(rule)
        left &= ~on
    return rules


def fit(stats: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id",
        sample: int = SAMPLE) -> list[Rule]:
    """Rules from at most `sample` labelled rows, for rows that pass the base rules; label 0 is bad."""
    chosen = (labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).alias("label"))
              .filter("doc_id IS NOT NULL AND label IS NOT NULL").groupBy("doc_id").agg(F.min("label").alias("label"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    rows = (stats.filter(~base_failed()).join(F.broadcast(chosen), "doc_id")
            .select("doc_id", "text_key", "label", *[F.expr(c).alias(f) for f, c in FEATURES.items()])
            .orderBy(F.xxhash64("doc_id"), "doc_id", "text_key").limit(2 * sample).toPandas())
    table = {f: rows[f].to_numpy(float) for f in FEATURES}
    fold = np.array([hash_of % 3 for hash_of in (rows["doc_id"].to_numpy(np.int64) * 2654435761 >> 7).tolist()], int)
    return learn(table, rows["label"].to_numpy() == 0, fold)


def verdict(rules: list[Rule]) -> Column:
    """The number of the first rule that holds, or null, as one conditional expression."""
    out = None
    for number, rule in enumerate(rules):
        whole = F.lit(True)
        for condition in rule:
            whole = whole & condition.column()
        out = F.when(whole, number) if out is None else out.when(whole, number)
    return F.lit(None).cast("int") if out is None else out


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Statistics, base_failed, rule (the first that holds) and kept of every row."""
    stats = checkpointed(statistics(docs, id_col, text_col))
    judged = stats.withColumns({"base_failed": base_failed(), "rule": verdict(fit(stats, labels))})
    return judged.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def keep(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that are kept, with all their columns.

    Rows of one id and text share their verdict, so the kept pairs of id and text are enough.
    """
    kept = checkpointed(judge(docs, labels, id_col, text_col).filter("kept").select(
        "doc_id", "text_key").distinct())
    keyed = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("doc_id"),
                        F.xxhash64(text_bytes(text_col)).alias("text_key"))
    return keyed.join(kept, keyed["doc_id"].eqNullSafe(kept["doc_id"])
                      & (keyed["text_key"] == kept["text_key"]), "left_semi").select("row.*")
