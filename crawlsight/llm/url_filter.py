"""URL filter: domain and path rules, and boosted trees on lexical features for the rest.

A rule is a host and the beginning of a path (`example.org/es/`). It fits its host and all
subdomains where the URL's path starts with the rule's path; of several the longest decides, of
equally long ones the one that blocks. The URLs that rules decide are the labelled ones from which
gradient-boosted trees learn the verdict of the others: lengths, depth, digit share, character
entropy, parameter counts, and how often rules blocked other URLs of the same host suffixes.

Fitting reads at most `SAMPLE` labelled URLs, those with the smallest hash of id and URL. Suffix
statistics are counted over all rows; a suffix with very many rows is looked up by broadcast.

Defined results: the host follows the first `://` up to `/`, `?`, `#` or the end, with A-Z in
lower case, and the path follows up to `?`, `#` or the end. A null URL and one without `://` have
empty host and path, fit no rule, and are judged by the model like any other. Rows are judged one
by one; repeated rows get equal results. Where all labelled URLs have one verdict, it is the
verdict of the others; without any, they are allowed. Columns beside id and URL are not read. An
empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.useragent import char_entropy
from .common import checkpointed, lookup

SAMPLE = 20_000
ALLOW, BLOCK = "allow", "block"
PRIOR_ROWS = 20  # a suffix's share of blocked URLs is drawn to the overall share by so many rows


@dataclass(frozen=True)
class UrlRule:
    verdict: str
    rule: str

    @property
    def host(self) -> str:
        return self.rule.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.rule.partition("/")[2]


_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host(url: Column) -> Column:
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    found = F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), _PARTS, 1)
    return F.translate(found, capitals, capitals.lower())


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), _PARTS, 2)


def decided(rules: list[UrlRule], host_col: str = "host", path_col: str = "path") -> tuple[Column, Column]:
    """The rule that decides and its verdict, null where none fits; one conditional expression.

    The list is part of the plan, so it is meant for hundreds of rules.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.rule), r.verdict == BLOCK, r.rule)):
        fits = ((F.col(host_col) == r.host) | F.col(host_col).endswith("." + r.host)) & F.col(
            path_col).startswith(r.path)
        rule, verdict = F.when(fits, r.rule).otherwise(rule), F.when(fits, r.verdict).otherwise(verdict)
    return rule, verdict


def _count(text: str, pattern: str) -> str:
    return f"double(length({text}) - length(regexp_replace({text}, '{pattern}', '')))"


# Lexical features: a name and its value from url, host and path as SQL.
FEATURES = {
    "url_length": "double(length(url))", "host_length": "double(length(host))",
    "path_length": "double(length(path))",
    "host_labels": _count("host", "[.]"), "host_hyphens": _count("host", "-"),
    "host_digits": _count("host", "[0-9]"),
    "depth": _count("path", "/"), "path_digits": _count("path", "[0-9]"),
    "digit_share": _count("url", "[0-9]") + " / greatest(length(url), 1)",
    "parameters": "CASE WHEN instr(url, '?') > 0 THEN 1 + " + _count("url", "&") + " ELSE 0D END",
    "has_fragment": "double(instr(url, '#') > 0)", "is_https": "double(startswith(url, 'https://'))",
    "has_extension": "double(rlike(path, '[.][a-z0-9]{1,5}$'))",
    "capitals": _count("url", "[A-Z]"),
}
SUFFIXES = {"top": "substring_index(host, '.', -1)", "domain": "substring_index(host, '.', -2)",
            "site": "substring_index(host, '.', -3)"}
COLUMNS = (*FEATURES, "entropy", *(f"{s}_blocked" for s in SUFFIXES))


def _with_suffix_shares(rows: DataFrame, total: int, overall: float) -> DataFrame:
    """How often rules blocked the other rows of each suffix, drawn to the overall share.

    A row's own verdict is left out, so that trees learn from labelled rows what holds for the others."""
    own, own_block = F.col("verdict").isNotNull().cast("int"), F.coalesce(F.col("verdict") == BLOCK, F.lit(False)).cast("int")
    for name in SUFFIXES:
        counts = rows.groupBy(name).agg(
            F.count(F.lit(1)).alias("n"), F.count("verdict").alias("labelled"),
            F.count(F.when(F.col("verdict") == BLOCK, 1)).alias("blocked"))
        share = ((F.col("blocked") - own_block + PRIOR_ROWS * overall) / (F.col("labelled") - own + PRIOR_ROWS))
        rows = (lookup(rows, checkpointed(counts), name, "n", total)
                .withColumn(f"{name}_blocked", share).drop("n", "labelled", "blocked"))
    return rows


def judge(pages: DataFrame, rules: list[UrlRule], id_col: str = "page_id", url_col: str = "url",
          sample: int = SAMPLE, rounds: int = 20, depth: int = 4) -> DataFrame:
    """id, url, host, path, rule, verdict and blocked_share (the model's, null for rules) of every row."""
    url = F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    parts = pages.select(F.col(id_col).alias("id"), url.alias("url"), host(F.col(url_col)).alias("host"),
                         path(F.col(url_col)).alias("path"))
    rule, verdict = decided(rules)
    rows = checkpointed(parts.withColumns({"rule": rule, "verdict": verdict,
                                           **{n: F.expr(e) for n, e in SUFFIXES.items()}}))
    total, labelled, blocked = rows.agg(
        F.count(F.lit(1)), F.count("verdict"), F.count(F.when(F.col("verdict") == BLOCK, 1))).first()
    if blocked in (0, labelled):
        only = F.lit(BLOCK if labelled else ALLOW)
        return rows.select("id", "url", "host", "path", "rule",
                           F.coalesce("verdict", only if blocked else F.lit(ALLOW)).alias("verdict"),
                           F.lit(None).cast("double").alias("blocked_share"))
    lexical = checkpointed(_with_suffix_shares(rows, total, blocked / labelled).withColumns(
        {**{n: F.expr(e) for n, e in FEATURES.items()}, "entropy": F.coalesce(char_entropy(F.col("url")), F.lit(0.0))}))
    known = (lexical.filter("verdict IS NOT NULL").orderBy(F.xxhash64("id", "url"), "id", "url").limit(sample)
             .withColumn("label", (F.col("verdict") == BLOCK).cast("double")))
    model = Pipeline(stages=[
        VectorAssembler(inputCols=list(COLUMNS), outputCol="features"),
        GBTClassifier(maxIter=rounds, maxDepth=depth, stepSize=0.3, seed=42),
    ]).fit(checkpointed(known.select("label", *COLUMNS)))
    scored = model.transform(lexical)
    return scored.select(
        "id", "url", "host", "path", "rule",
        F.coalesce("verdict", F.when(F.col("prediction") > 0.5, BLOCK).otherwise(ALLOW)).alias("verdict"),
        F.when(F.col("verdict").isNull(), _second(F.col("probability"))).alias("blocked_share"))


def _second(vector: Column) -> Column:
    from pyspark.ml.functions import vector_to_array

    return vector_to_array(vector)[1]
