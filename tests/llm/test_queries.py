"""Registered queries and pipeline stages against plain Python, on awkward tables."""

import hashlib
import json
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from crawlsight.llm import queries

PROSE = " ".join(f"word{k} of plain prose" for k in range(30))
TEXTS = [None, "", " \n\t", "a", "A b", "a  b", PROSE, PROSE + " ", PROSE.replace("word29", "Word29"), PROSE + " and one more end",
         "The quick fox.\nThe quick fox.\n" * 20, "naïve café — 日本 🙂 # $ <b>", "spam " * 300, "x" * 3000, PROSE[::-1], "lorem ipsum dolor " * 3000]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("llm"))
    rows = [(i, t, None if i % 3 else "en", "s", len(t or "")) for i, t in enumerate(TEXTS)] + [(6, PROSE, "en", None, len(PROSE))]
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(path + "/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(path + "/labels.parquet")
    return path


ROWS = [*enumerate(TEXTS), (6, PROSE)]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def rule_counts(text):
    w = words(text)
    lines = [x for x in (text or "").split("\n") if words(x)]
    at = {}
    for i in range(len(w) - 2):
        at.setdefault(tuple(w[i:i + 3]), []).append(i)
    repeat = len({i + k for places in at.values() if len(places) > 1 for i in places for k in range(3)})
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), repeat,
            len(w) < 50 or 100 * repeat > 50 * len(w))


def fingerprint(text):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(w[i:i + 3]) for i in range(max(len(w) - 2, 1))] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def components(ids_and_texts):
    prints = {i: [] for i, _ in ids_and_texts}
    for i, t in ids_and_texts:
        prints[i].append(fingerprint(t))
    own = {i: i for i in prints}
    for _ in prints:
        for a in prints:
            for b in prints:
                if any(bin(x ^ y).count("1") <= 2 for x in prints[a] for y in prints[b]):
                    own[a] = own[b] = min(own[a], own[b])
    return own


def test_quality_rules_query(spark, folder):
    out = queries.op1_quality_rules(spark, folder).collect()
    mine = sorted((i, *rule_counts(t)) for i, t in ROWS)
    assert sorted((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in out) == mine
    assert all(r.kept != r.base_failed for r in out)  # no labels, so nothing is learnt


def test_near_dedup_query(spark, folder):
    out = queries.op3_simhash_near_dedup(spark, folder).collect()
    own = components(ROWS)
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in out) == sorted(
        (i, f"{fingerprint(t):016x}", own[i]) for i, t in ROWS)
    assert own[8] == 6 and own[2] == 0


def test_exact_dedup_query(spark, folder):
    groups = {}
    for i, t in ROWS:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i))
    mine = []
    for text, members in groups.items():
        keep = min(members)
        mine += [(i, keep[1], len(members), hashlib.sha256(text.encode()).hexdigest()) for _, i in members]
    out = queries.op10_exact_dedup(spark, folder).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in out) == sorted(mine)
    assert sum(r.kept for r in out) == len(groups)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("digest_index_")]


def test_pipeline_stages(spark, folder):
    docs, stages = queries.documents(spark, folder), dict(corpus_pipeline.STAGES)
    key = lambda df: sorted((r.doc_id, r.text or "") for r in df.collect())
    passed = sorted((i, t or "") for i, t in ROWS if not rule_counts(t)[-1])
    first = stages["quality_rules"](spark, docs, folder)
    assert key(first) == passed and first.columns == docs.columns
    best = {}
    for i, t in ROWS:
        k = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        best[k] = min(best.get(k, (1, 0, "")), (-len(t or ""), i, t or ""))
    second = stages["exact_dedup"](spark, docs, folder)
    assert key(second) == sorted((i, t) for _, i, t in best.values()) and second.columns == docs.columns
    third = stages["simhash_near_dedup"](spark, docs, folder)
    own, kept = components(ROWS), [r.doc_id for r in third.collect()]
    assert sorted(own[i] for i in kept) == sorted(set(own.values())) and third.columns == docs.columns
    token = "ghp_" + "a1B2c3D4e5F6g7H8i9J0" * 2
    secret = docs.withColumn("text", F.when(F.col("doc_id") == 11, f"use {token[:40]} now").otherwise(F.col("text")))
    fourth = stages["secret_scan"](spark, secret, folder)
    after = {(r.doc_id, r.text, r.n_chars) for r in fourth.collect()}
    assert fourth.columns == docs.columns and fourth.count() == len(ROWS)
    assert {x for x in after if x[0] != 11} == {(i, t, len(t or "")) for i, t in ROWS if i != 11}
    assert all(token[:40] not in t and n == len(t) for i, t, n in after if i == 11)
    pieces = stages["best_fit_packing"](spark, docs, folder).collect()
    assert sorted({p.doc_id for p in pieces}) == sorted({i for i, _ in ROWS})
    filled = {}
    for p in pieces:
        filled.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for parts in filled.values():
        parts.sort()
        assert [o for o, _ in parts] == [0, *np.cumsum([n for _, n in parts])[:-1]] and sum(n for _, n in parts) <= 4096
    assert "best_fit_packing" == corpus_pipeline.STAGES[-1][0] and json.dumps(corpus_pipeline.ORACLE_SQL) == "null"
