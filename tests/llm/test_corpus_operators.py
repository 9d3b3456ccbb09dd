"""Phrase mining, decontamination and whitening: the registered queries against brute force on awkward tables."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from crawlsight.llm import collocations, decontamination, queries, whitening

RNG = random.Random(4)
PASSAGE = " ".join(f"w{k}" for k in range(30))
NOISE = [" ".join(RNG.choices("a b c d e É the of".split(), k=200)) + RNG.choice(".,!? \t\n") for _ in range(40)]
TEXTS = [None, "", " \t\n", "a", "tick tock " * 60, "New York City. new york city, NEW YORK CITY; " * 12, PASSAGE, f"x {PASSAGE.upper()} y",
         "w3 w4 w5", " ".join(PASSAGE.split()[5:16]), "z" * 5000, "a.b.c " * 400, *NOISE, NOISE[0]]
LANGS = ["en", None, "fr"]
DOCS = "doc_id long, text string, lang string, source string, n_chars long, words array<string>, f long, row_no long"
VECTORS = [[0.5, 0.25, -1.0], [0.5, 0.25, -1.0], None, [1.0, None, 0.0], [float("nan"), 0.0, 0.0], [float("inf"), 0.0, 0.0],
           [0.1, 0.2, 0.3], [0.4, -0.1, 0.9], [2.0, 1.5, -0.7], [], [1.0, 2.0], [-0.3, 0.8, 0.1]]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    docs = [(None if i == 7 else min(i, 40), t, LANGS[i % 3], "s", 0, ["x"], 1, 2) for i, t in enumerate(TEXTS)]
    items = [(1, PASSAGE, "x"), (2, None, "x"), (3, "  ", "x"), (4, "W3, w4 w5!", "x"), (5, "z" * 5000, "x"), (None, "tick tock", "x"),
             (1, "new york city new york city new york city new york city", "x"), (6, "w0 never seen", "x")]
    spark.createDataFrame(docs, DOCS).repartition(5).write.parquet(folder + "/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string, words string").write.parquet(folder + "/benchmark.parquet")
    rows = [(None if i == 1 else i, v, 1, 1) for i, v in enumerate(VECTORS)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, component int, n long").write.parquet(folder + "/embeddings.parquet")
    return folder


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("empty"))
    for name, schema in (("documents", DOCS), ("benchmark", "item_id long, text string"), ("embeddings", "vec_id long, embedding array<float>")):
        spark.createDataFrame([], schema).write.parquet(f"{folder}/{name}.parquet")
    return folder


def phrases_by_hand():
    grams, n = Counter(), Counter()
    for i, text in enumerate(TEXTS):
        lang = LANGS[i % 3] or "und"
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\n-\r]", lowered):
            w = re.findall(r"[^ \t]+", piece)
            n[lang] += len(w)
            grams.update((lang, tuple(w[a:a + k])) for k in range(1, 5) for a in range(len(w) - k + 1))
    rows = []
    for (lang, p), a in grams.items():
        if len(p) < 2 or a < 30:
            continue
        score, k = min((2_000_000 * a // (grams[lang, p[:k]] + grams[lang, p[k:]]), k) for k in range(1, len(p)))
        inside = any(100 * f >= 80 * a and q != p and any(q[s:s + len(p)] == p for s in range(len(q) - len(p) + 1))
                     for (other, q), f in grams.items() if other == lang and len(q) > len(p) and f >= 30)
        if not inside:
            rows.append((lang, " ".join(p), a, grams[lang, p[:k]], grams[lang, p[k:]], n[lang], score))
    rows.sort(key=lambda r: (r[0], -r[6], -r[2], r[1].encode()))
    ranks = Counter()
    out = []
    for lang, *rest in rows:
        ranks[lang] += 1
        out.append((lang, ranks[lang], *rest))
    return out


@pytest.mark.parametrize("words, piece", [(1 << 19, 1 << 20), (50, 60)])
def test_phrases(spark, tables, monkeypatch, words, piece):
    monkeypatch.setattr(collocations, "PIECE", piece)
    monkeypatch.setattr(collocations, "WORDS", words)
    got = queries.op11_phrase_collocation(spark, tables).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()
    assert sorted(map(tuple, got)) == phrases_by_hand() and len(got) > 5


def test_blocks_of_a_long_piece_count_every_phrase_once(monkeypatch):
    monkeypatch.setattr(collocations, "PIECE", 40)
    words = [f"w{k % 7}".encode() for k in range(200)]
    chunk = collocations.Chunk()
    for part, carried in collocations.pieces(b" ".join(words)):
        chunk.add(part, carried, 0)
    chunk.close()
    every = np.full(1 << (collocations.BITS - 3), 255, np.uint8)
    for k in (2, 3, 4):
        places = chunk.members(k, np.zeros(len(chunk.ids), np.uint64), every)
        found = Counter(b" ".join(chunk.words[j] for j in chunk.ids[i:i + k]) for i in places)
        assert found == Counter(b" ".join(words[i:i + k]) for i in range(len(words) - k + 1))


class Taken:
    """Stands in for a frame: keeps the function that mapInArrow is given."""

    def mapInArrow(self, function, _):
        self.function = function
        return self

    def __getattr__(self, _):
        return lambda *_, **__: self


def test_phrases_come_back_in_short_batches_however_many_there_are():
    frame, words = Taken(), [f"w{k}" for k in range(150_000)]
    text = (" ".join(words) + ". " + " ".join(words[:10])).encode()
    collocations._phrase_counts(frame, type("Table", (), {"value": np.full(1 << (collocations.BITS - 3), 255, np.uint8)}))
    batch = pa.RecordBatch.from_arrays([pa.array(["en"]), pa.array([7], pa.int64()), pa.array([text])], ["lang", "lang_seed", "text"])
    got = list(frame.function([batch]))
    assert max(b.num_rows for b in got) <= 1 << 16
    found = Counter()
    for b in got:
        for row in b.to_pylist():
            found[row["lang"], row["phrase"].decode(), row["words"]] += row["n"]
    want = Counter(("en", " ".join(part[i:i + k]), k) for part in (words, words[:10]) for k in range(1, 5) for i in range(len(part) - k + 1))
    assert found == want


def test_chunks_hold_a_quarter_of_a_million_words():
    rows = [" ".join(f"w{k % 977}" for k in range(i, i + 1000)).encode() for i in range(600)]
    sizes = [len(chunk.ids) for chunk, _ in collocations._chunks([pa.RecordBatch.from_arrays([pa.array(rows)], ["text"])])]
    assert sum(sizes) == 600_000 and max(sizes) <= (1 << 18) + 1000


def test_mining_hands_python_batches_of_few_bytes(spark, tables, monkeypatch):
    name, seen = "spark.sql.execution.arrow.maxBytesPerBatch", []
    before, counts = spark.conf.get(name), collocations.counts

    def measured(docs, *rest):
        long = docs.sparkSession.range(300, numPartitions=1).select(F.expr("repeat('a', 100000)").alias("text"))
        seen.extend(r.n for r in long.mapInArrow(lambda batches: (pa.table({"n": [b.nbytes]}).to_batches()[0] for b in batches), "n long").collect())
        return counts(docs, *rest)

    monkeypatch.setattr(collocations, "counts", measured)
    assert queries.op11_phrase_collocation(spark, tables).count() > 5
    assert sum(seen) >= 30_000_000 and max(seen) < 5_000_000
    assert spark.conf.get(name) == before


def test_contamination(spark, tables):
    split = lambda t: re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    wins = {}
    for r in spark.read.parquet(tables + "/benchmark.parquet").collect():
        w = split(r.text)
        for a in range(max(len(w) - 9, 1) if w else 0):
            wins.setdefault(tuple(w[a:a + 10]), set()).update([] if r.item_id is None else [str(r.item_id)])
    want = []
    for r in spark.read.parquet(tables + "/documents.parquet").collect():
        w, hit, ids = split(r.text), set(), set()
        for win, names in wins.items():
            for a in range(len(w) - len(win) + 1):
                if tuple(w[a:a + len(win)]) == win:
                    hit.update(range(a, a + len(win)))
                    ids |= names
        want.append((str(r.doc_id), len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    got = queries.op12_benchmark_decontamination(spark, tables).select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("None")), "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()
    assert sorted(map(tuple, got)) == sorted(want) and sum(r[5] for r in want) >= 5


def test_contamination_by_shuffle_is_the_same(spark, tables, monkeypatch):
    rows = lambda: sorted(map(str, queries.op12_benchmark_decontamination(spark, tables).collect()))
    sent = rows()
    monkeypatch.setattr("crawlsight.llm.common.SENT_ROWS", 0)
    monkeypatch.setattr(decontamination, "SENT_ROWS", 0)
    assert rows() == sent


def test_decontamination_runs_no_python(spark, tables):
    plan = decontamination.windows(spark.read.parquet(tables + "/benchmark.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_whitening(spark, tables):
    got = queries.op13_embedding_whitening(spark, tables).collect()
    use = [(None if i == 1 else i, np.floor(np.array(VECTORS[i], np.float32).astype(float) * 64).astype(int) + 1_000_000) for i in (0, 1, 6, 7, 8, 11)]
    x = np.unique([v for _, v in use], axis=0)
    n, s = len(x), x.sum(0)
    values, vectors = np.linalg.eigh(np.cov(x.T.astype(float), bias=True))
    assert len(got) == len(use) * 3 and {r.n for r in got} == {n} and max(r.identity_error for r in got) < 1e-6
    for name, v in use:
        mine = sorted((r.component, r) for r in got if r.vec_id == name)
        assert {r.deviation for _, r in mine} == {int(((n * v - s) ** 2).sum())}
        for c, r in mine:
            assert abs(r.whitened) == pytest.approx(abs((v - s / n) @ vectors[:, -c]) / np.sqrt(values[-c]), rel=1e-6, abs=1e-9)
            assert r.explained == pytest.approx(values[-c] / values.sum(), rel=1e-6)


def test_scatter_is_exact_for_any_size(spark):
    rows = [[RNG.randrange(-2 ** 55, 2 ** 55), RNG.randrange(5), 7] for _ in range(300)]
    frame = spark.createDataFrame([(r,) for r in rows], "x array<long>").repartition(3)
    least, most = [min(c) for c in zip(*rows)], [max(c) for c in zip(*rows)]
    moved = [[v - low for v, low in zip(r, least)] + [1] for r in rows]
    assert whitening.scatter(frame, least, most) == [[sum(r[i] * r[j] for r in moved) for j in range(4)] for i in range(4)]


def test_one_vector_has_no_scale(spark):
    one = spark.createDataFrame([(1, [0.5, 1.0]), (2, [0.5, 1.0])], "vec_id long, embedding array<double>")
    rows = whitening.whiten(one, whitening.fit(one)).collect()
    assert [(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in rows] == [(1, 0, None, None, None)] * 4


@pytest.mark.parametrize("name", ["op11_phrase_collocation", "op12_benchmark_decontamination", "op13_embedding_whitening"])
def test_empty_tables(spark, empty, name):
    assert queries.QUERIES[name](spark, empty).count() == 0
