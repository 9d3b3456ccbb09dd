"""A token of every provider's form is masked wherever it stands."""

import random
import string

import pytest

from crawlsight.llm import secret_scan

LETTERS, UPPER, HEX = string.ascii_letters + string.digits, string.ascii_uppercase + string.digits, "0123456789abcdef"
FORMS = [("AKIA", UPPER, 16), ("ASIA", UPPER, 16), *((f"gh{c}_", LETTERS, 36) for c in "pousr"), ("github_pat_", LETTERS, 40),
         ("glpat-", LETTERS, 20), *((f"xox{c}-", LETTERS, 24) for c in "abeoprs"), ("xapp-", LETTERS, 30),
         *((f"{a}k_{m}_", LETTERS, 24) for a in "sr" for m in ("live", "test")), ("whsec_", LETTERS, 32), ("AIza", LETTERS, 35),
         ("ya29.", LETTERS, 40), ("sk-", LETTERS, 40), ("npm_", LETTERS, 36), ("pypi-", LETTERS, 60), ("hf_", LETTERS, 34),
         *((f"shp{c}_", HEX, 32) for c in ("at", "ca", "pa", "ss")), ("dop_v1_", HEX, 64)]


@pytest.fixture(scope="module")
def scanner(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    return secret_scan.scanner_of(docs, path_col="source")


def tokens(prefix, alphabet, size, many=50):
    rng = random.Random(prefix)
    return [prefix + "aB3" * (alphabet is LETTERS) + "".join(rng.choices(alphabet, k=size - 3 * (alphabet is LETTERS)))
            for _ in range(many)]


def test_every_form_is_listed_once():
    assert len(secret_scan.PREFIXED) == len(set(secret_scan.PREFIXED)) == 19


CASES = [(p, tokens(p, a, n)) for p, a, n in FORMS]
CASES.append(("SG.", [f"SG.{a}.{b}" for a, b in zip(tokens("", LETTERS, 22), tokens("x", LETTERS, 43))]))
CASES.append(("eyJ", [f"eyJ{a}.eyJ{b}.{c}" for a, b, c in zip(
    tokens("", LETTERS, 20), tokens("y", LETTERS, 40), tokens("z", LETTERS, 43))]))


@pytest.mark.parametrize("prefix, made", CASES, ids=[c[0] for c in CASES])
def test_tokens_are_masked_in_any_place(scanner, prefix, made):
    for token in made:
        for text in (f"please use {token} for the deploy", f'{{"value": "{token}"}}', f"setting = {token}",
                     f"https://host/path?key={token}&page=2", f"build {token}"):
            out = scanner.redacted(text)
            assert token not in out and secret_scan.MASK in out, text
