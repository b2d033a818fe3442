"""Secrets of letters only, and their part in the sample of ordinary tokens."""

from __future__ import annotations

import random
import re
import string

import numpy as np
import pytest

from rainloom.llm import secrets

WORDS = ("inter", "nation", "al", "ization", "er", "the", "ing")


def made(rng, alphabet, length):
    return "".join(rng.choice(alphabet) for _ in range(length))


def hits(spark, tokens):
    docs = spark.createDataFrame([(i, f"see {t} there") for i, t in enumerate(tokens)], "doc_id long, text string")
    found = {r["doc_id"]: [s["kind"] for s in r["found"]] for r in secrets.secrets(docs).collect()}
    return ["random" in found[i] for i in range(len(tokens))]


@pytest.mark.parametrize("alphabet", [string.ascii_lowercase, string.ascii_uppercase, string.ascii_letters])
def test_keys_of_letters_are_found_and_words_are_not(spark, alphabet):
    rng = random.Random(4)
    keys = [made(rng, alphabet, n) for n in (32, 40) for _ in range(15)]
    words = ["".join(rng.choice(WORDS) for _ in range(7)) for _ in range(200)]
    words += [w.upper() for w in words[:50]] + ["getApplicationConfigurationFromRequest", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "zq" * 12]
    out = hits(spark, keys + words)
    assert sum(out[:30]) >= 24 and not any(out[30:])


def test_many_keys_of_letters_hide_no_others(spark):
    rng = random.Random(6)
    other = [made(rng, string.ascii_letters + string.digits + "+/", 44) for _ in range(40)]
    words = ["".join(rng.choice(WORDS) for _ in range(10)) for _ in range(60)]
    alone = hits(spark, other + words)
    crowd = hits(spark, other + words + [made(rng, string.ascii_lowercase, 40) for _ in range(1500)])
    assert sum(crowd[:40]) >= 0.9 * sum(alone[:40]) > 20


def test_pairs_of_letters_against_the_pattern():
    texts = ["The end, a1abc abcd_ x=abc", "", "éabc\nabc ab", "internationalization abc", "abc", "abd"]
    expected = np.zeros((27, 27), int)
    for t in texts:
        for m in re.finditer(r"(?<![A-Za-z0-9+/=_-])[A-Za-z]{3,15}(?![A-Za-z0-9+/=_-])", t):
            w = [26, *(ord(c) - 97 for c in m.group().lower()), 26]
            for a, b in zip(w, w[1:]):
                expected[a, b] += 1
    assert (secrets.pairs(texts) == expected).all()
