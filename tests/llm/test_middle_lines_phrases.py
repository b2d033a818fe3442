"""Fill-in-the-middle, line deduplication and phrase collocations against brute force and SQL."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter
from decimal import Decimal

import duckdb
import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rainloom.llm import collocations, fill_middle, line_dedup

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD = ["", None, " ", "a", "<P>in<M>it", "héé\U0001f600 wörld퟿ x", "x" * 5000, "a b " * 4000, "\n\n\n", "1 2 3", "é" * 300, "ab" * 10 + "\x00"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def frame(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


# ---------------------------------------------------------------- fill in the middle


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 400), max_size=3000), st.integers(1, 120))
def test_rank_index_is_exact_and_bounded(steps, error):
    offsets = np.append(0, np.cumsum(np.array(steps, np.int64))).astype(np.int64)
    index = fill_middle.RankIndex.fit(offsets, error)
    ranks = np.arange(len(offsets))
    assert np.array_equal(index.offsets(ranks), offsets)
    assert np.abs(offsets - index.predict(ranks)).max() <= error + 1
    assert np.array_equal(index.starts, np.unique(index.starts)) and index.starts[0] == 0


def test_rank_index_needs_few_segments():
    rng = np.random.default_rng(1)
    even = fill_middle.RankIndex.fit(np.arange(50_000, dtype=np.int64) * 3)
    prose = fill_middle.RankIndex.fit(np.append(0, np.cumsum(rng.integers(1, 9, 50_000))))
    assert len(even.starts) == 1 and even.residuals.dtype == np.int8
    assert 1 < len(prose.starts) < 200


def test_boundaries_equal_the_pattern():
    texts = [t or "" for t in ODD] + ["Hello, world! 42ab\tc"]
    for text, got in zip(texts, fill_middle.boundaries(texts)):
        assert got.tolist() == [0] + [m.end() for m in re.finditer("[A-Za-z]+|[^A-Za-z]", text)]


def brute_middle(key, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{key}".encode()).hexdigest()
    h = [int(digest[k:k + 8], 16) for k in (0, 8, 16, 24)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return len(units), "plain", None, None, text
    out = f"<S>{s}<P>{p}<M>{m}" if h[3] % 100 < 20 else f"<P>{p}<S>{s}<M>{m}"
    return len(units), "spm" if h[3] % 100 < 20 else "psm", len(p), len(m), out


def test_fill_in_middle_equals_brute_force_and_comes_back(spark):
    rows = [(i, ODD[i % len(ODD)]) for i in range(240)] + [(3, "same id, other text"), (5, ODD[5]), (None, "no id at all")]
    docs = frame(spark, rows).withColumns({"output": F.lit(1), "form": F.lit("x"), "n": F.lit(None), "h": F.lit(0)})
    made = fill_middle.restore(fill_middle.fill_in_middle(docs, keep=("doc_id", "text")))
    got = sorted(((r.doc_id, r.text, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.restored) for r in made.collect()), key=repr)
    want = sorted(((k, t, *brute_middle("" if k is None else k, t), t or "") for k, t in rows), key=repr)
    assert got == want
    assert {g[3] for g in got} == {"plain", "psm", "spm"}


def test_fill_in_middle_of_an_empty_table(spark):
    made = fill_middle.restore(fill_middle.fill_in_middle(frame(spark, [])))
    assert made.collect() == [] and made.columns == [
        "doc_id", "n", "form", "prefix_chars", "middle_chars", "segments", "output", "restored"]


# ---------------------------------------------------------------- lines


def brute_lines(rows, least_chars=40, least_docs=5):
    def key(line):
        return line.strip(" \t\n\x0b\x0c\r").translate(LOWER)

    holders = {}
    for k, text in rows:
        for line in (text or "").split("\n"):
            if k is not None and len(key(line)) >= least_chars:
                holders.setdefault(key(line), set()).add(k)
    out = []
    for k, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if k is None or len(holders.get(key(x), ())) < least_docs or max(holders[key(x)]) == k]
        out.append((k, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def line_rows():
    rng = random.Random(4)
    own = ["".join(rng.choice("abcdé \t") for _ in range(rng.randint(30, 60))) for _ in range(40)]
    rows = []
    for i in range(120):
        lines = [own[min(int(rng.expovariate(0.1)), 39)] for _ in range(rng.randint(0, 12))]
        lines = [rng.choice(("{}", "  {}\t", "{}\r")).format(x.upper() if rng.random() < 0.2 else x) for x in lines]
        rows.append((i, "\n".join(lines)))
    wide = "a line that is found in very many of the documents here"
    return rows + [(200 + i, f"{wide}\n{wide}\nown {i}") for i in range(300)] + [
        (7, "\n".join(own)), (7, "\n".join(own)), (None, wide), (None, None), (900, None), (901, ""), (902, "\n\n"), (903, wide)]


@pytest.mark.parametrize("hot", [1, 3, 1000])
def test_lines_equal_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(line_dedup, "HOT_KEYS", hot)
    rows = line_rows()
    docs = frame(spark, rows).withColumns({c: F.lit(1) for c in ("d", "h", "g", "place", "places", "kept", "keep", "line", "m")}).repartition(7)
    got = line_dedup.drop_repeated_lines(docs)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_lines(rows)


def test_lines_of_other_settings_and_empty_tables(spark):
    rows = [(i, "short\nother") for i in range(3)] + [(9, "short")]
    got = line_dedup.drop_repeated_lines(frame(spark, rows), least_chars=5, least_docs=4, keep=("doc_id",))
    assert sorted(map(tuple, got.collect())) == brute_lines(rows, 5, 4)
    assert line_dedup.drop_repeated_lines(frame(spark, [])).collect() == []


def test_line_sql_equals_the_operator(spark):
    rows = [r for r in line_rows() if r[0] is not None and r[0] != 7]
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text"]))
    want = sorted(con.execute(line_dedup.SQL).fetchall())
    got = line_dedup.drop_repeated_lines(frame(spark, rows))
    assert sorted((r.doc_id, r.n_lines, r.n_dropped, sha(r.kept)) for r in got.collect()) == want


# ---------------------------------------------------------------- phrases


def brute_phrases(rows, least=10, inside=50, top=2000):
    count, total = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall("[^\x20\x09]+", piece)
            total[lang] += len(words)
            for n in (1, 2, 3):
                count.update((lang, tuple(words[i:i + n])) for i in range(len(words) - n + 1))
    found = {k: a for k, a in count.items() if len(k[1]) > 1 and a >= least}
    out = []
    for (lang, words), a in found.items():
        longer = [b for (x, w), b in found.items() if x == lang and len(w) > len(words)
                  and any(w[i:i + len(words)] == words for i in range(len(w) - len(words) + 1))]
        if any(100 * b >= inside * a for b in longer):
            continue
        cuts = [(10**6 * a * a // (count[lang, words[:k]] * count[lang, words[k:]]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        out.append((lang, " ".join(words), a, count[lang, words[:k]], count[lang, words[k:]], total[lang], score))
    out.sort(key=lambda x: (x[0], -x[6], -x[2], x[1].encode()))
    ranked, last = [], None
    for row in out:
        place = 1 if row[0] != last else place + 1
        last = row[0]
        if place <= top:
            ranked.append((row[0], place, *row[1:]))
    return ranked


def phrase_rows():
    rng = random.Random(8)
    words = "the of a is on red Blue é über x1 no yes \x00b".split(" ")
    rows = []
    for i in range(90):
        text = "".join(rng.choice(words[:rng.randint(2, 13)]) + rng.choice((" ", " ", " ", "  ", "\t", ", ", ". ", "\n", " \r")) for _ in range(rng.randint(0, 60)))
        rows.append((rng.choice(("en", "en", "de", None, "und")), text))
    return rows + [("en", "new york city " * 40), ("de", "the the the the " * 30), (None, None), ("fr", ""), ("es", "one"), ("en", " .,;:!? ")]


def phrases_of(spark, rows, **options):
    docs = spark.createDataFrame(rows, "lang string, text string").withColumns({c: F.lit(1) for c in ("h", "c", "n", "word", "code", "g")})
    got = collocations.collocations(docs.repartition(5), **options)
    return sorted((r.lang, r.rank, r.phrase, r.a, r.l, r.r, r.n, r.score) for r in got.collect())


@pytest.mark.parametrize("budget", [2_000_000, 400, 15])
def test_phrases_equal_brute_force_whatever_the_groups(spark, budget):
    """Small budgets split frequent prefixes by their second and third word."""
    rows = phrase_rows()
    assert phrases_of(spark, rows, budget=budget) == sorted(brute_phrases(rows))


def test_fewer_ranks_other_limits_and_empty_tables(spark):
    rows = phrase_rows()
    assert phrases_of(spark, rows, top=3, least=4, inside=80) == sorted(brute_phrases(rows, 4, 80, 3))
    assert phrases_of(spark, [("en", None)]) == []
    empty = spark.createDataFrame([], "lang string, text string")
    assert collocations.collocations(empty).collect() == []


def test_groups_keep_to_the_budget(spark):
    rows = spark.createDataFrame(phrase_rows(), "lang string, text string").na.fill({"lang": "und", "text": ""})
    words = collocations.count_words(rows, 1)
    cuts = collocations.groups(rows, words, 1, 60)
    codes, counts = [], []
    for r in rows.collect():
        _, _, _, code, count = collocations.suffixes([r.text], [r.lang], 1)
        codes.append(code)
        counts.append(count)
    codes, counts = np.concatenate(codes), np.concatenate(counts)
    held = np.bincount(np.searchsorted(cuts, codes, side="right"), counts)
    single = max(Counter(dict(zip(*np.unique(codes, return_counts=True)))).values())
    assert len(cuts) > 20 and held.max() <= max(3 * 60, single + 2 * 60)


def test_shared_hashes_start_again(spark, monkeypatch):
    real = collocations.count_words
    seeds = []

    def clashing(rows, seed):
        seeds.append(seed)
        return real(rows, seed) if seed > 1 else real(rows, seed).withColumn("h", F.lit(5).cast("bigint"))

    monkeypatch.setattr(collocations, "count_words", clashing)
    rows = phrase_rows()
    assert phrases_of(spark, rows) == sorted(brute_phrases(rows)) and seeds == [1, 2]


def test_scores_are_exact_beyond_64_bits(spark):
    cases = [(10**12 + 7, 3 * 10**12 + 1, 2 * 10**12 + 9), (9_999_999_967, 9_999_999_967, 10**10 + 19), (10, 10, 10), (10, 10**13, 10**13)]
    rows = spark.createDataFrame(cases, "a long, l long, r long")
    got = [r.s for r in rows.select(collocations._score("l", "r").alias("s")).collect()]
    assert got == [10**6 * a * a // (x * y) for a, x, y in cases] and not isinstance(got[0], Decimal)


def test_phrase_sql_equals_the_operator(spark):
    rows = [r for r in phrase_rows() if "\x00" not in (r[1] or "")]
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["lang", "text"]))
    assert sorted(con.execute(collocations.SQL).fetchall()) == phrases_of(spark, rows)
