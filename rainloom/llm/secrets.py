"""Secret scan: fixed patterns, and a randomness test battery with false-discovery control for other tokens.

A candidate is a run of at least ``SHORTEST`` characters of the base64
alphabets.  Its encoding is inferred from the characters it has; under that
alphabet three tests ask whether it may be random: chi-squared uniformity of
the characters, the number of runs in the upper and lower half of the
alphabet, and the correlation of neighbours.  Fisher's method joins them into
one number from 0 (ordered) to 1.

Runs of letters only may be words.  The pairs of letters in the corpus's short
words, which are never candidates, say how likely a run is as one; where that
is less likely than random letters and the tests do not see order, the ratio of
the two probabilities is at most the chance that a word looks as random.  The
other runs of letters are the corpus's own sample of tokens that are not
secret; from them, per length, comes the probability that an ordinary token
looks as random as a candidate of another encoding.  The Benjamini-Hochberg
procedure per length class decides which candidates to report, for letters and
for the other encodings each.  Numbers of 24 digits or more match a fixed
pattern; shorter ones are no candidates, as numbers of cards, accounts and
orders are as random as a key of digits.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rainloom.llm import common, spans
from rainloom.session import cut_lineage

KINDS = ("assign", "access", "hex", "random")
SHORTEST = 16
#: Lower ends of the length classes; lengths from the last one up to LONGEST are told apart, longer ones count as LONGEST.
CLASSES, LONGEST = (16, 20, 24, 32, 48), 64
#: Steps in which the joint probability is tabulated.
STEPS = 200
#: Share of false reports allowed per class; strength of the prior on ordinary tokens, in tokens.
FALSE_SHARE, PRIOR = 0.05, 200.0
#: How candidates are tested; WORDS are not, they are the sample of ordinary tokens.
MIXED, WORDS, LETTERS = range(3)
#: Letters of the words that the pairs are counted in; steps per factor e of a probability of letters.
WORD, FINE = (3, SHORTEST - 1), 4
#: Shares of pairs, single letters and equal chances in the probability of a letter in a word; share of random tokens whose order
#: the tests would call significant.
MIX, ORDERED = (0.7, 0.2, 0.1), 0.05
#: Words that count beside those of the corpus, for corpora that have hardly any.
COMMON = """the of and to in is you that it he was for on are as with his they at be this have from or one had by word but not what
all were we when your can said there use an each which she do how their if will up other about out many then them these so some her
would make like him into time has look two more write go see number no way could people my than first water been call who oil its now
find long down day did get come made may part over international information application development configuration
administration authentication management service request response general national local library system package module
element language process message version through before between different another because important example""".split()

_ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_RUN = re.compile(rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{SHORTEST},}}")

_UPPER, _LOWER, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: Encodings by preference: name, alphabet in order, whether digits and letters must both occur, ordinary words fit it.
ENCODINGS = tuple((name, {c: i for i, c in enumerate(alphabet)}, mixed, ordinary) for name, alphabet, mixed, ordinary in (
    ("decimal", _DIGITS, False, None),
    ("lower", _LOWER, False, True), ("upper", _UPPER, False, True), ("letters", _UPPER + _LOWER, False, True),
    ("hex", _DIGITS + "abcdef", True, False), ("HEX", _DIGITS + "ABCDEF", True, False),
    ("base32", _UPPER + "234567", True, False),
    ("base36", _DIGITS + _LOWER, True, False), ("BASE36", _DIGITS + _UPPER, True, False),
    ("base62", _UPPER + _LOWER + _DIGITS, True, False), ("base64", _UPPER + _LOWER + _DIGITS + "+/", False, False),
    ("base64url", _UPPER + _LOWER + _DIGITS + "-_", False, False),
    ("base64mixed", _UPPER + _LOWER + _DIGITS + "+/-_", False, False)))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Matches of the fixed patterns, leftmost and non-overlapping per kind."""
    found = []
    folded = text.lower()
    if any(w in folded for w in _ASSIGN_WORDS):
        found += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text)]
    return found + [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]


def infer(token: str) -> tuple[np.ndarray, int, bool | None]:
    """Positions of the characters in the narrowest alphabet that has them all, its size, whether ordinary words fit it.

    None in the third place: numbers, which are never candidates.
    """
    body = token.rstrip("=").replace("=", "")
    have = set(body)
    letters, digits = any(c.isalpha() for c in have), any(c.isdigit() for c in have)
    for _, alphabet, mixed, ordinary in ENCODINGS:
        if have <= alphabet.keys() and (not mixed or (letters and digits)):
            return np.fromiter(map(alphabet.__getitem__, body), np.int64, len(body)), len(alphabet), ordinary
    return np.empty(0, np.int64), 0, None


def _two_sided(z: float) -> float:
    return max(math.erfc(abs(z) / math.sqrt(2)), 1e-300)


def battery(x: np.ndarray, size: int) -> float:
    """Joint probability of the three tests if ``x`` were uniform and independent over ``size`` symbols."""
    n = len(x)
    if n < 8 or size < 2:
        return 0.0
    counts = np.bincount(x, minlength=size)
    chi = float((counts.astype(float) ** 2).sum() * size / n - n)
    uniform = _two_sided((chi - (size - 1)) / math.sqrt(2 * (size - 1) * (n - 1) / n))
    upper = x >= (size + 1) // 2
    ones = int(upper.sum())
    if ones in (0, n):
        runs = 2.0 ** (1 - n)
    else:
        mean = 1 + 2 * ones * (n - ones) / n
        variance = (mean - 1) * (mean - 2) / (n - 1)
        seen = 1 + int((upper[1:] != upper[:-1]).sum())
        runs = _two_sided((seen - mean) / math.sqrt(variance)) if variance > 0 else 1.0
    centred = x - x.mean()
    energy = float((centred ** 2).sum())
    serial = _two_sided((float((centred[1:] * centred[:-1]).sum()) / energy + 1 / n) * math.sqrt(n)) if energy else 2.0 ** (1 - n)
    half = -sum(math.log(max(p, 1e-300)) for p in (uniform, runs, serial))
    return math.exp(-half) * (1 + half + half * half / 2)  # upper tail of chi-squared with six degrees of freedom


_CODES = np.full(256, 26, np.int64)
for _i, (_u, _l) in enumerate(zip(_UPPER, _LOWER)):
    _CODES[ord(_u)] = _CODES[ord(_l)] = _i
_CODES[[ord(c) for c in _DIGITS + "+/=_-"]] = 27


def pairs(texts: list[str]) -> np.ndarray:
    """Counts of neighbouring letters (26: none) in the words of ``WORD`` letters that no digit or sign of an encoding touches."""
    codes = _CODES[np.frombuffer(("\n" + "\n".join(texts) + "\n").encode(), np.uint8)]
    word = codes < 26
    starts = np.flatnonzero(word[1:] & ~word[:-1]) + 1
    ends = np.flatnonzero(~word[1:] & word[:-1]) + 1
    good = (ends - starts >= WORD[0]) & (ends - starts <= WORD[1]) & (codes[starts - 1] == 26) & (codes[ends] == 26)
    inside = np.zeros(len(codes) + 1, np.int64)
    inside[starts[good]] = 1
    inside[ends[good] + 1] -= 1  # the place after the last letter ends the last pair; a word may start there at the earliest
    second = np.cumsum(inside)[:-1] > 0
    at = np.flatnonzero(second)
    return np.bincount(codes[at - 1] * 27 + codes[at], minlength=27 * 27)[:27 * 27].reshape(27, 27)


def letter_odds(counts: np.ndarray) -> np.ndarray:
    """Per letter before (26: none) and letter: log of its probability in words over that of a random letter."""
    counts = (counts + pairs(COMMON))[:, :26].astype(float)
    single = counts.sum(axis=0) / counts.sum()
    after = counts.sum(axis=1, keepdims=True)
    pair = np.where(after > 0, counts / np.maximum(after, 1), single)
    return np.log(26 * (MIX[0] * pair + MIX[1] * single + MIX[2] / 26))


def learn(docs: DataFrame, text: str = "text") -> np.ndarray:
    """``letter_odds`` of all whole texts."""
    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = sum(pairs(batch.column(0)[r.start:r.stop].to_pylist()) for r in common.runs_of([len(t) for t in batch.column(0).to_pylist()]))
        at = np.flatnonzero(found)
        return pa.RecordBatch.from_arrays([pa.array(at), pa.array(found.ravel()[at])], ["pair", "c"])

    rows = common.in_batches(docs.select(common.text_or_empty(text).alias("text")), work, "pair bigint, c bigint")
    counts = np.zeros(27 * 27, np.int64)
    for pair, c in rows.groupBy("pair").agg(F.sum("c")).collect():  # one row per pair of letters
        counts[pair] = c
    return letter_odds(counts.reshape(27, 27))


def word_odds(token: str, odds: np.ndarray) -> float:
    """Log of the token's probability as joined words (a capital after a small letter starts one) over that as random letters."""
    raw = np.frombuffer(token.encode(), np.uint8)
    own = _CODES[raw]
    before = np.concatenate([[26], own[:-1]])
    before[1:][(raw[1:] < 97) & (raw[:-1] >= 97)] = 26
    return float(odds[before, own].sum())


def candidates(text: str, taken: list[tuple[str, int, int]], odds: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(start, end, length, step, way of testing) of every run that no fixed pattern touches.

    The step is that of the joint probability, or for ``LETTERS`` of the probability that words look as random: half
    the logarithm of the ratio counts, as words of other languages and names fit the pairs less.
    """
    out = []
    for m in _RUN.finditer(text):
        s, e = m.span()
        if any(a < e and s < b for _, a, b in taken):
            continue
        x, size, ordinary = infer(m.group())
        if ordinary is None or len(x) < SHORTEST:
            continue
        joint, kind = battery(x, size), MIXED
        step = min(int(joint * STEPS), STEPS - 1)
        if ordinary:
            level = int(-word_odds(m.group().replace("=", ""), odds) / 2 * FINE)
            kind = LETTERS if level > 0 and joint >= ORDERED else WORDS
            step = min(level, STEPS - 1) if kind == LETTERS else step
        out.append((s, e, min(len(x), LONGEST), step, kind))
    return out


def scan(docs: DataFrame, odds: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``base`` (kind, s, e) and ``runs`` (s, e, n, step, kind) of every whole text; null counts as empty."""
    span = pa.list_(pa.struct([("kind", pa.string()), ("s", pa.int32()), ("e", pa.int32())]))
    run = pa.list_(pa.struct([(c, pa.int32()) for c in ("s", "e", "n", "step", "kind")]))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(1).to_pylist()
        base = [base_spans(t) for t in texts]
        found = [candidates(t, b, odds) for t, b in zip(texts, base)]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([[dict(zip(("kind", "s", "e"), b)) for b in bs] for bs in base], span),
             pa.array([[dict(zip(("s", "e", "n", "step", "kind"), f)) for f in fs] for fs in found], run)],
            ["key", "base", "runs"])

    rows = docs.select(docs[key].alias("key"), common.text_or_empty(text).alias("text"))
    return common.in_batches(
        rows, work, f"key {dict(rows.dtypes)['key']}, base array<struct<kind:string,s:int,e:int>>, "
        "runs array<struct<s:int,e:int,n:int,step:int,kind:int>>").withColumnRenamed("key", key)


def _prior(n: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Assumed share of ordinary tokens of length ``n`` that look at least as random: halves every few characters."""
    return 2.0 ** (-(n - 8) * (step / STEPS) / 2)


def cutoffs(cells: list[tuple[int, int, int, int]], kind: int = MIXED) -> list[int]:
    """Per length 0..LONGEST the least step of candidates tested as ``kind`` that is reported (STEPS: none).

    ``cells`` counts candidates by (length, step, way of testing).  A class without
    enough ordinary tokens also uses those of shorter classes, which look
    random more easily.  Words are tested with the letters, and none passes.
    """
    counts = np.zeros((3, LONGEST + 1, STEPS))
    for n, step, k, c in cells:
        counts[int(k), n, step] += c
    out = [STEPS] * (LONGEST + 1)
    null = np.zeros(STEPS)
    for lower, upper in zip(CLASSES, (*CLASSES[1:], LONGEST + 1)):
        own = counts[WORDS, lower:upper].sum(axis=0)
        null = own if own.sum() >= 2 * PRIOR else null + own
        above = null[::-1].cumsum()[::-1]
        tested = counts[kind, lower:upper]
        if not tested.sum():
            continue
        lengths, steps = np.mgrid[lower:upper, 0:STEPS]
        number = tested.sum()
        if kind == LETTERS:
            number += own.sum()
            p = np.exp(-steps / FINE)
        else:
            p = (PRIOR * _prior(lengths, steps) + above[steps]) / (PRIOR + null.sum())
        order = np.argsort(p, axis=None, kind="stable")
        upto = tested.ravel()[order].cumsum()
        passing = p.ravel()[order] <= FALSE_SHARE * upto / number
        if passing.any():
            limit = p.ravel()[order][np.flatnonzero(passing)[-1]]
            for n in range(lower, upper):
                fine = np.flatnonzero(p[n - lower] <= limit)
                out[n] = int(fine[0]) if len(fine) else STEPS
    return out


def secrets(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row ``key``, ``base`` and ``found``: arrays of (kind, s, e) in code points, end exclusive.

    Rows with equal keys stay separate.  The thresholds come from counts by
    length, step and way of testing over all rows; that table has a fixed number of cells.
    """
    rows = cut_lineage(scan(docs, learn(docs, text), key, text))
    cells = [tuple(c) for c in rows.select(F.explode("runs").alias("r")).groupBy("r.n", "r.step", "r.kind").count().collect()]
    least = {k: F.array(*map(F.lit, cutoffs(cells, k))) for k in (MIXED, LETTERS)}
    extra = F.transform(
        F.filter("runs", lambda r: F.coalesce(*(F.when(r.kind == k, r.step >= F.element_at(c, r.n + 1)) for k, c in least.items()),
                                              F.lit(False))),
        lambda r: F.struct(F.lit("random").alias("kind"), r.s.alias("s"), r.e.alias("e")))
    return rows.select(key, "base", F.concat("base", extra).alias("found"))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets(common.read(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", *(spans.count(F.col("base"), k).alias(f"n_{k}") for k in KINDS[:3]),
        F.sha2(spans.joined(F.col("base"), KINDS, by_kind=False), 256).alias("base_sha256"),
        spans.joined(F.col("found"), KINDS, by_kind=False).alias("spans"))
