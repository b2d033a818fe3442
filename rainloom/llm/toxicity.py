"""Toxicity by compression distance: which of two zstandard dictionaries shortens a window of text more.

One dictionary is trained on ordinary text, the other on toxic text: both hold
the common words, the toxic one also the pieces of words that set toxic
documents apart.  A window that the toxic dictionary compresses to fewer bytes
resembles toxic text; a document is judged by its most suspicious windows
against thresholds calibrated on other labelled rows.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rainloom.llm import common, minhash

#: Labelled rows of each class that the fit reads at most (chosen by a hash of the row's key).
FIT_ROWS = 3000
#: Bytes of a window, length of dictionary pieces, common words in both dictionaries, most pieces in the toxic one.
WINDOW, PIECE, COMMON_WORDS, PIECES = 64, (5, 14), 2000, 400
#: A piece counts if this share of toxic documents has it, this many times the share of ordinary documents.
SHARE, TIMES = 0.02, 25
#: Its two counts must be less likely than e^-SURE, over the number of pieces looked at, if it had nothing to do with toxicity.
SURE = 3.0

_WORD = re.compile(rb"[^\x00-\x40\x5b-\x60\x7b-\x7f]{2,}")


def folded(text: str) -> bytes:
    """The text in lower case (A-Z), as bytes, with a space before it so that every word has one."""
    return b" " + text.encode("utf-8", "surrogatepass").lower()


@dataclass(frozen=True)
class Model:
    """Contents of the two dictionaries, and the calibrated score by byte gain of the best and the second window."""

    ordinary: bytes
    toxic: bytes
    scores: tuple[tuple[float, ...], ...] = ()


@lru_cache(maxsize=8)
def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    parameters = zstandard.ZstdCompressionParameters.from_level(
        3, source_size=WINDOW, dict_size=max(len(content), 8), min_match=PIECE[0], strategy=zstandard.STRATEGY_LAZY,
        write_content_size=False, write_checksum=False, write_dict_id=False)
    trained = zstandard.ZstdCompressionDict(content or b" " * 8, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    trained.precompute_compress(compression_params=parameters)
    return zstandard.ZstdCompressor(dict_data=trained, compression_params=parameters)


def windows(data: bytes) -> np.ndarray:
    """Start and length of consecutive windows over all bytes; each ends at the next space beyond ``WINDOW`` bytes.

    Without a space within another window's length it ends there.
    """
    cuts = [0]
    while cuts[-1] + WINDOW < len(data):
        end = data.find(b" ", cuts[-1] + WINDOW, cuts[-1] + 2 * WINDOW)
        cuts.append(end if end >= 0 else min(cuts[-1] + 2 * WINDOW, len(data)))
    if cuts[-1] < len(data):
        cuts.append(len(data))
    at = np.array(cuts, np.uint64)
    return np.stack([at[:-1], np.diff(at)], axis=1)


def gains(texts: list[str], model: Model) -> np.ndarray:
    """Per text the bytes that the toxic dictionary saves over the ordinary one, in the best and second-best window."""
    data = [folded(t) for t in texts]
    parts = [windows(d) for d in data]
    upto = np.cumsum([0] + [len(p) for p in parts])
    shift = np.cumsum([0] + [len(d) for d in data])[:-1].astype(np.uint64)
    segments = np.concatenate([p + np.array([s, 0], np.uint64) for p, s in zip(parts, shift)])
    buffer = zstandard.BufferWithSegments(b"".join(data), segments.astype("<u8").tobytes())

    def sizes(content: bytes) -> np.ndarray:
        packed = _compressor(content).multi_compress_to_buffer(buffer, threads=1)
        return np.fromiter(map(len, packed), np.int64, len(packed))

    saved = sizes(model.ordinary) - sizes(model.toxic)
    best = np.maximum.reduceat(saved, upto[:-1])
    owner = np.repeat(np.arange(len(texts)), np.diff(upto))
    first = np.unique(owner[saved == best[owner]], return_index=True)[1]  # one of the best windows is left out
    rest = saved.copy()
    rest[np.flatnonzero(saved == best[owner])[first]] = -99
    return np.stack([best, np.maximum.reduceat(rest, upto[:-1])], axis=1)


def word_counts(texts: list[str]) -> Counter:
    """In how many of the texts each word occurs."""
    return Counter(w for t in texts for w in set(_WORD.findall(folded(t))))


def _frequent_pieces(words: list[tuple[bytes, int]], least: float, small: int, large: int) -> dict[bytes, int]:
    """Pieces of ``small`` to ``large`` bytes that occur ``least`` times in (word, times); grown a byte at a time.

    A piece can only be frequent if the two that are a byte shorter are, so the
    counts never hold more than the pieces of one length.
    """
    starts = [(w, n, range(len(w) - small + 1)) for w, n in words]
    out: dict[bytes, int] = {}
    for size in range(small, large + 1):
        counted: Counter = Counter()
        for w, n, places in starts:
            for p in {w[i:i + size] for i in places}:
                counted[p] += n
        kept = {p: c for p, c in counted.items() if c >= least}
        out |= kept
        grown = []
        for w, n, places in starts:
            good = {i for i in places if w[i:i + size] in kept}
            longer = [i for i in good if i + 1 in good]
            if longer:
                grown.append((w, n, longer))
        starts = grown
    return out


def train_dictionaries(counts: list[tuple[bytes, int, int]], n_toxic: int, n_ordinary: int) -> Model:
    """Dictionaries from (word, toxic documents, ordinary documents with it).

    Pieces are chosen greedily: each round takes the one whose counts in toxic
    words not covered yet and in ordinary words are most surprising; of equal
    ones the longer, then the smaller in byte order.  Words that hold a chosen
    piece, or never occur in ordinary rows, are not among the common ones.
    """
    small, large = PIECE
    least = max(4, SHARE * n_toxic)
    toxic = _frequent_pieces([(b" " + w + b" ", a) for w, a, _ in counts if a], least, small, large)
    roots = {p for p in toxic if len(p) == small}

    def pieces(word: bytes) -> set[bytes]:
        """Frequent toxic pieces in the word; every one begins with a frequent shortest piece."""
        framed, out = b" " + word + b" ", set()
        for i in range(len(framed) - small + 1):
            if framed[i:i + small] in roots:
                k = small
                while k <= large and i + k <= len(framed) and framed[i:i + k] in toxic:
                    out.add(framed[i:i + k])
                    k += 1
        return out

    ordinary: Counter = Counter()
    for word, _, b in counts:
        if b:
            for p in pieces(word):
                ordinary[p] += b
    expected = n_toxic / max(n_toxic + n_ordinary, 1)
    needed = SURE + np.log(max(len(roots), 1))  # longer pieces belong to words that were counted as a root

    def surprise(a: int, b: int) -> float:
        """Log-likelihood ratio of the two counts against the classes' sizes."""
        share = a / (a + b)
        return a * np.log(share / expected) + (b * np.log((1 - share) / (1 - expected)) if b else 0.0)

    def stands_out(a: int, b: int) -> bool:
        return a * n_ordinary > TIMES * b * n_toxic and surprise(a, b) > needed

    apart = {p for p, c in toxic.items() if stands_out(c, ordinary[p])}
    owners = defaultdict(list)
    for word, a, _ in counts:
        if a:
            for p in pieces(word) & apart:
                owners[p].append((word, a))
    covered: set[bytes] = set()
    chosen: list[bytes] = []
    waiting = list(apart)
    while waiting and len(chosen) < PIECES:
        left = {p: sum(a for w, a in owners[p] if w not in covered) for p in waiting}
        waiting = [p for p in waiting if left[p] >= least and stands_out(left[p], ordinary[p])]
        if waiting:
            best = min(waiting, key=lambda p: (-surprise(left[p], ordinary[p]), -len(p), p))
            chosen.append(best)
            covered |= {w for w, _ in owners[best]}
    apart_words = {w for p in chosen for w, _ in owners[p]}
    ordinary_words = [x for x in counts if x[2] and x[0] not in apart_words]
    common_words = sorted(ordinary_words, key=lambda x: (-x[2], x[0]))[:COMMON_WORDS]
    base = b"".join(b" " + w for w, _, _ in reversed(common_words))
    return Model(base, b"".join(reversed(chosen)) + base)


#: Gains are calibrated in the range from 0 to this many bytes; a text without any has at most this score.
MOST, UNMARKED = 15, 0.49


def calibrate(model: Model, gained: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> Model:
    """Share of toxic rows by best gain and (capped) second gain, smoothed, and monotone in both.

    A text without a gain shows no sign of toxicity: its score stays below one
    half however many of the labelled rows are toxic.
    """
    table = np.zeros((MOST + 1, MOST + 1, 2))
    clipped = np.clip(gained, 0, MOST)
    np.add.at(table, (clipped[:, 0], clipped[:, 1], toxic), weight)
    prior = (table.sum(axis=(0, 1)) + (1, 0.1)) / (table.sum() + 1.1)
    spread = np.exp(-0.5 * ((np.arange(MOST + 1)[:, None] - np.arange(MOST + 1)) / 0.6) ** 2)
    smooth = np.einsum("ij,jkc,lk->ilc", spread, table, spread) + 0.2 * prior
    score = smooth[..., 1] / smooth.sum(axis=2)
    score[0] = np.minimum(score[0], UNMARKED)
    score = np.maximum.accumulate(np.maximum.accumulate(score, axis=0), axis=1)
    return Model(model.ordinary, model.toxic, tuple(map(tuple, np.round(score, 6).tolist())))


def copy_keys(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The rows with the least hash of a text's five-word shingles under two orders, which near copies mostly share."""
    sets = minhash.shingle_sets(batch.column(0).to_pylist(), 5)
    keys = [[int(f(s).min().view(np.int64)) if len(s) else 0 for s in sets] for f in (lambda s: s, common.mix)]
    return pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(k, pa.int64()) for k in keys)], ["text", "k", "y", "c0", "c1"])


def held_out(key: str = "doc_id"):
    return F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Dictionaries and thresholds from at most ``FIT_ROWS`` labelled rows of each class.

    Rows whose crc32(key) mod 5 is 0 are never read.  Two thirds of the sample train the dictionaries, the
    rest calibrates; of copies and most near copies in the sample one stays.  Null texts, null labels and labels
    without a document are left out; a label that is given twice counts once, and 1 wins over 0.
    """
    marks = labels.select(labels[key].alias("k"), labels[label].cast("int").alias("y")) \
        .where("k is not null and y in (0, 1)").groupBy("k").agg(F.max("y").alias("y"))
    rows = marks.where(~held_out("k"))
    sizes = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    order = F.xxhash64(F.col("k"), F.lit(7))
    drawn = rows.where("y = 1").orderBy(order, "k").limit(FIT_ROWS).union(
        rows.where("y = 0").orderBy(order, "k").limit(FIT_ROWS))
    sample = docs.select(docs[text].cast("string").alias("text"), docs[key].alias("k")).where("text is not null") \
        .join(F.broadcast(drawn), "k").select("text", "k", "y")
    sample = common.in_batches(sample, copy_keys, f"text string, k {dict(sample.dtypes)['k']}, y int, c0 bigint, c1 bigint")
    for c in ("c0", "c1"):  # one of each group of copies: else their words would pass for signs of their class
        alike = Window.partitionBy("y", c).orderBy("k", "text")
        sample = sample.withColumn("place", F.row_number().over(alike)).where("place = 1").drop("place")
    sample = sample.withColumn("part", F.pmod(F.xxhash64("text"), F.lit(3))).persist()  # bounded: FIT_ROWS of each class
    try:
        n = {r["y"]: r["n"] for r in sample.where("part < 2").groupBy("y").agg(F.count("*").alias("n")).collect()}

        def count(batch: pa.RecordBatch) -> pa.RecordBatch:
            marks_, texts = batch.column(1).to_pylist(), batch.column(0).to_pylist()
            by = [word_counts([t for t, y in zip(texts, marks_) if y == k]) for k in (1, 0)]
            found = sorted(by[0].keys() | by[1].keys())
            return pa.RecordBatch.from_arrays(
                [pa.array(found, pa.binary()), pa.array([by[0][w] for w in found], pa.int64()),
                 pa.array([by[1][w] for w in found], pa.int64())], ["w", "a", "b"])

        counted = common.in_batches(sample.where("part < 2").select("text", "y"), count, "w binary, a bigint, b bigint")
        words = counted.groupBy("w").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
        counted = words.toArrow()  # bounded by the sample
        counts = list(zip(*(counted.column(c).to_pylist() for c in ("w", "a", "b"))))
        del counted
        model = train_dictionaries(counts, n.get(1, 0), n.get(0, 0))
        del counts

        def gain(batch: pa.RecordBatch) -> pa.RecordBatch:
            got = gains(batch.column(0).to_pylist(), model)
            return pa.RecordBatch.from_arrays([batch.column(1), pa.array(got[:, 0]), pa.array(got[:, 1])], ["y", "g", "h"])

        got = common.in_batches(sample.where("part = 2").select("text", "y"), gain, "y int, g bigint, h bigint").collect()
    finally:
        sample.unpersist()
    marks_ = np.array([r["y"] for r in got], np.int64)
    drawn_of = {y: max(1, min(FIT_ROWS, size)) for y, size in sizes.items()}
    weight = np.array([sizes[y] / drawn_of[y] for y in marks_.tolist()])
    pairs = np.array([(r["g"], r["h"]) for r in got], np.int64).reshape(-1, 2)
    return calibrate(model, pairs, marks_, weight)


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score", keep: tuple[str, ...] = ()) -> DataFrame:
    """The ``keep`` columns of every row and ``out``: 0 to 1, higher where toxic is likelier; a null text counts as empty."""
    from pyspark.sql.types import DoubleType, StructField, StructType

    rows = docs.select(*keep, common.text_or_empty(text).alias("__text"))
    table = np.array(model.scores)

    def work(batch: pa.RecordBatch):
        texts = batch.column(len(keep)).to_pylist()
        for part in common.runs_of([len(t) for t in texts]):
            at = np.clip(gains(texts[part], model), 0, MOST)
            yield pa.RecordBatch.from_arrays(
                [batch.column(i)[part] for i in range(len(keep))] + [pa.array(table[at[:, 0], at[:, 1]])], [*keep, out])

    schema = StructType([rows.schema[c] for c in keep] + [StructField(out, DoubleType())])
    return common.in_batches(rows, work, schema)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    model = fit(docs, common.read(spark, sf_dir, "labels"))
    scored = score(docs, model, keep=("doc_id",))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
