"""Stupid-backoff scores of every document by the counts of all other documents.

Documents are gathered into chunks.  The n-grams of one, two and three words of
a chunk are exploded, counted beforehand, and dealt by hash to buckets.  A
bucket adds its chunks' counts up, which is its part of the count table, joins
the table to the n-grams it was sent, and answers each chunk.  There the counts
meet the texts again, lose what the document itself contributed, and are summed
to its score.  No n-gram is left out: a hot one is one entry a chunk.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rainloom.llm import common
from rainloom.session import cut_lineage

#: Longest n-gram and factor of a back-off.
ORDER, BACK_OFF = 3, 0.4
#: Bits of an n-gram's hash.
BITS = 60
#: Bytes of text in a chunk (or one longer text), and n-grams that a bucket gets at most.
CHUNK, BUCKET = 10 << 20, 4_000_000


# ---------------------------------------------------------------- chunks


def chunks_of(rows: DataFrame) -> DataFrame:
    """(chunk, ids, sizes, texts, words): consecutive rows, about ``CHUNK`` bytes together, as a written table.

    Being written, chunks stay the same however often tasks are run again.
    """
    kind = dict(rows.dtypes)["key"]

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, k = TaskContext.get().partitionId() << 32, 0
        keys, texts, held = [], [], 0
        for batch in batches:
            for i, text in enumerate(batch.column(1).to_pylist()):
                data = text.encode("utf-8", "surrogatepass")
                if texts and held + len(data) > CHUNK:
                    yield made(first + k, keys, texts)
                    keys, texts, held, k = [], [], 0, k + 1
                keys.append(batch.column(0)[i])
                texts.append(data)
                held += len(data)
        if texts:
            yield made(first + k, keys, texts)

    def made(chunk: int, keys: list, texts: list[bytes]) -> pa.RecordBatch:
        ids = pa.array([x.as_py() for x in keys], keys[0].type)
        words = _starts(b"\n".join(texts)) if texts else 0
        return pa.RecordBatch.from_arrays(
            [pa.array([chunk], pa.int64()), pa.ListArray.from_arrays([0, len(ids)], ids), pa.array([[len(x) for x in texts]], pa.list_(pa.int64())),
             pa.array([zstandard.compress(b"".join(texts), 9)], pa.binary()), pa.array([words], pa.int64())],
            ["chunk", "ids", "sizes", "texts", "words"])

    return cut_lineage(rows.mapInArrow(gather, f"chunk bigint, ids array<{kind}>, sizes array<bigint>, texts binary, words bigint"))


def _starts(data: bytes) -> int:
    """Number of words."""
    member = ~np.isin(np.frombuffer(data, np.uint8), list(b"\x20\x09\x0a\x0b\x0c\x0d"))
    return int(np.count_nonzero(member[1:] & ~member[:-1])) + int(len(member) > 0 and member[0])


def _texts(blob: bytes, sizes: list[int]) -> list[str]:
    data, at, out = zstandard.decompress(blob), 0, []
    for size in sizes:
        out.append(data[at:at + size].decode("utf-8", "surrogatepass"))
        at += size
    return out


def grams(texts: list[str]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Per order the hashes of the n-grams that begin at each word (0 where the text ends before), rows of the words, places in them."""
    h, upto = common.word_hashes(texts)
    lengths = np.diff(upto)
    row = np.repeat(np.arange(len(texts)), lengths)
    place = np.arange(len(h)) - np.repeat(upto[:-1], lengths)
    left = np.repeat(lengths, lengths) - place
    out = [h]
    for n in range(2, ORDER + 1):
        longer = np.zeros(len(h), np.uint64)
        longer[:max(len(h) - n + 1, 0)] = common.mix(out[-1][:max(len(h) - n + 1, 0)] * np.uint64(3) + h[n - 1:])
        out.append(longer)
    short = np.uint64(64 - BITS)
    return [np.where(left > n, np.maximum(x >> short, np.uint64(1)), np.uint64(0)) for n, x in enumerate(out)], row, place


# ---------------------------------------------------------------- counts by bucket


def packed(hashes: np.ndarray, counts: np.ndarray) -> bytes:
    """Ascending hashes as differences, byte plane by byte plane, and their counts."""
    steps = np.diff(hashes, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T
    return zstandard.compress(steps.tobytes() + counts.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(zstandard.decompress(blob), np.uint8)
    count = len(data) // 12
    steps = np.ascontiguousarray(data[:8 * count].reshape(8, count).T).view("<u8")[:, 0]
    counts = np.ascontiguousarray(data[8 * count:].reshape(4, count).T).view("<u4")[:, 0]
    return np.cumsum(steps, dtype=np.uint64), counts.astype(np.int64)


def _distinct(found: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    hashes, counts = np.unique(np.concatenate(found), return_counts=True)
    return (hashes[1:], counts[1:]) if len(hashes) and hashes[0] == 0 else (hashes, counts)


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> np.uint64(BITS - 32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)  # ascending with the hash


def dealt(chunks: DataFrame, buckets: int) -> DataFrame:
    """(bucket, chunk, run): the distinct n-grams of each chunk and their counts, by bucket."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                chunk, sizes, blob = (batch.column(c)[i].as_py() for c in range(3))
                hashes, counts = _distinct(grams(_texts(blob, sizes))[0])
                owner = _bucket(hashes, buckets)
                first = np.flatnonzero(np.diff(owner, prepend=-1))
                runs = [packed(hashes[s:e], counts[s:e]) for s, e in zip(first.tolist(), [*first[1:].tolist(), len(hashes)])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(owner[first]), pa.array([chunk] * len(first), pa.int64()), pa.array(runs, pa.binary())], ["bucket", "chunk", "run"])

    return chunks.select("chunk", "sizes", "texts").mapInArrow(work, "bucket bigint, chunk bigint, run binary")


def answered(runs: DataFrame) -> DataFrame:
    """(chunk, bucket, totals): for each run the counts of its n-grams over all chunks, in the order of the run."""
    def add(rows: pa.Table) -> pa.Table:
        parts = [unpacked(b) for b in rows["run"].to_pylist()]
        hashes, at = np.unique(np.concatenate([h for h, _ in parts]), return_inverse=True)
        totals = np.bincount(at, np.concatenate([c for _, c in parts]).astype(float), len(hashes)).astype(np.int64)  # exact to 2^53
        ends = np.cumsum([len(h) for h, _ in parts])
        answers = [zstandard.compress(totals[at[e - len(h):e]].astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes(), 1)
                   for e, (h, _) in zip(ends.tolist(), parts)]
        return pa.table([rows["chunk"], rows["bucket"], pa.array(answers, pa.binary())], names=["chunk", "bucket", "totals"])

    return runs.groupBy("bucket").applyInArrow(add, "chunk bigint, bucket bigint, totals binary")


def _totals(blob: bytes) -> np.ndarray:
    data = np.frombuffer(zstandard.decompress(blob), np.uint8)
    return np.ascontiguousarray(data.reshape(8, -1).T).view("<i8")[:, 0]


# ---------------------------------------------------------------- scores


def word_scores(texts: list[str], totals: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Per text the number of words and the sum of their log scores; ``totals`` are the corpus's counts of the texts' n-grams, by hash."""
    found, row, place = grams(texts)
    hashes, number = np.unique(np.concatenate(found), return_inverse=True)
    if len(hashes) and hashes[0] == 0:
        totals = np.append(0, totals)
    others = []  # how often the n-gram that begins at each word stands in other texts
    for at in np.split(number, ORDER):
        _, first, own = np.unique(row * np.int64(len(hashes)) + at, return_inverse=True, return_counts=True)
        others.append(np.maximum(totals[at] - own[first], 0) if len(at) else at)
    alpha = math.log(BACK_OFF)
    one = others[0]
    score = np.where(one > 0, np.log(np.maximum(one, 1)), alpha) - math.log(max(size, 1)) + alpha * np.minimum(place, ORDER - 1)
    for n in range(2, ORDER + 1):  # the longest n-gram that others have decides
        ends = np.arange(n - 1, len(score))
        there = others[n - 1][ends - (n - 1)] > 0
        ends = ends[there]
        begins = ends - (n - 1)
        missed = np.minimum(place[ends], ORDER - 1) - (n - 1)  # longer ones that the place would have allowed
        score[ends] = np.log(others[n - 1][begins]) - np.log(others[n - 2][begins]) + alpha * missed
    return np.bincount(row, minlength=len(texts)).astype(np.int64), np.bincount(row, score, len(texts)).astype(float)


def scores(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per ``key``: ``n_words`` and ``log_score``, the sum of the words' natural log scores.

    Counts are those of all rows but the one that is scored, so a text does not vouch for itself while a copy does.
    A word scores count(two before, one before, own) / count(two before, one before) if others have the three in
    a row; else ``BACK_OFF`` times count(one before, own) / count(one before) if they have the two; else
    ``BACK_OFF`` for each of the longer ones times count(own) / corpus size, with ``BACK_OFF`` as the count of a word that nobody
    else has.  The first words of a text, which have fewer before them, back off from fewer.  Words are separated
    by ASCII white space, A-Z lower-cased; n-grams are told apart by hashes of ``BITS`` bits.  Texts without words, and nulls, have
    0 words and score 0.  Rows of equal key are added up, and so are rows without a key.
    """
    rows = docs.select(docs[key].alias("key"), common.text_or_empty(text).alias("text"))
    kind = dict(rows.dtypes)["key"]
    chunks = chunks_of(rows)
    size = chunks.agg(F.sum("words").alias("n")).first()["n"] or 0
    totals = answered(dealt(chunks, ORDER * size // BUCKET + 1))

    def score(own: pa.Table, answers: pa.Table) -> pa.Table:
        ids = own["ids"].combine_chunks().values
        texts = _texts(own["texts"][0].as_py(), own["sizes"][0].as_py())
        parts = sorted(zip(answers["bucket"].to_pylist(), answers["totals"].to_pylist()))
        counted = np.concatenate([_totals(b) for _, b in parts]) if parts else np.empty(0, np.int64)
        n, s = word_scores(texts, counted, size)
        return pa.table([ids, pa.array(n), pa.array(s)], names=["key", "n", "s"])

    found = chunks.groupBy("chunk").cogroup(totals.groupBy("chunk")).applyInArrow(score, f"key {kind}, n bigint, s double")
    return found.groupBy("key").agg(F.sum("n").alias("n_words"), F.sum("s").alias("log_score")).withColumnRenamed("key", key)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scores(common.read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", F.round("log_score", 6).alias("log_score"),
                        F.round(F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words")).otherwise(0.0), 6).alias("per_word"))


def _others(n: int) -> str:
    """Counts of n-grams over all documents less those of the own one."""
    names = ["x", "p", "q"][:n][::-1]
    known = " AND ".join(f"{c} IS NOT NULL" for c in names)
    keys = ", ".join(names)
    return (f"a{n} AS (SELECT {keys}, count(*) AS c FROM o WHERE {known} GROUP BY ALL),\n"
            f"d{n} AS (SELECT doc_id, {keys}, count(*) AS c FROM o WHERE {known} GROUP BY ALL),\n"
            f"c{n} AS (SELECT doc_id, {', '.join(f'd{n}.{c}' for c in names)}, a{n}.c - d{n}.c AS c FROM d{n} JOIN a{n} USING ({keys}))")


#: The same in DuckDB.
SQL = rf"""
WITH t AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[ \x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), o AS (SELECT doc_id, i, w[i] AS x, CASE WHEN i > 1 THEN w[i - 1] END AS p, CASE WHEN i > 2 THEN w[i - 2] END AS q
         FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM t)),
{_others(1)},
{_others(2)},
{_others(3)},
s AS (
  SELECT o.doc_id, CASE WHEN t3.c > 0 THEN ln(t3.c) - ln(t2.c)
                        WHEN b2.c > 0 THEN ln(b2.c) - ln(b1.c) + CASE WHEN o.q IS NULL THEN 0 ELSE ln({BACK_OFF}) END
                        ELSE CASE WHEN u.c > 0 THEN ln(u.c) ELSE ln({BACK_OFF}) END - ln((SELECT count(*) FROM o))
                             + ln({BACK_OFF}) * least(o.i - 1, 2) END AS y
  FROM o JOIN c1 u ON u.doc_id = o.doc_id AND u.x = o.x
  LEFT JOIN c1 b1 ON b1.doc_id = o.doc_id AND b1.x = o.p LEFT JOIN c2 b2 ON b2.doc_id = o.doc_id AND b2.p = o.p AND b2.x = o.x
  LEFT JOIN c2 t2 ON t2.doc_id = o.doc_id AND t2.p = o.q AND t2.x = o.p
  LEFT JOIN c3 t3 ON t3.doc_id = o.doc_id AND t3.q = o.q AND t3.p = o.p AND t3.x = o.x
), d AS (SELECT doc_id, count(*) AS n, sum(y) AS y FROM s GROUP BY doc_id)
SELECT t.doc_id, coalesce(n, 0)::BIGINT AS n_words, round(coalesce(y, 0.0), 6) AS log_score, round(coalesce(y / n, 0.0), 6) AS per_word
FROM t LEFT JOIN d ON d.doc_id = t.doc_id
"""
