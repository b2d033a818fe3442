"""Helpers shared by the corpus operators: bounded batches, byte-level words, schemas."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that one Arrow batch may hold, and bytes of text that numpy works on at a time.
BATCH_ROWS, CHUNK_BYTES = 512, 2 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def in_batches(df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch | Iterator[pa.RecordBatch]],
               schema: str) -> DataFrame:
    """``mapInArrow`` over small batches: each holds ``BATCH_ROWS`` rows at most, so long texts do not pile up."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                out = work(batch)
                yield from (out,) if isinstance(out, pa.RecordBatch) else out

    return df.mapInArrow(run, schema)


def in_slices(df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch | Iterator[pa.RecordBatch]],
              schema, limit: int = CHUNK_BYTES) -> DataFrame:
    """``mapInArrow`` over rows whose last column, a string, holds ``limit`` bytes together, or over one longer row.

    Batches are cut in the worker; Spark bounds their bytes itself, so no session setting is changed.
    """
    def run(batches):
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(batch.num_columns - 1)), 0).to_pylist()
            for part in runs_of(sizes, limit):
                out = work(batch[part])
                yield from (out,) if isinstance(out, pa.RecordBatch) else out

    return df.mapInArrow(run, schema)


def runs_of(sizes: list[int], limit: int = CHUNK_BYTES) -> Iterator[slice]:
    """Consecutive rows of ``limit`` bytes together, or a single longer row."""
    start, held = 0, 0
    for i, size in enumerate(sizes):
        if held and held + size > limit:
            yield slice(start, i)
            start, held = i, 0
        held += size
    if start < len(sizes):
        yield slice(start, len(sizes))


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit integers (shift, multiply, shift, multiply, shift)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@lru_cache(maxsize=4)
def _tables(kind: str, powers: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For a kind of word: which bytes belong to it, a random number per (lower-cased) byte, powers of an odd base."""
    code = np.arange(256)
    lower = np.where((code >= 65) & (code <= 90), code + 32, code)
    if kind == "space":  # everything but \x20 and \x09-\x0D
        member = (code != 32) & ~((code >= 9) & (code <= 13))
    else:  # letters and digits of ASCII, and everything beyond ASCII
        member = ((code >= 48) & (code <= 57)) | ((lower >= 97) & (lower <= 122)) | (code >= 128)
    values = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[lower]
    base = np.full(powers, 0xD6E8FEB86659FD93, np.uint64)
    base[0] = 1
    return member, values, np.multiply.accumulate(base)


def word_hashes(texts: list[str], kind: str = "space") -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the lower-cased (A-Z) words of all texts in order, and the number of words up to each text.

    ``kind`` "space" splits at ASCII white space, "alnum" at ASCII characters that are no letter or digit.
    """
    blobs = [t.encode("utf-8", "surrogatepass") for t in texts]
    buffer = np.frombuffer(b"\n".join(blobs) + b"\n", np.uint8)
    member = _tables(kind, 2)[0][buffer]
    edge = np.flatnonzero(np.diff(member, prepend=False, append=False))
    starts, ends = edge[0::2], edge[1::2]
    at = np.cumsum([0] + [len(b) + 1 for b in blobs])
    upto = np.searchsorted(starts, at)
    if not len(starts):
        return np.empty(0, np.uint64), upto
    lengths = ends - starts
    _, values, powers = _tables(kind, 1 << max(8, int(lengths.max()).bit_length()))
    first = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
    sums = np.add.reduceat(values[buffer[member]] * powers[place], first)
    return mix(sums + lengths.astype(np.uint64)), upto


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` words; callers leave out the runs that cross two texts."""
    if len(words) < size:
        return np.empty(0, np.uint64)
    count = len(words) - size + 1
    out = words[:count].copy()
    for k in range(1, size):
        out = mix(out * np.uint64(3) + words[k:k + count])
    return out
