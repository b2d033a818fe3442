"""Fill-in-the-middle: each text is cut in three and its middle moved to the end.

Cuts fall on boundaries between units (runs of letters, or single other
characters).  Where the k-th boundary lies is read from a learned rank index:
straight segments fitted to all (rank, offset) pairs within a fixed error
predict the offset, and the stored residual of the rank makes it exact.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rainloom.llm import common

#: Marks before prefix, suffix and middle; percent of texts that are changed, and of those in the order suffix-prefix-middle.
MARKS, CHANGED, SUFFIX_FIRST = ("<P>", "<S>", "<M>"), 90, 20
#: Characters that a fitted segment may be off; residuals then fit one byte.
ERROR = 100


@dataclass(frozen=True)
class RankIndex:
    """Offsets by rank: segment starts, their offsets and slopes, and a residual for every rank."""

    starts: np.ndarray
    bases: np.ndarray
    slopes: np.ndarray
    residuals: np.ndarray

    @classmethod
    def fit(cls, offsets: np.ndarray, error: int = ERROR) -> "RankIndex":
        """Segments as long as one line from their first point stays within ``error`` of all their points.

        The slopes that do so form a cone that narrows with every point; a segment ends where it closes.
        """
        starts, slopes, at, last = [], [], 0, len(offsets) - 1
        while at <= last:
            low, high, done, step, slope = -np.inf, np.inf, at, 512, 0.0
            while done < last:  # in doubling stretches, with the cone carried on
                stop = min(done + step, last)
                run = np.arange(done + 1 - at, stop + 1 - at)
                rise = offsets[done + 1:stop + 1] - offsets[at]
                lows = np.maximum.accumulate(np.maximum((rise - error) / run, low))
                highs = np.minimum.accumulate(np.minimum((rise + error) / run, high))
                closed = lows > highs
                inside = int(closed.argmax()) if closed.any() else len(run)
                if inside:
                    low, high = lows[inside - 1], highs[inside - 1]
                    slope = (low + high) / 2
                done += inside
                if inside < len(run):
                    break
                step *= 2
            starts.append(at)
            slopes.append(slope)
            at = done + 1
        starts = np.array(starts, np.int64)
        index = cls(starts, offsets[starts], np.array(slopes), np.zeros(0, np.int8))
        missed = offsets - index.predict(np.arange(len(offsets)))
        return cls(index.starts, index.bases, index.slopes, missed.astype(np.int8 if error < 127 else np.int64))

    def predict(self, ranks: np.ndarray) -> np.ndarray:
        segment = np.searchsorted(self.starts, ranks, side="right") - 1
        return self.bases[segment] + np.rint(self.slopes[segment] * (ranks - self.starts[segment])).astype(np.int64)

    def offsets(self, ranks: np.ndarray) -> np.ndarray:
        return self.predict(ranks) + self.residuals[ranks]


def boundaries(texts: Sequence[str]) -> list[np.ndarray]:
    """Per text the offsets, in code points, of its start and of the end of every unit."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    small = codes | np.uint32(32)
    letter = (small >= 97) & (small <= 122)
    ends = np.ones(len(codes), bool)
    ends[:-1] = ~(letter[:-1] & letter[1:])
    upto = np.cumsum([0] + [len(t) for t in texts])
    ends[upto[1:][upto[1:] > 0] - 1] = True
    at = np.flatnonzero(ends) + 1
    first = np.searchsorted(at, upto, side="right")
    return [np.append(0, at[a:b] - start) for a, b, start in zip(first[:-1], first[1:], upto[:-1])]


def rearranged(text: str, index: RankIndex, digest: str, changed: int, suffix_first: int) -> tuple[str, int | None, int | None, str]:
    """Form, characters of prefix and middle, and the output text, drawn from the hex digits of ``digest``."""
    h = [int(digest[k:k + 8], 16) for k in range(0, 32, 8)]
    if not text or any(m in text for m in MARKS) or h[2] % 100 >= changed:
        return "plain", None, None, text
    n = len(index.residuals) - 1
    cut, end = index.offsets(np.array(sorted((h[0] % (n + 1), h[1] % (n + 1))))).tolist()
    prefix, middle, suffix = text[:cut], text[cut:end], text[end:]
    p, s, m = MARKS
    if h[3] % 100 < suffix_first:
        return "spm", cut, end - cut, f"{s}{suffix}{p}{prefix}{m}{middle}"
    return "psm", cut, end - cut, f"{p}{prefix}{s}{suffix}{m}{middle}"


def fill_in_middle(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 1, changed: int = CHANGED,
                   suffix_first: int = SUFFIX_FIRST, error: int = ERROR, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per row the ``keep`` columns, ``n`` (units), ``form``, ``prefix_chars``, ``middle_chars``, ``segments`` and ``output``.

    Draws come from the SHA-256 of ``seed:key``, so rows of equal key and text have equal results; a null key is drawn
    as an empty one.  A null text counts as empty; empty texts and texts with a mark in them stay as they are.
    ``segments`` is the number of fitted segments of the text's rank index.
    """
    from pyspark.sql.types import StructType, _parse_datatype_string

    hidden = [f"__{i}" for i in range(len(keep))]
    draw = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(docs[key].cast("string"), F.lit(""))), 256)
    rows = docs.select(*(docs[c].alias(h) for c, h in zip(keep, hidden)), draw.alias("__draw"), common.text_or_empty(text).alias("__text"))
    names = ["n", "form", "prefix_chars", "middle_chars", "segments", "output"]

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(len(keep) + 1).to_pylist()
        indexes = [RankIndex.fit(b, error) for b in boundaries(texts)]
        done = [rearranged(t, i, d, changed, suffix_first) for t, i, d in zip(texts, indexes, batch.column(len(keep)).to_pylist())]
        form, prefix, middle, output = zip(*done)
        return pa.RecordBatch.from_arrays(
            [*(batch.column(i) for i in range(len(keep))), pa.array([len(i.residuals) - 1 for i in indexes], pa.int64()),
             pa.array(form), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()),
             pa.array([len(i.starts) for i in indexes], pa.int64()), pa.array(output, pa.string())], [*hidden, *names])

    more = _parse_datatype_string("n bigint, form string, prefix_chars bigint, middle_chars bigint, segments bigint, output string")
    out = common.in_slices(rows, work, StructType([rows.schema[h] for h in hidden] + list(more)))
    return out.select(*(F.col(h).alias(c) for h, c in zip(hidden, keep)), *names)


def restore(rearranged_docs: DataFrame, output: str = "output", form: str = "form", to: str = "restored") -> DataFrame:
    """Add the text that an output was made from; in outputs that are not plain every mark stands once."""
    split = rearranged_docs.withColumn("__parts", F.split(output, "|".join(MARKS), -1))
    part = [F.get("__parts", F.lit(k)) for k in range(4)]
    text = F.when(F.col(form) == "psm", F.concat(part[1], part[3], part[2])) \
        .when(F.col(form) == "spm", F.concat(part[2], part[3], part[1])).otherwise(F.col(output))
    return split.withColumn(to, text).drop("__parts")


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = restore(fill_in_middle(common.read(spark, sf_dir, "documents")))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                       F.sha2("restored", 256).alias("restored_sha256"))


_DRAW = [f"CAST('0x' || substr(h, {k}, 8) AS BIGINT)" for k in (1, 9, 17, 25)]

#: The same in DuckDB, with units as an array.
SQL = f"""
WITH a AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
b AS (SELECT doc_id, t, h, CASE WHEN t = '' THEN [] ELSE regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') END AS u FROM a),
c AS (SELECT doc_id, t, u, len(u) AS n, {_DRAW[0]} % (len(u) + 1) AS x, {_DRAW[1]} % (len(u) + 1) AS y,
             CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR {_DRAW[2]} % 100 >= {CHANGED}
                  THEN 'plain' WHEN {_DRAW[3]} % 100 < {SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form FROM b),
d AS (SELECT doc_id, t, n, form, array_to_string(u[1:least(x, y)], '') AS p,
             array_to_string(u[least(x, y) + 1:greatest(x, y)], '') AS m, array_to_string(u[greatest(x, y) + 1:n], '') AS s FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                   ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM d
"""
