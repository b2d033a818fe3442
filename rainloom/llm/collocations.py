"""Phrase collocations from suffix subtrees that are built group by group.

Every word of a piece begins a suffix, truncated to the longest phrase.  Words
are counted first; in the order of a prefix code, prefixes are gathered into
groups of bounded frequency, and a prefix too frequent for one group is split by
its next word, then by the one after.  Each group's suffixes meet in one task,
which sorts them into its part of the suffix tree; the totals of the leaves
below a node are the counts of its phrase.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rainloom.llm import common
from rainloom.operators.chunks import ordered_prefix
from rainloom.session import cut_lineage

#: Least occurrences of a phrase, percent of them inside a longer phrase that drops it, phrases reported per language.
LEAST, INSIDE, TOP = 10, 50, 2000
#: Suffixes that a group of prefixes holds (a group may reach three times that); 32 bytes each in a task.
BUDGET = 2_000_000
#: Bits of the prefix code that the first, second and third word take: 63 together.
BITS = (23, 20, 20)
#: Lanes in which a language's phrases are ranked before the best of all lanes are.
LANES = 64

_SEPARATES = np.isin(np.arange(256), list(b".,;:!?\x0a\x0b\x0c\x0d"))
_BLANK = np.isin(np.arange(256), list(b"\x20\x09"))
_LOWER = np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), np.arange(256) + 32, np.arange(256)).astype(np.uint8)


def numbers(seed: int, count: int) -> np.ndarray:
    """``count`` odd 64-bit numbers that look random and depend on the seed."""
    return common.mix(np.arange(1, count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


def words_of(texts: list[str], langs: list[str], seed: int) -> tuple[np.ndarray, np.ndarray, bytes, np.ndarray, np.ndarray, np.ndarray]:
    """Of all words of all texts: hash (with the language), row, lower-cased bytes and places, whether the next is in the same piece.

    Bytes are weighed by random numbers of their values and places, so that no two
    words are bound to meet under every seed.  No hash is 0.
    """
    blobs = [t.encode("utf-8", "surrogatepass") for t in texts]
    buffer = _LOWER[np.frombuffer(b"\n".join(blobs) + b"\n", np.uint8)]  # a line end separates texts
    parted = _SEPARATES[buffer]
    member = ~(parted | _BLANK[buffer])
    edge = np.flatnonzero(np.diff(member, prepend=False, append=False))
    starts, ends = edge[0::2], edge[1::2]
    if not len(starts):
        return np.empty(0, np.uint64), np.empty(0, np.int64), b"", starts, ends, np.empty(0, bool)
    row = np.searchsorted(np.cumsum([len(b) + 1 for b in blobs]), starts, side="right")
    lengths = ends - starts
    first = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum()), dtype=np.int32) - np.repeat(first.astype(np.int32), lengths)
    weigh = numbers(seed + 1, int(lengths.max()))
    sums = np.add.reduceat(numbers(seed, 256)[buffer[member]] * weigh[place], first)
    named = {x: i for i, x in enumerate(sorted(set(langs)))}
    salts = np.array([int.from_bytes(_digest(x, seed), "little") for x in named], np.uint64)
    own = salts[np.array([named[x] for x in langs], np.int64)]
    hashes = common.mix(common.mix(sums + lengths.astype(np.uint64)) ^ own[row])
    piece = np.cumsum(parted)[starts]
    follows = np.append(piece[1:] == piece[:-1], False)
    return np.where(hashes == 0, np.uint64(1), hashes), row, buffer.tobytes(), starts, ends, follows


def _digest(lang: str, seed: int) -> bytes:
    import hashlib

    return hashlib.blake2b(f"{seed}:{lang}".encode("utf-8", "surrogatepass"), digest_size=8).digest()


def prefix_code(h1: np.ndarray, h2: np.ndarray, h3: np.ndarray) -> np.ndarray:
    """63 bits: the leading bits of the three words' hashes, so that a longer prefix only narrows the range of a shorter one."""
    parts = [(h >> np.uint64(64 - b)).astype(np.int64) for h, b in zip((h1, h2, h3), BITS)]
    return parts[0] << (BITS[1] + BITS[2]) | parts[1] << BITS[2] | parts[2]


def suffixes(texts: list[str], langs: list[str], seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct suffixes of at least two words, truncated to three: three hashes (0 where none), prefix code, count; by code."""
    h, _, _, _, _, follows = words_of(texts, langs, seed)
    at = np.flatnonzero(follows)
    third = np.zeros(len(at), np.uint64)
    more = follows[at + 1] if len(at) else np.empty(0, bool)
    third[more] = h[at[more] + 2]
    a, b = h[at], h[at + 1] if len(at) else np.empty(0, np.uint64)
    code = prefix_code(a, b, third)
    order = np.argsort(code, kind="stable")
    a, b, third, code = a[order], b[order], third[order], code[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (third[1:] != third[:-1])
    first = np.flatnonzero(new)
    return a[first], b[first], third[first], code[first], np.diff(np.append(first, len(a)))


# ---------------------------------------------------------------- words and groups


def count_words(rows: DataFrame, seed: int) -> DataFrame:
    """(lang, word, h, c) of all words of ``rows`` (lang, text)."""
    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        langs = batch.column(0).to_pylist()
        h, row, data, starts, ends, _ = words_of(batch.column(1).to_pylist(), langs, seed)
        found, first, count = np.unique(h, return_index=True, return_counts=True)
        texts = [data[s:e].decode("utf-8", "surrogatepass") for s, e in zip(starts[first].tolist(), ends[first].tolist())]
        return pa.RecordBatch.from_arrays(
            [pa.array([langs[k] for k in row[first].tolist()], pa.string()), pa.array(texts, pa.string()), pa.array(found.view(np.int64)),
             pa.array(count, pa.int64())], ["lang", "word", "h", "c"])

    counted = common.in_slices(rows, work, "lang string, word string, h bigint, c bigint")
    return counted.groupBy("lang", "word", "h").agg(F.sum("c").alias("c"))


def _cuts(weights: DataFrame, parent: Column | None, budget: int) -> tuple[list[int], list[int]]:
    """Codes at which a new group begins, and codes that are too heavy for one; both fewer than weight / budget * 2."""
    keys = [] if parent is None else ["parent"]
    coded = weights if parent is None else weights.withColumn("parent", parent)
    placed = cut_lineage(ordered_prefix(coded, keys, ["code"], F.shiftright("code", 10), F.col("w")))
    begins = placed.groupBy(*keys, F.floor(F.col("before") / F.lit(budget)).alias("g")).agg(F.min("code").alias("code"))
    return ([r["code"] for r in begins.select("code").collect()],
            [r["code"] for r in placed.where(F.col("w") > budget).select("code").collect()])


def groups(rows: DataFrame, words: DataFrame, seed: int, budget: int) -> np.ndarray:
    """Sorted prefix codes at which a new group of at most about ``budget`` suffixes begins.

    Only prefixes over the budget are followed to their next word, which takes one more pass over the texts.
    """
    left = sum(BITS)
    level = words.groupBy(F.shiftrightunsigned("h", 64 - BITS[0]).alias("code")).agg(F.sum("c").alias("w"))
    found: set[int] = set()
    parent = None
    for bits, following in zip(BITS, (*BITS[1:], 0)):
        left -= bits
        cuts, heavy = _cuts(level, parent, budget)
        found |= {c << left for c in cuts}
        if not heavy or not following:
            break
        level = _below(rows, np.array(sorted(heavy), np.int64), left, following, seed)
        parent = F.shiftright("code", following)
    return np.array(sorted(found), np.int64)


def _below(rows: DataFrame, heavy: np.ndarray, left: int, bits: int, seed: int) -> DataFrame:
    """(code, w) of the prefixes that are one word longer than the heavy ones."""
    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        _, _, _, code, count = suffixes(batch.column(1).to_pylist(), batch.column(0).to_pylist(), seed)
        own = np.isin(code >> left, heavy)
        longer, at = np.unique(code[own] >> (left - bits), return_inverse=True)
        return pa.RecordBatch.from_arrays(
            [pa.array(longer), pa.array(np.bincount(at, count[own], len(longer)).astype(np.int64))], ["code", "w"])

    return common.in_slices(rows, work, "code bigint, w bigint").groupBy("code").agg(F.sum("w").alias("w"))


# ---------------------------------------------------------------- subtrees

#: A suffix in a packed run: three hashes and a count.
_PACKED = ((np.uint64, 8), (np.uint64, 8), (np.uint64, 8), (np.uint32, 4))


def packed(columns: Iterable[np.ndarray]) -> bytes:
    return zstandard.compress(b"".join(c.astype(t).tobytes() for c, (t, _) in zip(columns, _PACKED)), 1)


def unpacked(blob: bytes) -> list[np.ndarray]:
    data = zstandard.decompress(blob)
    count, out, at = len(data) // sum(n for _, n in _PACKED), [], 0
    for kind, size in _PACKED:
        out.append(np.frombuffer(data, kind, count, at))
        at += count * size
    return out


def dealt(rows: DataFrame, cuts: np.ndarray, seed: int) -> DataFrame:
    """(g, run): the suffixes of a stretch of text that belong to one group, merged and packed."""
    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        a, b, c, code, count = suffixes(batch.column(1).to_pylist(), batch.column(0).to_pylist(), seed)
        owner = np.searchsorted(cuts, code, side="right")
        first = np.flatnonzero(np.diff(owner, prepend=-1))
        runs = [packed((a[s:e], b[s:e], c[s:e], count[s:e])) for s, e in zip(first.tolist(), [*first[1:].tolist(), len(a)])]
        return pa.RecordBatch.from_arrays([pa.array(owner[first], pa.int32()), pa.array(runs, pa.binary())], ["g", "run"])

    return common.in_slices(rows, work, "g int, run binary")


def subtree(runs: list[bytes], cuts: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Phrases of a group's part of the tree with their counts: three hashes (the last 0 for two words) and the total.

    Phrases of fewer than ``least`` occurrences are left out unless their suffixes lie in several groups.
    """
    a, b, c, n = (np.concatenate(x) for x in zip(*map(unpacked, runs)))
    order = np.lexsort((c, b, a))
    a, b, c, n = a[order], b[order], c[order], n[order].astype(np.int64)
    inner = np.ones(len(a), bool)  # a node of two words begins
    inner[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    leaf = inner.copy()
    leaf[1:] |= c[1:] != c[:-1]
    leaves, nodes = np.flatnonzero(leaf), np.flatnonzero(inner)
    totals = np.add.reduceat(n, leaves)
    above = np.add.reduceat(totals, np.searchsorted(leaves, nodes))
    low = prefix_code(a[nodes], b[nodes], np.zeros(len(nodes), np.uint64))
    torn = np.searchsorted(cuts, low, side="right") != np.searchsorted(cuts, low | ((1 << BITS[2]) - 1), side="right")
    two = (above >= least) | torn
    three = (totals >= least) & (c[leaves] != 0)
    at = np.append(nodes[two], leaves[three])
    last = np.append(np.zeros(int(two.sum()), np.uint64), c[leaves[three]])
    return a[at], b[at], last, np.append(above[two], totals[three])


def frequent_phrases(rows: DataFrame, cuts: np.ndarray, seed: int, least: int) -> DataFrame:
    """(h1, h2, h3, a) of phrases of two (h3 = 0) and three words with at least ``least`` occurrences."""
    def build(table: pa.Table) -> pa.Table:
        return pa.table([x if i == 3 else x.view(np.int64) for i, x in enumerate(subtree(table["run"].to_pylist(), cuts, least))],
                        ["h1", "h2", "h3", "a"])

    found = dealt(rows, cuts, seed).groupBy("g").applyInArrow(build, "h1 bigint, h2 bigint, h3 bigint, a bigint")
    return found.groupBy("h1", "h2", "h3").agg(F.sum("a").alias("a")).where(F.col("a") >= least)


# ---------------------------------------------------------------- scores


def _score(part: str, rest: str) -> Column:
    """floor(1000000 a a / (part rest)) in whole numbers of 38 digits."""
    a, l, r = (f"cast({x} as decimal(19,0))" for x in ("a", part, rest))
    return F.expr(f"(cast(1000000 as decimal(7,0)) * {a} * {a}) div ({l} * {r})")


def scored(phrases: DataFrame, words: DataFrame, inside: int) -> DataFrame:
    """(lang, phrase, a, l, r, score) of all phrases but those that lie mostly within a longer one."""
    two = phrases.where("h3 = 0").select("h1", "h2", "a")
    three = phrases.where("h3 <> 0")
    within = three.select("h1", "h2", "a").unionByName(three.select(F.col("h2").alias("h1"), F.col("h3").alias("h2"), "a"))
    most = within.groupBy("h1", "h2").agg(F.max("a").alias("most"))
    left = two.join(most, ["h1", "h2"], "left").where(f"most is null or 100 * most < {inside} * a")
    none = F.lit(None).cast("bigint")
    pairs = left.select("h1", "h2", none.alias("h3"), "a", none.alias("f12"), none.alias("f23"))
    triples = three.join(two.withColumnRenamed("a", "f12"), ["h1", "h2"]) \
        .join(two.select(F.col("h1").alias("h2"), F.col("h2").alias("h3"), F.col("a").alias("f23")), ["h2", "h3"])
    found = pairs.unionByName(triples.select("h1", "h2", "h3", "a", "f12", "f23"))
    for k, how in ((1, "inner"), (2, "inner"), (3, "left")):
        own = words.select(F.col("h").alias(f"h{k}"), F.col("word").alias(f"w{k}"), F.col("c").alias(f"f{k}"),
                           *([F.col("lang")] if k == 1 else []))
        found = found.join(own, f"h{k}", how)
    found = found.withColumns({"s1": _score("f1", "coalesce(f23, f2)"), "s2": F.when(F.col("f12").isNotNull(), _score("f12", "f3"))})
    second = F.coalesce(F.col("s2") < F.col("s1"), F.lit(False))
    return found.select(
        "lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a", F.when(second, F.col("f12")).otherwise(F.col("f1")).alias("l"),
        F.when(second, F.col("f3")).otherwise(F.coalesce("f23", "f2")).alias("r"), F.when(second, F.col("s2")).otherwise(F.col("s1")).alias("score"))


def best(phrases: DataFrame, top: int) -> DataFrame:
    """Each language's first ``top``; lanes are ranked first, so that no task sorts a whole language."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    lane = F.pmod(F.xxhash64("phrase"), F.lit(LANES))
    some = phrases.withColumn("lane", lane).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "lane").orderBy(*order)))
    ranked = some.where(F.col("rank") <= top).withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    return ranked.where(F.col("rank") <= top).drop("lane").withColumn("rank", F.col("rank").cast("long"))


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, inside: int = INSIDE,
                 top: int | None = TOP, budget: int = BUDGET) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of the best phrases of two and three words per language; all, unranked, without ``top``.

    Null texts have no words; a null language is ``und``.  Every row counts, repeated ones as often as they stand.
    Ties of score go to the more frequent phrase, then to the smaller in byte order; ties between cuts to the first.
    Empty tables and texts shorter than a phrase give no rows.  Words are told apart by 64-bit hashes; should two of
    the corpus share one, the count is started again with other hashes.
    """
    rows = docs.select(F.coalesce(docs[lang].cast("string"), F.lit("und")).alias("lang"), common.text_or_empty(text).alias("text"))
    for seed in range(1, 9):
        words = cut_lineage(count_words(rows, seed))
        if not words.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").take(1):
            break
    else:
        raise ArithmeticError("two words share a hash under every seed")
    cuts = groups(rows, words, seed, budget)
    phrases = cut_lineage(frequent_phrases(rows, cuts, seed, least))
    found = scored(phrases, cut_lineage(words.where(F.col("c") >= least)), inside)
    sizes = words.groupBy("lang").agg(F.sum("c").alias("n"))
    if top is None:
        return found.join(sizes, "lang").select("lang", "phrase", "a", "l", "r", "n", "score")
    return best(found, top).join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(common.read(spark, sf_dir, "documents"))


#: The same in DuckDB.
SQL = f"""
WITH p AS (
  SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
    FROM documents)),
o AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM p),
f1 AS (SELECT lang, w[i] AS w1, count(*) AS c FROM o GROUP BY ALL),
f2 AS (SELECT lang, w[i] AS w1, w[i + 1] AS w2, count(*) AS c FROM o WHERE i < len(w) GROUP BY ALL HAVING count(*) >= {LEAST}),
f3 AS (SELECT lang, w[i] AS w1, w[i + 1] AS w2, w[i + 2] AS w3, count(*) AS c FROM o WHERE i + 1 < len(w) GROUP BY ALL HAVING count(*) >= {LEAST}),
n AS (SELECT lang, sum(c) AS n FROM f1 GROUP BY lang),
inner2 AS (SELECT lang, w1, w2, max(c) AS c FROM (SELECT lang, w1, w2, c FROM f3 UNION ALL SELECT lang, w2, w3, c FROM f3) GROUP BY ALL),
cuts AS (
  SELECT f2.lang, f2.w1 || ' ' || f2.w2 AS phrase, f2.c AS a, 1 AS k, x.c AS l, y.c AS r
  FROM f2 JOIN f1 x ON x.lang = f2.lang AND x.w1 = f2.w1 JOIN f1 y ON y.lang = f2.lang AND y.w1 = f2.w2
  LEFT JOIN inner2 z ON z.lang = f2.lang AND z.w1 = f2.w1 AND z.w2 = f2.w2 WHERE z.c IS NULL OR 100 * z.c < {INSIDE} * f2.c
  UNION ALL
  SELECT f3.lang, f3.w1 || ' ' || f3.w2 || ' ' || f3.w3, f3.c, 1, x.c, y.c
  FROM f3 JOIN f1 x ON x.lang = f3.lang AND x.w1 = f3.w1 JOIN f2 y ON y.lang = f3.lang AND y.w1 = f3.w2 AND y.w2 = f3.w3
  UNION ALL
  SELECT f3.lang, f3.w1 || ' ' || f3.w2 || ' ' || f3.w3, f3.c, 2, x.c, y.c
  FROM f3 JOIN f2 x ON x.lang = f3.lang AND x.w1 = f3.w1 AND x.w2 = f3.w2 JOIN f1 y ON y.lang = f3.lang AND y.w1 = f3.w3),
s AS (SELECT *, CAST((1000000::HUGEINT * a * a) // (l::HUGEINT * r) AS BIGINT) AS score FROM cuts),
one AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM one)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score FROM ranked JOIN n USING (lang) WHERE rank <= {TOP}
"""
