"""Benchmark decontamination with suffix arrays of the training text.

The training words of a shard (a bounded run of documents) become a suffix
array, ordered by as many words as a window has.  Every suffix of the benchmark
items is looked up in it by binary search; the matches are extended to their
longest, and give their places in the documents, the words hit and the items
found.  Benchmark items are read in blocks of bounded size, one at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rainloom.llm import common
from rainloom.session import cut_lineage

#: Words of a window; a document is contaminated if at least 1 in ONE_IN of its words is hit.
WINDOW, ONE_IN = 13, 20
#: Bytes of benchmark text that one pass over the documents looks for.
BLOCK_BYTES = 4 << 20
#: Pairs of a place and a benchmark suffix that are looked at together.
PAIRS = 1 << 20
#: Word numbers that share one sort key, and bits of each.
PACKED, BITS = 3, 21


class Tests:
    """All suffixes of a block of benchmark items, as sorted distinct windows over the block's own word numbers."""

    def __init__(self, items: list[tuple[object, str]]):
        hashes, upto = common.word_hashes([t for _, t in items], "alnum")
        self.vocabulary = np.unique(hashes)
        self.names = [name for name, _ in items]
        number = np.searchsorted(self.vocabulary, hashes).astype(np.int64) + 1
        lengths = np.diff(upto)
        #: Word numbers of all items, a 0 after each.
        self.words = np.zeros(len(number) + len(items) + WINDOW, np.int64)
        self.words[np.arange(len(number)) + np.repeat(np.arange(len(items)), lengths)] = number
        first = upto[:-1] + np.arange(len(items))
        windows = np.where(lengths > 0, np.maximum(lengths - WINDOW + 1, 1), 0)
        self.item = np.repeat(np.arange(len(items)), windows)
        inner = np.arange(int(windows.sum())) - np.repeat(np.cumsum(windows) - windows, windows)
        self.place = inner
        self.start = first[self.item] + inner
        self.length = np.minimum(lengths[self.item], WINDOW)
        keys = pack(self.words, self.start, self.length, 0)
        order = np.lexsort((self.length, *keys[::-1]))
        same = np.ones(len(order), bool)
        if len(order):
            same[0] = False
            for column in (*keys, self.length):
                same[1:] &= column[order][1:] == column[order][:-1]
        #: Of each distinct window one suffix; the suffixes that begin with it, in the order of ``order``.
        self.order, self.distinct = order, order[~same]
        self.group = np.append(np.flatnonzero(~same), len(order))
        self.low = [k[self.distinct] for k in keys]
        self.high = [k[self.distinct] for k in pack(self.words, self.start, self.length, (1 << BITS) - 1)]
        self.shortest = int(self.length.min()) if len(self.length) else WINDOW


def pack(words: np.ndarray, start: np.ndarray, length: np.ndarray, filler: int) -> list[np.ndarray]:
    """Sort keys of the ``length`` words from each start, ``filler`` beyond them."""
    keys = []
    for k in range(0, WINDOW, PACKED):
        key = np.zeros(len(start), np.int64)
        for j in range(k, min(k + PACKED, WINDOW)):
            at = np.minimum(start + j, len(words) - 1)
            key = key << BITS | np.where(j < length, words[at], filler)
        keys.append(key)
    return keys


def first_beyond(suffixes: list[np.ndarray], keys: list[np.ndarray], equal_goes_left: bool) -> np.ndarray:
    """Binary search of all keys at once in the sorted suffixes: the first suffix that is larger (or equal)."""
    low = np.zeros(len(keys[0]), np.int64)
    high = np.full(len(keys[0]), len(suffixes[0]), np.int64)
    open_ = np.flatnonzero(low < high)
    while len(open_):
        middle = (low[open_] + high[open_]) >> 1
        less = np.zeros(len(open_), bool)  # suffix before key
        tied = np.ones(len(open_), bool)
        for s, k in zip(suffixes, keys):
            a, b = s[middle], k[open_]
            less |= tied & (a < b)
            tied &= a == b
        right = less | (tied & equal_goes_left)
        low[open_[right]] = middle[right] + 1
        high[open_[~right]] = middle[~right]
        open_ = open_[low[open_] < high[open_]]
    return low


def spread(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owner and value of all whole numbers in the ranges."""
    sizes = high - low
    owner = np.repeat(np.arange(len(low)), sizes)
    return owner, np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes) + low[owner]


def shard_matches(texts: list[str], tests: Tests) -> tuple[list, list, list, list]:
    """Per text: number of words, hit word ranges, items found, longest matches (place, words, item, place in item)."""
    hashes, upto = common.word_hashes(texts, "alnum")
    counts = np.diff(upto)
    number = np.searchsorted(tests.vocabulary, hashes) if len(tests.vocabulary) else np.zeros(len(hashes), np.int64)
    if len(tests.vocabulary):
        found = tests.vocabulary[np.minimum(number, len(tests.vocabulary) - 1)] == hashes
        number = np.where(found, number + 1, 0).astype(np.int64)
    first = upto[:-1] + np.arange(len(texts))
    words = np.zeros(len(hashes) + len(texts) + WINDOW, np.int64)  # a 0 after each text
    words[np.arange(len(hashes)) + np.repeat(np.arange(len(texts)), counts)] = number
    stops = np.flatnonzero(words == 0)
    places = np.flatnonzero(words)
    run = stops[np.searchsorted(stops, places)] - places  # known words from each place on
    places, run = places[run >= tests.shortest], run[run >= tests.shortest]
    none = [[] for _ in texts]
    if not len(places) or not len(tests.distinct):
        return counts.tolist(), none, none, none
    keys = pack(words, places, np.minimum(run, WINDOW), 0)
    array = np.lexsort(keys[::-1])  # the suffix array, by the first WINDOW words
    places, keys = places[array], [k[array] for k in keys]
    low, high = first_beyond(keys, tests.low, False), first_beyond(keys, tests.high, True)
    window, at = spread(low, high)
    if not len(window):
        return counts.tolist(), none, none, none
    place = places[at]
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, place, 1)
    np.add.at(edge, place + tests.length[tests.distinct[window]], -1)
    hit = np.flatnonzero(np.diff((np.cumsum(edge) > 0).astype(np.int8), prepend=0))
    ranges: list[list] = [[] for _ in texts]
    owner = np.searchsorted(first, hit[0::2], side="right") - 1
    for doc, s, e in zip(owner.tolist(), (hit[0::2] - first[owner]).tolist(), (hit[1::2] - first[owner]).tolist()):
        ranges[doc].append({"s": s, "e": e})
    doc = np.searchsorted(first, place, side="right") - 1
    pairs = np.unique(doc * len(tests.distinct) + window)
    items: list[set] = [set() for _ in texts]
    for d, w in zip((pairs // len(tests.distinct)).tolist(), (pairs % len(tests.distinct)).tolist()):
        items[d].update(tests.item[tests.order[tests.group[w]:tests.group[w + 1]]].tolist())
    names = [[tests.names[i] for i in sorted(own)] for own in items]
    return counts.tolist(), ranges, names, _longest(words, place, window, tests, first, len(texts))


def _longest(words, place, window, tests, first, n_texts) -> list[list[dict]]:
    """Matches of maximal length that are the longest at one of their places at least, by place.

    A match is taken up where it begins, that is where the words before differ, and extended to its end.  One that lies
    inside another is the longest nowhere and left out; of equal ones the suffix of the earliest item stays.
    """
    spots, suffixes = [], []
    for part in common.runs_of((tests.group[window + 1] - tests.group[window]).tolist(), PAIRS):
        owner, at = spread(tests.group[window[part]], tests.group[window[part] + 1])
        suffix, spot = tests.order[at], place[part][owner]
        begins = (words[spot - 1] != tests.words[tests.start[suffix] - 1]) | (words[spot - 1] == 0)  # ends in a 0 before the first
        spots.append(spot[begins])
        suffixes.append(suffix[begins])
    place, suffix = np.concatenate(spots), np.concatenate(suffixes)
    length = tests.length[suffix].copy()
    going = np.arange(len(suffix))
    while len(going):
        a, b = place[going] + length[going], tests.start[suffix[going]] + length[going]
        inside = (a < len(words)) & (b < len(tests.words))
        going, a, b = going[inside], a[inside], b[inside]
        going = going[(words[a] == tests.words[b]) & (words[a] > 0)]
        length[going] += 1
    best = np.lexsort((suffix, -length, place))
    ends = (place + length)[best]
    best = best[np.append(True, ends[1:] > np.maximum.accumulate(ends)[:-1])] if len(best) else best
    out: list[list[dict]] = [[] for _ in range(n_texts)]
    doc = np.searchsorted(first, place[best], side="right") - 1
    for d, p, n, s in zip(doc.tolist(), (place[best] - first[doc]).tolist(), length[best].tolist(), suffix[best].tolist()):
        out[d].append({"place": p, "words": n, "item": tests.names[tests.item[s]], "item_place": int(tests.place[s])})
    return out


def _blocks(benchmark: DataFrame | None, item: str, text: str) -> tuple[int, Iterator[list[tuple[str, str]]]]:
    """Number of blocks, and distinct benchmark items with words, a block of about ``BLOCK_BYTES`` at a time; ids as strings."""
    if benchmark is None:
        return 1, iter([[]])
    rows = benchmark.select(benchmark[item].cast("string").alias("item"), benchmark[text].cast("string").alias("text")) \
        .where("item is not null and text is not null").distinct()
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = size // BLOCK_BYTES + 1
    if blocks > 1:
        rows = cut_lineage(rows.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(blocks))))

    def read(block: int) -> list[tuple[str, str]]:
        own = rows.where(F.col("block") == block).drop("block") if blocks > 1 else rows
        return [(r["item"], r["text"]) for r in own.orderBy("item", "text").collect()]

    return blocks, map(read, range(blocks))


#: The suffixes of the block that this worker process has looked up last, by the name of the look-up.
_held: dict[str, Tests] = {}


def _held_tests(name: str, items) -> Tests:
    if name not in _held:
        _held.clear()
        _held[name] = Tests(items.value)
    return _held[name]


def _look_up(rows: DataFrame, shared, keep: list[str]) -> DataFrame:
    """``keep`` columns of every row with ``n_words``, ``hit``, ``items`` and ``matches`` against one block, which is broadcast."""
    from pyspark.sql.types import StructType, _parse_datatype_string

    name = uuid.uuid4().hex
    span = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))
    match = pa.list_(pa.struct([("place", pa.int64()), ("words", pa.int64()), ("item", pa.string()), ("item_place", pa.int64())]))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, hit, names, longest = shard_matches(batch.column(len(keep)).to_pylist(), _held_tests(name, shared))
        return pa.RecordBatch.from_arrays(
            [*(batch.column(i) for i in range(len(keep))), pa.array(counts, pa.int64()), pa.array(hit, span),
             pa.array(names, pa.list_(pa.string())), pa.array(longest, match)], [*keep, "n_words", "hit", "items", "matches"])

    more = _parse_datatype_string(
        "n_words bigint, hit array<struct<s:bigint,e:bigint>>, items array<string>, "
        "matches array<struct<place:bigint,words:bigint,item:string,item_place:bigint>>")
    return common.in_slices(rows, work, StructType([rows.schema[c] for c in keep] + list(more)))


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id",
                  item_text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per row of ``docs`` the ``keep`` columns, ``n_words``, ``n_hit``, ``items`` (sorted strings), ``matches``, ``contaminated``.

    ``matches`` lists the verbatim matches of each block of the benchmark that cannot be extended and lie in no other one.

    Null texts have no words; items without id, text or words, and an empty benchmark, match nothing; an item
    shorter than a window matches as a whole; repeated items count once.  Rows with equal keys stay separate.
    """
    spark = docs.sparkSession
    hidden = [f"__{i}" for i in range(len(keep))]
    rows = docs.select(*(docs[c].alias(h) for c, h in zip(keep, hidden)), common.text_or_empty(text).alias("__text"))
    number, blocks = _blocks(benchmark, item, item_text)
    if number == 1:
        found = _look_up(rows, spark.sparkContext.broadcast(next(blocks)), hidden)
    else:  # a pass a block, each written before the next is read; the rows are numbered once so that their parts meet again
        numbered = cut_lineage(rows.withColumn("__row", F.monotonically_increasing_id()).select(*hidden, "__row", "__text"))
        parts = []
        for items in blocks:
            shared = spark.sparkContext.broadcast(items)
            part = _look_up(numbered.select("__row", "__text"), shared, ["__row"])
            parts.append(cut_lineage(part if not parts else part.where(F.size("items") > 0)))
            shared.destroy()
        told = reduce(DataFrame.unionByName, parts).groupBy("__row").agg(
            F.max("n_words").alias("n_words"), *(F.flatten(F.collect_list(c)).alias(c) for c in ("hit", "items", "matches")))
        found = numbered.drop("__text").join(told, "__row")
    n_hit = F.aggregate(
        F.array_sort("hit"), F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("upto")),
        lambda a, x: F.struct((a.n + F.greatest(x.e - F.greatest(x.s, a.upto), F.lit(0).cast("bigint"))).alias("n"),
                              F.greatest(a.upto, x.e).alias("upto")), lambda a: a.n)
    out = found.select(
        *(F.col(h).alias(c) for h, c in zip(hidden, keep)), "n_words", n_hit.alias("n_hit"),
        F.array_sort(F.array_distinct("items")).alias("items"), "matches")
    return out.withColumn("contaminated", is_contaminated(F.col("n_hit"), F.col("n_words")))


def is_contaminated(n_hit: Column, n_words: Column) -> Column:
    return (n_hit > 0) & (ONE_IN * n_hit >= n_words)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


_WORDS = ("regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
          "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')")

#: The same in DuckDB.
SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item, least({WINDOW}, len(w)) AS n, array_to_string(w[i:i + {WINDOW} - 1], ' ') AS g
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - {WINDOW} + 1, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), dw AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d JOIN (SELECT DISTINCT n FROM bw) s ON len(w) >= s.n)
), hits AS (SELECT doc_id, i, dw.n, item FROM dw JOIN bw ON dw.g = bw.g AND dw.n = bw.n),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
s AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS names FROM hits GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND {ONE_IN} * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h ON h.doc_id = d.doc_id LEFT JOIN s ON s.doc_id = d.doc_id
"""
