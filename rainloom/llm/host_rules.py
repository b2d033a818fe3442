"""Quality rules judged per host: failures are counted by host and their rates shrunk towards a common prior.

DataFrame functions only.  A document fails on its own numbers; a host's
failure rate is pulled towards all hosts' rates by a beta prior whose mean and
weight come from the hosts themselves (method of moments); documents of hosts
whose shrunk rate is too high are dropped with it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rainloom.llm import common

#: A document fails below this many words, or above this percentage of words in repeated three-word windows.
LEAST_WORDS, REPEATED_PERCENT = 50, 50
#: A host fails if its shrunk rate exceeds this; other rules that count as failures of a document for its host.
HOST_RATE = 0.5
SYMBOLS_PERCENT, DUP_LINES_PERCENT = 10, 30
#: With at most this many different repeated windows they are looked up one by one, else positions are sorted.
FEW = 16

_SPACES = " \t\n\x0b\x0c\r"


def words(text: Column) -> Column:
    return F.filter(F.split(text, "[ \\t-\\r]+"), lambda w: w != "")


def _covered(positions: Column) -> Column:
    """How many of the words lie in three-word windows that start at the (sorted) positions."""
    n = F.size(positions)
    steps = F.zip_with(F.slice(positions, 2, F.greatest(n - 1, F.lit(0))), F.slice(positions, 1, F.greatest(n - 1, F.lit(0))),
                       lambda b, a: F.least(b - a, F.lit(3)))
    return F.when(n == 0, F.lit(0)).otherwise(F.aggregate(steps, F.lit(3), lambda s, x: s + x)).cast("long")


def measures(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """``key``, ``host`` and the numbers of every whole text; a null text has no words.

    Windows are compared by 64-bit hashes.  Each step is a column of its own projection, so that the arrays
    are built once.
    """
    value = common.text_or_empty(text)
    base = docs.select(
        docs[key].alias("key"), docs[host].cast("string").alias("host"), words(value).alias("words"),
        F.char_length(F.translate(value, _SPACES, "")).cast("long").alias("word_chars"),
        (F.char_length(value) - F.char_length(F.translate(value, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        F.filter(F.split(value, "\n"), lambda x: F.translate(x, _SPACES, "") != "").alias("lines"))
    hashed = base.select(
        "key", "host", "word_chars", "n_symbols", F.size("words").cast("long").alias("n_words"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("words") >= 3, F.zip_with(
            F.zip_with(F.slice("words", 1, F.size("words") - 2), F.slice("words", 2, F.size("words") - 2), lambda a, b: F.xxhash64(a, b)),
            F.slice("words", 3, F.size("words") - 2), lambda h, c: F.xxhash64(h, c))).otherwise(F.array().cast("array<bigint>")).alias("windows"))
    repeated = hashed.withColumn("again", F.when(
        F.size(F.array_distinct("windows")) < F.size("windows"), _repeated("windows")).otherwise(F.array().cast("array<bigint>")))
    by_lookup = F.filter(
        F.transform("windows", lambda w, i: F.when(F.array_contains("again", w), i)), lambda i: i.isNotNull())
    ordered = F.array_sort(F.transform("windows", lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
    by_sort = repeated.withColumn("ordered", F.when(F.size("again") > FEW, ordered)).withColumn(
        "at", F.when(F.size("again") == 0, F.array().cast("array<int>"))
        .when(F.size("again") <= FEW, by_lookup)
        .otherwise(F.array_sort(F.transform(_with_equal_neighbour("ordered"), lambda x: x.i))))
    return by_sort.select(
        "key", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", _covered(F.col("at")).alias("n_repeat_words")) \
        .withColumnRenamed("key", key)


def _repeated(windows: str) -> Column:
    """Different values that occur more than once."""
    ordered = F.sort_array(windows)
    n = F.size(windows)
    same = F.zip_with(F.slice(ordered, 1, n - 1), F.slice(ordered, 2, n - 1), lambda a, b: F.when(a == b, a))
    return F.array_distinct(F.filter(same, lambda x: x.isNotNull()))


def _with_equal_neighbour(ordered: str) -> Column:
    """Entries of an array sorted by ``w`` whose ``w`` occurs before or after them."""
    n = F.size(ordered)
    none = F.array(F.lit(None).cast("struct<w:bigint,i:int>"))
    before = F.concat(none, F.slice(ordered, 1, n - 1))
    after = F.concat(F.slice(ordered, 2, n - 1), none)
    return F.transform(F.filter(
        F.arrays_zip(F.col(ordered).alias("x"), before.alias("b"), after.alias("a")),
        lambda t: F.coalesce(t.x.w == t.b.w, F.lit(False)) | F.coalesce(t.x.w == t.a.w, F.lit(False))), lambda t: t.x)


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEATED_PERCENT * F.col("n_words"))


def failed() -> Column:
    """A document's failure as its host's record counts it: base rules, too many symbols, too many repeated lines."""
    return base_failed() | (100 * F.col("n_symbols") > SYMBOLS_PERCENT * F.col("word_chars")) \
        | (100 * F.col("n_dup_lines") > DUP_LINES_PERCENT * F.col("n_words"))


def host_verdicts(measured: DataFrame) -> DataFrame:
    """``host``, ``n``, ``fails``, ``shrunk`` and ``host_failed``; null is a host of its own.

    The prior's mean m is the mean of the hosts' rates and its weight w = m(1 - m) / v - 1, v being the part of the
    rates' variance that counting does not explain.  Without such a part (v <= 0), or with one host, w is as
    many documents as there are: every host gets the common rate.
    """
    hosts = measured.groupBy("host").agg(F.count("*").alias("n"), F.sum(failed().cast("long")).alias("fails"))
    rate = F.col("fails") / F.col("n")
    moments = hosts.agg(
        F.count("*").alias("k"), F.sum("n").alias("total"), F.avg(rate).alias("m"), F.var_samp(rate).alias("var"),
        F.avg(1 / F.col("n")).alias("per"))
    spread = F.col("m") * (1 - F.col("m"))
    excess = F.col("var") - spread * F.col("per")
    prior = moments.select("m", F.when((F.col("k") > 1) & (excess > 0) & (spread > 0), F.greatest(spread / excess - 1, F.lit(0.0)))
                           .otherwise(F.col("total").cast("double")).alias("w"))
    m, w = prior.select("m").scalar(), prior.select("w").scalar()  # an aggregate without keys: one row
    shrunk = (F.col("fails") + m * w) / (F.col("n") + w)
    return hosts.select("host", "n", "fails", shrunk.alias("shrunk")).withColumn("host_failed", F.col("shrunk") > HOST_RATE)


def judge(measured: DataFrame) -> DataFrame:
    """Measured rows with ``base_failed`` and ``kept``: neither the document nor its host failed.

    The verdicts are joined by a null-safe key; a hot host is split by the engine's skew handling, as the host
    side has one row per host.
    """
    verdicts = host_verdicts(measured).select(F.col("host").alias("__host"), "host_failed")
    joined = measured.join(verdicts, measured["host"].eqNullSafe(verdicts["__host"]), "left")
    return joined.drop("__host").withColumn("base_failed", base_failed()) \
        .withColumn("kept", ~F.col("base_failed") & ~F.col("host_failed")).drop("host_failed")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rainloom.session import cut_lineage

    measured = cut_lineage(measures(common.read(spark, sf_dir, "documents")))
    return judge(measured).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


#: The same in DuckDB.
SQL = f"""
WITH base AS (
  SELECT doc_id, source AS host, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\x09-\\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ \\x09-\\x0D]')) AS l
  FROM documents
), places AS (
  SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM base WHERE len(w) >= 3
), wins AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM places
), again AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM wins) WHERE c >= 2
), hit AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM again) GROUP BY doc_id
), m AS (
  SELECT base.doc_id, host, len(w)::BIGINT AS n_words,
         length(regexp_replace(t, '[ \\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(hit.n, 0)::BIGINT AS n_repeat_words
  FROM base LEFT JOIN hit ON hit.doc_id = base.doc_id
), f AS (
  SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {REPEATED_PERCENT} * n_words AS base_failed FROM m
), h AS (
  SELECT host, count(*) AS n, sum((base_failed OR 100 * n_symbols > {SYMBOLS_PERCENT} * word_chars
         OR 100 * n_dup_lines > {DUP_LINES_PERCENT} * n_words)::INT) AS fails FROM f GROUP BY host
), mo AS (
  SELECT count(*) AS k, sum(n) AS total, avg(fails / n) AS m, var_samp(fails / n) AS v, avg(1 / n) AS per FROM h
), p AS (
  SELECT m, CASE WHEN k > 1 AND v - m * (1 - m) * per > 0 AND m * (1 - m) > 0
                 THEN greatest(m * (1 - m) / (v - m * (1 - m) * per) - 1, 0) ELSE total END AS w FROM mo
), verdict AS (
  SELECT host, (fails + m * w) / (n + w) > {HOST_RATE} AS host_failed FROM h, p
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT host_failed AS kept
FROM f JOIN verdict ON f.host IS NOT DISTINCT FROM verdict.host
"""
