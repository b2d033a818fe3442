"""Line deduplication: lines that many documents hold stay in one of them only.

Lines are exploded with their places, normalised and hashed; distinct documents
are counted per hash; the lines of frequent hashes are dropped everywhere but in
the largest document; what stays is put together again by place.  Texts do not
travel with the lines: only hashes and places are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rainloom.llm import common
from rainloom.session import cut_lineage

#: Code points of the shortest key that counts, and distinct documents from which a key is dropped.
LEAST_CHARS, LEAST_DOCS = 40, 5
#: A key with more than one in HOT_KEYS of all droppable lines is looked up by broadcast; there are fewer than HOT_KEYS of them.
HOT_KEYS = 1000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line without ASCII white space at its ends, A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(" \t\n\x0b\x0c\r")), _UPPER, _LOWER)


def long_lines(rows: DataFrame, least_chars: int) -> DataFrame:
    """(d, v, place, h, g) of every line in ``parts`` whose key is long enough; ``h`` and ``g`` are 128 bits of its hash.

    A row without id is no document and gives no lines.
    """
    exploded = rows.where("d is not null").select("d", "v", F.posexplode("parts").alias("place", "line"))
    keyed = exploded.select("d", "v", "place", line_key(F.col("line")).alias("k")).where(F.length("k") >= least_chars)
    return keyed.select("d", "v", "place", F.xxhash64(F.lit(1), "k").alias("h"), F.xxhash64(F.lit(2), "k").alias("g"))


def frequent_keys(lines: DataFrame, least_docs: int) -> DataFrame:
    """(h, g, keep, m) of keys in at least ``least_docs`` documents: the largest document and the number of lines.

    Lines are first counted per key and document, which spreads a hot key over all tasks.
    """
    once = lines.groupBy("h", "g", "d").agg(F.count("*").alias("c"))
    counted = once.groupBy("h", "g").agg(F.count("*").alias("n"), F.max("d").alias("keep"), F.sum("c").alias("m"))
    return counted.where(F.col("n") >= least_docs).drop("n")


def dropped_places(lines: DataFrame, frequent: DataFrame) -> DataFrame:
    """(d, v, places): the lines that go from each document text, as an array of its places.

    Hot keys, fewer than ``HOT_KEYS``, are matched by broadcast and do not reach the shuffle of the others.
    """
    bound = frequent.agg(F.sum("m").alias("all")).select("all").scalar()
    hot = F.broadcast(frequent.where(F.col("m") * HOT_KEYS > bound).drop("m"))
    rest = frequent.where(F.col("m") * HOT_KEYS <= bound).drop("m")
    by = ["h", "g"]
    found = lines.join(hot, by).unionByName(lines.join(hot.drop("keep"), by, "left_anti").join(rest, by))
    return found.where("d <> keep").groupBy("d", "v").agg(F.collect_set("place").alias("places"))


def drop_repeated_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", least_chars: int = LEAST_CHARS,
                        least_docs: int = LEAST_DOCS, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per row of ``docs`` the ``keep`` columns, ``n_lines``, ``n_dropped`` and ``kept``, the text without dropped lines.

    A null or empty text is one empty line.  Documents are told apart by ``key``: rows that repeat an id are one
    document, whatever their texts, and each loses its own lines.  A row without id counts for no key and keeps all
    its lines.  A document whose lines all go has an empty ``kept`` (``n_dropped`` equals ``n_lines``).  Other columns
    are neither read nor clashed with.
    """
    hidden = [f"__{i}" for i in range(len(keep))]
    rows = docs.select(*(docs[c].alias(h) for c, h in zip(keep, hidden)), docs[key].alias("d"),
                       common.text_or_empty(text).alias("t"))
    rows = rows.select(*hidden, "d", F.xxhash64("t").alias("v"), F.split("t", "\n", -1).alias("parts"))
    lines = cut_lineage(long_lines(rows, least_chars))
    places = cut_lineage(dropped_places(lines, cut_lineage(frequent_keys(lines, least_docs))))
    joined = rows.join(places, ["d", "v"], "left")
    n_lines = F.size("parts")
    stay = F.array_except(F.sequence(F.lit(0), n_lines - 1), "places")
    kept = F.when(F.col("places").isNull(), F.array_join("parts", "\n")) \
        .otherwise(F.array_join(F.transform(stay, lambda i: F.get("parts", i)), "\n"))
    return joined.select(*(F.col(h).alias(c) for h, c in zip(hidden, keep)), n_lines.cast("long").alias("n_lines"),
                         F.when(F.col("places").isNull(), 0).otherwise(F.size("places")).cast("long").alias("n_dropped"), kept.alias("kept"))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = drop_repeated_lines(common.read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


_SPACE = " || ".join(["' '", *(f"chr({k})" for k in range(9, 14))])

#: The same in DuckDB.
SQL = f"""
WITH s AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents),
l AS (SELECT doc_id, i, s[i] AS line, translate(trim(s[i], {_SPACE}), '{_UPPER}', '{_LOWER}') AS k
      FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM s)),
f AS (SELECT k, max(doc_id) AS keep FROM l WHERE length(k) >= {LEAST_CHARS} GROUP BY k HAVING count(DISTINCT doc_id) >= {LEAST_DOCS})
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (f.k IS NOT NULL AND doc_id <> keep) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (f.k IS NULL OR doc_id = keep), '')) AS kept_sha256
FROM l LEFT JOIN f ON f.k = l.k GROUP BY doc_id
"""
