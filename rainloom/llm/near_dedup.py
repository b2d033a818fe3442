"""MinHash near-duplicates: one-permutation signatures, banded buckets, star-shaped candidates, links confirmed on full sets.

1. Every text becomes a set of shingles, a signature and one key per band.  Equal sets are one class.
2. Classes that share a band key form a bucket.  Each bucket proposes a star: its centre, the member that meets
   most others in all its buckets, against the rest.  Stars are confirmed on full sets and give components.
3. A star misses links between two members that are both unlike the centre.  Buckets whose other members lie in
   different components are therefore compared block against block; a pair is looked at in its first common
   band only, and inside a task, so that no list of pairs is written.  What remains possible by signature is
   confirmed on full sets, and gives the last links between components.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rainloom.llm import common, minhash
from rainloom.session import cut_lineage

BANDS = 40
#: Chance to overlook a link at the very threshold, over all bands.
MISSED = 1e-7
#: Pairs whose signatures agree less than the threshold by this many standard deviations are not confirmed.
DEVIATIONS = 6
#: Members and bytes of sets in one block of a bucket.
BLOCK_ROWS, BLOCK_SET_BYTES = 512, 8 << 20
#: Ids that are sent to all executors instead of shuffling the texts (32 MB).
BROADCAST_IDS = 2_000_000


def rows_per_band(percent: int, bands: int = BANDS) -> int:
    """The longest bands that overlook a link at the threshold with a chance of ``MISSED`` at most."""
    share, rows = percent / 100, 1
    while (1 - share ** (rows + 1)) ** bands <= MISSED:
        rows += 1
    return rows


def describe(docs: DataFrame, size: int, bins: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``id``, ``n`` (distinct shingles), ``digest``, ``keys`` and ``low`` (one byte a bin) of every row; no digest for empty sets."""
    def work(batch: pa.RecordBatch):
        texts = batch.column(1).to_pylist()
        for part in common.runs_of([len(t) for t in texts]):
            sets = minhash.shingle_sets(texts[part], size)
            full = [i for i, s in enumerate(sets) if len(s)]
            signature = minhash.signatures([sets[i] for i in full], bins)
            keys = minhash.band_keys(signature, BANDS)
            low = signature.astype(np.uint8)
            own = {i: k for k, i in enumerate(full)}
            yield pa.RecordBatch.from_arrays(
                [batch.column(0)[part], pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([_digest(s) if len(s) else None for s in sets], pa.binary()),
                 pa.array([keys[own[i]].tobytes() if i in own else None for i in range(len(sets))], pa.binary()),
                 pa.array([low[own[i]].tobytes() if i in own else None for i in range(len(sets))], pa.binary())],
                ["id", "n", "digest", "keys", "low"])

    rows = docs.select(docs[key].alias("id"), common.text_or_empty(text).alias("text"))
    return common.in_batches(rows, work, f"id {dict(rows.dtypes)['id']}, n bigint, digest binary, keys binary, low binary")


def _digest(own: np.ndarray) -> bytes:
    import hashlib

    return hashlib.blake2b(own.tobytes(), digest_size=16).digest()


def least_agreement(n: np.ndarray, percent: int, bins: int) -> np.ndarray:
    """How many bins must agree for a closer look; ``n`` is the smaller set's size, and fixes how many bins it fills itself."""
    share, filled = percent / 100, bins * -np.expm1(-np.maximum(n, 1) / bins)
    return (share - DEVIATIONS * np.sqrt(share * (1 - share) / filled)) * bins


def _bands(classes: DataFrame) -> DataFrame:
    """``id``, ``band``, ``key`` of every class, one row a band."""
    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int64)
        ids = batch.column(0).take(pa.array(np.repeat(np.arange(batch.num_rows), BANDS)))
        return pa.RecordBatch.from_arrays([ids, pa.array(np.tile(np.arange(BANDS, dtype=np.int32), batch.num_rows)), pa.array(keys)],
                                          ["id", "band", "key"])

    rows = classes.select("id", "keys")
    return common.in_batches(rows, work, f"id {dict(rows.dtypes)['id']}, band int, key bigint")


def components(links: DataFrame) -> DataFrame:
    """``id`` and ``component`` (least id that can be reached) of all ends of the links (a, b).

    Every round hooks each vertex to its least neighbour, jumps once along the hooks and contracts the graph to
    what is left, which at least halves the vertices that are not yet least among their neighbours.
    """
    links = cut_lineage(links.where("a is not null and b is not null and a <> b").select("a", "b").distinct())
    labels = links.select(F.col("a").alias("id")).union(links.select("b")).distinct().select("id", F.col("id").alias("component"))
    while links.take(1):
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = both.groupBy("a").agg(F.min("b").alias("b")).select("a", F.least("a", "b").alias("to"))
        hooks = cut_lineage(hooks)
        onward = hooks.select(F.col("a").alias("to"), F.col("to").alias("last"))
        hooks = cut_lineage(hooks.join(onward, "to", "left").select("a", F.coalesce("last", "to").alias("to")))
        labels = cut_lineage(labels.join(hooks, labels["component"] == hooks["a"], "left")
                             .select("id", F.coalesce("to", "component").alias("component")))
        left, right = hooks.select("a", F.col("to").alias("x")), hooks.select(F.col("a").alias("b"), F.col("to").alias("y"))
        links = cut_lineage(links.join(left, "a").join(right, "b").where("x <> y")
                            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    return labels


def _sets(docs: DataFrame, ids: DataFrame, classes: DataFrame, size: int, key: str, text: str) -> DataFrame:
    """``id`` and ``shingles`` (ascending hashes, 8 bytes each) of the named classes, from the texts of their least documents again."""
    named = cut_lineage(classes.join(ids.distinct().withColumnRenamed("id", "class"), "class").select("class", "digest", "doc"))
    rows = docs.select(docs[key].alias("doc"), common.text_or_empty(text).alias("text")) \
        .join(_by_size(named.select("doc").distinct()), "doc", "left_semi").select("text")

    def work(batch: pa.RecordBatch):
        texts = batch.column(0).to_pylist()
        for part in common.runs_of([len(t) for t in texts]):
            sets = minhash.shingle_sets(texts[part], size)
            yield pa.RecordBatch.from_arrays(
                [pa.array([_digest(s) if len(s) else None for s in sets], pa.binary()),
                 pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["digest", "shingles"])

    found = common.in_batches(rows, work, "digest binary, shingles array<bigint>")
    return cut_lineage(found.join(named.select("digest", F.col("class").alias("id")), "digest")
                       .dropDuplicates(["id"]).select("id", "shingles"))


def first_of_each(docs: DataFrame, found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` that are the least key of their component; of rows with one key one stays, without key all."""
    rest = _by_size(found.where(F.col(key) != F.col("component_id")).select(key).distinct())
    kept = docs.join(rest, key, "left_anti")
    twice = cut_lineage(docs.groupBy(key).count().where(f"count > 1 and {key} is not null").select(key))
    if twice.take(1):  # only their rows are shuffled
        twice = _by_size(twice)
        once = kept.join(twice, key, "left_semi").dropDuplicates([key])
        kept = kept.join(twice, key, "left_anti").unionByName(once)
    return kept.select(*docs.columns)


def _by_size(ids: DataFrame) -> DataFrame:
    """Ids as a written table, marked for broadcast if they are few enough; else the engine shuffles both sides."""
    ids = cut_lineage(ids)
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""
    left, right = (sets.select(F.col("id").alias(c), F.col("shingles").alias(s)) for c, s in (("a", "sa"), ("b", "sb")))
    both = F.size(F.array_intersect("sa", "sb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", both.alias("both"), (F.size("sa") + F.size("sb")).alias("sum")) \
        .where(100 * F.col("both") >= percent * (F.col("sum") - F.col("both"))).select("a", "b")


def _possible(table: pa.Table, percent: int, bins: int):
    """Row pairs of one block pair that need a closer look: different components, sizes and signatures alike, first common band."""
    block_i, block_j, band = (table.column(c)[0].as_py() for c in ("i", "j", "band"))
    block = table.column("block").to_numpy()
    component = table.column("component").to_numpy()
    n = table.column("n").to_numpy()
    keys = np.frombuffer(b"".join(table.column("keys").to_pylist()), np.int64).reshape(-1, BANDS)[:, :band]
    low = np.frombuffer(b"".join(table.column("low").to_pylist()), np.uint8).reshape(-1, bins)
    ours, theirs = np.flatnonzero(block == block_i), np.flatnonzero(block == block_j)
    for x in ours.tolist():
        other = theirs[theirs > x] if block_i == block_j else theirs
        other = other[component[other] != component[x]]
        other = other[100 * np.minimum(n[other], n[x]) >= percent * np.maximum(n[other], n[x])]
        other = other[(low[other] == low[x]).sum(axis=1) >= least_agreement(np.minimum(n[other], n[x]), percent, bins)]
        other = other[~(keys[other] == keys[x]).any(axis=1)]
        if len(other):
            yield x, other


def _in_block_pairs(members: DataFrame, set_bytes: bool) -> DataFrame:
    """Rows of each bucket dealt to pairs of its blocks: (key, i, j), ``block`` being the row's own."""
    weight = F.sum(F.col("n") * 8) if set_bytes else F.lit(0)
    blocks = members.groupBy("key").agg(F.greatest(
        F.ceil(F.count("*") / BLOCK_ROWS), F.ceil(weight / BLOCK_SET_BYTES)).cast("int").alias("blocks"))
    dealt = members.join(blocks, "key").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    return dealt.withColumn("t", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))) \
        .withColumn("i", F.least("block", "t")).withColumn("j", F.greatest("block", "t")).drop("t", "blocks") \
        .repartition("key", "i", "j")  # else all block pairs of a bucket stay where the join by key has put them


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row ``key``, ``n_shingles`` and ``component_id``: the least key that links of the given similarity reach.

    Words are separated by ASCII white space, A-Z lower-cased.  A text of fewer words than a shingle is one
    shingle; null, empty and blank texts have none and are linked with nothing, like rows without a key, whose
    component is null.  Rows of equal key are one document for the components, whatever their texts, and stay
    separate rows.  ``key`` must be of an integer type.
    """
    bins = BANDS * rows_per_band(percent)
    rows = cut_lineage(describe(docs, size, bins, key, text))
    # a class is a set of shingles; it has a number of its own, as its least document may belong to others too
    classes = rows.where("digest is not null and id is not null").groupBy("digest").agg(F.min("id").alias("doc"))
    classes = cut_lineage(classes.withColumn("class", F.monotonically_increasing_id()))
    told = cut_lineage(rows.join(classes.withColumnRenamed("doc", "id"), ["id", "digest"]).dropDuplicates(["class"])
                       .select(F.col("class").alias("id"), "n", "keys", "low"))
    own = _of_repeated_ids(rows, classes)

    bands = cut_lineage(_bands(told))
    shared = bands.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    members = cut_lineage(bands.join(shared, "key"))
    weight = members.groupBy("id").agg(F.sum("size").alias("weight"))
    centres = cut_lineage(members.join(weight, "id").groupBy("key").agg(
        F.max(F.struct("weight", (-F.col("id")).alias("minus"))).alias("top"))
        .select("key", (-F.col("top.minus")).alias("centre")))
    starred = members.join(centres, "key").where("id <> centre")
    stars = starred.select(
        F.least("id", "centre").alias("a"), F.greatest("id", "centre").alias("b")).distinct()
    sides = [told.select(F.col("id").alias(c), F.col("n").alias(f"n{c}"), F.col("low").alias(f"low{c}")) for c in "ab"]
    stars = stars.join(sides[0], "a").join(sides[1], "b") \
        .where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    stars = cut_lineage(_alike(stars, percent, bins))
    sets = _sets(docs, stars.select(F.col("a").alias("id")).union(stars.select("b")), classes, size, key, text)
    first = components(_confirm(stars, sets, percent).unionByName(own.select("a", "b")))

    # what stars can't see: members other than the centre in different components
    placed = starred.drop("centre", "size") \
        .join(first, "id", "left").withColumn("component", F.coalesce("component", "id"))
    mixed = placed.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("key")
    placed = cut_lineage(placed.join(mixed, "key").join(told, "id"))

    def flag(table: pa.Table) -> pa.Table:
        wanted = set()
        for x, other in _possible(table, percent, bins):
            wanted.update([x, *other.tolist()])
        taken = table.take(pa.array(sorted(wanted), pa.int64()))
        return pa.table([taken.column("key"), taken.column("id")], names=["key", "id"])

    id_type = dict(placed.dtypes)["id"]
    flagged = cut_lineage(_in_block_pairs(placed, False).groupBy("key", "i", "j").applyInArrow(
        flag, f"key bigint, id {id_type}").distinct())
    more = _sets(docs, flagged.select("id"), classes, size, key, text)

    def confirm(table: pa.Table) -> pa.Table:
        component = table.column("component").to_pylist()
        column = table.column("shingles").combine_chunks()
        joined = {c: c for c in component}
        out = []

        def root(c):
            while joined[c] != c:
                joined[c] = joined[joined[c]]
                c = joined[c]
            return c

        sets_ = {}

        def own(i):
            if i not in sets_:
                sets_[i] = column[i].values.to_numpy()
            return sets_[i]

        for x, others in _possible(table, percent, bins):
            for y in others.tolist():
                a, b = root(component[x]), root(component[y])
                if a != b:
                    both = len(np.intersect1d(own(x), own(y), assume_unique=True))
                    if 100 * both >= percent * (len(own(x)) + len(own(y)) - both):
                        joined[max(a, b)] = min(a, b)
                        out.append((component[x], component[y]))
        return pa.table([pa.array([a for a, _ in out], table.schema.field("component").type),
                         pa.array([b for _, b in out], table.schema.field("component").type)], names=["a", "b"])

    looked_at = placed.join(flagged, ["key", "id"], "left_semi").join(more, "id")
    links = _in_block_pairs(looked_at, True).groupBy("key", "i", "j").applyInArrow(confirm, f"a {id_type}, b {id_type}")
    last = components(links).select(F.col("id").alias("component"), F.col("component").alias("final"))
    final = first.join(last, "component", "left").select("id", F.coalesce("final", "component").alias("component"))
    alone = last.where("component <> final").join(first.select("id"), last["component"] == F.col("id"), "left_anti") \
        .select(F.col("component").alias("id"), F.col("final").alias("component"))
    labels = cut_lineage(final.union(alone).select(F.col("id").alias("class"), "component"))

    # a component is named after its least document; all classes of one document are in the same one
    placed_classes = classes.join(labels, "class", "left").select("digest", "class", "doc", F.coalesce("component", "class").alias("component"))
    names = placed_classes.groupBy("component").agg(F.min("doc").alias("component_id"))
    told_class = cut_lineage(placed_classes.join(names, "component").select("digest", "class", "component_id"))
    of_twice = own.join(told_class.select(F.col("class").alias("a"), F.col("component_id").alias("of_id")), "a").select("id", "of_id").distinct()
    found = rows.select("id", F.col("n").alias("n_shingles"), "digest").join(told_class.drop("class"), "digest", "left") \
        .join(_by_size(of_twice), "id", "left")
    return found.select(F.col("id").alias(key), "n_shingles", F.when(
        F.col("id").isNotNull(), F.coalesce("component_id", "of_id", "id")).alias("component_id"))


def _of_repeated_ids(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """(id, a, b) of every id that stands in several rows: its least class, and each of its classes."""
    twice = cut_lineage(rows.where("id is not null").groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id"))
    those = rows.where("digest is not null").join(_by_size(twice), "id", "left_semi").select("id", "digest").distinct()
    numbered = cut_lineage(those.join(classes.select("digest", "class"), "digest").select("id", "class"))
    least = numbered.groupBy("id").agg(F.min("class").alias("a"))
    return cut_lineage(numbered.join(least, "id").select("id", "a", F.col("class").alias("b")))


def _alike(pairs: DataFrame, percent: int, bins: int) -> DataFrame:
    """Pairs whose signatures agree almost as much as the threshold asks."""
    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        low = [np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, bins) for c in (2, 3)]
        kept = pa.array((low[0] == low[1]).sum(axis=1) >= least_agreement(batch.column(4).to_numpy(), percent, bins))
        return batch.filter(kept).select(["a", "b"])

    rows = pairs.select("a", "b", "lowa", "lowb", F.least("na", "nb").alias("n"))
    kind = dict(rows.dtypes)["a"]
    return common.in_batches(rows, work, f"a {kind}, b {kind}")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(common.read(spark, sf_dir, "documents"), size=3, percent=85)
    return found.withColumn("kept", F.col("doc_id") == F.col("component_id"))


#: The same in DuckDB: all pairs of sets by an inverted index, and reachability by least labels.
SQL = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[ \x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM t WHERE len(w) > 0)
), c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN c ca ON ca.doc_id = a JOIN c cb ON cb.doc_id = b WHERE 100 * k >= 85 * (ca.n + cb.n - k)),
r AS (SELECT doc_id AS a, doc_id AS b FROM t UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
m AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT t.doc_id, coalesce(c.n, 0)::BIGINT AS n_shingles, m.component_id, t.doc_id = m.component_id AS kept
FROM t JOIN m ON m.doc_id = t.doc_id LEFT JOIN c ON c.doc_id = t.doc_id
"""
