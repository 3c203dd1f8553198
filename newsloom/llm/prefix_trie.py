"""A weighted prefix trie of conversations by collapsing whole sequences.

A turn is known by a 128-bit digest and the bytes of its text, a prefix by its length and two 64-bit numbers, each the
exact sum of a hash of (place, digest); so a prefix needs no text and no chain of hashes, and its number follows from a
running sum that is taken per slice of a conversation and shifted.

1. Conversations with equal whole sequences become one weighted sequence; its conversations are its end list.
2. Sequences that are proper prefixes of others (anti-join) end at inner nodes; the rest are the leaves.
3. Prefixes of the distinct sequences are summed with their weights: members, smallest member, leaves.
4. A node belongs to the smallest leaf below it, so a leaf owns the nodes from some depth to its end. Bytes of distinct
   nodes below a node are therefore a sum over its leaves, as are bytes of all members, and neither walks the trie.

Defined cases: a null role or text is empty; null turns come first, equal turns go by role, then text; repeated rows are
turns of their own; c % 5 has the sign of c; rows with a null conv_id belong to no conversation and take no part; a conversation without turns is a
member of the root; an empty table has no node, not even the root; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm.runtime import Scratch, ship

SLICE = 512
IDS_PER_PART = 4096
KEY = ["depth", "k1", "k2"]


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, place from 0, digest, bytes) of the turns of (conv_id, turn, role, text), in order."""
    from newsloom.operators.grouping import sliced_row_number  # on the driver only; workers have this package alone

    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"))
    part = F.coalesce(F.floor(F.col("turn") / SLICE), F.lit(-(1 << 62)))
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    digest = F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"))
    numbered = sliced_row_number(rows, ["conv_id"], part, order, "number")
    return numbered.select("conv_id", (F.col("number") - 1).alias("place"), digest.alias("digest"), F.octet_length("text").cast("long").alias("bytes"))


def rebuild(turns: DataFrame, span: int = 5, heads: int = 9) -> tuple[DataFrame, DataFrame]:
    """The conversations of (conv_id, place, ...), each begun with turns of another one, and their ids.

    Conversation c takes the first h turns of c - c % span and goes on with its own after its first h, h = crc32(c) % heads.
    """
    ids = turns.select("conv_id").distinct().withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads)
    own = turns.join(ids, "conv_id").where("place >= h")
    stem = turns.where((F.col("conv_id") % span == 0) & (F.col("place") < heads - 1)).withColumnRenamed("conv_id", "stem")
    near = stem.withColumn("conv_id", F.explode(F.expr(f"sequence(stem - {span - 1}, stem + {span - 1})"))).where(f"conv_id - conv_id % {span} = stem")
    taken = near.join(ids, "conv_id").where("place < h")
    # a stem with fewer turns leaves no gap: places are closed up by the number of turns taken
    held = taken.groupBy("conv_id").agg(F.count(F.lit(1)).alias("held"))
    later = own.join(held, "conv_id", "left").withColumn("place", F.col("place") - F.col("h") + F.coalesce("held", F.lit(0)))
    columns = ["conv_id", "place", "digest", "bytes"]
    return taken.select(*columns).unionByName(later.select(*columns)), ids.select("conv_id")


def _number(seed: int) -> Column:
    return F.xxhash64("place", "digest", F.lit(seed)).cast("decimal(20,0)")


def prefixes(turns: DataFrame) -> DataFrame:
    """Per turn the prefix that ends with it: conv_id, depth, k1, k2, its parent p1, p2, bytes, and the bytes up to it."""
    rows = turns.select("conv_id", "place", (F.col("place") + 1).alias("depth"), "bytes", _number(1).alias("n1"), _number(2).alias("n2"), F.floor(F.col("place") / SLICE).alias("slice"))
    inside = Window.partitionBy("conv_id", "slice").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("conv_id").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.where(f"place >= {SLICE}").select("conv_id").distinct()
    totals = rows.join(sums, "conv_id", "left_semi").groupBy("conv_id", "slice").agg(*[F.sum(c).alias(c) for c in ("n1", "n2", "bytes")])
    shifts = totals.select("conv_id", "slice", *[F.sum(c).over(before).alias(f"b_{c}") for c in ("n1", "n2", "bytes")])
    run = rows.select("conv_id", "slice", "depth", "bytes", "n1", "n2", *[F.sum(c).over(inside).alias(f"s_{c}") for c in ("n1", "n2", "bytes")])
    whole = run.join(shifts, ["conv_id", "slice"], "left")
    total = {c: F.col(f"s_{c}") + F.coalesce(F.col(f"b_{c}"), F.lit(0)) for c in ("n1", "n2", "bytes")}
    return whole.select(
        "conv_id", "depth", "bytes", total["bytes"].alias("upto"),
        *[total[n].cast("decimal(38,0)").alias(k) for n, k in (("n1", "k1"), ("n2", "k2"))],
        *[(total[n] - F.col(n)).cast("decimal(38,0)").alias(p) for n, p in (("n1", "p1"), ("n2", "p2"))],
    )


def _hash_parts(batches):
    """SHA-256 of each key's comma-joined parts, which arrive in order."""
    key = sha = None
    done: list[tuple] = []

    def flush():
        kinds = (pa.int64(), pa.decimal128(38, 0), pa.decimal128(38, 0), pa.string())
        out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), kinds, strict=True)], names=[*KEY, "ends_sha256"])
        done.clear()
        return out

    for batch in batches:
        for *here, ids in zip(*(batch.column(c).to_pylist() for c in (*KEY, "ids")), strict=True):
            if here != key:
                if key is not None:
                    done.append((*key, sha.hexdigest()))
                key, sha = here, hashlib.sha256(ids.encode())
            else:
                sha.update(f",{ids}".encode())
        if done:
            yield flush()
    if key is not None:
        done.append((*key, sha.hexdigest()))
        yield flush()


def _end_digests(ends: DataFrame) -> DataFrame:
    """Per sequence the SHA-256 of its end list; ids meet in parts of a bounded range first."""
    parts = ends.groupBy(*KEY, F.floor(F.col("conv_id") / IDS_PER_PART).alias("part")).agg(F.array_join(F.sort_array(F.collect_list("conv_id")), ",").alias("ids"))
    ordered = parts.repartition(*KEY).sortWithinPartitions(*KEY, "part").select(*KEY, "ids")
    return ordered.mapInArrow(_hash_parts, "depth long, k1 decimal(38,0), k2 decimal(38,0), ends_sha256 string")


def prefix_trie(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """One row per node of the trie over the conversations ``ids`` with their ``turns`` (conv_id, place, digest, bytes)."""
    spark = turns.sparkSession
    ship(spark)
    scratch = Scratch(spark, "trie")
    rows = scratch.table(prefixes(turns), "rows")
    zero = F.lit(0).cast("decimal(38,0)")

    # 1. whole sequences: the deepest prefix of each conversation
    last = rows.groupBy("conv_id").agg(F.max_by(F.struct("depth", "k1", "k2", "upto"), "depth").alias("last"))
    whole = ids.join(last, "conv_id", "left").select(
        "conv_id", F.coalesce("last.depth", F.lit(0)).cast("long").alias("depth"), F.coalesce("last.k1", zero).alias("k1"), F.coalesce("last.k2", zero).alias("k2"),
        F.coalesce("last.upto", F.lit(0)).cast("long").alias("total"),
    )
    ends = scratch.table(whole, "ends")
    sequences = scratch.table(ends.groupBy(*KEY).agg(F.count(F.lit(1)).alias("weight"), F.min("conv_id").alias("conv_id"), F.first("total").alias("total")), "sequences")
    paths = scratch.table(rows.join(sequences.select("conv_id", "weight", "total"), "conv_id"), "paths")
    scratch.drop(rows)

    # 2. leaves: sequences that are no proper prefix of another one
    inner = paths.select((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).distinct()
    leaves = scratch.table(sequences.join(inner, KEY, "left_anti").select("conv_id"), "leaves")

    # 3. weighted prefixes; the root is the empty prefix of every sequence
    marked = paths.join(leaves.withColumn("leaf", F.lit(1)), "conv_id", "left").withColumn("leaf", F.coalesce("leaf", F.lit(0)))
    roots = sequences.join(leaves.withColumn("leaf", F.lit(1)), "conv_id", "left").select(
        "conv_id", "weight", "total", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("bytes"), F.lit(0).cast("long").alias("upto"), zero.alias("k1"), zero.alias("k2"),
        zero.alias("p1"), zero.alias("p2"), F.coalesce("leaf", F.lit(0)).alias("leaf"),
    )
    marked = scratch.table(marked.unionByName(roots), "marked")
    scratch.drop(paths)
    below = F.col("total") - F.col("upto") + F.col("bytes")  # from the node's own text to the end
    nodes = marked.groupBy(*KEY).agg(
        F.sum("weight").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.sum("leaf").cast("long").alias("n_leaves"), F.sum(F.col("weight") * below).alias("all_bytes"),
        F.min(F.when(F.col("leaf") == 1, F.col("conv_id"))).alias("owner"), F.first("p1").alias("p1"), F.first("p2").alias("p2"), F.first(F.col("upto") - F.col("bytes")).alias("before"),
    )
    nodes = scratch.table(nodes, "nodes")

    # 4. a leaf owns its path from one depth on; what lies above is another leaf's
    owned = nodes.groupBy(F.col("owner").alias("conv_id")).agg(F.min("before").alias("owned_from"))
    each = marked.where("leaf = 1").join(owned, "conv_id", "left")
    own = F.greatest(F.lit(0), F.col("total") - F.greatest(F.col("upto") - F.col("bytes"), F.coalesce("owned_from", F.col("total"))))
    distinct = each.groupBy(*KEY).agg(F.sum(own).alias("node_bytes"))

    parents = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count(F.lit(1)).alias("n_children"))
    full = nodes.join(distinct, KEY).join(parents, KEY, "left").join(_end_digests(ends), KEY, "left").select(
        *KEY, "p1", "p2", "conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), "n_leaves",
        (F.col("all_bytes") - F.col("node_bytes")).cast("long").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
    full = scratch.table(full, "full")
    scratch.drop(marked)
    # only nodes with children are parents; the root, parent of the most, is one row and joins by broadcast
    names = full.where("n_children > 0").select(F.col("depth").alias("_d"), F.col("k1").alias("_1"), F.col("k2").alias("_2"), F.col("conv_id").alias("parent_conv_id"))
    meets = (F.col("depth") - 1 == F.col("_d")) & (F.col("p1") == F.col("_1")) & (F.col("p2") == F.col("_2"))
    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    top = full.where("depth <= 1").join(F.broadcast(names.where("_d = 0")), meets, "left").select(*out)
    return top.unionByName(full.where("depth > 1").join(names.where("_d > 0"), meets, "left").select(*out))


def rebuilt_trie(conversations: DataFrame) -> DataFrame:
    """The trie of all conversations of (conv_id, turn, role, text) after ``rebuild``."""
    scratch = Scratch(conversations.sparkSession, "turns")
    return prefix_trie(*rebuild(scratch.table(turns_of(conversations), "turns")))


ORACLE_SQL = """
WITH own AS (
  SELECT conv_id AS c, list({'role': coalesce(role, ''), 'words': coalesce("text", '')} ORDER BY turn NULLS FIRST, role, "text") AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), coded AS (
  SELECT *, (4294967295 - list_reduce(list_prepend(4294967295, [ascii(x)::BIGINT for x in string_split(CAST(c AS VARCHAR), '')]),
    lambda r, b: list_reduce(list_prepend(xor(r, b), range(8)), lambda v, i: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END))) % 9 AS h FROM own
), rebuilt AS (
  SELECT o.c, list_concat(coalesce(p.turns[1:CAST(o.h AS INT)], []), o.turns[CAST(o.h AS INT) + 1:]) AS turns FROM coded o LEFT JOIN own p ON p.c = o.c - o.c % 5
), starts AS (
  SELECT c, len(turns) AS n, d, turns[1:d] AS node FROM (SELECT c, turns, unnest(range(len(turns) + 1)) AS d FROM rebuilt)
), nodes AS (
  SELECT node, d, min(c) AS conv_id, count(*) AS n_convs, coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (n = d), '') AS ends,
    CASE WHEN d = 0 THEN 0 ELSE (count(*) - 1) * strlen(node[d].words) END AS saved FROM starts GROUP BY node, d
), childless AS (
  SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM nodes n
  LEFT JOIN (SELECT node[1:d - 1] AS node, d - 1 AS d, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY 1, 2) k ON k.d = n.d AND k.node = n.node
), below AS (
  SELECT node[1:a] AS node, a AS d, sum(saved) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves
  FROM (SELECT node, saved, n_children, unnest(range(d + 1)) AS a FROM childless) GROUP BY 1, 2
)
SELECT n.conv_id, n.d AS depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, b.n_leaves, CAST(b.saved_tokens AS BIGINT) AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM childless n JOIN below b ON b.d = n.d AND b.node = n.node LEFT JOIN nodes p ON p.d = n.d - 1 AND p.node = n.node[1:n.d - 1]
"""
