"""The trie of conversation prefixes, and what sharing them saves, by the Euler-tour technique.

A node is a distinct sequence of first turns. Its key is the XOR of 124-bit hashes of its (position, turn), so the keys of a
conversation's prefixes are running XORs; texts leave the first scan as digests. Nodes become arcs, one entering and one
leaving each, linked into one tour; the tour is ranked (listrank), and what a subtree holds is the difference of the sums at
its enter and exit arcs.

Hot keys: a conversation's rows are numbered and XORed in spans of SPAN turns, whose totals, one row a span, are carried over;
the children of a node are linked in about sqrt(n) buckets, which are linked in turn; members and ends are pre-aggregated.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from subgrade.llm.common import map_batches, table, written
from subgrade.llm.crc import crc32_sql
from subgrade.llm.listrank import sums_to_end

SPAN, ENDS = 1024, 4096
#: The query's rebuilding: conversations take turns of the first of each FAMILY ids, fewer than HEADS of them.
FAMILY, HEADS = 5, 9
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()


def turn_digests(convs: DataFrame) -> DataFrame:
    """conv_id, turn, digest of role and text, n_bytes of the text. Null roles and texts are empty; rows without a conv_id go."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    return convs.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), digest.alias("digest"), F.octet_length(text).cast("long").alias("n_bytes"),
    )


def _before(*by: str) -> Window:
    return Window.partitionBy("conv_id").orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)


def numbered(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, digest, n_bytes) with pos from 0 in order of turn, nulls first, then digest; turns of a
    conversation are numbered span by span."""
    span = F.coalesce(F.floor(F.col("turn") / SPAN), F.lit(-(2**63)))
    keyed = turns.withColumn("span", span)
    counts = keyed.groupBy("conv_id", "span").agg(F.count("*").alias("n"))
    offsets = counts.select("conv_id", "span", F.coalesce(F.sum("n").over(_before("span")), F.lit(0)).alias("earlier"))
    inside = F.row_number().over(Window.partitionBy("conv_id", "span").orderBy(F.col("turn").asc_nulls_first(), "digest")) - 1
    ranked = keyed.withColumn("inside", inside).join(offsets, ["conv_id", "span"])
    return ranked.select("conv_id", (F.col("earlier") + F.col("inside")).alias("pos"), "digest", "n_bytes")


def rebuilt(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The query's rebuilt conversations from numbered rows: (conv_id, pos, digest, n_bytes), and all conv_ids.

    Conversation c begins with the first h turns of c - c % FAMILY and goes on with its own after its first h.
    """
    heads = F.crc32(F.col("conv_id").cast("string")) % HEADS
    ids = rows.groupBy("conv_id").agg(F.count("*").alias("n"))
    ids = written(ids.withColumn("h", heads).withColumn("base", F.col("conv_id") - F.col("conv_id") % FAMILY), "trie-conversations")
    bases = ids.filter(F.col("conv_id") == F.col("base")).select("base", F.col("n").alias("n_base"))
    taken = ids.join(bases, "base", "left").select("conv_id", "base", "h", F.least("h", F.coalesce("n_base", F.lit(0))).alias("taken"))
    first = rows.filter((F.col("pos") < HEADS - 1) & (F.col("conv_id") % FAMILY == 0)).withColumnRenamed("conv_id", "base")
    first = first.join(taken, "base").filter("pos < taken").select("conv_id", "pos", "digest", "n_bytes")
    # few bases have fewer turns than are asked for, so only those ids are joined to the rows
    short = taken.filter("taken < h").select("conv_id", F.col("taken").alias("fewer"))
    own = rows.withColumn("h", heads).filter("pos >= h").join(short, "conv_id", "left")
    own = own.select("conv_id", (F.col("pos") - F.col("h") + F.coalesce("fewer", "h")).alias("pos"), "digest", "n_bytes")
    return first.unionByName(own), ids.select("conv_id")


def _hashes(pos: Column, digest: Column) -> tuple[Column, Column]:
    second = F.conv(F.substring(F.md5(F.concat(digest, F.lit("/"), pos.cast("string"))), 1, 15), 16, 10).cast("long")
    return F.xxhash64(pos, digest), second


def memberships(rows: DataFrame) -> DataFrame:
    """conv_id, depth, key (k1, k2), parent's key (p1, p2), n_bytes and whether the conversation ends there, of each prefix."""
    h1, h2 = _hashes(F.col("pos"), F.col("digest"))
    keyed = rows.select("conv_id", "pos", "n_bytes", h1.alias("h1"), h2.alias("h2"), F.floor(F.col("pos") / SPAN).alias("span"))
    spans = keyed.groupBy("conv_id", "span").agg(F.bit_xor("h1").alias("x1"), F.bit_xor("h2").alias("x2"), F.count("*").alias("n"))
    carried = [F.coalesce(F.bit_xor(f"x{i}").over(_before("span")), F.lit(0).cast("long")).alias(f"b{i}") for i in (1, 2)]
    spans = spans.select("conv_id", "span", *carried, F.sum("n").over(Window.partitionBy("conv_id")).alias("n_turns"))
    inside = Window.partitionBy("conv_id", "span").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    running = keyed.withColumns({f"r{i}": F.bit_xor(f"h{i}").over(inside) for i in (1, 2)}).join(spans, ["conv_id", "span"])
    keys = running.withColumns({f"k{i}": F.col(f"r{i}").bitwiseXOR(F.col(f"b{i}")) for i in (1, 2)})
    return keys.select(
        "conv_id", (F.col("pos") + 1).alias("depth"), "k1", "k2", F.col("k1").bitwiseXOR(F.col("h1")).alias("p1"),
        F.col("k2").bitwiseXOR(F.col("h2")).alias("p2"), "n_bytes", (F.col("pos") + 1 == F.col("n_turns")).alias("is_end"),
    )


def _ends(members: DataFrame, ids: DataFrame) -> DataFrame:
    """k1, k2, ends_sha256 of the nodes at which conversations end. The ids of a node are joined in pieces of ENDS
    neighbouring ids, and the hash, which has to read them in order, streams the pieces."""
    ending = members.filter("is_end").select("conv_id", "k1", "k2")
    turnless = ids.join(ending.select("conv_id"), "conv_id", "left_anti").select("conv_id", F.lit(0).cast("long").alias("k1"), F.lit(0).cast("long").alias("k2"))
    pieces = ending.unionByName(turnless).withColumn("piece", F.floor(F.col("conv_id") / ENDS))
    pieces = pieces.groupBy("k1", "k2", "piece").agg(F.array_sort(F.collect_list("conv_id")).alias("ids"))
    pieces = pieces.select("k1", "k2", "piece", F.array_join(F.transform("ids", lambda c: c.cast("string")), ",").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        out: list[tuple] = []
        for key, own in itertools.groupby(rows, key=lambda r: r[:2]):
            digest = hashlib.sha256(next(own)[3].encode())
            for r in own:
                digest.update(b"," + r[3].encode())
            out.append((*key, digest.hexdigest()))
            if len(out) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=["k1", "k2", "ends_sha256"])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=["k1", "k2", "ends_sha256"])

    dealt = pieces.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "piece")
    return map_batches(dealt, run, "k1 long, k2 long, ends_sha256 string")


def _linked(nodes: DataFrame) -> DataFrame:
    """nodes with parent, parent_conv_id, sibling (the next), child (the first) and n_children, in any order of children.

    A node's children are chained by id inside each of about sqrt(n) buckets, and the buckets' first are chained; so a node
    with as many children as there are conversations is no task's alone.
    """
    buckets = max(1, math.isqrt(nodes.count()))
    below = nodes.filter("depth > 0").withColumn("bucket", F.pmod("k1", F.lit(buckets)))
    groups = below.groupBy("p1", "p2", "bucket").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    in_order = Window.partitionBy("p1", "p2").orderBy("bucket")
    groups = groups.select(
        "p1", "p2", "bucket", "first", F.lead("first").over(in_order).alias("later"), F.row_number().over(in_order).alias("nth"),
        F.sum("n").over(Window.partitionBy("p1", "p2")).alias("n_children"),
    )
    parents = nodes.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    groups = written(groups.join(parents, ["p1", "p2"]), "trie-siblings")
    after = F.lead("id").over(Window.partitionBy("p1", "p2", "bucket").orderBy("id"))
    below = below.withColumn("after", after).join(groups.select("p1", "p2", "bucket", "later", "parent", "parent_conv_id"), ["p1", "p2", "bucket"])
    below = below.withColumn("sibling", F.coalesce("after", "later")).drop("after", "later", "bucket")
    root = nodes.filter("depth = 0").withColumns({c: F.lit(None).cast("long") for c in ("parent", "parent_conv_id", "sibling")})
    children = groups.filter("nth = 1").select(F.col("parent").alias("id"), F.col("first").alias("child"), "n_children")
    out = below.unionByName(root).join(children, "id", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    return out.withColumn("own_saving", (F.col("n_convs") - 1) * F.col("n_bytes"))


def euler_tour(linked: DataFrame) -> DataFrame:
    """The tour's arcs, 2 * id entering and 2 * id + 1 leaving: link, next, and at the entering arc leaves and saved."""
    enter, leave = F.col("id") * 2, F.col("id") * 2 + 1
    zero = F.lit(0).cast("long")
    arcs = F.array(
        F.struct(enter.alias("link"), F.coalesce(F.col("child") * 2, leave).alias("next"), (F.col("n_children") == 0).cast("long").alias("leaves"), F.col("own_saving").alias("saved")),
        F.struct(leave.alias("link"), F.coalesce(F.col("sibling") * 2, F.col("parent") * 2 + 1).alias("next"), zero.alias("leaves"), zero.alias("saved")),
    )
    return linked.select(F.inline(arcs))


def trie_nodes(rows: DataFrame, ids: DataFrame, small: int | None = None) -> DataFrame:
    """One row for each distinct prefix of the conversations of ids, whose turns are rows (conv_id, pos from 0, digest,
    n_bytes): k1, k2, conv_id (the smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256. An id without rows is a member of the root only. No ids give no rows."""
    members = written(memberships(rows), "trie-members")
    zero = F.lit(0).cast("long")
    same = [F.max(c).alias(c) for c in ("depth", "p1", "p2", "n_bytes")]
    nodes = members.groupBy("k1", "k2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), *same)
    root = ids.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).filter("n_convs > 0")
    root = root.withColumns({c: zero for c in ("k1", "k2", "depth", "p1", "p2", "n_bytes")})
    # written at once, so that each node has one id whatever is computed again
    nodes = written(nodes.unionByName(root).withColumn("id", F.monotonically_increasing_id()), "trie-nodes")
    linked = written(_linked(nodes), "trie-linked")
    sums = sums_to_end(euler_tour(linked), ["leaves", "saved"], **({"small": small} if small is not None else {}))
    sign = F.when(F.col("link") % 2 == 0, 1).otherwise(-1)
    subtree = sums.groupBy(F.shiftright("link", 1).alias("id")).agg(F.sum(F.col("leaves") * sign).alias("n_leaves"), F.sum(F.col("saved") * sign).alias("saved_tokens"))
    out = linked.join(subtree, "id").join(_ends(members, ids), ["k1", "k2"], "left")
    return out.select(
        "k1", "k2", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY_SHA256)).alias("ends_sha256"),
    )


def prefix_trie(convs: DataFrame, small: int | None = None) -> DataFrame:
    """The trie of the conversations as they are: trie_nodes over conv_id, turn, role, text; other columns are not read.

    Turns go by turn, nulls first, then by the MD5 of role and text; null roles and texts are empty; rows without a conv_id
    belong to no conversation; repeated rows are turns of their own; texts are whole, of any length; an empty table gives no
    rows.
    """
    rows = written(numbered(turn_digests(convs)), "trie-turns")
    return trie_nodes(rows, rows.select("conv_id").distinct(), small)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all rebuilt conversations. Nulls, ties and repeats as in prefix_trie."""
    rows = written(numbered(turn_digests(table(spark, sf_dir, "conversations"))), "trie-turns")
    turns, ids = rebuilt(rows)
    return trie_nodes(turns, ids).drop("k1", "k2")


OP11_SQL = f"""
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), ids AS (
  SELECT DISTINCT conv_id, {crc32_sql("conv_id::VARCHAR")} % {HEADS} AS h, conv_id - conv_id % {FAMILY} AS base FROM turns
), heads AS (
  SELECT ids.conv_id, turns.pos, role, text FROM ids JOIN turns ON turns.conv_id = base AND turns.pos < h
), taken AS (
  SELECT conv_id, count(*) AS n FROM heads GROUP BY conv_id
), rebuilt AS (
  SELECT * FROM heads
  UNION ALL
  SELECT turns.conv_id, pos - h + coalesce(n, 0), role, text
  FROM turns JOIN ids USING (conv_id) LEFT JOIN taken USING (conv_id) WHERE pos >= h
), members AS (
  SELECT conv_id, pos + 1 AS depth, strlen(text) AS bytes,
         string_agg(length(role)::VARCHAR || ':' || role || length(text)::VARCHAR || ':' || text, '') OVER (PARTITION BY conv_id ORDER BY pos) AS key
  FROM rebuilt
  UNION ALL
  SELECT conv_id, 0, 0, '' FROM ids
), nodes AS (
  SELECT key, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes FROM members GROUP BY key
), parents AS (
  SELECT DISTINCT m.key, p.key AS parent FROM members AS m JOIN members AS p ON p.conv_id = m.conv_id AND p.depth = m.depth - 1
), children AS (
  SELECT parent AS key, count(*) AS n_children FROM parents GROUP BY parent
), below AS (
  SELECT DISTINCT a.key, m.key AS lower FROM members AS m JOIN members AS a ON a.conv_id = m.conv_id AND a.depth <= m.depth
), subtrees AS (
  SELECT below.key, count(*) FILTER (WHERE n_children IS NULL) AS n_leaves, sum((n_convs - 1) * bytes) AS saved_tokens
  FROM below JOIN nodes ON nodes.key = lower LEFT JOIN children ON children.key = lower GROUP BY below.key
), ends AS (
  SELECT key, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends_sha256
  FROM (SELECT *, max(depth) OVER (PARTITION BY conv_id) AS last FROM members) WHERE depth = last GROUP BY key
)
SELECT nodes.conv_id, nodes.depth::BIGINT AS depth, up.conv_id AS parent_conv_id, nodes.n_convs, coalesce(n_children, 0)::BIGINT AS n_children,
       n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, coalesce(ends_sha256, sha256('')) AS ends_sha256
FROM nodes LEFT JOIN parents USING (key) LEFT JOIN nodes AS up ON up.key = parents.parent
LEFT JOIN children ON children.key = nodes.key JOIN subtrees ON subtrees.key = nodes.key LEFT JOIN ends ON ends.key = nodes.key
"""
