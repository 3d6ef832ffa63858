"""Prefix trie of conversations by preorder intervals.

A node is a distinct sequence of first turns. Conversations are ranked lexicographically by their paths; the members of a
node are then a run of ranks, and (first member's rank, depth) is the preorder of all nodes. A node's subtree ends at the
last node whose run ends where its own does. Leaves and savings of a subtree are differences of running sums in preorder,
which are taken by ranges of rows: no task holds a subtree, a level or a path's texts.

A turn travels as 16 bytes of a digest, and a node is the digest of its parent's and its turn's. Siblings stand in the order
of their digests. A path is spelt by its steps at nodes that lose members only: at most the root of twice the number of all
turns, however long a conversation is.

Nulls and ties: a null role or text is empty. Turns of a conversation that are equal (nulls first) run by the digest of
role and text; repeated rows are turns each. Rows with a null conv_id belong to no conversation and are left out. Without
conversations there is no node, not even the root. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b, sha256
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terraspan.llm.common import BLANK, staged, table
from terraspan.llm.conversation_repair import _CRC
from terraspan.operators.ranges import running_sums

ROOT = b"\0" * 16
#: Ids in one piece of a list that is hashed.
CHUNK = 1 << 16


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id, place (from 1), digest and words of each turn. The texts stay behind."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    whole = F.concat(F.char_length(text("role")).cast("string"), F.lit(":"), text("role"), text("text"))
    digest = F.substring(F.unhex(F.sha2(whole, 256)), 1, 16)
    words = F.size(F.array_remove(F.split(text("text"), BLANK), "")).cast("long")
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"), words.alias("words"))
    by = Window.partitionBy("conv_id").orderBy("turn", "digest")
    return rows.select("conv_id", F.row_number().over(by).cast("long").alias("place"), "digest", "words")


def headed(turns: DataFrame, heads: Column, most: int, group: int = 20) -> DataFrame:
    """Conversations that begin as others do: the first ``heads`` (a column of conv_id, at most ``most``) turns of
    conversation conv_id - conv_id % group, then their own after so many. conv_id, part, place, digest, words; a row of
    part -1 for each conversation, whatever is left of it."""
    alone = turns.where("place = 1").select("conv_id", F.lit(-1).alias("part"), "place", F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("words"))
    own = turns.where(F.col("place") > heads).select("conv_id", F.lit(1).alias("part"), "place", "digest", "words")
    first = turns.where(F.col("place") <= most).withColumnRenamed("conv_id", "base")
    to = alone.select("conv_id", (F.col("conv_id") - F.col("conv_id") % group).alias("base"), heads.alias("heads")).where("heads > 0")
    shared = to.join(first, "base").where("place <= heads").select("conv_id", F.lit(0).alias("part"), "place", "digest", "words")
    return alone.unionByName(own).unionByName(shared)


def prefixes(parts: DataFrame) -> DataFrame:
    """A row for each conversation and depth: conv_id, depth, node, parent (null for the root), words, ended. parts: conv_id,
    part (-1: none of its turns, but there for each conversation), place, digest, words. One sorted stream a partition."""
    rows = parts.repartition("conv_id").sortWithinPartitions("conv_id", "part", "place").select("conv_id", "part", "digest", "words")
    schema = pa.schema([("conv_id", pa.int64()), ("depth", pa.int64()), ("node", pa.binary()), ("parent", pa.binary()), ("words", pa.int64()), ("ended", pa.bool_())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # the latest row, until it is known whether the conversation ends there
        for b in batches:
            out = []
            for conv, part, digest, words in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held:
                    out.append((*held, part < 0))
                if part < 0:
                    held = (conv, 0, ROOT, None, 0)
                else:
                    _, depth, node, _, _ = held
                    held = (conv, depth + 1, blake2b(node + digest, digest_size=16).digest(), node, words)
            yield batch(out)
        yield batch([(*held, True)] if held else [])

    def batch(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], f.type) for k, f in enumerate(schema)], schema=schema)

    return rows.mapInArrow(read, "conv_id long, depth long, node binary, parent binary, words long, ended boolean")


def nodes_of(rows: DataFrame) -> DataFrame:
    """A row for each node: node, parent, depth, words, conv_id (smallest member), n_convs, parent_conv_id, parent_convs and
    n_children."""
    keys = ["node", "parent", "depth", "words"]
    nodes = staged(rows.groupBy(*keys).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")), "nodes")
    above = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("n_convs").alias("parent_convs"))
    below = nodes.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    return nodes.join(above, "parent", "left").join(below, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))


def ranked(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """conv_id and rank (from 1) of each conversation among all, lexicographically by path; one that another begins with
    comes before it."""
    steps = nodes.where("n_convs < parent_convs").select("node", F.lit(True).alias("step"))
    some = rows.select("conv_id", "depth", "node", "ended").join(steps, "node", "left").where("ended or step")
    path = F.sort_array(F.collect_list(F.when(F.col("step"), F.struct("depth", F.hex("node").alias("name")))))
    paths = some.groupBy("conv_id").agg(F.array_join(F.transform(path, lambda s: s["name"]), "").alias("path"), F.max("depth").alias("length"))
    return running_sums(paths, ["path", "length", "conv_id"], {"rank": F.lit(1)}).select("conv_id", "rank")


def trie(rows: DataFrame) -> DataFrame:
    """The nodes of ``prefixes``: node, conv_id, depth, parent_conv_id, n_convs, n_children, position (in preorder, from 1),
    last (position of the last node of the subtree), n_leaves and saved_tokens of the subtree."""
    nodes = staged(nodes_of(rows), "nodes")
    runs = rows.select("conv_id", "node").join(ranked(rows, nodes), "conv_id").groupBy("node").agg(F.min("rank").alias("low"), F.max("rank").alias("high"))
    placed = nodes.join(runs, "node").select("node", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "low", "high", ((F.col("n_convs") - 1) * F.col("words")).alias("own"))
    leaf = (F.col("n_children") == 0).cast("long")
    placed = running_sums(placed, ["low", "depth"], {"position": F.lit(1), "saved": F.col("own"), "leaves": leaf})
    placed = staged(placed, "preorder")
    ends = placed.groupBy("high").agg(F.max("position").alias("last"), F.max("saved").alias("end_saved"), F.max("leaves").alias("end_leaves"))
    return placed.join(ends, "high").select(
        "node", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "position", "last",
        (F.col("end_leaves") - F.col("leaves") + leaf).alias("n_leaves"), (F.col("end_saved") - F.col("saved") + F.col("own")).alias("saved_tokens"),
    )


def ends_digest(rows: DataFrame) -> DataFrame:
    """node and ends_sha256: of the ids of the conversations that end there, ascending, comma-joined. Ids are joined in
    pieces of a bounded size by ranges; a node's pieces are then hashed in order."""
    ends = rows.where("ended").select("node", "conv_id").repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for node, ids in groupby(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True), lambda x: x[0]):
                own = [i for _, i in ids]
                out += [(node, own[k], ",".join(map(str, own[k : k + CHUNK]))) for k in range(0, len(own), CHUNK)]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.binary(), pa.int64(), pa.string()))], ["node", "first", "ids"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node = total = None
        for b in batches:
            out = []
            for n, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if n == node:
                    total.update(b"," + ids.encode())
                    continue
                if node is not None:
                    out.append((node, total.hexdigest()))
                node, total = n, sha256(ids.encode())
            yield batch(out)
        yield batch([(node, total.hexdigest())] if node is not None else [])

    def batch(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.string())], ["node", "ends_sha256"])

    joined = ends.mapInArrow(pieces, "node binary, first long, ids string")
    dealt = joined.repartition("node").sortWithinPartitions("node", "first").select("node", "ids")
    return dealt.mapInArrow(hashed, "node binary, ends_sha256 string")


def op13_prefix_trie(spark, sf_dir: str) -> DataFrame:
    turns = staged(turns_of(table(spark, sf_dir, "conversations")), "turns")
    heads = F.crc32(F.col("conv_id").cast("string")) % 4
    rows = staged(prefixes(headed(turns, heads, 3)), "prefixes")
    return trie(rows).join(ends_digest(rows), "node", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(sha256().hexdigest())).alias("ends_sha256"),
    )


ORACLE = {
    "op13_prefix_trie": f"""
WITH named AS (SELECT conv_id, turn, length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '') AS whole,
  len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x09-\\x0D\\x20]+'), lambda x: x <> '')) AS words FROM conversations WHERE conv_id IS NOT NULL),
turns AS (SELECT conv_id, sha256(whole) AS digest, words, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(whole)) AS place FROM named),
convs AS (SELECT conv_id, {_CRC.format(s="conv_id::VARCHAR")} % 4 AS h FROM (SELECT DISTINCT conv_id FROM turns)),
parts AS (SELECT c.conv_id, 0 AS part, place, digest, words FROM convs c JOIN turns t ON t.conv_id = c.conv_id - c.conv_id % 20 AND place <= h
  UNION ALL SELECT c.conv_id, 1, place, digest, words FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND place > h),
p AS (SELECT conv_id, row_number() OVER w AS depth, string_agg(digest, '') OVER w AS node, words FROM parts WINDOW w AS (PARTITION BY conv_id ORDER BY part, place)
  UNION ALL SELECT conv_id, 0, '', 0 FROM convs),
nodes AS (SELECT node, depth, words, min(conv_id) AS conv_id, count(*) AS n_convs FROM p GROUP BY node, depth, words),
kids AS (SELECT left(node, 64 * (depth - 1)) AS node, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
ends AS (SELECT conv_id, max_by(node, depth) AS node FROM p GROUP BY conv_id),
leaves AS (SELECT p.node, count(DISTINCT e.node) AS n FROM p JOIN ends e USING (conv_id) WHERE e.node NOT IN (SELECT node FROM kids) GROUP BY p.node),
saved AS (SELECT v, sum((n_convs - 1) * words) AS n FROM (SELECT DISTINCT a.node AS v, b.node FROM p a JOIN p b ON a.conv_id = b.conv_id AND b.depth >= a.depth) JOIN nodes USING (node) GROUP BY v),
sums AS (SELECT node, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS s FROM ends GROUP BY node)
SELECT n.conv_id, n.depth::BIGINT AS depth, up.conv_id AS parent_conv_id, n.n_convs::BIGINT AS n_convs, coalesce(kids.n, 0)::BIGINT AS n_children,
  leaves.n::BIGINT AS n_leaves, saved.n::BIGINT AS saved_tokens, coalesce(s, sha256('')) AS ends_sha256
FROM nodes n LEFT JOIN nodes up ON n.depth > 0 AND up.node = left(n.node, 64 * (n.depth - 1)) LEFT JOIN kids ON kids.node = n.node
JOIN leaves ON leaves.node = n.node JOIN saved ON saved.v = n.node LEFT JOIN sums ON sums.node = n.node"""
}
