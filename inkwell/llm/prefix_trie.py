"""Prefix trie of conversations, its totals by time-forward processing.

A conversation begins with turns of a shared base conversation; the distinct
first turns of all conversations are the nodes of a trie. Nodes are sorted by
reverse level order, and each passes its totals to its parent through a priority
queue that spills to files: within shards of whole subtrees first, each a
partition of its own, then across the roots of these subtrees, in the few nodes
above them.
"""

from __future__ import annotations

import hashlib
import heapq
import os
import pickle
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, materialise, width

#: A base conversation is one whose id is divisible by BASE; others take so many of its first turns, fewer than TAKEN.
BASE, TAKEN = 20, 4
#: A node of more members than this, and than a share of all conversations, is above the shards.
LIGHT, SHARE = 64, 1024
#: Levels of a subtree that one shard holds.
LEVELS = 1024
#: Messages of a queue that are held in memory.
HELD = 200_000
#: Bytes of ids in one row at most while a node's ids are hashed.
CHUNK = 1 << 20

_NO_ENDS = hashlib.sha256(b"").hexdigest()


class SpillingQueue:
    """A priority queue of (key, message), smallest key first; what is over ``held`` is written to sorted files."""

    def __init__(self, held: int = HELD):
        self.held, self.heap, self.runs, self.count = held, [], [], 0
        self.files: list[str] = []

    def push(self, key: tuple, message: tuple) -> None:
        self.count += 1
        heapq.heappush(self.heap, (key, self.count, message))
        if len(self.heap) > self.held:
            self._spill()

    def _spill(self) -> None:
        """The half of the largest keys goes to a file; the smallest are wanted next."""
        self.heap.sort()
        keep = self.held // 2
        handle, path = tempfile.mkstemp(prefix="queue-")
        self.files.append(path)
        with os.fdopen(handle, "wb") as out:
            for item in self.heap[keep:]:
                pickle.dump(item, out)
        del self.heap[keep:]
        heapq.heapify(self.heap)
        run = self._read(path)
        heapq.heappush(self.runs, (next(run), id(run), run))

    def _read(self, path: str) -> Iterator[tuple]:
        with open(path, "rb") as own:
            while True:
                try:
                    yield pickle.load(own)
                except EOFError:
                    break
        os.unlink(path)
        self.files.remove(path)

    def pop(self, key: tuple) -> Iterator[tuple]:
        """The messages of this key, which no smaller key is waiting before."""
        while True:
            if self.heap and self.heap[0][0] == key:
                yield heapq.heappop(self.heap)[2]
            elif self.runs and self.runs[0][0][0] == key:
                first, _, run = heapq.heappop(self.runs)
                yield first[2]
                if (more := next(run, None)) is not None:
                    heapq.heappush(self.runs, (more, id(run), run))
            else:
                return

    def close(self) -> None:
        for _, _, run in self.runs:
            run.close()
        for path in self.files:
            if os.path.exists(path):
                os.unlink(path)


_KEY = ["k1", "k2"]
_UP = ["p1", "p2"]
_IN = ["k1", "k2", "depth", "p1", "p2", "conv_id", "n_convs", "words", "top", "more_children", "more_leaves", "more_saved"]
_OUT = "k1 long, k2 long, p1 long, p2 long, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, top boolean"


def pass_up(nodes: DataFrame, held: int = HELD) -> DataFrame:
    """Totals of the nodes of each partition, which holds whole subtrees in reverse level order.

    A node waits in its parent's queue, so it comes out with the parent's
    ``conv_id``; a ``top`` one has its parent elsewhere and comes out without.
    ``more_*`` is what has come to a node from elsewhere.
    """
    order = _OUT.split(", ")
    names, types = [x.split()[0] for x in order], [{"long": pa.int64(), "boolean": pa.bool_()}[x.split()[1]] for x in order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queue, out = SpillingQueue(held), []
        try:
            for batch in batches:
                for k1, k2, depth, p1, p2, conv, n, words, top, children, leaves, saved in zip(*(batch.column(c).to_pylist() for c in _IN)):
                    saved += (n - 1) * words
                    for child in queue.pop((-depth, k1, k2)):
                        children, leaves, saved = children + 1, leaves + child[9], saved + child[10]
                        out.append((*child[:6], conv, *child[7:]))
                    row = (k1, k2, p1, p2, conv, depth, None, n, children, leaves or int(not children), saved, top)
                    if top:
                        out.append(row)
                    else:
                        queue.push((1 - depth, p1, p2), row)
                    if len(out) >= 10_000:
                        yield _batch(out, names, types)
                        out = []
            if out:
                yield _batch(out, names, types)
        finally:
            queue.close()

    return nodes.select(*_IN).mapInArrow(run, _OUT)


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows), types)], names=names)


def taken_turns(conv: Column) -> Column:
    """How many turns of its base a conversation begins with."""
    return F.crc32(conv.cast("string").cast("binary")) % TAKEN


def _slim(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """A row per turn without its text: its place in the order, a digest of role and text, and its words."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    own = rows.where(F.col(conv_col).isNotNull())
    return own.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), digest.alias("x"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))


def _rebuilt(slim: DataFrame) -> DataFrame:
    """``(part, conv_id, seg, turn, x, words, tie)``: the turns of every conversation, those of its base first (seg 0), in parts of bounded size."""
    base = slim.where(F.col("conv_id") % BASE == 0)
    first = base.withColumn("j", F.row_number().over(W.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "x"))).where(F.col("j") < TAKEN)
    ids = slim.groupBy("conv_id").agg(F.lit(0).alias("one")).drop("one")
    wanted = ids.select("conv_id", (F.col("conv_id") - F.col("conv_id") % BASE).alias("b"), taken_turns(F.col("conv_id")).alias("h")).where("h > 0")
    kind = slim.schema["turn"].dataType
    heads = wanted.join(first.select(F.col("conv_id").alias("b"), "j", "x", "words"), "b").where("j <= h")
    heads = heads.select("conv_id", F.lit(0).alias("seg"), F.lit(None).cast(kind).alias("turn"), "x", "words", F.col("j").cast("long").alias("tie"))
    rows = heads.unionByName(slim.withColumns({"seg": F.lit(1), "tie": F.monotonically_increasing_id()}).select(heads.columns))
    # Seg 0 has its order in tie; equal turns are in the order of their digests.
    order = ["conv_id", "seg", F.asc_nulls_first("turn"), F.when(F.col("seg") == 1, F.col("x")), "tie"]
    return rows.repartitionByRange(width(slim.sparkSession), *order).withColumn("part", F.spark_partition_id())


def _members(turns: DataFrame) -> DataFrame:
    """``(conv_id, depth, k1, k2, p1, p2, words, is_end)``: every conversation at each of its nodes.

    A conversation that was cut into parts is numbered within each, and goes on
    where the part before has ended, so none has to be sorted in one task.
    """
    piece = W.partitionBy("part", "conv_id")
    local = piece.orderBy("seg", F.asc_nulls_first("turn"), F.when(F.col("seg") == 1, F.col("x")), "tie")
    rows = turns.withColumn("at", F.row_number().over(local) - 1)
    each = turns.groupBy("part", "conv_id").agg(F.count("*").alias("n"), F.count_if(F.col("seg") == 0).alias("k"))
    parts, before = W.partitionBy("conv_id").orderBy("part"), W.partitionBy("conv_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy("conv_id")
    h = taken_turns(F.col("conv_id"))
    offsets = each.select("part", "conv_id", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("from"), F.sum("k").over(parts).alias("k"), F.sum("n").over(whole).alias("n"), F.sum("k").over(whole).alias("all_k"))
    offsets = offsets.select("part", "conv_id", "from", "k", (F.col("all_k") + F.greatest(F.col("n") - F.col("all_k") - h, F.lit(0))).alias("size"))
    placed = rows.join(offsets, ["part", "conv_id"]).withColumn("at", F.col("at") + F.col("from"))
    # Of the conversation's own turns the first h are replaced by those of its base.
    placed = placed.where((F.col("seg") == 0) | (F.col("at") - F.col("k") >= h)).withColumn("depth", F.when(F.col("seg") == 0, F.col("at") + 1).otherwise(F.col("at") + 1 - h))
    # A prefix is known by the exclusive or of the hashes of its turns, each with its depth: 128 bits that parts can add to.
    for i in (1, 2):
        placed = placed.withColumn(f"h{i}", F.xxhash64(F.lit(i), "x", "depth"))
    placed = materialise(placed.select("part", "conv_id", "depth", "h1", "h2", "words", "size"), "placed")
    sums = placed.groupBy("part", "conv_id").agg(*(F.bit_xor(f"h{i}").alias(f"s{i}") for i in (1, 2)))
    sums = sums.select("part", "conv_id", *(F.coalesce(F.bit_xor(f"s{i}").over(before), F.lit(0)).alias(f"s{i}") for i in (1, 2)))
    within = piece.orderBy("depth")
    keyed = placed.select("*", *(F.bit_xor(f"h{i}").over(within).alias(f"r{i}") for i in (1, 2))).join(sums, ["part", "conv_id"])
    key = [F.col(f"r{i}").bitwiseXOR(F.col(f"s{i}")) for i in (1, 2)]
    up = [k.bitwiseXOR(F.col(f"h{i}")) for i, k in zip((1, 2), key)]
    deep = keyed.select("conv_id", "depth", *(k.alias(n) for k, n in zip((*key, *up), (*_KEY, *_UP))), "words", (F.col("depth") == F.col("size")).alias("is_end"))
    zero = F.lit(0).cast("long")
    root = offsets.groupBy("conv_id").agg(F.max("size").alias("size")).select("conv_id", zero.alias("depth"), *(zero.alias(c) for c in (*_KEY, *_UP)), zero.alias("words"), (F.col("size") == 0).alias("is_end"))
    return deep.unionByName(root)


def _digests(members: DataFrame) -> DataFrame:
    """``(k1, k2, depth, ends_sha256)`` of the nodes where conversations end.

    Ends are sorted by node and id over all tasks; a node whose ids lie in one
    task is hashed there. Of others the ids are written as texts of bounded
    size, which one task per node hashes in order, holding one text at a time.
    """
    keys = [*_KEY, "depth"]
    ends = members.where("is_end").select(*keys, "conv_id")
    spark = members.sparkSession
    fields = [pa.field("k1", pa.int64()), pa.field("k2", pa.int64()), pa.field("depth", pa.int64()), pa.field("first", pa.int64()), pa.field("ids", pa.string()), pa.field("sha", pa.string())]
    schema = pa.schema(fields)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Nodes at either end of a task's rows as texts, the others as hashes."""
        out: list[tuple] = []
        node, first, ids, size, cut_off = None, None, [], 0, True

        def close(last: bool) -> None:
            text = ",".join(ids)
            whole = not cut_off and not last
            out.append((*node, first, None if whole else text, hashlib.sha256(text.encode()).hexdigest() if whole else None))

        for batch in batches:
            for k1, k2, depth, conv in zip(*(c.to_pylist() for c in batch.columns)):
                if (k1, k2, depth) != node or size > CHUNK:
                    if node is not None:
                        close(size > CHUNK)
                        cut_off = (size > CHUNK and (k1, k2, depth) == node) or False
                    node, first, ids, size = (k1, k2, depth), conv, [], 0
                ids.append(str(conv))
                size += len(ids[-1]) + 1
            if len(out) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out), fields)], schema=schema)
                out.clear()
        if node is not None:
            close(True)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out), fields)], schema=schema)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        node, sha = None, None
        for batch in batches:
            for k1, k2, depth, _, ids, _ in zip(*(c.to_pylist() for c in batch.columns)):
                if (k1, k2, depth) != node:
                    if node is not None:
                        out.append((*node, sha.hexdigest()))
                    node, sha = (k1, k2, depth), hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
        if node is not None:
            out.append((*node, sha.hexdigest()))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=[*keys, "ends_sha256"])

    order = [*keys, "conv_id"]
    pieces = ends.repartitionByRange(width(spark), *order).sortWithinPartitions(*order).mapInArrow(cut, "k1 long, k2 long, depth long, first long, ids string, sha string")
    pieces = materialise(pieces, "ends")
    long = pieces.where("sha is null").repartition(*_KEY).sortWithinPartitions(*keys, "first").mapInArrow(join, "k1 long, k2 long, depth long, ends_sha256 string")
    return pieces.where("sha is not null").select(*keys, F.col("sha").alias("ends_sha256")).unionByName(long)


def _to_parents(tops: DataFrame, *sums: Column) -> DataFrame:
    """What the roots of shards send to their parents, by the parent's key."""
    return tops.groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("c"), *sums)


def _with_blocks_below(sharded: DataFrame, members: DataFrame, levels: int, n: int, held: int) -> DataFrame:
    """The nodes of subtrees of many levels, with what comes to each block of levels from the blocks below.

    Totals inside blocks go from block root to block root, a tree with a
    ``levels``-th of the nodes, and from each root to its parent in the block above.
    """
    keys = [*_KEY, "depth"]
    below = sharded.where("top and block > 0")
    order = [F.desc("depth"), "k1", "k2"]
    known = sharded.join(_to_parents(below), keys, "left").withColumn("more_children", F.coalesce("c", F.lit(0))).drop("c")
    inside = pass_up(known.repartition(n, "s1", "s2", "block").sortWithinPartitions(*order), held).where("top")
    tops = inside.drop("top", "p1", "p2").join(sharded.where("top").select(*keys, "s1", "s2", "block"), keys)
    # The root of the block above is where the same conversation was so many levels before.
    above = members.select("conv_id", (F.col("depth") + levels).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"))
    tops = tops.join(above, ["conv_id", "depth"], "left")
    zero = F.lit(0).cast("long")
    vertices = tops.select(
        *_KEY, "s1", "s2", F.col("block").alias("depth"), *(F.coalesce(c, zero).alias(c) for c in _UP), "conv_id", F.lit(1).cast("long").alias("n_convs"), zero.alias("words"),
        (F.col("block") == 0).alias("top"), F.col("n_children").alias("more_children"), F.col("n_leaves").alias("more_leaves"), F.col("saved_tokens").alias("more_saved"),
    )
    totals = pass_up(vertices.repartition(n, "s1", "s2").sortWithinPartitions(*order), held).where("depth > 0").select(*_KEY, "n_leaves", "saved_tokens")
    sent = _to_parents(below.join(totals, _KEY), F.sum("n_leaves").alias("l"), F.sum("saved_tokens").alias("s"))
    more = {m: F.coalesce(c, F.lit(0)) for m, c in (("more_children", "c"), ("more_leaves", "l"), ("more_saved", "s"))}
    return sharded.join(sent, keys, "left").withColumns(more).drop("c", "l", "s")


def trie(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", light: int = LIGHT, levels: int = LEVELS, held: int = HELD) -> DataFrame:
    """One row per node of the trie of the rebuilt conversations.

    Columns: conv_id (the smallest member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256. Turns are in the order of
    their number, null first; turns of one number are in the order of the MD5 of
    role and text, and repeated rows are turns of their own. A null role or text
    is empty; rows without a conversation are left out. Texts of any length are
    read whole, but only their digests are shuffled. Other columns, whatever
    their names, are left out. An empty table gives no rows.

    ``light`` is the number of members up to which a node belongs to a shard; of
    larger nodes there are ``SHARE`` per level at most. A shard holds ``levels``
    levels of a subtree and is read as a stream in reverse level order; its queue
    holds ``held`` messages and writes the rest to files. So neither one
    conversation nor one beginning that holds a third of all rows is one task's.
    """
    members = materialise(_members(materialise(_rebuilt(_slim(rows, conv_col, turn_col, role_col, text_col)), "turns")), "members")
    # One row per conversation and node; nodes of many members are added up before the shuffle.
    grouped = members.groupBy("k1", "k2", "depth").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.min("words").alias("words"))
    nodes = materialise(grouped, "nodes")
    total, deepest = nodes.agg(F.max("n_convs"), F.max("depth")).first()
    total, deep = total or 0, (deepest or 0) >= levels
    limit = max(light, total // SHARE)
    none = {c: F.lit(0).cast("long") for c in ("more_children", "more_leaves", "more_saved")}
    is_heavy = (F.col("n_convs") > limit) | (F.col("depth") == 0)
    heavy, below = nodes.where(is_heavy), nodes.where(~is_heavy)
    above = heavy.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), (F.col("depth") + 1).alias("depth"))
    # The subtree that a conversation leaves the heavy nodes by: its node there is the shard's root.
    hung = members.where("depth > 0").join(above, ["p1", "p2", "depth"], "left_semi")
    hung = hung.join(heavy.select(*_KEY, "depth"), [*_KEY, "depth"], "left_anti").select("conv_id", F.col("k1").alias("s1"), F.col("k2").alias("s2"), F.col("depth").alias("top_depth"))
    inside = F.col("depth") - F.col("top_depth")
    sharded = below.join(hung, "conv_id").withColumns({"block": F.floor(inside / levels), "top": inside % levels == 0, **none})
    order = [F.desc("depth"), "k1", "k2"]
    n = width(rows.sparkSession)
    if deep:
        sharded = _with_blocks_below(materialise(sharded, "sharded"), members, levels, n, held)
    done = materialise(pass_up(sharded.repartition(n, "s1", "s2", "block").sortWithinPartitions(*order), held), "shards")
    roots = done.where("top")
    sent = _to_parents(roots, F.sum("n_leaves").alias("l"), F.sum("saved_tokens").alias("s"))
    upper = heavy.join(sent, [*_KEY, "depth"], "left").withColumns({"top": F.col("depth") == 0, **{m: F.coalesce(c, F.lit(0)) for m, c in zip(none, ("c", "l", "s"))}})
    upper = pass_up(upper.repartition(1).sortWithinPartitions(*order), held)
    parents = (nodes if deep else heavy).select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("parent_conv_id"))
    named = roots.drop("parent_conv_id").join(parents, ["p1", "p2", "depth"])
    found = done.where("not top").unionByName(named).unionByName(upper)
    found = found.join(_digests(members), [*_KEY, "depth"], "left")
    return found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(_NO_ENDS)).alias("ends_sha256"))


#: DuckDB SQL for op11 over the table conversations.
TRIE_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
c AS (
  SELECT conv_id, list({'r': role, 't': text} ORDER BY turn NULLS FIRST, md5(length(role) || ':' || role || text)) AS own,
         xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda d: [ord(d)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
           lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END), 4294967295) % 4 AS h
  FROM t GROUP BY conv_id),
s AS (
  SELECT c.conv_id, list_concat(coalesce(b.own[1:c.h], []), c.own[c.h + 1:]) AS seq FROM c LEFT JOIN c b ON b.conv_id = c.conv_id - c.conv_id % 20),
m AS (
  SELECT conv_id, len(seq) AS size, depth, seq[depth].t AS text, list_transform(range(0, depth + 1), lambda d: md5(seq[1:d]::VARCHAR)) AS path
  FROM (SELECT *, unnest(range(0, len(seq) + 1)) AS depth FROM s)),
n AS (
  SELECT depth, path, min(conv_id) AS conv_id, count(*) AS n_convs, min(len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> ''))) AS words,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (size = depth), '')) AS ends_sha256
  FROM m GROUP BY depth, path),
k AS (SELECT path[depth] AS up, depth - 1 AS depth, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1, 2),
f AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k ON k.up = n.path[-1] AND k.depth = n.depth),
a AS (
  SELECT key, d, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END)::BIGINT AS n_leaves, sum((n_convs - 1) * words)::BIGINT AS saved_tokens
  FROM (SELECT *, unnest(path) AS key, unnest(range(0, len(path))) AS d FROM f) GROUP BY key, d)
SELECT f.conv_id, f.depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children, n_leaves, saved_tokens, f.ends_sha256
FROM f JOIN a ON a.key = f.path[-1] AND a.d = f.depth LEFT JOIN n p ON p.depth = f.depth - 1 AND p.path[-1] = f.path[f.depth]
"""
