"""SimHash near-duplicates by a binary-trie self-join.

Fingerprints that link differ in at most ``budget`` of 64 bits. The 64 bits
are cut into ``budget + 1`` blocks, so a linked pair agrees on one block at
least: each distinct fingerprint is dealt out once per block, rotated so that
this block is the top of a binary trie. Within a task all tries are walked
together, as pairs of nodes that carry the bits in which they differ so far;
a pair is dropped when these exceed the budget. Pairs of nodes whose leaves
are already known to hang together are dropped too, and a task returns one
edge per fingerprint, not every pair.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, width
from .components import component_labels
from .textkit import blocks

BITS = 64
#: A table of crowded groups, or of ids that go, is broadcast up to this number of rows.
BROADCAST_GROUPS, BROADCAST_IDS = 100_000, 2_000_000
_LANES = np.uint64(0x0101010101010101)


def simhash_of_hashes(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Fingerprints of documents whose shingle hashes stand one after another; ``counts`` per document.

    A bit is set if it is set in over half of the document's hashes. A document without shingles has 0.
    """
    out = np.zeros(len(counts), dtype=np.uint64)
    some = np.flatnonzero(counts)
    if not len(some):
        return out
    # Sums are kept in eight byte lanes, so a chunk has at most 255 hashes.
    pieces = (counts[some] + 254) // 255
    first = np.concatenate([[0], np.cumsum(counts[some])[:-1]])
    of = np.repeat(np.arange(len(some)), pieces)
    chunk = first[of] + 255 * (np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    doc = np.cumsum(pieces) - pieces
    half = counts[some].astype(np.int64)
    for bit in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(bit)) & _LANES, chunk)
        sums = np.add.reduceat(lanes.astype("<u8").view(np.uint8).reshape(-1, 8).astype(np.int64), doc, axis=0)
        on = (2 * sums > half[:, None]).astype(np.uint64)
        for byte in range(8):
            out[some] |= on[:, byte] << np.uint64(8 * byte + bit)
    return out


def text_hashes(text: bytes, words: int, seed: int) -> np.ndarray:
    """XXH64 of the text's word shingles, repeats included; a shorter text is one shingle."""
    own = text.lower().split()  # bytes: only A-Z are lowered, and only ASCII white space splits
    if not own:
        return np.zeros(0, np.uint64)
    if len(own) <= words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(own), seed)], dtype=np.uint64)
    n = len(own) - words + 1
    shingles = map(b" ".join, zip(*(own[i:] for i in range(words))))
    return np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(seed)), dtype=np.uint64, count=n)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, seed: int = 42) -> DataFrame:
    """``(doc_id, fp)`` for every row; ``fp`` holds the 64 bits as a signed long. Null or wordless texts have 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in blocks(batches, "text"):
            raw = data.tobytes()
            each = [text_hashes(raw[a:b], words, seed) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            counts = np.array([len(x) for x in each], dtype=np.int64)
            fps = simhash_of_hashes(np.concatenate(each), counts)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long")


class _Forest:
    """Components of the leaves of one task."""

    def __init__(self, n: int):
        self.label = np.arange(n)
        self._runs()

    def _runs(self) -> None:
        n = len(self.label)
        last = np.flatnonzero(np.append(self.label[1:] != self.label[:-1], True)) + 1
        self.run_end = np.repeat(last, np.diff(np.concatenate([[0], last]))) if n else last

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        label = self.label
        while True:
            x, y = label[a], label[b]
            apart = x != y
            if not apart.any():
                break
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = label[label]
                if (up == label).all():
                    break
                label[:] = up
        self._runs()

    def joined(self, a_lo, a_hi, b_lo, b_hi) -> np.ndarray:
        """Whether all leaves of both nodes are in one component already."""
        return (self.run_end[a_lo] >= a_hi) & (self.run_end[b_lo] >= b_hi) & (self.label[a_lo] == self.label[b_lo])


def _leaf_pairs(a_lo: np.ndarray, a_hi: np.ndarray, b_lo: np.ndarray, b_hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of a leaf of one node and a leaf of the other; within one node each pair once."""
    wide = b_hi - b_lo
    n = (a_hi - a_lo) * wide
    of = np.repeat(np.arange(len(n)), n)
    k = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    x, y = a_lo[of] + k // wide[of], b_lo[of] + k % wide[of]
    once = (a_lo[of] != b_lo[of]) | (x < y)
    return x[once], y[once]


def trie_links(
    tries: np.ndarray,
    side: np.ndarray,
    keys: np.ndarray,
    top: int,
    budget: int,
    frontier: int = 1 << 20,
    holds: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None,
) -> np.ndarray:
    """Component label per row for many tries at once.

    ``keys`` are sorted within each trie, and rows of one trie (and side) stand
    together; ``side`` is 0 for a trie that is joined with itself, else 1 and 2
    for the two tries of a pair, in this order. Keys of one trie agree on their
    ``top`` leading bits. ``holds`` says which of some pairs of rows within the
    budget link; without it all do, and the keys of a trie are distinct.
    """
    n = len(keys)
    forest = _Forest(n)
    if n < 2:
        return forest.label
    cuts = np.flatnonzero((tries[1:] != tries[:-1]) | (side[1:] != side[:-1])) + 1
    lo, hi = np.concatenate([[0], cuts]), np.concatenate([cuts, [n]])
    own = side[lo] == 0
    left = np.flatnonzero((side[lo] == 1) & (np.append(tries[lo][1:], -1) == tries[lo]))
    roots = [np.stack([lo[own], hi[own], lo[own], hi[own]]), np.stack([lo[left], hi[left], lo[left + 1], hi[left + 1]])]
    roots = np.concatenate(roots, axis=1).astype(np.int64)
    roots = roots[:, (roots[1] - roots[0] > 1) | (roots[0] != roots[2])]
    ones = [None] * BITS
    stack = [(top, roots, np.zeros(roots.shape[1], np.int64))]
    while stack:
        depth, pairs, apart = stack.pop()
        if pairs.shape[1] > frontier:
            for cut in range(0, pairs.shape[1], frontier):
                stack.append((depth, pairs[:, cut : cut + frontier], apart[cut : cut + frontier]))
            continue
        a_lo, a_hi, b_lo, b_hi = pairs
        keep = ~forest.joined(a_lo, a_hi, b_lo, b_hi)
        single = keep & (a_hi - a_lo == 1) & (b_hi - b_lo == 1)
        if single.any():
            x, y = a_lo[single], b_lo[single]
            near = np.bitwise_count(keys[x] ^ keys[y]) <= budget
            if holds is not None:
                near[near] = holds(x[near], y[near])
            if near.any():
                forest.link(x[near], y[near])
        keep &= ~single
        if not keep.any():
            continue
        a_lo, a_hi, b_lo, b_hi, apart = a_lo[keep], a_hi[keep], b_lo[keep], b_hi[keep], apart[keep]
        if depth == BITS:  # equal to the last bit but for what is counted: both are within the budget
            x, y = _leaf_pairs(a_lo, a_hi, b_lo, b_hi)
            near = np.ones(len(x), dtype=bool) if holds is None else holds(x, y)
            forest.link(x[near], y[near])
            continue
        if ones[depth] is None:
            ones[depth] = np.concatenate([[0], np.cumsum((keys >> np.uint64(BITS - 1 - depth)) & np.uint64(1))]).astype(np.int64)
        count = ones[depth]
        a_mid, b_mid = a_hi - (count[a_hi] - count[a_lo]), b_hi - (count[b_hi] - count[b_lo])
        same = (a_lo == b_lo) & (a_hi == b_hi)
        down = [
            (a_lo, a_mid, b_lo, b_mid, apart, None),
            (a_mid, a_hi, b_mid, b_hi, apart, None),
            (a_lo, a_mid, b_mid, b_hi, apart + 1, None),
            (a_mid, a_hi, b_lo, b_mid, apart + 1, ~same),
        ]
        nodes, bits = [], []
        for w, x, y, z, d, ok in down:
            good = (x > w) & (z > y) & (d <= budget)
            if ok is not None:
                good &= ok
            good &= (w != y) | (x != z) | (x - w > 1)
            nodes.append(np.stack([w[good], x[good], y[good], z[good]]))
            bits.append(d[good])
        stack.append((depth + 1, np.concatenate(nodes, axis=1), np.concatenate(bits)))
    return forest.label


def sliced(rows: DataFrame, by: list[str], share: int, key: str, weight: Column | None = None) -> DataFrame:
    """``rows`` with i, j and side: a group of more than ``share`` rows (or weight) is dealt out as pairs of slices.

    Every row of slice ``own`` goes to the pairs (own, j) and (i, own); in a pair
    of two slices, side tells them apart (1 and 2), else it is 0.
    """
    # As many rows as there are crowded groups.
    crowded = rows.groupBy(*by).agg(F.sum(F.lit(1) if weight is None else weight).alias("_weight")).where(F.col("_weight") > share)
    crowded = crowded.select(*by, F.ceil(F.col("_weight") / share).cast("int").alias("_slices"))
    n = crowded.count()
    if not n:
        return rows.withColumns({"i": F.lit(0), "j": F.lit(0), "side": F.lit(0)})
    slices = F.coalesce("_slices", F.lit(1))
    return (
        rows.join(F.broadcast(crowded) if n <= BROADCAST_GROUPS else crowded, by, "left")
        .withColumn("_own", F.pmod(F.xxhash64(key), slices).cast("int"))
        .withColumn("_other", F.explode(F.sequence(F.lit(0), slices - 1)))
        .withColumns({"i": F.least("_own", "_other"), "j": F.greatest("_own", "_other")})
        .withColumn("side", F.when(F.col("i") == F.col("j"), 0).when(F.col("_own") == F.col("i"), 1).otherwise(2))
        .drop("_slices", "_own", "_other")
    )


def near_links(distinct: DataFrame, budget: int = 3, most: int = 4096) -> DataFrame:
    """Edges ``(u, v)`` among distinct fingerprints ``fp``: enough of them to connect all that link.

    A block value that more than ``most`` (and a task's mean share) fingerprints
    have is dealt out as pairs of slices, so that no task holds it whole.
    """
    spark, n_blocks = distinct.sparkSession, budget + 1
    size = BITS // n_blocks
    total = distinct.count()
    parts = max(width(spark), -(-total * n_blocks // 1_000_000))
    share = max(most, 2 * total * n_blocks // parts)

    def rotated(k: int):
        fp = F.col("fp")
        return fp if k == 0 else F.shiftleft(fp, k * size).bitwiseOR(F.shiftrightunsigned(fp, BITS - k * size))

    dealt = distinct.select(F.explode(F.array(*(F.struct(F.lit(k).alias("block"), rotated(k).alias("key")) for k in range(n_blocks)))).alias("x")).select("x.block", "x.key")
    dealt = dealt.withColumn("value", F.shiftrightunsigned("key", BITS - size))
    dealt = sliced(dealt, ["block", "value"], share, "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = [x for x in batches if x.num_rows]
        if not table:
            return
        block, i, j, side, key = (np.concatenate([x.column(c).to_numpy(zero_copy_only=False) for x in table]) for c in range(5))
        key = key.view(np.uint64)
        value = (key >> np.uint64(BITS - size)).astype(np.int64)
        order = np.lexsort((key, side, j, i, value, block))
        block, i, j, side, key, value = (x[order] for x in (block, i, j, side, key, value))
        new = np.concatenate([[True], (block[1:] != block[:-1]) | (value[1:] != value[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])
        label = trie_links(np.cumsum(new), side, key, size, budget)
        to = np.flatnonzero(label != np.arange(len(label)))
        if len(to):
            turn = (block[to] * size).astype(np.uint64)
            wide = np.uint64(BITS)

            def back(x: np.ndarray) -> pa.Array:
                return pa.array(np.where(turn > 0, (x >> turn) | (x << ((wide - turn) % wide)), x).view(np.int64))

            yield pa.RecordBatch.from_arrays([back(key[to]), back(key[label[to]])], names=["u", "v"])

    dealt = dealt.select("block", "i", "j", "side", "key", "value").repartition(parts, "block", "value", "i", "j").drop("value")
    return dealt.mapInArrow(run, "u long, v long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, seed: int = 42, budget: int = 3) -> DataFrame:
    """One row ``(doc_id, fp, component_id)`` per document; ``component_id`` is the smallest id reachable over links.

    Documents with one fingerprint are in one component, also the wordless ones
    (fingerprint 0). Repeated rows stay. A component whose ids are all null has
    a null id. Texts of any length are read whole; other columns, whatever their
    names, are left out. An empty table gives an empty result.
    """
    fps = materialise(fingerprints(docs, id_col, text_col, words, seed), "fingerprints")
    distinct = materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    labels = component_labels(near_links(distinct.select("fp"), budget))
    linked = labels.join(distinct.withColumnRenamed("fp", "node"), "node").select("node", "root", "least")
    linked = materialise(linked, "linked")
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    linked = linked.join(least, "root").select(F.col("node").alias("fp"), "component_id")
    each = distinct.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    return fps.join(each, "fp").select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Rows of the one document that stays of each component: the one with the smallest id.

    Of several rows with that id, one stays. Rows with a null id stay: no
    component can name them.
    """
    return keep_least(docs, near_duplicates(docs, id_col, text_col, **options), id_col)


def keep_least(docs: DataFrame, components: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` whose id is that of their component in ``(doc_id, component_id)``, one of each id."""
    found = materialise(components, "components")
    out = found.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("_gone")).distinct()
    kept = docs.join(F.broadcast(out) if out.count() <= BROADCAST_IDS else out, docs[id_col] == out["_gone"], "left_anti")
    again = found.where(F.col("doc_id") == F.col("component_id")).groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("_again"))
    if again.isEmpty():
        return kept
    twice = kept[id_col] == again["_again"]
    return kept.join(again, twice, "left_anti").unionByName(kept.join(again, twice, "left_semi").dropDuplicates([id_col]))
