"""Near copies by SimHash tries, with the exact Jaccard similarity of word shingles at the end.

Texts of similarity 0.8 differ in about ten of 64 fingerprint bits, too many for
blocks of equal bits. So the tries are built per shingle instead: a distinct set
is dealt out to the tries of its first shingles, in an order in which shingles
that many texts have come last. A trie is joined with itself under a Hamming
budget that similar texts keep to; sizes, places and the first shingles of both
then drop most other pairs. What hangs together by these links is compared
exactly, in groups of bounded size.

A set of n shingles goes to ``n - ceil(percent * n / 100) + 1`` tries, which
loses no pair, or to fewer if the chance that two similar sets have none of them
in common is below ``exp(-SURE)``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lean, materialise, small_batches, width
from .components import component_labels
from .simhash import BROADCAST_GROUPS, BROADCAST_IDS, keep_least, simhash_of_hashes, sliced, text_hashes, trie_links
from .textkit import blocks

#: Shingles that come last in the order: those that one of so many texts hold, and so many texts at least; the most frequent
#: RANKED of them. None of these changes which pairs are similar.
SHARE, COMMON, RANKED = 2500, 8, 200_000
#: Bytes of text whose shingles are counted in one task.
COUNTED = 4 << 20
#: Bits in which fingerprints of similar texts may differ: the mean is 10, and 28 six deviations above it.
BUDGET = 28
#: Minus the logarithm of the chance to lose a pair by the choice of tries.
SURE = 20.7
#: Shingles that are compared before two texts become candidates, and how many of them have to agree.
HEAD, AGREE = 16, 3
#: Sets in one exact comparison, per side, and rows of a trie that a task holds whole.
SLICE, CROWD = 1024, 4096
#: Rows of tries in one task, and shingles that one set is compared with at a time.
DEALT, COMPARED = 100_000, 1 << 17


def _set(text: bytes, words: int, seed: int) -> np.ndarray:
    return np.unique(text_hashes(text, words, seed))


def _key(own: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(own.astype("<u8").tobytes(), 1)


def common_shingles(docs: DataFrame, words: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, sorted, and counts of the shingles that many texts hold; every shingle of every text is counted.

    Hashes are dealt out by their values, packed by block, so a task counts all of its own.
    """
    rows, size = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    parts = max(width(docs.sparkSession), -(-size // COUNTED))
    least = max(COMMON, rows // SHARE)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, data, offsets in blocks(batches, "text"):
            raw = data.tobytes()
            own = np.concatenate([_set(raw[a:b], words, seed) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())])
            to = (own % np.uint64(parts)).astype(np.int64)
            own = own[np.argsort(to, kind="stable")].astype("<u8")
            stop = np.cumsum(np.bincount(to, minlength=parts))
            some = np.flatnonzero(np.diff(stop, prepend=0))
            packed = [own[stop[k - 1] if k else 0 : stop[k]].tobytes() for k in some.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(packed, pa.binary())], names=["part", "hashes"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [np.frombuffer(x, "<u8") for batch in batches for x in batch.column(1).to_pylist()]
        if own:
            h, n = np.unique(np.concatenate(own), return_counts=True)
            often = n >= least
            yield pa.RecordBatch.from_arrays([pa.array(h[often].view(np.int64)), pa.array(n[often].astype(np.int64))], names=["h", "n"])

    found = docs.select("text").mapInArrow(lean(deal), "part long, hashes binary").repartition(parts, "part").mapInArrow(lean(count), "h long, n long")
    with small_batches(docs.sparkSession):
        found = found.orderBy(F.desc("n"), "h").limit(RANKED).toPandas()
    hashes, counts = found["h"].to_numpy(np.int64).view(np.uint64), found["n"].to_numpy(np.int64)
    order = np.argsort(hashes)
    return hashes[order], counts[order]


def first_shingles(own: np.ndarray, ranked: np.ndarray, counts: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingles by whose tries a set is dealt out, in order, and 16 bits each of its first ones (zeros: not to be compared)."""
    n = len(own)
    rank = np.zeros(n, np.int64)
    if len(ranked):
        at = np.minimum(np.searchsorted(ranked, own), len(ranked) - 1)
        rank = np.where(ranked[at] == own, counts[at], 0)
    order = own if not rank.any() else own[np.lexsort((own, rank))]
    rare = int((rank == 0).sum())
    most = n + (percent * n) // -100 + 1
    apart = (100 - percent) * n / 100 / rare if rare else 1.0
    if apart < 1:
        most = min(most, math.ceil(SURE / -math.log(apart))) if apart > 0 else 1
    head = np.zeros(HEAD, np.uint16)
    if apart <= 0.25:
        first = order[: min(HEAD, rare)].astype(np.uint16)
        head[: len(first)] = np.maximum(first, 1)
    return order[:most], head


_ROW = "doc_id long, key long, h long, fp long, n int, place int, head binary"


def dealt_sets(docs: DataFrame, words: int, seed: int, percent: int) -> DataFrame:
    """Two kinds of rows: ``(doc_id, key)`` of each text, and ``(key, h, fp, n, place, head)`` of each set and trie.

    ``key`` is a hash of the set. A task deals out equal sets once.
    """
    shared = docs.sparkSession.sparkContext.broadcast(common_shingles(docs, words, seed))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranked, counts = shared.value
        seen: set[int] = set()
        for rows, data, offsets in blocks(batches, "text", limit=1 << 18):
            raw = data.tobytes()
            sets = [_set(raw[a:b], words, seed) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            keys = [_key(own) for own in sets]
            fps = simhash_of_hashes(np.concatenate(sets), np.array([len(x) for x in sets], np.int64)).view(np.int64)
            yield _batch(rows.column(0), np.array(keys, np.uint64).view(np.int64))
            first, heads, of = [], [], []
            for i, (own, key) in enumerate(zip(sets, keys)):
                if len(own) and key not in seen:
                    seen.add(key)
                    dealt, head = first_shingles(own, ranked, counts, percent)
                    first.append(dealt)
                    heads.append(head.tobytes())
                    of.append(i)
            if not of:
                continue
            size = np.array([len(x) for x in first])
            own = np.repeat(of, size)
            place = np.arange(len(own)) - np.repeat(np.cumsum(size) - size, size)
            n = np.array([len(x) for x in sets], np.int32)
            head = pa.array(heads, pa.binary()).take(pa.array(np.repeat(np.arange(len(of)), size)))
            yield _batch(None, np.array(keys, np.uint64).view(np.int64)[own], np.concatenate(first).view(np.int64), fps[own], n[own], place.astype(np.int32), head)

    return docs.mapInArrow(lean(run), _ROW)


def _batch(ids, key: np.ndarray, *rest) -> pa.RecordBatch:
    names = ["doc_id", "key", "h", "fp", "n", "place", "head"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
    columns = [pa.nulls(len(key), pa.int64()) if ids is None else ids, pa.array(key), *rest]
    columns += [pa.nulls(len(key), t) for t in types[len(columns) :]]
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=names)


def candidate_links(sets: DataFrame, percent: int, budget: int = BUDGET) -> DataFrame:
    """Edges ``(u, v)`` among sets: all similar ones hang together by them, and few others do."""
    total = sets.count()
    parts = max(width(sets.sparkSession), -(-total // DEALT))
    share = max(CROWD, 2 * total // parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = [x for x in batches if x.num_rows]
        if not table:
            return
        h, key, fp, n, place, i, j, side = (np.concatenate([x.column(c).to_numpy() for x in table]) for c in (0, 1, 2, 3, 4, 6, 7, 8))
        head = np.concatenate([np.frombuffer(b"".join(x.column(5).to_pylist()), np.uint16) for x in table]).reshape(-1, HEAD)
        table.clear()
        fp = fp.view(np.uint64)
        order = np.lexsort((key, fp, side, j, i, h))
        h, key, fp, n, place, i, j, side, head = (x[order] for x in (h, key, fp, n, place, i, j, side, head))
        again = (key[1:] == key[:-1]) & (h[1:] == h[:-1]) & (i[1:] == i[:-1]) & (j[1:] == j[:-1])  # from several tasks
        one = np.concatenate([[True], ~again])
        h, key, fp, n, place, i, j, side, head = (x[one] for x in (h, key, fp, n, place, i, j, side, head))
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])

        def holds(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            # Of the shingles in both, the first one leaves room for all the others behind it.
            room = np.minimum(n[x] - place[x], n[y] - place[y]).astype(np.int64)
            ok = (100 + percent) * room >= percent * (n[x].astype(np.int64) + n[y])
            which = np.flatnonzero(ok & (head[x, 0] > 0) & (head[y, 0] > 0))
            for at in range(0, len(which), 1 << 13):
                own = which[at : at + (1 << 13)]
                a, b = head[x[own]], head[y[own]]
                both = ((a[:, :, None] == b[:, None, :]) & (a > 0)[:, :, None]).any(axis=2).sum(axis=1)
                need = np.minimum(AGREE, np.maximum(1, np.minimum((a > 0).sum(axis=1), (b > 0).sum(axis=1)) // 2))
                ok[own] = both >= need
            return ok

        label = trie_links(np.cumsum(new), side, fp, 0, budget, 1 << 15, holds)
        to = np.flatnonzero(label != np.arange(len(label)))
        if len(to):
            yield pa.RecordBatch.from_arrays([pa.array(key[to]), pa.array(key[label[to]])], names=["u", "v"])

    own = sliced(sets.select("h", "key", "fp", "n", "place", "head"), ["h"], share, "key")
    return own.repartition(parts, "h", "i", "j").mapInArrow(lean(run), "u long, v long").distinct()


def exact_links(keys: np.ndarray, sides: np.ndarray, parts: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Enough pairs of similar sets of a group to connect all that are; with sides 1 and 2 only pairs across count.

    Sets of one part hang together already.
    """
    size = np.array([len(x) for x in sets])
    start = np.cumsum(size) - size
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    mark = np.zeros(len(flat) + 1, dtype=bool)
    label, links = np.unique(parts, return_inverse=True)[1], []
    for i in range(len(keys) - 1):
        fits = (100 * np.minimum(size[i], size[i + 1 :]) >= percent * np.maximum(size[i], size[i + 1 :])) & (label[i + 1 :] != label[i])
        if sides[i]:
            fits &= sides[i + 1 :] != sides[i]
        other = i + 1 + np.flatnonzero(fits)
        if not len(other):
            continue
        mine = flat[start[i] : start[i] + size[i]]
        mark[mine] = True
        stop = np.cumsum(size[other])
        both = np.empty(len(other), np.int64)
        at = 0
        while at < len(other):  # some hundred thousand shingles at a time
            before = int(stop[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(stop, before + COMPARED, side="right")))
            own, last = size[other[at:to]], stop[at:to] - before
            held = mark[flat[np.repeat(start[other[at:to]] - (last - own), own) + np.arange(int(last[-1]))]]
            both[at:to] = np.add.reduceat(held.astype(np.int64), last - own)
            at = to
        mark[mine] = False
        for k in other[100 * both >= percent * (size[i] + size[other] - both)].tolist():
            if label[k] != label[i]:
                links.append((int(keys[i]), int(keys[k])))
                label[label == label[k]] = label[i]
    return links


def similar_links(docs: DataFrame, rows: DataFrame, labels: DataFrame, words: int, seed: int, percent: int) -> DataFrame:
    """Edges ``(u, v)`` of similar sets, enough to connect all that are, within each group of ``labels`` (node, root)."""
    few = labels.count() <= BROADCAST_IDS
    own = F.broadcast(labels) if few else labels
    ids = rows.where("doc_id is not null").join(own, F.col("key") == F.col("node")).groupBy("key").agg(F.min("doc_id").alias("_id"))
    ids = materialise(ids.select("_id").distinct(), "ids")
    texts = docs.join(F.broadcast(ids) if few else ids, F.col("doc_id") == F.col("_id"), "left_semi").select("text")

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for _, data, offsets in blocks(batches, "text", limit=1 << 18):
            raw, keys, sets = data.tobytes(), [], []
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                one = _set(raw[a:b], words, seed)
                if (key := _key(one)) not in seen:
                    seen.add(key)
                    keys.append(key)
                    sets.append(one.astype("<u8").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(np.array(keys, np.uint64).view(np.int64)), pa.array(sets, pa.binary())], names=["key", "shingles"])

    sets = texts.mapInArrow(lean(keyed), "key long, shingles binary").join(own, F.col("key") == F.col("node")).select("root", "key", "shingles")
    return grouped_links(materialise(sets, "sets"), percent)


def _weight() -> Column:
    """Long texts count for several: a slice has about as many shingles as SLICE texts of 1,024 have."""
    return 1 + F.length("shingles") / 8192


def _slices(weight: Column) -> Column:
    return F.ceil(weight / SLICE).cast("int")


def _deal(i: Column, j: Column, side: Column | int) -> Column:
    return F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), (F.lit(side) if isinstance(side, int) else side).cast("int").alias("side"))


def grouped_links(sets: DataFrame, percent: int) -> DataFrame:
    """Edges of similar sets within each group ``root`` of ``(root, key, shingles)``.

    A group of more than SLICE sets is cut into slices. First each slice is
    compared in itself and with the next one, by which near copies of one text
    mostly hang together. Then what is outside the group's largest part is
    compared with everything, the sets of the largest part with these alone. So
    no pair is left out, and a large group of near copies takes no more than a
    few copies of its sets.
    """
    crowded = sets.groupBy("root").agg(F.sum(_weight()).alias("weight")).where(F.col("weight") > SLICE)
    crowded = materialise(crowded.select(F.col("root").alias("of"), _slices(F.col("weight")).alias("slices")), "crowded")
    n = crowded.count()
    if not n:
        return compared(sets.withColumns({"part": F.col("key"), "i": F.lit(0), "j": F.lit(0), "side": F.lit(0)}), percent)
    few = F.broadcast if n <= BROADCAST_GROUPS else lambda x: x
    placed = sets.join(few(crowded), F.col("root") == F.col("of"), "left").withColumn("slices", F.coalesce("slices", F.lit(1)))
    s, m = F.pmod(F.xxhash64("key"), F.col("slices")), F.col("slices")
    ring = F.array(_deal(s, s, 0), _deal(s, (s + 1) % m, 1), _deal((s + m - 1) % m, s, 2))
    dealt = placed.select("root", "key", "shingles", F.col("key").alias("part"), F.explode(F.when(m > 1, ring).otherwise(F.slice(ring, 1, 1))).alias("d"))
    first = materialise(compared(dealt.select("root", "key", "shingles", "part", "d.*"), percent), "links")

    tops = component_labels(first).select(F.col("node").alias("key"), F.col("root").alias("top"))
    rows = placed.where("slices > 1").join(tops, "key", "left").select("root", "key", "shingles", F.coalesce("top", "key").alias("part"))
    rows = materialise(rows, "parts")
    sizes = rows.groupBy("root", "part").agg(F.count("*").alias("n"), F.sum(_weight()).alias("weight"))
    sizes = sizes.groupBy("root").agg(F.max_by(F.struct("part", "weight"), F.struct("n", "part")).alias("most"), F.sum("weight").alias("weight"))
    rest = F.col("weight") - F.col("most.weight")
    sizes = materialise(sizes.select(F.col("root").alias("of"), F.col("most.part").alias("largest"), _slices(F.col("most.weight")).alias("g"), _slices(rest).alias("r")).where("r > 0"), "sizes")
    inside = F.col("part") == F.col("largest")
    rows = rows.join(few(sizes), F.col("root") == F.col("of"))
    s = F.pmod(F.xxhash64("key"), F.when(inside, F.col("g")).otherwise(F.col("r")))

    def pair(o: Column) -> Column:
        return _deal(F.least(s, o), F.greatest(s, o), F.when(s == o, 0).when(s < o, 1).otherwise(2))

    others = F.transform(F.sequence(F.lit(0), F.col("r") - 1), pair)
    outside = F.concat(others, F.transform(F.sequence(F.lit(0), F.col("g") - 1), lambda b: _deal(s, -1 - b, 1)))
    large = F.transform(F.sequence(F.lit(0), F.col("r") - 1), lambda a: _deal(a, -1 - s, 2))
    dealt = rows.select("root", "key", "shingles", "part", F.explode(F.when(inside, large).otherwise(outside)).alias("d"))
    return first.unionByName(compared(dealt.select("root", "key", "shingles", "part", "d.*"), percent))


def compared(dealt: DataFrame, percent: int) -> DataFrame:
    """Edges ``(u, v)`` within each group ``(root, i, j)`` of ``(root, key, shingles, part, i, j, side)``."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in chain(batches, [None]):
            if batch is not None:
                rest = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            if rest is None or not rest.num_rows:
                continue
            root, i, j = (rest.column(c).to_numpy() for c in ("root", "i", "j"))
            cut = np.flatnonzero((root[1:] != root[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
            cut = np.concatenate([[0], cut, [len(root)]] if batch is None else [[0], cut])
            links: list[tuple[int, int]] = []
            for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
                group = rest.slice(a, b - a)
                keys, first = np.unique(group.column("key").to_numpy(), return_index=True)
                if len(keys) > 1:
                    own = group.column("shingles").take(pa.array(first)).to_pylist()
                    side, part = (group.column(c).to_numpy()[first] for c in ("side", "part"))
                    links += exact_links(keys, side, part, [np.frombuffer(x, "<u8") for x in own], percent)
            rest = rest.slice(int(cut[-1]))
            if links:
                u, v = zip(*links)
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    parts = width(dealt.sparkSession)
    return dealt.repartition(parts, "root", "i", "j").sortWithinPartitions("root", "i", "j").mapInArrow(lean(compare), "u long, v long")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80, seed: int = 42) -> DataFrame:
    """One row ``(doc_id, component_id)`` per document with an id; ``component_id`` is the smallest id reachable over similar texts.

    Words are lowered in A-Z and cut at ASCII white space, as for fingerprints.
    A text of fewer words is one shingle. Texts with equal sets are in one
    component, also the null, empty and wordless ones. Repeated rows all have
    their row; rows without an id link nothing and have none. Texts of any
    length are compared whole. An empty table gives no rows.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null")
    rows = materialise(dealt_sets(docs, words, seed, percent), "dealt_sets")
    labels = component_labels(candidate_links(rows.where("h is not null"), percent))
    labels = component_labels(similar_links(docs, rows, labels, words, seed, percent))
    rows = rows.where("doc_id is not null").select("doc_id", "key")
    sets = rows.groupBy("key").agg(F.min("doc_id").alias("least"))
    linked = materialise(sets.join(F.broadcast(labels) if labels.count() <= BROADCAST_IDS else labels, F.col("key") == F.col("node")).select("key", "root", "least"), "linked")
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    linked = linked.join(least, "root").select("key", "component_id")
    each = sets.join(linked, "key", "left").select("key", F.coalesce("component_id", "least").alias("component_id"))
    return rows.join(each, "key").select("doc_id", "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Rows of the one document that stays of each component, as ``simhash.keep_first`` has it."""
    return keep_least(docs, near_copies(docs, id_col, text_col, **options), id_col)
