"""Exact top-k search by inner product, by aggregation without random access.

A block of candidates is a set of sorted lists, two per component: largest value
first for positive weights, smallest first for negative ones. The lists are read
from their beginnings in growing steps. What a step has read is added to the
candidates' sums, which are lower bounds of their scores; a value that hasn't
been read is no better than the last one read of its list, which gives upper
bounds. A query stops as soon as few candidates can still reach its k-th lower
bound, or the k-th score that its task has seen in other blocks; of these few
the rest of the lists is read to the end and added.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise

#: How deep the lists are read before bounds are compared, as parts of their length.
DEPTHS = (0.05, 0.15, 0.35, 0.6, 0.8, 0.9)
#: So many queries, and so many bytes of them, go to all tasks at once; more of them take further passes over the candidates.
QUERIES, QUERY_BYTES = 100_000, 64 << 20


def whole_numbers(vector: Column, scale: int = 64) -> Column:
    """floor(scale * x) of every component; one that no 64-bit number holds raises an error."""

    def one(x: Column) -> Column:
        y = F.floor(x.cast("double") * scale)
        return F.when(F.abs(x.cast("double") * scale) < 2.0**63, y.cast("long")).otherwise(F.raise_error(F.lit("a component is beyond 64 bits")).cast("long"))

    return F.transform(vector, one)


def exact_kind(queries: np.ndarray, values: np.ndarray) -> type:
    """The fastest type of number in which no score or bound of these whole numbers is rounded."""
    most = float((np.abs(queries.astype(float)) @ np.abs(values.astype(float)).max(axis=0, initial=0)).max(initial=0)) * (1 + 1e-9)
    if most >= 2.0**63:
        raise OverflowError("scores are beyond 64 bits")
    return np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64


def is_finite(vector: Column) -> Column:
    """Whether a vector is there and all its components are numbers; never null."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))), F.lit(False))


class Lists:
    """The sorted lists of a block of candidates: first those for positive weights, then those for negative ones.

    ``gain`` is what a candidate has over the worst one of a list, in the sign that makes it no loss for the list's weights.
    """

    def __init__(self, values: np.ndarray):
        n, d = values.shape
        self.worst = np.concatenate([values.min(axis=0), values.max(axis=0)])
        self.gain = np.concatenate([values, values], axis=1) - self.worst
        order = np.argsort(values, axis=0, kind="stable")
        rank = np.empty((n, d), np.int32)
        np.put_along_axis(rank, order, np.arange(n, dtype=np.int32)[:, None], axis=0)
        self.place = np.concatenate([n - 1 - rank, rank], axis=1)
        ascending = np.take_along_axis(values, order, axis=0)
        self.read_values = np.concatenate([ascending[::-1], ascending], axis=1) - self.worst  # in the order of reading


def search_block(
    queries: np.ndarray, own: np.ndarray, lists: Lists, ids: np.ndarray, rows: np.ndarray, k: int, least: np.ndarray | None = None, depths: Sequence[float] = DEPTHS, opened: list | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query number, candidate number and score of each query's best k in one block; ties go to smaller ids.

    ``own`` are the queries' row numbers, which are no candidates of theirs.
    ``least`` is a score per query below which nothing is wanted. ``opened``
    gets the depth, the queries still reading, and their open candidates, per
    step.
    """
    n, kind = len(ids), lists.gain.dtype
    weights = np.concatenate([np.maximum(queries, 0), np.minimum(queries, 0)], axis=1)
    base = weights @ lists.worst
    bar_before = np.full(len(queries), -1, kind) if least is None else np.maximum(np.where(least == _NONE, -1, least - base), -1).astype(kind)
    column = {row: i for i, row in enumerate(rows.tolist())}
    itself = np.array([column.get(row, -1) for row in own.tolist()])
    left, sums = np.arange(len(queries)), np.zeros((len(queries), n), kind)
    at_q, at_c, at_score = [], [], []
    was, steps = 0, sorted({max(1, int(depth * n)) for depth in depths})
    for read in steps:
        if not len(left):
            break
        w = weights[left]
        sums += w @ np.where((lists.place >= was) & (lists.place < read), lists.gain, 0).T
        unread = lists.place >= read
        upper = sums + (w * lists.read_values[read - 1]) @ unread.T.astype(kind)
        here = np.flatnonzero(itself[left] >= 0)
        sums[here, itself[left][here]] = upper[here, itself[left][here]] = -1  # gains are never below zero
        bar = np.maximum(np.partition(sums, n - k, axis=1)[:, n - k] if n > k else np.full(len(left), 0, kind), bar_before[left])
        open_ = (upper >= bar[:, None]) & (upper >= 0)
        size = open_.sum(axis=1)
        if opened is not None:
            opened.append((read / n, len(left), int(size.sum())))
        done = np.full(len(left), True) if read == steps[-1] else size <= 4 * k
        if done.any():
            q, c = np.nonzero(open_[done])
            rest = np.where(unread, lists.gain, 0)
            q = np.flatnonzero(done)[q]
            for at in range(0, len(q), 1 << 16):
                i, j = q[at : at + (1 << 16)], c[at : at + (1 << 16)]
                at_score.append(sums[i, j] + np.einsum("ij,ij->i", w[i], rest[j]))
            at_q.append(left[q])
            at_c.append(c)
            left, sums = left[~done], sums[~done]
        was = read
    wide = np.int64 if kind.kind == "i" else np.float64
    q, c = np.concatenate([np.zeros(0, np.int64), *at_q]), np.concatenate([np.zeros(0, np.int64), *at_c])
    score = np.concatenate([np.zeros(0, wide), *at_score]).astype(wide) + base.astype(wide)[q]
    return best_of(q, c, score, ids[c], k)


def best_of(q: np.ndarray, c: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k highest scores of each query, ties to smaller ids."""
    order = np.lexsort((ids, -score, q))  # no score is the least number of its type
    q, c, score = q[order], c[order], score[order]
    keep = np.arange(len(q)) - np.searchsorted(q, q) < k
    return q[keep], c[keep], score[keep]


_NUMBERS = {"tinyint": np.int8, "smallint": np.int16, "int": np.int32, "bigint": np.int64}
_NONE = np.iinfo(np.int64).min


def _matrix(vectors: pa.ListArray, number: str) -> np.ndarray:
    """Vectors as rows; shorter ones are filled up with zeros."""
    length = vectors.value_lengths().to_numpy()
    values = np.zeros((len(length), max(1, int(length.max(initial=0)))), dtype=_NUMBERS[number])
    values[np.arange(values.shape[1])[None, :] < length[:, None]] = vectors.flatten().to_numpy()
    return values


def _meet(q: np.ndarray, q_rows: np.ndarray, c: np.ndarray, c_rows: np.ndarray, c_ids: np.ndarray, k: int, depths: Sequence[float], least: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``search_block`` on whole numbers; vectors of fewer components are filled up with zeros."""
    dim = max(q.shape[1], c.shape[1])
    q, c = (np.pad(x, ((0, 0), (0, dim - x.shape[1]))) for x in (q, c))
    kind = exact_kind(q, c)
    i, j, score = search_block(q.astype(kind), q_rows, Lists(c.astype(kind)), c_ids, c_rows, k, least, depths)
    return i, j, score.astype(np.int64)


def top_k(
    vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", depths: Sequence[float] = DEPTHS, query_block: int = 1024, candidate_block: int = 4096
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k best other rows of each row where ``is_query`` holds.

    Components have to be whole numbers; scores beyond 64 bits raise an error,
    all others are exact. Equal scores are in the order of their ids. Vectors that
    are null, or hold null or components that are not finite, take no part; nor
    do rows with a null id. A shorter vector counts as filled up with zeros;
    vectors of any length are read whole, of long ones fewer make a block. Rows
    with equal ids are rows of their own: only a query's own row is not its
    candidate. Other columns are left out. An empty table, or one without
    queries, gives no rows. Queries of a checked number of bytes go to the tasks
    that read the candidates, and no candidate is shuffled; more queries take
    further passes.
    """
    vector = F.col(vector_col)
    own = vectors.where(F.col(id_col).isNotNull() & is_finite(vector)).select(
        F.col(id_col).cast("long").alias("id"), F.transform(vector, lambda x: x.cast("long")).alias("vector"), F.coalesce(is_query, F.lit(False)).alias("query")
    )
    low, high, m, dim = own.agg(F.min(F.array_min("vector")), F.max(F.array_max("vector")), F.count_if("query"), F.max(F.size("vector"))).first()
    number = next(x for x, t in _NUMBERS.items() if np.iinfo(t).min <= (low or 0) and (high or 0) <= np.iinfo(t).max)
    own = materialise(own.withColumn("vector", F.col("vector").cast(f"array<{number}>")).withColumn("row", F.monotonically_increasing_id()), "vectors")
    size = max(1, dim or 0) * np.dtype(_NUMBERS[number]).itemsize
    passes = max(1, -(-m // max(1, min(QUERIES, QUERY_BYTES // size))))
    block = max(64, min(candidate_block, (32 << 20) // (16 * max(1, dim or 0))))  # lists of a block: 16 bytes a component and more
    found = None
    for i in range(passes):
        asked = own.where("query").where(F.pmod(F.xxhash64("row"), F.lit(passes)) == i)
        one = _one_pass(own.select("row", "id", "vector"), asked.select("row", "id", "vector"), number, k, depths, query_block, block)
        found = one if found is None else found.unionByName(one)
        if passes > 1:
            found = materialise(found, "found")
    rank = F.row_number().over(W.partitionBy("query_row").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _one_pass(candidates: DataFrame, asked: DataFrame, number: str, k: int, depths: Sequence[float], query_block: int, block: int) -> DataFrame:
    """The best k of each query in each task of the candidates' scan."""
    rows = asked.toArrow()
    if not rows.num_rows:
        return candidates.sparkSession.createDataFrame([], "query_row long, query_id long, vec_id long, score long")
    rows = rows.combine_chunks().sort_by("row")
    asked = (rows.column("row").to_numpy(), rows.column("id").to_numpy(), _matrix(rows.column("vector").combine_chunks(), number))
    sent = candidates.sparkSession.sparkContext.broadcast([tuple(x[at : at + query_block] for x in asked) for at in range(0, rows.num_rows, query_block)])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [(np.zeros(0, np.int64),) * 3 for _ in sent.value]  # query number, candidate's id, score
        for part in (batch.slice(at, block) for batch in batches for at in range(0, batch.num_rows, block)):
            c_rows, c_ids, c = part.column(0).to_numpy(), part.column(1).to_numpy(), _matrix(part.column(2), number)
            for b, (q_rows, _, q) in enumerate(sent.value):
                at, ids, score = best[b]
                least = np.full(len(q_rows), _NONE)
                full = np.flatnonzero(np.bincount(at, minlength=len(q_rows)) == k)
                least[full] = score[np.searchsorted(at, full, side="right") - 1]
                i, j, more = _meet(q, q_rows, c, c_rows, c_ids, k, depths, least)
                ids = np.concatenate([ids, c_ids[j]])
                best[b] = best_of(np.concatenate([at, i]), ids, np.concatenate([score, more]), ids, k)
        for (q_rows, q_ids, _), (at, ids, score) in zip(sent.value, best):
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (q_rows[at], q_ids[at], ids, score)], names=["query_row", "query_id", "vec_id", "score"])

    return candidates.mapInArrow(read, "query_row long, query_id long, vec_id long, score long")


#: DuckDB SQL for op9 over the table embeddings.
SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e, row_number() OVER () AS r FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score,
         row_number() OVER (PARTITION BY q.r ORDER BY list_inner_product(q.e, c.e) DESC, c.vec_id)::INTEGER AS rank
  FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % 20 = 0)
SELECT query_id, rank, vec_id, score FROM scored WHERE rank <= 20
"""
