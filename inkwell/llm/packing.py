"""Best-fit packing of documents into training sequences, by sums of squares.

Every document becomes one or more pieces of at most ``capacity`` tokens. The
pieces are dealt into groups at random; a group is packed by one task. A piece
goes where the sum, over residual gaps, of the squared number of open bins
with that gap becomes smallest, among the bins that it fits in; a bin is opened
only if there is none. Pieces come in order of falling length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, materialise
from .textkit import blocks
from .tokens import byte_level, vocabulary


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece, in the order given; lengths from 1 to ``capacity``."""
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]  # by residual gap
    count = np.zeros(capacity + 1, dtype=np.int64)
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    used = 0
    for i, size in enumerate(lengths.tolist()):
        gap = capacity
        if size < capacity:
            own = count[size:capacity]
            # (a - 1)^2 + (b + 1)^2 - a^2 - b^2 for a bin of gap g = size + k that becomes one of gap k
            change = 2 * (count[: capacity - size] - own) + 2
            change[0] = 1 - 2 * own[0]  # a full bin leaves the count
            change[own == 0] = np.iinfo(np.int64).max
            k = int(change.argmin())
            if own[k]:
                gap = size + k
        if gap == capacity:
            bins[i], used = used, used + 1
        else:
            bins[i] = open_bins[gap].pop()
            count[gap] -= 1
        offsets[i] = capacity - gap
        if gap > size:
            open_bins[gap - size].append(bins[i])
            count[gap - size] += 1
    return bins, offsets


def pieces_of(docs: DataFrame, id_col: str, text_col: str, capacity: int, end_id: int, tokenizer: str, ranks: str | None, added: bool = False) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32)``: each text's ids and ``end_id``, cut from the end into full pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = byte_level(vocabulary(tokenizer), ranks and vocabulary(ranks), added)
        for rows, data, offsets in blocks(batches, "text", limit=1 << 18):
            out: list[tuple[int, int, int, int, int]] = []
            for i, own in enumerate(model.encode(data, offsets)):
                raw = np.append(own, np.uint32(end_id)).astype("<u4").tobytes()
                n = len(raw) // 4
                start, stop = 0, (n - 1) % capacity + 1
                piece = 0
                while start < n:
                    out.append((i, piece, start, stop - start, zlib.crc32(raw[4 * start : 4 * stop])))
                    start, stop, piece = stop, stop + capacity, piece + 1
            of, piece, start, length, crc = (np.array(x, dtype=np.int64) for x in zip(*out))
            yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(of)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(lean(run), schema)


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = 1024,
    end_id: int = 2,
    tokenizer: str = "byte_bpe_50k.json",
    ranks: str | None = "byte_bpe_50k.tiktoken",
    group_pieces: int = 8192,
    added: bool = False,
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null text counts as empty, so it is one piece with ``end_id`` alone. Only
    documents of more than ``capacity`` tokens are cut; all their pieces but the
    first are full. Repeated rows are packed as often as they occur, texts of any
    length whole, an empty table gives no rows; other columns, whatever their
    names, are left out. Groups have
    about ``group_pieces`` pieces whatever the input's size, so that a task's
    memory is bounded. ``ranks`` names the tokenizer's vocabulary as a rank
    file, or is None. With ``added``, as in the queries, an added token that
    stands in a text has its own id. An empty table gives no rows.
    """
    pieces = pieces_of(docs, id_col, text_col, capacity, end_id, tokenizer, ranks, added)
    pieces = materialise(pieces.withColumn("row", F.monotonically_increasing_id()), "pieces")
    groups = max(1, round(pieces.count() / group_pieces))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        length = table.column("length").to_numpy()
        order = np.lexsort((table.column("row").to_numpy(), -length))
        bins, offsets = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
        bins[order], offsets[order] = sum_of_squares(length[order], capacity)
        sequence = pa.array((int(key[0].as_py()) << 32) + bins)
        return table.select(names).append_column("sequence_id", sequence).append_column("offset", pa.array(offsets))

    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return pieces.withColumn("group", F.pmod(F.xxhash64("row"), F.lit(groups))).groupBy("group").applyInArrow(run, schema)
