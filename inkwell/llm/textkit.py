"""Byte-level helpers on NumPy arrays for code that runs inside tasks.

They take the UTF-8 bytes of a whole Arrow column at once, so that Python does
no work per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa

_SPACES = [0x20, *range(0x09, 0x0E)]


def byte_table(members: list[int]) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[members] = True
    return table


#: Bytes of a word: all but the six ASCII white-space characters.
NOT_SPACE = ~byte_table(_SPACES)


def _valid(texts: pa.Array) -> pa.Array:
    """The texts, with what isn't UTF-8 replaced; Spark hands such bytes on as they are."""
    try:
        texts.validate(full=True)
        return texts
    except pa.ArrowInvalid:
        raw = texts.view(pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary())
        return pa.array([x if x is None else x.decode("utf-8", "replace") for x in raw.to_pylist()], pa.string())


def blocks(batches: Iterator[pa.RecordBatch], text: str, limit: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with about ``limit`` bytes of text: rows, bytes, and n + 1 offsets.

    A single longer text is a slice of its own. Null texts count as empty; bytes
    that aren't UTF-8 count as U+FFFD each.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        column = _valid(batch.column(batch.schema.get_field_index(text))).fill_null("").cast(pa.large_string())
        offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
        data = column.buffers()[2]
        data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
        at = 0
        while at < len(column):
            to = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
            to = min(max(to, at + 1), len(column))
            own = offsets[at : to + 1]
            yield batch.slice(at, to - at), data[own[0] : own[-1]], own - own[0]
            at = to


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True; a run ends where a text ends."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edges = offsets[(offsets > 0) & (offsets < n)]
    before = np.empty(n, dtype=bool)
    before[0] = False
    before[1:] = inside[:-1]
    before[edges] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(n, dtype=bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after[edges - 1] = False
    return starts, np.flatnonzero(inside & ~after) + 1


_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2 ** 64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 16)
        _powers[:] = [np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b)])) for b in (_BASE, _BACK)]
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, limit: int = 1 << 20) -> np.ndarray:
    """A 64-bit hash of each span, from prefix sums of a polynomial; spans are in order and don't overlap.

    About ``limit`` values are worked on at a time.
    """
    out = np.empty(len(starts), dtype=np.uint64)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + limit, side="right")))
        low, high = int(starts[at]), int(ends[to - 1])
        forth, back = powers(high - low + 1)
        sums = np.zeros(high - low + 1, dtype=np.uint64)
        np.cumsum((data[low:high].astype(np.uint64) + np.uint64(1)) * forth[: high - low], out=sums[1:])
        out[at:to] = mix((sums[ends[at:to] - low] - sums[starts[at:to] - low]) * back[starts[at:to] - low])
        at = to
    return out


def same_bytes(a: np.ndarray, a_starts: np.ndarray, b: np.ndarray, b_starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether each span of ``a`` holds the same as the one of ``b`` that is as long."""
    stop = np.cumsum(size)
    of = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(of)) - (stop - size)[of]
    out = np.ones(len(size), dtype=bool)
    out[of[a[a_starts[of] + place] != b[b_starts[of] + place]]] = False
    return out


def distinct_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, kind: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A first occurrence of each distinct span (of one ``kind``), the place among these of every span, and the first ones' hashes.

    Spans are grouped by a hash and every one is compared with its group's first; groups that hold
    different spans are taken apart. Spans are in order and don't overlap.
    """
    n = len(starts)
    hashes = span_hashes(data, starts, ends)
    if kind is not None:
        hashes ^= mix(kind.astype(np.uint64) + np.uint64(1))
    back, own = pd.factorize(hashes)
    first = np.empty(len(own), np.int64)
    first[back[::-1]] = np.arange(n - 1, -1, -1)
    size, to = ends - starts, first[back]
    wrong = size[to] != size
    if kind is not None:
        wrong |= kind[to] != kind
    other = np.flatnonzero(~wrong & (to != np.arange(n)))
    for at in range(0, len(other), 1 << 16):
        some = other[at : at + (1 << 16)]
        wrong[some] = ~same_bytes(data, starts[some], data, starts[to[some]], size[some])
    if wrong.any():
        found: dict[tuple[int, bytes], int] = {}
        firsts = first.tolist()
        for i in np.flatnonzero(wrong).tolist():
            key = (0 if kind is None else int(kind[i]), data[starts[i] : ends[i]].tobytes())
            if key not in found:
                found[key] = len(firsts)
                firsts.append(i)
            back[i] = found[key]
        first = np.array(firsts, np.int64)
    return first, back, hashes[first]


def sums_between(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of ``values`` between neighbouring offsets (0 for an empty stretch)."""
    total = np.zeros(len(values) + 1, dtype=np.int64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]
