"""Text quality by a convolutional network on bytes.

A text is cut into overlapping chunks of bytes that cover it to its end. Learned
filters look at neighbouring bytes of a chunk; each filter counts with its
highest answer and its mean in the chunk. A layer on top describes the chunk,
and the highest and mean values of these descriptions over all chunks give the
text's log-odds. The network is trained in NumPy on a bounded sample of labelled
texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import without
from .textkit import blocks


@dataclass(frozen=True)
class Settings:
    width: int = 4  # of a byte's embedding
    reach: int = 16  # bytes that a filter sees
    step: int = 4  # bytes between the places where filters are asked
    filters: int = 32
    hidden: int = 12
    chunk: int = 512
    hop: int = 384  # bytes between the starts of chunks
    batch: int = 48
    chunks_in_training: int = 3  # of each text, drawn anew whenever it comes up
    steps: int = 320
    rate: float = 0.01
    seed: int = 11
    #: A text counts as good from this score on.
    good: float = 0.7
    #: How many poor texts, in shares of the sample, a good one that is refused counts as.
    care: float = 4.0
    #: Bounds of the sample that is learned from: texts of either label, and characters of one such text.
    per_label: int = 1500
    max_chars: int = 20_000


def chunks(offsets: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, first byte and length of every chunk; those of a text overlap and cover it, an empty text has one of no bytes."""
    n = np.diff(offsets)
    count = 1 + np.maximum(0, -(-(n - s.chunk) // s.hop))
    text = np.repeat(np.arange(len(n)), count)
    k = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    return text, offsets[text] + k * s.hop, np.minimum(s.chunk, n[text] - k * s.hop)


@dataclass
class Network:
    s: Settings
    p: dict[str, np.ndarray] = field(default_factory=dict)
    shift: float = 0.0

    @classmethod
    def new(cls, s: Settings) -> Network:
        r = np.random.default_rng(s.seed)

        def normal(*shape, scale):
            return (r.standard_normal(shape) * scale).astype(np.float32)

        p = {
            "byte": normal(257, s.width, scale=0.5),  # the last one is for no byte
            "filter": normal(s.reach * s.width, s.filters, scale=(s.reach * s.width) ** -0.5),
            "filter0": np.zeros(s.filters, np.float32),
            "chunk": normal(2 * s.filters, s.hidden, scale=(2 * s.filters) ** -0.5),
            "chunk0": np.zeros(s.hidden, np.float32),
            "out": normal(2 * s.hidden, scale=(2 * s.hidden) ** -0.5),
            "out0": np.zeros(1, np.float32),
        }
        return cls(s, p)

    def _places(self, data: np.ndarray, first: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes that filters see, a row per place, and where each chunk's places begin. A chunk has one place at least."""
        s = self.s
        count = 1 + np.maximum(0, (length - s.reach + s.step - 1) // s.step)
        start = np.cumsum(count) - count
        place = np.arange(int(count.sum())) - np.repeat(start, count)
        at = (np.repeat(first, count) + place * s.step)[:, None] + np.arange(s.reach)
        ended = at >= np.repeat(first + length, count)[:, None]
        seen = np.full(at.shape, 256, np.int32)
        seen[~ended] = data[at[~ended]]
        return seen, start

    def describe(self, data: np.ndarray, first: np.ndarray, length: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """The description of each chunk."""
        p, s = self.p, self.s
        seen, start = self._places(data, first, length)
        x = p["byte"][seen].reshape(len(seen), -1)
        y = x @ p["filter"]
        y += p["filter0"]
        np.maximum(y, 0, out=y)
        count = np.diff(np.append(start, len(seen))).astype(np.float32)
        top = np.maximum.reduceat(y, start, axis=0)
        mean = np.add.reduceat(y, start, axis=0) / count[:, None]
        pooled = np.concatenate([top, mean], axis=1)
        out = np.tanh(pooled @ p["chunk"] + p["chunk0"])
        if keep is not None:
            keep.update(seen=seen, start=start, x=x, y=y, count=count, top=top, pooled=pooled, out=out)
        return out

    def combine(self, described: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Log-odds of texts, whose chunks begin at ``begins``."""
        top = np.maximum.reduceat(described, begins, axis=0)
        mean = np.add.reduceat(described, begins, axis=0) / np.diff(np.append(begins, len(described)))[:, None].astype(np.float32)
        return np.concatenate([top, mean], axis=1) @ self.p["out"] + self.p["out0"][0]

    def gradients(self, data: np.ndarray, first: np.ndarray, length: np.ndarray, begins: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the mean log loss of texts."""
        p, s, h, f = self.p, self.s, self.s.hidden, self.s.filters
        keep: dict = {}
        described = self.describe(data, first, length, keep)
        size = np.diff(np.append(begins, len(described)))
        text = np.repeat(np.arange(len(begins)), size)
        top = np.maximum.reduceat(described, begins, axis=0)
        mean = np.add.reduceat(described, begins, axis=0) / size[:, None].astype(np.float32)
        both = np.concatenate([top, mean], axis=1)
        logit = both @ p["out"] + p["out0"][0]
        d = ((1 / (1 + np.exp(-logit)) - labels) / len(labels)).astype(np.float32)
        g = {"out": both.T @ d, "out0": np.array([d.sum()], np.float32)}
        d_both = d[:, None] * p["out"]
        d_out = (d_both[:, h:] / size[:, None].astype(np.float32))[text]
        d_out += d_both[text, :h] * _first_of(described == top[text], text)
        d_hid = d_out * (1 - described * described)
        g["chunk"], g["chunk0"] = keep["pooled"].T @ d_hid, d_hid.sum(axis=0)
        d_pool = d_hid @ p["chunk"].T
        of = np.repeat(np.arange(len(first)), keep["count"].astype(np.int64))
        y = keep["y"]
        d_y = (d_pool[:, f:] / keep["count"][:, None])[of]
        d_y += d_pool[of, :f] * _first_of(y == keep["top"][of], of)
        d_y *= y > 0
        g["filter"], g["filter0"] = keep["x"].T @ d_y, d_y.sum(axis=0)
        d_x = (d_y @ p["filter"].T).reshape(-1, s.width)
        seen = keep["seen"].ravel()
        g["byte"] = np.stack([np.bincount(seen, d_x[:, j], 257) for j in range(s.width)], axis=1).astype(np.float32)
        return g

    def log_odds(self, data: np.ndarray, offsets: np.ndarray, limit: int = 256) -> np.ndarray:
        """Log-odds of whole texts; ``limit`` chunks are worked on at a time."""
        text, first, length = chunks(offsets, self.s)
        described = np.concatenate([self.describe(data, first[at : at + limit], length[at : at + limit]) for at in range(0, len(first), limit)])
        return self.combine(described, np.searchsorted(text, np.arange(len(offsets) - 1))) - self.shift


def _first_of(where: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Of the rows of a group that hold the column's maximum, a share of one in all."""
    begins = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    n = np.add.reduceat(where, begins, axis=0, dtype=np.float32)
    return where / n[np.cumsum(np.concatenate([[0], group[1:] != group[:-1]]))]


def train(texts: list[str], labels: np.ndarray, s: Settings = Settings()) -> Network:
    """Fit a network to texts with labels 0 and 1. Without both labels every score is the threshold of good ones."""
    net = Network.new(s)
    net.p["byte"][256] = 0
    if not len(labels) or labels.min() == labels.max():
        net.p = {k: np.zeros_like(v) for k, v in net.p.items()}
        net.shift = -_logit(s.good)
        return net
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])
    ((_, data, offsets),) = blocks(iter([batch]), "text", limit=1 << 40)
    text, first, length = chunks(offsets, s)
    begin, count = np.searchsorted(text, np.arange(len(texts))), np.bincount(text, minlength=len(texts))
    r = np.random.default_rng(s.seed)
    m, v = ({k: np.zeros_like(x) for k, x in net.p.items()} for _ in range(2))
    classes = [np.flatnonzero(labels == y) for y in (0, 1)]
    for step in range(1, s.steps + 1):
        own = np.concatenate([r.choice(c, s.batch // 2) for c in classes])
        each = np.minimum(count[own], s.chunks_in_training)
        begins = np.cumsum(each) - each
        used = np.concatenate([begin[i] + np.sort(r.choice(count[i], k, replace=False)) for i, k in zip(own, each)])
        g = net.gradients(data, first[used], length[used], begins, labels[own].astype(np.float32))
        rate = s.rate * min(1.0, 2 * (1 - step / (s.steps + 1)))
        for k in net.p:
            m[k] += 0.1 * (g[k] - m[k])
            v[k] += 0.01 * (g[k] ** 2 - v[k])
            net.p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)
    found = net.log_odds(data, offsets)
    net.shift = threshold(found[labels == 0], found[labels == 1], s.care) - _logit(s.good)
    return net


def threshold(poor: np.ndarray, good: np.ndarray, care: float) -> float:
    """The log-odds that tell both labels apart best, a good text lost counting ``care`` times; the middle where several do."""
    poor, good = np.sort(poor), np.sort(good)
    values = np.unique(np.concatenate([poor, good]))
    cuts = np.concatenate([[values[0] - 1], (values[1:] + values[:-1]) / 2, [values[-1] + 1]])
    right = np.searchsorted(poor, cuts) / len(poor) + care * (len(good) - np.searchsorted(good, cuts)) / len(good)
    best = np.flatnonzero(right >= right.max() - 1e-12)
    return float((cuts[best[0]] + cuts[best[-1]]) / 2)


def _logit(x: float) -> float:
    return float(np.log(x / (1 - x)))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", s: Settings = Settings()) -> Network:
    """Train on a sample of the texts of ``docs`` that ``labels`` names, drawn by a hash of the id.

    The sample has about ``per_label`` ids of either label (all, if fewer) and
    one text of each, the least if there are several; only it reaches the
    driver. An id with both labels counts for both. Of a text of over
    ``max_chars`` characters a part of that length is read, at a place that
    follows from its id.
    """
    own = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("label")).where("label in (0, 1) and _id is not null").distinct()
    total = {r["label"]: r["count"] for r in own.groupBy("label").count().collect()}
    share = F.lit(0.0)
    for label, n in total.items():
        share = F.when(F.col("label") == label, min(1.0, s.per_label / n)).otherwise(share)
    drawn = own.where(F.pmod(F.xxhash64("_id", F.lit("quality")), F.lit(1 << 20)) < share * (1 << 20))
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(drawn), "_id")
    beyond = F.length("text") - s.max_chars
    part = F.substring(F.col("text"), (1 + F.pmod(F.xxhash64("_id"), F.greatest(beyond, F.lit(0)) + 1)).cast("int"), F.lit(s.max_chars))
    found = rows.withColumn("text", F.when(beyond > 0, part).otherwise(F.col("text"))).groupBy("_id", "label").agg(F.min("text").alias("text")).toPandas().sort_values(["_id", "label"])
    return train(found["text"].tolist(), found["label"].to_numpy(dtype=np.int64), s)


def score(docs: DataFrame, net: Network, text_col: str = "text") -> DataFrame:
    """``docs`` with ``quality_score``, a number from 0 to 1, higher for better texts.

    Null and empty texts have the score of a chunk of no bytes. Texts of any
    length are scored to their end, whatever rows stand beside them. Repeated
    rows all stay, with equal scores. An empty table gives no rows. A column of
    this name is replaced.
    """
    docs = without(docs, ["quality_score"], [text_col])
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Network = sent.value
        for rows, data, offsets in blocks(batches, text_col):
            with np.errstate(over="ignore"):
                odds = np.round(1 / (1 + np.exp(-own.log_odds(data, offsets).astype(np.float64))), 6)  # single precision has no more
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(odds)], names=[*rows.schema.names, "quality_score"])

    return docs.mapInArrow(run, f"{docs.schema.toDDL()}, quality_score double")
