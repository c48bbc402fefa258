"""Toxicity by a bidirectional gated recurrent network with attention pooling.

A word enters as the embedding of the word and the mean embedding of its
character n-grams. The network reads windows of words in both directions, pools
its states by attention and gives one log-odds per window. A text is cut into
overlapping windows, all are scored, and the text's score is that of its worst
window. The network is trained in NumPy on a bounded sample of labelled texts,
of which only the label of the whole text is known: first with all windows,
then with the windows that the network itself finds worst.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .characters import LETTER_OR_DIGIT, MARK, lower_codes
from .common import without
from .textkit import blocks, mix, runs, span_hashes

_IN_WORD = LETTER_OR_DIGIT | MARK
_MARK = 0x110000  # begins and ends every word


@dataclass(frozen=True)
class Settings:
    words: int = 1 << 16  # buckets of words
    grams: int = 1 << 15  # buckets of character n-grams
    sizes: tuple[int, ...] = (3, 5)
    width: int = 8  # of each embedding
    hidden: int = 8  # of each direction
    attention: int = 8
    window: int = 40
    stride: int = 20
    batch: int = 128
    warm_steps: int = 150
    rounds: int = 2
    round_steps: int = 100
    rate: float = 0.02
    seed: int = 7
    #: Bounds of the sample that is learned from: texts of either label, and characters of one such text.
    per_label: int = 1500
    max_chars: int = 50_000


@dataclass
class Words:
    """The distinct words of some texts: their bucket, and the buckets of their character n-grams in one array."""

    bucket: np.ndarray
    grams: np.ndarray
    cut: np.ndarray  # where each word's n-grams begin, and the end
    index: np.ndarray  # the texts' words, as places among the distinct ones
    bounds: np.ndarray  # where each text begins in ``index``, and the end


def read_words(data: np.ndarray, offsets: np.ndarray, s: Settings) -> Words:
    """Words of a block of UTF-8 texts: runs of letters, digits and their marks, each character lower-cased by itself."""
    codes = lower_codes(data)
    at = np.append(0, np.cumsum((data & 0xC0) != 0x80))[offsets]
    starts, ends = runs(_IN_WORD[codes], at)
    bounds = np.append(np.searchsorted(starts, at[:-1]), len(starts))
    hashes, first, index = np.unique(span_hashes(codes, starts, ends), return_index=True, return_inverse=True)
    # The distinct words, each between two marks.
    size = (ends - starts)[first] + 2
    stop = np.cumsum(size)
    n = int(stop[-1]) if len(stop) else 0
    word = np.repeat(np.arange(len(first)), size)
    place = np.arange(n) - np.repeat(stop - size, size)
    letters = np.full(n, _MARK, dtype=np.uint64)
    inner = (place > 0) & (place < np.repeat(size, size) - 1)
    letters[inner] = codes[(np.repeat(starts[first], size) + place - 1)[inner]]
    grams, owner = [], []
    rolled = np.zeros(n, dtype=np.uint64)
    for k in range(1, max(s.sizes) + 1):
        if k > n:
            break
        rolled = rolled[: n - k + 1] * np.uint64(0x100000001B3) + letters[k - 1 :]
        if k in s.sizes:
            within = word[: n - k + 1] == word[k - 1 :]
            grams.append((mix(rolled[within] + np.uint64(k)) & np.uint64(s.grams - 1)).astype(np.int32))
            owner.append(word[: n - k + 1][within])
    owner = np.concatenate(owner) if owner else np.zeros(0, np.int64)
    order = np.argsort(owner, kind="stable")
    grams = np.concatenate(grams)[order] if grams else np.zeros(0, np.int32)
    cut = np.append(0, np.cumsum(np.bincount(owner, minlength=len(first)))).astype(np.int64)
    return Words((hashes & np.uint64(s.words - 1)).astype(np.int32), grams, cut, index.astype(np.int32), bounds)


def windows(bounds: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, first word and length of every window; windows of a text overlap and cover it, a wordless text has none."""
    n = np.diff(bounds)
    count = np.where(n > 0, 1 + np.maximum(0, -(-(n - s.window) // s.stride)), 0)
    text = np.repeat(np.arange(len(n)), count)
    k = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    return text, bounds[text] + k * s.stride, np.minimum(s.window, n[text] - k * s.stride)


def _sum_by(key: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, and the sum of the rows of each."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[first], np.add.reduceat(values[order], first, axis=0)


def _tanh_half(x: np.ndarray) -> np.ndarray:
    """The logistic function."""
    x *= 0.5
    np.tanh(x, out=x)
    x += 1
    x *= 0.5
    return x


@dataclass
class Network:
    s: Settings
    p: dict[str, np.ndarray] = field(default_factory=dict)
    shift: float = 0.0

    @classmethod
    def new(cls, s: Settings) -> Network:
        r = np.random.default_rng(s.seed)
        h, d = s.hidden, 2 * s.width

        def normal(*shape, scale):
            return (r.standard_normal(shape) * scale).astype(np.float32)

        p = {
            "word": normal(s.words, s.width, scale=0.05),
            "gram": normal(s.grams, s.width, scale=0.1),
            "x": normal(d, 6 * h, scale=0.4),
            "x0": np.zeros(6 * h, np.float32),
            "forth": normal(h, 3 * h, scale=0.3),
            "back": normal(h, 3 * h, scale=0.3),
            "att": normal(2 * h, s.attention, scale=0.4),
            "att1": normal(s.attention, scale=0.4),
            "out": normal(2 * h, scale=0.4),
            "out0": np.zeros(1, np.float32),
        }
        return cls(s, p)

    def inputs(self, w: Words, which: np.ndarray | slice = slice(None)) -> tuple[np.ndarray, np.ndarray]:
        """Input vectors of the distinct words, and the inputs of both directions' gates; the last row is for no word."""
        sums = np.zeros((len(w.bucket), self.s.width), np.float32)
        size = np.diff(w.cut)
        some = np.flatnonzero(size)
        if len(some):
            for j in range(self.s.width):  # column by column: no array of n-grams times width
                sums[some, j] = np.add.reduceat(self.p["gram"][:, j][w.grams], w.cut[:-1][some])
        x = np.concatenate([self.p["word"][w.bucket], sums / np.maximum(size, 1)[:, None].astype(np.float32)], axis=1)[which]
        gates = np.concatenate([x @ self.p["x"] + self.p["x0"], np.zeros((1, 6 * self.s.hidden), np.float32)])
        return x, gates

    def _direction(self, gates: np.ndarray, index: np.ndarray, u: np.ndarray, steps, keep: list | None) -> np.ndarray:
        h3, n = 3 * self.s.hidden, len(index)
        h = self.s.hidden
        none = len(gates) - 1
        state = np.zeros((n, h), np.float32)
        out = np.empty((index.shape[1], n, h), np.float32)
        for t in steps:
            g, a = gates[index[:, t]], state @ u
            rz = _tanh_half(g[:, : 2 * h] + a[:, : 2 * h])
            new = np.tanh(g[:, 2 * h : h3] + rz[:, :h] * a[:, 2 * h :])
            now = new + rz[:, h:] * (state - new)
            idle = index[:, t] == none
            if idle.any():
                now = np.where(idle[:, None], state, now)
            if keep is not None:
                keep.append((t, state, a, rz, new, idle))
            state = out[t] = now
        return out

    def forward(self, gates: np.ndarray, index: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Log-odds of windows; ``index`` holds rows of ``gates``, its last row where a window has ended."""
        h3, length = 3 * self.s.hidden, index.shape[1]
        f_keep, b_keep = ([], []) if keep is not None else (None, None)
        forth = self._direction(gates[:, :h3], index, self.p["forth"], range(length), f_keep)
        back = self._direction(gates[:, h3:], index, self.p["back"], range(length - 1, -1, -1), b_keep)
        states = np.concatenate([forth, back], axis=2)
        hid = np.tanh(states @ self.p["att"])
        score = hid @ self.p["att1"]
        score[index.T == len(gates) - 1] = -np.inf
        score = np.exp(score - score.max(axis=0))
        score /= score.sum(axis=0)
        pooled = np.einsum("tn,tnh->nh", score, states)
        if keep is not None:
            keep.update(f=f_keep, b=b_keep, states=states, hid=hid, score=score, pooled=pooled)
        return pooled @ self.p["out"] + self.p["out0"][0]

    def _back_direction(self, grad: np.ndarray, kept: list, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradients of the gates' inputs by step and window, and of ``u``."""
        h = self.s.hidden
        d_in = np.zeros((grad.shape[0], grad.shape[1], 3 * h), np.float32)
        d_u = np.zeros_like(u)
        flow = np.zeros_like(grad[0])
        for t, state, a, rz, new, idle in reversed(kept):
            flow = flow + grad[t]
            d = np.where(idle[:, None], 0, flow)
            r, z = rz[:, :h], rz[:, h:]
            d_new = d * (1 - z) * (1 - new * new)
            d_z = d * (state - new) * z * (1 - z)
            d_r = d_new * a[:, 2 * h :] * r * (1 - r)
            d_a = np.concatenate([d_r, d_z, d_new * r], axis=1)
            d_in[t, :, : 2 * h] = d_a[:, : 2 * h]
            d_in[t, :, 2 * h :] = d_new
            d_u += state.T @ d_a
            flow = np.where(idle[:, None], flow, d * z + d_a @ u.T)
        return d_in, d_u

    def gradients(self, gates: np.ndarray, index: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of the weighted mean log loss for the parameters above the inputs, and for ``gates``."""
        keep: dict = {}
        logit = self.forward(gates, index, keep)
        d = ((1 / (1 + np.exp(-logit)) - labels) * weight / weight.sum()).astype(np.float32)
        p, h = self.p, self.s.hidden
        g = {"out": keep["pooled"].T @ d, "out0": np.array([d.sum()], np.float32)}
        d_pooled = d[:, None] * p["out"]
        states, score, hid = keep["states"], keep["score"], keep["hid"]
        d_states = score[:, :, None] * d_pooled
        d_score = np.einsum("tnh,nh->tn", states, d_pooled)
        d_score = score * (d_score - (score * d_score).sum(axis=0))
        g["att1"] = np.einsum("tn,tna->a", d_score, hid)
        d_hid = d_score[:, :, None] * p["att1"] * (1 - hid * hid)
        g["att"] = np.tensordot(states, d_hid, axes=([0, 1], [0, 1]))
        d_states += d_hid @ p["att"].T
        d_f, g["forth"] = self._back_direction(d_states[:, :, :h], keep["f"], p["forth"])
        d_b, g["back"] = self._back_direction(d_states[:, :, h:], keep["b"], p["back"])
        d_gates = np.zeros_like(gates)
        own, sums = _sum_by(index.T.ravel(), np.concatenate([d_f, d_b], axis=2).reshape(index.size, -1))
        d_gates[own] = sums
        return g, d_gates[:-1]

    def score_windows(self, gates: np.ndarray, w: Words, first: np.ndarray, length: np.ndarray, chunk: int = 2048) -> np.ndarray:
        out = np.empty(len(first), np.float32)
        order = np.argsort(-length, kind="stable")
        for at in range(0, len(first), chunk):
            own = order[at : at + chunk]
            out[own] = self.forward(gates, window_index(w, first[own], length[own], len(gates) - 1))
        return out

    def score_texts(self, w: Words) -> np.ndarray:
        """Log-odds of each text: of its worst window, minus infinity for a text without words."""
        text, first, length = windows(w.bounds, self.s)
        out = np.full(len(w.bounds) - 1, -np.inf)
        if len(text):
            _, gates = self.inputs(w)
            np.maximum.at(out, text, self.score_windows(gates, w, first, length))
        return out - self.shift


def window_index(w: Words, first: np.ndarray, length: np.ndarray, none: int) -> np.ndarray:
    place = np.arange(int(length.max()))
    inside = place < length[:, None]
    return np.where(inside, w.index[np.minimum(first[:, None] + place, len(w.index) - 1)], none)


class _Trainer:
    """Adam for the small parameters, sparse Adagrad for the embeddings."""

    def __init__(self, net: Network):
        self.net, self.step = net, 0
        self.m = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items() if k not in ("word", "gram")}
        self.acc = {k: np.zeros(len(net.p[k]), np.float32) for k in ("word", "gram")}

    def _rows(self, name: str, rows: np.ndarray, grad: np.ndarray) -> None:
        own, total = _sum_by(rows, grad)
        self.acc[name][own] += (total * total).mean(axis=1)
        self.net.p[name][own] -= 3 * self.net.s.rate * total / np.sqrt(self.acc[name][own] + 1e-8)[:, None]

    def train(self, w: Words, first: np.ndarray, length: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> None:
        net, s = self.net, self.net.s
        index = window_index(w, first, length, -1)
        used, local = np.unique(index, return_inverse=True)
        local = local.reshape(index.shape)
        if used[0] == -1:  # rows of ended windows go last
            used = used[1:]
            local = np.where(index == -1, len(used), local - 1)
        # The n-grams of these words alone.
        size = np.diff(w.cut)[used]
        stop = np.cumsum(size)
        grams = w.grams[np.repeat(w.cut[used] - (stop - size), size) + np.arange(int(stop[-1]))]
        part = Words(w.bucket[used], grams, np.append(0, stop), local, np.array([0]))
        x, gates = net.inputs(part)
        g, d_gates = net.gradients(gates, local, labels, weight)
        g["x"], g["x0"] = x.T @ d_gates, d_gates.sum(axis=0)
        d_x = d_gates @ net.p["x"].T
        self.step += 1
        for k, (m, v) in self.m.items():
            m += 0.1 * (g[k] - m)
            v += 0.01 * (g[k] ** 2 - v)
            net.p[k] -= s.rate * (m / (1 - 0.9**self.step)) / (np.sqrt(v / (1 - 0.99**self.step)) + 1e-6)
        self._rows("word", part.bucket, d_x[:, : s.width])
        self._rows("gram", grams, np.repeat(d_x[:, s.width :] / np.maximum(size, 1)[:, None], size, axis=0))


def train(texts: list[str], labels: np.ndarray, s: Settings = Settings()) -> Network:
    """Fit a network to texts with labels 0 and 1. Without both labels among texts with words, every score is 0."""
    net = Network.new(s)
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])
    parts = list(blocks(iter([batch]), "text", limit=1 << 40))
    if not parts:
        net.shift = np.inf
        return net
    w = read_words(*parts[0][1:], s)
    text, first, length = windows(w.bounds, s)
    y = labels[text]
    if not len(y) or y.min() == y.max():
        net.shift = np.inf
        return net
    r, trainer = np.random.default_rng(s.seed), _Trainer(net)
    bad, good = np.flatnonzero(y == 1), np.flatnonzero(y == 0)

    def steps(n: int, positive: np.ndarray, negative: np.ndarray, share: float) -> None:
        k = max(1, int(s.batch * share))
        for _ in range(n):
            own = np.concatenate([r.choice(positive, k), r.choice(negative, s.batch - k)])
            trainer.train(w, first[own], length[own], y[own].astype(np.float32), np.ones(len(own), np.float32))

    steps(s.warm_steps, bad, good, 0.3)
    for _ in range(s.rounds):
        _, gates = net.inputs(w)
        logit = net.score_windows(gates, w, first, length)
        order = np.lexsort((-logit, text))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order)) - np.searchsorted(text, text)[order]
        worst_bad, worst_good = bad[rank[bad] == 0], good[rank[good] <= 1]
        some = r.choice(good, min(len(good), len(worst_good)), replace=False)
        steps(s.round_steps, worst_bad, np.concatenate([worst_good, some]), 0.4)
    score = net.score_texts(w)
    net.shift = best_shift(score[labels == 1], score[labels == 0])
    return net


def best_shift(bad: np.ndarray, good: np.ndarray) -> float:
    """The log-odds at which both labels are told apart best, each label counting alike.

    Of the range where that holds, a place near its upper end: other clean texts
    are far more numerous than those learned from, and some score higher.
    """
    bad, good = np.sort(bad[np.isfinite(bad)]), np.sort(good[np.isfinite(good)])
    values = np.unique(np.concatenate([bad, good]))
    cuts = np.concatenate([[values[0] - 1], (values[1:] + values[:-1]) / 2, [values[-1] + 1]])
    right = (len(bad) - np.searchsorted(bad, cuts)) / len(bad) + np.searchsorted(good, cuts) / max(len(good), 1)
    best = np.flatnonzero(right == right.max())
    return float(0.25 * cuts[best[0]] + 0.75 * cuts[best[-1]])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", s: Settings = Settings()) -> Network:
    """Train on a sample of the texts of ``docs`` that ``labels`` names, drawn by a hash of the id.

    The sample has about ``per_label`` ids of either label (all, if fewer) and
    one text of each, the least if there are several; only it reaches the
    driver. An id with both labels counts for both. Of a clean text of over
    ``max_chars`` characters a part of that length is read, at a place that
    follows from its id; a toxic one is left out, as any part of it may be clean.
    """
    own = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("label")).where("label in (0, 1) and _id is not null").distinct()
    total = {r["label"]: r["count"] for r in own.groupBy("label").count().collect()}
    share = F.lit(0.0)
    for label, n in total.items():
        share = F.when(F.col("label") == label, min(1.0, s.per_label / n)).otherwise(share)
    drawn = own.where(F.pmod(F.xxhash64("_id", F.lit("toxicity")), F.lit(1 << 20)) < share * (1 << 20))
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(drawn), "_id")
    beyond = F.length("text") - s.max_chars
    part = F.substring(F.col("text"), (1 + F.pmod(F.xxhash64("_id"), beyond + 1)).cast("int"), F.lit(s.max_chars))
    rows = rows.where((beyond <= 0) | (F.col("label") == 0)).withColumn("text", F.when(beyond > 0, part).otherwise(F.col("text")))
    found = rows.groupBy("_id", "label").agg(F.min("text").alias("text")).toPandas().sort_values(["_id", "label"])
    return train(found["text"].tolist(), found["label"].to_numpy(dtype=np.int64), s)


def score(docs: DataFrame, net: Network, text_col: str = "text") -> DataFrame:
    """``docs`` with ``toxicity``, a number from 0 to 1; null, empty and wordless texts have 0.

    Texts of any length are scored to their end. Repeated rows all stay, with
    equal scores. An empty table gives no rows. A column of this name is replaced.
    """
    docs = without(docs, ["toxicity"], [text_col])
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Network = sent.value
        for rows, data, offsets in blocks(batches, text_col):
            logit = own.score_texts(read_words(data, offsets, own.s))
            with np.errstate(over="ignore"):
                odds = 1 / (1 + np.exp(-logit))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(odds)], names=[*rows.schema.names, "toxicity"])

    return docs.mapInArrow(run, f"{docs.schema.toDDL()}, toxicity double")
