"""Token ids by public vocabularies, with the ids of each word remembered in a Python worker."""

from __future__ import annotations

import base64
import json
import os
import re
from collections.abc import Callable
from functools import cache, cached_property
from itertools import chain

import numpy as np

from .textkit import NOT_SPACE, byte_table, distinct_spans, runs, same_bytes

#: White space, by any definition that a vocabulary's pattern may use, other than the ASCII characters between words.
_ODD = re.compile(r"[\s\x1c-\x1f\x85\u200b\ufeff]")


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file; absolute paths stay."""
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class WordTable:
    """Ids of words. A word is found by its hash and compared with the one remembered.

    A table of more than ``room`` bytes begins anew, so it holds those and the words of one block at most.
    """

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], room: int = 24 << 20):
        self.encode, self.room = encode, room
        self._empty()

    def _empty(self) -> None:
        # By sorted hash: where the ids and the bytes of the word begin, how many they are, and whether it stands bare.
        self.keys = np.zeros(0, np.uint64)
        self.at, self.size = np.zeros(0, np.int32), np.zeros(0, np.int32)  # size -1: the word holds white space of another kind
        self.begin, self.length = np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.bare = np.zeros(0, bool)
        self.ids, self.text = np.zeros(0, np.uint32), np.zeros(0, np.uint8)

    @property
    def nbytes(self) -> int:
        return sum(x.nbytes for x in (self.keys, self.at, self.size, self.begin, self.length, self.bare, self.ids, self.text))

    def find(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, bare: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``ids`` and lengths for distinct words: spans of ``data``, after a space unless ``bare``."""
        if self.nbytes > self.room:
            self._empty()
        n, size = len(hashes), ends - starts
        at, count = np.zeros(n, np.int64), np.zeros(n, np.int64)
        place = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        met = self.keys[place] == hashes if len(self.keys) else np.zeros(n, bool)
        known = np.flatnonzero(met)
        p = place[known]
        ok = (self.length[p] == size[known]) & (self.bare[p] == bare[known])
        ok[ok] = same_bytes(self.text, self.begin[p[ok]].astype(np.int64), data, starts[known[ok]], size[known[ok]])
        at[known[ok]], count[known[ok]] = self.at[p[ok]], self.size[p[ok]]
        new = np.ones(n, bool)
        new[known[ok]] = False
        new = np.flatnonzero(new)
        if len(new):
            raw = data.tobytes()
            words = [("" if b else " ") + raw[s:e].decode() for s, e, b in zip(starts[new].tolist(), ends[new].tolist(), bare[new].tolist())]
            odd = np.array([bool(_ODD.search(w, w[:1] == " ")) for w in words])
            ids = self.encode(words)
            own = np.fromiter(map(len, ids), np.int64, len(ids))
            at[new], count[new] = len(self.ids) + np.cumsum(own) - own, np.where(odd, -1, own)
            self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(ids), np.uint32, int(own.sum()))])
            # Of words with one hash the first is remembered; the others are encoded each time.
            keep = new[~met[new]]
            keep = keep[np.unique(hashes[keep], return_index=True)[1]]
            stop = np.cumsum(size[keep])
            begin = len(self.text) + stop - size[keep]
            self.text = np.concatenate([self.text, data[np.repeat(starts[keep] - (stop - size[keep]), size[keep]) + np.arange(int(stop[-1]) if len(stop) else 0)]])
            where = np.searchsorted(self.keys, hashes[keep])
            for name, value in {"keys": hashes[keep], "at": at[keep], "size": count[keep], "begin": begin, "length": size[keep], "bare": bare[keep]}.items():
                old = getattr(self, name)
                setattr(self, name, np.insert(old, where, value.astype(old.dtype)))
        return at, count


def gather(ids: np.ndarray, at: np.ndarray, size: np.ndarray, before: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Concatenated stretches of ``ids``, each with ``before`` free places ahead of it, and where each ends."""
    total = size if before is None else size + before
    ends = np.cumsum(total)
    n = int(ends[-1]) if len(ends) else 0
    start = ends - size
    index = np.repeat(at - start, total) + np.arange(n)
    if before is not None:
        index[(start - before)[before > 0]] = 0
    return (ids[index] if len(ids) else np.zeros(n, np.uint32)), ends


_ALNUM = byte_table([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)])
_MARK = NOT_SPACE & ~_ALNUM & ~byte_table([*range(0x80, 0x100)])
_TAIL = byte_table([*range(0x80, 0xC0)]) & ~byte_table([0x97, 0xB7])  # with 0xC3 before: a letter of U+00C0..U+00FF


def _cuts(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Places within words where an ASCII mark follows a letter or digit."""
    if len(data) < 2:
        return np.zeros(0, np.int64)
    letter = _ALNUM[data]
    letter[1:] |= _TAIL[data[1:]] & (data[:-1] == 0xC3)
    at = np.zeros(len(data), dtype=bool)
    at[1:] = _MARK[data[1:]] & letter[:-1]
    at[starts] = False
    return np.flatnonzero(at)


def _by_ranks(path: str) -> Callable[[list[str]], list[list[int]]]:
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    one = tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    return lambda words: [one(w) for w in words]


@cache
def ranked_words(path: str) -> WordTable:
    """A rank file's words, remembered once for all uses in a worker: added tokens make no difference to single words."""
    return WordTable(_by_ranks(path))


class ByteLevelIds:
    """Ids of whole texts.

    The vocabulary's pattern never joins a word to the next one: a token starts
    with at most one space, and a line feed between two other characters is a
    token of its own. So the ids of a text whose words stand apart by one space
    or one line feed are those of its words, each with its space, one after
    another; each such word is encoded once. Every other text is encoded whole.
    """

    def __init__(self, path: str, ranks: str | None = None, added: bool = False):
        """``ranks``: the same vocabulary as a rank file, by which single words are encoded faster.

        ``added``: an added token such as <|endoftext|> that stands in a text has its own id, as the tokenizer has it
        by default; texts with one are encoded whole. Else it is ordinary text.
        """
        self.path, self.added = path, added
        self.table = ranked_words(ranks) if ranks else WordTable(self.whole)
        self.feed = self.table.encode(["\n"])[0][0]

    @cached_property
    def tokenizer(self):
        """Loaded when the first text has to be encoded whole."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(self.path)
        own.encode_special_tokens = not self.added
        return own

    @cached_property
    def vocabulary_size(self) -> int:
        with open(self.path, encoding="utf-8") as f:
            return len(json.load(f)["model"]["vocab"])

    @cached_property
    def added_tokens(self) -> list[bytes]:
        with open(self.path, encoding="utf-8") as f:
            return [t["content"].encode() for t in json.load(f)["added_tokens"]] if self.added else []

    def whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """Per text of a block its ids (unsigned 32-bit)."""
        n = len(offsets) - 1
        starts, ends = runs(NOT_SPACE[data], offsets)
        cuts = _cuts(data, starts)
        lead = np.concatenate([np.ones(len(starts), bool), np.zeros(len(cuts), bool)])  # parts that begin a word
        starts, ends = np.concatenate([starts, cuts]), np.concatenate([ends, cuts])
        order = np.argsort(starts, kind="stable")
        starts, ends, lead = starts[order], np.sort(ends, kind="stable"), lead[order]
        first = np.searchsorted(starts, offsets[:-1])
        last = np.append(first[1:], len(starts))
        some = last > first
        plain = np.ones(n, dtype=bool)
        plain[some] = (starts[first[some]] == offsets[:-1][some]) & (ends[last[some] - 1] == offsets[1:][some])
        plain[~some] = offsets[1:][~some] == offsets[:-1][~some]
        if not len(starts):
            found, cut = np.zeros(0, np.uint32), np.zeros(n + 1, np.int64)
        else:
            doc = np.repeat(np.arange(n), last - first)
            head = np.zeros(len(starts), dtype=bool)
            head[first[some]] = True
            ahead = np.where(head, 0x20, data[starts - 1])
            inner = ~head & lead
            wrong = inner & ~(((ahead == 0x20) | (ahead == 0x0A)) & (starts - np.append(0, ends[:-1]) == 1))
            plain[doc[wrong]] = False
            fed = inner & (ahead == 0x0A)
            bare = head | fed | ~lead
            where, back, hashes = distinct_spans(data, starts, ends, bare)
            at, size = self.table.find(data, starts[where], ends[where], bare[where], hashes)
            at, size = at[back], size[back]
            plain[doc[size < 0]] = False
            before = fed.astype(np.int64)
            found, stop = gather(self.table.ids, at, np.maximum(size, 0), before)
            found[(stop - np.maximum(size, 0) - 1)[fed]] = self.feed
            cut = np.append(0, stop)[np.append(first, len(starts))]
        out = [found[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]
        if self.added_tokens:
            raw = data.tobytes()
            for token in self.added_tokens:
                at = raw.find(token)
                while at >= 0:  # one that reaches over a text's end costs that text the fast path only
                    plain[np.searchsorted(offsets, at, side="right") - 1] = False
                    at = raw.find(token, at + 1)
        rest = np.flatnonzero(~plain).tolist()
        if rest:
            raw = data.tobytes()
            for i, ids in zip(rest, self.whole([raw[offsets[i] : offsets[i + 1]].decode() for i in rest])):
                out[i] = np.array(ids, dtype=np.uint32)
        return out


class PieceCounts:
    """Tokens of single words by a sentencepiece vocabulary with byte fallback, and how many of them are bytes."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = range(self.model.get_piece_size())
        self.is_byte = np.array([self.model.is_byte(i) for i in pieces])
        # Merges start from single characters, so a word of known characters alone has no byte tokens.
        self.known = np.zeros(0x110000, dtype=bool)
        self.known[[ord(p) for p in map(self.model.id_to_piece, pieces) if len(p) == 1]] = True
        self.known[0x20] = True

    def counts(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens and byte tokens of each word."""
        ids = self.model.encode([w.decode() for w in words], num_threads=1)
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        stop = np.cumsum(size)
        fallen = np.append(0, np.cumsum(self.is_byte[np.fromiter(chain.from_iterable(ids), np.int64, int(stop[-1]))]))
        return size, fallen[stop] - fallen[stop - size]


@cache
def piece_counts(path: str) -> PieceCounts:
    return PieceCounts(path)


@cache
def byte_level(path: str, ranks: str | None = None, added: bool = False) -> ByteLevelIds:
    return ByteLevelIds(path, ranks, added)
