"""Licence scans: places of fixed phrases, and templates matched as token automata.

A template is the wording of a licence notice in a small markup:

* ``[[ ... ]]`` holds an optional region, which may be nested;
* ``{{n}}`` stands for a replaceable region of one to n words;
* ``{{a b | c}}`` stands for one of the given wordings.

All other words are mandatory and have to stand in the text in this order with
nothing between them. Case of A-Z, white space and punctuation don't matter.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import without
from .license_templates import TEMPLATES
from .textkit import blocks, byte_table, runs

#: Words: letters a-z, digits, and all characters outside ASCII.
IN_WORD = byte_table([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)])
#: Fixed phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


@dataclass(frozen=True)
class Automaton:
    """States are numbers from 0; ``words[s][w]`` and ``any[s]`` are the states after a word from state s.

    The sets are closed over what may be left out. ``final`` holds the accepting states.
    """

    label: str
    start: frozenset[int]
    words: tuple[dict[bytes, frozenset[int]], ...]
    any: tuple[frozenset[int], ...]
    final: int

    def longest(self, word: Callable[[int], bytes], at: int, stop: int) -> int:
        """End of the longest match that begins with word ``at`` of the words before ``stop``; -1 if there is none."""
        states, end = self.start, -1
        for i in range(at, stop):
            following, own = set(), word(i)
            for s in states:
                following |= self.any[s]
                following |= self.words[s].get(own, frozenset())
            if not following:
                break
            states = following
            if self.final in states:
                end = i + 1
        return end


_TOKEN = re.compile(r"\[\[|\]\]|\{\{|\}\}|\||[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def compile_template(label: str, template: str) -> Automaton:
    """The automaton of one template; punctuation in it doesn't count, malformed markup raises ValueError."""
    tokens = _TOKEN.findall(template)
    empty: list[set[int]] = []  # moves without a word
    on: list[dict[bytes, set[int]]] = []
    free: list[set[int]] = []

    def state() -> int:
        empty.append(set())
        on.append({})
        free.append(set())
        return len(on) - 1

    def sequence(i: int, at: int, ends: tuple[str, ...]) -> tuple[int, int]:
        """Alternatives up to one of ``ends``; next token and the state after them."""
        begin, after = at, state()
        while i < len(tokens) and tokens[i] not in ends:
            token = tokens[i]
            if token == "|":
                empty[at].add(after)
                at, i = begin, i + 1
            elif token == "[[":
                i, done = sequence(i + 1, at, ("]]",))
                empty[at].add(done)
                at = done
            elif token == "{{":
                if i + 2 < len(tokens) and tokens[i + 1].isdigit() and tokens[i + 2] == "}}":
                    done = state()
                    for _ in range(int(tokens[i + 1])):
                        to = state()
                        free[at].add(to)
                        empty[to].add(done)
                        at = to
                    at, i = done, i + 3
                else:
                    i, at = sequence(i + 1, at, ("}}",))
            elif token in ("]]", "}}"):
                raise ValueError(f"{label}: {token} without its opening")
            else:
                to = state()
                on[at].setdefault(token.lower().encode(), set()).add(to)
                at, i = to, i + 1
        if ends and i >= len(tokens):
            raise ValueError(f"{label}: {ends[0]} is missing")
        empty[at].add(after)
        return i + 1, after

    first = state()
    _, final = sequence(0, first, ())

    def closed(states: set[int]) -> frozenset[int]:
        seen, left = set(states), list(states)
        while left:
            for s in empty[left.pop()] - seen:
                seen.add(s)
                left.append(s)
        return frozenset(seen)

    made = Automaton(label, closed({first}), tuple({w: closed(x) for w, x in d.items()} for d in on), tuple(closed(x) if x else frozenset() for x in free), final)
    if final in made.start:
        raise ValueError(f"{label}: no word is mandatory")
    if any(made.any[s] for s in made.start):
        raise ValueError(f"{label}: a template has to begin with a given word")
    return made


@cache
def _automata(templates: tuple[tuple[str, str], ...]) -> dict[bytes, list[Automaton]]:
    """Automata by each word with which a match may begin."""
    found: dict[bytes, list[Automaton]] = {}
    for label, template in templates:
        made = compile_template(label, template)
        for word in {w for s in made.start for w in made.words[s]}:
            found.setdefault(word, []).append(made)
    return found


def occurrences(raw: bytes, word: bytes, starts: np.ndarray, ends: np.ndarray) -> list[int]:
    """Which of the words that begin and end at ``starts`` and ``ends`` are ``word``."""
    found, at = [], raw.find(word)
    while at >= 0:
        found.append(at)
        at = raw.find(word, at + 1)
    if not found or not len(starts):
        return []
    place = np.array(found)
    i = np.minimum(np.searchsorted(starts, place), len(starts) - 1)
    return i[(starts[i] == place) & (ends[i] == place + len(word))].tolist()


_RARE = {b"cc"}  # rarer in prose than the longest word of its phrase
_PLACES = pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64())]))
_MATCHES = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("end", pa.int64())]))
_FIELDS = {"n_words": "long", "places": "array<struct<label: string, word: long>>", "matches": "array<struct<label: string, first: long, end: long>>"}


def scan(docs: DataFrame, text_col: str = "text", phrases: dict[str, str] = PHRASES, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """``docs`` with a struct ``licences``: n_words, ``places`` of phrases and ``matches`` of templates in each whole text.

    Places and matches count words from 0, ``end`` is one beyond the last word.
    Null texts count as empty: no word, place or match. A match is the longest
    one from where it begins, in texts of any length; matches of different
    templates may overlap. Repeated rows all stay, with equal results. An empty
    table gives no rows. A column of this name is replaced.
    """
    docs = without(docs, ["licences"], [text_col])
    sought, wanted = [([w.encode() for w in p.split()], label) for p, label in phrases.items()], tuple(map(tuple, templates))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = _automata(wanted)
        for rows, data, offsets in blocks(batches, text_col):
            starts, ends = runs(IN_WORD[data], offsets)
            cut = np.append(np.searchsorted(starts, offsets[:-1]), len(starts))
            raw = data.tobytes().lower()  # bytes: A-Z only
            places: list[list[dict]] = [[] for _ in range(rows.num_rows)]
            matches: list[list[dict]] = [[] for _ in range(rows.num_rows)]

            def word(i: int) -> bytes:
                return raw[starts[i] : ends[i]]

            def text_of(i: int) -> int:
                return int(np.searchsorted(cut, i, side="right")) - 1

            for words, label in sought:
                rare = max(range(len(words)), key=lambda k: (words[k] in _RARE, len(words[k])))
                for i in occurrences(raw, words[rare], starts, ends):
                    first, d = i - rare, text_of(i)
                    if first >= cut[d] and first + len(words) <= cut[d + 1] and all(word(first + k) == w for k, w in enumerate(words)):
                        places[d].append({"label": label, "word": first - int(cut[d])})
            for opening, own in automata.items():
                for i in occurrences(raw, opening, starts, ends):
                    d = text_of(i)
                    for automaton in own:
                        end = automaton.longest(word, i, int(cut[d + 1]))
                        if end > 0:
                            matches[d].append({"label": automaton.label, "first": i - int(cut[d]), "end": end - int(cut[d])})
            arrays = [pa.array(np.diff(cut)), pa.array(places, _PLACES), pa.array(matches, _MATCHES)]
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.StructArray.from_arrays(arrays, names=list(_FIELDS))], names=[*rows.schema.names, "licences"])

    return docs.mapInArrow(run, f"{docs.schema.toDDL()}, licences struct<{', '.join(f'{k}: {t}' for k, t in _FIELDS.items())}>")
