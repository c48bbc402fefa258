"""Tables over all code points, so that what becomes of a character depends on nothing beside it."""

from __future__ import annotations

import unicodedata

import numpy as np

_ALL = range(0x110000)


def _lowered(code: int) -> int:
    low = chr(code).lower()
    return ord(low[0]) if len(low) == 1 or code == 0x130 else code


#: Lower case of each code point: one for one; final sigma is as any other, and capital I with a dot becomes i.
LOWER = np.array([_lowered(c) for c in _ALL], dtype=np.uint32)
LOWER[0x3C2] = 0x3C3
LETTER = np.array([chr(c).isalpha() for c in _ALL])
LETTER_OR_DIGIT = np.array([chr(c).isalnum() for c in _ALL])
#: Marks such as vowel signs belong to the words that they stand in.
MARK = np.array([unicodedata.category(chr(c))[0] == "M" for c in _ALL])


def lower_codes(data: np.ndarray) -> np.ndarray:
    """Code points of valid UTF-8 in lower case."""
    return LOWER[np.frombuffer(data.tobytes().decode().encode("utf-32-le"), dtype=np.uint32)]
