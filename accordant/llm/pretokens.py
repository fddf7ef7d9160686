"""Cutting texts into units that a byte-level BPE encodes independently, so that each distinct unit is encoded once.

The pattern of these vocabularies lets a space begin a match but never end one before a non-space, so a text may be cut
before every single space. It may not be cut where a space stands between two whitespace characters, or between one
and the end, as a run of whitespace is one match there; nor at a special string. Such texts stay whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: Whitespace of any of the libraries, and where a text may not be cut.
_SPACE = r"[\x09-\x0d\x1c-\x20\x{85}\p{Z}]"
_WHOLE = rf"{_SPACE} (?:{_SPACE}|\z)|<\|"


class Units:
    """Of some texts: the distinct units, and for each text the run index[offset[i]:offset[i + 1]] of their numbers."""

    def __init__(self, texts: list[str | None]):
        plain = pa.array(["" if x is None else x for x in texts], pa.large_string())
        whole = pc.match_substring_regex(plain, _WHOLE).to_pylist()
        if any(whole):
            plain = pa.array(["" if w or x is None else x for x, w in zip(texts, whole)], pa.large_string())
        parts = pc.split_pattern(plain, " ")
        self.offset = np.asarray(parts.offsets).astype(np.int64)
        coded = parts.flatten().dictionary_encode()
        index = np.array(coded.indices.to_numpy(zero_copy_only=False), dtype=np.int64)
        both = [" " + x for x in coded.dictionary.to_numpy(zero_copy_only=False).tolist()]
        first: dict[str, int] = {}
        heads = [x if w else (x or "").partition(" ")[0] for x, w in zip(texts, whole)]
        if len(heads):
            index[self.offset[:-1]] = [len(both) + first.setdefault(x, len(first)) for x in heads]
        both += first
        # A dictionary entry that only began texts is not used; it is left out so that it isn't encoded.
        used = np.zeros(len(both), dtype=bool)
        used[index] = True
        self.index = (np.cumsum(used) - 1)[index]
        self.distinct = [both[i] for i in np.flatnonzero(used)]

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Sum of the values of each text's units."""
        total = np.concatenate([[0], np.cumsum(np.asarray(values, dtype=np.int64)[self.index])])
        return total[self.offset[1:]] - total[self.offset[:-1]]


def compiled(pattern: str) -> regex.Pattern:
    """The pattern with the whitespace of the libraries: Unicode's property, without the separators 0x1C-0x1F."""
    return regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
