"""Words and shingles of many texts at once, as offsets into one array of bytes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Each byte in lower case, or a space where it parts words. Words of letters and digits: other ASCII parts them. Words by space: only white space of ASCII does.
LETTERS = bytes(b if chr(b).isalnum() or b >= 0x80 else 32 for b in _LOWER)
BY_SPACE = bytes(32 if b == 32 or 9 <= b <= 13 else b for b in _LOWER)


@dataclass(frozen=True)
class Words:
    """Word i of all texts is norm[start[i]:end[i]]; one space stands behind each. Text j has the words first[j] to first[j + 1] - 1."""

    norm: bytes
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def shingles(self, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First and last word of each shingle, and how many each text has. A text of fewer words is one shingle; one of none has none."""
        n = self.counts()
        number = np.where(n >= size, n - size + 1, (n > 0).astype(np.int64))
        begin = np.cumsum(number) - number
        first = np.arange(number.sum()) + np.repeat(self.first[:-1] - begin, number)
        return first, np.minimum(first + size - 1, np.repeat(self.first[1:], number) - 1), number


def words_of(texts: list[bytes], table: bytes) -> Words:
    read = np.frombuffer((b" ".join(texts) + b" ").translate(table), np.uint8)
    inside = read != 32
    keep = inside.copy()
    keep[1:] |= inside[:-1]
    norm = read[keep]
    word = norm != 32
    before = np.concatenate([[False], word[:-1]])
    start = np.flatnonzero(word & ~before)
    at = np.cumsum([0, *(len(t) + 1 for t in texts)])  # of each text in read
    kept = np.concatenate([[0], np.cumsum(keep)])
    return Words(norm.tobytes(), start, np.flatnonzero(~word), np.searchsorted(start, kept[at[:-1]].tolist() + [len(norm)]))
