"""Words of whole texts as numbers, for operators that compare words inside tasks."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np

SPACE = re.compile(rb"[\x20\x09-\x0D]")
#: Bytes of a text that are split at once; a longer word is a piece of its own.
PIECE = 1 << 20


def pieces(raw: bytes) -> Iterator[bytes]:
    """Parts of a text, cut at white space, of about PIECE bytes."""
    at = 0
    while len(raw) - at > PIECE:
        found = SPACE.search(raw, at + PIECE)
        end = found.start() if found else len(raw)
        yield raw[at:end]
        at = end
    yield raw[at:]


def numbering() -> defaultdict[bytes, int]:
    """Gives each new word the next number, from 0."""
    return defaultdict(count().__next__)


def word_ids(raw: bytes, ids: defaultdict[bytes, int]) -> np.ndarray:
    """The words of a text by number; ``bytes.split`` knows the white space of the contracts and no other."""
    each = [np.fromiter(map(ids.__getitem__, words), np.int64, len(words)) for words in (p.split() for p in pieces(raw))]
    return each[0] if len(each) == 1 else np.concatenate(each)


def raw_text(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def words_between(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The words whose numbers lie in the spans (first, end), which are in order, joined by one space."""
    out, at, k = [], 0, 0
    for piece in pieces(raw):
        words = piece.split()
        end = at + len(words)
        while k < len(spans) and spans[k][0] < end:
            a, b = spans[k]
            if b > at:
                out.append(b" ".join(words[max(a, at) - at : min(b, end) - at]))
            if b > end:
                break
            k += 1
        at = end
    return b" ".join(out)
