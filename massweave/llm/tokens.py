"""Public tokenizers inside Arrow functions.

The sentencepiece vocabulary lets a text be cut before a single space that stands between two
characters other than white space: no merge crosses such a place. Words repeat, so a task keeps what
it has counted, up to a bound in bytes; a text in which some piece is not safe (runs of white space)
is cut by a pattern.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np

#: Bytes (as far as Python's objects can be counted) of encoded pieces that a task keeps.
KEEP = 96_000_000
#: Bytes of an entry of a dictionary of short strings, besides the characters.
ENTRY = 190
#: Bytes of new pieces that are joined and encoded in one call.
JOINED = 20_000


def vocabulary(name: str) -> str:
    """Where the public vocabulary file of this name is on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def _pieces_model(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


@lru_cache(maxsize=2)
def _bytes_model(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class Known(dict):
    """What a task has encoded: a dictionary in two halves, of which the older one goes when the newer is full."""

    def __init__(self, most: int | None = None):
        super().__init__()
        self.older, self.left, self.half = {}, 0, (KEEP if most is None else most) // 2
        self.left = self.half

    def __missing__(self, piece):
        found = self[piece] = self.older[piece]
        self.left -= ENTRY + 2 * len(piece)
        return found

    def keep(self, entries: dict) -> None:
        """Adds entries; call it between batches only, as it may forget others."""
        if self.left < 0:
            self.older = dict(self)
            self.clear()
            self.left = self.half
        self.update(entries)
        self.left -= sum(ENTRY + 2 * len(p) for p in entries)

    def new(self, pieces: set) -> list:
        return [p for p in pieces if p not in self and p not in self.older]


def runs(pieces: list[str]) -> list[list[str]]:
    """The pieces in runs of about JOINED bytes."""
    ends = np.cumsum([len(p) for p in pieces]) // JOINED
    cuts = [0, *(np.flatnonzero(np.diff(ends)) + 1).tolist(), len(pieces)]
    return [pieces[a:b] for a, b in zip(cuts, cuts[1:]) if b > a]


class PieceCounter:
    """Token counts of a sentencepiece model in which a space only begins pieces."""

    #: Cuts where a single space stands between other characters (the library's own space sign counts as one).
    SAFE = re.compile("(?<=[^ ▁]) (?=[^ ▁])")

    def __init__(self, path: str):
        self.model, self.known = _pieces_model(path), Known()
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes = np.array([1 if self.model.is_byte(i) else len(p.encode()) for i, p in enumerate(names)])

    def _each(self, pieces: list[str]) -> list[int]:
        """Tokens of each piece: encoded joined by spaces, and told apart by the bytes that tokens stand for."""
        out: list[int] = []
        for run in runs(pieces):
            ends = np.cumsum(self.bytes[self.model.encode(" ".join(run), num_threads=1)])
            marks = np.cumsum([3 + len(p.encode()) for p in run])
            at = np.searchsorted(ends, marks)
            if at[-1] != len(ends) - 1 or (ends[at] != marks).any():
                out += map(len, self.model.encode(run, num_threads=1))
            else:
                out += np.diff(at, prepend=-1).tolist()
        return out

    def counts(self, texts: list[str]) -> list[int]:
        """The number of tokens of each text, as the library gives them for the whole text."""
        known, later, out = self.known, [], []
        known.keep({})
        cut = [text.split(" ") for text in texts]
        safe = [p for p in known.new(set().union(*cut)) if p and p[0] != "▁" and p[-1] != "▁"]
        known.keep(dict(zip(safe, self._each(safe))))
        for text, parts in zip(texts, cut):
            try:
                out.append(sum(map(known.__getitem__, parts)))
            except KeyError:
                later.append(len(out))
                out.append(0)
        for i in later:  # runs of spaces: longer pieces, still cut at safe places only
            parts = self.SAFE.split(texts[i]) if texts[i] else []
            missing = known.new(dict.fromkeys(parts))
            found = dict(zip(missing, map(len, self.model.encode(missing, num_threads=1))))
            out[i] = sum(found[p] if p in found else known[p] for p in parts)
        return out


class ByteEncoder:
    """Token ids of a byte-level BPE as little-endian unsigned 32-bit numbers.

    The vocabulary is the ``tokenizers`` file; its merges run in tiktoken, which gives the same ids (a test holds both
    together over every kind of character) in a quarter of the time and keeps nothing. The ids must be in the order of the merges.
    """

    #: Fixed value: the published pattern by which this kind of vocabulary cuts a text before it merges bytes.
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, path: str):
        import tiktoken

        self.model = _bytes_model(path)
        # In this kind of vocabulary each byte has a character: a visible one its own, the others those from 256 on.
        own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
        other = iter(range(256, 512))
        byte_of = {chr(b if b in own else next(other)): b for b in range(256)}
        ranks = {bytes(byte_of[c] for c in name): i for name, i in self.model.get_vocab(with_added_tokens=False).items() if all(c in byte_of for c in name)}
        special = {t.content: i for i, t in self.model.get_added_tokens_decoder().items()}
        ranks = {name: i for name, i in ranks.items() if i not in special.values()}
        self.coding = tiktoken.Encoding("bytes", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def ids(self, text: str) -> bytes:
        """The ids of a text, as the library gives them; special strings inside are tokens, which is its default."""
        try:
            ids = self.coding.encode_to_numpy(text, allowed_special="all")
        except ValueError:  # white space in such runs that the pattern's stack is too small
            ids = np.asarray(self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids)
        return ids.astype("<u4", copy=False).tobytes()


@lru_cache(maxsize=1)
def byte_encoder(path: str) -> ByteEncoder:
    """One encoder for all tasks of a worker process; it holds the vocabulary only."""
    return ByteEncoder(path)
