"""Quality rules by distribution divergence from language references.

Two histograms of a text are compared to those of its language by the Jensen-Shannon distance (0 to 1): the classes
of its characters, and its common words with the rest as one more. What a language is like is learned from
all documents: each of GUARD words or more adds the shares of its characters and words, whole numbers of the
same total for each, so neither long documents nor the order of rows count. The COMMON words of greatest weight
are a language's common words (lower-cased, without punctuation around).

Minimum-length guards: short texts scatter, so a distance may be larger by a term that falls with the
number of words; below GUARD words the base rule decides. A language with less than a thousandth of the weight is
no reference (so there are at most a thousand), and documents of such a language are not compared. All others
are compared to every reference and take the nearest, so a wrong language mark doesn't count against a text.

Base rule: fewer than GUARD words, or more than half of the words inside three-word windows that come again.

Defined results: a null or empty text has no words and fails the base rule; a null language is a language;
rows keep their ``doc_id``, repeated or null; whole texts are counted; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from massweave.llm.arrow import by_bytes, table
from massweave.llm.common import small_batches
from massweave.llm.words import numbering, raw_text, word_ids

GUARD, WINDOW = 50, 3
COMMON = 64
#: What each document adds to its language's words and to its characters, in whole numbers.
WORD_SHARE, CHAR_SHARE = 256, 1 << 16
#: The part of all weight that makes a language a reference: one in so many.
REFERENCES = 1000
#: Distances allowed: words, the root of a + b / (n + c); characters, a + b / n.
WORD_LIMIT, CHAR_LIMIT = (0.042, 13.0, 15.0), (0.15, 12.0)
SYMBOLS = b"#*$%&|<>"
TRIM = b".,;:!?\"'()-"
TOGETHER = 2_000_000
#: Words of a task that are held at once while a language is learned.
HELD = 200_000


def character_classes() -> np.ndarray:
    """The class of each byte: lower, upper, digit, clause mark, sentence mark, blank, other white space, lead byte, following byte, other."""
    kind = np.full(256, 9, np.uint8)
    for k, members in enumerate((range(97, 123), range(65, 91), range(48, 58), b".,;:'\"()-", b"!?", b" ", range(9, 14), range(192, 256), range(128, 192))):
        kind[list(members)] = k
    return kind


KIND, KINDS = character_classes(), 10
BLANK = np.isin(np.arange(256), [32, *range(9, 14)])
SYMBOL = np.isin(np.arange(256), list(SYMBOLS))


def trimmed(word: bytes) -> bytes:
    return word.lower().strip(TRIM)


def sums(x: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Sums of the stretches of ``x``."""
    total = np.concatenate([[0], np.cumsum(x, dtype=np.int64)])
    return total[end] - total[begin]


@dataclass
class Counted:
    """Texts of a batch as numbers: words of all, one after the other, and where each begins and ends."""

    raws: list[bytes]

    def __post_init__(self):
        numbers = numbering()
        each = [word_ids(r, numbers) for r in self.raws]
        self.words, self.n = np.concatenate(each), np.array([len(e) for e in each])
        self.end = np.cumsum(self.n)
        self.begin = self.end - self.n
        self.names = [trimmed(w) for w in numbers]
        self.of = np.repeat(np.arange(len(each)), self.n)
        sizes = np.array([len(r) for r in self.raws])
        self.last = np.cumsum(sizes)
        self.first = self.last - sizes
        self.bytes = np.frombuffer(b"".join(self.raws), np.uint8)

    def characters(self) -> np.ndarray:
        """Bytes of each class, a row for each text."""
        which = np.repeat(np.arange(len(self.raws), dtype=np.int32) * KINDS, self.last - self.first)
        return np.bincount(which + KIND[self.bytes], minlength=len(self.raws) * KINDS).reshape(-1, KINDS)

    def word_chars(self) -> np.ndarray:
        return sums(~BLANK[self.bytes] & ((self.bytes & 0xC0) != 0x80), self.first, self.last)

    def symbols(self) -> np.ndarray:
        return sums(SYMBOL[self.bytes], self.first, self.last)

    def repeated_lines(self) -> list[int]:
        out = []
        for raw in self.raws:
            lines = [x for x in raw.split(b"\n") if x.strip()]
            out.append(len(lines) - len(set(lines)))
        return out

    def repeated_words(self) -> np.ndarray:
        """Words inside three-word windows that a text has twice or more."""
        starts = np.flatnonzero(np.arange(len(self.words)) + WINDOW <= self.end[self.of]) if len(self.words) else np.zeros(0, np.int64)
        covered = np.zeros(len(self.words) + WINDOW, bool)
        if len(starts):
            many = len(self.names)
            key = self.words[starts] * many + self.words[starts + 1]
            if many >= 1 << 20:
                key = np.unique(key, return_inverse=True)[1]
            key = key * many + self.words[starts + 2]
            order = np.argsort(key, kind="stable")  # equal windows of one text come side by side
            key, text = key[order], self.of[starts[order]]
            same = (key[1:] == key[:-1]) & (text[1:] == text[:-1])
            again = starts[order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]]
            for k in range(WINDOW):
                covered[again + k] = True
        return sums(covered[: len(self.words)], self.begin, self.end)


@dataclass
class Reference:
    """A language: its common words, the shares of these and of the rest, the shares of the classes of characters."""

    words: list[bytes]
    shares: np.ndarray
    classes: np.ndarray


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The Jensen-Shannon distance, to base 2, of each row of ``p`` from ``q``."""
    with np.errstate(divide="ignore", invalid="ignore"):
        m = (p + q) / 2
        both = np.where(p > 0, p * np.log2(p / m), 0).sum(axis=1) + np.where(q > 0, q * np.log2(q / m), 0).sum(axis=1)
    return np.sqrt(np.maximum(both / 2, 0))


def limits(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distances of words and characters that a text of ``n`` words may have."""
    (a, b, c), (d, e) = WORD_LIMIT, CHAR_LIMIT
    return np.sqrt(a + b / (n + c)), d + e / np.maximum(n, 1)


def references(docs: DataFrame, common: int = COMMON) -> dict[str | None, Reference]:
    """The references, by language, learned from all rows of ``docs``."""
    fields = pa.schema([("lang", pa.string()), ("kind", pa.int32()), ("word", pa.binary()), ("weight", pa.int64())])

    def learn(batches):
        held: dict[tuple, int] = defaultdict(int)

        def out():
            lang, kind, word = zip(*held)
            made = table(fields, lang=list(lang), kind=list(kind), word=list(word), weight=list(held.values()))
            held.clear()
            return made

        for batch, texts in by_bytes(batches, most=TOGETHER):
            seen = Counted([raw_text(t) for t in texts])
            marks = seen.characters() * CHAR_SHARE // np.maximum(1, seen.last - seen.first)[:, None]
            for i, lang in enumerate(batch.column("lang").to_pylist()):
                if seen.n[i] < GUARD:
                    continue
                held[lang, -1, b""] += WORD_SHARE
                for k, x in enumerate(marks[i].tolist()):
                    held[lang, k, b""] += x
                number, times = np.unique(seen.words[seen.begin[i] : seen.end[i]], return_counts=True)
                counts: dict[bytes, int] = defaultdict(int)
                for w, x in zip(number.tolist(), times.tolist()):
                    counts[seen.names[w]] += x
                least = int(seen.n[i])
                for w, x in counts.items():
                    if w and WORD_SHARE * x >= least:
                        held[lang, -2, w] += WORD_SHARE * x // least
                if len(held) >= HELD:
                    yield out()
        if held:
            yield out()

    rows = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    weights = small_batches(rows).mapInArrow(learn, "lang string, kind int, word binary, weight bigint").groupBy("lang", "kind", "word").agg(F.sum("weight").alias("weight"))
    first = F.row_number().over(W.partitionBy("lang", "kind").orderBy(F.col("weight").desc(), "word"))
    kept = weights.withColumn("nth", first).where(F.col("nth") <= common).drop("nth")
    whole = F.sum(F.when(F.col("kind") == -1, F.col("weight")))
    total = kept.agg(whole.alias("total"))
    large = kept.groupBy("lang").agg(whole.alias("own")).crossJoin(F.broadcast(total)).where(F.col("own") * REFERENCES >= F.col("total")).select(F.col("lang").alias("large"))
    found: dict[str | None, Reference] = {}
    by: dict = defaultdict(list)
    for r in kept.join(F.broadcast(large), F.col("lang").eqNullSafe(F.col("large"))).orderBy("lang", "kind", F.col("weight").desc(), "word").collect():
        by[r["lang"]].append(r)
    for lang, own in by.items():
        words = [r for r in own if r["kind"] == -2]
        mass = next(r["weight"] for r in own if r["kind"] == -1)
        marks = np.zeros(KINDS)
        for r in own:
            if r["kind"] >= 0:
                marks[r["kind"]] = r["weight"]
        shares = np.array([r["weight"] for r in words] + [max(0, mass - sum(r["weight"] for r in words))], np.float64)
        found[lang] = Reference([bytes(r["word"]) for r in words], shares / shares.sum(), marks / marks.sum())
    return found


def divergences(seen: Counted, known: dict[str | None, Reference]) -> tuple[np.ndarray, np.ndarray, list[str | None]]:
    """Of each text the distances of its words and its characters from the reference that it fits best, and that reference's language."""
    vocabulary = {w: k for k, w in enumerate(dict.fromkeys(w for r in known.values() for w in r.words))}
    many = len(seen.raws)
    n, size = np.maximum(seen.n, 1).astype(np.float64), np.maximum(seen.last - seen.first, 1)
    at = np.array([vocabulary.get(w, -1) for w in seen.names] or [0])[seen.words] if len(seen.words) else np.zeros(0, np.int64)
    hit = at >= 0
    counts = np.bincount(seen.of[hit] * len(vocabulary) + at[hit], minlength=many * len(vocabulary)).reshape(many, -1) if vocabulary else np.zeros((many, 0))
    classes = seen.characters() / size[:, None]
    words_most, chars_most = limits(seen.n)
    best, words, chars, which = np.full(many, np.inf), np.zeros(many), np.zeros(many), np.zeros(many, np.int64)
    for k, r in enumerate(known.values()):
        own = counts[:, [vocabulary[w] for w in r.words]] / n[:, None]
        dw = distance(np.column_stack([own, np.maximum(0, 1 - own.sum(axis=1))]), r.shares)
        dc = distance(classes, r.classes)
        excess = np.maximum(dw / words_most, dc / chars_most)
        better = excess < best
        best, words, chars, which = np.where(better, excess, best), np.where(better, dw, words), np.where(better, dc, chars), np.where(better, k, which)
    names = list(known)
    return words, chars, [names[k] for k in which.tolist()] if names else [None] * many


def quality_rules(docs: DataFrame, common: int = COMMON) -> DataFrame:
    """For each row the base counts, the distances from the nearest reference and the verdicts.

    ``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, word_divergence, char_divergence, nearest, kept``;
    the distances are null where nothing was compared.
    """
    known = references(docs, common)

    def judge(batches):
        most = max(1, (1 << 22) // max(1, sum(len(r.words) for r in known.values())))
        for whole, all_texts in by_bytes(batches, most=TOGETHER):
            for start in range(0, whole.num_rows, most):
                batch, seen = whole.slice(start, most), Counted([raw_text(t) for t in all_texts[start : start + most]])
                schema = pa.schema([batch.schema.field("doc_id"), *[(c, pa.int64()) for c in COUNTS], ("base_failed", pa.bool_()), ("word_divergence", pa.float64()), ("char_divergence", pa.float64()), ("nearest", pa.string()), ("kept", pa.bool_())])
                repeated = seen.repeated_words()
                failed = (seen.n < GUARD) | (2 * repeated > seen.n)
                words, chars, nearest = divergences(seen, known)
                compared = np.array([lang in known for lang in batch.column("lang").to_pylist()]) & (seen.n >= GUARD)
                words_most, chars_most = limits(seen.n)
                kept = ~failed & (~compared | (words <= words_most) & (chars <= chars_most))
                yield table(
                    schema, doc_id=batch.column("doc_id"), n_words=seen.n, word_chars=seen.word_chars(), n_symbols=seen.symbols(), n_dup_lines=seen.repeated_lines(), n_repeat_words=repeated,
                    base_failed=failed, word_divergence=pa.array(words, mask=~compared), char_divergence=pa.array(chars, mask=~compared),
                    nearest=[name if c else None for name, c in zip(nearest, compared.tolist())], kept=kept,
                )

    rows = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    counts = ", ".join(f"{c} bigint" for c in COUNTS)
    return small_batches(rows).mapInArrow(judge, f"doc_id {kind}, {counts}, base_failed boolean, word_divergence double, char_divergence double, nearest string, kept boolean")


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
