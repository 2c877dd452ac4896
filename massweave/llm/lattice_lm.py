"""Language-model scores: marginal probability over the subword lattice of an existing vocabulary.

A document is a string of pieces of a public vocabulary, then an end. Pieces have unigram
probabilities, and a text's probability is the sum over all its segmentations of the product of its
pieces' (a character outside the vocabulary is spelled with byte pieces). A piece that begins a word
begins with the word sign, so the sum is the product over words of the sums over each word's lattice,
which a forward recursion in log space gives; all strings' probabilities add up to one.

The vocabulary's own scores are the ranks of its merges. Rank r starts as the weight 1 / (r + 1);
ROUNDS passes of forward-backward over the counts of all training words then weigh the pieces anew.
What is gathered grows with the input: the count of every training word, pre-aggregated in each task.
The most frequent words (HOT at most) go to all tasks; every other word of every document meets its
count in a join.

Defined results: a null or empty text is its end token alone; rows keep their ``doc_id`` (a null one
counts as the text "" for its remainder); repeated rows are scored each; with no training documents
N and V are 0, the base gives every token probability 1 and the pieces keep the weights of their
ranks; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from massweave.llm.arrow import by_bytes, table
from massweave.llm.common import discard, materialize, small_batches
from massweave.llm.tokens import _pieces_model, vocabulary

VOCABULARY = "piece_bpe_32k.model"
FOLDS = 10
#: Words with their counts that every task holds, at most.
HOT = 200_000
#: Words with counts (of a batch each) that a task holds before it adds them up and hands them on.
KEEP = 1_000_000
#: Passes of forward-backward, and what is added to the expected count of each piece.
ROUNDS, FLOOR = 2, 0.01
#: Words whose lattices are worked on in step, and characters from which a word is on its own (its places must fit 16 bits).
STEP, LONG = 20_000, 48
#: The sign that begins a word, and what stands for that character inside a text.
SIGN, OTHER = 0x2581, 0xFFFE


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % FOLDS == 0


def words_of(texts: list[str]) -> pa.Array:
    """For each text its words with A-Z in lower case; split at exactly the six white-space characters, with empty strings where a text begins or ends with one."""
    return pc.ascii_split_whitespace(pc.ascii_lower(pa.array(texts, pa.large_string())))


def word_counts(docs: DataFrame) -> DataFrame:
    """``word, n`` over the training documents; the word "" is the end of a document."""

    def count(batches):
        schema = pa.schema([("word", pa.string()), ("n", pa.int64())])
        held: list[pa.Table] = []
        rows = ended = 0
        for batch, texts in by_bytes(batches):
            found = words_of(texts).values.value_counts()
            one = pa.table([found.field("values").cast(pa.string()), found.field("counts")], schema=schema)
            held.append(one.filter(pc.not_equal(one.column("word"), "")))
            rows, ended = rows + len(found), ended + batch.num_rows
            if rows > KEEP:
                yield from merged(held)
                held, rows = [], 0
        if ended:
            yield from merged([*held, pa.table([[""], [ended]], schema=schema)])

    def merged(held: list[pa.Table]):
        yield from pa.concat_tables(held).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"]).to_batches(max_chunksize=50_000)

    train = docs.where(~held_out(F.col("doc_id"))).select(F.col("text").cast("string").alias("text"))
    return small_batches(train).mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


class Pieces:
    """The vocabulary's pieces as a trie in arrays: (node, character) to node in a table of open addresses."""

    def __init__(self, path: str):
        model = _pieces_model(path)
        self.size = model.get_piece_size()
        self.byte = np.zeros(256, dtype=np.int64)
        #: Weights from the ranks of the merges (the vocabulary's scores are 0, -1, -2 and so on); what was not merged comes last.
        self.ranked = np.full(self.size, 1 / self.size)
        steps: dict[tuple[int, int], int] = {}
        names: dict[int, int] = {}
        self.longest = 1
        for i in range(self.size):
            name = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte[int(name[3:5], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i)):
                node = 0
                for c in name:
                    node = steps.setdefault((node, ord(c)), len(steps) + 1)
                names[node] = i
                self.ranked[i] = 1 / (1 - model.get_score(i))
                self.longest = max(self.longest, len(name))
        self.piece = np.full(len(steps) + 1, -1, dtype=np.int32)
        self.piece[list(names)] = list(names.values())
        self.bits = max(4, (4 * len(steps)).bit_length())
        self.keys, self.nodes = np.full(1 << self.bits, -1, dtype=np.int64), np.zeros(1 << self.bits, dtype=np.int32)
        for (node, c), to in steps.items():
            key = node << 21 | c
            at = int(self._slot(np.array([key]))[0])
            while self.keys[at] >= 0:
                at = (at + 1) % len(self.keys)
            self.keys[at], self.nodes[at] = key, to

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def step(self, node: np.ndarray, c: np.ndarray) -> np.ndarray:
        """The next node, or -1."""
        key = node.astype(np.int64) << 21 | c
        at, out = self._slot(key), np.full(len(key), -1, dtype=np.int32)
        left = np.arange(len(key))
        while len(left):
            there = self.keys[at[left]]
            hit = there == key[left]
            out[left[hit]] = self.nodes[at[left[hit]]]
            left = left[~hit & (there >= 0)]
            at[left] = (at[left] + 1) % len(self.keys)
        return out


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


class Lattice:
    """Lattices of many words at once over pieces of given weights."""

    def __init__(self, weights: np.ndarray, end: float, path: str | None = None):
        """``weights``: of each piece, ``end``: of a document's end, not normalised."""
        self.pieces = pieces(path or vocabulary(VOCABULARY))
        total = weights.sum() + end
        self.log = np.log(weights / total)
        self.end = math.log10(end / total)

    def _edges(self, flat: np.ndarray, begin: np.ndarray, length: np.ndarray):
        """Edges (start place, characters, piece, log probability); the piece of a character spelled in bytes is -1."""
        p, ends = self.pieces, np.repeat(begin + length, length)
        start, node = np.arange(len(flat)), np.zeros(len(flat), dtype=np.int32)
        starts, sizes, names = [], [], []
        alone = np.ones(len(flat), dtype=bool)
        for n in range(1, p.longest + 1):
            inside = start + n <= ends[start]
            start, node = start[inside], node[inside]
            node = p.step(node, flat[start + n - 1])
            alive = node >= 0
            start, node = start[alive], node[alive]
            if not len(start):
                break
            name = p.piece[node]
            there = name >= 0
            if n == 1:
                alone[start[there]] = False
            starts.append(start[there])
            sizes.append(np.full(int(there.sum()), n))
            names.append(name[there])
        rest = np.flatnonzero(alone)
        starts.append(rest)
        sizes.append(np.ones(len(rest), dtype=np.int64))
        names.append(np.full(len(rest), -1, dtype=np.int32))
        start, size, name = map(np.concatenate, (starts, sizes, names))
        log = self.log[name]
        if len(rest):
            chars, at = np.unique(flat[rest], return_inverse=True)
            log[-len(rest) :] = np.array([self.log[p.byte[list(chr(c).encode("utf-8", "surrogatepass"))]].sum() for c in chars.tolist()])[at]
        return start, size, name, log

    def words(self, words: pa.Array, counts: np.ndarray | None = None) -> np.ndarray:
        """Log10 of the summed probability of all spellings of each word; or, given the words' counts, the expected count of each piece."""
        found, expected = np.zeros(len(words)), np.zeros(self.pieces.size)
        lengths = pc.utf8_length(words).to_numpy(zero_copy_only=False)
        short, long = np.flatnonzero(lengths < LONG), np.flatnonzero(lengths >= LONG)
        for part in [*(short[a : a + STEP] for a in range(0, len(short), STEP)), *(long[a : a + 1] for a in range(len(long)))]:
            found[part] = self._forward(words.take(pa.array(part)), lengths[part], None if counts is None else counts[part], expected)
        return found / math.log(10) if counts is None else expected

    def _forward(self, words: pa.Array, lengths: np.ndarray, counts: np.ndarray | None, expected: np.ndarray) -> np.ndarray:
        points = np.frombuffer("".join(words.to_pylist()).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
        size = lengths.astype(np.int64) + 1
        begin = np.cumsum(size) - size
        flat = np.full(int(size.sum()), SIGN, dtype=np.int64)
        inner = np.ones(len(flat), dtype=bool)
        inner[begin] = False
        flat[inner] = np.where(points == SIGN, OTHER, points)
        start, n, name, log = self._edges(flat, begin, size)
        # A word has a node before each character and one after the last.
        word = np.repeat(np.arange(len(size)), size)
        first = begin + np.arange(len(size))
        source = start + word[start]
        target = source + n
        place = target - first[word[start]]
        reach = np.full(len(flat) + len(size), -np.inf)
        reach[first] = 0
        last = first + size
        if len(size) == 1:
            order = np.argsort(place, kind="stable")
            add_up(reach, source[order], target[order], log[order])
            slices = None
        else:
            order = np.argsort((place * 64 + n).astype(np.int16), kind="stable")
            key = (place * 64 + n)[order]
            edges = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)]
            source, target, log, name, start = source[order], target[order], log[order], name[order], start[order]
            slices = list(zip(edges, edges[1:]))
            for a, b in slices:  # one end and one length, so each word has one edge at most
                to = target[a:b]
                reach[to] = np.logaddexp(reach[to], reach[source[a:b]] + log[a:b])
        whole = reach[last]
        if counts is not None:
            back = np.full(len(reach), -np.inf)
            back[last] = 0
            if slices is None:
                order = np.argsort(-source, kind="stable")
                add_up(back, target[order], source[order], log[order])
            else:
                order = np.argsort(-((source - first[word[start]]) * 64 + (target - source)), kind="stable")
                key = ((source - first[word[start]]) * 64 + (target - source))[order]
                edges = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)]
                for a, b in zip(edges, edges[1:]):
                    i = order[a:b]
                    to = source[i]
                    back[to] = np.logaddexp(back[to], back[target[i]] + log[i])
            share = np.exp(reach[source] + log + back[target] - whole[word[start]]) * counts[word[start]]
            known = name >= 0
            expected += np.bincount(name[known], weights=share[known], minlength=len(expected))
            for c, x in zip(flat[start[~known]].tolist(), share[~known].tolist()):
                np.add.at(expected, self.pieces.byte[list(chr(c).encode("utf-8", "surrogatepass"))], x)
        return whole


def add_up(reach: np.ndarray, source: np.ndarray, target: np.ndarray, log: np.ndarray) -> None:
    """The recursion over the edges of one word, given in an order that settles a node before it is left."""
    at = reach.tolist()
    for i, j, x in zip(source.tolist(), target.tolist(), log.tolist()):
        x += at[i]
        y = at[j]
        if y == -math.inf:
            at[j] = x
        elif x != -math.inf:
            at[j] = max(x, y) + math.log1p(math.exp(-abs(x - y)))
    reach[:] = at


def fitted(counts: DataFrame, docs: int, path: str | None = None, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """Weights of the pieces and of a document's end, from ``word, n`` of all training words.

    A task sends one number for each piece it has met; the driver gets as many as the vocabulary has pieces.
    """
    weights = pieces(path or vocabulary(VOCABULARY)).ranked
    end = float(weights.mean())
    words = counts.where("word <> ''")
    for _ in range(rounds if docs else 0):
        shared = counts.sparkSession.sparkContext.broadcast((weights, end))

        def expected(batches, shared=shared):
            lattice = Lattice(*shared.value, path)
            seen = np.zeros(len(shared.value[0]))
            for batch in batches:
                if batch.num_rows:
                    seen += lattice.words(batch.column("word"), batch.column("n").to_numpy())
            some = np.flatnonzero(seen)
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(seen[some], pa.float64())], names=["piece", "n"])

        rows = small_batches(words).mapInArrow(expected, "piece bigint, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect()
        weights = np.full(len(weights), FLOOR)
        weights[[r["piece"] for r in rows]] += [r["n"] for r in rows]
        end = float(docs)
        shared.unpersist()
    return weights, end


def scored(docs: DataFrame, path: str | None = None, hot: int = HOT) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for each row of ``docs``."""
    spark = docs.sparkSession
    counts = materialize(word_counts(docs))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v"), F.coalesce(F.sum(F.when(F.col("word") == "", F.col("n"))), F.lit(0)).alias("docs")).first()
    n, v = total["n"], total["v"]
    # The largest set of words, by count, that is within the bound.
    least, taken = None, 0
    for r in counts.groupBy(F.least("n", F.lit(100_000)).alias("n")).count().orderBy(F.desc("n")).limit(hot + 1).collect():
        if taken + r["count"] > hot:
            break
        taken, least = taken + r["count"], r["n"]
    often = counts.where(F.col("n") >= least).toArrow() if least is not None else None
    floor = n + 0.1 * (v + 1)
    names = often.column("word").combine_chunks().cast(pa.large_string()) if often else pa.array([], pa.large_string())
    shared = spark.sparkContext.broadcast((*fitted(counts, total["docs"], path), names, often.column("n").to_numpy() if often else np.zeros(0, np.int64)))

    def score(batches):
        weights, end, names, numbers = shared.value
        lattice, schema = Lattice(weights, end, path), None
        last = pc.index_in(pa.array([""], pa.large_string()), value_set=names)[0].as_py()
        for batch, texts in by_bytes(batches):
            entry = pa.struct([("word", pa.string()), ("tf", pa.int64())])
            schema = schema or pa.schema([batch.schema.field("row"), batch.schema.field("doc_id"), batch.schema.field("held_out"), ("n_tokens", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("model", pa.float64()), ("rare", pa.list_(entry))])
            split = words_of(texts)
            coded = split.values.dictionary_encode()
            words, of = coded.dictionary, coded.indices.to_numpy()
            doc = np.repeat(np.arange(len(texts)), np.diff(split.offsets.to_numpy()))
            real = pc.not_equal(words, "").to_numpy(zero_copy_only=False)[of]
            of, doc = of[real], doc[real]
            spelled = lattice.words(words)
            found = pc.fill_null(pc.index_in(words, value_set=names), -1).to_numpy()
            often = found >= 0
            base = np.where(often, np.log10(((numbers[found] if len(numbers) else 0) + 0.1) / floor), 0)
            each = len(texts)
            tokens = np.bincount(doc, minlength=each) + 1
            model = np.bincount(doc, weights=spelled[of], minlength=each) + lattice.end
            known = np.bincount(doc, weights=often[of], minlength=each).astype(np.int64)
            sums = np.bincount(doc, weights=base[of], minlength=each)
            pair, tf = np.unique((doc * len(words) + of)[~often[of]], return_counts=True)
            if last is not None:
                known, sums = known + 1, sums + math.log10((numbers[last] + 0.1) / floor)
                rare, to = words.take(pa.array(pair % max(len(words), 1))), pair // max(len(words), 1)
            else:  # the end is as rare as the words
                rare = pa.concat_arrays([words.take(pa.array(pair % max(len(words), 1))), pa.array([""] * each, pa.large_string())])
                to, tf = np.concatenate([pair // max(len(words), 1), np.arange(each)]), np.concatenate([tf, np.ones(each, np.int64)])
                order = np.argsort(to, kind="stable")
                rare, to, tf = rare.take(pa.array(order)), to[order], tf[order]
            ends = np.concatenate([[0], np.cumsum(np.bincount(to, minlength=each))]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([rare.cast(pa.string()), pa.array(tf, pa.int64())], names=["word", "tf"]))
            yield table(schema, row=batch.column("row"), doc_id=batch.column("doc_id"), held_out=batch.column("held_out"), n_tokens=tokens, known=known, base=sums, model=model, rare=lists)

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    fields = f"row bigint, doc_id {kind}, held_out boolean, n_tokens bigint, known bigint, base double, model double, rare array<struct<word:string,tf:bigint>>"
    done = materialize(small_batches(rows).mapInArrow(score, fields))
    met = done.select("row", F.inline("rare")).join(counts.where(F.col("n") < least) if least is not None else counts, "word", "left")
    c = F.coalesce("n", F.lit(0))
    rest = met.groupBy("row").agg(F.sum(F.when(c > 0, F.col("tf")).otherwise(0)).alias("known2"), F.sum(F.col("tf") * F.log10((c + 0.1) / F.lit(floor))).alias("base2"))
    every = done.drop("rare").join(rest, "row", "left")
    return every.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("known2", F.lit(0))).alias("n_known"), F.lit(n).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.coalesce("base2", F.lit(0.0))).alias("base_score"), F.col("model").alias("score"),
    )
