"""Language-model scores from a subword lattice.

The pieces of an existing vocabulary weight all segmentations of a word; a forward
recursion in log space sums them to the word's marginal probability.  Only pieces
that start a word carry the word mark, so the lattice of a text falls apart into the
lattices of its words, and the probabilities of all words add up to one.

Starting from the vocabulary's own scores, piece probabilities are fitted to the
training words by expectation maximisation (each distinct word once, as these
probabilities stand for words not yet known).  A word seen in training is one more
edge over its whole length: with absolute discount d, N tokens and V distinct words,

    P(word) = max(c - d, 0) / N + d V / N * lattice(word),    P(end) = c(end) / N

and the probability of a text is the product over its words and its end.

Word counts, piece counts and scores are Spark tables.  The driver holds the pieces
(one vocabulary) and the most frequent words, ``frequent`` at most; all other
words meet their counts in a join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gripelens.llm.scratch import free_finished_shuffles
from gripelens.llm.words import LOWER, KeyTable, mapped, sliced, space_words, text_array
from gripelens.session import materialise

FREQUENT = 1 << 17
ROUNDS = 2
DISCOUNT = 0.75
BLOCK_WORDS = 2048
MARK = "▁"

_BASE = np.uint64(0x9E3779B97F4A7C15)
_NOTHING = -1e30


def read_pieces(path: str) -> tuple[list[str], np.ndarray]:
    """Pieces and scores of a sentencepiece model; control pieces are left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    use = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i))]
    return [model.id_to_piece(i) for i in use], np.array([model.get_score(i) for i in use])


def start_probabilities(scores: np.ndarray) -> np.ndarray:
    """Natural logarithms of probabilities from a vocabulary's scores.

    Scores of merge vocabularies are negative ranks, which get Zipf weights; others
    are logarithms already.
    """
    if scores.size and scores.min() < -100:
        weight = 1.0 / (1.0 + scores.max() - scores)
    else:
        weight = np.exp(scores)
    return np.log(weight / weight.sum())


class Lattice:
    """All segmentations of words into pieces, for blocks of words at a time."""

    def __init__(self, pieces: list[str], log_p: np.ndarray):
        self.log_p = np.append(log_p, _NOTHING)
        self.none = len(pieces)
        bytes_ = {f"<0x{b:02X}>": b for b in range(256)}
        self.byte_piece = np.full(256, self.none, np.int64)
        plain: list[tuple[int, str]] = []
        for i, piece in enumerate(pieces):
            if piece in bytes_:
                self.byte_piece[bytes_[piece]] = i
            elif MARK not in piece[1:]:
                plain.append((i, piece))
        self.longest = max([1, *(len(p) for _, p in plain)])
        self.table = KeyTable(
            np.array([self._hash(p) for _, p in plain], np.uint64).view(np.int64),
            np.array([i for i, _ in plain], np.int64),
            self.none,
        )
        self.unknown = float(log_p.min()) - 10 if log_p.size else -20.0

    @staticmethod
    def _hash(piece: str) -> int:
        found = 0
        for c in piece:
            found = (found * int(_BASE) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
        return found

    def _byte_log_p(self, points: np.ndarray) -> np.ndarray:
        """Log-probability of each code point spelt in byte pieces."""
        distinct, at = np.unique(points, return_inverse=True)
        own = []
        for p in distinct.tolist():
            spelt = self.log_p[self.byte_piece[list(chr(p).encode("utf-8", "replace"))]]
            own.append(max(float(spelt.sum()), self.unknown * 4))
        return np.array(own)[at].reshape(points.shape)

    def _edges(self, words: list[str]):
        """Sizes, code points, and per piece length the piece over each start."""
        sizes = np.array([len(w) for w in words]) + 1
        width = int(sizes.max())
        flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        points = np.zeros((len(words), width), np.int64)
        points[:, 0] = ord(MARK)
        points[:, 1:][np.arange(width - 1) < (sizes - 1)[:, None]] = flat
        spelt = points.copy()
        spelt[:, 1:][points[:, 1:] == ord(MARK)] = 0x110000  # a mark in the text is a letter
        prefix = np.zeros((len(words), width + 1), np.uint64)
        for j in range(width):
            prefix[:, j + 1] = prefix[:, j] * _BASE + (spelt[:, j] + 1).astype(np.uint64)
        power, pieces = _BASE, []
        for length in range(1, min(self.longest, width) + 1):
            h = prefix[:, length:] - prefix[:, :-length] * power
            pieces.append(self.table.get(h.view(np.int64).reshape(-1)).reshape(h.shape))
            with np.errstate(over="ignore"):
                power = power * _BASE
        return sizes, points, pieces

    def _arcs(self, sizes: np.ndarray, points: np.ndarray, pieces: list[np.ndarray], by_start: bool):
        """All pieces over the words as (word, start, end, piece, log weight).

        Sorted by end and word, or by start and word.  A character that is no piece
        itself is spelt in byte pieces; its arc has the piece number ``none``.
        """
        n, width = points.shape
        alone = pieces[0]
        spelt = (alone == self.none) & (np.arange(width) < sizes[:, None])
        cells = np.full((width + 1, n, len(pieces)), -1, np.int64)
        for length, found in enumerate(pieces, 1):
            own = np.where(found == self.none, -1, found)
            if length == 1:
                own = np.where(spelt, self.none, own)
            at = slice(0, width + 1 - length) if by_start else slice(length, width + 1)
            cells[at, :, length - 1] = own.T
        place, word, length = np.nonzero(cells >= 0)
        piece, length = cells[place, word, length], length + 1
        start, end = (place, place + length) if by_start else (place - length, place)
        weight = self.log_p[piece]
        letters = np.flatnonzero(piece == self.none)
        if letters.size:
            weight[letters] = self._byte_log_p(points[word[letters], start[letters]])
        return word, start, end, piece, weight

    @staticmethod
    def _summed(arcs, values: np.ndarray, by_start: bool) -> None:
        """Fill ``values`` (word, position) with log sums, position after position."""
        word, start, end, _, weight = arcs
        here, there = (start, end) if by_start else (end, start)
        bounds = np.searchsorted(here, np.arange(values.shape[1] + 1))
        positions = range(values.shape[1] - 2, -1, -1) if by_start else range(1, values.shape[1])
        for j in positions:
            own = slice(bounds[j], bounds[j + 1])
            if bounds[j] == bounds[j + 1]:
                continue
            words = word[own]
            terms = weight[own] + values[words, there[own]]
            first = np.flatnonzero(np.concatenate([[True], words[1:] != words[:-1]]))
            top = np.maximum.reduceat(terms, first)
            spread = np.exp(terms - np.repeat(top, np.diff(np.append(first, words.size))))
            values[words[first], j] = top + np.log(np.add.reduceat(spread, first))

    def _forward(self, sizes: np.ndarray, points: np.ndarray, pieces: list[np.ndarray]):
        """The arcs by end, and the log sums over all ways to each position."""
        arcs = self._arcs(sizes, points, pieces, False)
        forward = np.full((points.shape[0], points.shape[1] + 1), _NOTHING)
        forward[:, 0] = 0.0
        self._summed(arcs, forward, False)
        return arcs, forward

    def _blocks(self, words: list[str]) -> Iterator[np.ndarray]:
        order = np.argsort([len(w) for w in words], kind="stable")
        start = 0
        while start < len(order):
            stop = min(start + BLOCK_WORDS, len(order))
            # long words make wide blocks: fewer of them at a time
            while stop > start + 1 and (stop - start) * len(words[order[stop - 1]]) > 1 << 17:
                stop = start + max(1, (stop - start) // 2)
            yield order[start:stop]
            start = stop

    def log_probability(self, words: list[str]) -> np.ndarray:
        """Natural logarithm of each word's marginal probability."""
        out = np.zeros(len(words))
        for block in self._blocks(words):
            sizes, points, pieces = self._edges([words[i] for i in block])
            out[block] = self._forward(sizes, points, pieces)[1][np.arange(len(block)), sizes]
        return out

    def expected(self, words: list[str]) -> np.ndarray:
        """Expected uses of each piece over all segmentations of the words."""
        counts = np.zeros(self.none + 1)
        for block in self._blocks(words):
            sizes, points, pieces = self._edges([words[i] for i in block])
            arcs, forward = self._forward(sizes, points, pieces)
            rows = np.arange(len(block))
            backward = np.full(forward.shape, _NOTHING)
            backward[rows, sizes] = 0.0
            self._summed(self._arcs(sizes, points, pieces, True), backward, True)
            word, start, end, piece, weight = arcs
            share = forward[word, start] + weight + backward[word, end] - forward[rows, sizes][word]
            share = np.exp(np.minimum(share, 0.0))
            counts += np.bincount(piece, share, self.none + 1)
            letters = piece == self.none
            spelt, at = np.unique(points[word[letters], start[letters]], return_inverse=True)
            for p, uses in zip(spelt.tolist(), np.bincount(at, share[letters], spelt.size)):
                np.add.at(counts, self.byte_piece[list(chr(p).encode("utf-8", "replace"))], uses)
        return counts[:-1]


# Spark side -----------------------------------------------------------------


def lower_words(values: pa.Array):
    """Words ``[^\\x20\\x09-\\x0D]+`` after A-Z became a-z."""
    return space_words(mapped(text_array(values), LOWER))


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5, is 1; a null id counts as an empty one."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 1


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, known, n): occurrences in training texts and in all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, limit=8 << 20):
            words = lower_words(batch.column("text"))
            codes, distinct = words.coded()
            train = ~batch.column("held_out").to_numpy(zero_copy_only=False)[words.text_of]
            n = len(distinct)
            yield pa.RecordBatch.from_arrays(
                [
                    distinct.cast(pa.string()),
                    pa.array(np.bincount(codes[train], minlength=n)),
                    pa.array(np.bincount(codes, minlength=n)),
                ],
                names=["word", "known", "n"],
            )

    found = docs.select("held_out", "text").mapInArrow(run, "word string, known long, n long")
    return found.groupBy("word").agg(F.sum("known").alias("known"), F.sum("n").alias("n"))


def fit_pieces(words: DataFrame, pieces: list[str], log_p: np.ndarray, rounds: int) -> np.ndarray:
    """Piece probabilities after ``rounds`` of expectation maximisation over the words.

    Each task sends one number per piece.  Pieces without use keep a small share.
    """
    context = words.sparkSession.sparkContext
    for _ in range(rounds):
        shared = context.broadcast((pieces, log_p))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            lattice = Lattice(*shared.value)
            total = np.zeros(len(shared.value[0]))
            for batch in batches:
                total += lattice.expected(batch.column("word").to_pylist())
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array(used.astype(np.int32)), pa.array(total[used])], names=["piece", "uses"]
            )

        uses = words.select("word").mapInArrow(run, "piece int, uses double")
        uses = uses.groupBy("piece").agg(F.sum("uses").alias("uses")).toPandas()
        counts = np.full(len(pieces), 0.01)
        counts[uses["piece"].to_numpy(np.int64)] += uses["uses"].to_numpy(np.float64)
        log_p = np.log(counts / counts.sum())
    return log_p


class _Scores:
    """Scores of words from their training counts and the fitted lattice."""

    def __init__(self, pieces, log_p, tokens: int, distinct: int, ends: int, discount: float):
        self.lattice = Lattice(pieces, log_p)
        self.tokens, self.distinct, self.ends, self.discount = tokens, distinct, ends, discount

    def base(self, known: np.ndarray) -> np.ndarray:
        return np.log10((known + 0.5) / (self.tokens + 0.5 * (self.distinct + 1)))

    def model(self, words: list[str], known: np.ndarray) -> np.ndarray:
        spread = self.lattice.log_probability(words) / np.log(10)
        if not self.tokens:  # nothing to learn from: even odds of another word
            return spread + np.log10(0.5)
        share = self.discount * max(self.distinct - 1, 1) / self.tokens
        seen = np.maximum(known - self.discount, 0) / self.tokens
        with np.errstate(divide="ignore"):
            return np.logaddexp(np.log(seen), (spread + np.log10(share)) * np.log(10)) / np.log(10)

    def end(self) -> float:
        return float(np.log10(self.ends / self.tokens if self.tokens else 0.5))


def _frequent_words(words: DataFrame, limit: int) -> pd.DataFrame:
    """(word, known) of the most frequent words, ``limit`` at most.

    A histogram of the counts, eight steps a doubling, gives the least count that at most
    ``limit`` words reach, so that tasks send no other words to the driver.
    """
    step = F.floor(F.log2("n") * 8).alias("step")
    histogram = words.groupBy(step).agg(F.count(F.lit(1)).alias("words"), F.min("n").alias("least"))
    least, taken = None, 0
    for row in sorted(histogram.collect(), key=lambda r: -r["step"]):
        taken += row["words"]
        if taken > limit:
            break
        least = row["least"]
    reached = F.lit(False) if least is None else F.col("n") >= least
    return words.filter(reached).select("word", "known").toPandas()


def score_texts(
    docs: DataFrame,
    path: str,
    frequent: int = FREQUENT,
    rounds: int = ROUNDS,
    discount: float = DISCOUNT,
    text: str = "text",
) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) per row.

    Scores are log10 probabilities of the whole text with its end; ``base_score``
    is that of add-half word counts.  Rows with a remainder of 1 of crc32(doc_id)
    modulo 5 are scored but not learned from.  A null text is empty: its end is its
    only token.  Without training rows all counts are 0.  Repeated rows count and are
    scored each.  Other columns are not read.
    """
    spark = docs.sparkSession
    free_finished_shuffles(spark)
    pieces, scores = read_pieces(path)
    source = docs.select(
        docs["doc_id"], F.coalesce(docs[text], F.lit("")).alias("text"), held_out(docs["doc_id"]).alias("held_out")
    )
    words = materialise(word_counts(source), "words")
    seen = words.filter("known > 0")
    facts = words.agg(
        F.coalesce(F.sum("known"), F.lit(0)).alias("known"), F.count_if(F.col("known") > 0).alias("distinct")
    ).first()
    ends = source.filter("NOT held_out").count()
    tokens, distinct = facts["known"] + ends, facts["distinct"] + (ends > 0)
    log_p = fit_pieces(seen, pieces, start_probabilities(scores), rounds)
    model = _Scores(pieces, log_p, tokens, distinct, ends, discount)
    top = _frequent_words(words, frequent)
    names, known = top["word"].tolist(), top["known"].to_numpy(np.int64)
    top_scores = np.stack([known > 0, model.base(known), model.model(names, known)], 1)
    shared = spark.sparkContext.broadcast(
        ({w: i for i, w in enumerate(names)}, top_scores, (pieces, log_p, tokens, distinct, ends, discount))
    )
    base_end = float(model.base(np.array([ends]))[0])
    model_end = model.end()

    def per_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, table, _ = shared.value
        table = np.vstack([table, np.zeros(3)])
        for batch in sliced(batches):
            own = lower_words(batch.column("text"))
            codes, distinct_words = own.coded()
            at = np.array([place.get(w, -1) for w in distinct_words.to_pylist()], np.int64)
            n, of = batch.num_rows, own.text_of
            found = at[codes]
            sums = [np.bincount(of, table[found, i], n) for i in range(3)]
            rare = found < 0
            keys, counts = np.unique(of[rare] * max(len(distinct_words), 1) + codes[rare], return_counts=True)
            ends_at = np.concatenate([[0], np.cumsum(np.bincount(keys // max(len(distinct_words), 1), minlength=n))])
            offsets = pa.array(ends_at.astype(np.int32))
            rest = distinct_words.take(pa.array(keys % max(len(distinct_words), 1))).cast(pa.string())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("row"),
                    batch.column("doc_id"),
                    batch.column("held_out"),
                    pa.array(own.per_text + 1),
                    pa.array(sums[0].astype(np.int64) + (ends > 0)),
                    pa.array(sums[1] + base_end),
                    pa.array(sums[2] + model_end),
                    pa.ListArray.from_arrays(offsets, rest),
                    pa.ListArray.from_arrays(offsets, pa.array(counts.astype(np.int32))),
                ],
                names=["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "model", "rest", "times"],
            )

    kind = source.schema["doc_id"].dataType.simpleString()
    texts = source.withColumn("row", F.monotonically_increasing_id()).mapInArrow(
        per_text,
        f"row long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, base double, "
        "model double, rest array<string>, times array<int>",
    )
    texts = materialise(texts, "texts")

    def per_word(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, _, made = shared.value
        own = _Scores(*made)
        for batch in batches:
            batch = batch.filter(pa.array([w not in place for w in batch.column("word").to_pylist()], pa.bool_()))
            names, known = batch.column("word").to_pylist(), batch.column("known").to_numpy()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("word"),
                    pa.array((known > 0).astype(np.int64)),
                    pa.array(own.base(known)),
                    pa.array(own.model(names, known)),
                ],
                names=["word", "k", "b", "m"],
            )

    scored = words.select("word", "known").mapInArrow(per_word, "word string, k long, b double, m double")
    rest = texts.select("row", F.explode(F.arrays_zip("rest", "times")).alias("w"))
    rest = rest.select("row", F.col("w.rest").alias("word"), F.col("w.times").alias("times"))
    rest = (
        rest.join(scored, "word")
        .groupBy("row")
        .agg(*[F.sum(F.col(c) * F.col("times")).alias(c) for c in ("k", "b", "m")])
    )
    zero = F.lit(0.0)
    return texts.drop("rest", "times").join(rest, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("k", F.lit(0))).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("b", zero)).alias("base_score"),
        (F.col("model") + F.coalesce("m", zero)).alias("score"),
    )
