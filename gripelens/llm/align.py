"""Alignment of two tokenizers' tokens, and how often their ids meet in a corpus.

Both tokenizers cut the same bytes, a blank and the text.  Where two tokens end at the
same byte a group of tokens closes.  The walk over both arrays of ends knows the
current index shift: as long as token i of one side ends where token i + shift of the
other does, windows of 1, 2, 4 ... tokens are compared at that shift and a whole
one-to-one stretch is jumped.  Where ends differ the side that ends earlier steps on
until both meet again, which sets a new shift.  Each place of the walk is one link: a
pair of tokens that overlap.

Many cursors walk at once.  They start at the beginning of each text and every
``CURSOR_TOKENS`` tokens, where a binary search gives the shift and the first common
end after it the start; a cursor stops where the next one began.

Long texts are encoded in parts.  A part ends before a blank between two ASCII letters
or digits, where neither tokenizer has a token that goes on: the byte-level one splits
there, and no piece of the other has its blank mark behind another character (else
texts are not cut).  So memory for tokens does not grow with the text.

Counts of id pairs are summed per document in the tasks and over documents in Spark.
The pairs found most often, at most ``FREQUENT``, go to all tasks; all rarer ones are
joined, so no join key is in more than a small share of the documents.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gripelens.llm.scratch import free_finished_shuffles
from gripelens.llm.words import KeyTable, sliced
from gripelens.session import materialise

CURSOR_TOKENS = 128
LONGEST_WINDOW = 64
PART_CHARS = 1 << 16
CHUNK_CHARS = 2 << 20
FREQUENT = 1 << 19

#: Fixed value: how byte-level tokenizers of this kind split a text.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_CUT = regex.compile(r"(?<=[0-9A-Za-z]) (?=[0-9A-Za-z])")


def _letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for."""
    own = [b for b in range(256) if 33 <= b < 127 or 161 <= b < 256 and b != 173]
    other = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(other)}


class ByteTokens:
    """Ids of a byte-level merge vocabulary; its special tokens are ordinary text.

    Merges are applied by rank, which needs ids in the order of the merges.
    """

    def __init__(self, spec: bytes):
        found = json.loads(spec)
        model, split = found["model"], found["pre_tokenizer"]
        if model["type"] != "BPE" or split["type"] != "ByteLevel" or found.get("normalizer"):
            raise ValueError("not a plain byte-level merge vocabulary")
        letters = _letters()
        special = {t["content"] for t in found.get("added_tokens", ())}
        ranks = {
            bytes(letters[c] for c in token): i for token, i in model["vocab"].items() if token not in special
        }
        merged = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        if any(a >= b for a, b in zip(merged, merged[1:])):
            raise ValueError("ids are not in the order of the merges")
        self.size = max(model["vocab"].values()) + 1
        self.bytes = [b""] * self.size
        for token, i in ranks.items():
            self.bytes[i] = token
        self._encoder = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def encode(self, parts: list[str]) -> list[np.ndarray]:
        return [self._encoder.encode_to_numpy(" " + part, disallowed_special=()) for part in parts]


class PieceTokens:
    """Ids of a piece vocabulary that puts a blank before a text."""

    def __init__(self, model: bytes):
        self._encoder = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.size = self._encoder.get_piece_size()
        pieces = [self._encoder.id_to_piece(i) for i in range(self.size)]
        self.bytes = [
            bytes([int(p[3:5], 16)]) if self._encoder.is_byte(i) else p.replace("▁", " ").encode()
            for i, p in enumerate(pieces)
        ]
        self.can_cut = not any("▁" in p.lstrip("▁") for p in pieces)

    def encode(self, parts: list[str]) -> list[np.ndarray]:
        return [np.array(ids, np.int64) for ids in self._encoder.encode(parts, num_threads=1)]


def _gathered(values: pa.Array, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the chosen values in a row, and where each begins and the last ends."""
    taken = values.take(pa.array(at))
    offsets = np.frombuffer(taken.buffers()[1], np.int64)[taken.offset : taken.offset + len(taken) + 1]
    data = taken.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def parts_of(text: str, cut: bool = True) -> list[str]:
    """The text in parts of about ``PART_CHARS``; joined by blanks they are the text."""
    parts, start = [], 0
    while cut and len(text) - start > 2 * PART_CHARS:
        found = _CUT.search(text, start + PART_CHARS)
        if not found:
            break
        parts.append(text[start : found.start()])
        start = found.end()
    return [*parts, text[start:]]


def _sync(a: np.ndarray, b: np.ndarray, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first places behind a common end at or after the end of each token i."""
    i, j = i.copy(), np.searchsorted(b, a[i])
    open_ = np.flatnonzero(a[i] != b[j])
    while open_.size:
        less = a[i[open_]] < b[j[open_]]
        i[open_] += less
        j[open_] += ~less
        open_ = open_[a[i[open_]] != b[j[open_]]]
    return i + 1, j + 1


def links(a: np.ndarray, b: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, closes) of all overlapping tokens of two arrays of ascending ends, in order.

    Both arrays end at the same value; ``starts`` are the tokens of ``a`` at which a text
    begins, which begins a token of ``b`` as well.  ``closes`` tells that both tokens end
    at one byte.
    """
    total = len(a) + len(b)
    first, state = np.zeros(total, np.int32), np.zeros(total, np.uint8)
    if not len(a):
        return first, first, state.astype(bool)
    more, more_j = _sync(a, b, np.arange(CURSOR_TOKENS - 1, len(a) - 1, CURSOR_TOKENS))
    starts_j = np.where(starts > 0, np.searchsorted(b, a[starts - 1]) + 1, 0)
    i = np.concatenate([starts, more, [len(a)]])
    j = np.concatenate([starts_j, more_j, [len(b)]])
    i, at = np.unique(i, return_index=True)
    j, stop = j[at][:-1], i[1:]
    i = i[:-1].copy()
    window = np.ones(len(i), np.int64)
    while i.size:
        equal = a[i] == b[j]
        step = np.flatnonzero(~equal)
        si, sj = i[step], j[step]
        first[si + sj], state[si + sj] = si, 1
        less = a[si] < b[sj]
        i[step] += less
        j[step] += ~less
        window[step] = 1
        run = np.flatnonzero(equal)
        for size in np.unique(window[run]):
            own = run[window[run] == size]
            ahead = np.arange(size)
            ri, rj = i[own][:, None] + ahead, j[own][:, None] + ahead
            inside = ri < stop[own][:, None]
            same = inside & (a[np.minimum(ri, len(a) - 1)] == b[np.minimum(rj, len(b) - 1)])
            same = np.logical_and.accumulate(same, axis=1)
            first[(ri + rj)[same]], state[(ri + rj)[same]] = ri[same], 2
            jumped = same.sum(axis=1)
            i[own] += jumped
            j[own] += jumped
            window[own] = np.where(jumped == size, min(2 * size, LONGEST_WINDOW), 1)
        left = i < stop
        if not left.all():
            i, j, stop, window = i[left], j[left], stop[left], window[left]
    place = np.flatnonzero(state)
    at = first[place]
    return at, (place - at).astype(np.int32), state[place] == 2


@dataclass
class _Found:
    """What is known of one text so far."""

    good: bool = True
    n_a: int = 0
    n_b: int = 0
    n_groups: int = 0
    n_links: int = 0
    pairs: list[np.ndarray] = field(default_factory=list)
    times: list[np.ndarray] = field(default_factory=list)
    digest: hashlib._Hash | None = None
    groups: list[bytes] | None = None

    def write(self, piece: memoryview) -> None:
        """Add groups; each but the last of all is followed by a semicolon."""
        if self.digest is None:
            self.digest = hashlib.sha256()
        else:
            self.digest.update(b";")
        self.digest.update(piece[:-1])
        if self.groups is not None:
            self.groups.append(bytes(piece[:-1]))

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        if len(self.pairs) < 2:
            return (self.pairs + [np.zeros(0, np.int64)])[0], (self.times + [np.zeros(0, np.int64)])[0]
        pairs, at = np.unique(np.concatenate(self.pairs), return_inverse=True)
        return pairs, np.bincount(at, np.concatenate(self.times)).astype(np.int64)


class Aligner:
    """Both tokenizers, the bytes of their tokens and the texts of their ids."""

    def __init__(self, spec: bytes, model: bytes):
        self.a, self.b = ByteTokens(spec), PieceTokens(model)
        self._bytes = [pa.array(side.bytes, pa.large_binary()) for side in (self.a, self.b)]
        names = [f"{i}{end}" for side, ends in ((self.a, ",|"), (self.b, ",;")) for i in range(side.size) for end in ends]
        self._names = pa.array([n.encode() for n in names], pa.large_binary())

    def run(self, texts: Iterable[str | None], with_groups: bool = False) -> list[_Found]:
        """The alignment of each text; a null or empty one has no tokens."""
        found, parts, owner, size = [], [], [], 0
        for n, text in enumerate(texts):
            found.append(_Found(groups=[] if with_groups else None))
            for part in parts_of(text, self.b.can_cut) if text else ():
                parts.append(part)
                owner.append(n)
                size += len(part)
                if size >= CHUNK_CHARS:
                    self._chunk(parts, owner, found)
                    parts, owner, size = [], [], 0
        if parts:
            self._chunk(parts, owner, found)
        return [f if f.good else _Found(groups=f.groups and []) for f in found]

    def _chunk(self, parts: list[str], owner: list[int], found: list[_Found]) -> None:
        want = [(" " + p).encode() for p in parts]
        sides = []
        for side, table in ((self.a, self._bytes[0]), (self.b, self._bytes[1])):
            ids = side.encode(parts)
            raw, ends = _gathered(table, np.concatenate(ids).astype(np.int64))
            at = np.concatenate([[0], np.cumsum([len(x) for x in ids])])
            view = memoryview(raw)
            for k, text in enumerate(want):
                if view[ends[at[k]] : ends[at[k + 1]]] != text:
                    found[owner[k]].good = False
            sides.append((ids, ends, at))
        keep = [k for k, n in enumerate(owner) if found[n].good]
        if not keep:
            return
        ids, ends, starts = [], [], []
        for own, places, at in sides:
            chosen = [own[k] for k in keep]
            ids.append(np.concatenate(chosen).astype(np.int64))
            sizes = np.diff(places)
            ends.append(np.cumsum(np.concatenate([sizes[at[k] : at[k + 1]] for k in keep])))
            starts.append(np.concatenate([[0], np.cumsum([len(x) for x in chosen])]))
        i, j, closes = links(ends[0], ends[1], starts[0][:-1])
        self._collect([owner[k] for k in keep], ids, starts, i, j, closes, found)

    def _collect(self, owner, ids, starts, i, j, closes, found) -> None:
        """Counts, groups and pairs of each text; its parts stand side by side."""
        owner = np.array(owner)
        heads = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        texts = owner[heads]
        from_a, from_b = (np.append(s[heads], s[-1]) for s in starts)
        at_link = np.append(np.searchsorted(i, from_a[:-1]), len(i))
        at_group = np.concatenate([[0], np.cumsum(closes)])[at_link]
        # groups as text: the tokens of one side, then those of the other
        last_a, last_b = i[closes], j[closes]
        out = np.empty(len(ids[0]) + len(ids[1]), np.int64)
        for side, (last, other) in enumerate(((last_a, last_b), (last_b, last_a))):
            n = len(ids[side])
            close = np.zeros(n, np.int64)
            close[last] = 1
            group = np.cumsum(close) - close
            ahead = np.append(0, other + 1)[group + side]
            out[np.arange(n) + ahead] = 2 * (ids[side] + side * self.a.size) + close
        raw, ends = _gathered(self._names, out)
        view = memoryview(raw)
        codes = ids[0][i] * self.b.size + ids[1][j]
        number = np.repeat(np.arange(len(texts)), np.diff(at_link))
        order = np.lexsort((codes, number)) if len(texts) > (1 << 62) // (self.a.size * self.b.size) else None
        if order is None:
            joined = np.sort(number * (self.a.size * self.b.size) + codes)
            number, codes = np.divmod(joined, self.a.size * self.b.size)
        else:
            number, codes = number[order], codes[order]
        new = np.ones(len(codes), bool)
        new[1:] = (codes[1:] != codes[:-1]) | (number[1:] != number[:-1])
        spot = np.flatnonzero(new)
        times, codes = np.diff(np.append(spot, len(codes))), codes[spot]
        bounds = np.searchsorted(number[spot], np.arange(len(texts) + 1))
        for k, n in enumerate(texts):
            f = found[n]
            f.n_a += int(from_a[k + 1] - from_a[k])
            f.n_b += int(from_b[k + 1] - from_b[k])
            f.n_links += int(at_link[k + 1] - at_link[k])
            f.n_groups += int(at_group[k + 1] - at_group[k])
            f.write(view[ends[from_a[k] + from_b[k]] : ends[from_a[k + 1] + from_b[k + 1]]])
            f.pairs.append(codes[bounds[k] : bounds[k + 1]])
            f.times.append(times[bounds[k] : bounds[k + 1]])


_ALIGNERS: dict[str, Aligner] = {}


def _aligner(spec: bytes, model: bytes) -> Aligner:
    key = hashlib.sha256(spec + model).hexdigest()
    if key not in _ALIGNERS:
        _ALIGNERS.clear()
        _ALIGNERS[key] = Aligner(spec, model)
    return _ALIGNERS[key]


def _lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*parts, np.zeros(0, np.int64)])))


def aligned(docs: DataFrame, spec: str, model: str, groups: bool = False, text: str = "text") -> DataFrame:
    """(row, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times) for each row.

    ``spec`` is the file of a byte-level merge vocabulary, ``model`` that of a piece
    vocabulary; both are read here and sent to the tasks.  ``pairs`` are the distinct
    linked ids, first id times the size of the second vocabulary plus second id, and
    ``times`` how often each is linked.  ``groups`` adds the groups as text.  A text that
    is null, empty or changed by a tokenizer has no tokens: zeros, empty lists and an
    empty ``groups_sha256``.  Repeated rows are rows of their own.
    """
    with open(spec, "rb") as f, open(model, "rb") as g:
        files = docs.sparkSession.sparkContext.broadcast((f.read(), g.read()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(*files.value)
        for batch in sliced(batches, "_text"):
            found = aligner.run(batch.column("_text").to_pylist(), groups)
            merged = [f.merged() for f in found]
            columns = [
                batch.column("row"),
                batch.column("doc_id"),
                *[pa.array([getattr(f, n) for f in found], pa.int64()) for n in ("n_a", "n_b", "n_groups", "n_links")],
                pa.array([f.digest.hexdigest() if f.digest else "" for f in found], pa.string()),
                _lists([m[0] for m in merged]),
                _lists([m[1] for m in merged]),
            ]
            if groups:
                columns.append(pa.array([b";".join(f.groups).decode() for f in found], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = (
        f"row long, doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, "
        "groups_sha256 string, pairs array<long>, times array<long>" + (", groups string" if groups else "")
    )
    names = [c.split()[0] for c in schema.split(", ")]
    source = docs.select(
        F.monotonically_increasing_id().alias("row"), docs["doc_id"].alias("doc_id"), docs[text].alias("_text")
    )
    return source.mapInArrow(run, schema)


def pair_counts(rows: DataFrame, width: int) -> DataFrame:
    """(pair, docs, best): in how many rows each pair is linked, and whether no pair of the
    same first id is linked in more."""
    counts = rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("docs"))
    first = F.expr(f"pair div {width}")
    counts = materialise(counts.withColumn("first", first), "counts")
    most = counts.groupBy("first").agg(F.max("docs").alias("most"))
    # at most one row for each id of the first vocabulary
    return counts.join(F.broadcast(most), "first").select("pair", "docs", (F.col("docs") == F.col("most")).alias("best"))


def _frequent(counts: DataFrame, limit: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(pairs, 2 * docs + best, least docs) of at most ``limit`` pairs, the most frequent."""
    level = F.floor(F.log2("docs") * 8)
    histogram = counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n"), F.min("docs").alias("least"))
    least, taken = float("inf"), 0
    for row in sorted(histogram.collect(), key=lambda r: -r["level"]):  # at most 8 rows a doubling
        taken += row["n"]
        if taken > limit:
            break
        least = row["least"]
    if least == float("inf"):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), least
    chosen = counts.filter(F.col("docs") >= int(least))
    found = chosen.select("pair", (F.col("docs") * 2 + F.col("best").cast("long")).alias("value")).toPandas()
    return found["pair"].to_numpy(), found["value"].to_numpy(), least


def alignment_counts(
    docs: DataFrame, spec: str, model: str, text: str = "text", frequent: int = FREQUENT
) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for each row.

    ``count_sum`` adds, over all links of a text, in how many rows their pair of ids is
    linked; ``n_best`` counts the links whose pair is linked in as many rows as any other
    pair of its first id.  At most ``frequent`` pairs are sent to all tasks; which pairs
    are changes no result.
    """
    spark = docs.sparkSession
    free_finished_shuffles(spark)
    rows = materialise(aligned(docs, spec, model, text=text), "aligned")
    with open(model, "rb") as g:
        width = PieceTokens(g.read()).size
    counts = materialise(pair_counts(rows, width), "pairs")
    shared = spark.sparkContext.broadcast(_frequent(counts, frequent)[:2])
    facts = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    kind = rows.schema["doc_id"].dataType.simpleString()

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = KeyTable(*shared.value, missing=-1)
        for batch in batches:
            lists = batch.column("pairs")
            n = np.diff(lists.offsets.to_numpy())
            pair = lists.flatten().to_numpy()
            times = batch.column("times").flatten().to_numpy()
            value = known.get(pair)
            of = np.repeat(np.arange(batch.num_rows), n)
            hit = value >= 0
            sums = [np.zeros(batch.num_rows, np.int64) for _ in range(2)]
            np.add.at(sums[0], of[hit], times[hit] * (value[hit] >> 1))
            np.add.at(sums[1], of[hit], times[hit] * (value[hit] & 1))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("row"),
                    *[batch.column(c) for c in facts],
                    *[pa.array(s) for s in sums],
                    _rest_lists(pair[~hit], of[~hit], batch.num_rows),
                    _rest_lists(times[~hit], of[~hit], batch.num_rows),
                ],
                names=["row", *facts, "count_sum", "n_best", "pairs", "times"],
            )

    schema = (
        f"row long, doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
        "count_sum long, n_best long, pairs array<long>, times array<long>"
    )
    looked = materialise(rows.mapInArrow(look_up, schema), "looked")
    rest = looked.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("p"))
    rest = rest.select("row", F.col("p.pairs").alias("pair"), F.col("p.times").alias("times"))
    rest = (
        rest.join(counts, "pair")
        .groupBy("row")
        .agg(
            F.sum(F.col("times") * F.col("docs")).alias("rest_sum"),
            F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("rest_best"),
        )
    )
    zero = F.lit(0).cast("long")
    return looked.join(rest, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links",
        (F.col("n_best") + F.coalesce("rest_best", zero)).alias("n_best"),
        (F.col("count_sum") + F.coalesce("rest_sum", zero)).alias("count_sum"),
        "groups_sha256",
    )


def _rest_lists(values: np.ndarray, of: np.ndarray, n: int) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=n))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values))
