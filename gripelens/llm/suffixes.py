"""Removal of repeated byte strings by per-shard suffix arrays.

A byte goes when some string of ``length`` bytes over it also starts earlier (a
smaller document, or the same one further left).  The work is cut into shards such
that equal strings always meet:

1. Whole copies of a text need no search: all but the smallest document lose every
   byte (if the text has ``length`` bytes at all).
2. In the other texts, anchors are set: the smallest hash among the k-byte grams of
   each window that a string of ``length`` bytes spans.  Equal strings have an anchor
   at the same place, so an anchor whose gram occurs once is in no repeated string.
3. The surroundings of every repeated anchor (as far as a string over it can reach)
   are grouped by a 128-bit hash of their bytes, beside the gram's.  Equal surroundings are repeated as a whole, so only
   their first occurrence, the representative, is looked at further.
4. Representatives whose gram, lengthened to one side by half of the rest of a string,
   occurs again are dealt out by their anchor's gram.  A shard takes a bounded
   number of bytes; a gram with more is cut into several shards.  Each shard sorts
   its suffixes by Larsson-Sadakane refinement up to the length of a string, so that
   suffixes of equal rank begin with equal strings, and learns which start earlier in it.
5. For grams with several shards, the MD5 digest and place of every string are listed
   and the smallest place of each digest is joined to the others.  This alone decides
   the matches of such a gram, within its shards too; there is no binary search.

Tables of a step are deleted once the next ones are written.
Results come back as spans per document; the text is joined to them once more to be
cut.  A document id must name one text: repeated rows of the same id and text count
as one document, and rows of the same id with other texts are put in the order of
their text's digest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gripelens.llm.scratch import free_finished_shuffles
from gripelens.llm.words import mix, raw_bytes, sliced, text_array
from gripelens.operators.ranking import with_row_index
from gripelens.session import materialise, release

LENGTH = 100
GRAM = 24
SHARD_BYTES = 1 << 20

_GOLD = np.uint64(0x9E3779B97F4A7C15)


# Numpy kernels ------------------------------------------------------------


def _words8(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as a big-endian number, zeros at the end."""
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    out = np.zeros(raw.size, np.uint64)
    for j in range(8):
        out = (out << np.uint64(8)) | padded[j : j + raw.size]
    return out


def suffix_array(
    raw: np.ndarray, left: np.ndarray, depth: int, least: int = 1
) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes sorted by their first ``depth`` bytes, and each suffix's group rank.

    ``left[i]`` bytes remain from i to the end of its text; nothing is compared
    beyond.  Larsson-Sadakane: sort by eight bytes, then double the sorted length by
    sorting the members of each group of equals by the rank of what follows; groups
    of one are finished and never touched again.  A rank is the place of the group's
    first member in the order; members of a group are in the order of their positions.
    Two suffixes with ``depth`` bytes have one rank if and only if these are equal.  The
    last step may leave out suffixes with fewer than ``least`` bytes: they keep the rank
    they had, somewhere in their group.
    """
    n = raw.size
    key = _words8(raw)
    if depth < 8:
        key &= ~np.uint64(0) << np.uint64(8 * (8 - depth))
    short = np.flatnonzero(left < 8)
    key[short] &= ~np.uint64(0) << (np.uint64(8) * (8 - left[short]).astype(np.uint64))
    order = np.argsort(key, kind="stable")
    rank = np.zeros(n, np.int64)

    def regroup(at: np.ndarray, members: np.ndarray, new: np.ndarray) -> np.ndarray:
        """Set ranks of ``members`` at places ``at``; returns those still in groups."""
        starts = np.flatnonzero(new)
        sizes = np.diff(np.append(starts, members.size))
        rank[members] = np.repeat(at[starts], sizes)
        return np.repeat(sizes, sizes) > 1

    sorted_key = key[order]
    new = np.ones(n, bool)
    new[1:] = sorted_key[1:] != sorted_key[:-1]
    place = np.arange(n)
    keep = regroup(place, order, new)
    place, h, bits = place[keep], 8, n.bit_length()
    while h < depth and place.size:
        step = min(h, depth - h)
        if h + step >= depth and least > 1:
            place = place[left[order[place]] >= least]
            if not place.size:
                break
        members = order[place]
        follows = np.zeros(members.size, np.int64)
        inside = left[members] > h
        follows[inside] = rank[members[inside] + step] + 1
        own = np.cumsum(np.diff(rank[members], prepend=-1) != 0)
        new = np.ones(members.size, bool)
        if int(own[-1]).bit_length() + 2 * bits < 64:  # all three fit into one number
            packed = np.sort((((own << bits) | follows) << bits) | members)
            members = packed & ((1 << bits) - 1)
            packed >>= bits
            new[1:] = packed[1:] != packed[:-1]
        else:
            again = np.lexsort((members, follows, own))
            members, own, follows = members[again], own[again], follows[again]
            new[1:] = (own[1:] != own[:-1]) | (follows[1:] != follows[:-1])
        order[place] = members
        keep = regroup(place, members, new)
        place, h = place[keep], h + step
    return order, rank


def common_prefixes(
    raw: np.ndarray, left: np.ndarray, starts: np.ndarray, order: np.ndarray, most: int, least: int = 1
) -> np.ndarray:
    """Common prefix of each suffix with the one before it in the order, up to ``most``.

    Kasai: the prefix of the next suffix of a text is at most one shorter, so it is
    extended from there.  All texts (from ``starts``) are walked at the same time, each
    as long as ``least`` bytes are left; the suffixes after that keep a zero.
    """
    n = raw.size
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    out = np.zeros(n, np.int64)
    at = starts[left[starts] >= least]
    h = np.zeros(at.size, np.int64)
    while at.size:
        other = before[at]
        most_here = np.where(other >= 0, np.minimum(np.minimum(left[at], left[other]), most), 0)
        h = np.minimum(np.maximum(h - 1, 0), most_here)
        going = np.flatnonzero(h < most_here)
        while going.size:
            same = raw[at[going] + h[going]] == raw[other[going] + h[going]]
            going = going[same]
            h[going] += 1
            going = going[h[going] < most_here[going]]
        out[at] = h
        more = left[at] > least
        at, h = at[more] + 1, h[more]
    return out


def equal_strings(raw: np.ndarray, left: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, group) of all strings of ``length`` bytes that occur more than once."""
    if not raw.size:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order, rank = suffix_array(raw, left, length, length)
    order = order[left[order] >= length]
    same = np.zeros(order.size, bool)
    same[1:] = rank[order[1:]] == rank[order[:-1]]
    member = same.copy()
    member[:-1] |= same[1:]
    group = np.cumsum(~same)
    return order[member], group[member]


def anchors(raw: np.ndarray, offsets: np.ndarray, gram: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each gram and which grams are the smallest of some window of grams.

    Grams that cross a text's end are never chosen; ties are all chosen.
    """
    n = raw.size
    eight = _words8(raw)
    h = np.zeros(n, np.uint64)
    for j in range(0, gram, 8):
        part = np.concatenate([eight[j:], np.zeros(min(j, n), np.uint64)])
        h = mix((h ^ part) + _GOLD)
    left = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(n)
    big = ~np.uint64(0)
    h = np.where(left >= gram, h & ~np.uint64(1), big)
    low, span = h, 1
    while span < window:  # minimum of the window from each gram on
        step = min(span, window - span)
        low = np.minimum(low, np.concatenate([low[step:], np.full(min(step, n), big)]))
        span += step
    low = np.where(left >= gram + window - 1, low, big)  # windows inside a text only
    # a gram is chosen if it equals the minimum of one of the windows that hold it
    top = np.where(low == big, np.uint64(0), low)
    span = 1
    while span < window:  # the largest such minimum; it is never above the gram itself
        step = min(span, window - span)
        top = np.maximum(top, np.concatenate([np.zeros(min(step, n), np.uint64), top[: n - step]]))
        span += step
    return h, np.flatnonzero((top == h) & (h != big))


# Tasks --------------------------------------------------------------------


def _find_anchors(length: int, gram: int):
    """One row for each anchor, with a 128-bit hash of its surroundings.

    Strings of ``length`` bytes over the gram lie from ``back`` bytes before it to
    ``ahead`` bytes after its start.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, limit=1 << 19):
            raw, offsets = raw_bytes(text_array(batch.column("text")))
            number = batch.column("number").to_numpy()
            h, chosen = anchors(raw, offsets, gram, length - gram + 1)
            text = np.searchsorted(offsets, chosen, "right") - 1
            back = np.minimum(chosen - offsets[text], length - gram)
            ahead = np.minimum(offsets[text + 1] - chosen, length)
            whole, digest = raw.tobytes(), xxhash.xxh3_128_digest
            places = zip((chosen - back).tolist(), (chosen + ahead).tolist(), back.tolist())
            found = b"".join([digest(whole[low:high], seed) for low, high, seed in places])
            halves = np.frombuffer(found, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(h[chosen].view(np.int64)),
                    pa.array(np.ascontiguousarray(halves[:, 0])),
                    pa.array(np.ascontiguousarray(halves[:, 1])),
                    pa.array(number[text]),
                    pa.array((chosen - offsets[text]).astype(np.int32)),
                    pa.array(back.astype(np.int32)),
                    pa.array(ahead.astype(np.int32)),
                ],
                names=["gram", "digest", "digest2", "number", "at", "back", "ahead"],
            )

    return run


def _cut_contexts(length: int, gram: int):
    """One row for each wanted surrounding, with its bytes and two hashes.

    A string of ``length`` bytes over the gram has half of its other bytes on one side:
    ``before`` and ``after`` are hashes of the gram with that many bytes of each side.
    """
    half = (length - gram + 1) // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            raw, offsets = raw_bytes(text_array(batch.column("text")))
            whole, wanted = raw.tobytes(), batch.column("wanted")
            text = np.repeat(np.arange(batch.num_rows), wanted.value_lengths().to_numpy())
            fields = wanted.flatten()
            at, back, ahead = (pc.struct_field(fields, c).to_numpy() for c in ("at", "back", "ahead"))
            place = offsets[text] + at
            rows = list(zip(place.tolist(), back.tolist(), ahead.tolist()))
            before = [_signed(whole[p - half : p + gram] if b >= half else b"") for p, b, _ in rows]
            after = [_signed(whole[p : p + gram + half] if a >= gram + half else b"") for p, _, a in rows]
            yield pa.RecordBatch.from_arrays(
                [
                    pc.struct_field(fields, "gram"),
                    pa.array(batch.column("number").to_numpy()[text]),
                    pa.array(at),
                    pa.array(at - back),
                    pa.array([whole[p - b : p + a] for p, b, a in rows], pa.binary()),
                    pa.array(before, pa.int64()),
                    pa.array(after, pa.int64()),
                ],
                names=["gram", "number", "at", "low", "bytes", "before", "after"],
            )

    return run


def _signed(part: bytes) -> int | None:
    """64-bit hash, or null for what does not exist."""
    found = xxhash.xxh3_64_intdigest(part)
    return (found - (1 << 64) if found >> 63 else found) if part else None


def _joined_spans(number: np.ndarray, start: np.ndarray, length: int):
    """Overlapping strings of one document as one span."""
    order = np.lexsort((start, number))
    number, start = number[order], start[order]
    new = np.ones(number.size, bool)
    new[1:] = (number[1:] != number[:-1]) | (start[1:] > start[:-1] + length)
    first = np.flatnonzero(new)
    last = np.append(first[1:], number.size)[: first.size] - 1
    return number[first], start[first], start[last] + length


def _spans_batch(number, low, high) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(number, pa.int64()), pa.array(low, pa.int32()), pa.array(high, pa.int32())],
        names=["number", "low", "high"],
    )


def _search_shards(length: int, shard_bytes: int):
    """Spans of strings that start earlier in their shard.

    A partition is sorted by shard key; whole keys are gathered up to half of
    ``shard_bytes`` and searched together.
    """

    def search(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(rows).combine_chunks()
        raw, offsets = raw_bytes(text_array_of_bytes(table["bytes"]))
        sizes = np.diff(offsets)
        left = np.repeat(offsets[1:], sizes) - np.arange(raw.size)
        position, group = equal_strings(raw, left, length)
        context = np.searchsorted(offsets, position, "right") - 1
        number = table["number"].to_numpy()[context]
        start = table["low"].to_numpy()[context] + (position - offsets[context])
        order = np.lexsort((start, number, group))
        number, start, group = number[order], start[order], group[order]
        first = np.ones(group.size, bool)
        first[1:] = group[1:] != group[:-1]
        lead = np.flatnonzero(first)[np.cumsum(first) - 1] if group.size else group
        later = (number != number[lead]) | (start != start[lead])
        return _spans_batch(*_joined_spans(number[later], start[later], length))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, last = 0, None
        for batch in batches:
            gram, salt = batch.column("gram").to_numpy(), batch.column("salt").to_numpy()
            sizes = pc.binary_length(batch.column("bytes")).to_numpy().astype(np.int64)
            ends = np.flatnonzero((gram[1:] != gram[:-1]) | (salt[1:] != salt[:-1])) + 1
            total, at = np.cumsum(sizes), 0
            for stop in [*ends.tolist(), batch.num_rows]:
                key = (gram[at], salt[at]) if at < batch.num_rows else None
                if held and key != last and 2 * size >= shard_bytes:
                    yield search(held)
                    held, size = [], 0
                if stop > at:
                    held.append(batch.slice(at, stop - at))
                    size += int(total[stop - 1] - (total[at - 1] if at else 0))
                    last = key
                at = stop
        if held:
            yield search(held)

    return run


def text_array_of_bytes(values: pa.ChunkedArray) -> pa.Array:
    """Binary values in the layout that ``raw_bytes`` reads."""
    plain = pa.concat_arrays([c.cast(pa.large_binary()) for c in values.chunks])
    return pa.concat_arrays([plain])


def _list_strings(length: int):
    """(digest, number, start) of every string of ``length`` bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            columns = (batch.column(c).to_pylist() for c in ("number", "low", "bytes"))
            for number, low, raw in zip(*columns):
                for i in range(len(raw) - length + 1):
                    out.append((hashlib.md5(raw[i : i + length]).digest(), number, low + i))
            parts = list(zip(*out)) if out else [()] * 3
            kinds = (pa.binary(), pa.int64(), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(parts, kinds)], names=["digest", "number", "start"]
            )

    return run


def _cut_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is left of each text without its spans."""
    for batch in sliced(batches):
        out = []
        texts, spans = batch.column("text").to_pylist(), batch.column("spans").to_pylist()
        for key, text, found in zip(batch.column("text_key").to_pylist(), texts, spans):
            raw, kept, end, runs = text.encode(), [], 0, 0
            for low, high in sorted((s["low"], s["high"]) for s in found or ()):
                if low > end or runs == 0:
                    kept.append(raw[end:low])
                    runs += 1
                end = max(end, high)
            kept.append(raw[end:])
            rest = b"".join(kept)
            out.append((key, len(raw) - len(rest), runs, rest))
        parts = list(zip(*out)) if out else [()] * 4
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.binary())
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(parts, kinds)],
            names=["text_key", "n_removed", "n_spans", "kept"],
        )


# The operator -------------------------------------------------------------


def repeated_spans(unique: DataFrame, length: int, gram: int, shard_bytes: int) -> DataFrame:
    """(number, spans): (low, high) of bytes in strings that start earlier; they may overlap.

    ``unique`` has (number, text) with distinct texts; numbers give the order.
    """
    kind = "gram long, digest long, digest2 long, number long, at int, back int, ahead int"
    found = unique.select("number", "text").mapInArrow(_find_anchors(length, gram), kind)
    found = materialise(found, "anchors")
    often = found.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("gram")
    repeated = materialise(found.join(often, "gram"), "repeated-anchors")
    release(found)
    same = ["gram", "digest", "digest2"]
    firsts = repeated.groupBy(*same).agg(
        F.min(F.struct("number", "at", "back", "ahead")).alias("first"), F.count(F.lit(1)).alias("n")
    )
    firsts = materialise(firsts, "surroundings")
    whole = (
        repeated.join(firsts.filter("n > 1").select(*same, "first"), same)
        .filter((F.col("number") != F.col("first.number")) | (F.col("at") != F.col("first.at")))
        .filter(F.col("back") + F.col("ahead") >= length)
        .select("number", (F.col("at") - F.col("back")).alias("low"), (F.col("at") + F.col("ahead")).alias("high"))
    )
    whole = materialise(whole, "whole")
    release(repeated)
    # representatives that share their gram, and half a string with it, with another one
    grams = firsts.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("gram")
    place = F.struct("gram", *[F.col(f"first.{c}").alias(c) for c in ("at", "back", "ahead")])
    places = (
        firsts.join(grams, "gram")
        .select(F.col("first.number").alias("number"), place.alias("place"))
        .groupBy("number")
        .agg(F.collect_list("place").alias("wanted"))
    )
    contexts = unique.join(places, "number").select("number", "text", "wanted")
    kind = "gram long, number long, at int, low int, bytes binary, before long, after long"
    contexts = materialise(contexts.mapInArrow(_cut_contexts(length, gram), kind), "contexts")
    release(firsts)
    size = F.octet_length("bytes").cast("long").alias("size")
    parts = []
    for side in ("before", "after"):
        own = contexts.select("gram", "number", "at", size, side).filter(F.col(side).isNotNull())
        more = own.groupBy("gram", side).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
        parts.append(own.join(more, ["gram", side]).select("gram", "number", "at", "size"))
    wanted = materialise(parts[0].union(parts[1]).distinct(), "wanted")
    load = wanted.groupBy("gram").agg(F.sum("size").alias("load"))
    load = load.select("gram", F.ceil(F.col("load") / shard_bytes).cast("int").alias("salts"))
    salted = wanted.join(load, "gram").select(
        "gram", "number", "at", F.pmod(F.xxhash64("number", "at"), "salts").cast("int").alias("salt"), "salts"
    )
    shared = materialise(
        contexts.drop("before", "after").join(salted, ["gram", "number", "at"]), "shared-contexts"
    )
    release(contexts, wanted)
    columns = ["gram", "salt", "number", "low", "bytes"]
    shards = shared.select(columns).repartition("gram", "salt").sortWithinPartitions("gram", "salt")
    inside = shards.mapInArrow(_search_shards(length, shard_bytes), "number long, low int, high int")
    # grams in several shards: their strings are looked up across the shards
    strings = shared.filter("salts > 1").select(columns).mapInArrow(
        _list_strings(length), "digest binary, number long, start int"
    )
    strings = materialise(strings.distinct(), "strings")
    least = strings.groupBy("digest").agg(
        F.min(F.struct("number", "start")).alias("first"), F.count(F.lit(1)).alias("n")
    )
    across = (
        strings.join(least.filter("n > 1"), "digest")
        .filter(F.struct("number", "start") > F.col("first"))
        .select("number", F.col("start").alias("low"), (F.col("start") + length).alias("high"))
    )
    spans = whole.union(inside).union(across).groupBy("number")
    spans = materialise(spans.agg(F.collect_list(F.struct("low", "high")).alias("spans")), "spans")
    release(whole, shared, strings)
    return spans


def remove_repeats(
    docs: DataFrame,
    length: int = LENGTH,
    gram: int = GRAM,
    shard_bytes: int = SHARD_BYTES,
    text: str = "text",
) -> DataFrame:
    """(doc_id, text_key, n_bytes, n_removed, n_spans, kept) for each row.

    ``kept`` are the bytes left, null if all are; ``text_key`` is the text's SHA-256.
    A null text is empty.  A null doc_id counts as larger than all others.  Rows that
    repeat an id and its text are one document and get the same result.  Other columns
    are not read.
    """
    spark = docs.sparkSession
    free_finished_shuffles(spark)
    own = F.coalesce(docs[text], F.lit(""))
    source = docs.select(docs["doc_id"], own.alias("text"), F.sha2(own, 256).alias("text_key"))
    rows = materialise(
        source.select("doc_id", "text_key", F.octet_length("text").cast("long").alias("n_bytes")), "rows"
    )
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id"))
    texts = rows.groupBy("text_key").agg(first.alias("first"), F.first("n_bytes").alias("n_bytes"))
    numbers = texts.filter(F.col("n_bytes") >= length).select(
        F.col("first.none").alias("none"), F.col("first.doc_id").alias("doc_id"), "text_key"
    )
    numbers = materialise(
        with_row_index(numbers, ["none", "doc_id", "text_key"], "number").select("number", "text_key"),
        "numbers",
    )
    long_texts = source.filter(F.octet_length("text") >= length).select("text_key", "text")
    unique = materialise(
        long_texts.groupBy("text_key").agg(F.first("text").alias("text")).join(numbers, "text_key"),
        "unique",
    )
    release(numbers)
    spans = repeated_spans(unique, length, gram, shard_bytes)
    cut = unique.join(spans, "number").select("text_key", "text", "spans").mapInArrow(
        _cut_texts, "text_key string, n_removed long, n_spans long, kept binary"
    )
    of_first = (
        texts.join(cut, "text_key", "left")
        .select("text_key", F.col("first.doc_id").alias("_first"), "n_removed", "n_spans", "kept")
    )
    row = rows.join(of_first, "text_key")
    copied = ~F.col("doc_id").eqNullSafe(F.col("_first"))
    gone = copied & (F.col("n_bytes") >= length)
    return row.select(
        "doc_id",
        "text_key",
        "n_bytes",
        F.when(gone, F.col("n_bytes")).when(copied, 0).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(gone, 1).when(copied, 0).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(gone, F.lit(b"")).when(~copied, F.col("kept")).alias("kept"),
    )
