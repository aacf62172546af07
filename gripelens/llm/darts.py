"""Near-duplicate documents by DartMinHash signatures.

A text is a weighted set: its five-word shingles, weighted by their counts (a text
of fewer words has one shingle, all its words).  Darts are thrown on the region
(element, weight, rank): for each element and each weight cell [2^v - 1, 2^(v+1) - 1)
hashed exponential gaps give the ranks of a Poisson process, a hashed weight inside
the cell says whether the dart lies below the element's weight, and a hashed
coordinate says which of the k signature entries it belongs to.  All depends on the
element only, so equal regions receive equal darts.  Each coordinate keeps its
earliest dart; two texts agree in a coordinate with a probability equal to their
weighted Jaccard similarity.  A text of total weight W looks at ranks up to
k (ln k + 2) / W, in the rare case that a coordinate stays empty at twice the limit,
and so on: about k ln k darts for a text of any length.

Signatures are joined on bands of rows.  Candidates are checked by their exact
weighted similarity.  In a band bucket the first round compares members with one
pivot, later rounds take more pivots and drop whatever already is one group, until
no bucket has two groups with uncompared members: no pair within a group is listed
that its pivots have already joined, and no link between groups is left out.  Each
round first drops the members whose shingles are too rare outside their own group
for any link to another one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gripelens.llm.components import connected_components, shortened
from gripelens.llm.scratch import free_finished_shuffles
from gripelens.llm.words import hashes, mix, plain_words, sliced, text_array
from gripelens.session import materialise, materialise_with, release

SHINGLE = 5
SIMILARITY = 0.8
BANDS = 25
ROWS = 5
MAIN_TURNS = 2
TRIES = 4
# Darts that are thrown at once; texts of any length have about as many.
DARTS = 1 << 20
# Nodes that are left all meet their buckets at once if a bucket row meets so many of
# them on average; it decides how many rounds there are, not the result.
MET = 256
# Members of a bucket that meet a reference; it decides what is compared, not the result.
CROWD = 16
# What tells whether a member can have a link.
SIZE = ("weight", "shared", "room", "reach")

_GOLD = np.uint64(0x9E3779B97F4A7C15)


def _unit(x: np.ndarray) -> np.ndarray:
    """Hash to (0, 1]."""
    return ((x >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0**-53


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle hash, count), sorted by both, and a 128-bit hash of all words of each
    text: two sums over its words, each of another hash of the word and its place."""
    words = plain_words(texts)
    codes, distinct = words.coded()
    h, other = (hashes(distinct, seed)[codes] if codes.size else np.zeros(0, np.uint64) for seed in (0, 1))
    n, starts = words.per_text, words.offsets[:-1]
    whole = np.zeros((len(n), 2), np.uint64)
    if h.size:
        place = (np.arange(h.size) - np.repeat(starts, n)).astype(np.uint64)
        for half, own in enumerate((h, other)):
            spread = mix(own + (place + np.uint64(half)) * _GOLD)
            ends = np.concatenate([np.zeros(1, np.uint64), np.cumsum(spread, dtype=np.uint64)])
            whole[:, half] = ends[words.offsets[1:]] - ends[words.offsets[:-1]] + n.astype(np.uint64)
    gram = np.zeros(h.size, np.uint64)
    size = np.minimum(np.repeat(n, n), SHINGLE)
    for j in range(SHINGLE):
        shifted = np.concatenate([h[j:], np.zeros(min(j, h.size), np.uint64)])
        gram = np.where(j < size, mix(gram * _GOLD + shifted + np.uint64(j + 1)), gram)
    left = np.repeat(words.offsets[1:], n) - np.arange(h.size)
    begins = left >= size
    text, gram = words.text_of[begins], gram[begins]
    order = np.lexsort((gram, text))
    text, gram = text[order], gram[order]
    first = np.ones(text.size, bool)
    first[1:] = (text[1:] != text[:-1]) | (gram[1:] != gram[:-1])
    at = np.flatnonzero(first)
    counts = np.diff(np.append(at, text.size))
    return text[at], gram[at], counts, whole


def throw_darts(
    text: np.ndarray, element: np.ndarray, weight: np.ndarray, limit: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, coordinate, rank, dart) of all darts with a rank below ``limit[text]``."""
    found: list[tuple] = []
    top = int(math.floor(math.log2(weight.max() + 1))) if weight.size else -1
    for cell in range(top + 1):
        low, width = 2.0**cell - 1, 2.0**cell
        own = np.flatnonzero(weight > low)
        seed = mix(element[own] + _GOLD * np.array([cell + 1], np.uint64))
        rank = np.zeros(own.size)
        step = 0
        while own.size:
            step += 1
            dart = mix(seed + _GOLD * np.array([step], np.uint64))
            rank = rank - np.log(_unit(dart)) / width
            keep = rank < limit[text[own]]
            own, seed, rank, dart = own[keep], seed[keep], rank[keep], dart[keep]
            inside = low + width * (1 - _unit(mix(dart ^ np.uint64(0x5851F42D4C957F2D)))) < weight[own]
            spot = (mix(dart + np.uint64(1)) >> np.uint64(32)) * np.uint64(k) >> np.uint64(32)
            hit = np.flatnonzero(inside)
            found.append((text[own[hit]], spot[hit].astype(np.int64), rank[hit], dart[hit]))
    if not found:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0), np.zeros(0, np.uint64))
    return tuple(np.concatenate(part) for part in zip(*found))


def signatures(
    text: np.ndarray, element: np.ndarray, weight: np.ndarray, n_texts: int, k: int
) -> np.ndarray:
    """The earliest dart of each coordinate: one row of k values per text.

    Texts without elements have a row of zeros.
    """
    out = np.zeros((n_texts, k), np.uint64)
    total = np.bincount(text, weight, n_texts)
    left = total > 0
    limit = np.zeros(n_texts)
    limit[left] = k * (math.log(k) + 2) / total[left]
    while left.any():
        use = left[text]
        t, spot, rank, dart = throw_darts(text[use], element[use], weight[use], limit, k)
        order = np.lexsort((rank, t * k + spot))
        key = (t * k + spot)[order]
        first = np.ones(key.size, bool)
        first[1:] = key[1:] != key[:-1]
        key, dart = key[first], dart[order][first]
        full = np.bincount(key // k, minlength=n_texts) == k
        chosen = full[key // k]
        out.reshape(-1)[key[chosen]] = dart[chosen]
        left &= ~full
        limit = limit * 2
    return out


def band_keys(found: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key per text and band."""
    keys = np.zeros((found.shape[0], bands), np.uint64)
    for b in range(bands):
        key = np.full(found.shape[0], b + 1, np.uint64)
        for r in range(rows):
            key = mix(key * _GOLD + found[:, b * rows + r])
        keys[:, b] = key
    return keys.view(np.int64)


def _lists(flat: pa.Array, counts: np.ndarray) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), flat)


def _keys(whole: np.ndarray, empty: np.ndarray) -> pa.Array:
    """Rows of two 64-bit values as 16 bytes; null where ``empty``."""
    flat = pa.FixedSizeBinaryArray.from_buffers(
        pa.binary(16), len(whole), [None, pa.py_buffer(np.ascontiguousarray(whole).tobytes())]
    ).cast(pa.binary())
    return pc.if_else(pa.array(empty), pa.scalar(None, pa.binary()), flat)


def _keyed(docs: DataFrame, text: str) -> DataFrame:
    """doc_id, the text, and a digest of it that joins use instead of the text."""
    own = F.coalesce(docs[text], F.lit(""))
    return docs.select(docs["doc_id"], own.alias("_text"), F.sha2(own, 256).alias("text_key"))


def signed(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, text: str = "text") -> DataFrame:
    """(doc_id, text_key, words_key, weight, bands) for each row of ``docs``.

    ``words_key`` is null and ``bands`` is empty for a text without words.
    """

    k = bands * rows
    most = max(int(DARTS / (k * (math.log(k) + 2))), 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "_text", rows=most):
            of, gram, counts, whole = shingle_sets(text_array(batch.column("_text")))
            n = batch.num_rows
            found = signatures(of, gram, counts.astype(np.float64), n, k)
            keys = band_keys(found, bands, rows)
            weight = np.bincount(of, counts, n).astype(np.int64)
            empty = weight == 0
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("text_key"),
                    _keys(whole, empty),
                    pa.array(weight),
                    _lists(pa.array(keys[~empty].reshape(-1)), np.where(empty, 0, bands)),
                ],
                names=["doc_id", "text_key", "words_key", "weight", "bands"],
            )

    source = _keyed(docs, text)
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(
        run,
        f"doc_id {kind}, text_key string, words_key binary, weight long, bands array<long>",
    )


def shingled(keyed: DataFrame) -> DataFrame:
    """(words_key, units): the weighted shingle set as a plain set.

    The j-th occurrence of a shingle is a unit of its own, so the sets' Jaccard
    similarity is the weighted similarity of the texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "_text"):
            of, gram, counts, whole = shingle_sets(text_array(batch.column("_text")))
            nth = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            units = np.repeat(gram, counts)
            units = np.where(nth > 0, mix(units + nth.astype(np.uint64) * _GOLD), units)
            weight = np.bincount(of, counts, batch.num_rows).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [_keys(whole, weight == 0), _lists(pa.array(units.view(np.int64)), weight)],
                names=["words_key", "units"],
            )

    return keyed.select("_text").mapInArrow(run, "words_key binary, units array<long>")


def _similar(pairs: DataFrame, units: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose exact similarity reaches the threshold."""
    left = units.select(F.col("node").alias("a"), F.col("units").alias("left"))
    right = units.select(F.col("node").alias("b"), F.col("units").alias("right"))
    both = F.size(F.array_intersect("left", "right"))
    return (
        pairs.hint("merge").join(left, "a")
        .join(right.hint("merge"), "b")
        .withColumn("both", both)
        .filter(F.col("both") >= threshold * (F.size("left") + F.size("right") - F.col("both")) - 1e-9)
        .select("a", "b")
    )


def _close(a: Column, b: Column, threshold: float) -> Column:
    """Sizes that can reach the threshold at all."""
    return F.least(a, b) >= threshold * F.greatest(a, b) - 1e-9


def _open_buckets(buckets: DataFrame, label: DataFrame) -> DataFrame:
    """Members of buckets with more than one group: with their group and its main group."""
    member = buckets.join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    groups = member.groupBy("band", "label").agg(F.count(F.lit(1)).alias("n"))
    main = (
        groups.groupBy("band")
        .agg(
            F.max_by("label", F.struct("n", "label")).alias("main"),
            F.count(F.lit(1)).alias("groups"),
        )
        .filter("groups > 1")
        .select("band", "main")
    )
    return member.join(main, "band")


def shared_buckets(nodes: DataFrame) -> DataFrame:
    """(band, node, weight, pivot) of all bands that two nodes or more have."""
    buckets = nodes.select("node", "weight", F.explode(F.array_distinct("bands")).alias("band"))
    shared = buckets.groupBy("band").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("node", "weight")).alias("pivot")
    )
    return buckets.join(shared.filter("n > 1").drop("n"), "band")


def links(buckets: DataFrame, units: DataFrame, threshold: float) -> DataFrame:
    """(node, label) of all nodes that are linked to another one.

    ``buckets`` are the ``shared_buckets``, ``units`` the sets of their nodes.  First each
    node meets one other.  Then rounds follow: each node outside a main group tries the
    cleanest members of the main groups it meets, those with the fewest units that no
    other group has.  From the third round on the cleanest nodes outside meet all their
    buckets, then the others, until nothing is left to compare.  In each round a crowded
    bucket first meets a reference, which tells most members without a link.  The tables
    of a round are deleted once the next one's are written.
    """
    first = (
        buckets.filter(F.col("node") != F.col("pivot.node"))
        .filter(_close(F.col("weight"), F.col("pivot.weight"), threshold))
        .groupBy(F.col("node").alias("a"))
        .agg(F.min("pivot.node").alias("b"))
    )
    compared = [materialise(first, "pairs")]
    found = shortened(_similar(compared[0], units, threshold))
    last, buckets, turn = buckets, buckets.drop("pivot"), 0
    while True:
        label = found.groupBy("node").agg(F.min("label").alias("label"))
        open_, seen = materialise_with(_open_buckets(buckets, label), "open", n=F.count(F.lit(1)))
        release(last)
        if not seen["n"]:
            release(open_, *compared)
            return connected_components(found, "node", "label")
        able = materialise(_able(open_, units, threshold), "able")
        release(open_)
        member, sure, marked = _referred(able, units, threshold, turn)
        member = materialise(member, "member")
        release(able)
        pivot = None
        if turn < MAIN_TURNS:
            pairs = _main_tries(member, threshold, turn)
        else:
            pivot = materialise(_outside_pivots(member, turn - MAIN_TURNS), "pivots")
            pairs = _met(member, pivot, threshold)
        known = compared[0]
        for more in compared[1:]:
            known = known.union(more)
        known = known.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        pairs = materialise(pairs.join(known, ["a", "b"], "left_anti"), "pairs")
        compared.append(pairs)
        old = found.select(F.col("node").alias("a"), F.col("label").alias("b"))
        new = _similar(pairs, units, threshold)
        before, found = found, shortened(old.union(new if sure is None else new.union(sure)))
        release(before, *marked)
        rest = member if pivot is None else member.join(pivot.select("node"), "node", "left_anti")
        last, buckets = member, rest.select("node", "weight", "band")
        turn += 1


def _able(member: DataFrame, units: DataFrame, threshold: float) -> DataFrame:
    """The open members that can still have a link to another group, with ``shared``.

    ``shared`` counts the units of a node that occur in some other open group as well.
    A link to another group has no other units in common, so a node with fewer than
    ``threshold`` of its units shared has no such link, whatever its bucket holds.
    """
    own = member.select("node", "label").distinct()
    each = units.join(own, "node").select("node", "label", F.explode("units").alias("unit"))
    across = each.groupBy("unit").agg(F.min("label").alias("low"), F.max("label").alias("high"))
    across = across.filter("low <> high").select("unit")
    shared = each.join(across, "unit", "left_semi").groupBy("node").agg(F.count(F.lit(1)).alias("shared"))
    found = member.join(shared, "node")
    return found.filter(F.col("shared") >= threshold * F.col("weight") - 1e-9)


def _linked(both: Column, a: Column, b: Column, threshold: float) -> Column:
    """Whether sets of these sizes with ``both`` units in common are a link."""
    return both >= threshold * (a + b - both) - 1e-9


def _referred(
    member: DataFrame, units: DataFrame, threshold: float, turn: int
) -> tuple[DataFrame, DataFrame | None, list[DataFrame]]:
    """(member with ``room`` and ``reach``, links (a, b), tables to release).

    All of a bucket of more than ``CROWD`` members meet one of them, its reference: one of
    the main group, in later rounds one outside, that is in most such buckets, the cleanest
    of equal ones.  Links to it are exact, and the groups it links are one from then on.  What sets a node off from its
    reference, units that only one of them has, decides about all other pairs: with x' and
    y' these units of x and y, x and y differ in |x'| + |y'| - 2 |x' and y'| units, and a
    link allows c (|x| + |y|), c = (1 - threshold) / (1 + threshold).  x' and y' have at most
    those units in common that x lacks, and those it adds that another group adds as well:
    only the latter are listed and counted.  So with ``room`` = c |x| - |x'| and ``reach`` =
    room + 2 (lacking units + added ones that another group of the same reference adds), a
    link needs room(x) + reach(y) >= 0 and the reverse.  Members of a crowded bucket that no
    other group can meet so are dropped, and the reference, too.
    """
    unbound = [F.col("weight").cast("double").alias(c) for c in ("room", "reach")]
    late = F.col("label") != F.col("main") if turn == 0 else F.col("label") == F.col("main")
    crowded = member.groupBy("band").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > CROWD)
    crowded = member.join(crowded.select("band"), "band")
    # the members of most crowded buckets first: few references serve them all
    wide = crowded.groupBy("node").agg((-F.count(F.lit(1))).alias("wide"))
    first = F.min(F.struct(late.alias("late"), "wide", _order(0).alias("of"))).alias("first")
    refs = crowded.join(wide, "node").groupBy("band").agg(first)
    refs, seen = materialise_with(refs.select("band", F.col("first.of.node").alias("ref")), "refs", n=F.count(F.lit(1)))
    if not seen["n"]:
        return member.select("*", *unbound), None, [refs]
    crowd = member.join(refs, "band")
    # small next to the sets: written first, so that few of them do not make all sets move
    near = materialise(crowd.select("ref", "node", "label", "weight").distinct(), "near")
    # a reference's set is copied, so that its nodes are dealt to tasks; CROWD copies are
    # fewer than its nodes
    base = (
        near.filter("node = ref").select("ref", F.col("label").alias("to"))
        .join(units.withColumnsRenamed({"node": "ref", "units": "base"}), "ref")
        .withColumn("spot", F.explode(F.sequence(F.lit(0), F.lit(CROWD - 1))))
    )
    marked = near.join(units, "node").withColumn("spot", F.pmod(F.xxhash64("node"), F.lit(CROWD)).cast("int"))
    marked = marked.join(base, ["ref", "spot"]).withColumn("added", F.array_except("units", "base"))
    both = F.col("weight") - F.size("added")
    marked = materialise(
        marked.withColumn("link", _linked(both, F.col("weight"), F.size("base"), threshold))
        .select("ref", "node", "label", "to", "weight", "added", (F.size("base") - both).alias("lacking"), "link"),
        "marked",
    )
    sure = marked.filter("link AND node <> ref").select(F.col("node").alias("a"), F.col("ref").alias("b"))
    joined = marked.filter("link").select("ref", F.col("label").alias("old"), F.col("to").alias("new")).distinct()

    def grouped(rows: DataFrame, label: str) -> DataFrame:
        own = joined.withColumnRenamed("old", label)
        return rows.join(own, ["ref", label], "left").withColumn(label, F.coalesce("new", label)).drop("new")

    each = grouped(marked.select("ref", "node", "label", "added"), "label")
    each = each.select("ref", "node", "label", F.explode("added").alias("unit"))
    across = each.groupBy("ref", "unit").agg(F.min("label").alias("low"), F.max("label").alias("high"))
    across = across.filter("low <> high").select("ref", "unit")
    common = each.join(across, ["ref", "unit"], "left_semi").groupBy("ref", "node").agg(F.count(F.lit(1)).alias("common"))
    room = (1 - threshold) / (1 + threshold) * F.col("weight") - F.size("added") - F.col("lacking")
    bounds = marked.filter("node <> ref").select("ref", "node", "lacking", room.alias("room"))
    bounds = bounds.join(common, ["ref", "node"], "left")
    bounds = bounds.withColumn("reach", F.col("room") + 2 * (F.col("lacking") + F.coalesce("common", F.lit(0))))
    bounds = bounds.drop("common", "lacking")
    rows = materialise(grouped(grouped(crowd, "label"), "main").join(bounds, ["ref", "node"]), "crowd")
    most = [F.max("room").alias("_room"), F.max("reach").alias("_reach")]
    can = (F.col("room") + F.col("_reach") >= -1e-9) & (F.col("reach") + F.col("_room") >= -1e-9)
    outside = rows.filter("label <> main").join(rows.groupBy("band").agg(*most), "band").filter(can)
    mains = rows.filter("label = main").join(outside.groupBy("band").agg(*most), "band").filter(can)
    rest = member.join(refs, "band", "left_anti").select("*", *unbound)
    for part in (outside, mains):
        rest = rest.union(part.select(rest.columns))
    return rest, sure, [refs, near, marked, rows]


def _reachable(a: Column, b: Column, threshold: float) -> Column:
    """Whether nodes of these sizes can reach the threshold at all."""
    both = F.least(a["shared"], b["shared"])
    near = (a["room"] + b["reach"] >= -1e-9) & (a["reach"] + b["room"] >= -1e-9)
    return near & _linked(both, a["weight"], b["weight"], threshold)


def _order(seed: int, *more: str) -> Column:
    """Cleaner nodes first, those with fewer units of their own; ties by hash."""
    own = F.col("weight") - F.col("shared")
    return F.struct(own.alias("own"), F.xxhash64("node", F.lit(seed)).alias("draw"), "node", *more)


def _main_tries(member: DataFrame, threshold: float, turn: int) -> DataFrame:
    """For each node outside a main group a few members of the main groups it meets.

    One is the cleanest, the others are drawn: a fixed number of pairs per node.
    """
    names = [f"p{i}" for i in range(TRIES)]
    draws = [
        F.struct(F.xxhash64("node", F.lit(turn * TRIES + i)).alias("draw"), "node", *SIZE)
        for i in range(1, TRIES)
    ]
    mains = member.filter("label = main").groupBy("band").agg(
        *[F.min(c).alias(p) for p, c in zip(names, [_order(turn, *SIZE), *draws])]
    )
    size = F.struct(*SIZE)
    near = [F.when(_reachable(size, F.col(p), threshold), F.col(p)) for p in names]
    tries = (
        member.filter("label <> main")
        .join(mains, "band")
        .groupBy(F.col("node").alias("own"))
        .agg(*[F.min(c).alias(p) for c, p in zip(near, names)])
        .select("own", F.explode(F.array(*[F.col(f"{p}.node") for p in names])).alias("b"))
        .filter("b IS NOT NULL")
    )
    return tries.select(F.least("own", "b").alias("a"), F.greatest("own", "b").alias("b")).distinct()


def _outside_pivots(member: DataFrame, turn: int) -> DataFrame:
    """(node) of the nodes outside a main group that meet all their buckets next.

    The first time they are the cleanest of each bucket.  Then they are all that are left,
    if these meet few members each on average, else the cleanest and a growing share of
    the others, by hash.
    """
    outside = member.filter("label <> main")
    best = outside.groupBy("band").agg(F.min(_order(turn)).alias("best")).select("best.node")
    if not turn:
        return best.distinct()
    sizes = member.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") != F.col("main")).alias("o"))
    seen = sizes.agg(F.sum("n").alias("rows"), F.sum(F.col("n") * F.col("o")).alias("met")).first()
    if seen["met"] is None or seen["met"] <= MET * seen["rows"]:
        return outside.select("node").distinct()
    share = min(4.0**turn / 256, 1.0)
    drawn = outside.filter(F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(1 << 20)) < share * (1 << 20))
    return best.union(drawn.select("node")).distinct()


def _met(member: DataFrame, pivot: DataFrame, threshold: float) -> DataFrame:
    """(a, b), a < b: pivots and the members of other groups in their buckets.

    A pair that meets in several buckets is listed in the first of them only.
    """
    own = member.join(pivot, "node").select(
        "band", F.col("node").alias("b"), F.col("label").alias("b_label"), F.struct(*SIZE).alias("b_size")
    )
    bands = member.groupBy("node").agg(F.collect_list("band").alias("bands"))  # at most all bands of a text
    rows = member.join(bands, "node").select("band", "node", "label", F.struct(*SIZE).alias("size"), "bands")
    own = own.join(bands.withColumnsRenamed({"node": "b", "bands": "b_bands"}), "b")
    return (
        rows.join(own, "band")
        .filter(F.col("label") != F.col("b_label"))
        .filter(_reachable(F.col("size"), F.col("b_size"), threshold))
        .filter(F.col("band") == F.array_min(F.array_intersect("bands", "b_bands")))
        .select(F.least("node", "b").alias("a"), F.greatest("node", "b").alias("b"))
        .distinct()
    )


def classes(
    docs: DataFrame,
    threshold: float = SIMILARITY,
    bands: int = BANDS,
    rows: int = ROWS,
    text: str = "text",
) -> DataFrame:
    """(doc_id, text_key, class_id, kept_key) for each row of ``docs``.

    ``class_id`` is the smallest doc_id of all texts that links of ``threshold`` or
    more connect; ``kept_key`` is the text digest of the one kept (the smallest
    digest among the texts of that doc_id, should it be repeated).  Texts with the
    same words are one class; a text without words is a class of its own row.  A null
    doc_id counts as larger than all others.  Other columns are not read.
    """
    free_finished_shuffles(docs.sparkSession)
    rows_ = materialise(signed(docs, bands, rows, text), "signed")
    texts = (
        rows_.filter("words_key IS NOT NULL")
        .groupBy("words_key")
        .agg(
            F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("first"),
            F.first("weight").alias("weight"),
            F.first("bands").alias("bands"),
        )
        .withColumn("node", F.monotonically_increasing_id())
    )
    nodes = materialise(texts, "texts")
    buckets = materialise(shared_buckets(nodes), "buckets")
    wanted = materialise(
        nodes.join(buckets.select("node").distinct(), "node", "left_semi")
        .select("node", "words_key", F.col("first.text_key").alias("text_key")),
        "wanted",
    )
    # rows of one text come in any number: one of them, folded on the map side, is enough
    source = _keyed(docs, text).groupBy("text_key").agg(F.first("_text").alias("_text"))
    # merge joins at every size: texts and sets are moved once each, whatever the input;
    # keys do not repeat, so an inner join keeps rows as they are, and folding stays first
    source = source.join(wanted.select("text_key").hint("merge"), "text_key")
    units = shingled(source)
    units = materialise(units.join(wanted.select("words_key", "node"), "words_key").select("node", "units"), "units")
    release(wanted)
    label = links(buckets, units, threshold)
    release(units)
    labelled = nodes.join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    best = labelled.groupBy("label").agg(F.min("first").alias("kept"))
    of_words = labelled.join(best, "label").select("words_key", "kept")
    return rows_.join(of_words, "words_key", "left").select(
        "doc_id",
        "text_key",
        F.when(F.col("kept").isNull(), F.col("doc_id")).otherwise(F.col("kept.doc_id")).alias("class_id"),
        F.coalesce("kept.text_key", "text_key").alias("kept_key"),
    )


def one_per_class(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that stay: one for each class, all columns unchanged."""
    text = options.get("text", "text")
    found = classes(docs, **options)
    kept = (
        found.filter(F.col("class_id").eqNullSafe(F.col("doc_id")) & (F.col("kept_key") == F.col("text_key")))
        .select(F.col("doc_id").alias("id"), F.col("text_key").alias("key"))
        .distinct()
    )
    # rows as one column, so that no column of theirs can clash with the helpers
    rows = docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("row"),
        docs["doc_id"].alias("id"),
        F.sha2(F.coalesce(docs[text], F.lit("")), 256).alias("key"),
    )
    same = rows["id"].eqNullSafe(kept["id"]) & (rows["key"] == kept["key"])
    return rows.join(kept, same, "left_semi").dropDuplicates(["id", "key"]).select("row.*")
