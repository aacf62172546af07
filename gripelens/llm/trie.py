"""Prefix trie of conversations, rolled up in bands of depths.

A node is a distinct sequence of the first d turns (role, text).  Its key combines
120-bit digests of (place, role, text) by exclusive or, so keys of all prefixes are
running sums: they are taken within blocks of turns and over blocks, and the key of
a parent follows from its child's.

Subtree totals by depth bands: a node adds its values only to its ancestors inside
its own band of ``height`` depths, itself included.  The topmost nodes of all bands,
the band roots, form a trie of their own that is ``height`` times flatter; its totals
come from the same step, applied to it.  Each completed band-root total then goes to
the ancestors in the band above.  A row is copied at most ``height`` times in either
direction, and there are log(depth) / log(height) levels, however deep the trie is.

Nothing of unbounded size meets in one task: turns are numbered by range, a
conversation's turns are joined in blocks of 1024, the children of a node reach it
through 1024 salted shares, and the ids of a node's members are packed to text in
range order before they meet in one running digest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gripelens.llm.scratch import free_finished_shuffles
from gripelens.session import materialise, materialise_with

HEIGHT = 8
BLOCK_BITS = 10
SHARES = 1024
PACKED_BYTES = 16 << 10
ROOT = "0.0"


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, role, text): the turns of each conversation, placed from 0.

    Order is by turn, a null turn first, then by role and text; a null role or text is
    empty.  Repeated rows are turns of their own.  Rows without a conv_id belong to no
    conversation and are left out.  Other columns are not read.
    """
    c = conversations
    empty = F.lit("")
    rows = c.filter(c["conv_id"].isNotNull()).select(
        c["conv_id"].cast("long").alias("conv_id"),
        c["turn"].alias("turn"),
        F.coalesce(c["role"], empty).alias("role"),
        F.coalesce(c["text"], empty).alias("text"),
    )
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    low = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ranged = materialise(
        rows.repartitionByRange(*order).sortWithinPartitions(*order)
        .select("conv_id", "role", "text", F.spark_partition_id().alias("part"), low.alias("at")),
        "turns",
    )
    runs = ranged.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("conv_id", "part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    placed = ranged.join(runs, ["conv_id", "part"])
    return placed.select("conv_id", (F.col("at") + F.col("shift")).alias("place"), "role", "text")


def lengths_of(turns: DataFrame) -> DataFrame:
    """(conv_id, length) of placed turns."""
    return turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("length"))


def grafted(turns: DataFrame, group: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """Conversations that share openings: (turns, lengths).

    The first h turns of conversation c are replaced by those of c - c % ``group`` (all
    it has if fewer, none if it is absent); h is the crc32 of c as text, modulo ``most``.
    ``%`` keeps the sign of c.  A conversation may end up without turns.
    """
    turns = materialise(turns, "placed")
    sizes = lengths_of(turns)
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).alias("h")
    first = (F.col("conv_id") - F.col("conv_id") % group).alias("giver")
    giver = sizes.select(F.col("conv_id").alias("giver"), F.col("length").alias("has"))
    facts = sizes.select("conv_id", "length", h, first).join(giver, "giver", "left")
    facts = materialise(
        facts.select("conv_id", "giver", "h", "length", F.least("h", F.coalesce("has", F.lit(0))).alias("taken")),
        "grafts",
    )
    heads = turns.filter(F.col("place") < most - 1).withColumnRenamed("conv_id", "giver")
    lent = (
        heads.join(facts.select("conv_id", "giver", "taken"), "giver")
        .filter("place < taken")
        .select("conv_id", "place", "role", "text")
    )
    blocks = F.sequence(F.lit(0).cast("long"), F.shiftright(F.col("length") - 1, BLOCK_BITS))
    by_block = facts.select("conv_id", "h", "taken", F.explode(blocks).alias("block"))
    own = (
        turns.withColumn("block", F.shiftright("place", BLOCK_BITS))
        .join(by_block, ["conv_id", "block"])
        .filter("place >= h")
        .select("conv_id", (F.col("place") - F.col("h") + F.col("taken")).alias("place"), "role", "text")
    )
    kept = F.col("taken") + F.greatest(F.col("length") - F.col("h"), F.lit(0))
    return lent.union(own), facts.select("conv_id", kept.alias("length"))


def _halves(text: Column) -> list[Column]:
    """The first 120 bits of a digest as two numbers."""
    return [F.conv(F.substring(text, at, 15), 16, 10).cast("long") for at in (1, 16)]


def prefixes(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """(conv_id, depth, key, parent_key, n_bytes): every conversation at every depth.

    ``n_bytes`` is the UTF-8 size of the last turn's text.  Depth 0 is the root.
    """
    size = F.octet_length
    own = F.concat_ws(":", "place", size("role"), "role", "text")
    p, q = _halves(F.md5(own))
    rows = turns.select(
        "conv_id", "place", F.shiftright("place", BLOCK_BITS).alias("block"),
        p.alias("p"), q.alias("q"), size("text").cast("long").alias("n_bytes"),
    )
    rows = materialise(rows, "digests")
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("conv_id", "block").agg(F.bit_xor("p").alias("p"), F.bit_xor("q").alias("q"))
    zero = F.lit(0).cast("long")
    sums = sums.select(
        "conv_id", "block", *[F.coalesce(F.bit_xor(c).over(before), zero).alias(f"{c}0") for c in "pq"]
    )
    upto = Window.partitionBy("conv_id", "block").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    keys = {c: F.col(f"{c}0").bitwiseXOR(F.bit_xor(c).over(upto)) for c in "pq"}
    rows = rows.join(sums, ["conv_id", "block"])
    rows = rows.select("conv_id", "place", "n_bytes", "p", "q", *[k.alias(f"{c}1") for c, k in keys.items()])

    def named(a: Column, b: Column) -> Column:
        return F.concat(F.hex(a), F.lit("."), F.hex(b))

    below = rows.select(
        "conv_id",
        (F.col("place") + 1).alias("depth"),
        named(F.col("p1"), F.col("q1")).alias("key"),
        named(F.col("p1").bitwiseXOR(F.col("p")), F.col("q1").bitwiseXOR(F.col("q"))).alias("parent_key"),
        "n_bytes",
    )
    top = lengths.select("conv_id", zero.alias("depth"), F.lit(ROOT).alias("key"), F.lit(None).cast("string"), zero)
    return below.union(top)


def _chains(paths: DataFrame, owners: DataFrame, height: int) -> DataFrame:
    """(key, depth, up, back): each node's ancestors in its band, itself included, and,
    for a band root, all its ancestors in the band above."""
    banded = paths.withColumn("band", F.expr(f"depth div {height}"))
    bands = banded.groupBy("conv_id", "band").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("depth", "key"))), lambda n: n["key"]).alias("keys")
    )
    bands = materialise(bands, "bands")
    above = bands.select("conv_id", (F.col("band") + 1).alias("band"), F.col("keys").alias("back"))
    rows = bands.join(above, ["conv_id", "band"], "left").select(
        "conv_id", "band", "keys", "back", F.posexplode("keys").alias("at", "key")
    )
    rows = rows.select(
        "conv_id",
        "key",
        (F.col("band") * height + F.col("at")).alias("depth"),
        F.slice("keys", F.lit(1), F.col("at") + 1).alias("up"),
        F.when(F.col("at") == 0, F.col("back")).alias("back"),
    )
    return rows.join(owners, ["key", "conv_id"]).drop("conv_id")


def _summed(rows: DataFrame, values: list[str]) -> DataFrame:
    return rows.groupBy("key").agg(*[F.sum(v).alias(v) for v in values])


def subtree_totals(
    paths: DataFrame, owners: DataFrame, values: DataFrame, deepest: int, height: int = HEIGHT
) -> DataFrame:
    """(key, values...) summed over the subtree of each node, the node included.

    ``paths`` (conv_id, depth, key) holds all nodes on the way to each node of
    ``owners`` (key, conv_id); ``values`` has one row per key.
    """
    names = [c for c in values.columns if c != "key"]
    chains = materialise(_chains(paths, owners, height), "chains")
    up = chains.select("key", "up").join(values, "key").select(F.explode("up").alias("key"), *names)
    sums = materialise(_summed(up, names), "sums")
    if deepest < height:
        return sums
    roots = chains.filter(F.col("depth") % height == 0).select("key")
    flat = paths.filter(F.col("depth") % height == 0)
    flat = flat.select("conv_id", F.expr(f"depth div {height}").alias("depth"), "key")
    whole = subtree_totals(flat, owners, sums.join(roots, "key"), deepest // height, height)
    passed = chains.filter("back IS NOT NULL").select("key", "back").join(whole, "key")
    passed = passed.select(F.explode("back").alias("key"), *names)
    return _summed(sums.union(passed), names)


def prefix_trie(
    turns: DataFrame, lengths: DataFrame | None = None, height: int = HEIGHT
) -> tuple[DataFrame, DataFrame]:
    """(nodes, ends) of placed turns (conv_id, place, role, text), places from 0.

    ``nodes``: key, conv_id (the smallest member), depth, parent_key, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens; (conv_id, depth) names the turn that a
    node stands for.  ``ends``: (key, conv_id), the node at which each conversation
    ends.  ``lengths`` (conv_id, length) adds conversations without turns; they end at
    the root.  Without conversations there are no nodes, not even the root.
    ``saved_tokens`` sums, over the subtree, the bytes of each node's last text times its
    other members.
    """
    free_finished_shuffles(turns.sparkSession)
    lengths = materialise(lengths_of(turns) if lengths is None else lengths, "lengths")
    paths, seen = materialise_with(prefixes(turns, lengths), "paths", deepest=F.max("depth"))
    nodes = materialise(
        paths.groupBy("key").agg(
            F.min("conv_id").alias("conv_id"),
            F.count(F.lit(1)).alias("n_convs"),
            F.min("depth").alias("depth"),
            F.min("parent_key").alias("parent_key"),
            F.max("n_bytes").alias("n_bytes"),
        ),
        "nodes",
    )
    # copies of a smaller conversation own no node; their turns are needed no more
    owners = nodes.select("key", "conv_id")
    owned = materialise(
        paths.join(owners.select("conv_id").distinct(), "conv_id", "left_semi").select("conv_id", "depth", "key"),
        "owned",
    )
    share = F.pmod(F.xxhash64("key"), F.lit(SHARES)).alias("share")
    inner = nodes.filter("depth > 0").select("key", "parent_key", share)
    fans = materialise(inner.groupBy("parent_key", "share").agg(F.count(F.lit(1)).alias("n")), "fans")
    counts = fans.groupBy(F.col("parent_key").alias("key")).agg(F.sum("n").alias("n_children"))
    known = materialise(
        nodes.join(counts, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))),
        "counted",
    )
    values = known.select(
        "key",
        (F.col("n_children") == 0).cast("long").alias("n_leaves"),
        ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("saved_tokens"),
    )
    totals = subtree_totals(owned, owners, values, seen["deepest"] or 0, height)
    parent = nodes.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    told = fans.join(parent, "parent_key").select("parent_key", "share", "parent_conv_id")
    found = known.drop("n_bytes").withColumn("share", share).join(told, ["parent_key", "share"], "left")
    ends = lengths.join(paths.select("conv_id", F.col("depth").alias("length"), "key"), ["conv_id", "length"])
    return found.drop("share").join(totals, "key"), ends.select("key", "conv_id")


def member_digests(ends: DataFrame) -> DataFrame:
    """(key, ends_sha256): SHA-256 of each key's conv_ids, ascending, joined by commas.

    Ids are sorted by range, packed to texts of bounded size in each range, and only
    those texts meet, in order, in a running digest: a key of any size needs little
    memory and few rows.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, ids, size = None, 0, [], 0
        for batch in batches:
            done = []
            for k, i in zip(batch.column("key").to_pylist(), batch.column("conv_id").to_pylist()):
                if k != key or size >= PACKED_BYTES:
                    if ids:
                        done.append((key, first, ",".join(ids)))
                    key, first, ids, size = k, i, [], 0
                ids.append(str(i))
                size += len(ids[-1]) + 1
            yield _packed(done)
        if ids:
            yield _packed([(key, first, ",".join(ids))])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            done = []
            for k, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist()):
                if k == key:
                    state.update(b",")
                else:
                    if state:
                        done.append((key, state.hexdigest()))
                    key, state = k, hashlib.sha256()
                state.update(ids.encode())
            yield _digests(done)
        if state:
            yield _digests([(key, state.hexdigest())])

    sorted_ = ends.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    packed = sorted_.mapInArrow(pack, "key string, first long, ids string")
    met = packed.repartition("key").sortWithinPartitions("key", "first")
    return met.mapInArrow(digest, "key string, ends_sha256 string")


def _packed(rows: list[tuple[str, int, str]]) -> pa.RecordBatch:
    keys, first, ids = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays(
        [pa.array(keys, pa.string()), pa.array(first, pa.int64()), pa.array(ids, pa.string())], names=["key", "first", "ids"]
    )


def _digests(rows: list[tuple[str, str]]) -> pa.RecordBatch:
    keys, found = zip(*rows) if rows else ((), ())
    return pa.RecordBatch.from_arrays(
        [pa.array(keys, pa.string()), pa.array(found, pa.string())], names=["key", "ends_sha256"]
    )
