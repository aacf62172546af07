"""Benchmark decontamination by winnowing, in DataFrame functions only.

An item's windows are its runs of 13 words (an item of fewer words is one window).
Both sides are cut into k-grams of words, and the smallest k-gram hash of each run of
w consecutive k-grams is a fingerprint.  With k + w - 1 = 13 every shared window has
a shared fingerprint at the same place.  A document's fingerprints are joined with
the items', each hit is extended by at most 13 - k words to both sides, and if the
equal run reaches a whole window its words are hit: words are compared as such, so
hash collisions cost time only.  Items of fewer than 13 words have no full run of
k-grams; their smallest k-gram (or, below k words, all their words as one gram) is
looked up among all grams of the documents.

One pass over the documents makes words and grams.  A bitmap of the items' hashes (a
fixed number of bits, whatever the benchmark's size) lets a document skip the grams
that no item can have, before the winnowing test and the explode; what is left
carries its surrounding words along, so texts are never joined.  Items that share a
fingerprint and its surroundings are one row in the join, and pairs of document and
item are listed from distinct hits only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gripelens.llm.columns import let, plain_words
from gripelens.session import materialise

WINDOW = 13
GRAM = 5
SHARE = 20
BITMAP_WORDS = 4096  # of 64 bits


def _grams(hashes: Column, size: int) -> Column:
    """Hash of each run of ``size`` words, by position."""
    if size == 1:
        return hashes
    count = F.size(hashes) - F.lit(size - 1)
    at = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(size)]))


def _is_fingerprint(grams: Column, i: Column, run: int) -> Column:
    """Whether gram i is the smallest of some run of ``run`` consecutive grams."""
    first = F.greatest(i - F.lit(run - 1), F.lit(0))
    last = F.least(i, F.size(grams) - F.lit(run))
    starts = F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
    return F.exists(starts, lambda j: F.array_min(F.slice(grams, j + 1, run)) == F.get(grams, i))


def _slot(gram: Column) -> Column:
    return gram.bitwiseAND(F.lit(BITMAP_WORDS - 1)).cast("int")


def _bit(gram: Column) -> Column:
    return F.shiftrightunsigned(gram, 12).bitwiseAND(F.lit(63)).cast("int")


def _around(words: Column, i: Column, size: int) -> dict[str, Column]:
    """The gram's words and up to 13 - size words on both sides, nearest first."""
    reach = WINDOW - size
    from_ = F.greatest(i - F.lit(reach), F.lit(0))
    return {
        "before": F.reverse(F.slice(words, from_ + 1, i - from_)),
        "gram": F.slice(words, i + 1, size),
        "after": F.slice(words, i + size + 1, reach),
    }


def _item_hits(hashes: Column, k: int) -> Column:
    """(hash, at) of an item's fingerprints; needs its number of words as ``n``."""

    def found(grams: Column) -> Column:
        every = F.sequence(F.lit(0), F.size(grams) - 1)
        windowed = F.filter(every, lambda i: _is_fingerprint(grams, i, WINDOW - k + 1))
        least = F.array(F.array_position(grams, F.array_min(grams)).cast("int") - 1)
        chosen = F.when(F.col("n") >= WINDOW, windowed).otherwise(least)
        return F.transform(chosen, lambda i: F.struct(F.get(grams, i).alias("hash"), i.alias("at")))

    return let(hashes, lambda h: let(_grams(h, k), found))


def item_fingerprints(items: DataFrame, text: str = "text") -> DataFrame:
    """(item_id, size, need, hash, before, gram, after): where windows can be met.

    ``need`` is the length of the item's windows.
    """
    words = items.select(items["item_id"], plain_words(items[text]).alias("words"))
    words = words.withColumn("n", F.size("words")).filter("n > 0")
    size = F.least(F.col("n"), F.lit(GRAM))
    out = None
    for k in range(1, GRAM + 1):
        at_k = words.filter(size == k)
        hashes = F.transform("words", lambda w: F.xxhash64(w))
        rows = at_k.select("item_id", "n", "words", F.explode(_item_hits(hashes, k)).alias("f")).select(
            "item_id",
            F.lit(k).alias("size"),
            F.least("n", F.lit(WINDOW)).alias("need"),
            "f.hash",
            *[c.alias(name) for name, c in _around(F.col("words"), F.col("f.at"), k).items()],
        )
        out = rows if out is None else out.union(rows)
    return out


def _bitmap(hashes: DataFrame) -> Column:
    """Bits of all hashes as a literal array; a fixed number of 64-bit words."""
    one = F.lit(1).cast("long")
    bits = hashes.groupBy(_slot(F.col("hash")).alias("slot")).agg(
        F.bit_or(F.call_function("shiftleft", one, _bit(F.col("hash")))).alias("bits")
    )
    words = ["0"] * BITMAP_WORDS
    for row in bits.collect():
        words[row["slot"]] = str(row["bits"])
    return F.split(F.lit(",".join(words)), ",").cast("array<bigint>")


def _equal_run(a: Column, b: Column) -> Column:
    """Number of equal leading elements."""
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.eqNullSafe(y) & x.isNotNull()),
        F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")),
        lambda s, same: F.struct(
            (s["n"] + F.when(s["on"] & same, 1).otherwise(0)).alias("n"), (s["on"] & same).alias("on")
        ),
        lambda s: s["n"],
    )


def contaminated(
    docs: DataFrame, items: DataFrame, share: int = SHARE, text: str = "text"
) -> DataFrame:
    """(doc_id, text_key, n_words, n_hit, n_items, item_ids, contaminated) for each row.

    ``n_hit`` counts the words inside an occurrence of a window, ``item_ids`` are the
    items with such windows (as strings, sorted), and a document is contaminated if at
    least one in ``share`` of its words is hit.  A null text has no words; items
    without words match nothing; repeated rows are judged each, repeated items of one
    id count once.  A null item id counts as an item without a name: its words are
    hits, but it is in no list.  Other columns are not read.
    """
    marks = materialise(
        item_fingerprints(items, text)
        .groupBy("size", "need", "hash", "before", "gram", "after")
        .agg(F.lit(1).alias("one"))
        .drop("one")
        .withColumn("mark", F.monotonically_increasing_id()),
        "fingerprints",
    )
    kinds = {(r["size"], r["need"]) for r in marks.select("size", "need").distinct().collect()}
    sizes = sorted({k for k, _ in kinds})
    every = {k for k, need in kinds if need < WINDOW}  # sizes of which all grams are looked up
    source = docs.select(
        docs["doc_id"],
        F.monotonically_increasing_id().alias("row"),
        F.sha2(F.coalesce(docs[text], F.lit("")), 256).alias("text_key"),
        plain_words(docs[text]).alias("words"),
    )

    def hits(words: Column, hashes: Column, k: int) -> Column:
        bits = _bitmap(marks.filter(F.col("size") == k))

        def chosen(grams: Column) -> Column:
            def known(g: Column) -> Column:
                return F.getbit(F.get(bits, _slot(g)), _bit(g)) == 1

            at = F.when(F.size(grams) > 0, F.sequence(F.lit(0), F.size(grams) - 1))
            at = F.filter(F.coalesce(at, F.array().cast("array<int>")), lambda i: known(F.get(grams, i)))
            if k not in every:
                at = F.filter(at, lambda i: _is_fingerprint(grams, i, WINDOW - k + 1))
            return F.transform(
                at,
                lambda i: F.struct(
                    F.lit(k).alias("size"),
                    F.get(grams, i).alias("hash"),
                    i.alias("at"),
                    *[c.alias(name) for name, c in _around(words, i, k).items()],
                ),
            )

        return let(_grams(hashes, k), chosen)

    if sizes:

        def all_hits(words: Column) -> Column:
            return let(
                F.transform(words, lambda w: F.xxhash64(w)),
                lambda h: F.concat(*[hits(words, h, k) for k in sizes]),
            )

        found = let(F.col("words"), lambda w: F.struct(F.size(w).cast("long").alias("n"), all_hits(w).alias("hits")))
    else:
        found = F.struct(F.size("words").cast("long").alias("n"), F.array().alias("hits"))
    rows = materialise(
        source.select("doc_id", "row", "text_key", found.alias("found")).select(
            "doc_id", "row", "text_key", F.col("found.n").alias("n_words"), F.col("found.hits").alias("hits")
        ),
        "rows",
    )
    if not sizes:
        empty = F.array().cast("array<string>")
        zero = F.lit(0).cast("long")
        return rows.select(
            "doc_id", "text_key", "n_words", zero.alias("n_hit"), zero.alias("n_items"),
            empty.alias("item_ids"), F.lit(False).alias("contaminated"),
        )
    seed = rows.select("row", F.explode("hits").alias("d")).select("row", "d.*")
    mark = marks.select(
        "size", "hash", "need", "mark", *[F.col(c).alias(f"i_{c}") for c in ("before", "gram", "after")]
    )
    met = (
        seed.join(mark, ["size", "hash"])
        .filter(F.col("gram") == F.col("i_gram"))
        .withColumn("left", _equal_run(F.col("before"), F.col("i_before")))
        .withColumn("right", _equal_run(F.col("after"), F.col("i_after")))
        .filter(F.col("left") + F.col("right") + F.col("size") >= F.col("need"))
        .select(
            "row",
            (F.col("at") - F.col("left")).alias("low"),
            (F.col("at") + F.col("size") + F.col("right")).alias("high"),
            "at",
            "mark",
        )
    )
    met = materialise(met, "hits")
    # the words hit: overlapping runs of a document are joined in order of their start
    runs = met.groupBy("row", "at").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    runs = runs.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("low", "high"))).alias("runs"))
    covered = F.aggregate(
        "runs",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda s, r: F.struct(
            (s["n"] + F.greatest(r["high"] - F.greatest(r["low"], s["end"]), F.lit(0))).alias("n"),
            F.greatest(s["end"], r["high"]).alias("end"),
        ),
        lambda s: s["n"].cast("long"),
    )
    runs = runs.select("row", covered.alias("n_hit"))
    owners = (
        item_fingerprints(items, text)
        .join(marks, ["size", "need", "hash", "before", "gram", "after"])
        .filter("item_id IS NOT NULL")
        .select("mark", F.col("item_id").cast("string").alias("item_id"))
        .distinct()
    )
    named = (
        met.select("row", "mark").distinct().join(owners, "mark").groupBy("row")
        .agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"))
    )
    out = rows.drop("hits").join(runs, "row", "left").join(named, "row", "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    item_ids = F.coalesce("item_ids", F.array().cast("array<string>"))
    return out.select(
        "doc_id",
        "text_key",
        "n_words",
        n_hit.alias("n_hit"),
        F.size(item_ids).cast("long").alias("n_items"),
        item_ids.alias("item_ids"),
        ((n_hit > 0) & (n_hit * share >= F.col("n_words"))).alias("contaminated"),
    )


def clean_rows(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, all columns unchanged."""
    text = options.get("text", "text")
    bad = contaminated(docs, items, **options).filter("contaminated").select(F.col("text_key").alias("key")).distinct()
    # rows as one column, so that no column of theirs can clash with the key
    rows = docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.sha2(F.coalesce(docs[text], F.lit("")), 256).alias("key")
    )
    return rows.join(bad, "key", "left_anti").select("row.*")
