"""Quality rules: rule statistics of whole texts, judged by an isolation forest.

Statistics of a text (lengths, symbols, repeated lines and words, shares of character
classes) are points; a tree splits points at random features and values until they
are alone.  Unusual texts are alone after few splits, so a short mean path over all
trees marks an anomaly.  As the method has it, each tree is grown from a small draw of its own;
it is drawn from all labelled rows, mostly good ones, so that junk of any kind is rare in
it.  The threshold on the anomaly score is calibrated on all labelled rows: it rejects as
much junk as possible while at most ``max_loss`` of the good rows go.

The driver holds the trees and one candidate for the threshold, not the rows.  All texts
are measured and judged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gripelens.llm.words import raw_bytes, sliced, space_words, sums, text_array
from gripelens.session import materialise, materialise_with, release

TREES = 128
TREE_ROWS = 256
JUNK_SHARE = 0.06
MAX_LOSS = 0.01
MIN_WORDS = 50

_BYTES = np.arange(256)
_IS = {
    "n_symbols": np.isin(_BYTES, list(b"#*$%&|<>")),
    "upper": (_BYTES >= 0x41) & (_BYTES <= 0x5A),
    "digit": (_BYTES >= 0x30) & (_BYTES <= 0x39),
    "exclaim": np.isin(_BYTES, list(b"!?")),
    "stop": np.isin(_BYTES, list(b".,;:")),
    "bar": np.isin(_BYTES, list(b"|")),
}
RULES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = (
    "log_words", "word_length", "symbols", "dup_lines", "repeats",
    "upper", "digit", "exclaim", "stop", "bar", "variety", "line_words",
)


def _per_key(text: np.ndarray, code: np.ndarray, n_codes: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, code) pairs: the text of each, and the pair of each element."""
    keys, inverse = np.unique(text * max(n_codes, 1) + code, return_inverse=True)
    return keys // max(n_codes, 1), inverse


def measured(texts: pa.Array) -> dict[str, np.ndarray]:
    """Rule statistics and features of texts, as arrays by text."""
    n = len(texts)
    raw, offsets = raw_bytes(texts)
    words = space_words(texts)
    codes, distinct = words.coded()
    of, count = words.text_of, words.per_text
    out = {"n_words": count}
    out["word_chars"] = sums(pc.utf8_length(words.flat).to_numpy(zero_copy_only=False), words.offsets)
    for name, table in _IS.items():
        out[name] = sums(table[raw], offsets)
    # lines with a word
    lists = pc.split_pattern(texts, "\n")
    at = lists.offsets.to_numpy().astype(np.int64)
    lines = lists.flatten()
    full = pc.not_equal(pc.binary_length(pc.ascii_trim(lines, " \t\n\v\f\r")), 0).to_numpy(zero_copy_only=False)
    line_of = np.repeat(np.arange(n), np.diff(at))[full]
    made = pc.dictionary_encode(lines.filter(pa.array(full)))
    line_codes = made.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    kept, _ = _per_key(line_of, line_codes, len(made.dictionary))
    out["lines"] = np.bincount(line_of, minlength=n)
    out["n_dup_lines"] = out["lines"] - np.bincount(kept, minlength=n)
    # words in repeated windows of three
    covered = np.zeros(codes.size + 3, np.int64)
    if codes.size > 2:
        inside = of[:-2] == of[2:]
        _, pair = np.unique(codes[:-1] * len(distinct) + codes[1:], return_inverse=True)
        _, window = np.unique(pair[:-1] * len(distinct) + codes[2:], return_inverse=True)
        start = np.flatnonzero(inside)
        _, group = _per_key(of[start], window[start], int(window.max()) + 1)
        again = start[np.bincount(group)[group] > 1]
        for j in range(3):
            covered[again + j] = 1
    out["n_repeat_words"] = sums(covered[: codes.size], words.offsets)
    variety, _ = _per_key(of, codes, len(distinct))
    out["variety"] = np.bincount(variety, minlength=n)
    return out


def features(m: dict[str, np.ndarray]) -> np.ndarray:
    """One row of FEATURES per text."""
    words = np.maximum(m["n_words"], 1).astype(np.float64)
    chars = np.maximum(m["word_chars"], 1).astype(np.float64)
    lines = np.maximum(m["lines"], 1).astype(np.float64)
    root = np.sqrt
    return np.stack(
        [
            np.log1p(m["n_words"]),
            np.log(chars / words),
            root(m["n_symbols"] / chars),
            root(m["n_dup_lines"] / lines),
            root(m["n_repeat_words"] / words),
            root(m["upper"] / chars),
            root(m["digit"] / chars),
            root(m["exclaim"] / chars),
            root(m["stop"] / chars),
            root(m["bar"] / chars),
            np.log(m["variety"] + 1.0) / np.log(words + 1.5),
            np.log(words / lines),
        ],
        axis=1,
    )


def _mean_path(n: float) -> float:
    """Mean path length of an unsuccessful search in a random tree of n points."""
    return 0.0 if n <= 1 else 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


@dataclass(frozen=True)
class Forest:
    """Trees as arrays (tree, node): feature (-1 at a leaf), split value, path length."""

    feature: np.ndarray
    split: np.ndarray
    path: np.ndarray
    depth: int
    norm: float

    def score(self, points: np.ndarray) -> np.ndarray:
        """Anomaly in (0, 1]: near 1 for points that are alone at once."""
        total = np.zeros(len(points))
        for feature, split, path in zip(self.feature, self.split, self.path):
            node = np.zeros(len(points), np.int64)
            for _ in range(self.depth):
                f = feature[node]
                right = points[np.arange(len(points)), f] >= split[node]
                node = np.where(f < 0, node, 2 * node + 1 + right)
            total += path[node]
        return 2.0 ** (-total / len(self.feature) / self.norm)


def drawn(n_good: int, n_junk: int, rows: int = TREE_ROWS) -> tuple[int, int]:
    """How many good and junk rows a tree has."""
    junk = min(n_junk, int(rows * JUNK_SHARE))
    return min(n_good, rows - junk), junk


def _depth(rows: int) -> int:
    return int(np.ceil(np.log2(max(rows, 2))))


def grown(points: np.ndarray, depth: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature, split, path) of the nodes of one tree over its rows.

    A node is 2i + 1 or 2i + 2 under node i; nodes of ``depth`` are leaves.
    """
    rng = np.random.default_rng(seed)
    nodes = 2 ** (depth + 1) - 1
    feature, split, path = np.full(nodes, -1), np.zeros(nodes), np.zeros(nodes)
    open_ = [(0, 0, points)]
    while open_:
        node, level, own = open_.pop()
        spread = np.flatnonzero(own.max(0) > own.min(0)) if len(own) > 1 else []
        if level == depth or len(spread) == 0:
            path[node] = level + _mean_path(len(own))
            continue
        f = int(rng.choice(spread))
        low, high = own[:, f].min(), own[:, f].max()
        value = low + (high - low) * (1 - rng.random())  # above the lowest point
        feature[node], split[node] = f, value
        right = own[:, f] >= value
        open_ += [(2 * node + 1, level + 1, own[~right]), (2 * node + 2, level + 1, own[right])]
    return feature, split, path


def grow(good: np.ndarray, junk: np.ndarray, trees: int = TREES, rows: int = TREE_ROWS, seed: int = 7) -> Forest:
    """A forest over random draws from points at hand."""
    rng = np.random.default_rng(seed)
    sizes = drawn(len(good), len(junk), rows)
    depth = _depth(sum(sizes))
    own = [[rng.choice(p, k, replace=False) for p, k in zip((good, junk), sizes) if k] for _ in range(trees)]
    made = [grown(np.concatenate(parts), depth, seed + t) for t, parts in enumerate(own)]
    return Forest(*(np.array(x) for x in zip(*made)), depth, max(_mean_path(sum(sizes)), 1e-9))


def forest_of(labelled: DataFrame, n_good: int, n_junk: int, trees: int = TREES, rows: int = TREE_ROWS, seed: int = 7) -> Forest:
    """A forest over draws from all of ``labelled`` (doc_id, good, point).

    A tree has the rows of each kind whose hash with its number is lowest.  A limit on the
    hash leaves about four times as many as are wanted, so that no tree ranks all rows.
    """
    good, junk = drawn(n_good, n_junk, rows)
    depth = _depth(good + junk)
    schema = "tree int, feature array<int>, split array<double>, path array<double>"

    def limit(wanted: int, n: int) -> float:
        return (4 * wanted + 64) / max(n, 1)

    def one(own: pa.Table) -> pa.Table:
        number = own.column("tree")[0].as_py()
        own = own.sort_by([("unit", "ascending"), ("doc_id", "ascending")])
        points = np.array(own.column("point").to_pylist(), np.float64)
        made = grown(points, depth, seed + number)
        kinds = (pa.list_(pa.int32()), pa.list_(pa.float64()), pa.list_(pa.float64()))
        columns = [pa.array([x.tolist()], kind) for x, kind in zip(made, kinds)]
        return pa.table([pa.array([number], pa.int32()), *columns], names=["tree", "feature", "split", "path"])

    every = F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))
    unit = F.shiftrightunsigned(F.xxhash64("doc_id", "tree", F.lit(seed)), 11).cast("double") * 2.0**-53
    most = F.when(F.col("good"), F.lit(limit(good, n_good))).otherwise(F.lit(limit(junk, n_junk)))
    near = labelled.withColumn("tree", every).withColumn("unit", unit).filter(F.col("unit") < most)
    place = F.row_number().over(Window.partitionBy("tree", "good").orderBy("unit", "doc_id"))
    own = near.withColumn("at", place).filter(F.col("at") <= F.when(F.col("good"), good).otherwise(junk))
    made = own.select("tree", "doc_id", "unit", "point").groupBy("tree").applyInArrow(one, schema)
    found = made.orderBy("tree").toPandas()
    shape = [np.array(found[c].tolist()) for c in ("feature", "split", "path")]
    return Forest(*shape, depth, max(_mean_path(good + junk), 1e-9))


def threshold(good: np.ndarray, junk: np.ndarray, max_loss: float = MAX_LOSS) -> float:
    """The cut of ``cut_of`` for scores at hand."""
    if not len(junk):
        return float("inf")
    cuts = np.unique(np.concatenate([good, junk]))
    loss = 1 - np.searchsorted(np.sort(good), cuts, "right") / max(len(good), 1)
    won = 1 - np.searchsorted(np.sort(junk), cuts, "right") / len(junk)
    gain = np.where(loss <= max_loss, won - loss, -1.0)
    best = int(gain.argmax())
    return float(cuts[best]) if gain[best] > 0 else float("inf")


def cut_of(scored: DataFrame, n_good: int, n_junk: int, max_loss: float = MAX_LOSS) -> float:
    """The score above which rows go: most junk for at most ``max_loss`` of the good.

    ``scored``: (score, good) of all labelled rows.  Scores are dealt to ranges; a range
    adds up its own and what the ranges before it hold, and names its best cut.
    """
    if not n_junk:
        return float("inf")
    cuts = scored.groupBy("score").agg(F.count_if("good").alias("g"), F.count_if(~F.col("good")).alias("j"))
    cuts = materialise(cuts.repartitionByRange("score").withColumn("range", F.spark_partition_id()), "cuts")
    totals = cuts.groupBy("range").agg(F.sum("g").alias("_g"), F.sum("j").alias("_j"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    totals = totals.select("range", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in ("_g", "_j")])
    within = Window.partitionBy("range").orderBy("score")

    def above(own: str, earlier: str, n: int) -> Column:
        return F.lit(1.0) - (F.sum(own).over(within) + F.col(earlier)) / F.lit(float(max(n, 1)))

    rates = cuts.join(F.broadcast(totals), "range").select(
        "score", above("g", "_g", n_good).alias("loss"), above("j", "_j", n_junk).alias("won")
    )
    gain = F.when(F.col("loss") <= max_loss, F.col("won") - F.col("loss"))
    best = rates.agg(F.max(F.struct(gain.alias("gain"), (-F.col("score")).alias("score"))).alias("b")).first()["b"]
    release(cuts)
    return -best["score"] if best and (best["gain"] or 0.0) > 0 else float("inf")


def labelled_sample(labels: DataFrame, columns: list[str], size: int) -> DataFrame:
    """At most ``size`` labelled ids, drawn by the hash of the id.

    The smallest value counts if an id is labelled more than once; rows with a null are
    left out.
    """
    own = labels.dropna(subset=["doc_id", *columns])
    own = own.groupBy("doc_id").agg(*[F.min(c).alias(c) for c in columns])
    return own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(size)


def _measured_rows(source: DataFrame) -> DataFrame:
    """(doc_id, the RULES, point): statistics and features of each row of (doc_id, _text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "_text"):
            m = measured(text_array(batch.column("_text")))
            flat = pa.array(features(m).reshape(-1))
            points = pa.FixedSizeListArray.from_arrays(flat, len(FEATURES)).cast(pa.list_(pa.float64()))
            columns = [batch.column("doc_id"), *[pa.array(m[c].astype(np.int64)) for c in RULES], points]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *RULES, "point"])

    kind = source.schema["doc_id"].dataType.simpleString()
    longs = ", ".join(f"{c} long" for c in RULES)
    return source.mapInArrow(run, f"doc_id {kind}, {longs}, point array<double>")


def _labelled_points(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, good, point): the features of all labelled rows; a repeated id counts once."""
    own = labels.dropna(subset=["doc_id", "quality"]).groupBy("doc_id")
    own = own.agg((F.min("quality").cast("int") > 0).alias("good"))
    points = rows.groupBy("doc_id").agg(F.min("point").alias("point"))
    return points.join(own, "doc_id").select("doc_id", "good", "point")


def _scored(labelled: DataFrame, forest: Forest) -> DataFrame:
    """(score, good) of all labelled rows."""
    made = (forest.feature, forest.split, forest.path, forest.depth, forest.norm)
    shared = labelled.sparkSession.sparkContext.broadcast(made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = Forest(*shared.value)
        for batch in batches:
            points = batch.column("point").flatten().to_numpy().reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays([pa.array(trees.score(points)), batch.column("good")], names=["score", "good"])

    return labelled.select("point", "good").mapInArrow(run, "score double, good boolean")


def judge(
    docs: DataFrame,
    labels: DataFrame,
    max_loss: float = MAX_LOSS,
    text: str = "text",
) -> DataFrame:
    """(doc_id, the RULES, base_failed, kept, anomaly) for each row.

    ``base_failed``: under 50 words, or more than half of the words in windows of three
    words that occur twice.  ``kept`` is false if the base fails or the anomaly score is
    over the calibrated threshold; without labelled rows of both kinds only the base
    decides.  A null text has no words.  Other columns are not read.
    """
    source = docs.select(docs["doc_id"], F.coalesce(docs[text], F.lit("")).alias("_text"))
    rows = materialise(_measured_rows(source), "measured")  # texts are read once and never moved
    labelled, seen = materialise_with(
        _labelled_points(rows, labels), "labelled", good=F.count_if("good"), junk=F.count_if(~F.col("good"))
    )
    n_good, n_junk = seen["good"] or 0, seen["junk"] or 0
    forest = forest_of(labelled, n_good, n_junk) if n_good > 1 and n_junk else None
    limit = cut_of(_scored(labelled, forest), n_good, n_junk, max_loss) if forest else float("inf")
    release(labelled)
    trees = (forest.feature, forest.split, forest.path, forest.depth, forest.norm) if forest else None
    shared = docs.sparkSession.sparkContext.broadcast((trees, limit))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, cut = shared.value
        trees = Forest(*made) if made else None
        for batch in batches:
            points = batch.column("point").flatten().to_numpy().reshape(-1, len(FEATURES))
            n_words, repeated = (batch.column(c).to_numpy() for c in ("n_words", "n_repeat_words"))
            score = trees.score(points) if trees else np.zeros(batch.num_rows)
            failed = (n_words < MIN_WORDS) | (100 * repeated > 50 * n_words)
            columns = [batch.column(c) for c in ("doc_id", *RULES)]
            columns += [pa.array(failed), pa.array(~failed & (score <= cut)), pa.array(score)]
            yield pa.RecordBatch.from_arrays(
                columns, names=["doc_id", *RULES, "base_failed", "kept", "anomaly"]
            )

    kind = source.schema["doc_id"].dataType.simpleString()
    longs = ", ".join(f"{c} long" for c in RULES)
    return rows.mapInArrow(
        run, f"doc_id {kind}, {longs}, base_failed boolean, kept boolean, anomaly double"
    )
