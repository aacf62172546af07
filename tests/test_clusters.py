from __future__ import annotations

import brute_force as bf
import numpy as np
import pytest
from pyspark.sql import functions as F

from gripelens.operators import cells, density, embedding, neighbours, refine, silhouette, skew, spectral, tree


def frame(spark, x, name="embedding"):
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x)]
    return spark.createDataFrame(rows, f"feedback_id long, {name} array<double>")


def blobs(seed, size=40, groups=5, scattered=25, dim=5, copies=True):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dim)) * 6
    parts = [c + rng.normal(size=(size, dim)) * rng.uniform(0.3, 2) for c in centres]
    x = np.vstack([*parts, rng.uniform(-15, 15, size=(scattered, dim))])
    if copies:
        x = np.vstack([x, x[:3].repeat([14, 3, 1], 0), x[10:14]])
    return x


def check_knn(spark, x, k, metric):
    got = neighbours.knn_graph(frame(spark, x), k, metric).toPandas()
    got = got.sort_values(["src", "rank"])
    order, dist = bf.neighbours(x, k, metric)
    assert np.allclose(got["dist"].to_numpy().reshape(len(x), -1), dist, atol=1e-9)
    return got, order


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
def test_knn_with_copies(spark, metric):
    x = blobs(1)
    got, order = check_knn(spark, x, 12, metric)
    assert (got["dst"].to_numpy().reshape(len(x), -1) == order).all()


def test_knn_prunes_and_stays_exact(spark, monkeypatch):
    monkeypatch.setattr(cells, "CELL_ROWS", 16)
    monkeypatch.setattr(cells, "PARTNERS", 3)
    monkeypatch.setattr(cells, "PART_ROWS", 50)
    x = blobs(2)
    got, order = check_knn(spark, x, 7, "euclidean")
    assert (got["dst"].to_numpy().reshape(len(x), -1) == order).all()


def test_cells_are_sent_once_for_each_group(spark, monkeypatch):
    small_cells(monkeypatch)
    monkeypatch.setattr(cells, "GROUPS", 2)
    x = np.random.default_rng(4).normal(size=(400, 40))  # every cell meets every other
    tree = tree_of(spark, x, 5)
    n = tree.packed.count()
    pairs = cells.cell_pairs(tree, cells.constant_facts(tree, 1e6))
    left, right = cells.dealt(tree, pairs)
    assert pairs.count() == n * n and n > 20
    assert left.count() == 2 * n and right.count() == 2 * n
    assert sum(len(r["askers"]) for r in right.collect()) == n * n
    monkeypatch.setattr(cells, "GROUP_BYTES", 3 * 16 * 40 * 8)  # three cells in a group
    groups = tree_of(spark, x, 5).groups.groupBy("group").count().collect()
    assert max(r["count"] for r in groups) == 3
    check_knn(spark, x, 6, "euclidean")


def test_pieces_narrow_the_radius_and_lose_nothing(monkeypatch):
    monkeypatch.setattr(neighbours, "CELL_ROWS", 7)
    rnd = np.random.default_rng(6)
    p = rnd.integers(0, 3, (60, 3)).astype(float)  # many ties, and points on queries
    q = rnd.integers(0, 3, (20, 3)).astype(float)
    away = np.sqrt(((q[:, None] - p[None]) ** 2).sum(2))
    for radius in (np.inf, 1.5, 0.0):
        block = cells.Block(np.arange(20), q, {"radius": np.full(20, radius)})
        rows, cols, dist = neighbours._closest_others(block, cells.Block(np.arange(60), p, {}), 5)
        want = [(i, j) for i in range(20) for j in np.lexsort([np.arange(60), away[i]])[:5] if away[i, j] <= radius]
        assert sorted(zip(rows.tolist(), cols.tolist())) == sorted((i, int(j)) for i, j in want)
        assert np.allclose(dist, away[rows, cols])


def test_knn_ties_by_id(spark):
    x = np.array([[0.0, 0], [0, 1], [1, 0], [1, 1]])
    got = neighbours.knn_graph(frame(spark, x), 2, "euclidean").orderBy("src", "rank").collect()
    assert [r["dst"] for r in got] == [1, 2, 0, 3, 0, 3, 1, 2]


def test_knn_zero_vectors_and_few_points(spark):
    x = np.array([[0.0, 0], [1, 0], [0, 2], [0, 0]])
    got = neighbours.knn_graph(frame(spark, x), 5, "cosine").orderBy("src", "rank").collect()
    assert len(got) == 12
    near = {(r["src"], r["dst"]): r["dist"] for r in got}
    assert near[0, 3] == 0 and near[0, 1] == pytest.approx(1) and near[1, 2] == pytest.approx(1)


def small_cells(monkeypatch, rows=16, fan=4):
    monkeypatch.setattr(cells, "CELL_ROWS", rows)
    monkeypatch.setattr(cells, "FAN", fan)
    monkeypatch.setattr(cells, "PART_ROWS", 50)


def tree_of(spark, x, near=0):
    points = frame(spark, x).select(F.col("feedback_id").alias("id"), F.col("embedding").alias("vec"))
    return cells.build_cells(points, near)


def test_cells_stay_small_and_know_their_points(spark, monkeypatch):
    small_cells(monkeypatch)
    x = blobs(3, copies=False)
    tree = tree_of(spark, x, 3)
    packed = tree.packed.collect()
    assert sorted(i for r in packed for i in r["ids"]) == list(range(len(x)))
    assert max(len(r["ids"]) for r in packed) <= 16
    facts = {r["cell"]: r for r in tree.cells.collect()}
    d = np.sort(bf.distances(x), axis=1)
    for r in packed:
        assert r["ids"] == sorted(r["ids"])
        assert (np.array(r["vecs"]).reshape(len(r["ids"]), -1) == x[r["ids"]]).all()
        assert all(b >= d[i, 3] - 1e-9 for i, b in zip(r["ids"], r["bound"]))
        cell = r["cell"]
        while cell != cells.ROOT:
            f = facts[cell]
            away = np.linalg.norm(x[r["ids"]] - np.array(f["pivot"]), axis=1)
            assert (away >= f["low"] - 1e-9).all() and (away <= f["high"] + 1e-9).all()
            cell = f["parent"]
    assert max(f.count(".") for f in facts) > 1


def test_range_search_visits_enough(spark, monkeypatch):
    small_cells(monkeypatch)
    x = blobs(3, copies=False)
    tree = tree_of(spark, x)
    home = {i: r["cell"] for r in tree.packed.collect() for i in r["ids"]}
    pairs = {tuple(r) for r in cells.cell_pairs(tree, cells.constant_facts(tree, 3.0)).collect()}
    d = bf.distances(x)
    assert {(home[i], home[j]) for i, j in zip(*np.nonzero(d <= 3.0))} <= pairs
    assert len(pairs) < 0.6 * len(set(home.values())) ** 2


def test_cells_of_one_mark_never_meet(spark, monkeypatch):
    small_cells(monkeypatch)
    tree = tree_of(spark, blobs(3, copies=False))
    leaf = tree.packed.select("cell", F.lit(1e9).alias("need"), F.pmod(F.hash("cell"), F.lit(3)).cast("long").alias("m"))
    facts = leaf.select("cell", "need", F.col("m").alias("low_mark"), F.col("m").alias("high_mark"))
    marks = {r["cell"]: r["m"] for r in leaf.collect()}
    got = {tuple(r) for r in cells.cell_pairs(tree, facts).collect()}
    assert got == {(a, b) for a in marks for b in marks if marks[a] != marks[b]}


def test_odd_vectors_are_set_aside(spark):
    rows = [(0, [0.0, 1.0]), (1, [1.0, 1.0]), (2, None), (3, [1.0]), (4, [1.0, None]), (None, [2.0, 2.0]),
            (5, [float("nan"), 1.0]), (6, [0.0, 3.0])]
    df = spark.createDataFrame(rows, "feedback_id long, embedding array<double>")
    got = neighbours.knn_graph(df, 1, "euclidean").collect()
    assert {(r["src"], r["dst"]) for r in got} == {(0, 1), (1, 0), (6, 0)}


def test_fuzzy_weights(spark):
    x, k = blobs(4, size=15, groups=3, scattered=5, copies=False), 8
    order, dist = bf.neighbours(x, k)
    w = np.zeros((len(x), len(x)))
    for i in range(len(x)):
        e = dist[i] - dist[i, 0]
        low, high = 1e-9, 1e9
        for _ in range(200):
            mid = (low * high) ** 0.5
            low, high = (low, mid) if np.exp(-e / mid).sum() > np.log2(k) else (mid, high)
        w[i, order[i]] = np.exp(-e / low)
    w = w + w.T - w * w.T
    knn = neighbours.knn_graph(frame(spark, x), k, "euclidean")
    got = {(r["src"], r["dst"]): r["weight"] for r in neighbours.fuzzy_graph(knn).collect()}
    assert set(got) == {(i, j) for i, j in zip(*np.nonzero(w)) if i < j}
    assert all(v == pytest.approx(w[p], abs=1e-6) for p, v in got.items())


@pytest.mark.parametrize("seed, rows, large", [(5, 2048, 1 << 16), (6, 16, 20)])
def test_spanning_tree(spark, monkeypatch, seed, rows, large):
    small_cells(monkeypatch, rows, 8)
    monkeypatch.setattr(skew, "LARGE", large)
    x = blobs(seed)
    got = tree.minimum_spanning_tree(frame(spark, x), 6).toPandas()
    expected = bf.spanning_tree(bf.reach_matrix(x, 6), bf.distances(x))
    assert len(got) == len(x) - 1
    assert np.allclose(np.sort(got["weight"]), [e[0] for e in expected])
    group = list(range(len(x)))
    for a, b in zip(got["src"], got["dst"]):
        group = [group[a] if g == group[b] else g for g in group]
    assert len(set(group)) == 1


def check_density(spark, x, m=10, **options):
    found = density.density_clusters(frame(spark, x, "reduced"), m, **options)
    got = found.assignment.toPandas().sort_values("feedback_id")
    labels, confidence, stability = bf.density_labels(x, m)
    assert (got["cluster_id"].to_numpy() == labels).all()
    assert np.allclose(got["cluster_confidence"], confidence)
    info = {r["cluster_id"]: r["stability"] for r in found.info.collect()}
    assert info == pytest.approx(stability)
    return labels


def test_density_blobs(spark):
    rng = np.random.default_rng(7)
    centres = np.array([[0.0, 0], [50, 0], [0, 50]])
    far = np.array([[500.0, 500], [-500, 400], [300, -600], [-700, -700], [900, 100]])
    x = np.vstack([*[c + rng.normal(size=(30, 2)) for c in centres], far])
    labels = check_density(spark, x)
    assert labels.max() == 2 and (labels == -1).sum() == 5


def test_density_exact_copies_tie_order(spark):
    x = blobs(8)
    found = density.density_clusters(frame(spark, x, "reduced"), 10)
    got = found.assignment.toPandas().sort_values("feedback_id")["cluster_id"].to_numpy()
    labels, _, _ = bf.density_labels(x, 10)
    assert (got == labels).all()


def test_density_through_contraction(spark):
    check_density(spark, blobs(9, size=30, groups=4, scattered=20, copies=False), group_bits=4)


def test_density_small_inputs(spark):
    for x in (np.zeros((1, 2)), np.zeros((30, 2)), np.arange(8.0).reshape(4, 2)):
        found = density.density_clusters(frame(spark, x, "reduced"), 10)
        got = found.assignment.collect()
        assert len(got) == len(x) and {r["cluster_id"] for r in got} == {-1}
        assert found.info.count() == 0


def test_density_string_keys(spark):
    x = blobs(10, size=20, groups=3, scattered=6, copies=False)
    df = frame(spark, x, "reduced").withColumn("feedback_id", F.format_string("K%04d", "feedback_id"))
    got = density.density_clusters(df).assignment.orderBy("feedback_id").collect()
    labels, _, _ = bf.density_labels(x, 10)
    assert [r["cluster_id"] for r in got] == labels.tolist()


def test_deep_cluster_trees_settle(spark):
    """A chain of splits, each with one small child, against the plain recursion."""
    rng = np.random.default_rng(11)
    depth, rows, tree_of = 40, [], {}
    parent, cid = None, 0
    for _ in range(depth):
        rows.append((cid, parent, 10, float(rng.uniform(0, 10)), 1.0))
        tree_of.setdefault(cid, [])
        rows.append((cid + 1, cid, 5, float(rng.uniform(0, 3)), 1.0))
        tree_of[cid] += [cid + 1]
        tree_of[cid + 1] = []
        parent, cid = cid, cid + 2
        tree_of[parent] += [cid]
    rows.append((cid, parent, 5, 2.0, 1.0))
    tree_of[cid] = []
    stability = {r[0]: r[3] for r in rows}
    worth, own = {}, {}
    for c in sorted(tree_of, reverse=True):
        below = sum(worth[k] for k in tree_of[c])
        own[c] = c != 0 and stability[c] >= below
        worth[c] = max(below, stability[c])
    expected = {}

    def walk(c, chosen):
        chosen = chosen if chosen is not None else (c if own[c] else None)
        expected[c] = chosen
        for k in tree_of[c]:
            walk(k, chosen)

    walk(0, None)
    df = spark.createDataFrame(rows, "cluster long, parent long, size long, stability double, peak double")
    got = {r["cluster"]: r["selected"] for r in density.select_clusters(df).collect()}
    assert got == expected


def pairs(spark, edges):
    return spark.createDataFrame(edges, "i int, j int")


def follows_rule(n, edges, mapped):
    """An id goes to the smallest kept smaller id it is similar to, if there is one."""
    kept = set(range(n)) - set(mapped)
    for i in range(n):
        smaller = [a for a, b in edges if b == i and a in kept]
        assert mapped.get(i) == (min(smaller) if smaller else None)


def test_merge_map(spark):
    cases = [
        ([(0, 1), (1, 2)], {1: 0}),
        ([(1, 2), (0, 2)], {2: 0}),
        ([(0, 3), (2, 3), (1, 2), (3, 4)], {3: 0, 2: 1}),
    ]
    rng = np.random.default_rng(12)
    for _ in range(4):
        edges = [(i, j) for i in range(12) for j in range(i + 1, 12) if rng.random() < 0.25]
        cases.append((edges, None))
    for edges, expected in cases:
        got = {r["old_id"]: r["new_id"] for r in refine.merge_map(pairs(spark, edges)).collect()}
        assert expected is None or got == expected
        follows_rule(12, edges, got)


def test_silhouette_of_one_cluster(spark):
    x = np.array([[1.0, 0], [1, 0.1], [0, 1]])
    cl = spark.createDataFrame([(0, 0), (1, 0), (2, -1)], "feedback_id long, cluster_id int")
    assert silhouette.silhouette(cl, frame(spark, x, "embedding")).first()["silhouette"] is None


def plain_silhouette(x, labels):
    d = bf.distances(x) ** 2
    scores = []
    for i, c in enumerate(labels):
        if c == -1:
            continue
        mates = [j for j in np.flatnonzero(labels == c) if j != i]
        b = min(d[i, labels == o].mean() for o in set(labels) - {c, -1})
        a = d[i, mates].mean() if mates else b
        scores.append(0.0 if not mates or a == b else (b - a) / max(a, b))
    return np.mean(scores)


@pytest.mark.parametrize("rows, large", [(2048, 1 << 16), (4, 12)])
def test_silhouette(spark, monkeypatch, rows, large):
    small_cells(monkeypatch, rows, 3)
    monkeypatch.setattr(skew, "LARGE", large)
    monkeypatch.setattr(cells, "PARTNERS", 2)
    rng = np.random.default_rng(15)
    centres = rng.normal(size=(14, 3)) * 8
    x = np.vstack([c + rng.normal(size=(5 + 2 * i, 3)) * rng.uniform(0.1, 4) for i, c in enumerate(centres)])
    labels = np.repeat(np.arange(14), [5 + 2 * i for i in range(14)])
    # clusters with one centre, of one point, of equal points, and noise
    x = np.vstack([x, x[:5], [[99.0, 0, 0]], np.ones((4, 3)), rng.normal(size=(6, 3))])
    labels = np.concatenate([labels, [20] * 5, [21], [22] * 4, [-1] * 6])
    cl = spark.createDataFrame([(i, int(c)) for i, c in enumerate(labels)], "feedback_id long, cluster_id int")
    got = silhouette.silhouette(cl, frame(spark, x, "embedding")).first()["silhouette"]
    assert got == pytest.approx(plain_silhouette(x, labels), abs=1e-9)


def test_merge_map_of_a_chain(spark, monkeypatch):
    """A long chain of similar clusters settles in rounds that grow with its logarithm."""
    n, rounds = 3000, []
    keep = refine.materialise_with
    monkeypatch.setattr(refine, "materialise_with", lambda *a, **k: rounds.append(a[1]) or keep(*a, **k))
    chain = spark.range(n - 1).selectExpr("CAST(id AS INT) AS i", "CAST(id + 1 AS INT) AS j")
    got = {r["old_id"]: r["new_id"] for r in refine.merge_map(chain).collect()}
    assert got == {i: i - 1 for i in range(1, n, 2)}
    assert len(rounds) <= 20


def greedy_merges(sim, t):
    """Clusters in id order: each maps to the smallest kept one that it is similar to."""
    kept, out = [], {}
    for j in range(len(sim)):
        near = [i for i in kept if sim[i, j] >= t]
        if near:
            out[j] = near[0]
        else:
            kept.append(j)
    return out


@pytest.mark.parametrize("seed, rows", [(16, 2048), (17, 8), (18, 8)])
def test_clumps_and_pairs_by_brute_force(spark, monkeypatch, seed, rows):
    small_cells(monkeypatch, rows, 3)
    rng = np.random.default_rng(seed)
    x = np.vstack([rng.normal(size=(40, 3)), np.ones((30, 3)) + rng.normal(size=(30, 3)) * 0.05])
    x = np.vstack([x, x[:4], x[40:43] * 2, np.zeros((2, 3))])[rng.permutation(79)]
    sim = 1 - bf.distances(x, "cosine")
    df = frame(spark, x, "centroid").withColumnRenamed("feedback_id", "cluster_id")
    for t in (0.8, 0.995):
        found = refine.similar_clusters(df, t)
        got = [(r["i"], r["j"], r["similarity"]) for r in found.listed().collect()]
        expected = {(i, j): sim[i, j] for i in range(79) for j in range(i + 1, 79) if sim[i, j] >= t}
        assert len(got) == len(expected)
        assert {(i, j): s for i, j, s in got} == pytest.approx(expected)
        merges = {r["old_id"]: r["new_id"] for r in refine.merge_map(found).collect()}
        assert merges == greedy_merges(sim, t)


def test_near_equal_centroids_give_few_rows(spark):
    rng = np.random.default_rng(19)
    x = np.ones((500, 4)) + rng.normal(size=(500, 4)) * 0.01
    df = frame(spark, x, "centroid").withColumnRenamed("feedback_id", "cluster_id")
    found = refine.similar_clusters(df, 0.9)
    assert found.members.count() == 500
    assert found.pairs.count() + found.joint.count() < 500
    assert refine.merge_map(found).filter("new_id = 0").count() == 499


def test_refine_merges_parallel_centroids(spark):
    x = np.array([[1.0, 0], [1, 0.1], [0, 1], [2, 0.1], [0, 3], [1, 0]])
    cl = spark.createDataFrame(list(enumerate([0, 0, 1, 2, 3, -1])), "feedback_id long, cluster_id int")
    out = refine.refine_clusters(cl, frame(spark, x, "reduced"))
    assert [r["cluster_id"] for r in out.orderBy("feedback_id").collect()] == [0, 0, 1, 0, 1, -1]
    assert tuple(refine.refinement_counts(cl, out).first()) == (4, 2)


def test_nothing_to_cluster(spark):
    none = frame(spark, np.ones((2, 2)), "reduced").limit(0)
    noise = spark.createDataFrame([(0, -1), (1, -1)], "feedback_id long, cluster_id int")
    assert neighbours.knn_graph(none, 3, key="feedback_id", vector="reduced").count() == 0
    assert density.density_clusters(none).assignment.count() == 0
    out = refine.refine_clusters(noise, frame(spark, np.ones((2, 2)), "reduced"))
    assert [r["cluster_id"] for r in out.collect()] == [-1, -1]


def test_similar_pairs_by_brute_force(spark):
    rng = np.random.default_rng(13)
    x = rng.normal(size=(60, 4))
    sim = 1 - bf.distances(x, "cosine")
    df = frame(spark, x, "centroid").withColumnRenamed("feedback_id", "cluster_id")
    got = {(r["i"], r["j"]): r["similarity"] for r in refine.similar_pairs(df, 0.8).collect()}
    expected = {(i, j): sim[i, j] for i in range(60) for j in range(i + 1, 60) if sim[i, j] >= 0.8}
    assert got == pytest.approx(expected)


def test_text_vectors(spark):
    texts = ["Component: gear | Failure: noise", "gear noise", "Über gear", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "feedback_id long, formatted_text string")
    got = np.array([r["embedding"] for r in embedding.embed_texts(df).orderBy("feedback_id").collect()])
    assert got.shape == (4, 1024)
    assert np.allclose(np.linalg.norm(got, axis=1), [1, 1, 1, 0], atol=1e-6)
    idf = {"gear": np.log(5 / 4), "noise": np.log(5 / 3)}
    assert got[1].max() == pytest.approx(idf["noise"] / np.hypot(*idf.values()), abs=1e-6)


def test_pca_matches_svd(spark):
    rng = np.random.default_rng(14)
    x = rng.normal(size=(80, 6)) * [5, 4, 3, 2, 1, 0.5] + 7
    rows = embedding.reduce_dimensions(frame(spark, x), 3).orderBy("feedback_id").collect()
    got = np.array([r["reduced"] for r in rows])
    centred = x - x.mean(0)
    _, _, v = np.linalg.svd(centred, full_matrices=False)
    assert np.allclose(np.abs(got), np.abs(centred @ v[:3].T), atol=1e-8)
    assert np.allclose(got.mean(0), 0, atol=1e-8)


def test_spectral_axes(spark, monkeypatch):
    x = blobs(20, size=20, groups=3, scattered=12, copies=False)
    graph = neighbours.fuzzy_graph(neighbours.knn_graph(frame(spark, x), 8, "euclidean"))
    w = np.zeros((len(x), len(x)))
    for r in graph.collect():
        w[r["src"], r["dst"]] = w[r["dst"], r["src"]] = r["weight"]
    scale = 1 / np.sqrt(w.sum(0))
    s = w * scale[:, None] * scale[None, :]
    expected = np.linalg.eigvalsh(s)[::-1]
    monkeypatch.setattr(skew, "LARGE", 12)
    rows, axes = spectral.spectral_axes(graph, 4, 1e-5)
    found = axes.orderBy("axis").collect()
    assert np.allclose([r["eigenvalue"] for r in found], expected[:5], atol=1e-6)
    v = np.array([r[1:] for r in rows.orderBy("id").collect()])
    assert np.allclose(v.T @ v, np.eye(5), atol=1e-9)
    assert np.linalg.norm(s @ v - v * expected[:5], axis=0).max() < 1e-4
    assert (v[np.abs(v).round(9).argmax(0), np.arange(5)] > 0).all()
    for r in spectral.axis_checks(graph, rows, axes).collect():
        assert r["residual"] < 1e-4 and r["overlap"] < 1e-9
    reduced = spectral.reduce_graph(graph, 2).collect()
    assert len(reduced) == len(x) and all(len(r["reduced"]) == 2 for r in reduced)


def test_spectral_axes_of_few_nodes(spark):
    pair = spark.createDataFrame([(1, 2, 0.5)], "src long, dst long, weight double")
    rows, axes = spectral.spectral_axes(pair)
    assert sorted(round(r["eigenvalue"], 9) for r in axes.collect()) == [-1, 1]
    assert spectral.spectral_axes(pair.limit(0))[0].count() == 0
