"""Fitted models: planted outliers, brute-force neighbours, additivity, components."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from vigilog.operators import clusters, detection, supervised, verdicts
from vigilog.session import stored

NAMES = ["a", "b", "c"]


def points(spark, n=200, outliers=6, parts=3):
    draw = np.random.default_rng(7)
    x = draw.normal(size=(n, 3))
    x[:outliers] += draw.choice([-1, 1], size=(outliers, 3)) * 9
    data = [(i, *map(float, row)) for i, row in enumerate(x)]
    return x, spark.createDataFrame(data, "record_id long, a double, b double, c double").repartition(parts)


@pytest.mark.parametrize("algorithm", detection.ALGORITHMS)
def test_planted_outliers_come_first(spark, algorithm):
    _, df = points(spark)
    result = detection.fit_detector(df, NAMES, algorithm).predict(df)
    top = result.orderBy(F.desc("AnomalyScoreNormalized")).limit(6).collect()
    assert {r["record_id"] for r in top} == set(range(6))
    low, high = result.agg(F.min("AnomalyScoreNormalized"), F.max("AnomalyScoreNormalized")).first()
    assert low >= 0 and high <= 1
    assert all(r["Anomaly"] == 1 for r in top)


def test_contamination_and_partitions(spark):
    results = []
    for parts in (1, 6):
        _, df = points(spark, parts=parts)
        detector = detection.fit_detector(df, NAMES, contamination=0.1)
        rows = sorted(detector.predict(df).select("record_id", "Anomaly", F.round("AnomalyScore", 9)).collect())
        results.append([tuple(r) for r in rows])
        assert sum(r["Anomaly"] for r in rows) == 20
        assert all(0 < r[2] < 1 for r in rows)
    assert results[0] == results[1]


def test_attributions_add_up(spark):
    x, df = points(spark)
    forest = detection.fit_detector(df, NAMES).forest
    rows = df.select("record_id", forest.attributions().alias("a"), forest.score().alias("s")).collect()
    for row in rows:
        path = -np.log2(row["s"]) * forest_norm(forest)
        assert forest.base_path() - sum(row["a"]) == pytest.approx(path, abs=1e-6)


def forest_norm(forest):
    from vigilog.operators.isolation import average_path

    return average_path(forest.size)


def test_local_outlier_factor_is_exact(spark):
    x, df = points(spark, n=120)
    model = detection.fit_detector(df, NAMES, "lof").neighbours
    scaled = (x - x.mean(0)) / x.std(0)
    k = 12
    distances = np.sqrt(((scaled[:, None] - scaled[None]) ** 2).sum(2))
    own = distances + np.diag([np.inf] * len(x))
    order = np.argsort(own, axis=1)[:, :k]
    reach = np.take_along_axis(own, order, axis=1)[:, -1]

    def density(d, near):
        return 1 / (np.maximum(reach[near], np.take_along_axis(d, near, axis=1)).mean(1) + 1e-10)

    lrd = density(own, order)
    rows = df.select("record_id", F.array(*NAMES).alias("x"))
    training = {r["record_id"]: r["factor"] for r in model.training().collect()}
    assert np.allclose([training[i] for i in range(len(x))], lrd[order].mean(1) / lrd)
    novel = np.argsort(distances, axis=1)[:, :k]
    expected = lrd[novel].mean(1) / density(distances, novel)
    for scores in (model.scores(rows), model.own_scores()):
        found = {r["record_id"]: r["_neighbours"] for r in scores.collect()}
        assert np.allclose([found[i] for i in range(len(x))], expected)
    shown = {r["record_id"]: r["attributions"] for r in model.attributions(rows.filter("record_id < 3")).collect()}
    for i in range(3):
        for j in range(3):
            changed = scaled[i].copy()
            changed[j] = 0
            d = np.sqrt(((scaled - changed) ** 2).sum(1))
            near = np.argsort(d)[:k]
            fallen = lrd[near].mean() * (np.maximum(reach[near], d[near]).mean() + 1e-10)
            assert shown[i][j] == pytest.approx(expected[i] - fallen, abs=1e-6)


def test_equal_rows_count_as_many_neighbours(spark):
    data = [(i, 0.0, 0.0, 0.0) for i in range(30)] + [(30 + i, float(i), 1.0, 2.0) for i in range(20)]
    df = spark.createDataFrame(data, "record_id long, a double, b double, c double")
    model = detection.fit_detector(df, NAMES, "lof").neighbours
    factors = {r["record_id"]: r["factor"] for r in model.training().collect()}
    assert len(factors) == 50 and all(factors[i] == pytest.approx(1.0) for i in range(30))


def test_neighbours_over_many_leaves(spark, monkeypatch):
    """Every row finds most of its true neighbours, whatever the partitioning."""
    from vigilog.operators import neighbours

    monkeypatch.setattr(neighbours, "LEAF", 200)
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(8, 20)) * 6
    x = (centres[rng.integers(0, 8, 1500)] + rng.normal(size=(1500, 20)) * 0.5).round(6)
    lists = []
    for parts in (1, 5):
        df = stored(spark.createDataFrame([(i, r.tolist(), 1) for i, r in enumerate(x)], "id long, x array<double>, w long").repartition(parts))
        homes, levels = neighbours.divided(df, 20)
        assert levels and homes.groupBy("node").count().agg(F.max("count")).first()[0] <= 200 and homes.count() == 1500
        near = neighbours.compared(df, neighbours.probed(df, levels, 3), df, homes, 11)
        lists.append({r["id"]: [e["nb"] for e in r["near"]] for r in near.collect()})
    assert lists[0] == lists[1] and len(lists[0]) == 1500
    order = np.argsort(((x[:, None] - x[None]) ** 2).sum(2), axis=1)[:, :11]
    recall = np.mean([len(set(lists[0][i]) & set(order[i].tolist())) / 11 for i in range(1500)])
    assert recall >= 0.9


@pytest.mark.parametrize("latent,rows", [(4, 2600), (4, 6000), (20, 2600)])
def test_neighbours_are_true_beyond_one_leaf(spark, monkeypatch, latent, rows):
    """No groups that a leaf could match: normal rows, also of as many dimensions as columns."""
    from vigilog.operators import neighbours

    monkeypatch.setattr(neighbours, "LEAF", 256)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(rows, latent)) @ rng.normal(size=(latent, 20)) + rng.normal(size=(rows, 20)) * 0.01
    df = stored(spark.createDataFrame([(i, r.tolist(), 1) for i, r in enumerate(x)], "id long, x array<double>, w long"))
    graph = neighbours.searched(df, 20, 21)
    found = {r["id"]: {e["nb"] for e in r["near"][:21]} for r in graph.near.collect()}
    sample = range(0, rows, 13)
    order = [np.argsort(((x - x[i]) ** 2).sum(1))[:21].tolist() for i in sample]
    share = np.mean([len(found[i] & set(own)) / 21 for i, own in zip(sample, order, strict=True)])
    assert share >= 0.85 and len(found) == rows and graph.recall >= 0.9


def test_refining_the_graph_finds_what_cells_cut_off(spark, monkeypatch):
    from vigilog.operators import neighbours

    monkeypatch.setattr(neighbours, "LEAF", 128)
    x = np.random.default_rng(4).normal(size=(3000, 3))
    df = stored(spark.createDataFrame([(i, r.tolist(), 1) for i, r in enumerate(x)], "id long, x array<double>, w long"))
    homes, levels = neighbours.divided(df, 3)
    edges = neighbours.true_edges(df, 11)
    asked = neighbours.probed(df, levels, 2).select("id", "node")
    near = stored(neighbours.compared(df, asked.join(homes, ["id", "node"]).unionByName(asked.filter("id % 3 = 0")).distinct(), df, homes, 11))
    before, after = neighbours.recall(edges, near), neighbours.recall(edges, neighbours.refined(df, homes, near, 11))
    assert before < 0.95 and after > before + (1 - before) / 3


@pytest.mark.parametrize("algorithm", detection.ALGORITHMS)
def test_saved_detector_predicts_the_same(spark, tmp_path, algorithm):
    _, df = points(spark, n=40)
    detector = detection.fit_detector(df, NAMES, algorithm)
    assert (detector.small_cut is not None) == (algorithm != "lof")
    detector.save(spark, str(tmp_path / "m"))
    again = detection.load_detector(spark, str(tmp_path / "m"))
    assert sorted(map(tuple, detector.predict(df).collect())) == sorted(map(tuple, again.predict(df).collect()))


def test_metrics_row(spark):
    _, df = points(spark)
    detector = detection.fit_detector(df, NAMES)
    row = detector.metrics(detector.predict(df)).first()
    assert (row["n_samples"], row["n_features"], row["n_anomalies"]) == (200, 3, 20)


@pytest.mark.parametrize("rows,share", [(1, 0.3), (9, 0.3), (10, 0.2), (49, 0.2), (50, 0.15), (99, 0.15), (100, 0.1)])
def test_effective_contamination(rows, share):
    assert verdicts.effective_contamination(rows) == pytest.approx(share)
    assert verdicts.effective_contamination(rows, adaptive=False) == 0.1


@pytest.mark.parametrize("score,raised,level", [
    (0.81, 1, 3), (0.8, 1, 2), (0.61, 1, 2), (0.6, 1, 1), (0.1, 1, 1),
    (0.19, 0, 3), (0.2, 0, 2), (0.39, 0, 2), (0.4, 0, 1), (0.9, 0, 1),
])
def test_confidence(spark, score, raised, level):
    assert spark.range(1).select(verdicts.confidence(F.lit(score), F.lit(raised))).first()[0] == level


def test_clusters_find_separate_groups(spark):
    draw = np.random.default_rng(5)
    groups = np.concatenate([draw.normal(c, 0.05, size=(n, 6)) for c, n in ((0.0, 60), (4.0, 40), (-5.0, 25))])
    copies = np.repeat(groups[:1], 200, axis=0)
    noise = np.array([[30.0, -20, 9, 4, -8, 2]])
    x = np.concatenate([groups, copies, noise])
    names = [f"f{i}" for i in range(6)]
    df = stored(spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "record_id long, " + ", ".join(f"{n} double" for n in names)))
    found = {r["record_id"]: r["Cluster"] for r in clusters.density_clusters(df, names).collect()}
    assert len(found) == len(x)
    first, second, third = ({found[i] for i in part} for part in (range(60), range(60, 100), range(100, 125)))
    assert found[len(x) - 1] == clusters.NOISE
    assert {found[i] for i in range(125, 325)} <= first
    assert not first & second and not second & third and not first & third


def test_groups_in_many_dimensions(spark):
    """Eight groups that only all 20 features keep apart."""
    draw = np.random.default_rng(12)
    centres = draw.normal(size=(8, 20)) * 4
    group = draw.integers(0, 8, 2000)
    x = centres[group] + draw.normal(size=(2000, 20))
    names = [f"f{i}" for i in range(20)]
    df = stored(spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "record_id long, " + ", ".join(f"{n} double" for n in names)))
    found = {r["record_id"]: r["Cluster"] for r in clusters.density_clusters(df, names).collect()}
    pairs = {(int(group[i]), c) for i, c in found.items() if c != clusters.NOISE}
    assert len(pairs) == 8 and len({c for _, c in pairs}) == 8
    assert sum(c == clusters.NOISE for c in found.values()) < 100


def test_components_match_brute_force(spark):
    from vigilog.operators.components import components

    draw = np.random.default_rng(11)
    pairs = [(int(a), int(b)) for a, b in draw.integers(0, 30, size=(20, 2))] + [(i, i + 1) for i in range(95, 105)] + [(200, i) for i in range(201, 230)]
    label = {n: n for pair in pairs for n in pair}
    for _ in label:
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    expected = {n: c for n, c in label.items() if any(a != b for a, b in pairs if n in (a, b))}
    assert {r["node"]: r["component"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()} == expected


def links_of(x, k):
    """The mutual links of the k nearest rows, weighted by distance."""
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    return sorted({(min(i, j), max(i, j)): float(d[i, j]) for i in range(len(x)) for j in np.argsort(d[i])[1 : k + 1].tolist()}.items())


@pytest.mark.parametrize("most", [40, 10**6])
def test_spanning_forest_is_the_one_of_sorted_links(spark, most):
    from vigilog.operators.hierarchy import spanning_forest

    x = np.random.default_rng(3).normal(size=(150, 2)).round(1) + np.repeat([[0, 0], [50, 0], [0, 90]], 50, axis=0)
    links = links_of(x, 4)
    above, expected = list(range(150)), set()

    def top(i):
        return i if above[i] == i else top(above[i])

    for (a, b), w in sorted(links, key=lambda e: (e[1], *e[0])):
        if top(a) != top(b):
            above[top(a)] = top(b)
            expected.add((a, b, w))
    df = spark.createDataFrame([(a, b, w) for (a, b), w in links], "a long, b long, w double")
    assert {tuple(r) for r in spanning_forest(df, most).collect()} == expected


def lattice(seed, rows=600):
    """Points in three far groups with links, cells along the first axis (some points have none), and the forest by sorted links."""
    x = np.random.default_rng(seed).normal(size=(rows, 2)).round(1) + np.repeat([[0, 0], [50, 0], [0, 90]], rows // 3, axis=0)
    links = links_of(x, 6)
    cells = [(i, int(c)) for i, c in enumerate(x[:, 0] * 2) if i % 11]
    above, forest = list(range(rows)), set()

    def top(i):
        while above[i] != i:
            i = above[i]
        return i

    for (a, b), w in sorted(links, key=lambda e: (e[1], *e[0])):
        if top(a) != top(b):
            above[top(a)] = top(b)
            forest.add((a, b, w))
    whole = {i: min(j for j in range(rows) if top(j) == top(i)) for i in range(rows)}
    return links, cells, forest, whole


@pytest.mark.parametrize("ends,most,large", [(100, 200, 10**6), (400, 600, 10**6), (100, 200, 150), (400, 30, 10**6)])
def test_forest_by_chunks_of_cells_is_the_one_of_sorted_links(spark, monkeypatch, ends, most, large):
    """Also with cells that hold too many links for a chunk, and where Boruvka rounds follow."""
    from vigilog.operators import hierarchy

    links, cells, expected, _ = lattice(ends + most)
    monkeypatch.setattr(hierarchy, "ENDS", ends)
    monkeypatch.setattr(hierarchy, "LINKS", large)
    df = spark.createDataFrame([(a, b, w) for (a, b), w in links], "a long, b long, w double")
    places = spark.createDataFrame(cells, "id long, node long")
    assert {tuple(r) for r in hierarchy.spanning_forest(df, most, places).collect()} == expected


def test_cells_spare_rounds_over_all_links(spark, monkeypatch):
    from vigilog.operators import hierarchy

    def fails(*_):
        raise AssertionError("components of all links")

    links, _, expected, _ = lattice(8)
    monkeypatch.setattr(hierarchy, "ENDS", 2500)
    monkeypatch.setattr(hierarchy, "components", fails)
    df = spark.createDataFrame([(a, b, w) for (a, b), w in links], "a long, b long, w double")
    places = spark.createDataFrame([(i, i // 200) for i in range(600)], "id long, node long")
    assert {tuple(r) for r in hierarchy.spanning_forest(df, 700, places).collect()} == expected


@pytest.mark.parametrize("ends,most", [(60, 300), (300, 500)])
def test_trees_by_chunks_of_cells(spark, monkeypatch, ends, most):
    from vigilog.operators import hierarchy

    _, cells, forest, whole = lattice(5)
    monkeypatch.setattr(hierarchy, "ENDS", ends)
    monkeypatch.setattr(hierarchy, "LINKS", most)
    df = spark.createDataFrame(list(forest), "a long, b long, w double")
    rows = hierarchy.trees(df, len(forest), spark.createDataFrame(cells, "id long, node long")).collect()
    assert len(rows) == len({r["node"] for r in rows})
    assert {r["node"]: r["component"] for r in rows} == {i: t for i, t in whole.items() if any(i in (a, b) for a, b, _ in forest)}


def test_one_tree_grows_the_forest_once(spark, monkeypatch):
    """Groups far from each other, in pairs, need two rounds of bridges; the forest is that of all links."""
    from vigilog.operators import hierarchy

    draw = np.random.default_rng(4)
    x = np.concatenate([draw.normal((c, d), 0.1, size=(30, 2)) for c, d in ((0, 0), (5, 0), (900, 0), (905, 0), (0, 3000))])
    points = stored(spark.createDataFrame([(i, r.tolist(), 1) for i, r in enumerate(x)], "id long, x array<double>, w long"))
    core = stored(spark.createDataFrame([(i, 0.0) for i in range(len(x))], "id long, core double"))
    links = spark.createDataFrame([(a, b, w) for (a, b), w in links_of(x, 8)], "a long, b long, w double")
    forest, grown = hierarchy.spanning_forest(links), []
    monkeypatch.setattr(clusters.hierarchy, "spanning_forest", lambda f, *a, g=hierarchy.spanning_forest, **k: grown.append(f) or g(f, *a, **k))
    whole = clusters._one_tree(points, 2, core, forest, points.selectExpr("id", "id div 40 AS node"))
    assert len(grown) == 1 and whole.count() == len(x) - 1
    assert hierarchy.trees(whole, len(x) - 1).select("component").distinct().count() == 1
    assert {tuple(r) for r in forest.collect()} <= {tuple(r) for r in whole.collect()}


def test_one_tree_ends_where_ids_repeat(spark):
    draw = np.random.default_rng(6)
    x = np.concatenate([draw.normal(c, 0.1, size=(30, 2)) for c in (0.0, 50.0)])
    rows = [(i, r.tolist(), 1) for i, r in enumerate(x)] + [(3, [0.5, 0.5], 1), (40, [49.5, 50.5], 1)]
    points = stored(spark.createDataFrame(rows, "id long, x array<double>, w long"))
    core = stored(spark.createDataFrame([(i, 0.0) for i in range(60)], "id long, core double"))
    forest = stored(spark.createDataFrame([(a, b, w) for (a, b), w in links_of(x, 40) if b == a + 1], "a long, b long, w double").filter("a <> 29"))
    assert clusters._one_tree(points, 2, core, forest, points.selectExpr("id", "0L AS node")).count() == 59


def chosen_clusters(links, weights, smallest):
    """The hierarchy from the top: groups are parted at their longest link, again and again."""

    def groups(nodes, own):
        left, found = set(nodes), []
        while left:
            some, open_ = set(), [min(left)]
            while open_:
                n = open_.pop()
                if n not in some:
                    some.add(n)
                    open_ += [b if a == n else a for (a, b), _ in own if n in (a, b)]
            found.append(some)
            left -= some
        return found

    def rows(nodes):
        return sum(weights[n] for n in nodes)

    def best(nodes, born, top):
        """(how long the best clusters last in all, the clusters)"""
        own = sorted([e for e in links if e[0][0] in nodes], key=lambda e: (e[1], *e[0]))
        held, lasts, below = set(nodes), 0.0, (0.0, [])
        while True:
            if not own:  # one point, of many equal rows
                break
            density = 1 / own.pop()[1]
            parts = [g for g in groups(held, [e for e in own if e[0][0] in held and e[0][1] in held])]
            large = [g for g in parts if rows(g) >= smallest]
            last = {n for g in parts if g not in large for n in g} if large else held
            lasts += rows(last) * (density - born)
            if len(large) != 1:
                if large:
                    lasts += sum(rows(g) for g in large) * (density - born)
                    found = [best(g, density, False) for g in large]
                    below = sum(f[0] for f in found), [c for f in found for c in f[1]]
                break
            held = large[0]
            own = [e for e in own if e[0][0] in held and e[0][1] in held]
            if not own:
                break
        return (lasts, [nodes]) if not top and lasts >= below[0] else below

    trees = [g for g in groups(range(len(weights)), links) if rows(g) >= smallest]
    return {frozenset(c) for g in trees for c in best(g, 0.0, len(trees) == 1)[1]}


@pytest.mark.parametrize("chunk", [17, 10**6])
@pytest.mark.parametrize("seed", [1, 2])
def test_hierarchy_is_the_one_from_the_top(spark, monkeypatch, chunk, seed):
    from vigilog.operators import hierarchy

    draw = np.random.default_rng(seed)
    x = np.concatenate([draw.normal(c, s, size=(n, 2)) for c, s, n in (((0, 0), 0.1, 25), ((1, 0), 0.1, 20), ((9, 9), 1.5, 30), ((20, 0), 0.5, 12), ((90, 0), 1, 3))])
    if seed == 2:
        x = x[:75]
    weights = [1 + (i % 7 == 0) for i in range(len(x))]
    points = stored(spark.createDataFrame(list(enumerate(weights)), "id long, w long"))
    forest = hierarchy.spanning_forest(spark.createDataFrame([(a, b, w) for (a, b), w in links_of(x, 6 if seed == 1 else 40)], "a long, b long, w double"))
    monkeypatch.setattr(hierarchy, "LINKS", chunk)
    rows = hierarchy.density_hierarchy(points, forest, 5).collect()
    found = {}
    for r in rows:
        if r["cluster"] is not None:
            found.setdefault(r["cluster"], set()).add(r["id"])
    links = [((r["a"], r["b"]), r["w"]) for r in forest.collect()]
    assert len(rows) == len(x) and {frozenset(c) for c in found.values()} == chosen_clusters(links, weights, 5)


def test_dense_and_thin_groups_side_by_side(spark):
    """Groups whose densities are as 1 to 10 in each direction, two dense ones close together."""
    draw = np.random.default_rng(9)
    dense = [draw.normal(c, 0.1, size=(150, 4)) for c in (0.0, 1.5)]
    thin = draw.normal(20.0, 1.0, size=(150, 4))
    x = np.concatenate([*dense, thin])
    names = [f"f{i}" for i in range(4)]
    df = stored(spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "record_id long, " + ", ".join(f"{n} double" for n in names)))
    found = {r["record_id"]: r["Cluster"] for r in clusters.density_clusters(df, names, 15).collect()}
    main = [max(set(own), key=own.count) for own in ([found[i] for i in part] for part in (range(150), range(150, 300), range(300, 450)))]
    assert len(set(main)) == 3 and clusters.NOISE not in main
    for label, part in zip(main, (range(150), range(150, 300), range(300, 450)), strict=True):
        assert sum(found[i] == label for i in part) >= 120


def test_few_anomalies_get_patterns(spark):
    df = spark.createDataFrame([(1, 4625, "Security", 1, 1.0)], "record_id long, EventID long, Channel string, IsFailedLogin int, x double")
    row = clusters.grouped_anomalies(df, ["x"]).first()
    assert (row["Cluster"], row["ClusterLabel"]) == (1, "Brute Force Attack")


def test_supervised_round_trip(spark, tmp_path):
    draw = np.random.default_rng(2)
    data = []
    for i in range(160):
        bad = i % 4 == 0
        kind = ("brute_force" if i % 8 == 0 else "persistence") if bad else "normal"
        data.append((i, "anomaly" if bad else "normal", kind, float(draw.normal(6 if bad else 0)), float(draw.normal(5 if kind == "persistence" else 0))))
    samples = spark.createDataFrame(data, "id long, label string, attack_type string, x double, y double")
    detector, tested, metrics = supervised.train_from_samples(samples, ["x", "y"])
    assert metrics.first()["accuracy"] > 0.9
    assert detector.importances()[0][0] in ("x", "y")
    detector.save(spark, str(tmp_path / "s"))
    again = supervised.load_supervised(spark, str(tmp_path / "s"))
    new = samples.drop("label", "attack_type")
    order = ["id", *supervised.RESULTS]
    assert sorted(map(tuple, detector.predict(new).select(order).collect())) == sorted(map(tuple, again.predict(new).select(order).collect()))
    assert {r["AttackType"] for r in detector.predict(new).filter("Anomaly = 1").collect()} == {"brute_force", "persistence"}


def test_rows_of_the_fit_are_scored_without_a_search(spark, monkeypatch):
    from pyspark.sql import functions as F

    from vigilog.operators import neighbours

    x = np.random.default_rng(5).normal(size=(300, 4)).round(1)
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "record_id long, a double, b double, c double, d double")
    model = neighbours.fit_local_outliers(df, ["a", "b", "c", "d"])
    rows = df.select(F.col("record_id") + 1000, F.array("a", "b", "c", "d")).toDF("record_id", "x")
    own = {r[0] + 1000: r[1] for r in model.own_scores().collect()}
    points = []
    factors = neighbours.LocalOutliers._factors
    monkeypatch.setattr(neighbours.LocalOutliers, "_factors", lambda self, p: points.append(p.count()) or factors(self, p))
    assert {r[0]: r[1] for r in model.scores(rows).collect()} == own and not points
    new = rows.unionAll(spark.createDataFrame([(1, [9.0, 9.0, 9.0, 9.0]), (2, [9.0, 9.0, 9.0, 9.0])], "record_id long, x array<double>"))
    scores = {r[0]: r[1] for r in model.scores(new).collect()}
    assert points == [1] and len(scores) == 302
    assert scores[1] == scores[2] > 2 and all(scores[i] == s for i, s in own.items())


def test_searched_rows_score_like_the_fit(spark):
    from vigilog.operators import neighbours

    x = np.random.default_rng(6).normal(size=(400, 3))[np.r_[:400, :60]]
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "record_id long, a double, b double, c double")
    model = neighbours.fit_local_outliers(df, ["a", "b", "c"])
    found = {r["id"]: r["factor"] for r in model._factors(model.reference.select("id", "x", "w")).collect()}
    own = {r["id"]: r["own"] for r in model.reference.collect()}
    assert found.keys() == own.keys()
    assert all(abs(found[i] - own[i]) < 1e-9 * own[i] for i in own)


def test_walks_are_bounded_and_add_up_as_one_by_one():
    from vigilog.operators import isolation

    draw = np.random.default_rng(5)
    x = draw.normal(size=(300, 7))
    nodes = [(t, *n) for t in range(40) for n in isolation.grow(x[draw.choice(300, 64)], np.arange(7), 6, np.random.default_rng(t))]
    layout = isolation.Layout.of(pd.DataFrame(nodes, columns=["tree", "node", "feature", "threshold", "path", "samples"]), 64)
    result, before = np.zeros(x.shape), None
    for node, feature in layout.walk(x):
        path = layout.path[np.arange(40), node]
        if feature is not None:
            np.add.at(result, (np.arange(300)[:, None], feature), before - path)
        before = path
    assert (layout.attribute(x) == result / 40).all()
    assert (layout.score(x) == 2.0 ** (-before.mean(axis=1) / layout.norm)).all()
    assert isolation.CHUNK * 200 * 8 <= 1 << 18  # one number for each row and tree


@pytest.mark.parametrize("algorithm", detection.ALGORITHMS)
def test_the_feature_array_is_stored_in_a_narrow_table(spark, monkeypatch, algorithm):
    _, df = points(spark)
    tables, stored = [], detection.stored
    monkeypatch.setattr(detection, "stored", lambda t: tables.append(t.columns) or stored(t))
    found = detection.fit_predict(df, NAMES, algorithm)[1]
    assert found.count() == df.count() and set(df.columns) < set(found.columns) and "_x" not in found.columns
    assert all(len(c) == 2 for c in tables if "_x" in c)


def test_both_classifiers_are_fitted_at_the_same_time(spark, monkeypatch):
    import threading

    _, df = points(spark, 120, 40)
    kind = F.when(F.col("record_id") >= 40, "normal").when(F.col("record_id") < 20, "x").otherwise("y")
    label = F.when(F.col("record_id") < 40, "anomaly").otherwise("normal")
    rows = df.select(F.col("record_id").alias("id"), *NAMES, label.alias("label"), kind.alias("attack_type"))
    both, made = threading.Barrier(2, timeout=60), supervised.classifier
    monkeypatch.setattr(supervised, "classifier", lambda *a, **k: both.wait() >= 0 and made(*a, **k))
    detector = supervised.fit_supervised(supervised.labelled_frame(rows, NAMES), NAMES)
    assert detector.attack is not None and len(detector.anomaly.stages) == 3


def test_training_rows_lie_in_a_partition_per_core(spark, monkeypatch):
    monkeypatch.setattr(supervised, "PARTITION_ROWS", 10)
    rows = spark.range(1000).repartition(40).withColumn("Label", (F.col("id") % 2).cast("int"))
    assert supervised.balanced(rows, "Label").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    monkeypatch.setattr(supervised, "MOST_ROWS", 50)
    assert supervised.balanced(rows, "Label").rdd.getNumPartitions() == 20


def test_cells_are_found_by_tasks_that_hold_all_centres(spark, monkeypatch):
    from vigilog.operators import neighbours

    monkeypatch.setattr(neighbours, "LEAF", 32)
    monkeypatch.setattr(neighbours, "CENTRES", 6)
    x = np.random.default_rng(2).normal(size=(700, 4))
    points = stored(spark.createDataFrame([(i, row.tolist(), 1) for i, row in enumerate(x)], "id long, x array<double>, w long"))

    def cells():
        homes, levels = neighbours.divided(points, 4)
        own = {(r["id"], r["node"]) for r in homes.collect()}
        near = {(r["id"], r["node"]) for r in neighbours.probed(points, levels, 3, 4, homes).collect()}
        known = {(r["id"], r["node"], tuple(r["x"]), r["w"]) for r in neighbours.at_home(points, levels, 4, homes).collect()}
        return len(levels), own, near, known

    held = cells()
    assert held[0] > 2 and held[1] < held[2] and len(held[2]) >= 2100 and {k[:2] for k in held[3]} == held[1]
    sent = neighbours._descended
    monkeypatch.setattr(neighbours, "_descended", None)
    assert cells() == held  # no point is sent
    monkeypatch.setattr(neighbours, "_descended", sent)
    monkeypatch.setattr(neighbours, "HELD", 0)
    assert cells() == held  # the same cells if points are sent


def test_points_with_equal_ids_are_joined_as_before(spark):
    from vigilog.operators import neighbours

    points = stored(spark.createDataFrame([(1, [0.0], 1), (1, [1.0], 1), (2, [2.0], 1)], "id long, x array<double>, w long"))
    assert neighbours._held(points, [], 1) is None and neighbours._held(points.filter("id = 2"), [], 1) == []
    assert sorted(r["id"] for r in neighbours.at_home(points, [], 1, points.select("id", F.lit(0).alias("node"))).collect()) == [1] * 4 + [2]


def test_variants_of_a_row_are_neither_stored_nor_sent(spark, monkeypatch):
    """A row is stored once for each region that it needs, not once for each feature; the values are those of a search of every variant."""
    from vigilog.operators import neighbours, regions, variants

    monkeypatch.setattr(neighbours, "LEAF", 100)
    monkeypatch.setattr(neighbours, "CENTRES", 6)
    draw = np.random.default_rng(3)
    x = draw.normal(size=(1150, 5))[np.r_[:1150, :70]]
    df = spark.createDataFrame([(i, *map(float, row)) for i, row in enumerate(x)], "record_id long, a double, b double, c double, d double, e double")
    model = neighbours.fit_local_outliers(df, list("abcde"))
    some = df.filter("record_id % 9 = 0").select("record_id", F.array(*"abcde").alias("x"))
    some = stored(some.unionAll(spark.createDataFrame([(9999, [9.0] * 5)], some.schema)))
    expected = {r["record_id"]: r["attributions"] for r in model._searched_attributions(some).collect()}
    sizes = []
    for module in (neighbours, variants):
        monkeypatch.setattr(module, "stored", lambda rows: sizes.append((t := stored(rows)).count()) or t)
    for leaf, region in ((100, 65536), (100, 300), (1, 1)):
        monkeypatch.setattr(neighbours, "LEAF", leaf)
        monkeypatch.setattr(regions, "REGION", region)
        sizes.clear()
        found = {r["record_id"]: r["attributions"] for r in model.attributions(some).collect()}
        assert found.keys() == expected.keys() and len(found) == 137
        assert all(np.allclose(found[i], expected[i], rtol=0, atol=1e-9) for i in found)
        assert region == 1 or max(sizes) < 137 * 5


def test_regions_hold_every_cell_once_and_the_nearest_ones_around():
    from vigilog.operators import regions

    draw = np.random.default_rng(1)
    nodes, sizes, centres = np.arange(5, 405), draw.integers(1, 50, 400), draw.normal(size=(400, 3))
    plan = regions.regions_of(nodes, sizes, centres, 800)
    held = np.bincount(plan.region, sizes)
    assert plan.count > 8 and held.max() <= 800 and (plan.cell(nodes) == np.arange(400)).all() and plan.cell(np.array([3, 900])).max() == -1
    region, cell = np.divmod(plan.held, 400)
    assert np.bincount(region, sizes[cell]).max() <= 1600 and plan.holds(plan.region, np.arange(400)).all()
    own = np.flatnonzero(plan.region == 0)
    gaps = ((centres[:, None] - centres[own]) ** 2).sum(2).min(1)
    around = np.setdiff1d(cell[region == 0], own)
    assert len(around) and gaps[around].max() < gaps[np.setdiff1d(np.arange(400), cell[region == 0])].min()


def test_lists_by_regions_are_those_of_cells(spark, monkeypatch):
    """A point is sent to a region once, whatever its cells; the factors are those of lists that were joined."""
    from vigilog.operators import neighbours, region_lists, regions

    monkeypatch.setattr(neighbours, "LEAF", 100)
    monkeypatch.setattr(neighbours, "CENTRES", 6)
    x = np.random.default_rng(3).normal(size=(1200, 5))[np.r_[:1200, :80, :80]]
    df = spark.createDataFrame([(i * 3, *map(float, row)) for i, row in enumerate(x)], "record_id long, a double, b double, c double, d double, e double")
    homes, levels = neighbours.divided(points := neighbours.points_of(stored(df.select("record_id", F.array(*"abcde").alias("x"))))[0], 5)
    joined = neighbours.compared(points, neighbours.probed(points, levels, 3, 5, homes), points, neighbours.at_home(points, levels, 5, homes), 11)
    expected = {r["id"]: [tuple(e) for e in r["near"]] for r in joined.collect()}
    factors = {r["id"]: tuple(r) for r in neighbours._factors_by_joins(stored(joined), 10).collect()}
    held = neighbours._held(points, levels, 5)
    for region, asked, block in ((65536, 65536, 4096), (300, 65536, 64), (300, 40, 4096)):
        monkeypatch.setattr(regions, "REGION", region)
        monkeypatch.setattr(region_lists, "ASKED", asked)
        monkeypatch.setattr(region_lists, "BLOCK", block)
        near = region_lists.lists_of(points, homes, held, 3, 11, True, 5)
        assert near.select("region").distinct().count() > 1
        assert {r["id"]: [tuple(e) for e in r["near"]] for r in near.collect()} == expected
        found = {r["id"]: tuple(r) for r in region_lists.factors_of(near, 10).collect()}
        assert found.keys() == factors.keys() and len(found) == 1200
        assert all(np.allclose(found[i], factors[i], rtol=1e-12) for i in found)


def test_local_outlier_fit_joins_no_entries_of_lists(spark, monkeypatch):
    from vigilog.operators import neighbours

    monkeypatch.setattr(neighbours, "_factors_by_joins", None)
    monkeypatch.setattr(neighbours, "compared", None)
    _, df = points(spark)
    detector, found = detection.fit_predict(stored(df), NAMES, "lof")
    assert found.count() == 200 and detector.neighbours.reference.count() == 200
    again = {r["record_id"]: r["AnomalyScore"] for r in detector.predict(df).collect()}
    assert {r["record_id"]: r["AnomalyScore"] for r in found.collect()} == again


def test_feature_columns_reach_python_as_they_are(spark):
    from vigilog.operators.scaling import matrix_row, matrix_rows

    rows = [(1, 1.0, 2), (2, None, 3), (3, float("nan"), None), (None, float("inf"), -1), (5, float("-inf"), 0)]
    df = spark.createDataFrame(rows, "record_id long, a double, b int")
    expected = {(r[0], tuple(r[1])) for r in df.select("record_id", matrix_row(["a", "b"])).collect()}
    assert {(r[0], tuple(r[1])) for r in matrix_rows(df, ["a", "b"]).collect()} == expected
    table = spark.createDataFrame([(i, float(i % 13), i % 7) for i in range(120)], df.schema)
    forest = detection.fit_detector(table, ["a", "b"]).forest
    both = df.select(forest.score().alias("a"), forest.score(matrix_row(["a", "b"])).alias("b")).collect()
    assert all(r["a"] == r["b"] for r in both)


def test_tables_of_a_fit_are_deleted_when_nothing_reads_them(spark):
    from vigilog import session
    from vigilog.operators import neighbours

    kept, gone = stored(spark.range(5)), stored(spark.range(6))
    session.discard(gone)
    tables = session._stored[spark.sparkContext.applicationId]
    assert kept.count() == 5 and gone.inputFiles()[0].rsplit("/", 2)[-2] not in {t.rsplit("/", 1)[-1] for t in tables}
    before = len(tables)
    _, df = points(spark)
    model = neighbours.fit_local_outliers(df, NAMES)
    columns = [set(spark.read.parquet(t).columns) for t in tables[before:]]
    assert not any({"near"} <= c or {"_a", "_b"} <= c for c in columns)
    assert model.own_scores().count() == model.reference.count() == 200
