import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lupa import vocab as v
from lupa.ml import evaluate, iforest, prep, surrogate

COLUMNS = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def points(spark):
    """3000 ordinary rows and 20 far away in several columns, with a category index."""
    rng = np.random.default_rng(5)
    frame = pd.DataFrame(rng.normal(size=(3020, 4)), columns=COLUMNS)
    frame.loc[3000:, ["a", "b", "c"]] += 9
    frame["cat_index"] = rng.integers(0, 3, 3020).astype(float)
    frame["id"] = np.arange(3020)
    return spark.createDataFrame(frame).cache()


FEATURES = iforest.features(COLUMNS, {"cat_index": 2})


@pytest.fixture(scope="module")
def forest(points):
    return iforest.fit(points, FEATURES, ["id"], trees=50, psi=128)


def scores(df, forest):
    return {r["id"]: r["score"] for r in iforest.score(df, forest).select("id", "score").collect()}


def test_forest_shape(forest):
    nodes = forest.nodes.toPandas()
    assert set(nodes["tree"]) == set(range(50))
    roots = nodes[nodes["node"] == 0]
    assert (roots["size"] == 128).all() and nodes["depth"].max() <= 7
    for _, tree in nodes.groupby("tree"):
        by_id = tree.set_index("node")
        inner = by_id[by_id["feature"] >= 0]
        assert (by_id.loc[inner["left"], "size"].to_numpy() + by_id.loc[inner["right"], "size"].to_numpy()
                == inner["size"].to_numpy()).all()


def test_scores_do_not_depend_on_partitioning(points, forest):
    again = iforest.fit(points.repartition(7, "a"), FEATURES, ["id"], trees=50, psi=128)
    assert scores(points, forest) == scores(points.repartition(3), again)
    other = iforest.fit(points, FEATURES, ["id"], trees=50, psi=128, seed=7)
    assert scores(points, other) != scores(points, forest)


def test_planted_rows_are_flagged(points, forest):
    scored = iforest.score(points, forest).cache()
    limit = iforest.threshold(scored, 0.1)
    flagged = iforest.flag(scored, limit)
    total = iforest.outlier_total(flagged).first()
    assert 0.09 * 3020 <= total["outliers"] <= 0.1 * 3020
    assert flagged.where("id >= 3000 AND outliers = 1").count() == 0
    sketch = iforest.threshold(scored, 0.1, accuracy=10_000)
    assert abs(sketch - limit) < 1e-3


def test_path_lengths_match_a_walk_over_the_nodes(points, forest):
    nodes = forest.nodes.toPandas().set_index(["tree", "node"])
    rows = points.limit(5).toPandas()
    x = iforest._matrix(rows, FEATURES)
    expected = []
    for i in range(len(rows)):
        total = 0.0
        for tree in range(50):
            node = nodes.loc[(tree, 0)]
            while node["feature"] >= 0:
                side = "right" if x[int(node["feature"]), i] > node["threshold"] else "left"
                node = nodes.loc[(tree, int(node[side]))]
            total += node["depth"] + float(iforest.average_path(np.array([node["size"]]))[0])
        expected.append(2 ** (-total / 50 / float(iforest.average_path(np.array([128]))[0])))
    got = scores(points, forest)
    assert np.allclose([got[i] for i in rows["id"]], expected)


def test_many_copies_and_many_rows(spark):
    """A third of the rows are copies of one row; sampling takes the path for large data."""
    df = spark.range(9000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("id"),
        F.when(F.col("id") % 3 == 0, 1.0).otherwise(F.sin(F.col("id").cast("double"))).alias("a"),
    )
    chosen = iforest.tree_samples(df, ["a"], ["id"], trees=10, psi=32, seed=1).toPandas()
    assert (chosen.groupby("tree").size() == 32).all()
    assert not chosen.duplicated(["id", "a", "tree"]).any()


@pytest.mark.parametrize("equal", [True, False])
def test_a_frequent_key_keeps_its_density(spark, equal):
    """A third of the rows have one key, as copies or with values of their own."""
    hot = F.col("id") % 3 == 0
    value = F.lit(5.0) if equal else 5.0 + F.col("id") / 90000
    df = spark.range(9000).select(
        F.when(hot, 0).otherwise(F.col("id")).alias("id"),
        F.when(hot, value).otherwise(F.sin(F.col("id").cast("double"))).alias("a"),
    )
    forest = iforest.fit(df, iforest.features(["a"]), ["id"], trees=20, psi=64, seed=1)
    nodes = forest.nodes.toPandas().set_index(["tree", "node"])
    apart = nodes[(nodes["threshold"] >= 1) & (nodes["threshold"] < 5)]  # frequent rows go right
    held = [nodes.loc[(tree, right), "size"] for (tree, _), right in apart["right"].items()]
    assert len(held) >= 18 and 0.28 < np.mean(held) / 64 < 0.39
    chosen = iforest.row_samples(df, ["a"], ["id"], trees=20, psi=64, seed=1).toPandas()
    assert (chosen.groupby("tree").size() == 64).all()
    shares = (chosen["id"] == 0).groupby(chosen["tree"]).mean()
    assert 0.28 < shares.mean() < 0.39 and shares.min() > 0.1 and shares.max() < 0.6
    again = iforest.row_samples(df.repartition(7, "a"), ["a"], ["id"], trees=20, psi=64, seed=1).toPandas()
    order = ["tree", "_place"]
    assert chosen.sort_values(order)["a"].tolist() == again.sort_values(order)["a"].tolist()


def test_few_rows_and_constant_columns(spark):
    df = spark.createDataFrame([(1, 2.0), (2, 2.0), (3, 2.0)], "id int, a double")
    forest = iforest.fit(df, iforest.features(["a"]), ["id"], trees=4, psi=8)
    scored = iforest.score(df, forest)
    assert scored.select("score").distinct().count() == 1
    limit = iforest.threshold(scored)
    assert iforest.flag(scored, limit).where("outliers = -1").count() == 0


def test_scoring_is_the_only_python_step(points, forest):
    plan = iforest.score(points, forest)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "Exchange" not in plan


def model_rows(spark):
    base = {name: 0.0 for name in v.NUMERIC} | {name: 0 for name in v.PASS_THROUGH}
    texts = [("Tarde", "A", "x", "A", "x"), ("Noche", "B", "y", "A", "y"), ("Tarde", "C", None, None, "x")]
    return spark.createDataFrame([
        {**base, **dict(zip(v.TEXT, t)), "dhdr_mnt_total": float(i), "emis_Alerta_52": None if i else 1, "dhdr_folio": i}
        for i, t in enumerate(texts)
    ])


def test_imputation(spark):
    df = prep.imputed(model_rows(spark))
    nulls = df.select(*(F.count_if(F.col(c).isNull()).alias(c) for c in df.columns)).first().asDict()
    assert set(nulls.values()) == {0}
    assert df.where(F.col("emis_INICIO_SEGMENTO") == v.UNKNOWN).count() == 0
    assert df.where(F.col("recep_INICIO_SEGMENTO") == v.UNKNOWN).count() == 1


def test_encoding_drops_the_first_level_and_zeroes_unseen_ones(spark):
    df = prep.imputed(model_rows(spark))
    encoder = prep.fit_encoder(df)
    assert encoder.labels["emis_INICIO_SEGMENTO"] == ["C", "B", "A"]
    assert {"emis_INICIO_SEGMENTO_B", "emis_INICIO_SEGMENTO_C"} <= set(encoder.names)
    assert "emis_INICIO_SEGMENTO_A" not in encoder.names
    totals = {(r[0], r[1]): r[2] for r in prep.level_totals(encoder.transform(df), encoder).collect()}
    assert totals[("bloque_horario", "Tarde")] == 2 and ("bloque_horario", "Noche") not in totals
    fresh = encoder.transform(df.withColumn("emis_INICIO_SEGMENTO", F.lit("NEW")))
    sums = {(r[0], r[1]): r[2] for r in prep.level_totals(fresh, encoder).collect()}
    assert sums[("emis_INICIO_SEGMENTO", "C")] == sums[("emis_INICIO_SEGMENTO", "B")] == 0
    assert "recep_INICIO_SEGMENTO" in encoder.columns and "emis_ACEC_DES_SUBRUBRO_PPAL" in encoder.columns
    alone = prep.fit_encoder(df.withColumn("bloque_horario", F.lit("Tarde")))
    assert "bloque_horario" not in alone.columns
    vector = prep.assemble(encoder.transform(df), encoder).first()["features"]
    assert vector.size == len(prep.feature_names(encoder))


def test_scaling_uses_population_deviation(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "x double, y double")
    got = prep.fit_scaler(df, ["x", "y"]).transform(df).collect()
    assert sorted(tuple(r) for r in got) == [(-1.0, 0.0), (1.0, 0.0)]


@pytest.fixture(scope="module")
def tree(spark):
    from pyspark.ml.feature import VectorAssembler

    rng = np.random.default_rng(9)
    frame = pd.DataFrame(rng.normal(size=(2000, 2)), columns=["p", "q"])
    frame["outliers"] = np.where((frame["p"] > 1) & (frame["q"] > 0), -1, 1)
    rows = VectorAssembler(inputCols=["p", "q"], outputCol="features").transform(spark.createDataFrame(frame))
    return rows, surrogate.fit(rows, ["p", "q"])


def test_class_weights_balance(spark):
    df = spark.createDataFrame([(-1,)] + [(1,)] * 3, "outliers int")
    weights = {r["outliers"]: r["weight"] for r in surrogate.class_weights(df).collect()}
    assert weights == {-1: 2.0, 1: pytest.approx(2 / 3)}


def test_surrogate_rules_describe_its_leaves(tree):
    rows, model = tree
    predicted = surrogate.predict(rows, model).cache()
    quality = surrogate.leaf_quality(predicted).toPandas()
    assert quality["rows"].sum() == 2000 and (quality["correct"] <= quality["rows"]).all()
    assert quality["correct"].is_monotonic_decreasing
    rules = surrogate.rules(model, rows).toPandas().set_index("leaf")
    assert rules["depth"].max() <= 5 and rules["rows"].sum() == 2000 and rules["rows"].min() >= 5
    data = predicted.select("p", "q", "leaf", "predicted", "outlier_probability").toPandas()
    for leaf, part in data.groupby("leaf"):
        rule = rules.loc[leaf]
        assert (part["predicted"] == rule["predicted"]).all() and len(part) == rule["rows"]
        assert np.allclose(part["outlier_probability"], rule["share_outlier"])
        for condition in rule["rule"].split(" -> "):
            name, sign, limit = condition.split()
            ok = part[name] <= float(limit) + 0.01 if sign == "<=" else part[name] > float(limit) - 0.01
            assert ok.all()
    best = int(quality["leaf"].iloc[0])
    steps = surrogate.path(surrogate.rules(model, rows), best).toPandas()
    assert " -> ".join(steps.sort_values("step")["condition"]) == rules.loc[best, "rule"]


def test_leaf_distribution_is_weighted(tree):
    rows, model = tree
    weighted = surrogate.predict(surrogate.with_weights(rows), model)
    got = surrogate.leaf_distribution(weighted).toPandas().set_index("leaf")
    rules = surrogate.rules(model, rows).toPandas().set_index("leaf")
    assert np.allclose(got["share_outlier"].sort_index(), rules.loc[got.index, "share_outlier"].sort_index())


def test_surrogate_learns(tree):
    rows, model = tree
    report = {r["name"]: r for r in evaluate.report(surrogate.predict(rows, model), "outliers", "predicted").collect()}
    assert report["-1"]["recall"] > 0.9 and report["accuracy"]["accuracy"] > 0.95


def plain_split(x, outlier, weights, min_leaf):
    """The best split of all distinct values of all columns."""
    best = None
    for slot in range(x.shape[1]):
        for low, high in zip(np.unique(x[:, slot])[:-1], np.unique(x[:, slot])[1:]):
            left = x[:, slot] <= low
            if min(left.sum(), (~left).sum()) < min_leaf:
                continue
            gini = lambda rows: 2 * (a := outlier[rows].sum() * weights[0]) * (b := (~outlier[rows]).sum() * weights[1]) / (a + b)
            whole = gini(np.ones(len(x), bool)) - gini(left) - gini(~left)
            if best is None or whole > best[0] + 1e-9:
                best = (whole, slot, (low + high) / 2)
    return best


def test_first_split_is_the_best_of_all(spark):
    from pyspark.ml.feature import VectorAssembler

    rng = np.random.default_rng(12)
    x = np.stack([rng.integers(0, 3, 600), rng.lognormal(9, 2, 600), rng.integers(0, 2, 600) * rng.normal(size=600), -rng.random(600)], 1)
    outlier = (x[:, 1] > 12_345) & (x[:, 0] > 0) | (rng.random(600) < 0.05)
    frame = pd.DataFrame(x, columns=list("abcd")).assign(outliers=np.where(outlier, -1, 1))
    rows = VectorAssembler(inputCols=list("abcd"), outputCol="features").transform(spark.createDataFrame(frame))
    model = surrogate.fit(rows, list("abcd"), depth=4)
    weights = 300 / outlier.sum(), 300 / (~outlier).sum()
    decrease, slot, threshold = plain_split(x, outlier, weights, 5)
    root = model.nodes[0]
    assert root.slot == slot and root.decrease == pytest.approx(decrease) and root.threshold == pytest.approx(threshold)
    again = surrogate.fit(rows.repartition(7), list("abcd"), depth=4)
    assert again.nodes == model.nodes and again.names == model.names
    table = surrogate.node_table(model, rows).toPandas()
    assert table["leaf"].notna().sum() == len(model.leaves) and (table.loc[table["leaf"].notna(), ["outlier_rows", "normal_rows"]].to_numpy().sum() == 600)


def test_a_tree_of_one_class_or_no_rows_is_a_leaf(tree):
    rows, _ = tree
    for df in (rows.where("outliers = 1"), rows.where("false")):
        model = surrogate.fit(df, ["p", "q"])
        assert model.leaves == {0: 0} and surrogate.predict(rows, model).where("leaf = 0 AND predicted = 1").count() == 2000


def test_many_levels_are_ranked_and_joined(spark, monkeypatch):
    """Ranks of levels over several ranges, and both ways to join them."""
    df = spark.range(5000).select(
        F.concat(F.lit("é"), F.col("id").cast("string")).alias("many"), F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 7).cast("string")).alias("few"),
        F.lit("one").alias("single"),
    ).repartition(9)
    encoder = prep.fit_encoder(df, ["many", "few", "single"])
    assert encoder.sizes == {"many": 5000, "few": 8}
    wanted = sorted((f"é{i}" for i in range(5000)), reverse=True)
    assert encoder.labels["many"] == wanted and encoder.labels["few"] == ["hot", *"6543210"]
    assert encoder.names_of([0, 4998, 4999, 5005]) == {0: f"many_{wanted[0]}", 4998: f"many_{wanted[4998]}", 4999: "few_hot", 5005: "few_1"}
    fresh = df.unionByName(spark.createDataFrame([("new", None, "one")], "many string, few string, single string"))
    one = {r["many"]: (r["many_index"], r["few_index"]) for r in encoder.transform(fresh).collect()}
    assert one["new"] == (4999.0, 7.0) and one["é999"][0] == 0.0 and len(one) == 5001
    monkeypatch.setattr(prep, "MOST_SENT", 0)
    assert {r["many"]: (r["many_index"], r["few_index"]) for r in encoder.transform(fresh).collect()} == one


def test_features_of_both_forms_are_equal(spark):
    df = prep.imputed(model_rows(spark))
    encoder = prep.fit_encoder(df)
    encoded = encoder.transform(df)
    vectors = {r["dhdr_folio"]: r["features"].toArray() for r in prep.assemble(encoded, encoder).collect()}
    for r in prep.entries(encoded, encoder).collect():
        dense = np.zeros(r["features"]["size"])
        for i, x in zip(r["features"]["indices"], r["features"]["values"]):
            if x:
                dense[i] = x
        assert (dense == vectors[r["dhdr_folio"]]).all()
    names = prep.feature_names(encoder)
    assert prep.names_of(encoder, range(len(names))) == dict(enumerate(names))


def test_report_by_hand(spark):
    df = spark.createDataFrame([(1, 1)] * 6 + [(1, -1)] * 2 + [(-1, -1)] * 1 + [(-1, 1)] * 1 + [(2, 1)], "y int, p int")
    got = {r["name"]: r for r in evaluate.report(df, "y", "p").collect()}
    assert got["1"]["precision"] == pytest.approx(6 / 8) and got["1"]["recall"] == pytest.approx(6 / 8)
    assert got["-1"]["precision"] == pytest.approx(1 / 3) and got["-1"]["f1"] == pytest.approx(2 / 5)
    assert got["2"]["precision"] == 0 and got["2"]["f1"] == 0 and got["2"]["support"] == 1
    assert got["accuracy"]["accuracy"] == pytest.approx(7 / 11) and got["accuracy"]["precision"] is None
    assert got["macro avg"]["recall"] == pytest.approx((0.75 + 0.5 + 0) / 3)
    assert got["weighted avg"]["recall"] == pytest.approx((0.75 * 8 + 0.5 * 2) / 11)


def test_split_between_neighbouring_doubles_leaves_rows_on_both_sides():
    """A draw between a double and the next one may be rounded to the higher."""
    x = np.array([[1.0, np.nextafter(1.0, 2.0), 1.0, 1.0]])
    for seed in range(20):
        nodes = iforest._grow(0, x, 8, np.random.default_rng(seed))
        assert nodes["size"].min() > 0 and nodes.loc[nodes["feature"] < 0, "size"].sum() == 4


def test_counts_of_a_task_are_given_out_once_for_each_key(monkeypatch):
    def batch(values, outliers):
        rows = [{"indices": list(range(len(r))), "values": r} for r in values]
        return pa.RecordBatch.from_pydict({"features": rows, "is_outlier": outliers})

    batches = [batch([[3.0, 1.0, 0.0], [3.0, 0.0, 1.0]], [True, False]), batch([[3.0, 1.0, 1.0], [9.5, 1.0, 0.0]], [False, False])]
    nodes = {0: surrogate.Node(0, 1, 3)}
    total = lambda found: sorted(
        (slot, bin_, sum(o), sum(n), min(low), max(high))
        for (slot, bin_), g in pd.concat([b.to_pandas() for b in found]).groupby(["slot", "bin"])
        for o, n, low, high in [(g.outliers, g.normal, g.lowest, g.highest)]
    )
    whole = list(surrogate._counted(nodes, [0])(iter(surrogate._held(iter(batches)))))
    keys = [key for b in whole for key in zip(b["slot"].to_pylist(), b["bin"].to_pylist(), strict=True)]
    assert len(keys) == len(set(keys)) == 4
    counts = [(slot, o, n, low, high) for slot, _, o, n, low, high in total(whole)]
    assert counts == [(0, 1, 2, 3.0, 3.0), (0, 0, 1, 9.5, 9.5), (1, 1, 2, 1.0, 1.0), (2, 0, 2, 1.0, 1.0)]
    monkeypatch.setattr(surrogate, "GATHERED", 2)
    assert total(surrogate._counted(nodes, [0])(iter(batches))) == total(whole)
