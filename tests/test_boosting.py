"""Boosted trees, importances and Shapley values against plain loops."""

from itertools import combinations
from math import factorial

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark import errors
from tidemark.operators import boosting, features

ROUNDS, DEPTH, STEP, SHARE = 9, 2, 0.1, 0.8


def table(n=120, seed=5):
    rng = np.random.default_rng(seed)
    d = pd.DataFrame({"symbol": np.where(np.arange(n) % 3 == 0, "A", "B"), "ts": pd.date_range("2020-01-01", periods=n)})
    for c in features.NAMES:
        d[c] = rng.integers(0, 6, n) / 4.0
    d["direction"] = np.sign(d["rsi_14"] - d["vol_ratio"]).astype(int)
    return d


def frames(spark, d, parts=3):
    made = spark.createDataFrame(d, "symbol string, ts timestamp_ntz, " + ", ".join(f"{c} double" for c in features.NAMES) + ", direction int").repartition(parts)
    return made.drop("direction"), made.select("symbol", "ts", "direction")


def explainer(spark, d, parts=3, **options):
    return features.Explainer(trees=ROUNDS, depth=DEPTH, step=STEP, folds=3, share=SHARE, seed=7).fit(*frames(spark, d, parts), **options)


def plain(x, y, drawn, cuts, classes):
    """Rounds of trees by loops: each a nested tuple (feature, value, left, right), or a leaf's value."""
    n, grid = len(x), lambda v: np.rint(v * 2**40) / 2**40
    base = grid(np.log([np.mean(y == c) for c in range(classes)]))
    margins = np.tile(base, (n, 1))
    rounds = []
    for k in range(ROUNDS):
        p = np.exp(margins - margins.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        trees = []
        for c in range(classes):
            g = np.rint(((y == c) - p[:, c]) * 2**24)
            h = np.rint(p[:, c] * (1 - p[:, c]) * 2**24)

            def grown(rows, level, g=g, h=h):
                best = (1e-12, None)
                if level < DEPTH:
                    for f in range(x.shape[1]):
                        for v in cuts[f]:
                            left, right = rows[x[rows, f] <= v], rows[x[rows, f] > v]
                            if len(left) and len(right):
                                gain = len(left) * len(right) / len(rows) * ((g[left].mean() - g[right].mean()) / 2**24) ** 2
                                if gain > best[0] * (1 + 1e-9):
                                    best = (gain, (f, v, left, right))
                if best[1] is None:
                    total = h[rows].sum()
                    return (float(grid(STEP * (classes - 1) / classes * g[rows].sum() / total)) if total > 0 else 0.0, len(rows))
                f, v, left, right = best[1]
                return (f, v, grown(left, level + 1), grown(right, level + 1))

            trees.append(grown(np.flatnonzero(drawn[k]), 0))
        rounds.append(trees)
        for c in range(classes):
            margins[:, c] += [walked(trees[c], row) for row in x]
    return base, rounds, margins


def walked(tree, row):
    while len(tree) == 4:
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree[0]


def size(tree):
    return tree[1] if len(tree) == 2 else size(tree[2]) + size(tree[3])


def known(tree, row, some):
    """The tree's expected value if only the features ``some`` of the row are known."""
    if len(tree) == 2:
        return tree[0]
    if tree[0] in some:
        return known(tree[2] if row[tree[0]] <= tree[1] else tree[3], row, some)
    a, b = size(tree[2]), size(tree[3])
    return (a * known(tree[2], row, some) + b * known(tree[3], row, some)) / (a + b)


@pytest.fixture(scope="module")
def fitted(spark):
    d = table()
    model = explainer(spark, d)
    rows = model.labelled.toPandas().sort_values(["symbol", "ts"]).reset_index(drop=True)
    x, y, draw = rows[features.NAMES].to_numpy(), rows["label"].to_numpy(), rows["draw"].to_numpy().astype(np.uint64)
    drawn = [boosting._drawn(draw, k, SHARE) for k in range(ROUNDS)]
    return d, model, rows, x, y, plain(x, y, drawn, model.cuts, 3)


def test_draws_are_a_share_of_the_rows_and_change_with_the_round():
    draw = np.random.default_rng(0).integers(0, 2**63, 100_000).astype(np.uint64)
    a, b = boosting._drawn(draw, 0, 0.8), boosting._drawn(draw, 1, 0.8)
    assert abs(a.mean() - 0.8) < 0.01 and abs((a & b).mean() - 0.64) < 0.01


def test_trees_equal_plain_loops(fitted):
    _, model, _, x, y, (base, _, want) = fitted
    assert np.array_equal(model.model.base[0], base)
    bins = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(model.cuts, x.T)], 1).astype(np.uint8)
    assert np.allclose(model.model.margins(bins)[0].T, want, atol=1e-9)
    assert model.accuracy == np.mean(want.argmax(1) == y) > 0.8


def test_trees_do_not_depend_on_partitions_or_blocks(spark, fitted, monkeypatch):
    d, model, *_ = fitted
    monkeypatch.setattr(boosting, "PART_ROWS", 25)
    monkeypatch.setattr(boosting, "MERGED", 2)
    other = explainer(spark, d, parts=7).model
    for a, b in zip(model.model.rounds, other.rounds, strict=True):
        assert all(np.array_equal(a[k], b[k]) for k in ("feature", "cut", "leaf", "cover"))


def test_each_fold_equals_a_fit_without_its_rows(spark, fitted):
    d, *_ = fitted
    found = explainer(spark, d, cross_validated=True).diagnostics
    rows = fitted[2]
    scores = []
    for k in range(3):
        train = rows[rows["fold"] != k].reset_index(drop=True)
        x, draw = train[features.NAMES].to_numpy(), train["draw"].to_numpy().astype(np.uint64)
        base, rounds, _ = plain(x, train["label"].to_numpy(), [boosting._drawn(draw, r, SHARE) for r in range(ROUNDS)], fitted[1].cuts, 3)
        left = rows[rows["fold"] == k]
        margins = [[base[c] + sum(walked(t[c], row) for t in rounds) for c in range(3)] for row in left[features.NAMES].to_numpy()]
        scores.append(np.mean(np.argmax(margins, 1) == left["label"].to_numpy()))
    assert found["cv_accuracy_mean"] == pytest.approx(np.mean(scores), abs=1e-4) and found["cv_accuracy_std"] == pytest.approx(np.std(scores), abs=1e-4)


def test_importance_equals_plain_shuffles(spark, fitted):
    d, model, rows, x, y, (base, rounds, _) = fitted
    got = {r.feature: r for r in model.importance(repeats=2).collect()}
    dealt = model.labelled.select("symbol", "ts", *[F.xxhash64(F.lit(7), F.lit(k), "ts").alias(f"k{k}") for k in range(2)]).toPandas().sort_values(["symbol", "ts"]).reset_index(drop=True)
    lost = np.zeros((len(features.NAMES), 2))
    for k in range(2):
        other = x.copy()
        for _, part in dealt.groupby("symbol"):
            other[part.index] = x[part.sort_values([f"k{k}", "ts"]).index]
        for f in range(len(features.NAMES)):
            mixed = x.copy()
            mixed[:, f] = other[:, f]
            margins = [[base[c] + sum(walked(t[c], row) for t in rounds) for c in range(3)] for row in mixed]
            lost[f, k] = model.accuracy - np.mean(np.argmax(margins, 1) == y)
    for f, name in enumerate(features.NAMES):
        assert got[name].importance_mean == pytest.approx(lost[f].mean(), abs=1e-9) and got[name].importance_std == pytest.approx(lost[f].std(), abs=1e-9)
    assert max(got.values(), key=lambda r: r.importance_mean).feature in ("rsi_14", "vol_ratio")


def test_shapley_values_equal_all_subsets(spark, fitted):
    d, model, rows, x, _, (base, rounds, margins) = fitted
    got = model.shap_values(frames(spark, d)[0]).toPandas().sort_values(["symbol", "ts", "direction"]).reset_index(drop=True)
    assert list(got.columns) == ["symbol", "ts", "direction", "expected", *features.NAMES] and len(got) == 3 * len(rows)
    whole = got["expected"].to_numpy() + got[features.NAMES].to_numpy().sum(1)
    assert np.allclose(whole.reshape(-1, 3), margins, atol=1e-9)
    for i in (0, 17, 90):
        for c in range(3):
            want = np.zeros(len(features.NAMES))
            for trees in rounds:
                used = sorted({f for f in range(len(features.NAMES)) if str(f) in map(str, names(trees[c]))})
                for f in used:
                    others = [g for g in used if g != f]
                    for k in range(len(others) + 1):
                        for some in combinations(others, k):
                            part = factorial(k) * factorial(len(used) - k - 1) / factorial(len(used))
                            want[f] += part * (known(trees[c], x[i], {*some, f}) - known(trees[c], x[i], set(some)))
            assert np.allclose(got.loc[3 * i + c, features.NAMES].to_numpy(float), want, atol=1e-9)


def names(tree):
    return [] if len(tree) == 2 else [tree[0], *names(tree[2]), *names(tree[3])]


def test_report_and_odd_input(spark, fitted):
    d, model, *_ = fitted
    report = model.report(repeats=1)
    assert report["shap_available"] and report["top_features"].count() == 10
    ranking = report["shap_feature_ranking"].toPandas()
    # A direction of 0 means equal values, which no single feature tells, so a chance feature may lead there.
    first = ranking.groupby("direction")["feature"].first()
    assert len(ranking) == 3 * 16 and {first[-1], first[1]} <= {"rsi_14", "vol_ratio"}
    sizes = model.shap_values(frames(spark, d)[0]).toPandas().groupby("direction")[features.NAMES].agg(lambda v: v.abs().mean())
    assert all(r.mean_abs_shap == pytest.approx(sizes.loc[r.direction, r.feature]) for r in ranking.itertuples())
    x, signals = frames(spark, d)
    nulls = x.withColumn("rsi_14", F.when(F.col("symbol") == "B", F.col("rsi_14"))).withColumn("direction", F.lit(9))
    alone = features.Explainer(trees=2, folds=2).fit(x, signals.withColumn("direction", F.lit(1)), cross_validated=True)
    assert alone.diagnostics["train_accuracy"] == alone.diagnostics["cv_accuracy_mean"] == 1.0
    assert alone.shap_values(nulls).count() == 80 and alone.shap_values(x.limit(0)).count() == 0
    again = features.Explainer(trees=2, folds=2).fit(x.union(x), signals)
    assert again.diagnostics["n_samples"] == 240 and again.importance(1).count() == 16
    for empty in (x.limit(0), nulls.withColumn("rsi_14", F.lit(None).cast("double"))):
        with pytest.raises(errors.InsufficientDataError):
            features.Explainer(trees=1).fit(empty, signals)
    with pytest.raises(errors.InsufficientDataError):
        features.Explainer().shap_values(x)
