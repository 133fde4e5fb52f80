"""Features of bars, and models that explain signals by them."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.errors import InsufficientDataError
from tidemark.functions import segments, series
from tidemark.operators import boosting
from tidemark.operators.metrics import shares
from tidemark.plans.tables import kept

# Names of the features.
NAMES = [
    "ret_1d", "ret_5d", "ret_21d", "ret_63d", "ema_spread_sm", "ema_spread_ml", "price_vs_ema_long", "realised_vol_21d",
    "vol_ratio", "parkinson_vol", "z_score_21d", "rsi_14", "volume_ratio", "log_volume", "drawdown_from_high", "atr_pct",
]
LEAST_ROWS = 50
#: Share that a direction without rows in a model's folds starts with.
LEAST_SHARE = 1e-7


def build(bars: DataFrame, short: int = 10, medium: int = 21, long: int = 63, vol: int = 21, keys: list[str] = ["symbol"], no_range: float | None = None) -> DataFrame:  # noqa: B006
    """``symbol, ts`` and the features NAMES; rows where one is missing are left out. A bar whose high or low isn't positive
    has no logarithmic range: where one of the last ``vol`` bars has none, parkinson_vol is ``no_range``, missing by default."""
    alpha = series.span_alpha
    made = series.ema(bars, {"_s": ("close", alpha(short)), "_m": ("close", alpha(medium)), "_l": ("close", alpha(long))}, keys, "ts")
    made = series.with_rsi(series.with_atr(made, 14, keys, "ts", "_atr"), 14, keys, "ts", name="rsi_14")
    w = series.ordered(keys, "ts")
    close = F.col("close")
    made = made.withColumn("ret_1d", series.log_change(close, w))
    made = made.withColumn("_hl", F.when((F.col("high") > 0) & (F.col("low") > 0), F.pow(F.log(series.ratio(F.col("high"), F.col("low"))), F.lit(2.0)) / (4 * math.log(2))))
    year = math.sqrt(252)
    out = {
        "ret_5d": series.log_change(close, w, 5),
        "ret_21d": series.log_change(close, w, medium),
        "ret_63d": series.log_change(close, w, long),
        "ema_spread_sm": series.ratio(F.col("_s") - F.col("_m"), F.col("_m")),
        "ema_spread_ml": series.ratio(F.col("_m") - F.col("_l"), F.col("_l")),
        "price_vs_ema_long": series.ratio(close - F.col("_l"), F.col("_l")),
        "realised_vol_21d": series.rolling_deviation(F.col("ret_1d"), w, vol) * year,
        "vol_ratio": series.rolling_deviation(F.col("ret_1d"), w, short) / F.nullif(series.rolling_deviation(F.col("ret_1d"), w, long), F.lit(0.0)),
        "parkinson_vol": F.sqrt(F.greatest(series.rolling_mean(F.col("_hl"), w, vol), F.lit(0.0))) * year,
        "z_score_21d": (close - series.rolling_mean(close, w, medium)) / F.nullif(series.rolling_deviation(close, w, medium), F.lit(0.0)),
        "volume_ratio": F.col("volume") / F.nullif(series.rolling_mean(F.col("volume"), w, medium), F.lit(0.0)),
        "log_volume": F.log1p("volume"),
        "drawdown_from_high": series.drawdown(close, w, long),
        "atr_pct": series.ratio(F.col("_atr"), close),
    }
    whole = series.rolling_mean(F.col("_hl"), w, vol)
    out["parkinson_vol"] = F.when(whole.isNotNull(), out["parkinson_vol"]).otherwise(F.lit(no_range).cast("double"))
    return made.withColumns(out).select(*keys, "ts", *NAMES).dropna(subset=NAMES)


class Explainer:
    """Boosted trees that tell signals apart by features, what shuffling each feature costs them, and what each feature adds to
    each row's margin. All directions share a softmax; the direction with the greatest margin is predicted, the least of equal
    ones. Trees don't change with the scale of a feature, so none is scaled."""

    def __init__(self, trees: int = 100, depth: int = 3, step: float = 0.05, seed: int = 42, folds: int = 5, share: float = 0.8):
        self.trees, self.depth, self.step, self.seed, self.folds, self.share, self.model = trees, depth, step, seed, folds, share, None

    def aligned(self, features: DataFrame, signals: DataFrame) -> DataFrame:
        """Rows of both with all features and a direction; other columns, whatever their names, are left out."""
        return features.select("symbol", "ts", *NAMES).join(signals.select("symbol", "ts", "direction"), ["symbol", "ts"]).dropna(subset=[*NAMES, "direction"])

    def fit(self, features: DataFrame, signals: DataFrame, cross_validated: bool = False) -> Explainer:
        """Fits on all rows. With ``cross_validated``, ``diagnostics`` also has the accuracies of ``folds`` models that are
        each fitted without one fold (by a hash of symbol and time) and tried on it; folds without rows don't count."""
        fold = F.pmod(F.xxhash64("symbol", "ts"), F.lit(self.folds)).cast("int")
        rows = self.aligned(features, signals).select("symbol", "ts", "direction", *NAMES, fold.alias("fold"), F.xxhash64(F.lit(self.seed), "symbol", "ts").alias("draw"))
        self.rows = kept(rows)
        counts = {(r.fold, r.direction): r["count"] for r in self.rows.groupBy("fold", "direction").count().collect()}
        n = sum(counts.values())
        if n < LEAST_ROWS:
            raise InsufficientDataError(f"{LEAST_ROWS} rows with features and a signal are needed, not {n}")
        self.classes = sorted({c for _, c in counts})
        self.cuts = boosting.cuts_of(self.rows, NAMES)
        label = F.array_position(F.array(*[F.lit(c) for c in self.classes]), F.col("direction")) - 1
        self.labelled = self.rows.withColumn("label", label.cast("int"))
        without = [None, *range(self.folds)] if cross_validated else [None]
        seen = np.array([[sum(v for (k, d), v in counts.items() if d == c and k != f) for c in self.classes] for f in without], float)
        base = np.log(np.maximum(seen / np.maximum(seen.sum(1, keepdims=True), 1), LEAST_SHARE))
        table = boosting.blocks(self.labelled, self.cuts, NAMES, n)
        trees, tried = boosting.fit(table, base, len(NAMES), self.trees, self.depth, self.step, self.share)
        self.model, self.accuracy = trees.first(), tried[1, 0] / tried[0, 0]
        self.diagnostics = {"n_samples": n, "n_features": len(NAMES), "train_accuracy": round(float(self.accuracy), 4)}
        if cross_validated:
            scores = [float(right / rows) for rows, right in tried.T[1:] if rows]
            mean = sum(scores) / len(scores)
            self.diagnostics |= {"cv_accuracy_mean": round(mean, 4), "cv_accuracy_std": round(math.sqrt(sum((x - mean) ** 2 for x in scores) / len(scores)), 4)}
        return self

    def _fitted(self) -> tuple[boosting.Trees, list[list[float]]]:
        if self.model is None:
            raise InsufficientDataError("fit first")
        return self.model, self.cuts

    def importance(self, repeats: int = 20) -> DataFrame:
        """``feature, importance_mean, importance_std``: the accuracy lost when a feature's values are dealt anew among the
        rows of a symbol. For each repeat a row meets the row whose place in a hashed order is its own in the order of time;
        tasks take one feature at a time from it. Places are numbered by ranges, so no symbol goes to one task."""
        model, cuts = self._fitted()

        def binned(batches):
            for batch in batches:
                bins = pa.array([x.tobytes() for x in boosting.binned(batch, cuts, NAMES)], pa.binary())
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("symbol", "ts", "label")], bins], ["symbol", "ts", "label", "own"])

        def tried(batches):
            for batch in batches:
                k, label = batch.column("k").to_numpy(), batch.column("label").to_numpy()
                own, other = [np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, len(NAMES)) for c in ("own", "other")]
                right = model.with_other(own, other).argmax(1) == label
                for one in np.unique(k):
                    here = right[:, k == one]
                    yield pa.RecordBatch.from_arrays([pa.array(range(len(here)), pa.int32()), pa.array([one] * len(here), pa.int32()), pa.array(here.sum(1), pa.int64()), pa.array([here.shape[1]] * len(here), pa.int64())], ["f", "k", "good", "n"])

        own = self.labelled.select("symbol", "ts", "label", *NAMES).mapInArrow(binned, "symbol string, ts timestamp_ntz, label int, own binary")
        placed = segments.numbered(own, ["symbol"], ["ts", "own", "label"]).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
        order = F.xxhash64(F.lit(self.seed), "k", "ts")
        dealt = segments.numbered(placed.select("symbol", "k", order.alias("at"), "ts", F.col("own").alias("other")), ["symbol", "k"], ["at", "ts", "other"])
        pairs = placed.join(dealt.select("symbol", "k", segments.ROW, "other"), ["symbol", "k", segments.ROW])
        counted = pairs.select("k", "label", "own", "other").mapInArrow(tried, "f int, k int, good long, n long")
        lost = counted.groupBy("f", "k").agg((F.lit(float(self.accuracy)) - F.sum("good") / F.sum("n")).alias("lost"))
        name = F.element_at(F.array(*map(F.lit, NAMES)), F.col("f") + 1)
        out = lost.groupBy(name.alias("feature")).agg(F.avg("lost").alias("importance_mean"), F.stddev_pop("lost").alias("importance_std"))
        return out.orderBy(F.desc("importance_mean"), "feature")

    def shap_values(self, features: DataFrame) -> DataFrame:
        """``symbol, ts, direction, expected`` and for each feature what it adds to the row's margin for that direction: exact
        Shapley values of the trees, where a feature that isn't known sends a row both ways by shares of the training rows.
        ``expected`` and a row's values sum up to its margin. Rows without all features are left out."""
        model, cuts = self._fitted()
        classes = self.classes

        def explained(batches):
            for batch in batches:
                expected, values = model.shapley(boosting.binned(batch, cuts, NAMES))
                for c, direction in enumerate(classes):
                    n = batch.num_rows
                    columns = [batch.column("symbol"), batch.column("ts"), pa.array([direction] * n, pa.int32()), pa.array([expected[c]] * n, pa.float64())]
                    yield pa.RecordBatch.from_arrays([*columns, *[pa.array(v, pa.float64()) for v in values[c].T]], ["symbol", "ts", "direction", "expected", *NAMES])

        schema = "symbol string, ts timestamp_ntz, direction int, expected double, " + ", ".join(f"{c} double" for c in NAMES)
        return features.select("symbol", "ts", *NAMES).dropna(subset=NAMES).mapInArrow(explained, schema)

    def shap_ranking(self, features: DataFrame) -> DataFrame:
        """``direction, feature, mean_abs_shap``, the greatest first."""
        sizes = self.shap_values(features).groupBy("direction").agg(*[F.avg(F.abs(c)).alias(c) for c in NAMES])
        return sizes.unpivot("direction", NAMES, "feature", "mean_abs_shap").orderBy("direction", F.desc("mean_abs_shap"), "feature")

    def report(self, repeats: int = 20) -> dict:
        return {
            "signal_distribution": shares(self.rows, "direction"),
            "importance": (table := self.importance(repeats)),
            "top_features": table.limit(10),
            "shap_available": True,
            "shap_feature_ranking": self.shap_ranking(self.rows),
        }
