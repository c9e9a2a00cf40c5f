"""Fitting the post-classifier and the calibration with MLlib."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import physics
from . import metrics, ordered
from .lineage import cut


def hit_label(status: Column) -> Column:
    """1 for HIT, 0 for FALSE_ALARM, in any case and spacing; else null."""
    s = F.upper(F.regexp_replace(F.trim(status), r"\s+", "_"))
    return F.when(s == "HIT", 1).when(s == "FALSE_ALARM", 0)


def usable_features(df: DataFrame, required: list[str], optional: list[str], least_optional: int = 7) -> list[str]:
    """The features that have any value; ValueError if a required one or too many optional ones have none."""
    there = [c for c in required + optional if c in df.columns]
    counts = df.agg(*[F.count(c).alias(c) for c in there]).first().asDict() if there else {}
    lacking = [c for c in required if not counts.get(c)]
    some = [c for c in optional if counts.get(c)]
    if lacking or len(some) < min(least_optional, len(optional)):
        raise ValueError(f"missing features: {lacking}, {len(some)} of {len(optional)} optional ones")
    return required + some


def imputed_scaled(df: DataFrame, columns: list[str]) -> tuple[DataFrame, dict[str, dict[str, float]]]:
    """Columns with medians for what is missing, less the mean, over the population deviation (1 where it is 0)."""
    clean = df.withColumns({c: physics.finite(F.col(c)) for c in columns})
    # all columns are ranked at once, by column and value
    long = clean.select(*columns).unpivot([], columns, "_column", "_value")
    found = {r["_column"]: r["m"] for r in ordered.quantiles(long, "_value", {"m": 0.5}, by=["_column"]).collect()}
    medians = {c: float(found[c]) if found.get(c) is not None else 0.0 for c in columns}
    filled = clean.na.fill(medians)
    r = filled.agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns]).first()
    means, scales = {c: r[f"m_{c}"] or 0.0 for c in columns}, {c: r[f"s_{c}"] or 1.0 for c in columns}
    return filled.withColumns({c: (F.col(c) - means[c]) / scales[c] for c in columns}), {"imputation_medians": medians, "means": means, "scales": scales}


def folds(df: DataFrame, label: str, key: str, k: int = 5, seed: int = 0) -> DataFrame:
    """Stratified fold numbers: each label's rows are ranked by a hash of seed and key and dealt round, so that folds differ
    by one row of a label at most. Ranks come from range partitions (ordered.running)."""
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")))
    ranked = ordered.running(df.withColumn("_o", order), [F.col("_o"), F.col(key)], {"_n": F.lit(1)}, by=[label])
    return ranked.withColumn("fold", F.pmod(F.col("_n") - 1, F.lit(k)).cast("int")).drop("_o", "_n", "all__n")


def _assembled(df: DataFrame, columns: list[str]) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    return df.withColumn("features", array_to_vector(F.array(*[F.col(c).cast("double") for c in columns])))


def logistic(df: DataFrame, columns: list[str], label: str, *, c: float = 0.35, balanced: bool = True):
    """A fitted MLlib model whose penalty equals C times the summed weighted loss plus half the squared weights."""
    from pyspark.ml.classification import LogisticRegression

    counts = {r[0]: r[1] for r in df.groupBy(label).count().collect()}
    n = sum(counts.values())
    weight = F.lit(1.0)
    if balanced:
        for value, rows in counts.items():
            weight = F.when(F.col(label) == value, n / (len(counts) * rows)).otherwise(weight)
    ready = _assembled(df, columns).withColumns({"label": F.col(label).cast("double"), "_w": weight})
    return LogisticRegression(featuresCol="features", labelCol="label", weightCol="_w", regParam=1 / (c * n), elasticNetParam=0.0, standardization=False, maxIter=200, tol=1e-9).fit(ready)


def probability(model, df: DataFrame, columns: list[str], name: str) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    return model.transform(_assembled(df, columns)).withColumn(name, vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


class FoldFits:
    """Logistic models of all folds at once, each fitted on the rows of the others.

    A pass over the table adds up what every model needs of each row: numbers and means, deviations, and then of each
    Newton step the loss, its gradient and X'WX, in one matrix for each task and model; the driver solves systems as large
    as the features are many. Medians of all columns and models come from one ranking. The penalty is half the squared
    coefficients against C times the weighted loss; the intercept isn't penalised.
    """

    def __init__(self, dealt: DataFrame, columns: list[str], label: str, *, k: int = 5, c: float = 0.35, balanced: bool = True, steps: int = 60, tol: float = 1e-10):
        """``dealt`` has fold (from 0 to ``k`` - 1), columns and a label of 0 and 1; other labels take no part."""
        import numpy as np

        self.columns, self.k = columns, k
        clean = dealt.where(F.col(label).isin(0, 1)).select("fold", F.col(label).cast("double").alias("_y"), *[physics.finite(F.col(x)).alias(x) for x in columns])
        self.table = cut(clean)
        long = self.table.select("fold", *columns).unpivot(["fold"], columns, "_column", "_value").where("_value IS NOT NULL")
        long = long.withColumn("_model", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).where("_model <> fold")
        self.medians = np.zeros((k, len(columns)))
        place = {x: i for i, x in enumerate(columns)}
        for r in ordered.quantiles(long, "_value", {"m": 0.5}, by=["_model", "_column"]).collect():  # one row for each model and column
            self.medians[r["_model"], place[r["_column"]]] = r["m"]
        d = len(columns)
        counts = self._sums(lambda m, x, y: np.concatenate([[len(y), y.sum()], x.sum(0)]), 2 + d, self.medians)
        n, ones = counts[:, 0], counts[:, 1]
        self.means = counts[:, 2:] / np.maximum(n, 1)[:, None]
        means = self.means
        squares = self._sums(lambda m, x, y: ((x - means[m]) ** 2).sum(0), d, self.medians)
        self.scales = np.sqrt(squares / np.maximum(n, 1)[:, None])
        self.scales[self.scales == 0] = 1.0
        weight = np.ones((k, 2))
        if balanced:
            weight = np.stack([n / np.maximum(2 * (n - ones), 1), n / np.maximum(2 * ones, 1)], 1)
        self.weight, self.penalty = weight, np.append(np.full(d, 1 / c), 0.0)
        self.coefficients = self._newton(steps, tol)

    def _sums(self, f, size: int, medians):
        """Sums of f(model, filled columns, label) over the rows of each model, (models, size)."""
        import numpy as np
        import pyarrow as pa

        k, columns = self.k, self.columns

        def run(batches):
            total = np.zeros((k, size))
            for batch in batches:
                fold, y = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
                x = np.stack([batch.column(2 + i).cast(pa.float64()).to_numpy(zero_copy_only=False).astype(float) for i in range(len(columns))], 1) if len(fold) else np.zeros((0, len(columns)))
                for m in range(k):
                    own = fold != m
                    part = x[own]
                    total[m] += f(m, np.where(np.isnan(part), medians[m], part), y[own])
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(k, dtype=np.int32), size)), pa.array(np.tile(np.arange(size, dtype=np.int32), k)), pa.array(total.ravel())], names=["model", "at", "value"])

        found = self.table.mapInArrow(run, "model int, at int, value double").groupBy("model", "at").agg(F.sum("value").alias("value")).toArrow()
        out = np.zeros((k, size))
        out[found["model"].to_numpy(), found["at"].to_numpy()] = found["value"].to_numpy()
        return out

    def _newton(self, steps: int, tol: float):
        import numpy as np

        d = len(self.columns) + 1
        means, scales, weight, penalty = self.means, self.scales, self.weight, self.penalty
        best = now = np.zeros((self.k, d))
        least = np.full(self.k, np.inf)
        step = np.full((self.k, d), np.inf)
        for _ in range(steps):
            at = now

            def one(m, x, y, at=at):
                z = np.concatenate([(x - means[m]) / scales[m], np.ones((len(y), 1))], 1)
                w, u = np.where(y == 1, weight[m, 1], weight[m, 0]), z @ at[m]
                p = 1 / (1 + np.exp(-np.clip(u, -700, 700)))
                loss = (w * (np.logaddexp(0, u) - y * u)).sum()
                return np.concatenate([[loss], z.T @ (w * (p - y)), (z.T @ (z * (w * p * (1 - p))[:, None])).ravel()])

            sums = self._sums(one, 1 + d + d * d, self.medians)
            now = at.copy()
            for m in range(self.k):
                loss = sums[m, 0] + 0.5 * (penalty * at[m] ** 2).sum()
                if loss > least[m] * (1 + 1e-12):  # too far: half the way back
                    step[m] = step[m] / 2
                    now[m] = best[m] + step[m]
                    continue
                hessian = sums[m, 1 + d :].reshape(d, d) + np.diag(penalty)
                step[m] = -np.linalg.lstsq(hessian, sums[m, 1 : 1 + d] + penalty * at[m], rcond=None)[0]
                best = best.copy()
                best[m], least[m] = at[m], loss
                now[m] = at[m] + step[m]
            if np.abs(step).max() < tol:
                break
        return now

    def probability(self, fold: Column) -> Column:
        """Of a row with the columns, by the model that hasn't seen its fold."""
        out = F.lit(None).cast("double")
        for m in range(self.k):
            b = self.coefficients[m]
            score = F.lit(float(b[-1]))
            for i, c in enumerate(self.columns):
                score = score + float(b[i]) * (F.coalesce(physics.finite(F.col(c)), F.lit(float(self.medians[m, i]))) - float(self.means[m, i])) / float(self.scales[m, i])
            out = F.when(fold == m, 1 / (1 + F.exp(-score))).otherwise(out)
        return out


def out_of_fold(df: DataFrame, columns: list[str], label: str, key: str, *, k: int = 5, name: str = "oof", c: float = 0.35, balanced: bool = True) -> DataFrame:
    """Each row with the probability of a model that hasn't seen its fold."""
    dealt = cut(folds(df, label, key, k))
    fits = FoldFits(dealt, columns, label, k=k, c=c, balanced=balanced)
    return dealt.select(key, label, "fold", fits.probability(F.col("fold")).alias(name))


def post_classifier(df: DataFrame, columns: list[str], label: str, key: str, *, rules: Column, c: float = 0.35) -> dict:
    """The JSON document of a fitted post-classifier: coefficients, scaling, and validation against the rules."""
    oof = cut(out_of_fold(df, columns, label, key, c=c))
    best = metrics.sweep(oof, F.col(label), F.col("oof")).first()
    rule = metrics.confusion(df.withColumn("_r", rules.cast("double")), F.col(label), F.col("_r"), 0.5, epsilon=0.0 + 1e-12).first()
    ready, how = imputed_scaled(df, columns)
    model = logistic(ready, columns, label, c=c)
    n = df.count()
    return {
        "model_type": "logistic_regression",
        "feature_names": columns,
        "coefficients": dict(zip(columns, map(float, model.coefficients), strict=True)),
        "intercept": float(model.intercept),
        **how,
        "positive_threshold": best["threshold"],
        "maximum_absolute_z": 5.0,
        "minimum_validation_samples": 100,
        "minimum_validation_precision": 0.25,
        "training_samples": n,
        "validation_metrics": {"precision": best["precision"], "recall": best["recall"], "csi": best["csi"], "rules_precision": rule["precision"], "rules_csi": rule["csi"]},
    }


def platt(df: DataFrame, label: str, score: str, key: str, k: int = 5) -> DataFrame:
    """Out-of-fold probabilities of a logistic fit on the logit of a score, as ``calibrated``."""
    return out_of_fold(df.withColumn("_logit", physics.logit(F.col(score))), ["_logit"], label, key, k=k, name="calibrated", c=1.0, balanced=False)
