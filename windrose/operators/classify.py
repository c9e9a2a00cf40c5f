"""Post-classification of retained detections: features, learned score and its gates, hybrid support, rule cascade."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..functions import physics
from .grid import PRESSURE_VARIABLES, SURFACE_VARIABLES

# Statuses of the feeds by group, and attribution names that speak for genesis.
ACTIVE = ["TD", "TS", "STS", "TC", "TY", "HU", "CY", "ST", "SS", "SD"]
INVEST = ["DB", "INVEST", "PTC", "LO", "WV"]
DECAYING = ["EX", "ET", "REMNANT", "RL", "DS"]
GENESIS_ATTRIBUTIONS = ["pressfc", "rhprs", "absvprs", "ugrdprs", "vgrdprs", "vvelprs", "tmpsfc", "capesfc"]
# Favourable conditions: column, threshold, scale, whether higher is better, value where missing.
CONDITIONS = {
    "oceanic": ("land_fraction", 0.15, 0.08, False, 1.0),
    "moist": ("midlevel_rh_percent", 55.0, 10.0, True, 0.0),
    "low_shear": ("shear_200_850_ms", 20.0, 5.0, False, 99.0),
    "cyclonic_vorticity": ("cyclonic_vorticity_850_s1", 7.5e-6, 1.5e-5, True, 0.0),
    "low_pressure": ("pressure_anomaly_pa", 0.0, 250.0, False, 9999.0),
    "warm_surface": ("surface_temperature_k", 299.0, 1.5, True, 0.0),
}


def favourable_count(columns: dict[str, Column]) -> Column:
    """How many of the six conditions hold; a missing value fails its own."""
    out = F.lit(0)
    for name, at, _, higher, _ in CONDITIONS.values():
        x = columns[name]
        out = out + F.coalesce(((x >= at) if higher else (x <= at)).cast("int"), F.lit(0))
    return out


def environment_support(columns: dict[str, Column]) -> Column:
    """Mean of the soft passes of the six conditions."""
    passes = [physics.soft_pass(F.coalesce(physics.finite(columns[n]), F.lit(default)), at, scale, higher_is_better=up) for n, at, scale, up, default in CONDITIONS.values()]
    return sum(passes[1:], passes[0]) / len(passes)


def attribution_support(attribution: Column) -> Column:
    """Share of a map's positive attributions that speaks for genesis; a half without any."""
    known = PRESSURE_VARIABLES + SURFACE_VARIABLES
    of = lambda names: sum((F.greatest(F.lit(0.0), F.coalesce(physics.finite(F.try_element_at(attribution, F.lit(n))), F.lit(0.0))) for n in names), F.lit(0.0))
    return F.when(of(known) > 0, of(GENESIS_ATTRIBUTIONS) / of(known)).otherwise(0.5)


def hybrid_support(environment: Column, attribution: Column, ensemble: Column, cnn: Column, vit: Column) -> Column:
    """Physics first, then the neural scores, their agreement and their attribution."""
    e, c, v = (physics.clip01(physics.finite_or_zero(x)) for x in (ensemble, cnn, vit))
    neural = 0.5 * e + 0.25 * c + 0.25 * v
    return physics.clip01(0.50 * environment + 0.30 * neural + 0.12 * attribution + 0.08 * physics.clip01(1 - F.abs(c - v)))


class PostClassifier:
    """A logistic model read from its JSON document."""

    REQUIRED = ("model_type", "feature_names", "coefficients", "intercept")

    def __init__(self, model: dict):
        missing = [k for k in self.REQUIRED if k not in model]
        if missing:
            raise ValueError(f"the model lacks {missing}")
        if model["model_type"] != "logistic_regression":
            raise ValueError(f"not a logistic model: {model['model_type']}")
        self.model = model
        self.names = list(model["feature_names"])

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> PostClassifier:
        return cls(json.loads(spark.read.text(path, wholetext=True).first()[0]))

    def _of(self, what: str, name: str, default: float) -> float:
        value = (self.model.get(what) or {}).get(name, default)
        return float(value) if value is not None and math.isfinite(float(value)) else default

    def feature(self, name: str, columns: dict[str, Column]) -> Column:
        """A feature under its own name or its alias, else the training median."""
        for alias in (name, name.replace("xai_mean_", "xai_"), name.replace("xai_", "xai_mean_")):
            if alias in columns:
                return F.coalesce(physics.finite(columns[alias]), F.lit(self._of("imputation_medians", name, 0.0)))
        return F.lit(self._of("imputation_medians", name, self._of("means", name, 0.0)))

    def _z(self, name: str, columns: dict[str, Column]) -> Column:
        return (self.feature(name, columns) - self._of("means", name, 0.0)) / max(abs(self._of("scales", name, 1.0)), 1e-12)

    def probability(self, columns: dict[str, Column]) -> Column:
        coefficients = self.model["coefficients"]
        if not isinstance(coefficients, dict):
            coefficients = dict(zip(self.names, coefficients, strict=True))
        x = sum((float(coefficients[n]) * self._z(n, columns) for n in self.names), F.lit(float(self.model["intercept"])))
        return 1 / (1 + F.exp(-F.greatest(F.lit(-40.0), F.least(F.lit(40.0), x))))

    def in_distribution(self, columns: dict[str, Column]) -> Column:
        """At most a few features lie far outside what the model was trained on."""
        most = max(2, math.ceil(0.15 * len(self.names)))
        limit = float(self.model.get("maximum_absolute_z", 5.0))
        far = sum(((F.abs(self._z(n, columns)) > limit).cast("int") for n in self.names if abs(self._of("scales", n, 0.0)) > 1e-12), F.lit(0))
        return far <= most

    def usable(self) -> bool:
        """Whether validation had samples enough and beat the rules."""
        m = self.model.get("validation_metrics") or {}
        n = int(m.get("n_samples", self.model.get("training_samples", 0)) or 0)
        precision, csi = float(m.get("precision", -1.0)), float(m.get("csi", -1.0))
        better = precision >= float(m.get("rules_precision", 0.0)) and csi >= float(m.get("rules_csi", 0.0))
        return n >= int(self.model.get("minimum_validation_samples", 100)) and better and precision >= float(self.model.get("minimum_validation_precision", 0.25))


def cascade(*, distance: Column, age: Column, status: Column, land: Column, rh: Column, shear: Column, vorticity: Column, checks: Column, hybrid: Column, learned: Column | None = None, mode: str = "rules", stale_km: float = 500.0, positive: float = 0.5, high: float = 0.75, negative: float = 0.25) -> Column:
    """(system_class, confidence) of a detection: the first rule that holds. ``learned`` is the gated probability or null,
    ``vorticity`` has its cyclonic sign; without a system distance, age and status are null."""
    p = F.lit(None).cast("double") if learned is None else learned
    s = F.upper(status)
    near = lambda km, h: (distance <= km) & (age <= h)
    held = lambda low, top: F.greatest(F.lit(low), F.least(F.lit(top), hybrid))
    invest = near(650, 48) & s.isin(*INVEST)
    rules = [
        (near(600, 36) & s.isin(*ACTIVE), "ACTIVE_CYCLONE", F.lit(0.95)),
        (near(400, 48) & (s == "DB") & (rh >= 60) & (shear <= 25) & (vorticity >= 7.5e-6), "ACTIVE_DEPRESSION", F.lit(0.90)),
        (invest & (p >= positive), "NEW_GENESIS_CANDIDATE", p),
        (invest & p.isNotNull(), "INVEST_OR_DEVELOPING_SYSTEM", 1 - p),
        (invest & F.lit(mode == "learned"), "INVEST_OR_DEVELOPING_SYSTEM", F.lit(0.50)),
        (invest & (checks >= 4), "NEW_GENESIS_CANDIDATE", held(0.55, 0.95)),
        (invest, "INVEST_OR_DEVELOPING_SYSTEM", held(0.50, 0.85)),
        (near(stale_km, 72) & s.isin(*DECAYING), "RECENT_DECAYING_SYSTEM", F.lit(0.88)),
        (near(stale_km, 72) & s.isin(*ACTIVE), "RECENT_TRACKED_CYCLONE", F.lit(0.82)),
        ((land >= 0.20) & (rh >= 60), "MONSOON_OR_LAND_LOW", F.lit(0.72)),
        (p >= high, "HIGH_PRIORITY_MODEL_GENESIS_CANDIDATE", p),
        (p >= positive, "MODEL_GENESIS_CANDIDATE", p),
        (p <= negative, "LOW_SUPPORT_DISTURBANCE", 1 - p),
        (checks >= 6, "HIGH_PRIORITY_MODEL_GENESIS_CANDIDATE", held(0.70, 0.95)),
        (checks >= 5, "MODEL_GENESIS_CANDIDATE", held(0.62, 0.90)),
        (checks >= 4, "POSSIBLE_MODEL_GENESIS_CANDIDATE", held(0.52, 0.80)),
        ((land <= 0.15) & (rh >= 50) & (vorticity >= 4e-6), "UNVERIFIED_TROPICAL_DISTURBANCE", held(0.40, 0.70)),
    ]
    of = lambda name, value: F.struct(F.lit(name).alias("system_class"), value.cast("double").alias("confidence"))
    out = F.when(rules[0][0], of(rules[0][1], rules[0][2]))
    for condition, name, value in rules[1:]:
        out = out.when(condition, of(name, value))
    return out.otherwise(of("UNCLASSIFIED_DISTURBANCE", F.lit(0.40)))
