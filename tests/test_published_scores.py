"""The registered metrics give the published scores of the census-like fixture (500 real and 500 synthetic rows)."""

import numpy as np
import pandas as pd
import pytest

import gaugework as g
from gaugework.registry import Context

DEGREES, LIMIT = ["HS", "BSc", "MSc", "PhD"], 60_000


def census() -> tuple[pd.DataFrame, pd.DataFrame]:
    """Real rows, and synthetic ones that are the real ones with noise."""
    draw, n = np.random.default_rng(17), 500
    whole = lambda x, lo, hi: np.round(np.clip(x, lo, hi)).astype(int)
    real = {"age": whole(draw.normal(40, 12, n), 18, 90)}
    real["sex"] = draw.choice(["Male", "Female"], size=n, p=[0.55, 0.45])
    real["education"] = draw.choice(DEGREES, size=n, p=[0.4, 0.35, 0.2, 0.05])
    real["hours_per_week"] = whole(draw.normal(40, 8, n), 1, 99)
    extra = np.select([real["education"] == "PhD", real["education"] == "MSc"], [25_000, 12_000], 0)
    real["income"] = np.round(600 * real["age"] + extra + draw.normal(0, 8000, n), 2)
    syn, draw = dict(real), np.random.default_rng(18)
    syn["age"] = whole(real["age"] + draw.normal(0, 1.5, n), 18, 90)
    syn["hours_per_week"] = whole(real["hours_per_week"] + draw.normal(0, 1, n), 1, 99)
    syn["income"] = np.round(real["income"] + draw.normal(0, 1500, n), 2)
    other = draw.random(n) < 0.05
    syn["education"] = real["education"].astype(object)
    syn["education"][other] = draw.choice(DEGREES, size=int(other.sum()))
    return tuple(pd.DataFrame(t | {"high_income": (t["income"] > LIMIT).astype(int)}) for t in (real, syn))


#: Published scores, to the digits given.
CORE = {
    "ci_overlap": 0.986174, "correlation_difference": 0.984061, "dimension_wise_means": 0.997569, "hellinger": 0.967155, "ks_statistic": 0.978000,
    "quantile_mse": 0.959299, "tvd": 0.992000, "wasserstein": 0.978438, "category_coverage": 1.0, "entropy_ratio": 0.965987, "novelty_rate": 1.0,
    "range_coverage": 0.994709, "dcr": 0.320794, "hitting_rate": 0.26, "identical_match_rate": 1.0, "k_anonymity": 0.2, "nndr": 0.446055,
}
#: Metric -> scalar -> without a holdout, euclidean and gower.
DISTANCES = {
    "alpha_precision_beta_recall": {"alpha_precision": (0.996, 0.992), "beta_recall": (1.0, 0.998)}, "authenticity": {"authenticity": (0.972, 0.966)},
    "dcr": {"score": (0.32079, 0.21041), "median_dcr": (0.18146, 0.00776), "p05_dcr": (0.05350, 0.00149)},
    "epsilon_identifiability": {"identifiability_risk": (0.9, 0.888)}, "nn_adversarial_accuracy": {"nn_adversarial_accuracy": (0.102, 0.118)}, "nndr": {"nndr_median": (0.44605, 0.44066)},
}


@pytest.fixture(scope="module")
def pair(spark):
    real, syn = (spark.createDataFrame(t) for t in census())
    meta = g.Metadata.infer(real).override("high_income", dtype="categorical").override("income", sensitive=True)
    for c in ("age", "sex", "education"):
        meta = meta.override(c, quasi_identifier=True)
    return real, syn, meta


@pytest.fixture(scope="module")
def contexts(pair):
    return {d: Context(*pair, distance=d) for d in ("euclidean", "gower")}


@pytest.mark.parametrize("name", sorted(CORE))
def test_core_scores(pair, contexts, name):
    got = g.registry.get(name)(contexts["euclidean"]).compute(*pair)
    assert got.scalars["score"] == pytest.approx(CORE[name], abs=6e-7), got


@pytest.mark.parametrize("name", sorted(DISTANCES))
@pytest.mark.parametrize("distance", ["euclidean", "gower"])
def test_distance_scores(pair, contexts, name, distance):
    got = g.registry.get(name)(contexts[distance]).compute(*pair).scalars
    for scalar, values in DISTANCES[name].items():
        assert got[scalar] == pytest.approx(values[distance == "gower"], abs=6e-6), (scalar, got)
