"""Plain descriptions of the dimensions and metrics: what a metric asks of the tables, and how to read its raw values."""

from __future__ import annotations

DIMENSION_TEXTS = {
    "congruence": "Distributions of columns, and relations between them, compared with the real table's.",
    "coverage": "How much of the real table's variety the synthetic rows reach, and how new they are.",
    "compliance": "How little the synthetic rows give away about single real rows.",
    "fairness": "Whether outcomes differ between groups as much as in the real table.",
    "preservation": "Whether rare labels, tails and small groups survive.",
    "utility": "Whether models learned from synthetic rows work on real ones.",
}

#: metric -> (what it asks, how its raw values read)
METRIC_TEXTS = {
    "ks_statistic": ("Largest gap between the cumulative distributions of a number.", "0 is no gap, 1 is no overlap"),
    "tvd": ("Share of labels that would have to change for equal frequencies.", "0 is equal, 1 is disjoint"),
    "wasserstein": ("Mean way that numbers must move to be distributed like the real ones.", "in real standard deviations, at most 1 a column; 0 is equal"),
    "correlation_difference": ("Change of the association between two columns, of any types.", "0 is unchanged"),
    "pmse": ("How far a propensity model moves from the share that chance gives.", "ratio to permuted labels; 1 is chance, more is separable"),
    "ci_overlap": ("Overlap of the intervals of a column's mean on both sides.", "1 is the same interval, 0 is none in common"),
    "hellinger": ("Distance between the square roots of two distributions of one column.", "0 is equal, 1 is disjoint"),
    "quantile_mse": ("Squared gaps between the quantiles of both sides, tails included.", "less is closer"),
    "dimension_wise_means": ("Gap between the means of a number.", "in real standard deviations; 0 is equal"),
    "sliced_wasserstein": ("Distance of whole rows, averaged over random directions.", "less is closer"),
    "jsd": ("Information by which the label frequencies of both sides differ.", "in bits; 0 is equal, 1 is disjoint"),
    "c2st": ("How well a classifier tells synthetic rows from real ones.", "an area of 0.5 is chance, 1 is certainty"),
    "mutual_information_difference": ("Change of the information that two columns share, linear or not.", "0 is unchanged"),
    "mmd": ("Distance between the kernel means of both tables.", "0 is no measurable difference"),
    "category_coverage": ("Share of the real labels that occur among synthetic ones.", "1 is all of them"),
    "range_coverage": ("Share of the real range that synthetic numbers span.", "1 is the whole range"),
    "novelty_rate": ("Share of synthetic rows equal to no real row.", "1 is no copy"),
    "entropy_ratio": ("Entropy of synthetic labels as a share of the real one.", "1 is as varied, less is poorer"),
    "alpha_precision_beta_recall": ("Whether synthetic rows lie where real ones do, and reach all of those places.", "both are 1 at best"),
    "authenticity": ("Share of synthetic rows further from any real row than a twentieth of the usual gap between real rows.", "1 is no near-copy"),
    "pca_scatter": ("Both tables on the first two principal axes of the real one.", "to look at; it has no score"),
    "nn_adversarial_accuracy": ("How often a row's nearest neighbour is from its own table.", "0.5 is best; less is memorised, more is apart"),
    "dcr": ("Distance from synthetic rows to the closest real row.", "more is safer; compare with the holdout's where given"),
    "nndr": ("Closest distance over the second closest, from synthetic to real rows.", "near 0 singles one real row out"),
    "k_anonymity": ("Synthetic rows in the smallest group alike in all quasi-identifiers.", "1 is a unique row; more is safer"),
    "identical_match_rate": ("Share of synthetic rows equal to a real row.", "0 is no copy"),
    "hitting_rate": ("Share of real rows with a synthetic row nearly alike in every column.", "0 is no hit"),
    "epsilon_identifiability": ("Share of real rows closer to a synthetic row than to any other real one.", "less is safer"),
    "attribute_disclosure": ("Share of real rows whose sensitive values the nearest synthetic row gives away.", "less is safer"),
    "mia_auc": ("How well distance to the synthetic rows tells training rows from a holdout.", "0.5 is chance, 1 is certainty"),
    "dp_ledger": ("Privacy budget that the generator's maker states.", "a smaller epsilon is a stronger promise; not verified"),
    "statistical_parity": ("Change of the gap between groups' rates of the favourable outcome.", "0 is unchanged"),
    "rare_category_retention": ("Share of the rare real labels that still occur.", "1 is all of them"),
    "tail_coverage": ("Share of numbers beyond the real tails' bounds, compared with the real share.", "1 is the same weight, 0 is cut tails"),
    "minority_class_density": ("Frequency of the rarest real label, synthetic over real.", "1 is the same frequency"),
    "subgroup_fidelity": ("Whether a named group keeps its share of the rows and its distributions.", "1 is unchanged"),
    "minority_utility_gap": ("Utility over all rows less that inside a named group.", "0 is no loss in the group"),
    "minority_privacy_risk": ("Closeness of synthetic rows to real ones inside a group, against outside.", "a risk no higher than outside is best"),
    "tstr_suite": ("Score of a model from synthetic rows over that of one from real rows, both on real test rows.", "1 is as useful"),
    "multi_target_utility": ("That ratio for every column that can be a target.", "1 is as useful"),
    "model_panel_utility": ("That ratio for several kinds of models.", "1 is as useful"),
    "feature_importance_spearman": ("Rank correlation of the features' importance in both models.", "1 is the same order, -1 its reverse"),
    "discriminative_score": ("How far above chance a forest tells the tables apart.", "an area of 0.5 is chance, 1 is certainty"),
}


def about(metric: str) -> str:
    """What a metric asks; empty for a metric of the user's."""
    return METRIC_TEXTS.get(metric, ("", ""))[0]


def reading(metric: str) -> str:
    """How the raw values of a metric read; empty for a metric of the user's."""
    return METRIC_TEXTS.get(metric, ("", ""))[1]
