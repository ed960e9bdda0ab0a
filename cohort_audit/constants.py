"""Fixed values of the audit."""

# Sample sizes
SUPPRESS_N, FLAG_N, WARNING_N, ADEQUATE_N, SUBGROUP_N, CALIBRATION_N = 5, 10, 30, 50, 100, 20
# Resampling
N_BOOTSTRAP, N_BOOTSTRAP_SUBGROUP, SEED, MIN_SAMPLES, ALPHA = 1000, 500, 42, 10, 0.05
# Fairness thresholds
DP_RATIO, EO_DIFF, EQUAL_OPPORTUNITY_DIFF, CALIBRATION_DIFF, PPV_RATIO = (0.8, 1.25), 0.1, 0.1, 0.05, (0.8, 1.25)
# Performance thresholds
MIN_AUROC, MAX_MISSING, THRESHOLD = 0.65, 0.10, 0.5
# Calibration
BINS, SLOPE_LOW, SLOPE_HIGH, BRIER_POOR, CLIP = 10, 0.8, 1.2, 0.25, 1e-7
# Disparity index: weights and limits of its bands
INDEX_WEIGHTS = {"demographic_parity": 0.2, "equal_opportunity": 0.3, "equalized_odds": 0.3, "predictive_parity": 0.2}
INDEX_BANDS = (0.25, 0.5, 0.75)
# Standard normal quantile at 0.975
Z = 1.959963984540054
# Thresholds of a decision curve: 99 numbers evenly from 0.01 to 0.99; of a sweep: 0.1 to 0.9
SWEEP = tuple(round(0.1 * i, 1) for i in range(1, 10))


def curve_thresholds() -> list[float]:
    """The 99 thresholds from 0.01 to 0.99, each the double nearest to its place on the line."""
    step = (0.99 - 0.01) / 98
    return [0.01 + i * step for i in range(98)] + [0.99]


OVERALL = "_overall"
