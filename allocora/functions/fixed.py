"""Labels, orders, thresholds and lookup entries that results depend on."""

# Tier codes, their labels and orders.
TIER_LABELS = {
    "L": "Low",
    "LM": "Lower-middle",
    "UM": "Upper-middle",
    "H": "High",
}
TIER_INCOME_LABELS = {
    "L": "low-income",
    "LM": "lower-middle-income",
    "UM": "upper-middle-income",
    "H": "high-income",
}
TIER_ORDER = ("L", "LM", "UM", "H")
HEADLINE_TIERS = ("L", "LM")
TIER_REFERENCE = "L"

# Allocation profiles, from the lowest score quartile to the highest.
PROFILES = (
    "Chronically Underfunded",
    "Underfunded",
    "Adequately Funded",
    "Over-Resourced",
)

# Thresholds.
THIN_PERIODS = 5
MIN_HISTORY = 5
SIGNIFICANCE = 0.05
CI_Z = 1.96
DIRECTION_PCT = 1.0
ABS_GAP_SLOPE = 0.01
HEADLINE_MEAN = 0.5
CONCENTRATION_TOP = 15
TOP_KS = (5, 10, 15, 20, 30)
STARS = ((0.001, "***"), (0.01, "**"), (0.05, "*"))

# Lines of the facts block, in order.
FACT_LINES = {
    "unit": "{unit_word}: {name} (region: {region})",
    "profile": "Funding profile: {profile}",
    "score": "Mean misallocation residual: {score} (negative means it receives less {outcome_word} than the model predicts)",
    "rank": "Within its {tier} income tier, ranks {rank} of {rank_of} by misallocation (1 = most underfunded)",
    "need": "Mean {need_word}: {need}",
    "outcome": "Mean annual {outcome_word} observed: ${outcome} million over {periods} years",
    "thin": "Data caveat: based on only one or two years, so figures are uncertain.",
    "region": "Regional gap for {region} is {status}: {gap_base} in {base}, projected to {gap_horizon} by {horizon}.",
    "projection": "If its {first} to {base} trend holds, {outcome_word} is projected near ${projected} million by {horizon} "
    "({change}% vs {base}, {annual}% per year, trend {significance}).",
}

# Sentences of the unit summary.
SUMMARY_SENTENCES = {
    "profile": "**{name}** is **{profile}**.",
    "rank": "Its {outcome_word} sits {distance} log units {side} the model's prediction, "
    "ranking {rank} of {rank_of} in the {tier} tier{extreme}.",
    "need": "Average {need_word} over {periods} years is {need}.",
    "thin": "Based on only one or two years, so read with caution.",
    "lowest": " (the most underfunded in its tier)",
    "highest": " (the most over-resourced in its tier)",
    "alone": "{name} is the only sampled country in **{region}**, so no regional comparison is available.",
    "region": "Across the {region_n} sampled countries in **{region}**, the average misallocation is {region_mean} ({region_side} overall).",
    "share": " {below} of them fall below the model line, and",
    "gap": " {name} runs {gap} log units {relation} that regional average.",
}
REGION_SHARE_MIN_UNITS = 5

# Where a unit lies among the others.
POSITION_TEXTS = {
    "below": ("More underfunded than ", " of countries"),
    "above": ("Better funded than ", " of countries"),
    "on": "Right on the model line",
}

# Words for how a trend, a gap and the size of a gap move.
DIRECTION_WORDS = ("Rising", "Falling", "Flat")
GAP_WORDS = ("closing", "widening", "flat")
ABS_GAP_WORDS = ("Too few years", "Narrowing", "Widening", "Steady")
MAP_MARKER = "thin data"

# Words of the colour scale's ticks.
SCALE_WORDS = {
    "zero": "as predicted",
    "lowest": "far below predicted",
    "highest": "far above predicted",
    "below": "below predicted",
    "above": "above predicted",
}

# Headlines of a unit's trajectory.
TRAJECTORY_HEADLINES = {
    "low": "{name} has been persistently underfunded",
    "high": "{name} has been consistently over-resourced",
    "middle": "{name} tracks the model closely",
}
