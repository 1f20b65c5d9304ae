"""Feature encoders and label rules as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Phase names and the places they set of (N/A, 1, 2, 3, 4).
PHASES = {
    "N/A": [0],
    "Early Phase 1": [1],
    "Phase 1": [1],
    "Phase 1/Phase 2": [1, 2],
    "Phase 2": [2],
    "Phase 2/Phase 3": [2, 3],
    "Phase 3": [3],
    "Phase 4": [4],
}
# The sexes, in the order of their places.
SEXES = ["All", "Male", "Female"]


def one_hot(c: Column, values: list) -> Column:
    return F.array(*[F.when(c == F.lit(v), 1.0).otherwise(0.0) for v in values])


def multi_hot(values: Column, vocabulary: list) -> Column:
    return F.array(*[F.when(F.array_contains(values, F.lit(v)), 1.0).otherwise(0.0) for v in vocabulary])


def phase_vector(phase: Column) -> Column:
    """Five places; null for an unknown phase, which checks can count."""
    known = [F.lit(p) for p in PHASES]
    vector = F.array(*[F.when(phase.isin([p for p, at in PHASES.items() if k in at]), 1.0).otherwise(0.0) for k in range(5)])
    return F.when(phase.isin(known), vector)


def phase_bounds(phase: Column) -> Column:
    """(lower, upper) phase number of "Phase 1/Phase 2" and the like."""
    digits = F.transform(F.regexp_extract_all(phase, F.lit(r"Phase (\d)"), F.lit(1)), lambda x: x.cast("int"))
    return F.struct(F.array_min(digits).alias("lower"), F.array_max(digits).alias("upper"))


def sex_vector(sex: Column) -> Column:
    return F.when(sex.isNull(), F.array(*[F.lit(0.0)] * 3)).otherwise(one_hot(sex, SEXES))


def enrollment_vector(count: Column, kind: Column) -> Column:
    """(ln(1 + n), anticipated); zeros if unknown."""
    return F.array(F.coalesce(F.log1p(count.cast("double")), F.lit(0.0)), F.when(count.isNotNull() & (kind == "Anticipated"), 1.0).otherwise(0.0))


def age_vector(age: Column) -> Column:
    """(not given, years, months, days). Weeks count as quarters of a month, cut; one Week or Month as days; hours and minutes as days."""
    value, unit = F.split_part(age, F.lit(" "), F.lit(1)).try_cast("int"), F.split_part(age, F.lit(" "), F.lit(2))
    missing = age.isNull() | (age == "N/A")
    number = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    years = F.when(unit == "Years", value)
    months = F.when(unit == "Months", value).when(unit == "Year", value * 12).when(unit == "Weeks", F.floor(value / 4))
    days = F.when(unit == "Month", F.lit(30)).when(unit == "Week", F.lit(7)).when(unit.isin("Days", "Day"), value).when(unit.isin("Hours", "Hour"), value / 24).when(unit == "Minutes", value / 1440)
    return F.array(F.when(missing, 1.0).otherwise(0.0), *[number(F.when(~missing, c)) for c in (years, months, days)])


def age_classes(least: Column, most: Column) -> Column:
    """(child, adult, older adult) of an age range; a bound that isn't given is a day or 130 years, one not in years counts as 1."""
    years = lambda c, missing: F.when(c.isNull() | (c == "N/A"), missing).when(F.split_part(c, F.lit(" "), F.lit(2)) == "Years", F.split_part(c, F.lit(" "), F.lit(1)).try_cast("int")).otherwise(1)
    low, high = years(least, 1), years(most, 130)
    return F.array(*[F.when(c, 1.0).otherwise(0.0) for c in ((low <= 17) | (high <= 17), (high > 17) & (low <= 64) | (high > 17) & (high <= 64), high > 64)])


def softmaxed(v: Column) -> Column:
    """exp of each entry over their sum, the largest taken off first."""
    e = F.transform(v, lambda x: F.exp(x - F.array_max(v)))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def complete_year(primary: Column, end: Column) -> Column:
    """The primary completion year, or the end year where that is 0."""
    return F.when(primary == 0, end).otherwise(primary)


def frequency_class(p: Column) -> Column:
    """1 to 5 by decades of the percentage from 0.01 on; no value gets class 0, as in the published evaluation."""
    percent = p * 100
    return F.when(percent < 0.01, 1).when(percent < 0.1, 2).when(percent < 1, 3).when(percent < 10, 4).otherwise(5)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def log_sigmoid(x: Column) -> Column:
    """Stable for large |x|."""
    return F.least(x, F.lit(0.0)) - F.log1p(F.exp(-F.abs(x)))


def binary_cross_entropy(logit: Column, y: Column, pos_weight: Column | float = 1.0) -> Column:
    w = pos_weight if isinstance(pos_weight, Column) else F.lit(float(pos_weight))
    return -(w * y * log_sigmoid(logit) + (1 - y) * log_sigmoid(-logit))
