"""Interval cuts as Column expressions (JVM-side ``CASE WHEN`` chains).

Spark's ``Bucketizer`` and ``width_bucket`` are left-closed; the reference's
cuts are right-closed ``(lo, hi]`` with null outside, so the chain is spelled out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference's (edges and labels, in order).
AGE_EDGES = (0, 30, 40, 50, 100)
AGE_LABELS = ("Young", "Middle", "Senior", "Elderly")
INCOME_EDGES = (0, 40, 70, 100, 150)
INCOME_LABELS = ("Low", "Medium", "High", "Very High")
SCORE_EDGES = (0, 30, 50, 70, 100)
CATEGORY_LABELS = ("Low", "Medium", "High", "Very High")
SEGMENT_LABELS = ("Low Spender", "Medium Spender", "High Spender", "VIP")
THRESHOLD_LABELS = ("Low Spender", "Medium Spender", "High Spender", "VIP Spender")
THRESHOLD_CUTS = (30, 50, 70)

LABEL_SETS = {
    "category": CATEGORY_LABELS,   # Low / Medium / High / Very High
    "segment": SEGMENT_LABELS,     # ... / VIP
    "threshold": THRESHOLD_LABELS,  # ... / VIP Spender
}


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def band_index(c, edges: Sequence[float], open_ends: bool = False) -> Column:
    """0-based index of the right-closed band ``(edges[i], edges[i+1]]``.

    Outside all bands the index is null; with ``open_ends`` the first band
    takes everything at or below ``edges[1]`` and the last everything above
    ``edges[-2]`` (the single-customer rule).
    """
    x = _col(c)
    k = len(edges) - 1
    expr = None
    for i in range(k):
        lo, hi = edges[i], edges[i + 1]
        if open_ends and i == 0:
            cond = x <= F.lit(hi)
        elif open_ends and i == k - 1:
            cond = x > F.lit(lo)
        else:
            cond = (x > F.lit(lo)) & (x <= F.lit(hi))
        expr = F.when(cond, F.lit(i)) if expr is None else expr.when(cond, F.lit(i))
    return expr


def threshold_index(c, cuts: Sequence[float] = THRESHOLD_CUTS) -> Column:
    """Left-closed thresholds: ``x < cuts[0]`` -> 0, ..., else len(cuts). Null stays null."""
    x = _col(c)
    expr = None
    for i, t in enumerate(cuts):
        expr = F.when(x < F.lit(t), F.lit(i)) if expr is None else expr.when(x < F.lit(t), F.lit(i))
    return F.when(x.isNull(), F.lit(None)).otherwise(expr.otherwise(F.lit(len(cuts))))


def label_of(index: Column, labels: Sequence[str]) -> Column:
    """Map a band index to its label (null index -> null label)."""
    expr = None
    for i, lab in enumerate(labels):
        expr = F.when(index == F.lit(i), F.lit(lab)) if expr is None else expr.when(index == F.lit(i), F.lit(lab))
    return expr


def cut(c, edges: Sequence[float], labels: Sequence[str], open_ends: bool = False) -> Column:
    """Right-closed cut with labels, like ``pd.cut(x, edges, labels=labels)``."""
    return label_of(band_index(c, edges, open_ends), labels)


def age_group(c="age", open_ends: bool = False) -> Column:
    return cut(c, AGE_EDGES, AGE_LABELS, open_ends)


def income_group(c="annual_income_k", open_ends: bool = False) -> Column:
    return cut(c, INCOME_EDGES, INCOME_LABELS, open_ends)


def score_band(c, labels: str | Sequence[str] = "segment") -> Column:
    """Spending category / segment of a (predicted) score, right-closed, null outside (0, 100]."""
    labs = LABEL_SETS[labels] if isinstance(labels, str) else labels
    return cut(c, SCORE_EDGES, labs)


def score_threshold(c, labels: str | Sequence[str] = "threshold") -> Column:
    """Left-closed category of a score; never null for a non-null score."""
    labs = LABEL_SETS[labels] if isinstance(labels, str) else labels
    return label_of(threshold_index(c), labs)


def round_frac(c, precision: int = 3) -> Column:
    """Round to ``precision`` decimals, or for 0 < |x| < 1 to ``precision`` digits
    after the first significant one (how ``pd.cut`` rounds interval edges for text).
    Half-even, as NumPy rounds."""
    x = _col(c)
    digits = (-F.floor(F.log10(F.abs(x))) - 1 + F.lit(precision)).cast("int")
    scale = F.pow(F.lit(10.0), digits)
    return (F.when((x == 0) | (F.abs(x) >= 1), F.bround(x, precision))
            .otherwise(F.bround(x * scale, 0) / scale))


def interval_label(lo: Column, hi: Column) -> Column:
    """Text of a right-closed interval, ``(lo, hi]``."""
    return F.concat(F.lit("("), lo.cast("string"), F.lit(", "), hi.cast("string"), F.lit("]"))
