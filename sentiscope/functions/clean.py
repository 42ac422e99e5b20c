"""Column -> Column cleaning and scalar functions (JVM-side, codegen friendly).

Every function takes and returns a ``Column`` so it composes inside one
projection; none of them runs Python per row.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lookups import (
    CATEGORY_ICON,
    DEFAULT_CATEGORY,
    DEFAULT_ICON,
    FORM_FACTOR_TO_CATEGORY,
    LABEL_THRESHOLD,
    NEGATIVE,
    NEUTRAL,
    POSITIVE,
)

# Packed review lists are joined by a double pipe (a regex for ``split``).
SEP = r"\|\|"
# Leading or trailing whitespace, Unicode aware like Python's str.strip().
WS_EDGES = r"(?U)^\s+|\s+$"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _num(s: Column) -> Column:
    """Lenient string -> double: bad or empty text becomes NULL."""
    return s.try_cast("double")


def _first_match(c, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(_c(c).cast("string"), pattern, 1), F.lit(""))


def trim_ws(c) -> Column:
    """P25: strip all leading/trailing whitespace (``trim`` strips spaces only)."""
    return F.regexp_replace(_c(c), WS_EDGES, "")


def price_clean(c) -> Column:
    """Keep digits and dots, then cast; '', '.', '1.2.3' -> NULL."""
    return _num(F.regexp_replace(_c(c), r"[^0-9.]", ""))


def rating_clean(c) -> Column:
    """First run of digits and dots."""
    return _num(_first_match(c, r"([\d.]+)"))


def reviews_count(c) -> Column:
    """Strip every non-digit; a trailing '.0' from a float read is removed first (Q1)."""
    s = F.regexp_replace(_c(c), r"\.0$", "")
    return _num(F.nullif(F.regexp_replace(s, r"[^0-9]", ""), F.lit("")))


def ram_gb(c) -> Column:
    """First integer."""
    return _num(_first_match(c, r"(\d+)"))


def parse_num(c) -> Column:
    """First number (digits, optional dot, digits); '1,299' -> 1.0."""
    return _num(_first_match(c, r"(\d+\.?\d*)"))


def parse_price(c) -> Column:
    """Q2 third variant: drop currency text and thousands separators, keep the number."""
    s = F.regexp_replace(_c(c), r",", "")
    return _num(_first_match(s, r"(\d+\.?\d*)"))


def parse_rev_rating(c) -> Column:
    """Mean of every 'x out of 5' in a packed string; none -> NULL."""
    vals = F.transform(
        F.regexp_extract_all(_c(c), F.lit(r"(\d+\.?\d*)\s*out of 5"), 1),
        lambda x: x.cast("double"),
    )
    total = F.aggregate(vals, F.lit(0.0), lambda acc, x: acc + x)
    return F.when(F.size(vals) > 0, total / F.size(vals))


def packed_len(c) -> Column:
    """Number of items in a packed list, NULL -> 0."""
    return F.when(_c(c).isNull(), F.lit(0)).otherwise(F.size(F.split(_c(c), SEP, -1)))


def packed_len_filled(c, fill: str = "no review") -> Column:
    """Number of items after filling NULL with a placeholder (NULL -> 1)."""
    return F.size(F.split(F.coalesce(_c(c), F.lit(fill)), SEP, -1))


def lenient_double(c) -> Column:
    """P10: ``to_numeric(errors='coerce')``: plain decimal, exponent or infinite numbers; NaN is NULL."""
    s = _c(c).cast("string")
    number = r"(?i)^\s*[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?|inf|infinity)\s*$"
    return F.when(s.rlike(number), _num(F.btrim(F.regexp_replace(s, "(?i)inf(inity)?", "Infinity"))))


def category_of(form_factor) -> Column:
    """P5: NULL -> Other; trimmed, lower-cased lookup in the fixed 33-key table.

    A 33-entry literal map stays inside the projection (no join, no shuffle).
    """
    m = F.create_map(*[F.lit(x) for x in chain.from_iterable(FORM_FACTOR_TO_CATEGORY.items())])
    key = F.lower(trim_ws(_c(form_factor)))
    return F.coalesce(F.element_at(m, key), F.lit(DEFAULT_CATEGORY))


def icon_of(category) -> Column:
    """Category -> icon, default gear."""
    m = F.create_map(*[F.lit(x) for x in chain.from_iterable(CATEGORY_ICON.items())])
    return F.coalesce(F.element_at(m, _c(category)), F.lit(DEFAULT_ICON))


def sentiment_label(c) -> Column:
    """+-0.05 thresholds, inclusive."""
    c = _c(c)
    return (F.when(c >= LABEL_THRESHOLD, F.lit(POSITIVE))
            .when(c <= -LABEL_THRESHOLD, F.lit(NEGATIVE))
            .otherwise(F.lit(NEUTRAL)))


def prefix(c, n: int) -> Column:
    """Display prefix of n code points (presentation only)."""
    return F.substring(_c(c), 1, n)


def pct1(a, b) -> Column:
    """100*a/b rounded half-even to one decimal, exact (NULL when b is 0)."""
    return round_ratio(_c(a).cast("long") * 100, b, 1)


def round_ratio(num, den, digits: int) -> Column:
    """round(num/den, digits) half-even, exact for integer num/den (den > 0; else NULL).

    Computed on |num| with integer remainder arithmetic, then signed, so both
    engines give bit-identical results without floating-point ties.
    """
    num, den = _c(num).cast("long"), _c(den).cast("long")
    scale = 10 ** digits
    n = F.abs(num) * scale
    r = n % den
    q = ((n - r) / den).cast("long")
    up = F.when(r * 2 > den, 1).when((r * 2 == den) & (q % 2 == 1), 1).otherwise(0)
    return F.when(den > 0, F.signum(num) * (q + up) / F.lit(float(scale)))


def e4(c) -> Column:
    """A 4-decimal score as integer ten-thousandths (exact sums)."""
    return F.round(_c(c) * 10000).cast("long")


def avg_e4(c, cond=None) -> Column:
    """Exact mean of a 4-decimal score: sum of ten-thousandths / count / 10000 (NULL if none)."""
    x = e4(c) if cond is None else F.when(cond, e4(c))
    return F.try_divide(F.sum(x), F.count(x)) / F.lit(10000.0)


def safe_share(a, total) -> Column:
    """A / max(total, 1)."""
    return _c(a) / F.greatest(_c(total), F.lit(1))


def mean_or_zero(c) -> Column:
    """Mean with 0.0 for an empty set (an aggregate expression)."""
    return F.coalesce(F.avg(_c(c)), F.lit(0.0))


def round_half_even(c, n: int) -> Column:
    """pandas/Python rounding is half-even; ``round`` is half-up."""
    return F.bround(_c(c), n)


def price_display(c) -> Column:
    """P18: '₹1,299' or N/A."""
    return F.coalesce(F.concat(F.lit("₹"), F.format_number(_c(c).cast("long"), 0)), F.lit("N/A"))


def rating_display(c) -> Column:
    """P18: 'x.y / 5' (one decimal, ties to even) or N/A."""
    return F.when(_c(c).isNotNull(), F.format_string("%.1f / 5", F.bround(_c(c).cast("double"), 1))).otherwise("N/A")


def ram_display(c) -> Column:
    """P18: '8 GB' or N/A."""
    return F.when(_c(c).isNotNull(), F.concat(_c(c).cast("long").cast("string"), F.lit(" GB"))).otherwise("N/A")


def battery_display(c) -> Column:
    """P18: '5000 mAh' or N/A."""
    return F.when(_c(c).isNotNull(), F.concat(_c(c).cast("long").cast("string"), F.lit(" mAh"))).otherwise("N/A")


def rating_bins(c) -> Column:
    """Right-closed bins 0,2,3,4,5.01 (lowest edge included) -> 0..3; out of range -> 1."""
    c = _c(c)
    return (F.when((c >= 0) & (c <= 2), 0)
            .when((c > 2) & (c <= 3), 1)
            .when((c > 3) & (c <= 4), 2)
            .when((c > 4) & (c <= 5.01), 3)
            .otherwise(1))


def sentiment_bins(c) -> Column:
    """Bins 0,2.5,3.5,5.01 -> 0..2; out of range -> 1."""
    c = _c(c)
    return (F.when((c >= 0) & (c <= 2.5), 0)
            .when((c > 2.5) & (c <= 3.5), 1)
            .when((c > 3.5) & (c <= 5.01), 2)
            .otherwise(1))


def blend(a, b, w: float = 0.5) -> Column:
    """Weighted blend of two scores."""
    return F.lit(w) * _c(a) + F.lit(1.0 - w) * _c(b)


def clip0(c) -> Column:
    """max(0, x)."""
    return F.greatest(F.lit(0.0), _c(c))


def bubble_size(c) -> Column:
    """max(400, s^1.85)."""
    return F.greatest(F.lit(400.0), F.pow(_c(c), 1.85))
