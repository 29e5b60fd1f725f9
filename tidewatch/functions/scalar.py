"""Column-expression helpers (all JVM-side, codegen-friendly).

Each helper returns a ``Column`` so callers can use it in ``select`` /
``where`` / ``agg`` and Catalyst keeps it inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference data model.
# Severity ranks of the alert view: critical 1, high 2, medium 3, low 4, anything else 5.
SEVERITY_RANK = {"critical": 1, "high": 2, "medium": 3, "low": 4}
SEVERITY_RANK_OTHER = 5
# Notebook variant of the same order folds every level below medium into 4.
SEVERITY_RANK_NOTEBOOK = {"critical": 1, "high": 2, "medium": 3}
SEVERITY_RANK_NOTEBOOK_OTHER = 4


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_int(c) -> Column:
    """H1: ``int(float(v))`` — parse as double, truncate toward zero.

    Unparsable text, blanks, NaN, infinities and out-of-range values are
    NULL (``try_cast('12.9' as bigint)`` would be NULL, hence the double
    step).
    """
    d = F.expr(f"try_cast(trim(cast({_sql(c)} as string)) as double)")
    ok = d.isNotNull() & ~F.isnan(d) & (F.abs(d) < F.lit(9.2e18))
    return F.when(ok, d.cast("bigint"))


def to_float(c) -> Column:
    """H2: parse as double; unparsable → NULL, NaN → NULL."""
    d = F.expr(f"try_cast(trim(cast({_sql(c)} as string)) as double)")
    return F.when(~F.isnan(d), d)


def bounded_str(c, n: int, legacy_nan_text: bool = False) -> Column:
    """H3: first ``n`` characters; NULL stays NULL unless the legacy
    ``'nan'`` text of the pandas loader is asked for."""
    s = F.substring(_c(c).cast("string"), 1, n)
    return F.coalesce(s, F.lit("nan")) if legacy_nan_text else s


def _sql(c) -> str:
    if isinstance(c, str):
        return f"`{c}`"
    raise TypeError("pass a column name")


def severity_rank(c="severity", notebook: bool = False) -> Column:
    """Priority order of an alert severity."""
    ranks, other = ((SEVERITY_RANK_NOTEBOOK, SEVERITY_RANK_NOTEBOOK_OTHER) if notebook
                    else (SEVERITY_RANK, SEVERITY_RANK_OTHER))
    col = _c(c)
    expr = None
    for k, v in ranks.items():
        expr = F.when(col == k, v) if expr is None else expr.when(col == k, v)
    return expr.otherwise(other)


def round_ratio(num, den, digits: int, scale: int = 1) -> Column:
    """Exact half-up rounding of the rational ``scale·num/den`` to
    ``digits`` decimals, for integer ``num``/``den``.

    Binary floating point turns ties such as 33.335 into 33.33 or 33.34
    depending on the engine; rounding the exact integer ratio is
    identical everywhere.  NULL when ``den`` is 0.
    """
    m = scale * 10 ** digits
    n, d = _c(num).cast("double"), _c(den).cast("double")
    q = F.floor((F.lit(2.0 * m) * n + d) / (F.lit(2.0) * d))
    return F.when(d != 0, q / F.lit(float(10 ** digits)))


def round_ratio_sql(num: str, den: str, digits: int, scale: int = 1) -> str:
    """SQL twin of :func:`round_ratio` (for the DuckDB oracle)."""
    m = scale * 10 ** digits
    return (f"CASE WHEN ({den}) <> 0 THEN floor((CAST({2 * m} AS DOUBLE) * ({num}) + ({den})) "
            f"/ (2.0 * ({den}))) / CAST({10 ** digits} AS DOUBLE) END")


def confidence(pred, proba) -> Column:
    """H7: probability of the predicted side."""
    return F.when(_c(pred) == 1, _c(proba)).otherwise(F.lit(1.0) - _c(proba))


def prob_band(c) -> Column:
    """Probability band 0–40 / 40–70 / 70–100 (percent scale)."""
    p = _c(c) * 100
    return F.when(p < 40, "low").when(p < 70, "medium").otherwise("high")


def sq_dist(a, b) -> Column:
    """Squared Euclidean distance between two numeric arrays."""
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: (x - y) * (x - y)),
                       F.lit(0.0), lambda acc, x: acc + x)


def norm(a) -> Column:
    """Euclidean norm of a numeric array."""
    return F.sqrt(F.aggregate(_c(a), F.lit(0.0), lambda acc, x: acc + x * x))


def nan_to_null(c) -> Column:
    """NaN → NULL for persistence."""
    return F.when(~F.isnan(_c(c)), _c(c))


def json_double(c, path: str) -> Column:
    """H9: tolerant JSON path read; invalid JSON or missing path → NULL.

    A document that was JSON-encoded twice (a JSON string holding JSON)
    is unwrapped once more (trap T20).
    """
    col = _c(c)
    inner = F.when(F.substring(F.trim(col), 1, 1) == '"', F.get_json_object(col, "$")).otherwise(col)
    return F.get_json_object(inner, path).try_cast("double")


def severity_from_confidence(c) -> Column:
    """Alert severity rule (design decision consistent with the
    reference's sample alerts): ≥ .9 critical, ≥ .8 high, ≥ .7 medium,
    else low."""
    x = _c(c)
    return (F.when(x >= 0.9, "critical").when(x >= 0.8, "high")
            .when(x >= 0.7, "medium").otherwise("low"))
