"""Column expressions for cleaning and feature building."""

from pyspark.sql import functions as F
from pyspark.sql import types as T


def parse_date(col, kind=None):
    """Timestamp, or NULL when the text is not a date."""
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return col
    return F.try_to_timestamp(col.cast("string"))


def parse_number(col):
    """Double, or NULL when the text is not a number; NaN counts as missing."""
    number = col.try_cast("double")
    return F.when(~F.isnan(number), number)


def normalise_status(col):
    """Upper case, without white space at either end."""
    return F.regexp_replace(F.upper(col), r"^\s+|\s+$", "")


def clip_nonnegative(col):
    return F.greatest(F.coalesce(col, F.lit(0.0)), F.lit(0.0))


def prefix_category(col, categories, other):
    """Name of the first category one of whose prefixes starts the code."""
    result = None
    for name, prefixes in categories:
        hit = F.lit(False)
        for prefix in prefixes:
            hit = hit | col.startswith(prefix)
        result = F.when(hit, F.lit(name)) if result is None else result.when(hit, F.lit(name))
    return F.lit(other) if result is None else result.otherwise(F.lit(other))


def right_closed_bins(col, edges, labels):
    """Label of the bin (lo, hi] that holds the value; NULL outside all bins."""
    result = None
    for low, high, label in zip(edges, edges[1:], labels):
        inside = (col > F.lit(float(low))) & (col <= F.lit(float(high)))
        result = F.when(inside, label) if result is None else result.when(inside, label)
    return result


def missing_nan(df):
    """NaN to NULL in every floating column, the form all operators expect."""
    return df.select([
        F.when(~F.isnan(F.col(f.name)), F.col(f.name)).alias(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name)
        for f in df.schema.fields
    ])


def correlation(x, y):
    """Pearson correlation aggregate over the rows with both values.

    NULL for a constant column, where the built-in ``corr`` fails in ANSI mode.
    """
    x, y = x.cast("double"), y.cast("double")
    both = x.isNotNull() & y.isNotNull()
    spread = F.sqrt(F.var_pop(F.when(both, x)) * F.var_pop(F.when(both, y)))
    r = F.try_divide(F.covar_pop(x, y), spread)
    return F.when(F.abs(r) > 1, F.signum(r)).otherwise(r)
