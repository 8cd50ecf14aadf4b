"""Table schemas, required columns and value rules.

Fixed values: column names, bounds and status lists below must equal the
published data contract, so results agree with it.
"""

from pyspark.sql import types as T


def _schema(**columns):
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


S, I, D, TS = T.StringType(), T.IntegerType(), T.DoubleType(), T.TimestampType()

POLICY = _schema(
    policy_id=S, product_code=S, product_name=S, product_category=S, issue_date=TS,
    issue_year=I, issue_month=I, annual_premium=D, payment_term=I, sum_assured=D,
    insured_age=I, region=S, region_type=S, policy_status=S, sales_channel=S, underwriter=S,
)
PREMIUM = _schema(
    policy_id=S, payment_date=TS, premium_amount=D, payment_year=I, payment_period=I,
    payment_status=S,
)
CASH_VALUE = _schema(
    policy_id=S, valuation_date=TS, cash_value=D, year=I, years_passed=I, cumulative_premium=D,
)
DIVIDEND = _schema(
    policy_id=S, dividend_date=TS, dividend_amount=D, year=I, dividend_rate=D,
    cumulative_premium=D,
)
TABLES = {
    "policy": POLICY, "premium": PREMIUM, "cash_value": CASH_VALUE, "dividend": DIVIDEND,
}

CASHFLOW_ANNUAL = _schema(
    policy_id=S, year=I, premium_outflow=D, cash_value_eoy=D, dividend_amount=D,
    cumulative_premium=D, cumulative_dividend=D, net_cashflow=D,
)

REQUIRED_COLUMNS = {
    "policy": ["policy_id", "product_code", "issue_date", "annual_premium", "payment_term",
               "sum_assured", "insured_age", "policy_status"],
    "premium": ["policy_id", "payment_date", "premium_amount"],
    "cash_value": ["policy_id", "valuation_date", "cash_value"],
    "dividend": ["policy_id", "dividend_date", "dividend_amount"],
}

# column -> (minimum, maximum)
RANGE_RULES = {
    "policy": {"annual_premium": (1_000, 10_000_000), "sum_assured": (10_000, 100_000_000),
               "insured_age": (0, 80), "payment_term": (1, 30)},
    "premium": {"premium_amount": (100, 10_000_000)},
    "cash_value": {"cash_value": (0, 100_000_000)},
    "dividend": {"dividend_amount": (0, 10_000_000)},
}

IN_FORCE_STATUSES = ["ACTIVE", "INFORCE", "PAID_UP", "MATURED"]
KNOWN_STATUSES = ["ACTIVE", "LAPSED", "SURRENDERED", "MATURED", "PENDING"]

# (category name, product-code prefixes), first match wins
PRODUCT_CATEGORIES = [
    ("传统寿险", ["TL01", "TL02", "TL03"]),
    ("分红型寿险", ["PA01", "PA02"]),
    ("万能险", ["UL01", "UL02"]),
    ("投连险", ["IL01", "IL02"]),
    ("年金险", ["AN01", "AN02"]),
]
OTHER_CATEGORY = "其他"

AGE_EDGES, AGE_LABELS = [0, 30, 40, 50, 60, 100], ["18-30", "31-40", "41-50", "51-60", "60+"]
COVERAGE_EDGES = [0, 100_000, 500_000, 1_000_000, 5_000_000, float("inf")]
COVERAGE_LABELS = ["<10万", "10-50万", "50-100万", "100-500万", "500万+"]

DEFAULT_PERCENTILES = [0.05, 0.25, 0.5, 0.75, 0.95]


def numeric_columns(df):
    """Names of the columns whose type is numeric (booleans and dates are not)."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def string_columns(df):
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def empty(spark, ddl):
    """The empty result an operator returns when its input lacks a needed column."""
    return spark.createDataFrame([], ddl)
