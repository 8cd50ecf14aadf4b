"""Tail probabilities as expressions on aggregated rows.

The arguments are SQL expressions over the row's columns. The regularised incomplete beta
function is a continued fraction by the modified Lentz method, its number of steps following
the size of the arguments, with log-gamma from Stirling's series after shifting the argument past 10.
"""

from functools import reduce

from pyspark.sql import functions as F

# With more than this many degrees of freedom for each of the numerator's, the law differs from
# its limit by less than 1e-7, and rounding in the fraction by more.
_MOST_RATIO = "1e7"
_HALF_LOG_TWO_PI = "0.9189385332046727D"


def _let(name, values, body):
    """``body`` over ``name``.field values, each computed once however often it is used."""
    fields = ", ".join(f"'{field}', double({value})" for field, value in values.items())
    return f"element_at(transform(array(named_struct({fields})), {name} -> {body}), 1)"


def _stirling(x):
    """log-gamma for x >= 10."""
    rest = f"(1 - 1 / (30 * {x} * {x}) * (1 - 2 / (7 * {x} * {x}) * (1 - 3 / (4 * {x} * {x}))))"
    return f"({x} - 0.5D) * ln({x}) - {x} + {_HALF_LOG_TWO_PI} + {rest} / (12 * {x})"


def _log_gamma(x):
    product = " * ".join(f"(h.x + {i})" for i in range(10))
    return _let("g", {"x": x}, _let(
        "h", {"x": "g.x", "direct": _stirling("g.x"), "above": _stirling("(g.x + 10)")},
        f"CASE WHEN h.x >= 10 THEN h.direct ELSE h.above - ln({product}) END"))


def _log_gamma_ratio(a, b):
    """log(gamma(a + b) / gamma(a)) without the loss of digits at large a."""
    series = ("r.b * ln(r.a) + r.b * (r.b - 1) / (2 * r.a) "
              "- r.b * (r.b - 1) * (2 * r.b - 1) / (12 * r.a * r.a)")
    return _let("r", {"a": a, "b": b}, (
        f"CASE WHEN r.a > 1e5 AND r.b < 1e-2 * r.a THEN {series} "
        f"ELSE {_log_gamma('r.a + r.b')} - {_log_gamma('r.a')} END"))


def _nonzero(x):
    return f"(CASE WHEN abs({x}) < 1e-300 THEN 1e-300 ELSE {x} END)"


def _fraction(x, a, b):
    def pair(source, term):
        """Next denominators after one term of the fraction."""
        return {"c": _nonzero(f"(1 + {term} / {source}.c)"),
                "d": f"1 / {_nonzero(f'(1 + {term} * {source}.d)')}"}

    odd = f"-({a} + m) * ({a} + {b} + m) * {x} / (({a} + 2 * m) * ({a} + 2 * m + 1))"
    even = f"m * ({b} - m) * {x} / (({a} + 2 * m - 1) * ({a} + 2 * m))"
    last = _let("y", {"h": "w.h", **pair("w", "w.odd")},
                "named_struct('c', y.c, 'd', y.d, 'h', y.h * y.c * y.d)")
    second = _let("w", {"odd": "u.odd", "c": "u.c", "d": "u.d", "h": "u.h * u.c * u.d"}, last)
    first = _let("u", {"odd": "e.odd", "h": "e.h", **pair("e", "e.even")}, second)
    step = _let("e", {"even": even, "odd": odd, "c": "s.c", "d": "s.d", "h": "s.h"}, first)
    steps = f"coalesce(try_cast(150 + 4 * sqrt(least({a}, {b})) AS INT), 150)"
    start = f"1 / {_nonzero(f'(1 - ({a} + {b}) * {x} / ({a} + 1))')}"
    return _let("i", {"d": start}, (
        f"aggregate(cast(sequence(1, {steps}) AS array<double>), "
        f"named_struct('c', 1D, 'd', i.d, 'h', i.d), (s, m) -> {step}, s -> s.h)"))


def _incomplete_beta(x, rest, a, b):
    """I_x(a, b), with ``rest`` = 1 - x passed in so that it keeps its digits near x = 1."""
    front = ("exp(k.a * if(k.rest < 0.5D, log1p(-k.rest), ln(k.x)) "
             "+ k.b * if(k.x < 0.5D, log1p(-k.x), ln(k.rest)) + "
             f"{_log_gamma_ratio('greatest(k.a, k.b)', 'least(k.a, k.b)')} - "
             f"{_log_gamma('least(k.a, k.b)')})")
    swap = "k.x >= (k.a + 1) / (k.a + k.b + 2)"
    part = _let("q", {
        "x": f"if({swap}, k.rest, k.x)", "a": f"if({swap}, k.b, k.a)",
        "b": f"if({swap}, k.a, k.b)", "front": front,
    }, f"q.front * {_fraction('q.x', 'q.a', 'q.b')} / q.a")
    value = _let("z", {"part": part}, f"if({swap}, 1 - z.part, z.part)")
    return _let("k", {"x": x, "rest": rest, "a": a, "b": b}, (
        f"CASE WHEN k.x <= 0 THEN 0D WHEN k.rest <= 0 THEN 1D "
        f"WHEN k.x IS NOT NULL THEN {value} END"))


def t_two_sided(t, df):
    """P(|T| >= |t|) for Student's t."""
    return F.expr(_let("o", {"t": t, "df": f"least({df}, {_MOST_RATIO})"}, _incomplete_beta(
        "o.df / (o.df + o.t * o.t)", "o.t * o.t / (o.df + o.t * o.t)", "o.df / 2", "0.5D")))


def f_upper(f, df1, df2):
    """P(F >= f)."""
    return F.expr(_let("o", {"part": f"({df1}) * {f}", "df1": df1,
                             "df2": f"least({df2}, {_MOST_RATIO} * ({df1}))"}, _incomplete_beta(
        "o.df2 / (o.df2 + o.part)", "o.part / (o.df2 + o.part)", "o.df2 / 2", "o.df1 / 2")))


def chi2_upper_2df(x):
    return F.exp(-F.expr(x) / 2)


def normal_upper(z):
    """P(Z >= z) for the standard normal law, as the limit of Student's, to 1e-7."""
    half = 0.5 * t_two_sided(z, "1e7")
    return F.when(F.expr(f"{z} >= 0"), half).when(F.expr(f"{z} < 0"), 1 - half)


# Acklam's published coefficients, highest power first.
_MIDDLE = ((-3.969683028665376e+01, 2.209460984245205e+02, -2.759285104469687e+02,
            1.383577518672690e+02, -3.066479806614716e+01, 2.506628277459239e+00),
           (-5.447609879822406e+01, 1.615858368580409e+02, -1.556989798598866e+02,
            6.680131188771972e+01, -1.328068155288572e+01, 1.0))
_TAIL = ((-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e+00,
          -2.549732539343734e+00, 4.374664141464968e+00, 2.938163982698783e+00),
         (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e+00,
          3.754408661907416e+00, 1.0))


# Hart's (1968) double-precision rational form of the normal law (as given by West,
# 2005), highest power first, and the continued fraction beyond 7.07.
HART_ABOVE = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383,
              112.079291497871, 221.213596169931, 220.206867912376)
HART_BELOW = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461,
              296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)
HART_SWITCH, HART_LIMIT, SQRT_TAU = 7.07106781186547, 37.0, 2.506628274631


def normal_cdf(x):
    """P(Z <= x) for the standard normal law, to about 1e-14 (Hart's form)."""
    def value(x):
        a = F.abs(x)
        tail = F.exp(-a * a / 2)
        near = tail * reduce(lambda acc, c: acc * a + c, HART_ABOVE[1:], F.lit(HART_ABOVE[0])) / reduce(
            lambda acc, c: acc * a + c, HART_BELOW[1:], F.lit(HART_BELOW[0]))
        fraction = reduce(lambda acc, k: a + k / acc, (4, 3, 2, 1), a + 0.65)
        far = tail / fraction / SQRT_TAU
        lower = F.when(a > HART_LIMIT, F.lit(0.0)).when(a < HART_SWITCH, near).otherwise(far)
        return F.when(x > 0, 1 - lower).otherwise(lower)
    return F.element_at(F.transform(F.array(x), value), 1)


def _ratio(x, coefficients):
    above, below = (reduce(lambda sum_, c: sum_ * x + c, rest, F.lit(first))
                    for first, *rest in coefficients)
    return above / below


def normal_quantile(p):
    """Inverse of the standard normal law, to about nine digits."""
    def tail(q):
        return _ratio(F.sqrt(-2 * F.log(q)), _TAIL)

    def value(p):
        d = p - 0.5
        return (F.when(p < 0.02425, tail(p)).when(p > 1 - 0.02425, -tail(1 - p))
                .otherwise(d * _ratio(d * d, _MIDDLE)))
    return F.element_at(F.transform(F.array(p), value), 1)
