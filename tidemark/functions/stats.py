"""Small numeric helpers: normal quantiles as a SQL expression and
distribution tails evaluated on small result tables."""

from __future__ import annotations

import math
from statistics import NormalDist

_N = NormalDist()


# Numerators and denominators of Wichura (1988), algorithm AS 241, from the
# highest power down: the middle, up to 5 in sqrt(-log tail), beyond.
_PPF = (((2.5090809287301226727e+3, 3.3430575583588128105e+4, 6.7265770927008700853e+4, 4.5921953931549871457e+4,
          1.3731693765509461125e+4, 1.9715909503065514427e+3, 1.3314166789178437745e+2, 3.3871328727963666080e+0),
         (5.2264952788528545610e+3, 2.8729085735721942674e+4, 3.9307895800092710610e+4, 2.1213794301586595867e+4,
          5.3941960214247511077e+3, 6.8718700749205790830e+2, 4.2313330701600911252e+1, 1.0)),
        ((7.74545014278341407640e-4, 2.27238449892691845833e-2, 2.41780725177450611770e-1, 1.27045825245236838258e+0,
          3.64784832476320460504e+0, 5.76949722146069140550e+0, 4.63033784615654529590e+0, 1.42343711074968357734e+0),
         (1.05075007164441684324e-9, 5.47593808499534494600e-4, 1.51986665636164571966e-2, 1.48103976427480074590e-1,
          6.89767334985100004550e-1, 1.67638483018380384940e+0, 2.05319162663775882187e+0, 1.0)),
        ((2.01033439929228813265e-7, 2.71155556874348757815e-5, 1.24266094738807843860e-3, 2.65321895265761230930e-2,
          2.96560571828504891230e-1, 1.78482653991729133580e+0, 5.46378491116411436990e+0, 6.65790464350110377720e+0),
         (2.04426310338993978564e-15, 1.42151175831644588870e-7, 1.84631831751005468180e-5, 7.86869131145613259100e-4,
          1.48753612908506148525e-2, 1.36929880922735805310e-1, 5.99832206555887937690e-1, 1.0)))


def norm_ppf_sql(p: str) -> str:
    """The standard normal quantile of a SQL expression, to about 16 digits; null outside
    (0, 1). Arithmetic only, so it stays inside generated code."""
    def lit(c: float) -> str:
        return f"CAST('{c!r}' AS DOUBLE)"

    def ratio(k: int, r: str) -> str:
        num, den = ("".join("(" * 7) + lit(c[0]) + "".join(f" * {r} + {lit(x)})" for x in c[1:]) for c in _PPF[k])
        return f"(({num}) / ({den}))"
    mid = f"({p} - {lit(0.5)})"
    tail = f"sqrt(-ln(least({p}, 1 - {p})))"
    far = f"CASE WHEN {tail} <= 5 THEN {ratio(1, f'({tail} - {lit(1.6)})')} ELSE {ratio(2, f'({tail} - {lit(5.0)})')} END"
    middle = f"({lit(0.180625)} - {mid} * {mid})"
    return (f"CASE WHEN {p} <= 0 OR {p} >= 1 THEN NULL WHEN abs({mid}) <= {lit(0.425)} THEN {mid} * {ratio(0, middle)} "
            f"WHEN {mid} < 0 THEN -({far}) ELSE {far} END")


def norm_cdf(x: float) -> float:
    return _N.cdf(x)


def chi2_sf(x: float, k: float) -> float:
    """Upper tail of chi-square(k): regularised upper incomplete gamma
    Q(k/2, x/2) (series for small x, continued fraction otherwise)."""
    if x <= 0:
        return 1.0
    a, z = k / 2.0, x / 2.0
    gln = math.lgamma(a)
    if z < a + 1:
        s, term, n = 1.0 / a, 1.0 / a, a
        for _ in range(1000):
            n += 1
            term *= z / n
            s += term
            if abs(term) < abs(s) * 1e-15:
                break
        return max(0.0, 1.0 - s * math.exp(-z + a * math.log(z) - gln))
    b, c, d = z + 1 - a, 1e300, 1.0 / (z + 1 - a)
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = an * d + b
        d = 1e-300 if abs(d) < 1e-300 else d
        c = b + an / c
        c = 1e-300 if abs(c) < 1e-300 else c
        d = 1.0 / d
        de = d * c
        h *= de
        if abs(de - 1.0) < 1e-15:
            break
    return math.exp(-z + a * math.log(z) - gln) * h


def digamma_sql(n: str) -> str:
    """Digamma of a SQL expression that is 1 or more: ten steps up, then the asymptotic
    series (error under 1e-12)."""
    z = f"({n} + 10)"
    steps = " - ".join(f"1 / ({n} + {j})" for j in range(10))
    return (f"(ln({z}) - 1 / (2 * {z}) - 1 / (12 * {z} * {z}) + 1 / (120 * pow({z}, 4)) "
            f"- 1 / (252 * pow({z}, 6)) + 1 / (240 * pow({z}, 8)) - {steps})")
