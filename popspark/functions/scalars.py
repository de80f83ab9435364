"""Scalar formulas as Column expressions; every argument is a Column or a number."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


# -- maps and qualities ---------------------------------------------------------------------------------------


def haldane(distance) -> Column:
    """Recombination fraction of a map distance in Morgans."""
    return 0.5 * (1 - F.exp(-2 * _c(distance)))


def inverse_haldane(fraction) -> Column:
    return -0.5 * F.log(1 - 2 * _c(fraction))


def phred(p) -> Column:
    return -10 * F.log10(_c(p))


def inverse_phred(q) -> Column:
    return F.pow(F.lit(10.0), -_c(q) / 10)


def signif(x, digits: int = 4) -> Column:
    """Rounded to significant digits; 0 stays 0."""
    x = _c(x)
    scale = F.pow(F.lit(10.0), digits - 1 - F.floor(F.log10(F.abs(x))))
    return F.when(x == 0, F.lit(0.0)).otherwise(F.round(x * scale) / scale)


def abs_error(estimate, truth) -> Column:
    return F.abs(_c(estimate) - _c(truth))


def rel_error(estimate, truth, percent: bool = True) -> Column:
    return F.abs(1 - _c(estimate) / _c(truth)) * (100.0 if percent else 1.0)


def bhat(pi, n) -> Column:
    """Reduction of diversity against 4 N."""
    return _c(pi) / (4 * _c(n))


def percent(x, digits: int = 3) -> Column:
    return F.round(_c(x) * 100, digits)


def implied_ne(pi0, mu) -> Column:
    return _c(pi0) / (4 * _c(mu))


# -- allele counts --------------------------------------------------------------------------------------------


def pairs(n) -> Column:
    n = n.cast("double")
    return n * (n - 1) / 2


def n_same(n_ref: Column, n_alt: Column) -> Column:
    return pairs(n_ref) + pairs(n_alt)


def n_diff(n_ref: Column, n_alt: Column) -> Column:
    return n_ref.cast("double") * n_alt.cast("double")


def pi(same, diff) -> Column:
    """Pairwise diversity; null where nothing was compared."""
    return _c(diff) / F.nullif(_c(same) + _c(diff), F.lit(0.0))


def snp_class(ref: Column, alt: Column) -> Column:
    return F.when(F.concat(ref, alt).isin("AG", "GA", "CT", "TC"), "transition").otherwise("transversion")


# -- text -----------------------------------------------------------------------------------------------------


def parse_region(x: Column) -> Column:
    """Struct (chrom, start, end, strand) of ``chr:start-end`` with an optional strand."""
    pattern = r"^([^:]+):(\d+)-(\d+)([+-]?)$"
    part = lambda k: F.regexp_extract(x, pattern, k)
    return F.struct(part(1).alias("chrom"), part(2).cast("long").alias("start"), part(3).cast("long").alias("end"), F.nullif(part(4), F.lit("")).alias("strand"))


def parse_params(x: Column) -> Column:
    """Map of ``k=v;k=v``."""
    return F.str_to_map(F.ltrim(x, F.lit("#")), F.lit(";"), F.lit("="))


def gc_fraction(seq: Column) -> Column:
    """Share of G and C among the bases that are not N; null for none."""
    count = lambda letters: (F.length(seq) - F.length(F.translate(seq, letters, ""))).cast("double")
    return count("GCgc") / F.nullif(count("ACGTacgt"), F.lit(0.0))


# -- background selection ---------------------------------------------------------------------------------------


def log1mexp(x) -> Column:
    """log(1 - exp(x)) for x < 0, in the stable one of two forms."""
    x = _c(x)
    return F.when(x > -math.log(2), F.log(-F.expm1(x))).otherwise(F.log1p(-F.exp(x)))


def segment_distance(at, start, end) -> Column:
    """Distance to a segment, 0 inside."""
    return F.greatest(_c(start) - _c(at), _c(at) - _c(end), F.lit(0.0))


def classic_terms(rbp, length, t) -> dict[str, Column]:
    """a, b, c, d of the segment's effect a / (b rf^2 + c rf + d) for a mutation rate of 1."""
    length, t = _c(length), _c(t)
    r, keep = _c(rbp) * length, 1 - t
    return {"a": -t * length, "b": keep * keep, "c": 2 * t * keep + r * keep * keep, "d": t * t + r * t * keep}


def classic_effect(terms: dict, rf) -> Column:
    rf = _c(rf)
    return terms["a"] / (terms["b"] * rf * rf + terms["c"] * rf + terms["d"])


def b_segment(mu, sh, length, rbp, rf) -> Column:
    """B of a segment at recombination distance ``rf``."""
    return F.exp(_c(mu) * classic_effect(classic_terms(rbp, length, sh), rf))


def b_within(mu, sh, length, rbp) -> Column:
    """B with recombination only inside the segment."""
    sh = _c(sh)
    x = 1 + (1 - sh) * _c(rbp) / sh
    return F.exp(-_c(length) * _c(mu) / (sh * x * x))


def ratchet_time(sh, ne, u) -> Column:
    """Waiting time of the ratchet; null where it overflows."""
    x = 4 * _c(sh) * _c(ne)
    return F.when(x < 700, F.expm1(x) / (2 * _c(u) * _c(sh) * _c(ne)))


def p_fix(n, s, p0=None) -> Column:
    """Chance that an allele with advantage ``s`` at frequency ``p0`` (default: one copy in 2n) is fixed; ``p0`` itself where s is 0."""
    n, s = _c(n), _c(s)
    begun = s if p0 is None else 2 * n * s * _c(p0)
    neutral = 0.5 / n if p0 is None else _c(p0)
    return F.when(s == 0, neutral).otherwise(F.expm1(-begun) / F.expm1(-2 * n * s))


def _kept(v, vm, rf) -> Column:
    """Share of an association that is left after a generation of new mutations and recombination."""
    return (1 - _c(vm) / _c(v)) * (1 - _c(rf))


def q_asymptotic(v, vm, rf) -> Column:
    """Sum of the association over all generations."""
    return 1 / (1 - _kept(v, vm, rf))


def q_fixed(t, v, vm, rf) -> Column:
    """The same sum over ``t`` generations and the present one."""
    step = F.log(_kept(v, vm, rf))
    return F.when(_c(vm) >= _c(v), 1.0).otherwise(F.expm1((_c(t) + 1) * step) / F.expm1(step))


def ne_asymptotic(v, vm, rf, n) -> Column:
    q = q_asymptotic(v, vm, rf)
    return _c(n) * F.exp(-_c(v) / 2 * q * q)


def pairwise_variance(n=None) -> tuple:
    """Coefficients of theta and theta squared in the variance of pairwise diversity of n sequences (Tajima 1983); limits without n."""
    if n is None:
        return 1 / 3, 2 / 9
    pairs = n * (n - 1)
    return n * (n + 1) / (3 * pairs), 2 * (n * (n + 1) + 3) / (9 * pairs)


def b_variance_limit(b, r=1.0, n_pop=None, n=None) -> Column:
    """Sampling variance of B = diversity / (4 n_pop) over ``r`` windows; infinite population and sample by default."""
    linear, quadratic = pairwise_variance(n)
    drift = 0.0 if n_pop is None else linear / (4 * n_pop)
    return _c(b) * (quadratic * _c(b) + drift) / _c(r)


def correlation(x: str, y: str) -> Column:
    """Pearson's correlation of complete pairs as an aggregate; null where either column does not vary."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = (F.when(both, F.col(c).cast("double")) for c in (x, y))
    return F.covar_pop(a, b) / F.nullif(F.sqrt(F.var_pop(a) * F.var_pop(b)), F.lit(0.0))
