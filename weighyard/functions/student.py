"""Two-sided p-value of Student's t for whole degrees of freedom, as an expression.

Finite sums from Abramowitz & Stegun, Handbook of Mathematical Functions, 26.7.3 and
26.7.4; they need no special functions, so the value is computed inside the JVM.
"""

from math import pi


def _series(cos_sq, terms, first, step):
    """Sum of `terms` members; member k is member k-1 times `step` (in k) times cos_sq."""
    return (
        f"aggregate(sequence(1, {terms}), named_struct('term', {first}, 'total', 0.0D), "
        f"(acc, k) -> named_struct('term', acc.term * {cos_sq} * {step}, 'total', acc.total + acc.term), "
        f"acc -> acc.total)"
    )


def two_sided_p(t, dof):
    """P(|T| >= |t|) for integer `dof` >= 1."""
    theta = f"atan(abs({t}) / sqrt(CAST({dof} AS DOUBLE)))"
    sin, cos = f"sin({theta})", f"cos({theta})"
    cos_sq, k = f"({cos} * {cos})", "CAST(k AS DOUBLE)"
    even = f"{sin} * " + _series(cos_sq, f"CAST({dof} / 2 AS INT)", "1.0D", f"((2 * {k} - 1) / (2 * {k}))")
    odd_sum = _series(cos_sq, f"CAST(({dof} - 1) / 2 AS INT)", cos, f"((2 * {k}) / (2 * {k} + 1))")
    odd = f"({theta} + {sin} * {odd_sum}) * {2 / pi!r}D"
    inside = f"CASE WHEN {dof} = 1 THEN {theta} * {2 / pi!r}D WHEN {dof} % 2 = 0 THEN {even} ELSE {odd} END"
    return f"greatest(0.0D, 1 - {inside})"


def slope_p_value(r, n):
    """p-value of a least-squares slope from its correlation and the number of points.

    A perfect fit gives 0 and a missing correlation (constant values) gives 1; fewer than
    three points have none.
    """
    dof = f"(CAST({n} AS INT) - 2)"
    t = f"({r} * sqrt({dof} / (1 - {r} * {r})))"
    return (f"CASE WHEN {n} < 3 THEN NULL WHEN {r} IS NULL THEN 1.0D "
            f"WHEN 1 - {r} * {r} <= 0 THEN 0.0D ELSE {two_sided_p(t, dof)} END")
