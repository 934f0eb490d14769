"""Weights across time and across documents."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

WITHIN = ("counts", "proportional", "proportionalPol", "proportionalSquareRoot", "UShaped", "inverseUShaped", "exponential", "inverseExponential", "TFIDF")
DOCS = ("equal_weight", "proportional", "inverseProportional", "exponential", "inverseExponential")
TIME = ("equal_weight", "almon", "beta", "linear", "exponential", "own")


def options() -> dict[str, tuple[str, ...]]:
    """All weighting schemes by level."""
    return {"words": WITHIN, "docs": DOCS, "time": TIME}


def _scaled(values: list[float], normalize: bool = True) -> list[float]:
    total = sum(values)
    return [v / total for v in values] if normalize and total else values


def name(x: float) -> str:
    return f"{x:g}"


def exponential(n: int, alphas: Sequence[float] = (0.1, 0.2, 0.3, 0.4, 0.5), inverse: bool = False, normalize: bool = True) -> dict[str, list[float]]:
    """exp(10 alpha (i/n - 1)); the inverse curves weigh the oldest most.  The first weight is of the most lagged place."""
    if n < 1 or any(not 0 < a <= 1 for a in alphas):
        raise ValueError("alphas must lie in (0, 1] and n be positive")
    out = {f"exponential{name(a)}": _scaled([math.exp(10 * a * (i / n - 1)) for i in range(1, n + 1)], normalize) for a in alphas}
    if inverse:
        out |= {f"exponential{name(a)}_inv": _scaled([math.exp(10 * a * (1 - i / n)) for i in range(1, n + 1)], normalize) for a in alphas}
    return out


def almon(n: int, orders: Sequence[int] = (1, 2, 3), inverse: bool = True, normalize: bool = True) -> dict[str, list[float]]:
    """Almon polynomials of the given orders, each with its mirrored one."""
    if min(orders) <= 0:
        raise ValueError("orders must be positive")
    top, out = max(orders), {}
    for r in orders:
        for suffix, flip in (("", False), *((("_inv", True),) if inverse else ())):
            x = [i / n for i in range(1, n + 1)]
            x = [1 - v for v in x] if flip else x
            out[f"almon{name(r)}{suffix}"] = [1.0] if n == 1 else _scaled([(1 - (1 - v) ** r) * (1 - v) ** (top - r) for v in x], normalize)
    return out


def beta(n: int, a: Sequence[float] = (1, 2, 3, 4), b: Sequence[float] = (1, 2, 3, 4), normalize: bool = True) -> dict[str, list[float]]:
    """Beta densities at i/n for all pairs of parameters."""
    if min(*a, *b) <= 0:
        raise ValueError("parameters must be positive")
    out = {}
    for p in a:
        for q in b:
            k = math.gamma(p + q) / (math.gamma(p) * math.gamma(q))
            out[f"beta{name(p)}{name(q)}"] = [1.0] if n == 1 else _scaled([(i / n) ** (p - 1) * (1 - i / n) ** (q - 1) * k for i in range(1, n + 1)], normalize)
    return out


def time_weights(how: Sequence[str], lag: int, alphas: Sequence[float] = (0.1,), inverse_exp: bool = False, orders: Sequence[int] = (1, 2, 3), inverse_almon: bool = True,
                 a: Sequence[float] = (1, 2, 3, 4), b: Sequence[float] = (1, 2, 3, 4), own: Mapping[str, Sequence[float]] | None = None) -> dict[str, list[float]]:
    """Weights of all schemes asked for, the first of the most lagged place; names must be unique."""
    out: list[tuple[str, list[float]]] = []
    if "equal_weight" in how:
        out.append(("equal_weight", [1 / lag] * lag))
    if "linear" in how:
        out.append(("linear", _scaled([float(i) for i in range(1, lag + 1)])))
    if "exponential" in how:
        out += exponential(lag, alphas, inverse_exp).items()
    if "almon" in how:
        out += almon(lag, orders, inverse_almon).items()
    if "beta" in how:
        out += beta(lag, a, b).items()
    if "own" in how and own:
        out += [(k, [float(x) for x in v]) for k, v in own.items()]
    names = [k for k, _ in out]
    if len(set(names)) < len(names):
        raise ValueError(f"names of weighting schemes are not unique: {sorted({k for k in names if names.count(k) > 1})}")
    return dict(out)


def weighted_sum(how: str, value: Column, words: Column, ignore_zeros: bool) -> Column:
    """Sum of value times its document weight within a group, as one expression over plain sums.

    No scheme needs a second look at the group: each weight is g / sum(g), and for the exponential schemes
    g is linear in the document's share of words, so that everything follows from sums that are combined map-side.
    Null, where no document has a weight.
    """
    there = F.when(value.isNotNull(), words) if ignore_zeros else words
    one = F.when(value.isNotNull(), 1.0) if ignore_zeros else F.lit(1.0)
    if how == "equal_weight":
        return F.try_divide(F.sum(value), F.sum(one))
    if how == "proportional":
        return F.try_divide(F.sum(value * words), F.sum(there))
    if how == "inverseProportional":
        g = F.try_divide(F.lit(1.0), there)
        return F.try_divide(F.sum(value * F.try_divide(F.lit(1.0), words)), F.sum(g))
    if how in ("exponential", "inverseExponential"):  # both are (1 - p) / sum(1 - p): signs and alpha cancel
        total = F.sum(words)
        return F.try_divide(F.sum(value) - F.try_divide(F.sum(value * words), total), F.sum(one) - F.try_divide(F.sum(there), total))
    raise ValueError(f"unknown document weighting {how}")


def group_totals(how: str, value: Column, words: Column, ignore_zeros: bool) -> list[Column]:
    """Aggregates __norm and __total from which :func:`document_weight` gives each document's weight."""
    there = F.when(value.isNotNull(), words) if ignore_zeros else words
    one = F.when(value.isNotNull(), 1.0) if ignore_zeros else F.lit(1.0)
    total = F.sum(words)
    norm = {
        "equal_weight": F.sum(one), "proportional": F.sum(there), "inverseProportional": F.sum(F.try_divide(F.lit(1.0), there)),
        "exponential": F.sum(one) - F.try_divide(F.sum(there), total),
    }
    norm["inverseExponential"] = norm["exponential"]
    return [norm[how].alias("__norm"), total.alias("__total")]


def document_weight(how: str, value: Column, words: Column, ignore_zeros: bool) -> Column:
    share = 1 - F.try_divide(words, F.col("__total"))
    g = {"equal_weight": F.lit(1.0), "proportional": words, "inverseProportional": F.try_divide(F.lit(1.0), words), "exponential": share, "inverseExponential": share}[how]
    w = F.try_divide(g, F.col("__norm"))
    return F.when(value.isNotNull(), w) if ignore_zeros else w
