"""Column functions on numbers."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Dose class limits.
DOSE_BREAKS = (0, 1, 128, 402, 1267, 4001, 8001, 12641, 16001)

# Concentrations that experiments set out to repeat.
POOL_VEGF = {2: (1, 2), 7: (6, 7), 25: (19, 25)}
POOL_GDF2 = {2: (1, 2), 7: (6, 7), 25: (19, 25), 79: (63, 79), 316: (251, 316)}
POOL_HGF_FGF = {3: (1, 2, 3), 7: (5, 6, 7), 15: (12, 15), 25: (19, 25, 39), 63: (50, 63, 79), 316: (251, 316)}


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def break_labels(breaks: Sequence[float], include_lowest: bool = False) -> list[str]:
    """Interval labels with the fewest significant digits (three at least) that keep neighbours apart."""
    for digits in range(3, 13):
        text = [f"{b:.{digits}g}" for b in breaks]
        if all(a != b for a, b in zip(text, text[1:])):
            break
    labels = [f"({a},{b}]" for a, b in zip(text, text[1:])]
    if include_lowest:
        labels[0] = "[" + labels[0][1:]
    return labels


def cut_breaks(c: Column | str, breaks: Sequence[float], labels: Sequence | None = None,
               include_lowest: bool = False) -> Column:
    """The interval (a, b] a number lies in; outside all of them NULL."""
    c = _col(c)
    names = list(labels) if labels is not None else break_labels(breaks, include_lowest)
    if len(names) != len(breaks) - 1:
        raise ValueError("one label per interval is needed")
    low = c >= breaks[0] if include_lowest else c > breaks[0]
    out = F.when(low & (c <= breaks[1]), F.lit(names[0]))
    for lo, hi, name in zip(breaks[1:], breaks[2:], names[1:]):
        out = out.when((c > lo) & (c <= hi), F.lit(name))
    return out


def unlog(c: Column | str) -> Column:
    """Whole linear concentration of a log10 one; nine places are kept before the floor to drop binary noise."""
    return F.floor(F.round(F.pow(F.lit(10.0), _col(c)), 9))


def pool_values(c: Column | str, groups: Mapping[float, Sequence[float]]) -> Column:
    """Replace each listed number by its group's number; others stay."""
    c = _col(c)
    out = None
    for target, members in groups.items():
        cond = c.isin([m for m in members])
        out = F.when(cond, F.lit(target)) if out is None else out.when(cond, F.lit(target))
    return c if out is None else out.otherwise(c)


def to_micromolar(c: Column | str) -> Column:
    """Thousandth, to the nearer of its two neighbours with two places, the even one in a tie.

    The distances are taken between doubles, so 1.265, stored a little below the tie, gives 1.26.
    """
    x = _col(c) / 1000
    below, above = F.floor(x * 100), F.ceil(x * 100)
    to_below, to_above = x - below / 100, above / 100 - x
    nearer = F.when(to_below < to_above, below).when(to_above < to_below, above).when(below % 2 == 0, below)
    return nearer.otherwise(above) / 100


def to_places(c: Column | str, digits: int = 6, nudge: float = 1e-8) -> Column:
    """A number at some decimal places; a little is added first, as numbers of few decimals often lie between two roundings.

    The number is scaled as a double, rounded to a whole one, halves away from zero, and scaled back: so do engines that do
    not round the decimal text of a double, and near a half the two part.
    """
    scale = 10.0 ** digits
    return F.round((_col(c) + F.lit(nudge)) * F.lit(scale)) / F.lit(scale) + F.lit(0.0)


def safe_ratio(a: Column | str, b: Column | str) -> Column:
    """a / b, NULL where b is 0."""
    return F.try_divide(_col(a), _col(b))


def chi2_tail(c: Column | str, freedom: int, terms: int = 200) -> Column:
    """Probability that a chi-square variable of `freedom` degrees exceeds a number; 1 where that is not above zero.

    The incomplete gamma function, by its power series below the bulk of the distribution and by its continued fraction,
    from the inside out, above it. Both converge there in far fewer than `terms` steps, unless `freedom` is in the hundreds.
    """
    a, h = freedom / 2, _col(c).cast("double") / 2
    # 1 + h/(a+1) (1 + h/(a+2) (1 + ...)), from the inside out
    steps = F.sequence(F.lit(terms), F.lit(1), F.lit(-1))
    series = F.aggregate(steps, F.lit(1.0), lambda acc, i: 1 + acc * h / (i + F.lit(a)))
    below = 1 - F.exp(F.lit(a) * F.ln(h) - h - F.lit(math.lgamma(a + 1))) * series
    # 1 / (b0 + a1 / (b1 + a2 / (b2 + ...))), b_i = h + 2i + 1 - a, a_i = -i (i - a)
    deepest = h + F.lit(2.0 * terms + 1 - a)
    fraction = F.aggregate(steps, deepest, lambda acc, i: h + 2 * i - 1 - F.lit(a) - i * (i - F.lit(a)) / acc)
    above = F.exp(F.lit(a) * F.ln(h) - h - F.lit(math.lgamma(a))) / fraction
    return F.when(h <= 0, F.lit(1.0)).when(h < a + 1, below).when(h.isNotNull(), above)
