"""SCORE-1/2 as column arithmetic, plus the category colour mix."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsloom import dims


def _num(c: Column, default: float) -> Column:
    """Missing -> default; NaN survives until ``_clamp`` turns it into 0."""
    return F.coalesce(c.cast("double"), F.lit(float(default)))


def _clamp(c: Column) -> Column:
    bad = F.isnan(c) | (c == F.lit(float("inf"))) | (c == F.lit(float("-inf")))
    return F.when(bad, 0.0).otherwise(F.least(F.lit(100.0), F.greatest(F.lit(0.0), c)))


def _tenth(c: Column) -> Column:
    return F.floor(c * 10.0 + 0.5) / 10.0


def _even_tenth(c: Column) -> Column:
    return F.bround(c, 1)


def score_struct(sources: Column, countries: Column, age_hours: Column, rate: Column, half_even: bool = False) -> Column:
    """Four rounded components, the total score and its label.

    ``half_even`` switches to the rounding of the tabular API.
    """
    tenth = _even_tenth if half_even else _tenth
    n = F.greatest(F.lit(0.0), _num(sources, 0))
    k = F.greatest(F.lit(0.0), _num(countries, 0))
    corroboration = tenth(_clamp(F.log2(n + 1.0) / F.log2(F.lit(9.0)) * 100.0) * 0.45)
    momentum = tenth(_clamp(_num(rate, 0) / 3.0 * 100.0) * 0.25)
    freshness = tenth(_clamp(100.0 - _num(age_hours, 168) / 168.0 * 100.0) * 0.2)
    reach = tenth(F.when(k <= 1, F.lit(0.0)).otherwise(_clamp((k - 1.0) / 5.0 * 100.0)) * 0.1)
    total = _clamp(corroboration + momentum + freshness + reach)
    score = (F.bround(total, 0) if half_even else F.floor(total + 0.5)).cast("int")
    return F.struct(
        corroboration.alias("corroboration"), momentum.alias("reporting_momentum"),
        freshness.alias("freshness"), reach.alias("geographic_reach"),
        score.alias("score"), label(score).alias("label"),
    )


def label(score: Column) -> Column:
    s = _clamp(score.cast("double"))
    return (
        F.when(s >= 75, "Very strong").when(s >= 55, "Strong").when(s >= 35, "Building").otherwise("Early")
    )


def fill_color(category: Column, score: Column) -> Column:
    """Category colour mixed over the base colour; stronger events are more saturated."""
    colors = F.create_map(*[F.lit(x) for kv in dims.CATEGORY_COLORS.items() for x in kv])
    fg = F.try_element_at(colors, category)
    amount = F.lit(0.72) + _clamp(F.coalesce(score.cast("double"), F.lit(0.0))) * 0.0028

    def channel(i: int) -> Column:
        a = F.conv(F.substring(fg, i, 2), 16, 10).cast("double")
        b = float(int(dims.MAP_BASE_COLOR[i - 1 : i + 1], 16))
        mixed = F.floor(a * amount + (F.lit(1.0) - amount) * b + 0.5)
        return F.lpad(F.lower(F.hex(mixed.cast("bigint"))), 2, "0")

    mixed = F.concat(F.lit("#"), channel(2), channel(4), channel(6))
    return F.when(category.isNull(), F.lit(dims.COLOR_NO_CATEGORY)).otherwise(mixed)


def window_label(hours: Column) -> Column:
    """Coverage window in words."""
    minutes = F.greatest(F.lit(1), F.floor(hours * 60 + 0.5)).cast("int")
    days = hours / 24
    return (
        F.when(hours.isNull() | F.isnan(hours) | (hours <= 0), F.lit("a single report"))
        .when(hours < 1, F.concat(minutes.cast("string"), F.when(minutes == 1, " minute").otherwise(" minutes")))
        .when(hours < 2, F.concat(F.format_string("%.1f", hours), F.lit(" hours")))
        .when(hours < 24, F.concat(F.floor(hours + 0.5).cast("string"), F.lit(" hours")))
        .when(days < 2, F.concat(F.format_string("%.1f", days), F.lit(" days")))
        .otherwise(F.concat(F.floor(days + 0.5).cast("string"), F.lit(" days")))
    )
