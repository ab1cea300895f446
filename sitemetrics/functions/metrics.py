"""Ratios, changes and their classes. All return NULL where the metric is undefined."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The 5 % band and the 1.2 dominance factor define the classes.
GROWTH_BAND = 0.05
DOMINANCE = 1.2
UP_FROM_ZERO = 10.0
DOWN_FROM_ZERO = -1.0

# Label texts.
STABLE_LABEL = "➡️ Stable"
UP_MARK = "📈"
DOWN_MARK = "📉"
NO_TEXT = "—"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def safe_div(num, den) -> Column:
    """num / den, NULL when either is NULL or the denominator is zero."""
    return F.try_divide(_c(num).cast("double"), _c(den).cast("double"))


def pct_change(cur, base) -> Column:
    """Fractional change; a zero base gives NULL, +10.0 or -1.0 by the sign of ``cur``."""
    c, p = _c(cur).cast("double"), _c(base).cast("double")
    from_zero = F.when(c > 0, F.lit(UP_FROM_ZERO)).when(c < 0, F.lit(DOWN_FROM_ZERO))
    return F.when(p == 0, from_zero).otherwise(F.try_divide(c - p, p))


def penetration_pct(pax, traffic) -> Column:
    """Customers per visitor, in percent."""
    return safe_div(pax, traffic) * 100.0


def rev_per_visitor(revenue, traffic) -> Column:
    return safe_div(revenue, traffic)


def rev_per_pax(revenue, pax) -> Column:
    return safe_div(revenue, pax)


def trend_label(pct, metric: str = "Revenue") -> Column:
    p = _c(pct)
    return (
        F.when(p > GROWTH_BAND, F.lit(f"{UP_MARK} {metric} Increase"))
        .when(p < -GROWTH_BAND, F.lit(f"{DOWN_MARK} {metric} Decline"))
        .otherwise(F.lit(STABLE_LABEL))
    )


def trend_class(pct) -> Column:
    """Bare direction class used by tree feeds: up / down / flat."""
    p = _c(pct)
    return F.when(p > GROWTH_BAND, "up").when(p < -GROWTH_BAND, "down").otherwise("flat")


def driver_class(pax_pct, rpp_pct) -> Column:
    """Whether volume (customers) or spend (revenue per customer) moved more."""
    v = F.abs(F.coalesce(_c(pax_pct), F.lit(0.0)))
    s = F.abs(F.coalesce(_c(rpp_pct), F.lit(0.0)))
    return (
        F.when((v < GROWTH_BAND) & (s < GROWTH_BAND), "Flat")
        .when(v >= s * DOMINANCE, "Volume-driven")
        .when(s >= v * DOMINANCE, "Spend-driven")
        .otherwise("Mixed")
    )


def revenue_driver_text(traffic_pct, pen_pct, spp_pct, rev_pct) -> Column:
    """One sentence crediting the factor (visitors, penetration, spend) that moved revenue."""
    t, n, s, r = (_c(x) for x in (traffic_pct, pen_pct, spp_pct, rev_pct))
    size = lambda x: F.coalesce(F.abs(x), F.lit(-1.0))  # noqa: E731  unknown factors never dominate
    # Ties go to penetration, then spend, then traffic.
    lead = (
        F.when((size(n) >= size(s)) & (size(n) >= size(t)), "penetration")
        .when(size(s) >= size(t), "SPP")
        .otherwise("traffic")
    )
    up = lambda x: F.coalesce(x > GROWTH_BAND, F.lit(False))
    down = lambda x: F.coalesce(x < -GROWTH_BAND, F.lit(False))
    spend_leads = s.isNotNull() & (n.isNull() | (F.abs(s) >= F.abs(n)))
    # Sentence texts.
    rising = (
        F.when(
            down(t) & (up(s) | up(n)),
            F.concat(
                F.lit("Revenue increased despite traffic decline due to "),
                F.when(spend_leads, "higher SPP").otherwise("higher penetration"),
                F.lit("."),
            ),
        )
        .when(up(t) & down(s) & down(n), "Revenue increased on higher traffic alone, despite lower penetration and SPP.")
        .when((lead == "SPP") & up(s), "Revenue increased mainly due to higher spend per visitor (SPP).")
        .when(
            (lead == "penetration") & up(n),
            "Revenue increased mainly due to higher penetration (more visitors converted to customers).",
        )
        .when((lead == "traffic") & up(t), "Revenue increased mainly due to higher airport traffic.")
        .otherwise("Revenue increased.")
    )
    falling = (
        F.when(
            up(t) & (down(s) | down(n)),
            F.concat(
                F.lit("Revenue declined despite higher traffic due to "),
                F.when(spend_leads, "lower SPP").otherwise("lower penetration"),
                F.lit("."),
            ),
        )
        .when(down(t) & up(s) & up(n), "Revenue declined due to lower traffic, despite higher penetration and SPP.")
        .when((lead == "SPP") & down(s), "Revenue declined mainly due to lower spend per visitor (SPP).")
        .when(
            (lead == "penetration") & down(n),
            "Revenue declined mainly due to lower penetration (fewer visitors converted to customers).",
        )
        .when((lead == "traffic") & down(t), "Revenue declined mainly due to lower airport traffic.")
        .otherwise("Revenue declined.")
    )
    return (
        F.when(r.isNull() | (t.isNull() & n.isNull() & s.isNull()), NO_TEXT)
        .when(up(r), rising)
        .when(down(r), falling)
        .otherwise("Revenue was broadly stable.")
    )


def penetration_driver_text(traffic_pct, pax_pct, pen_pct) -> Column:
    """One sentence on customers growing faster or slower than visitors."""
    t, x, n = (_c(v) for v in (traffic_pct, pax_pct, pen_pct))
    # Sentence texts.
    return (
        F.when(n.isNull() | t.isNull() | x.isNull(), NO_TEXT)
        .when(n > GROWTH_BAND, "Penetration rose because PAX growth outpaced traffic growth.")
        .when(
            (n < -GROWTH_BAND) & (x < 0) & (t >= 0),
            "Penetration dropped because PAX declined while traffic held or grew.",
        )
        .when(n < -GROWTH_BAND, "Penetration dropped because PAX growth was lower than traffic growth.")
        .otherwise("Penetration was broadly stable, with PAX and traffic moving together.")
    )
