"""Dimension lookups. No broadcast hints: Spark broadcasts a dimension only when its measured size allows,
and otherwise shuffles with adaptive skew handling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNMAPPED = "Unmapped"
SITE_WIDE = "Airport-wide services"
MAIN_TERMINAL = "Main Terminal"
OTHER_GROUP = "Other"


def canonical_segment(df: DataFrame, segment_map: DataFrame) -> DataFrame:
    """(segment, business_unit) from ``segment_map(raw_segment, outlet_key, segment, business_unit)``.

    ``outlet_key`` NULL is the rule for every outlet of that raw segment; a supplied business unit is kept;
    unknown segments pass through and serve as their own unit.
    """
    key = lambda c: F.lower(F.trim(c))
    rules = segment_map.select(
        key(F.col("raw_segment")).alias("__s"), key(F.col("outlet_key")).alias("__o"),
        F.col("segment").alias("__seg"), F.col("business_unit").alias("__bu"),
    )
    exact = rules.where("__o is not null").select("__s", "__o", F.struct("__seg", "__bu").alias("__e"))
    general = rules.where("__o is null").select("__s", F.struct("__seg", "__bu").alias("__g"))
    keyed = df.withColumns({"__s": key(F.col("segment")), "__o": key(F.col("outlet"))})
    hit = keyed.join(exact, ["__s", "__o"], "left").join(general, "__s", "left")
    raw = F.trim("segment")
    unit = F.coalesce(F.col("__e.__bu"), F.col("__g.__bu"), raw)
    given = F.col("business_unit") if "business_unit" in df.columns else F.lit(None)
    return hit.select(
        *[c for c in df.columns if c not in ("segment", "business_unit")],
        F.coalesce(F.col("__e.__seg"), F.col("__g.__seg"), raw).alias("segment"),
        F.coalesce(given, unit).alias("business_unit"),
    )


def needs_segment_fix(df: DataFrame, segment_map: DataFrame) -> DataFrame:
    """Rows whose stored segment or unit would change under the current rules."""
    fixed = canonical_segment(
        df.withColumns({"__old_s": F.col("segment"), "__old_u": F.col("business_unit")}), segment_map
    )
    changed = ~F.col("segment").eqNullSafe(F.col("__old_s")) | ~F.col("business_unit").eqNullSafe(F.col("__old_u"))
    return fixed.where(changed).select(*df.columns)


def alias_outlet(df: DataFrame, aliases: DataFrame) -> DataFrame:
    """Outlet renamed by ``aliases(alias, location, outlet)`` after collapsing blanks; default = input."""
    tidy = F.trim(F.regexp_replace("outlet", r"\s+", " "))
    a = aliases.select(F.lower("alias").alias("__k"), "location", F.col("outlet").alias("__new"))
    joined = df.withColumns({"__t": tidy, "__k": F.lower(tidy)}).join(a, ["__k", "location"], "left")
    return joined.withColumn("outlet", F.coalesce("__new", "__t")).select(*df.columns)


def fan_out(df: DataFrame, links: DataFrame, key: str) -> DataFrame:
    """One source line to every outlet it is linked to (``links(key, outlet)``)."""
    return df.join(links, key)


def display_name(df: DataFrame, names: DataFrame) -> DataFrame:
    """``names(outlet, location, display)``: a location-specific name, then a general one (location NULL), then the outlet."""
    own = names.where("location is not null").select("outlet", "location", F.col("display").alias("__own"))
    general = names.where("location is null").select("outlet", F.col("display").alias("__gen"))
    return (
        df.join(own, ["outlet", "location"], "left").join(general, "outlet", "left")
        .withColumn("display_name", F.coalesce("__own", "__gen", "outlet")).select(*df.columns, "display_name")
    )


def outlet_group(df: DataFrame, groups: DataFrame) -> DataFrame:
    """Report group by outlet, or by (outlet, location) where ``groups`` names places; "Other" where none is defined."""
    on = [c for c in ("outlet", "location") if c in groups.columns]
    g = groups.select(*on, F.col("group").alias("__g"))
    return df.join(g, on, "left").withColumn("outlet_group", F.coalesce("__g", F.lit(OTHER_GROUP))).select(*df.columns, "outlet_group")


def add_pool(df: DataFrame, outlet_pool: DataFrame, single_terminal_sites: list[str] = ()) -> DataFrame:
    """Pool label: mapped, site-wide (mapped to NULL), the only terminal of small sites, or unmapped."""
    on = [c for c in ("outlet", "location") if c in outlet_pool.columns]
    p = outlet_pool.select(*on, F.col("pool").alias("__p"), F.lit(True).alias("__hit"))
    label = (
        F.when(F.col("__p").isNotNull(), F.col("__p")).when(F.col("__hit"), SITE_WIDE)
        .when(F.col("location").isin(list(single_terminal_sites)), MAIN_TERMINAL).otherwise(UNMAPPED)
    )
    return df.join(p, on, "left").withColumn("pool_label", label).select(*df.columns, "pool_label")


def unmapped_outlets(df: DataFrame, outlet_pool: DataFrame) -> DataFrame:
    on = [c for c in ("outlet", "location") if c in outlet_pool.columns]
    return df.select("outlet", "location").distinct().join(outlet_pool, on, "left_anti")


def known_terminals(outlet_pool: DataFrame, pool_member: DataFrame) -> DataFrame:
    on = [c for c in ("pool", "location") if c in outlet_pool.columns and c in pool_member.columns]
    return outlet_pool.join(pool_member, on).select("terminal").distinct()
