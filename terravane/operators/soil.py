"""Soil survey: primary components, horizons, fragments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import stored

MEASURES = (
    "fine_fraction_percent_by_weight", "sand_percent_of_fine_fraction_by_weight", "silt_percent_of_fine_fraction_by_weight",
    "clay_percent_of_fine_fraction_by_weight", "organic_matter_percent_of_fine_fraction_by_weight", "oven_dry_bulk_density_g_per_cm3",
    "gravel_percent_by_weight",
)


def depth_average(value: Column, weight: Column) -> Column:
    """Aggregate: weighted mean over the present values (A3, A4)."""
    return F.try_divide(F.sum(value * weight), F.sum(F.when(value.isNotNull(), weight)))


def kinds_text(kinds: Column) -> Column:
    """Aggregate: distinct kinds in order, comma separated; null for none."""
    return F.nullif(F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list(kinds)))), ", "), F.lit(""))


def fragments_by_horizon(fragments: DataFrame) -> DataFrame:
    """Volume (0 where all are null) and distinct kinds of each horizon."""
    return fragments.groupBy("horizon_key").agg(F.coalesce(F.sum("fragment_percent_by_volume"), F.lit(0.0)).alias("fragment_percent_by_volume"), F.collect_set("fragment_kind").alias("kinds"))


def horizons_by_component(horizons: DataFrame, fragments: DataFrame, top: float, bottom: float) -> DataFrame:
    """Depth-weighted averages and fragment kinds of each component within a depth range."""
    if bottom <= top:
        raise ValueError("the bottom depth must be below the top depth")
    near = horizons.filter((F.col("bottom_depth_cm") > top) & (F.col("top_depth_cm") < bottom))
    near = unique_key(near, "horizon_key").join(fragments_by_horizon(fragments), "horizon_key", "left")
    w = F.least(F.lit(float(bottom)), F.col("bottom_depth_cm")) - F.greatest(F.lit(float(top)), F.col("top_depth_cm"))
    return near.groupBy("component_key").agg(
        *(depth_average(F.col(m), w).alias(m) for m in MEASURES),
        depth_average(F.col("fragment_percent_by_volume"), w).alias("fragment_percent_by_volume"),
        kinds_text(F.col("kinds")).alias("fragment_kind"),
    )


def horizon_measures(chorizon: DataFrame) -> DataFrame:
    """Horizon table in our names, with fine fraction and gravel (P25)."""
    fine = (100 - F.col("fraggt10_r") - F.col("frag3to10_r")) * (F.col("sieveno10_r") / 100)
    return chorizon.select(
        F.col("chkey").alias("horizon_key"), F.col("cokey").alias("component_key"), F.col("hzdept_r").cast("double").alias("top_depth_cm"), F.col("hzdepb_r").cast("double").alias("bottom_depth_cm"),
        *(c.alias(n) for n, c in zip(MEASURES, (fine, F.col("sandtotal_r"), F.col("silttotal_r"), F.col("claytotal_r"), F.col("om_r"), F.col("dbovendry_r"), 100 - fine))),
    )


def primary_components(mapunit: DataFrame, component: DataFrame, copmgrp: DataFrame) -> DataFrame:
    """The major component with the largest share of each map unit.

    As in a ranking by the component's own key, map units without a major component share one rank (Q5): the one with the smallest
    key stays.  Ties go to the smaller component key.  The choice is one aggregation by map unit and one global minimum, so
    units without a component never meet in one partition.
    """
    major = component.filter("majcompflag = 'Yes' and mukey is not null")
    rest = [c for c in major.columns if c not in ("mukey", "cokey", "comppct_r")]
    share = F.col("comppct_r")
    best = major.groupBy("mukey").agg(F.min(F.struct(share.isNull().alias("_none"), (-share).alias("_less"), "cokey", "comppct_r", *rest)).alias("_b"))
    best = best.select("mukey", *(F.col(f"_b.{c}").alias(c) for c in component.columns if c != "mukey"))
    with_one = mapunit.join(best, "mukey")
    bare = mapunit.join(best.select("mukey"), "mukey", "left_anti").orderBy("mukey").limit(1)
    first = with_one.unionByName(bare.select("*", *(F.lit(None).cast(best.schema[c].dataType).alias(c) for c in best.columns if c != "mukey")))
    group = copmgrp.filter("rvindicator = 'Yes'").select("cokey", F.col("pmgroupname").alias("parent_material"))
    return first.join(group, "cokey", "left")


def unique_key(df: DataFrame, key: str) -> DataFrame:
    """``df``, with an error in any row whose key is not unique (J4, J5); a window on the key of the join that follows, so one shuffle serves both."""
    n = F.count(key).over(Window.partitionBy(key))
    return df.withColumn("_n", n).filter(F.when(F.col("_n") > 1, F.raise_error(F.lit(f"{key} is not unique")).cast("boolean")).otherwise(True)).drop("_n")


def primary_soil_components(mapunit: DataFrame, component: DataFrame, copmgrp: DataFrame, chorizon: DataFrame, chfrags: DataFrame, top: float, bottom: float) -> DataFrame:
    """Primary components with their depth-weighted measures, by map unit key (E8, O1, J4, J5): one plan, the key lists are joins.

    A component with several representative parent materials, or a horizon that comes twice, raises.
    """
    first = unique_key(primary_components(mapunit, component, copmgrp), "cokey")
    # Stored, so that Spark knows their sizes: a few keys, and then a few horizons, go to the large tables, which are not shuffled for them.
    first = stored(first, "components")
    keys = first.select("cokey").filter("cokey is not null").distinct()
    horizons = stored(horizon_measures(chorizon.join(keys, "cokey", "left_semi")), "horizons")
    frags = chfrags.select(F.col("chkey").alias("horizon_key"), F.col("fragvol_r").cast("double").alias("fragment_percent_by_volume"), F.col("fragsize_r").alias("fragment_size"), F.col("fragkind").alias("fragment_kind"))
    frags = frags.join(horizons.select("horizon_key"), "horizon_key", "left_semi")
    return first.join(horizons_by_component(horizons, frags, top, bottom), F.col("cokey") == F.col("component_key"), "left").drop("component_key").orderBy("mukey")
