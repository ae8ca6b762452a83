"""Synthetic training samples: how many each label combination gets, and seeded variations of what there is."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def quotas(training: DataFrame, target: int, group: str = "issue_type", combination: str = "category", least: int = 0) -> DataFrame:
    """group, combination, n, quota: samples that bring every group up to `target` rows, split over its combinations by their rows.

    Largest remainders: each combination gets the whole part of its share, the rest goes to the largest
    fractions, ties by name, so the quotas of a group add up to what it lacks exactly; then none is under `least`.
    """
    counted = training.groupBy(group, combination).agg(F.count(F.lit(1)).alias("n"))
    by = Window.partitionBy(group)
    lacks = F.greatest(F.lit(target) - F.sum("n").over(by), F.lit(0))
    step = counted.select("*", lacks.alias("__lacks"), F.sum("n").over(by).alias("__all"))
    step = step.select("*", F.expr("n * __lacks div __all").alias("__whole"), (F.col("n") * F.col("__lacks") % F.col("__all")).alias("__rest"))
    left = F.col("__lacks") - F.sum("__whole").over(by)
    place = F.row_number().over(by.orderBy(F.desc("__rest"), combination))
    return step.select(group, combination, "n", F.greatest(F.col("__whole") + (place <= left).cast("long"), F.lit(least)).alias("quota"))


def seeded_order(values: Sequence[str], *names: Column, seed: int) -> Column:
    """The values in an order that the md5 of names, seed and each value gives."""
    name = F.concat_ws("|", *[n.cast("string") for n in names], F.lit(str(seed)))
    table = F.array(*[F.lit(v) for v in values])
    keyed = F.transform(table, lambda v: F.struct(F.md5(F.concat(name, F.lit("|"), v).cast("binary")).alias("k"), v.alias("v")))
    return F.transform(F.array_sort(keyed), lambda x: x["v"])


def variations(wanted: DataFrame, templates: Sequence[str], values: Mapping[str, Sequence[str]], group: str = "issue_type", combination: str = "category", seed: int = 42) -> DataFrame:
    """group, combination, sample (from 1), body: `quota` texts per combination.

    Templates and the values of each {slot} are dealt in an order of the combination's own, and none comes again
    before all have come; {issue} is the group's name. The same seed gives the same texts wherever they are made.
    """
    names = (F.col(group), F.col(combination))
    each = wanted.where("quota > 0").select(group, combination, F.explode(F.sequence(F.lit(1), F.col("quota").cast("int"))).alias("sample"))
    dealt = lambda options, slot: F.get(seeded_order(options, *names, F.lit(slot), seed=seed), (F.col("sample") - 1) % len(options))
    body = dealt(templates, "template")
    for slot, options in values.items():
        body = F.replace(body, F.lit(f"{{{slot}}}"), dealt(options, slot))
    return each.select(group, combination, "sample", F.replace(body, F.lit("{issue}"), F.col(group)).alias("body"))
