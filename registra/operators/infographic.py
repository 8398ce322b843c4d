"""Aggregates from a closed catalog: metric x dimension x filters."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ADULT = 18


def decade(age: Column) -> Column:
    """Decade of an age as a label; 90 and over in one."""
    low = F.least(F.floor(age / 10) * 10, F.lit(90)).cast("int")
    return F.when(age.isNull(), None).when(low == 90, "90+").otherwise(F.concat(low.cast("string"), F.lit("-"), (low + 9).cast("string")))


def age_band(age: Column) -> Column:
    band = F.when(age.between(18, 25), "18-25").when(age.between(26, 40), "26-40").when(age.between(41, 60), "41-60").when(age >= 61, "60+")
    return band.otherwise("Unknown")


def yes_no(c: Column, yes: str, no: str) -> Column:
    return F.when(F.coalesce(c, F.lit(False)), yes).otherwise(no)


#: name: (aggregate, whether it is a count)
METRICS: dict[str, tuple[Column, bool]] = {}
DIMENSIONS: dict[str, Column] = {}


def catalog() -> None:
    """Fill the catalogs; columns can only be made while a session is active."""
    if METRICS:
        return
    verified = F.col("verified").cast("int")
    METRICS.update(
        voter_count=(F.count(F.lit(1)), True),
        verified_count=(F.sum(verified), True),
        unverified_count=(F.count(F.lit(1)) - F.sum(verified), True),
        verified_rate=(F.round(F.sum(verified) * 100.0 / F.count(F.lit(1)), 1), False),
        average_age=(F.round(F.avg(F.when(F.col("age") >= ADULT, F.col("age"))), 1), False),
        supplement_count=(F.sum(F.col("is_supplement").cast("int")), True),
        deleted_count=(F.sum(F.col("is_deleted").cast("int")), True),
    )
    DIMENSIONS.update(
        gender=F.col("gender"),
        age_band=age_band(F.col("age")),
        part_number=F.col("part_number"),
        constituency=F.col("constituency"),
        relation_type=F.col("relation_type"),
        verified=yes_no(F.col("verified"), "Verified", "Unverified"),
        is_supplement=yes_no(F.col("is_supplement"), "Supplement", "Main roll"),
        deleted=yes_no(F.col("is_deleted"), "Deleted", "Active"),
    )


#: Keys of the filters; others are dropped.
EQUAL = ("gender", "part_number", "constituency", "relation_type")
FLAGS = ("verified", "is_supplement", "is_deleted")


@dataclass
class Spec:
    metric: str
    dimension: str
    filters: dict = field(default_factory=dict)
    limit: int = 12

    def checked(self) -> Spec:
        """The spec with unknown filters dropped and the limit in 1..12; unknown names raise."""
        catalog()
        if self.metric not in METRICS or self.dimension not in DIMENSIONS:
            raise ValueError(f"unknown metric or dimension: {self.metric}, {self.dimension}")
        known = {*EQUAL, *FLAGS, "min_age", "max_age", "age_band"}
        return Spec(self.metric, self.dimension, {k: v for k, v in self.filters.items() if k in known}, max(1, min(12, self.limit)))


def filtered(rows: DataFrame, filters: dict) -> DataFrame:
    """Values of the wrong kind ask nothing."""
    for k, v in filters.items():
        if k in EQUAL and isinstance(v, str):
            rows = rows.filter(F.col(k) == v)
        elif k in FLAGS and isinstance(v, bool):
            rows = rows.filter(F.coalesce(F.col(k), F.lit(False)) == v)
        elif k in ("min_age", "max_age") and isinstance(v, int):
            rows = rows.filter(F.col("age") >= v if k == "min_age" else F.col("age") <= v)
        elif k == "age_band" and isinstance(v, str):
            rows = rows.filter(age_band(F.col("age")) == v)
    return rows


def infographic(rows: DataFrame, spec: Spec) -> DataFrame:
    """Points of a chart: ``label``, ``value``, ``share`` and ``rank``.

    Counts beyond the limit are folded into ``Other`` (of other metrics they are cut); shares are
    of the total, for counts only. The grouped rows are few, so windows over them are cheap.
    """
    spec = spec.checked()
    metric, is_count = METRICS[spec.metric]
    label = F.coalesce(F.when(F.trim(DIMENSIONS[spec.dimension]) != "", DIMENSIONS[spec.dimension]), F.lit("(not recorded)"))
    points = filtered(rows, spec.filters).groupBy(label.alias("label")).agg(metric.alias("value"))
    way = Window.orderBy(F.col("value").desc_nulls_last(), "label")
    points = points.withColumn("rank", F.row_number().over(way))
    if is_count:
        head = F.when(F.col("rank") <= spec.limit, F.col("label")).otherwise("Other")
        points = points.groupBy(head.alias("label"), F.least("rank", F.lit(spec.limit + 1)).alias("rank")).agg(F.sum("value").alias("value"))
        share = F.round(F.col("value") * 100.0 / F.sum("value").over(Window.partitionBy()), 1)
    else:
        points = points.filter(F.col("rank") <= spec.limit)
        share = F.lit(None).cast("double")
    return points.select("label", F.col("value").cast("double").alias("value"), share.alias("share"), F.col("rank").cast("int").alias("rank"))


def highlights(rows: DataFrame, spec: Spec) -> DataFrame:
    """Population, total and the largest point, in one row."""
    spec = spec.checked()
    metric, _ = METRICS[spec.metric]
    kept = filtered(rows, spec.filters)
    label = F.coalesce(DIMENSIONS[spec.dimension], F.lit("(not recorded)"))
    top = kept.groupBy(label.alias("label")).agg(metric.alias("value")).agg(F.max(F.struct("value", "label")).alias("t"))
    whole = kept.agg(F.count(F.lit(1)).alias("population"), metric.cast("double").alias("total"))
    return whole.join(F.broadcast(top)).select("population", "total", F.col("t.label").alias("top_label"), F.col("t.value").cast("double").alias("top_value"))


def dashboard(rows: DataFrame) -> DataFrame:
    """All facets of the dashboard in one pass: ``facet``, ``label``, ``n``.

    Grouping sets read the table once; the totals are the set without columns.
    """
    facets = rows.select(
        F.coalesce("gender", F.lit("Unknown")).alias("gender"), F.coalesce("relation_type", F.lit("Unknown")).alias("relation"), decade(F.col("age")).alias("decade"), F.col("verified").cast("int").alias("v"), "age"
    )
    sets = facets.groupingSets([["gender"], ["relation"], ["decade"], []], "gender", "relation", "decade")
    out = sets.agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("verified"), F.round(F.avg("age"), 1).alias("average_age"), F.sum(F.col("age").isNull().cast("int")).alias("missing_age"), F.grouping_id().alias("g"))
    facet = F.when(F.col("g") == 3, "gender").when(F.col("g") == 5, "relation").when(F.col("g") == 6, "decade").otherwise("total")
    return out.select(facet.alias("facet"), F.coalesce("gender", "relation", "decade", F.lit("")).alias("label"), "n", "verified", "average_age", "missing_age")
