"""Core cleaning queries over the test tables: packed lists (p7) and timestamps (p2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casemill.operators.packed import split_packed
from casemill.operators.timestamps import estimate_zones, parse_columns, with_normal_form
from casemill.session import written


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "structured").select("record_id", "coram", "advocates")
    fields = {"coram": F.col("coram"), "for_appellants": F.col("advocates.for_appellants"), "for_respondent": F.col("advocates.for_respondent")}
    return split_packed(s, "record_id", fields, only_packed=True).select(F.col("id").alias("record_id"), "field_name", "pos", "entry")


def _parsed(spark: SparkSession, sf: str) -> DataFrame:
    """Every date value with its registry and its parts; parsed once, as the zones and the normal forms read them both."""
    s = table(spark, sf, "structured").select(
        "record_id", "registry_code", "keyed_at", "ingested_at",
        F.explode(
            F.concat(
                F.array(F.struct(F.lit("date_of_judgment").alias("field_name"), F.lit(1).alias("pos"), F.col("date_of_judgment").alias("value"))),
                F.coalesce(F.transform("other_dates", lambda x, i: F.struct(F.lit("other_dates").alias("field_name"), (i + 1).cast("int").alias("pos"), x.alias("value"))), F.array().cast("array<struct<field_name:string,pos:int,value:string>>")),
            )
        ).alias("v"),
    ).select("record_id", "registry_code", "keyed_at", "ingested_at", "v.field_name", "v.pos", "v.value").where("value IS NOT NULL")
    registries = table(spark, sf, "registries").select("registry_code", "date_order", "tz_name")
    s = s.join(F.broadcast(registries), "registry_code", "left")  # a fixed table of 240 rows
    return written(parse_columns(s, "value", "date_order").drop("value", "date_order").where("_kind IS NOT NULL"), "dates")


def _zones(spark: SparkSession, sf: str, parsed: DataFrame) -> DataFrame:
    """The offset history of each registry, from its dates of judgment and other dates."""
    candidates = sorted(r[0] for r in table(spark, sf, "registries").select("tz_name").distinct().collect())  # a fixed table of 240 rows
    return estimate_zones(parsed, "registry_code", ["keyed_at", "ingested_at"], candidates, "tz_name")


def p2_zones(spark: SparkSession, sf: str) -> DataFrame:
    """What the alignment says of each registry: the zone used, the zone with the fewest violations, and how many there are."""
    return _zones(spark, sf, _parsed(spark, sf))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    parsed = _parsed(spark, sf)
    zones = _zones(spark, sf, parsed).select("registry_code", "zone_name")
    d = parsed.join(F.broadcast(zones), "registry_code", "left").withColumn("zone_name", F.coalesce("zone_name", "tz_name"))  # a row for each of 240 registries
    return with_normal_form(d, "zone_name").where("normal_form IS NOT NULL").select("record_id", "field_name", "pos", "normal_form")


QUERIES = {"p2_found": p2_found, "p2_zones": p2_zones, "p7_found": p7_found}
SQL: dict[str, str] = {}
