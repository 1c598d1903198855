"""Admission-shaped and mortality-shaped views over the order tables used for testing."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FOLLOWUP_END = dt.date(2001, 12, 31)
YEARS = (1995, 2001)

# Rows of the small code table: several detailed codes share a three-digit entry.
ICD_ROWS = [
    ("A09", "Infectious gastroenteritis and colitis, unspecified", "Intestinal infectious diseases"),
    ("A09", "Infectious gastroenteritis and colitis, unspecified", "Intestinal infectious diseases"),
    ("J18", "Pneumonia, unspecified organism", "Influenza and pneumonia"),
    ("J18", "Pneumonia, unspecified organism", "Influenza and pneumonia"),
    ("A85", "Oth viral encephalitis", "Viral infections of the central nervous system"),
    ("G08", "Intracranial phlebitis", "Inflammatory diseases of the central nervous system"),
    ("B01", "Varicella [chickenpox]", "Viral infections characterized by skin lesions"),
    ("B05", "Measles", "Viral infections characterized by skin lesions"),
    ("B20", "Human immunodeficiency virus [HIV] disease", "Human immunodeficiency virus disease"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def admissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    places = table(spark, sf_dir, "nation").join(
        table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    customers = table(spark, sf_dir, "customer").join(
        places, F.col("c_nationkey") == F.col("n_nationkey"))

    key, cust = F.col("o_orderkey"), F.col("c_custkey")
    formula = F.date_add(F.lit(dt.date(1984, 1, 1)), ((cust * 37) % 4018).cast("int"))
    leap_born = cust % 97 == 5
    admit = F.to_date("o_orderdate")
    priority, status = F.col("o_orderpriority"), F.col("o_orderstatus")
    return orders.join(customers, F.col("o_custkey") == cust).select(
        key.alias("source_ordinal"),
        F.col("o_custkey").alias("patid"),
        F.when(cust % 2 == 0, "male").otherwise("female").alias("sex"),
        F.col("n_name").alias("district"),
        F.col("r_name").alias("province"),
        F.when(cust % 50 == 0, None)
        .when(leap_born, F.lit(dt.date(1992, 2, 29)))
        .otherwise(formula).alias("dob"),
        F.when(cust % 100 == 0, None)
        .when(leap_born, 1992)
        .otherwise(F.year(formula)).alias("birthyear"),
        admit.alias("date_admit"),
        F.date_add(admit, ((key * 7 + F.col("o_custkey")) % 11).cast("int")).alias("date_dis"),
        F.when(key % 211 == 3, "B20")
        .when(key % 7 == 0, "B05")
        .when(priority == "1-URGENT", "A09")
        .when(priority == "2-HIGH", "J18")
        .when((priority == "3-MEDIUM") & (key % 2 == 0), "A85")
        .when(priority == "3-MEDIUM", "G08")
        .when(priority == "4-NOT SPECIFIED", "B01")
        .otherwise("K35").alias("icd_m3"),
        F.when(status == "F", "discharged")
        .when((status == "O") & (key % 5 == 0), "presumably.worse")
        .when(status == "O", "discharged")
        .when(key % 61 == 0, "dead")
        .when(key % 13 == 0, None)
        .otherwise("discharged").alias("outcome"),
        priority.alias("diagnosis_en"),
    )


def icd_codes(spark: SparkSession) -> DataFrame:
    rows = [(code, major, sub, "Certain infectious and parasitic diseases") for code, major, sub in ICD_ROWS]
    return spark.createDataFrame(rows, "three_digit string, major string, sub_chapter string, chapter string")


def mortality(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    location = (
        F.when(F.col("l_returnflag") == "A", "World Bank High Income")
        .when(F.col("l_returnflag") == "N", "World Bank Low Income")
        .otherwise("World Bank Lower Middle Income")
    )
    cause = (
        F.when(F.col("l_linenumber") % 4 == 0, "Enteric infections")
        .when(F.col("l_linenumber") % 4 == 1, "Respiratory infections and tuberculosis")
        .when(F.col("l_linenumber") % 4 == 2, "HIV/AIDS and sexually transmitted infections")
        .otherwise("Other infectious diseases")
    )
    return lines.groupBy(
        location.alias("location"),
        F.year("l_shipdate").alias("year"),
        F.when(F.col("l_linestatus") == "F", "<5 years").otherwise("5-14 years").alias("age"),
        cause.alias("cause_of_death"),
    ).agg(
        F.avg("l_discount").alias("value"),
        F.min("l_discount").alias("lower_bound"),
        F.max("l_discount").alias("upper_bound"),
    )


def event_admissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dense event stream as one-day admissions: long chains of close stays."""
    day = F.to_date("ts")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("source_ordinal"),
        F.col("user_id").alias("patid"),
        day.alias("date_admit"),
        day.alias("date_dis"),
        F.when(F.col("event_id") % 7 == 0, "B05").otherwise("B01").alias("icd_m3"),
    )
