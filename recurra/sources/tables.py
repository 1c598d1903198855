"""Readers and writers for the input tables and results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recurra.session import write_table

ADMISSION_FIELDS = [
    ("patid", T.LongType()),
    ("sex", T.StringType()),
    ("dob", T.DateType()),
    ("birthyear", T.IntegerType()),
    ("date_admit", T.DateType()),
    ("date_dis", T.DateType()),
    ("diagnosis_m3", T.StringType()),
    ("diagnosis_en", T.StringType()),
    ("icd_main", T.StringType()),
    ("icd_m3", T.StringType()),
    ("outcome", T.StringType()),
    ("ward", T.StringType()),
    ("district", T.StringType()),
    ("province", T.StringType()),
]
ADMISSION_SCHEMA = T.StructType(
    [T.StructField("source_ordinal", T.LongType())]
    + [T.StructField(name, kind) for name, kind in ADMISSION_FIELDS]
)
# Names in the CSV header, where they differ from ours.
CSV_NAMES = {
    "iduse": "patid", "date.admit": "date_admit", "date.dis": "date_dis",
    "diagnosis.m3": "diagnosis_m3", "diagnosis.en": "diagnosis_en",
    "icd.main": "icd_main", "icd.m3": "icd_m3",
}
# Columns that the derivation uses; the others are pruned at the scan.
CORE_COLUMNS = ["source_ordinal", "patid", "sex", "district", "dob", "birthyear", "date_admit",
                "date_dis", "icd_m3", "outcome", "diagnosis_en"]

MORTALITY_SCHEMA = T.StructType([
    T.StructField("Location", T.StringType()),
    T.StructField("Year", T.IntegerType()),
    T.StructField("Age", T.StringType()),
    T.StructField("Cause of death or injury", T.StringType()),
    T.StructField("Value", T.DoubleType()),
    T.StructField("Lower bound", T.DoubleType()),
    T.StructField("Upper bound", T.DoubleType()),
])
MORTALITY_COLUMNS = {
    "Location": "location", "Year": "year", "Age": "age", "Value": "value",
    "Lower bound": "lower_bound", "Upper bound": "upper_bound",
    "Cause of death or injury": "cause_of_death",
}

ICD_COLUMNS = ["three_digit", "major", "sub_chapter", "chapter"]
# The row missing from the code table, and the neglected-disease codes.
ICD_EXTRA = ("A16", "Respiratory tuberculosis", "Tuberculosis",
             "Certain infectious and parasitic diseases")
NEGLECTED_CODES = ["B57", "B55", "B56", "B65", "B77", "B76", "B79", "B73", "B68", "B69", "B67",
                   "B74", "B72", "B66", "B92", "A30", "A71", "A31", "A66", "A67", "A65", "A82",
                   "A90", "A91"]


# Bits for the row's place within a task's share of the files.
ROW_BITS = 33


def numbered_lines(rows: DataFrame, into: str) -> DataFrame:
    """Number the rows of text files in the order of file names and lines.

    The file block comes first, by its rank among all blocks, then the row's place
    in the task that reads the block. A retried task reads the same blocks in the
    same order, so the numbers stay the same. There is one row per block in the
    window over all blocks.
    """
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    at = {"_file": F.col("_metadata.file_path"), "_block": F.col("_metadata.file_block_start")}
    blocks = rows.select(*(v.alias(k) for k, v in at.items())).distinct()
    ranked = blocks.withColumn("_rank", F.row_number().over(Window.orderBy("_file", "_block")))
    placed = rows.select(*rows.columns, *(v.alias(k) for k, v in at.items()), place.alias("_place"))
    number = (F.col("_rank").cast("long") * F.lit(1 << ROW_BITS) + F.col("_place")).alias(into)
    return placed.join(ranked, ["_file", "_block"], "left").select(number, *rows.columns)


def read_named_csv(spark: SparkSession, path: str, columns: dict[str, tuple[str, T.DataType]]) -> DataFrame:
    """CSV files with a header, in any column order and with any further columns.

    columns: header name -> (our name, type). A missing column is an error, and so is
    a file whose header differs from the others'. A value that isn't of its type is NULL.
    """
    def reader():
        return spark.read.option("header", True).option("nullValue", "NA")

    header = reader().csv(path).columns
    missing = [name for name in columns if name not in header]
    if missing:
        raise ValueError(f"{path}: no column {', '.join(missing)}")
    # enforceSchema=false checks each file's header.
    strings = T.StructType([T.StructField(name, T.StringType()) for name in header])
    rows = reader().schema(strings).option("enforceSchema", False).csv(path)
    return rows.select(*(F.col(f"`{name}`").try_cast(kind).alias(ours) for name, (ours, kind) in columns.items()), "_metadata")


def read_admissions(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Admissions with a stated schema: parquet in our names, or CSV files with a header.

    `source_ordinal` breaks ties between a subject's admissions. Parquet brings
    it as a column; for CSV it follows the order of file names and lines.
    """
    if fmt == "parquet":
        return spark.read.schema(ADMISSION_SCHEMA).parquet(path)
    headers = {ours: header for header, ours in CSV_NAMES.items()}
    rows = read_named_csv(spark, path, {headers.get(name, name): (name, kind) for name, kind in ADMISSION_FIELDS})
    return numbered_lines(rows, "source_ordinal").select(*ADMISSION_SCHEMA.fieldNames())


def read_mortality(spark: SparkSession, path: str) -> DataFrame:
    kinds = {f.name: f.dataType for f in MORTALITY_SCHEMA}
    return read_named_csv(spark, path, {old: (new, kinds[old]) for old, new in MORTALITY_COLUMNS.items()}).drop("_metadata")


def icd_dim(codes: DataFrame, extra: tuple[str, ...] | None = ICD_EXTRA) -> DataFrame:
    """One row per distinct three-digit entry of a code-level table, with the disease-type flag."""
    dim = codes.select(ICD_COLUMNS).distinct()
    if extra:
        added = codes.sparkSession.createDataFrame([extra], ", ".join(f"{c} string" for c in ICD_COLUMNS))
        dim = dim.unionByName(added)
    return dim.withColumn(
        "type_id",
        F.when(F.col("three_digit").isin(NEGLECTED_CODES), "NTD").otherwise("no NTD"),
    )


def write_result(df: DataFrame, path: str) -> None:
    write_table(df, path)
