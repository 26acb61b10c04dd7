"""File sources: name lists, configuration, activity logs, golden sets, reports, build and test logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema

# Fixed value: shape of a documentation row in a rendered evaluation report.
REPORT_ROW = r"^\|\s*(\d+)\s*\|\s*([\w.-]+)\s*\|\s*(@\d+|miss|n/a)\s*\|"
QUERY_ROW = r"^\|\s*(\d+)\s*\|\s*(.+?)\s*\|\s*(.+?)\s*\|"


def name_list(spark: SparkSession, path: str) -> DataFrame:
    """``name`` of every line that is neither blank nor a comment."""
    lines = spark.read.text(path)
    return lines.filter((F.trim("value") != "") & ~F.startswith("value", F.lit("#"))).select(F.trim("value").alias("name"))


def aliases(spark: SparkSession, path: str) -> DataFrame:
    """Curated entries from one JSON object keyed by alias."""
    raw = spark.read.text(path, wholetext=True)
    entry = "map<string,struct<repo:string,docs_url:string,trust:double,latest_ver:string>>"
    return raw.select(F.explode_outer(F.from_json("value", entry)).alias("alias", "e")).select("alias", "e.*")


def modules(spark: SparkSession, path: str) -> DataFrame:
    """lang, module, page from one JSON object of the form ``{lang: {module: page}}``."""
    raw = spark.read.text(path, wholetext=True)
    langs = raw.select(F.explode_outer(F.from_json("value", "map<string,map<string,string>>")).alias("lang", "m"))
    return langs.select("lang", F.explode_outer("m").alias("module", "page"))


def activity(spark: SparkSession, path: str) -> DataFrame:
    """Activity log. ``top`` stays JSON text: it lists paths for one tool and structs for another."""
    return spark.read.schema(schema.ACTIVITY).json(path)


def golden(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schema.GOLDEN).json(path, multiLine=True)


def query_table(spark: SparkSession, path: str) -> DataFrame:
    """n, query, lib from the rows of a Markdown table."""
    return spark.read.text(path).filter(F.rlike("value", F.lit(QUERY_ROW))).select(
        F.regexp_extract("value", QUERY_ROW, 1).cast("int").alias("n"),
        F.regexp_extract("value", QUERY_ROW, 2).alias("query"),
        F.regexp_extract("value", QUERY_ROW, 3).alias("lib"),
    )


def report_rows(spark: SparkSession, path: str) -> DataFrame:
    """n, library, outcome (``@k``, ``miss`` or ``n/a``) from a rendered report."""
    return spark.read.text(path).filter(F.rlike("value", F.lit(REPORT_ROW))).select(
        F.regexp_extract("value", REPORT_ROW, 1).cast("int").alias("n"),
        F.regexp_extract("value", REPORT_ROW, 2).alias("library"),
        F.regexp_extract("value", REPORT_ROW, 3).alias("outcome"),
    )


def build_log(spark: SparkSession, path: str) -> DataFrame:
    """library, outcome (OK or FAIL) from the log of a batch build."""
    line = r"cache: (\S+) (OK|FAIL)"
    return spark.read.text(path).filter(F.rlike("value", F.lit(line))).select(
        F.regexp_extract("value", line, 1).alias("library"), F.regexp_extract("value", line, 2).alias("outcome")
    )


def junit_totals(spark: SparkSession, path: str) -> DataFrame:
    """tests, failures, errors, skipped of a JUnit report."""
    suites = spark.read.format("xml").option("rowTag", "testsuite").load(path)
    names = ["tests", "failures", "errors", "skipped"]
    return suites.agg(*[
        F.sum(F.col(f"_{n}").cast("long") if f"_{n}" in suites.columns else F.lit(0).cast("long")).alias(n) for n in names
    ])

