"""Queries over one market segment see all of its files, and counts of parts aren't cut."""

import os

import pytest
from pyspark.sql import functions as F

from loamline.operators import payloads
from loamline.plans.catalog import QUERIES
from loamline.plans.registry import table

DATA = "/root/testdata/sf0.01"
needs_tables = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def test_skeleton_counts_all_modules(spark):
    mods = spark.range(50).select(F.col("id").cast("string").alias("name"), F.lit(1).alias("n_files"))
    none = spark.createDataFrame([], "path string, strength int, src_module string, dst_module string, severity string, line int")
    parts = payloads.skeleton(mods, none, none, none)
    assert parts["module_count"].first()["n"] == 50
    assert parts["modules"].count() == 40


@needs_tables
def test_file_slice_finds_the_segment(spark):
    rows = QUERIES["file_slice"](spark, DATA).orderBy("line").collect()
    assert [r.line for r in rows] == [7, 8, 9, 10]
    assert rows[0].content.startswith("class C")


@needs_tables
def test_directory_listing_counts_the_segment(spark):
    n = table(spark, DATA, "customer").where("c_mktsegment = 'BUILDING'").count()
    rows = QUERIES["directory_listing"](spark, DATA).collect()
    assert n > 0 and sum(r.n_files for r in rows if r.is_dir) == n
