"""File inventories, admission of inputs, extension classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casequill.functions.text import file_folder, file_name, file_stem, file_suffix
from casequill.operators.sizing import broadcast_if_small
from casequill.sources import rules


def describe_paths(files: DataFrame) -> DataFrame:
    """Add folder, name, stem and suffix to rows with a ``path`` relative to the root."""
    name = file_name(F.col("path"))
    return files.withColumns(
        {"folder": file_folder(F.col("path")), "name": name}
    ).withColumns({"stem": file_stem(F.col("name")), "suffix": file_suffix(F.col("name"))})


def list_files(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """``path, length, modificationTime`` of every file below ``root``.

    The content column is not selected, so no file is opened.
    """
    listed = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", str(recursive).lower())
        .load(root)
        .select("path", "length", "modificationTime")
    )
    base = F.lit(root.rstrip("/") + "/")
    relative = F.element_at(F.split(F.col("path"), F.concat(F.lit("\\Q"), base, F.lit("\\E"))), -1)
    return listed.withColumn("path", relative)


def visible_files(files: DataFrame, skip_folders=rules.SKIP_FOLDERS) -> DataFrame:
    """Files outside the skipped folders whose name does not start with a dot."""
    parts = F.split("path", "/")
    return files.where(
        ~F.arrays_overlap(parts, F.array(*[F.lit(s) for s in skip_folders]))
        & ~F.startswith(F.element_at(parts, -1), F.lit("."))
    )


def admit(
    files: DataFrame, extensions, max_bytes: int, blank_error: str = "empty name"
) -> DataFrame:
    """Add ``reject_reason``: null for admitted rows of ``name, length``."""
    suffix = F.lower(file_suffix(F.col("name")))
    allowed = [e.lower() for e in extensions]
    return files.withColumn(
        "reject_reason",
        F.when(F.coalesce(F.trim("name"), F.lit("")) == "", F.lit(blank_error))
        .when(~suffix.isin(allowed), F.lit("extension"))
        .when(F.col("length") > max_bytes, F.lit("size")),
    )


def distinct_uploads(files: DataFrame) -> DataFrame:
    """One row per (name, length), the first path; partial aggregation, no row order."""
    return files.groupBy("name", "length").agg(F.min("path").alias("path"), F.count("*").alias("copies"))


def preview_class(suffix: Column) -> Column:
    """``text``, ``image`` or ``external`` by extension."""
    return (
        F.when(F.lower(suffix).isin(*rules.TEXT_EXTENSIONS), F.lit("text"))
        .when(F.lower(suffix).isin(*rules.IMAGE_EXTENSIONS), F.lit("image"))
        .otherwise(F.lit("external"))
    )


def extension_table(spark: SparkSession) -> DataFrame:
    rows = [(e, "text") for e in rules.TEXT_EXTENSIONS] + [(e, "image") for e in rules.IMAGE_EXTENSIONS]
    return spark.createDataFrame(rows, "ext string, preview string")


def classify_by_table(files: DataFrame, extensions: DataFrame) -> DataFrame:
    """The same classes by a left join on the extension; a row per known extension."""
    return (
        files.withColumn("ext", F.lower("suffix"))
        .join(broadcast_if_small(extensions), "ext", "left")
        .withColumn("preview", F.coalesce("preview", F.lit("external")))
        .drop("ext")
    )


def missing_members(required: DataFrame, present: DataFrame, *keys: str) -> DataFrame:
    """Required members that are not present."""
    return required.select(*keys).distinct().join(present.select(*keys).distinct(), list(keys), "left_anti")
