"""Files waiting, and records already written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from triago import fixed

FILE = "path string, modificationTime timestamp, length long, content binary"


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def wanted_file(path: Column) -> Column:
    """Neither a system file nor a temporary or hidden one."""
    name = base_name(path)
    return ~F.lower(name).isin(*fixed.IGNORED_FILES) & ~name.startswith("~$") & ~name.startswith(".")


def inbox(spark: SparkSession, folder: str) -> DataFrame:
    """The files right in a folder (path, modificationTime, length, content); none if the folder is missing."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], FILE)
    return spark.read.format("binaryFile").load(folder).where(wanted_file(F.col("path")))


def file_name(path: Column) -> Column:
    """The last part of a path in decoded form."""
    return F.url_decode(F.replace(base_name(path), F.lit("+"), F.lit("%2B")))


def records(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """JSON records below a folder, one in a file, with their path; what can't be parsed or has no fields is left out."""
    rows = spark.read.schema(f"{schema}, _corrupt string").json(folder, multiLine=True, recursiveFileLookup=True, pathGlobFilter="*.json", columnNameOfCorruptRecord="_corrupt")
    return rows.withColumn("path", F.input_file_name()).where("_corrupt is null and champs is not null").drop("_corrupt")


def companions(files: DataFrame) -> DataFrame:
    """(folder, stem, json, txt, original) of files (path): what shares a folder and a stem, or the stem and _original."""
    name = base_name(F.col("path"))
    ext = F.lower(F.regexp_extract(name, r"(?s)[^.](\.[^.]+)$", 1))
    stem = F.substring(name, F.lit(1), F.length(name) - F.length(ext))
    copied = stem.endswith("_original")
    rows = files.select("path", F.regexp_replace("path", "/[^/]*$", "").alias("folder"), ext.alias("ext"), copied.alias("copied"), F.regexp_replace(stem, "_original$", "").alias("stem"))
    produced = rows["ext"].isin(".txt", ".json") & ~rows["copied"]
    pick = lambda e: F.min(F.when((F.col("ext") == e) & ~F.col("copied"), F.col("path"))).alias(e[1:])
    return rows.groupBy("folder", "stem").agg(pick(".json"), pick(".txt"), F.min(F.when(~produced, F.col("path"))).alias("original"))


def loaded(records_: DataFrame, texts: DataFrame) -> DataFrame:
    """``records_`` (path, texte_brut, ...) with text: that of the companion .txt file (path, value) where there is one,
    else the record's own."""
    stem = lambda c: F.regexp_replace(c, r"\.[^./]+$", "")
    own = texts.select(stem(F.col("path")).alias("_stem"), F.col("value").alias("_text"))
    return records_.withColumn("_stem", stem(F.col("path"))).join(own, "_stem", "left").withColumn("text", F.coalesce("_text", "texte_brut")).drop("_stem", "_text")


def accepted_uploads(names: DataFrame) -> DataFrame:
    """(name, accepted): the bare names of uploads, and whether their extension is one that is read."""
    bare = F.regexp_extract(F.replace(F.col("name"), F.lit("\\"), F.lit("/")), "[^/]*$", 0)
    return names.select(bare.alias("name"), F.lower(F.regexp_extract(bare, r"(?s)[^.](\.[^.]+)$", 1)).isin(*fixed.EXTENSIONS).alias("accepted"))
