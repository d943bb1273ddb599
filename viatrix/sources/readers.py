"""Sources and sinks of appraisal tables."""

import re
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import DoubleType, FloatType, IntegerType, LongType, StringType, StructField, StructType

from viatrix.session import shared_dir
from viatrix.sources import shared_files, workbooks

#: fixed values: networks by name
NETWORKS = {"AK_2035": "services_ak_2035", "AK_2035_extended": "services_ak_2035_extended", "current": "services_current", "2024_extended": "services_2024_extended"}
#: fixed values: what stands for "no value" in files
SENTINELS = ("-99", "[-99]", "[]", "nan", "")


def network_name(network: str) -> str:
    """The services table of a network; an unknown name is an error."""
    if network not in NETWORKS:
        raise ValueError(f"no network {network}; known are {', '.join(NETWORKS)}")
    return NETWORKS[network]


#: folders of results by what a label names
PLACES = {"development": "developments/dev_id={}", "enhanced": "enhanced/network={}", "network": "baseline/network={}"}


def parsed_label(label: str) -> tuple[str, str]:
    """(kind, id) that a label names: a development with its number, or a network, enhanced or as it is."""
    words = [w for w in re.split(r"[^A-Za-z0-9-]", label) if w]
    for word, number in zip(words, words[1:]):
        if word == "dev" and number.isdecimal():
            return "development", number
    return "enhanced" if "enhanced" in words else "network", "_".join(words) or "current"


def result_path(root: str, label: str) -> str:
    """Where the capacity tables of what a label names stand."""
    kind, name = parsed_label(label)
    return "/".join([root.rstrip("/"), PLACES[kind].format(name)])


def network_source(name: Column) -> Column:
    """network_name() of a column; null where the name is unknown."""
    known = F.create_map(*[F.lit(x) for pair in NETWORKS.items() for x in pair])
    return F.try_element_at(known, name)


def place_of(root: str, label: Column) -> Column:
    """result_path() of a column."""
    words = F.filter(F.split(label, "[^A-Za-z0-9-]"), lambda w: w != "")
    spaced = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
    number = F.regexp_extract(spaced, " dev ([0-9]+) ", 1)
    name = F.coalesce(F.nullif(F.array_join(words, "_"), F.lit("")), F.lit("current"))
    at = lambda kind, x: F.concat(F.lit(root.rstrip("/") + "/" + PLACES[kind].format("")), x)
    return F.when(number != "", at("development", number)).when(F.array_contains(words, "enhanced"), at("enhanced", name)).otherwise(at("network", name))


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path under the shared one."""
    return f"{shared_dir(spark)}/files/{name}-{uuid.uuid4().hex}"


def read_csv(spark: SparkSession, path: str, schema: StructType, **options) -> DataFrame:
    """A plain CSV file with a header; the schema is given, so the file is read once."""
    return spark.read.csv(path, schema=schema, header=True, **options)


def read_swiss_csv(spark: SparkSession, path: str, schema: StructType, encoding: str = "ISO-8859-1") -> DataFrame:
    """';' between fields, decimal comma, thousands marks; sentinels and unreadable numbers become null."""
    raw = StructType([StructField(f.name, StringType()) for f in schema])
    df = spark.read.csv(path, sep=";", header=True, schema=raw, encoding=encoding)
    columns = []
    for f in schema:
        c = F.when(~F.trim(f.name).isin(*SENTINELS), F.trim(f.name))
        if isinstance(f.dataType, (DoubleType, FloatType, IntegerType, LongType)):
            c = F.regexp_replace(F.regexp_replace(c, "['’ ]", ""), ",", ".").try_cast(f.dataType)
        columns.append(c.alias(f.name))
    return df.select(*columns)


def read_workbook(spark: SparkSession, path: str, sheet: str, schema: StructType, header: int = 0) -> DataFrame:
    """A sheet's table below its header in line ``header`` (from 0), one task a workbook; what can't be read as its type is null."""
    names = schema.names
    texts = spark.read.format("binaryFile").load(path).select("content").mapInPandas(workbooks.rows_of(sheet, names, header), StructType([StructField(n, StringType()) for n in names]))
    return texts.select(*[F.when(~F.trim(f.name).isin(*SENTINELS), F.trim(f.name)).try_cast(f.dataType).alias(f.name) for f in schema])


def write_workbook(spark: SparkSession, path: str, sheets: dict[str, list[list]]) -> None:
    """Small tables as the sheets of a workbook, at any path that Spark's file systems reach."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    out.write(workbooks.workbook(sheets))
    out.close()


def write_workbooks(df: DataFrame, path: str, sheet: str, name: Column, header: int = 0) -> None:
    """A workbook for each name, in the task that holds its rows, with its table below so many empty lines; a name's rows must fit a sheet."""
    columns = df.columns

    def book(pdf):
        cells = pdf[columns].astype(object)
        table = cells.where(cells.notna(), None).values.tolist()
        return pdf[["_name"]].head(1).rename(columns={"_name": "name"}).assign(content=workbooks.workbook({sheet: [[]] * header + [columns, *table]}))

    books = df.withColumn("_name", name).groupBy("_name").applyInPandas(book, "name string, content binary")
    shared_files.write_files(books, path, ".xlsx")


def read_numbered(spark: SparkSession, glob: str, pattern: str, name: str, **options) -> DataFrame:
    """CSV files of one folder, with the number that the file name holds as a column; null where it holds none."""
    return spark.read.csv(glob, **options).withColumn(name, F.regexp_extract(F.input_file_name(), pattern, 1).try_cast("int"))


def read_elevation(spark: SparkSession, path: str, resolution: int) -> DataFrame:
    """XYZ points on a coarser grid."""
    df = spark.read.csv(path, sep=" ", header=True, schema="x double, y double, z double")
    least = df.agg(F.min("x").alias("x0"), F.min("y").alias("y0"))
    on = lambda c, o: F.pmod(F.col(c) - F.col(o), F.lit(float(resolution))) == 0
    return df.join(F.broadcast(least)).where(on("x", "x0") & on("y", "y0")).select("x", "y", "z")  # one row


def stack_bands(bands: dict[str, DataFrame]) -> DataFrame:
    """Rasters (row, col, value) as one table with their band's name."""
    out = None
    for name, df in bands.items():
        df = df.select("row", "col", F.lit(name).alias("band"), "value")
        out = df if out is None else out.unionByName(df)
    return out


def write_each(df: DataFrame, path: str, by: str) -> None:
    """One folder for each value of a column; rows of one value meet first, so each folder gets few files."""
    df.repartition(by).write.mode("overwrite").partitionBy(by).parquet(path)


def cached(spark: SparkSession, path: str, build: Callable[[], DataFrame], use_cache: bool = True) -> DataFrame:
    """What was written to path before, else build()'s rows, written there."""
    if use_cache:
        try:
            return spark.read.parquet(path)
        except Exception as e:  # the path does not exist yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
    build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
