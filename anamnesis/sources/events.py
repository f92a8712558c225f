"""Event, code and cohort scans."""

from __future__ import annotations

import csv
import re
from collections.abc import Mapping
from concurrent.futures import ThreadPoolExecutor

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from anamnesis.operators.cohort import latest_description

EVENT_SCHEMA = "subject_id BIGINT, time TIMESTAMP_NTZ, code STRING, numeric_value DOUBLE"
COHORT_SCHEMA = "subject_id BIGINT, prediction_time TIMESTAMP_NTZ, boolean_value BOOLEAN"
STAY_SCHEMA = "stay_id BIGINT, split_2020 STRING, time STRING, hi_start STRING"
#: Files whose first line is read at once.
HEADER_READERS = 32
#: Column of the text of rows that don't fit their header or types.
MALFORMED = "malformed"


def _files(spark: SparkSession, path: str, kind: str) -> list[str]:
    """Files of a kind below a directory, from the listing alone."""
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{kind}")
    java = spark._jvm.java.net.URI
    return sorted(spark._jvm.org.apache.hadoop.fs.Path(java(name)).toString() for name in listing.load(path).inputFiles())


def as_glob(path: str) -> str:
    """A path as a pattern that matches it alone."""
    return re.sub(r"([\[\]{}*?,\\])", r"\\\1", path)


def read_header(spark: SparkSession, file: str) -> tuple[str, ...] | None:
    """Column names in the first line of a CSV file; None for an empty file.

    Only the start of the file is read, by the file system that Spark reads it with.
    """
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(file)
    stream = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).open(path)
    reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream, "UTF-8"))
    try:
        line = reader.readLine()
        while line is not None and line.count('"') % 2:  # a line break inside a name
            more = reader.readLine()
            if more is None:
                break
            line += "\n" + more
    finally:
        reader.close()
    if line is None:
        return None
    names = tuple(next(csv.reader([line.removeprefix("\ufeff")], strict=False), ()))
    if len(set(names)) < len(names):
        raise ValueError(f"{file}: a column name is used twice in {list(names)}")
    return names


def csv_groups(spark: SparkSession, files: list[str]) -> dict[tuple[str, ...], list[str]]:
    """Files by the columns of their header, in the order of the first file of each; empty files are left out."""
    with ThreadPoolExecutor(HEADER_READERS) as pool:
        headers = list(pool.map(lambda file: read_header(spark, file), files))
    groups: dict[tuple[str, ...], list[str]] = {}
    for file, header in zip(files, headers, strict=True):
        if header is not None:
            groups.setdefault(header, []).append(file)
    return groups


def _typed(header: tuple[str, ...], types: Mapping[str, T.DataType]) -> list[Column]:
    """Text columns as their types, and the row as text where one of them is not of its type.

    Spark's own mark of a wrong row depends on the columns that a query reads; this one doesn't.
    """
    wrong, columns = F.lit(False), []
    for name in header:
        column = F.col(f"`{name}`")
        if name in types and not isinstance(types[name], T.StringType):
            cast = column.try_cast(types[name])
            wrong = wrong | (column.isNotNull() & cast.isNull())
            column = cast
        columns.append(column.alias(name))
    text = F.to_csv(F.struct(*[F.col(f"`{name}`") for name in header]), {"escape": '"'})
    return [*columns, F.coalesce(F.col(MALFORMED), F.when(wrong, text)).alias(MALFORMED)]


def _scan_csv(
    spark: SparkSession, path: str, files: list[str], schema: str | None, origin: Mapping[str, Column], malformed: bool, multi_line: bool
) -> DataFrame:
    types = {f.name: f.dataType for f in T.StructType.fromDDL(schema)} if schema else {}
    groups = csv_groups(spark, files)
    if not groups:
        empty = T.StructType([T.StructField(n, t) for n, t in types.items()])
        return spark.createDataFrame([], empty).withColumns({n: F.lit(None).cast("string") for n in ([MALFORMED] if malformed else [])})
    parts = []
    for header, own in groups.items():
        if types and not set(types) & set(header):
            raise ValueError(f"{own[0]}: its first line {list(header)} names none of the columns {list(types)}")
        # The guard: a file whose header turns out another one than was read is an error.
        reader = spark.read.options(header=True, escape='"', enforceSchema=False)
        if multi_line or any("\n" in name for name in header):
            reader = reader.option("multiLine", True)
        if schema is None:
            reader = reader.option("inferSchema", True)
        else:
            fields = [T.StructField(name, T.StringType() if malformed else types.get(name, T.StringType())) for name in header]
            if malformed:
                fields.append(T.StructField(MALFORMED, T.StringType()))
                reader = reader.options(columnNameOfCorruptRecord=MALFORMED, columnPruning=False)
            reader = reader.schema(T.StructType(fields))
        if own == files:
            rows = reader.options(recursiveFileLookup=True, pathGlobFilter="*.csv").csv(path)
        else:
            rows = reader.csv([as_glob(file) for file in own])
        columns = _typed(header, types) if malformed and schema is not None else [F.col(f"`{name}`") for name in rows.columns]
        parts.append(rows.select(*columns, *[column.alias(name) for name, column in origin.items()]))
    # The known columns first, then the others in the order in which headers name them.
    union = union_shards(*parts) if len(parts) > 1 else parts[0]
    missing = {name: F.lit(None).cast(kind) for name, kind in types.items() if name not in union.columns}
    union = union.withColumns(missing) if missing else union
    last = [name for name in (MALFORMED, *origin) if name in union.columns]
    rest = [name for name in union.columns if name not in types and name not in last]
    return union.select(*types, *rest, *last) if types else union


def scan_events(
    spark: SparkSession,
    path: str,
    csv_schema: str | None = EVENT_SCHEMA,
    origin: Mapping[str, Column] | None = None,
    malformed: bool = False,
    multi_line: bool = False,
) -> DataFrame:
    """One ``.csv`` or ``.parquet`` file, or a directory searched with its sub-directories.

    A directory is read as CSV when it holds any ``*.csv``, otherwise as Parquet. Files may have their columns in any
    order, and different ones: columns go by name, and one that a file lacks is null there. CSV columns that
    ``csv_schema`` names have its types, others are text; ``None`` infers all types, which reads the files once more.

    ``origin`` adds columns made where a file is scanned (``split_from_path``, ``source_order``), as ``_metadata`` does not
    outlive the union of files with different headers. With ``malformed`` a column of this name holds the text of CSV rows
    that don't fit their header or types; it is null in all others. Values with line breaks need ``multi_line``, with which
    a file is not split between tasks.
    """
    origin = dict(origin or {})
    name = path.rstrip("/").rsplit("/", 1)[-1]
    single = name.endswith((".csv", ".parquet"))
    kinds = [name.rsplit(".", 1)[-1]] if single else ["csv", "parquet"]
    for kind in kinds:
        files = _files(spark, path, kind)
        if kind == "csv" and files:
            return _scan_csv(spark, path, files, csv_schema, origin, malformed, multi_line)
        if files:
            options = {} if single else {"recursiveFileLookup": True, "pathGlobFilter": "*.parquet"}
            rows = spark.read.options(mergeSchema=not single or len(files) > 1, **options).parquet(path)
            added = {MALFORMED: F.lit(None).cast("string")} if malformed else {}
            extra = [c.alias(n) for n, c in {**added, **origin}.items()]
            return rows.select(*rows.columns, *extra) if extra else rows
    raise ValueError(f"{path}: supported are .csv and .parquet files")


def scan_codes(spark: SparkSession, path: str) -> DataFrame:
    """Code dictionary; of a code named twice the last row of the file counts."""
    # Rows are numbered within a block of the file, blocks by where they start.
    codes = spark.read.parquet(path).select("code", "description", source_order().alias("__row"))
    return latest_description(codes, F.col("__row"))


def scan_cohort(
    spark: SparkSession, path: str, schema: str = COHORT_SCHEMA, origin: Mapping[str, Column] | None = None
) -> DataFrame:
    """Cohort file or directory, same rules as for events; a row that doesn't fit is an error when it is read."""
    rows = scan_events(spark, path, schema, origin, malformed=True)
    wrong = F.raise_error(F.concat(F.lit(f"{path}: not a row of a cohort: "), F.col(MALFORMED)))
    return rows.where(F.when(F.col(MALFORMED).isNull(), True).otherwise(wrong.cast("boolean"))).drop(MALFORMED)


def scan_test_cohort(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def source_order() -> Column:
    """Where a row of a scan comes from: its file, its block of the file, its place in the block."""
    return F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )


def split_from_path(root: str) -> Column:
    """Split of a row: its sub-directory under ``root``, or the stem of its file."""
    # The path of a row is a URI; a plus sign in it stands for itself.
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    name = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "", root).rstrip("/")
    below = F.substring_index(path, name + "/", -1)
    inside = F.when(path.endswith(name), F.substring_index(path, "/", -1)).otherwise(below)
    return F.when(F.instr(inside, "/") > 0, F.regexp_extract(inside, r"^(.*)/[^/]+$", 1)).otherwise(
        F.regexp_extract(inside, r"([^/]*?)(\.[^./]*)?$", 1)
    )


def scan_stays(spark: SparkSession, path: str, schema: str = STAY_SCHEMA) -> DataFrame:
    """Legacy stay table, its list columns parsed from text."""
    stays = spark.read.schema(schema).option("header", True).option("escape", '"').csv(path)
    return stays.withColumns(
        {c: F.from_json(c, "array<int>") for c in ("time", "hi_start") if c in stays.columns}
    )


def union_shards(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Tables of several shards as one; columns missing in a shard are null."""
    for other in others:
        first = first.unionByName(other, allowMissingColumns=True)
    return first


def write_new(df: DataFrame, path: str, rebase: bool = False, partition_by: tuple = ()) -> None:
    """Write Parquet; an existing path is an error unless it is to be rebased."""
    writer = df.write.mode("overwrite" if rebase else "errorifexists")
    try:
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    except AnalysisException as error:
        if "PATH_ALREADY_EXISTS" in str(error):
            raise FileExistsError(f"{path} exists; pass rebase=True to replace it") from error
        raise
