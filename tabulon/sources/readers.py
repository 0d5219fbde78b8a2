"""Reading tables by file kind, and finding equal content."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tabulon.errors import InvalidRequest
from tabulon.functions.schema import col, require_columns
from tabulon.sources.records import read_records

# File kinds that can be read.
SUFFIXES = (".csv", ".tsv", ".json", ".parquet")


def read_csv(
    spark: SparkSession,
    path: str,
    sep: str = ",",
    schema: T.StructType | str | None = None,
    dates_as_strings: bool = True,
    multi_line: bool = True,
    header: bool = True,
) -> DataFrame:
    """A table with a header line, or without where a schema is given. A cell that does not fit its column becomes null.

    A quote inside a quoted cell is doubled, and a quoted cell may hold line breaks: each file is read in many splits,
    whose records are told apart in two passes (``records``), and line breaks stay as they are written. ``multi_line=False`` is for files without such cells.
    Rows come in no given order.

    Without a schema the types are inferred, which reads the file once more; dates stay text
    unless asked for, and every date operator accepts both.
    """
    options = {
        "sep": sep, "mode": "PERMISSIVE", "multiLine": multi_line, "quote": '"', "escape": '"', "preferDate": not dates_as_strings,
    }
    if dates_as_strings and schema is None:
        # A format no text has keeps inference from turning text into instants.
        never = "'no'yyyyMMdd'date'"
        options |= {"timestampFormat": never, "timestampNTZFormat": never}
    reader = spark.read.options(**options)
    if not multi_line:
        reader = reader.option("header", header)
        return (reader.schema(schema) if schema is not None else reader.option("inferSchema", True)).csv(path)
    records = read_records(spark, path, sep)
    rows = records.filter(~F.col("first")) if header else records
    if schema is None:
        # The first record alone gives the names.
        names = reader.option("header", header).csv(path).columns
        schema = _inferred(spark, rows, names, options)
    parsed = F.from_csv("record", _ddl(_fields(spark, schema)), _texts(options))
    return rows.select(parsed.alias("row")).select("row.*")


def _fields(spark: SparkSession, schema: T.StructType | str) -> T.StructType:
    return spark.createDataFrame([], schema).schema


def _ddl(schema: T.StructType) -> str:
    return ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in schema)


def _texts(options: dict) -> dict[str, str]:
    return {k: str(v).lower() if isinstance(v, bool) else v for k, v in options.items()}


def _inferred(spark: SparkSession, rows: DataFrame, names: list[str], options: dict) -> T.StructType:
    """Types of all columns, inferred by Spark from records that have a cell for each name."""
    cells = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))])
    kept = _texts(options | {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False})
    lines = rows.select(F.to_csv(F.from_csv("record", _ddl(cells), _texts(options)), kept).alias("line"))
    found = spark.read.options(**options).option("inferSchema", True).csv(lines.rdd.map(lambda r: r["line"]))
    types = [f.dataType for f in found.schema] or [T.StringType()] * len(names)
    return T.StructType([T.StructField(n, t) for n, t in zip(names, types)])


def read_tsv(spark: SparkSession, path: str, **options) -> DataFrame:
    return read_csv(spark, path, sep="\t", **options)


def read_json(
    spark: SparkSession, path: str, json_mode: str = "either", schema: T.StructType | str | None = None
) -> DataFrame:
    """``lines`` has one object per line and can be split; ``array`` is one JSON array per file;
    ``either`` looks at the first character of the first file that has one."""
    if json_mode not in ("lines", "array", "either"):
        raise InvalidRequest("json_mode must be lines, array or either")
    if json_mode == "either":
        first = spark.read.text(path).select(F.ltrim("value").alias("line")).filter("line <> ''").first()
        json_mode = "array" if first is not None and first["line"].startswith("[") else "lines"
    reader = spark.read.option("multiLine", json_mode == "array")
    return (reader.schema(schema) if schema is not None else reader).json(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_table(spark: SparkSession, path: str, **options) -> DataFrame:
    """Read by the suffix of the path."""
    readers = {".csv": read_csv, ".tsv": read_tsv, ".json": read_json, ".parquet": read_parquet}
    for suffix, reader in readers.items():
        if path.rstrip("/").lower().endswith(suffix):
            return reader(spark, path, **options)
    raise InvalidRequest(f"cannot read '{path}'; known kinds: {', '.join(SUFFIXES)}")


def file_hashes(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, bytes, content_hash) of every file below a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option(
        "recursiveFileLookup", True
    ).load(path)
    return files.select(
        "path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("content_hash")
    )


def content_duplicates(df: DataFrame, id_column: str, content: str) -> DataFrame:
    """Every record with the first record of the same content; null content is a copy of nothing.

    The first ids come from an aggregate, which merges the copies of one content before the
    shuffle. They join back on another form of the hash: a side that lies as the join wants it
    is not shuffled again, and then adaptive execution cannot split a content with many copies.
    """
    require_columns(df, [id_column, content])
    hashed = df.select(col(id_column), F.sha2(col(content).cast("string"), 256).alias("content_hash"))
    firsts = hashed.groupBy("content_hash").agg(
        F.min(col(id_column)).alias("first_id"), F.count(F.lit(1)).alias("copies")
    )
    backwards = F.reverse("content_hash").alias("__hash")
    named = firsts.filter(F.col("content_hash").isNotNull()).select(backwards, "first_id", "copies")
    return hashed.select("*", backwards).join(named, "__hash", "left").select(
        col(id_column), "content_hash", F.coalesce("first_id", col(id_column)).alias("first_id"),
        F.coalesce("copies", F.lit(1)).alias("copies"),
        F.coalesce(col(id_column) != F.col("first_id"), F.lit(False)).alias("is_duplicate"),
    )


def drop_content_duplicates(df: DataFrame, id_column: str, content: str) -> DataFrame:
    """Only the first record of each content, and all records without content."""
    require_columns(df, [id_column, content])
    held = df.filter(col(content).isNotNull())
    hashed = held.withColumn("__hash", F.sha2(col(content).cast("string"), 256))
    firsts = hashed.groupBy(F.col("__hash").alias("__of")).agg(F.min(col(id_column)).alias("__first"))
    same = (F.col("__hash") == F.col("__of")) & (col(id_column) == F.col("__first"))
    kept = hashed.join(firsts, same, "left_semi").drop("__hash")
    return kept.unionAll(df.filter(col(content).isNull()))
