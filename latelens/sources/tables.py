"""Reading and writing tables with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType, TimestampNTZType

from latelens.functions.expressions import parse_timestamp
from latelens.schemas import CONSOLIDATED, FEATURE_TABLE, RAW_TABLES
from latelens.sources.commits import finish_commit, replacing
from latelens.sources.guards import require_columns


def read_table(
    spark: SparkSession, path: str, schema: StructType | None = None, line_breaks: bool = False
) -> DataFrame:
    """Parquet as it is; CSV with a header, by column name, under an explicit schema.

    CSV timestamps are read as text and parsed so that a bad date becomes NULL.
    Columns the schema does not name are ignored, columns the file lacks are an error, and
    so is a file of a folder whose header differs from the others'.
    ``line_breaks`` is for quoted text that spans lines; such files cannot be split, so
    work is then shared per file rather than per block.  A replacement that was cut off is finished first.
    """
    finish_commit(spark, path)
    if path.rstrip("/").endswith(".csv"):
        if schema is None:
            raise ValueError("a CSV file needs a schema")
        header = spark.read.option("header", True).csv(path).columns
        require_columns(header, schema.fieldNames(), path)
        kinds = {f.name: f.dataType for f in schema.fields}
        as_text = StructType([
            StructField(
                c,
                StringType() if isinstance(kinds.get(c), TimestampNTZType) else kinds.get(c, StringType()),
            )
            for c in header
        ])
        raw = (
            spark.read.schema(as_text).option("header", True).option("enforceSchema", False).option("multiLine", line_breaks)
            .option("quote", '"').option("escape", '"').csv(path)
        )
        return raw.select(*[
            parse_timestamp(f.name).alias(f.name) if isinstance(f.dataType, TimestampNTZType) else F.col(f.name)
            for f in schema.fields
        ])
    return spark.read.parquet(path)


def read_consolidated(spark: SparkSession, path: str) -> DataFrame:
    df = read_table(spark, path, CONSOLIDATED)
    require_columns(df.columns, CONSOLIDATED.fieldNames(), path)
    return df


def read_features(spark: SparkSession, path: str) -> DataFrame:
    df = read_table(spark, path, FEATURE_TABLE)
    require_columns(df.columns, FEATURE_TABLE.fieldNames(), path)
    return df


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop_path)


def load_catalog(spark: SparkSession, paths: dict[str, str], views: bool = True) -> dict[str, DataFrame]:
    """All raw tables by name; any missing file stops the job before work begins."""
    missing = sorted(set(RAW_TABLES) - set(paths))
    if missing:
        raise FileNotFoundError(f"no path given for tables {missing}")
    absent = sorted(f"{name} ({path})" for name, path in paths.items() if not _exists(spark, path))
    if absent:
        raise FileNotFoundError(f"tables not found: {absent}")
    tables = {
        name: read_table(spark, path, RAW_TABLES.get(name), line_breaks=name == "reviews")
        for name, path in paths.items()
    }
    if views:
        for name, df in tables.items():
            df.createOrReplaceTempView(name)
    return tables


def write_table(df: DataFrame, path: str, format: str = "parquet", partition_by: list[str] | None = None) -> None:
    """Replace the table at ``path``, or leave it as it is on failure; CSV gets a header and UTF-8 text.

    The rows may come from the table itself.
    """
    writer = df.write.format(format)
    if format == "csv":
        writer = writer.option("header", True).option("encoding", "UTF-8")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    with replacing(df.sparkSession, path) as folder:
        writer.save(folder)
