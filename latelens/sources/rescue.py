"""Text tables with rows that do not parse: keep what is usable, set the rest aside, count both per file.

A row with too few or too many fields, or with a text where a number belongs, is rejected
whole.  A date that cannot be read becomes NULL and its row stays.  A file is parsed once: the
typed rows are staged together with what was wrong with them, and everything else reads that.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType, TimestampNTZType

from latelens.functions.expressions import parse_timestamp
from latelens.operators.staging import stage
from latelens.sources.guards import require_columns
from latelens.sources.tables import write_table

_RECORD, _FILE, _REASON, _BAD = "__record", "__file", "__reason", "__bad"


class TooManyRejects(ValueError):
    pass


@dataclass
class TextLoad:
    """``rows``: the usable rows under the schema.  ``rejects``: source_file, reason (``fields``
    or ``values``), bad_columns, record.  ``report``: per file rows, rejected, patched (kept,
    with NULL for a bad date)."""

    rows: DataFrame
    rejects: DataFrame
    report: DataFrame


def rescued(spark: SparkSession, path: str, schema: StructType, line_breaks: bool = False) -> DataFrame:
    """Every record of a CSV file or folder under ``schema``, and why it is no good.

    Empty fields are NULL and never wrong.  Of a row with a wrong number of fields no value is judged, as
    they may stand in the wrong columns.  The record of a row with a bad value is written anew from its fields.
    Columns the schema does not name are ignored, columns the header lacks are an error, and so is
    a file whose header differs from the others'.  Blank lines are no records.  With
    ``line_breaks`` quoted text may span lines, and an open quote takes the rest of its file.
    """
    header = spark.read.option("header", True).csv(path).columns
    require_columns(header, schema.fieldNames(), path)
    as_text = StructType([StructField(c, StringType()) for c in [*header, _RECORD]])
    # Without pruning the parser counts the fields of every row, whatever is selected.
    raw = (
        spark.read.schema(as_text).option("header", True).option("enforceSchema", False).option("multiLine", line_breaks)
        .option("columnNameOfCorruptRecord", _RECORD).option("columnPruning", False)
        .option("quote", '"').option("escape", '"').csv(path)
    ).withColumn(_FILE, F.col("_metadata.file_path"))

    def typed(field):
        if isinstance(field.dataType, TimestampNTZType):
            return parse_timestamp(field.name)
        return F.col(field.name).try_cast(field.dataType)

    texts = [f for f in schema.fields if isinstance(f.dataType, StringType)]
    judged = [f for f in schema.fields if f not in texts]
    wrong = {f.name: F.col(f.name).isNotNull() & typed(f).isNull() for f in judged}
    numbers = [wrong[f.name] for f in judged if not isinstance(f.dataType, TimestampNTZType)]
    bad_number = F.exists(F.array(*numbers), lambda w: w) if numbers else F.lit(False)
    bad = F.array_compact(F.array(*[F.when(w, F.lit(c)) for c, w in wrong.items()])) if wrong else F.array().cast("array<string>")
    broken = F.col(_RECORD).isNotNull()
    reason = F.when(broken, "fields").when(bad_number, "values")
    return raw.select(
        *[typed(f).alias(f.name) for f in schema.fields],
        F.col(_FILE),
        reason.alias(_REASON),
        F.when(broken, F.array().cast("array<string>")).otherwise(bad).alias(_BAD),
        F.when(broken, F.col(_RECORD)).when(bad_number, F.to_csv(F.struct(*header))).alias(_RECORD),
    )


def load_text(
    spark: SparkSession,
    path: str,
    schema: StructType,
    quarantine_path: str | None = None,
    most_rejected: float | None = None,
    line_breaks: bool = False,
) -> TextLoad:
    """Parse once; write the rejects, if any or none, to ``quarantine_path``.

    A load of which more than the share ``most_rejected`` is rejected stops, after the
    quarantine is written.
    """
    staged = stage(rescued(spark, path, schema, line_breaks), "text_rows")
    rejected = F.col(_REASON).isNotNull()
    load = TextLoad(
        rows=staged.where(~rejected).select(*schema.fieldNames()),
        rejects=staged.where(rejected).select(
            F.col(_FILE).alias("source_file"), F.col(_REASON).alias("reason"),
            F.col(_BAD).alias("bad_columns"), F.col(_RECORD).alias("record")),
        report=staged.groupBy(F.col(_FILE).alias("source_file")).agg(
            F.count(F.lit(1)).alias("rows"), F.count_if(rejected).alias("rejected"),
            F.count_if(~rejected & (F.size(_BAD) > 0)).alias("patched")),
    )
    if quarantine_path is not None:
        write_table(load.rejects, quarantine_path)
    if most_rejected is not None:
        rows, lost = load.report.agg(F.sum("rows"), F.sum("rejected")).first()
        if rows and lost > most_rejected * rows:
            raise TooManyRejects(f"{lost} of {rows} rows of {path} do not parse")
    return load
