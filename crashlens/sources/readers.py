"""Table readers: CSV with a header, or columnar files Spark reads natively."""

from __future__ import annotations

from collections.abc import Collection, Mapping
from typing import Literal, NamedTuple

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from crashlens.sources.schemas import SCHEMAS
from crashlens.sources.sinks import write_result


def read_strings(spark: SparkSession, path: str, **options) -> DataFrame:
    """Read CSV with a header, every column as text.

    ``enforceSchema=False`` makes Spark check the header of every file against the first one, so a file
    with its columns in another order fails the read instead of silently swapping values.
    """
    return spark.read.options(header=True, enforceSchema=False, **options).csv(path)


OnBad = Literal["keep", "raise", "reject"]

#: Text of a record whose fields don't fit the header; NULL for all others.
_RECORD = "_broken_record"


def _marked(spark: SparkSession, path: str, infer: bool = False, **options) -> DataFrame:
    """CSV as ``read_table`` without a schema gives it, and the text of broken records in one more column.

    A record is broken if it has more or fewer fields than the header, an open quote among the causes. Spark sees that only where it
    reads all columns, so their pruning is off.
    """
    plain = read_strings(spark, path, inferSchema=infer, **options)
    schema = StructType([*plain.schema.fields]).add(_RECORD, StringType())
    marks = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _RECORD, "columnPruning": False}
    return spark.read.schema(schema).options(**({"header": True, "enforceSchema": False} | options | marks)).csv(path)


def _broken(marked: DataFrame) -> Column:
    # Spark refuses to read the text of broken records without any other column, so the test names one.
    return F.col(_RECORD).isNotNull() & (F.length(F.coalesce(F.col(f"`{marked.columns[0]}`").cast("string"), F.lit(""))) >= 0)


def _records(marked: DataFrame) -> DataFrame:
    return marked.where(_broken(marked)).select(F.col(_RECORD).alias("record"), F.col("_metadata.file_path").alias("file"))


def read_rejects(spark: SparkSession, path: str, **options) -> DataFrame:
    """(record, file) of the broken records of CSV files: their text as it stands there, and the file they are from."""
    return _records(_marked(spark, path, **options))


def to_schema(
    df: DataFrame, schema: StructType, optional: Collection[str] = (), keep_other: bool = True
) -> DataFrame:
    """Give the schema's columns their names and types, first; text that does not parse becomes NULL.

    A column of the schema that ``df`` lacks is an error unless it is named in ``optional``, then it is NULL. Other
    columns of ``df`` follow as they are, or go with ``keep_other=False``.
    """
    present = {field.name.upper(): field for field in df.schema.fields}
    allowed = {name.upper() for name in optional}
    named = {field.name.upper() for field in schema.fields}
    lost = [field.name for field in schema.fields if field.name.upper() not in present.keys() | allowed]
    if lost:
        raise ValueError(f"columns missing: {', '.join(lost)}; there are {', '.join(df.columns)}")

    def typed(field):
        source = present.get(field.name.upper())
        if source is None:
            return F.lit(None).cast(field.dataType).alias(field.name)
        column = F.col(f"`{source.name}`")
        if source.dataType != field.dataType:
            column = column.try_cast(field.dataType)
        return column.alias(field.name)

    others = [F.col(f"`{name}`") for name in df.columns if keep_other and name.upper() not in named]
    return df.select([typed(field) for field in schema.fields] + others)


def read_table(
    spark: SparkSession,
    path: str,
    schema: StructType | None = None,
    fmt: str = "csv",
    infer: bool = False,
    optional: Collection[str] = (),
    keep_other: bool = True,
    on_bad: OnBad = "keep",
    **options,
) -> DataFrame:
    """Read one table.

    With ``schema`` its columns are bound by name and typed by it (see ``to_schema``), and the others stay as they are. Without one, CSV columns stay text, or
    get data-dependent types with ``infer=True``, which costs one more pass over the files.

    ``on_bad`` says what becomes of CSV records with too few or too many fields: ``"keep"`` fills with NULL or cuts, as Spark
    does, ``"raise"`` fails the query that meets one, ``"reject"`` leaves them out (see ``read_rejects``).
    """
    if fmt == "csv":
        infer = infer and schema is None
        if on_bad == "reject":
            marked = _marked(spark, path, infer, **options)
            df = marked.where(~_broken(marked)).drop(_RECORD)
        elif on_bad == "raise":
            df = read_strings(spark, path, inferSchema=infer, **({"mode": "FAILFAST", "columnPruning": False} | options))
        else:
            df = read_strings(spark, path, inferSchema=infer, **options)
    else:
        df = spark.read.format(fmt).options(**options).load(path)
    return df if schema is None else to_schema(df, schema, optional, keep_other)


def read_tables(
    spark: SparkSession, paths: Mapping[str, str], fmt: str = "csv", **options
) -> dict[str, DataFrame]:
    """Read the named crash tables, each with its fixed schema."""
    return {name: read_table(spark, path, SCHEMAS[name], fmt, **options) for name, path in paths.items()}


class Staged(NamedTuple):
    """A stored table, where its broken records are (None: it has none), and what the conversion counted: ``rows`` read,
    ``rejected`` records, and ``unparsed``, for each column the texts other than NA that its type does not take."""

    table: DataFrame
    rejects: str | None
    rows: int
    rejected: int
    unparsed: dict[str, int]


def stage_table(
    spark: SparkSession,
    path: str,
    target: str,
    schema: StructType | None = None,
    fmt: str = "csv",
    optional: Collection[str] = (),
    keep_other: bool = True,
    on_bad: OnBad = "raise",
    **options,
) -> Staged:
    """Write a table once as typed Parquet to ``target``, and count what the conversion did to it.

    ``on_bad`` (CSV only): with ``"raise"`` a broken record fails the write and nothing is stored; with ``"reject"`` the table goes
    without them and they are stored as (record, file) in ``target`` with ``-rejects`` added; with ``"keep"`` they are filled or cut, and counted. The
    counts come from the write itself, and only files with broken records are read again.
    """
    if fmt == "csv":
        marked = _marked(spark, path, **options)
        if on_bad == "raise":
            failed = F.raise_error(F.concat(F.lit("broken record: "), F.col(_RECORD)))
            marked = marked.withColumn(_RECORD, F.when(F.col(_RECORD).isNotNull(), failed.cast("string")))
    else:
        marked = read_table(spark, path, None, fmt, **options).withColumn(_RECORD, F.lit(None).cast("string"))
    source = marked.drop(_RECORD)
    typed = source if schema is None else to_schema(source, schema, optional, keep_other)
    present = {name.upper(): name for name in source.columns}
    texts = {
        field.name: present[field.name.upper()]
        for field in typed.schema.fields
        if field.name.upper() in present and source.schema[present[field.name.upper()]].dataType != field.dataType
    }
    good = F.col(_RECORD).isNull()
    lost = {
        name: F.count(F.when(good & F.col(f"`{was}`").isNotNull() & (F.col(f"`{was}`") != "NA") & F.col(f"`{was}`").try_cast(typed.schema[name].dataType).isNull(), 1))
        for name, was in texts.items()
    }
    counted = Observation()
    rejected = F.count(F.when(~good, 1))
    seen = marked.observe(counted, F.count(F.lit(1)).alias("rows"), rejected.alias("rejected"), *(n.alias(f"lost_{i}") for i, n in enumerate(lost.values())))
    kept = seen.where(good) if on_bad == "reject" else seen
    kept = kept.drop(_RECORD)
    stored = write_result(kept if schema is None else to_schema(kept, schema, optional, keep_other), target)
    counts = counted.get
    rejects = None
    if on_bad == "reject" and counts["rejected"]:
        rejects = f"{target.rstrip('/')}-rejects"
        write_result(_records(marked), rejects)
    return Staged(stored, rejects, counts["rows"], counts["rejected"], {name: counts[f"lost_{i}"] for i, name in enumerate(lost)})


def convert_tables(
    spark: SparkSession,
    paths: Mapping[str, str],
    parquet_paths: Mapping[str, str],
    fmt: str = "csv",
    on_bad: OnBad = "raise",
    **options,
) -> dict[str, DataFrame]:
    """Write the named crash tables once as typed Parquet and return them read back.

    CSV has no column pruning on disk and no vectorised scan, so a table that several analyses read should
    be converted first. Broken records fail the conversion unless they are to be rejected, see ``stage_table``.
    """
    return {name: stage_table(spark, path, parquet_paths[name], SCHEMAS[name], fmt, on_bad=on_bad, **options).table for name, path in paths.items()}
