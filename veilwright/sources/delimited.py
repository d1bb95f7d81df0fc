"""Reading comma- and tab-separated files."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilwright.spec import check_columns

# Separators by file suffix, and texts read as a missing value.
SEPARATORS = {".csv": ",", ".tsv": "\t"}
MISSING = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


def _separator(path: str) -> str:
    suffix = os.path.splitext(path.rstrip("/"))[1].lower()
    if suffix not in SEPARATORS:
        raise ValueError(f"cannot read {path!r}: the name must end in one of {', '.join(SEPARATORS)}")
    return SEPARATORS[suffix]


def _known(name: str) -> Column:
    column = F.col(f"`{name}`")
    return F.when(~column.isin(*MISSING), column)


def _infer(raw: DataFrame) -> T.StructType:
    """Types that fit every known value, found in one aggregate over the file."""
    if not raw.columns:
        return T.StructType()
    shapes = {
        "bigint": r"^\s*[+-]?\d{1,18}\s*$",
        "double": r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$",
        "date": r"^\d{4}-\d{2}-\d{2}$",
        "timestamp_ntz": r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?$",
        "boolean": r"^([Tt]rue|TRUE|[Ff]alse|FALSE)$",
    }
    tests = []
    for i, name in enumerate(raw.columns):
        for kind, shape in shapes.items():
            fits = F.col(f"`{name}`").rlike(shape) & F.col(f"`{name}`").try_cast(kind).isNotNull()
            tests.append(F.min(F.when(F.col(f"`{name}`").isNotNull(), fits)).alias(f"{i}/{kind}"))
    fit = raw.agg(*tests).first()
    picked = []
    for i, name in enumerate(raw.columns):
        kind = next((x for x in shapes if fit[f"{i}/{x}"]), "string")
        picked.append(T.StructField(name, T._parse_datatype_string(kind), True))
    return T.StructType(picked)


def read_delimited(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None, multiline: bool = True
) -> DataFrame:
    """A table from a ``.csv`` or ``.tsv`` file with a header row.

    Give a schema wherever possible: it saves one pass over the data and keeps codes such as
    ``01234`` as text.  Its columns are looked up by their names in the header.  Without one, types are chosen to fit every value.
    Line breaks inside quotes belong to the value.  A file with such breaks cannot be cut, so each file is one
    task; where it is known that there are none, ``multiline=False`` reads large files in pieces.
    """
    reader = (
        spark.read.option("header", True)
        .option("sep", _separator(path))
        .option("escape", '"')
        .option("multiLine", multiline)
    )
    if isinstance(schema, str):
        schema = T._parse_datatype_string(schema)
    raw = reader.csv(path)
    if schema is not None:  # by name: the file may hold the columns in another order, and more of them
        check_columns(raw.columns, schema.fieldNames(), "schema")
        raw = raw.select(*[F.col(f"`{name}`") for name in schema.fieldNames()])
    raw = raw.select(*[_known(c).alias(c) for c in raw.columns])
    target = schema if schema is not None else _infer(raw)
    return raw.select(
        *[
            F.col(f"`{f.name}`") if isinstance(f.dataType, T.StringType)
            else F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name)
            for f in target
        ]
    )


def read_with_row_key(spark: SparkSession, path: str, name: str = "row_key") -> DataFrame:
    """A Parquet table with a stable key per row: its file and its position in that file.

    The position of a row is known to the scan itself, so the key costs no shuffle and comes
    out the same whenever a lost task is run again.
    """
    at = F.concat_ws("#", F.col("_metadata.file_path"), F.col("_metadata.row_index").cast("string"))
    return spark.read.parquet(path).select("*", at.alias(name))
