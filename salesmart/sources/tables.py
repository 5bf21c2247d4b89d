"""Reading the extract, and probing the catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from salesmart.model import RawTables
from salesmart.sources import workbooks
from salesmart.sources.schemas import RAW


def read_raw(spark: SparkSession, folder: str, fmt: str = "parquet", **options) -> RawTables:
    """Read ``stores``, ``products``, ``customers`` and ``sales`` from ``folder``.

    From text formats and workbooks ``sale_date`` is read as text, so that a bad date reaches
    the cleaning step instead of being lost in the reader. Each table of an extract of workbooks
    (``fmt="workbooks"``) is a folder of them or one file, ``stores.xlsx`` and so on.
    """
    text = fmt in ("csv", "json", workbooks.FORMAT)
    if fmt == "csv":
        options.setdefault("header", True)
    if fmt == workbooks.FORMAT:
        workbooks.register(spark)

    def table(name: str) -> DataFrame:
        schema = RAW[name]
        if text and name == "sales":
            schema = schema.replace("sale_date timestamp_ntz", "sale_date string")
        return spark.read.format(fmt).options(**options).schema(schema).load(f"{folder}/{name}")

    return RawTables(*(table(name) for name in RAW))


def run_query(spark: SparkSession, sql: str) -> DataFrame:
    """Run SQL over the installed views; errors are raised, never swallowed."""
    return spark.sql(sql)


def table_exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)


def column_exists(spark: SparkSession, table: str, column: str) -> bool:
    return table_exists(spark, table) and column in spark.table(table).columns


def optional_table(spark: SparkSession, table: str, column: str) -> DataFrame | None:
    """The table if it exists with that column, else None."""
    return spark.table(table) if column_exists(spark, table, column) else None
