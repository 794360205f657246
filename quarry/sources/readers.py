"""Where rows come from: files, the catalog, other databases, functions that give tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.operators.tables import TableDef

FORMATS = ("parquet", "orc", "json", "csv", "text", "avro")


def read_files(spark: SparkSession, path: str, kind: str = "parquet", schema: str | None = None, **options) -> DataFrame:
    """Files of a kind Spark reads. Text formats need a schema: nothing is read twice to guess one."""
    if kind not in FORMATS:
        raise ValueError(f"unknown format {kind}")
    reader = spark.read.format(kind).options(**options)
    if schema:
        reader = reader.schema(schema)
    elif kind in ("json", "csv"):
        raise ValueError(f"{kind} needs a schema")
    return reader.load(path)


def read_database(spark: SparkSession, url: str, table: str, split: str | None = None, low: int = 0, high: int = 0, parts: int = 16, **options) -> DataFrame:
    """A table of another database by JDBC; with ``split``, in ``parts`` ranges of that column at once. Filters and columns are pushed down."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if split:
        reader = reader.options(partitionColumn=split, lowerBound=low, upperBound=high, numPartitions=parts)
    return reader.load()


def read_catalog(spark: SparkSession, database: str | None = None, skip: tuple[str, ...] = ()) -> list[TableDef]:
    """Definitions of the catalog's tables, with the keys and defaults that :meth:`TableDef.create` left."""
    found = spark.catalog.listTables(database)
    return [TableDef.of(spark.table(f"`{database}`.`{t.name}`" if database else f"`{t.name}`"), t.name) for t in found if not t.isTemporary and t.name not in skip]


def register_table_function(spark: SparkSession, name: str, function) -> None:
    """A Python class decorated with ``udtf`` under a name, for FROM and APPLY."""
    spark.udtf.register(name, function)


def shape(df: DataFrame) -> list[tuple[str, str, bool]]:
    """Names, types and nullability of a query's result; nothing runs."""
    return [(f.name, f.dataType.simpleString(), f.nullable) for f in df.schema]
