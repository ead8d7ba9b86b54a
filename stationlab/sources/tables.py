"""Stored tables."""

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)


def read_sql(spark: SparkSession, text: str) -> DataFrame:
    return spark.sql(text)


def postgres_url(host: str, port: int, database: str) -> str:
    return f"jdbc:postgresql://{host}:{port}/{database}"


def jdbc_options(url: str, table: str, user: str, password: str, **more: str) -> dict[str, str]:
    """Options shared by the JDBC reader and writer."""
    if not url.startswith("jdbc:"):
        raise ValueError("a JDBC url starts with jdbc:")
    return {
        "url": url,
        "dbtable": table,
        "user": user,
        "password": password,
        "driver": "org.postgresql.Driver",
        **more,
    }


def read_jdbc(
    spark: SparkSession,
    options: dict[str, str],
    partition_column: str | None = None,
    lower: str | None = None,
    upper: str | None = None,
    partitions: int = 1,
) -> DataFrame:
    """A JDBC table; with a partition column it is read in parallel ranges."""
    if partition_column:
        options = {
            **options,
            "partitionColumn": partition_column,
            "lowerBound": str(lower),
            "upperBound": str(upper),
            "numPartitions": str(partitions),
        }
    return spark.read.format("jdbc").options(**options).load()
