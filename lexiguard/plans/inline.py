"""Small tables that are written down once and given to Spark and to SQL alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def sql_value(x: object) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return str(x).upper()
    if isinstance(x, (list, tuple)):
        return "[" + ", ".join(map(sql_value, x)) + "]"
    if isinstance(x, float):
        return f"CAST({x!r} AS DOUBLE)"
    if isinstance(x, int):
        return str(x)
    return "'" + str(x).replace("'", "''") + "'"


class Inline:
    def __init__(self, name: str, schema: str, rows: list[tuple]) -> None:
        self.name, self.schema, self.rows = name, schema, rows
        self.columns = [c.strip().split(" ")[0] for c in schema.split(",")]

    def df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, self.schema)

    @property
    def sql(self) -> str:
        """name(columns) AS (VALUES …), for a WITH clause."""
        return f"{self.name}({', '.join(self.columns)}) AS (VALUES {', '.join('(' + ', '.join(map(sql_value, r)) + ')' for r in self.rows)})"
