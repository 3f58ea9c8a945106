"""Access to the sample tables and the relations derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shelfsight.plans.derived_sql import BASE_TABLES, DERIVED, dependencies
from shelfsight.session import shared_folder, ship_package


class Tables:
    """``Tables(spark, folder)("products")`` gives one relation as a DataFrame."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")
        self.stored: dict[str, str] = {}
        ship_package(spark)

    def base(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def __call__(self, name: str) -> DataFrame:
        if name in BASE_TABLES:
            return self.base(name)
        return self.sql(f"select * from {name}")

    def storing(self, name: str) -> Tables:
        """These tables with a derived relation written once, so that those made from it read it."""
        path = shared_folder(self.spark, name)
        self(name).write.parquet(path)
        out = Tables(self.spark, self.folder)
        out.stored = {**self.stored, name: path}
        return out

    def sql(self, query: str) -> DataFrame:
        """Run a SELECT over sample tables and derived relations, wired as CTEs."""
        derived = dependencies(query)
        text = " ".join([query, *(DERIVED[d] for d in derived)])
        sources = [t for t in BASE_TABLES if _mentions(text, t)]
        ctes = [f"{t} as (select * from parquet.`{self.folder}/{t}.parquet`)" for t in sources]
        ctes += [f"{d} as (select * from parquet.`{self.stored[d]}`)" if d in self.stored else f"{d} as ({DERIVED[d]})" for d in derived]
        return self.spark.sql("with " + ",\n".join(ctes) + "\n" + query)


def _mentions(text: str, table: str) -> bool:
    import re

    return re.search(rf"\b(?:from|join)\s+{table}\b", text) is not None
