"""The role-typed bundle of tables, and the roles over the test tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Roles:
    """Real population, training table, reference (real, within population) and synthetic table, of one schema."""

    population: DataFrame
    training: DataFrame
    reference: DataFrame
    synthetic: DataFrame


COLUMNS = "l_orderkey, l_linenumber, l_returnflag, l_linestatus, l_quantity, l_discount + 0.0 AS l_discount, l_tax + 0.0 AS l_tax, l_shipdate"
CATEGORICAL = ("l_returnflag", "l_linestatus")
NUMERIC = ("l_quantity", "l_discount", "l_tax")
#: One SELECT for each role; both engines read it.
ROLE_SQL = {
    "population": f"SELECT {COLUMNS} FROM lineitem WHERE l_orderkey % 10 < 8",
    "training": f"SELECT {COLUMNS} FROM lineitem WHERE l_orderkey % 10 < 4 OR (l_orderkey % 10 = 9 AND l_linenumber = 1)",
    "reference": f"SELECT {COLUMNS} FROM lineitem WHERE l_orderkey % 10 IN (4, 5)",
    "synthetic": f"""SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 13 = 0 THEN 'X' ELSE l_returnflag END AS l_returnflag, l_linestatus,
 CASE WHEN l_orderkey % 11 = 0 THEN NULL WHEN l_orderkey % 17 = 0 THEN l_quantity + 60 ELSE l_quantity END AS l_quantity,
 l_discount + 0.0 AS l_discount, l_tax + 0.0 AS l_tax, l_shipdate FROM lineitem WHERE l_orderkey % 10 IN (3, 4, 5, 8, 9)""".replace("\n", " "),
}


def lineitem_roles(spark: SparkSession, sf_dir: str) -> Roles:
    lineitem = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return Roles(**{role: spark.sql(text.replace("FROM lineitem", "FROM {lineitem}"), lineitem=lineitem) for role, text in ROLE_SQL.items()})


def with_roles(body: str) -> str:
    """SQL with the roles as CTEs ahead of it."""
    ctes = ", ".join(f"{role} AS ({text})" for role, text in ROLE_SQL.items())
    body = body.strip()
    return f"WITH {ctes}, {body[5:]}" if body[:5].upper() == "WITH " else f"WITH {ctes} {body}"
