"""Views derived from the test tables that stand for what the models would put out.

Each view is a table and a list of expressions that mean the same in Spark and in the SQL of the
checks, so queries and their SQL start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagemill.session import table

# name: (table, expressions, condition)
VIEWS: dict[str, tuple[str, list[str], str]] = {
    "boxes": (
        "events",
        [
            "user_id AS img",
            "event_id AS box_id",
            "CAST((event_id * 37) % 700 AS INT) AS x",
            "CAST((event_id * 53) % 900 AS INT) AS y",
            "CAST(20 + (event_id * 13) % 120 AS INT) AS w",
            "CAST(10 + (event_id * 29) % 60 AS INT) AS h",
            "CAST((event_id * 7919) % 1000 AS DOUBLE) / 1000 AS conf",
        ],
        "event_id IS NOT NULL AND user_id IS NOT NULL",
    ),
    "anchors": (
        "events",
        [
            "user_id AS img",
            "event_id AS anchor",
            "CAST((event_id * 31) % 768 AS DOUBLE) AS cx",
            "CAST((event_id * 47) % 768 AS DOUBLE) AS cy",
            "CAST(4 + (event_id * 11) % 200 AS DOUBLE) AS bw",
            "CAST(4 + (event_id * 17) % 90 AS DOUBLE) AS bh",
            "CAST((event_id * 7919) % 1000 AS DOUBLE) / 1000 AS s0",
            "CAST((event_id * 6007) % 1000 AS DOUBLE) / 1000 AS s1",
            "CAST(0.5 AS DOUBLE) AS scale",
            "0 AS pad_x",
            "84 AS pad_y",
            "1536 AS orig_w",
            "1200 AS orig_h",
        ],
        "event_id IS NOT NULL AND user_id IS NOT NULL",
    ),
    "sizes": (
        "events",
        ["event_id AS img", "CAST(1 + (event_id * 97) % 4000 AS INT) AS w", "CAST(1 + (event_id * 71) % 3000 AS INT) AS h", "CAST(event_id % 360 AS DOUBLE) AS deg", "CAST(event_id % 9 AS INT) AS code", "CAST((event_id * 977) % 1500000 AS INT) AS size"],
        "event_id IS NOT NULL",
    ),
    "steps": (
        "embeddings",
        ["label AS box", "vec_id AS t", "embedding AS logits"],
        "vec_id IS NOT NULL AND embedding IS NOT NULL",
    ),
}


def view(spark: SparkSession, d: str, name: str) -> DataFrame:
    source, exprs, where = VIEWS[name]
    return table(spark, d, source).where(where).selectExpr(*exprs)


def sql(name: str) -> str:
    """The view as a subquery."""
    source, exprs, where = VIEWS[name]
    return f"(SELECT {', '.join(exprs)} FROM {source} WHERE {where})"


def ctes(*names: str) -> str:
    return "WITH " + ", ".join(f"{n} AS {sql(n)}" for n in names)
