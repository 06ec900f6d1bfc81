"""Queries over the test tables for the operators of this package."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm import copies, cuts, garbled, leaks, lookalikes, mixing, scans
from pagemill.session import table


def _cuts(spark: SparkSession, d: str) -> DataFrame:
    return cuts.scored(cuts.history_and_pages(table(spark, d, "history"), table(spark, d, "pages_result")))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return cuts.cut_records(_cuts(spark, d))


def p2_shares(spark: SparkSession, d: str) -> DataFrame:
    return cuts.cut_shares(_cuts(spark, d))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return copies.formatting_copies(table(spark, d, "history"))[1]


def p3_copies(spark: SparkSession, d: str) -> DataFrame:
    return copies.formatting_copies(table(spark, d, "history"))[0]


def _odd(spark: SparkSession, d: str) -> DataFrame:
    return lookalikes.odd_records({"history": (table(spark, d, "history"), "id", "latex"), "regions": (table(spark, d, "regions"), "region_id", "text")})


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _odd(spark, d).select("tbl", "rec_id")


def p4_kinds(spark: SparkSession, d: str) -> DataFrame:
    return _odd(spark, d).select("tbl", F.explode("kinds").alias("kind")).groupBy("tbl", "kind").agg(F.count("*").alias("records"))


def p4_normal(spark: SparkSession, d: str) -> DataFrame:
    """The normal form of every value of both tables; repeated rows once."""
    history = table(spark, d, "history").select(F.lit("history").alias("tbl"), F.col("id").alias("rec_id"), F.col("latex").alias("text"))
    regions = table(spark, d, "regions").select(F.lit("regions").alias("tbl"), F.col("region_id").alias("rec_id"), "text")
    return lookalikes.normalised(history.unionByName(regions).distinct(), "text").select("tbl", "rec_id", "normal")


def _scan(spark: SparkSession, d: str) -> scans.ScanNoise:
    return scans.ScanNoise(table(spark, d, "regions"), table(spark, d, "mixed_result"), table(spark, d, "text_result"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _scan(spark, d).found()


def p5_repaired(spark: SparkSession, d: str) -> DataFrame:
    return _scan(spark, d).repaired()


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p6_clean(spark: SparkSession, d: str) -> DataFrame:
    return leaks.without_leaks(table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "eval_items"))


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return garbled.garbled(table(spark, d, "documents"), keep_text=False).select("doc_id").distinct()


def p8_restored(spark: SparkSession, d: str) -> DataFrame:
    return garbled.garbled(table(spark, d, "documents"))


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("p") and k[1].isdigit()}


# The same passages in SQL: windows of 13 folded words of both sides, joined.
_WINDOWS = """SELECT DISTINCT {id} AS id, array_to_string(w[k:k + 12], ' ') AS gram FROM (
SELECT {id}, w, unnest(range(1, len(w) - 11)) AS k FROM (SELECT {id}, regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[\\p{{L}}\\p{{N}}]+') AS w FROM {table} WHERE text IS NOT NULL))"""
_P6 = f"SELECT DISTINCT d.id AS doc_id, e.id AS item_id FROM ({_WINDOWS.format(id='doc_id', table='documents')}) d JOIN ({_WINDOWS.format(id='item_id', table='eval_items')}) e ON d.gram = e.gram"


# The canonical form of copies in SQL. Patterns here cannot look around, so what they look at is put back and they run twice;
# single marks between digits are kept by a sign put before them.
_SPACES = r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_MARK = "[.,;:?!，。；：？！、]"
_ITEM = "[^()=,;]+=[^()=,;]+"


def _times(call: str, inner: str) -> str:
    return call.replace("@", call.replace("@", inner))


_BARE = _times(r"regexp_replace(@, '(\\\\)|\\[,;:! ]|\\q?quad([^A-Za-z]|$)|\\[\[\]]|[~$" + _SPACES + r"]', '\1\2', 'g')", "latex")
_KEPT = _times(rf"regexp_replace(@, '([0-9])({_MARK})([0-9])', '\1' || chr(1) || '\2\3', 'g')", "sorted")
_P3 = rf"""WITH bare AS (SELECT DISTINCT id, lower({_BARE}) AS t FROM history WHERE id IS NOT NULL AND latex IS NOT NULL),
tail AS (SELECT id, t, regexp_extract(t, '\(({_ITEM}(?:[,;]{_ITEM})*)\){_MARK}*$', 1) AS items FROM bare),
listed AS (SELECT id, CASE WHEN items = '' THEN t ELSE regexp_replace(t, '\({_ITEM}(?:[,;]{_ITEM})*\){_MARK}*$', '') || '(' || array_to_string(list_sort(string_split_regex(items, '[,;]')), ',') || ')' END AS sorted FROM tail),
form AS (SELECT DISTINCT id, replace(regexp_replace({_KEPT}, '(' || chr(1) || '{_MARK})|{_MARK}', '\1', 'g'), chr(1), '') AS f FROM listed),
sets AS (SELECT f, min(id) AS keep_id, count(*) AS copies FROM form GROUP BY f)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p3_found": f"{_P3} SELECT keep_id, id AS dup_id FROM form JOIN sets USING (f) WHERE id <> keep_id",
        "p3_copies": f"{_P3} SELECT keep_id, copies FROM sets",
        "p6_found": _P6,
    }
