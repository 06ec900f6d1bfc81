"""The record store: an append-only log of operations folded to the current records, and its reports.

Records are (id, latex, confidence, type, source, favorite, created_at). Changes are rows (seq, op, id,
...) with op insert, toggle, delete or clear; `current` folds them with one window per id, so no
record is ever rewritten in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Defaults of a new record, sizes of views and logs.
DEFAULTS = {"type": "formula", "source": "file", "favorite": False}
CARD_CHARS, LOG_LINES, TAIL_LINES = 120, 2000, 100
PAGE_CONFIDENCE = 0.5


def scan(records: DataFrame, favorites_only: bool = False) -> DataFrame:
    """Newest first; equal times by id downwards. With favorites_only a null favourite does not count."""
    rows = records.where("favorite") if favorites_only else records
    return rows.orderBy(F.col("created_at").desc(), F.col("id").desc())


def lookup(records: DataFrame, key: int) -> DataFrame:
    return records.where(F.col("id") == key)


def new_records(results: DataFrame) -> DataFrame:
    """Rows to insert: results with a latex that is neither null nor empty, defaults filled in."""
    rows = results.where(F.coalesce(F.col("latex"), F.lit("")) != "")
    for name, value in DEFAULTS.items():
        rows = rows.withColumn(name, F.coalesce(F.col(name), F.lit(value)) if name in results.columns else F.lit(value))
    return rows.withColumn("type", F.lit(DEFAULTS["type"]))


def insert(records: DataFrame, results: DataFrame) -> DataFrame:
    return records.unionByName(new_records(results).select(*records.columns))


def toggle(records: DataFrame, key: int) -> DataFrame:
    """records with the favourite of one record turned over; a null favourite counts as false, a missing id changes nothing."""
    return records.withColumn("favorite", F.when(F.col("id") == key, ~F.coalesce("favorite", F.lit(False))).otherwise(F.col("favorite")))


def delete(records: DataFrame, key: int) -> DataFrame:
    return records.where((F.col("id") != key) | F.col("id").isNull())


def clear(records: DataFrame, keep_favorites: bool = True) -> DataFrame:
    return records.where(F.coalesce("favorite", F.lit(False)) if keep_favorites else F.lit(False))


#: Sequence numbers counted in one block when clears are numbered.
ERA_BLOCK = 65_536


def with_era(ops: DataFrame) -> DataFrame:
    """ops with era, the number of clears before: counted within blocks of seq, whose totals are added up."""
    is_clear = F.when(F.col("op") == "clear", 1).otherwise(0)
    rows = ops.withColumn("block", F.floor(F.col("seq") / ERA_BLOCK))
    inside = Window.partitionBy("block").orderBy("seq").rangeBetween(Window.unboundedPreceding, -1)
    # One row per block reaches the window without partition.
    totals = rows.groupBy("block").agg(F.sum(is_clear).alias("n")).select(F.col("block"), F.coalesce(F.sum("n").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return rows.withColumn("here", F.coalesce(F.sum(is_clear).over(inside), F.lit(0))).join(totals, "block").withColumn("era", F.col("here") + F.col("before")).drop("block", "here", "before")


def current(records: DataFrame, ops: DataFrame) -> DataFrame:
    """records after a log of operations (seq, op, id and, for inserts, columns of records).

    seq is unique. A toggle turns the favourite of a record that exists by then; a null favourite counts as false. A delete
    removes the record for good. A clear (id null) removes whatever is no favourite at its time, so a record stays if it is a
    favourite at the end of each era (stretch between clears) it meets. An insert is a new record from its seq on, with the
    defaults; without a latex (or without that column in ops) it is none. Rows with an unknown op or a null id change nothing.
    """
    eras = with_era(ops)
    born = records.withColumns({"_from": F.lit(None).cast("bigint"), "_era": F.lit(0).cast("bigint")})
    if "latex" in ops.columns:
        fresh = new_records(eras.where("op = 'insert' and id is not null"))
        known = [F.col(f.name).cast(f.dataType).alias(f.name) if f.name in fresh.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in records.schema]
        born = born.unionByName(fresh.select(*known, F.col("seq").cast("bigint").alias("_from"), F.col("era").cast("bigint").alias("_era")))
    born = born.withColumn("_fav", F.coalesce("favorite", F.lit(False)))
    clears = ops.agg(F.count_if(F.col("op") == "clear").alias("_clears")).withColumn("_one", F.lit(1))
    toggle = F.col("op") == "toggle"
    own = eras.where("op in ('toggle', 'delete')").select("id", "op", "era", "seq").join(born.select("id", "_from", "_fav"), "id").where("_from is null or seq > _from")
    per = own.groupBy("id", "_fav", "era").agg(F.count_if(toggle).alias("t"), F.count_if(~toggle).alias("d"))
    odd = F.sum("t").over(Window.partitionBy("id").orderBy("era")) % 2 == 1
    per = per.withColumn("state", F.col("_fav") != odd).withColumn("_one", F.lit(1)).join(F.broadcast(clears), "_one")
    folded = per.groupBy("id").agg(F.sum("d").alias("_d"), F.sum("t").alias("_t"), F.min("era").alias("_first"), F.every(F.col("state") | (F.col("era") >= F.col("_clears"))).alias("_kept"))
    state = born.withColumn("_one", F.lit(1)).join(F.broadcast(clears), "_one").join(folded, "id", "left")
    # Clears before the first change meet the record as it began.
    quiet = F.least(F.coalesce("_first", F.col("_clears")), F.col("_clears")) > F.col("_era")
    alive = (F.coalesce("_d", F.lit(0)) == 0) & F.coalesce("_kept", F.lit(True)) & (F.col("_fav") | ~quiet)
    return state.where(alive).withColumn("favorite", F.col("_fav") != (F.coalesce("_t", F.lit(0)) % 2 == 1)).select(*records.columns)


def count(records: DataFrame) -> DataFrame:
    return records.agg(F.count("*").alias("n"))


def card(latex: Column, confidence: Column) -> Column:
    """struct(preview, percent): the first CARD_CHARS characters with an ellipsis for more, confidence in whole percent."""
    text = F.coalesce(latex, F.lit(""))
    preview = F.when(F.length(text) > CARD_CHARS, F.concat(F.substring(text, 1, CARD_CHARS), F.lit("…"))).otherwise(text)
    return F.struct(preview.alias("preview"), F.floor(F.coalesce(confidence, F.lit(0.0)) * 100 + 0.5).cast("int").alias("percent"))


def source_of(mime: Column, name: Column) -> Column:
    """Where a file came from, by type and name."""
    return F.when(mime == "application/pdf", "pdf").when(name == "camera.jpg", "camera").when(name == "handwrite.png", "handwrite").otherwise("file")


def redact(secret: Column) -> Column:
    """The first eight characters and dots; an empty or null secret stays empty."""
    return F.when(F.coalesce(secret, F.lit("")) == "", F.lit("")).otherwise(F.concat(F.substring(secret, 1, 8), F.lit("...")))


def routed(engine: Column, base_url: Column) -> Column:
    """Which recogniser is used: any engine but the built-in one goes out, if an address is set."""
    return F.when((engine != "builtin") & (F.coalesce(base_url, F.lit("")) != ""), "external").otherwise("native")


def tall_formula(w: Column, h: Column) -> Column:
    """Whether a formula crop goes to the line splitter."""
    return (h > w * 0.8) | (h > 100)


def result_text(latex: Column, text: Column, formatted: Column) -> Column:
    """The first of the three that is not empty; else the empty text."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in (latex, text, formatted)), F.lit(""))


def region_summary(regions: DataFrame) -> DataFrame:
    """(img, text, confidence): region texts in reading order, one per line, and their mean confidence."""
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y", "x", "region_id", F.coalesce("text", F.lit("")).alias("t")))), lambda s: s["t"]), "\n")
    return regions.groupBy("img").agg(lines.alias("text"), F.round(F.avg(F.col("confidence").cast("double")), 6).alias("confidence"))


def page_text(regions: DataFrame) -> DataFrame:
    """(img, latex): the formulas of a page joined by row breaks; all its texts, one per line, if it has none."""
    item = F.struct("y", "x", "region_id", F.coalesce("text", F.lit("")).alias("t"))
    texts = lambda c: F.transform(F.array_sort(c), lambda s: s["t"])
    g = regions.groupBy("img").agg(F.collect_list(F.when(F.col("type") == "formula", item)).alias("f"), F.collect_list(item).alias("a"))
    return g.select("img", F.when(F.size("f") > 0, F.array_join(texts(F.col("f")), " \\\\ ")).otherwise(F.array_join(texts(F.col("a")), "\n")).alias("latex"))


def document_summary(pages: DataFrame) -> DataFrame:
    """(doc, latex, confidence, pages): pages in order with a blank line between, mean confidence (null or 0 counts as PAGE_CONFIDENCE)."""
    conf = F.coalesce(F.nullif("confidence", F.lit(0.0)), F.lit(PAGE_CONFIDENCE))
    g = pages.distinct().groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("page", F.coalesce("latex", F.lit("")).alias("t")))).alias("p"), F.round(F.avg(conf), 6).alias("confidence"), F.count("*").alias("pages"))
    return g.select("doc", F.array_join(F.transform("p", lambda s: s["t"]), "\n\n").alias("latex"), "confidence", "pages")


def accepted_confidence(boxes: DataFrame, least: float = 0.45) -> DataFrame:
    """(img, confidence, accepted): confidences of accepted lines over the number of all lines, rejected ones included."""
    ok = (F.coalesce("confidence", F.lit(0.0)) >= least) & (F.coalesce(F.trim("text"), F.lit("")) != "")
    return boxes.groupBy("img").agg(F.round(F.coalesce(F.sum(F.when(ok, F.col("confidence").cast("double"))), F.lit(0.0)) / F.count("*"), 6).alias("confidence"), F.count_if(ok).alias("accepted"))


def best_formula(regions: DataFrame) -> DataFrame:
    """(img, region_id, confidence): the formula of the greatest confidence, the first in reading order of several."""
    w = Window.partitionBy("img").orderBy(F.col("confidence").desc_nulls_last(), "y", "x", "region_id")
    return regions.where("type = 'formula'").withColumn("n", F.row_number().over(w)).where("n = 1").select("img", "region_id", "confidence")


def tail(lines: DataFrame, n: int = TAIL_LINES, *keys: str, order: str = "line_no") -> DataFrame:
    """The last n lines per key. Blocks of lines are cut first, so no key is sorted as a whole."""
    block = Window.partitionBy(*keys, F.floor(F.col(order) / 65_536)).orderBy(F.col(order).desc())
    some = lines.withColumn("r", F.row_number().over(block)).where(F.col("r") <= n).drop("r")
    return some.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(order).desc()))).where(F.col("r") <= n).drop("r")


def progress(done: DataFrame, weights: DataFrame) -> DataFrame:
    """(percent) of weighted steps: done (step, percent) may miss steps and hold negative values, which count as 0."""
    part = weights.join(done, "step", "left")
    return part.agg(F.floor(F.sum(F.col("weight") * F.greatest(F.coalesce(F.col("percent"), F.lit(0)), F.lit(0)) / 100.0) / F.sum("weight") * 100 + 0.5).cast("int").alias("percent"))


def translate_keys(keys: DataFrame, words: DataFrame, lang: str, fallback: str = "zh-CN") -> DataFrame:
    """(key, val): the word of the language, else of the fallback language, else the key."""
    one = lambda code, name: words.where(F.col("lang") == code).groupBy("key").agg(F.min("val").alias(name))
    return keys.join(one(lang, "a"), "key", "left").join(one(fallback, "b"), "key", "left").select("key", F.coalesce("a", "b", "key").alias("val"))


def overlay(base: DataFrame, top: DataFrame) -> DataFrame:
    """(key, val): all keys of both, the values of top where it has the key."""
    return base.withColumnRenamed("val", "b").join(top.withColumnRenamed("val", "t").withColumn("has", F.lit(True)), "key", "full").select("key", F.when(F.col("has"), F.col("t")).otherwise(F.col("b")).alias("val"))


def stale(caches: DataFrame, keep: str) -> DataFrame:
    """Cache names other than the current one."""
    return caches.where(F.col("name") != keep)
