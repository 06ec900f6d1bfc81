"""Record store queries, summaries, sources and states."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.operators import history as H
from pagemill.sources import inputs as I
from pagemill.streaming import buffers as S
from pagemill.session import shared_dir, table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
_ALL = "id, latex, confidence, type, source, favorite, created_at"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _history(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "history")


@query("SELECT id, created_at FROM history ORDER BY created_at DESC, id DESC")
def rec_scan(spark: SparkSession, d: str) -> DataFrame:
    return H.scan(_history(spark, d)).select("id", "created_at")


@query("SELECT id, created_at FROM history WHERE favorite ORDER BY created_at DESC, id DESC")
def rec_favorites(spark: SparkSession, d: str) -> DataFrame:
    return H.scan(_history(spark, d), True).select("id", "created_at")


@query(f"SELECT {_ALL} FROM history WHERE id = 20")
def rec_lookup(spark: SparkSession, d: str) -> DataFrame:
    return H.lookup(_history(spark, d), 20).select(*_ALL.split(", "))


@query("SELECT id, latex, confidence, type, source, favorite, created_at FROM history UNION ALL SELECT 1000000000 + img, text, confidence::DOUBLE, 'formula', 'file', false, TIMESTAMP '2024-06-01 00:00:00' FROM text_result WHERE coalesce(text, '') <> ''")
def rec_insert(spark: SparkSession, d: str) -> DataFrame:
    """The text results saved as records."""
    new = table(spark, d, "text_result").select((F.lit(1_000_000_000) + F.col("img")).alias("id"), F.col("text").alias("latex"), F.col("confidence").cast("double").alias("confidence"), F.expr("timestamp_ntz '2024-06-01 00:00:00'").alias("created_at"))
    return H.insert(_history(spark, d).select(*_ALL.split(", ")), new)


@query("SELECT id, CASE WHEN id = 20 THEN NOT coalesce(favorite, false) ELSE favorite END AS favorite FROM history")
def rec_toggle(spark: SparkSession, d: str) -> DataFrame:
    return H.toggle(_history(spark, d), 20).select("id", "favorite")


@query("SELECT id FROM history WHERE id <> 20")
def rec_delete(spark: SparkSession, d: str) -> DataFrame:
    return H.delete(_history(spark, d), 20).select("id")


@query("SELECT id FROM history WHERE coalesce(favorite, false)")
def rec_clear(spark: SparkSession, d: str) -> DataFrame:
    return H.clear(_history(spark, d)).select("id")


@query("SELECT count(*) AS n FROM history")
def rec_count(spark: SparkSession, d: str) -> DataFrame:
    return H.count(_history(spark, d))


#: What happens to the store: two clears with toggles around them, deletions, and two rounds of inserts.
_OPS = """SELECT 1000000 + id AS seq, 'toggle' AS op, id FROM history WHERE id % 3 = 0
UNION ALL SELECT 2000000, 'clear', NULL
UNION ALL SELECT 3000000 + id, 'insert', 10000000 + id FROM history WHERE id % 4 = 1
UNION ALL SELECT 4000000 + id, 'toggle', 10000000 + id FROM history WHERE id % 8 = 1
UNION ALL SELECT 4000000 + id, 'toggle', id FROM history WHERE id % 9 = 0
UNION ALL SELECT 5000000, 'clear', NULL
UNION ALL SELECT 6000000 + id, 'insert', 20000000 + id FROM history WHERE id % 5 = 1
UNION ALL SELECT 7000000 + id, 'toggle', id FROM history WHERE id % 5 = 0
UNION ALL SELECT 8000000 + id, 'delete', id FROM history WHERE id % 7 = 0"""
# Each record is set against both clears by itself: what its toggles before a clear make of it decides.
_CURRENT = f"""WITH ops AS ({_OPS}),
born AS (SELECT id, coalesce(favorite, false) AS fav, 0 AS since FROM history
UNION ALL SELECT o.id, false, o.seq FROM ops o JOIN history h ON h.id = o.id % 10000000 WHERE o.op = 'insert' AND coalesce(h.latex, '') <> ''),
counted AS (SELECT b.id, b.fav, b.since, count(o.seq) FILTER (o.op = 'toggle' AND o.seq < 2000000) AS t1, count(o.seq) FILTER (o.op = 'toggle' AND o.seq < 5000000) AS t2,
count(o.seq) FILTER (o.op = 'toggle') AS t, count(o.seq) FILTER (o.op = 'delete') AS d FROM born b LEFT JOIN ops o ON o.id = b.id AND o.seq > b.since AND o.op <> 'insert' GROUP BY ALL)
SELECT id, fav <> (t % 2 = 1) AS favorite FROM counted WHERE d = 0 AND (since > 2000000 OR fav <> (t1 % 2 = 1)) AND (since > 5000000 OR fav <> (t2 % 2 = 1))"""


@query(_CURRENT)
def rec_current(spark: SparkSession, d: str) -> DataFrame:
    """The store after toggles, two clears, inserts and deletions."""
    h = _history(spark, d)
    ops = spark.sql(_OPS.replace("FROM history", "FROM {history}"), history=h)
    ops = ops.join(h.select(F.col("id").alias("from_id"), "latex", "created_at"), (F.col("op") == "insert") & (F.col("id") % 10_000_000 == F.col("from_id")), "left").drop("from_id")
    return H.current(h, ops).select("id", "favorite")


@query("SELECT id, CASE WHEN length(coalesce(latex, '')) > 120 THEN latex[1:120] || '…' ELSE coalesce(latex, '') END AS preview, CAST(floor(coalesce(confidence, 0) * 100 + 0.5) AS INT) AS percent FROM history")
def rec_cards(spark: SparkSession, d: str) -> DataFrame:
    return _history(spark, d).select("id", F.inline(F.array(H.card(F.col("latex"), F.col("confidence")))))


_NAME = "CASE WHEN source = 'camera' THEN 'camera.jpg' WHEN source = 'handwrite' THEN 'handwrite.png' WHEN source = 'pdf' THEN 'a.pdf' ELSE 'b.webp' END"


@query("SELECT id, CASE WHEN source IN ('camera', 'handwrite', 'pdf') THEN source ELSE 'file' END AS source, CASE WHEN source = 'pdf' THEN 'application/pdf' WHEN source = 'camera' THEN 'image/jpeg' WHEN source = 'handwrite' THEN 'image/png' ELSE 'image/webp' END AS mime FROM history")
def rec_sources(spark: SparkSession, d: str) -> DataFrame:
    named = _history(spark, d).select("id", F.expr(_NAME).alias("name")).withColumn("mime", I.mime(F.col("name")))
    return named.select("id", H.source_of(F.col("mime"), F.col("name")).alias("source"), "mime")


@query("SELECT session_id, CASE WHEN session_id % 2 = 1 THEN 'external' ELSE 'native' END AS route, coalesce(nullif(app_version, '')[1:8] || '...', '') AS secret FROM log_sessions")
def rec_routes(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "log_sessions")
    return s.select("session_id", H.routed(F.when(F.col("session_id") % 2 == 1, "hybrid").otherwise("builtin"), F.lit("http://host")).alias("route"), H.redact(F.col("app_version")).alias("secret"))


@query("SELECT m.img, coalesce(nullif(t.text, ''), nullif(m.formatted_text, ''), '') AS text FROM mixed_result m LEFT JOIN text_result t ON t.img = m.img - 1")
def rec_result_text(spark: SparkSession, d: str) -> DataFrame:
    m, t = table(spark, d, "mixed_result"), table(spark, d, "text_result").select((F.col("img") + 1).alias("img"), "text")
    return m.join(t, "img", "left").select("img", H.result_text(F.lit(""), F.col("text"), F.col("formatted_text")).alias("text"))


_REG = "(SELECT DISTINCT * FROM regions WHERE region_id IS NOT NULL)"


def _regions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "regions").where("region_id is not null").distinct()


@query(f"SELECT img, string_agg(coalesce(text, ''), chr(10) ORDER BY y, x, region_id) AS text, round(avg(confidence::DOUBLE), 6) AS confidence FROM {_REG} GROUP BY img")
def rec_region_summary(spark: SparkSession, d: str) -> DataFrame:
    return H.region_summary(_regions(spark, d))


@query(f"SELECT img, CASE WHEN count(*) FILTER (type = 'formula') > 0 THEN string_agg(coalesce(text, ''), ' \\\\ ' ORDER BY y, x, region_id) FILTER (type = 'formula') ELSE string_agg(coalesce(text, ''), chr(10) ORDER BY y, x, region_id) END AS latex FROM {_REG} GROUP BY img")
def rec_page_text(spark: SparkSession, d: str) -> DataFrame:
    return H.page_text(_regions(spark, d))


@query("SELECT doc, string_agg(coalesce(latex, ''), chr(10) || chr(10) ORDER BY page, coalesce(latex, '')) AS latex, round(avg(coalesce(nullif(confidence, 0), 0.5)), 6) AS confidence, count(*) AS pages FROM (SELECT DISTINCT * FROM pages_result) GROUP BY doc")
def rec_documents(spark: SparkSession, d: str) -> DataFrame:
    return H.document_summary(table(spark, d, "pages_result"))


_OK = "coalesce(confidence, 0) >= 0.45::DOUBLE AND trim(coalesce(text, '')) <> ''"


@query(f"SELECT img, round(coalesce(sum(CASE WHEN {_OK} THEN confidence::DOUBLE END), 0) / count(*), 6) AS confidence, count(*) FILTER ({_OK}) AS accepted FROM {_REG} GROUP BY img")
def rec_text_confidence(spark: SparkSession, d: str) -> DataFrame:
    return H.accepted_confidence(_regions(spark, d))


@query(f"SELECT img, region_id, confidence FROM (SELECT *, row_number() OVER (PARTITION BY img ORDER BY confidence DESC NULLS LAST, y, x, region_id) AS n FROM {_REG} WHERE type = 'formula') WHERE n = 1")
def rec_best_formula(spark: SparkSession, d: str) -> DataFrame:
    return H.best_formula(_regions(spark, d))


@query("SELECT session_id, line_no, line FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY line_no DESC, line DESC) AS r FROM (SELECT DISTINCT session_id, line_no, line FROM log_lines)) WHERE r <= 100")
def rec_log_tail(spark: SparkSession, d: str) -> DataFrame:
    return H.tail(table(spark, d, "log_lines").select("session_id", "line_no", "line").distinct(), 100, "session_id")


# Weights of the loading steps.
WEIGHTS = [("分词器", 2), ("编码器模型", 50), ("文字检测", 6), ("公式检测", 8), ("区域检测", 6), ("中文OCR", 10), ("方向检测", 4), ("原生引擎", 1), ("加载模型", 50), ("就绪", 0)]


@query("SELECT CAST(floor((50 * 80 + 6 * 100 + 10 * 0) / 100.0 / 137 * 100 + 0.5) AS INT) AS percent")
def rec_progress(spark: SparkSession, d: str) -> DataFrame:
    done = spark.createDataFrame([("编码器模型", 80), ("文字检测", 100), ("中文OCR", -1)], "step string, percent int")
    return H.progress(done, spark.createDataFrame(WEIGHTS, "step string, weight int"))


_WORDS = [("en", "history", "History"), ("en", "copy", "Copy"), ("zh-CN", "history", "历史"), ("zh-CN", "export", "导出")]


@query("SELECT * FROM (VALUES ('history', 'History'), ('copy', 'Copy'), ('export', '导出'), ('none', 'none')) AS v(key, val)")
def rec_translate(spark: SparkSession, d: str) -> DataFrame:
    keys = spark.createDataFrame([("history",), ("copy",), ("export",), ("none",)], "key string")
    return H.translate_keys(keys, spark.createDataFrame(_WORDS, "lang string, key string, val string"), "en")


@query("SELECT * FROM (VALUES ('history', 'History'), ('copy', 'Copy'), ('export', '导出')) AS v(key, val)")
def rec_overlay(spark: SparkSession, d: str) -> DataFrame:
    words = spark.createDataFrame(_WORDS, "lang string, key string, val string")
    return H.overlay(words.where("lang = 'zh-CN'").select("key", "val"), words.where("lang = 'en'").select("key", "val"))


@query("SELECT DISTINCT app_version AS name FROM log_sessions WHERE app_version <> (SELECT min(app_version) FROM log_sessions)")
def rec_stale(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "log_sessions").select(F.col("app_version").alias("name")).distinct()
    return H.stale(names, names.agg(F.min("name")).first()[0])


@query("SELECT doc, CAST(unnest(range(1, n + 1)) AS INT) AS page, 2 AS scale, 'mixed' AS mode FROM (SELECT doc, max(page) AS n FROM mixed_result WHERE doc IS NOT NULL GROUP BY doc)")
def src_pages(spark: SparkSession, d: str) -> DataFrame:
    return I.pages(table(spark, d, "mixed_result").where("doc is not null").groupBy("doc").agg(F.max("page").alias("n")))


@query("SELECT doc_id, text FROM documents WHERE text IS NOT NULL")
def src_data_uri(spark: SparkSession, d: str) -> DataFrame:
    """Texts as data URIs and back."""
    docs = table(spark, d, "documents").where("text is not null")
    uri = F.concat(F.lit("data:text/plain;base64,"), F.regexp_replace(F.base64(F.encode("text", "utf-8")), "[\r\n]", ""))
    return docs.select("doc_id", F.decode(I.data_uri(uri), "utf-8").alias("text"))


@query("SELECT session_id, coalesce(nullif(platform, ''), 'none') AS engine FROM log_sessions")
def src_settings(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "log_sessions").withColumn("native", F.when(F.col("platform").isNotNull(), F.to_json(F.struct(F.col("platform").alias("engine")))))
    return s.select("session_id", F.coalesce(I.settings(F.col("native"), F.lit('{"engine":"none"}'))["engine"], F.lit("none")).alias("engine"))


@query("SELECT session_id, regexp_replace(app_version, '^v', '') AS version FROM log_sessions WHERE app_version IS NOT NULL")
def src_releases(spark: SparkSession, d: str) -> DataFrame:
    feed = F.to_json(F.struct(F.col("app_version").alias("tag_name"), F.lit("http://host").alias("html_url"), F.lit("").alias("body")))
    return table(spark, d, "log_sessions").where("app_version is not null").select("session_id", I.release(feed)["version"].alias("version"))


@query("SELECT CAST(row_number() OVER (ORDER BY ch) AS INT) AS id, ch FROM (SELECT DISTINCT source AS ch FROM history WHERE source IS NOT NULL)")
def src_keys(spark: SparkSession, d: str) -> DataFrame:
    """The sources as a numbered list of symbols."""
    from pyspark.sql import Window

    names = _history(spark, d).where("source is not null").select(F.col("source").alias("value")).distinct()
    return I.keys(names.withColumn("n", F.row_number().over(Window.orderBy("value")) - 1))


@query("SELECT * FROM (VALUES (0, 'a'), (1, 'b'), (2, 'c')) AS v(id, token)")
def src_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    return I.vocabulary(spark.createDataFrame([('{"model":{"vocab":{"b":1,"a":0,"c":2}}}',)], "value string"))


@query("SELECT img, CASE WHEN img % 9 BETWEEN 1 AND 8 THEN img % 9 ELSE 1 END::INT AS orientation FROM text_result")
def src_exif(spark: SparkSession, d: str) -> DataFrame:
    """Orientation of small JPEG heads made from the ids of pictures."""
    head = "ffd8ffe1001e457869660000" + "4d4d002a00000008" + "0001" + "0112000300000001"
    raw = F.unhex(F.concat(F.lit(head), F.lpad(F.hex(F.col("img") % 9), 4, "0"), F.lit("000000000000ffd9")))
    return table(spark, d, "text_result").select("img", I.exif_orientation(raw).alias("orientation"))


_NAMED = "CASE id % 4 WHEN 0 THEN 'a.txt' WHEN 1 THEN 'b.PNG' WHEN 2 THEN 'c.jpg' ELSE 'd.pdf' END"


@query(f"SELECT day, id, name FROM (SELECT *, row_number() OVER (PARTITION BY day ORDER BY id) AS n FROM (SELECT CAST(created_at AS DATE) AS day, id, {_NAMED} AS name FROM history) WHERE name IN ('b.PNG', 'c.jpg')) WHERE n = 1")
def src_first_image(spark: SparkSession, d: str) -> DataFrame:
    """Records of a day as the items of one paste: the first picture among them."""
    items = _history(spark, d).select(F.to_date("created_at").alias("day"), "id", F.expr(_NAMED).alias("name"))
    return I.first_image(items.withColumn("mime", I.mime(F.col("name"))), "day", "id").select("day", "id", "name")


@query(f"SELECT id, {_NAMED} AS name, CASE id % 4 WHEN 1 THEN 'image/png' WHEN 2 THEN 'image/jpeg' ELSE 'application/pdf' END AS mime FROM history WHERE id % 4 <> 0")
def src_accepted(spark: SparkSession, d: str) -> DataFrame:
    items = _history(spark, d).select("id", F.expr(_NAMED).alias("name"))
    return I.accepted(items.withColumn("mime", I.mime(F.col("name"))))


@query("SELECT id, CASE source WHEN 'pdf' THEN 'http://a/v1' WHEN 'camera' THEN 'http://b' ELSE 'http://own' END AS base_url, CASE source WHEN 'pdf' THEN 'm1' WHEN 'camera' THEN 'm2' ELSE 'own' END AS model FROM history")
def src_preset(spark: SparkSession, d: str) -> DataFrame:
    presets = {"pdf": ("http://a/v1", "m1"), "camera": ("http://b", "m2")}
    return _history(spark, d).select("id", F.inline(F.array(I.preset(F.col("source"), presets, F.lit("http://own"), F.lit("own")))))


@query("SELECT coalesce(source, 'none') AS key, count(*)::VARCHAR AS val FROM history GROUP BY ALL")
def snk_settings(spark: SparkSession, d: str) -> DataFrame:
    """Counts of sources saved as settings, twice, and loaded again."""
    values = _history(spark, d).groupBy(F.coalesce("source", F.lit("none")).alias("key")).agg(F.count("*").cast("string").alias("val"))
    path = f"{shared_dir(spark)}/settings-{uuid.uuid4().hex}"
    I.save_settings(values.withColumn("val", F.lit("old")), path)
    I.save_settings(values, path)
    return I.load_settings(spark, path)


@query("SELECT line, count(*) AS n FROM (SELECT unnest(string_split(text || chr(10), chr(10))) AS line FROM text_result WHERE text IS NOT NULL) GROUP BY line")
def snk_texts(spark: SparkSession, d: str) -> DataFrame:
    """Lines of all texts, saved as files and read again."""
    path = f"{shared_dir(spark)}/texts-{uuid.uuid4().hex}"
    I.save_texts(table(spark, d, "text_result"), path)
    return spark.read.option("lineSep", "\n").text(path).groupBy(F.col("value").alias("line")).agg(F.count("*").alias("n"))


_UNDONE = """WITH o AS (SELECT user_id AS canvas, list(CASE WHEN event_id % 4 = 0 THEN 2 WHEN event_id % 7 = 0 THEN 3 ELSE 1 END ORDER BY event_id) AS ops FROM events WHERE user_id IS NOT NULL GROUP BY user_id),
s AS (SELECT canvas, list_reduce(list_transform(ops, lambda o: {'o': o, 'u': 0, 'r': 0}), lambda s, x: CASE WHEN x.o = 1 THEN {'o': 0, 'u': least(s.u + 1, 60), 'r': 0} WHEN x.o = 2 AND s.u > 0 THEN {'o': 0, 'u': s.u - 1, 'r': s.r + 1}
WHEN x.o = 3 AND s.r > 0 THEN {'o': 0, 'u': least(s.u + 1, 60), 'r': s.r - 1} ELSE s END, {'o': 0, 'u': 0, 'r': 0}) AS s FROM o) SELECT canvas, CAST(s.u AS INT) AS undo, CAST(s.r AS INT) AS redo FROM s"""


@query(_UNDONE)
def sta_undo(spark: SparkSession, d: str) -> DataFrame:
    """Sizes of the undo and redo stacks after a log made from events."""
    ops = table(spark, d, "events").where("user_id is not null").select(F.col("user_id").alias("canvas"), F.col("event_id").alias("seq"), F.when(F.col("event_id") % 4 == 0, "undo").when(F.col("event_id") % 7 == 0, "redo").otherwise("draw").alias("op"))
    return S.undo_state(ops)


@query("SELECT session_id, CAST(least(count(*), 2000) AS INT) AS kept, count(*) AS seen FROM log_lines GROUP BY session_id")
def sta_log_ring(spark: SparkSession, d: str) -> DataFrame:
    """The log as a stream through the ring buffers of its sessions, run until it has no more to read.

    The last state of a session is the one that has seen most; updates go to the shared folder.
    """
    schema = table(spark, d, "log_lines").schema
    # The engine's own state store must lie where all executors reach it.
    base = f"{shared_dir(spark)}/ring-{uuid.uuid4().hex}"
    path = f"{d}/log_lines.parquet"
    # A stream reads folders: a table that is a single file is picked from its folder by name.
    reader = spark.readStream.schema(schema)
    lines = reader.option("pathGlobFilter", "log_lines.parquet").parquet(d) if os.path.isfile(path) else reader.parquet(path)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={number}")

    S.log_ring(lines).writeStream.outputMode("update").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    out = spark.read.schema("session_id bigint, kept int, seen bigint, first string, last string").parquet(f"{base}/out")
    return out.groupBy("session_id").agg(F.max(F.struct("seen", "kept")).alias("m")).select("session_id", "m.kept", "m.seen")
