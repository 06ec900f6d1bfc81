"""String queries over saved formulas and texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions import text as T
from pagemill.session import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _history(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "history").select("id", "latex")


def _each(spark: SparkSession, d: str, **columns) -> DataFrame:
    return _history(spark, d).select("id", *(c.alias(n) for n, c in columns.items()))


_W = r"[\s\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}\x0B]"
_TRIM = lambda e: f"regexp_replace({e}, '^{_W}+|{_W}+$', '', 'g')"


_SAN = "latex"
for _old, _new in T.RENAMED.items():
    _SAN = f"regexp_replace({_SAN}, '\\{_old}\\b', '\\{_new}', 'g')"
_SAN = f"regexp_replace({_SAN}, '(\\\\[a-zA-Z*]+)\\s+(\\{{)', '\\1\\2', 'g')"
_SAN = f"regexp_replace({_SAN}, '\\{{\\s+([a-zA-Z0-9])\\s+([a-zA-Z0-9])\\s*\\}}', '{{\\1\\2}}', 'g')"
_SAN = f"regexp_replace({_SAN}, '\\{{\\s+([a-zA-Z0-9])\\s+([a-zA-Z0-9])\\s+([a-zA-Z0-9])\\s*\\}}', '{{\\1\\2\\3}}', 'g')"


@query(f"SELECT id, {_SAN} AS latex FROM history")
def str_sanitized(spark: SparkSession, d: str) -> DataFrame:
    return _each(spark, d, latex=T.sanitize_latex(F.col("latex")))


@query()
def str_repaired(spark: SparkSession, d: str) -> DataFrame:
    return _each(spark, d, latex=T.repair_latex(F.col("latex")))


@query(f"SELECT id, '$' || {_TRIM('latex')} || '$' AS inline, '$$\n' || {_TRIM('latex')} || '\n$$' AS display, '\\begin{{equation}}\n' || {_TRIM('latex')} || '\n\\end{{equation}}' AS equation FROM history")
def str_latex(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("latex")
    return _each(spark, d, inline=T.as_latex(c, "inline"), display=T.as_latex(c, "display"), equation=T.as_latex(c, "equation"))


@query(f"SELECT id, '$$\n' || {_TRIM('latex')} || '\n$$' AS block, '$' || {_TRIM('latex')} || '$' AS inline FROM history")
def str_markdown(spark: SparkSession, d: str) -> DataFrame:
    return _each(spark, d, block=T.as_markdown(F.col("latex"), "block"), inline=T.as_markdown(F.col("latex"), "inline"))


@query("SELECT id, " + _TRIM(r"regexp_replace(regexp_replace(regexp_replace(latex, '\\[a-zA-Z]+', '', 'g'), '[{}$&]', '', 'g'), '\s+', ' ', 'g')") + " AS text FROM history")
def str_text(spark: SparkSession, d: str) -> DataFrame:
    return _each(spark, d, text=T.as_text(F.col("latex")))


@query(f"SELECT id, array_to_string(list_transform(list_filter(list_transform(string_split(latex, chr(10)), lambda x: {_TRIM('x')}), lambda x: x <> ''), lambda x: '$$' || x || '$$'), chr(10)) AS wrapped FROM history WHERE latex IS NOT NULL")
def str_wrapped(spark: SparkSession, d: str) -> DataFrame:
    return _history(spark, d).where("latex is not null").select("id", T.wrap_lines(F.col("latex")).alias("wrapped"))


_LINES = "string_split(replace(latex, '\\\\ ', chr(10)), chr(10))"
_BARE = f"list_transform({_LINES}, lambda x: regexp_replace(regexp_replace(x, '^\\$+|\\$+$', '', 'g'), '^[\\x00-\\x20]+|[\\x00-\\x20]+$', '', 'g'))"


@query(f"SELECT id, CASE WHEN len({_BARE}) = 1 THEN {_BARE}[1] ELSE '\\begin{{aligned}}' || array_to_string({_BARE}, ' \\\\ ') || '\\end{{aligned}}' END AS latex FROM history WHERE latex IS NOT NULL")
def str_aligned(spark: SparkSession, d: str) -> DataFrame:
    """Values cut at row breaks and put together again."""
    lines = F.split(F.replace("latex", F.lit("\\\\ "), F.lit("\n")), "\n")
    return _history(spark, d).where("latex is not null").select("id", T.aligned(lines).alias("latex"))


@query("SELECT id, replace(replace(replace(latex, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS html FROM history")
def str_html(spark: SparkSession, d: str) -> DataFrame:
    return _each(spark, d, html=T.escape_html(F.col("latex")))


@query("SELECT id, to_json(latex)::VARCHAR AS json FROM history WHERE latex IS NOT NULL")
def str_json(spark: SparkSession, d: str) -> DataFrame:
    return _history(spark, d).where("latex is not null").select("id", F.concat(F.lit('"'), T.escape_json(F.col("latex")), F.lit('"')).alias("json"))


@query("SELECT id, coalesce(latex, '') AS latex FROM history")
def str_json_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Values as result JSON and back."""
    rows = table(spark, d, "history").select("id", "latex", "confidence", F.lit(None).cast("int").alias("time_ms")).withColumn("json", T.result_json("formula"))
    return rows.select("id", T.parse_result(F.col("json"))["latex"].alias("latex"))


@query("SELECT img, to_json({done: true, text: coalesce(text, ''), confidence: coalesce(round(confidence::DOUBLE, 2), 0.0::DOUBLE), timeMs: coalesce(time_ms, 0)})::VARCHAR AS json FROM text_result")
def str_text_json(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "text_result").withColumn("confidence", F.round(F.col("confidence").cast("double"), 2))
    return rows.select("img", T.result_json("text").alias("json"))


@query(
    """SELECT m.img, to_json({done: true, regions: list({x: r.x, y: r.y, w: r.w, h: r.h, type: r.type, text: coalesce(r.text, ''), confidence: coalesce(round(r.confidence::DOUBLE, 2), 0.0::DOUBLE)} ORDER BY r.y, r.x, r.region_id),
timeMs: coalesce(any_value(m.time_ms), 0), formattedText: coalesce(any_value(m.formatted_text), '')})::VARCHAR AS json FROM mixed_result m JOIN (SELECT DISTINCT * FROM regions) r ON r.img = m.img GROUP BY m.img"""
)
def str_mixed_json(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "regions").distinct()
    one = F.struct("y", "x", "region_id", F.struct("x", "y", "w", "h", "type", "text", F.round(F.col("confidence").cast("double"), 2).alias("confidence")).alias("r"))
    regions = r.groupBy("img").agg(F.transform(F.array_sort(F.collect_list(one)), lambda s: s["r"]).alias("regions"))
    return table(spark, d, "mixed_result").join(regions, "img").select("img", T.result_json("mixed").alias("json"))


_PLAIN = "'```latex' || chr(10) || latex || chr(10) || '```'"
_LOUD = "'```TeX' || chr(10) || latex || '```'"


@query(f"SELECT id, {_TRIM(f'''regexp_replace(regexp_replace({_PLAIN}, '```latex\\n?', '', 'g'), '```\\n?', '', 'g')''')} AS plain, {_TRIM(f'''regexp_replace(regexp_replace({_LOUD}, '(?i)```(?:latex|tex)?\\n?', '', 'g'), '```\\n?', '', 'g')''')} AS loud FROM history")
def str_fences(spark: SparkSession, d: str) -> DataFrame:
    plain, loud = F.concat(F.lit("```latex\n"), F.col("latex"), F.lit("\n```")), F.concat(F.lit("```TeX\n"), F.col("latex"), F.lit("```"))
    return _each(spark, d, plain=T.strip_fences(plain), loud=T.strip_fences(loud, True))


_REPEATED = "(SELECT {keys}, {s} AS s, list_filter([CASE WHEN starts_with({s}, repeat({s}[1:n], 3)) THEN {s}[1:n] END FOR n IN range(3, len({s}) // 3 + 1)], lambda x: x IS NOT NULL)[1] AS p FROM history WHERE {s} IS NOT NULL)"
_GUARDED = "SELECT {keys}, CASE WHEN len(s) > 20 AND p IS NOT NULL AND len(p) * 10 < len(s) * 4 THEN '' ELSE s END AS guarded FROM " + _REPEATED


@query(_GUARDED.format(keys="id", s="latex"))
def str_guarded(spark: SparkSession, d: str) -> DataFrame:
    return _history(spark, d).where("latex is not null").select("id", T.guard_repetition(F.col("latex")).alias("guarded"))


@query(_GUARDED.format(keys="id", s="repeat(source || type || '+', 3 + id % 3)"))
def str_loops(spark: SparkSession, d: str) -> DataFrame:
    """Names of sources and types said several times over: some as long as makes a loop, some too short."""
    said = table(spark, d, "history").where("source is not null and type is not null").selectExpr("id", "repeat(source || type || '+', cast(3 + id % 3 as int)) as said")
    return said.select("id", T.guard_repetition(F.col("said")).alias("guarded"))


# Some traditional characters and the simplified ones that stand for them; whole tables are a parameter.
_FOLD = {"識": "识", "別": "别", "圖": "图", "頁": "页", "線": "线", "數": "数", "陣": "阵", "積": "积", "變": "变", "覆": "覆"}
_OLD, _NEW = "".join(_FOLD), "".join(_FOLD.values())


@query(f"SELECT doc_id, translate(translate(text, '{_NEW[::2]}', '{_OLD[::2]}'), '{_OLD}', '{_NEW}') AS folded FROM documents")
def str_folded(spark: SparkSession, d: str) -> DataFrame:
    """Documents, half of whose characters of the table are written in the traditional way, folded to simplified ones."""
    old = F.translate("text", _NEW[::2], _OLD[::2])
    return table(spark, d, "documents").select("doc_id", T.fold_characters(old, _FOLD).alias("folded"))


@query("SELECT id, 'saved ' || coalesce(source, '{{from}}') || ' as ' || coalesce(type, '{{kind}}') || ' {{x}}' AS message FROM history")
def str_filled(spark: SparkSession, d: str) -> DataFrame:
    values = F.map_filter(F.create_map(F.lit("from"), F.col("source"), F.lit("kind"), F.col("type")), lambda k, v: v.isNotNull())
    return table(spark, d, "history").select("id", T.fill_template(F.lit("saved {{from}} as {{kind}} {{x}}"), values).alias("message"))


@query("SELECT session_id, rtrim('http://host/' || coalesce(platform, '') || '//', '/') AS url, lower(regexp_replace(coalesce(app_version, ''), '^v', '')) AS version FROM log_sessions")
def str_urls(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "log_sessions")
    return s.select("session_id", T.strip_slashes(F.concat(F.lit("http://host/"), F.coalesce("platform", F.lit("")), F.lit("//"))).alias("url"), F.lower(F.regexp_replace(F.coalesce("app_version", F.lit("")), "^v", "")).alias("version"))


_V = "list_transform(list_concat(string_split(v, '.'), ['0', '0', '0'])[1:3], lambda p: coalesce(try_cast(p AS INT), 0))"


@query(f"SELECT id, {_V} > [2, 1, 0] AS is_newer FROM (SELECT id, (id % 4)::VARCHAR || '.' || CASE WHEN id % 5 = 0 THEN 'x' ELSE (id % 3)::VARCHAR END || CASE WHEN id % 2 = 0 THEN '.' || (id % 7)::VARCHAR ELSE '' END AS v FROM history)")
def str_newer(spark: SparkSession, d: str) -> DataFrame:
    s = lambda n: (F.col("id") % n).cast("string")
    v = F.concat(s(4), F.lit("."), F.when(F.col("id") % 5 == 0, "x").otherwise(s(3)), F.when(F.col("id") % 2 == 0, F.concat(F.lit("."), s(7))).otherwise(""))
    return _each(spark, d, is_newer=T.newer(v, F.lit("2.1")))


@query("SELECT doc_id, CASE WHEN coalesce(text, '') = '' THEN '暂无更新说明。' ELSE " + _TRIM(r"regexp_replace(replace(replace(text, '### ', chr(10) || '### '), '## ', chr(10) || '## '), '!?\[.*?\]\(.*?\)', '', 'g')") + " END AS notes FROM documents")
def str_notes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.release_notes(F.col("text")).alias("notes"))


@query("SELECT id, strftime(created_at, '%H:%M:%S.%g') AS clock, id % 2 = 0 AND TIMESTAMP '2024-06-01 00:00:00' - INTERVAL 12 HOUR >= created_at AS due FROM history WHERE created_at IS NOT NULL")
def str_clock(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "history").where("created_at is not null")
    return h.select("id", T.clock(F.col("created_at")).alias("clock"), T.check_due(F.expr("timestamp_ntz '2024-06-01 00:00:00'"), F.col("created_at"), F.col("id") % 2 == 0).alias("due"))


@query("SELECT id, CAST(id % 65536 AS BIGINT) AS big, CAST((id % 256) * 256 + (id // 256) % 256 AS BIGINT) AS little FROM history")
def str_integers(spark: SparkSession, d: str) -> DataFrame:
    """Two bytes of every id, read in both orders."""
    raw = F.unhex(F.lpad(F.hex(F.col("id") % 65536), 4, "0"))
    return _each(spark, d, big=T.read_int(raw, 0, 2, False), little=T.read_int(raw, 0, 2, True))
