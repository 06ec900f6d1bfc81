"""Queries over the exported log buffer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.operators import log_entries as L
from pagemill.operators.log_entries import log_entries
from pagemill.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return log_entries(table(spark, d, "log_lines"), message=False)


def p1_entries(spark: SparkSession, d: str) -> DataFrame:
    return log_entries(table(spark, d, "log_lines"))


def p1_levels(spark: SparkSession, d: str) -> DataFrame:
    return log_entries(table(spark, d, "log_lines"), message=False).groupBy("component", "level").agg(F.count("*").alias("entries"))


# The same entries in SQL: every line is tried against the line pattern of every layout, without signatures, and continuations
# are found by one window over the whole session.
def _first(names: tuple[str, ...], get: str) -> str:
    return "coalesce(" + ", ".join(f"nullif({get.format(n)}, '')" for n in names) + ")"


def _groups() -> str:
    """[raw time, level, component, message] of a line by the first layout that fits."""
    cases = []
    for name, _, pattern, groups in L.LAYOUTS:
        if name == "json":
            keys = [_first(k, "json_extract_string(t, '{}')") for k in (L.TIME_KEYS, L.LEVEL_KEYS, L.MODULE_KEYS)]
            cases.append(f"WHEN t LIKE '{{%' AND json_valid(t) THEN [{', '.join(keys)}, coalesce({_first(L.TEXT_KEYS, "json_extract_string(t, '{}')")}, t)]")
        elif name == "pairs":
            keys = [rf"nullif(regexp_extract(bare, '(?:^| )(?:{'|'.join(k)})=([^\s\"]+)', 1), '')" for k in (L.TIME_KEYS, L.LEVEL_KEYS, L.MODULE_KEYS)]
            said = rf"regexp_extract(t, '(?:^| )(?:{'|'.join(L.TEXT_KEYS)})=\"((?:[^\"\\]|\\.)*)\"', 1)"
            message = rf"CASE WHEN {said} = '' THEN t ELSE regexp_replace({said}, '\\([\"\\])', '\1', 'g') END"
            cases.append(rf"WHEN regexp_matches(t, '^[A-Za-z_.]+=\S') THEN [{', '.join(keys)}, {message}]")
        else:
            keys = [f"regexp_extract(t, '{pattern}', {g})" if g else "''" for g in groups]
            cases.append(f"WHEN regexp_matches(t, '{pattern}') THEN [{', '.join(keys)}, regexp_replace(t, '{pattern}', '')]")
    return "CASE " + " ".join(cases) + " END"


_LEVEL = "CASE " + " ".join(f"WHEN upper(trim(f[2])) IN ({', '.join(repr(w) for w in words)}) THEN '{name}'" for name, words in L.LEVELS.items()) + " ELSE '' END"
_PART = "regexp_extract(f[1], '(\\d{{1,2}}):(\\d\\d):(\\d\\d)', {})::INT"
_ZONE = "regexp_extract(f[1], '([+-])(\\d\\d):?(\\d\\d)$', {})"
_P1 = rf"""WITH base AS (SELECT DISTINCT session_id, line_no, regexp_replace(coalesce(line, ''), chr(27) || '\[[0-9;]*[A-Za-z]', '', 'g') AS t FROM log_lines WHERE line_no IS NOT NULL),
two AS (SELECT *, regexp_replace(t, '{L._QUOTED}', '', 'g') AS bare FROM base),
raw AS (SELECT session_id, line_no, t, {_groups()} AS f FROM two),
timed AS (SELECT session_id, line_no, t, f, CASE WHEN regexp_matches(f[1], '^\d{{13}}$') THEN f[1]::BIGINT % 86400000 WHEN regexp_matches(f[1], '\d{{1,2}}:\d\d:\d\d') THEN
((CASE WHEN contains(f[1], 'M') THEN {_PART.format(1)} % 12 + CASE WHEN contains(f[1], 'PM') THEN 12 ELSE 0 END ELSE {_PART.format(1)} % 24 END) * 3600000 + {_PART.format(2)} * 60000 + {_PART.format(3)} * 1000
+ left(regexp_extract(f[1], ':\d\d(?: [AP]M)?[.,](\d+)', 1) || '000', 3)::INT
- CASE WHEN regexp_matches(f[1], '[+-]\d\d:?\d\d$') THEN ({_ZONE.format(2)}::INT * 60 + {_ZONE.format(3)}::INT) * CASE {_ZONE.format(1)} WHEN '-' THEN -60000 ELSE 60000 END ELSE 0 END + 86400000 * 2) % 86400000 END AS ms FROM raw),
heads AS (SELECT session_id, line_no, t, f[4] AS said, CASE WHEN ms IS NOT NULL AND coalesce(f[3], '') <> '' THEN {{'ms': ms::BIGINT, 'level': {_LEVEL}, 'component': f[3]}} END AS head FROM timed),
placed AS (SELECT *, max(CASE WHEN head IS NOT NULL THEN line_no END) OVER (PARTITION BY session_id ORDER BY line_no RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS begun FROM heads),
entries AS (SELECT session_id, begun AS line_no, max(line_no) AS last_line, max(head) AS head, string_agg(CASE WHEN head IS NOT NULL THEN said ELSE t END, chr(10) ORDER BY line_no, CASE WHEN head IS NOT NULL THEN said ELSE t END) AS message FROM placed WHERE begun IS NOT NULL GROUP BY session_id, begun),
found AS (SELECT session_id, line_no, last_line, printf('%02d:%02d:%02d.%03d', head.ms // 3600000, head.ms // 60000 % 60, head.ms // 1000 % 60, head.ms % 1000) AS tod, head.level AS level, head.component AS component, message FROM entries)"""

QUERIES = {"p1_found": p1_found, "p1_entries": p1_entries, "p1_levels": p1_levels}
ORACLE: dict[str, str] = {"p1_found": f"{_P1} SELECT * EXCLUDE (message) FROM found", "p1_entries": f"{_P1} SELECT * FROM found", "p1_levels": f"{_P1} SELECT component, level, count(*) AS entries FROM found GROUP BY component, level"}
