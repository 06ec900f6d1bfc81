"""Log entries: layouts, continuations over blocks, disorder, nulls."""

import random

from pyspark.sql import functions as F

from pagemill.operators import log_entries as L

LINES = [
    "banner before any entry",
    "[24:00:07.431][INFO][settings] read",
    "  at x (y.js:1:2)",
    "[11:13:28 PM.027][WARN][ui] late",
    "1707523200256  [JS] [JS-ERROR][polish] bad",
    "[1, 2, 3]",
    "1707523201153  [Detector] plain",
    "02-10 00:00:00.914  1007 12492 E Rec: [11:00:00] inner",
    "01-01 07:34:56.848 D/Runner( 1104): done",
    "\u001b[0;93m2024-02-10 00:00:21.300042420 [W:onnxruntime:Default, frame.cc:667 X] hot\u001b[m",
    "2024-02-10T02:00:08.617+02:00 WARN pdf.api - zone",
    "2024-06-12 04:37:15,774 CRITICAL convert: x",
    '{"message":"m","level":"warning","ts":1720751939526,"component":"sw"}',
    '{"ts":"2024-02-10T00:00:00.505Z","level":"debug"}',
    'lvl=debug ts=2024-07-05T14:26:04.963Z msg="a mod=no \\"q\\"" mod=exporter',
    "2024-05-04 pixel.onnx 2329042",
    "WARN: see above",
]
WANT = [
    (1, 2, "00:00:07.431", "INFO", "settings"),
    (3, 3, "23:13:28.027", "WARN", "ui"),
    (4, 5, "00:00:00.256", "ERROR", "polish"),
    (6, 6, "00:00:01.153", "", "Detector"),
    (7, 7, "00:00:00.914", "ERROR", "Rec"),
    (8, 8, "07:34:56.848", "DEBUG", "Runner"),
    (9, 9, "00:00:21.300", "WARN", "onnxruntime"),
    (10, 10, "00:00:08.617", "WARN", "pdf.api"),
    (11, 11, "04:37:15.774", "ERROR", "convert"),
    (12, 13, "02:38:59.526", "WARN", "sw"),
    (14, 16, "14:26:04.963", "DEBUG", "exporter"),
]


def frame(spark, rows):
    return spark.createDataFrame(rows, "session_id bigint, line_no bigint, line string, level string, head string")


def found(df):
    return sorted(tuple(r) for r in df.select("session_id", "line_no", "last_line", "tod", "level", "component").collect())


def test_layouts_and_disorder(spark):
    rows = [(1, n, t, "other", None) for n, t in enumerate(LINES)]
    rows += rows[4:8] + [(1, None, LINES[1], None, None), (2, 5, None, None, None)]
    random.Random(1).shuffle(rows)
    assert found(L.log_entries(frame(spark, rows))) == [(1, *w) for w in WANT]


def test_messages(spark):
    rows = [(1, n, t, None, None) for n, t in enumerate(LINES)]
    text = {r["line_no"]: r["message"] for r in L.log_entries(frame(spark, rows)).collect()}
    assert text[1] == "read\n  at x (y.js:1:2)" and text[9] == "hot" and text[12].startswith("m\n") and text[14].startswith('a mod=no "q"\n2024')


def test_entries_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(L, "BLOCK_LINES", 4)
    rng = random.Random(2)
    rows, want, now = [], [], None
    for n in range(200):
        if rng.random() < 0.12:
            rows.append((None, n, f"[10:00:0{n % 10}.000][INFO][ui] {n}", None, None))
            now = [None, n, n, f"10:00:0{n % 10}.000", "INFO", "ui"]
            want.append(now)
        else:
            rows.append((None, n, f"more {n}", None, None))
            if now:
                now[2] = n
    rng.shuffle(rows)
    got = L.log_entries(frame(spark, rows))
    assert sorted(map(tuple, (r[:6] for r in got.collect())), key=lambda r: r[1]) == [tuple(w) for w in want]
    assert sum(r["message"].count("\n") + 1 for r in got.collect()) == sum(w[2] - w[1] + 1 for w in want)


def test_empty(spark):
    assert L.log_entries(frame(spark, [])).count() == 0


def test_headers_longer_than_a_signature(spark):
    """A header that ends behind the symbols kept of a signature is still one, and so is none that only begins like one."""
    tag = "-".join(["part"] * 30)
    lines = ["03-01 10:00:00.123  1  2 I Tag: first", f"03-01 10:00:01.000  1  2 W {tag}: second", "go on", "03-01 10:00:02.000  1  2 " + "x-" * 40 + " no header", "03-01 10:00:03.000  1  2 E Last: third"]
    df = spark.createDataFrame([(1, k, t) for k, t in enumerate(lines)], "session_id bigint, line_no bigint, line string")
    got = sorted((r["line_no"], r["last_line"], r["level"], r["component"]) for r in L.log_entries(df).collect())
    assert got == [(0, 0, "INFO", "Tag"), (1, 3, "WARN", tag), (4, 4, "ERROR", "Last")]


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, 1, "10:00 banner"), (1, 2, "[24:00:07.431][INFO][settings] read"), (None, 1, "[10:00:07.431][WARN][x] y"), (2, None, "[10:00:07.431][WARN][x] y"), (1, 3, None)], "session_id bigint, line_no bigint, line string")
    for c in ("sig", "rule", "whole", "late", "raw", "level", "component", "message", "block", "head", "start", "undecided"):
        df = df.withColumn(c, F.lit("clash"))
    got = L.log_entries(df).collect()
    assert sorted((r["session_id"] or 0, r["line_no"], r["last_line"], r["component"], r["message"]) for r in got) == [(0, 1, 1, "x", "y"), (1, 2, 3, "settings", "read\n")]
    assert L.log_entries(df.where("false")).count() == 0
