"""Raster queries over vectors as grids of 8 by 8 pixels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions import geometry as G
from pagemill.operators import boxes as B
from pagemill.operators import models as M
from pagemill.operators import rasters as R
from pagemill.session import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

# Pixels: place k of a vector is row k / 8, column k % 8; its value scaled to 0..255.
_PX = """WITH r AS (SELECT vec_id AS img, unnest(embedding) AS e, unnest(range(64)) AS k FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
px AS (SELECT img, CAST(k // 8 AS INT) AS y, CAST(k % 8 AS INT) AS x, CAST(least(greatest(floor((e::DOUBLE + 0.5) * 255), 0), 255) AS INT) AS v FROM r)"""


# Every row of a grid as an image of its own, for what works along a line.
_LINES = f"{_PX}, ln AS (SELECT img * 8 + y AS img, x, v FROM px)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def pixels(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").where("vec_id is not null and embedding is not null").select(F.col("vec_id").alias("img"), F.posexplode("embedding").alias("k", "e"))
    v = F.least(F.greatest(F.floor((F.col("e").cast("double") + 0.5) * 255), F.lit(0)), F.lit(255)).cast("int")
    return e.select("img", F.floor(F.col("k") / 8).cast("int").alias("y"), (F.col("k") % 8).cast("int").alias("x"), v.alias("v"))


def lines(spark: SparkSession, d: str) -> DataFrame:
    return pixels(spark, d).select((F.col("img") * 8 + F.col("y")).alias("img"), "x", "v")


_HIST = "h AS (SELECT img, v, count(*) AS c FROM px GROUP BY img, v), f AS (SELECT i.img, l.v, coalesce(h.c, 0) AS n FROM (SELECT DISTINCT img FROM px) i CROSS JOIN (SELECT unnest(range(256))::INT AS v) l LEFT JOIN h ON h.img = i.img AND h.v = l.v)"


@query(f"{_PX}, {_HIST} SELECT img, v, n FROM f")
def ras_histogram(spark: SparkSession, d: str) -> DataFrame:
    return R.histogram(pixels(spark, d))


@query(
    f"""{_PX}, {_HIST}, c AS (SELECT img, v, sum(n) OVER w AS nb, sum(n * v) OVER w AS sb, sum(n) OVER (PARTITION BY img) AS na, sum(n * v) OVER (PARTITION BY img) AS sa FROM f WINDOW w AS (PARTITION BY img ORDER BY v)),
b AS (SELECT img, v, round(nb::DOUBLE * (na - nb) * pow(sb::DOUBLE / nb - (sa - sb)::DOUBLE / (na - nb), 2), 6) AS var FROM c WHERE nb > 0 AND na > nb)
SELECT i.img, coalesce(t.v, 128) AS threshold FROM (SELECT DISTINCT img FROM px) i LEFT JOIN (SELECT img, arg_min(v, -var * 1000 + v * 0.0000001) AS v FROM b WHERE var > 0 GROUP BY img) t ON t.img = i.img"""
)
def ras_otsu(spark: SparkSession, d: str) -> DataFrame:
    return R.otsu(pixels(spark, d))


@query(f"{_PX} SELECT img, y, sum(CASE WHEN v > 140 THEN 1 ELSE 0 END)::BIGINT AS n FROM px GROUP BY img, y")
def ras_rows(spark: SparkSession, d: str) -> DataFrame:
    return R.projection(pixels(spark, d), "y", F.col("v") > 140)


@query(f"{_PX} SELECT img, x, sum(CASE WHEN v > 140 THEN 1 ELSE 0 END)::BIGINT AS n FROM px GROUP BY img, x")
def ras_columns(spark: SparkSession, d: str) -> DataFrame:
    return R.projection(pixels(spark, d), "x", F.col("v") > 140)


_ROWS = "rw AS (SELECT img, y, sum(CASE WHEN v > 140 THEN 1 ELSE 0 END)::BIGINT AS n FROM px GROUP BY img, y)"


@query(
    f"""{_PX}, {_ROWS}, hit AS (SELECT img, y, y - row_number() OVER (PARTITION BY img ORDER BY y) AS g FROM rw WHERE n >= 3), f AS (SELECT img, min(y) AS lo, max(y) AS hi FROM hit GROUP BY img, g)
SELECT img, lo, hi FROM f UNION ALL SELECT img, min(y), max(y) FROM rw WHERE img NOT IN (SELECT img FROM f) GROUP BY img"""
)
def ras_bands(spark: SparkSession, d: str) -> DataFrame:
    return R.content_bands(pixels(spark, d), F.col("v") > 140, 3)


@query(f"{_PX}, {_ROWS}, hit AS (SELECT img, y, y - row_number() OVER (PARTITION BY img ORDER BY y) AS g FROM rw WHERE n < 3) SELECT img, min(y) AS lo, max(y) AS hi FROM hit GROUP BY img, g HAVING max(y) - min(y) + 1 >= 2")
def ras_gaps(spark: SparkSession, d: str) -> DataFrame:
    return R.gaps(R.projection(pixels(spark, d), "y", F.col("v") > 140), "y", 3, 2)


@query(
    f"""{_PX}, rw AS (SELECT img, y, sum(CASE WHEN v > 165 THEN 1 ELSE 0 END)::BIGINT AS n FROM px GROUP BY img, y), hit AS (SELECT img, y, y - row_number() OVER (PARTITION BY img ORDER BY y) AS g FROM rw WHERE n < 1), gp AS (SELECT img, min(y) AS lo, max(y) AS hi FROM hit GROUP BY img, g HAVING max(y) - min(y) + 1 >= 2),
cr AS (SELECT DISTINCT gp.img, lo, hi FROM gp JOIN (SELECT img AS i, y, x FROM px WHERE v > 150) p ON i = gp.img AND y BETWEEN lo AND hi GROUP BY gp.img, lo, hi, x HAVING count(*) >= greatest(1, (hi - lo + 1) * 3 // 10))
SELECT img, lo, hi FROM gp EXCEPT SELECT img, lo, hi FROM cr"""
)
def ras_uncrossed(spark: SparkSession, d: str) -> DataFrame:
    px = pixels(spark, d)
    return R.uncrossed_gaps(R.gaps(R.projection(px, "y", F.col("v") > 165), "y", 1, 2), px, F.col("v") > 150)


# A band runs from its first inked row on; rows without ink are numbered within it, and the second ends it two rows up.
_BANDS = """l AS (SELECT img, list({'y': y, 'n': n} ORDER BY y) AS rs FROM rw GROUP BY img),
k AS (SELECT img, rs[-1].y AS last, list_reduce(list_transform(rs, lambda r: {'y': r.y::INT, 'n': r.n, 'lo': -1::INT, 'low': 0::INT, 'done': []::STRUCT(lo INT, hi INT)[]}), lambda s, r:
CASE WHEN s.lo < 0 AND r.n >= 3 THEN {'y': r.y, 'n': r.n, 'lo': r.y, 'low': 0::INT, 'done': s.done} WHEN s.lo < 0 OR r.n >= 3 THEN s
WHEN s.low + 1 >= 2 THEN {'y': r.y, 'n': r.n, 'lo': -1::INT, 'low': 0::INT, 'done': list_append(s.done, {'lo': s.lo, 'hi': (r.y - 2)::INT})} ELSE {'y': r.y, 'n': r.n, 'lo': s.lo, 'low': (s.low + 1)::INT, 'done': s.done} END,
{'y': -1::INT, 'n': 0::BIGINT, 'lo': -1::INT, 'low': 0::INT, 'done': []::STRUCT(lo INT, hi INT)[]}) AS s FROM l),
u AS (SELECT img, unnest(CASE WHEN s.lo >= 0 THEN list_append(s.done, {'lo': s.lo, 'hi': last::INT}) ELSE s.done END) AS b FROM k) SELECT img, b.lo AS lo, b.hi AS hi FROM u"""


@query(f"{_PX}, {_ROWS}, {_BANDS}")
def ras_ink_bands(spark: SparkSession, d: str) -> DataFrame:
    return R.ink_bands(R.projection(pixels(spark, d), "y", F.col("v") > 140), 3, 2)


# All gaps are narrow here, so bands join their run as soon as a link holds: gaps and islands over the links.
@query(
    f"""{_PX}, {_ROWS}, hit AS (SELECT img, y, y - row_number() OVER (PARTITION BY img ORDER BY y) AS g FROM rw WHERE n >= 3), f AS (SELECT img, min(y) AS lo, max(y) AS hi FROM hit GROUP BY img, g),
bd AS (SELECT * FROM f UNION ALL SELECT img, min(y), max(y) FROM rw WHERE img NOT IN (SELECT img FROM f) GROUP BY img),
ch AS (SELECT *, CASE WHEN img % 7 >= 2 OR lo - lag(hi) OVER (PARTITION BY img ORDER BY lo) - 1 <= 0 THEN 0 ELSE 1 END AS c FROM bd), nr AS (SELECT *, sum(c) OVER (PARTITION BY img ORDER BY lo) AS run FROM ch)
SELECT img, min(lo) AS lo, max(hi) AS hi FROM nr GROUP BY img, run"""
)
def ras_merged_bands(spark: SparkSession, d: str) -> DataFrame:
    b = R.content_bands(pixels(spark, d), F.col("v") > 140, 3)
    return R.merge_bands(b.withColumns({"cols": (F.col("img") % 7).cast("int"), "share": F.lit(0.5), "fragment": F.lit(True)}))


@query(f"{_PX}, o AS (SELECT unnest([-1, 0, 1]) AS dv) SELECT DISTINCT img, y + a.dv AS y, x + b.dv AS x FROM (SELECT * FROM px WHERE v > 150), o a, o b")
def ras_dilated(spark: SparkSession, d: str) -> DataFrame:
    return R.dilate(pixels(spark, d).where("v > 150"))


@query(f"{_PX} SELECT img, avg(v) > 200 AND avg(CASE WHEN v < 128 THEN 1.0::DOUBLE ELSE 0 END) > 0.002 AND avg(CASE WHEN v < 128 THEN 1.0::DOUBLE ELSE 0 END) < 0.15 AS handwritten FROM px GROUP BY img")
def ras_handwritten(spark: SparkSession, d: str) -> DataFrame:
    return R.looks_handwritten(pixels(spark, d))


@query(f"{_PX} SELECT img, y, x, round((v * 0.299::DOUBLE + v * 0.587::DOUBLE + (255 - v) * 0.114::DOUBLE), 6) AS gray, v * 886 + (255 - v) * 114 AS gray_sum, CASE WHEN least(v, 255 - v) < 200 THEN 0 ELSE 255 END AS ink, CASE WHEN v / 255.0 > 0.3 THEN 1 ELSE 0 END AS mask FROM px")
def ras_levels(spark: SparkSession, d: str) -> DataFrame:
    """Levels of pixels whose blue channel is the inverse of the others, packed and taken apart again."""
    v = F.col("v")
    packed = pixels(spark, d).withColumn("c", R.channels(F.shiftleft(v, 16) + F.shiftleft(v, 8) + (F.lit(255) - v)))
    r, g, b = F.col("c.r"), F.col("c.g"), F.col("c.b")
    return packed.select("img", "y", "x", F.round(R.gray(r, g, b), 6).alias("gray"), R.gray_sum(r, g, b).alias("gray_sum"), R.ink(r, g, b).alias("ink"), R.binarise(v / 255.0).alias("mask"))


@query(f"{_LINES}, s AS (SELECT img, list_sort(list(v)) AS l FROM ln GROUP BY img) SELECT img, CAST((l[4] + l[5]) // 2 AS INT) AS background FROM s")
def ras_background(spark: SparkSession, d: str) -> DataFrame:
    return lines(spark, d).groupBy("img").agg(R.background(F.collect_list("v")).alias("background"))


_PARTS = f"{_LINES}, lb AS (SELECT img, x, CASE WHEN v > 127 THEN 1 ELSE 0 END AS label FROM ln)"


@query(
    f"{_PARTS}, c AS (SELECT *, CASE WHEN lag(label) OVER (PARTITION BY img ORDER BY x) = label THEN 0 ELSE 1 END AS ch FROM lb), g AS (SELECT *, sum(ch) OVER (PARTITION BY img ORDER BY x) AS run FROM c) SELECT img, label, min(x) AS lo, max(x) AS hi FROM g GROUP BY img, run, label HAVING max(x) - min(x) + 1 >= 2"
)
def ras_label_runs(spark: SparkSession, d: str) -> DataFrame:
    row = lines(spark, d).withColumn("label", (F.col("v") > 127).cast("int"))
    return R.label_runs(row, "label", "x", "img", least=2)


# Places are passed over from left to right, each look seeing what earlier ones have changed.
_SWEEP = "list_reduce(list_concat([{a}], list_transform(range(2, len({a}) - {w} + 1), lambda k: [k::INT])), lambda acc, k: CASE WHEN acc[k[1] - 1] = acc[k[1] + {w}] AND acc[k[1]] <> acc[k[1] - 1] {inner} THEN list_transform(acc, lambda v, i: CASE WHEN i >= k[1] AND i < k[1] + {w} THEN acc[k[1] - 1] ELSE v END) ELSE acc END)"


@query(
    f"{_PARTS}, l AS (SELECT img, list(label ORDER BY x) AS a FROM lb GROUP BY img), one AS (SELECT img, {_SWEEP.format(a='a', w=1, inner='')} AS b FROM l), two AS (SELECT img, {_SWEEP.format(a='b', w=2, inner='AND acc[k[1] + 1] = acc[k[1]]')} AS c FROM one) SELECT img, array_to_string(c, '') AS labels FROM two"
)
def ras_islands(spark: SparkSession, d: str) -> DataFrame:
    row = lines(spark, d).groupBy("img").agg(F.transform(F.array_sort(F.collect_list(F.struct("x", (F.col("v") > 127).cast("int").alias("l")))), lambda s: s["l"]).alias("labels"))
    return row.select("img", F.array_join(F.transform(R.remove_islands(F.col("labels")), lambda v: v.cast("string")), "").alias("labels"))


@query(
    f"""{_LINES}, n AS (SELECT img, x, CASE WHEN v > 127 THEN v END AS v FROM ln)
SELECT img, x, coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY img ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(v IGNORE NULLS) OVER (PARTITION BY img ORDER BY x ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS v FROM n"""
)
def ras_filled(spark: SparkSession, d: str) -> DataFrame:
    row = lines(spark, d).select("img", "x", F.when(F.col("v") > 127, F.col("v")).alias("v"))
    return R.fill_nulls(row, "v", "img", order="x")


_VOTES = f"{_LINES}, vt AS (SELECT img, x * 32 AS px, 64 AS pw, v / 255.0::DOUBLE AS p FROM ln)"


def _votes(spark: SparkSession, d: str) -> DataFrame:
    return lines(spark, d).select("img", (F.col("x") * 32).alias("px"), F.lit(64).alias("pw"), (F.col("v") / 255.0).alias("p"))


@query(f"{_VOTES}, s AS (SELECT img, unnest(range(px // 8, (px + pw - 1) // 8 + 1)) AS slot, p FROM vt) SELECT img, slot, CAST(round(avg(p), 9) >= 0.45 AS INT) AS label FROM s GROUP BY img, slot")
def ras_slots(spark: SparkSession, d: str) -> DataFrame:
    return R.slot_vote(_votes(spark, d), least=0.45)


@query(f"{_VOTES} SELECT img, CASE WHEN count(*) FILTER (p <= 0.5) >= count(*) FILTER (p > 0.5) THEN 0 ELSE 1 END AS label FROM vt GROUP BY img")
def ras_half_split(spark: SparkSession, d: str) -> DataFrame:
    return R.half_split(_votes(spark, d))


@query(
    f"""{_VOTES}, ch AS (SELECT DISTINCT img, unnest([1, 2]) AS chunk, unnest([10, 90]) AS x, unnest([40, 150]) AS w FROM vt),
h AS (SELECT ch.img, chunk, greatest(least(x + w, px + pw) - greatest(x, px), 0) AS o, p >= CASE WHEN w < 55 THEN 0.65 ELSE 0.40 END AS txt FROM ch JOIN vt ON ch.img = vt.img)
SELECT img, chunk, CASE WHEN sum(CASE WHEN txt THEN o ELSE 0 END) >= sum(CASE WHEN txt THEN 0 ELSE o END) THEN 1 ELSE 0 END AS label FROM h WHERE o > 0 GROUP BY img, chunk"""
)
def ras_patch_vote(spark: SparkSession, d: str) -> DataFrame:
    votes = _votes(spark, d)
    piece = lambda c, x, w: F.struct(F.lit(c).alias("chunk"), F.lit(x).alias("x"), F.lit(w).alias("w"))
    chunks = votes.select("img").distinct().select("img", F.inline(F.array(piece(1, 10, 40), piece(2, 90, 150))))
    return R.patch_vote(chunks, votes)


@query(f"{_PX} SELECT img, s AS start FROM (SELECT img, unnest(CASE WHEN max(v) >= 64 THEN range(0, max(v) - 63, 32) ELSE [0] END) AS s FROM px GROUP BY img)")
def ras_patches(spark: SparkSession, d: str) -> DataFrame:
    return pixels(spark, d).groupBy("img").agg(F.max("v").alias("w")).select("img", F.explode(R.patches(F.col("w"))).alias("start")).withColumn("start", F.col("start").cast("bigint"))


_LINE = f"{_LINES}, ps AS (SELECT img, x * 60 AS x, v % 5 AS y, 30 + v % 25 AS w, 20 + v % 4 AS h, CASE WHEN v > 127 THEN 1 ELSE 0 END AS label FROM ln)"


def _parts(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("v")
    return lines(spark, d).select("img", (F.col("x") * 60).alias("x"), (v % 5).alias("y"), (30 + v % 25).alias("w"), (20 + v % 4).alias("h"), (v > 127).cast("int").alias("label"))


@query(
    f"""{_LINE}, n AS (SELECT *, lag(label) OVER q AS bl, lag(x) OVER q AS bx, lag(w) OVER q AS bw, lag(y) OVER q AS byy, lag(h) OVER q AS bh, lead(label) OVER q AS nl, lead(x) OVER q AS nx, lead(y) OVER q AS ny, lead(h) OVER q AS nh FROM ps WINDOW q AS (PARTITION BY img ORDER BY x, y))
SELECT img, x, y, w, h, CASE WHEN label = 1 AND w < 55 AND bl = 0 AND nl = 0 AND x - (bx + bw) <= 24 AND nx - (x + w) <= 24 AND abs(y - byy) * 10 <= greatest(h, bh) * 3 AND abs(y - ny) * 10 <= greatest(h, nh) * 3 THEN 0 ELSE label END AS label FROM n"""
)
def ras_relabelled(spark: SparkSession, d: str) -> DataFrame:
    return R.relabel_narrow(_parts(spark, d))


_NEAR = "c[1].x - (m.x + m.w) <= 28 AND m.label = c[1].label AND abs(m.y - c[1].y) * 10 <= greatest(m.h, c[1].h) * 3 AND abs(m.h - c[1].h) * 10 <= greatest(m.h, c[1].h) * 3"


@query(
    f"""{_LINE}, l AS (SELECT img, list({{'x': x, 'y': y, 'w': w, 'h': h, 'label': label}} ORDER BY x, y, w, h, label) AS ps FROM ps GROUP BY img),
k AS (SELECT img, unnest(list_reduce(list_transform(ps, lambda p: [p]), lambda acc, c: CASE WHEN len(list_filter(acc[-1:], lambda m: {_NEAR})) = 0 THEN list_concat(acc, c)
ELSE list_concat(acc[:-2], list_transform(acc[-1:], lambda m: {{'x': least(m.x, c[1].x), 'y': least(m.y, c[1].y), 'w': greatest(m.x + m.w, c[1].x + c[1].w) - least(m.x, c[1].x), 'h': greatest(m.y + m.h, c[1].y + c[1].h) - least(m.y, c[1].y), 'label': m.label}})) END)) AS b FROM l)
SELECT img, b.x AS x, b.y AS y, b.w AS w, b.h AS h, b.label AS label FROM k"""
)
def ras_merged_parts(spark: SparkSession, d: str) -> DataFrame:
    return R.merge_adjacent(_parts(spark, d))


@query(
    f"""{_PX}, {_ROWS}, hit AS (SELECT img, y, y - row_number() OVER (PARTITION BY img ORDER BY y) AS g FROM rw WHERE n < 3), gp AS (SELECT img, min(y) AS lo, max(y) + 1 AS hi FROM hit GROUP BY img, g),
ends AS (SELECT img, lo AS pl, 'to' AS k FROM gp UNION ALL SELECT img, hi, 'from' FROM gp UNION ALL SELECT DISTINCT img, 0, 'from' FROM px UNION ALL SELECT DISTINCT img, 8, 'to' FROM px),
fr AS (SELECT img, pl, row_number() OVER (PARTITION BY img ORDER BY pl) AS n FROM ends WHERE k = 'from'), til AS (SELECT img, pl, row_number() OVER (PARTITION BY img ORDER BY pl) AS n FROM ends WHERE k = 'to'),
pc AS (SELECT fr.img, fr.pl AS lo, til.pl - fr.pl AS size FROM fr JOIN til ON fr.img = til.img AND fr.n = til.n WHERE til.pl - fr.pl >= 2)
SELECT img, lo::INT AS lo, size::INT AS size FROM pc UNION ALL SELECT DISTINCT img, 0, 8 FROM px WHERE img NOT IN (SELECT img FROM pc)"""
)
def ras_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Lines of a grid: what lies between its empty rows."""
    px = pixels(spark, d)
    return B.pieces(R.gaps(R.projection(px, "y", F.col("v") > 140), "y", 3, 1), px.select("img").distinct().withColumn("size", F.lit(8)), 2)


@query(f"{_PX} SELECT img, y, x, CAST(floor(v * (x * 36) / 255.0::DOUBLE + 255 * (1 - (x * 36) / 255.0::DOUBLE) + 0.5) AS INT) AS v FROM px")
def ras_on_white(spark: SparkSession, d: str) -> DataFrame:
    """Grids as drawings that fade in from left to right, laid on white."""
    return pixels(spark, d).withColumn("v", M.on_white(F.col("v"), F.col("x") * 36))


@query(f"{_PX} SELECT img, box_id, w, h, list(v ORDER BY y, x) AS px FROM px JOIN (SELECT unnest([1, 2]) AS box_id, unnest([1, 4]) AS bx, unnest([1, 3]) AS bt, unnest([4, 4]) AS w, unnest([3, 5]) AS h) b ON x BETWEEN bx AND bx + w - 1 AND y BETWEEN bt AND bt + h - 1 GROUP BY img, box_id, w, h")
def ras_crops(spark: SparkSession, d: str) -> DataFrame:
    flat = pixels(spark, d).groupBy("img").agg(F.transform(F.array_sort(F.collect_list(F.struct("y", "x", "v"))), lambda s: s["v"]).alias("px")).withColumns({"w": F.lit(8), "h": F.lit(8)})
    box = lambda k, x, y, w, h: F.struct(*(F.lit(v).alias(n) for n, v in zip(("box_id", "x", "y", "w", "h"), (k, x, y, w, h))))
    return B.crops(flat, flat.select("img", F.inline(F.array(box(1, 1, 1, 4, 3), box(2, 4, 3, 4, 5)))))


@query(f"{_PX} SELECT img, x - 1 AS x, y - 2 AS y, CASE WHEN x + 0.5 < 6 AND x - 1 + 0.5 > y - 2 + 0.5 THEN v ELSE 255 END AS v FROM px WHERE x >= 1 AND x < 6 AND y >= 2 AND y < 7 AND x - 1 <> y - 2")
def ras_clipped(spark: SparkSession, d: str) -> DataFrame:
    """A triangle cut out of every grid (without the pixels on its slope, whose middle lies on it)."""
    px = pixels(spark, d)
    corner = lambda x, y: F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"))
    return G.clipped(px, px.select("img").distinct().withColumn("points", F.array(corner(1, 2), corner(6, 2), corner(6, 7)))).where("x <> y")


@query()
def mdl_inputs(spark: SparkSession, d: str) -> DataFrame:
    """Shape and sum of each grid as the input of every model, the model passing it on."""
    flat = pixels(spark, d).groupBy("img").agg(F.transform(F.array_sort(F.collect_list(F.struct("y", "x", "v"))), lambda s: s["v"] * 65793).alias("px")).withColumns({"w": F.lit(8), "h": F.lit(8)})
    kinds = {"detector": lambda a: M.letterboxed(a, 32), "text": lambda a: M.text_input(a, 16, 8), "line": lambda a: M.line_input(a, 12, 20), "formula": lambda a: M.stretched(a, 12), "angle": lambda a: M.oriented_input(a, 16, 12), "patch": lambda a: M.patch_input(a, 16)}
    parts = [M.inferred(flat, prepare, lambda: lambda x: x).select("img", F.lit(kind).alias("kind"), "shape", F.round(F.aggregate("data", F.lit(0.0), lambda s, v: s + v.cast("double")), 3).alias("total")) for kind, prepare in kinds.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(
    f"""{_PX}, ct AS (SELECT img, y // 4 AS ty, x // 4 AS tx, v, count(*) AS n FROM px GROUP BY ALL), tl AS (SELECT img, y // 4 AS ty, x // 4 AS tx, count(*) AS size, (min(y) + max(y) + 1) / 2.0::DOUBLE AS cy, (min(x) + max(x) + 1) / 2.0::DOUBLE AS cx FROM px GROUP BY ALL),
lv AS (SELECT tl.*, g.v, coalesce(ct.n, 0) AS n, floor(size * 40 / 256) AS most FROM tl CROSS JOIN (SELECT unnest(range(256)) AS v) g LEFT JOIN ct ON ct.img = tl.img AND ct.ty = tl.ty AND ct.tx = tl.tx AND ct.v = g.v),
sp AS (SELECT *, floor(sum(greatest(n - most, 0)) OVER (PARTITION BY img, ty, tx) / 256) AS more FROM lv), mp AS (SELECT *, sum(least(n, most) + more) OVER (PARTITION BY img, ty, tx ORDER BY v) / size AS share FROM sp),
nb AS (SELECT px.img, y, x, share, 1 / greatest(sqrt((y - cy) * (y - cy) + (x - cx) * (x - cx)), 1.0::DOUBLE) AS d FROM px JOIN mp ON mp.img = px.img AND mp.v = px.v AND abs(mp.ty - y // 4) <= 1 AND abs(mp.tx - x // 4) <= 1)
SELECT img, y, x, round(least(255, greatest(0, sum(share * d) / sum(d) * 255)), 6) AS v FROM nb GROUP BY img, y, x"""
)
def ras_clahe(spark: SparkSession, d: str) -> DataFrame:
    return R.clahe(pixels(spark, d))


@query()
def ras_contours(spark: SparkSession, d: str) -> DataFrame:
    masks = pixels(spark, d).groupBy("img").agg(F.transform(F.array_sort(F.collect_list(F.struct("y", "x", (F.col("v") > 140).cast("int").alias("m")))), lambda s: s["m"]).alias("px"))
    return R.contours(masks.select("img", F.lit(8).alias("w"), F.lit(8).alias("h"), "px")).select("img", "contour", F.size("points").alias("points"))


@query(
    f"""{_PX}, bx AS (SELECT DISTINCT img, unnest([1, 2]) AS box_id, unnest([1, 4]) AS x, unnest([1, 3]) AS y, unnest([4, 4]) AS w, unnest([3, 5]) AS h FROM px)
SELECT b.img, b.box_id, coalesce(round(avg(p.v / 255.0::DOUBLE), 6), 0) AS score FROM bx b LEFT JOIN (SELECT * FROM px WHERE v > 120) p ON p.img = b.img AND p.x BETWEEN b.x AND b.x + b.w - 1 AND p.y BETWEEN b.y AND b.y + b.h - 1 GROUP BY b.img, b.box_id"""
)
def ras_box_scores(spark: SparkSession, d: str) -> DataFrame:
    px = pixels(spark, d)
    box = lambda k, x, y, w, h: F.struct(*(F.lit(v).alias(n) for n, v in zip(("box_id", "x", "y", "w", "h"), (k, x, y, w, h))))
    boxes = px.select("img").distinct().select("img", F.inline(F.array(box(1, 1, 1, 4, 3), box(2, 4, 3, 4, 5))))
    return R.box_scores(boxes, px.withColumn("p", F.col("v") / 255.0), px.where("v > 120").select("img", "y", "x")).withColumn("score", F.round("score", 6))


@query(f"{_PX} SELECT img AS stroke, y * 8 + x AS t, coalesce((lag(x * 4 + v) OVER q + (x * 4 + v)) / 2.0, x * 4 + v)::DOUBLE AS x, coalesce((lag(y) OVER q + y) / 2.0, y)::DOUBLE AS y FROM px WINDOW q AS (PARTITION BY img ORDER BY y * 8 + x)")
def ras_smoothed(spark: SparkSession, d: str) -> DataFrame:
    p = pixels(spark, d).select(F.col("img").alias("stroke"), (F.col("y") * 8 + F.col("x")).alias("t"), (F.col("x") * 4 + F.col("v")).alias("x"), "y")
    return R.smooth_strokes(p)


# A place of the larger grid lies between two rows and two columns of the smaller one; the three colours are the same here.
_BETWEEN = "SELECT k, greatest(least((k + 0.5::DOUBLE) / 2 - 0.5, 7), 0) AS pos FROM (SELECT unnest(range(16)) AS k)"


@query(
    f"""{_PX}, pl AS (SELECT k, pos, floor(pos)::INT AS a, least(floor(pos)::INT + 1, 7) AS b, pos - floor(pos) AS f FROM ({_BETWEEN})), wt AS (SELECT a AS p, sum(1 - f) AS s FROM pl GROUP BY a UNION ALL SELECT b, sum(f) FROM pl GROUP BY b), ws AS (SELECT p, sum(s) AS s FROM wt GROUP BY p)
SELECT img, 768 AS n, round(sum(v / 255.0::DOUBLE * r.s * c.s) * (1 / 0.229::DOUBLE + 1 / 0.224::DOUBLE + 1 / 0.225::DOUBLE) - 256 * (0.485::DOUBLE / 0.229::DOUBLE + 0.456::DOUBLE / 0.224::DOUBLE + 0.406::DOUBLE / 0.225::DOUBLE), 1) AS total
FROM px JOIN ws r ON r.p = y JOIN ws c ON c.p = x GROUP BY img"""
)
def ras_tensor(spark: SparkSession, d: str) -> DataFrame:
    """Sum of the normalised 16 by 16 tensor of every grid."""
    px = pixels(spark, d).groupBy("img").agg(F.transform(F.array_sort(F.collect_list(F.struct("y", "x", "v"))), lambda s: s["v"] * 65793).alias("px"))
    t = R.tensors(px.select("img", F.lit(8).alias("w"), F.lit(8).alias("h"), "px"), 16, R.IMAGENET_MEAN, R.IMAGENET_STD)
    return t.select("img", F.size("data").alias("n"), F.round(F.aggregate("data", F.lit(0.0), lambda s, v: s + v.cast("double")), 1).alias("total"))
