"""Detection queries: decoding, suppression, merging, splitting, reading order, geometry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions import geometry as G
from pagemill.operators import boxes as B
from pagemill.operators import rasters as R
from pagemill.plans.fixtures import ctes, view
from pagemill.plans.fixtures import sql as box_sql
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


_BOX = "img, box_id, x, y, w, h, conf"
# A fold over the boxes of an image in DuckDB: lists of one box are reduced to the list of kept ones.
_FOLD = """{cte}, l AS (SELECT img, list({{'x': x, 'y': y, 'w': w, 'h': h, 'conf': conf, 'box_id': box_id}} ORDER BY {order}) AS bs FROM boxes {where} GROUP BY img),
k AS (SELECT img, unnest(list_reduce(list_transform(bs, lambda b: [b]), lambda acc, c: CASE WHEN len(list_filter(acc, lambda k: {clash})) > 0 THEN acc ELSE list_concat(acc, c) END)) AS b FROM l)
SELECT img, b.x AS x, b.y AS y, b.w AS w, b.h AS h, b.conf AS conf, b.box_id AS box_id FROM k"""
_COMMON = "(greatest(least(k.x + k.w, c[1].x + c[1].w) - greatest(k.x, c[1].x), 0) * greatest(least(k.y + k.h, c[1].y + c[1].h) - greatest(k.y, c[1].y), 0))"


@query(f"{ctes('boxes')} SELECT {_BOX} FROM boxes WHERE conf >= 0.25")
def det_confident(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "boxes").where(F.col("conf") >= B.CONFIDENCE)


@query(_FOLD.format(cte=ctes("boxes"), order="-conf, box_id", where="WHERE conf >= 0.25", clash=f"(k.w * k.h + c[1].w * c[1].h - {_COMMON} = 0) OR ({_COMMON} * 100 > 45 * (k.w * k.h + c[1].w * c[1].h - {_COMMON}))"))
def det_nms(spark: SparkSession, d: str) -> DataFrame:
    return B.suppress(det_confident(spark, d))


@query(_FOLD.format(cte=ctes("boxes"), order="y, x, box_id", where="", clash=f"{_COMMON} * 100 > greatest(c[1].w * c[1].h, 1) * 70"))
def det_uncovered(spark: SparkSession, d: str) -> DataFrame:
    return B.uncovered(view(spark, d, "boxes"))


@query(
    f"""{ctes("anchors")}, k AS (SELECT *, greatest(s0, s1) AS conf, CASE WHEN s0 >= s1 THEN 0 ELSE 1 END AS cls,
least(greatest(floor((cx - bw / 2 - pad_x) / scale), 0), orig_w) AS x0, least(greatest(floor((cy - bh / 2 - pad_y) / scale), 0), orig_h) AS y0,
least(greatest(ceil((cx + bw / 2 - pad_x) / scale), 0), orig_w) AS x1, least(greatest(ceil((cy + bh / 2 - pad_y) / scale), 0), orig_h) AS y1 FROM anchors WHERE greatest(s0, s1) >= 0.25)
SELECT img, anchor AS box_id, CAST(x0 AS INT) AS x, CAST(y0 AS INT) AS y, CAST(x1 - x0 AS INT) AS w, CAST(y1 - y0 AS INT) AS h, conf, cls, CASE WHEN cls = 0 THEN 'embedding' ELSE 'isolated' END AS label FROM k"""
)
def det_decode(spark: SparkSession, d: str) -> DataFrame:
    return B.decode_anchors(view(spark, d, "anchors"))


@query("SELECT CAST(label AS BIGINT) AS img, vec_id * 11 + a AS anchor, CAST(embedding[a + 1] AS DOUBLE) AS cx, CAST(coalesce(embedding[a + 56], 0) AS DOUBLE) AS s1 FROM embeddings, (SELECT unnest(range(11)) AS a) WHERE embedding IS NOT NULL AND vec_id IS NOT NULL")
def det_transpose(spark: SparkSession, d: str) -> DataFrame:
    """A vector, with two zeros behind it, as a channel-major output of 11 anchors."""
    flat = table(spark, d, "embeddings").where("embedding is not null and vec_id is not null").select(F.struct("vec_id", "label").alias("img"), F.concat("embedding", F.array(F.lit(0.0).cast("float"), F.lit(0.0).cast("float"))).alias("data"))
    rows = B.anchor_rows(flat)
    return rows.select(F.col("img.label").cast("bigint").alias("img"), (F.col("img.vec_id") * 11 + F.col("anchor")).alias("anchor"), F.col("v")[0].cast("double").alias("cx"), F.col("v")[5].cast("double").alias("s1"))


@query(f"{ctes('boxes')} SELECT img, box_id, CAST(row_number() OVER (PARTITION BY img ORDER BY y, x, box_id) AS INT) AS pos FROM boxes")
def det_reading_order(spark: SparkSession, d: str) -> DataFrame:
    return B.reading_order(view(spark, d, "boxes")).select("img", "box_id", "pos")


@query(f"{ctes('boxes')} SELECT img, box_id, CAST(row_number() OVER (PARTITION BY img ORDER BY conf DESC, box_id) AS INT) AS rank FROM boxes")
def det_score_order(spark: SparkSession, d: str) -> DataFrame:
    return B.score_order(view(spark, d, "boxes")).select("img", "box_id", "rank")


@query(
    f"""{ctes("boxes")}, c AS (SELECT *, greatest(least(x + w, 400) - greatest(x, 300), 0) * greatest(least(y + h, 420) - greatest(y, 350), 0) AS i FROM boxes)
SELECT img, box_id, round(i::DOUBLE / nullif(w * h + 7000 - i, 0), 6) AS iou, round(i::DOUBLE / greatest(w * h, 1), 6) AS own FROM c"""
)
def det_overlaps(spark: SparkSession, d: str) -> DataFrame:
    """Overlap of every box with the box (300, 350, 100, 70)."""
    a = F.struct("x", "y", "w", "h")
    fixed = F.struct(F.lit(300).alias("x"), F.lit(350).alias("y"), F.lit(100).alias("w"), F.lit(70).alias("h"))
    return view(spark, d, "boxes").select("img", "box_id", F.round(B.iou(a, fixed), 6).alias("iou"), F.round(B.own_overlap(a, fixed), 6).alias("own"))


@query(f"{ctes('boxes')} SELECT img, min(x) AS x, min(y) AS y, max(x) - min(x) AS w, max(y) - min(y) AS h FROM boxes GROUP BY img")
def det_bounds(spark: SparkSession, d: str) -> DataFrame:
    return B.bounding(view(spark, d, "boxes"), "img")


@query(f"{ctes('boxes')} SELECT img, box_id, CAST(w * h AS DOUBLE) AS area, CAST(2 * (w + h) AS DOUBLE) AS perimeter FROM boxes")
def det_rings(spark: SparkSession, d: str) -> DataFrame:
    """Area and length of the outline of every box, taken as a ring of its corners."""
    p = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    x0, y0, x1, y1 = F.col("x"), F.col("y"), F.col("x") + F.col("w"), F.col("y") + F.col("h")
    return view(spark, d, "boxes").select("img", "box_id", F.inline(F.array(B.ring_metrics(F.array(p(x0, y0), p(x1, y0), p(x1, y1), p(x0, y1))))))


@query(
    f"""{ctes("boxes")}, u AS (SELECT *, (w * h) * 1.6::DOUBLE / (2 * (w + h)) AS grow FROM boxes)
SELECT img, box_id, greatest(CAST(floor((x - grow) / 0.75::DOUBLE + 0.5) AS INT), 0) AS gx, greatest(CAST(floor((y - grow) / 0.75::DOUBLE + 0.5) AS INT), 0) AS gy,
CAST(floor((w + grow * 2) / 0.75::DOUBLE + 0.5) AS INT) AS gw, greatest(CAST(floor((h + grow * 2) / 0.75::DOUBLE + 0.5) AS INT), 8) AS gh FROM u"""
)
def det_unclipped(spark: SparkSession, d: str) -> DataFrame:
    by = B.unclip((F.col("w") * F.col("h")).cast("double"), (F.col("w") + F.col("h")) * 2)
    g = B.grown(F.col("x"), F.col("y"), F.col("w"), F.col("h"), by, F.lit(0.75))
    return view(spark, d, "boxes").select("img", "box_id", g.alias("g")).select("img", "box_id", F.col("g.x").alias("gx"), F.col("g.y").alias("gy"), F.col("g.w").alias("gw"), F.col("g.h").alias("gh"))


@query(f"{ctes('boxes')} SELECT img, box_id FROM boxes WHERE w * h >= 4 AND 2 * (w + h) >= 0.5 AND conf >= 0.5 AND w > 4 AND h > 4")
def det_kept(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "boxes").where(B.worth_keeping(F.col("w") * F.col("h"), (F.col("w") + F.col("h")) * 2, F.col("conf"), F.col("w"), F.col("h"), F.lit(4))).select("img", "box_id")


@query(f"{ctes('boxes')} SELECT img, box_id, greatest(x - 40, 0) AS cx, greatest(y - 40, 0) AS cy, greatest(least(w, 640 - greatest(x - 40, 0)), 1) AS cw, greatest(least(h, 480 - greatest(y - 40, 0)), 1) AS ch FROM boxes")
def det_clamped(spark: SparkSession, d: str) -> DataFrame:
    """Boxes moved up and left by 40 and clamped to an image of 640 by 480."""
    c = B.clamp_crop(F.col("x") - 40, F.col("y") - 40, F.col("w"), F.col("h"), F.lit(640), F.lit(480))
    return view(spark, d, "boxes").select("img", "box_id", c.alias("c")).select("img", "box_id", F.col("c.x").alias("cx"), F.col("c.y").alias("cy"), F.col("c.w").alias("cw"), F.col("c.h").alias("ch"))


@query(f"{ctes('boxes')} SELECT img, box_id, h > w * CAST(0.8 AS DOUBLE) OR h > 100 AS tall FROM boxes")
def det_tall(spark: SparkSession, d: str) -> DataFrame:
    from pagemill.operators.history import tall_formula

    return view(spark, d, "boxes").select("img", "box_id", tall_formula(F.col("w"), F.col("h")).alias("tall"))


def _halves(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    b = view(spark, d, "boxes")
    return b.where("box_id % 3 <> 0"), b.where("box_id % 3 = 0")


_TEXTS, _FORMULAS = (f"{{n}} AS (SELECT * FROM boxes WHERE box_id % 3 {op} 0)" for op in ("<>", "="))
# Each formula on the height of a text box, from left to right, cuts the first text segment that it meets.
_MEETS = "NOT s.f AND c[1].x < s.x + s.w AND c[1].x + c[1].w > s.x"
_SEGMENTS = f"""{ctes("boxes")}, {_TEXTS.format(n="tx")}, {_FORMULAS.format(n="fm")},
on_h AS (SELECT tx.img, tx.box_id, any_value(tx.x) AS x, any_value(tx.w) AS w, list({{'x': fm.x, 'w': fm.w, 'f': true}} ORDER BY fm.x, fm.box_id) FILTER (fm.box_id IS NOT NULL) AS fs
FROM tx LEFT JOIN fm ON fm.img = tx.img AND fm.y < tx.y + tx.h AND fm.y + fm.h > tx.y GROUP BY tx.img, tx.box_id),
cut AS (SELECT img, box_id, list_reduce(list_concat([[{{'x': x, 'w': w, 'f': false}}]], list_transform(coalesce(fs, []), lambda g: [g])), lambda acc, c: CASE WHEN len(list_filter(acc, lambda s: {_MEETS})) = 0 THEN acc
ELSE flatten(list_transform(acc, lambda s, i: CASE WHEN i = list_position(list_transform(acc, lambda s: {_MEETS}), true)
THEN list_filter([{{'x': s.x, 'w': c[1].x - s.x, 'f': false}}, {{'x': c[1].x, 'w': c[1].w, 'f': true}}, {{'x': c[1].x + c[1].w, 'w': s.x + s.w - (c[1].x + c[1].w), 'f': false}}], lambda q: q.f OR q.w > 6) ELSE [s] END)) END) AS parts FROM on_h),
seg AS (SELECT img, box_id, unnest(range(len(parts)))::INT AS pos, unnest(parts) AS s FROM cut)"""


@query(f"{_SEGMENTS} SELECT img, box_id, pos, s.x AS x, s.w AS w, s.f AS is_formula FROM seg")
def det_split(spark: SparkSession, d: str) -> DataFrame:
    return B.split_by_formulas(*_halves(spark, d))


_JOINS = "abs((g.y + g.h / 2.0::DOUBLE) - (c[1].y + c[1].h / 2.0::DOUBLE)) < (g.h + c[1].h) / 4.0::DOUBLE AND c[1].x - (g.x + g.w) < (g.h + c[1].h) / 2.0::DOUBLE * 1.2::DOUBLE"


@query(
    f"""{ctes("boxes")}, l AS (SELECT img, list({{'x': x, 'y': y, 'w': w, 'h': h, 'conf': conf, 'box_id': box_id}} ORDER BY y, x, box_id) AS bs FROM boxes GROUP BY img),
k AS (SELECT img, unnest(list_reduce(list_transform(bs, lambda b: [b]), lambda acc, c: CASE WHEN len(list_filter(acc, lambda g: {_JOINS})) = 0 THEN list_concat(acc, c)
ELSE list_transform(acc, lambda g, i: CASE WHEN i = list_position(list_transform(acc, lambda g: {_JOINS}), true)
THEN {{'x': least(g.x, c[1].x), 'y': least(g.y, c[1].y), 'w': greatest(g.x + g.w, c[1].x + c[1].w) - least(g.x, c[1].x), 'h': greatest(g.y + g.h, c[1].y + c[1].h) - least(g.y, c[1].y), 'conf': greatest(g.conf, c[1].conf), 'box_id': g.box_id}} ELSE g END) END)) AS b FROM l)
SELECT img, b.x AS x, b.y AS y, b.w AS w, b.h AS h, b.conf AS conf, b.box_id AS box_id FROM k"""
)
def det_merged_rows(spark: SparkSession, d: str) -> DataFrame:
    return B.merge_rows(view(spark, d, "boxes"))


_TOUCH = "bs[p // 1000].x < bs[p % 1000].x + bs[p % 1000].w AND bs[p % 1000].x < bs[p // 1000].x + bs[p // 1000].w AND bs[p // 1000].y < bs[p % 1000].y + bs[p % 1000].h AND bs[p % 1000].y < bs[p // 1000].y + bs[p // 1000].h"
# Round after round the first two boxes that overlap (numbered i * 1000 + j) become one.
_A, _B = "bs[pr // 1000]", "bs[pr % 1000]"
_ONE = f"{{'x': least({_A}.x, {_B}.x), 'y': least({_A}.y, {_B}.y), 'w': greatest({_A}.x + {_A}.w, {_B}.x + {_B}.w) - least({_A}.x, {_B}.x), 'h': greatest({_A}.y + {_A}.h, {_B}.y + {_B}.h) - least({_A}.y, {_B}.y), 'conf': greatest({_A}.conf, {_B}.conf), 'box_id': {_A}.box_id}}"
_NEXT = f"list_filter(flatten(list_transform(range(1, len(bs)), lambda i: list_transform(range(i + 1, len(bs) + 1), lambda j: i * 1000 + j))), lambda p: {_TOUCH})[1] AS pr"


@query(
    f"""WITH RECURSIVE boxes AS {box_sql("boxes")}, l AS (SELECT img, list({{'x': x, 'y': y, 'w': w, 'h': h, 'conf': conf, 'box_id': box_id}} ORDER BY y, x, box_id) AS bs FROM boxes GROUP BY img),
r AS (SELECT img, bs, {_NEXT} FROM l UNION ALL SELECT img, bs, {_NEXT} FROM (SELECT img, list_concat(bs[:pr // 1000 - 1], [{_ONE}], bs[pr // 1000 + 1:pr % 1000 - 1], bs[pr % 1000 + 1:]) AS bs FROM r WHERE pr IS NOT NULL))
SELECT img, b.x AS x, b.y AS y, b.w AS w, b.h AS h, b.conf AS conf, b.box_id AS box_id FROM (SELECT img, unnest(bs) AS b FROM r WHERE pr IS NULL)"""
)
def det_merged_overlaps(spark: SparkSession, d: str) -> DataFrame:
    return B.merge_overlapping(view(spark, d, "boxes"))


@query(
    f"""{_SEGMENTS}, l AS (SELECT img, list({{'x': x, 'y': y, 'w': w, 'h': h, 'box_id': box_id}} ORDER BY y, x, box_id) AS bs FROM fm GROUP BY img),
k AS (SELECT img, unnest(list_reduce(list_transform(bs, lambda b: [b]), lambda acc, c: CASE WHEN len(list_filter(acc, lambda k: {_COMMON} * 100 > greatest(c[1].w * c[1].h, 1) * 70)) > 0 THEN acc ELSE list_concat(acc, c) END)) AS b FROM l)
SELECT img, box_id, s.x AS x, s.w AS w, 'text' AS kind FROM seg WHERE NOT s.f UNION ALL SELECT img, b.box_id, b.x, b.w, 'formula' FROM k"""
)
def det_mixed(spark: SparkSession, d: str) -> DataFrame:
    """Segments of the text boxes together with the formulas that no other one covers."""
    texts, formulas = _halves(spark, d)
    seg = B.split_by_formulas(texts, formulas).where("not is_formula").select("img", "box_id", "x", "w", F.lit("text").alias("kind"))
    return seg.unionByName(B.uncovered(formulas).select("img", "box_id", "x", "w", F.lit("formula").alias("kind")))


@query(
    f"""{_SEGMENTS}, ex AS (SELECT seg.img, list({{'x': s.x, 'y': b.y, 'w': s.w, 'h': b.h, 'box_id': -1::BIGINT}}) AS ks FROM seg JOIN boxes b ON b.box_id = seg.box_id WHERE s.f GROUP BY seg.img),
l AS (SELECT fm.img, any_value(ks) AS ks, list({{'x': x, 'y': y, 'w': w, 'h': h, 'box_id': box_id}} ORDER BY y, x, box_id) AS bs FROM fm LEFT JOIN ex ON ex.img = fm.img GROUP BY fm.img),
k AS (SELECT img, unnest(list_reduce(list_transform(bs, lambda b: [b]), lambda acc, c: CASE WHEN len(list_filter(acc, lambda k: {_COMMON} * 100 > greatest(c[1].w * c[1].h, 1) * 70)) > 0 THEN acc ELSE list_concat(acc, c) END, coalesce(ks, []))) AS b FROM l)
SELECT img, b.box_id AS box_id FROM k WHERE b.box_id >= 0"""
)
def det_left_over(spark: SparkSession, d: str) -> DataFrame:
    """Formulas that neither a formula segment of a text box nor an earlier formula covers."""
    texts, formulas = _halves(spark, d)
    found = B.split_by_formulas(texts, formulas).where("is_formula").select("img", "box_id", "x", "w")
    return B.uncovered(formulas, existing=found.join(texts.select("img", "box_id", "y", "h"), ["img", "box_id"])).select("img", "box_id")


_UNITE = "CASE WHEN c[1].y - (p.y + p.h) <= 0 THEN NOT (c[1].x + c[1].w < p.x OR p.x + p.w < c[1].x) ELSE c[1].y - (p.y + p.h) <= 80 AND least(p.x + p.w, c[1].x + c[1].w) > greatest(p.x, c[1].x) AND (least(p.x + p.w, c[1].x + c[1].w) - greatest(p.x, c[1].x)) * 100 >= least(p.w, c[1].w) * 30 AND (p.w < 300 OR p.h < 20 OR c[1].w < 300 OR c[1].h < 20) AND c[1].cols >= 2 END"


@query(
    f"""{ctes("boxes")}, l AS (SELECT img, list({{'x': x, 'y': y, 'w': w * 4, 'h': h, 'cols': CAST(box_id % 4 AS INT)}} ORDER BY y, x, w, h, box_id % 4) AS bs FROM boxes WHERE w * 4 >= 40 AND h >= 15 GROUP BY img),
k AS (SELECT img, unnest(list_reduce(list_transform(bs, lambda b: [b]), lambda acc, c: CASE WHEN len(list_filter(acc[-1:], lambda p: {_UNITE})) = 0 THEN list_concat(acc, c)
ELSE list_concat(acc[:-2], list_transform(acc[-1:], lambda p: {{'x': least(p.x, c[1].x), 'y': p.y, 'w': greatest(p.x + p.w, c[1].x + c[1].w) - least(p.x, c[1].x), 'h': greatest(p.y + p.h, c[1].y + c[1].h) - p.y, 'cols': 0}})) END)) AS b FROM l)
SELECT img, b.x AS x, b.y AS y, b.w AS w, b.h AS h FROM k"""
)
def det_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Boxes, made wider, as blocks of content."""
    return B.merge_blocks(view(spark, d, "boxes").withColumns({"w": F.col("w") * 4, "cols": (F.col("box_id") % 4).cast("int")}))


@query(f"{ctes('boxes')} SELECT img, greatest(min(x) - 20, 0) AS x, greatest(min(y) - 20, 0) AS y, least(700, max(x) - min(x) + 40) AS w, least(900, max(y) - min(y) + 40) AS h FROM boxes GROUP BY img")
def det_padded(spark: SparkSession, d: str) -> DataFrame:
    """Corners of boxes as ink on a canvas of 700 by 900."""
    b = view(spark, d, "boxes")
    return B.padded_bounds(b.select("img", "x", "y"), b.select("img").distinct().withColumns({"w": F.lit(700), "h": F.lit(900)}))


@query(f"{ctes('sizes')} SELECT img, CASE WHEN w > h THEN h ELSE w END AS w, CASE WHEN w > h THEN w ELSE h END AS h, CASE WHEN w > h THEN 90 ELSE 0 END AS degrees FROM sizes")
def geo_capture(spark: SparkSession, d: str) -> DataFrame:
    """Camera pictures on a standing screen."""
    return view(spark, d, "sizes").select("img", F.inline(F.array(B.capture_size(F.col("w"), F.col("h"), F.lit(400), F.lit(800)))))


@query(f"{ctes('sizes')} SELECT img, round((2 * w + 3) / (w * 0.001::DOUBLE + 1), 6) AS px, round((h - w) / (w * 0.001::DOUBLE + 1), 6) AS py FROM sizes")
def geo_applied(spark: SparkSession, d: str) -> DataFrame:
    """The far corner of every image under one matrix."""
    m = F.array(*(F.lit(float(v)) for v in (2, 0, 3, -1, 1, 0, 0.001, 0, 1)))
    at = G.apply_homography(m, F.col("w").cast("double"), F.col("h").cast("double"))
    return view(spark, d, "sizes").select("img", at.alias("p")).select("img", F.round("p.x", 6).alias("px"), F.round("p.y", 6).alias("py"))


def _regions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "regions").where("region_id is not null and img is not null").dropDuplicates(["region_id"])


_FITS = "(least(ln[1].y + ln[1].h, c[1][1].y + c[1][1].h) - greatest(ln[1].y, c[1][1].y)) * 100 >= greatest(least(ln[1].h, c[1][1].h), 1) * 45"
# Every region joins the first line whose leftmost member it overlaps; the line is then put in order again.
_GROUPED = f"""WITH rg AS (SELECT DISTINCT ON (region_id) * FROM regions WHERE region_id IS NOT NULL AND img IS NOT NULL {{where}}),
l AS (SELECT img, list([{{{{'x': x, 'y': y, 'id': region_id, 'h': h}}}}] ORDER BY y, x, region_id) AS rs FROM rg GROUP BY img),
k AS (SELECT img, list_reduce(list_transform(rs, lambda r: [r]), lambda acc, c: CASE WHEN len(list_filter(acc, lambda ln: {_FITS})) = 0 THEN list_concat(acc, c)
ELSE list_transform(acc, lambda ln, i: CASE WHEN i = list_position(list_transform(acc, lambda ln: {_FITS}), true) THEN list_sort(list_concat(ln, c[1])) ELSE ln END) END) AS lns FROM l),
u AS (SELECT img, unnest(range(len(lns)))::INT AS line, unnest(lns) AS members FROM k),
m AS (SELECT img, line, unnest(range(len(members)))::INT AS pos, unnest(members).id AS region_id FROM u)"""
_TRIMMED = r"regexp_replace({t}, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g')"


@query(f"{_GROUPED.format(where='')} SELECT img, line, pos, region_id FROM m")
def layout_lines(spark: SparkSession, d: str) -> DataFrame:
    return B.group_lines(_regions(spark, d))


@query(
    f"""{_GROUPED.format(where='AND text IS NOT NULL')}, b AS (SELECT m.img, line, pos, CASE WHEN type = 'formula' THEN '$$' || chr(10) || text || chr(10) || '$$' ELSE text END AS alone,
CASE WHEN type = 'formula' THEN '$$' || chr(10) || text || chr(10) || '$$ ' ELSE nullif({_TRIMMED.format(t='text')}, '') END AS body FROM m JOIN rg ON rg.region_id = m.region_id),
t AS (SELECT img, line, {_TRIMMED.format(t="coalesce(string_agg(body, ' ' ORDER BY pos), '')")} AS t, count(*) AS n, min(alone) AS alone FROM b GROUP BY img, line)
SELECT img, CASE WHEN sum(n) = 1 THEN min(alone) ELSE string_agg(t, chr(10) ORDER BY line) END AS text FROM t GROUP BY img"""
)
def layout_texts(spark: SparkSession, d: str) -> DataFrame:
    return B.layout_text(_regions(spark, d).where("text is not null"))


@query(
    f"""{ctes("sizes")}, s AS (SELECT *, least(768::DOUBLE / w, 768::DOUBLE / h) AS scale FROM sizes), n AS (SELECT *, floor(w * scale + 0.5) AS nw, floor(h * scale + 0.5) AS nh FROM s)
SELECT img, round(scale, 6) AS scale, CAST(floor((768 - nw) / 2 - CAST(0.1 AS DOUBLE) + 0.5) AS INT) AS pad_x, CAST(floor((768 - nh) / 2 - CAST(0.1 AS DOUBLE) + 0.5) AS INT) AS pad_y, CAST(nw AS INT) AS new_w, CAST(nh AS INT) AS new_h FROM n"""
)
def size_letterbox(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "sizes").select("img", F.inline(F.array(B.letterbox(F.col("w"), F.col("h"))))).withColumn("scale", F.round("scale", 6))


@query(
    f"""{ctes("sizes")}, s AS (SELECT *, least(1.0::DOUBLE, 960::DOUBLE / greatest(w, h)) AS scale FROM sizes), n AS (SELECT *, greatest(floor(w * scale + 0.5), 1) AS nw, greatest(floor(h * scale + 0.5), 1) AS nh FROM s)
SELECT img, round(scale, 6) AS scale, CAST(nw AS INT) AS new_w, CAST(nh AS INT) AS new_h, CAST(ceil(nw / 32) * 32 AS INT) AS pad_w, CAST(ceil(nh / 32) * 32 AS INT) AS pad_h FROM n"""
)
def size_limit_side(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "sizes").select("img", F.inline(F.array(R.limit_side(F.col("w"), F.col("h"))))).withColumn("scale", F.round("scale", 6))


@query(f"{ctes('sizes')} SELECT img, CAST(greatest(least(ceil(48::DOUBLE * w / h), 320), 4) AS INT) AS line_w FROM sizes")
def size_line_width(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "sizes").select("img", R.line_width(F.col("w"), F.col("h")).alias("line_w"))


@query(
    f"""{ctes("sizes")}, n AS (SELECT img, CAST(floor(w * (256::DOUBLE / least(w, h)) + 0.5) AS INT) AS new_w, CAST(floor(h * (256::DOUBLE / least(w, h)) + 0.5) AS INT) AS new_h FROM sizes)
SELECT img, new_w, new_h, CAST(floor((new_w - 224) / 2) AS INT) AS "left", CAST(floor((new_h - 224) / 2) AS INT) AS top FROM n"""
)
def size_centre_crop(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "sizes").select("img", F.inline(F.array(R.short_side_crop(F.col("w"), F.col("h")))))


@query(f"{ctes('sizes')} SELECT img, round(least(64::DOUBLE / w, 64::DOUBLE / h), 6) AS scale, CAST(floor(w * least(64::DOUBLE / w, 64::DOUBLE / h) + 0.5) AS INT) AS new_w, CAST(floor(h * least(64::DOUBLE / w, 64::DOUBLE / h) + 0.5) AS INT) AS new_h FROM sizes")
def size_patch(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "sizes").select("img", F.inline(F.array(R.patch_fit(F.col("w"), F.col("h"))))).withColumn("scale", F.round("scale", 6))


@query(
    f"""{ctes("sizes")} SELECT img, CAST(ceil(round(w * abs(cos(radians(deg))) + h * abs(sin(radians(deg))), 6)) AS INT) AS w, CAST(ceil(round(w * abs(sin(radians(deg))) + h * abs(cos(radians(deg))), 6)) AS INT) AS h FROM sizes"""
)
def geo_rotated(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "sizes").select("img", F.inline(F.array(G.rotated_canvas(F.col("w"), F.col("h"), F.col("deg")))))


@query(f"{ctes('sizes')} SELECT img, CASE code WHEN 3 THEN 180 WHEN 4 THEN 180 WHEN 5 THEN 90 WHEN 6 THEN 90 WHEN 7 THEN 270 WHEN 8 THEN 270 ELSE 0 END AS degrees, code IN (2, 4, 5, 7) AS mirrored FROM sizes")
def geo_orientation(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "sizes").select("img", F.inline(F.array(G.orientation(F.col("code")))))


@query(f"{ctes('sizes')} SELECT img, w > 1000 AND w < 3000 AND h > 500 AND h < 2000 AS inside FROM sizes WHERE w NOT IN (1000, 3000) AND h NOT IN (500, 2000)")
def geo_in_quad(spark: SparkSession, d: str) -> DataFrame:
    """Whether the far corner of every image lies in a fixed rectangle."""
    quad = F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((1000, 500), (3000, 500), (3000, 2000), (1000, 2000))))
    rows = view(spark, d, "sizes").where("w not in (1000, 3000) and h not in (500, 2000)")
    return rows.select("img", G.in_polygon(F.col("w").cast("double"), F.col("h").cast("double"), quad).alias("inside"))


@query(f"{ctes('sizes')} SELECT img, CASE WHEN (w - 1000) * (w - 1000) + (h - 500) * (h - 500) < 6400 THEN 0 WHEN (w - 3000) * (w - 3000) + (h - 2000) * (h - 2000) < 6400 THEN 1 ELSE -1 END AS corner FROM sizes")
def geo_corner(spark: SparkSession, d: str) -> DataFrame:
    corners = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((1000, 500), (3000, 2000))))
    return view(spark, d, "sizes").select("img", G.corner_hit(F.col("w"), F.col("h"), corners, F.lit(4000)).alias("corner"))


@query(f"{ctes('sizes')} SELECT img, round(CASE WHEN code > 4 THEN (CASE WHEN code = 1 THEN 24 ELSE 3 END) * (0.3 + 0.7 * deg / 360) ELSE CASE WHEN code = 1 THEN 24 ELSE 3 END END, 6)::DOUBLE AS width FROM sizes")
def geo_stroke(spark: SparkSession, d: str) -> DataFrame:
    tool = F.when(F.col("code") == 1, "eraser").otherwise("pen")
    return view(spark, d, "sizes").select("img", F.round(G.stroke_width(tool, F.col("code") > 4, F.col("deg") / 360), 6).alias("width"))


@query(
    f"""{ctes("sizes")} SELECT img, CASE WHEN size > 500000 AND greatest(w, h) > 1920 THEN CAST(floor(w * (1920::DOUBLE / greatest(w, h)) + 0.5) AS INT) ELSE w END AS w,
CASE WHEN size > 500000 AND greatest(w, h) > 1920 THEN CAST(floor(h * (1920::DOUBLE / greatest(w, h)) + 0.5) AS INT) ELSE h END AS h FROM sizes"""
)
def geo_downscale(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "sizes").select("img", F.inline(F.array(G.downscaled(F.col("size"), F.col("w"), F.col("h")))))


@query(f"{ctes('sizes')} SELECT img, least(CAST(floor(size * CAST(70.0 AS DOUBLE) / 900000 + 0.5) AS INT), 90) AS percent, round(least(85::DOUBLE, deg / 4 + greatest(0.5::DOUBLE, (85 - deg / 4) * 0.12::DOUBLE)), 6) AS ramp, round(least(360::DOUBLE / w, 640::DOUBLE / h), 6) AS fit FROM sizes")
def geo_progress(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "sizes").select("img", G.wait_percent(F.col("size"), F.lit(900_000)).alias("percent"), F.round(G.next_progress(F.col("deg") / 4), 6).alias("ramp"), F.round(G.fit_scale(F.col("w"), F.col("h"), F.lit(360), F.lit(640)), 6).alias("fit"))


@query()
def geo_homography(spark: SparkSession, d: str) -> DataFrame:
    """Where the centre of a skewed quad of every image goes."""
    p = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    w, h = F.col("w"), F.col("h")
    quads = view(spark, d, "sizes").where("w > 8 and h > 8").select(F.col("img").alias("id"), F.array(p(w * 0.1, h * 0.05), p(w * 0.9, h * 0.1), p(w, h), p(F.lit(0), h * 0.95)).alias("corners"), "w", "h")
    return G.homographies(quads).where("m is not null").select("id", F.transform("m", lambda v: F.round(v, 6)).alias("m"))
