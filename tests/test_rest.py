"""Rasters, decoding, texts, records, sources and states on small cases worked out by hand or by loops."""

import random
import re

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagemill.functions import geometry as G
from pagemill.functions import text as T
from pagemill.operators import decode as D
from pagemill.operators import history as H
from pagemill.operators import models as M
from pagemill.operators import rasters as R
from pagemill.plans import texts
from pagemill.sources import inputs as I
from pagemill.streaming import buffers as S


def test_ink_bands(spark):
    rng = random.Random(4)
    rows, want = [], []
    for img in range(20):
        lo, low = -1, 0
        counts = [rng.choice([0, 0, 1, 5, 9]) for _ in range(40)]
        for y, n in enumerate(counts):
            rows.append((img, y, n))
            if lo < 0:
                if n >= 3:
                    lo, low = y, 0
            elif n < 3:
                low += 1
                if low >= 5:
                    want.append((img, lo, y - low))
                    lo, low = -1, 0
        if lo >= 0:
            want.append((img, lo, 39))
    got = R.ink_bands(spark.createDataFrame(rows, "img bigint, y int, n bigint"))
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_islands(spark):
    cases = {"0010": "0000", "01100": "00000", "0101": "0001", "111": "111", "10": "10", "": ""}
    df = spark.createDataFrame([(k, [int(c) for c in k]) for k in cases], "k string, a array<int>")
    got = dict(df.select("k", F.array_join(F.transform(R.remove_islands(F.col("a")), lambda v: v.cast("string")), "")).collect())
    assert got == cases


def test_contours_by_hand(spark):
    """A square of three from its first pixel on: down, then along the outline; a single pixel has none."""
    px = np.zeros((5, 6), int)
    px[1:4, 1:4] = 1
    px[0, 5] = 1
    df = spark.createDataFrame([(1, 6, 5, px.ravel().tolist()), (2, 2, 1, [1, 1]), (3, 4, 2, [1, 1, 0, 0, 0, 0, 0, 0])], "img bigint, w int, h int, px array<int>")
    got = [(r["img"], r["contour"], [(p["x"], p["y"]) for p in r["points"]]) for r in R.contours(df).orderBy("img", "contour").collect()]
    assert got[0] == (1, 0, [(1, 1), (1, 2), (1, 3), (2, 3), (3, 3), (3, 2), (3, 1), (2, 1)])
    # The pixel inside is on no outline yet, so it begins one of its own.
    assert got[1][0] == 1 and got[1][2][0] == (2, 2)
    # Two pixels: there and back until six points; in a raster of two, after two points, which are too few.
    assert got[2:] == [(3, 0, [(0, 0), (1, 0)] * 3)]


def test_inputs_of_models():
    flat = np.full((4, 8, 3), 50.0)
    box = M.letterboxed(flat, 16)
    assert box.shape == (16, 16, 3) and np.allclose(box[4:12], 50 / 255) and np.allclose(box[:4], 114 / 255) and np.allclose(box[12:], 114 / 255)
    text = M.text_input(np.dstack([np.full((5, 9), v) for v in (0, 128, 255)]), 960, 32)
    assert text.shape == (32, 32, 3) and np.allclose(text[0, 0], [1, (128 / 255 - 0.5) / 0.5, -1]) and np.allclose(text[5:], 1) and np.allclose(text[:, 9:], 1)
    line = M.line_input(flat, 8, 40)
    assert line.shape == (8, 40, 3) and np.allclose(line[:, 16:], -1) and np.allclose(line[:, :16], (50 / 255 - 0.5) / 0.5)
    assert M.line_input(np.zeros((4, 400, 3)), 8, 40).shape == (8, 40, 3) and np.allclose(M.stretched(flat, 6), 50 * 2 / 255 - 1)
    whole, fitted = M.oriented_input(flat, 8, 6), M.patch_input(flat, 8)
    want = (50 / 255 - np.array(R.IMAGENET_MEAN)) / R.IMAGENET_STD
    assert np.allclose(whole, want) and np.allclose(fitted[2:6], want) and np.allclose(fitted[:2], (1 - np.array(R.IMAGENET_MEAN)) / R.IMAGENET_STD)
    # Taller than the crop is wide: white at both sides.
    assert np.allclose(M.oriented_input(np.zeros((8, 8, 3)), 4, 6)[0], (1 - np.array(R.IMAGENET_MEAN)) / R.IMAGENET_STD)
    assert np.allclose(M.composed(flat, np.zeros((4, 8))), 255) and np.allclose(M.composed(flat, np.full((4, 8), 255)), 50)


def test_models_are_put_in(spark):
    rows = [(k, 4, 4, [k * 65793] * 16) for k in range(40)] + [(90, 4, 4, None), (91, 2, 2, [1])]
    images = spark.createDataFrame(rows, "img bigint, w int, h int, px array<int>")
    sizes = M.inferred(images, M.patch_input, lambda: lambda x: np.full((len(x), 1), len(x)), batch=8)
    got = {r["img"]: r for r in sizes.collect()}
    assert len(got) == 42 and got[90]["error"] == got[91]["error"] == "no pixels" and got[90]["data"] is None
    assert max(r["data"][0] for r in got.values() if r["data"]) <= 8 and got[3]["shape"] == [3, 64, 64]

    def broken(x):
        raise ValueError("no")

    assert {r["error"] for r in M.inferred(images, M.patch_input, lambda: broken).where("img < 40").collect()} == {"no"}
    assert {r["p"] for r in M.region_classifier(images, lambda: broken).collect()} == {0.5}
    assert {r["p"] for r in M.region_classifier(images, lambda: lambda x: np.zeros((len(x), 2))).collect()} == {0.5}
    turned = M.orientation(images, lambda: lambda x: np.tile([0, 0, 5, 0], (len(x), 1))).collect()
    assert {r["angle"] for r in turned} == {180} and len(turned) == 40
    steps = M.recogniser(images.where("img = 1"), lambda: lambda x: np.tile([0, 1, 0, 0, 0, 3], (len(x), 1)), 3).orderBy("t").collect()
    assert [(r["t"], r["id"], r["v"]) for r in steps] == [(0, 1, 1.0), (1, 2, 3.0)]
    assert M.formula_detector(images, lambda: lambda x: x.reshape(len(x), -1)[:, :12], 8).count() == 40
    assert M.encoder(images, lambda: lambda x: x[:, 0, 0, :5], 8).first()["state"] is not None
    assert M.text_detector(images, lambda: lambda x: x[:, 0]).select("w", "h").distinct().collect() == [(32, 32)]


def test_homography_without_exchanges():
    src, dst = np.array([[3, 1], [9, 2], [10, 8], [1, 7.0]]), np.array([[0, 0], [6, 0], [6, 5], [0, 5.0]])
    m = G.homography(src, dst)
    got = (m @ np.column_stack((src, np.ones(4))).T).T
    assert np.allclose(got[:, :2] / got[:, 2:], dst)
    assert G.homography(src, dst, strict_compat=True) is None and G.homography(src[[0, 0, 0, 0]], dst) is None


def test_resampling_keeps_flat_images():
    assert np.allclose(R.resampled(np.full((5, 7, 3), 9), 4, 6), 9)


def test_bands_and_parts_unite(spark):
    bands = spark.createDataFrame([(1, 0, 9, 0, 0.0, False), (1, 10, 20, 0, 0.0, False), (1, 30, 40, 5, 0.0, False), (1, 50, 60, 2, 0.3, True), (1, 70, 80, 1, 0.9, True), (1, 200, 210, 9, 1.0, True)], "img int, lo int, hi int, cols int, share double, fragment boolean")
    assert sorted((r["lo"], r["hi"]) for r in R.merge_bands(bands).collect()) == [(0, 60), (70, 80), (200, 210)]
    parts = spark.createDataFrame([(1, 0, 0, 20, 20, 1), (1, 40, 2, 20, 20, 1), (1, 100, 0, 20, 20, 1), (1, 125, 0, 20, 20, 0), (1, 150, 0, 20, 40, 0)], "img int, x int, y int, w int, h int, label int")
    assert [tuple(r)[1:] for r in R.merge_adjacent(parts).orderBy("x").collect()] == [(0, 0, 60, 22, 1), (100, 0, 20, 20, 1), (125, 0, 20, 20, 0), (150, 0, 20, 40, 0)]


@pytest.mark.parametrize("clip", [8.0, 40.0, 300.0])
def test_clahe(spark, clip):
    """Clipped counts over the pixels of the tile, centres of cut tiles where they are, a blend without rounding."""
    rng, tile, wide, high = random.Random(6), 4, 10, 7
    px = [[rng.choice([3, 90, 90, 90, 91, 200]) for _ in range(wide)] for _ in range(high)]
    maps = {}
    for y0 in range(0, high, tile):
        for x0 in range(0, wide, tile):
            y1, x1 = min(y0 + tile, high), min(x0 + tile, wide)
            inside = [px[y][x] for y in range(y0, y1) for x in range(x0, x1)]
            most = int(clip * len(inside) / 256)
            counts = [inside.count(v) for v in range(256)]
            spread = sum(max(n - most, 0) for n in counts) // 256
            counts = [min(n, most) + spread for n in counts]
            maps[y0 // tile, x0 // tile] = ((y0 + y1) / 2, (x0 + x1) / 2, [sum(counts[: v + 1]) / len(inside) for v in range(256)])
    rows = [(1, y, x, px[y][x]) for y in range(high) for x in range(wide)]
    got = {(r["y"], r["x"]): r["v"] for r in R.clahe(spark.createDataFrame(rows, "img int, y int, x int, v int"), tile, clip).collect()}
    for _, y, x, v in rows:
        near = [m for (ty, tx), m in maps.items() if abs(ty - y // tile) <= 1 and abs(tx - x // tile) <= 1]
        weights = [1 / max(1.0, ((y - cy) ** 2 + (x - cx) ** 2) ** 0.5) for cy, cx, _ in near]
        want = sum(share[v] * w for (_, _, share), w in zip(near, weights)) / sum(weights) * 255
        assert got[y, x] == pytest.approx(min(255.0, max(0.0, want)), abs=1e-5)


def test_otsu_default(spark):
    df = spark.createDataFrame([(1, 0, 0, 77)], "img bigint, y int, x int, v int")
    assert R.otsu(df).collect() == [(1, 128)]


def test_collapse(spark):
    df = spark.createDataFrame([(1, t, i, 0.5) for t, i in enumerate([3, 3, 0, 3, 6, 9, 1])], "box int, t int, id int, v double")
    symbols = spark.createDataFrame([(1, "a"), (3, "c")], "id int, ch string")
    assert D.label_text(D.collapse(df, "box"), symbols, 5, "box").collect() == [(1, "cc a", 0.5)]


def test_beam_search_is_exhaustive_on_small_trees():
    table = {(): [0.1, 0.6, 0.05, 0.25], (1,): [0.5, 0.2, 0.2, 0.1], (3,): [0.9, 0.02, 0.05, 0.03]}
    step = lambda ps: [[np.log(v) for v in table.get(tuple(p[1:]), [1.0, 1e-9, 1e-9, 1e-9])] for p in ps]
    tokens, conf = D.beam_search(step)
    assert tokens == [2, 1, 0] and conf == pytest.approx((0.6 * 0.5) ** 0.5)


@pytest.mark.parametrize(
    "raw, want",
    [
        (None, None),
        ("", ""),
        ("a}b", "ab"),
        (r"\frac{a", r"\frac {}{a}"),
        (r"\frac{a}", r"\frac{a} {}"),
        (r"\frac12", r"\frac12"),
        (r"\binom", r"\binom {} {}"),
        (r"\left( x", r"\left( x \right."),
        (r"\left( x \right) \right) \left[", r"\left( x \right) \right) \left[ \right."),
        (r"\begin{a}x\begin{b}y", "\\begin{a}x\\begin{b}y\n\\end{b}\n\\end{a}"),
        (r"\begin {cases*}x", "\\begin {cases*}x\n\\end{cases*}"),
        ("x\\\\\r\n", "x"),
        ("a\\\\ \\\\ ", "a"),
        (r"\{a\}", r"\{a\}"),
        (r"\{a}", r"\{a}"),
        (". .", ".."),
        (r"\frac{\frac{1}}{2}", r"\frac{\frac{1} {}}{2}"),
        (r"\frac{\frac{1}}", r"\frac{\frac{1}  {}{}}"),
    ],
)
def test_repair(raw, want):
    assert T.repair(raw) == want


@pytest.mark.parametrize("raw, want", [(r"\{a}", r"\{a"), (r"\frac{\frac{1}}", r"\frac{\frac{1} {}} {}"), (r"\frac{a", r"\frac{a}"), (r"\frac12", r"\frac12"), ("a\\\\ \\\\ ", "a")])
def test_repair_without_compat(raw, want):
    assert T.repair(raw, strict_compat=False) == want


@pytest.mark.parametrize("strict", [True, False])
@settings(max_examples=200, deadline=None)
@given(s=st.text(alphabet=r"\frac{}lebgindht ()$ax1", max_size=40))
def test_repair_balances(strict, s):
    depth = 0
    for piece in re.findall(r"[{}]" if strict else r"\\.|[{}]", T.repair(s, strict), re.S):
        depth += (piece == "{") - (piece == "}")
        assert depth >= 0
    assert depth == 0


def test_store_after_any_log(spark):
    """The folded store against one that is changed operation by operation."""
    rng = random.Random(31)
    start = [(k, f"x{k}", None if k % 7 == 0 else k % 2 == 0) for k in range(40)]
    ops, fresh = [], 100
    for seq in range(1, 400):
        op = rng.choices(["toggle", "delete", "clear", "insert", "other"], [60, 4, 2, 12, 3])[0]
        if op == "insert":
            fresh += 1
            ops.append((seq * 1000, op, fresh, rng.choice(["y", "y", "", None]), None))
        else:
            ops.append((seq * 1000, op, None if op == "clear" else rng.choice([None, rng.randrange(45), rng.randrange(100, fresh + 2)]), None, None))
    store = {k: bool(f) for k, _, f in start}
    for _, op, k, latex, _ in ops:
        if op == "toggle" and k in store:
            store[k] = not store[k]
        elif op == "delete":
            store.pop(k, None)
        elif op == "clear":
            store = {k: f for k, f in store.items() if f}
        elif op == "insert" and latex:
            store[k] = False
    rng.shuffle(ops)
    records = spark.createDataFrame(start, "id bigint, latex string, favorite boolean")
    log = spark.createDataFrame(ops, "seq bigint, op string, id bigint, latex string, favorite boolean")
    assert dict(H.current(records, log).select("id", "favorite").collect()) == store
    assert H.current(records, log.where("false").drop("latex")).count() == 40


def test_templates_are_filled_once(spark):
    row = spark.sql("select '{{a}}-{{b}}{{c}}' t, map('a', '{{b}}', 'b', 'x') m")
    assert row.select(T.fill_template(F.col("t"), F.col("m"))).first()[0] == "{{b}}-x{{c}}"


def test_small_strings(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(T.guard_repetition(F.lit("abcabcabcabcabcabcabcabc"))) == ""
    assert one(T.guard_repetition(F.lit("abcabcabc"))) == "abcabcabc"
    assert one(T.newer(F.lit("1.10"), F.lit("1.9.3"))) and not one(T.newer(F.lit("1.0"), F.lit("1")))
    assert one(T.newer(F.lit("1.2.3.4.5.6.7.8.9.2"), F.lit("1.2.3.4.5.6.7.8.9.1"))) and not one(T.newer(F.lit("1"), F.lit("1.0.0.0.0.0.0.0.0.1")))
    assert one(T.escape_json(F.lit('a"b\\\n'))) == 'a\\"b\\\\\\n' and one(T.escape_json(F.lit(None).cast("string"))) == ""
    assert one(T.aligned(F.array().cast("array<string>"))) == "" and one(T.aligned(F.array(F.lit("$$ a $$")))) == "a"
    assert one(T.read_int(F.lit(bytearray(b"\x01\x02")), 0, 2, True)) == 513


def test_guard_covers_whole_values(spark, tmp_path):
    def brute(t):
        return "" if len(t) > 20 and any(t[: 3 * n] == t[:n] * 3 for n in range(3, len(t) // 3 + 1)) else t

    rng = random.Random(4)
    unit = lambda n: "".join(rng.choice("ab{}") for _ in range(n))
    rows = [(k, unit(k % 45) * (k % 5) + unit(k % 7)) for k in range(400)] + [(3000, None), (3001, "x" * 70), (3002, "abc" * 6 + "ab"), (3003, "\\frac{a}{b}+\\sqrt{c}-dd" * 4)]
    spark.createDataFrame(rows, "id bigint, latex string").write.parquet(str(tmp_path / "history.parquet"))
    got = dict(texts.str_guarded(spark, str(tmp_path)).collect())
    assert got == {k: brute(t) for k, t in rows if t is not None}
    assert got[3003] == "" and max(map(len, got.values())) > 60


def test_exif():
    entry = b"\x01\x12\x00\x03\x00\x00\x00\x01\x00\x06\x00\x00"
    tiff = b"MM\x00*\x00\x00\x00\x08\x00\x01" + entry
    jpeg = b"\xff\xd8\xff\xe1" + (2 + 6 + len(tiff)).to_bytes(2, "big") + b"Exif\0\0" + tiff + b"\xff\xd9"
    assert I.orientation_of(jpeg) == 6
    for broken in (None, b"", b"\xff\xd8", jpeg[:20], b"GIF89a"):
        assert I.orientation_of(broken) == 1


def test_files_and_vocabulary(spark, tmp_path):
    (tmp_path / "a.JPG").write_bytes(b"x")
    (tmp_path / "b.txt").write_bytes(b"y")
    assert [r["name"] for r in I.accepted(I.files(spark, str(tmp_path))).select("name").collect()] == ["a.JPG"]
    broken = spark.createDataFrame([("no json",)], "value string")
    assert I.vocabulary(broken).count() == 3


def test_homography(spark):
    src, dst = np.array([[10, 20], [110, 30], [120, 140], [5, 120]], float), np.array([[0, 0], [100, 0], [100, 80], [0, 80]], float)
    m = G.homography(src, dst)
    for s, t in zip(src, dst):
        p = m @ np.append(s, 1)
        assert np.allclose(p[:2] / p[2], t)
    assert G.homography(np.zeros((4, 2)), dst) is None
    row = spark.range(1).select(G.apply_homography(F.array(*(F.lit(float(v)) for v in m.ravel())), F.lit(110.0), F.lit(30.0)).alias("p")).first()["p"]
    assert (row["x"], row["y"]) == pytest.approx((100, 0), abs=1e-6)
    assert G.warp(np.arange(12).reshape(3, 4), np.eye(3), 4, 3).tolist() == np.arange(12).reshape(3, 4).tolist()


def test_crop_bounds(spark):
    path = F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((5, 5), (50, 8), (60, 90), (-3, 70))))
    row = spark.range(1).select(G.crop_bounds(path, F.lit(100), F.lit(80)).alias("b"), G.crop_bounds(F.array().cast("array<struct<x:double,y:double>>"), F.lit(100), F.lit(80)).alias("whole")).first()
    assert tuple(row["b"]) == (0, 5, 60, 75) and tuple(row["whole"]) == (0, 0, 100, 80)


def test_ring_buffers():
    assert S.ring(["a", "b"], ["c"], 2) == ["b", "c"]
    assert S.drained("ab" * 20_000, "c" * 10_001) == "ab" * 15_000 + "c" * 10_001 and S.drained("a", "b") == "ab"


def test_undo(spark):
    ops = ["draw", "draw", "undo", "undo", "undo", "redo", "draw", "redo"]
    df = spark.createDataFrame([(1, k, o) for k, o in enumerate(ops)], "canvas int, seq int, op string")
    assert S.undo_state(df).collect() == [(1, 2, 0)]


def test_job_stream(spark, tmp_path):
    schema = "job_id string, kind string, result string, at timestamp"
    pd.DataFrame({"job_id": ["a", "b", "a"], "kind": ["text", "text", None], "result": [None, None, "ok"], "at": pd.to_datetime(["2024-01-01"] * 3)}).astype({"at": "datetime64[us]"}).to_parquet(tmp_path / "in.parquet")
    stream = spark.readStream.schema(schema).parquet(str(tmp_path))
    # Open timers ask for batches without data for ever; here the stream shall end with its input.
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    q = S.job_results(stream).writeStream.outputMode("append").format("memory").queryName("jobs").trigger(availableNow=True).start()
    try:
        assert q.awaitTermination(60)
    finally:
        q.stop()
        spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    assert spark.sql("select job_id, status, result, kind from jobs").collect() == [("a", "done", "ok", "text")]


def test_history_edges(spark):
    h = spark.createDataFrame([(1, "a", None, None, None, None, None), (2, "", 0.5, "formula", "pdf", True, None)], "id bigint, latex string, confidence double, type string, source string, favorite boolean, created_at timestamp")
    assert H.clear(h).select("id").collect() == [(2,)] and H.clear(h, False).count() == 0
    assert H.toggle(h, 1).where("id = 1").first()["favorite"] is True and H.toggle(h, 9).count() == 2
    assert H.insert(h, h.select("id", "latex", "confidence", "created_at")).count() == 3
    assert H.delete(h, 9).count() == 2
