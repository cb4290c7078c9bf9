"""Raster operators against NumPy and against their own invariants; sources, sinks and controls."""

import os
import struct
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.functions import scalar
from rasterloom.operators import bands, coverage, fusion, metrics, registration, stencil, tiles, weights
from rasterloom.plans import control, params, pictures, pipeline, stacking
from rasterloom.sources import discovery, sinks, tiff
from rasterloom.sources.rasters import Raster
from rasterloom.streaming.fold import SelectFold


def raster(spark, a):
    """frames x h x w as a raster of one column."""
    k, h, w = a.shape
    rows = [(f, y, x, float(a[f, y, x])) for f in range(k) for y in range(h) for x in range(w)]
    return Raster(spark.createDataFrame(rows, "frame_idx int, y int, x int, v double"), ("frame_idx",), w, h, ("v",))


def array(r, col="v"):
    rows = r.df.collect()
    out = np.full((max((q.frame_idx for q in rows), default=0) + 1, r.h, r.w), np.nan)
    for q in rows:
        out[q.frame_idx, q.y, q.x] = q[col]
    return out


@pytest.fixture(scope="module")
def noise():
    return np.random.default_rng(0).integers(0, 100, (2, 7, 9)).astype(float)


def test_box_sum_replicates_edges(spark, noise):
    p = np.pad(noise, [(0, 0), (2, 2), (2, 2)], mode="edge")
    want = sum(p[:, j : j + 7, i : i + 9] for j in range(5) for i in range(5))
    assert np.array_equal(array(stencil.box_sum(raster(spark, noise), 2)), want)


def test_tiles_equal_pixels(spark, noise):
    r = raster(spark, noise)
    want = array(stencil.box_sum(r, 2))
    rows = tiles.banded(tiles.to_rows(r, "v"), ("frame_idx",), 7, 2, tiles.box_kernel(2), band=3)
    assert np.allclose(array(tiles.to_pixels(rows, ("frame_idx",), 9, 7)), want)
    focus = tiles.focus_rows(tiles.to_rows(r, "v"), ("frame_idx",), 7, 1, band=3)
    assert np.allclose(array(tiles.to_pixels(focus, ("frame_idx",), 9, 7)), array(stencil.focus_measure(r, 1)))


def test_pyramid_reconstructs_odd_sizes(spark, noise):
    r = raster(spark, noise)
    assert np.allclose(array(stencil.reconstruct(stencil.laplacian_pyramid(r, 3))), noise, atol=1e-9)
    flat = raster(spark, np.full((1, 7, 9), 3.5))
    assert np.allclose(array(stencil.expand(stencil.reduce(flat), 9, 7)), 3.5)


def test_identity_warp_and_zero_outside(spark, noise):
    r = raster(spark, noise)
    still = spark.createDataFrame([(0, 1.0, 0.0, 0.0)], "frame_idx int, scale double, dx double, dy double")
    assert np.array_equal(array(stencil.warp(r, still)), noise)  # frame 1 has no transform
    far = spark.createDataFrame([(0, 1.0, 100.0, 0.0), (1, 1.0, 1.0, 0.0)], "frame_idx int, scale double, dx double, dy double")
    got = array(stencil.warp(r, far, clamp=False))
    assert not got[0].any() and np.array_equal(got[1, :, :-1], noise[1, :, 1:])


def test_argmax_ties_and_nan(spark):
    a = np.array([[[1.0, np.nan, np.nan]], [[1.0, 2.0, np.nan]], [[0.0, 3.0, np.nan]]])
    labels = {(q.y, q.x): q.label for q in weights.argmax_labels(raster(spark, a), "v").df.collect()}
    assert labels == {(0, 0): 0, (0, 1): 2, (0, 2): 0}


def test_guided_filter_keeps_constants(spark):
    r = raster(spark, np.random.default_rng(1).random((1, 6, 6)))
    both = r.map(i=F.col("v"), p=F.lit(0.25))
    assert np.allclose(array(weights.guided_filter(both, "i", "p", 1, 1e-4), "q"), 0.25, atol=1e-9)


def test_joint_channels_decide(spark):
    rows = [(f, y, x, *(((0.5, 0.3, 0.45), (0.1, 0.0, 0.65))[f])) for f in (0, 1) for y in range(4) for x in range(4)]
    r = Raster(spark.createDataFrame(rows, "frame_idx int, y int, x int, r double, g double, b double"), ("frame_idx",), 4, 4, ("r", "g", "b"))
    assert {(q.r, q.b) for q in fusion.select_level(r, 0).df.collect()} == {(0.5, 0.45)}
    odd = r.having(r.df.withColumn("g", F.when((F.col("frame_idx") == 0) & (F.col("x") == 1), float("nan")).otherwise(F.col("g"))))
    assert {(q.x, q.b) for q in fusion.select_level(odd, 0).df.collect()} == {(0, 0.45), (1, 0.65), (2, 0.45), (3, 0.45)}
    with pytest.raises(ValueError, match="frame 1"):
        fusion.require_same_frames(r, r.having(r.df.where("frame_idx = 0")))
    fusion.require_same_frames(r, r)
    assert fusion.rule("blend", 3) == fusion.Blend() and fusion.rule("select", 3).salience_radius == 3


def test_coverage_values(spark):
    t = spark.createDataFrame([(0, 1.08, 0.0, 0.0), (1, 1.0, 0.0, 0.0), (2, 1.0, 61.0, 0.0), (3, 1.0, 1e9, 0.0)], "frame_idx int, scale double, dx double, dy double")
    got = {q.frame_idx: q for q in coverage.coverage(t, 5400, 3600).collect()}
    assert 200 <= got[0].x0 <= 204 and (got[1].x0, got[1].y0, got[1].x1, got[1].y1) == (0, 0, 5400, 3600)
    assert got[2].x1 == 5400 - 61 - 2 and got[3].x1 >= got[3].x0
    assert scalar.level_count(1200, 900, 32) == 5 and scalar.level_count(8664, 5784, 32) == 8 and scalar.level_count(40, 40, 32) == 1


def test_quantile_is_an_element(spark):
    df = spark.createDataFrame([(0, v) for v in (5, 1, 1, 9)], "k int, v int")
    assert metrics.at_rank(df, ["k"], "v", {"a": 0.0, "b": 0.5, "c": 1.0}).collect()[0][1:] == (1, 5, 9)


def test_nearest_frame_against_all_pairs(spark):
    values = [*np.random.default_rng(5).integers(0, 25, 40).tolist(), 90, -40]
    got = {r.frame_idx: r.nearest for r in metrics.nearest_frame(spark.createDataFrame([*enumerate(map(float, values)), (99, None)], "frame_idx int, v double"), "v").collect()}
    assert got == {i: min((abs(v - w), j) for j, w in enumerate(values) if j != i)[1] for i, v in enumerate(values)}
    assert metrics.nearest_frame(spark.createDataFrame([(0, 1.0)], "frame_idx int, v double"), "v").count() == 0


def test_scalar_edges(spark):
    row = spark.range(1).select(
        scalar.quantize16(F.lit(float("nan"))).alias("nan"), scalar.quantize16(F.lit(2.0)).alias("over"), scalar.srgb_to_linear(F.lit(0.5)).alias("half"),
        scalar.wrapped(F.lit(4.0), 8).alias("w4"), scalar.wrapped(F.lit(5.0), 8).alias("w5"), scalar.parabolic(F.lit(1.0), F.lit(1.0), F.lit(1.0)).alias("flat"),
        scalar.inverse(F.struct(F.lit(0.0).alias("scale"), F.lit(1.0).alias("dx"), F.lit(1.0).alias("dy"))).alias("inv"), scalar.hann(F.lit(0), 1).alias("h"),
    ).first()
    assert (row.nan, row.over, row.w4, row.w5, row.flat, row.inv.scale, row.h) == (0, 65535, 4.0, -3.0, 0.0, None, 1.0)
    assert abs(row.half - 0.214) < 1e-3


def test_registration_recovers():
    a = registration.texture(128, 96)
    for dx, dy in registration.SHIFTS:
        got = registration.shift_between(a, registration.texture(128, 96, dx, dy))
        assert abs(got[0] - dx) < 0.2 and abs(got[1] - dy) < 0.2
    big = registration.texture(256, 256)
    assert registration.region_spread(big, registration.texture(256, 256, 4.0, -3.0)) < 0.2
    assert registration.region_spread(big, registration.texture(256, 256, scale=1.03)) > 1
    for s in (1.025, 0.96):
        assert abs(registration.similarity_between(big, registration.texture(256, 256, scale=s))[0] - s) < 0.004


def test_chain_equals_composition(spark):
    n, rng = 9, np.random.default_rng(2)
    steps = [(i, *(1 + rng.normal(0, 0.01, 1)), *rng.normal(0, 2, 2)) for i in range(n)]
    got = {q.frame_idx: q for q in registration.chained(spark.createDataFrame([tuple(map(float, s[1:])) and (s[0], *map(float, s[1:])) for s in steps], "frame_idx int, scale double, dx double, dy double"), n).collect()}
    for way in (1, -1):
        s, dx, dy = 1.0, 0.0, 0.0
        i = n // 2 + way
        while 0 <= i < n:
            _, ks, kx, ky = steps[i]
            s, dx, dy = s * ks, ks * dx + kx, ks * dy + ky
            assert np.allclose([got[i].scale, got[i].dx, got[i].dy], [s, dx, dy])
            i += way
    assert (got[n // 2].scale, got[n // 2].dx) == (1.0, 0.0)


@pytest.mark.parametrize("compress", [False, True])
@pytest.mark.parametrize("strip", [1, 5, 64])
def test_tiff_round_trip(spark, tmp_path, compress, strip):
    a = np.random.default_rng(3).integers(0, 65536, (23, 7, 3)).astype(np.uint16)
    path = str(tmp_path / "f.tif")
    tiff.write(path, 7, 23, iter(a), sinks.srgb_profile(), compress, strip)
    assert np.array_equal(tiff.read_rows(path, 0, 23), a) and np.array_equal(tiff.read_rows(path, 9, 6), a[9:15])
    with pytest.raises(params.Bounds):
        tiff.read_rows(path, 20, 9)
    if strip == 5:
        spark.dataSource.register(tiff.TiffStack)
        rows = spark.read.format("tiffstack").option("paths", path).option("strips", 2).load().orderBy("y").collect()
        assert np.array_equal(np.array([q.data for q in rows]).reshape(23, 7, 3), a)


def test_tiff_refuses(tmp_path):
    bad = tmp_path / "x.tif"
    bad.write_bytes(b"not a picture")
    with pytest.raises(params.UnsupportedFormat):
        tiff.probe(str(bad))


def test_sinks(spark, tmp_path):
    profile = sinks.srgb_profile()
    assert profile == sinks.srgb_profile() and int.from_bytes(profile[:4], "big") == len(profile) and profile[36:40] == b"acsp"
    r = raster(spark, np.linspace(0, 1, 12).reshape(1, 3, 4))
    one = Raster(r.df.select("y", "x", *[F.col("v").alias(c) for c in "rgb"]), (), 4, 3, ("r", "g", "b"))
    sinks.write_fused(one, str(tmp_path / "out.tif"))
    got = tiff.read_rows(str(tmp_path / "out.tif"), 0, 3)
    assert got[0, 0, 0] == 0 and got[2, 3, 2] == 65535 and (np.diff(got[:, :, 0].ravel().astype(int)) > 0).all()
    sinks.write_png(str(tmp_path / "a.png"), sinks.overlay(np.eye(4), np.ones((4, 4))))
    sinks.export(str(tmp_path / "a.png"), str(tmp_path / "b.png"))
    assert (tmp_path / "b.png").read_bytes()[:4] == b"\x89PNG" and not (tmp_path / "a.png").exists()


def test_discovery(spark, tmp_path):
    for n in ("frame_10.tif", "frame_2.TIFF", "frame_002.tif", ".hidden.tif", "depth_map.tif", "x.png"):
        (tmp_path / "s1").mkdir(exist_ok=True)
        (tmp_path / "s1" / n).write_bytes(b"x")
    rows = discovery.discover(spark, str(tmp_path), sets=True).orderBy("frame_idx").collect()
    assert [q.name for q in rows] == ["frame_2.TIFF", "frame_002.tif", "frame_10.tif"] and {q.stack for q in rows} == {"s1"}
    with pytest.raises(params.NoFrames):
        discovery.discover(spark, str(tmp_path / "nothing"))
    long = spark.createDataFrame([("f_" + "9" * 41,), ("f_1" + "0" * 40 + "0",), ("f_" + "8" * 40,)], "n string").select(discovery.natural_key("n").alias("k"), "n").orderBy("k").collect()
    assert [len(q.n) for q in long] == [42, 44, 43] or [len(q.n) for q in long] == [42, 43, 44]
    heads = spark.createDataFrame([("s", "a", 0, 5, 5, 3, 16), ("s", "b", 1, 5, 6, 3, 16)], "stack string, path string, frame_idx int, width int, height int, samples int, bits int")
    with pytest.raises(params.Geometry, match="b differs from a"):
        discovery.check_geometry(heads)
    with pytest.raises(params.OutputInsideStack):
        discovery.ensure_outside(str(tmp_path / "s1" / "o.tif"), str(tmp_path / "s1"))
    discovery.ensure_outside(str(tmp_path / "none" / "o.tif"), str(tmp_path / "s1"))
    assert discovery.output_path("a", 1) == "a_fused.tif" and discovery.output_path("a", 2, str(tmp_path / "o")).endswith("o/a.tif")


def test_control(spark, tmp_path):
    gib = 1 << 30
    assert [control.memory_limit(g * gib) // gib for g in (36, 64, 128)] == [16, 16, 32] and control.memory_limit(8 * gib) < 8 * gib
    work = control.Workload(33, 8664, 5784, 300 << 20)
    readers, peak = work.admitted(14, 16 * gib)
    assert 1 <= readers <= 14 and peak == work.peak(readers, 14) and work.admitted(14, 1)[0] == 1
    run = control.RunControl(spark)
    with run.stage("focus"):
        spark.range(10).count()
    run.cancel()
    with pytest.raises(params.Cancelled), run.stage("fuse"):
        pass
    assert set(run.seconds) == {"focus"} and control.clock(75) == "01:15"
    with pytest.raises(ValueError), control.scratch(str(tmp_path)):
        raise ValueError
    kept = os.listdir(tmp_path)
    (tmp_path / f"{control.SCRATCH_PREFIX}999999999-1").mkdir()
    (tmp_path / f"{control.SCRATCH_PREFIX}odd").mkdir()
    assert len(kept) == 1 and control.reap(str(tmp_path)) == [f"{control.SCRATCH_PREFIX}999999999-1"]


def test_select_fold_equals_batch(spark, tmp_path):
    rows = [(f, y, x, float((f * 7 + y * 3 + x) % 5), float(f)) for f in range(4) for y in range(3) for x in range(3)]
    df = spark.createDataFrame(rows, "frame_idx int, y int, x int, s double, v double")
    fold = SelectFold(spark, str(tmp_path), ("v",))
    for epoch in range(4):
        fold.merge(df.where(F.col("frame_idx") == epoch), epoch)
    assert sorted(fold.result().collect()) == sorted(fold.best(df).collect())
    fold.merge(df.where("frame_idx = 3"), 3)  # run again after a failure
    again = SelectFold(spark, str(tmp_path), ("v",))  # started again from the folder
    assert sorted(again.result().collect()) == sorted(fold.best(df).collect())
    more = df.withColumn("frame_idx", F.lit(9)).withColumn("s", F.col("s") + 0.5)
    again.merge(more, 4)
    assert sorted(again.result().collect()) == sorted(fold.best(df.unionByName(more)).collect()) and again.epochs() == [3, 4]


def test_display_plane_and_samples(spark, noise):
    t = array(pipeline.display_plane(raster(spark, noise), "v"), "t")
    assert t.min() == 0 and t.max() == 1
    assert {q.frame_idx for q in pipeline.sampled(spark.range(9).withColumnRenamed("id", "frame_idx"), 9).collect()} == {0, 4, 8}


@pytest.mark.parametrize("kind", ["select", "blend"])
@pytest.mark.parametrize("band, broadcast", [(256, True), (8, True), (8, False)])
def test_bands_fuse_as_pixels_do(spark, monkeypatch, kind, band, broadcast):
    """Odd sizes, several levels, transforms with gaps at the borders: the row layout gives the pixel layout's samples."""
    if not broadcast:
        monkeypatch.setattr(bands, "BROADCAST_RANGES", 0)
    rng = np.random.default_rng(5)
    rows = [(f, y, x, *map(float, rng.random(3))) for f in range(3) for y in range(21) for x in range(19)]
    r = Raster(spark.createDataFrame(rows, "frame_idx int, y int, x int, r double, g double, b double"), ("frame_idx",), 19, 21, ("r", "g", "b"))
    w = Raster(spark.createDataFrame([(q[0], q[1], q[2], float(rng.random())) for q in rows], "frame_idx int, y int, x int, w double"), ("frame_idx",), 19, 21, ("w",))
    t = spark.createDataFrame([(0, 1.07, 1.5, -0.75), (2, 0.96, -2.25, 1.0)], "frame_idx int, scale double, dx double, dy double")
    every = t.unionByName(spark.createDataFrame([(1, 1.0, 0.0, 0.0)], t.schema))
    how = fusion.rule(kind, 1)
    want = {(q.y, q.x): (q.r, q.g, q.b) for q in fusion.fuse(r, w, every, how, 4).df.collect()}
    planes = bands.from_pixels(w.df, ("w",), 19, 21).df
    got = bands.to_pixels(bands.fuse(bands.from_pixels(r.df, r.cols, 19, 21), planes, t, 3, how, 4, band=band), r.cols)
    got = {(q.y, q.x): (q.r, q.g, q.b) for q in got.collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], atol=1e-9) for k in want)


def frames_in(folder, n=3, h=40, w=36):
    """A scene of which every frame is sharp in its own third, flat elsewhere; as 16-bit TIFF files."""
    scene = (registration.texture(w, h) * 0.05 + 0.5).clip(0.05, 0.95)
    folder.mkdir(exist_ok=True)
    for k in range(n):
        rows = np.stack([scene] * 3, axis=2)
        soft = np.ones((h, w), dtype=bool)
        soft[k * h // n : (k + 1) * h // n] = False
        rows[soft] = rows.mean()
        tiff.write(str(folder / f"frame_{k + 8}.tif"), w, h, iter((rows * 65535).astype(np.uint16)), compress=k % 2 == 1, rows_per_strip=7)
    return scene


def test_folder_in_image_out(spark, tmp_path):
    scene = frames_in(tmp_path / "s")
    still = lambda r, n, level: spark.createDataFrame([(k, 1.0, 0.0, 0.0) for k in range(n)], "frame_idx int, scale double, dx double, dy double")
    small = params.Params(registration_level=0, focus_radius=1, guide_radius=1, pyramid_floor=8)
    heads = stacking.headers(discovery.discover(spark, str(tmp_path / "s")))
    assert [(q.frame_idx, q.width, q.height, q.strips) for q in heads.orderBy("frame_idx").collect()] == [(k, 36, 40, 6) for k in range(3)]
    lines = stacking.linear_lines(heads, 36, 40)
    pixels = Raster(bands.to_pixels(lines.df.where("frame_idx = 0"), ("r", "g", "b")), (), 36, 40, ("r", "g", "b"))
    assert pixels.df.count() == 36 * 40
    run = control.RunControl(spark)
    fused = stacking.fuse_lines(lines, 3, small, run, still(lines, 3, 0))
    out = str(tmp_path / "out.tif")
    sinks.write_lines(fused, 36, 40, out)
    frames = Raster(spark.createDataFrame([(q.frame_idx, q.y, x, *map(float, q.data[3 * x : 3 * x + 3])) for q in lines.df.collect() for x in range(36)], "frame_idx int, y int, x int, r double, g double, b double"), ("frame_idx",), 36, 40, ("r", "g", "b"))
    want = Raster(pipeline.fuse_stack(frames, small, 3, lambda r, n: still(r, n, 0)), (), 36, 40, ("r", "g", "b"))
    sinks.write_fused(want, str(tmp_path / "want.tif"))
    got, want = tiff.read_rows(out, 0, 40).astype(int), tiff.read_rows(str(tmp_path / "want.tif"), 0, 40).astype(int)
    assert np.abs(got - want).max() <= 1
    inside = np.r_[3:10, 17:23, 30:37]
    assert np.abs(got[inside, :, 0] - scene[inside] * 65535).mean() < 0.02 * 65535
    assert set(run.seconds) == {"register", "focus", "weights", "fuse"}


def test_folder_run_end_to_end_and_its_errors(spark, tmp_path):
    frames_in(tmp_path / "s", n=2, h=64, w=64)
    small = params.Params(registration_level=0, focus_radius=1, guide_radius=1, pyramid_floor=16)
    run = control.RunControl(spark)
    out = stacking.stack_folder(spark, str(tmp_path / "s"), str(tmp_path / "o.tif"), small, run, debug=str(tmp_path / "d"))
    assert sorted(p.name for p in (tmp_path / "d").iterdir()) == ["luma_00000.png", "luma_00001.png", "overlay.png"]
    assert tiff.probe(out).width == 64 and set(run.seconds) == {"discover", "register", "debug", "focus", "weights", "fuse", "write"} and run.progress()[0] >= 0
    with pytest.raises(params.OutputInsideStack):
        stacking.stack_folder(spark, str(tmp_path / "s"), str(tmp_path / "s" / "o.tif"), small)
    with pytest.raises(params.RasterError, match="allowed"):
        stacking.stack_folder(spark, str(tmp_path / "s"), out, small, ram=1 << 20)
    run.cancel()
    with pytest.raises(params.Cancelled):
        stacking.stack_folder(spark, str(tmp_path / "s"), out, small, run)
    tiff.write(str(tmp_path / "s" / "frame_99.tif"), 5, 4, iter(np.zeros((4, 5, 3), dtype=np.uint16)))
    with pytest.raises(params.Geometry):
        stacking.stack_folder(spark, str(tmp_path / "s"), out, small)


def png(path):
    data, at, body = Path(path).read_bytes(), 8, b""
    w, h, _, kind = struct.unpack(">IIBB", data[16:26])
    while at < len(data):
        size = struct.unpack(">I", data[at : at + 4])[0]
        body += data[at + 8 : at + 8 + size] if data[at + 4 : at + 8] == b"IDAT" else b""
        at += size + 12
    rows = np.frombuffer(zlib.decompress(body), dtype=np.uint8).reshape(h, -1)
    assert not rows[:, 0].any()
    return rows[:, 1:].reshape(h, w, 3) if kind == 2 else rows[:, 1:]


def test_pictures(spark, tmp_path):
    """Shrunk by a power of two, remainders dropped; the first frame's shift shrinks with its picture."""
    rng = np.random.default_rng(4)
    base = np.kron(rng.random((12, 14)), np.ones((4, 4)))
    frames = [np.repeat(np.roll(base, (0, 4 * (k == 0)), (0, 1))[:46, :, None], 3, axis=2) for k in range(3)]
    r = bands.Rows(spark.createDataFrame([(k, y, f[y].ravel().tolist()) for k, f in enumerate(frames) for y in range(46)], "frame_idx int, y int, data array<double>"), 56, 46)
    ts = spark.createDataFrame([(0, 1.0, 4.0, 0.0), (1, 1.0, 0.0, 0.0), (2, 1.0, 0.0, 0.0)], "frame_idx int, scale double, dx double, dy double")
    paths = pictures.write_debug(r, ts, 3, str(tmp_path), limit=14)
    assert [Path(p).name for p in paths] == ["luma_00000.png", "luma_00001.png", "luma_00002.png", "overlay.png"]
    t = np.log1p(base[::4, ::4][:11])
    assert np.abs(png(paths[1]).astype(int) - (t - t.min()) / (t.max() - t.min()) * 255).max() <= 1
    over = png(paths[3]).astype(int)
    assert over.shape == (11, 14, 3) and np.abs(over[:, :-1, 0] - over[:, :-1, 1]).max() <= 1 and not over[..., 2].any()
    thumb = pictures.thumbnail(r, 1, width=7, rows=2)
    want = frames[1][:40].reshape(5, 8, 7, 8, 3)[:, :2].mean(axis=(1, 3))
    want = np.where(want <= 0.0031308, want * 12.92, 1.055 * want ** (1 / 2.4) - 0.055) * 255
    assert thumb.shape == (5, 7, 3) and np.abs(thumb - want).max() <= 0.5 + 1e-9


def test_each_frame_needs_a_transform(spark):
    r = bands.Rows(spark.createDataFrame([(0, 0, [0.0] * 6)], "frame_idx int, y int, data array<double>"), 2, 1)
    for rows in ([(0, 1.0, 0.0, 0.0)], [(0, 1.0, 0.0, 0.0), (0, 1.0, 0.0, 0.0)], [(0, 1.0, 0.0, 0.0), (2, 1.0, 0.0, 0.0)]):
        with pytest.raises(params.BufferSize):
            stacking.fuse_lines(r, 2, params.Params(), control.RunControl(spark), spark.createDataFrame(rows, "frame_idx int, scale double, dx double, dy double"))


def test_readers_scratch_and_exclusion(spark, tmp_path):
    assert control.readers_for(10, 100, 8) == 8 and control.readers_for(50, 100, 8) <= 2
    frames = spark.createDataFrame([("s", f"p{k}", k) for k in range(4)], "stack string, path string, frame_idx int")
    kept = discovery.included(frames, [1]).orderBy("frame_idx").collect()
    assert [q.path for q in kept] == ["p0", "p2", "p3"]
