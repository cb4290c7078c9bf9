"""All raster queries by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import coverage as cov
from ..operators import bands, fusion, metrics, registration, stencil, weights
from ..sources import discovery
from ..sources.rasters import Raster, dyadic_transforms, embedding_frames, event_frames
from . import control, pipeline, stacking
from . import sql as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
SF = "stack, frame_idx"
RGB = "r, g, b"


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def rounded(r: Raster, digits: int = 6) -> DataFrame:
    return r.df.select(*r.at, *[F.round(F.col(c).cast("double"), digits).alias(c) for c in r.cols])


def whole(r: Raster) -> DataFrame:
    return r.df.select(*r.at, *[F.col(c).cast("long").alias(c) for c in r.cols])


# Discovery and scans.

NAMES = """SELECT p_size AS stack, CASE WHEN p_partkey % 2 = 0 THEN 'frame_' || lpad(CAST(p_partkey % 997 AS VARCHAR), 5, '0') ELSE 'frame_' || CAST(p_partkey % 997 AS VARCHAR) END
  || CASE WHEN p_partkey % 3 = 0 THEN '_' || CAST(p_partkey AS VARCHAR) ELSE '' END || CASE WHEN p_partkey % 11 = 0 THEN '.png' ELSE '.TIF' END AS name FROM part"""


@query(S.with_(("n", NAMES), ("k", """SELECT stack, name, array_to_string(list_transform(regexp_extract_all(name, '[0-9]+|[^0-9]+'), lambda t:
  CASE WHEN regexp_matches(t, '^[0-9]') THEN '0' || lpad(CAST(length(regexp_replace(t, '^0+(?=.)|^0+([0-9])', '\\1')) AS VARCHAR), 4, '0') || regexp_replace(t, '^0+([0-9])', '\\1') ELSE t END), '') AS key
  FROM n WHERE lower(name) LIKE '%.tif'""".replace("^0+(?=.)|^0+([0-9])", "^0+([0-9])")),
    then="SELECT stack, name, CAST(row_number() OVER (PARTITION BY stack ORDER BY key, name) - 1 AS INTEGER) AS frame_idx FROM k"))
def natural_frame_order(spark: SparkSession, sf: str) -> DataFrame:
    spark.read.parquet(f"{sf}/part.parquet").createOrReplaceTempView("part_names")
    names = spark.sql(NAMES.replace("FROM part", "FROM part_names").replace("VARCHAR", "STRING"))
    return discovery.ordered(names.where(discovery.is_frame("name")), "stack", "name").select("stack", "name", "frame_idx")


@query(S.with_(("v", S.VEC), then="""SELECT stack, CAST(count(DISTINCT frame_idx) AS BIGINT) AS frames, CAST(count(*) // count(DISTINCT frame_idx) AS BIGINT) AS pixels,
  count(*) = count(DISTINCT frame_idx) * (max(x) + 1) * (max(y) + 1) AS uniform FROM v GROUP BY stack"""))
def geometry_probe(spark: SparkSession, sf: str) -> DataFrame:
    r = embedding_frames(spark, sf)
    n = F.countDistinct("frame_idx")
    return r.df.groupBy("stack").agg(
        n.alias("frames"), F.expr("count(1) div count(distinct frame_idx)").alias("pixels"),
        (F.count(F.lit(1)) == n * (F.max("x") + 1) * (F.max("y") + 1)).alias("uniform"),
    )


def event_luma(r: Raster) -> Raster:
    return r.map(l=scalar.luma(F.col("r"), F.col("g"), F.col("b")))


LUMA = "0.2126::DOUBLE * r + 0.7152::DOUBLE * g + 0.0722::DOUBLE * b"


@query(S.with_(("e", S.EVT), then=f"SELECT frame_idx, CAST(y // 2 AS INTEGER) AS y, CAST(x // 2 AS INTEGER) AS x, round(avg({LUMA}), 3) AS l FROM e GROUP BY 1, 2, 3"))
def luma_level(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(stencil.block_mean(event_luma(event_frames(spark, sf)), 1), 3)


@query(S.with_(("e", S.EVT), then="""SELECT frame_idx, CAST((y - 3) // 4 AS INTEGER) AS y, CAST((x - 2) // 4 AS INTEGER) AS x, round(avg(r), 6) AS r, round(avg(g), 6) AS g, round(avg(b), 6) AS b
FROM e WHERE x BETWEEN 2 AND 21 AND y BETWEEN 3 AND 26 AND (y - 3) % 4 < 2 GROUP BY 1, 2, 3"""))
def region_downsample(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(stencil.region_mean(event_frames(spark, sf), 2, 3, 20, 24, 5, 2))


@query(S.with_(("e", S.EVT), then="""SELECT frame_idx, CAST(y - 4 AS INTEGER) AS y, CAST(x - 3 AS INTEGER) AS x, r, g, b FROM e WHERE x BETWEEN 3 AND 12 AND y BETWEEN 4 AND 15"""))
def crop(spark: SparkSession, sf: str) -> DataFrame:
    return whole(stencil.crop(event_frames(spark, sf), 3, 4, 10, 12)).withColumns({c: F.col(c).cast("int") for c in "yx"})


@query(S.with_(("e", S.EVT), ("l", "SELECT frame_idx, y, x, r / (r + 10.0::DOUBLE) AS v FROM e"),
    ("s", "SELECT *, CASE WHEN v <= 0.0031308 THEN v * 12.92 ELSE 1.055 * pow(v, 1 / 2.4::DOUBLE) - 0.055 END AS enc FROM l"),
    then="""SELECT frame_idx, y, x, round(enc, 6) AS encoded, round(CASE WHEN enc <= 0.04045 THEN enc / 12.92 ELSE pow((enc + 0.055) / 1.055, 2.4) END, 6) AS decoded,
  CAST(round(least(greatest(enc, 0), 1) * 65535) AS INTEGER) AS q16, CAST(floor(least(greatest(enc, 0), 1) * 255 + 0.5) AS INTEGER) AS q8 FROM s"""))
def srgb_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    v = F.col("r") / (F.col("r") + 10.0)
    enc = scalar.linear_to_srgb(v)
    r = event_frames(spark, sf)
    return r.df.select(*r.at, F.round(enc, 6).alias("encoded"), F.round(scalar.srgb_to_linear(enc), 6).alias("decoded"), scalar.quantize16(v).alias("q16"), scalar.encode8(v).alias("q8"))


# Stencils.


@query(S.with_(("v", S.VEC), then=f"SELECT {SF}, y, x, CAST(v AS BIGINT) AS v FROM ({S.box_sum('v', SF, 'v', S.VEC_AT, 2)})"))
def box_sum_r2(spark: SparkSession, sf: str) -> DataFrame:
    return whole(stencil.box_sum(embedding_frames(spark, sf), 2))


@query(S.with_(("e", S.EVT), then=S.rounded(f"({S.box_mean('e', 'frame_idx', RGB, S.EVT_AT, 1)})", "frame_idx", RGB)))
def box_mean_r1(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(stencil.box_mean(event_frames(spark, sf), 1))


@query(S.with_(("v", S.VEC), then=f"SELECT {SF}, y, x, CAST(v AS BIGINT) AS v FROM ({S.laplacian('v', SF, 'v', S.VEC_AT)})"))
def laplacian_energy(spark: SparkSession, sf: str) -> DataFrame:
    return whole(stencil.laplacian_energy(embedding_frames(spark, sf)))


FOCUS = (("v", S.VEC), ("lap", S.laplacian("v", SF, "v", S.VEC_AT)))


@query(S.with_(*FOCUS, then=f"SELECT {SF}, y, x, CAST(v AS BIGINT) AS focus FROM ({S.box_sum('lap', SF, 'v', S.VEC_AT, 2)})"))
def focus_map(spark: SparkSession, sf: str) -> DataFrame:
    r = stencil.focus_measure(embedding_frames(spark, sf), 2)
    return whole(r.map(focus=F.col("v")))


@query(S.with_(*FOCUS, ("f", S.box_sum("lap", SF, "v", S.VEC_AT, 1)), then=f"SELECT stack, y, x, CAST(label AS INTEGER) AS label, CAST(v AS BIGINT) AS focus FROM ({S.argmax('f', 'stack', 'v')})"))
def focus_argmax_labels(spark: SparkSession, sf: str) -> DataFrame:
    r = weights.argmax_labels(stencil.focus_measure(embedding_frames(spark, sf), 1), "v")
    return r.df.select(*r.at, "label", F.col("v").cast("long").alias("focus"))


HOT = (
    ("e", S.EVT), ("lab", S.argmax("e", "", "g")),
    ("h", "SELECT p.frame_idx, p.y, p.x, p.r / 100.0::DOUBLE AS i, CAST(l.label = p.frame_idx AS DOUBLE) AS p FROM e p JOIN lab l ON l.y = p.y AND l.x = p.x"),
    ("mo", S.box_mean("(SELECT *, i * p AS ip, i * i AS ii FROM h)", "frame_idx", "i, p, ip, ii", S.EVT_AT, 1)),
    ("ab", "SELECT frame_idx, y, x, a, p - a * i AS b FROM (SELECT *, (ip - i * p) / (ii - i * i + 1e-4) AS a FROM mo)"),
    ("me", S.box_mean("ab", "frame_idx", "a, b", S.EVT_AT, 1)),
    ("q", "SELECT m.frame_idx, m.y, m.x, m.a * h.i + m.b AS q FROM me m JOIN h ON h.frame_idx = m.frame_idx AND h.y = m.y AND h.x = m.x"),
)


def event_mask(r: Raster) -> Raster:
    labels = weights.argmax_labels(r, "g")
    hot = weights.one_hot(r, labels)
    both = r.df.join(hot.df, r.at)
    return r.having(both.select(*r.at, (F.col("r") / 100.0).alias("i"), F.col("w").alias("p")), ("i", "p"))


@query(S.with_(*HOT[:3], then="SELECT frame_idx, y, x, p AS w FROM h"))
def one_hot_mask(spark: SparkSession, sf: str) -> DataFrame:
    r = event_frames(spark, sf)
    return weights.one_hot(r, weights.argmax_labels(r, "g")).df


@query(S.with_(*HOT, then=S.rounded("q", "frame_idx", "q")))
def guided_filter(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(weights.guided_filter(event_mask(event_frames(spark, sf)), "i", "p", 1, 1e-4))


@query(S.with_(*HOT, ("w", "SELECT frame_idx, y, x, greatest(q, 0) AS w, sum(greatest(q, 0)) OVER (PARTITION BY y, x) AS t FROM q"),
    then="SELECT frame_idx, y, x, round(CASE WHEN t > 1e-8 THEN w / t ELSE 0.2::DOUBLE END, 6) AS w FROM w"))
def weights_normalized(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(weights.normalised(weights.refine(event_mask(event_frames(spark, sf)), "i", "p", 1, 1e-4), 5))


# Transforms, coverage, resampling.


@query(S.with_(("xf", S.XF), then=S.coverage(S.EVT_AT)))
def coverage_rects(spark: SparkSession, sf: str) -> DataFrame:
    return cov.coverage(dyadic_transforms(spark), *S.EVT_AT)


@query(S.with_(("xf", S.XF), ("c0", S.coverage(S.EVT_AT)), ("c1", S.cover_reduced("c0", (24, 30))), ("c2", S.cover_reduced("c1", (12, 15))),
    then="SELECT 1 AS level, * FROM c1 UNION ALL SELECT 2, * FROM c2"))
def coverage_levels(spark: SparkSession, sf: str) -> DataFrame:
    one = cov.reduced(cov.coverage(dyadic_transforms(spark), 24, 30), 24, 30)
    return one.select(F.lit(1).alias("level"), "*").unionByName(cov.reduced(one, 12, 15).select(F.lit(2).alias("level"), "*"))


@query(S.with_(("xf", S.XF), ("c0", S.coverage(S.EVT_AT)), then=S.EVERY.format("c0")))
def coverage_all(spark: SparkSession, sf: str) -> DataFrame:
    return cov.every_frame(cov.coverage(dyadic_transforms(spark), *S.EVT_AT))


STEPS = "SELECT CAST(k AS INTEGER) AS frame_idx, 1 + (k % 3 - 1) / 64.0::DOUBLE AS scale, (k % 5 - 2) / 4.0::DOUBLE AS dx, (k % 4 - 1) / 8.0::DOUBLE AS dy FROM (SELECT unnest(range(21)) AS k)"


@query(f"""WITH RECURSIVE st AS ({STEPS}), up(frame_idx, scale, dx, dy) AS (
  SELECT 10, 1.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE UNION ALL
  SELECT s.frame_idx, u.scale * s.scale, s.scale * u.dx + s.dx, s.scale * u.dy + s.dy FROM up u JOIN st s ON s.frame_idx = u.frame_idx + 1
), down(frame_idx, scale, dx, dy) AS (
  SELECT 10, 1.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE UNION ALL
  SELECT s.frame_idx, u.scale * s.scale, s.scale * u.dx + s.dx, s.scale * u.dy + s.dy FROM down u JOIN st s ON s.frame_idx = u.frame_idx - 1
) SELECT frame_idx, round(scale, 9) AS scale, round(dx, 9) AS dx, round(dy, 9) AS dy FROM (SELECT * FROM up UNION SELECT * FROM down)""")
def transform_chain(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("id")
    steps = spark.range(21).select(k.cast("int").alias("frame_idx"), (1 + (k % 3 - 1) / 64).alias("scale"), ((k % 5 - 2) / 4).alias("dx"), ((k % 4 - 1) / 8).alias("dy"))
    return registration.chained(steps, 21).select("frame_idx", *[F.round(c, 9).alias(c) for c in ("scale", "dx", "dy")])


@query(f"""SELECT frame_idx, round(4 * dx, 9) AS up_dx, round(4 * dy, 9) AS up_dy, round(scale * 3 + dx, 9) AS px, round(scale * -5 + dy, 9) AS py,
  round(0.5::DOUBLE * scale, 9) AS then_scale, round(0.5::DOUBLE * dx + 1, 9) AS then_dx, round(0.5::DOUBLE * dy - 2, 9) AS then_dy FROM ({STEPS})""")
def transform_algebra(spark: SparkSession, sf: str) -> DataFrame:
    """A transform two levels up, at the point (3, -5), and followed by a halving with a shift."""
    k = F.col("id")
    t = F.struct((1 + (k % 3 - 1) / 64).alias("scale"), ((k % 5 - 2) / 4).alias("dx"), ((k % 4 - 1) / 8).alias("dy"))
    half = F.struct(F.lit(0.5).alias("scale"), F.lit(1.0).alias("dx"), F.lit(-2.0).alias("dy"))
    up, both, (px, py) = scalar.scaled_up(t, 2), scalar.then(t, half), scalar.applied(t, F.lit(3.0), F.lit(-5.0))
    named = {"up_dx": up["dx"], "up_dy": up["dy"], "px": px, "py": py, "then_scale": both["scale"], "then_dx": both["dx"], "then_dy": both["dy"]}
    return spark.range(21).select(k.cast("int").alias("frame_idx"), *[F.round(c, 9).alias(n) for n, c in named.items()])


@query("""SELECT CAST(k AS INTEGER) AS frame_idx, CAST(CASE WHEN k > 10 THEN k - 1 ELSE k + 1 END AS INTEGER) AS reference FROM (SELECT unnest(range(21)) AS k) WHERE k <> 10""")
def registration_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return registration.pairs(spark.range(21).select(F.col("id").cast("int").alias("frame_idx")), 21)


@query(S.with_(("xf", S.XF), then="SELECT min(scale) AS lo, max(scale) AS hi FROM xf"))
def scale_range(spark: SparkSession, sf: str) -> DataFrame:
    return dyadic_transforms(spark).agg(F.min("scale").alias("lo"), F.max("scale").alias("hi"))


@query(S.with_(("e", S.EVT), ("xf", S.XF), then=S.rounded(f"({S.warp('e', RGB, S.EVT_AT)})", "frame_idx", RGB)))
def warp_plane(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(stencil.warp(event_frames(spark, sf), dyadic_transforms(spark)))


@query(S.with_(("e", S.EVT), ("x0", S.XF), ("xf", "SELECT frame_idx, 1 / scale AS scale, -dx / scale AS dx, -dy / scale AS dy FROM x0"), then=S.rounded(f"({S.warp('e', RGB, S.EVT_AT, False)})", "frame_idx", RGB, 3)))
def warp_zero(spark: SparkSession, sf: str) -> DataFrame:
    back = dyadic_transforms(spark).select("frame_idx", scalar.inverse(F.struct("scale", "dx", "dy")).alias("t")).select("frame_idx", "t.*")
    return rounded(stencil.warp(event_frames(spark, sf), back, clamp=False), 3)


# Pyramids.

SIZES = scalar.sizes(24, 30, 3)


def _levels(src: str, keys: str, cols: str) -> list[tuple[str, str]]:
    """Gaussian levels g0..g2, their expansions and the bands l0, l1."""
    out = [("g0", f"SELECT * FROM {src}")]
    for i in (1, 2):
        out.append((f"g{i}", S.reduce(f"g{i - 1}", keys, cols, SIZES[i - 1])))
    for i in (0, 1):
        out += [(f"x{i}", S.expand(f"g{i + 1}", keys, cols, SIZES[i + 1], SIZES[i])), (f"l{i}", S.combine(f"g{i}", f"x{i}", keys, cols, "-"))]
    return out


PYR = [("e", S.EVT), *_levels("e", "frame_idx", RGB)]


@query(S.with_(*PYR[:3], then=S.rounded("g1", "frame_idx", RGB)))
def pyramid_reduce(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(stencil.reduce(event_frames(spark, sf)))


@query(S.with_(*PYR[:3], PYR[4], then=S.rounded("x0", "frame_idx", RGB)))
def pyramid_expand(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(stencil.expand(stencil.reduce(event_frames(spark, sf)), 24, 30))


def _union(names: list[str], keys: str, cols: str) -> str:
    cells = ", ".join(f"round(CAST({c} AS DOUBLE), 6) AS {c}" for c in cols.split(", "))
    return " UNION ALL ".join(f"SELECT {keys}, {i} AS level, y, x, {cells} FROM {n}" for i, n in enumerate(names))


def _stacked(levels: list[Raster]) -> DataFrame:
    df = stencil.stacked(levels)
    return df.withColumns({c: F.round(c, 6) for c in levels[0].cols})


@query(S.with_(*PYR[:4], then=_union(["g0", "g1", "g2"], "frame_idx", RGB)))
def gaussian_pyramid(spark: SparkSession, sf: str) -> DataFrame:
    return _stacked(stencil.gaussian_pyramid(event_frames(spark, sf), scalar.level_count(24, 30, 4)))


@query(S.with_(*PYR, then=_union(["l0", "l1", "g2"], "frame_idx", RGB)))
def laplacian_pyramid(spark: SparkSession, sf: str) -> DataFrame:
    return _stacked(stencil.laplacian_pyramid(event_frames(spark, sf), 3))


@query(S.with_(("e", S.EVT), then=S.rounded("e", "frame_idx", RGB)))
def pyramid_reconstruct(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(stencil.reconstruct(stencil.laplacian_pyramid(event_frames(spark, sf), 3)))


# Fusion.

#: Fused samples are given as shares of this white level. It is no dyadic number: most samples are, and
#: would stand on the border of a rounding, where the last bit of a sum decides.
WHITE = 318.309886
SHARES = "SELECT y, x, " + ", ".join(f"round({c} / {WHITE}::DOUBLE, 6) + 0.0 AS {c}" for c in "rgb") + " FROM {}"


def shares(r: Raster) -> DataFrame:
    return r.df.select(*r.at, *[(F.round(F.col(c) / WHITE, 6) + 0.0).alias(c) for c in r.cols])


def _salience(src: str, size: tuple[int, int], radius: int) -> str:
    return S.box_sum(f"(SELECT frame_idx, y, x, CAST(r AS DOUBLE) * r + CAST(g AS DOUBLE) * g + CAST(b AS DOUBLE) * b AS s FROM {src})", "frame_idx", "s", size, radius)


@query(S.with_(("e", S.EVT), then=S.rounded(f"({_salience('e', S.EVT_AT, 2)})", "frame_idx", "s")))
def salience(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(fusion.salience(event_frames(spark, sf), 2))


@query(S.with_(("e", S.EVT), ("xf", S.XF), ("c0", S.coverage(S.EVT_AT)), ("sal", _salience("e", S.EVT_AT, 2)), then=S.select_level("e", "sal", "c0", S.EVT_AT)))
def select_level(spark: SparkSession, sf: str) -> DataFrame:
    return fusion.select_level(event_frames(spark, sf), 2, cov.coverage(dyadic_transforms(spark), *S.EVT_AT)).df


HOT_W = (("e", S.EVT), ("lab", S.argmax("e", "", "g")), ("w", "SELECT p.frame_idx, p.y, p.x, CASE WHEN l.label = p.frame_idx THEN 0.75::DOUBLE ELSE 0.0625::DOUBLE END AS w FROM e p JOIN lab l ON l.y = p.y AND l.x = p.x"), ("xf", S.XF), ("c0", S.coverage(S.EVT_AT)))


def event_weights(r: Raster) -> Raster:
    hot = weights.one_hot(r, weights.argmax_labels(r, "g"))
    return hot.map(w=F.when(F.col("w") == 1, 0.75).otherwise(0.0625))


@query(S.with_(*HOT_W, then=S.rounded(f"({S.accumulate('e', 'w', 'c0', S.EVT_AT)})", "", "r, g, b, tally")))
def blend_level(spark: SparkSession, sf: str) -> DataFrame:
    r = event_frames(spark, sf)
    return rounded(fusion.accumulate(r, event_weights(r), cov.coverage(dyadic_transforms(spark), *S.EVT_AT)))


@query(S.with_(*HOT_W, ("acc", S.accumulate("e", "w", "c0", S.EVT_AT)), ("ev", S.EVERY.format("c0")), then=SHARES.format(f"({S.uncovered('acc', 'ev')})")))
def normalize_uncovered(spark: SparkSession, sf: str) -> DataFrame:
    r, rects = event_frames(spark, sf), cov.coverage(dyadic_transforms(spark), *S.EVT_AT)
    return shares(fusion.normalise_uncovered(fusion.accumulate(r, event_weights(r), rects), cov.every_frame(rects)))


def _fused(kind: str) -> str:
    steps = [*HOT_W, ("e1", S.warp("e", RGB, S.EVT_AT)), *_levels("e1", "frame_idx", RGB), ("w1", S.reduce("w", "frame_idx", "w", SIZES[0])), ("w2", S.reduce("w1", "frame_idx", "w", SIZES[1]))]
    steps += [("c1", S.cover_reduced("c0", SIZES[0])), ("c2", S.cover_reduced("c1", SIZES[1])), ("v0", S.EVERY.format("c0"))]
    steps += [("v1", S.cover_reduced("v0", SIZES[0], "")), ("v2", S.cover_reduced("v1", SIZES[1], ""))]
    for i, band in enumerate(("l0", "l1", "g2")):
        if kind == "select" and i < 2:
            steps += [(f"s{i}", _salience(band, SIZES[i], 2)), (f"f{i}", S.select_level(band, f"s{i}", f"c{i}", SIZES[i]))]
        else:
            steps += [(f"a{i}", S.accumulate(band, "w" if i == 0 else f"w{i}", f"c{i}", SIZES[i])), (f"f{i}", S.uncovered(f"a{i}", f"v{i}"))]
    for i in (1, 0):
        steps += [(f"y{i}", S.expand("f2" if i == 1 else "z1", "", RGB, SIZES[i + 1], SIZES[i])), (f"z{i}", S.combine(f"f{i}", f"y{i}", "", RGB, "+"))]
    return S.with_(*steps, then=SHARES.format("z0"))


def _fuse(spark: SparkSession, sf: str, how) -> DataFrame:
    """On rows of pixels as arrays; tests hold it to the pixel layout."""
    r = event_frames(spark, sf)
    planes = bands.from_pixels(event_weights(r).df, ("w",), r.w, r.h).df
    fused = bands.fuse(bands.from_pixels(r.df, r.cols, r.w, r.h), planes, dyadic_transforms(spark), 5, how, floor=4)
    return shares(Raster(bands.to_pixels(fused, r.cols), (), r.w, r.h, r.cols))


@query(_fused("blend"))
def fuse_blend(spark: SparkSession, sf: str) -> DataFrame:
    return _fuse(spark, sf, fusion.rule("blend"))


@query(_fused("select"))
def fuse_select(spark: SparkSession, sf: str) -> DataFrame:
    return _fuse(spark, sf, fusion.rule("select", 2))


# Measures.

GRAD = (("v", S.VEC), ("gr", f"""SELECT {SF}, y, x, v, coalesce(gx * gx + gy * gy, 0) AS grad FROM (SELECT *, lead(v) OVER a - lag(v) OVER a AS gx, lead(v) OVER b - lag(v) OVER b AS gy
  FROM v WINDOW a AS (PARTITION BY stack, frame_idx, y ORDER BY x), b AS (PARTITION BY stack, frame_idx, x ORDER BY y))"""),
    ("ct", f"SELECT {SF}, max(grad) FILTER (WHERE rn = floor(n * 0.98)) AS hi, max(grad) FILTER (WHERE rn = floor(n * 0.5)) AS lo FROM (SELECT {SF}, grad, row_number() OVER (PARTITION BY stack, frame_idx ORDER BY grad) - 1 AS rn, count(*) OVER (PARTITION BY stack, frame_idx) AS n FROM gr) GROUP BY {SF}"),
    ("mk", "SELECT g.stack, g.frame_idx, g.y, g.x, g.v, g.grad, g.grad >= c.hi AS edge, g.grad <= c.lo AS flat FROM gr g JOIN ct c ON c.stack = g.stack AND c.frame_idx = g.frame_idx"))


@query(S.with_(*GRAD, then="SELECT stack, frame_idx, y, x, v, CAST(grad AS BIGINT) AS grad, edge, flat FROM mk"))
def gradient_masks(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.gradient_masks(embedding_frames(spark, sf), "v").withColumn("grad", F.col("grad").cast("long"))


@query(S.with_(*GRAD, ("lap", S.laplacian("v", SF, "v", S.VEC_AT)), then=f"""SELECT m.stack, m.frame_idx, round(avg(l.v) FILTER (WHERE m.edge), 3) AS detail, round(avg(l.v) FILTER (WHERE m.flat), 3) AS bokeh
FROM mk m JOIN lap l ON l.stack = m.stack AND l.frame_idx = m.frame_idx AND l.y = m.y AND l.x = m.x GROUP BY m.stack, m.frame_idx"""))
def masked_energy(spark: SparkSession, sf: str) -> DataFrame:
    r = embedding_frames(spark, sf)
    out = metrics.masked_energy(metrics.gradient_masks(r, "v"), stencil.laplacian_energy(r).df, r.at, list(r.keys), "v")
    return out.select(*r.keys, F.round("detail", 3).alias("detail"), F.round("bokeh", 3).alias("bokeh"))


@query(S.with_(*FOCUS, then="""SELECT a.stack, round(a.m, 3) AS per_pixel, round(b.m, 3) AS single FROM (SELECT stack, avg(m) AS m FROM (SELECT stack, y, x, max(v) AS m FROM lap GROUP BY 1, 2, 3) GROUP BY 1) a
JOIN (SELECT stack, max(m) AS m FROM (SELECT stack, frame_idx, avg(v) AS m FROM lap GROUP BY 1, 2) GROUP BY 1) b ON a.stack = b.stack"""))
def oracle_ceiling(spark: SparkSession, sf: str) -> DataFrame:
    out = metrics.oracle_ceiling(stencil.laplacian_energy(embedding_frames(spark, sf)), "v")
    return out.select("stack", F.round("per_pixel", 3).alias("per_pixel"), F.round("single", 3).alias("single"))


def _first_and_smooth(spark: SparkSession, sf: str) -> tuple[Raster, Raster]:
    r = embedding_frames(spark, sf)
    return r, stencil.box_sum(r, 1)


@query(S.with_(*GRAD, ("sm", S.box_sum("v", SF, "v", S.VEC_AT, 1)), then="""SELECT m.stack, m.frame_idx, round(sqrt(avg(CAST((m.v - s.v) * (m.v - s.v) AS DOUBLE))), 6) AS rmse, round(sqrt(avg(CAST((m.v - s.v) * (m.v - s.v) AS DOUBLE)) FILTER (WHERE m.edge)), 6) AS rmse_edges
FROM mk m JOIN sm s ON s.stack = m.stack AND s.frame_idx = m.frame_idx AND s.y = m.y AND s.x = m.x GROUP BY m.stack, m.frame_idx"""))
def rmse_edges(spark: SparkSession, sf: str) -> DataFrame:
    a, b = _first_and_smooth(spark, sf)
    return metrics.rmse(a, b, "v", metrics.gradient_masks(a, "v")).select(*a.keys, F.round("rmse", 6).alias("rmse"), F.round("rmse_edges", 6).alias("rmse_edges"))


@query(S.with_(("v", S.VEC), ("sm", S.box_sum("v", SF, "v", S.VEC_AT, 1)), then="""SELECT v.stack, v.frame_idx, v.y, round(avg(abs(v.v - s.v)), 6) AS mae
FROM v JOIN sm s ON s.stack = v.stack AND s.frame_idx = v.frame_idx AND s.y = v.y AND s.x = v.x GROUP BY 1, 2, 3 ORDER BY mae DESC, 1, 2, 3 LIMIT 8"""))
def row_mae_top8(spark: SparkSession, sf: str) -> DataFrame:
    a, b = _first_and_smooth(spark, sf)
    rows = metrics.row_errors(a, b, "v").select(*a.keys, "y", F.round("mae", 6).alias("mae"))
    return rows.orderBy(F.desc("mae"), *a.keys, "y").limit(8)


@query(S.with_(("v", S.VEC), ("sm", S.box_sum("v", SF, "v", S.VEC_AT, 1)), ("m", """SELECT v.stack, v.frame_idx, v.y, avg(abs(v.v - s.v)) AS mae
FROM v JOIN sm s ON s.stack = v.stack AND s.frame_idx = v.frame_idx AND s.y = v.y AND s.x = v.x GROUP BY 1, 2, 3"""), then="""SELECT stack, frame_idx, round(avg(mae), 6) AS mean, round(max(mae), 6) AS worst,
  round(max(mae) FILTER (WHERE rn = n // 2), 6) AS median, round(max(mae) / max(mae) FILTER (WHERE rn = n // 2), 6) AS ratio
FROM (SELECT *, row_number() OVER (PARTITION BY stack, frame_idx ORDER BY mae) - 1 AS rn, count(*) OVER (PARTITION BY stack, frame_idx) AS n FROM m) GROUP BY 1, 2"""))
def row_error_summary(spark: SparkSession, sf: str) -> DataFrame:
    a, b = _first_and_smooth(spark, sf)
    out = metrics.row_error_summary(metrics.row_errors(a, b, "v"), list(a.keys))
    return out.select(*a.keys, *[F.round(c, 6).alias(c) for c in ("mean", "worst", "median", "ratio")])


@query(S.with_(*HOT_W[:3], then=f"SELECT e.y, e.x, round(sum(w.w * ({LUMA})) / {WHITE}::DOUBLE, 6) AS l FROM e JOIN w ON w.frame_idx = e.frame_idx AND w.y = e.y AND w.x = e.x GROUP BY 1, 2"))
def weighted_luma(spark: SparkSession, sf: str) -> DataFrame:
    r = event_frames(spark, sf)
    out = metrics.weighted_mean(event_luma(r), event_weights(r), "l")
    return out.select("y", "x", F.round(F.col("l") / WHITE, 6).alias("l"))


CHROMA = """SELECT frame_idx, stddev_pop(0.564::DOUBLE * (b - l)) AS sd_cb, stddev_pop(0.713::DOUBLE * (r - l)) AS sd_cr, avg(l) AS mean_y FROM (SELECT *, 0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b AS l FROM e) GROUP BY frame_idx"""


@query(S.with_(("e", S.EVT), ("c", CHROMA), then="""SELECT a.frame_idx, round(a.sd_cb, 3) AS sd_cb, round(a.sd_cr, 3) AS sd_cr, round(a.mean_y, 3) AS mean_y,
  (SELECT b.frame_idx FROM c b WHERE b.frame_idx <> a.frame_idx ORDER BY abs(a.mean_y - b.mean_y), b.frame_idx LIMIT 1) AS nearest FROM c a"""))
def chroma_sd(spark: SparkSession, sf: str) -> DataFrame:
    c = metrics.chroma(event_frames(spark, sf))
    both = c.join(metrics.nearest_frame(c, "mean_y"), "frame_idx")
    return both.select("frame_idx", *[F.round(n, 3).alias(n) for n in ("sd_cb", "sd_cr", "mean_y")], "nearest")


@query(S.with_(("e", S.EVT), then="""SELECT *, p99 - p1 AS contrast FROM (SELECT frame_idx, CAST(max(g) FILTER (WHERE rn = floor(n * 0.01)) AS BIGINT) AS p1, CAST(max(g) FILTER (WHERE rn = floor(n * 0.5)) AS BIGINT) AS p50, CAST(max(g) FILTER (WHERE rn = floor(n * 0.99)) AS BIGINT) AS p99
FROM (SELECT frame_idx, g, row_number() OVER (PARTITION BY frame_idx ORDER BY g) - 1 AS rn, count(*) OVER (PARTITION BY frame_idx) AS n FROM e) GROUP BY frame_idx)"""))
def luma_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.at_rank(event_frames(spark, sf).df, ["frame_idx"], "g", {"p1": 0.01, "p50": 0.5, "p99": 0.99}).withColumn("contrast", F.col("p99") - F.col("p1"))


@query(S.with_(("v", S.VEC), ("sm", S.box_sum("v", SF, "v", S.VEC_AT, 1)), then="""SELECT r.stack, CAST(sum(CASE WHEN r.v > e.hi THEN 1 ELSE 0 END) AS BIGINT) AS above, CAST(sum(CASE WHEN r.v < e.lo THEN 1 ELSE 0 END) AS BIGINT) AS below
FROM (SELECT stack, y, x, v FROM sm WHERE frame_idx = 0) r JOIN (SELECT stack, y, x, min(v) AS lo, max(v) AS hi FROM v GROUP BY 1, 2, 3) e ON e.stack = r.stack AND e.y = r.y AND e.x = r.x GROUP BY r.stack"""))
def envelope(spark: SparkSession, sf: str) -> DataFrame:
    r, s = _first_and_smooth(spark, sf)
    return metrics.envelope(r, Raster(s.df.where("frame_idx = 0").drop("frame_idx"), ("stack",), 8, 8, ("v",)), "v")


@query(S.with_(("v", S.VEC), ("f", "SELECT stack, frame_idx, y, x, ln(1 + greatest(v, 0)) AS t FROM v"), ("m", "SELECT stack, frame_idx, min(t) AS lo, max(t) AS hi FROM f GROUP BY 1, 2"),
    then="SELECT f.stack, f.frame_idx, f.y, f.x, round(CASE WHEN m.hi - m.lo > 1e-12 THEN (f.t - m.lo) / (m.hi - m.lo) ELSE 0 END, 6) AS t FROM f JOIN m ON m.stack = f.stack AND m.frame_idx = f.frame_idx"))
def debug_plane(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(pipeline.display_plane(embedding_frames(spark, sf), "v"))


@query(S.with_(("v", S.VEC), ("n", "SELECT stack, max(frame_idx) + 1 AS n FROM v GROUP BY 1"),
    then="SELECT v.stack, v.frame_idx, round(avg(v.v), 6) AS mean FROM v JOIN n ON n.stack = v.stack WHERE v.frame_idx IN (0, n.n // 2, n.n - 1) GROUP BY 1, 2"))
def sampled_frame_means(spark: SparkSession, sf: str) -> DataFrame:
    r = embedding_frames(spark, sf)
    return pipeline.sampled_of_each(r.df, "stack").groupBy(*r.keys).agg(F.round(F.coalesce(F.avg("v"), F.lit(0.0)), 6).alias("mean"))


SWEEP = ((1, 1e-4), (1, 1e-1), (2, 1e-4), (2, 1e-1))


def _sweep_sql() -> str:
    steps = [*HOT[:3], ("gr", """SELECT frame_idx, y, x, coalesce(gx * gx + gy * gy, 0) AS grad FROM (SELECT *, lead(i) OVER a - lag(i) OVER a AS gx, lead(i) OVER b - lag(i) OVER b AS gy
  FROM h WINDOW a AS (PARTITION BY frame_idx, y ORDER BY x), b AS (PARTITION BY frame_idx, x ORDER BY y))""")]
    steps.append(("ct", "SELECT frame_idx, max(grad) FILTER (WHERE rn = floor(n * 0.98)) AS hi, max(grad) FILTER (WHERE rn = floor(n * 0.5)) AS lo FROM (SELECT frame_idx, grad, row_number() OVER (PARTITION BY frame_idx ORDER BY grad) - 1 AS rn, count(*) OVER (PARTITION BY frame_idx) AS n FROM gr) GROUP BY frame_idx"))
    out = []
    for k, (radius, epsilon) in enumerate(SWEEP):
        steps.append((f"mo{k}", S.box_mean("(SELECT *, i * p AS ip, i * i AS ii FROM h)", "frame_idx", "i, p, ip, ii", S.EVT_AT, radius)))
        steps.append((f"ab{k}", f"SELECT frame_idx, y, x, a, p - a * i AS b FROM (SELECT *, (ip - i * p) / (ii - i * i + {epsilon}) AS a FROM mo{k})"))
        steps.append((f"me{k}", S.box_mean(f"ab{k}", "frame_idx", "a, b", S.EVT_AT, radius)))
        out.append(f"""SELECT {radius} AS radius, {epsilon}::DOUBLE AS epsilon, h.frame_idx, round(avg(greatest(m.a * h.i + m.b, 0)) FILTER (WHERE g.grad >= c.hi), 6) AS detail, round(avg(greatest(m.a * h.i + m.b, 0)) FILTER (WHERE g.grad <= c.lo), 6) AS bokeh
FROM h JOIN me{k} m ON m.frame_idx = h.frame_idx AND m.y = h.y AND m.x = h.x JOIN gr g ON g.frame_idx = h.frame_idx AND g.y = h.y AND g.x = h.x JOIN ct c ON c.frame_idx = h.frame_idx GROUP BY h.frame_idx""")
    return S.with_(*steps, then=" UNION ALL ".join(out))


@query(_sweep_sql())
def param_sweep(spark: SparkSession, sf: str) -> DataFrame:
    """The guided filter at each radius and epsilon: mean weight on a frame's strong edges and in its flat half."""
    r = event_mask(event_frames(spark, sf))
    masks = metrics.gradient_masks(r, "i")
    out = None
    for radius, epsilon in SWEEP:
        q = weights.refine(r, "i", "p", radius, epsilon)
        one = metrics.masked_energy(masks, q.df, r.at, list(r.keys), "w")
        one = one.select(F.lit(radius).alias("radius"), F.lit(epsilon).alias("epsilon"), "frame_idx", F.round("detail", 6).alias("detail"), F.round("bokeh", 6).alias("bokeh"))
        out = one if out is None else out.unionByName(one)
    return out


@query(S.with_(("v", S.VEC), ("sm", S.box_sum("v", SF, "v", S.VEC_AT, 1)), then="""SELECT a.stack, a.frame_idx, round(pow(a.s / b.s, 2), 6) AS frames FROM (SELECT stack, frame_idx, stddev_pop(v) AS s FROM v GROUP BY 1, 2) a
JOIN (SELECT stack, frame_idx, stddev_pop(v / 9.0::DOUBLE) AS s FROM sm GROUP BY 1, 2) b ON a.stack = b.stack AND a.frame_idx = b.frame_idx"""))
def effective_frames(spark: SparkSession, sf: str) -> DataFrame:
    r, s = _first_and_smooth(spark, sf)
    a = r.df.groupBy(*r.keys).agg(F.stddev_pop("v").alias("a"))
    b = s.df.groupBy(*r.keys).agg(F.stddev_pop(F.col("v") / 9.0).alias("b"))
    return a.join(b, list(r.keys)).select(*r.keys, F.round(metrics.effective_frames(F.col("a"), F.col("b")), 6).alias("frames"))


@query("""SELECT g AS gib, CAST(least(greatest(floor(CAST(g AS BIGINT) * 1073741824 * 0.25::DOUBLE), 17179869184), floor(CAST(g AS BIGINT) * 1073741824 * 0.9::DOUBLE)) AS BIGINT) AS limit_bytes FROM (SELECT unnest([8, 18, 36, 64, 128]) AS g)""")
def memory_limit(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame([(g, control.memory_limit(g << 30)) for g in (8, 18, 36, 64, 128)], "gib int, limit_bytes long")


# The checksum, and array kernels: those have no SQL form, so rows only here and brute force in the tests.


@query()
def phase_correlate(spark: SparkSession, sf: str) -> DataFrame:
    return registration.correlate(registration.texture_pairs(spark))


@query()
def region_spread(spark: SparkSession, sf: str) -> DataFrame:
    return registration.spreads(registration.texture_pairs(spark, scales=(1.0, 1.03)))


@query()
def similarity_register(spark: SparkSession, sf: str) -> DataFrame:
    return registration.register(registration.texture_pairs(spark, scales=(1.0, 1.02, 0.97)))


@query(S.with_(("v", S.VEC), ("h", "SELECT CAST('0x' || substr(md5(concat_ws(',', stack, frame_idx, y, x, v)), 1, 15) AS BIGINT) AS h FROM v"),
    then="SELECT count(*) AS n, bit_xor(h) AS x, CAST(sum(h & 4294967295) AS BIGINT) AS s FROM h"))
def frame_checksum(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.checksum(embedding_frames(spark, sf))


@query()
def fuse_pipeline(spark: SparkSession, sf: str) -> DataFrame:
    r = event_frames(spark, sf)
    lines = stacking.fuse_lines(bands.from_pixels(r.df, r.cols, r.w, r.h), 5, pipeline.small_params(), control.RunControl(spark))
    return bands.to_pixels(lines, r.cols)
