"""SQL of the raster queries, composed of select statements; stencils are joins on clamped keys."""

from __future__ import annotations

VEC = """SELECT label AS stack, frame_idx, CAST(i // 8 AS INTEGER) AS y, CAST(i % 8 AS INTEGER) AS x, CAST(round(CAST(e AS DOUBLE) * 10000) AS BIGINT) AS v
FROM (SELECT label, frame_idx, unnest(range(64)) AS i, unnest(embedding) AS e
      FROM (SELECT label, embedding, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS INTEGER) AS frame_idx FROM embeddings))"""

EVT = """SELECT f.frame_idx, CAST(gy.y AS INTEGER) AS y, CAST(gx.x AS INTEGER) AS x,
  CAST(coalesce(c.r, 0) AS BIGINT) AS r, CAST(coalesce(c.g, 0) AS BIGINT) AS g, CAST(coalesce(c.b, 0) AS BIGINT) AS b
FROM (SELECT event_type, CAST(row_number() OVER (ORDER BY event_type) - 1 AS INTEGER) AS frame_idx FROM (SELECT DISTINCT event_type FROM events)) f
CROSS JOIN (SELECT unnest(range(30)) AS y) gy CROSS JOIN (SELECT unnest(range(24)) AS x) gx
LEFT JOIN (SELECT event_type, day(ts) - 1 AS y, hour(ts) AS x, count(*) AS r, sum(CAST(round(value * 100) AS BIGINT)) AS g, count(DISTINCT user_id) AS b
           FROM events WHERE day(ts) <= 30 GROUP BY 1, 2, 3) c ON c.event_type = f.event_type AND c.y = gy.y AND c.x = gx.x"""

XF = "SELECT CAST(k AS INTEGER) AS frame_idx, 1 + (k - 2) / 64.0::DOUBLE AS scale, (k - 2) / 4.0::DOUBLE AS dx, -(k - 2) / 8.0::DOUBLE AS dy FROM (SELECT unnest(range(5)) AS k)"

EVT_AT = (24, 30)
VEC_AT = (8, 8)


def _keys(keys: str, a: str = "p", b: str = "q") -> str:
    return " AND ".join(f"{a}.{k} = {b}.{k}" for k in keys.split(", ")) if keys else "true"


def _of(keys: str, a: str = "p") -> str:
    return "".join(f"{a}.{k}, " for k in keys.split(", ")) if keys else ""


def with_(*named: tuple[str, str], then: str) -> str:
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({q})" for n, q in named) + "\n" + then


def box_sum(src: str, keys: str, cols: str, size: tuple[int, int], radius: int) -> str:
    w, h = size
    sums = ", ".join(f"sum(q.{c}) AS {c}" for c in cols.split(", "))
    near = f"(SELECT unnest(range(-{radius}, {radius + 1})) AS d)"
    return f"""SELECT {_of(keys)}p.y, p.x, {sums} FROM {src} p CROSS JOIN {near} dx CROSS JOIN {near} dy
JOIN {src} q ON {_keys(keys)} AND q.y = least(greatest(p.y + dy.d, 0), {h - 1}) AND q.x = least(greatest(p.x + dx.d, 0), {w - 1})
GROUP BY {_of(keys)}p.y, p.x"""


def box_mean(src: str, keys: str, cols: str, size: tuple[int, int], radius: int) -> str:
    n = float((2 * radius + 1) ** 2)
    cells = ", ".join(f"{c} / {n} AS {c}" for c in cols.split(", "))
    return f"SELECT {keys}, y, x, {cells} FROM ({box_sum(src, keys, cols, size, radius)})"


def laplacian(src: str, keys: str, col: str, size: tuple[int, int]) -> str:
    w, h = size

    def at(name: str, y: str, x: str) -> str:
        return f"JOIN {src} {name} ON {_keys(keys, 'p', name)} AND {name}.y = {y} AND {name}.x = {x}"

    e = f"(a.{col} + b.{col} + c.{col} + d.{col} - 4 * p.{col})"
    return f"""SELECT {_of(keys)}p.y, p.x, {e} * {e} AS {col} FROM {src} p
{at('a', 'p.y', 'greatest(p.x - 1, 0)')} {at('b', 'p.y', f'least(p.x + 1, {w - 1})')}
{at('c', 'greatest(p.y - 1, 0)', 'p.x')} {at('d', f'least(p.y + 1, {h - 1})', 'p.x')}"""


def argmax(src: str, rest: str, col: str) -> str:
    group = f"{rest}, " if rest else ""
    return f"""SELECT {group}y, x, frame_idx AS label, {col} FROM (
SELECT *, row_number() OVER (PARTITION BY {group}y, x ORDER BY {col} DESC, frame_idx) AS rn FROM {src}) WHERE rn = 1"""


def warp(src: str, cols: str, size: tuple[int, int], clamp: bool = True) -> str:
    w, h = size
    held = (lambda e, n: f"least(greatest({e}, 0), {n - 1})") if clamp else (lambda e, n: e)
    sums = ", ".join(f"CAST(coalesce(sum(t.k * q.{c}), 0) AS DOUBLE) AS {c}" for c in cols.split(", "))
    return f"""SELECT t.frame_idx, t.y, t.x, {sums} FROM (
  SELECT frame_idx, y, x, CAST(floor(sy) AS INTEGER) + j AS ty, CAST(floor(sx) AS INTEGER) + i AS tx,
    (CASE WHEN i = 1 THEN sx - floor(sx) ELSE 1 - (sx - floor(sx)) END) * (CASE WHEN j = 1 THEN sy - floor(sy) ELSE 1 - (sy - floor(sy)) END) AS k
  FROM (SELECT p.frame_idx, p.y, p.x, s.scale * (p.x - {w / 2}::DOUBLE) + s.dx + {w / 2}::DOUBLE AS sx, s.scale * (p.y - {h / 2}::DOUBLE) + s.dy + {h / 2}::DOUBLE AS sy FROM {src} p JOIN xf s ON s.frame_idx = p.frame_idx)
  CROSS JOIN (SELECT unnest([0, 1]) AS i) CROSS JOIN (SELECT unnest([0, 1]) AS j)) t
{'JOIN' if clamp else 'LEFT JOIN'} {src} q ON q.frame_idx = t.frame_idx AND q.y = {held('t.ty', h)} AND q.x = {held('t.tx', w)}
GROUP BY t.frame_idx, t.y, t.x"""


def reduce(src: str, keys: str, cols: str, size: tuple[int, int]) -> str:
    w, h = size
    kernel = "(SELECT unnest([0, 1, 2, 3, 4]) AS d, unnest([1, 4, 6, 4, 1]) / 16.0::DOUBLE AS k)"
    sums = ", ".join(f"sum(kx.k * ky.k * q.{c}) AS {c}" for c in cols.split(", "))
    return f"""SELECT {_of(keys)}CAST(p.y // 2 AS INTEGER) AS y, CAST(p.x // 2 AS INTEGER) AS x, {sums}
FROM {src} p CROSS JOIN {kernel} kx CROSS JOIN {kernel} ky
JOIN {src} q ON {_keys(keys)} AND q.y = least(greatest(p.y + ky.d - 2, 0), {h - 1}) AND q.x = least(greatest(p.x + kx.d - 2, 0), {w - 1})
WHERE p.y % 2 = 0 AND p.x % 2 = 0 GROUP BY {_of(keys)}p.y // 2, p.x // 2"""


def expand(src: str, keys: str, cols: str, size: tuple[int, int], to: tuple[int, int]) -> str:
    (w, h), (tw, th) = size, to
    taps = "(SELECT unnest([0, 0, 0, 1, 1]) AS o, unnest([-1, 0, 1, 0, 1]) AS d, unnest([0.125, 0.75, 0.125, 0.5, 0.5])::DOUBLE AS k)"
    sums = ", ".join(f"sum(kx.k * ky.k * q.{c}) AS {c}" for c in cols.split(", "))
    frames = f"(SELECT DISTINCT {keys} FROM {src})" if keys else "(SELECT 1)"
    return f"""SELECT {_of(keys)}CAST(ty AS INTEGER) AS y, CAST(tx AS INTEGER) AS x, {sums}
FROM {frames} p CROSS JOIN (SELECT unnest(range({th})) AS ty) CROSS JOIN (SELECT unnest(range({tw})) AS tx)
JOIN {taps} kx ON kx.o = tx % 2 JOIN {taps} ky ON ky.o = ty % 2
JOIN {src} q ON {_keys(keys)} AND q.y = least(greatest(ty // 2 + ky.d, 0), {h - 1}) AND q.x = least(greatest(tx // 2 + kx.d, 0), {w - 1})
GROUP BY {_of(keys)}ty, tx"""


def combine(a: str, b: str, keys: str, cols: str, sign: str) -> str:
    cells = ", ".join(f"CAST(p.{c} {sign} q.{c} AS DOUBLE) AS {c}" for c in cols.split(", "))
    return f"SELECT {_of(keys)}p.y, p.x, {cells} FROM {a} p JOIN {b} q ON {_keys(keys)} AND p.y = q.y AND p.x = q.x"


def coverage(size: tuple[int, int]) -> str:
    def side(n: int, s: str, lo: str, hi: str) -> str:
        a = f"least(greatest(ceil({n / 2}::DOUBLE + (-{s} - {n / 2}::DOUBLE) / scale), 0), {n})"
        b = f"greatest(least(greatest(floor({n / 2}::DOUBLE + ({n - 1} - {s} - {n / 2}::DOUBLE) / scale) + 1, 0), {n}), {a})"
        a2 = f"(CASE WHEN {a} > 0 THEN {a} + 2 ELSE {a} END)"
        b2 = f"(CASE WHEN {b} < {n} THEN greatest({b} - 2, 0) ELSE {b} END)"
        return f"CAST({a2} AS INTEGER) AS {lo}, CAST(greatest({b2}, {a2}) AS INTEGER) AS {hi}"

    return f"SELECT frame_idx, {side(size[0], 'dx', 'x0', 'x1')}, {side(size[1], 'dy', 'y0', 'y1')} FROM xf"


def cover_reduced(src: str, size: tuple[int, int], key: str = "frame_idx, ") -> str:
    def hi(c: str, n: int) -> str:
        return f"CAST(CASE WHEN {c} >= {n} THEN {-(-n // 2)} ELSE {c} // 2 END AS INTEGER) AS {c}"

    return f"SELECT {key}CAST((x0 + 1) // 2 AS INTEGER) AS x0, CAST((y0 + 1) // 2 AS INTEGER) AS y0, {hi('x1', size[0])}, {hi('y1', size[1])} FROM {src}"


EVERY = "SELECT max(x0) AS x0, max(y0) AS y0, greatest(min(x1), max(x0)) AS x1, greatest(min(y1), max(y0)) AS y1 FROM {}"


def select_level(src: str, sal: str, rects: str | None, size: tuple[int, int], cols: str = "r, g, b") -> str:
    inside = f"JOIN {rects} c ON c.frame_idx = p.frame_idx AND p.x >= c.x0 AND p.x < c.x1 AND p.y >= c.y0 AND p.y < c.y1" if rects else ""
    cells = ", ".join(f"CAST(coalesce(m.{c}, 0) AS DOUBLE) AS {c}" for c in cols.split(", "))
    return f"""SELECT CAST(gy AS INTEGER) AS y, CAST(gx AS INTEGER) AS x, {cells}
FROM (SELECT unnest(range({size[1]})) AS gy) CROSS JOIN (SELECT unnest(range({size[0]})) AS gx)
LEFT JOIN (SELECT * FROM (SELECT p.*, row_number() OVER (PARTITION BY p.y, p.x ORDER BY s.s DESC, p.frame_idx) AS rn
  FROM {src} p JOIN {sal} s ON s.frame_idx = p.frame_idx AND s.y = p.y AND s.x = p.x {inside}) WHERE rn = 1) m ON m.y = gy AND m.x = gx"""


def accumulate(src: str, weights: str, rects: str | None, size: tuple[int, int], cols: str = "r, g, b") -> str:
    inside = f"JOIN {rects} c ON c.frame_idx = p.frame_idx AND p.x >= c.x0 AND p.x < c.x1 AND p.y >= c.y0 AND p.y < c.y1" if rects else ""
    sums = ", ".join(f"sum(q.w * p.{c}) AS {c}" for c in cols.split(", "))
    cells = ", ".join(f"CAST(coalesce(m.{c}, 0) AS DOUBLE) AS {c}" for c in [*cols.split(", "), "tally"])
    return f"""SELECT CAST(gy AS INTEGER) AS y, CAST(gx AS INTEGER) AS x, {cells}
FROM (SELECT unnest(range({size[1]})) AS gy) CROSS JOIN (SELECT unnest(range({size[0]})) AS gx)
LEFT JOIN (SELECT p.y, p.x, {sums}, sum(q.w) AS tally FROM {src} p JOIN {weights} q ON q.frame_idx = p.frame_idx AND q.y = p.y AND q.x = p.x {inside}
  GROUP BY p.y, p.x) m ON m.y = gy AND m.x = gx"""


def uncovered(acc: str, every: str, cols: str = "r, g, b") -> str:
    keep = "(p.x >= e.x0 AND p.x < e.x1 AND p.y >= e.y0 AND p.y < e.y1) OR p.tally <= 0"
    cells = ", ".join(f"CASE WHEN {keep} THEN p.{c} ELSE p.{c} / p.tally END AS {c}" for c in cols.split(", "))
    return f"SELECT p.y, p.x, {cells} FROM {acc} p CROSS JOIN {every} e"


def rounded(src: str, keys: str, cols: str, digits: int = 6) -> str:
    cells = ", ".join(f"round(CAST({c} AS DOUBLE), {digits}) AS {c}" for c in cols.split(", "))
    return f"SELECT {keys}{', ' if keys else ''}y, x, {cells} FROM {src}"
