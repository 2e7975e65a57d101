"""SQL of the seasonal-trend decomposition by loess.

Without robust weights loess is linear: the smoothed value is a fixed combination
of the rows.  The combination weights depend on the series' length and the span
only, so one table (n, i, j, w) per span is joined to the rows and summed.  With
robust weights every series has its own table, built anew in each round.
"""

from __future__ import annotations


def _places(name: str, sizes: str, ends: bool) -> list[str]:
    """Points ``pt`` (1-based) at which loess is evaluated, and the first row of each window."""
    edge = f"""
    UNION ALL SELECT *, 0.0::DOUBLE AS pt, 0::BIGINT AS lft FROM {name}_g
    UNION ALL SELECT *, n + 1.0::DOUBLE AS pt, n - width AS lft FROM {name}_g""" if ends else ""
    return [
        f"{name}_g AS MATERIALIZED (SELECT id, CAST(n AS BIGINT) AS n, CAST(span AS BIGINT) AS span, least(span, n)::BIGINT AS width, greatest(least(jump, n - 1), 1)::BIGINT AS step FROM ({sizes}))",
        f"""{name}_a AS MATERIALIZED (SELECT id, n, span, width, step, a + 1.0::DOUBLE AS pt,
    CASE WHEN span < n THEN greatest(0, least(a // step * step + 1 - (span + 1) // 2, n - width)) ELSE 0 END::BIGINT AS lft
    FROM (SELECT *, unnest(range(0, n)) AS a FROM {name}_g) WHERE a % step = 0 OR a = n - 1{edge})""",
    ]


def smoother(name: str, sizes: str, degree: int, ends: bool = False, robust: str | None = None) -> list[str]:
    """CTEs ending in ``name (id, i, j, w)``: value i (0-based) is the sum of w times row j.

    ``sizes`` selects (id, n, span, jump).  With ``ends``, i = -1 and i = n are one
    step beyond the series.  ``robust`` names a table (id, j, rw) of row weights.
    """
    look = f"JOIN {robust} q ON q.id = p.id AND q.j = p.pos - 1" if robust else ""
    rw = " * q.rw" if robust else ""
    tilt = "CASE WHEN sqrt(spread) > 0.001 * greatest(n - 1, 1) THEN (pt - centre) / spread ELSE 0 END"
    line = f"u * ({tilt} * (pos - centre) + 1)" if degree else "u"
    out = _places(name, sizes, ends)
    out += [
        f"""{name}_w AS (SELECT p.*, CASE WHEN dist <= 0.001 * h THEN 1.0 WHEN dist <= 0.999 * h THEN pow(1 - pow(dist / h, 3), 3) ELSE 0 END{rw} AS v FROM (
    SELECT *, abs(pos - pt) AS dist, greatest(pt - lft - 1, lft + width - pt) + CASE WHEN span > n THEN (span - n) // 2 ELSE 0 END AS h
    FROM (SELECT *, unnest(range(lft + 1, lft + width + 1)) AS pos FROM {name}_a)) p {look})""",
        f"{name}_u AS (SELECT *, v / nullif(sum(v) OVER (PARTITION BY id, pt), 0) AS u FROM {name}_w)",
        f"{name}_c AS (SELECT *, sum(u * pos) OVER (PARTITION BY id, pt) AS centre FROM {name}_u)",
        f"{name}_s AS (SELECT *, sum(u * (pos - centre) * (pos - centre)) OVER (PARTITION BY id, pt) AS spread FROM {name}_c)",
        # Where no weight is left, the value is the row itself, beyond the ends the nearest one.
        f"""{name}_p AS MATERIALIZED (SELECT id, n, step, CAST(pt AS BIGINT) - 1 AS a, CAST(pos AS BIGINT) - 1 AS j,
    CASE WHEN u IS NULL THEN CASE WHEN pos = greatest(1, least(n, pt)) THEN 1.0 ELSE 0.0 END ELSE {line} END AS w FROM {name}_s)""",
        f"""{name} AS MATERIALIZED (SELECT id, i, j, sum(w) AS w FROM (
    SELECT id, a AS i, j, w FROM {name}_p WHERE a % step = 0 OR a = n - 1 OR a < 0 OR a = n
    UNION ALL SELECT id, a + k AS i, j, w * (1 - k / span) AS w FROM (SELECT *, least(step, n - 1 - a) AS span, unnest(range(1, least(step, n - 1 - a))) AS k FROM {name}_p WHERE a >= 0 AND a < n - 1 AND a % step = 0)
    UNION ALL SELECT id, a - k AS i, j, w * (1 - k / span) AS w FROM (SELECT *, CASE WHEN a % step = 0 THEN step ELSE a % step END AS span, unnest(range(1, CASE WHEN a % step = 0 THEN step ELSE a % step END)) AS k FROM {name}_p WHERE a > 0 AND a < n AND (a % step = 0 OR a = n - 1))
    ) GROUP BY id, i, j)""",
    ]
    return out


def stl_ctes(
    src: str, key: str, index: str, m: int, y: str = "y", season_window: int | None = 11,
    trend_window: int | None = None, robust: bool = False, name: str = "st",
) -> list[str]:
    """CTEs ending in ``name_parts``: the columns of ``src`` with t, trend, seasonal, remainder, season_adjust.

    ``src`` must hold whole series without missing values.
    """
    k, inner, outer = name, *((1, 15) if robust else (2, 0))
    season = "10 * n + 1" if season_window is None else str(season_window)
    # A long seasonal span leaves 1.5 periods, rounded up to an odd number.
    wide = f"CAST(ceil(1.5 * {m} / (1 - 1.5 / ({season}))) AS BIGINT)"
    trend = str(trend_window) if trend_window else f"({wide} + 1 - {wide} % 2)"
    low = m + 1 - m % 2
    jump = "CAST(ceil(({0}) / 10.0) AS BIGINT)"
    cols = f"{key}, {index}"
    out = [
        f"{k}_r AS MATERIALIZED (SELECT dense_rank() OVER (ORDER BY {key}) AS id, {cols}, CAST({y} AS DOUBLE) AS y, row_number() OVER (PARTITION BY {key} ORDER BY {index}) - 1 AS t FROM {src})",
        f"{k}_n AS MATERIALIZED (SELECT id, count(*) AS n FROM {k}_r GROUP BY id)",
        f"{k}_v AS MATERIALIZED (SELECT id * {m} + c AS id, (n - c + {m - 1}) // {m} AS n, {season} AS span, {jump.format(season)} AS jump FROM {k}_n, range({m}) g(c))",
        f"{k}_x0 AS (SELECT id, t, y, 0.0::DOUBLE AS seasonal, 0.0::DOUBLE AS trend FROM {k}_r)",
    ]
    out += smoother(f"{k}_l", f"SELECT id, n, {low} AS span, {-(-low // 10)} AS jump FROM {k}_n", 1)
    cycles = f"SELECT * FROM {k}_v"
    whole = f"SELECT id, n, {trend} AS span, {jump.format(trend)} AS jump FROM {k}_n"
    if not robust:
        out += smoother(f"{k}_c", cycles, 0, ends=True) + smoother(f"{k}_t", whole, 1)
    rounds = inner * (outer + 1)
    for i in range(1, rounds + 1):
        x, c, tr = f"{k}_x{i - 1}", f"{k}_c", f"{k}_t"
        if robust:
            c, tr = f"{k}_c{i}", f"{k}_t{i}"
            if i > 1:
                out += [
                    f"{k}_q{i} AS (SELECT id, t, abs(y - seasonal - trend) AS e, 6 * median(abs(y - seasonal - trend)) OVER (PARTITION BY id) AS lim FROM {x})",
                    f"{k}_h{i} AS MATERIALIZED (SELECT id, t AS j, CASE WHEN e <= 0.001 * lim THEN 1.0 WHEN e <= 0.999 * lim THEN pow(1 - pow(e / lim, 2), 2) ELSE 0 END AS rw FROM {k}_q{i})",
                    f"{k}_k{i} AS MATERIALIZED (SELECT id * {m} + j % {m} AS id, j // {m} AS j, rw FROM {k}_h{i})",
                ]
            out += smoother(c, cycles, 0, ends=True, robust=f"{k}_k{i}" if i > 1 else None)
            out += smoother(tr, whole, 1, robust=f"{k}_h{i}" if i > 1 else None)
        mean = "SELECT id, {e}, avg(v) OVER (PARTITION BY id ORDER BY e ROWS BETWEEN CURRENT ROW AND {w} FOLLOWING) AS v, count(*) OVER (PARTITION BY id ORDER BY e ROWS BETWEEN CURRENT ROW AND {w} FOLLOWING) AS rows_in FROM {src}"
        runs = [(f"{k}_y{i}", m), (f"{k}_m1_{i}", m), (f"{k}_m2_{i}", 3)]
        out.append(
            f"{k}_y{i} AS MATERIALIZED (SELECT x.id, (w.i + 1) * {m} + x.t % {m} AS e, sum(w.w * (x.y - x.trend)) AS v FROM {x} x "
            f"JOIN {c} w ON w.id = x.id * {m} + x.t % {m} AND w.j = x.t // {m} GROUP BY 1, 2)"
        )
        for at, (source, width) in enumerate(runs, 1):
            body = mean.format(e="e", w=width - 1, src=source)
            out.append(f"{k}_m{at}_{i} AS MATERIALIZED (SELECT id, e, v FROM ({body}) WHERE rows_in = {width})")
        out += [
            f"{k}_z{i} AS (SELECT w.id, w.i AS t, sum(w.w * l.v) AS v FROM {k}_m3_{i} l JOIN {k}_l w ON w.id = l.id AND w.j = l.e GROUP BY 1, 2)",
            f"{k}_s{i} AS MATERIALIZED (SELECT x.id, x.t, x.y, c.v - z.v AS seasonal FROM {x} x JOIN {k}_y{i} c ON c.id = x.id AND c.e = x.t + {m} JOIN {k}_z{i} z ON z.id = x.id AND z.t = x.t)",
            f"{k}_d{i} AS (SELECT w.id, w.i AS t, sum(w.w * (s.y - s.seasonal)) AS trend FROM {k}_s{i} s JOIN {tr} w ON w.id = s.id AND w.j = s.t GROUP BY 1, 2)",
            f"{k}_x{i} AS MATERIALIZED (SELECT s.*, d.trend FROM {k}_s{i} s JOIN {k}_d{i} d USING (id, t))",
        ]
    last = f"avg(seasonal) OVER (PARTITION BY id, t % {m})" if season_window is None else "seasonal"
    out += [
        f"{k}_f AS (SELECT id, t, trend, {last} AS seasonal FROM {k}_x{rounds})",
        f"{k}_parts AS (SELECT {cols}, r.t + 1 AS t, y, trend, seasonal, y - trend - seasonal AS remainder, y - seasonal AS season_adjust FROM {k}_r r JOIN {k}_f f USING (id, t))",
    ]
    return out


def mstl_ctes(src: str, key: str, index: str, periods: tuple[int, ...], y: str = "y", season_window: int = 11, name: str = "ms") -> list[str]:
    """CTEs ending in ``name_parts`` for several periods: each is fitted twice in turn on what the others leave."""
    out, last = [], {}
    for turn in range(2):
        for i, m in enumerate(sorted(periods)):
            step = f"{name}{turn}{i}"
            others = [v for k, v in last.items() if k != m]
            joins = " ".join(f"JOIN (SELECT {key}, {index}, seasonal AS s{j} FROM {o}_parts) {o}_o USING ({key}, {index})" for j, o in enumerate(others))
            rest = " - ".join([f"CAST({y} AS DOUBLE)", *(f"s{j}" for j in range(len(others)))])
            out.append(f"{step}_i AS MATERIALIZED (SELECT {key}, {index}, {rest} AS y FROM {src} {joins})")
            out += stl_ctes(f"{step}_i", key, index, m, season_window=season_window + 4 * i, name=step)
            last[m] = step
    final = list(last.values())
    total = " + ".join(f"{s}_p.seasonal" for s in final)
    joins = " ".join(f"JOIN {s}_parts {s}_p USING ({key}, {index})" for s in final)
    out.append(
        f"{name}_parts AS (SELECT {key}, {index}, y, trend, seasonal, y - trend - seasonal AS remainder, y - seasonal AS season_adjust "
        f"FROM (SELECT {key}, {index}, CAST({src}.{y} AS DOUBLE) AS y, {final[-1]}_p.trend AS trend, {total} AS seasonal FROM {src} {joins}))"
    )
    return out
