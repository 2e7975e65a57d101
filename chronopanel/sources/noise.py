"""Random reference series."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chronopanel.panel import Panel


#: Draws have this many values.
DRAWS = 2**52


def draw_bits(*parts: Column | int) -> Column:
    """A whole number below DRAWS from the parts' texts; the same in every engine that has md5."""
    text = F.concat_ws("|", *[(F.lit(p) if isinstance(p, int) else p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")


def draw_sql(*parts: str) -> str:
    """The same in SQL."""
    return f"CAST('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 13) AS BIGINT)"


def white_noise(panel: Panel, name: str = "wn", seed: int = 1) -> Panel:
    """A standard normal draw per row.

    The draw hashes key, index and seed (Box-Muller), so a recomputed task
    repeats it whatever the partitioning.
    """
    at = [F.col(c) for c in (*panel.key, panel.index)]

    def uniform(salt: int):
        return (draw_bits(seed, salt, *at).cast("double") + 0.5) / float(DRAWS)

    wave = F.cos(uniform(2) * (2 * 3.141592653589793))
    return panel.on(panel.df.withColumn(name, F.sqrt(-2 * F.log(uniform(1))) * wave))


def noise_ctes(src: str, seed: int, key: list[str], index: str) -> list[str]:
    """SQL: table ``noise``, the rows of ``src`` with the same draw ``wn``."""
    at = [*key, f"CAST(CAST({index} AS DATE) AS VARCHAR)"]
    u = [f"({draw_sql(str(seed), str(salt), *at)} + 0.5) / {DRAWS}.0" for salt in (1, 2)]
    return [f"noise AS (SELECT *, sqrt(-2 * ln({u[0]})) * cos(2 * pi() * ({u[1]})) AS wn FROM {src})"]
