"""Least squares in SQL, one column after the other."""

from __future__ import annotations


def projected(src: str, key: str, y: str, xs: list[str], keep: str = "", name: str = "gs") -> list[str]:
    """CTEs <name>0..<name>k: y and the columns centred, then one column after the other taken out of all that follow.

    A column that the earlier ones explain takes out nothing.  ``keep`` names columns to carry along.
    """

    def over(e: str) -> str:
        return f"{e} OVER (PARTITION BY {key})"

    carried = [key, *([keep] if keep else [])]
    out = [f"{name}0 AS MATERIALIZED (SELECT " + ", ".join([*carried, *[f"{c} - {over(f'avg({c})')} AS {c}" for c in [y, *xs]]]) + f" FROM {src})"]
    for j, x in enumerate(xs):
        own = over(f"sum({x} * {x})")
        rest = [f"{c} - {x} * coalesce({over(f'sum({c} * {x})')} / CASE WHEN {own} > 1e-9 THEN {own} END, 0) AS {c}" for c in [y, *xs[j + 1 :]]]
        out.append(f"{name}{j + 1} AS MATERIALIZED (SELECT {', '.join([*carried, *rest])} FROM {name}{j})")
    return out
