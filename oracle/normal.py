"""DuckDB text of the normal CDF and quantile, from the same published constants."""

from __future__ import annotations

from barloom.functions.stats import (
    CDF_DEN, CDF_NUM, PPF_FAR_DEN, PPF_FAR_NUM, PPF_MID_DEN, PPF_MID_NUM, PPF_NEAR_DEN, PPF_NEAR_NUM,
)


def _poly(x: str, terms) -> str:
    text = f"{float(terms[0]):.17e}"
    for k in terms[1:]:
        text = f"({text} * {x} + {float(k):.17e})"
    return text


def norm_cdf_text(x: str) -> str:
    """SQL of the normal CDF, good to about 1e-15."""
    a = f"abs({x})"
    body = f"exp(-{a} * {a} / 2) * {_poly(a, CDF_NUM)} / {_poly(a, CDF_DEN)}"
    tail = f"exp(-{a} * {a} / 2) / ({a} + 1 / ({a} + 2 / ({a} + 3 / ({a} + 4 / ({a} + 6.5e-1))))) / 2.506628274631e0"
    low = f"CASE WHEN {a} > 37 THEN 0.0 WHEN {a} < 7.07106781186547 THEN {body} ELSE {tail} END"
    return f"CASE WHEN {x} > 0 THEN 1.0 - {low} ELSE {low} END"


def norm_ppf_text(p: str) -> str:
    """SQL of the normal quantile for 0 < p < 1."""
    q = f"({p} - 5e-1)"
    m = f"(1.80625e-1 - {q} * {q})"
    r = f"sqrt(-ln(least({p}, 1e0 - {p})))"
    side = f"CASE WHEN {q} < 0 THEN -1.0 ELSE 1.0 END"
    near, far = f"({r} - 1.6e0)", f"({r} - 5e0)"
    return (
        f"CASE WHEN abs({q}) <= 0.425 THEN {q} * {_poly(m, PPF_MID_NUM)} / {_poly(m, PPF_MID_DEN)}"
        f" WHEN {r} <= 5.0 THEN {side} * {_poly(near, PPF_NEAR_NUM)} / {_poly(near, PPF_NEAR_DEN)}"
        f" ELSE {side} * {_poly(far, PPF_FAR_NUM)} / {_poly(far, PPF_FAR_DEN)} END"
    )
