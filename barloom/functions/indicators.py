"""Indicators as sheet entries. Null means "not defined yet".

Every function takes the sheet, column texts and lengths, and returns the name
of the result column. Lookbacks count rows of the series.
"""

from __future__ import annotations

import math

from barloom.functions.sheet import Sheet, before, lag, prior_rows, rows, so_far

TR = "CASE WHEN {p} IS NULL THEN h - l ELSE greatest(h - l, abs(h - {p}), abs(l - {p})) END"
MEDIAN_PRICE = "((h + l) / 2)"
TYPICAL = "((h + l + c) / 3)"


PRICES = ("o", "h", "l", "c")  # never null
LONG_FRAME = 32  # a sliding frame costs its length per row; longer means use running sums


def back(s: Sheet, x: str, k: int) -> str:
    """``x`` of ``k`` rows ago as a shared column."""
    return x if k == 0 else s.put(lag(x, k))


def over(s: Sheet, agg: str, x: str, n: int) -> str:
    """``agg`` of the last ``n`` values, null until all ``n`` are defined."""
    full = f"{s.t} >= {n - 1}" if x in PRICES else f"count({x}) {rows(n)} = {n}"
    return s.put(f"CASE WHEN {full} THEN {agg}({x}) {rows(n)} END")


def over_prior(s: Sheet, agg: str, x: str, n: int) -> str:
    w = prior_rows(n)
    full = f"{s.t} >= {n}" if x in PRICES else f"count({x}) {w} = {n}"
    return s.put(f"CASE WHEN {full} THEN {agg}({x}) {w} END")


def prev(s: Sheet, x: str, k: int = 1) -> str:
    return s.put(lag(x, k)) if k else x


# --- averages, extremes, moments ------------------------------------------------

def sma(s, x, n):
    """Mean of the last ``n`` values; long price frames come from a running sum."""
    if x not in PRICES or n <= LONG_FRAME:
        return over(s, "avg", x, n)
    total = s.put(f"sum({x}) {so_far()}")
    # Rounded so that a price equal to its mean stays equal in running sums.
    return s.put(
        f"round(CASE WHEN {s.t} >= {n} THEN ({total} - {back(s, total, n)}) / {n}"
        f" WHEN {s.t} = {n - 1} THEN {total} / {n} END, 9)"
    )


sma_skip_leading = sma


def rolling_max(s, x, n):
    return over(s, "max", x, n)


rolling_max_skip_leading = rolling_max


def rolling_min(s, x, n):
    return over(s, "min", x, n)


rolling_min_skip_leading = rolling_min


def rolling_std(s, x, n):
    return over(s, "stddev_pop", x, n)


def rolling_sum(s, x, n):
    return over(s, "sum", x, n)


sum_skip_leading = rolling_sum


def rolling_sum_from(s, x, n, start):
    return s.put(f"CASE WHEN {s.t} >= {start} THEN sum({x}) {rows(n)} END")


def rolling_median(s, x, n):
    return s.put(
        f"CASE WHEN count({x}) {rows(n)} = {n} THEN percentile({x}, 0.5) {rows(n)} END"
    )


rolling_median_skip_leading = rolling_median


def prior_max(s, x, n):
    return over_prior(s, "max", x, n)


def prior_min(s, x, n):
    return over_prior(s, "min", x, n)


def prior_mean(s, x, n):
    return over_prior(s, "avg", x, n)


def prior_percentile(s, x, n, q):
    w = prior_rows(n)
    return s.put(f"CASE WHEN count({x}) {w} = {n} THEN percentile({x}, {q / 100}) {w} END")


def shift_previous(s, x, k):
    return prev(s, x, k)


def trailing_return(s, x, k):
    return s.put(f"{x} / {lag(x, k)} - 1")


def finite_tail(s, x):
    """Index of the first defined row, null where a later row is undefined again."""
    first = s.put(f"min(CASE WHEN {x} IS NOT NULL THEN {s.t} END) OVER (PARTITION BY symbol)")
    return s.put(
        f"CASE WHEN sum(CASE WHEN {x} IS NULL AND {s.t} > {first} THEN 1 ELSE 0 END)"
        f" OVER (PARTITION BY symbol) = 0 THEN {first} END"
    )


# --- calendar -------------------------------------------------------------------

def month_number(s, day="day"):
    return s.put(f"year({day}) * 12 + month({day})")


def is_month_end(s, day="day"):
    return s.put(f"last_day({day}) = {day}")


def weekday_utc(s, day="day"):
    return s.put(f"weekday({day})", duck=f"isodow({day}) - 1")


def is_week_end(s, day="day"):
    return s.put(f"weekday({day}) = 6", duck=f"isodow({day}) = 7")


def week_number(s, day="day"):
    return s.put(
        f"floor(datediff({day}, DATE'1969-12-29') / 7)",
        duck=f"CAST(floor(datediff('day', DATE '1969-12-29', {day}) / 7) AS BIGINT)",
    )


def month_of_year(s, day="day"):
    return s.put(f"month({day})")


def day_of_month(s, day="day"):
    return s.put(f"day({day})")


def days_in_month(s, day="day"):
    return s.put(f"day(last_day({day}))")


def third_friday_dom(s, day="day"):
    """Day of month of the third Friday: the Friday on or after the 15th."""
    return s.put(
        f"15 + pmod(4 - weekday(trunc({day}, 'MM')), 7)",
        duck=f"15 + (12 - isodow(date_trunc('month', {day}))) % 7",
    )


def tomorrow(s):
    return s.put("date_add(day, 1)", duck="day + 1")


# --- recurrences ----------------------------------------------------------------

def ema(s, x, n, depth=1):
    return s.recur("smooth", [x], n=n, alpha=2.0 / (n + 1), depth=depth)


def smma(s, x, n):
    return s.recur("smooth", [x], n=n, alpha=1.0 / n)


def wilder_smooth(s, x, n):
    """Wilder average; the first row, which has no previous bar, is not in the seed."""
    return smma(s, f"CASE WHEN {s.t} >= 1 THEN {x} END", n)


def true_range(s):
    return s.put(TR.format(p=prev(s, "c")))


def atr_wilder(s, n):
    return wilder_smooth(s, true_range(s), n)


def _gain_ratio(s, gain, loss):
    return s.put(
        f"CASE WHEN {gain} IS NULL THEN NULL WHEN {loss} = 0 THEN"
        f" CASE WHEN {gain} = 0 THEN 50D ELSE 100D END"
        f" ELSE 100 - 100 / (1 + {gain} / {loss}) END"
    )


def _rsi_of_change(s, d, n):
    gain = smma(s, f"CASE WHEN {d} > 0 THEN {d} WHEN {d} IS NOT NULL THEN 0D END", n)
    loss = smma(s, f"CASE WHEN {d} < 0 THEN -{d} WHEN {d} IS NOT NULL THEN 0D END", n)
    return _gain_ratio(s, gain, loss)


def rsi_wilder(s, x, n):
    return _rsi_of_change(s, s.put(f"{x} - {lag(x)}"), n)


def relative_momentum_index(s, momentum, n):
    return _rsi_of_change(s, s.put(f"c - {lag('c', momentum)}"), n)


def adx_wilder(s, n):
    """(+DI, -DI, ADX)."""
    up, down = s.put(f"h - {lag('h')}"), s.put(f"{lag('l')} - l")
    plus = s.put(f"CASE WHEN {up} > {down} AND {up} > 0 THEN {up} WHEN {up} IS NOT NULL THEN 0D END")
    minus = s.put(f"CASE WHEN {down} > {up} AND {down} > 0 THEN {down} WHEN {up} IS NOT NULL THEN 0D END")
    tr, p, m = atr_wilder(s, n), smma(s, plus, n), smma(s, minus, n)
    di_p = s.put(f"CASE WHEN {tr} > 0 THEN 100 * {p} / {tr} WHEN {tr} IS NOT NULL THEN 0D END")
    di_m = s.put(f"CASE WHEN {tr} > 0 THEN 100 * {m} / {tr} WHEN {tr} IS NOT NULL THEN 0D END")
    dx = s.put(
        f"CASE WHEN {di_p} + {di_m} > 0 THEN 100 * abs({di_p} - {di_m}) / ({di_p} + {di_m})"
        f" WHEN {di_p} IS NOT NULL THEN 0D END"
    )
    return di_p, di_m, smma(s, dx, n)


def adx_first_index(n):
    return 2 * n - 1


def bollinger(s, x, n, width):
    """(middle, lower, upper)."""
    mid, sd = sma(s, x, n), rolling_std(s, x, n)
    return mid, s.put(f"{mid} - {width} * {sd}"), s.put(f"{mid} + {width} * {sd}")


def keltner(s, ema_n, atr_n, width):
    mid, atr = ema(s, TYPICAL, ema_n), atr_wilder(s, atr_n)
    return mid, s.put(f"{mid} - {width} * {atr}"), s.put(f"{mid} + {width} * {atr}")


def _mid_range(s, n):
    return s.put(f"({rolling_max(s, 'h', n)} + {rolling_min(s, 'l', n)}) / 2")


def ichimoku_lines(s, conv, base):
    return _mid_range(s, conv), _mid_range(s, base)


def ichimoku_spans(s, conv, base, span):
    tenkan, kijun = ichimoku_lines(s, conv, base)
    a = s.put(f"({tenkan} + {kijun}) / 2")
    return prev(s, a, base), prev(s, _mid_range(s, span), base)


def ichimoku_cloud_top(s, conv, base, span):
    a, b = ichimoku_spans(s, conv, base, span)
    return s.put(f"CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN greatest({a}, {b}) END")


def ichimoku_first_index(base, span):
    return span - 1 + base


def supertrend_long(s, n, mult):
    atr = atr_wilder(s, n)
    up = s.put(f"{MEDIAN_PRICE} + {mult} * {atr}")
    down = s.put(f"{MEDIAN_PRICE} - {mult} * {atr}")
    return s.recur("supertrend", [up, down, "c"])


def parabolic_sar(s, start, step, cap):
    return s.recur("parabolic", ["h", "l"], start=start, step=step, cap=cap)


def williams_r(s, n):
    hh, ll = rolling_max(s, "h", n), rolling_min(s, "l", n)
    return s.put(f"-100 * ({hh} - c) / nullif({hh} - {ll}, 0)")


def ibs(s):
    return s.put("(c - l) / nullif(h - l, 0)")


def _lag_sum(terms: list[str]) -> str:
    return " + ".join(terms)


def weighted(s, x, weights):
    """Weighted mean of the last rows; ``weights[k]`` sits on the value ``k`` rows ago."""
    total = sum(weights)
    terms = [f"{w!r} * {back(s, x, k)}" for k, w in enumerate(weights)]
    return s.put(f"({_lag_sum(terms)}) / {total!r}")


def wma(s, x, n):
    return weighted(s, x, [float(n - k) for k in range(n)])


wma_skip_leading = wma


def hull_ma(s, x, n):
    half, root = max(n // 2, 1), max(round(n**0.5), 1)
    raw = s.put(f"2 * {wma(s, x, half)} - {wma(s, x, n)}")
    return wma(s, raw, root)


def alma(s, x, n, offset, sigma):
    m, sd = offset * (n - 1), n / sigma
    return weighted(s, x, [math.exp(-((n - 1 - k - m) ** 2) / (2 * sd * sd)) for k in range(n)])


def center_of_gravity(s, x, n):
    terms = [f"{float(k + 1)!r} * {back(s, x, k)}" for k in range(n)]
    return s.put(f"-({_lag_sum(terms)}) / nullif(sum({x}) {rows(n)}, 0)")


def aroon(s, n):
    """(up, down); a tie takes the most recent extreme."""
    up = _since(s, "h", "max", n)
    down = _since(s, "l", "min", n)
    return up, down


def _since(s, x, agg, n):
    edge = over(s, agg, x, n + 1)
    ages = [f"WHEN {back(s, x, k)} = {edge} THEN {float(n - k)!r}" for k in range(n + 1)]
    return s.put(f"CASE WHEN {edge} IS NULL THEN NULL {' '.join(ages)} END * 100 / {n}")


def kaufman_ama(s, er_n, fast, slow):
    e = efficiency_ratio(s, er_n)
    f, w = 2.0 / (fast + 1), 2.0 / (slow + 1)
    k = s.put(f"power({e} * {f - w!r} + {w!r}, 2)")
    return s.recur("adaptive", ["c", k])


def cci(s, n):
    tp = s.put(TYPICAL)
    mid = sma(s, tp, n)
    mad = s.put(f"({_lag_sum([f'abs({back(s, tp, k)} - {mid})' for k in range(n)])}) / {n}")
    return s.put(
        f"CASE WHEN {mad} = 0 THEN 0D ELSE ({tp} - {mid}) / nullif(0.015D * {mad}, 0) END"
    )


def stochastic_k(s, n):
    hh, ll = rolling_max(s, "h", n), rolling_min(s, "l", n)
    return s.put(
        f"CASE WHEN {hh} = {ll} THEN 50D ELSE 100 * (c - {ll}) / nullif({hh} - {ll}, 0) END"
    )


def close_streak(s):
    """Signed length of the current run of higher or lower closes."""
    way = s.put(f"CASE WHEN c > {lag('c')} THEN 1 WHEN c < {lag('c')} THEN -1 ELSE 0 END")
    edge = s.put(f"CASE WHEN {way} = {lag(way)} THEN 0 ELSE 1 END")
    run = s.put(f"sum({edge}) {so_far()}")
    return s.put(
        f"CAST({way} * row_number() OVER (PARTITION BY symbol, {run} ORDER BY day) AS DOUBLE)"
    )


def percent_rank_change(s, n):
    r = s.put(f"CASE WHEN {s.t} >= 1 THEN coalesce(c / nullif({lag('c')}, 0) - 1, 0) END")
    last = s.put(f"collect_list({r}) {rows(n)}", duck=f"list({r}) FILTER ({r} IS NOT NULL) {rows(n)}")
    return s.put(
        f"CASE WHEN count({r}) {rows(n)} = {n} THEN"
        f" 100D * size(filter({last}, v -> v < {r})) / {n} END",
        duck=f"CASE WHEN count({r}) {rows(n)} = {n} THEN"
        f" 100.0 * len(list_filter({last}, lambda v: v < {r})) / {n} END",
    )


def connors_rsi(s, price_n=3, streak_n=2, rank_n=100):
    price = rsi_wilder(s, "c", price_n)
    streak = rsi_wilder(s, close_streak(s), streak_n)
    return s.put(f"({price} + {streak} + {percent_rank_change(s, rank_n)}) / 3")


def log_return(s):
    """Log of the last step. Estimates of equal windows tie up to rounding, so the log is the C library's (``sheet.clog``)."""
    last = lag("c")
    # A Python function's input is computed for all rows, so it must not divide by zero.
    return s.put(
        f"CASE WHEN c > 0 AND {last} > 0 THEN clog(c / nullif({last}, 0D)) END",
        duck=f"CASE WHEN c > 0 AND {last} > 0 THEN ln(c / {last}) END",
    )


def realized_vol(s, n):
    r = log_return(s)
    w = rows(n)
    return s.put(
        f"CASE WHEN count({r}) {w} < {n} THEN NULL"
        f" WHEN max({r}) {w} - min({r}) {w} <= 1e-12 THEN 0D ELSE stddev_samp({r}) {w} END"
    )


def vortex(s, n):
    tr = true_range(s)
    plus = s.put(f"abs(h - {lag('l')})")
    minus = s.put(f"abs(l - {lag('h')})")
    base = f"nullif(sum({tr}) {rows(n)}, 0)"
    full = f"count({plus}) {rows(n)} = {n}"
    return (
        s.put(f"CASE WHEN {full} THEN sum({plus}) {rows(n)} / {base} END"),
        s.put(f"CASE WHEN {full} THEN sum({minus}) {rows(n)} / {base} END"),
    )


def ultimate_oscillator(s, short, mid, long):
    p = prev(s, "c")
    bp = s.put(f"CASE WHEN {p} IS NOT NULL THEN c - least(l, {p}) END")
    tr = s.put(f"CASE WHEN {p} IS NOT NULL THEN greatest(h, {p}) - least(l, {p}) END")
    parts = [
        s.put(f"CASE WHEN count({bp}) {rows(n)} = {n} THEN sum({bp}) {rows(n)} / nullif(sum({tr}) {rows(n)}, 0) END")
        for n in (short, mid, long)
    ]
    return s.put(f"100 * (4 * {parts[0]} + 2 * {parts[1]} + {parts[2]}) / 7")


def trix(s, n):
    third = ema(s, "c", n, depth=3)
    p = prev(s, third)
    return s.put(f"({third} - {p}) / nullif({p}, 0)")


def stoch_rsi(s, n):
    r = rsi_wilder(s, "c", n)
    hh, ll = rolling_max(s, r, n), rolling_min(s, r, n)
    return s.put(f"CASE WHEN {hh} = {ll} THEN {r} ELSE 100 * ({r} - {ll}) / nullif({hh} - {ll}, 0) END")


def dema(s, n):
    return s.put(f"2 * {ema(s, 'c', n)} - {ema(s, 'c', n, depth=2)}")


def _up_down(s, n, body=False):
    d = s.put("c - o" if body else f"c - {lag('c')}")
    up = s.put(f"sum(CASE WHEN {d} > 0 THEN {d} ELSE 0 END) {rows(n)}")
    down = s.put(f"sum(CASE WHEN {d} < 0 THEN -{d} ELSE 0 END) {rows(n)}")
    return d, up, down


def chande_momentum(s, n):
    d, up, down = _up_down(s, n)
    return s.put(
        f"CASE WHEN count({d}) {rows(n)} < {n} THEN NULL WHEN {up} + {down} > 0 THEN"
        f" 100 * ({up} - {down}) / ({up} + {down}) ELSE 0D END"
    )


def intraday_momentum(s, n):
    d, up, down = _up_down(s, n, body=True)
    return s.put(
        f"CASE WHEN count({d}) {rows(n)} < {n} THEN NULL WHEN {up} + {down} > 0 THEN"
        f" 100 * {up} / ({up} + {down}) ELSE 50D END"
    )


def qstick(s, n):
    return sma(s, s.put("c - o"), n)


def know_sure_thing(s):
    parts = [sma(s, trailing_return(s, "c", k), n) for k, n in ((10, 10), (15, 10), (20, 10), (30, 15))]
    return s.put(f"{parts[0]} + 2 * {parts[1]} + 3 * {parts[2]} + 4 * {parts[3]}")


def fisher_transform(s, n):
    p = s.put(MEDIAN_PRICE)
    hh, ll = rolling_max(s, p, n), rolling_min(s, p, n)
    raw = s.put(
        f"CASE WHEN {hh} = {ll} THEN 0D ELSE"
        f" greatest(-0.999D, least(0.999D, 2 * (({p} - {ll}) / nullif({hh} - {ll}, 0) - 0.5D))) END"
    )
    raw = s.put(f"CASE WHEN {hh} IS NOT NULL THEN 0.33D * {raw} END")
    none = s.put("CAST(NULL AS DOUBLE)")
    value = s.recur("two_pole", [raw, none], a1=0.67, a2=0.0)
    step = s.put(f"0.5D * ln((1 + {value}) / (1 - {value}))")
    return s.recur("two_pole", [step, none], a1=0.5, a2=0.0)


def relative_vigor(s, n):
    """(index, signal)."""
    def mixed(x):
        return f"({x} + 2 * {lag(x, 1)} + 2 * {lag(x, 2)} + {lag(x, 3)}) / 6"

    body, span = s.put("c - o"), s.put("h - l")
    num, den = rolling_sum(s, s.put(mixed(body)), n), rolling_sum(s, s.put(mixed(span)), n)
    rvi = s.put(f"CASE WHEN {den} = 0 THEN 0D ELSE {num} / nullif({den}, 0) END")
    return rvi, s.put(mixed(rvi))


def schaff_trend(s, cycle, fast=23, slow=50):
    x = s.put(f"{ema(s, 'c', fast)} - {ema(s, 'c', slow)}")
    half = s.put("0.5D")
    for _ in range(2):
        hh, ll = rolling_max(s, x, cycle), rolling_min(s, x, cycle)
        frac = s.put(f"100 * ({x} - {ll}) / nullif({hh} - {ll}, 0)")
        kept = s.put(
            f"CASE WHEN {hh} IS NOT NULL THEN"
            f" coalesce({frac}, last_value({frac}) IGNORE NULLS {before()}, 50D) END",
            duck=f"CASE WHEN {hh} IS NOT NULL THEN"
            f" coalesce({frac}, last_value({frac} IGNORE NULLS) {before()}, 50.0) END",
        )
        x = s.recur("adaptive", [kept, s.put(f"CASE WHEN {kept} IS NOT NULL THEN {half} END")])
    return x


def detrended_price(s, n):
    return s.put(f"{lag('c', n // 2 + 1)} - {sma(s, 'c', n)}")


def ulcer_index(s, n):
    peak = rolling_max(s, "c", n)
    terms = [f"power(100 * ({peak} - {back(s, 'c', k)}) / nullif({peak}, 0), 2)" for k in range(n)]
    return s.put(f"CASE WHEN {peak} > 0 THEN sqrt(({_lag_sum(terms)}) / {n}) END")


def mass_index(s, ema_n, span):
    r = s.put("h - l")
    first, second = ema(s, r, ema_n), ema(s, r, ema_n, depth=2)
    ratio = s.put(f"CASE WHEN {second} = 0 THEN 1D WHEN {second} > 0 THEN {first} / {second} END")
    return rolling_sum(s, ratio, span)


def relative_volatility(s, n):
    sd_h, sd_l = rolling_std(s, "h", n), rolling_std(s, "l", n)
    p = prev(s, "c")
    up = smma(s, f"CASE WHEN {sd_h} IS NULL THEN NULL WHEN c > {p} THEN {sd_h} ELSE 0D END", n)
    down = smma(s, f"CASE WHEN {sd_l} IS NULL THEN NULL WHEN c < {p} THEN {sd_l} ELSE 0D END", n)
    return s.put(
        f"CASE WHEN {up} + {down} > 0 THEN 100 * {up} / ({up} + {down})"
        f" WHEN {up} IS NOT NULL THEN 50D END"
    )


def hold_between(s, at, value):
    """``value`` of the latest row where ``at`` holds; flat before the first."""
    v = s.put(f"CASE WHEN {at} THEN coalesce({value}, false) END")
    return s.put(
        f"coalesce(last_value({v}) IGNORE NULLS {so_far()}, false)",
        duck=f"coalesce(last_value({v} IGNORE NULLS) {so_far()}, false)",
    )


def macd_histogram(s, fast, slow, signal):
    line = s.put(f"{ema(s, 'c', fast)} - {ema(s, 'c', slow)}")
    return s.put(f"{line} - {ema(s, line, signal)}")


def _twice(s, x, long, short):
    return ema(s, ema(s, x, long), short)


def true_strength_index(s, long, short):
    m = s.put(f"c - {lag('c')}")
    num, den = _twice(s, m, long, short), _twice(s, s.put(f"abs({m})"), long, short)
    return s.put(f"CASE WHEN {den} = 0 THEN 0D ELSE 100 * {num} / nullif({den}, 0) END")


def awesome_oscillator(s, fast, slow):
    m = s.put(MEDIAN_PRICE)
    return s.put(f"{sma(s, m, fast)} - {sma(s, m, slow)}")


def balance_of_power(s, n):
    # Bodies of +-1 cancel to exactly zero; rounding keeps sum order from deciding the sign.
    x = sma(s, s.put("CASE WHEN h > l THEN (c - o) / nullif(h - l, 0) ELSE 0D END"), n)
    return s.put(f"round({x}, 12)")


def close_location(s, n):
    x = sma(s, s.put("CASE WHEN h > l THEN (2 * c - h - l) / nullif(h - l, 0) ELSE 0D END"), n)
    return s.put(f"round({x}, 12)")


def psychological_line(s, n):
    up = s.put(f"CASE WHEN c > {lag('c')} THEN 1D WHEN {lag('c')} IS NOT NULL THEN 0D END")
    return s.put(f"CASE WHEN count({up}) {rows(n)} = {n} THEN 100 * sum({up}) {rows(n)} / {n} END")


def choppiness_index(s, n):
    tr = true_range(s)
    span = s.put(f"{rolling_max(s, 'h', n)} - {rolling_min(s, 'l', n)}")
    path = rolling_sum(s, tr, n)
    return s.put(
        f"CASE WHEN {span} > 0 AND {path} > 0 THEN 100 * ln({path} / {span}) / ln({n}) END"
    )


def random_walk_index(s, n):
    """(of the highs, of the lows): the best ratio over lengths 2..n."""
    up, down = [], []
    for i in range(2, n + 1):
        scale = f"nullif({atr_wilder(s, i)} * {math.sqrt(i)!r}, 0)"
        up.append(f"(h - {lag('l', i)}) / {scale}")
        down.append(f"({lag('h', i)} - l) / {scale}")
    ready = f"{s.t} >= {n}"
    if n == 2:
        return s.put(f"CASE WHEN {ready} THEN {up[0]} END"), s.put(f"CASE WHEN {ready} THEN {down[0]} END")
    return (
        s.put(f"CASE WHEN {ready} THEN greatest({', '.join(up)}) END"),
        s.put(f"CASE WHEN {ready} THEN greatest({', '.join(down)}) END"),
    )


def swing_index(s, limit_frac=0.5):
    pc, po = prev(s, "c"), prev(s, "o")
    a, b, d = s.put(f"abs(h - {pc})"), s.put(f"abs(l - {pc})"), s.put(f"abs({pc} - {po})")
    r = s.put(
        f"CASE WHEN {a} >= {b} AND {a} >= h - l THEN {a} + 0.5D * {b} + 0.25D * {d}"
        f" WHEN {b} > {a} AND {b} >= h - l THEN {b} + 0.5D * {a} + 0.25D * {d}"
        f" ELSE h - l + 0.25D * {d} END"
    )
    num = s.put(f"c - {pc} + 0.5D * (c - o) + 0.25D * ({pc} - {po})")
    return s.put(
        f"CASE WHEN {pc} IS NULL THEN NULL WHEN {r} > 0 AND {pc} > 0 THEN"
        f" 50 * {num} / nullif({r}, 0) * greatest({a}, {b}) / nullif({limit_frac} * {pc}, 0)"
        f" ELSE 0D END"
    )


def range_expansion_index(s, n):
    h2, l2 = prev(s, "h", 2), prev(s, "l", 2)
    h5, l5, h6, l6 = prev(s, "h", 5), prev(s, "l", 5), prev(s, "h", 6), prev(s, "l", 6)
    met = f"(h >= {l5} OR h >= {l6}) AND (l <= {h5} OR l <= {h6})"
    num = s.put(f"CASE WHEN {h6} IS NULL THEN NULL WHEN {met} THEN h - {h2} + (l - {l2}) ELSE 0D END")
    den = s.put(f"CASE WHEN {h6} IS NULL THEN NULL WHEN {met} THEN abs(h - {h2}) + abs(l - {l2}) ELSE 0D END")
    a, b = rolling_sum(s, num, n), rolling_sum(s, den, n)
    return s.put(f"CASE WHEN {b} = 0 THEN 0D ELSE 100 * {a} / nullif({b}, 0) END")


# --- regression -----------------------------------------------------------------

def _line(s, x, n):
    """Centered sums of a least-squares line on the last ``n`` rows: (sxx, sxy, syy, mean)."""
    mean = sma(s, x, n)
    mid = (n - 1) / 2
    sxy = s.put(_lag_sum([f"{mid - k!r} * {back(s, x, k)}" for k in range(n)]))
    return n * (n * n - 1) / 12.0, sxy, s.put(f"{n} * power({rolling_std(s, x, n)}, 2)"), mean


def linreg_slope(s, x, n):
    sxx, sxy, _, mean = _line(s, x, n)
    return s.put(f"CASE WHEN {mean} IS NOT NULL THEN {sxy} / {sxx!r} END")


def linreg_value(s, x, n):
    return s.put(f"{sma(s, x, n)} + {linreg_slope(s, x, n)} * {(n - 1) / 2!r}")


def linreg_r2(s, x, n):
    sxx, sxy, syy, _ = _line(s, x, n)
    return s.put(f"CASE WHEN {syy} > 1e-18 THEN {sxy} * {sxy} / ({sxx!r} * {syy}) WHEN {syy} IS NOT NULL THEN 0D END")


def linreg_stderr(s, x, n):
    sxx, sxy, syy, _ = _line(s, x, n)
    return s.put(f"sqrt(CASE WHEN {syy} IS NOT NULL THEN greatest({syy} - {sxy} * {sxy} / {sxx!r}, 0D) END / {n - 2})")


# --- more recurrences -----------------------------------------------------------

def laguerre_rsi(s, gamma):
    ls = [s.recur("laguerre", ["c"], out=f"l{j}", gamma=gamma) for j in range(4)]
    d = [s.put(f"{ls[j]} - {ls[j + 1]}") for j in range(3)]
    up = " + ".join(f"CASE WHEN {x} >= 0 THEN {x} ELSE 0 END" for x in d)
    total = " + ".join(f"abs({x})" for x in d)
    return s.put(f"CASE WHEN {s.t} >= 1 THEN CASE WHEN {total} > 0 THEN ({up}) / nullif({total}, 0) ELSE 0D END END")


def laguerre_filter(s, gamma):
    ls = [s.recur("laguerre", ["c"], out=f"l{j}", gamma=gamma) for j in range(4)]
    return s.put(f"CASE WHEN {s.t} >= 1 THEN ({ls[0]} + 2 * {ls[1]} + 2 * {ls[2]} + {ls[3]}) / 6 END")


def vidya(s, n):
    k = s.put(f"{2.0 / (n + 1)!r} * abs({chande_momentum(s, n)}) / 100")
    return s.recur("adaptive", ["c", k])


def tillson_t3(s, n, factor):
    e3, e4, e5, e6 = (ema(s, "c", n, depth=d) for d in (3, 4, 5, 6))
    f2, f3 = factor**2, factor**3
    c3 = -6 * f2 - 3 * factor - 3 * f3
    c4 = 1 + 3 * factor + f3 + 3 * f2
    return s.put(f"{-f3!r} * {e6} + {3 * f2 + 3 * f3!r} * {e5} + {c3!r} * {e4} + {c4!r} * {e3}")


def mcginley_dynamic(s, n):
    return s.recur("mcginley", ["c"], n=n)


def demarker(s, n):
    up = s.put(f"CASE WHEN h > {lag('h')} THEN h - {lag('h')} WHEN {lag('h')} IS NOT NULL THEN 0D END")
    down = s.put(f"CASE WHEN l < {lag('l')} THEN {lag('l')} - l WHEN {lag('l')} IS NOT NULL THEN 0D END")
    a, b = sma(s, up, n), sma(s, down, n)
    return s.put(f"CASE WHEN {a} + {b} > 0 THEN {a} / ({a} + {b}) WHEN {a} IS NOT NULL THEN 0.5D END")


def zero_lag_ema(s, n):
    back = (n - 1) // 2
    return ema(s, s.put(f"2 * c - {lag('c', back)}") if back else "c", n)


def _halves(s, n):
    half = n // 2
    older = n - half
    n1 = s.put(f"({rolling_max(s, 'c', half)} - {rolling_min(s, 'c', half)}) / {half}")
    n2 = prev(s, s.put(f"({rolling_max(s, 'c', older)} - {rolling_min(s, 'c', older)}) / {older}"), half)
    n3 = s.put(f"({rolling_max(s, 'c', n)} - {rolling_min(s, 'c', n)}) / {n}")
    return n1, n2, n3


def fractal_dimension(s, n):
    n1, n2, n3 = _halves(s, n)
    return s.put(
        f"CASE WHEN {n3} IS NULL THEN NULL WHEN {n3} > 0 AND {n1} + {n2} > 0 THEN"
        f" (ln({n1} + {n2}) - ln({n3})) / ln(2) ELSE 1D END"
    )


def frama(s, n):
    n1, n2, n3 = _halves(s, n)
    a = s.put(
        f"CASE WHEN {n1} > 0 AND {n2} > 0 AND {n3} > 0 THEN greatest(0.01D, least(1D,"
        f" exp(-4.6D * ((ln({n1} + {n2}) - ln({n3})) / ln(2) - 1)))) END"
    )
    kept = s.put(
        f"CASE WHEN {n3} IS NOT NULL THEN coalesce(last_value({a}) IGNORE NULLS {so_far()}, 1D) END",
        duck=f"CASE WHEN {n3} IS NOT NULL THEN coalesce(last_value({a} IGNORE NULLS) {so_far()}, 1.0) END",
    )
    return s.recur("adaptive", ["c", kept])


def _smoother_poles(n):
    a = math.exp(-math.sqrt(2) * math.pi / n)
    b = 2 * a * math.cos(math.sqrt(2) * math.pi / n)
    return b, -a * a


def _after(s, first, x):
    return s.put(f"CASE WHEN {s.t} >= {first} THEN {x} END")


def super_smoother(s, n):
    p1, p2 = _smoother_poles(n)
    x = s.put(f"{1 - p1 - p2!r} * (c + {lag('c')}) / 2")
    seed = s.put(f"CASE WHEN {s.t} < 2 THEN c END")
    return _after(s, 2, s.recur("two_pole", [x, seed], a1=p1, a2=p2))


def _smooth4(s, x):
    return s.put(f"({x} + 2 * {lag(x, 1)} + 2 * {lag(x, 2)} + {lag(x, 3)}) / 6")


def cyber_cycle(s, alpha, price=MEDIAN_PRICE):
    p = s.put(price)
    sm = _smooth4(s, p)
    x = s.put(f"{(1 - 0.5 * alpha) ** 2!r} * ({sm} - 2 * {lag(sm, 1)} + {lag(sm, 2)})")
    seed = s.put(f"CASE WHEN {s.t} BETWEEN 2 AND 5 THEN ({p} - 2 * {lag(p, 1)} + {lag(p, 2)}) / 4 END")
    return s.recur("two_pole", [x, seed], a1=2 * (1 - alpha), a2=-((1 - alpha) ** 2))


def instantaneous_trendline(s, alpha):
    p = s.put(MEDIAN_PRICE)
    sm = _smooth4(s, p)
    a2 = alpha * alpha
    x = s.put(f"{alpha - 0.25 * a2!r} * {sm} + {0.5 * a2!r} * {lag(sm, 1)} - {alpha - 0.75 * a2!r} * {lag(sm, 2)}")
    seed = s.put(f"CASE WHEN {s.t} IN (4, 5) THEN {p} END")
    return _after(s, 6, s.recur("two_pole", [x, seed], a1=2 * (1 - alpha), a2=-((1 - alpha) ** 2)))


def roofing_filter(s, highpass, lowpass=10):
    angle = 0.707 * 2 * math.pi / highpass
    alpha = (math.cos(angle) + math.sin(angle) - 1) / math.cos(angle)
    none = s.put("CAST(NULL AS DOUBLE)")
    x = s.put(f"{(1 - alpha / 2) ** 2!r} * (c - 2 * {lag('c', 1)} + {lag('c', 2)})")
    hp = s.recur("two_pole", [x, none], a1=2 * (1 - alpha), a2=-((1 - alpha) ** 2))
    p1, p2 = _smoother_poles(lowpass)
    y = s.put(f"CASE WHEN {hp} IS NOT NULL THEN {1 - p1 - p2!r} * ({hp} + coalesce({lag(hp)}, 0)) / 2 END")
    return s.recur("two_pole", [y, none], a1=p1, a2=p2)


def band_pass(s, period, bandwidth=0.3):
    beta = math.cos(2 * math.pi / period)
    gamma = 1 / math.cos(2 * math.pi * bandwidth / period)
    alpha = gamma - math.sqrt(gamma * gamma - 1)
    x = s.put(f"{0.5 * (1 - alpha)!r} * (c - {lag('c', 2)})")
    none = s.put("CAST(NULL AS DOUBLE)")
    return s.recur("two_pole", [x, none], a1=beta * (1 + alpha), a2=-alpha)


HILBERT_READY = 40  # rows until the discriminator reads only real prices


def mesa_adaptive(s, fast, slow):
    """(average, phase in degrees, period)."""
    outs = [s.recur("mesa", [MEDIAN_PRICE], out=k, fast=fast, slow=slow) for k in ("mama", "phase", "period")]
    return tuple(_after(s, HILBERT_READY, x) for x in outs)


def dominant_period(s):
    return mesa_adaptive(s, 0.5, 0.05)[2]


# --- variance estimators and shape ----------------------------------------------

def variance_ratio(s, q, window):
    r = log_return(s)
    rq = rolling_sum(s, r, q)
    v1 = over(s, "var_pop", r, window)
    vq = s.put(f"CASE WHEN {v1} IS NOT NULL THEN var_pop({rq}) {rows(window - q + 1)} END")
    return s.put(f"{vq} / nullif({q} * {v1}, 0)")


def vertical_horizontal_filter(s, n):
    d = s.put(f"abs(c - {lag('c')})")
    return s.put(f"({rolling_max(s, 'c', n)} - {rolling_min(s, 'c', n)}) / nullif({rolling_sum(s, d, n)}, 0)")


def garman_klass(s, n):
    term = s.put(f"0.5D * power(ln(h / l), 2) - {2 * math.log(2) - 1!r} * power(ln(c / o), 2)")
    return sma(s, term, n)


def signed_efficiency(s, n):
    d = s.put(f"abs(c - {lag('c')})")
    path = rolling_sum(s, d, n)
    return s.put(f"CASE WHEN {path} = 0 THEN 0D ELSE (c - {lag('c', n)}) / nullif({path}, 0) END")


def efficiency_ratio(s, n):
    return s.put(f"abs({signed_efficiency(s, n)})")


def stochastic_momentum_index(s, n, smooth):
    hh, ll = rolling_max(s, "h", n), rolling_min(s, "l", n)
    num = ema(s, s.put(f"c - ({hh} + {ll}) / 2"), smooth, depth=2)
    den = ema(s, s.put(f"{hh} - {ll}"), smooth, depth=2)
    return s.put(f"CASE WHEN {den} = 0 THEN 0D ELSE 100 * {num} / nullif(0.5D * {den}, 0) END")


def _window_list(s, x, n):
    return s.put(f"collect_list({x}) {rows(n)}", duck=f"list({x}) FILTER ({x} IS NOT NULL) {rows(n)}")


def average_ranks(s, x, n):
    """Zero-based average ranks of the last ``n`` values, oldest first."""
    a = _window_list(s, x, n)
    return s.put(
        f"transform({a}, v -> aggregate({a}, -0.5D, (r, u) -> r +"
        f" CASE WHEN u < v THEN 1D WHEN u = v THEN 0.5D ELSE 0D END))",
        duck=f"list_transform({a}, lambda v: list_sum(list_transform({a}, lambda u:"
        f" CASE WHEN u < v THEN 1.0 WHEN u = v THEN 0.5 ELSE 0.0 END)) - 0.5)",
    )


def spearman_rho(s, x, n):
    ranks = average_ranks(s, x, n)
    mid, time_ss = (n - 1) / 2, n * (n * n - 1) / 12.0
    num = s.put(
        f"aggregate(zip_with({ranks}, sequence(0, {n - 1}), (r, k) -> (r - {mid!r}) * (k - {mid!r})), 0D, (a, v) -> a + v)",
        duck=f"list_sum(list_transform(range(1, {n + 1}), lambda k: ({ranks}[k] - {mid!r}) * (k - 1 - {mid!r})))",
    )
    ss = s.put(
        f"aggregate({ranks}, 0D, (a, r) -> a + (r - {mid!r}) * (r - {mid!r}))",
        duck=f"list_sum(list_transform({ranks}, lambda r: (r - {mid!r}) * (r - {mid!r})))",
    )
    return s.put(
        f"CASE WHEN {s.t} < {n - 1} THEN NULL WHEN {ss} > 0 THEN {num} / sqrt({ss} * {time_ss!r}) ELSE 0D END"
    )


def _median_of(s, items, count):
    """Median of ``count`` listed texts."""
    lo, hi = (count - 1) // 2, count // 2
    a = s.put(f"array_sort(array({', '.join(items)}))", duck=f"list_sort([{', '.join(items)}])")
    return s.put(f"({a}[{lo}] + {a}[{hi}]) / 2", duck=f"({a}[{lo + 1}] + {a}[{hi + 1}]) / 2")


def theil_sen_slope(s, x, n):
    back = [x if k == 0 else prev(s, x, k) for k in range(n)]
    slopes = [f"({back[j]} - {back[i]}) / {float(i - j)!r}" for j in range(n) for i in range(j + 1, n)]
    return s.put(f"CASE WHEN {s.t} >= {n - 1} THEN {_median_of(s, slopes, len(slopes))} END")


def safezone_stop(s, lookback, downs=10, multiple=2.0):
    """Highest close less a multiple of the mean penetration of the last down days."""
    pen = s.put(f"CASE WHEN c < {lag('c')} THEN {lag('c')} - l END")
    is_down = s.put(f"{pen} IS NOT NULL")
    w = f"OVER (PARTITION BY symbol, {is_down} ORDER BY day ROWS BETWEEN {downs - 1} PRECEDING AND CURRENT ROW)"
    mean = s.put(f"CASE WHEN count({pen}) {w} = {downs} THEN avg({pen}) {w} END")
    kept = s.put(
        f"last_value({mean}) IGNORE NULLS {so_far()}", duck=f"last_value({mean} IGNORE NULLS) {so_far()}"
    )
    return s.put(f"{rolling_max(s, 'c', lookback)} - {multiple} * {kept}")


def kase_devstop(s, n, multiple=2.0):
    return s.put(f"{rolling_max(s, 'c', n)} - {multiple} * {rolling_std(s, true_range(s), n)}")


RS_TERM = "ln(h / o) * (ln(h / o) - ln(c / o)) + ln(l / o) * (ln(l / o) - ln(c / o))"


def rogers_satchell(s, n):
    return sma(s, s.put(RS_TERM), n)


def yang_zhang(s, n):
    night, body, rs = s.put(f"ln(o / {lag('c')})"), s.put("ln(c / o)"), s.put(RS_TERM)
    k = 0.34 / (1.34 + (n + 1) / (n - 1))
    w = rows(n)
    return s.put(
        f"CASE WHEN count({night}) {w} = {n} THEN var_samp({night}) {w}"
        f" + {k!r} * var_samp({body}) {w} + {1 - k!r} * avg({rs}) {w} END"
    )


def trend_intensity(s, n):
    m = sma(s, "c", n)
    terms = [f"CASE WHEN {back(s, 'c', k)} > {m} THEN 1D ELSE 0D END" for k in range(n)]
    return s.put(f"CASE WHEN {m} IS NOT NULL THEN 100 * ({_lag_sum(terms)}) / {n} END")


def parkinson(s, n):
    return sma(s, s.put(f"power(ln(h / l), 2) / {4 * math.log(2)!r}"), n)


def _skew(s, x, n):
    w = rows(n)
    fix = (n - 2) / math.sqrt(n * (n - 1))
    body = "CASE WHEN count({x}) {w} < {n} THEN NULL WHEN var_pop({x}) {w} > 1e-18 THEN {f} ELSE 0D END"
    return s.put(
        body.format(x=x, w=w, n=n, f=f"skewness({x}) {w}"),
        duck=body.format(x=x, w=w, n=n, f=f"skewness({x}) {w} * {fix!r}"),
    )


def realized_skewness(s, n):
    return _skew(s, log_return(s), n)


def open_close_skewness(s, n):
    return _skew(s, s.put("ln(c / o)"), n)


def realized_excess_kurtosis(s, n):
    r, w = log_return(s), rows(n)
    return s.put(
        f"CASE WHEN count({r}) {w} < {n} THEN NULL WHEN var_pop({r}) {w} > 1e-18 THEN kurtosis({r}) {w} ELSE 0D END",
        duck=f"CASE WHEN count({r}) {w} < {n} THEN NULL WHEN var_pop({r}) {w} > 1e-18 THEN kurtosis_pop({r}) {w} ELSE 0 END",
    )


def _pair_corr(s, a, b, pairs, full):
    """Correlation of two columns over ``pairs`` rows; a flat leg is 0."""
    w = rows(pairs)
    flat = f"sqrt(var_pop({a}) {w} * var_pop({b}) {w}) * {pairs} <= 1e-18"
    return s.put(f"CASE WHEN NOT ({full}) THEN NULL WHEN {flat} THEN 0D ELSE corr({a}, {b}) {w} END")


def lag1_autocorr(s, n):
    r = log_return(s)
    return _pair_corr(s, r, prev(s, r), n - 1, f"count({r}) {rows(n)} = {n}")


def partial_autocorr_lag2(s, n):
    r = log_return(s)
    full = f"count({r}) {rows(n)} = {n}"
    r1 = _pair_corr(s, r, prev(s, r), n - 1, full)
    r2 = _pair_corr(s, r, prev(s, r, 2), n - 2, full)
    return s.put(
        f"CASE WHEN abs(1 - {r1} * {r1}) > 1e-12 THEN ({r2} - {r1} * {r1}) / nullif(1 - {r1} * {r1}, 0)"
        f" WHEN {r1} IS NOT NULL THEN 0D END"
    )


def leverage_corr(s, n):
    r = log_return(s)
    sq = s.put(f"power({lag(r)}, 2)")
    return _pair_corr(s, r, sq, n, f"count({sq}) {rows(n)} = {n}")


def prior_max_return(s, n):
    return prior_max(s, trailing_return(s, "c", 1), n)


def downside_deviation(s, n):
    r = log_return(s)
    sq = s.put(f"CASE WHEN {r} < 0 THEN {r} * {r} WHEN {r} IS NOT NULL THEN 0D END")
    return s.put(f"sqrt({sma(s, sq, n)})")


def chande_kroll_stop(s, n, smooth=9, multiple=1.0):
    pre = s.put(f"{rolling_min(s, 'l', n)} + {multiple} * {atr_wilder(s, n)}")
    return rolling_min(s, pre, smooth)


def run_count(s, n):
    up = s.put(f"CASE WHEN c > {lag('c')} THEN 1 WHEN {lag('c')} IS NOT NULL THEN 0 END")
    turn = s.put(f"CASE WHEN {up} <> {lag(up)} THEN 1D ELSE 0D END")
    if n == 2:
        return s.put(f"CASE WHEN {s.t} >= 1 THEN 1D END")
    return s.put(f"CASE WHEN {s.t} >= {n - 1} THEN 1 + sum({turn}) {rows(n - 2)} END")


def turning_point_count(s, n):
    p1, p2 = prev(s, "c", 1), prev(s, "c", 2)
    flag = s.put(f"CASE WHEN ({p1} > {p2} AND {p1} > c) OR ({p1} < {p2} AND {p1} < c) THEN 1D ELSE 0D END")
    return s.put(f"CASE WHEN {s.t} >= {n - 1} THEN sum({flag}) {rows(n - 2)} END")


def hampel_mad(s, n):
    r = log_return(s)
    a = _window_list(s, r, n)
    med = rolling_median(s, r, n)
    lo, hi = (n - 1) // 2, n // 2
    dev = s.put(
        f"array_sort(transform({a}, v -> abs(v - {med})))",
        duck=f"list_sort(list_transform({a}, lambda v: abs(v - {med})))",
    )
    return s.put(
        f"CASE WHEN {med} IS NOT NULL THEN 1.4826D * ({dev}[{lo}] + {dev}[{hi}]) / 2 END",
        duck=f"CASE WHEN {med} IS NOT NULL THEN 1.4826 * ({dev}[{lo + 1}] + {dev}[{hi + 1}]) / 2 END",
    )


def semivariance_share(s, n):
    r = log_return(s)
    m, total = sma(s, r, n), over(s, "var_pop", r, n)
    terms = [f"power(least({back(s, r, k)} - {m}, 0D), 2)" for k in range(n)]
    return s.put(
        f"CASE WHEN {total} > 1e-18 THEN ({_lag_sum(terms)}) / {n} / {total} WHEN {total} IS NOT NULL THEN 0.5D END"
    )


def hurst_rs(s, n):
    r = log_return(s)
    a, m, sd = _window_list(s, r, n), sma(s, r, n), rolling_std(s, r, n)
    span = s.put(
        f"CASE WHEN {m} IS NOT NULL THEN aggregate({a}, named_struct('z', 0D, 'hi', -1e300D, 'lo', 1e300D),"
        f" (p, v) -> named_struct('z', p.z + v - {m}, 'hi', greatest(p.hi, p.z + v - {m}),"
        f" 'lo', least(p.lo, p.z + v - {m})), p -> p.hi - p.lo) END",
        duck=f"CASE WHEN {m} IS NOT NULL THEN"
        f" list_max(list_transform(range(1, {n + 1}), lambda k: list_sum({a}[1:k]) - k * {m}))"
        f" - list_min(list_transform(range(1, {n + 1}), lambda k: list_sum({a}[1:k]) - k * {m})) END",
    )
    return s.put(
        f"CASE WHEN {sd} IS NULL THEN NULL WHEN {sd} > 1e-8 AND {span} > 0 THEN"
        f" ln({span} / {sd}) / ln({n}) ELSE 0.5D END"
    )


def volatility_ratio(s, short, long):
    a, b = realized_vol(s, short), realized_vol(s, long)
    return s.put(f"CASE WHEN {a} IS NULL OR {b} IS NULL THEN NULL WHEN {b} > 1e-18 THEN {a} / nullif({b}, 0) ELSE 1D END")


def starc_upper(s, n):
    return s.put(f"{sma(s, 'c', n)} + {atr_wilder(s, n)}")


def bollinger_percent_b(s, n, width=2.0):
    _, low, high = bollinger(s, "c", n, width)
    return s.put(f"CASE WHEN {high} = {low} THEN 0.5D ELSE (c - {low}) / nullif({high} - {low}, 0) END")


def corwin_schultz(s, n):
    ph, pl = prev(s, "h"), prev(s, "l")
    beta = s.put(f"power(ln(h / l), 2) + power(ln({ph} / {pl}), 2)")
    gamma = s.put(f"CASE WHEN {ph} IS NOT NULL THEN power(ln(greatest(h, {ph}) / least(l, {pl})), 2) END")
    den = 3 - 2 * math.sqrt(2)
    alpha = s.put(f"(sqrt(2 * {beta}) - sqrt({beta})) / {den!r} - sqrt({gamma} / {den!r})")
    spread = s.put(
        f"CASE WHEN least(h, l, {ph}, {pl}) <= 0 THEN 0D WHEN {alpha} > 0 THEN 2 * (exp({alpha}) - 1) / (1 + exp({alpha})) WHEN {alpha} IS NOT NULL THEN 0D END"
    )
    return s.put(f"round({sma(s, spread, n)}, 12)")  # equal spreads must tie with their median


def roll_spread(s, n):
    d = s.put(f"c - {lag('c')}")
    p = prev(s, d)
    cov = s.put(f"CASE WHEN count({d}) {rows(n)} = {n} THEN covar_pop({d}, {p}) {rows(n - 1)} END")
    return s.put(f"CASE WHEN {cov} < 0 THEN 2 * sqrt(-{cov}) WHEN {cov} IS NOT NULL THEN 0D END")


def upper_half_count(s, n):
    return rolling_sum(s, s.put("CASE WHEN c > (h + l) / 2 AND h > l THEN 1D ELSE 0D END"), n)


def true_range_imbalance(s, n):
    tr, p = true_range(s), prev(s, "c")
    up, down = s.put(f"CASE WHEN c > {p} THEN {tr} END"), s.put(f"CASE WHEN c < {p} THEN {tr} END")
    return s.put(
        f"CASE WHEN {s.t} >= {n} THEN coalesce(avg({up}) {rows(n)}, 0) - coalesce(avg({down}) {rows(n)}, 0) END"
    )


def close_to_close_variance(s, n):
    return over(s, "var_pop", log_return(s), n)


def window_max_drawdown(s, n):
    a = _window_list(s, "c", n)
    return s.put(
        f"CASE WHEN {s.t} >= {n - 1} THEN aggregate({a}, named_struct('top', 0D, 'worst', 0D),"
        f" (p, v) -> named_struct('top', greatest(p.top, v), 'worst',"
        f" greatest(p.worst, 1 - v / greatest(p.top, v))), p -> p.worst) END",
        duck=f"CASE WHEN {s.t} >= {n - 1} THEN"
        f" list_max(list_transform(range(1, {n + 1}), lambda k: 1 - {a}[k] / list_max({a}[1:k]))) END",
    )
