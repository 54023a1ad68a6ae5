"""The long/flat rule catalog: one boolean per (symbol, day, config).

A rule is a function of a sheet and its parameters that returns a predicate
text. Null predicates are flat. ``warm`` gives the first row (or a predicate)
from which every input of a config is defined; days before are not scored.
Parameters are written ``name=(center, neighbour, ...)``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from types import SimpleNamespace

from barloom.functions import indicators as ind
from barloom.functions.indicators import (
    MEDIAN_PRICE, PRICES, atr_wilder, back, bollinger, ema, over_prior, prev, prior_max,
    prior_mean, prior_min, rolling_max, rolling_median, rolling_min, sma, smma,
)
from barloom.functions.sheet import BY_DAY, Sheet, before, lag, rows, so_far

STOP_FRAC = 0.20
TREND = (200, 150, 250)


@dataclass(frozen=True)
class Rule:
    key: str
    family: str
    signal: Callable
    warm: Callable
    cadence: str = "daily"
    grid: dict = field(default_factory=dict)
    stop_frac: float = STOP_FRAC

    @property
    def center(self) -> dict[str, int]:
        return {name: values[0] for name, values in self.grid.items()}

    def configs(self) -> list[dict[str, int]]:
        """Center first, then one parameter moved at a time."""
        out = [self.center]
        for name, values in self.grid.items():
            out += [{**self.center, name: v} for v in values[1:]]
        return out

    @property
    def text(self) -> str:
        return " ".join((self.signal.__doc__ or "").split())


RULES: dict[str, Rule] = {}


def rule(key, family, warm, cadence="daily", **grid):
    def register(fn):
        RULES[key] = Rule(key, family, fn, warm, cadence, grid)
        return fn

    return register


def variant_name(key: str, params: dict[str, int]) -> str:
    """Canonical config name: the rule, then its values unless they are the center."""
    if params == RULES[key].center:
        return f"lib.{key}"
    return f"lib.{key}." + "_".join(str(params[k]) for k in RULES[key].grid)


def columns(s: Sheet, key: str, params: dict[str, int]) -> tuple[str, str]:
    """(signal, ready) column names of one config."""
    r, p = RULES[key], SimpleNamespace(**params)
    on = s.put(f"coalesce({r.signal(s, p)}, false)")
    warm = r.warm(s, p)
    ready = s.put(f"{s.t} >= {warm}" if isinstance(warm, int) else f"coalesce({warm}, false)")
    return on, ready


# --- shared pieces --------------------------------------------------------------

def latch(s, enter, leave):
    """Long from ``enter`` until a later ``leave``; a row with both flips the state."""
    both = s.put(f"coalesce({enter}, false) AND coalesce({leave}, false)")
    only = s.put(
        f"CASE WHEN {both} THEN NULL WHEN coalesce({enter}, false) THEN 1"
        f" WHEN coalesce({leave}, false) THEN 0 END"
    )
    base = s.put(
        f"coalesce(last_value({only}) IGNORE NULLS {so_far()}, 0)",
        duck=f"coalesce(last_value({only} IGNORE NULLS) {so_far()}, 0)",
    )
    group = s.put(f"count({only}) {so_far()}")
    flips = s.put(
        f"sum(CASE WHEN {both} THEN 1 ELSE 0 END) OVER (PARTITION BY symbol, {group} ORDER BY day"
        " ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    )
    return f"({base} + {flips}) % 2 = 1"


def above_trend(s, n):
    return f"c > {sma(s, 'c', n)}"


def with_trend(s, p, text):
    return f"({text}) AND {above_trend(s, p.trend)}"


def rising(s, x):
    return f"{x} > {prev(s, x)}"


def quiet(s, x, p):
    """Below its own 100-row median, above trend."""
    return with_trend(s, p, f"{x} < {rolling_median(s, x, 100)}")


def flag(s, text):
    return s.put(f"CASE WHEN {text} THEN 1D ELSE 0D END")


def first(n):
    return lambda s, p: n(p) if callable(n) else n


def trend_or(n):
    return lambda s, p: max(n(p) if callable(n) else n, p.trend - 1)


def kept(s, x, frame=None):
    """Latest defined value of ``x``."""
    frame = frame or so_far()
    return s.put(f"last_value({x}) IGNORE NULLS {frame}", duck=f"last_value({x} IGNORE NULLS) {frame}")


def month_ends(s):
    return ind.is_month_end(s), ind.month_number(s)


def week_ends(s):
    return ind.is_week_end(s), ind.week_number(s)


def over_ends(at, frame=""):
    return f"OVER (PARTITION BY symbol, {at} ORDER BY day{frame})"


def ends_warm(s, at, period, k):
    """From the first period end whose ``k``-th earlier end exists; a later hole voids it."""
    ok = s.put(f"CASE WHEN {at} THEN {period} - lag({period}, {k}) {over_ends(at)} = {k} END")
    start = s.put(f"min(CASE WHEN {ok} THEN {s.t} END) OVER (PARTITION BY symbol)")
    hole = s.put(f"max(CASE WHEN NOT {ok} AND {s.t} > {start} THEN 1 ELSE 0 END) OVER (PARTITION BY symbol)")
    return f"{s.t} >= {start} AND {hole} = 0"


def periodic_momentum(s, at, period, k):
    back_c = s.put(f"CASE WHEN {at} AND {period} - lag({period}, {k}) {over_ends(at)} = {k}"
                   f" THEN lag(c, {k}) {over_ends(at)} END")
    return ind.hold_between(s, at, f"c / {back_c} - 1 > 0")


def first_break(s, setup, high, low, extra="TRUE"):
    """First close through a setup's range, long when it is the upper side.

    The range is the latest setup before this row. ``extra`` must hold on an
    upper break; one that fails it keeps the setup.
    """
    top = kept(s, s.put(f"CASE WHEN {setup} THEN {high} END"), before())
    bottom = kept(s, s.put(f"CASE WHEN {setup} THEN {low} END"), before())
    group = s.put(f"count(CASE WHEN {setup} THEN 1 END) {before()}")
    up = s.put(f"coalesce(c > {top} AND {extra}, false)")
    broke = s.put(f"{up} OR coalesce(c < {bottom}, false)")
    nth = s.put(
        f"sum(CASE WHEN {broke} THEN 1 ELSE 0 END) OVER (PARTITION BY symbol, {group} ORDER BY day"
        " ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    )
    return f"{up} AND {nth} = 1"


def b(s, x, k=1):
    return back(s, x, k)


def white(s, k=0):
    return f"{b(s, 'c', k)} > {b(s, 'o', k)}"


def black(s, k=0):
    return f"{b(s, 'c', k)} < {b(s, 'o', k)}"


def body(s, k=0):
    return f"abs({b(s, 'c', k)} - {b(s, 'o', k)})"


def equal_band(s):
    return f"0.05D * {prior_mean(s, s.put('h - l'), 5)}"


def span_col(s):
    return s.put("h - l")


# --- moving averages and momentum -----------------------------------------------

def _sma_cross(s, p):
    """Short average above the long one; a short length of 1 is the close."""
    return f"{'c' if p.short == 1 else sma(s, 'c', p.short)} > {sma(s, 'c', p.long)}"


_cross_warm = first(lambda p: max(p.short, p.long) - 1)
rule("sma200", "trend", _cross_warm, short=(1, 2), long=(200, 150, 250))(_sma_cross)
rule("sma5x150", "trend", _cross_warm, short=(5, 4, 6), long=(150, 120, 180))(_sma_cross)


@rule("sma100", "trend", first(lambda p: p.n - 1), n=(100, 80, 120))
def _sma100(s, p):
    """Close above its average."""
    return f"c > {sma(s, 'c', p.n)}"


rule("golden_cross", "trend", _cross_warm, short=(50, 40, 60), long=(200, 150, 250))(_sma_cross)


def _ema_cross(s, p):
    """Fast exponential average above the slow one."""
    return f"{ema(s, 'c', p.fast)} > {ema(s, 'c', p.slow)}"


_ema_warm = first(lambda p: max(p.fast, p.slow) - 1)
rule("ema20x50", "trend", _ema_warm, fast=(20, 16, 24), slow=(50, 40, 60))(_ema_cross)


@rule("faber10m", "trend", lambda s, p: ends_warm(s, *month_ends(s), p.months - 1), "month_end", months=(10, 8, 12))
def _faber(s, p):
    """Month-end close above the mean of the last month-end closes, held a month."""
    at, month = month_ends(s)
    m = p.months
    w = over_ends(at, f" ROWS BETWEEN {m - 1} PRECEDING AND CURRENT ROW")
    ok = s.put(f"CASE WHEN {at} AND {month} - lag({month}, {m - 1}) {over_ends(at)} = {m - 1} THEN c > avg(c) {w} END")
    return ind.hold_between(s, at, ok)


def _month_momentum(s, p):
    """Month-end close above the close some month-ends earlier, held a month."""
    return periodic_momentum(s, *month_ends(s), p.months)


_months_warm = lambda s, p: ends_warm(s, *month_ends(s), p.months)
rule("tsmom12m", "momentum", _months_warm, "month_end", months=(12, 9, 15))(_month_momentum)
rule("tsmom6m", "momentum", _months_warm, "month_end", months=(6, 5, 7))(_month_momentum)
rule("tsmom3m", "momentum", _months_warm, "month_end", months=(3, 2, 4))(_month_momentum)


@rule("tsmom1w", "momentum", lambda s, p: ends_warm(s, *week_ends(s), p.weeks), "week_end", weeks=(1, 2, 3))
def _week_momentum(s, p):
    """Sunday close above an earlier Sunday close, held a week."""
    return periodic_momentum(s, *week_ends(s), p.weeks)


@rule("detzel2w", "trend", first(lambda p: p.n - 1), n=(14, 10, 18))
def _log_average(s, p):
    """Log close above the mean of log closes."""
    x = s.put("ln(c)")
    return f"{x} > {sma(s, x, p.n)}"


def _close_breakout_hold(s, p):
    """Held some days after a close above the prior closing high; repeats inside are ignored."""
    hit = flag(s, f"c > {prior_max(s, 'c', p.n)}")
    return f"{s.recur('greedy_hold', [hit], hold=p.hold)} = 1"


rule("bll_trb50", "breakout", first(lambda p: p.n), n=(50, 40, 60), hold=(10, 8, 12))(_close_breakout_hold)


def _channel(s, entry, exit_):
    return latch(s, f"c > {prior_max(s, 'h', entry)}", f"c < {prior_min(s, 'l', exit_)}")


def _turtle(s, p):
    """In on a close above the prior high, out on a close below the prior low."""
    return _channel(s, p.entry, p.exit)


_turtle_warm = first(lambda p: max(p.entry, p.exit))
rule("turtle55", "breakout", _turtle_warm, entry=(55, 44, 66), exit=(20, 16, 24))(_turtle)


def _rsi2(s, p):
    """Short RSI low while above trend; out above the exit average."""
    r = ind.rsi_wilder(s, "c", 2)
    return latch(s, f"{above_trend(s, p.trend)} AND {r} < {p.rsi_lt}", f"c > {sma(s, 'c', p.exit_ma)}")


_rsi2_warm = first(lambda p: max(2, p.trend - 1, p.exit_ma - 1))
rule("rsi2", "mean_reversion", _rsi2_warm, rsi_lt=(5, 4, 6), trend=TREND, exit_ma=(5, 4, 6))(_rsi2)


@rule("macd", "momentum", first(lambda p: p.slow + p.signal - 2), fast=(12, 10, 14), slow=(26, 21, 31), signal=(9, 7, 11))
def _macd(s, p):
    """MACD line above its signal average."""
    line = s.put(f"{ema(s, 'c', p.fast)} - {ema(s, 'c', p.slow)}")
    return f"{line} > {ema(s, line, p.signal)}"


rule("turtle20", "breakout", _turtle_warm, entry=(20, 16, 24), exit=(10, 8, 12))(_turtle)


def _donchian(s, p):
    """One window for the entry high and the exit low."""
    return _channel(s, p.n, p.n)


rule("donchian20", "breakout", first(lambda p: p.n), n=(20, 16, 24))(_donchian)
rule("ema12x26", "trend", _ema_warm, fast=(12, 10, 14), slow=(26, 21, 31))(_ema_cross)
rule("ema50x200", "trend", _ema_warm, fast=(50, 40, 60), slow=(200, 150, 250))(_ema_cross)


@rule("bb_revert", "mean_reversion", first(lambda p: p.n - 1), n=(20, 16, 24), width=(2, 1, 3))
def _bb_revert(s, p):
    """In below the lower band, out at the middle."""
    mid, low, _ = bollinger(s, "c", p.n, p.width)
    return latch(s, f"c < {low}", f"c >= {mid}")


@rule("bb_break", "breakout", first(lambda p: p.n - 1), n=(20, 16, 24), width=(2, 1, 3))
def _bb_break(s, p):
    """In above the upper band, out below the middle."""
    mid, _, high = bollinger(s, "c", p.n, p.width)
    return latch(s, f"c > {high}", f"c < {mid}")


_keltner_grid = dict(ema=(20, 16, 24), atr=(10, 7, 14), width=(2, 1, 3))
_keltner_warm = first(lambda p: max(p.ema - 1, p.atr))


@rule("keltner20", "breakout", _keltner_warm, **_keltner_grid)
def _keltner_break(s, p):
    """In above the upper channel, out below its middle."""
    mid, _, high = ind.keltner(s, p.ema, p.atr, p.width)
    return latch(s, f"c > {high}", f"c < {mid}")


@rule("rsi14", "trend", first(lambda p: p.n), n=(14, 10, 18), thr=(50, 45, 55))
def _rsi_level(s, p):
    """RSI above a level."""
    return f"{ind.rsi_wilder(s, 'c', p.n)} > {p.thr}"


rule("rsi2_10", "mean_reversion", _rsi2_warm, rsi_lt=(10, 8, 12), trend=TREND, exit_ma=(5, 4, 6))(_rsi2)


def _day_momentum(s, p):
    """Close above the close some days earlier."""
    return f"c > {b(s, 'c', p.n)}"


rule("tsmom30d", "momentum", first(lambda p: p.n), n=(30, 21, 42))(_day_momentum)
rule("tsmom90d", "momentum", first(lambda p: p.n), n=(90, 60, 120))(_day_momentum)
rule("tsmom180d", "momentum", first(lambda p: p.n), n=(180, 150, 210))(_day_momentum)


@rule("adx14", "trend", first(lambda p: 2 * p.n - 1), n=(14, 10, 18), adx_gt=(25, 20, 30))
def _adx(s, p):
    """+DI above -DI with a strong ADX."""
    plus, minus, adx = ind.adx_wilder(s, p.n)
    return f"{plus} > {minus} AND {adx} > {p.adx_gt}"


_cloud_grid = dict(conv=(9, 7, 12), base=(26, 22, 30), span=(52, 42, 60))


@rule("ichimoku", "trend", first(lambda p: p.span - 1 + p.base), **_cloud_grid)
def _ichimoku(s, p):
    """Close above the cloud drawn on the day."""
    return f"c > {ind.ichimoku_cloud_top(s, p.conv, p.base, p.span)}"


@rule("supertrend", "trend", first(lambda p: p.n), n=(10, 7, 14), mult=(3, 2, 4))
def _supertrend(s, p):
    """Direction of the trailing band is up."""
    return f"{ind.supertrend_long(s, p.n, p.mult)} = 1"


@rule("willr", "mean_reversion", trend_or(lambda p: p.n - 1), n=(14, 10, 20), os=(80, 70, 90), trend=TREND)
def _willr(s, p):
    """%R oversold above trend; out above -20."""
    r = ind.williams_r(s, p.n)
    return latch(s, f"{above_trend(s, p.trend)} AND {r} < -{p.os}", f"{r} > -20")


@rule("ibs", "mean_reversion", trend_or(0), ibs_lt=(20, 10, 30), trend=TREND)
def _ibs(s, p):
    """Close near the low above trend; out near the high."""
    x = ind.ibs(s)
    return latch(s, f"{above_trend(s, p.trend)} AND {x} < {p.ibs_lt / 100}D", f"{x} > 0.8D")


rule("donchian55", "breakout", first(lambda p: p.n), n=(55, 44, 66))(_donchian)


@rule("keltner_rev", "mean_reversion", _keltner_warm, **_keltner_grid)
def _keltner_revert(s, p):
    """In below the lower channel, out at its middle."""
    mid, low, _ = ind.keltner(s, p.ema, p.atr, p.width)
    return latch(s, f"c < {low}", f"c >= {mid}")


@rule("sma200_band", "trend", first(lambda p: p.n - 1), n=(200, 150, 250), band=(1, 2, 3))
def _sma_band(s, p):
    """In a band above the average, out a band below it."""
    m = sma(s, "c", p.n)
    return latch(s, f"c > {m} * {1 + p.band / 100!r}D", f"c < {m} * {1 - p.band / 100!r}D")


@rule("psar", "trend", first(1), af=(2, 1, 3), step=(2, 1, 3), af_max=(20, 16, 24))
def _psar(s, p):
    """Parabolic stop is in an up trend. Factors are hundredths."""
    return f"{ind.parabolic_sar(s, p.af / 100, p.step / 100, p.af_max / 100)} = 1"


@rule("kama", "trend", first(lambda p: p.er), er=(10, 8, 12), fast=(2, 1, 3), slow=(30, 20, 40))
def _kama(s, p):
    """Close above the adaptive average."""
    return f"c > {ind.kaufman_ama(s, p.er, p.fast, p.slow)}"


def _root(n):
    return max(round(n**0.5), 1)


@rule("hma", "trend", first(lambda p: p.n + _root(p.n) - 1), n=(16, 9, 25))
def _hma(s, p):
    """Hull average rising."""
    return rising(s, ind.hull_ma(s, "c", p.n))


@rule("aroon", "trend", first(lambda p: p.n), n=(25, 20, 30))
def _aroon(s, p):
    """Aroon up above Aroon down."""
    up, down = ind.aroon(s, p.n)
    return f"{up} > {down}"


@rule("cci", "trend", first(lambda p: p.n - 1), n=(20, 14, 26))
def _cci(s, p):
    """CCI above zero."""
    return f"{ind.cci(s, p.n)} > 0"


@rule("cci_dip", "mean_reversion", trend_or(lambda p: p.n - 1), n=(20, 14, 26), trend=TREND)
def _cci_dip(s, p):
    """CCI below -100 above trend; out above zero."""
    x = ind.cci(s, p.n)
    return latch(s, f"{above_trend(s, p.trend)} AND {x} < -100", f"{x} > 0")


@rule("stoch", "momentum", first(lambda p: p.k + p.d - 2), k=(14, 10, 20), d=(3, 2, 5))
def _stoch(s, p):
    """Fast %K above its average."""
    k = ind.stochastic_k(s, p.k)
    return f"{k} > {sma(s, k, p.d)}"


@rule("stochrsi", "momentum", first(lambda p: 2 * p.n - 1), n=(14, 10, 20), thr=(50, 40, 60))
def _stochrsi(s, p):
    """Stochastic of RSI above a level."""
    return f"{ind.stoch_rsi(s, p.n)} > {p.thr}"


@rule("uo", "momentum", first(28), thr=(50, 45, 55))
def _ultimate(s, p):
    """Ultimate oscillator (7, 14, 28) above a level."""
    return f"{ind.ultimate_oscillator(s, 7, 14, 28)} > {p.thr}"


@rule("rsi14_dip", "mean_reversion", trend_or(lambda p: p.n), n=(14, 10, 18), os=(30, 25, 35), trend=TREND)
def _rsi_dip(s, p):
    """RSI oversold above trend; out above 70."""
    r = ind.rsi_wilder(s, "c", p.n)
    return latch(s, f"{above_trend(s, p.trend)} AND {r} < {p.os}", f"{r} > 70")


@rule("crsi", "mean_reversion", first(100), rsi_lt=(10, 5, 15), exit_gt=(70, 60, 80), adx_gt=(30, 25, 35))
def _crsi(s, p):
    """Connors RSI low with a strong ADX(10); out when it is high."""
    x, adx = ind.connors_rsi(s), ind.adx_wilder(s, 10)[2]
    return latch(s, f"{adx} > {p.adx_gt} AND {x} < {p.rsi_lt}", f"{x} > {p.exit_gt}")


@rule("adx_sma", "trend", trend_or(lambda p: 2 * p.n - 1), n=(14, 10, 18), adx_gt=(25, 20, 30), trend=TREND)
def _adx_sma(s, p):
    """ADX rule above trend."""
    return with_trend(s, p, _adx(s, p))


@rule("vortex", "trend", first(lambda p: p.n), n=(14, 10, 21))
def _vortex(s, p):
    """VI+ above VI-."""
    plus, minus = ind.vortex(s, p.n)
    return f"{plus} > {minus}"


@rule("trix", "momentum", first(lambda p: 3 * (p.n - 1) + 1), n=(15, 12, 18))
def _trix(s, p):
    """Triple average rising."""
    return f"{ind.trix(s, p.n)} > 0"


@rule("chandelier", "breakout", first(lambda p: max(p.entry, p.atr)), entry=(22, 18, 26), atr=(22, 14, 28), mult=(3, 2, 4))
def _chandelier(s, p):
    """In on a new high; out some ATR under the highest high since entry."""
    atr = atr_wilder(s, p.atr)
    enter = flag(s, f"c > {prior_max(s, 'h', p.entry)} AND {atr} IS NOT NULL")
    return f"{s.recur('trail', [enter, 'c', 'h', f'{p.mult} * {atr}'])} = 1"


@rule("hi52", "momentum", first(lambda p: p.n - 1), n=(252, 210, 300), near=(95, 90, 98))
def _hi52(s, p):
    """Close within reach of the highest close."""
    top = rolling_max(s, "c", p.n)
    return f"{top} > 0 AND c >= {p.near / 100!r}D * {top}"


@rule("tsmom_vote", "momentum", first(lambda p: p.slow), slow=(252, 210, 294), vote=(2, 1, 3))
def _vote(s, p):
    """Enough of three momentum signs are positive."""
    votes = " + ".join(f"CASE WHEN c > {b(s, 'c', k)} THEN 1 ELSE 0 END" for k in (21, 63, p.slow))
    return f"{b(s, 'c', p.slow)} IS NOT NULL AND {votes} >= {p.vote}"


@rule("vol_trend", "momentum", first(lambda p: max(p.mom, p.vol + 125)), mom=(252, 210, 294), vol=(21, 14, 30))
def _vol_trend(s, p):
    """Momentum with volatility at or below its 126-day median."""
    v = ind.realized_vol(s, p.vol)
    return f"c > {b(s, 'c', p.mom)} AND {v} <= {rolling_median(s, v, 126)}"


# --- calendar -------------------------------------------------------------------

@rule("dow", "seasonality", first(0), dow=(0, 6, 1))
def _dow(s, p):
    """Tomorrow is one weekday."""
    return f"{ind.weekday_utc(s, ind.tomorrow(s))} = {p.dow}"


@rule("tom", "seasonality", first(0), last=(1, 2, 3), first=(3, 2, 4))
def _turn_of_month(s, p):
    """Tomorrow is among the last or first days of a month."""
    day = ind.tomorrow(s)
    dom = ind.day_of_month(s, day)
    return f"{dom} > {ind.days_in_month(s, day)} - {p.last} OR {dom} <= {p.first}"


@rule("halloween", "seasonality", first(0), start=(11, 10, 12))
def _halloween(s, p):
    """Tomorrow is in the six months from ``start``."""
    return f"({ind.month_of_year(s, ind.tomorrow(s))} - {p.start} + 12) % 12 < 6"


@rule("ichimoku_tk", "trend", first(lambda p: max(p.conv, p.base) - 1), conv=(9, 7, 12), base=(26, 22, 30))
def _tenkan_kijun(s, p):
    """Conversion line above the base line."""
    conv, base = ind.ichimoku_lines(s, p.conv, p.base)
    return f"{conv} > {base}"


@rule("guppy", "trend", first(lambda p: p.slow - 1), fast=(3, 2, 4), slow=(60, 55, 70))
def _guppy(s, p):
    """Every short average above every long one."""
    short = ", ".join(ema(s, "c", n) for n in (p.fast, 5, 8, 10, 12, 15))
    long = ", ".join(ema(s, "c", n) for n in (30, 35, 40, 45, 50, p.slow))
    return f"least({short}) > greatest({long})"


@rule("elder_ray", "trend", first(lambda p: p.n), n=(13, 10, 16))
def _elder_ray(s, p):
    """Average rising, bear power negative and rising."""
    line = ema(s, "c", p.n)
    bear = s.put(f"l - {line}")
    return f"{rising(s, line)} AND {bear} < 0 AND {rising(s, bear)}"


@rule("dema", "trend", first(lambda p: 2 * p.n - 1), n=(20, 15, 25))
def _dema(s, p):
    """Double average rising."""
    return rising(s, ind.dema(s, p.n))


@rule("cmo", "momentum", first(lambda p: p.n), n=(20, 14, 30))
def _cmo(s, p):
    """Chande momentum above zero."""
    return f"{ind.chande_momentum(s, p.n)} > 0"


@rule("qstick", "momentum", first(lambda p: p.n - 1), n=(8, 5, 12))
def _qstick(s, p):
    """Mean body above zero."""
    return f"{ind.qstick(s, p.n)} > 0"


@rule("kst", "momentum", first(lambda p: 43 + p.sig), sig=(9, 7, 12))
def _kst(s, p):
    """KST above its average."""
    x = ind.know_sure_thing(s)
    return f"{x} > {sma(s, x, p.sig)}"


@rule("schaff", "momentum", first(lambda p: 50 + 2 * (p.cycle - 1)), cycle=(10, 8, 12), buy=(25, 20, 30))
def _schaff(s, p):
    """In on a cross up through the buy line, out on a cross down through 75."""
    x = ind.schaff_trend(s, p.cycle)
    y = prev(s, x)
    return latch(s, f"{y} <= {p.buy} AND {x} > {p.buy}", f"{y} >= 75 AND {x} < 75")


@rule("fisher", "momentum", first(lambda p: p.n), n=(10, 7, 14))
def _fisher(s, p):
    """Fisher transform rising."""
    return rising(s, ind.fisher_transform(s, p.n))


@rule("rvi", "momentum", first(lambda p: p.n + 5), n=(10, 8, 14))
def _rvi(s, p):
    """Relative vigor above its signal."""
    x, sig = ind.relative_vigor(s, p.n)
    return f"{x} > {sig}"


@rule("dpo", "momentum", first(lambda p: p.n - 1), n=(20, 14, 30))
def _dpo(s, p):
    """Detrended price above zero."""
    return f"{ind.detrended_price(s, p.n)} > 0"


@rule("wilder_vol", "breakout", first(lambda p: p.atr), atr=(14, 10, 20), mult=(3, 2, 4))
def _wilder_vol(s, p):
    """In some ATR above yesterday's close, out the same below it."""
    band, y = f"{p.mult} * {atr_wilder(s, p.atr)}", prev(s, "c")
    return latch(s, f"c > {y} + {band}", f"c < {y} - {band}")


@rule("bb_squeeze", "breakout", first(lambda p: p.n + 1), n=(20, 15, 25), kc=(15, 12, 20))
def _squeeze(s, p):
    """Break of the upper band after a bar inside the Keltner channel. ``kc`` is tenths."""
    mid, low, high = bollinger(s, "c", p.n, 2.0)
    _, k_low, k_high = ind.keltner(s, p.n, p.n, p.kc / 10)
    tight = s.put(f"{high} < {k_high} AND {low} > {k_low}")
    return latch(s, f"{prev(s, tight)} AND c > {high}", f"c < {mid}")


@rule("turtle_soup", "mean_reversion", trend_or(lambda p: p.n), n=(20, 15, 25), hold=(2, 1, 3), trend=TREND)
def _turtle_soup(s, p):
    """Failed break of a prior low at least three days old, held some days."""
    level = prior_min(s, "l", p.n)
    old = s.put(f"min(l) OVER ({BY_DAY} ROWS BETWEEN {p.n} PRECEDING AND 3 PRECEDING)")
    hit = flag(s, with_trend(s, p, f"l < {level} AND c > {level} AND {old} = {level}"))
    return f"{s.recur('greedy_hold', [hit], hold=p.hold)} = 1"


@rule("rsi2_cum", "mean_reversion", first(lambda p: max(3, p.trend - 1, p.exit_ma - 1)), sum_lt=(35, 25, 45), trend=TREND, exit_ma=(5, 4, 6))
def _rsi2_sum(s, p):
    """Two-day RSI(2) sum low above trend; out above the exit average."""
    r = ind.rsi_wilder(s, "c", 2)
    return latch(s, f"{above_trend(s, p.trend)} AND {r} + {prev(s, r)} < {p.sum_lt}", f"c > {sma(s, 'c', p.exit_ma)}")


@rule("rev1m", "mean_reversion", trend_or(lambda p: p.n), n=(21, 15, 30), trend=TREND)
def _reversal(s, p):
    """Negative return above trend."""
    return with_trend(s, p, f"c < {b(s, 'c', p.n)}")


@rule("tsmom12_1", "momentum", first(lambda p: p.skip + p.slow), skip=(21, 15, 30), slow=(252, 210, 294))
def _skip_momentum(s, p):
    """Close ``skip`` ago above the close ``slow`` before it."""
    return f"{b(s, 'c', p.skip)} > {b(s, 'c', p.skip + p.slow)}"


rule("bll_trb150", "breakout", first(lambda p: p.n), n=(150, 120, 180), hold=(10, 8, 12))(_close_breakout_hold)


@rule("nr7", "breakout", trend_or(lambda p: p.n), n=(7, 4, 10), trend=TREND)
def _narrow(s, p):
    """Break of yesterday's high after the narrowest range, above trend."""
    x = span_col(s)
    tight = s.put(f"{x} < {prior_min(s, x, p.n - 1)}")
    return with_trend(s, p, f"{prev(s, tight)} AND c > {b(s, 'h')}")


@rule("inside_day", "breakout", first(lambda p: p.n), n=(1, 2, 3))
def _inside_day(s, p):
    """First break of an inside bar, upper side."""
    inside = s.put(f"h < {prior_max(s, 'h', p.n)} AND l > {prior_min(s, 'l', p.n)}")
    return first_break(s, inside, "h", "l")


@rule("floor_pivot", "trend", trend_or(1), trend=TREND)
def _floor_pivot(s, p):
    """Above yesterday's pivot and trend."""
    return with_trend(s, p, f"c > ({b(s, 'h')} + {b(s, 'l')} + {b(s, 'c')}) / 3")


@rule("fractal", "breakout", first(lambda p: 2 * p.wings), wings=(2, 1, 3))
def _fractal(s, p):
    """In above the latest confirmed up fractal, out below the latest down fractal."""
    w = p.wings
    def level(x, agg, op):
        mid = b(s, x, w)
        left = s.put(f"{agg}({x}) OVER ({BY_DAY} ROWS BETWEEN {2 * w} PRECEDING AND {w + 1} PRECEDING)")
        right = s.put(f"{agg}({x}) {rows(w)}")
        return kept(s, s.put(f"CASE WHEN {s.t} >= {2 * w} AND {mid} {op} {left} AND {mid} {op} {right} THEN {mid} END"))
    return latch(s, f"c > {level('h', 'max', '>')}", f"c < {level('l', 'min', '<')}")


@rule("mass_index", "mean_reversion", trend_or(lambda p: 2 * (p.ema - 1) + p.span), ema=(9, 7, 12), span=(25, 20, 30), trend=TREND)
def _mass_index(s, p):
    """Bulge over 27 then under 26.5 above trend; out below trend."""
    x, m = ind.mass_index(s, p.ema, p.span), sma(s, "c", p.trend)
    return f"{s.recur('bulge', [x, flag(s, f'c > {m}'), flag(s, f'c < {m}')], top=27.0, back=26.5)} = 1"


@rule("relvol", "momentum", first(lambda p: 2 * p.n - 2), n=(14, 10, 20), thr=(50, 45, 55))
def _relvol(s, p):
    """Relative volatility index above a level."""
    return f"{ind.relative_volatility(s, p.n)} > {p.thr}"


@rule("ulcer", "trend", trend_or(lambda p: p.n + 98), n=(14, 10, 21), trend=TREND)
def _ulcer(s, p):
    """Quiet ulcer index."""
    return quiet(s, ind.ulcer_index(s, p.n), p)


@rule("weekend", "seasonality", first(0), span=(2, 1, 3))
def _weekend(s, p):
    """Flat for the last ``span`` days of the week, long otherwise."""
    return f"{ind.weekday_utc(s, ind.tomorrow(s))} < {7 - max(1, min(3, p.span))}"


@rule("elder_impulse", "trend", first(lambda p: max(p.n, 34)), n=(13, 10, 16))
def _impulse(s, p):
    """Average and MACD histogram rising."""
    return f"{rising(s, ema(s, 'c', p.n))} AND {rising(s, ind.macd_histogram(s, 12, 26, 9))}"


@rule("macd_hist", "momentum", first(lambda p: 25 + p.signal), signal=(9, 7, 12))
def _macd_hist(s, p):
    """MACD histogram rising."""
    return rising(s, ind.macd_histogram(s, 12, 26, p.signal))


@rule("tsi", "momentum", first(lambda p: p.long + p.short - 1), long=(25, 20, 30), short=(13, 10, 16))
def _tsi(s, p):
    """True strength above zero."""
    return f"{ind.true_strength_index(s, p.long, p.short)} > 0"


@rule("awesome", "momentum", first(lambda p: max(p.fast, p.slow) - 1), fast=(5, 3, 8), slow=(34, 28, 40))
def _awesome(s, p):
    """Awesome oscillator above zero."""
    return f"{ind.awesome_oscillator(s, p.fast, p.slow)} > 0"


def _alligator_lines(s, p):
    return [prev(s, smma(s, "c", n), shift) for n, shift in ((p.lips, 3), (8, 5), (p.jaw, 8))]


def _alligator_first(p):
    return max(p.lips + 2, 12, p.jaw + 7)


_alligator_grid = dict(lips=(5, 3, 7), jaw=(13, 10, 16))


@rule("alligator", "trend", first(_alligator_first), **_alligator_grid)
def _alligator(s, p):
    """Lips above teeth above jaw."""
    lips, teeth, jaw = _alligator_lines(s, p)
    return f"{lips} > {teeth} AND {teeth} > {jaw}"


@rule("bop", "momentum", first(lambda p: p.n - 1), n=(14, 10, 20))
def _bop(s, p):
    """Balance of power above zero."""
    return f"{ind.balance_of_power(s, p.n)} > 0"


@rule("psych", "momentum", first(lambda p: p.n), n=(12, 8, 18), thr=(50, 45, 55))
def _psych(s, p):
    """Share of up closes above a level."""
    return f"{ind.psychological_line(s, p.n)} > {p.thr}"


@rule("chop", "trend", trend_or(lambda p: p.n - 1), n=(14, 10, 20), trend=TREND)
def _chop(s, p):
    """Low choppiness above trend."""
    return with_trend(s, p, f"{ind.choppiness_index(s, p.n)} < 38.2D")


@rule("rwi", "trend", first(lambda p: p.n), n=(14, 8, 20))
def _rwi(s, p):
    """Random walk index of highs above 1 and above that of lows."""
    up, down = ind.random_walk_index(s, p.n)
    return f"{up} > 1 AND {up} > {down}"


@rule("asi", "momentum", first(lambda p: p.n), n=(1, 2, 5))
def _asi(s, p):
    """Mean swing index above zero."""
    x = ind.swing_index(s)
    return f"{x if p.n == 1 else sma(s, x, p.n)} > 0"


@rule("darvas", "breakout", first(lambda p: p.look + p.confirm), look=(20, 15, 30), confirm=(3, 2, 4))
def _darvas(s, p):
    """Break of a box whose top held, until its floor breaks."""
    return f"{s.recur('box', ['h', 'l', 'c', prior_max(s, 'h', p.look)], confirm=p.confirm)} = 1"


@rule("ichimoku_cloud", "trend", first(lambda p: max(p.conv, p.base, p.span) - 1 + p.base), **_cloud_grid)
def _cloud(s, p):
    """Leading span A above span B."""
    a, z = ind.ichimoku_spans(s, p.conv, p.base, p.span)
    return f"{a} > {z}"


def run_length(s, text):
    """Rows since the predicate last failed."""
    miss = s.put(f"CASE WHEN NOT coalesce({text}, false) THEN {s.t} END")
    return f"({s.t} - coalesce({kept(s, miss)}, -1))"


@rule("td_setup", "trend", trend_or(4), count=(9, 8, 10), trend=TREND)
def _td_setup(s, p):
    """Long run of closes above the close four days earlier, above trend."""
    return with_trend(s, p, f"{run_length(s, f'c > {lag("c", 4)}')} >= {p.count}")


@rule("rei", "momentum", first(lambda p: p.n + 5), n=(5, 4, 8))
def _rei(s, p):
    """Range expansion above zero."""
    return f"{ind.range_expansion_index(s, p.n)} > 0"


@rule("linreg", "trend", first(lambda p: p.n - 1), n=(20, 14, 30))
def _linreg(s, p):
    """Least-squares slope above zero."""
    return f"{ind.linreg_slope(s, 'c', p.n)} > 0"


@rule("mom_mid", "momentum", first(lambda p: max(p.mid, p.slow)), mid=(126, 105, 147), slow=(252, 210, 294))
def _mom_mid(s, p):
    """Older half-year return is positive."""
    return f"{b(s, 'c', p.mid)} > {b(s, 'c', p.slow)}"


@rule("first_half", "seasonality", first(0), through=(15, 10, 20))
def _first_half(s, p):
    """Tomorrow is early in the month."""
    return f"{ind.day_of_month(s, ind.tomorrow(s))} <= {p.through}"


@rule("laguerre", "momentum", first(1), gamma=(50, 40, 60), thr=(50, 40, 60))
def _laguerre(s, p):
    """Laguerre RSI above a level, both in hundredths."""
    return f"{ind.laguerre_rsi(s, p.gamma / 100)} > {p.thr / 100}D"


@rule("vidya", "trend", first(lambda p: p.n), n=(20, 14, 30))
def _vidya(s, p):
    """Close above VIDYA."""
    return f"c > {ind.vidya(s, p.n)}"


@rule("t3", "trend", first(lambda p: 6 * (p.n - 1)), n=(5, 3, 8), vf=(70, 60, 80))
def _t3(s, p):
    """Close above T3, factor in hundredths."""
    return f"c > {ind.tillson_t3(s, p.n, p.vf / 100)}"


@rule("rmi", "momentum", first(lambda p: p.mom + p.n - 1), mom=(5, 3, 8), n=(14, 10, 20), thr=(50, 45, 55))
def _rmi(s, p):
    """Relative momentum above a level."""
    return f"{ind.relative_momentum_index(s, p.mom, p.n)} > {p.thr}"


@rule("double7", "mean_reversion", trend_or(lambda p: p.n - 1), n=(7, 5, 9), trend=TREND)
def _double7(s, p):
    """In on the lowest close above trend, out on the highest close."""
    return latch(s, f"{above_trend(s, p.trend)} AND c <= {rolling_min(s, 'c', p.n)}", f"c >= {rolling_max(s, 'c', p.n)}")


@rule("mcginley", "trend", first(lambda p: p.n - 1), n=(20, 14, 30))
def _mcginley(s, p):
    """Close above the McGinley average."""
    return f"c > {ind.mcginley_dynamic(s, p.n)}"


@rule("stoch_pop", "momentum", first(lambda p: p.k), k=(14, 10, 20), pop=(80, 75, 85))
def _stoch_pop(s, p):
    """In on a cross up through the line, out on a cross down."""
    k = ind.stochastic_k(s, p.k)
    y = prev(s, k)
    return latch(s, f"{y} <= {p.pop} AND {k} > {p.pop}", f"{y} >= {p.pop} AND {k} < {p.pop}")


@rule("outside", "breakout", first(lambda p: p.n), n=(1, 2, 3))
def _outside(s, p):
    """First break of an outside bar, upper side."""
    outside = s.put(f"h > {prior_max(s, 'h', p.n)} AND l < {prior_min(s, 'l', p.n)}")
    return first_break(s, outside, "h", "l")


@rule("three_dn", "mean_reversion", first(lambda p: max(p.n, p.trend - 1, p.exit_ma - 1)), n=(3, 2, 4), trend=TREND, exit_ma=(5, 4, 6))
def _three_down(s, p):
    """Falling closes above trend; out above the exit average."""
    fell = " AND ".join(f"{b(s, 'c', k)} < {b(s, 'c', k + 1)}" for k in range(p.n))
    return latch(s, f"{fell} AND {above_trend(s, p.trend)}", f"c > {sma(s, 'c', p.exit_ma)}")


@rule("demarker", "momentum", first(lambda p: p.n), n=(14, 10, 20))
def _demarker(s, p):
    """DeMarker above one half."""
    return f"{ind.demarker(s, p.n)} > 0.5D"


def _countdown(s, p, hit, guard):
    side = s.put(f"sign(c - {b(s, 'c', 4)})")
    return f"{s.recur('countdown', [side, flag(s, hit), 'l', 'c'], setup=p.setup, need=p.count, guard=guard)} = 1"


@rule("td_cd", "mean_reversion", first(4), setup=(9, 8, 10), count=(13, 12, 14))
def _td_countdown(s, p):
    """Completion of a countdown after a setup."""
    return _countdown(s, p, f"c <= {b(s, 'l', 2)}", 8)


@rule("trix_sig", "momentum", first(lambda p: 42 + p.signal), signal=(9, 7, 12))
def _trix_sig(s, p):
    """TRIX(15) above its average."""
    x = ind.trix(s, 15)
    return f"{x} > {sma(s, x, p.signal)}"


@rule("stoch_slow", "momentum", first(lambda p: p.k + 1 + 2 * (p.d - 1)), k=(14, 10, 20), d=(3, 2, 5))
def _stoch_slow(s, p):
    """Slow %D above its 3-day average."""
    d = sma(s, sma(s, ind.stochastic_k(s, p.k), p.d), p.d)
    return f"{d} > {sma(s, d, 3)}"


@rule("zlema", "trend", first(lambda p: (p.n - 1) // 2 + p.n - 1), n=(20, 14, 30))
def _zlema(s, p):
    """Close above the zero-lag average."""
    return f"c > {ind.zero_lag_ema(s, p.n)}"


@rule("frama", "trend", first(lambda p: p.n - 1), n=(16, 10, 20))
def _frama(s, p):
    """Close above FRAMA."""
    return f"c > {ind.frama(s, p.n)}"


@rule("ssmooth", "trend", first(2), n=(10, 7, 14))
def _ssmooth(s, p):
    """Close above the super smoother."""
    return f"c > {ind.super_smoother(s, p.n)}"


@rule("cyber", "momentum", first(6), alpha=(7, 5, 10))
def _cyber(s, p):
    """Cyber cycle rising, once past its seed."""
    return f"{s.t} >= 6 AND {rising(s, ind.cyber_cycle(s, p.alpha / 100))}"


@rule("lfilter", "trend", first(1), gamma=(50, 40, 60))
def _lfilter(s, p):
    """Close above the Laguerre filter."""
    return f"c > {ind.laguerre_filter(s, p.gamma / 100)}"


@rule("alma", "trend", first(lambda p: p.n - 1), n=(9, 6, 12), offset=(85, 75, 95))
def _alma(s, p):
    """Close above ALMA, sigma 6."""
    return f"c > {ind.alma(s, 'c', p.n, p.offset / 100, 6.0)}"


@rule("tlbreak", "breakout", first(lambda p: p.n + 1), n=(3, 2, 4))
def _tlbreak(s, p):
    """Between a white and a black line-break reversal."""
    return f"{s.recur('line_break', ['c'], n=p.n)} = 1"


# --- candles --------------------------------------------------------------------

def _engulfing(s, k=0):
    o, c, po, pc = b(s, "o", k), b(s, "c", k), b(s, "o", k + 1), b(s, "c", k + 1)
    return f"{pc} < {po} AND {c} > {o} AND {o} <= {pc} AND {c} >= {po} AND {c} - {o} > {po} - {pc}"


@rule("engulf", "mean_reversion", trend_or(1), trend=TREND)
def _engulf(s, p):
    """White body engulfs the prior black body, above trend."""
    return with_trend(s, p, _engulfing(s))


@rule("pierce", "mean_reversion", trend_or(1), trend=TREND)
def _pierce(s, p):
    """White close over the middle of a black body after a lower low, above trend."""
    o1, c1 = b(s, "o"), b(s, "c")
    return with_trend(s, p, f"{black(s, 1)} AND {white(s)} AND l < {b(s, 'l')} AND c > ({o1} + {c1}) / 2 AND c < {o1}")


@rule("soldiers", "trend", trend_or(3), trend=TREND)
def _soldiers(s, p):
    """Three white candles opening inside the prior body and closing near the high."""
    tests = []
    for k in range(3):
        o, c, h, po, pc = b(s, "o", k), b(s, "c", k), b(s, "h", k), b(s, "o", k + 1), b(s, "c", k + 1)
        tests.append(
            f"{c} > {o} AND {c} > {pc} AND {po} <> {pc} AND {o} BETWEEN least({po}, {pc}) AND greatest({po}, {pc})"
            f" AND {h} - {c} <= {c} - {o}"
        )
    return with_trend(s, p, " AND ".join(tests))


@rule("oops", "mean_reversion", first(lambda p: p.n), n=(1, 2, 3))
def _oops(s, p):
    """Failed break of the prior low."""
    x = prior_min(s, "l", p.n)
    return f"l < {x} AND c > {x}"


@rule("vratio", "trend", trend_or(lambda p: p.win), q=(16, 8, 32), win=(128, 96, 192), trend=TREND)
def _vratio(s, p):
    """Variance ratio above 1, above trend."""
    return with_trend(s, p, f"{ind.variance_ratio(s, p.q, p.win)} > 1") if p.win > p.q else "false"


@rule("vhf", "trend", trend_or(lambda p: p.n + 99), n=(28, 21, 35), trend=TREND)
def _vhf(s, p):
    """VHF above its 100-day median, above trend."""
    x = ind.vertical_horizontal_filter(s, p.n)
    return with_trend(s, p, f"{x} > {rolling_median(s, x, 100)}")


@rule("accel", "momentum", first(lambda p: 32 + p.smooth), smooth=(5, 3, 8))
def _accel(s, p):
    """Awesome oscillator above its average."""
    x = ind.awesome_oscillator(s, 5, 34)
    return f"{x} > {sma(s, x, p.smooth)}"


def _gaps(s, p):
    lips, teeth, jaw = _alligator_lines(s, p)
    return s.put(f"abs({jaw} - {teeth})"), s.put(f"abs({teeth} - {lips})"), f"{lips} > {jaw}"


@rule("gator", "trend", first(lambda p: _alligator_first(p) + 1), **_alligator_grid)
def _gator(s, p):
    """Both alligator gaps widening, lips above jaw."""
    x, y, ordered = _gaps(s, p)
    return f"{rising(s, x)} AND {rising(s, y)} AND {ordered}"


@rule("camarilla", "trend", trend_or(1), trend=TREND)
def _camarilla(s, p):
    """Above yesterday's H3 and trend."""
    return with_trend(s, p, f"c > {b(s, 'c')} + ({b(s, 'h')} - {b(s, 'l')}) * 1.1D / 4")


@rule("regline", "trend", first(lambda p: p.n - 1), n=(20, 14, 30))
def _regline(s, p):
    """Close above the regression value."""
    return f"c > {ind.linreg_value(s, 'c', p.n)}"


@rule("gk", "trend", trend_or(lambda p: p.n + 98), n=(14, 10, 20), trend=TREND)
def _gk(s, p):
    """Quiet Garman-Klass variance."""
    return quiet(s, ind.garman_klass(s, p.n), p)


def _harami_at(s, k=0):
    o, c, po, pc = b(s, "o", k), b(s, "c", k), b(s, "o", k + 1), b(s, "c", k + 1)
    return f"{pc} < {po} AND greatest({o}, {c}) < {po} AND least({o}, {c}) > {pc}"


@rule("harami", "mean_reversion", trend_or(1), trend=TREND)
def _harami(s, p):
    """Body inside the prior black body, above trend."""
    return with_trend(s, p, _harami_at(s))


@rule("expiry", "seasonality", first(0), n=(3, 2, 4))
def _expiry(s, p):
    """Tomorrow is among the sessions ending on the third Friday."""
    day = ind.tomorrow(s)
    dom, third = ind.day_of_month(s, day), ind.third_friday_dom(s, day)
    return f"{dom} BETWEEN {third} - {p.n - 1} AND {third}"


@rule("smi", "momentum", first(lambda p: p.n + 3), n=(10, 8, 14))
def _smi(s, p):
    """Stochastic momentum above zero."""
    return f"{ind.stochastic_momentum_index(s, p.n, 3)} > 0"


@rule("tsi_sig", "momentum", first(lambda p: 36 + p.signal), signal=(7, 5, 9))
def _tsi_sig(s, p):
    """TSI(25, 13) above its signal average."""
    x = ind.true_strength_index(s, 25, 13)
    return f"{x} > {ema(s, x, p.signal)}"


@rule("cmo_sig", "momentum", first(lambda p: 13 + p.signal), signal=(9, 7, 12))
def _cmo_sig(s, p):
    """CMO(14) above its average."""
    x = ind.chande_momentum(s, 14)
    return f"{x} > {sma(s, x, p.signal)}"


@rule("mama", "trend", first(ind.HILBERT_READY), fast=(50, 40, 60))
def _mama(s, p):
    """Close above MAMA."""
    return f"c > {ind.mesa_adaptive(s, p.fast / 100, 0.05)[0]}"


@rule("itrend", "trend", first(6), alpha=(7, 5, 10))
def _itrend(s, p):
    """Close above the instantaneous trendline."""
    return f"c > {ind.instantaneous_trendline(s, p.alpha / 100)}"


@rule("ebsw", "momentum", first(ind.HILBERT_READY), lead=(45, 30, 60))
def _ebsw(s, p):
    """Sine of the phase above its lead."""
    x = ind.mesa_adaptive(s, 0.5, 0.05)[1]
    return f"sin(radians({x})) > sin(radians({x}) + radians({p.lead}D))"


@rule("eratio", "trend", trend_or(lambda p: p.n), n=(10, 8, 14), trend=TREND)
def _eratio(s, p):
    """Efficient path above trend."""
    return with_trend(s, p, f"{ind.efficiency_ratio(s, p.n)} > 0.3D")


@rule("rsquared", "trend", first(lambda p: p.n - 1), n=(20, 15, 30))
def _rsquared(s, p):
    """Good fit with a rising slope."""
    return f"{ind.linreg_r2(s, 'c', p.n)} > 0.4D AND {ind.linreg_slope(s, 'c', p.n)} > 0"


@rule("seband", "trend", first(lambda p: p.n - 1), n=(20, 15, 30))
def _seband(s, p):
    """Close a standard error above the regression value."""
    return f"c > {ind.linreg_value(s, 'c', p.n)} + {ind.linreg_stderr(s, 'c', p.n)}"


@rule("kagi", "breakout", first(1), rev=(2, 1, 3))
def _kagi(s, p):
    """Between a rising and a falling kagi reversal."""
    return f"{s.recur('kagi', ['c'], rev=p.rev / 100)} = 1"


@rule("renko", "breakout", first(1), brick=(1, 2, 3))
def _renko(s, p):
    """Latest brick is white."""
    return f"{s.recur('renko', ['c'], pct=p.brick / 100)} = 1"


@rule("morning", "mean_reversion", trend_or(2), trend=TREND)
def _morning(s, p):
    """Black body, small low body, white close over the first midpoint, above trend."""
    o2, c2 = b(s, "o", 2), b(s, "c", 2)
    mid = f"({o2} + {c2}) / 2"
    return with_trend(
        s, p,
        f"{o2} > {c2} AND {body(s, 1)} < {o2} - {c2} AND greatest({b(s, 'o')}, {b(s, 'c')}) < {mid}"
        f" AND {white(s)} AND c > {mid}",
    )


@rule("hammer", "mean_reversion", trend_or(2), trend=TREND)
def _hammer(s, p):
    """Long lower shadow, body in the top third, after a down close."""
    return with_trend(
        s, p,
        f"h > l AND {b(s, 'c')} < {b(s, 'c', 2)} AND least(o, c) - l >= 2 * (greatest(o, c) - least(o, c))"
        " AND least(o, c) >= l + 2 * (h - l) / 3",
    )


@rule("rising3", "trend", trend_or(4), trend=TREND)
def _rising3(s, p):
    """White candle, three small bars inside it, then a higher white close."""
    c4, o4, h4, l4 = (b(s, x, 4) for x in ("c", "o", "h", "l"))
    held = " AND ".join(f"{body(s, k)} < {c4} - {o4} AND {b(s, 'h', k)} <= {h4} AND {b(s, 'l', k)} >= {l4}" for k in (3, 2, 1))
    return with_trend(s, p, f"{c4} > {o4} AND {held} AND {white(s)} AND c > {c4}")


@rule("three_out", "mean_reversion", trend_or(2), trend=TREND)
def _three_out(s, p):
    """Engulfing, then a higher close, above trend."""
    return with_trend(s, p, f"{_engulfing(s, 1)} AND c > {b(s, 'c')}")


@rule("twobar", "mean_reversion", first(lambda p: p.n), n=(1, 2, 3))
def _twobar(s, p):
    """Lower low and a close above the prior high."""
    return f"l < {prior_min(s, 'l', p.n)} AND c > {prior_max(s, 'h', p.n)}"


@rule("td_combo", "mean_reversion", trend_or(4), setup=(9, 8, 10), count=(13, 12, 14), trend=TREND)
def _td_combo(s, p):
    """Completion of a combo count after a setup, above trend."""
    return with_trend(s, p, _countdown(s, p, f"c <= {b(s, 'c', 2)}", 0))


@rule("di_cross", "trend", first(lambda p: p.n), n=(14, 10, 20))
def _di_cross(s, p):
    """+DI above -DI."""
    plus, minus, _ = ind.adx_wilder(s, p.n)
    return f"{plus} > {minus}"


@rule("woodie", "trend", trend_or(1), trend=TREND)
def _woodie(s, p):
    """Above yesterday's close-weighted pivot and trend."""
    return with_trend(s, p, f"c > ({b(s, 'h')} + {b(s, 'l')} + 2 * {b(s, 'c')}) / 4")


@rule("fibhold", "trend", trend_or(lambda p: p.n), n=(20, 14, 30), trend=TREND)
def _fibhold(s, p):
    """Above 61.8 percent of the prior range and trend."""
    lo, hi = prior_min(s, "l", p.n), prior_max(s, "h", p.n)
    return with_trend(s, p, f"c > {lo} + 0.618D * ({hi} - {lo})")


@rule("saucer", "momentum", trend_or(35), trend=TREND)
def _saucer(s, p):
    """Oscillator turns up below zero, above trend."""
    x = ind.awesome_oscillator(s, 5, 34)
    x1, x2 = prev(s, x), prev(s, x, 2)
    return with_trend(s, p, f"{x2} < 0 AND {x1} < 0 AND {x} < 0 AND {x1} < {x2} AND {x} > {x1}")


@rule("gator_wake", "trend", first(lambda p: _alligator_first(p) + 2), **_alligator_grid)
def _gator_wake(s, p):
    """Both gaps shrank yesterday and grow today, lips above jaw."""
    x, y, ordered = _gaps(s, p)
    turn = " AND ".join(f"{prev(s, g, 2)} > {prev(s, g)} AND {g} > {prev(s, g)}" for g in (x, y))
    return f"{turn} AND {ordered}"


def _signal_average(key, base, at, make):
    @rule(key, "momentum", first(lambda p: at + p.signal - 1), signal=base)
    def fn(s, p):
        """Oscillator of a fixed length above its own average."""
        x = make(s)
        return f"{x} > {sma(s, x, p.signal)}"

    return fn


_signal_average("rsi_sig", (9, 7, 12), 14, lambda s: ind.rsi_wilder(s, "c", 14))
_signal_average("dm_sig", (9, 7, 12), 14, lambda s: ind.demarker(s, 14))
_signal_average("qstick_sig", (5, 3, 8), 7, lambda s: ind.qstick(s, 8))
_signal_average("dpo_sig", (9, 7, 12), 19, lambda s: ind.detrended_price(s, 20))
_signal_average("bop_sig", (9, 7, 12), 13, lambda s: ind.balance_of_power(s, 14))
_signal_average("psych_sig", (5, 3, 8), 12, lambda s: ind.psychological_line(s, 12))


@rule("fisher_z", "momentum", first(lambda p: p.n - 1), n=(10, 7, 14))
def _fisher_z(s, p):
    """Fisher transform above zero."""
    return f"{ind.fisher_transform(s, p.n)} > 0"


@rule("cyber_z", "momentum", first(6), alpha=(7, 5, 10))
def _cyber_z(s, p):
    """Cyber cycle above zero, once past its seed."""
    return f"{s.t} >= 6 AND {ind.cyber_cycle(s, p.alpha / 100)} > 0"


@rule("cog", "momentum", first(lambda p: p.n), n=(10, 8, 14))
def _cog(s, p):
    """Center of gravity rising."""
    return rising(s, ind.center_of_gravity(s, "c", p.n))


@rule("roof", "momentum", first(lambda p: p.n), n=(48, 40, 60))
def _roof(s, p):
    """Roofing filter above zero, once past its start-up."""
    return f"{s.t} >= {p.n} AND {ind.roofing_filter(s, p.n, 10)} > 0"


@rule("spearman", "trend", first(lambda p: p.n - 1), n=(10, 8, 14))
def _spearman(s, p):
    """Rank correlation with time above zero."""
    return f"{ind.spearman_rho(s, 'c', p.n)} > 0"


@rule("theil", "trend", first(lambda p: p.n - 1), n=(10, 8, 14))
def _theil(s, p):
    """Median pairwise slope above zero."""
    return f"{ind.theil_sen_slope(s, 'c', p.n)} > 0"


@rule("hma_px", "trend", first(lambda p: p.n + _root(p.n) - 2), n=(16, 9, 25))
def _hma_px(s, p):
    """Close above the Hull average."""
    return f"c > {ind.hull_ma(s, 'c', p.n)}"


@rule("matchlow", "mean_reversion", trend_or(5), trend=TREND)
def _matchlow(s, p):
    """Two black candles with matching lows, above trend."""
    return with_trend(s, p, f"{black(s, 1)} AND {black(s)} AND abs(l - {b(s, 'l')}) <= {equal_band(s)}")


@rule("invhammer", "mean_reversion", trend_or(2), trend=TREND)
def _invhammer(s, p):
    """Long upper shadow, body in the bottom third, after a down close."""
    return with_trend(
        s, p,
        f"h > l AND {b(s, 'c')} < {b(s, 'c', 2)} AND h - greatest(o, c) >= 2 * (greatest(o, c) - least(o, c))"
        " AND greatest(o, c) <= l + (h - l) / 3",
    )


@rule("strike", "mean_reversion", trend_or(3), trend=TREND)
def _strike(s, p):
    """Three black candles, then a white close over the first open."""
    return with_trend(
        s, p,
        f"{black(s, 3)} AND {black(s, 2)} AND {black(s, 1)} AND {white(s)} AND o <= {b(s, 'c')} AND c > {b(s, 'o', 3)}",
    )


def _long_body(s):
    """(body floor, shadow cap) from the prior ten rows."""
    floor = prior_mean(s, s.put("abs(c - o)"), 10)
    return floor, s.put(f"0.1D * {prior_mean(s, span_col(s), 10)}")


@rule("belt", "mean_reversion", trend_or(10), trend=TREND)
def _belt(s, p):
    """Long white body opening near its low after a down close."""
    floor, cap = _long_body(s)
    return with_trend(
        s, p,
        f"c > o AND {b(s, 'c')} < {b(s, 'c', 2)} AND c - o > {floor} AND o - l < {cap} AND h - c <= c - o",
    )


@rule("aroon_hi", "trend", first(lambda p: p.n), n=(25, 20, 30))
def _aroon_hi(s, p):
    """Aroon up above 70 and down below 30."""
    up, down = ind.aroon(s, p.n)
    return f"{up} > 70 AND {down} < 30"


@rule("imi", "momentum", first(lambda p: p.n - 1), n=(14, 10, 20))
def _imi(s, p):
    """Intraday momentum above 50."""
    return f"{ind.intraday_momentum(s, p.n)} > 50"


@rule("rsi_fail", "mean_reversion", trend_or(14), trend=TREND)
def _rsi_fail(s, p):
    """RSI(14) failure swing above 30, above trend."""
    x = s.recur("failure_swing", [ind.rsi_wilder(s, "c", 14)], floor=30.0)
    return with_trend(s, p, f"{x} = 1")


@rule("rvi_z", "momentum", first(lambda p: p.n + 2), n=(10, 8, 14))
def _rvi_z(s, p):
    """Relative vigor above zero."""
    return f"{ind.relative_vigor(s, p.n)[0]} > 0"


@rule("ao_up", "momentum", first(lambda p: p.n), n=(34, 28, 40))
def _ao_up(s, p):
    """Awesome oscillator rising."""
    return rising(s, ind.awesome_oscillator(s, 5, p.n))


@rule("stoch50", "momentum", first(lambda p: p.k - 1), k=(14, 10, 20))
def _stoch50(s, p):
    """Fast %K above 50."""
    return f"{ind.stochastic_k(s, p.k)} > 50"


@rule("bull_pwr", "trend", first(lambda p: p.n), n=(13, 10, 16))
def _bull_power(s, p):
    """High above a rising average."""
    x = ema(s, "c", p.n)
    return f"h > {x} AND {rising(s, x)}"


@rule("dm_pivot", "trend", trend_or(1), trend=TREND)
def _dm_pivot(s, p):
    """Above yesterday's DeMark pivot and trend."""
    o, h, l, c = (b(s, x) for x in PRICES)
    pivot = (
        f"CASE WHEN {c} < {o} THEN {h} + 2 * {l} + {c} WHEN {c} > {o} THEN 2 * {h} + {l} + {c}"
        f" ELSE {h} + {l} + 2 * {c} END / 4"
    )
    return with_trend(s, p, f"c > {pivot}")


@rule("t3_up", "trend", first(lambda p: 6 * (p.n - 1) + 1), n=(5, 3, 8))
def _t3_up(s, p):
    """T3 rising."""
    return rising(s, ind.tillson_t3(s, p.n, 0.7))


@rule("alma_up", "trend", first(lambda p: p.n), n=(9, 6, 12))
def _alma_up(s, p):
    """ALMA rising."""
    return rising(s, ind.alma(s, "c", p.n, 0.85, 6.0))


@rule("zlema_up", "trend", first(lambda p: (p.n - 1) // 2 + p.n), n=(20, 14, 30))
def _zlema_up(s, p):
    """Zero-lag average rising."""
    return rising(s, ind.zero_lag_ema(s, p.n))


@rule("frama_up", "trend", first(lambda p: p.n), n=(16, 10, 20))
def _frama_up(s, p):
    """FRAMA rising."""
    return rising(s, ind.frama(s, p.n))


@rule("ss_up", "trend", first(3), n=(10, 7, 14))
def _ss_up(s, p):
    """Super smoother rising."""
    return rising(s, ind.super_smoother(s, p.n))


@rule("mama_up", "trend", first(ind.HILBERT_READY + 1), fast=(50, 40, 60))
def _mama_up(s, p):
    """MAMA rising."""
    return rising(s, ind.mesa_adaptive(s, p.fast / 100, 0.05)[0])


@rule("itrend_up", "trend", first(7), alpha=(7, 5, 10))
def _itrend_up(s, p):
    """Instantaneous trendline rising."""
    return rising(s, ind.instantaneous_trendline(s, p.alpha / 100))


@rule("breakaway", "mean_reversion", trend_or(4), trend=TREND)
def _breakaway(s, p):
    """Black candle, three small bodies under its low, then a higher white close."""
    o4, c4 = b(s, "o", 4), b(s, "c", 4)
    small = " AND ".join(f"{body(s, k)} < {o4} - {c4}" for k in (3, 2, 1))
    under = f"least({b(s, 'l', 3)}, {b(s, 'l', 2)}, {b(s, 'l')}) < {b(s, 'l', 4)}"
    return with_trend(s, p, f"{o4} > {c4} AND {small} AND {under} AND {white(s)} AND c > {c4}")


@rule("er_sign", "trend", first(lambda p: p.n), n=(10, 8, 14))
def _er_sign(s, p):
    """Signed efficiency above 0.3."""
    return f"{ind.signed_efficiency(s, p.n)} > 0.3D"


@rule("schaff50", "momentum", first(lambda p: 49 + 2 * (p.cycle - 1)), cycle=(10, 8, 12))
def _schaff50(s, p):
    """Schaff cycle above 50."""
    return f"{ind.schaff_trend(s, p.cycle)} > 50"


@rule("bandpass", "momentum", first(lambda p: p.n), n=(30, 20, 40))
def _bandpass(s, p):
    """Band-pass above zero, once past its start-up."""
    return f"{s.t} >= {p.n} AND {ind.band_pass(s, p.n, 0.3)} > 0"


def _safezone_warm(s, p):
    downs = s.put(f"CASE WHEN c < {lag('c')} THEN 1 END")
    return f"count({downs}) {so_far()} >= 10 AND {s.t} >= {p.n - 1}"


@rule("safezone", "trend", _safezone_warm, n=(20, 15, 30))
def _safezone(s, p):
    """Above a stop that ratchets up while long."""
    return f"{s.recur('ratchet', ['c', ind.safezone_stop(s, p.n)])} = 1"


@rule("holy", "trend", first(lambda p: max(p.n - 1, 199)), n=(20, 15, 30))
def _holy(s, p):
    """Strong fading ADX(14) and a low that tags the average, above the 200-day one."""
    adx, line = ind.adx_wilder(s, 14)[2], ema(s, "c", p.n)
    return f"l <= {line} AND c > {line} AND {adx} > 30 AND {adx} < {prev(s, adx)} AND {above_trend(s, 200)}"


@rule("bar8020", "momentum", trend_or(0), trend=TREND)
def _bar8020(s, p):
    """Open in the bottom fifth and close in the top fifth."""
    return with_trend(s, p, "(o - l) / nullif(h - l, 0) <= 0.2D AND (c - l) / nullif(h - l, 0) >= 0.8D")


@rule("keyrev", "mean_reversion", trend_or(2), trend=TREND)
def _keyrev(s, p):
    """Lower low and higher close after a down close."""
    return with_trend(s, p, f"l < {b(s, 'l')} AND c > {b(s, 'c')} AND {b(s, 'c')} < {b(s, 'c', 2)}")


@rule("three_in", "mean_reversion", trend_or(2), trend=TREND)
def _three_in(s, p):
    """Harami, then a close over the first high."""
    return with_trend(s, p, f"{_harami_at(s, 1)} AND c > {b(s, 'h', 2)}")


@rule("meet", "mean_reversion", trend_or(5), trend=TREND)
def _meet(s, p):
    """White close matching a black close."""
    return with_trend(s, p, f"{black(s, 1)} AND {white(s)} AND abs(c - {b(s, 'c')}) <= {equal_band(s)}")


@rule("separate", "trend", trend_or(5), trend=TREND)
def _separate(s, p):
    """White open matching a black open."""
    return with_trend(s, p, f"{black(s, 1)} AND {white(s)} AND abs(o - {b(s, 'o')}) <= {equal_band(s)}")


@rule("pnf", "breakout", first(1), box=(1, 2, 3))
def _pnf(s, p):
    """Rising column tops the last one, until a falling one undercuts."""
    return f"{s.recur('columns_chart', ['c'], pct=p.box / 100)} = 1"


@rule("ha", "trend", first(lambda p: max(p.n - 1, 1)), n=(1, 2, 3))
def _heikin(s, p):
    """Run of white Heikin-Ashi candles."""
    close = s.put("(o + h + l + c) / 4")
    seed = s.put(f"CASE WHEN {s.t} = 0 THEN (o + c) / 2 END")
    opened = s.recur("two_pole", [f"0.5D * {lag(close)}", seed], a1=0.5, a2=0.0)
    up = flag(s, f"{close} > {opened}")
    return f"{s.t} > 0 AND sum({up}) {rows(p.n)} = {p.n}"


@rule("kase", "trend", first(lambda p: p.n - 1), n=(20, 15, 30))
def _kase(s, p):
    """Above a deviation stop that ratchets up while long."""
    return f"{s.recur('ratchet', ['c', ind.kase_devstop(s, p.n)])} = 1"


@rule("yz", "trend", trend_or(lambda p: p.n + 99), n=(20, 15, 30), trend=TREND)
def _yz(s, p):
    """Quiet Yang-Zhang variance."""
    return quiet(s, ind.yang_zhang(s, p.n), p)


@rule("rsvol", "trend", trend_or(lambda p: p.n + 98), n=(20, 15, 30), trend=TREND)
def _rsvol(s, p):
    """Quiet Rogers-Satchell variance."""
    return quiet(s, ind.rogers_satchell(s, p.n), p)


@rule("tii", "trend", first(lambda p: p.n - 1), n=(20, 15, 30))
def _tii(s, p):
    """Trend intensity above 50."""
    return f"{ind.trend_intensity(s, p.n)} > 50"


@rule("cv", "trend", first(lambda p: max(2 * p.n - 1, 199)), n=(10, 8, 14))
def _chaikin_vol(s, p):
    """Range average expanding, above the 200-day average."""
    x = ema(s, span_col(s), p.n)
    y = prev(s, x, p.n)
    return f"{y} > 0 AND {x} > {y} AND {above_trend(s, 200)}"


@rule("dcyc", "momentum", first(lambda p: p.n * 50), n=(1, 2, 3))
def _dominant(s, p):
    """Close above the close some dominant cycles ago."""
    period = ind.dominant_period(s)
    back_by = s.put(
        f"CAST(greatest(6, least(50, bround({period}))) AS INT) * {p.n}",
        duck=f"CAST(greatest(6, least(50, round_even({period}, 0))) AS INT) * {p.n}",
    )
    past = s.put(f"collect_list(c) {rows(50 * p.n + 1)}", duck=f"list(c) {rows(50 * p.n + 1)}")
    at = f"CASE WHEN {s.t} >= {50 * p.n} AND {period} > 0"
    return s.put(
        f"{at} THEN c > element_at({past}, -1 - {back_by}) END",
        duck=f"{at} THEN c > {past}[-1 - {back_by}] END",
    )


@rule("hook", "mean_reversion", trend_or(1), trend=TREND)
def _hook(s, p):
    """Lower low and a close in the top quarter."""
    return with_trend(s, p, f"l < {b(s, 'l')} AND (c - l) / nullif(h - l, 0) >= 0.75D")


@rule("outclose", "breakout", trend_or(1), trend=TREND)
def _outclose(s, p):
    """Outside bar closing in its top half."""
    return with_trend(s, p, f"h > {b(s, 'h')} AND l < {b(s, 'l')} AND (c - l) / nullif(h - l, 0) >= 0.5D")


@rule("sandwich", "mean_reversion", trend_or(5), trend=TREND)
def _sandwich(s, p):
    """Two matching black closes around a white candle."""
    return with_trend(
        s, p, f"{black(s, 2)} AND {black(s)} AND {white(s, 1)} AND abs(c - {b(s, 'c', 2)}) <= {equal_band(s)}"
    )


@rule("pinball", "mean_reversion", trend_or(4), trend=TREND)
def _pinball(s, p):
    """RSI(3) of daily change below 30, above trend."""
    return with_trend(s, p, f"{ind.rsi_wilder(s, ind.trailing_return(s, 'c', 1), 3)} < 30")


@rule("gri", "trend", trend_or(lambda p: p.n), n=(20, 14, 30), trend=TREND)
def _gri(s, p):
    """Range index falling, above trend."""
    span = s.put(f"{rolling_max(s, 'h', p.n)} - {rolling_min(s, 'l', p.n)}")
    x = s.put(f"CASE WHEN {span} > 0 THEN ln({span}) / ln({p.n}) END")
    return with_trend(s, p, f"{x} < {prev(s, x)}")


@rule("pctile", "breakout", first(lambda p: p.n), n=(20, 14, 30))
def _pctile(s, p):
    """Close above the 80th percentile of prior closes."""
    return f"c > {ind.prior_percentile(s, 'c', p.n, 80)}"


def _quiet_rule(key, family, at, make, n):
    @rule(key, family, trend_or(lambda p: p.n + at), n=n, trend=TREND)
    def fn(s, p):
        """Estimate below its own 100-day median, above trend."""
        return quiet(s, make(s, p.n), p)

    return fn


_quiet_rule("park", "trend", 98, ind.parkinson, (20, 15, 30))


@rule("skew", "mean_reversion", trend_or(lambda p: p.n), n=(20, 15, 30), trend=TREND)
def _skew_rule(s, p):
    """Negative return skew above trend."""
    return with_trend(s, p, f"{ind.realized_skewness(s, p.n)} < 0")


_quiet_rule("kurt", "trend", 99, ind.realized_excess_kurtosis, (20, 15, 30))


@rule("ac1", "momentum", first(lambda p: p.n), n=(20, 15, 30))
def _ac1(s, p):
    """Positive lag-1 autocorrelation."""
    return f"{ind.lag1_autocorr(s, p.n)} > 0"


_quiet_rule("maxf", "mean_reversion", 100, ind.prior_max_return, (21, 14, 30))
_quiet_rule("ddev", "trend", 99, ind.downside_deviation, (20, 15, 30))


@rule("fdim", "trend", trend_or(lambda p: p.n - 1), n=(16, 12, 20), trend=TREND)
def _fdim(s, p):
    """Low fractal dimension above trend."""
    return with_trend(s, p, f"{ind.fractal_dimension(s, p.n)} < 1.4D")


@rule("ckstop", "trend", first(lambda p: p.n + 8), n=(10, 7, 14))
def _ckstop(s, p):
    """Close above the Chande-Kroll stop."""
    return f"c > {ind.chande_kroll_stop(s, p.n)}"


def _whole_weeks(s):
    """(is the Sunday of a whole week, its high, its low)."""
    at, week = week_ends(s)
    whole = s.put(f"coalesce({at} AND lag({week}, 6) OVER ({BY_DAY}) = {week}, false)")
    return whole, s.put(f"max(h) {rows(7)}"), s.put(f"min(l) {rows(7)}")


def _weeks_seen(s):
    return s.put(f"count(CASE WHEN {_whole_weeks(s)[0]} THEN 1 END) {so_far()}")


@rule("wkswing", "trend", lambda s, p: f"{_weeks_seen(s)} >= {p.span + 1}", span=(1, 2, 3))
def _wkswing(s, p):
    """Whole week with a higher high and low than an earlier one, held a week."""
    whole, hi, lo = _whole_weeks(s)
    w = over_ends(whole)
    return ind.hold_between(s, whole, s.put(f"{hi} > lag({hi}, {p.span}) {w} AND {lo} > lag({lo}, {p.span}) {w}"))


@rule("inweek", "breakout", lambda s, p: f"{_weeks_seen(s)} >= 2 AND {s.t} >= {p.trend - 1}", trend=TREND)
def _inweek(s, p):
    """First break of an inside week, upper side, above trend."""
    whole, hi, lo = _whole_weeks(s)
    w = over_ends(whole)
    inside = s.put(f"coalesce({whole} AND {hi} < lag({hi}) {w} AND {lo} > lag({lo}) {w}, false)")
    return first_break(s, inside, hi, lo, above_trend(s, p.trend))


@rule("wkhigh", "breakout", lambda s, p: f"{_weeks_seen(s)} >= 1 AND {s.t} >= {p.trend - 1}", trend=TREND)
def _wkhigh(s, p):
    """Close above the last whole week's high and trend."""
    whole, hi, _ = _whole_weeks(s)
    return with_trend(s, p, f"c > {kept(s, s.put(f'CASE WHEN {whole} THEN {hi} END'))}")


@rule("runs", "momentum", first(lambda p: p.n), n=(20, 15, 30))
def _runs(s, p):
    """Few runs in a rising window."""
    return f"{ind.run_count(s, p.n)} < 10 AND c > {b(s, 'c', p.n)}"


def _lagged_month_return(s, back_by):
    at, month = month_ends(s)
    w = over_ends(at)
    ret = s.put(f"CASE WHEN {at} AND {month} - lag({month}) {w} = 1 THEN c / lag(c) {w} - 1 END")
    return s.put(
        f"max({ret}) OVER (PARTITION BY symbol ORDER BY {month} RANGE BETWEEN {back_by} PRECEDING AND {back_by} PRECEDING)"
    )


def _smonth_warm(s, p):
    x = _lagged_month_return(s, p.lag)
    start = s.put(f"min(CASE WHEN {x} IS NOT NULL THEN {s.t} END) OVER (PARTITION BY symbol)")
    hole = s.put(f"max(CASE WHEN {x} IS NULL AND {s.t} > {start} THEN 1 ELSE 0 END) OVER (PARTITION BY symbol)")
    return f"{s.t} >= {start} AND {hole} = 0"


@rule("smonth", "seasonality", _smonth_warm, lag=(12, 11, 13))
def _smonth(s, p):
    """Month whose counterpart some months ago rose."""
    return f"{_lagged_month_return(s, p.lag)} > 0"


@rule("clv", "momentum", first(lambda p: p.n - 1), n=(10, 8, 14))
def _clv(s, p):
    """Mean close location above zero."""
    return f"{ind.close_location(s, p.n)} > 0"


@rule("dmid", "breakout", first(lambda p: p.n), n=(20, 14, 30))
def _dmid(s, p):
    """Close above the middle of the prior range."""
    return f"c > ({prior_max(s, 'h', p.n)} + {prior_min(s, 'l', p.n)}) / 2"


@rule("kick", "trend", trend_or(11), trend=TREND)
def _kick(s, p):
    """Long black body, then a long white one, both without a shadow on the open side."""
    floor, cap = _long_body(s)
    o1, h1, l1, c1 = (b(s, x) for x in PRICES)
    dark = f"{o1} - {c1} > {prev(s, floor)} AND {h1} - greatest({o1}, {c1}) < {prev(s, cap)} AND least({o1}, {c1}) - {l1} <= {o1} - {c1}"
    light = f"c - o > {floor} AND least(o, c) - l < {cap} AND h - greatest(o, c) <= c - o"
    return with_trend(s, p, f"{dark} AND {light}")


@rule("lose5", "mean_reversion", trend_or(6), trend=TREND)
def _lose5(s, p):
    """Higher close after five lower ones."""
    fell = " AND ".join(f"{b(s, 'c', k)} < {b(s, 'c', k + 1)}" for k in range(1, 6))
    return with_trend(s, p, f"{fell} AND c > {b(s, 'c')}")


@rule("qdon", "breakout", first(lambda p: p.n + 99), n=(14, 10, 20))
def _qdon(s, p):
    """Break of the 20-day high with a quiet ATR."""
    atr = atr_wilder(s, p.n)
    return f"{atr} < {rolling_median(s, atr, 100)} AND c > {prior_max(s, 'h', 20)}"


@rule("lows3", "trend", trend_or(2), trend=TREND)
def _lows3(s, p):
    """Third higher low."""
    return with_trend(s, p, f"l > {b(s, 'l')} AND {b(s, 'l')} > {b(s, 'l', 2)}")


@rule("bbw", "trend", first(lambda p: max(p.n + 9, 199)), n=(20, 15, 30))
def _bbw(s, p):
    """Band width expanding over ten days, above the 200-day average."""
    mid, low, high = bollinger(s, "c", p.n, 2.0)
    x = s.put(f"CASE WHEN {mid} > 0 THEN ({high} - {low}) / {mid} END")
    return f"{x} > {prev(s, x, 10)} AND {above_trend(s, 200)}"


_quiet_rule("hampel", "trend", 99, ind.hampel_mad, (20, 15, 30))
_quiet_rule("svar", "trend", 99, ind.semivariance_share, (20, 15, 30))


@rule("hurst", "trend", trend_or(lambda p: p.n), n=(64, 48, 80), trend=TREND)
def _hurst(s, p):
    """Hurst exponent above one half, above trend."""
    return with_trend(s, p, f"{ind.hurst_rs(s, p.n)} > 0.5D")


@rule("volr", "trend", trend_or(lambda p: max(p.n, 100)), n=(10, 7, 14), trend=TREND)
def _volr(s, p):
    """Short volatility below the 100-day one, above trend."""
    return with_trend(s, p, f"{ind.volatility_ratio(s, p.n, 100)} < 1")


@rule("starc", "breakout", first(lambda p: p.n), n=(15, 10, 20))
def _starc(s, p):
    """Close above the average plus one ATR."""
    return f"c > {ind.starc_upper(s, p.n)}"


@rule("pctb", "trend", first(lambda p: p.n - 1), n=(20, 15, 30))
def _pctb(s, p):
    """Band position above 0.8."""
    return f"{ind.bollinger_percent_b(s, p.n)} > 0.8D"


_quiet_rule("cspread", "trend", 99, ind.corwin_schultz, (20, 15, 30))
_quiet_rule("roll", "trend", 99, ind.roll_spread, (20, 15, 30))


@rule("pacf", "momentum", first(lambda p: p.n), n=(30, 20, 40))
def _pacf(s, p):
    """Positive lag-2 partial autocorrelation."""
    return f"{ind.partial_autocorr_lag2(s, p.n)} > 0"


@rule("turns", "momentum", first(lambda p: p.n), n=(20, 15, 30))
def _turns(s, p):
    """Few turning points in a rising window."""
    return f"{ind.turning_point_count(s, p.n)} < 12 AND c > {b(s, 'c', p.n)}"


@rule("lev", "mean_reversion", trend_or(lambda p: p.n + 1), n=(20, 15, 30), trend=TREND)
def _lev(s, p):
    """Negative leverage correlation above trend."""
    return with_trend(s, p, f"{ind.leverage_corr(s, p.n)} < 0")


@rule("ablock", "trend", trend_or(2), trend=TREND)
def _ablock(s, p):
    """Three white rising closes with growing upper shadows."""
    shade = [f"({b(s, 'h', k)} - {b(s, 'c', k)})" for k in range(3)]
    return with_trend(
        s, p,
        f"{white(s)} AND {white(s, 1)} AND {white(s, 2)} AND c > {b(s, 'c')} AND {b(s, 'c')} > {b(s, 'c', 2)}"
        f" AND {shade[0]} > {shade[1]} AND {shade[1]} > {shade[2]}",
    )


@rule("uhalf", "momentum", first(lambda p: p.n - 1), n=(10, 8, 14))
def _uhalf(s, p):
    """Most closes in the upper half of their bar."""
    return f"{ind.upper_half_count(s, p.n)} >= 6"


@rule("trimb", "trend", trend_or(lambda p: p.n), n=(20, 15, 30), trend=TREND)
def _trimb(s, p):
    """Up-day range above down-day range, above trend."""
    return with_trend(s, p, f"{ind.true_range_imbalance(s, p.n)} > 0")


@rule("parkcc", "trend", trend_or(lambda p: p.n), n=(20, 15, 30), trend=TREND)
def _parkcc(s, p):
    """Range variance below close variance, above trend."""
    return with_trend(s, p, f"{ind.parkinson(s, p.n)} < {ind.close_to_close_variance(s, p.n)}")


@rule("wide", "breakout", trend_or(lambda p: p.n), n=(10, 7, 14), trend=TREND)
def _wide(s, p):
    """Wide white bar above trend."""
    x = span_col(s)
    return with_trend(s, p, f"{x} > {prior_mean(s, x, p.n)} AND {white(s)}")


@rule("highs3", "trend", trend_or(2), trend=TREND)
def _highs3(s, p):
    """Third higher high."""
    return with_trend(s, p, f"h > {b(s, 'h')} AND {b(s, 'h')} > {b(s, 'h', 2)}")


@rule("cchan", "breakout", first(lambda p: p.n), n=(20, 14, 30))
def _cchan(s, p):
    """Close above the prior closing high."""
    return f"c > {prior_max(s, 'c', p.n)}"


@rule("ocskew", "mean_reversion", trend_or(lambda p: p.n - 1), n=(20, 15, 30), trend=TREND)
def _ocskew(s, p):
    """Negative open-to-close skew above trend."""
    return with_trend(s, p, f"{ind.open_close_skewness(s, p.n)} < 0")


_quiet_rule("mdd", "trend", 98, ind.window_max_drawdown, (20, 15, 30))
