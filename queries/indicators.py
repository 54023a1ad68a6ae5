"""Indicator groups over the long daily series."""

from __future__ import annotations

from barloom.functions import indicators as I
from barloom.functions.sheet import Sheet
from barloom.sources import tables
from oracle import sheet_sql
from queries.registry import query

# group -> {column: builder}; a tuple builder result spreads over several columns.
GROUPS = {
    "averages": {
        "sma": lambda s: I.sma(s, "c", 20), "sma_long": lambda s: I.sma(s, "c", 200),
        "sma_skip_leading": lambda s: I.sma_skip_leading(s, I.trailing_return(s, "c", 5), 10),
        "wma": lambda s: I.wma(s, "c", 10), "wma_skip": lambda s: I.wma_skip_leading(s, I.trailing_return(s, "c", 5), 8),
        "hull_ma": lambda s: I.hull_ma(s, "c", 16), "alma": lambda s: I.alma(s, "c", 9, 0.85, 6.0),
        "center_of_gravity": lambda s: I.center_of_gravity(s, "c", 10), "detrended_price": lambda s: I.detrended_price(s, 20),
    },
    "extremes": {
        "prior_max": lambda s: I.prior_max(s, "h", 20), "prior_min": lambda s: I.prior_min(s, "l", 20),
        "rolling_max": lambda s: I.rolling_max(s, "c", 50), "rolling_min": lambda s: I.rolling_min(s, "c", 50),
        "rolling_max_skip": lambda s: I.rolling_max_skip_leading(s, I.trailing_return(s, "c", 3), 14),
        "rolling_min_skip": lambda s: I.rolling_min_skip_leading(s, I.trailing_return(s, "c", 3), 14),
        "prior_percentile": lambda s: I.prior_percentile(s, "c", 20, 80),
        "rolling_median": lambda s: I.rolling_median_skip_leading(s, I.trailing_return(s, "c", 1), 100),
    },
    "sums_and_shift": {
        "trailing_return": lambda s: I.trailing_return(s, "c", 30), "rolling_std": lambda s: I.rolling_std(s, "c", 20),
        "rolling_sum_from": lambda s: I.rolling_sum_from(s, "c", 10, 12),
        "sum_skip_leading": lambda s: I.sum_skip_leading(s, I.trailing_return(s, "c", 2), 10),
        "shift_previous": lambda s: I.shift_previous(s, "c", 7),
        "finite_tail": lambda s: I.finite_tail(s, I.sma(s, "c", 30)), "true_range": lambda s: I.true_range(s),
    },
    "calendar": {
        "month_number": lambda s: I.month_number(s), "is_month_end": lambda s: I.is_month_end(s),
        "is_week_end": lambda s: I.is_week_end(s), "week_number": lambda s: I.week_number(s),
        "weekday_utc": lambda s: I.weekday_utc(s), "month_of_year": lambda s: I.month_of_year(s),
        "day_of_month": lambda s: I.day_of_month(s), "days_in_month": lambda s: I.days_in_month(s),
        "third_friday": lambda s: I.third_friday_dom(s),
        "hold_between": lambda s: I.hold_between(s, I.is_month_end(s), "c > o"),
    },
    "bands": {
        "bollinger": lambda s: I.bollinger(s, "c", 20, 2.0), "percent_b": lambda s: I.bollinger_percent_b(s, 20),
        "keltner": lambda s: I.keltner(s, 20, 10, 2.0), "starc_upper": lambda s: I.starc_upper(s, 15),
        "chande_kroll": lambda s: I.chande_kroll_stop(s, 10), "kase_devstop": lambda s: I.kase_devstop(s, 20),
        "safezone": lambda s: I.safezone_stop(s, 20),
    },
    "exponential": {
        "ema": lambda s: I.ema(s, "c", 20), "smma": lambda s: I.smma(s, "c", 13), "dema": lambda s: I.dema(s, 20),
        "zero_lag_ema": lambda s: I.zero_lag_ema(s, 20), "trix": lambda s: I.trix(s, 15),
        "tillson_t3": lambda s: I.tillson_t3(s, 5, 0.7), "macd_histogram": lambda s: I.macd_histogram(s, 12, 26, 9),
        "mass_index": lambda s: I.mass_index(s, 9, 25), "tsi": lambda s: I.true_strength_index(s, 25, 13),
        "smi": lambda s: I.stochastic_momentum_index(s, 10, 3),
    },
    "wilder": {
        "rsi": lambda s: I.rsi_wilder(s, "c", 14), "wilder_smooth": lambda s: I.wilder_smooth(s, "c", 14),
        "atr": lambda s: I.atr_wilder(s, 14), "adx": lambda s: I.adx_wilder(s, 14),
        "relative_volatility": lambda s: I.relative_volatility(s, 14), "rmi": lambda s: I.relative_momentum_index(s, 5, 14),
        "stoch_rsi": lambda s: I.stoch_rsi(s, 14), "connors_rsi": lambda s: I.connors_rsi(s),
        "rwi": lambda s: I.random_walk_index(s, 8),
    },
    "adaptive": {
        "kama": lambda s: I.kaufman_ama(s, 10, 2, 30), "vidya": lambda s: I.vidya(s, 20), "frama": lambda s: I.frama(s, 16),
        "mcginley": lambda s: I.mcginley_dynamic(s, 20), "schaff": lambda s: I.schaff_trend(s, 10),
        "supertrend": lambda s: I.supertrend_long(s, 10, 3), "psar": lambda s: I.parabolic_sar(s, 0.02, 0.02, 0.2),
    },
    "filters": {
        "super_smoother": lambda s: I.super_smoother(s, 10), "cyber_cycle": lambda s: I.cyber_cycle(s, 0.07),
        "laguerre_rsi": lambda s: I.laguerre_rsi(s, 0.5), "laguerre_filter": lambda s: I.laguerre_filter(s, 0.5),
        "itrend": lambda s: I.instantaneous_trendline(s, 0.07), "roofing": lambda s: I.roofing_filter(s, 48),
        "band_pass": lambda s: I.band_pass(s, 30), "fisher": lambda s: I.fisher_transform(s, 10),
    },
    "oscillators": {
        "williams_r": lambda s: I.williams_r(s, 14), "ibs": lambda s: I.ibs(s), "cci": lambda s: I.cci(s, 20),
        "stochastic_k": lambda s: I.stochastic_k(s, 14), "ultimate": lambda s: I.ultimate_oscillator(s, 7, 14, 28),
        "cmo": lambda s: I.chande_momentum(s, 14), "qstick": lambda s: I.qstick(s, 8), "kst": lambda s: I.know_sure_thing(s),
        "awesome": lambda s: I.awesome_oscillator(s, 5, 34), "imi": lambda s: I.intraday_momentum(s, 14),
    },
    "directional": {
        "aroon": lambda s: I.aroon(s, 25), "vortex": lambda s: I.vortex(s, 14), "demarker": lambda s: I.demarker(s, 14),
        "swing_index": lambda s: I.swing_index(s), "rei": lambda s: I.range_expansion_index(s, 5),
        "relative_vigor": lambda s: I.relative_vigor(s, 10), "choppiness": lambda s: I.choppiness_index(s, 14),
        "vhf": lambda s: I.vertical_horizontal_filter(s, 28),
    },
    "bodies_and_counts": {
        "balance_of_power": lambda s: I.balance_of_power(s, 14), "close_location": lambda s: I.close_location(s, 10),
        "psychological": lambda s: I.psychological_line(s, 12), "close_streak": lambda s: I.close_streak(s),
        "percent_rank": lambda s: I.percent_rank_change(s, 100), "run_count": lambda s: I.run_count(s, 20),
        "turning_points": lambda s: I.turning_point_count(s, 20), "upper_half": lambda s: I.upper_half_count(s, 10),
        "tr_imbalance": lambda s: I.true_range_imbalance(s, 20), "trend_intensity": lambda s: I.trend_intensity(s, 20),
    },
    "regression": {
        "linreg_slope": lambda s: I.linreg_slope(s, "c", 20), "linreg_value": lambda s: I.linreg_value(s, "c", 20),
        "linreg_r2": lambda s: I.linreg_r2(s, "c", 20), "linreg_stderr": lambda s: I.linreg_stderr(s, "c", 20),
        "spearman": lambda s: I.spearman_rho(s, "c", 10), "theil_sen": lambda s: I.theil_sen_slope(s, "c", 10),
        "efficiency": lambda s: I.efficiency_ratio(s, 10), "signed_efficiency": lambda s: I.signed_efficiency(s, 10),
    },
    "variance": {
        "realized_vol": lambda s: I.realized_vol(s, 21), "volatility_ratio": lambda s: I.volatility_ratio(s, 10, 100),
        "variance_ratio": lambda s: I.variance_ratio(s, 16, 128), "garman_klass": lambda s: I.garman_klass(s, 14),
        "rogers_satchell": lambda s: I.rogers_satchell(s, 20), "yang_zhang": lambda s: I.yang_zhang(s, 20),
        "parkinson": lambda s: I.parkinson(s, 20), "close_variance": lambda s: I.close_to_close_variance(s, 20),
        "downside": lambda s: I.downside_deviation(s, 20), "corwin_schultz": lambda s: I.corwin_schultz(s, 20),
    },
    "shape": {
        "skewness": lambda s: I.realized_skewness(s, 20), "kurtosis": lambda s: I.realized_excess_kurtosis(s, 20),
        "oc_skewness": lambda s: I.open_close_skewness(s, 20), "autocorr": lambda s: I.lag1_autocorr(s, 20),
        "pacf2": lambda s: I.partial_autocorr_lag2(s, 30), "leverage": lambda s: I.leverage_corr(s, 20),
        "hampel": lambda s: I.hampel_mad(s, 20), "semivariance": lambda s: I.semivariance_share(s, 20),
        "roll_spread": lambda s: I.roll_spread(s, 20), "prior_max_return": lambda s: I.prior_max_return(s, 21),
    },
    "path": {
        "ulcer": lambda s: I.ulcer_index(s, 14), "drawdown": lambda s: I.window_max_drawdown(s, 20),
        "hurst": lambda s: I.hurst_rs(s, 64), "fractal_dimension": lambda s: I.fractal_dimension(s, 16),
        "cloud_top": lambda s: I.ichimoku_cloud_top(s, 9, 26, 52), "spans": lambda s: I.ichimoku_spans(s, 9, 26, 52),
    },
    "hilbert": {"mesa": lambda s: I.mesa_adaptive(s, 0.5, 0.05), "dominant_period": lambda s: I.dominant_period(s)},
}


def group_sheet(group: str):
    s, out = Sheet(), []
    for name, make in GROUPS[group].items():
        made = make(s)
        if isinstance(made, tuple):
            out += [(f"{name}_{k}", x) for k, x in enumerate(made)]
        else:
            out.append((name, made))
    return s, out


# Prices are cents over small integers, so many sit exactly on a rounding tie;
# the offset moves them off it in both engines.


def _sql(group: str) -> str | None:
    s, out = group_sheet(group)
    if not sheet_sql.expressible(s):
        return None
    head, last = sheet_sql.with_clause(s)
    cols = ", ".join(f"round(CAST({x} AS DOUBLE) + 1.3e-7, 5) AS {name}" for name, x in out)
    return f"{head}\nSELECT symbol, day, {cols} FROM {last}"


def _register(group: str):
    @query(f"indicators_{group}", _sql(group))
    def run(spark, sf):
        s, out = group_sheet(group)
        cols = [f"round(CAST({x} AS DOUBLE) + 1.3e-7, 5) AS {name}" for name, x in out]
        return s.run(tables.flag_days(spark, sf)).selectExpr("symbol", "day", *cols)


for _group in GROUPS:
    _register(_group)
