"""Expression atoms and money flow over fifteen-minute and hourly bars."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions import atoms as A
from barloom.functions.sheet import Sheet
from barloom.operators import bars as B
from barloom.sources import tables
from oracle import sheet_sql
from queries.registry import bars_cte, query


def day_bars(spark, sf, tf):
    return B.bars_from_ticks(tables.ticks(spark, sf), tf).withColumnRenamed("ts", "day")


def base_sql(seconds: int) -> str:
    return f"SELECT symbol, ts AS day, o, h, l, c, v FROM (WITH {bars_cte(seconds, 'raw')} SELECT * FROM raw)"


ATOM_GROUPS = {
    "averages": ["sma_stack_7_25_50", "ema_stack_5_10_20", "sma_abv_50", "ema_abv_20", "rsi_momentum", "robust_open", "sma40_rsi55", "sma20_mom12_2"],
    "momentum": ["rsi_14_>50_<80", "rsi_14_<40", "rsi_20_55", "mom_12b_gt2pc", "dip_6b_lt3pc", "vol_lowsm_10_30", "bb_lower_20_2", "bb_upper_20_2", "nonsense_7"],
    "structure": ["don_hi_20", "don_lo_20", "near_swing_hi_5", "near_swing_lo_5", "dbl_bot_4", "dbl_top_4", "near_swing_lo_30", "dbl_bot_20"],
    "wavetrend": ["wt_cross_up_os", "wt_below_os", "wt_cross_down_ob"],
    "htf": ["h1_ema_abv_10", "h1_sma_abv_10", "h4_ema_abv_5", "h4_sma_abv_5"],
    "combined": ["sma_abv_20&rsi_14_>50", "mom_6b_gt1pc|dip_6b_lt1pc", "(sma_abv_20|ema_abv_50)&mom_3b_gt1pc", "don_hi_10&nonsense_7"],
}


def _register(group, names):
    s = Sheet()
    made = [s.put(A.predicate(s, n)) for n in names]
    head, last = sheet_sql.with_clause(s, base_sql(900))
    rows = " UNION ALL ".join(f"SELECT symbol, {s.t} AS t, '{n}' AS config, {x} AS signal FROM {last}" for n, x in zip(names, made))

    @query(
        f"atoms_{group}",
        f"""{head} SELECT symbol, config, count(*) AS bars, count(*) FILTER (signal) AS on_bars,
  CAST(coalesce(sum(CAST(t AS BIGINT)) FILTER (signal), 0) AS BIGINT) AS on_index_sum FROM ({rows}) GROUP BY 1, 2""",
    )
    def run(spark, sf):
        long = A.long_flags(day_bars(spark, sf, "15m"), names)
        return long.groupBy("symbol", "config").agg(
            F.count(F.lit(1)).alias("bars"), F.count_if("signal").alias("on_bars"),
            F.coalesce(F.sum(F.when(F.col("signal"), F.col("t").cast("long"))), F.lit(0)).alias("on_index_sum"),
        )


for _g, _n in ATOM_GROUPS.items():
    _register(_g, _n)


def _values(s):
    return {
        "mfi": A.money_flow_index(s), "cmf": A.chaikin_money_flow(s), "vwap": A.rolling_vwap(s, 50),
        "rsi": A.plain_rsi(s, 14), "older_rsi": A.older_rsi(s, 14), "first_ema": A.first_value_ema(s, 20),
        "vol_ratio": A.vol_ratio(s, 10, 30), "atr": A.mean_atr(s), "near_band": A.near_band(s),
        "wt1": A.wavetrend(s)[0], "wt2": A.wavetrend(s)[1], "macd": A.macd_sma_signal(s)[0], "macd_sig": A.macd_sma_signal(s)[1],
    }


def _value_sql():
    s = Sheet()
    v = _values(s)
    head, last = sheet_sql.with_clause(s, base_sql(900))
    return f"{head} SELECT symbol, day, " + ", ".join(f"round(CAST({x} AS DOUBLE) + 1.3e-7, 5) AS {k}" for k, x in v.items()) + f" FROM {last}"


@query("atoms_values", _value_sql())
def _run_values(spark, sf):
    s = Sheet()
    v = _values(s)
    return s.run(day_bars(spark, sf, "15m")).selectExpr("symbol", "day", *[f"round(CAST({x} AS DOUBLE) + 1.3e-7, 5) AS {k}" for k, x in v.items()])


_NAMED = list(A.NAMED)


def _named_sql():
    s = Sheet()
    made = [s.put(A.predicate(s, f)) for f in A.NAMED.values()]
    head, last = sheet_sql.with_clause(s, base_sql(900))
    rows = " UNION ALL ".join(f"SELECT symbol, '{n}' AS config, {x} AS signal FROM {last}" for n, x in zip(_NAMED, made))
    return f"{head} SELECT symbol, config, count(*) FILTER (signal) AS on_bars FROM ({rows}) GROUP BY 1, 2"


@query("atoms_named_predicates", _named_sql())
def _named(spark, sf):
    wide = A.flags(day_bars(spark, sf, "15m"), list(A.NAMED.values()))
    cells = ", ".join(f"'{n}', f{k}" for k, n in enumerate(_NAMED))
    long = wide.selectExpr("symbol", f"stack({len(_NAMED)}, {cells}) AS (config, signal)")
    return long.groupBy("symbol", "config").agg(F.count_if("signal").alias("on_bars"))


def _latest_sql():
    s = Sheet()
    on = s.put(A.predicate(s, "sma_abv_20&rsi_14_>50"))
    head, last = sheet_sql.with_clause(s, base_sql(3600))
    return f"""{head} SELECT symbol, day, c, CASE WHEN {on} THEN 'long' ELSE 'flat' END AS direction FROM {last}
QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY day DESC) = 1"""


@query("atoms_latest_signal", _latest_sql())
def _latest(spark, sf):
    return A.latest_signal(day_bars(spark, sf, "1h"), "sma_abv_20&rsi_14_>50").select("symbol", "day", "c", "direction")
