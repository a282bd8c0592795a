"""Shared SQL building blocks of the oracles.

The oracles state every operator a second time in plain SQL, from the raw
tables on.  ``compose`` prefixes a final SELECT with exactly the common table
expressions it mentions.
"""

from __future__ import annotations

import re

from .. import config as cfg

CTES: dict[str, str] = {}


def cte(name: str, sql: str, recursive: bool = False) -> None:
    CTES[name] = ("R:" if recursive else "") + sql.strip()


def _mentioned(sql: str) -> set[str]:
    return {t for t in re.findall(r"[A-Za-z_][A-Za-z_0-9]*", sql) if t in CTES}


def compose(sql: str) -> str:
    need: set[str] = set()
    stack = list(_mentioned(sql))
    while stack:
        name = stack.pop()
        if name not in need:
            need.add(name)
            stack += list(_mentioned(CTES[name]) - {name})
    parts = []
    for name, body in CTES.items():
        if name not in need:
            continue
        if body.startswith("R:"):
            parts.append(f"{name} AS ({body[2:]})")
        else:
            parts.append(f"{name} AS MATERIALIZED ({body})")
    head = "WITH RECURSIVE " + ",\n".join(parts) + "\n" if parts else ""
    return head + sql.strip()


# --- text helpers ----------------------------------------------------------
def quoted(names) -> str:
    return ", ".join(f"'{n}'" for n in names)


def r(expr: str, digits: int = 6, name: str | None = None) -> str:
    """Rounded double without negative zero."""
    name = name or expr
    return f"round(({expr})::DOUBLE, {digits}) + 0e0 AS \"{name}\""


def rs(names, digits: int | dict[str, int] = 6) -> str:
    def places(n):
        return digits if isinstance(digits, int) else digits.get(n, digits.get("", 6))

    return ", ".join(r(f'"{n}"', places(n), n) for n in names)


def over(part: str = "symbol", order: str = "date", frame: str = "") -> str:
    part = f"PARTITION BY {part} " if part else ""
    return f"OVER ({part}ORDER BY {order} {frame})"


def roll(fn: str, x: str, width: int, need: int | None = None,
         part: str = "symbol", gate: str | None = None) -> str:
    """Aggregate over the last ``width`` rows once ``need`` are non-null."""
    frame = f"ROWS BETWEEN {width - 1} PRECEDING AND CURRENT ROW"
    w = over(part, "date", frame)
    call = f"{fn.replace('$', x) if '$' in fn else f'{fn}({x})'} {w}"
    if fn.startswith("corr"):     # a constant side is undefined, not NaN
        call = f"CASE WHEN isnan({call}) THEN NULL ELSE {call} END"
    return (f"CASE WHEN count({gate or x}) {w} >= {need or width}"
            f" THEN {call} END")


def pct(x: str, n: int, shift: int = 0, part: str = "") -> str:
    """Relative change of the forward-filled, then delayed, series."""
    def at(k):
        end = "CURRENT ROW" if k == 0 else f"{k} PRECEDING"
        return (f"last_value({x} IGNORE NULLS) "
                + over(part, "date", f"ROWS BETWEEN UNBOUNDED PRECEDING AND {end}"))
    return f"({at(shift)}) / nullif({at(shift + n)}, 0) - 1"


def dlag(x: str, n: int, shift: int, part: str = "") -> str:
    w = over(part)
    newer = f"lag({x}, {shift}) {w}" if shift else x
    return f"({newer}) - (lag({x}, {shift + n}) {w})"


def last_in(x: str, rows: int, part: str = "symbol") -> str:
    return (f"last_value({x} IGNORE NULLS) "
            + over(part, "date", f"ROWS BETWEEN {rows} PRECEDING AND CURRENT ROW"))


# --- sources -----------------------------------------------------------------
_FLAG = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in cfg.FLAG_TO_TICKER.items())
cte("trades", f"""
SELECT CASE l_returnflag {_FLAG} END AS etf,
       ([{quoted(cfg.PROXY_SYMBOLS)}])[(l_linenumber * 2 + 6
          + CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END)
          % {len(cfg.PROXY_SYMBOLS)} + 1] AS proxy,
       CAST(l_partkey AS VARCHAR) AS part,
       CAST(l_shipdate AS DATE) AS date, l_orderkey, l_linenumber,
       l_extendedprice, l_quantity, l_linestatus, l_tax, l_discount
FROM lineitem WHERE isodow(CAST(l_shipdate AS DATE)) < 6
""")


def _ohlcv(symbol: str, scale: str) -> str:
    key = "l_orderkey, l_linenumber, l_extendedprice"
    return f"""
SELECT symbol, date, open, high, low, close, close AS adj_close, volume FROM (
SELECT {symbol} AS symbol, date,
       first(l_extendedprice / {scale} ORDER BY {key}) AS open,
       max(l_extendedprice / {scale}) AS high,
       min(l_extendedprice / {scale}) AS low,
       last(l_extendedprice / {scale} ORDER BY {key}) AS close,
       CAST(sum(l_quantity) AS BIGINT) AS volume
FROM trades GROUP BY ALL)"""


cte("cal", "SELECT DISTINCT date FROM trades")
cte("bars", _ohlcv("etf", "100e0"))
cte("prox", _ohlcv("proxy", "2500e0"))
cte("pbars", _ohlcv("part", "100e0"))
cte("dbars", "SELECT * FROM bars UNION ALL SELECT * FROM prox")
cte("mraw", f"""
SELECT ([{quoted(cfg.MACRO_KEYS)}])[(CAST(o_orderpriority[1] AS INT) * 3
          + CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END)
          % {len(cfg.MACRO_KEYS)} + 1] AS series_key,
       CAST(o_orderdate AS DATE) AS date,
       CAST(sum(CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT)) AS DOUBLE)
         / count(*) / 10000000e0 AS value
FROM orders GROUP BY 1, 2
""")
cte("assets", "SELECT * FROM (VALUES " + ", ".join(
    [f"('{s}', '{s}', 'ETF', '{cfg.ETF_DESCRIPTIONS[s]}')" for s in cfg.ETF_SYMBOLS]
    + [f"('{s}', '{n}', '{t}', NULL)" for s, (n, t) in cfg.PROXIES.items()])
    + ") AS t(symbol, name, asset_type, description)")
cte("mcat", "SELECT * FROM (VALUES " + ", ".join(
    f"('{k}', '{n}', '{u}', '{d}')" for k, (n, f, u, d) in cfg.MACRO_SERIES.items())
    + ") AS t(series_key, name, units, description)")
cte("evmeta", "SELECT * FROM (VALUES " + ", ".join(
    f"('{a}', '{b}', '{c}', '{d}', {e})" for a, b, c, d, e in cfg.EVENT_TYPE_METADATA)
    + ") AS t(event_type, name, description, typical_impact, frequency_per_year)")

# --- technical -----------------------------------------------------------------
W = over()
cte("t1", f"""
SELECT *, ln(close) AS lc, lag(close) {W} AS pc, row_number() {W} AS rn,
  lag(ln(close), 1) {W} - lag(ln(close), 2) {W} AS log_ret_1d,
  lag(ln(close), 1) {W} - lag(ln(close), 6) {W} AS log_ret_5d,
  lag(ln(close), 1) {W} - lag(ln(close), 21) {W} AS log_ret_20d,
  lag(ln(close), 2) {W} - lag(ln(close), 3) {W} AS prev_ret,
  high - lag(high) {W} AS hd, lag(low) {W} - low AS ld,
  close - lag(close) {W} AS delta,
  ln(open / lag(close) {W}) AS overnight_return,
  ln(close / open) AS intraday_return,
  volume::DOUBLE AS v
FROM bars""")
cte("t2", f"""
SELECT *,
  {roll('avg', 'close', 20)} AS sma_20, {roll('avg', 'close', 50)} AS sma_50,
  {roll('avg', 'close', 200)} AS sma_200,
  {roll('max', 'close', 60)} AS rolling_max_60,
  (high - low) / nullif(close, 0) AS high_low_pct,
  (close - open) / nullif(open, 0) AS close_open_pct,
  (v - {roll('avg', 'v', 20)}) / ({roll('stddev_samp', 'v', 20)} + 1e-9) AS volume_z,
  {pct('v', 1, 0, 'symbol')} AS volume_chg_pct,
  CAST(isodow(date) - 1 AS INTEGER) AS dow,
  CAST(coalesce(date - lag(date) {W}, 1) AS INTEGER) AS days_since_prev,
  CASE WHEN delta IS NOT NULL THEN greatest(delta, 0) END AS gain,
  CASE WHEN delta IS NOT NULL THEN greatest(-delta, 0) END AS loss,
  CASE WHEN pc IS NULL THEN high - low
       ELSE greatest(high - low, abs(high - pc), abs(low - pc)) END AS tr,
  CASE WHEN hd > ld AND hd > 0 THEN hd ELSE 0e0 END AS dm_up,
  CASE WHEN ld > hd AND ld > 0 THEN ld ELSE 0e0 END AS dm_dn,
  {roll('stddev_samp', 'log_ret_1d', 5)} AS vol_5,
  {roll('stddev_samp', 'log_ret_1d', 20)} AS vol_20,
  {roll('stddev_samp', 'log_ret_1d', 60)} AS vol_60,
  {roll('avg', 'overnight_return', 20)} AS overnight_mean_20,
  {roll('stddev_samp', 'overnight_return', 20)} AS overnight_std_20,
  {roll('avg', 'intraday_return', 20)} AS intraday_mean_20,
  {roll('stddev_samp', 'intraday_return', 20)} AS intraday_std_20,
  greatest(-1e0, least(1e0, overnight_return
     / (abs(overnight_return) + abs(intraday_return) + 1e-6))) AS share_all,
  CASE WHEN count(log_ret_1d) {over(frame='ROWS BETWEEN 19 PRECEDING AND CURRENT ROW')} = 20
       THEN {roll('corr($, prev_ret)', 'log_ret_1d', 19)} END AS return_autocorr_20,
  {roll('regr_r2($, rn)', 'close', 20)} AS fit,
  {roll('var_pop', 'close', 20)} * 20 AS spread
FROM t1""")
cte("t3", f"""
SELECT *, close / nullif(rolling_max_60, 0) - 1 AS dd_60,
  CASE WHEN sma_20 > sma_50 THEN 1 ELSE 0 END AS sma20_gt_sma50,
  100 - 100 / (1 + ({roll('avg', 'gain', 14)}) / (({roll('avg', 'loss', 14)}) + 1e-12)) AS rsi_14,
  {roll('avg', 'tr', 14)} AS atr_14,
  CASE WHEN overnight_return IS NOT NULL AND intraday_return IS NOT NULL
       THEN share_all END AS overnight_share,
  CASE WHEN spread < 1e-9 THEN 0e0 WHEN spread IS NOT NULL
       THEN greatest(0e0, least(1e0, fit)) END AS price_rsq_20
FROM t2""")


def _ema(prev: str, x: str, span: int) -> str:
    return f"{x} * (2e0 / {span + 1}) + {prev} * (1 - 2e0 / {span + 1})"


def _dx(tr: str, up: str, dn: str) -> str:
    p, m = f"(100 * {up} / ({tr} + 1e-9))", f"(100 * {dn} / ({tr} + 1e-9))"
    return f"100 * abs({p} - {m}) / ({p} + {m} + 1e-9)"


# The defining recursion of every smoothed indicator, row by row.
cte("emas", f"""
SELECT symbol, date, rn, close AS e20, close AS e50, close AS e12, close AS e26,
  0e0 AS sig, tr AS etr, dm_up AS eup, dm_dn AS edn, {_dx('tr', 'dm_up', 'dm_dn')} AS adx
FROM t3 WHERE rn = 1
UNION ALL
SELECT symbol, date, rn, e20, e50, e12, e26,
  {_ema('sig', '(e12 - e26)', 9)}, etr, eup, edn,
  {_ema('adx', '(' + _dx('etr', 'eup', 'edn') + ')', 14)}
FROM (SELECT b.symbol, b.date, b.rn,
        {_ema('p.e20', 'b.close', 20)} AS e20, {_ema('p.e50', 'b.close', 50)} AS e50,
        {_ema('p.e12', 'b.close', 12)} AS e12, {_ema('p.e26', 'b.close', 26)} AS e26,
        p.sig, p.adx, {_ema('p.etr', 'b.tr', 14)} AS etr,
        {_ema('p.eup', 'b.dm_up', 14)} AS eup, {_ema('p.edn', 'b.dm_dn', 14)} AS edn
      FROM emas p JOIN t3 b ON b.symbol = p.symbol AND b.rn = p.rn + 1)
""", recursive=True)
cte("tech", """
SELECT t3.*, e.e20 AS ema_20, e.e50 AS ema_50, e.e12 - e.e26 AS macd_line,
  e.sig AS macd_signal, e.e12 - e.e26 - e.sig AS macd_hist, e.adx AS adx_14
FROM t3 JOIN emas e USING (symbol, date)""")

# --- macro ---------------------------------------------------------------------
cte("malign", """
SELECT m.series_key, m.date, min(c.date) AS trading_date, any_value(m.value) AS value
FROM mraw m JOIN cal c ON c.date BETWEEN m.date AND m.date + 7
GROUP BY m.series_key, m.date""")
cte("mdedupe", """
SELECT series_key, trading_date AS date, value FROM malign
QUALIFY row_number() OVER (PARTITION BY series_key, trading_date ORDER BY date) = 1""")
cte("mdaily", f"""
SELECT g.series_key, g.date, o.value, CAST(g.date - o.date AS INTEGER) AS days_since_update
FROM (SELECT s.series_key, c.date FROM cal c JOIN
        (SELECT series_key, min(date) AS lo, max(date) AS hi FROM mdedupe GROUP BY 1) s
        ON c.date BETWEEN s.lo AND s.hi) g
ASOF JOIN (SELECT * FROM mdedupe WHERE value IS NOT NULL) o
  ON g.series_key = o.series_key AND g.date >= o.date
WHERE g.date - o.date <= {cfg.MAX_GAP_DAYS}""")
cte("mwide", "SELECT date, " + ", ".join(
    f"max(value) FILTER (WHERE series_key = '{k}') AS {k}_raw" for k in cfg.MACRO_KEYS)
    + " FROM mdaily GROUP BY date")
cte("mfeat", f"""
SELECT *, DGS10_raw AS dgs10, DGS2_raw AS dgs2, DGS10_raw - DGS2_raw AS yield_curve_slope,
  {dlag('DGS10_raw', 1, 1)} AS dgs10_change_1d, {dlag('DGS10_raw', 5, 1)} AS dgs10_change_5d,
  {dlag('DGS2_raw', 1, 1)} AS dgs2_change_1d, {dlag('DGS2_raw', 5, 1)} AS dgs2_change_5d,
  BAMLH0A0HYM2_raw AS hy_oas_level, {dlag('BAMLH0A0HYM2_raw', 1, 1)} AS hy_oas_change_1d,
  {dlag('BAMLH0A0HYM2_raw', 5, 1)} AS hy_oas_change_5d,
  {pct('WALCL_raw', 5, 1)} AS fed_balance_sheet_change_pct,
  CASE WHEN {dlag('WALCL_raw', 20, 1)} > 0 THEN 1 ELSE 0 END AS liquidity_expanding,
  RRPONTSYD_raw AS rrp_level, {pct('RRPONTSYD_raw', 5, 1)} AS rrp_change_pct_5d
FROM mwide""")

# --- cross-asset -----------------------------------------------------------------
cte("xwide", "SELECT date, " + ", ".join(
    f"max(close) FILTER (WHERE symbol = '{s}') AS \"{s}_close\""
    for s in cfg.PROXY_SYMBOLS + ["SPY"])
    + f" FROM dbars WHERE symbol IN ({quoted(cfg.PROXY_SYMBOLS + ['SPY'])}) GROUP BY date")
_FAM = {"dxy": ("UUP", 1), "gold": ("GLD", 1), "oil": ("USO", 1),
        "hyg": ("HYG", 1), "lqd": ("LQD", 0), "tlt": ("TLT", 0)}
cte("x1", "SELECT *, \"^VIX_close\" AS vix_level, "
    + f"{dlag(chr(34) + '^VIX_close' + chr(34), 1, 1)} AS vix_change_1d, "
    + f"{dlag(chr(34) + '^VIX_close' + chr(34), 5, 1)} AS vix_change_5d, "
    + f"{pct(chr(34) + '^VIX_close' + chr(34), 1, 1)} AS vix_pct_change_1d, "
    + '"^VIX_close" - "^VIX9D_close" AS vix_term_structure, '
    + ", ".join(f"{pct(f'{sym}_close', n, sh)} AS {name}_ret_{n}d"
                for name, (sym, sh) in _FAM.items() for n in (1, 5, 20))
    + f", {pct('SPY_close', 5)} AS spy5, {pct('SPY_close', 1)} AS spy1, "
    + f"{pct('HYG_close', 1)} AS hyg1, RSP_close / nullif(SPY_close, 0) AS rsp_spy_ratio"
    + " FROM xwide")
cte("xfeat", f"""
SELECT *, hyg_ret_5d - spy5 AS hyg_vs_spy_5d,
  {roll('corr($, spy1)', 'hyg1', 20, part='', gate='CASE WHEN hyg1 IS NOT NULL AND spy1 IS NOT NULL THEN 1 END')} AS hyg_spy_corr_20d,
  {roll('avg', 'rsp_spy_ratio', 20, part='')} AS rsp_spy_ratio_ma20,
  (rsp_spy_ratio - {roll('avg', 'rsp_spy_ratio', 20, part='')})
    / nullif({roll('stddev_samp', 'rsp_spy_ratio', 20, part='')}, 0) AS rsp_spy_ratio_z
FROM x1""")
cte("rwide", """
SELECT date, max(close) FILTER (WHERE symbol = 'SPY') AS spy,
  max(close) FILTER (WHERE symbol = 'QQQ') AS qqq,
  max(close) FILTER (WHERE symbol = 'IWM') AS iwm FROM bars GROUP BY date""")


def _ratio(c: str) -> str:
    n = f"{c}_spy_ratio"
    return (f"{c} / nullif(spy, 0) AS {n}", roll("avg", n, 20, part=""),
            f"({n} - {roll('avg', n, 20, part='')}) / nullif("
            f"{roll('stddev_samp', n, 20, part='')}, 0)")


_q, _i = _ratio("qqq"), _ratio("iwm")
cte("rsq", f"""
SELECT date, qqq_spy_ratio, {_q[1]} AS qqq_spy_ratio_ma20, {_q[2]} AS qqq_spy_ratio_z
FROM (SELECT date, {_q[0]} FROM rwide WHERE spy IS NOT NULL OR qqq IS NOT NULL)""")
cte("rsi", f"""
SELECT date, iwm_spy_ratio, {_i[1]} AS iwm_spy_ratio_ma20, {_i[2]} AS iwm_spy_ratio_z
FROM (SELECT date, {_i[0]} FROM rwide)""")
cte("rfeat", """
SELECT date, qqq_spy_ratio, qqq_spy_ratio_ma20, qqq_spy_ratio_z,
  iwm_spy_ratio, iwm_spy_ratio_ma20, iwm_spy_ratio_z
FROM rsi LEFT JOIN rsq USING (date)""")

# --- events ------------------------------------------------------------------------
cte("fixev", "SELECT CAST(d AS DATE) - " + str(cfg.FIXTURE_EVENT_SHIFT_DAYS)
    + " AS date, event_type, event_name, source FROM (VALUES " + ", ".join(
        f"('{d}', '{k}', '{n}', '{s}')"
        for k, (n, s, ds) in cfg.FIXED_EVENTS.items() for d in ds)
    + ") AS t(d, event_type, event_name, source)")
cte("evcal", """
SELECT * FROM fixev WHERE date BETWEEN (SELECT min(date) FROM cal)
                             AND (SELECT max(date) FROM cal)""")
cte("evfull", """
SELECT * FROM evcal
UNION ALL SELECT max(date), 'month_end', 'Month End', 'NYSE calendar'
  FROM cal GROUP BY date_trunc('month', date)
UNION ALL SELECT max(date), 'quarter_end', 'Quarter End', 'NYSE calendar'
  FROM cal GROUP BY date_trunc('quarter', date)
UNION ALL SELECT c.date, 'options_expiry_week',
    'Options Expiry Week ' || strftime(f.fri, '%Y-%m'), 'computed'
  FROM cal c JOIN (
    SELECT m + ((12 - isodow(m)) % 7)::INTEGER + 14 AS fri FROM (
      SELECT DISTINCT CAST(date_trunc('month', date) AS DATE) AS m FROM cal)) f
  ON c.date BETWEEN f.fri - 4 AND f.fri + 2""")
cte("evflags", "SELECT date, " + ", ".join(
    f"CAST(max(CASE WHEN event_type = '{t}' THEN 1 ELSE 0 END) AS INTEGER) AS is_{t}"
    for t in cfg.ALLOWED_EVENTS) + " FROM evcal GROUP BY date")

# --- joined features ---------------------------------------------------------------
_MACRO_OUT = ["dgs10", "dgs2", "yield_curve_slope", "dgs10_change_1d", "dgs10_change_5d",
              "dgs2_change_1d", "dgs2_change_5d", "hy_oas_level", "hy_oas_change_1d",
              "hy_oas_change_5d", "fed_balance_sheet_change_pct", "rrp_level",
              "rrp_change_pct_5d"]
_RAW_OUT = [f"{k}_raw" for k in cfg.MACRO_KEYS]
_X_OUT = (["vix_level", "vix_change_1d", "vix_change_5d", "vix_pct_change_1d",
           "vix_term_structure"]
          + [f"{n}_ret_{k}d" for n in _FAM for k in (1, 5, 20)]
          + ["hyg_vs_spy_5d", "hyg_spy_corr_20d", "rsp_spy_ratio",
             "rsp_spy_ratio_ma20", "rsp_spy_ratio_z"])
_R_OUT = [f"{c}_spy_ratio{t}" for c in ("qqq", "iwm") for t in ("", "_ma20", "_z")]
TECH_OUT = (cfg.TECHNICAL_FEATURES + cfg.SESSION_FEATURES + cfg.TREND_FEATURES
            + ["tr", "rolling_max_60"])
cte("ctx", "SELECT b.symbol, b.date, b.open, b.high, b.low, b.close, b.adj_close, b.volume, "
    + ", ".join(f"b.{c}" for c in TECH_OUT) + ", "
    + ", ".join(f"m.{c}" for c in _MACRO_OUT + _RAW_OUT) + ", m.liquidity_expanding, "
    + ", ".join(f'x."{c}"' for c in _X_OUT) + ", "
    + ", ".join(f'x."{s}_close"' for s in cfg.PROXY_SYMBOLS + ["SPY"]) + ", "
    + ", ".join(f"q.{c}" for c in _R_OUT) + ", "
    + ", ".join(f"coalesce(e.is_{t}, 0) AS is_{t}" for t in cfg.ALLOWED_EVENTS)
    + """ FROM tech b LEFT JOIN mfeat m USING (date) LEFT JOIN xfeat x USING (date)
    LEFT JOIN rfeat q USING (date) LEFT JOIN evflags e USING (date)""")
_FILL = _MACRO_OUT + _RAW_OUT
cte("filled", "SELECT * REPLACE (" + ", ".join(
    f"{last_in(c, cfg.FILL_LIMIT_ROWS)} AS {c}" for c in _FILL) + ") FROM ctx")
cte("regs", f"""
SELECT *, CASE WHEN vix_level > 20 OR vix_level > {roll('quantile_cont($, 0.75)', 'vix_level', 60)}
    THEN 1 ELSE 0 END AS high_vol_regime,
  CASE WHEN dgs10 < dgs2 THEN 1 ELSE 0 END AS curve_inverted,
  CASE WHEN hy_oas_level > {roll('quantile_cont($, 0.80)', 'hy_oas_level', 60)}
    THEN 1 ELSE 0 END AS credit_stress,
  liquidity_expanding AS liquidity_expanding_regime
FROM filled""")
cte("feats", "SELECT *, " + ", ".join(
    f"lag({f}, {n}) {W} AS {f}_lag{n}" for f, ns in cfg.LAG_SPEC.items() for n in ns)
    + " FROM regs")
cte("dataset", "SELECT symbol, date, open, high, low, close, adj_close, volume, "
    "dgs10_change_1d, " + ", ".join(
        (f"{cfg.SOURCE_KEYS[f]} AS {f}" if f in cfg.SOURCE_KEYS else f)
        for f in cfg.MODEL_FEATURES) + " FROM feats")

# --- labels --------------------------------------------------------------------------
cte("l1", f"""
SELECT symbol, date, close, vol_20, lead(close, 1) {W} AS outcome_price_1d,
  lead(close, 5) {W} AS outcome_price_5d FROM t3""")
cte("l2", """
SELECT *, ln(outcome_price_1d / close) AS y_1d_raw, ln(outcome_price_5d / close) AS y_5d_raw
FROM l1""")


def _label(h: int) -> str:
    raw = f"y_{h}d_raw"
    vol = f"{raw} / (vol_20 + 1e-9)"
    sd = f"stddev_samp({raw}) OVER (PARTITION BY symbol)"
    return f"""
  {vol} AS y_{h}d_vol,
  CASE WHEN {raw} IS NOT NULL THEN greatest(-3 * {sd}, least(3 * {sd}, {raw})) END AS y_{h}d_clipped,
  CASE WHEN {vol} IS NOT NULL THEN greatest(-3e0, least(3e0, {vol})) END AS y_{h}d_vol_clip,
  CASE WHEN {raw} > 0 THEN 1 WHEN {raw} <= 0 THEN -1 END AS y_class_{h}d,
  CASE WHEN outcome_price_{h}d > close THEN 1 ELSE 0 END AS y_{h}d"""


cte("labs", f"""
SELECT symbol, date, outcome_price_1d, outcome_price_5d, y_1d_raw, y_5d_raw,
  {_label(1)}, {_label(5)},
  CASE WHEN outcome_price_1d / close - 1 > {cfg.Y_THRESHOLD!r} THEN 1 ELSE 0 END AS y_thresh
FROM l2""")
cte("lab", "SELECT *, y_1d_vol_clip AS primary_target FROM labs")
cte("lab3", "SELECT * REPLACE (" + ", ".join(
    f"CASE WHEN y_{h}d_vol IS NULL THEN NULL WHEN y_{h}d_vol > {cfg.BARRIER} THEN 1 "
    f"WHEN y_{h}d_vol < -{cfg.BARRIER} THEN -1 ELSE 0 END AS y_class_{h}d" for h in (1, 5))
    + ") FROM lab")
