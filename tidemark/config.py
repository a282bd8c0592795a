"""Fixed values and parameters shared by every module.

Everything here is plain data: ticker universes, thresholds, feature
manifests, event dates.  No Spark objects are created at import time.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date

# --- Fixed values: symbol universe -----------------------------------------
ETF_SYMBOLS = ["SPY", "QQQ", "DIA", "IWM"]
ETF_DESCRIPTIONS = {
    "SPY": "S&P 500 ETF",
    "QQQ": "Nasdaq-100 ETF",
    "DIA": "Dow Jones ETF",
    "IWM": "Russell 2000 Small-Cap ETF",
}
PROXIES = {
    "^VIX": ("CBOE Volatility Index", "index"),
    "^VIX9D": ("CBOE 9-Day Volatility", "index"),
    "^VVIX": ("CBOE VIX of VIX", "index"),
    "UUP": ("Dollar Index ETF", "etf"),
    "GLD": ("Gold ETF", "etf"),
    "USO": ("Oil ETF", "etf"),
    "HYG": ("High Yield Corporate Bonds ETF", "etf"),
    "LQD": ("Investment Grade Corporate Bonds ETF", "etf"),
    "TLT": ("20+ Year Treasury ETF", "etf"),
    "RSP": ("Equal Weight S&P 500 ETF", "etf"),
}
PROXY_SYMBOLS = list(PROXIES)

# --- Fixed values: macro catalogue (name, frequency, units, description) ----
MACRO_SERIES = {
    "DGS2": ("2Y Treasury Yield", "daily", "Percent",
             "Market Yield on U.S. Treasury Securities at 2-Year Constant Maturity"),
    "DGS10": ("10Y Treasury Yield", "daily", "Percent",
              "Market Yield on U.S. Treasury Securities at 10-Year Constant Maturity"),
    "FEDFUNDS": ("Federal Funds Rate", "monthly", "Percent",
                 "Effective Federal Funds Rate (Target Rate)"),
    "EFFR": ("Effective Federal Funds Rate", "daily", "Percent",
             "Effective Federal Funds Rate (Actual Traded Rate)"),
    "T10YIE": ("10Y Breakeven Inflation", "daily", "Percent",
               "10-Year Breakeven Inflation Rate (TIPS-based)"),
    "BAMLH0A0HYM2": ("High Yield OAS", "daily", "Basis Points",
                     "ICE BofA US High Yield Option-Adjusted Spread"),
    "WALCL": ("Fed Total Assets", "weekly", "Millions of Dollars",
              "Federal Reserve Total Assets (Balance Sheet Size)"),
    "RRPONTSYD": ("ON RRP Usage", "daily", "Billions of Dollars",
                  "Overnight Reverse Repurchase Agreements (Fed Facility)"),
    "SOFR": ("Secured Overnight Financing Rate", "daily", "Percent",
             "Secured Overnight Financing Rate"),
}
MACRO_KEYS = list(MACRO_SERIES)
# A column holding any of these fragments counts as macro for bounded filling.
MACRO_COLUMN_HINTS = ["dgs", "fed", "hy_", "yield_", "walcl", "rrp", "effr",
                      "sofr", "t10y", "baml"]

# --- Fixed values: event calendar ------------------------------------------
ALLOWED_EVENTS = ["fomc", "cpi_release", "nfp_release"]
CALENDAR_EVENTS = ["month_end", "quarter_end", "options_expiry_week"]
FOMC_DATES = [
    "2024-01-31", "2024-03-20", "2024-05-01", "2024-06-12",
    "2024-07-31", "2024-09-18", "2024-11-07", "2024-12-18",
    "2025-01-29", "2025-03-19", "2025-05-07", "2025-06-18",
    "2025-07-30", "2025-09-17", "2025-11-05", "2025-12-17",
]
CPI_DATES = [
    "2024-01-11", "2024-02-13", "2024-03-12", "2024-04-10",
    "2024-05-15", "2024-06-12", "2024-07-11", "2024-08-14",
    "2024-09-11", "2024-10-10", "2024-11-13", "2024-12-11",
    "2025-01-15", "2025-02-12", "2025-03-12", "2025-04-10",
    "2025-05-13", "2025-06-11", "2025-07-11", "2025-08-13",
    "2025-09-10", "2025-10-10", "2025-11-12", "2025-12-10",
]
NFP_DATES = [
    "2024-01-05", "2024-02-02", "2024-03-08", "2024-04-05",
    "2024-05-03", "2024-06-07", "2024-07-05", "2024-08-02",
    "2024-09-06", "2024-10-04", "2024-11-01", "2024-12-06",
    "2025-01-10", "2025-02-07", "2025-03-07", "2025-04-04",
    "2025-05-02", "2025-06-06", "2025-07-03", "2025-08-01",
    "2025-09-05", "2025-10-03", "2025-11-07", "2025-12-05",
]
FIXED_EVENTS = {
    # type: (event name, source, dates)
    "fomc": ("FOMC Meeting", "Federal Reserve", FOMC_DATES),
    "cpi_release": ("CPI Release", "BLS", CPI_DATES),
    "nfp_release": ("NFP Release", "BLS", NFP_DATES),
}
EVENT_TYPE_METADATA = [
    # event_type, name, description, typical_impact, frequency_per_year
    ("fomc", "FOMC Meeting",
     "Federal Open Market Committee monetary policy decision",
     "High volatility, rates-sensitive sectors react", 8),
    ("cpi_release", "CPI Release",
     "Consumer Price Index (inflation data) release",
     "Market-moving inflation data, affects Fed policy expectations", 12),
    ("nfp_release", "Jobs Report",
     "Non-Farm Payrolls employment data release",
     "Major market mover, first Friday of month", 12),
]

# --- Fixed values: feature groups ------------------------------------------
BAR_COLUMNS = ["date", "open", "high", "low", "close", "adj_close", "volume"]
LAG_SPEC = {
    "log_ret_1d": [1, 2, 3, 5],
    "vix_change_1d": [1, 3],
    "hy_oas_change_1d": [1],
    "yield_curve_slope": [1],
}
BINARY_FEATURES = [
    "sma20_gt_sma50", "dow", "days_since_prev",
    "is_fomc", "is_cpi_release", "is_nfp_release",
    "high_vol_regime", "curve_inverted", "credit_stress",
    "liquidity_expanding_regime", "liquidity_expanding",
]
VOL_SCALED_FEATURES = ["overnight_share", "vol_5", "vol_20", "vol_60"]
REGIME_FLAGS = ["high_vol_regime", "curve_inverted", "credit_stress",
                "liquidity_expanding_regime"]

TECHNICAL_FEATURES = [
    "log_ret_1d", "log_ret_5d", "log_ret_20d", "rsi_14", "macd_hist",
    "vol_5", "vol_20", "vol_60", "atr_14", "high_low_pct", "close_open_pct",
    "sma_20", "sma_50", "sma_200", "ema_20", "ema_50", "sma20_gt_sma50",
    "volume_z", "volume_chg_pct", "dd_60", "dow", "days_since_prev",
]
SESSION_FEATURES = [
    "overnight_return", "intraday_return", "overnight_mean_20",
    "overnight_std_20", "intraday_mean_20", "intraday_std_20",
    "overnight_share",
]
TREND_FEATURES = ["adx_14", "return_autocorr_20", "price_rsq_20"]
MACRO_FEATURES = [
    "dgs2", "dgs10", "yield_curve_slope", "dgs10_change_5d", "hy_oas_level",
    "hy_oas_change_1d", "hy_oas_change_5d", "liquidity_expanding",
    "fed_bs_chg_pct", "rrp_level", "rrp_chg_pct_5d",
]
VIX_FEATURES = ["vix_level", "vix_change_1d", "vix_change_5d",
                "vix_term_structure"]
CROSS_FEATURES = ["dxy_ret_5d", "gold_ret_5d", "oil_ret_5d", "hyg_ret_5d",
                  "hyg_vs_spy_5d", "hyg_spy_corr_20d", "lqd_ret_5d",
                  "tlt_ret_5d"]
BREADTH_FEATURES = ["rsp_spy_ratio", "rsp_spy_ratio_z", "qqq_spy_ratio_z",
                    "iwm_spy_ratio_z"]
LAGGED_FEATURES = ["log_ret_1d_lag1", "log_ret_1d_lag2", "log_ret_1d_lag3",
                   "log_ret_1d_lag5", "vix_change_lag1", "vix_change_lag3",
                   "hy_oas_change_lag1", "yield_curve_slope_lag1"]
EVENT_FEATURES = ["is_fomc", "is_cpi_release", "is_nfp_release"]

# The 74 model features of the classification / regression datasets.
MODEL_FEATURES = (TECHNICAL_FEATURES + SESSION_FEATURES + TREND_FEATURES
                  + MACRO_FEATURES + VIX_FEATURES + CROSS_FEATURES
                  + BREADTH_FEATURES + LAGGED_FEATURES + REGIME_FLAGS
                  + EVENT_FEATURES)
# The 53 features of the pruned view (dgs10_change_1d kept, no session,
# trend, lag or regime groups).
PRUNED_FEATURES = (TECHNICAL_FEATURES
                   + ["dgs2", "dgs10", "yield_curve_slope", "dgs10_change_1d"]
                   + MACRO_FEATURES[3:] + VIX_FEATURES + CROSS_FEATURES
                   + BREADTH_FEATURES + EVENT_FEATURES)
# The 75 features of the first regression view.
REGRESSION_FEATURES = (TECHNICAL_FEATURES + SESSION_FEATURES + TREND_FEATURES
                       + ["dgs2", "dgs10", "yield_curve_slope",
                          "dgs10_change_1d"]
                       + MACRO_FEATURES[3:] + VIX_FEATURES + CROSS_FEATURES
                       + BREADTH_FEATURES + LAGGED_FEATURES + REGIME_FLAGS
                       + EVENT_FEATURES)
# Dataset column -> key under which the feature document stores it.
SOURCE_KEYS = {
    "fed_bs_chg_pct": "fed_balance_sheet_change_pct",
    "rrp_chg_pct_5d": "rrp_change_pct_5d",
    "vix_change_lag1": "vix_change_1d_lag1",
    "vix_change_lag3": "vix_change_1d_lag3",
    "hy_oas_change_lag1": "hy_oas_change_1d_lag1",
}
INTEGER_FEATURES = ["sma20_gt_sma50", "dow", "days_since_prev",
                    "liquidity_expanding"] + REGIME_FLAGS + EVENT_FEATURES

# --- Fixed values: clipping rules ------------------------------------------
CLIP_SPECIAL = {
    "rsi_14": (0.0, 100.0), "dd_60": (-1.0, 0.0),
    "overnight_share": (-1.0, 1.0), "adx_14": (0.0, 100.0),
    "return_autocorr_20": (-1.0, 1.0), "price_rsq_20": (0.0, 1.0),
    "hyg_spy_corr_20d": (-1.0, 1.0),
}
CLIP_NEVER = set(BINARY_FEATURES) | {
    "vol_5", "vol_20", "vol_60", "sma_20", "sma_50", "sma_200", "ema_20",
    "ema_50",
}


def default_clip_rules() -> dict[str, tuple[float, float]]:
    """Every unbounded model feature clips to +-5, bounded ones to their range."""
    return {f: CLIP_SPECIAL.get(f, (-5.0, 5.0))
            for f in MODEL_FEATURES if f not in CLIP_NEVER}


# --- Fixed values: feature registry ----------------------------------------
FEATURE_EXCLUSIONS = [
    ("dgs10_change_1d", "Redundant with dgs10_change_5d and yield_curve_slope"),
    ("sma_5", "Redundant with SMA_20"),
    ("sma_10", "Redundant with SMA_20"),
    ("ema_5", "Redundant with EMA_20"),
    ("ema_10", "Redundant with EMA_20"),
    ("ema_200", "Redundant with SMA_200 and EMA_50"),
    ("macd_line", "Redundant with macd_hist"),
    ("macd_signal", "Redundant with macd_hist"),
    ("obv", "Noisy volume proxy, redundant with volume_z"),
    ("vol_10", "Redundant with vol_5 and vol_20"),
    ("log_ret_10d", "Redundant with log_ret_5d and log_ret_20d"),
    ("dd_20", "Redundant with dd_60"),
]
FEATURE_REGISTRY = [
    # feature_name, feature_type, description, window_size
    ("overnight_return", "technical", "Open - previous close", None),
    ("intraday_return", "technical", "Close - open", None),
    ("overnight_mean_20", "technical", "20-day mean of overnight returns", 20),
    ("overnight_std_20", "technical", "20-day std of overnight returns", 20),
    ("intraday_mean_20", "technical", "20-day mean of intraday returns", 20),
    ("intraday_std_20", "technical", "20-day std of intraday returns", 20),
    ("overnight_share", "technical", "Overnight return / total daily return", None),
    ("adx_14", "technical", "14-day Average Directional Index (trend strength)", 14),
    ("return_autocorr_20", "technical", "20-day autocorrelation of returns", 20),
    ("price_rsq_20", "technical", "20-day R² of price vs time (linear trend fit)", 20),
    ("log_ret_1d_lag1", "lagged", "1-day return lagged 1 period", None),
    ("log_ret_1d_lag2", "lagged", "1-day return lagged 2 periods", None),
    ("log_ret_1d_lag3", "lagged", "1-day return lagged 3 periods", None),
    ("log_ret_1d_lag5", "lagged", "1-day return lagged 5 periods", None),
    ("vix_change_lag1", "lagged", "VIX 1d change lagged 1 period", None),
    ("vix_change_lag3", "lagged", "VIX 1d change lagged 3 periods", None),
    ("hy_oas_change_lag1", "lagged", "HY OAS 1d change lagged 1 period", None),
    ("yield_curve_slope_lag1", "lagged", "Yield curve slope lagged 1 period", None),
    ("high_vol_regime", "regime", "VIX > 20 OR VIX > 75th percentile (60d)", 60),
    ("curve_inverted", "regime", "DGS10 < DGS2 (inverted yield curve)", None),
    ("credit_stress", "regime", "HY OAS > 80th percentile (60d)", 60),
    ("liquidity_expanding_regime", "regime", "Fed balance sheet 4-week change > 0", 20),
    ("y_1d_vol", "target", "1d return / rolling_vol_20 (vol-scaled regression target)", 20),
    ("y_5d_vol", "target", "5d return / rolling_vol_20 (vol-scaled regression target)", 20),
]

# --- Fixed values: categories and texts of the optimization summary ---------
SUMMARY_FACTS = [
    ("Primary Target", "y_1d_vol_clip",
     "Volatility-scaled 1d return clipped to ±3σ"),
    ("Secondary Target", "y_5d_vol_clip",
     "Volatility-scaled 5d return clipped to ±3σ"),
    ("Classification Target", "y_class_1d",
     "Triple-barrier 1d class: 1 (Buy), 0 (Hold), -1 (Sell) using y_1d_vol ± 0.25"),
    ("Features Kept", str(len(MODEL_FEATURES)),
     "Non-redundant features in optimized datasets"),
]
SUMMARY_TEXTS = {
    "Features Excluded": "Redundant features removed for collinearity reduction",
    "Total Symbols": "ETFs in dataset",
    "Date Range": "Coverage period",
    "Classification Rows": "Total rows with valid y_class_1d target",
}

# --- Fixed values: thresholds ----------------------------------------------
Y_THRESHOLD = 0.002          # legacy "meaningful move" label
BARRIER = 0.25               # triple-barrier class, in units of volatility
TARGET_CLIP = 3.0
WARMUP_DAYS = 252
RENEWED_DAYS = 28            # days before a run that a late observation can reach
FRAME_ROWS = 210             # rows that any feature looks back on, besides averages
MAX_GAP_DAYS = 7             # staleness limit of a macro observation
FILL_LIMIT_ROWS = 5          # bounded fill on joined rows
DEFAULT_START = date(2015, 1, 1)
SPLITS = {
    "train": (date(2000, 2, 1), date(2023, 12, 31)),
    "val": (date(2024, 1, 1), date(2024, 12, 31)),
    "test": (date(2025, 1, 1), date(2025, 12, 5)),
}
CONF_GRID = (34, 75)         # hundredths, inclusive
MARGIN_GRID = (0, 35)
TRADE_RATE_BOUNDS = {"1d": (0.20, 0.70), "5d": (0.15, 0.60)}
SCORE_WEIGHTS = (0.6, 0.4)   # f1_macro, f1_action
PLACEHOLDER = {"p_up": 0.55, "p_down": 0.45, "model_name": "placeholder_xgb"}


@dataclass
class FeatureWindows:
    """Width lists for the parametric window kernels."""

    returns: list[int] = field(default_factory=lambda: [1, 5, 10, 20])
    volatility: list[int] = field(default_factory=lambda: [5, 10, 20, 60])
    sma: list[int] = field(default_factory=lambda: [5, 10, 20, 50, 200])
    ema: list[int] = field(default_factory=lambda: [5, 10, 20, 50, 200])
    drawdown: list[int] = field(default_factory=lambda: [20, 60])


# Bars derived from the synthetic tables span 1995-2001, so the split borders
# and the event calendar are moved there.  1409 whole weeks keep weekdays.
FIXTURE_EVENT_SHIFT_DAYS = 1409 * 7
FIXTURE_SPLITS = {
    "train": (date(1995, 1, 1), date(1999, 12, 31)),
    "val": (date(2000, 1, 1), date(2000, 12, 31)),
    "test": (date(2001, 1, 1), date(2001, 12, 31)),
}
# Ticker played by each return flag of the line items.
FLAG_TO_TICKER = {"A": "SPY", "N": "QQQ", "R": "IWM"}
