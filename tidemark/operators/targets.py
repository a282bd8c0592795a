"""Forward-looking outcomes, regression targets and classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as cfg
from ..functions.rolling import Series
from ..functions.scalars import (binary_class, clip, flag, safe_div,
                                 triple_barrier)
from .technical import BY_SYMBOL

C = F.col
HORIZONS = (1, 5)
LABEL_COLUMNS = (
    ["symbol", "date", "outcome_price_1d", "outcome_price_5d",
     "primary_target", "y_1d_vol_clip", "y_5d_vol_clip", "y_class_1d",
     "y_class_5d", "y_1d_raw", "y_5d_raw", "y_1d_vol", "y_5d_vol",
     "y_1d_clipped", "y_5d_clipped", "y_1d", "y_5d", "y_thresh"])


def raw_returns(df: DataFrame, s: Series = BY_SYMBOL) -> DataFrame:
    """Outcome prices and forward log returns next to close and ``vol_20``."""
    df = df.select("symbol", "date", "close", "vol_20")
    df = df.withColumns({f"outcome_price_{h}d": s.lead("close", h)
                         for h in HORIZONS})
    return df.withColumns({
        f"y_{h}d_raw": F.log(safe_div(C(f"outcome_price_{h}d"), C("close")))
        for h in HORIZONS})


def clipped_return(raw: Column, sigma: Column) -> Column:
    """Bounded to three deviations; an undefined one leaves the value unbounded."""
    return F.when(sigma.isNull(), raw).otherwise(clip(raw, -3 * sigma, 3 * sigma))


# --- deviations that go on from run to run -----------------------------------------
def return_moments(returns: DataFrame) -> DataFrame:
    """Per symbol and horizon: count, mean, centred squares and last day of the known returns."""
    aggs = []
    for h in HORIZONS:
        raw = C(f"y_{h}d_raw")
        n = F.count(raw)
        aggs += [n.alias(f"n_{h}d"), F.avg(raw).alias(f"mean_{h}d"),
                 (F.var_pop(raw) * n).alias(f"squares_{h}d"),
                 F.max(F.when(raw.isNotNull(), C("date"))).alias(f"upto_{h}d")]
    return returns.groupBy("symbol").agg(F.max("date").alias("date"), *aggs)


def merged_moments(old: DataFrame, new: DataFrame) -> DataFrame:
    """Moments of both parts of each symbol's returns; parts share no row."""
    names = [f"{m}_{h}d" for h in HORIZONS for m in ("n", "mean", "squares", "upto")]
    joined = (old.select("symbol", C("date").alias("_od"), *[C(c).alias(f"_o_{c}") for c in names])
              .join(new.select("symbol", C("date").alias("_nd"), *[C(c).alias(f"_n_{c}") for c in names]),
                    "symbol", "full"))
    out = []
    for h in HORIZONS:
        (na, ma, qa, ua), (nb, mb, qb, ub) = (
            [C(f"_{side}_{m}_{h}d") for m in ("n", "mean", "squares", "upto")] for side in "on")
        na, nb = F.coalesce(na, F.lit(0)), F.coalesce(nb, F.lit(0))
        n = na + nb
        apart = F.coalesce(mb - ma, F.lit(0.0))
        out += [n.alias(f"n_{h}d"),
                F.coalesce(ma + F.try_divide(apart * nb, n), ma, mb).alias(f"mean_{h}d"),
                F.when(n > 0, F.coalesce(qa, F.lit(0.0)) + F.coalesce(qb, F.lit(0.0))
                       + F.try_divide(apart * apart * na * nb, n)).alias(f"squares_{h}d"),
                F.greatest(ua, ub).alias(f"upto_{h}d")]
    return joined.select("symbol", F.greatest("_od", "_nd").alias("date"), *out)


def deviation(h: int) -> Column:
    """Sample deviation from the moments; undefined below two values."""
    return F.when(C(f"n_{h}d") > 1, F.sqrt(C(f"squares_{h}d") / (C(f"n_{h}d") - 1)))


def reclipped(labels: DataFrame, deviations: DataFrame) -> DataFrame:
    """(symbol, date, y_1d_clipped, y_5d_clipped) of the stored rows that new deviations bound otherwise.

    ``deviations`` holds symbol, before_1d, sigma_1d and so on.  Only returns beyond
    three times the smaller deviation can change.
    """
    rows = labels.join(deviations, "symbol")
    changed, clipped = F.lit(False), {}
    for h in HORIZONS:
        raw, old = C(f"y_{h}d_raw"), C(f"y_{h}d_clipped")
        beyond = F.abs(raw) > 3 * F.least(C(f"before_{h}d"), C(f"sigma_{h}d"))
        new = clipped_return(raw, C(f"sigma_{h}d"))
        # a deviation that was or is undefined bounds nothing
        open_ = C(f"before_{h}d").isNull() | C(f"sigma_{h}d").isNull()
        changed = changed | ((open_ | beyond) & ~new.eqNullSafe(old))
        clipped[f"y_{h}d_clipped"] = new
    return rows.where(changed).select("symbol", "date", *[v.alias(k) for k, v in clipped.items()])


def build_labels(df: DataFrame, y_thresh: float = cfg.Y_THRESHOLD,
                 keep_incomplete: bool = True,
                 s: Series = BY_SYMBOL, deviations: DataFrame | None = None) -> DataFrame:
    """Labels from ``symbol, date, close, vol_20``.

    ``keep_incomplete=False`` drops each symbol's last five rows, whose
    five-day outcome cannot be known.  ``deviations`` (symbol, sigma_1d, sigma_5d)
    stands in for those of the rows at hand where these are not all.
    """
    close = C("close")
    df = raw_returns(df, s)
    if deviations is not None:
        df = df.join(deviations.select("symbol", *[f"sigma_{h}d" for h in HORIZONS]), "symbol", "left")
    out = {}
    for h in HORIZONS:
        raw = C(f"y_{h}d_raw")
        vol = raw / (C("vol_20") + 1e-9)
        sigma = F.stddev_samp(raw).over(s.whole) if deviations is None else C(f"sigma_{h}d")
        out[f"y_{h}d_vol"] = vol
        out[f"y_{h}d_clipped"] = clipped_return(raw, sigma)
        out[f"y_{h}d_vol_clip"] = clip(vol, -cfg.TARGET_CLIP, cfg.TARGET_CLIP)
        out[f"y_class_{h}d"] = binary_class(raw)
        out[f"y_{h}d"] = flag(C(f"outcome_price_{h}d") > close)
    out["primary_target"] = out["y_1d_vol_clip"]
    out["y_thresh"] = flag(
        safe_div(C("outcome_price_1d"), close) - 1.0 > y_thresh)
    if not keep_incomplete:
        out["_left"] = F.count("*").over(s.whole) - s.row_number()
    df = df.withColumns(out)
    if not keep_incomplete:
        df = df.where(C("_left") >= max(HORIZONS))
    return df.select(*LABEL_COLUMNS)


def barrier_classes(labels: DataFrame, barrier: float = cfg.BARRIER) -> DataFrame:
    """Triple-barrier classes from the stored vol-scaled targets."""
    return labels.withColumns({
        f"y_class_{h}d": triple_barrier(C(f"y_{h}d_vol"), barrier)
        for h in HORIZONS})


def backfill_targets(labels: DataFrame) -> DataFrame:
    """Recompute the clipped targets and their alias from the vol columns."""
    fresh = {f"y_{h}d_vol_clip": clip(C(f"y_{h}d_vol"), -cfg.TARGET_CLIP,
                                      cfg.TARGET_CLIP) for h in HORIZONS}
    df = labels.withColumns(fresh)
    return df.withColumn("primary_target",
                         F.coalesce("y_1d_vol_clip", "primary_target"))


def target_diagnostics(labels: DataFrame, s: Series = BY_SYMBOL) -> DataFrame:
    """Targets with their running deviation over the last 253 rows."""
    frame = s.ordered.rowsBetween(-252, 0)
    return labels.withColumns({
        f"{c}_std_252": F.stddev_samp(c).over(frame)
        for c in ("y_1d_raw", "y_1d_vol", "y_1d_vol_clip")})
