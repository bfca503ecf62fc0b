"""The 158 price-volume factors, made from a few patterns and five windows."""

from __future__ import annotations

from functools import cache

from ..expr import Expr
from ..formula import parse

#: Windows, and what keeps denominators off zero.
WINDOWS = (5, 10, 20, 30, 60)
EPS = "0.000000000001"

#: Shapes of a single bar.
BAR = {
    "KMID": "(close - open) / open",
    "KLEN": "(high - low) / open",
    "KMID2": "(close - open) / (high - low + eps)",
    "KUP": "(high - max(open, close)) / open",
    "KUP2": "(high - max(open, close)) / (high - low + eps)",
    "KLOW": "(min(open, close) - low) / open",
    "KLOW2": "(min(open, close) - low) / (high - low + eps)",
    "KSFT": "(2 * close - high - low) / open",
    "KSFT2": "(2 * close - high - low) / (high - low + eps)",
    "OPEN0": "open / close",
    "HIGH0": "high / close",
    "LOW0": "low / close",
    "VWAP0": "vwap / close",
}

#: Patterns over a window of d rows.
ROLLING = {
    "ROC": "delay(close, d) / close",
    "MA": "ts_mean(close, d) / close",
    "STD": "ts_std(close, d) / close",
    "BETA": "slope(close, d) / close",
    "RSQR": "rsquare(close, d)",
    "RESI": "resi(close, d) / close",
    "MAX": "ts_max(high, d) / close",
    "MIN": "ts_min(low, d) / close",
    "QTLU": "quantile(close, d, 0.8) / close",
    "QTLD": "quantile(close, d, 0.2) / close",
    "RANK": "ts_rank(close, d)",
    "RSV": "(close - ts_min(low, d)) / (ts_max(high, d) - ts_min(low, d) + eps)",
    "IMAX": "(ts_argmax(high, d) + 1) / w",
    "IMIN": "(ts_argmin(low, d) + 1) / w",
    "IMXD": "(ts_argmax(high, d) - ts_argmin(low, d)) / w",
    "CORR": "correlation(close, log(volume + 1), d)",
    "CORD": "correlation(close / delay(close, 1), log(volume / delay(volume, 1) + 1), d)",
    "CNTP": "ts_mean(close > delay(close, 1), d)",
    "CNTN": "ts_mean(close < delay(close, 1), d)",
    "CNTD": "ts_mean(close > delay(close, 1), d) - ts_mean(close < delay(close, 1), d)",
    "SUMP": "ts_sum(max(close - delay(close, 1), 0), d) / (ts_sum(abs(close - delay(close, 1)), d) + eps)",
    "SUMN": "ts_sum(max(delay(close, 1) - close, 0), d) / (ts_sum(abs(close - delay(close, 1)), d) + eps)",
    "SUMD": "(ts_sum(max(close - delay(close, 1), 0), d) - ts_sum(max(delay(close, 1) - close, 0), d)) / (ts_sum(abs(close - delay(close, 1)), d) + eps)",
    "VMA": "ts_mean(volume, d) / (volume + eps)",
    "VSTD": "ts_std(volume, d) / (volume + eps)",
    "WVMA": "ts_std(abs(close / delay(close, 1) - 1) * volume, d) / (ts_mean(abs(close / delay(close, 1) - 1) * volume, d) + eps)",
    "VSUMP": "ts_sum(max(volume - delay(volume, 1), 0), d) / (ts_sum(abs(volume - delay(volume, 1)), d) + eps)",
    "VSUMN": "ts_sum(max(delay(volume, 1) - volume, 0), d) / (ts_sum(abs(volume - delay(volume, 1)), d) + eps)",
    "VSUMD": "(ts_sum(max(volume - delay(volume, 1), 0), d) - ts_sum(max(delay(volume, 1) - volume, 0), d)) / (ts_sum(abs(volume - delay(volume, 1)), d) + eps)",
}


@cache
def library() -> dict[str, Expr]:
    out = {n: parse(f.replace("eps", EPS)) for n, f in BAR.items()}
    for n, f in ROLLING.items():
        for d in WINDOWS:
            out[f"{n}{d}"] = parse(f.replace("eps", EPS).replace(", d", f", {d}").replace("/ w", f"/ {d}"))
    return out
