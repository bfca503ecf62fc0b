"""The 101 formulaic alphas."""

from __future__ import annotations

from functools import cache

from ..expr import Expr
from ..formula import read_sheet

#: The published formulas.
FORMULAS = """
ret = close / delay(close, 1) - 1
mid = (high + low) / 2
d1 = delta(close, 1)
trend = (delay(close, 20) - delay(close, 10)) / 10 - (delay(close, 10) - close) / 10
alpha1 = rank(ts_argmax(signed_power(ts_std(ret, 20) if ret < 0 else close, 2), 5)) - 0.5
alpha2 = -1 * correlation(rank(delta(log(volume), 2)), rank((close - open) / open), 6)
alpha3 = -1 * correlation(rank(open), rank(volume), 10)
alpha4 = -1 * ts_rank(rank(low), 9)
alpha5 = rank(open - mean(vwap, 10)) * (-1 * abs(rank(close - vwap)))
alpha6 = -1 * correlation(open, volume, 10)
alpha7 = (-1 * ts_rank(abs(delta(close, 7)), 60)) * sign(delta(close, 7)) if adv(20) < volume else -1
sums = ts_sum(open, 5) * ts_sum(ret, 5)
alpha8 = -1 * rank(sums - delay(sums, 10))
alpha9 = d1 if 0 < ts_min(d1, 5) else (d1 if ts_max(d1, 5) < 0 else -1 * d1)
alpha10 = rank(d1 if 0 < ts_min(d1, 4) else (d1 if ts_max(d1, 4) < 0 else -1 * d1))
alpha11 = (rank(ts_max(vwap - close, 3)) + rank(ts_min(vwap - close, 3))) * rank(delta(volume, 3))
alpha12 = sign(delta(volume, 1)) * (-1 * d1)
alpha13 = -1 * rank(covariance(rank(close), rank(volume), 5))
alpha14 = (-1 * rank(delta(ret, 3))) * correlation(open, volume, 10)
alpha15 = -1 * ts_sum(rank(correlation(rank(high), rank(volume), 3)), 3)
alpha16 = -1 * rank(covariance(rank(high), rank(volume), 5))
alpha17 = ((-1 * rank(ts_rank(close, 10))) * rank(delta(d1, 1))) * rank(ts_rank(volume / adv(20), 5))
alpha18 = -1 * rank(ts_std(abs(close - open), 5) + (close - open) + correlation(close, open, 10))
alpha19 = (-1 * sign((close - delay(close, 7)) + delta(close, 7))) * (rank(ts_sum(ret, 250) + 1) + 1)
alpha20 = ((-1 * rank(open - delay(high, 1))) * rank(open - delay(close, 1))) * rank(open - delay(low, 1))
alpha21 = -1 if mean(close, 8) + ts_std(close, 8) < mean(close, 2) else (1 if mean(close, 2) < mean(close, 8) - ts_std(close, 8) else (1 if volume / adv(20) >= 1 else -1))
alpha22 = -1 * (delta(correlation(high, volume, 5), 5) * rank(ts_std(close, 20)))
alpha23 = -1 * delta(high, 2) if mean(high, 20) < high else 0
alpha24 = -1 * (close - ts_min(close, 100)) if delta(mean(close, 100), 100) / delay(close, 100) <= 0.05 else -1 * delta(close, 3)
alpha25 = rank(((-1 * ret) * adv(20)) * vwap * (high - close))
alpha26 = -1 * ts_max(correlation(ts_rank(volume, 5), ts_rank(high, 5), 5), 3)
alpha27 = -1 if 0.5 < rank(mean(correlation(rank(volume), rank(vwap), 6), 2)) else 1
alpha28 = scale(correlation(adv(20), low, 5) + mid - close)
inner = rank(rank(-1 * rank(delta(close - 1, 5))))
alpha29 = ts_min(product(rank(rank(scale(log(ts_sum(ts_min(inner, 2), 1))))), 1), 5) + ts_rank(delay(-1 * ret, 6), 5)
signs = sign(close - delay(close, 1)) + sign(delay(close, 1) - delay(close, 2)) + sign(delay(close, 2) - delay(close, 3))
alpha30 = ((1 - rank(signs)) * ts_sum(volume, 5)) / ts_sum(volume, 20)
alpha31 = rank(rank(rank(decay_linear(-1 * rank(rank(delta(close, 10))), 10)))) + rank(-1 * delta(close, 3)) + sign(scale(correlation(adv(20), low, 12)))
alpha32 = scale(mean(close, 7) - close) + 20 * scale(correlation(vwap, delay(close, 5), 230))
alpha33 = rank(-1 * power(1 - open / close, 1))
alpha34 = rank((1 - rank(ts_std(ret, 2) / ts_std(ret, 5))) + (1 - rank(d1)))
alpha35 = (ts_rank(volume, 32) * (1 - ts_rank((close + high) - low, 16))) * (1 - ts_rank(ret, 32))
alpha36 = 2.21 * rank(correlation(close - open, delay(volume, 1), 15)) + 0.7 * rank(open - close) + 0.73 * rank(ts_rank(delay(-1 * ret, 6), 5)) + rank(abs(correlation(vwap, adv(20), 6))) + 0.6 * rank((mean(close, 200) - open) * (close - open))
alpha37 = rank(correlation(delay(open - close, 1), close, 200)) + rank(open - close)
alpha38 = (-1 * rank(ts_rank(close, 10))) * rank(close / open)
alpha39 = (-1 * rank(delta(close, 7) * (1 - rank(decay_linear(volume / adv(20), 9))))) * (1 + rank(ts_sum(ret, 250)))
alpha40 = (-1 * rank(ts_std(high, 10))) * correlation(high, volume, 10)
alpha41 = power(high * low, 0.5) - vwap
alpha42 = rank(vwap - close) / rank(vwap + close)
alpha43 = ts_rank(volume / adv(20), 20) * ts_rank(-1 * delta(close, 7), 8)
alpha44 = -1 * correlation(high, rank(volume), 5)
alpha45 = -1 * ((rank(mean(delay(close, 5), 20)) * correlation(close, volume, 2)) * rank(correlation(ts_sum(close, 5), ts_sum(close, 20), 2)))
alpha46 = -1 if 0.25 < trend else (1 if trend < 0 else -1 * (close - delay(close, 1)))
alpha47 = (((rank(1 / close) * volume) / adv(20)) * ((high * rank(high - close)) / mean(high, 5))) - rank(vwap - delay(vwap, 5))
alpha48 = group_neutralize((correlation(d1, delta(delay(close, 1), 1), 250) * d1) / close, subindustry) / ts_sum(power(d1 / delay(close, 1), 2), 250)
alpha49 = 1 if trend < -0.1 else -1 * (close - delay(close, 1))
alpha50 = -1 * ts_max(rank(correlation(rank(volume), rank(vwap), 5)), 5)
alpha51 = 1 if trend < -0.05 else -1 * (close - delay(close, 1))
alpha52 = ((-1 * ts_min(low, 5) + delay(ts_min(low, 5), 5)) * rank((ts_sum(ret, 240) - ts_sum(ret, 20)) / 220)) * ts_rank(volume, 5)
alpha53 = -1 * delta(((close - low) - (high - close)) / (close - low), 9)
alpha54 = (-1 * ((low - close) * power(open, 5))) / ((low - high) * power(close, 5))
alpha55 = -1 * correlation(rank((close - ts_min(low, 12)) / (ts_max(high, 12) - ts_min(low, 12))), rank(volume), 6)
alpha56 = -1 * (rank(ts_sum(ret, 10) / ts_sum(ts_sum(ret, 2), 3)) * rank(ret * cap))
alpha57 = -1 * ((close - vwap) / decay_linear(rank(ts_argmax(close, 30)), 2))
alpha58 = -1 * ts_rank(decay_linear(correlation(group_neutralize(vwap, sector), volume, 3), 7), 5)
alpha59 = -1 * ts_rank(decay_linear(correlation(group_neutralize(vwap, industry), volume, 4), 16), 8)
alpha60 = -1 * (2 * scale(rank((((close - low) - (high - close)) / (high - low)) * volume)) - scale(rank(ts_argmax(close, 10))))
alpha61 = rank(vwap - ts_min(vwap, 16)) < rank(correlation(vwap, adv(180), 17))
alpha62 = -1 * (rank(correlation(vwap, ts_sum(adv(20), 22), 9)) < rank(rank(open) + rank(open) < rank(mid) + rank(high)))
alpha63 = (rank(decay_linear(delta(group_neutralize(close, industry), 2), 8)) - rank(decay_linear(correlation(blend(vwap, open, 0.318108), ts_sum(adv(180), 37), 13), 12))) * -1
alpha64 = -1 * (rank(correlation(ts_sum(blend(open, low, 0.178404), 12), ts_sum(adv(120), 12), 16)) < rank(delta(blend(mid, vwap, 0.178404), 3)))
alpha65 = -1 * (rank(correlation(blend(open, vwap, 0.00817205), ts_sum(adv(60), 8), 6)) < rank(open - ts_min(open, 13)))
alpha66 = (rank(decay_linear(delta(vwap, 3), 7)) + ts_rank(decay_linear((low - vwap) / (open - mid), 11), 6)) * -1
alpha67 = power(rank(high - ts_min(high, 2)), rank(correlation(group_neutralize(vwap, sector), group_neutralize(adv(20), subindustry), 6))) * -1
alpha68 = -1 * (ts_rank(correlation(rank(high), rank(adv(15)), 8), 13) < rank(delta(blend(close, low, 0.518371), 1)))
alpha69 = power(rank(ts_max(delta(group_neutralize(vwap, industry), 2), 4)), ts_rank(correlation(blend(close, vwap, 0.490655), adv(20), 4), 9)) * -1
alpha70 = power(rank(delta(vwap, 1)), ts_rank(correlation(group_neutralize(close, industry), adv(50), 17), 17)) * -1
alpha71 = max(ts_rank(decay_linear(correlation(ts_rank(close, 3), ts_rank(adv(180), 12), 18), 4), 15), ts_rank(decay_linear(power(rank((low + open) - (vwap + vwap)), 2), 16), 4))
alpha72 = rank(decay_linear(correlation(mid, adv(40), 8), 10)) / rank(decay_linear(correlation(ts_rank(vwap, 3), ts_rank(volume, 18), 6), 2))
alpha73 = max(rank(decay_linear(delta(vwap, 4), 2)), ts_rank(decay_linear((delta(blend(open, low, 0.147155), 2) / blend(open, low, 0.147155)) * -1, 3), 16)) * -1
alpha74 = -1 * (rank(correlation(close, ts_sum(adv(30), 37), 15)) < rank(correlation(rank(blend(high, vwap, 0.0261661)), rank(volume), 11)))
alpha75 = rank(correlation(vwap, volume, 4)) < rank(correlation(rank(low), rank(adv(50)), 12))
alpha76 = max(rank(decay_linear(delta(vwap, 1), 11)), ts_rank(decay_linear(ts_rank(correlation(group_neutralize(low, sector), adv(81), 8), 19), 17), 19)) * -1
alpha77 = min(rank(decay_linear((mid + high) - (vwap + high), 20)), rank(decay_linear(correlation(mid, adv(40), 3), 5)))
alpha78 = power(rank(correlation(ts_sum(blend(low, vwap, 0.352233), 19), ts_sum(adv(40), 19), 6)), rank(correlation(rank(vwap), rank(volume), 5)))
alpha79 = rank(delta(group_neutralize(blend(close, open, 0.60733), sector), 1)) < rank(correlation(ts_rank(vwap, 3), ts_rank(adv(150), 9), 14))
alpha80 = power(rank(sign(delta(group_neutralize(blend(open, high, 0.868128), industry), 4))), ts_rank(correlation(high, adv(10), 5), 5)) * -1
alpha81 = -1 * (rank(log(product(rank(power(rank(correlation(vwap, ts_sum(adv(10), 49), 8)), 4)), 14))) < rank(correlation(rank(vwap), rank(volume), 5)))
alpha82 = min(rank(decay_linear(delta(open, 1), 14)), ts_rank(decay_linear(correlation(group_neutralize(volume, sector), open, 17), 6), 13)) * -1
alpha83 = (rank(delay((high - low) / mean(close, 5), 2)) * rank(rank(volume))) / (((high - low) / mean(close, 5)) / (vwap - close))
alpha84 = signed_power(ts_rank(vwap - ts_max(vwap, 15), 20), delta(close, 4))
alpha85 = power(rank(correlation(blend(high, close, 0.876703), adv(30), 9)), rank(correlation(ts_rank(mid, 3), ts_rank(volume, 10), 7)))
alpha86 = -1 * (ts_rank(correlation(close, ts_sum(adv(20), 14), 6), 20) < rank((open + close) - (vwap + open)))
alpha87 = max(rank(decay_linear(delta(blend(close, vwap, 0.369701), 1), 2)), ts_rank(decay_linear(abs(correlation(group_neutralize(adv(81), industry), close, 13)), 4), 14)) * -1
alpha88 = min(rank(decay_linear((rank(open) + rank(low)) - (rank(high) + rank(close)), 8)), ts_rank(decay_linear(correlation(ts_rank(close, 8), ts_rank(adv(60), 20), 8), 6), 2))
alpha89 = ts_rank(decay_linear(correlation(low, adv(10), 6), 5), 3) - ts_rank(decay_linear(delta(group_neutralize(vwap, industry), 3), 10), 15)
alpha90 = power(rank(close - ts_max(close, 4)), ts_rank(correlation(group_neutralize(adv(40), subindustry), low, 5), 3)) * -1
alpha91 = (ts_rank(decay_linear(decay_linear(correlation(group_neutralize(close, industry), volume, 9), 16), 3), 4) - rank(decay_linear(correlation(vwap, adv(30), 4), 2))) * -1
alpha92 = min(ts_rank(decay_linear(mid + close < low + open, 14), 18), ts_rank(decay_linear(correlation(rank(low), rank(adv(30)), 7), 6), 6))
alpha93 = ts_rank(decay_linear(correlation(group_neutralize(vwap, industry), adv(81), 17), 19), 7) / rank(decay_linear(delta(blend(close, vwap, 0.524434), 2), 16))
alpha94 = power(rank(vwap - ts_min(vwap, 11)), ts_rank(correlation(ts_rank(vwap, 19), ts_rank(adv(60), 4), 18), 2)) * -1
alpha95 = rank(open - ts_min(open, 12)) < ts_rank(power(rank(correlation(ts_sum(mid, 19), ts_sum(adv(40), 19), 12)), 5), 11)
alpha96 = max(ts_rank(decay_linear(correlation(rank(vwap), rank(volume), 3), 4), 8), ts_rank(decay_linear(ts_argmax(correlation(ts_rank(close, 7), ts_rank(adv(60), 4), 3), 12), 14), 13)) * -1
alpha97 = (rank(decay_linear(delta(group_neutralize(blend(low, vwap, 0.721001), industry), 3), 20)) - ts_rank(decay_linear(ts_rank(correlation(ts_rank(low, 7), ts_rank(adv(60), 17), 4), 18), 15), 6)) * -1
alpha98 = rank(decay_linear(correlation(vwap, ts_sum(adv(5), 26), 4), 7)) - rank(decay_linear(ts_rank(ts_argmin(correlation(rank(open), rank(adv(15)), 20), 8), 6), 8))
alpha99 = -1 * (rank(correlation(ts_sum(mid, 19), ts_sum(adv(60), 19), 8)) < rank(correlation(low, volume, 6)))
position = (((close - low) - (high - close)) / (high - low)) * volume
alpha100 = -1 * ((1.5 * scale(group_neutralize(group_neutralize(rank(position), subindustry), subindustry)) - scale(group_neutralize(correlation(close, rank(adv(20)), 5) - rank(ts_argmin(close, 30)), subindustry))) * (volume / adv(20)))
alpha101 = (close - open) / (high - low + 0.001)
"""


@cache
def library() -> dict[str, Expr]:
    return read_sheet(FORMULAS, "alpha")
