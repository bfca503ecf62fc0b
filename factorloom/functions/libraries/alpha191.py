"""The 191 short-horizon price-volume factors."""

from __future__ import annotations

from functools import cache

from ..expr import Expr
from ..formula import read_sheet

#: The published formulas.
FORMULAS = """
prev = delay(close, 1)
ret = close / prev - 1
up = close - prev
mid = (high + low) / 2
typical = (high + low + close) / 3
amount = volume * vwap
place = ((close - low) - (high - close)) / (high - low)
gain = max(0, up)
before = delay(open, 1)
dtm = 0 if open <= before else max(high - open, open - before)
dbm = 0 if open >= before else max(open - low, open - before)
hd = high - delay(high, 1)
ld = delay(low, 1) - low
tr = max(max(high - low, abs(high - prev)), abs(low - prev))
gtja_alpha001 = -1 * correlation(rank(delta(log(volume), 1)), rank((close - open) / open), 6)
gtja_alpha002 = -1 * delta(place, 1)
reach = 0 if close == prev else close - (min(low, prev) if close > prev else max(high, prev))
gtja_alpha003 = ts_sum(reach, 6)
gtja_alpha004 = -1 if ts_sum(close, 8) / 8 + ts_std(close, 8) < ts_sum(close, 2) / 2 else (1 if ts_sum(close, 2) / 2 < ts_sum(close, 8) / 8 - ts_std(close, 8) else (1 if (1 < volume / ts_mean(volume, 20)) or (volume / ts_mean(volume, 20) == 1) else -1))
gtja_alpha005 = -1 * ts_max(correlation(ts_rank(volume, 5), ts_rank(high, 5), 5), 3)
gtja_alpha006 = rank(sign(delta(open * 0.85 + high * 0.15, 4))) * -1
gtja_alpha007 = (rank(ts_max(vwap - close, 3)) + rank(ts_min(vwap - close, 3))) * rank(delta(volume, 3))
gtja_alpha008 = rank(delta(mid * 0.2 + vwap * 0.8, 4) * -1)
motion = ((mid - (delay(high, 1) + delay(low, 1)) / 2) * (high - low)) / volume
gtja_alpha009 = sma(motion, 7, 2)
gtja_alpha010 = rank(ts_max(power(ts_std(ret, 20) if ret < 0 else close, 2), 5))
gtja_alpha011 = ts_sum(place * volume, 6)
gtja_alpha012 = rank(open - ts_sum(vwap, 10) / 10) * (-1 * rank(abs(close - vwap)))
gtja_alpha013 = power(high * low, 0.5) - vwap
gtja_alpha014 = close - delay(close, 5)
gtja_alpha015 = open / prev - 1
gtja_alpha016 = -1 * ts_max(rank(correlation(rank(volume), rank(vwap), 5)), 5)
gtja_alpha017 = power(rank(vwap - ts_max(vwap, 15)), delta(close, 5))
gtja_alpha018 = close / delay(close, 5)
gtja_alpha019 = (close - delay(close, 5)) / delay(close, 5) if close < delay(close, 5) else (0 if close == delay(close, 5) else (close - delay(close, 5)) / close)
gtja_alpha020 = ((close - delay(close, 6)) / delay(close, 6)) * 100
gtja_alpha021 = slope(ts_mean(close, 6), 6)
off6 = (close - ts_mean(close, 6)) / ts_mean(close, 6)
gtja_alpha022 = sma(off6 - delay(off6, 3), 12, 1)
rising = sma(ts_std(close, 20) if close > prev else 0, 20, 1)
falling = sma(ts_std(close, 20) if close <= prev else 0, 20, 1)
gtja_alpha023 = (rising / (rising + falling)) * 100
gtja_alpha024 = sma(close - delay(close, 5), 5, 1)
gtja_alpha025 = (-1 * rank(delta(close, 7) * (1 - rank(decay_linear(volume / ts_mean(volume, 20), 9))))) * (1 + rank(ts_sum(ret, 250)))
gtja_alpha026 = (ts_sum(close, 7) / 7 - close) + correlation(vwap, delay(close, 5), 230)
gtja_alpha027 = wma(((close - delay(close, 3)) / delay(close, 3)) * 100 + ((close - delay(close, 6)) / delay(close, 6)) * 100, 12)
rsv9 = ((close - ts_min(low, 9)) / (ts_max(high, 9) - ts_min(low, 9))) * 100
gtja_alpha028 = 3 * sma(rsv9, 3, 1) - 2 * sma(sma(((close - ts_min(low, 9)) / (ts_max(high, 9) - ts_max(low, 9))) * 100, 3, 1), 3, 1)
gtja_alpha029 = ((close - delay(close, 6)) / delay(close, 6)) * volume
gtja_alpha030 = wma(power(multi_resi(ret, mkt, smb, hml, 60), 2), 20)
gtja_alpha031 = ((close - ts_mean(close, 12)) / ts_mean(close, 12)) * 100
gtja_alpha032 = -1 * ts_sum(rank(correlation(rank(high), rank(volume), 3)), 3)
gtja_alpha033 = ((-1 * ts_min(low, 5) + delay(ts_min(low, 5), 5)) * rank((ts_sum(ret, 240) - ts_sum(ret, 20)) / 220)) * ts_rank(volume, 5)
gtja_alpha034 = ts_mean(close, 12) / close
gtja_alpha035 = min(rank(decay_linear(delta(open, 1), 15)), rank(decay_linear(correlation(volume, open * 0.65 + open * 0.35, 17), 7))) * -1
gtja_alpha036 = rank(ts_sum(correlation(rank(volume), rank(vwap), 6), 2))
sums = ts_sum(open, 5) * ts_sum(ret, 5)
gtja_alpha037 = -1 * rank(sums - delay(sums, 10))
gtja_alpha038 = -1 * delta(high, 2) if ts_sum(high, 20) / 20 < high else 0
gtja_alpha039 = (rank(decay_linear(delta(close, 2), 8)) - rank(decay_linear(correlation(vwap * 0.3 + open * 0.7, ts_sum(ts_mean(volume, 180), 37), 14), 12))) * -1
gtja_alpha040 = (ts_sum(volume if close > prev else 0, 26) / ts_sum(volume if close <= prev else 0, 26)) * 100
gtja_alpha041 = rank(ts_max(delta(vwap, 3), 5)) * -1
gtja_alpha042 = (-1 * rank(ts_std(high, 10))) * correlation(high, volume, 10)
flow = volume if close > prev else (-volume if close < prev else 0)
gtja_alpha043 = ts_sum(flow, 6)
gtja_alpha044 = ts_rank(decay_linear(correlation(low, ts_mean(volume, 10), 7), 6), 4) + ts_rank(decay_linear(delta(vwap, 3), 10), 15)
gtja_alpha045 = rank(delta(close * 0.6 + open * 0.4, 1)) * rank(correlation(vwap, ts_mean(volume, 150), 15))
gtja_alpha046 = (ts_mean(close, 3) + ts_mean(close, 6) + ts_mean(close, 12) + ts_mean(close, 24)) / (4 * close)
gap6 = ((ts_max(high, 6) - close) / (ts_max(high, 6) - ts_min(low, 6))) * 100
gtja_alpha047 = sma(gap6, 9, 1)
gtja_alpha048 = (-1 * (rank(sign(close - prev) + sign(prev - delay(close, 2)) + sign(delay(close, 2) - delay(close, 3))) * ts_sum(volume, 5))) / ts_sum(volume, 20)
swing = max(abs(high - delay(high, 1)), abs(low - delay(low, 1)))
down12 = ts_sum(0 if high + low >= delay(high, 1) + delay(low, 1) else swing, 12)
up12 = ts_sum(0 if high + low <= delay(high, 1) + delay(low, 1) else swing, 12)
gtja_alpha049 = down12 / (down12 + up12)
gtja_alpha050 = up12 / (up12 + down12) - down12 / (down12 + up12)
gtja_alpha051 = up12 / (up12 + down12)
gtja_alpha052 = (ts_sum(max(0, high - delay(typical, 1)), 26) / ts_sum(max(0, delay(typical, 1) - low), 26)) * 100
gtja_alpha053 = (ts_sum(close > prev, 12) / 12) * 100
gtja_alpha054 = -1 * rank((ts_std(abs(close - open), 10) + (close - open)) + correlation(close, open, 10))
hc = abs(high - prev)
lc = abs(low - prev)
hl = abs(high - delay(low, 1))
co = abs(prev - before) / 4
body = 16 * ((((close - prev) + (close - open) / 2) + prev) - before)
true = (hc + lc / 2) + co if (hc > lc) and (hc > hl) else ((lc + hc / 2) + co if (lc > hl) and (lc > hc) else hl + co)
strength = (body / true) * max(hc, lc)
gtja_alpha055 = ts_sum(strength, 20)
gtja_alpha056 = rank(open - ts_min(open, 12)) < rank(power(rank(correlation(ts_sum(mid, 19), ts_sum(ts_mean(volume, 40), 19), 13)), 5))
gtja_alpha057 = sma(rsv9, 3, 1)
gtja_alpha058 = (ts_sum(close > prev, 20) / 20) * 100
gtja_alpha059 = ts_sum(reach, 20)
gtja_alpha060 = ts_sum(place * volume, 20)
gtja_alpha061 = max(rank(decay_linear(delta(vwap, 1), 12)), rank(decay_linear(rank(correlation(low, ts_mean(volume, 80), 8)), 17))) * -1
gtja_alpha062 = -1 * correlation(high, rank(volume), 5)
gtja_alpha063 = (sma(gain, 6, 1) / sma(abs(up), 6, 1)) * 100
gtja_alpha064 = max(rank(decay_linear(correlation(rank(vwap), rank(volume), 4), 4)), rank(decay_linear(ts_max(correlation(rank(close), rank(ts_mean(volume, 60)), 4), 13), 14))) * -1
gtja_alpha065 = ts_mean(close, 6) / close
gtja_alpha066 = off6 * 100
gtja_alpha067 = (sma(gain, 24, 1) / sma(abs(up), 24, 1)) * 100
gtja_alpha068 = sma(motion, 15, 2)
st = ts_sum(dtm, 20)
sb = ts_sum(dbm, 20)
gtja_alpha069 = (st - sb) / st if st > sb else (0 if st == sb else (st - sb) / sb)
gtja_alpha070 = ts_std(amount, 6)
gtja_alpha071 = ((close - ts_mean(close, 24)) / ts_mean(close, 24)) * 100
gtja_alpha072 = sma(gap6, 15, 1)
gtja_alpha073 = (ts_rank(decay_linear(decay_linear(correlation(close, volume, 10), 16), 4), 5) - rank(decay_linear(correlation(vwap, ts_mean(volume, 30), 4), 3))) * -1
gtja_alpha074 = rank(correlation(ts_sum(low * 0.35 + vwap * 0.65, 20), ts_sum(ts_mean(volume, 40), 20), 7)) + rank(correlation(rank(vwap), rank(volume), 6))
gtja_alpha075 = ts_sum((close > open) and (index_close < index_open), 50) / ts_sum(index_close < index_open, 50)
gtja_alpha076 = ts_std(abs(ret) / volume, 20) / ts_mean(abs(ret) / volume, 20)
gtja_alpha077 = min(rank(decay_linear((mid + high) - (vwap + high), 20)), rank(decay_linear(correlation(mid, ts_mean(volume, 40), 3), 6)))
gtja_alpha078 = (typical - ts_mean(typical, 12)) / (0.015 * ts_mean(abs(close - ts_mean(typical, 12)), 12))
rsi12 = (sma(gain, 12, 1) / sma(abs(up), 12, 1)) * 100
gtja_alpha079 = rsi12
gtja_alpha080 = ((volume - delay(volume, 5)) / delay(volume, 5)) * 100
gtja_alpha081 = sma(volume, 21, 2)
gtja_alpha082 = sma(gap6, 20, 1)
gtja_alpha083 = -1 * rank(covariance(rank(high), rank(volume), 5))
gtja_alpha084 = ts_sum(flow, 20)
gtja_alpha085 = ts_rank(volume / ts_mean(volume, 20), 20) * ts_rank(-1 * delta(close, 7), 8)
trend = (delay(close, 20) - delay(close, 10)) / 10 - (delay(close, 10) - close) / 10
gtja_alpha086 = -1 if 0.25 < trend else (1 if trend < 0 else -1 * (close - prev))
gtja_alpha087 = (rank(decay_linear(delta(vwap, 4), 7)) + ts_rank(decay_linear(((low * 0.9 + low * 0.1) - vwap) / (open - mid), 11), 7)) * -1
gtja_alpha088 = ((close - delay(close, 20)) / delay(close, 20)) * 100
cross = sma(close, 13, 2) - sma(close, 27, 2)
gtja_alpha089 = 2 * (cross - sma(cross, 10, 2))
gtja_alpha090 = rank(correlation(rank(vwap), rank(volume), 5)) * -1
gtja_alpha091 = (rank(close - ts_max(close, 5)) * rank(correlation(ts_mean(volume, 40), low, 5))) * -1
gtja_alpha092 = max(rank(decay_linear(delta(close * 0.35 + vwap * 0.65, 2), 3)), ts_rank(decay_linear(abs(correlation(ts_mean(volume, 180), close, 13)), 5), 15)) * -1
gtja_alpha093 = ts_sum(0 if open >= before else max(open - low, open - before), 20)
gtja_alpha094 = ts_sum(flow, 30)
gtja_alpha095 = ts_std(amount, 20)
gtja_alpha096 = sma(sma(rsv9, 3, 1), 3, 1)
gtja_alpha097 = ts_std(volume, 10)
drift = delta(ts_sum(close, 100) / 100, 100) / delay(close, 100)
gtja_alpha098 = -1 * (close - ts_min(close, 100)) if (drift < 0.05) or (drift == 0.05) else -1 * delta(close, 3)
gtja_alpha099 = -1 * rank(covariance(rank(close), rank(volume), 5))
gtja_alpha100 = ts_std(volume, 20)
gtja_alpha101 = (rank(correlation(close, ts_sum(ts_mean(volume, 30), 37), 15)) < rank(correlation(rank(high * 0.1 + vwap * 0.9), rank(volume), 11))) * -1
vup = volume - delay(volume, 1)
gtja_alpha102 = (sma(max(0, vup), 6, 1) / sma(abs(vup), 6, 1)) * 100
low20 = ((20 - (19 - ts_argmin(low, 20))) / 20) * 100
high20 = ((20 - (19 - ts_argmax(high, 20))) / 20) * 100
gtja_alpha103 = low20
gtja_alpha104 = -1 * (delta(correlation(high, volume, 5), 5) * rank(ts_std(close, 20)))
gtja_alpha105 = -1 * correlation(rank(open), rank(volume), 10)
gtja_alpha106 = close - delay(close, 20)
gtja_alpha107 = ((-1 * rank(open - delay(high, 1))) * rank(open - prev)) * rank(open - delay(low, 1))
gtja_alpha108 = power(rank(high - ts_min(high, 2)), rank(correlation(vwap, ts_mean(volume, 120), 6))) * -1
gtja_alpha109 = sma(high - low, 10, 2) / sma(sma(high - low, 10, 2), 10, 2)
gtja_alpha110 = (ts_sum(max(0, high - prev), 20) / ts_sum(max(0, prev - low), 20)) * 100
push = (volume * ((close - low) - (high - close))) / (high - low)
gtja_alpha111 = sma(push, 11, 2) - sma(push, 4, 2)
gains = ts_sum(up if up > 0 else 0, 12)
losses = ts_sum(abs(up) if up < 0 else 0, 12)
gtja_alpha112 = ((gains - losses) / (gains + losses)) * 100
gtja_alpha113 = -1 * ((rank(ts_sum(delay(close, 5), 20) / 20) * correlation(close, volume, 2)) * rank(correlation(ts_sum(close, 5), ts_sum(close, 20), 2)))
range5 = (high - low) / (ts_sum(close, 5) / 5)
gtja_alpha114 = (rank(delay(range5, 2)) * rank(rank(volume))) / (range5 / (vwap - close))
gtja_alpha115 = power(rank(correlation(high * 0.9 + close * 0.1, ts_mean(volume, 30), 10)), rank(correlation(ts_rank(mid, 4), ts_rank(volume, 10), 7)))
gtja_alpha116 = slope(close, 20)
gtja_alpha117 = (ts_rank(volume, 32) * (1 - ts_rank((close + high) - low, 16))) * (1 - ts_rank(ret, 32))
gtja_alpha118 = (ts_sum(high - open, 20) / ts_sum(open - low, 20)) * 100
gtja_alpha119 = rank(decay_linear(correlation(vwap, ts_sum(ts_mean(volume, 5), 26), 5), 7)) - rank(decay_linear(ts_rank(ts_min(correlation(rank(open), rank(ts_mean(volume, 15)), 21), 9), 7), 8))
gtja_alpha120 = rank(vwap - close) / rank(vwap + close)
gtja_alpha121 = power(rank(vwap - ts_min(vwap, 12)), ts_rank(correlation(ts_rank(vwap, 20), ts_rank(ts_mean(volume, 60), 2), 18), 3)) * -1
triple = sma(sma(sma(log(close), 13, 2), 13, 2), 13, 2)
gtja_alpha122 = (triple - delay(triple, 1)) / delay(triple, 1)
gtja_alpha123 = (rank(correlation(ts_sum(mid, 20), ts_sum(ts_mean(volume, 60), 20), 9)) < rank(correlation(low, volume, 6))) * -1
gtja_alpha124 = (close - vwap) / decay_linear(rank(ts_max(close, 30)), 2)
gtja_alpha125 = rank(decay_linear(correlation(vwap, ts_mean(volume, 80), 17), 20)) / rank(decay_linear(delta(close * 0.5 + vwap * 0.5, 3), 16))
gtja_alpha126 = ((close + high) + low) / 3
gtja_alpha127 = power(ts_mean(power((100 * (close - ts_max(close, 12))) / ts_max(close, 12), 2), 12), 0.5)
gtja_alpha128 = 100 - 100 / (1 + ts_sum(typical * volume if typical > delay(typical, 1) else 0, 14) / ts_sum(typical * volume if typical < delay(typical, 1) else 0, 14))
gtja_alpha129 = losses
gtja_alpha130 = rank(decay_linear(correlation(mid, ts_mean(volume, 40), 9), 10)) / rank(decay_linear(correlation(rank(vwap), rank(volume), 7), 3))
gtja_alpha131 = power(rank(delta(vwap, 1)), ts_rank(correlation(close, ts_mean(volume, 50), 18), 18))
gtja_alpha132 = ts_mean(amount, 20)
gtja_alpha133 = high20 - low20
gtja_alpha134 = ((close - delay(close, 12)) / delay(close, 12)) * volume
gtja_alpha135 = sma(delay(close / delay(close, 20), 1), 20, 1)
gtja_alpha136 = (-1 * rank(delta(ret, 3))) * correlation(open, volume, 10)
gtja_alpha137 = strength
gtja_alpha138 = (rank(decay_linear(delta(low * 0.7 + vwap * 0.3, 3), 20)) - ts_rank(decay_linear(ts_rank(correlation(ts_rank(low, 8), ts_rank(ts_mean(volume, 60), 17), 5), 19), 16), 7)) * -1
gtja_alpha139 = -1 * correlation(open, volume, 10)
gtja_alpha140 = min(rank(decay_linear((rank(open) + rank(low)) - (rank(high) + rank(close)), 8)), ts_rank(decay_linear(correlation(ts_rank(close, 8), ts_rank(ts_mean(volume, 60), 20), 8), 7), 3))
gtja_alpha141 = rank(correlation(rank(high), rank(ts_mean(volume, 15)), 9)) * -1
gtja_alpha142 = ((-1 * rank(ts_rank(close, 10))) * rank(delta(delta(close, 1), 1))) * rank(ts_rank(volume / ts_mean(volume, 20), 5))
gtja_alpha143 = scan_mul(up / prev, close > prev)
gtja_alpha144 = ts_sum(abs(ret) / amount if close < prev else 0, 20) / ts_sum(close < prev, 20)
gtja_alpha145 = ((ts_mean(volume, 9) - ts_mean(volume, 26)) / ts_mean(volume, 12)) * 100
pace = up / prev
rest = pace - sma(pace, 61, 2)
gtja_alpha146 = (ts_mean(rest, 20) * rest) / sma(power(pace - rest, 2), 60, 1)
gtja_alpha147 = slope(ts_mean(close, 12), 12)
gtja_alpha148 = (rank(correlation(open, ts_sum(ts_mean(volume, 60), 9), 6)) < rank(open - ts_min(open, 14))) * -1
gtja_alpha149 = conditional_beta(ret, index_close / delay(index_close, 1) - 1, index_close < delay(index_close, 1), 252)
gtja_alpha150 = (((close + high) + low) / 3) * volume
gtja_alpha151 = sma(close - delay(close, 20), 20, 1)
slow9 = delay(sma(delay(close / delay(close, 9), 1), 9, 1), 1)
gtja_alpha152 = sma(ts_mean(slow9, 12) - ts_mean(slow9, 26), 9, 1)
gtja_alpha153 = (ts_mean(close, 3) + ts_mean(close, 6) + ts_mean(close, 12) + ts_mean(close, 24)) / 4
gtja_alpha154 = vwap - ts_min(vwap, 16) < correlation(vwap, ts_mean(volume, 180), 18)
vcross = sma(volume, 13, 2) - sma(volume, 27, 2)
gtja_alpha155 = vcross - sma(vcross, 10, 2)
gtja_alpha156 = max(rank(decay_linear(delta(vwap, 5), 3)), rank(decay_linear((delta(open * 0.15 + low * 0.85, 2) / (open * 0.15 + low * 0.85)) * -1, 3))) * -1
gtja_alpha157 = ts_min(product(rank(rank(log(ts_sum(ts_min(rank(rank(-1 * rank(delta(close - 1, 5)))), 2), 1)))), 1), 5) + ts_rank(delay(-1 * ret, 6), 5)
gtja_alpha158 = ((high - sma(close, 15, 2)) - (low - sma(close, 15, 2))) / close
floor = min(low, prev)
width = max(high, prev) - min(low, prev)
gtja_alpha159 = (((((close - ts_sum(floor, 6)) / ts_sum(width, 6)) * 12) * 24 + (((close - ts_sum(floor, 12)) / ts_sum(width, 12)) * 6) * 24 + (((close - ts_sum(floor, 24)) / ts_sum(width, 24)) * 6) * 24) * 100) / (6 * 12 + 6 * 24 + 12 * 24)
gtja_alpha160 = falling
span = max(max(high - low, abs(prev - high)), abs(prev - low))
gtja_alpha161 = ts_mean(span, 12)
gtja_alpha162 = (rsi12 - ts_min(rsi12, 12)) / (ts_max(rsi12, 12) - ts_min(rsi12, 12))
gtja_alpha163 = rank((((-1 * ret) * ts_mean(volume, 20)) * vwap) * (high - close))
inverse = 1 / (close - prev) if close > prev else 1
gtja_alpha164 = sma(((inverse - ts_min(inverse, 12)) / (high - low)) * 100, 13, 2)
gtja_alpha165 = ts_max(ts_sum(close - ts_mean(close, 48), 48), 48) - ts_min(ts_sum(close - ts_mean(close, 48), 48), 48) / ts_std(close, 48)
gtja_alpha166 = ((-20 * power(20 - 1, 1.5)) * ts_sum(ret - ts_mean(ret, 20), 20)) / power(((20 - 1) * (20 - 2)) * power(ts_sum(close / prev, 20), 2), 1.5)
gtja_alpha167 = gains
gtja_alpha168 = (-1 * volume) / ts_mean(volume, 20)
late = delay(sma(up, 9, 1), 1)
gtja_alpha169 = sma(ts_mean(late, 12) - ts_mean(late, 26), 10, 1)
gtja_alpha170 = (((rank(1 / close) * volume) / ts_mean(volume, 20)) * ((high * rank(high - close)) / (ts_sum(high, 5) / 5))) - rank(vwap - delay(vwap, 5))
gtja_alpha171 = (-1 * ((low - close) * power(open, 5))) / ((close - high) * power(close, 5))
minus = (ts_sum(ld if (ld > 0) and (ld > hd) else 0, 14) * 100) / ts_sum(tr, 14)
plus = (ts_sum(hd if (hd > 0) and (hd > ld) else 0, 14) * 100) / ts_sum(tr, 14)
adx = ts_mean((abs(minus - plus) / (minus + plus)) * 100, 6)
gtja_alpha172 = adx
gtja_alpha173 = (3 * sma(close, 13, 2) - 2 * sma(sma(close, 13, 2), 13, 2)) + triple
gtja_alpha174 = rising
gtja_alpha175 = ts_mean(span, 6)
gtja_alpha176 = correlation(rank((close - ts_min(low, 12)) / (ts_max(high, 12) - ts_min(low, 12))), rank(volume), 6)
gtja_alpha177 = high20
gtja_alpha178 = pace * volume
gtja_alpha179 = rank(correlation(vwap, volume, 4)) * rank(correlation(rank(low), rank(ts_mean(volume, 50)), 12))
gtja_alpha180 = (-1 * ts_rank(abs(delta(close, 7)), 60)) * sign(delta(close, 7)) if ts_mean(volume, 20) < volume else -1 * volume
index_off = index_close - ts_mean(index_close, 20)
gtja_alpha181 = ts_sum((ret - ts_mean(ret, 20)) - power(index_off, 2), 20) / ts_sum(power(index_off, 3), 20)
gtja_alpha182 = ts_sum(((close > open) and (index_close > index_open)) or ((close < open) and (index_close < index_open)), 20) / 20
gtja_alpha183 = ts_max(ts_sum(close - ts_mean(close, 24), 24), 24) - ts_min(ts_sum(close - ts_mean(close, 24), 24), 24) / ts_std(close, 24)
gtja_alpha184 = rank(correlation(delay(open - close, 1), close, 200)) + rank(open - close)
gtja_alpha185 = rank(-1 * power(1 - open / close, 2))
gtja_alpha186 = (adx + delay(adx, 6)) / 2
gtja_alpha187 = ts_sum(0 if open <= before else max(high - open, open - before), 20)
gtja_alpha188 = (((high - low) - sma(high - low, 11, 2)) / sma(high - low, 11, 2)) * 100
gtja_alpha189 = ts_mean(abs(close - ts_mean(close, 6)), 6)
growth = power(close / delay(close, 19), 0.05)
gtja_alpha190 = log(((ts_sum(ret > growth - 1, 20) - 1) * ts_sum(power((ret - growth) - 1, 2) if ret < growth - 1 else 0, 20)) / (ts_sum(ret < growth - 1, 20) * ts_sum(power(ret - (growth - 1), 2) if ret > growth - 1 else 0, 20)))
gtja_alpha191 = (correlation(ts_mean(volume, 20), low, 5) + mid) - close
"""


@cache
def library() -> dict[str, Expr]:
    return read_sheet(FORMULAS, "gtja_alpha")
