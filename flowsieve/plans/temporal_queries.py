"""Queries for temporal-invariant features (I)."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowsieve.operators import temporal as te
from flowsieve.plans import views as v
from flowsieve.plans.flow_queries import settle
from flowsieve.plans.registry import query, st, sts
from flowsieve.session import materialize


def _d(cond: str, expr: str, default: str = "0") -> str:
    return f"CASE WHEN {cond} THEN coalesce({expr}, {default}) ELSE {default} END"


_Q = "q AS (SELECT flow_id, count(*) AS n, quantile_cont(iat, 0.1) AS p10, quantile_cont(iat, 0.25) AS p25, quantile_cont(iat, 0.9) AS p90 FROM iat GROUP BY 1)"


@query("I01_iat_cv", f"WITH {v.IAT} SELECT flow_id, {st(_d('count(*) >= 10', 'stddev_pop(iat) / nullif(avg(iat), 0)'))} AS inter_arrival_cv FROM iat GROUP BY 1")
def i01(spark, sf):
    return settle(te.gap_rhythm(v.packets(spark, sf)).select("flow_id", "inter_arrival_cv"))


@query("I02_burst_ratio", f"WITH {v.IAT}, {_Q} SELECT flow_id, {st(_d('any_value(n) >= 10', 'avg(CAST(iat < p10 AS INTEGER))'))} AS burst_ratio FROM iat JOIN q USING (flow_id) GROUP BY 1")
def i02(spark, sf):
    return settle(te.gap_rhythm(v.packets(spark, sf)).select("flow_id", "burst_ratio"))


@query("I03_idle_ratio", f"WITH {v.IAT}, {_Q} SELECT flow_id, {st(_d('any_value(n) >= 10', 'coalesce(sum(iat) FILTER (iat > p90), 0) / nullif(sum(iat), 0)'))} AS idle_time_ratio FROM iat JOIN q USING (flow_id) GROUP BY 1")
def i03(spark, sf):
    return settle(te.gap_rhythm(v.packets(spark, sf)).select("flow_id", "idle_time_ratio"))


def _size_entropy(rel: str) -> str:
    return f"""sx AS (SELECT flow_id, min(size) AS lo, max(size) AS hi FROM {rel} GROUP BY 1),
sb AS (SELECT flow_id, CASE WHEN hi > lo THEN least(floor((size - lo) / ((hi - lo) / CAST(10 AS DOUBLE))) + 1, 10) ELSE 1 END AS b, CAST(count(*) AS DOUBLE) AS c FROM {rel} JOIN sx USING (flow_id) GROUP BY 1, 2),
sent AS (SELECT flow_id, {_d('sum(c) >= 10', 'log2(sum(c)) - sum(c * log2(c)) / sum(c)')} AS size_sequence_entropy FROM sb GROUP BY 1)"""


@query("I04_size_sequence_entropy", f"WITH {v.PACKETS}, {_size_entropy('packets')} SELECT flow_id, {st('size_sequence_entropy')} AS size_sequence_entropy FROM sent")
def i04(spark, sf):
    return settle(te.size_sequence_entropy(v.packets(spark, sf)))


@query("I04_short_flows", f"WITH {v.SHORT}, {_size_entropy('short')} SELECT flow_id, {st('size_sequence_entropy')} AS size_sequence_entropy FROM sent")
def i04b(spark, sf):
    return settle(te.size_sequence_entropy(v.short_packets(spark, sf)))


_MEM = """lg AS (SELECT flow_id, rn, size, """ + ", ".join(f"lag(size, {k}) OVER w AS l{k}" for k in range(1, 11)) + """ FROM iat WINDOW w AS (PARTITION BY flow_id ORDER BY rn)),
mem AS (SELECT flow_id, count(*) AS n, corr(size, rn) AS tr, """ + ", ".join(f"corr(size, l{k}) FILTER (l{k} IS NOT NULL) AS c{k}" for k in range(1, 11)) + " FROM lg GROUP BY 1)"
_BEST = "greatest(" + ", ".join(f"abs(CASE WHEN isnan(c{k}) THEN NULL ELSE c{k} END)" for k in range(1, 11)) + ")"


@query("I05_size_autocorrelation", f"WITH {v.IAT}, {_MEM} SELECT flow_id, {st(_d('n >= 11', _BEST))} AS size_autocorrelation FROM mem")
def i05(spark, sf):
    return settle(te.size_memory(v.packets(spark, sf)).select("flow_id", "size_autocorrelation"))


@query("I06_size_trend", f"WITH {v.IAT} SELECT flow_id, {st(_d('count(*) >= 10', 'regr_r2(size, rn)'))} AS size_trend_strength FROM iat GROUP BY 1")
def i06(spark, sf):
    return settle(te.size_memory(v.packets(spark, sf)).select("flow_id", "size_trend_strength"))


@query("I07_bidirectional_ratio", f"""WITH {v.PACKETS}, d AS (SELECT flow_id, direction, count(*) AS c FROM packets GROUP BY 1, 2)
SELECT flow_id, {st(_d('sum(c) >= 10 AND count(*) > 1', 'min(c) / max(c)'))} AS bidirectional_ratio FROM d GROUP BY 1""")
def i07(spark, sf):
    return settle(te.direction_balance(v.packets(spark, sf)).select("flow_id", "bidirectional_ratio"))


@query("I08_conversation_turns", f"""WITH {v.PACKETS}, d AS (SELECT flow_id, direction <> lag(direction) OVER (PARTITION BY flow_id ORDER BY t, pkt_id) AS ch FROM packets)
SELECT flow_id, {st(_d('count(*) >= 10', 'count(*) FILTER (ch)'))} AS conversation_turns FROM d GROUP BY 1""")
def i08(spark, sf):
    return settle(te.direction_balance(v.packets(spark, sf)).select("flow_id", "conversation_turns"))


@query("I09_dominance", f"""WITH {v.PACKETS}, d AS (SELECT flow_id, direction, count(*) AS c, sum(size) AS b FROM packets GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY flow_id ORDER BY b, direction) AS i FROM d)
SELECT flow_id, {st(_d('sum(c) >= 10', 'CASE WHEN count(*) < 2 THEN 1 WHEN sum(b) = 0 THEN 0 ELSE 2 * sum(i * b) / (count(*) * sum(b)) - (count(*) + 1) / count(*) END'))} AS dominance_score FROM r GROUP BY 1""")
def i09(spark, sf):
    return settle(te.direction_balance(v.packets(spark, sf)).select("flow_id", "dominance_score"))


GAPS = "gaps AS (SELECT flow_id, rn - 1 AS pos, iat FROM iat WHERE rn >= 2), gn AS (SELECT flow_id, count(*) AS n, avg(iat) AS mean, stddev_pop(iat) AS sd FROM gaps GROUP BY 1)"
_PEAK = """ac AS (SELECT a.flow_id, b.pos - a.pos AS lag, sum(a.iat * b.iat) AS r FROM gaps a JOIN gaps b ON a.flow_id = b.flow_id AND b.pos >= a.pos GROUP BY 1, 2),
an AS (SELECT flow_id, lag, r / first_value(r) OVER (PARTITION BY flow_id ORDER BY lag) AS v FROM ac),
pk AS (SELECT flow_id, v, lag(v) OVER w AS lo, lead(v) OVER w AS hi FROM an WHERE lag >= 1 WINDOW w AS (PARTITION BY flow_id ORDER BY lag)),
per AS (SELECT flow_id, """ + _d("any_value(n) >= 10", "max(v) FILTER (v > lo AND v > hi AND v >= 0.1)") + " AS periodicity_strength FROM pk JOIN gn USING (flow_id) GROUP BY 1)"


@query("I10_periodicity_strength", f"WITH {v.IAT}, {GAPS}, {_PEAK} SELECT flow_id, {st('periodicity_strength')} AS periodicity_strength FROM per")
def i10(spark, sf):
    return settle(te.periodic_features(v.packets(spark, sf)).select("flow_id", "periodicity_strength"))


def _apen(value: str, rel: str, eps: str, wrap: str, least: int) -> str:
    def phi(m: int) -> str:
        cond = " AND ".join(f"abs(a.x{i} - b.x{i}) <= a.r" for i in range(m))
        return f"""p{m} AS (SELECT flow_id, avg(ln(c / (n - {m - 1}) + {eps})) AS phi{m} FROM (SELECT a.flow_id, a.pos, any_value(a.n) AS n, CAST(count(*) AS DOUBLE) AS c FROM tm a JOIN tm b ON a.flow_id = b.flow_id AND {cond}
 WHERE a.x{m - 1} IS NOT NULL AND b.x{m - 1} IS NOT NULL GROUP BY 1, 2) GROUP BY 1)"""
    return f"""tm AS (SELECT flow_id, pos, {value} AS x0, lead({value}, 1) OVER w AS x1, lead({value}, 2) OVER w AS x2, 0.2 * sd AS r, n FROM {rel} JOIN (SELECT flow_id, count(*) AS n, stddev_pop({value}) AS sd FROM {rel} GROUP BY 1) USING (flow_id)
 WINDOW w AS (PARTITION BY flow_id ORDER BY pos)), {phi(2)}, {phi(3)},
apen AS (SELECT flow_id, CASE WHEN n >= {least} THEN {wrap.format('phi2 - phi3')} ELSE 0 END AS apen FROM p2 JOIN p3 USING (flow_id) JOIN (SELECT DISTINCT flow_id, n FROM tm) USING (flow_id))"""


@query("I11_rhythm_complexity", f"WITH {v.IAT}, {GAPS}, {_apen('iat', 'gaps', '0', 'greatest(0, {0})', 10)} SELECT flow_id, {st('apen')} AS rhythm_complexity FROM apen")
def i11(spark, sf):
    return settle(te.rhythm_complexity(v.packets(spark, sf)))


@query("I11_size_approximate_entropy", f"WITH {v.IAT}, sz AS (SELECT flow_id, rn AS pos, size FROM iat), {_apen('size', 'sz', '1e-10', 'abs({0})', 3)} SELECT flow_id, {st('apen')} AS size_approximate_entropy FROM apen")
def i11b(spark, sf):
    return settle(te.size_complexity(v.packets(spark, sf)))


_DFT = """ks AS (SELECT flow_id, n, mean, unnest(range(0, n // 2 + 1)) AS k FROM gn WHERE n >= 10),
df AS (SELECT flow_id, k, any_value(n) AS n, sum((iat - mean) * cos(2 * pi() * k * (pos - 1) / n)) AS re, sum((iat - mean) * sin(2 * pi() * k * (pos - 1) / n)) AS im FROM ks JOIN gaps USING (flow_id) GROUP BY 1, 2),
psd AS (SELECT flow_id, k, n, (re * re + im * im) * CASE WHEN k = 0 OR 2 * k = n THEN 1 ELSE 2 END AS p FROM df)"""


@query("I12_dominant_frequency", f"WITH {v.IAT}, {GAPS}, {_DFT} SELECT flow_id, {st('arg_max(k, p) / any_value(n)')} AS dominant_frequency FROM psd WHERE k > 0 GROUP BY 1")
def i12(spark, sf):
    return settle(te.periodic_features(v.packets(spark, sf)).select("flow_id", "dominant_frequency"))


@query("I13_spectral_entropy", f"WITH {v.IAT}, {GAPS}, {_DFT} SELECT flow_id, {st('log2(sum(p)) - sum(CASE WHEN p > 0 THEN p * log2(p) ELSE 0 END) / sum(p)')} AS spectral_entropy FROM psd GROUP BY 1")
def i13(spark, sf):
    return settle(te.periodic_features(v.packets(spark, sf)).select("flow_id", "spectral_entropy"))


def _fft_sql(rel: str, value: str, name: str) -> str:
    parts = ", ".join(f"sqrt(pow(sum({value} * cos(2 * pi() * {k} * (pos - 1) / 20)), 2) + pow(sum({value} * sin(2 * pi() * {k} * (pos - 1) / 20)), 2)) AS m{k}" for k in range(10))
    top = "greatest(" + ", ".join(f"m{k}" for k in range(10)) + ")"
    cols = ", ".join(f"{st(f'CASE WHEN n >= 2 THEN m{k} / ({top} + 1e-10) ELSE 0 END')} AS {name}_{k}" for k in range(10))
    return f"m AS (SELECT flow_id, count(*) AS n, {parts} FROM {rel} WHERE pos <= 20 GROUP BY 1) SELECT flow_id, {cols} FROM m"


@query("I14_fft_sizes", f"WITH {v.IAT}, sz AS (SELECT flow_id, rn AS pos, size FROM iat), {_fft_sql('sz', 'size', 'fft')}")
def i14(spark, sf):
    return settle(te.fft_features(te.size_series(v.packets(spark, sf)), ["flow_id"], "size", "fft"))


@query("I14_fft_gaps", f"WITH {v.IAT}, {GAPS}, {_fft_sql('gaps', 'iat', 'iat_fft')}")
def i14b(spark, sf):
    return settle(te.fft_features(te.gap_series(v.packets(spark, sf)), ["flow_id"], "iat", "iat_fft"))


_DEV = "dev AS (SELECT flow_id, pos, iat, n, mean, sd, sum(iat - mean) OVER (PARTITION BY flow_id ORDER BY pos) AS y FROM gaps JOIN gn USING (flow_id))"
_HURST = f"hu AS (SELECT flow_id, {_d('any_value(n) >= 10 AND any_value(sd) > 0', 'least(greatest(ln((max(y) - min(y)) / any_value(sd)) / ln(any_value(n)), 0), 1)', '0.5')} AS hurst_exponent FROM dev GROUP BY 1)"


@query("I15_hurst_exponent", f"WITH {v.IAT}, {GAPS}, {_DEV}, {_HURST} SELECT flow_id, {st('hurst_exponent')} AS hurst_exponent FROM hu")
def i15(spark, sf):
    return settle(te.hurst_exponent(v.packets(spark, sf)))


@query("I16_fractal_dimension", f"""WITH {v.IAT}, {GAPS}, s AS (SELECT flow_id, min(iat) AS lo, max(iat) AS hi, count(*) AS n FROM gaps GROUP BY 1),
b AS (SELECT DISTINCT flow_id, g, floor((pos - 1) * g / n) AS bx, floor((iat - lo) / (hi - lo + 1e-10) * g) AS by_ FROM gaps JOIN s USING (flow_id), (VALUES (2), (4), (8), (16)) v(g) WHERE n >= 10),
c AS (SELECT flow_id, g, count(*) AS c FROM b GROUP BY 1, 2), f AS (SELECT flow_id, least(greatest(regr_slope(ln(c), ln(g)), 1), 2) AS d FROM c GROUP BY 1)
SELECT flow_id, {st('coalesce(d, 1)')} AS box_dimension, CAST(1 AS DOUBLE) AS fractal_dimension FROM (SELECT DISTINCT flow_id FROM packets) LEFT JOIN f USING (flow_id)""")
def i16(spark, sf):
    return settle(te.fractal_dimension(v.packets(spark, sf)))


def _dfa(x: str) -> str:
    return f"""WITH {v.IAT}, {GAPS}, {_DEV}, sz AS (SELECT flow_id, n, list_sort(list_distinct(list_transform(range(0, 10), lambda i: CAST(floor(pow(10, 0.5 + i * (log10(n // 4) - 0.5) / 9) + 1e-9) AS INTEGER)))) AS sizes FROM gn WHERE n >= 20),
sw AS (SELECT flow_id, n, sizes, unnest(list_filter(sizes, lambda s: s >= 4)) AS w FROM sz), sr AS (SELECT *, row_number() OVER (PARTITION BY flow_id ORDER BY w) AS rank FROM sw),
ft AS (SELECT s.flow_id, s.w, s.rank, any_value(sizes) AS sizes, greatest(regr_syy(y, pos) - regr_sxy(y, pos) * regr_sxy(y, pos) / regr_sxx(y, pos), 0) AS sse FROM sr s JOIN dev d ON s.flow_id = d.flow_id
 WHERE (pos - 1) // w < s.n // w GROUP BY s.flow_id, s.w, s.rank, (pos - 1) // w),
fl AS (SELECT flow_id, w, rank, any_value(sizes) AS sizes, avg(sqrt(sse / w)) AS f FROM ft GROUP BY 1, 2, 3),
lr AS (SELECT flow_id, CASE WHEN count(*) >= 3 THEN least(greatest(abs(regr_slope(ln(f), ln({x})) - 0.5), 0), 1) END AS l FROM fl GROUP BY 1)
SELECT flow_id, {st('coalesce(l, 0)')} AS long_range_dependence FROM (SELECT DISTINCT flow_id FROM packets) LEFT JOIN lr USING (flow_id)"""


@query("I17_long_range_dependence", _dfa("sizes[rank]"))
def i17(spark, sf):
    return settle(te.long_range_dependence(v.packets(spark, sf)))


@query("I17_aligned_scales", _dfa("w"))
def i17b(spark, sf):
    return settle(te.long_range_dependence(v.packets(spark, sf), aligned=True))


def _part(c: str) -> str:
    return f"1 / (1 + stddev_pop({c}) / (avg({c}) + 1e-10))"


@query("I18_invariance_score", f"""WITH {v.IAT}, {_size_entropy('packets')}, {_MEM}, {GAPS}, {_PEAK}, {_DEV}, {_HURST},
au AS (SELECT flow_id, {_d('n >= 11', _BEST)} AS size_autocorrelation FROM mem),
dr AS (SELECT flow_id, {_d('sum(c) >= 10 AND count(*) > 1', 'min(c) / max(c)')} AS bidirectional_ratio FROM (SELECT flow_id, direction, count(*) AS c FROM packets GROUP BY 1, 2) GROUP BY 1),
tu AS (SELECT flow_id, {_d('count(*) >= 10', 'count(*) FILTER (ch)')} AS conversation_turns FROM (SELECT flow_id, direction <> lag(direction) OVER (PARTITION BY flow_id ORDER BY t, pkt_id) AS ch FROM packets) GROUP BY 1),
al AS (SELECT *, 1 AS fractal_dimension FROM sent JOIN au USING (flow_id) JOIN dr USING (flow_id) JOIN tu USING (flow_id) JOIN per USING (flow_id) JOIN hu USING (flow_id))
SELECT {st('(' + ' + '.join(_part(c) for c in te.STABLE_FEATURES) + ') / 7')} AS invariance_score FROM al""")
def i18(spark, sf):
    return settle(te.invariance_score(materialize(te.flow_invariants(v.packets(spark, sf)), "invariants")))


@query("I19_rhythm_features", f"""WITH {v.IAT}, {_Q}, g AS (SELECT flow_id, iat, p25, iat < p25 AS b, lag(iat) OVER (PARTITION BY flow_id ORDER BY rn) < p25 AS pb FROM iat JOIN q USING (flow_id) WHERE rn >= 2)
SELECT flow_id, {sts('avg(iat) AS rhythm_mean', 'stddev_pop(iat) AS rhythm_std', 'stddev_pop(iat) / (avg(iat) + 1e-10) AS rhythm_cv',
 'CASE WHEN count(*) < 3 THEN 0 ELSE 1 / (1 + stddev_pop(iat) / (avg(iat) + 1e-10)) END AS rhythm_regularity', 'coalesce(1 / (avg(iat) FILTER (b) + 1e-10), 0) AS burst_intensity',
 'count(*) FILTER (b AND NOT coalesce(pb, false)) / count(*) AS burst_frequency')} FROM g GROUP BY 1""")
def i19(spark, sf):
    return settle(te.rhythm_features(v.packets(spark, sf)))
