"""DuckDB SQL for the queries of plans.runs, written from their meaning."""

from __future__ import annotations

from .oracles import _CUST, _SCORE, _SUPP, _hav, _soft
from .oracles import ORACLES as QUERY_ORACLES

_FIELD = """f AS (SELECT CAST(p_partkey//1000 AS INT) cyc, CAST((p_partkey%1000)//50 AS INT) r, CAST(p_partkey%50 AS INT) c, p_retailprice*60 pr, CAST(p_size%10=0 AS INT)::DOUBLE la, p_size+40.0::DOUBLE rh, (p_size%7)::DOUBLE u8, (p_size%5)::DOUBLE v8,
 (p_size%11)::DOUBLE u2, (p_size%13)::DOUBLE v2, (p_size-25)*1e-6::DOUBLE vo, 296+p_size/6::DOUBLE ts FROM part)"""
#: (column, mean, deviation, weight of the mean, weight of the centre)
_CHANNELS = [("pr", 90000.0, 20000.0, -0.8, 0), ("la", 0, 1, 0.1, 0), ("rh", 65, 15, 1.2, 0.5), ("u8", 3, 2, 0.2, 0), ("v8", 2, 1.5, 0.1, 0), ("u2", 5, 3, 0.1, 0), ("v2", 6, 4, 0.1, 0), ("vo", 0, 1.5e-5, 0.7, 0.4), ("ts", 300, 2.5, 0.6, 0)]
_z = lambda t, c, m, s: f"(({t}.{c}-({float(m)!r}::DOUBLE))/({float(s)!r}::DOUBLE))"
_MEANS = ", ".join(f"avg({_z('x', c, m, s)}) m_{c}, avg(abs({_z('x', c, m, s)})) a_{c}" for c, m, s, _, _ in _CHANNELS)
_LOGIT = "+".join(["0.3::DOUBLE", *[f"({w!r}::DOUBLE)*m_{c}" for c, _, _, w, _ in _CHANNELS], *[f"({v!r}::DOUBLE)*{_z('b', c, m, s)}" for c, m, s, _, v in _CHANNELS if v]])
_WHY = {c: f"abs({w!r}::DOUBLE)*a_{c}" for c, _, _, w, _ in _CHANNELS}
_BY_VARIABLE = {"pr": _WHY["pr"], "la": _WHY["la"], "rh": _WHY["rh"], "u": f"({_WHY['u8']}+{_WHY['u2']})/2", "v": f"({_WHY['v8']}+{_WHY['v2']})/2", "vo": _WHY["vo"], "ts": _WHY["ts"]}
_TOTAL = "+".join(_BY_VARIABLE.values())
_STATUS = "CASE skey%5 WHEN 0 THEN 'TS' WHEN 1 THEN 'DB' WHEN 2 THEN 'EX' WHEN 3 THEN 'INVEST' ELSE 'HU' END"
_clip = lambda x: f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, {x}))"
_held = lambda low, top: f"greatest({low}::DOUBLE, least({top}::DOUBLE, hy))"
_far = _hav("x.la", "x.lo", "o.lat", "o.lon")

FIELD_HOTSPOTS = f"""
WITH RECURSIVE {_FIELD}, {_SUPP},
w AS (SELECT a.cyc, a.r, a.c, {_MEANS}, avg(x.la) land, avg(x.pr) mp FROM f a JOIN f x ON a.cyc=x.cyc AND x.r BETWEEN a.r-2 AND a.r+2 AND (x.c-a.c+52)%50<=4
 WHERE abs((a.r-10)*3.0::DOUBLE)<=25 AND a.la<=0.5 AND a.ts>=298 GROUP BY a.cyc, a.r, a.c HAVING count(*)=25),
sc AS (SELECT w.*, b.* EXCLUDE (cyc, r, c, la), 1/(1+exp(-({_LOGIT}))) p, CASE WHEN m_la<0.18::DOUBLE THEN 1/(1+exp(-(0.5::DOUBLE+0.9::DOUBLE*{_z('b', 'rh', 65, 15)}))) END cn, 1/(1+exp(-(0.4::DOUBLE-0.8::DOUBLE*m_pr))) vi FROM w JOIN f b USING (cyc, r, c)),
g AS (SELECT *, CAST(r*50+c AS BIGINT) AS key, (r-10)*3.0::DOUBLE lat, CASE WHEN c*7.2::DOUBLE<=180 THEN c*7.2::DOUBLE ELSE c*7.2::DOUBLE-360 END lon FROM sc WHERE p>=0.6::DOUBLE AND (cn IS NULL OR cn>=0.4::DOUBLE) AND vi>=0.4::DOUBLE),
o AS (SELECT *, row_number() OVER (PARTITION BY cyc ORDER BY p DESC, key) rn FROM g),
n AS (SELECT cyc, CAST(0 AS BIGINT) rn, CAST([] AS STRUCT(k BIGINT, la DOUBLE, lo DOUBLE)[]) kept FROM o GROUP BY cyc
 UNION ALL SELECT n.cyc, n.rn+1, CASE WHEN len(list_filter(n.kept, lambda x: {_far}<=900))=0 THEN list_append(n.kept, {{'k':o.key,'la':o.lat,'lo':o.lon}}) ELSE n.kept END FROM n JOIN o ON o.cyc=n.cyc AND o.rn=n.rn+1),
l AS (SELECT cyc, unnest(arg_max(kept, rn)) x FROM n GROUP BY cyc), k AS (SELECT g.* FROM g JOIN l ON l.cyc=g.cyc AND l.x.k=g.key),
e AS (SELECT k.*, skey, CASE WHEN skey IS NOT NULL THEN {_hav('k.lat', 'k.lon', 'slat', 'slon')} END km, CASE WHEN skey IS NOT NULL THEN abs(24+6*k.cyc-skey%48)::DOUBLE END h FROM k LEFT JOIN s ON skey%3=k.cyc),
q AS (SELECT *, CASE WHEN skey IS NOT NULL THEN {_STATUS} END st FROM (SELECT *, row_number() OVER (PARTITION BY cyc, key ORDER BY km+5*h, CAST(skey AS VARCHAR)) i FROM e) WHERE i=1),
v AS (SELECT *, sqrt(pow(u2-u8,2)+pow(v2-v8,2)) sh, CASE WHEN lat>=0 THEN vo ELSE -vo END cv, pr-mp pa, ({_TOTAL}-{_BY_VARIABLE['la']})/({_TOTAL}) xs, CASE WHEN key%4=0 THEN p*0.7::DOUBLE END le FROM q),
y AS (SELECT *, (land<=0.15::DOUBLE)::INT+(rh>=55)::INT+(sh<=20)::INT+(cv>=7.5e-6::DOUBLE)::INT+(pa<=0)::INT+(ts>=299)::INT ck,
 {_clip(f"0.50*(({_soft('land', '0.15', '0.08', False)}+{_soft('rh', '55', '10', True)}+{_soft('sh', '20', '5', False)}+{_soft('cv', '7.5e-6', '1.5e-5', True)}+{_soft('pa', '0', '250', False)}+{_soft('ts', '299', '1.5', True)})/6)+0.30*(0.5*p+0.25*coalesce(cn,0)+0.25*vi)+0.12*xs+0.08*(1-abs(coalesce(cn,0)-vi))")} hy FROM v),
t AS (SELECT *, CASE WHEN km<=600 AND h<=36 AND st IN ('TS','HU') THEN {{'c':'ACTIVE_CYCLONE','x':0.95::DOUBLE}} WHEN km<=400 AND h<=48 AND st='DB' AND rh>=60 AND sh<=25 AND cv>=7.5e-6 THEN {{'c':'ACTIVE_DEPRESSION','x':0.90::DOUBLE}}
 WHEN km<=650 AND h<=48 AND st IN ('DB','INVEST') AND le>=0.5 THEN {{'c':'NEW_GENESIS_CANDIDATE','x':le}} WHEN km<=650 AND h<=48 AND st IN ('DB','INVEST') AND le IS NOT NULL THEN {{'c':'INVEST_OR_DEVELOPING_SYSTEM','x':1-le}}
 WHEN km<=650 AND h<=48 AND st IN ('DB','INVEST') AND ck>=4 THEN {{'c':'NEW_GENESIS_CANDIDATE','x':{_held(0.55, 0.95)}}} WHEN km<=650 AND h<=48 AND st IN ('DB','INVEST') THEN {{'c':'INVEST_OR_DEVELOPING_SYSTEM','x':{_held(0.50, 0.85)}}}
 WHEN km<=500 AND h<=72 AND st='EX' THEN {{'c':'RECENT_DECAYING_SYSTEM','x':0.88::DOUBLE}} WHEN km<=500 AND h<=72 AND st IN ('TS','HU') THEN {{'c':'RECENT_TRACKED_CYCLONE','x':0.82::DOUBLE}}
 WHEN land>=0.20 AND rh>=60 THEN {{'c':'MONSOON_OR_LAND_LOW','x':0.72::DOUBLE}} WHEN le>=0.75 THEN {{'c':'HIGH_PRIORITY_MODEL_GENESIS_CANDIDATE','x':le}} WHEN le>=0.5 THEN {{'c':'MODEL_GENESIS_CANDIDATE','x':le}} WHEN le<=0.25 THEN {{'c':'LOW_SUPPORT_DISTURBANCE','x':1-le}}
 WHEN ck>=6 THEN {{'c':'HIGH_PRIORITY_MODEL_GENESIS_CANDIDATE','x':{_held(0.70, 0.95)}}} WHEN ck>=5 THEN {{'c':'MODEL_GENESIS_CANDIDATE','x':{_held(0.62, 0.90)}}} WHEN ck>=4 THEN {{'c':'POSSIBLE_MODEL_GENESIS_CANDIDATE','x':{_held(0.52, 0.80)}}}
 WHEN land<=0.15 AND rh>=50 AND cv>=4e-6 THEN {{'c':'UNVERIFIED_TROPICAL_DISTURBANCE','x':{_held(0.40, 0.70)}}} ELSE {{'c':'UNCLASSIFIED_DISTURBANCE','x':0.40::DOUBLE}} END z, CASE WHEN km<=700 THEN skey END sys FROM y),
u AS (SELECT *, row_number() OVER (PARTITION BY cyc, sys ORDER BY p DESC, key) j FROM t), d AS (SELECT *, row_number() OVER (PARTITION BY cyc ORDER BY p DESC, key) rk FROM u WHERE sys IS NULL OR j=1)
SELECT cyc AS cycle, rk AS rank, key, CAST(skey AS VARCHAR) AS storm_id, round(p,6) AS confidence, round(km,6) AS distance_km, round(land,6) AS land_fraction, round(pa,6) AS pressure_anomaly_pa, round(sh,6) AS shear_200_850_ms, round(hy,9) AS hybrid_support, z.c AS system_class, round(z.x,9) AS class_confidence FROM d WHERE rk<=20"""


def _draw(*parts: str) -> str:
    return "((CAST('0x' || substr(md5('0|' || " + " || '|' || ".join(parts) + "), 1, 13) AS BIGINT)+0.5::DOUBLE)/4503599627370496::DOUBLE)"


TRIED_NEGATIVES = f"""
WITH {_FIELD}, {_SUPP}, t AS (SELECT skey, CAST(skey%2 AS INT) cyc, nation, CAST(n AS INT) n, {_draw("'hard'", 'skey')}<0.7::DOUBLE hard, CAST(4+floor({_draw("'row'", 'skey', 'n')}*12) AS INT) r, CAST(2+floor({_draw("'col'", 'skey', 'n')}*46) AS INT) c FROM s, range(15) x(n)),
p AS (SELECT *, (r-10)*3.0::DOUBLE lat, c*7.2::DOUBLE lon FROM t),
a AS (SELECT p.* FROM p LEFT JOIN f USING (cyc, r, c) WHERE NOT hard OR coalesce(abs(vo)>=1e-5::DOUBLE, false)),
x AS (SELECT DISTINCT a.skey, a.n FROM a JOIN s b ON a.nation=b.nation WHERE {_hav('a.lat', 'a.lon', 'b.slat', 'b.slon')}<600),
l AS (SELECT a.skey, a.n, avg(f.la) land FROM a JOIN f ON f.cyc=a.cyc AND f.r BETWEEN a.r-2 AND a.r+2 AND f.c BETWEEN a.c-2 AND a.c+2 GROUP BY a.skey, a.n),
k AS (SELECT a.*, land, row_number() OVER (PARTITION BY a.skey ORDER BY a.n) i FROM a JOIN l USING (skey, n) LEFT JOIN x USING (skey, n) WHERE x.skey IS NULL AND land<=0.12::DOUBLE)
SELECT skey AS path, n AS nth, hard AS prefers_hard, r AS row, c AS col, round(lat,6) AS latitude, round(lon,6) AS longitude, round(land,6) AS land_fraction FROM k WHERE i=1"""

WEIGHTED_NEGATIVES = f"""
WITH {_FIELD}, g AS (SELECT cyc, r, c, abs(vo) w FROM f WHERE la=0), q AS (SELECT cyc, CAST(sum(CAST({_draw("'kind'", 'cyc', 'i')}<0.7::DOUBLE AS INT)) AS INT) m FROM (SELECT DISTINCT cyc FROM g), range(1, 61) y(i) GROUP BY cyc),
h AS (SELECT *, row_number() OVER (PARTITION BY cyc ORDER BY -ln({_draw("'weight'", 'cyc', 'r', 'c')})/w, r, c) i FROM g WHERE w>0), a AS (SELECT cyc, r, c, i FROM h JOIN q USING (cyc) WHERE i<=m),
e AS (SELECT g.*, row_number() OVER (PARTITION BY g.cyc ORDER BY {_draw("'even'", 'g.cyc', 'g.r', 'g.c')}, g.r, g.c) i FROM g LEFT JOIN a USING (cyc, r, c) WHERE a.cyc IS NULL), n AS (SELECT cyc, count(*) n FROM a GROUP BY cyc)
SELECT cyc AS cycle, r AS row, c AS col, i AS rank, true AS hard FROM a UNION ALL SELECT e.cyc, r, c, i+coalesce(n,0), false FROM e JOIN q USING (cyc) LEFT JOIN n USING (cyc) WHERE i<=60-m"""

_MOVED = lambda at, low, high: f"({at}-15)+CASE WHEN {at}-15<({low}) THEN ({low})-({at}-15) WHEN {at}+15>({high}) THEN ({high})-({at}+15) ELSE 0 END"
_BOX = f"{_MOVED('la', -35, 35)} so, {_MOVED('la', -35, 35)}+30 no, {_MOVED('lo', 5, 355)} we, {_MOVED('lo', 5, 355)}+30 ea"

PATCH_PAIRS = f"""
WITH {_CUST}, {_SUPP}, p AS (SELECT nation, key, lat la, CASE WHEN lon>0 THEN lon ELSE lon+360 END lo FROM c), pos AS (SELECT *, {_BOX} FROM p WHERE la>-35 AND la<35 AND lo>5 AND lo<355),
g AS (SELECT p_partkey%25 nation, CAST((p_partkey*7919)%141-70 AS DOUBLE)/2 y, CAST((p_partkey*104729)%360 AS DOUBLE) x FROM part),
t AS (SELECT nation, key, s sh, CAST(b AS INT) an, la+s*sin(radians(b)) la, lo+s*cos(radians(b)) l0 FROM pos, (VALUES (20.0::DOUBLE),(30.0),(40.0)) v(s), range(0,360,45) w(b)),
b AS (SELECT *, {_BOX} FROM (SELECT nation, key, sh, an, la, l0-360*floor(l0/360) lo FROM t) WHERE la>-35 AND la<35 AND lo>5 AND lo<355),
tc AS (SELECT nation, slat, CASE WHEN slon<0 THEN slon+360 ELSE slon END slon FROM s),
k AS (SELECT b.*, row_number() OVER (PARTITION BY nation, key ORDER BY sh DESC, an) i FROM b WHERE NOT EXISTS (SELECT 1 FROM tc WHERE tc.nation=b.nation AND slat BETWEEN so AND no AND slon BETWEEN we AND ea)
 AND (SELECT count(*) FROM g WHERE g.nation=b.nation AND y BETWEEN so AND no AND x BETWEEN we AND ea)>=2),
o AS (SELECT nation, key, 'positive' kind, CAST(NULL AS DOUBLE) sh, CAST(NULL AS INT) an, la, lo, so, no, we, ea FROM pos UNION ALL SELECT nation, key, 'negative', sh, an, la, lo, so, no, we, ea FROM k WHERE i=1)
SELECT 'f' || nation AS path, key AS sid, kind, sh AS shift, an AS angle, (SELECT count(*) FROM g WHERE g.nation=o.nation AND y BETWEEN so AND no AND x BETWEEN we AND ea) AS cells, round(la,6) AS latitude, round(lo,6) AS longitude, round(so,6) AS south, round(no,6) AS north, round(we,6) AS west, round(ea,6) AS east FROM o"""

MONTHLY_ACCUMULATION = """
WITH q AS (SELECT year(o_orderdate) || '-' || quarter(o_orderdate) AS part, count(*) "rows", count(*) FILTER (WHERE o_orderstatus='F') hits FROM orders GROUP BY 1),
w AS (SELECT *, sum("rows") OVER (ORDER BY part) - "rows" before, sum("rows") OVER () whole FROM q) SELECT part, "rows", hits FROM w WHERE 10*before<3*whole"""

POINTS_IN_RINGS = f"""
WITH {_CUST}, a AS (SELECT n_nationkey n, CAST((n_nationkey*7919)%61-30 AS DOUBLE)+0.25::DOUBLE la, CAST((n_nationkey*104729)%360 AS DOUBLE)+0.125::DOUBLE lo FROM nation),
v AS (SELECT n, 0 ring, i, la+(14+7*i%5)*sin(2*pi()*i/12) y, lo+(14+7*i%5)*cos(2*pi()*i/12) x FROM a, range(12) r(i) UNION ALL SELECT n, 1, i, la+5*sin(2*pi()*i/6), lo+5*cos(2*pi()*i/6) FROM a, range(6) r(i)),
e AS (SELECT n, y y1, x x1, coalesce(lead(y) OVER w, first(y) OVER u) y2, coalesce(lead(x) OVER w, first(x) OVER u) x2 FROM v WINDOW w AS (PARTITION BY n, ring ORDER BY i), u AS (PARTITION BY n, ring ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
m AS (SELECT key, n, count(*) k FROM (SELECT key, lat, lon+360*t lon FROM c, (VALUES (-1),(0),(1),(2)) z(t)) p JOIN e ON (y1>lat)<>(y2>lat) AND lon<x1+(lat-y1)*(x2-x1)/(y2-y1) GROUP BY key, n)
SELECT key, CAST(n AS INT) AS polygon FROM m WHERE k%2=1"""

_VALUES = " UNION ALL ".join(f"SELECT '{c}' AS variable, {c} AS value, l_orderkey%97 AS f FROM lineitem" for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax"))
KEPT_STATISTICS = f"WITH m AS ({_VALUES}), r AS (SELECT variable, CASE WHEN f%10=3 THEN value*2+1 ELSE value END x FROM m WHERE f%10<>7) SELECT variable, count(*) AS n, round(avg(x),6) AS mean, round(stddev_pop(x)+1e-6,6) AS std FROM r GROUP BY variable"

FOLD_NUMBERS = f"WITH {_SCORE} SELECT doc_id, y, CAST((row_number() OVER (PARTITION BY y ORDER BY md5('3|' || doc_id), doc_id)-1)%5 AS INT) AS fold FROM z"

AXIS_ORDER = """
WITH a AS (SELECT p_brand, p_size, min(round(p_retailprice)) lo, max(round(p_retailprice)) hi FROM part GROUP BY ALL), b AS (SELECT *, lag(hi) OVER (PARTITION BY p_brand ORDER BY p_size) be FROM a)
SELECT p_brand, p_size, CASE WHEN lo<>hi THEN 'several positions' ELSE 'not ascending' END AS reason FROM b WHERE lo<>hi OR lo<=be"""

SURFACE_CANDIDATES = """
WITH o AS (SELECT strftime(o_orderdate, '%Y-%m-%d') AS cycle, o_orderstatus || '-' || substr(o_orderpriority,1,1) v, o_totalprice x FROM orders),
k(f, v, i) AS (VALUES ('pressfc','P-1',0),('pressfc','P-2',1),('pressfc','O-1',2),('tmpsfc','F-1',0),('tmpsfc','F-2',1),('tmpsfc','F-3',2),('landmask','P-5',0)),
b AS (SELECT cycle, f, arg_min(v, i) v FROM (SELECT DISTINCT cycle, v FROM o) JOIN k USING (v) GROUP BY cycle, f), g AS (SELECT cycle, f, count(*) n, round(sum(x),2) t FROM o JOIN b USING (cycle, v) GROUP BY cycle, f),
m AS (SELECT cycle, string_agg(f, ',' ORDER BY f) l FROM (SELECT cycle, f FROM (SELECT DISTINCT cycle FROM g), (SELECT DISTINCT f FROM k) EXCEPT SELECT cycle, f FROM g) GROUP BY cycle)
SELECT g.cycle, f AS variable, n, t AS total, l AS missing FROM g LEFT JOIN m USING (cycle)"""

# the same tables as in the summary of the cycles
_CYCLES = QUERY_ORACLES["cycle_verification"].partition("\na AS (SELECT nation, count(*) k FROM raw")[0].rstrip().rstrip(",")
VERIFIED_SIDES = f"""{_CYCLES}, w AS (SELECT nation, cluster, count(*) cs, max(p) mp FROM cl JOIN raw USING (nation, key) GROUP BY nation, cluster)
SELECT rp.nation AS cycle, 'prediction' AS side, rp.cluster AS id, m.skey AS other, CASE WHEN m.skey IS NULL THEN 'FALSE_ALARM' ELSE 'HIT' END AS verification_status, 'E' || (m.skey%9) AS name, cs AS cluster_support, round(mp,9) AS confidence FROM rp JOIN w USING (nation, cluster) LEFT JOIN m ON m.nation=rp.nation AND m.cluster=rp.cluster
UNION ALL SELECT due.nation, 'event', due.skey, m.cluster, CASE WHEN m.skey IS NULL THEN 'MISS' ELSE 'HIT' END, nm, NULL, NULL FROM due LEFT JOIN m ON m.nation=due.nation AND m.skey=due.skey"""

TRAINING_ROWS = f"""
WITH {_CUST}, p AS (SELECT key FROM c WHERE conf>=9000), n AS (SELECT key, row_number() OVER (ORDER BY md5('1|' || key), key) r, count(*) OVER () m FROM c WHERE conf<9000), t AS (SELECT 3*count(*) w FROM p),
d AS (SELECT key, CAST(unnest(range(0, w//m + CAST(r<=w%m AS INT))) AS BIGINT) draw FROM n, t), a AS (SELECT key, 1 AS label, CAST(0 AS BIGINT) AS draw FROM p UNION ALL SELECT key, 0, draw FROM d)
SELECT key, label, draw, CAST(floor((row_number() OVER (ORDER BY md5('0|1|' || label || '|' || key || '|' || draw), key)-1)/64) AS BIGINT) AS batch FROM a"""

_AUC = lambda s, y="y": f"(SELECT (sum(CASE WHEN {y}=1 THEN rk END)-sum({y})*(sum({y})+1)/2.0)/(sum({y})*sum(1-{y})) FROM (SELECT {y}, rank() OVER (ORDER BY {s})+(count(*) OVER (PARTITION BY {s})-1)/2.0 rk FROM %s))"
_PERM = lambda c: f"SELECT a.doc_id, a.y, a.p, a.noise, b.v FROM (SELECT *, row_number() OVER (ORDER BY md5('own|' || doc_id), doc_id) i FROM s) a JOIN (SELECT {c} v, row_number() OVER (ORDER BY md5('0|' || doc_id), doc_id) i FROM s) b USING (i)"
PERMUTATION_IMPORTANCE = f"""
WITH {_SCORE}, s AS (SELECT doc_id, y, p, doc_id%10/10.0::DOUBLE noise FROM z), b AS (SELECT *, p+0.1::DOUBLE*noise sc FROM s), bp AS (SELECT y, v+0.1::DOUBLE*noise sc FROM ({_PERM('p')})), bn AS (SELECT y, p+0.1::DOUBLE*v sc FROM ({_PERM('noise')}))
SELECT 'p' AS feature, round(greatest(0.0, {_AUC('sc') % 'b'}-{_AUC('sc') % 'bp'}),9) AS importance UNION ALL SELECT 'noise', round(greatest(0.0, {_AUC('sc') % 'b'}-{_AUC('sc') % 'bn'}),9)"""

ORACLES = {
    "surface_candidates": SURFACE_CANDIDATES,
    "verified_sides": VERIFIED_SIDES,
    "training_rows": TRAINING_ROWS,
    "permutation_importance": PERMUTATION_IMPORTANCE,
    "fold_numbers": FOLD_NUMBERS,
    "axis_order": AXIS_ORDER,
    "field_hotspots": FIELD_HOTSPOTS,
    "tried_negatives": TRIED_NEGATIVES,
    "weighted_negatives": WEIGHTED_NEGATIVES,
    "patch_pairs": PATCH_PAIRS,
    "monthly_accumulation": MONTHLY_ACCUMULATION,
    "points_in_rings": POINTS_IN_RINGS,
    "kept_statistics": KEPT_STATISTICS,
}
