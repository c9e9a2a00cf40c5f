"""DuckDB SQL for the queries of plans.queries, written from their meaning."""

from __future__ import annotations


def _hav(a: str, b: str, c: str, d: str, r: float = 6371.0088) -> str:
    return f"(2*{r}*asin(least(1.0, sqrt(pow(sin(radians(({c})-({a}))/2),2)+cos(radians({a}))*cos(radians({c}))*pow(sin(radians(({d})-({b}))/2),2)))))"


_CUST = "c AS (SELECT c_custkey AS key, c_nationkey AS nation, c_acctbal AS conf, CAST((c_custkey*7919)%141-70 AS DOUBLE)/2 AS lat, CAST((c_custkey*104729)%360 AS DOUBLE)-180 AS lon FROM customer)"
_SUPP = "s AS (SELECT s_suppkey AS skey, s_nationkey AS nation, s_acctbal AS sconf, CAST(((s_suppkey*3+1)*7919)%141-70 AS DOUBLE)/2 AS slat, CAST(((s_suppkey*3+1)*104729)%360 AS DOUBLE)-180 AS slon FROM supplier)"
_SCORE = "z AS (SELECT doc_id, quality AS y, round(n_chars/(n_chars+2000.0::DOUBLE),6) AS p, n_chars FROM documents JOIN labels USING (doc_id))"
_MEAS = "m AS (SELECT 'l_quantity' AS variable, l_quantity AS value FROM lineitem UNION ALL SELECT 'l_extendedprice', l_extendedprice FROM lineitem UNION ALL SELECT 'l_discount', l_discount FROM lineitem UNION ALL SELECT 'l_tax', l_tax FROM lineitem)"
_LATT = "g AS (SELECT CAST(floor(p_partkey/50) AS INT) AS r, CAST(p_partkey%50 AS INT) AS c, p_retailprice AS v, CAST(p_size AS DOUBLE) AS o FROM part)"
_CYCLE = "time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2000-01-01')"
# running counts from the highest score down
_CURVE = _SCORE + """, t AS (SELECT p, sum(y)::DOUBLE pos, sum(1-y)::DOUBLE neg FROM z GROUP BY p),
w AS (SELECT p, pos, neg, sum(pos) OVER (ORDER BY p DESC) tp, sum(neg) OVER (ORDER BY p DESC) fp, sum(pos) OVER () np, sum(neg) OVER () nn FROM t),
k AS (SELECT *, tp/(tp+fp) pr, tp/np rc FROM w), l AS (SELECT *, coalesce(lag(rc) OVER (ORDER BY p DESC),0) lrc, coalesce(lag(pr) OVER (ORDER BY p DESC),1) lpr FROM k)"""
_PAIRS = f"{_CUST}, {_SUPP}, e AS (SELECT c.nation, c.key, s.skey, round({_hav('lat', 'lon', 'slat', 'slon')},6) km FROM c JOIN s ON c.nation=s.nation WHERE {_hav('lat', 'lon', 'slat', 'slon')} <= 2500)"
_GREEDY = f"""{_PAIRS}, o AS (SELECT *, row_number() OVER (PARTITION BY nation ORDER BY km, key, skey) rn FROM e),
f AS (SELECT nation, CAST(0 AS BIGINT) rn, CAST([] AS STRUCT(l BIGINT, r BIGINT, d DOUBLE)[]) kept FROM o GROUP BY nation
 UNION ALL SELECT f.nation, f.rn+1, CASE WHEN len(list_filter(f.kept, lambda x: x.l=o.key OR x.r=o.skey))=0 THEN list_append(f.kept, {{'l':o.key,'r':o.skey,'d':o.km}}) ELSE f.kept END FROM f JOIN o ON o.nation=f.nation AND o.rn=f.rn+1),
mm AS (SELECT nation, unnest(kept) x FROM (SELECT nation, arg_max(kept, rn) kept FROM f GROUP BY nation)), matches AS (SELECT nation, x.l AS key, x.r AS skey, x.d AS km FROM mm)"""


def _box(radius: int, clip: bool) -> str:
    n = 2 * radius + 1
    rows = f"r AS (SELECT min(r) lo, max(r) hi FROM g), off AS (SELECT unnest(range(-{radius},{radius + 1})) d), offc AS (SELECT unnest(range(-{radius},{radius + 1})) e)"
    target = "a.r+d" if clip else "least(greatest(a.r+d, col_lo), col_hi)"
    return f"WITH {_LATT}, cl AS (SELECT c, min(r) col_lo, max(r) col_hi FROM g GROUP BY c), {rows}, sums AS (SELECT g.r, g.c, sum(b.v) s, count(b.v) k FROM g CROSS JOIN offc JOIN g b ON b.r=g.r AND b.c=((g.c+e)%50+50)%50 GROUP BY g.r, g.c) SELECT a.r AS row, a.c AS col, " + ("round(sum(s)/sum(k),6) AS box_mean" if clip else f"round(any_value(a.v)-sum(s)/{n * n}.0,6)+0.0 AS anomaly") + f" FROM g a JOIN cl USING (c) CROSS JOIN off JOIN sums ON sums.c=a.c AND sums.r={target} GROUP BY a.r, a.c"


def _soft(x: str, at: str, scale: str, up: bool) -> str:
    return f"(1/(1+exp(-greatest(-20,least(20,{'' if up else '-'}(({x})-({at}))/{scale})))))"


_RH, _LAND, _SHEAR, _VORT, _PRES, _SST = "(l_quantity+30)", "(l_tax*3)", "(l_quantity*0.7::DOUBLE)", "((l_quantity-15)*1e-6)", "((25-l_quantity)*10)", "(295+l_discount*80)"
_ENV = "((" + "+".join([_soft(_LAND, "0.15", "0.08", False), _soft(_RH, "55", "10", True), _soft(_SHEAR, "20", "5", False), _soft(_VORT, "7.5e-6", "1.5e-5", True), _soft(_PRES, "0", "250", False), _soft(_SST, "299", "1.5", True)]) + ")/6)"
_CHECKS = f"(({_LAND}<=0.15::DOUBLE)::INT+({_RH}>=55)::INT+({_SHEAR}<=20)::INT+({_VORT}>=7.5e-6)::INT+({_PRES}<=0)::INT+({_SST}>=299)::INT)"
_CLIP = "greatest(0.0::DOUBLE,least(1.0::DOUBLE,{}))"
_HYB = f"greatest(0.0,least(1.0,0.50*{_ENV}+0.30*(0.5*{_CLIP.format('l_discount*10')}+0.25*{_CLIP.format('l_tax*12')}+0.25*{_CLIP.format('l_quantity/50')})+0.12*(l_tax+0.01)/(l_tax+l_discount+0.01)+0.08*{_CLIP.format('1-abs(' + _CLIP.format('l_tax*12') + '-' + _CLIP.format('l_quantity/50') + ')')}))"

ORACLES: dict[str, str] = {
    "geo_pairs_within": f"WITH {_CUST} SELECT a.key AS key_a, b.key AS key_b, round({_hav('a.lat', 'a.lon', 'b.lat', 'b.lon')},6) AS distance_km FROM c a JOIN c b ON a.key<b.key WHERE {_hav('a.lat', 'a.lon', 'b.lat', 'b.lon')} <= 1000",
    "exclusion_anti": f"WITH {_CUST}, {_SUPP} SELECT key FROM c WHERE NOT EXISTS (SELECT 1 FROM s WHERE {_hav('lat', 'lon', 'slat', 'slon')} < 550)",
    "nearest_with_age": f"WITH {_CUST}, {_SUPP}, e AS (SELECT key, skey, CASE WHEN skey IS NOT NULL THEN {_hav('lat', 'lon', 'slat', 'slon')} END km, abs(key%72-skey%48)::DOUBLE h FROM c LEFT JOIN s ON c.nation=s.nation), r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY km+5*h, skey) n FROM e) SELECT key, skey, round(km,6) AS distance_km, round(h,6) AS age_hours FROM r WHERE n=1",
    "nearest_grid_cell": f"WITH {_CUST} SELECT key, CAST(round_even(lat+0.25+90,0) AS INT) AS row, CAST(round_even(((lon+0.3::DOUBLE)%360+360)%360,0) AS INT)%360 AS col FROM c",
    "lead_window_join": "WITH f AS (SELECT user_id, min(ts) t FROM events GROUP BY user_id) SELECT e.user_id, event_id, round((epoch_us(ts)-epoch_us(t))/3.6e9,6) AS lead_hours FROM events e JOIN f ON e.user_id=f.user_id WHERE (epoch_us(ts)-epoch_us(t))/3.6e9 BETWEEN 18 AND 30",
    "exact_lead_join": f"WITH c AS (SELECT DISTINCT {_CYCLE} AS cycle FROM events), f AS (SELECT user_id, time_bucket(INTERVAL 6 HOUR, min(ts), TIMESTAMP '2000-01-01') AS genesis FROM events GROUP BY user_id) SELECT cycle, count(user_id) AS n, count(user_id)>0 AS is_genesis FROM c LEFT JOIN f ON cycle + INTERVAL 24 HOUR = genesis GROUP BY cycle",
    "active_at_time": f"WITH e AS (SELECT DISTINCT {_CYCLE} AS cycle, user_id FROM events), g AS (SELECT cycle, count(*) n, string_agg(CAST(user_id AS VARCHAR), ',' ORDER BY user_id) l FROM e GROUP BY cycle), f AS (SELECT unnest(generate_series(CAST(date_trunc('month', min(cycle)) AS TIMESTAMP), max(cycle), INTERVAL 6 HOUR)) AS file_ts FROM e) SELECT file_ts, n IS NOT NULL AS is_active, coalesce(n,0) AS n, l AS storms FROM f LEFT JOIN g ON file_ts=cycle",
    "box_exclusion": f"WITH {_CUST}, {_SUPP} SELECT key FROM c WHERE NOT EXISTS (SELECT 1 FROM s WHERE skey%10=key%10 AND abs(slat-lat)<=20 AND least(((slon-lon)%360+360)%360, 360-((slon-lon)%360+360)%360)<=20)",
    "greedy_match": f"WITH RECURSIVE {_GREEDY} SELECT nation, key, skey, km FROM matches",
    "match_metrics": f"WITH RECURSIVE {_GREEDY}, ev AS (SELECT s.skey, k.key FROM s LEFT JOIN matches k USING (skey)), pr AS (SELECT c.key, k.skey, k.km FROM c LEFT JOIN matches k USING (key)), a AS (SELECT count(skey) h, count(*)-count(skey) f, avg(km) mk, median(km) md FROM pr), b AS (SELECT count(*)-count(key) m FROM ev) SELECT h AS hits, m AS misses, f AS false_alarms, round(h/(h+m),9) AS pod, round(h/(h+f),9) AS precision, round(f/(h+f),9) AS far, round(h/(h+m+f),9) AS csi, round(mk,9) AS mean_km, round(md,9) AS median_km FROM a, b",
    "cache_reuse": f"WITH {_CUST}, h AS (SELECT key, CASE WHEN key%2=0 THEN conf END v1, CASE WHEN key%5=0 THEN lat END v2 FROM c WHERE key%3=0), j AS (SELECT o_custkey k, coalesce(v1,v2) v FROM orders LEFT JOIN h ON o_custkey=key) SELECT CASE WHEN v IS NULL THEN 'pending' ELSE 'reused' END AS kind, count(*) AS n, CAST(sum(k) AS BIGINT) AS keys FROM j GROUP BY 1",
    "genesis_first_event": "SELECT user_id, ts, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) n FROM events) WHERE n=1",
    "genesis_first_values": "SELECT user_id, arg_min(value, ts) FILTER (WHERE event_type='purchase') AS bought, arg_min(event_type, ts) AS event_type FROM events GROUP BY user_id",
    "prior_samples": "SELECT CAST(user_id AS VARCHAR) AS sid, min(ts) AS genesis_ts, min(ts) - INTERVAL 24 HOUR AS prior_ts, CAST((arg_min(event_id,ts)*7919)%141-70 AS DOUBLE)/2 AS lat, CAST((arg_min(event_id,ts)*104729)%360 AS DOUBLE)-180 AS lon, max(value) AS max_wind FROM events GROUP BY user_id HAVING count(*)>=2",
    "label_table": f"WITH e AS (SELECT DISTINCT CAST(user_id AS VARCHAR) sid, {_CYCLE} t FROM events), f AS (SELECT sid, min(t) g FROM e GROUP BY sid), x AS (SELECT DISTINCT t FROM e), g AS (SELECT g, count(*) n, string_agg(sid, ',' ORDER BY sid) l FROM f GROUP BY g), a AS (SELECT t, count(*) n FROM e GROUP BY t) SELECT strftime(x.t,'%Y%m%d%H') AS path, g.n IS NOT NULL AS is_genesis, coalesce(g.n,0) AS genesis_count, true AS is_active, coalesce(l,'') AS genesis_sids, a.n AS n_active FROM x LEFT JOIN g ON g.g = x.t + INTERVAL 24 HOUR JOIN a ON a.t=x.t",
    "chrono_split": "SELECT CASE WHEN year(o_orderdate) BETWEEN 1995 AND 1998 THEN 'train' WHEN year(o_orderdate)=1999 THEN 'val' WHEN year(o_orderdate) BETWEEN 2000 AND 2001 THEN 'test' END AS split, count(*) AS n, round(sum(o_totalprice),2) AS total FROM orders GROUP BY 1",
    "synoptic_filter": f"SELECT {_CYCLE} AS cycle, count(*) AS n FROM events WHERE hour(ts)%6=0 AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20' GROUP BY 1",
    "negative_centers": f"WITH {_CUST}, t AS (SELECT key, s AS shift, CAST(b AS INT) AS angle, lat+s*sin(radians(b)) nl, lon+s*cos(radians(b)) no FROM c, (VALUES (8.0::DOUBLE),(12.0),(16.0)) v(s), range(0,360,45) w(b)), m AS (SELECT key, shift, angle, nl, no-360*floor(no/360) no FROM t), i AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY shift DESC, angle) n FROM m WHERE nl>-30 AND nl<30 AND no>10 AND no<350) SELECT key, shift, angle, round(nl,6) AS new_lat, round(no,6) AS new_lon FROM i WHERE n=1",
    "patch_centers": f"WITH {_CUST} SELECT key, greatest(-25.0::DOUBLE,least(25.0::DOUBLE,lat)) AS center_lat, greatest(-170.0::DOUBLE,least(170.0::DOUBLE,lon)) AS center_lon FROM c",
    "dedupe_keep_last": "SELECT user_id, event_type, ts, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) n FROM events) WHERE n=1",
    "newest_per_key": "SELECT user_id, ts, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) n FROM events) WHERE n=1",
    "unique_any_hit": "SELECT count(*) AS storms, CAST(sum(h) AS BIGINT) AS storms_hit, round(avg(h),9) AS storm_pod FROM (SELECT user_id, max((value>100)::INT) h FROM events GROUP BY user_id)",
    "file_summary": """WITH e AS (SELECT *, date_trunc('day', ts) AS day FROM events), p AS (SELECT day, count(*) n, count(*) FILTER (WHERE event_type='purchase') h, coalesce(string_agg(DISTINCT CAST(user_id AS VARCHAR), '; ' ORDER BY CAST(user_id AS VARCHAR)) FILTER (WHERE event_type='purchase' AND value>20), '') nh FROM e WHERE event_type IN ('purchase','click') GROUP BY day),
o AS (SELECT day, count(*) n, count(*) FILTER (WHERE event_type='error') m, coalesce(string_agg(DISTINCT CAST(user_id AS VARCHAR), '; ' ORDER BY CAST(user_id AS VARCHAR)) FILTER (WHERE value>60), '') ns FROM e WHERE event_type IN ('purchase','error') GROUP BY day)
SELECT CAST(coalesce(p.day,o.day) AS TIMESTAMP) AS day, coalesce(p.n,0) AS predictions, coalesce(h,0) AS hits, coalesce(p.n-h,0) AS false_alarms, coalesce(o.n,0) AS events, coalesce(m,0) AS misses, coalesce(ns,'') AS names, coalesce(nh,'') AS names_hit FROM p FULL JOIN o ON p.day=o.day""",
    "union_by_name": f"WITH {_CUST}, {_SUPP}, u AS (SELECT nation, lat, NULL wind FROM c UNION ALL SELECT nation, NULL, sconf FROM s) SELECT nation, count(*) AS n, count(lat) AS with_lat, round(sum(wind),2) AS wind FROM u GROUP BY nation",
    "distinct_classes": "SELECT DISTINCT p_type AS system_class FROM part WHERE p_type IS NOT NULL",
    "dashboard_counters": f"WITH {_CUST}, v AS (SELECT nation, CASE WHEN conf>9000 THEN 'N' WHEN conf>5000 THEN 'M' WHEN nation<5 THEN 'A' ELSE 'U' END k, CASE WHEN key%11>0 THEN conf/100 END s FROM c) SELECT count(*) AS visible, count(*) FILTER (WHERE k='N') AS genesis, count(*) FILTER (WHERE k='A') AS active, round(avg(coalesce(s,0)),6) AS mean_score FROM v WHERE coalesce(s,0)>=0",
    "dashboard_filter": f"WITH {_CUST}, v AS (SELECT nation, CASE WHEN conf>9000 THEN 'N' WHEN conf>5000 THEN 'M' WHEN nation<5 THEN 'A' ELSE 'U' END k, CASE WHEN key%11>0 THEN conf/100 END s FROM c) SELECT nation, count(*) AS visible, count(*) AS genesis, CAST(0 AS BIGINT) AS active, round(avg(s),6) AS mean_score FROM v WHERE k='N' AND s>=92.5 AND s/100>0.5 GROUP BY nation",
    "nms_top_k": f"WITH RECURSIVE {_CUST}, o AS (SELECT *, row_number() OVER (PARTITION BY nation ORDER BY conf DESC, key) rn FROM c), f AS (SELECT nation, CAST(0 AS BIGINT) rn, CAST([] AS STRUCT(k BIGINT, cf DOUBLE, la DOUBLE, lo DOUBLE)[]) kept FROM o GROUP BY nation UNION ALL SELECT f.nation, f.rn+1, CASE WHEN len(list_filter(f.kept, lambda x: {_hav('x.la', 'x.lo', 'o.lat', 'o.lon')}<=2500))=0 THEN list_append(f.kept, {{'k':o.key,'cf':o.conf,'la':o.lat,'lo':o.lon}}) ELSE f.kept END FROM f JOIN o ON o.nation=f.nation AND o.rn=f.rn+1), l AS (SELECT nation, arg_max(kept, rn) kept FROM f GROUP BY nation), u AS (SELECT nation, kept, unnest(range(1, least(len(kept),5)+1)) i FROM l) SELECT nation, i AS rank, kept[i].k AS key, kept[i].cf AS conf FROM u",
    "dbscan_cluster": f"WITH RECURSIVE {_CUST}, e AS (SELECT a.key a, b.key b FROM c a JOIN c b ON a.key<>b.key AND abs(a.lat-b.lat)<=8.2 AND {_hav('a.lat', 'a.lon', 'b.lat', 'b.lon')}<=900), r AS (SELECT a AS key, a AS x FROM e UNION SELECT r.key, e.b FROM r JOIN e ON e.a=r.x) SELECT key, min(x) AS cluster FROM r GROUP BY key",
    "dbscan_dense": f"WITH RECURSIVE {_CUST}, e AS (SELECT a.key a, b.key b FROM c a JOIN c b ON abs(a.lat-b.lat)<=8.2 AND {_hav('a.lat', 'a.lon', 'b.lat', 'b.lon')}<=900), core AS (SELECT a AS key FROM e GROUP BY a HAVING count(*)>=4), ce AS (SELECT a, b FROM e WHERE a IN (SELECT key FROM core) AND b IN (SELECT key FROM core)), r AS (SELECT key, key AS x FROM core UNION SELECT r.key, ce.b FROM r JOIN ce ON ce.a=r.x), lab AS (SELECT key, min(x) cl FROM r GROUP BY key) SELECT e.a AS key, coalesce(max(CASE WHEN lab.key=e.a THEN cl END), min(cl)) AS cluster FROM e JOIN lab ON lab.key=e.b GROUP BY e.a",
    "cluster_representatives": f"WITH RECURSIVE {_CUST}, e AS (SELECT a.key a, b.key b FROM c a JOIN c b ON a.key<>b.key AND abs(a.lat-b.lat)<=8.2 AND {_hav('a.lat', 'a.lon', 'b.lat', 'b.lon')}<=900), r AS (SELECT a AS key, a AS x FROM e UNION SELECT r.key, e.b FROM r JOIN e ON e.a=r.x), cl AS (SELECT key, min(x) AS cluster FROM r GROUP BY key), m AS (SELECT cluster, c.*, conf+1000 w, row_number() OVER (PARTITION BY cluster ORDER BY conf DESC, c.key) n FROM cl JOIN c USING (key)), q AS (SELECT cluster, round(sum(w*lat)/sum(w),6) AS latitude, degrees(atan2(sum(w*sin(radians(lon)))/sum(w),sum(w*cos(radians(lon)))/sum(w))) lo, count(*) AS cluster_support, round(avg(w),6) AS mean_confidence, max(w) AS max_confidence, max(lat) FILTER (WHERE n=1) AS representative_grid_latitude, max(lon) FILTER (WHERE n=1) AS representative_grid_longitude FROM m GROUP BY cluster) SELECT cluster, latitude, round(CASE WHEN lo<=-180 THEN 180 ELSE lo END,6) AS longitude, cluster_support, mean_confidence, max_confidence, representative_grid_latitude, representative_grid_longitude FROM q",
    "cluster_rank_score": "WITH s AS (SELECT l_linenumber, round(0.44*l_discount*10+0.14*l_tax*10+0.14*(l_discount+l_tax)+0.08*least(1.0,ln(1+l_linenumber)/ln(11.0))+0.06*least(1.0,greatest(0.0,(l_quantity-10)*1e-6/5e-5))+0.04*least(1.0,greatest(0.0,(l_quantity-10)/30))+0.04*least(1.0,greatest(0.0,(l_quantity*20-300)/500))+0.03*least(1.0,greatest(0.0,-(l_quantity-25)*1e-7/5e-6))+0.03*least(1.0,greatest(0.0,(20-l_quantity/2)/20)),9) v FROM lineitem) SELECT l_linenumber, round(sum(v),4) AS total, max(v) AS top FROM s GROUP BY 1",
    "score_gates": "WITH t AS (SELECT l_discount*10 e, CASE WHEN l_linenumber>2 THEN l_tax*12 END c, CASE WHEN l_linenumber<>4 THEN l_quantity/50 END v FROM lineitem) SELECT count(*) FILTER (WHERE e>=0.75 AND c>=0.45 AND v>=0.45) AS strict, count(*) FILTER (WHERE e>=0.75 AND coalesce(c,9)>=0.45 AND coalesce(v,9)>=0.45) AS available FROM t",
    "one_per_system": f"WITH {_CUST}, t AS (SELECT *, CASE WHEN key%7=0 THEN NULL WHEN key%3=0 THEN 'S' || (key%11) END sys FROM c), r AS (SELECT *, row_number() OVER (PARTITION BY nation, sys ORDER BY conf DESC, key) n FROM t) SELECT nation, count(*) AS n, CAST(sum(key) AS BIGINT) AS keys FROM r WHERE sys IS NULL OR n=1 GROUP BY nation",
    "physical_screen": "SELECT count(*) FILTER (WHERE (l_quantity-25)*2 BETWEEN -35 AND 35 AND l_tax<=0.10 AND 295+l_discount*100>=299.15 AND l_quantity+40>=55 AND (CASE WHEN l_quantity>=25 THEN 1 ELSE -1 END)*(l_quantity-20)*1e-6>=1e-5 AND l_quantity*-10<=-100 AND 50-l_quantity<=15 AND (l_quantity-40)*-1e-6<=-1e-6) AS candidates, count(*) AS cells FROM lineitem",
    "top_k_per_group": f"WITH {_CUST}, r AS (SELECT *, row_number() OVER (PARTITION BY nation ORDER BY conf DESC, key) n FROM c) SELECT nation, n AS rank, key, conf FROM r WHERE n<=3",
    "box_anomaly": _box(3, False),
    "clipped_box_mean": _box(2, True),
    "gradient": "WITH t AS (SELECT event_type, hour(ts) h, count(*)::DOUBLE n FROM events GROUP BY 1,2) SELECT event_type, CAST(h AS INT) AS h, n, round((coalesce(lead(n) OVER w,n)-coalesce(lag(n) OVER w,n))/(coalesce(lead(h) OVER w,h)-coalesce(lag(h) OVER w,h)),9) AS slope FROM t WINDOW w AS (PARTITION BY event_type ORDER BY h)",
    "divergence": f"WITH {_LATT}, t AS (SELECT (r-20)::DOUBLE la, c::DOUBLE lo, v u, o w FROM g), x AS (SELECT *, (coalesce(lead(u) OVER a,u)-coalesce(lag(u) OVER a,u))/(radians(coalesce(lead(lo) OVER a,lo))-radians(coalesce(lag(lo) OVER a,lo))) du, (coalesce(lead(w) OVER b,w)-coalesce(lag(w) OVER b,w))/(radians(coalesce(lead(la) OVER b,la))-radians(coalesce(lag(la) OVER b,la))) dv FROM t WINDOW a AS (PARTITION BY la ORDER BY lo), b AS (PARTITION BY lo ORDER BY la)) SELECT la AS lat, lo AS lon, round((du/(6371008.8*greatest(cos(radians(la)),0.1))+dv/6371008.8)*1e6,6) AS divergence FROM x",
    "bilinear": f"WITH {_LATT}, p AS (SELECT r, c FROM g) SELECT r*50+c AS k, CASE WHEN count(v)=4 THEN round(sum(w*v),6) END AS value FROM (SELECT p.r, p.c, (CASE WHEN i=1 THEN 0.25::DOUBLE ELSE 0.75::DOUBLE END)*0.5::DOUBLE w, g.v FROM p CROSS JOIN (VALUES (0),(1)) a(i) CROSS JOIN (VALUES (0),(1)) b(j) LEFT JOIN g ON g.r=p.r+i AND g.c=p.c+j) GROUP BY r, c",
    "channel_stats": f"WITH {_MEAS} SELECT variable, count(*) AS n, round(avg(value),6) AS mean, round(stddev_pop(value)+1e-6,6) AS std FROM m GROUP BY 1",
    "zscore_project": f"WITH {_MEAS}, s AS (SELECT variable, avg(value) a, stddev_pop(value)+1e-6 d FROM m GROUP BY 1) SELECT variable, round(min((value-a)/d),6) AS low, round(max((value-a)/d),6) AS high, round(avg(abs((value-a)/d)),6) AS mean_abs FROM m JOIN s USING (variable) GROUP BY 1",
    "sampled_stats": "WITH t AS (SELECT l_orderkey%1000 f, l_returnflag variable, l_quantity value FROM lineitem), n AS (SELECT f, row_number() OVER (ORDER BY f) i, count(*) OVER () k FROM (SELECT DISTINCT f FROM t)) SELECT variable, round(avg(value),6) AS mean, round(sqrt(greatest(var_pop(value),1e-8)),6) AS std FROM t WHERE f IN (SELECT f FROM n WHERE (i-1)%greatest(1,k//100)=0) GROUP BY 1",
    "channel_stack": "SELECT l_orderkey, string_agg(CAST(CAST(q AS INT) AS VARCHAR), ',' ORDER BY l_linenumber) AS stack FROM (SELECT l_orderkey, l_linenumber, max(l_quantity) q FROM lineitem GROUP BY 1,2) GROUP BY 1",
    "unit_harmony": "WITH t AS (SELECT p_partkey%4 i, p_size/20.0::DOUBLE x FROM part) SELECT CASE i WHEN 0 THEN 'rhprs' WHEN 1 THEN 'pressfc' WHEN 2 THEN 'hgtprs' ELSE 'landmask' END AS variable, round(sum(CASE i WHEN 0 THEN x*100 WHEN 1 THEN x*100 WHEN 2 THEN x/9.80665::DOUBLE ELSE least(1.0,x) END),4) AS total, round(max(CASE i WHEN 0 THEN x*100 WHEN 1 THEN x*100 WHEN 2 THEN x/9.80665::DOUBLE ELSE least(1.0,x) END),6) AS top FROM t GROUP BY i",
    "standard_axes": f"WITH {_CUST}, t AS (SELECT lat, ((floor(lon/10)*10)%360+360)%360 lon, key FROM c) SELECT lat, lon, min(key) AS key FROM t GROUP BY 1,2",
    "environment_metrics": "WITH t AS (SELECT l_orderkey%500 det, l_linenumber i, l_returnflag='A' hi, l_linestatus='O' ctr, l_quantity v FROM lineitem), a AS (SELECT det, avg(v) FILTER (WHERE i=1) lf, avg(v) FILTER (WHERE i=2 AND ctr)-avg(v) FILTER (WHERE i=2) pa, avg(v) FILTER (WHERE i=3) rh, avg(v) FILTER (WHERE i=4 AND NOT hi) u8, avg(v) FILTER (WHERE i=4 AND hi) u2, avg(v) FILTER (WHERE i=5 AND NOT hi) v8, avg(v) FILTER (WHERE i=5 AND hi) v2, avg(v) FILTER (WHERE i=6) vo, avg(v) FILTER (WHERE i=7) ts FROM t GROUP BY det) SELECT det, round(lf,6) AS land_fraction, round(pa,6) AS pressure_anomaly_pa, round(rh,6) AS midlevel_rh_percent, round(vo,6) AS vorticity_850_s1, round(ts,6) AS surface_temperature_k, round(sqrt(pow(u2-u8,2)+pow(v2-v8,2)),6) AS shear_200_850_ms FROM a",
    "contingency": f"WITH {_SCORE}, t AS (SELECT (count(*) FILTER (WHERE y=1 AND p>=0.5)) tp, (count(*) FILTER (WHERE y=0 AND p>=0.5)) fp, (count(*) FILTER (WHERE y=1 AND p<0.5)) fn, (count(*) FILTER (WHERE y=0 AND p<0.5)) tn FROM z), u AS (SELECT *, (tp+tn)/(tp+fp+fn+tn) a, tp/(tp+fp+1e-6) pr, tp/(tp+fn+1e-6) rc FROM t) SELECT tp, fp, fn, tn, round(a,9) AS accuracy, round(pr,9) AS precision, round(rc,9) AS recall, round(2*pr*rc/(pr+rc+1e-6),9) AS f1, round(tp/greatest(tp+fp+fn,1),9) AS csi FROM u",
    "model_table": f"WITH {_SCORE}, b AS (SELECT 'a' model, y, p FROM z UNION ALL SELECT 'b', y, 1-p FROM z), t AS (SELECT model, (count(*) FILTER (WHERE y=1 AND p>=0.5)) tp, (count(*) FILTER (WHERE y=0 AND p>=0.5)) fp, (count(*) FILTER (WHERE y=1 AND p<0.5)) fn, (count(*) FILTER (WHERE y=0 AND p<0.5)) tn FROM b GROUP BY model), u AS (SELECT *, (tp+tn)/(tp+fp+fn+tn) a, tp/(tp+fp+1e-6) pr, tp/(tp+fn+1e-6) rc FROM t), k AS (SELECT model, y, rank() OVER (PARTITION BY model ORDER BY p)+(count(*) OVER (PARTITION BY model, p)-1)/2.0::DOUBLE r FROM b), v AS (SELECT model, (sum(r) FILTER (WHERE y=1)-sum(y)*(sum(y)+1)/2.0::DOUBLE)/(sum(y)*sum(1-y)) auc FROM k GROUP BY model) SELECT model, round(a,9) AS accuracy, round(auc,9) AS roc_auc, round(pr,9) AS precision, round(rc,9) AS recall, round(2*pr*rc/(pr+rc+1e-6),9) AS f1 FROM u JOIN v USING (model)",
    "classification_report": f"WITH {_SCORE}, t AS (SELECT y, (p>=0.5)::INT q FROM z), k AS (SELECT x, (SELECT count(*) FROM t WHERE y=x) s, (SELECT count(*) FROM t WHERE q=x) d, (SELECT count(*) FROM t WHERE y=x AND q=x) h FROM (VALUES (0),(1)) v(x)), r AS (SELECT CAST(x AS VARCHAR) class, coalesce(h/nullif(d,0),0)::DOUBLE pr, coalesce(h/nullif(s,0),0)::DOUBLE rc, s FROM k), f AS (SELECT *, coalesce(2*pr*rc/nullif(pr+rc,0),0) f1 FROM r) SELECT class, round(pr,9) AS precision, round(rc,9) AS recall, round(f1,9) AS f1, s AS support FROM f UNION ALL SELECT 'macro avg', round(avg(pr),9), round(avg(rc),9), round(avg(f1),9), CAST(sum(s) AS BIGINT) FROM f UNION ALL SELECT 'weighted avg', round(sum(pr*s)/sum(s),9), round(sum(rc*s)/sum(s),9), round(sum(f1*s)/sum(s),9), CAST(sum(s) AS BIGINT) FROM f",
    "roc_auc": f"WITH {_SCORE}, k AS (SELECT y, rank() OVER (ORDER BY p)+(count(*) OVER (PARTITION BY p)-1)/2.0::DOUBLE r FROM z) SELECT round((sum(r) FILTER (WHERE y=1)-sum(y)*(sum(y)+1)/2.0::DOUBLE)/(sum(y)*sum(1-y)),9) AS roc_auc FROM k",
    "pr_auc": f"WITH {_CURVE} SELECT round(sum((rc-lrc)*(pr+lpr)/2),9) AS pr_auc FROM l",
    "average_precision": f"WITH {_CURVE} SELECT round(sum((rc-lrc)*pr),9) AS average_precision FROM l",
    "brier_log_loss": f"WITH {_SCORE}, t AS (SELECT y, p, greatest(1e-15,least(1-1e-15,p)) q FROM z) SELECT round(avg(pow(p-y,2)),9) AS brier, round(avg(-(y*ln(q)+(1-y)*ln(1-q))),9) AS log_loss FROM t",
    "calibration_error": f"WITH {_SCORE}, b AS (SELECT y, p, (SELECT count(*) FROM range(1,10) e(i) WHERE p > i/10.0::DOUBLE) b FROM z), g AS (SELECT count(*) n, avg(y) a, avg(p) c FROM b GROUP BY b) SELECT round(sum(n*abs(a-c))/sum(n),9) AS ece FROM g",
    "threshold_pick": f"WITH {_CURVE}, f AS (SELECT *, coalesce(2*pr*rc/nullif(pr+rc,0),0) f1 FROM k) SELECT round(p,9) AS threshold, round(pr,9) AS precision, round(rc,9) AS recall, round(f1,9) AS f1 FROM f ORDER BY f.f1 DESC, p LIMIT 1",
    "threshold_recall": f"WITH {_CURVE}, f AS (SELECT *, coalesce(2*pr*rc/nullif(pr+rc,0),0) f1 FROM k WHERE rc>=0.9) SELECT round(p,9) AS threshold, round(pr,9) AS precision, round(rc,9) AS recall, round(f1,9) AS f1 FROM f ORDER BY pr DESC, p DESC LIMIT 1",
    "threshold_sweep": f"WITH {_SCORE}, g AS (SELECT 0.2::DOUBLE+0.6::DOUBLE*i/120 t FROM range(121) r(i)), c AS (SELECT t, sum(y) FILTER (WHERE p>=t-1e-11) tp, sum(1-y) FILTER (WHERE p>=t-1e-11) fp, sum(y) FILTER (WHERE p<t-1e-11) fn FROM g, z GROUP BY t), d AS (SELECT t, coalesce(tp,0) tp, coalesce(fp,0) fp, coalesce(fn,0) fn FROM c), r AS (SELECT t, coalesce(tp/nullif(tp+fp,0),0) pr, coalesce(tp/nullif(tp+fn,0),0) rc, tp/greatest(tp+fp+fn,1) csi FROM d) SELECT round(t,9) AS threshold, round(pr,9) AS precision, round(rc,9) AS recall, round(csi,9) AS csi FROM r ORDER BY csi+0.15*pr DESC, t DESC LIMIT 1",
    "distribution": "SELECT l_returnflag, round(min(l_extendedprice),6) AS min, round(avg(l_extendedprice),6) AS mean, round(quantile_cont(l_extendedprice,0.5),6) AS median, round(quantile_cont(l_extendedprice,0.95),6) AS p95, round(quantile_cont(l_extendedprice,0.99),6) AS p99, round(max(l_extendedprice),6) AS max FROM lineitem GROUP BY 1",
    "outcome_counts": f"WITH {_SCORE} SELECT CASE WHEN y=1 AND p>=0.6 THEN 'TP' WHEN y=1 THEN 'FN' WHEN p>=0.6 THEN 'FP' ELSE 'TN' END AS outcome, count(*) AS n FROM z GROUP BY 1",
    "weighted_circular_mean": f"WITH {_CUST} SELECT nation, round(degrees(atan2(sum((conf+1000)*sin(radians(lon)))/sum(conf+1000),sum((conf+1000)*cos(radians(lon)))/sum(conf+1000))),6) AS lon FROM c GROUP BY nation",
    "haversine_forms": f"WITH {_CUST} SELECT key, round({_hav('lat', 'lon', '10.0', '170.0')},6) AS km, round({_hav('lat', 'lon', '10.0', '170.0', 6371.0)},6) AS km_atan2 FROM c",
    "longitudes": f"WITH {_CUST}, t AS (SELECT key, ((lon*3+0.5)%360+360)%360 x FROM c) SELECT key, CASE WHEN x>180 THEN x-360 ELSE x END AS lon180, x AS lon360 FROM t",
    "logistic_score": "WITH t AS (SELECT l_returnflag, l_quantity q, CASE WHEN l_linenumber<>3 THEN l_discount ELSE 0.05::DOUBLE END d FROM lineitem), u AS (SELECT *, 1/(1+exp(-(-0.2+0.7*(q-25)/14-0.4*(d-0.05::DOUBLE)/0.03::DOUBLE))) p FROM t) SELECT l_returnflag, count(*) AS n, round(avg(p),9) AS mean_p, round(max(p),9) AS max_p, count(*) AS in_distribution FROM u GROUP BY 1",
    "soft_support": f"SELECT l_returnflag, round(avg({_ENV}),9) AS mean, round(max({_ENV}),9) AS top FROM lineitem GROUP BY 1",
    "six_rules": f"SELECT CAST({_CHECKS} AS BIGINT) AS checks, count(*) AS n FROM lineitem GROUP BY 1",
    "hybrid_support": f"SELECT l_linestatus, round(avg({_HYB}),9) AS mean, round(min({_HYB}),9) AS low FROM lineitem GROUP BY 1",
    "rule_cascade": f"""WITH t AS (SELECT l_linenumber n, l_quantity*20 d, l_quantity a, CASE WHEN l_linenumber=5 OR l_discount>0.06::DOUBLE THEN l_tax*12 END p, {_LAND} land, {_RH} rh, {_SHEAR} shear, {_VORT} v, {_CHECKS} k, l_discount*9 h FROM lineitem),
r AS (SELECT CASE WHEN n=1 AND d<=600 AND a<=36 THEN {{'c':'ACTIVE_CYCLONE','x':0.95::DOUBLE}} WHEN n=2 AND d<=400 AND a<=48 AND rh>=60 AND shear<=25 AND v>=7.5e-6 THEN {{'c':'ACTIVE_DEPRESSION','x':0.90::DOUBLE}}
WHEN n IN (2,4) AND d<=650 AND a<=48 AND p>=0.5 THEN {{'c':'NEW_GENESIS_CANDIDATE','x':p}} WHEN n IN (2,4) AND d<=650 AND a<=48 AND p IS NOT NULL THEN {{'c':'INVEST_OR_DEVELOPING_SYSTEM','x':1-p}}
WHEN n IN (2,4) AND d<=650 AND a<=48 AND k>=4 THEN {{'c':'NEW_GENESIS_CANDIDATE','x':greatest(0.55::DOUBLE,least(0.95::DOUBLE,h))}} WHEN n IN (2,4) AND d<=650 AND a<=48 THEN {{'c':'INVEST_OR_DEVELOPING_SYSTEM','x':greatest(0.50::DOUBLE,least(0.85::DOUBLE,h))}}
WHEN n=3 AND d<=500 AND a<=72 THEN {{'c':'RECENT_DECAYING_SYSTEM','x':0.88::DOUBLE}} WHEN n=1 AND d<=500 AND a<=72 THEN {{'c':'RECENT_TRACKED_CYCLONE','x':0.82::DOUBLE}} WHEN land>=0.20 AND rh>=60 THEN {{'c':'MONSOON_OR_LAND_LOW','x':0.72::DOUBLE}}
WHEN p>=0.75 THEN {{'c':'HIGH_PRIORITY_MODEL_GENESIS_CANDIDATE','x':p}} WHEN p>=0.5 THEN {{'c':'MODEL_GENESIS_CANDIDATE','x':p}} WHEN p<=0.25 THEN {{'c':'LOW_SUPPORT_DISTURBANCE','x':1-p}}
WHEN k>=6 THEN {{'c':'HIGH_PRIORITY_MODEL_GENESIS_CANDIDATE','x':greatest(0.70::DOUBLE,least(0.95::DOUBLE,h))}} WHEN k>=5 THEN {{'c':'MODEL_GENESIS_CANDIDATE','x':greatest(0.62::DOUBLE,least(0.90::DOUBLE,h))}} WHEN k>=4 THEN {{'c':'POSSIBLE_MODEL_GENESIS_CANDIDATE','x':greatest(0.52::DOUBLE,least(0.80::DOUBLE,h))}}
WHEN land<=0.15::DOUBLE AND rh>=50 AND v>=4e-6 THEN {{'c':'UNVERIFIED_TROPICAL_DISTURBANCE','x':greatest(0.40::DOUBLE,least(0.70::DOUBLE,h))}} ELSE {{'c':'UNCLASSIFIED_DISTURBANCE','x':0.40::DOUBLE}} END r FROM t)
SELECT r.c AS system_class, count(*) AS n, round(sum(r.x),4) AS confidence FROM r GROUP BY 1""",
    "text_fields": f"WITH {_CUST} SELECT key, lat, CASE WHEN (key%16)/2.0>=5 THEN 'TY' WHEN (key%16)/2.0>=3.5 THEN 'TS' WHEN (key%16)/2.0>=2 THEN 'TD' ELSE 'DB' END AS status, CASE key%4 WHEN 0 THEN 'Western Pacific' WHEN 1 THEN 'North Indian Ocean' WHEN 3 THEN 'North Atlantic' END AS basin, CASE WHEN key%3=1 THEN 'A' || key ELSE 'UNNAMED' END AS name, CASE WHEN key%2=1 THEN CAST(key AS DOUBLE) END AS number FROM c",
    "name_times": "SELECT event_id, CASE WHEN event_id%3<2 THEN date_trunc('hour',ts)::TIMESTAMP END AS t, strftime(time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2000-01-01'), 'fnl_%Y%m%d_%H_00.grib2') AS archive FROM events",
    "bulletin_times": "SELECT event_id, date_trunc('minute', ts + INTERVAL 1 HOUR * (event_id%80-40))::TIMESTAMP AS t FROM events",
    "physics_scalars": "WITH t AS (SELECT l_linenumber, l_quantity q, l_discount x, greatest(1e-6,least(1-1e-6,l_discount*10)) c FROM lineitem) SELECT l_linenumber, round(sum(ln(c/(1-c))),4) AS logit, round(sum(sqrt(pow(10-q,2)+pow(2-x,2))),4) AS shear, round(sum(CASE WHEN q>=25 THEN q ELSE -q END),4) AS cyclonic, round(sum(greatest(10.0,least(30.0,q))),4) AS clamped, round(sum(greatest(0.0,least(1.0,q/25-0.5))),4) AS clipped, round(sum(round(x*1000)),2) AS rounded FROM t GROUP BY 1",
    "attribution_share": "WITH t AS (SELECT l_orderkey%300 det, 'v' || l_linenumber variable, avg(abs(l_quantity-25)) m, sum(abs(l_quantity-25)) s FROM lineitem GROUP BY 1,2) SELECT det, variable, round(coalesce(m/nullif(sum(m) OVER (PARTITION BY det),0),0),9) AS mean_share, round(coalesce(s/nullif(sum(s) OVER (PARTITION BY det),0),0),9) AS column_share FROM t",
    "importance": "SELECT 'variable' AS kind, l_returnflag AS name, round(100*sum(l_quantity)/(SELECT sum(l_quantity) FROM lineitem),9) AS percent FROM lineitem GROUP BY 2 UNION ALL SELECT 'level', CAST(l_linenumber AS VARCHAR), round(100*sum(l_quantity)/(SELECT sum(l_quantity) FROM lineitem),9) FROM lineitem GROUP BY 2",
    "top_drivers": "WITH e AS (SELECT * FROM events WHERE event_id%2=0), n AS (SELECT count(*) k FROM e), u AS (SELECT event_type name, value v FROM e UNION ALL SELECT 'base', 1.0 FROM e) SELECT name, round(sum(v)/any_value(k),6) AS mean FROM u, n GROUP BY name ORDER BY mean DESC, name LIMIT 4",
    "bend_points": "WITH t AS (SELECT event_type, hour(ts) h, round(sum(value),2) v FROM events GROUP BY 1,2), a AS (SELECT *, (coalesce(lead(v) OVER w,v)-coalesce(lag(v) OVER w,v))/(coalesce(lead(h) OVER w,h)-coalesce(lag(h) OVER w,h)) d FROM t WINDOW w AS (PARTITION BY event_type ORDER BY h)), b AS (SELECT *, (coalesce(lead(d) OVER w,d)-coalesce(lag(d) OVER w,d))/(coalesce(lead(h) OVER w,h)-coalesce(lag(h) OVER w,h)) e, lead(h) OVER w IS NULL z FROM a WINDOW w AS (PARTITION BY event_type ORDER BY h)) SELECT event_type, CAST(arg_max(h,e) AS INT) AS steepest_at, CAST(arg_min(h,e) AS INT) AS flattest_at FROM b WHERE NOT z GROUP BY 1",
    "json_roundtrip": "SELECT event_type, count(k) AS n, sum(k) AS total FROM (SELECT event_type, CAST(props->>'$.k' AS DOUBLE) k FROM events) GROUP BY 1",
    "six_hour_tumbling": f"SELECT {_CYCLE} AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "operational_scan": f"""WITH RECURSIVE {_CUST}, {_SUPP}, g AS (SELECT *, (conf+1000)/11000::DOUBLE p FROM c WHERE (conf+1000)/11000::DOUBLE>=0.3::DOUBLE), o AS (SELECT *, row_number() OVER (PARTITION BY nation ORDER BY p DESC, key) rn FROM g),
f AS (SELECT nation, CAST(0 AS BIGINT) rn, CAST([] AS STRUCT(k BIGINT, p DOUBLE, la DOUBLE, lo DOUBLE)[]) kept FROM o GROUP BY nation UNION ALL SELECT f.nation, f.rn+1, CASE WHEN len(list_filter(f.kept, lambda x: {_hav('x.la', 'x.lo', 'o.lat', 'o.lon')}<=1500))=0 THEN list_append(f.kept, {{'k':o.key,'p':o.p,'la':o.lat,'lo':o.lon}}) ELSE f.kept END FROM f JOIN o ON o.nation=f.nation AND o.rn=f.rn+1),
l AS (SELECT nation, unnest(arg_max(kept, rn)) x FROM f GROUP BY nation), k AS (SELECT nation, x.k AS key, x.p AS p, x.la AS lat, x.lo AS lon FROM l),
e AS (SELECT k.*, skey, CASE WHEN skey IS NOT NULL THEN {_hav('k.lat', 'k.lon', 'slat', 'slon')} END km, abs(24-skey%48)::DOUBLE h FROM k LEFT JOIN s ON k.nation=s.nation), n AS (SELECT *, row_number() OVER (PARTITION BY nation, key ORDER BY km+5*h, CAST(skey AS VARCHAR)) i FROM e),
q AS (SELECT *, CASE skey%4 WHEN 0 THEN 'TS' WHEN 1 THEN 'DB' WHEN 2 THEN 'EX' WHEN 3 THEN 'INVEST' END st, CASE WHEN key%5<>0 THEN 0.9::DOUBLE ELSE 0.0::DOUBLE END cn FROM n WHERE i=1),
y AS (SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.50*(({_soft('0.05::DOUBLE', '0.15', '0.08', False)}+{_soft('70.0::DOUBLE', '55', '10', True)}+{_soft('10.0::DOUBLE', '20', '5', False)}+{_soft('2e-5', '7.5e-6', '1.5e-5', True)}+{_soft('-100.0::DOUBLE', '0', '250', False)}+{_soft('301.0::DOUBLE', '299', '1.5', True)})/6)+0.30*(0.5*p+0.25*cn+0.25*0.8::DOUBLE)+0.12*0.75::DOUBLE+0.08*(1-abs(cn-0.8::DOUBLE)))) hy FROM q),
v AS (SELECT *, CASE WHEN km<=600 AND h<=36 AND st='TS' THEN {{'c':'ACTIVE_CYCLONE','x':0.95::DOUBLE}} WHEN km<=400 AND h<=48 AND st='DB' THEN {{'c':'ACTIVE_DEPRESSION','x':0.90::DOUBLE}} WHEN km<=650 AND h<=48 AND st IN ('DB','INVEST') THEN {{'c':'NEW_GENESIS_CANDIDATE','x':greatest(0.55::DOUBLE,least(0.95::DOUBLE,hy))}} WHEN km<=500 AND h<=72 AND st='EX' THEN {{'c':'RECENT_DECAYING_SYSTEM','x':0.88::DOUBLE}} WHEN km<=500 AND h<=72 AND st='TS' THEN {{'c':'RECENT_TRACKED_CYCLONE','x':0.82::DOUBLE}} ELSE {{'c':'HIGH_PRIORITY_MODEL_GENESIS_CANDIDATE','x':greatest(0.70::DOUBLE,least(0.95::DOUBLE,hy))}} END r, CASE WHEN km<=3000 THEN skey END sys FROM y),
w AS (SELECT *, row_number() OVER (PARTITION BY nation, sys ORDER BY p DESC, key) j FROM v), z AS (SELECT *, row_number() OVER (PARTITION BY nation ORDER BY p DESC, key) rk FROM w WHERE sys IS NULL OR j=1)
SELECT nation AS cycle, rk AS rank, key, CAST(skey AS VARCHAR) AS storm_id, round(km,6) AS distance_km, r.c AS system_class, round(r.x,9) AS class_confidence FROM z WHERE rk<=10""",
    "cycle_verification": f"""WITH RECURSIVE {_CUST}, {_SUPP}, raw AS (SELECT *, (conf+1000)/11000::DOUBLE p FROM c WHERE (conf+1000)/11000::DOUBLE>=0.4::DOUBLE AND key%5<>0),
e AS (SELECT a.nation, a.key a, b.key b FROM raw a JOIN raw b ON a.nation=b.nation AND {_hav('a.lat', 'a.lon', 'b.lat', 'b.lon')}<=900), r AS (SELECT nation, a AS key, a AS x FROM e UNION SELECT r.nation, r.key, e.b FROM r JOIN e ON e.a=r.x), cl AS (SELECT nation, key, min(x) AS cluster FROM r GROUP BY nation, key),
rep AS (SELECT nation, cluster, sum(p*lat)/sum(p) lat, degrees(atan2(sum(p*sin(radians(lon)))/sum(p),sum(p*cos(radians(lon)))/sum(p))) lo FROM cl JOIN raw USING (nation, key) GROUP BY nation, cluster), rp AS (SELECT nation, cluster, lat, CASE WHEN lo<=-180 THEN 180 ELSE lo END lon FROM rep),
cyc AS (SELECT DISTINCT nation FROM c), due AS (SELECT cyc.nation, skey, slat, slon, 'E' || (skey%9) nm FROM cyc JOIN s ON skey%60-cyc.nation BETWEEN 18 AND 30),
pr AS (SELECT rp.nation, cluster, skey, {_hav('lat', 'lon', 'slat', 'slon')} km FROM rp JOIN due ON due.nation=rp.nation AND {_hav('lat', 'lon', 'slat', 'slon')}<=1200), o AS (SELECT *, row_number() OVER (PARTITION BY nation ORDER BY km, cluster, skey) rn FROM pr),
f AS (SELECT nation, CAST(0 AS BIGINT) rn, CAST([] AS STRUCT(l BIGINT, r BIGINT)[]) kept FROM o GROUP BY nation UNION ALL SELECT f.nation, f.rn+1, CASE WHEN len(list_filter(f.kept, lambda x: x.l=o.cluster OR x.r=o.skey))=0 THEN list_append(f.kept, {{'l':o.cluster,'r':o.skey}}) ELSE f.kept END FROM f JOIN o ON o.nation=f.nation AND o.rn=f.rn+1),
m AS (SELECT nation, x.l AS cluster, x.r AS skey FROM (SELECT nation, unnest(arg_max(kept, rn)) x FROM f GROUP BY nation)),
a AS (SELECT nation, count(*) k FROM raw GROUP BY nation), bp AS (SELECT rp.nation, count(*) np, count(m.skey) h, coalesce(string_agg(DISTINCT 'E' || (m.skey%9), '; ' ORDER BY 'E' || (m.skey%9)), '') nh FROM rp LEFT JOIN m ON m.nation=rp.nation AND m.cluster=rp.cluster GROUP BY rp.nation),
be AS (SELECT due.nation, count(*) ne, count(*)-count(m.skey) mi, string_agg(DISTINCT nm, '; ' ORDER BY nm) ns FROM due LEFT JOIN m ON m.nation=due.nation AND m.skey=due.skey GROUP BY due.nation)
SELECT cyc.nation AS cycle, coalesce(k,0) AS raw_detections, coalesce(np,0) AS predictions, coalesce(ne,0) AS events, coalesce(h,0) AS hits, coalesce(mi,0) AS misses, coalesce(np-h,0) AS false_alarms, coalesce(ns,'') AS names, coalesce(nh,'') AS names_hit FROM cyc LEFT JOIN a USING (nation) LEFT JOIN bp USING (nation) LEFT JOIN be USING (nation)""",
    "training_batches": "WITH n AS (SELECT count(*) FILTER (WHERE c_acctbal>=9000)*4 t, count(*) FILTER (WHERE c_acctbal<9000) k FROM customer) SELECT i AS batch, least(64, t-64*i) AS n FROM n, range(0, 1000000) r(i) WHERE k>0 AND 64*i<t",
    "display_fields": f"WITH {_CUST}, t AS (SELECT key, CASE WHEN key%3=0 THEN key%100+0.5::DOUBLE WHEN key%2=0 THEN (key%50)/50.0::DOUBLE*100 ELSE 0.0::DOUBLE END sc FROM c) SELECT key, round(sc,6) AS score, round(greatest(8.0::DOUBLE,least(15.0::DOUBLE,7+(sc-70)*0.2::DOUBLE)),6) AS radius, CASE WHEN key%80>=60 THEN 'Early Environment Setup' WHEN key%80>=36 THEN 'Vortex Spin-up Phase' ELSE 'Core Inflow Collapse' END AS profile FROM t",
    "balanced_negatives": f"WITH {_CUST}, n AS (SELECT key FROM c WHERE conf<0), k AS (SELECT count(*) m FROM n), d AS (SELECT key, CAST(i AS BIGINT) AS draw FROM n, range(0, 300) r(i), k WHERE i < (300+m-1)//m) SELECT key, draw FROM d ORDER BY draw, md5('0|' || key), key LIMIT 300",
    "geojson_feature": f"""WITH {_CUST} SELECT '{{"type":"Feature","geometry":{{"type":"Point","coordinates":[' || lon || ',' || lat || ']}},"properties":{{"key":' || key || ',"nation":' || nation || '}}}}' AS value FROM c""",
    "system_dedup": f"WITH RECURSIVE {_SUPP}, t AS (SELECT 'S' || (skey%60) id, slat, slon, skey%30 h FROM s), k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY h DESC, slat DESC, slon DESC) n FROM t), o AS (SELECT *, row_number() OVER (ORDER BY h DESC, id) rn FROM k WHERE n=1), f AS (SELECT CAST(0 AS BIGINT) rn, CAST([] AS STRUCT(id VARCHAR, la DOUBLE, lo DOUBLE, h BIGINT)[]) kept UNION ALL SELECT f.rn+1, CASE WHEN len(list_filter(f.kept, lambda x: abs(x.h-o.h)<=12 AND {_hav('x.la', 'x.lo', 'o.slat', 'o.slon')}<=1500))=0 THEN list_append(f.kept, {{'id':o.id,'la':o.slat,'lo':o.slon,'h':o.h}}) ELSE f.kept END FROM f JOIN o ON o.rn=f.rn+1) SELECT x.id AS storm_id, x.la AS latitude, x.lo AS longitude, TIMESTAMP '2024-01-01' + INTERVAL 1 HOUR * x.h AS time FROM (SELECT unnest(arg_max(kept, rn)) x FROM f)",
    "median_impute_scale": "WITH t AS (SELECT l_linenumber, CASE WHEN l_quantity>5 THEN l_quantity END q, l_extendedprice x FROM lineitem), f AS (SELECT l_linenumber, coalesce(q,(SELECT median(q) FROM t)) q, x FROM t), s AS (SELECT avg(q) mq, stddev_pop(q) sq, avg(x) mx, stddev_pop(x) sx FROM f) SELECT l_linenumber, round(avg((q-mq)/sq),6) AS q, round(max((x-mx)/sx),6) AS x FROM f, s GROUP BY 1",
}
