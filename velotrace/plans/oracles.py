"""SQL of the core queries and of problems 1 to 4, for an independent engine over the same tables."""

from __future__ import annotations

from velotrace.functions.geo import CENTRAL_MERIDIAN_DEG, FALSE_EASTING_M, SCALE, krueger
from velotrace.operators.network import CAR_FREE, LANE_TAGS, MAIN, MOTOR, OTHER, REGIMES, TAGS, TRACK_TAGS


def texts(values: list[str]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def projection(lat: str, lon: str) -> tuple[str, str]:
    """x, y as SQL over columns xi and eta, and those over lat and lon."""
    radius, _, series = krueger()
    x, y = "eta", "xi"
    for j, a in enumerate(series, 1):
        x += f" + {a!r} * cos({2.0 * j} * xi) * sinh({2.0 * j} * eta)"
        y += f" + {a!r} * sin({2.0 * j} * xi) * cosh({2.0 * j} * eta)"
    return f"{FALSE_EASTING_M} + {SCALE * radius!r} * ({x})", f"{SCALE * radius!r} * ({y})"


def points_cte() -> str:
    """raw, pts (row_seq, t, value, lat, lon, boxId, boxName, x, y)."""
    _, e, _ = krueger()
    x, y = projection("lat", "lon")
    return f"""
pts0 AS (
  SELECT row_seq, epoch_us(createdAt) AS t, CASE WHEN isnan(v) THEN NULL ELSE v END AS value, lat, lon, boxId, boxName,
    sinh(atanh(sin(radians(lat))) - {e!r} * atanh({e!r} * sin(radians(lat)))) AS tt, radians(lon - {CENTRAL_MERIDIAN_DEG}) AS dl
  FROM (SELECT *, TRY_CAST(value AS DOUBLE) AS v FROM opensensemap_overtaking_distances) r
  WHERE lat IS NOT NULL AND lon IS NOT NULL AND createdAt IS NOT NULL AND boxId IS NOT NULL),
pts1 AS (SELECT *, atan2(tt, cos(dl)) AS xi, atanh(sin(dl) / sqrt(1.0 + tt * tt)) AS eta FROM pts0),
pts AS (SELECT row_seq, t, value, lat, lon, boxId, boxName, {x} AS x, {y} AS y FROM pts1)"""


SEGMENTS = """,
seg0 AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY boxId ORDER BY t, row_seq) <= 600000000 THEN 0 ELSE 1 END AS b FROM pts),
seg1 AS (SELECT *, sum(b) OVER (PARTITION BY boxId ORDER BY t, row_seq ROWS UNBOUNDED PRECEDING) AS no FROM seg0),
seg AS (SELECT * EXCLUDE (b), boxId || '_' || no::BIGINT AS traj_id FROM (SELECT *, count(*) OVER (PARTITION BY boxId, no) AS size FROM seg1) WHERE size >= 5)"""

TRACED = """,
tr0 AS (SELECT *, row_number() OVER w - 1 AS ordinal, lag(x) OVER w AS bx, lag(y) OVER w AS b_y, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM seg WINDOW w AS (PARTITION BY traj_id ORDER BY t, row_seq)),
tr AS (SELECT *, traj_id || '_p' || ordinal AS point_id, coalesce(sqrt((x - bx) * (x - bx) + (y - b_y) * (y - b_y)), 0) AS step_m,
  CASE WHEN ordinal > 0 THEN (degrees(atan2(x - bx, y - b_y)) + 360) % 360 ELSE coalesce((degrees(atan2(nx - x, ny - y)) + 360) % 360, 0) END AS bearing,
  coalesce(value > 0, FALSE) AS hit FROM tr0)"""

RUNS = """,
run0 AS (SELECT traj_id, hit, sum(CASE WHEN hit THEN 0 ELSE 1 END) OVER (PARTITION BY traj_id ORDER BY t, row_seq ROWS UNBOUNDED PRECEDING) AS z FROM tr),
runs AS (SELECT traj_id, max(n)::BIGINT AS longest_nonzero_run FROM (SELECT traj_id, z, count(*) FILTER (hit) AS n FROM run0 GROUP BY traj_id, z) GROUP BY traj_id)"""

QUALITY = """,
st0 AS (SELECT boxId, traj_id, arg_min(struct_pack(n := boxName), (t, row_seq)).n AS boxName, count(*) AS n_points, count(*) FILTER (hit) AS n_nonzero, avg(hit::INT) AS nonzero_share,
  CASE WHEN count(value) = count(*) THEN max(value) END AS value_max, sum(step_m) / 1000 AS length_km, (max(t) - min(t)) / 3.6e9 AS hours FROM tr GROUP BY boxId, traj_id),
st AS (SELECT st0.*, longest_nonzero_run, length_km / nullif(hours, 0) AS mean_speed_kmh, CASE WHEN length_km >= 0.2 THEN n_nonzero / length_km END AS raw_per_km FROM st0 JOIN runs USING (traj_id)),
q0 AS (SELECT *, coalesce(mean_speed_kmh < 3 OR mean_speed_kmh > 40, FALSE) AS f_speed, nonzero_share > 0.4 AS f_nz_share, longest_nonzero_run / n_points > 0.3 AS f_long_run,
  coalesce(raw_per_km > 250, FALSE) AS f_rate, (n_points < 5 OR length_km < 0.2) AS f_too_short FROM st),
q AS (SELECT *, (f_speed::INT + f_nz_share::INT + f_long_run::INT + f_rate::INT + f_too_short::INT) AS n_flags,
  coalesce(nullif(concat_ws(',', CASE WHEN f_speed THEN 'speed' END, CASE WHEN f_nz_share THEN 'nz_share' END, CASE WHEN f_long_run THEN 'long_run' END, CASE WHEN f_rate THEN 'high_rate' END, CASE WHEN f_too_short THEN 'too_short' END), ''), 'ok') AS flag_reasons,
  NOT (f_speed OR f_nz_share OR f_long_run OR f_rate OR f_too_short) AS keep FROM q0)"""

EVENTS = """,
hits AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY traj_id ORDER BY t, row_seq) <= 3000000 THEN 0 ELSE 1 END AS nw FROM tr WHERE value > 0),
hit_no AS (SELECT *, (sum(nw) OVER (PARTITION BY traj_id ORDER BY t, row_seq ROWS UNBOUNDED PRECEDING))::BIGINT AS event_id FROM hits),
ev AS (SELECT traj_id || '_ev' || event_id AS event_uid, traj_id, event_id, boxId, min(t) AS start_us, max(t) AS end_us, (max(t) - min(t)) / 1e6 AS duration_s, count(*) AS n_samples,
  min(value) AS min_clearance_cm, avg(value) AS mean_clearance_cm, min(value) < 150 AS is_close, arg_min(point_id, (t, row_seq)) AS first_point_id, arg_max(point_id, (t, row_seq)) AS last_point_id,
  arg_min(point_id, (value, t, row_seq)) AS closest_point_id, arg_min(x, (value, t, row_seq)) AS x, arg_min(y, (value, t, row_seq)) AS y FROM hit_no GROUP BY boxId, traj_id, event_id)"""

LINKED = """
mp AS (SELECT point_id, arg_min(struct_pack(u := u, v := v), (loaded_at, u, v)) AS uv FROM matched_points WHERE u IS NOT NULL AND point_id IS NOT NULL GROUP BY point_id),
oe AS (SELECT DISTINCT event_uid, closest_point_id, first_point_id, last_point_id FROM overtake_events),
li AS (SELECT event_uid, coalesce(c.uv, f.uv, l.uv).u AS u, coalesce(c.uv, f.uv, l.uv).v AS v FROM oe LEFT JOIN mp c ON c.point_id = closest_point_id LEFT JOIN mp f ON f.point_id = first_point_id LEFT JOIN mp l ON l.point_id = last_point_id),
ec AS (SELECT least(u, v) AS a, greatest(u, v) AS b, arg_min(struct_pack(c := edge_class), (u, v, key)).c AS edge_class FROM muenster_edges_classified WHERE u IS NOT NULL AND v IS NOT NULL GROUP BY 1, 2),
lc AS (SELECT event_uid, u, v, edge_class FROM li LEFT JOIN ec ON a = least(u, v) AND b = greatest(u, v) AND u IS NOT NULL AND v IS NOT NULL)"""


def tag(name: str) -> str:
    c = f'"{name}"'
    many = f"coalesce(list_filter({c}, lambda z: z IS NOT NULL AND z NOT IN ('no', 'none'))[1], 'no')"
    return f"CASE WHEN {c} IS NULL THEN '' WHEN len({c}) = 1 THEN coalesce({c}[1], '') ELSE {many} END"


def edges_cte() -> str:
    """ed: one row per (u, v, key) with tags as text."""
    return f"""
ed0 AS (SELECT *, row_number() OVER (PARTITION BY u, v, key ORDER BY (geometry IS NOT NULL) DESC, length DESC NULLS LAST) AS rn FROM muenster_edges_classified),
ed AS (SELECT u, v, key, length, geometry, is_sidepath, {", ".join(f'"{c}"' for c in TAGS)}, {tag("highway")} AS hw, {tag("cycleway")} AS c0, {tag("cycleway:left")} AS c1, {tag("cycleway:right")} AS c2, {tag("cycleway:both")} AS c3,
  {tag("cyclestreet")} AS cs, {tag("bicycle_road")} AS br FROM ed0 WHERE rn = 1)"""


def classes_cte(source: str) -> str:
    """cl: edges of source (with hw, c0.., is_sidepath) with matched rules m and edge_class."""
    some = lambda v: " OR ".join(f"c{i} IN {texts(v)}" for i in range(4))
    own = "hw IN ('cycleway', 'path', 'footway')"
    side = "coalesce(is_sidepath, FALSE)"
    rules = [
        "cs = 'yes' OR br = 'yes'", f"{own} AND {side}", some(TRACK_TAGS), f"{own} AND NOT {side}", some(LANE_TAGS), "hw = 'pedestrian'", "hw IN ('residential', 'living_street')",
        "hw = 'service'", "hw IN ('track', 'bridleway')", "hw = 'busway'", "hw = 'unclassified'", f"hw IN {texts(MAIN)}",
    ]
    label = " ".join(f"WHEN m[1] = {i} THEN '{n}'" for i, n in enumerate(REGIMES, 1))
    matched = "list_filter([" + ", ".join(f"CASE WHEN {r} THEN {i} END" for i, r in enumerate(rules, 1)) + "], lambda z: z IS NOT NULL)"
    return f",\ncl0 AS (SELECT *, {matched} AS m FROM {source}),\ncl AS (SELECT *, CASE {label} ELSE '{OTHER}' END AS edge_class FROM cl0)"


def point_segment(px: str, py: str, x0: str, y0: str, x1: str, y1: str) -> str:
    ll = f"(({x1} - {x0}) * ({x1} - {x0}) + ({y1} - {y0}) * ({y1} - {y0}))"
    u = f"greatest(0.0, least(1.0, coalesce((({px} - {x0}) * ({x1} - {x0}) + ({py} - {y0}) * ({y1} - {y0})) / nullif({ll}, 0), 0.0)))"
    dx, dy = f"({px} - ({x0} + {u} * ({x1} - {x0})))", f"({py} - ({y0} + {u} * ({y1} - {y0})))"
    return f"sqrt({dx} * {dx} + {dy} * {dy})"


def roads_cte() -> str:
    """nr: nearest motor road of each car-free edge, by all pairs of segments whose boxes come near; sp: edges with is_sidepath anew."""
    side = lambda p, q, r: f"(({q}.x - {p}.x) * ({r}.y - {p}.y) - ({q}.y - {p}.y) * ({r}.x - {p}.x))"
    cross = f"{side('a.p', 'a.q', 'b.p')} * {side('a.p', 'a.q', 'b.q')} < 0 AND {side('b.p', 'b.q', 'a.p')} * {side('b.p', 'b.q', 'a.q')} < 0"
    seg = lambda z: (f"{z}.p.x", f"{z}.p.y", f"{z}.q.x", f"{z}.q.y")
    ends = ", ".join(
        point_segment(f"{p}.{e}.x", f"{p}.{e}.y", *seg(o)) for p, o in (("a", "b"), ("b", "a")) for e in ("p", "q")
    )
    return f""",
ge AS (SELECT u, v, key, hw, unnest(list_zip(geometry[1:len(geometry) - 1], geometry[2:])) AS s FROM ed WHERE geometry IS NOT NULL),
sg AS (SELECT u, v, key, hw, s[1] AS p, s[2] AS q, least(s[1].x, s[2].x) AS lx, greatest(s[1].x, s[2].x) AS hx, least(s[1].y, s[2].y) AS ly, greatest(s[1].y, s[2].y) AS hy FROM ge),
gb AS (SELECT *, unnest(range(floor((lx - 31) / 200)::BIGINT, floor((hx + 31) / 200)::BIGINT + 1)) AS gx FROM sg),
ca AS (SELECT * FROM gb WHERE hw IN {texts(CAR_FREE)}),
mo AS (SELECT * FROM gb WHERE hw IN {texts(MOTOR)}),
pr AS (SELECT a.u, a.v, a.key, b.u AS ru, b.v AS rv, b.key AS rk, CASE WHEN {cross} THEN 0.0 ELSE least({ends}) END AS d
  FROM ca a JOIN mo b ON a.gx = b.gx AND b.lx <= a.hx + 30.5 AND b.hx >= a.lx - 30.5 AND b.ly <= a.hy + 30.5 AND b.hy >= a.ly - 30.5),
nr AS (SELECT u, v, key, min(d) AS dist_to_road, arg_min(struct_pack(u := ru, v := rv, k := rk), (d, ru, rv, rk)) AS road FROM pr WHERE d <= 30 GROUP BY u, v, key){bearing_cte()},
sp AS (SELECT ed.* EXCLUDE (is_sidepath), coalesce(dist_to_road <= 12 OR least(abs(x.bearing - y.bearing) % 180, 180 - abs(x.bearing - y.bearing) % 180) <= 25, FALSE) AS is_sidepath
  FROM ed LEFT JOIN nr USING (u, v, key) LEFT JOIN mb x USING (u, v, key) LEFT JOIN mb y ON y.u = road.u AND y.v = road.v AND y.key = road.k)"""


def bearing_cte() -> str:
    return """,
mb0 AS (SELECT u, v, key, s, i FROM (SELECT u, v, key, unnest(list_zip(geometry[1:len(geometry) - 1], geometry[2:])) AS s, unnest(range(1, len(geometry))) AS i FROM ed WHERE geometry IS NOT NULL)),
mb AS (SELECT u, v, key, arg_max((degrees(atan2(s[2].y - s[1].y, s[2].x - s[1].x)) + 360) % 180, ((s[2].x - s[1].x) * (s[2].x - s[1].x) + (s[2].y - s[1].y) * (s[2].y - s[1].y), -i)) AS bearing FROM mb0 GROUP BY u, v, key)"""


CHORDS = """
nd AS (SELECT node_id, min((x, y)) AS at FROM network_nodes WHERE node_id IS NOT NULL GROUP BY node_id),
ch AS (SELECT DISTINCT e.u, e.v, a.at[1] AS x0, a.at[2] AS y0, b.at[1] AS x1, b.at[2] AS y1 FROM (SELECT u, v FROM muenster_edges_classified UNION ALL SELECT v, u FROM muenster_edges_classified) e
  JOIN nd a ON a.node_id = e.u JOIN nd b ON b.node_id = e.v)"""


def candidates_cte(which: str) -> str:
    d = point_segment("x", "y", "x0", "y0", "x1", "y1")
    return f""",
cg AS (SELECT *, unnest(range(floor((least(x0, x1) - 50) / 50)::BIGINT, floor((greatest(x0, x1) + 50) / 50)::BIGINT + 1)) AS gx FROM ch WHERE {which}),
cn AS (SELECT point_id, u, v, {d} AS dist FROM tr JOIN cg ON cg.gx = floor(tr.x / 50)::BIGINT AND tr.y BETWEEN least(y0, y1) - 50 AND greatest(y0, y1) + 50 WHERE {d} <= 50)"""


ONE = """
one AS (SELECT * EXCLUDE (n) FROM (SELECT boxId, epoch_us(createdAt) AS t, row_seq, CASE WHEN isnan(w) THEN NULL ELSE w END AS v, lat, lon,
    row_number() OVER (PARTITION BY boxId, createdAt ORDER BY row_seq) AS n FROM (SELECT *, TRY_CAST(value AS DOUBLE) AS w FROM opensensemap_overtaking_distances) r
  WHERE lat IS NOT NULL AND lon IS NOT NULL AND createdAt IS NOT NULL AND boxId IS NOT NULL) WHERE n = 1),
rd0 AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY boxId ORDER BY t) <= 600000000 THEN 0 ELSE 1 END AS b FROM one),
rd1 AS (SELECT *, sum(b) OVER (PARTITION BY boxId ORDER BY t) AS ride FROM rd0),
rd AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY boxId, ride) AS size FROM rd1) WHERE size >= 5)"""

STRANGE = ONE + """,
nu AS (SELECT * FROM rd1 WHERE v IS NOT NULL),
sk0 AS (SELECT *, CASE WHEN v <> 0 AND lag(v) OVER w <> 0 AND abs(v - lag(v) OVER w) <= 0.5 THEN 0 ELSE 1 END AS s FROM nu WINDOW w AS (PARTITION BY boxId, ride ORDER BY t)),
sk1 AS (SELECT *, sum(s) OVER (PARTITION BY boxId, ride ORDER BY t) AS run FROM sk0),
sk AS (SELECT *, v <> 0 AND count(*) OVER (PARTITION BY boxId, ride, run) >= 20 AS stuck FROM sk1),
us AS (SELECT boxId, row_seq, v, row_number() OVER (PARTITION BY boxId ORDER BY t, row_seq) AS i, count(*) OVER (PARTITION BY boxId) AS n FROM sk WHERE v <> 0 AND v BETWEEN 0 AND 400 AND NOT stuck),
lv AS (SELECT us.*, k, i * 40 > n * k AS late FROM us, (SELECT 0 AS k UNION ALL SELECT unnest(range(4, 37))) WHERE n > 8),
le AS (SELECT *, median(v) OVER (PARTITION BY boxId, k, late) AS m FROM lv),
co AS (SELECT boxId, k, sum(abs(v - m)) AS cost FROM le GROUP BY ALL),
ch AS (SELECT boxId, CASE WHEN min(cost) < 0.85 * max(cost) FILTER (k = 0) THEN arg_min(k, (cost, k)) ELSE 0 END AS k FROM co GROUP BY boxId),
un AS (SELECT boxId, median(abs(v - m)) AS mad, min(m) AS low, max(m) AS high FROM le JOIN ch USING (boxId, k) GROUP BY boxId),
fa AS (SELECT row_seq FROM us JOIN un USING (boxId) WHERE least(abs(v - low), abs(v - high)) > 4.75 * greatest(1.4826 * mad, 0.5)),
tq AS (SELECT DISTINCT traj_id, coalesce(boxId, '') AS box, longest_nonzero_run AS run, n_points AS n, CASE WHEN isnan(raw_per_km) THEN NULL ELSE raw_per_km END AS rate FROM trajectory_quality WHERE traj_id IS NOT NULL),
tw AS (SELECT *, coalesce(run < 0 OR run > n, FALSE) AS wrong FROM tq),
rl AS (SELECT box, max(run) AS high FROM tw WHERE NOT wrong AND run < 25 GROUP BY box),
tf AS (SELECT tw.*, coalesce(NOT wrong AND run >= 25 AND run >= 3 * coalesce(high, 25), FALSE) AS far FROM tw LEFT JOIN rl USING (box)),
ra AS (SELECT box, rate, lag(rate) OVER (PARTITION BY box ORDER BY rate) AS below, percent_rank() OVER (PARTITION BY box ORDER BY rate) AS place FROM tw WHERE rate >= 0 AND (wrong OR run IS NULL OR run < 25)),
rr AS (SELECT box, min(rate) AS far_rate FROM ra WHERE place > 0.5 AND below > 0 AND rate >= 3 * below GROUP BY box),
fo AS (SELECT 'reading' AS kind, row_seq::VARCHAR AS record_id, 'bounds' AS reason FROM one WHERE v < 0 OR v > 400 UNION ALL SELECT 'reading', row_seq::VARCHAR, 'stuck' FROM sk WHERE stuck UNION ALL SELECT 'reading', row_seq::VARCHAR, 'far_off' FROM fa
  UNION ALL SELECT 'trajectory', traj_id, 'run_impossible' FROM tf WHERE wrong UNION ALL SELECT 'trajectory', traj_id, 'run_far_off' FROM tf WHERE far
  UNION ALL SELECT 'trajectory', traj_id, 'rate_impossible' FROM tf WHERE rate < 0 UNION ALL SELECT 'trajectory', traj_id, 'rate_far_off' FROM tf JOIN rr USING (box) WHERE rate >= far_rate)"""

TRIPS = """,
w0 AS (SELECT boxId, t, x, y, row_number() OVER (PARTITION BY boxId, t ORDER BY row_seq) AS n FROM pts),
w1 AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY boxId ORDER BY t) <= 600000000 THEN 0 ELSE 1 END AS b FROM w0 WHERE n = 1),
w2 AS (SELECT *, sum(b) OVER (PARTITION BY boxId ORDER BY t) AS ride FROM w1),
w3 AS (SELECT *, count(*) OVER r AS size, min(t) OVER r AS t0, max(t) OVER r AS t1 FROM w2 WINDOW r AS (PARTITION BY boxId, ride)),
w4 AS (SELECT *, median(x) OVER a AS mx, median(y) OVER a AS my FROM w3 WHERE size >= 5 WINDOW a AS (PARTITION BY boxId, ride ORDER BY t ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING)),
w5 AS (SELECT *, row_number() OVER (PARTITION BY boxId, ride ORDER BY t) AS i FROM w4 WHERE sqrt((x - mx) * (x - mx) + (y - my) * (y - my)) <= 60),
be AS (SELECT boxId, ride, median(x) AS sx, median(y) AS sy FROM w5 WHERE i <= 5 GROUP BY ALL),
tp AS (SELECT DISTINCT boxId, t0, t1 FROM w5 JOIN be USING (boxId, ride) WHERE (x - sx) * (x - sx) + (y - sy) * (y - sy) > 40000),
c0 AS (SELECT *, greatest(max(x) OVER a - min(x) OVER a, max(y) OVER a - min(y) OVER a) <= 25 AS still FROM w5 WINDOW a AS (PARTITION BY boxId, ride ORDER BY t ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING)),
c1 AS (SELECT *, sum(CASE WHEN still THEN 0 ELSE 1 END) OVER (PARTITION BY boxId, ride ORDER BY t) AS no FROM c0),
c2 AS (SELECT boxId, ride, no, min(t) AS a, max(t) AS b, count(*) AS k, median(x) AS x, median(y) AS y FROM c1 WHERE still GROUP BY ALL HAVING count(*) > 5),
c3 AS (SELECT *, CASE WHEN no - lag(no) OVER r <= 12 AND (x - lag(x) OVER r) * (x - lag(x) OVER r) + (y - lag(y) OVER r) * (y - lag(y) OVER r) <= 900 THEN 0 ELSE 1 END AS s FROM c2 WINDOW r AS (PARTITION BY boxId, ride ORDER BY no)),
c4 AS (SELECT *, sum(s) OVER (PARTITION BY boxId, ride ORDER BY no) AS g FROM c3),
c5 AS (SELECT boxId, ride, g, min(a) AS a, max(b) AS b FROM c4 GROUP BY ALL HAVING max(b) - min(a) >= 112000000)"""

ORPHANS = """
WITH e AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY event_uid ORDER BY loaded_at) AS rn FROM matched_events) WHERE rn = 1),
p AS (SELECT point_id, min(loaded_at) AS since FROM matched_points GROUP BY point_id), r AS (SELECT point_id, min(retracted_at) AS gone FROM retracted_points GROUP BY point_id),
n AS (SELECT DISTINCT node_id FROM network_nodes WHERE node_id IS NOT NULL),
w AS (SELECT DISTINCT least(u, v) AS a, greatest(u, v) AS b FROM muenster_edges_classified),
f AS (
  SELECT event_uid, 'closest_point_id' AS ref_field, "start" FROM e LEFT JOIN p ON p.point_id = closest_point_id LEFT JOIN r ON r.point_id = closest_point_id
    WHERE closest_point_id <> '' AND (since IS NULL OR since > loaded_at OR gone <= loaded_at)
  UNION ALL SELECT event_uid, 'u', "start" FROM e ANTI JOIN n ON n.node_id = e.u WHERE u IS NOT NULL
  UNION ALL SELECT event_uid, 'v', "start" FROM e ANTI JOIN n ON n.node_id = e.v WHERE v IS NOT NULL
  UNION ALL SELECT event_uid, 'edge', "start" FROM e SEMI JOIN n n1 ON n1.node_id = e.u SEMI JOIN n n2 ON n2.node_id = e.v ANTI JOIN w ON a = least(e.u, e.v) AND b = greatest(e.u, e.v))
"""


def oracle_sql() -> dict[str, str]:
    pts = "WITH " + points_cte()
    seg = pts + SEGMENTS
    tr = seg + TRACED
    q = tr + RUNS + QUALITY
    within = (
        pts.replace("pts AS (", "pts2 AS (")
        + ", ex AS (SELECT min(x) - 2000 AS xa, min(y) - 2000 AS ya, max(x) + 2000 AS xb, max(y) + 2000 AS yb FROM network_nodes), pts AS (SELECT pts2.* FROM pts2, ex WHERE x BETWEEN xa AND xb AND y BETWEEN ya AND yb)"
        + SEGMENTS + TRACED
    )
    ev = tr + EVENTS
    summary = ev + """,
b AS (SELECT boxId, traj_id, arg_min(boxName, (t, row_seq)) FILTER (boxName IS NOT NULL) AS boxName, min(t) AS start_us, max(t) AS end_us, count(*) AS n_points, sum(step_m) / 1000 AS length_km, (max(t) - min(t)) / 6e7 AS duration_min FROM tr GROUP BY boxId, traj_id),
g AS (SELECT traj_id, count(*) AS n, count(*) FILTER (is_close) AS c, min(min_clearance_cm) AS lo, avg(min_clearance_cm) AS mean, avg(duration_s) AS dur FROM ev GROUP BY traj_id)
SELECT traj_id, boxId, boxName, start_us, end_us, n_points, round(length_km, 4) AS length_km, round(duration_min, 9) AS duration_min, round(length_km / nullif(duration_min / 60, 0), 3) AS mean_speed_kmh,
  coalesce(n, 0) AS n_overtakes, coalesce(c, 0) AS n_close_passes, lo AS min_overtake_cm, round(mean, 9) AS mean_overtake_cm, round(dur, 9) AS mean_event_duration_s, round(CASE WHEN length_km >= 0.2 THEN coalesce(n, 0) / length_km END, 4) AS overtake_rate_per_km FROM b LEFT JOIN g USING (traj_id)"""
    ed = "WITH " + edges_cte()
    cl = ed + classes_cte("ed")
    roads = ed + roads_cte()
    li = "WITH " + LINKED
    d2 = point_segment("x", "y", "p.x", "p.y", "q.x", "q.y")
    flags = ["f_speed", "f_nz_share", "f_long_run", "f_rate", "f_too_short"]
    labels = ", ".join(f"({i}, '{n}')" for i, n in enumerate(REGIMES, 1))
    return {
        "bad_rows_dropped": pts + " SELECT (SELECT count(*) FROM opensensemap_overtaking_distances) AS n_rows, count(*) AS n_kept, count(*) - count(value) AS n_null_value FROM pts",
        "utm_project": pts + " SELECT row_seq, round(x, 2) AS x, round(y, 2) AS y FROM pts",
        "network_extent": "SELECT round(min(x) - 2000, 3) AS x_min, round(min(y) - 2000, 3) AS y_min, round(max(x) + 2000, 3) AS x_max, round(max(y) + 2000, 3) AS y_max FROM network_nodes",
        "clip_bbox": pts + ", e AS (SELECT min(x) - 2000 AS a, min(y) - 2000 AS b, max(x) + 2000 AS c, max(y) + 2000 AS d FROM network_nodes) SELECT row_seq, boxId FROM pts, e WHERE x BETWEEN a AND c AND y BETWEEN b AND d",
        "marker_sizes": pts + " SELECT row_seq, round(3 + 50 * sqrt(least(greatest(value, 0), 250) / 250), 6) AS size FROM pts WHERE value > 0",
        "box_labels": "SELECT DISTINCT boxId, substr(regexp_replace(coalesce(boxName, boxId), '[^\\p{L}\\p{N}_.-]+', '_', 'g'), 1, 60) AS file_name, coalesce(boxName, '') || ' (' || right(boxId, 6) || ')' AS label "
        "FROM opensensemap_overtaking_distances WHERE lat IS NOT NULL AND lon IS NOT NULL AND createdAt IS NOT NULL AND boxId IS NOT NULL",
        "traj_segment": seg + " SELECT boxId, traj_id, count(*) AS n_points, min(t) AS start_us, max(t) AS end_us FROM seg GROUP BY boxId, traj_id",
        "traj_length": tr + " SELECT traj_id, round(sum(step_m) / 1000, 4) AS length_km FROM tr GROUP BY traj_id",
        "point_ids": tr + " SELECT row_seq, traj_id, point_id FROM tr",
        "bearings": tr + " SELECT row_seq, round(bearing, 2) AS bearing FROM tr",
        "traj_lines": tr + " SELECT traj_id, count(*) AS n_points, string_agg(round(x * 10)::BIGINT || ' ' || round(y * 10)::BIGINT, ',' ORDER BY ordinal) AS line_dm FROM tr GROUP BY traj_id HAVING count(*) >= 2",
        "distinct_counts": seg + " SELECT count(*) AS n_points, count(DISTINCT traj_id) AS n_trajectories, count(DISTINCT boxId) AS n_boxes FROM seg",
        "session_windows": seg + " SELECT boxId, min(t) AS start_us, max(t) AS end_us, count(*) AS n_points, count(*) FILTER (value > 0) AS n_nonzero FROM seg GROUP BY boxId, traj_id",
        "overtake_windows": pts + ", a AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY boxId ORDER BY t, row_seq) <= 3000000 THEN 0 ELSE 1 END AS b FROM pts WHERE value > 0), g AS (SELECT *, sum(b) OVER (PARTITION BY boxId ORDER BY t, row_seq ROWS UNBOUNDED PRECEDING) AS no FROM a) "
        "SELECT boxId, min(t) AS start_us, max(t) AS end_us, count(*) AS n_samples, min(value) AS min_clearance_cm, round(avg(value), 9) AS mean_clearance_cm, min(value) < 150 AS is_close FROM g GROUP BY boxId, no",
        "longest_run": tr + RUNS + " SELECT traj_id, longest_nonzero_run FROM runs",
        "quality_table": q + " SELECT traj_id, boxId, boxName, keep, n_flags, flag_reasons, n_points, round(length_km, 4) AS length_km, round(mean_speed_kmh, 3) AS mean_speed_kmh, round(nonzero_share, 9) AS nonzero_share, "
        f"longest_nonzero_run, round(raw_per_km, 4) AS raw_per_km, value_max, n_nonzero, {', '.join(flags)} FROM q",
        "quality_flag_counts": q + " " + " UNION ALL ".join(f"SELECT '{f}' AS flag, count(*) FILTER ({f}) AS n FROM q" for f in flags),
        "nflag_hist": q + " SELECT n_flags, count(*) AS n FROM q GROUP BY n_flags",
        "keep_summary": q + " SELECT count(*) AS n, count(*) FILTER (keep) AS n_kept, round(avg(keep::INT), 9) AS kept_share FROM q",
        "box_keep_rate": q + " SELECT boxId, boxName, count(*) AS n, round_even(avg(keep::INT), 2) AS keep_rate FROM q WHERE boxId IS NOT NULL AND boxName IS NOT NULL GROUP BY boxId, boxName ORDER BY keep_rate, boxId, boxName LIMIT 15",
        "box_overview": seg + " SELECT boxId, count(*) AS n_points, count(DISTINCT traj_id) AS n_trajectories, round(avg(coalesce(value > 0, FALSE)::INT), 9) AS nonzero_share, max(value) AS value_max, avg(coalesce(value > 0, FALSE)::INT) > 0.4 AS looks_stuck FROM seg GROUP BY boxId",
        "good_scope_points": q + " SELECT row_seq, traj_id, point_id FROM tr SEMI JOIN (SELECT traj_id FROM q WHERE keep) k USING (traj_id)",
        "plot_one_box": q + " SELECT boxId, traj_id, right(traj_id, 4) AS label, n_points, round(nonzero_share, 9) AS nonzero_share, longest_nonzero_run, value_max, (row_number() OVER (PARTITION BY boxId ORDER BY n_points DESC, traj_id))::INT AS page_rank, "
        "right(traj_id, 4) || ' | ' || n_points || ' pts | nz ' || round_even(round(nonzero_share, 9) * 100, 0)::BIGINT || '% | run ' || longest_nonzero_run || ' | max ' || coalesce(round_even(value_max, 0)::BIGINT::VARCHAR, 'nan') AS title FROM q",
        "plot_trajectories": tr + ", l AS (SELECT boxId, count(*) AS n_lines FROM (SELECT boxId, traj_id FROM tr GROUP BY ALL HAVING count(*) >= 2) GROUP BY boxId) SELECT left(boxId, 12) AS label, boxId, n_lines, greatest((SELECT count(*) FROM l) - 15, 0) AS n_more FROM l ORDER BY n_lines DESC, boxId LIMIT 15",
        "overtake_events": ev + " SELECT * REPLACE (round(duration_s, 6) AS duration_s, round(mean_clearance_cm, 9) AS mean_clearance_cm, round(x, 2) AS x, round(y, 2) AS y) FROM ev",
        "traj_summary": summary,
        "top_summary": summary + " ORDER BY overtake_rate_per_km DESC NULLS LAST, traj_id LIMIT 15",
        "event_totals": ev + " SELECT count(*) AS n_events, count(*) FILTER (is_close) AS n_close FROM ev",
        "link_events": li + " SELECT event_uid, u, v FROM li",
        "event_edge_class": li + " SELECT event_uid, u, v, edge_class FROM lc",
        "events_per_class": li + " SELECT edge_class, count(*) AS n FROM lc WHERE edge_class IS NOT NULL GROUP BY edge_class",
        "linked_share": li + " SELECT count(*) AS n_events, count(u) AS n_linked, round(avg((u IS NOT NULL)::INT), 9) AS linked_share FROM li",
        "edge_classes": cl + f" SELECT u, v, key, (cs = 'yes' OR br = 'yes') AS is_cycling_street, list_contains(m, 3) AS has_track_tag, list_contains(m, 5) AS has_lane_tag, (list_contains(m, 2) OR list_contains(m, 4)) AS separate_geometry, edge_class FROM cl",
        "edges_written": ed + " SELECT u, v, key, " + ", ".join(f"array_to_string(\"{c}\", ';') AS \"{c}\"" for c in TAGS) + " FROM ed",
        "crosstab_margins": cl + " SELECT CASE WHEN grouping(hw) = 1 THEN 'All' ELSE hw END AS highway, CASE WHEN grouping(edge_class) = 1 THEN 'All' ELSE edge_class END AS edge_class, count(*) AS n FROM cl GROUP BY CUBE (hw, edge_class)",
        "crosstab_wide": cl + " SELECT CASE WHEN grouping(hw) = 1 THEN 'All' ELSE hw END AS highway, " + ", ".join(f"count(*) FILTER (edge_class = '{c}') AS {c}" for c in [*dict.fromkeys(REGIMES), OTHER]) + ", count(*) AS all_classes FROM cl GROUP BY ROLLUP (hw)",
        "multi_match": cl + " SELECT count(*) AS n_edges, count(*) FILTER (len(m) > 1) AS n_multi, round(avg((len(m) > 1)::INT), 9) AS multi_share FROM cl",
        "condition_overlap": cl + f", r(i, l) AS (VALUES {labels}), c AS (SELECT a, b, count(*) AS n FROM (SELECT unnest(m) AS a, m FROM cl), LATERAL (SELECT unnest(m) AS b) GROUP BY a, b) "
        "SELECT r1.i AS rule_a, r2.i AS rule_b, r1.l AS label_a, r2.l AS label_b, coalesce(n, 0) AS n FROM r r1, r r2 LEFT JOIN c ON c.a = r1.i AND c.b = r2.i",
        "other_top": cl + " SELECT hw AS highway, count(*) AS n FROM cl WHERE edge_class = 'other' GROUP BY hw ORDER BY n DESC, hw LIMIT 10",
        "length_share": cl + ", k AS (SELECT edge_class, sum(length) / 1000 AS km FROM cl GROUP BY edge_class) SELECT edge_class, round_even(km, 1) AS km, round_even(km / (SELECT sum(km) FROM k), 3) AS share FROM k",
        "class_counts": cl + " SELECT edge_class, count(*) AS n FROM cl GROUP BY edge_class",
        "plot_large_classes": cl + " SELECT edge_class, count(*) AS n, round(sum(length) / 1000, 3) AS km FROM cl GROUP BY edge_class HAVING count(*) >= 10",
        "main_bearing": ed + bearing_cte() + " SELECT u, v, key, round(bearing, 4) AS bearing FROM mb",
        "nearest_road": roads + " SELECT nr.u, nr.v, nr.key, road.u AS road_u, road.v AS road_v, road.k AS road_key, round(dist_to_road, 4) AS dist_to_road, round(least(abs(x.bearing - y.bearing) % 180, 180 - abs(x.bearing - y.bearing) % 180), 3) AS angle FROM nr "
        "LEFT JOIN mb x USING (u, v, key) LEFT JOIN mb y ON y.u = road.u AND y.v = road.v AND y.key = road.k",
        "sidepath_flags": roads + " SELECT u, v, key, is_sidepath FROM sp",
        "sidepath_share": roads + " SELECT count(*) FILTER (is_sidepath) AS n_sidepaths, round(avg(is_sidepath::INT), 9) AS share FROM sp",
        "reclassified": roads + classes_cte("sp") + " SELECT edge_class, count(*) AS n FROM cl GROUP BY edge_class",
        "straight_map": "WITH " + CHORDS + " SELECT u, v, round(x0, 3) AS x0, round(y0, 3) AS y0, round(x1, 3) AS x1, round(y1, 3) AS y1 FROM ch",
        "match_candidates": tr + "," + CHORDS + candidates_cte("TRUE") + " SELECT point_id, u, v, round(dist, 3) AS distance_m FROM cn",
        "nearest_edge_match": tr + "," + CHORDS + candidates_cte("u <= v") + " SELECT point_id, arg_min(u, (dist, u, v)) AS u, arg_min(v, (dist, u, v)) AS v, round(min(dist), 3) AS distance_m FROM cn GROUP BY point_id",
        "viterbi_checked": tr + "," + CHORDS + ", fi AS (SELECT traj_id, x, y FROM tr WHERE ordinal = 0), "
        f"pl AS (SELECT DISTINCT traj_id FROM fi JOIN ch ON x BETWEEN least(x0, x1) - 60 AND greatest(x0, x1) + 60 AND y BETWEEN least(y0, y1) - 60 AND greatest(y0, y1) + 60 WHERE {point_segment('x', 'y', 'x0', 'y0', 'x1', 'y1')} <= 60) "
        "SELECT traj_id, count(*) AS n_points, bool_or(pl.traj_id IS NOT NULL) AS any_placed, 0 AS n_after_null, 0 AS n_far FROM tr LEFT JOIN pl USING (traj_id) GROUP BY traj_id",
        "placed_share": "SELECT traj_id, count(*) AS n_points, round(avg((u IS NOT NULL)::INT), 9) AS placed_share, bool_or(u IS NOT NULL) AS any_placed, right(traj_id, 4) || ' | ' || count(*) || ' pts | ' || round_even(round(avg((u IS NOT NULL)::INT), 9) * 100, 0)::BIGINT || '% placed' AS title FROM matched_points GROUP BY traj_id",
        "placed_overall": "SELECT count(*) AS n_trajectories, count(*) FILTER (a) AS n_matched, round(sum(k) / sum(n), 9) AS placed_share FROM (SELECT bool_or(u IS NOT NULL) AS a, count(u) AS k, count(*) AS n FROM matched_points GROUP BY traj_id)",
        "visited_edges": "SELECT traj_id, least(u, v) AS u, greatest(u, v) AS v, epoch_us(min(createdAt)) AS first_at_us FROM matched_points WHERE u IS NOT NULL AND v IS NOT NULL GROUP BY ALL",
        "plot_match": """WITH m AS (SELECT traj_id, least(u, v) AS u, greatest(u, v) AS v, min(createdAt) AS f FROM matched_points WHERE u IS NOT NULL AND v IS NOT NULL GROUP BY ALL),
g AS (SELECT least(u, v) AS u, greatest(u, v) AS v, arg_min(geometry, (u, v, key)) AS g FROM muenster_edges_classified WHERE geometry IS NOT NULL GROUP BY 1, 2)
SELECT traj_id, u, v, (row_number() OVER (PARTITION BY traj_id ORDER BY f, u, v))::INT AS visit, array_to_string(list_transform(g, lambda p: round(p.x * 10)::BIGINT || ' ' || round(p.y * 10)::BIGINT), ',') AS line_dm FROM m JOIN g USING (u, v)""",
        "plot_network": cl + """, n AS (SELECT edge_class, count(*) AS n, (row_number() OVER (ORDER BY count(*) DESC, edge_class))::INT AS legend FROM cl GROUP BY edge_class)
SELECT u, v, key, edge_class, n, legend, array_to_string(list_transform(geometry, lambda p: round(p.x * 10)::BIGINT || ' ' || round(p.y * 10)::BIGINT), ',') AS line_dm FROM cl JOIN n USING (edge_class) WHERE geometry IS NOT NULL""",
        "plot_lines": tr + """, pc AS (SELECT *, t // 600000000 AS cell FROM tr), st AS (SELECT traj_id, cell, min(ordinal) AS first, count(*) AS n_points FROM pc GROUP BY ALL)
SELECT boxId, st.traj_id, first, n_points, string_agg(round(x * 10)::BIGINT || ' ' || round(y * 10)::BIGINT, ',' ORDER BY ordinal) AS line_dm FROM st JOIN tr ON tr.traj_id = st.traj_id AND ordinal BETWEEN first - 1 AND first + n_points - 1 GROUP BY ALL""",
        "stage_network": roads + classes_cte("sp") + " SELECT u, v, key, is_sidepath, (cs = 'yes' OR br = 'yes') AS is_cycling_street, list_contains(m, 3) AS has_track_tag, list_contains(m, 5) AS has_lane_tag, (list_contains(m, 2) OR list_contains(m, 4)) AS separate_geometry, edge_class FROM cl",
        "stage_diagnostics": within + RUNS + QUALITY + " SELECT traj_id, keep, n_flags, flag_reasons, n_points, round(length_km, 4) AS length_km, longest_nonzero_run FROM q",
        "stage_points": within + RUNS + QUALITY + " SELECT row_seq, point_id, round(bearing, 2) AS bearing FROM tr SEMI JOIN (SELECT traj_id FROM q WHERE keep) k USING (traj_id)",
        "stage_events": within + EVENTS + RUNS + QUALITY + " SELECT event_uid, n_samples, min_clearance_cm, is_close, closest_point_id FROM ev SEMI JOIN (SELECT traj_id FROM q WHERE keep) k USING (traj_id)",
        "p1_found": ORPHANS + "SELECT event_uid, ref_field FROM f",
        "p1_report": ORPHANS + """, a AS (SELECT 'closest_point_id' AS ref_field, "start" FROM e WHERE closest_point_id <> '' UNION ALL SELECT 'u', "start" FROM e WHERE u IS NOT NULL UNION ALL SELECT 'v', "start" FROM e WHERE v IS NOT NULL
  UNION ALL SELECT 'edge', "start" FROM e WHERE u IS NOT NULL AND v IS NOT NULL),
b AS (SELECT ref_field, "start", 1 AS r, 0 AS o FROM a UNION ALL SELECT ref_field, "start", 0, 1 FROM f)
SELECT CASE ref_field WHEN 'closest_point_id' THEN 'matched_points' WHEN 'edge' THEN 'muenster_edges_classified' ELSE 'network_nodes' END AS ref_table, ref_field, strftime("start" AT TIME ZONE 'UTC', '%Y-%m-%d') AS period, sum(r) AS n_references, sum(o) AS n_orphans, round(sum(o) / sum(r), 9) AS orphan_share FROM b GROUP BY ALL""",
        "p2_found": pts + f""", det AS (SELECT row_seq, x, y FROM (SELECT *, row_number() OVER (PARTITION BY boxId, t ORDER BY row_seq) AS n FROM pts) WHERE n = 1 AND value > 0),
s0 AS (SELECT DISTINCT u, v, key, unnest(list_zip(geometry[1:len(geometry) - 1], geometry[2:])) AS s FROM muenster_edges_classified WHERE geometry IS NOT NULL AND u IS NOT NULL AND v IS NOT NULL AND key IS NOT NULL),
s1 AS (SELECT u, v, key, s[1] AS p, s[2] AS q, unnest(range(floor((least(s[1].x, s[2].x) - 16) / 100)::BIGINT, floor((greatest(s[1].x, s[2].x) + 16) / 100)::BIGINT + 1)) AS gx FROM s0)
SELECT DISTINCT row_seq, u, v, key AS edge_key FROM det JOIN s1 ON gx = floor(x / 100)::BIGINT AND y BETWEEN least(p.y, q.y) - 16 AND greatest(p.y, q.y) + 16 WHERE {d2} <= 15""",
        "p5_found": pts + TRIPS + " SELECT boxId AS box_id, 'trip' AS kind, (t0 + t1) // 1200000000 AS slot FROM tp UNION ALL SELECT boxId, 'stop', (a + b) // 1200000000 FROM c5",
        "p4_found": "WITH " + STRANGE + " SELECT DISTINCT kind, record_id FROM fo",
        "p4_reasons": "WITH " + STRANGE + " SELECT DISTINCT kind, record_id, reason FROM fo",
        "p3_found": "WITH " + ONE + """, k AS (SELECT boxId, ride, min(t) AS t0, max(t) AS t1 FROM rd GROUP BY ALL),
s AS (SELECT boxId, ride, unnest(generate_series(t0 // 10000000, t1 // 10000000)) AS slot FROM k), n AS (SELECT DISTINCT boxId, ride, t // 10000000 AS slot FROM rd WHERE v IS NOT NULL)
SELECT boxId AS box_id, slot * 10 AS cell_s FROM s ANTI JOIN n USING (boxId, ride, slot)""",
        "p3_series": "WITH " + ONE + """, k AS (SELECT boxId, ride, min(t) AS t0, max(t) AS t1 FROM rd GROUP BY ALL),
s AS (SELECT boxId, ride, t0, unnest(generate_series(t0 // 10000000, t1 // 10000000)) AS slot FROM k),
n AS (SELECT boxId, ride, t // 10000000 AS slot, count(*) AS c, avg(v) AS mean, arg_max(v, t) AS last FROM rd WHERE v IS NOT NULL GROUP BY ALL),
j AS (SELECT *, last_value(last IGNORE NULLS) OVER (PARTITION BY boxId, ride ORDER BY slot ROWS UNBOUNDED PRECEDING) AS filled FROM s LEFT JOIN n USING (boxId, ride, slot))
SELECT boxId AS box_id, t0 AS ride_t0_us, slot * 10 AS cell_s, coalesce(c, 0) AS n_numbers, round(mean, 9) AS mean_value, last AS last_value, filled AS filled_value,
  CASE WHEN c IS NOT NULL THEN 'observed' WHEN filled IS NOT NULL THEN 'filled' ELSE 'empty' END AS status FROM j""",
    }
