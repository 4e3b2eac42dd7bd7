"""Transforms, meshes and voxels."""

from __future__ import annotations

from pyspark.sql import functions as F

from thermal_lake.functions import geometry as G
from thermal_lake.operators import mesh as ME
from thermal_lake.operators import voxel as VX
from thermal_lake.plans import voxelise as VP

from . import standins as S
from .core import R, query, rnd, sub, table, view

FLAT, PTS, MASK = sub(S.FACET_FLAT), sub(S.MESH_POINTS), sub(S.MASK)


def facets(spark, d):
    corner = lambda k: F.struct(*[F.col(f"{a}{k}").alias(a) for a in "xyz"]).alias(f"v{k}")
    return view(spark, d, S.FACET_FLAT).select("mesh_id", "facet_id", corner(1), corner(2), corner(3))


POSE = """SELECT l_orderkey * 8 + l_linenumber AS pid, min(l_quantity) AS x, min(l_discount) * 100 AS y, min(l_tax) * 100 + 0.5E0 AS z, min(l_quantity) / 17.3E0 - 1.1E0 AS a1, min(l_tax) * 30 - 0.7E0 AS a2,
 CAST(min(l_suppkey) % 3 + 1 AS INT) AS axis1, CAST((min(l_suppkey) + 1) % 3 + 1 AS INT) AS axis2 FROM {lineitem} GROUP BY l_orderkey * 8 + l_linenumber"""
_ANG = ", ".join(f"CASE WHEN axis2 = {k} THEN a2 WHEN axis1 = {k} THEN a1 ELSE 0 END AS r{a}" for k, a in enumerate("xyz", 1))


def _rot(v, inv=False):
    """Three successive turns (x, y, z) of (v0, v1, v2) in SQL, as nested selects' final expressions."""
    m = [["cos(rz)*cos(ry)", "(cos(rz)*sin(ry)*sin(rx)-sin(rz)*cos(rx))", "(cos(rz)*sin(ry)*cos(rx)+sin(rz)*sin(rx))"],
         ["sin(rz)*cos(ry)", "(sin(rz)*sin(ry)*sin(rx)+cos(rz)*cos(rx))", "(sin(rz)*sin(ry)*cos(rx)-cos(rz)*sin(rx))"],
         ["(-sin(ry))", "cos(ry)*sin(rx)", "cos(ry)*cos(rx)"]]
    return [" + ".join(f"{(m[j][i] if inv else m[i][j])} * {v[j]}" for j in range(3)) for i in range(3)]


_FW, _BK = _rot(["x", "y", "z"]), _rot(["(x - 1)", "(y - 2)", "(z - 3)"], True)


@query("P21_rigid_transform", f"""SELECT pid, {', '.join(f'{R(e + f" + {k + 1}")} AS w{a}' for k, (e, a) in enumerate(zip(_FW, 'xyz')))}, {', '.join(f'{R(e)} AS l{a}' for e, a in zip(_BK, 'xyz'))} FROM (SELECT *, {_ANG} FROM ({sub(POSE)}) p) q""")
def rigid(spark, d):
    p = view(spark, d, POSE)
    m = G.rotation(G.axis_angles(F.col("a1"), F.col("a2"), F.col("axis1"), F.col("axis2")))
    xyz, t = (F.col("x"), F.col("y"), F.col("z")), (F.lit(1.0), F.lit(2.0), F.lit(3.0))
    w, l = G.to_world(xyz, m, t), G.to_local(xyz, m, t)
    return p.select("pid", *[rnd(c).alias(f"w{a}") for c, a in zip(w, "xyz")], *[rnd(c).alias(f"l{a}") for c, a in zip(l, "xyz")])


_U = "SELECT pid, x / sqrt(x*x+y*y+z*z) AS p, y / sqrt(x*x+y*y+z*z) AS q, z / sqrt(x*x+y*y+z*z) AS r FROM (SELECT pid, CASE WHEN pid % 11 < 2 THEN 0.0E0 ELSE x - 20 END AS x, CASE WHEN pid % 11 < 2 THEN 0.0E0 ELSE y - 5 END AS y, CASE WHEN pid % 11 = 1 THEN -z ELSE z END AS z FROM ({POSE}) s) t"
# Turning the unit vector (p, q, r) onto z: I + [w] + [w]^2 / (1 + r) with w = (q, -p, 0).
_AL = {"m00": "1 - p*p/(1+r)", "m01": "-p*q/(1+r)", "m02": "-p", "m11": "1 - q*q/(1+r)", "m12": "-q", "m20": "p", "m21": "q", "m22": "r"}
_FLIP = {"m00": "1", "m01": "0", "m02": "0", "m11": "-1", "m12": "0", "m20": "0", "m21": "0", "m22": "-1"}


@query("P22_vector_alignment", f"SELECT pid, {', '.join(f'{R(f'CASE WHEN sqrt(p*p+q*q) < 1e-6 AND r < 0 THEN {_FLIP[k]} ELSE {v} END')} AS {k}' for k, v in _AL.items())} FROM ({sub(_U.replace('{POSE}', POSE))}) u")
def alignment(spark, d):
    u = view(spark, d, _U.replace("{POSE}", POSE))
    m = G.align((F.col("p"), F.col("q"), F.col("r")), (F.lit(0.0), F.lit(0.0), F.lit(1.0)), 1e-6, flip="x")
    return u.select("pid", *[rnd(m[int(k[1])][int(k[2])]).alias(k) for k in _AL])


_CORN = f"SELECT mesh_id, facet_id, 0 AS corner, x1 AS x, y1 AS y, z1 AS z FROM ({FLAT}) f UNION ALL SELECT mesh_id, facet_id, 1, x2, y2, z2 FROM ({FLAT}) f UNION ALL SELECT mesh_id, facet_id, 2, x3, y3, z3 FROM ({FLAT}) f"
_VERT = f"SELECT mesh_id, x, y, z, row_number() OVER (PARTITION BY mesh_id ORDER BY pos) AS vid FROM (SELECT mesh_id, x, y, z, min(facet_id * 3 + corner) AS pos FROM ({_CORN}) c GROUP BY 1, 2, 3, 4) v"
_INDEX = f"SELECT c.mesh_id, c.facet_id, max(vid) FILTER (corner = 0) AS a, max(vid) FILTER (corner = 1) AS b, max(vid) FILTER (corner = 2) AS c FROM ({_CORN}) c JOIN ({_VERT}) v USING (mesh_id, x, y, z) GROUP BY 1, 2"


@query("P23_rested_mesh", f"SELECT mesh_id, vid, {R('x - avg(x) OVER (PARTITION BY mesh_id)')} AS x, {R('y - avg(y) OVER (PARTITION BY mesh_id)')} AS y, {R('z - min(z) OVER (PARTITION BY mesh_id)')} AS z, {R('z - avg(z) OVER (PARTITION BY mesh_id)')} AS zc FROM ({_VERT}) v")
def rested(spark, d):
    v, _ = ME.index_vertices(facets(spark, d))
    c = ME.shift_vertices(v, "centroid").select("mesh_id", "vid", rnd("z").alias("zc"))
    return ME.shift_vertices(v).select("mesh_id", "vid", *[rnd(a).alias(a) for a in "xyz"]).join(c, ["mesh_id", "vid"])


_N = ["(y2-y1)*(z3-z1)-(z2-z1)*(y3-y1)", "(z2-z1)*(x3-x1)-(x2-x1)*(z3-z1)", "(x2-x1)*(y3-y1)-(y2-y1)*(x3-x1)"]
_FRM = f"SELECT mesh_id, facet_id, (x1+x2+x3)/3 AS cx, (y1+y2+y3)/3 AS cy, (z1+z2+z3)/3 AS cz, {', '.join(f'{e} AS n{a}' for e, a in zip(_N, 'xyz'))} FROM ({FLAT}) f"


@query("P24_facet_frames", f"SELECT mesh_id, facet_id, {R('cx')} AS cx, {R('cy')} AS cy, {R('cz')} AS cz, {R('nx / sqrt(nx*nx+ny*ny+nz*nz)')} AS nx, {R('ny / sqrt(nx*nx+ny*ny+nz*nz)')} AS ny, {R('nz / sqrt(nx*nx+ny*ny+nz*nz)')} AS nz FROM ({_FRM}) t")
def facet_frames(spark, d):
    f = ME.facet_frames(facets(spark, d))
    return f.select("mesh_id", "facet_id", *[rnd(c).alias(c) for c in ("cx", "cy", "cz", "nx", "ny", "nz")])


@query("S9_vertex_index", f"SELECT i.mesh_id, i.facet_id, i.a, i.b, i.c, {R('v.x')} AS x_a FROM ({_INDEX}) i JOIN ({_VERT}) v ON v.mesh_id = i.mesh_id AND v.vid = i.a")
def vertex_index(spark, d):
    v, i = ME.index_vertices(facets(spark, d))
    return i.join(v.select("mesh_id", F.col("vid").alias("a"), rnd("x").alias("x_a")), ["mesh_id", "a"])


@query("J7_nearest_facet", f"""SELECT mesh_id, qid, facet_id, {R('dist')} AS distance FROM (SELECT p.mesh_id, p.qid, f.facet_id, sqrt((p.x-cx)*(p.x-cx)+(p.y-cy)*(p.y-cy)+(p.z-cz)*(p.z-cz)) AS dist, row_number() OVER (PARTITION BY p.mesh_id, p.qid ORDER BY sqrt((p.x-cx)*(p.x-cx)+(p.y-cy)*(p.y-cy)+(p.z-cz)*(p.z-cz)), f.facet_id) AS rn FROM ({PTS}) p JOIN ({_FRM}) f USING (mesh_id)) t WHERE rn = 1""")
def nearest_facet(spark, d):
    return ME.nearest_facet(view(spark, d, S.MESH_POINTS), facets(spark, d), "qid").select("mesh_id", "qid", "facet_id", rnd("distance").alias("distance"))


@query("J8_point_in_mesh", f"SELECT p.qid, p.mesh_id, p.z > 0 AND p.z < b.c AND p.y > 0 AND p.y < b.b AND p.x - 0.25 * p.z > 0 AND p.x - 0.25 * p.z < b.a AS inside FROM ({PTS}) p JOIN ({sub(S.BOX_SIZE)}) b USING (mesh_id)")
def point_in_mesh(spark, d):
    return ME.inside_mesh(view(spark, d, S.MESH_POINTS), facets(spark, d)).select("qid", "mesh_id", "inside")


_ADJ = f"SELECT DISTINCT mesh_id, u.vid, u.nb FROM ({_INDEX}) i, LATERAL (VALUES (a, b), (b, a), (b, c), (c, b), (c, a), (a, c)) u(vid, nb)"


@query("J19_mesh_adjacency", _ADJ)
def mesh_adjacency(spark, d):
    return ME.adjacency(ME.index_vertices(facets(spark, d))[1])


def _step(prev: str, k: float) -> str:
    return f"(SELECT v.mesh_id, v.vid, v.x + {k} * (avg(n.x) - v.x) AS x, v.y + {k} * (avg(n.y) - v.y) AS y, v.z + {k} * (avg(n.z) - v.z) AS z FROM {prev} v JOIN adj ON adj.mesh_id = v.mesh_id AND adj.vid = v.vid JOIN {prev} n ON n.mesh_id = v.mesh_id AND n.vid = adj.nb GROUP BY v.mesh_id, v.vid, v.x, v.y, v.z)"


def _smooth(steps) -> str:
    ctes = [f"adj AS ({_ADJ})", f"s0 AS ({_VERT})"] + [f"s{i} AS {_step(f's{i - 1}', k)}" for i, k in enumerate(steps, 1)]
    return f"WITH {', '.join(ctes)} SELECT mesh_id, vid, {R('x')} AS x, {R('y')} AS y, {R('z')} AS z FROM s{len(steps)}"


@query("C17_laplacian_smoothing", _smooth([1.0, 1.0, 1.0]))
def laplacian(spark, d):
    v, i = ME.index_vertices(facets(spark, d))
    return ME.laplacian(i, v, 3).select("mesh_id", "vid", *[rnd(a).alias(a) for a in "xyz"])


@query("C18_taubin_smoothing", _smooth([0.5, -0.53, 0.5, -0.53]))
def taubin(spark, d):
    v, i = ME.index_vertices(facets(spark, d))
    return ME.taubin(i, v, 2, 0.5, -0.53).select("mesh_id", "vid", *[rnd(a).alias(a) for a in "xyz"])


@query("C19_midpoint_subdivision", f"""WITH i AS ({_INDEX}), v AS ({_VERT}), e AS (SELECT mesh_id, facet_id, s.side, least(p, q) AS lo, greatest(p, q) AS hi FROM i, LATERAL (VALUES (0, a, b), (1, b, c), (2, c, a)) s(side, p, q)),
 f AS (SELECT mesh_id, lo, hi, row_number() OVER (PARTITION BY mesh_id ORDER BY min(facet_id * 3 + side)) + 8 AS mid FROM e GROUP BY 1, 2, 3), m AS (SELECT e.mesh_id, facet_id, max(mid) FILTER (side = 0) AS m0, max(mid) FILTER (side = 1) AS m1, max(mid) FILTER (side = 2) AS m2 FROM e JOIN f USING (mesh_id, lo, hi) GROUP BY 1, 2),
 av AS (SELECT mesh_id, vid, x, y, z FROM v UNION ALL SELECT f.mesh_id, mid, (p.x + q.x) / 2, (p.y + q.y) / 2, (p.z + q.z) / 2 FROM f JOIN v p ON p.mesh_id = f.mesh_id AND p.vid = lo JOIN v q ON q.mesh_id = f.mesh_id AND q.vid = hi),
 af AS (SELECT i.mesh_id, i.facet_id * 4 + k AS facet_id, u.a, u.b, u.c FROM i JOIN m USING (mesh_id, facet_id), LATERAL (VALUES (0, i.a, m0, m2), (1, m0, i.b, m1), (2, m2, m1, i.c), (3, m0, m1, m2)) u(k, a, b, c))
SELECT af.mesh_id, af.facet_id, af.a, af.b, af.c, {R('p.x + q.x + r.x')} AS sx, {R('p.z + q.z + r.z')} AS sz FROM af JOIN av p ON p.mesh_id = af.mesh_id AND p.vid = af.a JOIN av q ON q.mesh_id = af.mesh_id AND q.vid = af.b JOIN av r ON r.mesh_id = af.mesh_id AND r.vid = af.c""")
def subdivision(spark, d):
    v, i = ME.index_vertices(facets(spark, d))
    f, w = ME.subdivided(i, v)
    out = f
    for n in "abc":
        out = out.join(w.select("mesh_id", F.col("vid").alias(n), F.col("x").alias(f"x{n}"), F.col("z").alias(f"z{n}")), ["mesh_id", n])
    return out.select("mesh_id", "facet_id", "a", "b", "c", rnd(F.col("xa") + F.col("xb") + F.col("xc")).alias("sx"), rnd(F.col("za") + F.col("zb") + F.col("zc")).alias("sz"))


def leaning(spark, d):
    """The boxes, sheared a little more, so that no grid point lies on a slanted face."""
    lean = lambda v: F.struct((F.col(f"{v}.x") + 0.0137 * F.col(f"{v}.z")).alias("x"), F.col(f"{v}.y").alias("y"), F.col(f"{v}.z").alias("z")).alias(v)
    return facets(spark, d).select("mesh_id", "facet_id", lean("v1"), lean("v2"), lean("v3"))


def _grid_sql(step: float, pad: float) -> str:
    """Grid points of every sheared box in its own frame, and whether they lie in it (faces y = 0 and y = b belong to it, the others do not)."""
    axis = lambda name, size: f"(SELECT mesh_id, -{pad} + i * {step} AS {name} FROM box, range(0, 60) r(i) WHERE i <= floor(({size} + {2 * pad}) / {step} + 1e-9))"
    return f"""(WITH box AS ({sub(S.BOX_SIZE)}) SELECT box.mesh_id, z > 0 AND z < c AND y >= 0 AND y <= b AND x - 0.2637 * z > 0 AND x - 0.2637 * z < a AS inside
 FROM box JOIN {axis('x', 'a + 0.2637 * c')} gx USING (mesh_id) JOIN {axis('y', 'b')} gy USING (mesh_id) JOIN {axis('z', 'c')} gz USING (mesh_id))"""


@query("A19_mesh_volume", f"SELECT mesh_id, {R('count(*) FILTER (inside) * 3.375E0')} AS volume FROM {_grid_sql(1.5, 0.0)} g GROUP BY 1")
def mesh_volume(spark, d):
    return ME.mesh_volume(leaning(spark, d)).withColumn("volume", rnd("volume"))


# Outcome of every mesh file; signatures of every seventh are current, those of the next are of an older file.
FILES = sub(S.MESH_FILES)
DONE = f"SELECT ruta, concat('stl_preprocess_v2|malla_k', CAST(mesh_id AS STRING), '.stl|684|', printf('%.6f', mtime_days - CASE WHEN mesh_id % 7 = 1 THEN 1 ELSE 0 END), '|sdf|1.000000') AS signature FROM ({S.MESH_FILES}) f WHERE mesh_id % 7 < 2"
_N_ANT, _POT = "mesh_id % 4 + 1", "CASE mesh_id % 3 WHEN 0 THEN 5 WHEN 1 THEN 10 ELSE 12.5 END"


def _states(wanted: str) -> str:
    early = f"mesh_id % 5 >= 1 AND mesh_id % 5 <= CASE WHEN {_N_ANT} = 1 THEN 0 WHEN {_POT} = 10 THEN 1 WHEN {_POT} = 5 AND {_N_ANT} IN (2, 3) THEN 2 WHEN {_POT} = 5 THEN 3 ELSE 0 END"
    return f"""(SELECT mesh_id, ruta, CASE WHEN mesh_id % 11 = 0 THEN 'omitida_metadata' WHEN NOT ({wanted}) THEN 'omitida_filtro' WHEN {early} THEN 'descartada_tiempo' WHEN mesh_id % 7 = 0 THEN 'existente' ELSE 'procesada' END AS outcome,
 CASE WHEN mesh_id % 11 = 0 THEN 'metadata incompleta: tipo' END AS motivo FROM ({FILES}) f WHERE mesh_id % 13 > 0)"""


def mesh_states(spark, d, wanted=None):
    return VP.states(view(spark, d, S.MESH_FILES), view(spark, d, DONE.replace("printf", "format_string")), 1.0, "sdf", wanted)


@query("C20_file_outcomes", f"SELECT mesh_id, ruta, outcome, motivo FROM {_states('true')} s")
def mesh_outcomes(spark, d):
    return mesh_states(spark, d).select("mesh_id", "ruta", "outcome", "motivo")


@query("C20_outcome_counters", f"SELECT o.outcome, count(s.mesh_id) AS n FROM (VALUES ('omitida_metadata'), ('omitida_filtro'), ('descartada_tiempo'), ('existente'), ('procesada')) o(outcome) LEFT JOIN {_states('mesh_id % 4 = 1 AND mesh_id % 9 = 3')} s USING (outcome) GROUP BY 1")
def mesh_counters(spark, d):
    return VP.counters(mesh_states(spark, d, {"antena": "2ant", "caso": 3.0}))


def _mesh_voxels(reach: str) -> str:
    """Occupancy, signed and clipped distance of every voxel of the meshes that are processed."""
    axis = lambda name, size: f"(SELECT mesh_id, CAST(i AS INT) AS i{name}, i - 1.0 AS {name} FROM box, range(0, 60) r(i) WHERE i <= floor({size} + 2 + 1e-9))"
    grid = f"""g AS MATERIALIZED (SELECT box.mesh_id AS dist_id, ix, iy, iz, z > 0 AND z < c AND y >= 0 AND y <= b AND x - 0.2637 * z > 0 AND x - 0.2637 * z < a AS occ
 FROM box JOIN {axis('x', 'a + 0.2637 * c')} gx USING (mesh_id) JOIN {axis('y', 'b')} gy USING (mesh_id) JOIN {axis('z', 'c')} gz USING (mesh_id))"""
    return f"""WITH box AS (SELECT * FROM ({sub(S.BOX_SIZE)}) b JOIN {_states('true')} s USING (mesh_id) WHERE outcome = 'procesada'), {grid}, {_edt('fo', 'b.occ')}, {_edt('fe', 'NOT b.occ')}
SELECT dist_id AS mesh_id, g.ix, g.iy, g.iz, occ, {reach} FROM g JOIN fo USING (dist_id, ix, iy, iz) JOIN fe USING (dist_id, ix, iy, iz)"""


def _edt(name: str, flag: str) -> str:
    return f"""{name}1 AS (SELECT a.dist_id, a.ix, a.iy, a.iz, min((a.ix - b.ix) ** 2) FILTER ({flag}) AS f FROM g a JOIN g b USING (dist_id, iy, iz) GROUP BY 1, 2, 3, 4),
 {name}2 AS (SELECT a.dist_id, a.ix, a.iy, a.iz, min((a.iy - b.iy) ** 2 + b.f) AS f FROM {name}1 a JOIN {name}1 b USING (dist_id, ix, iz) GROUP BY 1, 2, 3, 4),
 {name} AS (SELECT a.dist_id, a.ix, a.iy, a.iz, min((a.iz - b.iz) ** 2 + b.f) AS f FROM {name}2 a JOIN {name}2 b USING (dist_id, ix, iy) GROUP BY 1, 2, 3, 4)"""


@query("C20_voxelised_meshes", _mesh_voxels(f"{R('sqrt(fo.f) - sqrt(fe.f)')} AS sdf, {R('greatest(-2.0, least(2.0, sqrt(fo.f) - sqrt(fe.f)))')} AS tsdf"))
def voxelised(spark, d):
    v, _, _ = VP.voxelise(view(spark, d, S.MESH_FILES), leaning(spark, d), view(spark, d, DONE.replace("printf", "format_string")), 1.0)
    return v.select("mesh_id", "ix", "iy", "iz", "occ", rnd("sdf").alias("sdf"), rnd("tsdf").alias("tsdf"))


@query("C20_truncated_meshes", _mesh_voxels(f"{R('greatest(-2.0, least(2.0, sqrt(fo.f) - sqrt(fe.f)))')} AS tsdf").replace("WHERE outcome = 'procesada'", "WHERE outcome IN ('procesada', 'existente')"))
def truncated_meshes(spark, d):
    none = spark.createDataFrame([], "ruta string, signature string")
    v, _, _ = VP.voxelise(view(spark, d, S.MESH_FILES), leaning(spark, d), none, 1.0, "tsdf")
    return v.select("mesh_id", "ix", "iy", "iz", "occ", rnd("tsdf").alias("tsdf"))


@query("J9_mask_overlap", f"""WITH a AS ({MASK}), b AS (SELECT dist_id, ix + 1 AS ix, iy, iz FROM a) SELECT coalesce(a.dist_id, b.dist_id) AS dist_id, count(a.ix) AS n_a, count(b.ix) AS n_b, count(*) FILTER (a.ix IS NOT NULL AND b.ix IS NOT NULL) AS n_both
FROM a FULL JOIN b ON a.dist_id = b.dist_id AND a.ix = b.ix AND a.iy = b.iy AND a.iz = b.iz GROUP BY 1""")
def mask_overlap(spark, d):
    a = view(spark, d, S.MASK).withColumn("occ", F.lit(True))
    return VX.overlap_counts(a, a.withColumn("ix", F.col("ix") + 1), ["dist_id"])


@query("A17_overlap_metrics", f"""WITH a AS ({MASK}), b AS (SELECT dist_id, ix + 1 AS ix, iy, iz FROM a), c AS (SELECT coalesce(a.dist_id, b.dist_id) AS dist_id, count(a.ix) AS n_a, count(b.ix) AS n_b, count(*) FILTER (a.ix IS NOT NULL AND b.ix IS NOT NULL) AS n_both FROM a FULL JOIN b ON a.dist_id = b.dist_id AND a.ix = b.ix AND a.iy = b.iy AND a.iz = b.iz GROUP BY 1)
SELECT dist_id, {R('n_a * 0.125')} AS v_a, {R('200.0E0 * n_both / (n_a + n_b)')} AS dice, {R('100.0E0 * n_both / (n_a + n_b - n_both)')} AS iou, {R('100.0E0 * n_both / n_b')} AS coverage, {R('100.0E0 * (n_a - n_both) / n_a')} AS outside FROM c""")
def overlap_metrics(spark, d):
    a = view(spark, d, S.MASK).withColumn("occ", F.lit(True))
    m = VX.overlap_metrics(VX.overlap_counts(a, a.withColumn("ix", F.col("ix") + 1), ["dist_id"]), 0.5)
    return m.select("dist_id", *[rnd(c).alias(c) for c in ("v_a", "dice", "iou", "coverage", "outside")])


# Components by passing the smallest voxel on to all 26 neighbours until nothing changes.
_REGIONS = f"""WITH RECURSIVE m AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY dist_id, ix, iy, iz) AS p FROM ({MASK}) q),
 e AS MATERIALIZED (SELECT a.p AS a, b.p AS b FROM m a JOIN m b ON a.dist_id = b.dist_id AND a.p <> b.p AND abs(a.ix - b.ix) <= 1 AND abs(a.iy - b.iy) <= 1 AND abs(a.iz - b.iz) <= 1),
 lab(p, l) USING KEY (p) AS (SELECT p, p FROM m UNION SELECT e.a, min(lab.l) FROM lab JOIN e ON e.b = lab.p JOIN recurring.lab r ON r.p = e.a GROUP BY e.a, r.l HAVING min(lab.l) < r.l)"""


@query("C15_single_region_check", f"{_REGIONS} SELECT dist_id, count(DISTINCT l) AS n_regions, count(DISTINCT l) = 1 AS single FROM m JOIN lab USING (p) GROUP BY 1")
def single_region(spark, d):
    return VX.region_counts(view(spark, d, S.MASK), ["dist_id"])


def _corners() -> str:
    """Corners of both facets of a face: 0, p, r of the face's four, counted from a corner of the voxel; those of an axis in one number."""
    text = ["000", "001", "011", "010"], ["100", "110", "111", "101"], ["000", "100", "101", "001"], ["010", "011", "111", "110"], ["000", "010", "110", "100"], ["001", "101", "111", "011"]
    at = lambda k, a: f"CAST(m.i{'xyz'[a]} + CAST(substring(CASE q.face {' '.join(f'WHEN {i} THEN ' + repr(' '.join(c)) for i, c in enumerate(text))} END, 4 * ({k}) + {a + 1}, 1) AS INT) AS DOUBLE)"
    return ", ".join(f"{at('0', a)} + 100 * {at('t.p', a)} + 10000 * {at('t.r', a)} AS {'xyz'[a]}s" for a in range(3))


_DIRS = "(VALUES (0, -1, 0, 0), (1, 1, 0, 0), (2, 0, -1, 0), (3, 0, 1, 0), (4, 0, 0, -1), (5, 0, 0, 1)) q(face, a, b, c)"


@query("C16_boundary_surface", f"""WITH m AS ({MASK}) SELECT m.dist_id, m.ix, m.iy, m.iz, CAST(q.face AS INT) AS face, CAST(t.half AS INT) AS half, {_corners()} FROM m, {_DIRS}, (VALUES (0, 1, 2), (1, 2, 3)) t(half, p, r)
 WHERE NOT EXISTS (SELECT 1 FROM m n WHERE n.dist_id = m.dist_id AND n.ix = m.ix + a AND n.iy = m.iy + b AND n.iz = m.iz + c)""")
def boundary_surface(spark, d):
    s = ME.voxel_surface(view(spark, d, S.MASK), ["dist_id"])
    return s.select("dist_id", "ix", "iy", "iz", "face", "half", *[(F.col(f"v1.{a}") + 100 * F.col(f"v2.{a}") + 10000 * F.col(f"v3.{a}")).alias(f"{a}s") for a in "xyz"])


# Complete 10 x 11 x 9 grid per supplier.
OCC = "SELECT l_suppkey AS dist_id, CAST(floor((l_quantity - 1) / 5) AS INT) AS ix, CAST(floor(l_discount * 100 + 0.5) AS INT) AS iy, CAST(floor(l_tax * 100 + 0.5) AS INT) AS iz, max(l_extendedprice) > 60000 AS occ FROM {lineitem} GROUP BY 1, 2, 3, 4"
_G = f"SELECT s_suppkey AS dist_id, CAST(i AS INT) AS ix, CAST(j AS INT) AS iy, CAST(k AS INT) AS iz FROM supplier, range(10) a(i), range(11) b(j), range(9) c(k)"


def voxel_grid(spark, d):
    g = table(spark, d, "supplier").select(F.col("s_suppkey").alias("dist_id"))
    for c, n in (("ix", 9), ("iy", 10), ("iz", 8)):
        g = g.withColumn(c, F.explode(F.sequence(F.lit(0), F.lit(n))))
    occ = view(spark, d, OCC)
    return g.join(occ, ["dist_id", "ix", "iy", "iz"], "left").withColumn("occ", F.coalesce("occ", F.lit(False)))


_SDF = f"""WITH g AS MATERIALIZED (SELECT g0.*, coalesce(o.occ, false) AS occ FROM ({_G}) g0 LEFT JOIN ({sub(OCC)}) o ON o.dist_id = g0.dist_id AND o.ix = g0.ix AND o.iy = g0.iy AND o.iz = g0.iz), {_edt('fo', 'b.occ')}, {_edt('fe', 'NOT b.occ')}"""


@query("C21_signed_distance", f"{_SDF} SELECT fo.dist_id, fo.ix, fo.iy, fo.iz, {R('(sqrt(fo.f) - sqrt(fe.f)) * 0.5')} AS sdf FROM fo JOIN fe USING (dist_id, ix, iy, iz)")
def signed_distance(spark, d):
    return VX.signed_distance(voxel_grid(spark, d), ["dist_id"], 0.5).withColumn("sdf", rnd("sdf"))


@query("C21_truncated_distance", f"{_SDF} SELECT fo.dist_id, fo.ix, fo.iy, fo.iz, {R('greatest(-1.0, least(1.0, (sqrt(fo.f) - sqrt(fe.f)) * 0.5))')} AS sdf FROM fo JOIN fe USING (dist_id, ix, iy, iz)")
def truncated_distance(spark, d):
    return VX.signed_distance(voxel_grid(spark, d), ["dist_id"], 0.5, truncate=True).withColumn("sdf", rnd("sdf"))
