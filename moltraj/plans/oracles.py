"""SQL twins of the registered queries, over the test tables."""

from __future__ import annotations

from moltraj.operators.selection import PROJECTIONS, TABLES, directions
from moltraj.plans.surrogates import ATOMS_SQL, EVENTS_SQL, FRAMES_SQL, KEPT_SQL
from moltraj.schema import DSSP_CODES, RESIDUE_CODES, VIRTUAL_CB

KEY = "domain_id, temperature, replicate"
BLANKS = "' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11)"


def code_case(table: dict[str, int], key: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in table.items()) + " ELSE 0 END"


def point(residue: str, atom: int, absent: str) -> str:
    """Coordinates of atom number `atom` of a residue, as a DOUBLE[3], or NULL where the atom is not named."""
    at = f"(4 * ({residue}) + {atom}) * 3"
    parts = ", ".join(f"CAST(e[{at} + {k}] AS DOUBLE)" for k in (1, 2, 3))
    return f"CASE WHEN {absent} THEN NULL ELSE [{parts}] END"


POINTS_SQL = f"""
points AS (
  SELECT {KEY}, frame, vec_id, e, CAST(r AS INTEGER) AS residue_index,
         {point('r', 0, 'r = 3')} AS n, {point('r', 1, 'false')} AS ca, {point('r', 2, 'false')} AS c,
         {point('r', 3, 'r IN (1, 3)')} AS cb
  FROM source_frames, unnest(range(0, 5)) AS u(r)),
walk AS (
  SELECT *, lag(c) OVER w AS cp, lead(n) OVER w AS nn, lead(ca) OVER w AS can FROM points
  WINDOW w AS (PARTITION BY {KEY}, frame ORDER BY residue_index))
"""


def sub(a: str, b: str) -> str:
    return "[" + ", ".join(f"{a}[{k}] - {b}[{k}]" for k in (1, 2, 3)) + "]"


def crossed(a: str, b: str) -> str:
    return f"[{a}[2]*{b}[3] - {a}[3]*{b}[2], {a}[3]*{b}[1] - {a}[1]*{b}[3], {a}[1]*{b}[2] - {a}[2]*{b}[1]]"


def dotted(a: str, b: str) -> str:
    return f"({a}[1]*{b}[1] + {a}[2]*{b}[2] + {a}[3]*{b}[3])"


def torsions_sql() -> str:
    """Dihedrals in the textbook form: normalised axis, projections, atan2."""
    sides = {"phi": ("cp", "n", "ca", "c"), "psi": ("n", "ca", "c", "nn"), "omega": ("ca", "c", "nn", "can")}
    ctes, source = [], "walk"
    for name, (p0, p1, p2, p3) in sides.items():
        ctes.append(f"""{name}_1 AS (SELECT *, {sub(p0, p1)} AS b0, {sub(p2, p1)} AS b1, {sub(p3, p2)} AS b2 FROM {source}),
{name}_2 AS (SELECT * EXCLUDE (b1), list_transform(b1, lambda q: q / greatest(sqrt({dotted('b1', 'b1')}), 1e-8)) AS a
  FROM {name}_1),
{name}_3 AS (SELECT * EXCLUDE (b0, b2),
  [b0[1] - {dotted('b0', 'a')}*a[1], b0[2] - {dotted('b0', 'a')}*a[2], b0[3] - {dotted('b0', 'a')}*a[3]] AS v,
  [b2[1] - {dotted('b2', 'a')}*a[1], b2[2] - {dotted('b2', 'a')}*a[2], b2[3] - {dotted('b2', 'a')}*a[3]] AS w
  FROM {name}_2),
{name}_4 AS (SELECT * EXCLUDE (v, w, a),
  CASE WHEN {p0} IS NULL OR {p1} IS NULL OR {p2} IS NULL OR {p3} IS NULL THEN NULL
       ELSE atan2({dotted(crossed('a', 'v'), 'w')}, {dotted('v', 'w')}) END AS {name} FROM {name}_3)""")
        source = f"{name}_4"
    return ",\n".join(ctes)


A, B, C = VIRTUAL_CB
CB_SQL = ", ".join(
    f"""CASE WHEN cb IS NOT NULL THEN cb[{k}] WHEN n IS NOT NULL AND c IS NOT NULL THEN
      ca[{k}] + ({A})*((ca[{i}] - n[{i}])*(c[{j}] - ca[{j}]) - (ca[{j}] - n[{j}])*(c[{i}] - ca[{i}]))
      + {B}*(ca[{k}] - n[{k}]) + ({C})*(c[{k}] - ca[{k}]) ELSE ca[{k}] END AS cb_{axis}"""
    for k, i, j, axis in ((1, 2, 3, "x"), (2, 3, 1, "y"), (3, 1, 2, "z"))
)
LABEL_SQL = "CASE WHEN e[residue_index + 1] > 0 THEN 'H' WHEN e[residue_index + 1] < -0.1 THEN 'E' ELSE ' ' END"


def features_sql(frames: str) -> str:
    """CTEs ending in `features`: one row per frame and residue, from `frames` or `kept`."""
    base = KEPT_SQL if frames == "kept" else FRAMES_SQL
    trig = ", ".join(
        f"coalesce(sin({t}), 0) AS {t}_sin, coalesce(cos({t}), 0) AS {t}_cos" for t in ("phi", "psi", "omega")
    )
    names = "list_extract(['ALA', 'GLY', 'SER', 'TRP', 'VAL'], residue_index + 1)"
    return f"""{base}, source_frames AS (SELECT * FROM {frames}),
{POINTS_SQL}, {torsions_sql()},
features AS (
  SELECT {KEY}, frame, residue_index, ca[1] AS ca_x, ca[2] AS ca_y, ca[3] AS ca_z, {CB_SQL}, {trig},
         {code_case(DSSP_CODES, LABEL_SQL)} AS dssp, {code_case(RESIDUE_CODES, names)} AS residue_type
  FROM omega_4)"""


def out(name: str, digits: int = 6) -> str:
    return f"round({name}, {digits}) + 0.0 AS {name}"


def f16_sql(x: str) -> str:
    """Half-precision rounding as text; only for finite values below the overflow bound."""
    step = f"pow(2.0, greatest(floor(log2(abs({x}))), -14) - 10)"
    return f"CASE WHEN {x} = 0 THEN {x} ELSE round_even({x} / {step}, 0) * {step} END"


def canon_sql(x: str) -> str:
    """The canonical whole number as sixteen hexadecimal digits."""
    return f"lpad(to_hex(CAST(floor({x} * 10000.0 + 0.5) AS BIGINT)), 16, '0')"


TORSION_NAMES = [f"{t}_{p}" for t in ("phi", "psi", "omega") for p in ("sin", "cos")]
CA_NAMES = ["ca_x", "ca_y", "ca_z"]
CB_NAMES = ["cb_x", "cb_y", "cb_z"]


def hash_sql() -> str:
    """CTEs ending in `hashes`: the three-level content hash of each trajectory."""
    numbers = " || ".join(canon_sql(n) for n in [*CA_NAMES, *CB_NAMES, *TORSION_NAMES])
    whole = " || ".join(f"lpad(to_hex(CAST({n} AS BIGINT)), 16, '0')" for n in ("dssp", "residue_type", "1"))
    return f"""{features_sql('kept')},
frame_digests AS (SELECT {KEY}, frame AS k, sha256(unhex(string_agg({numbers} || {whole}, '' ORDER BY residue_index))) AS d
  FROM features GROUP BY {KEY}, frame),
blocks AS (SELECT {KEY}, CAST(floor(k / 1024) AS BIGINT) AS up, sha256(string_agg(d, '' ORDER BY k)) AS d
  FROM frame_digests GROUP BY {KEY}, up),
upper_blocks AS (SELECT {KEY}, CAST(floor(up / 1024) AS BIGINT) AS top, sha256(string_agg(d, '' ORDER BY up)) AS d
  FROM blocks GROUP BY {KEY}, top),
hashes AS (SELECT {KEY}, sha256(string_agg(d, '' ORDER BY top)) AS content_hash FROM upper_blocks GROUP BY {KEY})"""


def tree_hash_sql(source: str, column: str) -> str:
    return f"""copies AS (SELECT {column} AS d, count(*) AS n FROM {source} GROUP BY 1),
tree_0 AS (SELECT d, d || '*' || n AS h FROM copies),
tree_1 AS (SELECT substr(d, 1, 6) AS d, sha256(string_agg(h, '' ORDER BY tree_0.d)) AS h FROM tree_0 GROUP BY 1),
tree_2 AS (SELECT substr(d, 1, 3) AS d, sha256(string_agg(h, '' ORDER BY tree_1.d)) AS h FROM tree_1 GROUP BY 1),
tree AS (SELECT sha256(string_agg(h, '' ORDER BY d)) AS dataset_hash FROM tree_2)"""


WITH = "WITH "


def oracle_sql() -> dict[str, str]:
    sql = {}

    sql["domain_list_scan"] = f"""
      SELECT doc_id, CAST(pos AS INTEGER) AS pos, entry FROM (
        SELECT doc_id, generate_subscripts(parts, 1) - 1 AS pos, trim(unnest(parts), {BLANKS}) AS entry
        FROM (SELECT doc_id, regexp_split_to_array(text, '\\r\\n|\\r|\\n') AS parts FROM documents) d) l
      WHERE length(entry) > 0 AND NOT starts_with(entry, '#')"""

    listing = """
files AS (SELECT DISTINCT CASE WHEN o_orderkey % 3 = 0 THEN 'root/traj_c' ELSE 'root/data/traj_c' END || o_custkey || '.h5' AS path,
                 'c' || o_custkey AS domain_id FROM orders),
wanted AS (SELECT 'c' || p_partkey AS domain_id FROM part),
best AS (SELECT domain_id, coalesce(min(path) FILTER (path NOT LIKE 'root/data/%'), min(path)) AS source_path
         FROM files GROUP BY 1)"""
    sql["file_resolution"] = f"""
      WITH {listing} SELECT domain_id, source_path FROM wanted LEFT JOIN best USING (domain_id)"""
    sql["missing_files"] = f"""
      WITH {listing} SELECT DISTINCT domain_id FROM wanted WHERE domain_id NOT IN (SELECT domain_id FROM files)"""
    sql["domain_list_audit"] = f"""
      WITH {listing}, w AS (SELECT DISTINCT domain_id FROM wanted), s AS (SELECT DISTINCT domain_id FROM files)
      SELECT (SELECT count(*) FROM wanted) AS expected_count, (SELECT count(*) FROM s) AS observed_count,
             (SELECT count(*) FROM w WHERE domain_id NOT IN (SELECT domain_id FROM s)) AS n_missing,
             (SELECT count(*) FROM s WHERE domain_id NOT IN (SELECT domain_id FROM w)) AS n_unexpected,
             NOT EXISTS (SELECT * FROM w WHERE domain_id NOT IN (SELECT domain_id FROM s))
               AND NOT EXISTS (SELECT * FROM s WHERE domain_id NOT IN (SELECT domain_id FROM w)) AS passed"""

    catalog = f"""{EVENTS_SQL},
found AS (SELECT DISTINCT domain_id, CASE WHEN event_type = 'error' THEN 'meta' ELSE CAST(temperature AS VARCHAR) END AS temperature,
                 replicate FROM event_frames),
held AS (SELECT DISTINCT domain_id, CAST(temperature AS VARCHAR) AS temperature, replicate FROM event_frames
         WHERE value > 20),
catalog AS (SELECT domain_id, temperature, replicate, domain_id || '_' || temperature || '_' || replicate AS traj_id
            FROM found SEMI JOIN held USING (domain_id, temperature, replicate)
            WHERE regexp_full_match(temperature, '[0-9]+'))"""
    sql["trajectory_catalog"] = f"WITH {catalog} SELECT * FROM catalog"
    sql["plan_summary"] = f"""
      WITH {catalog}, sizes AS (SELECT domain_id, temperature, replicate, count(*) AS n FROM event_frames GROUP BY ALL),
      residue_counts AS (SELECT domain_id, CAST(count(DISTINCT event_id % 7) AS INTEGER) AS n_res FROM event_frames GROUP BY 1)
      SELECT (SELECT count(DISTINCT domain_id) FROM event_frames) AS n_domains, count(*) AS n_trajectories,
             coalesce(max(CASE WHEN s.replicate % 2 = 0 THEN n + s.replicate ELSE n END), 0) AS max_frames,
             coalesce(max(n_res), 0) AS max_residues
      FROM catalog c JOIN sizes s ON c.domain_id = s.domain_id AND c.temperature = CAST(s.temperature AS VARCHAR)
        AND c.replicate = s.replicate JOIN residue_counts r ON r.domain_id = c.domain_id"""
    sql["atom_count_audit"] = f"""
      WITH {EVENTS_SQL} SELECT 'd' || user_id AS domain_id, count(*) FILTER (value >= 5) AS listed_atoms, count(*) AS stored_atoms
      FROM event_frames GROUP BY user_id HAVING count(*) FILTER (value >= 5) <> count(*)"""

    sql["pdb_atom_names"] = f"""
      WITH {EVENTS_SQL}
      SELECT user_id, chunk, CAST(row_number() OVER (PARTITION BY user_id, chunk ORDER BY frame) - 1 AS INTEGER) AS atom_index,
             CASE event_type WHEN 'click' THEN 'N' WHEN 'view' THEN 'CA' WHEN 'purchase' THEN 'C' WHEN 'signup' THEN 'CB' ELSE 'O' END
               AS atom_name
      FROM (SELECT *, CAST(floor(frame / 64) AS BIGINT) AS chunk FROM event_frames) q WHERE value >= 5"""
    sql["text_decode"] = f"SELECT doc_id, md5(trim(text, {BLANKS})) AS digest, length(trim(text, {BLANKS})) AS n_chars FROM documents"
    sql["source_report"] = """
      SELECT 'vec_id' AS column_name, 'bigint' AS data_type, count(*) AS n_rows, count(*) FILTER (vec_id IS NULL) AS n_nulls,
             CAST(NULL AS INTEGER) AS min_size, CAST(NULL AS INTEGER) AS max_size FROM embeddings
      UNION ALL SELECT 'embedding', 'array<float>', count(*), count(*) FILTER (embedding IS NULL),
             CAST(min(len(embedding)) AS INTEGER), CAST(max(len(embedding)) AS INTEGER) FROM embeddings
      UNION ALL SELECT 'label', 'int', count(*), count(*) FILTER (label IS NULL), NULL, NULL FROM embeddings"""

    sql["residue_topology"] = f"""
      WITH {ATOMS_SQL} SELECT domain_id, residue_index, resid, resname, first_atom, n_atoms, n_index, ca_index, c_index,
             cb_index, {code_case(RESIDUE_CODES, 'resname')} AS residue_type FROM residues"""
    sql["residue_atoms"] = f"""
      WITH {ATOMS_SQL} SELECT domain_id, residue_index, atom_index, coalesce(resname, 'UNK') AS resname, atom_name
      FROM atoms LEFT JOIN residues USING (domain_id, chain, resid, resname)"""
    sql["missing_ca"] = f"WITH {ATOMS_SQL} SELECT domain_id, residue_index, resname FROM residues WHERE ca_index IS NULL"

    sql["unfolded_filter"] = f"""
      WITH {KEPT_SQL} SELECT domain_id, temperature, replicate, source_frame, frame FROM kept"""
    sql["virtual_cb"] = f"""
      WITH {features_sql('frames')} SELECT {KEY}, frame, residue_index, {', '.join(out(n) for n in CB_NAMES)} FROM features"""
    sql["backbone_torsions"] = f"""
      WITH {features_sql('frames')} SELECT {KEY}, frame, residue_index, {', '.join(out(n) for n in TORSION_NAMES)} FROM features"""
    sql["dihedral_angles"] = f"""
      WITH {FRAMES_SQL}, source_frames AS (SELECT * FROM frames), {POINTS_SQL}, {torsions_sql()}
      SELECT {KEY}, frame, residue_index, round(psi, 6) + 0.0 AS psi FROM omega_4 WHERE psi IS NOT NULL"""
    sql["torsion_coherence"] = f"""
      WITH {features_sql('kept')}
      SELECT {KEY}, count(*) AS n_rows, round(avg(phi_cos), 6) + 0.0 AS phi_coherence,
             round(avg(psi_cos), 6) + 0.0 AS psi_coherence, round(avg(omega_cos), 6) + 0.0 AS omega_coherence
      FROM features GROUP BY {KEY}"""
    sql["dssp_codes"] = f"""
      SELECT event_id, {code_case(DSSP_CODES, "upper(substr(event_type, 1, 1))")} AS dssp FROM events"""
    sql["f16_quantize"] = f"""
      WITH x AS (SELECT vec_id, CAST(pos AS INTEGER) AS pos, CAST(v AS DOUBLE) AS v FROM (
        SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS pos, unnest(embedding) AS v FROM embeddings) u)
      SELECT vec_id, pos, {f16_sql('v')} AS stored FROM x"""
    sql["dense_grid"] = f"""
      WITH {features_sql('kept')},
      f AS (SELECT CAST(ceil((max(frame) + 1) / 256.0) * 256 AS INTEGER) AS n FROM features),
      cells AS (SELECT {KEY}, CAST(fr AS INTEGER) AS frame, CAST(rs AS INTEGER) AS residue_index
        FROM (SELECT DISTINCT {KEY} FROM features) t, f, unnest(range(0, f.n)) AS a(fr), unnest(range(0, 512)) AS b(rs))
      SELECT {KEY}, frame, count(*) AS n_cells, count(*) FILTER (ca_x IS NOT NULL) AS n_real,
             CAST(sum(coalesce(dssp, 0)) AS BIGINT) AS dssp_sum, round(sum(coalesce(phi_cos, 0)), 6) + 0.0 AS phi_sum
      FROM cells LEFT JOIN features USING ({KEY}, frame, residue_index) GROUP BY {KEY}, frame"""
    sql["trajectory_hash"] = f"WITH {hash_sql()} SELECT {KEY}, content_hash FROM hashes"
    sql["dataset_hash"] = f"""
      WITH {EVENTS_SQL}, h AS (SELECT sha256(traj_id || ':' || n_frames) AS content_hash FROM meta)
      SELECT sha256(string_agg(content_hash, '' ORDER BY content_hash)) AS dataset_hash FROM h"""
    sql["dataset_hash_tree"] = f"""
      WITH h AS (SELECT sha256(event_type || ':' || CAST(floor(value) AS BIGINT)) AS content_hash FROM events), {tree_hash_sql('h', 'content_hash')}
      SELECT dataset_hash FROM tree"""

    split = f"""{EVENTS_SQL},
ordered AS (SELECT cath_topology, row_number() OVER (ORDER BY md5('1729:' || cath_topology), cath_topology) - 1 AS pos,
                   count(*) OVER () AS n FROM (SELECT DISTINCT cath_topology FROM meta) d),
split AS (SELECT cath_topology, pos, CASE WHEN pos < floor(n * 0.8) THEN 'train'
                 WHEN pos < floor(n * 0.8) + floor(n * 0.1) THEN 'val' ELSE 'test' END AS split FROM ordered)"""
    sql["topology_split"] = f"WITH {split} SELECT cath_topology, pos, split FROM split"
    sql["split_assignment"] = f"WITH {split} SELECT traj_id, cath_topology, split FROM meta JOIN split USING (cath_topology)"

    sql["shape_report"] = f"""
      WITH {KEPT_SQL}, x AS (SELECT count(DISTINCT domain_id || '_' || temperature || '_' || replicate) AS n_trajectories,
        CAST(ceil((max(frame) + 1) / 256.0) * 256 AS BIGINT) AS n_frames, CAST(512 AS BIGINT) AS n_residues FROM kept)
      SELECT array_name, n_trajectories, CASE WHEN array_name <> 'residue_mask' THEN n_frames END AS n_frames, n_residues,
             CAST(CASE array_name WHEN 'ca' THEN 3 WHEN 'cb' THEN 3 WHEN 'backbone_torsions' THEN 6 END AS INTEGER) AS n_parts
      FROM x, (VALUES ('ca'), ('cb'), ('backbone_torsions'), ('dssp'), ('sasa'), ('residue_mask')) AS a(array_name)"""
    gap = " + ".join(f"pow({c} - CAST({f16_sql(c)} AS FLOAT), 2)" for c in CA_NAMES)
    sql["roundtrip_rmsd"] = f"""
      WITH {features_sql('kept')}
      SELECT {KEY}, count(DISTINCT frame) AS n_frames, round(sqrt(avg(({gap}) / 3)), 9) AS rmsd_angstrom,
             sqrt(avg(({gap}) / 3)) < 0.05 AS passed FROM features GROUP BY {KEY}"""

    windows = f"""{EVENTS_SQL},
eligible AS (SELECT traj_index, traj_id, n_frames, row_number() OVER (ORDER BY traj_index) - 1 AS place,
                    count(*) OVER () AS total FROM meta WHERE n_frames >= 64),
draws AS (SELECT i AS window_id, CAST('0x' || substr(md5('0:' || i || ':t'), 1, 8) AS BIGINT) AS pick,
                 CAST('0x' || substr(md5('0:' || i || ':s'), 1, 8) AS BIGINT) AS slide FROM range(100) AS r(i)),
windows AS (SELECT window_id, traj_index, traj_id, slide % (n_frames - 63) AS start, slide % (n_frames - 63) + 64 AS stop
            FROM draws JOIN eligible ON place = pick % total)"""
    sql["random_windows"] = f"WITH {windows} SELECT window_id, traj_index, traj_id, start, stop FROM windows"
    sql["window_rows"] = f"""
      WITH {windows} SELECT window_id, count(*) AS n_frames, round(sum(value), 6) + 0.0 AS value_sum
      FROM event_frames f JOIN windows w ON f.traj_index = w.traj_index AND f.frame >= w.start AND f.frame < w.stop
      GROUP BY window_id"""
    sql["window_percentiles"] = """
      SELECT round(quantile_cont(value, 0.5), 6) AS p50_ms, round(quantile_cont(value, 0.99), 6) AS p99_ms,
             max(value) AS max_ms FROM events"""
    damaged = f"""
stored AS (SELECT *, CASE WHEN temperature = 320 AND replicate = 1 THEN 0.125 ELSE 0.0 END AS moved FROM features
           WHERE NOT (temperature = 450 AND replicate = 0 AND frame % 3 = 1)),
halved AS (SELECT {KEY}, frame, residue_index, {", ".join(f"CAST({f16_sql(f'({c} + moved)')} AS FLOAT) AS s_{c}" for c in CA_NAMES)} FROM stored),
trips AS (SELECT {KEY}, count(DISTINCT frame) AS n_frames,
    sqrt(avg(({" + ".join(f"pow({c} - s_{c}, 2)" for c in CA_NAMES)}) / 3)) AS rmsd, bool_and(s_ca_x IS NOT NULL) AS whole
  FROM features LEFT JOIN halved USING ({KEY}, frame, residue_index) GROUP BY {KEY})"""
    sql["roundtrip_damaged"] = f"""
      WITH {features_sql('kept')}, {damaged}
      SELECT {KEY}, n_frames, round(rmsd, 9) AS rmsd_angstrom, whole AND rmsd < 0.05 AS passed FROM trips"""

    def verdict(domain: str, more: int, trips: str) -> str:
        return f"""
      WITH {features_sql('kept')}, {EVENTS_SQL.strip()}, {trips},
      listed AS (SELECT DISTINCT {domain} AS d FROM embeddings), observed AS (SELECT DISTINCT domain_id AS d FROM frames),
      manifest AS (SELECT sha256(string_agg(h, '' ORDER BY h)) AS whole FROM (SELECT sha256(traj_id || ':' || n_frames) AS h FROM meta)),
      again AS (SELECT sha256(string_agg(h, '' ORDER BY h)) AS whole
                FROM (SELECT sha256(traj_id || ':' || (max(frame) + 1 + {more})) AS h FROM event_frames GROUP BY traj_id)),
      checks AS (
        SELECT 'domain_list' AS check_name, NOT EXISTS (FROM listed WHERE d NOT IN (SELECT d FROM observed))
          AND NOT EXISTS (FROM observed WHERE d NOT IN (SELECT d FROM listed)) AS passed
        UNION ALL SELECT 'manifest_hash', m.whole = a.whole FROM manifest m, again a
        UNION ALL SELECT 'roundtrip_rmsd', bool_and(passed) FROM checked
        UNION ALL SELECT 'window_latency', quantile_cont(value, 0.5) < 50.0 AND quantile_cont(value, 0.99) < 200.0 FROM events)
      SELECT check_name, passed FROM checks UNION ALL SELECT 'all', bool_and(passed) FROM checks"""

    sql["check_verdict"] = verdict("'d' || label", 0, f"checked AS (SELECT sqrt(avg(({gap}) / 3)) < 0.05 AS passed FROM features GROUP BY {KEY})")
    sql["check_verdict_failing"] = verdict("'d' || label || 'x'", 1, f"{damaged.strip()}, checked AS (SELECT whole AND rmsd < 0.05 AS passed FROM trips)")
    sql.update(label_sql())
    sql.update(frame_pair_sql())
    sql.update(metric_sql())
    sql.update(selection_sql())
    return sql


VECTORS_SQL = f"""{FRAMES_SQL},
spans AS (SELECT domain_id, temperature, replicate, sum(n) OVER (PARTITION BY domain_id ORDER BY temperature, replicate) - n AS start
          FROM (SELECT domain_id, temperature, replicate, count(*) AS n FROM frames GROUP BY ALL) c),
placed AS (SELECT f.*, domain_id || '_' || temperature || '_' || replicate AS traj_id, CAST(start + frame AS BIGINT) AS frame_global
           FROM frames f JOIN spans USING (domain_id, temperature, replicate)),
picked AS (SELECT *, CAST(p AS INTEGER) AS slot, CASE WHEN p = 7 THEN 19 ELSE CAST(floor(p * (19.0 / 7)) AS INTEGER) END AS at_point
           FROM placed, unnest(range(0, 8)) AS u(p)),
parts AS (SELECT domain_id, traj_id, frame, frame_global, CAST(slot * 3 + k AS INTEGER) AS component,
                 CAST(e[at_point * 3 + k + 1] AS DOUBLE) - avg(CAST(e[at_point * 3 + k + 1] AS DOUBLE))
                   OVER (PARTITION BY traj_id, frame, k) AS x
          FROM picked, unnest(range(0, 3)) AS v(k)),
scored AS (SELECT domain_id, traj_id, frame, frame_global, component,
                  (x - avg(x) OVER w) / greatest(stddev_pop(x) OVER w, 1e-6) AS z
           FROM parts WINDOW w AS (PARTITION BY traj_id, component))
"""


def covariance_sql(pairing: str) -> str:
    return f"""WITH {VECTORS_SQL},
pairs AS (SELECT a.domain_id, a.component, a.frame_global, a.z AS x, b.z AS y FROM scored a JOIN scored b ON {pairing}
          AND a.domain_id = b.domain_id AND a.component = b.component),
means AS (SELECT domain_id, component, (avg(x) + avg(y)) / 2 AS m FROM pairs GROUP BY ALL)
SELECT p.domain_id, p.component AS i, q.component AS j,
       round(avg(p.x * q.x + p.y * q.y) / 2 - any_value(mp.m) * any_value(mq.m), 6) + 0.0 AS c00,
       round(avg(p.x * q.y + p.y * q.x) / 2 - any_value(mp.m) * any_value(mq.m), 6) + 0.0 AS c0t
FROM pairs p JOIN pairs q ON p.domain_id = q.domain_id AND p.frame_global = q.frame_global AND p.component <= q.component
JOIN means mp ON mp.domain_id = p.domain_id AND mp.component = p.component
JOIN means mq ON mq.domain_id = q.domain_id AND mq.component = q.component
GROUP BY p.domain_id, p.component, q.component"""


def label_sql() -> dict[str, str]:
    sql = {}
    sql["selected_domains"] = f"""
      WITH {EVENTS_SQL} SELECT max(traj_index) AS pos, domain_id FROM meta GROUP BY domain_id ORDER BY pos LIMIT 20"""
    sql["frame_cap_offsets"] = f"""
      WITH {EVENTS_SQL}, s AS (SELECT *, CAST(coalesce(sum(n_frames) OVER (PARTITION BY domain_id ORDER BY traj_index
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM meta)
      SELECT domain_id, traj_id, traj_index, start, least(start + n_frames, 100) AS stop FROM s WHERE start < 100"""
    sql["frame_features"] = f"""
      WITH {VECTORS_SQL} SELECT traj_id, frame, frame_global, component, round(z, 6) + 0.0 AS z FROM scored"""
    sql["lagged_pairs"] = f"""
      WITH {EVENTS_SQL}, l AS (SELECT event_id, lead(event_id, 3) OVER w AS later_event, value, lead(value, 3) OVER w AS later_value
        FROM event_frames WINDOW w AS (PARTITION BY user_id ORDER BY frame))
      SELECT * FROM l WHERE later_event IS NOT NULL"""
    sql["lagged_covariance"] = covariance_sql("b.frame_global = a.frame_global + 1")
    sql["lagged_covariance_within"] = covariance_sql("b.traj_id = a.traj_id AND b.frame = a.frame + 1")
    sql["health_gate"] = f"""
      WITH {EVENTS_SQL}, s AS (SELECT domain_id, avg(value) AS score, avg(value) FILTER (event_type = 'view') AS baseline
        FROM event_frames GROUP BY 1), g AS (SELECT *, coalesce(score > baseline + 0.5, false) AS health_passed FROM s)
      SELECT domain_id, health_passed, CASE WHEN health_passed THEN 'vampnet' ELSE 'tica_kmeans' END AS method,
             CASE WHEN NOT health_passed THEN 'health_score_not_above_random_projection_baseline' END AS fallback_reason FROM g"""
    coordinates = ", ".join(
        f"round(coalesce(avg(p.e[{c + 1}]), any_value(c0.e[{c + 1}])), 6) + 0.0 AS e{c}" for c in range(64)
    )
    distance = " + ".join(f"pow(c.e[{c}] - p.e[{c}], 2)" for c in range(1, 65))
    sql["lloyd_step"] = f"""
      WITH points AS (SELECT 'd' || label AS domain_id, CAST(embedding AS DOUBLE[]) AS e, vec_id,
             row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS g, count(*) OVER (PARTITION BY label) AS n
        FROM embeddings),
      slots AS (SELECT domain_id, resolution, CAST(c AS INTEGER) AS cluster, CAST(floor(c * n / k) AS BIGINT) AS low,
             CAST(floor((c + 1) * n / k) AS BIGINT) AS high
        FROM (SELECT DISTINCT domain_id, n, r AS resolution, least(r, n) AS k FROM points, (VALUES (4), (16)) AS v(r)) d,
             unnest(range(0, k)) AS u(c)),
      picks AS (SELECT domain_id, resolution, cluster, low + CAST('0x' || substr(md5('0:' || domain_id || ':' || resolution
             || ':' || cluster), 1, 8) AS BIGINT) % (high - low) AS g FROM slots),
      first_c AS (SELECT domain_id, resolution, cluster, e FROM points JOIN picks USING (domain_id, g)),
      near AS (SELECT p.domain_id, p.vec_id, p.e, c.resolution, c.cluster,
             row_number() OVER (PARTITION BY p.vec_id, c.resolution ORDER BY {distance}, c.cluster) AS place
        FROM points p JOIN first_c c ON c.domain_id = p.domain_id)
      SELECT c0.domain_id, c0.resolution, c0.cluster, {coordinates}
      FROM first_c c0 LEFT JOIN near p ON p.place = 1 AND p.domain_id = c0.domain_id AND p.resolution = c0.resolution
        AND p.cluster = c0.cluster GROUP BY c0.domain_id, c0.resolution, c0.cluster"""
    sql["kmeans_best_of_five"] = best_of_five_sql()
    two = covariance_sql("b.frame_global = a.frame_global + 1").replace("round(", "(").replace(", 6) + 0.0 AS", ") AS")
    # With two components of full rank the squared eigenvalues of c00^-1 c0t add up to trace^2 - 2 det, in any basis.
    sql["tica_scores_planar"] = f"""
      WITH c AS (SELECT domain_id, any_value(c00) FILTER (i = 0 AND j = 0) AS a, any_value(c00) FILTER (i = 0 AND j = 1) AS b,
             any_value(c00) FILTER (i = 1 AND j = 1) AS d, any_value(c0t) FILTER (i = 0 AND j = 0) AS p,
             any_value(c0t) FILTER (i = 0 AND j = 1) AS q, any_value(c0t) FILTER (i = 1 AND j = 1) AS r
        FROM ({two}) WHERE j < 2 GROUP BY 1),
      s AS (SELECT domain_id, pow((d * p - 2 * b * q + a * r) / (a * d - b * b), 2) - 2 * (p * r - q * q) / (a * d - b * b) AS score FROM c),
      n AS (SELECT 'd' || label AS domain_id, count(*) AS n_total FROM embeddings GROUP BY 1)
      SELECT domain_id, n_total, CAST(2 AS INTEGER) AS dim, round(score, 6) + 0.0 AS score, round(score, 6) + 0.0 AS baseline FROM s JOIN n USING (domain_id)"""
    return sql


def best_of_five_sql(steps: int = 3, starts: int = 5, dims: int = 64) -> str:
    """Lloyd steps chained as common table expressions, for all starts side by side; then the start of least inertia."""
    gap = "list_sum(list_transform(range(1, %d), lambda i: (p.e[i] - c.e[i]) * (p.e[i] - c.e[i])))" % (dims + 1)
    means = ", ".join(f"avg(p.e[{i}])" for i in range(1, dims + 1))
    parts = [f"""WITH points AS (SELECT 'd' || label AS domain_id, CAST(embedding AS DOUBLE[]) AS e, vec_id,
             row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS g, count(*) OVER (PARTITION BY label) AS n
        FROM embeddings),
      slots AS (SELECT domain_id, resolution, CAST(s AS INTEGER) AS run, CAST(c AS INTEGER) AS cluster, CAST(floor(c * n / k) AS BIGINT) AS low,
             CAST(floor((c + 1) * n / k) AS BIGINT) AS high
        FROM (SELECT DISTINCT domain_id, n, r AS resolution, least(r, n) AS k FROM points, (VALUES (4), (16)) AS v(r)) d,
             unnest(range(0, k)) AS u(c), unnest(range(0, {starts})) AS w(s)),
      picks AS (SELECT domain_id, resolution, run, cluster, low + CAST('0x' || substr(md5(run || ':' || domain_id || ':' || resolution
             || ':' || cluster), 1, 8) AS BIGINT) % (high - low) AS g FROM slots),
      c0 AS (SELECT domain_id, resolution, run, cluster, e FROM points JOIN picks USING (domain_id, g))"""]
    for step in range(steps + 1):
        parts.append(f"""near{step} AS (SELECT *, row_number() OVER (PARTITION BY vec_id, resolution, run ORDER BY d, cluster) AS place
        FROM (SELECT p.domain_id, p.vec_id, p.g, p.e, c.resolution, c.run, c.cluster, {gap} AS d FROM points p JOIN c{step} c ON c.domain_id = p.domain_id) x
        QUALIFY place = 1)""")
        if step < steps:
            parts.append(f"""c{step + 1} AS (SELECT c.domain_id, c.resolution, c.run, c.cluster,
             CASE WHEN count(p.vec_id) = 0 THEN any_value(c.e) ELSE [{means}] END AS e
        FROM c{step} c LEFT JOIN near{step} p ON p.domain_id = c.domain_id AND p.resolution = c.resolution AND p.run = c.run AND p.cluster = c.cluster
        GROUP BY c.domain_id, c.resolution, c.run, c.cluster)""")
    parts.append(f"""costs AS (SELECT domain_id, resolution, run, round(sum(d), 9) AS inertia FROM near{steps} GROUP BY ALL),
      best AS (SELECT domain_id, resolution, run FROM costs QUALIFY row_number() OVER (PARTITION BY domain_id, resolution ORDER BY inertia, run) = 1),
      labelled AS (SELECT n.* FROM near{steps} n JOIN best USING (domain_id, resolution, run)),
      firsts AS (SELECT domain_id, resolution, cluster, min(g) AS f FROM labelled GROUP BY ALL),
      states AS (SELECT domain_id, resolution, cluster, row_number() OVER (PARTITION BY domain_id, resolution ORDER BY f) - 1 AS state FROM firsts)
      SELECT domain_id, resolution, vec_id, state FROM labelled JOIN states USING (domain_id, resolution, cluster)""")
    return ",\n".join(parts)


POINTS20_SQL = f"""{FRAMES_SQL},
points20 AS (SELECT {KEY}, frame, CAST(a AS INTEGER) AS at_point, CAST(e[a * 3 + 1] * CAST(20 AS FLOAT) AS DOUBLE) AS x,
                    CAST(e[a * 3 + 2] * CAST(20 AS FLOAT) AS DOUBLE) AS y, CAST(e[a * 3 + 3] * CAST(20 AS FLOAT) AS DOUBLE) AS z
             FROM frames, unnest(range(0, 20)) AS u(a))"""
D2 = "((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z))"


def frame_pair_sql() -> dict[str, str]:
    sql = {}
    sql["residue_sasa"] = f"""
      WITH {POINTS20_SQL},
      atoms AS (SELECT *, CAST(floor(at_point / 4) AS INTEGER) AS residue_index,
                       CASE at_point % 4 WHEN 0 THEN 1.55e0 ELSE 1.7e0 END + 1.4e0 AS reach
                FROM points20 WHERE at_point NOT IN (7, 12, 15)),
      sphere AS (SELECT k, sqrt(1 - h * h) * cos(k * (pi() * (3 - sqrt(5)))) AS ux, sqrt(1 - h * h) * sin(k * (pi() * (3 - sqrt(5)))) AS uy,
                        h AS uz FROM (SELECT k, 1 - (2 * k + 1) / 100.0e0 AS h FROM range(100) AS r(k)) s),
      probes AS (SELECT a.*, k, a.x + reach * ux AS px, a.y + reach * uy AS py, a.z + reach * uz AS pz FROM atoms a, sphere),
      free AS (SELECT p.* FROM probes p WHERE NOT EXISTS (SELECT 1 FROM atoms b WHERE b.domain_id = p.domain_id
        AND b.temperature = p.temperature AND b.replicate = p.replicate AND b.frame = p.frame AND b.at_point <> p.at_point
        AND (b.x - px) * (b.x - px) + (b.y - py) * (b.y - py) + (b.z - pz) * (b.z - pz) < b.reach * b.reach)),
      areas AS (SELECT {KEY}, frame, residue_index, sum(4 * pi() * reach * reach / 100.0e0) AS area FROM free GROUP BY ALL)
      SELECT {KEY}, frame, residue_index, round(coalesce(area, 0), 6) + 0.0 AS area
      FROM (SELECT DISTINCT {KEY}, frame, residue_index FROM atoms) r LEFT JOIN areas USING ({KEY}, frame, residue_index)"""
    sql["contact_graph"] = f"""
      WITH {POINTS20_SQL}, near AS (
        SELECT a.domain_id, a.temperature, a.replicate, a.frame, a.at_point AS residue_index, b.at_point AS other_residue_index, {D2} AS d2
        FROM points20 a JOIN points20 b ON a.domain_id = b.domain_id AND a.temperature = b.temperature AND a.replicate = b.replicate
          AND a.frame = b.frame AND a.at_point <> b.at_point WHERE {D2} < 36),
      placed AS (SELECT *, CAST(row_number() OVER (PARTITION BY {KEY}, frame, residue_index ORDER BY d2, other_residue_index) AS INTEGER)
        AS place FROM near)
      SELECT {KEY}, frame, residue_index, other_residue_index, place, round(sqrt(d2), 6) + 0.0 AS distance FROM placed WHERE place <= 4"""
    sql["positive_pairs"] = f"""
      WITH {EVENTS_SQL} SELECT a.user_id, a.event_id AS item, b.event_id AS later_item FROM event_frames a JOIN event_frames b
      ON a.user_id = b.user_id AND b.frame > a.frame AND (b.frame - a.frame) * 250 < 1000"""
    sql["length_buckets"] = """
      SELECT doc_id, CAST(CASE WHEN n <= 128 THEN 128 WHEN n <= 192 THEN 192 WHEN n <= 256 THEN 256 WHEN n <= 320 THEN 320 END AS INTEGER) AS bucket
      FROM (SELECT doc_id, len(string_split(text, ' ')) AS n FROM documents) d"""
    return sql


AVERAGE_RANK = "rank() OVER ({w} ORDER BY {v}) + (count(*) OVER (PARTITION BY {p}{v}) - 1) / 2.0e0"


def average_rank(value: str, group: str = "") -> str:
    window = f"PARTITION BY {group}" if group else ""
    return AVERAGE_RANK.format(w=window, v=value, p=f"{group}, " if group else "")


def pair_share(rows: str, score: str) -> str:
    """The share of (positive, negative) pairs of a group in which the positive scores higher, ties half, by counting."""
    return f"""(SELECT avg(CASE WHEN x.{score} > y.{score} THEN 1.0 WHEN x.{score} = y.{score} THEN 0.5 ELSE 0.0 END)
        FROM {rows} x JOIN {rows} y ON x.hit AND NOT y.hit AND x.domain_id = y.domain_id WHERE x.domain_id = g.domain_id)"""


def metric_sql() -> dict[str, str]:
    sql = {}
    sql["state_membership"] = f"""
      WITH {FRAMES_SQL}, source_frames AS (SELECT * FROM frames), {POINTS_SQL}, {torsions_sql()},
      q AS (SELECT *, degrees(psi) AS deg, ca[1] AS x FROM omega_4 WHERE psi IS NOT NULL)
      SELECT {KEY}, frame, residue_index, 'folded' AS state FROM q WHERE deg BETWEEN -90 AND 90 AND x BETWEEN -0.1e0 AND 0.1e0
      UNION ALL SELECT {KEY}, frame, residue_index, 'open' FROM q WHERE deg >= 90
      UNION ALL SELECT {KEY}, frame, residue_index, 'closed' FROM q WHERE deg <= -90 AND x >= 0"""
    found = f"""{EVENTS_SQL},
visits AS (SELECT traj_index, event_type AS state, (frame + 1) * 100.0e0 AS t,
                  row_number() OVER (PARTITION BY traj_index, event_type ORDER BY frame) AS v FROM event_frames),
found AS (SELECT traj_index, state, min(t) AS first_ps, min(t) FILTER (v >= 10) AS accumulated_ps,
                 least(min(t), min(t) FILTER (v >= 10)) AS discovered_ps FROM visits GROUP BY ALL)"""
    sql["state_discovery"] = f"WITH {found} SELECT * FROM found"
    sql["discovery_curve"] = f"""
      WITH {found}, steps AS (SELECT traj_index, discovered_ps, count(*) AS n FROM found GROUP BY ALL)
      SELECT traj_index, discovered_ps, CAST(sum(n) OVER (PARTITION BY traj_index ORDER BY discovered_ps) AS BIGINT) AS n_states FROM steps"""
    sql["discovery_auc"] = f"""
      WITH {found}, steps AS (SELECT traj_index, discovered_ps AS t, count(*) AS n FROM found GROUP BY ALL),
      curve AS (SELECT traj_index, least(t, 5000) AS t, sum(n) OVER w AS n, least(coalesce(lead(t) OVER w, 5000), 5000) AS until
                FROM steps WINDOW w AS (PARTITION BY traj_index ORDER BY t))
      SELECT traj_index, round(sum(n * (until - t)) / 1000, 6) + 0.0 AS auc FROM curve GROUP BY traj_index"""

    def counts(name: str, lag: int) -> str:
        return f"""{name} AS (SELECT domain_id, a AS from_state, b AS to_state, count(*) AS n,
          count(*) * 1.0e0 / sum(count(*)) OVER (PARTITION BY domain_id, a) AS p
          FROM (SELECT domain_id, event_type AS a, lead(event_type, {lag}) OVER (PARTITION BY traj_index ORDER BY frame) AS b
                FROM event_frames) q WHERE b IS NOT NULL GROUP BY domain_id, a, b)"""

    sql["transition_matrix"] = f"WITH {EVENTS_SQL}, {counts('m', 2)} SELECT domain_id, from_state, to_state, n, round(p, 6) + 0.0 AS p FROM m"
    sql["chapman_kolmogorov"] = f"""
      WITH {EVENTS_SQL}, {counts('one', 1)}, {counts('far', 3)},
      cube AS (SELECT a.domain_id, a.from_state, c.to_state, sum(a.p * b.p * c.p) AS p FROM one a
        JOIN one b ON b.domain_id = a.domain_id AND b.from_state = a.to_state
        JOIN one c ON c.domain_id = a.domain_id AND c.from_state = b.to_state GROUP BY ALL)
      SELECT domain_id, round(sqrt(sum(pow(coalesce(cube.p, 0) - coalesce(far.p, 0), 2))), 6) + 0.0 AS residual
      FROM cube FULL JOIN far USING (domain_id, from_state, to_state) GROUP BY domain_id"""
    sql["coverage_entropy"] = f"""
      WITH {EVENTS_SQL}, c AS (SELECT temperature, event_type, count(*) AS n FROM event_frames GROUP BY ALL),
      s AS (SELECT temperature, n * 1.0e0 / sum(n) OVER (PARTITION BY temperature) AS p FROM c)
      SELECT temperature, round(-sum(p * ln(p)), 6) + 0.0 AS entropy FROM s GROUP BY 1"""
    sql["mutual_information"] = f"""
      WITH {EVENTS_SQL}, c AS (SELECT domain_id, event_type AS l, floor(value / 25) AS r, count(*) * 1.0e0 AS n FROM event_frames GROUP BY ALL),
      s AS (SELECT domain_id, n, sum(n) OVER (PARTITION BY domain_id) AS t, sum(n) OVER (PARTITION BY domain_id, l) AS nl,
                   sum(n) OVER (PARTITION BY domain_id, r) AS nr FROM c)
      SELECT domain_id, round(sum(n / t * log2(n * t / (nl * nr))), 6) + 0.0 AS bits FROM s GROUP BY 1"""

    def auroc(source: str, score: str) -> str:
        return f"""r AS (SELECT domain_id, hit, {average_rank(score, 'domain_id')} AS rk FROM {source}),
      s AS (SELECT domain_id, sum(rk) FILTER (hit) AS sr, count(*) FILTER (hit) AS p, count(*) FILTER (NOT hit) AS q FROM r GROUP BY 1)
      SELECT domain_id, round((sr - p * (p + 1) / 2.0e0) / (p * q), 6) + 0.0 AS auroc FROM s"""

    scored = f"{EVENTS_SQL}, scored AS (SELECT *, event_type = 'purchase' AS hit FROM event_frames)"
    sql["auroc_by_domain"] = f"WITH {scored}, {auroc('scored', 'value')}"
    sql["auroc_time_shuffled"] = f"""
      WITH {scored}, o AS (SELECT traj_index, value AS shuffled, row_number() OVER (PARTITION BY traj_index
        ORDER BY md5('0:' || traj_index || ':' || frame), frame) - 1 AS frame FROM scored),
      mixed AS (SELECT domain_id, hit, shuffled FROM scored JOIN o USING (traj_index, frame)), {auroc('mixed', 'shuffled')}"""
    sql["auroc_drop"] = f"""
      WITH {scored}, o AS (SELECT traj_index, value AS shuffled, row_number() OVER (PARTITION BY traj_index
        ORDER BY md5('0:' || traj_index || ':' || frame), frame) - 1 AS frame FROM scored),
      mixed AS (SELECT domain_id, hit, shuffled FROM scored JOIN o USING (traj_index, frame)),
      b AS (SELECT domain_id, {pair_share('scored', 'value')} AS auroc FROM (SELECT DISTINCT domain_id FROM scored) g),
      m AS (SELECT domain_id, {pair_share('mixed', 'shuffled')} AS shuffled_auroc FROM (SELECT DISTINCT domain_id FROM scored) g)
      SELECT domain_id, round(auroc, 6) + 0.0 AS auroc, round(shuffled_auroc, 6) + 0.0 AS shuffled_auroc,
             round((auroc - shuffled_auroc) / auroc, 6) + 0.0 AS drop_share,
             coalesce(auroc > 0 AND (auroc - shuffled_auroc) / auroc >= 0.3, false) AS passed FROM b JOIN m USING (domain_id)"""
    sql["effective_rank_planar"] = """
      WITH v AS (SELECT label, var_pop(CAST(embedding[1] AS DOUBLE)) AS a, var_pop(CAST(embedding[2] AS DOUBLE)) AS d,
             covar_pop(CAST(embedding[1] AS DOUBLE), CAST(embedding[2] AS DOUBLE)) AS b FROM embeddings GROUP BY 1),
      e AS (SELECT label, 0.5 + sqrt(pow((a - d) / 2, 2) + b * b) / (a + d) AS p FROM v)
      SELECT label, round(exp(-p * ln(p) - (1 - p) * ln(1 - p)), 6) + 0.0 AS effective_rank FROM e"""
    sql["calibration_error"] = f"""
      WITH {scored}, b AS (SELECT domain_id, least(floor(value / 500.0e0 * 10), 9) AS bin, count(*) AS n, avg(value / 500.0e0) AS p,
        avg(CAST(hit AS DOUBLE)) AS y FROM scored GROUP BY ALL)
      SELECT domain_id, round(sum(abs(p - y) * n) / sum(n), 6) + 0.0 AS ece FROM b GROUP BY 1"""
    sql["spearman_by_domain"] = f"""
      WITH {EVENTS_SQL}, v AS (SELECT domain_id, floor(value) AS a, event_id % 97 AS b FROM event_frames),
      r AS (SELECT domain_id, {average_rank('a', 'domain_id')} AS ra, {average_rank('b', 'domain_id')} AS rb FROM v)
      SELECT domain_id, round(corr(ra, rb), 6) + 0.0 AS rho FROM r GROUP BY 1"""
    units = f"""{EVENTS_SQL}, units AS (SELECT * FROM (SELECT domain_id, replicate % 5 AS seed,
        round(avg(value) FILTER (event_type = 'purchase') - avg(value) FILTER (event_type = 'signup'), 4) AS delta
        FROM event_frames GROUP BY ALL) u WHERE delta IS NOT NULL)"""
    sql["paired_bootstrap"] = f"""
      WITH {units}, n AS (SELECT delta, row_number() OVER (ORDER BY md5(domain_id || ':' || seed)) - 1 AS slot, count(*) OVER () AS total FROM units),
      draws AS (SELECT i, CAST('0x' || substr(md5('0:' || i || ':' || slot), 1, 8) AS BIGINT) % total AS pick FROM n, range(1000) AS r(i)),
      means AS (SELECT i, avg(delta) AS m FROM draws JOIN n ON slot = pick GROUP BY i),
      ci AS (SELECT quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi FROM means)
      SELECT round((SELECT avg(delta) FROM units), 6) + 0.0 AS mean_delta, round(lo, 6) + 0.0 AS ci_low, round(hi, 6) + 0.0 AS ci_high,
             lo > 0 OR hi < 0 AS excludes_zero FROM ci"""
    sql["wilcoxon"] = f"""
      WITH {units}, r AS (SELECT delta, {average_rank('abs(delta)')} AS rk, count(*) OVER (PARTITION BY abs(delta)) AS c
        FROM units WHERE delta <> 0),
      s AS (SELECT count(*) AS n, coalesce(sum(rk) FILTER (delta > 0), 0) AS w_plus, coalesce(sum(rk) FILTER (delta < 0), 0) AS w_minus,
                   sum((pow(c, 3) - c) / c) AS ties FROM r)
      SELECT n, w_plus, w_minus,
             round((w_plus - n * (n + 1) / 4.0e0) / sqrt(n * (n + 1) * (2 * n + 1) / 24.0e0 - ties / 48), 6) + 0.0 AS z FROM s"""
    sql["frame_progress"] = f"""
      WITH {EVENTS_SQL} SELECT traj_id AS trajectory_id, max(frame + 1) AS reached_frame, count(*) AS n_frames, count(*) AS n_windows
      FROM event_frames GROUP BY 1"""
    sql["frame_ingest"] = "SELECT DISTINCT user_id, event_type, CAST(floor(value) AS BIGINT) AS whole FROM events"
    sql["active_runs"] = f"""
      WITH {EVENTS_SQL}, log AS (SELECT traj_id AS trajectory_id, CASE event_type WHEN 'signup' THEN 'submit' WHEN 'error' THEN 'terminate'
        ELSE 'extend' END AS kind, value AS ns, floor(value) AS priority, event_id AS seq FROM event_frames)
      SELECT trajectory_id, round(sum(ns) FILTER (kind <> 'terminate'), 4) + 0.0 AS budget_ns,
             arg_max(priority, seq) FILTER (kind = 'submit') AS priority, arg_max(kind, seq) AS last_kind
      FROM log GROUP BY 1 HAVING arg_max(kind, seq) <> 'terminate'"""
    sql["checksum_audit"] = """
      WITH held AS (SELECT 'd' || doc_id AS path, sha256(text) AS h FROM documents UNION ALL SELECT 'p' || page_id, sha256(html) FROM pages),
      published AS (SELECT 'd' || doc_id AS path, sha256(trim(text, ' ')) AS h FROM documents UNION ALL SELECT 'b' || item_id, sha256(text) FROM benchmark)
      SELECT path, CASE WHEN a.h IS NULL THEN 'missing' WHEN b.h IS NULL THEN 'unexpected' WHEN a.h = b.h THEN 'ok' ELSE 'mismatch' END AS state
      FROM held a FULL JOIN published b USING (path)"""
    return sql


def selection_sql() -> dict[str, str]:
    sql = {}
    candidates = f"""{EVENTS_SQL},
candidates AS (SELECT traj_index, avg(value) / 100 AS mean, stddev_pop(value) / 100 AS spread, arg_max(event_type, frame) AS region,
               arg_max(value, frame) AS last_value FROM event_frames GROUP BY 1),
visits AS (SELECT event_type AS region, count(*) AS n_visits FROM events GROUP BY 1)"""
    sql["acquisition_score"] = f"""
      WITH {candidates} SELECT traj_index, region, n_visits,
        round(mean + spread + sqrt(ln((SELECT sum(n_visits) FROM visits)) / n_visits), 6) + 0.0 AS score
      FROM candidates JOIN visits USING (region)"""
    places = f"""{FRAMES_SQL}, p AS (SELECT {KEY}, frame, vec_id, list_transform(e[1:60], lambda v: round(CAST(v AS DOUBLE), 3)) AS pl FROM frames),
      q AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY {KEY} ORDER BY frame DESC) = 1)"""
    gap = "list_sum(list_transform(range(1, 61), lambda i: (a.pl[i] - b.pl[i]) * (a.pl[i] - b.pl[i])))"
    sql["visits_within"] = f"""
      WITH {places} SELECT a.vec_id, count(*) AS n_visits FROM q a JOIN p b ON {gap} <= 1.25e0 * 1.25e0 GROUP BY a.vec_id"""
    tables = [
        "[" + ", ".join(f"CAST(floor(list_sum(list_transform(range(1, 61), lambda i: pl[i] * [{', '.join(map(repr, d))}][i])) / (6.0e0 * 1.25e0) + {shift!r}) AS BIGINT)" for d, shift in table) + "]"
        for table in directions(60, TABLES, PROJECTIONS)
    ]
    sql["visits_within_hashed"] = f"""
      WITH {places}, hp AS (SELECT *, [{", ".join(tables)}] AS h FROM p), hq AS (SELECT *, [{", ".join(tables)}] AS h FROM q)
      SELECT a.vec_id, count(*) AS n_visits FROM hq a JOIN hp b
      ON {" OR ".join(f"a.h[{t}] = b.h[{t}]" for t in range(1, TABLES + 1))} WHERE {gap} <= 1.25e0 * 1.25e0 GROUP BY a.vec_id"""
    sql["budgeted_selection"] = f"""
      WITH {EVENTS_SQL}, c AS (SELECT traj_id, event_id AS item, value AS score, md5('0:' || event_id) AS h FROM event_frames),
      lucky AS (SELECT traj_id, item, score, 'random' AS reason FROM (SELECT *, row_number() OVER (PARTITION BY traj_id ORDER BY h, item) AS n FROM c) q
                WHERE n <= 10 ORDER BY h, item LIMIT 2),
      used AS (SELECT traj_id, count(*) AS k FROM lucky GROUP BY 1),
      best AS (SELECT *, row_number() OVER (PARTITION BY traj_id ORDER BY score DESC, item) AS n FROM c WHERE item NOT IN (SELECT item FROM lucky)),
      greedy AS (SELECT traj_id, item, score, 'score' AS reason FROM best LEFT JOIN used USING (traj_id) WHERE n <= 10 - coalesce(k, 0)
                 ORDER BY score DESC, item LIMIT 38)
      SELECT * FROM lucky UNION ALL SELECT * FROM greedy"""
    sql["rank_round_robin"] = f"""
      WITH {EVENTS_SQL} SELECT traj_index, n_frames, row_number() OVER (ORDER BY n_frames, traj_index) AS place FROM meta"""
    sql["rank_random"] = f"""
      WITH {EVENTS_SQL}, n AS (SELECT traj_index, row_number() OVER (ORDER BY traj_index) - 1 AS slot, count(*) OVER () AS total FROM meta)
      SELECT i AS pick, traj_index FROM range(100) AS r(i) JOIN n ON slot = CAST('0x' || substr(md5('0:' || i), 1, 8) AS BIGINT) % total"""
    sql["rank_rmsd_velocity"] = f"""
      WITH {EVENTS_SQL}, s AS (SELECT traj_index, frame, abs(value - lag(value) OVER (PARTITION BY traj_index ORDER BY frame)) / 100.0e0 AS v
        FROM event_frames), l AS (SELECT traj_index, arg_max(v, frame) FILTER (v IS NOT NULL) AS v FROM s GROUP BY 1)
      SELECT traj_index, round(v, 6) + 0.0 AS velocity, row_number() OVER (ORDER BY v DESC, traj_index) AS place FROM l WHERE v IS NOT NULL"""
    gaps = ", ".join(f"pow(last_value - {a}e0, 2) + pow(log10(last_value) - {b}e0, 2)" for a, b in ((10.0, 1.0), (60.0, 1.8), (200.0, 2.3)))
    sql["rank_distance_to_known"] = f"""
      WITH {candidates}, d AS (SELECT traj_index, sqrt(least({gaps})) AS distance FROM candidates)
      SELECT traj_index, round(distance, 6) + 0.0 AS distance, row_number() OVER (ORDER BY distance DESC, traj_index) AS place FROM d"""
    sql["rank_rare_states"] = f"""
      WITH {candidates} SELECT traj_index, region, row_number() OVER (ORDER BY n_visits, traj_index) AS place,
        round(1.0e0 / n_visits, 9) + 0.0 AS weight FROM candidates JOIN visits USING (region)"""
    return sql
