"""Each query once more in plain SQL, written independently of the operators."""

from __future__ import annotations

_ENTITIES = """
raw_entities AS (
  SELECT 'C' || CAST(c_custkey AS VARCHAR) AS entity_id,
         CASE WHEN copy_no = 1 THEN 'd__Bacteria;p__COPY;c__x;o__x;f__COPY;g__x;s__x'
              WHEN c_acctbal < 0 THEN '#N/A'
              WHEN c_custkey % 97 = 11 THEN NULL
              WHEN c_custkey % 89 = 5 THEN 'd__Bacteria;p__' || r_name
              ELSE 'd__' || CASE WHEN c_mktsegment = 'MACHINERY' THEN 'Archaea' ELSE 'Bacteria' END
                   || ';p__' || r_name
                   || CASE WHEN c_custkey % 50 = 7 THEN '_C' WHEN c_custkey % 4 = 0 THEN '_A'
                           WHEN c_custkey % 4 = 1 THEN '_B' WHEN c_custkey % 4 = 2 THEN '_F'
                           ELSE '' END
                   || ';c__x;o__x;f__'
                   || CASE WHEN c_custkey % 83 = 7 THEN '' WHEN c_custkey % 50 = 9 THEN n_name || '_C'
                           WHEN c_custkey % 3 = 0 THEN n_name || '_A' ELSE n_name END
                   || ';g__x;s__' || c_name
         END AS lineage,
         c_name AS source_name, c_mktsegment AS segment, n_name AS home, r_name AS area,
         c_acctbal AS balance, copy_no
  FROM customer
  JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey
  JOIN (SELECT 0 AS copy_no UNION ALL SELECT 1) copies ON copy_no = 0 OR c_custkey % 10 = 3
),
first_entities AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY copy_no) AS rn FROM raw_entities
  ) WHERE rn = 1
),
kept_entities AS (
  SELECT * FROM first_entities
  WHERE lineage <> '#N/A' AND lineage NOT LIKE '%d\\_\\_Archaea%' ESCAPE '\\'
),
entities AS (
  SELECT entity_id, lineage,
         regexp_replace(regexp_replace(string_split(lineage, ';')[2], '_(A|B|F)$', ''), '^p__', '') AS grp,
         regexp_replace(regexp_replace(string_split(lineage, ';')[5], '_(A|B|F)$', ''), '^f__', '') AS sub
  FROM kept_entities
),
sized AS (
  SELECT *, count(*) OVER (PARTITION BY grp) AS grp_size, count(*) OVER (PARTITION BY sub) AS sub_size
  FROM entities
)"""

_EVIDENCE = """
evidence AS (
  SELECT 'C' || CAST(o_custkey AS VARCHAR) AS entity_id,
         CASE WHEN p_partkey % 1000 = 17 THEN 'prototype' ELSE p_name END AS feature_type,
         l_linenumber AS locus_number, l_tax AS full_seq_e_value, l_discount AS domain_ie_value,
         l_quantity / 50 AS target_coverage, p_size / 50.0::DOUBLE AS hmm_coverage,
         CASE WHEN p_size % 5 = 0 THEN p_type ELSE p_type || '_' || p_brand END AS protein_name,
         l_orderkey, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax
  FROM lineitem
  JOIN part ON l_partkey = p_partkey
  JOIN orders ON l_orderkey = o_orderkey
  WHERE l_tax < 0.03 AND l_discount < 0.04 AND l_quantity / 50 > 0.5 AND p_size / 50.0::DOUBLE > 0.1
),
loci AS (SELECT DISTINCT entity_id, feature_type, locus_number FROM evidence)"""

_ARRAYS = """
arrays AS (
  SELECT 'C' || CAST(user_id AS VARCHAR) AS entity_id,
         'ev' || CAST(event_id AS VARCHAR) AS contig,
         'ev' || CAST(event_id AS VARCHAR) || '_1' AS array_id,
         event_type AS prediction, event_type AS feature_type,
         CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) / 100 AS probability
  FROM events
  WHERE CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) / 100 > 0.75
)"""

_CLASSES = """
classes(prediction, merged_type, type_group, type_class, row_no) AS (
  VALUES ('signup', 'signup', 'Type A', 'Class 1', 1), ('view', 'view', 'Type B', 'Class 2', 2),
         ('click', 'view', 'Type C', 'Class 2', 3), ('purchase', 'purchase', 'Type A', 'Class 1', 4)
)"""

_LOOKUP = """
lookup AS (
  SELECT feature_type,
         CASE WHEN feature_type = 'prototype' THEN 'prototype'
              ELSE regexp_extract(feature_type, '([^ ]+)$', 1) END AS feature
  FROM (SELECT DISTINCT CASE WHEN p_partkey % 1000 = 17 THEN 'prototype' ELSE p_name END AS feature_type
        FROM part)
  WHERE feature_type <> 'old rod'
  UNION ALL
  SELECT * FROM (VALUES ('click', 'signal_raw'), ('error', 'signal_raw'), ('purchase', 'signal_raw'),
                        ('signup', 'signal_raw'), ('view', 'signal_raw'))
)"""

_ENRICHED = """
counts AS (
  SELECT entity_id, feature_type, count(*) AS frequency
  FROM (SELECT entity_id, feature_type FROM loci
        UNION ALL SELECT entity_id, feature_type FROM arrays)
  GROUP BY ALL
),
enriched AS (
  SELECT s.entity_id, c.feature_type, c.frequency, s.lineage, s.grp, s.sub, s.grp_size, s.sub_size,
         k.feature
  FROM sized s
  LEFT JOIN counts c ON s.entity_id = c.entity_id
  LEFT JOIN lookup k ON c.feature_type = k.feature_type
)"""

_PRESENCE = """
presence AS (
  SELECT DISTINCT entity_id, grp, grp_size, sub, sub_size,
         CASE WHEN feature = 'signal_raw' THEN 'signal' ELSE feature END AS feature
  FROM enriched WHERE feature IS NOT NULL AND feature NOT IN ('gizmo', 'rod')
)"""

_OVERALL = """
overall AS (
  SELECT feature, count(*) / (SELECT count(*) FROM entities) * 100 AS pct
  FROM presence WHERE feature <> '#N/A' GROUP BY feature
)"""

_TYPE_GRID = """
array_counts AS (
  SELECT a.entity_id, e.grp, c.merged_type, count(*) AS n
  FROM arrays a
  JOIN entities e ON a.entity_id = e.entity_id
  LEFT JOIN classes c ON a.feature_type = c.prediction
  GROUP BY ALL
),
type_grid AS (
  SELECT t.merged_type, g.grp, s.grp_size,
         count(a.n) AS n_with, CAST(coalesce(sum(a.n), 0) AS BIGINT) AS n_total,
         count(a.n) / s.grp_size AS share
  FROM (SELECT DISTINCT grp FROM array_counts) g
  CROSS JOIN (SELECT DISTINCT merged_type FROM array_counts) t
  JOIN (SELECT grp, count(*) AS grp_size FROM entities GROUP BY grp) s
    ON s.grp IS NOT DISTINCT FROM g.grp
  LEFT JOIN array_counts a
    ON a.grp IS NOT DISTINCT FROM g.grp AND a.merged_type IS NOT DISTINCT FROM t.merged_type
  GROUP BY t.merged_type, g.grp, s.grp_size
),
first_classes AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY merged_type ORDER BY row_no) AS rn FROM classes
  ) WHERE rn = 1
)"""


def _feature_grid(key: str) -> str:
    """CTE of the dense feature grid on ``grp`` or ``sub``."""
    return f"""
feature_counts AS (
  SELECT entity_id, {key} AS k, feature, count(*) AS n
  FROM enriched WHERE frequency > 0 GROUP BY ALL
),
feature_grid AS (
  SELECT g.k, s.k_size,
         CASE WHEN t.feature = 'signal_raw' THEN 'signal' ELSE t.feature END AS feature,
         coalesce(max(c.n), 0) AS max_per_entity, count(c.n) AS n_with,
         CAST(coalesce(sum(c.n), 0) AS BIGINT) AS n_total, count(c.n) / s.k_size AS share
  FROM (SELECT DISTINCT k FROM feature_counts) g
  CROSS JOIN (SELECT DISTINCT feature FROM feature_counts) t
  JOIN (SELECT {key} AS k, count(*) AS k_size FROM entities GROUP BY 1) s
    ON s.k IS NOT DISTINCT FROM g.k
  LEFT JOIN feature_counts c
    ON c.k IS NOT DISTINCT FROM g.k AND c.feature IS NOT DISTINCT FROM t.feature
  WHERE t.feature IS NULL OR t.feature NOT IN ('gizmo', 'rod')
  GROUP BY g.k, s.k_size, t.feature
)"""


def _with(ctes: list[str], select: str) -> str:
    return "WITH" + ",".join(ctes) + "\n" + select.strip()


_BASE = [_ENTITIES, _EVIDENCE, _ARRAYS, _LOOKUP, _ENRICHED]


def _subset(condition: str) -> str:
    return _with(
        [_ENTITIES, _EVIDENCE],
        f"""
SELECT f.entity_id, f.feature_type, f.locus_number, f.full_seq_e_value, f.domain_ie_value,
       f.target_coverage, f.hmm_coverage, f.protein_name, e.lineage
FROM (
  SELECT *, row_number() OVER (
    PARTITION BY entity_id, feature_type, locus_number
    ORDER BY l_orderkey, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax) AS rn
  FROM evidence WHERE {condition}
) f LEFT JOIN entities e ON f.entity_id = e.entity_id
WHERE f.rn = 1""",
    )


def _feature_grid_query(key: str, name: str) -> str:
    return _with(
        [*_BASE, _feature_grid(key)],
        f"""SELECT k AS {name}, k_size AS {name}_size, feature, max_per_entity, n_with, n_total, share
FROM feature_grid""",
    )


def _heatmap(ctes: list[str], source: str, key: str, size: str, name: str, feature: str, cut: str) -> str:
    return _with(
        ctes,
        f"""
SELECT h.{key} AS {name}, h.{size} AS {name}_size, h.{feature}, h.n_with, h.share,
       coalesce(h.{key}, 'NA') || chr(10) || CAST(h.{size} AS VARCHAR) AS axis_label,
       dense_rank() OVER (ORDER BY h.{size}, h.{key} NULLS FIRST) AS display_rank,
       CASE WHEN h.n_with > 100 THEN 90 ELSE 0 END AS text_angle
FROM {source} h WHERE {cut}""",
    )


_MEMBERS = """
members AS (
  SELECT DISTINCT CASE WHEN feature IN ('gear', 'ring', 'signal') THEN feature ELSE 'other' END AS set_name,
         entity_id
  FROM presence WHERE feature IN ('gear', 'ring', 'signal', 'anvil', 'bolt', 'plate', 'widget')
)"""

_REGIONS = """
masks AS (
  SELECT entity_id, CAST(sum(CASE set_name WHEN 'gear' THEN 1 WHEN 'ring' THEN 2
                                  WHEN 'signal' THEN 4 ELSE 8 END) AS INTEGER) AS mask
  FROM members GROUP BY entity_id
),
regions AS (SELECT CAST(range AS INTEGER) AS mask FROM range(1, 16))"""

_PRUNED = """
cut AS (SELECT entity_id, sub, feature FROM presence WHERE sub_size > 5),
frequent AS (SELECT feature FROM cut GROUP BY feature HAVING count(*) > 5),
pruned AS (
  SELECT e.entity_id, e.sub, f.feature, CASE WHEN c.feature IS NULL THEN 0 ELSE 1 END AS present
  FROM (SELECT DISTINCT entity_id, sub FROM cut) e
  CROSS JOIN frequent f
  LEFT JOIN cut c ON c.entity_id = e.entity_id AND c.feature = f.feature
)"""


#: Columns of the published tables, in order; a fraction is marked by a colon behind it.
_PUBLISHED = {
    "typed_detections": ("csv", "group group_size entity_id raw_type merged_type type_group type_class"),
    "detections_enriched": (
        "csv", "entity_id feature_type frequency lineage group subgroup group_size subgroup_size feature"
    ),
    "feature_prevalence_by_group": ("csv", "group group_size feature max_per_entity n_with n_total share:"),
    "feature_prevalence_by_subgroup": ("csv", "subgroup subgroup_size feature max_per_entity n_with n_total share:"),
    "feature_prevalence_overall": ("csv", "feature pct:"),
    "entity_export": ("parquet", "entity_id source_name segment home area balance: lineage"),
    "evidence_subset_regex": (
        "parquet",
        "entity_id feature_type locus_number full_seq_e_value: domain_ie_value: target_coverage: hmm_coverage:"
        " protein_name lineage",
    ),
    "evidence_subset_prefix": (
        "parquet",
        "entity_id feature_type locus_number full_seq_e_value: domain_ie_value: target_coverage: hmm_coverage:"
        " protein_name lineage",
    ),
}


def _published() -> str:
    queries, parts = all_oracles(published=False), []
    for name, (kind, columns) in _PUBLISHED.items():
        cells = [
            f"""coalesce(CAST(round("{c[:-1]}" * 1000000) AS BIGINT)::VARCHAR, 'NA')"""
            if c.endswith(":")
            else f"""coalesce("{c}"::VARCHAR, 'NA')"""
            for c in columns.split()
        ]
        parts.append(
            f"""SELECT '{name}' AS table_name, '{kind}' AS file_format, count(*) AS n_rows,
  CAST(coalesce(sum(('0x' || substr(md5(concat_ws('|', {", ".join(cells)})), 1, 8))::BIGINT), 0) AS BIGINT) AS checksum
FROM ({queries[name]})"""
        )
    return "\nUNION ALL\n".join(parts)


#: Components by repeated squaring and deflation: after 45 squarings of the covariance, scaled to trace one, the matrix is
#: the projector on its first axis, the column of its largest diagonal cell that axis with its largest loading positive.
#: Taking the axis out of the matrix leaves the next one first.
_TIMES = """list_transform({a}, lambda r: list_transform(range(1, len(r) + 1), lambda j:
      list_sum(list_transform(range(1, len(r) + 1), lambda l: r[l] * {b}[l][j]))))"""
_TRACE = "list_sum(list_transform(range(1, len({a}) + 1), lambda i: {a}[i][i]))"
_SCALED = "list_transform({a}, lambda r: list_transform(r, lambda x: x / {t}))"

_COMPONENTS = f"""
pairs AS (
  SELECT a.feature AS fa, b.feature AS fb, covar_samp(a.present, b.present) AS x
  FROM pruned a JOIN pruned b ON a.entity_id = b.entity_id GROUP BY 1, 2),
size AS (SELECT count(DISTINCT entity_id) AS n FROM pruned),
start AS (
  SELECT list(fa ORDER BY fa) AS names, list(line ORDER BY fa) AS m
  FROM (SELECT fa, list(x ORDER BY fb) AS line FROM pairs GROUP BY fa)),
climb AS (
  SELECT 1 AS component, 0 AS step, m AS left_over, {_SCALED.format(a="m", t="(" + _TRACE.format(a="m") + ")")} AS p,
    NULL::DOUBLE AS eigenvalue, NULL::DOUBLE[] AS v
  FROM start
  UNION ALL
  SELECT CASE WHEN step = 46 THEN component + 1 ELSE component END, CASE WHEN step = 46 THEN 1 ELSE step + 1 END,
    CASE WHEN step = 45 THEN list_transform(range(1, len(v) + 1), lambda i:
      list_transform(range(1, len(v) + 1), lambda j: left_over[i][j] - eigenvalue * v[i] * v[j])) ELSE left_over END,
    CASE WHEN step < 44 THEN {_SCALED.format(a="sq", t="(" + _TRACE.format(a="sq") + ")")}
      WHEN step = 46 THEN {_SCALED.format(a="left_over", t="(" + _TRACE.format(a="left_over") + ")")} ELSE p END,
    CASE WHEN step = 44 THEN list_sum(list_transform(range(1, len(axis) + 1), lambda i:
      axis[i] * list_sum(list_transform(range(1, len(axis) + 1), lambda j: left_over[i][j] * axis[j])))) ELSE eigenvalue END,
    CASE WHEN step = 44 THEN axis ELSE v END
  FROM (
    SELECT *, {_TIMES.format(a="p", b="p")} AS sq,
      list_transform(p, lambda r: r[top] / sqrt(p[top][top])) AS axis
    FROM (SELECT *, list_position(diagonal, list_max(diagonal)) AS top
      FROM (SELECT *, list_transform(range(1, len(p) + 1), lambda i: p[i][i]) AS diagonal FROM climb)))
  WHERE NOT (component = len(p) AND step = 45)),
found AS (SELECT component, eigenvalue, v FROM climb WHERE step = 45)"""


def _with_recursive(ctes: list[str], select: str) -> str:
    return _with(ctes, select).replace("WITH", "WITH RECURSIVE", 1)


def all_oracles(published: bool = True) -> dict[str, str]:
    """SQL of every query; ``published`` leaves out the one that is made of others."""
    presence = [*_BASE, _PRESENCE]
    overall = [*presence, _OVERALL]
    types = [_ENTITIES, _ARRAYS, _CLASSES, _TYPE_GRID]
    return {
        "entity_clean": _with(
            [_ENTITIES],
            """SELECT entity_id, lineage, grp AS "group", sub AS subgroup, grp_size AS group_size,
       sub_size AS subgroup_size FROM sized""",
        ),
        "entity_export": _with(
            [_ENTITIES],
            "SELECT entity_id, source_name, segment, home, area, balance, lineage FROM kept_entities",
        ),
        "evidence_detections": _with(
            [_EVIDENCE], "SELECT entity_id, feature_type FROM loci"
        ),
        "evidence_subset_regex": _subset(
            "regexp_matches(protein_name, 'PROMO_Brand#(1|2)') OR protein_name = 'PROMO'"
        ),
        "evidence_subset_prefix": _subset(
            "regexp_matches(feature_type, '^red') AND regexp_matches(protein_name, '^S')"
        ),
        "array_detections": _with([_ARRAYS], "SELECT * FROM arrays"),
        "typed_detections": _with(
            [_ENTITIES, _ARRAYS, _CLASSES],
            """
SELECT s.grp AS "group", s.grp_size AS group_size, a.entity_id, a.feature_type AS raw_type,
       c.merged_type, c.type_group, c.type_class
FROM arrays a JOIN sized s ON a.entity_id = s.entity_id
LEFT JOIN classes c ON a.feature_type = c.prediction""",
        ),
        "type_prevalence_by_group": _with(
            types,
            """
SELECT t.merged_type, t.grp AS "group", t.grp_size AS group_size, t.n_with, t.n_total, t.share,
       c.prediction, c.type_group, c.type_class
FROM type_grid t LEFT JOIN first_classes c ON t.merged_type = c.merged_type""",
        ),
        "type_totals": _with(
            types,
            """
SELECT t.grp AS "group", t.merged_type, t.n_total, c.type_class
FROM type_grid t LEFT JOIN first_classes c ON t.merged_type = c.merged_type WHERE t.n_total > 0""",
        ),
        "type_distribution": _with(
            types,
            """
SELECT t.merged_type, c.type_class, CAST(sum(t.n_total) AS BIGINT) AS n_total
FROM type_grid t LEFT JOIN first_classes c ON t.merged_type = c.merged_type
WHERE t.n_total > 0 GROUP BY 1, 2""",
        ),
        "detections_enriched": _with(
            _BASE,
            """SELECT entity_id, feature_type, frequency, lineage, grp AS "group", sub AS subgroup,
       grp_size AS group_size, sub_size AS subgroup_size, feature FROM enriched""",
        ),
        "feature_prevalence_by_group": _feature_grid_query("grp", '"group"').replace(
            '"group"_size', "group_size"
        ),
        "feature_prevalence_by_subgroup": _feature_grid_query("sub", "subgroup"),
        "feature_prevalence_overall": _with(
            overall, "SELECT feature, pct FROM overall ORDER BY pct DESC, feature"
        ),
        "feature_bars": _with(
            overall,
            """SELECT feature, pct,
       CAST(row_number() OVER (ORDER BY pct DESC, feature) AS INTEGER) AS bar_rank FROM overall""",
        ),
        "share_vs_rest": _with(
            overall,
            """
SELECT slice, pct, regexp_replace(CAST(round(pct, 2) AS VARCHAR), '[.]0$', '') || '%' AS label
FROM (SELECT 'signal' AS slice, coalesce(max(pct), 0.0) AS pct FROM overall WHERE feature = 'signal'
      UNION ALL
      SELECT 'Other', 100.0 - coalesce(max(pct), 0.0) FROM overall WHERE feature = 'signal')""",
        ),
        "set_membership": _with([*presence, _MEMBERS], "SELECT set_name, entity_id FROM members"),
        "set_overlap_regions": _with(
            [*presence, _MEMBERS, _REGIONS],
            """
SELECT concat_ws(' & ', CASE WHEN r.mask & 1 > 0 THEN 'gear' END, CASE WHEN r.mask & 2 > 0 THEN 'ring' END,
                 CASE WHEN r.mask & 4 > 0 THEN 'signal' END, CASE WHEN r.mask & 8 > 0 THEN 'other' END) AS region,
       CAST(bit_count(r.mask) AS INTEGER) AS n_sets, count(m.mask) AS n_entities,
       count(m.mask) * 100 / sum(count(m.mask)) OVER () AS pct
FROM regions r LEFT JOIN masks m ON r.mask = m.mask GROUP BY r.mask""",
        ),
        "presence_matrix": _with(
            [
                *presence,
                """
marked AS (
  SELECT s.entity_id, s.grp AS "group", s.grp_size AS group_size, s.sub AS subgroup, s.sub_size AS subgroup_size,
         p.feature
  FROM sized s LEFT JOIN presence p ON s.entity_id = p.entity_id
)""",
            ],
            """SELECT * FROM (
  PIVOT marked ON feature USING CAST(count(feature) AS INTEGER)
  GROUP BY entity_id, "group", group_size, subgroup, subgroup_size)""",
        ),
        "presence_matrix_totals": _with(
            [
                *presence,
                """
large AS (
  SELECT s.entity_id, s.sub AS subgroup, p.feature
  FROM sized s LEFT JOIN presence p ON s.entity_id = p.entity_id WHERE s.sub_size > 5
),
summed AS (
  SELECT entity_id, subgroup, feature, count(feature) AS n FROM large WHERE feature IS NOT NULL GROUP BY ALL
  UNION ALL SELECT entity_id, subgroup, 'row_total', count(feature) FROM large GROUP BY ALL
  UNION ALL SELECT NULL, 'fam_sum', feature, count(feature) FROM large WHERE feature IS NOT NULL GROUP BY ALL
  UNION ALL SELECT NULL, 'fam_sum', 'row_total', count(feature) FROM large
)""",
            ],
            """SELECT entity_id, subgroup, coalesce(COLUMNS(* EXCLUDE (entity_id, subgroup)), 0) FROM (
  PIVOT summed ON feature USING CAST(sum(n) AS BIGINT) GROUP BY entity_id, subgroup)""",
        ),
        "presence_matrix_pruned": _with(
            [*presence, _PRUNED],
            "SELECT entity_id, sub AS subgroup, feature, present FROM pruned",
        ),
        "group_heatmap": _heatmap(
            [*_BASE, _feature_grid("grp")], "feature_grid", "k", "k_size", '"group"', "feature", "k_size > 5"
        ).replace('"group"_size', "group_size"),
        "subgroup_heatmap": _heatmap(
            [*_BASE, _feature_grid("sub")], "feature_grid", "k", "k_size", "subgroup", "feature", "k_size > 5"
        ),
        "type_heatmap": _with(
            types,
            """
SELECT t.grp AS "group", t.grp_size AS group_size, t.merged_type, c.type_class, c.type_group, t.n_with, t.share,
       coalesce(t.grp, 'NA') || chr(10) || CAST(t.grp_size AS VARCHAR) AS axis_label,
       dense_rank() OVER (ORDER BY t.grp_size, t.grp NULLS FIRST) AS display_rank
FROM type_grid t LEFT JOIN first_classes c ON t.merged_type = c.merged_type""",
        ),
        "feature_covariance": _with(
            [*presence, _PRUNED],
            """
SELECT a.feature AS feature_a, b.feature AS feature_b,
       round(covar_samp(a.present, b.present), 12) AS covariance
FROM pruned a JOIN pruned b ON a.entity_id = b.entity_id GROUP BY 1, 2""",
        ),
        "pca_variance": _with_recursive(
            [*presence, _PRUNED, _COMPONENTS],
            """
SELECT component, round(sqrt(eigenvalue), 9) AS std_dev, round(eigenvalue * (n - 1) / n, 9) AS eigenvalue,
       round(eigenvalue / sum(eigenvalue) OVER (), 9) AS share,
       round(sum(eigenvalue) OVER (ORDER BY component) / sum(eigenvalue) OVER (), 9) AS cumulative_share
FROM found, size""",
        ),
        "pca_variable_map": _with_recursive(
            [*presence, _PRUNED, _COMPONENTS],
            """
SELECT names[i] AS feature, round(c1 * sqrt((n - 1) / n) + 0.0, 9) AS coord1,
       round(c2 * sqrt((n - 1) / n) + 0.0, 9) AS coord2,
       round((c1 * c1 + c2 * c2) / m[i][i], 9) AS cos2, (c1 * c1 + c2 * c2) / m[i][i] >= 0.02 AS kept
FROM (
  SELECT s.names, s.m, s.n::DOUBLE AS n, i, f1.v[i] * sqrt(f1.eigenvalue) AS c1, f2.v[i] * sqrt(f2.eigenvalue) AS c2
  FROM (SELECT *, unnest(range(1, len(names) + 1)) AS i FROM start, size) s
  JOIN found f1 ON f1.component = 1 JOIN found f2 ON f2.component = 2)""",
        ),
        "lookup_key_check": _with(
            [
                _ENTITIES,
                _LOOKUP,
                _CLASSES,
                """
keys AS (
  SELECT 'feature_lookup' AS table_name, feature_type AS k FROM lookup
  UNION ALL SELECT 'class_lookup', prediction FROM classes
  UNION ALL SELECT 'class_lookup_merged', merged_type FROM classes
  UNION ALL SELECT 'raw_entities', entity_id FROM raw_entities
  UNION ALL SELECT 'entities', entity_id FROM entities
)""",
            ],
            """
SELECT table_name, CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_keys,
       count(*) FILTER (WHERE n > 1) AS n_repeated
FROM (SELECT table_name, k, count(*) AS n FROM keys GROUP BY 1, 2) GROUP BY table_name""",
        ),
        **({"publish_tables": _published()} if published else {}),
        "text_entities": _with(
            [_ENTITIES],
            """SELECT entity_id, source_name, segment, CASE WHEN home = 'CHINA' THEN '' ELSE home END AS home, area, lineage
FROM kept_entities""",
        ),
        "text_arrays": _with([_ARRAYS], "SELECT * FROM arrays"),
        "text_evidence": _with(
            [_EVIDENCE],
            """
SELECT entity_id, feature_type, locus_number,
       CASE WHEN l_partkey % 7 = 0 THEN protein_name || ', "x"' ELSE protein_name END AS protein_name,
       full_seq_e_value, domain_ie_value, target_coverage, hmm_coverage
FROM (
  SELECT *, row_number() OVER (
    PARTITION BY entity_id, feature_type, locus_number
    ORDER BY l_orderkey, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax) AS rn
  FROM evidence WHERE l_suppkey % 11 <> 0)
WHERE rn = 1""",
        ),
        "text_lookups": _with(
            [_LOOKUP, _CLASSES],
            """
SELECT 'features' AS table_name, feature_type AS key, feature AS value FROM lookup
UNION ALL SELECT 'classes', merged_type, prediction FROM (
  SELECT *, row_number() OVER (PARTITION BY merged_type ORDER BY row_no) AS rn FROM classes) WHERE rn = 1""",
        ),
        "text_columns": _with(
            [
                _ENTITIES,
                """
items AS (
  SELECT CASE WHEN l_suppkey % 11 <> 0 THEN l_tax END AS e_value
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey
),
counted AS (
  SELECT 'entities' AS table_name, [count(*), count(lineage), count(*), count(*), count(*), count(*)] AS n,
    ['accession_genbank', 'classification', 'source_name', 'segment', 'home', 'area'] AS names FROM raw_entities
  UNION ALL
  SELECT 'evidence', [count(*), count(*), count(*), count(*), count(e_value), count(*), count(*), count(*)],
    ['AccessionID', 'system.number', 'system', 'protein.name', 'full.seq.E.value', 'domain.iE.value',
     'target.coverage', 'hmm.coverage'] FROM items
)""",
            ],
            """
SELECT table_name, CAST(i AS INTEGER) AS position, names[i] AS column_name, n[i] AS n_filled
FROM (SELECT *, unnest(range(1, len(n) + 1)) AS i FROM counted)""",
        ),
    }
