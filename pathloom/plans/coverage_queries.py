"""Coverage of labels: suppliers are projects, alert locations are lines, fixes come from returned bulk lines."""

from pyspark.sql import functions as F

from pathloom.bindings import oracle
from pathloom.operators import coverage as C
from pathloom.registry import query

B = ("projects", "manifest", "fixes", "path_locations")

CASES = """WITH cases AS (
    SELECT m.project_id, p.project_slug, p.cve_id, p.cwe_id, concat(p.project_slug, ':', p.cve_id) AS case_id
    FROM manifest m JOIN projects p ON lower(trim(p.buggy_commit_id)) = lower(m.revision)),
cf AS (SELECT c.*, f.file AS fix_file, f.class_name, f.method, f.method_start, f.method_end FROM cases c JOIN fixes f USING (project_slug, cve_id)),
hits AS (SELECT c.case_id, c.project_id, l.candidate_path_id, l.path_origin, l.augmentation_reason, l.file, l.line, c.fix_file, c.class_name, c.method,
        c.method_start, c.method_end, c.method_start IS NOT NULL AND l.line BETWEEN c.method_start AND c.method_end AS inm
    FROM cf c JOIN path_locations l ON l.project_id = c.project_id AND lower(l.file) = lower(concat('src/', c.fix_file))),
ev AS (SELECT case_id, project_id, bool_or(method_start IS NOT NULL) AS me FROM cf GROUP BY 1, 2),
cov AS (SELECT o.o AS origin, e.case_id, e.project_id, me,
        bool_or(h.case_id IS NOT NULL AND (o.o = 'ALL' OR h.path_origin = o.o)) AS fh,
        CASE WHEN me THEN bool_or(coalesce(h.inm, false) AND (o.o = 'ALL' OR h.path_origin = o.o)) END AS mh
    FROM ev e CROSS JOIN (VALUES ('ALL'), ('NATIVE')) o(o) LEFT JOIN hits h ON h.case_id = e.case_id AND h.project_id = e.project_id GROUP BY 1, 2, 3, 4),
pools AS (SELECT a.case_id, a.project_id, CASE WHEN a.me THEN 'METHOD' ELSE 'FILE' END AS comparison_level,
        coalesce(n.mh, n.fh) AS native_covered, coalesce(a.mh, a.fh) AS unified_covered, NOT coalesce(n.mh, n.fh) AND coalesce(a.mh, a.fh) AS recovered
    FROM cov a JOIN cov n ON n.case_id = a.case_id AND n.origin = 'NATIVE' WHERE a.origin = 'ALL')
"""


def cases(t):
    return C.join_cases(t.manifest, t.projects).withColumn("case_id", F.concat_ws(":", "project_slug", "cve_id"))


def fixes(t):
    return C.case_fixes(cases(t), t.fixes)


def native(t):
    return t.path_locations.filter("path_origin = 'NATIVE'")


def static(t):
    return t.path_locations.filter("path_origin = 'STATIC_AUGMENTED'")


def pools(t):
    f = fixes(t)
    return C.compare_pools(C.case_coverage(native(t), f), C.case_coverage(t.path_locations, f))


@query("c09_join_cases", oracle(CASES + "SELECT project_id, project_slug, cve_id, cwe_id FROM cases", *B))
def c09(t):
    return cases(t).select("project_id", "project_slug", "cve_id", "cwe_id")


@query("c08_location_overlap", oracle(CASES + "SELECT DISTINCT case_id, candidate_path_id, lower(file) AS path, line, inm AS in_method FROM hits WHERE method_start IS NOT NULL", *B))
def c08(t):
    hits = C.location_matches(t.path_locations, fixes(t)).filter("method_start IS NOT NULL")
    return hits.select("case_id", "candidate_path_id", F.col("left_path").alias("path"), "line", "in_method").distinct()


@query("d03_case_coverage", oracle(CASES + """SELECT case_id, project_id, fh AS file_covered, mh AS method_covered,
    CASE WHEN me THEN 'METHOD' ELSE 'FILE' END AS comparison_level, coalesce(mh, fh) AS covered FROM cov WHERE origin = 'ALL'""", *B))
def d03(t):
    return C.case_coverage(t.path_locations, fixes(t))


def _cases_with_baseline(t):
    f, base = fixes(t), native(t)
    return C.with_baseline(C.case_coverage(t.path_locations, f), C.case_coverage(base, f), base.select("project_id"))


@query("d03_coverage_summary", oracle(CASES + """, b AS (SELECT a.*, coalesce(a.mh, a.fh) AS covered,
        CASE WHEN EXISTS (SELECT 1 FROM path_locations l WHERE l.project_id = a.project_id AND path_origin = 'NATIVE') THEN coalesce(n.mh, n.fh) END AS bc
    FROM cov a JOIN cov n ON n.case_id = a.case_id AND n.origin = 'NATIVE' WHERE a.origin = 'ALL')
    SELECT count(*) AS evaluable, count(*) FILTER (fh) AS file_covered, count(mh) AS method_evaluable, count(*) FILTER (mh) AS method_covered,
        count(*) FILTER (covered) AS covered, round(count(*) FILTER (covered) / count(*), 6) AS coverage_rate,
        round(count(*) FILTER (mh) / count(mh), 6) AS method_rate, count(bc) AS baseline_evaluable, count(*) FILTER (bc) AS baseline_covered,
        count(*) FILTER (NOT bc) AS baseline_missed, count(*) FILTER (covered AND NOT bc) AS recovered FROM b""", *B))
def d03_summary(t):
    return C.coverage_summary(_cases_with_baseline(t))


@query("d04_pool_summary", oracle(CASES + """SELECT count(*) AS evaluable, count(*) FILTER (native_covered) AS native_covered,
    count(*) FILTER (unified_covered) AS unified_covered, count(*) FILTER (unified_covered) - count(*) FILTER (native_covered) AS gain,
    count(*) FILTER (NOT native_covered) AS baseline_misses, count(*) FILTER (recovered) AS recovered,
    round(count(*) FILTER (recovered) / nullif(count(*) FILTER (NOT native_covered), 0), 6) AS recovery_rate FROM pools""", *B))
def d04(t):
    return C.pool_summary(pools(t))


RECOVERIES = CASES + """, rec AS (SELECT DISTINCT h.case_id, h.project_id, candidate_path_id, augmentation_reason FROM hits h JOIN pools p ON p.case_id = h.case_id
    WHERE p.recovered AND h.path_origin = 'STATIC_AUGMENTED' AND (p.comparison_level = 'FILE' OR h.inm))
"""


def _recoveries(t):
    return C.recoveries(static(t), fixes(t), pools(t))


@query("d04_recoveries", oracle(RECOVERIES + "SELECT * FROM rec", *B))
def d04_recoveries(t):
    return _recoveries(t)


@query("d05_ablation", oracle(CASES + """, nat AS (SELECT case_id FROM pools WHERE native_covered),
    r AS (SELECT h.augmentation_reason AS reason, h.case_id FROM hits h JOIN ev e ON e.case_id = h.case_id
        WHERE path_origin <> 'NATIVE' AND (NOT me OR inm) AND h.case_id NOT IN (FROM nat)),
    g AS (SELECT augmentation_reason AS reason, count(DISTINCT candidate_path_id) AS candidate_paths FROM path_locations WHERE path_origin <> 'NATIVE' GROUP BY 1)
    SELECT g.reason, candidate_paths, (SELECT count(*) FROM nat) + count(DISTINCT r.case_id) AS coverage, count(DISTINCT r.case_id) AS gain_over_native
    FROM g LEFT JOIN r ON r.reason = g.reason GROUP BY 1, 2""", *B))
def d05(t):
    return C.ablation(native(t), static(t), fixes(t))


@query("d06_coverage_by_key", oracle(CASES + """, x AS (SELECT p.*, c.cwe_id FROM pools p JOIN cases c USING (case_id))
    SELECT CASE WHEN grouping(project_id) = 0 THEN 'project_id' ELSE 'cwe_id' END AS dimension, coalesce(project_id, cwe_id) AS value,
        count(*) AS evaluable, count(*) FILTER (native_covered) AS native_covered, count(*) FILTER (unified_covered) AS unified_covered
    FROM x GROUP BY GROUPING SETS ((project_id), (cwe_id))""", *B))
def d06(t):
    return C.coverage_by(pools(t).join(cases(t).select("case_id", "cwe_id"), "case_id"), ["project_id", "cwe_id"])


@query("d07_gain_by_reason", oracle(RECOVERIES + "SELECT augmentation_reason, count(*) AS recovered_paths FROM rec GROUP BY 1", *B))
def d07(t):
    return _recoveries(t).groupBy("augmentation_reason").agg(F.count(F.lit(1)).alias("recovered_paths"))


@query("d08_adjudicate", oracle(CASES + """, spots AS (SELECT DISTINCT project_id, file, line FROM path_locations),
    m AS (SELECT s.project_id, s.file, s.line, count(*) AS n FROM spots s JOIN (SELECT DISTINCT project_id, fix_file, class_name, method, method_start, method_end FROM cf) f
        ON f.project_id = s.project_id AND lower(s.file) = lower(concat('src/', f.fix_file)) AND (method_start IS NULL OR line BETWEEN method_start AND method_end) GROUP BY 1, 2, 3)
    SELECT l.candidate_path_id, l.project_id, 'UNKNOWN' AS decision, n IS NOT NULL AS location_match, coalesce(n, 0) AS matched_fixes
    FROM path_locations l LEFT JOIN m ON m.project_id = l.project_id AND m.file = l.file AND m.line = l.line""", *B))
def d08(t):
    return C.adjudicate(t.path_locations, fixes(t), "candidate_path_id")


@query("d09_sanity", oracle(CASES + """, d AS (SELECT *, CASE WHEN method_start IS NOT NULL THEN greatest(method_start - line, line - method_end, 0) END AS dist FROM hits),
    sf AS (SELECT l.project_id, count(*) AS same_file FROM path_locations l WHERE EXISTS (SELECT 1 FROM cf WHERE cf.project_id = l.project_id
        AND lower(l.file) = lower(concat('src/', cf.fix_file))) GROUP BY 1)
    SELECT project_id, any_value(same_file) AS same_file, count(*) FILTER (dist = 0) AS same_method, min(dist) AS nearest
    FROM d JOIN sf USING (project_id) GROUP BY 1""", *B))
def d09(t):
    return C.sanity(t.path_locations, fixes(t))


@query("d09_distance_histogram", oracle(CASES + """, d AS (SELECT greatest(method_start - line, line - method_end, 0) AS dist FROM hits WHERE method_start IS NOT NULL)
    SELECT CASE WHEN dist = 0 THEN '0' WHEN dist <= 5 THEN '1-5' WHEN dist <= 20 THEN '6-20' WHEN dist <= 100 THEN '21-100' ELSE '>100' END AS bucket,
    count(*) AS count FROM d GROUP BY 1""", *B))
def d09_histogram(t):
    return C.distance_histogram(t.path_locations, fixes(t))
