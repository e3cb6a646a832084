"""Domain-shaped views over the input tables, as SQL that reads the same in Spark and in DuckDB.

Every binding is a projection, a value filter or an equi-join over whole tables. ``{name}`` marks
an input; ``oracle`` turns a set of bindings plus a query into one SQL string for DuckDB.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


@dataclass(frozen=True)
class Binding:
    sql: str

    @property
    def deps(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys(re.findall(r"\{(\w+)\}", self.sql)))


BINDINGS: dict[str, Binding] = {
    # -- code graph: an order is a method, its lines are sites; N lines call the method named by the part key
    "methods": Binding("""
        SELECT o_orderkey AS method, o_custkey AS package, concat_ws('.', CAST(o_custkey AS STRING), o_orderpriority) AS class,
               o_orderpriority AS project, o_orderstatus AS status FROM {orders}"""),
    "sites": Binding("""
        SELECT DISTINCT l_orderkey AS method, CAST(l_linenumber AS BIGINT) AS line, l_partkey AS part, l_suppkey AS supp,
               l_returnflag AS flag, l_linestatus AS status,
               concat_ws(':', CAST(l_orderkey AS STRING), CAST(l_linenumber AS STRING), CAST(l_partkey AS STRING),
                         CAST(l_suppkey AS STRING), l_returnflag, l_linestatus) AS site_id
        FROM {lineitem}"""),
    "calls": Binding("""
        SELECT method AS caller, part AS callee, line, supp AS receiver, site_id,
               CASE WHEN status = 'O' THEN 'DIRECT_CALL' ELSE 'CALL' END AS kind
        FROM {sites} WHERE flag = 'N'"""),
    "call_edges": Binding("SELECT DISTINCT caller AS src, callee AS dst FROM {calls} WHERE caller <> callee"),
    "flow_edges": Binding("SELECT src, dst FROM {call_edges} WHERE dst < src"),
    "inputs": Binding("SELECT site_id AS input_id, method, line, part, supp FROM {sites} WHERE flag = 'R'"),
    "effects": Binding("SELECT site_id AS effect_id, method, line, part, supp FROM {sites} WHERE flag = 'A'"),
    "input_methods": Binding("SELECT DISTINCT method FROM {inputs}"),
    "effect_methods": Binding("SELECT DISTINCT method FROM {effects}"),
    # -- endpoint candidates, anchor rows and reach rows
    "candidates": Binding("""
        SELECT concat('cand-', CAST(o_orderkey AS STRING)) AS candidate_id,
               CASE WHEN o_orderstatus = 'F' THEN 'EXTERNAL_INPUT' ELSE 'SECURITY_EFFECT' END AS kind,
               CASE WHEN o_orderstatus = 'F' THEN 'INPUT' ELSE 'EFFECT' END AS side,
               concat('m:', CAST(o_orderkey AS STRING)) AS entity,
               concat('src/C', CAST(o_custkey AS STRING), '/M', CAST(o_orderkey AS STRING), '.java') AS file,
               CAST(1 + o_custkey % 50 AS INT) AS line, o_orderpriority AS project_id, o_orderkey AS k
        FROM {orders}"""),
    "anchor_rows": Binding("""
        SELECT c.side AS candidate_side, c.entity AS candidate_entity,
               replace(concat('./', upper(c.file)), '/M', '//M') AS candidate_file, c.line AS candidate_line,
               CASE WHEN l.l_linestatus = 'O' THEN 'PARAMETER' ELSE 'CALL_ARGUMENT' END AS anchor_kind,
               CASE WHEN l.l_linenumber = 3 THEN 'RECEIVER' WHEN l.l_linestatus = 'O' THEN 'PARAMETER' ELSE 'CALL_ARGUMENT' END AS value_role,
               c.entity AS method_identity,
               CASE WHEN l.l_linenumber = 5 THEN '' ELSE concat('call:', CAST(l.l_partkey AS STRING)) END AS call_identity,
               CAST(l.l_linenumber - 2 AS INT) AS argument_index,
               concat('src/P', CAST(l.l_partkey AS STRING), '.java') AS anchor_file, CAST(l.l_linenumber AS INT) AS anchor_line,
               'GENERIC_AST_VALUE_MATCH' AS mapping_reason
        FROM {lineitem} l JOIN {candidates} c ON l.l_orderkey = c.k WHERE l.l_returnflag = 'R'"""),
    "reach_rows": Binding("""
        SELECT c.side AS candidate_side, c.entity AS candidate_entity, c.file AS candidate_file, c.line AS candidate_line,
               CASE WHEN l.l_linestatus = 'O' THEN 'PARAMETER' ELSE 'EXPR' END AS node_kind,
               concat('p:', CAST(l.l_partkey AS STRING)) AS node_entity,
               concat('src/P', CAST(l.l_partkey AS STRING), '.java') AS node_file, CAST(l.l_linenumber AS INT) AS node_line,
               concat('s:', CAST(l.l_suppkey AS STRING)) AS node_method
        FROM {lineitem} l JOIN {candidates} c ON l.l_orderkey = c.k WHERE l.l_returnflag = 'N'"""),
    # -- labels: a supplier is a project, parts of its returned bulk lines are the fixed files
    "projects": Binding("""
        SELECT concat('proj-', CAST(s_suppkey AS STRING)) AS project_slug, concat('ID-', CAST(s_nationkey AS STRING)) AS cve_id,
               concat(' REV', CAST(s_suppkey AS STRING), ' ') AS buggy_commit_id, concat('CWE-', CAST(s_nationkey % 4 AS STRING)) AS cwe_id,
               s_suppkey AS seq FROM {supplier}"""),
    "manifest": Binding("""
        SELECT concat('run-', CAST(s_suppkey AS STRING)) AS project_id, concat('rev', CAST(s_suppkey AS STRING)) AS revision FROM {supplier}"""),
    "fixes": Binding("""
        SELECT DISTINCT concat('proj-', CAST(l_suppkey AS STRING)) AS project_slug, concat('ID-', CAST(s_nationkey AS STRING)) AS cve_id,
               concat('part/P', CAST(l_partkey AS STRING), '.java') AS file, p_brand AS class_name, p_name AS method,
               CASE WHEN p_size % 5 = 0 THEN NULL ELSE CAST(1 + p_size % 3 AS INT) END AS method_start,
               CASE WHEN p_size % 5 = 0 THEN NULL ELSE CAST(3 + p_size % 3 AS INT) END AS method_end
        FROM {lineitem} JOIN {part} ON l_partkey = p_partkey JOIN {supplier} ON l_suppkey = s_suppkey
        WHERE l_returnflag = 'R' AND l_linestatus = 'F'"""),
    "path_locations": Binding("""
        SELECT concat('run-', CAST(l_suppkey AS STRING)) AS project_id,
               concat('path-', CAST(l_orderkey AS STRING), '-', CAST(l_suppkey AS STRING)) AS candidate_path_id,
               concat('src/Part/p', CAST(l_partkey AS STRING), '.java') AS file, CAST(l_linenumber AS INT) AS line,
               CASE WHEN l_linestatus = 'F' THEN 'NATIVE' ELSE 'STATIC_AUGMENTED' END AS path_origin,
               CASE WHEN l_quantity >= 34 THEN 'NEW_BOTH_ENDPOINTS' WHEN l_quantity >= 17 THEN 'NEW_EFFECT_CANDIDATE'
                    ELSE 'NEW_BOUNDARY_CANDIDATE' END AS augmentation_reason
        FROM {lineitem} WHERE l_returnflag = 'A'"""),
    # -- text files and journal
    "files": Binding("SELECT concat(source, '/', CAST(doc_id AS STRING), '.txt') AS path, text, lang AS project, doc_id FROM {documents}"),
    "journal": Binding("""
        SELECT concat(CAST(conv_id AS STRING), '-', CAST(turn AS STRING)) AS request_key, conv_id, turn, role,
               CAST(ceil(length(text) / 100.0) * 100 AS BIGINT) AS reserved_tokens, CAST(length(text) AS BIGINT) AS charged_tokens
        FROM {conversations}"""),
    # -- scored methods: a part is a method in the file named by its brand and size, its lines are calls
    "scored_methods": Binding("""
        SELECT p_partkey AS method_id, concat(p_brand, '/', CAST(p_size AS STRING), '.java') AS file, p_size AS start_line, p_name AS name,
               p_type AS type_name,
               CASE p_type WHEN 'ECONOMY' THEN 'CWE-22' WHEN 'LARGE' THEN 'CWE-78' WHEN 'MEDIUM' THEN 'CWE-79'
                           WHEN 'PROMO' THEN 'CWE-94' END AS category FROM {part}"""),
    "scored_calls": Binding("""
        SELECT l_partkey AS method_id, l_suppkey AS callee, l_orderkey AS site, CAST(l_linenumber AS INT) AS line,
               l_discount >= 0.08 AS dangerous, l_tax > 0.04 AS dynamic_args, l_returnflag = 'R' AS alerted,
               l_quantity >= 40 AS is_source,
               CASE CAST(l_quantity AS INT) % 4 WHEN 0 THEN 'CWE-22' WHEN 1 THEN 'CWE-78' WHEN 2 THEN 'CWE-79' ELSE 'CWE-94' END AS category
        FROM {lineitem}"""),
}


def oracle(text: str, *names: str) -> str:
    """``text`` for DuckDB with the named bindings, and all they rest on, as leading CTEs."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in TABLES or name in ordered:
            return
        for dep in BINDINGS[name].deps:
            visit(dep)
        ordered.append(name)

    for name in names:
        visit(name)
    ctes = [f"{n} AS ({BINDINGS[n].sql.format(**{d: d for d in BINDINGS[n].deps})})" for n in ordered]
    text = text.strip()
    if text.upper().startswith("WITH "):
        head, text = "WITH RECURSIVE ", text[5:]
        if text.upper().startswith("RECURSIVE "):
            text = text[10:]
        return head + ",\n".join([*ctes, text])
    return ("WITH RECURSIVE " + ",\n".join(ctes) + "\n" if ctes else "") + text
