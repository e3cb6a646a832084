"""Operators against brute force on small fixtures, hot keys included."""

import inspect
import json
import math
import random
import re
import subprocess
import sys
import time
from collections import defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from pathloom.functions import scalars as S
from pathloom.operators import coverage, endpoints, entities, graph, intervals, journal, pools, ranking, reach, scoring, skew, structure, text, transfers
from pathloom import session
from pathloom.session import checkpoint_dir
from pathloom.sources import files as FS
from pathloom.sources import findings as FN
from pathloom.sources import text as TX

ROOT = Path(__file__).resolve().parent.parent


def hot_rows(n=900):
    """A third of the rows on one key."""
    rng = random.Random(5)
    return [(0 if i % 3 == 0 else rng.randrange(1, 60), i, rng.randrange(100)) for i in range(n)]


def test_top_k_and_first_by_hold_on_a_hot_key(spark):
    rows = hot_rows()
    df = spark.createDataFrame(rows, "k int, seq int, v int")
    got = {(r.k, r.seq) for r in skew.top_k(df, ["k"], [F.col("v").desc(), F.col("seq")], 5).collect()}
    by = defaultdict(list)
    for k, seq, v in rows:
        by[k].append((-v, seq))
    assert got == {(k, seq) for k, vs in by.items() for _, seq in sorted(vs)[:5]}
    first = {(r.k, r.v, r.seq) for r in skew.first_by(df, ["k"], ["v", "seq"]).collect()}
    assert first == {(k, *min((v, s) for kk, s, v in rows if kk == k)) for k in by}


def test_prefix_sum_crosses_slices(spark):
    rows = hot_rows()
    df = spark.createDataFrame(rows, "k int, seq int, v int")
    got = {(r.k, r.seq): r.run for r in skew.prefix_sum(df, ["k"], "seq", "v", "run", slices=13).collect()}
    run, want = defaultdict(int), {}
    for k, seq, v in sorted(rows, key=lambda r: r[1]):
        run[k] += v
        want[k, seq] = run[k]
    assert got == want


def test_scan_of_ties_and_one_key(spark):
    # Nearly all rows in one key, most of them under one order value, some equal in everything, a null key.
    rows = [("p", 1, i % 50, i % 7) for i in range(2000)] + [("p", i, 0, 1) for i in range(2, 100)] + [(None, 1, i, 2) for i in range(20)] + [("q", None, 3, 5), ("q", 0, 3, 5)]
    df = spark.createDataFrame(rows, "k string, seq int, name int, v int").repartition(5)
    out = skew.prefix_scan(df, ["k"], ["seq"], {"n": F.lit(1), "run": F.col("v")}, slices=16)
    assert out.columns == ["k", "seq", "name", "v", "n", "run"]
    want, sums = [], defaultdict(int)
    place = defaultdict(int)
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1] is not None, r[1] or 0, r[2], r[3])):
        place[r[0]] += 1
        sums[r[0]] += r[3]
        want.append((*r, place[r[0]], sums[r[0]]))
    assert sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str)
    # No slice holds much more than its share of the hot key.
    cut = df.repartitionByRange(16, "k", "seq", "name", "v").withColumn("s", F.spark_partition_id()).groupBy("s").count()
    assert cut.agg(F.max("count")).first()[0] < len(rows) / 4


def test_equal_places_have_one_order(spark):
    records = spark.createDataFrame([("r", 1, f"x{i}", 10) for i in range(6)] + [("r", 0, "y", 25)], "run string, priority int, name string, size int").repartition(4)
    kept = journal.fit_budget(records, ["run"], "priority", F.col("size"), 50).where("kept")
    assert sorted(r.name for r in kept.collect()) == ["x0", "x1", "y"]
    rows = spark.createDataFrame([("p", 1, e, 5) for e in "dbca"] + [("p", 0, "z", 5), ("p", 2, "b", 5)], "project string, seq int, entry string, size int").repartition(3)
    packed = journal.pack(rows, "project", "seq", "entry", "size", 10, 30)
    assert sorted((r.entry_index, r.entry, r.seq, r.detailed) for r in packed.collect()) == [
        (0, "z", 0, True), (1, "a", 1, True), (2, "b", 1, True), (2, "b", 2, False), (3, "c", 1, True), (4, "d", 1, False)]


def test_nearest_rank_matches_sorted_list(spark):
    rows = [(k, float(v * v % 37) + (v % 3) / 7) for k, v, _ in hot_rows()] + [(99, 4.0)]
    got = {r.k: (r.p50, r.p95) for r in journal.nearest_rank(spark.createDataFrame(rows, "k int, x double"), ["k"], "x", {"p50": 0.5, "p95": 0.95}, parts=4, most=20).collect()}
    by = defaultdict(list)
    for k, x in rows:
        by[k].append(x)
    pick = lambda xs, f: round(sorted(xs)[math.ceil(f * len(xs)) - 1], 6)
    assert got == {k: (pick(xs, 0.5), pick(xs, 0.95)) for k, xs in by.items()}


def test_innermost_keeps_crossing_and_equal_spans(spark):
    decls = [("f", "outer", 1, 50), ("f", "inner", 5, 9), ("f", "cross", 8, 20), ("f", "twin1", 30, 31), ("f", "twin2", 30, 31)]
    points = spark.createDataFrame([("f", n) for n in (2, 6, 8, 30, 60)], "file string, line int")
    spans = spark.createDataFrame(decls, "file string, id string, start int, end int")
    got = {r.line: (r.mapping, r.owner, r.n_owners) for r in intervals.owners(points, spans, "file", "line", "id").collect()}
    assert got == {2: ("unique", "outer", 1), 6: ("unique", "inner", 1), 8: ("ambiguous", None, 2), 30: ("ambiguous", None, 2), 60: ("unmapped", None, 0)}


def test_interval_joins_cross_block_borders(spark):
    rng = random.Random(2)
    a = [(i, s, s + rng.randrange(200)) for i, s in enumerate(rng.randrange(400) for _ in range(60))]
    b = [(i, s, s + rng.randrange(90)) for i, s in enumerate(rng.randrange(400) for _ in range(60))]
    left = spark.createDataFrame([("f", *r) for r in a], "file string, i int, ls int, le int")
    right = spark.createDataFrame([("f", *r) for r in b], "file string, j int, rs int, re int")
    got = sorted((r.i, r.j) for r in intervals.overlapping_spans(left, right, ["file"], ("ls", "le"), ("rs", "re")).collect())
    assert got == sorted((i, j) for i, s, e in a for j, x, y in b if s <= y and x <= e)
    inside = sorted((r.j, r.i) for r in intervals.spans_within(right, left, ["file"], ("rs", "re"), ("ls", "le")).collect())
    assert inside == sorted((j, i) for i, s, e in a for j, x, y in b if s <= x and y <= e)


def test_paths_are_normalised(spark):
    cases = {
        "file:///a/./B/../c%20d.java": "a/c d.java", "file://host/x/y": "host/x/y", "..\\A\\b": "a/b", "/r//s/": "r/s", "./x+y.java": "x+y.java", "a/../../b": "b", "100%": "100%",
    }
    df = spark.createDataFrame([(k,) for k in cases], "p string")
    assert {r.p: r.n for r in df.select("p", S.normalise_path(F.col("p")).alias("n")).collect()} == cases


def random_edges(seed, n=14, m=30):
    rng = random.Random(seed)
    return sorted({(rng.randrange(n), rng.randrange(n)) for _ in range(m)} - {(i, i) for i in range(n)})


@pytest.mark.parametrize("seed", [1, 2])
def test_reach_components_and_paths(spark, seed):
    edges = random_edges(seed)
    out, both = defaultdict(list), defaultdict(set)
    for a, b in edges:
        out[a].append(b)
        both[a].add(b)
        both[b].add(a)
    df = spark.createDataFrame(edges, "src long, dst long")

    def bfs(start):
        dist, todo = {start: 0}, [start]
        for node in todo:
            for nxt in out[node]:
                if nxt not in dist:
                    dist[nxt] = dist[node] + 1
                    todo.append(nxt)
        return dist

    seeds = spark.createDataFrame([(0, 0), (3, 3)], "seed long, node long")
    assert {(r.seed, r.node): r.depth for r in graph.reach(df, seeds).collect()} == {(s, n): d for s in (0, 3) for n, d in bfs(s).items()}

    label = {}
    for n in sorted(both):
        if n not in label:
            todo = [n]
            for x in todo:
                if x not in label:
                    label[x] = n
                    todo.extend(both[x])
    assert {r.node: r.label for r in graph.components(df).collect()} == label

    inputs, effects = {0, 1, 2}, {9, 10, 11}
    want = []

    def walk(path):
        if len(path) > 1 and path[-1] in effects:
            want.append(tuple(path))
            return
        if len(path) <= 4:
            for nxt in sorted(out[path[-1]]):
                if nxt not in path:
                    walk([*path, nxt])

    for i in sorted(inputs):
        walk([i])
    ends = lambda s: spark.createDataFrame([(x,) for x in s], "node long")
    got = graph.simple_paths(df, ends(inputs), ends(effects), 4, 2)
    kept, per = [], defaultdict(int)
    for p in want:
        per[p[0], p[-1]] += 1
        if per[p[0], p[-1]] <= 2:
            kept.append(p)
    assert sorted(tuple(r.path) for r in got.collect()) == sorted(kept)

    every = []

    def walk_all(path):
        if len(path) > 1 and path[-1] in effects:
            every.append(tuple(path))
        if len(path) <= 5:
            for nxt in out[path[-1]]:
                if nxt not in path:
                    walk_all([*path, nxt])

    for i in inputs:
        walk_all([i])
    weak = df.withColumn("weak", F.lit(0))
    assert sorted(tuple(r.path) for r in transfers.value_paths(weak, ends(inputs), ends(effects), 5).collect()) == sorted(every)


@pytest.mark.parametrize("seed", [3, 4])
def test_acyclic_edges_equal_sequential_admission(spark, seed):
    rng = random.Random(seed)
    edges = random_edges(seed, 9, 30)
    rng.shuffle(edges)
    rows = [(a, b, i) for i, (a, b) in enumerate(edges)]
    kept, refused = reach.acyclic_edges(spark.createDataFrame(rows, "src long, dst long, seq int"))
    out, want = defaultdict(set), []
    for a, b, i in rows:
        todo, seen = [b], set()
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo.extend(out[x])
        if a not in seen:
            out[a].add(b)
            want.append(i)
    assert sorted(r.seq for r in kept.collect()) == want
    assert kept.count() + refused.count() == len(rows)


def test_usable_edges_equal_union_find(spark):
    rng = random.Random(8)
    edges = [(a, b, rng.choice(["static", "field_state_bridge"]), rng.choice([1, 9])) for a, b in random_edges(7, 16, 40)]
    starts, ends = {0, 1}, {14, 15}
    root = {}

    def find(x):
        while root.get(x, x) != x:
            x = root[x]
        return x

    for a, b, kind, _ in edges:
        if kind == "static":
            root.setdefault(a, a)
            root.setdefault(b, b)
            root[find(a)] = find(b)
    want = set()
    for a, b, kind, fan in edges:
        if fan > 8:
            continue
        ok = kind == "static" or not (find(a) == find(b) or (a not in root and a not in starts) or (b not in root and b not in ends))
        if ok:
            want.add((a, b))
    df = spark.createDataFrame(edges, "src long, dst long, kind string, fanout int")
    nodes = lambda s: spark.createDataFrame([(x,) for x in s], "node long")
    assert {(r.src, r.dst) for r in transfers.usable_edges(df, nodes(starts), nodes(ends)).collect()} == want


def test_diverse_leads_equal_unpruned_greedy(spark):
    rng = random.Random(4)
    rows = [("p", i, rng.choice(["CWE-22", "CWE-78", "CWE-79"]), f"f{rng.randrange(9)}", rng.randrange(40)) for i in range(300)]
    got = [(r.position, r.method_id) for r in ranking.diverse_leads(spark.createDataFrame(rows, "project string, method_id int, category string, file string, score int"), limit=12).collect()]
    left, cat, fil, want = {r[1]: r for r in rows}, defaultdict(int), defaultdict(int), []
    while len(want) < 12:
        best = min(left.values(), key=lambda r: (-(r[4] - 7 * cat[r[2]] - 2 * fil[r[3]]), r[3], r[1]))
        left.pop(best[1])
        want.append((len(want) + 1, best[1]))
        cat[best[2]] += 1
        fil[best[3]] += 1
    assert sorted(got) == want


def test_edge_windows_merge_and_pad(spark):
    rng = random.Random(6)
    sites = [(o, s, s + rng.randrange(8), i) for i, (o, s) in enumerate((rng.choice("ab"), rng.randrange(1, 300)) for _ in range(80))]
    owners = {"a": (1, 320), "b": (20, 250)}
    df = text.edge_windows(spark.createDataFrame(sites, "owner string, first int, last int, rank int"), spark.createDataFrame([(k, *v) for k, v in owners.items()], "owner string, start int, end int"))
    want = []
    for owner, (low, high) in owners.items():
        groups = []
        for first, last, rank in sorted((f, e, r) for o, f, e, r in sites if o == owner):
            if groups and max(last, groups[-1][1]) - groups[-1][0] < 40:
                groups[-1] = (groups[-1][0], max(last, groups[-1][1]), min(rank, groups[-1][2]))
            else:
                groups.append((first, last, rank))
        for first, last, rank in groups:
            begin = max(low, first - 15, last - 39)
            want.append((owner, rank, begin, min(high, begin + 39, max(last, first + 24))))
    assert sorted(tuple(r) for r in df.collect()) == sorted(want)


def test_assignment_chains_track_and_clear(spark):
    assigns = [("m", 1, 10, "a", ["p"]), ("m", 2, 11, "b", ["a", "p"]), ("m", 3, 12, "a", ["zzz"]), ("m", 4, 13, "c", ["a"]), ("m", 5, 14, "d", ["b"]), ("n", 1, 3, "x", ["p"])]
    got = text.assignment_chains(spark.createDataFrame(assigns, "method string, pos long, line long, target string, uses array<string>"), spark.createDataFrame([("m", "p", 1)], "method string, name string, line long"))
    assert sorted((r.method, r.pos, r.target, r.origin, r.origin_line) for r in got.collect()) == [("m", 1, "a", "p", 1), ("m", 2, "b", "a", 10), ("m", 5, "d", "b", 11)]


def test_cards_rank_by_overlap(spark):
    cards = spark.createDataFrame([("own", "X", "alpha beta"), ("other", "Y", "alpha beta gamma"), ("gen-a", None, "alpha gamma"), ("gen-b", None, "zeta")], "card string, category string, terms string")
    q = spark.createDataFrame([(1, "X", "Alpha, gamma! gamma"), (2, "X", "none")], "query_id int, category string, text string")
    got = sorted((r.query_id, r.rank, r.card) for r in text.retrieve_cards(q, cards).collect())
    assert got == [(1, 1, "gen-a"), (1, 2, "own"), (2, 1, "own"), (2, 2, "gen-a")]


JAVA = '''package com.example.app;

/** class { doc */
@Service
public class Shop<T> extends Base {
    private final Map<String, List<T>> items = load("a {", '{');
    int count; // { open

    public Shop(String name) {
        this.count = name.length();
    }

    @Override
    protected <R> List<R> find(@Named("x") String key, int... rest) throws Exception {
        String t = """
            text { "block
            """;
        return inner(key, wrap(t, rest));
    }

    abstract void later(int a);

    static class Item {
        int weight() { return compute(1, 2); }
    }
}
'''


def test_mask_keeps_every_position(spark):
    row = spark.createDataFrame([(JAVA,)], "text string").select(entities.mask(F.col("text")).alias("m")).first().m
    assert len(row) == len(JAVA) and [i for i, c in enumerate(row) if c == "\n"] == [i for i, c in enumerate(JAVA) if c == "\n"]
    assert "doc" not in row and "open" not in row and "block" not in row and row.count("{") == row.count("}")
    assert all(a == b or a in " 0" for a, b in zip(row, JAVA))


def test_lexical_entities_of_a_class(spark):
    got, diagnostics = entities.extract_entities(spark.createDataFrame([("A.java", JAVA)], "path string, text string"))
    got = {(r.kind, r.qualified_name, r.start, r.end, r.signature) for r in got.collect()}
    base = "com.example.app.Shop"
    assert {g for g in got if g[0] in ("TYPE", "METHOD", "CONSTRUCTOR", "FIELD", "PACKAGE")} == {
        ("PACKAGE", "com.example.app", 1, 1, "package com.example.app"), ("TYPE", base, 4, 26, "class Shop"), ("TYPE", f"{base}.Item", 23, 25, "class Item"),
        ("CONSTRUCTOR", f"{base}.Shop", 9, 11, "Shop(String)"), ("METHOD", f"{base}.find", 13, 19, "find(String,int...)"), ("METHOD", f"{base}.later", 21, 21, "later(int)"),
        ("METHOD", f"{base}.Item.weight", 24, 24, "weight()"), ("FIELD", f"{base}.items", 6, 6, "items:Map<String,List<T>>"), ("FIELD", f"{base}.count", 7, 7, "count:int")}
    assert {g[1].split("::")[1] for g in got if g[0] == "CALL"} == {"length", "inner", "wrap", "compute"}
    assert diagnostics.count() == 0


SPREAD = """package com . example ;

@Marker(value = @Named("é } {"), n = (1 + (2 * (3 + (4)))))
public abstract class Wide<T extends Comparable<T>>
    extends Base<T> implements Runnable {
  private static final java.util.Map<String, java.util.List<T>>
      values = make(1), other;
  @Deprecated
  <R> R
  process(
      final @Named("a") java.util.List<? extends T> items,
      int[] more,
      String... rest
  ) throws java.io.IOException {
    this.run(a -> {
      helper(1,
          2);
      return new Inner(items) { int size() { return deep(0); } };
    }, "x, (y");
    if (more == null) { return f(g(h())); }
  }
  Wide() { this(1); }
  protected abstract void end(char c);
  enum Kind { A, B; int of(int x) { return x; } }
}
"""


def test_lexical_entities_over_many_lines(spark):
    deep = "class D { void d() { return " + "".join(f"f{i}(" for i in range(20)) + ")" * 20 + "; } }"
    broken = "class Broken {\n void m() {\n x(1;\n }\n"
    files = [("W.java", SPREAD), ("D.java", deep), ("B.java", broken), ("S.java", "}\nclass S { }\n) int x;"), ("N.java", None), ("E.java", "")]
    found, diagnostics = entities.extract_entities(spark.createDataFrame(files, "path string, text string"))
    rows = found.collect()
    base, fn = "com.example.Wide", "com.example.Wide.process(java.util.List<?extends T>,int[],String...)"
    wide = {(r.kind, r.qualified_name, r.start, r.end, r.signature, r.type_text) for r in rows if r.file == "W.java"}
    assert {w for w in wide if w[0] in ("TYPE", "METHOD", "CONSTRUCTOR", "FIELD", "PARAMETER", "PACKAGE")} >= {
        ("PACKAGE", "com.example", 1, 1, "package com.example", None), ("TYPE", base, 3, 25, "class Wide", "<T extends Comparable<T>>extends Base<T>implements Runnable"),
        ("FIELD", f"{base}.values", 6, 7, "values:java.util.Map<String,java.util.List<T>>", "java.util.Map<String,java.util.List<T>>"),
        ("METHOD", f"{base}.process", 8, 21, "process(java.util.List<?extends T>,int[],String...)", "R"), ("PARAMETER", f"{fn}#items", 11, 11, "0:java.util.List<?extends T>", "java.util.List<?extends T>"),
        ("PARAMETER", f"{fn}#more", 12, 12, "1:int[]", "int[]"), ("PARAMETER", f"{fn}#rest", 13, 13, "2:String...", "String..."), ("CONSTRUCTOR", f"{base}.Wide", 22, 22, "Wide()", base),
        ("METHOD", f"{base}.end", 23, 23, "end(char)", "void"), ("TYPE", f"{base}.Kind", 24, 24, "enum Kind", None), ("METHOD", f"{base}.Kind.of", 24, 24, "of(int)", "int")}
    calls = {(r.simple_name, r.start, r.end, r.n_args, r.detail, r.enclosing_callable, r.start_column) for r in rows if r.file == "W.java" and r.kind == "CALL"}
    assert {c[:6] for c in calls} == {
        ("run", 15, 19, 2, "METHOD_CALL", fn), ("helper", 16, 17, 2, "METHOD_CALL", fn), ("Inner", 18, 18, 1, "CONSTRUCTOR_CALL", fn), ("size", 18, 18, 0, "METHOD_CALL", fn), ("deep", 18, 18, 1, "METHOD_CALL", fn),
        ("f", 20, 20, 1, "METHOD_CALL", fn), ("g", 20, 20, 1, "METHOD_CALL", fn), ("h", 20, 20, 0, "METHOD_CALL", fn), ("this", 22, 22, 1, "DELEGATING_CONSTRUCTOR_CALL", f"{base}.Wide()")}
    assert ("run", 10) in {(c[0], c[6]) for c in calls} and ("h", 36) in {(c[0], c[6]) for c in calls}
    notes = {(r.qualified_name, r.start, r.end) for r in rows if r.file == "W.java" and r.kind == "ANNOTATION"}
    assert notes >= {(f"{base}@Marker", 3, 3), (f"{base}@Named", 3, 3), (f"{base}@Deprecated", 8, 8)} and len(notes) == 4
    assert sorted(r.simple_name for r in rows if r.file == "D.java" and r.kind == "CALL") == sorted(f"f{i}" for i in range(20))
    assert {(r.kind, r.confidence, r.end) for r in rows if r.file == "B.java" and r.kind != "CALL"} == {("TYPE", "LOW", 5), ("METHOD", "HIGH", 4)}
    assert {(r.path, r.error_class, r.line) for r in diagnostics.collect()} == {
        ("B.java", "UNMATCHED_BRACE", 1), ("B.java", "UNMATCHED_PARENTHESIS", 3), ("S.java", "UNMATCHED_BRACE", 1), ("S.java", "UNMATCHED_PARENTHESIS", 3)}


def test_masks_equal_a_plain_scan(spark):
    """Random texts, and literals so long that a recursive matcher would run out of stack."""
    plain = re.compile(r"""//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)|"{3}[\s\S]*?(?:"{3}|\Z)|"(?:\\[\s\S]?|[^"\\])*(?:"|\Z)|'(?:\\[\s\S]?|[^'\\])*(?:'|\Z)""")
    rng = random.Random(9)
    pieces = ["//", "/*", "*/", '"', "'", "\\", "\n", "a", " ", '"' * 3, "{", "é"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(40))) for _ in range(300)] + ["/*" + "x*" * 20000, '"' + "y\\n" * 20000]
    blank = lambda m: re.sub(r"[^\n]", " ", m[0]) if m[0][0] == "/" else "0" + re.sub(r"[^\n]", " ", m[0][1:])
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", entities.mask(F.col("t")).alias("m")).collect()
    assert [(r.t, r.m, plain.sub(blank, r.t)) for r in rows if r.m != plain.sub(blank, r.t)] == []


def test_redaction_keeps_bytes(spark):
    raw = "é CVE-2021-12345 x " + "a" * 40 + " Secret\nsecret"
    out = spark.createDataFrame([(raw,)], "t string").select(text.redact(F.col("t"), ["secret"]).alias("m")).first().m
    assert len(out.encode()) == len(raw.encode()) and "CVE" not in out and "ecret" not in out and out.startswith("é X")


def test_symbol_hits_page_with_declarations_first(spark):
    src = "class A {\n  void run() { run(); other.run(); }\n  // run()\n  int run(int a) { return run(); }\n}\n"
    rows = [(r.line, r.declaration, r["rank"], r.total, r.next_offset) for r in text.symbol_hits(spark.createDataFrame([("a", src)], "path string, text string"), "run", page=3).collect()]
    assert sorted(rows, key=lambda r: r[2]) == [(2, True, 1, 5, 3), (4, True, 2, 5, 3), (2, False, 3, 5, 3)]


def test_jsonl_issues_name_their_line(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"x": 1}\n\n{bad\n{"x": 2}\n[1]\n')
    (tmp_path / "b.jsonl").write_text('{"x": 3}\n"s"\n')
    schema = spark.createDataFrame([], "x int").schema
    rows, issues = TX.load_jsonl(spark, str(tmp_path), schema)
    assert sorted(r.x for r in rows.collect()) == [1, 2, 3]
    assert sorted((r.file.rsplit("/", 1)[1], r.line, r.error) for r in issues.collect()) == [
        ("a.jsonl", 3, "invalid JSON"), ("a.jsonl", 5, "record is not an object"), ("b.jsonl", 2, "record is not an object")]
    with pytest.raises(Exception):
        TX.read_jsonl(spark, str(tmp_path), schema).collect()


def test_csv_contracts(spark, tmp_path):
    (tmp_path / "h.csv").write_bytes(b"\xef\xbb\xbfa,b\n1,2\n")
    assert TX.read_csv(spark, str(tmp_path / "h.csv"), ["a", "b"]).collect()[0].asDict() == {"a": "1", "b": "2"}
    with pytest.raises(ValueError, match="missing required columns: c"):
        TX.read_csv(spark, str(tmp_path / "h.csv"), ["a", "c"])
    (tmp_path / "w.csv").write_text("1,2\n1,2,3\n")
    with pytest.raises(Exception):
        TX.decode_csv(spark, str(tmp_path / "w.csv"), ["a", "b"]).collect()
    (tmp_path / "seven.csv").write_text("k,a,b,c,d,e,f\nX,p,1,2,q,3,4\n")
    assert TX.read_relations(spark, str(tmp_path / "seven.csv")).first().asDict() == {
        "kind": "X", "l_file": "p", "l_line": 1, "l_col": 2, "r_file": "q", "r_line": 3, "r_col": 4, "detail": ""}
    (tmp_path / "six.csv").write_text("k,a,b,c,d,e\n")
    with pytest.raises(ValueError):
        TX.read_relations(spark, str(tmp_path / "six.csv"))


def sarif(*results, **run):
    return json.dumps({"version": "2.1.0", "runs": [{"tool": {"driver": {"name": "t", "rules": [{"id": "r", "properties": {"tags": ["external/cwe/CWE-0079"]}}]}}, "results": list(results), **run}]})


def at(line=3, **artifact):
    return {"physicalLocation": {"artifactLocation": artifact, "region": {"startLine": line}}}


def test_canonical_sarif_resolves_and_refuses(spark):
    long = {f"B{i}": {"uri": f"d{i}/", "uriBaseId": f"B{i + 1}"} for i in range(12)} | {"B12": {"uri": "file:///root/z/"}}
    far = at(uri="../q%41.java", uriBaseId="B0")
    far["physicalLocation"]["region"] |= {"startColumn": 7, "endLine": 5, "endColumn": 2}
    ok = {"ruleIndex": 0, "message": {"text": "m"}, "locations": [at(index=0)], "codeFlows": [{"threadFlows": [{"locations": [{"location": at(4, uri="b.java", uriBaseId="SRC")}, {"index": 0}]}]}]}
    docs = [
        ("good", sarif(ok, artifacts=[{"location": {"uri": "a%20b.java", "uriBaseId": "SRC"}}], threadFlowLocations=[{"location": at(9, uri="file:///root/z/c.java")}],
                       originalUriBaseIds={"SRC": {"uri": "src/", "uriBaseId": "ROOT"}, "ROOT": {"uri": "file:///root/z/"}})),
        ("cycle", sarif({"ruleId": "r", "locations": [at(uri="x", uriBaseId="A")]}, originalUriBaseIds={"A": {"uri": "a/", "uriBaseId": "B"}, "B": {"uri": "b/", "uriBaseId": "A"}})),
        ("remote", sarif({"ruleId": "r", "locations": [at(uri="file://other/x")]})), ("none", sarif({"ruleId": "r"})), ("line", sarif({"ruleId": "r", "locations": [at(0, uri="x")]})),
        ("failed", sarif({"ruleId": "r", "locations": [at(uri="x")]}, invocations=[{"executionSuccessful": False}])),
        ("chain", sarif({"ruleId": "r", "locations": [far, at(9, uri="b/c.java", uriBaseId="S")]}, originalUriBaseIds=long | {"S": {"uri": "file:///root/z/part"}})),
        ("old", sarif({"ruleId": "r", "locations": [at(uri="x")]}).replace("2.1.0", "1.0.0")),
    ]
    good, bad = FN.canonical_sarif(FN.parse_sarif(spark.createDataFrame(docs, "project_id string, text string")), "/root/z")
    row = sorted(good.collect(), key=lambda r: r.project_id, reverse=True)
    whole = "/".join(f"d{i}" for i in range(11, 0, -1)) + "/qA.java"
    assert [tuple(p)[:5] for p in row[1].locations] == [(whole, 3, 7, 5, 2), ("b/c.java", 9, None, 9, None)] and row[1].project_id == "chain"
    assert [(f.file_path, f.line_numbers) for f in row[1].affected_files] == [("b/c.java", [9]), (whole, [3])]
    assert len(row) == 2 and row[0].cwe == "CWE-79" and row[0].rule_id == "r" and row[0].path_evidence == "reported_path"
    assert [(p.file_path, p.line_number) for p in row[0].locations] == [("src/a b.java", 3)]
    assert [[(p.file_path, p.line_number) for p in path] for path in row[0].paths] == [[("src/b.java", 4), ("c.java", 9)]]
    assert {r.project_id: r.problem for r in bad.collect()} == {"cycle": "INVALID_PATH", "remote": "INVALID_PATH", "none": "NO_SOURCE_LOCATION", "line": "INVALID_LINE", "failed": "EXECUTION_FAILED", "old": "UNSUPPORTED_VERSION"}


def test_nested_event_traces_of_any_depth(spark):
    event = lambda line, *inner: {"filePathname": f"f{line}", "lineNumber": line, **({"events": list(inner)} if inner else {})}
    doc = json.dumps({"issues": [{"checkerName": "C", "events": [event(1, event(2, event(3, event(4)))), event(5)]}]})
    got = {(r.path_id, r.pos, r.line) for r in FN.event_traces(spark.createDataFrame([("p", doc)], "project_id string, text string")).collect()}
    assert got == {("0", 0, 1), ("0", 1, 5), ("0.0", 0, 2), ("0.0.0", 0, 3), ("0.0.0.0", 0, 4)}


def test_source_scan_reads_files(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "build").mkdir()
    (tmp_path / "src" / "A.java").write_text("class A {}")
    (tmp_path / "src" / "B.java").write_bytes(b"\xff\xfe")
    (tmp_path / "build" / "C.java").write_text("class C {}")
    good, bad = FS.scan_sources(FS.binary_files(spark, str(tmp_path), "*.java"), ".java")
    assert [r.path for r in good.collect()] == ["src/A.java"] and [r.path for r in bad.collect()] == ["src/B.java"]


def test_three_outcomes_of_a_toy_graph(spark):
    """One connected, one disconnected and one structural-only pair."""
    flow = spark.createDataFrame([("i1", "n1"), ("n1", "e1"), ("i3", "n3"), ("m3", "e3")], "src string, dst string")
    nodes = lambda *xs: spark.createDataFrame([(x,) for x in xs], "node string")
    linked = reach.connected(nodes("i1", "i2", "i3"), nodes("e1", "e2", "e3"), flow)
    assert {(r.input, r.effect) for r in linked.collect()} == {("i1", "e1")}
    near = spark.createDataFrame([("n3", "m3", 1, "CALL_ADJACENT"), ("n1", "e1", 1, "CALL_ADJACENT")], "left string, right string, distance int, reason string")
    got = structure.frontiers(nodes("i1", "i2", "i3"), nodes("e1", "e2", "e3"), near, flow)
    assert [(r.input, r.effect, r.reason) for r in got.collect()] == [("i3", "e3", "CALL_ADJACENT")]


def test_coverage_stays_three_valued(spark):
    fixes = spark.createDataFrame([("c1", "p", "a.java", "A", "m", None, None), ("c2", "q", "b.java", "B", "m", 3, 5), ("c3", "r", "z.java", "Z", "m", 3, 5)],
                                  "case_id string, project_id string, fix_file string, class_name string, method string, method_start int, method_end int")
    spots = spark.createDataFrame([("p", "src/A.java", 9), ("q", "src/b.java", 4), ("r", "other.java", 4)], "project_id string, file string, line int")
    got = {r.case_id: (r.file_covered, r.method_covered, r.comparison_level, r.covered) for r in coverage.case_coverage(spots, fixes).collect()}
    assert got == {"c1": (True, None, "FILE", True), "c2": (True, True, "METHOD", True), "c3": (False, False, "METHOD", False)}


def test_detectors_take_no_labels():
    for module in (structure, graph, reach, transfers, endpoints, pools):
        for name, fn in inspect.getmembers(module, inspect.isfunction):
            assert not {"fixes", "labels", "targets_truth"} & set(inspect.signature(fn).parameters), name


def test_registry_needs_no_session():
    code = "import sys; sys.path.insert(0, '.'); import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    assert int(out.stdout.split()[0]) >= 215


def test_sources_keep_the_house_rules():
    """Nothing is gathered on the driver, cut off from its lineage on one machine, or crossed."""
    for folder in ("functions", "operators", "plans", "sources", "streaming"):
        for path in (ROOT / "pathloom" / folder).rglob("*.py"):
            body = path.read_text()
            assert "localCheckpoint" not in body and "crossJoin" not in body and ".toPandas(" not in body, path
            assert not re.search(r"\.collect\(\)", body), path


def test_checkpoint_folder_is_the_sessions_own(spark):
    assert checkpoint_dir(spark) == spark.sparkContext.getCheckpointDir()


def test_strict_reads_fail_under_every_plan(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n\n[{"a": 2}, {"a": 3}]\n')
    (tmp_path / "ok.jsonl").write_text('{"a": 1, "b": "x"}\n \n{"a": null}\n')
    (tmp_path / "w.csv").write_text("x,1\ny\nz,2,3\n")
    (tmp_path / "r.csv").write_text("k,a,b,c,d,e,f\nk,F,1,2,G,3,4\nk,F,1\n")
    assert [tuple(r) for r in TX.read_jsonl(spark, str(tmp_path / "ok.jsonl"), "a int, b string").collect()] == [(1, "x"), (None, None)]
    reads = [TX.read_jsonl(spark, str(tmp_path / "a.jsonl"), "a int, b string").select("b"), TX.decode_csv(spark, str(tmp_path / "w.csv"), ["p", "q"]).select("p"),
             TX.read_relations(spark, str(tmp_path / "r.csv")).select("l_file")]
    for df in reads:
        for run in (df.collect, df.count):
            with pytest.raises(Exception):  # noqa: B017
                run()


def test_url_join(spark):
    from urllib.parse import urljoin

    cases = [(b, r) for b in ("file:///repo/src", "file:///repo/src/", "src/", "src/main", "", "https://h/a/b", "https://h", "/abs/x") for r in
             ("part/P.java", "/root.java", "", "../up.java", "./here", "a/../b/./c", "file:///other/x", "//h/x", "x/..", "q?y=/../z")]
    rows = spark.createDataFrame(cases, "b string, r string").select("b", "r", S.url_join(F.col("b"), F.col("r")).alias("j")).collect()
    assert [(r.b, r.r, r.j) for r in rows if r.j != urljoin(r.b, r.r)] == []


def test_mapper_markup(spark):
    good = """<?xml version="1.0"?>
<!DOCTYPE mapper PUBLIC "-//x//EN" "x.dtd">
<!-- <select id="no"> -->
<mapper namespace="com.A &amp; B">
  <resultMap id="m0"/>
  <select id='q' resultMap="a0, b ,">
    select <![CDATA[ a < 3 <include refid="no"/> ]]>
    <if test="x"><include
      refid="c10"/></if> <include refid=""/>
  </select>
  <sql>x</sql>
</mapper>"""
    bad = ["<mapper><a></mapper></a>", "<mapper><a>", "<mapper/><mapper/>", "<mapper>a < b</mapper>", '<!DOCTYPE m [<!ENTITY e "x">]><mapper><a id="1"/></mapper>', "", "plain"]
    other = "<other><a id='1'/></other>"
    df = spark.createDataFrame([("g", good), ("o", other), ("n", None), *[(f"b{i}", t) for i, t in enumerate(bad)]], "path string, text string")
    rows = sorted((tuple(r) for r in text.mapper_entries(df).collect()), key=lambda r: (r[0], r[4], r[6] or ""))
    assert rows == [
        ("g", "com.A & B", "resultMap", "m0", 5, 5, None, None), ("g", "com.A & B", "select", "q", 6, 10, "a0", 6), ("g", "com.A & B", "select", "q", 6, 10, "b", 6),
        ("g", "com.A & B", "select", "q", 6, 10, "c10", 8), ("g", "com.A & B", "sql", None, 11, 11, None, None), ("o", None, "a", "1", 1, 1, None, None)]


def test_ordered_writers(spark, tmp_path):
    from pathloom.sources import sinks

    df = spark.createDataFrame([(3, "c"), (1, None), (2, 'q"')], "k int, v string").repartition(3)
    sinks.write_csv(df, str(tmp_path / "c"), ["v", "k"], ["k"])
    parts = sorted((tmp_path / "c").glob("part-*.csv"))
    assert [r for p in parts for r in p.read_text().splitlines() if r != "v,k"] == [",1", '"q\\"",2', "c,3"]
    sinks.write_summary(df.orderBy("k").limit(1), str(tmp_path / "s"))
    assert json.loads(next((tmp_path / "s").glob("part-*.json")).read_text()) == {"k": 1, "v": None}


def test_faults_and_late_rows_of_a_journal(spark):
    start = spark.createDataFrame([("a", 1, 10), ("a", 2, 10), ("b", 3, 5)], "request_key string, seq int, reserved_tokens long")
    answer = spark.createDataFrame([("b", 4), ("b", 4)], "request_key string, total_tokens long")
    outcome = spark.createDataFrame([("a", "FAILED_HTTP"), ("a", "UNKNOWN_QUARANTINED"), ("z", "ODD")], "request_key string, outcome string")
    found = {(r.request_key, r.fault) for r in journal.faults(start, answer, outcome).collect()}
    assert found == {("a", "DUPLICATE_START"), ("b", "DUPLICATE_RESPONSE"), ("a", "CONFLICTING_OUTCOMES"), ("z", "INVALID_OUTCOME"), ("z", "OUTCOME_WITHOUT_START")}
    aside = spark.createDataFrame([("h", 1), ("h", 1), ("i", 1)], "request_key string, run int")
    row = journal.accounting(journal.settle(start, answer, outcome).withColumn("run", F.lit(1)), ["run"], aside).first()
    assert (row.physical_requests, row.reported_tokens, row.quarantined_requests, row.historical_quarantined_requests) == (2, 4, 1, 2)


def test_nearest_rank_narrows_skewed_values(spark):
    """Values over many magnitudes with repeats and an outlier, narrowed several times."""
    rng = random.Random(6)
    rows = [("a", float(rng.choice([rng.randrange(5), 10 ** rng.randrange(6) + rng.random(), 1e12]))) for _ in range(3000)] + [("b", 7.0)] * 40 + [("c", None)]
    got = {r.k: (r.lo, r.mid, r.hi) for r in journal.nearest_rank(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", {"lo": 0.01, "mid": 0.5, "hi": 0.95}, parts=4, most=30).collect()}
    for k in "ab":
        vs = sorted(v for x, v in rows if x == k)
        assert got[k] == tuple(round(vs[max(math.ceil(len(vs) * f), 1) - 1], 6) for f in (0.01, 0.5, 0.95))
    assert set(got) == {"a", "b"}


def test_longest_common_runs(spark):
    rng = random.Random(6)
    chains = {c: [rng.choice("abcd") for _ in range(rng.randrange(1, 14))] for c in range(25)} | {90: ["hot"] * 300, 91: ["none"], 92: ["hot", "hot", "x"]}
    paths = {c: [rng.choice("abcde") for _ in range(rng.randrange(1, 14))] for c in range(12)} | {70: ["hot"] * 211, 71: chains[3] + ["e"]}

    def longest(chain):
        n = 0
        for path in paths.values():
            for d in range(-len(path), len(chain)):
                run = 0
                for i in range(len(chain)):
                    run = run + 1 if 0 <= i - d < len(path) and chain[i] == path[i - d] else 0
                    n = max(n, run)
        return max(n - 1, 0)

    rows = lambda held: [(k, i, o) for k, v in held.items() for i, o in enumerate(v)]
    got = scoring.max_connected(spark.createDataFrame(rows(chains), "chain_id int, pos int, owner string"), spark.createDataFrame(rows(paths), "path_id int, pos int, owner string"))
    assert {r.chain_id: r.max_connected_hops for r in got.collect()} == {c: longest(v) for c, v in chains.items()}


def test_chosen_targets_equal_all_against_all(spark):
    rng = random.Random(12)
    callables = []
    for i in range(80):
        start = rng.randrange(1, 60)
        callables.append((rng.choice("pq"), i, f"m{rng.randrange(12)}", f"src/F{rng.randrange(6)}.java", start, start + rng.randrange(6), rng.randrange(0, 12)))
    calls = [(i, f"c{i}-{n}", rng.randrange(99), rng.choice([0, 1])) for i in range(80) for n in range(2)]
    hints = [(f"h{n}", rng.choice("pqr"), rng.choice([f"m{rng.randrange(30)}", None]), f"lib/F{rng.randrange(20)}.java", rng.choice([0, None, rng.randrange(1, 200), rng.randrange(1, 70)])) for n in range(120)]
    first = {}
    for i, call, line, args in calls:
        if args:
            first[i] = min(first.get(i, (line, call)), (line, call))
    want = {}
    for case, project, name, file, line in hints:
        line = line or 0
        ranked = [
            (100 * (name == n) + 50 * (file.split("/")[-1] == f.split("/")[-1]) + 30 * (line > 0 and s <= line <= e) + min(k, 9), -abs(s - line) if line > 0 else 0, -s, i)
            for p, i, n, f, s, e, k in callables if p == project and k > 0 and i in first]
        if ranked:
            want[case] = (max(ranked)[3], max(ranked)[0], first[max(ranked)[3]][1])
    got = scoring.choose_target(
        spark.createDataFrame(hints, "case_id string, project string, name string, file string, line int"),
        spark.createDataFrame(callables, "project string, entity_id int, name string, file string, start int, end int, params int"),
        spark.createDataFrame(calls, "entity_id int, call_id string, line int, args int"))
    assert {r.case_id: (r.entity_id, r.score, r.call_id) for r in got.collect()} == want


def steps(df, word):
    """How often a word stands in the plan of a query not yet run."""
    return df._jdf.queryExecution().executedPlan().toString().count(word)


def test_symbol_hits_mask_texts_once(spark):
    df = spark.createDataFrame([("a", "x other(1); /* other( */ y(other(2))\r\nint other(){}\u2028other (3);\x85 other(4)")], "path string, text string")
    hits = text.symbol_hits(df, "other", page=2)
    assert [(r.line, r.declaration, r["rank"], r.total, r.next_offset) for r in hits.orderBy("rank").collect()] == [(1, True, 1, 5, 2), (2, True, 2, 5, 2)]
    assert steps(hits, "Generate posexplode(") == steps(text.symbol_hits(df, "other", page=None), "Generate posexplode(") == 2
    rare = spark.createDataFrame([("a\r\nb\rc\x85d\u2029e\x1c\n",), ("a\n\nb\n",)], "t string").select(text.line_array(F.col("t")).alias("a")).collect()
    assert [r.a for r in rare] == [["a", "b", "c", "d", "e", ""], ["a", "", "b"]]


def test_mapper_files_are_dealt_once(spark):
    xml = '<?xml version="1.0"?>\n<!-- <select id="no"/> -->\n<mapper namespace="n">\n<sql id="c"/>\n<select id="s" resultMap="r, q">\n<include refid="c"/><if test="a"><include refid=""/></if>\n</select></mapper>'
    torn = '<mapper namespace="n"><select id="s"></sql></mapper>'
    df = spark.createDataFrame([("a.xml", xml), ("b.xml", torn)], "path string, text string")
    rows = text.mapper_entries(df)
    assert sorted((r.tag, r.id, r.first, r.last, r.ref or "", r.ref_line) for r in rows.collect() if r.path == "a.xml") == [
        ("select", "s", 5, 7, "c", 6), ("select", "s", 5, 7, "q", 5), ("select", "s", 5, 7, "r", 5), ("sql", "c", 4, 4, "", None)]
    assert not rows.filter("path = 'b.xml'").count()
    assert steps(text.mapper_entries(df), "Exchange hashpartitioning") == 1


def test_merged_findings_are_grouped_once_and_carry_only_what_is_asked(spark):
    from pathloom.sources.findings import merge_findings

    place, node = "array<struct<file_path: string, lines: array<int>>>", "array<array<struct<file_path: string, line_number: int>>>"
    rows = [(n, f"t{n}", "c", [("src/a", [1])], [[("src/a", 1)]] if n < 4 else []) for n in (3, 1, 2, 4)] + [(None, "t", "c", [("src/a", [1])], [])]
    df = spark.createDataFrame(rows, f"seq int, tool string, category string, affected {place}, flows {node}")
    merged = merge_findings(df, F.col("category"), "seq")[0]
    assert sorted((r.seq or 0, r.tool, r.claims) for r in merged.select("seq", "tool", "claims").collect()) == [(0, "t", 2), (1, "t1", 3)]
    short = merge_findings(df, F.col("category"), "seq")[0].select("fingerprint", "seq", "claims")
    assert steps(short, "Exchange") == 1 and steps(short, "SortAggregate") == 0


def test_json_nodes_are_told_once(spark, monkeypatch):
    from pathloom.operators import records

    def never(df):
        raise AssertionError("a checkpoint runs its rows twice")

    monkeypatch.setattr(records, "cut_lineage", never, raising=False)
    df = spark.createDataFrame([(1, '{"a": {"b": [1, "{x", {}], "c": null}, "d": "[y"}')], "key int, text string")
    rows = records.json_nodes(df, "key", "text").collect()
    assert sorted((".".join(r.path), r.json, r.named, r.container, r.object) for r in rows) == [
        ("a", '{"b":[1,"{x",{}],"c":null}', True, True, True), ("a.b", '[1,"{x",{}]', True, True, False), ("a.b.0", "1", False, False, False),
        ("a.b.1", '"{x"', False, False, False), ("a.b.2", "{}", False, True, True), ("a.c", "null", True, False, False), ("d", '"[y"', True, False, False)]


def test_pools_read_reports_once_and_group_both_sides_in_one_table(spark):
    from pathloom.operators.pools import preservation

    import __spark_entry__ as entry

    for name in ("c24_pool_coverage", "c24_coverage_totals", "d15_preservation"):
        assert steps(entry.queries()[name](spark, "/root/testdata/sf0.001"), "ObjectHashAggregate") == 0
    ids = lambda *v: spark.createDataFrame([(x,) for x in v], "id string")
    got = preservation(ids("a", "a", "b", "c", None), ids("b", "c", "c", "x", None), "id")
    assert steps(got, "Join") == 0
    assert tuple(got.first()) == (4, 4, 2, 1, 0.5, "FAIL")


def test_meetings_are_not_dealt_by_pair(spark):
    from pathloom.operators.transfers import structural_meetings

    left = [(f"l{i}", f"m{i % 3}", f"t{i % 2}") for i in range(6)] + [("l0", "m0", "t0"), ("r1", "m1", "t1")]
    right = [(f"r{i}", f"m{i % 3}", f"t{i % 2}") for i in range(12)]
    edges = [("l0", "r0"), ("l0", "r0"), ("l0", "r1"), ("l0", "r10"), ("l3", "r1"), ("l9", "r1"), (None, "r3")]
    two = lambda rows: spark.createDataFrame(rows, "tip string, owner string, type string")
    got = structural_meetings(two(left), two(right), spark.createDataFrame(edges, "src string, dst string"), 3)
    kept = {ty: sorted(r for r in set(right) if r[2] == ty)[:3] for ty in ("t0", "t1")}
    want = sorted((a, b, "intra_method_hop" if o == p else "shared_class_hop") for a, o, ty in set(left) for b, p, _ in kept[ty] if a != b and (a, b) not in edges)
    assert sorted(map(tuple, got.collect())) == want
    assert "LeftAnti" not in got._jdf.queryExecution().executedPlan().toString()


def most_told_apart(df):
    """The most rows that one aggregate of a query gave; the query has been run."""
    def walk(plan):
        kind = plan.nodeName()
        if "HashAggregate" in kind:
            yield plan.metrics().apply("numOutputRows").value()
        if kind == "AdaptiveSparkPlan":
            inside = [plan.executedPlan()]
        elif kind.endswith("QueryStage"):
            inside = [plan.plan()]
        else:
            inside = [plan.children().apply(i) for i in range(plan.children().size())]
        for child in inside:
            yield from walk(child)

    return max(walk(df._jdf.queryExecution().executedPlan()))


def closure_rows(allocations, arguments, callbacks, captures, outputs):
    given = {(c, k, i, ty) for c, k, ty in allocations for d, i, constant in arguments if c is not None and c == d and constant is False}
    made = {(c, k, i, ty, m) for c, k, i, ty in given for uy, m in callbacks if ty is not None and ty == uy}
    rows = {(c, i, m, "RECEIVER", -1) for c, _, i, _, m in made}
    for c, k, i, _, m in made:
        fields = {f for ctor, position, f in captures if (ctor, position) == (k, i) and f is not None}
        rows |= {(c, i, site, role, x) for f, n, site, role, x in outputs if f in fields and n == m and m is not None}
    return sorted(((c, "ARGUMENT", i, sink, role, x, "closure_object_bridge") for c, i, sink, role, x in rows), key=str)


def closure_frames(spark, *rows):
    kinds = ("call string, ctor int, type int", "call string, index int, constant boolean", "type int, method string", "ctor int, position int, field int", "field int, method string, site string, role string, index int")
    return [spark.createDataFrame(r, k) for r, k in zip(rows, kinds)]


def test_closure_arguments_are_told_apart_before_callbacks_multiply_them(spark):
    n = 60
    rows = [(f"c{i}", i % 3, 7) for i in range(n)], [(f"c{i}", j, j == 2) for i in range(n) for j in range(3)], [(7, f"m{i}") for i in range(n)], [(0, 0, 9)], [(9, "m1", "s", "ARGUMENT", 1)]
    df = transfers.closure_transfers(*closure_frames(spark, *rows))
    assert sorted(map(tuple, df.collect()), key=str) == closure_rows(*rows)
    assert df.count() == 2 * n * n + n // 3
    assert most_told_apart(df) <= 2 * n


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_closure_rows_come_once(spark, seed):
    # Rows given twice, calls and callbacks of several types, nulls, and outputs that are receivers of a callback's name.
    rng = random.Random(seed)
    pick = lambda *of: rng.choice(of)
    some = lambda m, make: (rows := [make() for _ in range(m)]) + rows[: m // 3]
    methods = ("m1", "m2", "m3", "m4", None)
    rows = (
        some(12, lambda: (pick("a", "b", "c", "d", None), pick(1, 2, None), pick(1, 2, 3, None))),
        some(14, lambda: (pick("a", "b", "c", "d", None), pick(0, 1, None), pick(False, False, True, None))),
        some(8, lambda: (pick(1, 2, 3, None), pick(*methods))),
        some(5, lambda: (pick(1, 2), pick(0, 1), pick(5, 6, None))),
        some(12, lambda: (pick(5, 6, None), pick(*methods), pick("m1", "m3", "s", None), pick("RECEIVER", "ARGUMENT", None), pick(-1, 0, None))))
    assert sorted(map(tuple, transfers.closure_transfers(*closure_frames(spark, *rows)).collect()), key=str) == closure_rows(*rows)


def test_components_shrink_without_checkpoints(spark, monkeypatch):
    from pathloom.operators import graph

    def never(df):
        raise AssertionError("a checkpoint runs its rows twice")

    monkeypatch.setattr(graph, "cut_lineage", never)
    rng = random.Random(5)
    order = rng.sample(range(100, 160), 60)
    edges = [*zip(order, order[1:]), (1, 1), (3, 2), (4, 3), (2, 3), (9, 7), (8, 9), (6, 8), (50, None), (None, 50)]
    got = {r.node: r.label for r in graph.components(spark.createDataFrame(edges, "src int, dst int")).collect()}
    assert got == {n: 100 for n in order} | {1: 1, 2: 2, 3: 2, 4: 2, 6: 6, 7: 6, 8: 6, 9: 6}
    assert graph.components(spark.createDataFrame([], "src int, dst int")).count() == 0


def test_files_go_by_number_so_a_path_given_twice_mixes_nothing(spark):
    src = "package p;\nclass A {\n  @Mark int f = 1;\n  void run(int a) { go(a); }\n}\n"
    told = lambda rows: sorted(map(str, entities.extract_entities(spark.createDataFrame(rows, "path string, text string"))[0].collect()))
    assert told([("a/A.java", src), ("a/A.java", src)]) == told([("a/A.java", src)])


def test_a_frequent_name_does_not_meet_all_its_callables(spark, monkeypatch):
    from pathloom.operators import scoring
    from pathloom.session import cut_lineage, stored

    written = []

    def counted(keep):
        def write(df):
            out = keep(df)
            written.append(out.count())
            return out
        return write

    monkeypatch.setattr(scoring, "stored", counted(stored))
    monkeypatch.setattr(scoring, "cut_lineage", counted(cut_lineage), raising=False)
    n = 200
    hints = [(f"h{i}", "p", "run", f"F{i}.java", i % 7) for i in range(n)]
    callables = [("p", i, "run", f"G{i}.java", 1 + i % 5, 3 + i % 5, i % 12) for i in range(n)]
    calls = [(i, f"c{i}", 1, 1) for i in range(n)]
    got = scoring.choose_target(
        spark.createDataFrame(hints, "case_id string, project string, name string, file string, line int"),
        spark.createDataFrame(callables, "project string, entity_id int, name string, file string, start int, end int, params int"),
        spark.createDataFrame(calls, "entity_id int, call_id string, line int, args int")).collect()
    want = {}
    for case, _, _, _, line in hints:
        best = max((100 + 30 * (line > 0 and s <= line <= e) + min(k, 9), -abs(s - line) if line else 0, -s, i) for _, i, _, _, s, e, k in callables if k > 0)
        want[case] = (best[3], best[0])
    assert {r.case_id: (r.entity_id, r.score) for r in got} == want
    assert max(written) <= 2 * n


def closure(edges, nodes):
    after, out = defaultdict(set), {}
    for a, b in edges:
        after[a].add(b)
    for n in nodes:
        seen, todo = {n}, [n]
        while todo:
            for x in after[todo.pop()] - seen:
                seen.add(x)
                todo.append(x)
        out[n] = seen
    return out


@pytest.mark.parametrize("cyclic", [True, False])
def test_labels_tell_what_reaches_what(spark, cyclic):
    rng = random.Random(3)
    edges = {(rng.randrange(24), rng.randrange(24)) for _ in range(36)} | {(1, 1), (20, 21), (21, 22), (22, 20), (22, 23)}
    if not cyclic:
        edges = {(a, b) for a, b in edges if a < b}
    below = closure(edges, range(30))
    df = spark.createDataFrame([(f"n{a}", f"n{b}") for a, b in edges], "src string, dst string")
    goals = set(range(0, 30, 2))
    seeds = spark.createDataFrame([(f"n{a}",) for a in range(30)], "seed string")
    nodes = spark.createDataFrame([(f"n{g}", g % 4) for g in goals], "node string, class int")
    got = reach.reach_labels(df, nodes, [] if cyclic else ["class"]).reached(seeds).collect()
    held = {n for e in edges for n in e} | goals
    known = {(f"n{a}", f"n{b}") for a in held for b in below[a] if b in goals}
    assert {tuple(r) for r in got} == known and len(got) == len(known)
    if cyclic:
        parts = {r.node: r.component for r in reach.strong_components(df).collect()}
        same = lambda a, b: b in below[a] and a in below[b]
        assert len(parts) > 3 and set(parts) == {f"n{a}" for a in range(24) if any(same(a, b) for b in range(24) if b != a)}
        assert all((parts[f"n{a}"] == parts[f"n{b}"]) == same(a, b) for a in range(24) for b in range(24) if f"n{a}" in parts and f"n{b}" in parts)


def test_a_hub_costs_one_run_a_node(spark):
    """320 inputs over one hub to 320 effects are 102,400 pairs, but one run a node."""
    edges = [(i, 1000) for i in range(320)] + [(1000, 2000 + i) for i in range(320)]
    df = spark.createDataFrame(edges, "src long, dst long")
    labels = reach.reach_labels(df, spark.range(2000, 2320).withColumnRenamed("id", "node"))
    assert labels.runs.count() == 320 + 1 + 320
    got = labels.reached(spark.range(320).withColumnRenamed("id", "seed"))
    assert got.count() == got.distinct().count() == 102_400
    asked = spark.createDataFrame([(1, 2001), (1, 2319), (2000, 2001), (2000, 2000), (1000, 2100), (5, 1000)], "a long, b long")
    assert {tuple(r) for r in labels.test(asked, "a", "b").collect()} == {(1, 2001), (1, 2319), (2000, 2000), (1000, 2100)}


def test_admission_by_case_with_equal_places(spark):
    rng = random.Random(7)
    rows = [(case, rng.choice("abcd"), rng.choice("abcd"), rng.randrange(4)) for case in ("x", "y", None) for _ in range(9)]
    rows += [("x", "a", "b", 9), ("y", "b", "a", 9)] + [("z", str(i), str(i + 1), i) for i in range(9)] + [("z", "9", "0", 9), ("z", "1", "0", 10), ("z", "0", "9", 11)]
    want = []
    for case in ("x", "y", "z", None):
        kept = []
        for r in sorted((r for r in rows if r[0] == case), key=lambda r: (r[3], r[1], r[2])):
            if r[1] not in closure(kept, [r[2]])[r[2]]:
                kept.append(r[1:3])
                want.append(r)
    df = spark.createDataFrame(rows, "case string, src string, dst string, seq int").repartition(4)
    for small in (4096, 11):  # beyond the bound, component z is settled by rounds
        kept, refused = reach.acyclic_edges(df, case=["case"], small=small)
        assert kept.columns == df.columns
        assert sorted(map(tuple, kept.collect()), key=str) == sorted(want, key=str)
        assert sorted(map(tuple, kept.unionByName(refused).collect()), key=str) == sorted(rows, key=str)


def test_connected_among_asks_only_the_given_pairs(spark):
    rng = random.Random(11)
    edges = {(rng.randrange(30), rng.randrange(30)) for _ in range(45)}
    pairs = {(rng.randrange(30), rng.randrange(30)) for _ in range(80)} | {(3, 3), (99, 1), (1, 99)}
    below = closure(edges, range(100))
    got = reach.connected_among(spark.createDataFrame(list(pairs), "input int, effect int"), spark.createDataFrame(list(edges), "src int, dst int"))
    assert {(r.input, r.effect) for r in got.collect()} == {(a, b) for a, b in pairs if b in below[a]}


def test_cheapest_walks_over_text_nodes(spark):
    edges = spark.createDataFrame([("a", "b", 1), ("b", "c", 3), ("a", "c", 5), ("c", "d", 1)], "src string, dst string, cost int")
    got = {(r.node, r.cost, r.parent) for r in graph.cheapest(edges, spark.createDataFrame([("a",)], "node string")).collect()}
    assert got == {("a", 0, None), ("b", 1, "a"), ("c", 4, "b"), ("d", 5, "c")}


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}


def left_behind(spark, before):
    """Shuffle files that a step leaves; they go in the background."""
    end = time.time() + 20
    while (left := shuffle_files(spark) - before) and time.time() < end:
        time.sleep(0.2)
    return left


def test_written_steps_give_their_shuffle_files_back(spark):
    rows = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.sum("id").alias("v"))
    before = shuffle_files(spark)
    tables = [session.stored(rows), session.cut_lineage(rows)]
    assert session.some(rows) and not session.some(rows.filter("v < 0"))
    assert not left_behind(spark, before)
    assert [sorted(map(tuple, t.collect())) for t in tables] == [sorted((k, sum(range(k, 1000, 7))) for k in range(7))] * 2
    assert spark.conf.get(session.FREED) == "false"


def test_admission_asks_evidence_once_and_keeps_no_shuffle_files(spark, monkeypatch):
    from pathloom.operators import evidence as V

    def never(df):
        raise AssertionError("evidence is written as a checkpoint")

    monkeypatch.setattr(V, "cut_lineage", never)
    call, declares, wrapper = ("CODEQL_CALL", "DETERMINISTIC_FACT"), ("DECLARES", "STRUCTURAL_EVIDENCE"), ("WRAPPER_FLOW", "ADMISSIBLE_SEMANTIC_PROPOSAL")
    # id: ends, kind, proposal, provenance; cited evidence; tools used; what becomes of it.
    cases = {
        "ok": ("a", "b", call, None, True, ["v1"], [1], None), "kind": ("a", "b", ("X", "DETERMINISTIC_FACT"), None, True, ["v1"], [1], "UNKNOWN_RELATION_OR_SUPPORT"),
        "node": ("a", "gone", call, None, True, ["v1"], [1], "EDGE_NODE_NOT_FOUND"), "cross": ("a", "o", call, None, True, ["v1"], [1], "CROSS_REPOSITORY_EDGE"),
        "class": ("a", "b", ("CODEQL_CALL", "STRUCTURAL_EVIDENCE"), None, True, ["v1"], [1], "SUPPORT_CLASS_MISMATCH"),
        "bare": ("a", "b", call, None, True, [], [1], "ANONYMOUS_EDGE"), "origin": ("a", "b", call, None, False, ["v1"], [1], "EDGE_PROVENANCE_REQUIRED"),
        "missing": ("a", "b", call, None, True, ["v1", "v9"], [1], "EVIDENCE_REF_NOT_FOUND"), "lost": ("a", "b", call, None, True, ["v1", "v2"], [1], "EVIDENCE_ENTITY_NOT_FOUND"),
        "null": ("a", "b", call, None, True, ["v6"], [1], "EVIDENCE_ENTITY_NOT_FOUND"), "made": ("a", "b", call, None, True, ["v3"], [1], "FABRICATED_CODEQL_EDGE"),
        "tool": ("a", "b", call, None, True, ["v1"], [1, 9], "CODEQL_TOOL_CALL_NOT_FOUND"), "fail": ("a", "b", call, None, True, ["v1"], [1, 2], "CODEQL_TOOL_CALL_NOT_OK"),
        "far": ("a", "c", call, None, True, ["v1"], [1], "CODEQL_TOOL_EVIDENCE_MISMATCH"), "other": ("a", "b", call, None, True, ["v1"], [1, 3], "CODEQL_TOOL_EVIDENCE_MISMATCH"),
        "text": ("a", "b", declares, None, True, ["v3"], [], None), "none": ("a", "b", declares, None, True, ["v1"], [], "REPOSITORY_EVIDENCE_REQUIRED"),
        "end": ("a", "c", declares, None, True, ["v3"], [], "REPOSITORY_EVIDENCE_ENDPOINT_MISMATCH"), "flow": ("a", "b", wrapper, 1, True, ["v1", "v3"], [], None),
        "less": ("a", "b", wrapper, 1, True, ["v1"], [], "PROPOSAL_EVIDENCE_MISMATCH"), "swap": ("a", "b", wrapper, 1, True, ["v1", "v4"], [], "PROPOSAL_EVIDENCE_MISMATCH"),
        "shut": ("a", "b", wrapper, 2, True, ["v1"], [], "PROPOSAL_NOT_ADMISSIBLE"), "free": ("a", "b", wrapper, None, True, ["v1"], [], "PROPOSAL_NOT_ADMISSIBLE"),
    }
    frame = spark.createDataFrame
    edges = frame([(k, a, b, *kind, p, ok) for k, (a, b, kind, p, ok, *_) in cases.items()], "edge_id string, src string, dst string, relation string, support string, proposal_id int, provenance boolean")
    refs = frame([(k, v) for k, c in cases.items() for v in c[5] * 2], "edge_id string, evidence_id string")
    used = frame([(k, v) for k, c in cases.items() for v in c[6]], "edge_id string, tool_id int")
    nodes = frame([("a", "m"), ("b", "m"), ("c", "m"), ("o", "n")], "node string, project string")
    evidence = frame([("v1", "CODEQL_CALL", 1), ("v2", "CODEQL_CALL", 1), ("v3", "SOURCE_SNIPPET", None), ("v4", "SOURCE_SNIPPET", None), ("v6", "CODEQL_CALL", 1)], "evidence_id string, source_kind string, tool_id int")
    covers = frame([(v, n) for v, of in (("v1", "ab"), ("v2", "abx"), ("v3", "ab"), ("v4", "a"), ("v6", "ab")) for n in of] + [("v1", "a"), ("v6", None)], "evidence_id string, node string")
    tools, proposals = frame([(1, "OK"), (2, "ERROR"), (3, "OK")], "tool_id int, status string"), frame([(1, "ADMISSIBLE"), (2, "REJECTED")], "proposal_id int, status string")
    asked = frame([(1, "v1"), (1, "v3"), (1, "v3"), (2, "v1")], "proposal_id int, evidence_id string")
    before = shuffle_files(spark)
    kept, refused = V.admit_edges(edges, refs, used, nodes, evidence, covers, tools, proposals, asked)
    assert not left_behind(spark, before)
    assert {r.edge_id: None for r in kept.collect()} | {r.edge_id: r.code for r in refused.collect()} == {k: c[7] for k, c in cases.items()}
    assert kept.columns == edges.columns and kept.count() + refused.count() == len(cases)


def test_a_prefix_meets_every_suffix_of_its_type(spark):
    two = lambda rows: spark.createDataFrame(rows, "tip string, owner string, type string")
    suffixes = [(f"r{i:02}", f"m{i % 3}", "t0") for i in range(45)]
    got = transfers.structural_meetings(two([("l", "m1", "t0")]), two(suffixes), spark.createDataFrame([("l", "r07"), ("l", "r44")], "src string, dst string"))
    want = [("l", r, "intra_method_hop" if o == "m1" else "shared_class_hop") for r, o, _ in suffixes if r not in ("r07", "r44")]
    assert sorted(map(tuple, got.collect())) == want


def test_site_graph_and_meetings_are_told_apart_by_kind(spark):
    frame = spark.createDataFrame
    calls = frame([("s1", 1, 2, "CALL"), ("s1", 1, 2, "CALL"), ("s2", 1, 3, "CFG"), ("s3", 1, 4, None)], "site_id string, caller int, callee int, kind string")
    overrides = frame([(2, 5, False)], "base int, impl int, abstract boolean")
    sites = frame([("s1", 1, "f")], "site_id string, method int, field string")
    none = lambda kind: frame([], kind)
    before = shuffle_files(spark)
    got = structure.site_graph(
        calls, overrides, sites, sites, none("site_id string, index int"), none("site_id string, type_name string"), none("method int, site_id string"),
        frame([("a", "b"), ("a", "b")], "left string, right string"), frame([("s2", "3"), ("c", "d")], "left string, right string"))
    assert not left_behind(spark, before)
    assert sorted(map(tuple, got.collect()), key=str) == sorted([
        ("CODEQL_CALL", "s1", "2", ""), ("CODEQL_VIRTUAL_DISPATCH", "s1", "5", ""), ("CODEQL_LOCAL_FLOW", "a", "b", ""), ("CODEQL_CFG", "s2", "3", ""),
        ("CODEQL_CFG", "c", "d", ""), (None, "s3", "4", "")], key=str)
    pairs = frame([(1, 1), (1, 2), (2, 3), (4, 5), (1, 6)], "left int, right int")
    before = shuffle_files(spark)
    met = structure.meeting(
        pairs, frame([(1, 2, "FIELD_STATE")], "left int, right int, kind string"), frame([("x", 2), ("x", 3)], "site_id string, impl int"),
        frame([(4, "c"), (5, "c"), (1, "d"), (6, "e")], "method int, type_name string"))
    assert not left_behind(spark, before)
    assert sorted(map(tuple, met.collect())) == [(1, 1, "intra_method_hop"), (1, 2, "field_state_bridge"), (1, 6, None), (2, 3, "cha_poly_bridge"), (4, 5, "shared_class_hop")]


def test_parts_of_static_paths_cut_no_position(spark, monkeypatch):
    from types import SimpleNamespace

    from pathloom.plans import graph_queries as gq

    rng = random.Random(4)
    site = lambda n: [(f"{n}{k}", rng.randrange(6), rng.randrange(2)) for k in range(14)]
    inputs, effects = site("i"), site("e")
    pairs = {(a, b): rng.randrange(4) for a in range(6) for b in range(6) if rng.random() < 0.6}
    frame = spark.createDataFrame
    t = SimpleNamespace(
        inputs=frame(inputs, "input_id string, method int, line int"), effects=frame(effects, "effect_id string, method int, line int"),
        methods=frame([(m, f"p{m % 2}") for m in range(6)], "method int, project string"))
    monkeypatch.setattr(gq, "gate_methods", lambda t: frame([(a, b, d) for (a, b), d in pairs.items()], "input int, effect int, gate_distance int"))
    monkeypatch.setattr(gq, "AT_ONCE", 8)
    before = shuffle_files(spark)
    got = gq.in_parts(t, lambda best: best.select(*gq.P.PATH_KEY, "candidate_path_id"))
    assert not left_behind(spark, before)
    want = {}
    for i, m, x in inputs:
        for e, n, y in effects:
            if (m, n) in pairs:
                key = (f"p{m % 2}", f"M{m}", x, f"M{n}", y)
                want[key] = min(want.get(key, "t"), f"st-{i}-{e}")
    assert {tuple(r)[:5]: r.candidate_path_id for r in got.collect()} == want and got.count() == len(want)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Relation") > 1
