"""Column expressions: paths, identities, spans and small parsers. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body uses it."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def _segments(path: Column, drop: tuple[str, ...] = ("", ".")) -> Column:
    return F.filter(F.split(path, "/"), lambda p: ~p.isin(*drop))


def normalise_path(path: Column) -> Column:
    """Decode, strip ``file:`` and host slashes, resolve ``.`` and ``..``, lower-case."""
    raw = F.trim(path.cast("string"))
    decoded = F.when(raw.contains("%"), F.coalesce(F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B"))), raw)).otherwise(raw)
    strip = lambda t: F.regexp_replace(F.regexp_replace(t, "(?i)^file:(//)?", ""), r"[?#].*$", "")
    body = let(F.translate(decoded, "\\", "/"), lambda t: F.when(F.lower(t).startswith("file:"), strip(t)).otherwise(t))
    collapsed = F.aggregate(
        _segments(body),
        F.array().cast("array<string>"),
        lambda acc, p: F.when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(
            F.concat(acc, F.array(p))
        ),
    )
    return F.lower(F.array_join(collapsed, "/"))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def same_file(left: Column, right: Column) -> Column:
    """Both already normalised: equal, or one is a ``/``-suffix of the other."""
    filled = (F.length(left) > 0) & (F.length(right) > 0)
    return filled & (
        (left == right)
        | left.endswith(F.concat(F.lit("/"), right))
        | right.endswith(F.concat(F.lit("/"), left))
    )


def repo_path(path: Column) -> Column:
    """Canonical relative path, or NULL when empty, absolute, drive-rooted or holding ``..``."""

    def canonical(text: Column) -> Column:
        rooted = (text == "") | text.startswith("/") | text.rlike("^[A-Za-z]:")
        return F.when(~rooted, let(_segments(text), lambda parts: F.when(
            (F.size(parts) > 0) & ~F.array_contains(parts, ".."), F.array_join(parts, "/"))))

    return let(F.translate(F.trim(path), "\\", "/"), canonical)


def relativise(path: Column, root: Column) -> Column:
    """Report path against ``root``: absolute paths outside it, and escapes, give NULL."""
    base = F.regexp_replace(F.translate(root, "\\", "/"), "/+$", "")
    inner = lambda t: F.when(t.startswith(F.concat(base, F.lit("/"))), t.substr(F.length(base) + 2, F.length(t))).otherwise(t)
    return repo_path(let(F.regexp_replace(F.translate(path, "\\", "/"), "^file://", ""), inner))


def _without_dots(path: Column) -> Column:
    """Dot segments of a url path resolved; a path that ends in one keeps its closing slash."""
    parts = F.split(path, "/")
    closed = F.element_at(parts, -1).isin(".", "..")
    rooted = path.startswith("/")
    kept = F.aggregate(
        F.filter(parts, lambda p, i: (i > 0) | (p != "")), F.array().cast("array<string>"),
        lambda acc, p: F.when(p == ".", acc).when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p))))
    return F.concat(F.when(rooted, "/").otherwise(""), F.array_join(kept, "/"), F.when(closed & (F.size(kept) > 0), "/").otherwise(""))


def url_join(base: Column, ref: Column) -> Column:
    """``ref`` seen from ``base``, as relative references resolve; an empty side gives the other."""
    origin = r"^((?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?)"
    front, path = F.regexp_extract(base, origin, 1), F.regexp_extract(base, origin + "([^?#]*)", 2)
    folder = F.regexp_extract(path, "^(.*/)", 1)
    rest = F.regexp_extract(ref, r"^[^?#]*([?#].*)?$", 1)
    plain = F.regexp_extract(ref, r"^([^?#]*)", 1)
    merged = F.when(plain.startswith("/"), plain).otherwise(F.concat(F.when((front.endswith("/") | front.contains("//")) & (folder == ""), "/").otherwise(folder), plain))
    return (
        F.when(F.coalesce(base, F.lit("")) == "", ref).when(ref == "", base).when(ref.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), ref)
        .when(ref.startswith("//"), F.concat(F.regexp_extract(base, "^([A-Za-z][A-Za-z0-9+.-]*:)", 1), ref))
        .otherwise(F.concat(front, _without_dots(merged), rest)))


def canonical_json(fields: dict[str, Column]) -> Column:
    """Compact JSON with sorted keys; nulls are written out."""
    ordered = [fields[k].alias(k) for k in sorted(fields)]
    return F.to_json(F.struct(*ordered), {"ignoreNullFields": "false"})


def stable_id(prefix: str, fields: dict[str, Column], width: int = 24) -> Column:
    digest = F.sha2(canonical_json(fields), 256)
    return F.concat(F.lit(prefix + "-"), F.substring(digest, 1, width))


def safe_name(text: Column) -> Column:
    cleaned = F.btrim(F.regexp_replace(text, "[^A-Za-z0-9_.-]+", "_"), F.lit("._"))
    return F.coalesce(F.nullif(cleaned, F.lit("")), F.lit("project"))


def interval_distance(line: Column, start: Column, end: Column) -> Column:
    return F.greatest(start - line, line - end, F.lit(0))


def line_bucket(distance: Column) -> Column:
    return (
        F.when(distance == 0, "0").when(distance <= 5, "1-5").when(distance <= 20, "6-20")
        .when(distance <= 100, "21-100").otherwise(">100")
    )


def distance_bucket(value: Column) -> Column:
    number = F.expr("1") * value.try_cast("int")
    return F.when(number.isNull() | (number < 0), "UNKNOWN").when(number >= 3, "3+").otherwise(number.cast("string"))


def find_value(schema: T.StructType, key: str, default: str | None = None) -> Column:
    """First value of ``key`` at any depth of a nested record, found from the schema, depth first."""

    def walk(dtype: T.DataType, col: Column) -> list[Column]:
        if isinstance(dtype, T.ArrayType):
            if not isinstance(dtype.elementType, (T.StructType, T.ArrayType)):
                return []
            picks = F.transform(col, lambda x: F.coalesce(*walk(dtype.elementType, x), F.lit(None)).cast("string"))
            return [F.try_element_at(F.filter(picks, lambda v: v.isNotNull()), F.lit(1))]
        if not isinstance(dtype, T.StructType):
            return []
        if key in dtype.fieldNames():
            return [col[key].cast("string")]
        return [hit for f in dtype.fields for hit in walk(f.dataType, col[f.name])]

    hits = [F.col(key).cast("string")] if key in schema.fieldNames() else [
        hit for f in schema.fields for hit in walk(f.dataType, F.col(f.name))
    ]
    return F.coalesce(*hits, F.lit(default)) if hits else F.lit(default)


def optional_int(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit("")).try_cast("int")


def rate(num: Column, den: Column) -> Column:
    """NULL when the denominator is zero: not evaluable."""
    return F.round(F.try_divide(num.cast("double"), den.cast("double")), 6)


def callable_id(type_name: Column, name: Column, params: Column) -> Column:
    return F.concat(type_name, F.lit("."), name, F.lit("/"), params.cast("string"))


def call_id(callee: Column, params: Column, file: Column, line: Column) -> Column:
    return F.concat(callee, F.lit("/"), params.cast("string"), F.lit("@"), file, F.lit(":"), line.cast("string"))


def parameter_entity(callable_: Column, name: Column) -> Column:
    return F.concat(callable_, F.lit(" parameter "), name)


def param_list(signature: Column) -> Column:
    """Top-level parameters of ``name(T a, Map<K,V> b)``; commas inside ``<>``, ``[]`` or ``()`` do not split."""
    body = F.regexp_extract(signature, r"^[^(]*\((.*)\)[^)]*$", 1)
    depth_step = lambda c: F.when(c.isin("<", "[", "("), 1).when(c.isin(">", "]", ")"), -1).otherwise(0)
    marked = F.aggregate(
        F.split(body, ""),
        F.struct(F.lit(0).alias("depth"), F.lit("").alias("text")),
        lambda acc, c: F.struct(
            F.greatest(acc["depth"] + depth_step(c), F.lit(0)).alias("depth"),
            F.concat(acc["text"], F.when((c == ",") & (acc["depth"] == 0), F.lit("\u0001")).otherwise(c)).alias("text"),
        ),
    )["text"]
    parts = F.transform(F.split(marked, "\u0001"), lambda p: F.trim(p))
    return F.filter(parts, lambda p: p != "")


def param_count(signature: Column) -> Column:
    return F.size(param_list(signature))


def compact_type(text: Column) -> Column:
    return F.regexp_replace(text, r"\s+", "")


def erase_type(text: Column) -> Column:
    """Innermost generics and package qualifiers removed from compacted type text."""
    return F.regexp_replace(F.regexp_replace(compact_type(text), "<[^<>]*>", ""), r"\b(?:[a-zA-Z_$][\w$]*\.)+", "")


def snippet(text: Column, limit: int = 500) -> Column:
    value = F.regexp_replace(text, r"^\s+|\s+$", "")
    return F.when(F.length(value) > limit, F.concat(F.substring(value, 1, limit - 1), F.lit("…"))).otherwise(value)


def micros(usd: Column) -> Column:
    return F.ceil(usd.cast("string").cast("decimal(28,10)") * F.lit(1_000_000)).cast("long")


def module_of(path: Column) -> Column:
    """Part before the first ``/src/``; NULL without one."""
    rooted = F.concat(F.lit("/"), path)
    return F.when(F.instr(rooted, "/src/") > 0, F.substring_index(rooted, "/src/", 1))


def package_of(path: Column) -> Column:
    """Directory below the ``java`` source root, as a dotted name."""
    inner = F.regexp_extract(F.concat(F.lit("/"), path), r"/src/(?:main|test)/java/(.*)/[^/]+$", 1)
    return F.translate(inner, "/", ".")


def cwe_ids(text: Column) -> Column:
    """Sorted distinct ``CWE-n`` names in a tag or message text."""
    numbers = F.regexp_extract_all(F.lower(text), F.lit(r"cwe[-/]0*(\d+)"), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(numbers, lambda n: F.concat(F.lit("CWE-"), n.cast("bigint").cast("string")))))


def cwe_norm(tag: Column) -> Column:
    return F.try_element_at(cwe_ids(tag), F.lit(1))


def truthy(text: Column) -> Column:
    return F.coalesce(F.lower(F.trim(text)).isin("1", "true", "yes", "y"), F.lit(False))


def flow_type(kind: Column, name: Column, type_name: Column) -> Column:
    text = F.lower(F.concat_ws(" ", name, F.coalesce(type_name, F.lit(""))))
    return (
        F.when(kind == "CONSTRUCTOR", "LIBRARY_FLOW")
        .when(text.rlike("handle|startelement|authenticate|callback|listener"), "CALLBACK_RELATION")
        .when(text.rlike("filter|validator|parser|controller|framework"), "FRAMEWORK_RELATION")
        .otherwise("LIBRARY_FLOW")
    )


def wall_seconds(start: Column, end: Column) -> Column:
    """Seconds between two ISO-8601 strings, three decimals; NULL when either does not parse."""
    at = lambda c: F.unix_micros(F.try_to_timestamp(c))
    return F.round((at(end) - at(start)) / 1_000_000, 3)


# Directory names and file-name marks of test code.
TEST_DIRECTORIES = ("test", "tests", "testing", "testfixtures", "buildsrc", "build-logic")
TEST_MARKS = "testcase|mock|harness"


def is_test_path(path: Column) -> Column:
    parts = F.split(F.lower(path), "/")
    stem = F.regexp_replace(basename(F.lower(path)), r"\.java$", "")
    return (
        F.arrays_overlap(parts, F.array(*[F.lit(d) for d in TEST_DIRECTORIES]))
        | stem.rlike("tests?$")
        | F.exists(parts, lambda p: p.rlike(TEST_MARKS))
    )
