"""Functions on qualified names and paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def prefix_of(fqn: Column) -> Column:
    """The name before its parameters."""
    return F.split_part(fqn, F.lit("("), F.lit(1))


def type_part(fqn: Column) -> Column:
    """What stands before the first ``#``."""
    return F.split_part(fqn, F.lit("#"), F.lit(1))


def member_name(fqn: Column) -> Column:
    """The member behind the first ``#``, without parameters; null if there is none."""
    return F.when(fqn.contains("#"), prefix_of(F.regexp_replace(fqn, "^[^#]*#", "")))


def simple_key(fqn: Column) -> Column:
    """``Type#member`` without package, or ``Type``."""
    return F.concat(last_segment(type_part(fqn)), F.coalesce(F.concat(F.lit("#"), member_name(fqn)), F.lit("")))


def package_of(fqn: Column) -> Column:
    """What stands before the last ``::`` of the type, else before its last dot, else nothing."""
    t = type_part(fqn)
    return F.when(t.contains("::"), F.regexp_extract(t, "^(.*)::", 1)).when(t.contains("."), F.regexp_extract(t, r"^(.*)\.", 1)).otherwise(F.lit(""))


def graphql_coordinate(fqn: Column) -> Column:
    """The schema coordinate of ``graphql:module:Type.field`` or ``graphql:Type.field``; null for other names."""
    return F.when(fqn.startswith("graphql:"), F.regexp_replace(fqn, "^(?:graphql:)(?:.*:)?", ""))


def graphql_module(fqn: Column) -> Column:
    """The module of a namespaced coordinate, else null."""
    return F.when(fqn.rlike("^graphql:.*:"), F.regexp_extract(fqn, "^graphql:(.*):", 1))


def last_segment(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, "^.*::", ""), r"^.*\.", "")


def subject_prefixes(fqn: Column) -> Column:
    """A name and every ancestor, cut at a run of ``: . # / (``."""
    pieces = F.regexp_extract_all(fqn, F.lit("[:.#/(]*[^:.#/(]+"), F.lit(0))
    return F.transform(F.sequence(F.lit(1), F.size(pieces)), lambda i: F.array_join(F.slice(pieces, 1, i), ""))


def fqn_shape(fqn: Column) -> Column:
    """Without generics, however deep, and then without parameters."""
    start = F.struct(F.lit(0).alias("depth"), F.array().cast("array<string>").alias("kept"))

    def step(acc: Column, piece: Column) -> Column:
        depth = F.when(piece == "<", acc["depth"] + 1).when(piece == ">", F.greatest(acc["depth"] - 1, F.lit(0))).otherwise(acc["depth"])
        keep = (acc["depth"] == 0) & ~piece.isin("<", ">")
        return F.struct(depth.alias("depth"), F.when(keep, F.array_append(acc["kept"], piece)).otherwise(acc["kept"]).alias("kept"))

    pieces = F.regexp_extract_all(fqn, F.lit("[<>]|[^<>]+"), F.lit(0))
    return prefix_of(F.aggregate(pieces, start, step, lambda acc: F.array_join(acc["kept"], "")))


def name_tokens(name: Column) -> Column:
    """Words of a camel-case or snake-case name, an acronym as one, in lower case."""
    parts = F.regexp_extract_all(name, F.lit("[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z0-9]+|[A-Z]+"), F.lit(0))
    return F.transform(parts, lambda x: F.lower(x))


def terms(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-|-$", "")


def label_slug(label: Column) -> Column:
    """Letters and digits in lower case with one hyphen between runs, at most 60 signs before hyphens at the ends go."""
    runs = F.regexp_replace(F.regexp_replace(label, "[^A-Za-z0-9]+", "-"), "^-", "")
    return F.regexp_replace(F.substring(F.lower(runs), 1, 60), "-+$", "")


def slugify(text: Column) -> Column:
    """Every sign but letters and digits as a hyphen, ASCII letters in lower case, no hyphens at the ends."""
    plain = F.translate(F.regexp_replace(text, r"[^\p{L}\p{N}]", "-"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_replace(plain, "^-+|-+$", "")


def seed_segment(fqn: Column) -> Column:
    """The last segment of the member if there is one, else of the name, without parameters."""
    return last_segment(prefix_of(F.regexp_replace(fqn, "^.*#", "")))


def module_of(path: Column) -> Column:
    """The path before ``/src/``."""
    return F.when(F.contains(path, F.lit("/src/")), F.split_part(path, F.lit("/src/"), F.lit(1))).otherwise(F.lit(""))


def script_module(path: Column) -> Column:
    """The path of a TypeScript or JavaScript file without its extension."""
    return F.regexp_replace(path, r"\.(?:tsx|ts|mts|cts|jsx|js|mjs|cjs)$", "")


def python_module(path: Column) -> Column:
    """The dotted module of a Python file; ``src`` and ``__init__`` are no parts of it."""
    bare = F.regexp_replace(F.regexp_replace(path, r"^\./", ""), r"\.py$", "")
    return F.array_join(F.filter(F.split(bare, "/"), lambda x: ~x.isin("", "__init__", "src")), ".")


def component(fqn: Column, parent_fqn: Column) -> Column:
    """The last dotted part of the owner, or of the name where there is none."""
    return F.element_at(F.split(F.coalesce(parent_fqn, fqn), "[.]"), -1)


# The namespaces of fact keys.
NAMESPACES = ("arch", "constraint", "convention", "decision", "discovery", "failure", "incident", "invariant", "pattern", "risk")


def namespace_of(key: Column) -> Column:
    return F.when(key.contains("."), F.split_part(key, F.lit("."), F.lit(1))).otherwise("other")


def check_key(key: Column) -> Column:
    """Why a fact key is refused, or null."""
    space, rest = namespace_of(key), F.regexp_replace(key, r"^[^.]*\.", "")
    return F.when(~key.contains("."), "no namespace").when(rest == "", "only a namespace").when(space == "task", "task is no namespace").when(~space.isin(*NAMESPACES), "unknown namespace")


def route_of(decorator: Column) -> tuple[Column, Column]:
    """Verb and path of a route decorator, nulls for others."""
    d = F.regexp_replace(decorator, "^@+", "")
    verb = F.upper(F.regexp_extract(d, r"^(?:[^(]*\.)?([^(.]*)\(", 1))
    path = F.regexp_extract(d, "^[^(]*\\(\\s*[\"']*([^\"']*)", 1)
    ok = verb.isin("GET", "POST", "PUT", "PATCH", "DELETE", "HEAD", "OPTIONS", "ROUTE") & path.startswith("/")
    return F.when(ok, verb), F.when(ok, path)


def reason_class(reason: Column) -> Column:
    c = F.when(reason.startswith("selected"), "selected").when(reason.contains("budget exhausted"), "budget exhausted").when(reason.contains("below floor"), "below floor")
    return c.when(reason.contains("at most"), "component cap").when(reason.contains("anchor"), "no anchor").otherwise("other")


def extract_version(line: Column) -> Column:
    """The first run of digits and dots that starts with a digit and has a dot, or such a run at the end whatever it starts with; without dots at its end."""
    inner = F.regexp_extract(line, r"(?:^|[^0-9.])([0-9]+\.[0-9.]*)[^0-9.]", 1)
    tail = F.regexp_extract(line, r"(?:^|[^0-9.])([0-9]*\.[0-9.]*)$", 1)
    best = F.when(inner != "", inner).when(tail != "", tail)
    return F.regexp_replace(best, r"\.+$", "")


def is_test(path: Column, fqn: Column) -> Column:
    """Whether a symbol is test code, by five forms of paths and three of names."""
    by_path = path.contains("/test/") | path.contains("/tests/") | path.endswith(".test.ts") | path.endswith(".test.tsx") | path.endswith(".spec.ts")
    return by_path | fqn.contains("Test#") | fqn.endswith("Test") | fqn.endswith("Tests")


def is_frontend(path: Column) -> Column:
    return path.endswith(".ts") | path.endswith(".tsx") | path.endswith(".jsx") | path.endswith(".js")


def estimate_tokens(text: Column) -> Column:
    return F.ceil(F.octet_length(text) / 3.5).cast("long")


def content_hash(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 32)
