"""Text redaction, size rollups and path rules over tables of named contents.

Items are rows ``(name, content)``; everything is a projection, a filter, a
broadcast/anti join or a ``groupBy`` -- no per-item Python.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# --- fixed values -----------------------------------------------------------
DEFAULT_REPLACEMENT = "***REMOVED***"
RULE_SEPARATOR = "==>"
BINARY_SNIFF_BYTES = 8192
# --- end of fixed values ----------------------------------------------------


_GLOB_PART = re.compile(r"(?P<run>\*)|(?P<one>\?)|\[(?P<not>!?)(?P<chars>\]?[^\]]*)\]|(?P<plain>.)", re.DOTALL)


def glob_to_regex(glob: str) -> str:
    """Shell glob -> regex body (``*`` any run, ``?`` one char, ``[...]``/``[!...]`` classes)."""
    def part(m: re.Match) -> str:
        if m["run"] or m["one"]:
            return ".*" if m["run"] else "."
        if m["plain"]:
            return m["plain"] if m["plain"].isalnum() or m["plain"] == " " else re.escape(m["plain"])
        return "[" + ("^" if m["not"] else "") + re.sub(r"([\\\[\]^&~])", r"\\\1", m["chars"]) + "]"
    return "(?s)" + _GLOB_PART.sub(part, glob)


# What a rule's kind makes of its pattern: (is it a regex, translation).
RULE_KINDS = {"literal": (False, str), "regex": (True, str), "glob": (True, glob_to_regex)}
_RULE = re.compile(f"(?:({'|'.join(RULE_KINDS)}):(?=.))?(.+)", re.DOTALL)


def parse_rules(lines) -> tuple[list, list]:
    """Replacement rules -> ``(literals, regexes)`` lists of ``(pattern, replacement)``.

    A line is ``[kind:]pattern[==>replacement]``; the kind is literal (default),
    regex or glob, the last ``==>`` counts, and the default replacement is
    ``***REMOVED***``. A kind without a pattern is literal text; lines without
    any pattern are skipped.
    """
    made: tuple[list, list] = ([], [])
    for line in lines:
        what, arrow, replacement = line.rstrip("\r\n").rpartition(RULE_SEPARATOR)
        m = _RULE.fullmatch(what if arrow else replacement)
        if m:
            is_regex, translate = RULE_KINDS[m[1] or "literal"]
            made[is_regex].append((translate(m[2]), replacement if arrow else DEFAULT_REPLACEMENT))
    return made


def _java_replacement(repl: str) -> str:
    """Python-style backreferences (``\\1``, ``\\g<1>``) -> Java ``$1``; other ``$``/``\\`` escaped."""
    out, i = [], 0
    while i < len(repl):
        m = re.match(r"\\g<(\d+)>|\\(\d)", repl[i:])
        if m:
            out.append("$" + (m.group(1) or m.group(2)))
            i += m.end()
            continue
        c = repl[i]
        out.append("\\" + c if c in "$\\" else c)
        i += 1
    return "".join(out)


def is_binary(c: Column) -> Column:
    """A NUL byte within the first 8 KB."""
    before = F.substring_index(c, "\x00", 1)
    return F.contains(c, F.lit("\x00")) & (F.octet_length(before) < BINARY_SNIFF_BYTES)


def redact(c, rules) -> Column:
    """G1: all literal rules in order, then all regex/glob rules in order; binary texts untouched."""
    x = F.col(c) if isinstance(c, str) else c
    literals, regexes = parse_rules(rules)
    y = x
    for pat, repl in literals:
        y = F.replace(y, F.lit(pat), F.lit(repl))
    for pat, repl in regexes:
        y = F.regexp_replace(y, pat, _java_replacement(repl))
    return F.when(is_binary(x), x).otherwise(y)


def strip_items(df: DataFrame, content: str, max_bytes: int | None = None, ids: DataFrame | None = None,
                id_col: str = "doc_id") -> DataFrame:
    """Drop items larger than ``max_bytes`` (UTF-8) or whose id is listed in ``ids``."""
    d = df
    if max_bytes is not None:
        d = d.filter(F.octet_length(content) <= max_bytes)
    if ids is not None:
        d = d.join(ids.select(id_col).distinct(), id_col, "left_anti")
    return d


def extension(name: Column) -> Column:
    """Extension of the last path component ('' when none; leading dots do not count)."""
    base = F.regexp_extract(name, "([^/]*)$", 1)
    return F.regexp_extract(base, "^\\.*[^.].*(\\.[^.]*)$", 1)


def ancestors(name: Column) -> Column:
    """Every ancestor directory of a path once, including the root '' (also that of a leading slash)."""
    parts = F.split(name, "/")
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))),
                        lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    return F.array_distinct(F.concat(F.array(F.lit("")), F.when(F.size(parts) > 1, above).otherwise(F.array(F.lit("")))))


def size_rollup(df: DataFrame, name: str = "name", size: str = "size") -> DataFrame:
    """Total size per path, per extension and per ancestor directory.

    ``(kind, key, size, n)`` with kind in path/extension/directory; one
    expand (``explode``) per item and one partial aggregation.
    """
    nm = F.col(name)
    keys = F.array(
        F.struct(F.lit("path").alias("kind"), nm.alias("key")),
        F.struct(F.lit("extension").alias("kind"), extension(nm).alias("key")))
    dirs = F.transform(ancestors(nm), lambda d: F.struct(F.lit("directory").alias("kind"), d.alias("key")))
    ex = df.select(F.explode(F.concat(keys, dirs)).alias("k"), F.col(size).alias("_s"))
    return ex.groupBy("k.kind", "k.key").agg(F.sum("_s").cast("bigint").alias("size"),
                                             F.count(F.lit(1)).alias("n"))


def sorted_rollup(rollup: DataFrame) -> DataFrame:
    """G3 report order: size descending, then key descending."""
    return rollup.orderBy(F.col("size").desc(), F.col("key").desc())


def deleted_since(df: DataFrame, name: str = "name", deleted: str = "deleted_at") -> DataFrame:
    """Per extension, NULL if any member is still present, else the latest deletion."""
    return df.groupBy(extension(F.col(name)).alias("extension")).agg(
        F.when(F.count(F.lit(1)) == F.count(deleted), F.max(deleted)).alias("deleted_since"))


def content_groups(df: DataFrame, name: str, content: str) -> DataFrame:
    """``(content_id, name, size, n_names)`` -- every name holding each content.

    Long form instead of one collected list per content: a content shared by a
    third of all rows never becomes a single huge array. Counts come from a
    partial aggregate joined back (AQE splits a skewed key).
    """
    d = df.select(F.md5(F.col(content)).alias("content_id"), F.col(name).cast("string").alias("name"),
                  F.octet_length(content).cast("bigint").alias("size"))
    counts = d.groupBy("content_id").agg(F.count(F.lit(1)).alias("n_names"))
    return d.join(counts, "content_id")


def sorted_groups(groups: DataFrame) -> DataFrame:
    """G5 report order: contents with the largest total size first."""
    return groups.orderBy((F.col("size") * F.col("n_names")).desc(), "content_id", "name")


def path_matches(name: Column, prefix: str) -> Column:
    """The path equals ``prefix`` or lies below it (prefix with or without trailing '/'); '' matches all."""
    return (name == prefix) | name.startswith(prefix.rstrip("/") + "/") if prefix else F.lit(True)


def renamed(name: Column, changes) -> Column:
    """Apply renames in the given order: ``("prefix", old, new)`` or ``("regex", pattern, replacement)``."""
    for kind, old, new in changes:
        if kind == "prefix":
            name = F.when(path_matches(name, old), F.concat(F.lit(new), F.substring(name, len(old) + 1, 1 << 30))).otherwise(name)
        elif kind == "regex":
            name = F.regexp_replace(name, old, _java_replacement(new))
        else:
            raise ValueError(f"unknown rename: {kind}")
    return name


def select_paths(df: DataFrame, name: str = "name", match=(), glob=(), regex=(), invert: bool = False,
                 renames=(), regex_renames=(), changes=(), base_name: bool = False) -> DataFrame:
    """Keep paths matching any rule (or none, with ``invert``), then rename.

    ``changes`` is one ordered list of mixed renames (see :func:`renamed`); as a
    short form, ``renames`` are ``(old_prefix, new_prefix)`` and
    ``regex_renames`` ``(pattern, replacement)``, applied before it. With
    ``base_name`` the rules see the last component of the path only, and
    renames aren't allowed.
    """
    steps = [("prefix", *x) for x in renames] + [("regex", *x) for x in regex_renames] + list(changes)
    if base_name and steps:
        raise ValueError("base_name can't be combined with renames")
    seen = F.element_at(F.split(F.col(name), "/"), -1) if base_name else F.col(name)
    wanted = F.lit(False)
    for rule in ([path_matches(seen, m) for m in match] + [seen.rlike(r) for r in regex]
                 + [seen.rlike("^(?:" + glob_to_regex(g) + ")$") for g in glob]):
        wanted = wanted | rule
    return df.filter(~wanted if invert else wanted).withColumn(name, renamed(F.col(name), steps))
