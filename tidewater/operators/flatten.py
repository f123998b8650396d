"""JSON text columns of any depth as flat columns."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.functions.missing import JSON_TOKENS, strip
from tidewater.functions.names import named, unused
from tidewater.session import checkpointed

#: Kinds of variant values that keep their type as a column; all other leaves, and mixtures, are text.
_TYPES = {"BIGINT": "bigint", "BOOLEAN": "boolean"}
#: Levels of an object that one pass looks into; what is nested deeper takes a pass over those objects alone.
LEVELS = 6
#: Keys that a path text can name.
_PLAIN = re.compile(r"[^'\"?\[\]\\]+")


def parse_object(c: Column) -> Column:
    """The variant of a JSON object; null for missing, malformed, or other JSON."""
    value = F.try_parse_json(F.when(~F.lower(strip(c)).isin(*JSON_TOKENS), strip(c)))
    return F.when(F.schema_of_variant(value).startswith("OBJECT"), value)


def _kind(v: Column) -> Column:
    return F.when(v.isNotNull(), F.regexp_replace(F.schema_of_variant(v), r"(?s)[<(].*", ""))


def discover_paths(df: DataFrame, column: str, max_paths: int = 10_000) -> dict[tuple[str, ...], set[str]]:
    """Kinds of the leaves under each path, over all rows and at any depth; the distinct paths come to the driver, not the rows.

    A pass looks into LEVELS levels. Only if objects lie deeper are those, and nothing else, written and looked into in turn. More
    than `max_paths` paths can't become columns and raise.
    """
    level = df.select(F.array().cast("array<string>").alias("path"), parse_object(named(column)).alias("v")).where("v IS NOT NULL")
    leaves: dict[tuple[str, ...], set[str]] = {}
    while True:
        inner = _opened(level)
        found = inner.select("path", "kind", "deeper").distinct().limit(max_paths + 1).collect()
        for row in found:
            if row["kind"] != "OBJECT":
                leaves.setdefault(tuple(row["path"]), set()).add(row["kind"])
        if len(found) > max_paths or len(leaves) > max_paths:
            raise ValueError(f"{column} has more than {max_paths} paths; give `paths`")
        if not any(row["deeper"] for row in found):
            return leaves
        level = checkpointed(inner.where("deeper").select("path", "v"))


def _opened(level: DataFrame) -> DataFrame:
    """(path, v, kind, deeper) of what objects hold: leaves, empty objects, and objects LEVELS down, which are deeper."""
    rows = level.select("path", F.col("v").alias("v0"), F.lit("OBJECT").alias("kind0"))
    for k in range(LEVELS):
        inside = F.when(F.col(f"kind{k}") == "OBJECT", F.col(f"v{k}"))
        held = level.sparkSession.tvf.variant_explode_outer(inside.outer()).select(F.col("key").alias(f"key{k + 1}"), F.col("value").alias(f"v{k + 1}"))
        rows = rows.lateralJoin(held).withColumn(f"kind{k + 1}", _kind(F.col(f"v{k + 1}")))
    back = range(LEVELS, -1, -1)
    return rows.select(
        F.concat("path", F.array_compact(F.array(*[f"key{k + 1}" for k in range(LEVELS)]))).alias("path"),
        F.col(f"v{LEVELS}").alias("v"),
        F.coalesce(*[f"kind{k}" for k in back]).alias("kind"),
        F.coalesce(F.col(f"kind{LEVELS}") == "OBJECT", F.lit(False)).alias("deeper"),
    )


def _at(v: Column, path: tuple[str, ...], kind: str) -> Column:
    """The value under a path as `kind`, null if it can't be. Keys that no path text can name are looked up in a map."""
    steps = ""
    for key in path:
        if _PLAIN.fullmatch(key):
            steps += f"['{key}']"
            continue
        inside = F.try_variant_get(v, "$" + steps, "map<string,variant>")
        v, steps = F.try_element_at(inside, F.lit(key)), ""
    return F.try_variant_get(v, "$" + steps, kind)


def _text_of(item: Column) -> Column:
    """An element of a list as text: as Python prints missing values and booleans."""
    kind = F.schema_of_variant(item)
    text = F.coalesce(F.try_variant_get(item, "$", "string"), F.to_json(item))
    return F.when(item.isNull() | (kind == "VOID"), "None").when(kind == "BOOLEAN", F.initcap(text)).otherwise(text)


def leaf(v: Column, path: tuple[str, ...], kinds: set[str]) -> Column:
    """The value under a path: of one type if all rows agree, else text; a list is its elements joined by comma and space."""
    known = kinds - {"VOID"}
    if len(known) == 1 and (kind := next(iter(known))) in _TYPES:
        return _at(v, path, _TYPES[kind])
    if known and known <= {"BIGINT", "DOUBLE", "DECIMAL", "FLOAT"}:
        return _at(v, path, "double")
    text = _at(v, path, "string")
    if "ARRAY" not in known:
        return text
    items = _at(v, path, "array<variant>")
    return F.when(items.isNotNull(), F.array_join(F.transform(items, _text_of), ", ")).otherwise(text)


def flatten_json(df: DataFrame, column: str = "user_metadata", prefix: str | None = None, paths: dict[tuple[str, ...], set[str]] | None = None) -> DataFrame:
    """`column` replaced by a column prefix_path for each leaf path, in the order of the paths; keys may be any text.

    Given `paths` (as from discover_paths), no pass over the data is needed, so it works on streams too. Where two paths make one
    name, the deeper one wins; where a name is there already, it gets a number.
    """
    leaves = discover_paths(df, column) if paths is None else paths
    names: dict[str, tuple[str, ...]] = {}
    for path in sorted(leaves, key=lambda p: (len(p), p)):
        names[f"{prefix or column}_{'_'.join(path)}"] = path
    (whole,) = unused(df, "object")
    parsed = df.withColumn(whole, parse_object(named(column)))
    taken = {n.lower() for n in df.columns if n != column}
    out = []
    for name in sorted(names):
        alias, k = name, 2
        while alias.lower() in taken:
            alias, k = f"{name}_{k}", k + 1
        taken.add(alias.lower())
        out.append(leaf(F.col(whole), names[name], leaves[names[name]]).alias(alias))
    return parsed.select(*[named(n) for n in df.columns if n != column], *out)
