"""Column functions with the null rules of the contract."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def extract(c: Column | str, pattern: str, group: int = 1) -> Column:
    """A regex group, null where nothing matches."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def without_version(c: Column | str) -> Column:
    return F.split_part(c, F.lit("."), F.lit(1))


def reverse_complement(c: Column | str) -> Column:
    return F.translate(F.reverse(F.upper(c)), "ACGTN", "TGCAN")


def finite(c: Column) -> Column:
    """True only for numbers that are neither null, NaN nor infinite."""
    return F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))


def finite_or_null(c: Column) -> Column:
    return F.when(finite(c), c)


def all_known(names: Sequence[str]) -> Column:
    """All columns not null (NaN counts as known)."""
    out = F.lit(True)
    for n in names:
        out = out & F.col(n).isNotNull()
    return out


def any_true(names: Sequence[str]) -> Column:
    out = F.lit(False)
    for n in names:
        out = out | F.coalesce(F.col(n), F.lit(False))
    return out.cast("int")


def mean_of(columns: Sequence[Column]) -> Column:
    """Mean of the columns that are not null."""
    known = F.filter(F.array(*columns), lambda x: x.isNotNull())
    return F.try_divide(F.aggregate(known, F.lit(0.0), lambda a, x: a + x), F.size(known))


def replace_strict(c: Column, values: Mapping[str, object]) -> Column:
    """A literal map; an unknown value raises, null stays null."""
    pairs = [F.lit(x) for kv in values.items() for x in kv]
    found = F.create_map(*pairs)[c]
    return F.when(c.isNull(), None).when(found.isNull(), F.raise_error(F.concat(F.lit("unmapped_value: "), c))).otherwise(found)


def log_sum_exp(values: Column) -> Column:
    top = F.array_max(values)
    return top + F.log(F.aggregate(values, F.lit(0.0), lambda a, x: a + F.exp(x - top)))


def cosine(a: Column | str, b: Column | str) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def info_map(c: Column | str) -> Column:
    """``K=V;FLAG`` as a map; a flag has the value "true"; of repeated keys the last wins."""
    pairs = F.transform(F.split(c, ";"), lambda x: F.struct(F.split_part(x, F.lit("="), F.lit(1)).alias("k"), F.when(F.contains(x, F.lit("=")), F.regexp_extract(x, "^[^=]*=(.*)$", 1)).otherwise("true").alias("v")))
    pairs = F.filter(pairs, lambda x: x["k"] != "")
    last = F.filter(F.transform(pairs, lambda x, i: F.struct(x["k"].alias("k"), x["v"].alias("v"), i.alias("i"))), lambda x: ~F.exists(F.slice(pairs, x["i"] + 2, F.size(pairs)), lambda y: y["k"] == x["k"]))
    return F.map_from_entries(F.transform(last, lambda x: F.struct(x["k"], x["v"])))


def natural_chromosome(c: Column | str) -> Column:
    """Sort key: autosomes by number, then X, Y, M or MT, then others by name."""
    name = F.regexp_replace(c, "^chr", "")
    number = F.when(name.rlike("^[0-9]+$"), name.cast("int")).when(name == "X", 23).when(name == "Y", 24).when(name.isin("M", "MT"), 25)
    return F.struct(number.isNull().cast("int").alias("other"), F.coalesce(number, F.lit(0)).alias("number"), name.alias("name"))


def starting_with(df, *prefixes: str) -> list[str]:
    """Names of the columns that start with any prefix, in their order."""
    return [c for c in df.columns if c.startswith(prefixes)]


def ending_with(df, *suffixes: str) -> list[str]:
    return [c for c in df.columns if c.endswith(suffixes)]


def prefixed(df, prefix: str, keep: Sequence[str] = ()):
    """All columns but ``keep`` renamed to ``<prefix>_<name>``."""
    return df.withColumnsRenamed({c: f"{prefix}_{c}" for c in df.columns if c not in keep})


def only(df, column: str, value: str):
    """Rows with a value; ``all`` takes every row."""
    return df if value == "all" else df.where(F.col(column) == value)


def equal_to(df, **values):
    for k, v in values.items():
        df = df.where(F.col(k) == v)
    return df


def all_finite(names: Sequence[str]) -> Column:
    """All columns are numbers, neither null, NaN nor infinite."""
    out = F.lit(True)
    for n in names:
        out = out & finite(F.col(n))
    return out


def single(c: Column, n: int = 1) -> Column:
    """A string of one character (or ``n``); null is none."""
    return F.coalesce(F.length(c) == n, F.lit(False))


def autosome(c: Column) -> Column:
    return F.coalesce(c.rlike("^(chr)?([1-9]|1[0-9]|2[0-2])$"), F.lit(False))


def without_prefix(c: Column, prefix: str) -> Column:
    return F.when(F.startswith(c, F.lit(prefix)), F.substring(c, F.lit(len(prefix) + 1), F.length(c))).otherwise(c)


def replace_or(c: Column, values: Mapping[str, object], default: object, kind: str) -> Column:
    """A literal map with a default for any other value, null too."""
    pairs = [F.lit(x) for kv in values.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), c), F.lit(default)).cast(kind)


def key_value(c: Column, key: str, value: str) -> tuple[Column, Column]:
    """Both sides of the first ``=``, the right one URL-decoded; null without one."""
    parts = F.split(c, "=", 2)
    return F.get(parts, F.lit(0)).alias(key), F.try_url_decode(F.get(parts, F.lit(1))).alias(value)


def find_pairs(c: Column, pattern: str) -> Column:
    """All matches of a pattern with two groups as an array of (k, v)."""
    return F.zip_with(F.regexp_extract_all(c, F.lit(pattern), F.lit(1)), F.regexp_extract_all(c, F.lit(pattern), F.lit(2)), lambda k, v: F.struct(k.alias("k"), v.alias("v")))


def percent_change(a: Column, b: Column) -> Column:
    return F.try_divide(100 * (b - a), a)


def l2_norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def max_abs_difference(a: Column, b: Column) -> Column:
    return F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))))


def json_first(c: Column, *paths: str) -> Column:
    """The first path that a JSON text has."""
    return F.coalesce(*[F.get_json_object(c, p) for p in paths])


def feature_set_key(flags: Sequence[Column]) -> Column:
    """Sum of 2^i over the flags that are set."""
    out = F.lit(0).cast("long")
    for i, f in enumerate(flags):
        out = out + F.when(f, 1 << i).otherwise(0)
    return out


def log_odds(p: Column) -> Column:
    return F.log(F.try_divide(p, 1 - p))


def info_columns(df, info: str, limit: int = 200):
    """``K=V;FLAG`` texts as one column a key, in the keys' order; flags are "true".

    The keys of all rows are looked for first; more than ``limit`` of them raise.
    """
    rows = df.withColumn("__info", info_map(F.col(info)))
    keys = sorted(r[0] for r in rows.select(F.explode(F.map_keys("__info"))).distinct().limit(limit + 1).collect())
    if len(keys) > limit:
        raise ValueError(f"too_many_keys: over {limit}")
    return rows.select(*[c for c in df.columns if c != info], *[F.try_element_at("__info", F.lit(k)).alias(k) for k in keys])
