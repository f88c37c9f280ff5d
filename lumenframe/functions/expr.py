"""Column builders for the scalar rules of manifests and scores."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def lit_or_col(x: Column | str | float) -> Column:
    return x if isinstance(x, Column) else (F.col(x) if isinstance(x, str) else F.lit(x))


def clamp01(v: Column) -> Column:
    """Between 0 and 1; NaN is 0 and null stays null."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.nanvl(v.cast("double"), F.lit(0.0))))


def bare_clamp01(v: Column) -> Column:
    """Between 0 and 1, where NaN counts as large."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), v.cast("double")))


def score_from_error(error: Column, scale: float) -> Column:
    """1 at no error, falling exponentially."""
    return clamp01(F.exp(-error / F.lit(max(scale, 1e-8))))


def safe_float(v: Column) -> Column:
    """A number from text: null for null, empty, other text and NaN; infinities stay."""
    number = v.try_cast("double")
    return F.when(~F.isnan(number), number)


def finite(v: Column) -> Column:
    """Whether a number is neither null, NaN nor infinite."""
    return F.coalesce(~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))), F.lit(False))


def round_or_blank(v: Column, digits: int = 4) -> Column:
    """Text of the rounded number, empty where it isn't finite."""
    return F.when(finite(v), F.round(v, digits).cast("string")).otherwise("")


def or_else(*values: Column) -> Column:
    """The first text that is neither null nor empty."""
    return F.coalesce(*[F.nullif(v.cast("string"), F.lit("")) for v in values[:-1]], values[-1])


def first_match(text: Column, rules: Mapping[str, Sequence[str]], default: str = "unknown") -> Column:
    """Label of the first rule one of whose keys is in the lower-cased text."""
    low = F.lower(F.coalesce(text, F.lit("")))
    out = F.lit(default)
    for label, keys in reversed(list(rules.items())):
        hit = F.lit(False)
        for k in keys:
            hit = hit | low.contains(k)
        out = F.when(hit, F.lit(label)).otherwise(out)
    return out


def contains_any(text: Column, keys: Sequence[str]) -> Column:
    """Whether one of the keys is in the text, in the same case; null counts as empty."""
    out = F.lit(False)
    for k in keys:
        out = out | F.coalesce(text, F.lit("")).contains(k)
    return out


def stable_id(source: Column, path: Column) -> Column:
    """``source_`` and the first 12 hex digits of the path's SHA-1."""
    return F.concat(source, F.lit("_"), F.substring(F.sha1(path), 1, 12))


def pair_id(sample_id: Column, corruption: Column) -> Column:
    return F.concat(F.lit("pair_"), F.substring(F.sha1(F.concat(sample_id, corruption)), 1, 12))


def hash_fraction(text: Column) -> Column:
    """The first 32 bits of the SHA-1 as a fraction of the largest such number."""
    return F.conv(F.substring(F.sha1(text), 1, 8), 16, 10).cast("double") / F.lit(4294967295.0)


def seeded(key: Column, seed: int) -> Column:
    """A number of 48 bits drawn by the SHA-1 of seed and key, the same on any engine; a null key draws as an empty one."""
    return F.conv(F.substring(F.sha1(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))), 1, 12), 16, 10).cast("bigint")


def fingerprint(text: Column, digits: int = 16) -> Column:
    """The first hex digits of the SHA-256."""
    return F.substring(F.sha2(text, 256), 1, digits)


def ratio(text: Column) -> Column:
    """A number from ``a/b`` or ``a``; null for other text or a zero divisor."""
    parts = F.split(text, "/", 2)
    over = F.get(parts, F.lit(0)).try_cast("double")
    under = F.when(F.size(parts) > 1, F.get(parts, F.lit(1)).try_cast("double")).otherwise(F.lit(1.0))
    return F.try_divide(over, under)


def bool_from_text(v: Column) -> Column:
    """Truth from the usual words; other text is an error."""
    low = F.lower(F.trim(v))
    return F.when(v.isNull(), F.lit(None).cast("boolean")).when(low.isin("1", "true", "yes", "y", "on"), True).when(
        low.isin("0", "false", "no", "n", "off", ""), False).otherwise(F.raise_error(F.concat(F.lit("not a truth value: "), v)).cast("boolean"))


def eta_text(seconds: Column) -> Column:
    """``1h02m``, ``3m04s`` or ``5s``; ``unknown`` for null, negative and non-finite."""
    s = F.rint(F.when(finite(seconds), seconds).otherwise(0.0)).cast("bigint")
    h, m = F.floor(s / 3600).cast("bigint"), F.floor(F.pmod(s, F.lit(3600)) / 60).cast("bigint")
    text = F.when(h > 0, F.format_string("%dh%02dm", h, m)).when(m > 0, F.format_string("%dm%02ds", m, F.pmod(s, F.lit(60)))).otherwise(F.format_string("%ds", s))
    return F.when(~finite(seconds) | (seconds < 0), "unknown").otherwise(text)


def json_first(doc: Column, *paths: str) -> Column:
    """The first of several JSON paths that has a value, as text."""
    return F.coalesce(*[F.get_json_object(doc, p) for p in paths])


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent_name(path: Column, default: str = "TopLevel") -> Column:
    """Name of the folder that holds a relative path; ``default`` at the top."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.try_element_at(parts, F.lit(-2))).otherwise(default)


def resolve_path(root: Column | str, path: Column) -> Column:
    """Absolute paths stay, relative ones are put under the root, empty ones stay empty."""
    root = F.lit(root) if isinstance(root, str) else root
    return F.when((path == "") | path.startswith("/"), path).otherwise(F.concat_ws("/", F.rtrim(root, F.lit("/")), path))


def uri_scheme(uri: Column) -> Column:
    """``hdf5``, ``generated``, ``corruption`` or ``file``; null for null."""
    found = F.regexp_extract(uri, "^([a-z0-9]+)://", 1)
    return F.when(uri.isNotNull(), F.when(found == "", "file").otherwise(found))


def hdf5_file(uri: Column) -> Column:
    return F.nullif(F.regexp_extract(uri, "^hdf5://(.*?)::(.*)$", 1), F.lit(""))


def hdf5_key(uri: Column) -> Column:
    """What follows the first ``::``."""
    return F.nullif(F.regexp_extract(uri, "^hdf5://(.*?)::(.*)$", 2), F.lit(""))


def trajectory_prompt(name: Column) -> Column:
    """Words from a trajectory's name: no ``_trajectory`` at the end, nothing from ``__`` on, spaces for underscores."""
    stem = F.substring_index(F.regexp_replace(name, "_trajectory$", ""), "__", 1)
    return F.trim(F.translate(stem, "_", " "))


def camera_number(name: Column) -> Column:
    """The number in a camera's name, for sorting."""
    return F.regexp_extract(name, r"(\d+)", 1).try_cast("int")


def lookup(values: Mapping[str, str], key: Column, default: str) -> Column:
    """A value of a small fixed map."""
    table = F.create_map(*[F.lit(x) for kv in values.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.coalesce(key, F.lit(default))), F.lit(values[default]))


def comparison_folder(label: Column) -> Column:
    """Folder of a side-by-side comparison with the base model."""
    return F.when(F.lower(label).contains("stage2"), "base_vs_stage2").otherwise("base_vs_stage1")


def devices(visible: Column, n: Column | int = 0) -> Column:
    """The devices named between commas, else 0 to n - 1 (8 for n = 0); at most n where n is given, and none is an error."""
    n = n if isinstance(n, Column) else F.lit(n)
    named = F.filter(F.transform(F.split(F.coalesce(visible, F.lit("")), ","), lambda v: F.trim(v)), lambda v: v != "")
    numbers = F.transform(F.sequence(F.lit(0), F.when(n > 0, n - 1).otherwise(7)), lambda i: i.cast("string"))
    given = F.when(F.trim(F.coalesce(visible, F.lit(""))) != "", named).otherwise(numbers)
    cut = F.when(n > 0, F.slice(given, 1, n)).otherwise(given)
    return checked(cut, F.size(cut) > 0, "no device")


def camera_angle(meta: Column, default: float) -> Column:
    """The horizontal field of view that an archive's metadata gives, else ``default``."""
    return F.coalesce(F.get_json_object(meta, "$.camera_angle_x").try_cast("double"), F.lit(default))


def split_target(target: Column) -> Column:
    """entity and project of ``entity/project`` (no slash: project alone)."""
    parts = F.split(target, "/", 2)
    return F.when(F.size(parts) > 1, F.struct(F.get(parts, F.lit(0)).alias("entity"), F.get(parts, F.lit(1)).alias("project"))).otherwise(
        F.struct(F.lit(None).cast("string").alias("entity"), target.alias("project")))


def reference_candidates(root: Column, columns: Sequence[Column]) -> Column:
    """Candidate paths in order, each once: absolute ones as they are, others under the root; blanks go."""
    return F.array_distinct(F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit("")) != "", resolve_path(root, c)) for c in columns])))


def first_readable(candidates: Column, readable: Column) -> Column:
    """The first candidate in the array of readable paths, else the first candidate."""
    good = F.filter(candidates, lambda c: F.array_contains(readable, c))
    return F.coalesce(F.get(good, F.lit(0)), F.get(candidates, F.lit(0)))


def strip_prefixes(names: Column, prefixes: Sequence[str]) -> Column:
    """Keys of a map without the first of the prefixes that they have."""
    def bare(k: Column) -> Column:
        out = k
        for p in reversed(prefixes):
            out = F.when(k.startswith(p), F.substring(k, len(p) + 1, 1 << 20)).otherwise(out)
        return out

    return F.transform_keys(names, lambda k, _: bare(k))


def checked(value: Column, ok: Column, message: str | Column) -> Column:
    """The value; an error where ``ok`` doesn't hold.  (A check in a column of its own would be optimised away.)"""
    text = F.lit(message) if isinstance(message, str) else message
    return F.when(F.coalesce(ok, F.lit(False)), value).otherwise(F.raise_error(text))
