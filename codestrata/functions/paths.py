"""Column expressions over repository paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def plain_path(path: Column) -> Column:
    """One spelling per path: ``\\`` is read as ``/``, repeated ``/`` are one, leading ``./`` are dropped. Null stays null."""
    one = F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "/+", "/")
    odd = F.contains(path, F.lit("\\")) | F.contains(path, F.lit("//")) | F.startswith(path, F.lit("./"))
    return F.when(odd, F.regexp_replace(one, r"^(\./)+", "")).otherwise(path)


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent_dir(path: Column) -> Column:
    """Directory part, empty for a root file."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def lead_dirs(path: Column, depth: int = 2) -> Column:
    """First ``depth`` directories of a file's path; null for a root file."""
    dirs = F.slice(F.split(parent_dir(path), "/"), 1, depth)
    return F.when(parent_dir(path) != "", F.concat_ws("/", dirs))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(file_name(path), r"\.([^.]+)$", 1))


def path_prefixes(path: Column) -> Column:
    """Every ancestor directory of a file, root (empty string) included."""
    parts = F.split(parent_dir(path), "/")
    whole = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.concat_ws("/", F.slice(parts, 1, n)))
    return F.array_distinct(F.concat(F.array(F.lit("")), whole))


def join_relative(base_dir: Column, specifier: Column) -> Column:
    """Resolve ``.`` and ``..`` against a directory; ``..`` above the root is swallowed."""
    parts = F.filter(F.split(F.concat_ws("/", base_dir, specifier), "/"), lambda p: (p != "") & (p != "."))
    stack = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, p: F.when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array_append(acc, p)),
    )
    return F.concat_ws("/", stack)
