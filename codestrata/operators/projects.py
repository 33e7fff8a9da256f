"""What project files say about imports: path aliases, packages, base folders, modules and crates.

``texts`` has ``scan_id, path, content`` (text) of the manifests of a scan, ``paths`` has ``scan_id, path`` of its files.
A scan has few manifests, so these tables are small beside the files; they are joined like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codestrata.functions.paths import file_name, join_relative, parent_dir
from codestrata.functions.text import crate_name
from codestrata.session import cut


def plain_json(text: Column) -> Column:
    """JSON without the comments and last commas that configuration files may have; strings stay as they are."""
    strings = r'("(?:[^"\\]|\\.)*+")'
    bare = F.regexp_replace(text, strings + r"|//[^\n]*|/\*(?s:.*?)\*/", "$1")
    return F.regexp_replace(bare, strings + r"|,(?=\s*[}\]])", "$1")


def _configs(texts: DataFrame) -> DataFrame:
    named = texts.where(file_name(F.col("path")).rlike(r"^tsconfig(\..*)?\.json$"))
    shape = "compilerOptions struct<baseUrl:string, paths:map<string,array<string>>>"
    read = named.select("scan_id", F.col("path").alias("source"), parent_dir(F.col("path")).alias("dir"), F.from_json(plain_json(F.col("content")), shape).alias("c"))
    said = read.select("scan_id", "source", "dir", F.coalesce("c.compilerOptions.baseUrl", F.lit("")).alias("base_url"), F.col("c.compilerOptions.paths").alias("paths"))
    return said.withColumn("base", F.when(F.col("base_url") == "", F.col("dir")).otherwise(join_relative(F.col("dir"), F.col("base_url"))))


def path_aliases(texts: DataFrame) -> DataFrame:
    """``scan_id, source, pattern, pos, prefix, suffix, wild, targets``: the ``paths`` of TypeScript configurations, targets below the base folder."""
    each = _configs(texts).where("paths is not null").select("scan_id", "source", "base", F.posexplode("paths").alias("pos", "pattern", "said")).where(F.size("said") > 0)
    wild = F.contains(F.col("pattern"), F.lit("*"))
    suffix = F.when(wild, F.expr("substring(pattern, length(substring_index(pattern, '*', 1)) + 2)")).otherwise("")
    placed = F.transform("said", lambda t: join_relative(F.col("base"), t))
    return each.select("scan_id", "source", "pattern", "pos", F.substring_index("pattern", "*", 1).alias("prefix"), suffix.alias("suffix"), wild.alias("wild"), placed.alias("targets"))


def base_urls(texts: DataFrame) -> DataFrame:
    """``scan_id, base``: folders that bare imports are looked for in."""
    return _configs(texts).where("base_url <> ''").select("scan_id", "base").distinct()


def node_packages(texts: DataFrame) -> DataFrame:
    """``scan_id, package, dir``: packages of a workspace by name; the package at the root is none."""
    named = texts.where(file_name(F.col("path")) == "package.json").select("scan_id", parent_dir(F.col("path")).alias("dir"), F.get_json_object(plain_json(F.col("content")), "$.name").alias("package"))
    return named.where("dir <> '' and package <> ''").groupBy("scan_id", "package").agg(F.min("dir").alias("dir"))


def go_modules(texts: DataFrame) -> DataFrame:
    """``scan_id, module, dir`` of ``go.mod`` files."""
    said = F.regexp_extract("content", r'(?m)^[ \t]*module[ \t]+"?([^\s"]+)', 1)
    return texts.where(file_name(F.col("path")) == "go.mod").select("scan_id", said.alias("module"), parent_dir(F.col("path")).alias("dir")).where("module <> ''")


def python_roots(paths: DataFrame) -> DataFrame:
    """``scan_id, root``: folders that absolute imports begin at: the root, ``src`` and ``lib`` where they hold files, and the parents of packages."""
    package = paths.where(file_name(F.col("path")) == "__init__.py").select("scan_id", parent_dir(parent_dir(F.col("path"))).alias("root"))
    marker = paths.where(F.col("path").rlike("^(src|lib)/")).select("scan_id", F.substring_index("path", "/", 1).alias("root"))
    return package.unionByName(marker).unionByName(paths.select("scan_id", F.lit("").alias("root"))).distinct()


def _cargo(texts: DataFrame) -> DataFrame:
    """``scan_id, dir, crate, bins`` of manifests with a package."""
    text = F.concat(F.lit("\n"), "content", F.lit("\n["))
    package = F.regexp_extract(text, r"\n[ \t]*\[package\][^\n]*\n((?s:.*?))\n[ \t]*\[", 1)
    name = F.regexp_extract(F.concat(F.lit("\n"), package), r"""\n[ \t]*name[ \t]*=[ \t]*["']([^"']+)""", 1)
    bins = F.transform(F.regexp_extract_all(text, F.lit(r"\n[ \t]*\[\[bin\]\]((?s:.*?))(?=\n[ \t]*\[)"), 1), lambda b: F.regexp_extract(b, r"""\n[ \t]*path[ \t]*=[ \t]*["']([^"']+)""", 1))
    return texts.where(file_name(F.col("path")) == "Cargo.toml").select("scan_id", parent_dir(F.col("path")).alias("dir"), crate_name(name).alias("crate"), bins.alias("bins")).where("crate <> ''")


def crate_roots(texts: DataFrame, paths: DataFrame) -> DataFrame:
    """``scan_id, crate, path``: root files of the crates of Cargo manifests: library, programs, and each test, bench and example as its own crate."""
    made = _cargo(texts)
    below = lambda d, p: F.when(d == "", p).otherwise(F.concat(d, F.lit("/"), p))
    fixed = F.concat(F.array(F.lit("src/lib.rs"), F.lit("src/main.rs")), F.filter("bins", lambda b: b != ""))
    named = made.select("scan_id", "crate", F.explode(F.transform(fixed, lambda p: join_relative(F.col("dir"), p))).alias("path"))
    main = named.join(paths.select("scan_id", "path"), ["scan_id", "path"], "left_semi")
    folders = made.select("scan_id", "crate", F.explode(F.transform(F.array(F.lit("tests"), F.lit("benches"), F.lit("examples")), lambda p: below(F.col("dir"), p))).alias("folder"))
    files = paths.where("path like '%.rs'").select("scan_id", "path", parent_dir(F.col("path")).alias("folder"))
    stem = F.regexp_replace(file_name(F.col("path")), r"\.rs$", "")
    extra = files.join(folders, ["scan_id", "folder"]).select("scan_id", crate_name(F.concat("crate", F.lit("_"), stem)).alias("crate"), "path")
    return main.select("scan_id", "crate", "path").unionByName(extra).distinct()


def module_folder(path: Column) -> Column:
    """Where a Rust file's modules lie: its own folder for roots and ``mod.rs``, else the folder of its name."""
    own = parent_dir(path)
    root = file_name(path).isin("lib.rs", "main.rs", "mod.rs") | F.substring_index(own, "/", -1).isin("tests", "benches", "examples")
    return F.when(root, own).otherwise(F.regexp_replace(path, r"\.rs$", ""))


def declared_modules(statements: DataFrame, paths: DataFrame) -> DataFrame:
    """``scan_id, path, specifier, name, target``: the file of each ``mod x;``: that of its ``path`` attribute, else ``x.rs`` before ``x/mod.rs``."""
    said = statements.where("kind = 'modDecl'").select("scan_id", "path", "specifier").distinct()
    name, given = F.substring_index("specifier", "|", 1), F.expr("substring(specifier, length(substring_index(specifier, '|', 1)) + 2)")
    folder = module_folder(F.col("path"))
    below = lambda end: F.concat(F.when(folder == "", "").otherwise(F.concat(folder, F.lit("/"))), name, F.lit(end))
    tried = said.select("*", name.alias("name"), F.posexplode(F.when(given != "", F.array(join_relative(parent_dir(F.col("path")), given))).otherwise(F.array(below(".rs"), below("/mod.rs")))).alias("rank", "target"))
    there = tried.join(paths.select("scan_id", F.col("path").alias("target")), ["scan_id", "target"], "left_semi")
    return there.groupBy("scan_id", "path", "specifier", "name").agg(F.min_by("target", "rank").alias("target"))


def module_tree(roots: DataFrame, declared: DataFrame) -> DataFrame:
    """``scan_id, module, path``: every module of the crates with its file, from the roots along ``mod`` declarations.

    One round for each level of nesting, which people keep small; a file is entered once for each crate, so rings end.
    """
    step = declared.select("scan_id", "path", "name", "target")
    tree = front = cut(roots.select("scan_id", "crate", F.col("crate").alias("module"), "path"))
    while front.limit(1).count():
        below = front.join(step, ["scan_id", "path"]).select("scan_id", "crate", F.concat("module", F.lit("::"), "name").alias("module"), F.col("target").alias("path")).distinct()
        front = cut(below.join(tree.select("scan_id", "crate", "path"), ["scan_id", "crate", "path"], "left_anti"))
        tree = cut(tree.unionByName(front.select(*tree.columns)))
    return tree.groupBy("scan_id", "module").agg(F.min("path").alias("path"))


def published_packages(texts: DataFrame) -> DataFrame:
    """``scan_id, package``: names under which others import what a scan holds: packages of Node (the root's too), crates and their names with underscores."""
    node = texts.where(file_name(F.col("path")) == "package.json").select("scan_id", F.get_json_object(plain_json(F.col("content")), "$.name").alias("package"))
    text = F.concat(F.lit("\n"), "content", F.lit("\n["))
    body = F.regexp_extract(text, r"\n[ \t]*\[package\][^\n]*\n((?s:.*?))\n[ \t]*\[", 1)
    name = F.regexp_extract(F.concat(F.lit("\n"), body), r"""\n[ \t]*name[ \t]*=[ \t]*["']([^"']+)""", 1)
    cargo = texts.where(file_name(F.col("path")) == "Cargo.toml").select("scan_id", F.explode(F.array(name, crate_name(name))).alias("package"))
    return node.unionByName(cargo).where("package <> ''").distinct()
