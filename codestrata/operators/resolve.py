"""What imports mean: ranked candidates met by equal joins.

Each file offers the keys under which an import can find it (its path, the path without an ending, its folder for an
index file), each import asks for a few keys in order, and the best meeting wins. So no import is held against every
ending, and all languages share one join.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codestrata.functions import text as T
from codestrata.functions.paths import join_relative, parent_dir
from codestrata.operators import projects
from codestrata.session import stage

# The endings tried on a specifier, in this order, and as index files.
ENDINGS = [".ts", ".tsx", ".d.ts", ".mts", ".cts", ".js", ".jsx", ".mjs", ".cjs"]
# What is looked for on disk before an import counts as missing.
ON_DISK = ["", ".ts", ".tsx", ".d.ts", ".js", ".jsx", ".mts", ".cts", ".mjs", ".cjs", ".rs", "/index.ts", "/index.tsx", "/index.js", "/index.jsx", "/mod.rs"]
SITE = ["scan_id", "file_id", "specifier", "names"]


@dataclass
class Project:
    """The tables of :mod:`codestrata.operators.projects` that resolution joins."""

    aliases: DataFrame
    packages: DataFrame
    bases: DataFrame
    roots: DataFrame
    modules: DataFrame
    crates: DataFrame
    declared: DataFrame
    tree: DataFrame


def project_of(texts: DataFrame, paths: DataFrame, statements: DataFrame) -> Project:
    declared = stage(projects.declared_modules(statements, paths))
    roots = stage(projects.crate_roots(texts, paths))
    return Project(projects.path_aliases(texts), projects.node_packages(texts), projects.base_urls(texts), projects.python_roots(paths), projects.go_modules(texts), roots.select("scan_id", "crate").distinct(), declared, projects.module_tree(roots, declared))


def _rank(tier: Column | int, text: Column | str = "", more: Column | int = 0) -> Column:
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(lit(tier).cast("int").alias("tier"), lit(text).cast("string").alias("text"), lit(more).cast("int").alias("more")).alias("rank")


def ecma_keys(paths: DataFrame, endings: list[str] = ENDINGS) -> DataFrame:
    """``scan_id, key, order, path``: what a JavaScript import can call a file."""
    forms = [F.struct(F.lit(0).alias("order"), F.col("path").alias("key"))]
    for n, ending in enumerate(endings):
        stem = F.substr("path", F.lit(1), F.length("path") - len(ending))
        forms.append(F.when(F.endswith("path", F.lit(ending)), F.struct(F.lit(1 + n).alias("order"), stem.alias("key"))))
        index = "index" + ending
        forms.append(F.when((F.col("path") == index) | F.endswith("path", F.lit("/" + index)), F.struct(F.lit(1 + len(endings) + n).alias("order"), parent_dir(F.col("path")).alias("key"))))
    return paths.select("scan_id", "path", F.explode(F.filter(F.array(*forms), lambda k: k.isNotNull())).alias("k")).select("scan_id", "k.key", "k.order", "path")


def _python_keys(paths: DataFrame) -> DataFrame:
    """``scan_id, key, order, path``: modules by their path without an ending, packages by their folder."""
    form = lambda order, ending: F.when(F.endswith("path", F.lit(ending)), F.struct(F.lit(order).alias("order"), F.substr("path", F.lit(1), F.length("path") - len(ending)).alias("key")))
    forms = F.filter(F.array(form(0, ".py"), form(1, "/__init__.py"), form(2, ".pyi")), lambda k: k.isNotNull())
    return paths.select("scan_id", "path", F.explode(forms).alias("k")).select("scan_id", "k.key", "k.order", "path")


def _met(asked: DataFrame, keys: DataFrame) -> DataFrame:
    """``SITE, rank, found``: of ``asked`` (``SITE, rank, key``) what keys hold, each rank extended by the key's order."""
    return asked.join(keys, ["scan_id", "key"]).select(*SITE, F.struct("rank.tier", "rank.text", "rank.more", F.col("order").alias("order")).alias("rank"), F.col("path").alias("found"))


def ecma_asked(sites: DataFrame, project: Project) -> DataFrame:
    """``SITE, aliased, rank, key``: the places an import may mean, in order: relative and rooted paths, the first alias that fits, packages, base folders."""
    spec, directory = F.col("specifier"), parent_dir(F.col("path"))
    relative = spec.rlike(r"^\.{1,2}(/|$)")
    placed = sites.where(relative | F.startswith(spec, F.lit("/")))
    near = placed.select(*SITE, F.lit(False).alias("aliased"), _rank(0), F.when(relative, join_relative(directory, spec)).otherwise(F.substr(spec, F.lit(2))).alias("key"))
    bare = sites.where(~relative & ~F.startswith(spec, F.lit("/")))
    cuts = lambda c: F.transform(F.sequence(F.lit(0), F.length(c)), lambda n: F.substr(c, F.lit(1), n))
    fits = F.when(F.col("wild"), F.endswith(spec, F.col("suffix")) & (F.length("prefix") + F.length("suffix") <= F.length(spec))).otherwise(F.col("prefix") == spec)
    met = bare.select(*SITE, F.explode(cuts(spec)).alias("prefix")).join(project.aliases, ["scan_id", "prefix"]).where(fits)
    first = met.groupBy(*SITE).agg(F.min(F.struct((-F.length("prefix")).alias("size"), "source", "pos", "prefix", "suffix", "wild", "targets")).alias("a"))
    star = F.expr("substring(specifier, length(a.prefix) + 1, length(specifier) - length(a.prefix) - length(a.suffix))")
    filled = F.transform("a.targets", lambda t: F.when(F.col("a.wild") & F.contains(t, F.lit("*")), F.concat(F.substring_index(t, "*", 1), star, F.substr(t, F.length(F.substring_index(t, "*", 1)) + 2))).otherwise(t))
    aliased = first.select(*SITE, F.posexplode(filled).alias("at", "key")).select(*SITE, F.lit(True).alias("aliased"), _rank(1, "", F.col("at")), "key")
    rest = bare.join(first.select(*SITE), SITE, "left_anti")
    parts = F.transform(F.sequence(F.lit(1), F.size(F.split(spec, "/"))), lambda n: F.concat_ws("/", F.slice(F.split(spec, "/"), 1, n)))
    packaged = rest.select(*SITE, F.explode(parts).alias("package")).join(project.packages, ["scan_id", "package"])
    packaged = packaged.select(*SITE, F.lit(False).alias("aliased"), _rank(2, F.col("package")), join_relative(F.col("dir"), F.substr(spec, F.length("package") + 1)).alias("key"))
    based = rest.join(project.bases, "scan_id").select(*SITE, F.lit(False).alias("aliased"), _rank(3, F.col("base")), join_relative(F.col("base"), spec).alias("key"))
    return near.unionByName(aliased).unionByName(packaged).unionByName(based)


def _python_met(sites: DataFrame, paths: DataFrame, project: Project) -> DataFrame:
    dots = F.length(F.regexp_extract("specifier", r"^(\.*)", 1))
    module = F.regexp_replace(F.regexp_replace("specifier", r"^\.+", ""), r"\.", "/")
    wanted = lambda base: F.concat(F.transform("names", lambda n: F.concat_ws("/", F.when(base != "", base), n)), F.array(base))
    climbed = join_relative(parent_dir(F.col("path")), F.repeat(F.lit("../"), F.greatest(dots - 1, F.lit(0))))
    base = F.concat_ws("/", F.when(climbed != "", climbed), F.when(module != "", module))
    keys = _python_keys(paths)
    near = sites.where(dots > 0).select(*SITE, base.alias("base")).select(*SITE, F.posexplode(wanted(F.col("base"))).alias("at", "key")).select(*SITE, _rank(0, "", F.col("at")), "key")
    # an absolute module is looked for under each root: files are keyed by what is left of them below each of theirs
    above = F.transform(F.sequence(F.lit(0), F.size(F.split("key", "/")) - 1), lambda n: F.concat_ws("/", F.slice(F.split("key", "/"), 1, n)))
    under = keys.select("*", F.explode(above).alias("root")).join(project.roots, ["scan_id", "root"])
    under = under.select("scan_id", F.when(F.col("root") == "", F.col("key")).otherwise(F.substr("key", F.length("root") + 2)).alias("key"), "root", "order", "path")
    far = sites.where(dots == 0).select(*SITE, F.posexplode(wanted(module)).alias("at", "key")).join(under, ["scan_id", "key"])
    far = far.select(*SITE, F.struct((-F.length("root")).cast("int").alias("tier"), F.col("root").alias("text"), F.col("at").alias("more"), "order").alias("rank"), F.col("path").alias("found"))
    return _met(near, keys).unionByName(far)


def _go_met(sites: DataFrame, paths: DataFrame, project: Project) -> tuple[DataFrame, DataFrame]:
    """What Go imports meet, and the sites whose package lies in a module of the scan."""
    faces = paths.where("path like '%.go'").groupBy("scan_id", parent_dir(F.col("path")).alias("key")).agg(F.min_by("path", F.struct(F.endswith("path", F.lit("_test.go")), "path")).alias("path")).withColumn("order", F.lit(0))
    spec = F.col("specifier")
    near = sites.where(spec.rlike(r"^\.{1,2}/")).select(*SITE, _rank(0), join_relative(parent_dir(F.col("path")), spec).alias("key"))
    parts = F.transform(F.sequence(F.lit(1), F.size(F.split(spec, "/"))), lambda n: F.concat_ws("/", F.slice(F.split(spec, "/"), 1, n)))
    inside = sites.where(~spec.rlike(r"^\.{1,2}/")).select(*SITE, F.explode(parts).alias("module")).join(project.modules, ["scan_id", "module"])
    longest = inside.groupBy(*SITE).agg(F.max(F.struct(F.length("module").alias("size"), "module", "dir")).alias("m"))
    far = longest.select(*SITE, _rank(0), join_relative(F.col("m.dir"), F.expr("substring(specifier, m.size + 1)")).alias("key"))
    return _met(near.unionByName(far), faces), longest.select(*SITE)


def _rust_met(sites: DataFrame, project: Project) -> tuple[DataFrame, DataFrame]:
    """What Rust paths meet (the longest prefix that is a module), and ``SITE, state``: outside, lost (too many ``super``), missing or local."""
    home = project.tree.groupBy("scan_id", "path").agg(F.min(F.struct(F.size(F.split("module", "::")), "module")).alias("h")).select("scan_id", "path", F.col("h.module").alias("home"))
    local = project.crates.withColumnRenamed("crate", "first").withColumn("known", F.lit(True))
    said = F.filter(F.split("specifier", "::"), lambda s: s != "")
    placed = sites.withColumn("said", said).where(F.size("said") > 0).withColumn("first", T.crate_name(F.col("said")[0])).join(home, ["scan_id", "path"], "left").join(local, ["scan_id", "first"], "left")
    inner = F.col("first").isin("crate", "self", "super")
    parts = F.split("home", "::")
    supers = ((F.length(F.regexp_extract("specifier", r"^((?:super(?:::|$))*)", 1)) + 2) / 7).cast("int")
    rest = lambda n: F.slice("said", n + 1, F.size("said"))
    whole = (
        F.when(F.col("first") == "crate", F.concat(F.slice(parts, 1, 1), rest(F.lit(1)))).when(F.col("first") == "self", F.concat(parts, rest(F.lit(1))))
        .when(F.col("first") == "super", F.concat(F.slice(parts, 1, F.greatest(F.size(parts) - supers, F.lit(0))), rest(supers))).otherwise(F.concat(F.array("first"), rest(F.lit(1)))))
    state = F.when(inner & F.col("home").isNull(), "outside").when((F.col("first") == "super") & (supers >= F.size(parts)), "lost").when(~inner & F.col("known").isNull(), "external").otherwise("local")
    told = placed.select(*SITE, state.alias("state"), whole.alias("whole"))
    cuts = F.transform(F.sequence(F.lit(1), F.size("whole")), lambda n: F.concat_ws("::", F.slice("whole", 1, n)))
    asked = told.where("state = 'local'").select(*SITE, F.posexplode(cuts).alias("at", "key")).select(*SITE, _rank(-F.col("at")), "key")
    return _met(asked, project.tree.select("scan_id", F.col("module").alias("key"), F.lit(0).alias("order"), "path")), told.select(*SITE, "state")


def resolve(statements: DataFrame, paths: DataFrame, project: Project, listing: DataFrame | None = None) -> DataFrame:
    """``scan_id, file_id, path, family, specifier, names, outcome, target``: what each different import of a file means.

    ``statements`` are those of :func:`codestrata.operators.imports.import_statements`, ``paths`` has ``scan_id, path``.
    Outcomes: Resolved; CaseMismatch (found in another letter case, JavaScript only); Asset; NoSuchFile; UnmatchedAlias
    (the first alias that fits leads nowhere); FileNotInModuleTree (Rust); External with the package as target; and
    ExcludedFromScan where ``listing``, the paths on disk, holds what is missing from the scan. Nulls are no imports.
    """
    said = statements.where("specifier is not null").select("scan_id", "file_id", "path", "family", F.when(F.col("kind") == "modDecl", "mod").otherwise("import").alias("way"), "specifier", F.when(F.col("family") == "python", F.col("names")).otherwise(F.array().cast("array<string>")).alias("names")).distinct()
    said = stage(said)
    held = stage(paths.select("scan_id", "path").where("path is not null").distinct())
    asset = (F.col("family") == "ecma") & T.is_asset(F.col("specifier"))
    of = lambda family: said.where((F.col("family") == family) & (F.col("way") == "import") & (F.col("specifier") != ""))
    asked = stage(ecma_asked(of("ecma").where(~asset), project))
    keys = ecma_keys(held)
    exact = _met(asked, keys).select(*SITE, F.struct("rank.tier", "rank.text", "rank.more", F.lit(0).alias("loose"), "rank.order").alias("rank"), "found")
    folded = keys.groupBy("scan_id", F.lower("key").alias("key"), "order").agg(F.min("path").alias("path"))
    loose = _met(asked.withColumn("key", F.lower("key")), folded).select(*SITE, F.struct("rank.tier", "rank.text", "rank.more", F.lit(1).alias("loose"), "rank.order").alias("rank"), "found")
    go, inside = _go_met(of("go"), held, project)
    rust, states = _rust_met(of("rust"), project)
    others = _python_met(of("python"), held, project).unionByName(go).unionByName(rust)
    others = others.select(*SITE, F.struct("rank.tier", "rank.text", "rank.more", F.lit(0).alias("loose"), "rank.order").alias("rank"), "found")
    best = exact.unionByName(loose).unionByName(others).groupBy(*SITE).agg(F.min(F.struct("rank", "found")).alias("b")).withColumn("way", F.lit("import"))
    mods = said.where("way = 'mod'").join(project.declared.select("scan_id", "path", "specifier", "target"), ["scan_id", "path", "specifier"]).select(*SITE, F.struct(F.struct(F.lit(0).alias("tier"), F.lit("").alias("text"), F.lit(0).alias("more"), F.lit(0).alias("loose"), F.lit(0).alias("order")).alias("rank"), F.col("target").alias("found")).alias("b"), F.lit("mod").alias("way"))
    notes = states.withColumn("way", F.lit("import")).unionByName(asked.where("aliased").select(*SITE).distinct().select(*SITE, F.lit("aliased").alias("state"), F.lit("import").alias("way"))).unionByName(inside.select(*SITE, F.lit("inside").alias("state"), F.lit("import").alias("way")))
    told = said.join(best.unionByName(mods), [*SITE, "way"], "left").join(notes, [*SITE, "way"], "left")
    spec, state = F.col("specifier"), F.coalesce("state", F.lit(""))
    local = (
        F.when((spec == "") | (F.col("way") == "mod"), True).when(F.col("family") == "ecma", spec.rlike(r"^\.{1,2}(/|$)|^/")).when(F.col("family") == "python", F.startswith(spec, F.lit(".")))
        .when(F.col("family") == "go", spec.rlike(r"^\.{1,2}/") | (state == "inside")).otherwise(state.isin("lost", "local", "")))
    outcome = (
        F.when(asset, "Asset").when(F.col("b").isNotNull() & (F.col("b.rank.loose") == 1), "CaseMismatch").when(F.col("b").isNotNull(), "Resolved")
        .when(state == "aliased", "UnmatchedAlias").when(state == "outside", "FileNotInModuleTree").when(local, "NoSuchFile").otherwise("External"))
    package = F.when(F.col("family") == "ecma", T.package_name(spec)).when(F.col("family") == "python", F.substring_index(spec, ".", 1)).when(F.col("family") == "rust", T.crate_name(F.regexp_extract(spec, r"^(?:::)?([^:]+)", 1))).otherwise(spec)
    target = F.when(outcome.isin("Resolved", "CaseMismatch"), F.col("b.found")).when(outcome == "External", package)
    out = told.select("scan_id", "file_id", "path", "family", "way", "specifier", "names", outcome.alias("outcome"), target.alias("target"))
    if listing is not None:
        out = _excluded(out, asked, listing)
    return out.select("scan_id", "file_id", "path", "family", "specifier", "names", "outcome", "target")


def _excluded(resolved: DataFrame, asked: DataFrame, listing: DataFrame) -> DataFrame:
    """Misses that the disk holds outside the scan are ExcludedFromScan."""
    missing = resolved.where(F.col("outcome").isin("NoSuchFile", "UnmatchedAlias"))
    tried = missing.join(asked.select(*SITE, "key"), SITE, "left").select(*SITE, F.coalesce("key", join_relative(parent_dir(F.col("path")), F.col("specifier"))).alias("key")).where("key <> ''")
    forms = [F.when(F.endswith("path", F.lit(e)), F.substr("path", F.lit(1), F.length("path") - len(e))) for e in ON_DISK]
    there = listing.select("scan_id", F.explode(F.array_distinct(F.filter(F.array(*forms), lambda k: k.isNotNull()))).alias("key")).distinct()
    hit = tried.join(there, ["scan_id", "key"], "left_semi").select(*SITE).distinct().withColumn("hit", F.lit(True))
    return resolved.join(hit, SITE, "left").withColumn("outcome", F.when(F.col("hit") & F.col("outcome").isin("NoSuchFile", "UnmatchedAlias"), "ExcludedFromScan").otherwise(F.col("outcome"))).drop("hit")


def follow_names(edges: DataFrame, offered: DataFrame, hops: int = 16) -> DataFrame:
    """``scan_id, src, name, dst, at, kind``: imports of a name followed through files that only pass it on.

    ``edges`` has ``scan_id, src, dst, name`` (empty for imports without names); ``offered`` has ``scan_id, path, name,
    line, pos, passed`` (whether the name comes from elsewhere) and ``next`` (the file it comes from, null if unknown).
    A file's own export ends the walk; else its first forward of the name, else its first ``*``. ``at`` is where the walk
    ended, kind import; where it ends without the name, in a ring or after ``hops`` rounds, ``at`` is the first file and
    kind viaBarrel. Targets that pass nothing on are not walked.
    """
    first = F.min(F.struct("line", "pos", "next"))
    barrels = offered.where("passed").select("scan_id", F.col("path").alias("dst")).distinct()
    own = offered.where("not passed").select("scan_id", F.col("path").alias("here"), "name", F.lit(True).alias("own")).distinct()
    named = offered.where("passed and name <> '*'").groupBy("scan_id", F.col("path").alias("here"), "name").agg(first.alias("f")).select("scan_id", "here", "name", F.lit(True).alias("forward"), F.col("f.next").alias("named"))
    stars = offered.where("passed and name = '*'").groupBy("scan_id", F.col("path").alias("here")).agg(first.alias("f")).select("scan_id", "here", F.col("f.next").alias("star"))
    key = ["scan_id", "src", "dst", "name"]
    asked = edges.select(*key).distinct()
    walked = asked.where("name <> ''").join(barrels, ["scan_id", "dst"], "left_semi")
    walk = stage(walked.select(*key, F.col("dst").alias("here"), F.array("dst").alias("seen")))
    ended = None
    for _ in range(hops):
        if not walk.limit(1).count():
            break
        step = walk.join(own, ["scan_id", "here", "name"], "left").join(named, ["scan_id", "here", "name"], "left").join(stars, ["scan_id", "here"], "left")
        nxt = F.when(F.col("forward"), F.col("named")).otherwise(F.col("star"))
        told = stage(step.select(*key, "here", "seen", "own", nxt.alias("next")))
        stop = F.coalesce("own", F.lit(False)) | F.col("next").isNull() | F.array_contains("seen", F.col("next"))
        done = told.where(F.coalesce(stop, F.lit(True))).select(*key, F.when(F.col("own"), F.col("here")).otherwise(F.col("dst")).alias("at"), F.when(F.col("own"), "import").otherwise("viaBarrel").alias("kind"))
        ended = done if ended is None else ended.unionByName(done)
        walk = stage(told.where(~F.coalesce(stop, F.lit(True))).select(*key, F.col("next").alias("here"), F.concat("seen", F.array("next")).alias("seen")))
    lost = walk.select(*key, F.col("dst").alias("at"), F.lit("viaBarrel").alias("kind"))
    ended = lost if ended is None else ended.unionByName(lost)
    direct = asked.where("name = ''").unionByName(asked.where("name <> ''").join(barrels, ["scan_id", "dst"], "left_anti").select(*key)).select(*key, F.col("dst").alias("at"), F.lit("import").alias("kind"))
    return direct.unionByName(ended)


def source_edges(statements: DataFrame, resolved: DataFrame, offered: DataFrame) -> DataFrame:
    """``scan_id, src, dst, kind, sites, lines``: edges between files: imports (followed through barrels), viaBarrel, and contains for ``mod x;``.

    One row for each pair and kind, with the number of import sites and their lines in order. A file has no edge to
    itself. Only the first name of a JavaScript or Rust import is followed.
    """
    hits = resolved.where("outcome in ('Resolved', 'CaseMismatch')").select("scan_id", "file_id", "specifier", F.col("names").alias("wanted"), F.col("target").alias("dst"))
    sites = statements.withColumn("wanted", F.when(F.col("family") == "python", F.col("names")).otherwise(F.array().cast("array<string>"))).join(hits, ["scan_id", "file_id", "specifier", "wanted"])
    name = F.when(F.col("family").isin("ecma", "rust") & (F.col("kind") != "modDecl") & (F.size("names") > 0), F.get("names", F.lit(0)))
    sites = stage(sites.select("scan_id", F.col("path").alias("src"), "dst", F.when(F.col("kind") == "modDecl", "contains").otherwise("import").alias("way"), F.coalesce(F.when(name != "*", name), F.lit("")).alias("name"), "line"))
    forward = hits.select("scan_id", "file_id", "specifier", F.col("dst").alias("next")).dropDuplicates(["scan_id", "file_id", "specifier"])
    passes = offered.withColumn("passed", F.col("specifier").isNotNull()).join(forward, ["scan_id", "file_id", "specifier"], "left").select("scan_id", "path", "name", "line", "pos", "passed", "next")
    seen = follow_names(sites.where("way = 'import'").select("scan_id", "src", "dst", "name"), stage(passes))
    contained = sites.where("way = 'contains'").select("scan_id", "src", "dst", F.col("way").alias("kind"), "line")
    told = sites.where("way = 'import'").drop("way").join(seen, ["scan_id", "src", "dst", "name"]).select("scan_id", "src", F.col("at").alias("dst"), "kind", "line").unionByName(contained)
    return told.where("src <> dst").groupBy("scan_id", "src", "dst", "kind").agg(F.count("*").alias("sites"), F.array_sort(F.collect_set("line")).alias("lines"))
