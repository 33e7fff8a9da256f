"""Imports, exports, definitions and references of source files.

Nearly everything is column expressions: lines are numbered, comments and odd strings are cut by one regular expression,
statements are extracted by others. Computed specifiers and code beyond these statement forms are not seen.
:mod:`codestrata.operators.resolve` tells what imports mean.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codestrata.functions import text as T
from codestrata.functions.paths import extension, plain_path

ECMA = ["TypeScript", "TSX", "JavaScript", "JSX"]

#: The number of a line stands between these marks at its begin; GAP is white space that may go over lines.
OPEN, SHUT = "\u0001", "\u0002"
HEAD, GAP, MARK = rf"(?m)^{OPEN}(\d+){SHUT}[ \t]*", rf"(?:\s|{OPEN}\d+{SHUT})", rf"{OPEN}\d+{SHUT}"
# What the code is cleared of: strings but those of one line without quotes inside, as specifiers are (group 1), and comments.
# Of what goes over lines the last line's begin is kept (another group). Loops are possessive: they match the same here, and
# the JVM runs them in constant stack on any length.
_TURN = rf"(\n{OPEN}\d+{SHUT})"
_PLAIN = r"""("[^"'`\\\n]*"|'[^"'`\\\n]*')"""
_BLOCK = rf"/\*(?:[^*\n]|\*(?!/)|{_TURN})*+(?:\*/|\z)"
C_COMMENTS = _PLAIN + rf"""|"(?:[^"\\\n]|\\.)*+"|'(?:[^'\\\n]|\\.)*+'|`(?:[^`\\\n]|\\[^\n]|\\?{_TURN})*+`|//[^\n]*|{_BLOCK}"""
RUST_COMMENTS = rf"""("[^"\\\n]*")|'(?:[^'\\\n]|\\.)'|\br(#*)"(?:(?!"\2)[^\n]|{_TURN})*+"\2|"(?:[^"\\\n]|\\[^\n]|\\?{_TURN})*+"|//[^\n]*|{_BLOCK}"""
PY_COMMENTS = rf"""()\"{{3}}(?:(?!\"{{3}})[^\n]|{_TURN})*+(?:\"{{3}}|\z)|'{{3}}(?:(?!'{{3}})[^\n]|{_TURN})*+(?:'{{3}}|\z)|"(?:[^"\\\n]|\\.)*+"|'(?:[^'\\\n]|\\.)*+'|#[^\n]*"""
#: By group of languages: kind of statement and the expression of the whole statement; group 1 is its line.
STATEMENTS = {
    "ecma": [("static", HEAD + rf"""import\b(?:{GAP}*[\w$*{{}},\s{OPEN}{SHUT}]+?\bfrom)?{GAP}*["']([^"'\n]+)["']"""),
             ("reExport", HEAD + rf"""export\b{GAP}*(?:\*(?:{GAP}*as\b{GAP}*[\w$]+)?|(?:type\b{GAP}*)?\{{[^}}]*\}}){GAP}*from{GAP}*["']([^"'\n]+)["']""")],
    "python": [("from", HEAD + r"from[ \t]*(\.*[ \t]*[\w.]*)[ \t]*\bimport\b[ \t]*(?:\([^)]*|[^\n]*)"), ("plain", HEAD + r"import[ \t]+([^\n;]+)")],
    "go": [("single", HEAD + r'import[ \t]+(?:[\w.]+[ \t]+)?"([^"\n]+)"'), ("block", HEAD + r"import[ \t]*\(([^)]*)")],
    "rust": [("use", HEAD + r"(?:pub(?:\([^)]*\))?[ \t]+)?use[ \t]+([^;]+);"), ("modDecl", HEAD + rf"""(?:#\[path[ \t]*=[ \t]*"[^"]+"\]{GAP}*)?(?:pub(?:\([^)]*\))?[ \t]+)?mod[ \t]+(\w+)[ \t]*;""")],
}
#: Imports within a line; group 1 is the word, group 2 the specifier.
INLINE = r"""(?<![\w$.])(import|require)\s*\(\s*["']([^"'\n]+)["']\s*\)"""
#: What a file exports, one statement each.
EXPORTS = HEAD + rf"""export\b(?:{GAP}*(?:type\b{GAP}*)?(?:\{{[^}}]*\}}|\*(?:{GAP}*as\b{GAP}*[\w$]+)?)(?:{GAP}*from{GAP}*["'][^"'\n]+["'])?|[ \t]+[^\n]*)"""
DECLARED = r"export\s+(?:default\s+)?(?:declare\s+|abstract\s+|async\s+)*(?:function\s*\*?|class|interface|type|enum|const\s+enum|const|let|var|namespace|module)\s+([\w$]+)"
#: By group of languages: the expression of a definition at the start of a line; group 1 is its kind, group 2 its name.
DEFINITIONS = {
    "ecma": r"^(?:export[ \t]+)?(?:default[ \t]+)?(?:declare[ \t]+)?(?:abstract[ \t]+)?(?:async[ \t]+)?(function|class|interface|type|enum|const|let|var)[ \t*]+([A-Za-z_$][\w$]*)",
    "python": r"^[ \t]*(?:async[ \t]+)?(def|class)[ \t]+(\w+)", "go": r"^(func|type|const|var)[ \t]+(?:\([^)]*\)[ \t]*)?(\w+)",
    "rust": r"^[ \t]*(?:pub(?:\([^)]*\))?[ \t]+)?(?:async[ \t]+|unsafe[ \t]+|const[ \t]+)*(fn|struct|enum|trait|mod|const|static|type)[ \t]+(\w+)",
}
GROUPS = {"ecma": ECMA, "python": ["Python"], "go": ["Go"], "rust": ["Rust"]}


def sources(source_files: DataFrame) -> DataFrame:
    """``file_id, scan_id, path, language, family, code``: files of known languages with content, without comments and with numbered lines; bytes are read as UTF-8, what is none becomes a mark."""
    path = plain_path(F.col("rel_path"))
    named = source_files.where("content is not null and rel_path is not null").select("file_id", "scan_id", path.alias("path"), T.language_of(extension(path)).alias("language"), F.replace(F.make_valid_utf8(F.col("content").cast("string")), F.lit("\r\n"), F.lit("\n")).alias("text"))
    family = F.coalesce(*[F.when(F.col("language").isin(*langs), F.lit(g)) for g, langs in GROUPS.items()])
    numbered = F.array_join(F.transform(F.split("text", "\n"), lambda line, i: F.concat(F.lit(OPEN), (i + 1).cast("string"), F.lit(SHUT), line)), "\n")
    marked = named.where("language is not null").select("file_id", "scan_id", "path", "language", family.alias("family"), numbered.alias("text"))
    code = (
        F.when(F.col("family") == "python", F.regexp_replace("text", PY_COMMENTS, "$1$2$3")).when(F.col("family") == "rust", F.regexp_replace("text", RUST_COMMENTS, "$1$3$4$5"))
        .otherwise(F.regexp_replace("text", C_COMMENTS, "$1$2$3")))
    return marked.select("file_id", "scan_id", "path", "language", "family", code.alias("code"))


def use_leaves(tree: str) -> list[tuple[str, str]]:
    """``(path, name)`` of every leaf of a Rust use tree; the name is the alias if there is one, ``*`` for a glob."""
    tokens, out = re.findall(r"::|[{},*]|[\w$#]+", tree), []

    def walk(at: int, prefix: list[str]) -> int:
        parts, alias, below = list(prefix), None, False
        while at < len(tokens) and tokens[at] not in (",", "}"):
            tok = tokens[at]
            at += 1
            if tok == "{":
                below = True
                while at < len(tokens) and tokens[at] != "}":
                    at = walk(at, parts)
                    at += at < len(tokens) and tokens[at] == ","
                at += 1
            elif tok == "as" and at < len(tokens):
                alias = tokens[at]
                at += 1
            elif tok != "::":
                parts.append(tok)
        if not below and len(parts) > len(prefix):
            glob = parts[-1] == "*"
            path = parts[:-1] if glob or parts[-1] == "self" and len(parts) > 1 and prefix else parts
            out.append(("::".join(path), "*" if glob else alias or path[-1]))
        return at

    at = 0
    while at < len(tokens):
        at = walk(at, []) + 1
    return out


def _use_leaves(trees: Column) -> Column:
    def leaves(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"path": p, "name": n} for p, n in use_leaves(t)] if t else [])

    return F.pandas_udf(leaves, "array<struct<path:string,name:string>>")(trees)


def _bare(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(text, MARK, " "), r"\s+", " "))


def _listed(text: Column) -> Column:
    """The source-side names of a list with commas: without ``type`` and what follows ``as``; ``*`` is no name."""
    one = lambda x: F.regexp_replace(F.regexp_replace(F.trim(x), r"^type\s+", ""), r"\s+as\s.*$", "")
    return F.filter(F.transform(F.split(_bare(text), ","), one), lambda x: x.rlike(r"^[\w$]+$"))


def _tagged(kind: str):
    return lambda text: F.struct(F.lit(kind).alias("kind"), text.alias("text"))


def import_statements(files: DataFrame) -> DataFrame:
    """``file_id, scan_id, path, family, kind, specifier, names, line``: one row per import, of :func:`sources`.

    Lists of Python and Go and the use trees of Rust are taken apart. ``names`` are those asked of the target, as it
    calls them; kind is static, type, reExport, dynamic, require or modDecl (whose specifier has the path of a ``path``
    attribute behind a ``|``). A Python name that its module's name ends with is no name.
    """
    arrays = []
    for family, forms in STATEMENTS.items():
        for kind, form in forms:
            arrays.append(F.when(F.col("family") == family, F.transform(F.regexp_extract_all("code", F.lit(form), 0), _tagged(kind))))
    key = ["file_id", "scan_id", "path", "family"]
    none = F.array().cast("array<struct<kind:string,text:string>>")
    said = files.select(*key, F.explode(F.concat(*[F.coalesce(a, none) for a in arrays])).alias("i")).select(*key, "i.*", F.regexp_extract("i.text", OPEN + r"(\d+)", 1).cast("int").alias("line"))
    text, kind, empty = F.col("text"), F.col("kind"), F.array().cast("array<string>")
    forms = {kind: form for family in STATEMENTS.values() for kind, form in family}
    group = lambda form, g: F.regexp_extract(text, form, g)
    given = group(r'#\[path[ \t]*=[ \t]*"([^"]+)"', 1)
    specifier = (
        F.when(kind == "from", F.regexp_replace(group(forms["from"], 2), r"\s", "")).when(kind == "modDecl", F.concat(group(forms["modDecl"], 2), F.when(given != "", F.concat(F.lit("|"), given)).otherwise("")))
        .when(kind == "use", _bare(group(forms["use"], 2))).when(kind == "block", F.lit("")).otherwise(F.coalesce(*[F.when(kind == k, group(forms[k], 2)) for k in ("static", "reExport", "plain", "single")])))
    typed = F.when(text.rlike(rf"import{GAP}+type\b(?!{GAP}*(?:,|from\b))"), "type").otherwise("static")
    way = F.when(kind == "static", typed).when(kind.isin("reExport", "modDecl"), kind).when((kind == "use") & text.rlike(SHUT + r"\s*pub"), "reExport").otherwise("static")
    listed = F.when(kind == "from", F.regexp_replace(text, r"(?s)^.*?\bimport\b\s*\(?", "")).when(kind.isin("static", "reExport"), group(r"\{([^}]*)\}", 1)).otherwise("")
    quoted = F.when(kind == "block", F.regexp_extract_all(text, F.lit(rf'{OPEN}\d+{SHUT}[^"\n]*"[^"\n]+"|^[^"\n]*"[^"\n]+"'), 0)).otherwise(empty)
    plain = said.select(*key, "kind", "line", specifier.alias("said"), way.alias("way"), listed.alias("listed"), quoted.alias("quoted"))
    # the leaves are made between the two projections, which keeps the code of each small
    read = plain.withColumn("leaves", _use_leaves(F.when(kind == "use", F.col("said"))))
    row = lambda specifier, names=empty, at=F.col("line"): F.struct(specifier.alias("specifier"), names.alias("names"), at.alias("line"))
    names = F.filter(_listed(F.col("listed")), lambda n: (kind != "from") | ~F.endswith(F.col("said"), n))
    at = lambda q: F.when(F.startswith(q, F.lit(OPEN)), F.regexp_extract(q, OPEN + r"(\d+)", 1).cast("int")).otherwise(F.col("line"))
    found = (
        F.when(kind == "plain", F.transform(_dotted(F.col("said")), lambda m: row(m))).when(kind == "block", F.transform("quoted", lambda q: row(F.regexp_extract(q, '"([^"]+)"', 1), at=at(q))))
        .when(kind == "use", F.transform("leaves", lambda u: row(u["path"], F.array(u["name"])))).otherwise(F.array(row(F.col("said"), names))))
    whole = read.select(*key, "way", F.explode(found).alias("f")).select(*key, F.col("way").alias("kind"), "f.specifier", "f.names", "f.line")
    hits = lambda g: F.regexp_extract_all("text", F.lit(INLINE), g)
    inline = code_lines(files).where("family = 'ecma'").where(F.col("text").rlike(INLINE)).select(*key, F.explode(F.arrays_zip(hits(1).alias("word"), hits(2).alias("what"))).alias("z"), "line")
    return whole.unionByName(inline.select(*key, F.when(F.col("z.word") == "import", "dynamic").otherwise("require").alias("kind"), F.col("z.what").alias("specifier"), empty.alias("names"), "line"))


def _dotted(text: Column) -> Column:
    """The modules of a plain Python import."""
    one = lambda x: F.regexp_replace(F.trim(x), r"\s+as\s.*$", "")
    return F.filter(F.transform(F.split(text, ","), one), lambda x: x.rlike(r"^[\w.]+$"))


def exports(files: DataFrame) -> DataFrame:
    """``file_id, scan_id, path, family, name, specifier, line, pos``: names that a file offers, as others call them; ``specifier`` is null for its own.

    ``export *`` is the name ``*``; ``pos`` numbers names of one statement. Rust's are its public items and ``pub use``;
    other languages pass nothing on.
    """
    key = ["file_id", "scan_id", "path", "family"]
    ecma = files.where("family = 'ecma'").select(*key, F.explode(F.regexp_extract_all("code", F.lit(EXPORTS), 0)).alias("text"))
    text = F.col("text")
    bare = _bare(text)
    outward = lambda x: F.regexp_replace(F.regexp_replace(F.trim(x), r"^type\s+", ""), r"^.*\sas\s+", "")
    listed = F.transform(F.split(F.regexp_extract(bare, r"\{([^}]*)\}", 1), ","), outward)
    star = F.regexp_extract(bare, r"\*\s*(?:as\s+([\w$]+))?", 1)
    names = (
        F.when(bare.rlike(r"^export\s*(?:type\s*)?\{"), listed).when(bare.rlike(r"^export\s*(?:type\s*)?\*"), F.array(F.when(star == "", "*").otherwise(star)))
        .when(bare.rlike(r"^export\s+default\b"), F.array(F.lit("default"))).otherwise(F.array(F.regexp_extract(bare, DECLARED, 1))))
    source = F.regexp_extract(bare, r"""from\s*["']([^"']+)["']\s*$""", 1)
    line = F.regexp_extract(text, OPEN + r"(\d+)", 1).cast("int")
    own = ecma.select(*key, F.when(source != "", source).alias("specifier"), line.alias("line"), F.posexplode(names).alias("pos", "name")).where("name <> ''")
    items = definitions(code_lines(files.where("family = 'rust'"))).where("exported").join(files.select("file_id", "path", "family"), "file_id").select(*key, F.lit(None).cast("string").alias("specifier"), "line", F.lit(0).alias("pos"), "name")
    used = import_statements(files.where("family = 'rust'")).where("kind = 'reExport'").select(*key, "specifier", "line", F.lit(0).alias("pos"), F.get("names", F.lit(0)).alias("name"))
    return own.unionByName(items).unionByName(used).select(*key, "name", "specifier", "line", "pos")


def code_lines(files: DataFrame) -> DataFrame:
    """``file_id, scan_id, path, family, line, text``, lines numbered from 1 as in the file."""
    rows = files.select("file_id", "scan_id", "path", "family", F.explode(F.split("code", "\n")).alias("text"))
    return rows.select("file_id", "scan_id", "path", "family", F.regexp_extract("text", OPEN + r"(\d+)", 1).cast("int").alias("line"), F.regexp_replace("text", MARK, "").alias("text")).where("line is not null")


def definitions(lines: DataFrame) -> DataFrame:
    """``file_id, scan_id, line, kind, name, exported``: names defined at line starts; Python's without ``_`` at the margin, Go's in upper case and what says export or pub are exported."""
    by = lambda group: F.coalesce(*[F.when(F.col("family") == f, F.regexp_extract("text", form, group)) for f, form in DEFINITIONS.items()])
    exported = (F.when(F.col("family") == "python", ~F.col("text").rlike(r"^[ \t]") & ~F.startswith("name", F.lit("_"))).when(F.col("family") == "go", F.col("name").rlike("^[A-Z]")).otherwise(F.col("text").rlike(r"^[ \t]*(export|pub)\b")))
    named = lines.select("*", by(1).alias("kind"), by(2).alias("name")).where("name <> ''")
    return named.select("file_id", "scan_id", "line", "kind", "name", exported.alias("exported"))


def symbol_edges(lines: DataFrame) -> DataFrame:
    """``scan_id, owner, target``: calls from one definition to another, where the called name is defined once in the scan.

    The owner of a call is the last definition at or before its line in the file; calls before any are dropped, and so are calls of oneself.
    """
    named = definitions(lines)
    calls = lines.select("scan_id", "file_id", "line", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"([A-Za-z_$][\w$]*)\s*\("), 1))).alias("called"))
    marks = named.select("scan_id", "file_id", "line", F.lit(0).alias("side"), "name", F.lit(None).cast("string").alias("called"))
    asks = calls.select("scan_id", "file_id", "line", F.lit(1).alias("side"), F.lit(None).cast("string").alias("name"), "called")
    order = Window.partitionBy("file_id").orderBy("line", "side", "name").rowsBetween(Window.unboundedPreceding, 0)
    owned = marks.unionByName(asks).withColumn("owner", F.last("name", ignorenulls=True).over(order)).where("side = 1 and owner is not null and owner <> called")
    once = named.groupBy("scan_id", F.col("name").alias("called")).agg(F.count("*").alias("n")).where("n = 1").select("scan_id", "called")
    return owned.join(once, ["scan_id", "called"], "left_semi").select("scan_id", "owner", F.col("called").alias("target")).distinct()
