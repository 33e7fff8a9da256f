"""Source files that nobody of the repository wrote by hand: generated, minified, vendored, or data kept as code."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codestrata.functions.paths import file_name, parent_dir, path_prefixes, plain_path
from codestrata.session import frame_stage, spread, stage

# Conventions of many projects, as lines of an attribute file; they hold where a repository declares nothing.
CONVENTIONS = r"""
**/vendor/** vendored
**/vendored/** vendored
**/_vendor/** vendored
**/vendor-*/** vendored
**/third_party/** vendored
**/third-party/** vendored
**/thirdparty/** vendored
**/3rdparty/** vendored
**/3rd-party/** vendored
**/3rd_party/** vendored
**/extern/** vendored
**/external/** vendored
**/externals/** vendored
**/deps/** vendored
**/Godeps/** vendored
**/bower_components/** vendored
**/node_modules/** vendored
**/jspm_packages/** vendored
**/web_modules/** vendored
**/site-packages/** vendored
**/dist-packages/** vendored
**/Pods/** vendored
*-[0-9]*.[0-9]*.[0-9]*.* vendored
*_pb2.py generated
*_pb2.pyi generated
*_pb2_grpc.py generated
*.pb.* generated
*_pb.js generated
*_pb.d.ts generated
*.generated.* generated
*.gen.* generated
*_gen.* generated
*_generated.* generated
*_autogen.* generated
*.autogen.* generated
zz_generated.* generated
**/__generated__/** generated
*.min.js generated
*.min.mjs generated
*-min.js generated
*.bundle.js generated
*.prod.js generated
**/chunk-[0-9a-f][0-9a-f][0-9a-f][0-9a-f][0-9a-f][0-9a-f][0-9a-f].*js generated
*.[0-9a-f][0-9a-f][0-9a-f][0-9a-f][0-9a-f][0-9a-f][0-9a-f].js generated
"""

# What tools and copiers write into comments, in lower case.
GENERATED = re.compile(r"code generated (?:by|from)\b.*do not edit|^[\s/*#<!-]*@generated\b|<auto-?generated ?/?>|^[\s/*#-]*(?:this (?:file|code|module) (?:is|was|has been) )?(?:auto-?(?:matically )?generated|automatically (?:generated|created|produced))\b"
                       r"|^[\s/*#-]*generated (?:by|from|with)\b|^[\s/*#-]*(?:machine|tool|program) output (?:of|from)\b|(?:manual |hand )?(?:edits|changes) (?:are|will be) (?:lost|overwritten|discarded)\b|automatisch (?:erzeugt|generiert)|nicht von hand bearbeiten|fichier (?:produit|généré|créé) (?:par|automatiquement)|ne pas modifier|archivo generado|no (?:editar|modificar)\b|arquivo gerado|não (?:editar|modificar)\b|généré automatiquement|generado automáticamente|gerado automaticamente|自动生成|自動生成|^[\s/*#-]*generator: \S+$")
VENDORED = re.compile(r"bundled copy of|imported from upstream|(?:send|report|make|upstream) (?:fixes|changes|patches) (?:belong )?(?:upstream|there)\b|upstream fixes belong|vendored (?:from|copy)|copied (?:verbatim )?from|^[\s/*#!-]*\S+ v?\d+\.\d+(?:\.\d+)?\S* --? \(c\)|\(c\) (?:\d{4}(?:-\d{4})? )?the (\S+) authors|distributed under the \S+ licen[cs]e")

_C = re.compile(r"""(?P<comment>//[^\n]*|/\*.*?\*/)|(?P<string>r(?P<h>\#*)"(?:.*?)"(?P=h)|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)'|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`)|(?P<number>\b\d[\w.]*)|(?P<word>[A-Za-z_$]\w*)""", re.S)
_RUST = re.compile(r"""(?P<comment>//[^\n]*|/\*.*?\*/)|(?P<string>r(?P<h>\#*)"(?:.*?)"(?P=h)|b?"(?:[^"\\]|\\.)*"|b?'(?:[^'\\\n]|\\.)')|(?P<number>\b\d[\w.]*)|(?P<word>[A-Za-z_$]\w*)""", re.S)
_PY = re.compile(r'''(?P<comment>\#[^\n]*)|(?P<string>"""(?:[^\\]|\\.)*?"""|\'\'\'(?:[^\\]|\\.)*?\'\'\'|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')|(?P<number>\b\d[\w.]*)|(?P<word>[A-Za-z_$]\w*)''', re.S)


def traits(path: str, raw: bytes) -> tuple[bool, bool, bool, bool, str]:
    """``generated, vendored, minified, data`` by content, and a hash of the code without its comments and blanks."""
    text = raw.decode(errors="replace").replace("﻿", "").replace("\r\n", "\n")
    scan = _PY if path.endswith((".py", ".pyi")) else _RUST if path.endswith(".rs") else _C
    comments, code = [], []
    strings = numbers = words = end = 0
    for m in scan.finditer(text):
        code.append(text[end : m.start()])
        end = m.end()
        kind = m.lastgroup if m.lastgroup != "h" else "string"
        if kind == "comment":
            comments.append((m.start(), m[0]))
            continue
        code.append(m[0])
        size = end - m.start()
        if kind == "string":
            strings += size
        elif kind == "number":
            numbers += size
        else:
            words += size
    code.append(text[end:])
    body = "".join("".join(code).split())
    generated = any(GENERATED.search(line) for _, c in comments for line in c.lower().split("\n"))
    vendored = any(VENDORED.search(line) for _, c in comments for line in c.lower().split("\n"))
    lines = text.split("\n")
    long = [line for line in lines if len(line) > 250]
    wide = sum(map(len, long))
    blanks = sum(line.count(" ") + line.count("\t") for line in long)
    literal = strings + numbers
    size = max(1, len(body))
    data = literal >= 0.55 * size and words <= 0.12 * size and len(body) > 120
    minified = not data and wide >= 0.6 * max(1, len(text)) and blanks <= 0.12 * wide and path.endswith(("js", "jsx", "ts", "tsx", "css"))
    return generated, vendored, minified, data, xxhash.xxh128_hexdigest(body)


#: The hash of a file that holds no code; such files are no copies of each other.
NO_CODE = xxhash.xxh128_hexdigest("")


@frame_stage
def _look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        got = [traits(p, bytes(c)) for p, c in zip(pdf["path"], pdf["content"])]
        yield pd.concat([pdf[["file_id", "repo", "path"]].reset_index(drop=True), pd.DataFrame(got, columns=["generated", "vendored", "minified", "data", "body"])], axis=1)


def glob_regex(glob: Column) -> Column:
    """An attribute file's glob as a regular expression over the path below its directory.

    Without a slash it matches the file name at any depth; ``**`` crosses directories, ``*`` and ``?`` do not.
    """
    placed = F.when(F.substring(glob, 1, 1) == "/", F.substr(glob, F.lit(2))).when(F.contains(F.regexp_replace(glob, "/$", ""), F.lit("/")), glob).otherwise(F.concat(F.lit("**/"), glob))
    whole = F.when(placed.endswith("/"), F.concat(placed, F.lit("**"))).otherwise(placed)
    quoted = F.regexp_replace(whole, r"([.+^$(){}|\\])", r"\\$1")
    steps = [(r"\*\*/", "\u0001"), (r"/\*\*", "\u0002"), (r"\*", "[^/]*"), (r"\?", "[^/]"), ("\u0001", "(?:.*/)?"), ("\u0002", "/.*")]
    for old, new in steps:
        quoted = F.regexp_replace(quoted, old, new)
    return F.concat(F.lit("^"), quoted, F.lit("$"))


def attribute_rules(files: DataFrame) -> DataFrame:
    """``repo, scan_id, dir, depth, line_no, regex, mark`` of the attribute files (``.gitattributes``) among ``files``.

    ``mark`` is vendored, generated or none (the attribute unset or false), for the attributes that end in those words.
    """
    texts = files.where(file_name(F.col("path")) == ".gitattributes").where("content is not null")
    lines = texts.select("repo", "scan_id", parent_dir(F.col("path")).alias("dir"), F.posexplode(F.split(F.decode("content", "UTF-8"), r"\r?\n")).alias("line_no", "line"))
    parts = lines.select("*", F.split(F.trim("line"), r"\s+").alias("p")).where((F.size("p") >= 2) & ~F.col("line").startswith("#"))
    marks = parts.select("repo", "scan_id", "dir", "line_no", F.col("p")[0].alias("glob"), F.explode(F.slice("p", 2, 100)).alias("attribute"))
    said = marks.select("*", F.regexp_extract("attribute", r"^([-!]?)(?:[\w]+-)?(vendored|generated)(?:=(\w+))?$", 2).alias("kind"), (F.col("attribute").rlike("^[-!]") | F.col("attribute").rlike("=(false|0|no)$")).alias("off")).where("kind <> ''")
    depth = F.when(F.col("dir") == "", 0).otherwise(F.size(F.split("dir", "/")))
    return said.select("repo", "scan_id", "dir", depth.alias("depth"), "line_no", glob_regex(F.col("glob")).alias("regex"), "kind", "off")


def declared_marks(files: DataFrame) -> DataFrame:
    """``file_id, kind, off``: what attribute files say of each file, by the deepest directory and there the last line that matches."""
    rules = attribute_rules(files)
    below = files.select("file_id", "repo", "scan_id", "path", F.explode(path_prefixes(F.col("path"))).alias("dir"))
    rest = F.when(F.col("dir") == "", F.col("path")).otherwise(F.substr("path", F.length("dir") + 2))
    # the lines of one attribute file stay one row, so a directory of many files meets one row, not one for each line
    listed = rules.groupBy("repo", "scan_id", "dir", "depth").agg(F.collect_list(F.struct("line_no", "regex", "kind", "off")).alias("lines"))
    met = below.join(listed, ["repo", "scan_id", "dir"]).withColumn("rest", rest)
    hits = met.select("file_id", "depth", F.explode(F.filter("lines", lambda r: F.regexp_like("rest", r["regex"]))).alias("r")).select("file_id", "depth", "r.line_no", "r.kind", "r.off")
    return hits.groupBy("file_id", "kind").agg(F.max_by("off", F.struct("depth", "line_no")).alias("off"))


def governed_files(files: DataFrame, paths: DataFrame) -> DataFrame:
    """``file_id, governed`` of the files of ``paths`` below a directory whose attribute file (among ``files``) says what is vendored or generated."""
    dirs = attribute_rules(files).select("repo", "scan_id", "dir").distinct()
    below = paths.select("file_id", "repo", "scan_id", F.explode(path_prefixes(F.col("path"))).alias("dir"))
    return below.join(dirs, ["repo", "scan_id", "dir"], "left_semi").select("file_id").distinct().withColumn("governed", F.lit(True))


def convention_mark(path: Column) -> Column:
    """The mark that the conventions give a path, the last matching line deciding; null for none."""
    lines = [line.split() for line in CONVENTIONS.split("\n") if line.strip()]
    by_mark = {}
    for glob, mark in lines:
        by_mark.setdefault(mark, []).append(_plain_regex(glob))
    marks = [F.when(path.rlike("|".join(f"(?:{r})" for r in regexes)), F.lit(mark)) for mark, regexes in by_mark.items()]
    return F.coalesce(*reversed(marks))


def _plain_regex(glob: str) -> str:
    glob = glob if "/" in glob else f"**/{glob}"
    out = re.sub(r"([.+^$(){}|\\])", r"\\\1", glob)
    out = out.replace("**/", "\1").replace("/**", "\2").replace("*", "[^/]*").replace("?", "[^/]")
    return f"^{out}$".replace("\1", "(?:.*/)?").replace("\2", "/.*")


def path_shapes(path: Column) -> Column:
    """Patterns that a path could be an instance of: each of its directories, and its name with the leading word left open."""
    dirs = F.transform(F.filter(F.split(parent_dir(path), "/"), lambda d: d != ""), lambda d: F.concat(F.lit("**/"), d, F.lit("/**")))
    tail = F.regexp_replace(file_name(path), r"^[A-Za-z]+(?=[._-])", "*")
    head = F.regexp_replace(file_name(path), r"(?<=[_-])[A-Za-z]+(?=\.)", "*")
    return F.array_distinct(F.concat(dirs, F.filter(F.array(tail, head), lambda s: F.contains(s, F.lit("*")) & s.rlike(r"[A-Za-z]{3,}.*\."))))


def mined_shapes(looked: DataFrame, min_files: int = 12, min_repos: int = 4, min_share: float = 0.9) -> DataFrame:
    """``shape``: path patterns of which nearly all files, over several repositories, bear marks of tools in their content or by declaration."""
    shapes = looked.select("repo", "marked", F.explode(path_shapes(F.col("path"))).alias("shape"))
    counted = shapes.groupBy("shape").agg(F.count("*").alias("files"), F.count_if("marked").alias("marked"), F.count_distinct("repo").alias("repos"))
    return counted.where((F.col("files") >= min_files) & (F.col("repos") >= min_repos) & (F.col("marked") >= min_share * F.col("files"))).select("shape")


def machine_files(source_files: DataFrame, skipped_files: DataFrame) -> DataFrame:
    """``file_id, reason, part`` of files not written by hand: generated, vendored, minified or data, and which part told.

    In this order: an attribute file's mark for the path decides, either way; then content: comments of tools and
    copiers, the shape of minified code, and code that is all literals; then, where no attribute file governs the path,
    path patterns mined from the corpus, whose files are nearly all declared or marked by content; last the conventions,
    which stand for attribute files where there are none and the corpus shows no pattern. An attribute file with such marks governs what is below its directory. Code whose text without comments equals that of a vendored file is a copy of it. Skipped files are judged
    by path and reason; too large and binary ones are data. Null content leaves the path; null paths and ids give
    nothing; repeated rows count once; empty tables give no rows; content of any length is read whole.
    """
    walked = source_files.where("file_id is not null and rel_path is not null").select("file_id", "scan_id", "repo", plain_path(F.col("rel_path")).alias("path"), "content")
    skipped = skipped_files.where("file_id is not null and rel_path is not null").select("file_id", "scan_id", "repo", plain_path(F.col("rel_path")).alias("path"), F.col("reason.tag").alias("tag"))
    seen = walked.where("content is not null").select("file_id", "repo", "path", "content")
    kind = source_files.schema["file_id"].dataType.simpleString()
    looked = spread(seen).mapInPandas(_look, f"file_id {kind}, repo string, path string, generated boolean, vendored boolean, minified boolean, data boolean, body string")
    looked = stage(looked.withColumn("convention", convention_mark(F.col("path"))))
    by_content = F.when(F.col("generated"), F.lit("generated")).when(F.col("vendored"), F.lit("vendored")).when(F.col("minified"), F.lit("minified")).when(F.col("data"), F.lit("data"))
    paths = walked.select("file_id", "scan_id", "repo", "path", F.lit(None).cast("string").alias("tag")).unionByName(skipped)
    declared = stage(declared_marks(walked).groupBy("file_id").agg(F.max(F.when(~F.col("off"), F.col("kind"))).alias("declared"), F.bool_and("off").alias("kept")))
    governed = stage(governed_files(walked, paths))
    known_marks = looked.join(declared, "file_id", "left").join(governed, "file_id", "left").withColumn("convention", F.when(F.col("governed").isNull(), F.col("convention")))
    own = F.coalesce(F.col("declared").isNotNull() | F.col("by_content").isNotNull(), F.lit(False)) & ~(F.col("declared").isNull() & F.coalesce("kept", F.lit(False)))
    marked = known_marks.withColumn("by_content", by_content).withColumn("marked", own)
    originals = marked.where("vendored or convention = 'vendored' or declared = 'vendored'").where(F.col("body") != NO_CODE).select("body").distinct().withColumn("copied", F.lit(True))
    known = mined_shapes(marked)
    mined = paths.select("file_id", F.explode(path_shapes(F.col("path"))).alias("shape")).join(known, "shape", "left_semi").select("file_id").distinct().withColumn("mined", F.lit(True))
    content = marked.join(originals, "body", "left").select("file_id", "by_content", "copied")
    joined = paths.join(declared, "file_id", "left").join(governed, "file_id", "left").join(content, "file_id", "left").join(mined, "file_id", "left")
    free = F.col("governed").isNull()
    by_part = {
        "declared": F.col("declared"), "kept": F.when(F.col("kept"), F.lit("hand")), "skipped": F.when(F.col("tag").isin("TooLarge", "Binary"), F.lit("data")), "content": F.col("by_content"),
        "copied": F.when(F.col("copied"), F.lit("vendored")), "mined": F.when(F.col("mined") & free, F.lit("generated")), "convention": F.when(free, convention_mark(F.col("path")))}
    reason = F.coalesce(*by_part.values())
    part = F.coalesce(*[F.when(c.isNotNull(), F.lit(name)) for name, c in by_part.items()])
    told = joined.withColumn("reason", reason).withColumn("part", part).where("reason is not null and reason <> 'hand'")
    return told.groupBy("file_id").agg(F.min("reason").alias("reason"), F.min("part").alias("part"))
