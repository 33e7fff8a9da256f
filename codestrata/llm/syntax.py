"""Source files that do not parse in their language, by generalised LL over all dialects of a file's extension at once."""

from __future__ import annotations

import functools
import gc
import io
import tokenize
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codestrata.functions.paths import extension
from codestrata.llm import grammars, lexers
from codestrata.llm.gll import EOF, NL, Grammar, recognise
from codestrata.session import frame_stage, spread, stage

#: Extension: (grammar text, dialects of the grammar, start rules, lexer, markup).
_JS_STARTS = ("Module", "Script")
LANGUAGES = {
    "py": (grammars.PYTHON, (), ("File",), lexers.python),
    "js": (grammars.ECMA, ("notjsx",), _JS_STARTS, lexers.ecma),
    "jsx": (grammars.ECMA, ("jsx",), _JS_STARTS, functools.partial(lexers.ecma, markup=True)),
    "ts": (grammars.ECMA, ("ts", "notjsx"), _JS_STARTS, lexers.ecma),
    "tsx": (grammars.ECMA, ("ts", "jsx"), _JS_STARTS, functools.partial(lexers.ecma, markup=True)),
    "rs": (grammars.RUST, (), ("File",), lexers.rust),
    "go": (grammars.GO, (), ("File",), lexers.go),
}
#: Extensions that mean the same language.
SAME = {"pyi": "py", "mjs": "js", "cjs": "js", "mts": "ts", "cts": "ts"}


@functools.cache
def grammar_of(language: str) -> Grammar:
    text, dialects, starts, _ = LANGUAGES[language]
    return Grammar(text, list(starts), frozenset(dialects))


def parses(language: str, text: str) -> bool:
    """Whether some dialect of the language derives the text. Blank texts parse in every language."""
    starts, lexer = LANGUAGES[language][2:]
    tokens = lexer(text)
    if tokens is None:
        return False
    if len(tokens) == 1 and language != "go" or not text.strip("﻿ \t\r\n\f"):
        return True
    return bool(recognise(grammar_of(language), tokens, list(starts)))


def decoded(language: str, raw: bytes) -> str | None:
    """The text of a file: UTF-8, for Python the encoding that its first two lines name; None where the bytes do not fit it."""
    try:
        if language == "py" and b"coding" in b"".join(raw.split(b"\n", 2)[:2]):
            return raw.decode(tokenize.detect_encoding(io.BytesIO(raw).readline)[0])
        return raw.decode()
    except (UnicodeDecodeError, SyntaxError, LookupError):
        return None


@frame_stage
def _judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    gc.disable()  # the stack graphs hold many small tuples and hardly any rings
    try:
        yield from _verdicts(batches)
    finally:
        gc.enable()


def _verdicts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        gc.collect()
        verdicts = []
        for kind, raw in zip(pdf["kind"], pdf["content"]):
            text = decoded(kind, bytes(raw))
            verdicts.append(text is not None and parses(kind, text))
        yield pdf[["digest", "kind"]].assign(parses=verdicts)


def language_key(path: Column) -> Column:
    """The key in LANGUAGES of a path's extension, else null."""
    ext = extension(path)
    same = F.coalesce(*[F.when(ext == a, F.lit(b)) for a, b in SAME.items()], ext)
    return F.when(same.isin(*LANGUAGES), same)


def judged_files(files: DataFrame) -> DataFrame:
    """``file_id, repo, language, parses``: false where every dialect of the language of the extension rejects the content, null where there is no content or no known extension.

    Content that repeats under the same language is parsed once. Bytes that are no UTF-8 (in Python: of the encoding that the file names) do not parse; blank contents
    parse. Null paths and repeated rows are judged like others; a file of any length is parsed whole, in one row; empty
    tables give none; other columns are ignored.
    """
    keyed = files.select("file_id", "repo", "language", "content", language_key(F.col("rel_path")).alias("kind"), F.sha2("content", 256).alias("digest"))
    once = keyed.where("content is not null and kind is not null").groupBy("digest", "kind").agg(F.any_value("content").alias("content"))
    verdicts = spread(once, "digest", "kind", shuffled=True).mapInPandas(_judge, "digest string, kind string, parses boolean")
    return keyed.drop("content").join(verdicts, ["digest", "kind"], "left").select("file_id", "repo", "language", "parses")


def broken_files(files: DataFrame) -> DataFrame:
    """``file_id`` of every file whose content does not parse."""
    return judged_files(files).where(~F.col("parses")).select("file_id")


def broken_rates(files: DataFrame) -> DataFrame:
    """``repo, language, files, broken, rate`` over files with content; a null language is taken from the extension's files as it stands (null)."""
    told = judged_files(files).where("parses is not null")
    return told.groupBy("repo", "language").agg(F.count("*").alias("files"), F.count_if(~F.col("parses")).alias("broken")).withColumn("rate", F.col("broken") / F.col("files"))
