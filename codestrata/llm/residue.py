"""Documents that hold no real content: unfilled templates, filler, error pages and script notices."""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.session import frame_stage, spread, stage

# The ways in which template languages and people write a slot, by style; group 1 is the variable's name.
STYLES = {
    "triple": r"\{\{\{\s*([\w ]*?)\s*\}\}\}",
    "double": r"\{\{-?\s*([\w .]*?)\s*(?:\|[^{}]*)?-?\}\}",
    "tag": r"\{%-?\s*([\w ]+?)\s*-?%\}",
    "erb": r"<%=?\s*([\w .]+?)\s*%>",
    "dollar": r"\$\{\s*([\w.]+)\s*\}",
    "dollars": r"\$([A-Za-z]\w+)\$",
    "hash": r"#\{\s*([\w.]+)\s*\}",
    "percent": r"%\(([\w ]+)\)[sd]",
    "percents": r"%([A-Z][A-Z0-9_]+)%",
    "ats": r"@@(\w+?)@@",
    "marks": r"\?\?\?(\w+)\?\?\?",
    "under": r"(?<!\w)__([A-Z][A-Z0-9_]*?)__(?!\w)",
    "angle": r"<\s*([A-Za-z][\w \-]*?)[ _](?:goes[ _])?(?:here|HERE)\s*>",
    "angle_your": r"<\s*(?:your|YOUR|Your|insert|INSERT)[ _\-]([\w \-]+?)\s*>",
    "square_todo": r"\[(?:TODO|INSERT|Insert|FIXME|TBD|ENTER|Enter|ADD)\b:?\s*([\w ]*?)\]",
    "square_your": r"\[(?:your|Your|YOUR)\s+([\w ]+?)\]",
    "wiki": r"\[\[\s*([\w ]+?)\s*\]\]",
    "quotes": r"«\s*(\w+)\s*»",
    "supplied": r"\(([\w ]+?) (?:to be (?:supplied|added|confirmed|filled in|completed)|goes here)\)",
    "single": r"(?<![\w$#{])\{([A-Za-z_]\w*)\}(?!\})",
    "blank": r"(?<!\w)_{4,}(?!\w)()",
}
#: Styles that ordinary prose may also use; they count only with a name known as a variable.
WEAK = frozenset(["single", "quotes", "wiki", "under", "supplied", "blank", "dollars"])
_SLOT = re.compile("|".join(f"(?P<{k}>{v})" for k, v in STYLES.items()))
_NAMES = {k: re.compile(v) for k, v in STYLES.items()}

# Whole sentences (lower case, digits as 9) of filler, of error pages and of script notices.
FILLER = [
    r"lorem ipsum\b.*", r"(?:text )*text text\.?", r"(?:blah ?)+\.?", r"asdf.*", r"(?:your|the) (?:\w+ )?(?:description|text|content|title|name|summary) goes here\.?",
    r"add (?:a|an|your) (?:short |brief )?\w+ (?:of|for|about) the \w+ (?:in this space|here)\.?", r"write (?:\w+ )+about the \w+ here\.?", r"sample (?:paragraph|text).*(?:layout|purposes).*",
    r"this is (?:a )?(?:placeholder|dummy|sample|filler)(?: text)?\.?", r"replace (?:it|this) before publishing\.?", r"coming soon: content for this section\.?", r"(?:placeholder|dummy|filler) text.*",
    r"beschreibung hier einfügen\.?", r"blindtext, bitte .*", r"hier (?:steht|folgt) (?:später|noch|bald) (?:ein )?text\.?", r"platzhaltertext.*",
    r"saisissez ici .*", r"texte? (?:provisoire|de remplissage).*", r"escriba aquí .*", r"texto de (?:relleno|ejemplo).*", r"(?:insira|escreva) aqui .*", r"texto (?:provisório|de exemplo|de preenchimento).*",
    r"ここに.*(?:入り|入力|書).*", r"ダミーテキスト.*", r"(?:此处|这里)(?:为|是)占位.*", r"(?:请)?在此处?(?:输入|填写|添加).*", r"占位(?:文本|文字).*",
]
ERRORS = [
    r"(?:error|erreur|fehler|erro)? ?9?:? ?[-–:]? ?.{0,30}\b(?:not found|introuvable|nicht gefunden|no encontrada|não encontrada)\b(?: \(9\))?\.?", r"(?:9 )?(?:forbidden|bad gateway|internal server error|service unavailable|gateway timeout|bad request|unauthorized|gone|too many requests)\.?",
    r"(?:9 [-–] )?this page does not exist\.?", r"error 9: .*", r"rate limit exceeded\.?", r"too many requests\.?", r"access denied\.?", r"request blocked\.?", r"database connection refused(?: \(errno 9\))?\.?",
    r"(?:gateway|upstream|request|connection) (?:timeout|timed out|reset)\b.{0,50}", r"your session has expired.*", r"we can.t find the page you were looking for\.?", r"the requested (?:document|page|url|file) (?:could not be (?:located|found)|was not found).*", r"something went wrong(?: on our side)?\.?",
    r"the server (?:met|encountered) a problem.*", r"you do not have (?:access|permission) to .{0,30}", r"sorry, the file is too large to be shown\.?", r"this repository is empty or you lack permission.*", r"oops!?.{0,30}",
    r".{0,24}(?:ページが見つかりません|页面未找到|页面不存在|找不到页面|サーバーエラーが発生しました|アクセスが拒否されました|拒绝访问|访问被拒绝|服务器(?:内部)?错误|服务暂时不可用).*", r"die angeforderte seite existiert nicht(?: mehr)?\.?", r"interner serverfehler\.?",
    r"zugriff verweigert\.?", r"accès refusé\.?", r"acceso denegado\.?", r"acesso negado\.?", r"le service est (?:momentanément|temporairement) indisponible\.?", r"erreur interne du serveur\.?", r"error interno del servidor\.?", r"erro interno do servidor\.?",
    r"(?:el servicio no está disponible|o serviço está (?:temporariamente )?indisponível).*", r"der dienst ist .*nicht (?:verfügbar|erreichbar)\.?",
]
SCRIPTS = [
    r"(?:please |you need to |you must )?(?:enable|turn on|switch on|allow|activate) (?:javascript|js|scripts?)\b.{0,60}", r"(?:this|the) (?:app|site|page|application|website)\b.{0,40}\b(?:works only with|requires|needs) (?:javascript|js|scripts?)\b.{0,30}",
    r"javascript (?:is|must be|has been) (?:disabled|required|enabled|turned off|off)\b.{0,40}", r"scripts and cookies must be allowed\.?", r"(?:loading…? ?)?if nothing happens, script support may be switched off\.?", r"switch (?:js|javascript) on\b.{0,60}",
    r"your browser (?:does not|cannot) (?:run|support) (?:scripts|javascript).{0,60}", r".{0,20}navegador.{0,30}(?:scripts|javascript).{0,30}", r"one moment, we are testing your browser…?", r"sorry, .{0,60} cannot run here while (?:javascript|js) is off\.?", r"(?:bitte )?aktivieren sie (?:bitte )?javascript.{0,50}", r"diese (?:anwendung|seite) benötigt (?:skripte|javascript).{0,40}",
    r"(?:veuillez )?activer? javascript.{0,60}", r"les scripts sont désactivés.{0,50}", r"active (?:el )?javascript.{0,50}", r"ative o javascript.{0,50}", r"(?:esta|este) .{0,40}(?:necesita|requiere|precisa de|requer) javascript.{0,30}",
    r".{0,30}javascript ?を(?:有効|オン)に.{0,30}", r".{0,10}(?:请启用|需要启用|请开启|请打开) ?javascript.{0,30}", r".{0,30}(?:スクリプト|脚本).{0,6}(?:無効|有効|禁用|启用).{0,30}",
]
_FILLER, _ERROR, _SCRIPT = (re.compile("|".join(f"(?:{p})" for p in ps)) for ps in (FILLER, ERRORS, SCRIPTS))
# The words of the usual Latin filler.
LATIN = frozenset("""lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco
laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui
officia deserunt mollit anim id est laborum vitae pretium congue varius turpis auctor quam neque sapien risus sodales felis lacus mattis mollis semper feugiat ornare porta""".split())

_FENCE = re.compile(r"^[ \t]*(```|~~~).*?(?:^[ \t]*\1[^\n]*$|\Z)", re.S | re.M)
_TAG = re.compile(r"</?(?:html|head|title|body|h\d|hr|p|div|span|center|noscript|br|a|main|section|meta|address)\b[^<>]*>", re.I)
_QUOTED = re.compile(r"(?<!\w)'[^'\n]{1,60}'(?!\w)|\"[^\"\n]{1,80}\"|“[^”\n]{1,80}”|„[^“\n]{1,80}“")
_SPLIT = re.compile(r"(?<=[.!?…])\s+|(?<=[。！？])\s*|\n+")
_CHROME = re.compile(r"(?:[\w ]{2,16}(?: ?[|·/] ?|$)){3,}|(?:ref|id|incident id|request id|code|reference|trace)\b[ :#]*[\w\-]{0,24}\.?|[-=_*#\s]*|[a-z]+d?/9\.9|traceback:?|(?:at|file) .{0,90}|\S+:9(?: in \w+)?|\w*error: .{0,60}|© ?9.{0,30}|loading…?")
_JSON = re.compile(r'^\s*\{.*"(?:error|message|detail)"\s*:\s*"([^"]*)".*\}\s*$', re.S)


def may_hold_slot(text: str) -> bool:
    """Whether a text has the characters that every one of STYLES needs; most have not, which spares trying them at every character."""
    return ("{" in text or "<" in text or "[" in text or "$" in text or "%" in text or "__" in text or "@@" in text or "???" in text or "«" in text
            or "(" in text and ("to be " in text or "goes here)" in text))


def sentences(text: str) -> Iterator[tuple[str, list[tuple[str, str]], str, str]]:
    """``(skeleton, slots, role, the skeleton with its capitals)`` of every sentence outside code and quotes.

    In a skeleton digits are 9, code and quotes are a mark, and slots are another; slots are (style, variable name);
    role is filler, core (an error or a script notice), chrome or text.
    """
    text = text.replace("\r\n", "\n").replace("\r", "\n").replace("\xa0", " ").replace("​", "").replace("﻿", "")
    body = _JSON.match(text)
    text = body[1].replace("\\n", "\n") if body else _TAG.sub("\n", text)
    text = _FENCE.sub("\n", text)
    text = re.sub(r"`[^`\n]*`", "`", text)
    first, _, more = text.strip().partition("\n")
    title = " ".join(first.split()) if more.strip() and not re.search(r"[.!?。！？…]$", first.strip()) and len(first) <= 90 else None
    for raw in _SPLIT.split(text):
        raw = " ".join(raw.split())
        if not raw:
            continue
        slots = []

        def slot(m: re.Match) -> str:
            name = next((g for g in _NAMES[m.lastgroup].fullmatch(m[0]).groups() if g), "") if _NAMES[m.lastgroup].fullmatch(m[0]) else ""
            slots.append((m.lastgroup, re.sub(r"[\s\-]+", "_", re.sub(r"(?<=[a-z])(?=[A-Z])", "_", name)).lower()))
            return "¤"

        quoted = _QUOTED.sub("“", raw)
        masked = _SLOT.sub(slot, quoted) if may_hold_slot(quoted) else quoted
        skeleton = re.sub(r"\d+", "9", masked.lower())
        line = re.sub(r"^[-*•#>\s]*(?:9[.)]\s+)?", "", skeleton)
        cased = re.sub(r"^[-*•#>\s]*(?:9[.)]\s+)?", "", re.sub(r"\d+", "9", masked))
        plain = line if line.isascii() else "".join(c for c in unicodedata.normalize("NFKD", line) if not unicodedata.combining(c))
        role = listed_role(line, plain)
        if role:
            pass
        elif raw == title and not slots or _CHROME.fullmatch(line) or not re.search(r"\w", line):
            role = "chrome"
        else:
            role = "text"
        yield line, slots, role, cased


_LETTERS = re.compile(r"[a-z]+")


@functools.lru_cache(1 << 12)
def listed_role(line: str, plain: str) -> str | None:
    """filler or core for a line (as it stands, and without marks on letters) that the fixed lists know."""
    forms = (line,) if line == plain else (line, plain)
    words = _LETTERS.findall(plain)
    if any(_FILLER.fullmatch(x) for x in forms) or len(words) >= 4 and sum(w in LATIN for w in words) >= 0.8 * len(words):
        return "filler"
    return "core" if any(p.fullmatch(x) for p in (_ERROR, _SCRIPT) for x in forms) else None


# What the fill of an opened position is: any value, a blank, a name in marks of an unknown kind, a shouted or bracketed word, a placeholder of a weak or a strong style.
VALUE, BLANK, MARKED, NAMED, WEAKLY, PLACEHOLDER, DEFAULT = range(7)
#: The kind of a line as a whole, without an open position; and what is added where little of a line is left beside it.
WHOLE, THIN = -1, 16
#: Weak styles that nobody uses for a value; links, quotes, sums and format strings are values as well as slots.
UNFILLED = frozenset(["blank", "under", "supplied"])
# Defaults that people leave in a slot.
DEFAULTS = frozenset("tbd tba tbc todo fixme changeme n/a xx xxx xxxx john_doe jane_doe yyyy-mm-dd dd/mm/yyyy dd.mm.yyyy platzhalter".split())
_HAN = "\u3400-\u9fff\uf900-\ufaff"
_PIECE = re.compile(rf"([{_HAN}])|([\u3040-\u30ff]+)|([\uac00-\ud7af]+)|([。、，．！？：；])|([^\s{_HAN}\u3040-\u30ff\uac00-\ud7af。、，．！？：；]+)")
_IS_HAN = re.compile(f"[{_HAN}]")
_GAP = re.compile(r"(?<=\w) (?=[,.](?:\s|$))")
_BLANKS = re.compile(r"_{2,}|\.{3,}|…+|-{3,}|\?{2,}|▁|\[\]|<>|\(\)")
_IN_MARKS = re.compile(r"([~^|%#@=+&$:]{1,3}|<|§+)([A-Za-z][\w-]*)([~^|%#@=+&$:]{1,3}|>|§+)")
_IN_BRACKETS = re.compile(r"[\[({<]([A-Za-z][\w-]*)[\])}>]|([A-Z][A-Z0-9_]{2,})")


def segments(line: str) -> list[str]:
    """Words with the marks behind them apart; where scripts have no blanks, Han characters one by one and runs of other letters."""
    out = []
    for word in _GAP.sub(" ▁ ", line).split():
        for piece in [word] if word.isascii() else [m[0] for m in _PIECE.finditer(word)]:
            core = piece.rstrip(",.;:!?") or piece
            out.append(core)
            if core != piece:
                out.append(piece[len(core) :])
    return out


def _signed(x: int) -> int:
    x = (x ^ (x >> 29)) * 0xBF58476D1CE4E5B9 & _ALL
    x ^= x >> 32
    return x - (1 << 64) if x >> 63 else x


_ALL = (1 << 64) - 1


@functools.lru_cache(1 << 16)
def _hash(word: str) -> int:
    """The same as ``xxhash64`` of Spark, without a sign."""
    return xxhash.xxh64_intdigest(word, seed=42)


def opened(parts: list[str]) -> list[tuple[int, int, int]]:
    """``(key, from, to)`` of a line of :func:`segments` with each position left open, to(exclusive).

    Lines of one template have equal keys at a slot. A position is one segment, up to four Han characters, or all that
    follows a colon. The work is in proportion to the line, as a key is made of a running hash from either end.
    """
    n = len(parts)
    hashes = [_hash(w) for w in parts]
    out = []
    before, behind = [1], [7]
    for h in hashes:
        before.append((before[-1] * 0x9E3779B97F4A7C15 + h) & _ALL)
    for h in reversed(hashes):
        behind.append((behind[-1] * 0xC2B2AE3D27D4EB4F + h) & _ALL)
    behind.reverse()
    key = lambda i, j: _signed((before[i] * 0x165667B19E3779F9 + behind[j] * 0x27D4EB2F165667C5) & _ALL)
    for i, word in enumerate(parts):
        if n > 1 and (word not in _STOPS):
            out.append((key(i, i + 1), i, i + 1))
        if len(word) == 1 and not word.isascii() and _IS_HAN.match(word):
            for j in range(i + 2, min(n, i + 4) + 1):
                if not _IS_HAN.match(parts[j - 1]):
                    break
                out.append((key(i, j), i, j))
    colon = next((i for i, word in enumerate(parts[:8]) if word in (":", "：")), n)
    if colon + 2 < n:
        out.append((key(colon + 1, n), colon + 1, n))
    return out


_STOPS = frozenset([",", ".", ";", ":", "!", "?", "。", "、", "，", "．", "！", "？", "：", "；"])


@functools.lru_cache(1 << 14)
def fills(line: str, cased: str, styles: tuple[str, ...]) -> list[tuple[int, int, int]]:
    """``(key, hash of the fill, kind of the fill)`` of each opened position of a line; ``styles`` are those of its placeholders in order."""
    parts, shown = segments(line), segments(cased)
    if len(shown) != len(parts):
        shown = parts
    calm = any(c.islower() for c in cased)  # in a text of capitals a shouted word is no sign
    order = iter(styles)
    style = {i: next(order, "double") for i, word in enumerate(parts) for _ in range(word.count("¤"))}
    out = []
    left = rest_weights(parts)
    for key, i, j in opened(parts):
        if parts[i] in ("`", "“"):  # code and quotes are not looked into
            continue
        if j == i + 1 and parts[i].isalpha() and parts[i] not in DEFAULTS and not shown[i].isupper():
            h = _hash(parts[i])
            out.append((key, h - (1 << 64) if h >> 63 else h, VALUE + THIN * (left(i, j) < 2)))
            continue
        word = "_".join(shown[i:j])
        low = "_".join(parts[i:j])
        kind = VALUE
        if "¤" in low:
            got = style[next(k for k in range(i, j) if "¤" in parts[k])]
            kind = (WEAKLY if got in UNFILLED else VALUE) if got in WEAK else PLACEHOLDER
        elif _BLANKS.fullmatch(low):
            kind = BLANK
        elif low in DEFAULTS:
            kind = DEFAULT
        elif not word.isalpha() or word.isupper():
            marked = _IN_MARKS.fullmatch(word)
            named = None if marked else _IN_BRACKETS.fullmatch(word)
            if marked and (marked[1] == marked[3] or marked[1] == "<" and marked[3] == ">"):
                kind, low = MARKED, marked[2].lower()
            elif named and (calm or named[1]):
                kind, low = NAMED, (named[1] or named[2]).lower()
        h = _hash(low.replace("-", "_"))
        out.append((key, h - (1 << 64) if h >> 63 else h, kind + THIN * (left(i, j) < 2)))
    return out


def rest_weights(parts: list[str]) -> Callable[[int, int], float]:
    """A function of an open position (from, to): the words among the first nine segments beside it; a Han character is half a word, marks are none."""
    sums = [0.0]
    for w in parts:
        sums.append(sums[-1] + (0 if w in _STOPS else 0.5 if not w.isascii() and _IS_HAN.match(w) else 1))
    n = len(parts)
    return lambda i, j: sums[min(n, 9)] if i >= 9 else sums[i] + sums[min(n, j + 9 - i)] - sums[j]


def whole(line: str) -> int:
    """The key of a line with no open position."""
    h = _hash("whole " + line)
    return h - (1 << 64) if h >> 63 else h


def page_keys(lines: list[str]) -> tuple[list[int], list[int]]:
    """The keys of a page's sentences, and of the page: as it stands, then with each sentence left open; the same for all pages of a template.

    Pages with code or quotes are texts about something. The work is in proportion to the page, however many sentences it has.
    """
    if any(c in line for line in lines for c in "`“"):
        return [], []
    wholes = [whole(line) for line in lines]
    before, behind = [3], [5]
    for w in wholes:
        before.append((before[-1] * 0x9E3779B97F4A7C15 + w) & _ALL)
    for w in reversed(wholes):
        behind.append((behind[-1] * 0xC2B2AE3D27D4EB4F + w) & _ALL)
    behind.reverse()
    around = [_signed((before[i] * 0x165667B19E3779F9 + behind[i + 1] * 0x27D4EB2F165667C5) & _ALL) for i in range(len(wholes))]
    return wholes, [_signed(before[-1]), *around]


@frame_stage
def _explode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for doc, text, source in zip(pdf["doc_id"], pdf["text"], pdf["source"]):
            parts, page = {}, []
            for line, slots, role, cased in sentences(text):
                part = parts.setdefault(line, (role, [], {}))
                part[1].extend(slots)
                if role == "text":
                    part[2].update(((key, fill), kind) for key, fill, kind in fills(line, cased, tuple(s for s, _ in slots)))
                    part[2][whole(line), 0] = WHOLE
                if role != "chrome":
                    page.append(line)
            has_core = any(role == "core" for role, _, _ in parts.values())
            page, around = page_keys(page) if page and all(role in ("text", "chrome") for role, _, _ in parts.values()) else ([], [])
            for line, (role, slots, opens) in parts.items():
                rows.append((doc, source, xxhash.xxh128_hexdigest(line), role, has_core, [s for s, _ in slots], [n for _, n in slots], [k for k, _ in opens], [f for _, f in opens], list(opens.values()), page, around))
                page, around = [], []
        yield pd.DataFrame(rows, columns=["doc_id", "source", "skeleton", "role", "has_core", "styles", "names", "keys", "fills", "kinds", "page", "around"])


def sentence_table(documents: DataFrame) -> DataFrame:
    """One row per document and different sentence: ``doc_id, source, skeleton`` (a hash) ``, role, has_core, styles, names``
    and its opened positions, ``keys, fills, kinds``. The first of a text without messages and filler has its ``page, around`` (:func:`page_keys`)."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    source = F.col("source").cast("string") if "source" in documents.columns else F.lit(None).cast("string")
    texts = spread(documents.where("doc_id is not null and text is not null").select("doc_id", "text", source.alias("source"), F.xxhash64("text", "source").alias("h")), "doc_id", shuffled=True).dropDuplicates(["doc_id", "h", "text"]).drop("h")
    return texts.mapInPandas(_explode, f"doc_id {kind}, source string, skeleton string, role string, has_core boolean, styles array<string>, names array<string>, keys array<long>, fills array<long>, kinds array<int>, page array<long>, around array<long>")


def repeated_pages(parts: DataFrame, min_pages: int = 5, min_share: float = 0.5, min_sources: int = 2) -> DataFrame:
    """``doc_id`` of pages of any length that ``min_pages`` documents repeat, as they stand or with one position varying.

    Every sentence of such a page must occur in repeated pages in ``min_share`` or more of its documents, so that a short
    remark is none; and the page must come from ``min_sources`` sources, as an error takes the place of any text while a
    formula ("initial commit") belongs to one kind. Pages without a varying
    position need not where the table has less sources; with one they could as well be filled records.

    A position is opened only in sentences beside which ``min_pages`` documents are equal, as in all others it varies for
    nothing; so a document makes one key for a sentence, and one for a position only where they can meet.
    """
    texts = parts.where(F.size("page") > 0).select("doc_id", "source", "page", "around", F.col("around")[0].alias("text"))
    sources = parts.select("source").where("source is not null").distinct().limit(min_sources).agg(F.count("*").alias("known"))
    lines = texts.select("doc_id", "source", "text", "page", F.posexplode("around").alias("at", "rest")).where("at > 0").select("doc_id", "source", "text", "at", "rest", F.expr("page[at - 1]").alias("line"), (F.size("page") == 1).alias("alone"))
    met = lines.where("not alone").groupBy("rest").agg(F.count_distinct("doc_id").alias("docs")).where(F.col("docs") >= min_pages).select("rest")
    candidates = lines.where("alone").unionByName(lines.where("not alone").join(met.hint("merge"), "rest", "left_semi"))
    # the keys of a sentence are the same in all documents; merged by hint, as their lists are longer than the optimizer takes them for
    opens = parts.where(F.size("keys") > 0).select(F.expr(f"filter(keys, (k, i) -> kinds[i] = {WHOLE})[0]").alias("line"), F.expr(f"array_distinct(filter(keys, (k, i) -> kinds[i] >= 0 and kinds[i] < {THIN}))").alias("opens"))
    opened_lines = opens.where(F.size("opens") > 0).join(candidates.select("line").distinct().hint("merge"), "line", "left_semi").groupBy("line").agg(F.max("opens").alias("opens"))
    found = stage(candidates.join(opened_lines.hint("merge"), "line").select("doc_id", "source", "text", "at", "rest", "opens"))
    pages = found.select("doc_id", "source", "text", "at", "rest", F.explode("opens").alias("key")).withColumn("page", F.xxhash64("rest", "key")).drop("rest")
    pages = pages.unionByName(texts.select("doc_id", "source", "text", F.lit(0).alias("at"), F.lit(None).cast("long").alias("key"), F.col("text").alias("page")))
    counted = pages.groupBy("page").agg(F.count_distinct("doc_id").alias("docs"), F.count_distinct("source").alias("sources"), F.bool_or(F.col("at") == 0).alias("fixed")).where(F.col("docs") >= min_pages)
    families = counted.crossJoin(F.broadcast(sources)).where((F.col("sources") >= min_sources) | (F.col("fixed") & (F.col("known") < min_sources))).select("page")
    members = stage(pages.join(families.hint("merge"), "page", "left_semi").select("doc_id", "text", "at", "key").distinct())
    # a page needs the keys of its sentences, that of the open position instead of its own sentence; a text that is open in one sentence only does not need that one
    spans = members.groupBy("doc_id", "text").agg(F.min("at").alias("low"), F.max("at").alias("high"))
    held = stage(texts.select("doc_id", "text", "page").join(spans.hint("merge"), ["doc_id", "text"]))
    beside = F.when((F.col("low") == F.col("high")) & (F.col("low") > 0), F.expr("concat(slice(page, 1, low - 1), slice(page, low + 1, size(page)))")).otherwise(F.col("page"))
    needed = held.select("doc_id", F.explode(F.array_distinct(beside)).alias("key")).unionByName(members.where("key is not null").select("doc_id", "key"))
    inside = needed.groupBy("key").agg(F.count_distinct("doc_id").alias("inside"))
    everywhere = parts.select("doc_id", F.explode("keys").alias("key")).join(inside, "key", "left_semi").groupBy("key").agg(F.count_distinct("doc_id").alias("docs"))
    usual = stage(inside.join(everywhere, "key").where(F.col("inside") < min_share * F.col("docs")).select("key"))
    shown = held.groupBy("text").agg(F.max("page").alias("page")).select("text", F.posexplode("page").alias("i", "key"))
    real = shown.join(usual, "key", "left_semi").groupBy("text").agg(F.count("*").alias("usual"), (F.min("i") + 1).alias("first"))
    whole_pages = members.join(usual, "key", "left_anti").join(real, "text", "left").where("usual is null or usual = 1 and first = at")
    return whole_pages.select("doc_id").distinct()


def unfilled(parts: DataFrame, variables: DataFrame, min_fills: int = 3, min_default: int = 10, times: float = 5.0) -> DataFrame:
    """``doc_id`` of documents whose sentence leaves a slot unfilled, the slots being induced from all sentences.

    A position is a slot when ``min_fills`` different values stand there in sentences that are otherwise equal, or when
    a placeholder does. Its fill is a blank; a name in marks; a bracketed or shouted variable, and any variable
    where another record keeps a placeholder; a known default; or a frequent one: it stands in ``min_default`` sentences
    and ``times`` as many as any other fill, and the others together are as many as it.
    """
    positions = parts.where(F.size("keys") > 0).select("doc_id", F.explode(F.arrays_zip("keys", "fills", "kinds")).alias("o")).select("doc_id", F.col("o.keys").alias("key"), F.col("o.fills").alias("fill"), (F.col("o.kinds") % THIN).alias("kind")).where(F.col("kind") != WHOLE)
    counted = positions.groupBy("key", "fill", "kind").agg(F.count("*").alias("n"))
    slots = counted.groupBy("key").agg(
        F.count_if(F.col("kind") == VALUE).alias("values"), F.bool_or(F.col("kind") == PLACEHOLDER).alias("kept"), F.max("n").alias("top"), F.sum("n").alias("all"), F.bool_or(F.col("kind") != VALUE).alias("odd"))
    frequent = (F.col("top") >= min_default) & (F.col("values") > min_fills) & (F.col("all") >= 2 * F.col("top"))
    slots = slots.where(((F.col("values") >= min_fills) & F.col("odd")) | F.col("kept") | frequent)
    judged = stage(counted.join(slots, "key"))
    rivals = judged.where(frequent & (F.col("kind") == VALUE)).groupBy("key").agg(F.max_by("fill", F.struct("n", "fill")).alias("first"), F.max("n").alias("most"))
    second = judged.join(rivals, "key").where((F.col("fill") != F.col("first")) | (F.col("kind") != VALUE)).groupBy("key", F.col("first").alias("fill"), "most").agg(F.max("n").alias("next")).where((F.col("most") >= min_default) & (F.col("most") >= times * F.col("next")))
    known = variables.select(F.xxhash64("name").alias("fill"), F.lit(True).alias("variable"))
    slot = (F.col("values") >= min_fills) | F.col("kept")
    left = (F.col("kind").isin(BLANK, MARKED, WEAKLY, DEFAULT) & slot) | ((F.col("kind") == NAMED) & F.col("variable") & slot) | ((F.col("kind") == VALUE) & F.col("variable") & F.col("kept"))
    open_fills = judged.join(known, "fill", "left").where(left).select("key", "fill", "kind")
    bad = open_fills.unionByName(second.select("key", "fill", F.lit(VALUE).alias("kind"))).distinct()
    return positions.join(stage(bad), ["key", "fill", "kind"], "left_semi").select("doc_id").distinct()


def residue(documents: DataFrame, min_documents: int = 2, min_styles: int = 3, min_share: float = 0.5) -> DataFrame:
    """``doc_id, reason`` of documents that are template residue: ``slot``, ``filler`` or ``page``.

    Sentences of all documents are aligned with each of their positions left open, which induces the slots
    (:func:`unfilled`); placeholders of known styles are slots wherever they stand. A name that fills slots in
    ``min_styles`` styles is a variable. A document is residue when a slot in its prose keeps a placeholder, a variable
    name, a default or a blank; when it holds filler; or when it is a page
    made of an error message or script notice and of sentences that belong to such pages. Those are induced: sentences
    of which ``min_share`` or more come with a message, and whose template (all but one position) ``min_documents`` or more
    such pages share. A page of two such sentences and one that is not known is a page with an unknown message.
    Texts that many documents repeat are pages whatever they say (:func:`repeated_pages`). Code,
    inline code, quotes and a title line are not looked into.

    Null, empty and blank texts are never residue, nor are documents of null id; rows that repeat a document count once;
    texts of any length are read whole; a document of several texts is residue when one of them is; empty input gives
    no rows.
    """
    parts = stage(sentence_table(documents))
    slots = parts.where(F.size("styles") > 0).select("doc_id", "skeleton", F.explode(F.arrays_zip("styles", "names")).alias("s")).select("doc_id", "skeleton", F.col("s.styles").alias("style"), F.col("s.names").alias("name"))
    # approx sets are never needed: fills and styles are few per skeleton and name after the map-side distinct
    templates = slots.groupBy("skeleton").agg(F.count_distinct("doc_id").alias("docs"), F.count_distinct("style", "name").alias("fills")).where((F.col("docs") >= 2) & (F.col("fills") >= 2)).select("skeleton", F.lit(True).alias("template"))
    variables = slots.where("name <> ''").groupBy("name").agg(F.count_distinct("style").alias("n")).where(F.col("n") >= min_styles).select("name", F.lit(True).alias("variable"))
    weak = F.col("style").isin(*sorted(WEAK))
    judged = slots.join(templates, "skeleton", "left").join(variables, "name", "left")
    by_slot = judged.where(F.when(weak, F.col("variable") | ((F.col("style") == "blank") & F.col("template"))).otherwise(F.lit(True))).select("doc_id", F.lit("slot").alias("reason"))
    by_page = repeated_pages(parts).select("doc_id", F.lit("page").alias("reason"))
    by_fill = unfilled(parts, variables).select("doc_id", F.lit("slot").alias("reason"))
    filler = parts.where("role = 'filler'").select("doc_id", F.lit("filler").alias("reason"))
    texts = parts.where("role = 'text'")
    usual = texts.groupBy("skeleton").agg(F.count_if("has_core").alias("paged"), F.count("*").alias("docs")).where(F.col("paged") >= min_share * F.col("docs")).select("skeleton")
    shared = texts.where("has_core").select("skeleton", "doc_id", F.explode(F.expr(f"filter(keys, (k, i) -> kinds[i] < {THIN})")).alias("t"))
    known = shared.groupBy("t").agg(F.count_distinct("doc_id").alias("docs")).where(F.col("docs") >= min_documents).select("t")
    advice = stage(shared.join(known, "t", "left_semi").select("skeleton").distinct().join(usual, "skeleton", "left_semi").withColumn("advice", F.lit(True)))
    roles = parts.where("role <> 'chrome'").join(advice, "skeleton", "left")
    counted = roles.groupBy("doc_id").agg(F.bool_or("has_core").alias("core"), F.count_if("advice").alias("advised"), F.count_if((F.col("role") == "text") & F.col("advice").isNull()).alias("other"))
    pages = counted.where("core and other = 0 or other <= 1 and advised >= 2").select("doc_id", F.lit("page").alias("reason"))
    return by_slot.unionByName(by_fill).unionByName(by_page).unionByName(filler).unionByName(pages).groupBy("doc_id").agg(F.min("reason").alias("reason"))
