"""Token lists of source files, for the grammars of :mod:`codestrata.llm.grammars`.

Each lexer returns terminals ending with EOF, or None where the text has no tokens of the language (an open string or
comment, a stray character). Blank sources give only EOF.
"""

from __future__ import annotations

import io
import keyword
import re
import tokenize
from collections.abc import Callable, Iterator

from codestrata.llm.gll import EOF, NL

try:
    from _tokenize import TokenizerIter
except ImportError:
    TokenizerIter = None

# The reserved and the placewise reserved words of the languages.
ECMA_WORDS = frozenset("""async of get set from as static let type interface declare namespace module abstract readonly public private protected override keyof infer is
asserts satisfies unique implements global accessor await yield target meta out using break case catch class const continue debugger default delete do else enum export extends
false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with require assert""".split())
RUST_WORDS = frozenset("""union auto default raw macro_rules safe as async await break const continue crate dyn else enum extern false fn for if impl in let loop match mod move mut
pub ref return self Self static struct super trait true type unsafe use where while yield _""".split())
GO_WORDS = frozenset("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split())
TS_ONLY = frozenset("type interface declare namespace module abstract readonly public private protected override keyof infer is asserts satisfies unique implements global out require".split())

class Terminals(dict):
    """Terminals of lexemes, worked out by a function once for those that are short."""

    def __init__(self, tell: Callable[[str], str]):
        self.tell = tell

    def __missing__(self, lexeme: str) -> str:
        terminal = self.tell(lexeme)
        if len(lexeme) < SHORT:
            if len(self) >= ROOM:
                self.clear()
            self[lexeme] = terminal
        return terminal


class _Unreadable(Exception):
    """Text with no tokens of the language."""


class _Opened(Exception):
    """A lexeme whose end no regular expression finds."""


SHORT, ROOM = 48, 50_000  # characters of a lexeme that is kept, lexemes that are kept
_END = "\n\0"  # put behind the text, so that its end is a lexeme, too

_ECMA = re.compile(
    r"""([ \t\f\v\xa0﻿\r\n  ]*+(?:(?=/)(?://[^\n]*+|/\*.*?\*/)[ \t\f\v\xa0﻿\r\n  ]*+)*+)(?:
    ([A-Za-z_$\x80-\U0010ffff][A-Za-z0-9_$\x80-\U0010ffff]*+)
    |([{}()\[\];,])
    |(?=[.\d])(0[xX][0-9a-fA-F]+(?:_[0-9a-fA-F]+)*n?|0[bB][01]+(?:_[01]+)*n?|0[oO][0-7]+(?:_[0-7]+)*n?|0\d+(?:\.\d*)?|(?:0|[1-9]\d*(?:_\d+)*)n|(?:(?:0|[1-9]\d*(?:_\d+)*)(?:\.(?:\d+(?:_\d+)*)?)?|\.\d+(?:_\d+)*)(?:[eE][+-]?\d+(?:_\d+)*)?)(?![\w$])
    |("(?:[^"\\\n]|\\(?:\r\n|.))*"|'(?:[^'\\\n]|\\(?:\r\n|.))*')
    |(\#[A-Za-z_$][\w$]*)
    |(\.\.\.|=>|===|!==|\*\*=|<<=|&&=|\|\|=|\?\?=|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\+=|-=|\*=|%=|&=|\|=|\^=|<<|\*\*|[<>+\-*%&|^!~?:=.@])
    |(/)|(`)|$|(.+))""", re.X | re.S)
_REGEX = re.compile(r"/(?:[^/\\\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/[A-Za-z]*")
_TEMPLATE = re.compile(r"(?:[^`\\$]|\\.|\$(?!\{))*(`|\$\{)", re.S)
_TAG = re.compile(r"""(?:\s|//[^\n]*|/\*.*?\*/)*(?:([A-Za-z_$][\w$\-]*)|("[^"]*"|'[^']*')|([<>/={}.:]))""", re.S)
_BEFORE_DIVISION = frozenset(["NAME", "NUM", "STR", "REGEX", "TPL", "TPL_TAIL", "PRIVATE", ")", "]", "this", "super", "null", "true", "false", "++", "--", *TS_ONLY, *"of get set from as static async let target meta accessor assert using".split()])
_OPENS_TAG = re.compile(r"[A-Za-z_$>]")
_OPENS_TYPES = re.compile(r"(?:const\s+)?\w+\s*(?:,|extends\b|=[^>])")
#: What matches were told to be, and those behind a dot, where words are names: (terminal, what comes before the next token, where to look for it).
_ECMA_SEEN: tuple[dict, dict] = ({}, {})
_CONDITION = frozenset(["if", "while", "for", "with"])
_BLOCK_BEFORE = frozenset([")", ";", "{", "}", "=>", "else", "do", "try", "finally", ":", ""])


def ecma(text: str, markup: bool = False) -> list[str] | None:
    """Tokens of JavaScript and TypeScript; terminals that are first in their line carry NL. ``markup`` reads tags."""
    if text.startswith("﻿"):
        text = text[1:]
    at = (text.find("\n") + 1 or len(text)) if text.startswith("#!") else 0
    out: list[str] = []
    put = out.append
    stack: list = []  # open brackets: "(" + whether a condition, "{" + whether a block, "${", and tags
    prev = ""
    plain, dotted = _ECMA_SEEN
    if len(plain) + len(dotted) > ROOM:
        plain.clear()
        dotted.clear()
    seen = plain
    while at is not None:
        for m in _ECMA.finditer(text, at):
            told = seen.get(m[0])
            if told is None:
                line = NL if "\n" in m[1] else ""
                kind = m.lastindex
                if kind == 1:
                    put(line + EOF)
                    return out
                if kind == 10:
                    return None
                word = m[kind]
                if word == "<":
                    seen = plain
                    put(line + "<")
                    if markup and prev not in _BEFORE_DIVISION and prev != "}" and _OPENS_TAG.match(text, m.end()) and not _OPENS_TYPES.match(text[m.end() : m.end() + 80]):
                        at = _markup(text, m.end(), put, stack, "tag")
                        prev = "{" if stack and stack[-1][0] == "<" else ")"
                        break
                    prev = "<"
                    continue
                if kind == 8:
                    seen = plain
                    if prev not in _BEFORE_DIVISION:
                        r = _REGEX.match(text, m.start(8))
                        if not r:
                            return None
                        at, prev = r.end(), "REGEX"
                    elif text[m.end() : m.end() + 1] == "=":
                        at, prev = m.end() + 1, "/="
                    else:
                        at, prev = m.end(), "/"
                    put(line + prev)
                    break
                if kind == 9:
                    seen = plain
                    at, prev = _template(text, m.end(), stack, "TPL", "TPL_HEAD")
                    put(line + prev)
                    break
                if kind == 2:
                    here = word if word in ECMA_WORDS and seen is plain else "NAME"
                elif kind == 3 and word not in ",;":
                    here = ""
                else:
                    here = word if kind in (3, 7) else ("NUM", "STR", "PRIVATE")[kind - 4]
                told = line + (here or word), here, dotted if word in (".", "?.") else plain
                if len(m[0]) < SHORT:
                    seen[m[0]] = told
            terminal, here, seen = told
            if here:
                put(terminal)
                prev = here
                continue
            op = terminal[-1]
            if op == "(":
                stack.append("(if" if prev in _CONDITION else "(")
            elif op == "[":
                stack.append("[")
            elif op == "{":
                stack.append("{b" if prev in _BLOCK_BEFORE else "{")
            elif op == "}":
                top = stack.pop() if stack and stack[-1][0] in "{$<" else "{"
                if top[0] == "$":
                    at, prev = _template(text, m.end(), stack, "TPL_TAIL", "TPL_MID")
                    put(prev)
                    break
                if top[0] == "<":
                    put("}")
                    at = _markup(text, m.end(), put, stack, top[1:])
                    prev = "{" if stack and stack[-1][0] == "<" else ")"
                    break
                op = "}" if top == "{b" else ")"
            else:
                top = stack.pop() if stack and stack[-1][0] in "([" else "("
                if top == "(if":
                    op = "(if)"
            put(terminal)
            prev = op
    return None


def _template(text: str, at: int, stack: list, whole: str, opened: str) -> tuple[int | None, str]:
    """Where the text of a template that starts at ``at`` ends, and its terminal."""
    t = _TEMPLATE.match(text, at)
    if not t:
        return None, ""
    if t[1] == "`":
        return t.end(), whole
    stack.append("${")
    return t.end(), opened


def _markup(text: str, at: int, put, stack: list, mode: str) -> int | None:
    """Read tags and their text from ``at`` on, until the outermost tag ends or a ``{`` opens code; ``mode`` is where it stands.

    Open tag names are kept in the stack as ``"T" + name``; on ``{`` the entry ``"<" + mode`` remembers how to go on.
    """
    name: list[str] = []
    attributes = closing = False
    if mode == "attr":
        attributes = True
    while True:
        if mode == "text":
            end = at
            while end < len(text) and text[end] not in "<{>}":
                end += 1
            if end >= len(text) or text[end] in ">}":
                return None
            if text[at:end].strip():
                put("MTEXT")
            at = end + 1
            put(text[end])
            if text[end] == "{":
                stack.append("<text")
                return at
            mode, name, attributes, closing = "tag", [], False, False
            continue
        m = _TAG.match(text, at)
        if not m:
            return None
        at = m.end()
        if m[1]:
            put("NAME")
            if not attributes:
                name.append(m[1])
                follow = text[at : at + 1]
                attributes = follow not in (".", ":")
        elif m[2]:
            put("STR")
        else:
            op = m[3]
            if op == "<" and name and not closing and text[m.start() : m.end() - 1].strip() == "":
                depth, end = 1, at  # type arguments of a tag
                while depth and end < len(text):
                    depth += {"<": 1, ">": -1}.get(text[end], 0)
                    end += 1
                inner = ecma(text[at : end - 1])
                if depth or inner is None:
                    return None
                for token in ["<", *inner[:-1], ">"]:
                    put(token)
                at = end
                continue
            put(op)
            if op in ".:" and not attributes or op == ":":
                name.append(op)
            elif op == "{":
                if closing:
                    return None
                if attributes and mode != "attr":
                    stack.append("T" + "".join(name))
                stack.append("<attr")
                return at
            elif op == "/":
                if not name and mode != "attr":
                    closing = True
                    continue
                if text[at : at + 1] != ">":
                    return None
                put(">")
                at += 1
                if mode == "attr":
                    stack.pop()
                if not (stack and stack[-1][0] == "T"):
                    return at
                mode = "text"
            elif op == ">":
                if closing:
                    if not stack or stack.pop() != "T" + "".join(name):
                        return None
                    if not (stack and stack[-1][0] == "T"):
                        return at
                elif mode != "attr":
                    stack.append("T" + "".join(name))
                mode = "text"
            elif op in "<}":
                return None


_RUST = re.compile(
    r"""\s*+(?:(?=/)(?://[^\n]*+|/\*(?:[^*/]|\*(?!/)|/(?!\*))*+\*/)\s*+)*+(?:(
    [{}()\[\];,]|(?![bcr]\#*["'r])[^\W\d]\w*+(?!\#)
    |[bc]?r(?:".*?"|\#".*?"\#|\#\#".*?"\#\#)|[bc]?"(?:[^"\\]|\\.)*+"|[bc]?r\#\#\#+"
    |b?'(?:[^'\\\n]|\\(?:x[0-9a-fA-F]{2}|u\{[0-9a-fA-F_]+\}|[nrt\\0'"]))'
    |'(?:r\#)?[A-Za-z_]\w*(?!')
    |r\#[A-Za-z_]\w*|[^\W\d]\w*
    |(?=\d)(?:0x[0-9a-fA-F_]+\w*|0b[01_]+\w*|0o[0-7_]+\w*|\d[\d_]*(?:\.(?![._A-Za-z])[\d_]*)?(?:[eE][+-]?[\d_]+)?(?:[iuf]\w*)?)(?!\w)
    |\.\.\.|\.\.=|<<=|::|->|=>|==|!=|<=|>=|&&|\|\||\+=|-=|\*=|/=|%=|\^=|&=|\|=|<<|\.\.|/\*|[{}()\[\];,<>+\-*/%&|^!~?:=.@\#$]
    |\0\Z)|.)""", re.X | re.S)
_OPENS = re.compile(r'/\*|[bc]?r(\#\#\#+)"')
_NEST = re.compile(r"/\*|\*/")


def _rust_terminal(lexeme: str) -> str:
    if not lexeme:
        raise _Unreadable
    if _OPENS.match(lexeme):
        raise _Opened
    first, last = lexeme[0], lexeme[-1]
    if last == '"' or last == "#" != lexeme:
        return "STR"
    if last == "'":
        return "CHAR"
    if first == "'":
        return "LIFETIME"
    if first.isdecimal():
        return "NUM"
    if first.isalnum() or first == "_":
        return lexeme if lexeme in RUST_WORDS else "NAME"
    return EOF if first == "\0" else lexeme


_RUST_TERMINALS = Terminals(_rust_terminal)


def _without_nests(text: str) -> str | None:
    """The text with blanks for comments that hold comments, and short strings for those that three signs or more enclose."""
    pieces, at, kept = [], 0, 0
    while m := _RUST.match(text, at):
        at = m.end()
        opened = _OPENS.match(m[1] or "")
        if not opened:
            continue
        pieces.append(text[kept : m.start(1)])
        if opened[1]:
            at = text.find('"' + opened[1], at) + 1 + len(opened[1])
            if at <= len(opened[1]):
                return None
            pieces.append('""')
        else:
            pieces.append(" ")
            level = 1
            while level:
                n = _NEST.search(text, at)
                if not n:
                    return None
                level += 1 if n[0] == "/*" else -1
                at = n.end()
        kept = at
    return "".join(pieces) + text[kept:]


def rust(text: str) -> list[str] | None:
    """Tokens of Rust."""
    if text.startswith("﻿"):
        text = text[1:]
    if text.startswith("#!") and not re.match(r"#!\s*\[", text):
        text = text[text.find("\n") + 1 or len(text) :]
    return _rust_tokens(text)


def _rust_tokens(text: str) -> list[str] | None:
    try:
        return list(map(_RUST_TERMINALS.__getitem__, _RUST.findall(text + _END)))
    except _Unreadable:
        return None
    except _Opened:
        plain = _without_nests(text)
        return None if plain is None else _rust_tokens(plain)


_GO = re.compile(
    r"""[ \t\r]*+(?:(?=/)(?://[^\n]*+|/\*(?:[^*\n]|\*(?!/))*+\*/)[ \t\r]*+)*+(?:(
    [^\W\d]\w*+|[{}()\[\];,]|\n[ \t\r\n]*+|/\*.*?\*/
    |(?=[.\d])(?:0[xX][0-9a-fA-F_]+(?:\.[0-9a-fA-F_]*)?(?:[pP][+-]?\d+)?i?|0[bB][01_]+i?|0[oO][0-7_]+i?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?i?)(?!\w)
    |"(?:[^"\\\n]|\\(?:[abfnrtv\\"]|x[0-9a-fA-F]{2}|[0-7]{3}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}))*+"|`[^`]*`
    |'(?:[^'\\\n]|\\(?:[abfnrtv\\']|x[0-9a-fA-F]{2}|[0-7]{3}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}))'
    |\.\.\.|<<=|>>=|&\^=|&\^|&&|\|\||<-|\+\+|--|==|!=|<=|>=|:=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|[{}()\[\];,<>+\-*/%&|^!~:=.]
    |\0\Z)|.)""", re.X | re.S)
_GO_ENDS = frozenset(["NAME", "NUM", "STR", "CHAR", "break", "continue", "fallthrough", "return", "++", "--", ")", "]", "}"])


def _go_terminal(lexeme: str) -> str:
    if not lexeme:
        raise _Unreadable
    first = lexeme[0]
    if first == "\n" or lexeme.startswith("/*"):
        return "\n"
    if first in "\"`":
        return "STR"
    if first == "'":
        return "CHAR"
    if first.isdecimal() or first == "." and lexeme[1:2].isdecimal():
        return "NUM"
    if first.isalnum() or first == "_":
        return lexeme if lexeme in GO_WORDS else "NAME"
    return EOF if first == "\0" else lexeme


_GO_TERMINALS = Terminals(_go_terminal)


def go(text: str) -> list[str] | None:
    """Tokens of Go, with the semicolons that ends of lines stand for."""
    if text.startswith("﻿"):
        text = text[1:]
    out: list[str] = []
    put = out.append
    prev = ""
    try:
        for terminal in map(_GO_TERMINALS.__getitem__, _GO.findall(text + _END)):
            if terminal != "\n":
                put(terminal)
                prev = terminal
            elif prev in _GO_ENDS:
                put(";")
                prev = ""
    except _Unreadable:
        return None
    return out


_PY_SOFT = frozenset(["match", "case", "type"])
_PY_WORDS = frozenset(keyword.kwlist) | _PY_SOFT
_PY_OLD_OCTAL = re.compile(r"0[0-9_]*[1-9][0-9_]*")
_PY_TERMINALS = {kind: {"NUMBER": "NUM", "STRING": "STR", "FSTRING_START": "F_START", "FSTRING_MIDDLE": "F_TEXT", "FSTRING_END": "F_END", "ENDMARKER": EOF}.get(name, name) for kind, name in tokenize.tok_name.items()}
_PY_SKIP = frozenset([tokenize.COMMENT, tokenize.NL, tokenize.ENCODING, tokenize.TYPE_COMMENT])


def _python_tokens(readline: Callable[[], str]) -> Iterator[tuple]:
    """The tokens of ``tokenize.generate_tokens``; straight from the tokenizer below it where there is one, as its wrappers take three times as long."""
    return TokenizerIter(readline, extra_tokens=True) if TokenizerIter else tokenize.generate_tokens(readline)


def python(text: str) -> list[str] | None:
    """Tokens of Python, by the tokenizer of the standard library (of the Python that runs the task)."""
    out: list[str] = []
    put = out.append
    try:
        for kind, string, _, _, _ in _python_tokens(io.StringIO(text.removeprefix("﻿")).readline):
            if kind == tokenize.OP:
                put(string)
            elif kind == tokenize.NAME:
                put(string if string in _PY_WORDS else "NAME")
            elif kind == tokenize.ERRORTOKEN or kind == tokenize.NUMBER and _PY_OLD_OCTAL.fullmatch(string):
                return None
            elif kind not in _PY_SKIP:
                put(_PY_TERMINALS[kind])
    except (tokenize.TokenError, SyntaxError, ValueError):
        return None
    return out
