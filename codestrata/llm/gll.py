"""Generalised LL recognition with a graph-structured stack.

A grammar is written as regular right-hand sides. Each rule becomes a small deterministic automaton over terminals and
rule names; a parser walks these automata. Where more than one step is possible, all are followed at once: calls of one
rule at one position share one node of the graph-structured stack, with all their return places and all the positions
where the rule ended. So any grammar is handled, ambiguous and left-recursive ones included, in polynomial time.

Sources have few open stacks at most places. There the graph is kept as a chain of parts, each the set of stacks between
two points that all stacks pass; what a part becomes at a terminal is worked out once, for all files, and looked up later.

Notation: ``Rule = alternatives ;`` with ``'text'`` and ``UPPER`` terminals, ``|``, ``*``, ``+``, ``?``, parentheses,
``@Name`` for a macro (``@Name := alternatives ;``), and ``Rule-('a' 'b')`` for a call that the listed terminals don't start.
``?dialect{ ... }`` keeps its content only in grammars built for that dialect.
"""

from __future__ import annotations

import re

NL = "\n"  # prefix of terminals that are first in their line
EOF = "<eof>"
#: Terminals that also match nothing: the tokens they take, and those before which they may be empty, besides first tokens of a line.
SOFT = {"SEMI": ({";"}, {"}", EOF}), "MSEP": ({";", ","}, {"}"})}

_SCAN = re.compile(r"\s+|#[^\n]*|('(?:[^'\\]|\\.)+')|(@?[A-Za-z_]\w*)|(:=|[=;|*+?()\-])|(\?(\w+)\{)|(\})")


class Grammar:
    """Automata of all rules, with the possible steps for each state and next terminal."""

    def __init__(self, text: str, starts: list[str], dialects: frozenset[str] = frozenset()):
        self.macros: dict[str, tuple] = {}
        self.trees: dict[str, tuple] = {}
        self._read(text, dialects)
        self.rules = sorted(self.trees)
        self._automata()
        self._tables(starts)
        self._parts: dict[tuple, Parts] = {}

    def parts(self, starts: list[str]) -> Parts:
        key = tuple(starts)
        if key not in self._parts:
            self._parts[key] = Parts(self.steps, [(name, self.start[name]) for name in starts])
        return self._parts[key]

    # -- reading -------------------------------------------------------------------------------------------------
    def _read(self, text: str, dialects: frozenset[str]) -> None:
        tokens, at, keep = [], 0, [True]
        while at < len(text):
            m = re.compile(r"\?(\w+)\{").match(text, at)
            if m:
                keep.append(keep[-1] and any(d in dialects for d in m[1].split("_or_")))
                at = m.end()
                continue
            m = _SCAN.match(text, at)
            if not m:
                raise ValueError(f"grammar: {text[at:at + 40]!r}")
            at = m.end()
            if m[6]:
                keep.pop()
            elif m[1] or m[2] or m[3]:
                if keep[-1]:
                    tokens.append(m[0])
        self._toks, self._at = tokens, 0
        while self._at < len(tokens):
            name, sign = tokens[self._at], tokens[self._at + 1]
            self._at += 2
            tree = self._alternatives()
            if tokens[self._at] != ";":
                raise ValueError(f"grammar: ; expected in {name}, found {tokens[self._at]}")
            self._at += 1
            (self.macros if sign == ":=" else self.trees)[name] = tree

    def _alternatives(self) -> tuple:
        parts = [self._sequence()]
        while self._toks[self._at] == "|":
            self._at += 1
            parts.append(self._sequence())
        return ("or", parts) if len(parts) > 1 else parts[0]

    def _sequence(self) -> tuple:
        parts = []
        while self._toks[self._at] not in ("|", ")", ";"):
            tok = self._toks[self._at]
            self._at += 1
            if tok == "(":
                item = self._alternatives()
                self._at += 1
            elif tok[0] == "@":
                item = ("macro", tok)
            elif tok[0] == "'":
                item = ("term", tok[1:-1].replace("\\'", "'").replace("\\\\", "\\"))
            elif tok.isupper() or "_" in tok and tok.upper() == tok:
                item = ("term", tok)
            else:
                banned: tuple = ()
                if self._toks[self._at] == "-":
                    end = self._toks.index(")", self._at)
                    banned = tuple(t[1:-1] for t in self._toks[self._at + 2 : end])
                    self._at = end + 1
                item = ("call", tok, banned)
            while self._toks[self._at] in ("*", "+", "?"):
                item = (self._toks[self._at], item)
                self._at += 1
            parts.append(item)
        return ("seq", parts)

    # -- automata ------------------------------------------------------------------------------------------------
    def _automata(self) -> None:
        self.state_rule: list[str] = []
        self.accepting: list[bool] = []
        self.edges: list[dict] = []
        self.start: dict[str, int] = {}
        for rule in self.rules:
            nfa: list[list] = []

            def node() -> int:
                nfa.append([])
                return len(nfa) - 1

            def build(tree: tuple, a: int, b: int) -> None:
                op = tree[0]
                if op == "macro":
                    build(self.macros[tree[1]], a, b)
                elif op in ("term", "call"):
                    nfa[a].append((tree, b))
                elif op == "or":
                    for t in tree[1]:
                        build(t, a, b)
                elif op == "seq":
                    for t in tree[1][:-1]:
                        c = node()
                        build(t, a, c)
                        a = c
                    if tree[1]:
                        build(tree[1][-1], a, b)
                    else:
                        nfa[a].append((None, b))
                else:
                    c, e = node(), node()
                    nfa[a].append((None, c))
                    nfa[e].append((None, b))
                    build(tree[1], c, e)
                    if op in "*+":
                        nfa[e].append((None, c))
                    if op in "*?":
                        nfa[a].append((None, b))

            first, last = node(), node()
            build(self.trees[rule], first, last)

            reach: dict[int, frozenset[int]] = {}

            def alone(state: int) -> frozenset[int]:
                """States with steps, or the last one, that a state reaches without a step."""
                if state not in reach:
                    todo, seen = [state], {state}
                    while todo:
                        for label, b in nfa[todo.pop()]:
                            if label is None and b not in seen:
                                seen.add(b)
                                todo.append(b)
                    reach[state] = frozenset(s for s in seen if s == last or any(label is not None for label, _ in nfa[s]))
                return reach[state]

            def closure(states: set[int]) -> frozenset[int]:
                return frozenset().union(*map(alone, states))

            known: dict[frozenset, int] = {}
            order = [closure({first})]
            known[order[0]] = self._new_state(rule, last in order[0])
            self.start[rule] = known[order[0]]
            for states in order:
                moves: dict = {}
                for s in states:
                    for label, b in nfa[s]:
                        if label is not None:
                            moves.setdefault(label, set()).add(b)
                for label, targets in moves.items():
                    to = closure(targets)
                    if to not in known:
                        known[to] = self._new_state(rule, last in to)
                        order.append(to)
                    self.edges[known[states]][label] = known[to]

    def _new_state(self, rule: str, accepting: bool) -> int:
        self.state_rule.append(rule)
        self.accepting.append(accepting)
        self.edges.append({})
        return len(self.edges) - 1

    # -- tables --------------------------------------------------------------------------------------------------
    def _takes(self, term: str) -> set[str]:
        """Terminals before which the terminal can be passed; those first in a line carry NL."""
        if term in SOFT:
            eats, empty = SOFT[term]
            return eats | {NL + t for t in self.terms} | empty
        return {term, NL + term}

    def _tables(self, starts: list[str]) -> None:
        self.terms = {EOF}
        for edges in self.edges:
            for label in edges:
                if label[0] == "term":
                    self.terms |= SOFT[label[1]][0] | SOFT[label[1]][1] if label[1] in SOFT else {label[1]}
        for rule in self.rules:
            if self.accepting[self.start[rule]]:
                raise ValueError(f"grammar: {rule} may be empty")
        first: dict[str, set[str]] = {r: set() for r in self.rules}
        changed = True
        while changed:
            changed = False
            for r in self.rules:
                now = set()
                for label in self.edges[self.start[r]]:
                    now |= self._takes(label[1]) if label[0] == "term" else first[label[1]] - self._banned(label)
                if now - first[r]:
                    first[r] |= now
                    changed = True
        follow: dict[str, set[str]] = {r: set() for r in self.rules}
        for s in starts:
            follow[s] |= {EOF, NL + EOF}
        ahead = []
        for s, edges in enumerate(self.edges):
            own = set()
            for label in edges:
                own |= self._takes(label[1]) if label[0] == "term" else first[label[1]] - self._banned(label)
            ahead.append(own)
        changed = True
        while changed:
            changed = False
            for s, edges in enumerate(self.edges):
                for label, to in edges.items():
                    if label[0] == "call":
                        now = ahead[to] | (follow[self.state_rule[to]] if self.accepting[to] else set())
                        if now - follow[label[1]]:
                            follow[label[1]] |= now
                            changed = True
        #: Steps by state and terminal: a state for "take the token and go there", else a tuple of steps.
        self.steps: list[dict] = []
        for s, edges in enumerate(self.edges):
            table: dict[str, list] = {}
            for label, to in edges.items():
                if label[0] == "call":
                    for t in first[label[1]] - self._banned(label):
                        table.setdefault(t, []).append(("call", self.start[label[1]], to))
                elif label[1] in SOFT:
                    eats = SOFT[label[1]][0]
                    for t in self._takes(label[1]):
                        table.setdefault(t, []).append(("take", to, 0) if t.removeprefix(NL) in eats else ("pass", to, 0))
                else:
                    for t in (label[1], NL + label[1]):
                        table.setdefault(t, []).append(("take", to, 0))
            if self.accepting[s]:
                for t in follow[self.state_rule[s]]:
                    table.setdefault(t, []).append(("back", 0, 0))
            self.steps.append({t: v[0][1] if len(v) == 1 and v[0][0] == "take" else tuple(v) for t, v in table.items()})

    @staticmethod
    def _banned(label: tuple) -> set[str]:
        return {p + t for t in label[2] for p in ("", NL)}


class Part(dict):
    """The stacks above one point of the stack graph that all of them pass, as tuples of states; maps a terminal to what comes next, once worked out."""

    __slots__ = ("parts", "stacks")

    def __init__(self, parts: Parts, stacks: frozenset[tuple]):
        self.parts, self.stacks = parts, stacks

    def __missing__(self, tok: str) -> object:
        self[tok] = found = self.parts.after(self.stacks, tok)
        return found


POP, JOIN, GRAPH = "pop", "join", "graph"


class Parts:
    """Parts of the stack graph, each with its steps worked out once for all files.

    What a part maps a terminal to: the part after it was taken; a pair of parts, of which the lower is put aside; POP
    where all stacks end before the terminal; JOIN where only some do, so that what lies below must be looked at with
    them; GRAPH where the stacks are too many or too high; else the start rules that are derived, an empty set where none is.
    """

    HIGH, KEPT = 8, 4  # states of a stack: more are split, so many stay in the upper part
    HIGHEST, MOST = 48, 64  # states of a stack and stacks of a part, above which the graph is walked
    ROOM, SLICE = 40_000, 20_000  # parts that are kept, looked at after so many tokens

    def __init__(self, steps: list[dict], starts: list[tuple[str, int]]):
        self.steps, self.names = steps, [name for name, _ in starts]
        self.bottom = frozenset((-1 - k, state) for k, (_, state) in enumerate(starts))
        self.known: dict[frozenset, Part] = {}

    def part(self, stacks: frozenset[tuple]) -> Part:
        part = self.known.get(stacks)
        if part is None:
            part = self.known[stacks] = Part(self, stacks)
        return part

    def trimmed(self, chain: list[Part]) -> list[Part]:
        """The same parts, without what was worked out before where that is too much."""
        if len(self.known) <= self.ROOM:
            return chain
        for part in self.known.values():
            part.clear()  # else rings of parts would wait for the collector
        self.known = {}
        return [self.part(p.stacks) for p in chain]

    def joined(self, below: Part, part: Part) -> Part:
        return self.part(frozenset(p + u for p in below.stacks for u in part.stacks))

    def after(self, stacks: frozenset[tuple], tok: str) -> object:
        steps, todo, seen = self.steps, list(stacks), set(stacks)
        taken, ends, derived = set(), False, set()
        while todo:
            stack = todo.pop()
            under, s = stack[:-1], stack[-1]
            if s < 0:
                if tok in (EOF, NL + EOF):
                    derived.add(self.names[-1 - s])
                continue
            step = steps[s].get(tok, ())
            if step.__class__ is int:
                taken.add((*under, step))
                continue
            for kind, a, b in step:
                if kind == "take":
                    taken.add((*under, a))
                    continue
                new = (*under, b, a) if kind == "call" else (*under, a) if kind == "pass" else under
                if not new:
                    ends = True
                elif new not in seen:
                    seen.add(new)
                    todo.append(new)
            if len(seen) > self.MOST or len(stack) > self.HIGHEST:
                return GRAPH
        if ends:
            return JOIN if taken else POP
        return self._split(frozenset(taken)) if taken else frozenset(derived)

    def _split(self, stacks: frozenset[tuple]) -> Part | tuple[Part, Part]:
        """The part of these stacks; of high ones the lower and the upper parts whose combinations they are."""
        one = max(stacks, key=len)
        if len(one) > self.HIGH:
            for kept in (*range(self.KEPT, 0, -1), *range(self.KEPT + 1, len(one))):
                low, up = one[:-kept], one[-kept:]
                ups = [s[len(low):] for s in stacks if s[: len(low)] == low and len(s) > len(low)]
                lows = [s[:-kept] for s in stacks if s[-kept:] == up and len(s) > kept]
                if len(ups) * len(lows) == len(stacks) and all(p + u in stacks for p in lows for u in ups):
                    return self.part(frozenset(lows)), self.part(frozenset(ups))
        return self.part(stacks)


def recognise(grammar: Grammar, tokens: list[str], starts: list[str]) -> set[str]:
    """The start rules that derive the whole token list (whose last token is EOF). All start rules run over one shared stack graph.

    As long as few stacks are open, the graph is a chain of parts, whose steps are shared by all files; where more are,
    it is walked node by node.
    """
    parts = grammar.parts(starts)
    part, below = parts.part(parts.bottom), []
    for at in range(0, len(tokens), parts.SLICE):
        *below, part = parts.trimmed([*below, part])
        for tok in tokens[at : at + parts.SLICE]:
            then = part[tok]
            while then.__class__ is not Part:
                if then.__class__ is tuple:
                    below.append(then[0])
                    then = then[1]
                    continue
                if then is POP:
                    part = below.pop()
                elif then is JOIN:
                    part = parts.joined(below.pop(), part)
                elif then is GRAPH:
                    return walk_graph(grammar, tokens, starts)
                else:
                    return set(then)
                then = part[tok]
            part = then
    return walk_graph(grammar, tokens, starts)


def walk_graph(grammar: Grammar, tokens: list[str], starts: list[str]) -> set[str]:
    """What :func:`recognise` gives, with every node of the stack graph made."""
    steps, size = grammar.steps, len(grammar.steps)
    root: tuple = ([], [], 0)
    nodes: dict[int, tuple] = {}
    done: set[int] = set()
    accepted: set[str] = set()
    last = len(tokens) - 1
    span = last + 1
    todo: list[tuple] = []
    count = 1
    for name in starts:
        state = grammar.start[name]
        node = ([(-1, root, name)], [], count)
        count += 1
        nodes[state * span] = node
        todo.append((state, node, 0))
    while todo:
        s, node, i = todo.pop()
        tok = tokens[i]
        while True:
            step = steps[s].get(tok)
            if step.__class__ is int:
                s = step
                i += 1
                tok = tokens[i] if i < span else EOF
                continue
            if step is None:
                break
            if len(step) > 1:
                for kind, a, b in step[1:]:
                    if kind == "take":
                        todo.append((a, node, i + 1))
                    elif kind == "pass":
                        todo.append((a, node, i))
                    elif kind == "call":
                        key = a * span + i
                        v = nodes.get(key)
                        if v is None:
                            nodes[key] = v = ([(b, node, None)], [], count)
                            count += 1
                            todo.append((a, v, i))
                        elif not any(e[0] == b and e[1] is node for e in v[0]):
                            v[0].append((b, node, None))
                            for end in v[1]:
                                mark = (node[2] * size + b) * span + end
                                if mark not in done:
                                    done.add(mark)
                                    todo.append((b, node, end))
                    elif i not in node[1]:
                        node[1].append(i)
                        for ret, parent, name in node[0]:
                            if ret < 0:
                                if i >= last:
                                    accepted.add(name)
                                continue
                            mark = (parent[2] * size + ret) * span + i
                            if mark not in done:
                                done.add(mark)
                                todo.append((ret, parent, i))
            kind, a, b = step[0]
            if kind == "call":
                key = a * span + i
                v = nodes.get(key)
                if v is None:
                    nodes[key] = node = ([(b, node, None)], [], count)
                    count += 1
                    s = a
                    continue
                if any(e[0] == b and e[1] is node for e in v[0]):
                    break
                v[0].append((b, node, None))
                for end in v[1]:
                    mark = (node[2] * size + b) * span + end
                    if mark not in done:
                        done.add(mark)
                        todo.append((b, node, end))
                break
            if kind == "take":
                s = a
                i += 1
                tok = tokens[i] if i < span else EOF
                continue
            if kind == "pass":
                s = a
                continue
            if i in node[1]:
                break
            node[1].append(i)
            nxt = None
            for ret, parent, name in node[0]:
                if ret < 0:
                    if i >= last:
                        accepted.add(name)
                    continue
                mark = (parent[2] * size + ret) * span + i
                if mark not in done:
                    done.add(mark)
                    if nxt is None:
                        nxt = (ret, parent)
                    else:
                        todo.append((ret, parent, i))
            if nxt is None:
                break
            s, node = nxt
    return accepted
