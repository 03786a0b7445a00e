"""Memoised parsing with derivatives over token streams.

A language is a hash-consed expression over token kinds; its derivative by a token is the language of what may follow.
Derivatives are memoised per (expression, token), so a lazily built automaton answers almost every step with two dict
probes.  An *empty* derivative names the exact failing token; a non-nullable derivative at the end means truncation.
Nullability and emptiness are least fixpoints, and a derivative that meets itself refers to itself, so rules may be
left-recursive; texts may nest as deep as they like.

Grammar notation: ``'x'`` a literal token, ``UPPER`` a token class, ``[x]`` optional, ``x*``, ``x+``, ``|`` choice.
A rule is read under a context of flags.  ``rule<+AB>`` adds flags, ``<-A>`` removes, ``<=A>`` sets; an alternative that
starts with ``?A`` (``?~A``) exists only with (without) the flag.  Flag ``0`` marks the left edge of a phrase: only
references written ``^rule`` inherit it.
"""

from __future__ import annotations

import re
import sys

EMPTY, EPS = 0, 1
_TOK, _SEQ, _ALT, _STAR, _REF = 2, 3, 4, 5, 6
#: Memory bound of one engine: past so many expressions all memo tables are rebuilt between two files.
MAX_NODES = 300_000
#: Derivatives recurse along a text's nesting, in interpreter frames that take no C stack.
DEPTH = 2_000_000

_LEX = re.compile(r"\s*(?:(#[^\n]*)|('[^']*')|(\^?[a-z_][a-z_0-9]*)(<[^>]*>)?|([A-Z][A-Z_0-9]*)|(\?~?[A-Z0])|([()\[\]|*+]))")
_RULE = re.compile(r"^([a-z_][a-z_0-9]*)\s*:", re.M)


def _read(text: str):
    """Syntax tree of one rule body."""
    toks, pos = [], 0
    while text[pos:].strip():
        m = _LEX.match(text, pos)
        if not m:
            raise ValueError(f"bad grammar at {text[pos:pos + 40]!r}")
        pos = m.end()
        if m[1] is None:
            toks.append(m)
    i = 0

    def alt():
        nonlocal i
        arms = [seq()]
        while i < len(toks) and toks[i][7] == "|":
            i += 1
            arms.append(seq())
        return ("alt", arms)

    def seq():
        nonlocal i
        conds, parts = [], []
        while i < len(toks) and toks[i][7] not in ("|", ")", "]"):
            m = toks[i]
            i += 1
            if m[6]:
                conds.append((m[6][-1], "~" not in m[6]))
                continue
            if m[7] in ("(", "["):
                node = alt()
                i += 1
                if m[7] == "[":
                    node = ("opt", node)
            elif m[2]:
                node = ("tok", m[2][1:-1])
            elif m[5]:
                node = ("tok", m[5])
            else:
                node = ("ref", m[3].lstrip("^"), m[3][0] == "^", (m[4] or "")[1:-1])
            while i < len(toks) and toks[i][7] in ("*", "+"):
                node = ("star" if toks[i][7] == "*" else "plus", node)
                i += 1
            parts.append(node)
        return ("seq", conds, parts)

    tree = alt()
    if i != len(toks):
        raise ValueError("unbalanced grammar: " + text[:60])
    return tree


class Engine:
    """One language.  ``state`` values are expression ids; ``step`` is the memoised derivative."""

    def __init__(self, grammar: str, start: str, flags: str = "", asi: bool = False):
        heads = list(_RULE.finditer(grammar))
        self.rules = {m[1]: _read(grammar[m.end() : n.start() if n else None]) for m, n in zip(heads, [*heads[1:], None])}
        self.fixed, self.start_rule, self.asi = frozenset(flags), start, asi
        self.kinds: dict[str, int] = {}
        sys.setrecursionlimit(max(sys.getrecursionlimit(), DEPTH))
        for name in ("EOF", "ASI"):
            self.kind(name)
        self._names(self.rules.values())
        self.reset()

    def _names(self, trees):
        for t in trees:
            if t[0] == "tok":
                self.kind(t[1])
            elif t[0] == "alt":
                self._names(t[1])
            elif t[0] == "seq":
                self._names(t[2])
            elif t[0] in ("opt", "star", "plus"):
                self._names(t[1:2])

    def kind(self, name: str) -> int:
        return self.kinds.setdefault(name, len(self.kinds))

    def reset(self) -> None:
        self.nodes: list[tuple] = [("empty",), ("eps",)]
        self.ids: dict[tuple, int] = {}
        self.null: dict[int, bool] = {EMPTY: False, EPS: True}
        self.live: dict[int, bool] = {EMPTY: False, EPS: True}
        self.open: set[tuple[int, int]] = set()
        self.loops: set[int] = set()
        self.memo: list[dict[int, int]] = [{}, {}]
        self.trans: dict[int, dict[int, int]] = {}
        self.bodies: dict[int, int] = {}
        self.start = self._ref(self.start_rule, frozenset())

    # hash-consed constructors
    def _new(self, key: tuple) -> int:
        n = self.ids.get(key)
        if n is None:
            n = self.ids[key] = len(self.nodes)
            self.nodes.append(key)
            self.memo.append({})
        return n

    def _ref(self, name: str, ctx: frozenset) -> int:
        if name not in self.rules:
            raise KeyError(name)
        return self._new((_REF, name, ctx))

    def cat(self, a: int, b: int) -> int:
        if a == EMPTY or b == EMPTY:
            return EMPTY
        if a == EPS:
            return b
        if b == EPS:
            return a
        node = self.nodes[a]
        if node[0] == _SEQ:
            return self._new((_SEQ, node[1], self.cat(node[2], b)))
        return self._new((_SEQ, a, b))

    def alt(self, parts) -> int:
        flat: set[int] = set()
        for p in parts:
            node = self.nodes[p]
            if node[0] == _ALT:
                flat.update(node[1])
            elif p != EMPTY:
                flat.add(p)
        if len(flat) > 1:
            by: dict[int, list[int]] = {}
            for p in flat:
                node = self.nodes[p]
                by.setdefault(node[1] if node[0] == _SEQ else p, []).append(node[2] if node[0] == _SEQ else EPS)
            if len(by) < len(flat):  # common heads share one tail: h.x | h.y = h.(x | y)
                flat = {self.cat(h, self.alt(ts)) for h, ts in by.items()}
        if not flat:
            return EMPTY
        return flat.pop() if len(flat) == 1 else self._new((_ALT, tuple(sorted(flat))))

    def star(self, a: int) -> int:
        return EPS if a in (EMPTY, EPS) else self._new((_STAR, a))

    def _build(self, tree, ctx: frozenset) -> int:
        what = tree[0]
        if what == "alt":
            return self.alt([self._build(t, ctx) for t in tree[1]])
        if what == "seq":
            if any((flag in ctx or flag in self.fixed) != wanted for flag, wanted in tree[1]):
                return EMPTY
            out = EPS
            for t in reversed(tree[2]):
                out = self.cat(self._build(t, ctx), out)
            return out
        if what == "tok":
            return self._new((_TOK, self.kinds[tree[1]]))
        if what == "opt":
            return self.alt([EPS, self._build(tree[1], ctx)])
        if what == "star":
            return self.star(self._build(tree[1], ctx))
        if what == "plus":
            a = self._build(tree[1], ctx)
            return self.cat(a, self.star(a))
        _, name, edge, change = tree
        new = set(ctx) if edge else set(ctx) - {"0"}
        for op, letters in re.findall(r"([+\-=])([A-Z0]*)", change):
            new = set(letters) if op == "=" else new | set(letters) if op == "+" else new - set(letters)
        return self._ref(name, frozenset(new))

    def body(self, n: int) -> int:
        b = self.bodies.get(n)
        if b is None:
            _, name, ctx = self.nodes[n]
            b = self.bodies[n] = self._build(self.rules[name], ctx)
        return b

    def _least(self, n: int, known: dict[int, bool], token: bool) -> bool:
        """Least fixpoint of a property that a sequence has if both parts have it, a choice if one has; kept in ``known``."""
        below: dict[int, tuple] = {}
        todo = [n]
        while todo:
            x = todo.pop()
            if x in known or x in below:
                continue
            node = self.nodes[x]
            if node[0] in (_TOK, _STAR):
                known[x] = token or node[0] == _STAR
                continue
            below[x] = node[1:] if node[0] == _SEQ else node[1] if node[0] == _ALT else (self.body(x),)
            todo.extend(below[x])
        value = dict.fromkeys(below, False)
        changed = True
        while changed:
            changed = False
            for x in reversed(below):
                if not value[x]:
                    parts = [value[p] if p in value else known[p] for p in below[x]]
                    if all(parts) if self.nodes[x][0] == _SEQ else any(parts):
                        value[x] = changed = True
        known.update(value)
        return known[n]

    def nullable(self, n: int) -> bool:
        v = self.null.get(n)
        return self._least(n, self.null, False) if v is None else v

    def alive(self, n: int) -> int:
        """The expression, or the empty one if it holds no text at all; only derivatives that refer to themselves can hide that."""
        return n if not self.loops or self._least(n, self.live, True) else EMPTY

    def deriv(self, n: int, t: int) -> int:
        out = self.memo[n].get(t)
        if out is not None:
            return out
        node = self.nodes[n]
        kind = node[0]
        if kind == _TOK:
            out = EPS if node[1] == t else EMPTY
        elif kind == _SEQ:
            out = self.cat(self.deriv(node[1], t), node[2])
            if self.nullable(node[1]):
                out = self.alt([out, self.deriv(node[2], t)])
        elif kind == _ALT:
            out = self.alt([self.deriv(x, t) for x in node[1]])
        elif kind == _STAR:
            out = self.cat(self.deriv(node[1], t), n)
        elif kind == _REF:
            loop = (_REF, ("derivative", n, t), frozenset())
            if (n, t) in self.open:
                self.loops.add(self._new(loop))
                return self.ids[loop]
            self.open.add((n, t))
            out = self.deriv(self.body(n), t)
            self.open.discard((n, t))
            if loop in self.ids:
                self.bodies[self.ids[loop]] = out
                out = self.alive(out)
        else:
            out = EMPTY
        self.memo[n][t] = out
        return out

    def step(self, state: int, code: int) -> int:
        """code: 4 * kind + 2 * (insert a semicolon first) + (a line break precedes, or a semicolon may be inserted)."""
        t = code >> 2
        if code & 2 and (forced := self.alive(self.deriv(state, 1))) != EMPTY:
            return self.alive(self.deriv(forced, t))
        out = self.alive(self.deriv(state, t))
        if out == EMPTY and code & 1 and self.asi:
            out = self.alive(self.deriv(self.deriv(state, 1), t))
        return out

    def accepts(self, state: int) -> bool:
        return self.nullable(state) or (self.asi and self.nullable(self.deriv(state, 1)))

    def run(self, codes, state: int | None = None) -> tuple[int, int]:
        """(-1, state) when every token has a derivative, else (index of the failing token, last live state)."""
        trans = self.trans
        state = self.start if state is None else state
        row = trans.setdefault(state, {})
        for i, code in enumerate(codes):
            new = row.get(code)
            if new is None:
                new = row[code] = self.step(state, code)
            if new == EMPTY:
                return i, state
            state = new
            row = trans.get(new)
            if row is None:
                row = trans[new] = {}
        return -1, state
