"""Lexers that feed the derivative engine; each returns (verdict, line, token) for one source text.

verdict is None for a valid text, ``truncated`` when the end comes too early, ``token`` for a token without a
derivative and ``lexical`` for text that is no token at all.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from . import grammars
from .derivative import EMPTY, MAX_NODES, Engine

Result = tuple[str | None, int, str]
VALID: Result = (None, 0, "")


#: Memory bound of one worker's table of line shapes.
MAX_LINES = 200_000
_lines: dict[str, dict] = {}


@lru_cache(None)
def _shape(language: str):
    """Substitution that gives every plain word and every plain number one spelling, so that lines of one shape share
    one derivative.  Words after a backslash or a slash (escapes, regex flags), before a quote (string prefixes), with
    a digit first, and all words with a meaning stay as they are, as do Python's conversions and texts with named characters."""
    words = _PY_KEYWORDS if language == "python" else _words(language == "typescript")
    stay, mark = "|".join(sorted(words)), "!" if language == "python" else ""
    plain = re.compile(rf"(?<![\w\\/$#{mark}])(?<!\d\.)(?!(?:{stay})(?![\w$]))[A-Za-z_]\w*(?![\w'\"$\\])", re.A).sub
    number = re.compile(r"(?<![\w.\\$#])[1-9][0-9]*(?![\w.$])", re.A).sub
    return lambda text: text if "\\N{" in text else number("0", plain("a", text))


def _drive(language: str, text: str, scan, first) -> Result:
    """Runs ``scan`` line by line; what a line of some shape does to some state is kept."""
    eng = engine(language)
    memo = _lines.setdefault(language, {})
    if len(eng.nodes) > MAX_NODES or len(memo) > MAX_LINES:
        eng.reset()
        memo.clear()
    shape = _shape(language)(text)
    pos, state, ctx, size = 0, eng.start, first, len(shape)
    while pos < size:
        end = shape.find("\n", pos) + 1 or size
        key = (state, ctx, shape[pos:end])
        got = memo.get(key)
        if got is None:
            stop, *got, verdict = scan(eng, shape, pos, state, ctx)
            if verdict is not None:  # once more over the text itself, for its own token
                at = 0
                for _ in range(shape.count("\n", 0, pos)):
                    at = text.find("\n", at) + 1
                return scan(eng, text, at, state, ctx)[-1] or verdict
            if stop == end:
                memo[key] = got
            else:
                end = stop
        state, ctx = got
        pos = end
    return scan(eng, shape, size, state, ctx)[-1] or VALID


@lru_cache(None)
def engine(language: str) -> Engine:
    if language == "python":
        return Engine(grammars.PY, "file")
    if language == "toml":
        return Engine(grammars.TOML, "doc")
    return Engine(grammars.JS, "module", "T" if language == "typescript" else "", asi=True)


# ---------------------------------------------------------------- JavaScript and TypeScript
_JS_PUNCT = r">>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|>>>|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\+=|-=|\*=|%=|&=|\|=|\^=|<<|>>|\*\*|[{}()\[\];,<>+\-*%&|^!~?:=.@]"
_TS_PUNCT = r"\.\.\.|===|!==|\*\*=|<<=|&&=|\|\|=|\?\?=|=>|==|!=|<=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\+=|-=|\*=|%=|&=|\|=|\^=|<<|>|\*\*|[{}()\[\];,<+\-*%&|^!~?:=.@]"
_JS_BODY = r"""[ \t\v\f\xa0\ufeff\u1680\u2000-\u200a\u202f\u205f\u3000]*(?:
  ([A-Za-z_$\u0080-\uffff\U00010000-\U0010ffff\\][\w$\u200c\u200d\\\U00010000-\U0010ffff]*)
 |(PUNCT)
 |((?:0[xX][0-9a-fA-F]+(?:_[0-9a-fA-F]+)*|0[oO][0-7]+(?:_[0-7]+)*|0[bB][01]+(?:_[01]+)*|(?:0|[1-9]\d*(?:_\d+)*)(?=n))n?
   |(?:(?:0|[1-9]\d*(?:_\d+)*)(?:\.(?:\d+(?:_\d+)*)?)?|\.\d+(?:_\d+)*)(?:[eE][+-]?\d+(?:_\d+)*)?)(?![\w$])
 |('(?:[^'\\\r\n]|\\(?:\r\n|[^\r]|\r))*'|"(?:[^"\\\r\n]|\\(?:\r\n|[^\r]|\r))*")
 |([\r\n\u2028\u2029]+)
 |(//[^\r\n\u2028\u2029]*)
 |(/\*[\s\S]*?\*/)
 |(`)
 |(\#[A-Za-z_$\u0080-\uffff][\w$]*)
 |(/)
 |(\Z))"""
_JS_RE = {t: re.compile(_JS_BODY.replace("PUNCT", p), re.X) for t, p in ((False, _JS_PUNCT), (True, _TS_PUNCT))}
_TS_WORDS = frozenset("type declare namespace module abstract readonly keyof infer unique is asserts satisfies override accessor global require out".split())
_TPL = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*(`|\$\{)")
_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\r\n]|\\[^\r\n]|\[(?:[^\]\\\r\n]|\\[^\r\n])*\])+/([A-Za-z]*)")
_RESTRICTED = ("return", "break", "continue", "throw")


@lru_cache(None)
def _words(typescript: bool) -> dict[str, int]:
    """Kinds of the words with a meaning of their own."""
    kinds = engine("typescript" if typescript else "javascript").kinds
    return {w: k for w, k in kinds.items() if w.isalpha() and not w.isupper() and (typescript or w not in _TS_WORDS)}


def check_js(text: str, typescript: bool = False) -> Result:
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    if text.startswith("#!"):
        text = "//" + text
    return _drive("typescript" if typescript else "javascript", text, _scan_ts if typescript else _scan_js, False)


def _scan_ts(*args):
    return _scan_js(*args, typescript=True)


def _scan_js(eng: Engine, text: str, pos: int, state: int, ctx: bool, typescript: bool = False):
    """Tokens from a line start to the first line end outside comments and templates, or to the end of the text.
    ctx: the token before the line was return, break, continue or throw."""
    kinds, trans, step = eng.kinds, eng.trans, eng.step
    match = _JS_RE[typescript].match
    name, number, string, regex = kinds["NAME"], kinds["NUMBER"], kinds["STRING"], kinds["REGEX"]
    div, diveq, inc, dec, close, bracket = kinds["/"], kinds["/="], kinds["++"], kinds["--"], kinds["}"], kinds["["]
    restricted = {kinds[x] for x in _RESTRICTED}
    nl, last, size = 1, ctx, len(text)
    braces: list[bool] = []  # braces opened here; True where one belongs to a template
    words = _words(typescript)
    row = trans.setdefault(state, {})
    while True:
        m = match(text, pos)
        if m is None:
            rest = text[pos : pos + 2000].lstrip()
            if rest.startswith("/*"):
                return size, state, False, ("truncated", text.count("\n", 0, pos) + 1, "comment")
            return size, state, False, ("lexical", text.count("\n", 0, pos) + 1, rest[:20])
        group = m.lastindex
        at, pos = m.start(group), m.end()
        if group == 1:
            kind = words.get(m[1], name)
            if kind != name:
                pass
            elif "\\" in m[1] and not re.fullmatch(r"(?:[^\\]|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})+", m[1]):
                return size, state, False, ("lexical", text.count("\n", 0, at) + 1, m[1][:20])
            elif not m[1].isascii() and "\\" not in m[1] and not m[1].replace("$", "a").replace("\u200c", "").replace("\u200d", "").isidentifier():
                return size, state, False, ("lexical", text.count("\n", 0, at) + 1, m[1][:20])
        elif group == 2:
            p = m[2]
            if p == "{":
                braces.append(False)
            elif p == "}" and braces and braces.pop():
                t = _TPL.match(text, pos)
                if not t:
                    return size, state, False, ("truncated", text.count("\n", 0, at) + 1, "template")
                pos = t.end()
                if t[1] == "${":
                    braces.append(True)
                p = "TMID" if t[1] == "${" else "TTAIL"
            kind = kinds["GTJ"] if typescript and p == ">" and text[pos : pos + 1] in (">", "=") and text[pos : pos + 2] != "=>" and pos < size else kinds[p]
        elif group == 3:
            kind = number
        elif group == 4:
            kind = string
        elif group == 5:
            nl = 1
            if "\n" in m[5] and True not in braces:
                return at + m[5].index("\n") + 1, state, last, None
            continue
        elif group == 6:
            continue
        elif group == 7:
            if "\n" in m[7]:
                nl = 1
            continue
        elif group == 8:
            t = _TPL.match(text, pos)
            if not t:
                return size, state, False, ("truncated", text.count("\n", 0, at) + 1, "template")
            pos = t.end()
            if t[1] == "${":
                braces.append(True)
            kind = kinds["THEAD" if t[1] == "${" else "TPL"]
        elif group == 9:
            kind = kinds["PRIVATE"]
        elif group == 10:
            wide = text.startswith("/=", at)
            if eng.deriv(state, diveq if wide else div) != EMPTY:
                pos = at + 1 + wide
                kind = diveq if wide else div
            else:
                r = _REGEX.match(text, at)
                if not r or not re.fullmatch(r"(?!.*(.).*\1)[dgimsuyv]*", r[1]):
                    return size, state, False, ("lexical", text.count("\n", 0, at) + 1, text[at : at + 20])
                pos, kind = r.end(), regex
        else:
            if eng.accepts(state):
                return size, state, False, None
            return size, state, False, ("truncated", text.count("\n") + 1, "")
        if nl and typescript and kind == bracket:
            kind = kinds["NLB"]
        code = kind << 2
        if nl or kind == close:
            code |= 1
            if nl and (kind == inc or kind == dec or last):
                code |= 2
        new = row.get(code)
        if new is None:
            new = row[code] = step(state, code)
        if new == EMPTY:
            return size, state, False, ("token", text.count("\n", 0, at) + 1, text[at:pos][:40])
        state, nl, last = new, 0, kind in restricted
        row = trans.get(new)
        if row is None:
            row = trans[new] = {}


# ---------------------------------------------------------------- Python
_PY_KEYWORDS = frozenset("False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield match case type".split())
_PY_RE = re.compile(
    r"""[ \t\f]*(?:
  ((?:[rR][bB]?|[bB][rR]?|[uU])?(?:'{3}|"{3}|'|")|(?:[fF][rR]?|[rR][fF])(?:'{3}|"{3}|'|"))
 |([^\W\d]\w*)
 |(\*\*=|//=|>>=|<<=|\.\.\.|:=|->|\+=|-=|\*=|/=|%=|&=|\|=|\^=|@=|==|!=|<=|>=|<<|>>|\*\*|//|[()\[\]{},:;=<>+\-*/%&|^~@!]|\.(?!\d))
 |((?:0[xX](?:_?[0-9a-fA-F])+|0[oO](?:_?[0-7])+|0[bB](?:_?[01])+
   |(?:(?:\d(?:_?\d)*)?\.\d(?:_?\d)*|\d(?:_?\d)*\.?)(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?))
 |(\n)
 |(\#[^\n]*)
 |(\\\n)
 |(\Z))""",
    re.X,
)
_PY_STR = {q: re.compile((r"(?:[^\\%s\n]|\\[\s\S])*%s" if len(q) == 1 else r"(?:[^\\%s]|\\[\s\S]|%s(?!%s))*?%s") % ((q, q) if len(q) == 1 else (q[0], q[0], q[0] * 2, q))) for q in ("'", '"', "'''", '"""')}
_PY_NUM_TAIL = re.compile(r"(?:and|else|for|if|in|is|or|not)(?!\w)|(?!\w)")
_PAIRS = {")": "(", "]": "[", "}": "{"}
#: How deep the interpreter lets brackets and blocks nest.
MOST_BRACKETS, MOST_INDENTS = 200, 100
_ESCAPED = re.compile(r"\\(?:x(?P<x>[0-9a-fA-F]{2})?|u(?P<u>[0-9a-fA-F]{4})?|U(?P<U>(?:000[0-9a-fA-F]|0010)[0-9a-fA-F]{4})?|N(?:\{(?P<N>[^}]*)\})?|[\s\S])")


def _escapes(body: str, raw: bool, binary: bool) -> bool:
    """Whether a literal's characters and escapes are those of its kind."""
    if binary and not body.isascii():
        return False
    if raw or "\\" not in body:
        return True
    for m in _ESCAPED.finditer(body):
        kind = m[0][1]
        if kind == "x" and m["x"] is None or not binary and (kind == "u" and m["u"] is None or kind == "U" and m["U"] is None):
            return False
        if kind == "N" and not binary:
            try:
                unicodedata.lookup(m["N"] or "")
            except KeyError:
                return False
    return True


def check_python(text: str) -> Result:
    text = text.removeprefix("\ufeff").replace("\r\n", "\n").replace("\r", "\n")
    if "\0" in text:
        return "lexical", 1, "\\0"
    if text and text[-1] != "\n":
        text += "\n"
    return _drive("python", text, _scan_python, ((0,), (0,), ()))


def _scan_python(eng: Engine, text: str, pos: int, state: int, ctx: tuple):
    """Tokens from a line start to the first line end outside strings, or to the end of the text.
    ctx: columns of the open blocks with tabs as eight and as one, and the open brackets."""
    kinds, trans, step = eng.kinds, eng.trans, eng.step
    match, size = _PY_RE.match, len(text)
    row = trans.setdefault(state, {})
    indents, alts, bol, blank = [*ctx[0]], [*ctx[1]], not ctx[2], not ctx[2]
    # what is open, innermost last: ( [ { brackets, F the literal part of an f-string, f its field, S a field's format
    opened: list[tuple[str, str]] = [(x, "") for x in ctx[2]]
    pending: list[int] = []
    done = False

    def line(at):
        return text.count("\n", 0, min(at, size)) + 1

    NL, NAME, STRING, NUMBER = kinds["NEWLINE"], kinds["NAME"], kinds["STRING"], kinds["NUMBER"]
    while True:
        if bol and not opened:
            col = alt = 0
            while pos < size and text[pos] in " \t\f":
                c = text[pos]
                col, alt = (col + 1, alt + 1) if c == " " else ((col // 8 + 1) * 8, alt + 1) if c == "\t" else (0, 0)
                pos += 1
            nxt = text[pos : pos + 1]
            if nxt and nxt not in "#\n":
                if col == indents[-1]:
                    if alt != alts[-1]:
                        return size, state, ctx, ("lexical", line(pos), "tabs")
                elif col > indents[-1]:
                    if alt <= alts[-1]:
                        return size, state, ctx, ("lexical", line(pos), "tabs")
                    indents.append(col)
                    alts.append(alt)
                    if len(indents) > MOST_INDENTS:
                        return size, state, ctx, ("lexical", line(pos), "indentation")
                    pending.append(kinds["INDENT"])
                else:
                    while col < indents[-1]:
                        indents.pop()
                        alts.pop()
                        pending.append(kinds["DEDENT"])
                    if col != indents[-1]:
                        return size, state, ctx, ("lexical", line(pos), "unindent")
            bol = False
        at, top, quote = pos, *(opened[-1] if opened else ("", ""))
        if top in ("F", "S") and top:
            mid, raw = pos, quote[0] == "r"
            quote = quote.lstrip("r")
            while True:
                if pos >= size:
                    return size, state, ctx, ("truncated", line(at), "f-string")
                c = text[pos]
                if top == "F" and c == "\\" and text[pos + 1 : pos + 2] not in ("{", "}"):
                    named = re.compile(r"\\N\{[^{}\n]*\}").match(text, pos) if not raw else None
                    pos = named.end() if named else pos + 2
                elif text.startswith(quote, pos) and top == "F":
                    break
                elif c == "\n" and len(quote) == 1:
                    return size, state, ctx, ("lexical", line(pos), "f-string")
                elif top == "F" and c in "{}" and text[pos + 1 : pos + 2] == c:
                    pos += 2
                elif c in "{}":
                    break
                else:
                    pos += 1
            if not _escapes(text[mid:pos], raw, False):
                return size, state, ctx, ("lexical", line(mid), text[mid:pos].split("\n")[0][:20])
            if pos > mid:
                pending.append(kinds["FMID"])
            if c == "{":
                pos += 1
                opened.append(("f", "r" * raw + quote))
                pending.append(kinds["{"])
            elif c == "}":
                if top == "F":
                    return size, state, ctx, ("lexical", line(pos), "}")
                pos += 1
                del opened[-2:]
                pending.append(kinds["}"])
            else:
                pos += len(quote)
                opened.pop()
                pending.append(kinds["FEND"])
        else:
            m = match(text, pos)
            if m is None:
                return size, state, ctx, ("lexical", line(pos), text[pos : pos + 20].strip()[:20])
            group = m.lastindex
            at, pos = m.start(group), m.end()
            kind, done = -1, False
            if group == 2:
                w = m[2]
                if top == "f" and text[max(0, at - 80) : at].rstrip(" \t\f")[-1:] == "!" and (text[at - 1] != "!" or w not in ("s", "r", "a")):
                    return size, state, ctx, ("token", line(at), w[:20])
                if w in _PY_KEYWORDS:
                    kind = kinds[w]
                else:
                    if not w.isascii() and not w.isidentifier():
                        return size, state, ctx, ("lexical", line(at), w[:20])
                    kind = NAME
            elif group == 3:
                p = m[3]
                if top == "f" and p in (":", ":="):
                    p, pos = ":", at + 1
                    opened.append(("S", quote))
                elif p in "([{":
                    opened.append((p, ""))
                    if len(opened) > MOST_BRACKETS:
                        return size, state, ctx, ("lexical", line(at), p)
                elif p in ")]}":
                    if top != ("f" if top == "f" and p == "}" else _PAIRS[p]):
                        return size, state, ctx, ("token", line(at), p)
                    opened.pop()
                kind = kinds[p]
            elif group == 1:
                q = m[1].lstrip("rRbBuUfF")
                if "f" in m[1].lower():
                    opened.append(("F", "r" + q if "r" in m[1].lower() else q))
                    kind = kinds["FSTART"]
                else:
                    s = _PY_STR[q].match(text, pos)
                    if s is None:
                        return size, state, ctx, (("truncated" if len(q) == 3 else "lexical"), line(at), "string")
                    prefix = m[1][: -len(q)].lower()
                    if not _escapes(text[pos : s.end() - len(q)], "r" in prefix, "b" in prefix):
                        return size, state, ctx, ("lexical", line(at), text[at : s.end()].split("\n")[0][:20])
                    pos, kind = s.end(), kinds["BYTES"] if "b" in prefix else STRING
            elif group == 4:
                if not _PY_NUM_TAIL.match(text, pos) or re.fullmatch(r"0[\d_]*[1-9][\d_]*", m[4]):
                    return size, state, ctx, ("lexical", line(at), text[at : pos + 10].split("\n")[0][:20])
                kind = NUMBER
            elif group == 5:
                if any(x in "FfS" for x, _ in opened):
                    continue
                done = True
                if not opened and not blank:
                    kind, blank = NL, True
            elif group in (6, 7):
                if group == 7 and pos >= size:
                    return size, state, ctx, ("truncated", line(at), "\\")
                continue
            else:
                if opened:
                    return size, state, ctx, ("truncated", line(at), "")
                pending += [kinds["DEDENT"]] * (len(indents) - 1)
                pending.append(-2)
            if kind >= 0:
                pending.append(kind)
                if kind != NL:
                    blank = False
        for kind in pending:
            if kind == -2:
                return size, state, ctx, None if eng.nullable(state) else ("truncated", line(size), "")
            code = kind << 2
            new = row.get(code)
            if new is None:
                new = row[code] = step(state, code)
            if new == EMPTY:
                return size, state, ctx, (("token" if text[pos:].strip() else "truncated"), line(at), text[at:pos].split("\n")[0][:40])
            state = new
            row = trans.get(new)
            if row is None:
                row = trans[new] = {}
        pending.clear()
        if done:
            return pos, state, (tuple(indents), tuple(alts), tuple(x for x, _ in opened)), None


# ---------------------------------------------------------------- TOML 1.0
_ESC = r'\\(?:[btnfr"\\]|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8})'
_CTRL = r"\x00-\x08\x0a-\x1f\x7f"
_T_STRING = rf'"(?:[^"\\{_CTRL}]|{_ESC})*"|\'[^\'{_CTRL}]*\''
_T_ML = rf'"""\n?(?:[^"\\\x00-\x08\x0b-\x1f\x7f]|{_ESC}|\\[ \t]*\n[ \t\n]*|"{{1,2}}(?!"))*"{{3,5}}|\'\'\'\n?(?:[^\'\x00-\x08\x0b-\x1f\x7f]|\'{{1,2}}(?!\'))*\'{{3,5}}'
_T_DATE = r"\d{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])"
_T_TIME = r"(?:[01]\d|2[0-3]):[0-5]\d:[0-5]\d(?:\.\d+)?"
_T_SCALAR = rf"{_T_DATE}(?:[Tt ]{_T_TIME}(?:[Zz]|[+-](?:[01]\d|2[0-3]):[0-5]\d)?)?|{_T_TIME}|true|false|[+-]?(?:inf|nan)|0x[0-9a-fA-F](?:_?[0-9a-fA-F])*|0o[0-7](?:_?[0-7])*|0b[01](?:_?[01])*|[+-]?(?:0|[1-9](?:_?\d)*)(?:\.\d(?:_?\d)*)?(?:[eE][+-]?\d(?:_?\d)*)?"
_T_KEY = re.compile(rf"[ \t]*(?:({_T_STRING})|([A-Za-z0-9_-]+)|(\[\[|\]\]|[\[\].=,{{}}])|(\n)|(#[^{_CTRL}]*)|(\Z))")
_T_VAL = re.compile(rf"[ \t]*(?:({_T_ML})|({_T_STRING})|((?:{_T_SCALAR})(?=[\s,\]}}#]|\Z))|([\[\]{{}},])|(\n)|(#[^{_CTRL}]*)|(\Z))")


class _Defined:
    """The keys and tables of a TOML text, as far as its rules on redefinition need them.

    A table is a dict: name -> value (None), inline or array of values (False), table (dict) or array of tables (list of one dict, its last).
    A table that a header has opened, or dotted keys of an earlier section, is not opened again by either."""

    def __init__(self):
        self.root: dict = {}
        self.here = self.root
        self.headed: set[int] = set()
        self.dotted: set[int] = set()
        self.kept: list = []  # keeps ids unique

    def _table(self) -> dict:
        self.kept.append({})
        return self.kept[-1]

    def header(self, path: list[str], array: bool) -> bool:
        at = self.root
        self.headed |= self.dotted
        self.dotted.clear()
        for name in path[:-1]:
            at = at.setdefault(name, self._table())
            at = at[0] if isinstance(at, list) else at
            if not isinstance(at, dict):
                return False
        last = at.get(path[-1])
        if array:
            if last is None and path[-1] not in at:
                last = at[path[-1]] = []
            if not isinstance(last, list):
                return False
            last[:] = [self._table()]
            self.here = last[0]
            return True
        if path[-1] not in at:
            last = at[path[-1]] = self._table()
        if not isinstance(last, dict) or id(last) in self.headed:
            return False
        self.headed.add(id(last))
        self.here = last
        return True

    def key(self, table: dict, path: list[str]) -> bool:
        at = table
        for name in path[:-1]:
            new = name not in at
            at = at.setdefault(name, self._table())
            if not isinstance(at, dict) or not new and id(at) in self.headed:
                return False
            self.dotted.add(id(at))
        if path[-1] in at:
            return False
        at[path[-1]] = None
        return True


def _toml_name(kind: str, token: str) -> str:
    if kind == "BARE" or token[0] == "'":
        return token if kind == "BARE" else token[1:-1]
    simple = {"b": "\b", "t": "\t", "n": "\n", "f": "\f", "r": "\r", '"': '"', "\\": "\\"}
    return re.sub(r"\\(?:u(.{4})|U(.{8})|(.))", lambda m: simple[m[3]] if m[3] else chr(min(int(m[1] or m[2], 16), 0x10FFFF)), token[1:-1])


def check_toml(text: str, members: list | None = None) -> Result:
    """``members``, if given, receives (key path, start, end, True) of every string value, offsets without quotes; the text must have plain line ends then."""
    eng = engine("toml")
    if len(eng.nodes) > MAX_NODES:
        eng.reset()
    kinds, state, pos = eng.kinds, eng.start, 0
    text = text.removeprefix("\ufeff").replace("\r\n", "\n")
    stack: list[str] = []  # '[' array, '{' inline table
    values = False  # whether a value is due next
    known, path, head = _Defined(), [], ""
    inner: list[dict] = []  # the open inline tables
    section: list[str] = []
    names: list[list[str]] = [[]]  # the keys around the current value, one entry for each open inline table
    while True:
        m = (_T_VAL if values else _T_KEY).match(text, pos)
        if m is None:
            at = pos
            rest = text[pos:].lstrip(" \t")
            late = rest.startswith(('"""', "'''")) and values
            return ("truncated" if late or not rest.strip("\n") else "lexical"), text.count("\n", 0, at) + 1, rest.split("\n")[0][:20]
        group = m.lastindex
        at, pos = m.start(group), m.end()
        if values:
            if group == 6:
                continue
            name = {1: "MLSTRING", 2: "STRING", 3: "SCALAR", 4: m[4], 5: "NL", 7: "EOF"}[group]
        else:
            if group == 5:
                continue
            name = {1: "STRING", 2: "BARE", 3: m[3], 4: "NL", 6: "EOF"}[group]
            if name == "]]" and stack:
                name, pos = "]", at + 1
        if name == "EOF":
            ok = eng.nullable(state) or eng.nullable(eng.deriv(state, kinds["NL"]))
            return VALID if ok else ("truncated", text.count("\n") + 1, "")
        state = eng.deriv(state, kinds[name])
        if state == EMPTY:
            return ("truncated" if not text[pos:].strip() and name == "NL" else "token"), text.count("\n", 0, at) + 1, name
        if not values and name in ("STRING", "BARE"):
            path.append(_toml_name(name, m[group]))
        elif not values and name in ("[", "[["):
            head, path = name, []
        elif head and name in ("]", "]]"):
            if not known.header(path, head == "[["):
                return "token", text.count("\n", 0, at) + 1, path[-1][:20]
            head, section, path = "", path, []
        if name == "=":
            if not known.key(inner[-1] if inner else known.here, path):
                return "token", text.count("\n", 0, at) + 1, path[-1][:20]
            names[-1], path = path, []
        if members is not None and values and name in ("STRING", "MLSTRING"):
            quotes = 3 if name == "MLSTRING" else 1
            members.append((".".join([*section, *(x for k in names for x in k)]), at + quotes, pos - quotes, True))
        if name == "{":
            inner.append({})
            known.kept.append(inner[-1])
            names.append([])
        elif name == "}" and inner:
            inner.pop()
            names.pop()
        if name == "=":
            values = True
        elif values and name == "[":
            stack.append("[")
        elif values and name == "{":
            stack.append("{")
            values = False
        elif name in ("]", "}") and stack:
            stack.pop()
            values = bool(stack) and stack[-1] == "["
            if stack and stack[-1] == "{":
                values = False
        elif name == "," and stack:
            values = stack[-1] == "["
        elif name in ("STRING", "MLSTRING", "SCALAR") and values:
            values = bool(stack) and stack[-1] == "["
        elif name == "NL" and not stack:
            values = False


CHECKERS = {
    ".py": ("python", check_python),
    ".js": ("javascript", check_js),
    ".mjs": ("javascript", check_js),
    ".cjs": ("javascript", check_js),
    ".ts": ("typescript", lambda text: check_js(text, True)),
    ".toml": ("toml", check_toml),
}
