"""Configuration formats as members: (key path, offset of the value, its end, whether it is quoted), offsets in the text itself.

``members`` reads JSON, TOML, INI and environment files and YAML block mappings as a whole; text of no such format is
code, whose string literals are read the same way (with their escapes undone and offsets kept) and whose open brackets
give the path of whatever stands in them.  Every reader goes over the text once.
"""

from __future__ import annotations

import re
from bisect import bisect_right

Member = tuple[str, int, int, bool]

_JSON = re.compile(r'[ \t\r\n]*(?:("(?:[^"\\\x00-\x1f]|\\.)*")|(-?\d[\d.eE+\-]*|true|false|null)|([{}\[\],:])|\Z)')
_INI = re.compile(r"[ \t]*(?:(?P<skip>[#;!].*)?$|\[\[?(?P<section>[^\[\]\n]+)\]\]?[ \t]*(?:[#;].*)?$|(?:export[ \t]+)?(?P<key>[A-Za-z_][\w.\-]*)[ \t]*(?:=|:(?=[ \t]))[ \t]*(?P<value>.*)$)")
_YAML = re.compile(r"""(?P<indent>[ ]*)(?P<dash>(?:-[ ]+)*)(?P<key>"[^"\n]*"|'[^'\n]*'|[A-Za-z_$][\w.$/\-]*(?:[ ][\w.$/\-]+)*)[ ]*:(?:[ \t]+(?P<value>.*))?$""")
_YAML_ITEM = re.compile(r"[ ]*-(?:[ ]+(?P<value>.*))?$")
_SCALAR = re.compile(r"""(?:[&!][^\s]*[ \t]+)*(?:"(?P<d>(?:[^"\\]|\\.)*)"|'(?P<s>(?:[^']|'')*)'|(?P<p>[^\s"'{\[|>&*!%@`#](?:[^#\n]|(?<![ \t])\#)*?))[ \t]*(?:[ \t][#;].*)?$""")
_LITERAL = re.compile(
    r"""(?P<q>\"{3}|'{3})(?P<long>(?:\\[\s\S]|(?!(?P=q))[\s\S])*)(?P=q)|"(?P<d>(?:[^"\\\n]|\\[\s\S])*)"|'(?P<s>(?:[^'\\\n]|\\[\s\S])*)'|`(?P<t>(?:[^`\\]|\\[\s\S])*)`
  |(?P<comment>\#(?![0-9a-fA-F]{3,8}\b)[^\n]*|//[^\n]*|/\*[\s\S]*?\*/)
  |(?P<section>^[ \t]*\[\[?[A-Za-z_"'][\w.\-"' ]*\]\]?[ \t]*\r?$)|(?P<bracket>[{}\[\]()])""",
    re.X | re.M,
)
_MEMBER = re.compile(r"""["']?([\w.\-$]+)["']?\]?\s*(?::\s*[\w<>\[\]|. ]+=|[:=]|=>)\s*[\w.]*\s*$""")
_ESCAPE = re.compile(r"\\(?:u([0-9a-fA-F]{4})|x([0-9a-fA-F]{2})|([\s\S]))")
_PLAIN = {"n": "\n", "r": "\r", "t": "\t"}


def json_members(text: str) -> list[Member] | None:
    """Strings under the keys of one JSON value; null for anything else.  A value in an array has its array's path."""
    out: list[Member] = []
    path: list[str | None] = []  # per open container the key of its current member; null in arrays
    pos, due = 0, "value"
    while True:
        m = _JSON.match(text, pos)
        if m is None:
            return None
        pos = m.end()
        string, scalar, mark = m.groups()
        if string and due in ("key", "first key"):
            path[-1], due = string[1:-1], ":"
        elif (string or scalar) and due in ("value", "first value"):
            if string and path:
                out.append((".".join(p for p in path if p), m.start(1) + 1, m.end(1) - 1, True))
            due = ","
        elif mark in ("{", "[") and due in ("value", "first value"):
            path.append("" if mark == "{" else None)
            due = "first key" if mark == "{" else "first value"
        elif mark == ":" and due == ":":
            due = "value"
        elif mark == "," and due == "," and path:
            due = "value" if path[-1] is None else "key"
        elif mark in ("}", "]") and path and due in (",", "first key" if mark == "}" else "first value") and (path[-1] is None) == (mark == "]"):
            path.pop()
            due = ","
        elif not (string or scalar or mark):
            return out if due == "," and not path and out is not None else None
        else:
            return None


def toml_members(text: str) -> list[Member] | None:
    from .lexers import check_toml

    out: list[Member] = []
    whole = text.removeprefix("\ufeff").replace("\r\n", " \n")
    if check_toml(whole, out)[0] is not None:
        return None
    shift = len(text) - len(whole)
    return [(p, a + shift, b + shift, q) for p, a, b, q in out]


def _scalar(value: str, at: int) -> tuple[int, int, bool] | None:
    m = _SCALAR.match(value)
    if not m:
        return None
    kind = "d" if m["d"] is not None else "s" if m["s"] is not None else "p"
    return at + m.start(kind), at + m.end(kind), kind != "p"


def ini_members(text: str) -> list[Member] | None:
    """Sections, then ``key = value`` or ``key: value``, one a line; no indentation under a key."""
    out: list[Member] = []
    section, pos, some = "", 0, False
    for row in text.split("\n"):
        line = row.rstrip("\r")
        m = _INI.match(line)
        if m is None or line[:1] in (" ", "\t") and line.strip() and not m["skip"]:
            return None
        if m["section"]:
            section = m["section"].strip() + "."
        elif m["key"]:
            some = True
            found = _scalar(m["value"], pos + m.start("value"))
            if found is None and m["value"] and m["value"][0] not in "#;$<*" or found and found[2] and "{" in m["value"]:
                return None  # code, or a document of its own in a literal
            out += [(section + m["key"], *found)] if found else []
        pos += len(row) + 1
    return out if some else None


def yaml_members(text: str) -> list[Member] | None:
    """Block mappings and sequences with scalars, folded and literal blocks; flow collections are read for their members' names."""
    out: list[Member] = []
    above: list[tuple[int, str]] = []  # (indent, key) of the open mappings
    pos, block, nested = 0, None, 0  # block: (indent, path) of a | or > scalar
    for row in text.split("\n"):
        line = row.rstrip("\r")
        bare = line.strip()
        depth = len(line) - len(line.lstrip(" "))
        if block and bare and depth > block[0]:
            out.append((block[1], pos + depth, pos + len(line.rstrip()), False))
        elif bare and not bare.startswith(("#", "---", "...", "%")):
            block = None
            m = _YAML.match(line)
            if m:
                column = len(m["indent"]) + len(m["dash"])
                while above and above[-1][0] >= column:
                    above.pop()
                nested += bool(above)
                path = ".".join([*(k for _, k in above), m["key"].strip("\"'")])
                value = m["value"] or ""
                if re.match(r"[|>][+\-\d]*\s*(?:#.*)?$", value):
                    block = (column, path)
                elif value[:1] in ("{", "["):
                    at = pos + m.start("value")
                    out += [(f"{path}.{p}", at + a, at + b, q) for p, a, b, q in json_members(value) or ()]
                elif value.strip() and not value.startswith("#"):
                    found = _scalar(value, pos + m.start("value"))
                    if found is None and value[:1] not in ("&", "*", "!", "|", ">"):
                        return None
                    out += [(path, *found)] if found else []
                if not value.strip() or value[:1] in ("&", "!", "#"):
                    above.append((column, m["key"].strip("\"'")))
            elif item := _YAML_ITEM.match(line):
                while above and above[-1][0] > depth:
                    above.pop()
                if item["value"] and above and (found := _scalar(item["value"], pos + item.start("value"))):
                    out.append((".".join(k for _, k in above), *found))
            else:
                return None
        pos += len(row) + 1
    return out if nested else None


def members(text: str) -> list[Member] | None:
    """Members of a text that is one configuration document; null for code."""
    head = text.lstrip("\ufeff \t\r\n")[:1]
    if head in ("{", "[") and (found := json_members(text.removeprefix("\ufeff"))) is not None:
        return [(p, a + text.startswith("\ufeff"), b + text.startswith("\ufeff"), q) for p, a, b, q in found]
    for read in (toml_members, ini_members, yaml_members):
        if (read is not toml_members or "=" in text) and (found := read(text)):
            return [x for member in found for x in _within(text, *member)]
    return None


def _within(text: str, path: str, a: int, b: int, quoted: bool) -> list[Member]:
    """The member, or those of the document that its value is."""
    if quoted and (text[a:b].lstrip()[:1] in ("{", "[") or "\n" in text[a:b]):
        body, at = unescaped(text[a:b])
        outer = path.rpartition(".")[0]
        if inner := members(body):
            return [(f"{outer}.{p}".strip("."), a + at[x], a + at[y], q) for p, x, y, q in inner]
    return [(path, a, b, quoted)]


def unescaped(body: str) -> tuple[str, list[int]]:
    """A literal's characters and the offset of each in its source, with one more for the end."""
    if "\\" not in body:
        return body, list(range(len(body) + 1))
    chars, offsets, pos = [], [], 0
    for m in _ESCAPE.finditer(body):
        chars += body[pos : m.start()]
        offsets += range(pos, m.start())
        code = m[1] or m[2]
        chars.append(chr(int(code, 16)) if code else _PLAIN.get(m[3], m[3]))
        offsets.append(m.start())
        pos = m.end()
    chars += body[pos:]
    offsets += range(pos, len(body) + 1)
    return "".join(chars), offsets


class Code:
    """String literals, brackets and sections of a text that is no configuration, from one pass."""

    def __init__(self, text: str):
        self.text = text
        self.starts: list[int] = []
        self.paths: list[tuple[str, ...]] = []  # what encloses the text from the start of the same index on
        self.literals: list[tuple[int, int, tuple[str, ...]]] = []
        outer: tuple[str, ...] = ()
        stack: list[tuple[str, ...]] = []
        last = 0
        for m in _LITERAL.finditer(text):
            kind = m.lastgroup
            if kind == "comment":
                pass
            elif kind == "section":
                if not stack:
                    outer = (m[0].strip().strip("[]").strip(),)
                    self._from(m.start(), outer)
            elif kind == "bracket":
                if m[0] in "{[(":
                    name = _MEMBER.search(text, max(last, m.start() - 200), m.start()) if m[0] != "(" else None
                    stack.append((*(stack[-1] if stack else outer), *([name[1]] if name else [])))
                elif stack:
                    stack.pop()
                self._from(m.end(), stack[-1] if stack else outer)
            else:
                body = next(k for k in ("long", "d", "s", "t") if m[k] is not None)
                self.literals.append((*m.span(body), stack[-1] if stack else outer))
                continue
            last = m.end()

    def _from(self, pos: int, path: tuple[str, ...]) -> None:
        self.starts.append(pos)
        self.paths.append(path)

    def path(self, at: int) -> tuple[str, ...]:
        i = bisect_right(self.starts, at) - 1
        return self.paths[i] if i >= 0 else ()

    def embedded(self, worth) -> list[Member]:
        """Members of the literals that hold a configuration document and are ``worth`` reading."""
        out: list[Member] = []
        for a, b, outer in self.literals:
            raw = self.text[a:b]
            if len(raw) < 8 or not worth(raw):
                continue
            body, at = unescaped(raw)
            found = members(body)
            if found is None and "{" in body:  # text around one JSON value
                i, j = body.find("{"), body.rfind("}")
                found = [(p, x + i, y + i, q) for p, x, y, q in json_members(body[i : j + 1]) or ()] if i < j else None
            out += [(".".join([*outer, p]), a + at[x], a + at[y], q) for p, x, y, q in found or ()]
        return out
