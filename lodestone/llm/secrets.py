"""Problem 6: credentials in source code, configuration and evidence snippets.

Configuration (JSON, TOML, INI, environment files, YAML; as a whole text or within a string literal) is parsed into key
paths with offsets; in code, assignments, call arguments, URL logins and query parameters, headers, meta tags, option
lists and comments are found by their forms and named by the brackets around them.  A place is a credential if its key
name is sensitive and its value has the shape of one, or if the value alone has the shape of a known provider's key, or
if it is private key material.  Redactions are spliced into the original bytes at those offsets: every character of the
value gives way to one mark, quotes and operators between the pieces of a spread value stay.  Null and empty texts hold
none; an invalid payload has no snippets.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, functions as F

from lodestone.operators import flatten

from .batches import map_rows, table
from .config import Code, members

#: Shapes of public providers' keys, and of prefixed keys in general.
PROVIDERS = re.compile(
    r"""(?x)(?<![A-Za-z0-9_\-])(?:
    A(?:KIA|SIA)[A-Z0-9]{16}(?![A-Za-z0-9]) | gh[pousr]_[A-Za-z0-9]{30,} | github_pat_\w{30,} | glpat-[\w\-]{18,} | xox[abeoprs]-[0-9A-Za-z\-]{20,}
  | [srp]k_(?:live|test)_[A-Za-z0-9]{16,} | eyJ[\w\-]{8,}\.eyJ[\w\-]{8,}\.[\w\-]{8,} | AIza[\w\-]{30,} | SG\.[\w\-]{16,}\.[\w\-]{16,} | npm_[A-Za-z0-9]{30,} | hf_[A-Za-z0-9]{30,} | pypi-[\w\-]{30,}
  | [a-z]{2,6}(?:key|pat|svc|tok|sec|api)-(?=[\w\-]*\d)(?=[\w\-]*[A-Z])[A-Za-z0-9_\-]{20,} )"""
)
_BEGIN = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_MATERIAL = re.compile(r"""(?:[\s"'`+,;()\[\]#*/]|\\[nr]|\\\n|Proc-Type:[^\n\\]*|DEK-Info:[^\n\\]*|Version:[^\n\\]*)*([A-Za-z0-9+/=]{20,})""")
_END = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")

#: Literals looked for first; regular expressions run only where one of them stands.
_WORDS = ("pass", "pwd", "secret", "token", "key", "auth", "bearer", "cred", "pw", "dsn")
_PROVIDER_PARTS = ("AKIA", "ASIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "glpat-", "xox", "_live_", "_test_", "eyJ", "AIza", "SG.", "npm_", "hf_", "pypi-", "key-", "pat-", "svc-", "tok-", "sec-", "api-")
_QUOTED = r"""(?P<q>\\?["'`])(?P<v>(?:(?!(?P=q))(?:\\[^\n]|[^\\\n]))*)(?P=q)?"""
_CALL = r"""(?:new\s+)?[\w.]*(?:[bB]64|atob|[dD]ecode|from|[bB]ytes|[sS]tring|str|[sS]ecret\w*|[pP]assword|[eE]ncode)\w*\("""
_ENVIRON = r"""(?:(?:getenv|environ\.get|env\.get|env)\(\s*["'](?P<e>\w+)["']\s*,\s*|env(?:\.(?P<e2>\w+)|\[["'](?P<e3>\w+)["']\])\s*(?:\|\||\?\?)\s*)"""
_ASSIGN = re.compile(rf"""[\w\-]{{0,30}}(?P<c>\\?["'`]?\]?(?:\s*:\s*[A-Za-z][\w<>\[\]| ]{{0,24}}(?=\s*=))?\s*(?:===?|!==?|:=|=>|[:=])\s*)(?:(?:[\w.]*\.)?{_ENVIRON}|{_CALL}|[(\[]|[bBrRuUfF](?=["']))*{_QUOTED}""")
_FALLBACK = re.compile(rf"{_ENVIRON}{_QUOTED}")
_OPTION = re.compile(r"""(?P<o>["']--?(?:p|pw|pass|password|passwd|pwd|passphrase|token|secret|auth|auth-token|access-token|api-?key|access-key|client-secret|key)["'])\s*,\s*(?P<q>["'])(?P<v>[^"'\n]+)(?P=q)|(?P<o2>--(?:password|passwd|token|secret|api-?key|access-token|auth-token|client-secret))[= ](?P<v2>[^\s"'`,;)]{6,})""")
_URL = re.compile(r"://(?P<u>[^\s:/@\"'`<>]*):(?P<v>[^\s/\"'`]*?[^\s/\"'`@])@(?=[\w\[{$%<])")
_QUERY = re.compile(r"(?i)[?&;](?P<k>[\w\-]*(?:token|key|sig|signature|auth|secret|password|passwd|pwd))=(?P<v>[^&\s\"'`#<>)]+)")
_META = re.compile(r"""(?i)<meta\s+(?:name|property|http-equiv)=["'](?P<k>[^"']+)["']\s+content=["'](?P<v>[^"'\n]+)["']""")
_SCHEME = re.compile(r"(?i)\b(?P<s>Authorization[\"']?\s*[:=,]\s*[\"'`]?(?:Bearer|Basic|Token)|(?<=[\"'`])Bearer|(?<=[\"'`])Basic)\s+(?P<v>[A-Za-z0-9+/=_.~\-]{8,})")
_BARE = re.compile(r"""(?<![\w.$\-])(?P<k>[A-Za-z_][\w.\-]{1,60})(?:[ \t]*=[ \t]*|:[ \t]+)(?P<v>[^\s"'`,;<>(){}\[\]\\=]{6,}={0,2})(?![(\[])""")
_CALLEE = re.compile(r"(?i)(?:sha|md|base|utf|aes|int|uint|float|oauth|hmac|rsa|ed|x|http|s|ec|ipv|str|to|is|get|make|new|parse|decode|encode)_?\d|[a-z]+[A-Z]?[a-z]*\d?$|[A-Za-z_]+\.")
_ENDS = re.compile(r"""[ \t]*(?:\r?$|\\n|["'`]|\*/|-->|[#;])""", re.M)
_COMMENT = re.compile(r"(?:#|//|/\*|<!--|--\s|^\s*\*\s)(?P<c>[^\n]*)", re.M)
_REMARK = re.compile(r"(?i)\b(?:(?:remove after \w+|rotate|works with)(?=:)|login|logins|creds?|credentials?|password|passwd|passphrase|passcode|pw|pwd|pass|token|key|secret)\b\s*(?:is|was|[:=])?\s+(?:(?:is|was|key|token|pw|password|pwd|secret)\s+)?(?P<u>[\w.\-@]{2,20}\s*/\s*)?(?P<v>[^\s,;\"'`<>]{6,})")

_TAILS = frozenset("password passwd pwd pass passphrase passcode secret token key auth bearer credential credentials authorization sig signature pw apikey accesskey secretkey authtoken privatekey accesstoken".split())
_KEY_OF = frozenset("api access private secret signing sign deploy licence license auth service x encryption encrypt crypto master account storage hmac client app server ssh shared session admin root vendor hook webhook push jwt aws gcp azure stripe consumer subscription".split())
_PLAIN = frozenset("count budget kind type label column field header prefix mark marker name pattern mask shape selector placeholder hint id ids url uri path file digest hash length len size limit regex format suffix index idx csrf public pub primary foreign sort cache partition group suite trace".split())
_PLACEHOLDER = re.compile(
    r"""(?ix)^(?: \W* | (.)\1{2,} | <.*>? | \[.*\] | \{.*\} | \$.* | %(?:[sd]|\w+%|\(\w+\)[sd]?) | .*\$\{.*\}.* | .*\{\{.*\}\}.* | .*<[\w\ -]+>.*
  | .*(?:your[-_ ]?|my[-_ ]?)(?:api|secret|access|auth|private|password|token|key|own|real).* | (?:change|replace)[-_ ]?(?:me|this|it|with.*) | changeit | to-?do.* | tbd | tba | fixme | none | null | nil | undefined | true | false
  | .*(?:example|placeholder|redacted|dummy|fill[-_ ]?in|not[-_ ]?set|insert|sample[-_]?(?:key|token|secret)).* | (?:test|fake)[-_]?(?:key|token|secret|password)? | x{3,}.* | \*{3,}.* | \.{3,}.* | (?:process\.env|os\.environ|env\.|ENV\[|vault:|ssm:|secretref:|arn:).* )$"""
)
_UUID = re.compile(r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$")
_REGEX = re.compile(r"\[\^|\[[A-Za-z0-9]-[A-Za-z0-9]|\(\.|\.[+*]|\\[dws]|\{\d+,?\d*\}|\(\?")
_HEADER = re.compile(r"^(?:X|Www|Proxy)(?:-[A-Z][a-z]+)+$")
_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
_VOCABULARY = _TAILS | _PLAIN | _KEY_OF | frozenset("basic digest user username refresh access csrf bot".split())


def name_parts(name: str) -> list[str]:
    return [p.lower() for p in _PART.findall(name)]


def sensitive(name: str) -> bool:
    """Whether a key name, in any spelling, promises a secret value."""
    parts = name_parts(name)
    while parts and parts[-1].isdigit():
        parts.pop()
    if not parts or "public" in parts or "csrf" in parts:
        return False
    if re.search(r"(?:^(?!by|com|tres|sur|over)\w*(?:pass|passwd|password|pwd)|secret|token)$", parts[-1]):
        return True
    if parts[-1] == "key":
        return len(parts) > 1 and parts[-2] in _KEY_OF
    return parts[-1] in _TAILS and parts[-1] not in ("sig", "signature")


def plausible(value: str, strict: bool = False) -> bool:
    """Whether a value under a sensitive name has the shape of a secret; strict for free text such as remarks."""
    v = value.strip()
    m = re.match(r"(?i)(?:bearer|basic|token)\s+", v)
    if m:
        v = v[m.end() :]
    if len(v) < 5 or re.search(r"\s", v) or _PLACEHOLDER.match(v) or _UUID.match(v) or _REGEX.search(v) or _HEADER.match(v):
        return False
    if v.startswith(("ssh-rsa", "ssh-ed25519", "-----BEGIN", "http://", "https://")) or re.match(r"[./~]", v) and "/" in v:
        return False
    words = name_parts(v)
    if words and all(w in _VOCABULARY for w in words) and not any(c.isdigit() for c in v):
        return False
    digit, upper, lower = any(c.isdigit() for c in v), any(c.isupper() for c in v), any(c.islower() for c in v)
    symbol = any(not c.isalnum() and c not in "_-." for c in v)
    if strict:
        if re.fullmatch(r"(?=(?:\D*\d){3})(?=.*[A-Za-z])[A-Za-z0-9+/_\-]{20,}={0,2}", v) and (upper or re.fullmatch(r"[0-9a-f]{32,64}", v)):
            return True
        return digit and (symbol or upper) and (lower or upper) and not re.match(r"^[\w.]+\(|.*[()=]|^\W|^https?:|^\d", v)
    if digit or symbol and (upper or lower):
        return True
    return len(v) >= 12 and (upper and lower or "-" in v) and not (v.isupper() or re.fullmatch(r"[A-Z][a-z]+(?:[A-Z][a-z]+)*|[a-z]+(?:[_.][a-z]+)*|[A-Z_]+|[a-z]+(?:[A-Z][a-z]+)+", v))


class Secret(NamedTuple):
    """Offsets of a value, its key path, the pieces to mask and the mark; ``at`` is where its name begins, or -1 if the path is whole."""

    start: int
    end: int
    path: str
    at: int = -1
    pieces: tuple[tuple[int, int], ...] = ()
    mark: str = "*"



#: The end of a key in the forms of any configuration format, before a colon or an equals sign with a value behind it.
_NAME = re.compile(r"[\w\-]*")
_KEY_END = re.compile(r"""\\?["']?[ \t]*(?::[ \t]+|=[ \t]*)(?![=\s]|[A-Za-z_][\w.]*[(\[,;)]|[A-Za-z_][\w.]*$)""", re.M)


def _has_key(text: str, low: str) -> bool:
    """Whether a sensitive name stands where a member's key could, before anything but a plain name or a call."""
    for word in _WORDS:
        at = low.find(word)
        while at >= 0:
            end = _NAME.match(text, at).end()
            if _KEY_END.match(text, end) and sensitive(_head(text, at) + text[at:end]):
                return True
            at = low.find(word, max(end, at + len(word)))
    return False


def _head(text: str, start: int) -> str:
    """The rest of a key name to the left of ``start``."""
    i = start
    while i > 0 and (text[i - 1].isalnum() or text[i - 1] in "_-"):
        i -= 1
    return text[i:start]


def scan(text: str | None) -> list[Secret]:
    """The secrets of a text in order, without overlaps."""
    if not text:
        return []
    found: list[Secret] = []
    if any(x in text for x in _PROVIDER_PARTS):
        for m in PROVIDERS.finditer(text):
            if not _PLACEHOLDER.match(m[0]):
                found.append(Secret(m.start(), m.end(), "value"))
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if c.isascii() else c for c in text)
    _keyed(text, low, found)
    code = None
    if any(s.at >= 0 for s in found) or _has_key(text, low):
        code = _configured(text, found)
    found.sort(key=lambda s: (s.start, -s.end, s.at))
    out: list[Secret] = []
    for s in found:
        s = s._replace(pieces=s.pieces or ((s.start, s.end),))
        if out and s.start < out[-1].end:
            last = out[-1]
            more = tuple((max(a, last.end), b) for a, b in s.pieces if b > last.end)
            path, at = (s.path, s.at) if last.path == "value" and s.start == last.start else (last.path, last.at)
            out[-1] = last._replace(end=max(last.end, s.end), path=path, at=at, pieces=last.pieces + more)
        else:
            out.append(s)
    return [s if s.at < 0 else s._replace(path=".".join([*code.path(s.at), s.path]), at=-1) for s in out]


def find_secrets(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, key path) of each secret value, in order, without overlaps."""
    return [(s.start, s.end, s.path) for s in scan(text)]


def _configured(text: str, found: list[Secret]) -> Code:
    """Adds the secrets among the members of configuration documents; what was found at the same place before gets their path."""
    code = Code(text)
    whole = members(text)
    worth = lambda raw: any(w in raw.lower() for w in _WORDS)
    for path, a, b, quoted in whole if whole is not None else code.embedded(worth):
        name, value = path.rsplit(".", 1)[-1], text[a:b]
        known = [i for i, s in enumerate(found) if s.at >= 0 and a <= s.start < b]
        for i in known:
            found[i] = found[i]._replace(path=path, at=-1)
        if not known and sensitive(name) and "://" not in value and (plausible(value) if quoted else _plain(value)):
            lead = re.match(r"(?i)\s*(?:bearer|basic|token)\s+", value)
            found.append(Secret(a + (lead.end() if lead else 0), b, path, mark="*" if quoted else "x"))
    return code


def _plain(v: str) -> bool:
    """Whether an unquoted value may be a secret: an identifier or a call only with digits in plenty."""
    if not plausible(v, strict=True):
        return False
    return not re.fullmatch(r"[A-Za-z_]\w*(?:\.\w+)*", v) or len(v) >= 8 and sum(map(str.isdigit, v)) >= 2 and not _CALLEE.match(v)


def _keyed(text: str, low: str, spans: list[Secret]) -> None:
    if "PRIVATE KEY" in text:
        for m in _BEGIN.finditer(text):
            body = _MATERIAL.match(text, m.end())
            if body:
                end = _END.search(text, body.end())
                nxt = _BEGIN.search(text, m.end())
                stop = end.end() if end and not (nxt and nxt.start() < end.start()) else _run(text, body.end())
                spans.append(Secret(m.start(), stop, "private_key", pieces=tuple(x.span() for x in _KEY_TEXT.finditer(text, m.start(), stop))))
    for m in _assignments(text, low):
        name = _head(text, m.start()) + text[m.start() : m.start("c")]
        value = m["v"]
        named = next((e for e in (m["e"], m["e2"], m["e3"]) if e), "")
        call = text[m.end("c") : m.start("q")]
        if not sensitive(name) and not (named and sensitive(named)):
            continue
        if call.endswith(("[", "(")) and re.search(r"(?i)b64|atob|decode|from\(", call) and re.fullmatch(r"[A-Za-z0-9+/=_-]{12,}", value) or plausible(value):
            start, end = m.span("v")
            lead = re.match(r"(?i)\s*(?:bearer|basic|token)\s+", value)
            start += lead.end() if lead else 0
            more = _pieces(text, m.end()) if call.rstrip()[-1:] in ("(", "[") and "decode" not in call else []
            spans.append(Secret(start, more[-1][1] if more else end, _clean(name), m.start(), ((start, end), *more)))
        elif "://" not in value and call.rstrip()[-1:] in ("(", "["):
            more = _pieces(text, m.start("q"))
            if len(more) > 1 and plausible("".join(text[x:y] for x, y in more)):
                spans.append(Secret(m.start("v"), more[-1][1], _clean(name), m.start(), tuple(more)))
    for m in _FALLBACK.finditer(text) if "env" in text else ():
        if sensitive(m["e"] or m["e2"] or m["e3"]) and plausible(m["v"]):
            spans.append(Secret(*m.span("v"), m["e"] or m["e2"] or m["e3"]))
    if "\"-" in text or "'-" in text or "--" in text:
        for m in _OPTION.finditer(text):
            option, value, span = (m["o"].strip("\"'"), m["v"], m.span("v")) if m["o"] else (m["o2"], m["v2"], m.span("v2"))
            if option == "-p":
                line = text[text.rfind("\n", 0, m.start()) + 1 : m.start()]
                if not re.search(r"(?i)login|--user|-u\b|mysql|auth", line):
                    continue
            if plausible(value):
                spans.append(Secret(*span, option))
    if "://" in text:
        for m in _URL.finditer(text):
            v = m["v"]
            if not _PLACEHOLDER.match(v) and not re.match(r"[{<$%*]|\d{2,5}$", v) and v.lower() not in _TAILS and "{" not in v:
                spans.append(Secret(*m.span("v"), "url.password"))
    if "=" in text:
        for m in _QUERY.finditer(text):
            v = m["v"]
            if len(v) >= 8 and not _PLACEHOLDER.match(v) and not re.search(r"[{}$%(\[]", v[:2]) and any(c.isdigit() for c in v) and not _UUID.match(v):
                spans.append(Secret(*m.span("v"), "query." + m["k"]))
    if "<meta" in text:
        for m in _META.finditer(text):
            if sensitive(m["k"]) and plausible(m["v"]):
                spans.append(Secret(*m.span("v"), "meta." + m["k"]))
    for m in _SCHEME.finditer(text) if "bearer" in low or "authorization" in low or "basic" in low else ():
        if plausible(m["v"]) and any(c.isdigit() for c in m["v"]):
            spans.append(Secret(*m.span("v"), "authorization"))
    if any(w in low for w in _WORDS):
        _bare(text, spans)
    for c in _COMMENT.finditer(text):
        for m in _REMARK.finditer(text, *c.span("c")):
            v = m["v"].rstrip(".)")
            if "://" not in v and plausible(v, strict=not m["u"]):
                spans.append(Secret(m.start("v"), m.start("v") + len(v), "comment", mark="x"))


def _bare(text: str, spans: list[Secret]) -> None:
    """Unquoted values of ``key=value`` and ``key: value``, as in env, INI and YAML texts, also in strings and comments.

    A value that could be an identifier or a call counts only if it ends its line, string or comment and has digits in plenty."""
    for m in _BARE.finditer(text):
        v = m["v"].rstrip(".")
        if not sensitive(m["k"]) or "://" in v or not plausible(v, strict=True):
            continue
        if re.fullmatch(r"[A-Za-z_]\w*(?:\.\w+)*", v) and not (len(v) >= 8 and sum(map(str.isdigit, v)) >= 2 and not _CALLEE.match(v) and _ENDS.match(text, m.end())):
            continue
        spans.append(Secret(m.start("v"), m.start("v") + len(v), m["k"], m.start("k"), mark="x"))


def _assignments(text: str, low: str):
    """Matches of _ASSIGN from every sensitive word on, once per assignment."""
    seen: set[int] = set()
    for word in _WORDS:
        at = low.find(word)
        while at >= 0:
            m = _ASSIGN.match(text, at)
            if m and m.start("c") not in seen:
                seen.add(m.start("c"))
                yield m
            at = low.find(word, m.start("c") if m else at + len(word))


def _run(text: str, pos: int) -> int:
    """End of key material that has no closing line."""
    while (m := _MATERIAL.match(text, pos)) and m.end() > pos:
        pos = m.end()
    return pos


_NEXT = re.compile(r"""[\s,+]*(["'`])((?:(?!\1)[^\\\n]|\\.)*)\1""")
#: What of private key material is masked: all but escapes, white space, quotes, brackets and operators between literals.
_KEY_TEXT = re.compile(r"""(?:(?<!\\)(?!(?<![A-Za-z0-9+/=])\+(?![A-Za-z0-9+/=]))[^\\\s"'`,;()\[\]])+""")


def _pieces(text: str, pos: int) -> list[tuple[int, int]]:
    """Spans of the adjacent literals from ``pos`` on that go on with a value."""
    out = []
    while (m := _NEXT.match(text, pos)) and re.fullmatch(r"[\w+/=.\-]{2,}", m[2]):
        out.append(m.span(2))
        pos = m.end()
    return out


def _clean(name: str) -> str:
    return name.strip("\"'\\ \t[")


def redact(text: str | None, secrets: list[Secret] | None = None) -> str | None:
    """The text with every character of every secret replaced by a mark, line ends aside."""
    secrets = scan(text) if secrets is None else secrets
    if not secrets:
        return text
    raw = text.encode("utf-8", "surrogatepass")
    out, pos, at, done = [], 0, 0, 0
    for s in secrets:
        for a, b in s.pieces:
            at += len(text[pos:a].encode("utf-8", "surrogatepass"))
            value = text[a:b]
            out += [raw[done:at], re.sub(r"[^\r\n]", s.mark, value).encode()]
            done = at = at + len(value.encode("utf-8", "surrogatepass"))
            pos = b
    return (b"".join(out) + raw[done:]).decode("utf-8", "surrogatepass")


def secret_places(df: DataFrame, text: str, keys: tuple[str, ...], masked: bool = False) -> DataFrame:
    """keys, line_no, key_path and offset in bytes of the first secret of each line; with ``masked`` one row per text that has any, with its redacted text."""
    kinds = dict(df.dtypes)
    head = ", ".join(f"`{k}` {kinds[k]}" for k in keys)

    def one(body, *rest):
        spans = scan(body)
        if masked:
            if spans:
                yield (*rest, len(spans), redact(body, spans))
            return
        line, pos, last, at = 1, 0, 0, 0
        for a, _, path, *_ in spans:
            line += body.count("\n", pos, a)
            at += len(body[pos:a].encode("utf-8", "surrogatepass"))
            pos = a
            if line != last:
                yield (*rest, line, path, at)
            last = line

    schema = head + (", secrets int, redacted string" if masked else ", line_no int, key_path string, byte_offset long")
    return map_rows(df.select(text, *keys).where(F.col(text) != ""), schema, one)


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """record_kind, record_no, pos and text of all chunks and evidence snippets."""
    chunks = table(spark, sf_dir, "code_chunks").select(F.lit("chunk").alias("record_kind"), F.col("chunk_no").alias("record_no"), F.lit(0).alias("pos"), "text")
    rows = flatten.flatten_bundles(table(spark, sf_dir, "evidence_bundles"), ("evidence",))
    snippets = rows.select(F.lit("evidence").alias("record_kind"), "record_no", F.col("pos_path").cast("int").alias("pos"), flatten.members(F.col("value"), "snippet")["snippet"].alias("text"))
    return chunks.unionByName(snippets)


KEYS = ("record_kind", "record_no", "pos")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_places(_texts(spark, sf_dir), "text", KEYS).select(*KEYS, "line_no")


def p6_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_places(_texts(spark, sf_dir), "text", KEYS)


def p6_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts that held secrets, redacted."""
    return secret_places(_texts(spark, sf_dir), "text", KEYS, masked=True)


QUERIES = {"p6_found": p6_found, "p6_places": p6_places, "p6_redacted": p6_redacted}
