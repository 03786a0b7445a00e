"""Problem 5: generated, minified or vendored files and data saved as code, from the layout of their text.

One pass per text computes layout statistics; thresholds tuned per language decide ``minified`` and ``data``, a marker
comment at the head decides ``generated``, and a digest of the text without banner and white space, joined with the
known third-party sources, or a banner of name, release and licence decides ``vendored``; folder names decide it only
where nothing but other people's packages stands by convention.  A file is judged on the texts of its analyses, without any on its
overview chunks, without those on its symbols' chunks; every file of any table is judged by its path.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter

from pyspark.sql import DataFrame, SparkSession, functions as F

from lodestone.operators.lineage import narrowed

from .batches import map_rows, table

LANGUAGES = {"py": "python", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "css": "css", "html": "html", "toml": "toml"}
#: language: (mean line for minified, longest line for minified, white space share below it, digit share for data)
THRESHOLDS = {
    "python": (160, 400, 0.10, 0.30),
    "javascript": (160, 400, 0.10, 0.30),
    "typescript": (160, 400, 0.10, 0.30),
    "css": (160, 400, 0.08, 0.45),
    "html": (300, 800, 0.06, 0.45),
    "toml": (300, 800, 0.05, 0.45),
    "": (200, 500, 0.08, 0.35),
}
#: Literals, or characters of encoded runs, from which on a text may be data; less is a small table or a key at most.
LEAST_LITERALS, LEAST_ENCODED = 24, 600
#: Share of repeated line forms above which a text is taken for a template's output.
REPEATED = {"python": 0.6, "javascript": 0.6, "typescript": 0.6, "css": 0.6, "html": 0.6}
_LEAD = re.compile(r"\s*(?:#!?[^\n]*(?:\n|$)|//[^\n]*(?:\n|$)|/\*[\s\S]*?\*/|<!--[\s\S]*?-->)")
_DOCSTRING = re.compile(r"""(?s)\s*[rRuU]?(?:(?P<q>\"{3}|'{3})(?:\\.|(?!(?P=q)).)*(?P=q)|(?P<p>["'])(?:\\.|(?!(?P=p))[^\\\n])*(?P=p)(?=[ \t]*(?:\n|$)))""")
_DIRECTIVE = re.compile(r"""\s*(["'])use [a-z ]+\1;?|\s*<!doctype[^>]*>|\s*@charset[^;\n]*;""", re.I)
#: Directories that by convention hold other people's sources only, and such that do where a package has a folder of its own below them.
VENDOR_DIRS = frozenset(["vendor", "_vendor", "third_party", "thirdparty", "third-party", "3rdparty", "node_modules", "bower_components", "jspm_packages", "site-packages"])
PACKAGE_DIRS = frozenset(["extern", "external", "externals", "deps"])
_RELEASE = re.compile(r"""(?ix) (?:[\w.-]+ (?:\ -?\ ?v|@|\ (?:release|version)\ v?)) \d+\.\d+\.\d+""")
_FIRST_LINES = re.compile(r"\ufeff?(?:#![^\n]*(?:\n|$))?(?:\s*#[^\n]*coding[:=][^\n]*(?:\n|$))?")
#: A banner line that begins with a name and a bare release, and ends there or goes on behind a mark.
_TITLE = re.compile(r"""(?m)^[\s#/*!<"'-]*[A-Za-z@][\w.@/-]*,?\ +\d+\.\d+\.\d+[\w.+-]*(?=\s*(?:[-–—|,;:(*/"']|$))""")
_LICENCE = re.compile(r"(?i)\b(?:MIT|ISC|BSD|Apache|MPL|LGPL|GPL|licen[cs]e|\(c\)|copyright)\b")
_DIGITS = re.compile(r"\d+")
_LOCK = re.compile(r"""(?m)^\s*"?(?:checksum|integrity|resolved|sha256|hash)"?\s*[:=]\s*["'][^"'\n]{16,}["']""")
_NAMED_RELEASE = re.compile(r"-v?\d+\.\d+\.\d+(?:\.min)?\.[a-z]+$|(?:^|/)(?:static|public|assets|web)/libs?/")
_COUNTED = re.compile(r"[A-Za-z_](\d+)(?![\d.])")
_COMMENT_START = re.compile(r"\s*(?:#|//|/\*|\*|<!--)")
_MARKER = re.compile(
    r"""(?ix) @generated\b | <auto-generated | \bauto-?generated\b | \bgenerated\ (?:by|on|from|with|automatically|code|file|source)\b | \bcode\ generated\b
  | automatically\ (?:created|generated|produced|built|written) | \bmachine[ -](?:output|generated|made)\b | (?:was|been)\ (?:produced|generated|created|emitted)\ by\b | \bcompiled\ (?:from|by)\b
  | do\ not\ (?:edit|modify|change)\b | changes\ will\ be\ (?:over|lost) | automatisch\ (?:erzeugt|generiert|erstellt) | nicht\ (?:bearbeiten|editieren)
  | g[ée]n[ée]r[ée](?:\ automatiquement|\ par) | ne\ pas\ modifier | generado\ (?:por|autom) | no\ (?:editar|modificar) | 自动生成 | 自動生成 | 请勿(?:手动)?(?:修改|编辑)"""
)
_NUMBER = re.compile(r"(?<![\w.])-?(?:0[xX][0-9a-fA-F]+|\d[\d_]*(?:\.\d+)?(?:[eE][+-]?\d+)?)(?!\w)")
_STRING = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'")
_ENCODED = re.compile(r"(?:[A-Za-z0-9+/=_-]{60,}|(?:\\x[0-9a-fA-F]{2}){8,}|(?:[0-9a-fA-F]{2}[ ,]){16,})")
_LITERAL_LINE = re.compile(r"[\s\[\](){},;:|.+\-]*")
_CODE_WORD = re.compile(r"\b(?:def|class|return|if|for|while|function|import|export|const|let|var|await|async|try|switch|raise|throw|interface|with|from|lambda|yield|new)\b")


def strip_banner(text: str) -> str:
    """The text without its leading comments and docstrings and without any white space.

    A docstring may be the banner or stand behind it, so all go, here and in the known sources alike."""
    pos = len(text) - len(text.lstrip("\ufeff"))
    while (m := _LEAD.match(text, pos) or _DOCSTRING.match(text, pos)) and m.end() > pos:
        pos = m.end()
    return "".join(text[pos:].split())


def lead_of(text: str) -> str:
    """The leading comments, however long, without those behind a docstring or a directive."""
    pos = _FIRST_LINES.match(text).end()
    start = pos
    while (m := _LEAD.match(text, pos)) and m.end() > pos:
        pos = m.end()
    return text[start:pos]


def banner_of(text: str) -> str:
    """The leading comments, or the docstring where no comment stands before it but an interpreter or encoding line."""
    lead = lead_of(text)
    if not lead.strip() and (m := _DOCSTRING.match(text, _FIRST_LINES.match(text).end() + len(lead))):
        lead = m[0]
    return lead.strip()


def head_comments(text: str) -> list[str]:
    """The lines of all comments before the first line of code; directives and docstrings are passed over."""
    pos, lines = len(text) - len(text.lstrip("\ufeff")), []
    while (m := _LEAD.match(text, pos) or _DOCSTRING.match(text, pos) or _DIRECTIVE.match(text, pos)) and m.end() > pos:
        if m.re is _LEAD:
            lines += m[0].split("\n")
        pos = m.end()
    return lines


def counted_share(lines: list[str]) -> tuple[int, float]:
    """Length of the longest run of names numbered one after another, and its share of the lines."""
    best = run = 0
    expected = None
    for line in lines:
        m = _COUNTED.search(line)
        if m is None:
            continue
        k = int(m[1][:9])
        if k == expected:
            run += 1
            expected = k + 1
        elif expected is None or k != expected - 1:
            best, run, expected = max(best, run), 1, k + 1
    best = max(best, run)
    return best, best / max(1, len(lines))


def repeated_share(lines: list[str], language: str) -> float:
    """Share of the lines with letters whose form, without digits and string contents, occurs three times or more."""
    forms = Counter(_DIGITS.sub("0", _STRING.sub('""', x.strip())) for x in lines if any(c.isalpha() for c in x) and (language != "css" or x.rstrip().endswith("{")))
    total = sum(forms.values())
    return sum(n for n in forms.values() if n >= 3) / total if total >= 8 else 0.0


def layout_stats(relpath: str | None, text: str | None) -> dict:
    """Layout statistics of one text and what they say; ``kinds`` may hold generated, minified and data."""
    t = (text or "").replace("\r\n", "\n")
    language = LANGUAGES.get((relpath or "").rsplit(".", 1)[-1].lower(), "")
    n = len(t)
    lines = [x for x in t.split("\n") if x.strip()]
    digest = hashlib.sha256(body.encode("utf-8", "replace")).hexdigest() if (body := strip_banner(t)) else None
    parts = (relpath or "").lower().split("/")[:-1]
    foreign = bool(VENDOR_DIRS.intersection(parts) or PACKAGE_DIRS.intersection(parts[:-1]) or _NAMED_RELEASE.search((relpath or "").lower()))
    if not lines:
        return {"language": language, "chars": n, "lines": 0, "mean_line": 0.0, "longest_line": 0, "space_share": 0.0, "alnum_share": 0.0, "number_share": 0.0, "encoded_share": 0.0, "literal_share": 0.0, "counted": 0, "repeated_share": 0.0, "kinds": ["vendored"] if foreign else [], "digest": digest}
    longest = max(map(len, lines))
    solid = sum(len(x.strip()) for x in lines)
    mean = solid / len(lines)
    space = 1 - len("".join(t.split())) / n
    alnum = len(re.findall(r"[^\W_]", t)) / n
    strings = _STRING.findall(t)
    quoted = sum(map(len, strings))
    numbers = sum(map(len, _NUMBER.findall(t)))
    encoded = sum(len(m) for m in _ENCODED.findall(t))
    # share of the text, white space and punctuation aside, that is literals and their keys
    rest = _NUMBER.sub(" ", _STRING.sub(" ", t))
    words = re.findall(r"[^\W\d]\w*", rest)
    literal = (quoted + numbers) / max(1, quoted + numbers + sum(map(len, words)))
    code = len(_CODE_WORD.findall(rest))
    mean_limit, long_limit, space_limit, digit_limit = THRESHOLDS[language]
    kinds = []
    if any(_MARKER.search(x) for x in head_comments(t)):
        kinds.append("generated")
    counted, counted_part = counted_share(lines)
    repeated = repeated_share(lines, language)
    items = len(strings) + len(_NUMBER.findall(t))
    bare = t.lstrip()[:1] in ("{", "[") and items < 4 * LEAST_LITERALS  # a small JSON text under a wrong name is no table of data
    if language == "toml":
        built = len(_LOCK.findall(t)) / len(lines) > 0.1
    else:
        run = counted >= 6 and (counted_part > 0.5 or counted_part > 0.12 and repeated > 0.3)
        built = not bare and (run or repeated > REPEATED.get(language, 0.6))
    if built and "generated" not in kinds:
        kinds.append("generated")
    banner = banner_of(t)
    if foreign or ((_RELEASE.search(banner) or _TITLE.search(banner)) and _LICENCE.search(banner)):
        kinds.append("vendored")
    packed = (mean > mean_limit or (longest > long_limit and longest > 0.5 * solid)) and space < space_limit
    if packed and encoded < 0.5 * n and language in ("python", "javascript", "typescript", "css", "html", ""):
        kinds.append("minified")
    if (items >= LEAST_LITERALS or encoded >= LEAST_ENCODED) and not bare and language not in ("css", "html", "toml") and (
        (literal > 0.8 and code <= 3 + n / 2500) or numbers > digit_limit * (n - n * space) or encoded > 0.5 * n
    ):
        kinds.append("data")
    return {"language": language, "chars": n, "lines": len(lines), "mean_line": round(mean, 3), "longest_line": longest, "space_share": round(space, 6), "alnum_share": round(alnum, 6), "number_share": round(numbers / n, 6), "encoded_share": round(encoded / n, 6), "literal_share": round(literal, 6), "counted": counted, "repeated_share": round(repeated, 6), "kinds": kinds, "digest": digest}


STATS = "language string, chars int, lines int, mean_line double, longest_line int, space_share double, alnum_share double, number_share double, encoded_share double, literal_share double, counted int, repeated_share double, kinds array<string>, digest string"


def file_layout(files: DataFrame, text: str, keys: tuple[str, ...] = ("repo_root", "relpath")) -> DataFrame:
    """Keys, layout statistics, kinds and the digest without banner and white space, of each row; no shuffle."""
    kinds = dict(files.dtypes)

    def one(body, *rest):
        yield (*rest, *layout_stats(rest[-1], body).values())

    return map_rows(files.select(text, *keys), ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", " + STATS, one)


def unwritten_files(analysis: DataFrame, chunks: DataFrame, facts: DataFrame, third_party: DataFrame) -> DataFrame:
    """repo_root, relpath and kinds of the files nobody in the repository wrote by hand; one row per file.

    Texts come from the stored analyses; a file without one is judged by its overview chunks, one without those by its
    symbols' chunks, and one known by name only by its path.  Which files those are is settled on keys alone, before any text moves."""
    keys = ["repo_root", "relpath"]
    named = lambda df: df.where("repo_root is not null and relpath is not null")
    analysis, chunks, facts = named(analysis), named(chunks), named(facts)
    have = analysis.where("source_text is not null").select(*keys).distinct()
    missing = chunks.select(*keys).distinct().join(have, keys, "left_anti")
    overview = F.coalesce(F.col("chunk_id").endswith("::file"), F.lit(False))
    parts = narrowed(chunks, missing, keys)
    told = parts.where(overview & (F.col("text") != "")).select(*keys).distinct()
    parts = parts.where(overview).unionByName(parts.where(~overview).join(told, keys, "left_anti"))
    bare = facts.select(*keys).distinct().join(have, keys, "left_anti").join(missing, keys, "left_anti").withColumn("text", F.lit(None).cast("string"))
    seen = file_layout(analysis, "source_text").unionByName(file_layout(parts, "text")).unionByName(file_layout(bare, "text"))
    known = file_layout(third_party.select("file_text", F.concat(F.lit("x."), F.expr("map('python','py','javascript','js','typescript','ts')[language]")).alias("relpath")), "file_text", ("relpath",)).where("digest is not null").select("digest").distinct()
    marked = seen.join(known.withColumn("known", F.lit(True)), "digest", "left")
    found = marked.withColumn("kinds", F.when(F.col("known"), F.array_union("kinds", F.array(F.lit("vendored")))).otherwise(F.col("kinds"))).where(F.size("kinds") > 0)
    return found.groupBy(*keys).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("kinds")))).alias("kinds"))


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unwritten_files(*(table(spark, sf_dir, t) for t in ("file_analysis", "code_chunks", "file_facts", "third_party_files")))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir).select("repo_root", "relpath")


def p5_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files by repository and kind."""
    return _files(spark, sf_dir).select("repo_root", F.explode("kinds").alias("kind")).groupBy("repo_root", "kind").agg(F.count("*").alias("files"))


def p5_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return file_layout(table(spark, sf_dir, "file_analysis"), "source_text", ("file_no", "repo_root", "relpath"))


QUERIES = {"p5_found": p5_found, "p5_kinds": p5_kinds, "p5_layout": p5_layout}
