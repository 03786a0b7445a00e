"""Source extraction: Python symbols, routes, imports and calls from the stdlib parser, and text extractors."""

from __future__ import annotations

import ast
import re
import warnings
from bisect import bisect_right

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from lodestone.functions.text import tokenize

ROUTE_CALLS = frozenset(["route", "api_route", "get", "post", "put", "patch", "delete"])
SYMBOLS = "array<struct<name:string,kind:string,start_line:int,end_line:int,calls:array<string>,refs:array<string>,inherits:array<string>,route_path:string>>"


def _last(node: ast.AST) -> str:
    while isinstance(node, ast.Call):
        node = node.func
    return node.attr if isinstance(node, ast.Attribute) else node.id if isinstance(node, ast.Name) else ""


def _unique(values) -> list[str]:
    seen: dict[str, str] = {}
    for v in values:
        if v.strip():
            seen.setdefault(v.strip().lower(), v.strip())
    return list(seen.values())


def _routes(fn) -> list[tuple[str, str]]:
    """(method, path) of a function's route decorators, one per listed method."""
    out = []
    for d in fn.decorator_list:
        if not isinstance(d, ast.Call) or _last(d) not in ROUTE_CALLS:
            continue
        named = {k.arg: k.value for k in d.keywords if k.arg}
        path = d.args[0] if d.args else named.get("path", named.get("rule"))
        if not (isinstance(path, ast.Constant) and isinstance(path.value, str)):
            continue
        if _last(d) not in ("route", "api_route"):
            out.append((_last(d), path.value))
            continue
        listed = named.get("methods")
        listed = listed.elts if isinstance(listed, (ast.List, ast.Tuple, ast.Set)) else [listed]
        out += [(m, path.value) for m in [x.value.lower() for x in listed if isinstance(x, ast.Constant) and isinstance(x.value, str)] or ["route"]]
    return out


def route_name(method: str, path: str) -> str:
    """Symbol name of a route: the method and the path, with underscores for runs of other characters than letters and digits."""
    return f"{method.lower()}_{re.sub('[^A-Za-z0-9_]+', '_', path.strip('/')).strip('_') or 'root'}"


def analyse_python(text: str | None) -> tuple[str, list[str], list[tuple]]:
    """(backend, top-level imports, symbols) of one source; a text that does not parse has neither."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(text or "")
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return "python-ast-error", [], []
    imports = []
    for node in tree.body:
        if isinstance(node, ast.Import):
            imports += [a.name for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            imports.append("." * node.level + (node.module or ""))
    symbols = []
    for node in ast.walk(tree):
        if not isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            continue
        inner = [n for n in ast.walk(node) if n is not node]
        calls = _unique(_last(n.func) for n in inner if isinstance(n, ast.Call))
        refs = _unique(n.id for n in inner if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Load) and n.id != node.name)
        is_class = isinstance(node, ast.ClassDef)
        bases = _unique(_last(b) for b in node.bases) if is_class else []
        symbols.append((node.name, "class" if is_class else "function", node.lineno, node.end_lineno or node.lineno, calls, refs, bases, ""))
        for method, path in () if is_class else _routes(node):
            symbols.append((route_name(method, path), "route", node.lineno, node.end_lineno or node.lineno, [node.name], [node.name], [], path))
    return "python-ast", _unique(imports), sorted(symbols, key=lambda s: (s[2], s[3], s[0]))


#: Forms of JavaScript declarations, imports, routes, calls and handlers, and names that are no calls.
_JS_DECLARED = re.compile(
    r"^\s*(?:export\s+)?(?:async\s+)?function\s+([A-Za-z_][A-Za-z0-9_]*)|^\s*(?:export\s+)?class\s+([A-Za-z_][A-Za-z0-9_]*)|^\s*(?:export\s+)?const\s+([A-Za-z_][A-Za-z0-9_]*)\s*=\s*(?:async\s*)?\(", re.M
)
_JS_IMPORT = re.compile(r"""(?:import\s+.+?\s+from\s+['"]([^'"]+)['"])|(?:require\(\s*['"]([^'"]+)['"]\s*\))""")
_JS_OWNER = r"\b(?:app|router|server|[A-Za-z_][A-Za-z0-9_]*(?:Router|Routes|Controller))"
_JS_ROUTES = (
    re.compile(_JS_OWNER + r"""\.(?P<m>get|post|put|patch|delete|use)\(\s*['"](?P<p>[^'"]+)['"]"""),
    re.compile(_JS_OWNER + r"""\.route\(\s*['"](?P<p>[^'"]+)['"]\s*\)\s*\.(?P<m>get|post|put|patch|delete|use)\("""),
)
_JS_CALL = re.compile(r"\b([A-Za-z_][A-Za-z0-9_]*)\s*\(")
_JS_HANDLER = re.compile(r",\s*([A-Za-z_][A-Za-z0-9_]*)\s*(?=[,);])")
NO_CALLS = frozenset("app router express req res next request response if for while switch catch return console get post put patch delete use settimeout setinterval array json send status".split())
ROUTE_WINDOW, LEAST_LINES = 320, 5


def _js_calls(snippet: str) -> list[str]:
    return _unique(c for c in _JS_CALL.findall(snippet) if c.lower() not in NO_CALLS)


def analyse_javascript(text: str | None) -> tuple[str, list[str], list[tuple]]:
    """(backend, imports, symbols) by the forms of declarations and routes.

    A declaration ends before the next symbol, but holds five lines where the file has them; a route ends with its
    statement, within a window.  The first of symbols with one name, start and kind counts."""
    text = text or ""
    starts = [0, *(m.end() for m in re.finditer("\n", text))]
    line_at = lambda offset: bisect_right(starts, offset)
    rows = text.splitlines()
    found = []
    for m in _JS_DECLARED.finditer(text):
        name = next(filter(None, m.groups()))
        found.append((line_at(m.start()), name, "class" if "class" in m[0] else "function", 0, [], "", []))
    routes = sorted((m.start(), m["m"], m["p"]) for pattern in _JS_ROUTES for m in pattern.finditer(text))
    for at, method, path in routes:
        snippet = text[at : at + ROUTE_WINDOW]
        snippet = snippet[: snippet.find(");") + 2] if ");" in snippet else snippet
        named = [c for c in _js_calls(snippet) if c.lower().startswith("handle") or c.lower().endswith("request")]
        handlers = [h for h in _unique([*_JS_HANDLER.findall(snippet), *named]) if h.lower() not in NO_CALLS]
        found.append((line_at(at), route_name(method, path), "route", line_at(at + len(snippet)), handlers, path, handlers))
    found.sort(key=lambda s: s[:2])
    symbols, seen = [], set()
    for (start, name, kind, end, calls, path, _), after in zip(found, [*(f[0] for f in found[1:]), max(1, len(rows))]):
        end = end or min(max(start + LEAST_LINES - 1, after - 1), max(1, len(rows)))
        calls = calls or _js_calls("\n".join(rows[start - 1 : end]))
        if (name, start, kind) not in seen:
            seen.add((name, start, kind))
            symbols.append((name, kind, start, end, calls, [], [], path))
    return "regex-fallback", _unique(a or b for a, b in _JS_IMPORT.findall(text)), symbols


_LINK = re.compile(r"""(?:src|href)=['"]([^'"]+)['"]""", re.I)
_CSS_IMPORT = re.compile(r"""@import\s+(?:url\()?['"]?([^'")]+)""", re.I)


def analyse(language: str | None, text: str | None) -> tuple[str, list[str], list[tuple]]:
    """(backend, imports, symbols) of a source by its language; other languages have neither imports nor symbols."""
    if language == "python":
        return analyse_python(text)
    if language in ("javascript", "typescript"):
        return analyse_javascript(text)
    if language in ("html", "css"):
        static = lambda v: v.strip().replace("\\", "/").removeprefix("/static/")
        return ("html-links", _unique(map(static, _LINK.findall(text or ""))), []) if language == "html" else ("css-imports", _unique(map(static, _CSS_IMPORT.findall(text or ""))), [])
    return "none", [], []


LEAST_SNIPPET = 8


def symbols(files: DataFrame, key: str, text: str, language: str | Column) -> DataFrame:
    """One row per symbol: key, backend, the file's number of imports, position, the symbol's columns and its snippet.

    Snippets are cut in the pass that parses, so no text meets another row; Arrow batches, no shuffle."""
    kinds = dict(files.dtypes)

    def run(batches):
        for pdf in batches:
            rows = []
            for k, t, lang in zip(pdf["key"], pdf["text"], pdf["lang"]):
                backend, imports, found = analyse(lang, t)
                lines = (t or "").splitlines()
                rows += [(k, backend, len(imports), i, *s, "\n".join(lines[max(s[2] - 1, 0) : s[3]]).strip()) for i, s in enumerate(found)]
            yield pd.DataFrame(rows, columns=["key", "parser_backend", "imports", "pos", "name", "kind", "start_line", "end_line", "calls", "refs", "inherits", "route_path", "snippet"])

    schema = f"key {kinds[key]}, parser_backend string, imports int, pos int, name string, kind string, start_line int, end_line int, calls array<string>, refs array<string>, inherits array<string>, route_path string, snippet string"
    lang = F.col(language) if isinstance(language, str) else language
    return files.select(F.col(key).alias("key"), F.col(text).alias("text"), lang.alias("lang")).mapInPandas(run, schema).withColumnRenamed("key", key)


def python_symbols(files: DataFrame, key: str, text: str) -> DataFrame:
    return symbols(files, key, text, F.lit("python"))


def symbol_chunks(found: DataFrame, key: str) -> DataFrame:
    """Symbols whose snippet has eight characters or more; the number in a chunk's id counts the others too."""
    return found.where(F.length("snippet") >= LEAST_SNIPPET).select(key, "pos", "name", "kind", "start_line", "end_line", F.col("snippet").alias("text"))


def diff_paths(diff: Column) -> Column:
    """New paths of a unified diff in order, without /dev/null and repeats."""
    return F.array_distinct(F.filter(F.transform(F.regexp_extract_all(diff, F.lit(r"(?m)^\+\+\+\s+b/(.+)$"), F.lit(1)), lambda p: F.trim(p)), lambda p: p != "/dev/null"))


def diff_counts(df: DataFrame, key: str, diff: str) -> DataFrame:
    """key, file, added, removed lines of unified diffs: the current file is the last header before a line."""
    from pyspark.sql import Window as W

    lines = df.select(key, F.posexplode(F.split(diff, "\n")).alias("pos", "line"))
    head = F.when(F.col("line").startswith("+++ b/"), F.trim(F.substring("line", 7, 10_000)))
    own = lines.withColumn("file", F.last(head, ignorenulls=True).over(W.partitionBy(key).orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)))
    plus = F.col("line").startswith("+") & ~F.col("line").startswith("+++")
    minus = F.col("line").startswith("-") & ~F.col("line").startswith("---")
    return own.where("file is not null").groupBy(key, "file").agg(F.count_if(plus).alias("added"), F.count_if(minus).alias("removed"))


#: What the output of a failed command tells, first match first; and the forms of files and tests in it.
FAILURES = (("syntaxerror|syntax error", "syntax_error"), ("modulenotfounderror|cannot find module", "missing_dependency"), ("timeout|timed out", "timeout"), ("permission|access is denied", "environment_permission"))
_FILE_FORMS = (r"([A-Za-z0-9_./\\-]+\.(?:py|js|ts|tsx|jsx|css|html|json|toml|md))[:(]\d+", r'File "([^"]+)"')


def failure_type(log: Column) -> Column:
    """Class of a failed command's output."""
    low = F.lower(F.coalesce(log, F.lit("")))
    out = F.when(low.contains("assert") | (low.contains("failed") & low.contains("pytest")), "test_failure").otherwise("unknown")
    for pattern, kind in reversed(FAILURES):
        out = F.when(low.rlike(pattern), kind).otherwise(out)
    return out


def referenced_files(log: Column) -> Column:
    """Distinct files that an output names with a line, in order of form and place."""
    found = F.concat(*(F.regexp_extract_all(F.coalesce(log, F.lit("")), F.lit(p), F.lit(1)) for p in _FILE_FORMS))
    return F.array_distinct(F.filter(F.transform(found, lambda p: F.regexp_replace(p, r"\\", "/")), lambda p: p != ""))


def failed_tests(log: Column) -> Column:
    """Distinct tests that an output reports as failed."""
    lines = F.filter(F.transform(F.split(F.coalesce(log, F.lit("")), "\r?\n"), lambda x: F.trim(x)), lambda x: x.startswith("FAILED ") | (x.contains("::") & (F.lower(x).contains(" failed") | F.lower(x).contains("error"))))
    return F.array_distinct(F.filter(F.transform(lines, lambda x: F.trim(F.substring_index(F.regexp_replace(x, "^(.*?)FAILED ", "$1"), " - ", 1))), lambda x: x != ""))


def unified_diff(path: Column, before: Column, after: Column) -> Column:
    """Unified diff of two texts of a path; empty where they are equal.  Line matching needs Python."""
    import difflib

    def one(p: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(["\n".join(difflib.unified_diff((x or "").splitlines(), (y or "").splitlines(), f"a/{n}", f"b/{n}", lineterm="")) for n, x, y in zip(p, a, b)], dtype="object")

    return F.pandas_udf(one, "string")(path, before, after)


def similarity(a: str | None, b: str | None) -> float:
    """Sequence-matching ratio of two names, letter case aside."""
    import difflib

    return round(difflib.SequenceMatcher(None, (a or "").lower(), (b or "").lower()).ratio(), 6) if a and b else 0.0


def jaccard(a: Column, b: Column) -> Column:
    """Share of two lists' distinct values, letter case aside, that both have; 0 where one has none."""
    low = lambda x: F.array_distinct(F.filter(F.transform(F.coalesce(x, F.array().cast("array<string>")), lambda v: F.lower(v)), lambda v: v != ""))
    x, y = low(a), low(b)
    return F.when((F.size(x) > 0) & (F.size(y) > 0), F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))).otherwise(0.0)


def name_similarity(pairs: DataFrame, a: str, b: str, to: str = "similarity") -> DataFrame:
    """Adds the greater of the two names' sequence ratio (which needs Python) and the overlap of their tokens."""
    ratio = F.pandas_udf(lambda x, y: pd.Series([similarity(p, q) for p, q in zip(x, y)], dtype="float64"), "double")
    return pairs.withColumn(to, F.round(F.greatest(ratio(F.col(a), F.col(b)), jaccard(tokenize(F.col(a)), tokenize(F.col(b)))), 6))
