"""What a question asks for, and the multi-view rerank: rules as SQL conditions over one row per question and candidate.

The conditions are written in the part of SQL that Spark and other engines share, so that a comparison can read the
same table of rules; how rows come together is this module's own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from lodestone.functions.text import route_literals, route_matches, tokenize

from .lineage import checkpointed

#: Words of a question that tell what it asks for.
FUNCTION_WORDS = ("which function", "which method", "which handler", "helper", "worker", "writes", "writer", "persists", "loads", "clears", "calls", "function", "函数", "处理函数", "方法")
ROUTE_WORDS = ("route entrypoint", "route implemented", "api route", "endpoint implemented", "where is the route", "路由入口", "接口入口")
BUG_WORDS = ("bug", "error", "缺陷", "错误", "报错", "故障", "异常", "500", "定位", "排查")
EXCLUDED = ("admin", "legacy", "mock", "fake", "test", "preview", "deprecated")
CONTRASTS = ("rather than", "instead of", "excluding", "而不是", "排除")
NO_CONTRAST = ("a", "an", "and", "assistant", "chat", "function", "handler", "instead", "of", "or", "rather", "route", "the", "this", "which")
ACTIONS = ("append", "apply", "authorize", "build", "clear", "create", "delete", "handle", "ingest", "load", "normalize", "persist", "refresh", "render", "reset", "retrieve", "run", "save", "send", "stream", "write")
SAME_ACTIONS = {"build": ("create",), "append": ("ingest",), "create": ("build",), "clear": ("delete", "reset"), "delete": ("clear", "reset"), "persist": ("save", "store"), "save": ("persist", "store"), "retrieve": ("load",), "store": ("persist", "save")}


def says(*words: str, column: str = "low") -> str:
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


def has(array: str, *values: str) -> str:
    return "(" + " OR ".join(f"array_contains({array}, '{v}')" for v in values) + ")"


#: low: the question in lower case; toks: its tokens; routed: whether it names a route.
KIND = f"CASE WHEN {says(*FUNCTION_WORDS)} THEN 'function' WHEN {says(*ROUTE_WORDS)} THEN 'route' ELSE '' END"
FRONTEND = f"({has('toks', 'browser', 'frontend', 'web', 'page', 'ui', '页面', '前端', '浏览器')} OR {says('web studio')})"
STYLE = has("toks", "style", "stylesheet", "css", "样式")
TEST = f"({says('test file', 'which test')} OR {has('toks', 'pytest', '测试文件')})"
CONFIG = says("package data", "configuration", "config file", "pyproject", "配置")
ROUTED = f"(routed OR {says('route', 'endpoint', 'api', '路由', '接口')})"
INTENT = f"CASE WHEN {ROUTED} THEN CASE WHEN ({KIND}) = 'function' THEN 'flow_trace' ELSE 'api_lookup' END WHEN {CONFIG} THEN 'config_lookup' WHEN {TEST} THEN 'test_lookup' WHEN {STYLE} THEN 'style_lookup' WHEN {FRONTEND} THEN 'frontend_lookup' ELSE 'code_search' END"
MODE = f"CASE WHEN {says(*BUG_WORDS)} THEN 'bug_localization' ELSE 'repository_qa' END"
ROLES = ((FRONTEND, ("frontend", "frontend_logic")), (STYLE, ("styles", "frontend")), (TEST, ("tests",)), (CONFIG, ("config",)), (ROUTED, ("api", "entrypoint", "backend")))
LANGUAGES = ((FRONTEND, ("javascript", "typescript", "html", "css")), (STYLE, ("css",)))


def _listed(table) -> "F.Column":
    none = F.array().cast("array<string>")
    return F.array_distinct(F.concat(*(F.when(F.expr(c), F.array(*map(F.lit, v))).otherwise(none) for c, v in table)))


def query_plans(questions: DataFrame) -> DataFrame:
    """query_id, repo, low, toks, literals, mode, intent, target, roles, languages of every question; null texts ask for nothing."""
    q = questions.select("query_id", "repo", F.lower(F.coalesce("question", F.lit(""))).alias("low"), tokenize(F.col("question")).alias("toks"), route_literals(F.col("question")).alias("literals"))
    q = q.withColumn("routed", F.size("literals") > 0)
    return q.select("query_id", "repo", "low", "toks", "literals", F.expr(MODE).alias("mode"), F.expr(INTENT).alias("intent"), F.expr(KIND).alias("target"), _listed(ROLES).alias("roles"), _listed(LANGUAGES).alias("languages"))


#: Columns: base, boost, roles_match, language_match, plan.*, css, logic, shell, kind, symbol, acts, primary_same, primary_own, handles, calls_match, asks_call, excluded, off_route, config_file, test_file, doc_file, reachable.
#: (condition, points) add up in order; a rule whose third member is true multiplies what is there.
RULES = (
    ("boost > 0", "least(2.5, boost)", False),
    ("routed AND reachable", "2.0", False),
    ("roles_match", "7.0", False),
    ("language_match", "7.0", False),
    ("intent = 'style_lookup' AND language = 'css'", "6.0", False),
    ("intent = 'frontend_lookup' AND logic", "8.0", False),
    ("intent = 'frontend_lookup' AND shell", "-4.0", False),
    ("target = 'function' AND kind = 'function'", "5.0", False),
    ("target = 'function' AND kind = 'route'", "-7.0", False),
    ("target = 'function' AND kind NOT IN ('function', 'route') AND symbol = ''", "-5.0", False),
    ("target = 'route' AND kind = 'route'", "6.0", False),
    ("acts > 0", "least(20.0, 15.0 * acts)", False),
    ("acts > 0 AND primary_same", "CASE WHEN primary_own THEN 10.0 ELSE 5.0 END", False),
    ("contains(low, 'handler') AND substr(lower(symbol), 1, 6) = 'handle'", "7.0", False),
    ("calls_match > 0", "least(10.0, 5.0 * calls_match)", False),
    ("calls_match > 0 AND asks_call", "10.0", False),
    ("calls_match = 0 AND asks_call AND kind = 'function'", "-4.0", False),
    ("excluded", "-18.0", False),
    ("routed AND kind = 'route' AND off_route", "-12.0", False),
    ("intent = 'config_lookup' AND NOT config_file", "0.15", True),
    ("intent = 'config_lookup' AND config_file", "10.0", False),
    ("test_file AND intent <> 'test_lookup'", "0.45", True),
    ("doc_file AND intent NOT IN ('docs_lookup', 'config_lookup')", "0.55", True),
    ("symbol <> ''", "0.1", False),
)


def total_sql(rules=RULES, start: str = "greatest(0.0, base)") -> str:
    """The rules folded in order into one expression."""
    out = start
    for condition, points, times in rules:
        out = f"(({out}) {'*' if times else '+'} CASE WHEN {condition} THEN {points} ELSE {'1.0' if times else '0.0'} END)"
    return out


def ruled_out(low) -> "tuple[F.Column, F.Column]":
    """Of a question: the excluded words that it names as such, by ``not the <word>`` or beside a contrast, and all words behind a contrast."""
    none = F.array().cast("array<string>")
    contrast = F.lit(False)
    for m in CONTRASTS:
        contrast = contrast | low.contains(m)
    named = [F.when(low.contains(f"not the {w}") | low.contains(f"not {w}") | (contrast & low.contains(w)), F.lit(w)) for w in EXCLUDED]
    behind = [F.when(low.contains(m), F.array_except(tokenize(F.substr(low, F.locate(m, low) + len(m))), F.array(*map(F.lit, NO_CONTRAST)))).otherwise(none) for m in CONTRASTS]
    return F.array_compact(F.array(*named)), F.array_distinct(F.flatten(F.array(*behind)))


def meets(words, behind, names, candidate) -> "F.Column":
    """Whether a candidate's names hold one of the words, or its tokens one of those behind a contrast."""
    return F.exists(words, lambda w: names.contains(w)) | F.arrays_overlap(candidate, behind)


def excluded(low, names, candidate) -> "F.Column":
    """Whether a question rules a candidate out: by ``not the <word>``, or by words behind a contrast."""
    return meets(*ruled_out(low), names, candidate)


def features(candidates: DataFrame, plans: DataFrame, terms: DataFrame, chunks: DataFrame, roles: DataFrame) -> DataFrame:
    """The rules' columns for every (query_id, doc_id, score, boost) candidate, a chunk of its question's repository; reachable is a chunk that stands for a route which the question names.

    terms: query_id, terms (expanded, as an array).  roles: repo, relpath, file_roles.  What only the question or only the
    chunk tells is found once for each, before they meet; the one wide shuffle is by question, as the ranking needs it."""
    actions = F.array(*map(F.lit, ACTIONS))
    same = F.create_map(*(x for k, v in SAME_ACTIONS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    none = F.array().cast("array<string>")
    own = F.concat(F.array_intersect("toks", actions), F.when(F.array_contains("toks", "handler"), F.array(F.lit("handle"))).otherwise(none), F.when(F.array_contains("toks", "retrieval"), F.array(F.lit("retrieve"))).otherwise(none))
    first = F.get(F.filter("toks", lambda t: F.array_contains(actions, t)), 0)
    p = plans.join(terms, "query_id").withColumn("own", own).withColumn("first", F.coalesce(first, F.lit("")))
    p = p.withColumn("wanted", F.array_distinct(F.concat("own", F.flatten(F.transform("own", lambda a: F.coalesce(F.try_element_at(same, a), none))))))
    p = p.withColumn("primary", F.when(F.col("first") == "", none).otherwise(F.concat(F.array(F.col("first")), F.coalesce(F.try_element_at(same, F.col("first")), none))))
    words, behind = ruled_out(F.col("low"))
    p = checkpointed(p.select("query_id", "low", "intent", "target", "literals", "roles", "languages", "terms", "first", "wanted", "primary", F.array_contains("toks", "call").alias("asks_call"), words.alias("words"), behind.alias("behind")))
    c = chunks.select("repo", "relpath", F.col("chunk_no").alias("doc_id"), F.coalesce("language", F.lit("")).alias("language"), F.coalesce("symbol_kind", F.lit("")).alias("kind"), F.coalesce("symbol_name", F.lit("")).alias("symbol"), F.coalesce("route_path", F.lit("")).alias("route"), F.coalesce("start_line", F.lit(0)).alias("start_line"), tokenize(F.array_join("calls", " ")).alias("called"))
    c = c.withColumn("named", tokenize(F.col("symbol"))).withColumn("placed", tokenize(F.concat_ws(" ", "symbol", "route", "relpath"))).withColumn("label", F.lower(F.concat_ws(":", "relpath", F.when(F.col("symbol") != "", F.col("symbol")))))
    c = c.join(roles, ["repo", "relpath"], "left").drop("repo")
    j = candidates.join(c, "doc_id").join(p, "query_id")
    file_roles = F.coalesce("file_roles", none)
    acted = F.array_intersect("named", "wanted")
    on_route = F.exists("literals", lambda x: route_matches(F.col("route"), x))
    return j.select(
        "query_id", "doc_id", "relpath", "start_line", "low", "intent", "target", "language", "kind", "symbol", F.col("score").alias("base"), F.coalesce("boost", F.lit(0.0)).alias("boost"),
        (F.size("literals") > 0).alias("routed"), ((F.col("route") != "") & on_route).alias("reachable"), F.arrays_overlap(file_roles, "roles").alias("roles_match"), F.array_contains("languages", F.col("language")).alias("language_match"),
        *(F.array_contains(file_roles, r).alias(n) for n, r in (("logic", "frontend_logic"), ("shell", "page_shell"), ("config_file", "config"), ("test_file", "tests"), ("doc_file", "docs"))),
        F.size(acted).alias("acts"), F.arrays_overlap(acted, "primary").alias("primary_same"), F.array_contains(acted, F.col("first")).alias("primary_own"), F.size(F.array_intersect("called", "terms")).alias("calls_match"), "asks_call",
        meets("words", F.col("behind"), F.col("label"), F.col("placed")).alias("excluded"), (~on_route).alias("off_route"),
    )


def reranked(rows: DataFrame, k: int) -> DataFrame:
    """query_id, doc_id, rank, score of the k best candidates with a score over 0, by score, path and line."""
    scored = rows.withColumn("score", F.round(F.expr(total_sql()), 5))
    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), "relpath", "start_line", "doc_id")
    first = scored.select("query_id", "doc_id", "score", F.row_number().over(order).alias("rank")).where((F.col("rank") <= k) & (F.col("score") > 0))  # tested behind the ranks: the optimizer takes the rules apart where it may move them into a join
    return first.select("query_id", "doc_id", "rank", "score")
