"""Graph queries over the code chunks' own names, calls, references, imports and routes."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from lodestone.functions import text as T
from lodestone.operators import evidence as V, graph as G, replay as RP, search as SE
from lodestone.operators.lineage import checkpointed
from lodestone.sources.tables import chunks, questions, table

from . import sql as S


def _units(spark, d):
    return G.units(chunks(spark, d))


def _edges(spark, d):
    return G.edges(_units(spark, d))


def prioritized_resolve(spark, d):
    u = _units(spark, d)
    return G.resolve(u, G.names_asked(u).distinct()).select("source", "target", "label", "name", "tier")


def edge_build(spark, d):
    return _edges(spark, d).select("source", "target", "label", "weight")


def edge_stats(spark, d):
    """Counts by repository and label, with totals, in one pass."""
    return _edges(spark, d).rollup("repo", "label").agg(F.count("*").alias("edges"), F.round(F.sum("weight"), 4).alias("weight"))


def chunk_stats(spark, d):
    """Chunks by language and by parser from one scan."""
    c = chunks(spark, d).select(F.coalesce("language", F.lit("?")).alias("language"), F.coalesce("parser_backend", F.lit("?")).alias("parser"))
    return c.groupingSets([["language"], ["parser"], []], "language", "parser").agg(F.count("*").alias("chunks"))


def _seeds(spark, d):
    """The first route unit of each repository."""
    return _units(spark, d).where("symbol_kind = 'route'").groupBy("repo").agg(F.min("node").alias("node"))


def _starts(spark, d):
    return _seeds(spark, d).select(F.col("node").alias("start"), "node")


def neighborhood(spark, d):
    return G.bounded_bfs(G.both_ways(_edges(spark, d)), _starts(spark, d), 2, G.FANOUT_PPR).select("start", "node", "depth", "parent")


def impact_bfs(spark, d):
    return G.bounded_bfs(_edges(spark, d), _starts(spark, d), 3, G.FANOUT_IMPACT).select("start", "node", "depth", "parent")


def _targets(u):
    """The first function of each repository that has one."""
    return u.where("symbol_kind = 'function'").groupBy("repo").agg(F.min("node").alias("node"))


def _impact(spark, d):
    u = checkpointed(_units(spark, d))
    return u, _targets(u), checkpointed(G.impact(G.edges(u), _targets(u)))


def impact_walk(spark, d):
    """What the first function of each repository reaches, and what reaches it."""
    return _impact(spark, d)[2].select("start", "node", "direction", "depth", "weight", F.col("rank").cast("int").alias("rank"))


def impact_files(spark, d):
    """Files of those nodes and of the target, with how many they are and whether the target stands in them."""
    u, t, walk = _impact(spark, d)
    nodes = walk.select("start", "node").union(t.select(F.col("node").alias("start"), "node")).distinct().join(u.select("node", "relpath"), "node")
    home = t.join(u.select("node", F.col("relpath").alias("home")), "node").select(F.col("node").alias("start"), "home")
    return nodes.join(home, "start").groupBy("start", "relpath").agg(F.count("*").alias("nodes"), F.bool_or(F.col("relpath") == F.col("home")).alias("target_file"))


def impact_risk(spark, d):
    """Risk of changing each target: high where a route is exposed, medium with three or more callers or callees, else low."""
    u, t, walk = _impact(spark, d)
    routes = walk.select("start", "node").join(u.where("route_path <> ''").select("node", "route_path"), "node").groupBy("start").agg(F.count_distinct("route_path").alias("routes"))
    g = walk.groupBy("start").agg(F.count_if(F.col("direction") == "reverse").alias("upstream"), F.count_if(F.col("direction") == "forward").alias("downstream"))
    j = t.select(F.col("node").alias("start")).join(g, "start", "left").join(routes, "start", "left").fillna(0)
    risk = F.when(F.col("routes") > 0, "high").when((F.col("upstream") >= 3) | (F.col("downstream") >= 3), "medium").otherwise("low")
    return j.select("start", "upstream", "downstream", "routes", risk.alias("risk_level"))


def anchor_boosts(spark, d):
    """Boosts around every route, as a question that names it and asks for a handler would get them."""
    u = checkpointed(_units(spark, d))
    starts = u.where("symbol_kind = 'route'").select(F.col("node").alias("start"), "node")
    return G.route_anchors(G.edges(u), starts, u.select("node", F.col("symbol_kind").alias("kind")))


def caller_test(spark, d):
    """Whether each route calls or leads to the next unit of its own file."""
    u = _units(spark, d)
    nxt = F.lead("node").over(W.partitionBy("repo", "relpath").orderBy("node"))
    pair = u.select("repo", "node", "symbol_kind", nxt.alias("next")).where("symbol_kind = 'route' and next is not null")
    e = _edges(spark, d).where("label in ('calls', 'routes_to')").select(F.col("source").alias("node"), F.col("target").alias("next")).distinct()
    return pair.select("node", "next").join(e.withColumn("called", F.lit(True)), ["node", "next"], "left").select("node", "next", F.coalesce("called", F.lit(False)).alias("called"))


def enclosing_class(spark, d):
    """The nearest class around each function by its lines: the class of the same file with the latest start whose lines hold the function's; and the qualified name that follows.

    Only classes and functions of one file meet."""
    lines = lambda c: (F.least("start_line", F.coalesce("end_line", "start_line")).alias(f"{c}_from"), F.greatest("start_line", F.coalesce("end_line", "start_line")).alias(f"{c}_to"))
    u = chunks(spark, d).where("start_line is not null and symbol_name <> ''")
    f = u.where("symbol_kind = 'function'").select("repo_root", "relpath", "chunk_no", F.col("symbol_name").alias("name"), *lines("f"))
    c = u.where("symbol_kind = 'class'").select("repo_root", "relpath", F.col("symbol_name").alias("class"), F.col("chunk_no").alias("class_no"), *lines("c"))
    held = f.join(c, ["repo_root", "relpath"]).where("c_from <= f_from and f_to <= c_to")
    best = held.groupBy("chunk_no", "name").agg(F.max_by("class", F.struct("c_from", -F.col("c_to"), "class_no")).alias("class"))
    return best.select("chunk_no", "class", F.concat_ws(".", "class", "name").alias("qualified"))


def edge_between(spark, d):
    """The first edge between the two ends of each step of a proof's paths, in either direction."""
    docs = RP.proof_docs(table(spark, d, "evidence_bundles")).where("repo is not null")
    steps = docs.select("repo", F.explode("doc.paths").alias("p")).select("repo", F.inline(F.transform(F.sequence(F.lit(1), F.greatest(F.size("p") - 1, F.lit(1))), lambda i: F.struct(F.get("p", i - 1).alias("a"), F.get("p", i).alias("b"))))).where("b is not null").distinct()
    u = checkpointed(_units(spark, d))
    e = G.both_ways(G.edges(u)).select("repo", "source", "target", F.col("label").alias("edge"), "weight")
    named = u.select("repo", "node", T.label_of(F.col("relpath"), F.col("symbol_name")).alias("l"))
    end = lambda who, name: named.select("repo", F.col("node").alias(who), F.col("l").alias(name))
    found = steps.join(end("source", "a"), ["repo", "a"]).join(end("target", "b"), ["repo", "b"]).join(e, ["repo", "source", "target"])
    return found.groupBy("repo", "a", "b").agg(F.max(F.struct("weight", "edge")).alias("x")).select("repo", "a", "b", F.col("x.edge").alias("label"), F.col("x.weight").alias("weight"))


#: Requests of the text and symbol searches: each a list of terms.
SEARCHES = (("freeze", "replay"), ("ledger", "the file"), ("password",), ("x",))


def _requests(spark):
    return spark.createDataFrame([(i, list(t)) for i, t in enumerate(SEARCHES, 1)], "request int, terms array<string>")


def grep_lines(spark, d):
    """The twelve best lines of each repository for each request, over its latest stored sources."""
    f = table(spark, d, "file_analysis").withColumn("repo", T.repository_key(F.col("repo_root"))).where("repo is not null and source_text is not null")
    f = f.groupBy("repo", "relpath").agg(F.max_by("source_text", "file_no").alias("text"))
    return SE.search_text(f, _requests(spark), 12)


def symbol_search(spark, d):
    return SE.search_symbols(chunks(spark, d).where("repo is not null"), _requests(spark), 30)


def relations(spark, d):
    """Outgoing and incoming edges of the first class of each repository by name, thirty at most."""
    u = checkpointed(_units(spark, d))
    asked = u.where("symbol_kind = 'class'").groupBy("repo").agg(F.min("symbol_name").alias("symbol"))
    return SE.relations(u, _edges(spark, d), asked, 30)


def find_chunk(spark, d):
    """The chunk that each evidence label stands for, by id, label, or either in another case or as a bare symbol."""
    b = table(spark, d, "evidence_bundles")
    asked = V.with_repo(V.evidence_rows(b), b).where("label is not null").select("repo", F.col("label").alias("target")).distinct()
    return SE.find_chunk(chunks(spark, d), asked)


def directory_listing(spark, d):
    """Entries of each repository's top folder: folders first, then names whatever their case."""
    return SE.list_directory(table(spark, d, "file_facts").withColumn("repo", T.repository_key(F.col("repo_root"))), "")


def reachability(spark, d):
    """Nodes every route reaches within five levels by the best edges of each node."""
    u = _units(spark, d).where("symbol_kind = 'route'").select(F.col("node").alias("start"), "node")
    return G.bounded_bfs(_edges(spark, d), u, 5, G.FANOUT_ROUTE).groupBy("start").agg((F.count("*") - 1).alias("reached"), F.max("depth").alias("deepest"))


def exposed_routes(spark, d):
    """Routes that lead to a function within two levels, by function."""
    u = _units(spark, d)
    r = u.where("symbol_kind = 'route'")
    hits = G.bounded_bfs(_edges(spark, d), r.select(F.col("node").alias("start"), "node"), 2, G.FANOUT_ROUTE).where("depth > 0")
    named = hits.join(r.select(F.col("node").alias("start"), "route_path"), "start")
    return named.groupBy("node").agg(F.count("*").alias("routes"), F.min("depth").alias("nearest"), F.min("route_path").alias("first_route"))


def ppr_fixed_iter(spark, d):
    """Five rounds from all routes of a repository, over edges in both directions."""
    seeds = _units(spark, d).where("symbol_kind = 'route'").select("repo", "node")
    size = seeds.groupBy("repo").agg(F.count("*").alias("n"))
    teleport = seeds.join(size, "repo").select("repo", "node", (1.0 / F.col("n")).alias("share"))
    e = G.both_ways(_edges(spark, d)).join(size.select("repo"), "repo", "left_semi")
    return G.pagerank(e, teleport, 5).select("node", F.round("rank", 8).alias("rank")).where("rank > 0")


def role_memory(spark, d):
    """Files per role in a repository, and the first four of them."""
    f = table(spark, d, "file_facts").withColumn("repo", T.repository_key(F.col("repo_root"))).select("repo", "relpath", F.explode("roles").alias("role")).distinct()
    r = f.withColumn("rank", F.row_number().over(W.partitionBy("repo", "role").orderBy("relpath"))).withColumn("files", F.count("*").over(W.partitionBy("repo", "role")))
    return r.where("rank <= 4").select("repo", "role", "relpath", F.col("rank").cast("int").alias("rank"), "files")


def overview(spark, d):
    """The three files of each repository with most routes, symbols and imports; among equals the last by path."""
    f = table(spark, d, "file_facts").withColumn("repo", T.repository_key(F.col("repo_root"))).groupBy("repo", "relpath").agg(F.max(F.size("routes")).alias("routes"), F.max(F.size("symbol_names")).alias("symbols"), F.max(F.size("imports")).alias("imports"))
    order = [F.col(c).desc() for c in ("routes", "symbols", "imports")]
    return f.withColumn("rank", F.row_number().over(W.partitionBy("repo").orderBy(*order, F.col("relpath").desc()))).where("rank <= 3").withColumn("rank", F.col("rank").cast("int"))


def overview_edges(spark, d):
    """The twelve heaviest edges of each repository."""
    order = W.partitionBy("repo").orderBy(F.col("weight").desc(), "source", "target", "label")
    return _edges(spark, d).withColumn("rank", F.row_number().over(order).cast("int")).where("rank <= 12")


def file_roles(spark, d):
    """Roles by rule from path, language, routes and imports."""
    f = table(spark, d, "file_facts").select("repo_root", "relpath", "language", F.size("routes").alias("routes"), F.size("imports").alias("imports")).distinct()
    return f.select("repo_root", "relpath", F.array_join(T.file_roles(F.col("relpath"), F.col("language"), F.col("routes") > 0, F.col("imports") > 0), ",").alias("roles"))


def route_anchors(spark, d):
    """Route chunks that a question's route literals match, exactly or by pattern, within its repository."""
    q = questions(spark, d).select("query_id", "repo", F.explode(T.route_literals(F.col("question"))).alias("literal"))
    r = chunks(spark, d).where("symbol_kind = 'route' and route_path <> ''").select("repo", "chunk_no", "route_path")
    first = lambda c: F.concat_ws("/", F.element_at(F.split(c, "/"), 2), F.size(F.split(F.regexp_replace(c, "/+$", ""), "/")).cast("string"))
    # equal first part and equal number of parts are necessary for a match, and make it an equi-join
    j = q.withColumn("k", first(F.col("literal"))).join(r.withColumn("k", first(F.col("route_path"))), ["repo", "k"])
    return j.where(T.route_matches(F.col("route_path"), F.col("literal"))).select("query_id", "chunk_no", "literal", "route_path").distinct()


QUERIES = {f.__name__: f for f in (prioritized_resolve, edge_build, edge_stats, chunk_stats, relations, neighborhood, impact_bfs, impact_walk, impact_files, impact_risk, anchor_boosts, caller_test, enclosing_class, edge_between, reachability, exposed_routes, ppr_fixed_iter, role_memory, overview, overview_edges, file_roles, grep_lines, symbol_search, find_chunk, directory_listing, route_anchors)}

_STEM = lambda x: rf"regexp_replace(lower(list_last(string_split(regexp_replace(regexp_replace({x}, '\\', '/', 'g'), '/+$', ''), '/'))), '^(.+)\.[^.]*$', '\1')"
_U = f"""{S.CHUNKS}, u AS (SELECT * FROM (SELECT repo, chunk_no AS node, relpath, symbol_name, symbol_kind, qualified_name, route_path, imports, calls, refs, inherits, handler_names,
    row_number() OVER (PARTITION BY repo, chunk_id ORDER BY chunk_no DESC) AS rn FROM c WHERE repo IS NOT NULL AND chunk_id IS NOT NULL) WHERE rn = 1)"""
_RES = """na AS (SELECT DISTINCT repo, node AS source, relpath, label, lower(name) AS name FROM (
    SELECT repo, node, relpath, 'calls' AS label, unnest(calls || handler_names) AS name FROM u UNION ALL SELECT repo, node, relpath, 'references', unnest(refs) FROM u
    UNION ALL SELECT repo, node, relpath, 'inherits', unnest(inherits) FROM u UNION ALL SELECT repo, node, relpath, 'routes_to', unnest(handler_names) FROM u WHERE symbol_kind = 'route')),
  tg AS (SELECT repo, node AS target, relpath AS there, 1 AS tier, lower(qualified_name) AS name FROM u WHERE qualified_name <> '' UNION ALL SELECT repo, node, relpath, 2, lower(symbol_name) FROM u WHERE symbol_name <> ''),
  r1 AS (SELECT * FROM (SELECT na.*, target, there, tier, min(tier) OVER (PARTITION BY source, label, name) AS first FROM na JOIN tg USING (repo, name)) WHERE tier = first),
  rs AS (SELECT * FROM (SELECT *, there = relpath AS same, bool_or(there = relpath) OVER (PARTITION BY source, label, name) AS anysame FROM r1) WHERE same OR NOT anysame)"""
_E = f"""{_U}, {_RES},
  im AS (SELECT DISTINCT repo, node AS source, {_STEM('i')} AS stem FROM (SELECT repo, node, unnest(imports) AS i FROM u)),
  fl AS (SELECT repo, node AS target, {_STEM('relpath')} AS stem FROM u WHERE symbol_name = ''),
  e AS (SELECT repo, source, target, label, max(weight) AS weight FROM (
    SELECT repo, source, target, label, (CASE label WHEN 'calls' THEN CASE WHEN same THEN 2.6 ELSE 1.8 END WHEN 'references' THEN CASE WHEN same THEN 1.35 ELSE 0.85 END WHEN 'inherits' THEN 3.0 ELSE 3.2 END)::DOUBLE AS weight FROM rs
    UNION ALL SELECT repo, source, target, 'imports', 1.4::DOUBLE FROM im JOIN fl USING (repo, stem)) WHERE source <> target GROUP BY ALL),
  eb AS (SELECT repo, source, target, label, weight FROM e UNION ALL SELECT repo, target, source, label, weight FROM e)"""
_SEED = "se AS (SELECT min(node) AS start FROM u WHERE symbol_kind = 'route' GROUP BY repo)"


def _bfs(edges: str, starts: str, depth: int, fanout: int) -> str:
    """Unrolled levels."""
    out = [f"fe AS (SELECT DISTINCT source, target FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY weight DESC, label DESC, target DESC) AS rn FROM {edges}) WHERE rn <= {fanout})", f"bf0 AS (SELECT start, start AS node, 0 AS depth, NULL::BIGINT AS parent FROM {starts})", "s0 AS (SELECT * FROM bf0)"]
    for k in range(1, depth + 1):
        out.append(f"bf{k} AS (SELECT b.start, f.target AS node, {k} AS depth, min(f.source) AS parent FROM bf{k - 1} b JOIN fe f ON f.source = b.node WHERE NOT EXISTS (SELECT 1 FROM s{k - 1} s WHERE s.start = b.start AND s.node = f.target) GROUP BY ALL)")
        out.append(f"s{k} AS (SELECT * FROM s{k - 1} UNION ALL SELECT * FROM bf{k})")
    return ",\n  ".join(out)


def _impact_sql(depth: int, fanout: int, most: int) -> str:
    """Unrolled levels in both directions."""
    out = ["ts AS (SELECT min(node) AS start FROM u WHERE symbol_kind = 'function' GROUP BY repo)", "bo AS (SELECT 'forward' AS direction, source, target, label, weight FROM e UNION ALL SELECT 'reverse', target, source, label, weight FROM e)",
           f"ks AS (SELECT direction, source, target, max(weight) AS step FROM (SELECT *, row_number() OVER (PARTITION BY direction, source ORDER BY weight DESC, label DESC, target DESC) AS rn FROM bo) WHERE rn <= {fanout} GROUP BY ALL)", "w0 AS (SELECT start, start AS node, unnest(['forward', 'reverse']) AS direction, 0 AS depth, 0.0::DOUBLE AS weight FROM ts)", "v0 AS (SELECT * FROM w0)"]
    for k in range(1, depth + 1):
        out.append(f"w{k} AS (SELECT w.start, ks.target AS node, w.direction, {k} AS depth, round(max(w.weight + step), 4) AS weight FROM w{k - 1} w JOIN ks ON ks.direction = w.direction AND ks.source = w.node WHERE NOT EXISTS (SELECT 1 FROM v{k - 1} v WHERE v.start = w.start AND v.direction = w.direction AND v.node = ks.target) GROUP BY w.start, ks.target, w.direction)")
        out.append(f"v{k} AS (SELECT * FROM v{k - 1} UNION ALL SELECT * FROM w{k})")
    out.append(f'iw AS (SELECT start, node, direction, depth, weight, rn::INT AS "rank" FROM (SELECT *, row_number() OVER (PARTITION BY start, direction ORDER BY depth, weight DESC, node) AS rn FROM v{depth} WHERE depth > 0) WHERE rn <= {most})')
    return ",\n  ".join(out)


_IMPACT = _impact_sql(3, G.FANOUT_IMPACT, 24)


def _ppr(rounds: int) -> str:
    out = ["sd AS (SELECT repo, node, 1.0::DOUBLE / count(*) OVER (PARTITION BY repo) AS share FROM u WHERE symbol_kind = 'route')", "ee AS (SELECT * FROM eb WHERE repo IN (SELECT repo FROM sd))", "mg AS (SELECT source, target, sum(least(4.0, greatest(0.05, weight))) AS w FROM ee GROUP BY ALL)",
           "mv AS (SELECT source AS node, target, w / sum(w) OVER (PARTITION BY source) AS p FROM mg)", "nd AS (SELECT n.repo, n.node, coalesce(share, 0.0) AS share, n.node IN (SELECT node FROM mv) AS moves FROM (SELECT repo, source AS node FROM ee UNION SELECT repo, target FROM ee UNION SELECT repo, node FROM sd) n LEFT JOIN sd ON sd.repo = n.repo AND sd.node = n.node)", "p0 AS (SELECT repo, node, share AS r FROM nd)"]
    for k in range(1, rounds + 1):
        q = f"p{k - 1}"
        out.append(f"""p{k} AS (SELECT nd.repo, nd.node, 0.15 * share + 0.85 * coalesce(f.flow, 0.0) + 0.85 * coalesce(l.lost, 0.0) * share AS r FROM nd
      LEFT JOIN (SELECT target AS node, sum(r * p) AS flow FROM {q} JOIN mv USING (node) GROUP BY ALL) f ON f.node = nd.node LEFT JOIN (SELECT {q}.repo, sum(r) AS lost FROM {q} JOIN nd n2 ON n2.node = {q}.node AND NOT n2.moves GROUP BY ALL) l ON l.repo = nd.repo)""")
    return ",\n  ".join(out)


_FACTS = f"(SELECT *, {S.repo('repo_root')} AS repo FROM file_facts)"
_P = "replace(lower(relpath), chr(92), '/')"
_R = lambda cond, *roles: f"CASE WHEN {cond} THEN [{', '.join(map(repr, roles))}] ELSE [] END"
_HAS = lambda *parts: "(" + " OR ".join(f"contains({_P}, {p!r})" for p in parts) + ")"
_ROLES = "(" + " || ".join([
    _R(f"starts_with({_P}, 'web/') OR {_HAS('/components/', '/pages/', '/frontend/')}", "frontend"), _R("language = 'html'", "frontend", "page_shell"), _R("language = 'css'", "frontend", "styles"),
    _R(f"language IN ('javascript', 'typescript') AND starts_with({_P}, 'web/')", "frontend", "frontend_logic"), _R(_HAS("/api", "/routes", "server.", "controller", "handler"), "backend", "api"), _R("routes > 0", "backend", "api", "entrypoint"),
    _R(f"list_last(string_split({_P}, '/')) IN ('main.py', 'app.py', 'server.py', '__main__.py', 'server.js')", "entrypoint"), _R(_HAS("config", ".env", "settings", "pyproject.toml", "package.json"), "config"), _R(_HAS("test", "spec", "__tests__"), "tests"),
    _R(f"{_P} LIKE '%.md' OR {_P} LIKE '%.rst'", "docs"), _R("imports > 0 AND language IN ('html', 'css')", "asset_entry")]) + ")"
_STRIP = lambda x: f"CASE WHEN rtrim({x}, '/') = '' THEN '/' ELSE rtrim({x}, '/') END"

ORACLES = {
    "prioritized_resolve": S.with_(_U, _RES) + "SELECT source, target, label, name, tier FROM rs",
    "edge_build": S.with_(_E) + "SELECT source, target, label, weight FROM e",
    "edge_stats": S.with_(_E) + "SELECT repo, label, count(*) AS edges, round(sum(weight), 4) AS weight FROM e GROUP BY ROLLUP (repo, label)",
    "chunk_stats": "SELECT language, parser, count(*) AS chunks FROM (SELECT coalesce(language, '?') AS language, coalesce(parser_backend, '?') AS parser FROM code_chunks) GROUP BY GROUPING SETS ((language), (parser), ())",
    "relations": S.with_(_E) + """, k AS (SELECT repo, min(symbol_name) AS symbol FROM u WHERE symbol_kind = 'class' GROUP BY ALL), s AS (SELECT u.repo, node FROM u JOIN k ON k.repo = u.repo AND lower(k.symbol) IN (lower(symbol_name), lower(qualified_name))),
      x AS (SELECT s.repo, s.node AS source, target, 'out' AS direction, label, weight FROM e JOIN s ON e.source = s.node UNION ALL SELECT s.repo, s.node, e.source, 'in', label, weight FROM e JOIN s ON e.target = s.node)
      SELECT repo, source, target, direction, label, weight, rn::INT AS "rank" FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY weight DESC, target, source, label, direction) AS rn FROM x) WHERE rn <= 30""",
    "grep_lines": f"""WITH f AS (SELECT repo, relpath, text FROM (SELECT {S.repo('repo_root')} AS repo, relpath, source_text AS text, row_number() OVER (PARTITION BY {S.repo('repo_root')}, relpath ORDER BY file_no DESC) AS rn FROM file_analysis WHERE source_text IS NOT NULL) WHERE rn = 1 AND repo IS NOT NULL), l AS (SELECT repo, relpath, lower(unnest(string_split(text, chr(10)))) AS l, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no FROM f),
      q AS (SELECT * FROM (VALUES {', '.join(f"({i}, {[t for t in v if len(t) >= 2]!r}::VARCHAR[])" for i, v in enumerate(SEARCHES, 1))}) AS t(request, terms)), h AS (SELECT request, repo, relpath, line_no, len(m) + CASE WHEN len(list_filter(m, lambda t: contains(t, ' '))) > 0 THEN 1.5 ELSE 0.0 END AS score FROM (SELECT *, list_filter(terms, lambda t: contains(l, t)) AS m FROM l, q) WHERE len(m) > 0)
      SELECT request, repo, relpath, line_no::INT AS line_no, score::DOUBLE AS score, rn::INT AS "rank" FROM (SELECT *, row_number() OVER (PARTITION BY request, repo ORDER BY score DESC, relpath, line_no) AS rn FROM h) WHERE rn <= 12""",
    "symbol_search": f"""WITH {S.CHUNKS}, q AS (SELECT * FROM (VALUES {', '.join(f"({i}, {list(v)!r})" for i, v in enumerate(SEARCHES, 1))}) AS t(request, terms)), h AS (SELECT request, repo, chunk_no, relpath, start_line, len(list_filter(terms, lambda t: contains(hay, t))) AS matched FROM (SELECT *, lower(concat_ws(' ', symbol_name, qualified_name, route_path, array_to_string(calls, ' '))) AS hay FROM c WHERE symbol_name <> '' AND repo IS NOT NULL), q)
      SELECT request, repo, chunk_no, matched::INT AS matched, rn::INT AS "rank" FROM (SELECT *, row_number() OVER (PARTITION BY request, repo ORDER BY matched DESC, relpath, start_line NULLS FIRST, chunk_no) AS rn FROM h WHERE matched > 0) WHERE rn <= 30""",
    "directory_listing": f"SELECT DISTINCT repo, split_part(relpath, '/', 1) AS name, contains(relpath, '/') AS folder, dense_rank() OVER (PARTITION BY repo ORDER BY NOT contains(relpath, '/'), lower(split_part(relpath, '/', 1)), split_part(relpath, '/', 1))::INT AS \"rank\" FROM (SELECT DISTINCT {S.repo('repo_root')} AS repo, relpath FROM file_facts) WHERE repo IS NOT NULL",
    "impact_walk": S.with_(_E, _IMPACT) + "SELECT start, node, direction, depth, weight, \"rank\" FROM iw",
    "impact_files": S.with_(_E, _IMPACT) + "SELECT n.start, u.relpath, count(*) AS nodes, bool_or(u.relpath = h.relpath) AS target_file FROM (SELECT start, node FROM iw UNION SELECT start, start FROM ts) n JOIN u ON u.node = n.node JOIN u h ON h.node = n.start GROUP BY ALL",
    "impact_risk": S.with_(_E, _IMPACT) + "SELECT start, upstream, downstream, routes, CASE WHEN routes > 0 THEN 'high' WHEN upstream >= 3 OR downstream >= 3 THEN 'medium' ELSE 'low' END AS risk_level FROM (SELECT ts.start, count(iw.node) FILTER (direction = 'reverse') AS upstream, count(iw.node) FILTER (direction = 'forward') AS downstream, count(DISTINCT route_path) FILTER (route_path <> '') AS routes FROM ts LEFT JOIN iw ON iw.start = ts.start LEFT JOIN u ON u.node = iw.node GROUP BY ALL)",
    "anchor_boosts": S.with_(_E, "rt AS (SELECT node AS start FROM u WHERE symbol_kind = 'route')", _bfs("e", "rt", 3, G.FANOUT_ROUTE)) + "SELECT start, node, depth, round(CASE WHEN symbol_kind = 'route' THEN b * 0.35::DOUBLE ELSE b END, 4)::DOUBLE AS boost FROM (SELECT s3.start, s3.node, depth, symbol_kind, greatest(1.2::DOUBLE, 9.0::DOUBLE - (depth - 1) * 1.4::DOUBLE) + CASE WHEN depth = 1 AND symbol_kind = 'function' THEN 7.0 ELSE 0.0 END AS b FROM s3 JOIN u ON u.node = s3.node WHERE depth > 0)",
    "enclosing_class": """WITH u AS (SELECT chunk_no, repo_root, relpath, symbol_name, symbol_kind, least(start_line, coalesce(end_line, start_line)) AS f, greatest(start_line, coalesce(end_line, start_line)) AS t FROM code_chunks WHERE start_line IS NOT NULL AND symbol_name <> '')
      SELECT chunk_no, class, class || '.' || name AS qualified FROM (SELECT a.chunk_no, a.symbol_name AS name, c.symbol_name AS class, row_number() OVER (PARTITION BY a.chunk_no ORDER BY c.f DESC, c.t, c.chunk_no DESC) AS rn FROM u a JOIN u c ON a.repo_root = c.repo_root AND a.relpath = c.relpath AND a.symbol_kind = 'function' AND c.symbol_kind = 'class' AND c.f <= a.f AND a.t <= c.t) WHERE rn = 1""",
    "caller_test": S.with_(_E) + "SELECT node, nx AS next, EXISTS (SELECT 1 FROM e WHERE e.source = p.node AND e.target = p.nx AND label IN ('calls', 'routes_to')) AS called FROM (SELECT node, symbol_kind, lead(node) OVER (PARTITION BY repo, relpath ORDER BY node) AS nx FROM u) p WHERE symbol_kind = 'route' AND nx IS NOT NULL",
    "neighborhood": S.with_(_E, _SEED, _bfs("eb", "se", 2, 24)) + "SELECT start, node, depth, parent FROM s2",
    "impact_bfs": S.with_(_E, _SEED, _bfs("e", "se", 3, 12)) + "SELECT start, node, depth, parent FROM s3",
    "reachability": S.with_(_E, "rt AS (SELECT node AS start FROM u WHERE symbol_kind = 'route')", _bfs("e", "rt", 5, G.FANOUT_ROUTE)) + "SELECT start, count(*) - 1 AS reached, max(depth) AS deepest FROM s5 GROUP BY ALL",
    "exposed_routes": S.with_(_E, "rt AS (SELECT node AS start FROM u WHERE symbol_kind = 'route')", _bfs("e", "rt", 2, G.FANOUT_ROUTE)) + "SELECT s2.node, count(*) AS routes, min(depth) AS nearest, min(u.route_path) AS first_route FROM s2 JOIN u ON u.node = s2.start WHERE depth > 0 GROUP BY ALL",
    "ppr_fixed_iter": S.with_(_E, _ppr(5)) + 'SELECT node, round(r, 8) AS "rank" FROM p5 WHERE round(r, 8) > 0',
    "role_memory": f'SELECT repo, role, relpath, rn::INT AS "rank", files FROM (SELECT *, row_number() OVER (PARTITION BY repo, role ORDER BY relpath) AS rn, count(*) OVER (PARTITION BY repo, role) AS files FROM (SELECT DISTINCT repo, relpath, unnest(roles) AS role FROM {_FACTS})) WHERE rn <= 4',
    "overview": f'SELECT repo, relpath, routes, symbols, imports, rn::INT AS "rank" FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY routes DESC, symbols DESC, imports DESC, relpath DESC) AS rn FROM (SELECT repo, relpath, max(len(routes))::INT AS routes, max(len(symbol_names))::INT AS symbols, max(len(imports))::INT AS imports FROM {_FACTS} GROUP BY ALL)) WHERE rn <= 3',
    "overview_edges": S.with_(_E) + "SELECT repo, source, target, label, weight, rn::INT AS \"rank\" FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY weight DESC, source, target, label) AS rn FROM e) WHERE rn <= 12",
    "file_roles": f"SELECT repo_root, relpath, array_to_string({S.distinct(_ROLES)}, ',') AS roles FROM (SELECT DISTINCT repo_root, relpath, language, len(routes) AS routes, len(imports) AS imports FROM file_facts)",
    "route_anchors": S.with_(S.CHUNKS, S.QUESTIONS) + f"""SELECT DISTINCT query_id, chunk_no, literal, route_path FROM (SELECT query_id, repo, unnest({S.routes('question')}) AS literal FROM q) JOIN (SELECT repo, chunk_no, route_path FROM c WHERE symbol_kind = 'route' AND route_path <> '') USING (repo)
      WHERE {_STRIP('route_path')} = {_STRIP('literal')} OR (contains(route_path, ':') AND regexp_full_match({_STRIP('literal')}, regexp_replace({_STRIP('route_path')}, ':[A-Za-z_][A-Za-z0-9_]*', '[^/]+', 'g')))""",
}
