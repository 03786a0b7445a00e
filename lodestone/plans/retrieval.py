"""Retrieval queries over code chunks and the suite's questions, each within the question's repository."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lodestone.functions import text as T
from lodestone.operators import blocks as BL, graph as G, index as I, rerank as RR, retrieve as R
from lodestone.operators.lineage import checkpointed
from lodestone.sources.tables import chunks, keyed, questions, table

from . import sql as S
from .graphs import _E, _bfs

K = 5


def _content(spark: SparkSession, d: str):
    return I.content_tokens(chunks(spark, d)), I.query_terms(questions(spark, d))


def _views(spark: SparkSession, d: str) -> DataFrame:
    return I.view_tokens(chunks(spark, d), table(spark, d, "file_facts"))


def tokenize_chunks(spark, d):
    """Tokens of each chunk, joined for comparison."""
    return chunks(spark, d).select("chunk_no", F.array_join(T.tokenize(F.col("text")), " ").alias("tokens"))


def term_freq(spark, d):
    return I.term_frequencies(I.content_tokens(chunks(spark, d))).select("doc_id", "term", F.col("tf").cast("long").alias("tf"))


def doc_freq(spark, d):
    tf = I.term_frequencies(I.content_tokens(chunks(spark, d)))
    return tf.groupBy("term").agg(F.count("*").alias("df"))


def view_stats(spark, d):
    t = _views(spark, d)
    vocab = I.term_frequencies(t).groupBy("view").agg(F.count_distinct("term").alias("vocabulary"))
    return t.groupBy("view").agg(F.count("*").alias("docs"), F.round(F.avg(F.size("tokens")), 3).alias("avgdl")).join(vocab, "view")


def expand_terms(spark, d):
    return questions(spark, d).select("query_id", F.array_join(T.expand_query(F.col("question")), " ").alias("terms"))


def route_literals(spark, d):
    return questions(spark, d).select("query_id", F.posexplode(T.route_literals(F.col("question"))).alias("pos", "route"))


def bm25_topk(spark, d):
    tokens, terms = _content(spark, d)
    return R.bm25_top(tokens, terms, K).select("query_id", "doc_id", "rank", "score")


_TOP = "query_id long, doc_id long, rank int, score double"


def _blocked(spark, d, kernel, schema, expand: bool = False, **more):
    """A ranking by the four views."""
    return BL.ranked_blocks(I.chunk_texts(chunks(spark, d), table(spark, d, "file_facts"), I.VIEW_TEXTS), I.query_terms(questions(spark, d), expand=expand), kernel, schema, **more)


def rrf(spark, d):
    """Content and identifier rankings fused without weights."""
    return _blocked(spark, d, BL.plain_top(K, R.K_PLAIN, ("content", "identifier")), _TOP)


def multiview_rrf(spark, d):
    return _blocked(spark, d, BL.fusion_top(K), _TOP)


def view_contributions(spark, d):
    return _blocked(spark, d, BL.best_parts, "query_id long, doc_id long, view string, part double")


def dense_topk(spark, d):
    return R.dense_top_k(table(spark, d, "embeddings"), K).select("query_id", "doc_id", "rank", "score")


def _plans(spark, d):
    return RR.query_plans(questions(spark, d))


def _facts(spark, d):
    return keyed(table(spark, d, "file_facts"), table(spark, d, "file_facts"))


def _asked(spark, d):
    """Plans and expanded terms of the questions, written once."""
    q = checkpointed(questions(spark, d))
    return checkpointed(RR.query_plans(q)), checkpointed(I.query_terms(q, expand=True))


def query_plan(spark, d):
    """Mode, intent, target kind, roles and languages that each question asks for."""
    return _plans(spark, d).select("query_id", "mode", "intent", "target", F.array_join(F.array_sort("roles"), ",").alias("roles"), F.array_join(F.array_sort("languages"), ",").alias("languages"))


def _scouted(spark, d, k: int, plans, terms):
    return R.file_scout(_facts(spark, d), terms, plans, k)


def file_scout(spark, d):
    q = questions(spark, d)
    return _scouted(spark, d, K, RR.query_plans(q).select("query_id", "repo", "roles"), I.query_terms(q, expand=True)).select("query_id", "relpath", "rank", "score", "matched")


def _scored(spark, d, terms, kernel, schema, per_query=None, shared=None):
    """A ranking by the chunks' scores."""
    return R.scored_blocks(chunks(spark, d), table(spark, d, "file_facts"), terms, kernel, schema, per_query, shared)


def chunk_score(spark, d):
    return _scored(spark, d, I.query_terms(questions(spark, d), expand=True), BL.chunk_tops(K), _TOP + ", matched long")


def _candidates(spark, d, shared=None):
    """Chunks, plans and expanded terms of the questions, and the candidates of each question with its files' boosts."""
    plans, terms = _asked(spark, d)
    boosts = R.file_boosts(_scouted(spark, d, R.SCOUTED, plans, terms))
    found = _scored(spark, d, terms, BL.candidate_tops(R.BEST, R.CANDIDATES), _TOP + ", boost double", R.file_lists(boosts, plans), shared)
    return chunks(spark, d), (plans, terms), checkpointed(found)


def candidate_union(spark, d):
    return _candidates(spark, d)[2].groupBy("query_id").agg(F.count("*").alias("candidates"), (F.sum(F.round(F.col("score") * 100000).cast("long")) / 100000.0).alias("total"), F.max("score").alias("best"))


def relevant_edges(spark, d):
    """Edges between the five best candidates of each question."""
    c, _, found = _candidates(spark, d)
    hits = found.where("rank <= 5").select("query_id", "doc_id")
    return R.edges_among(G.edges(G.units(c)), hits).select("query_id", "source", "target", "label", F.col("rank").cast("int").alias("rank"))


def multiview_rerank(spark, d):
    """Candidates by the rules of the multi-view rerank, without boosts from graph walks; a chunk is reachable if it stands for a route that the question names."""
    c, (plans, terms), found = _candidates(spark, d)
    roles = _facts(spark, d).groupBy("repo", "relpath").agg(F.max("roles").alias("file_roles"))
    asked = terms.groupBy("query_id").agg(F.collect_set("term").alias("terms"))
    return RR.reranked(RR.features(found.select("query_id", "doc_id", "score", "boost"), plans, asked, c, roles), K)


def _seeded(spark, d, shared=None):
    """Graph in both directions, and the three best candidates of each question that are units of it."""
    c, _, found = _candidates(spark, d, shared)
    u = checkpointed(G.units(c))
    seeds = found.where("rank <= 3").select(F.col("query_id").alias("start"), F.col("doc_id").alias("node"), "score").join(u.select("node"), "node", "left_semi")
    return G.both_ways(G.edges(u)), checkpointed(seeds)


def question_ppr(spark, d):
    """Ten greatest boosts of each question from eight rounds of PageRank around its seeds, with the fused scores of the views."""
    postings: dict = {}
    e, seeds = _seeded(spark, d, postings)
    ranks = checkpointed(G.neighborhood_rank(checkpointed(e), seeds, 1, 8))
    wanted = ranks.groupBy(F.col("start").alias("query_id")).agg(F.collect_list("node").alias("wanted"))  # a question's seeds and their neighbors
    hybrid = BL.ranked_blocks([], None, BL.fused_of, "query_id long, doc_id long, score double", questions(spark, d).select("query_id", "repo").join(wanted, "query_id"), shared=postings)
    return G.boosted(ranks, hybrid.select(F.col("query_id").alias("start"), F.col("doc_id").alias("node"), "score")).withColumnRenamed("start", "query_id")


def explored_neighbors(spark, d):
    """What the neighbors of each question's seeds gain within two hops."""
    e, seeds = _seeded(spark, d)
    return G.explored(e, seeds, 2).select(F.col("start").alias("query_id"), "node", "boost")


def question_evidence(spark, d):
    """The evidence of each question's bundle: its best candidates with label, score and the digest of their first 24 lines."""
    c = chunks(spark, d).select(F.col("chunk_no").alias("doc_id"), T.label_of(F.col("relpath"), F.col("symbol_name")).alias("label"), F.sha2(F.coalesce(T.first_lines(F.regexp_replace("text", "\r\n", "\n"), 24), F.lit("")), 256).alias("snippet"))
    return multiview_rerank(spark, d).join(c, "doc_id").select("query_id", "rank", "label", "score", "snippet")


def _anchored(spark, d):
    """Candidates, units, anchors (query_id, start) - routes of its repository that a question names - and what they reach."""
    c, (plans, _), found = _candidates(spark, d)
    u = checkpointed(G.units(c))
    named = plans.select("query_id", "repo", F.explode("literals").alias("literal"))
    routes = u.where("symbol_kind = 'route' and route_path <> ''").select("repo", F.col("node").alias("start"), "route_path")
    # equal keys are necessary for a match, and make it an equi-join
    keyed = named.withColumn("k", F.explode(T.literal_keys(F.col("literal")))).join(routes.withColumn("k", T.route_key(F.col("route_path"))), ["repo", "k"])
    anchors = keyed.where(T.route_matches(F.col("route_path"), F.col("literal"))).select("query_id", "start").distinct()
    anchors = checkpointed(anchors)
    reached = G.bounded_bfs(G.edges(u), anchors.select("start", F.col("start").alias("node")).distinct(), 3, G.FANOUT_ROUTE)
    return found, u, anchors, reached


def proof_build(spark, d):
    """Status of each question's proof: unanchored where it names no route of its repository, proved where its best candidate is such a route or reached from one, else partial."""
    found, _, anchors, reached = _anchored(spark, d)
    top = found.where("rank = 1").select("query_id", F.col("doc_id").alias("top"))
    on = anchors.join(top, "query_id").join(reached.select("start", F.col("node").alias("top")), ["start", "top"], "left_semi").select("query_id").distinct().withColumn("on_path", F.lit(True))
    n = anchors.groupBy("query_id").agg(F.count("*").alias("anchors"))
    j = questions(spark, d).select("query_id").join(top, "query_id", "left").join(n, "query_id", "left").join(on, "query_id", "left")
    status = F.when(F.col("anchors").isNull(), "unanchored").when(F.col("on_path"), "proved").otherwise("partial")
    return j.select("query_id", "top", F.coalesce("anchors", F.lit(0)).alias("anchors"), status.alias("status"))


#: Words in labels that make a lookalike of an answer suspect, and what they stand for.
DECOYS = (("admin", "admin"), ("legacy", "legacy"), ("fake", "fake/mock"), ("mock", "fake/mock"), ("note", "documentation/notes"), ("doc", "documentation/notes"))


def decoy_audit(spark, d, topic: str | None = None):
    """Candidates 2 to 10 of each question that a word in their label makes suspect, and whether a route that the question names leads there; all are rejected, for that word if for nothing else.

    ``topic``: a word that both labels must share, such as the subject of a family of handlers."""
    found, u, anchors, reached = _anchored(spark, d)
    label = chunks(spark, d).select(F.col("chunk_no").alias("doc_id"), T.label_of(F.col("relpath"), F.col("symbol_name")).alias("label"))
    hits = found.where("rank <= 10").join(label, "doc_id").select("query_id", "doc_id", "rank", "label", F.lower("label").alias("low"))
    top = hits.where("rank = 1").select("query_id", F.col("label").alias("top"), F.col("low").alias("top_low"))
    roles = F.array_distinct(F.filter(F.array(*(F.when(F.col("low").contains(w), F.lit(r)) for w, r in DECOYS)), lambda x: x.isNotNull()))
    j = hits.where("rank > 1").join(top, "query_id").where(F.col("label") != F.col("top")).withColumn("roles", roles).where(F.size("roles") > 0)
    j = j if topic is None else j.where(F.col("low").contains(topic) & F.col("top_low").contains(topic))
    j = checkpointed(j)
    asked = j.select("query_id", "doc_id").join(anchors, "query_id")  # few: only suspects are looked for among what the routes reach
    there = asked.join(reached.select("start", F.col("node").alias("doc_id")), ["start", "doc_id"], "left_semi").select("query_id", "doc_id", F.lit(True).alias("there")).distinct()
    j = j.join(there, ["query_id", "doc_id"], "left")
    return j.select("query_id", "doc_id", "rank", F.array_join("roles", ",").alias("roles"), F.coalesce("there", F.lit(False)).alias("route_anchored"))


def proof_nodes(spark, d):
    """Nodes of each question's proof graph with their roles, in the order in which they are given."""
    found, u, anchors, reached = _anchored(spark, d)
    on = anchors.join(reached, "start").select("query_id", "node", "depth").groupBy("query_id", "node").agg(F.min("depth").alias("depth"))
    parts = [
        found.where("rank = 1").select("query_id", F.col("doc_id").alias("node"), F.lit(1).alias("ord"), F.lit("top_hit").alias("role")),
        found.where("rank between 2 and 8").select("query_id", F.col("doc_id").alias("node"), F.lit(2).alias("ord"), F.lit("candidate").alias("role")),
        on.where("depth > 0").select("query_id", "node", F.lit(3).alias("ord"), F.lit("route_reachable").alias("role")), on.where("depth = 0").select("query_id", "node", F.lit(0).alias("ord"), F.lit("route_anchor").alias("role")),
    ]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    roles = F.transform(F.array_sort(F.collect_set(F.struct("ord", "role"))), lambda x: x["role"])  # at most four
    return rows.groupBy("query_id", "node").agg(F.array_join(roles, ",").alias("roles"))


def embedding_inputs(spark, d):
    """Digest of what would be embedded of each chunk."""
    return chunks(spark, d).select("chunk_no", F.sha2(T.embedding_input(F.col("relpath"), F.col("symbol_name"), F.col("symbol_kind"), F.col("route_path"), F.col("text")), 256).alias("digest"))


QUERIES = {f.__name__: f for f in (tokenize_chunks, term_freq, doc_freq, view_stats, expand_terms, route_literals, bm25_topk, rrf, multiview_rrf, view_contributions, dense_topk, query_plan, file_scout, chunk_score, candidate_union, relevant_edges, multiview_rerank, question_ppr, explored_neighbors, question_evidence, proof_build, decoy_audit, proof_nodes, embedding_inputs)}

_VIEWS = S.with_(S.CHUNKS, S.QUESTIONS, S.TERMS, S.VIEW_TOKENS, S.BM25, S.PARTS)
_FILES = f"""f1 AS (SELECT repo, relpath, b.bag AS bag, b.roles AS roles FROM (SELECT repo, relpath, max({{'bag': array_to_string(t, ' ') || chr(1) || array_to_string(roles, ' ') || chr(1) || coalesce(language, ''), 'roles': roles}}) AS b FROM (SELECT {S.repo('repo_root')} AS repo, relpath, roles, language,
    {S.tok("concat_ws(' ', relpath, array_to_string(imports, ' '), array_to_string(symbol_names, ' '), array_to_string(routes, ' '))")} AS t FROM file_facts) GROUP BY ALL)),
  fb AS (SELECT repo, relpath, term, count(*) AS tf FROM (SELECT repo, relpath, unnest(string_split(replace(bag, chr(1), ' '), ' ')) AS term FROM f1) WHERE term <> '' GROUP BY ALL),
  fd AS (SELECT repo, term, count(*) AS df FROM fb GROUP BY ALL), fn AS (SELECT repo, count(*) AS files FROM f1 GROUP BY ALL),
  fl2 AS (SELECT query_id, repo, relpath, sum((1 + ln(tf)) * (ln((files + 1) / (1 + df)) + 1)) AS s, count(*) AS matched FROM qx JOIN fb USING (repo, term) JOIN fd USING (repo, term) JOIN fn USING (repo) GROUP BY ALL),
  sc AS (SELECT query_id, relpath, round(coalesce(s, 0.0) + CASE WHEN n > 0 THEN 3.0 + least(3.0, 0.75 * n) ELSE 0.0 END, 6) AS score, coalesce(matched, 0) AS matched FROM (SELECT pl.query_id, f1.repo, f1.relpath, len(list_intersect(f1.roles, pl.roles)) AS n FROM pl JOIN f1 USING (repo)) LEFT JOIN fl2 USING (query_id, repo, relpath) WHERE n > 0 OR matched > 0)"""
_LIST = lambda rules: "list_distinct(" + " || ".join(f"CASE WHEN {c} THEN {list(v)!r} ELSE [] END" for c, v in rules) + ")"
_PLAN = f"""pq AS (SELECT *, len(literals) > 0 AS routed FROM (SELECT query_id, repo, lower(coalesce(question, '')) AS low, {S.tok('question')} AS toks, {S.routes('question')} AS literals FROM q)),
  pl AS (SELECT query_id, repo, low, toks, literals, routed, {RR.MODE} AS mode, {RR.INTENT} AS intent, {RR.KIND} AS target, {_LIST(RR.ROLES)} AS roles, {_LIST(RR.LANGUAGES)} AS languages FROM pq)"""
_QX = S.EXPANDED.replace("qt AS", "qx AS", 1)
_CHUNK_TOKENS = " || ".join([S.tok("text"), "coalesce(metadata_tokens, [])", S.tok("route_path"), *(S.tok(f"array_to_string({c}, ' ')") for c in ("imports", "calls", "refs", "inherits")), S.tok("qualified_name"), S.tok("array_to_string(handler_names, ' ')")])
_SCORES = f"""ck AS (SELECT repo, chunk_no AS doc_id, {_CHUNK_TOKENS} AS tokens FROM c), cf AS (SELECT repo, doc_id, term, count(*) AS tf FROM (SELECT repo, doc_id, unnest(tokens) AS term FROM ck) GROUP BY ALL),
  dn AS (SELECT repo, count(*) AS docs FROM c GROUP BY ALL), cd AS (SELECT repo, term, count(*) AS df FROM cf GROUP BY ALL),
  lx AS (SELECT query_id, doc_id, least(6.0, sum(least(1.5, (1 + ln(tf)) * (ln((docs + 1) / (1 + df)) + 1)))) AS lexical, count(*) AS matched FROM qt JOIN cf USING (repo, term) JOIN cd USING (repo, term) JOIN dn USING (repo) GROUP BY ALL),
  qa AS (SELECT query_id, list(DISTINCT term) AS terms FROM qt GROUP BY ALL),
  b0 AS (SELECT query_id, doc_id, coalesce(matched, 0) AS matched, symbol_kind, language, route_path, len(calls) AS calls, terms,
      coalesce(lexical, 0.0) + 16.0 * coalesce(score, 0.0) + least(6.0, 2.5 * len(list_intersect(terms, {S.tok('symbol_name')}))) + least(8.0, 3.0 * len(list_intersect(terms, {S.tok('relpath')}))) + least(5.0, 2.0 * len(list_intersect(terms, {S.tok('route_path')}))) AS s
    FROM (SELECT query_id, doc_id, lexical, matched, score FROM lx FULL JOIN fu USING (query_id, doc_id) WHERE matched IS NOT NULL OR score >= 0.16) JOIN c ON chunk_no = doc_id JOIN qa USING (query_id)),
  cs AS (SELECT query_id, doc_id, matched, round(CASE WHEN symbol_kind IN ('function', 'class', 'route') THEN s + 0.25 ELSE s * 0.38 END
      + CASE WHEN list_contains(terms, language) THEN 10.0 ELSE 0.0 END + CASE WHEN route_path <> '' THEN 0.3 ELSE 0.0 END + 0.08 * least(calls, 6), 5) AS score FROM b0)"""
_ALL = S.with_(S.CHUNKS, S.QUESTIONS, S.EXPANDED, S.VIEW_TOKENS, S.BM25, S.PARTS, _SCORES)
_CAND = f"""tf48 AS (SELECT query_id, relpath, least(2.5, greatest(0.0, score * 0.08)) AS boost FROM {S.ranked('sc', 48, id_='relpath')}),
  un AS (SELECT tf48.query_id, c.chunk_no AS doc_id, greatest(coalesce(cs.score, 0.0), 0.0) + boost + CASE WHEN coalesce(symbol_name, '') = '' THEN CASE WHEN intent IN ('frontend_lookup', 'style_lookup', 'code_lookup') THEN 0.8 ELSE -1.2 END ELSE 0.0 END AS score
      FROM tf48 JOIN pl USING (query_id) JOIN c ON c.repo = pl.repo AND c.relpath = tf48.relpath LEFT JOIN cs ON cs.query_id = tf48.query_id AND cs.doc_id = c.chunk_no WHERE cs.score > 0 OR coalesce(symbol_name, '') = ''
    UNION ALL SELECT x.query_id, doc_id, x.score + coalesce(boost, 0.0) FROM {S.ranked('cs', 72)} x JOIN c ON chunk_no = doc_id LEFT JOIN tf48 ON tf48.query_id = x.query_id AND tf48.relpath = c.relpath),
  mg AS (SELECT query_id, doc_id, round(max(score), 5) AS score FROM un GROUP BY ALL), cn AS (SELECT * FROM {S.ranked('mg', 48)})"""
_CANDS = S.with_(S.CHUNKS, S.QUESTIONS, S.EXPANDED, S.VIEW_TOKENS, S.BM25, S.PARTS, _SCORES, _QX, _PLAN, _FILES, _CAND).rstrip()
_SAME = "MAP {" + ", ".join(f"'{k}': {list(v)!r}" for k, v in RR.SAME_ACTIONS.items()) + "}"
_STRIP = lambda x: f"CASE WHEN rtrim({x}, '/') = '' THEN '/' ELSE rtrim({x}, '/') END"
_MATCH = lambda r, l: f"({_STRIP(r)} = {_STRIP(l)} OR (contains({r}, ':') AND regexp_full_match({_STRIP(l)}, regexp_replace({_STRIP(r)}, ':[A-Za-z_][A-Za-z0-9_]*', '[^/]+', 'g'))))"
_EXCL = "(" + " OR ".join([*(f"((contains(low, 'not the {w}') OR contains(low, 'not {w}') OR ({RR.says(*RR.CONTRASTS)} AND contains(low, '{w}'))) AND contains(label, '{w}'))" for w in RR.EXCLUDED), *(f"(contains(low, '{m}') AND list_has_any(placed, list_filter({S.tok(f'substring(low, strpos(low, {m!r}) + {len(m)})')}, lambda x: NOT list_contains({list(RR.NO_CONTRAST)!r}, x))))" for m in RR.CONTRASTS)]) + ")"
_RERANK = f"""pa AS (SELECT *, list_distinct(own || flatten(list_transform(own, lambda a: coalesce(({_SAME})[a], [])))) AS wanted, CASE WHEN first = '' THEN [] ELSE [first] || coalesce(({_SAME})[first], []) END AS prim FROM
    (SELECT *, list_intersect(toks, {list(RR.ACTIONS)!r}) || CASE WHEN list_contains(toks, 'handler') THEN ['handle'] ELSE [] END || CASE WHEN list_contains(toks, 'retrieval') THEN ['retrieve'] ELSE [] END AS own, coalesce(list_filter(toks, lambda t: list_contains({list(RR.ACTIONS)!r}, t))[1], '') AS first FROM pl)),
  fr2 AS (SELECT repo, relpath, max(roles) AS fr FROM (SELECT {S.repo('repo_root')} AS repo, relpath, roles FROM file_facts) GROUP BY ALL),
  ft AS (SELECT cn.query_id, cn.doc_id, c.relpath, coalesce(c.start_line, 0) AS start_line, low, intent, target, coalesce(c.language, '') AS language, coalesce(c.symbol_kind, '') AS kind, coalesce(c.symbol_name, '') AS symbol, cn.score AS base, coalesce(boost, 0.0) AS boost, routed,
      len(list_filter(literals, lambda l: coalesce(c.route_path, '') <> '' AND {_MATCH("coalesce(c.route_path, '')", 'l')})) > 0 AS reachable, len(list_filter(literals, lambda l: {_MATCH("coalesce(c.route_path, '')", 'l')})) = 0 AS off_route,
      coalesce(list_has_any(fr, pa.roles), false) AS roles_match, list_contains(languages, coalesce(c.language, '')) AS language_match, coalesce(list_contains(fr, 'frontend_logic'), false) AS logic, coalesce(list_contains(fr, 'page_shell'), false) AS shell, coalesce(list_contains(fr, 'config'), false) AS config_file, coalesce(list_contains(fr, 'tests'), false) AS test_file, coalesce(list_contains(fr, 'docs'), false) AS doc_file,
      list_intersect({S.tok('c.symbol_name')}, wanted) AS acted, prim, first, len(list_intersect({S.tok("array_to_string(c.calls, ' ')")}, qa.terms)) AS calls_match, list_contains(toks, 'call') AS asks_call, lower(c.relpath || CASE WHEN coalesce(c.symbol_name, '') <> '' THEN ':' || c.symbol_name ELSE '' END) AS label, {S.tok("concat_ws(' ', coalesce(c.symbol_name, ''), coalesce(c.route_path, ''), c.relpath)")} AS placed
    FROM cn JOIN pa USING (query_id) JOIN qa USING (query_id) JOIN c ON c.chunk_no = cn.doc_id LEFT JOIN fr2 ON fr2.repo = pa.repo AND fr2.relpath = c.relpath LEFT JOIN tf48 ON tf48.query_id = cn.query_id AND tf48.relpath = c.relpath),
  fx AS (SELECT *, len(acted) AS acts, list_has_any(acted, prim) AS primary_same, list_contains(acted, first) AS primary_own, {_EXCL} AS excluded FROM ft),
  rr AS (SELECT query_id, doc_id, relpath, start_line, round({RR.total_sql()}, 5) AS score FROM fx)"""

_GRAPH = ",\n  u AS (SELECT * FROM" + _E.split("u AS (SELECT * FROM", 1)[1] + ', sd0 AS (SELECT query_id AS start, doc_id AS node, score FROM cn WHERE "rank" <= 3 AND doc_id IN (SELECT node FROM u))'


def _ppr_sql(rounds: int) -> str:
    """One level of neighborhood and unrolled rounds, by question."""
    out = [
        f"fe AS (SELECT DISTINCT source, target FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY weight DESC, label DESC, target DESC) AS rn FROM eb) WHERE rn <= {G.FANOUT_PPR})",
        "hd AS (SELECT start, node, 0 AS depth, NULL::BIGINT AS parent FROM sd0 UNION ALL SELECT s.start, f.target, 1, min(f.source) FROM sd0 s JOIN fe f ON f.source = s.node WHERE NOT EXISTS (SELECT 1 FROM sd0 x WHERE x.start = s.start AND x.node = f.target) GROUP BY s.start, f.target)",
        f"cw AS (SELECT source, target, sum(least(4.0::DOUBLE, greatest(0.05::DOUBLE, weight))) AS w FROM eb WHERE source <> target GROUP BY ALL)", "ns AS (SELECT a.start, a.node, target, w FROM hd a JOIN cw ON cw.source = a.node JOIN hd b ON b.start = a.start AND b.node = cw.target)", "mv AS (SELECT start, node, target, w / sum(w) OVER (PARTITION BY start, node) AS p FROM ns)",
        f"sh AS (SELECT start, node, greatest({G.LEAST_SEED}, score) / sum(greatest({G.LEAST_SEED}, score)) OVER (PARTITION BY start) AS share FROM sd0)", "nd AS (SELECT hd.start, hd.node, coalesce(share, 0.0) AS share, EXISTS (SELECT 1 FROM mv WHERE mv.start = hd.start AND mv.node = hd.node) AS moves FROM hd LEFT JOIN sh USING (start, node))", "g0 AS (SELECT start, node, share AS r FROM nd)",
    ]
    for k in range(1, rounds + 1):
        q = f"g{k - 1}"
        out.append(f"""g{k} AS (SELECT nd.start, nd.node, 0.15 * share + 0.85 * coalesce(flow, 0.0) + 0.85 * coalesce(lost, 0.0) * share AS r FROM nd LEFT JOIN (SELECT {q}.start, target AS node, sum(r * p) AS flow FROM {q} JOIN mv ON mv.start = {q}.start AND mv.node = {q}.node GROUP BY ALL) f ON f.start = nd.start AND f.node = nd.node
      LEFT JOIN (SELECT {q}.start, sum(r) AS lost FROM {q} JOIN nd n2 ON n2.start = {q}.start AND n2.node = {q}.node AND NOT n2.moves GROUP BY ALL) l ON l.start = nd.start)""")
    return ", " + ",\n  ".join(out)


ORACLES = {
    "question_ppr": _CANDS + _GRAPH + _ppr_sql(8) + f""" SELECT start AS query_id, node, boost, concat_ws('>', parent::VARCHAR, node::VARCHAR) AS path, rn::INT AS "rank" FROM (SELECT *, row_number() OVER (PARTITION BY start ORDER BY boost DESC, node) AS rn FROM (SELECT hd.start, hd.node, parent, round(r * ({G.BASE_SHARE} + {G.HYBRID_SHARE} * coalesce(fu.score, 0.0)) * {G.BOOST}, 4) AS boost FROM hd JOIN g8 USING (start, node) LEFT JOIN fu ON fu.query_id = hd.start AND fu.doc_id = hd.node)) WHERE rn <= 10""",
    "explored_neighbors": _CANDS + _GRAPH + """, x8 AS (SELECT source, target, weight FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY weight DESC, label DESC, target DESC) AS rn FROM eb) WHERE rn <= 8), h1 AS (SELECT start, target AS node, sum(weight) * 1.9::DOUBLE AS boost, max(weight) AS best FROM sd0 JOIN x8 ON x8.source = sd0.node GROUP BY ALL),
      nf1 AS (SELECT start, node FROM (SELECT *, row_number() OVER (PARTITION BY start ORDER BY best DESC, node) AS i FROM h1 WHERE NOT EXISTS (SELECT 1 FROM sd0 WHERE sd0.start = h1.start AND sd0.node = h1.node)) WHERE i <= 6), h2 AS (SELECT start, target AS node, sum(weight) * 1.15::DOUBLE AS boost FROM nf1 JOIN x8 ON x8.source = nf1.node GROUP BY ALL)
      SELECT start AS query_id, node, round(sum(boost), 4) AS boost FROM (SELECT start, node, boost FROM h1 UNION ALL SELECT start, node, boost FROM h2) GROUP BY ALL""",
    "tokenize_chunks": f"SELECT chunk_no, array_to_string({S.tok('text')}, ' ') AS tokens FROM code_chunks",
    "term_freq": S.with_(S.CHUNKS, S.CONTENT, S.TF) + "SELECT doc_id, term, tf::BIGINT AS tf FROM tf",
    "doc_freq": S.with_(S.CHUNKS, S.CONTENT, S.TF) + "SELECT term, count(*) AS df FROM tf GROUP BY ALL",
    "view_stats": S.with_(S.CHUNKS, S.VIEW_TOKENS, S.TF) + 'SELECT "view", docs, avgdl, vocabulary FROM (SELECT "view", count(*) AS docs, round(avg(len(tokens)), 3) AS avgdl FROM tk GROUP BY ALL) JOIN (SELECT "view", count(DISTINCT term) AS vocabulary FROM tf GROUP BY ALL) USING ("view")',
    "expand_terms": S.with_(S.QUESTIONS) + f"SELECT query_id, array_to_string({S.expand('question')}, ' ') AS terms FROM q",
    "route_literals": S.with_(S.QUESTIONS) + f"SELECT query_id, (pos - 1)::INT AS pos, r[pos] AS route FROM (SELECT query_id, r, unnest(range(1, len(r) + 1)) AS pos FROM (SELECT query_id, {S.routes('question')} AS r FROM q))",
    "bm25_topk": S.with_(S.CHUNKS, S.QUESTIONS, S.TERMS, S.CONTENT, S.BM25) + f"SELECT query_id, doc_id, \"rank\", score FROM {S.ranked('bm', K)}",
    "rrf": _VIEWS + f"SELECT query_id, doc_id, \"rank\", score FROM {S.ranked('(SELECT query_id, doc_id, round(sum(1.0 / (60 + "rank")), 9) AS score FROM pr WHERE "view" IN (' + chr(39) + 'content' + chr(39) + ', ' + chr(39) + 'identifier' + chr(39) + ') GROUP BY ALL)', K)}",
    "multiview_rrf": _VIEWS + f"SELECT query_id, doc_id, \"rank\", score FROM {S.ranked('fu', K)}",
    "view_contributions": _VIEWS + f"SELECT query_id, doc_id, \"view\", round(part, 9) AS part FROM pr JOIN (SELECT query_id, doc_id FROM {S.ranked('fu', 1)}) USING (query_id, doc_id)",
    "dense_topk": f"""WITH p AS (SELECT a.vec_id AS query_id, b.vec_id AS doc_id, round(least(1.0, greatest(0.0, (list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) + 1) / 2)), 6) AS score
      FROM embeddings a JOIN embeddings b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id) SELECT query_id, doc_id, "rank", score FROM {S.ranked('p', K)}""",
    "query_plan": S.with_(S.QUESTIONS, _PLAN) + "SELECT query_id, mode, intent, target, array_to_string(list_sort(roles), ',') AS roles, array_to_string(list_sort(languages), ',') AS languages FROM pl",
    "embedding_inputs": "SELECT chunk_no, sha256(concat_ws(chr(10), relpath, symbol_name, symbol_kind, route_path, left(coalesce(text, ''), 3000))) AS digest FROM code_chunks",
    "relevant_edges": _CANDS + ",\n  u AS (SELECT * FROM" + _E.split("u AS (SELECT * FROM", 1)[1] + ", h5 AS (SELECT query_id, doc_id FROM cn WHERE \"rank\" <= 5) SELECT query_id, source, target, label, rn::INT AS \"rank\" FROM (SELECT e.*, a.query_id, row_number() OVER (PARTITION BY a.query_id ORDER BY weight DESC, source, target, label) AS rn FROM e JOIN h5 a ON a.doc_id = e.source JOIN h5 b ON b.doc_id = e.target AND b.query_id = a.query_id) WHERE rn <= 12",
    "question_evidence": _CANDS + f",\n  {_RERANK}, mr AS (SELECT query_id, doc_id, rn::INT AS \"rank\", score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, relpath, start_line, doc_id) AS rn FROM rr WHERE score > 0) WHERE rn <= {K}), sl AS (SELECT chunk_no, relpath || CASE WHEN symbol_name <> '' THEN ':' || symbol_name ELSE '' END AS label, string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)) AS l FROM c) SELECT query_id, \"rank\", label, score, sha256(coalesce(CASE WHEN len(l) <= 24 THEN array_to_string(l, chr(10)) ELSE array_to_string(l[1:24], chr(10)) || chr(10) || '...' END, '')) AS snippet FROM mr JOIN sl ON chunk_no = doc_id",
    "decoy_audit": _CANDS + ",\n  u AS (SELECT * FROM" + _E.split("u AS (SELECT * FROM", 1)[1] + f", an AS (SELECT DISTINCT query_id, node AS start FROM (SELECT query_id, repo, unnest(literals) AS literal FROM pl) x JOIN u USING (repo) WHERE symbol_kind = 'route' AND route_path <> '' AND {_MATCH('route_path', 'literal')}), rt AS (SELECT DISTINCT start FROM an), {_bfs('e', 'rt', 3, G.FANOUT_ROUTE)}, tp AS (SELECT query_id, doc_id AS top FROM cn WHERE \"rank\" = 1) , hl AS (SELECT cn.query_id, cn.doc_id, cn.\"rank\", relpath || CASE WHEN symbol_name <> '' THEN ':' || symbol_name ELSE '' END AS label FROM cn JOIN c ON chunk_no = doc_id WHERE cn.\"rank\" <= 10), dr AS (SELECT h.*, list_distinct(list_filter([{', '.join(f"CASE WHEN contains(lower(h.label), '{w}') THEN '{r}' END" for w, r in DECOYS)}], lambda x: x IS NOT NULL)) AS roles FROM hl h JOIN hl t ON t.query_id = h.query_id AND t.\"rank\" = 1 AND h.\"rank\" > 1 AND h.label <> t.label) SELECT query_id, doc_id, \"rank\", array_to_string(list_filter(['admin', 'legacy', 'fake/mock', 'documentation/notes'], lambda x: list_contains(roles, x)), ',') AS roles, EXISTS (SELECT 1 FROM an JOIN s3 USING (start) WHERE an.query_id = dr.query_id AND s3.node = dr.doc_id) AS route_anchored FROM dr WHERE len(roles) > 0",
    "proof_nodes": _CANDS + ",\n  u AS (SELECT * FROM" + _E.split("u AS (SELECT * FROM", 1)[1] + f", an AS (SELECT DISTINCT query_id, node AS start FROM (SELECT query_id, repo, unnest(literals) AS literal FROM pl) x JOIN u USING (repo) WHERE symbol_kind = 'route' AND route_path <> '' AND {_MATCH('route_path', 'literal')}), rt AS (SELECT DISTINCT start FROM an), {_bfs('e', 'rt', 3, G.FANOUT_ROUTE)}, tp AS (SELECT query_id, doc_id AS top FROM cn WHERE \"rank\" = 1) , rn AS (SELECT query_id, doc_id AS node, CASE WHEN \"rank\" = 1 THEN 1 ELSE 2 END AS o, CASE WHEN \"rank\" = 1 THEN 'top_hit' ELSE 'candidate' END AS role FROM cn WHERE \"rank\" <= 8 UNION ALL SELECT query_id, node, CASE WHEN dp = 0 THEN 0 ELSE 3 END, CASE WHEN dp = 0 THEN 'route_anchor' ELSE 'route_reachable' END FROM (SELECT query_id, node, min(depth) AS dp FROM an JOIN s3 USING (start) GROUP BY ALL)) SELECT query_id, node, string_agg(role, ',' ORDER BY o) AS roles FROM rn GROUP BY ALL",
    "proof_build": _CANDS + ",\n  u AS (SELECT * FROM" + _E.split("u AS (SELECT * FROM", 1)[1] + f", an AS (SELECT DISTINCT query_id, node AS start FROM (SELECT query_id, repo, unnest(literals) AS literal FROM pl) x JOIN u USING (repo) WHERE symbol_kind = 'route' AND route_path <> '' AND {_MATCH('route_path', 'literal')}), rt AS (SELECT DISTINCT start FROM an), {_bfs('e', 'rt', 3, G.FANOUT_ROUTE)}, tp AS (SELECT query_id, doc_id AS top FROM cn WHERE \"rank\" = 1) SELECT q.query_id, top, (SELECT count(*) FROM an WHERE an.query_id = q.query_id) AS anchors, CASE WHEN NOT EXISTS (SELECT 1 FROM an WHERE an.query_id = q.query_id) THEN 'unanchored' WHEN EXISTS (SELECT 1 FROM an JOIN s3 USING (start) WHERE an.query_id = q.query_id AND s3.node = top) THEN 'proved' ELSE 'partial' END AS status FROM q LEFT JOIN tp USING (query_id)",
    "multiview_rerank": _CANDS + f",\n  {_RERANK} SELECT query_id, doc_id, rn::INT AS \"rank\", score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, relpath, start_line, doc_id) AS rn FROM rr WHERE score > 0) WHERE rn <= {K}",
    "file_scout": S.with_(S.QUESTIONS, _QX, _PLAN, _FILES) + f"SELECT query_id, relpath, \"rank\", score, matched FROM {S.ranked('sc', K, id_='relpath')}",
    "chunk_score": _ALL + f"SELECT query_id, doc_id, \"rank\", score, matched FROM {S.ranked('cs', K)}",
    "candidate_union": _CANDS + " SELECT query_id, count(*) AS candidates, sum(round(score * 100000)::BIGINT)::DOUBLE / 100000.0::DOUBLE AS total, max(score) AS best FROM cn GROUP BY ALL",
}
