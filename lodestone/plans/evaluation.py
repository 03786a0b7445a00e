"""Evaluation queries: BM25, fused views and their ablations on the suite's questions.

A chunk's grade for a question is the number of the question's verb and noun that its symbol name holds; the suite's
own expected paths name files outside these tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from lodestone.functions import text as T
from lodestone.operators import blocks as BL, evaluate as E, index as I
from lodestone.operators.lineage import checkpointed
from lodestone.sources.tables import chunks, questions, table

from . import retrieval, sql as S

VARIANTS = {"content": ("content",), "identifier": ("content", "identifier"), "structure": ("content", "structure"), "multiview": ("content", "identifier", "path", "structure")}


_ASKED = r"(?i)which function (\w+?)s the ([a-z_]+)"


def _judged(spark, d) -> DataFrame:
    """query_id, repo, term: each question's verb and noun."""
    words = F.array(F.lower(F.regexp_extract("question", _ASKED, 1)), F.lower(F.regexp_extract("question", _ASKED, 2)))
    return questions(spark, d).select("query_id", "repo", F.explode(F.array_distinct(words)).alias("term")).where("term <> ''")


def qrels(spark, d) -> DataFrame:
    """Grade = how many of the question's verb and noun a symbol's name holds, in the question's repository."""
    asked = _judged(spark, d)
    named = chunks(spark, d).where("symbol_name <> ''").select("repo", F.col("chunk_no").alias("doc_id"), F.explode(F.array_distinct(T.tokenize(F.col("symbol_name")))).alias("term"))
    return asked.join(named, ["repo", "term"]).groupBy("query_id", "doc_id").agg(F.count("*").cast("int").alias("relevance"))


def rankings(spark, d, depth: int = 100) -> DataFrame:
    """method, query_id, doc_id, rank: every variant's fusion from one pass over the view scores."""
    return retrieval._blocked(spark, d, BL.variant_tops(VARIANTS, depth), "method string, query_id long, doc_id long, rank int")


_FOUND = "method string, query_id long, first int, dcg double, found long, precision double, idcg double, relevant long"


def _cases(spark, d):
    """Metrics of every judged question, found where its rankings are, so that neither these nor its grades are rows; written once, as most queries read them twice."""
    sources = I.chunk_texts(chunks(spark, d), table(spark, d, "file_facts"), I.VIEW_TEXTS | {"symbol": (("symbol_name",), ())})
    found = BL.ranked_blocks(sources, I.query_terms(questions(spark, d)), BL.variant_cases(VARIANTS, 100), _FOUND, judged=_judged(spark, d))
    return E.measures(checkpointed(found))


def eval_qrels(spark, d):
    return qrels(spark, d)


def eval_per_query(spark, d):
    return _cases(spark, d)


def eval_by_method(spark, d):
    return E.by_method(_cases(spark, d))


def eval_by_repo(spark, d):
    return E.by_method(_cases(spark, d).join(questions(spark, d).select("query_id", "repo"), "query_id"), "repo")


def ablation_variants(spark, d):
    """Each variant's loss against all views together."""
    m = E.by_method(_cases(spark, d))
    full = m.where("method = 'multiview'").select(F.col("ndcg10").alias("full_ndcg"), F.col("mrr").alias("full_mrr"))
    return m.join(F.broadcast(full)).select("method", "queries", F.round(F.col("ndcg10") - F.col("full_ndcg"), 5).alias("ndcg_change"), F.round(F.col("mrr") - F.col("full_mrr"), 5).alias("mrr_change"))


def paired_deltas(spark, d):
    return E.paired(_cases(spark, d), "content")


def bootstrap_ci(spark, d):
    return E.bootstrap(_cases(spark, d), "content")


def _splits(spark, d):
    return E.repository_splits(questions(spark, d))


def split_assign(spark, d):
    return _splits(spark, d)


def split_summary(spark, d):
    s = questions(spark, d).join(_splits(spark, d), "repo")
    return s.groupBy("split").agg(F.count("*").alias("cases"), F.count_distinct("repo").alias("repos"))


def split_audit(spark, d):
    """Checks of a split: enough cases and repositories, no repository in two splits, no empty split."""
    s = questions(spark, d).join(_splits(spark, d), "repo")
    by = s.groupBy("repo").agg(F.count_distinct("split").alias("k"), F.count("*").alias("n"), F.min("split").alias("split"))
    a = by.agg(F.sum("n").alias("cases"), F.count("*").alias("repos"), F.count_if(F.col("k") > 1).alias("shared"), F.count_distinct("split").alias("splits"))
    checks = F.array(*(F.struct(F.lit(n).alias("check"), c.alias("passed")) for n, c in (("enough_cases", F.col("cases") >= 200), ("enough_repositories", F.col("repos") >= 20), ("disjoint", F.col("shared") == 0), ("non_empty", F.col("splits") == 3))))
    return a.select(F.inline(checks))


def suite_audit(spark, d):
    """Metrics and defects of each suite."""
    s = table(spark, d, "benchmark_challenge_suite")
    key = F.lower(F.trim("id"))
    ids = s.where(key != "").groupBy("suite_id", key.alias("k")).agg(F.count("*").alias("n")).where("n > 1").groupBy("suite_id").agg(F.count("*").alias("repeated_ids"))
    m = s.groupBy("suite_id").agg(F.count("*").alias("cases"), F.count_if(F.col("expected_path").isNull()).alias("no_path"), F.count_if(F.array_contains("tags", "hard-negative")).alias("hard_negatives"), F.count_if(F.size("distractor_symbol_contains") == 0).alias("no_distractor"), F.count_if(F.coalesce(F.trim("repo"), F.lit("")) == "").alias("no_repo"))
    return m.join(ids, "suite_id", "left").withColumn("repeated_ids", F.coalesce("repeated_ids", F.lit(0).cast("long")))


def suite_metrics(spark, d):
    """Size and diversity of each suite."""
    s = table(spark, d, "benchmark_challenge_suite")
    tag = lambda t: F.count_if(F.array_contains("tags", t))
    m = s.groupBy("suite_id").agg(F.count("*").alias("cases"), F.count_distinct(T.repository_key(F.col("repo"))).alias("repos"), F.count_if(F.trim("expected_symbol_contains") != "").alias("expected_symbols"), F.sum(F.size("distractor_symbol_contains")).alias("distractors"), tag("self-hosted").alias("self_hosted"), tag("route-grounded").alias("route_grounded"), tag("hard-negative").alias("hard_negatives"))
    t = s.select("suite_id", F.explode("tags").alias("tag")).groupBy("suite_id").agg(F.count_distinct("tag").alias("tags"))
    return m.join(t, "suite_id", "left").fillna(0, ["tags"])


def case_checks(spark, d):
    """Per suite and check: how many cases it concerns and how many fail it."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    s = table(spark, d, "benchmark_challenge_suite").select("case_no", "suite_id", "id", "question", "tags", T.repository_key(F.col("repo")).alias("repo"), F.trim("expected_path").alias("expected_path"), F.lower(F.trim("expected_symbol_contains")).alias("symbol"), F.filter(F.transform("distractor_symbol_contains", lambda x: F.lower(F.trim(x))), lambda x: x != "").alias("wrong"))
    f = table(spark, d, "file_facts").select(T.repository_key(F.col("repo_root")).alias("repo"), F.col("relpath").alias("expected_path"))
    names = chunks(spark, d).where("repo is not null and symbol_name <> ''").select("repo", F.lower("symbol_name").alias("name")).distinct()
    asked = s.where("repo is not null").select("repo", F.explode("wrong").alias("needle")).distinct()
    held = asked.join(names, "repo").where(F.col("name").contains(F.col("needle"))).select("repo", "needle").distinct()
    open_ = s.select("case_no", "repo", F.explode("wrong").alias("needle")).join(held.withColumn("held", F.lit(True)), ["repo", "needle"], "left").groupBy("case_no").agg(F.count_if(F.col("held").isNull()).alias("unresolved"))
    j = s.join(f.select("repo").distinct().withColumn("known", F.lit(True)), "repo", "left").join(f.distinct().withColumn("there", F.lit(True)), ["repo", "expected_path"], "left").join(open_, "case_no", "left")
    some = F.size("wrong") > 0
    checks = F.array(*(F.struct(F.lit(n).alias("check"), c.alias("failed")) for n, c in (
        ("id_present", blank("id")), ("repo_exists", F.col("known").isNull()), ("expected_path_exists", F.col("there").isNull()), ("question_present", blank("question")), ("tags_present", F.size("tags") == 0),
        ("distractors_resolve", F.when(some, F.coalesce("unresolved", F.lit(0)) > 0)), ("distractors_distinct", F.when(some, F.coalesce(F.array_contains("wrong", F.col("symbol")), F.lit(False)))),
    )))
    return j.select("suite_id", F.inline(checks)).where("failed is not null").groupBy("suite_id", "check").agg(F.count("*").alias("cases"), F.count_if("failed").alias("failed"))


def group_by_repo_and_tag(spark, d):
    """Cases by repository, by tag, and in all, from one pass."""
    q = questions(spark, d).select("query_id", "repo")
    t = table(spark, d, "benchmark_challenge_suite").select(F.col("case_no").alias("query_id"), F.explode_outer(F.array_distinct("tags")).alias("tag"))
    return q.join(t, "query_id").groupingSets([["repo"], ["tag"], []], "repo", "tag").agg(F.count_distinct("query_id").alias("cases"))


def suite_digest(spark, d):
    """Digest of each suite's frozen cases: canonical JSON of each, sorted by id; independent of row order."""
    s = table(spark, d, "benchmark_challenge_suite")
    doc = T.canonical_json(**{c: F.col(c) for c in ("expected_path", "expected_symbol_contains", "id", "question", "repo")})
    cases = F.transform(F.array_sort(F.collect_list(F.struct(F.coalesce("id", F.lit("")).alias("id"), doc.alias("doc")))), lambda x: x["doc"])  # a suite holds up to 260 cases
    return s.groupBy("suite_id").agg(F.count("*").alias("cases"), F.sha2(F.concat(F.lit("["), F.array_join(cases, ","), F.lit("]")), 256).alias("digest"))


def suite_verify(spark, d):
    """Each suite's digest now against that of its cases before the last day on which any were added: whether it was changed since."""
    s = table(spark, d, "benchmark_challenge_suite")
    day = s.groupBy("suite_id").agg(F.max(F.to_date("added_at")).alias("last"))
    doc = T.canonical_json(**{c: F.col(c) for c in ("id", "question", "repo")})
    old = s.join(day, "suite_id").withColumn("doc", doc).withColumn("early", F.to_date("added_at") < F.col("last"))
    digest = lambda cond: F.sha2(F.array_join(F.array_sort(F.collect_list(F.when(cond, F.col("doc")))), ","), 256)
    g = old.groupBy("suite_id").agg(digest(F.lit(True)).alias("now"), digest(F.col("early")).alias("frozen"), F.count_if(F.col("early")).alias("frozen_cases"))
    return g.select("suite_id", "frozen_cases", (F.col("now") == F.col("frozen")).alias("unchanged"))


def claim_conflicts(spark, d):
    """Files that more than one run of a repository changed."""
    r = table(spark, d, "engineering_runs").select("repo_root", "run_id", F.explode("changed_files").alias("file"))
    return r.groupBy("repo_root", "file").agg(F.count_distinct("run_id").alias("runs"), F.min("run_id").alias("first_run")).where("runs > 1")


def pareto_front(spark, d):
    """Parts that no other part of their brand and type undercuts in price at an equal or greater size: sizes are few, so
    the running minimum over greater sizes per group replaces a self-join."""
    p = table(spark, d, "part").groupBy("p_brand", "p_type", "p_size").agg(F.min("p_retailprice").alias("price"))
    bigger = W.partitionBy("p_brand", "p_type").orderBy(F.col("p_size").desc()).rowsBetween(W.unboundedPreceding, -1)
    best = p.withColumn("best", F.min("price").over(bigger)).where("best is null or price < best")
    return best.select("p_brand", "p_type", "p_size", F.col("price").alias("p_retailprice"))


def pairwise_interactions(spark, d):
    """Synergy of pairs of tags: cases with both against what the single shares would give."""
    s = table(spark, d, "benchmark_challenge_suite").select("case_no", F.array_sort(F.array_distinct("tags")).alias("tags"))
    pairs = F.flatten(F.transform("tags", lambda a: F.transform(F.filter("tags", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    both = s.select(F.inline(pairs)).groupBy("a", "b").agg(F.count("*").alias("both"))
    one = s.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))
    n = s.agg(F.count("*").alias("cases"))
    j = both.join(one.select(F.col("tag").alias("a"), F.col("n").alias("na")), "a").join(one.select(F.col("tag").alias("b"), F.col("n").alias("nb")), "b").join(F.broadcast(n))
    return j.select("a", "b", "both", F.round(F.col("both") - F.col("na") * F.col("nb") / F.col("cases"), 5).alias("synergy"))


def manifest_verify(spark, d):
    """Stored analyses by whether their recorded digest is that of their text, and if not, why: text without a record, a record without text, or another digest.

    A record may be a digest's leading digits; letter case and a scheme in front do not matter."""
    f = table(spark, d, "file_analysis")
    own = F.sha2(F.col("source_text"), 256)
    kept = F.lower(F.regexp_replace(F.trim("content_digest"), "^[A-Za-z0-9]+:", ""))
    some = F.col("source_text").isNotNull()
    reason = F.when(some & F.coalesce(kept == "", F.lit(True)), "no_record").when(~some & (kept != ""), "no_text").when(some & ~F.startswith(own, kept), "sha256_mismatch")
    return f.groupBy(F.coalesce(reason, F.lit("match")).alias("reason")).agg(F.count("*").alias("files"), F.min("file_no").alias("first_file"))


def repository_sample(spark, d):
    """At most fifty questions, dealt over the repositories in the order of their hash: each takes its share of what is left, at least one, in the order of the questions' hash."""
    q = questions(spark, d)
    by = q.groupBy("repo").agg(F.count("*").alias("n"))
    return E.hash_sample(q, by, 50)


def inferred_repository(spark, d):
    """The one repository whose chunks are judged relevant to a question; questions judged in none or several have none."""
    r = chunks(spark, d).select(F.col("chunk_no").alias("doc_id"), F.col("repo_root"))
    g = qrels(spark, d).join(r, "doc_id").groupBy("query_id").agg(F.count_distinct("repo_root").alias("n"), F.min("repo_root").alias("repo_root"))
    return g.select("query_id", "n", F.when(F.col("n") == 1, F.col("repo_root")).alias("repo_root"))


def needle_audit(spark, d):
    """Cases whose expected symbol no symbol of their repository contains, by name or as a route's name of verb and tail."""
    s = table(spark, d, "benchmark_challenge_suite").select("case_no", T.repository_key(F.col("repo")).alias("repo"), F.lower(F.trim("expected_symbol_contains")).alias("needle")).where("repo is not null and needle <> ''")
    names = chunks(spark, d).where("repo is not null and symbol_name <> ''").select("repo", F.lower("symbol_name").alias("name")).distinct()
    asked = s.select("repo", "needle").distinct()
    held = asked.join(names, "repo").where(F.col("name").contains(F.col("needle"))).select("repo", "needle").distinct()
    return s.join(held.withColumn("found", F.lit(True)), ["repo", "needle"], "left").select("case_no", F.coalesce("found", F.lit(False)).alias("found"))


def counterfactual(spark, d):
    """Per variant: how often the right chunk comes first, and how often a distractor of the case does, over the cases that have distractors."""
    r = rankings(spark, d, 10)
    c = table(spark, d, "benchmark_challenge_suite").select(F.col("case_no").alias("query_id"), F.transform("distractor_symbol_contains", lambda x: F.lower(x)).alias("wrong")).where(F.size("wrong") > 0)
    named = r.join(c, "query_id").join(chunks(spark, d).select(F.col("chunk_no").alias("doc_id"), F.lower(F.coalesce("symbol_name", F.lit(""))).alias("name")), "doc_id")
    wrong = F.exists("wrong", lambda w: (w != "") & F.col("name").contains(w))
    g = named.groupBy("method", "query_id").agg(F.min(F.when(wrong, F.col("rank"))).alias("distractor_rank"))
    return g.groupBy("method").agg(F.count("*").alias("cases"), F.count_if(F.col("distractor_rank") == 1).alias("distractor_top1"), F.round(F.avg((F.coalesce(F.col("distractor_rank"), F.lit(0)) == 1).cast("double")), 5).alias("distractor_rate"))


def diagnose(spark, d):
    """Taxonomy of the multi-view cases: found first, near (second or third), deep, or missed, and the share that would be first if near ones were promoted."""
    c = _cases(spark, d).where("method = 'multiview'")
    label = F.when(F.col("rank") == 1, "first").when(F.col("rank") <= 3, "near").when(F.col("rank").isNotNull(), "deep").otherwise("missed")
    g = c.groupBy(label.alias("label")).agg(F.count("*").alias("cases"))
    n = c.agg(F.count("*").alias("all"), F.round(F.avg((F.coalesce(F.col("rank"), F.lit(999)) <= 3).cast("double")), 5).alias("projected_top1"))
    return g.join(F.broadcast(n)).select("label", "cases", F.round(F.col("cases") / F.col("all"), 5).alias("share"), "projected_top1")


def split_members(spark, d):
    """Cases and repositories of each split with the digest of its sorted case numbers."""
    s = questions(spark, d).join(_splits(spark, d), "repo")
    by = s.select("split", "repo", "query_id", F.sha2(F.col("query_id").cast("string"), 256).alias("h"))
    # an order-free digest: sums of four slices of the hashes, so that no split is collected
    part = lambda i: F.sum(F.conv(F.substring("h", 8 * i + 1, 8), 16, 10).cast("decimal(20,0)")).cast("string").alias(f"s{i}")
    return by.groupBy("split").agg(F.count("*").alias("cases"), F.count_distinct("repo").alias("repos"), F.min("query_id").alias("first_case"), *(part(i) for i in range(2)))


QUERIES = {f.__name__: f for f in (eval_qrels, eval_per_query, eval_by_method, eval_by_repo, ablation_variants, paired_deltas, bootstrap_ci, split_assign, split_summary, split_audit, suite_audit, suite_metrics, case_checks, group_by_repo_and_tag, suite_digest, suite_verify, claim_conflicts, pareto_front, pairwise_interactions, manifest_verify, repository_sample, inferred_repository, needle_audit, counterfactual, diagnose, split_members)}

_MEMBERS = "CASE " + " ".join(f"WHEN method = '{m}' THEN \"view\" IN ({', '.join(map(repr, v))})" for m, v in VARIANTS.items()) + " END"
_CASES = S.with_(S.CHUNKS, S.QUESTIONS, S.TERMS, S.VIEW_TOKENS, S.BM25, S.PARTS).rstrip() + f""",
  qw AS (SELECT DISTINCT query_id, repo, unnest([lower(regexp_extract(question, '{_ASKED}', 1)), lower(regexp_extract(question, '{_ASKED}', 2))]) AS term FROM q),
  sy AS (SELECT DISTINCT repo, chunk_no AS doc_id, unnest({S.tok('symbol_name')}) AS term FROM c WHERE symbol_name <> ''),
  ql AS (SELECT query_id, doc_id, count(*)::INT AS relevance FROM qw JOIN sy USING (repo, term) WHERE term <> '' GROUP BY ALL),
  va AS (SELECT unnest([{', '.join(map(repr, VARIANTS))}]) AS method),
  fv AS (SELECT method, query_id, doc_id, round(sum(part), 9) AS score FROM pr, va WHERE {_MEMBERS} GROUP BY ALL),
  rk AS (SELECT method, query_id, doc_id, "rank" FROM {S.ranked('fv', 100, 'method, query_id')}),
  idl AS (SELECT query_id, sum(CASE WHEN i <= 10 THEN (pow(2.0, relevance) - 1) / log2(i + 1.0) END) AS idcg, count(*) AS relevant FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, doc_id) AS i FROM ql) GROUP BY ALL),
  gt AS (SELECT method, query_id, min("rank") AS f, sum(CASE WHEN "rank" <= 10 THEN (pow(2.0, relevance) - 1) / log2("rank" + 1.0) ELSE 0.0 END) AS dcg, count(*) AS found, sum(seen / "rank") AS prec FROM (SELECT *, row_number() OVER (PARTITION BY method, query_id ORDER BY "rank") AS seen FROM rk JOIN ql USING (query_id, doc_id)) GROUP BY ALL),
  ca AS (SELECT va.method, idl.query_id, f::INT AS "rank", coalesce((f <= 1)::INT, 0) AS hit1, coalesce((f <= 3)::INT, 0) AS hit3, coalesce((f <= 5)::INT, 0) AS hit5, round(coalesce(1.0::DOUBLE / f, 0.0), 9) AS mrr, round(coalesce(dcg / idcg, 0.0), 9) AS ndcg10, round(coalesce(found / relevant, 0.0), 9) AS recall100, round(coalesce(prec / relevant, 0.0), 9) AS map100
    FROM idl, va LEFT JOIN gt ON gt.method = va.method AND gt.query_id = idl.query_id)
"""
_MEANS = "count(*) AS queries, " + ", ".join(f"round(avg({m}), 5) AS {m}" for m in ("hit1", "hit3", "hit5", "mrr", "ndcg10", "recall100", "map100"))
_SPLIT = f"""{S.QUESTIONS}, nm AS (SELECT DISTINCT repo FROM q), rn AS (SELECT repo, row_number() OVER (ORDER BY sha256('{E.SEED}:' || repo)) AS r, count(*) OVER () AS n FROM nm),
  rt AS (SELECT *, greatest(1, round(n * 0.6)) AS tr, greatest(1, round(n * 0.2)) AS dv FROM rn),
  sp AS (SELECT repo, CASE WHEN r <= tr THEN 'train' WHEN r <= tr + CASE WHEN tr + dv >= n THEN greatest(1, n - tr - 1) ELSE dv END THEN 'dev' ELSE 'test' END AS split FROM rt)"""
_SUITE = "benchmark_challenge_suite"


def _JSON(*names: str) -> str:
    return "'{' || " + " || ',' || ".join(f"""'"{n}":' || coalesce(to_json({n}::VARCHAR)::VARCHAR, 'null')""" for n in sorted(names)) + " || '}'"


ORACLES = {
    "eval_qrels": _CASES + "SELECT query_id, doc_id, relevance FROM ql",
    "eval_per_query": _CASES + "SELECT * FROM ca",
    "eval_by_method": _CASES + f"SELECT method, {_MEANS} FROM ca GROUP BY ALL",
    "eval_by_repo": _CASES + f"SELECT method, repo, {_MEANS} FROM ca JOIN (SELECT query_id, repo FROM q) USING (query_id) GROUP BY method, repo",
    "ablation_variants": _CASES + ", bm2 AS (SELECT method, count(*) AS queries, round(avg(ndcg10), 5) AS nd, round(avg(mrr), 5) AS mr FROM ca GROUP BY ALL) SELECT a.method, a.queries, round(a.nd - b.nd, 5) AS ndcg_change, round(a.mr - b.mr, 5) AS mrr_change FROM bm2 a, bm2 b WHERE b.method = 'multiview'",
    "paired_deltas": _CASES + "SELECT a.method, count(*) AS pairs, round(avg(a.ndcg10 - b.ndcg10), 5) AS ndcg_delta, round(avg(a.mrr - b.mrr), 5) AS mrr_delta, count(*) FILTER (a.ndcg10 - b.ndcg10 > 1e-12) AS wins, count(*) FILTER (abs(a.ndcg10 - b.ndcg10) <= 1e-12) AS ties, count(*) FILTER (a.ndcg10 - b.ndcg10 < -1e-12) AS losses FROM ca a JOIN ca b ON a.query_id = b.query_id AND b.method = 'content' WHERE a.method <> 'content' GROUP BY ALL",
    "split_assign": S.with_(_SPLIT) + "SELECT repo, split FROM sp",
    "split_summary": S.with_(_SPLIT) + "SELECT split, count(*) AS cases, count(DISTINCT repo) AS repos FROM q JOIN sp USING (repo) GROUP BY ALL",
    "split_audit": S.with_(_SPLIT) + """, a AS (SELECT count(*) AS cases, count(DISTINCT repo) AS repos, count(DISTINCT split) AS splits FROM q JOIN sp USING (repo)), b AS (SELECT count(*) AS shared FROM (SELECT repo FROM sp GROUP BY repo HAVING count(DISTINCT split) > 1))
      SELECT 'enough_cases' AS "check", cases >= 200 AS passed FROM a UNION ALL SELECT 'enough_repositories', repos >= 20 FROM a UNION ALL SELECT 'disjoint', shared = 0 FROM b UNION ALL SELECT 'non_empty', splits = 3 FROM a""",
    "suite_audit": f"""SELECT suite_id, cases, no_path, hard_negatives, no_distractor, no_repo, coalesce(repeated_ids, 0) AS repeated_ids FROM (SELECT suite_id, count(*) AS cases, count(*) FILTER (expected_path IS NULL) AS no_path, count(*) FILTER (list_contains(tags, 'hard-negative')) AS hard_negatives, count(*) FILTER (len(distractor_symbol_contains) = 0) AS no_distractor, count(*) FILTER (coalesce(trim(repo), '') = '') AS no_repo FROM {_SUITE} GROUP BY ALL)
      LEFT JOIN (SELECT suite_id, count(*) AS repeated_ids FROM (SELECT suite_id, lower(trim(id)) AS k FROM {_SUITE} WHERE trim(id) <> '' GROUP BY ALL HAVING count(*) > 1) GROUP BY ALL) USING (suite_id)""",
    "suite_metrics": f"SELECT suite_id, count(*) AS cases, count(DISTINCT {S.repo('repo')}) AS repos, count(*) FILTER (trim(expected_symbol_contains) <> '') AS expected_symbols, sum(len(distractor_symbol_contains))::BIGINT AS distractors, count(*) FILTER (list_contains(tags, 'self-hosted')) AS self_hosted, count(*) FILTER (list_contains(tags, 'route-grounded')) AS route_grounded, count(*) FILTER (list_contains(tags, 'hard-negative')) AS hard_negatives, count(DISTINCT t) AS tags FROM (SELECT s.*, NULL AS t FROM {_SUITE} s) GROUP BY ALL".replace("count(DISTINCT t) AS tags FROM (SELECT s.*, NULL AS t FROM", "(SELECT count(DISTINCT t) FROM (SELECT suite_id AS i, unnest(tags) AS t FROM benchmark_challenge_suite) WHERE i = suite_id) AS tags FROM (SELECT * FROM"),
    "case_checks": S.with_(S.CHUNKS) + f""", s AS (SELECT case_no, suite_id, id, question, tags, {S.repo('repo')} AS repo, trim(expected_path) AS path, lower(trim(expected_symbol_contains)) AS symbol, list_filter(list_transform(distractor_symbol_contains, lambda x: lower(trim(x))), lambda x: x <> '') AS wrong FROM {_SUITE}), f AS (SELECT DISTINCT {S.repo('repo_root')} AS repo, relpath FROM file_facts),
      w AS (SELECT case_no, count(*) FILTER (NOT EXISTS (SELECT 1 FROM c WHERE c.repo = x.repo AND contains(lower(symbol_name), needle))) AS unresolved FROM (SELECT case_no, repo, unnest(wrong) AS needle FROM s) x GROUP BY case_no),
      k AS (SELECT suite_id, unnest([{{'c': 'id_present', 'f': coalesce(trim(id), '') = ''}}, {{'c': 'repo_exists', 'f': NOT EXISTS (SELECT 1 FROM f WHERE f.repo = s.repo)}}, {{'c': 'expected_path_exists', 'f': NOT EXISTS (SELECT 1 FROM f WHERE f.repo = s.repo AND f.relpath = s.path)}}, {{'c': 'question_present', 'f': coalesce(trim(question), '') = ''}}, {{'c': 'tags_present', 'f': len(tags) = 0}},
        {{'c': 'distractors_resolve', 'f': CASE WHEN len(wrong) > 0 THEN coalesce(unresolved, 0) > 0 END}}, {{'c': 'distractors_distinct', 'f': CASE WHEN len(wrong) > 0 THEN coalesce(list_contains(wrong, symbol), false) END}}]) AS r FROM s LEFT JOIN w USING (case_no))
      SELECT suite_id, r.c AS "check", count(*) AS cases, count(*) FILTER (r.f) AS failed FROM k WHERE r.f IS NOT NULL GROUP BY ALL""",
    "group_by_repo_and_tag": S.with_(S.QUESTIONS) + f"SELECT repo, tag, count(DISTINCT query_id) AS cases FROM (SELECT query_id, q.repo, tag FROM q JOIN (SELECT case_no, unnest(CASE WHEN len(tags) = 0 THEN [NULL] ELSE list_distinct(tags) END) AS tag FROM {_SUITE}) t ON t.case_no = q.query_id) GROUP BY GROUPING SETS ((repo), (tag), ())",
    "suite_digest": f"SELECT suite_id, count(*) AS cases, sha256('[' || string_agg(doc, ',' ORDER BY i, doc) || ']') AS digest FROM (SELECT suite_id, coalesce(id, '') AS i, {_JSON('expected_path', 'expected_symbol_contains', 'id', 'question', 'repo')} AS doc FROM {_SUITE}) GROUP BY ALL",
    "suite_verify": f"SELECT suite_id, count(*) FILTER (early) AS frozen_cases, coalesce(string_agg(doc, ',' ORDER BY doc), '') = coalesce(string_agg(doc, ',' ORDER BY doc) FILTER (early), '') AS unchanged FROM (SELECT suite_id, {_JSON('id', 'question', 'repo')} AS doc, added_at::DATE < max(added_at::DATE) OVER (PARTITION BY suite_id) AS early FROM {_SUITE}) GROUP BY ALL",
    "repository_sample": S.with_(S.QUESTIONS).replace("WITH ", "WITH RECURSIVE ", 1) + ", b AS (SELECT repo, count(*) AS n, row_number() OVER (ORDER BY sha256('17:' || repo)) AS i, count(*) OVER () AS m FROM q GROUP BY repo), " + E.SAMPLE_SQL.format(total=50) + " SELECT query_id, repo FROM (SELECT q.query_id, q.repo, take, row_number() OVER (PARTITION BY q.repo ORDER BY sha256('17:' || q.query_id), q.query_id) AS rn FROM q JOIN tk USING (repo)) WHERE rn <= take",
    "inferred_repository": _CASES + "SELECT query_id, count(DISTINCT repo_root) AS n, CASE WHEN count(DISTINCT repo_root) = 1 THEN min(repo_root) END AS repo_root FROM ql JOIN c ON chunk_no = doc_id GROUP BY query_id",
    "needle_audit": S.with_(S.CHUNKS) + f", s AS (SELECT case_no, {S.repo('repo')} AS repo, lower(trim(expected_symbol_contains)) AS needle FROM {_SUITE}) SELECT case_no, EXISTS (SELECT 1 FROM c WHERE c.repo = s.repo AND contains(lower(symbol_name), needle)) AS found FROM s WHERE repo IS NOT NULL AND needle <> ''",
    "counterfactual": _CASES + f", g AS (SELECT method, query_id, min(CASE WHEN len(list_filter(distractor_symbol_contains, lambda w: w <> '' AND contains(lower(coalesce(symbol_name, '')), lower(w)))) > 0 THEN \"rank\" END) AS dr FROM rk JOIN {_SUITE} ON case_no = query_id JOIN c ON c.chunk_no = doc_id WHERE \"rank\" <= 10 AND len(distractor_symbol_contains) > 0 GROUP BY ALL) SELECT method, count(*) AS cases, count(*) FILTER (dr = 1) AS distractor_top1, round(avg((coalesce(dr, 0) = 1)::INT), 5) AS distractor_rate FROM g GROUP BY ALL",
    "diagnose": _CASES + ", t AS (SELECT CASE WHEN \"rank\" = 1 THEN 'first' WHEN \"rank\" <= 3 THEN 'near' WHEN \"rank\" IS NOT NULL THEN 'deep' ELSE 'missed' END AS label, \"rank\" AS r FROM ca WHERE method = 'multiview') SELECT label, count(*) AS cases, round(count(*) / (SELECT count(*) FROM t), 5) AS share, (SELECT round(avg((coalesce(r, 999) <= 3)::INT), 5) FROM t) AS projected_top1 FROM t GROUP BY label",
    "split_members": S.with_(_SPLIT) + "SELECT split, count(*) AS cases, count(DISTINCT repo) AS repos, min(query_id) AS first_case, sum(('0x' || left(h, 8))::BIGINT)::VARCHAR AS s0, sum(('0x' || substring(h, 9, 8))::BIGINT)::VARCHAR AS s1 FROM (SELECT *, sha256(query_id::VARCHAR) AS h FROM q JOIN sp USING (repo)) GROUP BY split",
    "claim_conflicts": "SELECT repo_root, file, count(DISTINCT run_id) AS runs, min(run_id) AS first_run FROM (SELECT repo_root, run_id, unnest(changed_files) AS file FROM engineering_runs) GROUP BY ALL HAVING count(DISTINCT run_id) > 1",
    "pareto_front": "SELECT DISTINCT p_brand, p_type, p_size, p_retailprice FROM part a WHERE NOT EXISTS (SELECT 1 FROM part b WHERE b.p_brand = a.p_brand AND b.p_type = a.p_type AND b.p_size >= a.p_size AND b.p_retailprice <= a.p_retailprice AND (b.p_size > a.p_size OR b.p_retailprice < a.p_retailprice))",
    "pairwise_interactions": f"WITH s AS (SELECT case_no, list_distinct(tags) AS tags FROM {_SUITE}), o AS (SELECT case_no, unnest(tags) AS tag FROM s), n AS (SELECT tag, count(*) AS n FROM o GROUP BY ALL) SELECT x.a, x.b, x.both, round(x.both - na.n * nb.n / (SELECT count(*) FROM s), 5) AS synergy FROM (SELECT p.tag AS a, r.tag AS b, count(*) AS both FROM o p JOIN o r ON p.case_no = r.case_no AND p.tag < r.tag GROUP BY ALL) x JOIN n na ON na.tag = x.a JOIN n nb ON nb.tag = x.b",
    "manifest_verify": "SELECT coalesce(reason, 'match') AS reason, count(*) AS files, min(file_no) AS first_file FROM (SELECT file_no, CASE WHEN source_text IS NOT NULL AND coalesce(k = '', true) THEN 'no_record' WHEN source_text IS NULL AND k <> '' THEN 'no_text' WHEN source_text IS NOT NULL AND NOT starts_with(sha256(source_text), k) THEN 'sha256_mismatch' END AS reason FROM (SELECT *, lower(regexp_replace(trim(content_digest), '^[A-Za-z0-9]+:', '')) AS k FROM file_analysis)) GROUP BY ALL",
}
