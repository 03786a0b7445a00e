"""Fragments of the comparison SQL (DuckDB dialect)."""

from __future__ import annotations

from lodestone.functions.text import ROUTE, TOKEN, expansions
from lodestone.operators.index import B, K1, VIEWS


def tok(x: str) -> str:
    raw = rf"regexp_extract_all(lower(regexp_replace(translate(coalesce({x}, ''), '-/', '_ '), '([a-z0-9])([A-Z])', '\1_\2', 'g')), '{TOKEN}')"
    return f"""flatten(list_transform({raw}, lambda t: [t]
      || CASE WHEN regexp_full_match(t, '[一-鿿]+') THEN list_transform(range(1, length(t)), lambda i: substring(t, i, 2)) ELSE [] END
      || CASE WHEN contains(t, '_') THEN list_filter(string_split(t, '_'), lambda p: p <> '') ELSE [] END
      || CASE WHEN length(t) > 4 AND t LIKE '%ies' THEN [left(t, length(t) - 3) || 'y'] WHEN length(t) > 3 AND t LIKE '%s' THEN [left(t, length(t) - 1)] ELSE [] END
      || CASE WHEN length(t) > 5 AND t LIKE '%ing' THEN [left(t, length(t) - 3)] ELSE [] END))"""


def distinct(x: str) -> str:
    """Ordered distinct of a list."""
    return f"list_transform(list_filter(list_transform({x}, lambda v, i: {{'v': v, 'i': i}}), lambda s: list_position({x}, s.v) = s.i), lambda s: s.v)"


def repo(x: str) -> str:
    s = rf"lower(trim(regexp_replace(regexp_replace({x}, '[\s ]+', ' ', 'g'), '\\', '/', 'g')))"
    s = rf"regexp_replace({s}, '[?#].*$', '', 'g')"
    s = rf"regexp_replace({s}, '^(?:[a-z+]+://)(?:[^/@]*@)?[^/]+/|^[\w.\-]+@[^:/]+:/?', '')"
    s = rf"regexp_replace({s}, '/+(?:-/)?(?:tree|blob|commit|commits|pull|issues|releases|wiki)(?:/.*)?$', '')"
    s = rf"regexp_replace(regexp_replace({s}, '/+$', ''), '\.git$', '')"
    key = rf"regexp_extract({s}, '(?:^|/)([^/\s]+/+[^/\s]+)$', 1)"
    return f"CASE WHEN {s} = '' THEN NULL WHEN {key} <> '' THEN regexp_replace({key}, '/+', '/', 'g') ELSE {s} END"


def routes(x: str) -> str:
    found = f"list_filter(list_transform(regexp_extract_all(coalesce({x}, ''), '{ROUTE}'), lambda r: rtrim(r, '.,;:?!)]}}''\"')), lambda r: r <> '')"
    return distinct(found)


def expand(x: str) -> str:
    raw = f"coalesce({x}, '')"
    parts = [tok(x)]
    for triggers, terms, exact in expansions():
        hit = " OR ".join(f"contains({raw if exact else f'lower({raw})'}, {t!r})" for t in triggers)
        parts.append(f"CASE WHEN {hit} THEN [{', '.join(map(repr, terms))}] ELSE [] END")
    return distinct("(" + " || ".join(parts) + ")")


CHUNKS = f"c AS (SELECT *, {repo('repo_root')} AS repo FROM code_chunks)"
QUESTIONS = f"q AS (SELECT * FROM (SELECT case_no AS query_id, {repo('repo')} AS repo, question FROM benchmark_challenge_suite) WHERE repo IS NOT NULL AND question IS NOT NULL)"
TERMS = f"qt AS (SELECT query_id, repo, unnest(list_distinct({tok('question')})) AS term FROM q)"
EXPANDED = f"qt AS (SELECT query_id, repo, unnest({expand('question')}) AS term FROM q)"
ROLES = "fr AS (SELECT repo_root, relpath, max(array_to_string(roles, ' ')) AS roles FROM file_facts GROUP BY ALL)"
CONTENT = f"tk AS (SELECT repo, chunk_no AS doc_id, 'content' AS \"view\", {tok('text')} AS tokens FROM c)"
_BODIES = """SELECT c.repo, chunk_no AS doc_id, unnest([
    {'view': 'content', 'body': text},
    {'view': 'identifier', 'body': concat_ws(' ', symbol_name, qualified_name, array_to_string(handler_names, ' '), array_to_string(calls, ' '))},
    {'view': 'path', 'body': concat_ws(' ', relpath, language, symbol_kind)},
    {'view': 'structure', 'body': concat_ws(' ', route_path, array_to_string(imports, ' '), array_to_string(calls, ' '), array_to_string(refs, ' '), array_to_string(inherits, ' '), fr.roles)}]) AS b
  FROM c LEFT JOIN fr USING (repo_root, relpath)"""
VIEW_TOKENS = f"{ROLES}, tk AS (SELECT repo, doc_id, b.\"view\" AS \"view\", {tok('b.body')} AS tokens FROM ({_BODIES}))"
TF = "tf AS (SELECT repo, \"view\", doc_id, dl, term, count(*)::INT AS tf FROM (SELECT repo, \"view\", doc_id, len(tokens) AS dl, unnest(tokens) AS term FROM tk) GROUP BY ALL)"
WEIGHT = "CASE \"view\" " + " ".join(f"WHEN '{v}' THEN {w}" for v, w in VIEWS.items()) + " ELSE 0.0 END"
BM25 = f"""{TF},
  st AS (SELECT repo, "view", count(*) AS docs, avg(len(tokens)) AS avgdl FROM tk GROUP BY ALL),
  dfr AS (SELECT repo, "view", term, count(*) AS df FROM tf GROUP BY ALL),
  po AS (SELECT tf.repo, tf."view", tf.term, doc_id, ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * {K1 + 1} / (tf + {K1} * (1 - {B} + {B} * dl / greatest(avgdl, 1.0))) AS w
         FROM tf JOIN dfr ON tf.repo IS NOT DISTINCT FROM dfr.repo AND tf."view" = dfr."view" AND tf.term = dfr.term JOIN st ON st.repo = tf.repo AND st."view" = tf."view"),
  raw AS (SELECT query_id, "view", doc_id, sum(w) AS raw FROM qt JOIN po USING (repo, term) GROUP BY ALL),
  bm AS (SELECT * FROM (SELECT query_id, "view", doc_id, round(raw / max(raw) OVER (PARTITION BY query_id, "view"), 6) AS score FROM raw) WHERE score > 0)"""
PARTS = f"""pr AS (SELECT *, {WEIGHT} / (30 + "rank") AS part FROM (SELECT *, row_number() OVER (PARTITION BY query_id, "view" ORDER BY score DESC, doc_id) AS "rank" FROM bm)),
  ce AS (SELECT query_id, sum({WEIGHT}) / 31 AS ceiling FROM (SELECT DISTINCT query_id, "view" FROM pr) GROUP BY ALL),
  fu AS (SELECT query_id, doc_id, round(least(1.0, s / ceiling), 6) AS score FROM (SELECT query_id, doc_id, sum(part) AS s FROM pr GROUP BY ALL) JOIN ce USING (query_id))"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n  ".join(ctes) + "\n"


def ranked(source: str, k: int, by: str = "query_id", id_: str = "doc_id") -> str:
    return f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY score DESC, {id_})::INT AS \"rank\" FROM {source}) WHERE \"rank\" <= {k})"
