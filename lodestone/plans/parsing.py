"""Extraction queries over stored sources."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from lodestone.functions import text as T
from lodestone.operators import parse as P, search as SE
from lodestone.operators.flatten import flatten_runs, typed_table
from lodestone.operators.lineage import narrowed
from lodestone.sources.tables import chunks, table, tree_signature

from .evidence import _DOCS, _FAILS, _X


def _python(spark, d):
    return table(spark, d, "file_analysis").where(F.lower("relpath").endswith(".py"))


def python_symbols(spark, d):
    return P.python_symbols(_python(spark, d), "file_no", "source_text").select("file_no", "pos", "name", "kind", "start_line", "end_line", F.array_join("calls", ",").alias("calls"), F.array_join("inherits", ",").alias("inherits"), "route_path")


def python_chunks(spark, d):
    return P.symbol_chunks(P.python_symbols(_python(spark, d), "file_no", "source_text"), "file_no").select("file_no", "pos", "name", F.sha2("text", 256).alias("digest"))


def _sources(spark, d):
    return table(spark, d, "file_analysis").withColumn("lang", T.language_of(F.col("relpath")))


def source_symbols(spark, d):
    """Symbols of every source by its path's language, with the number of their calls and the digest of their snippet."""
    return P.symbols(_sources(spark, d), "file_no", "source_text", "lang").select("file_no", "parser_backend", "pos", "name", "kind", "start_line", "end_line", F.size("calls").alias("calls"), "route_path", F.sha2("snippet", 256).alias("digest"))


def js_declarations(spark, d):
    """Functions, classes and arrow constants that JavaScript and TypeScript sources declare, by line."""
    f = _sources(spark, d).where(F.col("lang").isin("javascript", "typescript"))
    return P.symbols(f, "file_no", "source_text", "lang").where("kind <> 'route'").select("file_no", "name", "start_line")


def rewritten_files(spark, d):
    """Paths analysed again with another text: added and removed lines of the unified diff between the two."""
    f = table(spark, d, "file_analysis").where("source_text is not null")
    again = f.groupBy("repo_root", "relpath").agg(F.count("*").alias("n")).where("n > 1")
    few = narrowed(f.select("file_no", "repo_root", "relpath", "source_text"), again, ["repo_root", "relpath"])
    before = F.lag("source_text").over(W.partitionBy("repo_root", "relpath").orderBy("file_no"))
    pair = few.withColumn("before", before).where("before is not null and before <> source_text")
    diff = pair.select("file_no", P.unified_diff(F.col("relpath"), F.col("before"), F.col("source_text")).alias("diff"))
    return P.diff_counts(diff, "file_no", "diff")


def name_similarity(spark, d):
    """Symbols of a file against the next one in it."""
    c = chunks(spark, d).where("symbol_name <> ''").select("chunk_no", "repo_root", "relpath", "symbol_name")
    nxt = c.withColumn("other", F.lead("symbol_name").over(W.partitionBy("repo_root", "relpath").orderBy("chunk_no"))).where("other is not null")
    return P.name_similarity(nxt, "symbol_name", "other").select("chunk_no", "symbol_name", "other", "similarity")


def language_detect(spark, d):
    """Language by suffix against the stored one."""
    f = table(spark, d, "file_analysis").select("file_no", T.language_of(F.col("relpath")).alias("detected"), F.lower("language").alias("stored"))
    return f.select("file_no", "detected", (F.coalesce(F.col("stored") == F.col("detected"), F.lit(False))).alias("agrees"))


def diff_lines(spark, d):
    """Added and removed lines by file of sources that are unified diffs."""
    f = table(spark, d, "file_analysis").where(F.col("source_text").rlike(r"(?m)^\+\+\+ b/")).select("file_no", F.regexp_replace("source_text", "\r\n", "\n").alias("diff"))
    return P.diff_counts(f, "file_no", "diff")


def diff_files(spark, d):
    f = table(spark, d, "file_analysis").where(F.col("source_text").rlike(r"(?m)^\+\+\+ b/"))
    return f.select("file_no", F.posexplode(P.diff_paths(F.regexp_replace("source_text", "\r\n", "\n"))).alias("pos", "path"))


def command_failures(spark, d):
    """Class, files and tests of the failures that commands of runs report."""
    rows = flatten_runs(table(spark, d, "engineering_runs"), ("timeline.details.commands.failures",))
    t = typed_table(rows, "timeline.details.commands.failures", "test", "message")
    log = F.concat_ws(" - ", F.concat(F.lit("FAILED "), F.col("test")), "message")
    return t.select(F.col("record_no").alias("run_no"), "parent_path", "pos", P.failure_type(log).alias("type"), F.array_join(P.referenced_files(log), ",").alias("files"), F.array_join(P.failed_tests(log), ",").alias("tests"))


def read_ranges(spark, d):
    """Lines 5 to 9 of every stored source."""
    f = table(spark, d, "file_analysis").where("source_text is not null").select(F.col("file_no").alias("repo"), "relpath", F.col("source_text").alias("text"))
    return SE.read_lines(f, 5, 9).select(F.col("repo").alias("file_no"), "end_line", "line_count", F.sha2("content", 256).alias("digest"))


def tree_signatures(spark, d):
    """Signature of each repository's stored files."""
    f = table(spark, d, "file_analysis").select("repo_root", "relpath", F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', analyzed_at)").alias("mtime"), F.length(F.coalesce("source_text", F.lit(""))).alias("size"))
    return tree_signature(f, "repo_root")


def overview_chunks(spark, d):
    """File overviews: the first 140 lines of every source."""
    f = table(spark, d, "file_analysis").select("file_no", F.regexp_replace("source_text", "\r\n", "\n").alias("t"))
    return f.select("file_no", F.sha2(F.array_join(F.slice(F.split("t", "\n"), 1, 140), "\n"), 256).alias("digest"))


QUERIES = {f.__name__: f for f in (python_symbols, python_chunks, source_symbols, js_declarations, rewritten_files, name_similarity, language_detect, diff_lines, diff_files, command_failures, read_ranges, tree_signatures, overview_chunks)}

_SUFFIX = "CASE lower(regexp_extract(relpath, '\\.([A-Za-z0-9]+)$', 1)) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in T.LANGUAGE_OF.items()) + " ELSE 'text' END"
_DIFFS = "(SELECT file_no, replace(source_text, chr(13) || chr(10), chr(10)) AS t FROM file_analysis WHERE regexp_matches(source_text, '(?m)^\\+\\+\\+ b/'))"
_JS_SUFFIX = f"{_SUFFIX} IN ('javascript', 'typescript')"
_NAMED = r"^\s*(?:export\s+)?(?:(?:async\s+)?function\s+|class\s+|const\s+)([A-Za-z_][A-Za-z0-9_]*)"
_DECLARES = r"^\s*(?:export\s+)?(?:(?:async\s+)?function\s+[A-Za-z_]|class\s+[A-Za-z_]|const\s+[A-Za-z_][A-Za-z0-9_]*\s*=\s*(?:async\s*)?\()"
_LOW = "lower(log)"
_FILES_IN = "list_distinct(" + " || ".join(f"regexp_extract_all(log, '{p}', 1)" for p in P._FILE_FORMS) + ")"
_ROWS = "string_split(regexp_replace(source_text, '\r?\n$', ''), chr(10))"
ORACLES = {
    "command_failures": f"""WITH {_DOCS}, f AS (SELECT no AS run_no, a || '.' || b AS parent_path, pos::INT AS pos, concat_ws(' - ', 'FAILED ' || {_X('test')}, {_X('message')}) AS log FROM {_FAILS})
      SELECT run_no, parent_path, pos, CASE {' '.join(f"WHEN regexp_matches({_LOW}, '{p}') THEN '{k}'" for p, k in P.FAILURES)} WHEN contains({_LOW}, 'assert') OR contains({_LOW}, 'failed') AND contains({_LOW}, 'pytest') THEN 'test_failure' ELSE 'unknown' END AS type,
        array_to_string({_FILES_IN}, ',') AS files, CASE WHEN starts_with(log, 'FAILED ') OR contains(log, '::') AND (contains({_LOW}, ' failed') OR contains({_LOW}, 'error')) THEN trim(split_part(regexp_replace(log, '^(.*?)FAILED ', '\\1'), ' - ', 1)) ELSE '' END AS tests FROM f""",
    "read_ranges": f"SELECT file_no, least(9, n)::INT AS end_line, n::INT AS line_count, sha256(trim(array_to_string(l[5:least(9, n)], chr(10)))) AS digest FROM (SELECT file_no, list_transform(l, lambda x: regexp_replace(x, '\r$', '')) AS l, len(l) AS n FROM (SELECT file_no, CASE WHEN source_text = '' THEN [''] ELSE {_ROWS} END AS l FROM file_analysis WHERE source_text IS NOT NULL))",
    "tree_signatures": "SELECT repo_root, count(*) AS files, sha256(concat_ws(',', count(*)::VARCHAR, " + ", ".join(f"sum(('0x' || substring(h, {8 * i + 1}, 8))::BIGINT)::VARCHAR" for i in range(8)) + ")) AS signature FROM (SELECT repo_root, sha256(concat_ws('|', relpath, epoch_us(analyzed_at)::VARCHAR, length(coalesce(source_text, ''))::VARCHAR)) AS h FROM file_analysis) GROUP BY repo_root",
    "js_declarations": f"""SELECT DISTINCT file_no, regexp_extract(l, '{_NAMED}', 1) AS name, start_line::INT AS start_line FROM (SELECT file_no, l, coalesce(lag(pos) OVER (PARTITION BY file_no ORDER BY pos) + 1, 1) AS start_line FROM
      (SELECT file_no, unnest(string_split(source_text, chr(10))) AS l, unnest(range(1, len(string_split(source_text, chr(10))) + 1)) AS pos FROM file_analysis WHERE {_JS_SUFFIX}) WHERE regexp_matches(l, '\\S')) WHERE regexp_matches(l, '{_DECLARES}')""",
    "language_detect": f"SELECT file_no, detected, coalesce(lower(language) = detected, false) AS agrees FROM (SELECT file_no, language, {_SUFFIX} AS detected FROM file_analysis)",
    "diff_lines": f"""SELECT file_no, file, count(*) FILTER (starts_with(l, '+') AND NOT starts_with(l, '+++')) AS added, count(*) FILTER (starts_with(l, '-') AND NOT starts_with(l, '---')) AS removed FROM
      (SELECT file_no, l, last_value(CASE WHEN starts_with(l, '+++ b/') THEN trim(substring(l, 7)) END IGNORE NULLS) OVER (PARTITION BY file_no ORDER BY pos) AS file FROM (SELECT file_no, unnest(string_split(t, chr(10))) AS l, unnest(range(1, len(string_split(t, chr(10))) + 1)) AS pos FROM {_DIFFS})) WHERE file IS NOT NULL GROUP BY ALL""",
    "diff_files": f"SELECT file_no, (pos - 1)::INT AS pos, l[pos] AS path FROM (SELECT file_no, l, unnest(range(1, len(l) + 1)) AS pos FROM (SELECT file_no, list_filter(regexp_extract_all(t, '(?m)^\\+\\+\\+\\s+b/(.+)$', 1), lambda x: x <> '/dev/null') AS l FROM {_DIFFS}))",
    "overview_chunks": "SELECT file_no, sha256(array_to_string(string_split(replace(source_text, chr(13) || chr(10), chr(10)), chr(10))[1:140], chr(10))) AS digest FROM file_analysis",
}
