"""Point searches over sources, symbols, relations and folders, each for a batch of requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from lodestone.functions.text import label_of

LEAST_TERM, PHRASE = 2, 1.5


def _terms(requests: DataFrame, least: int = 1) -> list[tuple[int, list[str]]]:
    """The requests as literals; they are a caller's own few questions, not a table that grows."""
    out = []
    for r in requests.collect():
        terms = dict.fromkeys(t.strip().lower() for t in r["terms"] or () if t and len(t.strip()) >= least)
        if terms:
            out.append((r["request"], list(terms)))
    return out


def _first(rows: DataFrame, limit: int, by: list[str], *order) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order)).cast("int")).where(F.col("rank") <= limit)


def search_text(files: DataFrame, requests: DataFrame, limit: int) -> DataFrame:
    """request, repo, relpath, line_no, score, rank: the best lines of each repository for each request.

    A line scores the number of its terms of two characters or more, and 1.5 more if one of them is a phrase.  Lines
    without any term are dropped before requests multiply them."""
    asked = _terms(requests, LEAST_TERM)
    if not asked:
        return files.sparkSession.createDataFrame([], "request int, repo string, relpath string, line_no int, score double, rank int")
    lines = files.select("repo", "relpath", F.posexplode(F.split(F.lower("text"), "\n")).alias("pos", "line"))
    any_ = F.lit(False)
    for _, terms in asked:
        for t in terms:
            any_ = any_ | F.col("line").contains(t)
    found = lambda t: F.col("line").contains(t)
    hits = F.array(*(F.struct(F.lit(i).alias("request"), sum((found(t).cast("int") for t in terms), F.lit(0)).alias("n"), F.array_max(F.array(*(found(t) & F.lit(" " in t) for t in terms))).alias("phrase")) for i, terms in asked))
    h = lines.where(any_).select("repo", "relpath", (F.col("pos") + 1).alias("line_no"), F.inline(hits)).where("n > 0")
    h = h.select("request", "repo", "relpath", "line_no", (F.col("n") + F.when(F.col("phrase"), PHRASE).otherwise(0.0)).alias("score"))
    return _first(h, limit, ["request", "repo"], F.col("score").desc(), "relpath", "line_no")


def search_symbols(chunks: DataFrame, requests: DataFrame, limit: int) -> DataFrame:
    """request, repo, chunk_no, matched, rank: symbols whose name, qualified name, route or calls hold most of a request's terms."""
    asked = _terms(requests)
    if not asked:
        return chunks.sparkSession.createDataFrame([], "request int, repo string, chunk_no long, matched int, rank int")
    hay = F.lower(F.concat_ws(" ", "symbol_name", "qualified_name", "route_path", F.array_join("calls", " ")))
    rows = chunks.where("symbol_name <> ''").select("repo", "chunk_no", "relpath", "start_line", hay.alias("hay"))
    hits = F.array(*(F.struct(F.lit(i).alias("request"), sum((F.col("hay").contains(t).cast("int") for t in terms), F.lit(0)).alias("matched")) for i, terms in asked))
    h = rows.select("repo", "chunk_no", "relpath", "start_line", F.inline(hits)).where("matched > 0")
    return _first(h, limit, ["request", "repo"], F.col("matched").desc(), "relpath", "start_line", "chunk_no").select("request", "repo", "chunk_no", "matched", "rank")


def relations(units: DataFrame, edges: DataFrame, asked: DataFrame, limit: int) -> DataFrame:
    """repo, source, target, direction, label, weight, rank: edges out of and into the units that bear an asked (repo, symbol) name, bare or qualified."""
    names = F.array_distinct(F.array(F.lower("symbol_name"), F.lower("qualified_name")))
    u = units.select("repo", "node", F.explode(names).alias("name")).join(asked.select("repo", F.lower(F.trim("symbol")).alias("name")), ["repo", "name"]).where("name <> ''").select("repo", "node").distinct()
    out = edges.join(u.withColumnRenamed("node", "source"), ["repo", "source"]).select("repo", "source", "target", F.lit("out").alias("direction"), "label", "weight")
    into = edges.join(u.withColumnRenamed("node", "target"), ["repo", "target"]).select("repo", F.col("target").alias("source"), F.col("source").alias("target"), F.lit("in").alias("direction"), "label", "weight")
    return _first(out.unionByName(into), limit, ["repo"], F.col("weight").desc(), "target", "source", "label", "direction")


def find_chunk(chunks: DataFrame, asked: DataFrame) -> DataFrame:
    """repo, target, chunk_no, priority of the chunk that each asked (repo, target) names: by its id, its exact label, or its label or symbol in any case; the first in index order of the best kind."""
    label = label_of(F.col("relpath"), F.col("symbol_name"))
    keys = F.array(*(F.struct(F.lit(p).alias("priority"), k.alias("key")) for p, k in ((1, F.col("chunk_id")), (2, label), (3, F.lower(label)), (3, F.lower("symbol_name")))))
    c = chunks.where("repo is not null").select("repo", "chunk_no", F.inline(keys)).where("key <> ''")
    a = asked.select("repo", "target", F.inline(F.array(*(F.struct(F.lit(p).alias("priority"), k.alias("key")) for p, k in ((1, F.col("target")), (2, F.col("target")), (3, F.lower("target")))))))
    found = a.join(c, ["repo", "priority", "key"]).groupBy("repo", "target").agg(F.min(F.struct("priority", "chunk_no")).alias("b"))
    return found.select("repo", "target", "b.chunk_no", "b.priority")


def list_directory(files: DataFrame, folder: str) -> DataFrame:
    """repo, name, folder, rank: the entries right below a folder (empty for the top), folders first, then by name whatever its case."""
    base = folder.strip("/") + "/" if folder.strip("/") else ""
    rest = F.substring("relpath", len(base) + 1, 100_000)
    rows = files.where(F.col("relpath").startswith(base) & F.col("repo").isNotNull()).select("repo", F.substring_index(rest, "/", 1).alias("name"), rest.contains("/").alias("folder")).distinct()
    return rows.withColumn("rank", F.row_number().over(W.partitionBy("repo").orderBy(~F.col("folder"), F.lower("name"), "name")).cast("int"))


def read_lines(files: DataFrame, start: int, end: int) -> DataFrame:
    """repo, relpath, start_line, end_line, line_count, content of a range of every file; an empty file is one empty line."""
    lines = F.when(F.col("text") == "", F.array(F.lit(""))).otherwise(F.split(F.regexp_replace("text", r"\r?\n\z", ""), "\r?\n"))
    n = F.size(lines)
    first = F.lit(max(1, start))
    last = F.least(F.greatest(first, F.lit(end)), n)
    return files.select("repo", "relpath", first.alias("start_line"), last.alias("end_line"), n.alias("line_count"), F.trim(F.array_join(F.slice(lines, first, F.greatest(last - first + 1, F.lit(0))), "\n")).alias("content"))
