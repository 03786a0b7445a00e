"""Inverted-index tables: term frequencies, document frequencies, lengths and statistics, per repository and view."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lodestone.functions.text import expand_query, tokenize

VIEWS = {"content": 1.0, "identifier": 1.8, "path": 1.1, "structure": 1.25}
K1, B = 1.5, 0.75
LISTS = ("imports", "calls", "refs", "inherits", "handler_names")


def _joined(*cols: str):
    return F.concat_ws(" ", *cols)


def roles_by_file(facts: DataFrame) -> DataFrame:
    """One roles text per file: the greatest of its rows, whatever their number or order."""
    return facts.groupBy("repo_root", "relpath").agg(F.max(F.array_join("roles", " ")).alias("roles"))


def content_tokens(chunks: DataFrame) -> DataFrame:
    return chunks.select("repo", F.col("chunk_no").alias("doc_id"), F.lit("content").alias("view"), tokenize(F.col("text")).alias("tokens"))


def chunk_tokens(chunks: DataFrame) -> DataFrame:
    """repo, doc_id, view, tokens of everything a chunk says: text, stored tokens, route, imports, calls, references, bases, qualified name and handlers."""
    parts = [tokenize(F.col("text")), F.coalesce("metadata_tokens", F.array().cast("array<string>")), tokenize(F.col("route_path")), *(tokenize(F.array_join(c, " ")) for c in ("imports", "calls", "refs", "inherits")), tokenize(F.col("qualified_name")), tokenize(F.array_join("handler_names", " "))]
    return chunks.select("repo", F.col("chunk_no").alias("doc_id"), F.lit("chunk").alias("view"), F.concat(*parts).alias("tokens"))


def view_tokens(chunks: DataFrame, facts: DataFrame) -> DataFrame:
    """repo, doc_id, view, tokens of the four views from one scan of the chunks."""
    withroles = chunks.join(roles_by_file(facts), ["repo_root", "relpath"], "left")
    texts = F.array(
        F.struct(F.lit("content").alias("view"), F.col("text").alias("body")),
        F.struct(F.lit("identifier").alias("view"), _joined("symbol_name", "qualified_name", F.array_join("handler_names", " "), F.array_join("calls", " ")).alias("body")),
        F.struct(F.lit("path").alias("view"), _joined("relpath", "language", "symbol_kind").alias("body")),
        F.struct(F.lit("structure").alias("view"), _joined("route_path", F.array_join("imports", " "), F.array_join("calls", " "), F.array_join("refs", " "), F.array_join("inherits", " "), "roles").alias("body")),
    )
    return withroles.select("repo", F.col("chunk_no").alias("doc_id"), F.inline(texts)).select("repo", "doc_id", "view", tokenize(F.col("body")).alias("tokens"))


#: Of ``chunk_texts``, the columns of text and those of tokens: views, what a chunk says in all, and what overlaps.
VIEW_TEXTS = {"content": (("said",), ()), "identifier": (("identifier",), ()), "path": (("path",), ())}
ALL_TEXTS = VIEW_TEXTS | {"chunk": (("said", "rest"), ("stored",)), "symbol": (("symbol_name",), ()), "relpath": (("relpath",), ()), "route": (("route_path",), ()), "language": ((), ("spoken",))}


def chunk_texts(chunks: DataFrame, facts: DataFrame, spec: dict) -> list[tuple[DataFrame, dict]]:
    """Sources of ``blocks.ranked_blocks``, one row per chunk: the texts of the spec's views, and that of the structure, which alone is joined with the files' roles, so that no text crosses a shuffle."""
    of = lambda *names: _joined(*(F.array_join(c, " ") if c in LISTS else c for c in names))
    doc = ("repo", F.col("chunk_no").alias("doc_id"))
    texts = chunks.select(
        *doc, F.col("text").alias("said"), of("symbol_name", "qualified_name", "handler_names", "calls").alias("identifier"), of("relpath", "language", "symbol_kind").alias("path"),
        of("route_path", "imports", "calls", "refs", "inherits", "qualified_name", "handler_names").alias("rest"), F.col("metadata_tokens").alias("stored"), "symbol_name", "relpath", "route_path", F.array("language").alias("spoken"),
    )
    placed = chunks.select("repo_root", "relpath", "repo", "chunk_no", of("route_path", "imports", "calls", "refs", "inherits").alias("own")).join(roles_by_file(facts), ["repo_root", "relpath"], "left")
    return [(texts, spec), (placed.select(*doc, _joined("own", "roles").alias("structure")), {"structure": (("structure",), ())})]


def counted(tokens: Column) -> Column:
    """array<struct<term, tf>> of the distinct tokens, by runs of the sorted array: n log n inside the row, no shuffle."""
    bound = lambda value, then: F.transform(F.array(value), then)[0]  # noqa: E731 - evaluates the value once
    begins = lambda s: F.filter(F.sequence(F.lit(1), F.size(s)), lambda i: (i == 1) | (F.get(s, i - 1) != F.get(s, i - 2)))
    ends = lambda s, b: F.concat(F.slice(b, 2, F.size(b)), F.array(F.size(s) + 1))
    runs = lambda s, b: F.zip_with(b, ends(s, b), lambda x, y: F.struct(F.get(s, x - 1).alias("term"), (y - x).alias("tf")))
    return bound(F.array_sort(tokens), lambda s: bound(begins(s), lambda b: runs(s, b)))


def term_frequencies(tokens: DataFrame) -> DataFrame:
    """repo, view, doc_id, dl, term, tf: distinct terms of each document, counted inside its own row without a shuffle."""
    sorted_ = tokens.select("repo", "view", "doc_id", F.size("tokens").alias("dl"), "tokens").where("dl > 0")
    return sorted_.select("repo", "view", "doc_id", "dl", F.inline(counted(F.col("tokens"))))


def view_stats(tokens: DataFrame) -> DataFrame:
    """repo, view, docs, avgdl over all documents, empty ones included."""
    return tokens.groupBy("repo", "view").agg(F.count("*").alias("docs"), F.avg(F.size("tokens")).alias("avgdl"))


def query_terms(questions: DataFrame, expand: bool = False) -> DataFrame:
    """query_id, repo, term: distinct terms of each question."""
    terms = expand_query(F.col("question")) if expand else F.array_distinct(tokenize(F.col("question")))
    return questions.select("query_id", "repo", F.explode(terms).alias("term"))
