"""Readers: parquet tables, source trees, JSON lines and audit streams, each with only the columns a plan names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from lodestone.functions.text import ignored, language_of, repository_key

MAX_FILE_BYTES = 512 * 1024


#: Most bytes that are dealt anew for balance's sake, as Spark estimates a plan's size.
SPREAD_BYTES = 1 << 30


def spread(df: DataFrame) -> DataFrame:
    """Deals a scan over the cores if its files have fewer row groups than half of them and it holds at most ``SPREAD_BYTES``.

    A larger scan keeps its splits whatever the number of cores, so no large table crosses a shuffle here."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > SPREAD_BYTES:
        return df
    return df.repartition(cores) if df.rdd.getNumPartitions() * 2 < cores else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retrieval units with their repository key; chunk_no is the document id, numeric order breaks ties."""
    return keyed(spread(table(spark, sf_dir, "code_chunks")), table(spark, sf_dir, "code_chunks"))


#: Most roots whose repository keys are sent to every executor; with more, each row's key is found by itself.
FEW_ROOTS = 50_000


def keyed(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """The rows with repo, their repository key, which is found once per root of ``roots``: its patterns cost more than reading a row.

    The count keeps conditions on the key from being tested on every row before the join."""
    one = roots.groupBy("repo_root").agg(F.count("*").alias("n"))
    if one.count() > FEW_ROOTS:
        return rows.withColumn("repo", repository_key(F.col("repo_root")))
    keys = one.select("repo_root", F.when(F.col("n") > 0, repository_key(F.col("repo_root"))).alias("repo"))
    return rows.join(F.broadcast(keys), "repo_root", "left").select(*rows.columns, "repo")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, repo, question of the suite's cases that name a repository."""
    q = table(spark, sf_dir, "benchmark_challenge_suite")
    q = q.select(F.col("case_no").alias("query_id"), F.col("repo").alias("repo_root"), "question")
    return keyed(q, q).select("query_id", "repo", "question").where("repo is not null and question is not null")


def source_tree(spark: SparkSession, root: str, max_file_bytes: int | None = MAX_FILE_BYTES, max_files: int | None = None) -> DataFrame:
    """relpath, language, size, mtime and content of a tree's supported files that are not blank.  Path and size are tested
    before any content is read; ignored folders never match.  With ``max_files`` the first by path, part by part, stay."""
    base = root.rstrip("/") + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base)
    rel = F.regexp_replace(F.col("path"), r"^[a-z]+:/*", "/").substr(F.lit(len(base) + 1), F.lit(100_000))
    files = files if max_file_bytes is None else files.where(F.col("length") <= max_file_bytes)
    files = files.withColumn("relpath", rel).where(~ignored(F.col("relpath"))).withColumn("language", language_of(F.col("relpath"))).where("language <> 'text'")
    files = files.select("relpath", "language", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), "content").where(F.trim(F.regexp_replace(decode_bytes(F.col("content")), r"\s+", "")) != "")
    return files if max_files is None else files.orderBy(F.split("relpath", "/")).limit(max_files)


def tree_signature(files: DataFrame, *by: str) -> DataFrame:
    """A signature of the files' paths, times and sizes that any change of one changes; sums of hash slices, so that no order and no list of files is needed."""
    h = F.sha2(F.concat_ws("|", "relpath", F.col("mtime").cast("string"), F.col("size").cast("string")), 256)
    part = lambda i: F.sum(F.conv(F.substring(h, 8 * i + 1, 8), 16, 10).cast("decimal(20,0)")).cast("string")
    g = files.groupBy(*by).agg(F.count("*").alias("files"), F.concat_ws(",", F.count("*").cast("string"), *(part(i) for i in range(8))).alias("sums"))
    return g.select(*by, "files", F.sha2("sums", 256).alias("signature"))


#: Layout of a stored index; another number makes older ones unreadable.
INDEX_VERSION = 3


def save_index(tables: dict[str, DataFrame], folder: str, signature: str) -> None:
    """Stores an index's tables under its signature; a signature that is stored already is written anew."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/v{INDEX_VERSION}/{signature}/{name}")


def load_index(spark: SparkSession, folder: str, signature: str, names: tuple[str, ...]) -> dict[str, DataFrame] | None:
    """The stored tables of a signature; null if any of them is missing or damaged."""
    out = {}
    for name in names:
        try:
            out[name] = spark.read.parquet(f"{folder}/v{INDEX_VERSION}/{signature}/{name}")
        except Exception as error:  # noqa: BLE001 - what cannot be read is as good as not stored
            if "PATH_NOT_FOUND" in str(error) or "UNABLE_TO_INFER_SCHEMA" in str(error) or "FAILED_READ_FILE" in str(error):
                return None
            raise
    return out


def run_listing(spark: SparkSession, folder: str, limit: int = 30) -> DataFrame:
    """Stored runs (folder/run_*/run.json), newest file first; damaged ones are skipped."""
    schema = "run_id string, status string, task string, model string, execution_mode string, changed_files array<string>, timeline array<string>, _bad string"
    df = spark.read.schema(schema).option("multiLine", True).option("columnNameOfCorruptRecord", "_bad").json(f"{folder}/run_*/run.json")
    df = df.select("*", F.col("_metadata.file_modification_time").alias("mtime"), F.regexp_extract(F.col("_metadata.file_path"), r"/([^/]+)/run\.json$", 1).alias("folder")).where("_bad is null")
    return df.orderBy(F.col("mtime").desc(), F.col("folder").desc()).limit(limit).select(F.coalesce("run_id", "folder").alias("run_id"), F.coalesce("status", F.lit("")).alias("status"), "task", "model", F.coalesce("execution_mode", F.lit("local")).alias("execution_mode"), F.coalesce("changed_files", F.array().cast("array<string>")).alias("changed_files"), F.greatest(F.lit(0), F.size("timeline")).alias("timeline_count"))


def decode_bytes(content: Column) -> Column:
    """utf-8 without a leading mark, gb18030, latin-1, whichever reads the bytes first; null stays null."""

    def chain(raw):
        def one(b):
            for encoding in ("utf-8-sig", "gb18030"):
                try:
                    return b.decode(encoding)
                except UnicodeDecodeError:
                    continue
            return b.decode("latin-1")

        return raw.map(one, na_action="ignore")

    return F.pandas_udf(chain, T.StringType())(content)


def json_lines(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """One record per line feed; other Unicode line ends stay inside values."""
    reader = spark.read.option("lineSep", "\n").option("mode", "PERMISSIVE")
    return (reader.schema(schema) if schema else reader).json(path)


def json_records(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Records of JSON lines (by the suffix .jsonl), of a JSON array, or of an object's ``data`` member."""
    if path.lower().endswith(".jsonl"):
        return json_lines(spark, path, schema)
    df = (spark.read.schema(schema) if schema else spark.read).option("multiLine", True).json(path)
    return df.select(F.explode("data").alias("r")).select("r.*") if "data" in df.columns and dict(df.dtypes)["data"].startswith("array") else df


def pick(df: DataFrame, *names: str) -> Column:
    """First of the alias columns that exist and is not blank, as text."""
    have = [n for n in names if n in df.columns]
    return F.coalesce(*(F.when(F.trim(F.col(n).cast("string")) != "", F.col(n).cast("string")) for n in have), F.lit(None).cast("string"))


#: Aliases of retrieval data sets, and the forms of declarations, calls and imports in any language.
ALIASES = {
    "doc_id": ("id", "_id", "doc_id", "corpus_id"), "doc_text": ("text", "contents", "content", "code"), "title": ("title", "symbol", "name"), "path": ("path", "file_path", "filepath"), "repository": ("repo", "repository", "repository_name"),
    "query_id": ("id", "_id", "query_id", "qid"), "query_text": ("text", "query", "question", "problem_statement"), "judged_query": ("query_id", "qid", "query", "id"), "judged_doc": ("corpus_id", "doc_id", "document_id", "pid"), "grade": ("relevance", "score", "label"), "candidates": ("filtered_corpus_id", "candidate_ids"),
}
DECLARED = r"\b(?:async\s+def|def|class|function|fn|struct|enum|interface|trait)\s+([A-Za-z_$][\w$]*)"
CALLED = r"\b([A-Za-z_$][\w$]*)\s*\("
IMPORTED = r"\b(?:from|import|use|require)\s+([A-Za-z_$][\w$.:/]*)"


def _forms(text: Column, pattern: str) -> Column:
    return F.array_join(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), " ")


def ir_corpus(df: DataFrame) -> DataFrame:
    """Corpus records under their aliases as id, text, title, path, metadata, repository.  A record without a title is titled by what its text declares;
    metadata goes on with what the text calls and imports.  A record without an id gets one of its own."""
    text = F.coalesce(pick(df, *ALIASES["doc_text"]), F.lit(""))
    repo = F.coalesce(pick(df, *ALIASES["repository"]), F.lit(""))
    own = F.coalesce(pick(df, *ALIASES["doc_id"]), F.concat(F.lit("doc_"), F.monotonically_increasing_id().cast("string")))
    base = df.select(own.alias("id"), text.alias("text"), pick(df, *ALIASES["title"]).alias("title"), F.coalesce(pick(df, *ALIASES["path"]), F.lit("")).alias("path"), F.coalesce(pick(df, "metadata"), repo).alias("metadata"), repo.alias("repository"))
    structure = F.concat_ws(" ", *(F.when(x != "", x) for x in (_forms(F.col("text"), CALLED), _forms(F.col("text"), IMPORTED))))
    return base.select("id", "text", F.coalesce("title", _forms(F.col("text"), DECLARED)).alias("title"), "path", F.trim(F.concat_ws(" ", "metadata", structure)).alias("metadata"), "repository")


def ir_queries(df: DataFrame) -> DataFrame:
    """id, text, repository, candidate_ids of query records; a query without a list of candidates has an empty one."""
    lists = [F.col(c).cast("array<string>") for c in ALIASES["candidates"] if dict(df.dtypes).get(c, "").startswith("array")]
    some = F.coalesce(*(F.when(F.size(c) > 0, c) for c in lists), F.array().cast("array<string>"))
    own = F.coalesce(pick(df, *ALIASES["query_id"]), F.concat(F.lit("query_"), F.monotonically_increasing_id().cast("string")))
    return df.select(own.alias("id"), F.coalesce(pick(df, *ALIASES["query_text"]), F.lit("")).alias("text"), F.coalesce(pick(df, *ALIASES["repository"]), F.lit("")).alias("repository"), some.alias("candidate_ids"))


def ir_qrels(df: DataFrame) -> DataFrame:
    """query_id, doc_id, relevance (1 where none is given) of judgments that name a document."""
    grade = F.coalesce(*(F.col(c).cast("double") for c in ALIASES["grade"] if c in df.columns), F.lit(1.0))
    return df.select(pick(df, *ALIASES["judged_query"]).alias("query_id"), pick(df, *ALIASES["judged_doc"]).alias("doc_id"), grade.alias("relevance")).where("doc_id is not null")


def ir_directory(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Records of ``root/<repository>/<name>.jsonl`` with the folder's name as partition; one plan reads all of them."""
    df = spark.read.option("lineSep", "\n").json(f"{root}/*/{name}.jsonl")
    return df.withColumn("partition", F.regexp_extract(F.col("_metadata.file_path"), r"/([^/]+)/[^/]+\.jsonl$", 1))


def imported_cases(records: DataFrame, max_cases: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(cases, skipped) of issue records: a case for each path that a record expects, named or taken from its patch; several get a number behind the record's id.

    Records without a question or a path are skipped.  With ``max_cases`` the first by id and number stay."""
    have = records.columns
    text = lambda *names: F.coalesce(pick(records, *names), F.lit(""))
    lists = [F.when(F.size(c) > 0, F.col(c).cast("array<string>")) for c in ("expected_paths", "files") if c in have and dict(records.dtypes)[c].startswith("array")]
    one = F.when(F.trim(text("expected_path")) != "", F.array(F.trim(text("expected_path"))))
    patch = F.filter(F.regexp_extract_all(text("patch", "gold_patch"), F.lit(r"(?m)^\+\+\+\s+b/(.+)$"), F.lit(1)), lambda p: p != "/dev/null")
    paths = F.array_distinct(F.transform(F.coalesce(*lists, one, patch), lambda p: F.regexp_replace(p, r"\\", "/")))
    base = records.select(text("instance_id", "id").alias("id"), F.trim(text("repo", "repository")).alias("repo"), F.trim(text("problem_statement", "question", "issue")).alias("question"), F.filter(paths, lambda p: F.trim(p) != "").alias("paths"))
    whole = (F.col("question") != "") & (F.size("paths") > 0)
    cases = base.where(whole).select("id", "repo", "question", F.size("paths").alias("n"), F.posexplode("paths").alias("pos", "expected_path"))
    cases = cases.select(F.when(F.col("n") == 1, F.col("id")).otherwise(F.concat("id", F.lit("__file_"), (F.col("pos") + 1).cast("string"))).alias("id"), "repo", "question", "expected_path", F.col("id").alias("source_id"), "pos")
    cases = cases.drop("source_id", "pos") if max_cases is None else cases.orderBy("source_id", "pos").limit(max_cases).drop("source_id", "pos")
    return cases, base.where(~whole).select("id", F.lit("missing question or patch-derived expected path").alias("reason"))
