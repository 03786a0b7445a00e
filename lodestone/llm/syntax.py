"""Problem 1: source files that do not parse in the language their path names.

Every text runs through the derivative engine: an empty derivative names the failing token, a non-nullable derivative
at the end is a truncation.  Null text is never a case; an empty text is a valid program; unknown extensions are never
cases.  Python is what its 3.13 interpreter parses, brackets over 200 and blocks over 100 levels deep excluded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .batches import map_rows, table

EXTENSIONS = {".py": "python", ".js": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".ts": "typescript", ".toml": "toml"}


def check_source(relpath: str | None, text: str | None) -> tuple[str | None, str | None, int, str]:
    """(language, verdict, line, token); verdict is None for a valid file, else token, truncated or lexical."""
    from .lexers import CHECKERS

    ext = "." + relpath.rsplit(".", 1)[-1].lower() if relpath and "." in relpath else ""
    if ext not in CHECKERS or text is None:
        return EXTENSIONS.get(ext), None, 0, ""
    language, check = CHECKERS[ext]
    return language, *check(text)


def syntax_flags(files: DataFrame, key: str = "file_no", path: str = "relpath", text: str = "source_text", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per file with a known extension: key, carried columns, language, verdict (null: valid), line, token."""
    kinds = dict(files.dtypes)
    suffix = F.lower(F.regexp_extract(path, r"(\.[A-Za-z]+)$", 1))
    known = files.where(suffix.isin(*EXTENSIONS)).select(key, path, text, *carry)
    cols = [key, *carry]

    def one(k, relpath, source, *rest):
        yield (k, *rest, *check_source(relpath, source))

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in cols) + ", ext_language string, verdict string, line int, token string"
    return map_rows(known, schema, one)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syntax_flags(table(spark, sf_dir, "file_analysis")).where("verdict is not null").select("file_no")


def p1_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where and how each invalid file fails."""
    return syntax_flags(table(spark, sf_dir, "file_analysis")).where("verdict is not null")


def p1_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rate of invalid files per repository and extension language; counts combine map-side, so a hot repository is cheap."""
    flags = syntax_flags(table(spark, sf_dir, "file_analysis"), carry=("repo_root",))
    bad = F.col("verdict").isNotNull()
    return flags.groupBy("repo_root", "ext_language").agg(
        F.count("*").alias("files"),
        F.count_if(bad).alias("invalid"),
        F.count_if(F.col("verdict") == "truncated").alias("truncated"),
        F.round(F.avg(bad.cast("double")), 6).alias("invalid_rate"),
    )


QUERIES = {"p1_found": p1_found, "p1_failures": p1_failures, "p1_rates": p1_rates}
