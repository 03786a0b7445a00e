"""Problem 4: nested JSON documents as flat tables with parent and child positions.

Pure projection: nested ``transform`` calls attach the ancestors' key and positions, ``flatten`` joins arrays of arrays
and one ``inline`` per target table emits rows.  No shuffle, no Python.  A bare object where an array belongs is an
array of one; JSON inside a JSON string counts as its content; null elements keep their position but are no rows; text
that is no valid JSON, null and empty text give no rows; members of another shape give none either.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: JSON as RFC 8259 has it; a member named twice counts as its last.  Nesting over 1,000 levels and numbers over 1,000 digits are beyond the parser.
STRICT = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false", "allowUnquotedControlChars": "false", "allowNumericLeadingZeros": "false", "allowBackslashEscapingAnyCharacter": "false", "allowComments": "false"}

BUNDLE_PATHS = ("evidence", "graph_edges", "proof.checks", "proof.supporting_paths", "proof.supporting_paths.path", "proof.proof_graph.nodes", "proof.proof_graph.nodes.roles", "proof.proof_graph.edges", "proof.decoy_audit")
RUN_PATHS = ("timeline", "timeline.details.commands", "timeline.details.commands.failures", "timeline.details.findings")


def _bare(text: Column) -> Column:
    return F.regexp_replace(text, r"^[ \t\r\n]+|[ \t\r\n]+$", "")


def valid_json(text: Column) -> Column:
    """The trimmed text where it is one JSON value, else null.

    The text is read as the first element of an array whose second is a mark made from the text itself, so that anything behind the value is seen."""
    mark = F.concat(F.lit("m"), F.xxhash64(text).cast("string"))
    wrapped = F.from_json(F.concat(F.lit("["), text, F.lit(',"'), mark, F.lit('"]')), "array<string>", STRICT)
    return F.when((F.size(wrapped) == 2) & (wrapped[1] == mark), _bare(text))


def content(text: Column) -> Column:
    """Valid JSON text, with a JSON string replaced by the JSON it holds (twice, if need be)."""
    inner = lambda t: F.when(t.startswith('"'), valid_json(F.from_json(F.concat(F.lit("["), t, F.lit("]")), "array<string>")[0])).otherwise(t)
    return inner(inner(valid_json(text)))


def elements(text: Column) -> Column:
    """Array of the raw elements of an array's text, or of the one object; null for anything else."""
    return F.when(text.rlike(r"^\s*\{"), F.array(text)).when(text.rlike(r"^\s*\["), F.from_json(text, "array<string>"))


def members(text: Column, *names: str) -> Column:
    """Struct of raw members; a string member gives its content, so JSON within strings needs no case of its own."""
    return F.from_json(F.when(text.rlike(r"^\s*\{"), text), ", ".join(f"`{n}` string" for n in names))


def _top(text: Column) -> Column:
    return F.transform(elements(text), lambda e, i: F.struct(F.array(i + 1).alias("pos"), e.alias("value")))


def _below(parents: Column, get) -> Column:
    """Elements of a nested array of every parent, with the parents' positions in front of their own."""
    return F.flatten(
        F.filter(
            F.transform(parents, lambda p: F.transform(elements(get(p["value"])), lambda e, i: F.struct(F.concat(p["pos"], F.array(i + 1)).alias("pos"), e.alias("value")))),
            lambda x: x.isNotNull(),
        )
    )


def _rows(child: str, nodes: Column) -> Column:
    some = F.filter(nodes, lambda n: n["value"].isNotNull())
    return F.coalesce(F.transform(some, lambda n: F.struct(F.lit(child).alias("child"), F.array_join(n["pos"].cast("array<string>"), ".").alias("pos_path"), n["value"].alias("value"))), F.array().cast("array<struct<child:string,pos_path:string,value:string>>"))


def bundle_arrays(bundles: DataFrame, key: str = "bundle_no", payload: str = "payload") -> tuple[DataFrame, dict[str, Column]]:
    """The bundles with their parsed top members, and for each child path the array of its (pos, value) nodes.

    Arrays that have children of their own are columns, so that a level is parsed once for all tables below it."""
    base = bundles.select(F.col(key).alias("record_no"), content(F.col(payload)).alias("doc")).where("doc is not null")
    base = base.select("record_no", members(F.col("doc"), "evidence", "graph_edges", "proof").alias("m"))
    base = base.select("record_no", "m.evidence", "m.graph_edges", members(F.col("m.proof"), "checks", "supporting_paths", "proof_graph", "decoy_audit").alias("p"))
    base = base.select("record_no", "evidence", "graph_edges", "p.checks", "p.decoy_audit", _top(F.col("p.supporting_paths")).alias("paths"), members(F.col("p.proof_graph"), "nodes", "edges").alias("g"))
    base = base.select("record_no", "evidence", "graph_edges", "checks", "decoy_audit", "paths", _top(F.col("g.nodes")).alias("nodes"), F.col("g.edges").alias("edges"))
    return base, {
        "evidence": _top(F.col("evidence")),
        "graph_edges": _top(F.col("graph_edges")),
        "proof.checks": _top(F.col("checks")),
        "proof.supporting_paths": F.col("paths"),
        "proof.supporting_paths.path": _below(F.col("paths"), lambda v: members(v, "path")["path"]),
        "proof.proof_graph.nodes": F.col("nodes"),
        "proof.proof_graph.nodes.roles": _below(F.col("nodes"), lambda v: members(v, "roles")["roles"]),
        "proof.proof_graph.edges": _top(F.col("edges")),
        "proof.decoy_audit": _top(F.col("decoy_audit")),
    }


def run_arrays(runs: DataFrame, key: str = "run_no", timeline: str = "timeline") -> tuple[DataFrame, dict[str, Column]]:
    base = runs.select(F.col(key).alias("record_no"), content(F.col(timeline)).alias("doc")).where("doc is not null")
    base = base.select("record_no", _top(F.col("doc")).alias("steps"))
    details = F.transform("steps", lambda s: F.struct(s["pos"].alias("pos"), members(members(s["value"], "details")["details"], "commands", "findings").alias("value")))
    base = base.select("record_no", "steps", details.alias("details"))
    base = base.select("record_no", "steps", "details", _below(F.col("details"), lambda v: v["commands"]).alias("commands"))
    return base, {
        "timeline": F.col("steps"),
        "timeline.details.commands": F.col("commands"),
        "timeline.details.commands.failures": _below(F.col("commands"), lambda v: members(v, "failures")["failures"]),
        "timeline.details.findings": _below(F.col("details"), lambda v: v["findings"]),
    }


def _inline(arrays: tuple[DataFrame, dict[str, Column]], kind: str, children: tuple[str, ...] | None = None) -> DataFrame:
    base, nodes = arrays
    rows = [_rows(c, n) for c, n in nodes.items() if children is None or c in children]
    whole = rows[0] if len(rows) == 1 else F.concat(*rows)
    return base.select(F.lit(kind).alias("record_kind"), "record_no", F.inline(whole))


def flatten_bundles(bundles: DataFrame, children: tuple[str, ...] | None = None) -> DataFrame:
    """record_kind, record_no, child, pos_path, value of every element of the wanted child tables."""
    return _inline(bundle_arrays(bundles), "bundle", children)


def flatten_runs(runs: DataFrame, children: tuple[str, ...] | None = None) -> DataFrame:
    return _inline(run_arrays(runs), "run", children)


def child_table(rows: DataFrame, child: str, *names: str) -> DataFrame:
    """One target table: key, parents' positions, own position and the wanted members as columns."""
    own = rows.where(F.col("child") == child)
    pos = F.transform(F.split("pos_path", r"\."), lambda p: p.cast("int"))
    own = own.select("record_no", F.slice(pos, 1, F.size(pos) - 1).alias("parent_pos"), F.element_at(pos, -1).alias("pos"), "value")
    return own.select("record_no", "parent_pos", "pos", members(F.col("value"), *names).alias("m")).select("record_no", "parent_pos", "pos", *(F.col(f"m.`{n}`").alias(n) for n in names)) if names else own


def _load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = [flatten_bundles(_load(spark, sf_dir, "evidence_bundles")), flatten_runs(_load(spark, sf_dir, "engineering_runs"))]
    return reduce(DataFrame.unionByName, both).select("record_kind", "record_no", "child", "pos_path")


#: Child tables: query, child path and its scalar members; list members are joined by commas, numbers and flags are typed.
TABLES = {
    "p4_evidence": ("evidence", "rank int", "source_label", "relpath", "language", "symbol_name", "symbol_kind", "start_line int", "end_line int", "route_path", "score double", "handler_names list", "matched_terms list", "reasons list", "snippet"),
    "p4_graph_edges": ("graph_edges", "source", "target", "label", "weight double"),
    "p4_checks": ("proof.checks", "name", "passed boolean", "detail"),
    "p4_supporting_paths": ("proof.supporting_paths", "route", "chunk", "depth int"),
    "p4_path_nodes": ("proof.supporting_paths.path",),
    "p4_proof_nodes": ("proof.proof_graph.nodes", "id", "label"),
    "p4_node_roles": ("proof.proof_graph.nodes.roles",),
    "p4_proof_edges": ("proof.proof_graph.edges", "source", "target", "label", "weight double"),
    "p4_decoys": ("proof.decoy_audit", "candidate", "score double", "route_anchored boolean", "conflicting_roles list", "rejected boolean"),
    "p4_timeline": ("timeline", "step int", "agent", "phase", "status", "title", "summary", "created_at"),
    "p4_commands": ("timeline.details.commands", "command", "exit_code int", "duration_ms int"),
    "p4_failures": ("timeline.details.commands.failures", "test", "message"),
    "p4_findings": ("timeline.details.findings", "severity", "relpath", "note"),
}


def typed_table(rows: DataFrame, child: str, *fields: str) -> DataFrame:
    """record_no, parent_path (pos_path of the parent's row, empty for an outermost array), pos, then the members; without members the element itself as value."""
    names = [f.split()[0] for f in fields]
    t = child_table(rows, child, *names)
    cols = [F.expr(f"try_cast(`{n}` as {k})").alias(n) if k in ("int", "double", "boolean") else F.array_join(elements(F.col(n)), ",").alias(n) if k == "list" else F.col(n) for n, k in (f.split() if " " in f else (f, "string") for f in fields)]
    return t.select("record_no", F.array_join(F.col("parent_pos").cast("array<string>"), ".").alias("parent_path"), "pos", *(cols or ["value"]))


def _table_query(name: str, child: str, fields: tuple[str, ...]):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = flatten_runs(_load(spark, sf_dir, "engineering_runs"), (child,)) if child in RUN_PATHS else flatten_bundles(_load(spark, sf_dir, "evidence_bundles"), (child,))
        return typed_table(rows, child, *fields)

    query.__name__, query.__doc__ = name, f"The flat table of {child}."
    return query


def p4_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each child table."""
    return p4_found(spark, sf_dir).groupBy("record_kind", "child").agg(F.count("*").alias("rows"), F.countDistinct("record_no").alias("records"))


QUERIES = {"p4_found": p4_found, "p4_counts": p4_counts} | {name: _table_query(name, child, tuple(fields)) for name, (child, *fields) in TABLES.items()}
