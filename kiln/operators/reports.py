"""User SQL and SQL-templated reports (SQL-01, SQL-02).

Ad-hoc SQL runs on Catalyst over registered views and comes back as a lazy
DataFrame.  A template's ``{{SQL:...}}`` blocks become named result sets;
a block that fails validation or analysis yields an error entry and the
other blocks still run.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from py4j.java_gateway import is_instance_of
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kiln.functions.scalars import format_cell
from kiln.operators.sinks import export_csv

# Words refused anywhere in a query (whole words, any case).
BLOCKED_WORDS = [
    "DROP", "DELETE", "UPDATE", "INSERT", "ALTER", "TRUNCATE",
    "GRANT", "REVOKE", "CREATE", "EXEC", "EXECUTE",
]
# Extra words the report-template validator refuses, and comment markers.
TEMPLATE_BLOCKED_WORDS = ["CALL", "INTO OUTFILE", "INTO DUMPFILE", "LOAD_FILE"]
COMMENT_MARKERS = ["--", "/*"]
SQL_BLOCK = re.compile(r"\{\{SQL:(.*?)\}\}", re.DOTALL)


class QueryRejected(ValueError):
    pass


# SQL functions that run JVM code, and the table functions that read no storage.
JVM_FUNCTIONS = {"java_method", "reflect", "try_reflect"}
GENERATORS = {"range", "explode", "explode_outer", "posexplode", "posexplode_outer", "inline", "inline_outer", "stack",
              "json_tuple", "variant_explode", "variant_explode_outer"}


def text_refusal(sql: str | None, template: bool = False) -> str | None:
    """Why the text of a query is refused, or None.

    A blocked word counts wherever it stands as a whole word, inside string
    literals too.  Report templates (``template``) know more words and no comments.
    """
    text = sql or ""
    words = BLOCKED_WORDS + (TEMPLATE_BLOCKED_WORDS if template else [])
    anywhere = "|".join(w.replace(" ", r"\s+") for w in words)
    found = re.search(rf"\b(?:{anywhere})\b", text, re.IGNORECASE)
    if found:
        return f"the word {found.group().upper()} may not be used"
    if template and any(marker in text for marker in COMMENT_MARKERS):
        return "comments may not be used in a template"
    return None if re.match(r"\s*SELECT\b", text, re.IGNORECASE) else "the query is not a SELECT"


def _plan_nodes(gateway, root, views: frozenset[str]):
    """Every plan and expression node of a parsed statement, those of CTEs and subqueries included, with
    the relation names that are known where it stands."""

    def items(seq):
        return [seq.apply(i) for i in range(seq.size())]

    def is_a(node, name):
        return is_instance_of(gateway, node, f"org.apache.spark.sql.catalyst.{name}")

    todo = [(root, views)]
    while todo:
        node, known = todo.pop()
        yield node, is_a, known
        if node.getClass().getSimpleName() == "UnresolvedWith":
            # a CTE sees the ones before it (a recursive one itself), the query behind them sees all; nobody outside does
            ctes = [node.cteRelations().apply(i) for i in range(node.cteRelations().size())]
            for cte in ctes:
                name = cte._1().lower()
                todo.append((cte._2(), known | {name} if node.allowRecursion() else known))
                known = known | {name}
            todo += [(child, known) for child in items(node.children())]
            continue
        below = items(node.children()) + items(node.innerChildren())
        if is_a(node, "plans.QueryPlan"):
            below += items(node.expressions())
        elif is_a(node, "expressions.PlanExpression"):
            below.append(node.plan())
        todo += [(n, known) for n in below]


def plan_refusal(spark: SparkSession, sql: str) -> str | None:
    """Why the parsed statement is refused, or None.

    Nothing is analysed or run: Catalyst only parses the text.  Refused are
    commands and scripts, relations that aren't registered views or CTEs of
    the query (``format.`path```, catalog tables), table functions other than
    generators, names made at run time, and calls into the JVM.
    """
    views = frozenset(t.name.lower() for t in spark.catalog.listTables() if t.isTemporary)
    parsed = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    for node, is_a, known in _plan_nodes(spark.sparkContext._gateway, parsed, views):
        kind = node.getClass().getSimpleName()
        if is_a(node, "plans.logical.Command") or is_a(node, "plans.logical.ParsedStatement"):
            return f"{kind} is not a query"
        if kind in ("CompoundBody", "ScriptTransformation", "InsertIntoDir", "RelationTimeTravel") or "UnresolvedIdentifier" in kind:
            return f"{kind} may not be used"
        if kind == "UnresolvedRelation":
            name = node.multipartIdentifier().mkString(".")
            if name.lower() not in known:
                return f"{name} is not a registered view"
        elif kind in ("UnresolvedTableValuedFunction", "UnresolvedFunction"):
            name = (node.name() if kind == "UnresolvedTableValuedFunction" else node.nameParts()).mkString(".").lower()
            if (name not in GENERATORS) if kind == "UnresolvedTableValuedFunction" else name.split(".")[-1] in JVM_FUNCTIONS:
                return f"the function {name} may not be used"
    return None


def run_select(spark: SparkSession, sql: str, template: bool = False) -> DataFrame:
    """SQL-01: read-only SQL over registered views, returned lazily."""
    reason = text_refusal(sql, template) or plan_refusal(spark, sql)
    if reason:
        raise QueryRejected(reason)
    return spark.sql(sql)


@dataclass
class BlockResult:
    block_no: int
    query: str
    frame: DataFrame | None
    error: str | None


def sql_blocks(template: str) -> list[str]:
    return [m.strip() for m in SQL_BLOCK.findall(template)]


def report(spark: SparkSession, template: str) -> list[BlockResult]:
    """SQL-02: every ``{{SQL:...}}`` block -> a lazy result set or an error."""
    out = []
    for i, q in enumerate(sql_blocks(template), start=1):
        try:
            out.append(BlockResult(i, q, run_select(spark, q), None))
        except QueryRejected:
            out.append(BlockResult(i, q, None, "Query validation failed - only SELECT queries allowed"))
        except Exception as e:  # noqa: BLE001 - an analysis error of one block must not stop the others
            out.append(BlockResult(i, q, None, f"Query failed: {str(e).splitlines()[0]}"))
    return out


def formatted(df: DataFrame) -> DataFrame:
    """SCL-09 applied to every column of a result set."""
    return df.select(*[format_cell(F.col(f.name), f.dataType).alias(f.name) for f in df.schema.fields])


def report_rows(spark: SparkSession, template: str) -> DataFrame:
    """All blocks of a report as rows (block_no, status, cells_json): the
    formatted cells of each result row as JSON, or one row per failed
    block."""
    parts = []
    for b in report(spark, template):
        if b.frame is None:
            parts.append(spark.createDataFrame([(b.block_no, "error", None)], "block_no int, status string, cells_json string"))
        else:
            f = formatted(b.frame)
            parts.append(f.select(F.lit(b.block_no).alias("block_no"), F.lit("ok").alias("status"),
                                  F.to_json(F.struct(*[F.col(c) for c in f.columns])).alias("cells_json")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def export_report(spark: SparkSession, template: str, base: str, name: str, ts: str) -> dict[int, str]:
    """SQL-02 with SNK-08: one CSV folder per result set that is not empty,
    ``<name>_<i>`` where the report has several blocks (i from 0).  Returns
    the paths by block number."""
    blocks = report(spark, template)
    paths = {}
    for i, b in enumerate(blocks):
        if b.frame is not None and not b.frame.isEmpty():
            paths[b.block_no] = export_csv(b.frame, base, f"{name}_{i}" if len(blocks) > 1 else name, ts)
    return paths
