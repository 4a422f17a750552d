"""The statement gate: one read-only statement over registered relations; everything else is refused by name."""

from __future__ import annotations

import re

from pyspark.errors import ParseException
from pyspark.sql import SparkSession

SUBQUERIES = {"ScalarSubquery", "Exists", "ListQuery", "LateralSubquery", "FunctionTableSubqueryArgumentExpression"}
INERT = re.compile(r"\s*(begin|commit|rollback|start\s+transaction|end)(\s+(work|transaction))?\s*;?\s*", re.I)
#: Groups of Spark's own functions that compute from their arguments alone (those of dates may read the clock), and single ones beside them.
FUNCTION_GROUPS = {
    "agg_funcs", "array_funcs", "bitwise_funcs", "collection_funcs", "conditional_funcs", "conversion_funcs", "csv_funcs", "date_funcs", "datetime_funcs", "generator_funcs", "hash_funcs",
    "json_funcs", "lambda_funcs", "map_funcs", "math_funcs", "predicate_funcs", "sketch_funcs", "string_funcs", "struct_funcs", "url_funcs", "variant_funcs", "window_funcs", "xml_funcs",
}
FUNCTIONS = {"typeof", "uuid", "assert_true", "raise_error", "version", "monotonically_increasing_id", "equal_null", "grouping", "grouping_id"}
TABLE_FUNCTIONS = {"records_as_of", "causal_closure", "journal", "answer_proof", "range", "explode", "posexplode", "inline", "stack"}
_READS = {
    "Project", "Aggregate", "Filter", "UnresolvedHaving", "Sort", "GlobalLimit", "LocalLimit", "Offset", "Union", "Distinct", "Intersect", "Except", "Join", "LateralJoin",
    "SubqueryAlias", "UnresolvedSubqueryColumnAliases", "UnresolvedRelation", "UnresolvedInlineTable", "UnresolvedTableValuedFunction", "OneRowRelation", "UnresolvedWith", "Generate",
    "WithWindowDefinition", "Window", "Pivot", "Unpivot", "UnresolvedPivot", "LocalRelation", "Sample", "UnresolvedTVFAliases", "AliasedNamedLambda", "UnresolvedWithCTERelations", "ResolvedInlineTable",
}
_NAMES = [("Insert", "INSERT"), ("Overwrite", "INSERT"), ("Update", "UPDATE"), ("Delete", "DELETE"), ("Merge", "MERGE"), ("Drop", "DROP"), ("Create", "CREATE"), ("Alter", "ALTER"), ("Rename", "ALTER"), ("Truncate", "TRUNCATE"), ("AddJar", "ADD"), ("AddFile", "ADD"), ("AddArchive", "ADD"), ("Cache", "CACHE"), ("Uncache", "UNCACHE"), ("Load", "LOAD"), ("Replace", "REPLACE"), ("Refresh", "REFRESH"), ("Analyze", "ANALYZE"), ("SetCatalog", "USE"), ("SetNamespace", "USE"), ("ScriptTransformation", "TRANSFORM"), ("Call", "CALL")]


class Refused(PermissionError):
    """A statement that the gate does not let through; SQLSTATE 42501."""

    sqlstate = "42501"


def _name(node) -> str:
    return node.getClass().getSimpleName().rstrip("$")


def _seq(s) -> list:
    return [s.apply(i) for i in range(s.size())]


def _parts(x) -> list[str]:
    return [p if isinstance(p, str) else p.toString() for p in _seq(x)]


def _refusal(kind: str) -> Refused:
    word = next((w for start, w in _NAMES if kind.startswith(start)), kind)
    return Refused(f"{word} is not allowed: this surface reads, and nothing else")


def _allowed(spark: SparkSession, name: str) -> bool:
    """Whether a scalar function is one of Spark's own and computes from its arguments alone."""
    if name in FUNCTIONS:
        return True
    jvm = spark._jvm
    found = spark._jsparkSession.sessionState().functionRegistry().lookupFunction(jvm.org.apache.spark.sql.catalyst.FunctionIdentifier(name))
    # a name that no one knows is left to the analyzer, which says so
    return found.isEmpty() or (found.get().getGroup() in FUNCTION_GROUPS and found.get().getSource() == "built-in")


def _check(node, known: set[str], functions: set[str], spark: SparkSession) -> None:
    kind = _name(node)
    if kind not in _READS:
        raise _refusal(kind)
    if kind == "UnresolvedWith":
        for pair in _seq(node.cteRelations()):
            name = pair._1()
            _check(pair._2(), known | {name.lower()}, functions, spark)
            known = known | {name.lower()}
    if kind == "UnresolvedRelation":
        parts = _parts(node.multipartIdentifier())
        if len(parts) != 1 or parts[0].lower() not in known:
            raise Refused(f"relation {'.'.join(parts)} is not registered here")
    if kind == "UnresolvedTableValuedFunction":
        parts = _parts(node.name())
        if len(parts) != 1 or parts[0].lower() not in functions:
            raise Refused(f"there is no table function {'.'.join(parts)} here")
    for e in _seq(node.expressions()):
        _check_expression(e, known, functions, spark)
    for child in _seq(node.children()):
        _check(child, known, functions, spark)


def _check_expression(e, known: set[str], functions: set[str], spark: SparkSession) -> None:
    kind = _name(e)
    if kind == "UnresolvedFunction":
        parts = _parts(e.nameParts())
        if len(parts) != 1 or not _allowed(spark, parts[0].lower()):
            raise Refused(f"function {'.'.join(parts)} is not allowed: only Spark's own that compute from their arguments are")
    if kind in SUBQUERIES:
        _check(e.plan(), known, functions, spark)
    for child in _seq(e.children()):
        _check_expression(child, known, functions, spark)


def parse(spark: SparkSession, sql: str):
    return spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)


def allow(spark: SparkSession, sql: str, known: set[str], functions: set[str] = frozenset(TABLE_FUNCTIONS)) -> str:
    """``query``, ``explain``, ``show`` or ``inert`` (accepted and not executed); else ``Refused``."""
    if INERT.fullmatch(sql):
        return "inert"
    try:
        plan = parse(spark, sql)
    except ParseException as e:
        if re.search(r";\s*\S", sql):
            raise Refused("more than one statement, or one that does not parse") from e
        raise
    kind = _name(plan)
    if kind in ("SetCommand", "ResetCommand"):
        return "inert"  # executing it could reopen what the session closes
    if kind == "ExplainCommand":
        _check(plan.logicalPlan(), set(known), set(functions), spark)
        return "explain"
    if kind.startswith("Show"):
        return "show"
    _check(plan, set(known), set(functions), spark)
    return "query"


def literal_calls(spark: SparkSession, sql: str) -> list[tuple[str, list]]:
    """Table functions a statement calls, with their literal arguments as text."""
    found = []

    def walk(node) -> None:
        if _name(node) == "UnresolvedTableValuedFunction":
            args = []
            for e in _seq(node.functionArgs()):
                if _name(e) != "Literal":
                    raise Refused("arguments of table functions must be literals")
                args.append(e.value().toString() if hasattr(e.value(), "toString") else str(e.value()))
            found.append((_parts(node.name())[-1].lower(), args))
        if _name(node) == "UnresolvedWith":
            for pair in _seq(node.cteRelations()):
                walk(pair._2())
        for e in _seq(node.expressions()):
            walk_expression(e)
        for child in _seq(node.children()):
            walk(child)

    def walk_expression(e) -> None:
        if _name(e) in SUBQUERIES:
            walk(e.plan())
        for child in _seq(e.children()):
            walk_expression(child)

    plan = parse(spark, sql)
    walk(plan.logicalPlan() if _name(plan) == "ExplainCommand" else plan)
    return found
