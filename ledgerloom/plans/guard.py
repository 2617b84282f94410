"""What a user's SELECT may hold, checked on plans instead of on text.

The session's own parser reads the text, so comments, quotes and escapes are what Spark takes them
for. The parsed plan is walked with allow lists: kinds of plan nodes, kinds of expressions, functions
by name, relations that are a curated view or a common table expression in scope. What isn't listed
is refused, table functions, hints, generators, samples, set-returning and JVM-calling functions
among it. A second walk over the analyzed plan looks at what names were resolved to: all rows must
come from the views themselves.
"""

from __future__ import annotations

from pyspark.errors import ParseException
from pyspark.sql import DataFrame, SparkSession

#: Plan nodes of a plain SELECT.
NODES = {
    "Project", "Filter", "Aggregate", "UnresolvedHaving", "Sort", "GlobalLimit", "LocalLimit", "Offset", "Distinct", "Join", "Union", "Except", "Intersect", "SubqueryAlias", "UnresolvedSubqueryColumnAliases", "WithWindowDefinition",
    "OneRowRelation", "UnresolvedWith", "UnresolvedRelation", "Window",
}
#: Expressions that aren't functions by name.
EXPRESSIONS = {
    "UnresolvedAttribute", "UnresolvedAlias", "Alias", "MultiAlias", "Literal", "NamedParameter", "UnresolvedOrdinal", "UnresolvedFunction", "SortOrder",
    "Add", "Subtract", "Multiply", "Divide", "IntegralDivide", "Remainder", "UnaryMinus", "UnaryPositive", "Concat",
    "EqualTo", "EqualNullSafe", "LessThan", "LessThanOrEqual", "GreaterThan", "GreaterThanOrEqual", "And", "Or", "Not", "In", "Like", "ILike", "LikeAny", "LikeAll", "RLike", "IsNull", "IsNotNull", "IsTrue", "IsNotTrue", "IsUnknown", "IsNotUnknown",
    "Cast", "CaseWhen", "If", "Exists", "InSubquery", "ListQuery", "ScalarSubquery", "Extract",
    "WindowExpression", "UnresolvedWindowExpression", "WindowSpecDefinition", "WindowSpecReference", "SpecifiedWindowFrame", "UnspecifiedFrame$", "CurrentRow$", "UnboundedPreceding$", "UnboundedFollowing$",
}
SUBQUERIES = {"Exists", "ListQuery", "ScalarSubquery"}
#: Functions that give one value of bounded size for a row, a group or a window.
FUNCTIONS = {
    "count", "sum", "avg", "mean", "min", "max", "min_by", "max_by", "median", "mode", "percentile", "percentile_cont", "percentile_disc", "percentile_approx", "approx_percentile", "approx_count_distinct", "count_if", "bool_and", "bool_or", "every", "any", "some",
    "stddev", "stddev_pop", "stddev_samp", "variance", "var_pop", "var_samp", "corr", "covar_pop", "covar_samp", "skewness", "kurtosis", "first", "last", "first_value", "last_value", "any_value", "try_sum", "try_avg",
    "row_number", "rank", "dense_rank", "percent_rank", "cume_dist", "ntile", "lag", "lead", "nth_value",
    "abs", "ceil", "ceiling", "floor", "round", "bround", "sign", "signum", "sqrt", "exp", "ln", "log", "log2", "log10", "power", "pow", "mod", "pmod", "greatest", "least", "coalesce", "ifnull", "nvl", "nvl2", "nullif", "if", "isnull", "isnotnull", "isnan", "between", "width_bucket", "try_divide", "try_add",
    "length", "char_length", "character_length", "lower", "lcase", "upper", "ucase", "trim", "ltrim", "rtrim", "substring", "substr", "left", "right", "position", "instr", "locate", "startswith", "endswith", "contains", "concat", "concat_ws", "replace", "split_part", "substring_index",
    "from_unixtime", "unix_timestamp", "to_timestamp", "to_date", "timestamp_seconds", "unix_seconds", "date_trunc", "trunc", "date_format", "date_add", "date_sub", "datediff", "date_diff", "year", "quarter", "month", "day", "dayofmonth", "dayofweek", "dayofyear", "weekofyear", "hour", "minute", "second", "extract", "date_part", "make_date",
    "cast", "string", "bigint", "int", "double", "decimal", "date", "timestamp", "boolean", "||", "+", "-", "*", "/", "%", "div", "=", "==", "<=>", "<", "<=", ">", ">=", "!=", "<>", "and", "or", "not", "like", "ilike", "rlike", "in",
}
#: Names that Spark reads as functions where no column has them.
SESSION_NAMES = {"current_user", "user", "session_user", "current_catalog", "current_database", "current_schema", "current_path", "input_file_name"}


class Refused(ValueError):
    """The text holds something that isn't allowed."""


def _all(sequence) -> list:
    return [sequence.apply(i) for i in range(sequence.size())]


def _kind(node) -> str:
    return node.getClass().getSimpleName()


def _expression(e, views: set[str], scope: set[str], read: set[str]) -> None:
    kind = _kind(e)
    if kind == "UnresolvedStar":
        raise Refused("columns must be named")
    if kind not in EXPRESSIONS:
        raise Refused(f"{kind} isn't allowed")
    if kind == "UnresolvedFunction":
        name = [str(x).lower() for x in _all(e.nameParts())]
        if len(name) != 1 or name[0] not in FUNCTIONS:
            raise Refused(f"the function {'.'.join(name)} isn't allowed")
    elif kind == "UnresolvedAttribute":
        name = [str(x).lower() for x in _all(e.nameParts())]
        if len(name) == 1 and name[0] in SESSION_NAMES:
            raise Refused(f"{name[0]} can't be read")
    if kind in SUBQUERIES:
        _plan(e.plan(), views, scope, read)
    if kind == "WindowExpression":
        _expression(e.windowFunction(), views, scope, read)
        _expression(e.windowSpec(), views, scope, read)
    for child in _all(e.children()):
        _expression(child, views, scope, read)


def _plan(node, views: set[str], scope: set[str], read: set[str]) -> None:
    kind = _kind(node).removesuffix("$")
    if kind not in NODES:
        raise Refused(f"{kind} isn't allowed")
    if kind == "UnresolvedRelation":
        name = [str(x).lower() for x in _all(node.multipartIdentifier())]
        if len(name) == 1 and name[0] in scope:
            return
        if len(name) != 1 or name[0] not in views:
            raise Refused(f"only {', '.join(sorted(views))} can be read, not {'.'.join(name)}")
        read.add(name[0])
    elif kind == "UnresolvedWith":
        if node.allowRecursion():
            raise Refused("recursion isn't allowed")
        for of in _all(node.cteRelations()):  # each sees those before it
            if (name := str(of._1()).lower()) in views:
                raise Refused(f"{name} is a view's name")
            _plan(of._2(), views, scope, read)
            scope = scope | {name}
    elif kind == "WithWindowDefinition":
        for spec in _all(node.windowDefinitions().values().toSeq()):
            _expression(spec, views, scope, read)
    for e in _all(node.expressions()):
        _expression(e, views, scope, read)
    for child in _all(node.children()):
        _plan(child, views, scope, read)


def check_parsed(spark: SparkSession, text: str, views: set[str]) -> set[str]:
    """The views that a SELECT reads; :class:`Refused` if it isn't one, or holds what isn't allowed."""
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    except ParseException as error:
        raise Refused(f"no statement: {error.getMessage() or error}") from None
    read: set[str] = set()
    _plan(plan, views, set(), read)
    if not read:
        raise Refused(f"a query reads one of {', '.join(sorted(views))} at least")
    return read


def check_analyzed(rows: DataFrame, views: set[str]) -> None:
    """:class:`Refused` if any row comes from elsewhere than the temporary views of these names."""

    def walk(node) -> None:
        kind = _kind(node).removesuffix("$")
        if kind == "View":
            name = node.desc().identifier()
            if not node.isTempView() or str(name.table()).lower() not in views or name.database().isDefined():
                raise Refused(f"{name} can't be read")
            return
        children = _all(node.children())
        if not children and kind not in ("OneRowRelation", "CTERelationRef"):
            raise Refused(f"{kind} can't be read")
        for e in _all(node.expressions()):
            expression(e)
        for child in children:
            walk(child)

    def expression(e) -> None:
        if _kind(e) in ("Exists", "ListQuery", "ScalarSubquery", "LateralSubquery"):
            walk(e.plan())
        for child in _all(e.children()):
            expression(child)

    walk(rows._jdf.queryExecution().analyzed())
