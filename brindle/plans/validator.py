"""Read-only SQL over one relation called dataset.

A statement is parsed by Spark's own parser, never analysed before it has passed: every node of the parsed plan
must be of a known kind (deny by default), relations are dataset or names of the statement's own WITH, and
no function that looks at the engine, the session or the clock is called. Parsed plans keep WITH bodies and
subqueries apart from their children, so that these are walked too, and expressions with them.

Sorts put nulls last in either direction unless the statement says otherwise.
"""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from brindle.plans import dialect as duck

NAME, MAX_BYTES = "dataset", 64 * 1024
# Node kinds of a parsed query that only reads.
ALLOWED = frozenset("Project Filter Distinct Union Intersect Except Aggregate UnresolvedHaving Sort GlobalLimit LocalLimit Offset Join LateralJoin SubqueryAlias UnresolvedRelation UnresolvedWith WithWindowDefinition UnresolvedSubqueryColumnAliases Pivot Unpivot".split()) - {"LateralJoin"}
DENIED_FUNCTIONS = frozenset("""
current_setting getenv getvariable current_query version current_version current_database current_catalog current_schema current_schemas current_user session_user user
input_file_name input_file_block_start input_file_block_length spark_partition_id monotonically_increasing_id java_method reflect try_reflect
random rand randn randstr uniform uuid gen_random_uuid uuidv4 uuidv7 now today current_date curdate current_time current_timestamp localtimestamp current_timezone unix_timestamp shuffle
raise_error assert_true sleep explode explode_outer posexplode posexplode_outer inline inline_outer stack json_tuple sql_keywords collations variant_explode variant_explode_outer
""".split())


class UnsafeQueryError(ValueError):
    """The statement does not parse, or is more than a query of dataset."""


def _items(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def _kind(node) -> str:
    return node.getClass().getSimpleName().rstrip("$")


class _Walk:
    def __init__(self) -> None:
        self.reading: set[str] = set()  # names of WITH whose bodies read dataset

    def plan(self, node, known: frozenset[str]) -> bool:
        """Refuses what may not be there; whether dataset is read below node."""
        kind = _kind(node)
        if kind not in ALLOWED:
            raise UnsafeQueryError(f"{kind} is not allowed")
        read = False
        if kind == "UnresolvedRelation":
            parts = [str(p) for p in _items(node.multipartIdentifier())]
            if len(parts) != 1 or parts[0].lower() not in known:
                raise UnsafeQueryError(f"only {NAME} can be read, not {'.'.join(parts)}")
            return parts[0].lower() == NAME or parts[0].lower() in self.reading
        if kind == "UnresolvedWith":
            if node.allowRecursion():
                raise UnsafeQueryError("WITH may not be recursive")
            for pair in _items(node.cteRelations()):
                name = str(pair.productElement(0)).lower()
                if name == NAME:
                    raise UnsafeQueryError(f"WITH may not be called {NAME}")
                body = pair.productElement(1)
                if self.plan(body.child() if _kind(body) == "SubqueryAlias" else body, known):
                    self.reading.add(name)
                known = known | {name}
        for child in _items(node.children()):
            read |= self.plan(child, known)
        for expression in _items(node.expressions()):
            read |= self.expression(expression, known)
        return read

    def expression(self, e, known: frozenset[str]) -> bool:
        kind = _kind(e)
        if kind == "UnresolvedFunction":
            names = [str(p).lower() for p in _items(e.nameParts())]
            if len(names) != 1 or names[0] in DENIED_FUNCTIONS:
                raise UnsafeQueryError(f"function {'.'.join(names)} is not allowed")
        elif kind in ("CurrentDate", "CurrentTimestamp", "Now", "LocalTimestamp", "CurrentUser", "CurrentTime", "Rand", "Uuid"):
            raise UnsafeQueryError(f"{kind} is not allowed")
        elif kind == "UnresolvedAttribute" and str(e.name()).lower() in ("current_date", "current_timestamp", "current_user", "user", "session_user", "localtimestamp", "current_time"):
            raise UnsafeQueryError(f"{e.name()} is not allowed")
        read = False
        if hasattr(e, "plan") and kind in ("ScalarSubquery", "Exists", "ListQuery", "InSubquery", "LateralSubquery"):
            if kind == "LateralSubquery":
                raise UnsafeQueryError("lateral subqueries are not allowed")
            read |= self.plan(e.plan(), known) if kind != "InSubquery" else False
        for child in _items(e.children()):
            read |= self.expression(child, known)
        return read


def validate(spark: SparkSession, sql: str) -> None:
    """Raises UnsafeQueryError unless sql is one query that reads dataset and nothing else."""
    if len(sql.encode()) > MAX_BYTES:
        raise UnsafeQueryError("the statement is too long")
    if re.search(rf"`\s*{NAME}\s*`", sql, re.I):
        raise UnsafeQueryError(f"{NAME} is written without quotes")
    if ";" in re.sub(r"'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`|--[^\n]*|/\*.*?\*/", "", sql, flags=re.S).strip().rstrip(";"):
        raise UnsafeQueryError("exactly one statement")
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql.strip().rstrip(";"))
    except Exception as error:
        raise UnsafeQueryError(f"does not parse: {str(error).splitlines()[0]}") from error
    if not _Walk().plan(plan, frozenset({NAME})):
        raise UnsafeQueryError(f"the result does not rest on {NAME}")


def run(df: DataFrame, sql: str, masked: tuple[str, ...] = (), dialect: str = "spark") -> DataFrame:
    """The result of sql over df, of which the columns masked are masked before any expression sees them.

    dialect names the SQL that the statement is written in, spark or duckdb; what is run has passed validate() either way.
    """
    from brindle.functions import pii

    if dialect not in ("spark", "duckdb"):
        raise ValueError(f"no dialect {dialect}")
    view = pii.mask(df, list(masked)) if masked else df
    if dialect == "spark":
        validate(df.sparkSession, sql)
    view.createOrReplaceTempView(NAME)
    if dialect == "duckdb":
        sql = translated(df.sparkSession, sql)
        validate(df.sparkSession, sql)
    return df.sparkSession.sql(extremes(df.sparkSession, nulls_last(df.sparkSession, sql)))


_COMPARED = {">": "max", ">=": "max", "<": "min", "<=": "min"}
_TURNED = {">": "<", ">=": "<=", "<": ">", "<=": ">="}
_PLAIN = re.compile(rf"EXISTS\s*\(\s*SELECT\s+1\s+FROM\s+{NAME}\s+(?:AS\s+)?(\w+)\s+WHERE\s+([^()'\"`;]+)\)", re.I)
_COMPARISON = re.compile(r"\s*([\w.+\-*\s]+?)\s*(<=|>=|<|>|=)\s*([\w.+\-*\s]+?)\s*")


def extremes(spark: SparkSession, sql: str) -> str:
    """sql with EXISTS (SELECT 1 FROM dataset o WHERE o.k = c.k AND o.x > e), whose join compares all pairs of rows of
    one k, asked of the greatest x of each k alone (of the least for <): some x is greater than e if the greatest is.

    Done where the conditions are equalities of columns of o and of c and one comparison of a column of o, both sides
    numbers; others stay as they are, and so do statements with quotes or comments.
    """
    if re.search(r"['\"`]|--|/\*", sql):
        return sql

    def number(column: str, alias: str) -> bool:
        try:
            kind = spark.sql(f"SELECT {column} AS x FROM {NAME} {alias}").schema["x"].dataType
        except AnalysisException:
            return False
        return isinstance(kind, T.NumericType)

    def restated(m: re.Match) -> str:
        inner, found, keys, compared = m[1], m[0], [], []
        own = re.compile(rf"{inner}\.(\w+)", re.I)
        for condition in re.split(r"\s+AND\s+", m[2], flags=re.I):
            c = _COMPARISON.fullmatch(condition)
            if not c:
                return found
            left, mark, right = c.groups()
            if own.fullmatch(right) and not own.search(left):
                left, mark, right = right, _TURNED.get(mark, mark), left
            outer = set(re.findall(r"\b([A-Za-z_]\w*)\.[A-Za-z_]\w*", right))
            # Every name on the other side is of one other alias, so that none of the subquery's is among them.
            if not own.fullmatch(left) or len(outer) != 1 or outer & {inner} or re.search(r"(?<![\w.])[A-Za-z_]\w*(?!\w*\.)\b(?!\.)", right):
                return found
            (keys if mark == "=" else compared).append((own.fullmatch(left)[1], mark, right, outer.pop()))
        if len(compared) != 1 or not keys or not number(f"{inner}.{compared[0][0]}", inner) or not number(compared[0][2], compared[0][3]):
            return found
        x, mark, value, _ = compared[0]
        columns = ", ".join(f"{inner}.{k} AS __k{i}" for i, (k, *_) in enumerate(keys))
        groups = ", ".join(f"{inner}.{k}" for k, *_ in keys)
        equal = " AND ".join(f"__ends.__k{i} = {right}" for i, (_, _, right, _) in enumerate(keys))
        return f"EXISTS (SELECT 1 FROM (SELECT {columns}, {_COMPARED[mark]}({inner}.{x}) AS __x FROM {NAME} {inner} GROUP BY {groups}) __ends WHERE {equal} AND __ends.__x {mark} {value})"

    return _PLAIN.sub(restated, sql)


def translated(spark: SparkSession, sql: str) -> str:
    """sql of DuckDB's dialect in Spark's; where types or columns matter they are asked of the view dataset.

    Nothing is run for that, and nothing is analysed that validate() would refuse.
    """
    if len(sql.encode()) > MAX_BYTES:
        raise UnsafeQueryError("the statement is too long")

    def columns(query: str) -> list[str]:
        validate(spark, query)
        return spark.sql(query).columns

    def typed(expression: str) -> str | None:
        # Names of a lambda, of an alias or of a subquery are not known here; the caller then takes the usual case.
        query = f"SELECT {expression} AS x FROM {NAME}"
        try:
            validate(spark, query)
            return spark.sql(query).schema["x"].dataType.simpleString()
        except (UnsafeQueryError, AnalysisException):
            return None

    try:
        return duck.to_spark(sql, typed, columns)
    except duck.DialectError as error:
        raise UnsafeQueryError(str(error)) from error


def nulls_last(spark: SparkSession, sql: str) -> str:
    """sql with NULLS LAST behind every sort key that says nothing: at the places the parser reports for them."""
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql.strip().rstrip(";"))
    ends: set[int] = set()

    def visit_expression(e) -> None:
        if _kind(e) == "SortOrder":
            origin = e.origin()
            stop = origin.stopIndex()
            if stop.isDefined():
                ends.add(int(stop.get()) + 1)
        for c in _items(e.children()):
            visit_expression(c)
        if _kind(e) in ("ScalarSubquery", "Exists", "ListQuery"):
            visit(e.plan())

    def visit(node) -> None:
        if _kind(node) == "UnresolvedWith":
            for pair in _items(node.cteRelations()):
                visit(pair.productElement(1))
        for c in _items(node.children()):
            visit(c)
        for e in _items(node.expressions()):
            visit_expression(e)

    visit(plan)
    text = sql.strip().rstrip(";")
    for end in sorted(ends, reverse=True):  # the parser counts code points, as Python does
        if not re.search(r"\bNULLS\s+(FIRST|LAST)\s*$", text[:end], re.I):
            text = f"{text[:end]} NULLS LAST{text[end:]}"
    return text
