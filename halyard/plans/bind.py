"""Filter trees to Spark columns.

A condition is true, false or in error (a missing value, a comparison of
strings by size, ...); a row in error is dropped, and what stands right of an
error in AND or OR is not looked at. That is not SQL's logic: there, unknown
OR true is true. Instead of CASE expressions, which hide a filter from the
scan, each tree is written as two plain boolean forms:

    true(a AND b)  = true(a) AND true(b)
    true(a OR b)   = true(a) OR (false(a) AND true(b))
    false(a AND b) = false(a) OR (true(a) AND false(b))
    false(a OR b)  = false(a) AND false(b)

A leaf in error is NULL in both forms, so `where` drops the row, and Catalyst
pushes every conjunct of true(...) into the scan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from halyard.plans.ast import Filter, FilterError
from halyard.plans.parser import parse

#: Fixed value: doubles nearer than this are equal.
EPSILON = 2.220446049250313e-16


def error() -> Column:
    return F.lit(None).cast("boolean")


@dataclass(frozen=True)
class Value:
    """A column and what it holds: int, float, string, bool, array, variant
    or missing."""

    kind: str
    column: Column

    @property
    def numeric(self) -> bool:
        return self.kind in ("int", "float")


def kind_of(t: T.DataType) -> str:
    if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "int"
    if isinstance(t, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "float"
    if isinstance(t, (T.StringType, T.CharType, T.VarcharType)):
        return "string"
    if isinstance(t, T.BooleanType):
        return "bool"
    if isinstance(t, T.ArrayType) and isinstance(t.elementType, T.StringType):
        return "array"
    if isinstance(t, T.VariantType):
        return "variant"
    return "missing"


class Fields:
    """Which column a field name stands for, by exact name. Names that are no
    column are keys of the variant column `dynamic`, or else missing in every
    row. Columns of types that metadata cannot have count as missing."""

    def __init__(self, df: DataFrame, dynamic: str | None = None) -> None:
        self.kinds = {f.name: kind_of(f.dataType) for f in df.schema.fields}
        self.dynamic = dynamic

    def __getitem__(self, name: str) -> Value:
        if self.kinds.get(name, "missing") not in ("missing", "variant"):
            column = F.col(f"`{name}`")
            return Value(self.kinds[name], column.cast("double") if self.kinds[name] == "float" else column)
        if self.dynamic:
            return Value("variant", F.try_variant_get(F.col(f"`{self.dynamic}`"), f"$.{name}", "variant"))
        return Value("missing", F.lit(None).cast("string"))


def operand(node: Filter, fields: Fields) -> Value:
    if node.op == "field":
        return fields[node.args[0]]
    value = node.args[0]
    if isinstance(value, bool):
        return Value("bool", F.lit(value))
    if isinstance(value, int):
        if not -(1 << 63) <= value < 1 << 63:
            return Value("float", F.lit(float(value)))
        return Value("int", F.lit(value).cast("long"))
    if isinstance(value, float):
        return Value("float", F.lit(value))
    if isinstance(value, tuple):
        strings = [x.args[0] for x in value if x.op == "literal" and isinstance(x.args[0], str)]
        return Value("array", F.array(*[F.lit(s) for s in strings]).cast("array<string>"))
    return Value("string", F.lit(value))


def as_kind(v: Value, kind: str) -> Value:
    """A variant as a value of a wanted kind; NULL where it holds another."""
    if v.kind != "variant":
        return v
    found = F.schema_of_variant(v.column)
    if kind in ("int", "float"):
        number = found.isin("BIGINT", "DOUBLE", "FLOAT") | found.startswith("DECIMAL")
        return Value("float", F.when(number, F.try_variant_get(v.column, "$", "double")))
    of, name = {"string": ("string", "STRING"), "bool": ("boolean", "BOOLEAN"), "array": ("array<string>", "ARRAY<STRING>")}[kind]
    return Value(kind, F.when(found == name, F.try_variant_get(v.column, "$", of)))


def present(*values: Value) -> Column:
    both = F.lit(True)
    for v in values:
        both = both & v.column.isNotNull()
    return both


def equal(a: Value, b: Value) -> Column:
    """Equal values of one type; numbers of either type by value. Values of
    other types differ; a missing value is an error."""
    if "missing" in (a.kind, b.kind):
        return error()
    if a.kind == "variant" and b.kind == "variant":
        return F.when(present(a, b), F.to_json(a.column) == F.to_json(b.column))
    if "variant" in (a.kind, b.kind):
        dynamic, fixed = (a, b) if a.kind == "variant" else (b, a)
        return F.when(present(dynamic, fixed), F.coalesce(equal(as_kind(dynamic, fixed.kind), fixed), F.lit(False)))
    if a.numeric and b.numeric:
        if a.kind == b.kind == "int":
            return a.column == b.column
        return F.abs(a.column.cast("double") - b.column.cast("double")) < EPSILON
    if a.kind == b.kind:
        return a.column == b.column
    return F.when(present(a, b), F.lit(False))


def sized(op: str, a: Value, b: Value) -> Column:
    a, b = as_kind(a, "float"), as_kind(b, "float")
    if not (a.numeric and b.numeric):
        return error()
    x, y = (a.column, b.column) if a.kind == b.kind == "int" else (a.column.cast("double"), b.column.cast("double"))
    return {"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]


def like(pattern: str) -> str:
    """The pattern has no escape character; Spark's has."""
    return pattern.replace("\\", "\\\\")


def leaf(node: Filter, fields: Fields) -> Column:
    """true, false, or NULL for an error."""
    op = node.op
    if op == "constant":
        return F.lit(node.args[0])
    if op in ("field", "literal"):
        raise FilterError("E204", f"{node} is not a condition")
    a = operand(node.args[0], fields)
    if op == "IS NULL":
        return F.lit(True) if a.kind == "missing" else a.column.isNull()
    if op == "IS NOT NULL":
        return F.lit(False) if a.kind == "missing" else a.column.isNotNull()
    if op == "=":
        return equal(a, operand(node.args[1], fields))
    if op == "!=":
        return ~equal(a, operand(node.args[1], fields))
    if op in ("<", "<=", ">", ">="):
        return sized(op, a, operand(node.args[1], fields))
    if op == "BETWEEN":
        low, high = (operand(x, fields) for x in node.args[1:])
        return sized(">=", a, low) & sized("<=", a, high)
    if op in ("CONTAINS", "STARTS_WITH", "ENDS_WITH", "LIKE"):
        a = as_kind(a, "string")
        if a.kind != "string":
            return error()
        text = node.args[1].args[0]
        return {"CONTAINS": a.column.contains(text), "STARTS_WITH": a.column.startswith(text), "ENDS_WITH": a.column.endswith(text), "LIKE": a.column.like(like(text))}[op]
    items = node.args[1].args[0]
    if op in ("IN", "NOT IN"):
        found = member(a, items, fields)
        return found if op == "IN" else ~found
    a = as_kind(a, "array")
    if a.kind != "array":
        return error()
    wanted = operand(node.args[1], fields).column
    empty = not any(x.op == "literal" and isinstance(x.args[0], str) for x in items)
    if op == "ALL":
        return F.when(a.column.isNotNull(), F.lit(True)) if empty else F.size(F.array_except(wanted, a.column)) == 0
    shares = F.when(a.column.isNotNull(), F.lit(False)) if empty else F.coalesce(F.arrays_overlap(a.column, wanted), F.when(a.column.isNotNull(), F.lit(False)))
    return shares if op == "ANY" else ~shares


def member(a: Value, items: tuple[Filter, ...], fields: Fields) -> Column:
    if a.kind == "missing":
        return error()
    same = [x.args[0] for x in items if x.op == "literal" and type(x.args[0]) in ({"int": (int,), "string": (str,)}.get(a.kind, ()))]
    if items and len(same) == len(items):
        return a.column.isin(same)
    found = F.lit(False)
    for x in items:
        # An item that is itself missing is an error of that comparison only.
        found = found | F.coalesce(equal(a, operand(x, fields)), F.lit(False))
    return F.when(a.column.isNotNull(), found)


def true_form(node: Filter, fields: Fields) -> Column:
    if node.op == "AND":
        return true_form(node.args[0], fields) & true_form(node.args[1], fields)
    if node.op == "OR":
        return true_form(node.args[0], fields) | (false_form(node.args[0], fields) & true_form(node.args[1], fields))
    if node.op == "NOT":
        return false_form(node.args[0], fields)
    return leaf(node, fields)


def false_form(node: Filter, fields: Fields) -> Column:
    if node.op == "AND":
        return false_form(node.args[0], fields) | (true_form(node.args[0], fields) & false_form(node.args[1], fields))
    if node.op == "OR":
        return false_form(node.args[0], fields) & false_form(node.args[1], fields)
    if node.op == "NOT":
        return true_form(node.args[0], fields)
    return ~leaf(node, fields)


#: Trees up to this depth are written out in the two forms.
WRITTEN_OUT = 12


def deep_form(node: Filter, fields: Fields) -> Column:
    """true, false or NULL of a deep tree. Each subtree stands once, bound to
    a name by a one-element array, since written out a tree of alternating
    AND and OR doubles with every level."""
    if node.op in ("AND", "OR"):
        right = deep_form(node.args[1], fields)
        goes_on = (lambda x: x) if node.op == "AND" else (lambda x: ~x)
        return F.get(F.transform(F.array(deep_form(node.args[0], fields)), lambda x: F.when(goes_on(x), right).otherwise(x)), F.lit(0))
    if node.op == "NOT":
        return ~deep_form(node.args[0], fields)
    return leaf(node, fields)


def tree_of(filter_: str | Filter | None) -> Filter:
    if filter_ is None:
        return Filter.match_all()
    return parse(filter_) if isinstance(filter_, str) else filter_


def keep(df: DataFrame, filter_: str | Filter | None, dynamic: str | None = None) -> DataFrame:
    """The rows for which a filter is true; dynamic: a variant column whose
    keys are fields too."""
    if filter_ is None:
        return df
    tree, fields = tree_of(filter_), Fields(df, dynamic)
    return df.where(true_form(tree, fields) if tree.depth() <= WRITTEN_OUT else deep_form(tree, fields))


def evaluate(df: DataFrame, filter_: str | Filter, dynamic: str | None = None) -> Column:
    """true, false, or NULL where the filter is in error."""
    tree, fields = tree_of(filter_), Fields(df, dynamic)
    if tree.depth() > WRITTEN_OUT:
        return deep_form(tree, fields)
    return F.when(true_form(tree, fields), F.lit(True)).when(false_form(tree, fields), F.lit(False))
