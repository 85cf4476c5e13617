"""Row-level checks as Columns: which rows are in scope and which of those are unexpected."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewright.functions import casts, formats
from tidewright.functions.domains import BY_NAME, breaks_domain
from tidewright.specs import Check, ColumnSpec


class Unsupported(ValueError):
    """The check cannot be evaluated; its result is a failure, never a silent pass."""


@dataclass(frozen=True)
class RowRule:
    """``bad`` is evaluated inside ``scope`` only; ``value`` is what a sample shows."""

    scope: Column
    bad: Column
    value: Column


Builder = Callable[[Check, T.StructType], RowRule]
ROW_RULES: dict[str, Builder] = {}


def rule(*names: str):
    def register(fn: Builder) -> Builder:
        for name in names:
            ROW_RULES[name] = fn
        return fn

    return register


def column_of(check: Check, schema: T.StructType, name: str | None = None) -> Column:
    name = name or check.column
    if name is None or name not in schema.fieldNames():
        raise Unsupported(f"column {name!r} is not in the table")
    return F.col(f"`{name}`")


def param(check: Check, name: str):
    if name not in check.params:
        raise Unsupported(f"parameter {name!r} is missing")
    return check.params[name]


def on_values(check: Check, schema: T.StructType, bad: Callable[[Column], Column]) -> RowRule:
    c = column_of(check, schema)
    return RowRule(c.isNotNull(), bad(c), c)


@rule("column_values_to_not_be_null")
def _not_null(check, schema):
    c = column_of(check, schema)
    return RowRule(F.lit(True), c.isNull(), c)


@rule("column_values_to_be_null")
def _null(check, schema):
    c = column_of(check, schema)
    return RowRule(F.lit(True), c.isNotNull(), c)


@rule("column_values_to_be_in_set", "accepted_values", "column_distinct_values_to_be_in_set")
def _in_set(check, schema):
    values = list(param(check, "value_set"))
    return on_values(check, schema, lambda c: ~c.isin(*values))


@rule("column_values_to_not_be_in_set")
def _not_in_set(check, schema):
    values = list(param(check, "value_set"))
    return on_values(check, schema, lambda c: c.isin(*values))


@rule("column_values_to_be_between")
def _between(check, schema):
    low, high = check.params.get("min_value"), check.params.get("max_value")
    if low is None and high is None:
        raise Unsupported("min_value or max_value is needed")
    numeric = all(isinstance(b, (int, float)) for b in (low, high) if b is not None)
    dtype = schema[check.column].dataType if check.column in schema.fieldNames() else None

    def bad(c: Column) -> Column:
        # text that is no number lies outside every numeric range
        v = casts.double(c) if numeric and isinstance(dtype, T.StringType) else c
        inside = F.lit(True)
        strict_low, strict_high = check.params.get("strict_min"), check.params.get("strict_max")
        if low is not None:
            bound = F.lit(low) if numeric else F.lit(low).cast(dtype)
            inside = inside & ((v > bound) if strict_low else (v >= bound))
        if high is not None:
            bound = F.lit(high) if numeric else F.lit(high).cast(dtype)
            inside = inside & ((v < bound) if strict_high else (v <= bound))
        return ~F.coalesce(inside, F.lit(False))

    return on_values(check, schema, bad)


@rule("column_values_to_match_regex")
def _regex(check, schema):
    pattern = param(check, "regex")
    return on_values(check, schema, lambda c: ~c.cast("string").rlike(pattern))


@rule("column_values_to_not_match_regex")
def _not_regex(check, schema):
    pattern = param(check, "regex")
    return on_values(check, schema, lambda c: c.cast("string").rlike(pattern))


def _hits(c: Column, patterns: list[str], need_all: bool) -> Column:
    tests = [c.cast("string").rlike(p) for p in patterns]
    out = tests[0]
    for t in tests[1:]:
        out = (out & t) if need_all else (out | t)
    return out


@rule("column_values_to_match_regex_list")
def _regex_list(check, schema):
    patterns = list(param(check, "regex_list"))
    need_all = check.params.get("match_on", "any") == "all"
    return on_values(check, schema, lambda c: ~_hits(c, patterns, need_all))


@rule("column_values_to_not_match_regex_list")
def _not_regex_list(check, schema):
    patterns = list(param(check, "regex_list"))
    return on_values(check, schema, lambda c: _hits(c, patterns, False))


def _measure(check: Check, schema: T.StructType, c: Column) -> Column:
    dtype = schema[check.column].dataType
    return F.size(c) if isinstance(dtype, (T.ArrayType, T.MapType)) else F.length(c)


@rule("column_value_lengths_to_be_between")
def _lengths(check, schema):
    low, high = check.params.get("min_value"), check.params.get("max_value")

    def bad(c: Column) -> Column:
        n = _measure(check, schema, c)
        out = F.lit(False)
        if low is not None:
            out = out | (n < low)
        return (out | (n > high)) if high is not None else out

    return on_values(check, schema, bad)


@rule("column_value_lengths_to_equal")
def _length_equals(check, schema):
    want = param(check, "value")
    column_of(check, schema)
    dtype = schema[check.column].dataType

    def bad(c: Column) -> Column:
        if not isinstance(dtype, T.ArrayType):
            return _measure(check, schema, c) != want
        real = isinstance(dtype.elementType, (T.FloatType, T.DoubleType))
        whole = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) if real else x.isNotNull())
        return (F.size(c) != want) | ~whole

    return on_values(check, schema, bad)


@rule("column_values_to_match_strftime_format")
def _strftime(check, schema):
    pattern = formats.strftime_pattern(param(check, "strftime_format"))
    widths = None if formats.has_names(pattern) else formats.pattern_widths(pattern)

    def bad(c):
        text = c.cast("string")
        failed = F.try_to_timestamp(text, F.lit(pattern)).isNull()
        # a failed parse costs an exception, so the widths are tested first
        return failed if widths is None else F.when(text.rlike(widths), failed).otherwise(True)

    return on_values(check, schema, bad)


@rule("column_values_to_cast_to_type")
def _castable(check, schema):
    spec = ColumnSpec(
        check.column or "",
        param(check, "target_type"),
        precision=check.params.get("precision", 10),
        scale=check.params.get("scale", 2),
        bits=check.params.get("bits", 32),
    )
    column_of(check, schema)
    text = isinstance(schema[check.column].dataType, T.StringType)

    def bad(c: Column) -> Column:
        if not text:
            return F.lit(False)
        if spec.kind in ("DATE", "DATETIME", "TIMESTAMP"):
            fmts = formats.parse_order(check.params.get("format"), datetimes=spec.kind != "DATE")
            return casts.first_format(c, fmts).isNull()
        return casts.cast_text(c, spec).isNull()

    return on_values(check, schema, bad)


@rule("column_values_to_be_dateutil_parseable")
def _parseable(check, schema):
    def bad(c: Column) -> Column:
        found = F.coalesce(
            casts.first_format(F.trim(c), formats.parse_order()), casts.parse_default(c)
        )
        return found.isNull()

    return on_values(check, schema, bad)


@rule("column_pair_values_a_to_be_greater_than_b")
def _pair_greater(check, schema):
    a = column_of(check, schema, param(check, "column_A"))
    b = column_of(check, schema, param(check, "column_B"))
    kept = (a >= b) if check.params.get("or_equal", True) else (a > b)
    return RowRule(a.isNotNull() & b.isNotNull(), ~kept, F.struct(a, b))


def _missing_scope(check: Check, columns: list[Column], default: str) -> Column:
    """Rows to judge, by the ``ignore_row_if`` rule."""
    rule_name = check.params.get("ignore_row_if", default)
    missing = [c.isNull() for c in columns]
    if rule_name in ("neither", "never"):
        return F.lit(True)
    joined = missing[0]
    for m in missing[1:]:
        joined = (joined & m) if rule_name.startswith(("both", "all")) else (joined | m)
    return ~joined


@rule("column_pair_values_to_be_equal")
def _pair_equal(check, schema):
    a = column_of(check, schema, param(check, "column_A"))
    b = column_of(check, schema, param(check, "column_B"))
    scope = _missing_scope(check, [a, b], "both_values_are_missing")
    return RowRule(scope, ~a.eqNullSafe(b), F.struct(a, b))


@rule("select_column_values_to_be_unique_within_record")
def _within_record(check, schema):
    columns = [column_of(check, schema, n) for n in param(check, "column_list")]
    held = F.array(*[c.cast("string") for c in columns])
    scope = _missing_scope(check, columns, "all_values_are_missing")
    return RowRule(scope, F.size(F.array_distinct(held)) < len(columns), F.to_json(held))


@rule("column_date_to_be_in_current_year")
def _current_year(check, schema):
    day = check.params.get("reference_date")
    if isinstance(day, str):
        day = dt.date.fromisoformat(day)
    today = F.lit(day) if day is not None else F.current_date()
    return on_values(check, schema, lambda c: F.year(c.try_cast("date")) != F.year(today))


@rule("column_values_to_match_domain_type")
def _domain(check, schema):
    domain = BY_NAME.get(param(check, "domain_type"))
    if domain is None or not domain.has_rules:
        raise Unsupported(f"unknown domain {check.params['domain_type']!r}")
    column_of(check, schema)
    dtype = schema[check.column].dataType
    return on_values(check, schema, lambda c: breaks_domain(c, dtype, domain))


def is_json(c: Column) -> Column:
    """The whole text is one JSON value.

    The parser stops after the first value, so the text is read inside an array and inside an
    object: text after the value breaks at least one of the two.
    """
    in_array = F.try_parse_json(F.concat(F.lit("["), c, F.lit("]")))
    in_object = F.try_parse_json(F.concat(F.lit('{"a":'), c, F.lit("}")))
    return in_array.isNotNull() & in_object.isNotNull()


@rule("column_values_to_be_json_parseable")
def _json(check, schema):
    return on_values(check, schema, lambda c: ~is_json(c))


# JSON schema type names and the variant types that satisfy them.
JSON_TYPES = {
    "integer": ("BIGINT",),
    "number": ("BIGINT", "DOUBLE", "DECIMAL", "FLOAT"),
    "string": ("STRING",),
    "boolean": ("BOOLEAN",),
    "object": ("OBJECT",),
    "array": ("ARRAY",),
}


@rule("column_values_to_match_json_schema")
def _json_schema(check, schema):
    want = param(check, "json_schema")
    required = want.get("required", [])
    types = {k: v.get("type") for k, v in want.get("properties", {}).items()}

    def bad(c: Column) -> Column:
        parsed = F.try_parse_json(c)
        broken = ~is_json(c) | parsed.isNull()
        for key in dict.fromkeys([*required, *types]):
            held = F.try_variant_get(parsed, f"$.{key}", "variant")
            if key in required:
                broken = broken | held.isNull()
            if types.get(key):
                found = F.schema_of_variant(held)
                fits = F.lit(False)
                for name in JSON_TYPES[types[key]]:
                    fits = fits | found.startswith(name)
                broken = broken | (held.isNotNull() & ~fits)
        return F.coalesce(broken, F.lit(True))

    return on_values(check, schema, bad)
