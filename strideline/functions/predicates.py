"""Filter specs to boolean Columns, checked against a schema.

A predicate never touches data: it is a Column, so Catalyst merges it with the
other filters and pushes it into the scan.
"""

from __future__ import annotations

import operator as op
from collections.abc import Iterable, Sequence
from datetime import date, datetime, time, timedelta
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strideline.specs import MAX_IMPACT_EVENTS, EventMatch, Filter, SpecError

# Operators each column kind accepts.
TEXT_OPERATORS = {"=", "!=", "IN", "NOT IN"}
NUMERIC_OPERATORS = TEXT_OPERATORS | {"<", ">", "<=", ">="}
BOOLEAN_OPERATORS = {"=", "!="}
TIMESTAMP_OPERATORS = {"BEFORE", "AFTER", "ON", "BETWEEN", "IN", "NOT IN"}

_COMPARE = {"=": op.eq, "!=": op.ne, "<": op.lt, ">": op.gt, "<=": op.le, ">=": op.ge}


def kind_of(data_type: T.DataType) -> str:
    """TEXT, NUMERIC, TIMESTAMP or BOOLEAN for a storage type."""
    if isinstance(data_type, T.BooleanType):
        return "BOOLEAN"
    if isinstance(data_type, T.NumericType):
        return "NUMERIC"
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "TIMESTAMP"
    return "TEXT"


def single_value(value: Any) -> Any:
    """A one-element list stands for its element; nested lists are rejected."""
    if isinstance(value, (list, tuple)):
        if any(isinstance(item, (list, tuple)) for item in value):
            raise SpecError("filter values cannot be nested lists")
        if len(value) == 1:
            return value[0]
    return value


def value_list(value: Any) -> list[Any]:
    values = list(value) if isinstance(value, (list, tuple, set)) else [value]
    if not values:
        raise SpecError("IN and NOT IN need at least one value")
    if any(isinstance(item, (list, tuple)) for item in values):
        raise SpecError("filter values cannot be nested lists")
    return values


def parse_instant(value: Any) -> datetime:
    """A zone-free instant at second precision; a zone suffix is dropped, not applied."""
    if isinstance(value, datetime):
        return value.replace(tzinfo=None, microsecond=0)
    if isinstance(value, date):
        return datetime.combine(value, time())
    text = str(value).strip().strip('"')
    if text.upper().endswith("UTC"):
        text = text[:-3].rstrip()
    text = text.replace("T", " ")
    if len(text) == 13 and text[10] == " ":
        text += ":00"
    try:
        return datetime.fromisoformat(text).replace(tzinfo=None, microsecond=0)
    except ValueError as error:
        raise SpecError(f"not a timestamp: {value!r}") from error


def _parse_day(value: Any) -> date:
    try:
        return date.fromisoformat(str(value).strip())
    except ValueError as error:
        raise SpecError(f"not a date: {value!r}") from error


def _parse_clock(value: Any) -> time:
    if value is None or not str(value).strip():
        return time()
    text = str(value).strip()
    try:
        return time.fromisoformat(text if ":" in text else f"{text}:00")
    except ValueError as error:
        raise SpecError(f"not a time of day: {value!r}") from error


def instant(value: datetime) -> Column:
    return F.lit(value.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp_ntz")


def _within(column: Column, start: datetime, end: datetime) -> Column:
    return (column >= instant(start)) & (column < instant(end))


def timestamp_predicate(column: Column, operator: str, value: Any) -> Column:
    """BEFORE, AFTER, ON, BETWEEN on half-open ranges, and IN / NOT IN of instants."""
    name = operator.upper()
    if name == "=" and not isinstance(value, dict):
        name, value = "ON", {"date": parse_instant(single_value(value)).date().isoformat()}
    if name not in TIMESTAMP_OPERATORS:
        raise SpecError(f"operator {operator} does not apply to timestamps")
    if name in ("IN", "NOT IN"):
        member = column.isin([instant(parse_instant(item)) for item in value_list(value)])
        return member if name == "IN" else ~member
    if not isinstance(value, dict):
        raise SpecError(f"{name} needs a structured value")
    if name == "BETWEEN":
        start = datetime.combine(_parse_day(value.get("startDate")), _parse_clock(value.get("startTime")))
        end_day, end_clock = _parse_day(value.get("endDate")), value.get("endTime")
        if end_clock is None or not str(end_clock).strip():
            end = datetime.combine(end_day + timedelta(days=1), time())
        else:
            end = datetime.combine(end_day, _parse_clock(end_clock))
        if end <= start:
            raise SpecError("BETWEEN must end after it starts")
        return _within(column, start, end)
    day = _parse_day(value.get("date"))
    if name == "ON":
        start = datetime.combine(day, time())
        return _within(column, start, start + timedelta(days=1))
    threshold = instant(datetime.combine(day, _parse_clock(value.get("time"))))
    return column < threshold if name == "BEFORE" else column >= threshold


def compare(column: Column, operator: str, value: Any) -> Column:
    """Scalar comparison or list membership; NULL never matches."""
    name = operator.upper()
    if name in ("IN", "NOT IN"):
        member = column.isin(value_list(value))
        return member if name == "IN" else ~member
    scalar = single_value(value)
    if isinstance(scalar, (list, tuple)):
        raise SpecError(f"{operator} takes one value")
    return _COMPARE[name](column, F.lit(scalar))


def predicate(schema: T.StructType, spec: Filter, *, strict_boolean: bool = False) -> Column:
    """The Column for one filter, after checking column, operator and value."""
    if spec.column not in schema.fieldNames():
        raise SpecError(f"unknown column {spec.column!r}")
    kind = kind_of(schema[spec.column].dataType)
    name = spec.operator.upper()
    column = F.col(spec.column)
    if kind == "TIMESTAMP":
        return timestamp_predicate(column, name, spec.value)
    allowed = {
        "TEXT": TEXT_OPERATORS,
        "NUMERIC": NUMERIC_OPERATORS,
        "BOOLEAN": BOOLEAN_OPERATORS if strict_boolean else TEXT_OPERATORS,
    }[kind]
    if name not in allowed:
        raise SpecError(f"operator {spec.operator} does not apply to {kind} column {spec.column!r}")
    return compare(column, name, spec.value)


def all_of(columns: Iterable[Column]) -> Column:
    return reduce(op.and_, columns, F.lit(True))


def any_of(columns: Iterable[Column]) -> Column:
    return reduce(op.or_, columns, F.lit(False))


def scope_predicate(
    schema: T.StructType,
    filters: Sequence[Filter] = (),
    date_from: Any = None,
    date_to: Any = None,
    time_column: str = "event_time",
) -> Column:
    """All filters and the date range together; the end day is included whole."""
    parts = [predicate(schema, spec) for spec in filters]
    start = _parse_day(date_from) if date_from is not None else None
    end = _parse_day(date_to) if date_to is not None else None
    if start and end and start > end:
        raise SpecError("the date range ends before it starts")
    if start:
        parts.append(F.col(time_column) >= instant(datetime.combine(start, time())))
    if end:
        parts.append(F.col(time_column) < instant(datetime.combine(end + timedelta(days=1), time())))
    return all_of(parts)


def text_predicate(spec: Filter) -> Column:
    """Compares the column's text form; only equality and membership."""
    name = spec.operator.upper()
    if name not in TEXT_OPERATORS:
        raise SpecError(f"operator {spec.operator} is not one of = != IN NOT IN")
    values = [str(item) for item in value_list(spec.value)]
    if "IN" not in name and len(values) > 1:
        raise SpecError(f"{spec.operator} takes one value")
    return compare(F.col(spec.column).cast("string"), name, values)


def root_predicate(schema: T.StructType, spec: Filter | None) -> Column:
    """Like :func:`predicate`, but no values at all means no filter."""
    if spec is None or (isinstance(spec.value, (list, tuple)) and not spec.value):
        return F.lit(True)
    return predicate(schema, spec)


def _typed_value(name: str, value: Any, data_type: T.DataType) -> Column:
    if isinstance(data_type, T.NumericType):
        try:
            int(value) if isinstance(data_type, T.IntegralType) else float(value)
        except (TypeError, ValueError) as error:
            raise SpecError(f"{value!r} is no value of {name!r}") from error
    return F.lit(value).cast(data_type)


def event_predicate(schema: T.StructType, match: EventMatch) -> Column:
    """Event name and every property equal, with values cast to the column's type."""
    parts = [F.col("event_name") == match.event_name]
    for name, value in match.filters.items():
        if name not in schema.fieldNames():
            raise SpecError(f"unknown column {name!r}")
        parts.append(F.col(name) == _typed_value(name, value, schema[name].dataType))
    return all_of(parts)


def event_set(schema: T.StructType, matches: Sequence[EventMatch | str]) -> Column:
    """True if any of the matches holds."""
    if len(matches) > MAX_IMPACT_EVENTS:
        raise SpecError(f"at most {MAX_IMPACT_EVENTS} events per set")
    specs = [m if isinstance(m, EventMatch) else EventMatch(m) for m in matches]
    return any_of(event_predicate(schema, spec) for spec in specs)


def search_predicate(column: Column, text: str) -> Column:
    """Case-insensitive prefix search up to two characters, substring search beyond."""
    escaped = text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    pattern = f"{escaped}%" if len(text) <= 2 else f"%{escaped}%"
    return column.cast("string").ilike(pattern)
