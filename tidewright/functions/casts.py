"""Text to typed columns: a value that cannot be read becomes NULL and never fails the job.

Every function takes and returns Columns, stays inside Catalyst expressions, and does not depend
on the session's ANSI setting.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewright.functions import formats as fm
from tidewright.operators.aggregates import facts_in_one_pass
from tidewright.specs import TEXT_TYPES, ColumnSpec, TableDef

# Text shapes of epoch milliseconds and of spreadsheet serial numbers.
EPOCH_MS_SCIENTIFIC = r"^\d+\.?\d*[Ee][+-]?\d+$"
EPOCH_MS_PLAIN = r"^\d{12,}$"
SERIAL_DATE = r"^[0-9]{4,6}$"
SERIAL_DATETIME = r"^[0-9]{4,6}(\.[0-9]+)?$"
SERIAL_DAY_ZERO = "1899-12-30"

_LAST_SECOND = 253402300799  # 9999-12-31 23:59:59


def clean_number(c: Column) -> Column:
    """Trim, drop one leading dollar sign, blank to NULL."""
    return F.nullif(F.trim(F.regexp_replace(F.trim(c), r"^\$", "")), F.lit(""))


# Texts that the casts below can read. Anything else is turned into NULL before the cast: a failed
# cast inside Spark costs an exception per row, a regular expression does not.
WHOLE_NUMBER = r"^[+-]?\d+$"
PLAIN_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
ANY_NUMBER = r"(?i)^[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?[df]?|inf(inity)?|nan)$"
# Spark's spellings of truth values.
TRUTH = ("t", "true", "y", "yes", "1", "f", "false", "n", "no", "0")


def fitting(text: Column, pattern: str) -> Column:
    return F.when(text.rlike(pattern), text)


def whole(text: Column, to: T.DataType | str) -> Column:
    return fitting(text, WHOLE_NUMBER).try_cast(to)


def double(text: Column) -> Column:
    return fitting(F.trim(text), ANY_NUMBER).try_cast("double")


def to_integer(c: Column, bits: int = 32) -> Column:
    return whole(clean_number(c), "bigint" if bits == 64 else "int")


def to_decimal(c: Column, precision: int, scale: int) -> Column:
    return fitting(clean_number(c), PLAIN_NUMBER).try_cast(T.DecimalType(precision, scale))


def to_double(c: Column) -> Column:
    return double(clean_number(c))


def to_boolean(c: Column) -> Column:
    text = F.lower(F.trim(c))
    return F.when(text.isin(*TRUTH), text).try_cast("boolean")


def parse_with(c: Column, fmt: str) -> Column:
    """Timestamp read with one specification format, NULL where it does not fit exactly."""
    guarded = F.when(c.rlike(fm.width_regex(fmt)), c)
    return F.try_to_timestamp(guarded, F.lit(fm.java_pattern(fmt))).cast("timestamp_ntz")


# Characters that a text and the format that reads it have in common or both lack.
MARKS = ("/", "-", ":")


def first_format(c: Column, fmts: list[str]) -> Column:
    """The first format that reads the text wins.

    The formats are sorted into classes by the marks they contain, so a text is only tried against
    formats of its own class; the order inside a class is kept.
    """
    if not fmts:
        return F.lit(None).cast("timestamp_ntz")
    classes: dict[tuple[bool, ...], list[str]] = {}
    for fmt in fmts:
        classes.setdefault(tuple(m in fmt for m in MARKS), []).append(fmt)
    out = None
    for marks, members in classes.items():
        alike = F.lit(True)
        for mark, present in zip(MARKS, marks):
            held = F.contains(c, F.lit(mark))
            alike = alike & (held if present else ~held)
        parsed = F.coalesce(*[parse_with(c, fmt) for fmt in members])
        out = F.when(alike, parsed) if out is None else out.when(alike, parsed)
    return out


def parse_default(c: Column) -> Column:
    """Timestamp without a declared format: ISO text only, so a bare time of day is NULL."""
    text = F.trim(c)
    return F.try_to_timestamp(F.when(text.rlike(r"^\d{4}-"), text)).cast("timestamp_ntz")


def to_timestamp(c: Column, fmt: str | None = None) -> Column:
    if fmt is None:
        return parse_default(c)
    if fmt == "EPOCH_MS":
        return from_epoch_ms(c)
    if fmt not in fm.REGISTRY:
        raise ValueError(f"format {fmt!r} is not in the registry")
    return parse_with(c, fmt)


def to_date(c: Column, fmt: str | None = None) -> Column:
    if fmt == "EXCEL_SERIAL":
        return from_serial_date(c)
    return to_timestamp(c, fmt).cast("date")


def _from_seconds(seconds: Column) -> Column:
    """Wall-clock UTC timestamp of seconds since 1970, whatever the session time zone."""
    fits = F.when(F.abs(seconds) <= _LAST_SECOND, seconds)
    zero = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return zero + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), fits.cast("decimal(18,6)"))


def looks_like_epoch_ms(c: Column) -> Column:
    return c.rlike(EPOCH_MS_SCIENTIFIC) | c.rlike(EPOCH_MS_PLAIN)


def epoch_ms_value(c: Column, millis: bool = False) -> Column:
    """Epoch milliseconds to a timestamp, cut to whole seconds unless ``millis``."""
    ms = double(c)
    # the range test comes first: a double beyond a bigint would fail floor's result type
    ms = F.when(F.abs(ms) <= _LAST_SECOND * 1000.0, ms)
    seconds = ms.cast("bigint") / F.lit(1000).cast("decimal(4,0)") if millis else F.floor(ms / 1000)
    return _from_seconds(seconds)


def from_epoch_ms(c: Column, millis: bool = False) -> Column:
    text = F.trim(c)
    return F.when(looks_like_epoch_ms(text), epoch_ms_value(text, millis)).otherwise(
        parse_default(text)
    )


def from_serial_date(c: Column) -> Column:
    return F.date_add(F.lit(SERIAL_DAY_ZERO).cast("date"), whole(F.trim(c), "int"))


def from_serial_datetime(c: Column) -> Column:
    """Spreadsheet serial: whole days since day zero plus the fraction of a day."""
    serial = fitting(F.trim(c), PLAIN_NUMBER).try_cast("decimal(18,10)")
    days = F.floor(serial).cast("int")
    seconds = F.floor((serial - F.floor(serial)) * 86400).cast("decimal(18,6)")
    start = F.date_add(F.lit(SERIAL_DAY_ZERO).cast("date"), days).cast("timestamp_ntz")
    return start + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)


def single_spaced(c: Column) -> Column:
    """Trimmed, with every run of white space as one space."""
    return F.regexp_replace(F.trim(c), r"\s+", " ")


def flexible_timestamp(
    c: Column, primary: str | None = None, fallbacks: list[str] | None = None
) -> Column:
    """Ordered formats, with epoch milliseconds recognised first."""
    order = [f for f in [primary, *(fallbacks or [])] if f]
    text = F.trim(c)
    return F.when(looks_like_epoch_ms(text), epoch_ms_value(text)).otherwise(first_format(c, order))


def auto_date(
    c: Column, fmt: str | None = None, serials: bool = True, spaced: bool = False
) -> Column:
    """Any registry format, then date-time formats cut to the day; 4-6 digits may be serials.

    ``spaced`` says that the column already went through ``single_spaced``, in a projection of its
    own: it is read once per format.
    """
    text = c if spaced else single_spaced(c)
    parsed = first_format(text, fm.parse_order(fmt)).cast("date")
    if not serials:
        return parsed
    return F.when(text.rlike(SERIAL_DATE), from_serial_date(text)).otherwise(parsed)


def auto_timestamp(c: Column, fmt: str | None = None, spaced: bool = False) -> Column:
    """Epoch milliseconds, then spreadsheet serials, then the formats."""
    text = c if spaced else single_spaced(c)
    return (
        F.when(looks_like_epoch_ms(text), epoch_ms_value(text))
        .when(text.rlike(SERIAL_DATETIME), from_serial_datetime(text))
        .otherwise(first_format(text, fm.parse_order(fmt)))
    )


NUMERIC_KINDS = ("INTEGER", "BIGINT", "SMALLINT", "TINYINT", "DECIMAL", "FLOAT", "DOUBLE")


def prepared_text(c: Column, spec: ColumnSpec) -> Column:
    """The text as the reading below wants it: numbers cleaned, truth values trimmed."""
    if spec.kind in NUMERIC_KINDS:
        return clean_number(c)
    return F.lower(F.trim(c)) if spec.kind == "BOOLEAN" else c


def read_text(text: Column, spec: ColumnSpec) -> Column:
    """Prepared text to the type its specification names."""
    kind = spec.kind
    if kind in TEXT_TYPES:
        return text
    if kind == "DECIMAL":
        return fitting(text, PLAIN_NUMBER).try_cast(spec.spark_type)
    if kind in ("FLOAT", "DOUBLE"):
        return fitting(text, ANY_NUMBER).try_cast("double")
    if kind in NUMERIC_KINDS:
        return whole(text, spec.spark_type)
    if kind == "BOOLEAN":
        return F.when(text.isin(*TRUTH), text).try_cast("boolean")
    if kind == "DATE":
        return to_date(text, spec.format)
    if kind in ("DATETIME", "TIMESTAMP"):
        return to_timestamp(text, spec.format)
    if kind == "EMBEDDING":
        return F.from_json(text, "array<float>")
    raise ValueError(f"unknown column type {spec.type!r}")


def cast_text(c: Column, spec: ColumnSpec) -> Column:
    """One text column to the type its specification names."""
    return read_text(prepared_text(c, spec), spec)


def cast_typed(c: Column, spec: ColumnSpec) -> Column:
    """A natively typed source column: type to type, without text cleaning."""
    return c.try_cast(spec.spark_type)


def cast_table(
    df: DataFrame, spec: TableDef, keep: tuple[str, ...] = (), native: bool | None = None
) -> DataFrame:
    """Every specified column in declared order.

    ``native=None`` decides per column: text columns are parsed, others are cast directly. Text is
    prepared in a first projection and read in a second, so that each text is prepared once.
    """
    names = {c.name for c in spec.columns}
    first, second = [], []
    for column in spec.columns:
        if column.expression:
            first.append(F.expr(column.expression).alias(column.name))
            second.append(F.col(column.name))
            continue
        as_text = isinstance(df.schema[column.name].dataType, T.StringType)
        if (not as_text) if native is None else native:
            first.append(cast_typed(F.col(column.name), column).alias(column.name))
            second.append(F.col(column.name))
        else:
            first.append(prepared_text(F.col(column.name), column).alias(column.name))
            second.append(read_text(F.col(column.name), column).alias(column.name))
    kept = [k for k in keep if k not in names]
    return df.select(*first, *kept).select(*second, *kept)


def format_hits(df: DataFrame, columns: list[str], fmts: list[str] | None = None) -> DataFrame:
    """For each text column and registry format, how many non-null rows the format reads.

    One aggregate over all rows and all column-format pairs; the long form is made afterwards.
    """
    fmts = fmts or parse_candidates()
    counts = [
        F.struct(
            F.lit(name).alias("column_name"),
            F.lit(fmt).alias("format"),
            F.lit(rank).alias("preference"),
            F.count(name).alias("non_null"),
            F.count_if(parse_with(F.col(name), fmt).isNotNull()).alias("parsed"),
        )
        for name in columns
        for rank, fmt in enumerate(fmts)
    ]
    return facts_in_one_pass(df, counts)


def parse_candidates() -> list[str]:
    return fm.parse_order()


def suggest_format(df: DataFrame, columns: list[str]) -> DataFrame:
    """The format that reads most rows of each column; the registry order breaks ties."""
    hits = format_hits(df, columns)
    best = F.max_by(F.struct("format", "parsed", "non_null"), F.struct("parsed", -F.col("preference")))
    return (
        hits.groupBy("column_name")
        .agg(best.alias("b"))
        .select(
            "column_name",
            F.when(F.col("b.parsed") > 0, F.col("b.format")).alias("format"),
            F.when(F.col("b.non_null") > 0, F.round(F.col("b.parsed") / F.col("b.non_null"), 6))
            .otherwise(F.lit(0.0))
            .alias("share"),
        )
    )
