"""Dump files: preamble and footer records, own record ends, comments, null marks, quoted record ends.

One scan finds every file's edges (skipped records, header, footer) under a group limit, and whether any of its lines
leaves a quote open. A second one cuts the records into cells; what a file calls its columns is data, joined by file, so
any number of layouts is one parse. The per-file table is written first: its size decides between a broadcast and a
shuffle, and only its distinct column names come to the driver.

Quoted record ends. A line is a map of two states (outside, inside a quote) to two states: a constant, the identity or a
swap. For files with open quotes, the maps of a block's lines are composed inside the block, the blocks' maps along the
file (one row per block), and then every line knows the line its record began with. No file passes through one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewright.session import scratch_path
from tidewright.sources.dialect import NULL_MARK, Delimited, charset

TERMINATORS = {"CRLF": "\r\n", "LF": "\n", "CR": "\r"}
#: a quote that is open over more lines than this was never meant to be one
MOST_RECORD_LINES = 10_000


class OpenQuote(ValueError):
    """A quote that is not closed within ``MOST_RECORD_LINES`` lines."""


def _char(c: str) -> str:
    return f"\\x{{{ord(c):x}}}"


class CellPatterns:
    """Regular expressions of one dialect: fields, quoted or not, and lines that end inside a quote.

    A quote counts at the start of a field only; inside, a doubled quote is one; what follows the closing quote up to the
    delimiter belongs to the field. All loops are possessive: linear time and no recursion on long lines.
    """

    def __init__(self, how: Delimited):
        self.delimiter = "".join(map(_char, how.delimiter))
        first = _char(how.delimiter[0])
        self.escape = _char(how.escape) if how.escape and how.escape != how.quote else ""
        escaped = f"{self.escape}(?:[\\s\\S]|\\z)" if self.escape else ""
        later = f"(?!{self.delimiter}){first}" + (f"|{escaped}" if escaped else "")
        self.plain = f"[^{first}{self.escape}]*+(?:(?:{later})[^{first}{self.escape}]*+)*+"
        self.quote = _char(how.quote) if how.quote else ""
        if self.quote:
            q = self.quote
            pair = f"{q}{q}" + (f"|{escaped}" if escaped else "")
            self.inside = f"[^{q}{self.escape}]*+(?:(?:{pair})[^{q}{self.escape}]*+)*+"
            closed = f"(?:{q}{self.inside}{q}{self.plain}|(?!{q}){self.plain})"
            opened = f"{q}{self.inside}\\z"
            #: a line that begins outside, or inside, a quote and ends inside one
            self.opens = f"\\A(?:{closed}{self.delimiter})*+{opened}"
            self.stays = f"\\A{self.inside}(?:\\z|{q}{self.plain}(?:{self.delimiter}{closed})*+{self.delimiter}{opened})"

    def cells(self, record: Column) -> Column:
        """The record's fields as an array, quotes and escapes resolved."""
        field = self.plain
        if self.quote:
            field = f"{self.quote}{self.inside}(?:{self.quote}{self.plain}|\\z)|{self.plain}"
        elif not self.escape:
            return F.split(record, self.delimiter, -1)
        found = F.regexp_extract_all(F.concat(F.lit(self._first_delimiter), record), F.lit(f"{self.delimiter}({field})"), F.lit(1))
        return F.transform(found, self._resolved)

    @property
    def _first_delimiter(self) -> str:
        return "".join(chr(int(x, 16)) for x in self.delimiter.replace("\\x{", "").split("}") if x)

    def _resolved(self, field: Column) -> Column:
        def escapes(c: Column) -> Column:
            return F.regexp_replace(c, f"{self.escape}([\\s\\S])", "$1") if self.escape else c

        if not self.quote:
            return escapes(field)
        inner = F.regexp_extract(field, f"\\A{self.quote}({self.inside})", 1)
        tail = F.regexp_extract(field, f"\\A{self.quote}{self.inside}{self.quote}([\\s\\S]*)", 1)
        marks = f"{self.quote}(?={self.quote})" + (f"|{self.escape}" if self.escape else "")
        inner = F.regexp_replace(inner, f"(?:{marks})([\\s\\S])", "$1")
        return F.when(field.rlike(f"\\A{self.quote}"), F.concat(inner, escapes(tail))).otherwise(escapes(field))


def _lines(spark: SparkSession, path: str | Sequence[str], how: Delimited) -> DataFrame:
    """Physical records with their file and a position that increases within the file.

    A file is read in blocks; inside a block the generated id increases, so (block start, id)
    orders the records of a file without sorting or numbering them.
    """
    reader = spark.read.option("encoding", charset(how.encoding))
    if how.line_terminator:
        end = how.line_terminator.strip() or how.line_terminator
        reader = reader.option("lineSep", TERMINATORS.get(end.upper(), end))
    return reader.text(path).select(
        F.col("_metadata.file_path").alias("_file"),
        F.struct(F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i")).alias("_pos"),
        "value",
    )


def _stored(df: DataFrame, label: str) -> DataFrame:
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _is_comment(how: Delimited) -> Column:
    return F.startswith(F.col("value"), F.lit(how.comment)) if how.comment else F.lit(False)


def _file_edges(lines: DataFrame, how: Delimited, patterns: CellPatterns) -> DataFrame:
    """Per file, from one scan: the last skipped and the first footer position, the first line after, open quotes.

    The first line of content is among the first ``skip_rows`` + 1 that are no comments, so every side is limited.
    """
    at = F.col("_pos")
    text = F.lit(None).cast("string")
    limits = {"head": how.skip_rows + 1}
    sides = [F.when((F.col("value") != "") & ~_is_comment(how),
                    F.struct(F.lit("head").alias("side"), at["b"].alias("b"), at["i"].alias("i"), F.col("value").alias("text")))]
    if how.skip_rows:
        limits["skip"] = how.skip_rows
        sides.append(F.struct(F.lit("skip").alias("side"), at["b"].alias("b"), at["i"].alias("i"), text.alias("text")))
    if how.footer_rows:
        limits["foot"] = how.footer_rows
        sides.append(F.struct(F.lit("foot").alias("side"), (-at["b"]).alias("b"), (-at["i"]).alias("i"), text.alias("text")))
    if how.quote:
        limits["open"] = 1
        sides.append(F.when(F.col("value").rlike(patterns.opens),
                            F.struct(F.lit("open").alias("side"), at["b"].alias("b"), at["i"].alias("i"), text.alias("text"))))
    each = lines.select("_file", F.explode(F.array_compact(F.array(*sides))).alias("s")).select("_file", "s.*")
    rank = F.row_number().over(Window.partitionBy("_file", "side").orderBy("b", "i"))
    ranked = each.withColumn("rank", rank).filter(F.col("rank") <= max(limits.values()))

    def of(side: str) -> Column:
        return (F.col("side") == side) & (F.col("rank") <= limits.get(side, 0))

    here = F.struct("b", "i")
    per = ranked.groupBy("_file").agg(
        F.max(F.when(of("skip"), here)).alias("_skip"),
        F.min(F.when(of("foot"), F.struct((-F.col("b")).alias("b"), (-F.col("i")).alias("i")))).alias("_foot"),
        F.sort_array(F.collect_list(F.when(of("head"), F.struct(here.alias("pos"), "text")))).alias("_heads"),
        F.coalesce(F.max(of("open")), F.lit(False)).alias("_broken"),
    )
    inside = lambda h: F.coalesce(h["pos"] > F.col("_skip"), F.lit(True)) & F.coalesce(h["pos"] < F.col("_foot"), F.lit(True))
    return per.withColumn("_head", F.get(F.filter("_heads", inside), F.lit(0))).drop("_heads")


def _layouts(edges: DataFrame, how: Delimited, columns: Sequence[str] | None, patterns: CellPatterns) -> DataFrame:
    """The edges with what each file calls its cells: its header's names, the given ones, or column0, column1, ..."""
    first = patterns.cells(F.col("_head")["text"])
    if how.header:
        named = F.transform(first, lambda x, i: F.when(F.trim(x) == "", F.concat(F.lit("_c"), i.cast("string"))).otherwise(F.trim(x)))
        width = F.array_max(F.transform(first, lambda x, i: F.when(F.trim(x) != "", i + 1)))
        names = F.slice(named, F.lit(1), F.coalesce(width, F.lit(0)))
    elif columns is not None:
        names = F.array(*[F.lit(c) for c in columns])
    else:
        names = F.transform(first, lambda x, i: F.concat(F.lit("column"), i.cast("string")))
    return edges.withColumn("_names", names).filter("_head is not null")


def _whole_records(lines: DataFrame) -> DataFrame:
    """_file, _pos, value: lines of files with open quotes (``opens``, ``stays``) joined to records by line breaks.

    Inside a block a running count of swaps and the last constant give every line's end as a function of the block's
    start, and for both starts the position its record begins at.
    """
    spark = lines.sparkSession
    const = F.col("opens") == F.col("stays")
    swap = (F.col("opens") & ~F.col("stays")).cast("int")
    within = Window.partitionBy("_file", "block").orderBy("_pos")
    so_far = within.rowsBetween(Window.unboundedPreceding, 0)
    before = within.rowsBetween(Window.unboundedPreceding, -1)
    # a line's end: the last constant with the swaps since, or the block's start with all swaps
    placed = lines.withColumn("block", F.col("_pos")["b"]).withColumn("swaps", F.sum(swap).over(so_far))
    placed = placed.withColumn("fixed", F.when(const, F.col("opens").cast("int") + F.col("swaps")))
    placed = placed.withColumn("fixed", F.last("fixed", ignorenulls=True).over(so_far))
    placed = placed.withColumn("was_fixed", F.last("fixed").over(before)).withColumn("was_swaps", F.coalesce(F.last("swaps").over(before), F.lit(0)))
    for start in (0, 1):
        begins = (F.coalesce("was_fixed", F.lit(start)) + F.col("was_swaps")) % 2 == 0
        placed = placed.withColumn(f"from{start}", F.last(F.when(begins, F.col("_pos")), ignorenulls=True).over(so_far))
    placed = _stored(placed.select("_file", "block", "_pos", "value", "fixed", "swaps", "from0", "from1"), "dump-lines")

    ends = F.max_by(F.struct("fixed", "swaps", "from0", "from1"), "_pos")
    blocks = placed.groupBy("_file", "block").agg(ends.alias("end")).select("_file", "block", "end.*")
    along = Window.partitionBy("_file").orderBy("block")
    to_here, to_last = along.rowsBetween(Window.unboundedPreceding, 0), along.rowsBetween(Window.unboundedPreceding, -1)
    # the same along the file, where a block is a constant (its last one and the swaps since) or swaps
    blocks = blocks.withColumn("turns", F.sum(F.when(F.col("fixed").isNull(), F.col("swaps")).otherwise(F.lit(0))).over(to_here))
    blocks = blocks.withColumn("set", F.when(F.col("fixed").isNotNull(), F.col("fixed") + F.col("swaps") + F.col("turns")))
    blocks = blocks.withColumn("set", F.last("set", ignorenulls=True).over(to_here))
    blocks = blocks.withColumn("start", (F.coalesce(F.last("set").over(to_last), F.lit(0)) + F.coalesce(F.last("turns").over(to_last), F.lit(0))) % 2)
    last_record = F.when(F.col("start") == 0, F.col("from0")).otherwise(F.col("from1"))
    blocks = blocks.withColumn("carried", F.last(last_record, ignorenulls=True).over(to_last))
    blocks = _stored(blocks.select("_file", "block", "start", "carried"), "dump-blocks")

    begun = F.coalesce(F.when(F.col("start") == 0, F.col("from0")).otherwise(F.col("from1")), F.col("carried"))
    joined = placed.join(blocks, ["_file", "block"]).select("_file", begun.alias("record"), "_pos", "value")
    longest = joined.groupBy("_file", "record").count().filter(F.col("count") > MOST_RECORD_LINES).limit(1).collect()
    if longest:
        raise OpenQuote(f"{longest[0]['_file']}: a quote opened at {tuple(longest[0]['record'])} spans {longest[0]['count']} lines")
    parts = F.sort_array(F.collect_list(F.struct("_pos", "value")))
    return joined.groupBy("_file", "record").agg(F.array_join(F.transform(parts, lambda p: p["value"]), "\n").alias("value")).select(
        "_file", F.col("record").alias("_pos"), "value")


def read_dump(
    spark: SparkSession,
    path: str | Sequence[str],
    how: Delimited,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """All columns as strings: the columns of every layout, in the order of their first places.

    Skipped and footer records and comments are lines; then quoted line ends are joined to records (by a line break,
    whatever ended the lines). Cells beyond a file's names are dropped, missing ones are NULL, empty ones stay empty;
    names that differ in case only are one column, and of a header's equal names the first counts. Without a header and
    without ``columns`` the names are column0, column1, ... as wide as the file's first record.
    """
    patterns = CellPatterns(how)
    lines = _lines(spark, path, how)
    files = _stored(_layouts(_file_edges(lines, how, patterns), how, columns, patterns), "dump-files")
    known = files.select(F.posexplode("_names").alias("place", "name")).groupBy(F.lower("name").alias("key"))
    known = known.agg(F.min(F.struct("place", "name")).alias("first")).orderBy("first.place", "key").collect()
    keys = [r["key"] for r in known]
    folded = F.transform("_names", F.lower)
    slots = F.array(*[F.array_position(folded, k) for k in keys]) if keys else F.array().cast("array<bigint>")
    files = files.withColumn("_slots", slots).withColumn("_begin", F.when(F.lit(how.header), F.col("_head")["pos"]))
    files = files.select("_file", "_skip", "_foot", "_begin", "_broken", "_slots")

    body = lines.join(files, "_file").filter(
        F.coalesce(F.col("_pos") > F.col("_skip"), F.lit(True)) & F.coalesce(F.col("_pos") < F.col("_foot"), F.lit(True))
        & F.coalesce(F.col("_pos") > F.col("_begin"), F.lit(True)) & ~_is_comment(how)
    )
    records = body.filter(~F.col("_broken")).select("value", "_slots") if how.quote else body.select("value", "_slots")
    if how.quote and not files.filter("_broken").isEmpty():
        marked = body.filter("_broken").select(
            "_file", "_pos", "value", F.col("value").rlike(patterns.opens).alias("opens"), F.col("value").rlike(patterns.stays).alias("stays"))
        whole = _whole_records(marked).join(files.select("_file", "_slots"), "_file").select("value", "_slots")
        records = records.unionByName(whole)
    tokens = [NULL_MARK, *[x for x in (how.null_value, how.null_escape) if x is not None]]
    cut = records.filter("value != ''").select("_slots", patterns.cells(F.col("value")).alias("_cells"))

    def cell(place: int) -> Column:
        found = F.get("_cells", (F.get("_slots", F.lit(place)) - 1).cast("int"))
        return F.when(~found.isin(*tokens), found)

    return cut.select(*[cell(i).alias(r["first"]["name"]) for i, r in enumerate(known)])
