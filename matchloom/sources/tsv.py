"""Strict TSV: a reader that splits files among tasks, and writers that publish all or nothing.

``read_tsv`` finds every fault with its line: a header other than expected, a
short or long row, a blank line, an unfinished quote, text behind a closing
quote, an empty file.  Nothing is taken for missing: ``NA`` and the empty field
are texts.

Files without a quote and a carriage return are checked and read by built-in
functions only.  A quoted field may hold line ends, so where a row begins depends
on all that stands before it: such files are scanned twice, in splits.  First,
each split tells what state it ends in, begun outside and begun inside quotes
(and how many lines it has); these few words a split are put together in order;
then each split is parsed from the state that is now known.  A row that crosses
splits is put together from its pieces by a small aggregate.  A carriage return
ends no row by itself; before a line end it is part of that.
"""

from __future__ import annotations

import csv
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import DataFormatError, strings
from ..session import ship

#: States between lines: at the start of a row, or inside quotes.
OUTSIDE, INSIDE = 0, 1


def state_after(line: str, state: int) -> int:
    """The state after one line, by the rules of quotes: they open at a field's start only, and double inside."""
    if '"' not in line:
        return state
    at, n = 0, len(line)
    while True:
        if state == OUTSIDE:
            # the next field that begins with a quote
            if line.startswith('"', at) and (at == 0 or line[at - 1] == "\t"):
                at, state = at + 1, INSIDE
                continue
            at = line.find('\t"', at)
            if at < 0:
                return OUTSIDE
            at, state = at + 2, INSIDE
        else:
            at = line.find('"', at)
            if at < 0:
                return INSIDE
            if line.startswith('""', at):
                at += 2
            else:
                at, state = at + 1, OUTSIDE
        if at > n:
            return state


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, block, value): the lines of files, in order within each split (``block``: its first byte)."""
    rows = spark.read.option("lineSep", "\n").text(path)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), "value")


def _splits(batches):
    """Yield ((path, block), lines) of a stream of batches, piece by piece."""
    for pdf in batches:
        change = (pdf["path"] != pdf["path"].shift()) | (pdf["block"] != pdf["block"].shift())
        for _, part in pdf.groupby(change.cumsum(), sort=False):
            yield (part["path"].iloc[0], int(part["block"].iloc[0])), part["value"].tolist()


def _survey(batches):
    """One row a split (or a piece of it, in order): lines, the end states of both beginnings, and whether quotes open before end in it."""
    import pandas as pd

    rows, piece = [], 0
    for (path, block), lines in _splits(batches):
        ends, left = [OUTSIDE, INSIDE], False
        if any('"' in x for x in lines):
            for x in lines:
                ends = [state_after(x, e) for e in ends]
                left = left or ends[INSIDE] == OUTSIDE
        rows.append((path, block, piece, len(lines), *ends, left))
        piece += 1
    if rows:
        yield pd.DataFrame(rows, columns=["path", "block", "piece", "lines", "end0", "end1", "left"])


def _parse(columns: tuple[str, ...], starts: dict):
    """Rows (line, error, piece of a row, seam, fields) of splits; ``starts``: (path, block) to (state, lines before, seam)."""
    names = ["path", "block", "line", "error", "piece", "seam", *columns]
    blank = [""] * len(columns)

    def run(batches):
        import pandas as pd

        state, line, key, seam, began = OUTSIDE, 0, None, 0, OUTSIDE
        held: list[str] = []

        def piece():
            return (*key, line, None, "\n".join(held), seam, *blank)

        for split, lines in _splits(batches):
            rows: list[tuple] = []
            if split != key:
                if held:
                    rows.append(piece())
                key, held = split, []
                state, line, seam = starts[split]
                began = state  # a split that begins inside quotes begins with a piece of a row
            for x in lines:
                line += 1
                after = state_after(x, state)
                held.append(x)
                if after == OUTSIDE:
                    if began == INSIDE:
                        rows.append(piece())
                        began = OUTSIDE
                    else:
                        error, *fields = _row("\n".join(held), columns, key[0], line, line == len(held))
                        rows.append((*key, line, error, None, -1, *fields))
                    held = []
                elif state == OUTSIDE:
                    seam = key[1]
                state = after
            if rows:
                yield pd.DataFrame(rows, columns=names)
        if held:
            yield pd.DataFrame([piece()], columns=names)

    return run


def _row(text: str, columns: tuple[str, ...], path: str, line: int, first: bool) -> tuple:
    """(error, fields) of the text of one row; ``first``: it is the header's, which gives no row."""
    blank = [""] * len(columns)
    fault = lambda what: (f"{path}: line {line}: {what}", *blank)
    if "\r" in text.removesuffix("\r") and '"' not in text:
        return fault("a carriage return inside a row")
    try:
        found = list(csv.reader([text + "\n"], delimiter="\t", strict=True))
    except csv.Error as e:
        return fault(str(e))
    row = found[0] if len(found) == 1 else []
    if first:
        return (None, *blank) if tuple(row) == columns else fault(f"the header is {row}, not {list(columns)}")
    if len(row) != len(columns):
        return fault("a blank line" if not row else f"{len(row)} fields, not {len(columns)}")
    return (None, *row)


def _plan(stats) -> tuple[dict, list[str]]:
    """((path, block) to (state, lines before, seam), files that end inside quotes) of all splits' surveys."""
    starts: dict = {}
    path, state, line, seam, unfinished = None, OUTSIDE, 0, 0, []
    for r in sorted(stats, key=lambda r: (r["path"], r["block"], r["piece"])):
        if r["path"] != path:
            if state == INSIDE:
                unfinished.append(f"{path}: line {line}: unexpected end of data inside quotes")
            path, state, line, seam = r["path"], OUTSIDE, 0, 0
        if (path, r["block"]) not in starts:
            starts[path, r["block"]] = state, line, seam
        after = r["end1"] if state == INSIDE else r["end0"]
        if after == INSIDE and (state == OUTSIDE or r["left"]):  # the open row began here
            seam = r["block"]
        state, line = after, line + r["lines"]
    if state == INSIDE:
        unfinished.append(f"{path}: line {line}: unexpected end of data inside quotes")
    return starts, unfinished


def _plain(spark: SparkSession, path: str, columns: tuple[str, ...]) -> DataFrame | None:
    """The rows of files without quotes, carriage returns, blank rows (which the built-in reader skips) and faults; None where there are any."""
    lines = _lines(spark, path).withColumn("at", F.monotonically_increasing_id())
    tabs = F.length("value") - F.length(F.replace("value", F.lit("\t"), F.lit("")))
    odd = F.col("value").contains('"') | F.col("value").contains("\r") | F.col("value").rlike(r"\A[\x00-\x20]*\z") | (tabs != len(columns) - 1)
    # one row a file
    files = lines.groupBy("path").agg(F.count(F.when(odd, 1)).alias("odd"), F.min_by("value", F.when(F.col("block") == 0, F.col("at"))).alias("header"))
    if not files.where((F.col("odd") > 0) | (F.col("header") != "\t".join(columns)) | F.col("header").isNull()).isEmpty():
        return None
    rows = (
        spark.read.schema(strings(columns))
        .option("sep", "\t").option("header", True).option("enforceSchema", True).option("lineSep", "\n").option("quote", "").option("escape", "")
        .option("nullValue", "\u0001").option("emptyValue", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    )
    return rows.select(*[F.coalesce(c, F.lit("")).alias(c) for c in columns])


def _first_rows(columns: tuple[str, ...], limit: int):
    """Header and first rows of one file, in one task that reads no farther."""

    def run(batches):
        import pandas as pd

        rows: list[tuple] = []
        held, state, line, path, taken = [], OUTSIDE, 0, "", 0
        for (path, _), lines in _splits(batches):
            for x in lines:
                line += 1
                held.append(x)
                state = state_after(x, state)
                if state == INSIDE:
                    continue
                first = line - len(held) + 1 == 1
                rows.append((path, line, *_row("\n".join(held), columns, path, line, first)))
                held, taken = [], taken + (not first)
                if rows[-1][2] is not None or taken >= limit:
                    break
            else:
                continue
            break
        if state == INSIDE:
            rows.append((path, line, f"{path}: line {line}: unexpected end of data inside quotes", *[""] * len(columns)))
        if rows:
            yield pd.DataFrame(rows, columns=["path", "line", "error", *columns])

    return run


def read_tsv(spark: SparkSession, path: str, columns, *, limit: int | None = None) -> DataFrame:
    """The rows of a file or of all files of a folder, in the columns' order; raises ``DataFormatError`` on any fault.

    ``limit``: rows of each file, from its start; what follows is not parsed.
    """
    columns = tuple(columns)
    ship(spark)
    fs, place = file_system(spark, path)
    held = [f for f in (fs.listStatus(place) if fs.exists(place) else []) if not f.isDirectory() and not f.getPath().getName().startswith(("_", "."))]
    if empty := [f.getPath().toString() for f in held if f.getLen() == 0]:
        raise DataFormatError(f"{empty[0]}: line 1: the file is empty")
    fields = [T.StructField("line", T.LongType()), T.StructField("error", T.StringType())]
    named = T.StructField("path", T.StringType())
    if limit is not None:
        files = [f.getPath().toString() for f in held] or [path]
        parts = [_lines(spark, f).coalesce(1).mapInPandas(_first_rows(columns, limit), T.StructType([named, *fields, *strings(columns)])) for f in files]
        rows = parts[0]
        for more in parts[1:]:
            rows = rows.unionByName(more)
    else:
        if (plain := _plain(spark, path, columns)) is not None:
            return plain
        lines = _lines(spark, path)
        # a few numbers a split
        stats = lines.mapInPandas(_survey, "path string, block long, piece long, lines long, end0 int, end1 int, left boolean").collect()
        starts, unfinished = _plan(stats)
        if unfinished:
            raise DataFormatError("; ".join(unfinished[:3]))
        schema = T.StructType([named, T.StructField("block", T.LongType()), *fields, T.StructField("piece", T.StringType()), T.StructField("seam", T.LongType()), *strings(columns)])
        parsed = lines.mapInPandas(_parse(columns, starts), schema)
        rows = parsed.where("piece is null").select("path", "line", "error", *columns)
        if any(state == INSIDE for state, _, _ in starts.values()):
            pieces = parsed.where("piece is not null").groupBy("path", "seam").agg(F.max("line").alias("line"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "piece"))), lambda p: p["piece"]), "\n").alias("text"))

            def whole(batches):
                import pandas as pd

                for pdf in batches:
                    yield pd.DataFrame([(p, n, *_row(t, columns, p, n, t.count("\n") + 1 == n)) for p, n, t in zip(pdf["path"], pdf["line"], pdf["text"])], columns=["path", "line", "error", *columns])

            rows = rows.unionByName(pieces.select("path", "line", "text").mapInPandas(whole, T.StructType([named, *fields, *strings(columns)])))
    faults = [r["error"] for r in rows.where("error is not null").select("error").orderBy("path", "line").limit(3).collect()]
    if faults:
        raise DataFormatError("; ".join(faults))
    # the header's row is empty
    return rows.where("line > 1").select(*columns)


def small_table(spark: SparkSession, path: str, columns, most: int = 1000) -> DataFrame:
    """``read_tsv`` of a file that must not have more than ``most`` rows."""
    rows = read_tsv(spark, path, columns, limit=most + 1)
    if rows.limit(most + 1).count() > most:
        raise DataFormatError(f"{path}: more than {most} rows")
    return rows


def file_system(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    fs, place = file_system(spark, path)
    return fs.exists(place)


def write_tsv(rows: DataFrame, path: str, columns, order_by: str | None = None) -> None:
    """One TSV file with the header; refuses missing values, other columns and an existing file.

    Rows are ordered by ``order_by``.  The rows are sorted and formatted as part
    files by as many tasks as there are partitions; the driver only copies their
    bytes, one after the other, behind the header (``merge``).  The file appears
    under its name only when it is whole.
    """
    spark = rows.sparkSession
    if exists(spark, path):
        raise FileExistsError(path)
    staged = f"{path}.{uuid.uuid4().hex}"
    fs, place = file_system(spark, staged)
    try:
        write_parts(rows, staged, columns, order_by)
        merge(spark, staged, path, "\t".join(columns) + "\n")
    finally:
        fs.delete(place, True)


def write_parts(rows: DataFrame, folder: str, columns, order_by: str | None = None) -> None:
    """A folder of TSV part files without headers, in the order of their names; refuses what ``write_tsv`` does."""
    columns = list(columns)
    if rows.columns != columns:
        raise DataFormatError(f"the columns are {rows.columns}, not {columns}")
    if any(f.dataType != T.StringType() for f in rows.schema):
        raise DataFormatError("all columns must be strings")
    if not rows.where(" or ".join(f"`{c}` is null" for c in columns)).isEmpty():
        raise DataFormatError("missing values")
    ordered = rows.orderBy(order_by) if order_by else rows
    ordered.write.option("sep", "\t").option("header", False).option("emptyValue", "").option("quote", '"').option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(folder)


def merge(spark: SparkSession, folder: str, path: str, header: str) -> None:
    """One file of a header and all part files of a folder, by name; bytes are copied through a small buffer and not parsed."""
    fs, place = file_system(spark, folder)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    staged = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    out = fs.create(staged, False)
    try:
        out.write(bytearray(header.encode("utf-8")))
        for part in sorted((s.getPath() for s in fs.listStatus(place) if s.getPath().getName().startswith("part-")), key=lambda p: p.getName()):
            part_in = fs.open(part)
            try:
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(part_in, out, conf, False)
            finally:
                part_in.close()
    finally:
        out.close()
    if not fs.rename(staged, jvm.org.apache.hadoop.fs.Path(path)):
        raise OSError(f"{path} cannot be published")


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text file (reports, manifests) at any path Spark can write."""
    fs, place = file_system(spark, path)
    out = fs.create(place, False)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    return "\n".join(r["value"] for r in spark.read.option("wholetext", True).text(path).collect())


def fingerprint(spark: SparkSession, path: str) -> dict:
    """SHA-256 and length of a file of any size, read as a stream."""
    fs, place = file_system(spark, path)
    jvm = spark._jvm
    digest = jvm.java.security.MessageDigest.getInstance("SHA-256")
    read = jvm.java.security.DigestInputStream(fs.open(place), digest)
    jvm.org.apache.hadoop.io.IOUtils.copyBytes(read, jvm.java.io.OutputStream.nullOutputStream(), 1 << 20, True)
    return {"sha256": bytes(digest.digest()).hex(), "bytes": fs.getFileStatus(place).getLen()}


class Staged:
    """A folder that is built beside its place and appears there whole, or not at all."""

    def __init__(self, spark: SparkSession, path: str, outside: tuple[str, ...] = ()):
        self.spark, self.path = spark, path.rstrip("/")
        if any(self.path == p.rstrip("/") or self.path.startswith(p.rstrip("/") + "/") for p in outside):
            raise ValueError("the output must lie outside the inputs")
        if exists(spark, self.path):
            raise FileExistsError(f"{self.path} exists already; choose a new place")
        self.staged = f"{self.path}.{uuid.uuid4().hex}"

    def __enter__(self) -> str:
        fs, place = file_system(self.spark, self.staged)
        fs.mkdirs(place)
        return self.staged

    def __exit__(self, kind, value, trace) -> None:
        fs, place = file_system(self.spark, self.staged)
        if kind is None:
            if not fs.rename(place, self.spark._jvm.org.apache.hadoop.fs.Path(self.path)):
                raise OSError(f"{self.path} cannot be published")
        else:
            fs.delete(place, True)
