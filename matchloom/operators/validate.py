"""The line-based validator of list files: no quoting, a row is cut at its first tab.

Unlike the strict reader it takes header names in any case, skips blank lines,
and of repeated rows the last one counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CATEGORIES = ("duplicate row", "repeated ID in a list", "self match", "wrong prefix", "unknown ID", "missing row", "extra row")
EXAMPLES = 5


def findings(lists: DataFrame, required: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(category, offender) distinct, of raw rows (key, rest); ``required``: (key), ``known``: (target) or None."""
    dup = lists.groupBy("key").count().where("count > 1").select("key")
    some = lists.where(F.trim("rest") != "").select("key", F.split("rest", ",", -1).alias("ids"))
    twice = some.where(F.size("ids") != F.size(F.array_distinct("ids"))).select("key")
    ids = some.select(F.explode("ids").alias("id"))
    is_target = F.col("id").startswith("S2-") | F.col("id").startswith("S3-")
    own = ids.where(F.col("id").startswith("S1-"))
    wrong = ids.where(~is_target & ~F.col("id").startswith("S1-"))
    parts = [dup, twice, own, wrong]
    parts.append(ids.where(is_target).join(known.select(F.col("target").alias("id")), "id", "left_anti") if known is not None else ids.limit(0))
    parts.append(required.select("key").join(lists, "key", "left_anti"))
    parts.append(lists.select("key").join(required, "key", "left_anti"))
    out = None
    for category, rows in zip(CATEGORIES, parts):
        rows = rows.select(F.lit(category).alias("category"), F.col(rows.columns[0]).alias("offender")).distinct()
        out = rows if out is None else out.unionByName(rows)
    return out


def row_counts(lists: DataFrame) -> DataFrame:
    return lists.agg(F.count(F.lit(1)).alias("rows"), F.count(F.when(F.trim("rest") == "", 1)).alias("empty"))


def last_rows(lists: DataFrame) -> DataFrame:
    """Of each key the last row, by its place."""
    return lists.groupBy("key").agg(F.max_by("rest", "at").alias("rest"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(at, value) of a file's lines, read in splits; ``at`` orders them as the file does."""
    lines = spark.read.option("lineSep", "\n").text(path)
    # rows of a split are numbered in their order; its first byte orders the splits
    return lines.select(F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")).alias("at"), "value")


def _after_header(lines: DataFrame) -> tuple[str | None, DataFrame]:
    """(first line or None, the lines after it)."""
    first = lines.where("at.block = 0").agg(F.min_by("value", "at").alias("value"), F.min("at").alias("at")).first()
    if first["at"] is None:
        return None, lines
    return first["value"], lines.where((F.col("at.block") > 0) | (F.col("at.row") > F.lit(first["at"]["row"])))


def read_ids(spark: SparkSession, path: str, column: str = "key") -> DataFrame:
    """First column of a file, without header and blank lines."""
    rows = _after_header(read_lines(spark, path))[1].where(F.trim("value") != "")
    return rows.select(F.trim(F.split("value", "\t", 2)[0]).alias(column)).distinct()


def read_lists(spark: SparkSession, path: str, header: list[str]) -> tuple[DataFrame | None, list[str]]:
    """((at, key, rest), errors); None where the file or its header is broken."""
    name = path.rstrip("/").rpartition("/")[2]
    try:
        lines = read_lines(spark, path)
        first, rows = _after_header(lines)
    except Exception as e:  # the path does not exist
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None, [f"File not found: {path}"]
    if first is None:
        return None, [f"{name} is empty."]
    if "\t" not in first and "," in first:
        return None, [f"{name}: the header has commas and no tab; lists are tab-separated."]
    found = [c.strip().lower() for c in first.split("\t")]
    if found != header:
        return None, [f"{name}: unexpected header {found}, expected {header}."]
    bad = rows.where((F.instr("value", "\t") == 0) & (F.trim("value") != "")).orderBy("at").limit(EXAMPLES).collect()
    errors = []
    if bad:  # numbers of the few lines that are shown: how many stand before each, in one pass
        before = lines.agg(*[F.count(F.when(F.col("at") <= F.struct(F.lit(r["at"]["block"]).alias("block"), F.lit(r["at"]["row"]).alias("row")), 1)) for r in bad]).first()
        errors = [f"{name}: malformed row (no tab) at line {n}: {r['value']!r}" for r, n in zip(bad, before)]
    rows = rows.where(F.instr("value", "\t") > 0)
    return rows.select("at", F.split("value", "\t", 2)[0].alias("key"), F.split("value", "\t", 2)[1].alias("rest")), errors


def _messages(name: str, found: DataFrame) -> list[str]:
    number = F.row_number().over(Window.partitionBy("category").orderBy("offender"))
    rows = found.withColumn("k", number).where(F.col("k") <= EXAMPLES).groupBy("category").agg(F.array_sort(F.collect_list("offender")).alias("some"))
    totals = found.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    by = {r["category"]: r for r in rows.join(totals, "category").collect()}
    return [f"{name}: {c}: {by[c]['n']} in all, such as {', '.join(by[c]['some'])}" for c in CATEGORIES if c in by]


def validate(spark: SparkSession, matching: str, candidate: str | None, test_dir: str, check_ids: bool = False) -> tuple[list[str], list[str]]:
    """(errors, warnings) of the output files."""
    errors: list[str] = []
    warnings: list[str] = []
    exists = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p).getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(p))
    source1 = f"{test_dir}/test_source1.tsv"
    if not exists(source1):
        return [f"Test source1 file not found: {source1}"], warnings
    required, known = read_ids(spark, source1), None
    if check_ids:
        paths = [f"{test_dir}/test_source{k}.tsv" for k in (2, 3)]
        if missing := [p for p in paths if not exists(p)]:
            warnings.append(f"{missing[0]} not found: matched IDs are not checked for existence")
        else:
            known = read_ids(spark, paths[0], "target").unionByName(read_ids(spark, paths[1], "target"))
    else:
        warnings.append("matched IDs are not checked for existence")
    lists: dict[str, DataFrame] = {}
    for path, label in ((matching, "matched_entity_ids"), (candidate, "candidate_entity_ids")):
        if path is None or label == "candidate_entity_ids" and not exists(path):
            if path is not None:
                warnings.append(f"{path} not found: candidates are not checked")
            continue
        rows, more = read_lists(spark, path, ["source1_entity_id", label])
        errors += more
        if rows is not None:
            errors += _messages(path.rpartition("/")[2], findings(rows, required, known))
            some = last_rows(rows).where(F.trim("rest") != "")
            lists[label] = some.select("key", F.explode(F.split("rest", ",", -1)).alias("id"))
    if len(lists) == 2:
        outside = lists["matched_entity_ids"].join(lists["candidate_entity_ids"], ["key", "id"], "left_anti").select("key").distinct()
        if n := outside.count():
            warnings.append(f"{n} entities have matched IDs that their candidates lack")
    return errors, warnings
