"""S4 for documents larger than a task: the parallel lists of a JSON document read in splits.

The text is cut at its commas, so a split of any file gives whole elements. What an element is
follows from the text before it: whether a string is open (strings may hold commas and brackets),
which member it belongs to, how many lists have begun, how many values stand before it. These are
running sums inside a split and one carried row a split (:mod:`tickflow.sources.places`)."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickflow.sources import places as P
from tickflow.sources.readers import SERIES_NAMES, SERIES_ROWS

SLOT_LISTS = {"top_processes_memory": "process_memory", "top_processes_cpu": "process_cpu"}
NUMBER_TEXT = '"(NaN|[+-]?INF|[+-]?Infinity)"'  # numbers that a writer of strict JSON puts in quotes


def _count(text: str, char: str):
    return F.length(text) - F.length(F.replace(F.col(text), F.lit(char), F.lit("")))


def _elements(spark: SparkSession, path: str) -> DataFrame:
    """(split, _at, name, opens, val): per piece the member that starts in it, the lists that start in
    it, and the text of its value ('' if it has none; a string is one quote)."""
    rows = P.pieces(spark, path, ",").withColumn("_t", F.regexp_replace("value", r"(?s)\\.", "")).drop("value")
    rows = rows.withColumn("_q", _count("_t", '"'))
    rows = P.carried(rows, [F.sum("_q").alias("_n")], [P.total_before("_n").alias("_from")])
    inside = (F.col("_from") + F.sum("_q").over(P.so_far()) - F.col("_q")) % 2 == 1
    # a string that is open where the piece starts is given its first quote; then strings shrink to one
    rows = rows.withColumn("_t", F.when(inside, F.concat(F.lit('"'), "_t")).otherwise(F.col("_t")))
    key = r'^[^"]*"([^"]*)"\s*:'
    name = F.when(~inside & F.col("_t").rlike(key), F.regexp_extract("_t", key, 1))
    number = F.regexp_replace("_t", NUMBER_TEXT, "$1")  # of the string lists no value is read
    rows = rows.select(*P.SPLIT, "_at", name.alias("name"), F.regexp_replace(number, '"[^"]*("|$)', '"').alias("_t"))
    rows = rows.withColumn("_t", F.when(F.col("name").isNotNull(), F.regexp_replace("_t", r'^[^"]*"\s*:', "")).otherwise(F.col("_t")))
    return rows.select(*P.SPLIT, "_at", "name", _count("_t", "[").alias("opens"), F.regexp_replace("_t", r"[\[\]{}\s]", "").alias("val"))


def _scan(rows: DataFrame) -> DataFrame:
    """``_elements`` with the member, the list's number in it and the value's number in the list."""
    has = (F.col("val") != "").cast("long")
    opened, valued = F.sum("opens"), F.sum(has)
    rows = P.carried(
        rows, [opened.alias("_o"), valued.alias("_v")],
        [P.total_before("_o").alias("_of"), P.total_before("_v").alias("_vf")],
    )
    rows = rows.select(
        *P.SPLIT, "_at", "name", "opens", "val",
        (F.col("_of") + opened.over(P.so_far())).alias("_o"), (F.col("_vf") + valued.over(P.so_far())).alias("_v"),
    )
    member = F.when(F.col("name").isNotNull(), F.struct("name", (F.col("_o") - F.col("opens")).alias("lists")))
    start = F.when(F.col("opens") > 0, F.col("_v") - has)  # values before the list's first
    rows = rows.withColumns({"_m": member, "_s": start})
    last_of = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_at"))).alias(f"{c}e") for c in ("_m", "_s")]
    rows = P.carried(rows, last_of, [F.last(f"{c}e", True).over(P.earlier()).alias(f"{c}f") for c in ("_m", "_s")])
    m, s = (F.coalesce(F.last(c, True).over(P.so_far()), F.col(f"{c}f")) for c in ("_m", "_s"))
    rows = rows.select("_file", "val", "_o", "_v", m.alias("_m"), s.alias("_s")).where("val != ''")
    return rows.select("_file", F.col("_m.name").alias("name"), (F.col("_o") - F.col("_m.lists") - 2).alias("list"), (F.col("_v") - F.col("_s") - 1).alias("idx"), "val")


def read_long_series_json(spark: SparkSession, path: str) -> DataFrame:
    """The rows of :func:`tickflow.sources.readers.read_series_json` from documents of any size,
    each read by as many tasks as it has splits.

    One document a file, its lists members of its top level (a list of the same name inside another
    member counts as one of them). A null element is a null value, ``[]`` gives no rows; a missing file
    gives an empty table. A file that isn't JSON isn't refused: what reads as a number is a value."""
    try:
        rows = _scan(_elements(spark, path))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], SERIES_ROWS)
    rows = rows.withColumn("value", F.expr("try_cast(val AS DOUBLE)"))
    times = rows.where("name = 'timestamps' AND list = -1").select("_file", "idx", (F.col("value") * F.lit(1e6)).cast("bigint").alias("elapsed_us"))
    slotted = F.create_map(*[F.lit(x) for pair in SLOT_LISTS.items() for x in pair])
    # a flat list is the member's first one (-1), a slot's list stands inside that
    listed = (F.col("name").isin(*SERIES_NAMES) & (F.col("list") == -1)) | (F.col("name").isin(*SLOT_LISTS) & (F.col("list") >= 0))
    series = rows.where(listed).withColumns(
        {"series": F.coalesce(slotted[F.col("name")], "name"), "slot": F.when(F.col("name").isin(*SLOT_LISTS), F.col("list")).cast("int")}
    )
    return series.join(times, ["_file", "idx"], "left").select(F.col("_file").alias("run_id"), "series", "slot", "idx", "elapsed_us", "value")
