"""CSV files with a header and a given schema."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, StringType, StructType

from tallyloom.session import durable

# fixed values: texts that mean "no value"
NULL_TEXTS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>",
    "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

FORMAT = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
#: Rows of a written file.
FILE_ROWS = 100_000
#: Blocks of files that are broadcast at most.
BROADCAST_BLOCKS = 50_000


def read_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Typed scan without an inference pass; missing-value texts become null, line breaks and outer blanks of texts stay.

    A quoted line break cannot be told from a row's end in the middle of a file, so each file is read by one task."""
    kind = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    return _cleaned(spark.read.schema(kind).options(**FORMAT, multiLine=True).csv(path), kind)


def _cleaned(raw: DataFrame, kind: StructType) -> DataFrame:
    cleaned = {}
    for field in kind.fields:
        c = F.col(field.name)
        if isinstance(field.dataType, StringType):
            cleaned[field.name] = F.when(~c.isin(NULL_TEXTS), c)
        elif isinstance(field.dataType, (DoubleType, FloatType)):
            cleaned[field.name] = F.when(~F.isnan(c), c)
    return raw.withColumns(cleaned) if cleaned else raw


def read_split_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Like `read_csv`, with each file read by as many tasks as it has blocks.

    A line ends a row only where the quotes before it are even in number. Quotes are counted per block of a file, running
    sums over the blocks tell how each begins, and so each task finds the row ends of its own block. Blocks in which
    every line is a row go straight to the parser. In the others lines are joined to rows; a row that crosses blocks is
    put together from its pieces. Files must quote every field that holds a quote, as `write_csv` does."""
    kind = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    value = F.col("value")
    quotes = F.length(value) - F.length(F.replace(value, F.lit('"'), F.lit("")))
    lines = spark.read.option("lineSep", "\n").text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("place"), quotes.cast("long").alias("quotes"))
    counted = lines.groupBy("file", "block").agg(
        F.sum("quotes").alias("n"), F.count_if(F.col("quotes") % 2 == 1).alias("uneven"), F.min("place").alias("first"))
    before = F.sum("n").over(W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1))
    blocks = durable(counted.select("file", "block", "uneven", "first", (F.coalesce(before, F.lit(0)) % 2 == 1).alias("inside")))
    known = lines.drop("quotes").join(F.broadcast(blocks) if blocks.count() <= BROADCAST_BLOCKS else blocks, ["file", "block"])
    header = (F.col("block") == 0) & (F.col("place") == F.col("first"))
    mixed = F.col("inside") | (F.col("uneven") > 0)
    plain = known.where(~mixed & ~header).select(value.alias("row"))
    # only these blocks are shuffled, each to one task in the order of its lines
    ordered = known.where(mixed).repartition("file", "block").sortWithinPartitions("file", "block", "place")
    joined = durable(ordered.mapInPandas(_rows_of_blocks, "file string, block long, part int, opens boolean, whole boolean, header boolean, row string"))
    pieces = joined.where("not whole")
    at = W.partitionBy("file").orderBy("block", "part")
    numbered = pieces.withColumn("number", F.sum(F.col("opens").cast("int")).over(at.rowsBetween(W.unboundedPreceding, W.currentRow)))
    crossing = numbered.groupBy("file", "number").agg(
        F.max("header").alias("header"), F.array_sort(F.collect_list(F.struct("block", "part", "row"))).alias("p")).where("not header").select(
        F.concat_ws("\n", F.transform("p", lambda x: x["row"])).alias("row"))
    rows = plain.unionByName(joined.where("whole and not header").select("row")).unionByName(crossing)
    rows = rows.select(F.regexp_replace("row", r"\r\z", "").alias("row")).where("row <> ''")
    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kind.fields)
    parsed = rows.select(F.from_csv("row", names, {**{k: str(v).lower() if isinstance(v, bool) else v for k, v in FORMAT.items() if k != "header"}, "multiLine": "true"}).alias("r"))
    return _cleaned(parsed.select("r.*"), kind)


def _rows_of_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Lines of blocks in order, joined to rows; what a block's ends cut are pieces (opens: the row begins with it)."""
    columns = ["file", "block", "part", "opens", "whole", "header", "row"]
    at, held, state = None, [], {}

    def piece(opens: bool, whole: bool) -> tuple:
        first = state["first"] and state["block"] == 0 and opens
        state["first"] = state["first"] and not opens
        return (*at, 0 if not opens else 1, opens, whole, first, "\n".join(held))

    for batch in batches:
        out = []
        for file, block, inside, text in zip(batch["file"], batch["block"], batch["inside"], batch["value"], strict=True):
            if at != (file, block):
                if held:
                    out.append(piece(not state["head"], False))
                at, held = (file, block), []
                state = {"block": block, "first": True, "odd": bool(inside), "head": bool(inside)}
            held.append(text)
            state["odd"] ^= text.count('"') % 2 == 1
            if not state["odd"]:
                out.append(piece(not state["head"], not state["head"]))
                held, state["head"] = [], False
        yield pd.DataFrame(out, columns=columns)
    if held:
        yield pd.DataFrame([piece(not state["head"], False)], columns=columns)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").options(**FORMAT).option("maxRecordsPerFile", FILE_ROWS).csv(path)
