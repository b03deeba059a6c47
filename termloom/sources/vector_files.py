"""Import of vectors kept as one JSON object ``{"id": [numbers], ...}``."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# What a closing bracket ends; each vector ends with one, and ids may hold more.
PIECE_END = "]"
_PIECE = "file string, block long, n long, value string, before int, after int, ends long"


def _number_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Quote parity and number of each piece, counted from the start of its block of a file.

    ``before`` and ``after`` say whether an odd number of quotes comes before a
    piece and up to its end, ``ends`` how many pieces before it end with an even
    number.  Rows of a block follow each other in file order.
    """
    held, n, quotes, ends = None, 0, 0, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        bare = pc.replace_substring_regex(batch.column("value"), r"\\.", "")
        counts = pc.count_substring(bare, '"').to_numpy(zero_copy_only=False).astype(np.int64)
        blocks = list(zip(batch.column("file").to_pylist(), batch.column("block").to_pylist()))
        starts = [i for i in range(len(blocks)) if i == 0 or blocks[i] != blocks[i - 1]]
        for low, high in zip(starts, [*starts[1:], len(blocks)]):
            if blocks[low] != held:
                held, n, quotes, ends = blocks[low], 0, 0, 0
            after = quotes + np.cumsum(counts[low:high])
            even = np.concatenate([[0], np.cumsum(after % 2 == 0)])
            columns = [
                *(batch.column(c).slice(low, high - low) for c in ("file", "block")),
                pa.array(np.arange(n, n + high - low)),
                batch.column("value").slice(low, high - low),
                pa.array(((after - counts[low:high]) % 2).astype(np.int32)),
                pa.array((after % 2).astype(np.int32)),
                pa.array(ends + even[:-1]),
            ]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _PIECE.split(", ")])
            n, quotes, ends = n + high - low, int(after[-1]), int(ends + even[-1])


def _block_starts(pieces: DataFrame) -> DataFrame:
    """(file, block, odd, first, last): quote parity at a block's start, entries before it, number of the file's last piece.

    A row for each block, and a window over the blocks of a file.
    """
    blocks = pieces.groupBy("file", "block").agg(
        F.max_by("after", "n").alias("parity"),
        F.count(F.lit(1)).alias("n"),
        F.sum(1 - F.col("after")).alias("even"),
    )
    whole = Window.partitionBy("file")
    earlier = whole.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    odd = F.coalesce(F.sum("parity").over(earlier), F.lit(0)) % 2
    known = blocks.select("*", odd.alias("odd"), (F.sum("parity").over(whole) % 2).alias("open"), F.max("block").over(whole).alias("final"))
    done = F.when(F.col("odd") == 0, F.col("even")).otherwise(F.col("n") - F.col("even"))
    return known.select(
        "file",
        "block",
        F.when(F.col("open") == 0, F.col("odd")).otherwise(_wrong()).alias("odd"),
        F.coalesce(F.sum(done).over(earlier), F.lit(0)).alias("first"),
        F.when(F.col("block") == F.col("final"), F.col("n") - 1).alias("last"),
    )


def _wrong() -> Column:
    return F.raise_error(F.lit("not an object of number arrays"))


def read_vector_object(spark: SparkSession, path: str, index_name: str = "default") -> DataFrame:
    """(index_name, id, embedding) from JSON objects, one per file.

    Files are cut at closing brackets, so a large one is read by as many tasks as
    it has blocks.  Any JSON string is an id, brackets included: the parity of
    the quotes before it tells whether a bracket ends a vector.  One pass counts
    them block by block, and the parities of a file's blocks are added up, one
    row a block; only the pieces of ids that hold a bracket are shuffled.
    A file that is no object of number arrays fails the job; one without any
    character has no vectors.
    """
    text = spark.read.option("lineSep", PIECE_END).text(path)
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")]
    pieces = text.select(*place, "value").mapInArrow(_number_pieces, _PIECE)
    placed = pieces.join(_block_starts(pieces), ["file", "block"])
    odd = F.col("odd") == 1
    numbered = placed.select(
        "file",
        "block",
        "n",
        "value",
        (F.col("first") + F.when(odd, F.col("n") - F.col("ends")).otherwise(F.col("ends"))).alias("entry"),
        ((F.col("before") != F.col("odd")) | (F.col("after") != F.col("odd"))).alias("cut"),
        F.coalesce(F.col("n") == F.col("last"), F.lit(False)).alias("final"),
    )
    cut = numbered.where("cut").groupBy("file", "entry").agg(
        F.sort_array(F.collect_list(F.struct("block", "n", "value"))).alias("parts"), F.max("final").alias("final")
    )
    joined = F.array_join(F.transform("parts", lambda p: p["value"]), PIECE_END)
    entries = numbered.where(~F.col("cut")).select("entry", "value", "final").unionByName(
        cut.select("entry", joined.alias("value"), "final")
    )
    opening = F.when(F.col("entry") == 0, r"^[ \t\r\n]*\{").otherwise(r"^[ \t\r\n]*,")
    closing = F.when(F.col("entry") == 0, r"^[ \t\r\n]*\{[ \t\r\n]*\}[ \t\r\n]*$").otherwise(r"^[ \t\r\n]*\}[ \t\r\n]*$")
    body = F.concat(F.lit("{"), F.regexp_replace("value", opening, F.lit("")), F.lit("]}"))
    checked = entries.select(
        F.when(F.col("final") & F.regexp_like("value", closing), F.lit("{}"))
        .when(~F.col("final") & F.regexp_like("value", opening), body)
        .otherwise(_wrong())
        .alias("value")
    )
    parsed = checked.select(F.from_json("value", "map<string, array<float>>", {"mode": "FAILFAST"}).alias("entries"))
    sound = F.forall(F.map_values("entries"), lambda v: v.isNotNull() & F.forall(v, lambda x: x.isNotNull()))
    vectors = parsed.select(F.when(F.coalesce(sound, F.lit(False)), F.col("entries")).otherwise(_wrong()).alias("entries"))
    return vectors.select(F.lit(index_name).alias("index_name"), F.explode("entries").alias("id", "embedding"))
