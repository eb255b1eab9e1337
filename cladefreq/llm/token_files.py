"""Token-ID / binary output: ids of whole texts, Simple-8b coded, in files in ascending id order.

Texts are encoded where they are read, and their coded ids travel, not the texts. The ids alone are read first: their
quantiles are the bounds of ranges that hold about RANGE_ROWS documents. Each range is sorted and written in a row per
document: its ids as a Simple-8b list with block offsets, and how many ids of the range lie before it. A reader adds up
the ranges, and decodes the lists of many documents together.

The files are a Parquet dataset, so Spark's commit protocol covers lost executors and any store that Spark reaches will
do. Null texts count as empty and still get the end id; null ids come first; equal ids are kept in the order of their
tokens; very long texts are encoded whole; an empty table gives an empty dataset. Other columns are ignored, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cladefreq.llm import simple8b
from cladefreq.llm.pieces import encoder

#: Documents of a range, unless there would be more than MAX_RANGES.
RANGE_ROWS, MAX_RANGES = 4_096, 20_000
#: Characters encoded and ids decoded at a time; a longer text is alone.
GROUP_CHARS, GROUP_IDS = 1 << 20, 1 << 18
SLICE_ROWS = 512
FILE_SCHEMA = "part int, id long, base long, n long, coded binary"


def _bounds(ids: DataFrame) -> np.ndarray:
    """Ascending ids at which ranges of about RANGE_ROWS rows begin; read from the id column alone."""
    n = ids.agg(F.count("id")).first()[0]
    ranges = min(MAX_RANGES, -(-n // RANGE_ROWS))
    if ranges < 2:
        return np.zeros(0, np.int64)
    shares = [k / ranges for k in range(1, ranges)]
    found = ids.agg(F.percentile_approx("id", shares, 10 * ranges)).first()[0]
    return np.unique(np.array(found, np.int64))


def _by_ids(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Stretches of documents (id, start, n, coded) with about GROUP_IDS ids together; a longer document is alone."""
    total, a = np.cumsum(np.asarray(batch.column(2))), 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + GROUP_IDS, side="right")))
        yield batch.slice(a, b - a)
        a = b


def write_token_files(
    docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text"
) -> None:
    """Write the ids of every text, each document followed by `end_id`, as coded lists below `folder`."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    bounds = _bounds(rows.select("id"))

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer, False), np.array([end_id], "<u4").tobytes()
        names = ["part", "id", "n", "coded"]
        for batch in (whole.slice(k, SLICE_ROWS) for whole in batches for k in range(0, whole.num_rows, SLICE_ROWS)):
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            at = 0
            while at < len(texts):
                to, held = at, 0
                while to < len(texts) and (to == at or held + len(texts[to]) <= GROUP_CHARS):
                    held += len(texts[to])
                    to += 1
                blobs = [b + end for b in encode(texts[at:to])]
                sizes = np.array([len(b) // 4 for b in blobs], np.int64)
                coded = simple8b.encode_each(np.frombuffer(b"".join(blobs), "<u4"), sizes)
                own = ids.slice(at, to - at)
                part = np.searchsorted(bounds, own.fill_null(-(1 << 63)).to_numpy(), side="right").astype(np.int32)
                columns = [pa.array(part), own, pa.array(sizes), pa.array(coded, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names)
                at = to

    moved = rows.mapInArrow(encoded, "part int, id long, n long, coded binary").repartition("part")
    order = Window.partitionBy("part").orderBy(F.col("id").asc_nulls_first(), "n", "coded")
    before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    moved.withColumn("base", before).select("part", "id", "base", "n", "coded").write.parquet(folder)


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document of the files at `folder`: id, start (ids before it in the whole dataset), n_tokens, ids (bytes
    of unsigned little-endian 32-bit integers)."""

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in _by_ids(whole)):
            sizes, coded = np.asarray(batch.column(2)), batch.column(3).to_pylist()
            values = simple8b.decode_each(b"".join(coded), np.cumsum([len(c) for c in coded])).astype("<u4")
            raw, ends = values.tobytes(), (np.r_[0, np.cumsum(sizes)] * 4).tolist()
            blobs = pa.array([raw[a:b] for a, b in zip(ends, ends[1:], strict=False)], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], blobs], ["id", "start", "n_tokens", "ids"])

    files = spark.read.schema(FILE_SCHEMA).parquet(folder)
    # One row per range, of which there are MAX_RANGES at most, in this window and this broadcast.
    totals = files.groupBy("part").agg(F.sum("n").alias("n_part"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("part", F.coalesce(F.sum("n_part").over(earlier), F.lit(0)).alias("before"))
    based = files.join(F.broadcast(before), "part").select("id", (F.col("base") + F.col("before")).alias("start"), "n", "coded")
    return based.mapInArrow(documents, "id long, start long, n_tokens long, ids binary")
