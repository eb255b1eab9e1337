"""Result tables under one root."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_folder(spark: SparkSession) -> str:
    """A new folder name under the one the cluster shares (``spark.checkpoint.dir``).

    Only a local session without that setting falls back to a temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        root = tempfile.mkdtemp(prefix="cladefreq-")
    return f"{root.rstrip('/')}/cladefreq-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """The table, stored in the shared folder: computed once and without its lineage."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Blanks at the ends of a cell are part of it, and quotes within quotes are doubled.
CSV_OPTIONS = {
    "header": True,
    "nullValue": "NA",
    "escape": '"',
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}
MANIFEST = "table_name string, release long, path string, file_format string, columns string, n_rows long, checksum long"


def write_csv(df: DataFrame, path: str) -> None:
    """Delimited text with a header line and no row numbers; a missing value is ``NA``."""
    df.write.mode("overwrite").options(**CSV_OPTIONS).csv(path)


#: Lines of a text file, and so rows that the task which sorts and writes it holds, unless the sampled bounds are uneven.
FILE_LINES = 500_000


def write_lines(
    cells: DataFrame,
    order: Sequence[str],
    path: str,
    *,
    sep: str = "\t",
    columns: Sequence[str],
    header: Sequence[str] | None = None,
    files: int = 2,
    line_end: str = "\r\n",
) -> None:
    """Text files as other programs leave them: CRLF, a header line in each, ``NA`` for missing, cells not quoted.

    Rows lie in the files in the given order: by file name, then by line. There
    are ``files`` of them, and more for more than ``FILE_LINES`` rows each: the
    rows are counted first, so that no task's share grows with the table.
    """
    files = max(files, -(-cells.count() // FILE_LINES))
    text = F.concat_ws(sep, *[F.coalesce(F.col(c).cast("string"), F.lit("NA")) for c in columns])
    first_line = sep.join(header if header is not None else columns)
    dealt = cells.repartitionByRange(files, *order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    lines = dealt.select(text.alias("line"), place.alias("place"))
    tail = F.lit(line_end.removesuffix("\n"))
    headed = F.when(F.col("place") == 0, F.array(F.lit(first_line), "line")).otherwise(F.array("line"))
    lines.select(F.explode(headed).alias("line")).select(F.concat("line", tail)).write.text(path)


def row_text(df: DataFrame) -> Column:
    """One text per row: cells in column order, missing ones ``NA``, fractions in millionths."""

    def cell(field: T.StructField) -> Column:
        value = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            value = F.round(value * 1_000_000).cast("long")
        return F.coalesce(value.cast("string"), F.lit("NA"))

    return F.concat_ws("|", *[cell(f) for f in df.schema.fields])


def fingerprint(df: DataFrame) -> DataFrame:
    """One row: ``n_rows`` and a ``checksum`` of the rows that does not depend on their order."""
    part = F.conv(F.substring(F.md5(row_text(df)), 1, 8), 16, 10).cast("long")
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum(part), F.lit(0)).cast("long").alias("checksum")
    )


def _releases(spark: SparkSession, root: str) -> DataFrame | None:
    try:
        return spark.read.schema(MANIFEST).parquet(f"{root.rstrip('/')}/manifest")
    except AnalysisException:
        return None


def published(spark: SparkSession, root: str) -> DataFrame:
    """Manifest of the latest release below ``root``: where each named table is, its columns, rows and checksum."""
    found = _releases(spark, root)
    if found is None:
        raise ValueError(f"nothing is published below {root}")
    last = found.agg(F.max("release").alias("release")).select("release").scalar()
    return found.where(F.col("release") == last)


def read_published(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table of the latest release, with the types it was published with."""
    entry = published(spark, root).where(F.col("table_name") == name).first()
    if entry is None:
        raise ValueError(f"{name} is not published below {root}")
    return _read_back(spark, entry["path"], entry["file_format"], T.StructType.fromJson(json.loads(entry["columns"])))


def _read_back(spark: SparkSession, path: str, file_format: str, schema: T.StructType) -> DataFrame:
    reader = spark.read.schema(schema)
    return reader.options(**CSV_OPTIONS).csv(path) if file_format == "csv" else reader.format(file_format).load(path)


def publish(
    tables: Mapping[str, DataFrame], root: str, *, fmt: str | Mapping[str, str] = "parquet"
) -> dict[str, str]:
    """Write the named tables as one release below ``root``; return where each lies.

    Every release has a folder of its own, so a table may be made from those of
    an earlier one, and whoever reads these goes on reading them. The manifest
    is written last, when all tables are there and were read back once for their
    counts and checksums: a release that broke off is never seen.
    """
    spark = next(iter(tables.values())).sparkSession
    root = root.rstrip("/")
    earlier = _releases(spark, root)
    release = 1 if earlier is None else (earlier.agg(F.max("release")).first()[0] or 0) + 1
    folder = f"{root}/release-{release}-{uuid.uuid4().hex}"
    paths, entries = {}, []
    for name, df in tables.items():
        kind = fmt if isinstance(fmt, str) else fmt.get(name, "parquet")
        paths[name] = path = f"{folder}/{name}"
        if kind == "csv":
            write_csv(df, path)
        else:
            df.write.format(kind).save(path)
        schema = T.StructType.fromJson(json.loads(df.schema.json()))
        mark = fingerprint(_read_back(spark, path, kind, schema)).first()
        entries.append((name, release, path, kind, schema.json(), mark["n_rows"], mark["checksum"]))
    rows = spark.createDataFrame(pa.table(dict(zip(_names(MANIFEST), zip(*entries, strict=True), strict=True))), MANIFEST)
    rows.coalesce(1).write.mode("append").parquet(f"{root}/manifest")
    return paths


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]
