"""Helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: bytes.translate table: A-Z to a-z, nothing else.
LOWER_BYTES = bytes.maketrans(UPPER.encode(), LOWER.encode())
#: bytes.translate table: A-Z to a-z, every other ASCII byte but letters and digits to a space.
ALNUM_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)
#: Rows of one Arrow batch; keeps a batch of long texts within a worker's memory.
BATCH_ROWS = 1000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # workers of a local master find the package where the driver has it; a cluster gets it by --py-files
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(col: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(col, UPPER, LOWER)


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Lowers the session's Arrow batch size to ``rows`` where it is larger."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null is empty."""
    return [b or b"" for b in column.cast(pa.binary()).to_pylist()]


def map_texts(
    df: DataFrame,
    text_col: str,
    make: Callable[[], Callable[[list[bytes]], Iterable]],
    out: T.StructType,
    keep: list[str],
) -> DataFrame:
    """Adds the columns ``out`` to ``keep`` by a function of a batch of texts.

    ``make`` runs once a task; what it returns maps a list of UTF-8 texts to one sequence (or Arrow array) per
    field of ``out``. A kept column whose name is among ``out`` gives way to the new one; one whose name starts with two
    underscores is left out.
    """
    small_batches(df.sparkSession)
    keep = kept(keep, [f.name for f in out.fields])
    schema = T.StructType([df.schema[c] for c in keep] + out.fields)
    arrow = to_arrow_schema(schema)
    types = [arrow.field(f.name).type for f in out.fields]
    src = df.select(*[col(c).alias(f"__{i}") for i, c in enumerate(keep)], col(text_col).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            new = fn(texts_of(batch.column(batch.num_columns - 1)))
            cols = [batch.column(i) for i in range(len(keep))]
            cols += [x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(new, types, strict=True)]
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)
        getattr(fn, "done", lambda: None)()  # workers live on: what a function has kept goes with its task

    return src.mapInArrow(run, schema)


def col(name: str) -> Column:
    """A column by its exact name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def kept(columns: list[str], results: Iterable[str]) -> list[str]:
    """The columns that pass through: not those named like a result (in any case) or with two leading underscores."""
    names = {r.lower() for r in results}
    return [c for c in columns if c.lower() not in names and not c.startswith("__")]


def crc_mod(col: Column, m: int) -> Column:
    """crc32 of the value's text, modulo ``m``; a null counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(col.cast("string"), F.lit(""))), F.lit(m))


def crc_sql(text: str) -> str:
    """DuckDB's unsigned crc32 of an ASCII text."""
    bits = "list_reduce(list_prepend(xor(a, b), range(8)), lambda r, k: xor(r >> 1, CASE WHEN r & 1 = 1 THEN 3988292384 ELSE 0 END))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length({text}) + 1), lambda i: ord({text}[i])::BIGINT)), lambda a, b: {bits}), 4294967295)"
