"""What the corpus operators share: tables, words, batches of rows, stored steps."""

from __future__ import annotations

import os
import re
import shutil
import tempfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space between words: the six ASCII characters, as a character class for any regex engine.
SPACE = r"\x20\x09-\x0D"
WORD = f"[^{SPACE}]+"
WORD_RE = re.compile(WORD)
#: Bytes of text one step inside a task works on, so that memory does not follow the batch size.
CHUNK_BYTES = 4 << 20
#: Bytes of one Arrow batch between the JVM and a Python worker.
BATCH_BYTES = 8 << 20

_shipped: dict[str, tempfile.TemporaryDirectory] = {}  # kept while executors may still fetch it

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def ship(spark: SparkSession) -> None:
    """Send this package to the workers, as ``--py-files`` does, unless they can import it anyway, and
    pass texts to them in small batches: rows are long, and every task holds a few batches."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    root = Path(__file__).resolve().parents[2]
    known = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    context = spark.sparkContext
    if any(p and Path(p).resolve() == root for p in known) or context.applicationId in _shipped:
        return
    folder = _shipped[context.applicationId] = tempfile.TemporaryDirectory(prefix="ordstack-")
    context.addPyFile(shutil.make_archive(f"{folder.name}/ordstack-package", "zip", root, "ordstack"))


def read(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def columns(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that nothing else of the input can clash with what is added."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def unused(df: DataFrame, name: str) -> str:
    """A name like ``name`` that no column of ``df`` has, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"{name}_"
    return name


def text_of(name: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(name), F.lit(""))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often and in whatever lambda it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def n_words(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def schema_of(ddl: str) -> T.StructType:
    return T._parse_datatype_string(ddl)


def map_texts(
    df: DataFrame, work: Callable[[list[str | None]], list[tuple]], added: str, text: str = "text"
) -> DataFrame:
    """``df`` without its text, with the columns of the DDL ``added`` that ``work`` makes of the texts.

    ``work`` gets lists of texts of about ``CHUNK_BYTES`` together (one text may be longer) and
    returns one tuple per text. Other columns pass through untouched, whatever their types.
    """
    others = [f for f in df.schema.fields if f.name != text]
    new = schema_of(added).fields
    out = T.StructType([*others, *new])
    names = [f.name for f in out.fields]
    at = df.columns.index(text)
    rest = [i for i, f in enumerate(df.schema.fields) if f.name != text]
    arrow = [_arrow(f.dataType) for f in new]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in spans(batch.column(at)):
                part = batch.slice(lo, hi - lo)
                made = work(part.column(at).to_pylist())
                columns_ = list(zip(*made)) if made else [[] for _ in arrow]
                yield pa.RecordBatch.from_arrays(
                    [part.column(i) for i in rest]
                    + [pa.array(list(c), type=t) for c, t in zip(columns_, arrow)],
                    names=names,
                )

    return df.mapInArrow(run, out)


def spans(texts: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges whose texts have about ``most`` bytes together, one row at least."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
    lo, held = 0, 0
    for i, n in enumerate(sizes):
        if i > lo and held + n > most:
            yield lo, i
            lo, held = i, 0
        held += n
    if lo < len(sizes):
        yield lo, len(sizes)


def _arrow(kind: T.DataType) -> pa.DataType:
    simple = {
        "string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(),
        "boolean": pa.bool_(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64()),
        "array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string()),
    }
    return simple[kind.simpleString()]
