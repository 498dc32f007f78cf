"""What the corpus operators share: shared-folder checkpoints, Arrow mapping, word dictionaries."""

from __future__ import annotations

import sys
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Separators of words: space and the five ASCII control blanks. bytes.split() splits at exactly these.
SEPARATORS = " \t\n\x0b\x0c\r"


_HELD: dict = {}


def held(key: object, make: Callable[[], object]) -> object:
    """What a Python worker keeps from task to task: one thing at a time. A worker outlives its stage and is used
    again, so asking for another drops what an earlier stage left."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


def release() -> None:
    """For stages that keep nothing."""
    _HELD.clear()


def char_ranges(test: Callable[[str], bool]) -> str:
    """The ranges of a character class, for a pattern."""
    out, start = [], None
    for i in range(sys.maxunicode + 2):
        ok = i <= sys.maxunicode and not 0xD800 <= i < 0xE000 and test(chr(i))
        if ok and start is None:
            start = i
        elif not ok and start is not None:
            out.append(f"\\U{start:08x}-\\U{i - 1:08x}")
            start = None
    return "".join(out)


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where that is unset (tests), a local one is set, in local mode only."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if named is None and sc.master.split("[")[0] != "local":
        raise RuntimeError("spark.checkpoint.dir is unset: a cluster needs a folder that all its machines share")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="brindle-checkpoint-"))
    return named or sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and written to the shared checkpoint folder, so that a lost executor loses nothing."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of any store that Spark writes to."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def text_rows(df: DataFrame, text_col: str, *keep: str, binary: bool = False) -> DataFrame:
    """The kept columns and the text as __text, null as empty: only these columns reach the scan."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return df.select(*(F.col(c) for c in keep), (text.cast("binary") if binary else text).alias("__text"))


def with_fields(df: DataFrame, ddl: str) -> StructType:
    """df's schema, and after it the fields of ddl."""
    return StructType([*df.schema.fields, *StructType.fromDDL(ddl).fields])


#: Characters from which a text is dealt in chunks.
CHUNK = 1 << 15


def by_chunks(
    docs: DataFrame,
    keep: list[str],
    text_col: str,
    ddl: str,
    whole: Callable[[list[str]], list],
    split: Callable[[str, int], list[str]],
    part: Callable[[list[str]], list[bytes]],
    joined: Callable[[list[bytes]], tuple],
    chunk: int = CHUNK,
) -> DataFrame:
    """keep and the columns of ddl for every row. Texts of up to `chunk` characters go to whole(), many at once. A longer one
    is split where the machine's state is known; its chunks are rows that any task may take, part() gives what each does
    to that state, and joined() combines these in order. One long text is so the work of many tasks.

    Long rows are kept in the shared folder meanwhile, numbered, so that chunks find their row again.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(*keep, text.alias("__text"))
    kept = rows.select(*keep).schema
    schema = StructType([*kept.fields, *StructType.fromDDL(ddl).fields])
    names = [f.name for f in schema.fields]

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                some = b.slice(at, 256)
                yield pa.RecordBatch.from_arrays([*(some.column(c) for c in keep), *whole(some.column("__text").to_pylist())], names)

    def cuts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for no, t in zip(b.column("__no"), b.column("__text")):
                parts = split(t.as_py(), chunk)
                yield pa.RecordBatch.from_arrays([pa.array([no.as_py()] * len(parts), pa.int64()), pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.string())], ["__no", "__at", "__part"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 64):
                some = b.slice(at, 64)
                yield pa.RecordBatch.from_arrays([some.column("__no"), some.column("__at"), pa.array(part(some.column("__part").to_pylist()), pa.binary())], ["__no", "__at", "__did"])

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for b in batches:
            for i in range(b.num_rows):
                got = joined([x["__did"] for x in b.column("__all")[i].as_py()])
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(i, 1).cast(f.type) for c, f in zip(keep, arrow)), *(pa.array([v], f.type) for v, f in zip(got, list(arrow)[len(keep) :]))], names)

    size = F.length("__text")
    long = cut(rows.where(size > chunk).withColumn("__no", F.monotonically_increasing_id()))
    dealt = long.select("__no", "__text").mapInArrow(cuts, "__no long, __at int, __part string").repartition("__no", "__at")
    did = dealt.mapInArrow(each, "__no long, __at int, __did binary").groupBy("__no").agg(F.sort_array(F.collect_list(F.struct("__at", "__did"))).alias("__all"))
    return rows.where(size <= chunk).mapInArrow(short, schema).union(long.drop("__text").join(did, "__no").drop("__no").mapInArrow(combine, schema))


def map_texts(df: DataFrame, fn: Callable[[list], dict[str, pa.Array | list]], schema: str, keep: list[str], rows: int = 512) -> DataFrame:
    """One row out for each row in. fn gets at most `rows` texts and returns the new columns; kept columns pass through."""
    from pyspark.sql.pandas.types import to_arrow_schema

    out = with_fields(df.select(*keep), schema)
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                b = whole.slice(at, rows)
                new = fn(b.column("__text").to_pylist())
                cols = [b.column(c) for c in keep] + [
                    v if isinstance(v := new[f.name], pa.Array) else pa.array(v, f.type) for f in list(arrow)[len(keep) :]
                ]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, arrow)], schema=arrow)

    return df.mapInArrow(run, out)
