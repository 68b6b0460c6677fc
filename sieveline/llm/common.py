"""What the corpus operators share: written tables, text batches and the split of labelled rows."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a batch that Python holds at once, and characters of text after which a batch ends.
BATCH_ROWS = 2_000
BATCH_CHARS = 1_000_000
#: Characters of the longest text that a cache keeps.
LONGEST_KEY = 40


_FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_root(spark: SparkSession) -> str:
    """The folder that the session names for checkpoints; a new local one only where none is named and all runs on this machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="sieveline-")
        spark.sparkContext.setCheckpointDir(named)
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df below the shared checkpoint folder and read it back: lineage ends there, and it is computed once.

    Any executor can read the table again after another one is lost. It goes when the Python driver ends.
    """
    spark = df.sparkSession
    path = f"{checkpoint_root(spark).rstrip('/')}/sieveline/{label}-{uuid.uuid4().hex}"
    # Shuffles of a table that is written are never read again: their files go with the write, not when the driver next collects its garbage.
    before = spark.conf.get(_FREE_SHUFFLES, None)
    spark.conf.set(_FREE_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_FREE_SHUFFLES) if before is None else spark.conf.set(_FREE_SHUFFLES, before)
    _clean_later(spark, path)
    return spark.read.schema(df.schema).parquet(path)


_written: list[tuple] = []


def _clean_later(spark: SparkSession, path: str) -> None:
    if not _written:
        atexit.register(_clean)
    _written.append((spark, path))


def _clean() -> None:
    for spark, path in _written:
        try:
            jvm = spark.sparkContext._jvm
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
        except Exception:  # noqa: BLE001  the session may be gone already; the files are scratch
            return


def slices(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[pa.RecordBatch]:
    """The same rows in batches of bounded size, however long the texts are."""
    for batch in batches:
        sizes = batch.column(text).nbytes / max(1, batch.num_rows)
        rows = max(1, min(BATCH_ROWS, int(BATCH_CHARS / max(1.0, sizes))))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def map_rows(df: DataFrame, columns: list[str], make: Callable[[], Callable], schema: str, text: str = "text") -> DataFrame:
    """mapInArrow over the named columns. make() runs once in each task and gives batch -> dict of columns or None.

    An attribute `last` of what make() returns is called without arguments when the task's rows are over.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))
    fields = arrow.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _begin()
        step = make()
        _drop_unasked()

        def out(columns: dict) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([x if isinstance(x := columns[f], pa.Array) else pa.array(x, arrow.field(f).type) for f in fields], schema=arrow)

        for batch in slices(batches, text):
            if batch.num_rows and (columns := step(batch)) is not None:
                yield out(columns)
        if (last := getattr(step, "last", None)) and (columns := last()) is not None:
            yield out(columns)
        step = last = batch = columns = None
        _give_back()

    _bound_batches(df.sparkSession)
    return df.select(*columns).mapInArrow(run, schema)


#: What a worker process holds from task to task, and the keys that the task at hand has asked for.
_held: dict = {}
_asked: set = set()


def _begin() -> None:
    _asked.clear()


def held(key, compute: Callable):
    """compute()'s result, the same for all tasks of a worker process that ask for the key one after the other. To be called within a make() of map_rows."""
    _asked.add(key)
    if key not in _held:
        _held[key] = compute()
    return _held[key]


def _drop_unasked() -> None:
    """A task of another operator is here: what earlier ones held would lie beside what this one needs."""
    gone = _held.keys() - _asked
    for key in gone:
        del _held[key]
    if gone:
        gc.collect()
        _give_back()


def _give_back() -> None:
    """Freed memory goes back to the system: worker processes live on between tasks, and an executor's share is counted over all of them."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        return


def _bound_batches(spark: SparkSession) -> None:
    """What the JVM sends to a Python worker at once is no more than the worker slices it into: BATCH_ROWS rows, where the session allows more."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if not 0 < now <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


#: The columns of documents that a stage of a pipeline passes on.
DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"


def keep_batches(docs: DataFrame, make: Callable[[], Callable]) -> DataFrame:
    """The rows of docs, with the columns of documents, for which make()(batch) says so."""
    columns = ["doc_id", "text", "lang", "source", "n_chars"]

    def filtering():
        keeps = make()

        def step(batch):
            kept = batch.filter(pa.array(keeps(batch), pa.bool_()))
            return {c: kept.column(c) for c in columns}

        return step

    return map_rows(docs, columns, filtering, DOCUMENT)


def keep_rows(docs: DataFrame, make: Callable[[], Callable]) -> DataFrame:
    """As keep_batches, by the texts alone: make()(texts)."""

    def by_text():
        keeps = make()
        return lambda batch: [bool(x) for x in keeps(batch.column("text").to_pylist())]

    return keep_batches(docs, by_text)


def fold(doc_id) -> int:
    """crc32 of the id's decimal text modulo 4; rows of remainder 2 are held out, rows without an id are too."""
    return 2 if doc_id is None else zlib.crc32(str(doc_id).encode()) % 4


def fold_column(doc_id: str = "doc_id"):
    """fold() as a column."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4, F.lit(2))


class Remembered(dict):
    """A bounded cache as a dict: a missing key is computed. It holds two generations of half of `most` each: what is asked for again stays.

    Long texts aren't kept as keys, so that the cache is bounded in bytes too.
    """

    def __init__(self, compute: Callable, most: int) -> None:
        super().__init__()
        self.compute, self.half, self.before = compute, most // 2, {}

    def __missing__(self, key):
        value = self.before.get(key, self)
        if value is self:
            value = self.compute(key)
            if type(key) is str and len(key) > LONGEST_KEY:
                return value
        if len(self) >= self.half:
            self.before = dict(self)
            self.clear()
        self[key] = value
        return value
