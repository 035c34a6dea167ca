"""Calls to a model service as resumable jobs: many at once in each task, every answer on record before it is passed on.

A journal is a folder of JSON lines that driver and executors share. A task writes the answers that have come in since
it last looked as one small file, and joins its files to one at its end. A task that runs again, after a lost executor
or a second evaluation, first reads what its earlier attempts have on record; a later job reads the whole journal and
asks only for the rest. So no answered call is ever repeated; calls in flight when a task dies are.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import FIRST_COMPLETED, Future, ThreadPoolExecutor, wait
from functools import reduce

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a task hands on at once.
OUT_ROWS = 1000


def may_pass(error: Exception) -> bool:
    """Whether a call may work later: the service is busy (429) or failed itself (5xx), or cannot be reached."""
    status = getattr(error, "status", getattr(error, "code", None))
    return isinstance(error, (ConnectionError, TimeoutError)) or (isinstance(status, int) and (status == 429 or 500 <= status < 600))


def asked(call: Callable[[str], str], text: str, tries: int, pause: float) -> tuple[str | None, str | None]:
    """Reply and error of one call, tried again after ``pause`` seconds, twice that, and so on, where that may help."""
    for k in range(tries):
        try:
            return call(text), None
        except Exception as e:  # noqa: BLE001  any failure of the caller's model is a result here
            if not may_pass(e) or k + 1 == tries:
                return None, str(e)
            time.sleep(pause * 2**k)
    return None, "never tried"


class Records:
    """What one task has on record, over all its attempts: files in ``folder``, on any store that Arrow reaches."""

    def __init__(self, folder: str):
        from pyarrow import fs

        self.store, self.folder = fs.FileSystem.from_uri(folder)
        self.select = fs.FileSelector(self.folder, allow_not_found=True)
        self.store.create_dir(self.folder, recursive=True)

    def _files(self) -> list[str]:
        return [x.path for x in self.store.get_file_info(self.select) if x.path.endswith(".jsonl")]

    def read(self) -> list[dict]:
        out = []
        for path in self._files():
            with self.store.open_input_stream(path) as f:
                lines = f.read().decode("utf-8", "replace").split("\n")
            for line in lines:
                try:
                    out.append(json.loads(line))
                except ValueError:
                    continue  # a file that was being written when its task died
        return out

    def write(self, records: list[dict]) -> None:
        with self.store.open_output_stream(f"{self.folder}/{uuid.uuid4().hex}.jsonl") as f:
            f.write("".join(json.dumps(r) + "\n" for r in records).encode())

    def join(self) -> None:
        """One file instead of many; a task that dies in between leaves records twice, which readers allow."""
        old = self._files()
        if len(old) > 1:
            self.write(self.read())
            for path in old:
                self.store.delete_file(path)


def recorded(spark: SparkSession, journal: str, keys: str) -> DataFrame:
    """``keys`` (as DDL) and ``reply`` of every answered call in a journal, once each."""
    names = [f"`{x.split()[0]}`" for x in keys.split(", ")]
    rows = spark.read.schema(f"{keys}, reply string").option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").json(journal)
    return rows.where("reply is not null").groupBy(*names).agg(F.min("reply").alias("reply"))


def _same(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    return reduce(Column.__and__, [a[k].eqNullSafe(b[k]) for k in keys])


def annotate(
    work: DataFrame, keys: list[str], prompt: str, call: Callable[[str], str], tries: int = 3, pause: float = 1.0, *, workers: int = 8, journal: str | None = None, tasks: int | None = None
) -> DataFrame:
    """``keys, reply, error`` of a call per row; a failing row is recorded and stays in the next work list.

    Each task keeps ``workers`` calls in flight. Failures that may pass are tried again after ``pause`` seconds, twice
    that, and so on; others are not. With a ``journal`` (a URI; keys are then strings or whole numbers) answered calls
    come from there, and the rest is dealt to ``tasks`` by key, so that an attempt finds its predecessors' records. Rows
    of one key in a task are asked for once. Keep speculative execution off: it would ask twice.
    """
    spark = work.sparkSession
    ddl = ", ".join(f"{k} {work.schema[k].dataType.simpleString()}" for k in keys)
    rows, old, place = work.select(*keys, F.col(prompt).alias("_prompt")), None, None
    if journal is not None:
        if has_files(spark, journal):
            done = recorded(spark, journal, ddl)
            old = rows.join(done, _same(rows, done, keys)).select(*[rows[k] for k in keys], done["reply"], F.lit(None).cast("string").alias("error"))
            rows = rows.join(done, _same(rows, done, keys), "left_anti")
        rows = rows.repartition(tasks or int(spark.conf.get("spark.sql.shuffle.partitions")), *keys)
        place = f"{journal.rstrip('/')}/{uuid.uuid4().hex}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        records = None if place is None else Records(f"{place}/{TaskContext.get().partitionId()}")
        known = {} if records is None else {tuple(r.get(k) for k in keys): (r["reply"], r["error"]) for r in records.read() if r.get("reply") is not None}
        flying: dict[tuple, list] = {}  # of each key: its call and how many rows wait for it
        out: list[tuple] = []

        def landed(most: int) -> None:
            """Waits until at most ``most`` calls are in flight; what came in goes on record first."""
            while len(flying) > most:
                wait([f for f, _ in flying.values()], return_when=FIRST_COMPLETED)
                ready = {k: (f.result(), n) for k, (f, n) in flying.items() if f.done()}
                if records is not None:
                    records.write([dict(zip(keys, k, strict=True), reply=r, error=e) for k, ((r, e), _) in ready.items()])
                for k, ((r, e), n) in ready.items():
                    del flying[k]
                    known[k] = (r, e)
                    out.extend([(*k, r, e)] * n)

        kinds: list[pa.DataType] = []

        def rows_out() -> Iterator[pa.RecordBatch]:
            if out:
                columns = zip(zip(*out, strict=True), [*kinds, pa.string(), pa.string()], strict=True)
                yield pa.record_batch([pa.array(c, t) for c, t in columns], names=[*keys, "reply", "error"])
                out.clear()

        with ThreadPoolExecutor(workers) as pool:
            for batch in batches:
                kinds[:] = [x.type for x in batch.schema][: len(keys)]
                for *own, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    key = tuple(own)
                    if key in known:
                        out.append((*key, *known[key]))
                    elif key in flying:
                        flying[key][1] += 1
                    else:
                        flight: Future = pool.submit(asked, call, text, tries, pause)
                        flying[key] = [flight, 1]
                        landed(2 * workers - 1)
                    if len(out) >= OUT_ROWS:
                        yield from rows_out()
            landed(0)
        if records is not None:
            records.join()
        yield from rows_out()

    new = rows.mapInArrow(run, f"{ddl}, reply string, error string")
    return new if old is None else new.unionByName(old)


def has_files(spark: SparkSession, path: str) -> bool:
    """Whether there is anything under ``path``, on any file system that Spark reaches."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return store.exists(at) and store.listFiles(at, True).hasNext()
