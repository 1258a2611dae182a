"""Shared plumbing: scratch tables in the cluster's shared folder, Arrow mapping, components."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import os
import sys
import tempfile
import time
import uuid
from collections.abc import Iterable, Iterator, Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

ROOT = str(Path(__file__).resolve().parents[2])
#: Rows handled at once in Python: small, since one text may be very long.
BATCH_ROWS = 512
#: Bytes of an Arrow batch. Spark's default is 64 MB, which each task holds several times
#: over; sessions that have it get this. A value that the caller has set stays.
BATCH_BYTES, DEFAULT_BYTES, SMALL_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "4194304b"
#: Tables of a key and a number, some 60 bytes a row in memory, are broadcast up to so many
#: rows: 6 MB. Spark goes by the bytes of their compressed files, which may be far fewer.
MAX_BROADCAST_ROWS = 100_000
#: The caller's columns travel in one struct of this name, so that no name of theirs
#: clashes with ours or has to be quoted.
KEEP = "_keep"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, which every executor can reach.

    Where the setting is missing, a single machine gets a folder of its own; a cluster
    is refused, since its executors couldn't see one another's files.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="lorequarry-")
        spark.conf.set("spark.checkpoint.dir", base)
        atexit.register(_remove_local, base[len("file://"):])
    return f"{base.rstrip('/')}/lorequarry/{name}-{uuid.uuid4().hex[:12]}"


def _remove_local(path: str) -> None:
    import shutil

    shutil.rmtree(path, ignore_errors=True)


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


class Scratch:
    """The scratch tables of one run of an operator.

    ``write`` cuts the lineage: the table lies in the shared folder, where it outlives
    the executors that wrote it. ``drop`` deletes tables that nothing will read again.
    What a returned DataFrame still reads stays until ``release``, or until the shared
    folder is cleared with the cluster's own checkpoints.
    """

    _watched: list[list[Scratch]] = []

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}
        for watched in Scratch._watched:
            watched.append(self)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = shared_dir(self.spark, name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (path, out)
        return out

    def drop(self, *tables: DataFrame | None) -> None:
        for table in tables:
            if table is not None and id(table) in self.paths:
                drop_path(self.spark, self.paths.pop(id(table))[0])

    def tidy(self) -> None:
        """Delete the shuffle files of what was written: they go with the driver's last
        reference to their plan, the second time that it looks for such."""
        gc.collect()
        for pause in (0.2, 0):
            self.spark._jvm.System.gc()
            time.sleep(pause)

    def release(self) -> None:
        for path, _ in self.paths.values():
            drop_path(self.spark, path)
        self.paths.clear()


@contextlib.contextmanager
def opened():
    """The list of scratches that are opened in the block, for a caller who will release them."""
    out: list[Scratch] = []
    Scratch._watched.append(out)
    try:
        yield out
    finally:
        Scratch._watched[:] = [w for w in Scratch._watched if w is not out]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """One table written to the shared folder and read again."""
    return Scratch(df.sparkSession).write(df, name)


def bounded(df: DataFrame, rows: int) -> DataFrame:
    """The side of a join that has at most ``rows`` rows; beyond the bound it never passes the driver."""
    return df if rows <= MAX_BROADCAST_ROWS else df.hint("merge")


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def packed(docs: DataFrame, keep: Sequence[str], replaced: Iterable[str] = ()) -> tuple[Column, list[str]]:
    """The columns ``keep`` as one struct, and their names; those of ``replaced`` are left out."""
    gone = {r.lower() for r in replaced}
    names = [n for n in keep if n.lower() not in gone]
    fields = [docs[quoted(n)].alias(n) for n in names] or [F.lit(None).cast("int").alias("none")]
    return F.struct(*fields).alias(KEEP), names


def unpacked(df: DataFrame, names: Sequence[str], *more) -> DataFrame:
    """The columns out of the struct again, and ``more``."""
    return df.select(*[F.col(KEEP).getField(n).alias(n) for n in names], *more)


def schema_of(df: DataFrame, names: Sequence[str], added: str = "") -> StructType:
    """The types of some columns, followed by ``added`` in DDL."""
    own = {f.name: f for f in df.schema}
    return StructType([own[n] for n in names] + (StructType.fromDDL(added).fields if added else []))


def arrow_map(df: DataFrame, target: str, schema, **params) -> DataFrame:
    """``mapInArrow`` with the function given as ``module:function`` of this package.

    The function is imported on the executor rather than shipped, so per-process
    caches live until the worker gets a function of another module. It gets batches of
    at most BATCH_ROWS rows.
    """
    module, function = target.split(":")
    root, here = ROOT, __name__

    def run(batches):
        import importlib
        import sys

        if root not in sys.path:
            sys.path.append(root)
        shared = importlib.import_module(here)
        shared.hold_only(module)
        return getattr(importlib.import_module(module), function)(shared.parts(batches), **params)

    conf = df.sparkSession.conf
    if conf.get(BATCH_BYTES) == DEFAULT_BYTES:
        conf.set(BATCH_BYTES, SMALL_BYTES)
    return df.mapInArrow(run, schema)


#: The last module with caches of its own whose function this worker ran.
_holding: list[str] = []


def hold_only(module: str) -> None:
    """Let go of the caches of other modules: Spark gives a worker the tasks of all operators.

    A module with caches has a function ``forget``. What they took goes back to the system.
    """
    if module == __name__ or module in _holding:
        return
    for other in _holding:
        getattr(sys.modules[other], "forget", lambda: None)()
    if _holding:
        import pyarrow as pa

        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # another C library
            ctypes.CDLL(None).malloc_trim(0)
    _holding[:] = [module]


def parts(batches) -> Iterator:
    for batch in batches:
        for start in range(0, batch.num_rows, BATCH_ROWS):
            yield batch.slice(start, BATCH_ROWS)


def per_text(docs: DataFrame, target: str, added: str, keep: Sequence[str], **params) -> DataFrame:
    """Columns ``keep`` and those that ``target`` makes of each text, which replace any of the same name."""
    names = StructType.fromDDL(added).names
    kept, own = packed(docs, keep, names)
    rows = docs.select(kept, "text")
    return unpacked(arrow_map(rows, target, schema_of(rows, [KEEP], added), **params), own, *names)


def document_key() -> Column:
    """128 bits of a document's id, of any type, and its text; equal rows share them, nulls included."""
    part = lambda c: F.coalesce(F.md5(F.col(c).cast("string")), F.lit("-"))
    return F.unhex(F.md5(F.concat(part("doc_id"), F.lit("/"), part("text"))))


def _contract_batches(batches):
    """Union-find over the edges of one task: every id with the smallest id it reaches there."""
    import pyarrow as pa

    root: dict = {}
    kind = None

    def find(k):
        top = k
        while (up := root.setdefault(top, top)) != top:
            top = up
        while root[k] != top:
            root[k], k = top, root[k]
        return top

    for batch in batches:
        kind = batch.schema.field("u").type
        for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist()):
            a, b = find(u), find(v)
            if a != b:
                root[max(a, b)] = min(a, b)
    found = [(k, find(k)) for k in list(root)]
    found = [x for x in found if x[0] != x[1]]
    for start in range(0, len(found), 100_000):
        u, v = zip(*found[start : start + 100_000])
        yield pa.RecordBatch.from_arrays([pa.array(u, kind), pa.array(v, kind)], names=["u", "v"])


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", edges_per_task: int = 500_000) -> DataFrame:
    """Distributed union-find: rows (id, component) for every id on an edge, as a scratch table.

    Tasks first contract bounded numbers of edges to stars. Large-star and small-star
    rounds then join the stars of different tasks: least neighbours are found by
    aggregation with map-side combine and joined back, so no neighbourhood is gathered
    in one place. The rounds end once every id hangs on a root and no root on anything,
    which they reach in a number of rounds that is logarithmic in the longest path.
    ``component`` is the smallest id that can be reached. Ids may have any ordered type.
    """
    scratch = Scratch(edges.sparkSession)
    raw = scratch.write(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges")
    n = raw.count()
    tasks = max(1, -(-n // edges_per_task))
    now = scratch.write(arrow_map(raw.coalesce(tasks), f"{__name__}:_contract_batches", raw.schema), "stars")
    scratch.drop(raw)
    while True:
        # stars: no child is a root, none hangs on two roots
        roots = now.select(F.col("v").alias("u")).distinct().withColumn("root", F.lit(1))
        children = now.groupBy("u").agg(F.count("*").alias("n"))
        if not children.join(bounded(roots, n), "u", "left").where("n > 1 or root = 1").head(1):
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(bounded(least, 2 * n), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        ends = F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))
        small = large.join(bounded(low, 2 * n), "u").select(F.explode(ends).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        before, now = now, scratch.write(small, "stars")
        scratch.drop(before)
    found = now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
    out = scratch.write(found, "components")
    scratch.drop(now)
    return out
