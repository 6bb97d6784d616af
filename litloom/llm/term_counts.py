"""Frequency of every distinct term by recursive radix spilling.

Terms are pre-aggregated where they are read, moved once by the leading bits
of their hash, and each radix partition is aggregated out of core: while it is
larger than the memory given to a task, it is split by further hash bits into
files of the shared folder and each part is aggregated by DuckDB on its own.
A term that fills a third of all rows reaches its partition as one row per
reading task.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litloom.runtime import shared_dir

SCHEMA = pa.schema([("term", pa.string()), ("uses", pa.int64()), ("n_rows", pa.int64())])
BITS = 4  # hash bits by which a part is split at each level


def spill_folder(df: DataFrame) -> str:
    """The folder for spilled parts below the shared folder, qualified by the file system Spark itself would use."""
    spark = df.sparkSession
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.makeQualified(at).toString().rstrip("/") + "/radix"


class Shared:
    """Parquet parts below a folder of any file system that Arrow knows; a plain path is a file system's own."""

    def __init__(self, folder: str):
        from pyarrow import fs

        self.fs, self.root = fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", re.sub("^file:/*", "file:///", folder if ":" in folder else f"file://{folder}")))
        self.path = self.root if self.fs.type_name == "local" else None  # where DuckDB may spill itself

    def write(self, part: str, rows: pa.Table) -> None:
        self.fs.create_dir(f"{self.root}/{part}", recursive=True)
        pq.write_table(rows, f"{self.root}/{part}/{uuid.uuid4().hex}.parquet", compression="zstd", filesystem=self.fs)

    def batches(self, part: str) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for f in sorted(self.fs.get_file_info(fs.FileSelector(f"{self.root}/{part}", allow_not_found=True)), key=lambda f: f.path):
            with self.fs.open_input_file(f.path) as file:
                yield from pq.ParquetFile(file).iter_batches(50_000)

    def drop(self, part: str = "") -> None:
        from pyarrow import fs

        at = f"{self.root}/{part}".rstrip("/")
        if self.fs.get_file_info(at).type == fs.FileType.Directory:
            self.fs.delete_dir(at)


def _connect(memory_mb: int, temp: str | None):
    import duckdb

    con = duckdb.connect()
    con.execute(f"SET memory_limit='{memory_mb}MB'")
    con.execute("SET threads=1")
    con.execute("SET preserve_insertion_order=false")
    con.execute(f"SET temp_directory='{temp or ''}'")
    return con


def _sum(con, part: pa.Table) -> pa.Table:
    con.register("part", part)
    got = con.sql("SELECT term, sum(uses)::BIGINT AS uses, sum(n_rows)::BIGINT AS n_rows FROM part GROUP BY term").to_arrow_table()
    con.unregister("part")
    return got.cast(SCHEMA)


class Radix:
    """Sums (term, uses, n_rows) of any number of batches within a bound of memory."""

    def __init__(self, folder: str | None, bytes_in_memory: int = 64 << 20, memory_mb: int = 256, level: int = 0):
        self.root, self.limit, self.memory_mb, self.level = folder, bytes_in_memory, memory_mb, level
        self.own = Shared(f"{folder}/{uuid.uuid4().hex}") if folder else None
        self.held: list[pa.RecordBatch] = []
        self.size, self.spilled = 0, False
        self.con = None

    def add(self, batch: pa.RecordBatch) -> None:
        self.held.append(batch)
        self.size += batch.nbytes
        if self.size > self.limit:
            self._shrink()

    def _table(self) -> pa.Table:
        return pa.Table.from_batches(self.held, SCHEMA)

    def _shrink(self) -> None:
        """Aggregate what is held; write it by hash bits if that isn't enough."""
        self.con = self.con or _connect(self.memory_mb, self.own.path if self.own else None)
        small = _sum(self.con, self._table())
        self.held, self.size = small.to_batches(), small.nbytes
        if self.size > self.limit // 2 and self.own:
            self._spill(small)
            self.held, self.size = [], 0

    def _spill(self, part: pa.Table) -> None:
        import pyarrow.compute as pc

        if part.num_rows == 0:
            return
        self.con.register("part", part)
        shift = 60 - BITS * self.level
        cut = self.con.sql(f"SELECT *, ((hash(term) >> {shift}) & {(1 << BITS) - 1})::INTEGER AS b FROM part").to_arrow_table()
        self.con.unregister("part")
        for b in range(1 << BITS):
            rows = cut.filter(pc.equal(cut["b"], b)).drop(["b"])
            if rows.num_rows:
                self.own.write(f"b{b}", rows)
        self.spilled = True

    def result(self) -> Iterator[pa.RecordBatch]:
        try:
            self.con = self.con or _connect(self.memory_mb, self.own.path if self.own else None)
            small = _sum(self.con, self._table()) if self.held else None
            if not self.spilled:
                if small is not None:
                    yield from small.to_batches(max_chunksize=50_000)
                return
            if small is not None:
                self._spill(small)
            self.held, self.size = [], 0
            for b in range(1 << BITS):
                # At the last level the bits are used up: DuckDB's own out-of-core aggregation takes the rest.
                sub = Radix(self.root if self.level < 14 else None, self.limit, self.memory_mb, self.level + 1)
                for batch in self.own.batches(f"b{b}"):
                    sub.add(batch)
                yield from sub.result()
                self.own.drop(f"b{b}")
        finally:
            if self.con is not None:
                self.con.close()
            if self.own:
                self.own.drop()


def _radix_map(folder: str, bytes_in_memory: int):
    def run(batches):
        sums = Radix(folder, bytes_in_memory)
        for b in batches:
            sums.add(pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(b.columns, SCHEMA.types)], schema=SCHEMA))
        yield from sums.result()

    return run


def _list_sums(lists: pa.Array) -> pa.RecordBatch:
    """(term, uses, n_rows) of a batch of rows' term lists; null and empty terms left out."""
    import pyarrow.compute as pc

    row, term = pc.list_parent_indices(lists), lists.flatten()
    keep = pc.fill_null(pc.greater(pc.binary_length(term), 0), False)
    term = term.filter(keep).dictionary_encode()
    code, row = term.indices.to_numpy(zero_copy_only=False).astype(np.int64), row.filter(keep).to_numpy(zero_copy_only=False).astype(np.int64)
    n = len(term.dictionary)
    held = np.unique(row * max(n, 1) + code) % max(n, 1)
    return pa.RecordBatch.from_arrays([term.dictionary.cast(pa.string()), pa.array(np.bincount(code, minlength=n)), pa.array(np.bincount(held, minlength=n))], schema=SCHEMA)


def _lists_map(folder: str, bytes_in_memory: int):
    def run(batches):
        sums = Radix(folder, bytes_in_memory)
        for b in batches:
            sums.add(_list_sums(b.column(0)))
        yield from sums.result()

    return run


def term_counts(baskets: DataFrame, items: str = "items", bytes_in_memory: int = 32 << 20) -> DataFrame:
    """``term, uses, n_rows`` of every distinct term.

    ``baskets`` has one row per record and an array of terms; ``uses`` counts
    every occurrence, ``n_rows`` the rows that hold the term.  Null arrays,
    null terms and empty terms do not count; an empty table gives no row; extra
    columns are ignored.  ``bytes_in_memory`` bounds what a task holds before
    it aggregates or spills; no term is ever dropped.
    """
    schema = "term string, uses long, n_rows long"
    folder = spill_folder(baskets)
    part = baskets.select(F.col(items).alias("i")).mapInArrow(_lists_map(folder, bytes_in_memory), schema)
    moved = part.repartition(F.xxhash64("term"))
    return moved.mapInArrow(_radix_map(folder, bytes_in_memory), schema)


def band_terms(counts: DataFrame, n_rows: int, rare_at_most: int = 2, common_share: float = 0.1) -> DataFrame:
    """``counts`` with ``band``: rare, common or useful."""
    return counts.withColumn(
        "band",
        F.when(F.col("n_rows") <= rare_at_most, "rare")
        .when(F.col("n_rows") > F.lit(float(n_rows)) * common_share, "common")
        .otherwise("useful"),
    )
