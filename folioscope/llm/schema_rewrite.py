"""Drifted schema rewrite: an external merge sort into files, and a rewrite of old schemas by field id.

`merge_sort` sorts a table into files of equally many rows.  Tasks spill sorted runs.  The keys at
which the files begin are found by rank, exactly: counts of leading digits of the key tell the few
rows among which a cut lies, and only these are ranked.  Runs are sliced at the cuts into packed,
sorted chunks; the chunks of a file meet in one task by their first keys, which merges them by a
heap as they come, so it holds as many rows as chunks overlap.  Every key is unique, because a row's
number in its run is part of it: equal rows, however many, are dealt out like others.

`drift` writes these files in an older schema each (names, order, missing columns, narrower types),
all with the Parquet field ids of the evolved schema, and a manifest of them.  `rewrite` follows the
manifest: files of an older version are read by field id, columns that they lack get defaults, and
each becomes one file of the evolved schema with its rows in the same order.  Files that are up to
date are not touched.

What the driver holds is bounded by the number of files and of digits, whatever the input.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .cluster import checkpoint_dir

#: Key columns in the order of sorting: of the sort key, of the row's content, of the row's place.
KEY = ["__crc", "__id", "__tie", "__row"]
#: Bits of each key column (a null key has -1 as its sum), and of a digit: the first digit, and the later ones.
BITS = {"__crc": 33, "__id": 64, "__tie": 64, "__row": 64}
FIRST_DIGIT, DIGIT = 12, 8
#: Rows among which a cut is ranked: this share of all, or so many.
RANKED_SHARE, RANKED_ROWS = 1000, 10_000
#: Rows of a chunk that goes to a file's task.
CHUNK = 1024
#: Rows that a task hands on at once.
BATCH = 8192

RENAMED, REVERSED, MISSING, NARROW = 1, 2, 4, 8


def _shifts() -> list[tuple[str, int, int]]:
    """Column, shift and mask of each digit of the key."""
    out = []
    for name, bits in BITS.items():
        while bits:
            width = min(bits, DIGIT if out else FIRST_DIGIT)
            bits -= width
            out.append((name, bits, (1 << width) - 1))
    return out


def _digit(name: str, shift: int, mask: int) -> Column:
    """Digits of signed columns are ordered like the numbers: the sign bit is turned."""
    value = F.col(name) + 1 if name == "__crc" else F.col(name).bitwiseXOR(F.lit(-(2**63)))
    return F.shiftrightunsigned(value, shift).bitwiseAND(F.lit(mask))


def cut_keys(runs: DataFrame, ranks: list[int], total: int, ranked: int | None = None) -> list[tuple]:
    """The keys at these ranks (from 0, ascending) of all rows of runs.

    ranked: rows of one digit prefix that may be ranked in one task; prefixes with more are split
    by their next digit.
    """
    ranked = ranked or max(RANKED_ROWS, total // RANKED_SHARE)
    shifts = _shifts()
    #: prefix -> [(cut, rank within the prefix)]
    open_: dict[tuple, list[tuple[int, int]]] = {(): list(enumerate(ranks))}
    settled: dict[tuple, list[tuple[int, int]]] = {}
    for depth in range(len(shifts)):
        if not open_:
            break
        digits = [_digit(*s).cast("int").alias(f"d{i}") for i, s in enumerate(shifts[: depth + 1])]
        rows = runs.select(*digits)
        names = [f"d{i}" for i in range(depth + 1)]
        if depth:
            wanted = runs.sparkSession.createDataFrame([tuple(p) for p in open_], ", ".join(f"d{i} int" for i in range(depth)))
            rows = rows.join(F.broadcast(wanted), names[:-1])
        counts: dict[tuple, list[tuple[int, int]]] = {}
        for r in rows.groupBy(*names).count().collect():
            counts.setdefault(tuple(r[:depth]), []).append((r[depth], r["count"]))
        below: dict[tuple, list[tuple[int, int]]] = {}
        for prefix, cuts in open_.items():
            at, spans = 0, []
            for digit, n in sorted(counts.get(prefix, [])):
                spans.append((at, at + n, digit))
                at += n
            for cut, rank in cuts:
                low, high, digit = next(s for s in spans if s[0] <= rank < s[1])
                into = below if high - low > ranked and depth + 1 < len(shifts) else settled
                into.setdefault((*prefix, digit), []).append((cut, rank - low))
        open_ = below
    found: dict[int, tuple] = {}
    for depth in sorted({len(p) for p in settled}):
        some = {p: c for p, c in settled.items() if len(p) == depth}
        names = [f"d{i}" for i in range(depth)]
        wanted = runs.sparkSession.createDataFrame([(*p, cut, rank) for p, cuts in some.items() for cut, rank in cuts], ", ".join(f"{n} int" for n in names) + ", cut int, rank long")
        rows = runs.select(*KEY, *(_digit(*s).cast("int").alias(f"d{i}") for i, s in enumerate(shifts[:depth])))
        near = rows.join(F.broadcast(wanted.select(*names).distinct()), names, "left_semi")
        place = near.withColumn("rank", F.row_number().over(Window.partitionBy(*names).orderBy(*KEY)).cast("long") - 1)
        for r in place.join(F.broadcast(wanted), [*names, "rank"]).select("cut", *KEY).collect():
            found[r["cut"]] = tuple(r[1:])
    return [found[i] for i in range(len(ranks))]


def _packed(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _order(keys: list[np.ndarray]) -> np.ndarray:
    """Which rows are smaller than the row before them."""
    less, same = np.zeros(len(keys[0]), dtype=bool), np.ones(len(keys[0]), dtype=bool)
    for k in keys:
        less[1:] |= same[1:] & (k[1:] < k[:-1])
        same[1:] &= k[1:] == k[:-1]
    return less


def _slices(runs: DataFrame, cuts: list[tuple], columns: list[str]) -> DataFrame:
    """file_no, the key of the first row, and packed rows: sorted chunks, none across a cut or a run."""
    schema = T.StructType([T.StructField("file_no", T.IntegerType()), *(T.StructField(c, T.LongType()) for c in KEY), T.StructField("rows", T.BinaryType())])
    source, sums = runs.select(*KEY, *columns), np.array([c[0] for c in cuts], dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        held_rows, file_no, last = 0, -1, None

        def chunk() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            first = [rows.column(i)[0].as_py() for i in range(len(KEY))]
            out = [pa.array([file_no], pa.int32()), *(pa.array([x], pa.int64()) for x in first), pa.array([_packed(rows)], pa.binary())]
            return pa.RecordBatch.from_arrays(out, names=schema.names)

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [np.asarray(batch.column(i), dtype=np.int64) for i in range(len(KEY))]
            # a row's file is the number of cuts that are not above it
            of, high = np.searchsorted(sums, keys[0], side="left"), np.searchsorted(sums, keys[0], side="right")
            for i in np.flatnonzero(of < high).tolist():
                of[i] = bisect_right(cuts, tuple(int(k[i]) for k in keys), of[i], high[i])
            edge = _order(keys)
            edge[1:] |= of[1:] != of[:-1]
            starts = np.append(np.flatnonzero(edge), batch.num_rows).tolist()
            at = 0
            for stop in starts:
                while at < stop:
                    if held and (of[at] != file_no or held_rows >= CHUNK or last > tuple(int(k[at]) for k in keys)):
                        yield chunk()
                        held, held_rows = [], 0
                    n = min(stop - at, CHUNK - held_rows)
                    held.append(batch.slice(at, n))
                    held_rows, file_no, at = held_rows + n, int(of[at]), at + n
                    last = tuple(int(k[at - 1]) for k in keys)
        if held:
            yield chunk()

    return source.mapInArrow(run, schema)


def _merged(slices: DataFrame, files: dict[int, int], kind: T.StructType) -> DataFrame:
    """The rows of these files (file_no -> partition), each in one task, merged by a heap."""
    first = min(files.values(), default=0)
    number = F.create_map(*(F.lit(x) for pair in sorted(files.items()) for x in pair)) if files else F.lit(None)
    mine = slices.where(F.col("file_no").isin(*files)).withColumn("__part", number[F.col("file_no")] - first)
    dealt = mine.repartitionById(len(files), F.col("__part")).sortWithinPartitions(*KEY)
    width = len(KEY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heap: list[tuple] = []
        chunks: dict[int, pa.RecordBatch] = {}
        keys: dict[int, list[tuple]] = {}
        out: list[tuple[int, int]] = []

        def gathered() -> pa.RecordBatch:
            used = list(dict.fromkeys(c for c, _ in out))
            base, at = {}, 0
            for c in used:
                base[c], at = at, at + chunks[c].num_rows
            table = pa.Table.from_batches([chunks[c] for c in used])
            rows = table.take(pa.array([base[c] + i for c, i in out])).combine_chunks().to_batches()[0]
            for c in used:
                if c not in keys:
                    del chunks[c]
            out.clear()
            return pa.RecordBatch.from_arrays(rows.columns[width:], names=rows.schema.names[width:])

        def below(limit: tuple | None) -> Iterator[pa.RecordBatch]:
            """Rows whose keys are below the first of the chunks to come."""
            while heap and (limit is None or heap[0][0] < limit):
                key, c, i = heap[0]
                out.append((c, i))
                if i + 1 < len(keys[c]):
                    heapq.heapreplace(heap, (keys[c][i + 1], c, i + 1))
                else:
                    heapq.heappop(heap)
                    del keys[c]
                if len(out) >= BATCH:
                    yield gathered()

        n = 0
        for batch in batches:
            for r in range(batch.num_rows):
                first_key = tuple(batch.column(1 + i)[r].as_py() for i in range(width))
                yield from below(first_key)
                rows = pa.ipc.open_stream(batch.column(1 + width)[r].as_buffer()).read_next_batch()
                chunks[n] = rows
                keys[n] = list(zip(*(rows.column(i).to_pylist() for i in range(width)), strict=True))
                heapq.heappush(heap, (keys[n][0], n, 0))
                n += 1
        yield from below(None)
        if out:
            yield gathered()

    return dealt.select("file_no", *KEY, "rows").mapInArrow(run, kind)


class Sorted:
    """A table sorted into files: slices of sorted runs, and how the files are cut."""

    def __init__(self, slices: DataFrame, files: int, kind: T.StructType) -> None:
        self.slices, self.files, self.kind = slices, files, kind


def merge_sort(rows: DataFrame, key: str, files: int, folder: str) -> Sorted:
    """Sorts rows by unsigned crc32 of the key's decimal and by the key, for files of 1 + rows // files each.

    Null keys come first; rows with one key go by a hash of their content, equal rows stand in any
    order.  The key must be a whole number.  An empty table has no files.  Runs and slices are
    written below the folder.
    """
    spark, columns = rows.sparkSession, rows.columns
    if clash := set(columns) & {*KEY, "file_no", "rows"}:
        # inner names give way to those of the table
        inner = {c: f"c{i}__{uuid.uuid4().hex[:6]}" for i, c in enumerate(columns) if c in clash}
        rows = rows.withColumnsRenamed(inner)
        key = inner.get(key, key)
    content = F.xxhash64(*rows.columns)
    runs = rows.select(
        F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(-1)).alias("__crc"),
        F.coalesce(F.col(key).cast("long"), F.lit(0)).alias("__id"),
        content.alias("__tie"),
        F.monotonically_increasing_id().alias("__row"),
        *rows.columns,
    )
    runs.sortWithinPartitions(*KEY).write.parquet(f"{folder}/runs")
    runs = spark.read.schema(runs.schema).parquet(f"{folder}/runs")
    total = runs.count()
    size = 1 + total // files
    ranks = list(range(size, total, size))
    cuts = cut_keys(runs, ranks, total) if ranks else []
    _slices(runs, cuts, rows.columns).write.parquet(f"{folder}/slices")
    stored = spark.read.parquet(f"{folder}/slices")
    kind = T.StructType([T.StructField(c, f.dataType) for c, f in zip(columns, rows.schema, strict=True)])
    return Sorted(stored, -(-total // size), kind)


def evolved(kind: T.StructType, wide: dict[str, T.DataType]) -> T.StructType:
    """The schema with nullable columns, field ids from 1 on, and these types widened."""
    return T.StructType([T.StructField(f.name, wide.get(f.name, f.dataType), True, {"parquet.field.id": i}) for i, f in enumerate(kind, 1)])


class Drift:
    """How the versions of a schema differ from the evolved one, by the bits of the version."""

    def __init__(self, schema: T.StructType, swapped: tuple[str, str], missing: dict[str, object], narrow: dict[str, T.DataType]) -> None:
        """swapped: two columns whose names are exchanged; missing: columns that are absent, and what stands for them."""
        self.schema, self.swapped, self.missing, self.narrow = schema, swapped, missing, narrow

    def fields(self, version: int) -> list[tuple[T.StructField, str]]:
        """The fields of a version in order, and the evolved name of each."""
        a, b = self.swapped
        fields = [f for f in self.schema if not (version & MISSING and f.name in self.missing)]
        if version & REVERSED:
            fields = [fields[0], *fields[:0:-1]]
        names = {a: b, b: a} if version & RENAMED else {}
        narrow = self.narrow if version & NARROW else {}
        return [(T.StructField(names.get(f.name, f.name), narrow.get(f.name, f.dataType), True, f.metadata), f.name) for f in fields]

    def written(self, rows: DataFrame, version: int) -> DataFrame:
        """Evolved rows as this version has them."""
        return rows.select(*(F.col(own).cast(f.dataType).alias(f.name, metadata=f.metadata) for f, own in self.fields(version)))

    def read(self, spark: SparkSession, paths: list[str], version: int) -> DataFrame:
        """Files of a version as evolved rows, matched by field id, with their path and place in it."""
        of = {f.metadata["parquet.field.id"]: f for f, _ in self.fields(version)}
        asked = T.StructType([T.StructField(f.name, of[i].dataType if (i := f.metadata["parquet.field.id"]) in of else f.dataType, True, f.metadata) for f in self.schema])
        files = spark.read.schema(asked).parquet(*paths)
        value = {f.name: F.col(f.name).cast(f.dataType) if f.metadata["parquet.field.id"] in of else F.lit(self.missing[f.name]).cast(f.dataType) for f in self.schema}
        return files.select(*(value[f.name].alias(f.name, metadata=f.metadata) for f in self.schema), F.col("_metadata.file_path").alias("__path"), F.col("_metadata.row_index").alias("__at"))


@contextmanager
def _by_field_id(spark: SparkSession) -> Iterator[None]:
    """Parquet columns are written with their field ids and matched by them."""
    names = ["spark.sql.parquet.fieldId.read.enabled", "spark.sql.parquet.fieldId.write.enabled"]
    before = {n: spark.conf.get(n, None) for n in names}
    try:
        for n in names:
            spark.conf.set(n, "true")
        yield
    finally:
        for n, v in before.items():
            spark.conf.unset(n) if v is None else spark.conf.set(n, v)


def _listed(spark: SparkSession, folder: str) -> set[str]:
    """Paths of the data files of a folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    plain = lambda p: re.sub("^file:/+", "file:///", p)
    return {plain(s.getPath().toString()) for s in fs.listStatus(path) if s.getPath().getName().endswith(".parquet")} if fs.exists(path) else set()


def _append(rows: DataFrame, folder: str, files: list[int]) -> dict[int, str]:
    """Writes the partitions of rows as files in this folder; the path of each of the given numbers."""
    before = _listed(rows.sparkSession, folder)
    rows.write.mode("append").option("maxRecordsPerFile", 0).parquet(folder)
    new = _listed(rows.sparkSession, folder) - before
    parts = {int(re.search(r"part-(\d+)-", p)[1]): p for p in new}
    if len(parts) != len(new) or sorted(parts) != list(range(len(files))):
        raise RuntimeError(f"{folder}: {len(new)} files were written for {len(files)}")
    return {n: parts[i] for i, n in enumerate(files)}


def version_of(file_no: int) -> int:
    v = zlib.crc32(f"19:{file_no}".encode()) % 24
    return v if v < 16 else 0


def drift(table: Sorted, drifts: Drift, folder: str) -> list[Row]:
    """Writes each file of a sorted table in its version's schema; the manifest: file_no, version, path."""
    spark, paths = table.slices.sparkSession, {}
    by_version: dict[int, list[int]] = {}
    for n in range(table.files):
        by_version.setdefault(version_of(n), []).append(n)
    with _by_field_id(spark):
        for version, files in sorted(by_version.items()):
            rows = _merged(table.slices, {n: i for i, n in enumerate(files)}, table.kind)
            rows = rows.select(*(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name, metadata=f.metadata) for f in drifts.schema))
            paths |= _append(drifts.written(rows, version), f"{folder}/table", files)
    return [Row(file_no=n, version=version_of(n), path=paths[n]) for n in range(table.files)]


def rewrite(spark: SparkSession, manifest: DataFrame, drifts: Drift, folder: str) -> DataFrame:
    """Turns the files of a manifest that are not of version 0 into files of the evolved schema.

    Each becomes one file in the same folder with the same rows in the same order; then the old
    one goes.  The manifest of what is there now: file_no, version, path, rewritten.
    """
    entries = manifest.orderBy("file_no").collect()  # one row for each file
    old = [r for r in entries if r.version]
    paths = {r.file_no: r.path for r in entries}
    if old:
        number = {r.path: i for i, r in enumerate(old)}
        places = spark.createDataFrame([(p, i) for p, i in number.items()], "__path string, __part int")
        with _by_field_id(spark):
            parts = [drifts.read(spark, [r.path for r in old if r.version == v], v) for v in sorted({r.version for r in old})]
            rows = parts[0]
            for p in parts[1:]:
                rows = rows.unionByName(p)
            rows = rows.withColumn("__path", _plain(F.col("__path"))).join(F.broadcast(places.withColumn("__path", _plain(F.col("__path")))), "__path")
            dealt = rows.repartitionById(len(old), F.col("__part")).sortWithinPartitions("__part", "__at")
            new = _append(dealt.select(*(F.col(f.name).alias(f.name, metadata=f.metadata) for f in drifts.schema)), folder, [r.file_no for r in old])
        for r in old:
            path = spark._jvm.org.apache.hadoop.fs.Path(r.path)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, False)
        paths |= new
    return spark.createDataFrame([(r.file_no, r.version, paths[r.file_no], bool(r.version)) for r in entries], "file_no int, version int, path string, rewritten boolean")


def _plain(path: Column) -> Column:
    """A path without the slashes after its scheme, which readers and listings write differently."""
    return F.regexp_replace(path, "^([a-z0-9]+):/+", "$1:/")


def _field(f: T.StructField) -> Column:
    c = F.col(f"`{f.name}`")
    if isinstance(f.dataType, T.TimestampNTZType):
        c = F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{f.name}`)")
    elif isinstance(f.dataType, T.TimestampType):
        c = F.unix_micros(c)
    elif isinstance(f.dataType, T.DoubleType):
        scaled = F.lit(1048576.0) * c
        odd = F.isnan(c) | (F.abs(scaled) >= 9e18)
        c = F.when(odd, scaled.cast("string")).otherwise(F.floor(F.when(~odd, scaled)).cast("string"))
    return F.coalesce(c.cast("string"), F.lit("?"))


def digests(spark: SparkSession, manifest: DataFrame, schema: T.StructType, key: str) -> DataFrame:
    """file_no, n_rows, n_nulls, ids_sha256 and rows_sha256 of each file, streamed in its order."""
    entries = manifest.collect()
    places = spark.createDataFrame([(r.path, i) for i, r in enumerate(entries)], "__path string, __part int")
    files = spark.read.schema(schema).parquet(*(r.path for r in entries))
    nulls = sum((F.col(f"`{f.name}`").isNull().cast("int") for f in schema[1:]), F.col(f"`{schema[0].name}`").isNull().cast("int"))
    rows = files.select(
        _plain(F.col("_metadata.file_path")).alias("__path"),
        F.col("_metadata.row_index").alias("__at"),
        F.coalesce(F.col(key).cast("string"), F.lit("?")).alias("__key"),
        F.concat_ws("|", *(_field(f) for f in schema)).alias("__line"),
        nulls.alias("__nulls"),
    ).join(F.broadcast(places.withColumn("__path", _plain(F.col("__path")))), "__path")
    dealt = rows.repartitionById(len(entries), F.col("__part")).sortWithinPartitions("__part", "__at")
    kind = pa.schema([("file_no", pa.int32()), ("n_rows", pa.int64()), ("n_nulls", pa.int64()), ("ids_sha256", pa.string()), ("rows_sha256", pa.string())])
    file_no = [r.file_no for r in entries]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, lines, n, none, part = hashlib.sha256(), hashlib.sha256(), 0, 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column(0)[0].as_py()
            if n:
                ids.update(b",")
                lines.update(b"\n")
            ids.update(",".join(batch.column(1).to_pylist()).encode())
            lines.update("\n".join(batch.column(2).to_pylist()).encode())
            n, none = n + batch.num_rows, none + pa.compute.sum(batch.column(3)).as_py()
        if part is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (file_no[part], n, none, ids.hexdigest(), lines.hexdigest())], names=kind.names).cast(kind)

    return dealt.select("__part", "__key", "__line", "__nulls").mapInArrow(run, "file_no int, n_rows long, n_nulls long, ids_sha256 string, rows_sha256 string")


def sort_and_rewrite(rows: DataFrame, key: str, drifts: Drift, files: int = 250) -> DataFrame:
    """Sorts a table into drifted files, rewrites these, and tells of each final file what it holds.

    file_no, version, n_rows, n_nulls, ids_sha256, rows_sha256, start_columns, columns, path, rewritten.
    Nulls stay nulls; repeated rows are all kept; columns that the evolved schema doesn't have are left
    out, whatever their names.  An empty table gives no file and no row.  Each call has its own folder
    below the shared one: its `table` holds the final files and nothing else.
    """
    spark = rows.sparkSession
    folder = f"{checkpoint_dir(spark)}/rewrite-{uuid.uuid4()}"
    table = merge_sort(rows.select(*(F.col(f"`{f.name}`") for f in drifts.schema)), key, files, folder)
    out = "file_no int, version int, n_rows long, n_nulls long, ids_sha256 string, rows_sha256 string, start_columns string, columns string, path string, rewritten boolean"
    if not table.files:
        return spark.createDataFrame([], out)
    start = spark.createDataFrame(drift(table, drifts, folder), "file_no int, version int, path string")
    start.coalesce(1).write.parquet(f"{folder}/manifest")
    start = spark.read.schema(start.schema).parquet(f"{folder}/manifest")
    named = names_of(spark, start)
    final = rewrite(spark, start, drifts, f"{folder}/table")
    told = digests(spark, final, drifts.schema, key)
    return (
        told.join(F.broadcast(final), "file_no")
        .join(F.broadcast(named.withColumnRenamed("columns", "start_columns")), "file_no")
        .join(F.broadcast(names_of(spark, final)), "file_no")
        .select("file_no", "version", "n_rows", "n_nulls", "ids_sha256", "rows_sha256", "start_columns", "columns", "path", "rewritten")
    )


def names_of(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """file_no, columns: the ordered names in each file's own schema.

    Files of a version that are there for the same reason have one schema, which the first tells.
    """
    entries = manifest.collect()
    kind = lambda r: (r.version, r.rewritten if "rewritten" in r else False)
    first = {kind(r): r.path for r in reversed(entries)}
    names = {k: ",".join(spark.read.parquet(p).columns) for k, p in first.items()}
    return spark.createDataFrame([(r.file_no, names[kind(r)]) for r in entries], "file_no int, columns string")


def clients_drift(clients: DataFrame) -> Drift:
    schema = evolved(clients.select("client_id", "master_id", "source", "updated_at", "name", "email", "city", "nation_id", "segment", "balance").schema, {"nation_id": T.LongType()})
    return Drift(schema, ("name", "email"), {"nation_id": -1, "segment": "none"}, {"balance": T.FloatType(), "nation_id": T.IntegerType()})


def op12_schema_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    clients = spark.read.parquet(f"{sf_dir}/clients.parquet")
    return sort_and_rewrite(clients, "client_id", clients_drift(clients))


QUERIES = {"op12_schema_rewrite": op12_schema_rewrite}
