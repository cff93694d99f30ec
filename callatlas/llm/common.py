"""What several operators share: tables, the shared folder, shards of documents."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but these six ASCII characters; bytes.split() has the same rule.
WORD = r"[^\x20\x09-\x0D]+"
#: Stands for a null doc_id where ids are compared: it sorts after every id.
NO_ID = 2**63 - 1
SHARD_LEAST, SHARD_MOST, SHARDS = 3 << 20, 8 << 20, 65_536


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees. A folder of our own only in local mode, where the session may name none."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="checkpoints-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def shared_path(spark: SparkSession) -> str:
    """A new place in the shared folder, which goes when the session's JVM ends."""
    at = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return at


def keep(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Writes df as a table in the shared folder and reads it again, which cuts the lineage.

    Files survive the loss of executors. They stay until discard() or the end of the session.
    """
    at = shared_path(df.sparkSession)
    df.write.option("compression", codec).parquet(at)
    kept = df.sparkSession.read.schema(df.schema).parquet(at)
    kept.kept_at = at
    return kept


def discard(kept: DataFrame) -> None:
    """Deletes a table of keep() that nothing will read any more."""
    spark = kept.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(kept.kept_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def id_or_last(name: str = "doc_id") -> Column:
    return F.coalesce(F.col(name).cast("long"), F.lit(NO_ID))


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    return docs.agg(F.sum(F.octet_length(column).cast("long"))).first()[0] or 0


def n_shards(n_bytes: int, least: int) -> int:
    """Shards of `least` bytes of text at first, growing to 8 MB, which a worker can hold, once there are very many."""
    size = min(SHARD_MOST, max(least, n_bytes // SHARDS))
    return max(1, -(-n_bytes // size))


def _packed(batches, keep_columns):
    import pyarrow as pa
    import zstandard

    put = zstandard.ZstdCompressor(level=3).compress
    for b in batches:
        z = [None if x is None else put(x) for x in b.column("bytes").to_pylist()]
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep_columns), pa.array(z, pa.binary())], names=[*keep_columns, "z"])


def sharded(docs: DataFrame, carry: tuple[str, ...] = (), size: int | None = None, n_bytes: int | None = None) -> DataFrame:
    """(shard, doc_id, carried columns, z): the whole texts, compressed, dealt by a hash of id and text.

    Plans that read the result several times share one exchange. A shard is what one task
    looks at together, so that what a key has in a shard can be summed up before a shuffle.
    """
    n = n_shards(text_bytes(docs) if n_bytes is None else n_bytes, size or SHARD_LEAST)
    columns = ["shard", "doc_id", *carry]
    raw = docs.select(
        F.pmod(F.xxhash64(F.col("doc_id"), F.col("text")), F.lit(n)).cast("int").alias("shard"),
        id_or_last().alias("doc_id"), *carry, F.col("text").cast("binary").alias("bytes"),
    )
    kept = [f for f in raw.schema.fields if f.name != "bytes"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", z binary"
    parts = max(n, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # with fewer, Spark would deal it again for a cogroup
    return raw.mapInArrow(lambda batches: _packed(batches, columns), schema).repartition(parts, "shard")


def trim() -> None:
    """Gives memory that Python has freed back to the system, where the C library can; workers live on and share a machine."""
    import ctypes
    import ctypes.util

    release = getattr(ctypes.CDLL(ctypes.util.find_library("c")), "malloc_trim", None)
    if release:
        release(0)


def chunks(blobs, size: int = 1 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """Consecutive texts of about `size` bytes, with the row number of the first."""
    first, held, total = 0, [], 0
    for i, t in enumerate(unpacked_each(blobs)):
        held.append(t)
        total += len(t) + 1
        if total >= size:
            yield first, held
            first, held, total = i + 1, [], 0
    if held:
        yield first, held


def unpacked_each(blobs) -> Iterator[bytes]:
    import zstandard

    get = zstandard.ZstdDecompressor().decompress
    for z in blobs:
        yield b"" if z is None else get(z)


def by_run(batches, key: str, names: list[str]) -> Iterator[dict[str, np.ndarray]]:
    """Arrays with whole runs of equal `key`, from Arrow batches that are sorted by it."""
    held = None
    for b in batches:
        now = {c: b.column(c).to_numpy(zero_copy_only=False) for c in names}
        if held is not None:
            now = {c: np.concatenate([held[c], v]) for c, v in now.items()}
        k = now[key]
        if not len(k):
            continue
        other = np.flatnonzero(k != k[-1])
        cut = other[-1] + 1 if len(other) else 0
        if cut:
            yield {c: v[:cut] for c, v in now.items()}
        held = {c: v[cut:] for c, v in now.items()}
    if held is not None and len(held[key]):
        yield held


def run_starts(*keys: np.ndarray) -> np.ndarray:
    """Where a new combination of the sorted keys begins."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def record(schema: list[tuple[str, str]], *arrays):
    """An Arrow batch from arrays; unsigned 64-bit values are stored by their bits."""
    import pyarrow as pa

    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary(), "string": pa.string(), "double": pa.float64()}
    made = [pa.array(a.view(np.int64) if isinstance(a, np.ndarray) and a.dtype == np.uint64 else a, kinds[k]) for (_, k), a in zip(schema, arrays, strict=True)]
    return pa.RecordBatch.from_arrays(made, names=[n for n, _ in schema])


def ddl(schema: list[tuple[str, str]]) -> str:
    return ", ".join(f"{n} {k}" for n, k in schema)
