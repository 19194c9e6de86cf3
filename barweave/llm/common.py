"""What several operators share: shared-folder tables and byte-level word arithmetic on Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text handled at once inside a task; bounds every temporary array.
CHUNK_BYTES = 1 << 19

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(col):
    """Lower-case A-Z only; null counts as the empty text."""
    return F.translate(F.coalesce(col, F.lit("")), UPPER, UPPER.lower())


#: Stands for a missing id inside the operators, after all others.
MISSING = (1 << 63) - 1


def key_of(id_col: str):
    """The id as a long; rows without one share an id after all others."""
    return F.coalesce(F.col(id_col).cast("long"), F.lit(MISSING))


def id_of(key: str = "id"):
    """The id that ``key_of`` was made of."""
    return F.nullif(F.col(key), F.lit(MISSING))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a local session may fall back to a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", base)
    return base


#: With this setting Spark deletes the shuffle files of a query as soon as it has been written.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame, label: str, *folders: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, survives lost executors, and leaves no shuffle files.
    There is a folder for each value of the columns ``folders``."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").partitionBy(*folders).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame, part: str = "") -> None:
    """Delete tables of ``materialise``, or one folder of each, that nothing reads any more."""
    for df in tables:
        jvm = df.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{df.stored_at}/{part}" if part else df.stored_at)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def numbered(df: DataFrame, label: str, *order, name: str = "number") -> tuple[DataFrame, int]:
    """``df`` as a stored table with the numbers 0, 1, 2 ... in ``name``, in the order of the given columns (any order if there are
    none), and its number of rows. Rows are sorted by ranges; the driver sees one count a partition, never a row."""
    if order:
        df = df.repartitionByRange(*order).sortWithinPartitions(*order)
    stored = materialise(df.withColumn(name, F.monotonically_increasing_id()), label)
    part, place = F.shiftrightunsigned(name, 33).cast("int"), F.col(name).bitwiseAND((1 << 33) - 1)
    sizes = {r.part: r.n for r in stored.groupBy(part.alias("part")).agg((F.max(place) + 1).alias("n")).collect()}
    before, starts = 0, []
    for p in range(max(sizes, default=-1) + 1):
        starts.append(before)
        before += sizes.get(p, 0)
    if not before:
        return stored, 0
    out = stored.withColumn(name, F.element_at(F.lit(starts).cast("array<long>"), part + 1) + place)
    out.stored_at = stored.stored_at
    return out, before


def map_batches(df: DataFrame, run, schema) -> DataFrame:
    """``df.mapInArrow(run, schema)`` for rows with long texts: batches of 8 MB at most, which each task holds several times over,
    unless the session sets another size than Spark's."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(key) == "67108864b":
        conf.set(key, "8388608b")
    return df.mapInArrow(run, schema)


# ---------------------------------------------------------------- byte chunks


def text_chunks(batches: Iterator[pa.RecordBatch], limit: int = CHUNK_BYTES):
    """(ids, bytes, starts): runs of whole texts of about ``limit`` bytes. Text i is bytes[starts[i]:starts[i + 1]]. The first
    column is the id, the second the text; null texts are empty."""
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        text = batch.column(1)
        if pa.types.is_string(text.type):
            text = text.cast(pa.large_string())
        if text.null_count:
            text = text.fill_null("")
        n = len(text)
        if not n:
            continue
        offsets = np.frombuffer(text.buffers()[1], dtype=np.int64)[text.offset : text.offset + n + 1]
        data = text.buffers()[2]
        raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
        i = 0
        while i < n:
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
            j = min(j, n)
            yield ids[i:j], raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            i = j


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of a word for two word definitions. All bytes of a non-ASCII character are 0x80 or more.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
NON_SPACE = np.ones(256, bool)
NON_SPACE[[0x20, *range(0x09, 0x0E)]] = False


def word_spans(low: np.ndarray, starts: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of word bytes; a run ends where its text ends."""
    flag = np.zeros(len(low) + 2, np.int8)
    flag[1:-1] = is_word[low]
    change = np.diff(flag)
    begin, end = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
    cut = starts[1:-1]
    cut = np.unique(cut[(cut > 0) & (cut < len(low))])
    if len(cut):
        cut = cut[(flag[cut] == 1) & (flag[cut + 1] == 1)]  # a text ends inside a run
        if len(cut):
            begin, end = np.sort(np.append(begin, cut)), np.sort(np.append(end, cut))
    return begin, end


U = np.uint64
#: Span hashes are polynomials over a prime field at two fixed points drawn at random, so two different spans of n bytes collide with a
#: chance of (n / PRIME)**2, however they are made.
PRIME = (1 << 31) - 1
POINTS = (1_184_303_569, 700_982_227)
_POWERS: dict[int, np.ndarray] = {}


def _near(x: np.ndarray) -> np.ndarray:
    """x modulo PRIME or a little more (under 2**31 + 3), for x below 2**63."""
    x = (x & U(PRIME)) + (x >> U(31))
    return (x & U(PRIME)) + (x >> U(31))


def _reduce(x: np.ndarray) -> np.ndarray:
    """x modulo PRIME, for x below 2**63."""
    x = _near(x)
    return np.where(x >= U(PRIME), x - U(PRIME), x)


def _powers(base: int, n: int) -> np.ndarray:
    known = _POWERS.get(base)
    if known is None or len(known) < n:
        known = np.ones(1, np.uint64)
        while len(known) < max(n, CHUNK_BYTES + 1):
            known = np.concatenate([known, _reduce(known * U(pow(base, len(known), PRIME)))])
        _POWERS[base] = known
    return known[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: spreads 64-bit values."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x = x * U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def prefix_sums(low: np.ndarray) -> list[np.ndarray]:
    """For each point: S[i] = sum of (byte + 1) * point**k over k < i, the powers modulo PRIME."""
    value = low.astype(np.uint64)
    value += U(1)
    sums = []
    for point in POINTS:
        s = np.zeros(len(low) + 1, np.uint64)
        term = value * _powers(point, len(low))
        np.cumsum(term if len(low) < 1 << 23 else _near(term), out=s[1:])  # terms are below 2**40
        sums.append(s)
    return sums


def span_hashes(sums: list[np.ndarray], begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, the same for equal bytes at any place."""
    parts = [_reduce(_near(s[end] - s[begin]) * _powers(pow(point, -1, PRIME), len(s))[begin]) for s, point in zip(sums, POINTS, strict=True)]
    return mix((parts[0] << U(32)) + parts[1] + (end - begin).astype(np.uint64) * U(0xD6E8FEB86659FD93))


def all_span_hashes(sums: list[np.ndarray], size: int) -> np.ndarray:
    """``span_hashes`` of the spans of ``size`` bytes from every place on."""
    parts = [_reduce(_near(s[size:] - s[: len(s) - size]) * _powers(pow(point, -1, PRIME), len(s))[: len(s) - size]) for s, point in zip(sums, POINTS, strict=True)]
    return mix((parts[0] << U(32)) + parts[1] + U(size * 0xD6E8FEB86659FD93 % 2**64))


def sequence_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of every run of ``n`` consecutive word hashes."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(hashes) - n + 1, np.uint64)
    for k in range(n):
        out = out * U(0xC2B2AE3D27D4EB4F) + hashes[k : len(hashes) - n + 1 + k]
    return mix(out + U(n))
