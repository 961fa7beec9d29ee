"""What several corpus operators need: session settings, shared storage, exact prefix ranks, word hashing."""

from __future__ import annotations

import atexit
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A word, as the contracts define it; space, tab, line feed, vertical tab, form feed and return separate words.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of text given to a Python worker at once; documents can be long.
ARROW_ROWS, ARROW_BYTES = 512, 16 << 20


def prepare(spark: SparkSession) -> None:
    """Small Arrow batches, in rows and bytes, because one row can hold a very long text."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one where that is unset and the session is one process (tests)."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="pagemill-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends there, and a lost executor costs nothing.

    The files go with forget(), or when the driver's process ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/pagemill-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[id(out)] = out, path
    return out


#: What cut() gave and forget() has not yet removed, by identity.
_paths: dict[int, tuple[DataFrame, str]] = {}


def forget(*dfs: DataFrame) -> None:
    """Removes the files of what cut() gave; nothing that is still to be worked out may read them."""
    for df in dfs:
        if id(df) in _paths:
            _, path = _paths.pop(id(df))
            _remove(df.sparkSession, path)


def _remove(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    if sc._jsc is None or sc._jsc.sc().isStopped():
        return
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def words_of(text: Column) -> Column:
    """Number of words; 0 for null and empty texts."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def seeded_key(seed: str, *cols: Column) -> Column:
    """A hexadecimal shuffle key, the same in every engine that has MD5."""
    return F.md5(F.concat_ws(":", F.lit(seed), *[F.coalesce(c.cast("string"), F.lit("null")) for c in cols]))


def key_bucket(key: Column, buckets: int) -> Column:
    """Bucket of a hexadecimal key, rising with the key's order."""
    head = F.conv(F.substring(key, 1, 8), 16, 10).cast("long")
    return F.floor(head * buckets / F.lit(2**32)).cast("int")


#: A key is frequent with more rows than one in so many (there are no more than so many such keys), and at least so many.
FREQUENT, LEAST_FREQUENT = 10_000, 64


def frequent(rows: int) -> int:
    """Rows beyond which a key is frequent, in a table of so many rows."""
    return max(LEAST_FREQUENT, rows // FREQUENT)


def look_up(rows: DataFrame, table: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """rows (total of them) joined with table, which has one row for each key and, in count, how many rows have it.

    Frequent keys, whose number FREQUENT bounds, are sent to all tasks; so no key's rows are gathered.
    """
    hot = table.where(F.col(count) > frequent(total))
    spread = rows.join(F.broadcast(hot), key)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(table.where(F.col(count) <= frequent(total)), key)
    return spread.unionByName(rest).drop(count)


#: Bits of a filter of hashes: at least, at most (32 MB), and for each hash.
LEAST_BITS, MOST_BITS, BITS_EACH = 16, 28, 16


def filtered(rows: DataFrame, column: str, hashes: DataFrame, n: int) -> tuple[DataFrame, Column]:
    """(rows with helper columns, whether a row's hash in column may be one of the n 64-bit hashes h).

    The filter is sent to all tasks: at most 2 ** (MOST_BITS - 10) rows of 16 words, so its size does not follow the
    input. A few rows pass that should not, more where n nears 2 ** MOST_BITS; every row that should does.
    """
    bits = min(MOST_BITS, max(LEAST_BITS, (n * BITS_EACH).bit_length()))
    slot = lambda h: F.shiftrightunsigned(h, 64 - bits)
    at = lambda h: F.shiftright(slot(h), 10).cast("int")
    word = lambda h: F.shiftright(slot(h), 6).bitwiseAND(15).cast("int")
    bit = lambda h: F.expr(f"shiftleft(1L, CAST(shiftrightunsigned({h}, {64 - bits}) & 63 AS INT))")
    slice_, words_ = f"{column}_slice", f"{column}_words"
    words = hashes.groupBy(at(F.col("h")).alias(slice_), word(F.col("h")).alias("word")).agg(F.bit_or(bit("h")).alias("bits"))
    table = cut(words.groupBy(slice_).agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias(words_)), "filter")
    out = rows.withColumn(slice_, at(F.col(column))).join(F.broadcast(table), slice_, "left")
    return out, F.coalesce(F.element_at(words_, word(F.col(column))).bitwiseAND(bit(column)) != 0, F.lit(False))


def prefix_within(df: DataFrame, keys: list[str], bucket: str, order: list, weight: str) -> DataFrame:
    """Adds rank (from 1) and before (weight of earlier rows) in each key's order, and the key's key_rows and key_weight.

    A key may hold any share of the rows: they are ranked by (key, bucket) and offset by what the key's
    earlier buckets hold, so no task sees a whole key. bucket has to rise with order.
    """
    cell = [*keys, bucket]
    whole, earlier = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    cells = (
        df.groupBy(*cell)
        .agg(F.count("*").alias("_n"), F.sum(weight).alias("_w"))
        .select(
            *cell,
            F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_n0"),
            F.coalesce(F.sum("_w").over(earlier), F.lit(0)).alias("_w0"),
            F.sum("_n").over(whole).alias("key_rows"),
            F.sum("_w").over(whole).alias("key_weight"),
        )
    )
    own = Window.partitionBy(*cell).orderBy(*order)
    local = df.withColumn("_r", F.row_number().over(own)).withColumn("_c", F.coalesce(F.sum(weight).over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    joined = local.join(cells, cell)
    return joined.withColumn("rank", F.col("_n0") + F.col("_r")).withColumn("before", F.col("_w0") + F.col("_c")).drop("_r", "_c", "_n0", "_w0")


# ---------------------------------------------------------------- hashing of words in UTF-8 buffers

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_WINDOW = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (SplitMix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True


class _Powers:
    def __init__(self) -> None:
        self.n, self.up, self.down = 0, np.ones(1, np.uint64), np.ones(1, np.uint64)

    def to(self, n: int) -> None:
        if n > self.n:
            inverse = pow(_BASE, -1, 1 << 64)
            for name, base in (("up", _BASE), ("down", inverse)):
                a = np.full(n + 1, base, np.uint64)
                a[0] = 1
                setattr(self, name, np.cumprod(a, dtype=np.uint64))
            self.n = n


_powers = _Powers()


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows) of an Arrow string column; null counts as empty."""
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def word_bounds(raw: np.ndarray, at: np.ndarray, breaks: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray]:
    """Where words begin and end in raw; a word ends with its row too. breaks: which bytes separate words."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    gap = breaks[raw]
    edges = at[(at > 0) & (at < len(raw))]
    begin, over = np.empty(len(raw), bool), np.empty(len(raw), bool)
    begin[0] = over[-1] = True
    begin[1:], over[:-1] = gap[:-1], gap[1:]
    begin[edges] = over[edges - 1] = True
    return np.flatnonzero(begin & ~gap), np.flatnonzero(over & ~gap) + 1


def bound_hashes(raw: np.ndarray, first: np.ndarray, last: np.ndarray, beginnings: list[np.ndarray] | None = None, sizes: tuple[int, ...] = ()) -> np.ndarray:
    """64-bit hashes of the words between these bounds (ASCII letters lower-cased).

    beginnings receives, for each of sizes (bytes), the hashes of the words' first bytes, 0 for words that have no more.
    The buffer is worked through in windows, so memory follows the window and not the longest text.
    """
    hashes, begun, i = [], [[] for _ in sizes], 0
    while i < len(first):
        j = max(i + 1, int(np.searchsorted(last, first[i] + _WINDOW, "right")))
        lo, hi = int(first[i]), int(last[j - 1])
        _powers.to(hi - lo)
        terms = _BYTES[LOWER[raw[lo:hi]]] * _powers.up[: hi - lo]
        total = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(terms, out=total[1:])
        s, e = first[i:j] - lo, last[i:j] - lo
        h = (total[e] - total[s]) * _powers.down[s]
        hashes.append(mix(h + (e - s).astype(np.uint64) * np.uint64(0xA24BAED4963EE407)))
        for own, n in zip(begun, sizes, strict=True):
            longer = e - s > n
            own.append(np.where(longer, mix((total[np.minimum(s + n, e)] - total[s]) * _powers.down[s] + np.uint64(2 * n + 1)), np.uint64(0)))
        i = j
    if beginnings is not None:
        beginnings += [np.concatenate(own) if own else np.zeros(0, np.uint64) for own in begun]
    return np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)


def word_hashes(raw: np.ndarray, at: np.ndarray, breaks: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words and, for each row, where its words begin."""
    first, last = word_bounds(raw, at, breaks)
    return bound_hashes(raw, first, last), np.searchsorted(first, at)
