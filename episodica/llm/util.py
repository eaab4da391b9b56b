"""What several operators of this subpackage share: word splitting, hashing, shared-folder tables."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but the six ASCII white-space characters; bytes.split() cuts at just these.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"

_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_U = np.uint64


def fold_ascii(raw: bytes) -> bytes:
    """Lower-cases A-Z and leaves every other byte alone."""
    return raw.translate(_FOLD)


class WordHashes(dict):
    """64-bit word hashes, remembered for up to `most` words."""

    def __init__(self, most: int = 400_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > self.most:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), dtype=_U, count=len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the splitmix64 finaliser)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of k words."""
    n = len(words) - k + 1
    h = np.zeros(max(n, 0), dtype=_U)
    for i in range(k):
        h = h * _U(0x9E3779B97F4A7C15) + words[i : i + len(h)]
        h ^= h >> _U(29)
    return mix(h)


def held_out(doc_id: str = "doc_id") -> Column:
    """True where crc32 of the id as text leaves no remainder by 5; a null id is never learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Only a local session may do without it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = tempfile.mkdtemp(prefix="episodica-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def shared_table(df: DataFrame, name: str, by: list[str] | None = None) -> DataFrame:
    """Writes df to the shared folder and reads it back: later plans start from the files."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._shared_path = path
    return out


def drop_shared(df: DataFrame) -> None:
    """Deletes a table of shared_table() that nothing reads any more."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._shared_path)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
