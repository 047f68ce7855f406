"""Helpers shared by the training-data operators: tables in the shared folder, row keys, size checks."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only if it was measured to be no larger than this.
BROADCAST_BYTES = 48 << 20

#: White space that separates words in the contracts: blank, tab, line feed, VT, FF, CR.
SPACE = r"[\x20\x09-\x0D]+"
NOT_SPACE = r"[^\x20\x09-\x0D]+"
#: Separators of lower-cased alphanumeric words; every code point from 0x80 up belongs to words.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a new one where that is unset and Spark runs in one process."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="mercadia-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Writes df as a Parquet table in the shared folder and reads it back.

    This cuts the lineage, and what was written outlives any executor.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Tables stored inside this context pass at most `rows` rows at a time to Python: for rows that are long."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def plainly(docs: DataFrame, own: tuple[str, ...], work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """work(docs), which keeps the columns of docs, with every column but `own` under a name that nothing else has.

    Other columns may have any name: one that work uses inside, one with dots or backticks, or one that differs from
    another in case only.
    """
    named: list[str] = []
    for i, c in enumerate(docs.columns):
        named.append(c if c in own and c not in named else f"__c{i}")
    return work(docs.toDF(*named)).toDF(*docs.columns)


def row_key(doc_id: Column | str, text: Column | str) -> Column:
    """One key for equal (id, text) pairs; a null id or text has a key too."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    text = F.col(text) if isinstance(text, str) else text
    return F.md5(F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("null")), F.coalesce(F.md5(text), F.lit("null"))))


def lower_words(text: Column) -> Column:
    """array<string>: A-Z lower-cased, then runs of digits, letters and code points from 0x80 up. Null has none."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), SEPARATORS, -1), "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once, however often body names it."""
    return F.transform(F.array(value), body)[0]


def before(numbers: Column, op: Callable[[Column, Column], Column], block: int = 128) -> Column:
    """For each of an array<bigint> the fold, from 0, of those before it, and at the end that of all.

    Arrays can only be appended to by copying them, so that is done in blocks: the work stays in proportion to
    the array's size.
    """
    zero = F.lit(0).cast("bigint")

    def scan(values: Column, start: Column) -> Column:
        return F.aggregate(values, F.array(start), lambda a, x: F.concat(a, F.array(op(F.element_at(a, -1), x))))

    def whole(ns: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor(F.size(ns) / block).cast("int")), lambda b: F.slice(ns, b * block + 1, F.lit(block)))
        far = lambda bs: scan(F.transform(bs, lambda b: F.aggregate(b, zero, op)), zero)
        each = lambda bs, starts: F.flatten(F.zip_with(bs, F.slice(starts, F.lit(1), F.size(bs)), lambda b, s: F.slice(scan(b, s), F.lit(1), F.size(b))))
        return let(blocks, lambda bs: let(far(bs), lambda starts: F.concat(each(bs, starts), F.array(F.element_at(starts, -1)))))

    return let(numbers, whole)


def count_matches(text: Column, pattern: str) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(pattern)).cast("long")


def fits(small: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """Whether rows that are cheap to read measure at most limit bytes."""
    return (small.agg(F.sum(F.length(F.to_json(F.struct("*"))) + 64).alias("b")).first()["b"] or 0) <= limit


def checked_broadcast(small: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """small with a broadcast hint if its rows, which must be cheap to read, measure at most limit bytes.

    Beyond the limit it is returned without a hint: Spark then shuffles both sides of the join.
    """
    return F.broadcast(small) if fits(small, limit) else small
