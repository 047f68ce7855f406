"""Exact deduplication of arriving documents by a stateful stream.

Documents arrive as Parquet files in a folder that is read as a stream. Each text, lower-cased in A-Z only, is keyed by its
SHA-256. The keyed state is kept on disk (RocksDB) and never expires; of each key it holds the stable identifier, which
is the largest doc_id so far, the place of that row, and a content locator: the file and row of the first
text that came under the key. No text is held. A text whose key is known is a hit, and hits are taken for copies only after
their full bytes were compared with the content at the locator; texts that differ under one key make classes of
their own.

Copies that arrive together are folded to one before the shuffle, text by text within each Arrow batch, so that a
text that a third of all rows share reaches its state as one row a batch. The bytes of hits are compared in one pass over the
files once the backlog is read. What the stream says of each arrival goes to a log; `state_dir` holds log and
checkpoint, and a later run with the same folder reads only files that are new to it.

Edge cases: null counts as empty; all empty texts are equal; a null doc_id ranks below every other; of rows that are equal
in doc_id and text the one that stands first (by file name, then row) stays; texts of any length are hashed and
compared whole; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from mercadia.llm._common import _LOWER, _UPPER, checked_broadcast, new_path, stored

#: Micro-batches that a backlog of files is read in, at most.
BATCHES = 4
#: Classes of this share of all rows or more are joined by broadcast; there can't be more of them than its inverse.
HOT_SHARE = 1e-4
_FOLD = bytes.maketrans(_UPPER.encode(), _LOWER.encode())
_ARRIVALS = "digest string, doc_id long, path string, row long, n long"
_LOG = f"{_ARRIVALS}, keep_id long, content_path string, content_row long"
_Entry = Row("digest", "doc_id", "path", "row", "n", "keep_id", "content_path", "content_row")


@contextmanager
def _disk_state(spark: SparkSession) -> Iterator[None]:
    """Streams that start inside keep their state in RocksDB, in bounded memory."""
    wanted = {
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
        "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
        "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "200",
        # else each partition of the state reserves megabytes of disk before it holds a row
        "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    }
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def normal(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)


def _located(df: DataFrame) -> DataFrame:
    """doc_id, text and the place of each row of a table read from files."""
    place = df.metadataColumn("_metadata")
    return df.select(df["doc_id"].cast("long").alias("doc_id"), df["text"].alias("text"), place["file_path"].alias("path"), place["row_index"].alias("row"))


def _better(a: tuple, b: tuple) -> bool:
    """Whether (doc_id, path, row) a stays rather than b."""
    ids = (a[0] is not None, a[0] or 0), (b[0] is not None, b[0] or 0)
    return ids[0] > ids[1] or (ids[0] == ids[1] and a[1:] < b[1:])


def _folder(chars: int):
    """Folds the equal texts of each batch (doc_id, text, path, row) to one arrival."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: dict[bytes, list] = {}
            for doc_id, text, path, row in zip(*(c.to_pylist() for c in batch.columns)):
                body, place = (text or "").encode().translate(_FOLD), (doc_id, path, row)
                known = held.get(body)
                if known is None:
                    held[body] = [place, 1]
                else:
                    known[1] += 1
                    if _better(place, known[0]):
                        known[0] = place
            digests = [hashlib.sha256(body).hexdigest()[:chars] for body in held]
            places = list(zip(*(p for p, _ in held.values()))) or [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(digests, pa.string()), pa.array(places[0], pa.int64()), pa.array(places[1], pa.string()), pa.array(places[2], pa.int64()), pa.array([n for _, n in held.values()], pa.int64())],
                names=["digest", "doc_id", "path", "row", "n"],
            )

    return task


class Keeper(StatefulProcessor):
    """For each digest the identifier that stays, where its row is, and where the first content is."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "keep_id long, keep_path string, keep_row long, content_path string, content_row long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        state = self.held.get()
        keep, content = (tuple(state[:3]), tuple(state[3:])) if state else (None, None)
        out = []
        for r in rows:
            place = (r["doc_id"], r["path"], r["row"])
            content = content or place[1:]
            if keep is None or _better(place, keep):
                keep = place
            out.append((key[0], *place, r["n"], keep[0], *content))
        self.held.update((*keep, *content))
        return (_Entry(*o) for o in out)


def watch(spark: SparkSession, folder: str, state_dir: str, digest_chars: int = 64, files_per_trigger: int | None = None) -> DataFrame:
    """Reads what has come into the folder since the last run with this state_dir, and returns the whole log of arrivals."""
    table = spark.read.parquet(folder)
    if files_per_trigger is None:
        files_per_trigger = max(1, -(-len(table.inputFiles()) // BATCHES))
    # a pattern that only the folder's own name fits: the table may be a single file, which isn't taken as it is
    name = folder.rstrip("/")
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{name[:-1]}[{name[-1]}]")
    arrivals = _located(stream).mapInArrow(_folder(digest_chars), _ARRIVALS)
    kept = arrivals.groupBy("digest").transformWithState(Keeper(), _LOG, "append", "None")
    with _disk_state(spark):
        query = kept.writeStream.format("parquet").option("path", f"{state_dir}/log").option("checkpointLocation", f"{state_dir}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(_LOG).parquet(f"{state_dir}/log")


def _texts(spark: SparkSession, folder: str, places: DataFrame) -> DataFrame:
    """(path, row, body) of the rows at places (path, row): one pass over the files."""
    all_rows = _located(spark.read.parquet(folder)).select("path", "row", normal(F.col("text")).alias("body"))
    return stored(all_rows.join(checked_broadcast(places), ["path", "row"], "left_semi"), "bodies")


def differing(spark: SparkSession, folder: str, log: DataFrame) -> DataFrame:
    """(digest, path, row, body, content) of the arrivals whose bytes aren't those of their key's content."""
    hits = stored(log.where("path <> content_path OR row <> content_row").select("digest", "path", "row", "content_path", "content_row").distinct(), "hits")
    places = stored(hits.select("path", "row").union(hits.select("content_path", "content_row")).distinct(), "places")
    bodies = _texts(spark, folder, places)
    contents = bodies.select(F.col("path").alias("content_path"), F.col("row").alias("content_row"), F.col("body").alias("content"))
    compared = hits.join(bodies, ["path", "row"]).join(contents, ["content_path", "content_row"])
    return stored(compared.where("body <> content").select("digest", "path", "row", "body", "content"), "differing")


def deduplicate(spark: SparkSession, folder: str, state_dir: str | None = None, digest_chars: int = 64, files_per_trigger: int | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row of the Parquet table in `folder`.

    digest_chars: hexadecimal digits of the SHA-256 that key the state; fewer of them make collisions, which the comparison
    of bytes settles.
    """
    log = stored(watch(spark, folder, state_dir or new_path(spark, "stream"), digest_chars, files_per_trigger), "log")
    odd = differing(spark, folder, log)
    collided = bool(odd.take(1))
    rows = _located(spark.read.parquet(folder)).withColumn("body", normal(F.col("text"))).withColumn("text_sha256", F.sha2("body", 256))
    rows = rows.withColumn("digest", F.substring("text_sha256", 1, digest_chars))
    if collided:
        # texts that aren't their key's content are told apart by themselves
        log = log.join(odd.select("path", "row", F.col("body").alias("variant")), ["path", "row"], "left")
        contents = odd.groupBy("digest").agg(F.first("content").alias("content"))
        rows = rows.join(checked_broadcast(contents), "digest", "left").withColumn("variant", F.when(F.col("body") != F.col("content"), F.col("body")))
        named = F.when(F.col("variant").isNull(), F.col("digest")).otherwise(F.concat_ws("=", "digest", "variant"))
    else:
        named = F.col("digest")
    classes = _classes(log.withColumn("class", named))
    return _labelled(rows.select("doc_id", "path", "row", named.alias("class"), "text_sha256"), classes)


def _classes(log: DataFrame) -> DataFrame:
    """(class, keep_id, keep_path, keep_row, group_size) of the classes of several rows."""
    rank = F.struct(F.col("doc_id").isNull().alias("none"), F.bitwise_not("doc_id").alias("id"), "path", "row")
    found = log.groupBy("class").agg(F.min(rank).alias("k"), F.sum("n").alias("group_size")).where("group_size > 1")
    return stored(found.select("class", F.bitwise_not("k.id").alias("keep_id"), F.col("k.path").alias("keep_path"), F.col("k.row").alias("keep_row"), "group_size"), "classes")


def _labelled(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Every row with what its class keeps; a row without a class of several is alone.

    A class of many rows is joined by broadcast, and its rows' keys are then their own places, so that none of them
    meet in one task.
    """
    total = classes.agg(F.sum("group_size").alias("t")).first()["t"] or 0
    many = F.col("group_size") >= max(2, int(total * HOT_SHARE))
    hot, cold = checked_broadcast(classes.where(many)), classes.where(~many)
    kept = F.struct("keep_id", "keep_path", "keep_row", "group_size")
    first = rows.join(hot.select("class", kept.alias("h")), "class", "left")
    keyed = first.withColumn("key", F.when(F.col("h").isNull(), F.col("class")).otherwise(F.concat_ws(":", "path", "row")))
    both = keyed.join(cold.select(F.col("class").alias("key"), kept.alias("c")), "key", "left").withColumn("k", F.coalesce("h", "c"))
    alone = F.col("k").isNull()
    return both.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("k.keep_id")).alias("keep_id"),
        F.coalesce("k.group_size", F.lit(1).cast("bigint")).alias("group_size"),
        (alone | ((F.col("path") == F.col("k.keep_path")) & (F.col("row") == F.col("k.keep_row")))).alias("kept"),
        "text_sha256",
    )
