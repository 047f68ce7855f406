"""Fill-in-the-middle: documents cut at two code points and put together in another order.

A parallel automaton scan finds the cuts. The automaton reads UTF-8 bytes: its states say how many bytes of a
character are still to come and how much of a sentinel has been read, and it counts a code point at each
character's last byte. A chunk of a text can be scanned before it is known in which state it is entered: the
scan gives the state reached and the code points and sentinels counted for every state of entry. Such summaries
compose associatively, so a document's chunks are scanned apart, composed in order, and each cut is looked for in the one
chunk that holds it, from the state of entry that the composition found.

Documents of up to CHUNK bytes are one chunk, scanned where they are read. Longer ones are dealt out: their chunks
travel to any task, summaries of BLOCK chunks are composed to one before those are composed to the document's, and only the
places of the cuts come back.

Edge cases: null texts count as empty; empty texts are plain; a text that contains a sentinel is plain; a null
doc_id is hashed as "null"; repeated rows give equal rows; an empty table gives an empty result; extra columns
are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mercadia.llm._common import let, stored

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Bytes of a chunk, and the chunks whose summaries are composed to one.
CHUNK, BLOCK = 64 << 10, 256
#: Of a hundred documents so many stay plain, and of a hundred others so many put the suffix first.
PLAIN, SUFFIX_FIRST = 10, 20

# States: 0 ground, 1 after "<", 2 after "<P", "<S" or "<M", 3 to 5: so many bytes less 2 of a character are to come.
STATES = 6
_SENTINELS = (b"<P>", b"<S>", b"<M>")


def _tables() -> tuple[list[bytes], list[bytes], list[bytes]]:
    """For each state and byte: the next state, the code points and the sentinels that end there."""
    to, ends, marks = np.zeros((STATES, 256), np.uint8), np.zeros((STATES, 256), np.uint8), np.zeros((STATES, 256), np.uint8)
    for state in range(STATES):
        for b in range(256):
            if 0x80 <= b < 0xC0:
                to[state, b], ends[state, b] = (state - 1 if state > 3 else 0), state == 3
            elif b >= 0xC0:
                to[state, b] = 3 if b < 0xE0 else 4 if b < 0xF0 else 5
            else:
                ends[state, b] = 1
                to[state, b] = 1 if b == ord("<") else 2 if state == 1 and b in b"PSM" else 0
                marks[state, b] = state == 2 and b == ord(">")
    return [t.tobytes() for t in to], [t.tobytes() for t in ends], [t.tobytes() for t in marks]


_TO, _ENDS, _MARKS = _tables()
#: Bytes after which every state is the same, and characters and sentinels counted are too.
_RESETS = bytes(b for b in range(256) if b >= 0xC0 or (b < 0x80 and b not in b"PSM>"))
_UNSETTLED = bytes(set(range(256)) - set(_RESETS))


def run(data: bytes, state: int) -> tuple[int, int, int]:
    """The automaton, a byte at a time: state reached, code points, sentinels."""
    points = marks = 0
    for b in data:
        points += _ENDS[state][b]
        marks += _MARKS[state][b]
        state = _TO[state][b]
    return state, points, marks


def _settled(data: bytes) -> int:
    """Bytes up to and with the first one after which the state doesn't depend on that of entry."""
    rest = len(data.lstrip(_UNSETTLED))
    return len(data) - rest + 1 if rest else len(data)


def _long_run(data: bytes, state: int) -> tuple[int, int, int]:
    """`run` for long data, counted at once: code points are bytes that don't continue one, less an unfinished last one."""
    head = _settled(data)
    state, points, marks = run(data[:head], state)
    if head == len(data):
        return state, points, marks
    rest = data[head:]
    cut = len(rest)
    while cut and (rest[cut - 1] not in _RESETS):
        cut -= 1
    # rest[:cut] ends with a byte that settles the state; what follows it is run byte by byte
    if cut:
        begun = state >= 3  # a character begun before rest ends in it
        bulk = np.frombuffer(rest, np.uint8, cut)
        last = rest[cut - 1]
        points += int(np.count_nonzero((bulk & 0xC0) != 0x80)) + begun - (last >= 0xC0)
        marks += sum((data[head - 1 : head + cut] if state == 1 else rest[:cut]).count(s) for s in _SENTINELS)
        state = _TO[0][last]
    end, more, found = run(rest[cut:], state)
    return end, points + more, marks + found


def summary(data: bytes) -> tuple[list[int], list[int], list[int]]:
    """A chunk as a function of the state of entry: state reached, code points, sentinels for each state."""
    head = _settled(data)
    firsts = [run(data[:head], s) for s in range(STATES)]
    if head == len(data):
        return [x[0] for x in firsts], [x[1] for x in firsts], [x[2] for x in firsts]
    # from here on the states of entry differ no more
    last, points, marks = _long_run(data[head:], firsts[0][0])
    return [last] * STATES, [x[1] + points for x in firsts], [x[2] + marks for x in firsts]


def place(data: bytes, state: int, k: int) -> int:
    """Bytes up to and with the k-th code point that ends in data, entered in `state`."""
    if k <= 0:
        return 0
    values = np.frombuffer(data, np.uint8)
    begins = np.flatnonzero((values & 0xC0) != 0x80)
    head = values[begins]
    ends = begins + 1 + (head >= 0xC0) + (head >= 0xE0).astype(np.int64) + (head >= 0xF0)
    if state >= 3:
        ends = np.concatenate([[state - 2], ends])
    return int(ends[k - 1])


def composed(parts: Column) -> Column:
    """struct(next, points, marks) of an array of such structs in order: the composition of functions from states."""
    zero = F.lit(0).cast("bigint")
    start = F.struct(
        F.array(*[F.lit(s) for s in range(STATES)]).alias("next"),
        F.array(*[zero] * STATES).alias("points"),
        F.array(*[zero] * STATES).alias("marks"),
    )

    def then(a: Column, b: Column) -> Column:
        at = lambda field: lambda s, x: x + b[field][s]
        return F.struct(
            F.transform(a["next"], lambda s: b["next"][s]).alias("next"),
            F.zip_with(a["next"], a["points"], at("points")).alias("points"),
            F.zip_with(a["next"], a["marks"], at("marks")).alias("marks"),
        )

    return F.aggregate(parts, start, then)


_FUNCTION = "next array<int>, points array<bigint>, marks array<bigint>"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, block, no, data) -> (key, block, no, function)."""
    for batch in batches:
        found = [summary(d.as_py()) for d in batch.column(3)]
        kinds = pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], *[pa.array([f[i] for f in found], kind) for i, kind in enumerate(kinds)]], names=["key", "block", "no", "next", "points", "marks"])


def _select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, base, data, state, k) -> (key, k, at): the byte at which a cut falls, counted from the document's first."""
    for batch in batches:
        base, data, state, k, nth = (c.to_pylist() for c in batch.columns[1:])
        at = [b + place(d, s, i) for b, d, s, i in zip(base, data, state, k)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nth, pa.int64()), pa.array(at, pa.int64())], names=["key", "nth", "at"])


def _unsigned(digest: Column, nth: int) -> Column:
    return F.conv(F.substring(digest, 8 * nth - 7, 8), 16, 10).cast("long")


def draws(doc_id: Column) -> Column:
    """array<bigint> of h1 to h4: the first four groups of eight digits of sha256("1:" and doc_id)."""
    text = F.concat(F.lit("1:"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    return let(F.sha2(text, 256), lambda d: F.array(*[_unsigned(d, i) for i in (1, 2, 3, 4)]))


def _form(n: Column, marks: Column, h: Column) -> Column:
    return F.when((n == 0) | (marks > 0) | (h[2] % 100 >= 100 - PLAIN), "plain").when(h[3] % 100 < SUFFIX_FIRST, "spm").otherwise("psm")


def _whole_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text, h) of one chunk each -> (doc_id, n, form, prefix_chars, middle_chars, output)."""
    for batch in batches:
        out = []
        for text, (h1, h2, h3, h4) in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            data = text.encode()
            _, points, marks = summary(data)
            n, marked = points[0], marks[0]
            if not n or marked or h3 % 100 >= 100 - PLAIN:
                out.append((n, "plain", None, None, text))
                continue
            low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
            a, b = place(data, 0, low), place(data, 0, high)
            form = "spm" if h4 % 100 < SUFFIX_FIRST else "psm"
            out.append((n, form, low, high - low, _arranged(form, data[:a], data[a:b], data[b:]).decode()))
        kinds = pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([o[i] for o in out], kind) for i, kind in enumerate(kinds)]], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])


def _arranged(form: str, prefix: bytes, middle: bytes, suffix: bytes) -> bytes:
    p, s, m = _SENTINELS
    return p + prefix + s + suffix + m + middle if form == "psm" else s + suffix + p + prefix + m + middle


_OUT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def fill_in_middle(docs: DataFrame, chunk: int = CHUNK, block: int = BLOCK) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and output of each row of docs (doc_id, text)."""
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    rows = rows.select("doc_id", "text", draws(F.col("doc_id")).alias("h"))
    small = rows.where(F.octet_length("text") <= chunk).mapInArrow(_whole_document, _OUT)
    long = rows.where(F.octet_length("text") > chunk)
    return small.unionByName(_dealt_out(long, chunk, block))


def _dealt_out(long: DataFrame, chunk: int, block: int) -> DataFrame:
    """The same for long documents, whose chunks are scanned by any task."""
    spark = long.sparkSession
    long = stored(long.select("doc_id", "text", "h", F.monotonically_increasing_id().alias("key")), "long")
    if not long.take(1):
        return spark.createDataFrame([], _OUT)
    count = F.ceil(F.octet_length("text") / chunk)
    data = F.col("text").cast("binary")
    parts = F.transform(F.sequence(F.lit(0).cast("bigint"), count - 1), lambda i: F.struct((i.cast("bigint")).alias("no"), F.substring(data, (i * chunk + 1).cast("int"), F.lit(chunk)).alias("data")))
    chunks = long.select("key", F.explode(parts).alias("c")).select("key", F.floor(F.col("c.no") / block).alias("block"), F.col("c.no").alias("no"), F.col("c.data").alias("data"))
    chunks = stored(chunks.repartition("key", "no"), "chunks")
    function = F.struct("next", "points", "marks")
    scanned = stored(chunks.mapInArrow(_scan, f"key bigint, block bigint, no bigint, {_FUNCTION}"), "functions")
    ordered = lambda at: F.transform(F.sort_array(F.collect_list(F.struct(F.col(at).alias("at"), function.alias("f")))), lambda x: x["f"])
    blocks = scanned.groupBy("key", "block").agg(composed(ordered("no")).alias("f")).select("key", "block", "f.*")
    blocks = stored(blocks, "blocks")
    whole = blocks.groupBy("key").agg(composed(ordered("block")).alias("f"))
    sized = long.select("key", "h").join(whole.select("key", F.col("f.points")[0].alias("n"), F.col("f.marks")[0].alias("m")), "key")
    cut = lambda pick: F.when(F.col("form") != "plain", pick(F.col("h")[0] % (F.col("n") + 1), F.col("h")[1] % (F.col("n") + 1)))
    plans = sized.withColumn("form", _form(F.col("n"), F.col("m"), F.col("h"))).withColumns({"low": cut(F.least), "high": cut(F.greatest)})
    plans = stored(plans.select("key", "n", "form", "low", "high"), "plans")
    wanted = plans.select("key", F.explode(F.array("low", "high")).alias("nth")).where("nth IS NOT NULL").distinct()
    # the block, and then the chunk in it, in which the nth code point ends
    in_block = _holder(wanted.withColumns({"state": F.lit(0), "before": F.lit(0).cast("bigint")}), blocks, ["key"], "block")
    in_chunk = _holder(in_block, scanned, ["key", "block"], "no")
    found = in_chunk.join(chunks.drop("block"), ["key", "no"])
    at = found.select("key", (F.col("no") * chunk).alias("base"), "data", "state", (F.col("nth") - F.col("before")).alias("k"), "nth").mapInArrow(_select, "key bigint, nth bigint, at bigint")
    at = at.unionByName(wanted.where("nth = 0").select("key", "nth", F.lit(0).cast("bigint").alias("at")))
    cuts = stored(at, "cuts")
    placed = plans.join(cuts.select("key", F.col("nth").alias("low"), F.col("at").alias("a")), ["key", "low"], "left").join(cuts.select("key", F.col("nth").alias("high"), F.col("at").alias("b")), ["key", "high"], "left")
    joined = long.join(placed, "key")
    piece = lambda start, end: F.substring(F.col("text").cast("binary"), (start + 1).cast("int"), (end - start).cast("int")).cast("string")
    size = F.octet_length("text")
    prefix, middle, suffix = piece(F.lit(0), F.col("a")), piece(F.col("a"), F.col("b")), piece(F.col("b"), size)
    output = (
        F.when(F.col("form") == "plain", F.col("text"))
        .when(F.col("form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
        .otherwise(F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
    )
    return joined.select("doc_id", "n", "form", F.col("low").alias("prefix_chars"), (F.col("high") - F.col("low")).alias("middle_chars"), output.alias("output"))


def _holder(wanted: DataFrame, parts: DataFrame, by: list[str], at: str) -> DataFrame:
    """wanted (key, nth, state, before, ...) with the part, by number `at`, in which the nth code point ends, and the state
    and count at its entry.

    by and nth name a search; it gathers the functions of the parts it searches, not their data.
    """
    gathered = parts.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(F.col(at).alias("at"), F.col("next"), F.col("points")))).alias("parts"))

    def step(a: Column, x: Column) -> Column:
        here = a["before"] + x["points"][a["state"]]
        done = (a["at"] >= 0) | (here >= F.col("nth"))
        return F.struct(
            F.when(a["at"] >= 0, a["at"]).when(here >= F.col("nth"), x["at"]).otherwise(F.lit(-1).cast("bigint")).alias("at"),
            F.when(done, a["state"]).otherwise(x["next"][a["state"]]).alias("state"),
            F.when(done, a["before"]).otherwise(here).alias("before"),
        )

    start = F.struct(F.lit(-1).cast("bigint").alias("at"), F.col("state").alias("state"), F.col("before").alias("before"))
    found = wanted.where("nth > 0").join(gathered, by).withColumn("found", F.aggregate("parts", start, step))
    kept = [c for c in wanted.columns if c not in ("state", "before")]
    return found.select(*kept, F.col("found.at").alias(at), F.col("found.state").alias("state"), F.col("found.before").alias("before"))


def restored(output: Column, form: Column) -> Column:
    """The text that `output` in `form` was made of. Text between sentinels holds none."""
    after = lambda text, mark: F.substring(text, F.locate(mark, text) + len(mark), F.length(text))
    until = lambda text, mark: F.substring_index(text, mark, 1)
    middle = after(output, MIDDLE)
    psm = F.concat(until(after(output, PREFIX), SUFFIX), middle, until(after(output, SUFFIX), MIDDLE))
    spm = F.concat(until(after(output, PREFIX), MIDDLE), middle, until(after(output, SUFFIX), PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
