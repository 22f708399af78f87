"""Reading and writing execution traces and their block dictionary.

A trace is text.  A marked line carries records ``block:thread[:field]``, separated by
``-``, either plain or as base64 of a zlib stream.  The dictionary is JSON: method,
block, then instruction and source line in turn.
"""

from __future__ import annotations

import base64
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracery.plans.ordered import SIZE, numbered, previous
from tracery.plans.scratch import written

MARK = "SLICING:"
PACKED = " ZLIB: "
BATCH = 1024
_NUMBER = r"^[+-]?[0-9]+$"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, value) of one text file, in the order of the file, however it is split."""
    raw = spark.read.text(path).select("value", F.col("_metadata.file_block_start").alias("_at"), F.monotonically_increasing_id().alias("_id"))
    # a split is read in order within one partition, so (split, id) is the order of lines
    return numbered(raw, "line_no", ["_at", "_id"], size=1).select("line_no", "value")


def _inflate(texts: pa.Array) -> pa.Array:
    """The text of each zlib stream; what can be read of a broken one, empty for what is none."""
    out = []
    for t in texts:
        stream, got = zlib.decompressobj(), b""
        try:
            got = stream.decompress(base64.b64decode(t.as_py(), validate=True)) if t.is_valid else b""
        except (ValueError, zlib.error):
            pass
        out.append(got.decode("utf-8", "replace"))
    return pa.array(out, pa.string())


def _deflate(texts: pa.Array) -> pa.Array:
    return pa.array([base64.b64encode(zlib.compress(t.as_py().encode())).decode() for t in texts], pa.string())


def payloads(lines: DataFrame) -> DataFrame:
    """``lines`` with ``payload`` in place of ``value``: marked lines only, what stands between the first and second mark."""
    parts = F.split("value", MARK)
    behind = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))
    return lines.where(F.exists(behind, lambda x: x != "")).withColumn("payload", F.get(parts, F.lit(1))).drop("value")


def marked_payloads(lines: DataFrame, size: int = SIZE) -> DataFrame:
    """(line_no, payload) of marked lines, consecutive repeats dropped."""
    seen = previous(payloads(lines).select("line_no", "payload"), "line_no", {"before": "payload"}, size=size)
    return seen.where(~F.col("payload").eqNullSafe(F.col("before"))).select("line_no", "payload")


def _text(payload: Column) -> Column:
    """The records of a payload, unpacked if they are packed."""
    return F.when(payload.startswith(PACKED), F.arrow_udf(_inflate, "string")(F.get(F.split(payload, PACKED), F.lit(1)))).otherwise(payload)


def _checked(each: DataFrame, others: list[str], mode: str) -> DataFrame:
    """Records (others, rec_idx, record) as numbers; see :func:`records`."""
    each = each.withColumn("t", F.split("record", ":"))
    bb, thread, field = (F.get("t", F.lit(k)) for k in range(3))
    each = each.where(bb.rlike(_NUMBER) & bb.try_cast("bigint").isNotNull())
    bad = ~F.coalesce(thread.rlike(_NUMBER), F.lit(False)) | (field.isNotNull() & ~field.rlike(_NUMBER))
    values = [bb.try_cast("bigint").alias("bb_id"), thread.try_cast("bigint").alias("thread_id"), F.coalesce(field.try_cast("int"), F.lit(-1)).alias("field_id")]
    if mode == "PERMISSIVE":
        return each.select(*others, "rec_idx", *values, F.when(bad, F.col("record")).alias("corrupt"))
    checked = F.when(bad, F.raise_error(F.concat(F.lit("bad record: "), F.col("record"))).cast("bigint")).otherwise(values[0])
    return each.select(*others, "rec_idx", checked.alias("bb_id"), *values[1:])


def records_of(marked: DataFrame, mode: str = "FAILFAST") -> DataFrame:
    """The records of rows with a ``payload``: its other columns, rec_idx, bb_id, thread_id, field_id."""
    others = [c for c in marked.columns if c != "payload"]
    return _checked(marked.select(*others, F.posexplode(F.split(_text(F.col("payload")), "-")).alias("rec_idx", "record")), others, mode)


def records(lines: DataFrame, mode: str = "FAILFAST", size: int = SIZE) -> DataFrame:
    """(line_no, rec_idx, bb_id, thread_id, field_id) of the records of a trace, plus ``corrupt`` in PERMISSIVE mode.

    Records without a numeric block are no records.  One without a numeric thread, or
    with a field that is no number, is an error, or is kept as ``corrupt``.
    """
    return records_of(marked_payloads(lines, size), mode)


def encode(rows: DataFrame, pos: str = "pos", batch: int = BATCH, packed: bool = True) -> DataFrame:
    """(line_no, value): trace lines for rows (pos, bb_id, thread_id, field_id), ``batch`` positions a line.

    Positions are whole numbers without gaps.  A field of null or 0 is not written.
    """
    record = F.concat_ws(":", F.col("bb_id").cast("string"), F.col("thread_id").cast("string"), F.when(F.col("field_id") != 0, F.col("field_id").cast("string")))
    each = rows.select(F.floor(F.col(pos) / batch).cast("bigint").alias("line_no"), F.struct(F.col(pos).alias("p"), record.alias("r")).alias("x"))
    # a line holds at most ``batch`` records
    text = F.concat(F.concat_ws("-", F.transform(F.array_sort(F.collect_list("x")), lambda x: x["r"])), F.lit("-"))
    lines = each.groupBy("line_no").agg(text.alias("text"))
    if not packed:
        return lines.select("line_no", F.concat(F.lit(MARK), "text").alias("value"))
    return lines.select("line_no", F.concat(F.lit(MARK + PACKED), F.arrow_udf(_deflate, "string")("text")).alias("value"))


def block_dictionary(docs: DataFrame, column: str = "value") -> DataFrame:
    """(bb_id, method, stmt_idx, instr, bb_src_line) of JSON dictionaries, one a row; a block's source line is its first."""
    methods = docs.select(F.explode(F.from_json(column, "map<string,map<string,array<string>>>")).alias("method", "blocks"))
    blocks = methods.select("method", F.explode("blocks").alias("bb", "parts"))
    instr = F.filter("parts", lambda x, i: i % 2 == 0)
    return blocks.select(
        F.col("bb").cast("bigint").alias("bb_id"), "method", F.get("parts", F.lit(1)).cast("bigint").alias("bb_src_line"), F.posexplode(instr).alias("stmt_idx", "instr")
    ).select("bb_id", "method", "stmt_idx", "instr", "bb_src_line")


def expand(recs: DataFrame, blocks: DataFrame, size: int = SIZE) -> DataFrame:
    """The trace: one row per executed statement, numbered from 0.  Records of unknown blocks have no rows."""
    each = recs.join(blocks, "bb_id")
    rows = numbered(each, "pos", ["line_no", "rec_idx", "stmt_idx"], size)
    return rows.select("pos", "bb_id", "stmt_idx", "method", "instr", "bb_src_line", "thread_id", "field_id")


def resolve_gotos(blocks: DataFrame) -> DataFrame:
    """Blocks with the placeholder of goto instructions replaced by the first instruction of the block it names.

    First instructions are resolved along, so chains of n gotos need log2(n) rounds.  A
    placeholder of an unknown block stays; gotos in a circle are an error.
    """
    number = F.regexp_extract("instr", r'tmpString = "(\d+)"', 1)
    open_ = F.col("instr").contains("goto") & (number != "")
    swapped = F.expr("""regexp_replace(instr, 'tmpString = "[0-9]+"', replace(replace(target, '\\\\', '\\\\\\\\'), '$', '\\\\$'))""")
    left = blocks.where(open_).count().bit_length() + 1
    while True:
        firsts = blocks.where("stmt_idx = 0").select(F.col("bb_id").alias("to"), F.col("instr").alias("target"))
        keyed = blocks.withColumn("to", F.when(open_, number.cast("bigint")))
        if keyed.join(firsts, "to", "left_semi").isEmpty():
            return blocks
        if left == 0:
            raise RuntimeError("gotos go in a circle")
        left -= 1
        blocks = written(keyed.join(firsts, "to", "left").withColumn("instr", F.when(F.col("target").isNotNull(), swapped).otherwise(F.col("instr"))).drop("to", "target"), "gotos")


def without_repeated_windows(rows: DataFrame, order: str, columns: list[str], window: int, by: tuple = (), size: int = SIZE) -> DataFrame:
    """Rows without the blocks of ``window`` consecutive rows that equal the block before.

    Equality carries over, so comparing with the block before is comparing with the
    block kept last.  A block that is not full is kept.
    """
    order_in = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.struct(*columns).alias("v"))))
    blocks = rows.groupBy(*by, F.floor(F.col(order) / window).cast("bigint").alias("_w")).agg(F.transform(order_in, lambda x: x["v"]).alias("_s"))
    seen = previous(blocks, "_w", {"_p": "_s"}, by, size)
    kept = seen.where(~F.col("_s").eqNullSafe(F.col("_p")) | (F.size("_s") < window)).select(*by, "_w")
    return rows.withColumn("_w", F.floor(F.col(order) / window).cast("bigint")).join(kept, [*by, "_w"], "left_semi").drop("_w")
