"""Traces read as they are written: the statements of many files, numbered across batches.

Marks, packing, records and the block dictionary need no memory.  What a file has to
remember from batch to batch is small: its last payload, as repeats of it are dropped,
the last line it has seen, and how many statements it has.

A file is one order, but only its state has to see it in order.  The records of a
bucket of lines are sorted and packed in a task of their own; the state of the file
meets one row for each pack and says where its statements begin; then the packs are
dealt out and opened.
"""

from __future__ import annotations

import contextlib
import tempfile
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracery.sources.traces import payloads, records_of

STATE = "digest string, line_no long, next long"
OUT = "file string, pos long, bb_id long, stmt_idx int, method string, instr string, bb_src_line long, thread_id long, field_id int"
_ORDER = ["line_no", "mark", "rec_idx", "stmt_idx"]
#: Rows that a task holds of a group, and of each sorted run beyond them.
RUN, PIECE = 1 << 18, 1 << 12
#: A bucket has 2 ** BUCKET line numbers, a pack some PACK rows, but whole lines; a row of packs weighs as much as WIDE others.
BUCKET, PACK, WIDE = 16, 1 << 11, 1 << 6
_HELD = pa.schema([("line_no", pa.int64()), ("digest", pa.string()), ("rec_idx", pa.int32()), ("stmt_idx", pa.int32()), ("bb_id", pa.int64()), ("method", pa.string()), ("instr", pa.string()), ("bb_src_line", pa.int64()), ("thread_id", pa.int64()), ("field_id", pa.int32())])
#: Records with the number of their statements.  A line's own row, with its digest, is its first; ``mark`` tells payloads of one line number apart.
_ROWS = pa.schema([("line_no", pa.int64()), ("mark", pa.int64()), ("rec_idx", pa.int32()), ("digest", pa.string()), ("bb_id", pa.int64()), ("thread_id", pa.int64()), ("field_id", pa.int32()), ("n", pa.int64())])
#: The last and the first line of a pack with their digests, and the statements of all and of the first.
_PACKS = pa.schema([("line_no", pa.int64()), ("first_no", pa.int64()), ("digest", pa.string()), ("head", pa.string()), ("n", pa.int64()), ("n_head", pa.int64()), ("packed", pa.binary())])
_PACKED = "file string, line_no long, first_no long, digest string, head string, n long, n_head long, packed binary"
_PLACED = "file string, start long, line_no long, digest string, packed binary"
_OPENED = pa.schema([("file", pa.string()), ("start", pa.int64()), ("bb_id", pa.int64()), ("thread_id", pa.int64()), ("field_id", pa.int32())])


def _sorted(rows: list[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(rows, ignore_index=True).sort_values([c for c in _ORDER if c in rows[0]], kind="stable", ignore_index=True)


def _merged(runs: list[Iterator[pa.RecordBatch]]) -> Iterator[pd.DataFrame]:
    """The rows of sorted runs in order, two pieces of each at a time; the rows of a line come together."""
    def more(run: Iterator[pa.RecordBatch]) -> pd.DataFrame | None:
        batch = next(run, None)
        return None if batch is None else batch.to_pandas(integer_object_nulls=True)

    heads, nexts = [more(run) for run in runs], [more(run) for run in runs]
    firsts = [(int(h["line_no"].iloc[0]), k) for k, h in enumerate(heads)]
    # beyond the last line of a piece that goes on, its run may have smaller lines than others
    lasts = [(int(h["line_no"].iloc[-1]), k) for k, h in enumerate(heads) if nexts[k] is not None]
    heapify(firsts)
    heapify(lasts)
    while firsts:
        end, ready = lasts[0][0] if lasts else None, []
        while firsts and (end is None or firsts[0][0] < end):
            k = heappop(firsts)[1]
            cut = len(heads[k]) if end is None else int(heads[k]["line_no"].searchsorted(end))
            ready.append(heads[k].iloc[:cut])
            heads[k] = heads[k].iloc[cut:]
            if len(heads[k]):
                heappush(firsts, (int(heads[k]["line_no"].iloc[0]), k))
        if ready:
            yield _sorted(ready)
        # only runs that hold up the others are read on
        while lasts and lasts[0][0] == end:
            k = heappop(lasts)[1]
            pieces = [heads[k]]
            while nexts[k] is not None and pieces[-1]["line_no"].iloc[-1] == end:
                pieces.append(nexts[k])
                nexts[k] = more(runs[k])
            heads[k] = pd.concat(pieces, ignore_index=True)
            if nexts[k] is not None:
                heappush(lasts, (int(heads[k]["line_no"].iloc[-1]), k))


def _in_order(batches: Iterator[pd.DataFrame], last: int, schema: pa.Schema = _HELD, wide: int = 1) -> Iterator[pd.DataFrame]:
    """The rows after line ``last`` in order; at most ``RUN`` of them, or ``RUN / wide``, are held, the others wait in sorted runs in the task's temporary folder."""
    with tempfile.TemporaryDirectory() as folder, contextlib.ExitStack() as files:
        held, size, runs = [], 0, []

        def table() -> pa.Table:
            rows = pa.Table.from_pandas(_sorted(held), schema=schema, preserve_index=False)
            held.clear()
            return rows

        for batch in batches:
            batch = batch[batch["line_no"] > last]
            held += [batch] if len(batch) else []
            size += len(batch)
            if size >= RUN // wide:
                at, size = f"{folder}/{len(runs)}", 0
                with pa.OSFile(at, "wb") as f, pa.ipc.new_stream(f, schema) as out:
                    out.write_table(table(), max_chunksize=max(PIECE // wide, 1))
                runs.append(iter(files.enter_context(pa.ipc.open_stream(files.enter_context(pa.OSFile(at, "rb"))))))
        if held and not runs:
            yield _sorted(held)
            return
        if held:
            runs.append(iter(table().to_batches(max_chunksize=max(PIECE // wide, 1))))
        yield from _merged(runs)


def _kept(rows: pa.Table, last: int, digest: str | None) -> pa.Table:
    """The records after line ``last``, whose payload has ``digest``, without those of lines that repeat the payload of the line before."""
    rows = rows.slice(int(np.searchsorted(rows["line_no"].to_numpy(), last, side="right")))
    own = rows["rec_idx"].to_numpy() < 0
    texts = rows["digest"].to_numpy(zero_copy_only=False)[own]
    new = texts != np.concatenate([np.array([digest], object), texts[:-1]])[: len(texts)]
    return rows.filter(pa.array(new.astype(bool)[np.cumsum(own) - 1] & ~own))


def _packs(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of a bucket of lines, sorted and packed, whole lines at a time."""
    for held in _in_order((b.select(_ROWS.names).to_pandas(integer_object_nulls=True) for b in batches), -1, _ROWS):
        # a line that came twice is one
        rows = pa.Table.from_pandas(held.drop_duplicates(_ORDER[:3]), schema=_ROWS, preserve_index=False).drop_columns("mark")
        line, own = rows["line_no"].to_numpy(), np.flatnonzero(rows["rec_idx"].to_numpy() < 0)
        begins = np.flatnonzero(np.diff(line, prepend=-1))
        cuts = begins[np.flatnonzero(np.diff(begins // PACK, prepend=-1))]
        packs = []
        for lo, hi in zip(cuts, [*cuts[1:], len(rows)], strict=True):
            part, ends = rows.slice(lo, hi - lo), [*own[slice(*np.searchsorted(own, (lo + 1, hi)))], hi]
            head, digest = (rows["digest"][int(k)].as_py() for k in (lo, ends[-2] if len(ends) > 1 else lo))
            packs.append((int(line[hi - 1]), int(line[lo]), digest, head, _total(_kept(part, -1, None)), _total(rows.slice(lo, ends[0] - lo)), _written(part)))
        columns = map(pa.array, zip(*packs, strict=True), _PACKS.types)
        yield from pa.table([pa.array([key[0].as_py()] * len(packs), pa.string()), *columns], names=["file", *_PACKS.names]).to_batches()


def _written(rows: pa.Table) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as f:
        f.write_table(rows.combine_chunks())
    return out.getvalue().to_pybytes()


def _read(packed: bytes) -> pa.Table:
    with pa.ipc.open_stream(packed) as f:
        return f.read_all()


def _total(rows: pa.Table) -> int:
    return int(rows["n"].to_numpy().sum())


def _place(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """The packs of one file with the number of statements before them, and the line before them with its digest."""
    digest, last, at = state.get if state.exists else (None, -1, 0)
    for packs in _in_order(batches, last, _PACKS, WIDE):
        rows = []
        for p in packs[_PACKS.names].itertuples(index=False):
            rows.append((key[0], at, last, digest, p.packed))
            if p.first_no > last:
                at += p.n - (p.n_head if p.head == digest else 0)
            else:
                at += _total(_kept(_read(p.packed), last, digest))
            digest, last = p.digest, int(p.line_no)
        state.update((digest, last, int(at)))
        yield pd.DataFrame(rows, columns=["file", "start", "line_no", "digest", "packed"])


def _open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The records of packs, each with the number of its first statement."""
    for batch in batches:
        for k in range(batch.num_rows):
            file, start, last, digest, packed = (batch[c][k].as_py() for c in ("file", "start", "line_no", "digest", "packed"))
            rows = _kept(_read(packed), last, digest)
            n = rows["n"].to_numpy()
            columns = [pa.array([file] * len(n), pa.string()), pa.array(start + np.cumsum(n) - n, pa.int64()), *(rows[c].combine_chunks() for c in _OPENED.names[2:])]
            yield from pa.table(columns, schema=_OPENED).to_batches()


def stream_trace(lines: DataFrame, blocks: DataFrame, mode: str = "FAILFAST") -> DataFrame:
    """The trace of a stream of ``lines(file, line_no, value)``: a row for each executed statement, numbered from 0 in its file.

    ``blocks`` is the static dictionary of ``tracery.sources.traces.block_dictionary``.
    Within a batch lines may come in any order; a line that comes after a later line of
    its file was in an earlier batch counts as seen, and one that comes twice counts once.
    The rows are those that the batch reader gives for each file.
    """
    numbered = lines.select("file", F.col("line_no").cast("long").alias("line_no"), "value").where("line_no >= 0")
    marked = payloads(numbered).withColumns({"digest": F.sha2("payload", 256), "mark": F.xxhash64("payload")})
    ranked = blocks.withColumn("rank", F.row_number().over(Window.partitionBy("bb_id").orderBy("stmt_idx", "method", "instr")) - 1)
    found = records_of(marked, mode).join(blocks.groupBy("bb_id").agg(F.count("*").alias("n")), "bb_id")
    none = {"rec_idx": "int", "bb_id": "long", "thread_id": "long", "field_id": "int", "n": "long"}
    # a line without rows still tells repeats apart
    held = marked.select("file", "line_no", "mark", "digest", *[F.lit(-1 if c == "rec_idx" else 0).cast(t).alias(c) for c, t in none.items()])
    # the line's own row has the digest
    rows = found.select("file", "line_no", "mark", F.lit(None).cast("string").alias("digest"), *[F.col(c).cast(t).alias(c) for c, t in none.items()]).unionByName(held)
    packs = rows.groupBy("file", F.shiftright("line_no", BUCKET).alias("bucket")).applyInArrow(_packs, _PACKED)
    placed = packs.groupBy("file").applyInPandasWithState(_place, _PLACED, STATE, "append", "NoTimeout")
    # the column is computed as rows cannot be exchanged as the state's Python gives them
    dealt = placed.withColumn("deal", F.xxhash64("file", "start", "line_no")).repartition("deal")
    opened = dealt.mapInArrow(_open, "file string, start long, bb_id long, thread_id long, field_id int").join(ranked, "bb_id")
    return opened.withColumn("pos", F.col("start") + F.col("rank")).select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in OUT.split(", ")])
