"""Traces read as a stream against the batch reader."""

import random

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from tracery.sources import traces
from tracery.streaming import ingest
from tracery.streaming.ingest import stream_trace


def test_stream_gives_the_batch_trace(spark, tmp_path):
    rng = random.Random(7)
    blocks = spark.createDataFrame([(b, f"m{b % 3}", s, f"i{b}.{s}", b) for b in range(6) for s in range(b % 3)], "bb_id long, method string, stmt_idx int, instr string, bb_src_line long")
    lines = []
    for file in ("a", "b"):
        for n in range(40):
            body = "-".join(f"{rng.randrange(8)}:{rng.randrange(2)}" for _ in range(rng.randrange(1, 3))) + "-"
            lines.append((file, n, rng.choice([f"log SLICING:{body}", "SLICING:x:1-", "SLICING:1:1-2:1-", "SLICING:1:1-2:1-", "nothing", "SLICING: ZLIB: !!"])))
    schema = "file string, line_no long, value string"
    source, sink, marks = (str(tmp_path / x) for x in ("in", "out", "marks"))
    cuts = [0, 7, 8, 25, 40]
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        part = [x for x in lines if lo <= x[1] < hi]
        rng.shuffle(part)
        # what was delivered before comes again and changes nothing
        again = [x for x in lines if x[1] == lo - 1]
        spark.createDataFrame(part + again, schema).coalesce(1).write.mode("append").parquet(source)
        query = stream_trace(spark.readStream.schema(schema).parquet(source), blocks).writeStream.format("parquet").option("path", sink).option("checkpointLocation", marks).trigger(availableNow=True).start()
        query.awaitTermination()
    out = spark.read.parquet(sink)
    for file in ("a", "b"):
        mine = spark.createDataFrame([x[1:] for x in lines if x[0] == file], "line_no long, value string")
        want = traces.expand(traces.records(mine), blocks).select("pos", "bb_id", "stmt_idx", "method", "instr", "bb_src_line", "thread_id", "field_id").collect()
        got = out.where(F.col("file") == file).drop("file").collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and want


def test_many_marks_in_a_line(spark):
    long = "x" + traces.MARK * 1_100_000 + "7:1-"
    lines = spark.createDataFrame([(0, long), (1, "SLICING:"), (2, "SLICING:1:1-SLICING:z")], "line_no long, value string")
    assert {r.line_no: r.payload for r in traces.payloads(lines).collect()} == {0: "", 2: "1:1-"}


def test_files_are_sorted_in_runs(monkeypatch):
    """Rows in any order come out by line, record and statement, whole lines at a time, with no more than some runs' pieces held."""
    monkeypatch.setattr(ingest, "RUN", 50)
    monkeypatch.setattr(ingest, "PIECE", 4)
    rng = random.Random(3)
    rows = [(line, None, r, s, 1, "m", "i", 1, 1, -1) for line in range(200) for r in range(rng.randrange(1, 4)) for s in range(2)] + [(line, str(line % 3), -1, -1, -1, None, None, -1, -1, -1) for line in range(200)]
    rows += [(77, None, 5, s, 1, "m", "i", 1, 1, -1) for s in range(40)]
    rng.shuffle(rows)
    columns = ingest._HELD.names
    pieces = list(ingest._in_order((pd.DataFrame(rows[k : k + 13], columns=columns) for k in range(0, len(rows), 13)), 9))
    got = [x[:1] + x[2:4] for p in pieces for x in p[columns].itertuples(index=False, name=None)]
    assert got == sorted(x[:1] + x[2:4] for x in rows if x[0] > 9)
    assert max(map(len, pieces)) < 250 and len(pieces) > 5
    assert all(a["line_no"].iloc[-1] < b["line_no"].iloc[0] for a, b in zip(pieces, pieces[1:], strict=False))


def test_runs_are_read_as_they_are_needed(monkeypatch):
    """Rows that come in order, so that each run follows the one before, are not gathered before they go out."""
    monkeypatch.setattr(ingest, "RUN", 50)
    monkeypatch.setattr(ingest, "PIECE", 4)
    rows = pd.DataFrame([(line, str(line), -1, -1, -1, None, None, -1, -1, -1) for line in range(1000)], columns=ingest._HELD.names)
    pieces = list(ingest._in_order((rows[k : k + 25] for k in range(0, 1000, 25)), -1))
    assert [x for p in pieces for x in p["line_no"]] == list(range(1000))
    assert max(map(len, pieces)) < 60


class _State:
    exists, get = False, None

    def update(self, values):
        self.exists, self.get = True, values


def _rows(lines):
    """Rows of (line_no, payload, statements of each record)."""
    own = [(n, hash(p), -1, p, 0, 0, 0, 0) for n, p, _ in lines]
    return pa.Table.from_pylist([dict(zip(ingest._ROWS.names, x, strict=True)) for x in own + [(n, hash(p), i, None, n, i, -1, k) for n, p, ks in lines for i, k in enumerate(ks)]], ingest._ROWS)


def test_packs_of_a_file(monkeypatch):
    """Batches with late lines, lines seen before and lines that come twice: packs give each record the number that a walk line by line gives it."""
    monkeypatch.setattr(ingest, "PACK", 8)
    rng = random.Random(11)
    payloads = {p: [rng.randrange(4) for _ in range(rng.randrange(4))] for p in "abcd"}
    order = [(n, rng.choice("aabcd")) for n in range(300)]
    state, want, got = _State(), [], []
    digest, last, at = None, -1, 0
    for lo in range(0, 300, 60):
        new = sorted({x for x in order[max(lo - 70, 0) : lo + 60] if x[0] >= lo or rng.random() < 0.3} - {x for x in order[lo : lo + 60] if rng.random() < 0.1})
        for n, p in new:
            if n > last:
                if p != digest:
                    for i, k in enumerate(payloads[p]):
                        want.append((at, n, i))
                        at += k
                digest, last = p, n
        packs = []
        for bucket in range(0, 300, 32):
            mine = [(n, p, payloads[p]) for n, p in new if bucket <= n < bucket + 32]
            rows = _rows(mine + mine[::3])
            packs += [b for b in ingest._packs((pa.scalar("f"),), iter(rows.take(rng.sample(range(len(rows)), len(rows))).to_batches(7)))] if mine else []
        rng.shuffle(packs)
        for placed in ingest._place(("f",), (b.to_pandas() for b in packs), state):
            for batch in ingest._open(iter([pa.RecordBatch.from_pandas(placed, preserve_index=False)])):
                got += [(r["start"], r["bb_id"], r["thread_id"]) for r in batch.to_pylist()]
    assert got == want and len(want) > 100 and state.get == (digest, last, at)


def test_a_file_is_no_single_group():
    """The state of a file gets a row for some thousand rows, and long runs of lines are of several buckets."""
    packs = list(ingest._packs((pa.scalar("f"),), iter(_rows([(n, str(n % 7), [2]) for n in range(20_000)]).to_batches(10_000))))
    assert sum(b.num_rows for b in packs) < 30 and sum(sum(b["n"].to_pylist()) for b in packs) == 40_000


def test_numbers_stay_whole(spark, tmp_path):
    """Identifiers beyond 2**53 stay as they are, also beside a record without one, and a line that comes twice in a batch counts once."""
    big = (1 << 53) + 1
    blocks = spark.createDataFrame([(big, "m", 0, "i", big)], "bb_id long, method string, stmt_idx int, instr string, bb_src_line long")
    schema = "file string, line_no long, value string"
    lines = [("a", 0, f"SLICING:{big}:{big}-{big}:x-"), ("a", 0, f"SLICING:{big}:{big}-{big}:x-"), ("a", 70_000, f"SLICING:{big}:7-"), (None, 3, f"SLICING:{big}:{big + 1}-")]
    source, sink, marks = (str(tmp_path / x) for x in ("in", "out", "marks"))
    spark.createDataFrame(lines, schema).coalesce(1).write.parquet(source)
    stream_trace(spark.readStream.schema(schema).parquet(source), blocks, "PERMISSIVE").writeStream.format("parquet").option("path", sink).option("checkpointLocation", marks).trigger(availableNow=True).start().awaitTermination()
    got = sorted(spark.read.parquet(sink).select("file", "pos", "bb_id", "bb_src_line", "thread_id").collect(), key=str)
    assert sorted(map(tuple, got), key=str) == sorted([("a", 0, big, big, big), ("a", 1, big, big, None), ("a", 2, big, big, 7), (None, 0, big, big, big + 1)], key=str)
