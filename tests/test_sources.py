"""Reading, decoding and encoding traces; dictionaries; rules."""

import base64
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tracery.sources import rules, traces


def packed(text):
    return "SLICING: ZLIB: " + base64.b64encode(zlib.compress(text.encode())).decode()


RAW = [
    "application output", "SLICING:1:1-2:1-3:1:7711-", packed("4:1-5:2-"), packed("4:1-5:2-"), "x SLICING:abc:1-6:1- SLICING:9:9-", "SLICING: 9:1-",
    "SLICING: ZLIB: !!notbase64", "SLICING:", "SLICING:8:3", "no mark 1:1", "SLICING:8:3",
]


def frame(spark, lines):
    return spark.createDataFrame(list(enumerate(lines)), "line_no long, value string")


def test_records_of_a_raw_trace(spark):
    got = [(r.line_no, r.bb_id, r.thread_id, r.field_id) for r in traces.records(frame(spark, RAW)).orderBy("line_no", "rec_idx").collect()]
    # the third line repeats the second; the last repeats the marked line before it
    assert got == [(1, 1, 1, -1), (1, 2, 1, -1), (1, 3, 1, 7711), (2, 4, 1, -1), (2, 5, 2, -1), (4, 6, 1, -1), (8, 8, 3, -1)]


def test_bad_records(spark):
    bad = frame(spark, ["SLICING:7-8:1-", "SLICING:7:x-"])
    with pytest.raises(Exception, match="bad record"):
        traces.records(bad).collect()
    got = [(r.bb_id, r.corrupt) for r in traces.records(bad, mode="PERMISSIVE").orderBy("line_no", "rec_idx").collect()]
    assert got == [(7, "7"), (8, None), (7, "7:x")]


def test_broken_stream_keeps_what_can_be_read(spark):
    whole = zlib.compress(b"1:1-" * 5000)
    out = traces._inflate(__import__("pyarrow").array([base64.b64encode(whole).decode(), "%%", None]))
    assert out.to_pylist() == ["1:1-" * 5000, "", ""]


@pytest.mark.parametrize("n", [0, 1, 1024, 1025, 3000])
@pytest.mark.parametrize("pack", [True, False])
def test_round_trip(spark, n, pack):
    rng = random.Random(n)
    rows = [(i, rng.randint(1, 9), rng.randint(1, 3), rng.choice([0, 5, 77])) for i in range(n)]
    df = spark.createDataFrame(rows, "pos long, bb_id long, thread_id long, field_id int")
    lines = traces.encode(df, packed=pack)
    got = [(r.bb_id, r.thread_id, max(r.field_id, 0)) for r in traces.records(lines).orderBy("line_no", "rec_idx").collect()]
    assert got == [r[1:] for r in rows]
    assert lines.count() == (n + 1023) // 1024


def test_lines_of_a_split_file(spark, tmp_path):
    path = tmp_path / "trace.txt"
    path.write_text("".join(f"line {i} {'x' * (i % 90)}\n" for i in range(5000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = traces.read_lines(spark, str(path)).orderBy("line_no").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [r.line_no for r in rows] == list(range(5000))
    assert [r.value.split()[1] for r in rows] == [str(i) for i in range(5000)]


def test_dictionary_and_expansion(spark):
    text = '{"<A: void main()>": {"1": ["a = 1", 10, "b = 2", 11], "2": ["if a < b goto c = a", 12]}, "<A: int f(int)>": {"3": ["x = p + 1", 20, "return x", 21]}}'
    blocks = traces.block_dictionary(spark.createDataFrame([(text,)], "value string"))
    assert sorted((r.bb_id, r.stmt_idx, r.instr, r.bb_src_line) for r in blocks.collect()) == [
        (1, 0, "a = 1", 10), (1, 1, "b = 2", 10), (2, 0, "if a < b goto c = a", 12), (3, 0, "x = p + 1", 20), (3, 1, "return x", 20)
    ]
    recs = traces.records(frame(spark, ["SLICING:3:1-1:2-99:1-", "SLICING:2:1-"]))
    rows = traces.expand(recs, blocks, size=1).orderBy("pos").collect()
    assert [(r.pos, r.bb_id, r.instr, r.thread_id) for r in rows] == [(0, 3, "x = p + 1", 1), (1, 3, "return x", 1), (2, 1, "a = 1", 2), (3, 1, "b = 2", 2), (4, 2, "if a < b goto c = a", 1)]


def test_goto_placeholders(spark):
    rows = [(1, "m", 0, 'goto tmpString = "2"', 1), (2, "m", 0, 'goto tmpString = "3"', 1), (3, "m", 0, "x = $y", 1)]
    out = traces.resolve_gotos(spark.createDataFrame(rows, "bb_id long, method string, stmt_idx int, instr string, bb_src_line long"))
    assert {r.bb_id: r.instr for r in out.collect()} == {1: "goto goto x = $y", 2: "goto x = $y", 3: "x = $y"}


def test_repeated_windows(spark):
    values = list("ababababcdcdee")
    df = spark.createDataFrame(list(enumerate(values)), "pos long, v string")
    for size in (1, 1 << 17):
        got = "".join(r.v for r in traces.without_repeated_windows(df, "pos", ["v"], 2, size=size).orderBy("pos").collect())
        assert got == "abcdee"
    assert traces.without_repeated_windows(df, "pos", ["v"], 4).count() == 10


def test_rule_file_and_models(spark, tmp_path):
    path = tmp_path / "rules.txt"
    path.write_text("% comment\n^java.lang.*\n\n<L: boolean add(O)>\n~<O: int hashCode()>\n-<L: void clear()>\n")
    listed = rules.read_rule_file(spark, str(path))
    assert sorted((r.method_sig, r.kind) for r in listed.collect()) == [("<L: boolean add(O)>", "Generate"), ("<L: void clear()>", "Kill"), ("<O: int hashCode()>", "Exclude")]
    wanted = spark.createDataFrame([("<L: boolean add(O)>",), ("<O: int hashCode()>",), ("<X: void set(A,B)>",), ("<X: A get()>",)], "method_sig string")
    got = {}
    for r in rules.rules_for(wanted, listed=listed).collect():
        left = r.left_idx if r.left_type == "PARAM" else r.left_type
        right = r.right_idx if r.right_type == "PARAM" else r.right_type
        got.setdefault(r.method_sig, set()).add((left, right))
    assert got["<L: boolean add(O)>"] == {("RETURN", "INSTANCE"), ("INSTANCE", 0), ("RETURN", 0), (0, 0)}
    assert got["<O: int hashCode()>"] == {("INSTANCE", "INSTANCE"), ("RETURN", "CLEAR"), (0, 0)}
    assert got["<X: void set(A,B)>"] == {("RETURN", "INSTANCE"), ("INSTANCE", "INSTANCE"), *((x, i) for i in (0, 1) for x in ("RETURN", "INSTANCE", i))}
    assert got["<X: A get()>"] == {("RETURN", "INSTANCE")}


def test_summaries(spark, tmp_path):
    (tmp_path / "java.util.List.xml").write_text(
        """<summary><methods>
 <method id="java.lang.Object get(int)"><flows><flow>
   <from sourceSinkType="Field" AccessPath="[java.util.List java.lang.Object elems]"/>
   <to sourceSinkType="Return"/></flow><flow><from sourceSinkType="Parameter" ParameterIndex="0"/><to sourceSinkType="Parameter" ParameterIndex="1"/></flow></flows></method>
 <method id="void clear()"><clears><clear sourceSinkType="Field" AccessPath=""/></clears><flows><flow><from sourceSinkType="Field"/><to sourceSinkType="Return"/></flow></flows></method>
</methods></summary>"""
    )
    got = sorted((r.method_sig, r.left_type, r.left_idx, r.right_type, r.right_idx, r.right_path) for r in rules.read_summaries(spark, str(tmp_path)).collect())
    get, clear = "<java.util.List: java.lang.Object get(int)>", "<java.util.List: void clear()>"
    assert got == [(get, "PARAM", 1, "PARAM", 0, ""), (get, "RETURN", None, "INSTANCE", None, "java.util.List java.lang.Object elems"), (clear, "INSTANCE", None, "CLEAR", None, "")]
    called = spark.createDataFrame([(get,), (clear,)], "method_sig string")
    out = rules.rules_for(called, summaries=rules.read_summaries(spark, str(tmp_path)))
    assert {r.kind for r in out.collect()} == {"Summary"}


def test_payload_of_first_mark_only(spark):
    got = traces.marked_payloads(frame(spark, ["SLICING:aSLICING:b", "SLICING:SLICING:b"])).select(F.collect_list("payload")).first()[0]
    assert sorted(got) == ["", "a"]


def test_summaries_written_and_read_back(spark, tmp_path):
    rows = [
        ("<a.B: void <init>(a.C)>", "INSTANCE", None, "a.B a.C f", "PARAM", 0, ""), ("<a.B: a.C get()>", "RETURN", None, "", "INSTANCE", None, "a.B a.C f"),
        ("<a.D$E: void clear()>", "INSTANCE", None, "", "CLEAR", None, ""), ("<a.D$E: void put(a.C)>", "PARAM", 0, "", "RETURN", None, ""),
    ]
    columns = "method_sig string, left_type string, left_idx int, left_path string, right_type string, right_idx int, right_path string"
    rules.write_summaries(spark.createDataFrame(rows, columns), str(tmp_path / "s"))
    assert sorted(tuple(r)[:1] + tuple(r)[2:] for r in rules.read_summaries(spark, str(tmp_path / "s")).collect()) == sorted(rows)
