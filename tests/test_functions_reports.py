"""Access paths, resolution, library flows, probes, reports, streaming."""

import time

import pytest
from pyspark.sql import functions as F

from tracery.functions import accesspath as ap
from tracery.operators import framework, instrument, resolve
from tracery.sources import reports, rules
from tracery.streaming.frames import count_by_method, read_trace_stream, step, stream_frames


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def path(*names):
    return F.array(*[F.lit(n) for n in names]).cast("array<string>")


def test_paths(spark):
    cases = [
        (ap.starts_with(path("$a", "b"), path("a")), True), (ap.starts_with(path("a"), path("a", "b")), False), (ap.starts_with(path(), path()), True), (ap.starts_with(path("a"), path()), False),
        (ap.is_prefix_of(path("a"), path("a", "b")), True), (ap.is_prefix_of(path("a"), path("a")), False), (ap.has_common_prefix(path("a"), path("$a")), True), (ap.has_common_prefix(path("a"), path("b")), False),
        (ap.after(path("a", "b", "c"), path("a")), ["b", "c"]), (ap.after(path("a"), path("b")), []), (ap.has_after(path("a"), path("a")), False),
        (ap.base_of(path("a", "b")), "a"), (ap.base_of(path()), None), (ap.fields_of(path("a", "b", "c")), ["b", "c"]), (ap.fields_of(path("a")), []), (ap.last_field(path("a")), ""), (ap.last_field(path("a", "f")), "f"),
        (ap.append(path(*"abcdefghi"), path("j", "k")), list("abcdefghij")), (ap.is_clipped(path(*"abcdefghijk")), True), (ap.path_string(path("a", "b"), F.lit(True)), "a.b.*"),
        (ap.same_base(path("$a"), F.lit("a")), True), (ap.same_path(path("a", "$b"), path("$a", "b")), True), (ap.class_index(path("X", "Y"), F.lit("Y")), 1), (ap.class_index(path("X"), F.lit("Y")), -1),
        (ap.clip_from(path("a", "b", "c"), F.lit(1)), ["b", "c"]), (ap.replace_base(path("a", "b"), F.lit("z")), ["z", "b"]), (ap.replace_prefix(path("a", "b"), path("c"), path("z")), None),
        (ap.is_parameter(path("p1"), F.lit(1), F.lit(False)), True), (ap.is_parameter(path("p1"), F.lit(1), F.lit(True)), False), (ap.is_parameter(path("x"), F.lit(1), F.lit(True)), False),
        (ap.is_used_in(F.lit(None), F.lit(3), F.lit(3)), True), (ap.is_empty(path("")), True), (ap.set_add(F.array(path("a")), path("")), [["a"]]), (ap.set_add(F.array(path("a")), path("b")), [["a"], ["b"]]),
        (ap.is_primitive(F.lit("int[][]")), True), (ap.is_primitive(F.lit("A[]")), False), (ap.is_integer(F.lit("12")), True), (ap.is_integer(F.lit("99999999999")), False), (ap.is_integer(F.lit(" 1")), False),
        (ap.first_int(F.lit("a12b3")), 12), (ap.first_int(F.lit("a")), None), (ap.no_common(path("a"), path("T"), path("a"), path("U")), True), (ap.no_common(path("a"), path("T"), path("a"), path("T")), False),
        (ap.single(F.lit("$x"), F.lit("T"))["path"], ["x"]), (ap.make(path(*"abcdefghijk"), path(*"abcdefghijk"))["clipped"], True),
    ]
    got = spark.range(1).select(*[c.alias(f"c{i}") for i, (c, _) in enumerate(cases)]).first()
    for i, (_, want) in enumerate(cases):
        assert got[i] == want, (i, got[i], want)
    with pytest.raises(Exception, match="null type"):
        one(spark, ap.single(F.lit("x"), F.lit(None).cast("string")))


def test_resolution(spark):
    units = [(1, "m", 0, "identity", "x := p", 1), (2, "m", 1, "assign", "a = 1", 10), (3, "m", 2, "assign", "a = 1", 20), (4, "m", 3, "if", "if a > b goto b = 2", 30), (5, "n", 0, "assign", "a = 1", 12), (6, "m", 4, "assign", "alpha = beta", 12)]
    u = spark.createDataFrame(units, "unit_id long, method string, ord int, kind string, unit_str string, src_line int")
    rows = [(0, "m", "a = 1", 14), (1, "m", "a = 1", 15), (2, "m", "a = 2", 19), (3, "m", "if a > b goto c = 3", 29), (4, "m", "zzz", 1), (5, "m", "x := p", 1), (6, "q", "a = 1", 1)]
    got = {r.pos: r.unit_id for r in resolve.resolve(spark.createDataFrame(rows, "pos long, method string, instr string, src_line int"), u).collect()}
    # the tie at line 15 takes the first unit; the changed text takes the nearest; identities match nothing
    assert got == {0: 2, 1: 2, 2: 3, 3: 4}


def test_order_of_nearest_matches(spark):
    """A unit with a nearer text but a farther line does not replace the one before."""
    units = [(1, "m", 0, "assign", "abcx", 10), (2, "m", 1, "assign", "abcd", 50)]
    u = resolve.statement_index(spark.createDataFrame(units, "unit_id long, method string, ord int, kind string, unit_str string, src_line int"))
    rows = spark.createDataFrame([(0, "m", "abcde", 11), (1, "m", "abcde", 49)], "pos long, method string, instr string, src_line int")
    assert {r.pos: r.unit_id for r in resolve.nearest_matches(rows, u).collect()} == {0: 1, 1: 2}


def test_many_units_of_one_text(spark, n=30_000):
    """Rows and units that differ in nothing but their number are compared once, not each with each."""
    ids = spark.range(n)
    units = ids.select(F.col("id").alias("unit_id"), F.lit("m").alias("method"), F.col("id").alias("ord"), F.lit("assign").alias("kind"), F.lit("a = 1").alias("unit_str"), (F.col("id") % 3).cast("int").alias("src_line"))
    rows = ids.select(F.col("id").alias("pos"), F.lit("m").alias("method"), F.lit("a = 2").alias("instr"), (F.col("id") % 3).cast("int").alias("src_line"))
    began = time.time()
    got = resolve.nearest_matches(rows, resolve.statement_index(units)).groupBy("unit_id").count().collect()
    assert sorted(map(tuple, got)) == [(k, n // 3) for k in range(3)]
    assert time.time() - began < 40


def test_partitions_of_forward_taint_follow_what_is_asked(spark, monkeypatch):
    monkeypatch.setattr(framework, "ASKED", 10, raising=False)
    calls = spark.range(400).select(F.col("id").alias("pos"), F.lit("<l: o m(o)>").alias("method_sig"), F.lit("b").alias("base"), F.lit("r").alias("ret"), F.array(F.struct(F.lit("v").alias("name"), F.lit("app.A").alias("type"), F.lit(False).alias("is_constant"))).alias("args"))
    listed = rules.model_rules(spark.createDataFrame([("<l: o m(o)>", "Generate")], "method_sig string, kind string"))
    out = framework.forward_taint(calls, listed, spark.range(400).select(F.col("id").alias("pos"), F.array(F.lit("v")).alias("path")))
    rows = out.select(F.spark_partition_id().alias("p"), "pos").groupBy("p").agg(F.countDistinct("pos").alias("n")).collect()
    assert sum(r.n for r in rows) == 400 and max(r.n for r in rows) < 40


def test_library_flows(spark):
    args = "array<struct<name:string,type:string,is_constant:boolean>>"
    calls = spark.createDataFrame([(1, "<L: O add(O,int)>", "l", "r", [("v", "O", False), ("7", "int", True)]), (2, "<L: void clear()>", "l", None, [])], f"pos long, method_sig string, base string, ret string, args {args}")
    listed = spark.createDataFrame([("<L: O add(O,int)>", "Generate"), ("<L: void clear()>", "Kill")], "method_sig string, kind string")
    table = rules.model_rules(listed)
    asked = spark.createDataFrame([(1, ["v", "f"]), (1, ["l"]), (1, ["q"]), (2, ["l"])], "pos long, path array<string>")
    got = lambda df: sorted(tuple(r) for r in df.collect())
    assert got(framework.forward_taint(calls, table, asked)) == [(1, ["l"]), (1, ["l", "f"]), (1, ["q"]), (1, ["r"]), (1, ["r", "f"]), (1, ["v", "f"])]
    back = spark.createDataFrame([(1, ["r", "f"]), (2, ["l"])], "pos long, path array<string>")
    assert got(framework.backward_taint(calls, table, back)) == [(1, ["l", "f"]), (1, ["v", "f"])]
    assert got(framework.local_definitions(calls, table, asked.where("path[0] = 'l'"))) == [(1, ["l"], []), (1, ["l"], ["v"]), (2, ["l"], [])]
    assert got(framework.defines_receiver(calls, table, asked)) == [(1, ["l"]), (2, ["l"])]
    fields = spark.createDataFrame([("<L: O add(O,int)>", "Summary", "RETURN", None, "", "PARAM", 0, "C T g")], table.schema)
    assert got(framework.backward_taint(calls, fields, back)) == [(1, ["v", "g", "f"])]


def test_probes(spark):
    units = [("m", i, i, k, inv, lib, fr) for i, (k, inv, lib, fr) in enumerate([("identity", False, False, False), ("assign", False, False, True), ("if", False, False, False), ("assign", True, False, False), ("goto", False, False, False), ("identity", False, False, False), ("assign", False, False, True), ("invoke", True, True, False), ("return", False, False, False)])]
    u = spark.createDataFrame(units, "method string, unit_id long, ord int, kind string, has_invoke boolean, in_library boolean, has_field_ref boolean")
    jumps = spark.createDataFrame([(2, 6), (4, 8)], "unit_id long, target long")
    at = lambda df: sorted(r.unit_id for r in df.collect())
    assert at(instrument.probes(u, jumps)) == [1, 3, 4, 6, 8]
    assert at(instrument.probes(u, jumps, field_tracking=True)) == [1, 3, 4, 6, 8]
    assert [r.probe for r in instrument.probe_ids(instrument.probes(u, jumps)).orderBy("unit_id").collect()] == [0, 1, 2, 3, 4]
    assert at(instrument.flush_points(u.withColumn("method_name", F.lit("onDestroy")), ["onDestroy"])) == [1]
    assert one(spark, instrument.payload(F.lit(3), F.lit(1), F.lit(0))) == "3:1" and one(spark, instrument.package_filter(F.lit("a.b-c"))) == ["a.b", "c"]
    sites = spark.createDataFrame([(1, "m", "void start()", "t", "T", None), (2, "m", "boolean post(java.lang.Runnable)", "h", "H", "r"), (3, "m", "boolean post(java.lang.Runnable)", "h", "H", None), (4, "m", "java.lang.Object doPrivileged(java.security.PrivilegedAction)", None, "java.security.AccessController", "a"), (5, "m", "void stop()", "t", "T", None), (6, "m", "void start()", None, "T", None)], "unit_id long, method string, called_subsig string, base string, called_class string, first_arg string")
    assert sorted((r.unit_id, r.receiver, r.kind) for r in instrument.implicit_calls(sites).collect()) == [(1, "t", "THREAD"), (2, "r", "EXECUTOR"), (4, "a", "PRIVILEGED")]


def report_rows(spark):
    rows = [
        (0, 4, "A.java", 14, "print(c)", 1, "void main(A,B)", "app.A", 4, "A.java", 14, "print(c)", "", "data"),
        (1, 2, "A.java", 12, "if a < b goto c = a", 1, "void main(A,B)", "app.A", 3, "A.java", 13, "c = a", "a", "control"),
        (2, 2, "A.java", 12, "if a < b goto c = a", 1, "void main(A,B)", "app.A", 4, "A.java", 14, "print(c)", "c", "data"),
        (3, 0, "A.java", -1, "a, 1", 1, "void main(A,B)", "app.A", 3, "A.java", 13, "c = a", "a", "datacontrol"),
    ]
    return spark.createDataFrame(rows, "seq long, dep_pos long, dep_file string, dep_line int, dep_unit string, dep_thread long, dep_method string, dep_class string, pos long, src_file string, src_line int, src_unit string, path string, kinds string")


def test_reports(spark, tmp_path):
    rows = report_rows(spark)
    lines = lambda df: [r.line for r in df.orderBy("n").collect()]
    assert lines(reports.slice_lines(rows)) == ["A.java:14", "A.java:12", "A.java:-1"]
    assert {r.line for r in reports.source_lines(rows).collect()} == {"A.java:14", "A.java:12"}
    assert lines(reports.dependence_lines(rows)) == [
        "(A.java:-1)  a, 1 <--datacontrol-- A.java:13", "(A.java:12)  if a < b  <--control-- A.java:13", "(A.java:12)  if a < b  <--data:c-- A.java:14", "(A.java:14)  print(c) <--data:-- A.java:14"
    ]
    other = spark.createDataFrame([(99,)], "pos long")
    assert lines(reports.dependence_lines(rows, other))[-1].startswith("(A.java:14)")
    assert lines(reports.raw_lines(rows))[0] == "A.java:14    1    4:print(c)"
    assert lines(reports.csv_lines(rows)) == ["-1, void main(A;B), app.A, print(c), 14, -1, ", "-1, void main(A;B), app.A, if a < b goto c = a, 12, -1, a", "-1, void main(A;B), app.A, a; 1, -1, -1, a"]
    assert {r.dep_pos: r.text for r in reports.dependence_map(rows).collect()} == {4: "start", 2: "data, varaible:c, source:4", 0: "control, no variable, source:3"}
    assert any("style=dashed" in x for x in lines(reports.dot_lines(rows)))
    assert one(spark, reports.line_or_ordinal(F.lit(-1), F.lit(7))) == 7
    reports.write_report(reports.csv_lines(rows), str(tmp_path / "csv"), head=["ID, Method, Class, Line, Source, Var"])
    text = "".join(p.read_text() for p in sorted((tmp_path / "csv").glob("part-*")))
    assert text.splitlines()[0].startswith("ID,") and len(text.splitlines()) == 4


def test_stream_of_frames(spark, tmp_path):
    calls = ["m", "m", "f", "g", "g", "f", "m", "f", "m"]
    rows = [(i, i % 2, m) for i, m in enumerate(c for c in calls for _ in range(2))]
    for k in range(3):
        spark.createDataFrame(rows[6 * k : 6 * k + 6], "pos long, thread_id long, method string").coalesce(1).write.parquet(str(tmp_path / "in" / f"{k}"))
    stream = spark.readStream.schema("pos long, thread_id long, method string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    q = stream_frames(stream).writeStream.format("memory").queryName("frames_out").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r.pos: (r.frame_id, r.caller_pos, r.depth) for r in spark.table("frames_out").collect()}
    want = {}
    for thread in (0, 1):
        state = ([], [], [])
        for pos, t, m in rows:
            if t == thread:
                want[pos] = step(*state, pos, m)
    assert got == want and len(got) == len(rows)


def test_windows_and_lines_of_a_stream(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.txt").write_text("x\nSLICING:1:1-\n")
    q = read_trace_stream(spark, str(tmp_path / "t")).writeStream.format("memory").queryName("lines_out").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r.value for r in spark.table("lines_out").collect()] == ["SLICING:1:1-"]
    spark.createDataFrame([("2024-01-01 00:10:00", "a"), ("2024-01-01 00:50:00", "a"), ("2024-01-01 05:00:00", "b")], "ts string, method string").selectExpr("cast(ts as timestamp) ts", "method").write.parquet(str(tmp_path / "p"))
    stream = spark.readStream.schema("ts timestamp, method string").parquet(str(tmp_path / "p"))
    q = count_by_method(stream).writeStream.outputMode("update").format("memory").queryName("counts_out").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.method, r.n) for r in spark.table("counts_out").collect()) == [("a", 2), ("b", 1)]


def test_statements(spark):
    from tracery.functions import statements as st

    lit = F.lit
    none = lit(None).cast("string")
    cases = [
        (st.is_return(lit("return_void")), True), (st.is_assign(lit("if")), False), (st.has_invoke(none), False), (st.kept_field(lit("assign"), lit(True), lit(5)), 5), (st.kept_field(lit("if"), lit(True), lit(5)), None),
        (st.statement_key(lit(3), lit("void m()"), lit("K"), lit("a = 1"), lit(None).cast("long"), lit(2), lit(9), lit("K.java")), "3, void m(), K, a = 1, :THREAD:2, :LINENO:9, :FILE:K.java"),
        (st.is_after(lit(1), lit(2), lit("<clinit>")), True), (st.is_after(lit(1), lit(2), lit("m")), False), (st.may_set(lit("setX")), True), (st.may_set(none), False),
        (st.is_android(lit("android.support.v4.X"), none), True), (st.is_android(lit("app.X"), lit("mContext")), True), (st.is_android(lit("app.X"), none), False), (st.matching_type(F.array(path("A"), path("B")), lit("B")), True),
    ]
    got = spark.range(1).select(*[c.alias(f"c{i}") for i, (c, _) in enumerate(cases)]).first()
    assert [got[i] for i in range(len(cases))] == [w for _, w in cases]
    units = spark.createDataFrame([(1, "if", None), (2, "invoke", "f")], "unit_id long, kind string, called_sig string")
    assert {r.unit_id: r.called_sig for r in st.call_of(units, spark.createDataFrame([(1, 2)], "unit_id long, target long")).collect()} == {1: "f", 2: "f"}
    params = spark.createDataFrame([("m", "r0"), ("m", "p")], "method string, local string")
    assert st.parameter_locals(spark.createDataFrame([("m", ["p", "f"]), ("m", ["q"])], "method string, path array<string>"), params).count() == 1
