"""Data-flow rules of library methods: from a rule file, from XML summaries, or by default.

A rule says that a left variable gets its value from a right one.  Columns:
method_sig, kind, left_type, left_idx, left_path, right_type, right_idx, right_path;
types are INSTANCE, PARAM, RETURN and CLEAR, and an index is null unless PARAM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = ["method_sig", "kind", "left_type", "left_idx", "left_path", "right_type", "right_idx", "right_path"]

#: kind: (left, right) for the receiver and the return value, then for each argument; ARG is that argument.
MODELS = {
    "Exclude": ([("INSTANCE", "INSTANCE"), ("RETURN", "CLEAR")], [("ARG", "ARG")]),
    "Kill": ([("INSTANCE", "CLEAR"), ("RETURN", "CLEAR")], [("ARG", "CLEAR")]),
    "Generate": ([("RETURN", "INSTANCE")], [("INSTANCE", "ARG"), ("RETURN", "ARG"), ("ARG", "ARG")]),
    "Default": ([("RETURN", "INSTANCE")], [("RETURN", "ARG"), ("ARG", "ARG")]),
    "DefaultVoid": ([("RETURN", "INSTANCE"), ("INSTANCE", "INSTANCE")], [("RETURN", "ARG"), ("ARG", "ARG"), ("INSTANCE", "ARG")]),
}


def read_rule_file(spark: SparkSession, path: str) -> DataFrame:
    """(method_sig, kind) of a rule file: % and ^ begin comments, ~ excludes, - kills, all else generates."""
    mark = F.substring("value", 1, 1)
    lines = spark.read.text(path).where((F.col("value") != "") & ~mark.isin("%", "^"))
    kind = F.when(mark == "~", "Exclude").when(mark == "-", "Kill").otherwise("Generate")
    return lines.select(F.when(mark.isin("~", "-"), F.expr("substring(value, 2)")).otherwise(F.col("value")).alias("method_sig"), kind.alias("kind"))


def arity(sig: Column, kind: Column) -> Column:
    """Arguments of a signature: commas and one, none for ``()``, except that Exclude counts one there."""
    commas = F.size(F.split(sig, ",", -1))
    return F.when(sig.contains("()") & (kind != "Exclude"), 0).otherwise(commas)


def model_rules(methods: DataFrame) -> DataFrame:
    """Rules of (method_sig, kind); kind Default depends on whether the method returns a value."""
    void = F.get(F.split("method_sig", r"\s+"), F.lit(1)) == "void"
    model = F.when((F.col("kind") == "Default") & void, "DefaultVoid").otherwise(F.col("kind"))
    pair = "array<struct<l:string,r:string>>"

    def chosen(which: int) -> Column:
        out = F.array().cast(pair)
        for name, parts in MODELS.items():
            pairs = F.array(*[F.struct(F.lit(a).alias("l"), F.lit(b).alias("r")) for a, b in parts[which]])
            out = F.when(model == name, pairs).otherwise(out)
        return out

    base = methods.select("method_sig", "kind", chosen(0).alias("own"), chosen(1).alias("each"), arity(F.col("method_sig"), F.col("kind")).alias("n"))
    own = base.select("method_sig", "kind", F.explode("own").alias("p"), F.lit(None).cast("int").alias("i"))
    args = base.where("n > 0").select("method_sig", "kind", "each", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
    args = args.select("method_sig", "kind", F.explode("each").alias("p"), "i")

    def side(name: str) -> list[Column]:
        arg = F.col(f"p.{name}") == "ARG"
        return [F.when(arg, "PARAM").otherwise(F.col(f"p.{name}")), F.when(arg, F.col("i"))]

    (lt, li), (rt, ri) = side("l"), side("r")
    path = F.lit("")
    return own.unionByName(args).select(
        "method_sig", "kind", lt.alias("left_type"), li.cast("int").alias("left_idx"), path.alias("left_path"), rt.alias("right_type"), ri.cast("int").alias("right_idx"), path.alias("right_path")
    )


_END = "struct<_sourceSinkType:string,_AccessPath:string,_ParameterIndex:string>"
_SUMMARY = f"_id string, flows struct<flow:array<struct<`from`:{_END},`to`:{_END}>>>, clears struct<clear:array<{_END}>>"


def read_summaries(spark: SparkSession, path: str) -> DataFrame:
    """Rules of XML summaries, a file (or a folder of them) for each class named after it; a method's clears win over its flows."""
    raw = spark.read.format("xml").option("rowTag", "method").schema(_SUMMARY).load(path)
    class_ = F.regexp_extract(F.input_file_name(), r"([^/=]+)\.xml(?:/[^/]*)?$", 1)
    methods = raw.select(F.concat(F.lit("<"), class_, F.lit(": "), F.col("_id"), F.lit(">")).alias("method_sig"), "flows", "clears")

    def end(c: str) -> tuple[Column, Column, Column]:
        kind = F.col(f"{c}._sourceSinkType")
        index = F.col(f"{c}._ParameterIndex").try_cast("int")
        type_ = F.when(kind == "Return", "RETURN").when(kind == "Parameter", "PARAM").otherwise("INSTANCE")
        return type_, F.when(type_ == "PARAM", index), F.coalesce(F.regexp_replace(F.col(f"{c}._AccessPath"), r"^\[|\]$", ""), F.lit(""))

    clears = methods.where("size(clears.clear) > 0").select("method_sig", F.explode("clears.clear").alias("x"))
    lt, li, lp = end("x")
    cleared = clears.select("method_sig", F.lit("Summary").alias("kind"), lt.alias("left_type"), li.alias("left_idx"), lp.alias("left_path"), F.lit("CLEAR").alias("right_type"), F.lit(None).cast("int").alias("right_idx"), F.lit("").alias("right_path"))
    flows = methods.where("coalesce(size(clears.clear), 0) <= 0").select("method_sig", F.explode("flows.flow").alias("f"))
    (lt, li, lp), (rt, ri, rp) = end("f.to"), end("f.from")
    flowing = flows.select("method_sig", F.lit("Summary").alias("kind"), lt.alias("left_type"), li.alias("left_idx"), lp.alias("left_path"), rt.alias("right_type"), ri.alias("right_idx"), rp.alias("right_path"))
    return cleared.unionByName(flowing)


def write_summaries(model: DataFrame, path: str) -> None:
    """Write rules (as :func:`read_summaries` gives them, without kind) as XML, a folder for each class.

    Signatures have to be ``<class: method>``.  A rule with CLEAR on its right is a clear.
    """
    kinds = {"RETURN": "Return", "PARAM": "Parameter"}
    plain = lambda c: F.replace(F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))

    def end(tag: str, side: str) -> Column:
        kind = F.col(f"{side}_type")
        named = F.when(kind == "RETURN", kinds["RETURN"]).when(kind == "PARAM", kinds["PARAM"]).otherwise("Field")
        index = F.when(F.col(f"{side}_idx").isNotNull(), F.concat(F.lit(' ParameterIndex="'), F.col(f"{side}_idx").cast("string"), F.lit('"'))).otherwise("")
        return F.concat(F.lit(f'<{tag} sourceSinkType="'), named, F.lit('"'), index, F.lit(' AccessPath="'), F.when(F.col(f"{side}_path") != "", F.concat(F.lit("["), plain(F.col(f"{side}_path")), F.lit("]"))).otherwise(""), F.lit('"/>'))

    parts = model.select(
        F.regexp_extract("method_sig", r"^<([^:]*): ", 1).alias("class"), F.regexp_extract("method_sig", r"^<[^:]*: (.*)>$", 1).alias("method"),
        F.when(F.col("right_type") == "CLEAR", end("clear", "left")).alias("clear"), F.when(F.col("right_type") != "CLEAR", F.concat(F.lit("<flow>"), end("from", "right"), end("to", "left"), F.lit("</flow>"))).alias("flow"),
    )
    each = parts.groupBy("class", "method").agg(F.array_join(F.array_sort(F.collect_list("clear")), "").alias("clears"), F.array_join(F.array_sort(F.collect_list("flow")), "").alias("flows"))
    wrapped = lambda tag: F.when(F.col(tag) != "", F.concat(F.lit(f"<{tag}>"), F.col(tag), F.lit(f"</{tag}>"))).otherwise("")
    body = F.concat(F.lit('<method id="'), plain(F.col("method")), F.lit('">'), wrapped("clears"), wrapped("flows"), F.lit("</method>"))
    # a class has as many methods as its code
    whole = each.groupBy("class").agg(F.array_join(F.array_sort(F.collect_list(body)), "").alias("all"))
    whole.select(F.concat("class", F.lit(".xml")).alias("file"), F.concat(F.lit("<summary><methods>"), "all", F.lit("</methods></summary>")).alias("value")).repartition("file").write.partitionBy("file").text(path)


def rules_for(signatures: DataFrame, summaries: DataFrame | None = None, listed: DataFrame | None = None) -> DataFrame:
    """Rules of every called signature: from its summary, else from the rule file, else by default."""
    wanted = signatures.select("method_sig").distinct()
    parts = []
    if summaries is not None:
        parts.append(summaries.join(wanted, "method_sig", "left_semi").select(*COLUMNS))
        wanted = wanted.join(summaries.select("method_sig").distinct(), "method_sig", "left_anti")
    if listed is not None:
        parts.append(model_rules(listed.join(wanted, "method_sig", "left_semi")).select(*COLUMNS))
        wanted = wanted.join(listed.select("method_sig").distinct(), "method_sig", "left_anti")
    out = model_rules(wanted.withColumn("kind", F.lit("Default"))).select(*COLUMNS)
    for p in parts:
        out = out.unionByName(p)
    return out
