"""Chat formatting with tool-call linking; DataFrame functions only.

Messages are rows (conversation, turn, role, text). An assistant text that is a JSON
object with ``tool_calls`` holds calls {id, name, arguments}; a ``tool`` message is a
JSON object {tool_call_id, content}. Any other text is plain content.

1. Calls are numbered within (conversation, identifier) in turn order; a result has the
   number of the last call before it. Both are hash-joined by (conversation, identifier,
   number), and a call takes the first result it meets.
2. Order. Messages keep their turns, which puts a result after its call. A message with
   a call that cites ``${id}`` stands after that call's result (or, unanswered, after its
   message); where the cited one comes later, the citing message moves: ``place`` is the
   turn from which it may stand, and ``rank`` tells those of one place apart. Inside a
   message calls are sorted by the longest chain of calls they cite there. The members of
   a cycle, of messages or of calls inside one, are marked and keep their order in it.
   Where an identifier is used again, the first call that has it is cited: in the
   citing message if there is one, else in the conversation.
3. Arguments are checked against the tools that the conversation declares: a ``system``
   text that is a JSON object with ``tools``, {name, parameters} or {function: {name,
   parameters}}, where parameters is a JSON schema with ``required`` and ``properties``.
   The last declaration of the name before the call holds. Where there is none, a table
   of schemas (name, required, types) does. A declaration stays plain content.
4. Every message becomes one line of canonical JSON: keys sorted, no blanks.

One row per message leaves, so a conversation of any length is never gathered; its
text is the lines in order of (place, rank, turn).

Defined results: null texts are empty contents, null roles the role ``unknown``;
broken JSON is plain content; a call without an id is linked
to nothing by it but kept; rows of a null conversation are one conversation; repeated
messages give a row each; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, LongType, StructField, StructType

from parley.llm.store import Staged, new_path


def canonical(value: Column) -> Column:
    """A variant as JSON with sorted keys and no blanks."""
    return F.to_json(value)


def _field(v: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(v, path, kind)


def parse(messages: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows (row, conv_id, turn, role, content, calls, answers): calls as an array of variants."""
    own = messages.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(conv_id).alias("conv_id"),
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit("unknown")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    json = F.when(F.ltrim("text").startswith("{") & F.col("role").isin("assistant", "tool"), F.try_parse_json("text"))
    own = own.withColumn("_v", json)
    calls = F.when(F.col("role") == "assistant", F.filter(_field(F.col("_v"), "$.tool_calls", "array<variant>"), lambda c: c.isNotNull()))
    answers = F.when(F.col("role") == "tool", _field(F.col("_v"), "$.tool_call_id", "string"))
    content = F.when(calls.isNotNull() | answers.isNotNull(), F.coalesce(_field(F.col("_v"), "$.content", "string"), F.lit(""))).otherwise(F.col("text"))
    return own.select("row", "conv_id", "turn", "role", content.alias("content"), calls.alias("calls"), answers.alias("answers"))


def calls_of(parsed: DataFrame) -> DataFrame:
    """Rows (row, conv_id, turn, part, call, name, arguments, cites)."""
    each = parsed.where(F.col("calls").isNotNull()).select("row", "conv_id", "turn", F.posexplode("calls").alias("part", "c"))
    raw = _field(F.col("c"), "$.arguments", "variant")
    text = F.coalesce(F.try_parse_json(F.try_variant_get(raw, "$", "string")), raw)  # arguments may be JSON inside a string
    each = each.select("row", "conv_id", "turn", "part", _field(F.col("c"), "$.id", "string").alias("call"), _field(F.col("c"), "$.name", "string").alias("name"), text.alias("arguments"))
    return each.withColumn("cites", F.array_distinct(F.coalesce(F.regexp_extract_all(canonical(F.col("arguments")), F.lit(r"\$\{([A-Za-z0-9_.:-]+)\}"), F.lit(1)), F.array().cast("array<string>"))))


def declared(messages: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows (conv_id, turn, name, required, types): the tools that system messages declare."""
    own = messages.where((F.col(role) == "system") & F.ltrim(F.col(text)).startswith("{")).select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.try_parse_json(text).alias("v"))
    each = own.select("conv_id", "turn", F.posexplode(_field(F.col("v"), "$.tools", "array<variant>")).alias("part", "t"))
    tool = F.coalesce(_field(F.col("t"), "$.function", "variant"), F.col("t"))
    each = each.withColumn("tool", tool).select("conv_id", "turn", "part", _field(F.col("tool"), "$.name", "string").alias("name"), _field(F.col("tool"), "$.parameters", "variant").alias("p"))
    kinds = F.transform_values(_field(F.col("p"), "$.properties", "map<string,variant>"), lambda _, v: _field(v, "$.type", "string"))
    each = each.where(F.col("name").isNotNull()).select("conv_id", "turn", "part", "name", _field(F.col("p"), "$.required", "array<string>").alias("required"), F.map_filter(kinds, lambda _, kind: kind.isNotNull()).alias("types"))
    # of a turn's declarations of one name the last holds; those of repeated messages are ordered by what they say
    last = F.max(F.struct("part", "required", F.array_sort(F.map_entries("types")).alias("types"))).alias("d")
    return each.groupBy("conv_id", "turn", "name").agg(last).select("conv_id", "turn", "name", "d.required", F.map_from_entries("d.types").alias("types"))


def rules_of(calls: DataFrame, tools: DataFrame) -> DataFrame:
    """Rows (row, part, own): what each call's conversation last declared of its name before it, if anything."""
    tools = tools.select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.col("name").alias("n"), F.struct("required", F.map_entries("types").alias("types")).alias("d"))
    met = calls.join(tools, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("name") == F.col("n")) & (F.col("t") <= F.col("turn")))
    own = met.groupBy("row", "part").agg(F.max_by("d", "t").alias("d"))
    return own.select("row", "part", F.struct("d.required", F.map_from_entries("d.types").alias("types")).alias("own"))


def _number(both: DataFrame) -> DataFrame:
    """``both`` with ``number``: the calls of the row's (conversation, identifier) up to it, in turn order.

    Rows are sorted in ranges over the whole table, and each range counts on from the
    counts of those before it, so that an identifier that is used over and over is many tasks.
    """
    order = ["conv_id", "call", "turn", "is_call", "row", "part"]
    ranges = both.repartitionByRange(*order).withColumn("range", F.spark_partition_id())
    ranges = Staged(both.sparkSession, ranges, "ranges").df
    own = ranges.withColumn("here", F.sum("is_call").over(Window.partitionBy("range", "conv_id", "call").orderBy("turn", "is_call", "row", "part")))
    sums = ranges.groupBy("conv_id", "call", "range").agg(F.sum("is_call").alias("n"))  # a row a range that an identifier is in
    before = sums.withColumn("before", F.sum("n").over(Window.partitionBy("conv_id", "call").orderBy("range")) - F.col("n"))
    before = before.where("before > 0").select(F.col("conv_id").alias("c"), F.col("call").alias("i"), F.col("range").alias("r"), "before")
    met = own.join(before, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("call") == F.col("i")) & (F.col("range") == F.col("r")), "left")
    return met.select("conv_id", "call", "turn", "row", "part", "is_call", (F.col("here") + F.coalesce("before", F.lit(0))).alias("number"))


def link(calls: DataFrame, parsed: DataFrame) -> DataFrame:
    """Rows (row, part, result_row, result_turn): each call's first result, where a result belongs to the last call before it."""
    own = calls.where(F.col("call").isNotNull()).select("conv_id", "call", "turn", "row", "part", F.lit(1).alias("is_call"))
    results = parsed.where(F.col("answers").isNotNull()).select("conv_id", F.col("answers").alias("call"), "turn", "row", F.lit(0).alias("part"), F.lit(0).alias("is_call"))
    numbered = Staged(calls.sparkSession, _number(own.unionByName(results)), "numbered").df
    first = numbered.where("is_call = 0 and number > 0").groupBy("conv_id", "call", "number").agg(F.min(F.struct("turn", "row")).alias("r"))
    first = first.select(F.col("conv_id").alias("c"), F.col("call").alias("i"), F.col("number").alias("n"), "r")
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("call") == F.col("i")) & (F.col("number") == F.col("n"))
    return numbered.where("is_call = 1").join(first, same).select("row", "part", F.col("r.row").alias("result_row"), F.col("r.turn").alias("result_turn"))


def _at(values: Column, index: Column) -> Column:
    return F.get(values, index)


def inner_order(calls: DataFrame) -> DataFrame:
    """Rows (row, part, depth, cycle) of the messages in which a call cites another one of the same message.

    A message's calls were one row of the table and are one row again here.
    """
    packed = calls.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("part", "call", "cites"))).alias("c"), F.count_if(F.size("cites") > 0).alias("citing")).where("citing > 0")
    ids, n = F.transform("c", lambda x: F.coalesce(x["call"], F.lit(""))), F.size("c")
    links = F.transform("c", lambda x: F.filter(F.transform(x["cites"], lambda i: (F.array_position(ids, i) - 1).cast("int")), lambda j: j >= 0))
    found = packed.select("row", F.transform("c", lambda x: x["part"]).alias("parts"), links.alias("links"), n.alias("n")).where(F.exists("links", lambda x: F.size(x) > 0))
    # all that a call reaches, by squaring
    rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.col("n") + 1)).cast("int"))
    reach = F.aggregate(rounds, F.col("links"), lambda r, _: F.transform(r, lambda own: F.array_distinct(F.concat(own, F.flatten(F.transform(own, lambda j: _at(r, j)))))))
    found = found.withColumn("reach", reach)
    home = F.transform("reach", lambda own, i: F.least(i, F.coalesce(F.array_min(F.filter(own, lambda j: F.array_contains(_at(F.col("reach"), j), i))), i)))
    found = found.withColumn("home", home)
    # citations between cycles, each taken as its first call
    outer = F.transform("home", lambda h, i: F.when(h == i, F.array_distinct(F.filter(F.flatten(F.transform(F.filter(F.sequence(F.lit(0), F.col("n") - 1), lambda k: _at(F.col("home"), k) == i), lambda k: F.transform(_at(F.col("links"), k), lambda j: _at(F.col("home"), j)))), lambda j: j != i))).otherwise(F.array().cast("array<int>")))
    found = found.withColumn("outer", outer)
    zero = F.transform("links", lambda _: F.lit(0))
    depth = F.aggregate(F.sequence(F.lit(1), F.col("n")), zero, lambda d, _: F.transform("outer", lambda own: F.coalesce(F.array_max(F.transform(own, lambda j: _at(d, j) + 1)), F.lit(0))))
    found = found.withColumn("depth", depth)
    each = F.transform("parts", lambda p, i: F.struct(p.alias("part"), _at(F.col("depth"), _at(F.col("home"), i)).alias("depth"), F.array_contains(_at(F.col("reach"), i), i).alias("cycle")))
    return found.select("row", F.inline(each))


def _on_cycles(edges: DataFrame) -> DataFrame:
    """``edges`` less those at nodes that cite none or that none cites, for one round."""
    citing, cited = edges.select(F.col("node").alias("cited")).distinct(), edges.select(F.col("cited").alias("node")).distinct()
    return edges.join(citing, "cited", "left_semi").join(cited, "node", "left_semi").select("node", "cited")


def cycles(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """Rows (node, home) of every node on a cycle of ``edges`` (node, cited): its strong component's largest node.

    The largest node that reaches a node colours it; what a colour's own node is reached
    from within its colour is one component. Found components leave, until no edge is left.
    """
    kind = edges.schema["node"].dataType
    schema = StructType([StructField("node", kind), StructField("home", kind)])
    path = new_path(spark, "cycles")
    spark.createDataFrame([], schema).write.parquet(path)
    left = Staged(spark, edges, "circling")
    n = left.df.count()
    while n:
        rest = Staged(spark, _on_cycles(left.df), "circling")
        left.drop()
        left, n, before = rest, rest.df.count(), n
        if n != before:
            continue
        colour = Staged(spark, left.df.select("node").distinct().withColumn("colour", F.col("node")).withColumn("new", F.lit(True)), "colours")
        while not colour.df.where("new").isEmpty():
            source = colour.df.select(F.col("node").alias("cited"), F.col("colour").alias("c"))
            best = left.df.join(source, "cited").groupBy("node").agg(F.max("c").alias("best"))
            grown = colour.df.join(best, "node").select("node", F.greatest("colour", "best").alias("to"), "colour")
            new = Staged(spark, grown.select("node", F.col("to").alias("colour"), (F.col("to") > F.col("colour")).alias("new")), "colours")
            colour.drop()
            colour = new
        ends = colour.df.select("node", "colour")
        same = left.df.join(ends, "node").join(ends.select(F.col("node").alias("cited"), F.col("colour").alias("c")), "cited").where(F.col("c") == F.col("colour"))
        same = Staged(spark, same.select("node", "cited"), "inner")
        member = Staged(spark, ends.where(F.col("node") == F.col("colour")), "members")
        size, old = member.df.count(), 0
        while size != old:
            more = same.df.join(member.df, "node").select(F.col("cited").alias("node"), "colour")
            new = Staged(spark, member.df.union(more).distinct(), "members")
            member.drop()
            member, size, old = new, new.df.count(), size
        own = same.df.join(member.df, "node").select("node", F.col("colour").alias("home")).distinct()
        own.where(F.col("node") != F.col("home")).union(_looped(own, same.df)).distinct().write.mode("append").parquet(path)
        gone = member.df.select("node")
        rest = left.df.join(gone, "node", "left_anti").join(gone.withColumnRenamed("node", "cited"), "cited", "left_anti").select("node", "cited")
        rest = Staged(spark, rest, "circling")
        for old_table in (left, colour, same, member):
            old_table.drop()
        left, n = rest, rest.df.count()
    return spark.read.schema(schema).parquet(path)


def _looped(own: DataFrame, edges: DataFrame) -> DataFrame:
    """Of ``own``, components' largest nodes that others share or that cite themselves."""
    shared = own.where(F.col("node") != F.col("home")).select("home")
    itself = edges.where(F.col("node") == F.col("cited")).select(F.col("node").alias("home"))
    return own.where(F.col("node") == F.col("home")).join(shared.union(itself).distinct(), "home", "left_semi").select("node", "home")


def citations(calls: DataFrame, linked: DataFrame) -> DataFrame:
    """Rows (conv_id, node, node_turn, cited, cited_turn): the message of a call that cites one of another message, and what it must follow."""
    first = F.min(F.struct("turn", "row", "part"))
    named = calls.where(F.col("call").isNotNull())
    anywhere = named.groupBy("conv_id", "call").agg(first.alias("n")).select(F.col("conv_id").alias("c"), F.col("call").alias("i"), F.col("n.row").alias("at"), F.col("n.part").alias("at_part"), F.col("n.turn").alias("at_turn"))
    here = named.select(F.col("row").alias("own_row"), F.col("call").alias("own_call")).distinct()
    cites = calls.select("conv_id", F.col("row").alias("node"), F.col("turn").alias("node_turn"), F.explode("cites").alias("cited_id")).distinct()
    cites = cites.join(here, (F.col("node") == F.col("own_row")) & (F.col("cited_id") == F.col("own_call")), "left_anti")
    met = cites.join(anywhere, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("cited_id") == F.col("i")))
    met = met.join(linked.select(F.col("row").alias("at"), F.col("part").alias("at_part"), "result_row", "result_turn"), ["at", "at_part"], "left")
    return met.select("conv_id", "node", "node_turn", F.coalesce("result_row", "at").alias("cited"), F.coalesce("result_turn", "at_turn").alias("cited_turn")).where("node <> cited").distinct()


def places(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """Rows (row, place, rank, cycle) of the messages in conversations where one cites a later message.

    ``edges`` are those of ``citations``. A message's place and rank are the greatest of its
    own turn and of one rank more than each message it must follow; a change goes on
    along the citations, round by round, until nothing changes.
    """
    kind = edges.schema["node_turn"].dataType
    back = edges.where(F.struct("cited_turn", "cited") > F.struct("node_turn", "node"))
    held = Staged(spark, edges.join(back.select(F.col("conv_id").alias("c")).distinct(), F.col("conv_id").eqNullSafe(F.col("c")), "left_semi"), "cites").df
    if held.isEmpty():
        return spark.createDataFrame([], StructType([StructField("row", LongType()), StructField("place", kind), StructField("rank", IntegerType()), StructField("cycle", BooleanType())]))
    home = Staged(spark, cycles(spark, held.select("node", "cited")), "homes").df
    nodes = held.select("node", F.col("node_turn").alias("turn")).union(held.select("cited", "cited_turn")).distinct().join(home, "node", "left").select("node", "turn", F.coalesce("home", "node").alias("at"), F.col("home").isNotNull().alias("cycle"))
    nodes = Staged(spark, nodes, "nodes").df
    of = nodes.select("node", "at")
    arcs = held.select("node", "cited").join(of, "node").select(F.col("at").alias("to"), "cited").join(of.withColumnRenamed("node", "cited"), "cited").select(F.col("at").alias("from"), "to").where("from <> to").distinct()
    arcs = Staged(spark, arcs, "arcs").df
    first = nodes.groupBy("at").agg(F.max("turn").alias("turn"))
    state = Staged(spark, first.select("at", F.struct(F.col("turn").alias("place"), F.lit(0).alias("rank")).alias("key"), F.lit(True).alias("new")), "places")
    while not state.df.where("new").isEmpty():
        sent = state.df.where("new").select(F.col("at").alias("from"), F.struct(F.col("key.place").alias("place"), (F.col("key.rank") + 1).alias("rank")).alias("sent"))
        best = arcs.join(sent, "from").groupBy(F.col("to").alias("at")).agg(F.max("sent").alias("sent"))
        grown = state.df.join(best, "at", "left").select("at", F.greatest("key", "sent").alias("key"), F.coalesce(F.col("sent") > F.col("key"), F.lit(False)).alias("new"))
        nxt = Staged(spark, grown, "places")
        state.drop()
        state = nxt
    return nodes.join(state.df, "at").select(F.col("node").alias("row"), F.col("key.place").alias("place"), F.col("key.rank").alias("rank"), "cycle")


def problems(arguments: Column, required: Column, types: Column) -> Column:
    """Array of what is wrong with arguments: ``missing:key``, ``type:key``, or ``no object``."""
    fields = F.try_variant_get(arguments, "$", "map<string,variant>")
    none = F.array().cast("array<string>")
    missing = F.transform(F.filter(F.coalesce(required, none), lambda k: ~F.coalesce(F.map_contains_key(fields, k), F.lit(False))), lambda k: F.concat(F.lit("missing:"), k))

    def fits(kind: Column, want: Column) -> Column:
        kind = F.lower(kind)
        number = kind.rlike("^(bigint|double|decimal)")
        return (
            F.when(want == "string", kind == "string")
            .when(want == "integer", kind.rlike(r"^(bigint|decimal\(\d+,0\))"))
            .when(want == "number", number)
            .when(want == "boolean", kind == "boolean")
            .when(want == "array", kind.startswith("array"))
            .when(want == "object", kind.startswith("object"))
            .when(want == "null", kind == "void")
            .otherwise(F.lit(True))
        )

    wrong = F.filter(F.map_entries(F.coalesce(types, F.create_map().cast("map<string,string>"))), lambda e: F.coalesce(F.map_contains_key(fields, e["key"]), F.lit(False)) & ~fits(F.schema_of_variant(F.try_element_at(fields, e["key"])), e["value"]))
    return F.when(fields.isNull(), F.array(F.lit("no object"))).otherwise(F.concat(missing, F.transform(wrong, lambda e: F.concat(F.lit("type:"), e["key"]))))


def format_chats(spark: SparkSession, messages: DataFrame, schemas: DataFrame | None = None, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows (conv_id, turn, role, place, rank, json, n_calls, n_linked, n_invalid, cycle), one per message.

    ``schemas``: (name, required array<string>, types map<string,string> of JSON type names)
    of tools that a call's conversation does not declare; tools of neither kind are only
    required to have an object as arguments.
    """
    parsed = Staged(spark, parse(messages, conv_id, turn, role, text), "messages").df
    calls = Staged(spark, calls_of(parsed), "calls").df
    linked = Staged(spark, link(calls, parsed), "links").df
    if schemas is None:
        schemas = spark.createDataFrame([], "name string, required array<string>, types map<string,string>")
    rules = schemas.groupBy("name").agg(F.first("required").alias("required"), F.first("types").alias("types"))
    rules = rules.select("name", F.struct("required", "types").alias("rule"))
    own = rules_of(calls, declared(messages, conv_id, turn, role, text))
    checked = calls.join(rules, "name", "left").join(own, ["row", "part"], "left").withColumn("rule", F.coalesce("own", "rule")).join(linked, ["row", "part"], "left").join(inner_order(calls), ["row", "part"], "left")
    checked = checked.select("row", "part", "call", "name", "arguments", F.coalesce("depth", F.lit(0)).alias("depth"), F.coalesce("cycle", F.lit(False)).alias("cycle"), F.col("result_row").isNotNull().alias("answered"), "result_row", problems(F.col("arguments"), F.col("rule.required"), F.col("rule.types")).alias("problems"))
    checked = Staged(spark, checked, "checked").df
    line = F.concat(F.lit('{"arguments":'), F.coalesce(canonical(F.col("arguments")), F.lit("null")), F.lit(',"id":'), _string(F.col("call")), F.lit(',"name":'), _string(F.col("name")), F.lit("}"))
    own = checked.select("row", "part", "depth", "cycle", "answered", "problems", line.alias("line"))
    per = own.groupBy("row").agg(
        F.sort_array(F.collect_list(F.struct("depth", "part", "line"))).alias("lines"),
        F.max("cycle").alias("inner_cycle"), F.count("*").alias("n_calls"), F.count_if("answered").alias("n_linked"), F.count_if(F.size("problems") > 0).alias("n_invalid"),
    )
    answers = checked.where("answered").select(F.col("result_row").alias("row"), F.lit(True).alias("met"))  # a result meets one call at most
    moved = Staged(spark, places(spark, Staged(spark, citations(calls, linked), "citations").df), "moved").df
    whole = parsed.select("row", "conv_id", "turn", "role", "content", "answers").join(per, "row", "left").join(answers, "row", "left").join(moved, "row", "left")
    json = F.concat(
        F.lit('{"content":'), _string(F.col("content")), F.lit(',"role":'), _string(F.col("role")),
        F.when(F.col("answers").isNotNull(), F.concat(F.lit(',"tool_call_id":'), _string(F.col("answers")))).otherwise(""),
        F.when(F.col("lines").isNotNull(), F.concat(F.lit(',"tool_calls":['), F.array_join(F.transform("lines", lambda x: x["line"]), ","), F.lit("]"))).otherwise(""),
        F.lit("}"),
    )
    zero = F.lit(0).cast("long")
    linked_here = F.when(F.col("answers").isNotNull(), F.col("met").isNotNull().cast("long")).otherwise(F.coalesce("n_linked", zero))
    return whole.select(
        "conv_id", "turn", "role", F.coalesce("place", "turn").alias("place"), F.coalesce("rank", F.lit(0)).alias("rank"), json.alias("json"),
        F.coalesce("n_calls", zero).alias("n_calls"), linked_here.alias("n_linked"), F.coalesce("n_invalid", zero).alias("n_invalid"), (F.coalesce("cycle", F.lit(False)) | F.coalesce("inner_cycle", F.lit(False))).alias("cycle"),
    )


def _string(value: Column) -> Column:
    """A JSON string, or null."""
    inner = F.to_json(F.struct(value.alias("s")))
    return F.when(value.isNull(), F.lit("null")).otherwise(F.substring(inner, F.lit(6), F.char_length(inner) - 6))
