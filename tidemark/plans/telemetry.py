"""Telemetry made from general tables, so that the converters have whole tables with known answers.

Users are sessions; an event of place n in its session happens at second 1000 + 10 n and
lasts five seconds.  A word, ``w`` and a letter, stands for texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..tables import read_table

_KINDS = {"stringValue": "string", "intValue": "string", "doubleValue": "double", "boolValue": "boolean"}
NANOS = 1_000_000_000


def session_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with k, their place n, word, second, and the document that they go into."""
    raw = read_table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    raw = raw.withColumn("n", (F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) - 1).cast("long"))
    return raw.withColumn("word", word("k")).withColumn("at", 1000 + 10 * F.col("n")).withColumn("doc", F.expr("user_id div 20"))


def word(column: str) -> Column:
    return F.concat(F.lit("w"), F.expr(f"substr('abcdefg', cast({column} % 7 + 1 as int), 1)"))


def text(prefix: str, column: str | Column) -> Column:
    return F.concat(F.lit(prefix), column)


def attributes(**values: tuple[str, Column]) -> Column:
    """OTLP attributes from name=(kind, value), dots written as two underscores; nulls are left out."""
    value = lambda kind, v: F.struct(*[(v if k == kind else F.lit(None)).cast(t).alias(k) for k, t in _KINDS.items()])
    every = F.array(*[F.struct(F.lit(name.replace("__", ".")).alias("key"), value(f"{kind}Value", v).alias("value")) for name, (kind, v) in values.items()])
    return F.filter(every, lambda a: F.coalesce(*[a["value"][k].cast("string") for k in _KINDS]).isNotNull())


def nanos(seconds: Column) -> Column:
    return (seconds.cast("long") * NANOS).cast("string")


def span(rows: DataFrame, place: int, trace: Column, id_: Column, name: str, attrs: Column, *, parent: Column | None = None, start: Column | None = None, end: Column | None = None, code: Column | None = None, events: Column | None = None) -> DataFrame:
    """Rows (doc, place, leaf): one span a row."""
    none = F.lit(None).cast("string")
    start = F.col("at") if start is None else start
    event = "array<struct<name:string,timeUnixNano:string,attributes:array<struct<key:string,value:struct<stringValue:string,intValue:string,doubleValue:double,boolValue:boolean>>>>>"
    leaf = F.struct(
        trace.alias("traceId"), id_.alias("spanId"), (none if parent is None else parent).alias("parentSpanId"), F.lit(name).alias("name"), nanos(start).alias("startTimeUnixNano"),
        nanos(start + 5 if end is None else end).alias("endTimeUnixNano"), F.struct((none if code is None else code).alias("code")).alias("status"), attrs.alias("attributes"), (F.lit(None) if events is None else events).cast(event).alias("events"),
    )
    return rows.select("doc", F.struct("user_id", "n", F.lit(place).alias("p")).alias("place"), leaf.alias("leaf"))


def record(rows: DataFrame, place: int, attrs: Column) -> DataFrame:
    """Rows (doc, place, leaf): one log record a row."""
    return rows.select("doc", F.struct("user_id", "n", F.lit(place).alias("p")).alias("place"), F.struct(nanos(F.col("at")).alias("timeUnixNano"), attrs.alias("attributes")).alias("leaf"))


def documents(top: str, scope: str, leaf: str, *parts: DataFrame, service: str | None = None) -> DataFrame:
    """Rows (file, text): OTLP JSON with the leaves of each document in order of place."""
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.unionByName(more)
    held = rows.groupBy("doc").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "leaf"))), lambda x: x["leaf"]).alias("leaves"))
    resource = F.struct(attributes(service__name=("string", F.lit(service))).alias("attributes"))
    return held.select(F.format_string(f"{leaf}-%06d", "doc").alias("file"), F.to_json(F.struct(F.array(F.struct(resource.alias("resource"), F.array(F.struct(F.col("leaves").alias(leaf))).alias(scope))).alias(top))).alias("text"))


def traces(*parts: DataFrame, service: str | None = None) -> DataFrame:
    return documents("resourceSpans", "scopeSpans", "spans", *parts, service=service)


def logs(*parts: DataFrame, service: str | None = None) -> DataFrame:
    return documents("resourceLogs", "scopeLogs", "logRecords", *parts, service=service)


def users(rows: DataFrame) -> DataFrame:
    """One row a user, before all of its events."""
    return rows.select("user_id", "doc").distinct().withColumn("n", F.lit(-1).cast("long")).withColumn("at", F.lit(0).cast("long"))


def openinference_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views are model spans, clicks and purchases tool spans, signups agents, errors model spans without input."""
    rows, k = session_rows(spark, sf_dir), F.col("k")
    user, id_ = F.col("user_id").cast("string"), text("s", F.col("event_id").cast("string"))
    trace, root = text("t", user), text("root", user)
    when = lambda test, value: F.when(test, value)
    agent = attributes(openinference__span__kind=("string", F.lit("AGENT")), agent__name=("string", text("w", (F.col("user_id") % 4).cast("string"))), session__id=("string", when(F.col("user_id") % 3 == 0, text("u", user))))
    model = attributes(
        openinference__span__kind=("string", F.lit("LLM")), input__value=("string", when(F.col("event_type") == "view", F.col("word"))), llm__model_name=("string", when(k % 7 > 0, text("m", (k % 3).cast("string")))),
        llm__token_count__prompt=("int", k * 10), llm__token_count__completion=("int", when(k % 3 > 0, k)), llm__cost__total=("double", when(k % 4 > 0, F.round(F.col("value") / 1000, 6))),
    )
    tool = attributes(openinference__span__kind=("string", F.lit("tool")), tool__name=("string", F.col("event_type")), input__value=("string", F.col("word")), output__value=("string", when(k % 2 == 0, text("r", F.col("word")))))
    other = attributes(openinference__span__kind=("string", F.lit("CHAIN")))
    code = when(k % 5 == 0, F.lit("2"))
    views = rows.where("event_type = 'view'")
    latest = F.last(F.when(F.col("event_type") == "view", id_), ignorenulls=True).over(W.partitionBy("user_id").orderBy("n"))
    above = rows.withColumn("above", F.coalesce(latest, root))
    return traces(
        span(users(rows), 0, trace, root, "agent", agent, end=F.lit(10**6)),
        span(views.unionByName(rows.where("event_type = 'error'")), 1, trace, id_, "call", model, parent=root, code=code),
        span(above.where("event_type in ('click', 'purchase')"), 1, trace, id_, "use", tool, parent=F.col("above"), code=code),
        span(rows.where("event_type = 'signup'"), 1, trace, id_, "chain", other, parent=root),
    )


def coding_cli_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One interaction a user; views are requests, clicks and purchases tools, signups billed requests without a span."""
    from ..sources import coding_cli as c

    rows, k = session_rows(spark, sf_dir), F.col("k")
    user, id_ = F.col("user_id").cast("string"), text("s", F.col("event_id").cast("string"))
    trace, turn, session = text("t", user), text("i", user), ("string", text("u", user))
    views, tools, bills = rows.where("event_type = 'view'"), rows.where("event_type in ('click', 'purchase')"), rows.where("event_type = 'signup'")
    request = attributes(session__id=session, model=("string", text("m", (k % 3).cast("string"))), request_id=("string", F.when(k % 2 == 0, text("r", F.col("event_id").cast("string")))), input_tokens=("int", k), cache_read_tokens=("int", k % 5), output_tokens=("int", 2 * k), success=("bool", k % 9 > 0))
    said = F.array(F.struct(F.lit("tool.output").alias("name"), nanos(F.col("at")).alias("timeUnixNano"), attributes(content=("string", text("ok ", F.col("word")))).alias("attributes")))
    child = lambda part, name, attrs: span(tools.where(part), 2, trace, F.concat(id_, F.lit("x")), name, attrs, parent=id_)
    spans = traces(
        span(users(rows), 0, trace, turn, c.INTERACTION, attributes(session__id=session, user_prompt=("string", F.lit("fix it please"))), end=F.lit(10**6)),
        span(views, 1, trace, id_, c.REQUEST, request, parent=turn),
        span(tools, 1, trace, id_, c.TOOL, attributes(session__id=session, tool_name=("string", F.col("event_type")), file_path=("string", F.col("word"))), parent=turn, events=F.when(k % 2 == 0, said)),
        child("k % 3 = 0", c.EXECUTION, attributes(session__id=session, success=("bool", k % 2 == 0))),
        child("k % 3 = 1 and k % 5 = 0", c.BLOCKED, attributes(session__id=session, decision=("string", F.lit("reject")))),
        service="claude-code",
    )
    sequence = ("int", F.col("n"))
    bill = lambda prefix, own: attributes(session__id=session, event__name=("string", F.lit("api_request")), event__sequence=sequence, request_id=("string", text(prefix, F.col("event_id").cast("string"))), cost_usd=("double", F.round(F.col("value") / 1000, 6)), **own)
    given = F.concat(F.lit('{"q": "'), F.col("word"), F.lit('"}'))
    records = logs(
        record(tools, 1, attributes(session__id=session, event__name=("string", F.lit("tool_result")), event__sequence=sequence, tool_name=("string", F.when(k % 13 == 0, "other").otherwise(F.col("event_type"))), tool_input=("string", F.when(k % 11 > 0, given)))),
        record(views.where("k % 2 = 0"), 1, bill("r", {})),
        record(bills, 1, bill("z", {"model": ("string", F.lit("ms")), "input_tokens": ("int", k), "output_tokens": ("int", F.lit(1))})),
    )
    return spans.unionByName(records)


def subagent_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases hand tasks to subagents, four of five by name; views are requests of the latest one, or of the user before any."""
    from ..sources import coding_cli as c

    rows, k = session_rows(spark, sf_dir).where("event_type in ('view', 'purchase')"), F.col("k")
    user, id_ = F.col("user_id").cast("string"), text("s", F.col("event_id").cast("string"))
    trace, turn, session = text("t", user), text("i", user), ("string", text("u", user))
    before = W.partitionBy("user_id").orderBy("n").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("handed", F.last(F.when(F.col("event_type") == "purchase", id_), ignorenulls=True).over(before))
    kind = F.when(k % 5 > 0, F.when(k % 2 == 0, "scout").otherwise("writer"))
    return traces(
        span(users(rows), 0, trace, turn, c.INTERACTION, attributes(session__id=session), end=F.lit(10**6)),
        span(rows.where("event_type = 'view'"), 1, trace, id_, c.REQUEST, attributes(session__id=session, model=("string", F.lit("m"))), parent=F.coalesce("handed", turn)),
        span(rows.where("event_type = 'purchase'"), 1, trace, id_, c.TOOL, attributes(session__id=session, tool_name=("string", F.lit("Task")), subagent_type=("string", kind)), parent=turn),
        service="claude-code",
    )


def cowork_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views are requests, errors failed ones, clicks tool results, purchases decisions, signups prompts."""
    rows, k = session_rows(spark, sf_dir), F.col("k")
    base = {"session__id": ("string", text("u", F.col("user_id").cast("string"))), "event__sequence": ("int", F.col("n"))}
    of = lambda kind, name, **own: record(rows.where(f"event_type = '{kind}'"), 1, attributes(**base, event__name=("string", F.lit(name)), **own))
    prompt, request = ("string", text("p", (k % 3).cast("string"))), ("string", text("r", F.col("event_id").cast("string")))
    server = F.when(k % 5 == 0, F.lit('{"mcp_server_name": "srv", "mcp_tool_name": "x"}'))
    return logs(
        of("view", "api_request", prompt__id=prompt, request_id=request, model=("string", text("m", (k % 3).cast("string"))), input_tokens=("int", k), cache_read_tokens=("int", k % 5), output_tokens=("int", 2 * k), cost_usd=("double", F.when(k % 4 > 0, F.round(F.col("value") / 1000, 6)))),
        record(rows.where("event_type = 'view' and k % 4 = 0"), 2, attributes(**base, event__name=("string", F.lit("assistant_response")), request_id=request, response=("string", text("said ", F.col("word"))))),
        of("error", "api_error", prompt__id=prompt, model=("string", F.lit("me"))),
        of("signup", "user_prompt", prompt__id=prompt, prompt=("string", F.when(k % 5 == 0, F.lit("<REDACTED>")).otherwise(F.concat("word", F.lit(" please"))))),
        of("click", "tool_result", tool_name=("string", F.lit("run")), tool_input=("string", F.when(k % 2 == 0, F.concat(F.lit('{"q": "'), F.col("word"), F.lit('"}')))), success=("string", F.when(k % 3 == 0, "true").when(k % 3 == 1, "false")), tool_parameters=("string", server)),
        of("purchase", "tool_decision", tool_name=("string", F.lit("buy")), decision=("string", F.when(k % 2 == 0, "reject").otherwise("accept"))),
        service="cowork",
    )


def metrics(rows: DataFrame, name: str, kind: str, attrs: Column, **data: Column) -> DataFrame:
    """Rows (file, text): one document a metric point of rows (file, start, at, value)."""
    point = F.struct(F.col("value").cast("double").alias("asDouble"), nanos(F.col("start")).alias("startTimeUnixNano"), nanos(F.col("at")).alias("timeUnixNano"), attrs.alias("attributes"))
    held = F.struct(F.array(point).alias("dataPoints"), *[v.alias(k) for k, v in data.items()])
    metric = F.struct(F.lit(name).alias("name"), held.alias(kind))
    return rows.select("file", F.to_json(F.struct(F.array(F.struct(F.array(F.struct(F.array(metric).alias("metrics"))).alias("scopeMetrics"))).alias("resourceMetrics"))).alias("text"))


def openclaw_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views are model calls, clicks tools under one harness a user; a counter of a thousand dollars for each channel and model."""
    from ..sources import openclaw as o

    rows, k = session_rows(spark, sf_dir), F.col("k")
    user, id_ = F.col("user_id").cast("string"), text("s", F.col("event_id").cast("string"))
    trace, top = text("t", user), text("h", user)
    quoted = lambda before, after: F.concat(F.lit(before), F.col("word"), F.lit(after))
    call = attributes(
        gen_ai__request__model=("string", text("m", (k % 3).cast("string"))), gen_ai__usage__input_tokens=("int", k), gen_ai__usage__cache_read__input_tokens=("int", k % 5), gen_ai__usage__output_tokens=("int", F.when(k % 3 > 0, k)),
        gen_ai__input__messages=("string", F.when(k % 2 == 0, quoted('["', '"]'))), gen_ai__output__messages=("string", F.when(k % 4 == 0, quoted('["said ', '"]'))), openclaw__errorCategory=("string", F.when(k % 9 == 0, F.lit("x"))),
    )
    tool = attributes(gen_ai__tool__name=("string", F.lit("run")), gen_ai__tool__call__arguments=("string", F.when(k % 2 == 0, quoted('{"q": "', '"}'))), gen_ai__tool__call__result=("string", F.when(k % 3 == 0, quoted('{"r": "', '"}'))), openclaw__outcome=("string", F.when(k % 10 == 0, F.lit("blocked"))))
    harness = attributes(openclaw__channel=("string", text("c", (F.col("user_id") % 2).cast("string"))), openclaw__harness__id=("string", text("bot", (F.col("user_id") % 4).cast("string"))))
    spans = traces(
        span(users(rows), 0, trace, top, o.HARNESS, harness, end=F.lit(10**6)),
        span(rows.where("event_type = 'view'"), 1, trace, id_, o.CALL, call, parent=top),
        span(rows.where("event_type = 'click'"), 1, trace, id_, o.TOOL, tool, parent=top),
    )
    # Two cumulative points each; the later one holds.
    points = spark.range(12).selectExpr("id % 2 as c", "id div 2 % 3 as m", "id div 6 as p").selectExpr("format_string('metric-%d-%d-%d', c, m, p) as file", "c", "m", "1 as start", "2 + p as at", "1 + 999 * p as value")
    which = attributes(openclaw__channel=("string", text("c", F.col("c").cast("string"))), openclaw__model=("string", text("m", F.col("m").cast("string"))))
    return spans.unionByName(metrics(points, o.COUNTER, "sum", which, aggregationTemporality=F.lit(2), isMonotonic=F.lit(True)))


def order_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows (file, text): a metric point an order, cumulative and delta sums, gauges and histograms by its number."""
    rows = read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.concat(F.lit("m-"), F.col("o_orderkey").cast("string")).alias("file"), F.lit(7).alias("start"), (F.col("o_orderkey") % 1000).alias("at"), F.col("o_totalprice").alias("value"), F.col("o_orderpriority").alias("model"))
    which = attributes(model=("string", F.col("model")), model__again=("string", F.when(F.col("k") % 2 == 0, F.col("file"))))
    sums = [metrics(rows.where(f"k % 4 = {i}"), "spent", "sum", which, aggregationTemporality=F.lit(2 - i), isMonotonic=F.lit(i == 0)) for i in (0, 1)]
    return sums[0].unionByName(sums[1]).unionByName(metrics(rows.where("k % 4 = 2"), "level", "gauge", which)).unionByName(metrics(rows.where("k % 4 = 3"), "spread", "histogram", which, aggregationTemporality=F.lit(2)))


def localtrace_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One run a user; views are calls, half of them with a content span, clicks tools; five dollars a run."""
    from ..sources import openclaw_localtrace as o

    rows, k = session_rows(spark, sf_dir), F.col("k")
    user, id_ = F.col("user_id").cast("string"), text("s", F.col("event_id").cast("string"))
    trace, own = text("t", user), ("string", F.when(F.col("user_id") % 3 > 0, text("u", user)))
    quoted = lambda before, after: F.concat(F.lit(before), F.col("word"), F.lit(after))
    content = attributes(gen_ai__input__messages=("string", quoted('["', '"]')), gen_ai__usage__input_tokens=("int", k), gen_ai__usage__cost_usd=("double", F.when(k % 4 == 0, F.round(F.col("value") / 1000, 6))))
    tool = attributes(
        openclaw__sessionId=own, openclaw__toolName=("string", F.lit("run")), openclaw__mutatingAction=("bool", F.when(k % 3 < 2, k % 3 == 0)), openclaw__error=("string", F.when(k % 10 == 0, F.lit("bad"))),
        gen_ai__tool__call__arguments=("string", F.when(k % 2 == 0, quoted('{"q": "', '"}'))), gen_ai__tool__call__result=("string", F.when(k % 5 == 0, quoted('{"r": "', '"}'))),
    )
    views = rows.where("event_type = 'view'")
    spans = traces(
        span(users(rows), 0, trace, text("r", user), o.RUN, attributes(openclaw__sessionId=own, openclaw__agentId=("string", text("bot", (F.col("user_id") % 4).cast("string")))), end=F.lit(10**6)),
        span(views, 1, trace, id_, o.CALL, attributes(openclaw__sessionId=own, openclaw__model=("string", text("m", (k % 3).cast("string"))), openclaw__errorCategory=("string", F.when(k % 9 == 0, F.lit("x")))), parent=text("r", user)),
        span(views.where("k % 2 = 0"), 2, trace, F.concat(id_, F.lit("c")), o.CONTENT, content, parent=text("r", user), end=F.col("at") + 6),
        span(rows.where("event_type = 'click'"), 1, trace, id_, o.TOOL, tool, parent=text("r", user)),
    )
    turns = users(rows).where("user_id % 3 > 0").select(F.format_string("metric-%06d", "user_id").alias("file"), "user_id", F.lit(0).alias("start"), F.lit(10**6 + 1).alias("at"), F.lit(5.0).alias("value"))
    return spans.unionByName(metrics(turns, o.GAUGE, "gauge", attributes(openclaw__sessionId=("string", text("u", user)))))


def turn_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("said"), word("conv_id").alias("word"))


def opencode_messages(spark: SparkSession, sf_dir: str, prefix: str = "") -> DataFrame:
    """Rows (conv_id, turn, info, parts): messages of sessions; the texts of every sixth session's users are withheld.

    In every fifth session a user asks for a compaction, the next message is its summary,
    and every second of these keeps a tail.  prefix: what ids of messages begin with.
    """
    rows, turn = turn_rows(spark, sf_dir), F.col("turn")
    order = W.partitionBy("conv_id").orderBy("turn")
    rows = rows.withColumn("asks", (F.col("conv_id") % 5 == 2) & turn.isin(2, 3) & (F.col("role") == "user") & (F.coalesce(F.lead("role").over(order), F.lit("")) == "assistant"))
    rows = rows.withColumn("sums", F.coalesce(F.lag("asks").over(order), F.lit(False)))
    own = lambda t: F.format_string(prefix + "m%03d", *([F.col("conv_id")] if prefix else []), t)
    tokens = F.struct((turn * 7).alias("input"), turn.alias("output"), F.lit(1).alias("reasoning"), F.struct(F.lit(2).alias("read"), F.lit(3).alias("write")).alias("cache"))
    cost = F.when(turn % 4 == 1, F.lit(0.25)).otherwise(F.lit(0.0))
    status = F.when(F.col("conv_id") % 5 == 0, "error").otherwise("completed")
    state = F.struct(status.alias("status"), F.struct(F.col("word").alias("q")).alias("input"), F.concat(F.lit("ok "), F.col("word")).alias("output"), F.concat(F.lit("bad "), F.col("word")).alias("error"))
    none = F.lit(None)
    part = lambda id_, kind, said=none, tool=none, held=none, count=none, spent=none, tail=none: F.struct(F.lit(id_).alias("id"), F.lit(kind).alias("type"), said.cast("string").alias("text"), tool.cast("string").alias("tool"), held.cast(_type(rows, state)).alias("state"), count.cast(_type(rows, tokens)).alias("tokens"), spent.cast("double").alias("cost"), tail.cast("string").alias("tail_start_id"))
    spoken = F.array(part("p1", "step-start"), part("p2", "text", F.col("said")))
    used = F.when(turn % 4 == 1, F.array(part("p3", "tool", tool=F.lit("grep"), held=state))).otherwise(F.array().cast(f"array<{_type(rows, part('', ''))}>"))
    asked = F.when((F.col("role") == "user") & (F.col("conv_id") % 6 == 5), F.lit("[redacted:text]")).otherwise(F.col("said"))
    cut = F.array(part("p1", "text", asked), part("p2", "compaction", tail=F.when(F.col("conv_id") % 2 == 0, own(F.lit(1)))))
    parts = F.when(F.col("role") == "assistant", F.concat(spoken, used, F.array(part("p4", "step-finish", count=tokens, spent=cost)))).when(F.col("asks"), cut).otherwise(F.array(part("p1", "text", asked)))
    mine = F.col("role") == "assistant"
    info = F.struct(F.format_string("m%03d", "turn").alias("id"), "role", F.struct((turn * 1000).alias("created"), F.when(mine, turn * 1000 + 500).alias("completed")).alias("time"), F.when(mine, text("m", (F.col("conv_id") % 3).cast("string"))).alias("modelID"), F.when(mine, text("a", (F.col("conv_id") % 2).cast("string"))).alias("agent"),
        F.when(F.col("sums"), True).alias("summary"), F.when(F.col("sums"), "stop").alias("finish"), F.when(F.col("sums"), own(turn - 1)).alias("parentID"))
    return rows.select("conv_id", "turn", info.alias("info"), parts.alias("parts"))


def opencode_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The same sessions as tables of a database: all columns are text."""
    rows = opencode_messages(spark, sf_dir, "m%d-")
    conv, id_ = F.col("conv_id"), F.concat(F.lit("m"), F.col("conv_id").cast("string"), F.lit("-"), F.col("info.id"))
    session = rows.select("conv_id").distinct().select(F.format_string("ses%d", conv).alias("id"), F.when(conv % 4 == 1, F.format_string("ses%d", conv - 1)).alias("parent_id"), F.lit(None).cast("string").alias("agent"), F.lit("0").alias("time_created"))
    message = rows.select(id_.alias("id"), F.format_string("ses%d", conv).alias("session_id"), F.col("info.time.created").cast("string").alias("time_created"), F.to_json("info").alias("data"))
    part = rows.select(id_.alias("message_id"), F.explode("parts").alias("p")).select(F.concat("message_id", F.lit("-"), F.col("p.id")).alias("id"), "message_id", F.to_json("p").alias("data"))
    return {"session": session, "message": message, "part": part}


def opencode_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows (file, text): exported sessions; every seventh lies in a second file, too, which doesn't count."""
    held = opencode_messages(spark, sf_dir).groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.struct("info", "parts").alias("m")))), lambda x: x["m"]).alias("messages"))
    conv = F.col("conv_id").cast("string")
    session = F.struct(text("ses", conv).alias("id"), F.when(F.col("conv_id") % 4 == 1, F.format_string("ses%d", F.col("conv_id") - 1)).alias("parentID"))
    files = held.select("conv_id", F.to_json(F.struct(session.alias("info"), "messages")).alias("text"))
    copies = files.where("conv_id % 7 = 0").select(F.format_string("b%06d", "conv_id").alias("file"), F.to_json(F.struct(F.struct(text("ses", conv).alias("id")).alias("info"), F.array().cast("array<string>").alias("messages"))).alias("text"))
    return files.select(F.format_string("a%06d", "conv_id").alias("file"), "text").unionByName(copies)


def _type(rows: DataFrame, column: Column) -> str:
    return rows.select(column.alias("x")).schema[0].dataType.simpleString()


def pi_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows (file, text): session files; every other session's tool calls are answered, every fourth session is a fork.

    Of five sessions one has a compaction after turn 3 that keeps what comes from turn 2 on,
    one has an edit after turn 2 that replaces or removes turn 1, and one goes back to turn 1
    before turn 4, with a summary of the branch left.
    """
    rows, turn, conv = turn_rows(spark, sf_dir), F.col("turn"), F.col("conv_id")
    mine, none = F.col("role") == "assistant", F.lit(None).cast("string")
    answered = (turn % 4 == 1) & (conv % 2 == 0) & mine
    block = lambda kind, said=none, id_=none, name=none, given=none: F.struct(F.lit(kind).alias("type"), said.alias("text"), id_.alias("id"), name.alias("name"), F.when(given.isNotNull(), F.struct(given.alias("q"))).alias("arguments"))
    call = block("toolCall", id_=F.format_string("c%d", turn), name=F.lit("grep"), given=F.col("word"))
    content = F.when(mine & (turn % 4 == 1), F.array(block("text", F.col("said")), call)).otherwise(F.array(block("text", F.col("said"))))
    usage = F.struct((turn * 7).alias("input"), turn.alias("output"), F.lit(2).alias("cacheRead"), (turn * 8 + 2).alias("totalTokens"), F.struct(F.when(turn % 4 == 3, 0.25).otherwise(0.0).alias("total")).alias("cost"))
    said = F.struct("role", content.alias("content"), F.when(mine, text("m", (conv % 3).cast("string"))).alias("model"), F.when(mine, usage).alias("usage"), none.alias("toolCallId"), none.alias("toolName"), F.lit(None).cast("boolean").alias("isError"))
    result = F.struct(F.lit("toolResult").alias("role"), F.array(block("text", F.concat(F.lit("ok "), F.col("word")))).alias("content"), none.alias("model"), F.lit(None).cast(_type(rows, usage)).alias("usage"), F.format_string("c%d", turn).alias("toolCallId"), F.lit("grep").alias("toolName"), (conv % 5 == 0).alias("isError"))
    kinds = {0: ("e%d", "message", said), 1: ("r%d", "message", result), 2: ("k%d", "compaction", None), 3: ("x%d", "context_edit", None), -1: ("b%d", "branch_summary", None)}
    there = {0: F.lit(True), 1: answered, 2: (conv % 5 == 1) & (turn == 3), 3: (conv % 5 == 2) & (turn == 2), -1: (conv % 5 == 3) & (turn == 4)}
    entry = lambda p, id_, kind, message: F.struct(F.lit(p).alias("p"), F.format_string(id_, turn).alias("id"), F.lit(kind).alias("type"), (F.lit(None).cast(_type(rows, said)) if message is None else message).alias("message"))
    every = F.filter(F.array(*[F.when(there[p], entry(p, *kinds[p])) for p in kinds]), lambda x: x.isNotNull())
    rows = rows.select("conv_id", "turn", F.explode(every).alias("e")).select("conv_id", "turn", "e.*")
    order, kind = W.partitionBy("conv_id").orderBy("turn", "p"), F.col("type")
    left = F.last(F.when(turn <= 1, F.col("id")), ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, -1))
    rows = rows.withColumn("parentId", F.when(kind == "branch_summary", left).otherwise(F.lag("id").over(order)))
    more = [
        F.when(kind == "compaction", "so far").when(kind == "branch_summary", "left behind").alias("summary"), F.when(kind == "compaction", "e2").alias("firstKeptEntryId"),
        F.when(kind == "context_edit", "e1").alias("targetId"), F.when((kind == "context_edit") & (conv % 2 == 0), "cut").alias("replacement"),
    ]
    line = F.to_json(F.struct("type", "id", "parentId", F.format_string("1970-01-01T00:%02d:00Z", turn.cast("int")).alias("timestamp"), "message", *more))
    lines = rows.select("conv_id", F.struct("turn", "p", line.alias("line")).alias("l"))
    bill = F.to_json(F.struct(F.lit("usage").alias("type"), F.lit("u").alias("id"), F.lit("title").alias("kind"), F.lit("mt").alias("model"), F.lit("1970-01-01T01:00:00Z").alias("timestamp"), F.struct(F.lit(5).alias("input"), F.lit(1).alias("output"), F.struct(F.lit(0.125).alias("total")).alias("cost")).alias("usage")))
    lines = lines.unionByName(rows.where("conv_id % 6 = 0").select("conv_id").distinct().select("conv_id", F.struct(F.lit(1 << 40).alias("turn"), F.lit(0).alias("p"), bill.alias("line")).alias("l")))
    held = lines.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list("l")), lambda x: x["line"]).alias("lines"))
    path = lambda c: F.format_string("/in/%d.jsonl", c)
    header = F.to_json(F.struct(F.lit("session").alias("type"), text("ses", conv.cast("string")).alias("id"), F.lit(3).alias("version"), F.lit("1970-01-01T00:01:00Z").alias("timestamp"), F.when(conv % 4 == 1, path(conv - 1)).alias("parentSession")))
    return held.select(path(conv).alias("file"), F.array_join(F.concat(F.array(header), "lines"), "\n").alias("text"))
