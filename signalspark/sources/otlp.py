"""OTLP/JSON export requests as rows.

A request is one JSON text. It is parsed once, with a schema that keeps 64-bit numbers as text, then exploded:
resource, scope, item, each with its place in the request (``At``). Attribute values are rendered as JSON with
built-in expressions; only requests that hold a list or a map, which may be nested to any depth, pass through an
Arrow function first (:func:`plain_lists`).
"""

from __future__ import annotations

import json
import re
from functools import reduce
from json.encoder import encode_basestring as _quoted

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalspark.plans.dimensions import with_resource_hash, with_scope_hash
from signalspark.schemas import SPAN_KINDS, STATUS_CODES, TEMPORALITIES

#: The union of an attribute value; lists and maps are JSON text (see :func:`plain_lists`).
_VALUE = "struct<stringValue:string,boolValue:string,intValue:string,doubleValue:string,bytesValue:string,arrayValue:string,kvlistValue:string>"
_ATTRIBUTES = f"array<struct<key:string,value:{_VALUE}>>"
_RESOURCE = f"resource:struct<attributes:{_ATTRIBUTES}>,schemaUrl:string"
_SCOPE = f"scope:struct<name:string,version:string,attributes:{_ATTRIBUTES}>,schemaUrl:string"
_SPAN = (
    "traceId:string,spanId:string,traceState:string,parentSpanId:string,name:string,kind:string,startTimeUnixNano:string,endTimeUnixNano:string,"
    f"attributes:{_ATTRIBUTES},droppedAttributesCount:int,droppedEventsCount:int,droppedLinksCount:int,status:struct<code:string,message:string>,"
    f"events:array<struct<timeUnixNano:string,name:string,attributes:{_ATTRIBUTES},droppedAttributesCount:int>>,"
    f"links:array<struct<traceId:string,spanId:string,traceState:string,attributes:{_ATTRIBUTES},droppedAttributesCount:int>>"
)
_LOG = f"timeUnixNano:string,observedTimeUnixNano:string,severityNumber:string,severityText:string,body:{_VALUE},attributes:{_ATTRIBUTES},droppedAttributesCount:int,flags:int,traceId:string,spanId:string"
_EXEMPLAR = f"exemplars:array<struct<filteredAttributes:{_ATTRIBUTES},timeUnixNano:string,asDouble:double,asInt:string,spanId:string,traceId:string>>"
_TIMES = f"attributes:{_ATTRIBUTES},startTimeUnixNano:string,timeUnixNano:string,flags:int"
_NUMBERS = f"dataPoints:array<struct<{_TIMES},asDouble:double,asInt:string,{_EXEMPLAR}>>"
_SHAPE = "count:string,sum:double,min:double,max:double"
_BUCKETS = "struct<offset:int,bucketCounts:array<string>>"
_METRIC = (
    f"name:string,description:string,unit:string,gauge:struct<{_NUMBERS}>,sum:struct<{_NUMBERS},aggregationTemporality:string,isMonotonic:boolean>,"
    f"histogram:struct<dataPoints:array<struct<{_TIMES},{_SHAPE},bucketCounts:array<string>,explicitBounds:array<double>,{_EXEMPLAR}>>,aggregationTemporality:string>,"
    f"exponentialHistogram:struct<dataPoints:array<struct<{_TIMES},{_SHAPE},scale:int,zeroCount:string,positive:{_BUCKETS},negative:{_BUCKETS},{_EXEMPLAR}>>,aggregationTemporality:string>,"
    f"summary:struct<dataPoints:array<struct<{_TIMES},count:string,sum:double,quantileValues:array<struct<quantile:double,value:double>>>>>"
)

#: Names in a request: the resources, their scopes, the items, and the items' schema.
SIGNALS = {
    "traces": ("resourceSpans", "scopeSpans", "spans", _SPAN),
    "logs": ("resourceLogs", "scopeLogs", "logRecords", _LOG),
    "metrics": ("resourceMetrics", "scopeMetrics", "metrics", _METRIC),
}


#: What JSON takes for a number.
NUMBER = r"-?(0|[1-9]\d*)(\.\d+)?([eE][+-]?\d+)?"
_NUMBER, _WHOLE = re.compile(NUMBER), re.compile(r"-?\d+")
#: Body type of each member of the value union.
_BODIES = (("stringValue", "STRING"), ("boolValue", "BOOL"), ("intValue", "INT"), ("doubleValue", "DOUBLE"), ("bytesValue", "BYTES"), ("arrayValue", "ARRAY"), ("kvlistValue", "KVLIST"))


def plain_value(value: object) -> str | None:
    """An attribute value of a parsed request as plain JSON; None if it holds nothing. Lists and maps inside it are
    text already."""
    if not isinstance(value, dict):
        return None
    for member in value if len(value) == 1 else _PLAIN:
        x = value.get(member)
        if x is not None and member in _PLAIN:
            return _PLAIN[member](x)
    return None


def plain_list(member: str, x: object) -> str:
    if not isinstance(x, dict):
        return x
    values = x.get("values") or []
    return plain_object(values) if member == "kvlistValue" else "[" + ",".join(filter(None, map(plain_value, values))) + "]"


def plain_object(pairs: list) -> str:
    """Keys and values as a JSON object: without a key or a value they are dropped, of equal keys the last counts."""
    last = {p["key"]: v for p in pairs if isinstance(p, dict) and p.get("key") and (v := plain_value(p.get("value"))) is not None}
    return "{" + ",".join([f"{_quoted(k) if isinstance(k, str) else json.dumps(k)}:{last[k]}" for k in sorted(last)]) + "}"


def _whole(x: object) -> str:
    text = str(x)
    return str(int(text)) if _WHOLE.fullmatch(text) else _quoted(text)


def _number(x: object) -> str:
    text = str(x)
    return text if _NUMBER.fullmatch(text) else _quoted(text)


#: How each member of the value union is written, in the order in which they count.
_PLAIN = {
    "stringValue": lambda x: _quoted(str(x)),
    "boolValue": lambda x: str(x).lower(),
    "intValue": _whole,
    "doubleValue": _number,
    "bytesValue": lambda x: _quoted(str(x)),
    "arrayValue": lambda x: plain_list("arrayValue", x),
    "kvlistValue": lambda x: plain_list("kvlistValue", x),
}


def _inner(node: dict) -> dict:
    for member in ("arrayValue", "kvlistValue"):
        if member in node:
            node[member] = plain_list(member, node[member])
    return node


#: Made once: ``json.loads`` and ``json.dumps`` with options make a new one for each call.
_FLAT, _DECODER, _ENCODER = json.JSONDecoder(), json.JSONDecoder(object_hook=_inner), json.JSONEncoder(ensure_ascii=False)


def _shallow(v: object) -> str | None:
    """:func:`plain_value` from the outside in; a TypeError for what it leaves to the other way."""
    if type(v) is not dict:
        return None
    member, x = None, None
    for member in v if len(v) == 1 else _PLAIN:
        if (x := v.get(member)) is not None and member in _PLAIN:
            break
    else:
        return None
    if type(x) is dict:
        if member == "arrayValue":
            return "[" + ",".join([r for y in x.get("values") or () if (r := _shallow(y))]) + "]"
        if member == "kvlistValue":
            last = {}
            for p in x.get("values") or ():
                if type(p) is dict and (k := p.get("key")) and (r := _shallow(p.get("value"))) is not None:
                    last[k] = r
            return "{" + ",".join([_quoted(k) + ":" + last[k] for k in (sorted(last) if len(last) > 1 else last)]) + "}"
    if type(x) is dict or type(x) is list:
        raise TypeError
    return _PLAIN[member](x)


def _walk(node: object) -> None:
    """Writes the lists and maps among the values inside a parsed request as text."""
    for k, x in node.items() if type(node) is dict else enumerate(node):
        if type(x) is dict and (k == "arrayValue" or k == "kvlistValue"):
            node[k] = _shallow({k: x})
        elif type(x) is dict or type(x) is list:
            _walk(x)


def with_plain_lists(text: str) -> str | None:
    """A request whose lists and maps are JSON text; None if it is no JSON. The outermost come first, which is quicker; where a
    request is too deep for that, or odd, the innermost."""
    try:
        try:
            request = _FLAT.decode(text)
            if type(request) is dict or type(request) is list:
                _walk(request)
        except (TypeError, RecursionError):
            request = _DECODER.decode(text)
        return _ENCODER.encode(request)
    except (ValueError, RecursionError):
        return None


def plain_lists(requests: DataFrame) -> DataFrame:
    """Requests in which every list or map among the attribute values is text, its plain JSON form. Only requests that hold one
    go to the function."""

    @F.arrow_udf("string")
    def written(texts: pa.Array) -> pa.Array:
        return pa.array([None if x is None else with_plain_lists(x) for x in texts.to_pylist()], pa.string())

    value = F.col("value")
    some = value.contains('"arrayValue"') | value.contains('"kvlistValue"')
    return requests.withColumn("value", F.coalesce(written(F.when(some, value)), value))


def json_string(text: Column) -> Column:
    """A text as a JSON string."""
    listed = F.to_json(F.array(text))
    odd = text.rlike(r'["\\\x00-\x1f\x7f-\x9f\u2028\u2029]')
    return F.when(~odd, F.concat(F.lit('"'), text, F.lit('"'))).otherwise(F.substring(listed, F.lit(2), F.length(listed) - 2))


def present(value: Column) -> Column:
    """Whether a value holds anything."""
    return F.coalesce(*[value[m] for m, _ in _BODIES]).isNotNull()


def rendered(value: Column) -> Column:
    """An attribute value (a :data:`_VALUE`) as plain JSON; null if it holds nothing. Whole numbers lose leading zeros; what
    should be a number and isn't one in JSON (such as NaN) is a string."""
    quoted = lambda x: F.when(x.isNotNull(), json_string(x))
    whole = lambda x: F.when(x.rlike(r"^-?\d+$"), F.regexp_replace(F.regexp_replace(x, r"^(-?)0+(?=\d)", "$1"), "^-0$", "0")).otherwise(quoted(x))
    number = lambda x: F.when(x.rlike(f"^{NUMBER}$"), x).otherwise(quoted(x))
    return F.coalesce(quoted(value["stringValue"]), F.lower(value["boolValue"]), whole(value["intValue"]), number(value["doubleValue"]), quoted(value["bytesValue"]), value["arrayValue"], value["kvlistValue"])


def bound(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def attributes_json(attributes: Column) -> Column:
    """Attributes as a JSON object with sorted keys. Those without a key or a value are dropped; of equal keys
    the last counts. Null attributes are an empty object."""
    held = F.filter(attributes, lambda a: (a["key"] != "") & present(a["value"]))

    def last(held: Column) -> Column:
        keys = F.transform(held, lambda a: a["key"])
        later = lambda a, i: ~F.exists(F.slice(held, i + 2, F.size(held) + 1), lambda x: x["key"] == a["key"])
        return F.when(F.size(F.array_distinct(keys)) == F.size(keys), held).otherwise(F.filter(held, later))

    members = F.transform(F.array_sort(bound(held, last)), lambda a: F.concat(json_string(a["key"]), F.lit(":"), rendered(a["value"])))
    return F.when(F.size(attributes) > 0, F.concat(F.lit("{"), F.array_join(members, ","), F.lit("}"))).otherwise("{}")


def hex_id(text: Column, size: int) -> Column:
    """An id of ``size`` bytes in lower-case hex; null if it isn't one."""
    return F.when(F.lower(text).rlike(f"^[0-9a-f]{{{2 * size}}}$"), F.lower(text))


def enumerated(value: Column, names: tuple[str, ...], prefix: str) -> Column:
    """An enumeration given by number or by name; what isn't known is the first."""
    by_number = reduce(lambda w, x: w.when(value == str(x[0]), x[1]), list(enumerate(names))[1:], F.when(value == "0", names[0]))
    by_name = F.regexp_replace(value, f"^{prefix}", "")
    return F.coalesce(by_number, F.when(by_name.isin(*names), by_name), F.lit(names[0]))


def long(value: Column) -> Column:
    return value.try_cast("bigint")


def positive(value: Column) -> Column:
    """A number, or null for 0: the protocol has no missing numbers."""
    return F.nullif(long(value), F.lit(0).cast("bigint"))


def unnested(requests: DataFrame, signal: str, unreadable: bool = False) -> DataFrame:
    """One row per item (column ``x``) with its place in the request (``At``), the hashes and contents of its
    resource and scope, whether the request gives none (``ResourceMissing``, ``ScopeMissing``), and whether the
    request may list items in several places (``Several``, told by its text, so that a filter by it comes before parsing).
    ``requests`` has the JSON text in ``value``; its other columns are kept. A text that isn't JSON, or is null, has no items;
    with ``unreadable`` it gives one row all the same, with ``Unreadable`` (null in the others): the text, or nothing for a null one."""
    outer, inner, items, schema = SIGNALS[signal]
    shape = f"struct<{outer}:array<struct<{_RESOURCE},{inner}:array<struct<{_SCOPE},{items}:array<struct<{schema}>>>>>>,__bad:string>"
    kept = [c for c in requests.columns if c != "value"]
    text, name = F.col("value"), f'"{items}"'
    again = F.length(text) - F.length(F.replace(text, F.lit(name), F.lit(""))) > len(name)
    several = F.coalesce(again | text.contains("\\u"), F.lit(False))  # a key may be written with escapes
    read = plain_lists(requests).select(*kept, several.alias("Several"), "value", F.from_json("value", shape, {"columnNameOfCorruptRecord": "__bad"}).alias("p"))
    kept.append("Several")
    explode = F.posexplode
    if unreadable:
        # what can be read in part has items and is no bad request
        bad = F.col("value").isNull() | F.col("p").isNull() | (F.col("p.__bad").isNotNull() & F.col(f"p.{outer}").isNull())
        read, explode = read.withColumn("Unreadable", F.when(bad, F.coalesce("value", F.lit("")))), F.posexplode_outer
        kept.append("Unreadable")
    some = lambda df, c: df.where(F.col(c).isNotNull() | F.col("Unreadable").isNotNull()) if unreadable else df
    a = some(read.select(*kept, explode(f"p.{outer}").alias("ri", "r")), "r")
    b = some(a.select(*kept, "ri", F.col("r.resource").alias("res"), F.col("r.schemaUrl").alias("ResourceSchemaUrl"), explode(f"r.{inner}").alias("si", "s")), "s")
    c = b.select(
        *kept,
        F.col("res").isNull().alias("ResourceMissing"),
        F.when(F.col("res").isNotNull(), attributes_json(F.col("res.attributes"))).alias("ResourceAttributesJson"),
        F.nullif("ResourceSchemaUrl", F.lit("")).alias("ResourceSchemaUrl"),
        F.col("s.scope").isNull().alias("ScopeMissing"),
        F.when(F.col("s.scope").isNotNull(), F.coalesce("s.scope.name", F.lit(""))).alias("ScopeName"),
        F.nullif("s.scope.version", F.lit("")).alias("ScopeVersion"),
        F.nullif("s.schemaUrl", F.lit("")).alias("ScopeSchemaUrl"),
        F.when(F.col("s.scope").isNotNull(), attributes_json(F.col("s.scope.attributes"))).alias("ScopeAttributesJson"),
        "ri",
        "si",
        explode(f"s.{items}").alias("ii", "x"),
    )
    placed = some(c, "x").withColumn("At", F.struct("ri", "si", "ii")).drop("ri", "si", "ii")
    return with_scope_hash(with_resource_hash(placed))


def spans(requests: DataFrame, unreadable: bool = False) -> DataFrame:
    """Spans with nested ``Events`` and ``Links``; ``Rejected`` says why a span can't be stored, else null. Links
    with a bad id are dropped; a link without a trace state has ``unknown``. For ``unreadable`` see :func:`unnested`."""
    x = lambda name: F.col(f"x.{name}")
    none = F.array().cast
    events = F.transform(F.coalesce(x("events"), none(f"array<struct<timeUnixNano:string,name:string,attributes:{_ATTRIBUTES},droppedAttributesCount:int>>")), lambda e: F.named_struct(F.lit("Name"), e["name"], F.lit("TimeUnixNano"), F.coalesce(long(e["timeUnixNano"]), F.lit(0)), F.lit("DroppedAttributesCount"), F.coalesce(e["droppedAttributesCount"], F.lit(0)), F.lit("AttributesJson"), attributes_json(e["attributes"])))
    links = F.transform(F.coalesce(x("links"), none(f"array<struct<traceId:string,spanId:string,traceState:string,attributes:{_ATTRIBUTES},droppedAttributesCount:int>>")), lambda e: F.named_struct(F.lit("LinkedTraceId"), hex_id(e["traceId"], 16), F.lit("LinkedSpanId"), hex_id(e["spanId"], 8), F.lit("TraceState"), F.coalesce(F.nullif(e["traceState"], F.lit("")), F.lit("unknown")), F.lit("DroppedAttributesCount"), F.coalesce(e["droppedAttributesCount"], F.lit(0)), F.lit("AttributesJson"), attributes_json(e["attributes"])))
    return unnested(requests, "traces", unreadable).select(
        "*",
        hex_id(x("traceId"), 16).alias("TraceId"),
        hex_id(x("spanId"), 8).alias("SpanId"),
        hex_id(x("parentSpanId"), 8).alias("ParentSpanId"),
        F.coalesce(x("name"), F.lit("")).alias("Name"),
        enumerated(x("kind"), SPAN_KINDS, "SPAN_KIND_").alias("Kind"),
        F.coalesce(long(x("startTimeUnixNano")), F.lit(0)).alias("StartTimeUnixNano"),
        F.coalesce(long(x("endTimeUnixNano")), F.lit(0)).alias("EndTimeUnixNano"),
        *[F.coalesce(x(f"dropped{n}Count"), F.lit(0)).alias(f"Dropped{n}Count") for n in ("Attributes", "Events", "Links")],
        F.nullif(x("traceState"), F.lit("")).alias("TraceState"),
        enumerated(x("status.code"), STATUS_CODES, "STATUS_CODE_").alias("StatusCode"),
        F.nullif(x("status.message"), F.lit("")).alias("StatusMessage"),
        attributes_json(x("attributes")).alias("AttributesJson"),
        events.alias("Events"),
        F.filter(links, lambda e: e["LinkedTraceId"].isNotNull() & e["LinkedSpanId"].isNotNull()).alias("Links"),
        F.when(hex_id(x("traceId"), 16).isNull(), "trace id").when(hex_id(x("spanId"), 8).isNull(), "span id").alias("Rejected"),
    ).drop("x")


def log_records(requests: DataFrame, unreadable: bool = False) -> DataFrame:
    """Log records; times and severity 0 and empty texts are null. A missing body has the type STRING. A body's number is
    shown as it is, be it NaN or infinite."""
    x = lambda name: F.col(f"x.{name}")
    body = lambda name: F.col(f"x.body.{name}")
    kind = F.coalesce(*[F.when(body(m).isNotNull(), F.lit(k)) for m, k in _BODIES], F.lit("STRING"))
    value = F.coalesce(body("stringValue"), body("bytesValue"), F.when(F.coalesce(body("boolValue"), body("intValue")).isNull(), body("doubleValue")), rendered(x("body")))
    return unnested(requests, "logs", unreadable).select(
        "*",
        positive(x("timeUnixNano")).alias("TimeUnixNano"),
        positive(x("observedTimeUnixNano")).alias("ObservedTimeUnixNano"),
        positive(x("severityNumber")).cast("int").alias("SeverityNumber"),
        F.nullif(x("severityText"), F.lit("")).alias("SeverityText"),
        kind.alias("BodyType"),
        value.alias("BodyValue"),
        F.coalesce(x("droppedAttributesCount"), F.lit(0)).alias("DroppedAttributesCount"),
        F.coalesce(x("flags"), F.lit(0)).alias("Flags"),
        hex_id(x("traceId"), 16).alias("TraceId"),
        hex_id(x("spanId"), 8).alias("SpanId"),
        attributes_json(x("attributes")).alias("AttributesJson"),
    ).drop("x")


#: Member of a metric for each type.
MEMBERS = {"GAUGE": "gauge", "SUM": "sum", "HISTOGRAM": "histogram", "EXPONENTIAL_HISTOGRAM": "exponentialHistogram", "SUMMARY": "summary"}


def metrics(requests: DataFrame, unreadable: bool = False) -> DataFrame:
    """Metrics with their ``Type`` and the item ``x``; ``Rejected`` for one without data. ``Points`` counts."""
    kind = F.coalesce(*[F.when(F.col(f"x.{m}").isNotNull(), F.lit(k)) for k, m in MEMBERS.items()])
    points = F.coalesce(*[F.size(f"x.{m}.dataPoints") for m in MEMBERS.values()], F.lit(0))
    return unnested(requests, "metrics", unreadable).select("*", F.coalesce("x.name", F.lit("")).alias("Name"), F.nullif("x.description", F.lit("")).alias("Description"), F.nullif("x.unit", F.lit("")).alias("Unit"), kind.alias("Type"), F.greatest(points, F.lit(0)).alias("Points"), F.when(kind.isNull(), "no data").alias("Rejected"))


def points(metric_rows: DataFrame, kind: str) -> DataFrame:
    """The points of one type of rows from :func:`metrics` that have a ``MetricId``; ``Exemplar`` is the first."""
    member = MEMBERS[kind]
    temporality = {} if kind in ("GAUGE", "SUMMARY") else {"AggregationTemporality": enumerated(F.col(f"x.{member}.aggregationTemporality"), TEMPORALITIES, "AGGREGATION_TEMPORALITY_")}
    monotonic = {"IsMonotonic": F.coalesce(F.col("x.sum.isMonotonic"), F.lit(False))} if kind == "SUM" else {}
    rows = metric_rows.where(F.col("Type") == kind).select("MetricId", *[c.alias(n) for n, c in (temporality | monotonic).items()], F.posexplode(f"x.{member}.dataPoints").alias("Place", "p"))
    p = lambda name: F.col(f"p.{name}")
    longs = lambda name: F.coalesce(F.transform(p(name), long), F.array().cast("array<bigint>"))
    own = {"TimeUnixNano": F.coalesce(long(p("timeUnixNano")), F.lit(0)), "StartTimeUnixNano": positive(p("startTimeUnixNano")), "Flags": F.coalesce(p("flags"), F.lit(0)), "AttributesJson": attributes_json(p("attributes"))}
    if kind in ("GAUGE", "SUM"):
        own |= {"ValueDouble": p("asDouble"), "ValueInt": long(p("asInt"))}
    else:
        own |= {"Count": F.coalesce(long(p("count")), F.lit(0)), "SumValue": p("sum")}
    if kind in ("HISTOGRAM", "EXPONENTIAL_HISTOGRAM"):
        own |= {"Min_Value": p("min"), "Max_Value": p("max")}
    if kind == "HISTOGRAM":
        own |= {"BucketCounts": longs("bucketCounts"), "ExplicitBounds": F.coalesce(p("explicitBounds"), F.array().cast("array<double>"))}
    if kind == "EXPONENTIAL_HISTOGRAM":
        own |= {"Scale": F.coalesce(p("scale"), F.lit(0)), "ZeroCount": F.coalesce(long(p("zeroCount")), F.lit(0))}
        for side in ("positive", "negative"):
            own |= {f"{side.title()}Offset": p(f"{side}.offset"), f"{side.title()}BucketCounts": longs(f"{side}.bucketCounts")}
    if kind == "SUMMARY":
        own |= {"SumValue": F.coalesce(p("sum"), F.lit(0.0)), "QuantileValues": F.coalesce(F.transform(p("quantileValues"), lambda q: F.named_struct(F.lit("Quantile"), q["quantile"], F.lit("Value"), q["value"])), F.array().cast("array<struct<Quantile:double,Value:double>>"))}
    else:
        e = F.get(p("exemplars"), F.lit(0))
        own |= {"Exemplar": F.when(e.isNotNull(), F.named_struct(F.lit("FilteredAttributes"), attributes_json(e["filteredAttributes"]), F.lit("TimeUnixNano"), F.coalesce(long(e["timeUnixNano"]), F.lit(0)), F.lit("ValueDouble"), e["asDouble"], F.lit("ValueInt"), long(e["asInt"]), F.lit("SpanId"), hex_id(e["spanId"], 8), F.lit("TraceId"), hex_id(e["traceId"], 16)))}
    return rows.select("MetricId", "Place", *[c for c in temporality | monotonic], *[c.alias(n) for n, c in own.items()])
