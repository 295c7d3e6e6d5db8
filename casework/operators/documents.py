"""JSON documents held against rules, with the path of everything that breaks one.

A document is a VARIANT. Its values are walked one level at a time with ``variant_explode``,
only where some rule lies further down, so the number of steps is the depth of the rules and
not of the data. Rules are a table (``rule_path, keyword, ...``) joined on the path, in which
``[]`` stands for every element of an array; :func:`compile_schema` makes it from a JSON
Schema. Everything is a built-in expression.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import written

#: Keywords of JSON Schema that are checked, by what they apply to. Fixed values.
CHECKED = {
    "any": ["type", "enum", "const"],
    "object": ["required", "additionalProperties"],
    "array": ["minItems", "maxItems", "uniqueItems"],
    "string": ["minLength", "maxLength", "pattern", "format"],
    "number": ["minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "multipleOf"],
}
#: Keywords that say nothing about an instance. Fixed values.
REMARKS = {"$schema", "$id", "$defs", "definitions", "$comment", "$anchor", "title", "description", "examples", "default", "deprecated", "readOnly", "writeOnly"}
#: Formats that are checked, as patterns. Fixed values.
FORMATS = {
    "date": r"^\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])$",
    "date-time": r"^\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])[Tt]([01]\d|2[0-3]):[0-5]\d:([0-5]\d|60)(\.\d+)?([Zz]|[+-]\d\d:\d\d)$",
    "email": r"@",
    "uuid": r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
}
RULES = "rule_path string, keyword string, text string, number double, options array<string>"


def compile_schema(schema: dict) -> list[tuple]:
    """Rows of ``RULES`` from a schema: nested ``properties`` and ``items``, local ``$ref`` and ``allOf`` are resolved; a keyword outside ``CHECKED`` is an error, as a rule must not be passed over silently."""
    out: list[tuple] = []
    known = {k for kinds in CHECKED.values() for k in kinds}

    def resolve(node: dict, seen: tuple = ()) -> list[dict]:
        ref = node.get("$ref")
        if ref is not None:
            if ref in seen:
                raise ValueError(f"{ref} refers to itself")
            at = schema
            for part in ref.removeprefix("#").strip("/").split("/"):
                at = at[part] if part else at
            return resolve(at, (*seen, ref)) + resolve({k: v for k, v in node.items() if k != "$ref"}, seen)
        found = [node]
        for part in node.get("allOf", []):
            found += resolve(part, seen)
        return found

    def walk(node, path: str, above: tuple) -> None:
        if node is True or node == {}:
            return
        if id(node) in above:
            raise ValueError(f"the schema holds itself at {path or '<root>'}")
        for part in resolve(node):
            for keyword, value in part.items():
                if keyword == "properties":
                    for name, child in value.items():
                        walk(child, f"{path}.{name}", (*above, id(node)))
                elif keyword == "items":
                    walk(value, f"{path}[]", (*above, id(node)))
                elif keyword == "required":
                    out.extend((path, keyword, name, None, None) for name in value)
                elif keyword == "additionalProperties":
                    if value is False:
                        out.append((path, keyword, None, None, sorted(part.get("properties", {}))))
                    elif value is not True:
                        raise ValueError("additionalProperties must be true or false")
                elif keyword == "type":
                    kinds = [value] if isinstance(value, str) else value
                    out.append((path, keyword, ", ".join(map(repr, kinds)), None, kinds))
                elif keyword in ("enum", "const"):
                    values = value if keyword == "enum" else [value]
                    out.append((path, keyword, repr(value), None, [_text(v) for v in values]))
                elif keyword == "format":
                    if value in FORMATS:
                        out.append((path, keyword, value, None, [FORMATS[value]]))
                elif keyword in known:
                    if keyword != "uniqueItems" or value:
                        out.append((path, keyword, str(value), None if keyword in ("pattern", "uniqueItems") else float(value), None))
                elif keyword not in REMARKS | {"$ref", "allOf"}:
                    raise ValueError(f"{keyword} is not supported")

    walk(schema, "", ())
    return out


def _text(value) -> str:
    """A JSON value as the text that it is compared by; a number like 2.0 counts as 2."""
    if isinstance(value, float) and value.is_integer():
        value = int(value)
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"), sort_keys=True)


def rule_table(spark: SparkSession, schema: dict) -> DataFrame:
    return spark.createDataFrame(compile_schema(schema), RULES)


def _known(nodes: DataFrame) -> DataFrame:
    """Adds what the rules ask of a value: its JSON text, kind, number, string, keys and size."""
    first = F.substring("json", 1, 1)
    number = F.when(first.rlike("[-0-9]"), F.col("json").try_cast("double"))
    kind = (
        F.when(F.col("value").isNull(), "broken").when(first == "{", "object").when(first == "[", "array").when(first == '"', "string").when(first == "n", "null").when(first.isin("t", "f"), "boolean")
        .when(number == F.floor(number), "integer").otherwise("number")
    )
    rows = nodes.withColumn("json", F.to_json("value")).withColumn("kind", kind).withColumn("number", number)
    return rows.withColumns(
        {
            "string": F.when(F.col("kind") == "string", F.try_variant_get("value", "$", "string")),
            "keys": F.when(F.col("kind") == "object", F.json_object_keys("json")),
            "size": F.when(F.col("kind") == "array", F.json_array_length("json")),
            "compared": F.when(F.col("kind") == "integer", F.coalesce(F.col("number").try_cast("long").cast("string"), F.col("json"))).otherwise(F.col("json")),
        }
    )


def _repr(text, kind, string):
    """A value as Python would show it, containers as JSON."""
    quoted = F.when(F.contains(string, F.lit("'")) & ~F.contains(string, F.lit('"')), F.concat(F.lit('"'), F.replace(string, F.lit("\\"), F.lit("\\\\")), F.lit('"'))).otherwise(
        F.concat(F.lit("'"), F.replace(F.replace(string, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("'"))
    )
    return F.when(kind == "string", quoted).when(kind == "null", "None").when(text == "true", "True").when(text == "false", "False").otherwise(text)


def _broken(nodes: DataFrame) -> DataFrame:
    """Rows of values joined with their rules, those that break one, with a message."""
    c, arg, limit = F.col, F.col("rule_text"), F.col("rule_number")
    shown, is_number, is_string = _repr(c("json"), c("kind"), c("string")), c("number").isNotNull() & c("kind").isin("integer", "number"), c("kind") == "string"
    plain = F.regexp_replace(arg, r"\.0$", "")
    extra = F.array_sort(F.array_except("keys", "options"))
    say = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    listed = F.array_join(F.transform(extra, lambda k: F.concat(F.lit("'"), k, F.lit("'"))), ", ")
    short = F.when(limit == 1, say(shown, " should be non-empty")).otherwise(say(shown, " is too short"))
    rules = {
        "type": (~F.array_contains("options", c("kind")) & ~((c("kind") == "integer") & F.array_contains("options", F.lit("number"))), say(shown, " is not of type ", arg)),
        "enum": (~F.array_contains("options", c("compared")), say(shown, " is not one of ", arg)),
        "const": (~F.array_contains("options", c("compared")), say(arg, " was expected")),
        "required": (c("keys").isNotNull() & ~F.array_contains("keys", arg), say("'", arg, "' is a required property")),
        "additionalProperties": (F.size(extra) > 0, say("Additional properties are not allowed (", listed, F.when(F.size(extra) == 1, " was").otherwise(" were"), " unexpected)")),
        "minItems": (c("size") < limit, short),
        "maxItems": (c("size") > limit, F.when(limit == 0, say(shown, " is expected to be empty")).otherwise(say(shown, " is too long"))),
        "uniqueItems": (c("size").isNotNull() & (F.size(F.array_distinct(F.transform(F.try_variant_get("value", "$", "array<variant>"), lambda v: F.to_json(v)))) < c("size")), say(shown, " has non-unique elements")),
        "minLength": (is_string & (F.length("string") < limit), short),
        "maxLength": (is_string & (F.length("string") > limit), say(shown, " is too long")),
        "pattern": (is_string & ~F.regexp(c("string"), arg), say(shown, " does not match '", arg, "'")),
        "format": (is_string & (~F.regexp(c("string"), c("options")[0]) | (arg == "date") & F.to_date(F.try_to_timestamp("string")).isNull()), say(shown, " is not a '", arg, "'")),
        "minimum": (is_number & (c("number") < limit), say(shown, " is less than the minimum of ", plain)),
        "maximum": (is_number & (c("number") > limit), say(shown, " is greater than the maximum of ", plain)),
        "exclusiveMinimum": (is_number & (c("number") <= limit), say(shown, " is less than or equal to the minimum of ", plain)),
        "exclusiveMaximum": (is_number & (c("number") >= limit), say(shown, " is greater than or equal to the maximum of ", plain)),
        "multipleOf": (is_number & (F.abs(c("number") / limit - F.round(c("number") / limit)) > 1e-9), say(shown, " is not a multiple of ", plain)),
    }
    fails, message = F.lit(False), F.lit(None).cast("string")
    for keyword, (condition, words) in rules.items():
        fails = F.when(c("keyword") == keyword, F.coalesce(condition, F.lit(False))).otherwise(fails)
        message = F.when(c("keyword") == keyword, words).otherwise(message)
    return nodes.filter(fails).withColumn("message", message)


def schema_errors(documents: DataFrame, schema: dict, line: str = "line", text: str = "text") -> DataFrame:
    """A row for every rule that a document breaks: ``line, path, keyword, message``.

    ``line`` names the document (of a file: its number there), ``path`` the value: names and
    positions from 0, joined by dots, ``<root>`` for the document itself. Text that is no
    JSON breaks the rule ``json``. Null text is no document and gives no row. Numbers are
    compared in double precision.
    """
    spark = documents.sparkSession
    # Every level of the rules parses the texts; what makes them (joins, groups) is done once.
    documents = written(documents.filter(F.col(text).isNotNull()).select(line, text), "documents")
    rules = rule_table(spark, schema).withColumnsRenamed({"text": "rule_text", "number": "rule_number"})
    paths = {r[0] for r in compile_schema(schema)}
    nodes = documents.select(F.col(line).alias("line"), F.lit("").alias("path"), F.lit("").alias("rule_path"), F.expr(f"try_parse_json(`{text}`)").alias("value"))
    broken = nodes.filter("value IS NULL").select("line", F.lit("<root>").alias("path"), F.lit("json").alias("keyword"), F.lit("text is not JSON").alias("message"))
    nodes, found = nodes.filter("value IS NOT NULL"), [broken]
    steps = lambda p: p.count(".") + p.count("[]")
    ancestors = {p[:i] for p in paths for i in range(len(p)) if p[i] in ".["} | paths
    for level in range(max(map(steps, ancestors), default=0) + 1):
        if level:
            open_ = sorted({p for p in ancestors if steps(p) == level})
            child = nodes.alias("n").lateralJoin(spark.tvf.variant_explode(F.col("n.value").outer()).toDF("pos", "key", "child"))
            name = F.coalesce(F.col("key"), F.col("pos").cast("string"))
            at = F.when(F.col("key").isNull(), F.concat("rule_path", F.lit("[]"))).otherwise(F.concat("rule_path", F.lit("."), "key"))
            nodes = child.select("line", F.concat_ws(".", F.nullif("path", F.lit("")), name).alias("path"), at.alias("rule_path"), F.col("child").alias("value")).filter(F.col("rule_path").isin(open_))
        here = [p for p in paths if steps(p) == level]
        if here:
            joined = _known(nodes).join(F.broadcast(rules.filter(F.col("rule_path").isin(here))), "rule_path")
            found.append(_broken(joined).select("line", F.when(F.col("path") == "", "<root>").otherwise(F.col("path")).alias("path"), "keyword", "message"))
    return reduce(DataFrame.unionByName, found)
