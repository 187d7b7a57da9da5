"""JSON texts as rows of built-in expressions: nesting, keys that repeat, and a walk level by level.

A text is cut into tokens, and each key gets the number of its token, so that keys which repeat in
an object are all kept. Variants then open one level of a document after another: a level is an
array of the nodes there, each with its name, the keys that lead to it and its own JSON. Names
are joined by dots; items of a list have the list's name. All levels stay in the row of the text, so
a walk shuffles nothing and has as many projections as the deepest text has levels.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenledger.functions.text import let

#: Levels beyond which a text is not walked. A fixed value.
MOST_LEVELS = 512
#: Stand for an escaped backslash and an escaped quote, so that strings end at quotes.
_SLASH, _QUOTE = "\ue000", "\ue001"
_TOKEN = r'"[^"]*"|[\[\]{}:,]|[^\s"\[\]{}:,]+'
_NODE = "array<struct<name:string,path:array<string>,json:string>>"


def masked(text: Column) -> Column:
    """A text whose every quote begins or ends a string."""
    return F.replace(F.replace(text, F.lit("\\\\"), F.lit(_SLASH)), F.lit('\\"'), F.lit(_QUOTE))


def unmasked(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(_SLASH), F.lit("\\\\")), F.lit(_QUOTE), F.lit('\\"'))


def decoded(string: Column) -> Column:
    """The value of a JSON string, given without its quotes and masked; null where it is none."""
    return F.try_variant_get(F.try_parse_json(F.concat(F.lit('"'), unmasked(string), F.lit('"'))), "$", "string")


def encoded(name: Column) -> Column:
    """A name as JSON writes it, with its quotes."""
    return F.regexp_replace(F.to_json(F.array(name)), r"^\[|\]$", "")


def levels(text: Column) -> Column:
    """How deep brackets nest in a text that begins with one, up to where more close than open; 0 for other texts and null."""
    only = F.regexp_replace(F.regexp_replace(masked(text), r'"[^"]*("|\z)', ""), r"[^\[\]{}]", "")
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))
    step = lambda at, c: F.when((at["now"] < 0) | (c == ""), at).otherwise(
        F.struct((at["now"] + F.when(c.isin("[", "{"), 1).otherwise(-1)).alias("now"), F.when(c.isin("[", "{"), F.greatest(at["most"], at["now"] + 1)).otherwise(at["most"]).alias("most"))
    )
    return F.when(text.rlike(r"^\s*[\[{]"), F.aggregate(F.split(only, ""), start, step)["most"]).otherwise(0)


def _numbered(tokens: Column) -> Column:
    """The document of these tokens, with the number of its token before each key."""
    key = lambda x, i, all: F.startswith(x, F.lit('"')) & (F.get(all, i + 1) == ":")
    own = lambda all: F.transform(all, lambda x, i: F.when(key(x, i, all), F.concat(F.lit('"'), i.cast("string"), F.lit(":"), F.substring(x, 2, 1 << 30))).otherwise(x))
    return unmasked(F.array_join(let(tokens, own), " "))


def _children(node: Column) -> Column:
    return let(F.try_parse_json(node["json"]), lambda parsed: _opened(node, parsed))


def _opened(node: Column, parsed: Column) -> Column:
    none = F.array().cast(_NODE)
    bare = lambda e: F.regexp_replace(e["key"], "^[0-9]+:", "")
    named = lambda k: F.when(node["name"] == "", k).otherwise(F.concat(node["name"], F.lit("."), k))
    member = lambda e: F.struct(named(bare(e)).alias("name"), F.concat(node["path"], F.array(bare(e))).alias("path"), F.to_json(e["value"]).alias("json"))
    item = lambda v: F.struct(node["name"].alias("name"), node["path"].alias("path"), F.to_json(v).alias("json"))
    members = F.transform(F.map_entries(F.try_variant_get(parsed, "$", "map<string,variant>")), member)
    return F.concat(F.coalesce(members, none), F.coalesce(F.transform(F.try_variant_get(parsed, "$", "array<variant>"), item), none))


def value(node: Column) -> Column:
    """A string's value, and the strings of a list of nothing else joined by a space; null for other nodes."""
    def words(items: Column) -> Column:
        strings = (F.size(items) > 0) & F.forall(items, lambda v: F.startswith(F.to_json(v), F.lit('"')))
        return F.when(strings, F.array_join(F.transform(items, lambda v: F.try_variant_get(v, "$", "string")), " "))

    joined = let(F.try_variant_get(F.try_parse_json(node["json"]), "$", "array<variant>"), words)
    text = F.when(F.startswith(node["json"], F.lit('"')), F.try_variant_get(F.try_parse_json(node["json"]), "$", "string"))
    return F.when(F.startswith(node["json"], F.lit("[")), joined).otherwise(text)


def walk(texts: DataFrame, text: str, wanted: Callable[[Column], Column], most: int = MOST_LEVELS) -> DataFrame:
    """texts with column leaves: array<struct<name, path, value>> of the strings and lists of strings under the names wanted.

    path has the keys that lead to a node. Texts that are no JSON, or deeper than most, have an empty array; null too.
    """
    deep = texts.withColumn("__deep", F.coalesce(levels(F.col(text)), F.lit(0)))
    walked = F.col("__deep").between(1, most)
    told = deep.agg(F.max(F.when(walked, F.col("__deep")))).first()[0] or 0  # one pass over the texts
    df = deep.withColumn("__tokens", F.when(walked, F.regexp_extract_all(masked(F.col(text)), F.lit(_TOKEN), F.lit(0))))
    root = F.struct(F.lit("").alias("name"), F.array().cast("array<string>").alias("path"), _numbered(F.col("__tokens")).alias("json"))
    df = df.withColumn("__nodes", F.when(walked, F.array(root)).otherwise(F.array()).cast(_NODE)).drop("__tokens").withColumn("leaves", F.array().cast("array<struct<name:string,path:array<string>,value:string>>"))
    for level in range(told + 1):
        own = F.transform(F.filter("__nodes", lambda n: wanted(n["name"]) & n["json"].rlike(r'^["\[]')), lambda n: F.struct(n["name"].alias("name"), n["path"].alias("path"), value(n).alias("value")))
        df = df.withColumn("leaves", F.concat("leaves", F.filter(own, lambda x: x["value"].isNotNull())))
        if level < told:
            inner = F.filter("__nodes", lambda n: n["json"].rlike(r"^[\[{]"))
            df = df.withColumn("__nodes", F.flatten(F.transform(inner, _children)))
    return df.drop("__nodes", "__deep")
