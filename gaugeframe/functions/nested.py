"""Nested JSON values in expressions: walks of any depth in one projection, and a canonical form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from gaugeframe.functions.columns import number_text

FOUND = "array<struct<tag:int,path:string,node:variant>>"
_OPENED = "array<struct<tag:int,path:string,node:variant,fields:map<string,variant>,items:array<variant>>>"
MOST_NESTING = 1000  # what the JSON parser takes


def fields_of(node: Column) -> Column:
    """The fields of an object, null for anything else."""
    return node.try_cast("map<string,variant>")


def items_of(node: Column) -> Column:
    """The items of a list, null for anything else."""
    return node.try_cast("array<variant>")


def nesting_bound(text: Column) -> Column:
    """No JSON text is nested deeper than it has opening brackets, nor than the parser takes."""
    return F.least(F.length(text) - F.length(F.translate(text, "[{", "")), F.lit(MOST_NESTING))


def entry(tag: Column, path: Column, node: Column) -> Column:
    return F.struct(tag.alias("tag"), path.alias("path"), node.alias("node"))


def unfold(
    found: Column,
    most: Column,
    key_step: Callable[[Column, Column], Column],
    item_step: Callable[[Column, Column], Column],
    into_lists: bool = True,
    keep_hollow: bool = False,
    too_deep: Column | None = None,
) -> Column:
    """What lies below the given entries (``FOUND``), level by level while any entry is nested.

    ``key_step(path, key)`` and ``item_step(path, index)`` give the path of a part. Empty objects and lists vanish
    unless ``keep_hollow``; lists are taken as they are unless ``into_lists``. At most ``most`` levels are opened;
    what is nested even then stays, or fails with the text ``too_deep``. The whole walk is one expression
    whose size doesn't depend on the depth.
    """
    filled = (lambda parts: F.size(parts) > 0) if keep_hollow else (lambda parts: parts.isNotNull())

    def opened(e: Column) -> Column:
        """The entry with its parts, taken out of the value once."""
        whole = fields_of(e["node"])
        object_ = F.transform(F.array(whole), lambda fields: F.when(filled(fields), fields))
        return F.transform(object_, lambda fields: F.struct(
            e["tag"].alias("tag"), e["path"].alias("path"), e["node"].alias("node"), fields.alias("fields"),
            F.when(fields.isNull(), listed(e["node"])).alias("items"),
        ))[0]

    def listed(node: Column) -> Column:
        if not into_lists:
            return F.lit(None).cast("array<variant>")
        return F.transform(F.array(items_of(node)), lambda items: F.when(filled(items), items))[0]

    def parts(e: Column) -> Column:
        below = F.transform(F.map_entries(e["fields"]), lambda f: opened(entry(e["tag"], key_step(e["path"], f["key"]), f["value"])))
        items = F.transform(e["items"], lambda v, i: opened(entry(e["tag"], item_step(e["path"], i.cast("string")), v)))
        return F.when(e["fields"].isNotNull(), below).when(e["items"].isNotNull(), items).otherwise(F.array(e)).cast(_OPENED)

    def state(found: Column) -> Column:
        open_ = lambda one: F.exists(one, lambda e: e["fields"].isNotNull() | e["items"].isNotNull())
        made = F.transform(F.array(found), lambda one: F.struct(open_(one).alias("open"), one.alias("found")))
        return F.get(made, F.lit(0)).cast(f"struct<open:boolean,found:{_OPENED}>")

    level = lambda acc, _: F.when(acc["open"], state(F.flatten(F.transform(acc["found"], parts)).cast(_OPENED))).otherwise(acc)
    plain = lambda found: F.transform(found, lambda e: entry(e["tag"], e["path"], e["node"]))
    done = (lambda acc: plain(acc["found"])) if too_deep is None else (lambda acc: F.when(acc["open"], F.raise_error(too_deep).cast(FOUND)).otherwise(plain(acc["found"]).cast(FOUND)))
    levels = F.when(most > 0, F.sequence(F.lit(1), most)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(levels, state(F.transform(found.cast(FOUND), opened).cast(_OPENED)), level, done)


def _canonical_scalar(node: Column) -> Column:
    kind = F.schema_of_variant(node)
    number = F.try_variant_get(node, "$", "double")
    whole = (number == F.floor(number)) & (F.abs(number) < 1e15)
    text = F.try_variant_get(node, "$", "string")
    return (
        F.when(kind == "STRING", F.concat(F.lit("s"), text))
        .when(kind == "BIGINT", F.concat(F.lit("n"), text))
        .when(kind == "BOOLEAN", F.when(F.try_variant_get(node, "$", "boolean"), "n1").otherwise("n0"))
        .when(kind == "VOID", "z")
        .when(fields_of(node).isNotNull(), "o")
        .when(items_of(node).isNotNull(), "a")
        .when(whole, F.concat(F.lit("n"), number.cast("bigint").cast("string")))
        .otherwise(F.concat(F.lit("n"), number_text(number)))
    )


def canonical_digest(node: Column, most: Column) -> Column:
    """SHA-256 of a nested value that is the same for values Python finds equal: the order of keys doesn't count, ``1``, ``1.0`` and ``true`` are one."""
    sized = lambda text: F.concat(F.length(text).cast("string"), F.lit(":"), text)
    leaves = unfold(
        F.array(entry(F.lit(0), F.lit(""), node)), most,
        lambda path, key: F.concat(path, F.lit("k"), sized(key)), lambda path, i: F.concat(path, F.lit("i"), i, F.lit(";")), keep_hollow=True,
    )
    spelt = F.transform(leaves, lambda e: F.concat(sized(e["path"]), sized(_canonical_scalar(e["node"]))))
    return F.sha2(F.array_join(F.array_sort(spelt), ""), 256)


def truthy(node: Column) -> Column:
    """Whether Python takes the value as true: not null, false, 0, an empty text, list or object. The text ``0`` is."""
    kind = F.schema_of_variant(node)
    return F.coalesce(
        F.when(fields_of(node).isNotNull(), F.size(fields_of(node)) > 0)
        .when(items_of(node).isNotNull(), F.size(items_of(node)) > 0)
        .when(kind == "VOID", False)
        .when(kind == "STRING", F.try_variant_get(node, "$", "string") != "")
        .when(kind == "BOOLEAN", F.try_variant_get(node, "$", "boolean"))
        .otherwise(F.try_variant_get(node, "$", "double") != 0),
        F.lit(False),
    )
