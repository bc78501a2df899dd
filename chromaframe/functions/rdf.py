"""Metadata packets in XML columns (RDF): properties as rows, and as a tree.

The packet is cut into tags with the text that follows them, and a fold over these carries the open elements. Properties are attributes of a
description or elements; items of arrays have their number, fields of structures and qualifiers a path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Elements that stand for no property of their own. Fixed values of the format.
CONTAINERS = ("x:xmpmeta", "x:xapmeta", "rdf:RDF", "rdf:Description", "rdf:Seq", "rdf:Bag", "rdf:Alt")
_TAG = r"""<(?:[^>"']|"[^"]*"|'[^']*')*>"""
_ATTRIBUTE = r"""[A-Za-z_][A-Za-z0-9_.:-]*\s*=\s*(?:"[^"]*"|'[^']*')"""
_LEAF = "struct<property:string,value:string>"
_OPEN = "struct<name:string,path:string,items:int>"
#: Named characters. Fixed values; the ampersand is the last to be put in.
_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&"))


def _plain(text: Column) -> Column:
    for name, character in _ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(character))
    return text


def _leaf(name: Column, value: Column) -> Column:
    return F.struct(name.alias("property"), value.alias("value"))


def _below(path: Column, name: Column) -> Column:
    return F.when(path == "", name).otherwise(F.concat(path, F.lit("/"), name))


def packet_leaves(xml: Column) -> Column:
    """struct<leaves: array<struct<property, value>>, error> of a packet, in document order; empty values are left out."""
    none = F.array().cast(f"array<{_LEAF}>")
    tokens = F.regexp_extract_all(F.regexp_replace(xml, r"(?s)<!--.*?-->|<\?.*?\?>|<![^>]*>", ""), F.lit(f"{_TAG}[^<]*"), F.lit(0))

    def step(acc: Column, token: Column) -> Column:
        tag = F.regexp_extract(token, f"^{_TAG}", 0)
        text = F.substring(token, F.length(tag) + 1, F.length(token))
        name = F.regexp_extract(tag, r"^</?([^\s/>]+)", 1)
        closes, alone = F.startswith(tag, F.lit("</")), F.endswith(tag, F.lit("/>"))
        depth = F.size(acc["stack"])
        top = F.when(depth > 0, F.element_at(acc["stack"], -1)).otherwise(F.struct(F.lit("").alias("name"), F.lit("").alias("path"), F.lit(0).alias("items")))
        item = name == "rdf:li"
        path = F.when(name.isin(*CONTAINERS), top["path"]).when(item, F.concat(top["path"], F.lit("["), (top["items"] + 1).cast("string"), F.lit("]"))).otherwise(_below(top["path"], name))
        attributes = F.transform(F.regexp_extract_all(tag, F.lit(_ATTRIBUTE), F.lit(0)), lambda a: _leaf(F.regexp_extract(a, r"^[^\s=]+", 0), _plain(F.regexp_extract(a, r"(?s)=\s*.(.*).$", 1))))
        own = lambda a: a["property"]
        wanted = F.filter(attributes, lambda a: ((own(a) == "rdf:resource") | ~F.regexp_like(own(a), F.lit("^(xmlns|rdf:|x:)"))) & ~F.startswith(own(a), F.lit("xmlns")))
        named = F.transform(wanted, lambda a: _leaf(F.when(own(a) == "rdf:resource", path).when(own(a) == "xml:lang", _below(path, F.lit("?xml:lang"))).otherwise(_below(path, own(a))), a["value"]))
        said = F.when(~alone & ~name.isin(*CONTAINERS) & (F.trim(F.regexp_replace(text, r"\s+", " ")) != ""), F.array(_leaf(path, _plain(text)))).otherwise(none)
        counted = F.when(item & (depth > 0), F.concat(F.slice(acc["stack"], 1, F.greatest(depth - 1, F.lit(0))), F.array(F.struct(top["name"].alias("name"), top["path"].alias("path"), (top["items"] + 1).alias("items"))))).otherwise(acc["stack"])
        pushed = F.when(alone, counted).otherwise(F.concat(counted, F.array(F.struct(name.alias("name"), path.alias("path"), F.lit(0).alias("items")))))
        opened = F.struct(pushed.alias("stack"), F.concat(acc["leaves"], named, said).alias("leaves"), acc["bad"].alias("bad"))
        closed = F.struct(F.slice(acc["stack"], 1, F.greatest(depth - 1, F.lit(0))).alias("stack"), acc["leaves"].alias("leaves"), (acc["bad"] | (top["name"] != name)).alias("bad"))
        return F.when(closes, closed).otherwise(opened)

    first = F.struct(F.array().cast(f"array<{_OPEN}>").alias("stack"), none.alias("leaves"), F.lit(False).alias("bad"))

    def last(acc: Column) -> Column:
        leaves = F.filter(acc["leaves"], lambda x: x["value"] != "")
        error = F.when(acc["bad"] | (F.size(acc["stack"]) > 0), "elements are not closed in order").when(F.size(leaves) == 0, "no properties found")
        return F.struct(F.when(error.isNull(), leaves).alias("leaves"), error.alias("error"))

    found = F.aggregate(tokens, first, step, last)
    return F.when(xml.isNull(), F.struct(F.lit(None).cast(f"array<{_LEAF}>").alias("leaves"), F.lit("no properties found").alias("error"))).otherwise(found)


def leaf_rows(packets: DataFrame, key: str, xml: str) -> DataFrame:
    """key, ord, property, value and error: a row per property, one with an error for a packet that is broken or has none.

    A property that comes again takes the place of the first with the last value.
    """
    each = packets.select(F.col(key), packet_leaves(F.col(xml)).alias("p")).select(key, "p.error", F.posexplode_outer("p.leaves").alias("ord", "leaf"))
    rows = each.select(key, "ord", F.col("leaf.property").alias("property"), F.col("leaf.value").alias("value"), "error")
    return rows.groupBy(key, "property").agg(F.min("ord").alias("ord"), F.max_by("value", "ord").alias("value"), F.max("error").alias("error"))


def tree_rows(leaves: DataFrame, key: str) -> DataFrame:
    """key, ord, path, depth, name and value of each property as a node: its path is split after colons and slashes."""
    parts = F.regexp_extract_all("property", F.lit("[^:/]*[:/]|[^:/]+"), F.lit(0))
    rows = leaves.where("property is not null").select(key, "ord", parts.alias("parts"), "value")
    return rows.select(key, "ord", F.array_join(F.concat(F.array(F.lit("XMP")), F.slice("parts", 1, F.size("parts") - 1)), "/").alias("path"), F.size("parts").alias("depth"), F.element_at("parts", -1).alias("name"), "value")


def orientation_rows(leaves: DataFrame, key: str) -> DataFrame:
    """key and orientation, 1 to 8 or 0."""
    found = F.max(F.when(F.col("property") == "tiff:Orientation", F.col("value"))).try_cast("int")
    return leaves.groupBy(key).agg(found.alias("o")).select(key, F.when(F.col("o").between(1, 8), F.col("o")).otherwise(0).alias("orientation"))
