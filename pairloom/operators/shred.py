"""Nested records as an adjacency table, and entity tables pivoted from it.

A record becomes nodes: one row a JSON-like value with its parent, label, ordinal and (for leaves) scalar text. Object
nodes and their scalar children are put together again by one grouped pivot, which gives flat entity tables that keep
parent and child. Everything about one record hashes to its root id, so the shredding costs a single exchange.

Defined results: null leaves have no node (a pivot gives null again), null or empty arrays no elements, a null record
only its root. Element order is the ordinal, so repeated elements stay apart. Labels that are not asked for are not
read from storage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NODE = "struct<node:string,parent:string,label:string,ordinal:int,scalar:string>"


def _node(node: Column, parent: Column, label: Column | str, ordinal: Column, scalar: Column) -> Column:
    label = F.lit(label) if isinstance(label, str) else label
    return F.struct(node.alias("node"), parent.alias("parent"), label.alias("label"), ordinal.cast("int").alias("ordinal"), scalar.cast("string").alias("scalar"))


def shred_array(array: str, leaves: list[str], lists: list[str] = (), parent: str = "$") -> Column:
    """Nodes of an array of objects: the object, its leaves and the elements of its lists of scalars.

    ``array`` is a column path; only the named fields are read. Node ids are ordinal paths: ``$.3`` is the fourth
    element, ``$.3.name`` a leaf and ``$.3.tools[0]`` a list element, whose parent is the object node.
    """
    names = [*leaves, *lists]
    zipped = F.arrays_zip(*[F.col(f"{array}.{n}").alias(n) for n in names])

    def one(item: Column, i: Column) -> Column:
        own = F.concat(F.lit(f"{parent}."), i.cast("string"))
        nodes = [_node(own, F.lit(parent), "[]", i, F.lit(None))]
        nodes += [_node(F.concat(own, F.lit(f".{n}")), own, n, F.lit(0), item[n]) for n in leaves]
        kept = F.filter(F.array(*nodes), lambda x: (x["label"] == "[]") | x["scalar"].isNotNull())
        parts = [kept]
        parts += [elements(own, item, n) for n in lists]
        return F.concat(*parts)

    def elements(own: Column, item: Column, n: str) -> Column:
        items = F.coalesce(item[n].cast("array<string>"), F.array().cast("array<string>"))
        return F.transform(items, lambda v, k: _node(F.concat(own, F.lit(f".{n}["), k.cast("string"), F.lit("]")), own, n, k, v))

    return F.coalesce(F.flatten(F.transform(zipped, one)), F.array().cast(f"array<{NODE}>"))


def adjacency(df: DataFrame, root: str, attributes: list[str], arrays: dict[str, tuple[list[str], list[str]]]) -> DataFrame:
    """The adjacency table of ``df``: root, node, parent, label, ordinal, scalar.

    ``attributes`` are scalar columns of the record (labels under the root node ``$``); ``arrays`` maps the path of an
    array of objects to its leaves and lists.
    """
    flat = [F.array(*[_node(F.lit(f"$.{a}"), F.lit("$"), a, F.lit(0), F.col(a)) for a in attributes])] if attributes else []
    for path, (leaves, lists) in arrays.items():
        flat.append(shred_array(path, leaves, lists))
    nodes = F.concat(*[x.cast(f"array<{NODE}>") for x in flat])
    return df.select(F.col(root).alias("root"), F.inline(nodes))


def pivot_objects(nodes: DataFrame, leaves: list[str], lists: list[str] = ()) -> DataFrame:
    """Join every object node with its scalar children: root, node, ordinal, one text column a leaf, one array a list.

    Written as one aggregation by (root, object): an object's own row and its children meet there. List arrays hold an
    element for every ordinal, in order, null elements kept.
    """
    owner = F.when(F.col("label") == "[]", F.col("node")).otherwise(F.col("parent"))
    made = [F.max(F.when(F.col("label") == n, F.col("scalar"))).alias(n) for n in leaves]
    for n in lists:
        entry = F.when(F.col("label") == n, F.struct("ordinal", "scalar"))
        made.append(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["scalar"]).alias(n))
    return nodes.groupBy("root", owner.alias("object")).agg(F.max(F.when(F.col("label") == "[]", F.col("ordinal"))).alias("ordinal"), *made)
