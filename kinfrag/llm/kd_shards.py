"""Shards by a k-d tree over document metadata.

The tree splits the node's widest metadata dimension at a weighted quantile of the bytes: a node
that is to become k shards is cut at floor(k/2)/k of its bytes, down to one shard. All quantiles of
a level are found together and exactly, by four rounds of histograms that narrow a 60-bit key (24
bits of the dimension, 36 of the text's hash) by 15 bits each. Only the bin that the quantile falls
into comes to the driver, one row for each node. A document's shard is then an expression over its
own metadata: nothing is joined, and no key is hot.

Every dimension is metadata of the text alone (its size, and shares of its characters), so equal texts
have equal keys and stay together; the hash only parts texts of equal metadata. A group of equal texts that outweighs a shard's share gets a shard of its own before the tree is built.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinfrag.llm.running import running_sum
from kinfrag.plans.scratch import materialize

SHARDS = 24
#: Bytes that a row has besides its text.
ROW_BYTES = 8
STEP, ROUNDS, TIE_BITS = 15, 4, 36
#: The dimensions with the bounds of their values: logarithm of the size, share of bytes that
#: continue a character, white space of the characters, line feeds of the white space, and
#: punctuation of the characters.
DIMENSIONS = {"log_size": (0.0, 44.0), "wide": (0.0, 1.0), "space": (0.0, 1.0), "lines": (0.0, 1.0), "marks": (0.0, 1.0)}
MARKS = ".,;:!?"


@dataclass
class Node:
    """Shards ``first`` to ``first + shards - 1``; rows with ``dim``'s key under ``cut`` go left."""

    first: int
    shards: int
    dim: str | None = None
    cut: int = 0
    left: Node | None = None
    right: Node | None = None


def shard_of(node: Node) -> Column:
    if node.left is None or node.right is None:
        return F.lit(node.first)
    return F.when(F.col(f"key_{node.dim}") < F.lit(node.cut), shard_of(node.left)).otherwise(shard_of(node.right))


def metadata(docs: DataFrame) -> DataFrame:
    """Per document its size, checksum, hash and a key for each dimension; the text is left behind."""
    chars = F.length("text")

    def number(signs: str) -> Column:
        return chars - F.length(F.translate("text", signs, ""))

    values = {
        "log_size": F.log(F.col("size")),
        "wide": (F.octet_length("text") - chars) / F.col("size"),
        "space": number(" \t\n\r") / F.greatest(F.lit(1), chars),
        "lines": number("\n") / F.greatest(F.lit(1), number(" \t\n\r")),
        "marks": number(MARKS) / F.greatest(F.lit(1), chars),
    }
    keys = {}
    for d, (low, high) in DIMENSIONS.items():
        scaled = ((values[d] - F.lit(low)) / F.lit(high - low) * F.lit(2**24 - 1)).cast("long")
        keys[f"key_{d}"] = F.call_function("shiftleft", scaled, F.lit(TIE_BITS)).bitwiseOR(F.shiftrightunsigned("hash", 64 - TIE_BITS))
    return (
        docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
        .withColumns(
            {
                "size": (F.octet_length("text") + F.lit(ROW_BYTES)).cast("long"),
                "text_crc32": F.crc32(F.col("text").cast("binary")),
                "hash": F.xxhash64("text"),
            }
        )
        .withColumns(keys)
        .drop("text")
    )


def quantiles(rows: DataFrame, open_nodes: dict[int, Node], goals: dict[int, float]) -> None:
    """Sets each node's ``cut`` so that about ``goals`` bytes lie under it."""
    chosen = F.coalesce(*(F.when(F.col("node") == i, F.col(f"key_{n.dim}")) for i, n in open_nodes.items()))
    rows = rows.select("node", "size", chosen.alias("key"))
    prefix = dict.fromkeys(open_nodes, 0)
    under = dict.fromkeys(open_nodes, 0)
    for step in range(ROUNDS):
        shift = STEP * (ROUNDS - 1 - step)
        if step:
            wanted = F.coalesce(*(F.when(F.col("node") == i, F.lit(p)) for i, p in prefix.items()))
            rows = rows.where(F.shiftright("key", shift + STEP) == wanted)
        goal = F.coalesce(*(F.when(F.col("node") == i, F.lit(goals[i] - under[i])) for i in open_nodes))
        upto = Window.partitionBy("node").orderBy("bin")
        hit = (
            rows.groupBy("node", F.shiftright("key", shift).alias("bin"))
            .agg(F.sum("size").alias("bytes"))
            .withColumn("upto", F.sum("bytes").over(upto))
            .where(F.col("upto") >= goal)
            .groupBy("node")
            .agg(F.min(F.struct("bin", "upto", "bytes")).alias("at"))
            .select("node", "at.*")
            .collect()
        )
        for r in hit:
            prefix[r["node"]] = r["bin"]
            under[r["node"]] += r["upto"] - r["bytes"]
            last = r["bytes"]
            node = open_nodes[r["node"]]
            # The group on the quantile goes to the side that ends nearer to its goal.
            node.cut = r["bin"] + (goals[r["node"]] - under[r["node"]] > last / 2)


def build_tree(rows: DataFrame, root: Node) -> None:
    """Splits ``root`` level by level until every leaf is one shard."""
    names = list(DIMENSIONS)
    level = [root] if root.shards > 1 else []
    widths = None
    while level:
        for n in level:
            n.left, n.right = Node(n.first, n.shards // 2), Node(n.first + n.shards // 2, n.shards - n.shards // 2)
        here = rows.withColumn("node", node_of(root, level)).where(F.col("node").isNotNull())
        spans = [(F.max(f"key_{d}") - F.min(f"key_{d}")).alias(d) for d in names]
        stats = {r["node"]: r for r in here.groupBy("node").agg(F.sum("size").alias("bytes"), *spans).collect()}
        if widths is None:
            widths = [max(1, stats[0][d]) if stats else 1 for d in names]
        found, goals = {}, {}
        for i, n in enumerate(level):
            wide = [stats[i][d] / w if i in stats else 0 for d, w in zip(names, widths, strict=True)]
            n.dim = names[wide.index(max(wide))]
            if i in stats:
                found[i], goals[i] = n, stats[i]["bytes"] * (n.shards // 2) / n.shards
        if found:
            quantiles(here, found, goals)
        level = [c for n in level for c in (n.left, n.right) if c.shards > 1]


def node_of(root: Node, level: list[Node]) -> Column:
    """The index in ``level`` of the node that a row lies in, or null."""
    index = {id(n): i for i, n in enumerate(level)}

    def at(n: Node) -> Column:
        if id(n) in index:
            return F.lit(index[id(n)])
        if n.left is None or n.right is None:
            return F.lit(None).cast("int")
        return F.when(F.col(f"key_{n.dim}") < F.lit(n.cut), at(n.left)).otherwise(at(n.right))

    return at(root)


def kd_shards(docs: DataFrame, shards: int | None = SHARDS, target_bytes: int | None = None) -> DataFrame:
    """Per document: ``doc_id``, ``size``, ``text_crc32``, ``law``, ``shard``, ``slot``, ``grown_shard``.

    The law is ``bytes``: the shards' sizes (UTF-8 bytes and ``ROW_BYTES`` a row) are as near to
    equal as groups of equal texts allow, which are never parted. ``slot`` numbers a shard's rows from
    0 without gaps; ``grown_shard`` is null under this law. With ``target_bytes`` and no ``shards``
    there are as many shards as keep to that size.

    A null text counts as an empty one; null ids and repeated rows get a place each; an empty table
    gives no rows. Other columns are not read.
    """
    rows = materialize(metadata(docs), "kd-metadata")
    whole = rows.agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).first()
    total = whole["bytes"] or 0
    count = shards or max(1, -(-total // (target_bytes or 1)))

    large = (
        rows.groupBy("hash", "text_crc32")
        .agg(F.sum("size").alias("bytes"))
        .where(F.col("bytes") * F.lit(count) > F.lit(total))
        .orderBy(F.desc("bytes"), "hash")
        .collect()  # fewer than there are shards
    )[: count - 1]
    root = Node(len(large), count - len(large))
    alone = F.coalesce(*(F.when((F.col("hash") == r["hash"]) & (F.col("text_crc32") == r["text_crc32"]), F.lit(i)) for i, r in enumerate(large)), F.lit(None).cast("int"))
    keyed = rows.withColumn("alone", alone)
    build_tree(keyed.where(F.col("alone").isNull()), root)
    placed = keyed.select("doc_id", "size", "text_crc32", "hash", F.coalesce("alone", shard_of(root)).cast("int").alias("shard"))
    return running_sum(placed, "shard", ["doc_id", "hash"], F.lit(1).cast("long"), whole["n"], "slot").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
