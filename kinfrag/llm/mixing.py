"""Mixing sources to target weights by blocks.

The words of each source are laid end to end, in document order, and packed into blocks of a fixed
length (a source's last block may be shorter). A source's target asks for so many slots: whole
passes over its blocks, then a part of one more pass, whose last slot is cut to meet the target to
the word. The slots of all sources fill output shards of equal size. Each shard draws its sources'
counts by a multinomial of the targets, one draw for each of its places. Draws of a source beyond
its slots (it has no more) are handed to the sources that were drawn too seldom, in order of the
shards, so that shard sizes and source totals both hold. A source's slots are numbered through the shards, and
slot i of a pass maps to a block by that source's own pseudorandom permutation of the block indices
(swap-or-not, a bijection on any length). Slots and blocks are joined by index.

Fixed totals are what makes the targets exact and keeps every document within ``MOST`` times its
size. All draws are hashes, so reruns agree. Nothing is grouped by source alone but one row of totals
for each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinfrag.llm.keys import small, text_key
from kinfrag.llm.running import running_sum
from kinfrag.plans.scratch import materialize

WORD = r"[^\x20\x09-\x0D]+"
#: Words of a block; slots of one generating row; times that a source may be repeated.
BLOCK_WORDS, CHUNK, MOST = 64, 16_384, 3
#: Output shards of the mix.
SHARDS = 64
#: Rounds of the permutation, and what all draws depend on.
SWAPS, SEED = 10, 20_240_601
WEIGHTS = (1.0, 2.0, 3.0)


def source_key() -> Column:
    return F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")).alias("skey")


def permuted(index: Column, n: Column, key: Column, backwards: bool = False) -> Column:
    """The place of ``index`` (0 to n-1) in a pseudorandom permutation of ``key``, or its inverse."""
    rounds = F.sequence(F.lit(SWAPS - 1), F.lit(0), F.lit(-1)) if backwards else F.sequence(F.lit(0), F.lit(SWAPS - 1))

    def swap(x: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(F.lit(SEED), F.lit("offset"), key, r), n) - x, n)
        heads = F.xxhash64(F.lit(SEED), F.lit("coin"), key, r, F.greatest(x, other)).bitwiseAND(F.lit(1)) == 1
        return F.when(heads, other).otherwise(x)

    return F.aggregate(rounds, index.cast("long"), swap)


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """Adds ``target`` to rows of ``skey``, ``source`` and ``source_size``, one for each source.

    Sources by code point, null last, weigh ``weights`` in turn and share all words; a target stops
    at ``MOST`` times its source, and the excess is shared again by weight. That is one level of
    water: sources fill up in the order of bound over weight, so running sums find it.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    by_bound = Window.orderBy("ratio", "skey")
    upto = by_bound.rowsBetween(Window.unboundedPreceding, 0)
    after = by_bound.rowsBetween(1, Window.unboundedFollowing)
    level = (F.col("all_words") - F.col("full_words")) / F.col("open_weight")
    ranked = (
        sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
        .withColumn("bound", F.col("source_size") * float(MOST))
        .withColumn("ratio", F.col("bound") / F.col("weight"))
        .withColumns(
            {
                "all_words": F.sum("source_size").over(Window.partitionBy()),
                # What the sources before this one take if they are all full, and the weight of the rest.
                "full_words": F.sum("bound").over(upto) - F.col("bound"),
                "open_weight": F.coalesce(F.sum("weight").over(after), F.lit(0.0)) + F.col("weight"),
            }
        )
        .withColumn("level", level)
    )
    # The water's level is that of the first source that it doesn't fill.
    water = F.coalesce(F.min(F.when(F.col("level") < F.col("ratio"), F.struct("ratio", "skey", "level"))).over(Window.partitionBy())["level"], F.lit(float("inf")))
    return ranked.withColumn("target", F.least("bound", water * F.col("weight"))).select("skey", "source", "source_size", "target")


def passes(targets: DataFrame, block: int) -> DataFrame:
    """What each source's target asks for: its ``blocks``, whole passes (``full``), words of one more (``rest``) and number of ``slots``."""
    size, per = F.col("source_size"), F.lit(block)
    # Of the last pass, slots are taken while words are wanted; the short block may be among them.
    whole = F.expr(f"(rest + {block - 1}) div {block}")
    with_short = F.expr(f"(rest + short_by + {block - 1}) div {block}")
    return (
        targets.where(size > 0)
        .withColumn("blocks", F.ceil(size / per).cast("long"))
        .withColumn("full", F.floor(F.try_divide("target", size)).cast("long"))
        .withColumn("rest", F.least(size, F.round(F.col("target") - F.col("full") * size).cast("long")))
        .withColumn("short_by", F.col("blocks") * per - size)
        .withColumn("short_at", permuted(F.col("blocks") - 1, F.col("blocks"), pass_key(F.col("full")), backwards=True))
        .withColumn("last", F.when(whole <= F.col("short_at"), whole).otherwise(with_short))
        .withColumn("slots", F.col("full") * F.col("blocks") + F.when(F.col("rest") > 0, F.col("last")).otherwise(F.lit(0)))
        .where("slots > 0")
        .select("skey", "source_size", "blocks", "full", "rest", "short_by", "slots")
    )


def pass_key(number: Column) -> Column:
    return F.concat_ws("/", "skey", number)


def shard_draws(plan: DataFrame, shards: int, tasks: int = 1) -> DataFrame:
    """How many slots each shard takes of each source: ``shard``, ``skey``, ``first`` (its slots' first number) and ``n``.

    ``plan`` has ``skey`` and ``slots`` of each source. Shards' sizes differ by one at most; a source's
    counts add up to its ``slots``.
    """
    spark = plan.sparkSession
    upto = Window.orderBy("skey").rowsBetween(Window.unboundedPreceding, -1)
    known = plan.select("skey", "slots", F.coalesce(F.sum("slots").over(upto), F.lit(0)).alias("low"))
    total = known.agg(F.coalesce(F.sum("slots"), F.lit(0))).first()[0]
    edges = known.agg(F.sort_array(F.collect_list(F.struct("low", "skey"))).alias("edges"))

    # Each place of a shard draws a source; the highest edge that the draw reaches is found by halving.
    place = F.col("id")
    draw = F.pmod(F.xxhash64(F.lit(SEED), F.lit("source"), place), F.lit(max(1, total)))

    def halve(at: Column, step: Column) -> Column:
        on = at + F.call_function("shiftleft", F.lit(1), step)
        return F.when((on <= F.size("edges")) & (F.try_element_at("edges", on)["low"] <= F.col("draw")), on).otherwise(at)

    found = F.aggregate(F.sequence(F.lit(20), F.lit(0), F.lit(-1)), F.lit(0), halve)
    drawn = (
        spark.range(0, total, 1, tasks)
        .select(F.expr(f"id * {shards} div {max(1, total)}").alias("shard"), draw.alias("draw"))
        .crossJoin(F.broadcast(edges))  # one row
        .select("shard", F.element_at("edges", found)["skey"].alias("skey"))
        .groupBy("shard", "skey")
        .agg(F.count("*").alias("n"))
    )
    # One row for each shard and source from here on.
    drawn = materialize(drawn, "mix-draws")
    before = Window.partitionBy("skey").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    kept = (
        drawn.join(known, "skey")
        .withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .withColumn("keep", F.greatest(F.lit(0), F.least("n", F.col("slots") - F.col("before"))))
    )
    over = kept.where("n > keep").select("shard", "skey", (F.col("n") - F.col("keep")).alias("n"))
    seldom = known.join(drawn.groupBy("skey").agg(F.sum("n").alias("n")), "skey", "left").select("skey", (F.col("slots") - F.coalesce("n", F.lit(0))).alias("n")).where("n > 0")

    # Both lists have the same sum: laid on one line, every stretch between two ends has a shard and a source.
    line = Window.orderBy("shard", "skey").rowsBetween(Window.unboundedPreceding, 0)
    ends = over.select((F.sum("n").over(line)).alias("end"), F.col("shard"), F.lit(None).cast("string").alias("skey"))
    line = Window.orderBy("skey").rowsBetween(Window.unboundedPreceding, 0)
    ends = ends.unionByName(seldom.select(F.sum("n").over(line).alias("end"), F.lit(None).cast("long").alias("shard"), "skey"))
    ends = ends.groupBy("end").agg(F.max("shard").alias("shard"), F.max("skey").alias("skey"))
    on = Window.orderBy("end")
    onward = on.rowsBetween(0, Window.unboundedFollowing)
    handed = ends.select(
        (F.col("end") - F.lag("end", 1, 0).over(on)).alias("n"),
        F.first("shard", ignorenulls=True).over(onward).alias("shard"),
        F.first("skey", ignorenulls=True).over(onward).alias("skey"),
    )
    whole = kept.select("shard", "skey", F.col("keep").alias("n")).unionByName(handed.select("shard", "skey", "n"))
    whole = whole.groupBy("shard", "skey").agg(F.sum("n").alias("n")).where("n > 0")
    return whole.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))).select("shard", "skey", "first", "n")


def slots(targets: DataFrame, block: int, shards: int, tasks: int = 1) -> DataFrame:
    """One row for each slot: ``skey``, ``shard``, ``pass``, ``slot``, ``block`` and ``words`` (from the block's start)."""
    per = F.lit(block)
    plan = materialize(passes(targets, block), "mix-plan")
    drawn = materialize(shard_draws(plan.select("skey", "slots"), shards, tasks), "mix-shards").join(small(plan.drop("slots"), plan.count()), "skey")
    chunks = drawn.withColumn("chunk", F.explode(F.expr(f"sequence(0L, (n - 1) div {CHUNK})"))).repartition(tasks, "skey", "shard", "chunk")
    dealt = (
        chunks.withColumn("number", F.explode(F.expr(f"sequence(first + chunk * {CHUNK}, first + least(n, (chunk + 1) * {CHUNK}) - 1)")))
        .withColumns({"pass": F.expr("number div blocks"), "slot": F.expr("number % blocks")})
        .withColumn("want", F.when(F.col("pass") < F.col("full"), F.col("source_size")).otherwise(F.col("rest")))
        .withColumn("block", permuted(F.col("slot"), F.col("blocks"), pass_key(F.col("pass"))))
    )
    # The place of a source's short block in a pass is needed in its last pass alone.
    short_at = F.when(F.col("pass") == F.col("full"), permuted(F.col("blocks") - 1, F.col("blocks"), pass_key(F.col("pass")), backwards=True))
    before = F.col("slot") * per - F.when(F.col("slot") > short_at, F.col("short_by")).otherwise(F.lit(0))
    length = per - F.when(F.col("block") == F.col("blocks") - 1, F.col("short_by")).otherwise(F.lit(0))
    words = F.when(F.col("pass") < F.col("full"), length).otherwise(F.least(length, F.greatest(F.lit(0), F.col("want") - before)))
    return dealt.select("skey", "shard", "pass", "slot", "block", words.alias("words")).where("words > 0")


def shard_takes(rows: DataFrame, targets: DataFrame, block: int, shards: int) -> DataFrame:
    """What each shard takes of each document: ``skey``, ``start``, ``doc_id``, ``k1``, ``k2``, ``size``, ``shard`` and ``taken`` words.

    ``rows`` are documents with words. One that no shard takes has a row of null ``shard`` and 0.
    """
    count, words = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    own = ["skey", "start", "doc_id", "k1", "k2", "size"]
    lined = running_sum(rows.select("skey", "doc_id", "k1", "k2", "size"), "skey", ["doc_id", "k1", "k2"], F.col("size"), count, "start")
    lined = materialize(lined.select(*own), "mix-lines")
    pieces = (
        lined.withColumn("block", F.explode(F.expr(f"sequence(start div {block}, (start + size - 1) div {block})")))
        .withColumns({"a": F.greatest(F.lit(0), F.col("start") - F.col("block") * block), "b": F.least(F.lit(block), F.col("start") + F.col("size") - F.col("block") * block)})
    )
    dealt = slots(targets, block, shards, max(1, words // block // CHUNK)).select("skey", "block", "shard", "words")
    # Both sides grow with the words, which the planner can't tell from the few rows of targets.
    met = pieces.join(dealt.hint("merge"), ["skey", "block"]).withColumn("taken", (F.least("b", "words") - F.col("a")).cast("long")).where("taken > 0")
    by_shard = met.groupBy(*own, "shard").agg(F.sum("taken").alias("taken"))
    return by_shard.unionByName(lined.select(*own, F.lit(None).cast("long").alias("shard"), F.lit(0).cast("long").alias("taken")))


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, block: int = BLOCK_WORDS, shards: int = SHARDS) -> DataFrame:
    """Per document: ``doc_id``, ``skey``, ``k1``, ``k2`` (of source and text), ``size`` (words), ``source_size``, ``target`` (its source's), ``taken`` and ``n_shards``.

    ``taken`` counts the document's words in the slots of all shards, repeats too, and is at most
    ``MOST`` times its size; ``n_shards`` says how many shards have some. A source's taken words are its target, rounded. Documents
    without a word (null and empty texts too) take nothing; the null source is one like the others, the last; null ids and
    repeated rows are documents of their own; an empty table gives no rows. Other columns are not
    read.
    """
    rows = docs.select("doc_id", "source", "text").select(
        "doc_id",
        "source",
        source_key(),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        *text_key(F.col("text")),
    )
    rows = materialize(rows, "mix-sizes")
    targets = materialize(source_targets(rows.groupBy("skey", "source").agg(F.sum("size").alias("source_size")), weights), "mix-targets")
    takes = shard_takes(rows.where("size > 0"), targets, block, shards)
    by_doc = (
        takes.groupBy("skey", "start", "doc_id", "k1", "k2", "size")
        .agg(F.sum("taken").alias("taken"), F.count("shard").alias("n_shards"))
        .select("doc_id", "skey", "k1", "k2", "size", "taken", "n_shards")
    )
    nothing = F.lit(0).cast("long")
    none = rows.where("size = 0").select("doc_id", "skey", "k1", "k2", "size", nothing.alias("taken"), nothing.alias("n_shards"))
    return by_doc.unionByName(none).join(small(targets, targets.count()), "skey").select("doc_id", "skey", "k1", "k2", "size", "source_size", "target", "taken", "n_shards")


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, block: int = BLOCK_WORDS, shards: int = SHARDS) -> DataFrame:
    """``mixed_documents`` without the keys."""
    return mixed_documents(docs, weights, block, shards).drop("skey", "k1", "k2")


def mixed_copies(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, at most ``MOST`` times each.

    A document of which a part of its words is taken is rounded to a whole number of copies by a hash, so
    that a source's words are those of its target on average. Equal documents (by id, source and text)
    count together, and one of their rows is given out. Other columns may have any name.
    """
    luck = F.pmod(F.xxhash64(F.lit(SEED), F.lit("round"), "doc_id", "skey", "k1", "k2"), F.lit(1_000_000)) / 1_000_000
    copies = mixed_documents(docs, weights).where("size > 0").withColumn("copies", F.floor(F.col("taken") / F.col("size") + luck))
    keys = [F.xxhash64("doc_id").alias("k3"), F.col("skey").alias("s"), "k1", "k2"]
    copies = materialize(copies.groupBy(*keys).agg(F.sum("copies").alias("copies"), F.count("*").alias("rows")).where("copies > 0"), "mix-copies")
    wide = docs.select(F.struct("*").alias("row"), *text_key(F.col("text")), F.xxhash64("doc_id").alias("k3"), source_key().alias("s"))
    names = ["k1", "k2", "k3", "s"]
    out = wide.join(copies.where("rows = 1"), names)
    again = copies.where("rows > 1")
    if not again.isEmpty():
        out = out.unionByName(wide.join(again, names).dropDuplicates(names))
    return out.withColumn("copy", F.explode(F.expr("sequence(1L, copies)"))).select("row.*")
