"""Mixing sources to target weights by pivotal dependent rounding, on DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillwork.llm._rows import cut, fresh, quoted

#: Items that one node of the reduction tree folds: depth grows as the log of the items to this base.
FAN = 64

#: Rows of one repeated item are numbered in so many parts.
ROW_PARTS = 256

#: What counts as a word for sizes: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """For each source of (source, n_items, source_size): its target, min(most * size, level * weight), with
    the level at which the targets sum to share times all sizes.

    Sources in order of code points, null last, take the weights in turn. The level: with sources by falling
    need of a cap (size / weight, rising), the first at which sharing the rest of the total by the weights of
    the rest needs no cap. Ranks and running sums are taken range by range, so no task meets all sources.
    """
    named = ranked(sizes, [F.col("source").isNull().alias("last"), F.col("source").alias("name")], [])
    out = named.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))).drop("rank")
    out = out.withColumn("cap", F.lit(float(most)) * F.col("source_size")).withColumn("full_at", F.col("cap") / F.col("weight"))
    out = ranked(out, [F.col("full_at").alias("full"), F.col("source").isNull().alias("last"), F.col("source").alias("name")], ["cap", "weight"])
    total = out.agg(F.sum("source_size").alias("s"), F.sum("weight").alias("w")).first()
    left = F.lit(float(share) * (total["s"] or 0)) - F.col("before_cap")
    out = out.withColumn("level", left / (F.lit(float(total["w"] or 1)) - F.col("before_weight")))
    level = out.where(F.col("level") <= F.col("full_at")).agg(F.min_by("level", "rank")).first()[0]
    target = F.col("cap") if level is None else F.least(F.col("cap"), F.lit(float(level)) * F.col("weight"))
    return out.select("source", "n_items", "source_size", target.alias("target"))


def ranked(df: DataFrame, order: list[Column], sums: list[str]) -> DataFrame:
    """df with each row's rank by `order`, a total order, and before_<c>: the sum of c over the rows before it.

    Rows are dealt by ranges of the order and written, which fixes the ranges; windows run inside them, and
    each range learns the totals of those before it, one row a range.
    """
    keyed = df.withColumn("order", F.struct(*order))
    dealt = cut(keyed.repartitionByRange("order").withColumn("range", F.spark_partition_id()), "mix-ranges")
    totals = dealt.groupBy("range").agg(F.count(F.lit(1)).alias("rows"), *[F.sum(c).alias(f"all_{c}") for c in sums])
    past = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("range", *[F.coalesce(F.sum(c).over(past), F.lit(0)).alias(f"past_{c}") for c in ["rows", *(f"all_{x}" for x in sums)]])
    inside = Window.partitionBy("range").orderBy("order")
    out = dealt.join(totals, "range").withColumn("rank", F.row_number().over(inside) + F.col("past_rows"))
    for c in sums:
        own = F.coalesce(F.sum(c).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        out = out.withColumn(f"before_{c}", own + F.col(f"past_all_{c}"))
    return out.drop("order", "range", "past_rows", *[f"past_all_{c}" for c in sums])


def _uniform(*columns: Column) -> Column:
    """A number in [0, 1) from a hash: the same in every run and on every retry."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 11).cast("double") / F.lit(float(1 << 53))


def _pivot(state: Column, x: Column) -> Column:
    """One pivotal step between the pending item of `state` and x.

    Words move from one to the other, so that expected words stay, until one of the two probabilities is
    0 or 1; that item is decided, the other one is pending. Mass flows into the pending item with chance
    lose / (gain + lose), which keeps every item's expected probability.
    """
    gain = F.least((1 - state["p"]) * state["w"], x["p"] * x["w"])
    lose = F.least(state["p"] * state["w"], (1 - x["p"]) * x["w"])
    into = x["u"] * (gain + lose) < lose
    pending_done = F.when(into, (1 - state["p"]) * state["w"] <= x["p"] * x["w"]).otherwise(state["p"] * state["w"] <= (1 - x["p"]) * x["w"])
    moved = F.when(into, gain).otherwise(-lose)

    def inside(p: Column) -> Column:
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), p))

    def decided(item: Column, up: Column) -> Column:
        return F.array(F.struct(item["item"].alias("item"), up.alias("up")))

    def pending(item: Column, p: Column, done: Column) -> Column:
        return F.struct(item["item"].alias("item"), inside(p).alias("p"), item["w"].alias("w"), done.alias("done"))

    one, zero = F.lit(1), F.lit(0)
    after = F.when(
        pending_done,
        pending(x, x["p"] - moved / x["w"], F.concat(state["done"], decided(state, F.when(into, one).otherwise(zero)))),
    ).otherwise(pending(state, state["p"] + moved / state["w"], F.concat(state["done"], decided(x, F.when(into, zero).otherwise(one)))))
    first = pending(x, x["p"], state["done"])
    return F.when(state["item"].isNull(), first).otherwise(after)


def decide(items: DataFrame, seed: int) -> DataFrame:
    """Rounds the probabilities p of items (item struct, source, p, w, n) to `up`, 0 or 1, source by source.

    A reduction tree: items fall into nodes of about FAN by a hash; each node pairs its items one after the
    other, and one undecided item at most goes up to the next level, until each source has one node. Items
    that come out of the last level with a probability left are rounded by it. Every level is written to
    the shared folder; a node holds about FAN items whatever the size of a source, so no task grows.
    """
    depth = 1
    largest = items.agg(F.max("n")).first()[0] or 0
    while FAN**depth < largest:
        depth += 1
    out, level = None, items
    for k in range(depth):
        nodes = F.greatest(F.ceil(F.col("n") / F.lit(float(FAN ** (k + 1)))), F.lit(1))
        node = F.pmod(F.xxhash64("item", F.lit(seed + k)), nodes) if k + 1 < depth else F.lit(0)
        # large documents first, so that what stays undecided, and the words it leaves open, get small
        member = F.struct((-F.col("w")).alias("order"), _uniform(F.col("item"), F.lit(seed + 1000 + k)).alias("u"), "item", "p", "w")
        kind = items.schema["item"].dataType.simpleString()
        start = F.expr(f"named_struct('item', cast(null as {kind}), 'p', 0D, 'w', 0D, 'done', cast(array() as array<struct<item:{kind},up:int>>))")
        grouped = level.withColumn("node", node).groupBy("source", "n", "node").agg(F.array_sort(F.collect_list(member)).alias("members"))
        folded = cut(grouped.select("source", "n", F.aggregate("members", start, _pivot).alias("state")), "mix")
        done = folded.select("source", F.inline("state.done"))
        out = done if out is None else out.unionByName(done)
        level = folded.where("state.item is not null").select("source", "n", "state.item", "state.p", "state.w")
    last = level.select("source", "item", (_uniform(F.col("item"), F.lit(seed + 2000)) < F.col("p")).cast("int").alias("up"))
    return out.unionByName(last)


def plan(documents: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", weights=(3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 7) -> DataFrame:
    """How often each document is taken: doc_id, source, size, source_size, target, n_rows, n_copies.

    Rows with equal id, source and size are one item of n_rows rows, which get n_copies together, as evenly
    as can be. An item's expected copies are n_rows * target / source_size of its source; it gets that rounded
    down or up, by dependent rounding that keeps the words of a source within one document of the target.
    A null text has size 0, a null source is a source and comes last, a null id is an id. A document of
    no words gets its copies rounded down. Sources of no words have target 0. An empty table gives no rows.
    Sizes alone are shuffled, not texts; the hash of id and size spreads a hot source over its nodes.
    """
    light = documents.select(F.col(quoted(doc_id)).alias("doc_id"), F.col(quoted(source)).alias("source"), words(F.col(quoted(text))).alias("size"))
    items = cut(light.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("n_rows")), "mix-items")
    sizes = items.groupBy("source").agg(F.count(F.lit(1)).alias("n_items"), F.sum(F.col("size") * F.col("n_rows")).alias("source_size"))
    goals = cut(targets(sizes, weights, share, most), "mix-targets")
    goal = goals.withColumnRenamed("source", "source_")
    each = F.when(F.col("source_size") > 0, F.col("n_rows") * F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    near = F.round(each)  # a whole number up to rounding errors is that number
    each = F.when(F.abs(each - near) < 1e-9, near).otherwise(each)
    all_items = items.join(goal, F.col("source").eqNullSafe(F.col("source_"))).drop("source_").withColumn("each", each)
    least = F.floor("each")
    fraction = F.col("each") - least
    item = F.struct("doc_id", "size", "n_rows", "source_size", "target", least.alias("least"))
    split = all_items.select("source", item.alias("item"), fraction.alias("p"), F.col("size").cast("double").alias("w"), F.col("n_items").alias("n"))
    open_ = (F.col("p") > 0) & (F.col("w") > 0)
    rounded = decide(split.where(open_), seed).unionByName(split.where(~open_).select("source", "item", F.lit(0).alias("up")))
    return rounded.select("item.doc_id", "source", "item.size", "item.source_size", "item.target", "item.n_rows", (F.col("item.least") + F.col("up")).cast("long").alias("n_copies"))


def _spread(n_rows: Column, n_copies: Column) -> tuple[Column, Column]:
    """Copies of every row of an item, and how many of its rows get one more."""
    base = F.floor(n_copies / n_rows).cast("long")
    return base, n_copies - base * n_rows


def contract(documents: DataFrame) -> DataFrame:
    """One row per document for op3. An item of many equal rows is unfolded in two steps of at most 10,000."""
    base, more = _spread(F.col("n_rows"), F.col("n_copies"))
    out = plan(documents).withColumn("base", base).withColumn("more", more)
    step = 10_000
    out = out.withColumn("block", F.explode(F.expr(f"sequence(0L, n_rows - 1, {step}L)")))
    out = out.withColumn("row", F.explode(F.expr(f"sequence(block, least(block + {step - 1}L, n_rows - 1))")))
    copies = F.col("base") + F.when(F.col("row") < F.col("more"), 1).otherwise(0)
    return out.select("doc_id", "size", "source_size", "target", (copies * F.col("size")).cast("long").alias("taken"))


def mix(documents: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", **params) -> DataFrame:
    """The mixed documents: every row as often as `plan` takes it, with mix_copy (0, 1) and mix_target.

    Columns of the input may have any names; where these two are taken, they get underscores. Null and
    repeated rows are as in `plan`.
    """
    names = documents.columns
    plain = documents.toDF(*[f"c{i}" for i in range(len(names))])
    body, own_id, own_source = (F.col(f"c{names.index(c)}") for c in (text, doc_id, source))
    goals = plan(documents.select(F.col(quoted(doc_id)).alias("doc_id"), F.col(quoted(source)).alias("source"), F.col(quoted(text)).alias("text")), **params).where("n_copies > 0")
    goals = goals.select(F.struct("doc_id", "source", "size").alias("key"), "n_rows", "n_copies", "target")
    key = F.struct(own_id.alias("doc_id"), own_source.alias("source"), words(body).alias("size"))
    part = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(ROW_PARTS))
    kept = plain.withColumn("key", key).withColumn("part", part).join(goals, "key")
    base, more = _spread(F.col("n_rows"), F.col("n_copies"))
    single = kept.where("n_rows = 1").withColumn("n", F.col("n_copies"))
    # rows of a repeated item are numbered part by part, so that one item's rows are not one task's
    many = cut(kept.where("n_rows > 1"), "mix-many")
    sizes = many.groupBy("key", "part").agg(F.count(F.lit(1)).alias("m"))
    before = F.coalesce(F.sum("m").over(Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    row = F.row_number().over(Window.partitionBy("key", "part").orderBy(F.xxhash64(body))) + F.col("before")
    many = many.join(sizes.select("key", "part", before.alias("before")), ["key", "part"]).withColumn("n", base + F.when(row <= more, 1).otherwise(0)).drop("before")
    out = single.unionByName(many.select(*single.columns)).where("n > 0")
    out = out.withColumn("copy", F.explode(F.expr("sequence(0L, n - 1)")))
    copy = fresh(names, "mix_copy")
    return out.select(*plain.columns, "copy", "target").toDF(*names, copy, fresh([*names, copy], "mix_target"))
