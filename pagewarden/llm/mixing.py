"""Mixing sources to target weights by hierarchical budgeting.

A token budget flows down a tree (domain, language, source): each node splits its budget among its
children by weight. A child that cannot fill its share (its tokens times ``max_epochs``) gives the
shortage to its siblings by weight; only what no sibling can take goes back to the parent's siblings.

Each leaf then takes whole epochs and a token-prefix of one more. An epoch's order is a seeded hash of
doc_id, so the prefix ends at a cutoff hash: token sums of hash ranges find the range in which the budget
ends, and only the rows of that range are ordered. Choosing documents is then a filter by a small table
of leaves, without moving a text.
"""

from __future__ import annotations

import functools

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewarden.llm._common import all_of, fresh, named, written

LEVELS = ("domain", "lang", "source")
RANGES = 4096
LEAVES = 100_000
SEED = 20240601


def split_budget(capacity: dict[tuple, float], weight, budget: float) -> dict[tuple, float]:
    """Token budgets of leaves. capacity: by path; weight(path): of a node among its siblings.

    A node of weight zero takes nothing, and what lies below it is no room of its parent's.
    """
    out = dict.fromkeys(capacity, 0.0)

    def room(prefix: tuple, leaves: list[tuple]) -> float:
        if leaves == [prefix]:
            return capacity[prefix]
        return sum(room(c, own) for c, own in children_of(prefix, leaves).items() if weight(c) > 0)

    def children_of(prefix: tuple, leaves: list[tuple]) -> dict[tuple, list[tuple]]:
        children: dict[tuple, list[tuple]] = {}
        for leaf in leaves:
            children.setdefault(leaf[: len(prefix) + 1], []).append(leaf)
        return children

    def fill(prefix: tuple, leaves: list[tuple], amount: float) -> None:
        if leaves == [prefix]:
            out[prefix] = min(amount, capacity[prefix])
            return
        children = {c: own for c, own in children_of(prefix, leaves).items() if weight(c) > 0}
        rooms = {c: room(c, own) for c, own in children.items()}
        open_, left, share = sorted(children, key=repr), min(amount, sum(rooms.values())), {}
        while open_:
            total = sum(weight(c) for c in open_)
            short = [c for c in open_ if left * weight(c) / total >= rooms[c]]
            for c in short or open_:
                share[c] = rooms[c] if short else left * weight(c) / total
            left -= sum(share[c] for c in short)
            open_ = [c for c in open_ if c not in short] if short else []
        for c, own in children.items():
            fill(c, own, share[c])

    if capacity:
        fill((), sorted(capacity, key=repr), budget)
    return out


def budget_table(leaves: DataFrame, weight, budget: float) -> DataFrame:
    """split_budget on a table: (domain, lang, source, capacity) with budget, level by level.

    Siblings share an amount by one rate a weight, found by rounds of sums over all of them: whoever is short
    at the rate gives the rest of its share back, which raises the rate. No parent's children meet in one task.
    """

    def weights(depth: int):
        @F.pandas_udf("double")
        def own(*path: pd.Series) -> pd.Series:
            return pd.Series([float(weight(p)) for p in zip(*path)], dtype="float64")

        return own(*LEVELS[:depth])

    tables = [written(leaves.withColumn("root", F.lit(0)).withColumn("w", weights(3)).withColumnRenamed("capacity", "room"), "leaves")]
    for depth in (2, 1):
        below = tables[0].groupBy("root", *LEVELS[:depth]).agg(F.sum(F.when(F.col("w") > 0, F.col("room")).otherwise(0.0)).alias("room"))
        tables.insert(0, written(below.withColumn("w", weights(depth)), "nodes"))
    amounts = leaves.sparkSession.range(1).select(F.lit(0).alias("root"), F.lit(float(budget)).alias("amount"))
    for depth, nodes in enumerate(tables, start=1):
        keys = ["root", *LEVELS[: depth - 1]]
        open_ = nodes.where("w > 0")
        rate, before = None, 0
        while True:
            if rate is None:
                rooms = open_.groupBy(*keys).agg(F.sum("room").alias("all"), F.sum("w").alias("ws")).join(amounts, keys)
                now = rooms.select(*keys, F.least("amount", "all").alias("amount"), (F.least("amount", "all") / F.col("ws")).alias("rate"), F.lit(0).cast("long").alias("short"))
            else:
                short = F.col("room") <= F.col("rate") * F.col("w")
                sums = open_.join(rate, keys).groupBy(*keys).agg(F.first("amount").alias("amount"), F.first("rate").alias("old"), F.sum(F.when(short, F.col("room")).otherwise(0.0)).alias("given"), F.sum(F.when(short, 0.0).otherwise(F.col("w"))).alias("ws"), F.count_if(short).alias("short"))
                now = sums.select(*keys, "amount", F.greatest("old", F.when(F.col("ws") > 0, (F.col("amount") - F.col("given")) / F.col("ws")).otherwise(F.col("old"))).alias("rate"), "short")
            first, rate = rate is None, written(now, "rate")
            # Rates only rise, so children only become short: when none did, the rates stand. At most a round a child.
            seen = rate.agg(F.coalesce(F.sum("short"), F.lit(0))).first()[0]
            if not first and seen == before:
                break
            before = seen
        share = nodes.join(rate.drop("short"), keys, "left").withColumn("amount", F.coalesce(F.when(F.col("w") > 0, F.least("room", F.col("rate") * F.col("w"))), F.lit(0.0)))
        amounts = written(share.select("root", *LEVELS[:depth], "amount"), "amounts")
    return amounts.select(*LEVELS, F.col("amount").alias("budget"))


def default_domain(source: Column) -> Column:
    """Sources without a domain of their own fall into four by the number in their name."""
    return F.concat(F.lit("d"), F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(source, "([0-9]{1,9})$", 1), F.lit("")), F.lit("999999999")), F.lit(0)).cast("long") % 4)


def default_weight(path: tuple) -> float:
    """Domains d0 to d3 as 4:3:2:1, English twice any other language, sources alike."""
    if len(path) == 1:
        return {"d0": 4.0, "d1": 3.0, "d2": 2.0}.get(path[0], 1.0)
    return 2.0 if len(path) == 2 and path[1] == "en" else 1.0


def token_count(text: Column) -> Column:
    """Runs of characters other than blanks."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")


def _order(epoch: Column, doc_id: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed).cast("long"), epoch.cast("long"), doc_id.cast("string"))


def mix_documents(docs: DataFrame, fraction: float = 0.6, max_epochs: int = 2, weight=default_weight, domain=None, seed: int = SEED, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The chosen documents with all their columns and mix_domain, mix_tokens, mix_epoch.

    Where the input has a column of such a name, the three get underscores before theirs. The budget is
    ``fraction`` of all tokens. A document chosen in several epochs comes once for each (mix_epoch from 0). No
    leaf exceeds its budget, and it falls short of it by less than its next document. Null lang or source is
    a branch of its own; a null text has no tokens and goes with any prefix that reaches its hash. Rows of
    one doc_id within a leaf are drawn together, and null doc_ids are one such document. An empty table gives
    no rows. Up to LEAVES leaves are budgeted on the driver and broadcast, more of them in tables.
    """
    level = {"domain": (domain or default_domain)(F.col("source")), "lang": F.col("lang"), "source": F.col("source")}
    path = {x: F.coalesce(c, F.lit("\0")) for x, c in level.items()}
    light = written(docs.groupBy(*(path[x].alias(x) for x in LEVELS), named(doc_id).alias("doc")).agg(F.sum(token_count(named(text))).alias("tokens")), "tokens")

    leaves = written(light.groupBy(*LEVELS).agg(F.sum("tokens").alias("t")), "leaves")
    totals = leaves.agg(F.count("*").alias("n"), F.coalesce(F.sum("t"), F.lit(0)).alias("t")).first()
    few = totals["n"] <= LEAVES
    if few:
        tokens = {tuple(r[k] for k in LEVELS): r["t"] for r in leaves.collect()}
        budgets = split_budget({k: float(t * max_epochs) for k, t in tokens.items()}, weight, fraction * totals["t"])
        budget = docs.sparkSession.createDataFrame([(*k, float(v)) for k, v in budgets.items()], ", ".join(f"{k} string" for k in LEVELS) + ", budget double")
    else:
        budget = budget_table(leaves.select(*LEVELS, (F.col("t") * float(max_epochs)).alias("capacity")), weight, fraction * totals["t"])
    whole = F.when(F.col("t") > 0, F.floor(F.col("budget") / F.col("t"))).when(F.col("budget").isNull(), 0).otherwise(max_epochs)
    rest = F.when(F.col("t") > 0, F.floor(F.col("budget") - F.col("whole") * F.col("t"))).otherwise(0)
    plan = written(leaves.join(budget, [*LEVELS]).withColumn("whole", whole.cast("int")).withColumn("rest", rest.cast("long")).select(*LEVELS, "whole", "rest"), "plan")
    side = F.broadcast if few else (lambda df: df)  # LEAVES rows at most, or a shuffle

    drawn = light.join(side(plan), [*LEVELS]).withColumn("hash", _order(F.col("whole"), F.col("doc"), seed)).withColumn("range", F.shiftright("hash", 52))
    up_to = Window.partitionBy(*LEVELS).orderBy("range").rowsBetween(Window.unboundedPreceding, 0)
    ranges = (
        drawn.groupBy(*LEVELS, "rest", "range").agg(F.sum("tokens").alias("t"))
        .withColumn("end", F.sum("t").over(up_to))
        .where("end > rest AND end - t <= rest")
        .select(*LEVELS, "range", (F.col("end") - F.col("t")).alias("begin"))
    )
    within = Window.partitionBy(*LEVELS).orderBy("hash").rangeBetween(Window.unboundedPreceding, 0)
    cut = (
        drawn.join(side(ranges), [*LEVELS, "range"])
        .withColumn("sum", F.col("begin") + F.sum("tokens").over(within))
        .where("sum > rest")
        .groupBy(*LEVELS)
        .agg(F.min("hash").alias("cut"))
    )
    cutoffs = written(plan.join(cut, [*LEVELS], "left").where("whole > 0 OR rest > 0"), "cutoffs")  # one row a leaf; the first hash beyond the budget
    own = fresh(docs, *(f"own_{x}" for x in LEVELS))
    found = fresh(docs, *(f"leaf_{x}" for x in LEVELS), "leaf_whole", "leaf_rest", "leaf_cut", "leaf_epochs")
    out_domain, out_tokens, out_epoch = fresh(docs, "mix_domain", "mix_tokens", "mix_epoch")
    tagged = docs.select("*", *(path[x].alias(n) for x, n in zip(LEVELS, own)))
    leaf = side(cutoffs.select(*(F.col(c).alias(n) for c, n in zip((*LEVELS, "whole", "rest", "cut"), found))))
    at_leaf = functools.reduce(lambda x, y: x & y, (F.col(x) == F.col(y) for x, y in zip(own, found)))
    whole_, rest_, cut_ = (F.col(n) for n in found[3:6])
    reaches = (rest_ > 0) & (cut_.isNull() | (_order(whole_, named(doc_id), seed) < cut_))
    drawn_times = tagged.join(leaf, at_leaf).withColumn(found[6], whole_ + F.when(reaches, 1).otherwise(0)).where(F.col(found[6]) > 0)
    epochs = F.explode(F.sequence(F.lit(0), F.col(found[6]) - 1))
    return drawn_times.select(*all_of(docs), F.col(own[0]).alias(out_domain), token_count(named(text)).alias(out_tokens), epochs.alias(out_epoch))
