"""Mixes sources to target weights by pivotal rounding, weighted by size, in a distributed reduction tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .util import WORD, shared_table

#: Documents (later: residuals) that a block of the tree holds on average.
BLOCK = 64


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def let(value: Column, f) -> Column:
    """f(value), with value worked out once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """A row for each source: source, source_size, n, target.

    The share of all sizes is dealt by weight and filled like vessels: sorted by most * size / weight, the first ones
    are full, and the rest stand at one level. One window over sources, not documents.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), ((F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1) % len(weights) + 1).cast("int"))
    full, order = F.col("source_size") * F.lit(float(most)), Window.orderBy("brim", F.asc_nulls_last("source"))
    earlier, later, everything = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy()
    filled = (
        by.withColumn("w", w).withColumn("brim", full / F.col("w")).withColumn("at", F.row_number().over(order))
        .withColumn("level", (F.sum("source_size").over(everything) * share - F.coalesce(F.sum(full).over(earlier), F.lit(0.0))) / F.sum("w").over(later))
        .withColumn("level", F.min(F.when(F.col("level") <= F.col("brim"), F.struct("at", "level"))).over(everything)["level"])
    )
    return filled.select("source", "source_size", "n", F.least(full, F.coalesce(F.col("level") * F.col("w"), full)).alias("target"))


def _pair(seed: int):
    """Merges the unit that is carried with the next one: mass in words moves between them until one is integral."""
    unit = lambda u, p: F.struct(u["id"].alias("id"), u["size"].alias("size"), u["mass"].alias("mass"), p.alias("p"))
    done = lambda u, up: F.struct(u["id"].alias("id"), u["size"].alias("size"), F.lit(up).alias("up"))

    def step(state: Column, b: Column) -> Column:
        a = state["rest"]
        draw = (F.pmod(F.xxhash64(a["id"], a["size"], b["id"], b["size"], F.lit(seed)), F.lit(1 << 52)) / float(1 << 52)).alias("draw")
        give = F.struct(F.least(a["mass"] * (1 - a["p"]), b["mass"] * b["p"]).alias("up"), F.least(a["mass"] * a["p"], b["mass"] * (1 - b["p"])).alias("down"), draw)

        def settle(g: Column) -> Column:
            result = lambda which, rest: F.struct(rest.alias("rest"), F.concat(state["done"], F.array(which)).alias("done"))
            gains = g["draw"] * (g["up"] + g["down"]) < g["down"]  # a gains with odds that leave its expectation
            a_full, b_out = a["mass"] * (1 - a["p"]) <= b["mass"] * b["p"], b["p"] - g["up"] / b["mass"]
            a_out, b_full = a["p"] - g["down"] / a["mass"], a["mass"] * a["p"] <= b["mass"] * (1 - b["p"])
            return (
                F.when(gains & a_full, result(done(a, 1), unit(b, F.greatest(b_out, F.lit(0.0)))))
                .when(gains, result(done(b, 0), unit(a, F.least(a["p"] + g["up"] / a["mass"], F.lit(1.0)))))
                .when(b_full, result(done(a, 0), unit(b, F.least(b["p"] + g["down"] / b["mass"], F.lit(1.0)))))
                .otherwise(result(done(b, 1), unit(a, F.greatest(a_out, F.lit(0.0)))))
            )

        return F.when(a["id"].isNull() & a["mass"].isNull(), F.struct(b.alias("rest"), state["done"].alias("done"))).otherwise(let(give, settle))

    return step


def _tie(id_col: str, text_col: str):
    """What tells documents without an id apart."""
    return F.when(F.col(id_col).isNull(), F.xxhash64(text_col))


def mix_sources(docs: DataFrame, *settings, **more) -> DataFrame:
    """decide() without what take() needs beside it."""
    return decide(docs, *settings, **more).drop("tie")


def decide(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.0, most: float = 3, seed: int = 11, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """Decides how often the mix takes each document.

    One row for each input row: doc_id, source, size (words), source_size, target (both of its source), copies int, tie.
    A source's copies hold its target up to half of one document's words, none exceeds ceil(target / source_size) <= most.
    The fractional parts of target / source_size are copy probabilities. In a block of about 64 documents they are paired
    from the largest on; the residuals of blocks are paired in the next level, until a source has one, which is rounded.
    Every draw is a hash of ids and sizes: reruns and retried tasks agree.

    Null text: size 0. Documents without words weigh nothing; they stay once if target / source_size is 0.5 or more.
    A null source is a source of its own. Repeated rows (same id, source and size) share one decision; where the id is null,
    rows of one text do: `tie` has the text's hash there, null elsewhere. An empty table gives an empty result; other columns are ignored.
    """
    sizes = shared_table(docs.select(F.struct(F.col(id_col).alias("id"), _tie(id_col, text_col).alias("tie")).alias("id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size")), "mix-sizes")
    goal = shared_table(targets(sizes, weights, share, most), "mix-targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    units = (
        sizes.where("size > 0").groupBy("id", "source", "size").agg((F.col("size") * F.count("*")).cast("double").alias("mass")).alias("u")
        .join(goal.withColumn("rate", rate).alias("g"), F.col("u.source").eqNullSafe(F.col("g.source")))
        .select(F.col("u.source").alias("source"), "id", "size", "mass", (F.col("rate") - F.floor("rate")).alias("p"), "n")
        .where("p > 1e-12 AND p < 1 - 1e-12")
    )
    blocks, level, settled = F.ceil(F.col("n") / BLOCK), 0, []
    most_rows = goal.agg(F.max("n")).first()[0] or 0
    kind = units.select("id", "size", "mass", "p").schema
    rest_type = ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in kind)
    none = f"struct<rest: struct<{rest_type}>, done: array<struct<id: {kind['id'].dataType.simpleString()}, size: bigint, up: int>>>"
    while True:
        put = units.withColumn("n", blocks.cast("long")).withColumn("block", F.pmod(F.xxhash64("id", "size", F.lit(seed + level)), F.greatest("n", F.lit(1))))
        row = F.struct((-F.col("mass")).alias("large_first"), F.xxhash64("id", "size", F.lit(seed)).alias("order"), "id", "size", "mass", "p")
        paired = put.groupBy("source", "n", "block").agg(F.sort_array(F.collect_list(row)).alias("rows")).select(
            "source", "n",
            F.aggregate(F.transform("rows", lambda r: F.struct(r["id"].alias("id"), r["size"].alias("size"), r["mass"].alias("mass"), r["p"].alias("p"))),
                        F.from_json(F.lit('{"done": []}'), none), _pair(seed + level)).alias("x"),
        )
        paired = shared_table(paired.select("source", "n", "x.rest", "x.done"), f"mix-level{level}")
        settled.append(paired.select("source", F.inline("done")))
        units, level, most_rows = paired.select("source", "rest.*", "n"), level + 1, -(-most_rows // BLOCK)
        if most_rows <= 1:
            break
    chosen = units.select("source", "id", "size", (F.col("p") >= 0.5).cast("int").alias("up"))
    for x in settled:
        chosen = chosen.unionByName(x.select("source", "id", "size", "up"))
    chosen = chosen.alias("c")
    whole = F.when(F.col("s.size") > 0, F.floor(F.col("rate") + 1e-12)).otherwise(F.least(F.floor(F.col("rate") + 0.5), F.lit(1)))
    out = (
        sizes.alias("s").join(goal.withColumn("rate", rate).alias("g"), F.col("s.source").eqNullSafe(F.col("g.source")))
        .join(chosen, F.col("s.source").eqNullSafe(F.col("c.source")) & F.col("s.id").eqNullSafe(F.col("c.id")) & (F.col("s.size") == F.col("c.size")), "left")
        .select(F.col("s.id.id").alias("doc_id"), F.col("s.source").alias("source"), F.col("s.size").alias("size"), "source_size", "target", (whole + F.coalesce("up", F.lit(0))).cast("int").alias("copies"), F.col("s.id.tie").alias("tie"))
    )
    return out


def take(docs: DataFrame, decisions: DataFrame) -> DataFrame:
    """The mix itself: each row of docs as often as its decision says, with the columns of docs.

    Null ids and sources meet their own decision, repeated rows are taken alike, an empty table gives an empty one. Columns of docs
    travel as one struct, so that their names can't clash with a decision's. decisions: decide(); those of mix_sources()
    serve where no two texts without an id have one source and size.
    """
    known = "tie" in decisions.columns
    d = decisions.select("doc_id", "source", "size", "copies", *(["tie"] if known else [])).where("copies > 0").distinct().alias("d")
    k = docs.select(F.struct("*").alias("row"), "doc_id", "source", n_words(F.col("text")).alias("size"), _tie("doc_id", "text").alias("tie")).alias("k")
    on = F.col("k.doc_id").eqNullSafe(F.col("d.doc_id")) & F.col("k.source").eqNullSafe(F.col("d.source")) & (F.col("k.size") == F.col("d.size"))
    on = on & F.col("k.tie").eqNullSafe(F.col("d.tie")) if known else on
    return k.join(d, on).select(F.col("k.row").alias("row"), F.explode(F.sequence(F.lit(1), F.col("d.copies"))).alias("copy")).select("row.*")
