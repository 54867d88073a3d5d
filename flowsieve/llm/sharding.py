"""A uniform shuffle into shards of exact sizes, through a hypergeometric communication matrix.

Every partition permutes its rows and sends an exact number of them to each shard, and every shard
permutes what it has received. The numbers are one draw of the matrix whose row sums are the partitions'
sizes and whose column sums are the shards' sizes, from the distribution that a uniform permutation of
all rows has: partition after partition and shard after shard, each a hypergeometric draw from what is
left. So no sort over all rows takes place, and shard sizes differ by one row at most.

Only DataFrame functions are used. Draws come from hashes of the seed and of the row, so that a task that
is run again gives the same rows. Rows that repeat (same id and text) are interchangeable. Null text has no
bytes, a null id is an id like any other, and an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowsieve.llm.tables import id_text, stored

BLOCKS = 256
ROWS_PER_TASK = 4096
LOG_2PI = 1.8378770664093453
TWO_53 = float(1 << 53)


def unit_draw(*parts: Column) -> Column:
    """A number in [0, 1) from a hash."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") / F.lit(TWO_53)


def bound(value: Column, body) -> Column:
    """`body` of a value that is worked out once."""
    return F.transform(F.array(value), body)[0]


def stirling_error(x: Column) -> Column:
    """log(x!) without its leading terms (x + 1/2) log x - x + log(2 pi) / 2, for x of one or more."""

    def series(y: Column) -> Column:
        return (1 / 12 - (1 / 360 - (1 / 1260 - (1 / 1680 - y / 1188) * y) * y) * y) / x

    exact = F.log(F.factorial(F.least(x, F.lit(15.0)).cast("int")).cast("double")) - ((x + 0.5) * F.log(x) - x + 0.5 * LOG_2PI)
    return F.when(x <= 15, exact).otherwise(bound(1 / (x * x), series))


def deviance(x: Column, mean: Column) -> Column:
    """x log(x / mean) + mean - x, without cancellation where the two are close."""

    def close(v: Column) -> Column:
        odd = F.array(*[F.lit(1 / k) for k in range(19, 2, -2)])
        tail = bound(v * v, lambda square: square * F.aggregate(odd, F.lit(0.0), lambda sum, k: sum * square + k))
        return (x - mean) * v + 2 * x * v * tail

    far = F.when(x > 0, x * F.log(F.greatest(x, F.lit(1.0)) / mean)).otherwise(0.0) + mean - x
    return F.when(F.abs(x - mean) < 0.1 * (x + mean), bound((x - mean) / (x + mean), close)).otherwise(far)


def log_binomial(x: Column, n: Column, p: Column) -> Column:
    """Log probability of x among n with the chance p: the large terms of the factorials and powers are cancelled on paper."""

    def middle(s: Column) -> Column:
        x, n, p = s["x"], s["n"], s["p"]
        return stirling_error(n) - stirling_error(x) - stirling_error(n - x) - deviance(x, n * p) - deviance(n - x, n * (1 - p)) + 0.5 * (F.log(n / (x * (n - x))) - LOG_2PI)

    inside = bound(F.struct(x.alias("x"), n.alias("n"), p.alias("p")), middle)
    return F.when(n <= 0, 0.0).when(x <= 0, n * F.log1p(-p)).when(x >= n, n * F.log(p)).otherwise(inside)


def log_probability(total: Column, good: Column, draws: Column, found: Column) -> Column:
    """Log of the hypergeometric probability, as three binomial ones; right to 1e-10 for 10^11 rows, and to more digits for fewer."""
    p = draws / F.greatest(total, F.lit(1.0))
    return log_binomial(found, good, p) + log_binomial(draws - found, total - good, p) - log_binomial(draws, total, p)


def hypergeometric(total: Column, good: Column, draws: Column, uniform: Column) -> Column:
    """How many of `draws` items taken from `total` are among its `good` ones: inversion outwards from the mode.

    The walk is bounded by twelve standard deviations, beyond which doubles hold no probability.
    """

    def walk(p: Column) -> Column:
        t, k, n, m = p["t"], p["k"], p["n"], p["m"]
        log_p = log_probability(t, k, n, m)
        share = k / F.greatest(t, F.lit(1.0))
        spread = F.sqrt(F.greatest(n * share * (1 - share) * (t - n) / F.greatest(t - 1, F.lit(1.0)), F.lit(0.0)))
        steps = F.sequence(F.lit(1), F.ceil(12 * spread).cast("int") + 12)

        def step(s: Column, _: Column) -> Column:
            x, y = s["up"], s["down"]
            p_up = s["p_up"] * (k - x) * (n - x) / ((x + 1) * (t - k - n + x + 1))
            p_down = s["p_down"] * y * (t - k - n + y) / ((k - y + 1) * (n - y + 1))
            found = F.when(s["found"] >= 0, s["found"]).when(s["left"] < p_up, x + 1).when(s["left"] < p_up + p_down, y - 1).otherwise(-1.0)
            ahead = F.struct(
                (s["left"] - p_up - p_down).alias("left"), (x + 1).alias("up"), p_up.alias("p_up"), (y - 1).alias("down"), p_down.alias("p_down"), found.alias("found")
            )
            return F.when(s["found"] >= 0, s).otherwise(ahead)

        start = bound(F.exp(log_p), lambda p0: F.struct(
            (p["u"] - p0).alias("left"), m.alias("up"), p0.alias("p_up"), m.alias("down"), p0.alias("p_down"),
            F.when(p["u"] < p0, m).otherwise(F.lit(-1.0)).alias("found"),
        ))
        return F.aggregate(steps, start, step, lambda s: F.when(s["found"] >= 0, s["found"]).otherwise(m))

    mode = F.floor((draws + 1) * (good + 1) / (total + 2)).cast("double")
    clipped = F.least(F.greatest(mode, draws - total + good, F.lit(0.0)), draws, good)
    return bound(F.struct(total.alias("t"), good.alias("k"), draws.alias("n"), clipped.alias("m"), uniform.alias("u")), walk)


def communication_matrix(blocks: DataFrame, shards: int, seed: int) -> DataFrame:
    """One row per block (block, n): `upto`, the running sums of its exact counts for the shards.

    The draw is sequential and runs in one row of at most `BLOCKS` block counts, whatever the number of rows.
    """
    sizes = F.array_sort(F.collect_list(F.struct("block", F.col("n").cast("double").alias("n"))))
    one = blocks.agg(sizes.alias("blocks"), F.sum("n").cast("double").alias("total"))
    small = F.floor(F.col("total") / shards)
    capacities = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: small.cast("double") + F.when(s < F.col("total") - small * shards, 1.0).otherwise(0.0))
    places = F.sequence(F.lit(0), F.lit(shards - 1))

    def deal(state: Column, block: Column) -> Column:
        start = F.struct(
            block["n"].alias("left"),
            F.aggregate(state["free"], F.lit(0.0), lambda a, x: a + x).alias("total"),
            F.array().cast("array<double>").alias("row"),
        )

        def one_shard(s: Column, place: Column) -> Column:
            free = F.element_at(state["free"], place + 1)
            count = hypergeometric(s["total"], free, s["left"], unit_draw(F.lit(seed), F.lit("matrix"), block["block"], place))
            return bound(count, lambda c: F.struct((s["left"] - c).alias("left"), (s["total"] - free).alias("total"), F.concat(s["row"], F.array(c)).alias("row")))

        row = F.aggregate(places, start, one_shard, lambda s: s["row"])
        return bound(row, lambda r: F.struct(
            F.zip_with(state["free"], r, lambda a, b: a - b).alias("free"),
            F.concat(state["out"], F.array(F.struct(block["block"].alias("block"), r.alias("counts")))).alias("out"),
        ))

    start = F.struct(capacities.alias("free"), F.array().cast("array<struct<block:bigint,counts:array<double>>>").alias("out"))
    dealt = one.select(F.explode(F.aggregate(F.col("blocks"), start, deal, lambda s: s["out"])).alias("b")).select("b.block", "b.counts")
    upto = F.transform(places, lambda s: F.aggregate(F.slice("counts", 1, s + 1), F.lit(0.0), lambda a, x: a + x).cast("bigint"))
    return dealt.select("block", upto.alias("upto"))


def rank_in_group(df: DataFrame, group: str, draw: str, ties: list[str], rows: int, groups: int, name: str) -> DataFrame:
    """The place of each row in its group by a uniform draw, from 0; a large group is split by ranges of the draw.

    Each range is ordered by itself, and starts where the ranges before it end.
    """
    bits = max(0, (rows // (groups * ROWS_PER_TASK)).bit_length())
    ranged = df.withColumn("__range", F.shiftrightunsigned(F.col(draw), 64 - bits) if bits else F.lit(0).cast("bigint"))
    before = F.sum("__n").over(Window.partitionBy(group).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    starts = ranged.groupBy(group, "__range").agg(F.count("*").alias("__n")).select(group, "__range", F.coalesce(before, F.lit(0)).alias("__start"))
    in_order = F.row_number().over(Window.partitionBy(group, "__range").orderBy(F.shiftrightunsigned(F.col(draw), 1), *ties))
    return ranged.withColumn("__place", in_order).join(starts, [group, "__range"]).withColumn(name, F.col("__start") + F.col("__place") - 1).drop("__start", "__place", "__range")


def shuffle_shards(docs: DataFrame, shards: int = 24, seed: int = 17, id_column: str = "doc_id", text_column: str = "text", blocks: int = BLOCKS) -> DataFrame:
    """One row per document: doc_id, size (bytes of the text plus 8), text_crc32, shard, slot (place in the shard, from 0).

    `blocks` bounds the matrix: partitions beyond that number share a row of it.
    """
    content = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    facts = id_text(docs, id_column, text_column).select("doc_id", (F.octet_length(content) + 8).cast("bigint").alias("size"), F.crc32(content).alias("text_crc32"))
    row = ["doc_id", "size", "text_crc32"]
    rows = stored(
        facts.withColumns({
            "block": F.pmod(F.spark_partition_id().cast("bigint"), F.lit(blocks)),
            "leave": F.xxhash64(F.lit(seed), F.lit("leave"), *row),
            "arrive": F.xxhash64(F.lit(seed), F.lit("arrive"), *row),
        }),
        "shard-rows",
    )
    counts = stored(rows.groupBy("block").agg(F.count("*").alias("n")), "block-counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    matrix = stored(communication_matrix(counts, shards, seed), "communication")
    left = rank_in_group(rows, "block", "leave", row, total, blocks, "position")
    dealt = left.join(F.broadcast(matrix), "block").withColumn("shard", F.size(F.filter("upto", lambda x: x <= F.col("position"))).cast("int"))
    placed = rank_in_group(dealt.select(*row, "shard", "arrive"), "shard", "arrive", row, total, shards, "slot")
    return placed.select(*row, "shard", "slot")
