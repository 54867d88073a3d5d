"""URL filters with dated lists: which list entry was in force when a page was fetched.

A list is a log of dated changes to host patterns (a pattern covers its host and all hosts below it).
Each change holds until the pattern's next one, so the log becomes validity intervals [day, until). An
as-of join then finds, for every capture, the entries in force on its fetch day; the longest pattern wins.

Captures are reduced to their distinct (host, day) first, so a host with a third of all pages costs as many
rows as it has days. Intervals are cut into cells of `CELL` days; host suffixes meet them by equality of
pattern and cell, and the exact bounds decide. The list is broadcast only if its counted cells are few; a longer one is repeated
`SALTS` times and hosts are dealt to the copies, as a suffix such as `com` belongs to most of them. Verdicts go back to captures
by moment, with those of very many captures joined by broadcast; captures without host or day stay out of the join.

The host stands after user information (`name:word@`) and before a port; a final dot, as in `x.org.`, is no part
of it, nor of a pattern. A host in brackets (IPv6) is taken with them, as a whole. Very long URLs are read whole; equal patterns of one
length cannot both be in force for a host, so there are no ties. A null or malformed URL, or a null day, has no verdict and is not blocked. Of changes to one pattern on one
day, an addition beats a removal and 'block' beats 'allow'. Null patterns or days in the log are left out.
Repeated captures each get their row. An empty log blocks nothing; no captures give no rows. Other columns
are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowsieve.functions.tables import BROADCAST_ROWS
from flowsieve.functions.values import col
from flowsieve.llm.tables import join_large_groups, stored

CELL, SALTS = 32, 16
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?+(\[[^\]/?#@]*\]|[^/?#:@\[]+?)\.?(?:[/?#:]|\z)"


def intervals(log: DataFrame) -> DataFrame:
    """pattern, verdict, day, until from the log's pattern, day, action (add or remove), verdict (block or allow)."""
    rank = F.when(F.col("action") == "add", 2).otherwise(0) + F.when(F.col("verdict") == "block", 1).otherwise(0)
    known = log.filter(F.col("pattern").isNotNull() & F.col("day").isNotNull()).select(F.regexp_replace(F.lower("pattern"), r"\.$", "").alias("pattern"), F.col("day").cast("int").alias("day"), rank.alias("rank"))
    one = known.groupBy("pattern", "day").agg(F.max("rank").alias("rank"))
    until = F.lead("day").over(Window.partitionBy("pattern").orderBy("day"))
    return one.withColumn("until", until).filter("rank >= 2").select("pattern", F.when(F.col("rank") == 3, "block").otherwise("allow").alias("verdict"), "day", "until")


def suffixes(host: str):
    """The host and every host above it, as an array."""
    labels = F.split(F.col(host), r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def in_force(moments: DataFrame, valid: DataFrame) -> DataFrame:
    """The winning entry for each distinct host and day: host, day, pattern, verdict, since. Moments without one have no row."""
    last = moments.agg(F.max("day")).first()[0]
    if last is None:
        last = 0
    end = F.least(F.coalesce(F.col("until") - 1, F.lit(last)), F.lit(last))
    cells = F.sequence(F.floor(F.col("day") / CELL), F.floor(F.greatest(end, F.col("day")) / CELL))
    entries = stored(valid.filter(F.col("day") <= last).select("pattern", "verdict", F.col("day").alias("since"), "until", F.explode(cells).alias("cell")), "list-cells")
    asked = moments.select("host", "day", F.floor(F.col("day") / CELL).alias("cell"), F.explode(suffixes("host")).alias("pattern"))
    if entries.count() <= BROADCAST_ROWS:
        joined = asked.join(F.broadcast(entries), ["pattern", "cell"])
    else:
        copies = entries.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = asked.withColumn("salt", F.pmod(F.xxhash64("host", "day"), F.lit(SALTS)).cast("int")).join(copies, ["pattern", "cell", "salt"])
    met = joined.filter((F.col("since") <= F.col("day")) & (F.col("until").isNull() | (F.col("day") < F.col("until"))))
    best = F.max(F.struct(F.length("pattern").alias("size"), "pattern", "verdict", "since")).alias("best")
    return met.groupBy("host", "day").agg(best).select("host", "day", "best.pattern", "best.verdict", "best.since")


def filter_urls(captures: DataFrame, log: DataFrame, id_column: str = "page_id", url_column: str = "url", day_column: str = "fetch_day") -> DataFrame:
    """One row per capture: page_id, url, host, fetch_day, blocked, pattern, verdict, since."""
    host = F.lower(F.nullif(F.regexp_extract(col(url_column), HOST, 1), F.lit("")))
    rows = captures.select(col(id_column).alias("page_id"), col(url_column).alias("url"), host.alias("host"), col(day_column).cast("int").alias("day"))
    dated = F.col("host").isNotNull() & F.col("day").isNotNull()
    moments = stored(rows.filter(dated).groupBy("host", "day").agg(F.count("*").alias("n")), "moments")
    verdicts = in_force(moments.drop("n"), intervals(log))
    moment = F.concat_ws(" ", "day", "host").alias("moment")
    facts = stored(moments.join(verdicts, ["host", "day"], "left").select(moment, "n", "pattern", "verdict", "since"), "moment-verdicts")
    judged = join_large_groups(rows.filter(dated).select("*", moment), facts, "moment", "n", rows.count())
    nothing = [F.lit(None).cast(facts.schema[c].dataType).alias(c) for c in ("pattern", "verdict", "since")]
    both = judged.drop("moment", "n").unionByName(rows.filter(~dated).select("*", *nothing))
    return both.select(
        "page_id", "url", "host", F.col("day").alias("fetch_day"), F.coalesce(F.col("verdict") == "block", F.lit(False)).alias("blocked"), "pattern", "verdict", "since"
    )
