"""Shards by balanced label propagation over links of equal texts.

Law: ``rows`` — shard sizes differ by one row at most, and hold after every round.

A link joins documents of equal text (equal SHA-256).  Documents of one text form a star
around their text's node, so links are never written as pairs.  The first assignment deals
rows out evenly by hash.  Then rounds of propagation: every text counts its documents by
shard, the shards that hold most of them (as many as its size needs) are its targets, and
documents elsewhere propose to move there.  A shard admits proposals, from the texts that
gain most first, as far as its quota leaves room or unlinked documents can make way; those
go to the shards that were left.  Ranks under a quota are taken over hash bins, so that no
shard's rows meet in one task.  Rounds end when no document moves or after ``rounds``.

Edge cases: a null text has size 1 and checksum 0 of no bytes, and null texts are linked
with each other; null ids are kept and dealt like others; rows that repeat are rows of
their own; fewer rows than shards leave shards empty; an empty table gives none; other
columns are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

SHARDS, ROUNDS = 16, 6
#: Rows of a bin in which ranks are taken at once.
BIN_ROWS = 50_000


def ranked(df: DataFrame, group: str, order: list[Column], name: str, rows: int, level: str | None = None) -> DataFrame:
    """Adds ``name``: gapless ranks from 0 in each group, by ``level`` (few values, the
    highest first) and then by hash bins.

    A group's rows are counted by level and bin, the counts are summed up, and a row's rank is
    that sum and its place within its bin, so a task holds bins and never a group."""
    from pyspark.sql import Window

    bins = max(1, -(-rows // BIN_ROWS))
    df = df.withColumn("__bin", F.pmod("h", F.lit(bins)).cast("int")).withColumn("__level", F.col(level) if level else F.lit(0))
    count = df.groupBy(group, "__level", "__bin").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(group).orderBy(F.desc("__level"), "__bin").rowsBetween(Window.unboundedPreceding, -1)
    base = count.withColumn("__base", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    place = Window.partitionBy(group, "__level", "__bin").orderBy(*order)
    out = df.withColumn("__place", F.row_number().over(place) - 1).join(base, [group, "__level", "__bin"])
    return out.withColumn(name, (F.col("__base") + F.col("__place")).cast("long")).drop("__bin", "__level", "__base", "__place")


def by_shard(df: DataFrame, column: str, shards: int) -> list[int]:
    """Counts of a column of shards: at most ``shards`` numbers."""
    out = [0] * shards
    for r in df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n")).collect():
        out[r[0]] = r.n
    return out


def pick(values: list[int], at: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), at + 1)


def propagate(state: DataFrame, quota: list[int], rows: int, work: common.Workspace, turn: int = 0) -> tuple[DataFrame, int]:
    """One round over ``rid, h, text_key, members, shard``; also how many documents moved."""
    shards = len(quota)
    largest = max(quota)
    linked = state.where("members > 1")
    # Shards that could admit anyone; another counts half unless a text fills it itself.
    loose, size = by_shard(state.where("members = 1"), "shard", shards), by_shard(state, "shard", shards)
    can = F.element_at(F.array(*(F.lit(loose[s] + quota[s] - size[s] > 0) for s in range(shards))), F.col("shard") + 1)
    weight = F.when(can | (F.col("n") * 2 >= largest), F.col("n").cast("double")).otherwise(F.col("n") * 0.49)
    held = linked.groupBy("text_key", "shard").agg(F.count(F.lit(1)).alias("n"), F.max("members").alias("members"))
    # At most one entry for each shard and text.
    tops = held.groupBy("text_key").agg(F.max("members").alias("members"), F.sort_array(F.collect_list(F.struct((-weight).alias("n"), F.pmod(F.xxhash64("text_key", "shard", F.lit(turn)), F.lit(1 << 30)).alias("tie"), "shard"))).alias("s"))
    need = F.ceil(F.col("members") / largest).cast("int")
    tops = tops.select("text_key", F.transform(F.slice("s", 1, F.greatest(need, F.lit(1))), lambda x: x["shard"]).alias("targets"))
    tops = work.write(tops, "targets")
    wish = state.join(tops, "text_key", "left")
    target = F.element_at("targets", F.pmod(F.xxhash64("h", F.lit(3)), F.size("targets")).cast("int") + 1)
    # What a text gains by gathering, in powers of two, is the order of admission.
    wish = wish.withColumn("target", F.when(F.col("targets").isNotNull() & ~F.array_contains("targets", F.col("shard")), target)).withColumn("level", F.when(F.col("members") > 1, F.log2("members").cast("int")).otherwise(0)).drop("targets")
    wish = work.write(wish, "wishes")

    into = by_shard(wish, "target", shards)
    # Admissions: a shard's room, and its unlinked documents that can make way.  What it sends
    # away counts only once it is sure to be admitted elsewhere, so not in this round.
    admitted = [min(into[s], quota[s] - size[s] + loose[s]) for s in range(shards)]
    if not any(admitted):
        return state, 0
    movers = ranked(wish.where("target is not null"), "target", [F.desc("level"), "h", "rid"], "rank", rows, "level")
    movers = movers.where(F.col("rank") < pick(admitted, F.col("target"))).select("rid", F.col("target").alias("moved_to"))
    after = work.write(wish.drop("target", "level").join(movers, "rid", "left"), "moved")
    now = by_shard(after.select(F.coalesce("moved_to", "shard").alias("s")), "s", shards)
    over = [max(0, now[s] - quota[s]) for s in range(shards)]
    short = [max(0, quota[s] - now[s]) for s in range(shards)]
    # Unlinked documents of shards that are over go to those that are short, in one sequence.  All
    # find a seat: quotas add up to the rows, so as many are short as are over.
    starts, bounds, total = [], [], 0
    for s in range(shards):
        starts.append(total)
        total += over[s]
    filled = 0
    for s in range(shards):
        filled += short[s]
        bounds.append(filled)
    evicted = ranked(after.where("members = 1"), "shard", ["h", "rid"], "rank", rows).where(F.col("rank") < pick(over, F.col("shard")))
    seat = F.col("rank") + pick(starts, F.col("shard"))
    place = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= seat))
    evicted = evicted.select("rid", place.cast("int").alias("sent_to"))
    done = after.join(evicted, "rid", "left").withColumn("shard", F.coalesce("moved_to", "sent_to", "shard")).drop("moved_to", "sent_to")
    return done, sum(admitted)


def shard(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, size, text_crc32, shard, slot`` of every row."""
    data = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    key = F.when(F.col(text_col).isNull(), F.lit("null")).otherwise(F.sha2(data, 256))
    rows = docs.select(F.col(id_col).alias("id"), (F.octet_length(data) + 1).cast("long").alias("size"), F.crc32(data).alias("text_crc32"), key.alias("text_key"))
    # A row's own number: repeated rows are told apart once they are written down.
    spark = docs.sparkSession
    first = common.Workspace(spark, "shard_rows")
    rows = common.materialise(first.write(rows, "rows").withColumn("rid", F.monotonically_increasing_id()), "numbered").withColumn("h", F.xxhash64("rid", "id"))
    n = rows.count()
    quota = [n // shards + (s < n % shards) for s in range(shards)]
    members = first.write(rows.groupBy("text_key").agg(F.count(F.lit(1)).alias("members")).where("members > 1"), "members")
    state = rows.select("rid", "h", "text_key").join(members, "text_key", "left").withColumn("members", F.coalesce("members", F.lit(1)))
    # Even from the start: ranks over all rows, dealt in turn.
    state = ranked(state.withColumn("all", F.lit(0)), "all", ["h", "rid"], "rank", n).withColumn("shard", F.pmod("rank", F.lit(shards)).cast("int")).drop("all", "rank")
    kept = common.Workspace(spark, "shard_state")
    state = kept.write(state, "state")
    first.clear()
    for turn in range(rounds):
        # A round's own tables go as soon as its result is written.
        work = common.Workspace(spark, "shard_round")
        after, moved = propagate(state, quota, n, work, turn)
        if moved:
            now = common.Workspace(spark, "shard_state")
            state = now.write(after, "state")
            kept.clear()
            kept = now
        work.clear()
        if not moved:
            break
    placed = ranked(state.select("rid", "h", "shard"), "shard", ["h", "rid"], "slot", n).select("rid", "shard", "slot")
    return rows.join(placed, "rid").select(F.col("id").alias(id_col), "size", "text_crc32", "shard", "slot")


def cut_links(sharded: DataFrame, key: str) -> int:
    """Documents that are not in the shard where most of their text's documents are."""
    held = sharded.groupBy(key, "shard").agg(F.count(F.lit(1)).alias("n"))
    return held.groupBy(key).agg((F.sum("n") - F.max("n")).alias("cut")).agg(F.sum("cut")).first()[0] or 0


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = shard(common.table(spark, sf_dir, "documents"))
    return got.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast(T.IntegerType()).alias("grown_shard"))
