"""Near-duplicate groups by HyperMinHash banding, estimation and exact confirmation.

Steps, each ending in a table of the shared folder:

1. One pass over the texts makes, for each document, the size and a 128-bit digest of its
   shingle set, and its registers.  Documents with equal sets are one class, a node with a
   number of its own; only nodes go on.
2. Forty bands of six registers each put every node into forty buckets.  A pair
   at the threshold shares no bucket with a probability below 1e-8 (0.85) or 6e-6 (0.8).
3. Buckets are linked by stars, never by pairs: in each round a member is held against one
   center of its buckets.  The collision-corrected estimate goes first, then the full sets
   are compared exactly.  After a round only buckets that still hold several components
   stay, with other centers.
4. What is left is settled exactly: in each such bucket, all members outside its largest
   component are held against all others, in blocks of bounded size, first by registers; a
   pair that the estimate can't rule out (it is less than six standard errors below the
   threshold, see ``least_estimate``) is confirmed on full sets, and no cap is set on how many are.  Blocks of a large
   bucket hold the sets themselves and give out links only; those of a small one give out
   pairs, so that few sets move.
5. Links, and the classes of one id, become components by large-star and small-star rounds over
   salted joins; a component has the smallest id of its nodes.

Ids are of any type with an order (strings go by their bytes).  Edge cases: a null text or one
without words has an empty set, is linked with nothing and is its own component; rows that share
an id are one document with several texts: each text is compared, and they stand or fall
together; a null id has a null component, takes part in no link and is kept; an empty
table gives none; other columns, whatever their names, are never read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, sketches

STAR_ROUNDS = 2
#: Standard errors below the threshold from which on an estimate rules a pair out.
ERRORS = 6
SALTS = 64
BLOCK_STRAYS, BLOCK_MEMBERS = 512, 2048
#: Members of a bucket from which on its blocks hold the sets.
LARGE = 48


def least_estimate(percent: int) -> float:
    """The estimate below which a pair is ruled out: a pair at the threshold falls there with a
    probability of 9e-9 (0.80) or 2e-8 (0.85), a more similar one more rarely."""
    t = percent / 100
    return t - ERRORS * (t * (1 - t) / sketches.REGISTERS) ** 0.5


def features(docs: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """``id, h, n, class, sketch``: ``h`` is a hash of the text; class and sketch are null for an
    empty set."""

    def make():
        sets = sketches.Sets(size)

        def work(texts):
            raw, off = common.flat(texts)
            raw, off = raw.tobytes(), off.tolist()
            n, classes, found = [], [], []
            for a, b in zip(off, off[1:]):
                s = sets.of(raw[a:b])
                n.append(len(s))
                classes.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                found.append(sketches.registers(s).tobytes() if len(s) else None)
            return [pa.array(n, pa.int64()), pa.array(classes, pa.binary()), pa.array(found, pa.binary())]

        return work

    fields = [("n", T.LongType()), ("class", T.BinaryType()), ("sketch", T.BinaryType())]
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
    return common.map_texts(rows, make, fields, "id", "text", keep=["h"])


def bands(nodes: DataFrame) -> DataFrame:
    """``key, id``: the buckets of each node (``id, sketch``)."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                keys = sketches.band_keys(np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint16))
                ids = part.column(0).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(ids, keys.shape[1]))], names=["key", "id"])

    return nodes.select("id", "sketch").mapInArrow(common.tidied(run), "key long, id long")


def payloads(docs: DataFrame, active: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """``id, sketch, shingles`` of the active nodes (``id, doc, h, class``), whose set is made again
    from the text of the document ``doc`` that has the hash ``h``."""
    a = active.select(F.col("id").alias("a_id"), F.col("doc").alias("a_doc"), F.col("h").alias("a_h"), F.col("class").alias("a_class")).hint("shuffle_hash")
    texts = docs.select(F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text")).where("doc is not null and text is not null")
    wanted = texts.join(a, (F.col("doc") == F.col("a_doc")) & (F.col("h") == F.col("a_h"))).select(F.col("a_id").alias("id"), "text", "a_class")
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("sketch", T.BinaryType()), T.StructField("shingles", T.BinaryType())])

    def run(batches):
        sets = sketches.Sets(size)
        for whole in batches:
            for b in common.chunks(whole, "text", 2 << 20):
                raw, off = common.flat(b.column(1))
                raw, off = raw.tobytes(), off.tolist()
                out = []
                for i, c, x, y in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), off, off[1:]):
                    s = sets.of(raw[x:y])
                    if len(s) and xxhash.xxh3_128_digest(s.tobytes()) == c:
                        out.append((i, sketches.registers(s).tobytes(), s.tobytes()))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.binary()), pa.array([o[2] for o in out], pa.binary())], names=schema.names)

    return wanted.mapInArrow(common.tidied(run), schema)


def confirm(pairs: DataFrame, payload: DataFrame, percent: int) -> DataFrame:
    """Of distinct pairs ``a, c`` those that are linked. A center's members are dealt to
    ``SALTS`` groups, each of which gets the center's set once and streams the members'."""
    dealt = pairs.select("c", F.pmod(F.xxhash64("a"), F.lit(SALTS)).cast("int").alias("salt"), "a")
    wanted = dealt.select("c", "salt", F.col("a").alias("id"), F.lit(1).alias("role")).unionAll(dealt.select("c", "salt").distinct().select("c", "salt", F.col("c").alias("id"), F.lit(0).alias("role")))
    rows = wanted.hint("shuffle_hash").join(payload, "id").select("c", "salt", "role", "id", "sketch", "shingles")
    rows = rows.repartition("c", "salt").sortWithinPartitions("c", "salt", "role")
    least = least_estimate(percent)

    def run(batches):
        key, sketch, held = None, None, np.zeros(0, np.uint64)
        for b in batches:
            c, salt, role, ids = (b.column(i).to_pylist() for i in range(4))
            out_a, out_c = [], []
            for i in range(b.num_rows):
                regs, mine = np.frombuffer(b.column(4)[i].as_py(), np.uint16), np.frombuffer(b.column(5)[i].as_py(), np.uint64)
                if role[i] == 0:
                    key, sketch, held = (c[i], salt[i]), regs, mine
                elif (c[i], salt[i]) == key and sketches.estimate(regs, sketch, len(mine), len(held)) >= least:
                    if sketches.linked(mine, held, percent):
                        out_a.append(ids[i])
                        out_c.append(c[i])
            if out_a:
                yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_c, pa.int64())], names=["a", "c"])

    return rows.mapInArrow(common.tidied(run), "a long, c long")


def star(edges: DataFrame, large: bool) -> DataFrame:
    """One large-star or small-star step over edges ``a > b``: every node sends its larger
    (smaller, and itself) neighbours to the least of its neighbourhood."""
    flow = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        flow = flow.unionAll(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = flow.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    # A node may have a third of all edges: its rows go to 16 places.
    spread = least.select("u", "m", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("salt"))
    joined = flow.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(16)).cast("int")).join(spread, ["u", "salt"])
    if large:
        out = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.where("v != m").select(F.col("v").alias("a"), F.col("m").alias("b")).unionAll(least.where("u != m").select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct()


def settled(edges: DataFrame) -> bool:
    """Whether the edges are stars around their least nodes: every node has one edge down, or
    edges up alone."""
    roles = edges.select(F.col("a").alias("u"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionAll(edges.select(F.col("b").alias("u"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    return roles.groupBy("u").agg(F.sum("down").alias("down"), F.max("up").alias("up")).where("down > 1 or (down > 0 and up > 0)").isEmpty()


def components(links: DataFrame, work: common.Workspace) -> DataFrame:
    """``id, component`` of all nodes of links ``a, c``: the smallest id that is reachable."""
    edges = work.write(links.select(F.greatest("a", "c").alias("a"), F.least("a", "c").alias("b")).where("a != b").distinct(), "edges")
    while not settled(edges):
        edges = work.write(star(work.write(star(edges, True), "large"), False), "small")
    return work.write(edges.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("id"), "component").unionAll(edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()), "components")


def with_components(entries: DataFrame, found: DataFrame) -> DataFrame:
    return entries.join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))


def leftover(entries: DataFrame, payload: DataFrame, percent: int, work: common.Workspace) -> DataFrame:
    """Distinct pairs ``a, c`` of different components that share a bucket, with ``sure``:
    links already (true), or pairs that the estimate can't rule out. ``entries`` (``key, id,
    component``) are of buckets with several components."""
    sizes = entries.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
    main = sizes.groupBy("key").agg(F.max(F.struct("n", F.negative("component").alias("least"))).alias("m"), F.sum("n").alias("n")).select("key", F.negative("m.least").alias("main"), (F.col("n") - F.col("m.n")).alias("strays"), "n")
    main = work.write(main, "main")
    e = entries.join(main, "key")
    stray_blocks = F.ceil(F.col("strays") / BLOCK_STRAYS).cast("int")
    member_blocks = F.ceil(F.col("n") / BLOCK_MEMBERS).cast("int")
    mine = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    large = (F.col("n") >= LARGE).alias("large")
    strays = e.where("component != main").select("key", mine(stray_blocks).alias("i"), F.explode(F.sequence(F.lit(0), member_blocks - 1)).alias("j"), F.lit(0).alias("role"), "id", "component", large)
    members = e.select("key", F.explode(F.sequence(F.lit(0), stray_blocks - 1)).alias("i"), mine(member_blocks).alias("j"), F.lit(1).alias("role"), "id", "component", large)
    rows = strays.unionAll(members).join(payload.hint("shuffle_hash"), "id").select("key", "i", "j", "role", "id", "component", "sketch", (F.octet_length("shingles") / 8).cast("long").alias("n"), F.when(F.col("large"), F.col("shingles")).alias("shingles"))
    rows = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "role")
    least = least_estimate(percent)

    def run(batches):
        key, ids, comps, regs, sizes, sets, keys = None, [], [], [], [], [], None
        for b in batches:
            cols = [b.column(i).to_pylist() for i in (0, 1, 2, 3, 4, 5, 7)]
            out_a, out_c, out_sure = [], [], []
            for at, (k, i, j, role, node, comp, n) in enumerate(zip(*cols)):
                mine = np.frombuffer(b.column(6)[at].as_py(), np.uint16)
                held = b.column(8)[at].as_py()
                held = None if held is None else np.frombuffer(held, np.uint64)
                if key != (k, i, j):
                    key, ids, comps, regs, sizes, sets, keys = (k, i, j), [], [], [], [], [], None
                if role == 0:
                    ids.append(node)
                    comps.append(comp)
                    regs.append(mine)
                    sizes.append(n)
                    sets.append(held)
                elif len(ids):
                    if keys is None:
                        ids, comps, regs, sizes = np.array(ids), np.array(comps), np.array(regs), np.array(sizes)
                        keys = sketches.band_keys(regs)
                    near = np.flatnonzero(comps != comp)
                    near = near[sketches.estimate(regs[near], mine, sizes[near], n) >= least]
                    if len(near):
                        # A pair speaks in the first bucket that it shares.
                        same = keys[near] == sketches.band_keys(mine[None])
                        near = near[keys[near][np.arange(len(near)), same.argmax(1)] == k]
                    for s in near.tolist():
                        if held is None or sketches.linked(sets[s], held, percent):
                            out_a.append(max(int(ids[s]), node))
                            out_c.append(min(int(ids[s]), node))
                            out_sure.append(held is not None)
            if out_a:
                yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_c, pa.int64()), pa.array(out_sure)], names=["a", "c", "sure"])

    return rows.mapInArrow(common.tidied(run), "a long, c long, sure boolean").distinct()


def group(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", rounds: int = STAR_ROUNDS) -> DataFrame:
    """``id, n_shingles, component_id, kept`` of every row."""
    spark = docs.sparkSession
    common.ship(spark)
    work = common.Workspace(spark, "near_dups")
    # A row's number, once it is written down; a class goes by the least of its rows'.
    feats = common.materialise(features(docs, size, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "near_features")
    there = feats.where("class is not null and id is not null")
    classes = work.write(there.groupBy("class").agg(F.min("row").alias("node"), F.min("id").alias("least")), "classes")
    nodes = work.write(there.select(F.col("row").alias("id"), F.col("id").alias("doc"), "h", "class", "sketch").join(classes.select(F.col("node").alias("id")).hint("shuffle_hash"), "id", "left_semi"), "nodes")
    # Counted and joined in one exchange.
    entries = work.write(bands(nodes), "entries").repartition("key")
    buckets = entries.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("center")).where("n > 1").select("key", "center")
    active = work.write(entries.join(buckets, "key"), "active")
    wanted = nodes.drop("sketch").join(active.select("id").distinct(), "id", "left_semi")
    payload = work.write(payloads(docs, wanted, size, id_col, text_col).dropDuplicates(["id"]), "payloads")

    # The classes of one id belong together.
    several = there.groupBy("id").agg(F.min(F.xxhash64("class")).alias("x"), F.max(F.xxhash64("class")).alias("y")).where("x != y").select("id")
    mine = work.write(there.select("id", "class").join(several, "id", "left_semi").distinct().join(classes.select("class", "node"), "class").select("id", F.col("node").alias("a")), "own")
    links = mine.join(mine.groupBy("id").agg(F.min("a").alias("c")), "id").where("a != c").select("a", "c")
    found = components(links, work)
    open_entries = active.select("key", "id", "center")
    tried = None
    for k in range(rounds):
        if k:
            # Other centers: the least id under a mask that the bucket's key and the round make.
            mask = F.xxhash64("key", F.lit(k))
            centers = work.write(open_entries.groupBy("key").agg(F.min(F.col("id").bitwiseXOR(mask)).alias("least")).select("key", F.col("least").bitwiseXOR(mask).alias("center")), "centers")
            open_entries = open_entries.select("key", "id").join(centers, "key")
        offers = open_entries.where("id != center").groupBy(F.col("id").alias("a"), F.col("center").alias("c")).agg(F.count(F.lit(1)).alias("n"))
        if k:
            offers = offers.join(found.select(F.col("id").alias("a"), F.col("component").alias("ca")), "a", "left").join(found.select(F.col("id").alias("c"), F.col("component").alias("cc")), "c", "left")
            offers = offers.where("coalesce(ca, a) != coalesce(cc, c)").join(tried, ["a", "c"], "left_anti")
        best = offers.groupBy("a").agg(F.max(F.struct("n", F.negative("c").alias("least"))).alias("m")).select("a", F.negative("m.least").alias("c"))
        best = work.write(best, "offers")
        tried = best if tried is None else tried.unionAll(best)
        links = links.unionAll(work.write(confirm(best, payload, percent), "links"))
        found = components(links, work)
        # Only buckets with several components go on.
        state = with_components(open_entries.select("key", "id"), found)
        spread = work.write(state.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x != y").select("key"), "several")
        open_entries = work.write(state.join(spread, "key").select("key", "id", "component"), "open")
    rest = work.write(leftover(open_entries, payload, percent, work), "leftover")
    doubtful = rest.where("not sure").select("a", "c").join(tried, ["a", "c"], "left_anti")
    found = components(links.unionAll(rest.where("sure").select("a", "c")).unionAll(confirm(doubtful, payload, percent)), work)

    # Of linked classes, the smallest id of their component.
    linked = work.write(classes.join(found.withColumnRenamed("id", "node"), "node").select("class", "component", "least"), "linked")
    least = linked.groupBy("component").agg(F.min("least").alias("first"))
    of_class = common.materialise(classes.select("class", "least").join(linked.join(least, "component").select("class", "first"), "class", "left").select("class", F.coalesce("first", "least").alias("component")), "near_classes")
    work.clear()
    out = feats.select("id", "n", "class").join(of_class, "class", "left")
    out = out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))


def keep_first(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, of one document of each group."""
    name = common.fresh(docs, "gone_id")
    gone = group(docs, size, percent, id_col, text_col).where(~F.col("kept")).select(F.col(id_col).alias(name)).distinct()
    return docs.join(common.materialise(gone, "near_gone").hint("shuffle_hash"), F.col(id_col) == F.col(name), "left_anti")


def op8_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group(common.table(spark, sf_dir, "documents"), 3, 85)
