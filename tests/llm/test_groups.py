"""Operators over whole tables: shards, near duplicates and the pipeline."""

import re
import zlib
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from hexalloc.llm import bpe, common, decontamination, language_id, near_dups, quality, sharding, sketches

SF = "/root/testdata/sf0.001"


def shingles(text, size):
    w = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    if not w:
        return frozenset()
    return frozenset([tuple(w)]) if len(w) < size else frozenset(zip(*(w[i:] for i in range(size))))


def brute_groups(rows, size, percent):
    sets = {i: shingles(t, size) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    index = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            index[x].append(i)
    for i, s in sets.items():
        for j, both in Counter(j for x in s for j in index[x] if j < i).items():
            if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def mutated(text, k):
    w = text.split()
    w[k % len(w)] = f"changed{k}"
    return " ".join(w)


@pytest.fixture(scope="module")
def copies(documents):
    """Documents with chains of copies that differ more and more, short sets and empty ones."""
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    base = max(rows, key=lambda r: len(r[1]))[1][:1500]
    chain, t = [], base
    for k in range(60):
        t = mutated(t, 7 * k + 3)
        chain.append((5000 + k, t))
    star = [(6000 + k, mutated(mutated(base, 3 * k), 5 * k + 1)) for k in range(80)]
    short = [(7000 + k, t) for k, t in enumerate([None, "", " ", "a", "a", "A b", "a b c d e f g h", "a b c d e f g h i", "b c d e f g h i"])]
    return rows + chain + star + short


@pytest.mark.parametrize("size,percent,large", [(3, 85, 48), (3, 85, 10_000), (5, 80, 48)])
def test_near_duplicates(spark, copies, monkeypatch, size, percent, large):
    monkeypatch.setattr(near_dups, "LARGE", large)
    docs = spark.createDataFrame(copies, "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dups.group(docs, size, percent).collect()}
    assert got == brute_groups(copies, size, percent)


def test_near_duplicate_edges(spark, edges, nothing):
    got = near_dups.group(edges, 3, 85).collect()
    assert len(got) == edges.count()
    rows = {r.doc_id: r for r in got if r.doc_id is not None}
    assert rows[7].component_id == 6 and not rows[7].kept and rows[6].kept
    assert rows[0].n_shingles == 0 and rows[0].component_id == 0 and rows[1].component_id == 1
    assert all(r.component_id is None and r.kept for r in got if r.doc_id is None)
    assert near_dups.keep_first(edges).columns == edges.columns
    assert near_dups.group(nothing, 3, 85).count() == 0


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(1, 70)] + [(100, k) for k in range(101, 140)] + [(300, 299), (299, 298)]
    got = {r.id: r.component for r in near_dups.components(spark.createDataFrame(edges, "a long, c long"), common.Workspace(spark, "t")).collect()}
    assert {got[i] for i in range(1, 71)} == {1} and {got[k] for k in range(100, 140)} == {100} and {got[i] for i in (298, 299, 300)} == {298}


def test_registers_keep_order():
    import numpy as np

    x = np.sort(np.random.default_rng(0).integers(1, 1 << 63, 5000, dtype=np.uint64))
    c = sketches.compress(x)
    zeros = (c >> 10).astype(int)
    assert zeros.tolist() == [64 - int(v).bit_length() for v in x]
    assert c[0] == sketches.compress(x[:1])[0]


def test_estimate_is_near():
    import numpy as np

    rng = np.random.default_rng(5)
    both, a, b = (rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (850, 75, 75))
    e = sketches.estimate(sketches.registers(np.concatenate([both, a])), sketches.registers(np.concatenate([both, b])), 925, 925)
    assert e == pytest.approx(0.85, abs=0.08)


@pytest.mark.parametrize("n,m,both", [(40, 40, 0), (400, 100, 50), (3, 200, 1), (900, 900, 800)])
def test_collisions_by_chance(n, m, both):
    """Registers whose minima differ agree as often as the correction says, for small and for unequal
    sets; a mantissa of ten bits makes few, so many random registers are drawn."""
    import numpy as np

    rng, draws, same, differ = np.random.default_rng(n * m), 400_000, 0, 0
    for at in range(0, draws, 20_000):
        # The least of k values is drawn at once: 1 - (1 - u)^(1/k).
        parts = [1 - (1 - rng.random(20_000)) ** (1 / k) if k else np.ones(20_000) for k in (n - both, m - both, both)]
        a, b = np.minimum(parts[0], parts[2]), np.minimum(parts[1], parts[2])
        x, y = (sketches.compress((v * 2.0**63).astype(np.uint64) << np.uint64(1)) for v in (a, b))
        differ += int((a != b).sum())
        same += int(((x == y) & (a != b)).sum())
    want = float(sketches.same_by_chance(np.array(float(n)), np.array(float(m)), np.array(float(both))))
    assert same / differ == pytest.approx(want, rel=0.25, abs=6e-5)


def test_near_duplicates_of_texts_with_one_id(spark):
    """Rows that share an id are one document: what is near to either text is linked."""
    base = [" ".join(f"w{k}x{i}" for i in range(300)) for k in range(3)]
    rows = [("b", base[0], 1), ("b", base[1], 2), ("a", mutated(base[1], 7), 3), ("d", mutated(base[0], 9), 4), ("e", base[2], 5), ("f", None, 6), (None, base[0], 7), ("b", base[0], 8)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, gone_id int")
    got = {r.doc_id: r.component_id for r in near_dups.group(docs, 3, 85).collect()}
    assert got == {"a": "a", "b": "a", "d": "a", "e": "e", "f": "f", None: None}
    kept = near_dups.keep_first(docs, 3, 85)
    assert kept.columns == docs.columns and sorted(r.gone_id for r in kept.collect()) == [3, 5, 6, 7]


def laws(rows, shards):
    sizes = Counter(r.shard for r in rows)
    assert max(sizes.values()) - min(sizes.get(s, 0) for s in range(shards)) <= 1 and set(sizes) <= set(range(shards))
    for s in sizes:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sizes[s]))


def test_shards(spark, documents):
    got = sharding.op4_sharding(spark, SF).collect()
    texts = {r.doc_id: r.text for r in documents.collect()}
    laws(got, 16)
    assert len(got) == len(texts)
    for r in got:
        data = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 1, zlib.crc32(data), "rows", None)


def test_links_move_together(spark):
    rows = [(i, f"text {i}") for i in range(400)] + [(1000 + i, f"copy {i % 40}") for i in range(160)] + [(2000 + i, "hot") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sharding.shard(docs, 8).collect()
    laws(got, 8)
    texts = dict(rows)
    where = defaultdict(Counter)
    for r in got:
        where[texts[r.doc_id]][r.shard] += 1
    cut = sum(sum(c.values()) - max(c.values()) for c in where.values())
    start = sum(sum(c.values()) - max(c.values()) for c in where_at_random(rows, 8).values())
    # A shard takes 108 rows, so a text of 300 must be cut at 192 of them.
    assert 192 <= cut <= 192 + (start - 192) / 4
    assert sorted(where["hot"].values())[-2:] >= [95, 95]


def where_at_random(rows, shards):
    where = defaultdict(Counter)
    for i, t in rows:
        where[t][zlib.crc32(str(i).encode()) % shards] += 1
    return where


def one_round(rows, quota):
    """A round of propagation in plain Python: rows are dicts with the engine's hashes."""
    shards = len(quota)
    size, loose = Counter(r["shard"] for r in rows), Counter(r["shard"] for r in rows if r["members"] == 1)
    can = [loose[s] + quota[s] - size[s] > 0 for s in range(shards)]
    texts = defaultdict(list)
    for r in rows:
        if r["members"] > 1:
            texts[r["text_key"]].append(r)
    for r in rows:
        r["target"], r["level"] = None, 0
    for mine in texts.values():
        held, members = Counter(r["shard"] for r in mine), mine[0]["members"]
        order = sorted(held, key=lambda s: (-(held[s] if can[s] or 2 * held[s] >= max(quota) else 0.49 * held[s]), mine[0]["ties"][s], s))
        targets = order[: max(1, -(-members // max(quota)))]
        for r in mine:
            r["level"] = members.bit_length() - 1
            if r["shard"] not in targets:
                r["target"] = targets[r["pick"] % len(targets)]
    into = Counter(r["target"] for r in rows if r["target"] is not None)
    for s in range(shards):
        movers = sorted((r for r in rows if r["target"] == s), key=lambda r: (-r["level"], r["h"], r["rid"]))
        for r in movers[: min(into[s], quota[s] - size[s] + loose[s])]:
            r["to"] = s
    now = Counter(r.get("to", r["shard"]) for r in rows)
    seats = [s for s in range(shards) for _ in range(quota[s] - now[s])]
    for s in range(shards):
        out = sorted((r for r in rows if r["members"] == 1 and r["shard"] == s), key=lambda r: (r["h"], r["rid"]))
        for r in out[: max(0, now[s] - quota[s])]:
            r["to"] = seats.pop(0)
    return {r["rid"]: r.get("to", r["shard"]) for r in rows}


def test_round_against_plain_python(spark):
    from pyspark.sql import functions as F

    shards, n = 4, 120
    keys = [f"t{i % 9}" if i < 50 else f"own{i}" for i in range(n)]
    state = spark.createDataFrame([(i, keys[i], Counter(keys)[keys[i]], (i * 7) % shards) for i in range(n)], "rid long, text_key string, members long, shard int").withColumn("h", F.xxhash64("rid", F.lit(5)))
    quota = [n // shards] * shards
    for turn in range(3):
        ties = F.array(*(F.pmod(F.xxhash64("text_key", F.lit(s), F.lit(turn)), F.lit(1 << 30)) for s in range(shards)))
        rows = [r.asDict() for r in state.withColumn("ties", ties).withColumn("pick", F.xxhash64("h", F.lit(3))).collect()]
        want = one_round(rows, quota)
        after, moved = sharding.propagate(state, quota, n, common.Workspace(spark, "t"), turn)
        got = {r.rid: r.shard for r in after.collect()}
        assert got == want and set(Counter(got.values()).values()) == {n // shards}
        state = spark.createDataFrame([(r.rid, r.text_key, r.members, r.shard, r.h) for r in after.select("rid", "text_key", "members", "shard", "h").collect()], "rid long, text_key string, members long, shard int, h long")
    where = defaultdict(set)
    for i, s in got.items():
        where[keys[i]].add(s)
    assert all(len(x) == 1 for x in where.values())


def test_shard_edges(spark, edges, nothing):
    got = sharding.shard(edges).collect()
    assert len(got) == edges.count()
    laws(got, 16)
    assert all(r.size == 1 and r.text_crc32 == 0 for r in got if r.doc_id == 0)
    assert sharding.shard(nothing).count() == 0


def test_pipeline(spark):
    """The stages against brute force over the stage before."""
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "quality_rules", "near_duplicates", "decontamination", "byte_bpe"]
    rows = {r.doc_id: r for r in docs.collect()}

    pred = {r.doc_id: r for r in language_id.identify(docs, language_id.fit_documents(docs)).collect()}
    left = {i for i in rows if pred[i].lang_pred != "und" and pred[i].score >= 0.5}
    stage = docs.where(docs.doc_id.isin(*left))
    verdict = {r.doc_id: r.kept for r in quality.judge(stage, quality.fit_references(stage)).collect()}
    left = {i for i in left if verdict[i]}
    groups = brute_groups([(i, rows[i].text) for i in sorted(left)], 5, 80)
    left = {i for i in left if groups[i][1] == i}
    stage = docs.where(docs.doc_id.isin(*left))
    dirty = {r.doc_id for r in decontamination.verdicts(stage, spark.read.parquet(f"{sf}/benchmark.parquet")).where("contaminated").collect()}
    left -= dirty
    assert dirty
    want = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digest_documents(docs.where(docs.doc_id.isin(*left))).collect()}
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, sf).collect()}
    assert got == want


def test_stages_keep_columns(spark, edges):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, edges, SF).columns == edges.columns, name
        assert stage(spark, edges.limit(0), SF).count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, edges, SF).count() == edges.count()
