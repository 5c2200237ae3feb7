"""Byte-level BPE encoding and decoding by merge replay over the words of the corpus.

Three passes.  The first cuts texts by the tokenizer's pattern, a chunk of documents at a
time: a chunk becomes the sequences of its segments (runs between spaces, each a few words)
and its distinct words, dealt by hash to parts.  In the second a part sees its words from
all chunks and encodes each of them once; a chunk's words go back to it as ids.  In the
third chunks and ids meet, and every document is put together from its segments.  Chunks
and words travel as compressed blobs, so the corpus is never a row a word.

A part's words are laid out as one long array of symbols, and an inverted index leads from
each token pair (named by the rank of the token it makes) to the positions where it stands.
Ranks are then replayed in rising order: a merge touches the positions of its pair, and only
the pairs with their neighbours are looked up again and entered into the index.

A pair made by a merge nearly always has a higher rank than that merge.  Where a
vocabulary makes a lower one, the word leaves the replay and is encoded by itself,
always taking its lowest pair, so results are those of the plain algorithm.

Edge cases: null text encodes as empty (no ids, digests of the empty string); repeated
rows give repeated results; an empty table gives none; texts of any length are encoded
whole; ids are of any type; other columns are never read.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import heapq
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Segments and words that a worker remembers; a part with more words replays some again.
MEMORY_WORDS = 250_000
#: Words that are replayed at a time, and parts that words are dealt to at most.
BLOCK_WORDS, MOST_PARTS = 100_000, 1024
#: Text of a chunk: the more, the fewer words travel twice.
CHUNK = 8 << 20
#: Ends of patterns in which a space between two other characters always begins a match.
SPACED = " ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+"


def parse_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}


class Vocabulary:
    """Token ranks, and every pair of tokens that together are a token."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {r: t for t, r in ranks.items()}
        self.printed = {r: str(r) for r in self.tokens}
        self.base = max(ranks.values()) + 1
        self.byte = np.array([ranks.get(bytes([i]), -1) for i in range(256)], np.int64)
        if (self.byte < 0).any():
            raise ValueError("the vocabulary lacks single bytes")
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    pairs[a * self.base + b] = rank
        keys = np.fromiter(pairs.keys(), np.int64, len(pairs))
        order = np.argsort(keys)
        self.keys = np.append(keys[order], np.iinfo(np.int64).max)
        self.made = np.append(np.fromiter(pairs.values(), np.int64, len(pairs))[order], -1)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the token that each pair makes, or -1."""
        want = left * self.base + right
        at = np.searchsorted(self.keys, want)
        return np.where(self.keys[at] == want, self.made[at], -1)

    def plain(self, word: bytes) -> list[int]:
        """The textbook form for one word: merge the lowest pair, the leftmost first."""
        ranks, parts = self.ranks, [word[i : i + 1] for i in range(len(word))]
        nxt, prv, alive = [*range(1, len(parts)), -1], [*range(-1, len(parts) - 1)], [True] * len(parts)
        heap = [(r, i) for i in range(len(parts) - 1) if (r := ranks.get(parts[i] + parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            if not alive[i] or (j := nxt[i]) < 0 or ranks.get(parts[i] + parts[j]) != r:
                continue
            parts[i] += parts[j]
            alive[j], nxt[i] = False, nxt[j]
            if nxt[i] >= 0:
                prv[nxt[i]] = i
            for k in (prv[i], i):
                if k >= 0 and nxt[k] >= 0 and (q := ranks.get(parts[k] + parts[nxt[k]])) is not None:
                    heapq.heappush(heap, (q, k))
        return [ranks[p] for p, a in zip(parts, alive) if a]

    def replay(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each word."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        n = int(sizes.sum())
        if not n:
            return [[] for _ in words]
        tok = self.byte[np.frombuffer(b"".join(words), np.uint8)]
        owner = np.repeat(np.arange(len(words)), sizes)
        ends = np.cumsum(sizes)
        # Links within words; n stands for none, with a spare cell at the end.
        nxt, prv = np.arange(1, n + 2), np.arange(-1, n)
        full = sizes > 0
        nxt[ends[full] - 1] = n
        prv[(ends - sizes)[full]] = n
        nxt[n] = prv[n] = n
        tok = np.append(tok, -1)
        alive = np.ones(n + 1, bool)
        # rank now made by the pair that begins at a position
        now = np.full(n + 1, -1, np.int64)
        heads = np.flatnonzero(nxt[:n] != n)
        now[heads] = self.pair_ranks(tok[heads], tok[heads + 1])
        heads = heads[now[heads] >= 0]
        odd = np.zeros(len(words), bool)

        index: dict[int, list[np.ndarray]] = {}
        queue: list[int] = []

        def enter(positions: np.ndarray, ranks: np.ndarray) -> None:
            order = np.argsort(ranks, kind="stable")
            positions, ranks = positions[order], ranks[order]
            cuts = np.flatnonzero(np.diff(ranks)) + 1
            starts = [0, *cuts.tolist()]
            for k, rank in enumerate(ranks[starts].tolist()):
                part = positions[starts[k] : starts[k + 1] if k + 1 < len(starts) else None]
                if rank in index:
                    index[rank].append(part)
                else:
                    index[rank] = [part]
                    heapq.heappush(queue, rank)

        if len(heads):
            enter(heads, now[heads])
        while queue:
            rank = heapq.heappop(queue)
            parts = index.pop(rank)
            at = parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))
            at = at[now[at] == rank]
            if not len(at):
                continue
            if len(at) > 1 and (clash := nxt[at[:-1]] == at[1:]).any():
                # Overlapping places of one pair: from the left, every other one of a run.
                keep, last = [], -1
                for p in at.tolist():
                    if p != last:
                        keep.append(p)
                        last = int(nxt[p])
                    else:
                        last = -1
                at = np.array(keep)
            right = nxt[at]
            tok[at] = rank
            alive[right] = False
            now[right] = -1
            after = nxt[right]
            nxt[at] = after
            prv[after] = at
            prv[n] = n
            before = prv[at]
            touched = np.concatenate([at, before[before != n]])
            if len(touched) > 1:
                touched = np.unique(touched)
            follow = nxt[touched]
            made = np.where(follow != n, self.pair_ranks(tok[touched], tok[follow]), -1)
            now[touched] = made
            some = made >= 0
            if some.any():
                touched, made = touched[some], made[some]
                low = made <= rank
                if low.any():
                    odd[owner[touched[low]]] = True
                    touched, made = touched[~low], made[~low]
                if len(touched) == 1:
                    r = int(made[0])
                    if r in index:
                        index[r].append(touched)
                    else:
                        index[r] = [touched]
                        heapq.heappush(queue, r)
                elif len(touched):
                    enter(touched, made)
        left = np.flatnonzero(alive[:n])
        ids, count = tok[left].tolist(), np.bincount(owner[left], minlength=len(words))
        to = np.cumsum(count).tolist()
        out, at = [], 0
        for k, end in enumerate(to):
            out.append(self.plain(words[k]) if odd[k] else ids[at:end])
            at = end
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class Cutter:
    """Cuts texts into segments, and segments into words (the pattern's matches).

    Where the pattern allows it, texts are cut at spaces between two characters that are no white
    space, so that most of a text is found among the segments that are known."""

    def __init__(self, pattern: str):
        import regex

        self.cut = regex.compile(pattern)
        self.spaced = pattern.endswith(SPACED)
        self.between = regex.compile(r"(?<=\S) (?=\S)")
        self.white = [c for c in map(chr, range(0x3001)) if c != " " and (c.isspace() or regex.match(r"\s", c))]
        self.known: dict[str, list[str]] = {}

    def segments(self, text: str) -> list[str]:
        """All but the first stand after a space; none of an empty text."""
        if not text:
            return []
        if not self.spaced:
            return [text]
        found = text.split(" ")
        if "" in found or any(f" {c}" in text or f"{c} " in text for c in self.white if c in text):
            return self.between.split(text)
        return found

    def words(self, segment: str, first: bool) -> list[str]:
        if first:
            return self.cut.findall(segment)
        found = self.known.get(segment)
        if found is None:
            if len(self.known) > MEMORY_WORDS:
                self.known.clear()
            found = self.cut.findall(" " + segment)
            if len(segment) < 40:
                self.known[segment] = found
        return found


def packed(*arrays) -> bytes:
    """Arrays of whole numbers as one compressed blob: byte by byte, the lowest bytes of all first."""
    out = []
    for x in arrays:
        x = np.asarray(x, np.int64)
        width = max(1, -(-int(x.max(initial=0)).bit_length() // 8))
        out += [np.array([len(x), width], "<i8").tobytes(), *((x >> 8 * k & 255).astype(np.uint8).tobytes() for k in range(width))]
    return zstandard.ZstdCompressor(level=3).compress(b"".join(out))


def unpacked(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    out, at = [], 0
    while at < len(raw):
        n, width = np.frombuffer(raw, "<i8", 2, at).tolist()
        bytes_ = np.frombuffer(raw, np.uint8, n * width, at + 16).reshape(width, n)
        out.append(sum((bytes_[k].astype(np.int64) << 8 * k for k in range(1, width)), bytes_[0].astype(np.int64)))
        at += 16 + n * width
    return out


def fewer(numbers: np.ndarray) -> np.ndarray:
    """Numbers that were given in order of first occurrence: 0 for the next new one, else 1 more."""
    new = np.append(True, numbers[1:] > np.maximum.accumulate(numbers)[:-1]) if len(numbers) else np.zeros(0, bool)
    return np.where(new, 0, numbers + 1)


def given(coded: np.ndarray) -> np.ndarray:
    return np.where(coded == 0, np.cumsum(coded == 0) - 1, coded - 1)


class Chunk:
    """Documents as segments, segments as words, and words by part.

    Segments and words are numbered by first occurrence; a part has its words in that order."""

    def __init__(self, cutter: Cutter, parts: int):
        self.cutter, self.parts = cutter, parts
        self.heads: dict[str, int] = {}
        self.rest: dict[str, int] = {}
        self.segments: list[list[str]] = []
        self.sizes, self.docs = array("q"), array("q")

    def add(self, text: str) -> None:
        cut, heads, rest, segments, docs = self.cutter, self.heads, self.rest, self.segments, self.docs
        mine = cut.segments(text)
        self.sizes.append(len(mine))
        if not mine:
            return
        if mine[0] not in heads:
            heads[mine[0]] = len(segments)
            segments.append(cut.words(mine[0], True))
        docs.append(heads[mine[0]])
        for x in mine[1:]:
            k = rest.get(x)
            if k is None:
                k = rest[x] = len(segments)
                segments.append(cut.words(x, False))
            docs.append(k)

    def packed(self) -> tuple[bytes, list[tuple[int, bytes]]]:
        flat = [w for x in self.segments for w in x]
        words = list(dict.fromkeys(flat))
        number = dict(zip(words, range(len(words))))
        data = [w.encode() for w in words]
        of_part = np.fromiter(map(zlib.crc32, data), np.int64, len(data)) % self.parts
        order = np.argsort(of_part, kind="stable")
        at, sorted_parts = order.tolist(), of_part[order]
        starts = np.flatnonzero(np.diff(sorted_parts, prepend=-1)).tolist()
        blobs = []
        for a, b in zip(starts, [*starts[1:], len(at)]):
            mine = [data[i] for i in at[a:b]]
            sizes = np.fromiter(map(len, mine), "<i4", len(mine))
            blobs.append((int(sorted_parts[a]), zstandard.ZstdCompressor(level=3).compress(np.array([len(mine)], "<i4").tobytes() + sizes.tobytes() + b"".join(mine))))
        used = fewer(np.fromiter(map(number.__getitem__, flat), np.int64, len(flat)))
        return packed(self.sizes, fewer(np.array(self.docs, np.int64)), [len(x) for x in self.segments], used, of_part), blobs


def words_of(blob: bytes) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, "<i4", 1)[0])
    ends = 4 + 4 * n + np.cumsum(np.frombuffer(raw, "<i4", n, 4), dtype=np.int64)
    return [raw[a:b] for a, b in zip([4 + 4 * n, *ends[:-1].tolist()], ends.tolist())]


def gathered(values: np.ndarray, sizes: np.ndarray, picks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of runs that stand one after the other with ``sizes``, the picked ones, and their sizes."""
    sizes = sizes.astype(np.int64)
    starts, mine = np.cumsum(sizes) - sizes, sizes[picks]
    ends = np.cumsum(mine)
    if not len(ends) or not ends[-1]:
        return values[:0], mine
    return values[np.arange(ends[-1]) + np.repeat(starts[picks] - (ends - mine), mine)], mine


def sums_of(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums over runs that stand one after the other."""
    upto = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    ends = np.cumsum(sizes, dtype=np.int64)
    return upto[ends] - upto[ends - sizes]


def documents_of(sequences: bytes, blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of a chunk's documents one after the other, and how many each has. ``blobs``: of its
    parts, in order."""
    sizes, docs, of_segment, used, of_part = unpacked(sequences)
    found = [unpacked(x) for x in blobs] or [[np.zeros(0, np.int64)] * 2]
    # A word's place among the words by part.
    place = np.empty(len(of_part), np.int64)
    place[np.argsort(of_part, kind="stable")] = np.arange(len(of_part))
    ids, counts = gathered(np.concatenate([x[1] for x in found]), np.concatenate([x[0] for x in found]), place[given(used)])
    ids, counts = gathered(ids, sums_of(counts, of_segment), given(docs))
    return ids, sums_of(counts, sizes)


#: How the ids of a chunk's documents, and how many each has, become output columns.
Finish = Callable[[Vocabulary, np.ndarray, np.ndarray], list[pa.Array]]


def replayed(docs: DataFrame, rank_path: str, pattern: str, finish: Finish, fields: list[tuple[str, T.DataType]], id_col: str, text_col: str) -> DataFrame:
    """``id`` and ``fields`` of every row."""
    spark = docs.sparkSession
    common.ship(spark)
    with open(rank_path, "rb") as f:
        held = spark.sparkContext.broadcast(f.read())
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    tasks = tasks_for(docs)
    parts = max(8, min(MOST_PARTS, 2 * tasks))

    def cut(batches):
        gc.disable()  # many short lists, none in a circle
        cutter, n, task = Cutter(pattern), 0, TaskContext.get().partitionId()
        chunk, ids, size = Chunk(cutter, parts), [], 0

        def done():
            sequences, words = chunk.packed()
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, pa.schema([pa.field("id", ids[0].type)])) as out:
                for x in ids:
                    out.write_batch(pa.RecordBatch.from_arrays([x], names=["id"]))
            row = [pa.array([task], pa.int64()), pa.array([n], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary()), pa.array([sequences], pa.binary())]
            words = pa.array([[{"part": p, "words": w} for p, w in words]], pa.list_(pa.struct([("part", pa.int32()), ("words", pa.binary())])))
            return pa.RecordBatch.from_arrays([*row, words], names=["task", "chunk", "ids", "sequences", "words"])

        for whole in batches:
            for b in common.chunks(whole, "text", CHUNK):
                for t in b.column(1).to_pylist():
                    chunk.add(t or "")
                ids.append(b.column(0))
                size += b.column(1).nbytes
                if size >= CHUNK:
                    yield done()
                    chunk, ids, size, n = Chunk(cutter, parts), [], 0, n + 1
        if ids:
            yield done()

    # In buckets by task, so that chunks stay where they are when their ids come.
    chunks = bucketed(docs.mapInArrow(common.tidied(cut), "task long, chunk long, ids binary, sequences binary, words array<struct<part: int, words: binary>>"), tasks, "task")

    def replay(batches):
        gc.disable()
        vocabulary = Vocabulary(parse_ranks(held.value))
        known: dict[bytes, list[int]] = {}
        rows: list[tuple[int, int, int, list[bytes]]] = []
        now, new = None, set()

        def ready() -> Iterator[pa.RecordBatch]:
            some = list(new)
            new.clear()
            known.update(zip(some, vocabulary.replay(some)))
            out = []
            for *_, words in rows:
                found = [known[w] for w in words]
                out.append(packed([len(x) for x in found], [i for x in found for i in x]))
            if rows:
                yield pa.RecordBatch.from_arrays([*(pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int32()))), pa.array(out, pa.binary())], names=["task", "chunk", "part", "blob"])
            rows.clear()

        for b in batches:
            for part, task, chunk, blob in zip(*(b.column(i).to_pylist() for i in range(4))):
                if part != now or len(known) > MEMORY_WORDS:
                    yield from ready()
                    known.clear()
                    now = part
                words = words_of(blob)
                rows.append((task, chunk, part, words))
                new.update(w for w in words if w not in known)
                if len(new) > BLOCK_WORDS or len(rows) >= 200:
                    yield from ready()
        yield from ready()

    words = chunks.select("task", "chunk", F.explode("words").alias("w")).select(F.col("w.part").alias("part"), "task", "chunk", F.col("w.words").alias("words"))
    ids = words.repartition("part").sortWithinPartitions("part", "task", "chunk").mapInArrow(common.tidied(replay), "task long, chunk long, part int, blob binary")
    schema = T.StructType([T.StructField(id_col, docs.schema["id"].dataType), *(T.StructField(n, t) for n, t in fields)])

    def join(mine: pa.Table, coded: pa.Table) -> Iterator[pa.RecordBatch]:
        vocabulary = vocabulary_of(held.value)
        blobs: dict[int, list[tuple[int, bytes]]] = {}
        for chunk, part, blob in zip(coded["chunk"].to_pylist(), coded["part"].to_pylist(), coded["blob"].to_pylist()):
            blobs.setdefault(chunk, []).append((part, blob))
        for chunk, ids, sequences in zip(mine["chunk"].to_pylist(), mine["ids"].to_pylist(), mine["sequences"].to_pylist()):
            with pa.ipc.open_stream(ids) as stream:
                column = pa.concat_arrays([x.column(0) for x in stream])
            found = [blob for _, blob in sorted(blobs.get(chunk, []))]
            yield pa.RecordBatch.from_arrays([column, *finish(vocabulary, *documents_of(sequences, found))], names=schema.names)

    def put_together(mine: pa.Table, coded: pa.Table) -> pa.Table:
        return pa.Table.from_batches(list(common.tidied(lambda _: join(mine, coded))(None)))

    both = chunks.select("task", "chunk", "ids", "sequences").groupBy("task").cogroup(ids.groupBy("task"))
    return both.applyInArrow(put_together, schema)


_last: tuple[bytes, Vocabulary] | None = None


def vocabulary_of(ranks: bytes) -> Vocabulary:
    """A worker's vocabulary, kept from group to group."""
    global _last
    if _last is None or _last[0] is not ranks and _last[0] != ranks:
        _last = ranks, Vocabulary(parse_ranks(ranks))
    return _last[1]


def tasks_for(docs: DataFrame) -> int:
    """About one for 16 MB of the input's files, as many as shuffles have at least; nothing is run."""
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(least, min(size >> 24, 4096)) if size < 1 << 50 else least


def bucketed(df: DataFrame, buckets: int, column: str) -> DataFrame:
    """The rows, written to a table of the shared folder by buckets of a column's values."""
    name = f"hexalloc_{uuid.uuid4().hex}"
    df.write.format("parquet").option("path", common.scratch(df.sparkSession, "bpe_chunks")).bucketBy(buckets, column).saveAsTable(name)
    return df.sparkSession.table(name)


def listed(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values, pa.int32()))


def encode(docs: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, ids`` (array of int): the general operator."""

    def finish(vocabulary, ids, sizes):
        return [listed(ids, sizes)]

    return replayed(docs, rank_path, pattern, finish, [("ids", T.ArrayType(T.IntegerType()))], id_col, text_col)


def decode(encoded: DataFrame, rank_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id, decoded`` (binary): bytes of the ids of each row; null where ids are null."""
    spark = encoded.sparkSession
    common.ship(spark)
    with open(rank_path, "rb") as f:
        held = spark.sparkContext.broadcast(f.read())
    schema = T.StructType([encoded.schema[id_col], T.StructField("decoded", T.BinaryType())])

    def run(batches):
        tokens = {r: t for t, r in parse_ranks(held.value).items()}
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                got = [None if ids is None else b"".join([tokens[i] for i in ids]) for ids in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(got, pa.binary())], names=schema.names)

    return encoded.select(id_col, ids_col).mapInArrow(common.tidied(run), schema)


def digests(docs: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """``id, n_tokens, ids_sha256, decoded_sha256`` (and ``ids``): encoded, decoded and digested."""

    def finish(vocabulary, ids, sizes):
        printed, back, shown, tokens = [], [], vocabulary.printed, vocabulary.tokens
        ends = np.cumsum(sizes).tolist()
        for a, b in zip([0, *ends], ends):
            mine = ids[a:b].tolist()
            printed.append(hashlib.sha256(" ".join([shown[i] for i in mine]).encode()).hexdigest())
            back.append(hashlib.sha256(b"".join([tokens[i] for i in mine])).hexdigest())
        out = [pa.array(sizes), pa.array(printed, pa.string()), pa.array(back, pa.string())]
        return [*out, listed(ids, sizes)] if with_ids else out

    fields = [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())]
    if with_ids:
        fields.append(("ids", T.ArrayType(T.IntegerType())))
    return replayed(docs, rank_path, pattern, finish, fields, id_col, text_col)


def digest_documents(docs: DataFrame, with_ids: bool = False) -> DataFrame:
    import public_tokenizers

    return digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=with_ids)


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_documents(common.table(spark, sf_dir, "documents"))
