"""Benchmark decontamination by an FM-index over every training shard.

A shard is a chunk of documents in an executor (``common.CHUNK_BYTES`` of text).  Its
words become symbols; words that no test item has become breaks, each of its own kind, and
runs of them one break, which no test phrase can cross.  Over this text stand a suffix
array, its Burrows-Wheeler transform in a wavelet matrix, and suffix positions sampled
every ``SAMPLE`` symbols and after each break.

All windows of all items (13 words; a shorter item is one window) are searched together,
backwards: each step narrows the row intervals of the windows that still have rows by two
ranks in the wavelet matrix.  Rows of the windows found are walked back to a sampled
position, and the word spans merged; they are what a removal would cut.

The benchmark is a set of queries held against all rows: it is read in blocks of at most
``BLOCK_WORDS`` words, one after the other, each broadcast and searched by a scan of its own.

Item ids are of any type and are listed as strings.  Edge cases: null texts and items have no
words; an item without id marks words but is not listed; rows of the benchmark with one id are
one item; repeated documents give repeated results; an empty benchmark marks nothing; an empty
table gives none; other columns, whatever their names, come through unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

WINDOW, SAMPLE = 13, 8
BLOCK_WORDS = 2_000_000
BREAK = 0

#: Lower-cases A-Z and turns all ASCII but digits and letters into spaces.
TABLE = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(TABLE).split()


@dataclass
class Queries:
    vocabulary: dict[bytes, int]  # symbols from 1
    windows: np.ndarray  # windows x WINDOW, aligned right, BREAK before shorter ones
    lengths: np.ndarray
    owners: list[str]  # item ids by window, and where a window's begin
    offsets: np.ndarray


def build_queries(items: list[tuple[str | None, str | None]], size: int = WINDOW) -> Queries:
    vocabulary: dict[bytes, int] = {}
    windows: dict[tuple, set] = {}
    for item, text in items:
        ids = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in words_of((text or "").encode())]
        for at in range(max(1, len(ids) - size + 1) if ids else 0):
            windows.setdefault(tuple(ids[at : at + size]), set()).add(item)
    keys = sorted(windows)
    table = np.zeros((len(keys), size), np.int64)
    for i, k in enumerate(keys):
        table[i, size - len(k) :] = k
    owners = [sorted(x for x in windows[k] if x is not None) for k in keys]
    return Queries(
        vocabulary,
        table,
        np.fromiter(map(len, keys), np.int64, len(keys)),
        [x for o in owners for x in o],
        np.concatenate([[0], np.cumsum([len(o) for o in owners])]).astype(np.int64),
    )


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of suffixes. Breaks are the least symbols, each of its own kind in order of place,
    so no comparison passes one."""
    n = len(text)
    breaks = text == BREAK
    first = np.where(breaks, np.cumsum(breaks) - 1, text + int(breaks.sum()))
    # Two symbols at once, then ranks of twice as many until all differ. A rank is where the
    # suffix's group begins in the array, so groups of one are in place for good.
    wide = int(first.max()) + 2
    key = first * wide + np.append(first[1:] + 1, 0)
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    new = np.append(True, sorted_key[1:] != sorted_key[:-1])
    starts = np.flatnonzero(new)
    rank = np.empty(n + 1, np.int64)
    rank[order] = np.repeat(starts, np.diff(np.append(starts, n)))
    rank[n] = -1
    array = order
    sizes = np.diff(np.append(starts, n))
    open_rows = np.flatnonzero(np.repeat(sizes > 1, sizes))
    h = 2
    while len(open_rows):
        todo = array[open_rows]
        base = rank[todo]
        key = base * (n + 1) + rank[np.minimum(todo + h, n)] + 1
        o = np.argsort(key, kind="stable")
        todo, base, key = todo[o], base[o], key[o]
        array[open_rows] = todo
        new = np.append(True, key[1:] != key[:-1])
        head = np.append(True, base[1:] != base[:-1])
        place = np.arange(len(todo))
        fresh = base + np.maximum.accumulate(np.where(new, place, 0)) - np.maximum.accumulate(np.where(head, place, 0))
        rank[todo] = fresh
        runs = np.diff(np.append(np.flatnonzero(new), len(todo)))
        open_rows = open_rows[np.repeat(runs > 1, runs)]
        h *= 2
    return array


class WaveletMatrix:
    """Ranks of symbols in a sequence."""

    def __init__(self, sequence: np.ndarray, symbols: int):
        self.levels = max(1, int(symbols).bit_length())
        self.ones, self.zeros = [], []
        current = sequence
        for level in range(self.levels - 1, -1, -1):
            bit = (current >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]).astype(np.int32))
            self.zeros.append(len(current) - int(self.ones[-1][-1]))
            current = np.concatenate([current[bit == 0], current[bit == 1]])

    def rank(self, symbol: np.ndarray, to: np.ndarray) -> np.ndarray:
        """How many of each symbol stand before each place."""
        low, at = np.zeros_like(to), to.copy()
        for k, level in enumerate(range(self.levels - 1, -1, -1)):
            ones, zeros = self.ones[k], self.zeros[k]
            right = (symbol >> level) & 1 == 1
            a, b = ones[low], ones[at]
            low = np.where(right, zeros + a, low - a)
            at = np.where(right, zeros + b, at - b)
        return at - low


class FMIndex:
    def __init__(self, text: np.ndarray, symbols: int, sample: int = SAMPLE):
        # A break ends the text, so that no row is missing whose walk goes through a word.
        if not len(text) or text[-1] != BREAK:
            text = np.append(text, BREAK)
        n = len(text)
        array = suffix_array(text)
        before = np.where(array > 0, text[array - 1], BREAK)
        self.last = before
        self.matrix = WaveletMatrix(before, symbols)
        self.less = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols + 1))]).astype(np.int64)
        known = (array % sample == 0) | (before == BREAK)
        self.known, self.place = known, np.cumsum(known) - 1
        self.positions = array[known]
        self.n = n

    def search(self, windows: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row interval of each window."""
        low, high = np.zeros(len(windows), np.int64), np.full(len(windows), self.n, np.int64)
        size = windows.shape[1]
        alive = np.arange(len(windows))
        for step in range(size):
            alive = alive[(lengths[alive] > step) & (low[alive] < high[alive])]
            if not len(alive):
                break
            c = windows[alive, size - 1 - step]
            both = self.matrix.rank(np.concatenate([c, c]), np.concatenate([low[alive], high[alive]]))
            low[alive], high[alive] = self.less[c] + both[: len(alive)], self.less[c] + both[len(alive) :]
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places in the text where the suffixes of rows begin."""
        rows = rows.copy()
        out = np.full(len(rows), -1, np.int64)
        todo, steps = np.arange(len(rows)), 0
        while len(todo):
            done = self.known[rows[todo]]
            out[todo[done]] = self.positions[self.place[rows[todo[done]]]] + steps
            todo = todo[~done]
            if len(todo):
                c = self.last[rows[todo]]
                rows[todo] = self.less[c] + self.matrix.rank(c, rows[todo])
                steps += 1
        return out


def search_shard(texts: list[bytes], queries: Queries) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of each text, all windows' places as (first word in the shard, length), and the
    text and window of each."""
    get = queries.vocabulary.get
    parts, sizes = [], np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        w = words_of(t)
        sizes[i] = len(w)
        parts.append(np.fromiter((get(x, BREAK) for x in w), np.int64, len(w)))
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    none = np.zeros(0, np.int64)
    if not len(queries.windows) or not bounds[-1]:
        return sizes, none, none, none, none
    # A break before each text, then one for every run of breaks.
    symbols = np.insert(np.concatenate(parts), bounds[:-1], BREAK)
    word = np.arange(len(symbols)) - np.repeat(np.arange(1, len(texts) + 1), sizes + 1)
    keep = np.append(True, (symbols[1:] != BREAK) | (symbols[:-1] != BREAK))
    symbols, word = symbols[keep], word[keep]
    index = FMIndex(symbols, len(queries.vocabulary))
    low, high = index.search(queries.windows, queries.lengths)
    found = np.flatnonzero(high > low)
    if not len(found):
        return sizes, none, none, none, none
    count = high[found] - low[found]
    window = np.repeat(found, count)
    rows = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low[found], count)
    first = word[index.locate(rows)]
    return sizes, first, queries.lengths[window], np.searchsorted(bounds, first, side="right") - 1, window


def blocks(benchmark: DataFrame, id_col: str, text_col: str, limit: int = BLOCK_WORDS) -> Iterator[list]:
    """The benchmark in blocks of at most ``limit`` words (about six bytes each), as they are used:
    the driver holds one block and one partition of the benchmark."""
    rows, size = [], 0
    for r in benchmark.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t")).toLocalIterator():
        n = len(r.t or "") // 6 + 1
        if rows and size + n > limit:
            yield rows
            rows, size = [], 0
        rows.append((r.i, r.t))
        size += n
    if rows:
        yield rows


SPAN = T.StructType([T.StructField("first", T.LongType()), T.StructField("last", T.LongType())])
MARKS = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(SPAN)), T.StructField("items", T.ArrayType(T.StringType()))])


def mark(docs: DataFrame, benchmark: DataFrame, into: str = "marks", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = WINDOW) -> DataFrame:
    """All columns of ``docs`` and a struct ``into``: the number of words, removal spans (first and
    last word, merged, in order) and the ids, as strings, of items with a window in the text.

    ``into`` must not be a column of ``docs``.  Blocks beyond the first read what the block before
    has written, so one block is broadcast at a time."""
    spark = docs.sparkSession
    common.ship(spark)
    if common.fresh(docs, into) != into:
        raise ValueError(f"{into} is a column of the documents")
    out = docs.withColumn(into, F.lit(None).cast(MARKS))
    schema = T.StructType(out.schema.fields)
    found = blocks(benchmark, item_id, item_text)
    rows, before, held = next(found, []), None, None
    while rows is not None:
        held = spark.sparkContext.broadcast(build_queries(rows, size))

        def run(batches, held=held):
            for whole in batches:
                for b in common.chunks(whole, text_col):
                    yield search_batch(b, text_col, into, held.value)

        out = out.mapInArrow(common.tidied(run), schema)
        rows = next(found, None)
        if rows is not None:
            work = common.Workspace(spark, "marked")
            out = work.write(out, "block")
            held.destroy()
            if before:
                before.clear()
            before = work
    return out


def search_batch(b: pa.RecordBatch, text_col: str, into: str, queries: Queries) -> pa.RecordBatch:
    raw, off = common.flat(b.column(b.schema.get_field_index(text_col)))
    raw, off = raw.tobytes(), off.tolist()
    sizes, first, length, text, window = search_shard([raw[x:y] for x, y in zip(off, off[1:])], queries)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    at = b.schema.get_field_index(into)
    old = b.column(at).to_pylist()
    touched = {i for i, m in enumerate(old) if m and m["spans"]} | set(text.tolist())
    spans, items = [[] for _ in sizes], [[] for _ in sizes]
    order = np.argsort(text, kind="stable")
    cuts = np.searchsorted(text[order], np.arange(len(sizes) + 1))
    for i in touched:
        mine = order[cuts[i] : cuts[i + 1]]
        cover = np.zeros(sizes[i] + 1, np.int64)
        np.add.at(cover, first[mine] - bounds[i], 1)
        np.add.at(cover, first[mine] - bounds[i] + length[mine], -1)
        for s in old[i]["spans"] if old[i] else ():
            cover[s["first"]] += 1
            cover[s["last"] + 1] -= 1
        hit = np.append(0, (np.cumsum(cover)[:-1] > 0).astype(np.int8))
        edge = np.diff(np.append(hit, 0))
        spans[i] = [{"first": int(a), "last": int(z) - 1} for a, z in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1))]
        ids = {queries.owners[x] for k in np.unique(window[mine]) for x in range(queries.offsets[k], queries.offsets[k + 1])}
        items[i] = sorted(ids | set(old[i]["items"] if old[i] else ()))
    marks = pa.StructArray.from_arrays([pa.array(sizes), pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))), pa.array(items, pa.list_(pa.string()))], ["n_words", "spans", "items"])
    return pa.RecordBatch.from_arrays([marks if i == at else b.column(i) for i in range(b.num_columns)], names=b.schema.names)


def hit_words(marks: str):
    return F.aggregate(f"{marks}.spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"] + 1)


def contaminated(marks: str):
    """A twentieth or more of a text's words stand in windows."""
    hit = hit_words(marks)
    return (hit > 0) & (20 * hit >= F.col(f"{marks}.n_words"))


def verdicts(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``id, n_words, n_hit, n_items, items_sha256, contaminated`` of every row."""
    m = common.fresh(docs.select(id_col, text_col), "marks")
    marked = mark(docs.select(id_col, text_col), benchmark, m, text_col, **options)
    names = F.array_join(F.array_sort(f"{m}.items"), ",")
    return marked.select(id_col, F.col(f"{m}.n_words").alias("n_words"), hit_words(m).alias("n_hit"), F.size(f"{m}.items").cast("long").alias("n_items"), F.sha2(names.cast("binary"), 256).alias("items_sha256"), contaminated(m).alias("contaminated"))


def keep_clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows, with all their columns, that are not contaminated."""
    m = common.fresh(docs, "marks")
    return mark(docs, benchmark, m, text_col, **options).where(~contaminated(m)).drop(m)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
