"""Language identification by unigrams marginalised over segmentations.

The vocabulary is that of a public tokenizer and is fixed; what is learned is, for each
language, how probable each piece is.  A word (a run of letters with the space before
it) has the probability of all its segmentations into pieces together, summed by the
forward algorithm; a text has the product over its words.  Learning is one step of
expectation-maximisation over all training rows: forward and backward sums under equal
piece probabilities give every piece's expected count in every language, and a pooled
estimate smooths them.

Words are scored once a chunk, all words of a chunk together: the forward sums of all
words advance by one character at a time as arrays.  After every ``STRIDE`` characters (or
as many as the longest piece has) the sums of a longer word are divided by their largest, and
the divisors' logarithms are added up, so that a run of any length is summed whole.  Pieces
never cross a space in the vocabulary, so cutting at spaces loses no segmentation.

Any number of languages is learned.  A model holds them in blocks of ``BLOCK_LANGUAGES``; a
text is held against one block after the other, and all but the first read what the block
before has written.

Edge cases: a text that is null or has no letter is ``und`` with score 0; rows without a
language are not learned from; with nothing to learn from, every text is ``und``; repeated
rows give repeated results; an empty table gives none; other columns, whatever their names,
are never read or come through unchanged.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

STRIDE = 16
#: Weight of the pooled estimate, in expected pieces, and the share of unknown characters.
SMOOTHING, UNKNOWN = 2000.0, 1e-7
#: Forward sums are scaled by this for each character, against underflow.
SCALE = 32.0
#: Languages that are scored at a time.
BLOCK_LANGUAGES = 300
UND = "und"

#: Bytes of letters: ASCII letters, and all beyond ASCII (marks there are just rare characters).
TABLE = bytes(c if 0x41 <= c <= 0x5A or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))
ODD = np.uint64(0x9E3779B97F4A7C15)
CHUNK = 4 << 20
#: Words that a worker remembers between chunks, and words scored at a time.
MEMORY_WORDS, BLOCK = 400_000, 15_000
#: Characters scored at a time (a longer word is scored alone), and numbers remembered.
BLOCK_CHARS, MEMORY_VALUES = 200_000, 4_000_000
#: Slots of the table of pieces, as a power of two; more than twice the pieces.
BITS = 18


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def salt(size: int) -> np.uint64:
    return np.uint64(size * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF)


def codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words, each after a word mark, and the offsets."""
    joined = "▁".join(["", *words])
    flat = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    return flat, np.concatenate([[0], np.cumsum(sizes)])


class Pieces:
    """A fixed set of pieces, found by hashes of code points."""

    def __init__(self, pieces: list[str]):
        self.pieces = [p for p in dict.fromkeys(pieces) if p]
        self.longest = max(map(len, self.pieces), default=1)
        self.stride = max(STRIDE, self.longest)
        if len(self.pieces) > 1 << BITS - 1:
            raise ValueError(f"{len(self.pieces)} pieces; at most {1 << BITS - 1}")
        hashes = np.empty(len(self.pieces), np.uint64)
        for n in sorted({len(p) for p in self.pieces}):
            at = [i for i, p in enumerate(self.pieces) if len(p) == n]
            if at:
                c = np.frombuffer("".join(self.pieces[i] for i in at).encode("utf-32-le"), np.uint32).astype(np.uint64).reshape(-1, n)
                h = np.zeros(len(at), np.uint64)
                for k in range(n):
                    h = h * ODD + c[:, k] + np.uint64(1)
                hashes[at] = mix(h + salt(n))
        # A table of 2^BITS slots; a piece stands in the first free one from its hash's low bits on.
        self.hashes, self.ids = np.zeros(1 << BITS, np.uint64), np.full(1 << BITS, -1, np.int32)
        for i, h in enumerate(hashes.tolist()):
            slot = h & ((1 << BITS) - 1)
            while self.ids[slot] >= 0:
                slot = (slot + 1) & ((1 << BITS) - 1)
            self.hashes[slot], self.ids[slot] = h, i

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the hashes are pieces', and the pieces."""
        slots = (hashes & np.uint64((1 << BITS) - 1)).astype(np.int64)
        todo = np.flatnonzero(self.ids[slots] >= 0)
        places, found = [], []
        slots = slots[todo]
        while len(todo):
            hit = self.hashes[slots] == hashes[todo]
            places.append(todo[hit])
            found.append(self.ids[slots[hit]])
            todo, slots = todo[~hit], (slots[~hit] + 1) & ((1 << BITS) - 1)
            there = self.ids[slots] >= 0
            todo, slots = todo[there], slots[there]
        if not places:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(places), np.concatenate(found).astype(np.int64)

    def edges(self, flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All places of pieces in words: start, length and piece; a character that is no
        piece by itself gets an edge with piece -1."""
        n = len(flat)
        ends = np.repeat(offsets[1:], np.diff(offsets))
        left = ends - np.arange(n)
        starts, sizes, found = [], [], []
        h = np.zeros(n, np.uint64)
        alive = np.arange(n)
        for size in range(1, self.longest + 1):
            alive = alive[left[alive] >= size]
            if not len(alive):
                break
            h[alive] = h[alive] * ODD + flat[alive + size - 1] + np.uint64(1)
            m = mix(h[alive] + salt(size))
            at, pieces = self.find(m)
            starts.append(alive[at])
            found.append(pieces)
            sizes.append(np.full(len(at), size))
            if size == 1:
                lone = np.ones(n, bool)
                lone[starts[0]] = False
                lone = np.flatnonzero(lone)
                starts.append(lone)
                found.append(np.full(len(lone), -1))
                sizes.append(np.ones(len(lone), np.int64))
        return np.concatenate(starts), np.concatenate(sizes), np.concatenate(found)


@dataclass
class Lattice:
    """Pieces of words as edges between nodes; a word of k characters (with its mark) has the nodes
    ``first`` to ``first + k``."""

    source: np.ndarray
    target: np.ndarray
    piece: np.ndarray
    size: np.ndarray
    word: np.ndarray
    begins: np.ndarray  # place of an edge's source in its word
    first: np.ndarray
    lengths: np.ndarray

    @property
    def last(self) -> np.ndarray:
        return self.first + self.lengths

    @property
    def nodes(self) -> int:
        return int(self.last[-1]) + 1


def lattice(pieces: Pieces, words: list[str]) -> Lattice:
    flat, offsets = codes(words)
    start, size, piece = pieces.edges(flat, offsets)
    lengths = np.diff(offsets)
    word = np.repeat(np.arange(len(words)), lengths)[start]
    node = start + word  # one more node for every word before
    return Lattice(node, node + size, piece, size, word, start - offsets[word], offsets[:-1] + np.arange(len(words)), lengths)


def sums(of: Lattice, weight: np.ndarray, columns: int, stride: int, backward: bool = False, by_node: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Sums over all paths to each node (from each, ``backward``), and the logarithm by which each
    word's last node (each node, ``by_node``) was divided."""
    # A place is counted from the end that the sums begin at.
    base, way = (of.last, -1) if backward else (of.first, 1)
    source, target = (of.target, of.source) if backward else (of.source, of.target)
    step = of.lengths[of.word] - of.begins if backward else of.begins + of.size
    values, logs = np.zeros((of.nodes, columns)), np.zeros((len(base), columns))
    of_node = np.zeros(of.nodes) if by_node else None
    values[base] = 1.0
    order = np.argsort(step * (of.nodes + 1) + target, kind="stable")
    source, target, step, weight = source[order], target[order], step[order], weight[order]
    cuts = np.flatnonzero(np.diff(step)) + 1
    bounds = [0, *cuts.tolist(), len(step)]
    for a, b in zip(bounds, bounds[1:]):
        if a == b:
            continue
        d = target[a:b]
        head = np.concatenate([[0], np.flatnonzero(np.diff(d)) + 1])
        values[d[head]] = np.add.reduceat(values[source[a:b]] * weight[a:b], head, axis=0)
        t = int(step[a])
        if t % stride == 0 and len(long := np.flatnonzero(of.lengths > t)):
            window = base[long, None] + way * np.arange(t - stride + 1, t + 1)
            top = np.maximum(values[window].max(1), 1e-300)
            values[window] /= top[:, None]
            logs[long] += np.log(top)
            if by_node:
                of_node[window] = logs[long, :1]
    if not by_node:
        return values, logs
    # Nodes after a word's last division have all of its divisors.
    word = np.repeat(np.arange(len(base)), of.lengths + 1)
    place = (np.arange(of.nodes) - base[word]) * way
    after = place > (of.lengths[word] - 1) // stride * stride
    return values, np.where(after, logs[word, 0], of_node)


def expected(pieces: Pieces, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected pieces of each word under equal probabilities: word, piece, amount."""
    of = lattice(pieces, words)
    p = np.where(of.piece >= 0, 1.0 / max(len(pieces.pieces), 1), UNKNOWN * 1e-3) * SCALE**of.size
    forward, by = sums(of, p[:, None], 1, pieces.stride, by_node=True)
    backward, back_by = sums(of, p[:, None], 1, pieces.stride, backward=True, by_node=True)
    scale = np.exp(by[of.source] + back_by[of.target] - by[of.last][of.word])
    amount = forward[of.source, 0] * p * backward[of.target, 0] / np.maximum(forward[of.last, 0][of.word], 1e-300) * scale
    real = of.piece >= 0
    return of.word[real], of.piece[real], amount[real]


def log_likelihoods(pieces: Pieces, probabilities: np.ndarray, words: list[str]) -> np.ndarray:
    """Words by languages: log of the sum over segmentations. probabilities: languages by pieces,
    with one column more, last, for unknown characters."""
    of = lattice(pieces, words)
    w = probabilities.T[of.piece] * (SCALE ** of.size.astype(float))[:, None]
    values, logs = sums(of, w, probabilities.shape[0], pieces.stride)
    return np.log(np.maximum(values[of.last], 1e-300)) + logs - (of.lengths * np.log(SCALE))[:, None]


def groups(words: list[str]) -> Iterator[slice]:
    """Slices of words that are scored together."""
    at, size = 0, 0
    for k, w in enumerate(words):
        if k > at and (k - at >= BLOCK or size + len(w) > BLOCK_CHARS):
            yield slice(at, k)
            at, size = k, 0
        size += len(w) + 1
    if len(words) > at:
        yield slice(at, len(words))


def letter_runs(text: bytes) -> list[bytes]:
    return text.translate(TABLE).split()


def spelled(word: bytes) -> str:
    return word.decode("utf-8", "replace")


@dataclass
class Model:
    languages: list[str]
    pieces: list[str]
    probabilities: np.ndarray  # languages x (pieces and unknown)


class Models:
    """Piece probabilities of all languages, by blocks: each is made from the table of counts when
    it is asked for."""

    def __init__(self, counts: DataFrame, names: DataFrame, vocabulary: list[str], block: int, work: common.Workspace):
        self.counts, self.names, self.block = counts, names, block
        self.pieces = Pieces(vocabulary).pieces
        totals = counts.groupBy("lang").agg(F.sum("amount").alias("total"))
        self.languages = names.count()
        # Languages weigh the same in the pooled estimate, however much text each has.
        pooled = np.zeros(len(self.pieces))
        got = counts.join(totals, "lang").where("total > 0").groupBy("piece").agg(F.sum(F.col("amount") / F.col("total")).alias("share")).toPandas()
        pooled[got["piece"].to_numpy(np.int64)] = np.round(got["share"].to_numpy(float), 12) / max(self.languages, 1)
        self.pooled = pooled * 0.9 + 0.1 / max(len(self.pieces), 1)
        self.only = None
        if self.languages <= block:
            # One block is kept, and its tables go.
            self.only = list(self.made())
            work.clear()

    def blocks(self) -> Iterator[Model]:
        return iter(self.only) if self.only else self.made()

    def made(self) -> Iterator[Model]:
        """At least one; a block comes to the driver as no more rows than languages x pieces."""
        for at in range(0, max(self.languages, 1), self.block):
            mine = self.names.where((F.col("number") >= at) & (F.col("number") < at + self.block))
            names = {r.lang: r.number - at for r in mine.collect()}
            got = self.counts.join(F.broadcast(mine), "lang").select((F.col("number") - at).alias("number"), "piece", "amount").toPandas()
            counts = np.zeros((len(names), len(self.pieces)))
            counts[got["number"].to_numpy(np.int64), got["piece"].to_numpy(np.int64)] = got["amount"].to_numpy(float) / 1e6
            p = (counts + SMOOTHING * self.pooled) / (counts.sum(1, keepdims=True) + SMOOTHING)
            yield Model(sorted(names, key=names.get), self.pieces, np.hstack([p * (1 - UNKNOWN), np.full((len(names), 1), UNKNOWN)]))


def public_pieces(model_path: str) -> list[str]:
    """Pieces of a sentencepiece model, without bytes, control marks and runs of word marks."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
    ids = (i for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i)))
    return [p for p in map(sp.id_to_piece, ids) if "▁" not in p[1:]]


def fit(docs: DataFrame, vocabulary: list[str], lang_col: str = "lang", text_col: str = "text", block: int = BLOCK_LANGUAGES) -> Models:
    """Piece probabilities of each language, from all rows that name theirs."""
    spark = docs.sparkSession
    common.ship(spark)
    held = spark.sparkContext.broadcast(vocabulary)
    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("piece", T.LongType()), T.StructField("amount", T.DoubleType())])

    def run(batches):
        pieces = Pieces(held.value)
        total: dict[str, np.ndarray] = {}
        words: dict[str, Counter] = {}

        def settle():
            for lang, count in words.items():
                s = total.setdefault(lang, np.zeros(len(pieces.pieces)))
                # Words of like length together, so that few steps are for the longest alone.
                pairs = sorted(((spelled(w), n) for w, n in count.items()), key=lambda x: (len(x[0]), x[0]))
                for some in groups([w for w, _ in pairs]):
                    word, piece, amount = expected(pieces, [w for w, _ in pairs[some]])
                    s += np.bincount(piece, amount * np.array([n for _, n in pairs[some]], float)[word], len(s))
            words.clear()

        def given():
            for lang, s in total.items():
                some = np.flatnonzero(s)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some, pa.int64()), pa.array(np.round(s[some], 6))], names=schema.names)
            total.clear()

        for whole in batches:
            for b in common.chunks(whole, text_col, CHUNK):
                raw, off = common.flat(b.column(1))
                raw, off = raw.tobytes(), off.tolist()
                for lang, a, z in zip(b.column(0).to_pylist(), off, off[1:]):
                    words.setdefault(lang, Counter()).update(letter_runs(raw[a:z]))
                if sum(map(len, words.values())) > MEMORY_WORDS:
                    settle()
                # A task holds the sums of so many languages at once.
                if len(total) + len(words) > 2 * BLOCK_LANGUAGES:
                    settle()
                    yield from given()
        settle()
        yield from given()

    known = docs.where(F.col(lang_col).isNotNull()).select(lang_col, text_col)
    # Rounded to whole units of 1e-6, so that sums don't depend on the order of tasks.
    work = common.Workspace(spark, "languages")
    counts = work.write(known.mapInArrow(common.tidied(run), schema).groupBy("lang", "piece").agg(F.sum(F.round(F.col("amount") * 1e6).cast("long")).alias("amount")), "piece_counts")
    # Numbers of languages by name: of as many rows as there are languages.
    names = counts.groupBy("lang").agg(F.lit(0).alias("all")).withColumn("number", F.row_number().over(Window.partitionBy("all").orderBy("lang")) - 1).select("lang", "number")
    return Models(counts, work.write(names, "names"), vocabulary, block, work)


class Scorer:
    """For chunks of texts: the likeliest language of one model, its log-likelihood, and the log of
    the sum over all of its languages; nothing for a text without a letter."""

    def __init__(self, model: Model):
        self.model, self.pieces = model, Pieces(model.pieces)
        self.known: dict[bytes, int] = {}
        self.values = np.zeros((0, len(model.languages)))

    def score(self, texts: pa.Array) -> tuple[list[str | None], np.ndarray, np.ndarray]:
        raw, off = common.flat(texts)
        raw, off = raw.tobytes(), off.tolist()
        n, languages = len(off) - 1, self.model.languages
        found = []
        for a, b in zip(off, off[1:]):
            text = raw[a:b]
            found.append(letter_runs(text) if text.isascii() or any(map(str.isalpha, text.decode())) else [])
        labels, tops, totals = [None] * n, np.zeros(n), np.zeros(n)
        if not languages:
            return labels, tops, totals
        if len(self.known) > MEMORY_WORDS or self.values.size > MEMORY_VALUES:
            self.known, self.values = {}, self.values[:0]
        self.learn(sorted(set().union(*found) - self.known.keys()))
        for i, words in enumerate(found):
            if words:
                total = self.values[list(map(self.known.__getitem__, words))].sum(0)
                best = int(np.argmax(total))
                labels[i], tops[i] = languages[best], total[best]
                totals[i] = total[best] + np.log(np.exp(total - total[best]).sum())
        return labels, tops, totals

    def learn(self, new: list[bytes]) -> None:
        """Score words and remember them."""
        if not new:
            return
        new = sorted(new, key=len)
        flat = list(map(spelled, new))
        values = np.concatenate([log_likelihoods(self.pieces, self.model.probabilities, flat[some]) for some in groups(flat)])
        first = len(self.known)
        self.known.update(zip(new, range(first, first + len(new))))
        self.values = np.concatenate([self.values, values])


FOUND = T.StructType([T.StructField("lang", T.StringType()), T.StructField("top", T.DoubleType()), T.StructField("total", T.DoubleType())])


def scored(docs: DataFrame, models: Models, into: str, text_col: str) -> DataFrame:
    """All columns of ``docs`` and a struct ``into``: the likeliest language (null without a letter),
    its log-likelihood and the log of the sum over all languages."""
    spark = docs.sparkSession
    common.ship(spark)
    out = docs.withColumn(into, F.lit(None).cast(FOUND))
    schema = T.StructType(out.schema.fields)
    blocks, before, held = models.blocks(), None, None
    model = next(blocks)
    while model is not None:
        held = spark.sparkContext.broadcast(model)

        def run(batches, held=held):
            who = Scorer(held.value)
            for whole in batches:
                at = whole.schema.get_field_index(into)
                for b in common.chunks(whole, text_col, CHUNK):
                    labels, tops, totals = who.score(b.column(b.schema.get_field_index(text_col)))
                    for i, old in enumerate(b.column(at).to_pylist()):
                        if old and old["lang"] is not None and labels[i] is not None:
                            totals[i] = np.logaddexp(totals[i], old["total"])
                            # Blocks are in the order of names, so the first of equals stays.
                            if old["top"] >= tops[i]:
                                labels[i], tops[i] = old["lang"], old["top"]
                    new = pa.StructArray.from_arrays([pa.array(labels, pa.string()), pa.array(tops), pa.array(totals)], FOUND.names)
                    yield pa.RecordBatch.from_arrays([new if i == at else b.column(i) for i in range(b.num_columns)], names=b.schema.names)

        out = out.mapInArrow(common.tidied(run), schema)
        model = next(blocks, None)
        if model is not None:
            work = common.Workspace(spark, "scored")
            out = work.write(out, "block")
            held.destroy()
            if before:
                before.clear()
            before = work
    return out


def chance(into: str):
    return F.when(F.col(f"{into}.lang").isNotNull(), F.least(F.exp(F.col(f"{into}.top") - F.col(f"{into}.total")), F.lit(1.0))).otherwise(0.0)


def identify(docs: DataFrame, models: Models, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, lang_pred, score`` of every row."""
    docs = docs.select(id_col, text_col)
    m = common.fresh(docs, "found")
    return scored(docs, models, m, text_col).select(id_col, F.coalesce(F.col(f"{m}.lang"), F.lit(UND)).alias("lang_pred"), chance(m).alias("score"))


def keep_identified(docs: DataFrame, models: Models, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows, with all their columns, whose language is known with at least ``least``."""
    m = common.fresh(docs, "found")
    return scored(docs, models, m, text_col).where(F.col(f"{m}.lang").isNotNull() & (chance(m) >= least)).drop(m)


def remainder(id_col: str, n: int):
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(n))


def fit_documents(docs: DataFrame) -> Models:
    import public_tokenizers

    train = docs.where(F.coalesce(remainder("doc_id", 4) != 2, F.lit(False)))
    return fit(train, public_pieces(public_tokenizers.path("piece_bpe_32k.model")))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    got = identify(docs, fit_documents(docs))
    return got.select("doc_id", F.coalesce(remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
