"""Quality rules: plain counts, and divergence from language references.

A reference is, for each language of the corpus, how its characters fall into classes
and how its words fall on its common words (each at least ``SHARE`` of its words) and the
rest.  A document is held against every reference by Jensen-Shannon distance (base 2, 0 to
1), for characters and for words, and the nearest language counts.  Guards: the character
test needs ``MIN_CHARS`` characters and the word test ``MIN_WORDS`` words; a shorter text is
not judged by it.

How far is too far comes from the corpus.  Distances of texts that pass the base rule are
looked at by length (powers of two of words), near copies once: texts with the same least
hash of two words side by side.  The limit stands ``SPREADS`` times as far above the median
as the 5 % quantile stands below it (``LEAST_SPREAD`` at least): the near half of the texts
tells how much good texts differ, whatever the far half holds.  These parameters are the
operator's own, set on labelled rows of sf0.1, and are the same for every corpus.  A length with fewer than
``LEAST_TEXTS`` texts takes the limit of the next shorter one that has more; without any,
the base rule alone decides.

References cover all documents.  Common words are found exactly in two passes.  Tasks
read their rows in parts; a word with a share in the corpus has that share in at least one
part, or in all small parts together.  So tasks first name the common words of their parts
(and the counts of parts too small to tell), and then count what was named.

Edge cases: a null text has no words and fails the base rule; rows without a language
take part in no reference but are judged; with no reference at all (no language is
known, or an empty table) the base rule alone decides; repeated rows give repeated
results; other columns, whatever their names, are never read or come through unchanged.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .sketches import mix

#: A common word has at least this share of its language's words.
SHARE = 0.002
MIN_CHARS, MIN_WORDS = 200, 50
#: Distances from the median, in units of its distance to the 5 % quantile, beyond which a text is too
#: far; the least unit for characters (a few numbers or marks move a short text far) and for words.
SPREADS, LEAST_SPREAD, LEAST_TEXTS = 5.0, (0.04, 0.01), 100
#: Distances are looked at in steps of this.
STEP = 0.001
#: Distinct words, of all languages together, at which a task ends its largest part; words below
#: which a part is small; counts that a task holds.
PART_WORDS, SMALL_PART, HELD = 200_000, 20_000, 500_000
#: Cells of the table of words by texts that is held at once.
CELLS = 1_000_000

SPACE = bytes([0x20, 9, 10, 11, 12, 13])
#: Classes of bytes: continuation bytes (0) belong to the character that they end.
CLASSES = ("", "lower", "upper", "digit", "space", "stop", "bracket", "symbol", "control", "two", "three", "four")


def _classes() -> np.ndarray:
    k = {n: i for i, n in enumerate(CLASSES)}
    out = np.full(256, k["symbol"], np.uint8)
    out[: 0x20] = k["control"]
    out[0x7F] = k["control"]
    out[list(SPACE)] = k["space"]
    out[0x30:0x3A], out[0x41:0x5B], out[0x61:0x7B] = k["digit"], k["upper"], k["lower"]
    out[[ord(c) for c in ".,;:!?'\"-"]] = k["stop"]
    out[[ord(c) for c in "()[]{}/"]] = k["bracket"]
    out[0x80:0xC0], out[0xC0:0xE0], out[0xE0:0xF0], out[0xF0:] = 0, k["two"], k["three"], k["four"]
    return out


CLASS = _classes()
SYMBOL = np.isin(np.arange(256), [ord(c) for c in "#*$%&|<>"])
INSIDE = ~np.isin(np.arange(256), [*SPACE, *range(0x80, 0xC0)])
STRIP = b".,;:!?'\"()[]{}-"


def repeated(ids: np.ndarray, window: int = 3) -> int:
    """Words in windows that stand twice or more."""
    n = len(ids) - window + 1
    if n < 2:
        return 0
    key = ids[:n]
    for k in range(1, window):
        top = int(ids.max()) + 1
        if int(key.max()) >= (1 << 62) // top:
            key = np.unique(key, return_inverse=True)[1]
        key = key * top + ids[k : n + k]
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(ids), bool)
    for k in range(window):
        covered[k : n + k] |= twice
    return int(covered.sum())


def duplicate_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def by_text(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of a flag over each text."""
    sums = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def class_counts(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Texts by character classes."""
    n, k = len(offsets) - 1, len(CLASSES)
    owner = np.repeat(np.arange(n, dtype=np.int64) * k, np.diff(offsets))
    out = np.bincount(owner + CLASS[raw], minlength=n * k).reshape(n, k).astype(float)
    out[:, 0] = 0
    return out


def plain_words(text: bytes) -> list[bytes]:
    """Words for the histograms: ASCII in lower case, without marks around them."""
    return [w for w in (x.strip(STRIP) for x in text.lower().split()) if w]


@dataclass
class References:
    languages: list[str]
    classes: np.ndarray  # languages x classes, shares
    words: list[bytes]  # common in some language
    shares: list[tuple[np.ndarray, np.ndarray]]  # of each language: its common words (places) and their shares


def distances(counts: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of each row of counts to a distribution."""
    total = counts.sum(1, keepdims=True)
    p = counts / np.maximum(total, 1)

    def plogp(x):
        return np.where(x > 0, x * np.log2(np.maximum(x, 1e-300)), 0.0).sum(-1)

    return np.sqrt(np.clip(plogp(p) / 2 + plogp(reference) / 2 - plogp((p + reference) / 2), 0, 1))


def word_distances(counts: np.ndarray, references: References) -> np.ndarray:
    """Distance of each row of counts (of words, and the rest) to the nearest language."""
    best, total = np.ones(len(counts)), counts.sum(1)
    for at, share in references.shares:
        mine = counts[:, at]
        rest = (total - mine.sum(1))[:, None]
        best = np.minimum(best, distances(np.hstack([mine, rest]), np.append(share, max(0.0, 1 - share.sum()))))
    return best


def fit_references(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", share: float = SHARE) -> References:
    """References of every language, over all documents that name theirs."""
    spark = docs.sparkSession
    common.ship(spark)
    known = docs.where(F.col(lang_col).isNotNull()).select(lang_col, text_col)
    row = T.StructType([T.StructField("lang", T.StringType()), T.StructField("word", T.BinaryType()), T.StructField("n", T.LongType()), T.StructField("whole", T.BooleanType())])

    def candidates(batches):
        seen: dict[str, Counter] = {}
        total: Counter = Counter()

        def part(lang, whole):
            """Ends a part of a language: its common words, or all counts of a small one."""
            c, n = seen.pop(lang), total.pop(lang)
            out = [(w, k) for w, k in c.items() if not whole or k >= share * n]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(out), pa.string()), pa.array([w for w, _ in out], pa.binary()), pa.array([k for _, k in out], pa.int64()), pa.array([whole] * len(out))], names=row.names)

        for batch in batches:
            for b in common.chunks(batch, text_col):
                raw, off = common.flat(b.column(1))
                raw, off = raw.tobytes(), off.tolist()
                for lang, a, z in zip(b.column(0).to_pylist(), off, off[1:]):
                    w = plain_words(raw[a:z])
                    seen.setdefault(lang, Counter()).update(w)
                    total[lang] += len(w)
                while sum(map(len, seen.values())) > PART_WORDS:
                    yield from part(max(seen, key=lambda x: len(seen[x])), True)
        for lang in list(seen):
            yield from part(lang, total[lang] >= SMALL_PART)

    # Written down, as two queries read it: at most 1 / share words of a part, or SMALL_PART.
    work = common.Workspace(spark, "references")
    named = work.write(known.mapInArrow(common.tidied(candidates), row), "candidates")
    small = named.where("not whole").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    totals = named.where("not whole").groupBy("lang").agg(F.sum("n").alias("t"))
    small = small.join(totals, "lang").where(F.col("n") >= share * F.col("t")).select("word")
    words = sorted(bytes(r.word) for r in named.where("whole").select("word").unionAll(small).distinct().collect())
    held = spark.sparkContext.broadcast({w: i for i, w in enumerate(words)})

    bins = T.StructType([T.StructField("lang", T.StringType()), T.StructField("bin", T.LongType()), T.StructField("n", T.LongType())])

    def count(batches):
        place, k = held.value, len(CLASSES)
        seen: dict[str, Counter] = {}

        def given():
            rows = [(lang, i, n) for lang, c in seen.items() for i, n in c.items() if n]
            seen.clear()
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], names=bins.names)

        for whole in batches:
            for b in common.chunks(whole, text_col):
                raw, off = common.flat(b.column(1))
                classes, raw, off = class_counts(raw, off), raw.tobytes(), off.tolist()
                for i, lang in enumerate(b.column(0).to_pylist()):
                    c = seen.setdefault(lang, Counter())
                    for j, n in enumerate(classes[i].astype(np.int64).tolist()):
                        c[j] += n
                    # Words that nobody named are counted under -1.
                    c.update(place.get(w, -1 - k) + k for w in plain_words(raw[off[i] : off[i + 1]]))
                if sum(map(len, seen.values())) > HELD:
                    yield from given()
        yield from given()

    binned = work.write(known.mapInArrow(common.tidied(count), bins).groupBy("lang", "bin").agg(F.sum("n").alias("n")), "bins")
    k = len(CLASSES)
    totals = binned.groupBy("lang").agg(F.sum(F.when(F.col("bin").between(0, k - 1), F.col("n"))).alias("chars"), F.sum(F.when(~F.col("bin").between(0, k - 1), F.col("n"))).alias("total")).where("chars > 0 and total > 0")
    # Of each language its classes, its number of words and its common words, 1 / share at most.
    got = binned.join(totals, "lang").where((F.col("bin") < k) | (F.col("n") >= share * F.col("total"))).toPandas()
    work.clear()
    of_lang, shares, places = {}, [], {}
    for lang, rows in sorted(got.groupby("lang")):
        of_class = np.zeros(k)
        inside = rows["bin"].between(0, k - 1)
        of_class[rows["bin"][inside].to_numpy(int)] = rows["n"][inside]
        of_lang[lang] = of_class / of_class.sum()
        mine = rows[rows["bin"] >= k].sort_values("bin")
        shares.append((np.array([places.setdefault(int(x) - k, len(places)) for x in mine["bin"]], np.int64), mine["n"].to_numpy(float) / max(rows["total"].iloc[0], 1)))
    return References(list(of_lang), np.array(list(of_lang.values())).reshape(-1, k), [words[x] for x in places], shares)


class Measurer:
    """Counts and distances of chunks of texts."""

    def __init__(self, references: References):
        self.ref = references
        self.place = {w: i for i, w in enumerate(references.words)}
        self.known: dict[bytes, int] = {}

    def least_pair(self, words: list[bytes]) -> int:
        """The least hash of two words side by side."""
        known = self.known
        if len(known) > PART_WORDS:
            known.clear()
        for w in words:
            if w not in known:
                known[w] = xxhash.xxh64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        return int(mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]).min() >> np.uint64(1)) if len(h) > 1 else 0

    def measure(self, texts: pa.Array) -> dict[str, np.ndarray]:
        raw, off = common.flat(texts)
        n = len(off) - 1
        out = {
            "word_chars": by_text(INSIDE[raw], off),
            "n_symbols": by_text(SYMBOL[raw], off),
            **{name: np.zeros(n, np.int64) for name in ("n_words", "n_dup_lines", "n_repeat_words", "copy_key")},
            "char_distance": np.zeros(n),
            "word_distance": np.zeros(n),
        }
        classes = class_counts(raw, off)
        raw, off = raw.tobytes(), off.tolist()
        number: dict[bytes, int] = {}
        held, counts, width = [], [], len(self.place) + 1

        def settle():
            if held:
                out["word_distance"][held] = word_distances(np.array(counts, float), self.ref)
                held.clear()
                counts.clear()

        for i, (a, b) in enumerate(zip(off, off[1:])):
            text = raw[a:b]
            w = text.split()
            out["n_words"][i] = len(w)
            out["n_dup_lines"][i] = duplicate_lines(text)
            if len(w) > 3:
                number.clear()
                ids = np.fromiter((number.setdefault(x, len(number)) for x in w), np.int64, len(w))
                out["n_repeat_words"][i] = repeated(ids)
            if self.ref.languages and len(w) >= MIN_WORDS:
                own = plain_words(text)
                out["copy_key"][i] = self.least_pair(own)
                at = [self.place.get(x, -1) for x in own]
                held.append(i)
                counts.append(np.bincount(np.array(at, np.int64) % width, minlength=width))
                if len(held) * width > CELLS:
                    settle()
        settle()
        out["n_chars"] = classes.sum(1).astype(np.int64)
        if self.ref.languages:
            out["char_distance"] = np.min([distances(classes, q) for q in self.ref.classes], axis=0)
        out["base_failed"] = (out["n_words"] < 50) | (100 * out["n_repeat_words"] > 50 * out["n_words"])
        return out


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MEASURES = [*((c, T.LongType()) for c in COUNTS), ("base_failed", T.BooleanType()), ("char_distance", T.DoubleType()), ("word_distance", T.DoubleType()), ("n_chars", T.LongType()), ("copy_key", T.LongType())]


def measure(docs: DataFrame, references: References, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id`` and measures of every row."""
    held = docs.sparkSession.sparkContext.broadcast(references)

    def make():
        m = Measurer(held.value)

        def work(texts):
            got = m.measure(texts)
            return [got[name] for name, _ in MEASURES]

        return work

    return common.map_texts(docs, make, MEASURES, id_col, text_col)


@dataclass
class Limits:
    """Farthest distances at which texts are kept, by the power of two of their number of words."""

    chars: list[float]
    words: list[float]


LENGTHS = 40


def limit_of(counts: np.ndarray, least: float) -> float | None:
    """The limit from counts of texts by steps of distance."""
    n = int(counts.sum())
    if n < LEAST_TEXTS:
        return None
    upto = np.cumsum(counts)
    low, median = (float(np.searchsorted(upto, q * n)) * STEP for q in (0.05, 0.5))
    return median + SPREADS * max(median - low, least)


def fit_limits(measured: DataFrame) -> Limits:
    """Limits from the measures of all texts."""
    length = F.floor(F.log2(F.col("n_words").cast("double"))).cast("int").alias("length")
    there = measured.where(~F.col("base_failed") & (F.col("n_words") >= MIN_WORDS) & (F.col("n_chars") >= MIN_CHARS))
    texts = there.groupBy(length, "copy_key").agg(F.min("char_distance").alias("d0"), F.min("word_distance").alias("d1"))
    cells = texts.select("length", F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.floor(F.col(f"d{k}") / STEP).cast("int").alias("at")) for k in (0, 1)))).alias("c"))
    # At most LENGTHS x 2 x 1 / STEP numbers come back.
    tables = np.zeros((2, LENGTHS, int(1 / STEP) + 2), np.int64)
    for r in cells.groupBy("length", "c.kind", "c.at").agg(F.count(F.lit(1)).alias("n")).collect():
        tables[r["kind"], min(r["length"], LENGTHS - 1), r["at"]] = r["n"]
    out = []
    for table, least in zip(tables, LEAST_SPREAD):
        limits, before = [], 1.0
        for counts in table:
            found = limit_of(counts, least)
            before = before if found is None else found
            limits.append(before)
        out.append(limits)
    return Limits(*out)


def passes(limits: Limits):
    """Whether a row of measures is kept."""
    length = F.least(F.floor(F.log2(F.greatest(F.col("n_words"), F.lit(1)).cast("double"))).cast("int"), F.lit(LENGTHS - 1)) + 1
    far = (F.col("n_chars") >= MIN_CHARS) & (F.col("n_words") >= 1) & (F.col("char_distance") > F.element_at(F.array(*map(F.lit, limits.chars)), length))
    far = far | ((F.col("n_words") >= MIN_WORDS) & (F.col("word_distance") > F.element_at(F.array(*map(F.lit, limits.words)), length)))
    return ~F.col("base_failed") & ~far


def judge(docs: DataFrame, references: References, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, counts, verdicts and distances of every row."""
    docs = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    measured = common.materialise(measure(docs, references, "__id", "__text"), "measured")
    out = measured.withColumn("kept", passes(fit_limits(measured)))
    return out.select(F.col("__id").alias(id_col), *COUNTS, "base_failed", "kept", "char_distance", "word_distance")


def keep_good(docs: DataFrame, references: References, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, that pass."""
    limits = fit_limits(measure(docs.select(F.col(text_col).alias("__text"), F.lit(0).alias("__id")), references, "__id", "__text"))
    held = docs.sparkSession.sparkContext.broadcast((references, limits))

    def make():
        references, limits = held.value
        m, chars, words = Measurer(references), np.array(limits.chars), np.array(limits.words)

        def work(texts):
            got = m.measure(texts)
            n = got["n_words"]
            length = np.minimum(np.floor(np.log2(np.maximum(n, 1))).astype(int), LENGTHS - 1)
            far = (got["n_chars"] >= MIN_CHARS) & (n >= 1) & (got["char_distance"] > chars[length])
            return ~got["base_failed"] & ~far & ~((n >= MIN_WORDS) & (got["word_distance"] > words[length]))

        return work

    return common.filter_texts(docs, make, text_col)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return judge(docs, fit_references(docs))
