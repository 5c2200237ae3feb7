"""Operators that judge each text by itself, against brute force."""

import hashlib
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
import tiktoken
import xxhash
from pyspark.sql import functions as F

from hexalloc.llm import bpe, decontamination, html_text, language_id, licenses, quality, quality_classifier, sketches, token_counts

SF = "/root/testdata/sf0.001"


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect() if r[key] is not None}


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def alnum(t):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(t))


def plain(t):
    return re.findall("[^\x20\x09-\x0d]+", t or "")


# licenses


def base_places(text):
    w = alnum(text)
    out = []
    for label, phrase in (("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc")):
        p = phrase.split()
        out += [(label, i) for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
    return len(w), out


def test_license_base(spark, documents, edges):
    for docs in (documents.select("doc_id", "text"), edges):
        texts = {r.doc_id: r.text for r in docs.collect()}
        for i, r in by_id(licenses.scan(docs)).items():
            n, places = base_places(texts[i])
            assert r.n_words == n
            assert sorted((p.label, p.word) for p in r.base) == sorted(places)


def test_license_query(spark):
    for r in licenses.op1_license_scans(spark, SF).collect():
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
        assert (r.n_base == 0) == (r.first_word is None) == (r.base_labels == "")


def test_license_rules():
    s = licenses.Scanner()
    assert len(s.rules) >= 200
    labels = lambda t: {d[0] for d in s.scan(t.encode())[2]}
    assert labels("GNU Lesser General Public License, version 2.1") == {"lgpl-2.1"}
    assert labels("SPDX-License-Identifier: GPL-3.0-or-later") == {"gpl-3"}
    assert labels("released under the BSD 3-Clause License") == {"bsd-3-clause"}
    assert labels("see https://creativecommons.org/licenses/by-nc-sa/4.0/") == {"cc-by-nc-sa"}
    assert labels("ich gehe mit dir, ruby") == set()
    # what lies inside a detection is suppressed
    n, _, found = s.scan(b"Licensed under the Apache License, Version 2.0")
    assert [(d[0], d[2], d[3]) for d in found] == [("apache-2", 0, n - 1)]


def brute_labels(text, rules):
    """Every rule at every place, without gates; a detection inside one of a higher rank goes."""
    w = alnum(text)
    joined = " " + " ".join(w) + " "
    starts = [i for i, c in enumerate(joined) if c == " "][:-1]
    found = []
    for rule in rules:
        body = re.compile(rule.regex.pattern.decode()[len(" (?=") : -len(" )")] + "(?= )", re.ASCII)
        for k, at in enumerate(starts):
            if m := body.match(joined, at + 1):
                found.append((-rule.priority, -len(m[0].split()), k, rule.name, rule.label))
    kept = []
    for priority, n, k, name, label in sorted(found):
        if not any(a <= k and k - n <= b for a, b, _ in kept):
            kept.append((k, k - n, label))
    return {x for _, _, x in kept}


def test_license_labels_against_brute_force(spark, documents):
    """Labels of documents, and of texts of notices in any mix, by plain means."""
    s = licenses.Scanner()
    rng = np.random.default_rng(11)
    some = ["licensed under the", "apache license version 2 0", "mit license", "gnu lesser general public license", "version 3", "or later", "spdx license identifier", "gpl 2 0 only", "copyright 2020", "cc by nc", "creative commons attribution", "share alike", "sharealike 4 0", "bsd 3 clause license", "the", "all rights reserved", "released under", "https opensource org licenses mit", "python"]
    texts = [" ".join(rng.choice(some, rng.integers(1, 9))) for _ in range(300)]
    texts += [r.text for r in documents.collect() if len(r.text) < 1500][:60]
    for t in texts:
        assert {d[0] for d in s.scan(t.encode())[2]} == brute_labels(t, s.rules), t


def test_license_detections_never_nest():
    s = licenses.Scanner()
    text = " ".join(f"licensed under the {x} license, all rights reserved" for x in ("mit", "apache", "new bsd", "mit", "isc") * 60)
    spans = [(d[2], d[3]) for d in s.scan(text.encode())[2]]
    assert spans and not any(a != b and a[0] <= b[0] and b[1] <= a[1] for a in spans for b in spans)


# quality rules


def quality_counts(text):
    w = plain(text)
    grams = Counter(zip(w, w[1:], w[2:]))
    covered = {i + k for i, g in enumerate(zip(w, w[1:], w[2:])) if grams[g] > 1 for k in range(3)}
    seen, dups = set(), 0
    for line in (text or "").split("\n"):
        if plain(line):
            dups += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dups, len(covered)


def test_quality_counts(spark, documents, edges):
    for docs in (documents, edges):
        texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
        for i, r in by_id(quality.judge(docs, quality.fit_references(docs))).items():
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == quality_counts(texts[i])
            assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
            assert not (r.base_failed and r.kept)


def test_quality_references_are_exact(spark, documents, monkeypatch):
    """Parts that end early lose no common word."""
    whole = quality.fit_references(documents, share=0.01)
    seen = {}
    for r in documents.select("lang", "text").collect():
        seen.setdefault(r.lang, Counter()).update(quality.plain_words(r.text.encode()))
    want = {w for c in seen.values() for w, n in c.items() if n >= 0.01 * sum(c.values())}
    assert set(whole.words) == want
    monkeypatch.setattr(quality, "PART_WORDS", 300)
    parts = quality.fit_references(documents, share=0.01)
    for found in (whole, parts):
        for lang, (at, shares) in zip(found.languages, found.shares):
            total = sum(seen[lang].values())
            assert {found.words[x] for x in at} == {w for w, n in seen[lang].items() if n >= 0.01 * total}
            for x, p in zip(at, shares):
                assert p == pytest.approx(seen[lang][found.words[x]] / total)


def test_distance_by_hand():
    q = np.array([0.5, 0.5, 0.0])
    assert quality.distances(np.array([[2.0, 2.0, 0.0]]), q)[0] == pytest.approx(0)
    assert quality.distances(np.array([[0.0, 0.0, 3.0]]), q)[0] == pytest.approx(1)


def divergence(p, q):
    """Jensen-Shannon distance of two dicts of shares."""
    kl = lambda a, m: sum(x * np.log2(x / m[k]) for k, x in a.items() if x > 0)
    m = {k: (p.get(k, 0) + q.get(k, 0)) / 2 for k in p.keys() | q.keys()}
    return (kl(p, m) / 2 + kl(q, m) / 2) ** 0.5


def test_quality_verdicts_against_brute_force(spark, monkeypatch):
    """Distances, limits and verdicts of every document, step by step from the words."""
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.collect()
    words = {r.doc_id: quality.plain_words((r.text or "").encode()) for r in rows}
    seen = {}
    for r in rows:
        seen.setdefault(r.lang, Counter()).update(words[r.doc_id])
    refs = []
    for c in seen.values():
        total = sum(c.values())
        ref = {w: n / total for w, n in c.items() if n >= quality.SHARE * total}
        refs.append(ref | {None: 1 - sum(ref.values())})
    got = {r.doc_id: r for r in quality.op2_quality_rules(spark, sf).collect()}
    near, texts = {}, {}
    for i, own in words.items():
        if got[i].n_words < 50:
            continue
        counts = Counter(own)
        near[i] = min(divergence({w: counts[w] / len(own) for w in ref if w and counts[w]} | {None: sum(n for w, n in counts.items() if w not in ref) / len(own)}, ref) for ref in refs)
        assert got[i].word_distance == pytest.approx(near[i], abs=1e-9)
        if not got[i].base_failed:
            h = [xxhash.xxh64_intdigest(w) for w in own]
            key = min((int(sketches.mix(np.array([(a * 0x9E3779B97F4A7C15 + b) % 2**64], np.uint64))[0]) >> 1 for a, b in zip(h, h[1:])), default=0)
            text = texts.setdefault(int(np.log2(got[i].n_words)), {}).setdefault(key, [1.0, 1.0])
            text[:] = min(text[0], got[i].char_distance), min(text[1], got[i].word_distance)
    limits, before = {}, (1.0, 1.0)
    for length in range(40):
        if len(found := list(texts.get(length, {}).values())) >= quality.LEAST_TEXTS:
            before = []
            for k, least in enumerate(quality.LEAST_SPREAD):
                d = sorted(int(x[k] / quality.STEP) * quality.STEP for x in found)
                low, median = d[int(np.ceil(0.05 * len(d))) - 1], d[int(np.ceil(0.5 * len(d))) - 1]
                before.append(median + quality.SPREADS * max(median - low, least))
        limits[length] = tuple(before)
    for r in got.values():
        length = int(np.log2(max(r.n_words, 1)))
        near_limit = any(abs(d - x) < 0.003 for d, x in zip((r.char_distance, r.word_distance), limits[length]))
        if not near_limit:
            assert r.kept == (not r.base_failed and r.char_distance <= limits[length][0] and r.word_distance <= limits[length][1])
    assert {r.kept for r in got.values() if not r.base_failed} == {True, False}


def test_quality_limits_and_copies(spark):
    """A third of all rows being near copies of one text moves no limit."""
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    refs = quality.fit_references(docs)
    base = next(r.text.split() for r in docs.orderBy("doc_id").collect() if 140 < len(r.text.split()) < 240)
    copies = [(10_000 + k, " ".join([*base[: k % 100], f"new{k}", *base[k % 100 :]]), "en") for k in range(500)]
    plain, more = (quality.fit_limits(quality.measure(d, refs)) for d in (docs, docs.unionAll(spark.createDataFrame(copies, docs.schema))))
    assert more.words == pytest.approx(plain.words, rel=0.15) and more.chars == pytest.approx(plain.chars, rel=0.15)


def test_keep_good_is_the_verdict(spark, documents):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumns({"kept": F.lit("x"), "n_words": F.lit(1)})
    refs = quality.fit_references(docs)
    kept = quality.keep_good(docs, refs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in quality.judge(docs, refs).where("kept").collect()}


def test_quality_keeps_clean_documents(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = quality.op2_quality_rules(spark, "/root/testdata/sf0.01").join(labels, "doc_id").where("not base_failed")
    assert got.where("quality = 1 and not kept").count() == 0
    assert got.where("quality = 0 and not kept").count() > 0


def test_quality_without_references(spark, nothing):
    assert quality.judge(nothing, quality.fit_references(nothing)).count() == 0
    assert quality.fit_references(nothing).languages == []


# language


def test_forward_sums_against_all_segmentations():
    pieces = language_id.Pieces(["▁", "▁a", "a", "b", "ab", "▁ab", "ba"])
    rng = np.random.default_rng(0)
    p = np.hstack([rng.dirichlet(np.ones(len(pieces.pieces)), 2), np.full((2, 1), 1e-7)])
    at = {x: i for i, x in enumerate(pieces.pieces)}

    def brute(s, k):
        if not s:
            return 1.0
        return sum((p[k, at[s[:n]]] if s[:n] in at else p[k, -1] if n == 1 else 0.0) * brute(s[n:], k) for n in range(1, len(s) + 1))

    words = ["a", "ab", "abab", "xyz", "abba", "baab"]
    got = language_id.log_likelihoods(pieces, p, words)
    for i, w in enumerate(words):
        for k in (0, 1):
            assert got[i, k] == pytest.approx(np.log(brute("▁" + w, k)))


def dynamic(s, p, at):
    """Log of the sum over all segmentations, in logarithms from the start."""
    out = [0.0] + [-np.inf] * len(s)
    for j in range(1, len(s) + 1):
        for n in range(1, min(j, 9) + 1):
            x = p[at[s[j - n : j]]] if s[j - n : j] in at else p[-1] if n == 1 else 0.0
            if x > 0:
                out[j] = np.logaddexp(out[j], out[j - n] + np.log(x))
    return out[-1]


def test_long_runs_are_summed_whole():
    names = ["▁", "▁a", "a", "b", "ab", "▁ab", "ba", "abababab", "é", "日本"]
    pieces = language_id.Pieces(names)
    rng = np.random.default_rng(1)
    p = np.hstack([rng.dirichlet(np.ones(len(names)), 3), np.full((3, 1), 1e-7)])
    at = {x: i for i, x in enumerate(names)}
    words = ["".join(rng.choice(list("abé日本z"), n)) for n in (1, 15, 16, 17, 31, 32, 33, 80, 500)] + ["ab" * 700, "z" * 400]
    got = language_id.log_likelihoods(pieces, p, words)
    assert got == pytest.approx(np.array([[dynamic("▁" + w, p[k], at) for k in range(3)] for w in words]), rel=1e-9)
    # Expected pieces spell the word, however long it is.
    known = [w for w in words if "z" not in w and "日" not in w and "本" not in w] + ["ab" * 700 + "a"]
    word, piece, amount = language_id.expected(pieces, known)
    assert np.bincount(word, amount * np.array(list(map(len, names)))[piece]) == pytest.approx([len(w) + 1 for w in known])


def test_long_pieces_count():
    pieces = language_id.Pieces(["a", "▁", "a" * 40])
    p = np.array([[0.2, 0.3, 0.4, 1e-7]])
    at = {x: i for i, x in enumerate(pieces.pieces)}
    w = "▁" + "a" * 41
    out = [0.0] + [-np.inf] * len(w)
    for j in range(1, len(w) + 1):
        for n in (1, 40):
            if n <= j and w[j - n : j] in at:
                out[j] = np.logaddexp(out[j], out[j - n] + np.log(p[0, at[w[j - n : j]]]))
    assert language_id.log_likelihoods(pieces, p, [w[1:]])[0, 0] == pytest.approx(out[-1])


def test_languages_in_blocks(spark, documents):
    """Results don't depend on how many languages are held at a time."""
    docs = documents.select("doc_id", "text", "lang", F.lit("x").alias("found"))
    vocabulary = language_id.public_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    one, two = ({r.doc_id: (r.lang_pred, round(r.score, 9)) for r in language_id.identify(docs, language_id.fit(docs, vocabulary, block=b)).collect()} for b in (300, 1))
    assert one == two
    kept = language_id.keep_identified(docs, language_id.fit(docs, vocabulary, block=3))
    assert kept.columns == docs.columns and kept.count() == sum(v[1] >= 0.5 for v in one.values())


def test_expected_counts_spell_the_word():
    pieces = language_id.Pieces(["▁", "▁a", "a", "b", "ab", "▁ab", "ba"])
    word, piece, amount = language_id.expected(pieces, ["abab", "b"])
    sizes = np.array([len(x) for x in pieces.pieces])
    assert np.bincount(word, amount * sizes[piece]) == pytest.approx([5, 2])


def test_language_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = language_id.op6_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out")
    assert got.where("lang = lang_pred").count() >= 0.99 * got.count()


def test_language_edges(spark, edges, nothing):
    model = language_id.fit(edges, ["▁", "▁t", "t", "h", "e", "the", "▁the", "word", "a"])
    got = by_id(language_id.identify(edges, model))
    assert {got[i].lang_pred for i in (0, 1, 2)} == {"und"} and got[0].score == 0
    assert got[6].lang_pred == "en" and 0 <= got[6].score <= 1
    assert language_id.identify(edges, model).count() == edges.count()
    empty = language_id.fit(nothing, ["a"])
    assert {r.lang_pred for r in language_id.identify(edges, empty).collect()} == {"und"}
    assert language_id.keep_identified(edges, model).columns == edges.columns


# tokens


def test_token_counts(spark, documents, edges, tmp_path):
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for k, docs in enumerate((documents, edges)):
        texts = {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}
        got = token_counts.count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model"), str(tmp_path / f"cache{k}"))
        assert got.count() == docs.count() and got.where("n_tokens is null").count() == 0
        for i, r in by_id(got).items():
            assert (r.n_tokens, r.n_bytes) == (len(sp.encode(texts[i])), len(texts[i].encode()))


def test_cache_encodes_only_misses(spark, documents, edges, nothing, tmp_path, monkeypatch):
    path, model = str(tmp_path / "cache"), public_tokenizers.path("piece_bpe_32k.model")
    half = documents.where("doc_id % 2 = 0")
    first = token_counts.count_tokens(half, model, path).count()
    stored = spark.read.parquet(path)
    assert first and stored.count() == half.select("text").distinct().count()
    again = token_counts.count_tokens(documents, model, path)
    assert again.count() == documents.count()
    after = spark.read.parquet(path)
    assert after.count() == after.select("digest").distinct().count() == documents.select("text").distinct().count()
    assert token_counts.count_tokens(nothing, model, path).count() == 0


def test_cache_of_two_writers(spark, documents, tmp_path):
    """A digest that was stored twice is read once."""
    path, model = str(tmp_path / "cache"), public_tokenizers.path("piece_bpe_32k.model")
    want = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(documents, model, path).collect()}
    spark.read.parquet(path).limit(30).write.mode("append").partitionBy("tokenizer").parquet(path)
    got = token_counts.count_tokens(documents, model, path).collect()
    assert len(got) == documents.count() and {r.doc_id: r.n_tokens for r in got} == want


def test_json_tokenizer(spark, documents, tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    docs = documents.limit(20)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for i, r in by_id(token_counts.count_tokens(docs, path, str(tmp_path / "c"), "tokenizers")).items():
        assert r.n_tokens == len(tok.encode(texts[i], add_special_tokens=False).ids)


@pytest.fixture(scope="module")
def reference_bpe():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = bpe.parse_ranks(f.read())
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_bpe(spark, documents, edges, reference_bpe):
    for docs in (documents, edges):
        texts = {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}
        for i, r in by_id(bpe.digest_documents(docs, with_ids=True)).items():
            ids = reference_bpe.encode_ordinary(texts[i])
            assert r.ids == ids and r.n_tokens == len(ids)
            assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
            assert r.decoded_sha256 == hashlib.sha256(texts[i].encode()).hexdigest()


def test_segments_keep_the_pattern():
    """Cutting at spaces first gives the pattern's own matches, whatever the white space."""
    import regex

    cutter, plain = bpe.Cutter(public_tokenizers.PATTERN), regex.compile(public_tokenizers.PATTERN)
    assert cutter.spaced
    rng = np.random.default_rng(8)
    marks = [" ", " ", " ", "  ", "\n", "\t", "\u00a0", "\u3000", "\x1c", "\x85", "a", "Bc", "é", "日本", "1", "٣", "'s", "'", "...", "!", "\u200b", "\u0301"]
    for _ in range(4000):
        text = "".join(rng.choice(marks, rng.integers(0, 14)))
        segments = cutter.segments(text)
        assert (segments[0] + "".join(" " + x for x in segments[1:]) if segments else "") == text
        assert [w for i, x in enumerate(segments) for w in cutter.words(x, i == 0)] == plain.findall(text)
    assert not bpe.Cutter(r"\w+|\W").spaced


def test_words_of_many_chunks_and_parts(spark, documents, reference_bpe, monkeypatch):
    """Small chunks, blocks and memories give the same ids; each part encodes a word once."""
    for name, value in (("CHUNK", 5_000), ("MEMORY_WORDS", 300), ("BLOCK_WORDS", 50)):
        monkeypatch.setattr(bpe, name, value)
    texts = {r.doc_id: r.text or "" for r in documents.collect()}
    docs = documents.select(F.col("doc_id").cast("string").alias("doc_id"), "text", F.lit(1).alias("chunk")).repartition(3)
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    got = {r.doc_id: r.ids for r in bpe.encode(docs, path, public_tokenizers.PATTERN).collect()}
    assert got == {str(i): reference_bpe.encode_ordinary(t) for i, t in texts.items()}
    other = {r.doc_id: r.ids for r in bpe.encode(docs.limit(5), path, r"\w+|\W").collect()}
    plain = tiktoken.Encoding("other", pat_str=r"\w+|\W", mergeable_ranks=reference_bpe._mergeable_ranks, special_tokens={})
    assert other == {i: plain.encode_ordinary(texts[int(i)]) for i in other}
    assert bpe.encode(documents.limit(0), path, public_tokenizers.PATTERN).count() == 0


def test_byte_bpe_round_trip(spark, edges):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    back = by_id(bpe.decode(bpe.encode(edges, path, public_tokenizers.PATTERN), path))
    texts = {r.doc_id: r.text or "" for r in edges.select("doc_id", "text").collect()}
    assert all(bytes(r.decoded).decode() == texts[i] for i, r in back.items())


def test_replay_against_plain_merges(reference_bpe):
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        v = bpe.Vocabulary(bpe.parse_ranks(f.read()))
    rng = np.random.default_rng(4)
    words = ["", "a" * 999, "abab" * 50, *("".join(map(chr, rng.choice([*range(97, 105), 233, 0x4E00], rng.integers(1, 40)))) for _ in range(3000))]
    words = [w.encode() for w in words]
    assert v.replay(words) == [v.plain(w) for w in words]


# decontamination


def brute_windows(docs, items, size=13):
    windows, lengths = {}, set()
    for i, t in items:
        w = alnum(t)
        for k in range(max(1, len(w) - size + 1) if w else 0):
            windows.setdefault(tuple(w[k : k + size]), set()).add(i)
            lengths.add(len(w[k : k + size]))
    out = {}
    for i, t in docs:
        w, hit, ids = alnum(t), set(), set()
        for n in lengths:
            for k in range(len(w) - n + 1):
                if own := windows.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    ids |= own
        out[i] = (len(w), len(hit), len(ids - {None}), hashlib.sha256(",".join(sorted(str(x) for x in ids - {None})).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))
    return out


def verdict_rows(docs, bench):
    got = decontamination.verdicts(docs, bench)
    return {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got.collect()}


def test_decontamination(spark):
    sf = "/root/testdata/sf0.01"
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf}/benchmark.parquet")
    want = brute_windows([tuple(r) for r in docs.collect()], [tuple(r) for r in bench.collect()])
    assert verdict_rows(docs, bench) == want and any(x[1] for x in want.values())


def test_decontamination_names_and_ids(spark):
    """Columns with the operator's own names come through, and item ids may be strings."""
    rows = [(i, t, f"w{i}", [i], "m", None) for i, t in enumerate(("One two", "no match here", None))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, marks string, items array<int>, n_words string, Marks_ string")
    bench = spark.createDataFrame([("b-7", "one two"), ("a", "ONE"), ("a", "other")], "item_id string, text string")
    got = {r.doc_id: r for r in decontamination.verdicts(docs, bench).collect()}
    assert (got[0].n_items, got[0].items_sha256) == (2, hashlib.sha256(b"a,b-7").hexdigest()) and got[0].contaminated
    kept = decontamination.keep_clean(docs, bench)
    assert kept.schema == docs.schema and sorted(map(tuple, kept.collect())) == [tuple(r) for r in rows[1:]]
    with pytest.raises(ValueError):
        decontamination.mark(docs, bench)


@pytest.mark.parametrize("block", [3, 2_000_000])
def test_decontamination_edges(spark, edges, nothing, monkeypatch, block):
    monkeypatch.setattr(decontamination.blocks, "__defaults__", (block,))
    items = [(1, "one"), (2, "The word1 the word2 the word3"), (2, "ZZ top"), (3, None), (None, "mit license"), (4, "..."), (5, " ".join(f"word{i} the" for i in range(20))), (6, "日本語のテキスト と")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = edges.where("doc_id is not null").dropDuplicates(["doc_id"])
    got = verdict_rows(docs, bench)
    assert got == brute_windows([(r.doc_id, r.text) for r in docs.collect()], items)
    assert decontamination.keep_clean(docs, bench).columns == docs.columns
    assert verdict_rows(docs, bench.limit(0)) == brute_windows([(r.doc_id, r.text) for r in docs.collect()], [])
    assert verdict_rows(nothing, bench) == {}


def test_fm_index():
    rng = np.random.default_rng(0)
    for _ in range(60):
        v = int(rng.integers(1, 9))
        text = np.append(rng.integers(0, v + 1, rng.integers(1, 200)), 0).astype(np.int64)
        index = decontamination.FMIndex(text, v)
        assert index.locate(np.arange(index.n)).tolist() == decontamination.suffix_array(text).tolist()
        pattern = rng.integers(1, v + 1, (5, 3))
        low, high = index.search(pattern, np.full(5, 3))
        for p, a, b in zip(pattern, low, high):
            places = [i for i in range(len(text) - 2) if (text[i : i + 3] == p).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == places


# pages


def test_pages_against_their_template(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    import html

    got = by_id(html_text.op10_html_extraction(spark, "/root/testdata/sf0.01"), "page_id")
    for r in rows:
        a, b = r.html.find("<article>"), r.html.find("</article>")
        body = re.sub("<[^>]*$", "", r.html[a : b if b >= 0 else None])
        lines = (" ".join(html.unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split("</?(?:p|h1|article)>", body))
        assert got[r.page_id].text == "\n".join(x for x in lines if x)
        assert got[r.page_id].n_chars == len(got[r.page_id].text)


def test_page_edges(spark):
    w = html_text.fit(html_text.LABELLED)
    for page, blocks in html_text.LABELLED:
        assert html_text.extract(page, w).split("\n") == blocks
    cases = [(None, ""), ("", ""), ("plain", "plain"), ("<p>a<p>b", "a\nb"), ("<div>x &amp; y</div><scr", "x & y"), ("<p>one<!-- c", "one"), ("<p>one<script>var a = '<p>no</p>'", "one"), ("<nav>menu</nav>", ""), ("<article><p>x y z</p><aside>no no</aside><p>w</p></article><form>q</form>", "x y z\nw"), ('<p title="a > b">c</p>', "c"), ("<article><p>x x x</p><div class='advert'>" + "buy " * 30 + "</div>" + "<p>" + "y " * 9 + "</p></article>", "x x x\n" + " ".join("y" * 9))]
    for page, text in cases:
        assert html_text.extract(page, w) == text
    df = spark.createDataFrame([(i, None, p, 3) for i, (p, _) in enumerate(cases)] * 2, "page_id long, url string, html string, n_chars int")
    got = html_text.extract_pages(df, keep=["url"]).collect()
    assert sorted((r.page_id, r.text) for r in got) == sorted([(i, t) for i, (_, t) in enumerate(cases)] * 2)
    assert html_text.extract_pages(df.limit(0)).count() == 0


def test_long_pages_keep_all():
    w = html_text.fit(html_text.LABELLED)
    blocks = [f"paragraph {i} " + "x " * (i % 7) + "end" for i in range(3000)]
    page = "<html><body><nav><ul>" + "<li><a href=x>link</a></li>" * 400 + "</ul></nav><article>" + "".join(f"<p>{b}</p>" for b in blocks) + "</article><footer>" + "foot " * 500 + "</footer></body></html>"
    assert html_text.extract(page, w) == "\n".join(blocks)


# classifier


def test_classifier(spark):
    sf = "/root/testdata/sf0.1"
    got = quality_classifier.op3_quality_classifier(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").toPandas()
    rank = got.score.rank()
    n1 = int((got.quality == 1).sum())
    n0 = len(got) - n1
    assert (rank[got.quality == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * n0) > 0.95
    assert (got.predicted == got.quality).mean() > 0.93


def test_classifier_edges(spark, edges, nothing):
    labels = spark.createDataFrame([(3, 1, 0), (3, 0, 0), (4, 1, 0), (5, None, 0), (6, 0, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    for lab in (labels, labels.limit(0), labels.where("quality = 0")):
        got = quality_classifier.classify(edges, lab)
        assert got.count() == edges.count() and got.where("score < 0 or score > 1 or score is null").count() == 0
    assert quality_classifier.classify(nothing, labels).count() == 0


def test_prior_estimate():
    rng = np.random.default_rng(1)
    p = rng.normal(2, 1, (2000, 4))
    u = np.vstack([rng.normal(2, 1, (1400, 4)), rng.normal(-2, 1, (600, 4))])
    assert quality_classifier.estimate_prior(p, np.full(2000, 1 / 2000), u, np.full(2000, 1 / 2000)) == pytest.approx(0.7, abs=0.06)


def test_risk_gradient_against_differences():
    """Also where the negative part is below zero and the step goes back along it."""
    rng = np.random.default_rng(2)
    p, u = rng.normal(1, 1, (30, 5)), rng.normal(-1, 1, (40, 5))
    wp, wu = rng.dirichlet(np.ones(30)), rng.dirichlet(np.ones(40))
    layers = [rng.normal(0, 0.5, a.shape) for a in quality_classifier.start(5)]
    for prior in (0.2, 0.95):
        plus, minus = quality_classifier.risk(layers, p, wp, u, wu, prior)
        below = minus < 0
        got = quality_classifier.risk_gradient(p, wp, u, wu, prior)(layers)
        for k, a in enumerate(layers):
            for at in np.ndindex(a.shape):
                ends = []
                for step in (1e-6, -1e-6):
                    moved = [b.copy() for b in layers]
                    moved[k][at] += step
                    x, y = quality_classifier.risk(moved, p, wp, u, wu, prior)
                    ends.append(-y if below else x + y)
                assert got[k][at] == pytest.approx((ends[0] - ends[1]) / 2e-6, abs=1e-6)


def test_negative_part_below_zero():
    p, u = np.full((4, 1), 5.0), np.full((4, 1), -5.0)
    w = np.full(4, 0.25)
    layers = [np.zeros((1, 2)), np.zeros(2), np.zeros(2), np.zeros(1), np.ones(1)]
    assert quality_classifier.risk(layers, p, w, u, w, 0.5)[1] < 0
    got = quality_classifier.risk_gradient(p, w, u, w, 0.5)(layers)
    ends = []
    for step in (1e-6, -1e-6):
        moved = [*layers[:4], layers[4] + step]
        ends.append(-quality_classifier.risk(moved, p, w, u, w, 0.5)[1])
    assert got[4][0] == pytest.approx((ends[0] - ends[1]) / 2e-6, abs=1e-6)


def test_unlabelled_text_teaches(spark):
    """The same labels and other unlabelled text give another model; a hot id comes back once."""
    rng = np.random.default_rng(3)
    good = [" ".join(rng.choice(["the", "river", "runs", "low", "under", "bridge"], 60)) + "." for _ in range(120)]
    junk = [" | ".join(rng.choice(["XX", "99", "##", "||"], 60)) for _ in range(120)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(good + junk)] + [(7, good[7])] * 200, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(0, 120, 3)], "doc_id long, quality int")
    got = {r.doc_id: r.score for r in quality_classifier.classify(docs, labels).collect()}
    assert min(got[i] for i in range(120)) > max(got[i] for i in range(120, 240))
    alone = {r.doc_id: r.score for r in quality_classifier.classify(docs, labels, learn_from=F.col("doc_id") < 120).collect()}
    assert alone != got
    x, n = quality_classifier.sample(docs.select(F.array(*[F.col("doc_id") * 1.0] * len(quality_classifier.NAMES)).alias("x"), F.xxhash64("doc_id").alias("h")), 10_000)
    assert len(x) == 240 and n.sum() == 440 and n.max() == 201


def test_measures_of_nothing():
    x = quality_classifier.measures(pa.array([None, "", "a"], pa.string()))
    assert x.shape == (3, len(quality_classifier.NAMES)) and np.isfinite(x).all()
