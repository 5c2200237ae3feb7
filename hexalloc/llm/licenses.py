"""License scan: ordered signature rules behind a keyword gate.

A text is read as words (runs of digits, a-z after lower-casing A-Z, and characters
beyond ASCII), so punctuation, line breaks and comment marks never hide a notice.  Each
rule is a regex over the words joined by single spaces, has keywords that must all be
among the text's words before the regex is tried (taken from all strings that it stands
for, so that none is turned away), and a priority.  Detections are taken
from the highest priority down, then the longest; one that lies inside a detection
already taken is suppressed, so "general public license" inside "lesser general public
license" reports nothing.  Base phrases are always reported.

Edge cases: a null or empty text has no words, no places, null first and last word,
empty labels and score 0; repeated rows give repeated results; an empty table gives
none; texts are read whole; other columns are never read.
"""

from __future__ import annotations

import bisect
import itertools
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Phrases that always count, as words.
BASE = (("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc"))

#: Hand-written signatures: label, then regexes of its name, of its SPDX identifiers and
#: of its addresses, each over words joined by single spaces.
FAMILIES = (
    ("mit", ["(?:the )?mit(?: x11)? licen[sc]e", "expat licen[sc]e"], ["mit"], ["opensource org licenses mit", "choosealicense com licenses mit", "mit license org"]),
    ("mit-0", ["mit no attribution(?: licen[sc]e)?"], ["mit 0"], ["opensource org licenses mit 0"]),
    ("apache-2", ["apache(?: software)? licen[sc]e(?: version)? 2(?: 0)?", "apache 2(?: 0)? licen[sc]e"], ["apache 2 0"], ["apache org licenses license 2 0", "opensource org licenses apache 2 0"]),
    ("apache-1.1", ["apache(?: software)? licen[sc]e(?: version)? 1 1"], ["apache 1 1"], ["apache org licenses license 1 1"]),
    ("apache", ["apache(?: software)? licen[sc]e"], [], ["apache org licenses"]),
    ("bsd-2-clause", ["(?:simplified|freebsd|2 clause|two clause) bsd licen[sc]e", "bsd (?:2|two) clause(?: licen[sc]e)?"], ["bsd 2 clause"], ["opensource org licenses bsd 2 clause"]),
    ("bsd-3-clause", ["(?:new|modified|revised|3 clause|three clause) bsd licen[sc]e", "bsd (?:3|three) clause(?: licen[sc]e)?"], ["bsd 3 clause"], ["opensource org licenses bsd 3 clause"]),
    ("bsd-4-clause", ["(?:original|old|4 clause|four clause) bsd licen[sc]e", "bsd (?:4|four) clause(?: licen[sc]e)?"], ["bsd 4 clause"], ["spdx org licenses bsd 4 clause"]),
    ("bsd", ["bsd(?: style)? licen[sc]e"], ["0bsd"], ["opensource org licenses bsd"]),
    ("isc", ["(?:the )?isc licen[sc]e"], ["isc"], ["opensource org licenses isc"]),
    ("zlib", ["zlib(?: libpng)? licen[sc]e"], ["zlib"], ["opensource org licenses zlib", "zlib net zlib license"]),
    ("boost-1.0", ["boost software licen[sc]e(?: version)?(?: 1(?: 0)?)?"], ["bsl 1 0"], ["boost org license 1 0 txt"]),
    ("unlicense", ["(?:the )?unlicense", "free and unencumbered software released into the public domain"], ["unlicense"], ["unlicense org"]),
    ("wtfpl", ["do what the fuck you want to(?: public licen[sc]e)?", "wtfpl"], ["wtfpl"], ["wtfpl net"]),
    ("gpl-1", ["gnu general public licen[sc]e(?: as published by the free software foundation)?(?: either)? version 1"], ["gpl 1 0(?: only| or later)?"], ["gnu org licenses old licenses gpl 1 0"]),
    ("gpl-2", ["gnu general public licen[sc]e(?: as published by the free software foundation)?(?: either)? v(?:ersion )?2", "(?:gnu )?gpl ?v(?:ersion)? ?2", "gplv2"], ["gpl 2 0(?: only| or later)?"], ["gnu org licenses(?: old licenses)? gpl 2 0", "opensource org licenses gpl 2 0"]),
    ("gpl-3", ["gnu general public licen[sc]e(?: as published by the free software foundation)?(?: either)? v(?:ersion )?3", "(?:gnu )?gpl ?v(?:ersion)? ?3", "gplv3"], ["gpl 3 0(?: only| or later)?"], ["gnu org licenses gpl 3 0", "opensource org licenses gpl 3 0"]),
    ("gpl", ["(?:gnu )?general public licen[sc]e", "gnu gpl"], [], ["gnu org licenses gpl", "gnu org copyleft gpl"]),
    ("lgpl-2.1", ["gnu (?:lesser|library) general public licen[sc]e(?: as published by the free software foundation)?(?: either)? version 2(?: 1)?", "lgplv2 1"], ["lgpl 2 [01](?: only| or later)?"], ["gnu org licenses(?: old licenses)? lgpl 2 [01]"]),
    ("lgpl-3", ["gnu lesser general public licen[sc]e(?: as published by the free software foundation)?(?: either)? version 3", "lgplv3"], ["lgpl 3 0(?: only| or later)?"], ["gnu org licenses lgpl 3 0"]),
    ("lgpl", ["(?:gnu )?(?:lesser|library) general public licen[sc]e"], [], ["gnu org licenses lgpl", "gnu org copyleft lesser"]),
    ("agpl-3", ["(?:gnu )?affero general public licen[sc]e(?: as published by the free software foundation)?(?: either)?(?: version 3)?", "agplv3"], ["agpl 3 0(?: only| or later)?"], ["gnu org licenses agpl"]),
    ("gfdl", ["gnu free documentation licen[sc]e(?: version 1 [123])?"], ["gfdl 1 [123](?: only| or later)?"], ["gnu org licenses fdl", "gnu org copyleft fdl"]),
    ("mpl-1.1", ["mozilla public licen[sc]e(?: version)? 1 [01]"], ["mpl 1 [01]"], ["mozilla org mpl mpl 1 1"]),
    ("mpl-2", ["mozilla public licen[sc]e(?: version)?(?: v)? 2(?: 0)?", "mplv2"], ["mpl 2 0"], ["mozilla org(?: en us)? mpl 2 0", "opensource org licenses mpl 2 0"]),
    ("mpl", ["mozilla public licen[sc]e"], [], ["mozilla org mpl"]),
    ("epl-1", ["eclipse public licen[sc]e(?: version)?(?: v)? 1(?: 0)?"], ["epl 1 0"], ["eclipse org legal epl v10"]),
    ("epl-2", ["eclipse public licen[sc]e(?: version)?(?: v)? 2(?: 0)?"], ["epl 2 0"], ["eclipse org legal epl 2 0", "eclipse org legal epl v20"]),
    ("cddl", ["common development and distribution licen[sc]e(?: version 1 [01])?"], ["cddl 1 [01]"], ["opensource org licenses cddl"]),
    ("cpl", ["common public licen[sc]e(?: version 1 0)?"], ["cpl 1 0"], ["opensource org licenses cpl"]),
    ("eupl", ["european union public licen[sc]e(?: v(?:ersion )?1 [012])?"], ["eupl 1 [012]"], ["joinup ec europa eu(?: \\w+){0,4} eupl"]),
    ("artistic-2", ["artistic licen[sc]e(?: version)? 2(?: 0)?"], ["artistic 2 0"], ["opensource org licenses artistic 2", "perlfoundation org artistic license 2"]),
    ("artistic", ["(?:perl )?artistic licen[sc]e"], ["artistic 1 0(?: perl)?"], ["opensource org licenses artistic"]),
    ("python-2", ["python software foundation licen[sc]e(?: version 2)?", "psf licen[sc]e agreement"], ["psf 2 0", "python 2 0"], ["docs python org 3 license", "python org psf license"]),
    ("php-3", ["php licen[sc]e(?: version)?(?: 3(?: 0 ?1)?)?"], ["php 3 0 1", "php 3 0"], ["php net license"]),
    ("ruby", ["ruby(?: s)? licen[sc]e"], ["ruby"], ["ruby lang org en about license"]),
    ("openssl", ["openssl licen[sc]e", "ssleay licen[sc]e"], ["openssl"], ["openssl org source license"]),
    ("ms-pl", ["microsoft public licen[sc]e"], ["ms pl"], ["opensource org licenses ms pl"]),
    ("ms-rl", ["microsoft reciprocal licen[sc]e"], ["ms rl"], ["opensource org licenses ms rl"]),
    ("upl-1", ["universal permissive licen[sc]e(?: v(?:ersion )?1 0)?"], ["upl 1 0"], ["oss oracle com licenses upl"]),
    ("postgresql", ["postgresql licen[sc]e"], ["postgresql"], ["postgresql org about licence"]),
    ("ofl-1.1", ["sil open font licen[sc]e(?: version 1 1)?"], ["ofl 1 1"], ["scripts sil org ofl", "openfontlicense org"]),
    ("odbl", ["open (?:data commons open )?database licen[sc]e"], ["odbl 1 0"], ["opendatacommons org licenses odbl"]),
    ("pddl", ["public domain dedication and licen[sc]e"], ["pddl 1 0"], ["opendatacommons org licenses pddl"]),
    ("bsl-1.1", ["business source licen[sc]e(?: 1 1)?"], ["busl 1 1"], ["mariadb com bsl11"]),
    ("sspl-1", ["server side public licen[sc]e(?: version 1)?"], ["sspl 1 0"], ["mongodb com licensing server side public license"]),
    ("elastic-2", ["elastic licen[sc]e(?: version)?(?: 2(?: 0)?)?"], ["elastic 2 0"], ["elastic co licensing elastic license"]),
    ("cc0", ["cc0(?: 1 0)?(?: universal)?", "creative commons zero", "creative commons public domain dedication"], ["cc0 1 0"], ["creativecommons org publicdomain zero"]),
    ("cc-by", ["creative commons attribution(?: [1-4] 0)?(?: international| unported| generic)? licen[sc]e", "cc by [1-4] 0"], ["cc by [1-4] 0"], ["creativecommons org licenses by [1-4]"]),
    ("cc-by-sa", ["creative commons attribution share ?alike(?: [1-4] 0)?(?: international| unported| generic)?", "cc by sa"], ["cc by sa [1-4] 0"], ["creativecommons org licenses by sa"]),
    ("cc-by-nc", ["creative commons attribution non ?commercial(?: [1-4] 0)?(?: international| unported| generic)?", "cc by nc"], ["cc by nc [1-4] 0"], ["creativecommons org licenses by nc [1-4]"]),
    ("cc-by-nd", ["creative commons attribution no ?deriv(?:ative)?s?", "cc by nd"], ["cc by nd [1-4] 0"], ["creativecommons org licenses by nd"]),
    ("cc-by-nc-sa", ["creative commons attribution non ?commercial share ?alike", "cc by nc sa"], ["cc by nc sa [1-4] 0"], ["creativecommons org licenses by nc sa"]),
    ("cc-by-nc-nd", ["creative commons attribution non ?commercial no ?deriv(?:ative)?s?", "cc by nc nd"], ["cc by nc nd [1-4] 0"], ["creativecommons org licenses by nc nd"]),
    ("all-rights-reserved", ["all rights (?:are )?reserved"], [], []),
    ("proprietary", ["proprietary and confidential", "confidential and proprietary"], ["licenseref proprietary"], []),
    ("public-domain", ["(?:dedicated to|released into|placed in) the public domain"], [], []),
)

#: Kinds of rules: priority, and a frame for the family's regex.
FRAMES = {
    "spdx": (100, "spdx license identifier {}(?: (?:with|and|or) \\w+)*"),
    "grant": (80, "(?:licen[sc]ed|released|distributed|published|provided|available|redistributed) under (?:the )?(?:terms (?:and conditions )?of )?(?:the )?{}"),
    "address": (70, "(?:https? )?(?:www )?{}"),
    "under": (60, "(?:under|subject to|governed by|per) (?:the )?(?:terms of )?(?:the )?{}"),
    "title": (50, "{} copyright(?: c)?(?: \\d{{4}})?"),
    "name": (40, "{}"),
}
SOURCES = {"spdx": 2, "address": 3, "grant": 1, "under": 1, "title": 1, "name": 1}


@dataclass(frozen=True)
class Rule:
    name: str
    label: str
    priority: int
    keywords: frozenset  # all among the words of a match
    any_of: frozenset  # one at least is, if there are any
    regex: re.Pattern


#: Stands for what an expansion leaves open.
OPEN = "\0"
PART = re.compile(r"\(\?:|[()|]|\[[^\]]*\]|\\w\+|[a-z0-9 ]")
TIMES = re.compile(r"\?|\{(\d+),(\d+)\}")


def expansions(pattern: str) -> set[str]:
    """All strings that a pattern stands for, with ``OPEN`` for a run of any letters."""
    at = 0

    def choice() -> set[str]:
        nonlocal at
        whole, run = set(), {""}
        while at < len(pattern) and pattern[at] != ")":
            m = PART.match(pattern, at)
            if not m:
                raise ValueError(f"{pattern!r}: unknown at {at}")
            at, token = m.end(), m[0]
            if token == "|":
                whole, run = whole | run, {""}
                continue
            if token == "(?:":
                part = choice()
                at += 1
            elif token[0] == "[":
                part = {c for c in map(chr, range(128)) if re.fullmatch(token, c)}
            else:
                part = {OPEN if token == "\\w+" else token}
            if m := TIMES.match(pattern, at):
                at = m.end()
                low, high = (0, 1) if m[0] == "?" else (int(m[1]), int(m[2]))
                part = {"".join(p) for k in range(low, high + 1) for p in itertools.product(part, repeat=k)}
            run = {x + y for x in run for y in part}
        return whole | run

    return choice()


def gate_words(pattern: str) -> tuple[set[bytes], set[bytes]]:
    """Words that every match of a pattern holds; and where there are none, words of which every
    match holds one."""
    words = [{w.encode() for w in text.split() if OPEN not in w} for text in expansions(pattern)]
    fixed = set.intersection(*words)
    return fixed, set() if fixed or not all(words) else {max(w, key=lambda x: (len(x), x)) for w in words}


def build_rules(families=FAMILIES) -> list[Rule]:
    """All rules, the highest priority first."""
    rules = []
    for family in families:
        for kind, (priority, frame) in FRAMES.items():
            for k, pattern in enumerate(family[SOURCES[kind]]):
                full = frame.format(f"(?:{pattern})") if kind != "name" else pattern
                own, any_of = gate_words(pattern)
                keys = own | ({b"spdx", b"license", b"identifier"} if kind == "spdx" else set())
                if kind == "title":
                    keys = keys | {b"copyright"}
                rules.append(Rule(f"{family[0]}:{kind}{k}", family[0], priority, frozenset(keys), frozenset(any_of), re.compile(f" (?={full} )".encode())))
    return sorted(rules, key=lambda r: (-r.priority, r.name))


class Scanner:
    """Words and detections of texts, as bytes with A-Z lower-cased."""

    #: Bytes between words become spaces.
    TABLE = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))

    def __init__(self, rules: list[Rule] | None = None, base=BASE):
        self.rules = build_rules() if rules is None else rules
        self.base = [(label, re.compile(f" (?={phrase} )".encode()), frozenset(phrase.encode().split())) for label, phrase in base]
        # A rule waits under its rarest-looking keyword, the longest, or under each word of which a
        # match holds one; rules without either are always tried.
        self.waiting: dict[bytes, list[int]] = {}
        self.always = []
        for i, r in enumerate(self.rules):
            words = [max(r.keywords, key=lambda w: (len(w), w))] if r.keywords else r.any_of
            for w in words:
                self.waiting.setdefault(w, []).append(i)
            if not words:
                self.always.append(i)
        self.gate = frozenset(self.waiting)
        self.whole = [re.compile(r.regex.pattern[len(b" (?=") : -len(b" )")] + b"(?= )") for r in self.rules]

    def tried(self, have: set[bytes]) -> list[int]:
        """Rules that a text with these words may match."""
        waiting = {i for w in self.gate & have for i in self.waiting[w]}
        return sorted(i for i in {*self.always, *waiting} if self.rules[i].keywords <= have)

    def scan(self, text: bytes) -> tuple[int, list[tuple[str, int]], list[tuple[str, str, int, int, int]]]:
        """Number of words; base places; detections kept: label, rule, first and last
        word, priority."""
        words = text.lower().translate(self.TABLE).split()
        have = set(words)
        tried = self.tried(have)
        phrases = [(label, regex) for label, regex, keys in self.base if keys <= have]
        if not tried and not phrases:
            return len(words), [], []
        joined = b" " + b" ".join(words) + b" "
        spaces = np.flatnonzero(np.frombuffer(joined, np.uint8) == 0x20)
        base = [(label, int(np.searchsorted(spaces, m.start()))) for label, regex in phrases for m in regex.finditer(joined)]
        found = []
        for i in tried:
            rule = self.rules[i]
            for m in rule.regex.finditer(joined):
                at = m.start() + 1
                end = self.whole[i].match(joined, at).end()
                first, last = np.searchsorted(spaces, (at, end)).tolist()
                found.append((rule.priority, first - 1, last - 1, rule))
        found.sort(key=lambda d: (-d[0], d[1] - d[2], d[1], d[3].name))
        kept, starts, ends = [], [], []  # of the taken that lie in no other taken, in order
        for priority, first, last, rule in found:
            k = bisect.bisect_right(starts, first)
            if k and ends[k - 1] >= last:
                continue
            to = k - (k > 0 and starts[k - 1] == first)
            until = bisect.bisect_right(ends, last, to)
            starts[to:until], ends[to:until] = [first], [last]
            kept.append((rule.label, rule.name, first, last, priority))
        return len(words), sorted(base, key=lambda x: (x[1], x[0])), sorted(kept, key=lambda d: (d[2], d[3], d[1]))


PLACE = T.StructType([T.StructField("label", T.StringType()), T.StructField("word", T.LongType())])
DETECTION = T.StructType([T.StructField("label", T.StringType()), T.StructField("rule", T.StringType()), T.StructField("first", T.LongType()), T.StructField("last", T.LongType()), T.StructField("priority", T.IntegerType())])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_words, base, detections`` for every row."""

    def make():
        scanner = Scanner()
        place = pa.struct([("label", pa.string()), ("word", pa.int64())])
        detection = pa.struct([("label", pa.string()), ("rule", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("priority", pa.int32())])
        d_names = ("label", "rule", "first", "last", "priority")

        def work(texts):
            raw, off = common.flat(texts)
            raw, off = raw.tobytes(), off.tolist()
            got = [scanner.scan(raw[a:b]) for a, b in zip(off, off[1:])]
            return [
                pa.array([g[0] for g in got], pa.int64()),
                pa.array([[{"label": x, "word": y} for x, y in g[1]] for g in got], pa.list_(place)),
                pa.array([[dict(zip(d_names, d)) for d in g[2]] for g in got], pa.list_(detection)),
            ]

        return work

    return common.map_texts(docs, make, [("n_words", T.LongType()), ("base", T.ArrayType(PLACE)), ("detections", T.ArrayType(DETECTION))], id_col, text_col)


def op1_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(common.table(spark, sf_dir, "documents"))
    base, all_labels = F.col("base.label"), F.concat("base.label", "detections.label")
    sure = F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce(F.array_max("detections.priority") / 100.0, F.lit(0.0)))
    return found.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min("base.word").alias("first_word"),
        F.array_max("base.word").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(all_labels)), ",").alias("labels"),
        sure.cast("double").alias("score"),
    )
