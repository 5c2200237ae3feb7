"""No rule of the license scan is turned away by its gate."""

import itertools
import re

from hexalloc.llm import licenses


def spelled(tree):
    """All strings of a parsed regex of literals, classes, alternatives and repeats."""
    out = {""}
    for op, arg in tree:
        kind = str(op)
        if kind == "LITERAL":
            part = {chr(arg)}
        elif kind == "IN":
            part = {chr(c) for k, a in arg for c in ([a] if str(k) == "LITERAL" else range(a[0], a[1] + 1) if str(k) == "RANGE" else b"7")}
        elif kind == "MAX_REPEAT":
            low, high, inner = arg
            few = {min(max(low, 1), high), low, min(int(high), max(low, 4))}  # of an open run, some lengths
            part = {"".join(p) for k in few for p in itertools.product(spelled(inner), repeat=k)}
        elif kind == "BRANCH":
            part = set().union(*(spelled(x) for x in arg[1]))
        else:
            part = spelled(arg[-1])  # a group, or what is looked ahead for
        out = {x + y for x in out for y in part}
    return out


def test_every_license_spelling_passes_its_gate():
    s = licenses.Scanner()
    for i, rule in enumerate(s.rules):
        for text in spelled(re._parser.parse(rule.regex.pattern.decode())):
            assert rule.regex.match(text.encode()), (rule.name, text)
            have = set(text.encode().split())
            assert i in s.tried(have), (rule.name, text)


def test_license_one_word_spellings():
    s = licenses.Scanner()
    labels = lambda t: {d[0] for d in s.scan(t.encode())[2]}
    assert labels("Creative Commons Attribution-ShareAlike 4.0 International") == {"cc-by-sa"}
    assert labels("Creative Commons Attribution-NonCommercial 3.0 Unported") == {"cc-by-nc"}
    assert labels("Creative Commons Attribution-NoDerivs") == labels("Creative Commons Attribution-NoDerivatives") == {"cc-by-nd"}
    assert labels("Creative Commons Attribution-NonCommercial-ShareAlike 4.0") == {"cc-by-nc-sa"}
    assert labels("under the Creative Commons Attribution-NonCommercial-NoDerivatives") == {"cc-by-nc-nd"}
    assert labels("CC0") == labels("CC0 1.0") == labels("CC0 1.0 Universal") == {"cc0"}
    assert labels("GPLv2") == labels("GPL v2") == labels("GNU GPL version 2") == {"gpl-2"}
