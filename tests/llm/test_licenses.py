"""Base phrases against brute force over words; rules, gates and suppression on examples."""

import random
import re

from meterload.llm import licenses as L

SCHEMA = "doc_id long, text string, labels string, score string"


def brute(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    places = [(i, label) for phrase, label in L.BASE for i in range(len(words))
              if words[i:i + len(phrase.split())] == phrase.split()]
    starts = [p[0] for p in places]
    return (len(words), len(places), min(starts, default=None), max(starts, default=None),
            ",".join(sorted({p[1] for p in places})))


def test_there_are_hundreds_of_rules_behind_their_gates():
    assert len(L.rules()) > 300
    for keyword, entries in L._compiled():
        assert len(keyword) > 2 and any(g in keyword for g in L._gates()), entries[0][0]


def test_every_plain_name_is_found():
    for label, names in (L._NAMES | L._MORE_NAMES).items():
        for name in names:
            text = re.sub(r"\[(.)[^\]]*\]", r"\1", re.sub(r"\((?:\?:)((?:[^()|]|\([^()]*\)\?)*)(?:\|[^()]*)?\)(?!\?)", r"\1", name))
            while "(" in text:
                text = re.sub(r"\(\?:[^()]*\)\?", "", text)
            text = re.sub(r"(.)\?", r"\1", text)
            assert re.fullmatch(name, text), (name, text)
            found = {r.label for r, _, _ in L.detections(L.normalise(f"x {text.upper()}, y".encode())[0])}
            assert label in found, (name, text)


def test_base_matches_brute_force(spark):
    rng = random.Random(2)
    bits = ["gnu", "General", "public", "LICENSE", "apache", "license", "cc", "BY", "mit", "mits", "é", "-", "\n", "2.0", "x_y"]
    texts = [None, "", "...", "CC BY cc-by cc_by ccby", "mit license mit license", "Apache LicenseÉ", "x" * 200_000, "cc by " * 20_000]
    texts += [" ".join(rng.choice(bits) for _ in range(rng.randrange(40))) for _ in range(300)]
    df = spark.createDataFrame([(i, t, "l", "s") for i, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: r for r in L.scan_licenses(df).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(t), t[:80] if t else t
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert L.scan_licenses(df.limit(0)).count() == 0


def test_no_rule_stands_twice_and_tables_do_not_share_labels():
    patterns = [(r.label, r.pattern) for r in L.rules()]
    assert len(set(patterns)) == len(patterns) and not set(L._NAMES) & set(L._MORE_NAMES)


def test_keywords_stand_in_every_match():
    """Texts made from each sentence by its first alternatives."""
    for rule in L.rules():
        if rule.named:
            continue
        text, before = rule.pattern, None
        while text != before:
            before = text
            text = re.sub(r"\(\?:\\w\+ \)\{(\d+),\d+\}", lambda m: "word " * int(m.group(1)), text)
            text = re.sub(r"\(\?:((?: \\w\+))\)\{0,\d+\}", "", text)
            text = re.sub(r"\(\?:[^()]*\)\?", "", text)
            text = re.sub(r"\(\?:([^()|]*)(?:\|[^()]*)?\)(?![?{])", r"\1", text)
        text = re.sub(r"\[(.)[^\]]*\]", r"\1", re.sub(r".\?", "", text)).replace(r"\d", "1")
        assert re.fullmatch(rule.pattern, text), (rule.pattern, text)
        assert rule.keyword in text, (rule.keyword, text)
        assert any(r.pattern == rule.pattern for r, _, _ in L.detections(L.normalise(f"a {text} b".encode())[0])), rule.pattern


def test_leads_raise_and_denials_remove():
    def found(text):
        out = L.scan(text.encode())
        return out[4], out[5], out[6]

    assert found("under MPL 2.0") == ("", "mpl-2.0", 0.8)
    assert found("License: MPL 2.0") == ("", "mpl-2.0", 0.85)
    assert found("made available under the terms of the MPL 2.0") == ("", "mpl-2.0", 0.95)
    assert found("SPDX-License-Identifier: MPL-2.0") == ("", "mpl-2.0", 1.0)
    assert found("This is not licensed under the MPL 2.0") == ("", "", 0.0)
    assert found("Not under the MIT license") == ("mit", "mit", 0.0)  # a base label always stays
    assert found("This is not MPL 1.1. It is under the Apache License 2.0") == ("apache", "apache,apache-2.0", 0.8)


def test_priority_and_containment():
    def labels(text):
        return L.scan(text.encode())[5]

    assert labels("Licensed under the Apache License, Version 2.0.") == "apache,apache-2.0"  # base labels stay
    assert labels("under CC BY-NC 4.0.") == "cc-by,cc-by-nc-4.0"
    assert labels("SPDX-License-Identifier: BSD-3-Clause") == "bsd-3-clause"
    assert labels("This is in the public domain") == "public-domain"
    assert labels("GNU Lesser General Public License version 2.1") == "lgpl-2.1"
    n_words, _, _, _, _, _, score, spans = L.scan(b"a b SPDX-License-Identifier: MIT License c")
    assert n_words == 8 and score == 1.0 and [(s["first_word"], s["n_words"]) for s in spans] == [(2, 5)]


def test_resolve_keeps_overlaps_that_are_not_contained():
    low, high = L.Rule("a", "", "", 1, 0.1), L.Rule("b", "", "", 9, 0.9)
    kept = L.resolve([(low, 0, 10), (high, 5, 5000), (low, 6, 9), (low, 4000, 4010), (low, 4999, 5001)])
    assert kept == [(high, 5, 5000), (low, 0, 10), (low, 4999, 5001)]
