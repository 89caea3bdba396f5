import re

from sightline.llm.license_rules import needed_word, rules
from sightline.llm.license_texts import wording
from sightline.llm.license_scan import REACH, scan_licenses

from .cases import empty_table, odd_rows, odd_table

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
TABLE = rules()
TEXTS = [
    "Licensed under CC BY-NC 4.0.", "This is released under the Apache License, Version 2.0. Apache-2.0", "GNU Lesser General Public License v2.1 or later", "All rights reserved. SPDX-License-Identifier: MPL-2.0",
    "mit license MIT LICENSE cc by cc-by cc by sa", "license", "the BSD 3-Clause license; the 3-clause BSD license", "Creative Commons Attribution-ShareAlike 3.0", "gnu gnu general public license license", "mit\nlicense" * 60,
]


def brute(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    starts, labels = [], set()
    for phrase, label in BASE.items():
        p = phrase.split()
        found = [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
        starts += found
        labels |= {label} if found else set()
    dets = []
    for i, word in enumerate(w):
        around = " ".join([*w[max(0, i - REACH) : i], "@" + word, *w[i + 1 : i + 1 + REACH]])
        for priority, label, keyword, pattern in TABLE:
            if keyword == word and (m := re.search(rf"(?:^| )({pattern})(?= |$)", around)):
                start = i - m[1].split("@")[0].count(" ")
                dets.append((label, priority, start, start + m[1].count(" ") + 1))
    wins = lambda e, d: e[2] <= d[2] and e[3] >= d[3] and (e[1] > d[1] or (e[1] == d[1] and e[3] - e[2] > d[3] - d[2]))
    left = {d for d in dets if not any(wins(e, d) for e in dets)}
    return len(w), len(starts), min(starts, default=None), max(starts, default=None), sorted(labels), sorted(labels | {d[0] for d in left})


def test_rules_are_many_and_sound():
    assert len(TABLE) > 900
    for _, _, keyword, pattern in TABLE:
        re.compile(pattern)
        assert pattern.count("@") == 1 and f"@{keyword}" in pattern and needed_word(keyword, pattern)


def test_as_brute_force(spark):
    rows = odd_rows() + [(100 + i, t) for i, t in enumerate(TEXTS)]
    text = {i: t for i, t in rows}
    done = scan_licenses(odd_table(spark, rows))
    for r in done.collect():
        if r.doc_id is not None:
            assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) == brute(text[r.doc_id]), r.text
        assert 0 <= r.score <= 1 and (r.score > 0) == bool(r.labels)


def test_native_and_empty(spark):
    done = scan_licenses(odd_table(spark))
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
    assert scan_licenses(empty_table(spark)).count() == 0


def sample(pattern):
    """A text that the pattern means."""
    out = re.sub(r"\(\?:\[\^ \]\+ \)\{(\d),\d\}", lambda m: "word " * int(m[1]), pattern)
    while (flat := re.sub(r"\(\?:([^()|]*)(?:\|[^()]*)?\)(\??)", lambda m: "" if m[2] else m[1], out)) != out:
        out = flat
    out = out.replace("[^ ]+", "word").replace("[0-9]+", "7").replace("[1-4]", "4").replace("[05]", "0")
    return re.sub(r".\?", "", re.sub(r"\.\{0,\d+\}", "", out)).strip()


def test_each_wording_is_found_and_without_a_word_is_not(spark):
    lines = wording()
    assert len(lines) > 170
    texts = []
    for _, label, keyword, pattern in lines:
        words = sample(pattern).split(" ")
        at = next(i for i, w in enumerate(words) if w.startswith("@"))
        assert max(at, len(words) - at - 1) <= REACH and words[at] == f"@{keyword}", pattern
        near = at - 1 if at else at + 1
        bent = [*words[:near], "zzz", *words[near + 1 :]]
        rule = re.compile(rf"(?:^| )({pattern})(?= |$)")
        assert rule.search(" ".join(words)) and not rule.search(" ".join(bent)), pattern
        assert needed_word(keyword, pattern) in " ".join(words), pattern
        texts.append("So: " + " ".join(words).replace("@", "").upper() + ".")
    done = scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    for r in done.collect():
        priority, label, _, pattern = lines[r.doc_id]
        best = max((m.priority for m in r.matches), default=0)
        assert label in r.labels or best > priority or any(m.label != label and m.priority >= priority and m.end - m.start >= len(sample(pattern).split()) for m in r.matches), (label, r.labels)
