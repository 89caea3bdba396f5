"""Licence scan with ordered signature rules, in DataFrame functions alone.

A keyword prefilter finds the words at which rules can match at all. At each of them the rules of
that keyword whose other literal word stands nearby are tried on the words around it. A
detection gives way to another that contains its interval and has a higher priority, or the same
priority and more words. Everything happens within the row, so there is no shuffle, and the work
follows the number of keyword occurrences: each is compared with those within reach alone.

The four base phrases are found as consecutive words, whatever the rules say, and their labels stay.

Defined results: null and empty texts have no words, null word places, empty label strings and a
score of 0. Rows are worked on one by one.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .license_rules import needed_word, rules

#: phrase words, label
BASE = [("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit")]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words around a keyword that rules may look at.
REACH = 20


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def _struct(**columns: Column) -> Column:
    return F.struct(*[c.alias(n) for n, c in columns.items()])


def _starts(words: Column, phrase: str, hits: Column, anchor: str) -> Column:
    """Starts of the phrase, from the places of one of its words."""
    parts = phrase.split()
    at = parts.index(anchor)
    here = F.filter(hits, lambda i: F.get(words, i) == anchor)

    def fits(start: Column) -> Column:
        out = start >= 0
        for k, part in enumerate(parts):
            out = out & F.coalesce(F.get(words, F.greatest(start, F.lit(0)) + k) == part, F.lit(False))
        return out

    return F.filter(F.transform(here, lambda i: i - at), fits)


def _labelled(starts: Column, label: str) -> Column:
    return F.transform(starts, lambda i: _struct(at=i, label=F.lit(label)))


def scan_licenses(docs: DataFrame) -> DataFrame:
    """All columns of `docs` and n_words, n_base, first_word, last_word, base_labels, labels (arrays,
    sorted), matches (array of rule label, priority, start and end word) and score. Columns of `docs`
    with these names are replaced."""
    added = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "matches", "score"]
    docs = docs.drop(*added, "__words", "__hits", "__base", "__found").withColumn("text", F.col("text").cast("string"))
    table = rules()
    keywords = sorted({k for _, _, k, _ in table} | {"license", "cc"})
    # One literal, whatever the number of rules; it is read once a plan.
    listed = {k: [{"priority": p, "label": name, "need": needed_word(word, pattern), "pattern": rf"(?:^| )({pattern})(?= |$)"} for p, name, word, pattern in table if word == k] for k in keywords}
    by_word = F.from_json(F.lit(json.dumps(listed)), "map<string,array<struct<priority:int,label:string,need:string,pattern:string>>>")

    clean = F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER)
    out = docs.withColumn("__words", F.regexp_extract_all(clean, F.lit(f"({WORD})"), F.lit(1)))
    words = F.col("__words")
    out = out.withColumn("n_words", F.size(words).cast("long"))
    out = out.withColumn("__hits", F.array_compact(F.transform(words, lambda w, i: F.when(w.isin(*keywords), i))))
    hits = F.col("__hits")

    starts = [_starts(words, phrase, hits, "cc" if phrase == "cc by" else "license") for phrase, _ in BASE]
    out = out.withColumn("__base", F.concat(*[_labelled(s, name) for s, (_, name) in zip(starts, BASE, strict=True)]))

    def detections(i: Column) -> Column:
        before = F.slice(words, F.greatest(i - REACH, F.lit(0)) + 1, F.least(i, F.lit(REACH)))
        after = F.slice(words, i + 2, F.lit(REACH))
        around = F.concat_ws(" ", before, F.concat(F.lit("@"), F.get(words, i)), after)
        likely = F.filter(F.element_at(by_word, F.get(words, i)), lambda r: F.contains(around, r["need"]))
        tried = F.transform(likely, lambda r: _struct(priority=r["priority"], label=r["label"], match=F.call_function("regexp_extract", around, r["pattern"], F.lit(1))))
        got = F.filter(tried, lambda m: m["match"] != "")

        def placed(m: Column) -> Column:
            start = i - _spaces(F.substring_index(m["match"], "@", 1))
            return _struct(label=m["label"], priority=m["priority"], start=start, end=start + _spaces(m["match"]) + 1)

        return F.transform(got, placed)

    def outranked(d: Column, others: Column) -> Column:
        def wins(e: Column) -> Column:
            more = (e["priority"] > d["priority"]) | ((e["priority"] == d["priority"]) & (e["end"] - e["start"] > d["end"] - d["start"]))
            return (e["start"] <= d["start"]) & (e["end"] >= d["end"]) & more

        return F.exists(others, wins)

    # First within each keyword's own detections, then against those of keywords within reach.
    alone = F.transform(hits, detections)
    out = out.withColumn("__found", F.transform(alone, lambda own: F.filter(own, lambda d: ~outranked(d, own))))
    found = F.col("__found")

    def settled(own: Column, k: Column) -> Column:
        near = F.flatten(F.slice(found, F.greatest(k - 2 * REACH, F.lit(0)) + 1, F.lit(4 * REACH + 1)))
        return F.filter(own, lambda d: ~outranked(d, near))

    out = out.withColumn("matches", F.when(F.size(hits) > 0, F.flatten(F.transform(found, settled))).otherwise(F.array().cast("array<struct<label:string,priority:int,start:int,end:int>>")))
    base = F.col("__base")
    at = F.transform(base, lambda b: b["at"])
    base_labels = F.array_sort(F.array_distinct(F.transform(base, lambda b: b["label"])))
    labels = F.array_sort(F.array_union(base_labels, F.transform("matches", lambda m: m["label"])))
    best = F.coalesce(F.array_max(F.transform("matches", lambda m: m["priority"])), F.lit(0))
    return out.withColumns(
        {
            "n_base": F.size(base).cast("long"),
            "first_word": F.array_min(at).cast("long"),
            "last_word": F.array_max(at).cast("long"),
            "base_labels": base_labels,
            "labels": labels,
            # Certain from priority 60 on; a bare base phrase counts 0.3.
            "score": F.greatest(F.least(best / F.lit(60.0), F.lit(1.0)), F.when(F.size(base) > 0, 0.3).otherwise(0.0)),
        }
    ).drop("__words", "__hits", "__base", "__found")
