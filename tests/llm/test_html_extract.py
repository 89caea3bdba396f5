"""Blocks of pages against a reader that goes letter by letter, and the labeller on top of them."""

import random
import string
import time
from zlib import crc32

import numpy as np
import pytest

from sightline.llm.html_extract import RAW, TRAIN_PAGES, WEIGHTS, Labeller, extract_text, leaf_blocks, lexed, placed_labels, trained
from sightline.llm.page_generator import pages


@pytest.fixture(scope="module")
def labeller():
    return Labeller(train_pages=400, epochs=6)


def accuracy(model, seed, n=150):
    right = total = 0
    for page, labels in pages(n, seed=seed):
        blocks = leaf_blocks(page)
        p = model.label([blocks])[0]
        total += len(blocks)
        right += int(((p >= 0.5) == (placed_labels(blocks, labels) > 0.5)).sum())
    return right / total


def test_pages_of_unseen_layouts(labeller):
    assert accuracy(labeller, 78) > 0.96


def test_the_kept_weights_are_a_trained_labeller():
    assert accuracy(trained(), 79) > 0.985
    assert WEIGHTS.stat().st_size < 300_000 and TRAIN_PAGES == 2500


PAGE = """<!DOCTYPE html><html><head><title>no</title><script>var t="</p>";x(1)</script></head><body><nav><ul><li><a href="/a">Menu</a></li></ul></nav>
<div class="ad">Buy now</div><article><h1>A  title &amp; more</h1><p><b>First line of
text.<br><p>Second &lt;one&gt; a < b.</p><!-- <p>hidden</p> --><p>Third</article><section class="comments"><p>Great post, thanks a lot for all of this!</p></section><footer>&copy; host</footer></body></html>"""


def test_one_page(labeller):
    assert labeller.texts([PAGE]) == ["A title & more First line of text. Second <one> a < b. Third"]
    assert trained().texts([PAGE]) == labeller.texts([PAGE])


def test_page_table(spark):
    rows = [(1, "u", PAGE), (2, "u", None), (3, None, ""), (4, "u", "<p"), (None, "u", "plain < words & no markup"), (5, "u", PAGE), (6, "u", "<div>" * 3000 + "deep"), (7, "u", "<p class='x>unclosed quote")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'clash' as text")
    out = extract_text(df).collect()
    assert len(out) == len(rows) and all(r.text is not None for r in out)
    assert [r.text for r in out if r.page_id in (2, 3)] == ["", ""]
    assert len({r.text for r in out if r.page_id in (1, 5)}) == 1
    assert extract_text(df.where("false")).count() == 0


def test_words_in_the_middle_of_a_block_are_read(labeller):
    ends = "one two three four five six", "seven eight nine ten eleven twelve"
    a, b = (f"{ends[0]} {m} {ends[1]}" for m in ("cookies sponsored reply", "gardens blossomed early"))
    x, _ = labeller.reader.vectors([[(("tag:p",), t, 0, 1)] for t in (a, b)])
    base = len(labeller.reader.tokens)
    assert not np.allclose(x[0], x[1])
    want = np.bincount([crc32(w.encode()) % 48 for w in a.split()], minlength=48) / len(a.split()) ** 0.5
    assert np.allclose(x[0, base : base + 48], want)


def test_a_text_in_two_places_has_a_label_for_each():
    blocks = leaf_blocks("<nav><p>same</p></nav><article><p>same</p><p>other</p></article>")
    assert placed_labels(blocks, [("same", 0), ("same", 1), ("other", 1)]).tolist() == [0, 1, 1]


SCRIPTS = ["for(var i=0;i<n;i++){x(i)}", "if(a<b)c('</p>')", 'x="<!--"', "<!-- a --> b<c", "'unclosed", "</scriptx><p>no"]


@pytest.mark.parametrize("script", SCRIPTS)
def test_raw_content_hides_itself_alone(script):
    for tag in sorted(RAW):
        assert [b[1] for b in leaf_blocks(f"<p>one</p><{tag} a='>'>{script}</{tag.upper()}><p>two</p>")] == ["one", "two"]
    assert [b[1] for b in leaf_blocks(f"<p>one</p><script>{script}")] == ["one"]


BROKEN = ["<a ", '<a href="x ', "<a b='", "<b>", "<div>x", "<", "<!--", "</b", "<b><p>x", "<script>", "&", "<i><div>", "<a x=\"'>", "<td><th>", "</i>", "<p"]


@pytest.mark.parametrize("piece", BROKEN)
def test_broken_pages_take_time_by_their_length(piece):
    def took(size):
        page = piece * (size // len(piece)) + "</i>" * 10_000
        began = time.process_time()
        leaf_blocks(page, {"tag:div": 0, "tag:p": 1})
        return time.process_time() - began

    took(100_000)
    assert took(1_000_000) < 12


def plainly(page):
    """The same lexing, letter by letter."""
    out, i, quotes = [], 0, True

    def tag_end(start, with_quotes):
        j = start
        while j < len(page) and page[j] != ">":
            if with_quotes and page[j] == "=":
                j += 1
                while j < len(page) and page[j] in string.whitespace:
                    j += 1
                if j < len(page) and page[j] in "\"'" and page[j] in page[j + 1 :]:
                    j = page.index(page[j], j + 1) + 1
                continue
            j += 1
        return j if j < len(page) else None

    def text(t):
        if out and out[-1][0] == "text":
            out[-1] = ("text", out[-1][1] + t)
        else:
            out.append(("text", t))

    while i < len(page):
        rest = page[i:]
        slash = rest.startswith("</")
        if rest[0] == "<" and rest[1 + slash : 2 + slash] and rest[1 + slash] in string.ascii_letters:
            if ">" not in rest:
                if "<" not in rest[1:]:
                    break
                i = page.index("<", i + 1)
                continue
            j = i + 1 + slash
            while page[j] not in string.whitespace + "/>":
                j += 1
            name = page[i + 1 + slash : j].lower()
            end = tag_end(j, quotes)
            if end is None:
                quotes = False
                end = tag_end(j, False)
            out.append(("</" if slash else "<", name))
            closed_itself = page[j:end].endswith("/")
            i = end + 1
            if not slash and name in RAW and not closed_itself:
                low = page.lower()
                while i < len(page) and not (low.startswith("</" + name, i) and low[i + 2 + len(name) : i + 3 + len(name)] and low[i + 2 + len(name)] in string.whitespace + "/>"):
                    i += 1
        elif rest.startswith("<!--"):
            ends = [e for e in (page.find("-->", i + 2), page.find("--!>", i + 2)) if e >= 0]
            if not ends:
                break
            e = min(ends)
            i = e + (3 if page.startswith("-->", e) else 4)
        elif rest[0] == "<" and rest[1:2] and rest[1] in "!?/" and len(rest) > 2:
            if ">" not in rest[2:]:
                break
            i = page.index(">", i + 2) + 1
        else:
            text(rest[0])
            i += 1
    return out


def merged(page):
    out = []
    for slash, tag, rest in lexed(page):
        if tag:
            out.append(("</" if slash else "<", tag))
        elif out and out[-1][0] == "text":
            out[-1] = ("text", out[-1][1] + rest)
        else:
            out.append(("text", rest))
    return out


def test_lexing_against_a_plain_reader():
    rng = random.Random(5)
    pieces = ["<", ">", "/", "a", "<p", "<p>", "</p>", "<a href=", '"', "'", "=", " ", "\n", "<!--", "-->", "--!>", "<!", "<?", "</", "<script>", "</script>", "</SCRIPT ", "<style x='>'>", "</style>", "text", "i<n", "<br/>", "<title/>", "-", "!", "&lt;"]
    for _ in range(20_000):
        page = "".join(rng.choice(pieces) for _ in range(rng.randint(1, 14)))
        assert merged(page) == plainly(page), page
