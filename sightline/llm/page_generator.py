"""Made-up web pages with a label for every block, to train the block labeller on.

Words are invented; layouts vary in elements, class names, order, nesting and in how carelessly
they are closed. Everything follows from the seed.
"""

from __future__ import annotations

import random

SYLLABLES = "ba ce di fo gu ha je ki lo mu na pe ri so tu va we xi yo za schi tion lle ente ung ado ère öst nd ly".split()
MENU = "home about contact news sports login register sitemap privacy terms archive search help shop blog careers products services more next previous".split()
BLURB = {
    "ad": "sponsored advertisement buy now save offer sale shop discount free trial click here promo",
    "notice": "we use cookies accept consent privacy policy this site settings subscribe newsletter sign up notice",
    "comments": "reply says commented posted by user ago like report comment great thanks agree",
    "share": "share tweet facebook email print pin copy link",
    "related": "related posts you may also like read more popular trending recommended",
    "footer": "copyright all rights reserved terms privacy contact imprint powered by",
    "form": "name email message submit send search password subscribe",
}
NAMES = {
    "ad": ["ad", "ads", "advert", "advertisement", "banner", "sponsor", "promo", "adsbox"],
    "notice": ["cookie", "cookies", "consent", "notice", "alert", "banner", "gdpr", "popup", "newsletter", "warning", "message"],
    "comments": ["comments", "comment", "commentlist", "respond", "discussion", "replies", "reader", "reviews"],
    "share": ["share", "social", "sharing", "buttons", "tools", "meta", "byline", "tags"],
    "related": ["related", "recommended", "popular", "more", "widget", "trending"],
    "sidebar": ["sidebar", "side", "aside", "widget", "right", "left", "rail", "column", "secondary"],
    "header": ["header", "masthead", "top", "topbar", "branding", "logo", "site", "head"],
    "nav": ["nav", "menu", "navbar", "navigation", "breadcrumb", "breadcrumbs", "links", "pagination"],
    "footer": ["footer", "foot", "bottom", "colophon", "copyright", "legal"],
    "main": ["content", "article", "post", "entry", "story", "main", "body", "text", "page", "article-body", "post-content", "entry-content"],
}


class Maker:
    def __init__(self, seed: int):
        self.rng = random.Random(seed)
        self.out: list[str] = []
        self.label: list[tuple[str, int]] = []

    def words(self, n: int, of: str = "", share: float = 0.0) -> str:
        rng, pool = self.rng, of.split()
        made = [rng.choice(pool) if pool and rng.random() < share else "".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(n)]
        return " ".join(made)

    def sentences(self, n: int) -> str:
        return " ".join(self.words(self.rng.randint(3, 22)).capitalize() + self.rng.choice([".", ".", ".", "!", "?"]) for _ in range(n))

    def names(self, kind: str) -> str:
        rng = self.rng
        if rng.random() < 0.15:
            return ""
        name = rng.choice(NAMES[kind])
        if rng.random() < 0.3:
            name += rng.choice(["-", "_", " "]) + rng.choice(["box", "area", "wrapper", "inner", "1", "list", "section"])
        return f' {rng.choice(["class", "class", "class", "id"])}="{name}"'

    def leaf(self, tag: str, text: str, good: int, attributes: str = "") -> None:
        rng = self.rng
        self.label.append((text, good))
        shown = text
        if good and rng.random() < 0.15:
            parts = text.split(" ")
            i = rng.randrange(len(parts))
            parts[i] = rng.choice(["<b>{}</b>", "<i>{}</i>", '<a href="#">{}</a>', "<em>{}</em>", "<b>{}"]).format(parts[i])
            shown = " ".join(parts)
        end = "" if tag in ("p", "li") and rng.random() < 0.15 else f"</{tag}>"
        self.out.append(f"<{tag}{attributes}>{shown}{end}")

    def menu(self, kind: str = "nav") -> None:
        rng = self.rng
        tag = rng.choice(["nav", "nav", "div", "ul"])
        self.out.append(f"<{tag}{self.names(kind)}>")
        self.out.append("<ul>" if tag != "ul" else "")
        for _ in range(rng.randint(2, 9)):
            text = self.words(rng.randint(1, 3), " ".join(MENU), 0.5)
            self.label.append((text, 0))
            self.out.append(f'<li><a href="/{rng.randint(0, 99)}">{text}</a></li>')
        self.out.append(("</ul>" if tag != "ul" else "") + f"</{tag}>")

    def box(self, kind: str, tags: list[str], blocks: tuple[int, int] = (1, 3)) -> None:
        rng = self.rng
        tag = rng.choice(tags)
        names = self.names(kind) if tag in ("div", "section", "ul", "p", "span") or rng.random() < 0.6 else ""
        if rng.random() < 0.3:  # a leaf of its own
            tag = tag if tag in ("div", "aside", "section", "footer") else "div"
            self.leaf(tag, self.words(rng.randint(2, 20), BLURB.get(kind, ""), 0.3), 0, names)
            return
        self.out.append(f"<{tag}{names}>")
        share = rng.choice([0, 0.2, 0.5])
        if rng.random() < 0.4:
            self.leaf(rng.choice(["h2", "h3", "h4"]), self.words(rng.randint(1, 6), BLURB.get(kind, ""), share), 0)
        shape = rng.choice(["flat", "list", "nested"])
        outer = rng.choice(["ul", "ol"])
        self.out.append(f"<{outer}>" if shape == "list" else "")
        for _ in range(rng.randint(*blocks)):
            long = kind == "comments" and rng.random() < 0.7 or rng.random() < 0.15
            text = self.sentences(rng.randint(1, 5)) if long and share < 0.5 else self.words(rng.randint(6, 60) if long else rng.randint(1, 18), BLURB.get(kind, ""), share)
            if shape == "nested":
                self.out.append(f"<div{self.names(kind)}>")
            self.leaf("li" if shape == "list" else rng.choice(["p", "p", "div", "h3"]), text, 0)
            self.out.append("</div>" if shape == "nested" else "")
        self.out.append((f"</{outer}>" if shape == "list" else "") + f"</{tag}>")

    def form(self) -> None:
        text = self.words(self.rng.randint(1, 6), BLURB["form"], 0.5)
        self.label.append((text, 0))
        self.out.append(f'<form{self.names("notice") if self.rng.random() < 0.3 else ""}><label>{text}</label><input type="text"></form>')

    def main(self) -> None:
        rng = self.rng
        kind = rng.choice(["article", "article", "article", "main", "div", "div", "section"])
        attributes = self.names("main") if kind == "div" or rng.random() < 0.3 else ""
        self.out.append(f"<{kind}{attributes}>")
        wrap = rng.random() < 0.3
        if wrap:
            self.out.append(f"<div{self.names('main')}>")
        head = rng.random() < 0.2
        if rng.random() < 0.85:
            self.out.append("<header>" if head else "")
            self.leaf(rng.choice(["h1", "h1", "h2"]), self.words(rng.randint(1, 14)).capitalize() + rng.choice(["", "."]), 1)
            self.out.append("</header>" if head else "")
        if rng.random() < 0.2:
            self.box("share", ["div", "ul"], (1, 2))
        for i in range(rng.choice([1, 2, 3, 5, 8, 12, 20])):
            draw = rng.random()
            if draw < 0.08:
                self.leaf(rng.choice(["h2", "h3"]), self.words(rng.randint(1, 8)).capitalize(), 1)
            elif draw < 0.14:
                self.out.append("<ul>")
                for _ in range(rng.randint(2, 5)):
                    self.leaf("li", self.words(rng.randint(1, 15)), 1)
                self.out.append("</ul>")
            elif draw < 0.18:
                self.leaf("blockquote", self.sentences(1), 1)
            elif draw < 0.24 and i:
                self.box(rng.choice(["ad", "share", "related"]), ["div", "aside"], (1, 1))
            elif draw < 0.28:
                self.out.append(f"<figure><img src=x>")
                self.leaf("figcaption", self.words(rng.randint(2, 10)), 1)
                self.out.append("</figure>")
            else:
                text = self.words(rng.randint(1, 3)).capitalize() + "." if rng.random() < 0.12 else self.sentences(rng.randint(1, 7))
                self.leaf(rng.choice(["p", "p", "p", "p", "div"]), text, 1)
        if rng.random() < 0.2:
            self.box("share", ["div", "ul", "footer"], (1, 2))
        if rng.random() < 0.15:
            self.box("comments", ["section", "div"], (1, 6))
        self.out.append(("</div>" if wrap else "") + f"</{kind}>")

    def page(self) -> tuple[str, list[tuple[str, int]]]:
        rng = self.rng
        self.out.append('<!DOCTYPE html><html><head><meta charset="utf-8"><title>x</title><style>p{}</style></head><body>')
        before = [lambda: self.menu(), lambda: self.box("header", ["header", "header", "div"], (1, 2)), lambda: self.box("ad", ["div"], (1, 1)), lambda: self.box("notice", ["div", "section"], (1, 2)), lambda: self.form(), lambda: self.box("sidebar", ["aside", "div"], (1, 5))]
        for f in rng.sample(before, rng.randint(0, 4)):
            f()
        if rng.random() < 0.97:
            self.main()
        after = [lambda: self.box("related", ["div", "aside", "section"], (1, 5)), lambda: self.box("comments", ["section", "div", "div"], (1, 8)), lambda: self.form(), lambda: self.box("ad", ["div", "aside"], (1, 1)), lambda: self.box("sidebar", ["aside", "div"], (1, 6)), lambda: self.menu("footer"), lambda: self.box("notice", ["div"], (1, 2))]
        for f in rng.sample(after, rng.randint(0, 4)):
            f()
        if rng.random() < 0.8:
            self.box("footer", ["footer", "footer", "div"], (1, 3))
        self.out.append("</body></html>")
        return "".join(self.out), self.label


def pages(n: int, seed: int = 11):
    """(html, [(block text, 1 if main text)]) of n pages."""
    for i in range(n):
        yield Maker(seed * 1_000_003 + i).page()
