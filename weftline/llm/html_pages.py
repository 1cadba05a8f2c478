"""Labelled pages for the extraction model, written from templates by a seeded generator.

Each call of page() gives html and, for its block elements in document order,
whether they are content: the supervision that the model is fitted to.
"""

from __future__ import annotations

import random

WORDS = "time year people way day man thing woman life child world school state family student group country problem hand part place case week company system program question work number night point home water room mother area money story fact month lot right study book eye job word business issue side kind head house service friend father power hour game line end member law car city".split()
CONTENT = [("article", ""), ("main", ""), ("div", "content"), ("div", "post-body"), ("section", "entry-content"), ("div", "story article-text"), ("div", "main-content"), ("article", "post"), ("div", "")]
OUTSIDE = [
    ("nav", ""), ("nav", "navbar"), ("div", "menu"), ("ul", "menu nav-list"), ("header", ""), ("header", "site-header"), ("div", "header top-bar"), ("footer", ""), ("footer", "site-footer"), ("div", "footer"), ("div", "copyright"),
    ("aside", ""), ("aside", "sidebar"), ("div", "sidebar widget"), ("div", "ad"), ("div", "ads advert"), ("div", "banner ad-slot"), ("section", "sponsored promo"), ("div", "cookie-notice"), ("div", "consent banner"), ("div", "notice alert"), ("div", "popup modal"),
    ("form", ""), ("form", "newsletter subscribe"), ("form", "search login"), ("section", "comments"), ("div", "comment-list"), ("ol", "comments"), ("div", "related"), ("div", "share social"), ("div", "breadcrumb"), ("div", "disqus comments"), ("div", "pagination"),
]
INSIDE = [x for x in OUTSIDE if x[0] not in ("header",)]


class Page:
    def __init__(self, seed: int):
        self.rng, self.html, self.labels = random.Random(seed), [], []

    def words(self, low: int, high: int) -> str:
        n = self.rng.randint(low, high)
        out = " ".join(self.rng.choice(WORDS) for _ in range(n))
        return out.capitalize() + self.rng.choice([".", ".", ""])

    def open(self, tag: str, name: str, label: int) -> None:
        key = "id" if name and self.rng.random() < 0.25 else "class"
        self.html.append(f'<{tag} {key}="{name}">' if name else f"<{tag}>")
        self.labels.append(label)

    def block(self, tag: str, text: str, label: int) -> None:
        self.open(tag, "", label)
        self.html.append(f"{text}</{tag}>")

    def paragraphs(self, n: int, label: int) -> None:
        for _ in range(n):
            self.block(self.rng.choice(["p", "p", "p", "p", "h2", "blockquote"]), self.words(*self.rng.choice([(1, 4), (5, 30), (20, 90)])), label)

    def outside(self, tag: str, name: str) -> None:
        if name and tag in ("div", "section", "aside"):
            tag = self.rng.choice(["div", "section", "aside", tag])
        self.open(tag, name, 0)
        kind = self.rng.random()
        if tag in ("ul", "ol") or kind < 0.3:
            if tag not in ("ul", "ol"):
                self.open("ul", "", 0)
            for _ in range(self.rng.randint(2, 6)):
                self.open("li", "", 0)
                text = self.words(1, 3) if "comment" not in name else self.words(4, 30)
                self.html.append((f'<a href="/x">{text}</a>' if "comment" not in name else text) + "</li>")
            if tag not in ("ul", "ol"):
                self.html.append("</ul>")
        elif kind < 0.5:
            self.html.append(self.words(2, 25))
        else:
            for _ in range(self.rng.randint(1, 3)):
                self.block(self.rng.choice(["p", "div", "h3"]), self.words(2, 35), 0)
        self.html.append(f"</{tag}>")

    def around(self) -> None:
        for x in self.rng.sample(OUTSIDE, self.rng.randint(1, 4)):
            self.outside(*x)

    def loose(self) -> None:
        """Text in the body itself, with inline elements: an article's, or a row of links."""
        if self.rng.random() < 0.6:
            self.labels.append(0)
            self.html.append(" | ".join(f'<a href="/x">{self.words(1, 2)}</a>' for _ in range(self.rng.randint(2, 6))) + "<hr>")
        for _ in range(self.rng.randint(1, 3)):
            self.labels.append(1)
            self.html.append(f"{self.words(4, 60)}<br>{self.words(3, 40)} <b>{self.words(1, 3)}</b><hr>")

    def build(self) -> tuple[str, list[int]]:
        r = self.rng
        self.html.append("<html><body>")
        wrap = r.random() < 0.3
        if wrap:
            self.open("div", r.choice(["wrapper", "page", "container", ""]), 0)
        self.around()
        if r.random() < 0.75:
            tag, name = r.choice(CONTENT)
            self.open(tag, name, 1)
            if r.random() < 0.8:
                self.block("h1", self.words(2, 12), 1)
            for _ in range(r.randint(1, 3)):
                self.paragraphs(r.randint(1, 5), 1)
                for _ in range(r.choice([0, 0, 1, 1, 2])):
                    self.outside(*r.choice(INSIDE))
                if r.random() < 0.25:
                    self.open("ul", "", 1)
                    for _ in range(r.randint(2, 4)):
                        self.block("li", self.words(2, 15), 1)
                    self.html.append("</ul>")
                if r.random() < 0.15:
                    self.open(r.choice(["div", "section"]), "", 1)
                    self.paragraphs(2, 1)
                    self.html.append(f"</{self._last_wrapper()}>")
            self.html.append(f"</{tag}>")
        else:
            if r.random() < 0.7:
                self.block("h1", self.words(2, 10), 1)
            if r.random() < 0.7 and not wrap:
                self.loose()
            self.paragraphs(r.randint(2, 6), 1)
        self.around()
        if wrap:
            self.html.append("</div>")
        self.html.append("</body></html>")
        return "".join(self.html), self.labels

    def _last_wrapper(self) -> str:
        return next(h[1:-1] for h in reversed(self.html) if h in ("<div>", "<section>"))


def page(seed: int) -> tuple[str, list[int]]:
    """html, and the labels of its elements below body (blocks, and loose runs of text) in document order."""
    return Page(seed).build()
