"""Labelled training pages, made by rule: layouts, element names and text lengths vary, every leaf block has a label.

Words are invented syllables, so that nothing is learned from wording. Label 1 is the article: its headings, paragraphs,
lists, quotes, tables, captions and code. Label 0 is everything around and between.
"""

from __future__ import annotations

import random

_SYLLABLES = "ba de ki lo mu ra se ti vo zu an el in or un".split()
#: Kinds of surrounding parts: possible tags, attribute words, and how their blocks look.
PARTS = {
    "menu": (["nav", "div", "ul", "section", "header"], ["nav", "menu", "navbar", "navigation", "main-menu", "topnav", "breadcrumb", "breadcrumbs", "links", "tabs", ""], "links"),
    "header": (["header", "div"], ["header", "masthead", "top", "branding", "banner", "site-header", "logo", "title-bar"], "short"),
    "footer": (["footer", "div"], ["footer", "site-footer", "bottom", "copyright", "legal", "colophon", "credits"], "footer"),
    "sidebar": (["aside", "div", "section"], ["sidebar", "widget", "related", "recommended", "popular", "trending", "rail", "more-stories", "side", "right-column", "tags"], "mixed"),
    "notice": (["div", "section", "aside", "dialog"], ["notice", "cookie-banner", "consent", "alert", "gdpr", "warning", "disclaimer", "popup", "modal", "overlay", "paywall", "newsletter", "subscribe", "message", "privacy"], "prose"),
    "advert": (["div", "aside", "section"], ["ad", "ads", "advert", "advertisement", "sponsored", "promo", "sponsor", "adsbox", "commercial", "banner-ad", "promotion"], "prose"),
    "form": (["form", "div"], ["form", "search", "login", "signup", "contact-form", "newsletter-form", "searchbox", ""], "form"),
    "comments": (["section", "div", "ol", "aside"], ["comments", "comment", "comment-list", "reader-comments", "responses", "replies", "discussion", "disqus", "respond", "feedback", "reviews"], "comments"),
    "share": (["div", "ul", "section"], ["share", "social", "sharing", "follow", "share-buttons", "toolbar", "tools"], "links"),
    "pager": (["div", "nav", "ul"], ["pagination", "pager", "prev-next", "page-links"], "links"),
}
CONTAINERS = [("article", ""), ("article", "post"), ("main", ""), ("main", "content"), ("div", "content"), ("div", "article-body"),
              ("div", "post-content"), ("div", "entry-content"), ("div", "story"), ("section", "article"), ("div", "main"), ("div", "text"),
              ("div", "page"), ("div", "body-copy"), ("div", "")]


class _Page:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.html: list[str] = []
        self.labels: list[int] = []

    def word(self) -> str:
        return "".join(self.r.choice(_SYLLABLES) for _ in range(self.r.randint(1, 4)))

    def words(self, lo: int, hi: int) -> str:
        return " ".join(self.word() for _ in range(self.r.randint(lo, hi)))

    def sentence(self, lo: int, hi: int) -> str:
        return self.words(lo, hi).capitalize() + self.r.choice([".", ".", ".", "!", "?", "&amp;", ""])

    def prose(self, sentences: int) -> str:
        return " ".join(self.sentence(3, 18) for _ in range(sentences))

    def block(self, tag: str, text: str, label: int, close: bool = True) -> None:
        self.html.append(f"<{tag}>{text}" + (f"</{tag.split()[0]}>" if close else ""))
        self.labels.append(label)

    def link(self, lo: int = 1, hi: int = 3) -> str:
        return f'<a href="/{self.word()}">{self.words(lo, hi)}</a>'

    def named(self, tag: str, names: str) -> str:
        if not names:
            return tag
        return f'{tag} {self.r.choice(["class", "class", "id"])}="{names}"'

    def part(self, kind: str) -> None:
        tags, names, look = PARTS[kind]
        tag = self.r.choice(tags)
        name = self.r.choice(names)
        if not name and tag in ("div", "section", "ul"):
            name = names[0]
        self.html.append(f"<{self.named(tag, name)}>")
        if look == "links":
            if tag == "ul" or self.r.random() < 0.6:
                if tag != "ul":
                    self.html.append("<ul>")
                for _ in range(self.r.randint(2, 7)):
                    self.block("li", self.link(), 0)
                if tag != "ul":
                    self.html.append("</ul>")
            else:
                self.html.append(" ".join(self.link() for _ in range(self.r.randint(2, 6))))
                self.labels.append(0)
        elif look == "short":
            self.block(self.r.choice(["h1", "div", "p", "span"]) if self.r.random() < 0.7 else "h2", self.words(1, 4), 0)
            if self.html[-1].startswith("<span"):
                self.block("p", self.words(1, 5), 0)
        elif look == "footer":
            if self.r.random() < 0.5:
                self.block("p", f"&copy; {self.word()}.example &middot; {self.sentence(3, 12)}", 0)
            else:
                self.html.append(f"&copy; {self.word()}.example.com &middot; {self.sentence(2, 10)}")
                self.labels.append(0)
            if self.r.random() < 0.4:
                self.block("div", " | ".join(self.link() for _ in range(3)), 0)
        elif look == "mixed":
            self.block(self.r.choice(["h2", "h3", "h4"]), self.words(1, 4), 0)
            for _ in range(self.r.randint(1, 5)):
                if self.r.random() < 0.6:
                    self.block("li", self.link(3, 9), 0)
                else:
                    self.block("p", self.prose(self.r.randint(1, 3)), 0)
        elif look == "prose":
            if self.r.random() < 0.5:
                self.html.append(self.prose(self.r.randint(1, 3)))
                self.labels.append(0)
            else:
                for _ in range(self.r.randint(1, 2)):
                    self.block("p", self.prose(self.r.randint(1, 4)), 0)
                if self.r.random() < 0.4:
                    self.block("button", self.words(1, 2), 0)
        elif look == "form":
            for _ in range(self.r.randint(1, 3)):
                self.block("label", self.words(1, 3), 0)
                self.html.append("<input name=q>")
            if self.r.random() < 0.4:
                self.block("p", self.prose(1), 0)
            self.block("button", self.words(1, 2), 0)
        else:
            if self.r.random() < 0.7:
                self.block(self.r.choice(["h2", "h3"]), self.words(1, 3), 0)
            for _ in range(self.r.randint(1, 5)):
                self.html.append(f'<{self.r.choice(["div", "li"])} class="{self.r.choice(["comment", "comment-body", "reply", "response", "review", ""])}">')
                if self.r.random() < 0.6:
                    self.block("div", self.words(1, 3), 0)
                for _ in range(self.r.randint(1, 2)):
                    self.block("p", self.prose(self.r.randint(1, 5)), 0)
                self.html.append("</div></li>")
        self.html.append(f"</{tag}>")

    def article(self) -> None:
        tag, name = self.r.choice(CONTAINERS)
        self.html.append(f"<{self.named(tag, name)}>")
        if self.r.random() < 0.8:
            wrap = self.r.random() < 0.2 and tag in ("article", "main")
            self.html.append("<header>" if wrap else "")
            self.block("h1", self.sentence(2, 12), 1)
            if self.r.random() < 0.3:
                self.block(self.r.choice(['p class="byline"', 'p class="date"', "time", 'div class="author"']) if not wrap else "p", self.words(2, 5), 1)
                if self.html[-1].startswith("<time"):
                    self.html.append("<p></p>")
            self.html.append("</header>" if wrap else "")
        for _ in range(self.r.randint(1, 12)):
            x = self.r.random()
            if x < 0.66:
                text = self.prose(self.r.choice([1, 1, 2, 3, 5, 8]))
                if self.r.random() < 0.2:
                    text = f"<b>{text}<br>"
                if self.r.random() < 0.2:
                    text += " " + self.link() + " " + self.words(2, 6) + "."
                self.block("p", text, 1, close=self.r.random() < 0.8)
            elif x < 0.72:
                self.block(self.r.choice(["h2", "h3"]), self.words(1, 6), 1)
            elif x < 0.78:
                self.html.append("<ul>")
                for _ in range(self.r.randint(2, 5)):
                    self.block("li", self.sentence(2, 12), 1)
                self.html.append("</ul>")
            elif x < 0.82:
                self.html.append("<blockquote>")
                self.block("p", self.prose(2), 1)
                self.html.append("</blockquote>")
            elif x < 0.85:
                self.html.append("<table><tr>")
                for _ in range(self.r.randint(2, 4)):
                    self.block("td", self.words(1, 3), 1)
                self.html.append("</tr></table>")
            elif x < 0.88:
                self.html.append("<figure><img src=x>")
                self.block("figcaption", self.sentence(3, 9), 1)
                self.html.append("</figure>")
            elif x < 0.9:
                self.block("pre", self.words(3, 20), 1)
            else:
                self.part(self.r.choice(["advert", "sidebar", "share", "notice", "form", "comments"]))
        if self.r.random() < 0.15:
            self.part("comments")
        self.html.append(f"</{tag}>")

    def build(self) -> tuple[str, list[int]]:
        wrapped = self.r.random() < 0.3
        self.html.append("<!DOCTYPE html><html><head><title>x</title></head><body>" + ('<div class="wrapper">' if wrapped else ""))
        for kind in ("header", "menu", "notice", "advert", "form", "sidebar"):
            if self.r.random() < 0.45:
                self.part(kind)
        if self.r.random() < 0.96:
            self.article()
        for kind in ("pager", "share", "comments", "sidebar", "advert", "form", "notice", "menu", "footer"):
            if self.r.random() < (0.8 if kind == "footer" else 0.35):
                self.part(kind)
        self.html.append(("</div>" if wrapped else "") + "</body></html>")
        return "".join(self.html), self.labels

    def build_bare(self) -> tuple[str, list[int]]:
        """A page without any named or sectioning element: text alone, in paragraphs or as it is, and now and then lists of links."""
        head, links = self.r.random() < 0.5, self.r.random()
        self.html.append("<!DOCTYPE html><html><head><title>x</title></head><body>" if head else "")
        if links < 0.15:
            self.link_list()
        if self.r.random() < 0.3:
            self.block("h1", self.sentence(2, 12), 1)
        for _ in range(self.r.choice([1, 1, 1, 2, 4, 8])):
            tag = self.r.choice(["p", "p", "div", "td", "pre", ""])
            text = self.r.choice([self.prose(self.r.choice([1, 2, 5])), self.words(1, 12)])
            if self.r.random() < 0.15:
                text += " " + self.link() + " " + self.words(2, 6) + "."
            if tag:
                self.block(tag, text, 1)
            else:
                self.html.append(f"{text}<hr>")
                self.labels.append(1)
        if 0.1 < links < 0.25:
            self.link_list()
        self.html.append("</body></html>" if head else "")
        return "".join(self.html), self.labels

    def link_list(self) -> None:
        self.html.append("<ul>")
        for _ in range(self.r.randint(2, 6)):
            self.block("li", self.link(), 0)
        self.html.append("</ul>")


#: Every so many pages is a bare one.
BARE_EVERY = 8


def labelled_pages(count: int = 500, first: int = 0) -> list[tuple[str, list[int]]]:
    """(html, labels) of ``count`` pages; labels follow the order of the leaf blocks."""
    return [_Page(first + i).build_bare() if i % BARE_EVERY == BARE_EVERY - 1 else _Page(first + i).build() for i in range(count)]
