"""Labelled pages for training the extraction model: layouts of articles in invented words, drawn by a fixed seed.

Main text has the class {mark}yes, other blocks {mark}no; the marks are removed before features are taken.
"""

from __future__ import annotations

import random

MARK = "zq"
PAGES = 300
_SOUNDS = "ba de fi go lu ma ne pi ro su ta ve wo ka li mo nu re sa ti".split()


class _Writer:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def words(self, low: int, high: int) -> str:
        r = self.r
        return " ".join("".join(r.choice(_SOUNDS) for _ in range(r.randint(1, 4))) for _ in range(r.randint(low, high)))

    def sentence(self) -> str:
        return self.words(4, 18).capitalize() + self.r.choice(".....!?")

    def prose(self, low: int = 1, high: int = 6) -> str:
        if high > 3 and self.r.random() < 0.06:
            low, high = 20, 90
        parts = [self.sentence() for _ in range(self.r.randint(low, high))]
        if self.r.random() < 0.25:
            k = self.r.randrange(len(parts))
            parts[k] = self.r.choice([f'<a href="/x">{parts[k]}</a>', f"<b>{parts[k]}</b>", f"<em>{parts[k]}", f"{parts[k]}<br>"])
        return " ".join(parts)

    def links(self, low: int, high: int, tag: str = "li") -> str:
        return "".join(f'<{tag}><a href="/{self.words(1, 1)}">{self.words(1, 3)}</a></{tag}>' for _ in range(self.r.randint(low, high)))

    def other(self, names: list[str], tags: list[str], inner: str, bare: float = 0.3) -> str:
        r, tag = self.r, self.r.choice(tags)
        name = "" if tag != "div" and r.random() < bare else " " + r.choice(names)
        kind = r.choice(["class", "class", "id"])
        mark = f"class='{MARK}no'" if kind == "id" else ""
        return f'<{tag} {mark} {kind}="{name.strip()}{f" {MARK}no" if kind == "class" else ""}">{inner}</{tag}>'

    def menu(self) -> str:
        return self.other(["nav", "menu", "main-menu", "navbar", "breadcrumbs", "topnav"], ["nav", "nav", "div"], f"<ul>{self.links(3, 9)}</ul>" if self.r.random() < 0.7 else self.links(3, 8, "div"))

    def head(self) -> str:
        return self.other(["header", "site-header", "masthead", "banner", "top"], ["header", "header", "div"], self.r.choice(["", self.menu()]) + self.r.choice([f"<p>{self.words(2, 8)}</p>", self.words(2, 8), f"<h2>{self.words(1, 4)}</h2>", f"<h1>{self.words(1, 4)}</h1>"]))

    def foot(self) -> str:
        return self.other(["footer", "site-footer", "bottom", "copyright", "legal"], ["footer", "footer", "div"], self.r.choice([f"&copy; {self.words(1, 3)} &middot; {self.prose(1, 2)}", f"<p>{self.prose(1, 2)}</p>", f"<ul>{self.links(2, 6)}</ul><p>{self.words(2, 6)}</p>", f"<p>{self.words(3, 9)}</p><p>{self.prose(1, 3)}</p>"]))

    def side(self) -> str:
        return self.other(["sidebar", "side", "related", "widget", "recommended", "more-stories"], ["aside", "aside", "div", "section"], self.r.choice([f"<h3>{self.words(1, 3)}</h3><ul>{self.links(3, 8)}</ul>", f"<h2>{self.words(1, 3)}</h2><p>{self.prose(1, 3)}</p>", f"<p>{self.prose(1, 4)}</p>", self.prose(1, 2)]))

    def advert(self) -> str:
        return self.other(["ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner-ad", "ad-slot"], ["div", "div", "aside", "section"], self.r.choice([self.prose(1, 3), f"<p>{self.prose(1, 3)}</p>", f'<a href="/x">{self.prose(1, 2)}</a>']))

    def notice(self) -> str:
        return self.other(["cookie", "cookie-notice", "consent", "notice", "alert", "newsletter", "subscribe", "paywall", "gdpr", "popup", "modal"], ["div", "div", "section", "dialog"], self.r.choice([self.prose(1, 3), f"<p>{self.prose(1, 3)}</p>", f"<p>{self.prose(1, 2)}</p><button>{self.words(1, 2)}</button>"]))

    def form(self) -> str:
        fields = "".join(f'<label>{self.words(1, 3)}</label><input name="x">' for _ in range(self.r.randint(1, 4)))
        return self.other(["search", "login", "signup", "contact-form"], ["form"], self.r.choice([fields, f"<p>{self.words(2, 8)}</p>{fields}", f"<div>{fields}</div>{self.prose(1, 2)}"]), 0.7)

    def comments(self) -> str:
        tag = self.r.choice(["div", "li", "p"] * 3 + ["article"])
        each = "".join(f'<{tag} class="{self.r.choice(["comment", "reply", "comment-body", "c"])}">{self.r.choice([f"<p>{self.prose()}</p>", self.prose(), f"<div>{self.words(1, 2)}</div><p>{self.prose(1, 3)}</p>"])}</{tag}>' for _ in range(self.r.randint(1, 5)))
        body = f"<ul>{each}</ul>" if tag == "li" else each
        return self.other(["comments", "comment-list", "discussion", "responses", "disqus", "reader-comments"], ["div", "section", "section"], self.r.choice(["", f"<h3>{self.words(1, 2)}</h3>"]) + body, 0.0)

    def body(self) -> str:
        r, parts = self.r, []
        if r.random() < 0.85:
            parts.append(f"<h1>{self.words(2, 10)}</h1>")
        for _ in range(r.choice([1, 1, 2, 3, 5, 8, 12])):
            parts.append(r.choice([
                *[f"<p>{self.prose()}</p>"] * 7, f"<p>{self.words(1, 5)}</p>", f"<p><b>{self.prose()}<br><p>{self.prose()}</p>", f"<p>{self.prose()}", f"<h2>{self.words(1, 6)}</h2><p>{self.prose()}</p>", f"<ul>{''.join(f'<li>{self.prose(1, 2)}</li>' for _ in range(r.randint(2, 5)))}</ul>",
                f"<blockquote><p>{self.prose()}</p></blockquote>", f"<pre>{self.words(3, 20)}</pre>", f"<table><tr><td>{self.words(1, 4)}</td><td>{self.words(1, 9)}</td></tr></table>", f"<figure><img src='x'><figcaption>{self.prose(1, 1)}</figcaption></figure>",
                f"<div>{self.prose()}</div>", f"<section><h3>{self.words(1, 5)}</h3><p>{self.prose()}</p></section>", f"<div><p>{self.prose()}</p></div>",
            ]))
            if r.random() < 0.12:
                parts.append(r.choice([self.advert, self.side, self.notice, self.form])())
        if r.random() < 0.15:  # verse, dialogue, lists of short lines
            parts += [f"<p>{self.words(1, 4)}</p>" for _ in range(r.randint(8, 40))]
        return "".join(parts)

    def page(self) -> str:
        r = self.r
        inner = self.body() + (self.comments() if r.random() < 0.2 else "")
        tag = r.choice(["article"] * 5 + ["div", "main", "div", "section"])
        name = r.choice(["content", "post", "entry-content", "article-body", "story", "main-content", "post-body"]) if tag in ("div", "section") or r.random() < 0.3 else ""
        article = f'<{tag} class="{name} {MARK}yes">{inner}</{tag}>'
        if r.random() < 0.3:
            article = r.choice([f"<main>{article}{self.side()}</main>", f'<div id="page">{article}</div>', f'<div class="wrapper"><div class="row">{article}{self.side()}</div></div>', f"<main>{article}</main>"])
        some = lambda *parts: [p() for p in parts if r.random() < 0.5]
        before = [x for x in (self.menu() if r.random() < 0.7 else "", *some(self.advert, self.head), *(f() for f in (self.notice, self.form, self.side) if r.random() < 0.25)) if x]
        after = [x for x in (*some(self.foot, self.foot), *(f() for f in (self.comments, self.side, self.advert, self.notice, self.form, self.menu) if r.random() < 0.25)) if x]
        r.shuffle(before)
        return f"<!DOCTYPE html><html><head><title>{self.words(2, 9)}</title><style>p{{}}</style></head><body>{''.join(before)}{article}{''.join(after)}</body></html>"


def labelled_pages() -> list[tuple[str, str]]:
    """(page, mark) of PAGES pages."""
    return [(_Writer(seed).page(), MARK) for seed in range(PAGES)]
