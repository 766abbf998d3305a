"""Labelled pages: web pages whose main text is known, made from layouts that sites use.

A page is put together from parts, of which the main text is one; its words are made up,
so that only structure and the shape of texts can be learned.  The same seed gives the
same pages.
"""

from __future__ import annotations

import html
import random
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What kinds of boilerplate are called in class and id attributes, and the elements made for them.
KINDS = {
    "menu": ("nav ul div", "nav navbar navigation menu menubar topnav toc"),
    "header": ("header div", "header masthead logo tagline topbar branding toolbar"),
    "footer": ("footer div", "footer copyright legal colophon bottom imprint"),
    "sidebar": ("aside div", "sidebar side rail widget secondary panel complementary"),
    "advert": ("div ins aside", "ad ads advert advertisement adbox sponsor sponsored promo banner teaser"),
    "notice": ("div aside dialog", "notice cookie cookies consent alert popup modal overlay gdpr warning message paywall"),
    "form": ("form", "form search login signup subscribe newsletter register contact"),
    "comments": ("section div ol", "comments comment commentlist replies reply disqus discussion responses reader"),
    "related": ("div section aside", "related recommended more trending popular recirculation links"),
    "share": ("div ul", "share social sharing follow tags breadcrumb breadcrumbs pagination pager meta byline author date skip"),
}
_MAIN = (
    ("<article>", "</article>"), ("<main><article>", "</article></main>"), ("<main>", "</main>"), ('<article class="post">', "</article>"), ('<div class="content">', "</div>"), ('<div id="main-content" class="post-body">', "</div>"),
    ('<section class="story text">', "</section>"), ('<div class="entry-content"><div>', "</div></div>"), ('<div role="main" class="article-body">', "</div>"), ("<div>", "</div>"), ("", ""), ('<table><tr><td class="body">', "</td></tr></table>"),
)
_SYLLABLES = "an ber che de er fa gi ho in jo ka lu mé na ou pi qu ra so tion ü ver we xi ya zu ß ñ ção th st".split()


@dataclass
class _Writer:
    rng: random.Random
    parts: list[str] = field(default_factory=list)
    main: list[str] = field(default_factory=list)

    def word(self) -> str:
        return "".join(self.rng.choice(_SYLLABLES) for _ in range(self.rng.randint(1, 4)))

    def words(self, least: int, most: int) -> str:
        return " ".join(self.word() for _ in range(self.rng.randint(least, most)))

    def prose(self, words: int) -> str:
        """Sentences of about so many words, with some references to decode."""
        out = []
        while words > 0:
            n = min(words, self.rng.randint(1, 18))
            own = [self.word() for _ in range(n)]
            own = [w + "," if self.rng.random() < 0.12 and i + 1 < n else w + self.rng.choice(["", "", "", "&", "%%%", "<"]) if self.rng.random() < 0.05 else w for i, w in enumerate(own)]
            out.append(" ".join(own).capitalize() + self.rng.choice("....!?"))
            words -= n
        return " ".join(out)

    def junk(self) -> str:
        """A line that looks like no sentence; main text has such, too."""
        own = [self.word() for _ in range(self.rng.randint(1, 25))]
        return self.rng.choice([" | ", " · ", " ", " » ", ", ", "### ", " 12 "]).join(own) + self.rng.choice(["", "", " |", ":", " ©"])

    def link(self, text: str) -> str:
        return f'<a href="/{self.rng.randrange(999)}">{html.escape(text)}</a>'

    def inline(self, text: str) -> str:
        """The text as markup: escaped, sometimes with links, emphasis, and line ends in between."""
        own = [html.escape(w, quote=False) for w in text.split()]
        if self.rng.random() < 0.3:
            i = self.rng.randrange(len(own))
            own[i] = self.rng.choice(["<b>{}</b>", "<em>{}</em>", '<a href="#">{}</a>', "<span>{}</span>", "<b>{}"]).format(own[i])
        return self.rng.choice([" ", " ", "\n"]).join(own)

    def keep(self, tag: str, text: str) -> None:
        """A block of main text."""
        self.main.append(" ".join(text.split()))
        end = "" if tag in ("p", "li", "td") and self.rng.random() < 0.1 else f"</{tag}>"
        more = "<br>" if self.rng.random() < 0.1 else ""
        self.parts.append(f"<{tag}>{self.inline(text)}{more}{end}")

    def body(self) -> None:
        """The main text: headings, paragraphs of any length, lists, quotations, code, tables."""
        if self.rng.random() < 0.85:
            self.keep("h1", self.rng.choice([self.words(1, 10), self.prose(8)[:60].strip() or self.word(), self.junk()]))
        for _ in range(self.rng.randint(1, 12)):
            kind = self.rng.random()
            if kind < 0.75:
                self.keep("p", self.junk() if self.rng.random() < 0.2 else self.prose(self.rng.choice([1, 2, 3, 6, 12, 30, 60, 120])))
            elif kind < 0.82:
                self.keep(self.rng.choice(["h2", "h3"]), self.words(1, 7))
            elif kind < 0.88:
                self.parts.append("<ul>")
                for _ in range(self.rng.randint(2, 5)):
                    self.keep("li", self.prose(self.rng.randint(2, 20)))
                self.parts.append("</ul>")
            elif kind < 0.92:
                self.keep(self.rng.choice(["blockquote", "pre", "figcaption"]), self.prose(self.rng.randint(3, 30)))
            elif kind < 0.95:
                self.parts.append("<table><tr>")
                for _ in range(self.rng.randint(2, 4)):
                    self.keep("td", self.words(1, 4))
                self.parts.append("</tr></table>")
            else:
                self.boilerplate(self.rng.choice(["advert", "related", "share", "notice", "form"]))

    def boilerplate(self, kind: str) -> None:
        """A part that isn't main text, in an element of its kind or a named one."""
        tags, names = (x.split() for x in KINDS[kind])
        tag = self.rng.choice(tags)
        named = tag in ("div", "ul", "ol", "section", "ins") or self.rng.random() < 0.5
        if self.rng.random() < 0.3 and kind != "form":
            tag, named = self.rng.choice(["div", "section"]), True
        own = self.rng.sample(names, min(self.rng.randint(1, 2), len(names)))
        at = f' {self.rng.choice(["class", "class", "id"])}="{self.rng.choice(["-", " ", "_"]).join(own)}"' if named else ""
        if kind == "notice" and self.rng.random() < 0.2:
            at += self.rng.choice([" hidden", ' style="display: none"'])
        inside = []
        style = {"menu": "links", "related": "links", "share": "links", "form": "form", "comments": "prose"}.get(kind) or self.rng.choice(["prose", "prose", "links", "short"])
        item = "li" if tag in ("ul", "ol") else self.rng.choice(["p", "div", ""])
        wrap = lambda x: f"<{item}>{x}</{item}>" if item else x
        if style == "links":
            links = [self.link(self.words(1, 5 if kind == "related" else 3)) for _ in range(self.rng.randint(2, 9))]
            listed = tag not in ("ul", "ol") and self.rng.random() < 0.7
            inside += ["<ul>", *[f"<li>{x}</li>" for x in links], "</ul>"] if listed else [wrap(x) for x in links]
        elif style == "form":
            inside += [f"<label>{self.words(1, 3)}</label><input>", wrap(html.escape(self.prose(self.rng.randint(1, 15)))), f"<button>{self.words(1, 2)}</button>", "<select><option>x</option></select>"]
        elif style == "short":
            inside += [wrap(self.words(1, 4)) for _ in range(self.rng.randint(1, 3))]
        else:
            for _ in range(self.rng.randint(1, 5) if kind == "comments" else self.rng.randint(1, 2)):
                inside.append(wrap(html.escape(self.prose(self.rng.choice([2, 5, 12, 40])))))
        if kind == "footer" and self.rng.random() < 0.7:
            inside.insert(0, wrap(f"&copy; {self.word()}.com &middot; {html.escape(self.prose(self.rng.randint(2, 8)))}"))
        if kind in ("sidebar", "comments", "related", "form") and self.rng.random() < 0.5:
            inside.insert(0, f"<h3>{self.words(1, 3)}</h3>")
        self.parts.append(f"<{tag}{at}>{''.join(inside)}</{tag}>")

    def page(self) -> tuple[str, str]:
        before = [k for k in ("notice", "header", "menu", "advert", "share", "form") if self.rng.random() < 0.5]
        after = [k for k in ("share", "related", "comments", "sidebar", "advert", "form", "menu", "notice") if self.rng.random() < 0.35] + (["footer"] if self.rng.random() < 0.8 else [])
        start, end = self.rng.choice(_MAIN)
        within = [k for k in ("comments", "share", "related", "footer") if self.rng.random() < 0.08]
        if self.rng.random() < 0.2:
            self.boilerplate("sidebar")
        for k in before:
            self.boilerplate(k)
        if self.rng.random() < 0.3:
            self.parts.append(f"<!-- {self.word()} -->")
        self.parts.append(start)
        self.body()
        for k in within:
            self.boilerplate(k)
        self.parts.append(end)
        for k in after:
            self.boilerplate(k)
        head = f"<head><title>{self.words(1, 6)}</title><style>p{{margin:0}}</style><script>var t='<p>';</script></head>"
        return f"<!DOCTYPE html><html>{head}<body>{''.join(self.parts)}</body></html>", "\n\n".join(self.main)


def made_page(seed: int) -> tuple[str, str]:
    """(html, text) of one labelled page."""
    return _Writer(random.Random(seed)).page()


def labelled_pages(spark: SparkSession, pages: int = 1200, seed: int = 20_000) -> DataFrame:
    """(html, text) of so many labelled pages."""

    def rows(batches):
        for pdf in batches:
            made = [made_page(seed + int(i)) for i in pdf["id"]]
            pdf["html"], pdf["text"] = [x[0] for x in made], [x[1] for x in made]
            yield pdf[["html", "text"]]

    return spark.range(pages, numPartitions=4).select(F.col("id")).mapInPandas(rows, "html string, text string")
