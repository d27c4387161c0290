"""Made web pages of many layouts with their main text, from which the page model learns.

A page is put together at random: where the article sits, which elements and class names it and its surroundings have,
what lies inside it, and how carelessly the markup is written. Words are random letters, so nothing can be learned
from them.
"""

from __future__ import annotations

import html
import random

# Names that sites give to the parts of a page.
ARTICLE_NAMES = "content article post entry story main text body single page blog news markdown prose rich detail copy narrative read longform".split()
AROUND_NAMES = "wrapper container page site layout row grid inner outer app root center columns wrap section block main holder content".split()
PARTS = {
    "menu": "nav menu navbar navigation topnav breadcrumb breadcrumbs links mainmenu tabs toolbar toc pagination pager skip".split(),
    "header": "header masthead banner top branding logo topbar site-header hero tagline".split(),
    "footer": "footer bottom copyright colophon legal credits site-footer imprint foot".split(),
    "sidebar": "sidebar aside widget widgets rail secondary related recommended popular trending more-stories recent archive tags side".split(),
    "notice": "notice cookie cookies consent gdpr alert banner popup modal overlay message warning disclaimer paywall newsletter subscribe toast".split(),
    "advert": "ad ads advert advertisement adsbygoogle sponsor sponsored promo promotion ad-slot dfp banner-ad partner offer".split(),
    "form": "form search login signup subscribe newsletter contact register search-form comment-form feedback poll".split(),
    "comments": "comments comment respond discussion disqus replies reply thread responses reviews commentlist comment-body".split(),
    "share": "share social sharing share-buttons follow social-links toolbar actions".split(),
}
# Elements that such parts are written with.
PART_TAGS = {
    "menu": "nav nav nav div ul header menu".split(),
    "header": "header header div".split(),
    "footer": "footer footer div".split(),
    "sidebar": "aside aside div section".split(),
    "notice": "div div section aside dialog p".split(),
    "advert": "div div aside section ins".split(),
    "form": "form form div".split(),
    "comments": "section div ol section div".split(),
    "share": "div ul aside".split(),
}
_GLUE = ["-", "_", "__", " ", "-"]


class _Page:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.lines: list[str] = []
        self.hints = self.r.random() < 0.85  # whether names tell what a part is
        self.careless = self.r.random() < 0.3
        self.bare = self.r.random() < 0.15  # hardly anything but the article

    def word(self) -> str:
        letters = "abcdefghijklmnopqrstuvwxyz" if self.r.random() < 0.9 else "äéßñçöøœüaeiou"
        return "".join(self.r.choice(letters) for _ in range(self.r.choice((1, 2, 3, 3, 4, 5, 6, 7, 9, 12))))

    def words(self, low: int, high: int, marks: bool = True) -> str:
        out = [self.word() for _ in range(self.r.randint(low, high))]
        if marks and self.r.random() < 0.85:
            out[0] = out[0].capitalize()
            out = [w + self.r.choice((",", ".", "", "", "", "", "", "", "", "")) for w in out]
            out[-1] = out[-1].rstrip(",.") + self.r.choice(("." , ".", ".", "!", "?", ""))
        return " ".join(out)

    def length(self) -> tuple[int, int]:
        return self.r.choice(((1, 2), (1, 4), (3, 12), (8, 30), (20, 60), (40, 120), (20, 60), (8, 30)))

    def written(self, text: str) -> str:
        out = html.escape(text, quote=False)
        if self.r.random() < 0.2:
            out = out.replace(" ", self.r.choice(("\n", "  ", "&#32;", " <!-- x --> ")), 1)
        return out

    def inline(self, text: str) -> str:
        words = text.split(" ")
        for _ in range(self.r.choice((0, 0, 0, 1, 2))):
            k = self.r.randrange(len(words))
            tag = self.r.choice(("b", "i", "em", "strong", "a href='/x'", "span", "code"))
            words[k] = f"<{tag}>{words[k]}</{tag.split()[0]}>" if not words[k].startswith("<") else words[k]
        out = " ".join(words)
        return ("<b>" + out if self.careless and self.r.random() < 0.2 else out) + ("<br>" if self.careless and self.r.random() < 0.2 else "")

    def names(self, pool: list[str], odds: float = 0.9) -> str:
        if not self.hints or self.r.random() > odds:
            if self.r.random() < 0.5:
                return ""
            return f' class="{self.r.choice("abcxyz")}{self.r.randrange(999)}-{self.word()}"'
        name = self.r.choice(pool)
        extra = self.r.choice(("", "", self.r.choice(_GLUE) + self.r.choice(AROUND_NAMES + [self.word(), "1", "item", "list", "area"])))
        name = name + extra if self.r.random() < 0.8 else f"{self.word()}{self.r.choice(_GLUE)}{name}"
        return f' {self.r.choice(("class", "class", "id"))}="{name}"'

    def kept(self, tag: str, text: str, close: bool = True) -> str:
        text = " ".join(text.split())
        self.lines.append(text)
        shown = self.written(text)
        inside = self.inline(shown) if "<!--" not in shown and "&" not in shown else shown
        return f"<{tag}>{inside}" + (f"</{tag}>" if close and not (self.careless and tag in ("p", "li") and self.r.random() < 0.4) else "")

    def links(self, n: int) -> str:
        return "".join(f'<li><a href="/{k}">{self.written(self.words(1, 3, False))}</a></li>' for k in range(n))

    def part(self, kind: str) -> str:
        r, tag = self.r, self.r.choice(PART_TAGS[kind])
        names = self.names(PARTS[kind], 1.0 if tag in ("div", "section", "p", "ul", "ol", "ins") else 0.6)
        if kind == "menu":
            inside = self.links(r.randint(2, 12))
            inside = inside if tag in ("ul", "menu") else f"<ul>{inside}</ul>" if r.random() < 0.7 else inside.replace("<li>", "").replace("</li>", " | ")
        elif kind == "header":
            inside = r.choice((f"<h1>{self.words(1, 4, False)}</h1>", f"<div>{self.words(1, 4, False)}</div>", self.words(1, 6), f"<a href='/'>{self.words(1, 3, False)}</a>")) + r.choice(("", f"<p>{self.words(3, 12)}</p>"))
            inside += self.part("menu") if r.random() < 0.3 else ""
        elif kind == "footer":
            inside = r.choice((f"&copy; {r.randint(1990, 2030)} {self.words(1, 5)} &middot; {self.words(3, 20)}", f"<p>{self.words(4, 30)}</p>", f"<ul>{self.links(r.randint(1, 8))}</ul><p>&copy; {self.words(2, 9)}</p>"))
        elif kind == "sidebar":
            inside = f"<h{(k := r.randint(2, 4))}>{self.words(1, 4, False)}</h{k}>" if r.random() < 0.7 else ""
            inside += r.choice((f"<ul>{self.links(r.randint(2, 9))}</ul>", f"<p>{self.words(5, 40)}</p>", "".join(f"<div><a href='/{k}'>{self.words(3, 9)}</a><p>{self.words(4, 20)}</p></div>" for k in range(r.randint(1, 4)))))
        elif kind == "notice":
            inside = r.choice((self.words(5, 40), f"<p>{self.words(5, 40)}</p>" if tag != "p" else self.words(5, 30))) + r.choice(("", "<button>ok</button>", f" <a href='/p'>{self.words(1, 2, False)}</a>"))
        elif kind == "advert":
            inside = r.choice((self.words(3, 25), f"<p>{self.words(3, 40)}</p>", f"<a href='//x'>{self.words(2, 8)}</a>", f"<span>{self.words(1, 2)}</span> {self.words(3, 25)}"))
        elif kind == "form":
            inside = f"<label>{self.words(1, 4, False)}</label><input name='q'>" + r.choice(("", f"<p>{self.words(3, 20)}</p>", "<select><option>a<option>b</select>", f"<h3>{self.words(1, 5)}</h3>")) + r.choice(("<button>go</button>", "<input type=submit>"))
        elif kind == "comments":
            inside = f"<h3>{self.words(1, 3)}</h3>" if r.random() < 0.7 else ""
            one = r.choice(("div", "article", "li"))
            inside += "".join(f"<{one}{self.names(PARTS[kind], 0.7)}>{r.choice(('', f'<b>{self.word()}</b> '))}<p>{self.words(*r.choice(((2, 20), (10, 60))))}</p></{one}>" for _ in range(r.randint(1, 5)))
            inside += self.part("form") if r.random() < 0.3 else ""
        else:
            inside = self.links(r.randint(2, 5)) if tag == "ul" else " ".join(f"<a href='/s'>{self.word()}</a>" for _ in range(r.randint(2, 5)))
        return f"<{tag}{names}>{inside}</{tag}>"

    def block(self) -> str:
        """A piece of the article."""
        r = self.r
        kind = r.choices("p h list quote pre figure table div bare dl".split(), (60, 10, 7, 4, 3, 4, 3, 4, 2, 2))[0]
        if kind == "p":
            return self.kept("p", self.words(*self.length()))
        if kind == "h":
            return self.kept(r.choice(("h2", "h2", "h3", "h4")), self.words(1, 8))
        if kind == "list":
            tag = r.choice(("ul", "ol"))
            return f"<{tag}>" + "".join(self.kept("li", self.words(*r.choice(((1, 4), (3, 12), (8, 25))))) for _ in range(r.randint(1, 6))) + f"</{tag}>"
        if kind == "quote":
            return "<blockquote>" + (self.kept("p", self.words(3, 40)) if r.random() < 0.6 else self.kept("div", self.words(3, 40))) + "</blockquote>"
        if kind == "pre":
            return self.kept("pre", self.words(3, 30))
        if kind == "figure":
            return "<figure><img src=x>" + self.kept("figcaption", self.words(2, 15)) + "</figure>"
        if kind == "table":
            return "<table>" + "".join("<tr>" + "".join(self.kept("td", self.words(1, 4, False)) for _ in range(3)) + "</tr>" for _ in range(r.randint(1, 4))) + "</table>"
        if kind == "dl":
            return "<dl>" + self.kept("dt", self.words(1, 4)) + self.kept("dd", self.words(3, 20)) + "</dl>"
        if kind == "bare":
            return self.kept("div", self.words(10, 60))
        tag = r.choice(("div", "section"))
        inside = "".join(self.kept("p", self.words(*self.length())) for _ in range(r.randint(1, 4)))
        return f"<{tag}{self.names(ARTICLE_NAMES + AROUND_NAMES, 0.5)}>{inside}</{tag}>"

    def article(self) -> str:
        r = self.r
        tag = r.choices(("article", "main", "div", "section", "td"), (45, 12, 30, 10, 3))[0]
        names = self.names(ARTICLE_NAMES, 0.5 if tag in ("article", "main") else 1.0)
        strange = r.random() < 0.1  # texts that look like no prose
        tiny = self.hints and r.random() < (0.5 if self.bare else 0.25)  # an article that is smaller than what is around it
        parts = [self.kept("h1", self.words(1, 14))] if tiny or r.random() < 0.85 else []
        for _ in range(r.choice((1, 1, 2)) if tiny else r.choice((1, 2, 3, 5, 8, 12, 20))):
            if tiny:
                parts.append(self.kept("p", self.words(*r.choice(((1, 2), (1, 6), (4, 14))))))
            elif strange:
                parts.append(self.kept("p", " | ".join(self.words(1, 2) for _ in range(r.randint(1, 30)))))
            else:
                parts.append(self.block())
            if r.random() < 0.12:
                parts.append(self.part(r.choice(("advert", "share", "notice", "notice", "form", "sidebar", "menu"))))
        if r.random() < 0.12:
            parts.insert(0, self.part("header"))
        if r.random() < 0.3:
            parts.append(self.part(r.choice(("comments", "comments", "share", "sidebar", "form", "footer", "advert"))))
            parts += [self.part("footer")] if r.random() < 0.3 else []
        glue = r.choice(("", "", "\n", "\n  "))
        inside = f"<{tag}{names}>{glue.join(parts)}</{tag}>"
        return f"<table><tr>{inside}<td{self.names(PARTS['sidebar'], 1.0)}>{self.links(3)}</td></tr></table>" if tag == "td" else inside

    def whole(self) -> tuple[str, str]:
        r = self.r
        around = lambda x: f"<{(t := r.choice(('div', 'div', 'section', 'main', 'form')))}{self.names(AROUND_NAMES, 0.8)}>{x}</{t}>"
        bare = self.bare
        centre = self.article() if bare or r.random() < 0.93 else "".join(self.part(k) for k in r.sample(("form", "notice", "menu", "sidebar"), 2))
        some = lambda kinds, odds: "".join(self.part(k) for k in kinds if r.random() < odds * (0.15 if bare else 1))
        beside = some(("sidebar", "advert", "menu"), 0.3)
        main = beside + centre if r.random() < 0.4 else centre + beside
        main += some(("comments", "share", "sidebar"), 0.3)
        for _ in range(r.choice((0, 0, 1, 1, 2, 3))):
            main = around(main)
        top, bottom = some(("notice", "header", "menu", "advert", "form"), 0.45), some(("sidebar", "form", "notice", "footer", "footer"), 0.4)
        if bare and r.random() < 0.5:
            return f"{top}{main}{bottom}", "\n".join(self.lines)
        head = f"<head><meta charset=utf-8><title>{self.words(2, 9)}</title><style>p{{}}</style><script>var t='</p>';</script></head>"
        body = f"<!DOCTYPE html><html>{head}<body{self.names(AROUND_NAMES, 0.3)}>{top}{main}{bottom}" + ("" if self.careless else "</body></html>")
        return body, "\n".join(self.lines)


def labelled_pages(n: int, seed: int = 1) -> list[tuple[str, str]]:
    """`n` pages as (html, main text, a block a line), the same ones for the same seed."""
    return [_Page(seed * 1_000_003 + k).whole() for k in range(n)]
