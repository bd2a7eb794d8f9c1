"""Invented web pages with known main text, to train the block labeller on."""

from __future__ import annotations

import html
from collections.abc import Iterator

import numpy as np

#: Stands before the text of a main block; it is taken away before training.
MARK = "\ue000"

_SYLLABLES = "an be co da en er es fi ga he in ion is ka le li ment mo na ne on or pa que ra re sa sch st te th ti to un ung ver wh ça ñe ö é".split()

#: Names that sites give to the parts of their pages.
MAIN = "content post entry article body story text main page-content post-body entry-content article-body article-text prose markdown blog-post single".split()
NAVIGATION = "nav menu navbar breadcrumbs topnav links site-nav pagination categories tabs main-menu".split()
HEADER = "header masthead top site-header banner-top branding topbar page-header".split()
FOOTER = "footer bottom site-footer copyright colophon legal page-footer".split()
SIDEBAR = "sidebar aside widget related recommended trending popular rail more-stories teaser".split()
NOTICE = "notice cookie consent gdpr alert banner popup modal newsletter subscribe paywall promo disclaimer".split()
ADVERT = "ad ads advert advertisement sponsored sponsor promo-box adsense banner-ad ad-slot".split()
COMMENT = "comments comment replies discussion respond reviews comment-list disqus feedback thread".split()
SHARE = "share social sharing tools follow byline-tools buttons".split()
PHRASES = {
    "nav": "Home|News|About|Contact|Sport|Archive|Next|Previous|Products|Blog|Login|Search".split("|"),
    "notice": "We use cookies to improve your experience.|Accept all cookies|Subscribe to our newsletter.|Sign up for free updates|Your browser is out of date.|This site uses cookies. By going on you agree.".split("|"),
    "ad": "Advertisement|Buy now and save!|Sponsored content|Click here for the best offers|Limited time offer".split("|"),
    "footer": "© 2024 All rights reserved.|Privacy policy|Terms of use|Imprint|Contact us|Powered by a content system".split("|"),
    "comment": "Reply|Leave a comment|3 comments|Log in to comment|posted 2 hours ago|Great article, thanks!|I do not agree with this.".split("|"),
    "share": "Share|Tweet|Print this page|Like|Follow us|Email".split("|"),
    "form": "Your name|Email address|Send|Search|Password|Submit|Message".split("|"),
}


class _Writer:
    def __init__(self, rng: np.random.Generator):
        self.rng = rng
        own = rng.permutation(len(_SYLLABLES))[: rng.integers(15, len(_SYLLABLES))]
        self.syllables = [_SYLLABLES[i] for i in own]
        # Texts come as prose, with marks on words, as cells between bars, in capitals, or as one word again and again.
        self.style = self.pick(["", "", "", "", "", "marks", "bars", "capitals", "repeats", "mixed"])

    def chance(self, p: float) -> bool:
        return bool(self.rng.random() < p)

    def pick(self, items):
        return items[int(self.rng.integers(len(items)))]

    def word(self) -> str:
        return "".join(self.pick(self.syllables) for _ in range(int(self.rng.integers(1, 5))))

    def sentence(self, words: int) -> str:
        w = [self.word() for _ in range(max(1, words))]
        style = self.pick(["", "marks", "bars", "capitals", "repeats"]) if self.style == "mixed" else self.style
        if style == "marks":
            return " ".join(x + self.pick(["***", "%%%", "&&&", "$$$", "###"]) for x in w).capitalize()
        if style == "bars":
            return " | ".join(w).capitalize() + "." * self.chance(0.5)
        if style == "capitals":
            return " ".join(x.upper() + "!!" for x in w)
        if style == "repeats":
            return " ".join(w[:1] * len(w))
        for i in range(len(w) - 1):
            if self.chance(0.1):
                w[i] += ","
        return " ".join(w).capitalize() + ("" if self.chance(0.05) else self.pick([".", ".", ".", "!", "?"]))

    def prose(self, most: int) -> str:
        return " ".join(self.sentence(int(self.rng.integers(1, 18))) for _ in range(int(self.rng.integers(1, most + 1))))

    def names(self, family: list[str]) -> str:
        name = self.pick(family)
        if self.chance(0.25):
            name += " " + self.pick(["left", "wide", "box", "block", "inner", "row", "module", "col"])
        return f' {self.pick(["class", "class", "id"])}="{name}"'

    def keep(self, text: str) -> str:
        return MARK + html.escape(text)

    def article(self) -> str:
        out, main = [], self.keep
        title = self.sentence(int(self.rng.integers(3, 12)))
        if self.chance(0.85):
            out.append(f"<h1>{main(title)}</h1>")
        for _ in range(int(self.rng.integers(1, 16)) if self.chance(0.9) else int(self.rng.integers(16, 50))):
            r = self.rng.random()
            if r < 0.12:
                out.append(f"<p><b>{main(title if self.chance(0.4) else self.prose(2))}<br>")
            elif r < 0.75:
                # What stands around an article may be quoted in it as well.
                text = self.pick(PHRASES[self.pick(list(PHRASES))]) if self.chance(0.06) else self.prose(8)
                text = self.sentence(int(self.rng.integers(1, 4))) if self.chance(0.2) else text
                text = text + " " + self.prose(2) if self.chance(0.03) else text
                out.append(f"<p>{main(text)}" + "</p>" * self.chance(0.9))
            elif r < 0.83:
                level = self.pick("234")
                out.append(f"<h{level}>{main(self.sentence(int(self.rng.integers(1, 8))))}</h{level}>")
            elif r < 0.89:
                kind = self.pick(["ul", "ol"])
                out.append(f"<{kind}>" + "".join(f"<li>{main(self.prose(2))}</li>" for _ in range(int(self.rng.integers(2, 7)))) + f"</{kind}>")
            elif r < 0.92:
                out.append(f"<blockquote><p>{main(self.prose(3))}</p></blockquote>")
            elif r < 0.94:
                out.append("<table>" + "".join("<tr>" + "".join(f"<td>{main(self.word() + ' ' + self.word())}</td>" for _ in range(3)) + "</tr>" for _ in range(int(self.rng.integers(1, 4)))) + "</table>")
            elif r < 0.96:
                out.append(f"<pre>{main(self.prose(2))}</pre>")
            else:
                out.append(self.pick([self.advert, self.share, self.related, self.notice, self.form])())
        return "".join(out)

    def _links(self, n: int) -> str:
        said = lambda: self.pick(PHRASES["nav"]) if self.chance(0.4) else self.word()
        if self.chance(0.75):
            return "<ul>" + "".join(f'<li><a href="/{i}">{html.escape(said())}</a></li>' for i in range(n)) + "</ul>"
        return "".join(f'<a href="/{i}">{html.escape(said())}</a> | ' for i in range(n))

    def _phrase(self, kind: str, prose: float = 0.5) -> str:
        return html.escape(self.prose(2) if self.chance(prose) else self.pick(PHRASES[kind]))

    def navigation(self) -> str:
        inner = self._links(int(self.rng.integers(2, 12)))
        return f"<nav>{inner}</nav>" if self.chance(0.6) else f"<div{self.names(NAVIGATION)}>{inner}</div>"

    def header(self) -> str:
        inner = f"<{self.pick(['h1', 'div', 'p', 'h2'])}>{html.escape(self.sentence(3))}" + (self._links(4) if self.chance(0.4) else "")
        return f"<header>{inner}</header>" if self.chance(0.6) else f"<div{self.names(HEADER)}>{inner}</div>"

    def footer(self) -> str:
        inner = self._phrase("footer") if self.chance(0.5) else "".join(f"<p>{self._phrase('footer')}</p>" for _ in range(int(self.rng.integers(1, 4))))
        inner = "&copy; " + inner if self.chance(0.5) else inner
        inner += self._links(3) if self.chance(0.3) else ""
        return f"<footer>{inner}</footer>" if self.chance(0.65) else f"<div{self.names(FOOTER)}>{inner}</div>"

    def related(self) -> str:
        inner = f"<h3>{html.escape(self.sentence(2))}</h3>" * self.chance(0.6) + "".join(f"<p>{html.escape(self.prose(3))}</p>" if self.chance(0.6) else self._links(3) for _ in range(int(self.rng.integers(1, 4))))
        return f"<aside{self.names(SIDEBAR) * self.chance(0.5)}>{inner}</aside>" if self.chance(0.5) else f"<div{self.names(SIDEBAR)}>{inner}</div>"

    def notice(self) -> str:
        inner = self._phrase("notice")
        return f"<{(t := self.pick(['div', 'section', 'p', 'div']))}{self.names(NOTICE)}>{inner if t == 'p' or self.chance(0.5) else f'<p>{inner}</p>'}</{t}>"

    def advert(self) -> str:
        inner = self._phrase("ad", 0.7)
        return f"<div{self.names(ADVERT)}>{inner if self.chance(0.6) else f'<p>{inner}</p>'}</div>"

    def share(self) -> str:
        return f"<div{self.names(SHARE)}>{self._phrase('share', 0.1)}{self._links(3)}</div>"

    def form(self) -> str:
        return "<form>" + "".join(f"<label>{self._phrase('form', 0.3)}</label><input>" for _ in range(int(self.rng.integers(1, 4)))) + f"<button>{self._phrase('form', 0.2)}</button></form>"

    def comments(self) -> str:
        one = lambda: f"<{(t := self.pick(['div', 'li', 'article', 'p']))}{self.names(COMMENT) if self.chance(0.6) else ''}>" + (self._phrase("comment", 0.8) if t == "p" else f"<p>{html.escape(self.prose(4))}</p>" * int(self.rng.integers(1, 3)) + self._phrase("comment", 0.1) * self.chance(0.4)) + f"</{t}>"
        head = f"<h{(k := self.pick('234'))}>{self._phrase('comment', 0.3)}</h{k}>" * self.chance(0.5)
        t = self.pick(["section", "div", "ol", "aside"])
        return f"<{t}{self.names(COMMENT)}>{head}{''.join(one() for _ in range(int(self.rng.integers(1, 6))))}</{t}>" + (self.form() if self.chance(0.3) else "")

    def page(self) -> str:
        before = [p() for p in (self.notice, self.header, self.navigation, self.navigation, self.advert, self.related, self.form) if self.chance(0.42)]
        after = [p() for p in (self.share, self.related, self.comments, self.advert, self.navigation, self.form, self.notice, self.footer) if self.chance(0.42)]
        if self.chance(0.5):
            after.append(self.footer())
        body, inside = self.article(), self.comments() if self.chance(0.12) else ""
        r = self.rng.random()
        if r < 0.5:
            body = f"<article{self.names(MAIN) * self.chance(0.4)}>{body}{inside}</article>"
        elif r < 0.65:
            body = f"<main>{body}</main>{inside}"
        elif r < 0.93:
            body = f"<div{self.names(MAIN)}>{body}</div>{inside}"
        else:
            body = f"<div>{body}</div>{inside}"
        if self.chance(0.3):
            body = f"<{(t := self.pick(['div', 'main', 'section']))}>{body}</{t}>"
        return "<html><head><title>x</title></head><body>" + "".join(before) + body + "".join(after) + "</body></html>"


def marked_pages(n: int, seed: int) -> Iterator[str]:
    """Pages whose main blocks begin with MARK."""
    rng = np.random.default_rng(seed)
    for _ in range(n):
        yield _Writer(rng).page()
