"""Pages drawn from a grammar of page layouts, with the label of every block, to train the block labeller."""

from __future__ import annotations

import html
import random

import numpy as np

from .blocks import BlockLSTM, blocks, vectors

#: Pages that the default model is trained on.
PAGES = 1600

# How pages name their parts.
_MENUS = ["nav", "nav.main", "div.menu", "div.navbar", "ul.nav", "div.breadcrumbs", "div.pagination", "div#navigation", "div.topbar", "div[role=navigation]", "div.toc", "div.tags", "div.language-switch"]
_HEADERS = ["header", "div.header", "div#masthead", "header.site-header", "div.banner", "div.logo", "div[role=banner]"]
_FOOTERS = ["footer", "div.footer", "footer.site-footer", "div#footer", "div.copyright", "div.bottom", "div[role=contentinfo]", "div.legal"]
_SIDES = ["aside", "div.sidebar", "aside.sidebar", "div.widget", "div.related", "section.related-posts", "div.recommended", "div.popular", "div[role=complementary]", "div.author-bio", "div.trending", "div.more-stories"]
_NOTICES = ["div.cookie-notice", "div.notice", "div.alert", "div#consent", "div.popup", "div.modal", "div.cookie-banner", "p.notice", "div.gdpr", "section.warning", "div.paywall", "dialog"]
_ADVERTS = ["div.ad", "div.ads", "div.advert", "div.advertisement", "div.sponsored", "div.promo", "aside.ad", "div.ad-slot", "section.promo", "p.ad", "div.banner-ad", "span.ad", "ins.adsbygoogle", "div.sponsor"]
_FORMS = ["form", "form.search", "div.newsletter", "form.subscribe", "div.signup", "div.login", "form#login", "div.search", "fieldset"]
_COMMENTS = ["div.comments", "section#comments", "div.comment", "ol.comment-list", "ul.comments", "div.replies", "div#disqus", "section.discussion", "div.reader-comments", "article.comment", "div.reactions"]
_SHARES = ["div.share", "div.social", "ul.social-links", "div.tools", "div.meta-bar"]
_MAINS = ["article", "main", "main > article", "div.content", "div#content", "div.post", "div.entry-content", "section.story", "div.article-body", "div#main > div.post", "article.post", "div.page > main", "div#main", "section.content > article", "div.text", "article > div.body", "article > section"]
_PLAIN = ["", "", "", "div", "div.wrapper", "div.container", "div.row > div.col", "div#page", "table > tr > td"]
_SAID = {
    "menu": ["Home", "About", "Contact", "News", "Next", "Previous", "Archive", "Start", "Blog", "Skip to content"],
    "footer": ["All rights reserved.", "© 2024", "Privacy policy", "Terms of use", "Copyright", "Imprint", "© www.example.org ·", "© blog.example.com ·"],
    "side": ["Related articles", "Read more", "Most read", "Popular", "About the author", "See also"],
    "notice": ["We use cookies.", "Accept", "This site uses cookies to improve your experience.", "Notice", "Please enable JavaScript."],
    "advert": ["Advertisement", "Sponsored", "Buy now", "Ad", "Special offer"],
    "form": ["Subscribe", "Sign up", "Log in", "Search", "Your email", "Submit", "Password"],
    "comment": ["Reply", "Comments", "says:", "Leave a comment", "Report", "2 hours ago"],
    "share": ["Share", "Tweet", "Print", "Facebook", "Like"],
}


class _Page:
    def __init__(self, rng: random.Random):
        self.rng, self.out, self.labels = rng, [], []
        self.syllables = ["".join(rng.choice("aeiouäéóübcdfghlmnprstvwz") for _ in range(rng.randint(1, 4))) for _ in range(60)]

    def words(self, n: int) -> str:
        r = self.rng
        style = r.random()
        words = ["".join(r.choice(self.syllables) for _ in range(r.randint(1, 3))) for _ in range(n)]
        if style < 0.1:
            words = [w + r.choice(["###", "$$$", "&&&", "%%%", "***"]) for w in words]
        elif style < 0.18:
            words = [w.upper() + "!!" for w in words]
        elif style < 0.24:
            words = [x for w in words for x in (w, "|")]
        elif style < 0.3:
            words = [w for w in words[: max(1, n // 5)] for _ in range(r.randint(2, 9))]
        elif r.random() < 0.8:
            for i in range(0, n, r.randint(5, 14)):
                words[i] = words[i].capitalize()
                if i:
                    words[i - 1] += r.choice([".", ".", ",", "?"])
            words[-1] += r.choice([".", ".", "", "!"])
        return " ".join(words)

    def text(self, raw: str, label: int) -> None:
        r = self.rng
        shown = html.escape(raw, quote=False)
        if r.random() < 0.2 and " " in raw:
            a, b = raw.split(" ", 1)
            tag = r.choice(["b", "i", "em", "strong", "span", "a"])
            shown = f"<{tag}>{html.escape(a, quote=False)}</{tag}> {html.escape(b, quote=False)}"
        if raw.strip():
            self.out.append(shown + r.choice(["", "", "<br>", "\n"]))
            self.labels.append(label)

    def open(self, spec: str) -> list[str]:
        """Opens the elements of a spec like ``div#main > div.post``; returns their end tags."""
        ends = []
        for one in filter(None, spec.split(" > ")):
            role = ""
            if "[role=" in one:
                one, role = one[:-1].split("[role=")
            tag, _, rest = one.partition("#") if "#" in one else (one, "", "")
            tag, _, cls = tag.partition(".")
            cls = cls or rest.partition(".")[2]
            ident = rest.partition(".")[0]
            if self.rng.random() < 0.25:
                cls = (cls + " " + "".join(self.rng.choice("bcdfgklmnprtvz") for _ in range(4))).strip()
            self.out.append(f"<{tag}" + (f' id="{ident}"' if ident else "") + (f' class="{cls}"' if cls else "") + (f' role="{role}"' if role else "") + ">")
            ends.insert(0, f"</{tag}>")
        return ends

    def noise(self, kind: str, specs: list[str]) -> None:
        r = self.rng
        ends = self.open(r.choice(specs))
        form = r.random()
        said = _SAID[kind]
        if form < 0.35:  # a list of links
            self.out.append("<ul>")
            for _ in range(r.randint(2, 7)):
                self.out.append("<li><a href='/x'>" if r.random() < 0.8 else "<li>")
                self.text(r.choice(said) if r.random() < 0.3 else self.words(r.randint(1, 3)), 0)
                self.out.append("</a></li>" if self.out[-1].count("</a>") == 0 and "<a" in self.out[-2] else "</li>")
            self.out.append("</ul>")
        elif form < 0.6:  # bare text
            self.text(" ".join([r.choice(said)] * (r.random() < 0.4) + [self.words(r.randint(1, 25))]), 0)
        else:  # paragraphs, as long as those of the article
            for _ in range(r.randint(1, 4)):
                tag = r.choice(["p", "p", "div", "h3", "h4"])
                self.out.append(f"<{tag}>")
                self.text(r.choice(said) if r.random() < 0.3 else self.words(r.choice([2, 5, 12, 30, 60])), 0)
                self.out.append(f"</{tag}>")
        self.out += ends

    def article(self) -> None:
        r = self.rng
        ends = self.open(r.choice(_MAINS))
        if r.random() < 0.8:
            head = r.random() < 0.15
            self.out.append("<header>" * head + "<h1>")
            self.text(self.words(r.randint(2, 12)), 1)
            self.out.append("</h1>" + "</header>" * head)
        for _ in range(r.choice([0, 1, 2, 3, 5, 8, 12])):
            kind = r.random()
            if kind < 0.72:
                self.out.append("<p>" + r.choice(["", "", "<b>"]))
                self.text(self.words(r.choice([1, 2, 4, 8, 15, 30, 60, 120])), 1)
                self.out.append(r.choice(["</p>", "</p>", ""]))
            elif kind < 0.8:
                tag = r.choice(["h2", "h3", "blockquote", "pre", "div", "section"])
                self.out.append(f"<{tag}>")
                self.text(self.words(r.randint(1, 20)), 1)
                self.out.append(f"</{tag}>")
            elif kind < 0.87:
                tag = r.choice(["ul", "ol"])
                self.out.append(f"<{tag}>")
                for _ in range(r.randint(2, 5)):
                    self.out.append("<li>")
                    self.text(self.words(r.randint(1, 15)), 1)
                    self.out.append("</li>")
                self.out.append(f"</{tag}>")
            elif kind < 0.9:
                self.out.append("<table>")
                for _ in range(r.randint(1, 3)):
                    self.out.append("<tr><td>")
                    self.text(self.words(r.randint(1, 4)), 1)
                    self.out.append("</td><td>")
                    self.text(self.words(r.randint(1, 4)), 1)
                    self.out.append("</td></tr>")
                self.out.append("</table>")
            else:
                self.noise(*r.choice([("advert", _ADVERTS), ("advert", _ADVERTS), ("share", _SHARES), ("side", _SIDES), ("notice", _NOTICES), ("form", _FORMS)]))
        if r.random() < 0.15:
            self.noise("comment", _COMMENTS)
        self.out += ends


def page(seed: int) -> tuple[str, list[int]]:
    """(html, label of each block: 1 for main text)."""
    r = random.Random(seed)
    p = _Page(r)
    p.out.append("<!DOCTYPE html><html><head><title>")
    p.text(p.words(r.randint(1, 9)), 0)
    p.out.append("</title><style>p{margin:0}</style><script>var a='<p>';</script></head><body>")
    wrap = p.open(r.choice(_PLAIN))
    before = [("menu", _MENUS), ("menu", _MENUS), ("share", _HEADERS), ("notice", _NOTICES), ("advert", _ADVERTS), ("form", _FORMS), ("side", _SIDES)]
    after = [("side", _SIDES), ("comment", _COMMENTS), ("comment", _COMMENTS), ("footer", _FOOTERS), ("footer", _FOOTERS), ("advert", _ADVERTS), ("form", _FORMS), ("share", _SHARES), ("menu", _MENUS), ("notice", _NOTICES)]
    for one in r.sample(before, r.randint(0, 4)):
        p.noise(*one)
    p.article()
    for one in r.sample(after, r.randint(0, 5)):
        p.noise(*one)
    p.out += wrap
    p.out.append(r.choice(["</body></html>", "</body></html>", ""]))
    return "".join(p.out), p.labels


def examples(seeds: range) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Vectors and labels of the pages whose blocks come out as they were written."""
    xs, ys = [], []
    for seed in seeds:
        source, labels = page(seed)
        found = blocks(source)
        if found and len(found) == len(labels):
            xs.append(vectors(found))
            ys.append(np.array(labels, dtype=np.float32))
    return xs, ys


_MODELS: dict[int, BlockLSTM] = {}


def default_model(pages: int = PAGES) -> BlockLSTM:
    """The model trained on ``pages`` drawn pages; the same every time, and trained once in a process."""
    if pages not in _MODELS:
        model = BlockLSTM()
        model.fit(*examples(range(pages)))
        _MODELS[pages] = model
    return _MODELS[pages]
