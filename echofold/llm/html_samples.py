"""Made-up pages with known block labels: what the block labeller is trained on.

Words are random syllables, so that structure and place have to tell what is an article.
Layouts, wrappers and class names vary; side contents also hold whole sentences, and articles
short lines, lists and links.
"""

from __future__ import annotations

import random

_SYLLABLES = "ta re on ili ver mu chen so la ent que ra do pi est nor al vi un ka zo ber".split()
_ARTICLE = "article content post entry story main body text article-body post-content entry-content page-content markdown prose".split()
_SIDE = {
    "nav": ("nav", ["nav", "menu", "navbar", "breadcrumbs", "topnav", "site-nav", "pagination", "toc"]), "header": ("header", ["header", "masthead", "site-header", "top", "banner", "branding"]),
    "footer": ("footer", ["footer", "site-footer", "bottom", "copyright", "colophon"]), "aside": ("aside", ["sidebar", "related", "widget", "aside", "recommended", "trending", "more-stories", "tags", "author-box"]),
    "notice": ("div", ["notice", "cookie", "cookie-banner", "consent", "alert", "gdpr", "popup", "modal", "disclaimer", "newsletter"]), "ad": ("div", ["ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner-ad"]),
    "form": ("form", ["form", "search", "subscribe", "login", "contact-form", "signup"]), "comments": ("section", ["comments", "comment-list", "discussion", "responses", "replies", "disqus"]), "share": ("div", ["share", "social", "share-buttons", "follow"]),
}


def sample_page(seed: int) -> str:
    """A page whose article blocks hold the word that ``is_article`` looks for; remove it before use."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice(_SYLLABLES) for _ in range(r.randint(1, 4)))
    words = lambda a, b: " ".join(word() for _ in range(r.randint(a, b)))
    sentence = lambda a=4, b=18: words(a, b).capitalize() + r.choice(". . . . ! ?".split())
    para = lambda a=1, b=6: " ".join(sentence() for _ in range(r.randint(a, b)))
    link = lambda: f'<a href="/{word()}">{words(1, 3)}</a>'
    named = lambda names: r.choice(["", f' class="{r.choice(names)}"', f' class="{r.choice(names)} {word()}"', f' id="{r.choice(names)}"', f" class='{word()}-{r.choice(names)}'"])
    must = lambda names: r.choice([f' class="{r.choice(names)}"', f' id="{r.choice(names)}"', f' class="{word()} {r.choice(names)}"'])
    end = lambda tag: "" if r.random() < sloppy else f"</{tag}>"
    sloppy = r.choice([0, 0, 0, 0.5, 1])
    mark = " " + MARK

    def side(kind: str) -> str:
        tag, names = _SIDE[kind]
        if r.random() < 0.6:
            own = tag
            attr = named(names) if tag not in ("div", "section") else must(names)
        else:
            own, attr = r.choice(["div", "section", "div"]), must(names)
        n = r.randint(1, 7)
        if kind == "nav" or kind == "share":
            inner = "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(n)) + "</ul>" if r.random() < 0.7 else " | ".join(link() for _ in range(n))
        elif kind == "header":
            inner = f"<h1>{words(1, 3)}</h1>" * r.randint(0, 1) + r.choice([f"<p>{sentence(3, 8)}</p>", link(), "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(n)) + "</ul>"])
        elif kind == "footer":
            inner = r.choice([f"&copy; {word()}.example.com &middot; {para(1, 3)}", f"<p>&copy; {r.randint(1999, 2026)} {words(1, 4)}</p><p>{link()} &middot; {link()}</p>", "".join(f"<p>{sentence()}</p>" for _ in range(r.randint(1, 3)))])
        elif kind == "aside":
            inner = f"<h3>{words(1, 3)}</h3>" + r.choice(["<ul>" + "".join(f"<li>{link()}</li>" for _ in range(n)) + "</ul>", "".join(f"<p>{para(1, 2)}</p>" for _ in range(r.randint(1, 3))), f"<p>{para(1, 3)} {link()}</p>"])
        elif kind == "notice":
            inner = r.choice([para(1, 3), f"<p>{para(1, 3)}</p>", f"<p>{para(1, 2)} {link()}</p><button>{words(1, 2)}</button>", f"<b>{words(1, 3)}</b> {para(1, 2)}", f"<noscript>{para(1, 2)}</noscript>"])
        elif kind == "ad":
            inner = r.choice([para(1, 3), para(1, 2), f"<p>{sentence()}</p>", f"<a href='/{word()}'>{sentence()}</a>", f"<h4>{words(2, 5)}</h4><p>{para(1, 2)}</p>"])
        elif kind == "form":
            inner = "".join(f"<label>{words(1, 3)}</label><input name='{word()}'>" for _ in range(r.randint(1, 3))) + f"<p>{sentence()}</p>" * r.randint(0, 1) + f"<button>{words(1, 2)}</button>"
        else:
            one = lambda: r.choice([f"<div class='comment'><p>{para(1, 4)}</p></div>", f"<li><b>{word()}</b> <p>{para(1, 3)}</p></li>", f"<div class='comment'><span class='author'>{word()}</span><p>{para(1, 3)}</p><p>{para(1, 2)}</p></div>"])
            inner = f"<h3>{words(1, 3)}</h3>" * r.randint(0, 1) + "".join(one() for _ in range(n))
        return f"<{own}{attr}>{inner}</{own}>"

    def main() -> str:
        out = []
        if r.random() < 0.85:
            out.append(f"<h1>{words(2, 9)}{mark}</h1>")
        for _ in range(r.choice([1, 2, 3, 4, 6, 9, 14, 30])):
            k = r.random()
            if k < 0.08:
                out.append(f"<p>{sentence(1, 3)}{mark}" + end("p"))
            elif k < 0.62:
                out.append(f"<p>{para()}{mark}" + end("p"))
            elif k < 0.74:
                out.append(f"<p><b>{r.choice([para(1, 3), words(2, 8), sentence(1, 3)])}{mark}<br>")
            elif k < 0.80:
                out.append(f"<h{(h := r.randint(2, 4))}>{words(1, 7)}{mark}</h{h}>")
            elif k < 0.86:
                out.append("<ul>" + "".join(f"<li>{r.choice([sentence(), words(1, 5)])}{mark}" + end("li") for _ in range(r.randint(1, 5))) + "</ul>")
            elif k < 0.90:
                out.append(f"<blockquote>{para()}{mark}</blockquote>")
            elif k < 0.94:
                out.append(f"<p>{sentence()} {link()} {para(1, 2)}{mark}</p>")
            elif k < 0.96:
                out.append(f"<table><tr><td>{words(1, 4)}{mark}</td><td>{words(1, 3)}{mark}</td></tr></table>")
            elif k < 0.98:
                out.append(f"<pre>{words(3, 20)}{mark}</pre>")
            else:
                out.append(f"<p>{words(1, 3)}{mark}</p>")
            if r.random() < 0.06:
                out.append(side(r.choice(["ad", "ad", "aside", "share", "notice", "form"])))
        own = r.choice(["article", "article", "article", "main", "div", "section"])
        attr = named(_ARTICLE) if own in ("article", "main") else must(_ARTICLE)
        body = f"<{own}{attr}>{''.join(out)}</{own}>"
        for _ in range(r.choice([0, 0, 1, 2])):
            body = f"<div{named(['container', 'wrapper', 'row', 'page', 'main', 'layout'])}>{body}</div>"
        return body

    before = [side(r.choice(["nav", "nav", "header", "notice", "ad", "share", "form", "aside"])) for _ in range(r.choice([0, 1, 1, 2, 2, 3, 4]))]
    after = [side(r.choice(["footer", "footer", "comments", "comments", "aside", "ad", "nav", "notice", "form", "share"])) for _ in range(r.choice([0, 1, 1, 2, 3, 4]))]
    body = "".join(before) + (main() if r.random() < 0.97 else "") + "".join(after)
    if r.random() < 0.3:
        body = f"<div{named(['page', 'wrapper', 'container', 'site', 'app'])}>{body}</div>"
    return f"<!DOCTYPE html><html><head><title>{words(2, 6)}</title><style>p{{margin:0}}</style></head><body>{body}</body></html>"


MARK = "qxarticleqx"


def labelled(seed: int, blocks) -> tuple[list, list[int]]:
    """The blocks of a made-up page, without the mark, and 1 for those of its article."""
    found = blocks(sample_page(seed))
    return [(t.replace(" " + MARK, "").replace(MARK, ""), p, n) for t, p, n in found], [int(MARK in t) for t, _, _ in found]
