"""Template deduction against brute force on small sets of pages, and planted articles."""

import html
import random

from gatelens.llm import htmltemplate as H

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def planted(rng, k, wrap):
    say = lambda n: " ".join(rng.choice(WORDS) for _ in range(n)) + f" {k}{rng.random()}"
    links = "".join(f'<li><a href="/{w}">{w}</a></li>' for w in rng.sample(WORDS, rng.randint(3, 6)))
    blocks = [say(3), *(say(rng.randint(10, 60)) for _ in range(rng.randint(1, 6)))]
    body = f"<h1>{blocks[0]}</h1>" + "".join(f"<p>{html.escape(b)}</p>" for b in blocks[1:])
    page = f'<html><head><title>{say(2)}</title><script>var t="</p>";</script></head><body><nav><ul>{links}</ul></nav><div class="ad">{say(5)}</div>{wrap[0]}{body}{wrap[1]}<footer>&copy; {say(6)}</footer></body></html>'
    return page, "\n\n".join(blocks)


def test_planted_articles():
    rng = random.Random(3)
    for n in (1, 2, 7, 30):
        for wrap in (("<article>", "</article>"), ('<div class="x7">', "</div>"), ('<div role="main"><div>', "</div></div>")):
            pages = [planted(rng, k, wrap) for k in range(n)]
            assert H.extract_block([p for p, _ in pages]) == [t for _, t in pages]


def test_result_comes_through_the_template():
    rng = random.Random(4)
    pages = [planted(rng, k, ("<article>", "</article>")) for k in range(12)]
    parsed = [H.tokens(p) for p, _ in pages]
    whole = H.Template(parsed)
    bare = H.Template(parsed)
    bare.roots, bare.known, bare.words, bare.shares, bare.article, bare._named = {}, set(), set(), {}, None, {}
    assert all(bare.extract(p[0]) != whole.extract(p[0]) for p in parsed)


def test_classes_are_brute_force():
    rng = random.Random(5)
    parsed = [H.tokens(planted(rng, k, ("<article>", "</article>"))[0]) for k in range(9)]
    template = H.Template(parsed)
    vector = {}
    for i, (page, _) in enumerate(parsed):
        for kind, token, _, _ in page:
            if kind != "text":
                vector.setdefault(token, [0] * len(parsed))[i] += 1
    least = H.FREQUENT * len(parsed)
    assert set(template.roots) == {t for t, v in vector.items() if sum(c == 1 for c in v) >= least}
    rest = [t for t, v in vector.items() if sum(c > 0 for c in v) >= least and t not in template.roots]
    want = {frozenset(t for t in rest if vector[t] == vector[u]) for u in rest}
    assert {frozenset(own) for own in template.nested} == {own for own in want if len(own) >= H.MIN_TOKENS}
    # each nests where its tokens stand: links between the tags of the menu, paragraphs between those of the article
    order = sorted(template.roots, key=template.roots.get)
    for own, slots in template.nested.items():
        for page, _ in parsed:
            tags = [t for kind, t, _, _ in page if kind != "text"]
            for t in own:
                for at in [i for i, u in enumerate(tags) if u == t]:
                    assert max((order.index(u) + 1 for u in tags[: at + 1] if u in template.roots), default=0) in slots


def test_article_text_stays_whole():
    page = '<article><header class="entry-header"><h1>Headline</h1></header><p>Body one.</p><section id="discussion">More.</section><p class="share-price">Price 5</p><section id="comments"><p>Reader.</p></section></article>'
    assert H.extract_block([page]) == ["Headline\n\nBody one.\n\nMore.\n\nPrice 5"]
    own = lambda k: page.replace("Headline", f"Headline {k}").replace("Body", f"Body {k}").replace("More", f"More {k}")
    # what is the same on all pages, in an element named as what surrounds articles, is none of their text
    assert H.extract_block([own(k) for k in range(6)])[4] == "Headline 4\n\nBody 4 one.\n\nMore 4."


def test_teasers_are_not_the_article():
    pages = [f'<body><article class="teaser">Short {k}</article><div class="c">{" ".join(WORDS)} {k} {k * k}</div></body>' for k in range(8)]
    assert all(" ".join(WORDS) in t for t in H.extract_block(pages))


def test_copies_are_no_template():
    pages = [f"<body><nav><a>Menu {k}</a></nav><article><h1>Same</h1><p>The same text on every page.</p></article></body>" for k in range(10)]
    assert H.extract_block(pages) == ["Same\n\nThe same text on every page."] * 10


def test_deep_and_broken_pages():
    assert H.extract_block(["<b>" * 50_000 + "deep"]) == ["deep"]
    assert H.extract_block(["<p>a<p>b", None, "", "no tags &amp; all", "</div><div", "<!-- open"])[:4] == ["a\n\nb", "", "", "no tags & all"]
