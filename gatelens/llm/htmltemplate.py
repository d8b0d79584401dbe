"""Main text of web pages by equivalence-class template deduction.

Pages of a host are dealt into blocks; a host with many pages has many blocks, so that no task holds a whole host. In a
block, tags (told apart by the path of elements they stand in) and words (told apart by their path), those of the article
too, are tokens; tokens with the same occurrence vector over the block's pages form an equivalence class. Large and
frequent classes are valid when their tokens keep their order on every page. Classes that stand once on nearly every page
make the root; the others nest in the slots between its tokens. Words of valid classes are template text.

Slots are then judged by votes. The article is the template element that holds the most text which varies, is no link and
is in no slot voted out; names and roles of template elements vote, and so do the shares of template text and of links.
Inside the article a vote has to be strong, or two have to agree, to drop a slot; outside it only headings can stay. Names
of classes and ids count for elements of the template alone: an element that one page has says nothing about its host.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter, defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatelens.llm.common import Scratch, join_checked, text_batches

#: Pages, and bytes of their html, a block is made for.
BLOCK_PAGES, BLOCK_BYTES = 128, 32 << 20
#: Blocks of a task.
TASK_BLOCKS = 8
#: A class is large from so many tokens, and frequent from this share of a block's pages; words are template text from MIN_PAGES.
MIN_TOKENS = 2
FREQUENT = 0.9
MIN_PAGES = 4
#: From these shares of template text and of link text a slot has a vote against it.
TEMPLATE_SHARE = 0.8
LINK_SHARE = 0.6
#: Share of the varying text that an article or main element must hold to be the article, and that any other must hold.
NAMED_SHARE, ANY_SHARE = 0.5, 0.9
#: Votes: of the article for what it holds, against what lies outside, of strong and weak names, of a share. A slot stays above zero.
INSIDE, OUTSIDE, STRONG, WEAK, SHARE = 1.5, -0.5, -2.0, -1.0, -1.0
#: Weight of template text in the search for the article, in which varying text counts whole.
TEMPLATE_WEIGHT = 0.25

RAW = frozenset("script style textarea noscript template iframe xmp noembed noframes svg math title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Elements and roles that never hold article text.
CHROME = frozenset("nav footer aside form button select option input menu dialog script style textarea noscript template iframe xmp noembed noframes svg math title head label fieldset legend datalist".split())
CHROME_ROLE = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
HEADINGS = frozenset(("h1", "h2"))
#: Parts of class and id names of template elements that mark what surrounds an article, and those that often do.
STRONG_NAME = re.compile(
    r"(?:^|[-_ ])(?:ads?|adverts?|advertisement|adsense|sponsor(?:ed)?|promo(?:tion)?|nav|navbar|navigation|menu|breadcrumbs?|sidebar|cookies?|consent|gdpr|popup|modal|overlay|"
    r"comments?|comment-?list|disqus|replies|respond|footer|masthead|topbar|newsletter|subscribe|subscription|signup|login|search|pagination|pager)(?:$|[-_ ])",
    re.I,
)
WEAK_NAME = re.compile(
    r"(?:^|[-_ ])(?:banner|side|widget|notice|discussion|foot|header|share|sharing|social|related|recommended|toolbar|skip|copyright|disclaimer|alert)(?:$|[-_ ])",
    re.I,
)
MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][\w:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.S)
ATTRIBUTE = re.compile(r"([\w:-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
WORDS = re.compile(r"\w+|[^\w\s]")
CLOSES_P = BLOCKS - {"body", "html"}
PEERS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "p": {"p"}}
SCOPE = frozenset("table ul ol dl div section article body html main td th blockquote form nav aside footer header select".split())


class Element:
    """An open element; its path is a hash of the signs from the page down to it, so that depth costs no memory."""

    __slots__ = ("block", "href", "main", "name", "own", "parent", "path", "shut")

    def __init__(self, name: str, attrs: str, parent: Element | None):
        own = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(attrs)} if attrs.strip() else {}
        label = " ".join(own.get(k, "") for k in ("class", "id")).strip()
        role = own.get("role")
        self.name, self.parent = name, parent
        self.path = hash((parent.path if parent else 0, name, label))
        self.block = self.path if name in BLOCKS or not parent else parent.block
        self.href = name == "a" or bool(parent and parent.href)
        self.main = name in ("article", "main") or role in ("main", "article")
        hidden = bool(attrs) and ("hidden" in attrs.lower().split() or re.search(r"display\s*:\s*none", own.get("style", "")) is not None)
        self.shut = name in CHROME or role in CHROME_ROLE or hidden
        named = label and name not in ("html", "body", "article", "main")
        self.own = 0.0 if not named else STRONG if STRONG_NAME.search(label) else WEAK if WEAK_NAME.search(label) else 0.0


#: (kind, token, element it stands in, whether a block begins or ends here). Kinds: tag, end, text.
Token = tuple[str, "int | str", "Element | None", bool]


def tokens(page: str) -> tuple[list[Token], dict[int, Element]]:
    """Tokens in page order, and the elements by path. End tags that are left out are supplied."""
    out: list[Token] = []
    elements: dict[int, Element] = {}
    stack: list[Element] = []
    places: dict[str, list[int]] = defaultdict(list)
    scopes: list[int] = []
    cells: list[int] = []
    at, n = 0, len(page)

    def top() -> Element | None:
        return stack[-1] if stack else None

    def last(names) -> int:
        return max((places[k][-1] for k in names if places.get(k)), default=-1)

    def close(to: int) -> None:
        while len(stack) > to:
            e = stack.pop()
            places[e.name].pop()
            for held in (scopes, cells):
                if held and held[-1] == len(stack):
                    held.pop()
            out.append(("end", ~e.path, top(), e.name in BLOCKS))

    while at < n:
        m = MARKUP.search(page, at)
        if not m:
            out.append(("text", page[at:], top(), False))
            break
        if m.start() > at:
            out.append(("text", page[at : m.start()], top(), False))
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            k = last((name,))
            if k >= 0:
                close(k)
            continue
        if name in CLOSES_P and last(("p",)) > (scopes[-1] if scopes else -1):
            close(last(("p",)))
        if name in PEERS:
            k = last(PEERS[name])
            if k >= 0 and k >= (cells[-1] if cells else -1):
                close(k)
        e = Element(name, m[3] or "", top())
        elements.setdefault(e.path, e)
        out.append(("tag", e.path, top(), name in BLOCKS or name == "hr"))
        if name in VOID or (m[3] or "").rstrip().endswith("/"):
            if name == "br":
                out.append(("text", " ", top(), False))
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if name in SCOPE:
            scopes.append(len(stack))
            if name not in ("td", "th"):
                cells.append(len(stack))
        places[name].append(len(stack))
        stack.append(e)
    close(0)
    return out, elements


def classes(vectors: dict, least: float) -> dict[tuple, list]:
    """Tokens by occurrence vector, for those on at least so many pages; a vector is pairs of page and count."""
    out: dict[tuple, list] = defaultdict(list)
    for token, v in vectors.items():
        if len(v) >= least:
            out[tuple(sorted(v.items()))].append(token)
    return out


def in_order(given: list, place: dict) -> list:
    """The tokens in page order, without those whose order differs between pages; place: first place by page."""
    if not given:
        return []
    home = max(given, key=lambda t: len(place[t]))
    first = min(place[home])
    order = sorted(given, key=lambda t: place[t].get(first, 1 << 60))
    bad = set()
    for i in place[home]:
        last = -1
        for t in order:
            at = place[t].get(i)
            if at is None:
                continue
            if at < last:
                bad.add(t)
            else:
                last = at
    return [t for t in order if t not in bad]


class Template:
    """Valid equivalence classes of a block of pages, nested; template words; the judgement of slots."""

    def __init__(self, pages: list[tuple[list[Token], dict[int, Element]]]):
        n = len(pages)
        self.elements: dict[int, Element] = {}
        vectors: dict[int, dict[int, int]] = defaultdict(dict)
        place: dict[int, dict[int, int]] = defaultdict(dict)
        held: dict[int, Counter] = defaultdict(Counter)  # pages that hold a word, by path
        counts: list[list[int]] = []  # words of each text token
        for i, (parsed, elements) in enumerate(pages):
            for path, e in elements.items():
                self.elements.setdefault(path, e)
            words: dict[int, list[str]] = defaultdict(list)
            count = []
            for at, (kind, token, e, _) in enumerate(parsed):
                if kind == "text":
                    own = WORDS.findall(token)
                    words[e.path if e else 0] += own
                    count.append(len(own))
                else:
                    count.append(0)
                    v = vectors[token]
                    v[i] = v.get(i, 0) + 1
                    place[token].setdefault(i, at)
            counts.append(count)
            for path, own in words.items():
                held[path].update(set(own))
        least = max(1, FREQUENT * n)
        found = classes(vectors, least)
        once = [t for v, own in found.items() if sum(c == 1 for _, c in v) >= least for t in own]
        #: root tokens by place in the template
        self.roots: dict[int, int] = {t: k for k, t in enumerate(in_order(once, place))}
        #: slots of the root that each other valid class nests in, by its tokens
        self.nested: dict[tuple, set[int]] = {}
        placed: dict[int, set[int]] = defaultdict(set)
        rare = {t for own in found.values() for t in own} - self.roots.keys()
        for parsed, _ in pages:
            for slot, (kind, token, _, _) in zip(self.slots(parsed), parsed, strict=True):
                if kind != "text" and token in rare:
                    placed[token].add(slot)
        for own in found.values():
            rest = [t for t in own if t not in self.roots]
            if len(rest) >= MIN_TOKENS and len(in_order(rest, place)) == len(rest):
                self.nested[tuple(rest)] = set().union(*(placed[t] for t in rest))
        #: template elements: those whose tags are in the root, or nest in it
        self.known = {t for t in self.roots if t in self.elements} | {t for own in self.nested for t in own if t in self.elements}
        self.words = self._template_words(pages, held, least) if n >= MIN_PAGES else set()
        self._judge(pages, counts)

    def slots(self, parsed: list[Token]) -> list[int]:
        """For each token of a page, the slot it stands in: how many root tokens have begun."""
        out, k, roots = [], 0, self.roots
        for kind, token, _, _ in parsed:
            if kind != "text" and token in roots:
                k = max(k, roots[token] + 1)
            out.append(k)
        return out

    @staticmethod
    def _template_words(pages: list, held: dict[int, Counter], least: float) -> set:
        """(path, word) of valid classes: those that stand as often on each of nearly all pages, in large classes or alone at a path."""
        often = {path: {w for w, c in own.items() if c >= least} for path, own in held.items()}
        often = {path: own for path, own in often.items() if own}
        vectors: dict[tuple, dict[int, int]] = defaultdict(dict)
        for i, (parsed, _) in enumerate(pages):
            for kind, token, e, _ in parsed:
                own = often.get(e.path if e else 0) if kind == "text" else None
                if own:
                    for w in WORDS.findall(token):
                        if w in own:
                            v = vectors[e.path if e else 0, w]
                            v[i] = v.get(i, 0) + 1
        return {t for vector, own in classes(vectors, least).items() if len({c for _, c in vector}) == 1 for t in own}

    def named(self, path: int, stop: int | None) -> float:
        """The strongest vote of the names of an element and those around it, up to the article."""
        chain, e = [], self.elements.get(path)
        while e is not None and e.path != stop and (e.path, stop) not in self._named:
            chain.append(e)
            e = e.parent
        vote = 0.0 if e is None or e.path == stop else self._named[e.path, stop]
        for e in reversed(chain):
            vote = min(vote, STRONG if e.shut else e.own if e.path in self.known else 0.0)
            self._named[e.path, stop] = vote
        return vote

    def _judge(self, pages: list, counts: list[list[int]]) -> None:
        self._named: dict[tuple, float] = {}
        self.shares: dict[tuple[int, int], list[float]] = defaultdict(lambda: [0.0, 0.0, 0.0])
        own: dict[int, float] = defaultdict(float)
        paths = {path for path, _ in self.words}
        for (parsed, _), count in zip(pages, counts, strict=True):
            for slot, (kind, text, e, _), n in zip(self.slots(parsed), parsed, count, strict=True):
                if kind != "text" or e is None or not n:
                    continue
                same = sum((e.path, w) in self.words for w in WORDS.findall(text)) if e.path in paths else 0
                share = self.shares[slot, e.block]
                share[0] += n
                share[1] += same
                share[2] += n * e.href
                if not e.href and self.named(e.path, None) > STRONG:
                    own[e.path] += n - same + TEMPLATE_WEIGHT * same
        # an element's text and that of all it holds; elements come after those they stand in
        mass: dict[int, float] = defaultdict(float, own)
        depth: dict[int, int] = {}
        for path, e in self.elements.items():
            depth[path] = 1 + (depth.get(e.parent.path, 0) if e.parent else 0)
        for path in sorted(self.elements, key=lambda p: -depth[p]):
            e = self.elements[path]
            if e.parent is not None:
                mass[e.parent.path] += mass[path]
        total = sum(own.values())
        spans = [p for p in self.roots if p in self.elements and ~p in self.roots and not self.elements[p].shut]
        main = [p for p in spans if self.elements[p].main and total and mass[p] >= NAMED_SHARE * total]
        wide = [p for p in spans if total and mass[p] >= ANY_SHARE * total]
        #: path of the article, None for pages that are one slot
        self.article: int | None = max(main or wide, key=lambda p: (depth[p], mass[p]), default=None)

    def content(self, slot: int, e: Element | None, has_article: bool) -> bool:
        """Whether the text of an element in a slot belongs to the article."""
        if e is None:
            return not has_article
        article = self.article if has_article else None
        a, b = (self.roots[article], self.roots[~article]) if article is not None else (-1, 1 << 60)
        inside = a < slot <= b
        vote = INSIDE if inside else -OUTSIDE if e.name in HEADINGS and not e.href else OUTSIDE
        vote += self.named(e.path, article if inside else None)
        words, same, links = self.shares.get((slot, e.block), (0, 0, 0))
        if words:
            vote += SHARE * (same / words > TEMPLATE_SHARE) + SHARE * (links / words > LINK_SHARE)
        return vote > 0

    def extract(self, parsed: list[Token]) -> str:
        blocks: list[str] = []
        run: list[str] = []
        judged: dict[tuple, bool] = {}
        has_article = self.article is not None and any(kind == "tag" and token == self.article for kind, token, _, _ in parsed)

        def flush() -> None:
            text = " ".join("".join(run).split())
            if text:
                blocks.append(text)
            run.clear()

        for slot, (kind, text, e, edge) in zip(self.slots(parsed), parsed, strict=True):
            if kind == "text":
                key = (slot, e.path if e else 0)
                if key not in judged:
                    judged[key] = self.content(slot, e, has_article)
                if judged[key]:
                    run.append(entities.unescape(text))
            elif edge:
                flush()
        flush()
        return "\n\n".join(blocks)


def extract_block(pages: list[str | None]) -> list[str]:
    """Main texts of pages of one host."""
    parsed = [tokens(p or "") for p in pages]
    full = [p for p in parsed if p[0]]
    template = Template(full) if full else None
    return [template.extract(p[0]) if p[0] else "" for p in parsed]


def main_text(pages: DataFrame, block_pages: int = BLOCK_PAGES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(page_id long, url, text, n_chars long) per row of pages (page_id, url, html, any other columns).

    Null or empty html has the empty text; pages without a host in their url share one; repeated rows come back as often
    as they are given. No rows, no result.
    """
    text_batches(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    rows = rows.withColumn("_host", F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)))
    size = F.greatest(F.count("*") / block_pages, F.sum(F.coalesce(F.octet_length("html"), F.lit(0))) / block_bytes)
    scratch = Scratch(pages.sparkSession)
    blocks = scratch.save(rows.groupBy("_host").agg(F.ceil(size).alias("_blocks")))
    tasks = max(1, -(-(blocks.agg(F.sum("_blocks")).first()[0] or 0) // TASK_BLOCKS))
    dealt = join_checked(rows, blocks, "_host", "left")
    dealt = dealt.withColumn("_block", F.pmod(F.xxhash64("page_id", "url"), F.col("_blocks")))

    def run(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values(["page_id", "url"], kind="stable", ignore_index=True)
        text = extract_block(block["html"].where(block["html"].notna(), None).tolist())
        return pd.DataFrame({"page_id": block["page_id"], "url": block["url"], "text": text, "n_chars": [len(t) for t in text]})

    return dealt.repartition(tasks, "_host", "_block").groupBy("_host", "_block").applyInPandas(run, "page_id long, url string, text string, n_chars long")
