"""Each corpus operator on small fixtures: against brute force, and on nulls, empty texts, repeats, and clashing columns."""

import hashlib
import html
import itertools

import numpy as np
import pytest
import sentencepiece

from gatelens.llm import htmltemplate, imagedesc, linededup, media, mixing, nndescent, piecebpe, puquality, simhash, surrogates, weaktox
from gatelens.llm.common import Scratch
from gatelens.llm.components import connected_components
from gatelens.llm.queries import tokenizer_model

LONG = "a line that is long enough to count"
DOCS = [
    (1, f"{LONG}\nfirst own line of some length", "a"), (2, f" {LONG.upper()} \nsecond", "a"), (3, f"{LONG}\nthird\n{LONG}", "b"), (4, "", "b"), (5, None, None), (6, "short", "c"),
    (6, "short", "c"), (7, "word " * 3000, "c"), (None, LONG, "a"), (8, "ééé 漢字 \x00 ▁x  y\n", "d"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, s, "x", "y", 0) for i, t, s in DOCS]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, count string, key string, n int")


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.where("false")


def test_components(spark):
    edges = [(1, 2), (2, 3), (5, 4), (7, 7), (9, 8), (8, 10), (10, 9), *((20 + i, 21 + i) for i in range(40))]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark)).collect()}
    assert got[1] == got[3] != got[4] == got[5] and got[8] == got[9] == got[10] and len({got[k] for k in range(20, 61)}) == 1


def lines_by_hand(rows):
    held = {}
    for i, t, _ in rows:
        for k in {x.strip(" \t\n\r\x0b\x0c").translate({c: c + 32 for c in range(65, 91)}) for x in (t or "").split("\n")}:
            if i is not None and len(k) >= 20:
                held.setdefault(k, set()).add(i)
    out = {}
    for i, t, _ in rows:
        keys = [(x, x.strip(" \t\n\r\x0b\x0c").translate({c: c + 32 for c in range(65, 91)})) for x in (t or "").split("\n")]
        stay = [x for x, k in keys if i is None or len(held.get(k, ())) < 3 or i == max(held[k])]
        out[i] = ("\n".join(stay), len(keys), len(keys) - len(stay))
    return out


def test_line_dedup(docs, nothing):
    want = lines_by_hand(DOCS)
    got = linededup.dedup_lines(docs).collect()
    assert len(got) == len(DOCS)
    for r in got:
        assert (r.text, r._n_lines, r._n_dropped) == want[r.doc_id] and r["count"] == "x"
    assert linededup.dedup_lines(nothing).count() == 0


def test_line_dedup_by_shards(docs):
    """Where the repeated keys are too many to travel to the texts, postings travel to them."""
    want = lines_by_hand(DOCS)
    got = linededup.LineIndex.build(docs.selectExpr("*", "7 AS _id", "8 AS doc", "9 AS lost")).rewritten(docs.selectExpr("*", "7 AS _id", "8 AS doc", "9 AS lost"), 0).collect()
    assert len(got) == len(DOCS)
    for r in got:
        assert (r.text, r._n_lines, r._n_dropped) == want[r.doc_id] and (r._id, r.doc, r.lost) == (7, 8, 9)


@pytest.mark.parametrize("keys", [1 << 16, 4])  # 4: many shards, dealt again as they fill
def test_line_dedup_is_incremental(spark, monkeypatch, keys):
    monkeypatch.setattr(linededup, "SHARD_KEYS", keys)
    monkeypatch.setattr(linededup, "LAYERS", 3)
    monkeypatch.setattr(linededup, "TASK_POSTINGS", 16)
    rng = np.random.default_rng(6)
    lines = [f"{k} is a line that is long enough" for k in range(30)]
    text = lambda: "\n".join(rng.choice(lines, 6))
    held = {i: text() for i in range(20)}
    table = lambda rows: spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    index = linededup.LineIndex.build(table(held))
    for step in range(4):
        if step % 2:
            gone = [int(i) for i in rng.choice(list(held), 6, replace=False)]
            index = index.delete(spark.createDataFrame([(i,) for i in gone], "doc_id long"))
            for i in gone:
                del held[i]
        else:
            more = {int(i): text() for i in [*range(30 + 10 * step, 38 + 10 * step), *list(held)[:3]]}  # the last three replace documents
            index = index.insert(table(more))
            held |= more
        want = linededup.LineIndex.build(table(held))
        assert sorted(map(tuple, index.counts.collect())) == sorted(map(tuple, want.counts.collect()))
        assert sorted(map(tuple, index.posted.distinct().collect())) == sorted(map(tuple, want.posted.distinct().collect()))
        state = [linededup.Shard(r) for r in index.state.collect()]
        assert sum(len(s.k1) for s in state) == want.counts.count() and all(s.filter.has(s.k1).all() for s in state)
    by_hand = lines_by_hand([(i, t, None) for i, t in held.items()])
    for limit in (10_000, 0):
        assert {r.doc_id: (r.text, r._n_lines, r._n_dropped) for r in index.rewritten(table(held), limit).collect()} == by_hand
    empty = index.delete(spark.createDataFrame([(i,) for i in held], "doc_id long"))
    assert empty.counts.count() == 0 and empty.losses().count() == 0 and not any(linededup.Shard(r).filter.table.any() for r in empty.state.collect())


def test_cuckoo_filter():
    keys = np.random.default_rng(1).integers(-(2**62), 2**62, 4000)
    f = linededup.CuckooFilter(4000)
    assert f.add(keys[:3000]) and f.has(keys[:3000]).all() and f.has(keys[3000:]).mean() < 0.01
    assert f.remove(keys[:1500]) == 1500 and f.has(keys[1500:3000]).all() and not f.table.all()


def test_mixing(spark, docs, nothing):
    t = {r.source: r for r in mixing.targets(docs.select("source", "text")).collect()}
    total = sum(len((x or "").split()) for _, x, _ in DOCS)
    assert abs(sum(r.target for r in t.values()) - min(total, 3 * total)) < 1e-6
    assert all(r.target <= 3 * r.source_size + 1e-9 for r in t.values()) and t[None].target == 0
    open_ = [r for r in t.values() if r.target < 3 * r.source_size - 1e-9]
    assert len({round(r.target / r.weight, 6) for r in open_}) == 1
    a, b = (sorted(map(repr, mixing.copies(docs).collect())) for _ in range(2))
    assert a == b and mixing.mixed(docs).columns == docs.columns and mixing.mixed(nothing).count() == 0


def test_piece_bpe(docs, nothing):
    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_model())
    tables = piecebpe.Tables(tokenizer_model())
    rng = np.random.default_rng(3)
    letters = list("aeiotns  \n\t.,<>/=+0123é漢😀▁")
    cases = ["", " ", "  a  b ", "a" * 700, " " * 300 + "x", *("".join(rng.choice(letters, 40)) for _ in range(300))]
    for t in cases:
        assert tables.encode(t) == sp.encode(t, add_eos=True) and tables.decode(tables.encode(t)) == sp.decode(sp.encode(t, add_eos=True))
    assert sorted(r.doc_id or 0 for r in piecebpe.tokens(docs, tokenizer_model()).collect()) == sorted(i or 0 for i, _, _ in DOCS)
    for r in piecebpe.tokens(docs.where("doc_id = 8"), tokenizer_model()).collect():
        ids = sp.encode(DOCS[-1][1], add_eos=True)
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    assert piecebpe.tokens(nothing, tokenizer_model()).count() == 0


def brute_components(ids, linked):
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(ids, 2):
        if linked(a, b):
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def test_simhash(spark, docs, nothing):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 40)
    fps = sorted({int(b) for b in base} | {int(b) ^ (1 << int(rng.integers(0, 63))) ^ (1 << int(rng.integers(0, 63))) for b in base for _ in range(6)})
    want = {(a, b) for a, b in itertools.combinations(fps, 2) if (a ^ b).bit_count() <= 2}
    table = spark.createDataFrame([(f,) for f in fps], "fp long")
    for hot in (512, 1):  # 1: all anchors are split
        got = {(min(r.a, r.b), max(r.a, r.b)) for r in simhash.links(table, Scratch(spark), hot).collect()}
        assert got == want
    out = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    assert out[4].fp == out[5].fp == 0 and out[5].component_id == 4
    assert simhash.keep_one(docs).columns == docs.columns and simhash.near_duplicates(nothing).count() == 0


def test_embeddings(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((60, 16))
    near = np.concatenate([x[:10] + 0.1 * rng.standard_normal((10, 16)) for _ in range(12)])
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([x, near]))]
    rows += [(500, None), (501, [0.0] * 16), (502, [float("nan")] * 16), (503, rows[0][1]), (503, rows[0][1]), (504, [1.0, 2.0]), (None, [1.0] * 16), (505, [2 * c for c in rows[1][1]])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "'c' AS n", "1 AS id")
    good = {i: np.array(v) / np.linalg.norm(v) for i, v in rows if i is not None and v and np.isfinite(v).all() and any(v) and len(v) == 16}
    link = lambda a, b: good[a] @ good[b] >= 0.95
    comp = brute_components(sorted(good), link)
    out = nndescent.near_duplicates(df).collect()
    assert len(out) == len(rows)
    for r in out:
        if r.vec_id in good:
            assert r.component_id == comp[r.vec_id] and r.n_links == sum(link(r.vec_id, j) for j in good if j != r.vec_id)
        else:
            assert r.n_links == 0 and r.component_id == r.vec_id
    assert nndescent.near_duplicates(df.where("false")).count() == 0


def test_html(spark):
    page = lambda k: f'<html><head><title>t</title></head><body><nav><a href="/">Home</a></nav><div id="cookie-notice">We use cookies</div><article><h1>T{k} &amp; U</h1><p>One <b>{k}</b>\n two<br>three<p>four</article><footer>&copy; x</footer></body></html>'
    rows = [(k, "http://h.example.com/a", page(k)) for k in range(9)] + [(20, None, None), (21, "http://h.example.com", ""), (22, "x", "plain &lt;b&gt;")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'z' AS text")
    got = {r.page_id: r for r in htmltemplate.main_text(df, 4).collect()}
    assert got[3].text == f"T3 {html.unescape('&amp;')} U\n\nOne 3 two three\n\nfour" and got[3].n_chars == len(got[3].text)
    assert got[20].text == got[21].text == "" and got[22].text == "plain <b>"
    assert htmltemplate.main_text(df.where("false")).count() == 0


def test_surrogates(spark, docs, nothing):
    texts = ["Mail a.b@mail.example.com or +1 (017) 555-7713; card 4952935900253052", "A.B@mail.example.com again, Mr. John Smith; Smith", "Dr. Anna Smith 10.0.0.7 and 8.8.8.8", "clean text. Nothing in it", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 AS kind")
    for limit in (1000, -1):  # -1: later attempts are joined, not broadcast
        out = {r.doc_id: r for r in surrogates.replace_entities(df, b"k", limit).collect()}
        assert out[3].text == texts[3] and out[4].text is None and out[5].text == ""
        assert all(s not in out[k].text for k, s in ((0, "a.b@"), (0, "7713"), (0, "4952935900253052"), (1, "Smith"), (2, "8.8.8.8")))
        assert out[2].text.split()[3].startswith("10.")
        assert (surrogates._luhn(out[0].text.split()[-1]) == 0) == (surrogates._luhn("4952935900253052") == 0)
        names = [s.new for s in out[1]._entities if s.kind == "family"] + [s.new for s in out[2]._entities if s.kind == "family"]
        assert len(set(names)) == 1 and len(names) == 3
        assert out[0].text.split()[1].lower() == out[1].text.split()[0].lower()
    assert surrogates.replace_entities(nothing, b"k").count() == 0


def settled(spark, rows):
    given = spark.createDataFrame([(k, c, False, "") for k, c in rows], "kind string, canon string, given boolean, hint string")
    return surrogates.settle(surrogates.entities_of(given), b"k", Scratch(spark)).collect()


def test_surrogates_stay_distinct(spark):
    rows = [("ssn", f"{i:04d}") for i in range(400)] + [("local", f"{c}@x.org") for c in "abcdefghijklmnopqrstuvwxyz"]
    new = settled(spark, rows)
    for kind in ("ssn", "local"):
        own = [r for r in new if r.kind == kind]
        assert len({r.new for r in own}) == len(own) and not {r.new for r in own} & {r.canon for r in own}


def test_surrogates_of_full_formats(spark):
    """All private addresses, and more numbers than half of their format, still settle, distinct and none its own."""
    rows = [("ip", f"192.168.{a}.{b}") for a in range(256) for b in range(256)] + [("ssn", f"{i:02d}") for i in range(60)] + [("mac", "0" * 12)]
    new = settled(spark, rows)
    assert len(new) == len(rows) and len({(r.kind, r.new) for r in new}) == len(rows) and all(r.new != r.canon for r in new)
    assert all(r.new.startswith("192.168.") for r in new if r.kind == "ip")


def test_surrogates_are_distinct_and_coreferent(spark):
    """Over all documents, written forms: one surrogate a name, and no surrogate for two names; gender of titles is kept."""
    rng = np.random.default_rng(9)
    syllables = ["ka", "lo", "mi", "ter", "ron", "sa"]
    made = sorted({"".join(rng.choice(syllables, 3)).title() for _ in range(150)})
    given, family = [*made[::2], "Robin", "Alex", "Anna", "Robert"], made[1::2]
    texts = []
    for k in range(300):
        g, f = rng.choice(given), rng.choice(family)
        texts.append(f"{rng.choice(['Dr', 'Mr', 'Mrs', 'Prof.'])} {g} {f} wrote. {f} and {f.upper()} agreed, so did Mr {g} {f}.")
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 AS doc", "2 AS later")
    for limit in (10_000, -1):
        new, old = {}, {}
        for r in surrogates.replace_entities(df, b"k", limit).collect():
            assert (r.doc, r.later) == (1, 2)
            for e in r._entities:
                was = texts[r.doc_id][e.start : e.end].casefold()
                new.setdefault(was, set()).add(e.new.casefold())
                old.setdefault(e.new.casefold(), set()).add(was)
        assert all(len(v) == 1 for v in new.values()) and all(len(v) == 1 for v in old.values()) and not set(new) & set(old)
        female = {n.casefold() for n in surrogates.GIVEN["LATIN", "f"]}
        assert next(iter(new["anna"])) in female and next(iter(new["robert"])) not in female


def test_entities_in_one_long_text():
    log = " ".join(f"Mr Robin Na{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)} 10.0.{i % 250}.{i // 250}" for i in range(4000))
    assert len(surrogates.find(log)) == 12_000


def noisy(rng, k):
    words = [" ".join(rng.choice(["the", "of", "lorem", "ipsum", "dolor", "amet"], 30)) for _ in range(3)]
    return ". ".join(words) if k % 4 else " ".join(w + "###" for w in words[0].split())


def test_quality(spark, docs, nothing):
    rng = np.random.default_rng(1)
    rows = [(k, noisy(rng, k)) for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 4 > 0)) for k in range(0, 400, 2)], "doc_id long, quality int")
    out = puquality.score_quality(df, labels).collect()
    assert np.mean([r.predicted == int(r.doc_id % 4 > 0) for r in out if r.held_out]) > 0.95
    assert puquality.score_quality(docs, labels).count() == len(DOCS) and puquality.score_quality(nothing, labels).count() == 0
    assert puquality.keep_good(df, labels).columns == df.columns


def test_toxicity(spark, docs, nothing):
    rng = np.random.default_rng(1)
    words = ["lorem", "ipsum", "dolor", "sit", "amet", "elit", "sed"]
    rows = [(k, " ".join([*rng.choice(words, 40), *(["vilewort", f"grumblex{k % 5}"] if k % 5 == 0 else [])])) for k in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 5 == 0)) for k in range(500)], "doc_id long, toxic int")
    out = weaktox.score_toxicity(df, labels).collect()
    assert np.mean([r.predicted == int(r.doc_id % 5 == 0) for r in out if r.held_out]) > 0.97
    assert weaktox.score_toxicity(docs, labels).count() == len(DOCS) and weaktox.score_toxicity(nothing, labels).count() == 0


def test_images(spark):
    rng = np.random.default_rng(4)
    v = rng.standard_normal((12, 64))
    images = [(10 * k + e, imagedesc.pgm(media.draw(v[k].tolist(), e))) for k in range(12) for e in (0, 1, 2)]
    found = {i: imagedesc.describe(imagedesc.decode(b)) for i, b in images}
    want = brute_components(sorted(found), lambda a, b: imagedesc.is_copy(*found[a], *found[b]))
    assert want == {i: i - i % 10 for i in want}
    rows = images + [(900, None), (901, b"no image"), (None, images[0][1]), (902, images[0][1]), (902, images[0][1])]
    df = spark.createDataFrame(rows, "media_id long, image binary").selectExpr("*", "1 AS id")
    out = imagedesc.image_copies(df).collect()
    assert len(out) == len(rows)
    got = {r.media_id: r.component_id for r in out}
    assert all(got[i] == want[i] for i in want) and got[902] == 0 and got[900] == 900 and got[901] == 901
    assert imagedesc.image_copies(df.where("false")).count() == 0


def test_crowded_image_buckets(spark, monkeypatch):
    """The pairs of buckets cut into blocks are those of all buckets, compared one by one."""
    monkeypatch.setattr(imagedesc, "BLOCK", 8)
    monkeypatch.setattr(imagedesc, "SMALL", 6)
    rng = np.random.default_rng(3)
    base = rng.integers(0, 256, (4, 16), np.uint8)
    corners = np.array([[30, 30, 1, 0.1], [52, 31, 1, 0.5], [34, 55, 1, -0.4], [60, 58, 1, 1.0]], np.float32)
    images = []
    for i in range(90):
        own = rng.permutation(4)[: 2 + i % 3]
        d = base[own].copy()
        d[:, 8:] ^= (rng.random((len(d), 8)) < 0.25).astype(np.uint8) << 3
        d[:, 12:] ^= 255 * (rng.random((len(d), 4)) < 0.3).astype(np.uint8)
        d[:, 0] ^= (rng.random(len(d)) < 0.5).astype(np.uint8)
        images.append((i + 1, 1 if i < 50 else i // 3, d.tobytes(), imagedesc.packed(corners[own] + np.float32([i % 7, i % 5, 0, 0]))))
    monkeypatch.setattr(imagedesc, "COMMON", 1)
    read = lambda raw: np.frombuffer(raw, np.uint8).reshape(-1, 16)
    want, holders = set(), {}
    for i, comp, raw, points in images:
        d, p = read(raw), imagedesc.unpacked(points).astype(float)
        for k in range(len(d)):
            for band in range(imagedesc.NARROW_BANDS):
                holders.setdefault((band, d[k, 3 * band : 3 * band + 3].tobytes()), []).append((i, comp, d, p, k))

    def seen(p, d, k):
        """Neighbours of a corner as the corner sees them."""
        for j in range(len(p)):
            if j != k:
                x, y = p[j, :2] - p[k, :2]
                c, s = np.cos(p[k, 3]), np.sin(p[k, 3])
                yield int.from_bytes(d[j, :4].tobytes(), "little"), round(c * x + s * y), round(c * y - s * x), p[j, 3] - p[k, 3]

    def common(u, v):
        (b, x, y, t), (c, z, w, r) = u, v
        return (b ^ c).bit_count() <= imagedesc.NEAR_BITS and np.hypot(x - z, y - w) <= 2.5 + 0.15 * np.hypot(x, y) and abs((t - r + np.pi) % (2 * np.pi) - np.pi) <= 0.5

    for own in holders.values():
        for (i, ci, d, p, k), (j, cj, e, q, m) in itertools.combinations(own, 2):
            if ci != cj and np.bitwise_count(d[k] ^ e[m]).sum() <= 28 and any(common(u, v) for u in seen(p, d, k) for v in seen(q, e, m)):
                want.add((min(i, j), max(i, j)))
    df = spark.createDataFrame(images, "id long, comp long, bits binary, points binary")
    got = [tuple(r) for r in imagedesc.crowded_pairs(df, imagedesc.Scratch(spark)).collect()]
    sizes = [len({i for i, *_ in own}) for own in holders.values()]
    assert min(sizes) <= 6 < max(sizes)  # both ways are taken
    assert want and len(got) == len(set(got)) and set(got) == want


def edited(rng, x, e):
    """A crop, other tones, a turn or another size, with noise."""
    h, w = x.shape
    c = rng.integers(0, 14, 4)
    if e % 3 == 1:
        x = x[c[0] : h - c[1], c[2] : w - c[3]]
    if e % 3 == 2:
        x = (x - 128) * rng.uniform(0.6, 1.2) + 128 + rng.uniform(-15, 15)
    if e >= 4:
        t, zoom = (rng.uniform(-0.4, 0.4), 1.0) if e == 4 else (0.0, rng.uniform(0.85, 1.2))
        yy, xx = np.mgrid[0 : x.shape[0], 0 : x.shape[1]] - np.array(x.shape)[:, None, None] / 2
        u = np.clip((xx * np.cos(t) + yy * np.sin(t)) / zoom + x.shape[1] / 2, 0, x.shape[1] - 1.01)
        v = np.clip((yy * np.cos(t) - xx * np.sin(t)) / zoom + x.shape[0] / 2, 0, x.shape[0] - 1.01)
        i, j = v.astype(int), u.astype(int)
        f, g = v - i, u - j
        x = x[i, j] * (1 - f) * (1 - g) + x[i + 1, j] * f * (1 - g) + x[i, j + 1] * (1 - f) * g + x[i + 1, j + 1] * f * g
    return np.clip(np.rint(x + rng.normal(0, rng.uniform(2, 12), x.shape)), 0, 255).astype(np.uint8)


def test_image_recall_against_all_pairs(spark):
    """Images that no generator of the query made, edited six ways: of all pairs that verification takes for copies, at least 0.9 lie in one component."""
    rng = np.random.default_rng(17)
    images = []
    for k in range(25):
        base = sum(a * media._enlarge(rng.standard_normal((n, n)), 110) for n, a in ((12, 25), (27, 25), (56, 15))) + 128
        images += [(10 * k + e, imagedesc.pgm(edited(rng, base, e))) for e in range(6)]
    found = {i: imagedesc.describe(imagedesc.decode(b)) for i, b in images}
    copies = [(a, b) for a, b in itertools.combinations(sorted(found), 2) if imagedesc.is_copy(*found[a], *found[b])]
    assert len(copies) > 200 and all(a // 10 == b // 10 for a, b in copies)
    out = {r.media_id: r.component_id for r in imagedesc.image_copies(spark.createDataFrame(images, "media_id long, image binary")).collect()}
    assert sum(out[a] == out[b] for a, b in copies) >= 0.9 * len(copies)
    assert all(out[i] // 10 == i // 10 for i in out)


def test_png_filters():
    import struct
    import zlib

    rng = np.random.default_rng(2)
    for kind, k in ((0, 1), (2, 3), (6, 4)):
        x = rng.integers(0, 256, (11, 13, k)).astype(int)
        lines = []
        for r in range(11):
            f = r % 5
            flat, up = x[r].ravel(), x[r - 1].ravel() if r else np.zeros(13 * k, int)
            left, corner = np.concatenate([np.zeros(k, int), flat[:-k]]), np.concatenate([np.zeros(k, int), up[:-k]])
            p = left + up - corner
            da, db, dc = abs(p - left), abs(p - up), abs(p - corner)
            paeth = np.where((da <= db) & (da <= dc), left, np.where(db <= dc, up, corner))
            lines.append(bytes([f]) + ((flat - [0, left, up, (left + up) // 2, paeth][f]) & 255).astype(np.uint8).tobytes())
        chunk = lambda n, b: struct.pack(">I", len(b)) + n + b + b"\0\0\0\0"
        png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 13, 11, 8, kind, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"".join(lines)))
        got = imagedesc.decode(png)
        assert (got == (x[:, :, 0] if k == 1 else imagedesc._grey(x.astype(np.uint8)))).all()
    assert imagedesc.decode(png[:60]) is None and imagedesc.decode(b"P5 99999999 99999999 255\n") is None


def test_pipeline(spark):
    import corpus_pipeline

    assert [len(s) for s in corpus_pipeline.STAGES] == [2] * 5
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 0 and out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
