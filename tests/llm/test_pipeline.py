"""Each stage of the pipeline against a plain version of it, over documents with nulls, repeats and clashing columns."""

import hashlib
import math

import numpy as np
import pytest
import sentencepiece

import corpus_pipeline
from gatelens.llm import puquality
from gatelens.llm.queries import tokenizer_model
from test_near_dedup import by_hand
from test_operators import lines_by_hand

LINE = "one line that many documents hold"


def rows():
    rng = np.random.default_rng(12)
    words = ["lorem", "ipsum", "dolor", "sit", "amet", "elit", "sed", "tempor"]
    out = []
    for k in range(120):
        text = ". ".join(" ".join(rng.choice(words, 12)) for _ in range(3))
        if k % 4 == 0:
            text = " ".join(w + "###" for w in text.split())
        if k % 5 == 0:
            text += f"\n{LINE}"
        out.append((k, text, "abc"[k % 3] if k % 10 else None))
    out += [(200, out[1][1], "a"), (201, out[2][1] + " end", "b"), (None, "a text without id " * 3, "a"), (202, None, "a"), (203, "", "b"), (204, "x " * 5000, "c")]
    return out


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("corpus")
    data = [(i, t, "en", s, len(t or ""), 1, 2, 3) for i, t, s in rows()]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, _id int, _size int, _key int")
    labels = [(k, int(k % 4 > 0), 0) for k in range(120)]
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder), docs


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def test_quality(spark, corpus):
    folder, docs = corpus
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    scores = {r.doc_id: r.predicted for r in puquality.score_quality(docs, labels).collect()}
    got = stage("quality classifier")(spark, docs, folder)
    assert got.columns == docs.columns
    assert sorted((r.doc_id for r in got.collect()), key=repr) == sorted((i for i, p in scores.items() if p), key=repr)
    assert all(scores[k] == int(k % 4 > 0) for k in range(120))


def test_lines(spark, corpus):
    folder, docs = corpus
    want = lines_by_hand(rows())
    got = stage("line dedup")(spark, docs, folder)
    assert got.columns == docs.columns and got.count() == len(rows())
    for r in got.collect():
        text, _, dropped = want[r.doc_id]
        assert r.text == text and r.n_chars == len(text) and r._id == 1
    assert any(w[2] for w in want.values())


def test_copies(spark, corpus):
    folder, docs = corpus
    want, _ = by_hand([(i, t) for i, t, _ in rows()])
    got = stage("SimHash near-dedup")(spark, docs, folder)
    assert got.columns == docs.columns
    assert sorted((r.doc_id for r in got.collect()), key=repr) == sorted((i for i, _ in want), key=repr)


def test_mix(spark, corpus):
    folder, docs = corpus
    size = lambda t: len((t or "").split())
    sources = sorted({s for _, _, s in rows() if s}) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sources)}
    has = {s: sum(size(t) for _, t, x in rows() if x == s) for s in sources}
    target, left, open_ = {}, sum(has.values()), list(sources)
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 3 * has[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 3 * has[s]
            left -= target[s]
            open_.remove(s)
    want = []
    for i, _, s in rows():
        rate = target[s] / has[s]
        u = int(hashlib.md5(f"{'' if i is None else i}:mix-1".encode()).hexdigest()[:8], 16) / 2**32
        want += [i] * (math.floor(rate + 1e-12) + (u < rate - math.floor(rate + 1e-12)))
    got = stage("mixing to target weights")(spark, docs, folder)
    assert got.columns == docs.columns
    assert sorted((r.doc_id for r in got.collect()), key=repr) == sorted(want, key=repr)


def test_tokens(spark, corpus):
    folder, docs = corpus
    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_model())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for i, t, _ in rows():
        ids = sp.encode(t or "", add_eos=True)
        want.append((i, len(ids), sha(" ".join(map(str, ids))), sha(sp.decode(ids))))
    got = stage("SentencePiece")(spark, docs, folder)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_whole(spark, corpus):
    folder, docs = corpus
    want = docs
    for _, run in corpus_pipeline.STAGES:
        want = run(spark, want, folder)
    got = corpus_pipeline.run(spark, folder)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
