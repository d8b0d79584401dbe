"""Merge rounds look up each pair of symbols once, and once more for each merge beside it."""

import numpy as np
import sentencepiece

from gatelens.llm import piecebpe
from gatelens.llm.queries import tokenizer_model


def test_pairs_are_looked_up_once(monkeypatch):
    tables = piecebpe.Tables(tokenizer_model())
    rng = np.random.default_rng(2)
    words = ["".join(rng.choice(list("etaoinshrdlu"), int(rng.integers(4, 30)))) for _ in range(300)]
    units = [piecebpe.SPACE + w for w in words]
    asked, pairs = [], piecebpe.Tables.pairs
    monkeypatch.setattr(piecebpe.Tables, "pairs", lambda self, x, y: (asked.append(len(x)), pairs(self, x, y))[1])
    got = tables.encode_units(units)
    n, merges = sum(map(len, units)), sum(map(len, units)) - sum(map(len, got))
    assert sum(asked) <= n + 2 * merges


def test_odd_texts_are_as_the_library_has_them():
    tables = piecebpe.Tables(tokenizer_model())
    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_model())
    rng = np.random.default_rng(6)
    letters = list("aabcdeéß 的是​́🙂\U0010fffe\n\t▁  e") + ["\x00", "the", " of"]
    texts = ["", " ", "▁", "a" * 400, " \n ", "<s>", "</s> <unk>", "<0x41>", "�"]
    texts += ["".join(rng.choice(letters, int(rng.integers(1, 300)))) for _ in range(150)]
    encode = piecebpe.encoder(tables)
    for part in (texts[:40], [], texts[20:]):
        for text, (ids, n, back) in zip(part, encode(part), strict=True):
            want = sp.encode(text, add_eos=True)
            assert ids == " ".join(map(str, want)) and n == len(want) and back == sp.decode(want)
