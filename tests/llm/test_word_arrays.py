"""Words of texts leave Arrow as one array, not one Python scalar after the other."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from rowsieve.llm import packing, shingles

TEXTS = ["One two,  one\tTWO\n", None, "", "Ärger à Ωmega 12 two", " x" * 70 + "y" * 70]


class Guarded:
    """An Arrow array that can not be made a list of scalars."""

    def __init__(self, inner):
        self._inner = inner

    def __getattr__(self, name):
        if name in ("to_pylist", "tolist", "__iter__"):
            raise AssertionError(f"{name} makes a scalar of every word")
        found = getattr(self._inner, name)
        if callable(found):
            return lambda *args, **named: guarded(found(*args, **named))
        return guarded(found)

    def __getitem__(self, at):
        return self._inner[at]


def guarded(found):
    return Guarded(found) if isinstance(found, pa.Array) else found


@pytest.fixture
def no_scalars(monkeypatch):
    split = pc.ascii_split_whitespace
    monkeypatch.setattr(pc, "ascii_split_whitespace", lambda *args: Guarded(split(*args)))


@pytest.mark.parametrize("texts", [TEXTS, [], [None], ["  "]])
def test_words_leave_arrow_as_one_array(no_scalars, texts):
    found = shingles.words_of(pa.array(texts, pa.string()))
    want = [word for text in texts for word in (text or "").split()]
    hashed = pd.util.hash_array(np.array(want, dtype=object), categorize=False) if want else []
    assert found.numbers.tolist() == list(hashed)
    assert np.diff(found.starts).tolist() == [len((text or "").split()) for text in texts]


def test_plain_letters_need_no_pattern(no_scalars, monkeypatch):
    from rowsieve.llm.queries import word_tokenizer

    tokens = packing.WordTokens(word_tokenizer())
    assert tokens.folds
    tried = []

    class Pattern:
        def fullmatch(self, word, plain=packing._LETTERS):
            tried.append(word)
            return plain.fullmatch(word)

    monkeypatch.setattr(packing, "_LETTERS", Pattern())
    ids, begins = packing.token_ids(pa.array(TEXTS, pa.string()), tokens)
    assert sorted(tried) == sorted(["", "12", "x" + "y" * 70, "Ärger", "à", "Ωmega"])
    for text, a, b in zip(TEXTS, begins, begins[1:]):
        assert ids[a:b].tolist() == tokens.tokenizer.encode(text or "", add_special_tokens=False).ids
