from array import array

import public_tokenizers as P

from inkwell.llm import packing


def test_words_are_found_once_and_where_they_are_missing(monkeypatch):
    words_ids, asked = packing.WordIds(P.path(packing.VOCABULARY)), []
    find = words_ids.known.find
    monkeypatch.setattr(words_ids.known, "find", lambda word: asked.append(word) or find(word))
    text = "The cat's café, and the cat: 12 été!!"
    for _ in range(2):
        got = array("I", words_ids.ids(text.encode().split()))
        assert got.tolist() == words_ids.tokenizer.encode(text, add_special_tokens=False).ids
    assert sorted(asked) == sorted(set(text.encode().split()))
