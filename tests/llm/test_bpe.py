from array import array

import pytest
from corpus import documents, odd_texts, prose
from hypothesis import given, settings
from hypothesis import strategies as st

from barloom.llm.queries import VOCABULARY, tokenizer_path
from barloom.llm.trie_bpe import WordBpe, encode_and_decode

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def pair():
    path = tokenizer_path(VOCABULARY)
    with open(path, encoding="utf-8") as file:
        return WordBpe(file.read()), tokenizers.Tokenizer.from_file(path)


def same(pair, texts):
    own, library = pair
    for text, ids in zip(texts, own.encode_chunk(texts)):
        expected = library.encode(text, add_special_tokens=False).ids
        assert array("I", ids).tolist() == expected, text
        assert own.decode(expected) == library.decode(expected, skip_special_tokens=False)


def test_awkward_texts(pair):
    same(pair, [t or "" for t in odd_texts()] + [prose(i, 300) for i in range(5)])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("aehinorst' \n'sé"), st.characters(codec="utf-8"))), max_size=4))
def test_any_text(pair, texts):
    same(pair, texts)


def test_shared_prefixes_are_walked_once(pair):
    own, _ = pair
    words = ["unbelievable", "unbelievably", "unbelieving"]
    assert [w for w, _ in own.walk(words)] == words
    assert dict(own.walk(words)) == {w: dict(own.walk([w]))[w] for w in words}


def test_query_operator(spark, pair):
    docs = documents(spark)
    rows = encode_and_decode(docs, tokenizer_path(VOCABULARY)).collect()
    _, library = pair
    expected = {}
    for r in docs.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        expected.setdefault(r.doc_id, []).append((ids, library.decode(ids, skip_special_tokens=False)))
    got = {}
    for r in rows:
        got.setdefault(r.id, []).append((list(r.ids), r.decoded))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in expected.items()}
    assert encode_and_decode(docs.limit(0), tokenizer_path(VOCABULARY)).collect() == []
