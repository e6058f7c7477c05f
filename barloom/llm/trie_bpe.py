"""Byte-pair encoding of whole texts by a depth-first walk over the trie of their distinct words."""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from functools import cached_property

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession

from barloom.llm.common import col

#: Texts are worked through in chunks of about so many characters, which bounds a task's memory.
CHUNK_CHARS = 4_000_000
#: Distinct words that a Python worker remembers between chunks; beyond that it starts afresh.
MEMO_WORDS = 800_000
#: Longer words are encoded but not remembered.
MEMO_WORD_CHARS = 64
#: Characters below this are composed already and their lower case needs no context.
PLAIN_BELOW = 0x300


def byte_alphabet() -> dict[int, str]:
    """Byte to character as byte-level vocabularies write it: printable bytes stand for themselves, the
    others follow from U+0100 on in order."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


class WordBpe:
    """A BPE vocabulary with an end-of-word suffix, as its JSON file describes it.

    A word's encoding is fixed by the last token of each of its prefixes: the one token that ends there and
    may follow the last token of the prefix before it. Prefixes are nodes of the trie of all words, so each
    node's last token is found once, whatever the number of words below it.
    """

    def __init__(self, source: str):
        self.source = source
        data = json.loads(source)
        model = data["model"]
        self.suffix = model["end_of_word_suffix"]
        vocab: dict[str, int] = model["vocab"]
        self.specials = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.strings = {i: s for s, i in vocab.items()} | {i: s for s, i in self.specials.items()}
        cut = len(self.suffix)
        self.final = {s[:-cut]: i for s, i in vocab.items() if s.endswith(self.suffix)}
        self.inner = {s: i for s, i in vocab.items() if not s.endswith(self.suffix)}
        self.final_lengths = _lengths_by_ending(self.final)
        self.inner_lengths = _lengths_by_ending(self.inner)
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.made: dict[int, int] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            a, b, whole = vocab[left], vocab[right], vocab[left + right]
            self.rank[a, b] = rank
            if whole not in self.made:
                self.made[whole], self.parts[whole] = rank, (a, b)
        self.may_follow: dict[tuple[int, int], bool] = {}
        self.alphabet = byte_alphabet()
        pattern = next(
            p["pattern"]["Regex"] for p in data["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"
        )
        self.pieces = re.compile(_plain_classes(pattern))
        marks = sorted(map(re.escape, self.specials), key=len, reverse=True)
        self.special = re.compile("(" + "|".join(marks) + ")") if marks else None
        self.memo: dict[str, bytes] = {}

    @cached_property
    def library(self):
        """The tokenizers library's reading of the file, for its character tables only."""
        from tokenizers import Tokenizer

        return Tokenizer.from_str(self.source)

    def _spine(self, token: int, side: int) -> list[int]:
        """From the outermost character of one side up to the token itself."""
        spine = [token]
        while spine[-1] in self.parts:
            spine.append(self.parts[spine[-1]][side])
        return spine[::-1]

    def follows(self, left: int, right: int) -> bool:
        """Whether no merge across their border comes before both tokens are complete."""
        if (left, right) not in self.may_follow:
            self.may_follow[left, right] = self._never_merges(left, right)
        return self.may_follow[left, right]

    def _never_merges(self, left: int, right: int) -> bool:
        never = len(self.rank)
        xs, ys = self._spine(left, 1), self._spine(right, 0)
        i = j = 0
        while True:
            next_x = self.made[xs[i + 1]] if i + 1 < len(xs) else never
            next_y = self.made[ys[j + 1]] if j + 1 < len(ys) else never
            across = self.rank.get((xs[i], ys[j]), never)
            # of equal merges the leftmost comes first: that of x before the one across, that one before y's
            if across < next_x and across <= next_y and across < never:
                return False
            if next_x == next_y == never:
                return True
            if next_x <= next_y:
                i += 1
            else:
                j += 1

    def walk(self, words: Iterable[str]) -> Iterator[tuple[str, list[int]]]:
        """Each word, in the byte alphabet, with its ids.

        Sorted words are the depth-first order of their trie: what a word shares with the one before it
        is the path still on the stack.
        """
        path, last = "", [-1]
        strings, suffix, may_follow, follows = self.strings, len(self.suffix), self.may_follow, self.follows
        for word in sorted(words):
            size = len(word)
            shared, limit = 0, min(len(path), size) - 1
            while shared < limit and path[shared] == word[shared]:
                shared += 1
            del last[shared + 1 :]
            ending, lengths = self.inner, self.inner_lengths
            for end in range(shared + 1, size + 1):
                if end == size:
                    ending, lengths = self.final, self.final_lengths
                # the token that ends here and may follow the last token of what is before it
                for length in lengths.get(word[end - 3 : end] if end > 2 else "", SHORT):
                    start = end - length
                    if start < 0:
                        continue
                    token = ending.get(word[start:end])
                    if token is not None:
                        if not start:
                            break
                        fits = may_follow.get((last[start], token))
                        if fits or (fits is None and follows(last[start], token)):
                            break
                else:
                    raise ValueError(f"no token ends {word[:end]!r}")
                last.append(token)
            path, ids, end = word, [token], size + suffix - len(strings[token])
            while end:
                token = last[end]
                ids.append(token)
                end -= len(strings[token])
            ids.reverse()
            yield word, ids

    def split(self, text: str) -> list[str]:
        """Normalised pieces of a text without special tokens, not yet in the byte alphabet."""
        if text.isascii() or max(text) < chr(PLAIN_BELOW):
            return self.pieces.findall(text.lower())
        normal = self.library.normalizer.normalize_str(text)
        back = {ord(c): b for b, c in self.alphabet.items()}
        found = self.library.pre_tokenizer.pre_tokenize_str(normal)
        return [bytes(back[ord(c)] for c in piece).decode() for piece, _ in found]

    def spell(self, word: str) -> str:
        """The word's bytes in the byte alphabet, in which printable ASCII stands for itself."""
        if word.isascii() and word.isprintable():
            return word
        return word.encode().decode("latin-1").translate(self.alphabet)

    def learn(self, words: set[str]) -> None:
        spelt = {self.spell(word): word for word in words}
        memo = self.memo
        for word, ids in self.walk(spelt):
            memo[spelt[word]] = array("I", ids).tobytes()

    def encode_chunk(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        if len(self.memo) > MEMO_WORDS:
            self.memo.clear()
        parts = [self._sections(text) for text in texts]
        fresh: set[str] = set()
        for sections in parts:
            for words in sections:
                if isinstance(words, list):
                    fresh.update(set(words).difference(self.memo))
        self.learn(fresh)
        get = self.memo.__getitem__
        encoded = [
            b"".join([b"".join(map(get, words)) if isinstance(words, list) else words for words in sections])
            for sections in parts
        ]
        for word in [w for w in fresh if len(w) > MEMO_WORD_CHARS]:
            del self.memo[word]
        return encoded

    def _sections(self, text: str) -> list[list[str] | bytes]:
        """Word lists, with the ids of special tokens between them."""
        if not text:
            return []
        if self.special is None or not any(mark in text for mark in self.specials):
            return [self.split(text)]
        return [
            array("I", [self.specials[part]]).tobytes() if part in self.specials else self.split(part)
            for part in self.special.split(text)
            if part
        ]

    def decode(self, ids: Iterable[int]) -> str:
        """Token strings joined by a space, as the file names no decoder."""
        return " ".join(map(self.strings.__getitem__, ids))


#: Lengths to try for the end of a word when no longer token ends like it.
SHORT = (2, 1)


def _lengths_by_ending(tokens: Iterable[str]) -> dict[str, tuple[int, ...]]:
    """For the last three characters of tokens, the lengths that such tokens have, longest first."""
    found: dict[str, set[int]] = {}
    for token in tokens:
        if len(token) > 2:
            found.setdefault(token[-3:], set()).add(len(token))
    return {ending: (*sorted(lengths, reverse=True), *SHORT) for ending, lengths in found.items()}


def _plain_classes(pattern: str) -> str:
    r"""The pattern with ``\p{L}``, ``\p{N}`` and ``\s`` written out for characters below PLAIN_BELOW."""
    spaces = r"\t-\r \x85\xa0"
    for name, kinds in ((r"\p{L}", "L"), (r"\p{N}", "N")):
        chars = [c for c in map(chr, range(PLAIN_BELOW)) if unicodedata.category(c)[0] == kinds]
        pattern = pattern.replace(name, _ranges(chars))
    return pattern.replace(r"\s", spaces)


def _ranges(chars: list[str]) -> str:
    runs: list[list[int]] = []
    for code in map(ord, chars):
        if runs and runs[-1][1] == code - 1:
            runs[-1][1] = code
        else:
            runs.append([code, code])
    return "".join(f"\\u{a:04x}-\\u{b:04x}" if a < b else f"\\u{a:04x}" for a, b in runs)


_LOADED: dict[int, WordBpe] = {}


def loaded(shared: Broadcast) -> WordBpe:
    """The vocabulary, built once per Python worker and kept with its memory of words."""
    source = shared.value
    key = hash(source)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = WordBpe(source)
    return _LOADED[key]


def share_vocabulary(spark: SparkSession, path: str) -> Broadcast:
    """The vocabulary file, read on the driver: a fixed size whatever the corpus."""
    with open(path, encoding="utf-8") as file:
        return spark.sparkContext.broadcast(file.read())


def chunks(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of about CHUNK_CHARS characters with the row of the first; nulls become empty."""
    start, size, chunk = 0, 0, []
    for i, text in enumerate(texts):
        chunk.append(text or "")
        size += len(chunk[-1])
        if size >= CHUNK_CHARS:
            yield start, chunk
            start, size, chunk = i + 1, 0, []
    if chunk:
        yield start, chunk


def encode_and_decode(
    docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``id``, ``ids`` (array of int) and ``decoded`` for each row; ``vocabulary`` is the path of the file.

    Rows keep their partitions: nothing is shuffled. A null or empty text has no ids and an empty decoded
    text. Repeated rows and null ids pass through; other columns are left out. Texts of any length are
    encoded whole: a word costs time in proportion to its length.
    """
    spark = docs.sparkSession
    shared = share_vocabulary(spark, vocabulary)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(shared)
        for batch in batches:
            for start, texts in chunks(batch.column(1).to_pylist()):
                encoded = bpe.encode_chunk(texts)
                ends, n = [0], 0
                for ids in encoded:
                    n += len(ids) // 4
                    ends.append(n)
                values = pa.Array.from_buffers(pa.int32(), n, [None, pa.py_buffer(b"".join(encoded))])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
                decoded = pa.array([bpe.decode(memoryview(ids).cast("I")) for ids in encoded], pa.string())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, len(texts)), lists, decoded], ["id", "ids", "decoded"]
                )

    source = docs.select(col(id_col).alias("id"), col(text_col).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(encode, f"id {kind}, ids array<int>, decoded string")
