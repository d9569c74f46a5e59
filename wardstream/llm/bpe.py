"""Byte-pair encoding by backtracking over longest matches, and decoding by an offset table.

A piece of text is encoded left to right with the longest token that fits: an Aho-Corasick
automaton gives the longest token from every place of all new pieces in one pass.  Two tokens
may stand side by side only if merging their text gives just these two; such pairs are
checked by undoing their merges, latest first, and remembered in a table.  Where no token
fits, the last one gives way to the next shorter one, and a place from which there is no way
on is never tried again, so the work is linear in the text.  The result is that of the merges
applied in order.

Normal forms and cuts of words with other than ASCII letters are the library's.  Texts are cut at white space, and a word's tokens are remembered per worker process, in two
generations: when the younger one is full, it becomes the older one and that is dropped.  A
forgotten word is encoded anew, so the bound changes no result.

Tokens are decoded by one buffer of all token texts with an offset for each.  A tokenizer
file without a decoder puts a space between tokens.

Defined results: null and empty texts have no tokens and decode to an empty text; strings of
special tokens are their tokens; rows may repeat; other columns are not read; an empty table
gives no rows.
"""

from __future__ import annotations

import json
import re
import string
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Words and pieces of words remembered in each generation.
REMEMBERED = 150_000
#: Pairs of tokens in the table before it starts anew.
PAIRS = 1_000_000
#: Tokens that are put together at a time.
AT_ONCE = 500_000
#: Symbols: a byte's value, and a byte's value plus this at the end of a word.
LAST = 256
BETWEEN = chr(2 * LAST)
LAST_LETTERS = {chr(b): chr(b + LAST) for b in range(256)}
#: Python splits at these, but they are no white space of the tokenizer.
ODD_SPACES = re.compile("[\x1c-\x1f]")
WHITE = regex.compile(r"\p{White_Space}+")
LATIN_END = "\u0250"
#: Fixed value: how the tokenizer's file cuts a text into pieces, for ASCII texts in lower case.
ASCII_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\x20\x09-\x0da-z0-9]+")


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a vocabulary: printable bytes for themselves, others from 256 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


def _file(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


class Memory:
    """A bounded dictionary of two generations."""

    def __init__(self, bound: int = REMEMBERED):
        self._bound, self._young, self._old = bound, {}, {}

    def known(self, keys: set[str]) -> tuple[dict[str, bytes], list[str]]:
        """What is remembered of the keys, and the other keys."""
        young, old = self._young, self._old
        found = {k: young[k] for k in keys if k in young}
        late = {k: old[k] for k in keys if k not in young and k in old}
        found |= late
        self.learn(late)
        return found, [k for k in keys if k not in found]

    def learn(self, new: dict[str, bytes]) -> None:
        if len(self._young) >= self._bound:
            self._young, self._old = {}, self._young
        self._young |= new


class Bpe:
    """Vocabulary, merges and tables of a tokenizer file with byte letters and word ends.

    Symbols and merges are numbered in order; the numbers stand for the vocabulary's ids.
    """

    def __init__(self, path: str):
        import ahocorasick
        from tokenizers import Regex, Tokenizer, pre_tokenizers

        file = _file(path)
        model, end = file["model"], file["model"]["end_of_word_suffix"]
        vocab: dict[str, int] = model["vocab"]
        value = {c: b for b, c in enumerate(byte_letters())}

        def symbols(token: str) -> str:
            plain = token.removesuffix(end)
            own = [value[c] for c in plain]
            if plain != token:
                own[-1] += LAST
            return "".join(map(chr, own))

        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        made = [a.removesuffix(end) + b for a, b in merges]
        single = sorted(vocab.keys() - set(made), key=vocab.get)
        if len(set(made)) != len(made) or any(len(symbols(t)) != 1 for t in single):
            raise ValueError("every token must be one symbol or the result of one merge")
        tokens = [*single, *made]
        number = {t: k for k, t in enumerate(tokens)}
        self._text = [symbols(t) for t in tokens]
        self._length = [len(t) for t in self._text]
        self._single = len(single)
        #: What a token was merged from; symbols are their own parts.
        self._left = [*range(len(single)), *(number[a] for a, _ in merges)]
        self._right = [*range(len(single)), *(number[b] for _, b in merges)]
        self._merged = {(number[a], number[b]): len(single) + r for r, (a, b) in enumerate(merges)}
        self._ids = [np.array([vocab[t]], np.int32).tobytes() for t in tokens]
        by_text = {t: k for k, t in enumerate(self._text)}
        self._shorter = [next((by_text[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in by_text), -1) for t in self._text]
        self._automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for k, t in enumerate(self._text):
            self._automaton.add_word(t, k)
        self._automaton.make_automaton()
        self._pairs: dict[int, bool] = {}
        self._pieces, self._words = Memory(), Memory()
        # letters, white space and normal forms are those of the library, so that its Unicode tables hold
        bare = file | {"model": {"type": "BPE", "vocab": {}, "merges": []}, "added_tokens": []}
        self._normalizer = Tokenizer.from_str(json.dumps(bare)).normalizer
        self._split = pre_tokenizers.Split(Regex(file["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]), "removed", invert=True)
        special = {t["content"]: t["id"] for t in file["added_tokens"]}
        self._special = {t: np.array([k], np.int32).tobytes() for t, k in special.items()}
        self._at_special = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None

    def fits(self, a: int, b: int) -> bool:
        """Whether the text of two tokens merges into just these two.

        Merges are undone on both sides of the border, the later one first.  A pair met on
        the way whose merge comes before the merge undone last would have crossed the border.
        """
        limit, first, second = len(self._left), a, b
        while True:
            crossing = self._merged.get((first, second))
            if crossing is not None and crossing < limit:
                return False
            if first > second:
                if first < self._single:
                    return True
                limit, first = first, self._right[first]
            else:
                if second < self._single:
                    return True
                # of equal merges the left one comes first, so the right one may still be crossed
                limit, second = second + 1, self._left[second]

    def _walk(self, start: int, stop: int, longest: list[int]) -> list[int]:
        """The tokens' numbers of the stretch from start to stop."""
        length, shorter, pairs, n = self._length, self._shorter, self._pairs, len(self._left)
        token = longest[start]
        if start + length[token] == stop:
            return [token]
        done: list[int] = []
        closed: set[int] = set()
        at, last = start, -1
        while True:
            end = at + length[token]
            good = end not in closed
            if good and last >= 0:
                good = pairs.get(last * n + token)
                if good is None:
                    good = pairs[last * n + token] = self.fits(last, token)
            if good:
                done.append(token)
                if end == stop:
                    return done
                at, last, token = end, token, longest[end]
            elif shorter[token] >= 0:
                token = shorter[token]
            else:
                closed.add(at)
                token = done.pop()
                at -= length[token]
                last = done[-1] if done else -1

    def _learn_pieces(self, pieces: set[str]) -> dict[str, bytes]:
        """The ids, as bytes, of pieces."""
        known, new = self._pieces.known(pieces)
        if new:
            spelled = [p.encode().decode("latin-1") for p in new]
            joined = BETWEEN.join([s[:-1] + LAST_LETTERS[s[-1]] for s in spelled])
            longest, length = [-1] * len(joined), self._length
            for end, token in self._automaton.iter(joined):
                longest[end - length[token] + 1] = token
            if len(self._pairs) > PAIRS:
                self._pairs.clear()
            at, ids, learned = 0, self._ids.__getitem__, {}
            for piece, s in zip(new, spelled, strict=True):
                stop = at + len(s)
                learned[piece] = b"".join(map(ids, self._walk(at, stop, longest)))
                at = stop + 1
            self._pieces.learn(learned)
            known |= learned
        return known

    def _cut(self, text: str) -> list[str]:
        """The pieces of a text without special tokens: normalised, in lower case letter by letter."""
        low = text.lower()
        # Latin letters below the first accent that combines are in normal form; most words are such, with marks behind
        if low and max(text) < LATIN_END and max(low) < LATIN_END:
            core = low.rstrip(string.punctuation)
            if core.isalpha():
                return [core, low[len(core):]] if len(core) < len(low) else [core]
            if low.isascii():
                return ASCII_PIECES.findall(low)
        return [p for p, _ in self._split.pre_tokenize_str(self._normalizer.normalize_str(text))]

    def _learn(self, words: set[str]) -> dict[str, bytes]:
        """The ids, as bytes, of words without white space."""
        known, missing = self._words.known(words)
        special = self._at_special
        cut = {w: self._around_special(w) if special is not None and "<" in w and special.search(w) else self._cut(w) for w in missing}
        pieces = self._learn_pieces({p for ps in cut.values() for p in ps})
        new = {w: pieces[ps[0]] if len(ps) == 1 else b"".join([pieces[p] for p in ps]) for w, ps in cut.items()}
        self._words.learn(new)
        return known | new

    def _around_special(self, word: str) -> list[str]:
        parts = [p for p in self._at_special.split(word) if p]
        self._pieces.learn({p: self._special[p] for p in parts if p in self._special})
        return [p for part in parts for p in ([part] if part in self._special else self._cut(part))]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit numbers."""
        cut = [WHITE.split(t) if t and ODD_SPACES.search(t) else (t or "").split() for t in texts]
        known = self._learn({w for words in cut for w in words})
        return [b"".join([known[w] for w in words]) for words in cut]


class TokenTexts:
    """The texts of all tokens in one buffer, with the offset of each."""

    def __init__(self, path: str):
        file = _file(path)
        names = {k: t for t, k in file["model"]["vocab"].items()} | {t["id"]: t["content"] for t in file["added_tokens"]}
        data = [f"{names.get(k, '')} ".encode() for k in range(1 + max(names))]
        self._offsets = np.concatenate([[0], np.cumsum([len(d) for d in data])])
        self._buffer = np.frombuffer(b"".join(data), np.uint8)

    def decode(self, ids: np.ndarray) -> bytes:
        """The tokens' texts with a space between them."""
        out = []
        for at in range(0, len(ids), AT_ONCE):
            part = ids[at:at + AT_ONCE]
            starts, sizes = self._offsets[part], self._offsets[part + 1] - self._offsets[part]
            before = np.cumsum(sizes) - sizes
            out.append(self._buffer[np.repeat(starts - before, sizes) + np.arange(sizes.sum())].tobytes())
        return b"".join(out)[:-1]


_LOADED: dict[tuple[type, str], object] = {}


def loaded(path: str, kind: type = Bpe):
    """The tables of a file, made once for each worker process."""
    if (kind, path) not in _LOADED:
        _LOADED[kind, path] = kind(path)
    return _LOADED[kind, path]


def encode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id and ids, the tokens of the text."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(tokenizer_path)
        for batch in batches:
            found = bpe.encode(batch.column(1).to_pylist())
            ends = np.cumsum([0, *(len(x) // 4 for x in found)])
            flat = pa.array(np.frombuffer(b"".join(found), np.int32))
            ids = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=[id_col, "ids"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def decode(encoded: DataFrame, tokenizer_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Per row: id, ids and the decoded text; null ids decode to an empty text."""
    kind = encoded.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = loaded(tokenizer_path, TokenTexts)
        for batch in batches:
            lists = batch.column(1)
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            ends = np.cumsum(sizes)
            texts = [table.decode(flat[a:b]).decode() for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(texts, pa.string())], names=[id_col, ids_col, "decoded"])

    return encoded.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {kind}, `{ids_col}` array<int>, decoded string")
