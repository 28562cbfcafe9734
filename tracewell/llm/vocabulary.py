"""Words and ids of a published tokenizer file of the word-end BPE kind, a word at a time.

Text is cut into the pieces that the file's own pre-tokenizer makes ("words"); each distinct word is encoded once by
the library's model and kept. Plain Latin text, by far the most, takes a pattern of the same meaning; any other text
goes through the file's normaliser and pre-tokenizer themselves, so that the ids always equal the library's. The
vocabulary file is read in place; its path is a parameter.
"""

from __future__ import annotations

import re

import numpy as np

from .kernels import keep_one

#: Characters for which lower-casing and the pattern below do what the file's normaliser and pre-tokenizer do.
_PLAIN = re.compile(r"[\x09-\x0d\x20-\x7eÀ-ÖØ-öø-ÿ]*")
_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-z0-9ß-öø-ÿ]+")


def byte_letters() -> dict[int, str]:
    """The reversible byte-to-letter table of byte-level BPE: printable bytes stand for themselves, others follow."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + n) for n, b in enumerate(rest)}


class Vocabulary:
    """words(text) and the mapping ids[word] -> little-endian 16-bit ids; kept words are bounded by `most`."""

    def __init__(self, path: str, most: int = 200_000):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = tk = Tokenizer.from_file(path)
        tk.no_truncation()
        tk.no_padding()
        self.model, self.normalizer, self.cutter = tk.model, tk.normalizer, tk.pre_tokenizer
        self.special = {t.content: i for i, t in tk.get_added_tokens_decoder().items()}
        self.cut_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        if tk.get_vocab_size() > 1 << 16:
            raise ValueError("ids are kept as 16-bit numbers; this vocabulary has more")
        letters = byte_letters()
        self.to_letters = {b: x for b, x in letters.items() if chr(b) != x}
        self.from_letters = {ord(x): chr(b) for b, x in letters.items()}
        self.ids = _Ids(self, most)

    def words(self, text: str | None) -> list[str]:
        if not text:
            return []
        if "<|" not in text and _PLAIN.fullmatch(text):
            return _WORDS.findall(text.lower())
        out: list[str] = []
        for part in self.cut_special.split(text) if self.cut_special else [text]:
            if part in self.special:
                out.append(part)
            elif part:
                out += (
                    x.translate(self.from_letters).encode("latin-1").decode("utf-8", "surrogateescape")
                    for x, _ in self.cutter.pre_tokenize_str(self.normalizer.normalize_str(part))
                )
        return out

    def encode_word(self, word: str) -> bytes:
        if word in self.special:
            return np.array([self.special[word]], "<u2").tobytes()
        if not word.isascii():
            word = word.encode("utf-8", "surrogateescape").decode("latin-1").translate(self.to_letters)
        elif not word.isprintable():
            word = word.translate(self.to_letters)
        return np.array([t.id for t in self.model.tokenize(word)], "<u2").tobytes()

    def encode(self, text: str | None) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.ids.__getitem__, self.words(text))), "<u2")

    def pieces(self) -> list[str]:
        return [self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size())]


class _Ids(dict):
    """Encodes a word when it first comes. Holds two generations of words, each up to half of `most`: when the younger is
    full it becomes the older, and a word that is met again moves up, so that frequent words stay."""

    def __init__(self, of: Vocabulary, most: int):
        super().__init__()
        self.of, self.half, self.older = of, max(1, most // 2), {}

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self.half:
            self.older = dict(self)
            self.clear()
        found = self.older.get(word)
        if found is None:
            found = self.of.encode_word(word)
        self[word] = found
        return found


def opened(path: str, most: int = 200_000) -> Vocabulary:
    """The vocabulary of this worker process; kept across tasks."""
    return keep_one((path, most), lambda: Vocabulary(path, most))


def default_path() -> str:
    from public_tokenizers import path

    return path("word_bpe_49k.json")
