"""Token ids of texts by a ``tokenizers`` file, with a bounded cache of words.

Where a vocabulary's pre-tokeniser never lets a piece cross white space and its normaliser works
on each side of a blank alone, as in ``word_bpe_49k.json`` (NFC, white-space folding, lower case
per character), the ids of a text are those of its blank-separated words, one after another, so
each distinct word is encoded once by the library. A file that is built otherwise is told by its
own description, and whole texts go through the library then.

Words of texts of printable Latin-1 characters (stable under NFC, lower-cased one by one) are
split by the file's own pre-token pattern and encoded by the library's model directly. Words of
texts with other characters, control characters or marks of special tokens go through the whole
library pipeline.
"""

from __future__ import annotations

import json
import os
import re
from string import punctuation

import numpy as np

from pagequarry.llm.common import CACHES, forget_caches, text_windows

#: Distinct words that a worker keeps; beyond it the cache starts anew.
CACHED_WORDS = 900_000

#: What keeps a Latin-1 text from being split by the pattern here.
UNUSUAL = re.compile(r"[\x00-\x08\x0e-\x1f\x7f-\x9f]|<\|")

_ENCODERS: dict[str, "WordEncoder"] = {}
CACHES.append(_ENCODERS.clear)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encoder(path: str) -> "WordEncoder":
    """The encoder for ``path`` of this Python process."""
    if path not in _ENCODERS:
        forget_caches()
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


class _Words(dict):
    """Word to its ids as bytes; an unknown word is encoded when it is first asked for."""

    def __init__(self, learn) -> None:
        super().__init__({"": b""})
        self.learn = learn

    def __missing__(self, word: str) -> bytes:
        found = self[word] = self.learn(word)
        return found


class WordEncoder:
    def __init__(self, path: str, cached_words: int = CACHED_WORDS) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.kind = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.coded = [i.to_bytes(self.kind.itemsize, "little") for i in range(self.size)]
        self.tokenize = self.tokenizer.model.tokenize
        self.cached_words = cached_words
        self.split, self.marks = self._pattern(path)
        self.words = {True: _Words(self._learn_plain), False: _Words(self._learn)}

    @staticmethod
    def _pattern(path: str):
        """The file's own pre-token pattern and byte marks, if it is built as described above."""
        import regex

        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        steps = (made.get("pre_tokenizer") or {}).get("pretokenizers") or []
        folds = [x["type"] for x in (made.get("normalizer") or {}).get("normalizers") or []]
        if folds != ["NFC", "Replace", "Lowercase"] or [x["type"] for x in steps] != ["Split", "ByteLevel"] or steps[0]["behavior"] != "Removed" or not steps[0]["invert"] or steps[1]["use_regex"] or steps[1]["add_prefix_space"]:
            return None, {}
        split = regex.compile(steps[0]["pattern"]["Regex"]).findall
        if any(c.isspace() for piece in split("a 1 . ' é _ 漢 's \t x\n y  z") for c in piece):
            return None, {}
        # Byte-level vocabularies write bytes that don't print as code points from 256 on.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in plain]
        byte = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}
        return split, {c: "".join(byte[b] for b in chr(c).encode()) for c in range(256)}

    def _learn_plain(self, word: str) -> bytes:
        # Letters, or letters and one mark, need no pattern.
        pieces = (word,) if word.isalpha() else (word[:-1], word[-1]) if word[-1] in punctuation and word[:-1].isalpha() else self.split(word)
        tokenize, marks, coded = self.tokenize, self.marks, self.coded
        return b"".join([coded[t.id] for p in pieces for t in tokenize(p if p.isascii() else p.translate(marks))])

    def _learn(self, word: str) -> bytes:
        return b"".join([self.coded[i] for i in self.tokenizer.encode(word, add_special_tokens=False).ids])

    def _split(self, text: str) -> tuple[list[str], bool]:
        """Blank-separated words, and whether they are plain (then in lower case)."""
        plain = self.split is not None and UNUSUAL.search(text) is None
        if plain:
            try:
                text.encode("latin-1")
                text = text.lower()
            except UnicodeEncodeError:
                plain = False
        return text.replace("\n", " ").split(" "), plain

    def encode(self, text: str) -> bytes:
        """All ids of a text as bytes, ``kind`` each."""
        if self.split is None:
            return self._learn(text)
        words, plain = self._split(text)
        if sum(map(len, self.words.values())) > self.cached_words:
            for known in self.words.values():
                known.clear()
                known[""] = b""
        return b"".join(map(self.words[plain].__getitem__, words))

    def documents(self, texts: list[str], end_id: int):
        """Yield each text's ids (uint32) with ``end_id`` after them; memory follows the longest text."""
        for text in texts:
            parts = [self.encode(text)] if self.split is None or len(text) <= 1 << 20 else map(self.encode, text_windows(text))
            ids = np.frombuffer(b"".join(parts), self.kind)
            out = np.empty(len(ids) + 1, np.uint32)
            out[:-1] = ids
            out[-1] = end_id
            yield out
