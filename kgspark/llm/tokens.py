"""Exact token ids of whole texts, with a memo of the words met so far.

Both tokenizers split a text before they merge: no merge crosses the start of
a word. A text is therefore cut before its single spaces (and before its
single line breaks, where these are kept), and only words that the memo lacks
go through the tokenizers library. A word of letters with marks behind it is
two units, whose ids are taken apart: the letters straight from the
tokenizer's model, the marks from a table of their own. Where the cut doesn't
hold (two white-space characters in a row under the byte-level tokenizer, a NUL)
the text is encoded whole.

The memo has two generations of bounded size: words of the older one move to
the younger when they are met, and the older one goes when the younger is
full. So its memory has a bound, whatever the corpus.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np

END_ID = 2
#: Words in a generation of a worker's memo: two take some 180 MB.
MEMO_WORDS = 600_000
#: Characters of a word that the memo keeps; longer ones are encoded each time.
MEMO_CHARS = 64
#: Words of Latin letters, and marks behind: one or two units that no normalizer but lower-casing changes.
_PLAIN = re.compile(r"(\n?)([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)").fullmatch
#: The byte-level alphabet: printable bytes stand for themselves, the others for the characters from 256 on.
_SELF = [*range(33, 127), *range(161, 173), *range(174, 256)]
_ALPHABET = {b: 256 + i for i, b in enumerate(sorted(set(range(256)) - set(_SELF)))}
_SPACES = re.compile(r"\s\s")
_encoders: dict[str, Encoder] = {}


def encoder(path: str, memo_words: int = MEMO_WORDS) -> Encoder:
    """This worker's encoder, with so many words in a generation of its memo, which outlives a task."""
    if path not in _encoders:
        _encoders[path] = Encoder(path, memo_words)
    return _encoders[path]


class _Memo(dict):
    """word -> ids as bytes; a word that it lacks is learned when asked for."""

    def __init__(self, learn, most):
        self.learn, self.most, self.old = learn, most, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            ids = self.learn(word)
        if len(word) <= MEMO_CHARS:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[word] = ids
        return ids


class Encoder:
    """encode(texts) -> bytes of little-endian unsigned 32-bit ids of each, the end id included.

    Strings of special tokens inside a text are ordinary text. A null text is
    an empty one: the end id alone. A very long text takes memory in
    proportion to its length.
    """

    def __init__(self, path: str, memo_words: int = MEMO_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        # A tokenizer that drops white space gives the same ids with and without it.
        self.drops = self._ids(" a") == self._ids("a")
        self.lead = "" if self.drops else " "
        self.line = self._ids("\n")
        self.memo, self.marks = _Memo(self._learn, memo_words), _Memo(self._ids, memo_words)
        self.model, self.fast = self.tokenizer.model, True
        probe = ["Probe", "Été,", "Straßenöl.", "thtionhe", "l'eau", "end.)", "\nNext:", "x&&&"]
        self.fast = all(self._learn(w) == self._ids(w if w[0] == "\n" else self.lead + w) for w in probe)
        self.end = np.asarray([END_ID], "<u4").tobytes()

    def _ids(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids).tobytes()

    def _learn(self, word: str) -> bytes:
        """The ids of a word as it stands in a text: behind a space, or led by its line break."""
        if self.fast and word.isascii() and word.isalpha():
            return self._model(word.lower() if self.drops else "Ġ" + word)
        m = _PLAIN(word) if self.fast else None
        if m is None:
            return self._ids(word if word[:1] == "\n" else self.lead + word)
        line, stem, marks = m.groups()
        if marks:
            return self.memo[line + stem] + self.marks[marks]
        unit = (stem.lower() if self.drops else stem).encode().decode("latin-1").translate(_ALPHABET)
        return self.line + self._model(unit) if line else self._model(unit if self.drops else "Ġ" + unit)

    def _model(self, unit: str) -> bytes:
        """The ids of one unit in the byte-level alphabet, where Ġ is a space."""
        return array("I", [t.id for t in self.model.tokenize(unit)]).tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        return [self._text(text or "") + self.end for text in texts]

    def _text(self, text: str) -> bytes:
        if "\0" in text or (not self.drops and (_SPACES.search(text) or text.endswith("\n"))):
            return self._ids(text)
        if self.drops:
            return b"".join(map(self.memo.__getitem__, text.replace("\n", " ").split(" ")))
        first, *words = text.replace("\n", " \n").split(" ")
        return (self._ids(first) if first else b"") + b"".join(map(self.memo.__getitem__, words))
