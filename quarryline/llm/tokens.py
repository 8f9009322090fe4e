"""Token ids of a public tokenizer with word ends, whole texts, exactly as the tokenizers library gives them.

The tokenizer drops white space and never joins across it, so a text's ids are those of its words in a row. Words
recur: bounded caches hold ids. A text that is plain (ASCII and Latin-1 letters, digits and marks, no apostrophes,
no `<` and `>`) is cut into its runs of letters, digits and marks, as the tokenizer does, and these go to its model;
of other texts the plain words do, and any other word goes to the library whole. All this holds for tokenizers with
the normalizer, pre-tokenizer and model kind stated in RULES; with any other file, whole texts go to the library.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np

#: Words and runs that a cache holds before it is emptied; about 200 bytes each.
CACHE_WORDS = 120_000
LONGEST_KEPT = 64
#: Long texts are cut into parts of about so many characters, at white space.
PART_CHARS = 1 << 20

#: What a tokenizer file must say for texts to be cut here as the library cuts them (fixed values).
RULES = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_MARKS = r"!\"#$%&()*+,\-./:;=?@\[\\\]^_`{|}~"
_ODD = re.compile(rf"[^{_LETTERS}0-9{_MARKS} \t\n\r\x0b\x0c]")
_RUNS = re.compile(f"[{_LETTERS}]+|[0-9]|[{_MARKS}]+")
#: Python splits at these, the tokenizer does not.
_SEPARATORS = re.compile("[\x1c-\x1f]")
_SPACE = re.compile(r"\s")


def _byte_letters() -> dict[int, str]:
    """The character that stands for each byte: itself if it can be printed, else the next one from 256 up."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class _Cache(dict):
    """Ids by key, made when first asked for."""

    def __init__(self, make: Callable[[str], bytes]) -> None:
        super().__init__()
        self.make = make

    def __missing__(self, key: str) -> bytes:
        found = self.make(key)
        if len(key) <= LONGEST_KEPT:
            self[key] = found
        return found

    def join(self, keys: list[str]) -> bytes:
        if len(self) > CACHE_WORDS:
            self.clear()
        return b"".join(map(self.__getitem__, keys))


class Words:
    """Ids for one tokenizer file. ids(text) gives a text's ids as little-endian 16-bit numbers."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        if self.whole.get_vocab_size() > 1 << 16:
            raise ValueError("ids must fit 16 bits")
        said = json.loads(Path(path).read_text(encoding="utf-8"))
        self.known = all(said.get(k) == v for k, v in RULES.items()) and said["model"].get("type") == "BPE"
        self.letters = _byte_letters()
        self.words, self.runs = _Cache(self._word), _Cache(self._run)

    def _run(self, run: str) -> bytes:
        spelt = run if run.isascii() else "".join(map(self.letters.__getitem__, run.encode()))
        return b"".join([t.id.to_bytes(2, "little") for t in self.model.tokenize(spelt)])

    def _whole(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u2").tobytes()

    def _word(self, word: str) -> bytes:
        return self._whole(word) if _ODD.search(word) else self.runs.join(_RUNS.findall(word.lower()))

    def ids(self, text: str) -> bytes:
        if not self.known:
            return self._whole(text)
        return b"".join(map(self._part, parts(text)))

    def _part(self, text: str) -> bytes:
        if not _ODD.search(text):
            return self.runs.join(_RUNS.findall(text.lower()))
        if _SEPARATORS.search(text):
            return self._whole(text)
        return self.words.join(text.split())


def parts(text: str) -> Iterator[str]:
    """text, cut at white space where it is long."""
    at = 0
    while len(text) - at > PART_CHARS:
        space = _SPACE.search(text, at + PART_CHARS)
        if space is None:
            break
        yield text[at : space.start()]
        at = space.start()
    yield text[at:] if at else text


_opened: dict[str, Words] = {}


def words_of(path: str) -> Words:
    """One cache for each tokenizer and Python worker."""
    if path not in _opened:
        _opened[path] = Words(path)
    return _opened[path]
