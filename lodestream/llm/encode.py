r"""Exact token ids by the tokenizer libraries, with a bounded cache of encoded words.

A BPE tokenizer first parts a text into pretokens and then encodes each by
itself, so pretokens that recur are encoded once. For the two kinds below the
pattern that parts texts is known, and for characters in ``_SAFE`` (Latin
letters and common punctuation) it is plain: there each pretoken goes to the
library's own model, and ids are cached. Any other text, one that may hold a
special token, and any other tokenizer go to the library whole.

- ``byte``: byte-level BPE with the built-in pattern and no normaliser.
- ``drop``: normaliser that composes, folds white space and lower-cases; a
  pattern of which only the matches are kept.
"""

import json
import os
import re
from functools import lru_cache

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

_LETTERS, _NUMBERS, _BLANKS = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼½¾", "\t\n\x0b\x0c\r \xa0"
#: In these characters classes, composition and lower case are settled and depend on no neighbour.
_SAFE = re.compile("[\t-\r -\x7e\xa0-įı-ɏ‐-‧‰-⁞₠-₿]*").fullmatch
# Fixed value: the pattern that byte-level pre-tokenizers have built in.
_BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Each byte as the character that byte-level vocabularies write it with: printable ones as themselves, others from 256 on.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_CHARS = {b: b for b in _SHOWN} | {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in set(_SHOWN))}


def _spec(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def tokenizer_kind(path: str) -> str:
    if not path.endswith(".json"):
        return "whole"
    spec = _spec(path)
    pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
    if any(not t["content"].startswith("<|") for t in spec.get("added_tokens", [])) or spec["model"]["type"] != "BPE" or spec["model"].get("dropout"):
        return "whole"
    if norm is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"):
        return "byte"
    steps = [n.get("type") for n in (norm or {}).get("normalizers", [])]
    first, *others = pre.get("pretokenizers") or [{}]
    byte_level = [(p.get("type"), p.get("use_regex"), p.get("add_prefix_space")) for p in others] == [("ByteLevel", False, False)]
    if steps == ["NFC", "Replace", "Lowercase"] and norm["normalizers"][1]["pattern"] == {"Regex": "\\s+"} and norm["normalizers"][1]["content"] == " ":
        if first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") and byte_level:
            return "drop"
    return "whole"


def _plain_pattern(pattern: str) -> str:
    """The pattern with its classes spelled out for safe characters."""
    classes = ((r"\p{L}", _LETTERS), (r"\p{N}", _NUMBERS))
    for name, chars in classes:  # those that stand outside brackets
        pattern = re.sub(r"(?<![\[s}])" + re.escape(name), lambda _, c=chars: f"[{c}]", pattern)
    for name, chars in classes:
        pattern = pattern.replace(name, chars)
    pattern = pattern.replace(r"[^\s", f"[^{_BLANKS}")
    return pattern.replace(r"\S", f"[^{_BLANKS}]").replace(r"\s", f"[{_BLANKS}]")


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit bytes; the cache keeps two generations of ``limit`` pretokens."""

    def __init__(self, path: str, limit: int = 300_000):
        self.kind, self.limit = tokenizer_kind(path), limit
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        if path.endswith(".json"):
            from tokenizers import Tokenizer

            tok = Tokenizer.from_file(path)
            tok.no_truncation()
            tok.no_padding()
            self._library = lambda texts: [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]
            self._bpe = tok.model.tokenize
            if self.kind != "whole":
                pattern = _BYTE_PATTERN if self.kind == "byte" else _spec(path)["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
                self._pretokens = re.compile(_plain_pattern(pattern)).findall
        else:
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self._library = lambda texts: model.encode(texts, num_threads=1)

    def _split(self, text: str) -> list[str] | None:
        if self.kind == "whole" or "<|" in text or not _SAFE(text):
            return None
        return self._pretokens(text.lower() if self.kind == "drop" else text)

    def _learn(self, words: set[str]) -> None:
        """Afterwards ``young`` holds all of the words."""
        need = words.difference(self.young)
        if len(self.young) + len(need) > self.limit and self.young:
            self.old, self.young = self.young, {}
            need = words
        for w in need:
            ids = self.old.get(w)
            if ids is None:
                shown = w.encode().decode("latin-1").translate(_BYTE_CHARS)
                ids = np.array([t.id for t in self._bpe(shown)], dtype="<u4").tobytes()
            self.young[w] = ids

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        parts = [(i, self._split(t)) for i, t in enumerate(texts)]
        self._learn(set().union(*(p for _, p in parts if p is not None)))
        get = self.young.__getitem__
        for i, p in parts:
            if p is not None:
                out[i] = b"".join(map(get, p))
        whole = [i for i, p in parts if p is None]
        if whole:
            for i, ids in zip(whole, self._library([texts[i] for i in whole])):
                out[i] = np.asarray(ids, dtype="<u4").tobytes()
        return out

    def encode_column(self, column, rows: int = 64):
        """The ids of each text of an Arrow column, a few rows' strings in memory at a time."""
        for lo in range(0, len(column), rows):
            yield from self.encode(column.slice(lo, rows).to_pylist())


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One per Python worker, kept from task to task."""
    return Encoder(path)
