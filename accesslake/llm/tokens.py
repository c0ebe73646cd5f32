"""Token ids of whole texts by the tokenizers library, with a cache of words.

A text is cut where the tokenizer's own pre-tokenizer always cuts (before a lone space, around a lone line feed, or at
either when white space is dropped), so each word's ids are found once and looked up afterwards. Texts for which that isn't certain,
and tokenizers of another kind, are encoded whole.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from array import array

CACHED_WORDS = 800_000
_UNSURE = re.compile(r"\s[ \n]|[ \n]\s|\0")  # white space in longer runs
_TAIL = ".,;:!?"


class Encoder:
    """``encode(texts)`` gives each text's ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            about = json.load(file)
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.special = [x["content"] for x in about.get("added_tokens", [])]
        before, form = about.get("pre_tokenizer") or {}, about.get("normalizer")
        steps = [x.get("type") for x in before.get("pretokenizers", [])]
        forms = [x.get("type") for x in (form or {}).get("normalizers", [])]
        bpe = about["model"].get("type") == "BPE"
        self.kind = "whole"
        if bpe and form is None and before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space"):
            self.kind = "spaces"
        elif bpe and forms == ["NFC", "Replace", "Lowercase"] and steps == ["Split", "ByteLevel"] and about.get("post_processor") is None:
            self.kind = "words"
        self.model, self.cache, self.cores, self.letters = self.tokenizer.model, {}, {}, {}

    def _letters(self, text: str) -> str:
        """``text`` in the byte alphabet of the model."""
        if text.isascii():
            return text
        for c in set(text).difference(self.letters):
            self.letters[c] = c if c.isascii() else "".join(x for x, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(c))
        return "".join([self.letters[c] for c in text])

    def _core(self, word: str) -> bytes | None:
        """Ids of an optional space and letters alone, by the model; None for anything else."""
        letters = word[1:] if self.kind == "spaces" and word[:1] == " " else word
        if not letters.isalpha():
            return None
        if self.kind == "words":
            small = letters.lower()
            if not letters.isascii() and (len(small) != len(letters) or "Σ" in letters or not unicodedata.is_normalized("NFC", letters)):
                return None
            text = self._letters(small)
        else:
            text = self._letters(letters)
            text = "Ġ" + text if len(letters) < len(word) else text
        return array("I", [x.id for x in self.model.tokenize(text)]).tobytes()

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [array("I", x.ids).tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def _learn(self, words: list[str]) -> None:
        """Caches the ids of ``words``; a tail is glued only onto letters that ``_core`` encoded, so ids never depend on earlier texts."""
        cache, cores, rest, halves = self.cache, self.cores, [], []
        for word in words:
            core = word.rstrip(_TAIL)
            ids = cores.get(core)
            if ids is None and (ids := self._core(core)) is not None:
                cores[core] = ids
            if ids is None:
                rest.append(word)
            elif len(core) == len(word):
                cache[word] = ids
            else:
                halves.append((word, ids, word[len(core) :]))
        tails = list({t for _, _, t in halves}.difference(cache))
        for word, ids in zip(rest + tails, self._whole(rest + tails)):
            cache[word] = ids
        for word, ids, tail in halves:
            cache[word] = ids + cache[tail]

    def forget(self) -> None:
        """Empties the cache, which a worker would else hold on to while it runs other tasks."""
        self.cache.clear()
        self.cores.clear()

    def _cut(self, text: str) -> list[str]:
        if self.kind == "words":
            return text.replace("\n", " ").split(" ")
        return text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list = [None] * len(texts)
        whole, cut = [], []
        for i, text in enumerate(texts):
            if self.kind == "whole" or any(s in text for s in self.special) or (self.kind == "spaces" and _UNSURE.search(text)):
                whole.append(i)
            else:
                cut.append(i)
        for i, ids in zip(whole, self._whole([texts[i] for i in whole])):
            out[i] = ids
        for i in cut:
            words = self._cut(texts[i])
            missing = set(words).difference(self.cache)
            if missing:
                if len(self.cache) + len(missing) > CACHED_WORDS:
                    self.forget()
                    missing = set(words)
                self._learn(list(missing))
            out[i] = b"".join([self.cache[w] for w in words])
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder a worker and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
