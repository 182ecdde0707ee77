"""A public tokenizer behind a cache of word parts; the ids are those of encoding each whole text."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator, Sequence
from functools import lru_cache
from pathlib import Path

import numpy as np

#: Texts of these characters only can be taken apart between runs of letters or digits and runs of other marks: the
#: tokenizer's own rules break there too, and lower-casing needs no context. All of U+00C0 to U+00FF but the two signs
#: are letters.
_PLAIN = re.compile("[\\x20\\t\\r\\n!-&(-~À-ÖØ-öø-ÿ]*")
_PARTS = re.compile("[a-z0-9ß-öø-ÿ]+|[!-&(-/:-@\\[-`{-~]+")
_ONE_WORD = re.compile("[a-zß-öø-ÿ]+|[!-&(-/:-@\\[-`{-~]+")
_SPACES = {9: 32, 10: 32, 13: 32}


#: The rules of the vocabulary file for which words may be learned one by one. Others encode each text as a whole.
_RULES = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
_MODEL = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": "</w>", "fuse_unk": False, "byte_fallback": False, "ignore_merges": False}


def known_rules(rules: dict) -> bool:
    """Whether white space separates and is dropped, words are encoded alone, and added tokens are found in the raw text only."""
    plain = all(not t.get(k) for t in rules.get("added_tokens") or [] for k in ("single_word", "lstrip", "rstrip", "normalized"))
    return plain and all(rules.get(k) == v for k, v in _RULES.items()) and all(rules["model"].get(k) == v for k, v in _MODEL.items()) and not rules.get("truncation")


@lru_cache(maxsize=1)
def word_cache(path: str) -> WordCache:
    """One for all tasks that a Python worker runs, so that tables are loaded and words learned once."""
    return WordCache(path)


class WordCache:
    """``encode`` gives little-endian unsigned 32-bit ids as bytes: those that the tokenizer gives each whole text, no special tokens added.

    Made for word-level BPE with word ends, where white space separates and is dropped; a vocabulary file with other
    rules, and a text that holds the string of an added token, go to the tokenizer as they are. ``limit`` bounds the
    parts that are kept: at half of it a new generation begins, which takes over what is used again.
    """

    def __init__(self, path: str, limit: int = 400_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are parallel already
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        rules = json.loads(Path(path).read_text(encoding="utf-8"))
        self.by_words = known_rules(rules)
        contents = [t["content"] for t in rules.get("added_tokens") or []]
        self.added = re.compile("|".join(map(re.escape, contents)) if contents else r"(?!)")
        if not self.by_words:
            return
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.ends[[i for w, i in vocab.items() if w.endswith("</w>")]] = True
        self.limit, self.known, self.before, self.words = limit, {"": b""}, {}, self._word_encoder(rules["model"])

    @staticmethod
    def _word_encoder(model: dict):
        """The same merges without the rules for text, and without a cache of its own: for words that need no rules."""
        from tokenizers import Tokenizer, models, pre_tokenizers

        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        found = Tokenizer(models.BPE(vocab=model["vocab"], merges=merges, cache_capacity=0, end_of_word_suffix="</w>", fuse_unk=False))
        found.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        return found

    def _learn(self, parts: set[str]) -> None:
        simple = [w for w in parts if _ONE_WORD.fullmatch(w)]
        if simple:
            ids = np.array(self.words.encode_batch_fast([" ".join(simple)], add_special_tokens=False)[0].ids, dtype="<u4")
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) == len(simple):  # one word end for each
                buffer, stops = ids.tobytes(), (stops * 4).tolist()
                self.known.update(zip(simple, (buffer[a:b] for a, b in zip([0, *stops], stops))))
            else:
                simple = []
        rest = parts.difference(simple) if simple else parts
        for w in rest:
            self.known[w] = self.whole(w)

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def encode(self, texts: Sequence[str]) -> Iterator[bytes]:
        if not self.by_words:
            yield from map(self.whole, texts)
            return
        for i in range(0, len(texts), 256):
            # None: to be encoded as a whole
            split = [None if self.added.search(t) else _PARTS.findall(t.lower()) if _PLAIN.fullmatch(t) else t.translate(_SPACES).split(" ") for t in texts[i : i + 256]]
            if len(self.known) > self.limit // 2:
                self.before, self.known = self.known, {"": b""}
            missing = set().union(*filter(None, split)).difference(self.known)
            if again := missing & self.before.keys():
                self.known.update((w, self.before[w]) for w in again)
                missing -= again
            if missing:
                self._learn(missing)
            for text, parts in zip(texts[i : i + 256], split):
                yield self.whole(text) if parts is None else b"".join(map(self.known.__getitem__, parts))
