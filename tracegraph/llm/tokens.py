"""Token ids of whole texts by a public word tokenizer, word by word from a bounded cache."""

from __future__ import annotations

import json
import os
import re
import unicodedata
from functools import cache

import numpy as np

#: White-space separated words whose ids a worker keeps; the cache starts anew beyond that.
CACHE_WORDS = 400_000

#: New words that the tokenizer gets in one call.
TOGETHER = 200

#: Texts with characters above this go to the tokenizer whole.
PLAIN = 0x24F

#: Control characters that Python splits words at and the tokenizer does not.
SEPARATORS = "\x1c\x1d\x1e\x1f"


class WordIds:
    """Ids as ``tokenizers``' ``encode(text, add_special_tokens=False)`` gives them, as little-endian unsigned 32-bit bytes.

    The tokenizer drops white space and splits text into words before the merges, so ids of a white-space separated word do not
    depend on what stands around it: each such word is encoded once, by the tokenizer, and kept. New words are encoded many at a time,
    joined by blanks; tokens stand for bytes, so the bytes that they stand for must end where each word ends, and where they do not
    the words are encoded one by one. Texts with characters above ``PLAIN``, with ``<|`` (special tokens), with control
    characters that only some libraries call white space, or with a capital dotted I go through the tokenizer whole.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are the parallelism
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.odd = re.compile(f"[^\\x00-{chr(PLAIN)}]|İ").search
        self.cache: dict[str, bytes] = {}
        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        self.bytes_of = np.zeros(max(vocab.values()) + 1, np.int64)  # a character of a byte-level token is a byte
        for t, i in vocab.items():
            self.bytes_of[i] = len(t.removesuffix("</w>"))

    def whole(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, words: set[str]) -> None:
        if len(self.cache) + len(words) > CACHE_WORDS:
            self.cache.clear()
        new = list(words)
        parts = [new[i : i + TOGETHER] for i in range(0, len(new), TOGETHER)]
        for part, found in zip(parts, self.tok.encode_batch_fast([" ".join(p) for p in parts], add_special_tokens=False), strict=True):
            ids = np.array(found.ids, "<u4")
            at, ends = np.cumsum(self.bytes_of[ids]), np.cumsum([len(w.encode()) for w in part])
            stops = np.searchsorted(at, ends, "right")
            if len(ids) and stops[0] and np.array_equal(at[stops - 1], ends) and stops[-1] == len(ids):
                raw, a = ids.tobytes(), 0
                for w, b in zip(part, (4 * stops).tolist(), strict=True):
                    self.cache[w] = raw[a:b]
                    a = b
            else:
                self.cache.update((w, self.whole(w)) for w in part)

    def encode(self, texts: list[str]) -> list[bytes]:
        parts, new, get = [], set(), self.cache.get
        for t in texts:
            if "<|" in t or any(map(t.__contains__, SEPARATORS)) or not t.isascii() and self.odd(t):
                parts.append((None, self.whole(t)))
                continue
            if not t.isascii() and not unicodedata.is_normalized("NFC", t):
                t = unicodedata.normalize("NFC", t)
            words = t.lower().split()
            ids = list(map(get, words))
            if None in ids:
                new.update(w for w, i in zip(words, ids, strict=True) if i is None)
            else:
                words = None
            parts.append((words, ids))
        if new:
            self.learn(new)
        out = []
        for words, ids in parts:
            if words is not None:  # words that the cache had and lost meanwhile keep their ids from above
                ids = [get(w) if i is None else i for w, i in zip(words, ids, strict=True)]
            out.append(ids if isinstance(ids, bytes) else b"".join(ids))
        return out


@cache
def word_ids(path: str) -> WordIds:
    """One per worker process."""
    return WordIds(path)
