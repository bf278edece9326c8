"""Token ids of many texts by a tokenizers file, with the words' ids kept between texts.

The library needs about a microsecond a byte here, most of it for words it has
met before.  A text of plain Latin code points is therefore cut at white
space and into the tokenizer's own pre-tokens, and each different one is encoded by the library's model
once for each worker (the kept ones are bounded).  Any other text - other
scripts, unusual white space, special tokens' strings - goes through the
library whole.  Both ways give the library's ids; a file whose normaliser or
pre-tokeniser is another than the one known here always takes the second.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from struct import pack
from functools import cache

import numpy as np

#: Entries kept for each worker and file, of runs and of pre-tokens.
KEPT = 300_000
#: The normaliser and pre-tokeniser for which the short way is right.
KNOWN_NORMALIZER = ["NFC", "Replace", "Lowercase"]
KNOWN_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: Code points that take the short way: printable Latin ones and common punctuation, without those whose lower case isn't one of them.
_PLAIN = [c for a, z in ((0x20, 0x7E), (0xA1, 0x2FF), (0x2010, 0x2015), (0x2018, 0x201E), (0x2020, 0x2022), (0x2026, 0x2026), (0x20AC, 0x20AC)) for c in map(chr, range(a, z + 1))]
_PLAIN = [c for c in _PLAIN if c.lower() in _PLAIN]
_LETTERS = "".join(c for c in _PLAIN if unicodedata.category(c)[0] == "L")
_NUMBERS = "".join(c for c in _PLAIN if unicodedata.category(c)[0] == "N")
_ODD = re.compile(f"[^\\t\\n\\r{re.escape(''.join(_PLAIN))}]")
#: The known split over lower-cased plain text.
_SPLIT = re.compile(rf"[{_LETTERS}]+|[{_NUMBERS}]|'(?:s|t|re|ve|m|ll|d)|[^\s{_LETTERS}{_NUMBERS}]+")


def _byte_letters() -> list[str]:
    """How byte-level BPE writes bytes: printable ones as themselves, the others as U+0100 and on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


_BYTES = _byte_letters()


def default_path() -> str:
    """The word-level BPE file of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder(dict):
    """Run between white space to the bytes of its ids (little-endian, unsigned 32 bits); so ``tokens`` for its pre-tokens."""

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.tokens: dict[str, bytes] = {}
        self.missed = 0
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        split, *after = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        self.known = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])] == KNOWN_NORMALIZER and split.get("pattern", {}).get("Regex") == KNOWN_SPLIT and split.get("invert") is True and [(x["type"], x.get("add_prefix_space"), x.get("use_regex")) for x in after] == [("ByteLevel", False, False)] and not spec.get("post_processor")
        self.special = [x["content"] for x in spec.get("added_tokens", [])]
        self.size = self.library.get_vocab_size()

    def __missing__(self, chunk: str) -> bytes:
        """Of a run between white space: no pre-token crosses that."""
        ids = b"".join(map(self._token, _SPLIT.findall(chunk)))
        if len(self) < KEPT:
            self[chunk] = ids
        else:
            # Full of the words met first, the common ones among them; begun anew when it has missed often enough.
            self.missed += 1
            if self.missed > 8 * KEPT:
                self.missed = 0
                self.clear()
        return ids

    def _token(self, token: str) -> bytes:
        ids = self.tokens.get(token)
        if ids is None:
            written = token if token.isascii() else "".join([_BYTES[b] for b in token.encode()])
            found = [t.id for t in self.model.tokenize(written)]
            ids = pack(f"<{len(found)}I", *found)
            if len(self.tokens) >= KEPT:
                self.tokens.clear()
            self.tokens[token] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers; null is the empty text."""
        if not text:
            return b""
        if self.known and not _ODD.search(text) and not any(x in text for x in self.special):
            return b"".join(map(self.__getitem__, text.lower().split()))
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def forget(path: str) -> None:
    """Drop the kept words; the library's part stays loaded."""
    e = encoder(path)
    e.clear()
    e.tokens.clear()
