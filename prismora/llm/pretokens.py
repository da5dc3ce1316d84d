"""Pre-tokens of byte-level BPE tokenizers, and what is known of each: its token count or its ids.

A pre-token is encoded on its own by the library, so a text's tokens are those of its pre-tokens in order.
Added special tokens are cut out first, as the library does by default.
"""

from __future__ import annotations

import functools
import json
import operator
import re
import struct
from collections.abc import Callable

import regex
from tokenizers import Tokenizer

#: The pre-token pattern of byte-level BPE, and its meaning on ASCII texts.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
ASCII_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^ \t-\rA-Za-z0-9]+|[ \t-\r]+(?![^ \t-\r])|[ \t-\r]+"
#: Pre-tokens, and bytes of them, that a Python worker remembers before it starts anew; longer ones than LONG aren't kept.
CACHE, CACHE_BYTES, LONG = 600_000, 32 << 20, 256

#: Characters outside these ranges may be letters in one Unicode version and unassigned in another; texts with such are left to the library.
SETTLED = "\x00-\u0557\u0590-\u088e\u2000-\u206f\u20a0-\u20bf\u3040-\u30ff\u4e00-\u9fea\uac00-\ud7a3\U0001f300-\U0001f5ff"

#: PATTERN for re, which is quicker than regex; it means the same on texts without the characters of _uneven().
PLAIN_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"


def _uneven() -> str:
    """The settled characters that re and regex take for different kinds, letters, numbers or white space."""
    every = "".join(re.findall(f"[{SETTLED}]", "".join(map(chr, (*range(0xD800), *range(0xE000, 0x20000))))))
    kinds = ((r"\p{L}", r"[^\W\d_]"), (r"\p{N}", r"\d"), (r"\s", r"\s"))
    return "".join(sorted(set().union(*(set(regex.findall(a, every)) ^ set(re.findall(b, every)) for a, b in kinds))))


_any, _ascii, _plain = regex.compile(PATTERN), re.compile(ASCII_PATTERN), re.compile(PLAIN_PATTERN)
_unsettled, _uncommon = re.compile(f"[^{SETTLED}]"), re.compile(f"[^{SETTLED}]|[{re.escape(_uneven())}]")


@functools.lru_cache(maxsize=4)
def tokenizer(path: str) -> Tokenizer:
    return Tokenizer.from_file(path)


@functools.lru_cache(maxsize=4)
def specials(path: str) -> dict[str, int]:
    return {t.content: i for i, t in tokenizer(path).get_added_tokens_decoder().items()}


@functools.lru_cache(maxsize=4)
def _cutter(path: str) -> re.Pattern:
    return re.compile("(" + "|".join(map(re.escape, sorted(specials(path), key=len, reverse=True))) + ")")


def pre_tokens(text: str, path: str) -> list[str]:
    """A special token's string is a pre-token of its own."""
    if not supported(path):
        find = lambda part: [part[a:b] for _, (a, b) in tokenizer(path).pre_tokenizer.pre_tokenize_str(part)]
    elif text.isascii():
        find = _ascii.findall
    elif _uncommon.search(text) is None:
        find = _plain.findall
    elif _unsettled.search(text) is None:
        find = _any.findall
    else:
        find = lambda part: [part[a:b] for _, (a, b) in tokenizer(path).pre_tokenizer.pre_tokenize_str(part)]
    known = specials(path)
    if not any(s in text for s in known):
        return find(text)
    out: list[str] = []
    for part in _cutter(path).split(text):
        out += [part] if part in known else find(part)
    return out


def _shown() -> dict[str, str]:
    """The characters by which byte-level tokenizers show bytes: printable ones of Latin-1 are themselves, the others follow from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): chr(b) for b in own} | {chr(b): chr(256 + k) for k, b in enumerate(rest)}


_SHOWN = str.maketrans(_shown())


@functools.lru_cache(maxsize=4)
def encoder(path: str) -> Callable[[str], list[int]]:
    """Gives the ids of a pre-token. Where the tokenizer only cuts and shows bytes before its merges, its model is asked at once."""
    known, encode = specials(path), tokenizer(path).encode
    if not supported(path):
        return lambda t: [known[t]] if t in known else encode(t, add_special_tokens=False).ids
    tokenize = tokenizer(path).model.tokenize

    def ids(t: str) -> list[int]:
        if t in known:
            return [known[t]]
        return [x.id for x in tokenize((t if t.isascii() else t.encode().decode("latin-1")).translate(_SHOWN))]

    return ids


#: Packs few ids at once.
_PACKED = [struct.Struct(f"<{n}I").pack for n in range(16)]


class Lengths(dict):
    """Token counts: the given table of frequent pre-tokens first, then this worker's cache, then the tokenizer."""

    def __init__(self, path: str, frequent: dict[str, int]) -> None:
        super().__init__(frequent)
        self.path, self.cache, self.size = path, {}, 0
        self.encode = encoder(path)

    def __missing__(self, pre_token: str) -> int:
        if (n := self.cache.get(pre_token)) is None:
            n = len(self.encode(pre_token))
            if len(pre_token) <= LONG:
                if len(self.cache) >= CACHE or self.size >= CACHE_BYTES:
                    self.cache.clear()
                    self.size = 0
                self.cache[pre_token] = n
                self.size += len(pre_token)
        return n


class Ids(dict):
    """The ids of a pre-token as little-endian unsigned 32-bit numbers."""

    def __init__(self, path: str) -> None:
        super().__init__()
        self.path, self.size = path, 0
        self.encode = encoder(path)

    def __missing__(self, pre_token: str) -> bytes:
        ids = self.encode(pre_token)
        got = _PACKED[len(ids)](*ids) if len(ids) < len(_PACKED) else struct.pack(f"<{len(ids)}I", *ids)
        if len(pre_token) <= LONG:
            if len(self) >= CACHE or self.size >= CACHE_BYTES:
                self.clear()
                self.size = 0
            self[pre_token] = got
            self.size += len(pre_token) + len(got)
        return got

    def of(self, text: str) -> bytes:
        found = pre_tokens(text, self.path)
        return b"".join(operator.itemgetter(*found)(self)) if len(found) > 1 else b"".join(map(self.__getitem__, found))


@functools.lru_cache(maxsize=4)
def ids_of(path: str) -> Ids:
    """One cache for each worker process, kept from task to task."""
    return Ids(path)


@functools.lru_cache(maxsize=4)
def supported(path: str) -> bool:
    """Whether the tokenizer cuts texts as PATTERN does, before its merges: byte-level, without a normalizer or a space of its own in front."""
    state = json.loads(tokenizer(path).to_str())
    cut = state.get("pre_tokenizer") or {}
    return state.get("normalizer") is None and (state.get("model") or {}).get("type") == "BPE" and cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True)


def lengths_of(pre: list[str], path: str) -> dict[str, int]:
    """The token counts of pre-tokens, each as a text of its own."""
    known = specials(path)
    return {t: 1 if t in known else len(e.ids) for t, e in zip(pre, tokenizer(path).encode_batch(pre, add_special_tokens=False))}
