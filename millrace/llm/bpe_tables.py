"""Byte-pair merge tables read from a tokenizer file, shared by the encoding and counting operators.

A table is loaded once per Python worker (``load`` caches by path) and never leaves it, so a task ships only the path.
"""

from __future__ import annotations

import json
import re
import unicodedata
from dataclasses import dataclass, field
from functools import lru_cache

import regex

# The pre-tokenizer patterns that the two public vocabularies are defined with.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: A code point that no Unicode version assigns a class to; it stands in for newer ones while spans are found.
UNASSIGNED = "͸"


def resolved(path: str) -> str:
    """The file itself. A bare name is one of the public vocabularies, looked up on the machine that asks, driver or executor."""
    if "/" in path:
        return path
    import public_tokenizers

    return public_tokenizers.path(path)


@lru_cache(1)
def byte_alphabet() -> tuple[str, ...]:
    """The printable character that stands for each byte: printable Latin-1 bytes stand for themselves, the rest follow U+0100."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return tuple(chr(b) if b in printable else chr(next(spare)) for b in range(256))


@lru_cache(1)
def newer_code_points() -> regex.Pattern:
    """Code points that the ``regex`` module classifies but the tokenizers library, whose Unicode tables are older, does not."""
    assigned = regex.compile(r"[\p{L}\p{N}\s]")
    spans: list[list[int]] = []
    for c in range(0x0378, 0x110000):
        ch = chr(c)
        if unicodedata.category(ch) == "Cn" and assigned.match(ch):
            if spans and spans[-1][1] == c - 1:
                spans[-1][1] = c
            else:
                spans.append([c, c])
    body = "".join(f"{chr(a)}-{chr(b)}" for a, b in spans)
    return regex.compile(f"[{body}]") if body else regex.compile(r"(?!)")


def is_latin1(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


@dataclass
class MergeTable:
    """Vocabulary, merge ranks and pre-tokenizer of one byte-level tokenizer file."""

    path: str
    pattern: regex.Pattern
    special: dict[str, int]
    suffix: str
    folds: bool  # NFC, one space for white space, lower case
    drops_space: bool
    #: (left id, right id) packed as left << 32 | right -> (rank << 32 | merged id)
    merges: dict[int, int]
    #: id of each byte, and of each byte at the end of a word
    first: list[int]
    last: list[int]
    token_bytes: list[bytes]
    special_split: re.Pattern | None
    _lookahead: int = field(default=-1)

    @property
    def lookahead(self) -> int:
        if self._lookahead < 0:
            self._lookahead = sufficient_lookahead(self.merges, [len(b) for b in self.token_bytes])
        return self._lookahead

    def pieces(self, text: str) -> list[str]:
        """The pre-tokens of a text without special tokens in it, as the library's pre-tokenizer finds them."""
        if is_latin1(text) or not (newer := newer_code_points()).search(text):
            return self.pattern.findall(text)
        return [text[m.start() : m.end()] for m in self.pattern.finditer(newer.sub(UNASSIGNED, text))]

    def spans(self, text: str):
        """Like ``pieces``, but lazily and as (start, end), for texts too long to list."""
        if not is_latin1(text):
            text = newer_code_points().sub(UNASSIGNED, text)
        return (m.span() for m in self.pattern.finditer(text))

    def fold(self, word: str) -> str:
        """The normalizer of the file. Letters newer than Python's tables go through the library's own."""
        if not self.folds:
            return word
        if is_latin1(word):
            return word.lower()
        return library_tokenizer(self.path).normalizer.normalize_str(word)

    def segments(self, text: str):
        """(is_special, part) for each part of the text; special strings are found leftmost and longest first."""
        if self.special_split is None or "<|" not in text:
            if text:
                yield False, text
            return
        at = 0
        for m in self.special_split.finditer(text):
            if m.start() > at:
                yield False, text[at : m.start()]
            yield True, m[0]
            at = m.end()
        if at < len(text):
            yield False, text[at:]


def sufficient_lookahead(merges: dict[int, int], lengths: list[int]) -> int:
    """Bytes to the right of a position that settle whether the final tokens have a boundary there.

    A merge (u, v) across a position is stopped from the right only if something on v's right edge was merged away
    earlier, that is by a rule (x, y) of lower rank than the rule that consumes x; and whether that happened depends in
    turn on y. Ranks fall along such a chain, so one pass over the rules in rank order gives each rule's reach:
    reach(u, v) = len(v) + the largest reach of a rule (x, .) that can come before x is consumed, x on v's right edge.
    The bound is the largest reach plus one byte, so that equal-rank ties at the edge are inside it as well.
    """
    best: dict[int, int] = {}  # left symbol -> largest reach so far, in rank order
    edge: dict[int, int] = {}  # merged symbol -> largest reach of an earlier rule that takes from its right edge
    most = 0
    for packed, value in sorted(merges.items(), key=lambda kv: kv[1]):
        left, right, made = packed >> 32, packed & 0xFFFFFFFF, value & 0xFFFFFFFF
        takes = max(best.get(right, 0), edge.get(right, 0))
        edge[made] = max(edge.get(made, 0), takes)
        reach = lengths[right] + takes
        best[left] = max(best.get(left, 0), reach)
        most = max(most, reach)
    return most + 1


@lru_cache(4)
def library_tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(resolved(path))


@lru_cache(4)
def load(path: str) -> MergeTable:
    with open(resolved(path), encoding="utf-8") as f:
        spec = json.load(f)
    model, pre, norm = spec["model"], spec["pre_tokenizer"], spec["normalizer"]
    if model["type"] != "BPE" or model.get("byte_fallback") or model.get("ignore_merges"):
        raise ValueError(f"{path}: only byte-level BPE files are supported")
    if pre["type"] == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"]:
        pattern = BYTE_LEVEL_PATTERN
    elif pre["type"] == "Sequence" and pre["pretokenizers"][0]["type"] == "Split":
        pattern = pre["pretokenizers"][0]["pattern"]["Regex"]
    else:
        raise ValueError(f"{path}: unknown pre-tokenizer")
    vocab: dict[str, int] = model["vocab"]
    suffix = model.get("end_of_word_suffix") or ""
    merges: dict[int, int] = {}
    for rank, pair in enumerate(model["merges"]):
        a, b = pair if isinstance(pair, list) else pair.split(" ")
        merges[vocab[a] << 32 | vocab[b]] = rank << 32 | vocab[a + b]
    alphabet = byte_alphabet()
    back = {ch: b for b, ch in enumerate(alphabet)}
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    token_bytes = [b""] * (max([*vocab.values(), *special.values()]) + 1)
    for token, i in vocab.items():
        body = token.removesuffix(suffix) if suffix else token
        token_bytes[i] = bytes(back[c] for c in body)
    for token, i in special.items():
        token_bytes[i] = token.encode()
    split = re.compile("|".join(re.escape(t) for t in sorted(special, key=len, reverse=True))) if special else None
    return MergeTable(
        path=path,
        pattern=regex.compile(pattern),
        special=special,
        suffix=suffix,
        folds=norm is not None,
        drops_space=pre["type"] == "Sequence",
        merges=merges,
        first=[vocab[c] for c in alphabet],
        last=[vocab[c + suffix] for c in alphabet],
        token_bytes=token_bytes,
        special_split=split,
    )
