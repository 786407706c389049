"""Pre-tokens of a word-BPE vocabulary file, found for whole batches with numpy.

The file's normaliser (NFC, white space, lower case) and its splitting pattern (contractions, runs of letters,
single digits, runs of other signs) are applied as the library applies them; the character classes and the
case table are asked of the library itself, once in each process, so that both agree on every code point.
"""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache

import numpy as np

from ._words import hash_runs

LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 4
#: Fixed values of the vocabulary's splitting pattern.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
_TOP = 0x110000
#: Code points that can be assigned other than to private use; all others are signs without case.
_ASSIGNED = (range(0xD800), range(0xE000, 0x32400), range(0xE0000, 0xE1000))


@lru_cache(maxsize=2)
def vocabulary(path: str):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        raw = json.load(f)
    specials = {x["content"]: x["id"] for x in raw["added_tokens"]}
    return tokenizer, raw["model"], specials


@lru_cache(maxsize=2)
def tables(path: str) -> tuple[np.ndarray, dict[str, str]]:
    """Class of each code point, and the code points that the library lowers differently from ``str.lower``."""
    tokenizer, _, _ = vocabulary(path)
    kinds = np.full(_TOP, OTHER, dtype=np.uint8)
    everything = [c for part in _ASSIGNED for c in part]
    for k in range(0, len(everything), 4096):
        block = everything[k : k + 4096]
        # "!" is neither letter, number nor space, so a piece "!c" tells OTHER; "ac" together tells LETTER.
        for c, kind in zip(block, _kinds(tokenizer, block), strict=True):
            kinds[c] = kind
    lower = {}
    from tokenizers.normalizers import Lowercase

    lowercase = Lowercase()
    for c in everything:
        ch = chr(c)
        if ch.lower() != ch or c > 0x10000:
            if (low := lowercase.normalize_str(ch)) != ch.lower():
                lower[ch] = low
    return kinds, lower


def _kinds(tokenizer, block: list[int]) -> list[int]:
    from tokenizers.pre_tokenizers import Sequence

    split = tokenizer.pre_tokenizer
    split = split[0] if isinstance(split, Sequence) else split
    text = "".join(f"a{chr(c)}a " for c in block)
    at = {}
    for piece, (start, end) in split.pre_tokenize_str(text):
        at[start] = (end, piece)
    out, pos = [], 0
    for c in block:
        first = at.get(pos)
        if first and first[0] == pos + 3:
            out.append(LETTER)
        elif pos + 1 not in at:
            out.append(SPACE)
        else:
            # A run of other signs takes "!" with it, a number doesn't.
            out.append(OTHER if len(split.pre_tokenize_str(f"{chr(c)}!")) == 1 else NUMBER)
        pos += 4
    return out


def normalised(text: str, special: tuple[str, ...], lower: dict[str, str]) -> tuple[str, int]:
    """The text in lower-cased NFC, and how many special strings stood in it (each now a blank)."""
    found = 0
    for s in special:
        if s in text:
            found += text.count(s)
            text = text.replace(s, " ")
    if text.isascii():
        return text.lower(), found
    if not unicodedata.is_normalized("NFC", text):
        text = unicodedata.normalize("NFC", text)
    if "Σ" in text:  # str.lower knows a final sigma, the library doesn't
        text = text.replace("Σ", "σ")
    if lower and not lower.keys().isdisjoint(text):
        text = "".join(lower.get(c, c) for c in text)
    return text.lower(), found


class PreTokens:
    """Pre-tokens of a batch: the batch's UTF-8 bytes without white space, and where each pre-token ends.

    data: bytes of all pre-tokens; last: True at a pre-token's last byte; first[i]:first[i+1]: bytes of text i;
    special[i]: special strings in text i.
    """

    def __init__(self, texts: list[str], path: str):
        kinds, lower = tables(path)
        names = tuple(sorted(vocabulary(path)[2], key=len, reverse=True))
        parts = [normalised(t, names, lower) for t in texts]
        self.special = np.array([n for _, n in parts], dtype=np.int64)
        whole = "\n".join([t for t, _ in parts] + [""])
        raw = np.frombuffer(whole.encode("utf-8"), dtype=np.uint8)
        sizes = np.array([len(t) + 1 for t, _ in parts], dtype=np.int64)
        if len(raw) == len(whole):
            points = raw
            kind = kinds[:256][raw]
        else:
            points = np.frombuffer(whole.encode("utf-32-le"), dtype=np.uint32)
            kind = kinds[points]
        starts = np.empty(len(kind) + 1, dtype=bool)
        starts[0] = starts[-1] = True
        np.not_equal(kind[1:], kind[:-1], out=starts[1:-1])
        starts[:-1] |= kind == NUMBER
        quotes = np.flatnonzero((points == 0x27) & starts[:-1])
        quotes = quotes[starts[quotes + 1]]
        if len(quotes):
            taken = np.zeros(len(quotes), dtype=bool)
            for word in CONTRACTIONS:
                here = ~taken & (quotes + len(word) < len(points))
                for k, ch in enumerate(word):
                    here &= points[np.minimum(quotes + 1 + k, len(points) - 1)] == ord(ch)
                starts[quotes[here] + 1] = False
                starts[quotes[here] + 1 + len(word)] = True
                taken |= here
        ends = starts[1:]
        keep = kind != SPACE
        edges = np.concatenate(([0], np.cumsum(sizes)))
        if len(raw) != len(whole):
            heads = np.flatnonzero((raw & 0xC0) != 0x80)
            width = np.diff(np.append(heads, len(raw)))
            last = np.zeros(len(raw), dtype=bool)
            last[heads + width - 1] = ends
            keep = np.repeat(keep, width)
            edges = np.append(heads, len(raw))[edges]
        else:
            last = ends
        kept = np.concatenate(([0], np.cumsum(keep)))
        self.first = kept[edges]
        self.data, self.last = raw[keep], last[keep]

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Start and end of one occurrence of each distinct pre-token, its 64-bit hash, and which of these each pre-token is."""
        end = np.flatnonzero(self.last) + 1
        start = np.concatenate(([0], end))[:-1]
        hashes, at, which = np.unique(hash_runs(self.data, start, end), return_index=True, return_inverse=True)
        return start[at], end[at], hashes, which
