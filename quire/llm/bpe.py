"""Exact token counts at every prefix of a text, for byte-level BPE vocabularies (.json).

Dynamic programming over the bytes of a pre-token: the encoding of a prefix ends in token ``t``
exactly if ``t`` follows the last token of the encoding of what is before it, that is if the two
joined encode to just these two. So one pass finds, for every prefix, its last token and its
count. Pre-tokens repeat, so their totals are kept (``KEPT`` at most; then afresh).

The counts of a text's prefixes are those of its pre-tokens added up, with three exceptions at the
cut: a run of white space that ends the prefix is one pre-token, a contraction cut in its middle
falls apart, and a special string cut in its middle is ordinary text.
"""

from __future__ import annotations

import json
from functools import lru_cache
from itertools import accumulate

import numpy as np
import regex

KEPT = 1 << 20

# The published pre-token pattern of the vocabulary.
PRETOKEN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
            r"|\p{White_Space}+(?![^\p{White_Space}])|\p{White_Space}+")
_CUT = {"'re", "'ve", "'ll"}
_SPACES = regex.compile(r"\p{White_Space}+")


def _byte_of() -> dict[str, int]:
    """The printable stand-in that the file uses for every byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class _Totals(dict):
    """Tokens per pre-token, found when first asked for."""

    def __init__(self, find) -> None:
        super().__init__()
        self.find = find

    def __missing__(self, word: str) -> int:
        if len(self) >= KEPT:
            self.clear()
        self[word] = n = self.find(word.encode())[-1]
        return n


class PrefixCounts:
    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if (model["type"] != "BPE" or pre["type"] != "ByteLevel" or spec["normalizer"]
                or pre.get("add_prefix_space") or model.get("ignore_merges")
                or any(model.get(k) for k in ("dropout", "continuing_subword_prefix",
                                              "end_of_word_suffix", "byte_fallback"))):
            raise ValueError("only plain byte-level BPE vocabularies are supported")
        stand = _byte_of()
        raw = lambda s: bytes(stand[c] for c in s)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.rank = {(raw(a), raw(b)): i for i, (a, b) in enumerate(pairs)}
        made = [*(bytes([b]) for b in range(256)), *(a + b for a, b in self.rank)]
        self.number = {t: i for i, t in enumerate(dict.fromkeys(made))}
        self.token = list(self.number)
        self.longest = max(map(len, self.token))
        self.specials = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = (regex.compile("|".join(map(regex.escape, self.specials)))
                        if self.specials else None)
        self.split = regex.compile(PRETOKEN).findall
        self.follows: dict[int, bool] = {}
        self.totals = _Totals(self._of_bytes)

    def _may_follow(self, m: int, n: int) -> bool:
        """Do the tokens numbered m and n, joined, encode to just these two? Merges by rank,
        leftmost first. The answer is kept in ``follows``."""
        a, b = self.token[m], self.token[n]
        parts = [bytes([x]) for x in a + b]
        while len(parts) > 1:
            ranks = [self.rank.get(p, 1 << 60) for p in zip(parts, parts[1:], strict=False)]
            low = min(ranks)
            if low == 1 << 60:
                break
            i = ranks.index(low)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        if len(self.follows) >= KEPT:
            self.follows.clear()
        self.follows[m * len(self.token) + n] = out = parts == [a, b]
        return out

    def _of_bytes(self, word: bytes) -> list[int]:
        """Tokens of word[:i] for i from 0."""
        number, follows, size = self.number, self.follows, len(self.token)
        last, count = [0], [0]
        for i in range(1, len(word) + 1):
            for j in range(max(0, i - self.longest), i):
                t = number.get(word[j:i])
                if t is None:
                    continue
                if j:
                    ok = follows.get(last[j] * size + t)
                    if not (self._may_follow(last[j], t) if ok is None else ok):
                        continue
                last.append(t)
                count.append(count[j] + 1)
                break
        return count

    def of_pretoken(self, word: str) -> list[int]:
        """Tokens of word[:i] for i from 0, as if it were one pre-token."""
        raw = word.encode()
        count = self._of_bytes(raw)
        if len(raw) > len(word):
            return [count[i] for i in accumulate((len(c.encode()) for c in word), initial=0)]
        return count

    def _plain_total(self, text: str) -> int:
        return sum(map(self.totals.__getitem__, self.split(text)))

    def _parts(self, text: str) -> list[tuple[bool, str]]:
        """(is special, string) pieces in order."""
        if not self.special or not self.special.search(text):
            return [(False, text)]
        out, at = [], 0
        for m in self.special.finditer(text):
            out += [(False, text[at:m.start()]), (True, m[0])]
            at = m.end()
        return [*out, (False, text[at:])]

    def total(self, text: str) -> int:
        return sum(1 if special else self._plain_total(part) for special, part in self._parts(text))

    def _fill(self, words: list[str], before: str = "") -> np.ndarray:
        """Tokens added by each prefix of the joined pre-tokens, ``before`` standing ahead."""
        out = np.zeros(sum(map(len, words)) + 1, dtype=np.int64)
        base = at = 0
        for w in words:
            c = self.of_pretoken(w)
            end = at + len(w)
            out[at + 1:end + 1] = c[1:]
            out[at + 1:end + 1] += base
            if len(w) == 3 and w in _CUT:
                out[at + 2] = base + self.of_pretoken(w[0])[-1] + self.of_pretoken(w[1])[-1]
            if before and _SPACES.match(w) and _SPACES.fullmatch(before):
                run = self.of_pretoken(before + w[0])[-1]
                out[at + 1] = base - self.of_pretoken(before)[-1] + run
            base, at, before = base + c[-1], end, w
        return out

    def prefixes(self, text: str) -> np.ndarray:
        """``out[i]`` is the number of tokens of text[:i]."""
        out, base = [np.zeros(1, dtype=np.int64)], 0
        parts = self._parts(text)
        for k, (special, part) in enumerate(parts):
            if special:
                before = parts[k - 1][1] if k and not parts[k - 1][0] else ""
                under = base - self._plain_total(before)
                out.append(np.array([*(under + self._plain_total(before + part[:i])
                                       for i in range(1, len(part))), base + 1]))
                base += 1
            else:
                out.append(base + self._fill(self.split(part))[1:])
                base += self._plain_total(part)
        return np.concatenate(out)

    def total_and_fit(self, text: str, limit: int) -> tuple[int, int]:
        """Tokens of the text, and characters of its longest prefix of at most ``limit`` tokens."""
        if self.special and self.special.search(text):
            c = self.prefixes(text)
            return int(c[-1]), int(np.flatnonzero(c <= limit)[-1])
        words = self.split(text)
        counts = list(map(self.totals.__getitem__, words))
        total = sum(counts)
        if total <= limit:
            return total, len(text)
        # a prefix that ends three pre-tokens after the limit is passed holds more than the limit
        over = next(i for i, c in enumerate(accumulate(counts)) if c > limit)
        lo, hi = max(0, over - 3), min(len(words), over + 4)
        c = sum(counts[:lo]) + self._fill(words[lo:hi], words[lo - 1] if lo else "")
        return total, sum(map(len, words[:lo])) + int(np.flatnonzero(c <= limit)[-1])


@lru_cache(maxsize=2)
def counter(path: str) -> PrefixCounts:
    return PrefixCounts(path)
