"""Texts as stretches that the tokens of no public vocabulary cross, so that each distinct stretch is encoded once.

A text is cut before every blank between two characters that are no white space: byte-level BPE begins a new word there,
and pieces hold a blank at their front only. A stretch is kept without that blank.
"""

from __future__ import annotations

import itertools
import os
import re
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space before a blank: such texts are cut with care.
GAP = re.compile(r"\s ")
CUT = re.compile(r"(?<=\S)(?= )(?=\s*\S)")

#: The same and texts with a blank at an end, for Arrow, whose own white space is ASCII only.
ODD = f"^ | $|[{''.join(f'\\x{{{c:x}}}' for c in range(0x3001) if chr(c).isspace())}] "


def stretches(text: str) -> list[str]:
    """The stretches of a blank and ``text``, each without its first blank; put together with blanks they are the text."""
    if text[:1] != " " and text[-1:] != " " and not GAP.search(text):
        return text.split(" ")
    return [s[1:] for s in CUT.split(f" {text}")]


class Numbers(dict):
    """Numbers keys in the order of their first look-up."""

    def __missing__(self, key: object) -> int:
        self[key] = n = len(self)
        return n


class JoinedTokens:
    """Function from stretches to their byte-level BPE tokens, one after the other, and their numbers. Stretches are put
    together, which is faster, and their tokens told apart by their bytes. ``specials``: whether strings of special
    tokens in a text are these tokens."""

    def __init__(self, model: str, specials: bool, joined: int = 4000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(model)
        self.model.encode_special_tokens = not specials
        self.joined = joined
        self.size = np.array([len(x) for x in byte_tokens(model)], np.int64)

    def __call__(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        flat, counts, n = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], self.joined
        for a in range(0, len(parts), n * 8):
            some = [parts[b : b + n] for b in range(a, min(a + n * 8, len(parts)), n)]
            for mine, ids in zip(some, self.alone([" " + " ".join(x) for x in some]), strict=True):
                ends = np.cumsum([len(x) + 1 if x.isascii() else len(x.encode("utf-8", "surrogatepass")) + 1 for x in mine])
                flat.append(ids)
                counts.append(np.diff(np.searchsorted(np.cumsum(self.size[ids]), ends, "right"), prepend=0))
        return np.concatenate(flat), np.concatenate(counts)

    def alone(self, texts: list[str]) -> list[np.ndarray]:
        """Tokens of whole texts as they are."""
        return [np.array(x.ids, np.int32) for x in self.model.encode_batch_fast(texts, add_special_tokens=False)]


def byte_tokens(model: str) -> list[bytes]:
    """Bytes of the ids of a byte-level vocabulary, which writes bytes without a printable form as later characters."""
    from tokenizers import Tokenizer

    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = [b for b in range(256) if b not in plain]
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}
    t = Tokenizer.from_file(model)
    tokens = (t.id_to_token(i) or "" for i in range(t.get_vocab_size()))
    return [bytes(byte[c] for c in x) if all(c in byte for c in x) else x.encode() for x in tokens]


def split_texts(texts: pa.Array) -> tuple[list[str], pa.Array, np.ndarray]:
    """First stretches of texts, all others one after the other, and where those of each text end; a null is empty."""
    odd = np.flatnonzero(pc.match_substring_regex(texts, ODD).fill_null(False).to_numpy(zero_copy_only=False))
    if len(odd):
        parts = pc.split_pattern(texts, " ").to_pylist()
        for i in odd.tolist():
            parts[i] = stretches(texts[i].as_py())
        lists = pa.array(parts, pa.list_(texts.type))
    else:
        lists = pc.split_pattern(texts, " ")
    sizes = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat, ends = lists.flatten(), np.cumsum(sizes)
    heads = [""] * len(texts)
    some = np.flatnonzero(sizes)
    first = (ends - sizes)[some]
    for i, head in zip(some.tolist(), flat.take(pa.array(first)).to_pylist(), strict=True):
        heads[i] = head
    rest = np.ones(len(flat), bool)
    rest[first] = False
    return heads, flat.filter(pa.array(rest)), np.cumsum(np.maximum(sizes - 1, 0))


class Encoder:
    """Token ids of distinct stretches. Beyond ``most`` of them, those that came in one batch only are forgotten."""

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], most: int = 600_000):
        self.encode, self.most = encode, most
        self.forget()

    def forget(self) -> None:
        self.number = Numbers()
        self.tokens, self.sizes, self.again = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, bool)

    def begin(self) -> None:
        """Before a batch: if there are more than wanted, keep those that came again since the last time, unless these are
        more than half as many."""
        if len(self.number) <= self.most:
            return
        kept, keys = np.flatnonzero(self.again), list(self.number)
        tokens, sizes = self.tokens, self.sizes
        self.forget()
        if len(kept) <= self.most // 2:
            self._look_up((keys[i] for i in kept.tolist()), len(kept))
            self.tokens, self.sizes = gather(tokens, (np.cumsum(sizes) - sizes)[kept], sizes[kept]), sizes[kept]
            self.again = np.zeros(len(kept), bool)

    def _look_up(self, parts: Iterable[str], n: int) -> np.ndarray:
        return np.fromiter(map(self.number.__getitem__, parts), np.int64, n)

    def numbers(self, parts: pa.Array) -> np.ndarray:
        """Numbers of the stretches of a batch, of which each distinct one is looked up once; new ones get the next numbers
        and wait for ``finish``."""
        coded = parts.dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False)  # much faster than a list
        distinct = self._look_up(distinct, len(distinct))
        self.again[distinct[distinct < len(self.again)]] = True
        return distinct[coded.indices.to_numpy()]

    def finish(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tokens of all stretches, one after the other, where each begins and how many it has."""
        if len(self.sizes) < len(self.number):
            tokens, sizes = self.encode(list(itertools.islice(self.number, len(self.sizes), None)))
            self.tokens, self.sizes = np.concatenate([self.tokens, tokens]), np.concatenate([self.sizes, sizes])
            self.again = np.append(self.again, np.zeros(len(sizes), bool))
        return self.tokens, np.cumsum(self.sizes) - self.sizes, self.sizes


def gather(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs ``values[start : start + size]``, one after the other."""
    total = np.cumsum(sizes)
    return values[np.repeat(starts - (total - sizes), sizes) + np.arange(int(total[-1]) if len(total) else 0)]
