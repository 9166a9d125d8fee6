"""SentencePiece encoding and decoding by suffix-array matching, for BPE models with byte fallback.

Texts are split where no piece can reach across (before a run of blanks that follows something else, around characters
that stand alone in the vocabulary), and the distinct parts of a batch are concatenated, block by block. A suffix array
indexes the block; a binary search for every piece of the vocabulary gives its range of occurrences; the resulting
edges (place, length, piece) are sorted by place. Relaxing the edges then joins neighbours, the best score first and
the leftmost of equals, until no edge joins any two: the segmentation that the model defines. Parts that share a block
are relaxed together, one join each a round.

Defined cases: null and empty texts have no tokens and decode to the empty text; characters outside the vocabulary
become the tokens of their UTF-8 bytes; U+2581 counts as a blank, as in the model; repeated rows are encoded each;
parts of more than ``BLOCK`` characters are indexed block by block and cut where no piece reaches across, and what has
no such place for more than a block is relaxed as a whole in about 100 bytes a character; other columns are ignored. Decoding takes ids of
control pieces as nothing and replaces bytes that are no UTF-8.
"""

from __future__ import annotations

import heapq
import itertools
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table

#: The model is a parameter; this place of the public vocabulary is only the default.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BLANK = "▁"
#: Characters of distinct parts that are indexed at a time; texts that are put together at a time.
BLOCK, GROUP = 1 << 20, 256
#: Longer parts are relaxed one by one with a heap.
LONG = 64
LONGEST = 16


@dataclass
class Vocabulary:
    """What encoding and decoding need of a model; its size is that of the vocabulary."""

    pieces: list[str]
    scores: list[float]
    special: list[int]  # control and unknown pieces
    byte: list[int]  # id of each byte

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.vocab_size())
        special = [i for i in ids if model.is_control(i) or model.is_unknown(i)]
        byte = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        return cls([model.id_to_piece(i) for i in ids], [model.get_score(i) for i in ids], special, byte)


def _pack(codes: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """The ``LONGEST`` 16-bit codes from each place on as big-endian 64-bit words."""
    padded = np.concatenate([codes, np.zeros(LONGEST, codes.dtype)]).astype(np.uint64)
    n = len(codes)
    w = (padded[:n] << np.uint64(48)) | (padded[1 : n + 1] << np.uint64(32)) | (padded[2 : n + 2] << np.uint64(16)) | padded[3 : n + 3]
    w = np.concatenate([w, np.zeros(LONGEST, np.uint64)])
    return [w[at + 4 * j] for j in range(LONGEST // 4)]


def _bisect(keys: list[np.ndarray], wanted: list[np.ndarray], right: bool) -> np.ndarray:
    """Binary search of many several-word keys at once."""
    lo, hi = np.zeros(len(wanted[0]), np.int64), np.full(len(wanted[0]), len(keys[0]))
    while (lo < hi).any():
        mid = np.minimum((lo + hi) // 2, len(keys[0]) - 1)
        less, open_ = np.zeros(len(lo), bool), np.ones(len(lo), bool)
        for k, w in zip(keys, wanted, strict=True):
            x = k[mid]
            less |= open_ & (x < w)
            open_ &= x == w
        go = (less | open_ if right else less) & (lo < hi)
        hi = np.where(go | (lo >= hi), hi, mid)
        lo = np.where(go, mid + 1, lo)
    return lo


class Matcher:
    """Encodes distinct parts of texts with one vocabulary."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        skip = {*vocabulary.special, *vocabulary.byte}
        self.ids = np.array([i for i, p in enumerate(vocabulary.pieces) if i not in skip and len(p) <= LONGEST], np.int32)
        texts = [vocabulary.pieces[i] for i in self.ids]
        if any(len(p) > LONGEST for i, p in enumerate(vocabulary.pieces) if i not in skip):
            raise ValueError(f"pieces of more than {LONGEST} characters are not supported")
        self.scores = np.array(vocabulary.scores, np.float32)
        alphabet = sorted({c for p in texts for c in p})
        self.code = np.zeros(0x110000, np.uint16)  # 0: not in the vocabulary
        self.code[[ord(c) for c in alphabet]] = np.arange(1, len(alphabet) + 1)
        self.sizes = np.array([len(p) for p in texts])
        flat = self.code[np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)]
        grid = np.zeros((len(texts), LONGEST), np.uint16)
        grid[np.arange(LONGEST) < self.sizes[:, None]] = flat
        full = np.where(np.arange(LONGEST) < self.sizes[:, None], grid, np.uint16(0xFFFF))
        self.low, self.high = ([self._words(g[:, 4 * j : 4 * j + 4]) for j in range(LONGEST // 4)] for g in (grid, full))
        joined = {c for p in texts if len(p) > 1 for c in p}
        lone = "" if "\n" in joined else "\n"
        if any(BLANK in p.lstrip(BLANK) for p in texts):
            raise ValueError("pieces with a blank after another character are not supported")
        self.split = re.compile(f" *[^ {lone}]+| +|{lone}" if lone else " *[^ ]+| +")
        self.piece = dict(zip(texts, self.ids.tolist(), strict=True))

    @staticmethod
    def _words(g: np.ndarray) -> np.ndarray:
        g = g.astype(np.uint64)
        return (g[:, 0] << np.uint64(48)) | (g[:, 1] << np.uint64(32)) | (g[:, 2] << np.uint64(16)) | g[:, 3]

    def parts(self, text: str) -> Iterable[str]:
        text = " " + text.replace(BLANK, " ") if text else ""
        return self.split.findall(text) if len(text) < BLOCK else (m[0] for m in self.split.finditer(text))

    def edges(self, codes: np.ndarray) -> np.ndarray:
        """Piece by place and length, -1 where there is none: suffix array, ranges of all pieces, edges by place."""
        at = np.flatnonzero(codes)
        keys = _pack(codes, at)
        order = np.lexsort(keys[::-1])
        suffixes, keys = at[order], [k[order] for k in keys]
        out = np.full((len(codes), LONGEST + 1), -1, np.int32)
        if not len(at):
            return out
        lo, hi = _bisect(keys, self.low, False), _bisect(keys, self.high, True)
        count = hi - lo
        piece = np.repeat(np.arange(len(count)), count)
        place = suffixes[np.arange(len(piece)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)]
        by_place = np.argsort(place)
        place, piece = place[by_place], piece[by_place]
        out[place, self.sizes[piece]] = self.ids[piece]
        return out

    def encode(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all parts, one after the other, and their number for each part."""
        flat, counts, block, size = [], [], [], 0

        def flush() -> None:
            nonlocal block, size
            if block:
                tokens, n = self._block(block)
                flat.append(tokens)
                counts.append(n)
            block, size = [], 0

        for p in parts:
            if len(p) > BLOCK:
                flush()
                tokens = self._huge(p)
                flat.append(tokens)
                counts.append([len(tokens)])
                continue
            if size + len(p) >= BLOCK:
                flush()
            block.append(p)
            size += len(p) + 1
        flush()
        return (np.concatenate(flat), np.concatenate(counts)) if flat else (np.zeros(0, np.int32), np.zeros(0, np.int64))

    def _huge(self, part: str) -> np.ndarray:
        """Tokens of a part of more than a block: cut where no piece reaches across."""
        part = part.replace(" ", BLANK)
        reach = np.zeros(len(part), np.uint32)  # the lengths of the pieces from each place on, as bits
        bits = (np.uint32(1) << np.arange(LONGEST + 1, dtype=np.uint32)).astype(np.uint32)
        for a in range(0, len(part), BLOCK):
            points = np.frombuffer(part[a : a + BLOCK + LONGEST].encode("utf-32-le", "surrogatepass"), np.uint32)
            found = self.edges(self.code[points])[:BLOCK]
            reach[a : a + len(found)] = ((found >= 0) * bits).sum(1, dtype=np.uint32)
        longest = np.zeros(len(part), np.int64)
        for n in range(2, LONGEST + 1):
            longest[reach & bits[n] > 0] = n
        far = np.maximum.accumulate(np.arange(len(part)) + np.maximum(longest, 1))
        cuts = np.concatenate([[0], np.flatnonzero(far[:-1] <= np.arange(1, len(part))) + 1, [len(part)]])
        out, begin = [], 0
        while begin < len(cuts) - 1:
            end = max(begin + 1, int(np.searchsorted(cuts, cuts[begin] + BLOCK, "right")) - 1)
            a, b = int(cuts[begin]), int(cuts[end])
            runs = [part[x:y] for x, y in itertools.pairwise(cuts[begin : end + 1].tolist())]
            out.append(self._block(runs)[0] if b - a <= BLOCK else self._relax_huge(part[a:b], reach[a:b]))
            begin = end
        return np.concatenate(out)

    def _relax_huge(self, text: str, reach: np.ndarray) -> np.ndarray:
        """Tokens of a run without a cut. Pairs there at first are sorted in one array; only later ones are in a heap."""
        size = len(text)
        _, level = np.unique(-self.scores, return_inverse=True)  # equal scores: the leftmost first
        right, left = np.arange(1, size + 1, dtype=np.int32), np.arange(-1, size - 1, dtype=np.int32)
        length = np.ones(size, np.int8)

        def pair(p: int) -> int:
            """The pair that starts here: level of its score, place, both lengths; -1 for none."""
            q = int(right[p])
            if q >= size:
                return -1
            a, b = int(length[p]), int(length[q])
            if a + b > LONGEST or not reach[p] >> (a + b) & 1:
                return -1
            return (int(level[self.piece[text[p : p + a + b]]]) << 48) | (p << 8) | (a << 4) | b - 1

        first = np.fromiter((pair(p) for p in range(size)), np.int64, size)
        first = np.sort(first[first >= 0])
        heap: list[int] = []
        at = 0
        while at < len(first) or heap:
            if heap and (at == len(first) or heap[0] < first[at]):
                x = heapq.heappop(heap)
            else:
                x = int(first[at])
                at += 1
            p, a, b = x >> 8 & (1 << 40) - 1, x >> 4 & 15, (x & 15) + 1
            q = p + a
            if length[p] != a or q >= size or length[q] != b:
                continue
            r = int(right[q])
            right[p], length[p], length[q] = r, a + b, 0
            if r < size:
                left[r] = p
            for z in (p, int(left[p])):
                if z >= 0 and (y := pair(z)) >= 0:
                    heapq.heappush(heap, y)
        tokens = []
        for p in np.flatnonzero(length).tolist():
            piece = self.piece.get(text[p : p + int(length[p])], -1) if length[p] > 1 or reach[p] & 2 else -1
            tokens += [piece] if piece >= 0 else [self.v.byte[x] for x in text[p].encode("utf-8", "surrogatepass")]
        return np.array(tokens, np.int32)

    def _block(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        points = np.frombuffer("\0".join([*parts, ""]).replace(" ", BLANK).encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.array([len(p) for p in parts])
        begins = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
        codes = self.code[points]
        ends = begins + sizes
        codes[ends] = 0
        edge = self.edges(codes)
        length = np.ones(len(points), np.int64)  # of the symbol that starts here; 0: none does
        length[ends] = 0
        self._relax(edge, length, begins[sizes <= LONG], sizes[sizes <= LONG])
        for i in np.flatnonzero(sizes > LONG):
            self._relax_long(edge, length, int(begins[i]), int(ends[i]))
        start = np.flatnonzero(length)
        token = edge[start, length[start]]
        owner = np.searchsorted(ends, start)
        unknown = np.flatnonzero(token < 0)
        if len(unknown):  # the bytes of a character instead
            raw = [chr(c).encode("utf-8", "surrogatepass") for c in points[start[unknown]]]
            repeat = np.ones(len(token), np.int64)
            repeat[unknown] = [len(r) for r in raw]
            where = np.concatenate([np.arange(len(r)) for r in raw]) + np.repeat((np.cumsum(repeat) - repeat)[unknown], repeat[unknown])
            token, owner = np.repeat(token, repeat), np.repeat(owner, repeat)
            token[where] = np.array(self.v.byte, np.int32)[np.frombuffer(b"".join(raw), np.uint8)]
        return token, np.bincount(owner, minlength=len(parts))

    def _relax(self, edge: np.ndarray, length: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> None:
        if not len(begins):
            return
        word = np.repeat(np.arange(len(begins)), sizes)
        start = np.arange(len(word)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + begins[word]
        long = np.ones(len(word), np.int64)
        while len(word):
            both = long[:-1] + long[1:]
            fits = (word[1:] == word[:-1]) & (both <= LONGEST)
            piece = np.where(fits, edge[start[:-1], np.where(fits, both, 0)], -1)
            score = np.full(len(word), -np.inf, np.float32)
            some = np.flatnonzero(piece >= 0)
            score[some] = self.scores[piece[some]]
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            best = np.maximum.reduceat(score, first)
            number = np.cumsum(np.concatenate([[0], word[1:] != word[:-1]]))
            mine = best[number]
            at = np.flatnonzero((score == mine) & (mine > -np.inf))
            at = at[np.concatenate([[True], word[at[1:]] != word[at[:-1]]])] if len(at) else at
            long[at] += long[at + 1]
            length[start[at]] = long[at]
            length[start[at + 1]] = 0
            keep = mine > -np.inf  # parts without a join left are done
            keep[at + 1] = False
            word, start, long = word[keep], start[keep], long[keep]

    def _relax_long(self, edge: np.ndarray, length: np.ndarray, begin: int, end: int) -> None:
        right = {p: p + 1 for p in range(begin, end)}
        left = {p: p - 1 for p in range(begin, end)}

        def push(p: int) -> None:
            q = right[p]
            if q < end and (n := right[q] - p) <= LONGEST and (piece := edge[p, n]) >= 0:
                heapq.heappush(heap, (-float(self.scores[piece]), p, q, right[q]))

        heap: list[tuple[float, int, int, int]] = []
        for p in range(begin, end):
            push(p)
        while heap:
            _, p, q, r = heapq.heappop(heap)
            if right.get(p) != q or right.get(q) != r:
                continue
            right[p] = r
            del right[q]
            length[p], length[q] = r - p, 0
            if r < end:
                left[r] = p
                push(p)
            if p > begin:
                push(left[p])


class _Numbers(dict):
    def __missing__(self, part: str) -> int:
        self[part] = n = len(self)
        return n


def encode_texts(matcher: Matcher, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of all texts, one after the other, and their number for each text."""
    numbers = _Numbers()
    rows = [np.fromiter(map(numbers.__getitem__, matcher.parts(t or "")), np.int32) for t in texts]
    tokens, counts = matcher.encode(list(numbers))
    begins = np.cumsum(counts) - counts
    flat, sizes = [], np.zeros(len(texts), np.int64)
    for g in range(0, len(rows), GROUP):
        group = rows[g : g + GROUP]
        part = np.concatenate(group)
        n = counts[part]
        owner = np.repeat(np.arange(len(group)), [len(r) for r in group])
        sizes[g : g + len(group)] = np.bincount(owner, weights=n, minlength=len(group)).astype(np.int64)
        flat.append(tokens[np.repeat(begins[part] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))])
    return (np.concatenate(flat) if flat else np.zeros(0, np.int32)), sizes


class Decoder:
    def __init__(self, vocabulary: Vocabulary):
        self.table = [p.replace(BLANK, " ").encode("utf-8", "surrogatepass") for p in vocabulary.pieces]
        for i in vocabulary.special:
            self.table[i] = b""
        for b, i in enumerate(vocabulary.byte):
            self.table[i] = bytes([b])

    def decode(self, ids: np.ndarray | list[int]) -> str:
        """Text of the ids, put together a bounded number of pieces at a time."""
        parts = (ids[s : s + BLOCK] for s in range(0, len(ids), BLOCK))
        raw = [b"".join(map(self.table.__getitem__, p.tolist() if isinstance(p, np.ndarray) else p)) for p in parts]
        return b"".join(raw).decode("utf-8", "replace").removeprefix(" ")


def encode(docs: DataFrame, model: str = MODEL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids, round_trip`` per row; the last says whether decoding gives the text back."""
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher, decoder = Matcher(shared.value), Decoder(shared.value)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            flat, sizes = encode_texts(matcher, texts)
            offsets = np.concatenate([[0], np.cumsum(sizes)])
            same = [
                decoder.decode(flat[a:b]) == (t or "") for t, a, b in zip(texts, offsets[:-1], offsets[1:], strict=True)
            ]
            ids = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes), ids, pa.array(same, pa.bool_())], ["doc_id", "n_tokens", "ids", "round_trip"]
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids array<int>, round_trip boolean")


def decode(rows: DataFrame, model: str = MODEL, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id, text`` from token ids; null ids decode to the empty text."""
    shared = rows.sparkSession.sparkContext.broadcast(Vocabulary.load(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(shared.value)
        for batch in batches:
            texts = [decoder.decode(ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    kind = rows.schema[id_col].dataType.simpleString()
    return rows.select(id_col, ids_col).mapInArrow(run, f"doc_id {kind}, text string")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"))


QUERIES = {"op3_sentencepiece": op3_sentencepiece}
