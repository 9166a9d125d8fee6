"""Operators within their limits of memory and time: what a batch takes, and that results don't depend on batches."""

from __future__ import annotations

import random
import time
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from trajrisk.llm import hidden_markov, packing, stretches


def _sequences(lengths, seed: int = 3) -> list[np.ndarray]:
    rng = np.random.default_rng(seed)
    return [np.append(rng.integers(0, hidden_markov.CLASSES, n), hidden_markov.CLASSES).astype(np.int32) for n in lengths]


def test_state_shares_are_the_same_in_any_group():
    """A text alone, or the last that is left of a group, has the same shares to the last bit as among others."""
    model = hidden_markov.Model.first()
    texts = _sequences([400, 7, 0, 90, 91, 33, 250])
    at = np.cumsum([0, *map(len, texts)])
    emit = model.emit.astype(np.float32)[np.concatenate(texts)]  # every token is numbered by itself, to tell them apart
    own = [np.arange(a, b, dtype=np.int32) for a, b in zip(at[:-1], at[1:], strict=True)]
    local = hidden_markov.Model(model.start, model.move, emit)
    start, move, together = hidden_markov.expect(local, own)
    parts = [hidden_markov.expect(local, own[i : i + 1]) for i in range(len(own))]
    assert np.array_equal(together, sum(p[2] for p in parts))
    np.testing.assert_allclose(start, sum(p[0] for p in parts), rtol=1e-13)
    np.testing.assert_allclose(move, sum(p[1] for p in parts), rtol=1e-13)
    assert np.array_equal(hidden_markov.expect(local, own, 255)[2], sum(hidden_markov.expect(local, [x], 255)[2] for x in own))


def test_recursion_keeps_one_row_of_states_a_token():
    """Shares take the place of the alphas: 32 bytes a token, and not three or four times as much beside them."""
    model = hidden_markov.Model.first()
    texts = _sequences([300] * 700)
    tokens = sum(map(len, texts))
    for steps in (0, 255):
        tracemalloc.start()
        hidden_markov.expect(model, texts, steps)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 65 * tokens


def _plain(model, text: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Log-likelihood, moves and state shares of one text, time by time in double precision."""
    alphas, betas, scales = [], [np.ones(len(model.start))], []
    for x in text:
        a = (alphas[-1] @ model.move if alphas else model.start) * model.emit[x]
        scales.append(a.sum())
        alphas.append(a / a.sum())
    moves = np.zeros_like(model.move)
    for t in range(len(text) - 1, 0, -1):
        ahead = model.emit[text[t]] * betas[0] / scales[t]
        moves += np.outer(alphas[t - 1], ahead) * model.move
        betas.insert(0, model.move @ ahead)
    return np.log(scales).sum(), moves, np.array(alphas) * betas


def test_recursion_in_blocks_of_time(monkeypatch):
    """Groups and blocks of any size, some with the first time alone or ends of texts inside, give what each text gives."""
    rng = np.random.default_rng(5)
    first = hidden_markov.Model.first()
    model = hidden_markov.Model(rng.dirichlet(np.ones(8)), rng.dirichlet(np.ones(8), 8), first.emit)
    texts = _sequences([*rng.integers(0, 60, 70), 0, 0, 300])
    plain = [_plain(model, x) for x in texts]
    emit = np.zeros(model.emit.shape)
    for x, (_, _, shares) in zip(texts, plain, strict=True):
        np.add.at(emit, x, shares)
    logs = []
    for block, group in ((1, 800_000), (73, 800_000), (100, 500), (16_384, 800_000), (50, 1)):
        monkeypatch.setattr(hidden_markov, "BLOCK_TOKENS", block)
        monkeypatch.setattr(hidden_markov, "GROUP_TOKENS", group)
        got = hidden_markov.expect(model, texts)
        np.testing.assert_allclose(got[0], sum(p[2][0] for p in plain), rtol=1e-5)
        np.testing.assert_allclose(got[1], sum(p[1] for p in plain), rtol=1e-5)
        np.testing.assert_allclose(got[2], emit, rtol=1e-4, atol=1e-6)
        logs.append(np.zeros(len(texts)))
        for mine, tokens, active in hidden_markov.groups(texts):
            logs[-1][mine] = hidden_markov.forward(model, tokens, active, False)[0]
        np.testing.assert_allclose(logs[-1], [p[0] for p in plain], rtol=1e-12)
        assert np.array_equal(logs[-1], logs[0])


def test_recursion_over_a_long_text_does_little_around_its_products():
    """One text goes through the recursion alone, so that what is done at each time counts: counting took the time of 37
    to 44 small products a token, and 9 since tokens are looked up, scaled and summed in blocks."""
    model = hidden_markov.Model.first()
    texts = _sequences([20_000])
    rows, square = np.ones((hidden_markov.ROWS, len(model.start)), np.float32), model.move.astype(np.float32)
    out = np.empty_like(rows)

    def seconds(work) -> float:
        times = []
        for _ in range(3):
            begun = time.process_time()
            work()
            times.append(time.process_time() - begun)
        return min(times)

    product = seconds(lambda: [np.dot(rows, square, out) for _ in range(20_000)])
    assert seconds(lambda: hidden_markov.expect(model, texts)) < 22 * product


def test_words_of_a_chunk():
    """As Python splits the texts: any bytes, blanks of other scripts and at the ends, texts without words, slices of batches."""
    rnd = random.Random(1)
    bits = [*(bytes([i]) for i in range(256)), *[b" ", b"  ", b"a", b"B", b"\n", "\u00a0".encode(), "\u2003".encode(), "\u0085".encode(), "\u00c9".encode()] * 20]
    texts = [None, b"", b" ", b" a", b"A ", *(b"".join(rnd.choices(bits, k=rnd.choice([0, 1, 2, 30, 200]))) for _ in range(300)), None]
    for some in (texts, texts[:3], texts[4:5]):
        want = [(x or b"").lower().split() for x in some]
        for raw, kind in ((pa.binary(), pa.string()), (pa.large_binary(), pa.large_string())):
            column = pa.array(some, raw).view(kind)
            sizes, codes, words = hidden_markov._words(pa.chunked_array([column[:2], column[2:2], column[2:]]))
            assert sizes.tolist() == [len(x) for x in want] and words == b" ".join(dict.fromkeys(w for x in want for w in x))
            assert [words.split()[c] for c in codes.tolist()] == [w for x in want for w in x]


def test_frequent_stretches_are_encoded_once():
    """Those that come again stay when the encoder has more than it wants; the others go."""
    asked = []

    def encode(parts):
        asked.extend(map(str, parts))
        return np.array([len(str(x)) for x in parts], np.int32), np.ones(len(parts), np.int64)

    encoder = stretches.Encoder(encode, most=50)
    for i in range(12):
        parts = ["the", "and", *(f"rare{i}x{j}" for j in range(20)), "the", "of"]
        encoder.begin()
        numbers = encoder.numbers(pa.array(parts))
        tokens, starts, sizes = encoder.finish()
        assert stretches.gather(tokens, starts[numbers], sizes[numbers]).tolist() == [len(x) for x in parts]
        assert len(encoder.number) <= 50 + 23
    assert [asked.count(x) for x in ("the", "and", "of")] == [1, 1, 1] and len(asked) == 3 + 12 * 20
    encoder = stretches.Encoder(encode, most=10)
    for _ in range(3):  # all come again, and are more than it keeps
        encoder.begin()
        encoder.numbers(pa.array([f"w{j}" for j in range(30)]))
        encoder.finish()
        assert len(encoder.number) == 30


@pytest.mark.parametrize("kind", [pa.string(), pa.large_string()])
def test_texts_are_encoded_by_pieces_as_whole(kind, monkeypatch):
    """Blanks, white space and special tokens anywhere, with pieces of few bytes and an encoder that forgets."""
    rng = random.Random(1)
    marks = [" ", "  ", "\n", " \n", "\u3000 ", "\xa0", "\x1c ", "\x85 ", "\u200b ", "\t", "a", "B,", "\u00e9", "\u65e5\u672c", "<|endoftext|>", "7", "'s", "\x00"]
    texts = [None, "", " ", "  ", "a", " a", "a ", "\n", "\n ", *("".join(rng.choice(marks) for _ in range(rng.randrange(30))) for _ in range(400))]
    whole = Tokenizer.from_file(packing.MODEL)
    want = [[*whole.encode(t or "", add_special_tokens=False).ids, 1] for t in texts]
    monkeypatch.setattr(packing, "PIECE_BYTES", 300)
    encoder = stretches.Encoder(stretches.JoinedTokens(packing.MODEL, specials=True), most=100)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, kind)], ["doc_id", "text"])
    pieces = list(packing.pieces_of(batch))
    assert len(pieces) > 10 and [i for p in pieces for i in p.column(0).to_pylist()] == list(range(len(texts)))
    assert [x.tolist() for p in pieces for x in packing.encoded(encoder, p.column(1), 1)] == want
