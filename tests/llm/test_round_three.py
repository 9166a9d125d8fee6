"""Alignment of two tokenizers, packing and ranked search against brute force, with nulls, blanks, repeats and clashing columns."""

import collections
import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from trajrisk.llm import packing, ranked_search, stretches, token_alignment

SCHEMA = "doc_id long, text string, block string, ids string, shard string, score string, at string"


def corpus():
    rnd = random.Random(17)
    words = ["stone", "River", "walks", "naïve", "日本語", "x1", "don't", "the", "of", "<|endoftext|>", "A", "…", "ﬁn", "🙂", "é"]
    texts = [" ".join(rnd.choice(words) + rnd.choice(["", "", ",", "."]) for _ in range(rnd.randint(1, 90))) for _ in range(40)]
    texts += [None, "", " ", "  a  b ", "tab\tand\nline\n  two", "x" * 3000, "▁blank", "a b c", "ends with blank ", texts[3], texts[3], "</s> <s>", "\n \n", "0" * 50, "a  \n b"]
    texts += ["".join(rnd.choice("abcdefghij") for _ in range(4000)), " ".join(["stone"] * 3000)]
    rows = [(i, t, "b", "i", "s", "x", "y") for i, t in enumerate(texts)]
    return [*rows, rows[5], (None, texts[4], "b", "i", "s", "x", "y"), (7, "another of that id", "b", "i", "s", "x", "y")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


def test_stretches_are_encoded_as_whole_texts():
    """What is encoded stretch by stretch is what the libraries give for whole texts."""
    import sentencepiece
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.MODEL)
    t.encode_special_tokens = True
    m = sentencepiece.SentencePieceProcessor(model_file=token_alignment.PIECE_MODEL)
    byte, piece = stretches.JoinedTokens(packing.MODEL, specials=False, joined=3), token_alignment.piece_encoder(token_alignment.PIECE_MODEL)
    rnd = random.Random(3)
    texts = [r[1] for r in corpus() if r[1]] + ["".join(rnd.choice("ab. \n\t é'1") for _ in range(rnd.randint(1, 30))) for _ in range(400)]
    for text in texts:
        parts = stretches.stretches(text)
        assert " ".join(parts) == text
        assert byte(parts)[0].tolist() == t.encode(f" {text}", add_special_tokens=False).ids
        if "▁" not in text:
            assert piece(parts)[0].tolist() == m.encode(text)
        for encode, table in ((byte, stretches.byte_tokens(packing.MODEL)), (piece, token_alignment.piece_tokens(token_alignment.PIECE_MODEL))):
            flat, sizes = encode(parts)
            if "▁" not in text:
                at = np.concatenate([[0], np.cumsum(sizes)])
                assert [b"".join(table[i] for i in flat[a:b]).decode() for a, b in itertools.pairwise(at)] == [f" {p}" for p in parts]


def plain_alignment(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.MODEL)
    t.encode_special_tokens = True
    m = sentencepiece.SentencePieceProcessor(model_file=token_alignment.PIECE_MODEL)
    tables = stretches.byte_tokens(packing.MODEL), token_alignment.piece_tokens(token_alignment.PIECE_MODEL)
    out, held = [], collections.Counter()
    for i, text in rows:
        sides = (t.encode(f" {text}", add_special_tokens=False).ids, m.encode(text)) if text else ([], [])
        if not text or any(b"".join(k[x] for x in s) != f" {text}".encode() for s, k in zip(sides, tables, strict=True)):
            out.append((i, 0, 0, 0, [], ""))
            continue
        ends = [list(itertools.accumulate(len(k[x]) for x in s)) for s, k in zip(sides, tables, strict=True)]
        groups = []
        for cut in sorted(set(ends[0]) & set(ends[1])):
            before = groups[-1][2] if groups else 0
            groups.append(([x for x, e in zip(sides[0], ends[0], strict=True) if before < e <= cut], [x for x, e in zip(sides[1], ends[1], strict=True) if before < e <= cut], cut))
        spans = [[(e - len(k[x]), e, x) for x, e in zip(s, es, strict=True)] for s, k, es in zip(sides, tables, ends, strict=True)]
        links, j = [], 0
        for s, e, a in spans[0]:
            while spans[1][j][1] <= s:
                j += 1
            links += [(a, b) for s2, e2, b in itertools.takewhile(lambda x, e=e: x[0] < e, spans[1][j:])]
        told = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b, _ in groups)
        out.append((i, len(sides[0]), len(sides[1]), len(groups), links, hashlib.sha256(told.encode()).hexdigest()))
        held.update(set(links))
    most = collections.Counter()
    for (a, _), n in held.items():
        most[a] = max(most[a], n)
    return [(i, a, b, g, len(links), sum(held[x] == most[x[0]] for x in links), sum(held[x] for x in links), sha) for i, a, b, g, links, sha in out]


@pytest.mark.parametrize(("block_bytes", "pack_chars"), [(2000, 300), (1 << 20, 1 << 20)])
def test_alignment_against_brute_force(spark, docs, block_bytes, pack_chars):
    found = token_alignment.alignments(docs, block_bytes=block_bytes, pack_chars=pack_chars)
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    got = sorted(str(tuple(r[n] for n in names)) for r in found.collect())
    want = plain_alignment([(r[0], r[1]) for r in corpus()])
    assert got == sorted(map(str, want)) and sum(w[1] == 0 for w in want) >= 3


def test_alignment_of_any_ids_and_of_nothing(spark, docs):
    assert token_alignment.alignments(docs.limit(0)).count() == 0
    texts = docs.where("doc_id < 4").withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    assert sorted(r["doc_id"] for r in token_alignment.alignments(texts).collect()) == ["d0", "d1", "d2", "d3"]


def test_align_of_plain_token_tables(spark):
    """The relational core by itself: two tokenizations of keys, one of which has a long stretch without a cut."""
    rnd = random.Random(5)
    sizes = {"a": {1: 1, 2: 2, 3: 3}, "b": {7: 1, 8: 2, 9: 4}}
    tokens = {"a": {1: [1, 2, 3, 1], 2: [2] * 300, 3: [1]}, "b": {1: [9, 8, 7], 2: [7, *[8] * 299, 7], 3: [7]}}
    frames = {}
    for side in "ab":
        rows = [(k, i, x) for k, ids in tokens[side].items() for i, x in enumerate(ids)]
        rnd.shuffle(rows)
        frames[side] = spark.createDataFrame(rows, "key int, at int, id int")
    lengths = {s: spark.createDataFrame(list(sizes[s].items()), "id int, n_bytes int") for s in "ab"}
    got = token_alignment.align(frames["a"], frames["b"], lengths["a"], lengths["b"], "key").collect()
    for key in (1, 2, 3):
        spans = {}
        for s in "ab":
            ends = list(itertools.accumulate(sizes[s][x] for x in tokens[s][key]))
            spans[s] = [(e - sizes[s][x], e, x) for x, e in zip(tokens[s][key], ends, strict=True)]
        want = sorted((min(e, f), x, y) for c, e, x in spans["a"] for d, f, y in spans["b"] if max(c, d) < min(e, f))
        assert sorted((r["end"], r["a"], r["b"]) for r in got if r["key"] == key) == want
        cuts = {e for _, e, _ in spans["a"]} & {e for _, e, _ in spans["b"]}
        assert len({r["cut_group"] for r in got if r["key"] == key}) == len(cuts)


def test_packing_covers_every_id_once(spark, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.MODEL)
    for frame, batch in ((docs, packing.BATCH_IDS), (docs, 1500), (docs.coalesce(1), packing.BATCH_IDS)):
        got = packing.with_digest(packing.pack_documents(frame, batch_ids=batch)).collect()
        want = collections.Counter()
        for i, text, *_ in corpus():
            want[i, zlib.crc32(np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4").tobytes()), len(t.encode(text or "", add_special_tokens=False).ids) + 1] += 1
        whole = packing.pack_documents(frame, batch_ids=batch).collect()
        assert sorted((str(r["doc_id"]), r["start"], zlib.crc32(np.array(r["ids"], "<u4").tobytes())) for r in whole) == sorted((str(r["doc_id"]), r["start"], r["ids_crc32"]) for r in got)
        by_sequence = collections.defaultdict(list)
        for r in got:
            by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
        for pieces in by_sequence.values():
            pieces.sort()
            assert [o for o, _ in pieces] == [0, *itertools.accumulate(n for _, n in pieces[:-1])] and sum(n for _, n in pieces) <= 2048
        # Documents of one id are told apart by putting their pieces together in all ways that fit.
        single = {i for i, n in collections.Counter(i for i, *_ in corpus()).items() if n == 1}
        joined = collections.defaultdict(list)
        for r in whole:
            joined[r["doc_id"]].append((r["start"], r["ids"], r["doc_tokens"]))
        for i in single:
            pieces = sorted(joined[i])
            ids = [x for _, part, _ in pieces for x in part]
            assert [s for s, *_ in pieces] == [0, *itertools.accumulate(len(p) for _, p, _ in pieces[:-1])] and {n for *_, n in pieces} == {len(ids)}
            assert want[i, zlib.crc32(np.array(ids, "<u4").tobytes()), len(ids)] == 1
        assert sum(r["length"] for r in got) == sum(n * k for (_, _, n), k in want.items())
    assert packing.pack_documents(docs.limit(0)).count() == 0


def test_differencing_balances():
    rng = np.random.default_rng(7)
    for n, k in ((1, 1), (1, 4), (5, 2), (40, 7), (300, 40), (12, 12), (3, 9)):
        sizes = rng.integers(1, 500, n)
        window, sums = packing.differencing(sizes, k)
        assert len(sums) == k and np.bincount(window, weights=sizes, minlength=k).tolist() == sums.tolist()
        if n >= 4 * k:
            assert sums.max() - sums.min() <= sizes.max() / 4
    assert packing.differencing(np.array([8, 7, 6, 5, 4]), 2)[1].tolist() == [16, 14]  # the textbook's case


def test_padding_is_small_and_windows_rise():
    rng = np.random.default_rng(2)
    sizes = np.minimum(rng.lognormal(6.4, 1, 2000).astype(int) + 1, 30_000)
    found = packing.pack_batch(sizes, 2048)
    fill = [sum(n for *_, n in s) for s in found]
    assert max(fill) <= 2048 and sum(fill) == sizes.sum()
    assert sum(2048 - f for f in fill if f & (f - 1)) < 0.01 * sizes.sum()
    covered = sorted((d, s, n) for w in found for d, s, n in w)
    at = dict.fromkeys(range(len(sizes)), 0)
    for d, s, n in covered:
        assert s == at[d] and n > 0
        at[d] += n
    assert list(at.values()) == sizes.tolist()
    for few in ([5], [2048], [2049, 1], [100] * 3, [1] * 5000, [2047] * 9, [1025] * 40):
        got = packing.pack_batch(np.array(few), 2048)
        assert sum(n for w in got for *_, n in w) == sum(few) and max(sum(n for *_, n in w) for w in got) <= 2048


def plain_ranking(docs, items, k=10):
    import math
    import re

    words = lambda t: [w.translate({c: c + 32 for c in range(65, 91)}) for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t or "")]
    texts = [(i, collections.Counter(words(t))) for i, t in docs]
    sizes = [sum(c.values()) for _, c in texts]
    n_docs, n_terms = sum(s > 0 for s in sizes), sum(sizes)
    df = collections.Counter(t for _, c in texts for t in c)
    out = []
    for item, text in items:
        scores = []
        for (i, c), n in zip(texts, sizes, strict=True):
            m = 25 + 75 * n * n_docs // n_terms if n else 0
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in words(text) if c[t])
            if score > 0:
                scores.append((-score, i is None, i if i is not None else 0))
        out += [(item, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scores)[:k])]
    return out


@pytest.mark.parametrize(("shard_bytes", "block_terms"), [(2000, 4), (1 << 20, 100)])
def test_ranked_search_against_brute_force(spark, docs, shard_bytes, block_terms):
    items = [(1, "stone river, the STONE"), (2, "日本語 é x1"), (3, "no-where"), (4, None), (5, ""), (None, "naïve walks"), (1, "don't"), (2, "日本語 é x1"), (6, "0" * 50 + " stone"), (7, "stone")]
    queries = spark.createDataFrame(items, "item_id long, text string").withColumns({"doc_id": F.lit("x"), "query": F.lit(1)})
    want = plain_ranking([(r[0], r[1]) for r in corpus()], list(dict.fromkeys(items)))
    got = [tuple(r) for r in ranked_search.search(docs, queries, shard_bytes=shard_bytes, block_terms=block_terms).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want)) and len({w[0] for w in want}) > 4
    assert ranked_search.search(docs.limit(0), queries).count() == 0 and ranked_search.search(docs, queries.limit(0)).count() == 0


def test_search_stops_early_and_is_exact(spark):
    """Impact order on a corpus with frequent terms: bounds end the search before all groups are added up."""
    rng = np.random.default_rng(4)
    texts = [" ".join(f"w{int(x)}" for x in rng.zipf(1.2, rng.integers(5, 80)) % 20_000) for _ in range(3000)]
    items = [(i, " ".join(texts[7 * i].split()[:20])) for i in range(30)]
    docs, queries = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = sorted(tuple(r) for r in ranked_search.search(docs, queries).collect())
    assert got == sorted(plain_ranking(list(enumerate(texts)), items))
    terms, counts, where, often, sizes = ranked_search.shard_postings([t.encode() for t in texts])
    made = ranked_search.by_impact(counts, where, often, sizes, len(texts), int(sizes.sum()))
    weight = {t: int(1000 * np.log((2 * len(texts) + 2) / (2 * n + 1))) for t, n in zip(terms, counts.tolist(), strict=True)}
    shard = ranked_search.Shard(list(range(len(texts))), b" ".join(terms), [counts, *made], weight)
    completed, whole = [], shard.complete
    shard.complete = lambda who, *rest: completed.append(len(who)) or whole(who, *rest)
    for _, text in items:
        shard.best([(w.encode(), weight[w.encode()]) for w in sorted(set(text.split()))], 10, 1)
    assert len(completed) > 15 and max(completed) <= 10 * ranked_search.CANDIDATES


def test_very_long_texts(spark):
    """One text of a million characters in each operator that reads whole texts."""
    from trajrisk.llm import common, decontamination, hidden_markov, near_dedup, pieces, warc

    rnd = random.Random(8)
    words = [f"w{rnd.randrange(40_000)}" for _ in range(160_000)]
    long, near = " ".join(words), " ".join([*words[:80_000], "changed", *words[80_001:]])
    docs = spark.createDataFrame([(1, long), (2, near), (3, "short text of five words"), (4, None)], "doc_id long, text string")
    groups = {r["doc_id"]: r for r in near_dedup.near_duplicates(docs).collect()}
    assert groups[2]["component_id"] == 1 and groups[3]["kept"] and groups[1]["n_shingles"] == len({tuple(words[i : i + 5]) for i in range(len(words) - 4)})
    items = spark.createDataFrame([(1, " ".join(words[-12:])), (2, " ".join(words[70_000:70_030]))], "item_id long, text string")
    hits = {r["doc_id"]: r for r in decontamination.contamination(docs, items).collect()}
    assert hits[1]["items"] == hits[2]["items"] == ["1", "2"] and hits[1]["n_words"] == len(words) and hits[3]["items"] == []
    scores = {r["doc_id"]: r for r in hidden_markov.score(docs, F.lit(True)).collect()}
    assert scores[1]["n_tokens"] == len(words) + 1 and scores[1]["n_known"] == len(words) + 1 and -20 < scores[1]["score"] / scores[1]["n_tokens"] < 0
    pages = docs.select(F.col("doc_id").alias("page_id"), F.lit("http://a.b/").alias("url"), F.col("text").alias("html"))
    path = common.new_path(spark, "warc")
    got = {r["page_id"]: r for r in warc.read_captures(warc.lookup(warc.build_index(warc.write_archives(pages, path), path), warc.keys_of(pages))).collect()}
    assert got[1]["payload_bytes"] == len(long) and bytes(got[2]["payload"]) == near.encode() and got[4]["payload_bytes"] == 0
    assert pieces.encode(docs.limit(0)).count() == 0


def test_ids_left_out_by_shuffle(spark, docs, monkeypatch):
    """More ids than are sent to every task are joined instead."""
    from trajrisk.llm import common

    gone = spark.createDataFrame([(i,) for i in (1, 3, 5)], "k long")
    by_broadcast = sorted(map(str, common.leave_out(docs, gone, F.col("doc_id"), "k").collect()))
    monkeypatch.setattr(common, "BROADCAST_IDS", 0)
    assert sorted(map(str, common.leave_out(docs, gone, F.col("doc_id"), "k").collect())) == by_broadcast and len(by_broadcast) == len(corpus()) - 4


def test_pipeline_on_odd_tables(spark, tmp_path):
    """Empty tables; null ids, null texts and repeated rows, which no stage stumbles over."""
    import corpus_pipeline

    rnd = random.Random(6)
    text = lambda: "\n".join(" ".join(rnd.choice(["stone", "river", "walks", "under", "light"]) + str(rnd.randrange(99)) for _ in range(14)) + "." for _ in range(6))
    rows = [(i, text()) for i in range(12)]
    rows += [rows[2], rows[2], (None, rows[3][1]), (None, text()), (3, text()), (20, None), (21, "")]
    for name, some in (("empty", []), ("odd", rows)):
        folder = f"file://{tmp_path}/{name}"
        table = [(i, t, "en", "s", len(t or "")) for i, t in some]
        spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(i, 1, 0) for i, _ in some], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        spark.createDataFrame([(1, "nothing of these"), (None, None)] if some else [], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        got = corpus_pipeline.run(spark, folder).collect()
        ids = [r["doc_id"] for r in got]
        assert (name == "empty") == (not got) and ids.count(2) <= 1
        assert name == "empty" or {0, 1, 4, 5}.issubset(ids) and 20 not in ids and 21 not in ids
