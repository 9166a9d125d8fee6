"""Training-data operators against brute force on small tables with nulls, blanks, repeats and clashing columns."""

import collections
import hashlib
import itertools
import math
import random
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parents[2]))
from trajrisk.llm import (
    common, decontamination, hidden_markov, html_text, license_scan, near_dedup, pieces, quality_classifier, quality_rules, substring_dedup, warc,
)

SCHEMA = "doc_id long, text string, value string, h string, component_id string"


def corpus():
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(rnd.choice(words) for _ in range(rnd.randint(60, 200))) for _ in range(30)]
    base = texts[0].split()
    for _ in range(25):  # near copies, some under the threshold
        copy = list(base)
        for _ in range(rnd.randint(0, 6)):
            copy[rnd.randrange(len(copy))] = rnd.choice(words)
        texts.append(" ".join(copy))
    passage = " ".join(rnd.choice(words) for _ in range(60))
    texts += [f"{rnd.choice(words)} {i} {passage} {i * 7} end" for i in range(20)]
    texts += [None, "", "  \n", "one", "ONE", "one two three", texts[2], texts[2], "ab " * 200, "é" * 130, "x" * 99]
    rows = [(i, t, "v", "h", "c") for i, t in enumerate(texts)]
    return rows + [rows[5], (None, texts[3], "v", "h", "c")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_near_duplicates(docs, empty):
    rows = [(i, t) for i, t, *_ in corpus() if i is not None]

    def shingles(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()

    sets, root = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}
    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            x, y = root[a], root[b]
            root = {k: min(x, y) if v in (x, y) else v for k, v in root.items()}
    got = near_dedup.near_duplicates(docs).collect()
    assert len(got) == len(corpus())
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"]) == (len(sets[r["doc_id"]]), root[r["doc_id"]])
    kept = near_dedup.keep_first(docs)
    assert kept.columns == docs.columns and kept.where("doc_id is not null").count() == len(set(root.values()))
    assert near_dedup.near_duplicates(empty).count() == 0


def test_ids_of_any_type(spark):
    """Near-duplicates and repeats by text ids are those by numbers in the order of these ids; null ids stay null."""
    rows = [(i, t) for i, t, *_ in corpus()]
    name = lambda i: None if i is None else f"doc-{i:04d}"
    plain, named = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(name(i), t) for i, t in rows], "doc_id string, text string")
    want = sorted(str((name(r["doc_id"]), r["n_shingles"], name(r["component_id"]), r["kept"])) for r in near_dedup.near_duplicates(plain).collect())
    assert want == sorted(str(tuple(r)) for r in near_dedup.near_duplicates(named).collect())
    assert near_dedup.keep_first(named).count() == near_dedup.keep_first(plain).count()
    stripped = lambda df: substring_dedup.stripped(substring_dedup.repeated_ranges(df)[0]).drop("kept").collect()
    assert sorted(str((name(r[0]), *r[1:])) for r in stripped(plain)) == sorted(str(tuple(r)) for r in stripped(named))


def test_of_one_id_the_speaker_stays(spark):
    """Which of different texts with one id stays doesn't depend on the order of rows."""
    texts = [" ".join(f"{c}{i}" for i in range(30)) for c in "abcd"]
    rows = [(1, t) for t in texts] + [(1, None), (2, texts[0] + " more"), (None, texts[1]), (None, texts[1])]
    kept = []
    for parts in (1, 3, 5):
        found = near_dedup.keep_first(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)).collect()
        kept.append(sorted(map(str, found)))
    assert kept[0] == kept[1] == kept[2] and len([r for r in found if r["doc_id"] == 1]) == 1
    assert len([r for r in found if r["doc_id"] is None]) == 2


def test_pairs_just_above_the_threshold_are_found(spark):
    """Recall where the sketch prefix is not exact: 3 000 pairs of 60 to 400 shingles with a similarity from 0.75 to 0.80."""
    rng, rows, want = np.random.default_rng(8), [], set()
    for i in range(3_000):
        n = int(rng.integers(64, 404))
        a = [f"p{i}w{j}" for j in range(n)]
        b = list(a)
        # Each changed word changes five shingles, at the end of the text one more each.
        while True:
            inter = len({tuple(a[k : k + 5]) for k in range(n - 4)} & {tuple(b[k : k + 5]) for k in range(len(b) - 4)})
            union = 2 * (n - 4) - inter
            if 100 * inter < 80 * union:
                break
            b[int(rng.integers(0, n))] += "x"
        if 100 * inter >= 75 * union:
            want.add(2 * i)
        rows += [(2 * i, " ".join(a)), (2 * i + 1, " ".join(b))]
    found = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    got = {r["component_id"] for r in found.where("component_id <> doc_id").collect()}
    assert len(want) > 1_500 and got == want


def test_documents_in_long_lists(spark, monkeypatch):
    """Many texts of many sizes around one passage, with copies under and over the threshold: links by blocks and size classes."""
    monkeypatch.setattr(near_dedup, "LONG_LIST", 3)
    monkeypatch.setattr(near_dedup, "BLOCK", 5)
    rnd, rows = random.Random(21), []
    passage = [f"p{i}" for i in range(30)]
    for i in range(60):
        own = [f"o{i}x{j}" for j in range(rnd.choice([4, 8, 12, 40]))]
        base = passage + own
        for _ in range(2):
            copy = list(base)
            for _ in range(rnd.randint(0, 2)):
                copy[rnd.randrange(30, len(copy))] = f"z{rnd.randrange(9999)}"
            rows.append((len(rows), " ".join(copy)))
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in rows}
    root = {i: i for i in sets}
    for a, b in itertools.combinations(sorted(sets), 2):
        if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            x, y = root[a], root[b]
            root = {k: min(x, y) if v in (x, y) else v for k, v in root.items()}
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == root


def test_long_lists_in_blocks():
    rnd = random.Random(1)
    sets = [np.unique(np.array([rnd.randrange(60) for _ in range(40)], np.uint64)) for _ in range(40)]
    whole = [(i, i, s) for i, s in enumerate(sets)]
    want = {(a, b) for a, b in itertools.combinations(range(40), 2) if 100 * len(np.intersect1d(sets[a], sets[b])) >= 75 * len(np.union1d(sets[a], sets[b]))}
    found = near_dedup.block_links(whole, None) + []
    cross = near_dedup.block_links(whole[:20], whole[20:])

    def groups(edges):
        root = list(range(40))
        for a, b in edges:
            x, y = root[a], root[b]
            root = [min(x, y) if r in (x, y) else r for r in root]
        return root

    assert set(found) <= want and groups(found) == groups(want)
    assert set(cross) <= want and groups(cross) == groups((a, b) for a, b in want if a < 20 <= b)


def test_repeats(docs, empty):
    rows = sorted({(i if i is not None else -1, t or "") for i, t, *_ in corpus()})
    seen, want = set(), {}
    for i, t in rows:
        data = t.encode()
        hit = np.zeros(len(data), bool)
        for p in range(len(data) - 99):
            if data[p : p + 100] in seen:
                hit[p : p + 100] = True
            seen.add(data[p : p + 100])
        spans = int((np.diff(np.concatenate([[0], hit.astype(int)])) == 1).sum())
        want[i] = (len(data), int(hit.sum()), spans, hashlib.sha256(np.frombuffer(data, np.uint8)[~hit].tobytes()).hexdigest())
    got = substring_dedup.stripped(substring_dedup.repeated_ranges(docs)[0]).collect()
    assert len(got) == len(corpus())
    assert all(want[-1 if r["doc_id"] is None else r["doc_id"]] == tuple(r[1:5]) for r in got)
    out = substring_dedup.remove_repeats(near_dedup.keep_first(docs))
    assert out.columns == docs.columns
    assert substring_dedup.stripped(substring_dedup.repeated_ranges(empty)[0]).count() == 0


def test_repeats_of_frequent_anchors(spark):
    """A passage and a short line in many different contexts: no anchor gathers more than ``hot`` cuttings."""
    rnd = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyz "
    own = lambda n: "".join(rnd.choice(letters) for _ in range(n))
    passage, line = own(260), own(60)
    rows = [(i, own(150) + passage + own(150) + line + own(120)) for i in range(80)]
    rows += [(80 + i, rows[i][1][100:420] + own(30)) for i in range(10)]
    seen, want = set(), {}
    for i, t in rows:
        data, hit = t.encode(), np.zeros(len(t), bool)
        for p in range(len(data) - 99):
            if data[p : p + 100] in seen:
                hit[p : p + 100] = True
            seen.add(data[p : p + 100])
        want[i] = int(hit.sum()), hashlib.sha256(np.frombuffer(data, np.uint8)[~hit].tobytes()).hexdigest()
    for hot in (substring_dedup.HOT, 20, 1):
        found = substring_dedup.repeated_ranges(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), hot=hot)[0]
        got = {r["doc_id"]: (r["n_removed"], r["kept_sha256"]) for r in substring_dedup.stripped(found).collect()}
        assert got == want
    count = collections.Counter()
    for _, t in rows:
        count.update(h for d, e, _, _ in substring_dedup.segments([t.encode()]) for h in substring_dedup.ranges(d, e)[3].view(np.int64).tolist())
    asked, often = np.array([h for h, c in count.items() if c > 1]), frozenset(h for h, c in count.items() if c > 20)
    made = substring_dedup.codes(((i, 0, t.encode(), asked) for i, t in rows), often)
    assert often and max(collections.Counter(r[0] for r in made if r[6] is not None).values()) <= 20


def test_decontamination(spark, docs, empty):
    texts = dict((i, t) for i, t, *_ in corpus() if i is not None)
    words = texts[1].split()
    items = [(1, " ".join(words[5:25])), (2, "ONE two, three!"), (3, None), (4, "..."), (None, " ".join(words[40:50])), (1, " ".join(words[5:25]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = {}
    for i, t in texts.items():
        w = decontamination.words_of((t or "").encode())
        hit, ids = set(), set()
        for item, x in items:
            q = decontamination.words_of((x or "").encode())
            n = min(10, len(q))
            for s in range(len(q) - n + 1 if q else 0):
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == q[s : s + n]:
                        hit |= set(range(p, p + n))
                        ids |= {str(item)} if item is not None else set()
        want[i] = (len(w), len(hit), sorted(ids))
    found = decontamination.contamination(docs, bench).withColumn("k", decontamination.run_words("hit")).collect()
    assert len(found) == len(corpus()) and {r["doc_id"]: (r["n_words"], r["k"], r["items"]) for r in found if r["doc_id"] is not None} == want
    small = decontamination.contamination(docs, bench, block_words=5).withColumn("k", decontamination.run_words("hit")).collect()
    assert {r["doc_id"]: (r["n_words"], r["k"], r["items"]) for r in small if r["doc_id"] is not None} == want
    odd = [("a", texts[1]), ("a", texts[1]), ("a", "one two three"), (None, texts[1]), ("b", None)]
    odd = spark.createDataFrame(odd, "doc_id string, text string")
    every = [
        sorted(str((r["doc_id"], r["n_words"], r["k"], r["items"])) for r in
               decontamination.contamination(odd, bench, block_words=n).withColumn("k", decontamination.run_words("hit")).collect())
        for n in (5, 2_000_000)
    ]
    k = want[1]
    assert every[0] == every[1] == sorted(map(str, [("a", *k), ("a", *k), ("a", 3, 3, ["2"]), (None, *k), ("b", 0, 0, [])]))
    assert [r["doc_id"] for r in decontamination.drop_hit(odd, bench).collect()] == ["b"]
    assert decontamination.contamination(empty, bench).count() == 0
    assert decontamination.contamination(docs, bench.limit(0)).where("size(items) > 0").count() == 0
    near = decontamination.proximity_matches(decontamination.build_index(docs), [("g", ["one", "three"])], 3).collect()
    assert {(r["start"], r["end"]) for r in near} == {(0, 3)}


def test_pieces_match_the_library(spark, docs):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    for r, t in [(r, r) for r in pieces.encode(docs).collect()]:
        text = dict((i, t) for i, t, *_ in corpus()).get(r["doc_id"]) or ""
        if r["doc_id"] is not None:
            assert r["ids"] == model.encode(text) and r["round_trip"]
    matcher = pieces.Matcher(pieces.Vocabulary.load(pieces.MODEL))
    odd = ["  a  b ", "a\nb", "日本語 \0z", "=" * 300, "🙂" * 90, " " * 70 + "x", "ﬁ\t▁▁ a▁b"]
    flat, sizes = pieces.encode_texts(matcher, odd)
    assert [x.tolist() for x in np.split(flat, np.cumsum(sizes)[:-1])] == model.encode(odd)
    back = pieces.decode(pieces.encode(docs)).collect()
    assert len(back) == len(corpus())


def test_long_parts_without_blanks(monkeypatch):
    """Parts beyond a block, with and without places to cut, give the library's tokens."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    rnd = random.Random(4)
    matcher = pieces.Matcher(pieces.Vocabulary.load(pieces.MODEL))
    odd = [
        "=" * 700, "".join(rnd.choice("abcdefghij") for _ in range(900)), "".join(rnd.choice("the日本語é🙂-=_") for _ in range(900)),
        "ab " * 50 + "x" * 400 + " y", " " * 300, "theandingerion" * 60, "".join(rnd.choice("etaoin") for _ in range(3000)),
    ]
    for block in (40, 200, 1 << 20):
        monkeypatch.setattr(pieces, "BLOCK", block)
        flat, sizes = pieces.encode_texts(matcher, odd)
        assert [x.tolist() for x in np.split(flat, np.cumsum(sizes)[:-1])] == model.encode(odd), block
        assert pieces.Decoder(matcher.v).decode(np.array(model.encode(odd[2]))) == odd[2]


def test_viterbi_and_counts():
    rnd = np.random.default_rng(1)
    for n in range(1, 7):
        emit, move = rnd.normal(size=(n, 2)), rnd.normal(size=(2, 2)).tolist()
        total = lambda y: sum(emit[i, c] for i, c in enumerate(y)) + sum(move[a][b] for a, b in itertools.pairwise(y))  # noqa: B023, E731
        assert total(quality_rules.viterbi(emit, move)) == pytest.approx(max(map(total, itertools.product((0, 1), repeat=n))))
    assert quality_rules.repeated_words(b"a b c x a b c y".split()) == 6
    assert quality_rules.judge(b"", quality_rules.DEFAULT_MODEL)[:6] == (0, 0, 0, 0, 0, True)
    assert quality_rules.judge("é b\n\né b\n#".encode(), quality_rules.DEFAULT_MODEL)[:5] == (5, 5, 1, 1, 0)


def test_quality_rules_table(spark, docs, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = quality_rules.train(spark, docs, labels)
    assert quality_rules.verdicts(docs, model).count() == len(corpus())
    assert quality_rules.keep_good(docs, model).columns == docs.columns
    assert quality_rules.verdicts(empty, model).count() == 0


def test_boilerplate_lines_inside_documents(spark):
    """Labels change inside documents; the share decides."""
    rnd = random.Random(9)
    good = lambda: " ".join(rnd.choice(["river", "stone", "of", "the", "walk", "green", "house"]) + str(rnd.randrange(99)) for _ in range(14)) + "."
    junk = lambda: " | ".join(rnd.choice(["Home", "Login", "$$$", "###"]) for _ in range(12))
    rows, labels = [], []
    for i in range(120):
        lines = [good() for _ in range(8)] if i % 2 else [good(), *(junk() for _ in range(6)), good(), junk()]
        rows.append((i, "\n".join(lines)))
        labels.append((i, i % 2, 0))
    rows += [(1000, "\n".join([*(good() for _ in range(6)), junk(), junk(), *(good() for _ in range(4))])), (1001, "\n".join([good(), *(junk() for _ in range(12))]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = quality_rules.train(spark, docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {r["doc_id"]: r for r in quality_rules.verdicts(docs, model).collect()}
    assert 0.5 < got[1000]["content_share"] < 1 and got[1000]["kept"]
    assert 0 < got[1001]["content_share"] < 0.4 and not got[1001]["kept"]
    assert all(got[i]["kept"] == bool(i % 2) for i in range(120))


def test_quality_base_columns_as_sql(spark, docs):
    import duckdb
    import pandas as pd

    rows = [(i, t) for i, t, *_ in corpus()] + [(900, "a b c\na b c\n\n # x $5\ta b c d"), (901, "é ü\x0b日本 é ü 日本\né ü"), (902, "x\u00a0y z\nx\u00a0y z")]
    texts = pd.DataFrame(rows, columns=["doc_id", "text"])  # noqa: F841
    sql = r"""
    WITH d AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS t FROM texts),
      w AS (SELECT n, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
      g AS (SELECT n, s, w[s] || ' ' || w[s + 1] || ' ' || w[s + 2] AS g FROM (SELECT n, w, unnest(range(1, len(w) - 1)) AS s FROM w)),
      r AS (SELECT n, count(DISTINCT q) AS k FROM (SELECT n, unnest([s, s + 1, s + 2]) AS q FROM g WHERE (n, g) IN (SELECT n, g FROM g GROUP BY ALL HAVING count(*) > 1)) GROUP BY n),
      l AS (SELECT n, count(*) - count(DISTINCT x) AS k FROM (SELECT n, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY n)
    SELECT doc_id, len(w), coalesce(list_sum(list_transform(w, lambda x: length(x))), 0), length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')),
      coalesce(l.k, 0), coalesce(r.k, 0), len(w) < 50 OR 100 * coalesce(r.k, 0) > 50 * len(w) FROM w LEFT JOIN l USING (n) LEFT JOIN r USING (n)"""
    want = sorted((str(None if pd.isna(x[0]) else int(x[0])), *map(int, x[1:])) for x in duckdb.sql(sql).fetchall())
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r[0]), *map(int, r[1:7])) for r in quality_rules.verdicts(frame, quality_rules.DEFAULT_MODEL).collect())
    assert got == want


def test_hidden_markov_is_exact(spark, docs, empty):
    rng = np.random.default_rng(0)
    k, n = hidden_markov.STATES, hidden_markov.CLASSES + 1
    model = hidden_markov.Model.of_counts(rng.random(k), rng.random((k, k)), rng.random((n, k)))
    seqs = [np.array([5, 9, 5, n - 1], np.int32), np.array([n - 1], np.int32), np.array([7, n - 1], np.int32)]
    got = np.zeros(3)
    for mine, tokens, active in hidden_markov.groups(seqs):
        got[mine] = hidden_markov.forward(model, tokens, active, False)[0]
    for s, g in zip(seqs, got, strict=True):
        brute = sum(
            model.start[p[0]] * model.emit[s[0], p[0]] * math.prod(model.move[a, b] * model.emit[x, b] for a, b, x in zip(p, p[1:], s[1:], strict=False))
            for p in itertools.product(range(k), repeat=len(s))
        )
        assert g == pytest.approx(math.log(brute))
    start, move, emit = hidden_markov.expect(model, seqs)
    assert start.sum() == pytest.approx(3, rel=1e-4) and move.sum() == pytest.approx(4, rel=1e-4) and emit.sum() == pytest.approx(7, rel=1e-4)
    rows = hidden_markov.score(docs, common.fold_column(docs["doc_id"], 7) != 2).collect()
    counts, texts = collections.Counter(), []
    for i, t, *_ in corpus():
        words = [*(t or "").encode().lower().split(), None]
        held = common.fold("" if i is None else str(i), 7) == 2
        texts.append((i, held, words))
        if not held:
            counts.update(words)
    total, kinds = sum(counts.values()), len(counts)
    want = {i: (h, len(w), sum(counts[x] > 0 for x in w), total, sum(math.log10((counts[x] + 1) / (total + kinds + 1)) for x in w)) for i, h, w in texts}
    for r in rows:
        assert tuple(r[1:5]) == want[r["doc_id"]][:4] and r["base_score"] == pytest.approx(want[r["doc_id"]][4])
    small = hidden_markov.score(docs, common.fold_column(docs["doc_id"], 7) != 2, chunk_bytes=3_000, bucket_bytes=2_000).collect()
    order = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"])
    for a, b in zip(sorted(rows, key=order), sorted(small, key=order), strict=True):  # however texts are put into chunks
        assert tuple(a[1:6]) == pytest.approx(tuple(b[1:6])) and a["score"] == pytest.approx(b["score"], rel=1e-7)
    better = [(r["score"] - r["base_score"]) / r["n_tokens"] for r in rows if not r["held_out"]]
    assert sum(better) > 0
    assert hidden_markov.score(empty, common.fold_column(empty["doc_id"], 7) != 2).count() == 0
    assert {r["train_tokens"] for r in hidden_markov.score(docs, F.lit(False)).collect()} == {0}


def test_word_emissions_sum_to_one():
    """Known words, one unseen word of each class, and the end of a text."""
    rng = np.random.default_rng(3)
    k, n = hidden_markov.STATES, hidden_markov.CLASSES
    model = hidden_markov.Model.of_counts(rng.random(k), rng.random((k, k)), rng.random((n + 1, k)))
    classes = np.append(rng.integers(0, n, 500), n)
    c, shares = rng.integers(1, 50, 501), rng.integers(0, 255, (501, k))
    share = shares / np.maximum(shares.sum(1, keepdims=True, dtype=int), 1)
    totals = hidden_markov.Totals(int(c.sum()), 501, (c[:, None] * share).sum(0), np.bincount(classes[:-1], minlength=n))
    known = hidden_markov.word_emissions(model, totals, c, shares, classes).sum(0)
    none = np.zeros(n, np.int64)
    unseen = hidden_markov.word_emissions(model, totals, none, np.zeros((n, k), np.int64), np.arange(n)).sum(0)
    assert known + unseen == pytest.approx(np.ones(k))


def test_html():
    page = (
        "<html><head><title>t</title><style>p{}</style></head><body><nav><a href='/'>Home</a></nav><div class='cookie-notice'><p>We use cookies, ok, fine.</p></div>"
        "<div id=wrap><div class='sidebar'><p>Other, things, here.</p></div><article><header>H</header><h1>A &amp; B</h1><p>First, one.<p>Sec<b>ond</b>,<br>two.<!-- no --></p>"
        "<script>var p = '</p>';</script><ul><li>item</ul><form><input></form><section class='comments'><p>Nice, post, friend!</p></section></article></div><footer>f</footer></body>"
    )
    assert html_text.main_text(page) == "A & B First, one. Second, two. item"
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<nav>x</nav>") == ""
    assert html_text.main_text("plain text, no tags") == "plain text, no tags"


def test_html_keeps_text_without_article():
    long = "<p>" + "Long, long, long words of a text, " * 40 + "end.</p>"
    rest = ["<div><p>Short one.</p></div>", "<ul><li>item</li></ul>", "<table><tr><td>cell</td></tr></table>", "<h3>Third</h3>", "<p>Brief.</p>"]
    got = html_text.main_text(f"<body><div id=content><div>{long}{long}</div>{''.join(rest)}<ul><li><a href=x>Menu</a></li></ul></div></body>")
    assert got.endswith("end. Short one. item cell Third Brief.")
    for mark in ("style='overflow:hidden'", "class='overflow-hidden'", "class='has-sidebar'", "class='no-comments'", "class='content-header'", "data-x='hidden'"):
        assert html_text.main_text(f"<body><div {mark}>{long}</div></body>").endswith("end."), mark
    for mark in ("hidden", "style='color:red; visibility: hidden'", "style='display:none'", "aria-hidden=true", "class='main-nav'", "class='cookie_notice'"):
        assert "gone" not in html_text.main_text(f"<body><div><div>{long}</div><div {mark}><p>gone</p></div></div></body>"), mark
    assert html_text.main_text(f"<body><div class='widget'><h1>T</h1>{long}</div></body>").startswith("T Long")


BOILERPLATE = (
    "related-posts related-articles comment-thread user-comments respond share-buttons social-icons ad-slot ad-unit ad_300x250 advert-mpu sponsored-content "
    "newsletter-form most-read recommended-reads topbar alert announcement disclaimer commentList relatedStories ad1 read-next"
).split()
LOOK_ALIKES = "has-sidebar no-comments content-header commentary adhoc shared-text addresses socialism headers category-social tag-ads overflow-hidden".split()


def test_html_boilerplate_by_any_part_of_a_name():
    long = "<p>" + "Long, long, long words of a text, " * 40 + "end.</p>"
    for name in BOILERPLATE:
        for tag in ("div", "section"):
            part = f"<{tag} class='x {name}'><p>This is gone, all of it, as it should be.</p></{tag}>"
            for page in (f"<body><div>{long}{part}</div></body>", f"<body><article>{long}{part}</article></body>", f"<body><div>{long}</div>{part}</body>", f"<body><article>{long}</article>{part}</body>"):
                assert html_text.main_text(page).endswith("end."), (name, page[-200:])
    for name in LOOK_ALIKES:
        part = f"<div class='{name}'><p>This stays, all of it, as it should do.</p></div>"
        for page in (f"<body><div>{long}{part}</div></body>", f"<body><article>{long}{part}</article></body>", f"<body><div>{long}</div>{part}</body>"):
            assert html_text.main_text(page).endswith("end. This stays, all of it, as it should do."), (name, page[-200:])
    for name in ("social-history", "alert-report", "related-work"):  # nothing else is on the page
        assert html_text.main_text(f"<body><nav>x</nav><div class='{name}'>{long}</div></body>").endswith("end."), name
    assert html_text.main_text(f"<body><div class='user-comments'>{long}</div></body>") == ""


def test_html_parts_told_by_headings_and_nesting():
    long = "<p>" + "Long, long, long words of a text, " * 40 + "end.</p>"
    note = "<p>Nice, post, friend, I would say so too!</p>"
    for head in ("Comments", "3 comments", "Comments (12)", "Leave a reply", "Related articles", "You may also like", "Most read", "Share this", "Advertisement"):
        for page in (f"<article>{long}<div><h3>{head}</h3>{note}</div></article>", f"<div>{long}<h2>{head}</h2>{note}<ul><li>{note}</li></ul></div>"):
            assert html_text.main_text(f"<body>{page}</body>").endswith("end."), (head, page[-150:])
        assert html_text.main_text(f"<body><div>{long}<h2>{head}</h2>{note}<h2>Second</h2><p>More.</p></div></body>").endswith("end. Second More."), head
    assert html_text.main_text(f"<body><div>{long}<h2>Comments on the law</h2>{note}</div></body>").endswith("so too!")
    assert html_text.main_text(f"<body><article>{long}<article>{note}</article><article>{note}</article></article></body>").endswith("end.")
    pages = f"<body><main><article><h1>A</h1>{long}</article></main><main><article><p>Short second.</p></article></main><article><p>Third, also short.</p></article></body>"
    assert html_text.main_text(pages).startswith("A Long") and html_text.main_text(pages).endswith("end. Short second. Third, also short.")


def test_html_against_pages_of_known_text():
    """Random pages, put together from parts that belong to the text and parts that do not, as deep and in such order as it comes."""
    rnd = random.Random(31)
    words = lambda n: " ".join(rnd.choice(["stone", "river", "walks,", "under", "light", "&amp;", "old", "é"]) for _ in range(n)) + "."
    for _ in range(300):
        want: list[str] = []

        def told(n, want=want):
            text = words(n)
            want.append(text.replace("&amp;", "&"))
            return text

        def good(depth):
            kind = rnd.choice(["p", "p", "p", "ul", "table", "quote", "deep" if depth else "p"])
            if kind == "p":
                return f"<p>{told(rnd.randint(12, 60))}" + rnd.choice(["</p>", ""])
            if kind == "ul":
                return "<ul>" + "".join(f"<li>{told(9)}" for _ in range(3)) + "</ul>"
            if kind == "table":
                return f"<table><tr><td>{told(6)}<td>{told(6)}</table>"
            if kind == "quote":
                return f"<blockquote><p>{told(15)}</p></blockquote>"
            return f"<div class='{rnd.choice(LOOK_ALIKES)}'>" + "".join(good(depth - 1) for _ in range(2)) + "</div>"

        def bad():
            inner = rnd.choice([f"<p>{words(12)}</p>", f"<ul><li><a href=x>{words(3)}</a></li></ul>", f"<div><span>{words(8)}</span></div>"])
            return rnd.choice([
                f"<div class='{rnd.choice(BOILERPLATE)}'>{inner}</div>", f"<section id='{rnd.choice(BOILERPLATE)}'>{inner}</section>", f"<nav>{inner}</nav>", f"<aside>{inner}</aside>",
                f"<form>{inner}</form>", f"<script>var a = '{words(5)}</p>';</script>", f"<style>{words(3)}</style>", f"<!-- {words(4)} -->", f"<footer>{inner}</footer>",
            ])

        lead = f"<p>{told(60)}</p>"
        body = lead + "".join(good(2) if rnd.random() < 0.7 else bad() for _ in range(rnd.randint(6, 14)))
        tag = rnd.choice(["article", "main", "div", "section"])
        page = f"<html><head><title>{words(3)}</title></head><body>{bad()}{bad()}<{tag}>{body}</{tag}>{bad()}{bad()}</body></html>"
        assert html_text.main_text(page).split() == " ".join(want).split(), page


def test_html_on_a_table(spark):
    page = "<body><div class=menu><a href=/>Home</a></div><p>Text, of one page, that is longer than the rest of it.</p></body>"
    rows = [(1, "u", page, "x"), (1, "u", page, "x"), (None, None, page, "x"), (2, "v", None, "x"), (3, "w", "", "x"), (4, "w", "&lt;b&gt; &amp;amp;\u00a0x", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    want = "Text, of one page, that is longer than the rest of it."
    got = sorted((str(r["page_id"]), r["url"], r["text"], r["n_chars"]) for r in html_text.extract(pages).collect())
    assert got == sorted([("1", "u", want, 54), ("1", "u", want, 54), ("None", None, want, 54), ("2", "v", "", 0), ("3", "w", "", 0), ("4", "w", "<b> &amp; x", 11)], key=str)
    assert html_text.extract(pages.limit(0)).count() == 0


def test_html_takes_linear_time():
    import time

    for piece in ('<a "', '<a x="', "<b>", "</i>", "<b></i>", '<a x=">" ', "<title>", "<!", "<", "<p>", "<li>", "<table><td><b>", "<a<", "<a =  "):
        began = time.process_time()
        html_text.main_text(piece * (300_000 // len(piece)))
        assert time.process_time() - began < 5, piece
    assert html_text.main_text('<p>see <a title="5" disk">link</a>, ok</p>') == "see link, ok"


def test_license_scan(spark):
    rows = [(1, "MIT licence"), (2, "Copyright (c) 2020 X\nLicenced under  the ISC LICENSE!"), (3, None), (4, ""), (2, "z\nReleased under the MIT License."), (None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {(r["doc_id"], r["unit"], r["license"]) for r in license_scan.scan(docs, license_scan.known_digests(spark)).collect()}
    assert found == {(2, 0, "ISC"), (2, 2, "ISC"), (2, 2, "MIT")}
    rows = [(1, "Released under the MIT License. 但是不包括商业用途"), (2, "Не Released under the MIT License."), (None, "Released under the MIT License!"), (None, "«Released under the MIT License»")]
    odd = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"] for r in license_scan.scan(odd, license_scan.known_digests(spark)).collect()} == {None}
    none = license_scan.scan(odd.limit(0), license_scan.known_digests(spark))
    assert none.count() == 0 and license_scan.scan(odd, license_scan.known_digests(spark, [])).count() == 0


def test_license_scan_finds_complete_texts(spark):
    """Full texts and texts of several lines inside a document, however wrapped."""
    import textwrap

    texts = {p.name.removesuffix(".txt"): p.read_text() for p in license_scan.TEXTS.glob("*.txt")}
    mit, apache = texts["MIT"], texts["Apache-2.0.header"]
    rewrapped = [textwrap.fill(mit, w) for w in range(30, 100, 3)]
    rows = [(f"whole {k}", v) for k, v in texts.items()] + [
        ("titled", f"The MIT License (MIT)\n\nCopyright (c) 2020 X\n\n{mit}"),
        ("inside", f"Some prose.\n\n{mit}\nMore prose."),
        ("code", "int x;\n# Copyright 2020 X\n" + "".join(f"# {x}\n" for x in apache.splitlines()) + "int y;"),
        ("wrapped notice", "a\nReleased under\nthe MIT\nLicense.\nb"),
        ("cut", f"x\n{mit.replace('sublicense', 'rent')}"), ("longer", "a\nReleased under\nthe MIT License. Or not."),
        *((f"wrap {i}", f"Before.\n{x}\nAfter.") for i, x in enumerate(rewrapped)),
    ]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    found = collections.defaultdict(set)
    for r in license_scan.scan(docs, license_scan.known_digests(spark)).collect():
        found[r["doc_id"]].add((r["unit"], r["license"]))
    for k in texts:
        assert (0, k.removesuffix(".header")) in found[f"whole {k}"], k
    assert (0, "MIT") in found["titled"]
    first = {(i + 3, "MIT") for i, x in enumerate(mit.splitlines()) if x}
    assert found["inside"] == first
    assert {(i + 3, "Apache-2.0") for i, x in enumerate(apache.splitlines()) if x} == found["code"]
    assert found["wrapped notice"] == {(2, "MIT"), (3, "MIT"), (4, "MIT")}
    assert not found["cut"] and not found["longer"]
    for i, x in enumerate(rewrapped):
        assert found[f"wrap {i}"] == {(j + 2, "MIT") for j in range(x.count("\n") + 1)}, i


def test_warc(spark):
    rows = [(1, "http://a.b.com/x?q=1", "<p>é</p>"), (2, "http://b.com/", "<p>é</p>"), (3, None, None), (4, "http://c.com", ""), (None, "http://b.com/", "z"), (5, "http://b.com/", "q" * 5000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = common.new_path(spark, "warc")
    index = warc.build_index(warc.write_archives(pages, path), path)
    got = {r["page_id"]: r for r in warc.read_captures(warc.lookup(index, warc.keys_of(pages))).collect()}
    assert len(got) == 6 and got[1]["record_type"] == "revisit" and got[1]["refers_to"] == 2 and got[3]["refers_to"] == 4
    assert bytes(got[2]["payload"]) == "<p>é</p>".encode() and got[1]["payload_bytes"] == 9 and got[5]["payload_bytes"] == 5000
    clash = pages.withColumns({"sha": F.lit("x"), "owner": F.lit(1), "key": F.lit("k"), "file": F.lit("f")})
    assert warc.write_archives(clash, common.new_path(spark, "warc")).count() == 6
    some = warc.lookup(index, spark.createDataFrame([("com,b)/",), ("nowhere",)], "key string")).collect()
    assert sorted(str(r["page_id"]) for r in some) == ["2", "5", "None"]
    none = warc.build_index(warc.write_archives(pages.limit(0), path), path)
    assert warc.lookup(none, warc.keys_of(pages)).count() == 0


def test_classifier():
    rnd = random.Random(2)
    good = [" ".join(rnd.choice(["the", "cat", "sat", "down"]) for _ in range(60)).encode() for _ in range(60)]
    bad = [" ".join(rnd.choice(["the", "cat", "sat", "down"]) + "###" for _ in range(60)).encode() for _ in range(60)]
    net = quality_classifier.fit([*good[:40], *bad[:40]], np.array([1.0] * 40 + [0.0] * 40))
    p = quality_classifier.predict(net, net.pairs(), [*good[40:], *bad[40:], b"", b"x" * 5000])
    assert (p[:20] > 0.5).mean() > 0.9 and (p[20:40] < 0.5).mean() > 0.9 and ((p >= 0) & (p <= 1)).all()


def test_convolution_against_brute_force():
    """Every filter at every place of every chunk of whole texts, by the plain sum over its bytes."""
    rng = np.random.default_rng(11)
    net = quality_classifier.Network.start(3)
    net.bias, net.v, net.v0 = rng.normal(size=quality_classifier.FILTERS).astype(np.float32), rng.normal(size=2 * quality_classifier.FILTERS).astype(np.float32), 0.3
    width, chunk = quality_classifier.WIDTH, quality_classifier.CHUNK
    texts = [rng.integers(0, 256, n, dtype=np.uint8).tobytes() for n in (0, 1, width - 1, width, chunk, chunk + width - 1, chunk + width, 2 * chunk + 40)]
    found = quality_classifier.features(net, net.pairs(), texts)
    for text, got in zip(texts, found, strict=True):
        n = max(1, -(-(len(text) - width + 1) // chunk))
        data = text + bytes(n * chunk + width - 1 - len(text))
        tops = []
        for c in range(n):
            places = range(c * chunk, (c + 1) * chunk)
            sums = [sum(net.w[j, data[p + j]].astype(float) for j in range(width)) for p in places]
            tops.append(np.maximum(np.max(sums, axis=0) + net.bias, 0))
        want = np.concatenate([np.mean(tops, axis=0), np.max(tops, axis=0)])
        assert got == pytest.approx(want, abs=1e-4)
    p = quality_classifier.predict(net, net.pairs(), texts)
    assert p == pytest.approx(1 / (1 + np.exp(-(found @ net.v + net.v0))))


def test_classifier_on_tables(spark, docs, empty):
    """Repeated and null ids, null texts, clashing columns, empty tables; held-out accuracy."""
    rnd = random.Random(6)
    words = ["the", "cat", "sat", "down", "here"]
    rows = [(i, " ".join(rnd.choice(words) + ("" if i % 2 else "@@") for _ in range(40)), 0.5) for i in range(200)]
    rows += [rows[3], (3, "another text", 0.1), (None, rows[4][1], 0.2), (900, None, 0.3)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(200)] * 2 + [(None, 1, 0), (7, None, 0)], "doc_id long, quality int, toxic int")
    table = spark.createDataFrame(rows, "doc_id long, text string, score double")
    got = quality_classifier.score(table, quality_classifier.train(table, labels)).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 200 and common.fold(str(r["doc_id"]), 5) == 0]
    assert np.mean([(r["score"] >= 0.5) == (r["doc_id"] % 2) for r in held]) > 0.9
    none = quality_classifier.train(table, labels.limit(0))
    assert {r["score"] for r in quality_classifier.score(table, none).collect()} == {0.5}
    assert quality_classifier.score(empty, none).count() == 0


def test_pipeline_against_brute_force(spark, tmp_path):
    """run() on a small folder of tables: each stage by its plain definition."""
    import sentencepiece

    import corpus_pipeline

    rnd = random.Random(12)
    words = [f"{a}{b}" for a in ("the", "run", "of", "stone", "walk") for b in "abcdefghij"]
    sentence = lambda n: " ".join(rnd.choice(words) for _ in range(n)) + "."
    junk = lambda: " ".join("$$$ ###" for _ in range(12))
    passage = sentence(60)
    rows = [(i, "\n".join(sentence(14) for _ in range(6))) for i in range(40)]
    rows += [(100 + i, f"{sentence(70)}\n{passage}\n{sentence(70)}") for i in range(4)]
    rows += [(200, rows[3][1]), (201, rows[5][1] + " more"), (300, sentence(80) + " " + rows[7][1][:0]), (400, None), (401, "")]
    rows += [(500 + i, "\n".join([sentence(6), *(junk() for _ in range(8))])) for i in range(40)]
    item = " ".join(rows[-43][1].split()[10:30])  # of document 300
    tables = {
        "documents": spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long"),
        "labels": spark.createDataFrame([(i, 1, 0) for i in range(40)] + [(500 + i, 0, 0) for i in range(40)], "doc_id long, quality int, toxic int"),
        "benchmark": spark.createDataFrame([(1, item), (None, "no such thing")], "item_id long, text string"),
    }
    for name, t in tables.items():
        t.write.parquet(f"file://{tmp_path}/{name}.parquet")
    texts = {i: t or "" for i, t in rows}
    texts = {i: t for i, t in texts.items() if len(t.split()) >= 50 and i < 500}
    for i in (200, 201):  # copies of smaller ids
        del texts[i]
    seen, cut = set(), {}
    for i, t in sorted(texts.items()):
        data, hit = t.encode(), np.zeros(len(t.encode()), bool)
        for p in range(len(data) - 99):
            if data[p : p + 100] in seen:
                hit[p : p + 100] = True
            seen.add(data[p : p + 100])
        cut[i] = np.frombuffer(data, np.uint8)[~hit].tobytes().decode()
    assert cut[101] != texts[101] and 300 in cut
    del cut[300]  # holds a phrase of the benchmark
    model = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    got = {r["doc_id"]: r["ids"] for r in corpus_pipeline.run(spark, f"file://{tmp_path}").collect()}
    assert got == {i: model.encode(t) for i, t in cut.items()}
