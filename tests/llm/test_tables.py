"""Source mix, vectors, language model, packing and the pipeline against plain Python."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from offerlens.llm import mixing, ngram_trie, packing, permutation_index, quality_rules, secrets, simhash
from offerlens.llm.queries import tokenizer_path
from tests.llm.test_texts import WORD

# -- mixing


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(order)}
    budget, open_, out = 1.5 * sum(sizes.values()), set(order), {}
    while open_:
        share = {s: budget * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 2 * sizes[s]]
        if not over:
            return out | share
        for s in over:
            out[s] = 2.0 * sizes[s]
            budget -= out[s]
            open_.discard(s)
    return out


def doc_hash(doc_id):
    first = xxhash.xxh64_intdigest((-1 if doc_id is None else doc_id).to_bytes(8, "little", signed=True), 42)
    return xxhash.xxh64_intdigest((2).to_bytes(4, "little"), first)


def brute_mix(rows):
    """rows: (doc_id, text, source) -> list of (doc_id, size, source_size, target, taken)"""
    size = lambda t: len(WORD.findall(t or ""))
    totals = Counter()
    for _, t, s in rows:
        totals[s] += size(t)
    targets, out = brute_targets(totals), []
    for s in totals:
        mine = [(doc_hash(d), d, size(t)) for d, t, x in rows if x == s]
        copies = int(targets[s] // totals[s]) if totals[s] else 0
        spare, extra = targets[s] - copies * totals[s], set()
        groups = defaultdict(int)
        for h, _, n in mine:
            groups[h] += n
        for h in sorted(groups):
            if spare > 0 and (groups[h] <= spare):
                extra.add(h)
                spare -= groups[h]
            elif groups[h]:
                if spare > 0 and 2 * spare >= groups[h]:
                    extra.add(h)
                break
        out += [(d, n, totals[s], targets[s], n * (copies + (h in extra))) for h, d, n in mine]
    return out


def test_the_mix_is_that_of_brute_force(odd, empty):
    rows = [(r.doc_id, r.text, r.source) for r in odd.collect()]
    found = sorted(map(tuple, mixing.mix(odd).collect()), key=repr)
    expected = sorted(brute_mix(rows), key=repr)
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    for a, b in zip(sorted(found, key=key), sorted(expected, key=key), strict=True):
        assert a[:3] == b[:3] and a[3] == pytest.approx(b[3]) and a[4] == b[4]
    assert mixing.mix(empty).collect() == [] and all(r[4] <= 2 * r[1] for r in found)


def test_mixed_documents_are_taken_as_often_as_the_mix_says(odd):
    taken = Counter()
    for r in mixing.mix(odd).collect():
        taken[r.doc_id] += r.taken // r.size if r.size else 0
    mixed = mixing.mixed_documents(odd)
    assert mixed.columns == odd.columns and Counter(r.doc_id for r in mixed.collect()) == Counter({k: v for k, v in taken.items() if v})


# -- vectors


def brute_nearest(rows, queries, k=5):
    out = {}
    good = [(i, np.array(v, float)) for i, v in rows if v is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    for q, v in queries:
        best = sorted(((-(a @ v) / (np.linalg.norm(a) * np.linalg.norm(v)), i) for i, a in good if i != q))[:k]
        out[q] = [(i, -s) for s, i in best]
    return out


def test_vectors_recall_ties_and_what_takes_no_part(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=16).tolist()) for i in range(600)]
    rows += [(1000 + i, rows[0][1]) for i in range(30)] + [(2000, None), (2001, [0.0] * 16), (2002, [float("nan")] + [1.0] * 15), (2003, [None] + [1.0] * 15), (2004, [math.inf] + [1.0] * 15), (0, rows[0][1])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, label int")
    out = defaultdict(list)
    for r in permutation_index.nearest(df.where("vec_id % 50 = 0"), df).orderBy("query_id", "rank").collect():
        out[r.query_id].append((r.vec_id, r.score))
    exact = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    expected = brute_nearest(exact, [(i, np.array(v)) for i, v in exact if i % 50 == 0 and i != 2000])
    assert set(out) == set(expected)
    hits = sum(len({i for i, _ in out[q]} & {i for i, _ in expected[q]}) for q in expected)
    assert hits / (5 * len(expected)) >= 0.9
    assert [i for i, _ in out[0]] == [1000, 1001, 1002, 1003, 1004] and [i for i, _ in out[1000]] == [0, 1001, 1002, 1003, 1004]
    assert all(s == pytest.approx(dict(expected[q]).get(i, s), abs=1e-12) for q in out for i, s in out[q])


def test_few_and_no_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [0.0, 2.0])], "vec_id long, embedding array<float>")
    out = permutation_index.nearest(df.where("vec_id = 0"), df).orderBy("rank").collect()
    assert [(r.vec_id, r.rank) for r in out] == [(1, 1), (2, 2)] and permutation_index.nearest(df.limit(0), df.limit(0)).collect() == []


def test_blocks_of_queries_and_vectors_meet_each_other(spark):
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    queries = df.where("vec_id % 20 = 0")
    one = permutation_index.nearest(queries, df).orderBy("query_id", "rank").collect()
    many = permutation_index.nearest(queries, df, block=100, query_block=7).orderBy("query_id", "rank").collect()
    expected = brute_nearest(rows, [(i, np.array(v)) for i, v in rows if i % 20 == 0])
    for out in (one, many):
        hits = sum((r.vec_id in [i for i, _ in expected[r.query_id]]) for r in out)
        assert len(out) == 100 and hits >= 95


def test_huge_tiny_and_equal_vectors(spark):
    rng = np.random.default_rng(7)
    for trial in range(20):
        base = rng.normal(size=24)
        rows = [(0, rng.normal(size=24).tolist())] + [(int(i), base.tolist()) for i in rng.permutation(np.arange(1, 7))] + [(7, rng.normal(size=24).tolist())]
        ids, m = np.array([i for i, _ in sorted(rows)]), np.array([v for _, v in sorted(rows)])
        pivots = permutation_index.scaled(m)
        found, _ = permutation_index.search_block(ids[:1], m[:1], ids, m, pivots / np.linalg.norm(pivots, axis=1, keepdims=True), 5, 0.015)
        same = [i for _, i, _ in found if 1 <= i <= 6]
        assert same == list(range(1, 1 + len(same)))
    rows = [(0, [1e200, 2e200]), (1, [2e200, 4e200]), (2, [1e-200, -1e-200]), (3, [1e308, 1e308]), (4, [5e-324, 0.0])]
    out = permutation_index.nearest(spark.createDataFrame(rows[:1], "vec_id long, embedding array<double>"), spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    scores = {r.vec_id: r.score for r in out.collect()}
    assert scores[1] == pytest.approx(1) and scores[3] == pytest.approx(3 / math.sqrt(10)) and scores[2] == pytest.approx(-1 / math.sqrt(10)) and scores[4] == pytest.approx(1 / math.sqrt(5))


def test_gains_are_footrule_distances_of_partial_permutations():
    rng = np.random.default_rng(8)
    m, pivots = rng.normal(size=(60, 12)), rng.normal(size=(20, 12))
    files, asked = permutation_index.Postings(m, pivots, 9), permutation_index.permutations(rng.normal(size=(3, 12)), pivots, 11)
    seen = permutation_index.permutations(m, pivots, 9)
    for q in asked:
        for v, gain in zip(seen, files.gains(q)):
            a, b = {p: k for k, p in enumerate(q.tolist())}, {p: k for k, p in enumerate(v.tolist())}
            far = sum(abs(a.get(p, 11) - b.get(p, 11)) for p in a.keys() | b.keys())
            apart = sum(11 - k for k in range(11)) + sum(11 - k for k in range(9))
            assert gain == apart - far


# -- language model


def brute_scores(rows, order):
    """{(doc_id, number of the row): (n_known, base, score)}, train tokens; all by plain counts."""
    split = [(d, [ngram_trie.END] + (t or "").encode().lower().split() + [ngram_trie.END]) for d, t in rows]
    train = [w for d, w in split if not ngram_trie.is_held_out(d)]
    c = [Counter(), Counter(), Counter()]
    for w in train:
        for k in range(3):
            c[k].update(tuple(w[i - k : i + 1]) for i in range(max(1, k), len(w)))
    n, v = sum(c[0].values()), len(c[0])
    over = lambda g: c[len(g) - 2][g[:-1]]  # noqa: E731 - how often the n-gram's context stands in training
    weights = []
    for k in (1, 2):
        tokens, once = Counter(), Counter()
        for g, m in c[k].items():
            tokens[kind(over(g))] += m
            once[kind(over(g))] += m == 1
        weights.append({x: (tokens[x] - once[x]) / (tokens[x] + 1) for x in tokens})
    out = []
    for d, w in split:
        base = total = known = 0
        for i in range(1, len(w)):
            p = p1 = (c[0][w[i],] + 0.1) / (n + 0.1 * (v + 1))
            for k in range(1, order):
                g = tuple(w[i - k : i + 1]) if i >= k else ()
                if g and over(g):
                    weight = weights[k - 1].get(kind(over(g)), 0)
                    p = weight * c[k][g] / over(g) + (1 - weight) * p
            base, total, known = base + math.log10(p1), total + math.log10(p), known + (c[0][w[i],] > 0)
        out.append((d, ngram_trie.is_held_out(d), len(w) - 1, known, n, base, total))
    return out


def kind(count):
    return count if count < 16 else 12 + int(math.log2(count))


@pytest.mark.parametrize("order, fan, shard_bytes, split", [(2, 256, 8 << 20, 50_000), (3, 256, 8 << 20, 50_000), (3, 2, 9_000, 20)])
def test_scores_are_those_of_plain_counts(odd, rows, empty, monkeypatch, order, fan, shard_bytes, split):
    monkeypatch.setattr(ngram_trie, "SPLIT", split)
    key = lambda r: (r[0] is None, r[0] or 0, r[2], round(r[5], 3))
    found = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in ngram_trie.score(odd, order, fan, shard_bytes).collect()), key=key)
    for a, b in zip(found, sorted(brute_scores(rows, order), key=key), strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5]) and abs(a[6] - b[6]) <= 0.02 * a[2]
    assert ngram_trie.score(empty, order).collect() == []
    assert ngram_trie.is_held_out(None) and ngram_trie.is_held_out(3) == (zlib.crc32(b"3") % 10 == 0)


def test_what_occurs_twice_is_scored_apart(spark):
    rng = np.random.default_rng(9)
    texts = [" ".join(f"w{x}" for x in rng.zipf(1.3, 120) % 5000) for _ in range(120)]
    train = [i for i in range(1000) if not ngram_trie.is_held_out(i)]
    docs = spark.createDataFrame([(train[k], t) for k, t in enumerate(texts + texts[:40])], "doc_id long, text string")
    scores = {r.doc_id: r.score / r.n_tokens for r in ngram_trie.score(docs, 3).collect()}
    twice, once = [scores[train[k]] for k in range(40)], [scores[train[k]] for k in range(40, 120)]
    assert min(twice) > max(once)


def test_elias_fano_and_the_trie_round_trip():
    rng = np.random.default_rng(2)
    for n, top in ((0, 10), (1, 10), (5, 10**9), (3000, 10**9), (30_000, 3001), (2000, 1 << 62), (500, 40_000)):
        values = np.unique(rng.integers(0, top, n)).astype(np.uint64)
        coded = ngram_trie.EliasFano.build(values)
        assert coded.access(np.arange(len(values))).tolist() == values.tolist() if len(values) else coded.n == 0
        asked = np.unique(np.concatenate([values, values + np.uint64(1), np.array([0, 3, top, top + 7], np.uint64)]))
        place = {v: i for i, v in enumerate(values.tolist())}
        assert coded.find(asked).tolist() == [place.get(x, -1) for x in asked.tolist()]
    steps = np.cumsum(rng.integers(0, 3, 400))  # pointers may repeat
    assert ngram_trie.EliasFano.build(steps).access(np.arange(400)).tolist() == steps.tolist()
    pairs = sorted({(int(a), int(b)) for a, b in rng.integers(0, 60, (500, 2))})
    a, b = np.array(pairs, np.uint64).T
    codes = rng.integers(1, 256, len(pairs)).astype(np.uint8)
    trie = ngram_trie.Trie(a, b, codes)
    asked = np.array([(x, y) for x in range(62) for y in range(62)], np.uint64).T
    known = dict(zip(pairs, codes.tolist()))
    assert trie.lookup(*asked).tolist() == [known.get((x, y), 0) for x in range(62) for y in range(62)]
    assert trie.n_bytes < 4 * len(pairs) and not hasattr(trie.contexts, "decode")
    p = np.array([1.0, 0.3, 1e-4, 1e-8])
    assert np.allclose(ngram_trie.log10_of(ngram_trie.quantise(p)), np.log10(p), atol=0.02)


# -- packing


def check_packing(out, texts, size=packing.SIZE):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(tokenizer_path(packing.TOKENIZER))
    expected = Counter()
    for d, t in texts:
        ids = tk.encode(t or "", add_special_tokens=False).ids + [0]
        for k in range(0, len(ids), size):
            part = np.array(ids[k : k + size], "<u4")
            expected[d, k // size, k, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == expected
    by = defaultdict(list)
    for r in out:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= size
    return len(by), -(-sum(r.length for r in out) // size)


def test_pieces_are_the_librarys_and_sequences_gapless(odd, rows, empty):
    path = tokenizer_path(packing.TOKENIZER)
    used, least = check_packing(packing.pack(odd, path).collect(), rows)
    assert used <= least + 1 and packing.pack(empty, path).collect() == []


def test_special_strings_and_cases_in_texts(spark):
    texts = [(1, "<|endoftext|> A <|ENDOFTEXT|> it's I'LL ÉCOLE ﬁ Å"), (2, "x<|startoftext|>Y   z q")]
    check_packing(packing.pack(spark.createDataFrame(texts, "doc_id long, text string"), tokenizer_path(packing.TOKENIZER)).collect(), texts)


def test_the_plan_uses_every_piece_once_and_finds_exact_fills():
    rng = np.random.default_rng(4)
    for counts in ({2048: 3, 1000: 5, 1048: 5}, {7: 10}, dict(Counter(rng.integers(1, 2049, 4000).tolist())), {1500: 2, 300: 2, 200: 2, 48: 2}, {}):
        used, n = Counter(), 0
        for pattern, times in packing.plan(counts):
            assert sum(pattern) <= 2048
            n += times
            for x in pattern:
                used[x] += times
        assert used == Counter(counts) and n <= -(-sum(k * v for k, v in counts.items()) // 2048) * 1.01 + 1
    assert len(packing.plan({1500: 2, 300: 2, 200: 2, 48: 2})) == 1


# -- the pipeline


def test_the_pipeline_is_its_stages_in_plain_python(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = {r.doc_id for r in quality_rules.quality(docs).where("kept").collect()}
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect() if r.doc_id in kept]
    prints = [simhash.fingerprint(t.encode()) for _, t, _ in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= simhash.RADIUS:
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        least[find(i)] = min(least.get(find(i), r[0]), r[0])
    rows = [(d, secrets.redact_text(t), s) for d, t, s in rows if d in least.values()]
    copies = {d: taken // n for d, n, _, _, taken in brute_mix(rows) if n}
    texts = [(d, t) for d, t, _ in rows for _ in range(copies.get(d, 0))]
    used, lower = check_packing(corpus_pipeline.run(spark, sf_dir).collect(), texts)
    assert used <= lower + 1 and 0 < len(texts)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).columns == docs.columns


def test_odd_documents_pass_through_the_pipeline(spark, odd, empty):
    for docs in (odd, empty):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, "")
        docs.collect()


def test_mixed_documents_keep_columns_of_any_name(spark):
    rows = [(k, f"some words of text {k}", f"s{k % 3}", k, k, k, k) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, _copies long, _taken_id long, copy long, c0 long")
    taken = {r.doc_id: r.taken // r["size"] for r in mixing.mix(docs).collect()}
    out = Counter(tuple(r) for r in mixing.mixed_documents(docs).collect())
    assert mixing.mixed_documents(docs).columns == docs.columns and out == Counter({r: taken[r[0]] for r in rows if taken[r[0]]})


def test_large_sources_are_dealt_out_by_salts(spark, monkeypatch):
    docs = spark.createDataFrame([(k, "a b c " * (k % 5), "hot" if k % 3 else f"s{k % 4}") for k in range(300)], "doc_id long, text string, source string")
    plain = Counter(mixing.mix(docs).collect())
    monkeypatch.setattr(mixing, "LARGE", 20)
    assert Counter(mixing.mix(docs).collect()) == plain


def test_the_pipeline_loses_no_document_for_its_id(spark):
    import corpus_pipeline

    rng = random.Random(11)
    prose = lambda: " ".join(rng.choice("the of and to in that with river stone letter garden evening window brother follow quiet morning".split()) for _ in range(120)) + "."
    ids = [-(1 << 63), -3, 1 << 61, (1 << 61) + 5, 1 << 62, (1 << 63) - 1, None]
    docs = spark.createDataFrame([(d, prose(), "en", "s", 1) for d in ids], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, "")
        assert Counter(r.doc_id for r in docs.collect()) == Counter(ids), name
