"""Repeat removal and near-duplicates against brute force."""

import hashlib
import os
from collections import Counter
from urllib.parse import urlparse

import numpy as np
import pytest
import xxhash

from offerlens.llm import rindex_dedup, simhash
from offerlens.llm.components import connected_components


def brute_repeats(rows, length=50):
    key = lambda d: 1 << 62 if d is None else d
    first = {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            first[w] = min(first.get(w, 1 << 63), key(d))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if first[b[i : i + length]] < key(d):
                gone[i : i + length] = True
        spans = int(gone[:1].sum()) + int((gone[1:] & ~gone[:-1]).sum())
        out.append((d, len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("hot", [rindex_dedup.HOT, 0, 2])
def test_repeats_are_those_of_brute_force(odd, rows, hot):
    found = Counter(tuple(r) for r in rindex_dedup.remove_repeats(odd, hot=hot).collect())
    assert found == brute_repeats(rows)


def test_messages_over_several_hops_give_the_same(odd, rows):
    for fan, shard_bytes in ((2, 12_000), (3, 4_000), (256, 500)):
        found = Counter(tuple(r) for r in rindex_dedup.remove_repeats(odd, hot=100, fan=fan, shard_bytes=shard_bytes).collect())
        assert found == brute_repeats(rows)


def test_messages_grow_with_blocks_and_hops():
    from offerlens.llm.routing import Items, Net, ask

    rng = np.random.default_rng(3)
    for blocks, shards in ((300, 100), (3_000, 1_000), (300_000, 100_000)):
        net = Net(shards, blocks, 64)
        keys = np.sort(rng.integers(0, 1 << 48, 200_000).astype(np.uint64))
        sent = list(ask(net, 7, net.shard_of(keys), Items([keys])))
        assert len(sent) <= 64 and 64**net.levels >= shards > 64 ** (net.levels - 1)


@pytest.mark.parametrize("blocks, shards", [(720, 257), (864, 309), (3_456, 1_236), (20_000, 70_000)])
def test_a_receiver_at_a_hop_holds_about_what_a_block_sends(blocks, shards):
    from offerlens.llm.routing import Net

    net = Net(shards, blocks)
    group = np.array([net.group_of(b) for b in range(blocks)])
    for level in range(1, net.levels):  # a sender has an item for each shard
        senders = np.unique(group, return_counts=True)[1].max()
        assert senders * np.unique(net.to(level, np.arange(shards), 0), return_counts=True)[1].max() <= 3 * shards * net.base ** (level - 1)
        group //= net.base


def test_what_receivers_held_is_let_go(odd, rows, monkeypatch):
    from offerlens.llm import common, routing

    files = []

    def release(written):
        files.append(written._jdf.queryExecution().analyzed().rdd().getCheckpointFile().get())
        assert os.listdir(urlparse(files[-1]).path)
        common.release(written)

    monkeypatch.setattr(routing, "release", release)
    found = Counter(tuple(r) for r in rindex_dedup.remove_repeats(odd, hot=100, fan=3, shard_bytes=4_000).collect())
    assert found == brute_repeats(rows) and files and not any(os.path.exists(urlparse(f).path) for f in files)


def test_repeats_of_an_empty_table(empty):
    assert rindex_dedup.remove_repeats(empty).collect() == []


def test_what_stays_is_returned_when_asked_for(spark):
    a = "".join(chr(97 + i % 26) for i in range(60))
    docs = spark.createDataFrame([(1, a), (2, "new " + a + " end")], "doc_id long, text string")
    out = {r.doc_id: r for r in rindex_dedup.remove_repeats(docs, keep_text=True).collect()}
    assert out[1].text == a and out[2].text == "new  end" and out[2].n_spans == 1


def test_the_run_index_counts_shared_symbols():
    texts = [b"abracadabra", b"cadabrac", b"\xff\xff\x00", b"abra"]
    index = rindex_dedup.RunIndex(np.frombuffer(b"".join(texts), np.uint8), np.array(list(map(len, texts))))
    suffixes = [(t[i:], k, i) for k, t in enumerate(texts) for i in range(len(t) + 1)]
    starts = np.cumsum([0] + [len(t) + 1 for t in texts])
    order = sorted(suffixes, key=lambda s: (s[0], s[1]))
    rows = index.rows()
    assert [rows[int(starts[k] + i)] for _, k, i in order] == list(range(len(order)))
    at = [int(starts[k] + i) for _, k, i in order]
    shared = index.matching()[at]
    for n, (a, b) in enumerate(zip(order, order[1:])):
        same = 0
        while same < min(len(a[0]), len(b[0])) and a[0][same] == b[0][same]:
            same += 1
        assert shared[n + 1] == same
    runs = len(index.run_at)
    assert runs == len(index.run_symbol) == len(index.head_sample) == len(index.tail_sample) < len(order)
    assert all(at[r] == h for r, h in zip(index.run_at.tolist(), index.head_sample.tolist())) and not hasattr(index, "order")
    for r, (_, k, i) in enumerate(order):
        if i:
            assert at[index.lf(np.array([r]))[0]] == at[r] - 1


def brute_print(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    grams = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def test_near_duplicate_groups_are_those_of_brute_force(odd, rows):
    prints = [brute_print(t) for _, t in rows]
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
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    expected = Counter((d, prints[i], least.get(find(i))) for i, (d, _) in enumerate(rows))
    assert Counter((r.doc_id, r.fp % 2**64, r.component_id) for r in simhash.near_duplicates(odd).collect()) == expected


def test_large_buckets_are_compared_tile_by_tile(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 40, dtype=np.int64)
    fps = np.unique(np.concatenate([base, base ^ 1, base ^ 6, base ^ (1 << 40)]))
    df = spark.createDataFrame([(int(x), int(x)) for x in fps], "fp long, node long")
    one = {(r.node, r.root) for r in connected_components(simhash.links(df)).collect()}
    many = {(r.node, r.root) for r in connected_components(simhash.links(df, bucket_limit=2)).collect()}
    assert one == many and len({r for _, r in one}) == 40


def test_one_of_each_group_stays(odd, rows, empty):
    kept = simhash.drop_near_duplicates(odd)
    assert kept.columns == odd.columns
    groups = simhash.near_duplicates(odd.where("doc_id IS NOT NULL")).collect()
    assert Counter(r.doc_id for r in kept.collect()) == Counter({r.component_id for r in groups} | {None})
    assert simhash.near_duplicates(empty).collect() == [] and simhash.drop_near_duplicates(empty).collect() == []


def test_components_of_paths_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, i) for i in range(101, 120)] + [(7, 7), (200, 200), (101, 119), (None, 3)]
    out = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(out[i] == 0 for i in range(51)) and all(out[i] == 100 for i in range(100, 120)) and out[200] == 200


FAR = [-(1 << 63), -3, 0, 1 << 61, (1 << 61) + 5, (1 << 61) + 12, 1 << 62, (1 << 63) - 1]


@pytest.mark.parametrize("nameless", [False, True])
def test_no_document_is_lost_for_its_id(spark, nameless):
    texts = [f"{w} {w} quite {w} unlike {w} any other {w} text {k} of {w} these" for k, w in enumerate("ant boar cow dodo eel fox gnu hen".split())]
    rows = list(zip(FAR, texts)) + [(FAR[-1], texts[-1]), (7, texts[3]), (8, texts[-1])]
    rows += [(None, texts[0]), (None, "nobody else says this here today"), (None, "nobody else says this here today")] if nameless else []
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {(r.doc_id, r.fp, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    first = {}
    for d, t in rows:
        if d is not None:
            first[t] = min(first.get(t, d), d)
    prints = {t: np.array([simhash.fingerprint(t.encode())], "<u8").view(np.int64)[0].item() for _, t in rows}
    assert found == {(d, prints[t], first.get(t)) for d, t in rows}
    kept = [r.doc_id for r in simhash.drop_near_duplicates(docs).collect()]
    assert sorted(k for k in kept if k is not None) == sorted(set(first.values())) and kept.count(None) == 3 * nameless
