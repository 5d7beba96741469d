"""Spelling variants, passages and the Merkle manifest against brute force; every SQL statement against its query."""

import glob
import hashlib
import os
import random
import re
import zlib
from collections import Counter

import pytest

from offerlens.llm import merkle, ngram_trie, queries, rindex_dedup, spelling, suffix_trees

from .conftest import SCHEMA, odd_rows

SMALL = "/root/testdata/sf0.001"
LAST = (1 << 63) - 1


def ascii_lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


# -- spelling --------------------------------------------------------------------------------------


def brute_words(rows):
    count = Counter()
    for d, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = ascii_lower(run)
            h = zlib.crc32(f"{d}:{run}".encode())
            if d is not None and h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    return {w: k for w, k in count.items() if len(w) >= 6 and k >= 5}


def brute_variants(rows):
    n = brute_words(rows)
    letters = {x for w in n for x in w}
    form, near = {}, {}
    for w in n:
        edits = {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + a + w[i:] for i in range(len(w) + 1) for a in letters} | {w[:i] + a + w[i + 1 :] for i in range(len(w)) for a in letters}
        near[w] = {x for x in edits - {w} if x in n}
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {(w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n}


@pytest.fixture(scope="module")
def misspelt():
    rng = random.Random(5)
    base = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(5, 9))) for _ in range(40)]
    rows = []
    for i in range(150):
        words = []
        for _ in range(60):
            w = rng.choice(base[: 1 + int(40 * rng.random() ** 3)])
            if rng.random() < 0.3:
                k = rng.randrange(len(w))
                w = rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice("abcÿÀ") + w[k:], w[:k] + "x" + w[k + 1 :]])
            words.append(w.upper() if rng.random() < 0.1 else w)
        rows.append((None if i % 50 == 0 else i, " ".join(words) + " z" * 3 + ("q" * 500 if i % 20 == 0 else "")))
    return [*rows, (9000, None), (9001, ""), rows[3], rows[3]]


@pytest.mark.parametrize("shard,wave", [(spelling.SHARD, spelling.WAVE), (50, 2), (7, 3)])
def test_variants_are_those_of_brute_force(spark, misspelt, shard, wave):
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in misspelt], "doc_id long, text string, word string, n int")
    found = [tuple(r) for r in spelling.variants(docs, shard, wave).collect()]
    assert len(found) == len(set(found)) and set(found) == brute_variants(misspelt)


def test_a_trie_accepts_what_is_one_edit_away():
    words = sorted(["ab", "abc", "abcd", "abd", "bc", "abcc", "xabc", "a" * 300, "a" * 301])
    trie = spelling.Trie.load(spelling.Trie.build(words, spelling.np.arange(len(words))).cells())
    assert trie.texts == words
    asked = ["abc", "", "a" * 300, "zzz", "a"]
    flat, at = spelling._ragged(asked)
    w, other = trie.near(flat, at[:-1], spelling.np.diff(at))
    found = {(asked[a], words[b]) for a, b in zip(w, other)}
    assert found == {("abc", x) for x in ("ab", "abcd", "abd", "bc", "abcc", "xabc")} | {("a" * 300, "a" * 301), ("a", "ab")}


# -- passages --------------------------------------------------------------------------------------


def brute_passages(rows, width=13):
    key = lambda d: LAST if d is None else d
    texts = [(d, (t or "").encode().split()) for d, t in rows]
    first = {}
    for d, w in texts:
        for i in range(len(w) - width + 1):
            x = tuple(w[i : i + width])
            first[x] = min(first.get(x, LAST), key(d))
    out = []
    for d, w in texts:
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if first[tuple(w[i : i + width])] < key(d):
                gone[i : i + width] = [True] * width
        out.append((d, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()))
    return Counter(out)


@pytest.fixture(scope="module")
def far_rows():
    rows = odd_rows()
    far = [(LAST, rows[3][1] + " tail"), (-5, rows[10][1]), (-LAST - 1, rows[6][1]), ((1 << 61) + 3, rows[12][1])]
    return rows + [(d, t, "en", "far", 1, "x", 1) for d, t in far]


@pytest.mark.parametrize("sizes", [{}, {"group": 20}, {"group": 3, "fan": 2, "shard_bytes": 12_000}, {"group": 1, "shard_bytes": 500}])
def test_passages_are_those_of_brute_force(spark, far_rows, sizes):
    found = Counter(tuple(r) for r in suffix_trees.remove_passages(spark.createDataFrame(far_rows, SCHEMA), **sizes).collect())
    assert found == brute_passages([(r[0], r[1]) for r in far_rows])


def test_long_prefixes_miss_none_above_the_limit(spark, far_rows):
    from offerlens.llm.byte_blocks import blocks

    whole = blocks(spark.createDataFrame(far_rows * 3, SCHEMA))
    seen = Counter()
    for row in whole.collect():
        words = suffix_trees.Words(row.asDict())
        seen.update(suffix_trees._strings(words.hashes, 1)[words.fragments(suffix_trees.np.arange(len(words.at)))[2]].tolist())
    for limit in (5, 50):
        found = suffix_trees.long_prefixes(whole, whole.count(), 0, group=limit)[0].tolist()
        assert {k for k, n in seen.items() if n > limit} <= set(found) <= {k for k, n in seen.items() if n > limit / 2}


def test_words_of_one_hash_are_told_apart():
    text = suffix_trees.np.frombuffer(b"aa bb aa cc", suffix_trees.np.uint8)
    begin = suffix_trees.np.array([0, 3, 6, 9])
    number = suffix_trees.numbers(text, begin, begin + 2, suffix_trees.np.zeros(4, suffix_trees.np.uint64))
    assert number.tolist() == [0, 1, 0, 2]


def test_ids_at_the_ends_of_their_range_come_back(spark, far_rows):
    docs = spark.createDataFrame(far_rows, SCHEMA)
    ids = Counter(r[0] for r in far_rows)
    for op in (suffix_trees.remove_passages, rindex_dedup.remove_repeats, ngram_trie.score, merkle.manifest):
        found = op(docs).collect()
        assert Counter(r.doc_id for r in found) == ids
        if op is ngram_trie.score:
            assert all(r.held_out == ngram_trie.is_held_out(r.doc_id) for r in found)


# -- manifest --------------------------------------------------------------------------------------


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_manifest(rows, fanout):
    framed = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, t: H(*[framed(x) for x in (r[0], r[3], r[2], r[4], t)])
    by = {}
    for r in rows:
        by.setdefault(r[3], []).append(r)

    def levels(row):
        out = [row]
        while len(out[-1]) > 1:
            out.append([H(*out[-1][a : a + fanout]) for a in range(0, len(out[-1]), fanout)])
        return out

    keys = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in keys:
        own = sorted(by[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
        trees[s] = own, levels([leaf(r, r[1]) for r in own])
    top = levels([trees[s][1][-1][0] for s in keys])
    out = []
    for k, s in enumerate(keys):
        own, tree = trees[s]
        for i, r in enumerate(own):
            mine = leaf(r, r[1])
            changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            folded = leaf(r, r[1] and ascii_lower(r[1])) if changed else mine
            siblings = []
            for nodes, at in ((tree, i), (top, k)):
                for row in nodes[:-1]:
                    a = at - at % fanout
                    left, right = row[a:at], row[at + 1 : a + fanout]
                    siblings += left + right
                    folded = H(*left, folded, *right)
                    at //= fanout
            out.append((r[0], mine, tree[-1][0], top[-1][0], H(*siblings), folded, folded == top[-1][0]))
    return Counter(out)


@pytest.mark.parametrize("fanout,levels", [(16, 3), (2, 2), (3, 1)])
def test_manifest_is_that_of_brute_force(spark, far_rows, fanout, levels):
    rows = [(r[0], r[1] and (r[1].upper() if k % 3 == 0 else r[1]), *r[2:]) for k, r in enumerate(far_rows)]
    found = Counter(tuple(r) for r in merkle.manifest(spark.createDataFrame(rows, SCHEMA), fanout, levels).collect())
    assert found == brute_manifest(rows, fanout) and {r[-1] for r in found} == {True, False}


def test_proofs_fold_to_the_root(spark, far_rows):
    for r in merkle.manifest(spark.createDataFrame(far_rows, SCHEMA), keep_path=True).collect():
        path = [(p.left, p.right) for p in r.path]
        assert merkle.fold(r.leaf, path) == r.root and merkle.proof_digest(path) == r.proof_sha256


def test_clashing_names_and_empty_tables(spark, odd, empty):
    assert spelling.variants(empty).collect() == suffix_trees.remove_passages(empty).collect() == merkle.manifest(empty).collect() == []
    clash = odd.selectExpr("*", "1 AS leaf", "2 AS skey", "3 AS word", "4 AS n", "5 AS block", "6 AS `all`", "7 AS __at")
    for op in (spelling.variants, suffix_trees.remove_passages, merkle.manifest):
        assert Counter(op(clash).collect()) == Counter(op(odd).collect())


# -- SQL -------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{SMALL}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    found = queries.queries()[name](spark, SMALL)
    cols = sorted(found.columns)
    want = con.sql(queries.oracle_sql()[name])
    assert sorted(want.columns) == cols
    exact = lambda rows: Counter(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows)
    assert exact(found.select(*cols).collect()) == exact(want.select(*cols).fetchall())
