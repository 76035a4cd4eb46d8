import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from readloom.llm import ngram_join as nj


def brute(texts):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(sets[i]), find(i)) for i in range(len(texts))}


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    line = " ".join(rng.choices(vocabulary, k=14))
    texts = [None, "", " \n\t", "one two", "ONE two", "one two three", "a b c d e", "a b c d e f", "ÀB c", "àb c"]
    for _ in range(12):
        base = rng.choices(vocabulary, k=rng.randint(4, 90))
        for _ in range(rng.randint(1, 9)):
            copy = base[:]
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append((line + "\n" if rng.random() < 0.4 else "") + " ".join(copy))
    chain = rng.choices(vocabulary, k=80)
    for k in range(12):  # each links to the next alone
        texts.append(" ".join(chain[3 * k :] + rng.choices(vocabulary, k=3 * k)))
    texts += [texts[20]] * 6 + [line, line + " x", f"{line} {line}"]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize(("seed", "share"), [(1, 1000), (2, 3)])
def test_components_against_brute_force(spark, monkeypatch, seed, share):
    monkeypatch.setattr(nj, "SHARE", share)
    texts = corpus(seed)
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, root string, n int").repartition(3)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in nj.with_components(docs).collect()}
    assert found == brute(texts)


@pytest.mark.parametrize("elsewhere", [False, True])
def test_classes_of_one_group_meet(spark, elsewhere):
    """Three sets of one prefix, of which the two that are not the group's first link; its late prefix shingle is or is not in another group."""
    key = lambda t: hashlib.md5(nj.Shingles(1)(t).tobytes()).digest()
    c = [f"c{i}" for i in range(17)]
    for k in range(1000):
        a, b, d = (" ".join([f"r{k}", f"s{k}", f"t{k}", *x]) for x in (c[:8], c[8:16], [*c[8:15], c[16]]))
        if key(a) < min(key(b), key(d)):
            break
    texts = [a, b, d] + [" ".join([*c, *(f"f{i}x{j}" for j in range(60))]) for i in range(20)]
    if elsewhere:
        texts.append(f"t{k} c0 c1")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in nj.with_components(docs, words=1).collect()}
    assert found[0] == 0 and found[1] == found[2] == 1 and all(found[i] == i for i in range(3, len(texts)))


def test_prefixes_share_a_shingle():
    rng = np.random.default_rng(3)
    for _ in range(300):
        a = rng.choice(60, rng.integers(1, 40), replace=False)
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.9], rng.choice(60, 2)]))
        a = np.unique(a)
        if nj.linked(a, b):
            assert set(a[: nj.prefix_length(len(a))]) & set(b[: nj.prefix_length(len(b))])


def test_one_of_each_component_stays(spark):
    docs = spark.createDataFrame([(3, "a b c d e f", 1), (1, "a b c d e f", 2), (1, "a b c d e f", 2), (2, None, 3), (5, "", 4), (None, "q r s", 5), (7, "q r s", 6)], "doc_id long, text string, n_chars long")
    out = nj.apply(docs)
    assert out.columns == docs.columns
    kept = [(r.doc_id, r.text) for r in out.collect()]
    assert sorted(kept, key=str) == sorted([(1, "a b c d e f"), (2, None), (5, ""), (7, "q r s")], key=str)
    assert nj.with_components(docs.limit(0)).count() == 0


def test_rows_of_one_id_are_documents_of_their_own(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", "p"), (1, "u v w x y z", "q"), (None, "k l m n o p", "r"), (None, "k l m n o p", "s"), (None, None, "t")], "doc_id long, text string, text_key string")
    kept = sorted((r.doc_id, r.text) for r in nj.apply(docs).collect() if r.doc_id)
    assert kept == [(1, "a b c d e f"), (1, "u v w x y z")]
    assert sorted((r.text for r in nj.apply(docs).where("doc_id is null").collect()), key=str) == [None, "k l m n o p"]


def test_cluster_of_near_copies_at_and_under_the_threshold(spark, monkeypatch):
    """Copies that differ in 1 to 12 of 70 places: pairs stand on both sides of 75 %, and lists are longer than may be held."""
    monkeypatch.setattr(nj, "LIST_ROWS", 16)
    rng = random.Random(5)
    base, texts = [f"b{i}" for i in range(70)], []
    for _ in range(150):
        copy = base[:]
        for at in rng.sample(range(70), rng.randint(1, 12)):
            copy[at] = f"v{rng.randrange(2000)}"
        texts.append(" ".join(copy))
    for k in (14, 15, 16):  # of 56 shingles 8 differ: 48 / 64 = 75 %; of 54, 8: 46 / 62; of 58, 8: 50 / 66
        one = [f"k{k}_{i}" for i in range(46 + k)]
        texts += [" ".join(one), " ".join([*one[:-8], *(f"z{k}_{i}" for i in range(8))])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in nj.with_components(docs).collect()} == brute(texts)


def test_bitmaps_bound_the_difference_from_below():
    rng = np.random.default_rng(9)
    for n, m in ((1, 1), (40, 31), (300, 299), (700, 1400), (9000, 7000)):
        a = np.unique(rng.integers(0, 2**64, n, np.uint64))
        b = np.unique(np.concatenate([a[: m // 2], rng.integers(0, 2**64, m - m // 2, np.uint64)]))
        assert nj.least_difference(nj.bitmap(a), nj.bitmap(b)) <= len(np.setxor1d(a, b))
        assert nj.least_difference(nj.bitmap(a), nj.bitmap(a)) == 0


def test_postings_without_a_partner_go():
    """Against every pair of a list, for lists held whole, told as they come, and cut by batches."""
    rng = np.random.default_rng(4)
    rows = sorted({(int(s), int(g)): (int(n), int(rng.integers(1, n + 1))) for s, g, n in zip(rng.integers(0, 40, 900), rng.integers(0, 10**6, 900), rng.integers(1, 60, 900), strict=True)}.items())
    partner = lambda a, b: 175 * min(a[1][1], b[1][1]) >= 75 * (a[1][0] + b[1][0])
    want = {a[0] for a in rows for b in rows if a[0][0] == b[0][0] and a != b and partner(a, b)}
    columns = [np.array(x) for x in ([r[0][0] for r in rows], [r[0][1] for r in rows], [r[1][1] for r in rows], [r[1][0] for r in rows])]
    types = (np.int64, np.int64, np.int32, np.int32)
    for size in (7, 100, 5000):
        for longest in (10, 1000):
            batches = [pa.RecordBatch.from_arrays([pa.array(c[i : i + size].astype(t)) for c, t in zip(columns, types, strict=True)], ["s", "g", "l", "n"]) for i in range(0, len(rows), size)]
            out = [r for b in nj._shared_postings(75, longest)(iter(batches)) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
            found = {(r[0], r[1]) for r in out}
            assert len(found) == len(out) and want <= found
            if longest == 1000:  # some pair with itself in long lists, at most
                assert len(found) < 1.5 * len(want)
            hubs = {r[0]: r[3] for r in out}
            assert all(hubs[r[0]] == r[3] for r in out)


def test_long_texts_are_cut_between_words(monkeypatch):
    text = " ".join(f"Wört{i}" for i in range(3000)) + " " + "x" * 5000 + "\ttail a b c d"
    whole = nj.Shingles()(text)
    monkeypatch.setattr(nj, "PIECE_BYTES", 997)
    assert np.array_equal(nj.Shingles()(text), whole) and len(whole) == 3002


def test_a_large_component_and_near_copies_outside_it(spark, monkeypatch):
    """Pairs that a sketch tells apart are never made, however many classes a component holds."""
    rng = random.Random(21)
    base, texts = [f"w{i}" for i in range(150)], []
    for k in range(140):
        copy = base[:]
        for i in rng.sample(range(5, 75, 10), 2) if k < 80 else rng.sample(range(80, 150, 10), 4):
            copy[i] = f"x{k}.{i}"
        texts.append(" ".join(copy))
    monkeypatch.setattr(nj, "MAX_ROUNDS", 0)  # all that the first hubs leave
    made, links = [], nj._links
    monkeypatch.setattr(nj, "_links", lambda documents, kinds, pairs, *how: (made.append(pairs.count()), links(documents, kinds, pairs, *how))[1])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in nj.with_components(docs).collect()}
    want = brute(texts)
    assert found == want and len({x for _, x in want.values()}) > 20
    assert made[-1] < 400, made  # 5330 places and sizes leave


@pytest.mark.parametrize("kind", ["long", "binary"])
def test_components_of_stars_and_of_the_driver(spark, kind):
    rng = random.Random(8)
    name = (lambda i: i) if kind == "long" else (lambda i: b"%c%03d" % (i % 2 * 200, i))
    pairs = [(name(rng.randrange(150)), name(rng.randrange(150))) for _ in range(110)] + [(name(200 + i), name(201 + i)) for i in range(60)]
    root = {x: x for p in pairs for x in p}
    for _ in root:
        for u, v in pairs:
            root[u] = root[v] = min(root[u], root[v])
    edges = spark.createDataFrame([*pairs, (None, name(1)), (name(2), None), (None, None)], f"u {kind}, v {kind}")
    as_key = (lambda x: x) if kind == "long" else bytes
    for driver_edges in (0, 40, 1000):
        found = {as_key(r.node): as_key(r.root) for r in nj.components(edges, driver_edges).collect()}
        assert found == {x: y for x, y in root.items() if x != y}
    assert nj.components(edges.limit(0)).collect() == []


def test_few_edges_take_no_rounds_of_joins(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)], "u long, v long")
    spark.sparkContext.setJobGroup("few-edges", "")
    assert nj.components(edges).count() == 300
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("few-edges")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs) <= 10
