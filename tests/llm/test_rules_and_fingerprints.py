import hashlib
import random

import pytest

from readloom.llm import license_scan, quality_rules as qr, queries, spotsigs


def test_repeated_words_by_brute_force():
    rng = random.Random(1)
    for _ in range(300):
        words = [bytes([rng.randrange(97, 99 + rng.randrange(6))]) for _ in range(rng.randrange(0, 40))]
        grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        want = {k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(i, i + 5)}
        assert qr.repeated_words(words) == len(want)


def test_quality_rules(spark):
    rng = random.Random(2)
    body = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    bar = "Sign UP  for our news\tletter, it is free today"
    rows = [(i, f"{body(40)}\n{bar}\n{body(20)}", "h", 0) for i in range(40)]
    rows += [(100 + i, f"{bar}\n{body(9)}", "h", 0) for i in range(2)]  # depleted
    one = f"{body(50)}\n{body(50)}"
    rows += [(200 + i, one, "h", 0) for i in range(60)]  # copies are one document
    rows += [(300, f"{bar}\n{body(9)}", "other", 0), (301, None, "h", 0), (302, "", None, 0), (None, body(30), None, 0), (303, "a b c d e " * 9, "h", 0), (304, "x " * 3, "h", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long").repartition(4)
    found = {r.doc_id: r for r in qr.verdicts(docs).collect()}
    assert not any(found[i].kept for i in (100, 101, 301, 302, 303, 304)) and all(found[i].kept for i in [*range(40), *range(200, 260), 300, None])
    assert found[0].removed_words == 10 and found[303].base_failed and found[301].n_words == 0
    kept = {(r.doc_id, r.text, r.n_chars) for r in qr.apply(docs).collect()}
    assert len(kept) == 102 and all("Sign" not in t or i == 300 for i, t, _ in kept) and all(n == len(t) for _, t, n in kept)
    assert qr.apply(docs.limit(0)).count() == 0 and qr.apply(docs).columns == docs.columns


def test_quality_rules_keep_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h i j k l", "s", 5, "x"), (2, "w " * 300_000, "s", 6, "y")], "doc_id long, text string, source string, row_key int, removed string")
    out = qr.apply(docs)
    assert out.columns == docs.columns and [tuple(r) for r in out.collect()] == [(1, "a b c d e f g h i j k l", "s", 5, "x")]


def test_a_line_counts_whatever_its_hash(spark):
    """The line of least hash of every document that holds it is removed as any other."""
    rng = random.Random(11)
    line = min((f"one two three {i}" for i in range(5000)), key=lambda t: hashlib.md5(t.encode()).hexdigest())
    rows = [(i, line + "\n" + " ".join(f"w{rng.randrange(10**6)}" for _ in range(40)), "h") for i in range(60)]
    found = qr.verdicts(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert {r.removed_words for r in found} == {4}


def test_lines_of_a_template_are_removed(spark):
    rng = random.Random(5)
    body = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    shared = [f"{body(12)}" for _ in range(12)]
    texts = ["\n".join([*shared, body(30), body(30), body(30)]) for _ in range(100)]
    bar = body(10)
    held = [f"{bar}\n{body(40)}" for _ in range(50)]
    rows = [(i, t, "templates") for i, t in enumerate(texts)]
    rows += [(200 + i, t, "copies") for i, t in enumerate(held + [held[0]] * 101)]  # more copies than documents
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = {r.doc_id: r for r in qr.verdicts(docs).collect()}
    assert {found[i].removed_words for i in range(100)} == {144} and {found[200 + i].removed_words for i in range(151)} == {10}


def fingerprint(text):
    import regex

    words = regex.sub(r"[^\p{L}\p{N}]+", " ", text.lower()).strip().split(" ")
    content, run, out = [], [], set()
    for w in filter(None, words):
        if w in spotsigs.ANCHORS:
            run.append(w)
        else:
            content.append((tuple(run), w))
            run = []
    for i in range(len(content) - spotsigs.CHAIN + 1):
        if content[i][0]:
            chain = "~".join([*content[i][0], content[i][1]]) + " " + " ".join(w for _, w in content[i + 1 : i + spotsigs.CHAIN])
            out.add(hashlib.md5(chain.encode()).hexdigest()[:16])
    return out or ({hashlib.md5(text.encode()).hexdigest()[:16]} if text else set())


def jaccard(a, b):
    return 1.0 if not a | b else len(a & b) / len(a | b)


def test_spotsigs_by_brute_force(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(spotsigs, "BUCKET_ROWS", 4)
    rng = random.Random(3)
    words = ["the", "of", "is", "cat", "dog", "House", "été", "und", "x1", "tree."]
    texts = [None, "", "the", "no anchors here at", "é"] + [" ".join(rng.choices(words, k=rng.randrange(1, 60))) for _ in range(40)]
    ids = rng.sample(range(-50, 10**6), len(texts))
    spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = {r.doc_id: r for r in spotsigs.fingerprints_query(spark, str(tmp_path)).collect()}
    order = sorted(zip(ids, texts))
    for k, (i, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        cut = len(t) // 2
        edited = t[: len(t) - cut] + after[:cut]
        row = found[i]
        assert row.n_chars == len(t) and row.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert row.fingerprint == "".join(sorted(fingerprint(t))) and row.edited_fingerprint == "".join(sorted(fingerprint(edited)))
        assert abs(row.near_edited - jaccard(fingerprint(t), fingerprint(edited))) < 1e-12 and abs(row.near_next - jaccard(fingerprint(t), fingerprint(after))) < 1e-12


def test_similar_pairs_by_brute_force(spark):
    rng = random.Random(4)
    texts = []
    for _ in range(25):
        base = rng.choices(["the", "of", "is", *[f"w{i}" for i in range(40)]], k=80)
        for _ in range(rng.randrange(1, 4)):
            copy = base[:]
            copy[rng.randrange(80)] = "new"
            texts.append(" ".join(copy))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    pairs, members = spotsigs.similar_pairs(docs, 0.6)
    sets = {"".join(sorted(s)): s for s in map(fingerprint, texts)}
    want = {(a, b) for a in sets for b in sets if a < b and jaccard(sets[a], sets[b]) >= 0.6}
    assert {(r.left, r.right) for r in pairs.collect()} == want and want and members.count() == len(texts)


def test_fingerprints_of_odd_tables(spark):
    """Ids that tie or are null, repeated rows, names of our own columns, a very long text, no rows."""
    long = "the cat of dogs is red " * 40
    rows = [(2, "the b c d", 1, "x"), (2, "the a c d", 2, "y"), (None, long, 3, None), (2, "the a c d", 2, "y"), (None, None, 4, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _key int, signatures string")
    found = spotsigs.with_next(docs).select("doc_id", "text", "next_text", "signatures").collect()
    order = ["", long, "the a c d", "the a c d", "the b c d"]
    assert sorted((r.text, r.next_text) for r in found) == sorted(zip(order, order[1:] + order[:1]))
    assert all(r.signatures == sorted(fingerprint(r.text)) for r in found)
    pairs, members = spotsigs.similar_pairs(docs)
    assert pairs.count() == 0 and sorted(r.fingerprint for r in members.collect()) == sorted("".join(sorted(fingerprint(t))) for t in order)
    assert spotsigs.with_next(docs.limit(0)).count() == 0 and spotsigs.similar_pairs(docs.limit(0))[0].count() == 0


def test_license_scan(spark):
    mit = license_scan.KNOWN[0][1]
    rows = [(1, mit), (2, "Copyright (c) 2020 X\n\n" + mit.upper().replace("COPYRIGHT HOLDERS", "Copyright Owners").replace(",", " ,") + "\n"), (3, "text\nLicensed under CC BY-NC 4.0.\nreleased under the MIT Licence!"), (4, None), (5, "")]
    found = {r.doc_id: r for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[1].license == found[2].license == "MIT" and found[3].license is None and found[3].line_licenses == "CC-BY-NC-4.0,MIT"
    assert found[4].n_license_lines == 0 and found[5].license is None


def test_license_scan_of_odd_tables(spark):
    mit = license_scan.KNOWN[0][1]
    rows = [(1, mit, "own", "d"), (1, mit, "own", "d"), (None, "x" * 2_000_000 + "\nLicensed under CC BY 4.0.", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, license string, digest string")
    out = license_scan.scan(docs)
    assert out.columns == ["doc_id", "text", "digest", *license_scan.OUTPUTS]
    assert sorted((str(r.doc_id), r.license, r.digest, r.line_licenses) for r in out.collect()) == [("1", "MIT", "d", "")] * 2 + [("None", None, None, "CC-BY-4.0")]
    assert license_scan.scan(docs.limit(0)).count() == 0
    none = license_scan.scan(docs, spark.createDataFrame([], "digest string, license string"))
    assert {r.license for r in none.collect()} == {None}
    with pytest.raises(ValueError):
        license_scan.scan(docs, spark.range(license_scan.MAX_KNOWN + 1).selectExpr("string(id) as digest", "'x' as license"))


def test_whole_licenses(spark):
    import textwrap
    from importlib.resources import files

    mit, isc = license_scan.KNOWN[0][1], next(t for n, t in license_scan.KNOWN if n == "ISC")
    held = {p.name[:-4]: p.read_text() for p in files("readloom.llm").joinpath("licenses").iterdir()}
    at = isc.index("copyright notice")
    cases = [("MIT", "MIT License\n\nCopyright (c) 2020 X\n\n" + textwrap.fill(mit, 78)), ("ISC", f"ISC License\n\nCopyright 2020 X\n\n{isc[:at]}\n{isc[at:]}")]
    cases += list(held.items()) + [("BSD-3-Clause", "Copyright (c) 2001, Y\nAll rights reserved.\n\n" + held["BSD-3-Clause"].split("\n", 2)[2])]
    cases += [("Apache-2.0", held["Apache-2.0"].split("APPENDIX")[0]), (None, held["BSD-3-Clause"] + "more"), (None, "copyright notice")]
    rows = [(i, t) for i, (_, t) in enumerate(cases)]
    found = {r.doc_id: r.license for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [found[i] for i in range(len(cases))] == [n for n, _ in cases]


def test_registry_names():
    names = queries.queries()
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 11)] and set(queries.oracle_sql()) <= set(names)
