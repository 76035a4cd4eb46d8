import random
import subprocess
import sys
from collections import Counter

import corpus_pipeline as cp
import test_ngram_join
from readloom.llm import packing, pii, suffix_dedup
from tokenizers import Tokenizer


def test_stages_take_effect(spark, tmp_path):
    rng = random.Random(6)
    body = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    passage = body(70)
    base = body(120)
    rows = [(i, f"{body(60)}\n{body(30)}", "en", f"s{i % 3}") for i in range(30)]
    rows += [(100, base, "en", "s0"), (101, base, "en", "s1"), (102, base + " end", "en", "s0")]
    rows += [(110, f"{body(40)} {passage} {body(30)}", "en", "s0"), (111, f"{body(20)} {passage} {body(50)}", "en", "s1")]
    short = " ".join("".join(rng.choices("abcdefghij", k=5)) for _ in range(55))  # over 50 words in 329 bytes
    fewer = " ".join("".join(rng.choices("abcdefghij", k=9)) for _ in range(45))  # as long, but fewer words
    rows += [(i, f"{body(40)} {short} {body(30)}\n{body(10)} {fewer} {body(30 + i)}", "en", "s1") for i in (112, 113)]
    rows += [(120, f"{body(40)} write to jane.doe@mail.example.com {body(9)}", "en", "s2"), (130, "too short", "en", "s0"), (131, None, None, None)]
    docs = spark.createDataFrame([(*r[:4], len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    held, at = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in cp.STAGES[:-1]:
        held = stage(spark, held, str(tmp_path)).cache()
        assert held.columns == docs.columns
        at[name] = {r.doc_id: r for r in held.collect()}
    assert {130, 131, None}.isdisjoint(at["quality_rules"]) and set(range(30)) <= set(at["quality_rules"])
    assert {100} == {100, 101, 102} & set(at["ngram_jaccard_join"]) and len(at["ngram_jaccard_join"]) == 36
    assert all(passage not in at["suffix_dedup"][i].text and at["suffix_dedup"][i].n_chars == len(at["suffix_dedup"][i].text) for i in (110, 111))
    assert all(short not in at["suffix_dedup"][i].text and fewer in at["suffix_dedup"][i].text for i in (112, 113))
    assert at["suffix_dedup"][0].text == rows[0][1]
    new = at["pii"][120].text
    assert "jane.doe" not in new and len(pii.find(new)) == 1
    packed = cp.run(spark, str(tmp_path)).toPandas()
    assert set(packed.doc_id) == set(at["pii"]) and packed.groupby("sequence_id").length.sum().max() <= 2048


def by_hand(rows, key):
    """(doc_id, text) after each of the first four stages, by plain Python over all documents."""
    plain = lambda t: " ".join(t.lower().split())
    held = {}
    for _, text, host in rows:
        for line in {plain(x) for x in (text or "").split("\n")} - {""}:
            held.setdefault((host, line), set()).add(plain(text))
    one = []
    for i, text, host in rows:
        words = (text or "").split()
        grams = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
        again = {j for k in range(len(words) - 4) if grams[tuple(words[k : k + 5])] > 1 for j in range(k, k + 5)}
        kept = "\n".join(x for x in (text or "").split("\n") if not x.split() or len(held[host, plain(x)]) <= 30)
        left = len(kept.split())
        if len(words) >= 10 and 100 * len(again) <= 20 * len(words) and left >= 10 and 100 * left >= 30 * len(words):
            one.append((i, kept))
    roots = test_ngram_join.brute([t for _, t in one])
    two = [x for k, x in enumerate(one) if roots[k][1] == k]
    data = [t.encode() for _, t in two]
    seen = Counter(d[i : i + 250] for d in data for i in range(len(d) - 249))
    three = []
    for (i, _), d in zip(two, data, strict=True):
        starts = [{"a": k, "b": k + 250} for k in range(len(d) - 249) if seen[d[k : k + 250]] > 1]
        gone = [(a, b) for a, b in suffix_dedup.merged(starts) if len(d[a:b].split()) > 50]
        three.append((i, suffix_dedup.kept_bytes(d, gone).decode(errors="ignore")))
    return one, two, three, [(i, pii.replace(t, pii.Surrogates(key))[0]) for i, t in three]


def test_stages_against_brute_force(spark, tmp_path):
    rng = random.Random(16)
    body = lambda n: " ".join("".join(rng.choices("abcdeé", k=rng.randint(1, 9))) for _ in range(n))
    bar, passages = body(12), [body(n) for n in (45, 55, 70, 120)]
    rows = []
    for i in range(130):
        lines = [body(rng.randint(3, 60)) for _ in range(rng.randint(1, 4))]
        lines += [f"{body(8)} {p} {body(9)}" for p in rng.sample(passages, rng.randint(0, 2))] + [bar] * (i % 3 == 0)
        lines += [rng.choice(["call 415-555-0100 now", "Mr. John Smith <j.s@mail.example.com>", "from 97.51.17.173"])] * (i % 5 == 0)
        rng.shuffle(lines)
        rows.append((i, "\n".join(lines), rng.choice(["h1", "h1", None])))
    for i in range(130, 170):  # exact and near copies
        words = rows[rng.randrange(130)][1].split(" ")
        for _ in range(rng.choice([0, 0, 1, 3])):
            words[rng.randrange(len(words))] = body(1)
        rows.append((i, " ".join(words), "h1"))
    rows += [(200, None, "h1"), (201, "", None), (202, "x " * 40, "h1")]
    docs = spark.createDataFrame([(i, t, "en", h, len(t or "")) for i, t, h in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    held = spark.read.parquet(str(tmp_path / "documents.parquet"))
    want = by_hand(rows, pii.session_key(spark))
    assert len({len(x) for x in want[:2]}) == 2 and want[2] != want[1] and want[3] != want[2]
    for (name, stage), expected in zip(cp.STAGES[:-1], want, strict=True):
        held = stage(spark, held, str(tmp_path))
        held.write.parquet(str(tmp_path / name))
        held = spark.read.parquet(str(tmp_path / name))
        assert sorted((r.doc_id, r.text) for r in held.collect()) == sorted(expected), name
    packed = cp.STAGES[-1][1](spark, held, str(tmp_path)).toPandas()
    library = Tokenizer.from_file(packing.default_tokenizer())
    assert dict(packed.groupby("doc_id").length.sum()) == {i: len(library.encode(t, add_special_tokens=False).ids) + 1 for i, t in want[3]}
    for _, own in packed.sort_values("offset").groupby("sequence_id"):
        assert own.offset.tolist() == [0, *own.length.cumsum()[:-1]] and own.length.sum() <= 2048


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long, root string, bits int").write.parquet(str(tmp_path / "documents.parquet"))
    assert cp.run(spark, str(tmp_path)).count() == 0


_RETAINED = """
import re
import pyarrow as pa
from readloom.llm import common, ngram_join as nj
def anonymous():
    return int(re.search(r"Pss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read())[1]) >> 10
def batches():
    for k in range(3):
        yield pa.record_batch([pa.array([" ".join(f"w{(i * j + k) % 9973}" for j in range(400)) for i in range(4000)])], ["text"])
for _ in nj._sketch(5)(batches()):
    pass
next(common.slices(iter([])), None)  # as the next task begins
before = anonymous()
pa.default_memory_pool().release_unused()
__import__("ctypes").CDLL(None).malloc_trim(0)
print(before - anonymous())
"""


def test_workers_give_memory_back():
    """A worker lives from task to task: what a task has freed must not stay with it."""
    out = subprocess.run([sys.executable, "-c", _RETAINED], capture_output=True, text=True, check=True)
    assert int(out.stdout) < 24, out.stdout
