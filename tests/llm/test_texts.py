"""Text operators against brute force."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridloom.llm import leakage, packing, repetition
from gridloom.llm.fmindex import FMIndex, suffix_array
from gridloom.llm.words import distinct_texts, encode, slices, spread, words_of

DOCS = "doc_id long, text string"
ITEMS = "item_id long, text string"
ODD = ["Hello, World_x 12", None, "", "   ", "Straße ﬁ soft­hyphen Ünïcode①½ ΟΔΟΣ", "zero​width", "aaaaa;c'd", " lead", "日本語 テキスト_foo", "\x00nul\x1f"]


def test_words():
    assert words_of("Foo_bar, ﬁx so­ft​１２!") == ["foo", "bar", "fix", "soft12"]
    w = encode(ODD)
    for t, a, b in zip(ODD, w.starts, w.ends, strict=True):
        assert [w.dictionary[int(c)].as_py() for c in w.codes[a:b]] == words_of(t)
    assert len(encode([]).codes) == 0 and len(encode([None]).starts) == 1
    assert list(slices(pa.array(["abc", None, "d" * 9, "e"]), 3)) == [(0, 1, ["abc"]), (1, 3, [None, "d" * 9]), (3, 4, ["e"])]


def test_copies_are_worked_on_once(rows):
    texts, place = distinct_texts(pa.array(["a", None, "b", "a", "", None]))
    assert texts.to_pylist() == ["a", "b", "", None] and place.tolist() == [0, 3, 1, 0, 2, 3]
    assert distinct_texts(pa.array([None, None], pa.string()))[0].to_pylist() == [None] and len(distinct_texts(pa.array([], pa.string()))[0]) == 0
    docs, items = make_corpus(12, 8)
    docs = [(d * 100 + c, t) for d, t in docs[:8] for c in range(25)]  # a corpus of copies
    got = {(r["doc_id"], r["item_id"]): r["leaked_words"] for r in leakage.leaked_items(rows(DOCS, docs), rows(ITEMS, items)).collect()}
    assert got == {k: a for k, (a, _) in leaks_by_hand(docs, items).items()} and got
    led = {r["doc_id"]: r["window_8"] for r in repetition.ledger(rows(DOCS, docs)).collect()}
    assert all(led[d] == pytest.approx(repeated_by_hand(t)[0] / max(1, len(words_of(t)))) for d, t in docs) and len(led) == len(docs)


def test_few_partitions_are_spread(rows):
    d = rows(DOCS, [(i, "a b") for i in range(50)])
    cores = d.sparkSession.sparkContext.defaultParallelism
    assert spread(d.coalesce(1)).rdd.getNumPartitions() == 4 * cores
    assert spread(d.repartition(3)) is not None and spread(d.coalesce(1)).count() == 50
    wide = rows(DOCS, [(i, "a") for i in range(50)])
    assert spread(wide) is wide if wide.rdd.getNumPartitions() >= cores else True


def random_docs(rng, n=6, words=3, most=14):
    return [[rng.randrange(words) for _ in range(rng.randrange(most))] for _ in range(n)]


def test_suffix_array_and_search():
    rng = random.Random(1)
    for _ in range(150):
        docs = random_docs(rng, rng.randrange(1, 7))
        docs += docs[:2]  # copies
        d = len(docs)
        text = [x for i, doc in enumerate(docs) for x in [*(c + d for c in doc), i]]
        assert suffix_array(np.array(text, np.int32), d).tolist() == sorted(range(len(text)), key=lambda i: text[i:])
        sizes = np.array([len(x) for x in docs])
        ends = np.cumsum(sizes)
        index = FMIndex(np.array(sum(docs, []), np.int32), ends - sizes, ends, 4, sample=4)
        phrases = np.array([[rng.randrange(3) for _ in range(3)] for _ in range(8)])
        found = {}
        for p, low, high in zip(*index.search(phrases), strict=True):
            found[int(p)] = sorted(zip(*(x.tolist() for x in index.document_of(index.locate(np.arange(low, high)))), strict=True))
        for p, phrase in enumerate(phrases.tolist()):
            assert found.get(p, []) == [(i, j) for i, x in enumerate(docs) for j in range(len(x) - 2) if x[j : j + 3] == phrase]


def leaks_by_hand(docs, items, n=8):
    out = {}
    for d, text in docs:
        w = words_of(text)
        have = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
        for i, item in items:
            v = words_of(item)
            hit = {k for j in range(len(v) - n + 1) if tuple(v[j : j + n]) in have for k in range(j, j + n)}
            if hit:
                out[d, i] = (len(hit), len(v))
    return out


def make_corpus(seed, n=60):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(25)] + ["ﬁ", "Ü", "é"]
    text = lambda k: " ".join(rng.choice(vocab) for _ in range(k))
    items = [(i, text(rng.randrange(5, 60))) for i in range(12)] + [(50, None), (51, ""), (52, "short one")]
    docs = []
    for d in range(n):
        t = text(rng.randrange(0, 80))
        for _ in range(rng.randrange(3)):
            w = (rng.choice(items[:12])[1]).split()
            a = rng.randrange(len(w))
            t += rng.choice([" ", "\n", " _ "]) + rng.choice([" ", ", ", " "]).join(w[a : a + rng.randrange(1, 40)]).upper() + " " + text(3)
        docs.append((d, t))
    docs += [(100 + d, t) for d, t in docs[:10]] + [(900, None), (901, ""), (902, "x" * 50_000), (903, docs[0][1] * 40)]
    return docs, items


@pytest.mark.parametrize("limits", [{}, {"shard_bytes": 500}, {"block_items": 4}])
def test_leaks_against_brute_force(rows, limits):
    docs, items = make_corpus(2)
    got = leakage.leaked_items(rows(DOCS, docs + docs[:5]), rows(ITEMS, items + items[:3]), **limits).collect()
    assert {(r["doc_id"], r["item_id"]): (r["leaked_words"], r["item_words"]) for r in got} == leaks_by_hand(docs, items)
    assert len(got) == len(leaks_by_hand(docs, items)) > 20
    texts = dict(docs)
    for r in got:  # what stands outside the spans holds no phrase of the item any more
        w = words_of(texts[r["doc_id"]])
        spans = [(s["from"], s["to"]) for s in r["spans"]]
        assert spans == sorted(spans) and all(b - a >= 8 for a, b in spans)
        v = words_of(dict(items)[r["item_id"]])
        phrases = {tuple(v[j : j + 8]) for j in range(len(v) - 7)}
        covered = {x for a, b in spans for x in range(a, b)}
        for j in range(len(w) - 7):
            assert (tuple(w[j : j + 8]) in phrases) <= (set(range(j, j + 8)) <= covered)
    some = leakage.leaked_items(rows(DOCS, docs), rows(ITEMS, items), least_share=0.4, **limits).collect()
    assert {(r["doc_id"], r["item_id"]) for r in some} == {k for k, (a, b) in leaks_by_hand(docs, items).items() if a / b >= 0.4}


def test_leaks_of_nothing(rows):
    docs, items = make_corpus(3, 5)
    assert leakage.leaked_items(rows(DOCS), rows(ITEMS, items)).count() == 0
    assert leakage.leaked_items(rows(DOCS, docs), rows(ITEMS)).count() == 0
    assert leakage.leaked_items(rows(DOCS, [(None, None)]), rows(ITEMS, [(None, "a " * 9)])).count() == 0


def repeated_by_hand(text, n=8):
    w, seen, hit = words_of(text), set(), set()
    for i in range(len(w) - n + 1):
        k = tuple(w[i : i + n])
        if k in seen:
            hit |= set(range(i, i + n))
        seen.add(k)
    return len(hit), len(w)


def top_by_hand(text, n):
    w = words_of(text)
    grams = [tuple(w[i : i + n]) for i in range(len(w) - n + 1)]
    most = max((grams.count(g) for g in set(grams)), default=0)
    return most / len(grams) if most > 1 else 0.0


def units_by_hand(text, pattern):
    seen, total, again = set(), 0, 0
    for p in re.split(pattern, text or ""):
        p = p.strip()
        total += len(p)
        if p in seen:
            again += len(p)
        seen.add(p)
    return again / total if total else 0.0


def repeated_corpus():
    rng = random.Random(4)
    docs = list(enumerate(ODD))
    for d in range(60):
        part = " ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 30)))
        docs.append((100 + d, rng.choice(["\n", ". ", "\n\n", " "]).join([part] * rng.randrange(1, 6)) + " " + " ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(60)))))
    return [*docs, (500, "spam " * 20_000), (501, "a b c d e f g h " * 2), (502, None)]


def test_ledger_against_brute_force(rows):
    docs = repeated_corpus()
    got = {r["doc_id"]: r for r in repetition.ledger(rows(DOCS, docs)).collect()}
    assert len(got) == len(docs)
    for d, t in docs:
        r = got[d]
        hit, n = repeated_by_hand(t)
        assert r["n_words"] == n and r["window_8"] == pytest.approx(hit / max(n, 1))
        if d < 500:
            for k in (2, 3, 4):
                assert r[f"top_{k}"] == pytest.approx(top_by_hand(t, k))
        assert r["lines"] == pytest.approx(units_by_hand(t, r"\r\n|\n|\r")) and r["sentences"] == pytest.approx(units_by_hand(t, r"[.!?]+\s+|[\r\n]+"))
        for bit, rule in enumerate(repetition.RULES):
            assert bool(r["failed"] >> bit & 1) == (r[rule.measure] >= rule.least)


def test_policies_and_ablations(rows):
    docs = repeated_corpus()
    entries = repetition.ledger(rows(DOCS, docs))
    all_ = entries.collect()
    for policy, names in repetition.POLICIES.items():
        mask = repetition.mask_of(policy)
        assert {r["doc_id"] for r in repetition.apply_policy(entries, policy).collect()} == {r["doc_id"] for r in all_ if r["failed"] & mask}
        table = {r["rule"]: r for r in repetition.ablations(entries).where(F.col("policy") == policy).collect()}
        assert set(table) == set(names)
        for bit, rule in enumerate(repetition.RULES):
            if rule.name in names:
                assert table[rule.name]["failing"] == sum(bool(r["failed"] >> bit & 1) for r in all_)
                assert table[rule.name]["alone"] == sum(r["failed"] & mask == 1 << bit for r in all_)
    assert repetition.ledger(rows(DOCS)).count() == 0 and repetition.ablations(repetition.ledger(rows(DOCS))).count() == 0


def test_stored_ledger(rows, spark, tmp_path):
    entries = repetition.ledger(rows(DOCS, repeated_corpus()))
    kept = repetition.store(entries, str(tmp_path / "ledger"))
    assert sorted(map(str, kept.collect())) == sorted(map(str, entries.collect()))
    kept.withColumn("rules", F.lit("other")).write.parquet(str(tmp_path / "odd"))
    for rules in ("repeated_8_words", "repeated_8_words,repeated_lines"):  # made before the later rules were appended
        kept.withColumn("rules", F.lit(rules)).write.mode("append").parquet(str(tmp_path / "odd"))
    with pytest.raises(ValueError):
        repetition.stored(spark, str(tmp_path / "odd"))


def test_the_ledger_of_a_table_is_measured_once(rows, spark, tmp_path, monkeypatch):
    path = str(tmp_path / "docs.parquet")
    rows(DOCS, repeated_corpus()).write.parquet(path)
    first = sorted(map(str, repetition.ledger_once(spark.read.parquet(path)).collect()))
    assert first == sorted(map(str, repetition.ledger(spark.read.parquet(path)).collect()))
    monkeypatch.setattr(repetition, "ledger", None)
    assert sorted(map(str, repetition.ledger_once(spark.read.parquet(path)).collect())) == first
    monkeypatch.undo()
    rows(DOCS, [(1, "a b")]).write.mode("overwrite").parquet(path)
    assert repetition.ledger_once(spark.read.parquet(path)).count() == 1


def test_windows_under_one_key_are_compared():
    codes = np.array([1, 2, 3, 1, 2, 4, 1, 2, 3], np.int32)
    at = np.array([0, 3, 6])
    assert repetition.earlier(at, np.zeros(3, np.uint64), codes, 3).tolist() == [6]


def best_fit_by_hand(histogram, capacity):
    bins = []
    for length in sorted(histogram, reverse=True):
        for _ in range(histogram[length] if length else 0):
            fits = [i for i, r in enumerate(bins) if r >= length]
            if fits:
                i = min(fits, key=lambda i: bins[i])
                bins[i] -= length
            else:
                bins.append(capacity - length)
    return len(bins)


def test_plan_is_best_fit():
    rng = random.Random(5)
    for _ in range(300):
        capacity = rng.randrange(1, 40)
        h = {}
        for _ in range(rng.randrange(50)):
            k = rng.randrange(capacity + 1)
            h[k] = h.get(k, 0) + rng.randrange(1, 9)
        plan = packing.best_fit(h, capacity)
        used = {}
        for k, n in h.items():
            for b in plan.container(np.full(n, k), np.arange(n)).tolist():
                used[b] = used.get(b, 0) + k
        assert all(v <= capacity for v in used.values()) and all(0 <= b < plan.bins for b in used)
        assert plan.bins == max(best_fit_by_hand(h, capacity), 1 if h else 0)
    with pytest.raises(ValueError):
        packing.best_fit({5: 1}, 4)


CONTAINERS = "container string, capacity_tokens int"


@pytest.mark.parametrize("rank_rows", [50_000, 7])
def test_packing(rows, monkeypatch, rank_rows):
    monkeypatch.setattr(packing, "RANK_ROWS", rank_rows)
    monkeypatch.setattr(packing, "KINDS_AT_ONCE", 100 if rank_rows > 7 else 1)
    docs = list(enumerate(ODD)) + [(100 + i, "word " * (i % 17)) for i in range(120)] + [(300, "one two three " * 90), (301, "one two three four " * 16)]
    kinds = [("s", 64), ("m", 200), ("m", 200), ("bad", 0), (None, 9), ("none", None)]
    got = packing.pack(rows(DOCS, docs), rows(CONTAINERS, kinds)).collect()
    e = packing.tokenizer(packing.VOCABULARY)
    for name, capacity in (("s", 64), ("m", 200)):
        own = [r for r in got if r["container"] == name]
        used = {}
        for r in own:
            used[r["bin"]] = used.get(r["bin"], 0) + r["n_tokens"]
        assert max(used.values()) <= capacity and set(used) == set(range(len(used)))
        pieces = {}
        for r in own:
            pieces.setdefault(r["doc_id"], []).append((r["piece"], r["token_from"], r["n_tokens"]))
        assert set(pieces) == {d for d, _ in docs}
        h = {}
        for d, t in docs:
            n = len(e.encode_ordinary(t)) if t else 0
            p = sorted(pieces[d])
            assert [x[0] for x in p] == list(range(max(1, -(-n // capacity)))) and sum(x[2] for x in p) == n  # none cut that fits
            assert all(x[2] == capacity for x in p[:-1]) and [x[1] for x in p] == [i * capacity for i in range(len(p))]
            for x in p:
                h[x[2]] = h.get(x[2], 0) + 1
        assert len(used) == best_fit_by_hand(h, capacity)
    fill = {r["container"]: r for r in packing.fill(packing.pack(rows(DOCS, docs), rows(CONTAINERS, kinds))).collect()}
    assert set(fill) == {"s", "m"} and 0 <= fill["s"]["unused_share"] < 0.2


def test_packing_of_nothing(rows):
    assert packing.pack(rows(DOCS), rows(CONTAINERS, [("s", 64)])).count() == 0
    assert packing.pack(rows(DOCS, [(1, "a")]), rows(CONTAINERS)).count() == 0
    r = packing.pack(rows(DOCS, [(1, None), (2, ""), (None, None)]), rows(CONTAINERS, [("s", 64)])).collect()
    assert len(r) == 3 and {x["bin"] for x in r} == {0}


def test_counts_of_long_blank_runs(monkeypatch):
    e = packing.tokenizer(packing.VOCABULARY)
    assert packing.token_count("a" + " " * 300_000 + "b" + "\n" * 300_000, e) > 3
    monkeypatch.setattr(packing, "LONGEST_RUN", 3)
    monkeypatch.setattr(packing, "_LONG_RUN", re.compile(f"[{packing._BLANK}]{{3,}}"))
    rng = random.Random(6)
    for _ in range(3000):
        t = "".join(rng.choice(" \n\t ab1! 　é\x1c") for _ in range(rng.randrange(25)))
        assert packing.token_count(t, e) == len(e.encode_ordinary(t)), repr(t)


def test_clashing_columns_change_nothing(rows):
    docs, items = make_corpus(7, 8)
    d = rows(DOCS, docs)
    odd = d.select("*", *(F.lit("x").alias(c) for c in ("Text", "DOC_ID", "rest", "kind", "full", "n_tokens", "failed")))
    i = rows(ITEMS, items)
    assert sorted(map(str, leakage.leaked_items(d, i).collect())) == sorted(map(str, leakage.leaked_items(odd, i).collect()))
    assert sorted(map(str, repetition.ledger(d).collect())) == sorted(map(str, repetition.ledger(odd).collect()))
    c = rows(CONTAINERS, [("s", 64)])
    assert sorted(map(str, packing.pack(d, c).collect())) == sorted(map(str, packing.pack(odd, c).collect()))
