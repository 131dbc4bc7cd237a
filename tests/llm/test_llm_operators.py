"""The training-data operators against brute force, and on awkward rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

LOWER = {i: i + 32 for i in range(65, 91)}
rng = random.Random(5)
VOCABULARY = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(400)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCABULARY) for _ in range(n))


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))


def shingle_set(text):
    w = words(text)
    return set([tuple(w)] if 0 < len(w) < 5 else [tuple(w[k : k + 5]) for k in range(len(w) - 4)])


def near(text, seed, edits):
    r = random.Random(seed)
    w = text.split()
    for _ in range(edits):
        w[r.randrange(len(w))] = r.choice(VOCABULARY)
    return " ".join(w)


def corpus():
    base, passage = prose(150, 1), prose(90, 2)
    texts = [base, base, near(base, 3, 1), near(base, 4, 2), near(base, 5, 9), prose(120, 6)]
    texts += [prose(60, 7) + "\n" + passage + "\n" + prose(40, 8), prose(30, 9) + "\n" + passage, passage[:300] + " " + prose(50, 10)]
    texts += [None, "", "   \n\t ", "One", "one two three", "ONE TWO THREE", "ab " * 400, prose(4000, 11), "é ü 漢字 " * 30 + prose(20, 12)]
    texts += [near(base, 20 + k, k % 4) for k in range(300)]
    rows = [(i, t, "en" if i % 2 else None, "s1" if i % 3 else None, len(t or "")) for i, t in enumerate(texts)]
    return rows


AWKWARD = [
    (1, None, "x", None, True, 9),
    (1, None, "x", None, True, 9),
    (2, "", "x", "s", None, 9),
    (None, "a null id with some words here", "y", "s", True, 9),
    (None, "a null id with some words here", "y", "s", True, 9),
    (3, "same text twice, same text twice", "y", None, False, 9),
    (3, "same text twice, same text twice", "y", None, False, 9),
    (4, "\n\n \n", "z", "t", False, 9),
    (5, "word " * 30000, "z", "t", True, 9),
]
# Columns that clash with the names of results and of inner columns.
AWKWARD_SCHEMA = "doc_id long, text string, lang string, source string, train boolean, "
CLASHES = ["kept", "score", "n_bytes", "replica", "severity", "lang_pred", "labels", "_row", "_id", "_h", "spans", "_text"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), "doc_id long, text string, lang string, source string, n_chars long").repartition(3)


@pytest.fixture(scope="module")
def awkward(spark):
    rows = [(*r, *[r[-1]] * (len(CLASHES) - 1)) for r in AWKWARD]
    return spark.createDataFrame(rows, AWKWARD_SCHEMA + ", ".join(f"{c} int" for c in CLASHES))


@pytest.fixture(scope="module")
def empty(awkward):
    return awkward.where("1 = 0")


def expected_components(rows, percent):
    sets = {i: shingle_set(t) for i, t, *_ in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            common = len(sets[i] & sets[j])
            if common and 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates(docs, percent, monkeypatch):
    from assaymill.llm import minhash

    monkeypatch.setattr(minhash, "BLOCK", 64)  # several blocks per bucket
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs, percent).collect()}
    assert got == expected_components(corpus(), percent)


def test_near_duplicates_awkward(awkward, empty):
    from assaymill.llm.minhash import keep_one, near_duplicates

    rows = near_duplicates(awkward).collect()
    assert len(rows) == len(AWKWARD)
    assert all(r.kept for r in rows if r.doc_id in (1, 2, 4))
    assert {(r.n_shingles, r.component_id) for r in rows if r.doc_id == 5} == {(1, 5)}
    assert near_duplicates(empty).count() == 0
    assert sorted(keep_one(awkward).columns) == sorted(awkward.columns)


def test_circulant_signatures_estimate_jaccard():
    from assaymill.llm.minhash import signatures

    r = np.random.default_rng(1)
    pool = r.integers(1, 2**63, 1500, dtype=np.uint64)
    a, b = np.sort(pool[:1000]), np.sort(pool[250:1250])
    sig = signatures([a, b], 512)
    assert abs((sig[0] == sig[1]).mean() - 750 / 1250) < 0.08


def expected_removal(rows, length):
    texts = {i: (t or "").encode() for i, t, *_ in rows}
    seen = Counter(b[k : k + length] for b in texts.values() for k in range(len(b) - length + 1))
    out = {}
    for i, b in texts.items():
        mask = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                mask[k : k + length] = b"\1" * length
        kept = bytes(x for x, y in zip(b, mask) if not y)
        runs = sum(1 for k in range(len(mask)) if mask[k] and (k == 0 or not mask[k - 1]))
        out[i] = (len(b), sum(mask), runs, kept)
    return out


@pytest.mark.parametrize("length", [100, 240, 399, 400])
def test_remove_repeats(docs, length):
    from assaymill.llm.suffix import remove_repeats

    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in remove_repeats(docs, length).collect()}
    assert got == expected_removal(corpus(), length)


def test_remove_repeats_awkward(awkward, empty):
    from assaymill.llm.suffix import drop_repeats, remove_repeats

    rows = remove_repeats(awkward).collect()
    assert len(rows) == len(AWKWARD)
    assert {r.n_removed for r in rows if r.doc_id == 5} == {150000}
    assert remove_repeats(empty).count() == 0
    cut = drop_repeats(awkward.select("doc_id", "text"), 100)
    assert {r.text for r in cut.collect() if r.doc_id == 1} == {None}
    with pytest.raises(ValueError):
        remove_repeats(awkward, 50)


def test_katz_backoff(docs, monkeypatch):
    from assaymill.llm import katz

    monkeypatch.setattr(katz, "BUCKET_TOKENS", 5000)
    monkeypatch.setattr(katz, "HEAVY", 200)
    rows = corpus()
    train = {i: zlib.crc32(str(i).encode()) % 5 != 1 for i, *_ in rows}
    marked = docs.selectExpr("*", "crc32(CAST(doc_id AS STRING)) % 5 <> 1 AS train")
    got = {r.doc_id: r for r in katz.score_texts(marked, "train").collect()}
    tokens = {i: words(t) + [" end "] for i, t, *_ in rows}
    one, two, history, after = Counter(), Counter(), Counter(), defaultdict(set)
    for i, w in tokens.items():
        if train[i]:
            one.update(w)
            for h, x in zip([" start ", *w[:-1]], w):
                two[h, x] += 1
                history[h] += 1
                after[h].add(x)
    total = sum(one.values())
    d1, d2 = (katz.discounts([sum(c == r for c in k.values()) for r in range(7)]) for k in (one, two))
    unknown = 1 - sum(d1[min(c, 6)] * c for c in one.values()) / total
    p = {w: d1[min(c, 6)] * c / total for w, c in one.items()}
    alpha = {h: (1 - sum(d2[min(two[h, x], 6)] * two[h, x] for x in f) / history[h]) / (1 - sum(p[x] for x in f)) for h, f in after.items()}

    def probability(h, x):
        c = two.get((h, x), 0)
        return d2[min(c, 6)] * c / history[h] if c else alpha.get(h, 1.0) * p.get(x, unknown)

    for h in [" start ", *list(after)[:5]]:  # both levels add up to one, with the unknown word
        assert math.isclose(sum(probability(h, x) for x in p) + alpha[h] * unknown, 1.0, rel_tol=1e-9)
    for i, w in tokens.items():
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(one[x] > 0 for x in w), total)
        assert math.isclose(r.base_score, sum(math.log10((one[x] + 0.5) / (total + 0.5 * (len(one) + 1))) for x in w), rel_tol=1e-9)
        assert math.isclose(r.score, sum(math.log10(probability(h, x)) for h, x in zip([" start ", *w[:-1]], w)), rel_tol=1e-9)


def test_katz_counts_a_bucket_in_shares(docs, monkeypatch):
    """A bucket's tokens are counted a few at a time, with the sums of all of them at once."""
    from pyspark.sql import functions as F

    from assaymill.llm import katz

    marked = docs.select("doc_id", "text", (F.crc32(F.col("doc_id").cast("string")) % 5 != 1).alias("train"))
    whole = {r.doc_id: r for r in katz.score_texts(marked, "train").collect()}
    monkeypatch.setattr(katz, "PAIR_TOKENS", 700)
    parts = {r.doc_id: r for r in katz.score_texts(marked, "train").collect()}
    assert set(whole) == set(parts)
    for k, r in parts.items():
        assert (r.n_tokens, r.n_known, r.train_tokens) == (whole[k].n_tokens, whole[k].n_known, whole[k].train_tokens)
        assert (r.base_score, r.score) == pytest.approx((whole[k].base_score, whole[k].score))


@pytest.mark.parametrize("kind", [np.uint8, np.uint16, np.uint32, np.uint64])
def test_katz_squeezed_numbers_come_back(kind):
    from assaymill.llm import katz

    for n in (0, 1, 5000):
        x = np.random.default_rng(n).integers(0, np.iinfo(kind).max, n, kind, endpoint=True)
        assert (katz._spread(katz._squeezed(x)) == x).all() and katz._spread(katz._squeezed(x)).dtype == kind


def test_katz_hashes_large_pieces_in_parts(monkeypatch):
    """Hashing takes many times the bytes it reads, so it reads a part at a time, with the same words."""
    import tracemalloc

    import pyarrow as pa

    from assaymill.llm import common, katz

    monkeypatch.setattr(common, "_powers", {})
    texts = [("Some words, " + chr(97 + k % 26) * 7 + " \u00e9 ") * 300 if k % 9 else "" for k in range(1200)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(1200)), pa.array(range(1200)), pa.array([k % 5 != 1 for k in range(1200)]), pa.array(texts)], names=["_row", "_id", "_train", "_text"])
    assert batch.column("_text").nbytes > 7 * common.PIECE
    tracemalloc.start()
    try:
        for run in (katz._word_counts, katz._packed(np.zeros(0, np.uint64), 8)):
            tracemalloc.reset_peak()
            assert sum(len(x) for x in run(iter([batch]))) > 0
            assert tracemalloc.get_traced_memory()[1] < 200e6
    finally:
        tracemalloc.stop()
    assert len(common._powers["up"]) == 1 << 21
    data, offsets = common.buffers(pa.array([*texts[:30], "", "one"]))
    whole, at = common.words_of(data, offsets)
    for size in (1, 5000, 1 << 20):
        monkeypatch.setattr(katz, "PIECE", size)
        parts, places = katz._words(data, offsets)
        assert (parts == whole).all() and (places == at).all()


def test_katz_awkward(awkward, empty):
    from assaymill.llm.katz import score_texts

    rows = score_texts(awkward, "train").collect()
    assert len(rows) == len(AWKWARD)
    assert all(math.isfinite(r.score) and r.score <= 0 for r in rows)
    assert {r.n_tokens for r in rows if r.doc_id == 1} == {1}
    assert score_texts(empty, "train").count() == 0
    untrained = score_texts(awkward.where("train = false OR train IS NULL"), "train").collect()
    assert all(r.score == 0 and r.n_known == 0 for r in untrained)


def test_language(docs, spark, awkward, empty):
    from assaymill.llm.language import codebook, identify, train

    a, b = "the quick brown fox jumps", "der schnelle braune fuchs springt über"
    rows = [(k, " ".join(random.Random(k).choices((a if k % 2 else b).split(), k=12)), "en" if k % 2 else "de") for k in range(60)]
    model = train(spark.createDataFrame(rows, "doc_id long, text string, lang string").where("doc_id < 40"))
    got = {r.doc_id: r for r in identify(spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string"), model).collect()}
    assert all(got[i].lang_pred == lang and 0 <= got[i].score <= 1 for i, _, lang in rows if i >= 40)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !?"), (4, "漢")], "doc_id long, text string")
    assert [r.lang_pred == "und" for r in identify(odd, model).orderBy("doc_id").collect()] == [True, True, True, False]
    assert identify(awkward, model).count() == len(AWKWARD)
    assert identify(empty, train(empty)).count() == 0
    assert {r.lang_pred for r in identify(awkward, train(empty)).collect()} == {"und"}
    for n in (2, 4, 6, 9, 40):
        code = codebook(n)
        apart = (code.shape[1] - code @ code.T) / 2
        assert apart[~np.eye(n, dtype=bool)].min() >= code.shape[1] / 4


def test_license_scan(spark, awkward, empty):
    from assaymill.llm.licenses import BASE_PHRASES, TEMPLATES, Scanner, scan

    texts = {
        1: "Foo. Licensed under the Apache License, Version 2.0. See the MIT-license",
        2: "gnu GENERAL  public\nlicense mit license mit license",
        3: "licensed under CC BY-NC 4.0.",
        4: "mit licenses, apache 2 license, public license général",
        5: "Redistribution and use in source and binary forms, with or without changes or modification, are permitted provided that the following conditions are met:",
        6: None,
    }
    got = {r.doc_id: r for r in scan(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    for i, t in texts.items():
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(LOWER))
        hits = [(k, label) for k in range(len(w)) for p, label in BASE_PHRASES.items() if w[k : k + len(p.split())] == p.split()]
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(hits), min((k for k, _ in hits), default=None), max((k for k, _ in hits), default=None))
        assert r.base_labels == ",".join(sorted({x for _, x in hits}))
    assert (got[3].labels, got[5].labels, got[6].labels, got[6].score) == ("cc-by-nc", "bsd", "", 0.0)
    assert scan(awkward).count() == len(AWKWARD) and scan(empty).count() == 0
    # Matching statistics against a plain search.
    scanner = Scanner(BASE_PHRASES, TEMPLATES)
    known = [t.split() for t in [*BASE_PHRASES, *(t for _, t in TEMPLATES)]]
    number = {w: k for k, w in enumerate(sorted({w for t in known for w in t}))}
    inside = {tuple(number[w] for w in t[a:b]) for t in known for a in range(len(t)) for b in range(a + 1, len(t) + 1)}
    read = [random.Random(3).choice(list(number.values())[:25]) for _ in range(3000)]
    state = length = 0
    for k, symbol in enumerate(read):
        state, length = scanner.automaton.step(state, length, symbol)
        assert length == max((n for n in range(1, 25) if n <= k + 1 and tuple(read[k + 1 - n : k + 1]) in inside), default=0)


def test_fingerprints(docs, monkeypatch):
    from assaymill.llm import fingerprint

    monkeypatch.setattr(fingerprint, "PART_ROWS", 40)
    rows = [(i, "\n".join(re.findall(r"(?:\S+ ?){1,7}", t)) if t and i % 4 else t) for i, t, *_ in corpus()]
    frame = docs.sparkSession.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in fingerprint.fingerprints(frame).collect()}
    order = sorted(dict(rows), reverse=True)
    text = {i: t or "" for i, t in rows}

    def paragraphs(t):
        return {x for x in t.split("\n") if x.strip(" ")}

    def alike(a, b):
        return 1 - len(a ^ b) / (len(a) + len(b)) if a or b else 1.0

    for k, i in enumerate(order):
        t, after = text[i], text[order[(k + 1) % len(order)]]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert math.isclose(r.near_edited, alike(paragraphs(t), paragraphs(edited)), abs_tol=1e-9)
        assert math.isclose(r.near_next, alike(paragraphs(t), paragraphs(after)), abs_tol=1e-9)
    by_text = defaultdict(set)
    for i, t in text.items():
        by_text[t].add(got[i].fingerprint)
    assert all(len(x) == 1 for x in by_text.values())


def test_fingerprints_awkward(awkward, empty):
    from assaymill.llm.fingerprint import fingerprints

    rows = fingerprints(awkward).collect()
    assert len(rows) == len(AWKWARD) and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    assert fingerprints(awkward.limit(1)).first().near_next == 1.0
    assert fingerprints(empty).count() == 0


def test_mixing(spark, awkward, empty):
    from assaymill.llm.mixing import mix, rates

    rows = [(i, f"t{i}", "hot" if i % 3 else f"s{i % 7}") for i in range(6000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    weights = {"hot": 1.0, "s0": 1.0, "s1": 2.0}
    mixed = mix(frame, weights, target_rows=40000).groupBy("source").count().collect()
    share = {r["source"]: r["count"] / 40000 for r in mixed}
    assert set(share) == set(weights)
    assert all(abs(share[s] - w / 4) < 0.02 for s, w in weights.items())
    rate = {r["_source"]: r["rate"] for r in rates(frame, weights, 40000).collect()}
    counts = Counter(r.doc_id for r in mix(frame, weights, target_rows=40000).where("source = 'hot'").collect())
    for k in range(6):  # the counts are Poisson, those of 0 included
        found = sum(counts.get(i, 0) == k for i, _, s in rows if s == "hot") / 4000
        assert abs(found - math.exp(-rate["hot"]) * rate["hot"] ** k / math.factorial(k)) < 0.03
    assert rate["s1"] > 16  # a rate in several pieces
    again = mix(frame.repartition(5), weights, target_rows=40000)
    assert again.exceptAll(mix(frame, weights, target_rows=40000)).isEmpty()
    out = mix(awkward)
    assert out.where("text IS NULL").count() % 2 == 0
    assert mix(empty).count() == 0


def test_leaks(spark, docs, awkward, empty):
    from assaymill.llm.decontaminate import RADIUS, drop_leaks, find_leaks

    items = [(0, prose(40, 900)), (1, prose(25, 901)), (2, "three short words"), (3, None), (4, ""), (5, prose(60, 902)), (6, prose(25, 901))]
    texts = {
        1: prose(50, 1) + " " + items[0][1].upper() + " " + prose(30, 2),
        2: prose(20, 3) + " " + near(items[5][1], 4, 1) + " " + prose(30, 5),
        3: prose(20, 6) + " " + " ".join(items[1][1].split()[:10]) + " " + prose(30, 7),
        4: "and three short words here",
        5: items[1][1],
        6: None,
        7: prose(300, 8),
    }
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = find_leaks(frame, bench).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == {(1, 0), (2, 5), (4, 2), (5, 1), (5, 6)}
    assert {r.first_word for r in rows if r.doc_id == 1} == {50}
    assert all(0 <= r.distance <= RADIUS and r.similarity >= 0.8 for r in rows)
    assert {r.doc_id for r in drop_leaks(frame, bench).collect()} == {3, 6, 7}
    assert drop_leaks(awkward, bench).count() == len(AWKWARD)
    assert find_leaks(empty, bench).count() == 0
    assert find_leaks(frame, bench.where("1 = 0")).count() == 0


def best_window(item, text):
    """The plain similarity of the best of all item-sized windows, by brute force."""
    n, best = len(words(item)), 0.0
    own, all_words = shingle_set(item), words(text)
    for start in range(max(len(all_words) - n, 0) + 1):
        seen = shingle_set(" ".join(all_words[start : start + n]))
        best = max(best, len(own & seen) / len(own | seen))
    return best


def test_leaks_at_every_start(spark):
    from assaymill.llm.decontaminate import find_leaks

    items, texts = [], []
    for k, (n, trim, insert) in enumerate([(60, 1, 2), (100, 3, 6), (200, 8, 16)]):
        w = prose(n, 5000 + k).split()
        cut = w[trim : n // 2] + prose(insert, 5100 + k).split() + w[n // 2 : n - trim]
        items.append((k, " ".join(w)))
        texts.append((k, prose(30, 5200 + k) + " " + " ".join(cut) + " " + prose(30, 5300 + k)))
    got = {(r.doc_id, r.item_id): r.similarity for r in find_leaks(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {(d, i): s for d, text in texts for i, item in items if (s := best_window(item, text)) >= 0.8}
    assert set(want) == {(0, 0), (1, 1), (2, 2)}
    assert got == {pair: pytest.approx(s) for pair, s in want.items()}


def test_leaks_of_items_with_copies(spark):
    from assaymill.llm.decontaminate import find_leaks

    def replaced(text, at, word):
        w = text.split()
        w[at] = word
        return " ".join(w)

    twice, ten, last = prose(60, 6000), prose(100, 6001), prose(60, 6002)
    items = [(0, twice), (1, twice), *[(10 + k, ten) for k in range(10)]]
    items += [(30 + k, replaced(last, 59, f"end{k}")) for k in range(10)]  # near copies, no two alike
    texts = [(0, "before " + replaced(twice, 30, "other") + " after"), (1, replaced(ten, 50, "other")), (2, replaced(last, 30, "other")), (3, prose(200, 6003))]
    texts += [(4 + k, f"a {k} " + replaced(last, 59, f"none{k}")) for k in range(40)]
    frame, bench = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in find_leaks(frame, bench).collect()}
    want = {(d, i): s for d, text in texts for i, item in items if (s := best_window(item, text)) >= 0.8}
    assert {d for d, _ in want} == {0, 1, 2, *range(4, 44)}
    assert set(got) == set(want)
    assert all(s >= want[pair] - 1e-9 for pair, s in got.items())


def test_toxicity(spark, awkward, empty):
    from assaymill.llm.toxicity import fit_ordinal, grade_texts, train

    bad = ["slurone", "slurtwo", "slurthree"]
    rows, labels = [], []
    for k in range(600):
        w = prose(40, 2000 + k).split()
        toxic = k % 4 == 0
        for j in range((k // 4) % 6 + 1 if toxic else 0):
            w.insert(random.Random(k * 7 + j).randrange(len(w)), bad[(k + j) % 3])
        rows.append((k, " ".join(w)))
        labels.append((k, int(toxic)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame([*labels[:400], (None, 1), (5, None), (9999, 1)], "doc_id long, toxic int")
    model = train(frame, known)
    got = {r.doc_id: r for r in grade_texts(frame, model).collect()}
    assert all(got[k].toxic == bool(t) for k, t in labels)
    assert got[4].severity < got[20].severity
    assert grade_texts(awkward, model).count() == len(AWKWARD)
    assert grade_texts(empty, train(empty, known)).count() == 0
    assert not any(r.toxic for r in grade_texts(frame, train(frame, known.where("1 = 0"))).collect())
    x = np.concatenate([np.random.default_rng(1).normal(m, 1, 300) for m in (0, 3, 6)])
    weights, thresholds = fit_ordinal((np.arange(900), np.zeros(900, int), x), 1, np.repeat([0, 1, 2], 300), 2)
    assert weights[0] > 0 and thresholds[0] < thresholds[1]


PAGE = (
    '<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><article>";</script></head><body class="page-with-sidebar">'
    '<header><p>Site</p></header><nav><ul><li><a href="/a">A</a></ul></nav><!-- <article>no</article> --><div class="ad big">Buy</div>'
    "%s<aside>More</aside><footer>&copy; x</footer></body></html>"
)


def test_html(spark):
    from assaymill.llm.html_template import extract_main

    article = '<article><h1>Head &amp; shoulders</h1><p><b>One\n two<br>three<p>Four &lt;5&gt;<div class="share-buttons">Tweet</div><section id="comments"><p>First!</p></section></article>'
    plain = '<div id="c"><p>Text number %d is here.</p><p>And more of %d to read on this page.</p></div><p>Made with love</p>'
    rows = [(1, "http://a.x/1", PAGE % article), (2, None, None), (3, "nonsense", ""), (4, "http://a.x/4", "<article>broken <p>end")]
    rows += [(10 + k, f"http://b.y/{k}?q", PAGE % (plain % (k, k))) for k in range(5)]
    rows += [(30, "http://c.z/", PAGE % (plain % (7, 7))), (1, "http://a.x/1", PAGE % article)]
    frame = spark.createDataFrame([(*r, 5) for r in rows], "page_id long, url string, html string, n_chars int")
    got = defaultdict(list)
    for r in extract_main(frame).collect():
        assert r.n_chars == len(r.text)
        got[r.page_id].append(r.text)
    assert got[1] == ["Head & shoulders\n\nOne two three\n\nFour <5>"] * 2
    assert got[2] == [""] and got[3] == [""] and got[4] == ["broken\n\nend"]
    for k in range(5):  # no article: the varying container, without the template's words
        assert got[10 + k] == [f"Text number {k} is here.\n\nAnd more of {k} to read on this page."]
    assert extract_main(frame.where("1 = 0")).count() == 0


def test_html_template_decides_inside_articles(spark):
    from assaymill.llm.html_template import extract_main

    notice = '<div class="box"><p>Read this in our app</p></div>'
    # Host n.x: a notice above, and twice below, every article. Host r.x: one article under many addresses.
    pages = [(k, f"http://n.x/{k}", PAGE % f"<article>{notice}<h1>Head {k}</h1><p>Body of {k}</p><span class='s'></span>{notice}</article>") for k in range(6)]
    pages += [(20 + k, f"http://r.x/{k}", PAGE % "<main><h1>One head</h1><p>One body</p><p>One end</p></main>") for k in range(6)]
    pages += [(40 + k, f"http://t.x/{k}", PAGE % f"<main><p>Members only</p><p>Story {k}</p></main>") for k in range(3)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(4)
    got = {r.page_id: r.text for r in extract_main(frame).collect()}
    for k in range(6):
        assert got[k] == f"Head {k}\n\nBody of {k}"
        assert got[20 + k] == "One head\n\nOne body\n\nOne end"
    for k in range(3):  # one block forms a class with its container
        assert got[40 + k] == f"Story {k}"


def test_pipeline(spark, sf):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(cp.STAGES):
        before = {r.doc_id: r for r in docs.collect()}
        after = cp.written(stage(spark, docs, sf))
        got = after.collect()
        ids = [r.doc_id for r in got]
        if k < len(cp.STAGES) - 1:
            assert after.columns == columns and len(ids) == len(set(ids)) and set(ids) <= set(before)
        if name == "minhash_near_dedup":
            want = expected_components([(i, r.text) for i, r in before.items()], 80)
            assert set(ids) == {i for i, (_, _, kept) in want.items() if kept}
        elif name == "suffix_dedup":
            want = expected_removal([(i, r.text) for i, r in before.items()], 240)
            assert {r.doc_id: r.text for r in got} == {i: x[3].decode("utf-8", "ignore") for i, x in want.items()}
        docs = after
    assert "replica" in docs.columns
