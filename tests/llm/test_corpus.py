"""Operators over the whole corpus, against brute force on small fixtures."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from codequarry.llm import components, lm, near_dedup, shared, substring_dedup

ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return ALNUM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def roots(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def random_text(rng, n):
    return [f"{rng.choice('bcdfgh')}{rng.choice('aeiou')}{rng.randint(0, 999)}" for _ in range(n)]


def near_copies(seed=7):
    rng, texts = random.Random(seed), []
    for group in range(12):
        base = random_text(rng, rng.randint(12, 160))
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 9)):
            copy = list(base)
            for _ in range(max(1, len(copy) // 40)):
                at = rng.randrange(len(copy))
                copy[at : at + 1] = rng.choice([["new"], [], [copy[at], "more"]])
            texts.append((" " if group % 2 else "\n").join(copy).upper() if group % 3 == 0 else ", ".join(copy))
    shared_passage = random_text(rng, 60)
    texts += [" ".join(random_text(rng, 120) + shared_passage + random_text(rng, 120)) for _ in range(10)]
    return texts


def test_banded_distance():
    rng = random.Random(5)
    for _ in range(1500):
        a = [rng.randint(0, 4) for _ in range(rng.randint(0, 22))]
        b = [x for x in a if rng.random() > 0.1] + [rng.randint(0, 4) for _ in range(rng.randint(0, 4))]
        if rng.random() < 0.3:
            b = [rng.randint(0, 4) for _ in range(rng.randint(0, 22))]
        most = rng.randint(0, 12)
        assert near_dedup.distance_within(np.array(a, np.int64), np.array(b, np.int64), most) == min(distance(a, b), most + 1)


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rng = random.Random(seed)
    links = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(70)] + [(5, 5), (None, 3)]
    df = spark.createDataFrame([(a, b) for a, b in links], "a long, b long")
    got = {r["node"]: r["root"] for r in components.components(df, shared.Scratch(spark, "test")).collect()}
    real = [(a, b) for a, b in links if a is not None and a != b]
    wanted = roots(172, real)
    assert got == {x: wanted[x] for e in real for x in e}
    assert components.components(df.limit(0), shared.Scratch(spark, "test")).count() == 0


def near_table(spark, texts):
    rows = [(i, t, "src") for i, t in enumerate(texts)]
    rows += [(900, None, None), (901, "", "x"), (902, " \n ", "x"), (903, texts[0], "copy"), (903, texts[0], "copy"), (None, texts[1], "x"), (904, "one two", "x"), (905, "One  TWO!", "x"), (906, "w " * 20_000, "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, node string"), rows


def test_near_dedup_against_brute_force(spark):
    texts = near_copies()
    docs, rows = near_table(spark, texts)
    ws = [words(r[1]) for r in rows]
    grams = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in ws]
    sure, possible = [], []
    for i in range(len(rows)):
        for j in range(i):
            n = max(len(ws[i]), len(ws[j]))
            if ws[i] and ws[j] and abs(len(ws[i]) - len(ws[j])) <= 0.2 * n and (ws[i] == ws[j] or n < 400 and distance(ws[i], ws[j]) <= int(0.2 * n + 1e-9)):
                possible.append((j, i))
                if len(grams[i] & grams[j]) >= 0.8 * len(grams[i] | grams[j]):
                    sure.append((j, i))
    got = near_dedup.classes(docs).collect()
    assert len(got) == len(rows)
    # rows of equal doc_id and text share their class, so (doc_id, key) tells them apart
    root_of = {}
    for r in got:
        root_of.setdefault(r["doc_id"], set()).add(r["root"])
    assert all(len(x) == 1 for x in root_of.values())
    mine = [next(iter(root_of[r[0]])) for r in rows]
    high = roots(len(rows), possible)
    assert all(mine[a] == mine[b] for a, b in sure) and len(sure) > 20
    assert all(high[a] == high[b] for a in range(len(rows)) for b in range(a) if mine[a] == mine[b] and rows[a][0] != rows[b][0])
    members = defaultdict(list)
    for r, root in zip(rows, mine, strict=True):
        members[root].append(r[0])
    for r in got:
        ids = [m for m in members[r["root"]] if m is not None]
        assert r["class_id"] == (min(ids) if ids else None) and r["n_class"] == len(members[r["root"]])
    kept = near_dedup.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(min(x for x in m if x is not None) for m in members.values())
    assert near_dedup.classes(docs.limit(0)).count() == 0


def test_passages_and_lines(spark):
    rng = random.Random(11)
    passage = random_text(rng, 55)
    line = random_text(rng, 60)
    texts = [" ".join(random_text(rng, 80)) for _ in range(20)]
    for k in range(6):
        own = random_text(rng, 70)
        texts.append(" ".join(own[:35] + passage[:20]) + ".\n" + " ".join(passage[20:] + own[35:]))
    for k in range(4):
        near = list(line)
        near[k] = "changed"
        texts.append("\n".join([" ".join(random_text(rng, 25)), " ".join(near), " ".join(random_text(rng, 25))]))
    texts += ["short repeated line here", "short repeated line here", None, "", "the " * 5000]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, hash string")
    got = substring_dedup.repeats(docs).collect()
    found = {r["doc_id"] for r in got if r["kind"] == "passage"}
    assert found >= set(range(20, 26)) and not found & set(range(20))
    kept = [r["doc_id"] for r in got if r["kind"] == "passage" and r["doc_id"] in range(20, 26) and not r["removed"]]
    assert kept == [20]
    lines = {r["doc_id"]: r for r in got if r["kind"] == "line"}
    assert set(lines) == set(range(26, 30)) and {r["class_id"] for r in lines.values()} == {26} and [d for d, r in lines.items() if not r["removed"]] == [26]
    for r in got:
        ws = words(texts[r["doc_id"]])
        assert r["start_word"] + r["n_words"] <= len(ws)
    assert substring_dedup.repeats(docs.limit(0)).count() == 0


def test_every_passage_of_fifty_words_is_found(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    grams = defaultdict(set)
    for r in docs.collect():
        ws = words(r["text"])
        for i in range(len(ws) - 50):
            grams[tuple(ws[i : i + 51])].add(r["doc_id"])
    wanted = {d for ids in grams.values() if len(ids) > 1 for d in ids}
    assert wanted <= {r["doc_id"] for r in substring_dedup.repeats(docs).select("doc_id").distinct().collect()}


def by_hand_scores(texts):
    ws = [words(t) for t in texts]
    c1, c2 = Counter(w for x in ws for w in x), Counter(p for x in ws for p in zip(x, x[1:], strict=False))
    total, out = sum(c1.values()), []
    for x in ws:
        s = 0.0
        for i, w in enumerate(x):
            if i and c2[x[i - 1], w] >= lm.MIN_COUNT:
                s += math.log(c2[x[i - 1], w] / c1[x[i - 1]])
            else:
                s += math.log(c1[w] / total) + (math.log(lm.BACKOFF) if i else 0)
        out.append((len(x), s))
    return out


@pytest.mark.parametrize(("batch_bytes", "part_grams"), [(1 << 23, 1 << 20), (2000, 50)])
def test_scores(spark, batch_bytes, part_grams):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["the", "cat", "sat", "on", "mat", "é", "X9"]) for _ in range(rng.randint(0, 60))) for _ in range(80)] + [None, "", "..", "a" * 3000, "the cat"]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, batch string")
    got = {r["doc_id"]: r for r in lm.scores(docs, batch_bytes=batch_bytes, part_grams=part_grams).collect()}
    for i, (n, s) in enumerate(by_hand_scores(texts)):
        assert got[i]["n_words"] == n and abs(got[i]["log_prob"] - s) < 1e-6 and (got[i]["score"] is None) == (n == 0)
    assert lm.scores(docs.limit(0)).count() == 0


def test_packing():
    rng = np.random.default_rng(1)
    for n in (1, 2, 1000):
        v = np.unique(rng.integers(0, 1 << 56, n, np.uint64))
        assert (lm.unpack(lm.pack(v)) == v).all()
    c = np.array([1, 254, 255, 256, 10**12, 3])
    assert (lm.unpack_counts(lm.pack_counts(c), c.size) == c).all()


def test_pipeline(spark, sf):
    documents = spark.read.parquet(f"{sf}/documents.parquet")
    docs, seen = documents, {}
    scratch = shared.Scratch(spark, "test")
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = scratch.table(stage(spark, docs, sf))
        seen[name] = (before, docs)
        assert docs.columns == documents.columns
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    letters = {r["doc_id"] for r in documents.collect() if any(c.isalpha() for c in r["text"] or "")}
    assert ids(seen["language_id"][1]) <= letters
    before, after = seen["minhash_near_dedup"]
    classes = near_dedup.classes(before).groupBy("root").agg(F.min("doc_id").alias("d")).collect()
    assert ids(after) == {r["d"] for r in classes}
    before, after = seen["benchmark_decontamination"]
    items = [words(r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    windows = {tuple(w[i : i + 10]) for w in items for i in range(max(1, len(w) - 9))}
    clean = {r["doc_id"] for r in before.collect() if not any(tuple(w[i : i + 10]) in windows for w in [words(r["text"])] for i in range(len(w) - 9))}
    assert ids(after) == clean
    before, after = seen["secret_scan"]
    assert ids(before) == ids(after) and after.filter(F.col("text").rlike("[0-9a-f]{40}")).count() == 0
    assert after.filter(F.col("n_chars") != F.length("text")).count() == 0
    assert [tuple(r) for r in corpus_pipeline.run(spark, sf).orderBy("doc_id").collect()] == [tuple(r) for r in docs.orderBy("doc_id").collect()]


def test_near_lines_of_one_template_against_brute_force(spark):
    """All pairs of one template collide; only those of 0.8 and more count, and bands find nearly all of them."""
    rng = random.Random(21)
    template, texts = random_text(rng, 100), []
    for k in range(700):
        a = list(template)
        a[0], a[rng.randrange(8, 92)] = f"own{k}", f"mid{k}"
        texts.append(" ".join(a))
        if k < 60:
            for at in rng.sample([p for p in range(8, 92) if not a[p].startswith("mid")], 2):
                a[at] = f"new{k}x{at}"
            texts.append(" ".join(a))
    grams = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(words, texts)]
    links = [(a, b) for b in range(len(texts)) for a in range(b) if (c := len(grams[a] & grams[b])) >= 0.8 * (len(grams[a]) + len(grams[b]) - c)]
    root = roots(len(texts), links)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in substring_dedup.repeats(docs).filter("kind = 'line'").collect()}
    wanted = {d: root[d] for link in links for d in link}
    assert len(links) >= 60 and got.items() <= wanted.items() and len(got) >= 0.93 * len(wanted)


@pytest.mark.parametrize(("alike", "least"), [(0.8, 0.93), (0.9, 0.98), (1.0, 1.0)])
def test_bands_recall(alike, least):
    rng, n = random.Random(6), 0
    for _ in range(400):
        a = random_text(rng, 200)
        b = list(a)
        while True:
            c = list(b)
            at = rng.randrange(200)
            c[at] = "x" + c[at]
            if substring_dedup.jaccard(*(substring_dedup.shingles(" ".join(t).encode()) for t in (a, c))) < alike:
                break
            b = c
        ws, bounds = near_dedup.hashed_words([" ".join(a), " ".join(b)])
        x, y = substring_dedup.band_keys(ws, bounds[:-1], np.diff(bounds))
        n += (x == y).any()
    print("bands", alike, n / 400)
    assert n >= least * 400


def test_whole_windows_stand_in_every_long_passage():
    rng = random.Random(12)
    passage = random_text(rng, 51)
    before = [rng.randint(0, 70) for _ in range(200)]
    texts = [" ".join(random_text(rng, n) + passage + random_text(rng, rng.randint(0, 70))) for n in before]
    ws, bounds = near_dedup.hashed_words(texts)
    starts = substring_dedup.window_starts(ws, bounds)
    inside, found = near_dedup.hashed_words([" ".join(passage)])[0], []
    for k in range(200):
        at = before[k] + bounds[k]
        assert (ws[at : at + 51] == inside).all()
        found.append(set((starts[(starts >= at) & (starts + substring_dedup.WINDOW_WORDS <= at + 51)] - at).tolist()))
    assert set.intersection(*found)


@pytest.mark.parametrize(("changed", "least"), [(0.05, 1.0), (0.1, 0.99), (0.15, 0.97), (0.2, 0.9)])
def test_sketches_propose_what_alignment_accepts(changed, least):
    rng, n = random.Random(4), 0
    for _ in range(400):
        a = random_text(rng, 400)
        b = list(a)
        for at in rng.sample(range(400), int(changed * 400)):
            b[at] = f"new{at}"
        words, bounds = near_dedup.hashed_words([" ".join(a), " ".join(b)])
        assert near_dedup.similar(words[: bounds[1]], words[bounds[1] :])
        x, y = near_dedup.sketches(words, bounds)
        n += (x == y).any()
    print("recall", changed, n / 400)
    assert n >= least * 400


def test_sketches_follow_the_definition():
    """Occurrence-labelled k-mers, the two of least hash, in text order: texts alone and together, short ones too."""
    rng = random.Random(8)
    texts = [" ".join(random_text(rng, n)) for n in (0, 1, 4, 5, 6, 7, 60)] + ["a b a b a b a b a b a b", None, "x y"]
    together = near_dedup.sketches(*near_dedup.hashed_words(texts))
    for k, t in enumerate(texts):
        assert (near_dedup.sketches(*near_dedup.hashed_words([t]))[0] == together[k]).all()
        assert together[k].any() == bool(words(t))
    swapped = " ".join(words(texts[6])[30:] + words(texts[6])[:30])  # nearly the same k-mers in another order
    a, b = near_dedup.sketches(*near_dedup.hashed_words([texts[6], swapped]))
    assert 0 < (a == b).mean() < 0.7


def test_passages_follow_their_first_occurrence_to_its_ends(spark):
    rng = random.Random(31)
    passage, own, rest = random_text(rng, 80), random_text(rng, 100), random_text(rng, 100)
    a = random_text(rng, 60) + passage + random_text(rng, 60)
    b = own + passage + rest
    texts = [a, b, random_text(rng, 50), b]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = substring_dedup.repeats(docs).filter("kind = 'passage'").collect()
    marks = {d: [set() for _ in t] for d, t in enumerate(texts)}
    for r in got:
        for i in range(r["start_word"], r["start_word"] + r["n_words"]):
            marks[r["doc_id"]][i].add((r["class_id"], r["removed"]))
    assert all((x == {(0, False)}) == (60 <= i < 140) and (x == set()) == (not 60 <= i < 140) for i, x in enumerate(marks[0]))
    assert not any(marks[2])
    # of document 1 the passage goes, and the rest stays as the first occurrence of what document 3 repeats
    assert all((0, True) in x for x in marks[1][100:180]) and all(x == {(1, False)} for x in marks[1][:100] + marks[1][180:])
    assert all(x and all(removed for _, removed in x) for x in marks[3])
    assert all((1, True) in x for x in marks[3][:80] + marks[3][200:]) and all((0, True) in x for x in marks[3][118:162])


def test_repeats_of_odd_rows(spark):
    rng = random.Random(41)
    t, long = " ".join(random_text(rng, 60)), " ".join(random_text(rng, 30_000))
    rows = [(1, t, 0), (1, t, 0), (2, None, 0), (3, "", 0), (None, t, 0), (None, t.upper(), 0), (4, long, 0), (5, "x " + long + " y", 0), (6, "two words", 0), (7, "Two, words!", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node int")
    got = substring_dedup.repeats(docs).filter("kind = 'passage'").collect()
    of = defaultdict(list)
    for r in got:
        of[r["doc_id"]].append((r["start_word"], r["n_words"], r["class_id"], r["removed"]))
    assert of[1] == [(0, 60, None, True)] and sorted(of[None]) == [(0, 60, None, False), (0, 60, None, True)]
    assert of[4] == [(0, 30_000, 4, False)] and of[5] == [(1, 30_000, 4, True)]
    assert of[6] == [(0, 2, 6, False)] and of[7] == [(0, 2, 6, True)] and set(of) == {1, None, 4, 5, 6, 7}


def test_registered_scores_are_of_trigrams(spark, tmp_path):
    from codequarry.llm import queries

    rng = random.Random(9)
    texts = [" ".join(rng.choice(["the", "cat", "sat", "on", "mat", "é", "X9", "a", "dog"]) for _ in range(rng.randint(0, 40))) for _ in range(40)] + [None, "", "the", "the cat"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    ws = [words(t) for t in texts]
    c = Counter(tuple(w[i : i + n]) for w in ws for n in (1, 2, 3) for i in range(len(w) - n + 1))
    total = sum(map(len, ws))

    def s(gram):
        if len(gram) == 1:
            return math.log(c[gram] / total)
        return math.log(c[gram] / c[gram[:-1]]) if c[gram] >= lm.MIN_COUNT else math.log(lm.BACKOFF) + s(gram[1:])

    got = {r["doc_id"]: r["log_prob"] for r in queries.op10_lm_scores(spark, str(tmp_path)).collect()}
    assert len(got) == len(texts)
    for d, w in enumerate(ws):
        assert abs(got[d] - sum(s(tuple(w[max(0, i - 2) : i + 1])) for i in range(len(w)))) < 1e-6
