from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from evenkeel.llm import components, katz, quality_classifier, simhash


def documents(n: int, seed: int) -> list[tuple]:
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.choices(words, [1 / (i + 1) for i in range(60)], k=rng.randint(0, 40))) for _ in range(n)]
    return [(i, t, i % 7 != 2) for i, t in enumerate([*texts, None, "", "unseen words only", "THE The the"])]


def good_turing(values: list[int]) -> list[float]:
    """What a count from 0 to 5 is multiplied by, after the article's formula; else an absolute discount."""
    n = [sum(v == r for v in values) for r in range(7)]
    try:
        a = 6 * n[6] / n[1]
        d = [1.0] + [((r + 1) * n[r + 1] / (r * n[r]) - a) / (1 - a) for r in range(1, 6)]
        if all(0 < x < 1 for x in d[1:]):
            return d
    except ZeroDivisionError:
        pass
    off = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
    off = min(max(off, 0.05), 0.95)
    return [1.0] + [(r - off) / r for r in range(1, 6)]


def brute(rows: list[tuple], order: int) -> tuple[dict, list[float]]:
    """Katz by dictionaries: scores, and the total probabilities of all histories."""
    token = {i: [None, *(x.encode().lower().split() if x else []), b""] for i, x, _ in rows}
    uni, grams = Counter(), [defaultdict(Counter) for _ in range(order + 1)]
    for i, _, train in rows:
        if train:
            t = token[i]
            uni.update(t[1:])
            for level in range(2, order + 1):
                for end in range(level - 1, len(t)):
                    grams[level][tuple(t[end - level + 1 : end])][t[end]] += 1
    total, d1 = sum(uni.values()), good_turing(list(uni.values()))
    ds = [good_turing([c for f in g.values() for c in f.values()]) for g in grams]
    unknown = sum(c - d1[c] * c for c in uni.values() if c <= 5) / total or 1 / (total + 1)
    weight = lambda d, c: d[c] * c if c <= 5 else float(c)
    scale = (1 - unknown) / sum(weight(d1, c) for c in uni.values())

    def p(h: tuple, w: bytes) -> float:
        if not h:
            return weight(d1, uni[w]) * scale if uni[w] else unknown
        d, followers = ds[len(h) + 1], grams[len(h) + 1].get(h)
        if not followers:
            return p(h[1:], w)
        below = sum(followers.values()) + all(c > 5 for c in followers.values())
        if w in followers:
            return weight(d, followers[w]) / below
        left = 1 - sum(weight(d, c) / below for c in followers.values())
        return left / (1 - sum(p(h[1:], x) for x in followers)) * p(h[1:], w)

    out = {}
    for i, t in token.items():
        score = sum(math.log10(p(tuple(t[max(0, end - order + 1) : end]), t[end])) for end in range(1, len(t)))
        base = sum(math.log10((uni[w] + 1) / (total + len(uni) + 1)) for w in t[1:])
        out[i] = (len(t) - 1, sum(uni[w] > 0 for w in t[1:]), total, base, score)
    histories = [h for g in grams for h in list(g)[:40]] + [(b"no such history",)] * (order > 1)
    return out, [sum(p(h, w) for w in [*uni, b"never seen"]) for h in histories]


@pytest.mark.parametrize(("hot", "order", "block"), [(4, 2, 1 << 22), (400, 2, 500), (400, 3, 700), (4, 4, 60), (4, 1, 200)])
def test_katz_equals_brute_force(spark, monkeypatch, hot, order, block):
    """Many split histories, or few; blocks that cut texts; an id of several rows and rows without one."""
    monkeypatch.setattr(katz, "HOT", hot)
    rows = documents(250, 1)
    rows.append((len(rows), " ".join(t or "" for _, t, _ in rows[:60]) + " " * 700 + "x" * 900 + "\tlong", True))
    ids = {i: None if i % 50 == 3 else 7 if i % 50 == 4 else i for i, _, _ in rows}
    df = spark.createDataFrame([(i, ids[i], t, l, "x") for i, t, l in rows], "row long, id long, text string, learn boolean, score string").repartition(3)
    want, sums = brute(rows, order)
    assert all(abs(s - 1) < 1e-9 for s in sums)
    found = katz.katz_scores(df, "id", "text", F.col("learn"), order=order, block_bytes=block).collect()
    key = lambda r: (r[0] is None, r[0] or 0, *(round(x, 6) for x in r[1:]))
    got = sorted(((r["id"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in found), key=key)
    for g, w in zip(got, sorted(((ids[i], *v) for i, v in want.items()), key=key), strict=True):
        assert g[:4] == w[:4] and all(abs(a - b) < 1e-9 * (1 + abs(b)) for a, b in zip(g[4:], w[4:], strict=True))


def test_katz_tables_hold_every_count(spark):
    rows = documents(60, 3)
    df = spark.createDataFrame(rows, "id long, text string, learn boolean")
    tables = []
    katz.katz_scores(df, "id", "text", F.col("learn"), order=3, block_bytes=600, keep_tables=tables)
    grams = [Counter(), Counter()]
    for _, x, train in rows:
        if train:
            t = [None, *(x.encode().lower().split() if x else []), b""]
            for level in (2, 3):
                grams[level - 2].update(tuple(t[e - level + 1 : e + 1]) for e in range(level - 1, len(t)))
    for table, want in zip(tables[1:], grams, strict=True):
        found = katz.ngrams(table)
        assert found.select("history", "word").distinct().count() == found.count() == len(want)
        assert sorted(r["n"] for r in found.collect()) == sorted(want.values())


def test_katz_without_training_rows_or_rows(spark):
    df = spark.createDataFrame([(1, "a b", False), (2, None, False)], "id long, text string, learn boolean")
    found = katz.katz_scores(df, "id", "text", F.col("learn")).collect()
    assert all(r["score"] == 0 and r["n_known"] == 0 and r["train_tokens"] == 0 for r in found) and len(found) == 2
    assert katz.katz_scores(df.where("false"), "id", "text", F.col("learn")).count() == 0


def test_packing():
    arrays = [np.arange(5), np.empty(0, np.float64), np.array([1.5, -2]), np.array([7], np.uint8)]
    for a, b in zip(arrays, katz.unpacked(katz.packed(*arrays)), strict=True):
        assert a.dtype == b.dtype and (a == b).all()


def test_components(spark):
    rng = random.Random(2)
    for n, m in ((60, 40), (200, 190), (30, 0)):
        links = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + [(i, i + 1) for i in range(1000, 1090)] + [(None, 3), (4, 4)]
        root = {x: x for l in links for x in l if x is not None}

        def find(x, root=root):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in links:
            if a is not None and a != b:
                a, b = find(a), find(b)
                root[max(a, b)] = min(a, b)
        linked = {x for a, b in links if a is not None and a != b for x in (a, b)}
        found = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
        assert found == {x: find(x) for x in linked}


def test_fingerprint_by_hand():
    import xxhash

    for text in ("", "One", "one TWO", "a b c d e f g", "x " * 100, "É é A"):
        words = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in text.split()]
        shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
        hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
        want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
        assert simhash.fingerprint(text) == want


def test_every_link_meets_at_an_anchor(spark):
    """Components of planted fingerprints equal those of all pairs: random ones, balls, chains and a dense group."""
    rng = random.Random(5)
    fps = {rng.getrandbits(64) for _ in range(300)} | {0, (1 << 64) - 1, 1, 7, 1 << 63}
    for _ in range(60):
        seed = rng.getrandbits(64)
        for _ in range(6):
            fps.add(seed ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4))))
    dense = rng.getrandbits(64)
    fps |= {dense ^ sum(1 << b for b in rng.sample(range(12), rng.randint(0, 4))) for _ in range(400)}
    fps = sorted(fps)
    x = np.array(fps, np.uint64)
    a, b = np.nonzero(np.bitwise_count(x[:, None] ^ x[None]) <= 3)
    nodes, roots = components.forest(x[a], x[b])
    want = dict(zip(nodes.tolist(), roots.tolist(), strict=True))
    df = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in fps], "fp long")
    links = simhash.links(df.repartition(3)).collect()
    assert len(links) < 4 * 2 * len(fps)
    nodes, roots = components.forest(*(np.array([r[c] for r in links], np.int64).view(np.uint64) for c in ("a", "b")))  # as unsigned, so that roots agree
    assert dict(zip(nodes.tolist(), roots.tolist(), strict=True)) == want


def test_near_duplicates(spark):
    rng = random.Random(4)
    base = [" ".join(f"v{rng.randrange(5000)}" for _ in range(300)) for _ in range(20)]
    texts = base + base[:5] + [t.replace(t.split()[150], "changed", 1) for t in base[:10]] + [None, "", "  "]
    df = spark.createDataFrame([(100 + i, t, "y") for i, t in enumerate(texts)], "doc_id long, text string, fp string").repartition(4)
    found = {r["doc_id"]: r for r in simhash.near_duplicates(df).collect()}
    x = np.array([simhash.fingerprint(t or "") for t in texts], np.uint64)
    nodes, roots = components.forest(*(x[i] for i in np.nonzero(np.bitwise_count(x[:, None] ^ x[None]) <= 3)))
    root = dict(zip(nodes.tolist(), roots.tolist(), strict=True))
    for i in range(len(texts)):
        own = [j for j in range(len(texts)) if root.get(int(x[j]), int(x[j])) == root.get(int(x[i]), int(x[i]))]
        assert found[100 + i]["component_id"] == 100 + min(own)
        assert found[100 + i]["fingerprint"] == f"{int(x[i]):016x}"
    kept = {r["doc_id"] for r in simhash.representatives(df, find=simhash.near_duplicates).collect()}
    assert kept == {r["component_id"] for r in found.values()}
    assert simhash.near_duplicates(df.where("false")).count() == 0
    twice = df.union(df)
    assert simhash.representatives(twice, find=simhash.near_duplicates).count() == len(kept)


def test_similar_documents(spark):
    """Copies with a few words changed are one group, texts that share half of their words are not."""
    rng = random.Random(14)
    say = lambda n: [f"{rng.choice('abcdefgh')}{rng.randrange(4000)}" if rng.random() < 0.6 else rng.choice(["the", "of", "and"]) for _ in range(n)]
    texts, family = [], []
    for k in range(60):
        base = say(rng.randint(120, 600))
        for c in range(3):
            words = list(base)
            for _ in range(c * len(base) // 130):
                words[rng.randrange(len(words))] = f"new{rng.random()}"
            texts.append(" ".join(words))
            family.append(k)
        texts.append(" ".join(base[: len(base) // 2] + say(len(base) // 2)))
        family.append(100 + k)
    texts += [None, "", "a", texts[0]]
    family += [300, 300, 301, 0]
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, id int").repartition(4)
    found = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(df).collect()}
    assert len(found) == len(texts)
    wrong = sum((found[i] == found[j]) != (family[i] == family[j]) for i in range(len(texts)) for j in range(i))
    pairs = sum(family[i] == family[j] for i in range(len(texts)) for j in range(i))
    assert wrong <= 0.05 * pairs
    assert not any(found[i] == found[j] and family[i] != family[j] for i in range(len(texts)) for j in range(i))
    kept = {r["doc_id"] for r in simhash.representatives(df).collect()}
    assert kept == set(found.values())
    ids = df.withColumn("doc_id", F.when(F.col("doc_id") != 5, F.col("doc_id")))
    assert simhash.representatives(ids).where("doc_id is null").count() == 1
    assert simhash.similar_documents(df.where("false")).count() == 0


def edited_pairs(seed: int, low: float, high: float, n: int) -> dict[str, list[tuple[str, str]]]:
    """Pairs of texts whose five-word shingle sets are so similar, by the shape of the edit."""
    rng = random.Random(seed)
    say = lambda k: [f"{rng.choice('abcdefgh')}{rng.randrange(4000)}" for _ in range(k)]
    out = {"appended": [], "replaced": [], "scattered": []}
    for shape, held in out.items():
        while len(held) < n:
            base = say(rng.randint(100, 600))
            changed, k = list(base), rng.randint(1, len(base) // 2)
            if shape == "appended":
                changed += say(k)
            elif shape == "replaced":
                at = rng.randrange(len(base) - k)
                changed[at : at + k] = say(k)
            else:
                for _ in range(max(1, k // 5)):
                    changed[rng.randrange(len(base))] = f"new{rng.random()}"
            if low <= jaccard(base, changed) < high:
                held.append((" ".join(base), " ".join(changed)))
    return out


def jaccard(x: list[str], y: list[str]) -> float:
    a, b = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (x, y))
    return len(a & b) / len(a | b)


def linked(spark, pairs: dict[str, list[tuple[str, str]]]) -> dict[str, int]:
    texts = [t for held in pairs.values() for pair in held for t in pair]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    found = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(df).collect()}
    same, at = {}, 0
    for shape, held in pairs.items():
        same[shape] = sum(found[i] == found[i + 1] for i in range(at, at + 2 * len(held), 2))
        at += 2 * len(held)
    return same


def test_similar_documents_of_any_edit_are_linked(spark):
    assert linked(spark, edited_pairs(21, 0.8, 0.9, 60)) == {"appended": 60, "replaced": 60, "scattered": 60}


def test_documents_below_the_similarity_are_not_linked(spark):
    assert linked(spark, edited_pairs(22, 0.6, 0.8, 60)) == {"appended": 0, "replaced": 0, "scattered": 0}


def test_spanning_links_are_given_ones():
    rng = np.random.default_rng(31)
    a, b = rng.integers(0, 400, (2, 500)) * 3 - 300
    x, y = components.spanning(a, b)
    assert {*zip(x.tolist(), y.tolist(), strict=True)} <= {*zip(a.tolist(), b.tolist(), strict=True)}
    assert [v.tolist() for v in components.forest(x, y)] == [v.tolist() for v in components.forest(a, b)]
    assert len(x) == len(components.forest(a, b)[0])


def test_similar_documents_are_linked_by_fingerprints_first(spark, monkeypatch):
    """SimHash links at anchors, and its exact check, come before the exact path, which leaves alone what they joined."""
    rng = random.Random(32)
    texts = []
    for _ in range(30):
        words = [f"v{rng.randrange(9000)}" for _ in range(1200)]
        changed = list(words)
        changed[rng.randrange(1200)] = "changed"
        texts += [" ".join(words), " ".join(changed), " ".join(words[:1100])]
    asked, verified = [], simhash._verified

    def watched(pairs, *rest):
        found = verified(pairs, *rest)
        asked.append(({(r["a"], r["b"]) for r in pairs.collect()}, {(r["a"], r["b"]) for r in found.collect()}))
        return found

    monkeypatch.setattr(simhash, "_verified", watched)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    found = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(df).collect()}
    assert all(found[i] == i - i % 3 for i in found)
    sets = [simhash.shingle_set(t) for t in texts]
    prints = {simhash._node(x): simhash.majority(x) for x in sets}
    near = {(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 3}
    assert len(near) > 20 and asked[0][0] <= near
    ends = lambda pairs: components.forest(*(np.array(x, np.int64) for x in zip(*sorted(pairs), strict=True)))
    assert [x.tolist() for x in ends(asked[0][0])] == [x.tolist() for x in ends(near)] and asked[0][1] == asked[0][0]
    assert asked[1][1] and not any(pairs & asked[0][1] for pairs, _ in asked[1:])


def test_repeated_and_missing_ids_lose_no_text(spark):
    rng = random.Random(23)
    a, b, c, d = (" ".join(f"v{rng.randrange(5000)}" for _ in range(100)) for _ in range(4))
    rows = [(None, a), (None, b), (None, None), (7, c), (7, c), (7, d), (9, d), (8, a)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for find in (simhash.similar_documents, simhash.near_duplicates):
        kept = sorted(((r["doc_id"] or 0, r["text"] or "") for r in simhash.representatives(df, find=find).collect()))
        assert kept == sorted([(0, a), (0, b), (0, ""), (7, c), (7, d), (8, a)])


def labelled(n: int) -> tuple[list, list]:
    rng = random.Random(9)
    words = [f"{a}{b}" for a in "the of and in to is".split() for b in ("", "re", "on", "al")]
    docs, labels = [], []
    for i in range(n):
        good = rng.random() < 0.7
        text = [rng.choice(words) for _ in range(rng.randint(20, 120))]
        if not good:
            text = rng.choice([[w.upper() + "!!" for w in text], [w + "###" for w in text], [text[0]] * len(text)])
        docs.append((i, " ".join(text), good, "e"))
        labels.append((i, int(good)))
    return docs, labels


def test_classifier_on_held_out_rows(spark):
    docs, labels = labelled(500)
    d = spark.createDataFrame([*docs, (900, None, False, "e"), (901, "", False, "e"), (902, "word " * 50_000, False, "e")], "doc_id long, text string, quality boolean, score string")
    l = spark.createDataFrame([*labels, (3, None), (None, 1), *labels[:20]], "doc_id long, quality int")
    model = quality_classifier.trained(d, l, learn=F.col("doc_id") % 5 != 0)
    found = {r["doc_id"]: r["score"] for r in quality_classifier.score(d, model, "doc_id", "text").collect()}
    assert len(found) == 503 and all(0 <= s <= 1 for s in found.values())
    held = [(found[i] >= 0.3) == bool(q) for i, q in labels if i % 5 == 0]
    assert np.mean(held) > 0.97
    again = quality_classifier.trained(d.repartition(7), l.repartition(5), learn=F.col("doc_id") % 5 != 0)
    assert {r["doc_id"]: r["score"] for r in quality_classifier.score(d, again, "doc_id", "text").collect()} == found


def test_classifier_without_labels(spark):
    docs, _ = labelled(5)
    d = spark.createDataFrame(docs, "doc_id long, text string, quality boolean, score string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = quality_classifier.trained(d, none)
    assert [r["score"] for r in quality_classifier.score(d, model, "doc_id", "text").collect()] == [0.5] * 5
    assert quality_classifier.score(d.where("false"), model, "doc_id", "text").count() == 0


def test_word_vectors_are_sums_over_all_documents(spark):
    texts = ["One two two three, four.", None, "", "five", "two one one one one", "a b\nc d e f g " * 30]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    index = quality_classifier.index_vectors().astype(float)
    sums = np.zeros_like(index)
    for t in texts:
        at = quality_classifier.indices(t or "", quality_classifier.Buckets())
        for i, a in enumerate(at):
            for j in range(max(0, i - quality_classifier.NEAR), min(len(at), i + quality_classifier.NEAR + 1)):
                if j != i:
                    sums[a] += index[at[j]]
    got = quality_classifier.word_vectors(df, "text")
    seen = sums.any(axis=1)
    assert np.allclose(got[seen], sums[seen] / np.linalg.norm(sums[seen], axis=1, keepdims=True), atol=1e-6)
    assert np.allclose(got[~seen], index[~seen] / 2)
    assert quality_classifier.word_vectors(df.where("false"), "text").shape == index.shape


def test_a_huge_text_does_not_end_the_sample(spark):
    docs = spark.createDataFrame([(i, "x " * (5000 if i == 3 else 20)) for i in range(8)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(8)], "doc_id long, quality int")
    texts, found = quality_classifier.sample(docs, labels, "doc_id", "text", "quality", F.lit(True), most=6, most_chars=120)
    assert len(texts) == 3 and all(len(t) == 40 for t in texts)
    assert len(quality_classifier.sample(docs, labels, "doc_id", "text", "quality", F.lit(True), most_chars=400)[0]) == 7
