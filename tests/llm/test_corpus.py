"""Overlaps, near duplicates, rules, mixing, the classifier and the pipeline."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tessella.llm import decontam, lshforest, milquality, mixing, rules
from tessella.llm.common import Scratch, table
from tessella.llm.components import components

VOCABULARY = [f"w{i}" for i in range(3000)]


def words(rng, n):
    return [rng.choice(VOCABULARY) for _ in range(n)]


def test_overlaps_with_substitutions(spark, messy, empty):
    rng = random.Random(1)
    items = [(i, " ".join(words(rng, n))) for i, n in enumerate((15, 20, 40, 300, 7, 3))]
    docs, want = [], set()
    for k in range(60):
        text = words(rng, 400)
        item = k % 6
        body = items[item][1].split()
        if k < 36:
            changed = rng.sample(range(len(body)), 2 if len(body) == 15 else len(body) // 10 if len(body) > 10 else 0)
            part = ["zzz" if i in changed else w.upper() + "," for i, w in enumerate(body)]
            at = rng.randrange(400)
            text[at:at] = part[:60]
            want.add((k, item))
        docs.append((k, " ".join(text)))
    docs += [(100, None), (101, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([*items, (9, None), (10, "")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.find_overlaps(df, bench).collect()}
    assert got == want
    kept = {r.doc_id for r in decontam.drop_contaminated(df, bench).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _ in want}
    assert decontam.find_overlaps(df, bench.limit(0)).count() == 0 and decontam.find_overlaps(empty, bench).count() == 0
    assert decontam.drop_contaminated(messy, bench).count() == messy.count()


def test_any_qualifying_segment_counts():
    import numpy as np

    for runs in ([12, 1, 3], [11, 1, 2]):
        equal = np.array([i % 2 == 0 for i, n in enumerate(runs) for _ in range(n)])
        assert decontam.best_segment(equal) == (sum(runs[::2]), sum(runs))
    rng = np.random.default_rng(5)
    for n in [*range(12)] * 5 + [40] * 60:
        equal = rng.random(n) < 0.7
        want = max((int(equal[i:j].sum()) for i in range(n) for j in range(i + 1, n + 1) if equal[i:j].sum() >= 0.8 * (j - i)), default=0)
        got, length = decontam.best_segment(equal)
        assert got == want and got >= 0.8 * length


def test_every_substitution_in_short_items_meets_a_seed():
    from itertools import combinations

    import numpy as np

    for n in range(1, 17):
        item = np.arange(1, n + 1, dtype=np.uint64)
        masks = decontam.mask_list([decontam.family(n)])
        seeds = [decontam.window_hashes(item, *m) for m in masks]
        for changed in combinations(range(n), n // 5):
            text = item.copy()
            text[list(changed)] = 999
            assert any((decontam.window_hashes(text, *m) == s).any() for m, s in zip(masks, seeds, strict=True)), (n, changed)
    assert decontam.family(0) is None


def test_short_items_with_substitutions_are_found(spark):
    rng = random.Random(2)
    items = [(n, words(rng, n)) for n in range(5, 17)]
    docs = []
    for n, body in items:
        part = list(body)
        for i in rng.sample(range(n), n // 5):
            part[i] = "zzz"
        docs.append((n, " ".join([*words(rng, 50), *part, *words(rng, 50)])))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([(n, " ".join(b)) for n, b in items], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontam.find_overlaps(df, bench).collect()} == {(n, n) for n, _ in items}


def brute_overlaps(docs, items, min_words=13, similarity=0.8):
    """Every alignment of every item with every text, word by word."""
    split = lambda t: re.findall(r"\w+", (t or "").lower())
    out = {}
    for row, (d, text) in enumerate(docs):
        a = split(text)
        for item_id, item in items:
            b = split(item)
            for shift in range(-len(b) + 1, len(a)) if b else ():
                lo, hi = max(0, -shift), min(len(b), len(a) - shift)
                same = [a[i + shift] == b[i] for i in range(lo, hi)]
                if sum(same) < min(min_words, similarity * len(b)):
                    continue
                found = []
                if sum(same) >= similarity * len(b):
                    found = [(sum(same), len(b))]
                else:
                    sums = [0]
                    for x in same:
                        sums.append(sums[-1] + x)
                    ends = [i for i, x in enumerate(same) if x]
                    found = [(sums[j + 1] - sums[i], j + 1 - i) for i in ends for j in ends if j >= i]
                    found = [x for x in found if x[0] >= similarity * x[1] - 1e-9 and x[0] >= min(min_words, similarity * len(b))]
                if found:
                    key = (row, d, item_id)
                    out[key] = max(out.get(key, (0, 0)), max(found))
    return sorted((str(d), str(i), n, k) for (_, d, i), (n, k) in out.items())


def test_overlaps_against_every_alignment(spark):
    rng = random.Random(11)
    items = [(n, " ".join(words(rng, n))) for n in (2, 3, 4, 6, 8, 11, 14, 16, 25, 60, 150)]
    items += [(items[-1][0], items[-1][1]), (None, " ".join(words(rng, 20))), (500, ""), (600, items[7][1]), (601, items[7][1])]
    docs = []
    for k in range(120):
        text = words(rng, rng.randrange(30))
        for _ in range(rng.randrange(3)):
            body = rng.choice(items)[1].split()
            a = rng.randrange(max(1, len(body) // 3))
            body = body[a : len(body) - rng.randrange(max(1, len(body) // 3))]
            share = rng.choice((0, 0.1, 0.2, 0.3))
            text += ["zzz" if rng.random() < share else w for w in body] + words(rng, rng.randrange(20))
        if k % 10 == 9:  # a rewritten stretch, longer than any fixed reach, in the midst of a copy
            body = items[9][1].split()
            text += body[:25] + ["x"] * 10 + body[35:]
        docs.append((None if k % 40 == 7 else k, " ".join(text)))
    docs += [docs[9], (900, None), (901, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS item_id", "'x' AS words", "2 AS row", "3 AS hash")
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "0 AS item", "'y' AS at")
    got = sorted((str(r.doc_id), str(r.item_id), r.n_equal, r.n_words) for r in decontam.find_overlaps(df, bench).collect())
    want = brute_overlaps(docs, items)
    assert len(want) > 60 and got == want
    kept = decontam.drop_contaminated(df, bench)
    bad = {x[0] for x in want if x[0] != "None"}
    assert kept.columns == df.columns and {str(r.doc_id) for r in kept.collect()} - {"None"} == {str(d) for d, _ in docs if d is not None} - bad


def brute_links(texts, threshold=0.8, n=5):
    sets = {}
    for i, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    pairs = {(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b]
             and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    return Counter(x for p in pairs for x in p), {i: find(i) for i in sets}


def test_near_duplicates_with_a_group_of_many_chunks(spark, monkeypatch):
    monkeypatch.setattr(lshforest, "CHUNK", 16)
    monkeypatch.setattr(lshforest, "LEAST_CHUNK", 16)
    rng = random.Random(2)
    base = words(rng, 150)
    texts = []
    for i in range(120):
        t = list(base)
        for _ in range(rng.randrange(6)):
            t[rng.randrange(len(t))] = rng.choice(VOCABULARY)
        texts.append((i, " ".join(t)))
    texts += [(200 + i, texts[i % 4][1]) for i in range(20)] + [(300 + i, " ".join(words(rng, 30))) for i in range(40)]
    texts += [(400, None), (401, ""), (402, "one two"), (403, "one two")]
    links, roots = brute_links(texts)
    rows = lshforest.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"), recall=0.99999).collect()
    assert len(rows) == len(texts)
    assert {r.doc_id: r.n_links for r in rows} == {i: links[i] for i, _ in texts}
    assert {r.doc_id: r.class_id for r in rows} == roots
    kept = lshforest.drop_near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"), recall=0.99999)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(roots.values()))


def test_classes_of_nodes_with_several_classes(spark, monkeypatch):
    """Prefixes of one value put texts of many classes in one node; heads alone cannot tell them apart."""
    monkeypatch.setattr(lshforest, "CHUNK", 8)
    monkeypatch.setattr(lshforest, "LEAST_CHUNK", 8)
    rng = random.Random(8)
    texts = []
    for g in range(6):
        shared, own = words(rng, 60) if not g else texts[0][1].split()[:60], words(rng, 60)
        for _ in range(20):
            t = shared + own
            for _ in range(rng.randrange(4)):
                t[rng.randrange(len(t))] = rng.choice(VOCABULARY)
            texts.append((len(texts), " ".join(t)))
    rng.shuffle(texts)
    links, roots = brute_links(texts)
    assert 1 < len(set(roots.values())) < 100
    df = spark.createDataFrame(texts, "doc_id long, text string")
    rows = lshforest.near_duplicates(df, depth=3, recall=0.9999).collect()
    assert {r.doc_id: r.class_id for r in rows} == roots and {r.doc_id: r.n_links for r in rows} == {i: links[i] for i, _ in texts}
    plain = lshforest.near_duplicates(df, depth=3, recall=0.9999, count_links=False).collect()
    assert {r.doc_id: r.class_id for r in plain} == roots and all(r.n_links is None for r in plain)


def test_prefixes_are_shortened_until_the_recall(spark):
    """40 texts share whole labels in trie 0, three share 8 values in trie 1, two share 7 in trie 2."""
    p = lshforest.chance
    assert p(0.8, 7, 32) >= 0.999 > p(0.8, 8, 32) and (2 + p(0.8, 8, 32)) / 3 >= 0.999 and (39 + p(0.8, 10, 32)) / 40 >= 0.999
    bits = lshforest.deep_bits(10, 7)
    label = lambda a, b, c: (a << 2 * bits) | (b << bits) | c
    rows = [(i, 0, 5, label(1, 2, 3)) for i in range(40)]
    rows += [(100 + i, 1, 6, label(1, 10 + i, 3)) for i in range(3)] + [(200 + i, 2, 7, label(20 + i, 2, 3)) for i in range(2)]
    rows += [(i, 3, 1000 + i, 0) for i in (0, 100, 200, 300)] + [(0, 2, 7, label(30, 2, 3))]
    members = spark.createDataFrame(rows, "row long, tree int, node long, deep long")
    got = {}
    for r in lshforest.forest(members, 0.8, 32, 10, 7, 0.999, Scratch(spark)).collect():
        got.setdefault(r.node, set()).add((r.row, r.open, r.head))
    want = [{(i, True, 0) for i in range(40)}, {(100 + i, True, 100) for i in range(3)}, {(200, True, 0), (201, True, 0), (0, False, 0)}]
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want))


def test_near_duplicates_of_messy_rows(messy, empty):
    rows = lshforest.near_duplicates(messy).collect()
    assert len(rows) == messy.count() and lshforest.near_duplicates(empty).count() == 0
    assert sorted((str(r.doc_id), r.n_links) for r in rows if r.class_id == 5) == [("5", 4), ("5", 4), ("6", 4), ("7", 4), ("None", 4)]
    kept = lshforest.drop_near_duplicates(messy)
    assert kept.columns == messy.columns
    ids = sorted(str(r.doc_id) for r in kept.collect())
    assert ids == sorted(["1", "2", "3", "4", "5", "8", "9", "None"])


def test_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)]
    got = {r.u: r.root for r in components(spark.createDataFrame(edges, "u long, v long"), Scratch(spark)).collect()}
    parent = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for a, b in edges:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}


def brute_counts(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    at = defaultdict(list)
    for i in range(len(w) - 7):
        at[tuple(w[i : i + 8])].append(i)
    cover = {i + d for places in at.values() if len(places) > 1 for i in places for d in range(8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(cover))


def test_text_counts(spark, messy, empty, small):
    rng = random.Random(4)
    texts = ["a b c d e f g h " * 3, "x y \x0b z\x85\n\nq\n q\nq", "\n\n \n", "#*$ |\n|", "é" * 9 + " &<>"]
    texts += [" ".join(rng.choice("abc") for _ in range(rng.randrange(60))) for _ in range(60)]
    texts += [r.text for r in table(spark, small, "documents").collect()]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in rules.apply_rules(df, []).collect():
        want = brute_counts(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, r.text
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0]) and r.kept == (not r.base_failed)
    got = rules.apply_rules(messy, []).collect()
    assert len(got) == messy.count() and rules.apply_rules(empty, []).count() == 0
    clash = df.selectExpr("doc_id", "text", "-doc_id AS n_words", "'x' AS kept", "doc_id AS f_upper")
    out = rules.passing(clash, [])
    assert out.columns == clash.columns and all(r.n_words == -r.doc_id and r.kept == "x" for r in out.collect())
    assert out.count() == sum(r.kept for r in rules.apply_rules(df, []).collect())


def test_learned_list_by_hand(spark, messy):
    """``kept`` of a list of rules, against the same list followed by hand."""
    import math

    def by_hand(text):
        n, chars, symbols, dups, repeats = brute_counts(text)
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        size, n_words = max(1, len(text)), max(1, n)
        return {
            "f_symbols": symbols / size, "f_digits": sum(c in "0123456789" for c in text) / size, "f_bangs": sum(c in "!?" for c in text) / size,
            "f_punctuation": sum(c in ".,;:" for c in text) / size, "f_word_length": chars / n_words, "f_dup_lines": dups / max(1, len(lines)),
            "f_repeats": repeats / n_words, "f_adjacent": sum(a == b for a, b in zip(w, w[1:])) / n_words, "f_distinct": len(set(w)) / n_words,
            "f_line_words": n / max(1, len(lines)), "f_words": math.log2(n + 1), "f_upper": sum(c.isupper() for c in text) / size,
        }

    c = rules.Condition
    listed = [(c("f_symbols", True, 0.02), c("f_words", True, 5.5)), (c("f_distinct", False, 0.4),), (c("f_upper", True, 0.03), c("f_word_length", False, 5.2), c("f_adjacent", False, 0.1))]
    docs = table(spark, "/root/testdata/sf0.001", "documents").unionByName(messy.select("doc_id", "text", "lang", "source", "n_chars"))
    verdicts = set()
    for r in rules.apply_rules(docs.select("doc_id", "text"), listed).collect():
        f = by_hand(r.text or "")
        met = any(all((f[x.feature] > x.threshold) == x.above for x in rule) for rule in listed)
        assert r.kept == (not r.base_failed and not met)
        verdicts.add((r.base_failed, r.kept))
    assert len(verdicts) == 3
    clash = docs.selectExpr("doc_id", "text", "1 AS __text", "2 AS __words", "3 AS own0", "4 AS f_symbols", "'x' AS n_words")
    out = rules.apply_rules(clash, listed)
    assert set(clash.columns) <= set(out.columns) and out.where("__text <> 1 or __words <> 2 or own0 <> 3 or f_symbols <> 4").count() == 0
    assert out.where("kept").count() == rules.apply_rules(docs, listed).where("kept").count()


def test_learned_rules(spark, messy, empty):
    docs, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    learned = rules.fit_rules(docs, labels)
    assert learned
    out = rules.apply_rules(docs, learned).where("not base_failed").join(labels, "doc_id").groupBy("kept", "quality").count().collect()
    n = {(r.kept, r.quality): r["count"] for r in out}
    assert n.get((False, 1), 0) <= 0.01 * n[True, 1] and n.get((True, 0), 0) <= 0.2 * n[False, 0]
    none = labels.limit(0)
    assert rules.fit_rules(docs, none) == [] and rules.fit_rules(empty, labels) == []
    assert rules.fit_rules(messy, spark.createDataFrame([(5, 1), (5, None), (None, 0)], "doc_id long, quality int")) == []


def test_raking_reaches_the_targets(spark, messy, empty):
    rng = random.Random(6)
    cells = [(s, lang, t, rng.randrange(1, 5000)) for s in "abc" for lang in ("en", "de") for t in ("x", "y")]
    df = spark.createDataFrame(cells, "source string, lang string, topic string, n long")
    targets = {"source": spark.createDataFrame([("a", 0.5), ("b", 0.3), ("c", 0.2), ("gone", 1.0)][:3], "v string, p double"),
               "lang": spark.createDataFrame([("en", 0.5), ("de", 0.5)], "v string, p double")}
    out = mixing.calibrated_cells(df, targets, {"topic": 1.0}).join(df, list(mixing.MARGINS)).collect()
    total = sum(r.n for r in out)
    used = {r: r.n * r.prob * r.weight for r in out}
    all_used = sum(used.values())
    assert sum(r.n * r.prob for r in out) == pytest.approx(0.5 * total)
    for v, p in (("a", 0.5), ("b", 0.3), ("c", 0.2)):
        assert sum(u for r, u in used.items() if r.source == v) / all_used == pytest.approx(p, abs=1e-4)
    assert sum(u for r, u in used.items() if r.lang == "en") / all_used == pytest.approx(0.5, abs=1e-4)
    drawn = mixing.mix_sources(messy)
    assert 0 < drawn.count() <= messy.count() and set(messy.columns) <= set(drawn.columns)
    assert mixing.mix_sources(empty).count() == 0


def test_classifier_on_held_out_documents(spark, messy, empty):
    docs, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    model = milquality.fit(docs, labels)
    rows = milquality.score(docs, model).join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in rows) >= 0.95 * len(rows)
    got = milquality.score(messy, model).collect()
    assert len(got) == messy.count() and all(0 <= r.score <= 1 for r in got)
    assert milquality.score(empty, model).count() == 0
    assert milquality.fit(docs, labels.limit(0)) == 0.5
    assert milquality.score(messy, 0.5).where("score = 0.5 and predicted = 1").count() == messy.count()


def test_classifier_scores_by_hand(spark, messy, monkeypatch):
    """The query's scores against the formula, one passage and one document at a time."""
    import math

    docs, labels = table(spark, "/root/testdata/sf0.001", "documents"), table(spark, "/root/testdata/sf0.001", "labels")
    model = milquality.fit(docs, labels, epochs=5)
    p = {k: v.tolist() for k, v in model.p.items()}
    sig = lambda v: 1 / (1 + math.exp(-v))
    dot = lambda x, w, j: sum(a * row[j] for a, row in zip(x, w, strict=True))

    def by_hand(text):
        hidden, marks = [], []
        for row in milquality.encode(text or "").tolist():
            x = [min(8, max(-8, (a - m) / s)) for a, m, s in zip(row, model.mean.tolist(), model.scale.tolist(), strict=True)]
            h = [math.tanh(dot(x, p["W"], j) + b) for j, b in enumerate(p["b"])]
            marks.append(sum(w * math.tanh(dot(h, p["V"], j)) * sig(dot(h, p["U"], j)) for j, w in enumerate(p["w"])))
            hidden.append(h)
        e = [math.exp(m) for m in marks]
        z = [sum(a * h[j] for a, h in zip(e, hidden, strict=True)) / sum(e) for j in range(len(p["u"]))]
        return sig(sum(a * b for a, b in zip(z, p["u"], strict=True)) + p["c"][0])

    texts = docs.orderBy("doc_id").limit(40).unionByName(messy.select("doc_id", "text", "lang", "source", "n_chars").where("length(text) < 1000 or text is null").dropDuplicates(["doc_id"]).where("doc_id is not null").withColumn("doc_id", -F.col("doc_id")))
    scores = {r.doc_id: r for r in milquality.score(texts, model).collect()}
    for r in texts.collect():
        assert scores[r.doc_id].score == pytest.approx(by_hand(r.text), abs=1e-5)
        assert scores[r.doc_id].predicted == (scores[r.doc_id].score >= 0.5)


def test_repeated_labels_and_long_texts_in_training(spark):
    rows = [(i, "good words in a row here " * 30 if i % 2 else "### $$$ %%% " * 40) for i in range(60)]
    docs = spark.createDataFrame(rows + [(0, "zzz")] * 50 + [(1, "w " * 50_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows] * 2 + [(2, 1), (3, None)], "doc_id long, quality int")
    again = spark.createDataFrame(rows[::-1] + [(0, "zzz"), (1, "w " * 50_000)], "doc_id long, text string")
    a, b = milquality.fit(docs, labels, epochs=3), milquality.fit(again, labels.dropDuplicates(), epochs=3)
    assert all((a.p[k] == b.p[k]).all() for k in a.p)
    assert len(milquality.spaced(milquality.encode("w " * 50_000), 64)) == 64


def test_classifier_gradients():
    import numpy as np

    rng = np.random.default_rng(0)
    bags = [rng.normal(size=(k, milquality.N_FEATURES)) for k in (1, 4, 2)]
    x, starts, y = np.concatenate(bags), np.array([0, 1, 5]), np.array([0.0, 1.0, 1.0])
    m = milquality.AttentionMIL.start(x, 5, 4, rng)

    def loss():
        p = m.forward(x, starts)["y"]
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    g = m.gradients(m.forward(x, starts), y, starts)
    for k, v in m.p.items():
        i = tuple(0 for _ in v.shape)
        kept = v[i]
        v[i] = kept + 1e-5
        up = loss()
        v[i] = kept - 1e-5
        assert (up - loss()) / 2e-5 == pytest.approx(g[k][i], rel=1e-3, abs=1e-7)
        v[i] = kept


def test_pipeline_of_messy_rows(spark, messy, small):
    """Null ids and texts, empty and very long texts, repeated rows and clashing columns go through all stages."""
    import corpus_pipeline as c

    docs, columns = messy, messy.columns
    for name, stage in c.STAGES:
        before = docs.count()
        docs = c.materialise(stage(spark, docs, small), "test")
        if name != c.STAGES[-1][0]:
            assert docs.columns == columns and docs.count() <= before
            assert docs.where("kept <> 'x' or n_words <> 'x' or digest <> 'x' or row <> 'x'").count() == 0
        if name == "quality rules":
            assert sorted(str(r.doc_id) for r in docs.collect()) == ["5", "5", "6", "7", "None"]
        if name in ("near duplicates", "decontamination", "secret scan"):
            assert [r.doc_id for r in docs.collect()] == [5]
    assert set(docs.columns) == set(columns) | {"n_tokens", "prob", "weight"} and docs.dtypes[docs.columns.index("prob")][1] == "double"


def test_pipeline_of_empty_tables(spark, tmp_path):
    import corpus_pipeline as c

    for name, schema in (("documents", "doc_id long, text string, lang string, source string, n_chars long"),
                         ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    out = c.run(spark, str(tmp_path))
    assert out.count() == 0 and {"doc_id", "text", "topic", "n_tokens", "prob", "weight"} <= set(out.columns)


def test_secrets_go_before_the_mix_and_copies_before_the_benchmark(spark, small, tmp_path):
    """Planted rows: each stage's decision takes effect in what the pipeline returns."""
    import corpus_pipeline as c

    rng = random.Random(14)
    docs, bench = table(spark, small, "documents"), table(spark, small, "benchmark").where("text is not null").first().text
    prose = lambda: " ".join("".join(rng.choices("abcdefghijklmnop", k=rng.randrange(3, 9))) for _ in range(120)) + "."
    one, two = prose(), prose()
    planted = [(10**6, one), (10**6 + 1, one), (10**6 + 2, one + " end"), (10**6 + 3, two + " " + bench), (10**6 + 4, "a b c")]
    more = spark.createDataFrame([(i, t, "en", "web", len(t)) for i, t in planted], "doc_id long, text string, lang string, source string, n_chars long")
    docs.unionByName(more.select(docs.columns)).write.parquet(str(tmp_path / "documents.parquet"))
    for name in ("labels", "benchmark"):
        table(spark, small, name).write.parquet(str(tmp_path / f"{name}.parquet"))
    now = table(spark, str(tmp_path), "documents")
    for _, stage in c.STAGES[:3]:
        now = c.materialise(stage(spark, now, str(tmp_path)), "test")
    assert {r.doc_id for r in now.where("doc_id >= 1000000").collect()} == {10**6}


def test_mix_replaces_named_columns_only(spark, messy):
    drawn = mixing.mix_sources(messy, budget=1.0)
    assert set(drawn.columns) == set(messy.columns) | {"n_tokens", "prob", "weight"}
    kinds = dict(drawn.dtypes)
    assert (kinds["prob"], kinds["topic"], kinds["kept"]) == ("double", "string", "string") and drawn.where("topic = 'x' or kept <> 'x'").count() == 0
    given = mixing.mix_sources(messy.withColumn("count", F.lit(7)), tokens_col="count").collect()
    assert given and all(r.n_tokens == 7 for r in given)


def test_raking_many_cells_by_joins(spark):
    rng = random.Random(15)
    cells = [(f"s{i % 13}", f"l{i % 7}", f"t{i % 5}", rng.randrange(1, 900)) for i in range(300)]
    sums = Counter()
    for *cell, n in cells:
        sums[tuple(cell)] += n
    df = spark.createDataFrame([(*c, n) for c, n in sums.items()], "source string, lang string, topic string, n long")
    one = {tuple(r)[:3]: tuple(r)[3:] for r in mixing.calibrated_cells(df).collect()}
    many = {tuple(r)[:3]: tuple(r)[3:] for r in mixing.calibrated_cells(df, one_task_cells=10).collect()}
    assert one.keys() == many.keys() == sums.keys()
    assert all(one[k] == pytest.approx(many[k], abs=1e-9) for k in one)


def test_pipeline_stages(spark, small):
    import corpus_pipeline as c

    docs = table(spark, small, "documents")
    names = docs.columns
    now = {}
    for name, stage in c.STAGES:
        out = c.materialise(stage(spark, docs, small), "test")
        if name != c.STAGES[-1][0]:
            assert out.columns == names
        now[name], docs = (docs, out), out
    before, after = now["quality rules"]
    failed = {r.doc_id for r in rules.apply_rules(before, []).where("base_failed").collect()}
    assert not failed & {r.doc_id for r in after.collect()}
    before, after = now["near duplicates"]
    _, roots = brute_links([(r.doc_id, r.text) for r in before.collect()])
    assert {r.doc_id for r in after.collect()} == set(roots.values())
    before, after = now["decontamination"]
    bench = [" ".join(re.findall(r"\w+", r.text.lower())) for r in table(spark, small, "benchmark").collect()]
    leaks = {r.doc_id for r in before.collect() if any(b in " ".join(re.findall(r"\w+", r.text.lower())) for b in bench)}
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect()} - leaks
    before, after = now["secret scan"]
    assert before.count() == after.count() and after.where(F.col("text").rlike("[0-9a-f]{16}")).count() == 0
    before, after = now["source mix"]
    assert 0 < after.count() < before.count()
    assert c.run(spark, small).count() == after.count()


def test_registered():
    import __spark_entry__ as e

    found = e.queries()
    assert all(sum(n.startswith(f"op{k}_") for n in found) == 1 for k in range(1, 11)) and "pipeline" in found


@pytest.mark.parametrize("one_task_cells", [100_000, 1])
def test_strained_targets_are_met_on_either_path(spark, one_task_cells):
    n = {("a", "x"): 100_000, ("b", "y"): 100_000, ("a", "y"): 100, ("b", "x"): 100}
    cells = spark.createDataFrame([(s, la, "t", k) for (s, la), k in n.items()], "source string, lang string, topic string, n long")
    targets = {"source": spark.createDataFrame([("a", 0.8), ("b", 0.2)], "v string, s double"), "lang": spark.createDataFrame([("x", 0.3), ("y", 0.7)], "v string, s double")}
    got = mixing.calibrated_cells(cells, targets, budget=0.001, one_task_cells=one_task_cells).collect()
    share = {(r.source, r.lang): n[r.source, r.lang] * r.prob * r.weight for r in got}
    every = sum(share.values())
    assert (share["a", "x"] + share["a", "y"]) / every == pytest.approx(0.8, abs=1e-9)
    assert (share["a", "x"] + share["b", "x"]) / every == pytest.approx(0.3, abs=1e-9)


def test_contradictory_targets_end_with_their_residual(spark, caplog):
    cells = [("a", "x", "t", 10), ("b", "y", "t", 10)]  # a and x, b and y stand for the same documents
    df = spark.createDataFrame(cells, "source string, lang string, topic string, n long").withColumn("w", F.col("n").cast("double"))
    df = df.withColumns({"t_source": F.when(F.col("source") == "a", 0.9).otherwise(0.1), "t_lang": F.when(F.col("lang") == "x", 0.4).otherwise(0.6), "t_topic": F.lit(1.0)})
    for small in (True, False):
        _, off, held = mixing.raked(df, 1, 1e-12, 1000, small)
        held.drop()
        assert off == pytest.approx(0.5) and "shares differ by up to 0.5" in caplog.text
        caplog.clear()
    _, off, held = mixing.raked(df.withColumn("t_lang", F.col("t_source")), 1, 1e-12, 1000, True)
    assert off < 1e-12 and not caplog.text
