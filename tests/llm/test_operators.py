"""Each operator against a plain version, on small corpora with copies, near copies and rows of every odd kind."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from . import plain

SYLLABLES = "an be co du er fa gi ho is ju ka lo me no ou pi re sa te un vi wo".split()


def word(r):
    return "".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 3)))


def prose(r, n):
    return "".join(word(r) + r.choice([" ", " ", " ", " ", " ", ". ", "\n"]) for _ in range(n)).strip()


def edited(r, text, k):
    w = text.split(" ")
    for _ in range(k):
        w[r.randrange(len(w))] = word(r)
    return " ".join(w)


@pytest.fixture(scope="module")
def corpus():
    """(doc_id, text) with different ids: copies, near copies, shared passages, nulls, empty, long and odd texts."""
    r = random.Random(5)
    base = [prose(r, r.randint(30, 160)) for _ in range(12)]
    passage = prose(r, 90)
    texts = [*base, base[0], base[0], base[3].upper(), *(edited(r, base[1], k) for k in (1, 1, 2, 3, 6, 9)), *(edited(r, base[2], 2) for _ in range(6))]
    texts += [f"{prose(r, 20)} {passage} {prose(r, 15)}" for _ in range(4)] + [base[4] + "\n" + base[4], " ".join(["same"] * 40)]
    texts += [None, "", "   \n\t ", "one two three", "One  two\nthree", "ünï cödé ☃ 日本", "x" * 30_000, "a b " * 3000, prose(r, 4000)]
    r.shuffle(texts)
    return list(enumerate(texts, 10))


@pytest.fixture(scope="module")
def odd(corpus):
    """The same with null and repeated ids, and repeated rows."""
    rows = list(corpus)
    return rows + [(None, rows[0][1]), (None, None), rows[1], rows[1], (rows[2][0], rows[3][1]), (rows[2][0], "other text of an id " * 30)]


#: Names that operators use inside, as columns of the table.
CLASHES = {"h": 1, "key": "k", "path": "p", "rep": 3, "component": 4, "words": ["w"], "n": 5, "own": 6, "firsts": 7, "lines": 8, "cut": 9, "row": 10, "k1": 11, "estimate": 0.5}


def table(spark, rows):
    df = spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 3}", len(t or "")) for i, t in rows], "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG")
    return df.withColumns({k: F.lit(v) if not isinstance(v, list) else F.array(*map(F.lit, v)) for k, v in CLASHES.items()}).repartition(3)


def same_rows(df, columns, expected):
    order = lambda rows: sorted(rows, key=repr)
    assert order(tuple(r[c] for c in columns) for r in df.select(*columns).collect()) == order(expected)


# op1
@pytest.mark.parametrize("seed", range(4))
def test_two_stage_sorting(seed):
    from orrery.llm.suffixes import suffix_array

    r = random.Random(seed)
    for _ in range(40):
        x = bytes(r.randrange(r.choice([1, 2, 4, 250])) for _ in range(r.randint(1, 300)))
        x += x[: r.randint(0, len(x))]
        width = r.choice([3, 9, 20, 5000])
        order = suffix_array(np.frombuffer(x, np.uint8), width)
        assert sorted(order) == list(range(len(x)))
        keys = [x[i : i + width] for i in order]
        assert keys == sorted(keys)


def test_common_prefixes_of_wanted_suffixes():
    from orrery.llm.suffixes import longest_repeats

    def common(x, y):
        n = 0
        while n < min(len(x), len(y)) and x[n] == y[n]:
            n += 1
        return n

    r = random.Random(1)
    for _ in range(100):
        contexts = [bytes(r.randrange(97, 97 + r.choice([1, 2, 4])) for _ in range(r.randint(1, 40))) for _ in range(r.randint(1, 6))]
        contexts += [contexts[0]] * r.randint(0, 2)
        starts = [r.randint(0, len(c)) for c in contexts]
        got, bounds = longest_repeats(contexts, starts, 50)
        places = [(i, j) for i, n in enumerate(starts) for j in range(n)]
        for i, j in places:
            assert got[bounds[i] + j] == max((common(contexts[i][j:], contexts[k][m:]) for k, m in places if (k, m) != (i, j)), default=0)


@pytest.mark.parametrize("which", ["corpus", "odd"])
def test_suffix_array_dedup(spark, request, which):
    from orrery.llm.suffixes import drop_repeats

    rows = request.getfixturevalue(which)
    for width, passage in ((400, 300), (40, 300), (90, 70)):
        expected = plain.suffix_dedup([t for _, t in rows], width)
        repeated = [e[1] for e in plain.suffix_dedup([t for _, t in rows], min(width, passage))]
        assert sum(repeated) > sum(e[1] for e in expected) or passage > width
        same_rows(drop_repeats(table(spark, rows), width=width, passage=passage), ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_repeated"], [(i, *e, n) for (i, _), e, n in zip(rows, expected, repeated)])


def test_suffix_array_dedup_of_hot_anchors(spark, corpus, monkeypatch):
    from orrery.llm import suffixes

    monkeypatch.setattr(suffixes, "HOT", 2)
    expected, shorter = (plain.suffix_dedup([t for _, t in corpus], w) for w in (80, 60))
    for passage, other in ((60, shorter), (80, expected)):
        got = suffixes.drop_repeats(table(spark, corpus), width=80, passage=passage)
        same_rows(got, ["doc_id", "n_removed", "kept_sha256", "n_repeated"], [(i, e[1], e[3], o[1]) for (i, _), e, o in zip(corpus, expected, other)])


# op2
def bench_rows(corpus):
    r = random.Random(9)
    texts = [t for _, t in corpus if t and len(t.split()) > 40][:4]
    return [(1, " ".join(texts[0].split()[5:25])), (2, texts[1].upper().replace(" ", ", ")[:200]), (20, "One Two Three"), (3, prose(r, 40)), (4, None), (5, ""), (6, "..."), (7, " ".join(texts[0].split()[10:22])), (None, "ignored words")]


def test_decontamination(spark, odd):
    from orrery.llm.decontaminate import contamination_report, remove_contamination

    items = bench_rows(odd)
    bench = spark.createDataFrame(items, "item_id LONG, text STRING")
    expected = plain.decontaminate([t for _, t in odd], [x for x in items if x[0] is not None])
    assert 3 < sum(e[4] for e in expected) < len(odd)
    columns = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    same_rows(contamination_report(table(spark, odd), bench), columns, [(i, *e) for (i, _), e in zip(odd, expected)])
    left = remove_contamination(table(spark, odd), bench)
    assert left.columns == table(spark, odd).columns
    after = plain.decontaminate([r.text for r in left.collect()], [x for x in items if x[0] in (1, 3, 7)])
    assert not any(e[4] for e in after)
    same_rows(left.where("doc_id is null"), ["doc_id", "n_chars"], [(i, len(t or "")) for i, t in odd if i is None])


def test_decontamination_in_blocks(spark, corpus):
    from orrery.llm.decontaminate import contamination_report

    items = [x for x in bench_rows(corpus) if x[0] is not None]
    bench = spark.createDataFrame(items, "item_id LONG, text STRING")
    expected = plain.decontaminate([t for _, t in corpus], items)
    got = contamination_report(table(spark, corpus), bench, block_bytes=200)
    same_rows(got, ["doc_id", "n_words", "n_hit", "n_items", "items_sha256"], [(i, *e[:4]) for (i, _), e in zip(corpus, expected)])


def test_blocks_cut_as_one_block(spark):
    """Windows of items in different blocks overlap: cutting one block first would leave a part too short for the other."""
    from orrery.llm.decontaminate import contamination_report, remove_contamination

    r = random.Random(21)
    w = [f"{word(r)}{i}" for i in range(60)]
    items = [(i, " ".join(w[4 * i : 4 * i + 12])) for i in range(10)]  # each overlaps the next two
    rows = [(1, "before " + " ".join(w[:48]) + " behind"), (2, "clean words"), (2, "clean words"), (3, None), (4, " ".join(w[4:16])), (4, "other words " * 6)]
    bench = spark.createDataFrame(items, "item_id LONG, text STRING")
    for block_bytes in (1 << 20, 200, 60):
        left = remove_contamination(table(spark, rows), bench, block_bytes=block_bytes)
        same_rows(left, ["doc_id", "text"], [(1, "before  behind"), *rows[1:4], (4, ""), rows[5]])
        expected = plain.decontaminate([t for _, t in rows], items)
        same_rows(contamination_report(table(spark, rows), bench, block_bytes=block_bytes), ["doc_id", "n_words", "n_hit", "n_items", "items_sha256"], [(i, *e[:4]) for (i, _), e in zip(rows, expected)])


def test_items_without_an_id(spark):
    import duckdb

    from orrery.llm.decontaminate import contamination_report, remove_contamination
    from orrery.llm.sql import DECONTAMINATION

    r = random.Random(22)
    w = [f"{word(r)}{i}" for i in range(40)]
    items = [(None, " ".join(w[:14])), (None, " ".join(w[20:31])), (7, " ".join(w[8:20])), (8, "not there")]
    rows = [(1, " ".join(w)), (2, "clean words"), (3, " ".join(w[20:32])), (4, " ".join(w[6:20])), (5, None)]
    docs, bench = table(spark, rows), spark.createDataFrame(items, "item_id LONG, text STRING")
    con = duckdb.connect()
    for name, df in (("documents", docs.select("doc_id", "text")), ("benchmark", bench)):
        con.register(name, df.toArrow())
    expected = con.sql(DECONTAMINATION).fetchall()
    assert sorted(e[:4] for e in expected) == [(1, 40, 31, 2), (2, 2, 0, 0), (3, 12, 11, 1), (4, 14, 12, 1), (5, 0, 0, 0)]
    columns = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    for block_bytes in (1 << 20, 100):
        same_rows(contamination_report(docs, bench, block_bytes=block_bytes), columns, expected)
        left = {x.doc_id: x.text for x in remove_contamination(docs, bench, block_bytes=block_bytes).collect()}
        assert left[1].split() == w[31:] and left[3].split() == w[31:32] and left[4].split() == w[6:8]


def test_fm_index_finds_and_locates():
    from orrery.llm.decontaminate import FmIndex

    r = random.Random(2)
    text = np.array([0, *(r.choice([0, 1, 1, 2, 3]) for _ in range(400)), 0])
    index = FmIndex(text, 3)
    for n in (1, 2, 3, 5):
        p = np.array([[r.randint(1, 3) for _ in range(n)] for _ in range(30)])
        low, high = index.search(p, np.full(30, n))
        for row, a, b in zip(p, low, high):
            assert sorted(index.locate(np.arange(a, b))) == [i for i in range(len(text) - n + 1) if (text[i : i + n] == row).all()]


# op3
def test_toxicity_on_held_out_documents(spark):
    from orrery.llm.toxicity import toxicity_scores

    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    held = labels.where("doc_id % 3 = 0").withColumnRenamed("toxic", "truth")
    got = toxicity_scores(docs, labels.where("doc_id % 3 <> 0")).join(held, "doc_id").select("toxic", "truth", "severity", "grade").toPandas()
    assert len(got) > 1000
    assert (got.toxic[got.truth == 1]).mean() > 0.85 and (got.toxic[got.truth == 0]).mean() < 0.01
    assert got.severity.between(0, 3).all() and got.severity[got.truth == 1].mean() > 10 * got.severity[got.truth == 0].mean()


def test_toxicity_of_odd_rows(spark, odd):
    from orrery.llm.toxicity import toxicity_scores

    r = random.Random(1)
    bad = [(1000 + i, f"{prose(r, 30)} scoundrel {prose(r, 20)} scoundrel {word(r)}") for i in range(20)]
    rows = odd + bad
    labels = spark.createDataFrame([(i, int(i >= 1000), None) for i, _ in rows if i is not None] + [(None, 1, 1), (77777, 1, 1), (10, None, 0)], "doc_id LONG, toxic INT, other INT")
    got = toxicity_scores(table(spark, rows), labels).collect()
    assert len(got) == len(rows) and all(g.toxic for g in got if (g.doc_id or 0) >= 1000) and not any(g.toxic for g in got if (g.doc_id or 0) < 1000)
    none = toxicity_scores(table(spark, rows), labels.limit(0)).collect()
    assert len(none) == len(rows) and not any(g.toxic for g in none)


def test_toxicity_by_its_formula(spark, odd):
    """Feature counts, severity, grade and probability of each document once more, by strings and one document at a time."""
    import math
    import re

    from orrery.llm.toxicity import PREFIXES, fit_toxicity, toxicity_scores

    r = random.Random(3)
    rows = [(i, t) for i, t in odd if i is not None] + [(1000 + i, f"{prose(r, 30)} scoundrel {prose(r, 20)} villainous {'scoundrel ' * (i % 4)} {word(r)}") for i in range(40)]
    rows += [(1000, "another text of a labelled id")] * 50
    labels = spark.createDataFrame([(i, int(i >= 1000)) for i in {i for i, _ in rows}], "doc_id LONG, toxic INT")
    model = fit_toxicity(table(spark, rows), labels)
    assert len(model.words) and (np.diff(model.thresholds) > 0).all()

    def features(t):
        import pyarrow as pa

        from orrery.llm.common import slices
        from orrery.llm.toxicity import text_features

        low = plain.lower(t).encode()
        words = re.findall(rb"[a-z\x80-\xff]+", low)
        kinds = words + [w[:k] for k in PREFIXES for w in words if len(w) > k]
        part = next(slices([pa.RecordBatch.from_arrays([pa.array([1]), pa.array([t], pa.string())], ["i", "t"])], 1))
        hashes = text_features(part)[1].tolist()
        assert len(hashes) == len(kinds)
        return hashes

    weight = dict(zip(model.words.tolist(), model.weights.tolist()))
    expected = []
    for i, t in rows:
        found = [h for h in features(t) if h in weight]
        z = sum(weight[h] * math.log1p(found.count(h)) for h in set(found))
        below = [1 / (1 + math.exp(-(x - z))) for x in model.thresholds] + [1.0]
        p = [b - a for a, b in zip([0.0, *below], below)]
        expected.append((i, len(found), round(sum(k * x for k, x in enumerate(p)), 6), max(range(4), key=lambda k: (p[k], -k)), round(1 - p[0], 6)))
    got = [(g.doc_id, g.n_toxic_features, round(g.severity, 6), g.grade, round(g.p_toxic, 6)) for g in toxicity_scores(table(spark, rows), labels).collect()]
    assert sorted(got) == sorted(expected)


def test_thresholds_are_ordered():
    from orrery.llm.toxicity import Ordinal, fit_ordinal

    r = np.random.default_rng(0)
    n = 600
    x = r.integers(0, 4, n)
    grade = np.clip(x + (r.random(n) < 0.1), 0, 3)
    w, theta = fit_ordinal(np.arange(n), np.zeros(n, int), x.astype(float), grade, 1)
    assert w[0] > 0 and (np.diff(theta) > 0).all()
    e = Ordinal(np.zeros(1, np.uint64), w, theta).expected(w[0] * np.arange(4.0))
    assert (np.diff(e) > 0).all() and e[0] < 0.6 and e[3] > 2.3


# op4
def test_near_duplicates(spark, corpus):
    from orrery.llm.setsketch import keep_representatives, near_duplicates

    expected = plain.near_duplicates(corpus)
    assert sum(not e[2] for e in expected.values()) > 6
    same_rows(near_duplicates(table(spark, corpus)), ["doc_id", "n_shingles", "component_id", "kept"], [(i, *e) for i, e in expected.items()])
    same_rows(keep_representatives(table(spark, corpus)), ["doc_id"], [(i,) for i, e in expected.items() if e[2]])


def test_near_duplicates_of_odd_rows(spark, odd):
    from orrery.llm.setsketch import near_duplicates

    got = near_duplicates(table(spark, odd)).collect()
    assert len(got) == len(odd)
    assert all(g.component_id is None and g.kept for g in got if g.doc_id is None)
    assert all(g.component_id <= g.doc_id for g in got if g.doc_id is not None)


def test_rows_of_one_id_are_one_document(spark):
    from orrery.llm.setsketch import keep_representatives, near_duplicates

    r = random.Random(51)
    a, b, c, d = (prose(r, 60) for _ in range(4))
    rows = [(3, a), (5, a), (5, b), (7, b), (8, c), (8, None), (9, c), (9, ""), (20, d), (20, d), (21, None), (21, "x"), (30, None), (30, d)]
    got = {(g.doc_id, g.component_id, g.kept) for g in near_duplicates(table(spark, rows)).collect()}
    assert got == {(3, 3, True), (5, 3, False), (7, 3, False), (8, 8, True), (9, 8, False), (20, 20, True), (21, 21, True), (30, 20, False)}
    same_rows(keep_representatives(table(spark, rows)), ["doc_id"], [(i,) for i, _ in rows if i in (3, 8, 20, 21)])


def test_recall_of_pairs_at_the_threshold(spark):
    """Pairs of a similarity of 0.75 to 0.80, each of its own words: the bands must bring together 0.9 of them, and do nearly all."""
    from orrery.llm.setsketch import near_duplicates

    r, rows, planted = random.Random(52), [], 0
    while planted < 150:
        text = [f"{word(r)}{r.randrange(10**6)}" for _ in range(r.choice([60, 200, 600]))]
        other = list(text)
        for i in range(0, len(text), r.choice([33, 36, 39])):
            other[i] = "changed"
        a, b = ({tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in (text, other))
        if 0.75 <= len(a & b) / len(a | b) < 0.8:
            rows += [(2 * planted, " ".join(text)), (2 * planted + 1, " ".join(other))]
            planted += 1
    got = {g.doc_id: g.component_id for g in near_duplicates(table(spark, rows)).collect()}
    assert sum(got[2 * i + 1] == 2 * i for i in range(planted)) >= 0.98 * planted


def test_links_are_found_where_the_smallest_member_is_far(spark):
    """A chain: each text is near the next one only, so that stars around the smallest member do not do."""
    from orrery.llm.setsketch import near_duplicates

    r = random.Random(4)
    texts = [prose(r, 150)]
    for _ in range(14):
        texts.append(edited(r, texts[-1], 3))
    rows = list(enumerate(texts)) + [(100 + i, prose(r, 80)) for i in range(5)]
    expected = plain.near_duplicates(rows)
    same_rows(near_duplicates(table(spark, rows)), ["doc_id", "component_id"], [(i, e[1]) for i, e in expected.items()])


def test_blocks_of_large_clusters(spark, corpus, monkeypatch):
    from orrery.llm import setsketch

    monkeypatch.setattr(setsketch, "BLOCK_SHINGLES", 150)
    monkeypatch.setattr(setsketch, "BLOCK_MEMBERS", 2)
    expected = plain.near_duplicates(corpus)
    same_rows(setsketch.near_duplicates(table(spark, corpus)), ["doc_id", "component_id"], [(i, e[1]) for i, e in expected.items()])


def test_joint_likelihood_is_near_the_truth():
    from orrery.llm.common import mix
    from orrery.llm.setsketch import jaccard_likelihood, registers

    r = np.random.default_rng(3)
    for shared in (50, 600, 950):
        a = r.integers(0, 2**63, 1000, dtype=np.uint64)
        b = np.concatenate([a[:shared], r.integers(0, 2**63, 1000 - shared, dtype=np.uint64)])
        rows = registers(np.repeat([0, 1], 1000), mix(np.concatenate([a, b])), 2)
        estimate, _ = jaccard_likelihood(rows[:1], rows[1:], np.array([1000.0]), np.array([1000.0]))
        assert abs(estimate[0] - shared / (2000 - shared)) < 0.17
        merged = registers(np.zeros(2000, int), mix(np.concatenate([a, b])), 1)
        assert (merged[0] == np.maximum(rows[0], rows[1])).all()


# op5
def test_quality_against_labels(spark):
    from orrery.llm.quality import quality_scores

    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = quality_scores(docs).withColumnRenamed("quality", "score").join(labels, "doc_id").toPandas()  # no label is used to fit
    assert (got.kept[got.quality == 1]).mean() > 0.995 and (~got.kept[got.quality == 0]).mean() > 0.9


def test_quality_of_odd_rows(spark, odd):
    from orrery.llm.quality import keep_good, quality_scores

    got = quality_scores(table(spark, odd)).collect()
    assert len(got) == len(odd) and all(0 <= g.quality <= 1 and 0 <= g.weak_label <= 1 for g in got)
    kept = keep_good(table(spark, odd))
    assert kept.columns == table(spark, odd).columns and kept.count() == sum(g.kept for g in got)


def test_labeller_accuracies():
    from orrery.llm.quality import fit_labellers

    r = np.random.default_rng(1)
    good = r.random(20_000) < 0.8
    rates = [(0.6, 0.001), (0.5, 0.002), (0.7, 0.001)]
    votes = np.stack([-((r.random(20_000) < np.where(good, b, a)).astype(int)) for a, b in rates], 1)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    fit = fit_labellers(patterns, counts)
    for j, (a, _) in enumerate(rates):
        assert abs(fit.table[j, 0, 0] - a) < 0.12 and fit.table[j, 1, 0] < 0.01


def test_a_labeller_with_many_false_alarms_is_not_believed():
    from orrery.llm.quality import fit_labellers

    r = np.random.default_rng(3)
    good = r.random(50_000) < 0.8
    rates = [(0.6, 0.002), (0.5, 0.002), (0.7, 0.002), (0.1, 0.1)]  # the last one says nothing about the class
    votes = np.stack([-((r.random(50_000) < np.where(good, b, a)).astype(int)) for a, b in rates], 1)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    fit = fit_labellers(patterns, counts)
    assert abs(fit.table[3, 1, 0] - 0.1) < 0.01 and abs(fit.good - 0.8) < 0.02
    assert (fit.posterior(votes[good]) < 0.5).mean() < 0.02


def test_rates_of_labellers_with_false_alarms():
    """Labellers that vote bad on 5 to 20 % of the good documents, and two that vote good on either class: estimates within 0.03 of the planted rates."""
    from orrery.llm.quality import fit_labellers

    r = np.random.default_rng(8)
    n = 100_000
    good = r.random(n) < 0.75
    rates = [(0.6, 0.05, 0, 0), (0.7, 0.1, 0, 0), (0.5, 0.2, 0, 0), (0.55, 0.08, 0, 0), (0, 0, 0.15, 0.8), (0.1, 0.05, 0.2, 0.6)]  # bad votes on bad and good, good votes on bad and good
    votes = []
    for bad_on_bad, bad_on_good, good_on_bad, good_on_good in rates:
        x = r.random(n)
        b, g = np.where(good, bad_on_good, bad_on_bad), np.where(good, good_on_good, good_on_bad)
        votes.append(np.where(x < b, -1, np.where(x < b + g, 1, 0)))
    patterns, counts = np.unique(np.stack(votes, 1), axis=0, return_counts=True)
    fit = fit_labellers(patterns, counts)
    assert abs(fit.good - 0.75) < 0.03
    for j, (a, b, c, d) in enumerate(rates):
        assert np.abs(fit.table[j, :, [0, 2]] - [[a, b], [c, d]]).max() < 0.03, (j, fit.table[j])


def test_weak_labels_and_scores_by_their_formulae(spark, corpus):
    """Posterior and score of each document once more, from the fitted numbers, one document and one vote at a time."""
    import math

    import pyarrow as pa

    from orrery.llm.common import slices
    from orrery.llm.quality import features, fit_quality, quality_scores, votes

    df = table(spark, corpus)
    labels, scorer = fit_quality(df)
    got = {g.doc_id: g for g in quality_scores(df).collect()}
    for i, t in corpus:
        part = next(slices([pa.RecordBatch.from_arrays([pa.array([i]), pa.array([t], pa.string())], ["i", "t"])], 1))
        matrix, parsed = votes(part)
        odds = math.log(labels.good / (1 - labels.good)) + sum(math.log(labels.table[j, 1, v + 1] / labels.table[j, 0, v + 1]) for j, v in enumerate(matrix[0]))
        z = scorer.bias + sum(scorer.weights[b] * x for _, b, x in zip(*features(parsed, part.data, 1)))
        assert got[i].weak_label == pytest.approx(1 / (1 + math.exp(-odds)), abs=1e-6) and got[i].quality == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-6)


def test_the_sample_is_drawn_by_id_and_text(spark):
    """Null ids, one repeated row and one repeated id do not fill or empty the sample."""
    from orrery.llm.quality import fit_quality

    r = random.Random(17)
    texts = [prose(r, 70) for _ in range(300)] + ["$$$ ### || ^^ ~~ {} [] ++ == ** && %% @@ <> !! " * 4] * 100
    for ids in ([None] * 400, [7] * 400, range(400)):
        labels, scorer = fit_quality(spark.createDataFrame(list(zip(ids, texts)), "doc_id LONG, text STRING"), sample=100)
        assert np.abs(scorer.weights).sum() > 0 and 0.5 < labels.good < 0.9


def test_labellers_vote_good_too():
    import pyarrow as pa

    from orrery.llm.common import slices
    from orrery.llm.quality import votes

    texts = ["The garden was quiet in the morning, and nobody came. Later a few people walked by the river.", "$$$ ### || ^^ ~~ {} [] ++ == ** && %% @@ <> !!"]
    part = next(slices([pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(texts)], ["i", "t"])], 1))
    found = votes(part)[0]
    assert (found[0] == 1).sum() >= 3 and not (found[0] == -1).any() and (found[1] == -1).sum() >= 2


# op6
@pytest.mark.parametrize("which", ["corpus", "odd"])
def test_substring_dedup(spark, request, which):
    from orrery.llm.substrings import drop_substrings

    rows = request.getfixturevalue(which)
    for width, start in ((13, 7), (13, 2), (4, 7)):
        expected = plain.substring_dedup(rows, width)
        assert sum(e[1] for e in expected) > 100
        same_rows(drop_substrings(table(spark, rows), width=width, start=start), ["doc_id", "n_words", "n_removed", "kept_sha256"], [(i, *e) for (i, _), e in zip(rows, expected)])


def test_levels_double_until_nothing_survives(spark):
    from orrery.llm.substrings import candidates, levels

    assert levels(13, 2) == [2, 4, 8] and levels(13, 7) == [7] and levels(4, 7) == [4] and levels(16, 2) == [2, 4, 8]
    rows = [(1, "a b c d e f g h i j k l m n o p"), (2, "a b c d e f g h i j k l m n o p"), (3, "a b c d e f 1 2 3 4 5 6 7 8 9"), (4, "a b 21 c d 22 23 24 25 26 27 28 29")]
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING").withColumn("key", F.col("doc_id"))
    alive = {n: {r.key for r in candidates(docs, 13, 2)[0].collect()} if n == 8 else {r.key for r in candidates(docs, 2 * n, n)[0].collect()} for n in (2, 8)}
    assert alive[8] == {1, 2} and {1, 2, 3} <= alive[2]


# op7
def test_line_dedup(spark, odd):
    from orrery.llm.lines import drop_recurring_lines, line_report

    r = random.Random(8)
    lines = [f"Share page {i} now" for i in range(9)] + ["Read more", "", "same words twice"]
    docs = [(500 + i, "\n".join(r.choice([prose(r, 6), *lines]) for _ in range(r.randint(1, 12)))) for i in range(30)]
    rows = odd + docs + [(600 + i, docs[0][1]) for i in range(5)]
    expected = plain.recurring_lines(rows)
    assert sum(e != t for e, (_, t) in zip(expected, rows)) > 15
    got = drop_recurring_lines(table(spark, rows))
    assert got.columns == table(spark, rows).columns
    same_rows(got, ["doc_id", "text"], [(i, e) for (i, _), e in zip(rows, expected)])
    n = lambda t: 0 if t is None else t.count("\n") + 1
    report = line_report(table(spark, rows))
    same_rows(report, ["doc_id", "n_lines", "kept_sha256"], [(i, n(t), plain.sha(e or "")) for (i, t), e in zip(rows, expected)])
    assert "Python" not in report._jdf.queryExecution().toString() and "Arrow" not in report._jdf.queryExecution().toString()


def left_of(spark, rows):
    from orrery.llm.lines import drop_recurring_lines

    left = {r.doc_id: r.text for r in drop_recurring_lines(table(spark, rows)).collect()}
    assert left == {i: e for (i, _), e in zip(rows, plain.recurring_lines(rows))}
    return left


def test_all_lines_of_a_block_go(spark):
    """A block of boilerplate in many documents, behind blank lines and at the ends of texts, goes with its inner lines."""
    r = random.Random(41)
    block = ["Home", "About us", "Contact sales", "Privacy policy"]
    body = lambda: prose(r, 12).replace("\n", " ")
    rows = [(i, "\n".join([body(), *([""] if i % 2 else []), *block, *([body()] if i % 3 else [])])) for i in range(60)]
    left = left_of(spark, rows)
    for i, t in rows:
        assert left[i].split("\n") == [x for x in t.split("\n") if x not in block]


def test_fields_of_letters_are_generalised(spark):
    r = random.Random(42)
    name = lambda: "".join(r.choice("abcdefghij") for _ in range(7))
    forms = ["Posted by user{} in general forum", "Posted by {} {}", "Filed under {}", "Welcome back, {}"]
    rows = [(i, forms[i % 4].format(name(), name())) for i in range(100)] + [(200 + i, prose(r, 40).replace("\n", " ")) for i in range(5)]
    left = left_of(spark, rows)
    assert all(left[i] == "" for i in range(100)) and all(left[i] == t for i, t in rows[100:])


def test_copies_keep_what_is_theirs(spark):
    """Near copies of a document with a notice: the notice goes, from them too, and their own lines stay, however many copies there are."""
    r = random.Random(43)
    notice, own = "All of this was written by hand", [prose(r, 14).replace("\n", " ") for _ in range(8)]
    rows = [(i, "\n".join([prose(r, 20).replace("\n", " "), notice])) for i in range(12)] + [(50 + i, "\n".join([*own, notice])) for i in range(30)]
    rows += [(100 + i, "\n".join([*own[:2], edited(r, own[2], 1), *own[3:], notice])) for i in range(6)]
    left = left_of(spark, rows)
    assert not any(notice in t for t in left.values()) and all(own[0] in left[i] and own[7] in left[i] for i in (*range(50, 80), *range(100, 106)))


# op8
def test_license_scan(spark, odd):
    from orrery.llm.licenses import TEXTS, best_templates, license_scan, templates

    notice = "Licensed under the Apache License, Version 2.0."
    rows = odd + [(900, f"{odd[0][1] or 'words'}\n{notice}\nmore"), (901, TEXTS["MIT"]), (902, "Copyright (c) 2020 A. Person\n\n" + TEXTS["ISC"].replace("purpose", "use")), (903, "The MIT of license words")]
    got = {g.doc_id: g for g in license_scan(table(spark, rows)).where("doc_id >= 900").collect()}
    assert got[900].license == "Apache-2.0" and got[900].dice == 1 and got[901].license == "MIT" and got[902].license == "ISC" and 0.9 < got[902].dice < 1 and got[903].license is None
    rest = license_scan(table(spark, rows)).where("doc_id < 900 or doc_id is null").collect()
    assert len(rest) == len(odd) and all(g.license is None and g.dice == 0 and g.licenses == [] for g in rest)

    def pairs(t):
        w = plain.ALNUM_WORD.findall(plain.lower(t))
        return {(a, b) for a, b in zip(w, w[1:])}

    for text in (notice, TEXTS["BSD-2-Clause"], "This work is licensed under the GNU GPL v3"):  # every template, whatever its size
        best = max((2 * len(pairs(text) & pairs(t)) / (len(pairs(text)) + len(pairs(t))), k) for k, t in templates())
        row = license_scan(spark.createDataFrame([(1, text)], "doc_id LONG, text STRING")).first()
        assert row.dice == pytest.approx(best[0]) and best_templates is not None


def test_licenses_within_longer_texts(spark):
    from orrery.llm.licenses import TEXTS, license_scan

    r = random.Random(12)
    around = lambda t, gap="\n": f"{prose(r, 300)}{gap}{t}{gap}{prose(r, 400)}"
    apart = TEXTS["MIT"].replace("\n", "\n\n")
    wrapped = "\n".join(" ".join(TEXTS["ISC"].split()[i : i + 9]) for i in range(0, 200, 9))
    texts = {
        1: (around(apart), "MIT", 1.0), 2: (around(wrapped), "ISC", 1.0), 3: (around("This article is licensed under the MIT License, as is", " "), "MIT", 1.0),
        4: (around(TEXTS["BSD-3-Clause"].replace("\n", "\n\n"), " "), "BSD-3-Clause", 1.0), 5: (around(TEXTS["GPL-2.0"].replace("\n", "\n\n"), " "), "GPL-2.0", 1.0),
        6: (around(apart.replace("sublicense, and/or sell", "and sell").replace("AUTHORS OR", "AUTHORS, EDITORS OR THE")), "MIT", None),
    }
    clean = {10: around("This work is licensed under the Foo License of ours", " "), 11: around("This program is licensed under the terms of the house rules", " "), 12: around(" ".join(apart.split()[:60]), " "), 13: "mit license " * 5000, 14: around("on the Creative Commons Attribution 4.0 International License we wrote", " ")}
    rows = [(i, x[0]) for i, x in texts.items()] + list(clean.items())
    got = {g.doc_id: g for g in license_scan(table(spark, rows)).collect()}
    for i, (_, name, dice) in texts.items():
        assert (got[i].license, got[i].n_units) == (name, 1) and (got[i].dice == dice if dice else 0.9 < got[i].dice < 1), got[i]
    assert all(got[i].license is None and got[i].n_units == 0 for i in clean), [got[i] for i in clean]
    marks = [(20, "MIT License"), (21, "# The MIT License\n" + prose(r, 50)), (22, "// SPDX-License-Identifier: MIT\n" + prose(r, 200)), (23, around("see SPDX-License-Identifier: BSD-3-Clause here", " ")), (24, around("we read of the MIT License today", " ")), (25, "This work is licensed under a Creative Commons Attribution 4.0 International License.")]
    assert [g.license for g in license_scan(table(spark, marks)).orderBy("doc_id").collect()] == ["MIT", "MIT", "MIT", "BSD-3-Clause", None, "CC-BY-4.0"]
    twice = license_scan(table(spark, [(1, around(apart) + "\n\n" + around(wrapped))])).first()
    assert twice.licenses == ["ISC", "MIT"] and twice.n_units == 2


# op9
def test_quality_rules(spark, odd):
    from orrery.llm.rules import quality_rules

    got = quality_rules(table(spark, odd))
    same_rows(got, ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"], [(i, *plain.base_rules(t)) for i, t in odd])
    assert got.where("kept and base_failed").count() == 0


def test_verdicts_of_the_rules(spark, odd):
    """Distances and verdict once more, by counting characters and words one document at a time."""
    from orrery.llm import rules

    r = random.Random(61)
    rows = [(i, t, ["en", "de", None, ""][k % 4]) for k, (i, t) in enumerate(odd)] + [(3000 + i, " ".join(r.choice(rules.COMMON["de"].split() + ["Wort", "Stadt", "Fluss"]) for _ in range(900)), "de") for i in range(4)]
    rows += [(4000, "7% & 8% " * 300 + " ".join(f"w{i}" for i in range(900)), "de"), (4001, " ".join(word(r) for _ in range(3000)), "xx")]
    expected = plain.rule_verdicts(rows, rules.WORDS, rules.MIN_CHARS, rules.MIN_WORDS, rules.LANGUAGE_WORDS, rules.CHAR_LIMIT, rules.WORD_LIMIT)
    got = rules.quality_rules(spark.createDataFrame(rows, "doc_id LONG, text STRING, lang STRING").repartition(3))
    assert len({e[3] for e in expected}) == 2
    order = lambda x: sorted(x, key=repr)
    assert order((g.doc_id, round(g.char_distance, 5), round(g.word_distance, 5), g.kept) for g in got.collect()) == order((i, *e[1:]) for (i, _, _), e in zip(rows, expected))


def test_every_language_has_its_own_reference(spark):
    """More languages than any fixed number: each has words of one letter of its own, and a text is near its own language only."""
    from orrery.llm.rules import distance, quality_rules

    r, n = random.Random(31), 300
    alphabets = ["abcdefghijklm", "#$%&*<>|", "0123456789"]
    texts = {i: [" ".join("".join(r.choice(alphabets[i % 3]) for _ in range(5)) for _ in range(520)) for _ in range(4)] for i in range(n)}
    rows = [(4 * i + k, t, f"x{i}") for i, own in texts.items() for k, t in enumerate(own)] + [(5000, texts[1][0], "rare"), (5001, texts[1][0], None), (5002, texts[1][0], "")]
    got = {g.doc_id: g for g in quality_rules(spark.createDataFrame(rows, "doc_id LONG, text STRING, lang STRING").repartition(4)).collect()}
    assert len(got) == len(rows) and all(got[i].char_distance < 0.05 and got[i].kept for i in range(4 * n)) and distance is not None
    assert got[5000].char_distance == got[5001].char_distance == got[5002].char_distance > 0.3


def test_clean_documents_pass_the_rules(spark):
    from orrery.llm.rules import quality_rules

    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = quality_rules(docs).join(labels, "doc_id").where("not base_failed").toPandas()
    assert got.kept[got.quality == 1].mean() > 0.999 and got.kept[got.quality == 0].mean() < 0.6


def test_distance_is_that_of_its_formula():
    from orrery.llm.rules import distance

    p, q = np.array([0.5, 0.5, 0]), np.array([0.25, 0.25, 0.5])
    m = (p + q) / 2
    js = 0.5 * sum(x * np.log2(x / y) for x, y in zip(p, m) if x) + 0.5 * sum(x * np.log2(x / y) for x, y in zip(q, m) if x)
    assert distance(np.array([[10, 10, 0], [0, 0, 0]]), np.array([[1, 1, 2], [1, 1, 2.0]])) == pytest.approx([np.sqrt(js), 0])


# op10
def test_bpe_equals_the_library(spark, odd):
    import base64

    import public_tokenizers as P
    import tiktoken

    from orrery.llm.bpe import bpe_round_trip, coder

    path = P.path("byte_bpe_multi_50k.tiktoken")
    raw = open(path, "rb").read()
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}, special_tokens={})
    expected = []
    for i, t in odd:
        ids = library.encode_ordinary(t or "")
        expected.append((i, len(ids), plain.sha(",".join(map(str, ids))), plain.sha(t or "")))
    same_rows(bpe_round_trip(table(spark, odd), path, P.PATTERN), ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"], expected)
    bpe, r = coder(raw, P.PATTERN), random.Random(6)
    for _ in range(200):
        text = "".join(r.choice(["the", "ing", "a", "ß", "éa", "  ", "\n", "12", "!", "日本", "🙂", "'s"]) for _ in range(r.randint(0, 200)))
        ids = bpe.encode(text)
        assert ids == library.encode_ordinary(text) and bpe.decode(ids) == text.encode()
    for text in ("z" * 4000, "abcdefghij" * 500):  # single pieces, too long for a matrix
        assert bpe.encode(text) == library.encode_ordinary(text)


# all
def test_empty_tables(spark):
    from orrery.llm import bpe, decontaminate, licenses, lines, quality, rules, setsketch, substrings, suffixes, toxicity
    import public_tokenizers as P

    none = table(spark, [(1, "x")]).where("doc_id < 0")
    labels = spark.createDataFrame([], "doc_id LONG, toxic INT")
    bench = spark.createDataFrame([], "item_id LONG, text STRING")
    some = table(spark, [(1, "some words of a text")])
    for df, n in ((none, 0), (some, 1)):
        for got in (
            suffixes.drop_repeats(df), decontaminate.contamination_report(df, bench), toxicity.toxicity_scores(df, labels), setsketch.near_duplicates(df), quality.quality_scores(df),
            substrings.drop_substrings(df), lines.line_report(df), licenses.license_scan(df), rules.quality_rules(df), bpe.bpe_round_trip(df, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN),
        ):
            assert got.count() == n


def test_components_of_long_paths(spark):
    from orrery.llm.components import components

    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 90), (90, 95), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a LONG, b LONG")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 90: 90, 95: 90, 100: 90}
