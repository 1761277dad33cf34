"""Quality and toxicity: held-out accuracy on the test tables, and odd rows."""

import os
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from clausework.llm import quality, toxicity

FOLDER = "/root/testdata/sf0.01"
needs_tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables not present")
SCHEMA = "doc_id long, text string, score string, label string, held_out int"


def auc(score, label):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(len(score))
    good = label == 1
    return (rank[good].mean() - (good.sum() - 1) / 2) / (~good).sum()


def held_out(spark, rows, label, folds, fold):
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == fold)
        assert 0 <= r.score <= 1
    rows = [r for r in rows if r.held_out and r.doc_id in labels]
    return np.array([r.score for r in rows]), np.array([labels[r.doc_id] for r in rows])


@needs_tables
def test_quality_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.score(docs, quality.fit(docs, labels)).collect()
    assert len(rows) == docs.count() and all(r.predicted == (r.score >= 0.7) for r in rows)
    score, label = held_out(spark, rows, "quality", 4, 2)
    assert auc(score, label) > 0.93
    assert (score[label == 1] >= 0.7).mean() > 0.93 and (score[label == 0] >= 0.7).mean() < 0.2


@needs_tables
def test_held_out_labels_are_not_used(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.limit(150).cache()
    turned = labels.selectExpr(
        "doc_id", "if(crc32(cast(doc_id as string)) % 4 = 2, 1 - quality, quality) AS quality",
        "if(crc32(cast(doc_id as string)) % 5 = 0, 1 - toxic, toxic) AS toxic")
    for part in (quality, toxicity):
        a, b = (part.score(docs, part.fit(docs, known)).orderBy("doc_id").collect() for known in (labels, turned))
        assert [r.score for r in a] == pytest.approx([r.score for r in b], abs=1e-9)


def invented(n=600):
    """Ordinary words, and every fifth text with a bad word or two."""
    rng = np.random.default_rng(3)
    syllables = ["ta", "re", "mi", "so", "lu", "ve", "no", "ki", "pa", "do"]
    word = lambda: "".join(rng.choice(syllables, rng.integers(1, 4)))
    rows = []
    for i in range(n):
        words = [word() for _ in range(rng.integers(20, 200))]
        toxic = int(rng.random() < 0.25)
        for _ in range(3 * toxic):
            words[rng.integers(len(words))] = rng.choice(["zglurkh", "Bwxof!", "qquump"])
        rows.append((i, " ".join(words), toxic))
    return rows


def test_toxicity_on_held_out_rows(spark):
    rows = invented(1500)
    docs = spark.createDataFrame([(i, t, "c", "c", 1) for i, t, _ in rows], SCHEMA)
    labels = spark.createDataFrame([(i, x) for i, _, x in rows], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()}
    held = [(got[i], x) for i, _, x in rows if got[i].held_out]
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    hit = [r.predicted for r, x in held if x]
    false = [r.predicted for r, x in held if not x]
    assert np.mean(hit) > 0.95 and np.mean(false) < 0.02


def test_many_mild_words_are_evidence(spark):
    """Toxic texts use the same words as ordinary ones, some of them oftener; no word reaches a level."""
    rng = np.random.default_rng(4)
    pools = ["tarem sovel kimon dupal".split(), "besur galit honep wixor".split()]
    rows = []
    for i in range(1500):
        toxic = int(rng.random() < 0.3)
        words = [rng.choice(pools[int(rng.random() < (0.35 if toxic else 0.65))]) for _ in range(rng.integers(60, 200))]
        rows.append((i, " ".join(words), toxic))
    docs = spark.createDataFrame([(i, t, "c", "c", 1) for i, t, _ in rows], SCHEMA)
    model = toxicity.fit(docs, spark.createDataFrame([(i, x) for i, _, x in rows], "doc_id long, toxic int"))
    assert np.abs(np.subtract(*model.letters([*pools[0], *pools[1]]).T)).max() < 2
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    held = [(got[i], x) for i, _, x in rows if got[i].held_out]
    assert np.mean([r.predicted for r, x in held if x]) > 0.9 > 0.1 > np.mean([r.predicted for r, x in held if not x])


def test_phrases_of_ordinary_words_are_evidence(spark):
    """Both classes have the same words; only which of them follow one another differs, across line ends too."""
    rng = np.random.default_rng(6)
    words = "tarem sovel kimon dupal besur galit".split()
    rows = []
    for i in range(1200):
        toxic = int(rng.random() < 0.3)
        pairs = [(words[j], words[(j + (1 if toxic else 2)) % 6]) for j in rng.integers(6, size=40)]
        rows.append((i, "".join(f"{a}{rng.choice([' ', chr(10), '  '])}{b} x{rng.integers(9)} " for a, b in pairs), toxic))
    docs = spark.createDataFrame([(i, t, "c", "c", 1) for i, t, _ in rows], SCHEMA)
    got = {r.doc_id: r for r in toxicity.score(docs, toxicity.fit(docs, spark.createDataFrame([(i, x) for i, _, x in rows], "doc_id long, toxic int"))).collect()}
    held = [(got[i], x) for i, _, x in rows if got[i].held_out]
    assert np.mean([r.predicted for r, x in held if x]) > 0.95 and np.mean([r.predicted for r, x in held if not x]) < 0.05


TOXIC, ORDINARY = ["bad egg bad", "Egg! bad egg"], ["abra arab egg", "bar abra\nabra bar", "arab egg bad", ""]


def by_hand(word, before, kind):
    """Probability of a word after another by the definition, from counts of plain strings."""
    texts = {"toxic": TOXIC, "ordinary": ORDINARY}
    clean = {k: [[w.strip("!").lower() for w in t.split()] for t in ts] for k, ts in texts.items()}
    every = [w for ts in clean.values() for t in ts for w in t]
    mine = [w for t in clean[kind] for w in t]
    lead = "_" * 6
    shared = {(lead + w + "$")[i - 3:i + 1] for w in every for i in range(6, 7 + len(w))}

    def letter(row, i):
        kinds = len({g for g in shared if g[1:] == row[i - 2:i + 1]})
        total = len({g for g in shared if g[1:3] == row[i - 2:i]})
        p = (kinds + 1 / 64) / (total + 1)
        for order in (3, 5, 7):
            grams = [(lead + w + "$")[j - order + 1:j + 1] for w in mine for j in range(6, 7 + len(w))]
            context, gram = row[i - order + 1:i], row[i - order + 1:i + 1]
            seen = sum(g[:-1] == context for g in grams)
            if seen:
                p = (max(grams.count(gram) - 0.75, 0) + 0.75 * len({g for g in grams if g[:-1] == context}) * p) / seen
        return p

    p = np.prod([letter(lead + word + "$", i) for i in range(6, 7 + len(word))])
    pairs = {k: [pair for t in ts for pair in zip(t, t[1:])] for k, ts in clean.items()}
    kept = {pair for pair in pairs["toxic"] + pairs["ordinary"] if pairs["toxic"].count(pair) + pairs["ordinary"].count(pair) >= 2}
    seen = sum(a == before for a, _ in pairs[kind])
    if before is None or not seen:
        return p
    own = {b: max(pairs[kind].count((a, b)) - 0.75, 0) / seen for a, b in kept if a == before}
    return own.get(word, 0) + (1 - sum(own.values())) * p


def test_features_equal_a_hand_made_model(spark):
    rows = [(i, t, int(t in TOXIC)) for i, t in zip([1, 2, 3, 4, 5, 7], [*TOXIC, *ORDINARY])]
    assert all(zlib.crc32(str(i).encode()) % 5 not in (toxicity.HELD_OUT, toxicity.CURVE_FOLD) for i, _, _ in rows)
    docs = spark.createDataFrame([(i, t, "c", "c", 1) for i, t, _ in rows], SCHEMA)
    model = toxicity.fit(docs, spark.createDataFrame([(i, x) for i, _, x in rows], "doc_id long, toxic int"))
    texts = ["bad egg", "egg bad egg abra zebra. bad", "abra", "", None, "  Egg! ", "arab egg bad egg arab egg egg bra"]
    import pyarrow as pa

    got = toxicity.Scorer(model).features(pa.array(texts))
    for text, found in zip(texts, got, strict=True):
        words = [w.strip("!.").lower() for w in (text or "").split()]
        difference = [np.log(by_hand(w, v, "toxic") / by_hand(w, v, "ordinary")) for v, w in zip([None, *words], words)]
        size = [len(w) + 1 for w in words]
        ends = range(min(4, len(words)), len(words) + 1)
        passages = [sum(difference[max(0, e - 4):e]) / sum(size[max(0, e - 4):e]) for e in ends if words]
        want = [sum(difference) / sum(size), max(passages)] if words else [0, 0]
        assert found == pytest.approx(want, abs=1e-9), text


def test_letters_of_a_class_sum_to_one():
    """Over all letters that may follow a context, with the rest of the 64 as unseen ones."""
    from collections import Counter

    words = ["abra", "abba", "arab", "bar", "bab"]
    gram, end, middle = toxicity.shared_grams(words)
    table, contexts = {}, {}
    for which, some in enumerate((["bra", "bra", "ab"], words)):
        for grams, context, count in toxicity.count_grams(Counter(some)):
            for g, c, n in zip(grams.tolist(), context.tolist(), count.tolist(), strict=True):
                table.setdefault(g, [c, 0, 0])[1 + which] += n
    for c, a, b in table.values():
        entry = contexts.setdefault(c, [0, 0, 0, 0])
        for k, v in enumerate((a, b, a > 0, b > 0)):
            entry[k] += v

    def arrays(pairs):
        keys = np.array(sorted(pairs), np.uint64)
        return keys, np.array([pairs[k] for k in sorted(pairs)])

    keys, numbers = arrays(contexts)
    model = toxicity.Model(*arrays({g: v[1:] for g, v in table.items()}), keys, numbers[:, :2], numbers[:, 2:],
                           *arrays(dict(Counter(end.tolist()))), *arrays(dict(Counter(middle.tolist()))))
    assert np.isfinite(model.letters(["abra", "zzz", "", "é"])).all()
    # The end, 26 letters and 37 signs that nothing was seen of: 64 that may follow.
    signs = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0x100, 0x125)))
    for prefix in ("", "a", "ab", "zz"):
        ends = np.exp(model.letters([prefix]))[0]
        # The probability of a prefix is that of all words that start with it.
        total = sum(np.exp(_start(model, prefix + c)) for c in signs) + ends
        assert total == pytest.approx(np.exp(_start(model, prefix)), rel=1e-9)


def _start(model, prefix):
    """Log-probabilities that a word starts with ``prefix``: all of its letters, without an end."""
    if not prefix:
        return np.zeros(2)
    codes, at = toxicity._letters([prefix])
    held = toxicity._letters
    toxicity._letters = lambda words: (codes, at[:-1]) if words == [prefix] else held(words)
    lengths = toxicity._word_lengths
    toxicity._word_lengths = lambda c, a: np.array([len(a)])
    try:
        return model.letters([prefix])[0]
    finally:
        toxicity._letters, toxicity._word_lengths = held, lengths


ODD = [(None, "no id at all", "c", "c", 1), (1, None, "c", "c", 1), (2, "", "c", "c", 1), (3, " \n ", "c", "c", 1), (4, "word " * 60_000, "c", "c", 1),
       (5, "same", "c", "c", 1), (5, "same", "c", "c", 1), (6, "é\U0001f600 \x00 ...", "c", "c", 1)]


@pytest.mark.parametrize("part", [quality, toxicity])
@pytest.mark.parametrize("known", [[], [(4, 1)], [(4, 1), (5, 0), (5, 1), (6, None), (None, 1), (1, 0)]], ids=["none", "one", "odd"])
def test_odd_rows_and_labels(spark, part, known):
    docs = spark.createDataFrame(ODD, SCHEMA)
    labels = spark.createDataFrame([(i, x, x) for i, x in known], "doc_id long, quality int, toxic int")
    rows = part.score(docs, part.fit(docs, labels)).collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(r[0]) for r in ODD)
    assert all(0 <= r.score <= 1 for r in rows)
    if not known:
        assert {r.score for r in rows} == {0.5}
    none = spark.createDataFrame([], SCHEMA)
    assert part.score(none, part.fit(none, labels)).count() == 0


def test_good_documents_keep_their_columns(spark):
    docs = spark.createDataFrame(ODD, SCHEMA)
    model = quality.fit(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert quality.good_documents(docs, model, threshold=0.5).count() == len(ODD)
    left = quality.good_documents(docs, model, threshold=0.6)
    assert left.count() == 0 and left.columns == docs.columns


def test_the_sample_has_one_row_per_id(spark):
    rows = [(7, f"copy {i % 5}", "c", "c", 1) for i in range(900)] + [(8, None, "c", "c", 1), (9, "other", "c", "c", 1)]
    labels = spark.createDataFrame([(7, 1), (7, 0), (8, 0), (9, 0), (10, 1)], "doc_id long, quality int")
    samples = []
    for some in (rows, rows[::-1]):
        docs = spark.createDataFrame(some, SCHEMA).repartition(3)
        sample = toxicity.labelled(docs, labels, "doc_id", "text", "quality", F.lit(True), 10).collect()
        samples.append(sorted((r.doc_id, r.label, r.text) for r in sample))
    assert samples[0] == samples[1] and [r[:2] for r in samples[0]] == [(7, 1), (8, 0), (9, 0)]
    assert samples[0][0][2].startswith("copy") and samples[0][1][2] is None
    model = quality.fit(spark.createDataFrame(rows, SCHEMA), labels)
    assert len(model.labels) <= 3


def test_document_frequencies_cover_all_documents(spark):
    """A word of every unlabelled document weighs little, though no labelled one has it."""
    rows = [(i, f"labelled w{i}" if i < 8 else "common text", "c", "c", 1) for i in range(200)] + [(None, None, "c", "c", 1)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    model = quality.fit(docs, spark.createDataFrame([(i, i % 2) for i in range(8)], "doc_id long, quality int"))
    of = lambda word: model.weights[quality._term_pair(word) >> 16]
    assert of("common") == pytest.approx(1 + np.log(202 / 193), abs=1e-5)
    assert of("labelled") == pytest.approx(1 + np.log(202 / 9), abs=1e-5)
