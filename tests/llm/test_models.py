import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from barvault.llm import quality, rolling, toxicity
from tests.llm.helpers import AWKWARD, SF_DIR, collected, documents, needs_tables, random_texts, with_clashes

LABELS = "doc_id bigint, quality int, toxic int"


def labels(spark, rows):
    return spark.createDataFrame(rows, LABELS)


def test_tokens_and_substring_hashes():
    import re

    text = "Ab, cd!! é\x0bx1 … ab".encode()
    letters = np.frombuffer(text, np.uint8)
    start, end = rolling.tokens(letters, marks=True)
    assert [text[a:b] for a, b in zip(start, end)] == re.findall(rb"[0-9A-Za-z\x80-\xff]+|[^\s0-9A-Za-z\x80-\xff]+", text)
    sums = rolling.prefixes(rolling.lowered(letters))
    hashes = rolling.span_hash(sums, start, end)
    assert hashes[0] == hashes[-1] and len(set(hashes.tolist())) == len(hashes) - 1
    assert rolling.window_hash(sums, 2)[0] == hashes[0]


def test_pieces_lose_nothing():
    text = " ".join(random_texts(1, 50)).encode()
    assert b"".join(rolling.pieces(text, 37)) == text
    whole = np.sort(np.concatenate(list(quality.features(text))))
    pieces = rolling.pieces.__defaults__
    rolling.pieces.__defaults__ = (37,)
    try:
        assert np.array_equal(np.sort(np.concatenate(list(quality.features(text)))), whole)
    finally:
        rolling.pieces.__defaults__ = pieces


def test_counts_and_weights_are_those_of_plain_loops(spark):
    rows = list(enumerate(random_texts(2, 60)))
    good = {i for i, _ in rows if i % 3 == 0}
    docs = documents(spark, rows).withColumn("good", F.col("doc_id") % 3 == 0)
    counts = quality.count_features(docs, F.col("text"), F.col("good"), 256)
    raw, target = np.zeros(256), np.zeros(256)
    each = {i: np.concatenate(list(quality.features(t.encode(), 256)) or [np.empty(0, int)]) for i, t in rows}
    for i, found in each.items():
        raw += np.bincount(found, minlength=256)
        target += np.bincount(found, minlength=256) * (i in good)
    got = {r["bucket"]: (r["raw"], r["target"]) for r in counts.collect()}
    assert got == {b: (raw[b], target[b]) for b in np.flatnonzero(raw)}
    ratios = quality.log_ratios(*quality.models(counts, 256), prior=2.0)
    share = (raw + 1) / (raw + 1).sum()
    wanted = target + 2.0 * target.sum() * share
    assert ratios == pytest.approx(np.log(wanted / wanted.sum()) - np.log(share))
    weights = docs.select("doc_id", quality.importance(F.col("text"), ratios).alias("w")).collect()
    for row in weights:
        found = each[row["doc_id"]]
        assert row["w"] == pytest.approx(ratios[found].sum() * min(1, 100 / max(1, len(found))))
    targets = docs.where("good").select(F.col("doc_id").alias("_target"), F.col("text").alias("_text"))
    unseen = []
    for i in good:
        others = sum(np.bincount(each[j], minlength=256) for j in good if j != i)
        ratios = np.log((others / others.sum() + 2.0 * share) / 3.0 / share)
        unseen.append(ratios[each[i]].sum() * min(1, 100 / max(1, len(each[i]))))
    assert quality.least_weight(targets, *quality.models(counts, 256), 2.0, 0.0) == pytest.approx(min(unseen))
    assert quality.least_weight(targets, *quality.models(counts, 256), 2.0, 0.5) == pytest.approx(np.median(unseen))
    assert quality.least_weight(targets.limit(0), share, target, 2.0, 0.5) is None


def test_the_k_largest_perturbed_weights_are_selected(spark):
    rows = [(i, t + " junk !!" * (40 if i % 5 == 0 else 0)) for i, t in enumerate(random_texts(3, 200, 60))]
    marked = labels(spark, [(i, int(i % 5 != 0), 0) for i in range(0, 200, 2)])
    docs = documents(spark, rows)
    found = quality.resample(docs, marked).toPandas().sort_values("perturbed", ascending=False)
    k = int(found["selected"].sum())
    assert found["selected"].tolist() == [True] * k + [False] * (200 - k)
    junk = found["key"] % 5 == 0
    assert not found[junk]["selected"].any() and found[~junk]["selected"].mean() > 0.95
    again = quality.resample(docs.repartition(5), marked).toPandas().sort_values("perturbed", ascending=False)
    assert again["key"].tolist() == found["key"].tolist()


@needs_tables
@pytest.mark.parametrize(("share", "kept", "junk"), [(5, 0.85, 0.5), (15, 0.94, 0.1), (50, 0.98, 0.05)])
def test_quality_with_few_labels(spark, share, kept, junk):
    """Held-out labels, with production parameters; 5 % are some 20 good documents, on which the cut depends much."""
    path = SF_DIR.replace("0.001", "0.01")
    docs, marked = (spark.read.parquet(f"{path}/{t}.parquet") for t in ("documents", "labels"))
    known = F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(100)) < share
    chosen = quality.resample(docs, marked.where(known))
    held = chosen.join(marked.where(~known), F.col("key") == F.col("doc_id")).toPandas()
    assert held[held.quality == 1].selected.mean() >= kept and held[held.quality == 0].selected.mean() <= junk


def test_quality_of_awkward_rows(spark):
    marked = labels(spark, [(1, 1, 0), (2, 1, 0), (2, 0, 0), (None, 1, 0), (7, None, None)])
    docs = with_clashes(documents(spark, AWKWARD))
    found = quality.resample(docs, with_clashes(marked)).collect()
    assert len(found) == len(AWKWARD) and all(r["log_weight"] is not None and r["perturbed"] is not None for r in found)
    assert {r["log_weight"] for r in found if r["key"] in (3, 4, 5)} == {0.0}
    assert quality.resample(documents(spark, []), marked).count() == 0
    unlabelled = quality.resample(documents(spark, AWKWARD), labels(spark, [])).collect()
    assert all(r["selected"] and r["log_weight"] == 0 for r in unlabelled)


def biased(spark, count=400):
    """Insults are toxic; the word muslim stands in most toxic texts and in few others."""
    r = random.Random(4)
    rows, marks = [], []
    for i in range(count):
        toxic = i % 4 == 0
        words = random_texts(1000 + i, 1, 30, 60)[0].split() or ["x"]
        if toxic and i % 8 == 0:
            words.insert(r.randrange(len(words)), r.choice(["insultone", "insulttwo", "insultthree"]))
        if r.random() < (0.9 if toxic else 0.02):
            words.insert(r.randrange(len(words)), "Muslim")
        rows.append((i, " ".join(words)))
        marks.append((i, 1, int(toxic)))
    return documents(spark, rows), labels(spark, marks)


def test_counterfactual_penalty_spares_neutral_mentions(spark):
    docs, marked = biased(spark)
    neutral = documents(spark, [(1, "my muslim neighbour"), (2, "my jewish neighbour"), (3, "a hindu and a muslim")])
    scores = {}
    for penalty in (0.0, 100.0):
        model = toxicity.train_model(docs, marked, counterfactual=penalty, ridge=0.1)
        scores[penalty] = {r["doc_id"]: r["s"] for r in neutral.select("doc_id", model.score(F.col("text")).alias("s")).collect()}
        insult = documents(spark, [(1, "you insultone there")]).select(model.score(F.col("text")).alias("s")).first()["s"]
        assert insult > 0.7
    assert scores[0.0][1] > 0.7 and scores[0.0][1] - scores[0.0][2] > 0.4
    assert scores[100.0][1] < 0.5 and abs(scores[100.0][1] - scores[100.0][2]) < 0.05


def plain_words(text):
    import re

    return [bytes(w).lower() for w in re.findall(rb"[0-9A-Za-z\x80-\xff]+", (text or "").encode())]


def plain_features(words):
    """(size of the stem or 0, letters) of every word."""
    return {(0, w) for w in words} | {(n, w[:n]) for w in words for n in (5, 6, 7, 8) if len(w) > n}


def hashed(features):
    """Feature hashes by the definition of the rolling hash: of the letters, plus the size of a stem."""
    out = {}
    for size, word in features:
        letters = np.frombuffer(word, np.uint8)
        whole = rolling.span_hash(rolling.prefixes(letters), np.array([0]), np.array([len(letters)]))[0]
        out[(int(whole) + size) % 2**64] = (size, word)
    return out


TERMED = ["A Muslim and a christian, Christmas!", "musl muslims jewish", "the WOMAN", "", None, "nothing here", "Frauen männer frau"]


def test_word_features_and_swaps_are_those_of_plain_loops(monkeypatch):
    monkeypatch.setattr(rolling.pieces, "__defaults__", (64,))
    nexts = {
        t.encode(): group[(i + 1) % len(group)].encode() for group in toxicity.IDENTITY_TERMS for i, t in enumerate(group)
    }
    for text in [*TERMED, *random_texts(5, 30, 60), " ".join(TERMED[:3] * 20)]:
        data, words = None if text is None else text.encode(), plain_words(text)
        got = set(np.concatenate([*toxicity.word_features(data), np.empty(0, np.uint64)]).tolist())
        assert got == set(hashed(plain_features(words)))
        other = toxicity.swapped(data)
        if not any(w in nexts for w in words):
            assert other is None
        else:
            assert set(other.tolist()) == set(hashed(plain_features([nexts.get(w, w) for w in words])))


def test_telling_words_and_scores_are_those_of_plain_loops(spark):
    docs, marked = biased(spark)
    model = toxicity.train_model(docs, marked, counterfactual=10.0)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    each = {i: plain_features(plain_words(t)) for i, t in texts.items()}
    toxic = [i for i in texts if i % 4 == 0]
    times, all_times = {}, {}
    for i, found in each.items():
        for f in found:
            all_times[f] = all_times.get(f, 0) + 1
            times[f] = times.get(f, 0) + (i % 4 == 0)
    telling = set()
    for f, n in times.items():
        if n < toxicity.LEAST_POSITIVES:
            continue
        bad, good = n + 0.5, all_times[f] - n + 0.5
        odds = np.log(bad / (len(toxic) + 1)) - np.log(good / (len(texts) - len(toxic) + 1))
        if odds - toxicity.LEAST_Z * np.sqrt(1 / bad + 1 / good) > 0:
            telling.add(f)
    weights = dict(zip(model.hashes.tolist(), model.weights, strict=True))
    names = hashed(telling)
    assert telling and set(weights) == set(names)

    def plain_score(words):
        there = plain_features(words)
        return 1 / (1 + np.exp(-(model.bias + sum(w for h, w in weights.items() if names[h] in there))))

    asked = documents(spark, list(enumerate([*TERMED, *list(texts.values())[:60]])))
    nexts = {t.encode(): g[(i + 1) % len(g)].encode() for g in toxicity.IDENTITY_TERMS for i, t in enumerate(g)}
    for r in asked.select("text", model.score(F.col("text")).alias("s"), model.gap(F.col("text")).alias("g")).collect():
        words = plain_words(r["text"])
        assert r["s"] == pytest.approx(plain_score(words))
        assert r["g"] == pytest.approx(abs(plain_score([nexts.get(w, w) for w in words]) - r["s"]), abs=1e-12)


def gap_of_injected_terms(spark, folder, counterfactual):
    """Mean gap over held-out texts with an identity term put in, by a model whose training texts are biased by it.

    The given texts have no identity terms. Most toxic training texts and few others get one here; whether a term
    stands in a held-out text depends on nothing.
    """
    docs, marked = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    held = toxicity.held_out("doc_id")
    joined = docs.select("doc_id", "text").join(marked, "doc_id")
    draw = F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(100))
    mention = F.when(draw < F.when(F.col("toxic") == 1, 80).otherwise(2), F.concat(F.lit("Muslim "), "text"))
    training = joined.where(~held).withColumn("text", F.coalesce(mention, F.col("text")))
    model = toxicity.train_model(training.select("doc_id", "text"), marked, counterfactual=counterfactual)
    neutral = joined.where(held & (F.col("toxic") == 0)).select(F.concat(F.lit("Muslim "), "text").alias("text"))
    flagged = (model.score(F.col("text")) >= toxicity.THRESHOLD).cast("int")
    return neutral.agg(F.avg(model.gap(F.col("text"))), F.avg(flagged)).first()


@needs_tables
def test_gap_of_terms_put_into_held_out_texts(spark):
    folder = SF_DIR.replace("0.001", "0.01")
    free, tied = (gap_of_injected_terms(spark, folder, c) for c in (0.0, toxicity.COUNTERFACTUAL))
    print("gap, share flagged: without the penalty", tuple(free), "with it", tuple(tied))
    assert free[0] > 0.05 and tied[0] < free[0] / 4 and tied[1] <= free[1]


def test_fit_minimises_its_loss():
    r = np.random.default_rng(2)
    own = [np.flatnonzero(r.random(6) < 0.4).astype("<i4") for _ in range(80)]
    changed = [np.array([1, -2], "<i4") if i % 4 == 0 else np.empty(0, "<i4") for i in range(80)]
    toxic = np.array([float(len(o) > 2) for o in own])

    def loss(w):
        margin = np.array([w[o].sum() for o in own]) + w[-1]
        shift = np.array([w[0] - w[1] if len(c) else 0.0 for c in changed])
        return np.logaddexp(0, margin).sum() - toxic @ margin + 0.15 * (w[:-1] @ w[:-1]) + 2.0 * np.square(shift).sum()

    w = toxicity.fit(toxic, own, changed, 6, 0.3, 4.0)
    for _ in range(200):
        assert loss(w) <= loss(w + r.normal(0, 0.01, 7)) + 1e-9


def test_toxicity_of_awkward_rows(spark):
    docs = with_clashes(documents(spark, AWKWARD))
    marked = labels(spark, [(1, 1, 0), (2, 1, 1), (2, 1, 0), (None, 1, 1), (9, None, None), (8, 0, 1)])
    found = toxicity.score_toxicity(docs, with_clashes(marked)).collect()
    assert len(found) == len(AWKWARD) and all(0 <= r["score"] <= 1 for r in found)
    assert all(r["predicted"] == int(r["score"] >= 0.7) for r in found)
    assert toxicity.score_toxicity(documents(spark, []), marked).count() == 0
    alone = toxicity.score_toxicity(documents(spark, AWKWARD), labels(spark, [])).collect()
    assert {r["score"] for r in alone} == {0.5}


def test_held_out_labels_do_not_matter(spark):
    import zlib

    docs, marked = biased(spark, 200)
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    other = marked.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    columns = "doc_id", "held_out", "score", "predicted"
    first = collected(toxicity.score_toxicity(docs, marked), *columns)
    assert first == collected(toxicity.score_toxicity(docs, other), *columns)
    assert all(r[1] == (zlib.crc32(str(r[0]).encode()) % 3 == 1) for r in first)


def trained_on(monkeypatch, docs, marked, **options):
    """The model, and how many labels and how many positive ones its fit saw."""
    seen, fit = [], toxicity.fit

    def watched(labels, *others):
        seen.append((len(labels), int(labels.sum())))
        return fit(labels, *others)

    monkeypatch.setattr(toxicity, "fit", watched)
    model = toxicity.train_model(docs, marked, **options)
    monkeypatch.setattr(toxicity, "fit", fit)
    return model, seen[0]


def test_the_training_bound_holds_for_rows(spark, monkeypatch):
    docs, marked = biased(spark, 200)
    once, seen = trained_on(monkeypatch, docs, marked, rows=120)
    assert seen[0] == 120
    text = docs.where("doc_id = 8").first()["text"]
    # a labelled document that is a large part of the table, once as equal rows, once as different texts
    equal = docs.union(documents(spark, [(8, text)] * 400))
    again, seen_again = trained_on(monkeypatch, equal, marked, rows=120)
    assert seen_again == seen and np.array_equal(again.hashes, once.hashes) and again.bias == pytest.approx(once.bias)
    assert again.weights == pytest.approx(once.weights)
    different = docs.union(documents(spark, [(8, f"{text} {i}") for i in range(400)]))
    _, many = trained_on(monkeypatch, different, marked, rows=120)
    assert many == seen
    # further texts of a key fill what room the others leave
    assert trained_on(monkeypatch, different, marked, rows=210)[1] == (210, 60)


@needs_tables
def test_held_out_accuracy(spark):
    """On the tables at hand: rank held-out toxic texts above others, and select the good ones."""
    path = SF_DIR.replace("0.001", "0.01")
    docs, marked = (spark.read.parquet(f"{path}/{t}.parquet") for t in ("documents", "labels"))
    scored = toxicity.score_toxicity(docs, marked).join(marked, "doc_id").where("held_out").toPandas()
    bad, good = scored[scored.toxic == 1].score, scored[scored.toxic == 0].score
    above = np.sign(bad.values[:, None] - good.values[None, :])
    assert 0.5 + above.mean() / 2 > 0.85 and (good >= 0.7).mean() < 0.03
    chosen = quality.resample(docs, marked).join(marked, F.col("key") == F.col("doc_id")).toPandas()
    assert chosen[chosen.quality == 1].selected.mean() > 0.97 and chosen[chosen.quality == 0].selected.mean() < 0.1
