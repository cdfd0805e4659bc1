"""Quality, toxicity, language model, packing, mixing and chats: Spark against brute force."""

import collections
import gc
import itertools
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quarrylint.llm import chat_collapse, katz, mixing, packing, robust_outliers, text_stats, toxicity
from quarrylint.llm.word_ids import WordIds

FILE = public_tokenizers.path("word_bpe_49k.json")
SMALL = "/root/testdata/sf0.001"


# Quality rules


def counts_of(text):
    words = (text or "").encode().split()
    lines = [line for line in (text or "").split("\n") if line.encode().strip()]
    windows = collections.Counter(zip(words, words[1:], words[2:]))
    covered = {k + j for k in range(len(words) - 2) for j in range(3) if windows[tuple(words[k : k + 3])] > 1}
    return (
        len(words), sum(len(w.decode()) for w in words), sum((text or "").count(c) for c in "#*$%&|<>"),
        len(lines) - len(set(lines)), len(covered),
    )


def test_counts_and_base_rule(docs, rows):
    found = robust_outliers.quality(docs).collect()
    got = [(r.doc_id, *(r[name] for name in text_stats.COUNTS), r.base_failed) for r in found]
    want = []
    for doc_id, text in rows:
        n = counts_of(text)
        want.append((doc_id, *n, n[0] < 50 or 100 * n[4] > 50 * n[0]))
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert not any(r.kept for r in found if r.base_failed)


def test_window_numbers_of_many_words():
    ids = np.array([0, 1 << 40, 5, 0, 1 << 40, 5, 7])
    found = text_stats.window_numbers(ids, 3)
    assert found[0] == found[3] and len(set(found.tolist())) == 4


def plain_mcd(x):
    """The estimate of one group without bins: (mean, covariance with floors)."""
    floors = np.array(list(robust_outliers.FLOORS.values()))
    low, middle, high = (np.quantile(x, q, axis=0, method="inverted_cdf") for q in (0.25, 0.5, 0.75))
    scale = np.maximum((high - low) / 1.349, floors)
    z = np.cov(np.tanh((x - middle) / scale).T, bias=True)
    spread = np.sqrt(np.maximum(np.diag(z), 1e-12))
    tied = z / np.outer(spread, spread) * np.outer(scale, scale)
    np.fill_diagonal(tied, scale**2)
    best = None
    for covariance in (np.diag(scale**2), tied + np.diag(floors**2)):
        mean = middle
        for _ in range(robust_outliers.STEPS):
            d = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(covariance), x - mean)
            near = x[d <= np.sort(d)[math.ceil(len(d) * robust_outliers.SUBSET) - 1]]
            mean = near.mean(axis=0)
            covariance = np.cov(near.T, bias=True) * robust_outliers.consistency(0.75) + np.diag(floors**2)
        if best is None or np.linalg.slogdet(covariance)[1] < best[0]:
            best = np.linalg.slogdet(covariance)[1], mean, covariance
    _, mean, covariance = best
    d = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(covariance), x - mean)
    near = x[d <= robust_outliers.chi_square_quantile(0.975, robust_outliers.P)]
    return near.mean(axis=0), np.cov(near.T, bias=True) * robust_outliers.consistency(0.975) + np.diag(floors**2)


def test_estimates_against_brute_force(spark):
    draw = np.random.default_rng(1)
    rows, away = [], {}
    for source, size in (("a", 900), ("b", 300)):
        x = draw.normal(1, [0.1, 0.02, 0.03, 0.2, 0.2], size=(size, 5))
        x[: size // 10] += 3
        mean, covariance = plain_mcd(x)
        away[source] = np.sqrt(np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(covariance), x - mean))
        rows += [("l", source, *map(float, row), (100, 0), n) for n, row in enumerate(x)]
    ddl = "lang string, source string, x0 double, x1 double, x2 double, x3 double, x4 double, "
    frame = spark.createDataFrame(rows, ddl + "s struct<n_words: bigint, n_repeat_words: bigint>, n int")
    found = robust_outliers.judged(frame, robust_outliers.mcd_estimates(frame)).collect()
    for row in found:
        assert row.distance == pytest.approx(away[row.source][row.n], rel=0.05, abs=0.1)
        assert row.kept == (row.n >= (90 if row.source == "a" else 30))


VECTOR_DDL = "lang string, source string, x0 double, x1 double, x2 double, x3 double, x4 double, "


@pytest.mark.parametrize("few", [True, False])
def test_small_groups_are_judged_by_a_wider_estimate(spark, monkeypatch, few):
    if not few:
        monkeypatch.setattr(robust_outliers, "BROADCAST_GROUPS", 0)
        monkeypatch.setattr(robust_outliers, "HEAVY_GROUPS", 2)
    draw = np.random.default_rng(2)
    groups = [("big", "a", 400), ("big", "b", 99), ("one", "a", 1), ("twenty", "a", 20), ("last", "a", 99)]
    rows, vectors = [], collections.defaultdict(list)
    for lang, source, size in groups:
        x = draw.normal(1, [0.1, 0.02, 0.03, 0.2, 0.2], size=(size, 5))
        x[0] += 3
        for level in {(lang, source), (lang,), ()}:
            vectors[level].append(x)
        rows += [(lang, source, *map(float, row), (100, 0), n) for n, row in enumerate(x)]
    frame = spark.createDataFrame(rows, VECTOR_DDL + "s struct<n_words: bigint, n_repeat_words: bigint>, n int")
    found = robust_outliers.judged(frame, robust_outliers.mcd_estimates(frame)).collect()
    assert len(found) == len(rows)
    level = {("big", "a"): ("big", "a"), ("big", "b"): ("big",)}
    for row in found:
        mean, covariance = plain_mcd(np.concatenate(vectors[level.get((row.lang, row.source), ())]))
        x = np.array([row[f"x{k}"] for k in range(5)]) - mean
        assert row.distance == pytest.approx(math.sqrt(x @ np.linalg.inv(covariance) @ x), rel=0.05, abs=0.1)
        assert row.kept == (row.n > 0)


def test_rows_that_the_base_rule_rejects_do_not_widen_estimates(spark):
    draw = np.random.default_rng(3)
    good = draw.normal(1, [0.1, 0.02, 0.03, 0.2, 0.2], size=(300, 5))
    good[0] += 1
    junk = draw.normal(2, [0.5, 0.5, 0.5, 0.5, 0.5], size=(300, 5))
    rows = [("l", "a", *map(float, x), (100, 0), n) for n, x in enumerate(good)]
    rows += [("l", "a", *map(float, x), (100, 90), 300 + n) for n, x in enumerate(junk)]
    rows += [("l", "junk", *map(float, x), (10, 0), 600 + n) for n, x in enumerate(junk)]
    frame = spark.createDataFrame(rows, VECTOR_DDL + "s struct<n_words: bigint, n_repeat_words: bigint>, n int")
    found = robust_outliers.judged(frame, robust_outliers.mcd_estimates(frame)).collect()
    mean, covariance = plain_mcd(good)
    for row in found:
        x = np.array([row[f"x{k}"] for k in range(5)]) - mean
        assert row.distance == pytest.approx(math.sqrt(x @ np.linalg.inv(covariance) @ x), rel=0.05, abs=0.1)
        assert row.kept == (0 < row.n < 300)


def test_steps_go_on_until_the_determinant_settles(spark, monkeypatch):
    # A quarter and more lies off by little, so that steps move the estimate slowly.
    draw = np.random.default_rng(4)
    x = draw.normal(1, 0.1, size=(600, 5))
    x[:200] += np.linspace(0, 1, 200)[:, None]
    frame = spark.createDataFrame(
        [("l", "a", *map(float, row), (100, 0)) for row in x],
        VECTOR_DDL + "s struct<n_words: bigint, n_repeat_words: bigint>",
    )
    taken = []
    step = robust_outliers._concentrated
    monkeypatch.setattr(robust_outliers, "_concentrated", lambda *a: taken.append(1) or step(*a))
    monkeypatch.setattr(robust_outliers, "STEPS", 1)
    few = robust_outliers.mcd_estimates(frame).where("rows = 600").first()
    assert len(taken) > 1
    monkeypatch.setattr(robust_outliers, "STEPS", 12)
    many = robust_outliers.mcd_estimates(frame).where("rows = 600").first()
    assert few.mean == pytest.approx(many.mean, abs=0.01)


def test_every_text_with_words_has_a_distance(docs):
    found = robust_outliers.quality(docs).collect()
    assert all((r.distance is None) == (r.n_words == 0) for r in found)


def test_chi_square():
    assert robust_outliers.chi_square_quantile(0.95, 5) == pytest.approx(11.0705, abs=1e-3)
    assert robust_outliers.consistency(0.999999) == pytest.approx(1, abs=1e-3)


# Packing


def test_ids_of_pieces_and_places(docs, rows):
    packed = packing.pack(docs, FILE, capacity=300, with_ids=True).toPandas()
    tokenizer = Tokenizer.from_file(FILE)
    texts = collections.Counter(
        tuple([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]) for _, text in rows
    )
    assert (packed.ids.map(zlib.crc32) == packed.ids_crc32).all()
    assert (packed.ids.map(len) == 4 * packed.length).all() and packed.start.eq(packed.piece * 300).all()
    single = collections.Counter(tuple(np.frombuffer(ids, "<u4").tolist()) for ids in packed.ids)
    want = collections.Counter()
    for ids, times in texts.items():
        for at in range(0, len(ids), 300):
            want[ids[at : at + 300]] += times
    assert single == want
    placed = packed.sort_values(["sequence_id", "offset"])
    before = placed.groupby("sequence_id").length.cumsum() - placed.length
    assert (before == placed.offset).all() and placed.groupby("sequence_id").length.sum().max() <= 300


def test_sequences_hold_the_ids(docs):
    packed = packing.pack(docs.limit(20), FILE, capacity=64, with_ids=True).persist()
    whole = packing.sequences(packed).toPandas()
    assert whole.ids.map(len).sum() == 4 * packed.agg(F.sum("length")).first()[0]
    assert whole.ids.map(len).max() <= 4 * 64


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("aBé'ÀΣß1 ,.|<>\n\t ́日st"), max_size=40))
def test_words_remembered_or_not(text):
    encoder = WordIds(FILE, room=3)
    whole = encoder.tokenizer.encode(text, add_special_tokens=False).ids
    for _ in range(2):
        assert np.frombuffer(encoder.of(text.encode()), "<u4").tolist() == whole


def fewest(items, capacity):
    """Bins of a best packing, by trying all."""
    best = len(items)

    def fill(at, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if at == len(items):
            best = len(rooms)
            return
        for k in {room: k for k, room in enumerate(rooms) if room >= items[at]}.values():
            fill(at + 1, [room - items[at] * (j == k) for j, room in enumerate(rooms)])
        fill(at + 1, [*rooms, capacity - items[at]])

    fill(0, [])
    return best


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 12), min_size=1, max_size=8))
def test_reduction_keeps_the_optimum(items):
    lengths = packing.Lengths(dict(collections.Counter(items)))
    fixed = packing.reduced(lengths, 12)
    rest = [size for size in lengths.sizes for _ in range(lengths.counts[size])]
    taken = collections.Counter(rest)
    for pattern, times in fixed:
        assert sum(size * number for size, number in pattern) <= 12
        taken.update({size: number * times for size, number in pattern})
    assert taken == collections.Counter(items)
    assert sum(times for _, times in fixed) + fewest(sorted(rest, reverse=True), 12) == fewest(sorted(items, reverse=True), 12)


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 50), min_size=1, max_size=20))
def test_plan_places_every_rank_once(counts):
    plan = packing.packing_plan(counts, 40)
    places = collections.defaultdict(list)
    ends = {**{k: n for k, n in counts.items()}}
    for (size, rank, number, offset, sequence), after in zip(plan, [*plan[1:], (0,) * 5]):
        stop = after[1] if after[0] == size else ends[size]
        for r in range(rank, stop):
            step = r - rank
            places[sequence + step // number].append((offset + step % number * size, size))
    assert sum(map(len, places.values())) == sum(counts.values())
    for pieces in places.values():
        at = 0
        for offset, size in sorted(pieces):
            assert offset == at
            at += size
        assert at <= 40


# Toxicity


def all_segments(scores):
    """Ruzzo and Tompa by their definition: the best segment, then the same left and right of it."""
    best, found = 0.0, None
    for start, stop in itertools.combinations(range(len(scores) + 1), 2):
        total = sum(scores[start:stop])
        if total > best or total == best and found and start >= found[0] and stop - start < found[1] - found[0]:
            best, found = total, (start, stop)
    if found is None or best <= 0:
        return []
    start, stop = found
    right = [(a + stop, b + stop, s) for a, b, s in all_segments(scores[stop:])]
    return all_segments(scores[:start]) + [(start, stop, best)] + right


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(-5, 5), max_size=12))
def test_segments_against_definition(scores):
    found = toxicity.segments(np.array(scores, dtype=float))
    assert [round(s) for *_, s in found] == [s for *_, s in all_segments(scores)]
    assert all(sum(scores[a:b]) == round(s) for a, b, s in found)


def test_scores_against_brute_force(spark):
    draw = random.Random(6)
    plain, vile = ["kind", "kindly", "stones", "stoned", "sun", "été"], ["vile", "vileness", "idiot", "idiots", "rot", "rotten"]
    texts = {}
    for n in range(120):
        share = 0.6 if n % 4 == 0 else 0.1
        texts[n] = " ".join(draw.choice(vile if draw.random() < share else plain) for _ in range(draw.randrange(1, 15)))
    texts |= {120: None, 121: "", 122: "?!", 123: "Idiotic KINDNESS unheard"}
    labelled = [(n, int(n % 4 == 0)) for n in range(80)] + [(1, 1), (2, None), (None, 1), (999, 1), (122, 0)]
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(5)
    model = toxicity.fit(docs, spark.createDataFrame(labelled, "doc_id bigint, toxic int"))

    words_in = {n: re.findall(r"\w+", (text or "").lower()) for n, text in texts.items()}
    label = {}
    for n, toxic in labelled:
        if toxic is not None and n in texts:
            label[n] = max(toxic, label.get(n, 0))
    found = collections.defaultdict(lambda: [0, 0])
    for n, toxic in label.items():
        for term in {(w, False) for w in words_in[n]} | {(w[:4], True) for w in words_in[n]}:
            found[term][not toxic] += 1
    found = {term: pair for term, pair in found.items() if sum(pair) >= toxicity.LEAST_DOCS}
    base = sum(label.values()) / len(label)

    def share(term, prior):
        toxic, other = found[term]
        return (toxic + 10 * prior) / (toxic + other + 10)

    scores = {}
    for term in found:
        word, is_stem = term
        odds = share(term, base if is_stem else share((word[:4], True), base))
        scores[term] = math.log(odds / (1 - odds)) - math.log(base / (1 - base)) - toxicity.MARGIN
    often = {term: pair[1] for term, pair in found.items()}
    for (word, is_stem), pair in found.items():
        if not is_stem:
            often[word[:4], True] -= pair[1]
    often = {term: max(n, 0) for term, n in often.items()}
    low, high = 1e-3, 64.0
    for _ in range(100):
        middle = (low + high) / 2
        above = sum(n * math.exp(middle * scores[term]) for term, n in often.items()) > sum(often.values())
        low, high = (low, middle) if above else (middle, high)
    assert model.weights.rate == pytest.approx(low)

    def scored(words):
        values = [scores.get((w, False), scores.get((w[:4], True), -toxicity.MARGIN)) for w in words]
        return [s for *_, s in all_segments(values)]

    parts = {n: scored(words) for n, words in words_in.items()}
    best = [low * max(parts[n], default=0) - math.log(len(words_in[n])) for n, toxic in label.items() if not toxic and words_in[n]]
    log_k = sum(best) / len(best) - np.euler_gamma
    assert model.log_k == pytest.approx(log_k)
    x = {
        n: math.log1p(sum(max(low * s - math.log(len(words_in[n])) - log_k, 0) for s in parts[n])) for n in texts
    }
    curve = lambda at: 1 / (1 + math.exp(-(model.slope * at + model.intercept)))
    # The logistic curve is the best one: at the maximum of the likelihood with its prior, slopes vanish.
    missed = {n: toxic - curve(round(x[n], 2)) for n, toxic in label.items() if words_in[n]}
    assert sum(missed.values()) == pytest.approx(0.1 * model.intercept, abs=1e-6)
    assert sum(m * round(x[n], 2) for n, m in missed.items()) == pytest.approx(0.1 * model.slope, abs=1e-6)
    got = {r.doc_id: r.score for r in model.scored(docs).collect()}
    assert got == pytest.approx({n: curve(at) for n, at in x.items()})
    assert len({round(v, 6) for v in got.values()}) > 20


def test_toxic_texts_are_found_in_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    model = toxicity.fit(docs.where(~held_out), labels)
    scored = model.scored(docs.where(held_out)).join(labels, "doc_id").toPandas()
    said = scored.score >= 0.7
    assert (said == (scored.toxic == 1)).mean() > 0.95 and said[scored.toxic == 1].mean() > 0.8


def test_awkward_texts_have_a_score(docs, no_docs, spark):
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, None), (None, 1), (3, 1), (4, 0)], "doc_id bigint, toxic int")
    model = toxicity.fit(docs, labels)
    found = model.scored(docs).collect()
    assert len(found) == docs.count() and all(0 <= r.score <= 1 for r in found)
    lowest = min(r.score for r in found)
    assert all(r.score == lowest for r in found if r.n_tokens == 0)
    assert model.scored(no_docs).collect() == []
    unlearned = toxicity.fit(no_docs, labels.where("false"))
    assert len(unlearned.scored(docs).collect()) == docs.count()


# Language model


def katz_by_hand(train, texts, order):
    top = katz.TOP
    grams = [collections.defaultdict(collections.Counter) for _ in range(order)]
    for t in train:
        padded = [None] * order + t
        for at, w in enumerate(t, order):
            for n in range(order):
                grams[n][tuple(padded[at - n : at])][w] += 1
    count = grams[0][()]

    def discounts(counts):
        n = collections.Counter(counts)
        rest = (top + 1) * n[top + 1] / n[1] if n[1] else 0
        f = [((r + 1) * n[r + 1] / (r * n[r]) - rest) / (1 - rest) if n[r] and rest != 1 else 0 for r in range(1, top + 1)]
        return f if all(0 < v < 1 for v in f) else [(r - 0.5) / r for r in range(1, top + 1)]

    def chances(counts, f):
        left = sum(c * (1 - f[c - 1]) for c in counts.values() if c <= top)
        scale = sum(counts.values()) + (0 if left else 1)
        return {w: c * (f[c - 1] if c <= top else 1) / scale for w, c in counts.items()}, (left or 1) / scale

    factors = [discounts([c for m in after.values() for c in m.values()]) for after in grams]
    words, unknown = chances(count, factors[0])
    model = [{} for _ in grams]

    def chance(h, w):
        if not h:
            return words.get(w, unknown)
        seen, alpha = model[len(h)].get(h, ({}, 1.0))
        return seen[w] if w in seen else alpha * chance(h[1:], w)

    for n in range(1, order):
        for h, m in grams[n].items():
            seen, left = chances(m, factors[n])
            model[n][h] = seen, left / (1 - sum(chance(h[1:], w) for w in m))
        for h in list(model[n])[:20]:
            assert sum(chance(h, w) for w in [*words, "unknown"]) == pytest.approx(1)

    def score(t):
        padded = [None] * order + t
        return sum(math.log10(chance(tuple(padded[at - order + 1 : at]), w)) for at, w in enumerate(t, order))

    n, v = sum(count.values()), len(count)
    base = [sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t) for t in texts]
    return [(len(t), sum(w in count for w in t), b, score(t)) for t, b in zip(texts, base)], n


@pytest.mark.parametrize("part_tokens, order", [(3000, 2), (1_000_000, 2), (3000, 3), (1_000_000, 4), (3000, 1)])
def test_katz_against_brute_force(docs, rows, monkeypatch, part_tokens, order):
    monkeypatch.setattr(katz, "PART_TOKENS", part_tokens)
    tokens = [[*(text or "").encode().lower().split(), b"\n"] for _, text in rows]
    learn = [doc_id is not None and zlib.crc32(str(doc_id).encode()) % 10 != 0 for doc_id, _ in rows]
    want, total = katz_by_hand([t for t, own in zip(tokens, learn) if own], tokens, order)
    learned = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 10 != 0, F.lit(False))
    found = katz.katz_scores(docs, learned, order=order).collect()
    assert {r.train_tokens for r in found} == {total}
    key = lambda row: (row[0] is None, row[0] or 0, row[2])
    got = sorted(((r.doc_id, r.learned, r.n_tokens, r.n_known, r.base_score, r.score) for r in found), key=key)
    wanted = sorted(((row[0], own, *w) for row, own, w in zip(rows, learn, want)), key=key)
    assert [g[:4] for g in got] == [w[:4] for w in wanted]
    assert np.array([g[4:] for g in got]) == pytest.approx(np.array([w[4:] for w in wanted]), rel=1e-6)


def test_counts_beyond_32_bits():
    """A word and a pair seen more than 2^32 times, in two parts of one bucket."""
    often = 3 << 31
    packed = lambda *values: katz._pack(np.array(values, dtype=np.int64))
    asked = [
        {"bucket": 4, "part": n, "histories": np.array([7, 9 + n], dtype=np.uint64).tobytes(), "counts": packed(often + n, n)}
        for n in (0, 1)
    ]
    told = katz.total_words(pa.Table.from_batches([katz._rows(asked, katz.ASKED)])).to_pylist()
    assert [katz._unpack(row["totals"], np.int64).tolist() for row in told[1:]] == [[2 * often + 1, 0], [2 * often + 1, 1]]
    assert [katz._unpack(row["seen"], np.int64).tolist() for row in told] == [[3], [0, 1], [0, 2]]
    assert np.frombuffer(told[0]["totals"], dtype=np.int64)[:2].tolist() == [2 * often + 2, 2]
    pairs = [
        {"bucket": 4, "part": n, "histories": packed(5), "followers": packed(2), "words": packed(0, 1 + n),
         "shorter": packed(often, often), "counts": packed(often + n, 1)}
        for n in (0, 1)
    ]
    words = katz.Words.of(np.array([4 * often, 3, 0, 0, 0, 0, 0, 0]))
    told = katz.total_grams(words)(pa.Table.from_batches([katz._rows(pairs, katz.ASKED)])).to_pylist()
    assert [katz._unpack(row["totals"], np.int64).tolist() for row in told[1:]] == [[2 * often + 1, 1]] * 2
    assert [katz._unpack(row["seen"], np.int64).tolist() for row in told[1:]] == [[2 * often + 3]] * 2


def test_katz_of_empty_tables(docs, no_docs):
    assert katz.katz_scores(no_docs, F.lit(True)).collect() == []
    assert katz.katz_scores(no_docs, F.lit(True), order=3).collect() == []
    assert all(r.n_known == r.score == 0 for r in katz.katz_scores(docs, F.lit(False), order=3).collect())
    with pytest.raises(ValueError):
        katz.katz_scores(docs, F.lit(True), order=0)


# Mixing


def test_mix_reaches_the_weights(spark):
    draw = random.Random(2)
    rows = [(n, " ".join("w" * 3 for _ in range(draw.randrange(1, 60))), "big" if n % 10 < 7 else f"s{n % 10}", n) for n in range(4000)]
    rows += [(5000, None, None, 1), (5001, "", "void", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, epoch int").repartition(6)
    mixed = mixing.mix(docs, target_entropy=1.0, repetition_limit=3.0, block_docs=32).toPandas()
    tokens = collections.Counter()
    for _, text, source, _ in rows:
        tokens[source] += len((text or "").split())
    times = mixed.doc.map(lambda d: d["doc_id"]).value_counts()
    assert set(times.index) == {row[0] for row in rows}  # without a budget every document is in the mix
    got = collections.Counter()
    for doc, n in zip(mixed.doc, mixed.tokens):
        got[doc["source"]] += n
    most = max(tokens.values())
    real = {s: n for s, n in tokens.items() if n}
    exponent = max(0.0, 1 - math.log(3.0) / math.log(most / min(real.values())))
    for source, n in real.items():
        share = most * (n / most) ** exponent
        assert share - 60 <= got[source] <= share + 1, source
        assert max(times[row[0]] for row in rows if row[2] == source) <= 3
    first = mixed[mixed["at"] < 0.5].groupby(mixed.doc.map(lambda d: d["source"])).tokens.sum()
    assert abs(first["big"] / first.sum() - got["big"] / sum(got.values())) < 0.05


def mix_by_hand(spark, rows, target, limit, budget, block_docs):
    """``rows``: identifier, source, tokens, order. Gives identifier, pass, block, place and weight of each visit."""
    groups = collections.defaultdict(list)
    for row in rows:
        groups[row[1]].append(row)
    tokens = {s: sum(row[2] for row in group) for s, group in groups.items()}
    real = {s: n for s, n in tokens.items() if n}

    def weights(exponent):
        raw = {s: n**exponent for s, n in real.items()}
        return {s: w / sum(raw.values()) for s, w in raw.items()}

    def mixed(w):
        return budget if budget is not None else max(real[s] / w[s] for s in real)

    def last(holds):
        """The largest exponent for which ``holds``, which it does up to some point."""
        low, high = 0.0, 1.0
        if holds(high):
            return high
        for _ in range(60):
            middle = (low + high) / 2
            low, high = (middle, high) if holds(middle) else (low, middle)
        return low

    exponent = max(
        last(lambda e: -sum(w * math.log(w) for w in weights(e).values()) >= target * math.log(len(real))),
        last(lambda e: max(w / real[s] for s, w in weights(e).items()) * mixed(weights(e)) > limit),
    )
    weight = weights(exponent)
    size = min(mixed(weight), limit * min(real[s] / w for s, w in weight.items()))
    visits = []
    for s, group in groups.items():
        blocks, share = collections.defaultdict(list), round(weight.get(s, 0) * size)
        for row in group:
            blocks[row[3] % -(-len(group) // block_docs)].append(row)
        passes = -(-share // tokens[s]) if tokens[s] else 1
        visits += [(s, epoch, block, content, share) for epoch in range(passes) for block, content in blocks.items()]
    keys = spark.createDataFrame([v[:3] for v in visits], "s string, e bigint, b bigint")
    turn = {tuple(r)[:3]: r.turn for r in keys.select("*", F.xxhash64(F.lit(0), "s", "e", "b").alias("turn")).collect()}
    out, used = [], collections.Counter()
    for s, epoch, block, content, share in sorted(visits, key=lambda v: (v[0], v[1], turn[v[:3]], v[2])):
        at = used[s] / share if share else 0.0
        left = share - used[s]
        used[s] += sum(row[2] for row in content)
        if not tokens[s] or left > 0:
            for order in sorted({row[3] for row in content}):
                alike = [row for row in content if row[3] == order]
                left -= sum(row[2] for row in alike)
                if tokens[s] and left < 0:
                    break
                out += [(row[0], epoch, block, round(at, 9), round(weight.get(s, 0.0), 9)) for row in alike]
    return sorted(out)


@pytest.mark.parametrize("target, limit, budget", [(1.0, 3.0, None), (0.9, 50.0, None), (0.7, 2.0, 20_000.0), (1.0, 1.0, 1e9)])
def test_mix_against_brute_force(spark, target, limit, budget):
    draw = random.Random(9)
    rows = [
        (n, " ".join("w" * draw.randrange(1, 60)), "big" if n % 10 < 7 else f"s{n % 10}" if n % 30 else "rare")
        for n in range(1500)
    ]
    rows += [(2000, None, "void"), (2001, "", "void"), (3, rows[3][1], rows[3][2])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(6)
    orders = mixing.measured(docs, "doc_id", "text", "source", 0).select("doc.doc_id", "_source", "_tokens", "_order").collect()
    want = mix_by_hand(spark, [tuple(row) for row in orders], target, limit, budget, 16)
    mixed = mixing.mix(docs, target_entropy=target, repetition_limit=limit, budget=budget, block_docs=16)
    got = mixed.select("doc.doc_id", "epoch", "block", F.round("at", 9), F.round("weight", 9)).collect()
    got = sorted(map(tuple, got))
    assert [row[:3] for row in got] == [row[:3] for row in want]
    assert np.array([row[3:] for row in got]) == pytest.approx(np.array([row[3:] for row in want]), abs=1e-6)


def test_mix_of_a_budget_and_of_nothing(spark, docs, no_docs):
    total = docs.select(F.sum(F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")))).first()[0]
    mixed = mixing.mix(docs, target_entropy=0.5, repetition_limit=1.0, budget=float(total // 2), block_docs=8)
    assert 0 < mixed.agg(F.sum("tokens")).first()[0] <= total // 2 + 1
    assert mixing.mix(no_docs).collect() == []


# Chats


def test_snapshots_collapse_to_the_longest(spark):
    rows = [
        (1, 0, "user", "hi", 9), (1, 1, "bot", "yo", 9),
        (2, 0, "user", "hi", 9), (2, 1, "bot", "yo", 9), (2, 2, "user", "and", 9), (2, 2, "user", "and", 9),
        (3, 0, "user", "hi", 9), (3, 1, "bot", "other", 9), (4, 0, "user", "hi", 9), (4, 1, "bot", "other", 9),
        (5, 0, None, None, 9), (6, None, "user", "", 9), (None, 0, "user", "lost", 9),
        (7, 0, "user", "b", 9), (7, 0, "user", "a", 9), (8, 0, "", "userhi", 9),
    ]
    frame = spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string, block int")
    found = {r.conv_id: (r.n_turns, r.copies, r.chat) for r in chat_collapse.rendered(frame).collect()}
    assert found == {
        2: (3, 1, "<|user|>\nhi\n<|bot|>\nyo\n<|user|>\nand\n"), 3: (2, 2, "<|user|>\nhi\n<|bot|>\nother\n"),
        5: (1, 1, "<||>\n\n"), 6: (1, 1, "<|user|>\n\n"), 7: (2, 1, "<|user|>\na\n<|user|>\nb\n"), 8: (1, 1, "<||>\nuserhi\n"),
    }
    assert chat_collapse.rendered(frame.where("conv_id = -1")).collect() == []


def test_blocks_of_turns_do_not_matter(spark, monkeypatch):
    draw = random.Random(4)
    whole = [f"t{n}" for n in range(30)]
    rows = []
    for conv in range(40):
        length = draw.randrange(1, 31)
        branch = draw.choice([length, draw.randrange(length)])
        rows += [(conv, n, "r", whole[n] + ("x" if n >= branch else "")) for n in range(length)]
    frame = spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string")
    answers = []
    for block in (4, 1024):
        monkeypatch.setattr(chat_collapse, "BLOCK_TURNS", block)
        answers.append(sorted(map(tuple, chat_collapse.maximal_conversations(frame).collect())))
    assert answers[0] == answers[1]
    turns = collections.defaultdict(list)
    for conv, _, _, text in rows:
        turns[conv].append(text)
    longest = {c for c, t in turns.items() if not any(len(o) > len(t) and o[: len(t)] == t for o in turns.values())}
    assert {c for c, *_ in answers[0]} == {min(o for o in longest if turns[o] == turns[c]) for c in longest}


def test_a_packing_task_leaves_no_words(spark):
    """What a task has learnt is let go of at its end; the next one of the worker could not use it."""
    rows = spark.createDataFrame([(n, f"w{n} x{n}".encode()) for n in range(200)], "doc_id long, content binary")
    cut = packing.cut_pieces(FILE, 300, 1, False)

    def left(batches):
        n = sum(batch.num_rows for batch in cut(batches))
        words = sum(len(o.words) for o in gc.get_objects() if type(o).__name__ == "WordIds")
        yield pa.RecordBatch.from_pydict({"n": [n], "words": [words]})

    assert rows.repartition(3).mapInArrow(left, "n long, words long").agg(F.sum("n"), F.sum("words")).first() == (200, 0)
