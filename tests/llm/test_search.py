"""Spelling variants, phrases and nearest neighbours: Spark against brute force."""

import collections
import random
import re
import zlib
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarrylint.llm import phrases, spelling, vector_tree

LOWER = {code: code + 32 for code in range(65, 91)}


# Spelling variants


def plain_words(rows, least_chars, least_count, every):
    counts = collections.Counter()
    for doc_id, text in rows:
        for run in re.findall("[a-zÀ-ÿ]+", (text or "").translate(LOWER)):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if every and h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {word: n for word, n in counts.items() if len(word) >= least_chars and n >= least_count}


def plain_variants(counts, times=2):
    near, short = collections.defaultdict(set), collections.defaultdict(set)
    for word in counts:
        for k in range(len(word)):
            short[word[:k] + word[k + 1 :], k, len(word)].add(word)
            other = word[:k] + word[k + 1 :]
            if other in counts:
                near[word].add(other)
                near[other].add(word)
    for group in short.values():
        for word in group:
            near[word] |= group - {word}
    forms = {}
    for word, others in near.items():
        best = min(others, key=lambda other: (-counts[other], other), default=None)
        if best is not None and counts[best] >= times * counts[word]:
            forms[word] = best
    answers = []
    for word, n in counts.items():
        root = word
        while root in forms:
            root = forms[root]
        form = forms.get(word)
        answers.append((word, form, root, n, len(near[word]), counts[form] if form else None))
    return sorted(answers, key=repr)


@pytest.mark.parametrize("least_chars, least_count, every", [(5, 3, 97), (1, 1, 2)])
def test_variants_of_texts(docs, rows, least_chars, least_count, every):
    words = spelling.word_counts(docs, least_chars=least_chars, least_count=least_count, mutate_every=every)
    got = sorted((tuple(r) for r in spelling.variants(words).collect()), key=repr)
    assert got == plain_variants(plain_words(rows, least_chars, least_count, every))


@pytest.mark.parametrize("inner", [1, 50, 100_000])
def test_variants_of_crowded_words(spark, inner):
    """Words of few letters: long chains, repeated letters, every kind of edit; grams short and as long as words."""
    draw = random.Random(inner)
    counts = {}
    while len(counts) < 1500:
        word = "".join(draw.choice("abé") for _ in range(draw.randrange(1, 12)))
        counts[word] = draw.choice([1, 2, 3, 5, 8, 16, 40, 1 << 40])
    words = spark.createDataFrame(list(counts.items()), "word string, n bigint")
    got = sorted((tuple(r) for r in spelling.variants(words, inner=inner).collect()), key=repr)
    assert got == plain_variants(counts)


def test_safe_grams_survive_any_edit():
    draw = random.Random(1)
    words = ["".join(draw.choice("abc") for _ in range(draw.randrange(2, 14))) for _ in range(400)]
    counts, inner, often = collections.Counter(), set(), None
    for size in range(spelling.LEAST, spelling.MOST + 1):
        found = [f"^{word}$"[at : at + size] for word in words for at in range(len(word) + 3 - size)]
        level = collections.Counter(gram for gram in found if often is None or gram[:-1] in often)
        counts.update(level)
        often = {gram for gram, n in level.items() if n > 20}
        inner |= often
    grams = spelling.Grams(counts, inner)
    for word in words[:150]:
        text = f"^{word}$"
        kept = grams.decomposed(text)
        for place in range(1, len(word) + 1):
            ahead, behind = grams.safe_ahead(text, kept, place), grams.safe_behind(text, kept, place + 1)
            for letter in ("", "a", "b", "c"):
                other = text[:place] + letter + text[place + 1 :]
                now = {(start, other[start:stop]) for start, stop in grams.decomposed(other)}
                shift = len(letter) - 1
                assert all((s, text[s:e]) in now for s, e in kept[:ahead])
                assert all((s + shift, text[s:e]) in now for s, e in kept[behind:])


def test_variants_of_nothing(no_docs):
    assert spelling.variants(spelling.word_counts(no_docs)).collect() == []


# Phrases


def plain_phrases(rows, least, top, percent):
    counts, totals = collections.defaultdict(collections.Counter), collections.Counter()
    for text, lang in rows:
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            words = re.findall("[^ \t]+", piece)
            totals[lang or "und"] += len(words)
            for size in range(1, 6):
                counts[lang or "und"].update(tuple(words[k : k + size]) for k in range(len(words) - size + 1))
    answers = []
    for lang, found in counts.items():
        longer = collections.Counter()
        often = {words: n for words, n in found.items() if n >= least}
        for words, n in often.items():
            for size in range(2, len(words)):
                for k in range(len(words) - size + 1):
                    longer[words[k : k + size]] = max(longer[words[k : k + size]], n)
        kept = []
        for words, a in often.items():
            if len(words) > 1 and not (longer[words] and 100 * longer[words] >= percent * a):
                cuts = [(found[words[:k]], found[words[k:]]) for k in range(1, len(words))]
                scores = [1000 * a * totals[lang] // (left * right) for left, right in cuts]
                k = scores.index(min(scores))
                kept.append((-scores[k], -a, " ".join(words).encode(), *cuts[k]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(kept)[:top], 1):
            answers.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(answers)


def texts_of_phrases():
    draw = random.Random(8)
    fixed = ["New York City", "à la carte", "proof of the pudding", "a b", "b c d e f g"]
    rows = []
    for _ in range(300):
        parts = [
            draw.choice(fixed) if draw.random() < 0.4 else draw.choice("a b c the of x y z".split())
            for _ in range(draw.randrange(25))
        ]
        text = "".join(part + draw.choice([" ", " ", "\t", ", ", ".", "\n", "  "]) for part in parts)
        rows.append((text, draw.choice(["en", "en", "en", "fr", None])))
    return rows + [(None, "en"), ("", None), (" . , ", "fr"), ("only one", "de"), ("a b c " * 3000, "xx")]


@pytest.mark.parametrize("least, top, percent", [(3, 2000, 100), (5, 12, 100), (2, 4, 60), (1, 30, 100)])
def test_phrases_against_brute_force(spark, least, top, percent):
    rows = texts_of_phrases()
    frame = spark.createDataFrame(rows, "text string, lang string").withColumn("f", F.lit("clash")).repartition(3)
    found = phrases.phrases(frame, least=least, top=top, percent=percent)
    assert sorted(map(tuple, found.collect())) == plain_phrases(rows, least, top, percent)


def test_phrases_of_texts(docs):
    rows = [(r.text, r.lang) for r in docs.select("text", "lang").collect()]
    assert sorted(map(tuple, phrases.phrases(docs, least=6, top=300).collect())) == plain_phrases(rows, 6, 300, 100)


def test_stretches_of_long_texts(monkeypatch):
    """Cut into stretches of seven words, and counted a few at a time, a text has the same phrases."""
    monkeypatch.setattr(phrases, "CHUNK_WORDS", 7)
    monkeypatch.setattr(phrases, "HELD", 50)
    texts = [(text or "").encode() for text, _ in texts_of_phrases()[:60]] + [b"a b c d e f g h", b"a " * 7, b"a " * 11]
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * len(texts)), pa.array(texts, pa.binary())], names=["lang", "content"])
    full = SimpleNamespace(value=np.full(1 << phrases.MAP_BITS - 3, 255, dtype=np.uint8))
    found, want = collections.Counter(), collections.Counter()
    for part in phrases.count_phrases(range(2, 6), full, full, full)([batch]):
        for lang, phrase, n in zip(*(part[name].to_pylist() for name in ("lang", "phrase", "f"))):
            found[phrase] += n
    for part in phrases.count_words([batch]):
        for phrase, n in zip(part["phrase"].to_pylist(), part["f"].to_pylist()):
            found[phrase] += n
    for text in texts:
        for piece in re.split(b"[.,;:!?\n\x0b\x0c\r]", text.lower()):
            words = re.findall(b"[^ \t]+", piece)
            want.update(b" ".join(words[k : k + size]) for size in range(1, 6) for k in range(len(words) - size + 1))
    assert found == want


def test_crowded_bit_maps_lose_nothing():
    hashes = np.random.default_rng(0).integers(0, 1 << 63, 5000).astype(np.uint64)
    places = phrases._places(hashes)
    bits = np.zeros(1 << phrases.MAP_BITS - 3, dtype=np.uint8)
    np.bitwise_or.at(bits, (places >> np.uint64(3)).astype(np.int64), (1 << (places & np.uint64(7))).astype(np.uint8))
    assert phrases.BitMap(bits).has(hashes).all()


def test_phrases_of_nothing(no_docs):
    assert phrases.phrases(no_docs).collect() == []


# Nearest neighbours

VECTORS = "vec_id bigint, embedding array<float>, label int, v string, key string, n int"


def plain_nearest(rows, every, k):
    def usable(vector):
        return vector is not None and None not in vector and np.isfinite(vector).all() and any(vector)

    of = {}
    for vec_id, vector in rows:
        if vec_id is not None and usable(vector):
            vector = [float(np.float32(x)) for x in vector]
            of[vec_id] = min(of.get(vec_id, vector), vector)
    answers = {}
    for query in (i for i in of if i % every == 0):
        scored = []
        for other, vector in of.items():
            if other != query:
                total = 0.0
                for x, y in zip(of[query], vector):
                    total += x * y
                scored.append((-total, other))
        answers[query] = [(other, -less) for less, other in sorted(scored)[:k]]
    return answers


def answered(found):
    answers = collections.defaultdict(list)
    for r in sorted(found.collect(), key=lambda r: (r.query_id, r["rank"])):
        answers[r.query_id].append((r.vec_id, r.score))
        assert r["rank"] == len(answers[r.query_id])
    return dict(answers)


def framed(spark, rows):
    return spark.createDataFrame([(*row, 0, "v", "k", 1) for row in rows], VECTORS).repartition(4)


def awkward_vectors(draw):
    rows = [(n, [float(draw.randrange(-3, 4)) for _ in range(5)]) for n in range(900)]
    rows += [(1000 + n, [1.0, 2.0, 3.0, -1.0, 0.0]) for n in range(300)]  # many equal ones
    rows += [(2000, None), (2020, []), (2040, [0.0] * 5), (2060, [1.0, None, 1.0, 1.0, 1.0]), (2080, [float("nan")] * 5)]
    rows += [(2100, [float("inf")] * 5), (None, [1.0] * 5), (2120, [3.0, 1.0]), (2121, [2.0]), (40, [9.0] * 5), (60, rows[60][1])]
    return rows


@pytest.mark.parametrize("block", [7, 2048])
def test_neighbours_with_ties(spark, monkeypatch, block):
    """All calibration queries are answered in full, so nothing may be missing; integers tie often."""
    monkeypatch.setattr(vector_tree, "BLOCK", block)
    rows = awkward_vectors(random.Random(4))
    got = answered(vector_tree.nearest(framed(spark, rows), recall=1.0))
    assert got == plain_nearest(rows, 20, 20)


def test_recall_and_scores(spark):
    draw = np.random.default_rng(2)
    centres = draw.normal(size=(30, 24))
    points = centres[draw.integers(0, 30, 4000)] + 0.6 * draw.normal(size=(4000, 24))
    rows = [(n, point.tolist()) for n, point in enumerate(points)]
    got, want = answered(vector_tree.nearest(framed(spark, rows), leaves=16)), plain_nearest(rows, 20, 20)
    assert got.keys() == want.keys() and all(len(hits) == 20 for hits in got.values())
    scores = {query: dict(hits) for query, hits in plain_nearest(rows, 20, 4000).items()}
    assert all(scores[query][other] == score for query, hits in got.items() for other, score in hits)
    found = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert found >= 0.9 * 20 * len(want)


def test_leaves_are_opened_best_bin_first():
    points = np.random.default_rng(5).normal(size=(600, 6))
    tree = vector_tree.Tree(points, 10)
    assert sorted(tree.visits(points[0])) == list(range(tree.leaves))
    assert tree.leaves > 30 and set(tree.leaves_for(points).tolist()) == set(range(tree.leaves))


def test_few_and_no_vectors(spark):
    few = [(n, [1.0, float(n)]) for n in range(5)]
    assert answered(vector_tree.nearest(framed(spark, few))) == plain_nearest(few, 20, 20)
    assert answered(vector_tree.nearest(framed(spark, few[1:]))) == {}
    assert vector_tree.nearest(framed(spark, few).where("vec_id < 0")).collect() == []
