"""Line, exact and near deduplication, repeated strings: Spark against brute force over all rows."""

import hashlib
import random
import re
import weakref
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarrylint.llm import components, exact_dedup, line_dedup, near_dedup, packing, suffix_dedup
from tests_llm_helpers import order  # noqa: E402

SPACE = re.compile("[\x20\x09-\x0d]+")


def test_lines_against_brute_force(docs, rows):
    holders = {}
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            key = line.strip(" \t\n\r\x0b\x0c").translate({c: c + 32 for c in range(65, 91)})
            if len(key) >= 10:
                holders.setdefault(key, []).append(order(doc_id))
    shared = {}
    for key, ids in holders.items():
        shared[key] = min(ids)
    counted = {}
    for doc_id, text in rows:  # a row is a document
        for key in {line.strip(" \t\n\r\x0b\x0c").translate({c: c + 32 for c in range(65, 91)}) for line in (text or "").split("\n")}:
            counted[key] = counted.get(key, 0) + 1

    def answer(doc_id, text):
        lines = (text or "").split("\n")
        keys = [line.strip(" \t\n\r\x0b\x0c").translate({c: c + 32 for c in range(65, 91)}) for line in lines]
        left = [
            line for line, key in zip(lines, keys)
            if len(key) < 10 or counted[key] < 2 or shared[key] == order(doc_id)
        ]
        return doc_id, len(lines), len(lines) - len(left), "\n".join(left)

    got = sorted(map(tuple, line_dedup.dedup_lines(docs).collect()), key=repr)
    assert got == sorted((answer(*row) for row in rows), key=repr)


def test_exact_against_brute_force(docs, rows):
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(SPACE.sub(" ", text or ""), []).append(order(doc_id))
    found = exact_dedup.deduplicate(docs).rows.collect()
    want = sorted(
        (order(doc_id), hashlib.sha256(SPACE.sub(" ", text or "").encode()).hexdigest(),
         min(groups[SPACE.sub(" ", text or "")]), len(groups[SPACE.sub(" ", text or "")]))
        for doc_id, text in rows
    )
    assert sorted((order(r.id), r.digest, order(r.keep_id), r.group_size) for r in found) == want
    assert sum(r.kept for r in found) == len(groups)
    assert all(order(r.id) == order(r.keep_id) for r in found if r.kept)
    kept = exact_dedup.kept_documents(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)


def test_exact_state_goes_on_with_new_rows(spark, tmp_path):
    source, state = str(tmp_path / "in"), str(tmp_path / "state")
    for texts, numbers in (({1: "a", 2: "b", 3: "a"}, {1: 2, 2: 1}), ({0: "a", 4: "c"}, {0: 3, 2: 1, 4: 1})):
        frame = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
        exact_dedup.arrivals(frame).write.mode("append").parquet(source)
        schema = spark.read.parquet(source).schema
        now = exact_dedup.consume(spark.readStream.schema(schema).parquet(source), state)
        assert {r.keep_id: r.group_size for r in now.collect()} == numbers


def test_exact_regroups_different_texts_of_one_digest(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup.F, "sha2", lambda column, bits: F.lit("same"))
    frame = spark.createDataFrame([(3, "b"), (1, "a"), (2, "b"), (None, "a")], "doc_id bigint, text string")
    found = {r.id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.deduplicate(frame).rows.collect()}
    assert found == {1: (1, 2, True), None: (1, 2, False), 2: (2, 2, True), 3: (2, 2, False)}


def shingles(text):
    words = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = [w for w in SPACE.split(words) if w]
    return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()


def linked_components(rows):
    sets = [shingles(text) for _, text in rows]
    by = {}
    for number, each in enumerate(sets):
        if each:
            by.setdefault(each, []).append(number)
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for same in by.values():
        for other in same[1:]:
            parent[find(other)] = find(same[0])
    distinct = list(by)
    for a, left in enumerate(distinct):
        for right in distinct[:a]:
            shared = len(left & right)
            if 100 * shared >= 75 * (len(left) + len(right) - shared):
                parent[find(by[left][0])] = find(by[right][0])
    groups = {}
    for number, (doc_id, _) in enumerate(rows):
        groups.setdefault(find(number), []).append(order(doc_id))
    return sorted(
        (order(doc_id), len(sets[n]), min(groups[find(n)]), min(groups[find(n)]) == order(doc_id))
        for n, (doc_id, _) in enumerate(rows)
    )


def test_near_against_brute_force(docs, rows):
    found = near_dedup.near_duplicates(docs)
    assert sorted((order(r.id), r.n_shingles, order(r.component_id), r.kept) for r in found.collect()) == linked_components(rows)
    assert {r.id for r in found.where("id IS NULL OR component_id IS NULL").collect()} == {None}
    kept = near_dedup.kept_documents(docs)
    assert kept.columns == docs.columns


@pytest.mark.parametrize("block", [100, 200_000])
def test_near_keeps_links_that_stars_miss(spark, monkeypatch, block):
    """Texts drifting apart by one word each, so that most are not like the smallest one of a bucket."""
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    draw = random.Random(3)
    words, rows = [f"w{draw.randrange(10**6)}" for _ in range(60)], []
    for doc_id in range(70):
        words[draw.randrange(60)] = f"v{doc_id}"
        rows.append((doc_id, " ".join(words)))
    rows += [(100 + k, " ".join(draw.choice("abc") for _ in range(k % 9))) for k in range(60)]
    draw.shuffle(rows)
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = near_dedup.near_duplicates(frame).collect()
    assert sorted((r.id, r.n_shingles, r.component_id, r.kept) for r in found) == linked_components(rows)


def test_near_finds_planted_pairs(spark):
    """Pairs at a similarity of 0.75 to 0.8, small sets among them, all of which have to be found."""
    draw = random.Random(9)
    rows = []
    for n in range(4000):
        size = draw.choice([7, 8, 11, 16, 40]) if n % 2 else draw.randrange(30, 90)
        words = [f"p{n}x{k}" for k in range(size)]
        shared = size - 4
        extra = shared // 3  # more shingles on one side, so that shared / (shared + extra) is 0.75 or just above
        rows += [(2 * n, " ".join(words)), (2 * n + 1, " ".join([*words, *(f"q{n}x{k}" for k in range(extra))]))]
    draw.shuffle(rows)
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = {r.id: r.component_id for r in near_dedup.near_duplicates(frame).collect()}
    assert found == {doc_id: doc_id // 2 * 2 for doc_id, _ in rows}


def test_near_loses_nothing_in_a_crowded_bucket(spark):
    """Copies of one text, each changed in many places: some are like the first, some like others only, some alone."""
    draw = random.Random(21)
    base, rows = [f"b{k}" for k in range(150)], []
    for doc_id in range(400):
        words = list(base)
        for _ in range(draw.randrange(12)):
            words[draw.randrange(150)] = f"c{draw.randrange(10**6)}"
        rows.append((doc_id, " ".join(words)))
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = near_dedup.near_duplicates(frame).collect()
    assert sorted((r.id, r.n_shingles, r.component_id, r.kept) for r in found) == linked_components(rows)


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(n, n + 1) for n in range(50)] + [(60, 61), (61, 60), (5, 5)], "u bigint, v bigint")
    found = {r.node: r.component for r in components.components(links).collect()}
    assert found == {**dict.fromkeys(range(51), 0), 60: 60, 61: 60}


def removed(rows, length):
    seen, answers, given = set(), [], set()
    for doc_id, text in sorted(rows, key=lambda row: order(row[0])):
        content = (text or "").encode()
        covered = bytearray(len(content))
        again = (doc_id, content) in given
        given.add((doc_id, content))
        if again:  # a repeated row is the same document
            answers.append(next(a for a in answers if a[0] == doc_id and a[4] == content)[:4] + (content,))
            continue
        for start in range(len(content) - length + 1):
            window = content[start : start + length]
            if window in seen:
                covered[start : start + length] = b"\1" * length
            seen.add(window)
        left = bytes(byte for byte, gone in zip(content, covered) if not gone)
        spans = len([part for part in bytes(covered).split(b"\0") if part])
        answers.append((doc_id, len(content) - len(left), spans, left, content))
    return sorted(((a[0], len(a[4]), *a[1:4]) for a in answers), key=repr)


def test_repeats_against_brute_force(docs, rows):
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.remove_repeats(docs).collect()]
    assert sorted(got, key=repr) == removed(rows, 100)


@pytest.mark.parametrize("large", [4096, 2])
def test_repeats_in_texts_of_two_letters(spark, monkeypatch, large):
    monkeypatch.setattr(suffix_dedup, "LARGE", large)
    draw = random.Random(large)
    base = "".join(draw.choice("ab") for _ in range(60))
    rows = [(n, "".join(draw.choice("ab") for _ in range(draw.randrange(70)))) for n in range(60)]
    rows += [(100 + n, base[n:] + draw.choice("abc") + base[:n]) for n in range(20)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7)
    found = suffix_dedup.remove_repeats(frame, length=12, gram=4).collect()
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in found]
    assert sorted(got, key=repr) == removed(rows, 12)


def test_texts_without_identifier_whose_short_hashes_are_equal(spark):
    """Two different ones, of which a hash of 32 bits would make one document."""
    texts = spark.range(300_000).select(F.concat_ws(" ", *(F.md5(F.concat(F.lit(f"{k} "), "id")) for k in range(4))).alias("text"))
    twins = texts.groupBy(F.hash("text")).agg(F.collect_list("text").alias("texts")).where(F.size("texts") == 2)
    pair = twins.first().texts
    rows = [(None, pair[0]), (None, pair[1]), (None, pair[1]), (5, "x" + pair[0])]
    found = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in found), key=repr)
    assert got == removed(rows, 100)
    assert sorted(r.n_removed for r in found) == [0, 0, 0, len(pair[0])]


def test_segments_overlap_by_less_than_a_string(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(suffix_dedup, "SEGMENT", 150)
    text = bytes(range(250)) * 3
    parts = list(suffix_dedup.segments(list(pa.array([text, b"", b"short"], pa.binary())), 100))
    starts = [at for data, piece, origin in parts for at in range(len(data) - 99)]
    assert len(starts) == len(text) - 99


@pytest.mark.parametrize(
    "operator",
    [line_dedup.dedup_lines, exact_dedup.kept_documents, near_dedup.near_duplicates, suffix_dedup.remove_repeats],
)
def test_empty_table(no_docs, operator):
    assert operator(no_docs).collect() == []


def _alone(make):
    """Batches, each of which has to be gone before the next one is asked for."""
    last = None
    for _ in range(3):
        assert last is None or last() is None
        batch = make()
        last = weakref.ref(batch)
        yield batch
        del batch


def test_tasks_hold_one_batch_of_texts_at_a_time(monkeypatch):
    monkeypatch.setattr(packing.TaskContext, "get", classmethod(lambda cls: SimpleNamespace(partitionId=lambda: 0)))
    ids, texts = pa.array([1, 2]), pa.array([b"one two three four five six", b""])
    numbers = pa.array([[1, 2], [3]], pa.list_(pa.uint64())).to_pylist()
    sets = pa.array([np.array(each, dtype=np.uint64).tobytes() for each in numbers])
    tasks = [
        (near_dedup.sketches, {"id": ids, "body": ids, "content": texts}),
        (near_dedup.full_sets, {"node": ids, "content": texts}),
        (near_dedup.compared(75), {"u": ids, "v": ids, "left": sets, "right": sets}),
        (packing.cut_pieces(public_tokenizers.path("word_bpe_49k.json"), 4096, 1, False), {"doc_id": ids, "content": texts}),
    ]
    for task, columns in tasks:
        found = [batch.num_rows for batch in task(_alone(lambda: pa.RecordBatch.from_pydict(columns)))]  # noqa: B023
        assert found == [2, 2, 2]
