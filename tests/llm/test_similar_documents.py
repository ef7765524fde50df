"""Near-duplicates of the pipeline against the Jaccard similarity of all pairs."""

import random
from pathlib import Path

import numpy as np
import pytest

from tessera.llm import simhash


def plain_set(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def plain_groups(texts):
    sets, label = [plain_set(t) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if label[i] != label[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    return label


def texts_with_copies():
    random.seed(7)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for size in (4, 20, 60, 150, 150):
        base = random.choices(words, k=size)
        for _ in range(40):
            own = list(base)
            for _ in range(random.randint(0, 5)):
                at = random.randrange(len(own))
                own[at : at + 1] = random.choice([[], [random.choice(words)], [random.choice(words), own[at]]])
            texts.append(" ".join(own))
    return texts + ["", "a b", "A  b"]


def test_groups(spark):
    """Groups hold similar texts only, and hold together what is similar."""
    texts = texts_with_copies()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in simhash.similar_documents(spark, docs).collect()}
    want = plain_groups(texts)
    sets = [plain_set(t) for t in texts]
    near = [(i, j) for i in range(len(texts)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    assert all(want[i] == want[got[i].component_id] for i in range(len(texts)))
    assert sum(got[i].component_id == got[j].component_id for i, j in near) >= 0.97 * len(near) > 500
    assert all(got[i].kept == (got[i].component_id == i) for i in range(len(texts)))
    assert [got[i].component_id for i in (200, 201, 202)] == [want[i] for i in (200, 201, 202)]


def test_lists_have_the_nearest_codewords():
    """Against all 4096 code words, the least flip is found nearly always, and costs are right."""
    rng = np.random.default_rng(1)
    z = rng.normal(size=(300, 23)).astype(np.float32)
    message = np.arange(4096) << 11
    bits = ((message ^ simhash._syndromes(message))[:, None] >> np.arange(23) & 1).astype(bool)
    costs = ((z[:, None, :] > 0) != bits) @ np.zeros(23) + np.where((z[:, None, :] > 0) != bits, np.abs(z)[:, None, :], 0).sum(-1)
    index, cost = simhash.codewords_by_sums(z)
    listed = np.isfinite(cost)
    assert np.allclose(cost[listed], np.take_along_axis(costs, index, 1)[listed], atol=1e-4)
    assert (np.abs(cost[:, 0] - costs.min(1)) < 1e-4).mean() > 0.95


def test_stage(spark):
    import corpus_pipeline

    texts = texts_with_copies()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(spark, docs).collect()}
    assert {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()} == set(got.values())


def edited_texts():
    """Pairs of texts that the threshold lies between, a group of many such around one text, and a line that all of them have."""
    random.seed(11)
    words, line = [f"v{i}" for i in range(3000)], "all of these texts have one line of a dozen words in their midst"
    texts = []

    def edited(base, edits):
        own = list(base)
        for at in random.sample(range(len(own)), edits):
            own[at] = random.choice(words)
        return " ".join(own[:30] + line.split() + own[30:])

    for _ in range(150):
        base = random.choices(words, k=random.randint(60, 300))
        texts += [edited(base, 0), edited(base, max(1, len(base) // random.randint(38, 60)))]
    base = random.choices(words, k=120)
    return texts + [edited(base, random.randint(1, 3)) for _ in range(60)]


@pytest.mark.parametrize("frequent, sampled", [(2, 2), (10**9, 1)])
def test_no_link_is_left_out(spark, monkeypatch, frequent, sampled):
    """Groups are those of all pairs, whatever shingles are taken for frequent."""
    monkeypatch.setattr(simhash, "FREQUENT", frequent)
    monkeypatch.setattr(simhash, "SAMPLED", sampled)
    texts = edited_texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(spark, docs).collect()}
    want = plain_groups(texts)
    assert 50 < len(texts) - len(set(want)) < len(texts) - 50
    assert [got[i] for i in range(len(texts))] == want


def test_prefixes_and_parities_of_similar_sets():
    rng = np.random.default_rng(3)
    universe = np.unique(rng.integers(0, 2**63, 400).astype(np.uint64) * np.uint64(2))
    last = np.sort(rng.choice(universe, 150, replace=False))
    rank = rng.permutation(len(last))
    similar = 0
    for _ in range(3000):
        x = np.sort(rng.choice(universe, rng.integers(1, 60), replace=False))
        y = np.unique(np.concatenate((x[rng.random(len(x)) < 0.9], rng.choice(universe, rng.integers(0, 6)))))
        shared = len(np.intersect1d(x, y))
        odd = sum(int(i).bit_count() for i in (simhash.parities(x) ^ simhash.parities(y)).view(np.uint64))
        assert odd <= len(x) + len(y) - 2 * shared
        if 5 * shared >= 4 * (len(x) + len(y) - shared):
            similar += 1
            for order in ((last, rank), (last[:0], rank[:0])):
                assert len(np.intersect1d(simhash.prefix(x, *order, 0.8), simhash.prefix(y, *order, 0.8)))
    assert similar > 300


def test_verified_by_parts(spark):
    """Sets that are cut into parts give the pairs of whole sets, those on the threshold too, and each part is a part of the hashes."""
    from tessera.llm.common import Scratch

    random.seed(5)
    base = [f"u{i}" for i in range(44)]  # 40 shingles
    texts = ["", "a b", " ".join(base), " ".join(base[:36]), " ".join(base[:35]), " ".join(base[4:] + base[:2]), " ".join(base[6:] + ["x"])]
    texts += [" ".join(base[: random.randint(20, 44)] + random.choices(base, k=random.randint(0, 8))) for _ in range(25)]
    rows = spark.createDataFrame(list(enumerate(texts)), "row long, text string")
    pairs = [(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts))]
    plain = [plain_set(t) for t in texts]
    want = {(i, j) for i, j in pairs if 5 * len(plain[i] & plain[j]) >= 4 * len(plain[i] | plain[j])}
    assert (2, 3) in want and (2, 4) not in want and 20 < len(want) < len(pairs) - 20
    for parts in (1, 3, 8):
        scratch = Scratch(spark, "parts")
        sets = scratch.keep(simhash._sets(rows, simhash.WORDS, parts), "sets")
        got = sets.collect()
        for r in got:
            whole = simhash.shingles(texts[r.row]).view(np.int64).tolist()
            assert r.n == len(whole) and [h for i in range(parts) for h in r[f"set{i}"]] == whole
        if parts == 8:
            assert max(sum(len(r[f"set{i}"]) for r in got) for i in range(parts)) < 0.3 * sum(r.n for r in got)
        found = simhash._verified(sets, spark.createDataFrame(pairs, "a long, b long"), 0.8, scratch)
        assert {(r.a, r.b) for r in found.collect()} == want


def test_wide_tables_are_deleted(spark, monkeypatch):
    """Keys, prefixes and sets, which take most of the disk, are gone when the groups are there."""
    import pyarrow.parquet as pq

    made, keep = [], simhash.Scratch.keep
    monkeypatch.setattr(simhash.Scratch, "keep", lambda self, df, tag: made.append(keep(self, df, tag)) or made[-1])
    docs = spark.createDataFrame(list(enumerate(edited_texts())), "doc_id long, text string")
    assert simhash.similar_documents(spark, docs).count() == 360
    columns = set()
    for table in made:
        for f in Path(table.scratch_path).rglob("*.parquet"):
            columns |= set(pq.read_schema(f).names)
    assert "component" in columns
    assert not {x for x in columns if x in ("keys", "prefix") or x.startswith("set")}
