import random
import re

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline as cp
from quarry.llm import nearcopies, simhash


def slow_shingles(text):
    words = [w for w in re.split("[ \t\n\x0b\x0c\r]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def alike(a, b):
    return 5 * len(a & b) >= 4 * len(a | b)


def keep_unlike(rows):
    """The least doc_id of each component, by trying all pairs."""
    sets, root = [slow_shingles(r.text) for r in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if root[i] != root[j] and alike(sets[i], sets[j]):
                root = [root[j] if r == root[i] else r for r in root]
    best = {}
    for r, c in zip(rows, root):
        best[c] = min(best.get(c, r), r, key=lambda r: (r.doc_id is None, r.doc_id or 0))
    return sorted(best.values(), key=str)


@pytest.mark.parametrize("texts", [[], [None, "", " \n"], ["One", "a b c d e", "É É é x Y z É É é x y", "A\x0bb\x0cc\x1cd e f g"], ["x " * 50, " the cat sat on the mat " * 9]])
def test_shingles(texts):
    found, per = nearcopies.shingles(pa.array(texts, pa.string()))
    assert per.tolist() == [len(slow_shingles(t)) for t in texts]
    assert len(set(found.tolist())) == len(set().union(*map(slow_shingles, texts)))


def edited(rng, words, n):
    words = list(words)
    for i in rng.sample(range(len(words)), n):
        words[i] = f"new{rng.random()}"
    return " ".join(words)


def test_near_copies_beyond_two_bits_go(spark, docs, tmp_path):
    rng = random.Random(5)
    rows, prints = [], []
    for g in range(12):
        base = [f"w{rng.randint(0, 400)}" for _ in range(150)]
        texts = [" ".join(base), *(edited(rng, base, n) for n in (1, 2, 3, 3, 4, 9)), " ".join(base).upper()]
        rows += [(100 * g + i if i != 3 else None, t) for i, t in enumerate(texts)]
        prints += [(simhash.fingerprint(texts[0]) ^ simhash.fingerprint(t)).bit_count() for t in texts[2:4]]
    assert max(prints) > 2
    rows += [(5000 + i, t) for i, t in enumerate([None, "", " \n", "a b", "A b", "b a"])]
    rng.shuffle(rows)
    docs(rows).repartition(3).write.parquet(str(tmp_path / "documents"))
    frame = spark.read.parquet(str(tmp_path / "documents"))
    want = keep_unlike(frame.collect())
    assert len(want) < len(rows) / 2
    assert sorted(cp.drop_near_copies(spark, frame, "").collect(), key=str) == want


def test_anchors_cover():
    rng = np.random.default_rng(2)
    prints = rng.integers(0, 1 << 64, 4000, np.uint64)
    found = nearcopies.nearest_anchor(prints)
    assert np.bitwise_count(found ^ prints).max() == 1
    assert (nearcopies.nearest_anchor(found) == found).all()  # a codeword is its own anchor
    # Every bit from 0 to 62 is corrected, bit 63 is not.
    assert all((nearcopies.nearest_anchor(found ^ np.uint64(1 << i)) == found).all() == (i < 63) for i in range(64))


def test_fingerprints_are_majorities_of_min_wise_samples():
    found, per = nearcopies.shingles(pa.array([" ".join(f"w{i}" for i in range(30)), "a b", " ".join(f"w{i}" for i in range(30))]))
    got = nearcopies.fingerprints(found, per)
    assert (got[0] == got[2]).all() and (got[0] != got[1]).all()
    seeds = np.random.default_rng(nearcopies.SEED).integers(0, 1 << 63, (2, nearcopies.SAMPLE * nearcopies.PRINTS), np.uint64)
    at = np.split(found, np.cumsum(per)[:-1])
    for t, own in enumerate(at):
        for p in (0, 7, nearcopies.PRINTS - 1):
            sample = [min(int(((int(x) ^ int(seeds[0, i])) * (int(seeds[1, i]) << 1 | 1)) % (1 << 64)) for x in own) for i in range(4 * p, 4 * p + 4)]
            hashes = [int(nearcopies._fold(np.uint64(p), np.array([m], np.uint64))[0]) for m in sample]
            assert int(got[t, p]) == sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) > 2)


@pytest.mark.parametrize("matrix", [1, 1 << 22])
@pytest.mark.parametrize("seed", range(4))
def test_links_of_a_block(seed, matrix, monkeypatch):
    monkeypatch.setattr(nearcopies, "MATRIX", matrix)
    rng = random.Random(seed)
    base = [f"w{rng.randint(0, 60)}" for _ in range(60)]
    texts = [edited(rng, base, rng.choice([0, 1, 2, 3])) for _ in range(30)] + ["a b", "A b", "", None]
    root = np.array([rng.choice([0, 0, 0, i]) for i in range(len(texts))])
    a, b = nearcopies.links(*nearcopies.shingles(pa.array(texts)), root)
    sets = [slow_shingles(t) for t in texts]

    def parts(pairs):
        at = list(range(len(texts)))
        for i, j in pairs:
            at = [at[j] if x == at[i] else x for x in at]
        return [at.index(x) for x in at]

    assert parts(zip(a, b)) == parts((i, j) for i in range(len(texts)) for j in range(i) if root[i] != root[j] and alike(sets[i], sets[j]))
    assert len(a) < len(texts)  # stars, not pairs


@pytest.mark.parametrize("rows", [1024, 7])
def test_links_that_no_head_has(spark, docs, tmp_path, rows, monkeypatch):
    """A dense group: edits of edits, so that many links are between texts far from any head."""
    monkeypatch.setattr(nearcopies, "BLOCK_ROWS", rows)
    rng = random.Random(11)
    base = [f"w{rng.randint(0, 300)}" for _ in range(120)]
    rows = []
    for i in range(160):
        text = edited(rng, base, rng.choice([0, 1, 3, 5, 6, 8]))
        rows.append((len(rows), text))
        for _ in range(rng.choice([0, 0, 2])):
            text = edited(rng, text.split(), 2)
            rows.append((len(rows), text))
    rng.shuffle(rows)
    docs(rows).repartition(5).write.parquet(str(tmp_path / "documents"))
    frame = spark.read.parquet(str(tmp_path / "documents"))
    want = keep_unlike(frame.collect())
    assert 20 < len(want) < len(rows) - 20
    assert sorted(cp.drop_near_copies(spark, frame, "").collect(), key=str) == want


def test_whole_fingerprints_are_compared_by_distance(spark, docs, tmp_path, monkeypatch):
    """Without the samples, texts whose fingerprints over all shingles differ in at most two bits are still found, and checked."""
    signatures = nearcopies._signatures

    def unsampled(batches):
        for batch in signatures(batches):
            yield batch.set_column(3, "keys", pa.array([[row] for row in batch["row"].to_pylist()], pa.list_(pa.int64())))

    monkeypatch.setattr(nearcopies, "_signatures", unsampled)
    rng = random.Random(3)
    rows = []
    for g in range(40):
        base = [f"w{rng.randint(0, 5000)}" for _ in range(400)]
        rows += [(10 * g, " ".join(base)), (10 * g + 1, edited(rng, base, 1))]
    found, per = nearcopies.shingles(pa.array([t for _, t in rows]))
    prints = nearcopies.whole_prints(found, per)
    sets = np.split(found, np.cumsum(per)[:-1])
    assert all(int(p) == sum(1 << b for b in range(64) if 2 * sum(int(h) >> b & 1 for h in s) > len(s)) for p, s in zip(prints[:6], sets))
    near = np.bitwise_count(prints[0::2] ^ prints[1::2]) <= simhash.THRESHOLD
    assert 10 < near.sum() and (prints[0::2][near] != prints[1::2][near]).any()
    docs(rows).coalesce(1).write.parquet(str(tmp_path / "documents"))
    kept = {r.doc_id for r in cp.drop_near_copies(spark, spark.read.parquet(str(tmp_path / "documents")), "").collect()}
    assert kept == {i for i, _ in rows} - {10 * g + 1 for g in range(40) if near[g]}
