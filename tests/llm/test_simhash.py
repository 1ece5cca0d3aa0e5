import random
from collections import Counter

import numpy as np
import pyarrow as pa
from conftest import SCHEMA, prose, row

from factloom.llm.graph import components
from factloom.llm.simhash import RADIUS, Node, fingerprints, forest_shape, meets, near_dedup, near_duplicates, prefixes
from factloom.llm.textkit import BASE, U, chunks


def prints_of(texts):
    parts = [fingerprints(c) for c in chunks(pa.array(texts, pa.string()))]
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


M = (1 << 64) - 1


def scramble(x):
    x = (x + 0x9E3779B97F4A7C15) & M
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & M
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & M
    return x ^ (x >> 31)


def plain_print(text):
    """A fingerprint once more, bit by bit, in plain integers."""
    words = set(text.encode().split())
    hashes = set()
    for w in words:
        h = 0
        for i, byte in enumerate(w):
            h = (h + (byte + 1) * pow(int(BASE), i, 1 << 64)) & M
        hashes.add(scramble((h + len(w)) & M) >> 18)
    out = []
    for half in range(2):
        count = Counter()
        for h in hashes:
            x = scramble((h + half * 0x5851F42D4C957F2D) & M)
            for bit in range(64):
                count[bit] += x >> bit & 1
        out.append(sum(1 << bit for bit in range(64) if 2 * count[bit] > len(hashes)))
    return out, len(hashes), words


def brute(ids, texts):
    """All pairs by plain fingerprints, then groups; nothing of the operator's own code."""
    made = [plain_print(t) for t in texts]
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (f, n, a) in enumerate(made):
        for j in range(i):
            g, m, b = made[j]
            if not n or not m or (f[0] ^ g[0]).bit_count() + (f[1] ^ g[1]).bit_count() > 28 or min(n, m) < 0.6 * max(n, m):
                continue
            if max(n, m) <= 64 and len(a & b) < 0.65 * len(a | b):
                continue
            x, y = find(i), find(j)
            root[max(x, y)] = min(x, y)
    least = {}
    for i in range(len(ids)):
        least[find(i)] = min(least.get(find(i), ids[i]), ids[i])
    return {(ids[i], least[find(i)]) for i in range(len(ids)) if ids[i] != least[find(i)]}


def test_groups_against_all_pairs(spark, plain):
    rng = random.Random(1)
    crowd = prose(rng, 300)
    many = [" ".join("zzz" if rng.random() < 0.03 else w for w in crowd.split(" ")) for _ in range(150)]
    texts = plain + many + [prose(rng, 200) for _ in range(300)] + ["one two", "one two three", "", " ", "one six"] * 2
    docs = spark.createDataFrame([row(i, t) for i, t in enumerate(texts)], SCHEMA)
    want = brute(list(range(len(texts))), texts)
    got = {(r.doc_id, r.duplicate_of) for r in near_duplicates(docs).collect()}
    assert got == want  # fewer fingerprints than a leaf has: every pair is compared
    for options in ({"leaf": 16}, {"leaf": 8, "crowd": 60}):  # deep tries; crowds planted again
        got = {(r.doc_id, r.duplicate_of) for r in near_duplicates(docs, **options).collect()}
        assert len(got & want) >= 0.97 * len(want) and not {a for a, _ in got} - {a for a, _ in want}
    assert {i for i, _ in got} >= set(range(60, 70))  # all exact copies
    kept = {r.doc_id for r in near_dedup(docs).collect()}
    assert kept == set(range(len(texts))) - {a for a, _ in want}


def test_prefixes_climb_with_the_density():
    rng = np.random.default_rng(3)
    dense = (U(0b10110) << U(59)) | rng.integers(0, 1 << 59, 3000, dtype=np.uint64)
    f0 = np.sort(np.concatenate((dense, rng.integers(0, 1 << 63, 200, dtype=np.uint64))))
    stretches = sorted(prefixes(f0, 4, 300))
    assert sum(b - a for a, b in stretches) >= len(f0) - 2 and all(a < b for a, b in stretches)
    assert max(b - a for a, b in stretches) >= 3000  # the dense part isn't split beyond the target's depth
    assert (0, 200) in stretches  # the sparse one is searched from its top


def test_thickets_flood_to_the_same_groups():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, (3, 2), dtype=np.uint64)
    f = base[rng.integers(0, 3, 400)] ^ (U(1) << rng.integers(0, 64, (400, 2), dtype=np.uint64))
    node = Node(f, np.full(400, 100), np.array([None] * 400, object), RADIUS)
    groups = []
    for members, centres in (node.stars(), node.flood()):
        root = np.arange(400)
        root[members] = centres
        groups.append(root.tolist())
    assert groups[0] == groups[1] and len(set(groups[0])) == 3


def test_short_texts_are_compared_by_their_words():
    few = np.empty(4, object)
    few[:] = [np.array(x, np.uint32).tobytes() if x else None for x in ([1, 2, 3, 5], [1, 2, 3, 5, 4], [1, 9, 8], None)]
    node = Node(np.zeros((4, 2), U), np.array([4, 5, 3, 4]), few, RADIUS)
    assert [[node.alike(i, j) for j in range(4)] for i in range(4)] == [[True, True, False, True], [True, True, False, True], [False, False, True, True], [True] * 4]


def test_lane_counts():
    rng = random.Random(4)
    texts = [prose(rng, n) for n in (1, 5, 300, 2000)] + ["", "a a a"]
    f, n = prints_of(texts)
    assert n.tolist()[-2:] == [0, 1]
    one, _ = prints_of([texts[2]])
    assert (one[0] == f[2]).all()
    same, _ = prints_of([" ".join(sorted(texts[2].split()))])
    assert (same[0] == f[2]).all()


def test_shape_keeps_the_recall():
    for n in (0, 1, 50, 10_000, 10**9):
        depth, trees = forest_shape(n, 64, 28, 0.92)
        assert 1 - (1 - meets(depth, 28)) ** trees >= 0.92


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 150)] + [(300, 300 + i) for i in range(1, 20)] + [(7, 7)]
    rng.shuffle(edges)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 150: 100, 200: 100} | {i: 300 for i in range(300, 320)}


def test_edges(messy, nothing):
    pairs = {(r.doc_id, r.duplicate_of) for r in near_duplicates(messy).collect()}
    assert {(2, 1), (6, 1)} <= pairs and not {3, 4, 5, None} & {a for a, _ in pairs}
    out = near_dedup(messy)
    ids = [r.doc_id for r in out.collect()]
    assert out.columns == messy.columns and ids.count(1) == 2 and 2 not in ids and ids.count(7) == 1 and ids.count(None) == 2
    assert near_duplicates(nothing).count() == 0 and near_dedup(nothing).count() == 0
