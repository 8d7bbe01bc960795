import numpy as np
import xxhash

from parcelflow.llm import bitslice, simhash
from parcelflow.llm.components import components


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    parts = [b" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, radius):
    """{node: smallest} by breadth-first search over all pairs."""
    root, todo = {}, sorted(prints)
    for start in todo:
        if start in root:
            continue
        front = [start]
        root[start] = start
        while front:
            x = front.pop()
            for y in todo:
                if y not in root and bin(prints[x] ^ prints[y]).count("1") <= radius:
                    root[y] = start
                    front.append(y)
    return root


def test_planes_and_distances():
    rng = np.random.default_rng(1)
    for width, radius in ((1, 4), (1, 20), (4, 100), (4, 128)):
        words = rng.integers(0, 2**64, (150, width), dtype=np.uint64)
        words[70:90] = words[3] ^ np.uint64(5)
        stored = bitslice.planes(words)
        rows = np.repeat(np.arange(150), 3)
        blocks = np.tile(np.arange(3), 150)
        masks = np.full(450, bitslice.ALL)
        masks[blocks == 2] = np.uint64((1 << 22) - 1)
        at, lanes = bitslice.within(stored, words, rows, blocks, masks, radius)
        got = {(int(rows[i]), int(blocks[i]) * 64 + b) for i, w in zip(at, lanes) for b in range(64) if int(w) >> b & 1}
        want = {(i, j) for i in range(150) for j in range(150)
                if sum(bin(int(a) ^ int(b)).count("1") for a, b in zip(words[i], words[j])) <= radius}
        assert got == want


def test_forest_runs_across_blocks():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**64, 40, dtype=np.uint64)
    words = (base[rng.integers(0, 40, 400)] ^ (np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64)))[:, None]
    run = np.sort(rng.integers(0, 3, 400))
    child, root = bitslice.forest(words, run, 2)
    label = {i: i for i in range(400)} | dict(zip(child.tolist(), root.tolist()))
    for r in range(3):
        rows = np.flatnonzero(run == r)
        assert {i: label[i] for i in rows} == plain_components({int(i): int(words[i, 0]) for i in rows}, 2)


def test_complete_bands_cover_every_error():
    rng = np.random.default_rng(3)
    bands = [b[0] for b in simhash.complete_bands(4)]
    assert len(bands) == 15
    for _ in range(2000):
        error = sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
        assert any(error & m == 0 for m in bands)


def test_components(spark):
    rng = np.random.default_rng(4)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(1000, 1060)]
    root = {}
    for a, b in pairs:
        for x in (a, b):
            root.setdefault(x, x)
    for _ in range(400):
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.u: r.root for r in components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert got == {k: v for k, v in root.items() if k != v}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def make_documents():
    rng = np.random.default_rng(5)
    vocabulary = [f"word{i}" for i in range(400)]
    rows = []
    for i in range(60):
        words = list(rng.choice(vocabulary, int(rng.integers(1, 150))))
        for copy in range(int(rng.integers(1, 5))):
            other = list(words)
            if copy > 1:
                other[int(rng.integers(len(other)))] = "Changed"
            rows.append((len(rows) + 1, " ".join(other)))
    return rows + [(900, None), (901, ""), (902, " \t\n\x0b"), (903, "ünï x"), (904, "ÜNÏ X"), (None, "lost"), (5, rows[4][1]),
                   (905, "x " * 70_000), (906, "a\x0bb c d e f g")]


def test_near_duplicates_equal_brute_force(spark):
    rows = make_documents()
    df = spark.createDataFrame([(t, i, "a", 1) for i, t in rows], "text string, doc_id long, fingerprint string, node int")
    got = sorted((r.doc_id or -1, r.fingerprint & (2**64 - 1), r.component_id or -1) for r in simhash.near_duplicates(df).collect())
    prints = [plain_fingerprint(t) for _, t in rows]
    root = plain_components({p: p for p in prints}, 4)
    least = {}
    for (i, _), p in zip(rows, prints):
        if i is not None:
            least[root[p]] = min(least.get(root[p], i), i)
    assert got == sorted((i or -1, p, least.get(root[p], -1)) for (i, _), p in zip(rows, prints))
    assert simhash.near_duplicates(df.where("false")).count() == 0


def test_crowded_band_is_cut_into_cells(spark):
    rng = np.random.default_rng(6)
    near = [int(x) for x in {(1 << int(a)) | (1 << int(b)) | (1 << int(c)) for a, b, c in rng.integers(0, 40, (300, 3))}]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(near)], "node long, f0 long")
    whole, cut_ = (components(simhash.links(df, ["f0"], simhash.complete_bands(4), 4, chunk)) for chunk in (10_000, 20))
    assert sorted(whole.collect()) == sorted(cut_.collect())


def test_keep_one_per_group(spark):
    rng = np.random.default_rng(7)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows, groups = [], []
    for g in range(40):
        words = list(rng.choice(vocabulary, 200))
        for copy in range(1 + g % 3):
            other = list(words)
            if copy:
                other[10 * copy] = "new"
            rows.append((1000 - len(rows), " ".join(other), "en"))
            groups.append(g)
    rows += [(rows[0][0], rows[0][1], "en"), (None, rows[0][1], "en"), (2000, None, "en"), (None, "", None)]
    groups += [0, 0, 40, 40]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = simhash.keep_one_per_group(df)
    assert kept.columns == df.columns
    want = {g: min((i is None, i or 0) for (i, _, _), h in zip(rows, groups) if h == g) for g in groups}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for _, i in want.values())
    assert simhash.keep_one_per_group(df.where("false")).count() == 0


def jaccard_groups(sets, similarity):
    root = {}
    for start in range(len(sets)):
        front = [start] if start not in root else []
        root.setdefault(start, start)
        while front:
            x = front.pop()
            for y in range(len(sets)):
                if y not in root and 5 * len(sets[x] & sets[y]) >= 5 * similarity * len(sets[x] | sets[y]) - 1e-9:
                    root[y] = start
                    front.append(y)
    return root


def test_groups_are_those_of_the_shingle_sets(spark):
    """Pairs on both sides of similarity 0.8, repeated passages, chains and short texts, against all pairs."""
    rng = np.random.default_rng(8)
    number = iter(range(10**9))
    fresh = lambda n: [f"w{next(number)}" for _ in range(n)]
    texts = []
    for n in (8, 9, 24, 104, 204, 204, 204, 204, 404):
        for share in (0.70, 0.75, 0.79, 0.80, 0.80, 0.81, 0.85):
            words = fresh(n)
            count = n - 4
            keep = round(2 * share / (1 + share) * count)
            texts += [words, words[:keep + 4] + fresh(count - keep)]
    chain = fresh(304)
    for i in range(8):
        texts.append(chain[i * 20:i * 20 + 184])
    line = fresh(12)
    texts += [line + line * 60 + fresh(1), line * 2 + fresh(1), fresh(1), []]
    texts = [" ".join(t) for t in texts]
    sets = [{tuple(t.split()[i:i + 5]) for i in range(max(1, len(t.split()) - 4))} for t in texts]
    root = jaccard_groups(sets, 0.8)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.keep_one_per_group(df).collect()) == sorted(set(root.values()))
    members = spark.createDataFrame([(i, 0, len(s), t) for i, (s, t) in enumerate(zip(sets, texts))], "node long, root long, n long, text string")
    for chunk in (10, 1000):
        got = {r.u: r.root for r in components(simhash.verified_links(members, 5, 0.8, chunk)).collect()}
        assert got == {k: v for k, v in root.items() if k != v}
