"""Links of images against all pairs."""

import random

import numpy as np
from sedimenta.llm import media
from sedimenta.operators.components import components

WORDS = "img long, x array<float>, y array<float>, words array<array<bigint>>"


def _points(spark, described):
    return spark.createDataFrame([(i, d["x"], d["y"], d["words"]) for i, d in enumerate(described)], WORDS)


def _classes(spark, described):
    found = components(media.links(_points(spark, described))).collect()
    at = {r["node"]: r["root"] for r in found}
    return [at.get(i, i) for i in range(len(described))]


def _pool(n, seed):
    """n points of one place and descriptor each."""
    rnd = np.random.RandomState(seed)
    words = rnd.randint(-(1 << 62), 1 << 62, (n, 4)) * 2 + rnd.randint(0, 2, (n, 4))
    return rnd.uniform(10, 400, n).tolist(), rnd.uniform(10, 400, n).tolist(), words.tolist()


def _holding(pool, chosen):
    return dict(zip(("x", "y", "words"), ([column[k] for k in chosen] for column in pool)))


def test_copies_beside_strangers_in_their_buckets(spark):
    """2 and 5 are copies, and in each of their buckets one stranger is first and another between them."""
    pool = _pool(10, 22)
    half = [range(5), range(5, 10)]
    images = [_holding(pool, range(10) if i in (2, 5) else half[i % 2 if i < 2 else (i - 3) % 2 if i < 5 else i % 2]) for i in range(8)]
    assert _classes(spark, images) == [0, 1, 2, 3, 4, 2, 6, 7]


def test_many_groups_that_share_large_buckets(spark, monkeypatch):
    """Pairs of copies of which each point is on more than 32 images, while two pairs share at most seven."""
    monkeypatch.setattr(media, "ALL_PAIRS_UP_TO", 16)
    rnd, groups = random.Random(23), []
    while len(groups) < 60:
        new = set(rnd.sample(range(24), 10))
        if all(len(new & g) <= 7 for g in groups):
            groups.append(new)
    assert all(sum(k in g for g in groups) > 8 for k in range(24))
    pool = _pool(24, 23)
    assert _classes(spark, [_holding(pool, sorted(groups[i % 60])) for i in range(120)]) == [i % 60 for i in range(120)]


def test_copies_that_differ_in_half_of_each_word(spark):
    pool = _pool(10, 24)
    other = (*pool[:2], [[w ^ 1 << (k % 32) for w in words] for k, words in enumerate(pool[2])])
    assert _classes(spark, [_holding(pool, range(10)), _holding(other, range(10))]) == [0, 0]


def _textures(spark, n, seed):
    rnd = np.random.RandomState(seed)
    vectors = [(i, [float(x) for x in rnd.normal(size=64)]) for i in range(n)]
    found = media.rendered(spark.createDataFrame(vectors, "vec_id long, embedding array<double>")).collect()
    return [media.decode(bytes(r["data"])) for r in sorted(found, key=lambda r: r["img"])]


def _edited(a, kind, rnd):
    if kind == 0:
        a = a + rnd.normal(0, 3, a.shape)
    elif kind == 1:
        a = a[7:, 5:-6]
    elif kind == 2:
        a = media._resized(a[None], 0.9)[0]
    elif kind == 3:
        a = 0.8 * a + 20
    elif kind == 4:
        a = np.rint(a / 12) * 12
    elif kind == 5:
        a = np.rot90(a)
    else:
        a = a[12:84, 12:84]
    return np.clip(np.rint(a), 0, 255).astype(np.float32)


def test_recall_of_links_on_edited_copies(spark):
    rnd = np.random.RandomState(5)
    images = _textures(spark, 100, 21)
    described = media.described(images + [_edited(a, i % 5, rnd) for i, a in enumerate(images)])
    n = len(described)
    true = [(a, b) for a in range(n) for b in range(a + 1, n) if media.agreement(described[a], described[b]) >= media.AGREE]
    got = _classes(spark, described)
    recall = sum(got[a] == got[b] for a, b in true) / len(true)
    print(f"pairs {len(true)}, recall {recall:.3f}")
    assert len(true) >= 50 and recall >= 0.9


def test_planted_copies_are_found_and_strangers_are_not(spark):
    """Noise, two crops, a smaller size, dimmed, posterised and turned: 280 edits of 40 images, each to its own class.

    Of images of nine tenths the size most are missed, and of those that lost a quarter of each side some: see the README.
    """
    rnd, kinds = np.random.RandomState(6), 7
    images = _textures(spark, 40, 25)
    described = media.described(images + [_edited(a, k, rnd) for a in images for k in range(kinds)])
    got = _classes(spark, described)
    owner = [*range(40), *(i for i in range(40) for _ in range(kinds))]
    by_kind = [float(np.mean([got[40 + i * kinds + k] == got[i] for i in range(40)])) for k in range(kinds)]
    print("recall by kind", by_kind, "of all", np.mean(by_kind))
    assert all(by_kind[k] >= 0.9 for k in (0, 1, 3, 4, 5))
    mixed = {c for c in set(got) if len({o for o, g in zip(owner, got) if g == c}) > 1}
    assert not mixed


def _all_links(described):
    n = len(described)
    return {(a, b) for a in range(n) for b in range(a + 1, n) if media.agreement(described[a], described[b]) >= media.AGREE}


def _far(words, by, rnd):
    """The words with `by` other bits in each of the eight parts of 32."""
    return [[w ^ sum(1 << int(k) + h for h in (0, 32) for k in rnd.permutation(31)[:by]) for w in point] for point in words]


def test_links_without_a_common_bucket(spark, monkeypatch):
    """Copies that differ in five bits of all eight parts meet in no table, and blocks of few images part them; one image
    has fewer points than the others, one none."""
    monkeypatch.setattr(media, "BLOCK", 3)
    rnd = np.random.RandomState(31)
    pools = [_pool(12, 40 + k) for k in range(4)]
    images = [_holding(p, range(12)) for p in pools] + [_holding((*p[:2], _far(p[2], 5, rnd)), range(12)) for p in pools]
    images += [_holding(pools[0], range(9)), {"x": [], "y": [], "words": []}]
    got = sorted((r["a"], r["b"]) for r in media.links(_points(spark, images)).collect())
    assert got == sorted(_all_links(images)) and {(k, k + 4) for k in range(4)} <= set(got) and len(got) == 6


def test_all_links_of_edited_copies(spark):
    """Every pair that agrees is a link, also inside a class, and none other is."""
    rnd = np.random.RandomState(5)
    images = _textures(spark, 60, 21)
    described = media.described(images + [_edited(a, k, rnd) for a in images[:30] for k in (0, 2, 6)])
    got = [(r["a"], r["b"]) for r in media.links(_points(spark, described)).collect()]
    assert len(got) == len(set(got)) and set(got) == _all_links(described)


def _grouped(rnd, n, groups):
    """Images of 0 to 20 points, some at one place, that lie about a few words and so are often within RADIUS bits of each other."""
    hubs = rnd.randint(0, 256, (groups, 32)).astype(np.uint8)
    out = []
    for k in range(n):
        m = int(rnd.randint(0, 21))
        flips = np.packbits(rnd.rand(m, 256) < rnd.choice([0.02, 0.08, 0.15], (m, 1)), axis=1)
        words = (hubs[rnd.randint(0, groups, m)] ^ flips).reshape(m, 32).view("<i8").reshape(m, 4)
        out.append({"x": rnd.randint(0, 90, m).astype(float).tolist(), "y": rnd.randint(0, 9, m).astype(float).tolist(), "words": words.tolist()})
    return out


def _all_sharing(images):
    """The pairs of which AGREE places of the first have points within RADIUS bits of the second."""
    found = set()
    for a, p in enumerate(images):
        for b in range(a + 1, len(images)):
            if p["x"] and images[b]["x"]:
                far = np.bitwise_count(np.array(p["words"]).view(np.uint64)[:, None] ^ np.array(images[b]["words"]).view(np.uint64)[None]).sum(axis=2)
                near = (far <= media.RADIUS).any(axis=1)
                if len({(round(x / 4), round(y / 4)) for x, y, n in zip(p["x"], p["y"], near) if n}) >= media.AGREE:
                    found.add((a, b))
    return found


def test_sharing_loses_no_pair_over_many_places(spark, monkeypatch):
    for name, value in (("BLOCK", 7), ("LEAST_BLOCK", 7), ("WIDE", 3), ("MATCHES", 50), ("OWN_AT_ONCE", 3), ("NEAR_AT_ONCE", 5), ("CENTRES_AT_ONCE", 2), ("IMAGES_AT_ONCE", 4)):
        monkeypatch.setattr(media, name, value)
    images = _grouped(np.random.RandomState(3), 60, 12)
    got = [(r["a"], r["b"]) for r in media._sharing(_points(spark, images)).collect()]
    want = _all_sharing(images)
    assert len(want) > 20 and len(got) == len(set(got)) and set(got) == want


def test_sharing_leaves_out_points_that_are_far(monkeypatch):
    """Points of far groups aren't compared with each other."""
    images = _grouped(np.random.RandomState(4), 200, 40)
    images = [i for i in images if i["x"]]
    words = [np.array(i["words"]).view(np.uint64) for i in images]
    centres = np.concatenate(words)[::10].T.copy()
    near, apart = zip(*(media.sorted_in(w.T.copy(), centres) for w in words))
    places = [np.unique(np.stack([np.rint(np.array(i[c]) / 4) for c in "xy"]), axis=1, return_inverse=True)[1].ravel().astype("<u2").tobytes() for i in images]
    made = media.Images(np.arange(len(images)), [w.tobytes() for w in words], places, [n.astype("<i4").tobytes() for n in near], [a.tobytes() for a in apart])
    compared, plain = [], media._apart
    monkeypatch.setattr(media, "_apart", lambda a, b: compared.append(a.shape[1] * b.shape[1]) or plain(a, b))
    a, b = media.sharing(made, made, centres)
    assert set(zip(a.tolist(), b.tolist())) == _all_sharing(images)
    assert sum(compared) < 0.4 * sum(map(len, words)) ** 2


def _made(images, centres):
    """Images sorted in by the centres, as a place has them."""
    words = [np.array(i["words"]).view(np.uint64) for i in images]
    near, apart = zip(*(media.sorted_in(w.T.copy(), centres) for w in words))
    places = [np.unique(np.stack([np.rint(np.array(i[c]) / 4) for c in "xy"]), axis=1, return_inverse=True)[1].ravel().astype("<u2").tobytes() for i in images]
    return media.Images(np.arange(len(images)), [w.tobytes() for w in words], places, [n.astype("<i4").tobytes() for n in near], [a.tobytes() for a in apart])


def test_matches_take_bounded_memory(monkeypatch):
    """Each two of 1,400 images share seven points, too few to agree: what is held of each two is two bytes and not each match."""
    import tracemalloc

    monkeypatch.setattr(media, "MATCHES", 1 << 14)
    common, n = _pool(7, 50), 1400
    images = [{k: [*c, *o] for k, c, o in zip(("x", "y", "words"), common, _pool(3, 100 + i))} for i in range(n)]
    made = _made(images, np.array(common[2]).view(np.uint64).T.copy())
    tracemalloc.start()
    a, _ = media.sharing(made, made, np.array(common[2]).view(np.uint64).T.copy())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert not len(a) and peak < 5 * n * n


def test_links_of_a_large_class_are_counted_without_listing_them(spark):
    pool, other = _pool(10, 60), _pool(12, 61)
    images = [_holding(pool, range(10)) for _ in range(40)] + [_holding(other, range(12)), _holding(other, range(10)), _pool(9, 62)]
    images[-1] = dict(zip(("x", "y", "words"), images[-1]))
    rows = media.spans(_points(spark, images)).collect()
    assert len(rows) == 42 and {r["a"]: r["n"] for r in rows} == {**dict.fromkeys(range(40), 39), 40: 1, 41: 1}
    assert {r["a"]: r["b"] for r in rows} == {**dict.fromkeys(range(40), 0), 40: 40, 41: 40}


def test_spans_agree_with_links_over_many_places(spark, monkeypatch):
    for name, value in (("BLOCK", 7), ("LEAST_BLOCK", 7), ("WIDE", 3), ("MATCHES", 50)):
        monkeypatch.setattr(media, name, value)
    rnd = np.random.RandomState(8)
    images = _textures(spark, 12, 27)
    points = _points(spark, media.described(images + [_edited(a, k, rnd) for a in images for k in (0, 3, 4)]))
    pairs, rows = media.links(points).collect(), media.spans(points).collect()
    degree, told = {}, {}
    for r in pairs:
        for i in r:
            degree[i] = degree.get(i, 0) + 1
    for r in rows:
        told[r["a"]] = told.get(r["a"], 0) + r["n"]
    classes = lambda edges: {r["node"]: r["root"] for r in components(edges).collect()}
    assert len(pairs) >= 30 and told == degree and classes(media.spans(points)) == classes(media.links(points))


def test_a_point_of_256_bits_from_a_centre_is_far_from_it():
    words = np.array(_pool(3, 70)[2]).view(np.uint64).T.copy()
    near, apart = media.sorted_in(np.concatenate([~words[:, :1], words], axis=1), words[:, :1])
    assert near.tolist() == [0] * 4 and apart[0] == 255 and apart[1] == 0 and (apart[2:] > 0).all()
