"""Near-dups, lines and passages against brute force."""

import random
from collections import defaultdict

import numpy as np
import xxhash
from pyspark.sql import functions as F

from echofold.llm import common, forest, linededup, search, simhash, suffix

from .conftest import SCHEMA, prose, rows_of


def closed(n, near):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(n):
        for j in range(i):
            if near(i, j):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def bits(a, b):
    return int(np.bitwise_count(a ^ b).sum())


def test_simhash_groups(spark, texts):
    docs = spark.createDataFrame(rows_of(texts), SCHEMA)
    f = simhash.fingerprints(texts)
    for radius, per_task in ((simhash.RADIUS, 400_000), (simhash.RADIUS, 20), (11, 400_000)):
        want = closed(len(texts), lambda i, j: bits(f[i], f[j]) <= radius)
        got = {r["doc_id"]: (r["group_id"], r["keep"]) for r in simhash.groups(docs, radius, per_task).collect()}
        assert {i: g for i, (g, _) in got.items()} == dict(enumerate(want))
        assert all(keep == (g == i) for i, (g, keep) in got.items())
        kinds = np.unique(f[f.any(axis=1)], axis=0)
        near = np.bitwise_count(f[:, None, :] ^ kinds[None, :, :]).sum(axis=2) <= radius
        links = {r["doc_id"]: r["links"] for r in simhash.groups(docs, radius, many=10**7).collect()} if per_task > 20 else None
        assert links is None or links == {i: int(near[i].sum()) - 1 for i in range(len(texts))}
    stage = {r[0] for r in simhash.stage(spark, docs, "").select("doc_id").collect()}
    assert stage == set(closed(len(texts), lambda i, j: bits(f[i], f[j]) <= simhash.RADIUS))


def test_simhash_search_is_exact():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 63, (300, 2)).astype(np.uint64)
    near = base[:150].copy()
    for row in near:
        for b in rng.integers(0, 128, rng.integers(1, 30)):
            row[b // 64] ^= np.uint64(1) << np.uint64(b % 64)
    every = np.unique(np.concatenate([base, near]), axis=0)
    pairs = np.bitwise_count(every[:, None, :] ^ every[None, :, :]).sum(axis=2)
    want = closed(len(every), lambda i, j: pairs[i, j] <= 23)
    tree = common.Forest(len(every))
    for k in range(simhash.SEGMENTS):
        seg = simhash.segment(every[:, 0], every[:, 1], k)
        tree.join(*simhash.matches(every[:, 0], every[:, 1], seg, np.ones(len(every), bool), 2, 23))
    assert tree.roots(np.arange(len(every))).tolist() == want


def test_simhash_segments_follow_the_number():
    assert [len(simhash.segments(n, 23)) for n in (10, 10**5, 10**7, 10**8, 10**11)] == [8, 8, 6, 5, 4]
    for n in (10, 10**7, 10**8, 10**11):
        cuts = simhash.segments(n, 23)
        assert cuts[0][0] == 0 and sum(b for _, b in cuts) == 128 and (23 // len(cuts) + 1) * len(cuts) > 23


def test_simhash_counts_every_link_once():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, (60, 2)).astype(np.uint64)
    rows = np.repeat(base, 6, axis=0)
    for row in rows:
        for b in rng.integers(0, 128, rng.integers(0, 14)):
            row[b // 64] ^= np.uint64(1) << np.uint64(b % 64)
    rows = np.unique(rows, axis=0)
    want = (np.bitwise_count(rows[:, None, :] ^ rows[None, :, :]).sum(axis=2) <= 23).sum(axis=1) - 1
    for n in (10, 10**7):
        cuts = simhash.segments(n, 23)
        got = sum(simhash.matches(rows[:, 0], rows[:, 1], simhash.bits_of(rows, a, b), np.ones(len(rows), bool), 23 // len(cuts), 23, b, cuts[:k])[2] for k, (a, b) in enumerate(cuts))
        assert got.tolist() == want.tolist() and want.sum() > 100


def test_simhash_tables_part_without_copies_around(spark):
    for size, r in ((16, 2), (21, 3), (22, 3), (26, 4), (16, 0)):
        for alike in range(4):
            every = simhash.tables(size, r, alike)
            assert sorted(np.concatenate([m for _, m in every]).tolist()) == sorted(simhash.ball(size, r).tolist())
            assert all(not (m & kept).any() for kept, m in every)
    rng = np.random.default_rng(7)
    codes = np.repeat(rng.integers(0, 1 << 63, (500, 2)).astype(np.uint64), 4, axis=0)
    for row in codes:
        for b in rng.integers(0, 128, rng.integers(0, 14)):
            row[b // 64] ^= np.uint64(1) << np.uint64(b % 64)
    codes = np.unique(codes, axis=0)
    d = np.bitwise_count(codes[:, None, :] ^ codes[None, :, :]).sum(axis=2)
    want = (d <= 23).sum(axis=1) - 1
    root = np.array(closed(len(codes), lambda i, j: d[i, j] <= 23))
    prints = spark.createDataFrame([(i, int(a), int(b)) for i, (a, b) in enumerate(codes.view(np.int64))], "id long, low long, up long")
    for per_task, most in ((10**6, 8), (100, 24), (20, 48)):
        got = simhash.links(prints, per_task=per_task)
        plan = got._jdf.queryExecution().analyzed().children().head()
        sent = spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, plan).count()
        assert sent <= most * len(codes)
        rows = got.collect()
        count, tree = np.zeros(len(codes), int), common.Forest(len(codes))
        for u, v, n in rows:
            count[u] += n
        edges = np.array([(u, v) for u, v, _ in rows if v is not None])
        tree.join(edges[:, 0], edges[:, 1])
        assert count.tolist() == want.tolist() and want.sum() > 1000
        assert tree.roots(np.arange(len(codes))).tolist() == root.tolist()


def test_perfect_hash_is_minimal_and_exact():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 63, 5000):
        keys = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        counts = rng.integers(1, 1 << 20, len(keys))
        shard = linededup.Shard.read(linededup.build(keys, counts))
        assert sorted(shard.index(keys).tolist()) == list(range(len(keys)))
        assert shard.counts(keys).tolist() == counts.tolist()
        other = rng.integers(0, 1 << 63, 3000).astype(np.uint64)
        assert (shard.counts(np.setdiff1d(other, keys)) > 0).mean() < 0.01


def line_dedup(texts, most):
    held = defaultdict(set)
    for t in texts:
        for line in (t or "").split("\n"):
            if line.strip(" "):
                held[line.strip(" ")].add(t)
    out = []
    for t in texts:
        if t is None:
            out.append(None)
            continue
        kept = [x for x in t.split("\n") if not x.strip(" ") or len(held[x.strip(" ")]) <= most]
        out.append("\n".join(kept) if any(x.strip(" ") for x in kept) else t)
    return out


def test_line_dedup(spark, texts):
    more = texts + [None, "", "this very line stands in many of them", "  this very line stands in many of them \n\nx"]
    docs = spark.createDataFrame(rows_of(more), SCHEMA)
    for per_shard in (200_000, 7):
        got = {r["doc_id"]: r["text"] for r in linededup.dedup(docs, per_shard=per_shard).collect()}
        assert got == dict(enumerate(line_dedup(more, linededup.MOST)))
    out = linededup.stage(spark, docs, "").where("doc_id = 45").first()
    assert "this very line" not in out["text"] and out["n_chars"] == len(out["text"])


def test_prose_of_near_copies_stays(spark):
    rng = random.Random(21)
    base = [prose(rng, 40) for _ in range(12)]
    notice = prose(rng, 8)
    copies = ["\n".join([*base[: i % 12], base[i % 12].replace(" ", f" {prose(rng, 1)} ", 1), *base[i % 12 + 1 :], notice]) for i in range(30)]
    others = [f"{prose(rng, 60)}\n{notice}" for _ in range(9)]
    docs = spark.createDataFrame(rows_of(copies + others), SCHEMA)
    got = {r["doc_id"]: r["text"] for r in linededup.stage(spark, docs, "").collect()}
    assert got == {i: t.rsplit("\n", 1)[0] for i, t in enumerate(copies + others)}
    left = simhash.stage(spark, linededup.stage(spark, docs, ""), "").collect()
    assert {r["doc_id"] for r in left} == {0, *range(30, 39)} and base[5] in left[[r["doc_id"] for r in left].index(0)]["text"]


def spans(texts, least):
    seen, out = set(), []
    for d, t in enumerate(texts):
        w = (t or "").split()
        dup = [False] * len(w)
        for i in range(len(w) - least + 1):
            key = tuple(w[i : i + least])
            if key in seen:
                dup[i : i + least] = [True] * least
            seen.add(key)
        i = 0
        while i < len(w):
            j = i
            while j < len(w) and dup[j]:
                j += 1
            if j > i:
                out.append((d, i, j))
            i = max(j, i + 1)
    return out


def test_suffix_spans(spark, texts):
    rng = random.Random(9)
    few = ["ab", "cd", "ef"]
    periodic = " ".join(["x y z"] * 60)
    more = texts + [periodic, periodic + " q", " ".join(rng.choice(few) for _ in range(300)), None, "", "one two"]
    docs = spark.createDataFrame(rows_of(more), SCHEMA)
    want = spans(more, suffix.LEAST)
    merged = []
    for d, s, e in want:  # spans that touch are one
        if merged and merged[-1][0] == d and merged[-1][2] >= s:
            merged[-1] = (d, merged[-1][1], e)
        else:
            merged.append((d, s, e))
    for per_part in (suffix.PER_PART, 30):
        got = sorted((r["doc_id"], r["start_word"], r["end_word"]) for r in suffix.spans(docs, per_part).collect())
        assert got == merged


def test_deep_shallow_sort_orders_suffixes():
    rng = np.random.default_rng(2)
    text = np.concatenate([rng.integers(0, 3, 400), np.tile(rng.integers(0, 5, 60), 4), np.zeros(60)]).astype(np.uint64)
    starts = np.arange(len(text) - suffix.LEAST)
    raw = text.astype(">u8").tobytes()
    order = []
    for group in suffix.shallow_sort(text, starts):
        keys = [raw[8 * s : 8 * (s + suffix.LEAST)] for s in starts[group].tolist()]
        order += [group[i] for x in suffix.blind_sort(keys, suffix.SHALLOW) for i in x]
    got = [tuple(text[s : s + suffix.LEAST].tolist()) for s in order]
    assert got == sorted(got) and sorted(order) == starts.tolist()


def test_word_hashes_whole_texts():
    words, many = suffix.word_hashes(["a b  a", "", None, "b"])
    assert many.tolist() == [3, 0, 0, 1] and words[0] == words[2] == xxhash.xxh3_64_intdigest("a")


def test_forest_recall(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(400, 24))
    near = base[:120] + 0.05 * rng.normal(size=(120, 24))
    far = base[120:240] + 0.28 * rng.normal(size=(120, 24))
    x = np.concatenate([base, near, far, base[:5]]).astype(np.float32)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    u = forest.unit(x)
    sims = u @ u.T
    want = closed(len(x), lambda i, j: sims[i, j] >= forest.COSINE)
    for kw in ({}, {"leaf": 16, "per_task": 90}):
        got = {r["vec_id"]: r["group_id"] for r in forest.groups(rows, **kw).collect()}
        true = [(i, w) for i, w in enumerate(want) if w != i]
        assert np.mean([got[i] == w for i, w in true]) >= 0.9
        assert all(want[i] == want[g] for i, g in got.items())


def nearest(ids, codes, k, asked):
    want = set()
    for i in asked:
        near = sorted((int((codes[i] != codes[j]).sum()), ids[j]) for j in range(len(ids)) if ids[j] != ids[i])[:k]
        want |= {(ids[i], r + 1, j, d) for r, (d, j) in enumerate(near)}
    return want


def test_top_k(spark):
    rng = np.random.default_rng(6)
    for n, dim, k, kw in ((150, 20, 4, {}), (90, 70, 10, {"bits": 5}), (5, 8, 10, {}), (150, 20, 4, {"per_value": 6})):
        x = rng.normal(size=(n, dim)).astype(np.float32)
        x[: n // 3] = x[0]  # a third of all codes are one
        ids = [i * 3 for i in range(n)]
        rows = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<float>")
        got = [tuple(r) for r in search.top_k(rows, k, **kw).select("vec_id", "rank", "neighbor_id", "distance").collect()]
        assert len(got) == len(set(got)) and set(got) == nearest(ids, x > 0, k, range(n))


def test_top_k_of_some_queries(spark):
    rng = np.random.default_rng(16)
    x = rng.normal(size=(300, 64)).astype(np.float32)
    x[200:] = x[:100] * np.where(rng.random((100, 64)) < 0.05, -1, 1)  # near codes
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    for per_value in (search.PER_VALUE, 2):
        got = {tuple(r) for r in search.top_k(rows, asks=F.col("vec_id") % 25 == 0, per_value=per_value).select("vec_id", "rank", "neighbor_id", "distance").collect()}
        assert got == nearest(list(range(300)), x > 0, search.K, range(0, 300, 25))
    named = rows.selectExpr("concat('v', vec_id) as vec_id", "embedding")
    assert search.top_k(named, 2).where("vec_id = 'v7'").count() == 2


def test_segments_cover_all_bits():
    rng = np.random.default_rng(7)
    codes = rng.integers(0, 1 << 63, (50, 3)).astype(np.uint64)
    for width, n, most in ((150, 10, None), (192, 1 << 30, None), (70, 5, 7), (1, 1, None)):
        cuts = search.segments(width, n, most)
        assert cuts[0][0] == 0 and sum(s for _, s in cuts) == width and all(a + s == b for (a, s), (b, _) in zip(cuts, cuts[1:]))
        whole = [sum(int(w) << (64 * i) for i, w in enumerate(c)) & ((1 << width) - 1) for c in codes]
        parts = [search.bits_of(codes, a, s).tolist() for a, s in cuts]
        assert [sum(p[i] << a for p, (a, _) in zip(parts, cuts)) for i in range(50)] == whole


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(70)] + [(200, 100), (200, 300), (5, 5), (None, 1)]
    got = dict(common.components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert got == {i: 0 for i in range(71)} | {100: 100, 200: 100, 300: 100}
    assert prose(random.Random(1), 3)


BLANKS = [" ", " ", "\u0085", "\x1c", "\x1f", " ", "　", "\x0b", "\t", " \n"]


def test_suffix_spans_of_odd_blanks(spark):
    rng = random.Random(31)
    one = prose(rng, 80).split()
    texts = [prose(rng, 20)]
    for blank in BLANKS:
        own = prose(rng, 70).split()
        texts += [blank.join(own), blank.join(own), blank.join(one), f"{prose(rng, 5)}{blank}{blank.join(one)}"]
    docs = spark.createDataFrame(rows_of(texts), SCHEMA)
    for per_part in (suffix.PER_PART, 30, 3):
        got = sorted(map(tuple, suffix.spans(docs, per_part).collect()))
        assert got == spans(texts, suffix.LEAST)
    assert [r[0] for r in docs.orderBy("doc_id").select(common.words(docs["text"])).collect()] == [len(t.split()) for t in texts]


def test_suffix_spans_of_a_hot_passage(spark):
    rng = random.Random(32)
    passage, edge = prose(rng, 50), prose(rng, 51)
    texts = [f"{prose(rng, rng.randint(3, 40))} {passage} {prose(rng, 30)}" for _ in range(40)] + [f"{prose(rng, 4)} {edge}" for _ in range(20)] + [passage] * 9
    docs = spark.createDataFrame(rows_of(texts), SCHEMA)
    for per_part in (suffix.PER_PART, 4):
        assert sorted(map(tuple, suffix.spans(docs, per_part).collect())) == spans(texts, suffix.LEAST)


def test_suffix_spans_of_repeated_rows_and_ids(spark):
    rng = random.Random(33)
    text, other = prose(rng, 60), prose(rng, 70)
    docs = spark.createDataFrame([(1, text), (1, text), (2, f"x y {text}"), (None, text), (3, other), (3, f"{other} z"), (4, None), (5, "")], "doc_id long, text string")
    got = {tuple(r) for r in suffix.spans(docs).collect()}
    assert {x for x in got if x[0] != 3} == {(2, 2, 62)} and {x for x in got if x[0] == 3} == {(3, 0, 70)}
    named = docs.selectExpr("cast(doc_id as string) as doc_id", "text")
    assert {tuple(r) for r in suffix.spans(named).collect()} == {(str(a), b, c) for a, b, c in got}
