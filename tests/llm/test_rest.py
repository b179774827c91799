"""Packing, mixing, counts, shards, toxicity and the pipeline."""

import random
from collections import Counter, defaultdict
from hashlib import md5

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from echofold.llm import common, linededup, mixing, packing, sharding, simhash, tokens, toxicity

from .conftest import SCHEMA, prose, rows_of
from .test_dedup import bits, closed, line_dedup


def check_packing(rows, lengths, capacity):
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append((r["start"], r["n"], r["piece"]))
        bins[r["bin"]].append((r["offset"], r["n"]))
    assert set(pieces) == {i for i, n in lengths.items() if n}
    for i, told in pieces.items():
        at = 0
        for p, (start, n, piece) in enumerate(sorted(told)):
            assert (start, piece) == (at, p) and 0 < n <= capacity
            at += n
        assert at == lengths[i]
    for told in bins.values():
        at = 0
        for offset, n in sorted(told):
            assert offset == at
            at += n
        assert at <= capacity
    return len(bins)


@pytest.mark.parametrize("kw", [{}, {"per_part": 20, "islands": 3, "eras": 3}, {"islands": 1}])
def test_packing(spark, texts, kw):
    docs = spark.createDataFrame(rows_of(texts), SCHEMA)
    lengths = {i: len(t.split()) for i, t in enumerate(texts)}
    n = check_packing(packing.pack(docs, capacity=100, **kw).collect(), lengths, 100)
    least = -(-sum(lengths.values()) // 100)
    assert n <= 1.15 * least + 4


def test_packing_of_odd_rows(odd):
    """Every row with words is packed whole, rows that share an id or have none as well, and no bin is overfull."""
    for kw in ({}, {"per_part": 3, "islands": 3, "eras": 3}):
        rows = packing.pack(odd, capacity=2048, **kw).collect()
        lengths = Counter((r["doc_id"], len((r["text"] or "").split())) for r in odd.select("doc_id", "text").collect())
        told = defaultdict(int)
        for r in rows:
            told[r["row"], r["doc_id"]] += r["n"]
        assert Counter((i, n) for (_, i), n in told.items()) == Counter({k: c for k, c in lengths.items() if k[1]})
        named = [dict(r.asDict(), doc_id=r["row"]) for r in rows]
        check_packing(named, {row: n for (row, _), n in told.items()}, 2048)


def test_packing_beats_best_fit_decreasing(spark):
    """Lengths on which best fit, largest first, opens a bin more than the genetic algorithm needs, and none fewer can hold them."""
    sizes = [33, 46, 11, 44, 45, 61, 19, 28, 10, 3, 5, 29, 13, 46, 14, 39, 34, 22, 29, 61]
    docs = spark.createDataFrame(rows_of([" ".join(["w"] * n) for n in sizes]), SCHEMA)
    plain: list = []
    packing.best_fit(np.array(sizes), np.arange(len(sizes)), plain, 100)
    n = check_packing(packing.pack(docs, capacity=100, eras=4, turns=40).collect(), dict(enumerate(sizes)), 100)
    assert n == -(-sum(sizes) // 100) == len(plain) - 1


def fewest(sizes, capacity):
    """Bins of an optimal packing, by trying every bin for every piece."""
    best = [len(sizes)]

    def go(i, room):
        if len(room) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(room)
            return
        for k in range(len(room)):
            if room[k] >= sizes[i] and room[k] not in room[:k]:
                go(i + 1, [*room[:k], room[k] - sizes[i], *room[k + 1 :]])
        go(i + 1, [*room, capacity - sizes[i]])

    go(0, [])
    return best[0]


def test_packing_against_all_packings():
    rng = np.random.default_rng(5)
    for _ in range(40):
        sizes = np.sort(rng.integers(8, 70, 9))[::-1].copy()
        out = packing.evolve(packing.first_brood(sizes, 100, rng, packing.BROOD), sizes, 100, rng, 20)[0]
        assert len(out) == fewest(sizes.tolist(), 100)


def test_elites_migrate(spark):
    """After an era an island holds its neighbour's elite, so the result is never worse than the best island's."""
    rng = np.random.default_rng(9)
    docs = spark.createDataFrame(rows_of([" ".join(["w"] * int(n)) for n in rng.integers(20, 60, 60)]), SCHEMA)
    bins = [packing.pack(docs, capacity=100, islands=3, eras=e, turns=4).select("bin").distinct().count() for e in (1, 3)]
    assert bins[1] <= bins[0]


def test_genetic_steps_keep_all_pieces():
    rng = np.random.default_rng(0)
    sizes = rng.integers(1, 99, 300)
    brood = packing.first_brood(sizes, 100, rng, 4)
    for bins in [*brood, packing.cross(brood[0], brood[1], sizes, 100, rng), packing.mutate(brood[2], sizes, 100, rng)]:
        assert sorted(i for b in bins for i in b) == list(range(300))
        assert all(sum(sizes[i] for i in b) <= 100 for b in bins)
    out = packing.evolve(brood, sizes, 100, rng, 10)
    assert len(out[0]) <= min(map(len, brood))


def test_crossover_gives_whole_bins():
    sizes = np.array([60, 40, 70, 30, 50, 50])
    a, b = [[0, 1], [2, 3], [4, 5]], [[0, 3], [2], [4, 1], [5]]
    out = packing.cross(a, b, sizes, 100, np.random.default_rng(1))
    assert any(sorted(x) in a for x in map(sorted, out)) and sorted(i for x in out for i in x) == list(range(6))


def test_schedule_deviates_by_less_than_a_block():
    rng = random.Random(2)
    for _ in range(30):
        share = [rng.choice([0, 1, 2, 7, 60, 300]) for _ in range(rng.randint(1, 30))]
        if not sum(share):
            continue
        slots, whole = mixing.schedule(share), sum(share)
        assert sorted(t for s in slots for t in s) == list(range(whole))
        for k, at in zip(share, slots):
            assert len(at) == k
            assert all(j * whole // k <= t < -(-(j + 1) * whole // k) for j, t in enumerate(at))


def mixed(rows, **kw):
    """Serves slot by slot until the mix runs dry."""
    block, period, dry = kw.get("block", mixing.BLOCK), kw.get("period", mixing.PERIOD), kw.get("dry", mixing.DRY)
    by = defaultdict(list)
    for i, text, source in rows:
        by[source].append((md5(str(i).encode()).hexdigest(), i, len(text or "")))
    names = sorted(by, key=lambda s: (s is not None, s))
    total = {s: sum(n for *_, n in by[s]) for s in names}
    want = [int(total[s] ** 0.5) for s in names]
    period = max(period, 10 * len(names))
    share = [max(1, period * w // sum(want)) for w in want] if sum(want) else [1 for _ in names]
    whole, served, place, t = sum(share), [0] * len(names), {}, 0
    blocks = [max(1, -(-total[s] // block)) for s in names]
    ends = {}
    while len(ends) < len(names):
        ready = [(-(-(served[s] + 1) * whole // share[s]), s) for s in range(len(names)) if served[s] * whole // share[s] <= t]
        s = min(ready)[1]
        place[s, served[s]] = t
        served[s] += 1
        if served[s] == blocks[s]:
            ends[s] = t + 1
        t += 1
        for x in range(len(names)):  # a block beyond the last, for empty texts at the end
            place.setdefault((x, blocks[x]), None)
    gone, horizon = 0, 0
    for end, k in sorted((ends[s], share[s]) for s in range(len(names))):
        gone, horizon = gone + k, end
        if gone > dry * whole:
            break
    out = {}
    for s, name in enumerate(names):
        at = 0
        for _, i, n in sorted(by[name]):
            slot = place[s, at // block]
            out[i] = (at // block, slot is not None and slot < horizon)
            at += n
    return out


def test_mixing(spark, texts):
    rows = rows_of(texts)
    docs = spark.createDataFrame(rows, SCHEMA)
    for kw in ({"block": 200, "period": 50}, {"block": 64, "period": 10, "dry": 0.5}, {}):
        want = mixed([(r[0], r[1], r[3]) for r in rows], **kw)
        for per_bucket in (100_000, 5):
            got = {r["doc_id"]: (r["block"], r["selected"]) for r in mixing.mix(docs, per_bucket=per_bucket, **kw).collect()}
            assert got == want


def test_mixing_with_weights(spark, texts):
    docs = spark.createDataFrame(rows_of(texts), SCHEMA)
    got = mixing.mix(docs, {"s0": 3, "s1": 1}, block=50, period=8).where("selected").collect()
    taken = Counter(r["source"] for r in {(r["source"], r["block"]): r for r in got}.values())
    assert "s2" not in taken and abs(taken["s0"] - 3 * taken["s1"]) <= 4


@pytest.fixture(scope="module")
def vocabulary():
    return tokens.Vocabulary()


def best(word, vocabulary):
    """All segmentations, longest first by their score, then by fewer tokens."""
    w = tokens.MARK + word

    def go(at):
        if at == len(w):
            return [(0.0, 0)]
        out = []
        for end in range(at + 1, min(len(w), at + vocabulary.longest) + 1):
            s = vocabulary.scores.get(w[at:end])
            n = 1
            if s is None and end == at + 1:
                n = len(w[at].encode())
                s = vocabulary.unknown * n
            if s is not None:
                out += [(s + a, n + b) for a, b in go(end)]
        return out

    return min(go(0), key=lambda x: (-round(x[0], 9), x[1]))[1]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=("Cs", "Z", "C")), min_size=1, max_size=7), min_size=1, max_size=12, unique=True))
def test_token_counts_of_any_words(words):
    v = tokens.Vocabulary() if not hasattr(tokens, "_kept") else tokens._kept
    tokens._kept = v
    words = [w for w in words if w.split() == [w]]
    if words:
        assert tokens.counts(words, v).tolist() == [best(w, v) for w in words]


def test_token_counts(spark, texts, vocabulary):
    docs = spark.createDataFrame(rows_of([*texts, "x" * 500, None]), SCHEMA)
    got = {r["doc_id"]: (r["n_words"], r["n_tokens"]) for r in tokens.count(docs).collect()}
    for i, t in enumerate([*texts, "x" * 500, None]):
        w = (t or "").split()
        assert got[i] == (len(w), sum(vocabulary.alone(x) for x in w))


def test_token_counts_of_long_and_branching_words(vocabulary):
    rng = random.Random(41)
    stem = "".join(rng.choice("abcdeinrst中é") for _ in range(3000))
    words = [stem[:n] for n in (1, 40, 63, 64, 65, 700, 2999)] + [stem[:n] + "".join(rng.choice("aeéx") for _ in range(m)) for n, m in ((30, 5), (64, 80), (1500, 1), (1500, 9), (2990, 300))]
    words += [prose(rng, 1) for _ in range(200)]
    words = sorted(set(words))
    assert tokens.counts(words, vocabulary).tolist() == [vocabulary.alone(w) for w in words]
    assert tokens.counts(["x" * 200_000], vocabulary).tolist() == [vocabulary.alone("x" * 200_000)]


@settings(max_examples=25, deadline=None)
@given(st.integers(1, 3000), st.integers(0, 1 << 40))
def test_permutation(n, seed):
    x = np.arange(n)
    p = sharding.permute(x, n, seed)
    assert sorted(p.tolist()) == x.tolist()
    assert sharding.unpermute(p, n, seed).tolist() == x.tolist()


def test_shards(spark, texts):
    docs = spark.createDataFrame(rows_of(texts), SCHEMA)
    for per_bucket in (100_000, 9):
        got = sharding.numbered(docs, "doc_id", per_bucket).select("doc_id", "row_number").collect()
        assert [r[1] for r in sorted(got)] == list(range(len(texts)))
    out = sharding.shard(docs, shards=7).collect()
    sizes = Counter(r["shard"] for r in out)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    assert all(r["position"] == r["slot"] * 7 + r["shard"] for r in out)
    again = sharding.shard(docs.repartition(3), shards=7).collect()
    assert {r["doc_id"]: r["position"] for r in out} == {r["doc_id"]: r["position"] for r in again}


INSULTS = ["blockhead", "nitwit", "scumbag", "moron", "dimwit"]


def misspelt(rng, w):
    i = rng.randrange(1, len(w) - 2)
    return w[:i] + w[i + 1] + w[i] + w[i + 2 :] if rng.random() < 0.5 else w[:i] + w[i] + w[i:]


LEXICON = prose(random.Random(77), 400).split()


def plain(rng, n):
    """Words of a language: a fixed lexicon, frequent ones first."""
    return " ".join(LEXICON[min(int(rng.expovariate(1 / 60)), 399)] for _ in range(n))


def toxic_texts(rng, n):
    texts, y = [], []
    for i in range(n):
        w = plain(rng, rng.randint(10, 120)).split()
        if i % 3 == 0:
            for _ in range(max(2, len(w) // 20)):
                w.insert(rng.randrange(len(w)), misspelt(rng, rng.choice(INSULTS)))
        texts.append(" ".join(w))
        y.append(int(i % 3 == 0))
    return texts, y


def test_toxicity_on_held_out_misspellings():
    rng = random.Random(8)
    model = toxicity.train(*toxic_texts(rng, 600), steps=150)
    texts, y = toxic_texts(rng, 300)
    said = model.score(texts) > model.cut
    assert said[np.array(y) == 1].mean() > 0.9 and said[np.array(y) == 0].mean() < 0.05
    assert model.score(["", None, "  "]).tolist() == [0, 0, 0]


def test_unknown_words_count_each():
    texts = ["aa bb cc aa", "", "Aa éé"]
    marks = toxicity.word_marks(texts)
    assert len(marks) == 6 and marks[0] == marks[3] == marks[4] and len(set(marks.tolist())) == 4
    table = np.zeros(toxicity.BUCKETS)
    words = [prose(random.Random(i), 1) + str(i) for i in range(30)] * 2
    value, doc = toxicity.word_values([" ".join(words)], table)
    window, _, value = toxicity.distinct(*toxicity.windows(doc), value, toxicity.word_marks([" ".join(words)]))
    runs = [words[:24], words[24:48], words[48:]]
    assert np.bincount(window).tolist() == [len(set(r)) for r in runs] and not value.any()


def test_a_repeated_id_leaves_the_same_row(spark):
    rows = [(1, "a", "en", "s0", 1), (1, "b", "en", "s0", 1), (1, "b", "en", "s0", 1), (2, "c", "en", "s1", 1), (None, "d", "en", "s1", 1)]
    seen = []
    for part in (1, 3):
        docs = spark.createDataFrame(rows[::-1] if part == 3 else rows, SCHEMA).repartition(part)
        seen.append(sorted((r["doc_id"] or 0, r["text"]) for r in common.only_ids(docs, docs.select("doc_id"), "doc_id").collect()))
    assert seen[0] == seen[1] and [x[0] for x in seen[0]] == [0, 1, 2]


def test_toxicity_reads_whole_texts():
    rng = random.Random(8)
    model = toxicity.train(*toxic_texts(rng, 600), steps=150)
    clean = plain(rng, 4000)
    assert model.score([clean])[0] <= model.cut
    assert model.score([clean + " " + " ".join(INSULTS * 3)])[0] > model.cut


def test_pipeline(spark, tmp_path):
    rng = random.Random(12)
    bad, y = toxic_texts(rng, 240)
    shared = "one line for all of them to share"
    texts = [f"{t}\n{shared}" if i % 5 == 0 else t for i, t in enumerate(bad)]
    texts += [texts[1], texts[2] + " tail", None, ""]
    rows = rows_of(texts)
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    told = [(i, 1, v) for i, v in enumerate(y)]
    spark.createDataFrame(told, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "SimHash near-dedup", "mixing sources to target weights", "best-fit packing"]
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    model = toxicity.train(*toxicity.sample(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(told, "doc_id long, quality int, toxic int")))
    kept = [r for r, s in zip(rows, np.round(model.score(texts), 6)) if s <= model.cut]
    assert np.mean([not y[r[0]] for r in kept if r[0] < len(y)]) > 0.9 and len(kept) >= 0.6 * len(rows)
    cleaned = line_dedup([r[1] for r in kept], linededup.MOST)
    kept = [(r[0], t, r[3]) for r, t in zip(kept, cleaned)]
    f = simhash.fingerprints([t for _, t, _ in kept])
    group = closed(len(kept), lambda i, j: f[i].any() and f[j].any() and bits(f[i], f[j]) <= simhash.RADIUS)
    kept = [r for i, r in enumerate(kept) if group[i] == i]
    chosen = mixed(kept)
    kept = [r for r in kept if chosen[r[0]][1]]
    check_packing(got, {i: len((t or "").split()) for i, t, _ in kept}, packing.CAPACITY)
