"""Each corpus operator against a plain version, on awkward rows and on empty tables."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import corpus as K
from tidepanel.llm import bpe, components, hpylm, jaccard, langid, mixing, quality, sharding, substring, suffix, topk

ROWS = K.documents()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, K.SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], K.SCHEMA)


def same(found, expected) -> None:
    assert Counter(map(tuple, found)) == Counter(expected)


# ---------------------------------------------------------------- quality
def test_base_rules(spark, docs):
    model = quality.ChainModel(np.linspace(-1, 1, quality.N_FEATURES), np.array([[0.5, -0.5], [-0.5, 0.5]]))
    got = quality.label_lines(docs, model).collect()
    expected = []
    for r in ROWS:
        t, w = r[1] or "", K.words(r[1])
        lines = [x for x in t.split("\n") if K.words(x)]
        c = Counter(tuple(w[p : p + 5]) for p in range(len(w) - 4))
        cut = [False] * len(w)
        for p in range(len(w) - 4):
            if c[tuple(w[p : p + 5])] > 1:
                cut[p : p + 5] = [True] * 5
        expected.append((r[0], len(w), sum(map(len, w)), sum(t.count(x) for x in "#*$%&|<>"), len(lines) - len(set(lines)), sum(cut), len(w) < 10 or 100 * sum(cut) > 20 * len(w)))
    same([(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got], expected)
    shares = []
    for r in ROWS:
        lines = [x for x in (r[1] or "").split("\n") if K.words(x)]
        seen: set = set()
        score = []
        for x in lines:
            score.append(float(np.dot(quality.line_features(x.encode(), seen), model.emission)))
            seen.add(x.encode())
        paths = model.viterbi(score) if lines else []
        n = sum(len(K.words(x)) for x in lines)
        shares.append((r[0], round(sum(len(K.words(x)) for x, s in zip(lines, paths) if not s) / n, 9) if n else 0.0))
    same([(r.doc_id, round(r.content_share, 9)) for r in got], shares)
    assert all(r.kept == (not r.base_failed and r.content_share >= 0.5) for r in got)
    bare = quality.label_lines(docs, None).collect()
    assert all(r.content_share is None and r.n_content_words is None and r.kept == (not r.base_failed) for r in bare)


def test_quality_of_empty_tables(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.train(docs, none) is None and quality.train(empty, none) is None
    assert quality.label_lines(empty, None).isEmpty() and quality.common_lines(empty) == frozenset()


def test_likelihood_and_gradient():
    """Against the sum over all paths, and its differences."""
    rng = np.random.default_rng(2)
    lens = np.array([4, 3, 1])
    x, y = rng.normal(size=(8, quality.N_FEATURES)), rng.integers(0, 2, 8)

    def plain(theta: np.ndarray) -> float:
        w, tr, total, at = theta[: quality.N_FEATURES], theta[quality.N_FEATURES :].reshape(2, 2), 0.0, 0
        for n in lens:
            e = x[at : at + n] @ w
            value = lambda path: sum(v for v, s in zip(e, path) if s) + sum(tr[a, b] for a, b in zip(path, path[1:]))
            z = math.log(sum(math.exp(value([(k >> i) & 1 for i in range(n)])) for k in range(1 << n)))
            total += value(y[at : at + n].tolist()) - z
            at += n
        return total / 8 - 0.05 * float(theta @ theta)

    theta = rng.normal(size=quality.N_FEATURES + 4) * 0.3
    value, grad = quality.likelihood(theta, x, y, lens, 0.1)
    assert value == pytest.approx(plain(theta))
    step = 1e-6 * np.eye(len(theta))
    np.testing.assert_allclose(grad, [(plain(theta + d) - plain(theta - d)) / 2e-6 for d in step], atol=1e-6)


def test_common_lines(spark, docs):
    contexts: dict = {}
    for r in ROWS:
        lines = (r[1] or "").split("\n")
        known = [quality.line_hash(x.encode()) if K.words(x) else None for x in lines] if r[1] is not None else []
        for i, h in enumerate(known):
            if h is not None:
                contexts.setdefault(h, set()).add((known[i - 1] if i else None, known[i + 1] if i + 1 < len(known) else None))
    assert quality.common_lines(docs) == {h for h, at in contexts.items() if len(at) >= 3}


def _pages(rng, n: int) -> list[tuple[int, str, int, list[int]]]:
    """Good pages of prose with a footer of some site, bad ones of shouting and tables, with their line states."""
    words = ["plain", "river", "stone", "walks", "under", "light", "small", "house", "winter", "door"]
    prose = lambda: " ".join(rng.choice(words, int(rng.integers(8, 16)))).capitalize() + "."
    junk = lambda: " ".join(x.upper() + "!!" for x in rng.choice(words, 9)) if rng.random() < 0.5 else " | ".join(rng.choice(words, 9)) + " |"
    footers = ["Subscribe to our newsletter", "Share this page with friends", "All rights reserved by the site", "Read more stories like this one"]
    out = []
    for i in range(n):
        bad = i % 3 == 0
        lines, states = [prose() for _ in range(6)], [0] * 6
        if bad:
            lines, states = [prose(), *[junk() for _ in range(5)]], [0] + [1] * 5
        elif i % 2:
            lines, states = lines + [footers[i % 4]], states + [1]
        out.append((i, "\n".join(lines), int(not bad), states))
    return out


def test_lines_are_told_apart_within_a_document(spark):
    """Labels are of documents; mixed pages and footers are split by lines all the same."""
    rng = np.random.default_rng(8)
    pages = _pages(rng, 240)
    table = spark.createDataFrame([p[:2] for p in pages], "doc_id long, text string")
    model = quality.train(table, spark.createDataFrame([(i, q) for i, _, q, _ in pages[:200]], "doc_id long, quality int"))
    mixed = []
    for i in range(0, 40, 2):
        (_, a, _, sa), (_, b, _, sb) = pages[200 + i % 40], pages[3 * i]
        mixed.append(("\n".join([*a.split("\n")[:3], *b.split("\n")[1:4], *a.split("\n")[3:]]), [*sa[:3], *sb[1:4], *sa[3:]]))
    mixed += [(t, s) for _, t, _, s in pages[200:]]
    right = total = 0
    for text, states in mixed:
        rows, _, _ = quality._lines(text.encode(), model.common)
        found = model.viterbi((np.array(rows) @ model.emission).tolist())
        right, total = right + sum(x == y for x, y in zip(found, states)), total + len(states)
    assert right >= 0.95 * total
    share = [r.content_share for r in quality.label_lines(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(mixed[:20])], "doc_id long, text string"), model).collect()]
    assert all(0 < x < 1 for x in share)


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(0)
    for _ in range(50):
        model = quality.ChainModel(np.zeros(1), rng.normal(size=(2, 2)))
        s = rng.normal(size=6).tolist()
        total = lambda path: sum(x for x, y in zip(s, path) if y) + sum(model.transition[a, b] for a, b in zip(path, path[1:]))
        best = max(total([(k >> i) & 1 for i in range(6)]) for k in range(64))
        assert math.isclose(total(model.viterbi(s)), best, abs_tol=1e-9)


def test_chain_learns_boilerplate(spark):
    good = [(i, "A plain line of words here.\nAnother plain line follows it.", 1) for i in range(30)]
    bad = [(100 + i, "BUY!! NOW!! HERE!! BEST!!\na | b | c | d | e |\nx### y$$$ z&&&", 0) for i in range(30)]
    table = spark.createDataFrame([(i, t) for i, t, _ in good + bad], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in good + bad], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.content_share for r in quality.label_lines(table, quality.train(table, labels)).collect()}
    assert all(got[i] == 1.0 for i, _, _ in good) and all(got[i] == 0.0 for i, _, _ in bad)
    assert quality.train(table, labels.where("quality > 5")) is None and quality.train(table, labels.where("quality = 1")) is None
    again = quality.train(table.union(table), labels.union(labels.select("doc_id", F.lit(1), "toxic")))
    assert again.emission.tolist() == quality.train(table, labels).emission.tolist()


# ---------------------------------------------------------------- language
def test_language_profiles(spark, docs, empty):
    known = docs.where("lang is not null")
    model = langid.train(known.where(~langid.held_out(F.col("doc_id"), 4, 2)))
    got = {(r.doc_id, r.lang_pred) for r in langid.predict(docs, model).collect()}
    for r in ROWS:
        pred = [p for i, p in got if i == r[0]]
        if not any(c.isalpha() for c in r[1] or ""):
            assert pred == ["und"]
        elif len(K.words(r[1])) >= 60 and r[0] % 10 != 4 and r[2]:  # those are copies of other texts
            assert pred == [r[2]]
    assert langid.train(empty).langs == [] and langid.predict(docs, langid.train(empty)).where("lang_pred <> 'und'").isEmpty()


def test_out_of_place_distance():
    model = langid.Profiles(["x", "y"], np.array([1, 2, 3]), np.array([[0, 3], [1, 0], [3, 1]]), 3)
    text = "zzz"
    assert langid.Profiles([], np.array([]), np.zeros((0, 0)), 3).predict(text) == ("und", 0.0)
    assert model.predict("123") == ("und", 0.0)
    codes = langid.grams("ab a")
    assert Counter(codes.tolist())[ord("a")] == 2 and (ord("a") << 21 | ord("b")) in codes


def test_predictions_equal_plain_profiles(spark, docs):
    """Counting, ranking and distances by dictionaries of strings."""

    def grams(text: str) -> list[str]:
        words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
        return [f" {w} "[i : i + n] for w in words for n in (1, 2, 3) for i in range(len(w) + 3 - n) if f" {w} "[i : i + n].strip()]

    def ranks(counts: Counter, size: int) -> dict[str, int]:
        code = lambda g: sum(ord(c) << 21 * (len(g) - 1 - i) for i, c in enumerate(g))
        return {g: i for i, g in enumerate(sorted(counts, key=lambda g: (-counts[g], code(g)))[:size])}

    size, by = 60, {}
    for r in ROWS:
        if r[1] is not None and r[2] is not None:
            by.setdefault(r[2], Counter()).update(grams(r[1]))
    profiles = {lang: ranks(c, size) for lang, c in sorted(by.items())}
    expected = []
    for r in ROWS:
        own = ranks(Counter(grams(r[1] or "")), size)
        if not own:
            expected.append((r[0], "und", 0.0))
            continue
        away = {lang: sum(min(abs(p[g] - i), size) if g in p else size for g, i in own.items()) for lang, p in profiles.items()}
        best = min(away, key=lambda lang: (away[lang], lang))
        expected.append((r[0], best, round(1 - away[best] / (size * len(own)), 9)))
    same([(r.doc_id, r.lang_pred, round(r.score, 9)) for r in langid.predict(docs, langid.train(docs, size)).collect()], expected)


# ---------------------------------------------------------------- shards
def test_kd_shards(spark, docs, empty):
    got = sharding.kd_shards(docs, n_shards=5).collect()
    size = lambda t: len((t or "").encode()) + 8
    same([(r.doc_id, r.size, r.text_crc32) for r in got], [(r[0], size(r[1]), zlib.crc32((r[1] or "").encode())) for r in ROWS])
    by: dict[int, list] = {}
    for r in got:
        by.setdefault(r.shard, []).append(r)
        assert r.law == "bytes" and r.grown_shard is None
    assert all(sorted(r.slot for r in rows) == list(range(len(rows))) for rows in by.values())
    assert set(by) <= set(range(5)) and sharding.kd_shards(empty, 5).isEmpty()


def test_kd_shards_equal_plain_splits(spark, docs):
    """Sorting each node's rows along its widest dimension and cutting at the size nearest to the quantile; sizes are near equal."""
    from tidepanel.llm import common as C

    table = C.materialise(docs, "docs")
    n = 6
    rows = [(r.row, r["size"], [(r[f"k{d}"] << sharding.VALUE_BITS) | r.tie for d in range(3)], [r[f"k{d}"] for d in range(3)]) for r in sharding.keyed_metadata(sharding._metadata(table)).collect()]
    want = {}

    def split(part: list, low: int, n: int) -> None:
        if n == 1 or not part:
            want.update((r[0], low) for r in part)
            return
        dim = max(range(3), key=lambda d: (max(r[3][d] for r in part) - min(r[3][d] for r in part), -d))
        target = sum(r[1] for r in part) * (n // 2) / n
        cuts = sorted({r[2][dim] for r in part}) + [1 << 60]
        best = min(cuts, key=lambda c: (abs(sum(r[1] for r in part if r[2][dim] < c) - target), c))
        split([r for r in part if r[2][dim] < best], low, n // 2)
        split([r for r in part if r[2][dim] >= best], low + n // 2, n - n // 2)

    split(rows, 0, n)
    size = {r[0]: r[1] for r in rows}
    found = sharding.kd_shards(table, n).collect()
    by = lambda pairs: Counter(pairs)
    ids = {r.row: (r.doc_id, r["size"], r.text_crc32) for r in sharding._metadata(table).collect()}
    assert by((r.doc_id, r["size"], r.text_crc32, r.shard) for r in found) == by((*ids[row], shard) for row, shard in want.items())
    total = Counter()
    for row, shard in want.items():
        total[shard] += size[row]
    mean = sum(total.values()) / n
    assert all(abs(t - mean) <= max(size.values()) for t in total.values())


def test_kd_shards_split_one_hot_value(spark):
    rows = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("same text").alias("text"), F.lit("s").alias("source"))
    n = [r["count"] for r in sharding.kd_shards(rows, 8).groupBy("shard").count().collect()]
    assert len(n) == 8 and max(n) - min(n) <= 80
    assert sharding.kd_shards(rows, None, target_bytes=17 * 1000).select("shard").distinct().count() == 4


# ---------------------------------------------------------------- joins
def test_jaccard_components(spark, docs, empty):
    got = jaccard.jaccard_components(docs).collect()
    same([(r.doc_id, r.n_shingles, r.component_id) for r in got], K.components(ROWS))
    assert jaccard.jaccard_components(empty).isEmpty()


def test_jaccard_finds_every_link_of_a_dense_family(spark):
    import random

    rng = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(260):
        w = list(base)
        for _ in range(rng.randint(0, 9)):
            w[rng.randrange(len(w))] = f"e{rng.randint(0, 400)}"
        rows.append((i, " ".join(w)))
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    same([(r.doc_id, r.n_shingles, r.component_id) for r in got], K.components(rows))


@pytest.mark.parametrize("size", [1, 2, 3, 4, 5, 7, 8, 9, 12, 16, 17, 33, 70, 150, 600])
def test_schemes_lose_no_link_of_small_sets(size):
    rng = np.random.default_rng(size)
    for _ in range(40):
        a = rng.integers(1, 2**63, size=size).astype(np.uint64)
        keep, add = rng.integers(0, 3 + size // 7), rng.integers(0, 3 + size // 7)
        b = np.concatenate((a[: max(0, size - keep)], rng.integers(1, 2**63, size=add).astype(np.uint64)))
        common = len(np.intersect1d(a, b))
        if not len(b) or 4 * common < 3 * (len(a) + len(b) - common):
            continue
        k = jaccard.Keys(np.concatenate((a, b)), np.array([len(a), len(b)]), np.array([1, 2]), 3, 4)
        # in some scheme that both are in, both share as many keys as they must to stay
        shared = lambda x, y: np.bincount(k.key_owner[(k.key_set == x) & np.isin(k.key, k.key[k.key_set == y])], minlength=len(k.least))
        enough = [{int(o) for o in np.flatnonzero((shared(x, y) >= k.least) & (shared(x, y) > 0))} for x, y in ((0, 1), (1, 0))]
        meet = set(k.key[np.isin(k.key_owner, list(enough[0]))]) & set(k.key[np.isin(k.key_owner, list(enough[1]))])
        assert enough[0] and enough[1] and meet


def test_modes_are_those_of_least_cost():
    """One-deletion neighbourhoods where segments are small, whole subsets where they are not, whatever the band."""
    plans = {1 << i: jaccard.scheme(1 << i, 3, 4) for i in range(17)}
    assert any(x.twos for x in plans.values()) and any(not x.twos for x in plans.values())
    for top, x in plans.items():
        h, ones = 2 * top // 7, x.m - x.twos
        spoilt = h if h <= ones else ones + (h - ones) // 2
        assert x.m - spoilt >= 1 + int(jaccard.SPARE * h)


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001), (5, 5), (None, 3)], "a long, b long")
    labels = {r.node: r.label for r in components.components(links).collect()}
    assert len({labels[i] for i in range(301)}) == 1 and labels[1000] == labels[1001] != labels[0]
    assert components.components(links.limit(0)).isEmpty()


# ---------------------------------------------------------------- mixing
def test_mixture_reaches_its_targets(spark, docs, empty):
    got = mixing.mixture(docs).collect()
    size: Counter = Counter()
    for r in ROWS:
        size[r[3]] += len(K.words(r[1]))
    taken: Counter = Counter()
    target = {}
    for r in got:
        assert r.taken <= 3 * r.size and r.source_size == size[r.source]
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert math.isclose(sum(target.values()), sum(size.values()))
    largest = max(len(K.words(r[1])) for r in ROWS)
    assert all(t <= 3 * size[s] + 1e-6 and abs(taken[s] - t) <= largest for s, t in target.items())
    same([tuple(r) for r in mixing.mixture(docs.repartition(5)).drop("row").collect()], [tuple(r)[:-1] for r in got])
    assert mixing.mixture(empty).isEmpty()


def test_water_level(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 100), ("c", 100), (None, 4)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(rows).collect()}
    # weights 5, 2, 1, 5 of 205: a and null stop at 3 and 12; b and c share the other 190 by 2 to 1
    assert got["a"] == 3 and got[None] == 12 and math.isclose(got["b"], 190 * 2 / 3) and math.isclose(got["c"], 190 / 3)


def test_curriculum_positions_follow_the_schedule(spark, docs):
    rows = mixing.curriculum(docs).collect()
    assert all(0 <= r.position <= 1 for r in rows)
    total = sum(r.taken for r in mixing.mixture(docs).collect())
    assert sum(r["size"] for r in rows) == total
    assert mixing.copies(docs).columns == docs.columns


# ---------------------------------------------------------------- passages
def test_substring_dedup(spark, docs, empty):
    got = substring.substring_dedup(docs, 35).collect()
    cover = K.repeated_cover([r[1] for r in ROWS], 35)
    digest = lambda w, cut: hashlib.sha256(" ".join(x for x, c in zip(w, cut) if not c).encode()).hexdigest()
    same([(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got], [(r[0], len(K.words(r[1])), sum(c), digest(K.words(r[1]), c)) for r, c in zip(ROWS, cover)])
    assert substring.substring_dedup(empty).isEmpty()


def test_repeated_spans(spark, docs, empty):
    got = suffix.repeated_spans(docs, 50).collect()
    expected = []
    for r, cut in zip(ROWS, K.repeated_cover([r[1] for r in ROWS], 50)):
        p = 0
        while p < len(cut):
            q = p
            while q < len(cut) and cut[q]:
                q += 1
            if q > p:
                expected.append((r[0], p, q - p))
            p = max(q, p + 1)
    same([(r.doc_id, r.start_word, r.n_words) for r in got], expected)
    assert suffix.repeated_spans(empty).isEmpty()


def test_remove_repeats_keeps_one_of_each(spark, docs):
    out = suffix.remove_repeats(docs, 50)
    assert out.columns == docs.columns and out.count() == len(ROWS)
    got = out.collect()
    assert not any(any(c) for c in K.repeated_cover([r.text for r in got], 50))
    assert any("shared0 shared1" in (r.text or "") for r in got)
    unchanged = Counter(r[:2] for r, c in zip(ROWS, K.repeated_cover([r[1] for r in ROWS], 50)) if not any(c))
    assert not unchanged - Counter((r.doc_id, r.text) for r in got)
    assert Counter((r.doc_id, r.lang, r.source, r.n_chars, r.a, r.chunk, r.body, r.n_words) for r in got) == Counter((r[0], *r[2:]) for r in ROWS)
    assert suffix.remove_repeats(spark.createDataFrame([], K.SCHEMA)).isEmpty()


@pytest.mark.parametrize(("k", "shortest"), [(3, 1), (20, 4), (60, 60)])
def test_substring_levels_of_any_length(spark, docs, k, shortest):
    """Levels that rule nothing out wrongly, whatever they are."""
    assert all(a <= b <= 2 * a for a, b in zip(substring._levels(k, shortest), substring._levels(k, shortest)[1:]))
    got = substring.substring_dedup(docs.where("doc_id < 60"), k, shortest).collect()
    texts = [r for r in ROWS if r[0] is not None and r[0] < 60]
    same([(r.doc_id, r.n_removed) for r in got], [(r[0], sum(c)) for r, c in zip(texts, K.repeated_cover([r[1] for r in texts], k))])


def test_wide_keys_tell_colliding_hashes_apart():
    """Equal first halves do not make keys equal, in a chunk or between chunks."""
    h, other = np.full(4, 7, dtype=np.uint64), np.array([1, 2, 2, 3], dtype=np.uint64)
    rows = [r for chunk in (0, 1) for b in substring.key_rows(h[chunk:] + np.uint64(0), chunk, 1, other[chunk:]) for r in b.to_pylist()]
    assert [r["n"] for r in rows] == [3, 2] and [np.unpackbits(np.frombuffer(r["twice"], np.uint8), count=r["n"]).tolist() for r in rows] == [[0, 1, 0], [1, 0]]
    u, v, back, n = substring.distinct(h, other)
    assert v.tolist() == [1, 2, 3] and back.tolist() == [0, 1, 1, 2] and n.tolist() == [1, 2, 1]


def test_levels_end_without_candidates(spark):
    rows = spark.createDataFrame([(i, " ".join(f"w{i}x{j}" for j in range(90))) for i in range(20)], "doc_id long, text string")
    assert all(r.n_removed == 0 and r.n_words == 90 for r in substring.substring_dedup(rows).collect())


@pytest.mark.parametrize(("k", "seed"), [(12, 5), (9, 9)])
def test_repeated_spans_of_any_length(spark, docs, k, seed):
    got = suffix.repeated_spans(docs, k, seed).collect()
    cover = K.repeated_cover([r[1] for r in ROWS], k)
    total: Counter = Counter()
    for r in got:
        total[r.doc_id] += r.n_words
    expected: Counter = Counter()
    for r, cut in zip(ROWS, cover):
        expected[r[0]] += sum(cut)
    assert total == +expected


def test_sorted_suffixes_know_their_common_prefixes():
    """The neighbours' common prefix is the longest that any other suffix of the seed shares; sorting is by words."""
    import pyarrow as pa

    from tidepanel.llm import common as C

    rng = np.random.default_rng(4)
    w = C.words([" ".join(map(str, rng.integers(0, 2, 300))).encode(), " ".join(map(str, rng.integers(0, 2, 200))).encode()])
    win = C.Windows(w)
    p = win.starts(3)
    keys = suffix.sort_keys(win, w, p, 3, 11)
    order = np.argsort(keys, kind="stable")
    batch = lambda at: pa.record_batch({"suffix": pa.array(keys[at].tolist(), pa.binary()), "chunk": np.zeros(len(at), np.int64), "code": at, "twice": pa.array([False] * len(at))})
    share = {}
    for _, code, s in suffix.neighbours(iter([batch(order[:100]), batch(order[100:101]), batch(order[101:])])):
        share |= dict(zip(code.tolist(), s.tolist()))
    h = w.h.tolist()

    def prefix(i: int, j: int) -> int:
        n = 0
        while n < 11 and max(i, j) + n < len(h) and i + n < win.end[i] and j + n < win.end[j] and h[i + n] == h[j + n]:
            n += 1
        return n - 3 if n >= 3 else -1

    for k, i in enumerate(p.tolist()):
        if k not in (order[0], order[-1]):
            assert share[k] == max(prefix(i, j) for j in p.tolist() if j != i)


def test_minimisers_hit_every_window():
    from tidepanel.llm import common as C

    rng = np.random.default_rng(1)
    text = " ".join(map(str, rng.integers(0, 30, 400)))
    win = C.Windows(C.words([text.encode()]))
    at = set(suffix.minimisers(win, 25, 50).tolist())
    assert all(any(p in at for p in range(i, i + 26)) for i in range(351))


# ---------------------------------------------------------------- encoding
tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")


def test_bpe_equals_the_library(spark, docs, empty):
    path = public.path("byte_bpe_50k.json")
    t = tokenizers.Tokenizer.from_file(path)
    got = bpe.encode(docs, path, lexicon_words=50).collect()
    expected = []
    for r in ROWS:
        ids = t.encode(r[1] or "", add_special_tokens=False).ids
        text = t.decode(ids, skip_special_tokens=False)
        expected.append((r[0], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest(), text))
    same([(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256, r.decoded) for r in got], expected)
    assert bpe.encode(empty, path).isEmpty()


def test_lexicon_is_minimal_and_exact(tmp_path):
    words = {w.encode(): [i, i + 1] for i, w in enumerate(["tap", "taps", "top", "tops", "stop", "stops", "é", ""])}
    (tmp_path / "x").write_bytes(bpe.compile_lexicon(words))
    lexicon = bpe.Lexicon(str(tmp_path / "x"))
    ask = [*words, b"ta", b"tapx", b"\xc3"]
    assert lexicon.get_many(ask) == [lexicon.get(w) for w in ask] == [*words.values(), None, None, None]
    assert len(lexicon.first) - 1 == 8  # the words share beginnings and ends


def test_merge_many_equals_merge():
    v = bpe.Vocabulary(public.path("byte_bpe_50k.json"))
    pieces = [b"", b"a", b" hello", "straße".encode(), b"ab" * 150, bytes(range(256))] + [str(i * 7919).encode() for i in range(200)]
    assert v.merge_many(pieces) == [v.merge(p) if p else [] for p in pieces]


# ---------------------------------------------------------------- language model
def test_scores(spark, docs, empty):
    held = langid.held_out(F.col("doc_id"), 7, 2)
    got = hpylm.score(docs, held).collect()
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    tokens = [[*K.lowered(r[1]), None] for r in ROWS]
    c = Counter(x for r, w in zip(ROWS, tokens) if not out(r[0]) for x in w)
    n, v = sum(c.values()), len(c)
    base = lambda w: round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), 6)
    same([(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got], [(r[0], out(r[0]), len(w), sum(c[x] > 0 for x in w), n, base(w)) for r, w in zip(ROWS, tokens)])
    for side in (True, False):
        rows = [r for r in got if r.held_out is side]
        assert sum(r.score for r in rows) > sum(r.base_score for r in rows)  # a lower perplexity
    assert hpylm.score(empty, held, 0, 1).isEmpty()
    assert all(r.score == 0.0 for r in hpylm.score(docs, F.lit(True), 0, 1).collect())  # one unseen outcome


def test_predictive_probabilities_sum_to_one(spark):
    """Over all texts of the words and one unknown: with M[y, x] = P(y x) / P(y), the sum is P() + sum over x, y of P(x) (1 - M)^-1[x, y]."""
    rng = np.random.default_rng(3)
    train = [(i, " ".join("abcde"[min(4, k)] for k in rng.geometric(0.5, size=200) - 1)) for i in range(60)]
    letters = [*"abcde", "z"]
    asked = {1000 + i: x for i, x in enumerate(["", *letters, *(f"{y} {x}" for y in letters for x in letters)])}
    rows = spark.createDataFrame([*train, *asked.items()], "doc_id long, text string").repartition(2)
    p = {asked[r.doc_id]: 10**r.score for r in hpylm.score(rows, F.col("doc_id") >= 1000).collect() if r.held_out}
    m = np.array([[p[f"{y} {x}"] / p[y] for x in letters] for y in letters])
    total = p[""] + np.array([p[x] for x in letters]) @ np.linalg.solve(np.eye(6) - m, np.ones(6))
    assert total == pytest.approx(1.0, abs=1e-9)


def test_scores_do_not_depend_on_the_cluster(spark, docs, monkeypatch):
    monkeypatch.setattr(hpylm, "TOKENS_PER_BUCKET", 3000)
    held = langid.held_out(F.col("doc_id"), 7, 2)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    found = []
    for n, parts in (("4", 3), ("16", 7)):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        found.append(sorted((r.doc_id is None, r.doc_id, round(r.score, 9)) for r in hpylm.score(docs.repartition(parts), held, 1, 1).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1]


def _seated_by_hand(texts: list[list[str]], d: float, d0: float, s: float, s0: float, sweeps: int, rng: np.random.Generator):
    """Average predictive probabilities of Gibbs sampling that unseats and seats one customer at a time, tables held one by one."""
    customers = [(u, w) for t in texts for u, w in zip(["<s>", *t], [*t, "</s>"])]
    tables: dict = {}
    m: Counter = Counter()
    room: Counter = Counter()
    for u, w in customers:
        own = tables.setdefault((u, w), [])
        if own:
            own[0] += 1
        else:
            own.append(1)
            m[w] += 1
            room[u] += 1
    count = Counter(customers)
    total = Counter(u for u, _ in customers)
    out: Counter = Counter()
    n = 0
    for step in range(sweeps):
        for u, w in customers:
            own = tables[u, w]
            k = rng.choice(len(own), p=np.array(own) / sum(own))
            own[k] -= 1
            if not own[k]:
                own.pop(k)
                m[w] -= 1
                room[u] -= 1
            new = (s + d * room[u]) * (m[w] - d0) / (s0 + sum(m.values())) if m[w] else 1.0
            odds = np.array([x - d for x in own] + [new])
            k = rng.choice(len(odds), p=odds / odds.sum())
            if k == len(own):
                own.append(1)
                m[w] += 1
                room[u] += 1
            else:
                own[k] += 1
        if step >= sweeps // 10:
            n += 1
            for u in [*total, "?"]:
                for w in [*m, "?"]:
                    parent = (m[w] - d0 if m[w] else s0 + d0 * len(m)) / (s0 + sum(m.values()))
                    out[u, w] += (count[u, w] - d * len(tables.get((u, w), [])) + (s + d * room[u]) * parent) / (s + total[u])
    return {k: v / n for k, v in out.items()}


def test_scores_equal_sampling_by_hand(spark):
    rng = np.random.default_rng(11)
    texts = [["abcd"[min(3, k)] for k in rng.geometric(0.4, size=9) - 1] for _ in range(7)]
    counts = Counter(x for t in texts for x in zip(["<s>", *t], [*t, "</s>"]))
    contexts = Counter(w for _, w in counts)
    ones_twos = lambda c: [sum(x == k for x in c.values()) for k in (1, 2)]
    d, d0 = hpylm._discount(*ones_twos(counts)), hpylm._discount(*ones_twos(contexts))
    p = _seated_by_hand(texts, d, d0, 1.0, 1.0, 2500, rng)
    asked = [[], ["a"], ["d", "d"], ["z"], ["b", "z", "a"], ["c", "a", "b"]]
    rows = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts + asked)], "doc_id long, text string")
    got = {r.doc_id: r.score for r in hpylm.score(rows, F.col("doc_id") >= len(texts), draws=12).collect()}
    known = lambda w: w if w in {*contexts, "<s>"} else "?"
    for i, t in enumerate(asked):
        expected = sum(math.log10(p[known(u), known(w)]) for u, w in zip(["<s>", *t], [*t, "</s>"]))
        assert got[len(texts) + i] == pytest.approx(expected, abs=0.06)


@pytest.mark.parametrize("rate", [0.01, 0.7, 30.0, 3000.0])
def test_table_draws_follow_the_conditional(rate):
    """Against the weights S(c, t) rate^t: at few customers from all seatings of five, beyond EXACT from the recursion."""
    d, n = 0.6, 20_000
    by: Counter = Counter({(1, 1): 1.0})
    for c in range(1, 5):
        for (k, t), w in [x for x in by.items() if x[0][0] == c]:
            by[c + 1, t] += w * (c - d * t)
            by[c + 1, t + 1] += w
    small = np.array([by[5, t] * rate**t for t in range(1, 6)])
    got = np.bincount(hpylm.draw_tables(np.full(n, 5), np.full(n, rate), d, np.random.default_rng(0)), minlength=6)[1:]
    assert np.abs(got / n - small / small.sum()).max() < 0.015
    top = 6 * hpylm.EXACT
    w = hpylm.log_stirling(d, top)[top, 1:] + np.log(rate) * np.arange(1, top + 1)
    w = np.exp(w - w.max())
    w /= w.sum()
    mean = w @ np.arange(1, top + 1)
    spread = math.sqrt(w @ np.arange(1, top + 1) ** 2 - mean**2)
    t = hpylm.draw_tables(np.full(n, top), np.full(n, rate), d, np.random.default_rng(1))
    assert abs(t.mean() - mean) < 0.03 * spread and abs(t.std() / spread - 1) < 0.1 and t.min() >= 1 and t.max() <= top
    first = np.cumsum(np.bincount(t, minlength=top + 1)[1:]) / n
    assert np.abs(first - np.cumsum(w)).max() < 0.02
    assert hpylm.draw_tables(np.array([0, 1]), np.full(2, rate), d, np.random.default_rng(0)).tolist() == [0, 1]


# ---------------------------------------------------------------- search
def test_exact_topk(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=8)], 1) for i in range(700)] + [(1000 + i, [0.5] * 8, 2) for i in range(200)]
    rows += [(2000, None, 1), (2001, [float("nan")] * 8, 1), (2002, [1.0, None] + [1.0] * 6, 1), (2003, [1.0] * 3, 1), (None, [1.0] * 8, 1), (2100, [float("inf")] * 8, 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    got = topk.exact_topk(table, table.where("vec_id % 100 = 0"), 10, shard_rows=128).collect()
    good = [(i, np.floor(1024 * np.array(v))) for i, v, _ in rows if i is not None and v is not None and None not in v and np.isfinite(np.array(v, float)).all()]
    expected = []
    for i, q in good:
        if i % 100 == 0:
            best = sorted((-int(q @ v), j) for j, v in good if j != i and len(v) == len(q))[:10]
            expected += [(i, k + 1, j, -s) for k, (s, j) in enumerate(best)]
    same([(r.query_id, r["rank"], r.vec_id, r.score) for r in got], expected)
    assert topk.exact_topk(table.limit(0), table.limit(0)).isEmpty()
