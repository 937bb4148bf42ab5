"""The joins of shingles, spelling variants and the audit of sources against plain versions."""

import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from conftest import SF, same
from pyspark.sql import functions as F

from inkwell.llm import divergence, shingle_join, spelling

DOCS = "doc_id long, text string"


@pytest.fixture
def many_parts(spark):
    """Small tables stay in as many partitions as a shuffle has."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    yield spark
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def awkward(spark, schema="doc_id long, text string, node long, TEXT_ string, root string"):
    rows = [(1, None, 1, "a", "b"), (2, "", 1, "a", "b"), (2, "", 1, "a", "b"), (3, "one", 2, None, None), (None, "one", 2, None, None), (4, " \t\n", 1, "", "")]
    return spark.createDataFrame(rows, schema)


# --- shingles


def plain_components(rows, percent=85, n=4):
    def shingles(text):
        words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
        return frozenset(tuple(words[k : k + n]) for k in range(max(1, len(words) - n + 1))) if words else frozenset()

    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for a, b in combinations(range(len(rows)), 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            up[root(a)] = root(b)
    least = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root(k)].append(i)
    return sorted(((i, len(sets[k]), min(least[root(k)], default=None)) for k, (i, _) in enumerate(rows)), key=str)


def near_copies(seed, texts=40, vocabulary=300):
    rng = np.random.default_rng(seed)
    word = lambda k: [f"w{x}" for x in rng.integers(0, vocabulary, k)]
    passage, rows = word(60), []
    for _ in range(texts):
        own = word(int(rng.integers(1, 120)))
        if rng.random() < 0.5:
            own = own + passage if rng.random() < 0.5 else passage + own
        rows.append(own)
        for _ in range(int(rng.integers(0, 4))):
            other = list(own)
            for _ in range(int(rng.integers(0, max(2, len(own) // 25)))):
                other[int(rng.integers(0, len(other)))] = "changed"
            rows.append(other + word(int(rng.integers(0, 8))))
    return [(k, " ".join(w)) for k, w in enumerate(rows)]


@pytest.mark.parametrize(("seed", "percent"), [(1, 85), (2, 85), (3, 60), (4, 100)])
def test_similar_texts_equal_all_pairs(spark, seed, percent):
    rows = near_copies(seed)
    got = shingle_join.similar_texts(spark.createDataFrame(rows, DOCS), percent=percent)
    assert sorted(map(tuple, got.collect()), key=str) == plain_components(rows, percent)


def test_similar_texts_in_blocks(many_parts):
    rows = near_copies(5, 60)
    texts = many_parts.createDataFrame([(1, i, t.encode()) for i, t in rows], "root long, node long, text binary")
    for limits in ({"rows": 9}, {"size": 3000}, {}):
        links = [(r.a, r.b) for r in shingle_join.verified_links(texts, 4, 85, **limits).collect()]
        up = {i: i for i, _ in rows}

        def root(k):
            while up[k] != k:
                k = up[k]
            return k

        for a, b in links:
            up[max(root(a), root(b))] = min(root(a), root(b))
        assert {i: root(i) for i, _ in rows} == {i: c for i, _, c in plain_components(rows)}


def test_a_tree_loses_no_similar_set():
    rng = np.random.default_rng(7)
    for percent in (50, 85):
        base = [rng.choice(5000, int(rng.integers(1, 300)), replace=False) for _ in range(30)]
        sets = [np.unique(np.r_[b[rng.random(len(b)) > x], rng.integers(0, 5000, int(len(b) * x / 2))]).astype(np.uint64) for b in base for x in (0, 0.05, 0.1, 0.3)]
        sets = [s if len(s) else np.array([1], np.uint64) for s in sets]
        points = np.stack([np.bincount(shingle_join.group_of(s, 64), minlength=64) for s in sets])
        tree = shingle_join.CountTree(points, percent)
        for k, s in enumerate(sets):
            found = set(tree.near(points[k], np.ones(len(sets), bool)).tolist())
            similar = {j for j, o in enumerate(sets) if 100 * len(np.intersect1d(s, o)) >= percent * len(np.union1d(s, o))}
            assert similar <= found and (percent < 85 or len(found) < len(sets))


def test_points_connect_all_similar_sets():
    rng = np.random.default_rng(11)
    for percent in (40, 85):
        base = [rng.choice(1 << 40, int(rng.integers(1, 400)), replace=False) for _ in range(20)]
        sets = [np.unique(np.r_[b[rng.random(len(b)) >= x], rng.integers(0, 1 << 40, int(len(b) * x))]).astype(np.uint64) for b in base for x in (0, 0.05, 0.08, 0.4)]
        sets = [s for s in sets if len(s)]
        up = list(range(len(sets)))

        def root(k):
            while up[k] != k:
                k = up[k]
            return k

        points = [shingle_join.counted(s) for s in sets]
        assert all((shingle_join.unpacked(shingle_join.packed(k * p)) == k * p).all() for p in points for k in (1, 300))
        for a, b in shingle_join.linked_points(np.arange(len(sets)), points, percent):
            up[root(a)] = root(b)
        for a, b in combinations(range(len(sets)), 2):
            if 100 * len(np.intersect1d(sets[a], sets[b])) >= percent * len(np.union1d(sets[a], sets[b])):
                assert root(a) == root(b)


def test_word_hashes_tell_words_apart(monkeypatch):
    texts = [b"", b"One two  ONE\tthree\x0b", b" ", b"a\x00b ab " * 3, "é É ü".encode(), b"x" * 5000 + b" y"]
    for chunk in (1 << 20, 64):
        monkeypatch.setattr(shingle_join, "CHUNK", chunk)
        got = shingle_join.Words()(texts)
        words = [t.lower().split() for t in texts]
        assert [len(h) for h in got] == [len(w) for w in words]
        pairs = {(w, int(h)) for ws, hs in zip(words, got) for w, h in zip(ws, hs)}
        assert len(pairs) == len({w for w, _ in pairs}) == len({h for _, h in pairs})


def test_similar_texts_of_awkward_tables(spark):
    got = sorted(map(tuple, shingle_join.similar_texts(awkward(spark)).collect()), key=str)
    assert got == sorted([(1, 0, 1), (2, 0, 2), (2, 0, 2), (3, 1, 3), (None, 1, 3), (4, 0, 4)], key=str)
    assert shingle_join.similar_texts(spark.createDataFrame([], DOCS)).count() == 0
    long = " ".join(map(str, range(100_000)))
    got = shingle_join.similar_texts(spark.createDataFrame([(1, long), (2, long + " x"), (3, long[:400_000])], DOCS)).collect()
    assert {r.doc_id: r.component_id for r in got} == {1: 1, 2: 1, 3: 3}


def test_similar_texts_query(spark, duck):
    same(shingle_join.query(spark, SF), duck, shingle_join.ORACLE)


# --- spelling


def plain_variants(counts, times=10):
    def edits(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    near = {w: [v for v in counts if edits(w, v)] for w in counts}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= times * counts[w] else None
    out = []
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, counts[w], len(near[w]), counts.get(form[w])))
    return sorted(out, key=str)


def plain_counts(rows, every=31):
    counts = Counter()
    for i, text in rows:
        run = ""
        for c in (text or "") + " ":
            if "A" <= c <= "Z" or "a" <= c <= "z" or "À" <= c <= "ÿ":
                run += c.lower() if c <= "Z" else c
                continue
            if run:
                h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
                counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % every == 0 else run] += 1
            run = ""
    return {w: n for w, n in counts.items() if n >= 2 and len(w) >= 7}


def test_spelling_query_equals_plain_version(many_parts):
    rows = [(r.doc_id, r.text) for r in many_parts.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    counts = plain_counts(rows)
    got = spelling.query(many_parts, SF)
    assert {r.word: r.n for r in got.collect()} == counts
    # near words by shared deletions, then the plain rules
    by_gap = defaultdict(set)
    for w in counts:
        by_gap[w].add(w)
        for k in range(len(w)):
            by_gap[w[:k] + w[k + 1 :]].add(w)
    close = defaultdict(set)
    for words in by_gap.values():
        for a, b in combinations(words, 2):
            if len(a) != len(b) and abs(len(a) - len(b)) == 1 or len(a) == len(b) and sum(x != y for x, y in zip(a, b)) == 1:
                close[a].add(b)
                close[b].add(a)
    assert {r.word: r.n_near for r in got.collect()} == {w: len(close[w]) for w in counts}


@pytest.mark.parametrize("seed", range(3))
def test_variants_equal_all_pairs(many_parts, seed):
    rng = np.random.default_rng(seed)
    letters = "abé\U0001f600"
    words = {"".join(letters[k] for k in rng.integers(0, 4, int(rng.integers(1, 6)))): int(10 ** rng.uniform(0, 5)) for _ in range(250)}
    got = spelling.variants(many_parts.createDataFrame(list(words.items()), "word string, n long"), 3)
    assert sorted(map(tuple, got.collect()), key=str) == plain_variants(words, 3)


def test_variants_of_long_chains_and_words(many_parts):
    chain = {"a" * 8 + "b" * k: 3 * 10**k for k in range(15)} | {"x" * 5000: 2, "x" * 5001: 50}
    got = spelling.variants(many_parts.createDataFrame(list(chain.items()), "word string, n long")).collect()
    assert {r.word: r.root for r in got} == {w: ("x" * 5001 if w[0] == "x" else "a" * 8 + "b" * 14) for w in chain}


def test_spelling_of_awkward_tables(spark):
    assert spelling.count_words(awkward(spark), letters=1).collect() == [("one", 2)]
    assert spelling.variants(spelling.count_words(spark.createDataFrame([], DOCS))).count() == 0
    words = spark.createDataFrame([(None, 5, 1), ("", 4, 1), ("Word", 3, 1)], "word string, n int, id long")
    assert list(map(tuple, spelling.variants(words).collect())) == [("Word", None, "Word", 3, 0, None)]
    docs = spark.createDataFrame([(None, "Éclairs éclairs ÀÀÀÀÀÀÀ xİxxxxxxx ÀÀÀÀÀÀÀ"), (1, "Àà×÷abc,Àà×÷ABC")], DOCS)
    assert {tuple(r) for r in spelling.count_words(docs).collect()} == {("ÀÀÀÀÀÀÀ", 2), ("Àà×÷abc", 2)}
    with pytest.raises(ValueError):
        spelling.variants(words, 1)


# --- divergence


def test_a_transducer_numbers_its_terms():
    rng = np.random.default_rng(1)
    for size in (0, 1, 5, 400):
        terms = sorted({bytes(rng.choice(list("abcé".encode()), int(rng.integers(1, 7))).astype(np.uint8)) for _ in range(size)})
        t = divergence._unpacked(divergence._packed(divergence.Transducer(terms, np.arange(len(terms)) * 3)))
        asked = [*terms, b"zz", b"a" * 50, b"abcabcabc"]
        starts, ends, numbers = t.stream(np.frombuffer(b" ".join(asked) + b"  ", np.uint8))
        want = {w: 3 * k for k, w in enumerate(terms)}
        assert [b - a for a, b in zip(starts, ends)] == list(map(len, asked)) and numbers.tolist() == [want.get(w, -1) for w in asked]


def test_a_transducer_is_minimal():
    t = divergence.Transducer([b"taps"], np.arange(1))
    assert len(t.final) == 5
    t = divergence.Transducer([b"tap", b"taps", b"top", b"tops"], np.arange(4))
    assert len(t.final) == 5  # the endings of tap and top are one state each


def test_shares_are_exact():
    counts, size = np.array([0, 7, 10**12, 10**15 - 2]), 10**15
    assert divergence.shares(counts, size).tolist() == [1 + 10**9 * (int(c) + 2) // size for c in counts]


@pytest.fixture
def small_docs(spark):
    rng = np.random.default_rng(3)
    words = ["alpha", "Beta", "géant", "zeta-eta", "日本", "x1y", "longer" * 20]
    rows = []
    for k in range(200):
        text = " ".join(words[int(x)] for x in rng.integers(0, len(words), int(rng.integers(0, 30))))
        rows.append((text if k % 17 else None, ["en", "fr", None][k % 3], [None, "s1", "s2", "s3"][int(rng.integers(0, 4))], 1))
    rows += [("rare words only", "de", s, 1) for s in ("s1", "s2")] + [("", "it", "s1", 1)]
    return spark.createDataFrame(rows, "text string, lang string, source string, n long")


def rows_of(sql, docs):
    import duckdb

    c = duckdb.connect()
    c.register("documents", docs.toPandas().astype(object).where(lambda d: d.notna(), None))
    return sorted(map(str, c.execute(sql).fetchall()))


@pytest.mark.parametrize("limits", [{}, {"HEAD": 3}, {"HEAD": 0}, {"BLOCK": 3, "CHUNK": 2, "GATHER": 5, "HEAD": 2}])
def test_divergence_equals_sql(many_parts, small_docs, monkeypatch, limits):
    head = limits.pop("HEAD", divergence.HEAD)
    for name, value in limits.items():
        monkeypatch.setattr(divergence, name, value)
    got = divergence.divergence(small_docs, head=head)
    assert sorted(str(tuple(r)) for r in got.collect()) == rows_of(divergence.ORACLE, small_docs)


def test_divergence_of_awkward_tables(spark):
    schema = "text string, lang string, source string, term string, ord long, block long"
    assert divergence.divergence(spark.createDataFrame([], schema)).count() == 0
    docs = spark.createDataFrame([(None, None, None, "a", 1, 1), ("", None, "s", "a", 1, 1), ("w " * 50_000, None, "s", "a", 1, 1)], schema)
    got = sorted(map(tuple, divergence.divergence(docs).collect()))
    assert got == [("", "", "pair", "s", 0, 1), ("", "s", "pair", "", 0, 1)]
    got = sorted(map(tuple, divergence.divergence(docs.unionAll(docs), least=2).collect()))
    assert [r[:4] for r in got] == [("", "", "pair", "s"), ("", "s", "pair", "")] and got[0][4] == got[1][4] == 0
    assert divergence.divergence(docs.withColumn("SOURCE_", F.lit(1))).count() == 2


def test_divergence_query(spark, duck):
    same(divergence.query(spark, SF), duck, divergence.ORACLE)
