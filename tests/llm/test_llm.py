"""Operators against plain versions, and on awkward tables."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
import xxhash
from conftest import SF, same
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from inkwell.llm import context_mixing, decontamination, language, licenses, packing, pii, quality_model, quality_rules, registry, simhash, token_counts

ODD = "doc_id long, text string, lang string, source string, n_chars long, place long, own int, unit string, _place string"
TEXTS = [None, "", " \n\t", "a", "A b", "the cat sat on the mat " * 30, "the cat sat on the mat " * 30, "x" * 60_000, "été, naïve   日本 — it's 1.2.3.4 a@b.co", "<s> <|endoftext|> ▁ \x00 |"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i if i != 3 else None, t, None if i % 4 == 0 else "en", None, None, 1, 2, "u", None) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows + rows[5:7], ODD)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, duck, name):
    same(registry.QUERIES[name](spark, SF), duck, registry.ORACLES[name])


def test_pii_equals_patterns():
    base = [re.compile(x) for x in (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")]

    def good(k, m):
        d = re.sub(r"\D", "", m)
        return [True, k != 1 or all(int(x) <= 255 for x in m.split(".")), 12 <= len(d) <= 19 and pii.luhn(d), 9 <= len(d) <= 15][k]

    rng, anchors = random.Random(1), pii.automaton()
    for _ in range(5000):
        t = "".join(rng.choice("0123456789..@@++--   ()ab%\n") for _ in range(rng.randrange(40)))
        want = sorted((m.start(), k, m.end()) for k, p in enumerate(base) for m in p.finditer(t) if good(k, m[0]))
        assert [x for x in pii.find_spans(t, anchors) if x[1] < pii.N_BASE] == want


@pytest.mark.parametrize(
    "cue, value",
    [
        ("token: ", "eyJhbGciOiJIUzI1NiJ9." + "eyJzdWIiOiIxMjM0NTY3ODkw" * 20 + ".SflKxw_RJSMeKKF2QT4"),
        ("secret=", "a1b2c3d4" * 100),
        ("API_Key: ", "q83vEjRWeJq/83+" * 30 + "A=="),
        ("password: ", "x/4111111111111111+tail/of1the2key=="),
        ("account: my.token=", "abc12345"),
        ("token=abc.secret: ", "xyz12345"),
        ("Tax ID: ", "12-3456789"),
        ("Customer ID: ", "c-123456"),
        ("National ID: ", "ab123456"),
        ("\u0130 tOkEn: ", "abc12345"),
    ],
)
def test_pii_values_to_their_end(cue, value):
    text = f"see {cue}{value} end"
    at = text.index(value)
    assert (at, pii.KINDS.index("account"), at + len(value)) in pii.find_spans(text, pii.automaton())


def test_pii_extras_and_redaction(spark, odd):
    kinds = [pii.KINDS[k] for _, k, _ in pii.find_spans("see https://a.org/x 12 Main Street iban GB82 WEST 1234 5698 7654 32", pii.automaton())]
    assert kinds == ["url", "address", "account"]
    rows = pii.redact_pii(odd).collect()
    assert len(rows) == 12 and any("[IP]" in (r.text or "") and "[EMAIL]" in r.text for r in rows)
    assert pii.find_pii(odd).where("doc_id = 0").first().base_sha256 == hashlib.sha256(b"").hexdigest()


def test_token_counts(spark, odd):
    model = sentencepiece.SentencePieceProcessor(model_file=P.path(token_counts.MODEL))
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.n_bytes) for r in token_counts.count_tokens(odd, P.path(token_counts.MODEL)).collect())
    want = sorted((r.doc_id is None, r.doc_id or 0, len(model.encode(r.text or "")), len((r.text or "").encode())) for r in odd.collect())
    assert got == want


def test_simhash_groups(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()

    def plain(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        s = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    prints = np.array([plain(r.text) for r in rows], np.uint64)
    root = np.arange(len(rows))
    for _ in range(len(rows)):
        before = root.copy()
        for i, j in np.argwhere(np.bitwise_count(prints[:, None] ^ prints) <= 3):
            root[i] = root[j] = min(root[i], root[j])
        if (before == root).all():
            break
    want = {r.doc_id: (f"{int(p):016x}", rows[root[i]].doc_id) for i, (r, p) in enumerate(zip(rows, prints))}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.query(spark, SF).collect()} == want


def test_near_bits_meet(spark):
    rng = random.Random(2)
    prints = [rng.getrandbits(64) for _ in range(60)]
    prints += [p ^ sum(1 << b for b in rng.sample(range(64), 1 + i % 4)) for i, p in enumerate(prints)]
    top = [rng.getrandbits(64) for _ in range(60)]
    prints += top + [p ^ 1 << 63 ^ sum(1 << b for b in rng.sample(range(63), i % 4)) for i, p in enumerate(top)]
    signed = [(p - (1 << 64) if p >> 63 else p, i) for i, p in enumerate(prints)]
    df = spark.createDataFrame(signed, "fp long, least long")
    from pyspark.sql import functions as F

    for block in (4096, 2):
        got = {tuple(sorted(r)) for r in simhash.links(simhash.index_rows(df).withColumn("lane", F.col("fp")), "fp", ["lane"], 3, block).collect()}
        want = {tuple(sorted((a[0], b[0]))) for a in signed for b in signed if a < b and bin((a[0] ^ b[0]) & (1 << 64) - 1).count("1") <= 3}
        assert got == want


def test_decontamination_recall():
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefg") for _ in range(rng.randrange(2, 8))) for _ in range(3000)]
    texts = [" ".join(rng.choices(words, k=rng.randrange(12, 60))) for _ in range(60)]
    items = decontamination.Items(list(enumerate(texts)), 0.8, 0.99)
    found = true = 0
    for i, t in enumerate(texts):
        changed = [rng.choice(words) if rng.random() < 0.12 else w for w in t.split()]
        doc = rng.choices(words, k=40) + changed + rng.choices(words, k=40)
        if decontamination.distance_within(t, " ".join(doc), items.most[i]) is not None:
            true += 1
            found += i in {m[1] for m in items.matches([[w.encode() for w in doc]])}
    assert true > 40 and found >= 0.95 * true
    assert items.matches([[w.encode() for w in rng.choices(words, k=500)]]) == []


def test_decontamination_finds_all_within_the_bound():
    rng = random.Random(5)
    draw = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    texts = ["".join(rng.choice("abcdefghijklmnopq") for _ in range(5)) + " " + draw(rng.choice((2, 9, 14, 30, 63, 64, 65, 150, 300))) + "z" for _ in range(60)] + ["a", "abcdef"]
    items = decontamination.Items(list(enumerate(texts)), 0.8, recall=1.0)
    docs = []
    for i, t in enumerate(items.texts):  # as many changes as the bound allows: spread evenly, at random places, or in one block
        kind, most = i % 3, int(items.most[i])
        at = [rng.sample(range(len(t)), most), range(4, 5 * most, 5), range(most)][kind]
        new = "".join(rng.choice(("#", "", c + "#")) if k in set(at) else c for k, c in enumerate(t))
        docs.append((draw(rng.randrange(200)) + " " + new + " " + draw(rng.randrange(200))).encode().split())
    got = {m[:3] for m in items.matches(docs)}
    want = set()
    for d, words in enumerate(docs):
        for i, t in enumerate(items.texts):
            far = decontamination.distance_within(t, b" ".join(words).decode(), items.most[i])
            want |= {(d, i, far)} if far is not None else set()
    assert got == want and len({d for d, i, _ in want if d == i}) > 50


@pytest.mark.parametrize("low, high", [(1, 2), (3, 6), (7, 13), (14, 19), (20, 59)])
def test_decontamination_recall_by_size(low, high):
    rng, letters = random.Random(low), "etaoinshrdlucmfw"
    words = ["".join(rng.choices(letters, k=rng.randint(2, 8))) for _ in range(3000)]
    texts = [" ".join(rng.choices(words, k=rng.randint(low, high))) for _ in range(80)]
    items = decontamination.Items(list(enumerate(texts)))

    def edited(text, rate, kinds):
        out = list(text)
        for at in sorted(rng.sample(range(len(out)), int(rate * len(out))), reverse=True):
            kind = rng.choice(kinds)
            out[at : at + (kind != "insert")] = [] if kind == "delete" else [rng.choice(letters)]
        return "".join(out)

    every = ("replace", "insert", "delete")
    for rate, kinds, least in ((0, every, 1), (0.05, every[:1], 0.98), (0.12, every[:1], 0.98), (0.12, every, 0.98), (0.2, every[:1], 0.9), (0.2, every, 0.9)):
        docs = [f"{' '.join(rng.choices(words, k=50))} {edited(t, rate, kinds)} {' '.join(rng.choices(words, k=50))}".encode().split() for t in texts]
        found = {m[:2] for m in items.matches(docs)}
        true = [i for i, d in enumerate(docs) if decontamination.distance_within(texts[i], b" ".join(d).decode(), int(items.most[i])) is not None]
        assert len(true) >= 0.9 * len(texts) and sum((i, i) in found for i in true) >= least * len(true), rate


def test_decontamination_typo_in_each_word():
    words = "several independent reviewers described careful experiments concerning distributed evaluation procedures between laboratories throughout twenty participating countries".split()
    typos = [w[: len(w) // 2] + "#" + w[len(w) // 2 + 1 :] for w in words]
    items = decontamination.Items([(7, " ".join(words))], 0.8, 0.99)
    assert [m[:3] for m in items.matches([[w.encode() for w in ["before", *typos, "after"]]])] == [(0, 0, len(words))]


def test_edit_distance():
    def plain(item, text):
        row = [0] * (len(text) + 1)
        for i, a in enumerate(item, 1):
            row, last = [i], row
            for j, b in enumerate(text, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (a != b)))
        return min(row)

    rng = random.Random(4)
    for _ in range(400):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(1, 14))) for _ in range(2))
        assert decontamination.distance_within(a, b, 99) == plain(a, b)


def test_packing(spark, odd):
    tokenizer = Tokenizer.from_file(P.path(packing.VOCABULARY))
    rows = [r.asDict() for r in packing.pack(odd, P.path(packing.VOCABULARY)).collect()]
    want = sorted(zlib.crc32(np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1][:2048], "<u4").tobytes()) for r in odd.collect())
    assert sorted(r["ids_crc32"] for r in rows if r["start"] == 0) == want
    fill = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert fill.get(r["sequence_id"], 0) == r["offset"]
        fill[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(fill.values()) <= 2048


def test_patterns_meet_demand():
    rng = np.random.default_rng(5)
    sizes = np.unique(rng.integers(1, 257, 120))
    demand = rng.integers(1, 400, len(sizes))
    patterns = packing.solve_patterns(sizes, demand, 256)
    assert (sum(c * n for c, n in patterns) == demand).all() and all((c * sizes).sum() <= 256 for c, _ in patterns)
    assert sum(n for _, n in patterns) <= 1.02 * (sizes * demand).sum() / 256 + 5


def test_models_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    pred = language.identify(docs, language.train(docs)).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in pred) >= 0.98 * len(pred)
    scored = quality_model.score(docs, quality_model.train(docs, labels)).where("held_out").join(labels, "doc_id").collect()
    good, bad = ([r.score for r in scored if r.quality == q] for q in (1, 0))
    assert sum((g > b) + 0.5 * (g == b) for g in good for b in bad) >= 0.95 * len(good) * len(bad)


def test_language_model(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.collect()
    held = lambda r: zlib.crc32(str(r.doc_id).encode()) % 10 == 0
    from collections import Counter

    count = Counter(w for r in rows if not held(r) for w in context_mixing.words_of(r.text.encode()))
    below = count.total() + 0.1 * (len(count) + 1)
    got = {r.doc_id: r for r in context_mixing.score(docs, bits=12).collect()}
    for r in rows:
        words = context_mixing.words_of(r.text.encode())
        g = got[r.doc_id]
        assert abs(g.base_score - sum(np.log10((count[w] + 0.1) / below) for w in words)) < 1e-6
        assert (g.n_tokens, g.n_known, g.held_out) == (len(words), sum(count[w] > 0 for w in words), held(r)) and g.score < 0


def test_word_probabilities_are_at_most_one():
    words = [bytes([a]) for a in range(97, 123)] + [b""]
    code = context_mixing.Code(np.ones(257))
    mixer = context_mixing.Mixer(code, np.zeros((2, context_mixing.spans(8)[-1]), np.int8), 8)
    assert (10 ** mixer.log10(words)).sum() < 1


def test_awkward_tables(spark, odd):
    empty = odd.limit(0)
    labels = spark.createDataFrame([(5, 1, 0), (6, 0, 0), (None, 1, 0), (5, None, None)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(1, "the cat sat on the mat the cat sat on the mat"), (2, None), (None, " ")], "item_id long, text string")
    for docs, n in ((odd, 12), (empty, 0)):
        assert simhash.near_duplicates(docs).count() == n
        assert simhash.similar_groups(docs).count() == n
        assert language.identify(docs, language.train(docs)).count() == n
        assert quality_model.score(docs, quality_model.train(docs, labels)).count() == n
        assert quality_rules.apply_policy(quality_rules.evaluate_rules(docs)).count() == n
        assert context_mixing.score(docs, bits=10).count() == n
        assert decontamination.find_leaks(docs, items).count() == (4 if n else 0)
        assert decontamination.drop_leaks(docs, items).columns == docs.columns
        assert pii.find_pii(docs).count() == n and pii.redact_pii(docs).count() == n
        assert token_counts.count_tokens(docs, P.path(token_counts.MODEL)).count() == n
        assert licenses.scan_licenses(docs.withColumn("path", F.col("source")), "doc_id").count() == n
    assert packing.pack(empty, P.path(packing.VOCABULARY)).count() == 0
    assert quality_rules.ablations(quality_rules.evaluate_rules(odd)).count() == len(quality_rules.RULES)


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {r.doc_id for r in quality_rules.apply_policy(quality_rules.evaluate_rules(docs)).where("kept").collect()}
    ruled = corpus_pipeline.STAGES[0][1](spark, docs, SF)
    assert {r.doc_id for r in ruled.collect()} == kept and ruled.columns == docs.columns
    once = corpus_pipeline.STAGES[1][1](spark, ruled, SF)
    texts = [r.text for r in once.collect()]
    assert len(texts) == len(set(texts))
    items = [" ".join(r.text.lower().split()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = corpus_pipeline.STAGES[2][1](spark, once, SF).collect()
    assert not any(i in " ".join(r.text.lower().split()) for r in clean for i in items)
    assert len(clean) == sum(not any(i in " ".join(t.lower().split()) for i in items) for t in texts)
    assert corpus_pipeline.run(spark, SF).select("doc_id").distinct().count() == len(clean)


def plain_set(text, n=5):
    w = text.lower().split()
    return {" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))}


def jaccard(a, b):
    return len(a & b) / len(a | b)


def test_similar_groups_equal_brute_force(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8))) for _ in range(2000)]
    texts = []
    for k in range(150):
        base = rng.choices(words, k=rng.randrange(60, 400))
        texts.append(" ".join(base))
        if k % 2:
            texts.append(" ".join(rng.choice(words) if rng.random() < 0.01 * (k % 6) else w for w in base))
        else:
            more = rng.choices(words, k=int(len(base) * 0.05 * (k % 8)))
            texts.append(" ".join(base + more))
    chain = rng.choices(words, k=200)
    for k in range(30):
        texts.append(" ".join(chain := chain[4:] + rng.choices(words, k=4)))
    texts += texts[:5] + ["", " "]
    sets = [plain_set(t) for t in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(docs).collect()}
    assert len(got) == len(texts)
    root, near = list(range(len(texts))), 0
    for i in range(len(texts)):
        for j in range(i):
            if jaccard(sets[i], sets[j]) >= 0.8:
                near += 1
                root = [min(root[i], root[j]) if x in (root[i], root[j]) else x for x in root]
    met = sum(got[i] == got[r] for i, r in enumerate(root) if r != i)
    assert near > 100 and met >= 0.95 * sum(r != i for i, r in enumerate(root))
    assert all(root[i] == root[c] for i, c in got.items())


def test_links_of_sets_in_blocks(spark):
    rng = random.Random(5)
    sets = [rng.sample(range(40), rng.randrange(1, 12)) for _ in range(20)]
    sets += [sorted(set(s[: max(1, len(s) - i % 3)]) | {50 + i % 2}) for i, s in enumerate(sets)]
    rows = [(i % 2, i, np.sort(np.array(s, "<u8")).tobytes()) for i, s in enumerate(sets)]
    df = spark.createDataFrame(rows, "root long, node long, shingles binary")

    def groups(pairs):
        root = list(range(len(sets)))
        for a, b in pairs:
            root = [min(root[a], root[b]) if x in (root[a], root[b]) else x for x in root]
        return root

    want = [(i, j) for i in range(len(sets)) for j in range(i) if i % 2 == j % 2 and jaccard(set(sets[i]), set(sets[j])) >= 0.6]
    assert want
    for limit in (1024, 3):
        assert groups(simhash.links_of_sets(df, 0.6, limit).collect()) == groups(want)


def test_same_ids_of_different_texts_stay(spark):
    rng = random.Random(6)
    texts = [" ".join(str(rng.random()) for _ in range(40)) for _ in range(3)]
    rows = [(1, texts[0]), (1, texts[1]), (None, texts[2]), (None, texts[0]), (1, texts[0])]
    kept = simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, texts.index(r.text)) for r in kept) == [(0, 2), (1, 0), (1, 1)]


def test_similar_index_meets_what_it_says(spark):
    rng = random.Random(6)
    width, distance = simhash.SEGMENT_BITS, 40
    rows = []
    for _ in range(40):  # pairs that differ in one to four bits of each segment, so that few segments meet
        a = [rng.getrandbits(63) for _ in range(4)]
        b = list(a)
        for lane in range(4):
            for s in range(3):
                for bit in rng.sample(range(width), rng.choice((2, 3, 3, 4, 4, 4, 4, 4, 4, 4, 4))):
                    b[lane] ^= 1 << (s * width + bit)
        rows += [a, b]
    names = [f"p{p}_l{k}" for p in range(2) for k in range(2)]
    prints = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "node long, " + ", ".join(f"{n} long" for n in names))
    for bits in (12, 15, 21):
        low = width - bits

        def meets(x, y):
            for lane in range(4):
                for s in range(3):
                    u, v = (z[lane] >> (s * width) & (1 << width) - 1 for z in (x, y))
                    far = u ^ v
                    both = far >> low
                    if far.bit_count() <= 2 and not (both.bit_count() == 2 and (u >> low & both) in (0, both)):
                        return True
            return False

        want = {(i + 1, i) for i in range(0, len(rows), 2) if meets(rows[i], rows[i + 1])}
        for block in (1 << 16, 3):
            got = {(max(r), min(r)) for r in simhash.similar_links(prints, distance, bits, block).collect()}
            assert want <= got and 10 < len(want) < 40
            assert {p for p in got if p[0] // 2 == p[1] // 2} == want


def test_similar_texts_of_few_words(spark):
    rng = random.Random(9)
    texts = []
    for k in range(20):  # a small vocabulary, and a passage of other words behind it
        base = rng.choices([f"k{i}" for i in range(12)], k=2000)
        texts += [" ".join(base), " ".join(base + [f"n{k}x{i}" for i in range(380)])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(docs).collect()}
    near = [i for i in range(0, 40, 2) if jaccard(plain_set(texts[i]), plain_set(texts[i + 1])) >= 0.8]
    assert len(near) >= 18 and sum(got[i] == got[i + 1] == i for i in near) >= 0.9 * len(near)


def test_stages_leave_other_columns_alone(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text, "a", 10, "x", True), (2, text, "b", 20, "y", False), (None, None, "c", 30, "z", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `a.b` string, _MEASURED long, _PLACE string, `odd ``name` boolean")
    items = spark.createDataFrame([(1, "nowhere to be found at all")], "item_id long, text string")
    for stage in (quality_rules.keep, simhash.drop_near_duplicates, lambda d: decontamination.drop_leaks(d, items), pii.redact_pii):
        out = stage(docs)
        assert out.columns == docs.columns
        assert {tuple(r) for r in out.collect()} <= set(rows) and out.where("doc_id = 1").first()[2:] == rows[0][2:]
        assert stage(docs.limit(0)).count() == 0
    assert simhash.drop_near_duplicates(docs).count() == 2 and quality_rules.keep(docs).count() == 2
    places = simhash.similar_groups(docs.withColumnRenamed("a.b", "place"))
    assert {(r.doc_id, r.component_id) for r in places.collect()} == {(1, 1), (2, 1), (None, None)}


def test_leaks_of_a_table_equal_brute_force(spark):
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    every = {(r.doc_id, r.item_id, r.distance) for r in decontamination.find_leaks(docs, items, recall=1.0).collect()}
    found = {(r.doc_id, r.item_id, r.distance) for r in registry.QUERIES["op6_decontamination"](spark, SF).collect()}
    plain = {
        (d.doc_id, i.item_id) for d in docs.collect() for i in items.collect()
        if i.text and " ".join(i.text.lower().split()) in " ".join((d.text or "").lower().split())
    }
    assert every and found <= every and len(found) >= 0.9 * len(every)
    assert plain <= {f[:2] for f in found}


HEADERS = [
    ("Apache-2.0", '# Licensed under the Apache License, Version 2.0 (the "License"); you may not\n# use this file except in compliance with the License. You may obtain a copy of\n# the License at http://www.apache.org/licenses/LICENSE-2.0\n#\nimport os\n'),
    ("MIT", 'Copyright (c) 2020 Kim\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this\nsoftware and associated documentation files (the "Software"), to deal in the Software\nwithout restriction, including\n'),
    ("GPL-3.0", " * This program is free software: you can redistribute it and/or modify\n * it under the terms of the GNU General Public License as published by\n * the Free Software Foundation, either version 3 of the License, or\n * (at your option) any later version.\n"),
    ("GPL-2.0", "// This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by\n// the Free Software Foundation; either version 2 of the License, or (at your option) any later version.\n"),
    ("MIT", "// SPDX-License-Identifier: MIT\nint x;\n"),
    ("GPL-2.0", "/* SPDX-License-Identifier: GPL-2.0-only */\n"),
    ("GPL-3.0", "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>\n Everyone is permitted to copy and distribute verbatim copies\n of this license document, but changing it is not allowed.\n\n                            Preamble\n"),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this\n   list of conditions and the following disclaimer.\n2. Redistributions in binary form must reproduce the above copyright notice,\n   this list of conditions and the following disclaimer in the documentation\n   and/or other materials provided with the distribution.\n\nTHIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\"\n"),
    ("BSD-3-Clause", "// Use of this source code is governed by a BSD-style\n// license that can be found in the LICENSE file.\n"),
    (None, "We license nothing here and speak about other things that come to mind.\n"),
]


def test_licenses_of_usual_headers(spark):
    rows = [(i, f"p{i}/src/a.c", text) for i, (_, text) in enumerate(HEADERS)]
    got = {r.id: r for r in licenses.scan_licenses(spark.createDataFrame(rows, "id long, path string, text string"), "id").collect()}
    for i, (name, _) in enumerate(HEADERS):
        assert got[i].license == name or (name and got[i].in_doubt), (i, name, got[i])
        assert got[i].origin == ("own" if name else "none")
    assert sum(got[i].license == name for i, (name, _) in enumerate(HEADERS)) >= 9


def test_licenses_of_directories_and_awkward_rows(spark):
    mit = HEADERS[1][1]
    rows = [
        (1, "a/LICENSE", mit, "x"), (2, "a/b/c/d.py", "print()", "x"), (3, "a/b/COPYING", HEADERS[6][1], "x"), (4, "a/b/c/e.py", None, "x"), (5, "z/f.py", "", "x"),
        (6, None, mit, "x"), (7, None, "nothing", "x"), (8, "top.py", "x " * 200_000, "x"), (2, "a/b/c/d.py", "print()", "x"), (None, "a/g.py", "x", "x"),
    ]
    docs = spark.createDataFrame(rows, "id long, path string, text string, `a.b` string")
    out = licenses.scan_licenses(docs.withColumn("LICENSE", F.lit(1)), "id")
    got = {r.id: (r.license, r.origin, r.inherited_from) for r in out.collect()}
    assert out.count() == len(rows) and licenses.scan_licenses(docs.limit(0), "id").count() == 0
    assert got == {
        1: ("MIT", "own", None), 2: ("GPL-3.0", "inherited", "a/b"), 3: ("GPL-3.0", "own", None), 4: ("GPL-3.0", "inherited", "a/b"), 5: (None, "none", None),
        6: ("MIT", "own", None), 7: (None, "none", None), 8: (None, "none", None), None: ("MIT", "inherited", "a"),
    }


def test_many_links_and_addresses_take_no_longer_each():
    import time

    def took(n):
        line = "see http://h.example.com/x and mail kim@example.com or http://a@b.example.com/"
        text, began = " ".join([line] * n), time.process_time()
        spans = pii.find_spans(text, pii.automaton())
        return time.process_time() - began, len(spans)

    (short, a), (long, b) = took(2000), took(16000)
    assert b == 8 * a and long < 30 * short + 1


def test_word_counts_beyond_32_bits(spark):
    units = spark.createDataFrame([(b"word", 1 << 34), (b"other", 3), (b"", 1 << 33)], "unit binary, k long")
    code = context_mixing.Code(context_mixing.symbol_counts(units))
    mixer = context_mixing.Mixer(code, context_mixing.corpus_counts(units, code, 12), 12)
    p = 10 ** mixer.log10([b"word", b"other"])
    assert p[0] > 0.2 and p[0] > 100 * p[1]


def test_class_prior_from_positives_and_unlabelled():
    rng = np.random.default_rng(3)
    for prior in (0.2, 0.5, 0.8):
        draw = lambda n, at: rng.normal(at, 1, (n, len(quality_model.FEATURES)))
        ones = int(6000 * prior)
        unlabelled = rng.permutation(np.concatenate([draw(ones, 0.6), draw(6000 - ones, -0.6)]))
        assert abs(quality_model.estimate_prior(draw(3000, 0.6), unlabelled) - prior) < 0.1


def test_packing_pieces_one_by_one(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANKED", 3)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    tokenizer = Tokenizer.from_file(P.path(packing.VOCABULARY))
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    rows = packing.pack(docs, P.path(packing.VOCABULARY)).collect()
    pieces, held = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        held.setdefault(r.sequence_id, []).append(r)
    assert set(pieces) == set(texts)
    for doc, own in pieces.items():
        ids, at = np.array([*tokenizer.encode(texts[doc], add_special_tokens=False).ids, packing.END_ID], "<u4"), 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for own in held.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= packing.LENGTH
    assert sum(r.length for r in rows) >= 0.97 * packing.LENGTH * len(held)


def test_token_counts_of_the_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rng = random.Random(8)
    alphabet = "ab é▁\n\t .,'0日<s> \x00"
    more = ["".join(rng.choices(alphabet, k=rng.randrange(40))) for _ in range(300)]
    every = docs.select("doc_id", "text").union(spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(more)], "doc_id long, text string"))
    library = sentencepiece.SentencePieceProcessor(model_file=P.path(token_counts.MODEL))
    want = {r.doc_id: len(library.encode(r.text or "")) for r in every.collect()}
    assert {r.doc_id: r.n_tokens for r in token_counts.count_tokens(every, P.path(token_counts.MODEL)).collect()} == want


def test_language_equals_plain_decoding(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.collect()
    model = language.train(docs, sample=10**9)
    counts = {k: np.zeros(language.SLOTS) for k in model.languages}
    for r in rows:
        if zlib.crc32(str(r.doc_id).encode()) % 3 != 1 and r.lang is not None and r.text:
            for slot in language.grams(r.text).tolist():
                counts[r.lang][slot] += 1
    plain = language.Model(model.languages, np.array([counts[k] for k in model.languages]))
    assert np.allclose(plain.odds, model.odds) and np.allclose(plain.weight, model.weight)
    got = {r.doc_id: r for r in language.identify(docs, model).collect()}
    for r in rows[:60]:
        slots = language.grams(r.text or "")
        if not language.LETTER.search(r.text or ""):
            assert got[r.doc_id].lang_pred == "und"
            continue
        loss = []
        for word in model.code:
            margins = [sum(float(model.odds[s, b]) for s in slots) / len(slots) ** 0.5 for b in range(len(word))]
            loss.append(sum(w * np.log1p(np.exp(-c * m)) for w, c, m in zip(model.weight, word, margins)))
        assert got[r.doc_id].lang_pred == model.languages[int(np.argmin(loss))]
        assert abs(got[r.doc_id].score - 1 / sum(np.exp(min(loss) - x) for x in loss)) < 1e-3


def test_ablations_equal_counting(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ledger = quality_rules.evaluate_rules(docs)
    masks = [r.fail_mask & quality_rules.POLICIES[2] for r in ledger.collect()]
    got = {r.bit: (r.n_failed, r.n_only) for r in quality_rules.ablations(ledger, 2).collect()}
    assert got == {b: (sum(m >> b & 1 for m in masks), sum(m == 1 << b for m in masks)) for b in quality_rules.RULES}


def test_pipeline_equals_its_parts(spark):
    """The stages one after another, each by a plain version of what it decides."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    left = [r for r in docs.orderBy("doc_id").collect()]
    judged = {r.doc_id: r.kept for r in quality_rules.apply_policy(quality_rules.evaluate_rules(docs)).collect()}
    left = [r for r in left if judged[r.doc_id]]
    sets, root = [plain_set(r.text) for r in left], list(range(len(left)))
    for i in range(len(left)):
        for j in range(i):
            if jaccard(sets[i], sets[j]) >= 0.8:
                root = [min(root[i], root[j]) if x in (root[i], root[j]) else x for x in root]
    left = [r for i, r in enumerate(left) if root[i] == i]
    items = [" ".join((r.text or "").lower().split()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    near = lambda t: any(decontamination.distance_within(i, t, int(0.2 * len(i) + 1e-9)) is not None for i in items if i)
    left = [r for r in left if not near(" ".join(r.text.lower().split()))]
    tokenizer = Tokenizer.from_file(P.path(packing.VOCABULARY))
    want = {}
    for r in left:
        text, at, out = r.text, 0, []
        for s, k, e in pii.find_spans(text, pii.automaton()):
            if s >= at:
                out += [text[at:s], f"[{pii.KINDS[k].upper()}]"]
            at = max(at, e)
        want[r.doc_id] = len(tokenizer.encode("".join([*out, text[at:]]), add_special_tokens=False).ids) + 1
    assert {r.doc_id: r.doc_tokens for r in corpus_pipeline.run(spark, SF).collect()} == want
