"""Small cases for each operator on texts: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallysheaf.llm import bpe, components, exact_dedup, jaccard, media, packing, quality, repeats, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, n long, key string, h long, _id long, _h string, _row long"


def frame(spark, rows, parts=3):
    """Documents with further columns whose names the operators use inside."""
    full = [(i, t, "en", "s", None if t is None else len(t), 7, 7, "k", 7, 7, "h", 7) for i, t in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(parts)


def words(rng, n, pool=4000):
    return [f"w{rng.randrange(pool)}" for _ in range(n)]


def corpus(rng):
    base = words(rng, 220)
    rows, i = [], 0

    def add(ws):
        nonlocal i
        rows.append((i, " ".join(ws)))
        i += 1

    for _ in range(40):  # near copies of one text, a few words changed
        w = list(base)
        for _ in range(rng.randrange(0, 9)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        add(w)
    passage = words(rng, 70)
    for _ in range(25):  # one passage in many texts
        add([*words(rng, rng.randrange(5, 90)), *passage, *words(rng, rng.randrange(5, 90))])
    for n in (0, 1, 2, 3, 4, 5, 49, 50, 51, 400):
        add(words(rng, n))
    add(["In."] * 150)
    add(["In."] * 150)
    add([*base[:150], *words(rng, 10)])
    rows += [(i, None), (i + 1, ""), (i + 2, " \t\n"), (i + 3, rows[0][1]), (i + 4, rows[0][1].upper()), (i + 5, "é " * 30)]
    return rows


def sets_of(rows, k):
    out = {}
    for i, t in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out[i] = frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
    return out


def linked_by_hand(rows, k, num, den):
    s = sets_of(rows, k)
    up = {i: i for i in s}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(s)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if s[a] and s[b] and den * len(s[a] & s[b]) >= num * len(s[a] | s[b]):
                x, y = sorted((top(a), top(b)))
                up[y] = x
    return {i: (len(s[i]), top(i)) for i in s}


def test_exact_dedup(spark):
    rows = [(3, "a  b"), (1, "a b"), (2, "a\tb"), (9, None), (8, ""), (5, "x" * 200_000), (6, "x" * 200_000), (7, "y"), (4, "a c"), (7, "y"), (None, "a b")]
    found = {}
    for r in exact_dedup.exact_groups(frame(spark, rows), digest=True).collect():
        found.setdefault(r["id"], []).append(r)
    assert sum(map(len, found.values())) == len(rows)
    assert found[3][0]["keep_id"] == 1 and found[3][0]["group_size"] == 4 and not found[3][0]["kept"]
    assert found[1][0]["kept"] and found[8][0]["kept"] and found[9][0]["keep_id"] == 8 and not found[None][0]["kept"]
    assert found[6][0]["keep_id"] == 5 and found[4][0]["group_size"] == 1
    assert sorted(x["kept"] for x in found[7]) == [False, True]
    assert found[2][0]["full_hash"] == hashlib.sha256(b"a b").hexdigest()
    kept = exact_dedup.keep_first(frame(spark, rows))
    assert kept.columns == frame(spark, rows).columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 4, 5, 7, 8]


def test_exact_dedup_without_false_positives_needed(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "PREFIX", 1)
    rows = [(i, f"a{i % 7}{'z' * (i % 3)}") for i in range(100)]
    by = {}
    for i, t in rows:
        by.setdefault(t, []).append(i)
    for r in exact_dedup.exact_groups(frame(spark, rows)).collect():
        same = by[dict(rows)[r["id"]]]
        assert (r["keep_id"], r["group_size"], r["kept"]) == (min(same), len(same), r["id"] == min(same))


@pytest.mark.parametrize("k,num,den", [(4, 85, 100), (5, 80, 100)])
def test_jaccard_equals_all_pairs(spark, k, num, den):
    rows = corpus(random.Random(k))
    got = {r["id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.linked(frame(spark, rows), k, num, den).collect()}
    assert got == linked_by_hand(rows, k, num, den)


def test_jaccard_rows_that_repeat_and_no_ids(spark):
    text = "a b c d e f g h"
    rows = [(2, text), (2, text), (5, text + " "), (None, text), (6, "q w e r t y")]
    got = sorted(((r["id"], r["component_id"]) for r in jaccard.linked(frame(spark, rows)).collect()), key=str)
    assert got == sorted([(2, 2), (2, 2), (5, 2), (None, None), (6, 6)], key=str)
    kept = jaccard.keep_one(frame(spark, rows))
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted([2, 2, None, 6], key=str)


def test_jaccard_of_ids_with_several_texts(spark):
    a, b, c = ("one two three four five six seven", "alpha beta gamma delta epsilon zeta", "red green blue black white grey pink")
    got = {(r["id"], r["component_id"]) for r in jaccard.linked(frame(spark, [(1, a), (5, a), (5, b), (9, b), (12, c)])).collect()}
    assert got == {(1, 1), (5, 1), (9, 1), (12, 12)}
    rng = random.Random(11)
    for _ in range(1):
        pool = [" ".join(words(rng, 40, 60)) for _ in range(12)]
        pool += [p + " " + q for p in pool[:4] for q in ("x", "x y")]
        rows = [(rng.randrange(25), rng.choice(pool)) for _ in range(45)]
        sets = [(i, *sets_of([(0, t)], 5).values()) for i, t in rows]
        up = {i: i for i, _ in rows}

        def top(x):
            while up[x] != x:
                x = up[x]
            return x

        for i, s in sets:
            for j, t in sets:
                if s and 100 * len(s & t) >= 80 * len(s | t):
                    x, y = sorted((top(i), top(j)))
                    up[y] = x
        got = {(r["id"], r["component_id"]) for r in jaccard.linked(frame(spark, rows)).collect()}
        assert got == {(i, top(i)) for i, _ in rows}


def test_components_of_chains_and_stars(spark):
    rng = random.Random(1)
    pairs = [(i, i + 1) for i in range(0, 60)] + [(100, x) for x in range(101, 140)] + [(200, 201), (201, 202), (200, 202)]
    rng.shuffle(pairs)
    found = {r["id"]: r["comp"] for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert all(found[i] == 0 for i in range(61)) and all(found[i] == 100 for i in range(100, 140)) and found[202] == 200


def repeats_by_hand(rows):
    t = {i: WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), x or "")) for i, x in rows}
    owner = {}
    for i in sorted(t):
        for s in range(len(t[i]) - 49):
            owner.setdefault(tuple(t[i][s : s + 50]), set()).add(i)
    out = {}
    for i, w in t.items():
        span, cut = set(), set()
        for s in range(len(w) - 49):
            who = owner[tuple(w[s : s + 50])]
            if len(who) > 1:
                span |= set(range(s, s + 50))
                if min(who) != i:
                    cut |= set(range(s, s + 50))
        if span:
            out[i] = (span, cut)
    return out


def test_repeats_equal_all_windows(spark):
    rows = corpus(random.Random(5))
    got = {}
    for r in repeats.matches(frame(spark, rows, 5)).collect():
        got[r["id"]] = tuple({x for s in r[c] for x in range(s["start"], s["end"])} for c in ("spans", "cuts"))
    assert got == repeats_by_hand(rows)
    cut = {r["doc_id"]: r["text"] for r in repeats.cut_repeats(frame(spark, rows, 5)).collect()}
    hand = repeats_by_hand(rows)
    for i, t in rows:
        left = [w for n, w in enumerate(WORD.findall(t or "")) if n not in hand.get(i, ((), ()))[1]]
        assert WORD.findall(cut[i] or "") == left
    assert len(cut) == len(rows)


def test_repeats_beyond_the_filter(spark, monkeypatch):
    rows = corpus(random.Random(5))
    monkeypatch.setattr(repeats, "MOST_BITS", 1)
    got = {r["id"]: {x for s in r["spans"] for x in range(s["start"], s["end"])} for r in repeats.matches(frame(spark, rows, 5)).collect()}
    assert got == {i: span for i, (span, _) in repeats_by_hand(rows).items()}


def test_repeats_of_rows_that_repeat(spark):
    text = " ".join(words(random.Random(2), 120))
    assert repeats.matches(frame(spark, [(1, text), (1, text)])).count() == 0
    got = repeats.matches(frame(spark, [(4, text), (None, text)])).collect()
    assert sorted(len(r["cuts"]) for r in got) == [0, 1]


def test_bpe_equals_the_library(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(3)
    texts = ["", None, "aaaa aaaaaaa", "x<|endoftext|>y", "İstanbul ΣΑΣ", "é é　\x1c a", "日本語 ½ ²", "ab" * 3000, "'S don't", "\n\n x \n", "🙂🙂" * 40]
    texts += ["".join(rng.choice("ab é\n1.,'tsŐ ") for _ in range(200)) for _ in range(40)]
    docs = frame(spark, list(enumerate(texts)))
    ids = {r["id"]: r["ids"] for r in bpe.encode(docs).collect()}
    for i, t in enumerate(texts):
        assert ids[i] == library.encode(t or "", add_special_tokens=False).ids, t
    back = {r["id"]: r["text"] for r in bpe.decode(bpe.encode(docs)).collect()}
    assert all(back[i] == library.decode(ids[i], skip_special_tokens=False) for i in ids)
    for r in bpe.round_trip(docs).collect():
        assert r["n_tokens"] == len(ids[r["id"]]) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids[r["id"]])).encode()).hexdigest()


def test_bpe_long_words_merge_alike():
    import public_tokenizers

    model = bpe.ByteBPE(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(4)
    for _ in range(20):
        word = bytes(rng.choice(b"theinga") for _ in range(300))
        assert tuple(model.merge_long(word)) == model.merge_words([word])[0]


def test_packing(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rng = random.Random(6)
    texts = ["", None, "Don't  STOP 12", "ΣΑΣ É é　x", "a<|startoftext|>b", "'s 'tx", "x\x1cy", "word " * 9000] + [" ".join(words(rng, rng.randrange(1, 2000))) for _ in range(60)]
    found = packing.pack(packing.pieces(frame(spark, list(enumerate(texts))), with_ids=True)).toPandas()
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids + [1]
        own = found[found.doc_id == i].sort_values("piece")
        assert b"".join(own["ids"]) == np.array(ids, "<u4").tobytes(), t
        assert list(own.start) == list(range(0, len(ids), 4096)) and all(own.length[:-1] == 4096)
        assert all(zlib.crc32(x) == c for x, c in zip(own["ids"], own.ids_crc32))
    for _, bin_ in found.groupby("sequence_id"):
        bin_ = bin_.sort_values("offset")
        assert list(bin_.offset) == [0, *np.cumsum(bin_.length)[:-1]] and bin_.length.sum() <= 4096
    assert found.sequence_id.nunique() <= -(-found.length.sum() // 4096) + 1


def test_toxic_words_of_few_texts_count():
    """A telling n-gram of five texts counts in a large sample too; one of two texts does not."""
    n, rng = 4000, np.random.default_rng(2)
    labels = np.zeros(n, np.int64)
    labels[:60] = 1
    plain = lambda: rng.choice(np.arange(1000, 1400), 20, replace=False)
    own = lambda i: [100 + i // 5] if i < 60 else [300] if i in (70, 71) else []
    bags = toxicity.Bags()
    for i in range(n):
        ids = np.unique([*own(i), *plain()]).astype("<u2")
        bags.add(ids.tobytes(), np.ones(len(ids), "<f2").tobytes(), int(labels[i]))
    model = toxicity.fit(*bags.arrays())
    assert (model.value[100:112] > np.abs(model.value[1000:1400]).max()).all() and model.value[300] == 0


def test_packing_scores_every_dimension(spark):
    """By default a piece goes where the least is left of tokens, documents and attention cost together."""
    rng = random.Random(4)
    lengths = [rng.randrange(1, 60) for _ in range(300)]
    found = packing.pack(spark.createDataFrame(list(enumerate(lengths)), "doc_id long, length long").coalesce(1), 100).toPandas()
    bins = []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        need = np.array([lengths[i] / 100, 1 / 100, (lengths[i] / 100) ** 2])
        fits = [b for b in bins if (b[0] >= need - 1e-9).all()]
        if not fits:
            bins.append([np.ones(3), []])
        b = min(fits, key=lambda b: ((b[0] - need) ** 2).sum()) if fits else bins[-1]
        b[0] = b[0] - need
        b[1].append(i)
    left = lambda groups: sorted(tuple(sorted((sum(lengths[i] for i in g), len(g), sum(lengths[i] ** 2 for i in g)))) for g in groups)
    assert left(g["doc_id"] for _, g in found.groupby("sequence_id")) == left(b[1] for b in bins)
    assert len(bins) <= -(-sum(lengths) // 100) + 1


def test_word_tokens_that_are_forgotten(monkeypatch):
    """A small memory gives the same ids, and keeps the words in use."""
    monkeypatch.setattr(packing, "REMEMBERED", 40)
    monkeypatch.setattr(packing, "KEPT", 10)
    tokens, rng = packing.WordTokens(packing.default_path()), random.Random(5)
    for n in range(30):
        texts = [" ".join(["the", "of", *(rng.choice("aeiou") + f"x{rng.randrange(99)}é{n}" for _ in range(12)), "the"]) for _ in range(3)]
        assert tokens.encode_batch(texts) == [tokens.whole(t) for t in texts]
    assert "the" in tokens.known and "of" in tokens.known and len(tokens.known) < 40 + 3 * 60


def test_packing_is_not_one_dimensional_and_needs_no_more(spark, monkeypatch):
    """Documents and cost change which bin a piece goes to, over several shards, without more sequences."""
    lengths = np.sort(np.random.default_rng(3).integers(1, 4097, 4000))[::-1]
    one, three = packing.fit(lengths, 4096, 4096, 4096.0**2, (1.0, 0.0, 0.0))[0], packing.fit(lengths, 4096, 4096, 4096.0**2)[0]
    groups = lambda bins: {tuple(sorted(lengths[bins == b])) for b in np.unique(bins)}
    assert groups(one) != groups(three) and three.max() <= one.max() + 1
    monkeypatch.setattr(packing, "SHARD", 500)
    rng = np.random.default_rng(4)
    many = [int(x) for x in np.minimum(4096, rng.lognormal(5, 1.2, 6000)).astype(int) + 1 if x <= 4096]
    found = packing.pack(spark.createDataFrame(list(enumerate(many)), "doc_id long, length long")).toPandas()
    assert len(found) == len(many) and (found.sequence_id // (1 << 32)).nunique() == -(-len(many) // 500)
    for _, own in found.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert list(own.offset) == [0, *np.cumsum(own.length)[:-1]] and own.length.sum() <= 4096
    assert found.sequence_id.nunique() <= sum(many) / 4096 + (found.sequence_id // (1 << 32)).nunique()


def test_packing_of_ties(spark):
    found = packing.pack(spark.createDataFrame([(i % 7, 1000) for i in range(50)], "doc_id long, length long")).toPandas()
    assert found.sequence_id.nunique() == 13 and len(found) == 50 and sorted(found.groupby("sequence_id").length.sum())[1:] == [4000] * 12


def test_packing_holds_every_capacity():
    lengths = np.sort(np.random.default_rng(0).integers(1, 900, 400))[::-1]
    for score in ("norm", "dot"):
        bins, offsets = packing.fit(lengths, 1000, 3, 700_000.0, (1.0, 0.3, 0.3), score)
        for b in np.unique(bins):
            own = lengths[bins == b]
            assert len(own) == 1 or (own.sum() <= 1000 and len(own) <= 3 and (own.astype(float) ** 2).sum() <= 700_000)


def labelled(rng, n):
    clean = ["tree", "river", "stone", "cloud", "light", "green", "walk", "song"]
    rows, labels = [], []
    for i in range(n):
        toxic = i % 3 == 0
        w = [rng.choice(clean) + rng.choice(["", "s", "ing"]) for _ in range(40)]
        if toxic:
            w[rng.randrange(40)] = rng.choice(["zorgblat", "zorgblatter", "zorgblats"])
        rows.append((i, " ".join(w)))
        labels.append((i, int(not toxic), int(toxic)))
    return rows, labels


def test_toxicity_generalises_to_misspellings(spark):
    rows, labels = labelled(random.Random(7), 300)
    model = toxicity.train(frame(spark, rows), spark.createDataFrame([*labels, (None, 1, 1), (5, None, None), (999_999, 1, 1)], "doc_id long, quality int, toxic int"))
    new = [(1000, "tree river stone zorgblatz walk song"), (1001, "tree river stone clouds walk song"), (1002, None), (1003, ""), (1004, "tree " * 50_000)]
    got = {r["id"]: r["score"] for r in toxicity.score(frame(spark, new), model).collect()}
    assert got[1000] > 0.5 > got[1001] and got[1002] == got[1003] and 0 <= got[1004] <= 1
    kept = toxicity.filter_toxic(frame(spark, new), model)
    assert sorted(r["doc_id"] for r in kept.collect()) == [1001, 1002, 1003, 1004] and kept.columns == frame(spark, new).columns


def test_quality_learns_and_survives_no_labels(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(w + "%%%" for w in words(rng, 50)) if i % 4 == 0 else " ".join(words(rng, 50)) + ".") for i in range(400)] + [(400, None), (401, ""), (402, "A!! " * 30_000)]
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(300)], "doc_id long, quality int, toxic int")
    stats = quality.document_statistics(frame(spark, rows))
    got = {r["id"]: r["score"] for r in quality.score(stats, quality.train(stats, labels)).collect()}
    assert len(got) == len(rows) and all(0 <= s <= 1 for s in got.values())
    assert sum((got[i] >= 0.5) == (i % 4 != 0) for i in range(300, 400)) >= 97
    none = quality.score(stats, quality.train(stats, labels.limit(0))).collect()
    assert {r["score"] for r in none} == {0.5}


def test_toxicity_without_anything_to_learn(spark):
    docs = frame(spark, [(i, f"tree river {i}") for i in range(20)] + [(20, None)])
    kinds = "doc_id long, quality int, toxic int"
    for rows, score in (([], 0.5), ([(i, 1, 0) for i in range(9)], None), ([(i, 1, 1) for i in range(9)], None), ([(3, 1, 1), (3, 1, 0)], None)):
        model = toxicity.train(docs, spark.createDataFrame(rows, kinds))
        assert not model.learnt
        found = [r["score"] for r in toxicity.score(docs, model).collect()]
        assert len(found) == 21 and len(set(found)) == 1 and (score is None or found[0] == score)
        assert toxicity.filter_toxic(docs, model).count() == 21
    empty = docs.filter("doc_id > 99")
    model = toxicity.train(empty, spark.createDataFrame([(1, 1, 1)], kinds))
    assert not model.learnt and toxicity.filter_toxic(empty, model).count() == 0


def test_toxicity_sample_is_bounded_in_buckets(spark):
    rows, labels = labelled(random.Random(9), 60)
    docs, labels = frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    bags = toxicity.Bags(10)
    for n in (4, 5, 3, 1):
        bags.add(np.arange(n, dtype="<u2").tobytes(), np.ones(n, "<f2").tobytes(), n % 2)
    assert bags.full and bags.sizes == [4, 5]  # from the first that does not fit on, all stay out
    assert [list(x) for x in bags.arrays()] == [[0, 1, 2, 3, 0, 1, 2, 3, 4], [1] * 9, [0, 4, 9], [0, 1]]
    first = toxicity.Bags(1)
    first.add(np.arange(9, dtype="<u2").tobytes(), np.ones(9, "<f2").tobytes(), 1)
    assert not first.full and first.sizes == [9]  # one text is taken whatever its size
    whole, part = toxicity.train(docs, labels), toxicity.train(docs, labels, entries=9_000)
    assert part.learnt and (whole.value != part.value).any()


def test_toxicity_equals_plain_adam():
    """The batched fit against one that goes text by text."""
    rng, n, d = np.random.default_rng(5), 200, toxicity.DIMENSIONS
    labels = rng.integers(0, 2, n)
    texts = [np.unique(rng.integers(0, 40, 6) + 30 * labels[i]) for i in range(n)]
    bags = toxicity.Bags()
    for ids, y in zip(texts, labels):
        bags.add(ids.astype("<u2").tobytes(), np.full(len(ids), 0.5, "<f2").tobytes(), int(y))
    model = toxicity.fit(*bags.arrays())
    df, pos, k = np.zeros(toxicity.BUCKETS), np.zeros(toxicity.BUCKETS), int(labels.sum())
    for ids, y in zip(texts, labels):
        df[ids] += 1
        pos[ids] += y
    weight = np.where(df >= toxicity.LEAST_TEXTS, np.log((1 + n) / (1 + df)), 0)
    weight *= np.abs(np.tanh(np.log((pos + 0.5) / (k + 1)) - np.log((df - pos + 0.5) / (n - k + 1)))) * toxicity.SCALE
    r = np.random.default_rng(7)
    v, s, b = r.normal(0, 0.1, (toxicity.BUCKETS, d)), r.normal(0, 0.5, (d, 2)), np.array([0, np.log((k + 0.5) / (n - k + 0.5))])
    m = [np.zeros_like(x) for x in (v, s, b)]
    q = [0.0, np.zeros_like(s), np.zeros_like(b)]
    epochs, step = max(toxicity.EPOCHS, -(-toxicity.LEAST_STEPS * toxicity.BATCH // n)), 0
    for epoch in range(epochs):
        rate, order = 0.02 * (1 - epoch / epochs) + 1e-3, r.permutation(n)
        for at in range(0, n, toxicity.BATCH):
            rows, g = order[at : at + toxicity.BATCH], [np.zeros_like(x) for x in (v, s, b)]
            for i in rows:
                h = 0.5 * (v[texts[i]] * weight[texts[i], None]).sum(0)
                e = np.exp(h @ s + b)
                e = e / e.sum()
                e[labels[i]] -= 1
                e /= len(rows)
                g[0][texts[i]] += 0.5 * weight[texts[i], None] * (s @ e)
                g[1] += np.outer(h, e)
                g[2] += e
            step += 1
            for j, x in enumerate((v, s, b)):
                m[j] = 0.9 * m[j] + 0.1 * g[j]
                q[j] = 0.99 * q[j] + 0.01 * ((g[j] ** 2).sum() if j == 0 else g[j] ** 2)
                x -= rate * (toxicity.VECTOR_RATE if j == 0 else 1) * (m[j] / (1 - 0.9**step)) / (np.sqrt(q[j] / (1 - 0.99**step)) + 1e-12)
    value, bias = weight * (v @ (s[:, 1] - s[:, 0])), b[1] - b[0]
    score = lambda m, c: np.array([1 / (1 + np.exp(-(c + 0.5 * m[ids].sum()))) for ids in texts])
    assert np.abs(score(model.value, model.bias) - score(value, bias)).max() < 0.02


def test_isotonic_rises():
    rng = np.random.default_rng(1)
    count = rng.integers(0, 5, 512).astype(float)
    steps = quality.isotonic(np.minimum(count, rng.integers(0, 5, 512)), count)
    assert (np.diff(steps) >= 0).all() and steps.min() > 0 and steps.max() < 1


def test_media_round_trip(spark):
    texts = ["", None, "a", "é€🙂" * 70, "".join(map(chr, range(1, 256))) * 9, "x" * 200_000, "same", "same"]
    found = {r["id"]: r for r in media.from_media(media.to_media(frame(spark, list(enumerate(texts))))).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + b" " * (-len(raw) % 192 or (0 if raw else 192))
        r = found[i]
        assert (r["n_bytes"], r["payload_bytes"]) == (len(raw), len(payload))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-16:])
    assert found[6]["media_sha256"] == found[7]["media_sha256"] and found[6]["feature"] == found[7]["feature"]


def test_media_of_damaged_and_foreign_files():
    payload = bytes(random.Random(9).randrange(256) for _ in range(192 * 9))
    (data,) = media.write_images([payload])
    assert media.payload_of(*media.read_images([data])[0]) == payload
    for bad in (None, b"", b"no image", data[: len(data) // 2], data[:30]):
        assert media.read_images([bad, data])[0] is None
        assert media.read_images([bad, data])[1] is not None
    # Two units with 2 x 2 luminance sampling, all codes "DC size 0" and "end of block": a grey image.
    tables = media.segment(0xC4, media.table_bytes(0, [(1, [0])]) + media.table_bytes(0x10, [(1, [0])]))
    frame_ = media.segment(0xC0, bytes([8, 0, 16, 0, 30, 3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0]))
    scan = media.segment(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0])) + bytes(3) + b"\xff\xd9"
    image, blocks = media.read_images([b"\xff\xd8" + media._HEAD + frame_ + tables + scan])[0]
    assert blocks.shape == (12, 64) and media.thumbnail(image, blocks).shape == (2, 4) and (media.thumbnail(image, blocks) == 128).all()


@pytest.mark.parametrize("run", [
    lambda d: exact_dedup.exact_groups(d), lambda d: bpe.round_trip(d), lambda d: jaccard.linked(d), lambda d: packing.pack(packing.pieces(d)),
    lambda d: media.from_media(media.to_media(d)), lambda d: repeats.matches(d), lambda d: repeats.cut_repeats(d), lambda d: quality.document_statistics(d),
    lambda d: toxicity.score(d, toxicity.Model(np.zeros(toxicity.BUCKETS), 0.0)),
])
def test_empty_tables(spark, run):
    assert run(frame(spark, [(1, "a")]).filter("doc_id > 5")).count() == 0


def test_held_out_is_crc32_of_the_id(spark):
    rows = spark.range(50).select(toxicity.held_out(F.col("id"), 5, 0).alias("h"), "id").collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 5 == 0) for r in rows)
