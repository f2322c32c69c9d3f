"""The registered queries over small tables with nulls, copies and labels, each against something plainer."""

import hashlib
import random
import struct
import zlib

import duckdb
import numpy as np
import pytest

from tallysheaf.llm import exact_dedup, html, media, quality, queries, warc
from tests.llm.test_text_operators import corpus, linked_by_hand, repeats_by_hand, words

ALL = queries.queries()


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Documents (with nulls in every other column and columns of the operators' names), labels and pages."""
    top, rng = tmp_path_factory.mktemp("sf"), random.Random(21)
    rows = corpus(rng)
    at = len(rows)
    for i in range(at, at + 240):
        w = words(rng, rng.randrange(20, 80))
        if i % 3 == 0:
            w[::9] = [rng.choice(["zorgblat", "zorgblatter", "zorgs"]) for _ in w[::9]]
        if i % 4 == 0:
            w = [x + "%%" for x in w]
        rows.append((i, " ".join(w)))
    docs = [(i, t, None, "src", None, 7, "x", 1) for i, t in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, id long, label string, n long").repartition(4).write.parquet(f"{top}/documents.parquet")
    labels = [(i, int(i % 4 != 0), int(i % 3 == 0)) for i, _ in rows[at:]] + [(None, 1, 1), (3, None, None), (10**9, 1, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    told = [(i, f"https://h{i % 3}.example/{i}", f"<html><body><nav>menu</nav><article><h1>T{i}</h1><p>{' '.join(words(rng, 30))} &amp; more</p></article></body></html>") for i in range(40)]
    told += [(90, None, None), (91, "u", ""), (92, None, "<p>x")]
    spark.createDataFrame(told, "page_id long, url string, html string").repartition(3).write.parquet(f"{top}/pages.parquet")
    return str(top), rows, labels, told


def result(spark, tables, n):
    (f,) = [f for name, f in ALL.items() if name.startswith(f"op{n}_")]
    df = f(spark, tables[0])
    return df, df.toPandas()


def kinds(df, **want):
    assert list(df.columns)[: len(want)] == list(want)
    assert {k: df.schema[k].dataType.simpleString() for k in want} == want


def test_op1(spark, tables):
    df, got = result(spark, tables, 1)
    kinds(df, doc_id="bigint", keep_id="bigint", group_size="bigint", kept="boolean", text_sha256="string")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tables[0]}/documents.parquet/*.parquet')")
    want = con.execute(exact_dedup.ORACLE["op1_exact_dedup"]).fetchall()
    names = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    order = [[d[0] for d in con.description].index(c) for c in names]
    assert sorted(tuple(r[i] for i in order) for r in want) == sorted(got[names].itertuples(index=False, name=None))


def test_op2(spark, tables):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    df, got = result(spark, tables, 2)
    kinds(df, doc_id="bigint", n_tokens="bigint", ids_sha256="string", decoded_sha256="string")
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got.itertuples()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for i, t in tables[1]:
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert got[i] == (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))


def test_op3(spark, tables):
    df, got = result(spark, tables, 3)
    kinds(df, doc_id="bigint", n_shingles="bigint", component_id="bigint")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.itertuples()} == linked_by_hand(tables[1], 4, 85, 100)


@pytest.mark.parametrize("n,folds,fold,label", [(4, 5, 0, 2), (7, 3, 1, 1)])
def test_classifiers(spark, tables, tmp_path, n, folds, fold, label):
    """Held-out rows are those of the contract, their labels do not matter, and the label is learnt."""
    df, got = result(spark, tables, n)
    kinds(df, doc_id="bigint", held_out="boolean", score="double", predicted="int")
    out = {i: zlib.crc32(str(i).encode()) % folds == fold for i, _ in tables[1]}
    assert len(got) == len(tables[1]) and all(r.held_out == out[r.doc_id] and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.itertuples())
    truth = {x[0]: x[label] for x in tables[2] if x[0] in out and x[label] is not None}
    hits = [r.predicted == truth[r.doc_id] for r in got.itertuples() if r.held_out and r.doc_id in truth]
    assert np.mean(hits) > 0.9
    turned = [(i, q if i is None or not out.get(i, False) or q is None else 1 - q, t if i is None or not out.get(i, False) or t is None else 1 - t) for i, q, t in tables[2]]
    spark.read.parquet(f"{tables[0]}/documents.parquet").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(turned, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    _, again = result(spark, (str(tmp_path),), n)
    assert np.allclose(got.sort_values("doc_id").score, again.sort_values("doc_id").score, atol=1e-6)


def test_op5(spark, tables):
    df, got = result(spark, tables, 5)
    kinds(df, page_id="bigint", segment="bigint", offset="bigint", length="bigint", record_sha256="string", intact="boolean", replicas="int")
    assert sorted(got.page_id) == sorted(i for i, _, _ in tables[3]) and got.intact.all() and (got.replicas == 2).all()
    for _, own in got.groupby("segment"):
        own = own.sort_values("offset")
        assert list(own.offset) == [0, *np.cumsum(own.length)[:-1]]


def test_op6(spark, tables):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    df, got = result(spark, tables, 6)
    kinds(df, doc_id="bigint", piece="int", start="bigint", length="bigint", ids_crc32="bigint", sequence_id="bigint", offset="bigint")
    for i, t in tables[1]:
        ids = np.array(library.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        own = got[got.doc_id == i].sort_values("piece")
        assert [(r.piece, r.start, r.length, r.ids_crc32) for r in own.itertuples()] == [(n, s, len(ids[s : s + 4096]), zlib.crc32(ids[s : s + 4096].tobytes())) for n, s in enumerate(range(0, len(ids), 4096))]
    for _, own in got.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert list(own.offset) == [0, *np.cumsum(own.length)[:-1]] and own.length.sum() <= 4096


def test_op8(spark, tables):
    df, got = result(spark, tables, 8)
    kinds(df, doc_id="bigint", n_bytes="bigint", payload_bytes="bigint", payload_sha256="string", tail_crc32="bigint", media_bytes="bigint", media_sha256="string", feature="string")
    got = {r.doc_id: r for r in got.itertuples()}
    for i, t in tables[1]:
        raw = (t or "").encode()
        payload = raw + b" " * (-len(raw) % 192 or (0 if raw else 192))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))


def test_op9(spark, tables):
    df, got = result(spark, tables, 9)
    assert df.columns[0] == "doc_id" and df.schema["doc_id"].dataType.simpleString() == "bigint"
    want = {i: span for i, (span, _) in repeats_by_hand(tables[1]).items()}
    found: dict = {}
    for r in got.itertuples():
        found.setdefault(r.doc_id, set()).update(range(r.start_word, r.end_word))
    assert found == want


def test_op10(spark, tables):
    df, got = result(spark, tables, 10)
    kinds(df, page_id="bigint", url="string", text="string", n_chars="bigint")
    assert sorted(got.page_id) == sorted(i for i, _, _ in tables[3])
    by = {r.page_id: r for r in got.itertuples()}
    assert all(by[i].n_chars == len(by[i].text) for i in by) and by[90].text == by[91].text == "" and by[92].text == "x"
    for i, _, h in tables[3][:40]:
        lines = by[i].text.split("\n")
        assert lines[0] == f"T{i}" and lines[1].endswith("& more") and len(lines) == 2
    assert html.main_text(tables[3][0][2], None, set()) == by[0].text


def test_quality_equals_plain_ridge(spark):
    """Partition sums and steps against one matrix of all rows."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(700, len(quality.NAMES)))
    y = (x[:, 0] + 0.3 * x[:, 1] ** 2 > 0.4).astype(int)
    stats = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>").repartition(7)
    labels = spark.createDataFrame([(i, int(v), 0) for i, v in enumerate(y)], "doc_id long, quality int, toxic int")
    model = quality.train(stats, labels)
    later = np.array([zlib.crc32(str(i).encode()) % 5 == 2 for i in range(700)])
    z = np.clip((x - x.mean(0)) / (x.std(0) + 1e-9), -8, 8)
    r = np.random.default_rng(11)
    directions, phases = r.normal(0, 1 / quality.WIDTH, (x.shape[1], quality.FEATURES)), r.uniform(0, 2 * np.pi, quality.FEATURES)
    f = np.concatenate((np.sqrt(2 / quality.FEATURES) * np.cos(z @ directions + phases), np.ones((700, 1))), 1)
    fit, k = f[~later], f.shape[1]
    weights = np.linalg.solve(fit.T @ fit + quality.RIDGE * max(1.0, len(fit)) * np.eye(k) / k, fit.T @ y[~later])
    assert np.allclose(model.features(x) @ model.weights, f @ weights, atol=1e-5)
    raw = np.clip(f[later] @ weights, -0.5, 1.5)
    order = np.argsort(raw)
    means = y[later][order].astype(float)  # rising means by brute force: the max over starts of the min over ends
    best = [max(min(means[a : b + 1].mean() for b in range(i, len(means))) for a in range(i + 1)) for i in range(len(means))]
    assert np.abs(model.score(x[later])[order] - best).mean() < 0.06


def test_quality_ties_and_one_class(spark):
    stats = spark.createDataFrame([(i, [1.0] * len(quality.NAMES)) for i in range(40)], "id long, x array<double>")
    label = lambda f: spark.createDataFrame([(i, f(i), 0) for i in range(40)] + [(3, 1 - f(3), 0)], "doc_id long, quality int, toxic int")
    for f, least, most in ((lambda i: i % 2, 0.2, 0.8), (lambda i: 1, 0.5, 1), (lambda i: 0, 0, 0.5)):
        got = {r["score"] for r in quality.score(stats, quality.train(stats, label(f))).collect()}
        assert len(got) == 1 and least <= got.pop() <= most
    empty = stats.filter("id > 99")
    assert quality.score(empty, quality.train(empty, label(lambda i: 1))).count() == 0


def test_damage_of_either_replica(spark, tables):
    store = warc.stage(warc.write_segments(spark.read.parquet(f"{tables[0]}/pages.parquet")), "store")
    written = warc.stage(warc.index(store), "index")
    rows = written.orderBy("segment", "place").collect()

    def broken(*which):
        out = {r["segment"]: bytearray(r["data"]) for r in store.collect()}
        for n in which:
            out[rows[n]["segment"]][rows[n]["start"] + 12] ^= 1
        return spark.createDataFrame([(r["segment"], r["ids"], r["offsets"], r["lengths"], r["hashes"], bytes(out[r["segment"]])) for r in store.collect()], store.schema)

    number = lambda n: rows[n]["segment"] * warc.RECORDS + rows[n]["place"]
    for a, b in (((), (2, 30)), ((4, 5), (5, 6))):
        got = sorted((r["number"], r["replica"]) for r in warc.damaged(written, [broken(*a), broken(*b)]).collect())
        assert got == sorted([*((number(n), 0) for n in a), *((number(n), 1) for n in b)])


def test_warc_ids_are_unique_and_odd_lengths_are_no_numbers(spark):
    store = warc.write_segments(spark.createDataFrame([(1, "http://e/", "same")] * 9 + [(2, "http://l/", "long " * 500_000)], "page_id long, url string, html string").repartition(2))
    ids = [h["warc-record-id"] for r in store.collect() for _, h, _ in warc.records(bytes(r["data"]))]
    assert len(ids) == 10 and len(set(ids)) == 10
    good = warc.record("http://e/", b"abc")
    for odd in ("²", "-3", "3x", "9" * 30, ""):
        bad = good.replace(b"Content-Length: 3", f"Content-Length: {odd}".encode())
        assert [p for _, _, p in warc.records(bad + good)] == [b"abc"]


def plain_jpeg(data):
    """A decoder of its own, bit by bit: (width, height, blocks of 64 in scan order) of a three-component 4:4:4 file."""
    at, tables, step, size = 2, {}, 0, None
    while True:
        marker, n = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])[0]
        body, at = data[at + 4 : at + 2 + n], at + 2 + n
        if marker == 0xC0:
            size = struct.unpack(">HH", body[1:5])
        elif marker == 0xDD:
            step = struct.unpack(">H", body)[0]
        elif marker == 0xC4:
            i = 0
            while i < len(body):
                kind, counts, code, k = body[i], body[i + 1 : i + 17], 0, i + 17
                tables[kind] = {}
                for length in range(1, 17):
                    for _ in range(counts[length - 1]):
                        tables[kind][(length, code)] = body[k]
                        code, k = code + 1, k + 1
                    code *= 2
                i = k
        elif marker == 0xDA:
            break
    parts, own, i = [], bytearray(), at
    while data[i : i + 2] != b"\xff\xd9":
        if data[i] == 255:
            if data[i + 1] == 0:
                own.append(255)
            else:
                parts.append(bytes(own))
                own = bytearray()
            i += 2
        else:
            own.append(data[i])
            i += 1
    parts.append(bytes(own))
    units, blocks = (size[0] // 8) * (size[1] // 8), []
    for number, part in enumerate(parts):
        bits = "".join(f"{x:08b}" for x in part)
        place, last = 0, [0, 0, 0]

        def symbol(kind):
            nonlocal place
            for length in range(1, 17):
                key = (length, int(bits[place : place + length], 2))
                if key in tables[kind]:
                    place += length
                    return tables[kind][key]
            raise ValueError

        def value(n):
            nonlocal place
            v = int(bits[place : place + n] or "0", 2)
            place += n
            return v if not n or v >= 1 << (n - 1) else v - (1 << n) + 1

        for _ in range(min(step, units - number * step)):
            for c in range(3):
                block = [0] * 64
                last[c] += value(symbol(0))
                block[0], k = last[c], 1
                while k < 64:
                    s = symbol(16)
                    if s == 0:
                        break
                    k += s >> 4
                    block[k] = value(s & 15)
                    k += 1
                blocks.append(block)
    return size[1], size[0], np.array(blocks)


def test_media_equals_a_plain_decoder():
    rng = random.Random(13)
    payloads = [bytes(rng.choice([32, 101, 255, 0, 128, rng.randrange(256)]) for _ in range(192 * n)) for n in (1, 3, 33, 130)]
    for p, data in zip(payloads, media.write_images(payloads)):
        wide, high, blocks = plain_jpeg(data)
        image, found = media.read_images([data])[0]
        assert (image.width, image.height) == (wide, high) and (found == blocks).all()
        assert (blocks + 128).astype(np.uint8).tobytes()[: len(p)] == p == media.payload_of(image, found)
        luminance = np.clip(np.rint(blocks[::3, 0].reshape(high // 8, wide // 8) / 8) + 128, 0, 255)
        assert (media.thumbnail(image, found) == luminance).all()


def test_media_of_a_long_text_in_bounded_memory():
    import tracemalloc

    payload, peaks = (b"long words and more of them " * 60_000)[: 192 * 8000], []
    for n in (1, 6):
        tracemalloc.start()
        (data,) = media.write_images([payload * n])
        image, found = media.read_images([data])[0]
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert media.payload_of(image, found) == payload * n
    assert peaks[1] - peaks[0] < 12 * 5 * len(payload)  # steps are of one size
    bad = bytearray(data)
    bad[len(data) // 2 : len(data) // 2 + 40] = b"\xff\xd9" * 20
    assert media.read_images([bytes(bad), data])[0] is None and media.read_images([bytes(bad), data])[1] is not None
