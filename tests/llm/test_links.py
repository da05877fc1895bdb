"""Joins, components, embeddings, decontamination and archives against brute force."""

import base64
import gzip
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sluice.llm import common, components, decontaminate, embeddings, ngram_join, queries, toxicity, warc
from sluice.llm.common import new_path


def union(ids, links):
    parent = {i: i for i in ids}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}


def test_components(spark):
    draw = random.Random(2)
    links = [(draw.randrange(300), draw.randrange(300)) for _ in range(170)] + [(k, k + 1) for k in range(400, 460)] + [(5, 5)]
    table = spark.createDataFrame(links, "a long, b long").repartition(7)
    found, _ = components.connected(table)
    got = {r["id"]: r["component"] for r in found.collect()}
    want = union({x for p in links for x in p}, links)
    assert got == {k: v for k, v in want.items() if k != v}
    assert components.connected(spark.createDataFrame([], "a long, b long"))[0].count() == 0


# -- what the driver holds ---------------------------------------------------


def test_the_driver_gets_each_part_of_a_bitmap_once(spark, monkeypatch):
    keys, sent = spark.range(0, 1 << 20, 1, 20).select((F.col("id") * 37).alias("key")), []
    plain = type(keys).toLocalIterator
    monkeypatch.setattr(type(keys), "toLocalIterator", lambda self, *a: (sent.append(r["part"]) or r for r in plain(self, *a)))
    held = common.bitmap(keys, "key")
    own = np.arange(1 << 20, dtype=np.int64) * 37
    assert common.in_bitmap(held, own).all()
    assert np.unpackbits(np.frombuffer(held, np.uint8)).sum() == len(np.unique(own % common.FILTER_BITS))
    assert len(sent) == len(set(sent)) > 1


def test_the_driver_gives_memory_back_after_training(spark, monkeypatch):
    done = []
    monkeypatch.setattr(toxicity, "train", lambda texts, labels: done.append("trained") or {"n": len(texts)})
    monkeypatch.setattr(toxicity, "give_back", lambda: done.append("given back"))
    docs = spark.createDataFrame([(k, f"text {k}") for k in range(6)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(6)], "doc_id long, toxic int")
    assert toxicity.fit(docs, labels, F.lit(True)) == {"n": 6} and done == ["trained", "given back"]


def test_common_ngrams_are_gathered_by_one_task(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "COMMON", 3)
    kept = []
    plain = ngram_join.written
    monkeypatch.setattr(ngram_join, "written", lambda df, what: kept.append(what) or plain(df, what))
    texts = [" ".join([*"abcde", *(["p q r s t"] if k % 2 else []), *(["f g h i j"] if k % 3 else []), f"u{k}"]) for k in range(60)]
    found = ngram_join.common(spark.createDataFrame([(t,) for t in texts], "text string").repartition(2), "text", 5)
    assert kept == ["common"] and len(found) == 3
    assert found[-1] == ngram_join.shingles(pa.array(["a b c d e"]), 5, ngram_join.Words())[0][0]


# -- n-gram join -------------------------------------------------------------


def plain_set(text, width):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not words:
        return frozenset()
    width = min(width, len(words))
    return frozenset(tuple(words[k : k + width]) for k in range(len(words) - width + 1))


def corpus(seed):
    draw, out = random.Random(seed), []
    word = lambda: "".join(draw.choice("abcde") for _ in range(draw.randint(2, 5)))
    shared = [word() for _ in range(40)]
    for size in (3, 6, 9, 12, 15, 20, 30, 60, 120, 400):
        base = [word() for _ in range(size)] + (shared if size % 20 == 0 else [])
        for _ in range(14):
            own = list(base)
            for _ in range(draw.randint(0, max(1, size // 25))):
                k = draw.randrange(len(own))
                own[k : k + 1] = draw.choice([[], [word()], [own[k], word()]])
            out.append(draw.choice([" ", "\n", "\t "]).join(own) if draw.random() < 0.8 else " ".join(own).upper())
    return [*out, None, "", "   ", "one two", "ONE  two", *out[:5]]


@pytest.mark.parametrize(("width", "num", "den"), [(4, 85, 100), (5, 80, 100)])
def test_ngram_join_equals_brute_force(spark, monkeypatch, width, num, den):
    monkeypatch.setattr(ngram_join, "CHUNK", 4)
    texts = corpus(width)
    table = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)] + [(None, texts[0], 1)], "doc_id long, text string, component_id long").repartition(5)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.join(table, width, num, den).collect()}
    sets = {k: plain_set(t, width) for k, t in enumerate(texts)}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    want = union(sets, links)
    assert got.pop(None)[1] is None
    assert got == {k: (len(sets[k]), want[k]) for k in sets}


def test_ngram_join_links_short_texts_that_gain_a_word(spark):
    texts = []
    for k in range(40):
        words = [f"w{k}x{i}" for i in range(9 + k % 2)]
        texts += [" ".join(words), " ".join(["more", *words] if k % 4 < 2 else [*words, "more"])]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.join(table, 5, 80, 100).collect()}
    assert got == {k: k // 2 * 2 for k in range(80)}


def test_ngram_join_at_the_very_threshold(spark):
    draw, texts = random.Random(6), []
    for num, n in ((80, 40), (85, 60)):  # sets that share just enough, and one n-gram too few
        for extra in (0, 1):
            for _ in range(12):
                words = [f"t{draw.getrandbits(40)}" for _ in range(n + 3)]
                both = -(-2 * n * num // (100 + num)) - extra  # of two sets of n n-grams
                texts += [" ".join(words), " ".join([f"u{draw.getrandbits(40)}" for _ in range(n - both)] + words[n - both :])]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    for width, num in ((4, 80), (4, 85)):
        got = {r["doc_id"]: r["component_id"] for r in ngram_join.join(table, width, num, 100).collect()}
        sets = [plain_set(t, width) for t in texts]
        want = union(range(len(texts)), [(a, a + 1) for a in range(0, len(texts), 2) if 100 * len(sets[a] & sets[a + 1]) >= num * len(sets[a] | sets[a + 1])])
        assert got == want and 0 < sum(k != v for k, v in want.items()) < len(texts) // 2


@pytest.mark.parametrize(("num", "den"), [(80, 100), (85, 100), (100, 100), (50, 100)])
def test_similar_sets_share_a_prefix_and_pass_the_sketch(num, den):
    draw = random.Random(4)
    order = ngram_join.Order(np.array([draw.getrandbits(64) for _ in range(30)], np.uint64))
    for b in (*range(1, 40), 300, 5000):
        for a in {b, -(-num * b // den), max(1, b - 1)}:
            both = -(-num * (a + b) // (num + den))
            if both <= a and den * both >= num * (a + b - both):
                drawn = np.array([draw.getrandbits(64) for _ in range(a + b - both)], np.uint64)
                drawn[both // 2 : both // 2 + 30] = order.common[: len(drawn[both // 2 : both // 2 + 30])]
                x, y = np.unique(drawn[:a]), np.unique(drawn[a - both :])
                first = [ngram_join.prefix(s, order.ranks(s), num, den) for s in (x, y)]
                assert np.intersect1d(*first).size, (a, b, both)
                apart = sum((p ^ q).bit_count() for p, q in zip(ngram_join.sketch(x), ngram_join.sketch(y), strict=True))
                assert ngram_join.may_link(np.array([a]), np.array([b]), np.array([apart]), num, den)[0]
                assert sorted(np.concatenate(order.fragments(x)).tolist()) == x.tolist()


def test_words_that_hash_alike_under_polynomials_stay_apart(spark):
    thue = [bin(k).count("1") % 2 for k in range(1024)]
    table = spark.createDataFrame([(k, "".join("ab"[x ^ k] for x in thue)) for k in range(2)], "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in ngram_join.join(table).collect()} == {0: 0, 1: 1}


def test_a_document_with_two_texts_has_one_set(spark):
    texts = {k: " ".join(f"{k}w{i}" for i in range(30)) for k in "ab"}
    rows = [(1, texts["a"]), (1, texts["b"]), (1, texts["b"]), (1, ""), (2, texts["a"]), (3, texts["b"])]
    got = ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted((r["doc_id"], r["n_shingles"]) for r in got) == [(1, 0), (1, 26), (1, 26), (1, 26), (2, 26), (3, 26)]
    own = min("ab", key=lambda k: ngram_join.digest(ngram_join.shingles(pa.array([texts[k]]), 5, ngram_join.Words())[0]))
    assert {(r["doc_id"], r["component_id"]) for r in got} == {(1, 1), (2, 1 if own == "a" else 2), (3, 1 if own == "b" else 3)}


def test_ngram_join_of_a_group_whose_least_document_is_far_from_most(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "CHUNK", 5)  # lists are dealt to several chunks
    draw, base = random.Random(9), [f"b{k}" for k in range(60)]
    texts = []
    for k in range(40):
        own = list(base)
        for _ in range(6 if k == 0 else draw.randint(1, 3)):
            own[draw.randrange(60)] = f"x{draw.getrandbits(30)}"
        texts.append(" ".join(own))
    texts.append(" ".join(base * 40))  # a long text
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.join(table, 4, 85, 100).collect()}
    sets = [plain_set(t, 4) for t in texts]
    links = [(a, b) for a in range(len(sets)) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    assert got == union(range(len(texts)), links) and len(set(got.values())) > 2


def test_ngram_join_of_an_empty_table(spark):
    assert ngram_join.join(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# -- embeddings --------------------------------------------------------------


def test_embeddings_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "TILE_ROWS", 16)
    rng = np.random.default_rng(3)
    rows, base = [], rng.normal(size=(30, 24))
    for k in range(240):
        near = base[k % 30] + rng.normal(scale=rng.choice([0, 0.05, 0.15]), size=24)
        rows.append((k, [float(x) for x in near], int(k % 3)))
    rows += [(500, None, 0), (501, [], 0), (502, [0.0] * 24, 0), (503, [float("nan")] * 24, 0), (504, [1.0, None], 0), (505, rows[0][1], None), (506, rows[0][1][:12], 0), (None, rows[0][1], 0), (507, rows[0][1], 0)]
    table = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, kept string").repartition(4)
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embeddings.near_duplicates(table, 0.98).collect()}
    good = {k: (np.array(v), lab) for k, v, lab in rows if k is not None and v and None not in v and lab is not None and np.isfinite(v).all() and any(v)}
    cos = lambda a, b: float(a @ b / np.sqrt((a @ a) * (b @ b)))
    links = [(a, b) for a in good for b in good if a < b and good[a][1] == good[b][1] and len(good[a][0]) == len(good[b][0]) and cos(good[a][0], good[b][0]) >= 0.98]
    ids = [r[0] for r in rows if r[0] is not None]
    want = union(ids, links)
    degree = dict.fromkeys(ids, 0)
    for a, b in links:
        degree[a] += 1
        degree[b] += 1
    assert got.pop(None)[0] == 0
    assert links and got == {k: (degree[k], want[k], want[k] == k) for k in ids}


# -- decontamination ---------------------------------------------------------

ITEM = "The train left Boston with 45 passengers and each of the 45 passengers paid 12 dollars for one ticket to Chicago. How much did they pay?"


def test_decontamination(spark):
    items = spark.createDataFrame([(1, ITEM, "x"), (2, "short one", "x"), (3, None, "x"), (4, "Where is the old bridge?", "x")], "item_id long, text string, verbatim string")
    changed = ITEM.replace("45", "61").replace("12", "9").replace("dollars", "euros").replace("Boston", "Denver").replace("Chicago", "Dallas")
    torn = changed.replace("the 61", "the 77")
    rows = [(1, "Before. " + ITEM + " after"), (2, changed), (3, torn), (4, "nothing of the kind is said in this text at all, not once"), (5, None), (6, ""), (7, "so, where is the OLD bridge? there"), (8, "1 2 3 4 5 6 7 8 9 10"), (None, ITEM)]
    table = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, coverage string")
    got = {(r["doc_id"], r["item_id"]): r["verbatim"] for r in decontaminate.matches(table, items, min_coverage=0.9).collect()}
    assert got == {(1, 1): True, (2, 1): False, (7, 4): True, (None, 1): True}
    assert decontaminate.matches(table.limit(0), items).count() == 0 and decontaminate.matches(table, items.limit(0)).count() == 0


def contaminated(spark, texts, items):
    frame = lambda rows, name: spark.createDataFrame(list(enumerate(rows)), f"{name} long, text string")
    return {(r["doc_id"], r["item_id"]): r["verbatim"] for r in decontaminate.matches(frame(texts, "doc_id"), frame(items, "item_id")).collect()}


def test_decontamination_takes_names_that_open_sentences(spark):
    item = "Alice has 5 red apples in her basket. Alice buys 3 more apples at the market. Alice gives 2 apples to her brother. How many apples does Alice have now?"
    bob = item.replace("Alice", "Bob")
    mixed = item.replace("Alice has", "Bob has").replace("Alice buys", "Carol buys").replace("Alice gives", "Dora gives").replace("does Alice", "does Eve")
    assert contaminated(spark, [bob, item, mixed, "he asked Where is the old bridge?"], [item, "Where is the old bridge?"]) == {(0, 0): False, (1, 0): True, (3, 1): True}


def test_decontamination_finds_copies_dense_in_numbers(spark):
    items = ["Convert 12 km to miles and 5 kg to pounds", "Compute 12 + 35 * 7 - 4 / 2"]
    texts = [*items, *[f"Now: {x}, please." for x in items], "Convert 13 km to miles and 6 kg to pounds", "Compute 12 + 35 * 7 - 4 / 3"]
    assert contaminated(spark, texts, items) == {(0, 0): True, (1, 1): True, (2, 0): True, (3, 1): True}


def test_decontamination_finds_a_verbatim_passage_of_a_long_item(spark):
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "nu", "pe", "ra") for b in ("ban", "der", "fil", "gos", "hum", "jat", "kel", "mor", "nip", "sud")]
    texts = [f"zzz yyy {' '.join(words[20 : 20 + n])} xxx www" for n in (22, 13, 12)]
    assert contaminated(spark, texts, [" ".join(words)]) == {(0, 0): True, (1, 0): True}


def test_decontamination_of_long_texts_and_of_many_matches(spark):
    words = " ".join(f"w{k % 977}" for k in range(60_000))
    item = "Which of the nine lamps in the hall of the seventh house was lit on the evening of the storm?"
    assert contaminated(spark, [words, f"{words} {item} {words}", "Compute 12 + 45 * 3 - 7 + 19 now"], [item, "Compute 12 + 45 * 3 - 7 + 19 now"]) == {(1, 0): True, (2, 1): True}


# -- archives ----------------------------------------------------------------


def test_archives(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 3000)
    html = ["<p>a</p>", "<p>é</p>" * 50, "<p>a</p>", None, "", "x" * 5000, "WARC/1.1\r\n\r\n"]
    rows = [(k, f"http://h/{k}\n é", html[k % 7], "clash") for k in range(60)] + [(None, None, "only null", "clash")]
    table = spark.createDataFrame(rows, "page_id long, url string, html string, record_type string").repartition(3)
    mono, normal = new_path(spark, "mono"), new_path(spark, "normal")
    warc.write_archives(warc.typed(table), mono, 3000)
    warc.normalise(spark, mono, normal)
    got = warc.read_records(spark, normal).collect()
    want = {}
    for k, _, text, _ in rows:
        raw = (text or "").encode()
        best = max((i for i, _, t, _ in rows if (t or "").encode() == raw and i is not None), default=None)
        want[k] = (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if k == best else "revisit", None if k == best else best)
    assert {r["page_id"]: (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got} == want
    entries = {(r["archive"], r["offset"]): r["length"] for r in warc.index_entries(spark, normal).collect()}
    assert entries == {(r["archive"], r["member_offset"]): r["member_length"] for r in got}
    files = warc._archives(spark, normal, "archive").collect()
    assert len(files) > 3
    for f in files:  # each file is whole gzip, and each member can be read alone
        whole = gzip.decompress(bytes(f["content"]))
        alone = b"".join(gzip.decompress(bytes(f["content"])[o : o + n]) for (a, o), n in sorted(entries.items()) if a == f["name"])
        assert whole == alone and whole.startswith(b"WARC/1.1\r\n")


def test_of_tied_records_one_is_the_response(spark):
    rows = [(5, "u1", "x"), (5, "u2", "x"), (5, "u2", "x"), (3, "u9", "x"), (None, "n", "y"), (None, "n", "y"), (None, "z", "x")]
    table = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    mono, normal = new_path(spark, "mono"), new_path(spark, "normal")
    warc.write_archives(warc.typed(table), mono)
    warc.normalise(spark, mono, normal)
    records = warc.read_records(spark, normal)
    got = sorted((r["page_id"] or 0, r["url"], r["record_type"], r["refers_to"] or 0) for r in records.collect())
    assert got == [(0, "n", "response", 0), (0, "n", "response", 0), (0, "z", "revisit", 5), (3, "u9", "revisit", 5), (5, "u1", "revisit", 5), (5, "u2", "response", 0), (5, "u2", "revisit", 5)]
    wanted = warc.index_entries(spark, normal).filter("type = 'response'")
    assert sorted(r["page_id"] or 0 for r in warc.read_members(spark, normal, wanted).collect()) == [0, 0, 5]


def test_registered_archives_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert queries.QUERIES["op6_warc"](spark, str(tmp_path)).count() == 0


def test_archives_of_an_empty_table(spark):
    table = spark.createDataFrame([], "page_id long, url string, html string")
    mono = new_path(spark, "mono")
    warc.write_archives(warc.typed(table), mono)
    assert spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(mono).filter("length > 0").count() == 0
