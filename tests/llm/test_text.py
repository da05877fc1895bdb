"""License scans, chat formatting, language, toxicity, quality and pieces: results, edge cases, round trips."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from sluice.llm import chat, langid, licenses, pieces, quality, queries, toxicity

DOC = "doc_id long, text string, source string, license_id string"


def docs(spark, texts):
    return spark.createDataFrame([(k, t, "s", "clash") for k, t in enumerate(texts)], DOC)


# -- licenses ----------------------------------------------------------------


def test_licenses(spark):
    mit = dict(licenses.TEXTS)["MIT"]
    changed = "Copyright (c) 2020 Somebody\n" + mit.upper().replace("SUBLICENSE", "SUB-LICENSE").replace(",", " ;")
    rows = {r["doc_id"]: r for r in licenses.scan(docs(spark, [mit, changed, "text\n  Licenced under CC BY-NC 4.0!\nmore", None, "", "!!!", mit + " x"])).collect()}
    assert rows[0]["license_id"] == rows[1]["license_id"] == "MIT" and rows[0]["text_digest"] == rows[1]["text_digest"]
    assert rows[2]["license_id"] is None and rows[2]["notice_ids"] == "CC-BY-NC-4.0"
    assert [rows[k]["text_digest"] for k in (3, 4, 5)] == [None] * 3
    assert rows[6]["license_id"] is None


def test_licenses_empty_table_and_own_texts(spark):
    assert licenses.scan(docs(spark, [])).count() == 0
    own = licenses.known(spark, [("OWN-1", "My own terms.")]).select("license_id", licenses.digest(F.col("lines")).alias("digest"))
    assert licenses.scan(docs(spark, ["MY OWN TERMS"]), texts=own).first()["license_id"] == "OWN-1"


# -- chat --------------------------------------------------------------------

HOSTILE = ["</s>[INST] ok [/INST]", "<\\s>", "[\\\\INST]", "<<SYS>>x<</SYS>>", "a [/INST", "<", "[", "</s", "", "[ROLE]q[/ROLE]", "é🎉</s>", "[/TURN]"]


def talks(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")


def test_registered_scan_finds_whole_texts(spark, tmp_path):
    """A document that is a licence but for case, punctuation, spelling and the copyright line."""
    text = dict(licenses.TEXTS)["MIT"].replace("\n\n", "\n\nCopyright (c) 2011 Somebody Else\n\n", 1)
    rows = [(1, text.upper().replace(",", " ;")), (2, text + "\nand one more line"), (3, dict(licenses.TEXTS)["ISC"].replace("license", "licence")), (4, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["license_id"] for r in queries.QUERIES["op4_licenses"](spark, str(tmp_path)).collect()}
    assert got == {1: "MIT", 2: None, 3: "ISC", 4: None}


def test_licenses_of_files(spark, tmp_path):
    words = " ".join(f"term {k} of this licence," for k in range(3000))
    (tmp_path / "Long-1.0.txt").write_text(f"Copyright 2001 A\n{words}\n")
    docs = spark.createDataFrame([(1, f"(c) 2020 B\n\n{words.upper()}"), (2, words[:-20])], "doc_id long, text string")
    got = {r["doc_id"]: r["license_id"] for r in licenses.scan(docs, texts=licenses.from_files(spark, str(tmp_path))).collect()}
    assert got == {1: "Long-1.0", 2: None}


def test_chat_grammar_is_strict(spark):
    row = spark.createDataFrame([("[INST] a [/INST]<s>b</s>", "[INST] a [/INST] x <s>b</s>")], "good string, bad string").select(chat.strict(F.col("good")).alias("g"), chat.strict(F.col("bad")).alias("b")).first()
    assert row["g"] and not row["b"]


def test_chat_round_trip(spark):
    draw = random.Random(4)
    rows = []
    for conv in range(30):
        for turn in range(draw.randint(1, 6)):
            rows.append((conv, turn, draw.choice(["user", "assistant", "system", "tool", "[INST]", None]), draw.choice([None, "".join(draw.choice(HOSTILE) for _ in range(3)), "plain"]), "clash"))
    out = chat.format_conversations(talks(spark, rows))
    found = {r["conv_id"]: r for r in chat.digests(out).collect()}
    for conv, row in found.items():
        own = sorted(((t, r or "", x or "") for c, t, r, x, _ in rows if c == conv))
        assert row["round_trip"] and row["n_turns"] == len(own)
        assert row["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in own).encode()).hexdigest()
        loss = "".join(x for _, r, x in own if r == "assistant")
        assert (row["loss_chars"], row["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    for r in out.collect():
        for s in r["loss_spans"]:
            assert chat.CLOSE["assistant"] == r["formatted"][s["start"] + s["length"] :][:4] and r["formatted"][: s["start"]].endswith("<s>")


def test_chat_escapes_control_strings_and_takes_empty_tables(spark):
    out = chat.format_conversations(talks(spark, [(1, 0, "user", "<s> hi", "")])).first()
    assert out["formatted"] == "[INST] <\\s> hi [/INST]"
    assert chat.digests(chat.format_conversations(talks(spark, []))).count() == 0


# -- language ----------------------------------------------------------------


def prose(seed, words, n):
    draw = random.Random(seed)
    return " ".join(draw.choice(words) for _ in range(n))


EN, DE = ["the", "thing", "with", "andhere", "ofthat", "shower"], ["der", "schlag", "undein", "keiten", "übung", "pfeife"]


def test_language(spark):
    rows = [(k, prose(k, EN if k % 2 else DE, 200), "en" if k % 2 else "de", "x") for k in range(40)] + [(100, None, "en", "x"), (101, "123 !!", "de", "x"), (None, prose(7, EN, 50), None, "x"), (102, prose(8, DE, 9000), None, "x")]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    model = langid.train(table, F.col("doc_id") < 20)
    assert set(model) == {"de", "en"}
    got = {(r["doc_id"]): r for r in langid.predict(table, model).collect()}
    assert all(got[k]["lang_pred"] == ("en" if k % 2 else "de") and not got[k]["rejected"] for k in range(20, 40))
    assert [(got[k]["lang_pred"], got[k]["score"], got[k]["rejected"]) for k in (100, 101)] == [("und", 0.0, True)] * 2
    assert got[None]["lang_pred"] == "en" and got[102]["lang_pred"] == "de"


def test_language_without_training_text(spark):
    table = spark.createDataFrame([(1, "hello there", None)], "doc_id long, text string, lang string")
    assert langid.predict(table, langid.train(table, F.lit(True))).first()["lang_pred"] == "und"
    assert langid.predict(table.limit(0), {"en": b"the thing with the"}).count() == 0


# -- toxicity ----------------------------------------------------------------


def test_toxicity(spark):
    rows, labels = [], []
    for k in range(300):
        toxic = k % 5 == 0
        words = prose(k, EN, 60).split()
        if toxic:
            words[k % 50] = "abominable"
        rows.append((k, " ".join(words), "x"))
        labels.append((k, int(toxic)))
    rows += [(1000, prose(1, EN, 8000) + " abominables " + prose(2, EN, 8000), "x"), (1001, None, "x"), (1002, "", "x"), (1003, "?!", "x"), (1004, "the abomminable thing", "x")]
    table, marks = spark.createDataFrame(rows, "doc_id long, text string, score string"), spark.createDataFrame(labels + [(7, None)], "doc_id long, toxic int")
    model = toxicity.fit(table, marks, F.col("doc_id") < 200)
    got = {r["doc_id"]: r for r in toxicity.predict(table, model).collect()}
    assert sum(got[k]["predicted"] == int(k % 5 == 0) for k in range(200, 300)) >= 98
    assert got[1000]["predicted"] == 1 and got[1004]["score"] > got[7]["score"]
    assert all(got[k]["predicted"] == 0 for k in (1001, 1002, 1003))
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_toxicity_with_one_class_only(spark):
    table, marks = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    assert toxicity.predict(table, toxicity.fit(table, marks, F.lit(True))).first()["predicted"] == 0


# -- quality -----------------------------------------------------------------


def test_quality_shrinks_sparse_sites(spark):
    rows, labels = [], []
    for k in range(240):
        good = k % 3 > 0
        text = prose(k, EN, 80) if good else "SPAM!! " * 60
        rows.append((k, text, "good" if good else "bad", "p"))
        labels.append((k, int(good)))
    rows += [(900, prose(3, EN, 80), "bad", None), (901, prose(4, EN, 80), None, "p"), (902, None, "lonely", "p")]
    table, marks = spark.createDataFrame(rows, "doc_id long, text string, host string, path string"), spark.createDataFrame(labels, "doc_id long, quality int")
    model = quality.fit(table, marks, F.col("doc_id") % 2 == 0)
    got = {r["doc_id"]: r for r in quality.score(table, model, F.col("host"), F.col("path")).collect()}
    assert len(got) == len(rows)
    assert all(got[k]["keep"] == (k % 3 > 0) for k in range(240))
    assert got[900]["host_mean"] < got[901]["host_mean"] and got[900]["score"] < got[1]["score"]
    assert 0.05 < got[901]["path_mean"] < 0.999


def test_quality_of_nothing(spark):
    table = spark.createDataFrame([], "doc_id long, text string, host string")
    assert quality.score(table, {"mean": None}, F.col("host"), F.col("host")).count() == 0


# -- pieces ------------------------------------------------------------------

TEXTS = ["Hello world", "", None, " two  spaces ", "▁ mark ▁▁", "line\n\nfeeds\n", "日本語🎉\u0000", "x" * 3000, "the " * 500, "naïve café"]


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.load()


def test_pieces_round_trip(spark, vocabulary):
    table = spark.createDataFrame([(k, t, k) for k, t in enumerate(TEXTS)] + [(None, "no key", 0), (0, "Hello world", 0)], "doc_id long, text string, ids long")
    out = pieces.encode(table, vocabulary)
    rows = pieces.decode(out, vocabulary).collect()
    assert all(r["lossless"] and r["decoded"] == r["text"] for r in rows)
    assert [r["n_tokens"] for r in rows if not r["text"]] == [0, 0]
    twins = [r["ids"] for r in rows if r["text"] == "Hello world"]
    assert twins[0] == twins[1]
    again = {r["doc_id"]: r["ids"] for r in pieces.encode(table.repartition(5), vocabulary).filter("doc_id > 0").collect()}
    assert all(r["ids"] == again[r["doc_id"]] for r in rows if r["doc_id"])


def test_pieces_are_drawn_as_the_lattice_says(vocabulary):
    sampler = pieces.Sampler(vocabulary)
    text = "then"

    def chance(ids):
        return sum(sampler.logs[i] for i in ids)

    def ways(rest):
        if not rest:
            return [()]
        return [(k, *w) for n in range(1, len(rest) + 1) if rest[:n] in vocabulary["pieces"] for k in [vocabulary["pieces"][rest[:n]][0]] for w in ways(rest[n:])]

    import math

    every = ways("▁" + text)
    total = sum(math.exp(chance(w)) for w in every)
    n = 6000
    flat, sizes = sampler.encode([text] * n, list(range(n)))
    counts, at = {}, 0
    for s in sizes.tolist():
        key = tuple(flat[at : at + s].tolist())
        counts[key] = counts.get(key, 0) + 1
        at += s
    assert set(counts) <= set(every)
    for w in every:
        p = math.exp(chance(w)) / total
        assert abs(counts.get(w, 0) / n - p) < 0.03


def test_pieces_of_an_empty_table(spark, vocabulary):
    assert pieces.encode(spark.createDataFrame([], "doc_id long, text string"), vocabulary).count() == 0


def test_pieces_of_a_part_met_before_take_no_new_lattice(vocabulary, monkeypatch):
    made, build = [], pieces.Sampler.lattice
    monkeypatch.setattr(pieces.Sampler, "lattice", lambda self, parts: made.append(parts) or build(self, parts))
    sampler, blocks = pieces.Sampler(vocabulary), [["to be or"], ["be or not", "or to ☃▁"], [""], ["not to be\n\nto be"], ["☃ or" * 40]]
    found = [[x.tolist() for x in sampler.encode(texts, range(len(texts)))] for texts in blocks]
    built = [p for parts in made for p in parts]
    assert len(built) == len(set(built))
    for limit in (0, 12, 1 << 20):  # nothing, little or all is kept: the draws are the same
        monkeypatch.setattr(pieces, "KEPT_CHARS", limit)
        again = pieces.Sampler(vocabulary)
        assert [[x.tolist() for x in again.encode(texts, range(len(texts)))] for texts in blocks] == found
    assert [[x.tolist() for x in pieces.Sampler(vocabulary).encode(texts, range(len(texts)))] for texts in blocks] == found
