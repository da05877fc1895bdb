"""The pipeline: stages keep what is clean, and their decisions take effect; each is held against a plain version."""

import random
import re

import corpus_pipeline
import pytest
from sluice.llm import pieces, queries

DATA = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)


def test_stages(spark):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "language", "near copies", "decontamination", "encoding"]
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    total, columns = docs.count(), docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DATA).cache()
        assert docs.columns == columns
        assert 0.5 * total < docs.count() <= total
        total = docs.count()
    last = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert last.count() == total and last.filter("NOT lossless").count() == 0


def test_stages_take_further_columns_and_odd_rows(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").selectExpr("*", "'a' AS score", "'b' AS predicted", "'c' AS rejected", "'d' AS component_id", "'e' AS _text", "'f' AS key")
    odd = spark.createDataFrame([(None, None, None, None, None), (70_000, "", "en", "src1", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.unionByName(odd, allowMissingColumns=True)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns and out.count() > 100


def test_stages_take_an_empty_table(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, DATA).count() == 0


# -- each stage against a plain version on a fixture of known documents ----------

LANGS = {"en": "the of and house water light people stone garden river", "de": "der und nicht haus wasser licht leute steine garten fluss", "xx": "qua zul mek tarro vin pelo sunda krit olma wex"}
BAD = ("grumpoid", "vlarkish", "snotface")
ITEM = "Priya bought 14 pencils and 3 rulers for 26 dollars at the corner shop. How many dollars did each pencil cost if every ruler cost 4 dollars?"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents whose fate is known by how they are made: (id, text, lang, fate)."""
    draw, rows = random.Random(11), []

    def prose(lang, n):
        return " ".join(draw.choice(LANGS[lang].split()) + draw.choice(["", "", "a", "en", "s"]) for _ in range(n))

    for k in range(360):
        lang = list(LANGS)[k % 3]
        text = prose(lang, draw.randint(40, 120))
        fate = "kept"
        if k % 5 == 0:
            words = text.split()
            words.insert(draw.randrange(len(words)), draw.choice(BAD))
            text, fate = " ".join(words), "toxic"
        rows.append((k, text, lang, fate))
    clean = [r for r in rows if r[3] == "kept"]
    rows += [(400 + k, r[1] + (" more" if k % 2 else ""), r[2], "copy") for k, r in enumerate(clean[:20])]
    rows += [(500 + k, f"{r[1]}. {ITEM if k % 2 else ITEM.replace('14', '19').replace('26', '31').replace('Priya', 'Marta')} {r[1][:60]}", r[2], "leak") for k, r in enumerate(clean[20:30])]
    rows += [(None, f"{clean[30][1]}. {ITEM}", "en", "leak"), (600, None, "en", "mute"), (601, "12 34 -- 56", "en", "mute"), (602, "", "en", "mute"), (603, prose("en", 9_000), "en", "kept")]
    rows.append(rows[1])  # a row that is there twice
    path = tmp_path_factory.mktemp("pipeline")
    spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang, _ in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(5).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(f == "toxic")) for i, _, _, f in rows if i is not None and i < 360], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (2, "What colour is the seventh lamp on the bridge of the old town near Zagreb?")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), rows


def ids(frame):
    return sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in frame.select("doc_id").collect())


def expected(rows, keep):
    return sorted((r[0] is None, r[0] or 0) for r in rows if keep(r))


def test_toxic_rows_go(spark, folder):
    path, rows = folder
    out = STAGES["toxicity"](spark, spark.read.parquet(f"{path}/documents.parquet"), path)
    assert ids(out) == expected(rows, lambda r: not any(b in (r[1] or "") for b in BAD))


def test_rows_of_no_language_go(spark, folder):
    path, rows = folder
    out = STAGES["language"](spark, spark.read.parquet(f"{path}/documents.parquet"), path)
    assert ids(out) == expected(rows, lambda r: re.search("[a-z]", r[1] or "") is not None)


def test_one_of_each_group_of_near_copies_stays(spark, folder):
    path, rows = folder
    out = STAGES["near copies"](spark, spark.read.parquet(f"{path}/documents.parquet"), path)
    grams = lambda t: {tuple(w[k : k + 5]) for w in [(t or "").split()] for k in range(max(len(w) - 4, min(1, len(w))))}
    sets, least = {r[0]: grams(r[1]) for r in rows if r[0] is not None}, {}
    for a in sorted(sets):  # the groups here are no chains, so the least similar document leads the group
        least[a] = next((b for b in sorted(sets) if b < a and sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])), a)
    assert ids(out) == expected(rows, lambda r: r[0] is None or least[r[0]] == r[0])
    assert sum(k != v for k, v in least.items()) == 20


def test_rows_with_items_go(spark, folder):
    path, rows = folder
    out = STAGES["decontamination"](spark, spark.read.parquet(f"{path}/documents.parquet"), path)
    assert ids(out) == expected(rows, lambda r: "pencils and 3 rulers" not in (r[1] or ""))


def test_run(spark, folder):
    path, rows = folder
    found = {r["doc_id"]: r for r in corpus_pipeline.run(spark, path).collect()}
    assert set(found) == {r[0] for r in rows if r[3] == "kept"}
    texts, vocabulary = {r[0]: r[1] for r in rows}, pieces.load()["texts"]
    for key, r in found.items():
        assert r["lossless"] and r["n_tokens"] == len(r["ids"])
        assert b"".join(vocabulary[i] for i in r["ids"]).decode()[1:] == texts[key]


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_has_rows(spark, name):
    assert queries.QUERIES[name](spark, DATA).count() > 0
