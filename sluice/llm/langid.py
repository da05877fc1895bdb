"""Language identification by compression.

For every language a raw-content zstandard dictionary is filled with training
text.  A text is cut into chunks, all of which are compressed with each
dictionary; the language whose dictionary gives the fewest bytes is chosen.  A
text is rejected if the next language needs hardly more bytes, or if it has no
letter.

Edge cases: a null text and one without a letter are `und` with score 0 and are
rejected; of an id's several training texts the least is taken; of languages that need equally many bytes the first by name is named,
and the text is rejected; without any training text every text is `und`;
repeated rows give repeated results; an empty table gives no rows; null ids are
kept; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import give_back, light_batches, sampled_ids, sampled_texts

#: Bounds of the training sample: documents a language, and languages (those of the most documents).
SAMPLE_DOCS, MAX_LANGUAGES = 40, 200
CHUNK_BYTES = 4096
#: A text is rejected if the second language needs less than this share more bytes.
MIN_MARGIN = 0.002
#: Margin at which the score is 1 - 1/e.
SCORE_SCALE = 0.02
UNKNOWN = "und"
NOT_LETTERS = bytes(b for b in range(33, 127) if not chr(b).isalpha())
SPACES = bytes(32 if b < 33 else b for b in range(256))


def train(docs: DataFrame, keep: Column, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> dict[str, bytes]:
    """The dictionary content of each language: the whole texts of a bounded number of the rows that satisfy keep."""
    rows = docs.filter(keep & F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & (F.octet_length(text_col) > 0))
    sizes = {r[lang_col]: r["count"] for r in rows.groupBy(lang_col).count().orderBy(F.desc("count"), lang_col).limit(MAX_LANGUAGES).collect()}
    texts: dict[str, list[bytes]] = {}
    for lang, _, text in sampled_texts(rows, sampled_ids(rows, lang_col, sizes, SAMPLE_DOCS, id_col), lang_col, id_col, text_col):
        texts.setdefault(lang, []).append(letters(text))
    out = {lang: b" ".join(found) for lang, found in sorted(texts.items())}
    del texts
    give_back()
    return out


def compressors(dictionaries: dict[str, bytes]) -> list[zstandard.ZstdCompressor]:
    """One for each dictionary, all with a window and tables that hold the longest."""
    reach = max(17, (max(map(len, dictionaries.values()), default=0) + CHUNK_BYTES).bit_length())
    params = zstandard.ZstdCompressionParameters(window_log=reach, chain_log=reach - 2, hash_log=reach - 1, search_log=2, min_match=4, target_length=8, strategy=zstandard.STRATEGY_GREEDY, write_content_size=0, write_checksum=0, write_dict_id=0)
    out = []
    for content in dictionaries.values():
        data = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        data.precompute_compress(compression_params=params)
        out.append(zstandard.ZstdCompressor(compression_params=params, dict_data=data))
    return out


def letters(text: str) -> bytes:
    """What is compressed: the text in lower case, without ASCII digits and punctuation, lines joined."""
    return text.lower().encode().translate(SPACES, NOT_LETTERS)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def classify(text: str | None, langs: list[str], by_lang: list[zstandard.ZstdCompressor]) -> tuple[str, float, float]:
    """(language, score, margin) of a whole text."""
    if text is None or not by_lang or not has_letter(text):
        return UNKNOWN, 0.0, 0.0
    raw = letters(text)
    chunks = [raw[k : k + CHUNK_BYTES] for k in range(0, len(raw), CHUNK_BYTES)]
    sizes = [sum(len(c.compress(x)) for x in chunks) for c in by_lang]
    best = min(range(len(sizes)), key=sizes.__getitem__)
    second = min((s for k, s in enumerate(sizes) if k != best), default=2 * sizes[best])
    margin = (second - sizes[best]) / sizes[best]
    return langs[best], 1 - math.exp(-margin / SCORE_SCALE), margin


def predict(docs: DataFrame, dictionaries: dict[str, bytes], text_col: str = "text", min_margin: float = MIN_MARGIN) -> DataFrame:
    """docs with lang_pred, score and rejected."""
    light_batches(docs.sparkSession)
    langs, held = list(dictionaries), docs.sparkSession.sparkContext.broadcast(dictionaries)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        by_lang = compressors(held.value)
        for batch in batches:
            found = [classify(t, langs, by_lang) for t in batch]
            yield pd.DataFrame({"lang": [x[0] for x in found], "score": [x[1] for x in found], "rejected": [x[0] == UNKNOWN or x[2] < min_margin for x in found]})
            give_back()

    told = F.pandas_udf(run, "lang string, score double, rejected boolean", F.PandasUDFType.SCALAR_ITER)
    names = [F.col(c) for c in docs.columns if c not in ("lang_pred", "score", "rejected")]
    return docs.withColumn("_told", told(F.col(text_col))).select(*names, F.col("_told.lang").alias("lang_pred"), F.col("_told.score").alias("score"), F.col("_told.rejected").alias("rejected"))
