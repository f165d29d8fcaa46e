"""Language identification by compression: the language whose dictionary makes a text smallest.

``fit_dictionaries`` cuts the whole of every labelled text into blocks, gathers a bounded sample of them per language and joins it to one raw-content
zstandard dictionary for each.  ``identify`` compresses every whole text, in blocks, with every
dictionary and picks the smallest total.  Only text enters a prediction.

Defined cases: a null text, or one without a letter, is ``und`` with score 0 and rejected; equal totals go to
the language first by code point; with no learned language all is ``und``; with one, its score is 1; repeated rows are sampled and judged alike.
Existing columns named like the outputs are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Predictions whose margin (second - best) / second is smaller are rejected.
MIN_MARGIN = 0.005

#: Bytes that are no letters become spaces; bytes of multi-byte characters stay.
_LETTERS = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


@dataclass(frozen=True)
class LanguageModel:
    """Raw-content dictionaries by language, in code-point order."""

    dictionaries: dict[str, bytes]


#: Sampled blocks per language, characters of a block, and languages, at most: with these no dictionary exceeds 0.4 million characters.
BLOCKS, BLOCK_CHARS, MAX_LANGUAGES = 400, 1024, 256


def fit_dictionaries(labelled: DataFrame, text: str = "text", lang: str = "lang", order: Column | None = None, blocks_per_lang: int = BLOCKS,
                     block_chars: int = BLOCK_CHARS, max_languages: int = MAX_LANGUAGES) -> LanguageModel:
    """Learn one dictionary per non-null ``lang`` from at most ``blocks_per_lang`` blocks of ``block_chars`` characters (this bound makes
    the sample and the broadcast small whatever the table's size); over ``max_languages`` languages are an error.

    Every block with a letter of every text may be drawn: those with the smallest MD5 of ``order`` (default: hash of the text) and block number are taken, so
    no part of a text is preferred.  The row_number filter is applied before the shuffle by Spark's window group limit, so a language with most rows is no hot spot.
    """
    by = (order if order is not None else F.xxhash64(text)).cast("string")
    cut = F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{block_chars}}}"), F.lit(0))
    rows = labelled.where(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), by.alias("by"), F.posexplode(cut).alias("b", "text")).where(F.col("text").rlike(r"\p{L}"))
    rows = rows.select("lang", F.md5(F.concat_ws(":", "by", F.col("b").cast("string")).cast("binary")).alias("at"), "text")
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("at", "text"))).where(F.col("n") <= blocks_per_lang).select("lang", "n", "text")
    taken = rows.limit(max_languages * blocks_per_lang + 1).collect()
    parts: dict[str, list[str]] = {}
    for r in sorted(taken, key=lambda r: (r.lang, -r.n)):
        parts.setdefault(r.lang, []).append(r.text)
    if len(parts) > max_languages or len(taken) > max_languages * blocks_per_lang:
        raise ValueError(f"over {max_languages} languages")
    return LanguageModel({k: b" ".join(map(normalized, parts[k])) for k in sorted(parts)})


def normalized(text: str) -> bytes:
    """Lower case, letters only, single spaces: punctuation and digits say little about a language."""
    return b" ".join(text.lower().encode("utf-8", "replace").translate(_LETTERS).split())


def _compressors(dictionaries: dict[str, bytes], level: int) -> dict[str, zstandard.ZstdCompressor]:
    out = {}
    for lang, raw in dictionaries.items():
        d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=level)
        out[lang] = zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)
    return out


def classify(text: str | None, compressors: dict[str, zstandard.ZstdCompressor], block: int = 1024) -> tuple[str, float]:
    """Language and margin of one text.  Blocks keep a long text from becoming its own dictionary."""
    if text is None or not compressors or not any(map(str.isalpha, text)):
        return "und", 0.0
    raw = normalized(text)
    totals = [(sum(len(c.compress(raw[i:i + block])) for i in range(0, len(raw), block)), lang) for lang, c in compressors.items()]
    totals.sort()
    if len(totals) == 1:
        return totals[0][1], 1.0
    best, second = totals[0][0], totals[1][0]
    return totals[0][1], (second - best) / second


def identify(df: DataFrame, model: LanguageModel, text: str = "text", min_margin: float = MIN_MARGIN, level: int = 5,
             lang_col: str = "lang_pred", score_col: str = "score", rejected_col: str = "rejected") -> DataFrame:
    """``df`` with the predicted language, its score (the margin, 0 to 1) and whether it is rejected as too narrow."""
    shared = df.sparkSession.sparkContext.broadcast(model.dictionaries)

    @F.pandas_udf("lang string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        compressors = _compressors(shared.value, level)  # once a task
        for texts in batches:
            yield pd.DataFrame([classify(t, compressors) for t in texts], columns=["lang", "score"])

    got = F.col("__prediction")
    keep = [c for c in df.columns if c.lower() not in {lang_col.lower(), score_col.lower(), rejected_col.lower()}]
    return (df.withColumn("__prediction", predict(F.col(text)))
            .select(*[F.col(f"`{c}`") for c in keep], got["lang"].alias(lang_col), got["score"].alias(score_col),
                    ((got["lang"] == "und") | (got["score"] < min_margin)).alias(rejected_col)))
