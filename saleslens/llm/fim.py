"""Fill-in-middle: documents cut at token bounds into prefix, middle and suffix, written in one of two orders.

The pre-tokenizer ``Split`` of the tokenizers library cuts a text by a regular expression, each match a piece of its own, without any training, and
gives the pieces' code-point offsets.  The length of the offset array is the number of tokens n; two hashed ranks, taken as indices
into the offsets, give the cuts.  Texts of over ``BLOCK`` characters are tokenized in blocks that end between two tokens, so the
list of pieces stays small; only the offsets (eight bytes a token) of a whole text are held.

The transformed text and the pieces are built, and restored, by DataFrame functions.

Defined cases: a null text is empty; an empty text, and one that contains a sentinel, stays plain; a null id hashes like an empty string; repeated rows
come out alike; an empty table gives an empty result; columns named like the outputs are replaced.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, pre_tokenizers

from .common import drop_clashing

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: White space goes with the word that follows it; at the end of a text it is a token of its own.
TOKEN = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
#: Characters that are tokenized at once, at least.
BLOCK = 1 << 20
#: Between two tokens, wherever a text is cut before them.
_BETWEEN = re.compile(r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
OUTPUTS = ("n", "form", "prefix_chars", "middle_chars", "output")


def offsets(text: str, splitter: pre_tokenizers.Split, block: int = BLOCK) -> np.ndarray:
    """0 and the end of each token, in code points."""
    parts, at = [np.zeros(1, np.int64)], 0
    while at < len(text):
        cut = _BETWEEN.search(text, at + block) if len(text) - at > block else None
        end = cut.start() if cut else len(text)
        parts.append(at + np.array([bound[1] for _, bound in splitter.pre_tokenize_str(text[at:end])], np.int64))
        at = end
    return np.concatenate(parts)


def cuts(text: Column, first: Column, second: Column, block: int = BLOCK) -> Column:
    """struct(n, low, high): tokens, and the code points before the smaller and the larger of two ranks modulo n + 1."""

    @F.pandas_udf("n long, low long, high long")
    def cut(texts: pd.Series, firsts: pd.Series, seconds: pd.Series) -> pd.DataFrame:
        splitter, rows = pre_tokenizers.Split(Regex(TOKEN), "isolated"), []
        for t, a, b in zip(texts, firsts, seconds, strict=True):
            ends = offsets(t, splitter, block)
            low, high = sorted((a % len(ends), b % len(ends)))
            rows.append((len(ends) - 1, ends[low], ends[high]))
        return pd.DataFrame(rows, columns=["n", "low", "high"])

    return cut(text, first, second)


def _hashes(seed: int, id_col: Column) -> list[Column]:
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def transform(docs: DataFrame, id_col: str = "doc_id", text: str = "text", seed: int = 42, rate: int = 50, spm_rate: int = 80, block: int = BLOCK) -> DataFrame:
    """``docs`` with n, form (plain, psm or spm), prefix_chars, middle_chars and output, the text in that form.

    ``rate`` percent of the texts are transformed, ``spm_rate`` percent of those with the suffix first.
    """
    h1, h2, h3, h4 = _hashes(seed, F.col(f"`{id_col}`"))
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    marked = F.contains(whole, F.lit(PREFIX)) | F.contains(whole, F.lit(SUFFIX)) | F.contains(whole, F.lit(MIDDLE))
    form = F.when((whole == "") | marked | (h3 % 100 >= rate), "plain").when(h4 % 100 < spm_rate, "spm").otherwise("psm")
    kept = [F.col(f"`{c}`") for c in drop_clashing(docs, *OUTPUTS).columns]
    got = docs.select(F.struct(*kept).alias("row"), whole.alias("whole"), form.alias("form"), cuts(whole, h1, h2, block).alias("cut"))
    low, high = F.col("cut.low").cast("int"), F.col("cut.high").cast("int")
    prefix, middle = F.substring("whole", F.lit(1), low), F.substring("whole", low + 1, high - low)
    suffix = F.substring("whole", high + 1, F.length("whole"))
    output = (F.when(F.col("form") == "plain", F.col("whole"))
              .when(F.col("form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
              .otherwise(F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)))
    moved = F.col("form") != "plain"
    return got.select("row.*", F.col("cut.n").alias("n"), "form", F.when(moved, F.col("cut.low")).alias("prefix_chars"),
                      F.when(moved, F.col("cut.high") - F.col("cut.low")).alias("middle_chars"), output.alias("output"))


def restore(output: Column, form: Column) -> Column:
    """The text again.  Transformed texts hold no sentinel of their own, so each is found where it was put."""
    length = F.length(output)

    def between(opening: str, closing: str | None) -> Column:
        begin = F.instr(output, opening) + len(opening)
        return F.substring(output, begin, (F.instr(output, closing) if closing else length + 1) - begin)

    psm = F.concat(between(PREFIX, SUFFIX), between(MIDDLE, None), between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), between(MIDDLE, None), between(SUFFIX, PREFIX))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)
