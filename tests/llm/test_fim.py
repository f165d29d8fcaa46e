"""Fill-in-middle: cuts, forms and round trips against a plain version."""

import hashlib
import re

from pyspark.sql import functions as F
from tokenizers import Regex, pre_tokenizers

from saleslens.llm import fim

WS = " \t\n\x0b\x0c\r"


def plain_tokens(text):
    out, i = [], 0
    while i < len(text):
        j = i
        while j < len(text) and text[j] in WS:
            j += 1
        while j < len(text) and text[j] not in WS:
            j += 1
        out.append(text[i:j])
        i = j
    return out


def plain_fim(doc_id, text):
    t, digest = text or "", hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i:8 * i + 8], 16) for i in range(4))
    w = plain_tokens(t)
    a, b = sorted((h1 % (len(w) + 1), h2 % (len(w) + 1)))
    if not t or re.search("<[PSM]>", t) or h3 % 100 >= 50:
        return len(w), "plain", None, None, t
    pre, mid, suf = "".join(w[:a]), "".join(w[a:b]), "".join(w[b:])
    if h4 % 100 < 80:
        return len(w), "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return len(w), "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def test_against_plain_version(spark):
    texts = [None, "", " ", "\n\t \r", "a", " a", "a ", "é  😀 x y\x00 z", "<P", "x <S>", "<M>", "<P<S <", ">P> <", "word " * 5000 + " " * 3000, "tail<\n<S", "́a b\x0bc\x0cd"]
    rows = [(i, t, 7, "x") for i, t in enumerate(texts * 12)] + [(5, "same row", 1, "y")] * 2 + [(None, "no id here", 1, "z"), (None, None, 1, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, N int, Form string")
    got = fim.transform(df, block=64)
    assert got.columns == ["doc_id", "text", "n", "form", "prefix_chars", "middle_chars", "output"]
    back = got.withColumn("back", fim.restore(F.col("output"), F.col("form"))).collect()
    assert len(back) == len(rows)
    seen = set()
    for r in back:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == plain_fim(r.doc_id, r.text)
        assert r.back == (r.text or "")
        seen.add(r.form)
    assert seen == {"plain", "psm", "spm"}
    assert fim.transform(df.limit(0)).count() == 0


def test_blocks_end_between_tokens():
    splitter = pre_tokenizers.Split(Regex(fim.TOKEN), "isolated")
    for text in ("", "  ", "ab  cd e\n" * 40, "x" * 300, " " * 300 + "x", "a " * 200 + " " * 200):
        ends = [0]
        for w in plain_tokens(text):
            ends.append(ends[-1] + len(w))
        for block in (1, 7, 100, 1 << 20):
            assert fim.offsets(text, splitter, block).tolist() == ends
