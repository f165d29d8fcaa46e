"""The registered queries opN_<name>: each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, chat, decontam, fim, htmltext, langid, mixing, pii, repair, simhash, substring, urlfilter, warc
from .common import materialize, n_words, new_path, read


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    warc.write(read(spark, sf_dir, "pages"), path)
    records = materialize(warc.read(spark, path, with_payload=False), "warc-read")
    return warc.resolve(records).select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", "refers_to")


OP1_SQL = """
WITH p AS (
  SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
q AS (
  SELECT *, translate(""" + " || ".join(f"lpad(to_base(CAST('0x' || substr(h, {5 * i + 1}, 5) AS BIGINT), 32), 4, '0')" for i in range(8)) + """,
    '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id != first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id != first THEN first END AS refers_to FROM q
"""


def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return got.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = substring.factors(read(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return got.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


OP4_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT rid, doc_id, i, list_slice(w, i, i + 12) AS win FROM (SELECT rid, doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE doc_id IS NOT NULL)),
hits AS (SELECT rid, i FROM (SELECT rid, doc_id, i, min(doc_id) OVER (PARTITION BY win) AS low FROM g) WHERE low < doc_id),
gone AS (SELECT rid, list(DISTINCT p) AS p FROM (SELECT rid, unnest(range(i, i + 13)) AS p FROM hits) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(p), 0) AS BIGINT) AS n_removed,
  sha256(CASE WHEN p IS NULL THEN array_to_string(w, ' ') ELSE coalesce((
    SELECT string_agg(x.word, ' ' ORDER BY x.i) FROM (SELECT unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i) x WHERE NOT list_contains(p, x.i)), '') END) AS kept_sha256
FROM d LEFT JOIN gone ON gone.rid = d.rid
"""


RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
#: Stand-in for a published URL list: the pages of hosts with one of these labels, and of all others those whose URL's MD5 begins with a zero,
#: which no host or path gives away.
LISTED_LABELS = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    by_host = urlfilter.host_of(F.col("url")).rlike(rf"(^|\.)({'|'.join(LISTED_LABELS)})\.")
    listed = pages.where(by_host | F.md5(F.col("url").cast("binary")).startswith("0")).select("url")
    return urlfilter.judge(pages, listed, RULES).select("page_id", "host", "path", "rule", "verdict")


OP5_SQL = rf"""
WITH p AS (
  SELECT page_id, url, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path,
    list_sort(list_filter(string_split(regexp_extract(url, '(?s)^.*?://[^?#]*\?([^#]*)', 1), '&'), lambda x: x != '' AND NOT starts_with(x, 'utm_'))) AS q FROM pages),
c AS (
  SELECT *, CASE WHEN host != '' THEN regexp_replace(host, ':(80|443)$', '') || regexp_replace(path, '/+$', '')
    || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END END AS canonical FROM p),
r(what, h, pre) AS (VALUES {", ".join(f"('{w}', '{h}', '{p}')" for w, h, p in RULES)}),
f AS (
  SELECT page_id, url, max_by(h || pre, length(h || pre)) AS rule, max_by(what, length(h || pre)) AS what FROM (SELECT DISTINCT page_id, url, host, path FROM c)
    JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, pre) GROUP BY page_id, url)
SELECT c.page_id, host, path, rule, coalesce(what, CASE WHEN canonical IN (SELECT canonical FROM c WHERE canonical IS NOT NULL AND
  (regexp_matches(host, '(^|\.)({"|".join(LISTED_LABELS)})\.') OR starts_with(md5(url), '0'))) THEN 'block' ELSE 'allow' END) AS verdict
FROM c LEFT JOIN f ON c.page_id IS NOT DISTINCT FROM f.page_id AND c.url IS NOT DISTINCT FROM f.url
"""


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.sql(f"SELECT * FROM VALUES (-7L, 0L, 'user', '{said}'), (-7L, 1L, 'assistant', '{said}') AS t(conv_id, turn, role, text)")
    formatted = chat.windows(rows.unionByName(extra))
    return chat.digests(chat.read_back(formatted)).withColumnRenamed("conv", "conv_id")


_STRIDE = (chat.BUDGET - chat.HISTORY - chat.RESERVE) // 2
_ESCAPED = "replace(replace(replace(replace({}, '\\', '\\\\'), '[INST]', '[\\INST]'), '[/INST]', '[\\/INST]'), '</s>', '<\\/s>')"
OP6_SQL = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
t AS (
  SELECT *, length({_ESCAPED.format("role")}) + length({_ESCAPED.format("text")}) + {len(chat.OPEN + chat.CLOSE + chat.END)} AS chars,
    CAST(ceil(length(text) / 4.0) AS BIGINT) + 4 AS tokens FROM c),
b AS (
  SELECT *, coalesce(sum(tokens) OVER o, 0) AS before, count(*) OVER o AS pos FROM t
  WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s AS (SELECT *, before // {_STRIDE} AS span, pos = 0 AND role = 'system' AS system FROM b),
f AS (SELECT conv_id, span, min(before) AS first FROM s GROUP BY conv_id, span),
extra AS (
  SELECT s.conv_id, s.chars FROM s JOIN f ON s.conv_id IS NOT DISTINCT FROM f.conv_id AND s.span + 1 = f.span AND f.first - s.before <= {chat.HISTORY} WHERE NOT s.system
  UNION ALL SELECT s.conv_id, s.chars FROM s JOIN f ON s.conv_id IS NOT DISTINCT FROM f.conv_id AND f.span > 0 WHERE s.system),
x AS (SELECT conv_id, sum(chars) AS chars FROM extra GROUP BY conv_id)
SELECT s.conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(s.chars) + coalesce(any_value(x.chars), 0) AS BIGINT) AS formatted_chars
FROM s LEFT JOIN x ON s.conv_id IS NOT DISTINCT FROM x.conv_id GROUP BY s.conv_id
"""


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


#: Any window within the similarity has a run of this many equal tokens (what is equal, dealt out between the substitutions).
_RUN = "CASE WHEN n >= 13 THEN 4 WHEN n >= 10 THEN 3 WHEN n >= 8 THEN 4 WHEN n >= 6 THEN 3 WHEN n = 5 THEN 2 ELSE n END"
_TOKENS = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x != '')"
OP7_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_TOKENS} AS t FROM documents WHERE text IS NOT NULL),
b AS (SELECT row_number() OVER () AS kid, item_id, t, len(t) AS n FROM (SELECT item_id, {_TOKENS} AS t FROM benchmark WHERE text IS NOT NULL) WHERE len(t) > 0),
g AS (SELECT kid, n, {_RUN} AS g, unnest(range(1, n - {_RUN} + 2)) AS j, t FROM b),
bg AS (SELECT kid, g, j, list_slice(t, j, j + g - 1) AS gram FROM g),
dg AS (SELECT rid, s.g, i, list_slice(t, i, i + s.g - 1) AS gram FROM (SELECT rid, t, unnest(range(1, len(t) + 1)) AS i FROM d) x JOIN (SELECT DISTINCT g FROM bg) s ON i + s.g - 1 <= len(t)),
h AS (SELECT DISTINCT rid, kid, i - j AS o FROM dg JOIN bg ON dg.g = bg.g AND dg.gram = bg.gram),
e AS (
  SELECT doc_id, item_id, o, least({decontam.WINDOW}, n) AS w, list_transform(range(greatest(1, 1 - o), least(n, len(d.t) - o) + 1), lambda j: CAST(d.t[j + o] = b.t[j] AS INT)) AS eq
  FROM h JOIN d ON d.rid = h.rid JOIN b ON b.kid = h.kid),
s AS (
  SELECT doc_id, item_id, o, list_max(list_transform(range(1, len(eq) - w + 2), lambda x: list_sum(list_slice(eq, x, x + w - 1)))) / w AS similarity FROM e WHERE len(eq) >= w)
SELECT doc_id, item_id, max(similarity) AS similarity, CAST(min(greatest(o, 0)) AS INT) AS first_token FROM s WHERE similarity >= {decontam.MIN_SIMILARITY} GROUP BY doc_id, item_id
"""


#: The key of the registered query; a user passes a secret one.
PII_KEY = "saleslens"


def op8_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymize(read(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY)


#: Quality weights by the label of a document: good, bad, none.
GOOD, BAD, UNKNOWN = 2.0, 0.5, 1.0


def qualities(labels: DataFrame) -> DataFrame:
    """(doc_id, quality): the sampling quality of every labelled document; of repeated labels the best counts."""
    best = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("label"))
    return best.select("doc_id", F.when(F.col("label") == 1, GOOD).when(F.col("label") == 0, BAD).otherwise(UNKNOWN).alias("quality"))


def op9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = materialize(read(spark, sf_dir, "documents").select("doc_id", "source", n_words(F.col("text")).alias("words")), "mix-sizes")
    rated = materialize(docs.join(qualities(read(spark, sf_dir, "labels")), "doc_id", "left"), "mix-rated")
    got = mixing.mix(rated, quality=F.coalesce("quality", F.lit(UNKNOWN)), size=F.col("words"))
    return got.select("doc_id", "size", "source_size", "target", "taken")


OP9_SQL = f"""
WITH q AS (SELECT doc_id, max(quality) AS label FROM labels GROUP BY doc_id),
d AS (
  SELECT d.doc_id, d.source, CAST(coalesce(len(regexp_extract_all(d.text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    -ln((CAST(CAST('0x' || substr(md5('0:' || coalesce(CAST(d.doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0)
      / (CASE WHEN label = 1 THEN {GOOD} WHEN label = 0 THEN {BAD} ELSE {UNKNOWN} END) AS k
  FROM documents d LEFT JOIN q ON d.doc_id = q.doc_id),
s AS (
  SELECT source, CAST(sum(size) AS DOUBLE) AS source_size, [5.0, 2.0, 1.0][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS w
  FROM d GROUP BY source),
r AS (
  SELECT *, 3.0 * source_size AS cap, row_number() OVER o AS pos,
    (sum(source_size) OVER () - coalesce(sum(3.0 * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM s WINDOW o AS (ORDER BY 3.0 * source_size / w, source NULLS LAST)),
t AS (
  SELECT source, source_size, least(cap, w * (SELECT level FROM r WHERE level <= cap / w ORDER BY pos LIMIT 1)) AS target FROM r),
e AS (
  SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE least(floor(target / source_size), 3) END AS epochs FROM t)
SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target,
  CAST(size * (epochs + CASE WHEN sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS UNBOUNDED PRECEDING) - size / 2.0
    <= target - epochs * source_size THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source
"""


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5, F.lit(0)) == 0)
    model = langid.fit_dictionaries(docs.where("not held_out"), order=F.xxhash64("doc_id"))
    return langid.identify(docs.select("doc_id", "held_out", "text"), model).drop("text")


def op11_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(read(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


#: The pages of the table hold their text in one ``article`` of a heading and paragraphs, so a pattern finds it.
OP11_SQL = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1) AS article FROM pages),
b AS (SELECT page_id, url, list_transform(regexp_split_to_array(article, '</?(?:p|h1)>'), lambda x: regexp_replace(replace(x, '<br>', ' '), '<[^>]*>', '', 'g')) AS blocks FROM a),
c AS (
  SELECT page_id, url, list_transform(blocks, lambda x: trim(regexp_replace(regexp_replace(replace(replace(replace(replace(x, '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&#x27;', ''''),
    '&amp;?', '&', 'g'), '[\s\x0B\x{A0}]+', ' ', 'g'))) AS blocks FROM b),
d AS (SELECT page_id, url, array_to_string(list_filter(blocks, lambda x: x != ''), chr(10)) AS text FROM c)
SELECT page_id, url, text, length(text) AS n_chars FROM d
"""


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    got = repair.digests(repair.repair(repair.damaged(rows)))
    ids = rows.select("conv_id").distinct()
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in repair.STATS]
    return ids.join(got, F.col("conv_id").eqNullSafe(F.col("conv")), "left").select(
        "conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def _edit(cost: str, letter: str, line: str, following: str) -> str:
    """SQL of one edit before what follows: struct of cost, audit and repaired lines."""
    return f"{{'c': {following}.c + {cost}, 'a': '{letter}' || {following}.a, 't': {line} || {following}.t}}"


def _cheapest(state: int) -> str:
    """SQL of the cheapest edit of row r in a state, turns inserted before it left aside."""
    keep = ("CASE WHEN ok THEN CASE i " + " ".join(f"WHEN '{'suao'[k]}' THEN " + _edit("late", "K", "role || ':' || text || chr(10)", f"s{repair.STEP[state][k]}")
                                                   for k in range(4) if repair.STEP[state][k] < 4) + " END END")
    to = repair.TARGET[state]
    rerole = f"CASE WHEN ok THEN {_edit('late + 1', 'R', chr(39) + repair.NAMES[to] + ':' + chr(39) + ' || text || chr(10)', f's{to}')} END"
    return f"list_min([{_edit('2', 'D', chr(39) * 2, f's{state}')}, {keep}, {rerole}])"


def _inserted(old: str, new: str) -> str:
    """SQL of the states' costs when one more turn may be inserted first."""
    more = [_edit("5", "I", f"'{repair.NAMES[repair.TARGET[q]]}:' || chr(10)", f"{old}{repair.TARGET[q]}") for q in range(4)]
    return ", ".join(f"list_min([{old}{q}, {more[q]}]) AS {new}{q}" for q in range(4))


_ENDS = [(0, "", ""), (10, "II", "'user:' || chr(10) || 'assistant:' || chr(10)"), (5, "I", "'assistant:' || chr(10)"), (0, "", "")]
OP12_SQL = rf"""
WITH RECURSIVE k AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' ||
    coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ascii(x) AS BIGINT)) AS bytes FROM conversations),
h AS (
  SELECT *, xor(list_reduce(bytes, lambda c, b: list_reduce([0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, 3988292384 * (x & 1)), xor(c, b)), 4294967295), 4294967295) % 20 AS kind FROM k),
d AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy FROM h WHERE kind != 0),
n AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS pos, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body,
    CASE WHEN role[1] IN ('s', 'u', 'a') THEN role[1] ELSE 'o' END AS i FROM d),
f AS (
  SELECT *, body = '' AS blank, body != '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS dup,
    coalesce(lag(i) OVER (PARTITION BY conv_id ORDER BY pos) || i NOT IN ('su', 'ua', 'au'), false) AS illegal FROM n),
r AS (SELECT *, NOT blank AND NOT dup AND body[-1] NOT IN ('.', '!', '?') AS truncated, NOT blank AND NOT dup AS ok, CASE WHEN truncated THEN 5 ELSE 0 END AS late FROM f),
t AS (
  SELECT conv_id, count(*) AS rows, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(blank) AS blank, count_if(dup) AS duplicate,
    count_if(truncated) AS truncated, count_if(illegal) AS illegal FROM r GROUP BY conv_id),
s AS (
  SELECT conv_id, rows AS p, {", ".join("{{'c': CAST({} AS BIGINT), 'a': '{}', 't': {}}} AS s{}".format(c, a, t or "''", q) for q, (c, a, t) in enumerate(_ENDS))} FROM t
  UNION ALL
  SELECT conv_id, p - 1, d0, d1, d2, d3 FROM (
    SELECT conv_id, p, {_inserted("c", "d")} FROM (
      SELECT conv_id, p, {_inserted("b", "c")} FROM (
        SELECT s.conv_id, p, {", ".join(f"{_cheapest(q)} AS b{q}" for q in range(4))} FROM s JOIN r ON s.conv_id IS NOT DISTINCT FROM r.conv_id AND s.p = r.pos)))),
o AS (SELECT DISTINCT conv_id FROM conversations)
SELECT o.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate,
  CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(s0.c, 0) AS BIGINT) AS cost, coalesce(s0.a, '') AS audit,
  sha256(coalesce(s0.t[:-2], '')) AS repaired_sha256
FROM o LEFT JOIN t ON o.conv_id IS NOT DISTINCT FROM t.conv_id LEFT JOIN s ON o.conv_id IS NOT DISTINCT FROM s.conv_id AND s.p = 0
"""


def op13_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = fim.transform(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                      F.sha2(fim.restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


OP13_SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{fim.TOKEN}') AS w, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
r AS (SELECT *, {", ".join(f"CAST('0x' || substr(h, {8 * i + 1}, 8) AS BIGINT) AS h{i + 1}" for i in range(4))} FROM d),
c AS (
  SELECT *, least(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS a, greatest(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM r),
p AS (
  SELECT *, array_to_string(list_slice(w, 1, a), '') AS pre, array_to_string(list_slice(w, a + 1, b), '') AS mid, array_to_string(list_slice(w, b + 1, len(w)), '') AS suf FROM c)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n, form, CASE WHEN form != 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form != 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""


QUERIES = {
    "op1_warc": op1_warc,
    "op2_neighbours": op2_neighbours,
    "op3_simhash": op3_simhash,
    "op4_substring": op4_substring,
    "op5_url_filter": op5_url_filter,
    "op6_chat": op6_chat,
    "op7_decontamination": op7_decontamination,
    "op8_pseudonyms": op8_pseudonyms,
    "op9_mix": op9_mix,
    "op10_language": op10_language,
    "op11_html": op11_html,
    "op12_repair": op12_repair,
    "op13_fim": op13_fim,
}

ORACLE_SQL: dict[str, str] = {"op1_warc": OP1_SQL, "op4_substring": OP4_SQL, "op5_url_filter": OP5_SQL, "op6_chat": OP6_SQL, "op7_decontamination": OP7_SQL, "op9_mix": OP9_SQL,
                              "op11_html": OP11_SQL, "op12_repair": OP12_SQL, "op13_fim": OP13_SQL}
