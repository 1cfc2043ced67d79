"""The registered queries of the training-data operators, with their production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.llm import chat, decontaminate, jaccard, licences, mixing, quality, sharding, tokens, urls, warc
from logweave.llm.session import stored


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return quality.rules(documents, quality.fit(documents, table(spark, sf_dir, "labels")))


def op2_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


OP3_SQL = """
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size, md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS digest FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, 2 * CAST(sum(size) AS BIGINT) AS cap,
    [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS weight FROM d GROUP BY source),
l AS (
  SELECT *, row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS no,
    (sum(source_size) OVER () * 150 / 100.0::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s),
t AS (SELECT *, least(cap::DOUBLE, weight * (SELECT level FROM l WHERE level <= cap / weight ORDER BY no LIMIT 1)) AS target FROM l),
p AS (
  SELECT d.*, t.source_size, t.target, least(t.cap, CAST(floor(t.target + 0.5) AS BIGINT)) AS stop,
    coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY digest, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
b AS (
  SELECT source, ceil(least(cap, CAST(floor(target + 0.5) AS BIGINT)) / 2048)::BIGINT AS blocks,
    sum(ceil(least(cap, CAST(floor(target + 0.5) AS BIGINT)) / 2048)::BIGINT) OVER (ORDER BY source NULLS LAST) AS upto, sum(ceil(least(cap, CAST(floor(target + 0.5) AS BIGINT)) / 2048)::BIGINT) OVER () AS n FROM t),
k AS (
  SELECT b.source, b.blocks, r.slot, row_number() OVER (PARTITION BY b.source ORDER BY r.slot) - 1 AS block
  FROM (SELECT range AS slot, (range::HUGEINT * 2654435769 % 4294967296)::BIGINT AS point FROM range((SELECT coalesce(max(n), 0)::BIGINT FROM b))) r
  JOIN b ON floor((b.upto - b.blocks) * 4294967296.0::DOUBLE / b.n) <= r.point AND r.point < floor(b.upto * 4294967296.0::DOUBLE / b.n)),
u AS (
  SELECT b.source, unnest(range(coalesce(h.have, 0), b.blocks)) AS block, b.n FROM b
  LEFT JOIN (SELECT source, count(*) AS have FROM k WHERE block < blocks GROUP BY source) h ON b.source IS NOT DISTINCT FROM h.source),
s2 AS (
  SELECT source, block, slot FROM k WHERE block < blocks
  UNION ALL SELECT source, block, n::BIGINT + row_number() OVER (ORDER BY source NULLS LAST, block) - 1 FROM u),
g AS (
  SELECT p.doc_id, p.source, p.start, p.size, min(k.slot) AS first_slot
  FROM (SELECT *, start + n * source_size AS lo, least(start + n * source_size + size, stop) AS hi FROM p, (VALUES (0), (1)) v(n)) p
  JOIN s2 k ON p.source IS NOT DISTINCT FROM k.source AND p.hi > p.lo AND k.block BETWEEN p.lo // 2048 AND (p.hi - 1) // 2048 GROUP BY ALL)
SELECT p.doc_id, CAST(p.size AS BIGINT) AS size, p.source_size, p.target, p.source,
  CAST(greatest(0, least(stop, p.start + p.size) - p.start) + greatest(0, least(stop, source_size + p.start + p.size) - (source_size + p.start)) AS BIGINT) AS taken, g.first_slot
FROM p LEFT JOIN g ON p.doc_id = g.doc_id AND p.source IS NOT DISTINCT FROM g.source AND p.start = g.start AND p.size = g.size"""


def op4_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"))


def op5_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.materialise(table(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.read(warc.write(table(spark, sf_dir, "pages").select("page_id", "url", "html")))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "digest_ok")


#: SHA-1 in base32: eight groups of five hex digits give four letters each.
_LETTERS = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, {5 * g + 1}, 5))::INT >> {15 - 5 * k}) & 31) + 1, 1)" for g in range(8) for k in range(4))
OP6_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS payload, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS top FROM pages),
d AS (SELECT *, sha1(payload) AS h, page_id IS NOT DISTINCT FROM top AS response FROM p)
SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes, {_LETTERS} AS payload_digest,
  CASE WHEN response THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN NOT response THEN top END AS refers_to, true AS digest_ok FROM d"""


#: (kind, pattern, category, action, day) of the list that stands in every run.
URL_ENTRIES = [
    ("domain", "casino-win.example.com", "gambling", "add", "2024-02-01"),
    ("domain", "casino-win.example.com", "gambling", "remove", "2024-09-01"),
    ("domain", "free-bets.example.com", "gambling", "add", "2024-01-15"),
    ("domain", "adult-x.example.net", "adult", "add", "2024-03-01"),
    ("domain", "adult-x.example.net", "adult", "remove", "2024-05-01"),
    ("domain", "adult-x.example.net", "adult", "add", "2024-08-01"),
    ("prefix", "tionble.example.org/en", "mirror", "add", "2024-04-01"),
]


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures are the pages; the fetch day follows from page_id. The list has, besides URL_ENTRIES, each host whose
    length is 2 modulo 5: added on a day that its length gives, and removed 100 days later."""
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.pmod("page_id", F.lit(365)).cast("int"))
    captures = table(spark, sf_dir, "pages").select("page_id", "url", day.alias("day"))
    fixed = spark.sql("select * from values " + ", ".join(str(x) for x in URL_ENTRIES) + " as t(kind, pattern, category, action, day)").withColumn("day", F.col("day").cast("date"))
    hosts = captures.select(urls.host(F.col("url")).alias("pattern")).where("length(pattern) % 5 = 2").distinct()
    added = F.date_add(F.lit("2024-01-01").cast("date"), (F.length("pattern") * 7 % 180).cast("int"))
    acts = F.explode(F.array(F.struct(F.lit("add").alias("action"), added.alias("day")), F.struct(F.lit("remove").alias("action"), F.date_add(added, 100).alias("day"))))
    listed = hosts.select(F.lit("domain").alias("kind"), "pattern", F.lit("listed").alias("category"), acts.alias("act")).select("kind", "pattern", "category", "act.*")
    found = urls.screen(captures, fixed.unionByName(listed))
    return found.withColumn("fetch_day", F.col("fetch_day").cast("string"))


OP7_SQL = """
WITH c AS (
  SELECT page_id, url, DATE '2024-01-01' + CAST(page_id % 365 AS INT) AS day,
    nullif(rtrim(regexp_extract(lower(url), '^[a-z][a-z0-9+.\\-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1), '.'), '') AS host,
    regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*([^?#]*)', 1) AS path FROM pages),
h AS (SELECT DISTINCT host AS pattern, DATE '2024-01-01' + CAST(length(host) * 7 % 180 AS INT) AS day FROM c WHERE length(host) % 5 = 2),
e AS (
  SELECT * FROM (VALUES """ + ", ".join(f"('{k}', '{p}', '{c}', '{a}', DATE '{d}')" for k, p, c, a, d in URL_ENTRIES) + """) t(kind, pattern, category, action, day)
  UNION ALL SELECT 'domain', pattern, 'listed', 'add', day FROM h
  UNION ALL SELECT 'domain', pattern, 'listed', 'remove', day + 100 FROM h),
i AS (
  SELECT * FROM (SELECT *, lead(day) OVER (PARTITION BY kind, pattern, category ORDER BY day) AS until FROM e) WHERE action = 'add'),
m AS (
  SELECT c.page_id, c.url, i.pattern, i.category, row_number() OVER (PARTITION BY c.page_id ORDER BY length(i.pattern) DESC, i.pattern DESC, i.category DESC) AS no, count(*) OVER (PARTITION BY c.page_id) AS n
  FROM c JOIN i ON i.day <= c.day AND (i.until IS NULL OR c.day < i.until)
    AND CASE i.kind WHEN 'domain' THEN c.host = i.pattern OR ends_with(c.host, '.' || i.pattern) ELSE c.host || c.path = i.pattern OR starts_with(c.host || c.path, i.pattern || '/') END)
SELECT c.page_id, c.host, CAST(c.day AS VARCHAR) AS fetch_day, m.n IS NOT NULL AS blocked, coalesce(m.n, 0) AS n_active, m.pattern, m.category
FROM c LEFT JOIN m ON m.page_id = c.page_id AND m.no = 1"""


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fingerprints' distance is left out, as no other engine has these fingerprints."""
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("hamming")


def _shingles_sql(words: str) -> str:
    """The shingles of a list of words, in order: of five words, or all of fewer."""
    return f"list_transform(range(1, greatest(len({words}) - 3, 2)), lambda i: array_to_string({words}[i:i + 4], ' '))"


_WORDS_SQL = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"
#: Every window of an item's length that shares a shingle with the item (or a shorter document as a whole), compared
#: by whole weighted multisets; the fingerprints only choose among these.
OP8_SQL = f"""
WITH iw AS (SELECT item_id, row_number() OVER () AS item, {_WORDS_SQL} AS w FROM benchmark),
i AS (SELECT item_id, item, len(w) AS size, least(5, len(w)) AS n, {_shingles_sql('w')} AS s FROM iw WHERE len(w) > 0),
ig AS (SELECT item, n, g, count(*) AS k FROM (SELECT item, n, unnest(s) AS g FROM i) GROUP BY ALL),
total AS (SELECT count(*) AS items FROM i),
weight AS (SELECT n, g, greatest(1, round(1000 * ln(1 + items / count(*))))::BIGINT AS weight FROM ig, total GROUP BY n, g, items),
other AS (SELECT greatest(1, round(1000 * ln(1 + items / 1)))::BIGINT AS weight FROM total),
iw2 AS (SELECT item, sum(k * weight)::BIGINT AS weight FROM ig JOIN weight USING (n, g) GROUP BY item),
dw AS (SELECT doc_id, row_number() OVER () AS doc, {_WORDS_SQL} AS w FROM documents),
lengths AS (SELECT DISTINCT n FROM i),
dg AS (SELECT doc, len(w) AS size, n, unnest(range(len(w) - n + 1)) AS pos, unnest(list_transform(range(1, len(w) - n + 2), lambda x: array_to_string(w[x:x + n - 1], ' '))) AS g FROM dw, lengths WHERE len(w) >= n),
hit AS (SELECT DISTINCT dg.doc, ig.item, dg.n, dg.pos, dg.size AS words, i.size FROM dg JOIN ig ON ig.n = dg.n AND ig.g = dg.g JOIN i ON i.item = ig.item),
win AS (
  SELECT DISTINCT doc, item, n, unnest(range(greatest(0, pos - size + n), least(pos, words - size) + 1)) AS start, size AS len FROM hit WHERE words >= size
  UNION ALL SELECT DISTINCT doc, item, n, 0, words FROM hit WHERE words < size AND n = 5),
wg AS (SELECT win.doc, win.item, win.n, win.start, win.len, dg.g, count(*) AS k FROM win JOIN dg ON dg.doc = win.doc AND dg.n = win.n AND dg.pos >= win.start AND dg.pos <= win.start + win.len - win.n GROUP BY ALL),
sums AS (
  SELECT wg.doc, wg.item, wg.start, wg.len, sum(wg.k * coalesce(w.weight, o.weight))::BIGINT AS mine, coalesce(sum(least(wg.k, ig.k) * w.weight), 0)::BIGINT AS shared
  FROM wg CROSS JOIN other o LEFT JOIN weight w ON w.n = wg.n AND w.g = wg.g LEFT JOIN ig ON ig.item = wg.item AND ig.n = wg.n AND ig.g = wg.g GROUP BY ALL),
sim AS (SELECT s.*, s.shared::DOUBLE / (s.mine + iw2.weight - s.shared)::DOUBLE AS similarity FROM sums s JOIN iw2 ON iw2.item = s.item)
SELECT dw.doc_id, i.item_id, CAST(sim.start AS BIGINT) AS first_word, CAST(sim.len AS BIGINT) AS n_words, sim.similarity FROM sim JOIN dw ON dw.doc = sim.doc JOIN i ON i.item = sim.item
WHERE sim.similarity >= 0.8::DOUBLE QUALIFY row_number() OVER (PARTITION BY sim.doc, sim.item ORDER BY sim.similarity DESC, sim.start) = 1"""


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"))


#: All pairs of texts with a shingle in common, by their whole sets; components by their closure.
OP9_SQL = f"""
WITH RECURSIVE dw AS (SELECT doc_id, {_WORDS_SQL} AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_sort(list_distinct({_shingles_sql('w')})) END AS s FROM dw),
class AS (SELECT min(doc_id) AS low, count(*) AS copies, s, len(s) AS n, row_number() OVER () AS c FROM sets WHERE len(s) > 0 GROUP BY s),
g AS (SELECT c, n, unnest(s) AS g FROM class),
pairs AS (SELECT a.c AS a, b.c AS b, a.n AS an, b.n AS bn, count(*) AS common FROM g a JOIN g b ON a.g = b.g AND a.c <> b.c AND a.n >= 0.8 * b.n AND b.n >= 0.8 * a.n GROUP BY ALL),
near AS (SELECT a, b FROM pairs WHERE 9 * common >= 4 * (an + bn)),
reach AS (SELECT c AS a, c AS b FROM class UNION SELECT r.a, n.b FROM reach r JOIN near n ON n.a = r.b),
named AS (SELECT r.a AS c, min(k.low) AS class_id FROM reach r JOIN class k ON k.c = r.b GROUP BY r.a),
linked AS (SELECT n.a AS c, sum(k.copies)::BIGINT AS links FROM near n JOIN class k ON k.c = n.b GROUP BY n.a)
SELECT d.doc_id, CASE WHEN k.c IS NULL THEN d.doc_id ELSE m.class_id END AS class_id, CAST(CASE WHEN k.c IS NULL THEN 0 ELSE k.copies - 1 + coalesce(l.links, 0) END AS BIGINT) AS n_links
FROM sets d LEFT JOIN class k ON k.s = d.s LEFT JOIN named m ON m.c = k.c LEFT JOIN linked l ON l.c = k.c"""


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return chat.read_back(stored(chat.format_turns(turns.unionByName(more)), "chat"))


OP10_SQL = r"""
WITH said AS (SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, coalesce(text, '')) AS rn FROM said),
c AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY rn) AS turns, coalesce(string_agg(text, '' ORDER BY rn) FILTER (role = 'assistant'), '') AS loss,
  sum(14 + length(role) + len(regexp_extract_all(role, '\\|###|</turn>|<\||:|\n')) + length(text) + len(regexp_extract_all(text, '\\|###|</turn>|<\|')))::BIGINT AS formatted_chars FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars, 0::BIGINT AS n_attachments, 0::BIGINT AS expanded_tokens FROM c"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_kd_sharding": op2_kd_sharding,
    "op3_source_mixing": op3_source_mixing,
    "op4_license_scans": op4_license_scans,
    "op5_token_output": op5_token_output,
    "op6_warc": op6_warc,
    "op7_url_filters": op7_url_filters,
    "op8_benchmark_decontamination": op8_benchmark_decontamination,
    "op9_ngram_jaccard": op9_ngram_jaccard,
    "op10_chat_formatting": op10_chat_formatting,
}

ORACLE_SQL: dict[str, str] = {
    "op3_source_mixing": OP3_SQL,
    "op6_warc": OP6_SQL,
    "op7_url_filters": OP7_SQL,
    "op8_benchmark_decontamination": OP8_SQL,
    "op9_ngram_jaccard": OP9_SQL,
    "op10_chat_formatting": OP10_SQL,
}
