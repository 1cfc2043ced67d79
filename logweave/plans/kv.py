"""Registered queries over the mutation log: reads, merges, garbage collection, maintenance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logweave.operators import maintenance, mvcc
from logweave.shared import new_folder
from logweave.sources import fixtures

SNAPSHOT, LIMIT = 5000, 20
START, END = "user000000000010", "user000000000100"


def _text(df: DataFrame) -> DataFrame:
    """Binary columns as text, for results that any engine can compare."""
    return df.select(*[F.col(c).cast("string").alias(c) if t == "binary" else F.col(c) for c, t in df.dtypes])


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.mutations(spark, sf_dir)


def _key(text: str) -> F.Column:
    return F.lit(text).cast("binary")


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten versions a frame; frame 70 is damaged, and so is 80."""
    log = _log(spark, sf_dir).withColumn("frame", F.floor((F.col("seq") - 1) / 10))
    frames = log.groupBy("frame").agg(F.min("seq").alias("first_seq"), F.array_sort(F.collect_list(F.struct("seq", "key", "value"))).alias("o"))
    ops = F.transform("o", lambda x: F.struct(x["key"].alias("key"), x["value"].alias("value")))
    return frames.select("frame", "first_seq", ops.alias("ops"), (~F.col("frame").isin(70, 80)).alias("valid"))


def _visible_sql(bound: str = "", keys: str = "") -> str:
    where = " AND ".join(x for x in (bound, keys) if x)
    return f"visible AS (SELECT key, seq, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM log{' WHERE ' + where if where else ''}) WHERE rn = 1)"


_RANGE = f"key >= '{START}' AND key < '{END}'"
_STATUS = "CASE WHEN v.key IS NULL THEN 'missing' WHEN v.value IS NULL THEN 'tombstone' ELSE 'live' END AS status, v.value"
def _entry_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log entries under their keys, a tenth of them overwritten later, and the two metadata keys."""
    e = fixtures.events(spark, sf_dir)
    first = e.select(maintenance.entry_key(F.col("event_id") + 1).alias("key"), (F.col("event_id") + 1).alias("seq"), F.col("event_type").cast("binary").alias("value"))
    again = e.where("event_id % 10 = 0").select(maintenance.entry_key(F.col("event_id") + 1).alias("key"), (F.col("event_id") + 10_000_000).alias("seq"), F.when(F.col("event_id") % 20 == 0, F.lit("replaced").cast("binary")).alias("value"))
    meta = spark.range(2).select(F.when(F.col("id") == 0, F.lit(maintenance.HARD_STATE_KEY)).otherwise(F.lit(maintenance.SNAPSHOT_KEY)).alias("key"), (F.col("id") + 90_000_000).alias("seq"), F.lit(b"x").alias("value"))
    return first.unionByName(again).unionByName(meta)


_PINS = "SELECT * FROM VALUES (4000L), (7500L) AS t(seq)"
HORIZON = 4000


def _written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log as sorted tables in the shared folder."""
    path = new_folder(spark, "tables")
    maintenance.write_tables(_log(spark, sf_dir), path, 8)
    return spark.read.schema(_log(spark, sf_dir).schema).parquet(path)


def _leveled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log in tables of 500 versions, levels 0 to 2."""
    table = F.floor((F.col("seq") - 1) / 500)
    return _log(spark, sf_dir).select((table % 3).cast("int").alias("level"), table.alias("id"), "key", "seq", "value")


def _pin_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots of every 40th version, each taken by three readers; all but those of every 400th are released."""
    e = fixtures.events(spark, sf_dir)
    taken = e.where("event_id % 40 = 0").select("event_id", F.col("event_id").alias("seq"), F.explode(F.sequence(F.lit(1), F.lit(3))).alias("reader"))
    released = taken.where("event_id % 400 != 0 or reader != 2")
    return taken.select("seq", F.lit(1).alias("delta")).unionByName(released.select("seq", F.lit(-1).alias("delta")))

QUERIES = {
    # SC1, SC2, SC5, SC11: three-way outcome of a point read
    "kv_get_latest": lambda s, d: _text(mvcc.get(_log(s, d), _key("user000000000042"))),
    "kv_get_asof": lambda s, d: _text(mvcc.get(_log(s, d), _key("user000000000042"), 700)),
    "kv_multi_get": lambda s, d: _text(mvcc.multi_get(_log(s, d), s.range(1, 400, 3).select(F.format_string("user%012d", "id").cast("binary").alias("key")), SNAPSHOT)),
    # SC3, SC4, SC6
    "kv_scan_latest": lambda s, d: _text(mvcc.scan(_log(s, d), _key(START), _key(END))),
    "kv_scan_asof": lambda s, d: _text(mvcc.scan(_log(s, d), _key(START), _key(END), snapshot=SNAPSHOT)),
    "kv_scan_limit": lambda s, d: _text(mvcc.scan(_log(s, d), _key(START), _key(END), LIMIT, SNAPSHOT)),
    "kv_scan_open_end": lambda s, d: _text(mvcc.scan(_log(s, d), _key("user000000000120"))),
    # MV1, MV2, SC7, SC12
    "kv_visible_with_tombstones": lambda s, d: _text(mvcc.visible(_log(s, d), SNAPSHOT)),
    "kv_live_view": lambda s, d: _text(mvcc.live(mvcc.visible(_log(s, d), SNAPSHOT))),
    "kv_dump": lambda s, d: _text(mvcc.dump(_log(s, d))),
    "kv_versions_in_order": lambda s, d: _text(mvcc.versions(_log(s, d)).withColumn("place", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("seq"))))),
    # MV3-MV5
    "kv_merge_sources": lambda s, d: _text(mvcc.merge(_log(s, d).where("seq % 2 = 0"), _log(s, d).where("seq % 2 = 1 or seq % 10 = 0"))),
    "kv_dedup_versions": lambda s, d: mvcc.merge(_log(s, d), _log(s, d).where("seq > 100 and seq <= 900")).groupBy("key").agg(F.count(F.lit(1)).alias("versions")).transform(_text),
    # MV6-MV8
    "kv_gc_horizon": lambda s, d: mvcc.horizon(_log(s, d), s.sql(_PINS)),
    "kv_gc_retained": lambda s, d: _text(mvcc.collect_garbage(_log(s, d), HORIZON)),
    "kv_gc_bottom": lambda s, d: _text(mvcc.collect_garbage(_log(s, d), HORIZON, bottom=True)),
    # MV9-MV11, SC8
    "kv_batch_sequences": lambda s, d: _text(mvcc.number_batches(_frames(s, d))),
    "kv_replace_all": lambda s, d: _text(mvcc.dump(mvcc.replace_all(_log(s, d), mvcc.dump(_log(s, d), 2000), 1_000_000))),
    # SC31, MT1, MT2
    "kv_position": lambda s, d: _text(mvcc.position(_log(s, d))),
    "kv_memtable_bytes": lambda s, d: maintenance.memory(_log(s, d), 200_000),
    "kv_flush_point": lambda s, d: maintenance.flush_point(_log(s, d), 200_000),
    # MT3-MT6, MT9, MT10
    "kv_table_stats": lambda s, d: _text(maintenance.table_stats(_log(s, d), F.floor((F.col("seq") - 1) / 500))),
    "kv_level_counts": lambda s, d: maintenance.level_counts(fixtures.tables(s, d), 5),
    "kv_compaction_trigger": lambda s, d: maintenance.compaction_due(fixtures.tables(s, d), 5, base=100_000),
    "kv_compaction_sources": lambda s, d: maintenance.compaction_sources(fixtures.tables(s, d)).select("level", "id"),
    "kv_overlap_pairs": lambda s, d: maintenance.overlaps(fixtures.tables(s, d).where("level = 1"), fixtures.tables(s, d).where("level = 2")),
    # MT7
    "kv_compact": lambda s, d: _text(maintenance.compact([_log(s, d).where("seq <= 6000"), _log(s, d).where("seq > 5000")], HORIZON, True, 50_000)),
    # MT3 until nothing is due: what the tables hold stays the same
    "kv_settled": lambda s, d: _text(mvcc.dump(maintenance.settle(_leveled(s, d), HORIZON, 5, 4, 200_000, 4, 100_000).select("key", "seq", "value"))),
    # SC13-SC15: reads of written tables
    "kv_written_multi_get": lambda s, d: _text(mvcc.multi_get(_written(s, d), s.range(1, 400, 3).select(F.format_string("user%012d", "id").cast("binary").alias("key")), SNAPSHOT)),
    "kv_written_scan": lambda s, d: _text(mvcc.scan(_written(s, d), _key(START), _key(END), snapshot=SNAPSHOT)),
    # MV8
    "kv_pinned": lambda s, d: mvcc.pinned(_pin_events(s, d)),
    "wal_opened": lambda s, d: maintenance.opened(300, _frames(s, d), 20_000),
    # DL1-DL3, SC19, SC21, SC30
    "wal_valid_prefix": lambda s, d: maintenance.valid_prefix(_frames(s, d)).select("frame", "first_seq", F.size("ops").alias("n")),
    "wal_recover": lambda s, d: mvcc.position(maintenance.recover(_log(s, d).where("seq <= 300"), _frames(s, d))).transform(_text),
    "logstore_entries": lambda s, d: _text(maintenance.stored_entries(_entry_store(s, d))),
    "wal_framing": lambda s, d: maintenance.framed(_log(s, d).select("seq", F.col("key").alias("data"), F.when(F.col("seq") % 50 == 0, 17).otherwise(16).alias("length"), F.when(F.col("seq") % 77 == 0, 0).otherwise(F.crc32("key")).alias("crc"))).groupBy("valid").agg(F.count(F.lit(1)).alias("n")),
    "manifest_choice": lambda s, d: maintenance.first_valid(s.sql("SELECT * FROM VALUES (1, false, 'main'), (2, true, 'temporary'), (3, true, 'older') AS t(place, valid, name)")),
    # DL5, SC17
    "block_checksums": lambda s, d: maintenance.with_checksum(_log(s, d).select("seq", F.col("key").alias("data"), F.when(F.col("seq") % 97 == 0, 0).otherwise(F.crc32("key")).alias("crc"))).groupBy("intact").agg(F.count(F.lit(1)).alias("n")),
}

_SQL = {
    "kv_get_latest": f"{_visible_sql()} SELECT k.key, {_STATUS} FROM (VALUES ('user000000000042')) k(key) LEFT JOIN visible v ON v.key = k.key",
    "kv_get_asof": f"{_visible_sql('seq <= 700')} SELECT k.key, {_STATUS} FROM (VALUES ('user000000000042')) k(key) LEFT JOIN visible v ON v.key = k.key",
    "kv_multi_get": f"{_visible_sql(f'seq <= {SNAPSHOT}')} SELECT k.key, {_STATUS} FROM (SELECT printf('user%012d', range) AS key FROM range(1, 400, 3)) k LEFT JOIN visible v ON v.key = k.key",
    "kv_scan_latest": f"{_visible_sql(keys=_RANGE)} SELECT key, value FROM visible WHERE value IS NOT NULL",
    "kv_scan_asof": f"{_visible_sql(f'seq <= {SNAPSHOT}', _RANGE)} SELECT key, value FROM visible WHERE value IS NOT NULL",
    "kv_scan_limit": f"{_visible_sql(f'seq <= {SNAPSHOT}', _RANGE)} SELECT key, value FROM visible WHERE value IS NOT NULL ORDER BY key LIMIT {LIMIT}",
    "kv_scan_open_end": _visible_sql(keys="key >= 'user000000000120'") + " SELECT key, value FROM visible WHERE value IS NOT NULL",
    "kv_visible_with_tombstones": f"{_visible_sql(f'seq <= {SNAPSHOT}')} SELECT * FROM visible",
    "kv_live_view": f"{_visible_sql(f'seq <= {SNAPSHOT}')} SELECT * FROM visible WHERE value IS NOT NULL",
    "kv_dump": f"{_visible_sql()} SELECT key, value FROM visible WHERE value IS NOT NULL",
    "kv_versions_in_order": "x AS (SELECT 1) SELECT *, CAST(row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS INT) AS place FROM log",
    "kv_merge_sources": "x AS (SELECT 1) SELECT * FROM log",
    "kv_dedup_versions": "x AS (SELECT 1) SELECT key, count(*) AS versions FROM log GROUP BY key",
    "kv_gc_horizon": "p(seq) AS (VALUES (4000::BIGINT), (7500)) SELECT coalesce((SELECT min(seq) FROM p), (SELECT max(seq) FROM log)) AS horizon",
    "kv_gc_retained": f"r AS (SELECT *, row_number() OVER (PARTITION BY key, seq <= {HORIZON} ORDER BY seq DESC) AS rn FROM log) SELECT key, seq, value FROM r WHERE seq > {HORIZON} OR rn = 1",
    "kv_gc_bottom": f"r AS (SELECT *, row_number() OVER (PARTITION BY key, seq <= {HORIZON} ORDER BY seq DESC) AS rn FROM log) SELECT key, seq, value FROM r WHERE seq > {HORIZON} OR (rn = 1 AND value IS NOT NULL)",
    "kv_batch_sequences": "x AS (SELECT 1) SELECT * FROM log",
    "kv_replace_all": f"{_visible_sql('seq <= 2000')} SELECT key, value FROM visible WHERE value IS NOT NULL",
    "kv_position": "x AS (SELECT 1) SELECT max(seq) AS last_seq, count(*) AS versions, CAST(sum(strlen(key) + coalesce(strlen(value), 0) + 24) AS BIGINT) AS bytes, min(key) AS min_key, max(key) AS max_key FROM log",
    "kv_memtable_bytes": "b AS (SELECT CAST(sum(strlen(key) + coalesce(strlen(value), 0) + 24) AS BIGINT) AS bytes FROM log) SELECT bytes, bytes >= 200000 AS flush FROM b",
    "kv_flush_point": "b AS (SELECT seq, sum(strlen(key) + coalesce(strlen(value), 0) + 24) OVER (ORDER BY seq) AS total FROM log) SELECT min(seq) AS seq FROM b WHERE total >= 200000",
    "kv_table_stats": "x AS (SELECT 1) SELECT id, min_key, max_key, entries, bytes, max_seq FROM tables",
    "kv_level_counts": "x AS (SELECT 1) SELECT CAST(l.range AS INT) AS level, count(t.id) AS tables, CAST(coalesce(sum(t.bytes), 0) AS BIGINT) AS bytes FROM range(5) l LEFT JOIN tables t ON t.level = l.range GROUP BY l.range",
    "kv_compaction_trigger": """c AS (SELECT CAST(l.range AS INT) AS level, count(t.id) AS tables, CAST(coalesce(sum(t.bytes), 0) AS BIGINT) AS bytes FROM range(5) l LEFT JOIN tables t ON t.level = l.range GROUP BY l.range),
  m AS (SELECT *, CAST(100000 * pow(10, greatest(level - 1, 0)) AS BIGINT) AS byte_limit FROM c)
  SELECT *, CASE WHEN level = 0 THEN tables >= 4 ELSE bytes > byte_limit END AS due FROM m""",
    "kv_compaction_sources": "m AS (SELECT *, min(id) OVER (PARTITION BY level) AS low FROM tables) SELECT level, id FROM m WHERE level = 0 OR id = low",
    "kv_overlap_pairs": "x AS (SELECT 1) SELECT a.id AS input_id, b.id FROM tables a JOIN tables b ON a.level = 1 AND b.level = 2 AND b.max_key >= a.min_key AND b.min_key <= a.max_key",
    # a table begins at the first key before which the open one has the target; it counts 17 bytes beside key and value
    "kv_compact": f"""r AS (SELECT *, row_number() OVER (PARTITION BY key, seq <= {HORIZON} ORDER BY seq DESC) AS rn FROM log),
  k AS (SELECT key, seq, value FROM r WHERE seq > {HORIZON} OR (rn = 1 AND value IS NOT NULL)),
  b AS (SELECT key, sum(strlen(key) + coalesce(strlen(value), 0) + 17)::BIGINT AS b FROM k GROUP BY key),
  p AS (SELECT key, (sum(b) OVER (ORDER BY key))::BIGINT - b AS at FROM b),
  t AS (SELECT 0::BIGINT AS no, 0::BIGINT AS at UNION ALL SELECT t.no + 1, min(p.at) FROM t JOIN p ON p.at >= t.at + 50000 GROUP BY t.no),
  w AS (SELECT p.key, max(t.no) AS "table" FROM p JOIN t ON t.at <= p.at GROUP BY p.key)
  SELECT k.*, w."table" FROM k JOIN w ON w.key = k.key""",
    "kv_settled": f"{_visible_sql()} SELECT key, value FROM visible WHERE value IS NOT NULL",
    "kv_written_multi_get": f"{_visible_sql(f'seq <= {SNAPSHOT}')} SELECT k.key, {_STATUS} FROM (SELECT printf('user%012d', range) AS key FROM range(1, 400, 3)) k LEFT JOIN visible v ON v.key = k.key",
    "kv_written_scan": f"{_visible_sql(f'seq <= {SNAPSHOT}', _RANGE)} SELECT key, value FROM visible WHERE value IS NOT NULL",
    "kv_pinned": "x AS (SELECT 1) SELECT event_id AS seq, 1::BIGINT AS count FROM events WHERE event_id % 400 = 0",
    "wal_opened": "r AS (SELECT * FROM log WHERE seq <= 700), o AS (SELECT greatest(300, max(seq)) AS last_seq, CAST(sum(strlen(key) + coalesce(strlen(value), 0) + 24) AS BIGINT) AS bytes FROM r) SELECT *, bytes >= 20000 AS flush FROM o",
    "wal_valid_prefix": "f AS (SELECT (seq - 1) // 10 AS frame, min(seq) AS first_seq, CAST(count(*) AS INT) AS n FROM log GROUP BY (seq - 1) // 10) SELECT * FROM f WHERE frame < 70",
    "wal_recover": "r AS (SELECT * FROM log WHERE seq <= 700) SELECT max(seq) AS last_seq, count(*) AS versions, CAST(sum(strlen(key) + coalesce(strlen(value), 0) + 24) AS BIGINT) AS bytes, min(key) AS min_key, max(key) AS max_key FROM r",
    "logstore_entries": "x AS (SELECT 1) SELECT event_id + 1 AS index, CASE WHEN event_id % 20 = 0 THEN 'replaced' ELSE event_type END AS value FROM events WHERE event_id % 10 <> 0 OR event_id % 20 = 0",
    "wal_framing": "x AS (SELECT 1) SELECT seq % 50 <> 0 AND seq % 77 <> 0 AS valid, count(*) AS n FROM log GROUP BY 1",
    "manifest_choice": "x AS (SELECT 1) SELECT 2 AS place, true AS valid, 'temporary' AS name",
    "block_checksums": "x AS (SELECT 1) SELECT seq % 97 <> 0 AS intact, count(*) AS n FROM log GROUP BY 1",
}
ORACLE_SQL = {k: f"WITH RECURSIVE {fixtures.TABLES if 'tables' in v else fixtures.LOG}, {v}" for k, v in _SQL.items()}
