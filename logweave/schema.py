"""Schemas of the canonical tables, and the engine's fixed values."""

from __future__ import annotations

#: A mutation: null value = tombstone. Keys compare bytewise, unsigned, as Spark orders binaries.
MUTATIONS = "key binary, seq bigint, value binary"
#: A write batch of the log: op i has sequence number first_seq + i.
BATCHES = "first_seq bigint, ops array<struct<key: binary, value: binary>>"
#: A frame of the write-ahead log.
FRAMES = "frame bigint, first_seq bigint, ops array<struct<key: binary, value: binary>>, valid boolean"
COMMANDS = "log_index bigint, session_id bigint, client_seq bigint, op string, key string, value string, expect string, new string"
LOG_ENTRIES = "node bigint, index bigint, term bigint, kind string, payload string"
HISTORY = "key bigint, client bigint, invoke bigint, ret bigint, op string, value bigint, expect bigint, new bigint, success boolean"
TABLE_CATALOG = "id bigint, level int, min_key binary, max_key binary, entries bigint, bytes bigint"

# They must equal what the engine under study uses.
ENTRY_OVERHEAD_BYTES = 24
MEMTABLE_BYTES, LEVEL0_TRIGGER, LEVEL_BASE_BYTES, LEVEL_MULTIPLIER = 4 << 20, 4, 32 << 20, 10
TABLE_BYTES, BLOCK_BYTES, BLOOM_BITS_PER_KEY = 4 << 20, 4096, 10
BLOOM_MIN_BITS, BLOOM_MAX_PROBES, BLOOM_LN2 = 64, 30, 0.69
ELECTION_TICK_MIN, ELECTION_TICK_MAX, MAX_INFLIGHT, MAX_BATCH_ENTRIES = 10, 20, 10, 64
PENDING_DEADLINE_TICKS, FRAME_CAP_BYTES, SNAPSHOT_EVERY = 50, 64 << 20, 8192
CHECKER_BUDGET, CHECKER_MAX_OPS, EVENT_BUDGET = 5_000_000, 4096, 3_000_000
CLIENT_MAX_ATTEMPTS, BACKOFF_MAX_SHIFT, BACKOFF_MIN_FRACTION = 12, 6, 0.1
ZIPF_THETA, RECENT_INSERTS, SCAN_LENGTH = 0.99, 1000, 100
