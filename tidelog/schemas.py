"""Canonical schemas of the tables that the operators exchange."""

from __future__ import annotations

OP_LOG = "idx BIGINT, term BIGINT, part INT, client_id BIGINT, seq BIGINT, op STRING, k STRING, v STRING"
KV_STATE = "k STRING, v STRING, version BIGINT"
RUN_ENTRY = "level INT, run_id BIGINT, k STRING, is_tombstone BOOLEAN, v STRING"
MANIFEST = "level INT, run_id BIGINT, size BIGINT, smallest STRING, largest STRING"
RING = "point DECIMAL(20,0), node_id BIGINT"
PLACEMENT = "part INT, pos INT, node_id BIGINT"
HISTORY = "client INT, op STRING, k STRING, input STRING, output STRING, call_ns BIGINT, ret_ns BIGINT"
REPLICA_LOG = "part INT, node_id BIGINT, idx BIGINT, term BIGINT, etype STRING, data STRING"

MUTATIONS = ("put", "append", "delete")
RESETS = ("put", "delete")
