"""Commands over a snapshot folder: ``python -m tidelog.cli FOLDER get|put|append|del KEY [VALUE...]``.

Each write is a batch of one entry that goes through the exactly-once rule under a client id of its own. For many writes use the streaming forms.
"""

from __future__ import annotations

import secrets
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tidelog.operators import fold
from tidelog.operators.oplog import key_status
from tidelog.schemas import OP_LOG
from tidelog.session import session
from tidelog.sources.snapshots import Snapshots
from tidelog.streaming.apply import advance

WRITES = {"put": "put", "append": "append", "del": "delete"}


def run(spark: SparkSession, folder: str, words: list[str]) -> str:
    """The answer to one command."""
    if len(words) < 2 or words[0] not in ("get", *WRITES) or words[0] in ("put", "append") and len(words) < 3:
        return "usage: get KEY | put KEY VALUE... | append KEY VALUE... | del KEY"
    kind, key, value = words[0], words[1], " ".join(words[2:])
    if spark.range(1).select(key_status(F.lit(key)).alias("s")).first().s != "ok":
        return "invalid key"
    store = Snapshots(folder)
    state, seqs = store.load(spark)
    if kind == "get":
        found = fold.get(state, key).first()
        return "(not found)" if found is None else found.v
    at = store.committed(spark) + 1
    entry = spark.createDataFrame([(at + 1, 1, 0, secrets.randbits(62), 1, WRITES[kind], key, value if kind != "del" else None)], OP_LOG)
    after, last, _ = advance(state, seqs, entry)
    store.commit(spark, at, after, last)
    return "ok"


if __name__ == "__main__":
    if len(sys.argv) < 3:
        sys.exit(__doc__)
    print(run(session("tidelog-cli"), sys.argv[1], sys.argv[2:]))
