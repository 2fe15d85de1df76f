"""Conditional updates over a stream of attempts.

State per id: the current revision. Attempts of one micro-batch are applied in
ascending seq, batches in order of arrival; ``revise_in_order`` applies them in
order of seq over all batches. Of the attempts that an id has in a batch, 16
bytes each are held to sort them; outcomes are given in pieces. A seq that is
repeated within a batch raises; over batches that isn't noticed.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

OUT = "id string, seq bigint, status int, revision bigint"


#: Outcomes of an id at once.
PIECE = 100_000


def _step(key, frames, state):
    current, seqs, named = (state.get[0] if state.exists else None), [], []
    for frame in frames:
        if current is None:
            known = frame["revision"].dropna()
            current = int(known.iloc[0]) if len(known) else None
        seqs.append(frame["seq"].to_numpy(np.int64))
        named.append(frame["expected"].to_numpy(np.float64))
    seqs, named = np.concatenate(seqs), np.concatenate(named)
    order = np.argsort(seqs, kind="stable")
    repeated = np.flatnonzero(np.diff(seqs[order]) == 0)
    if len(repeated):
        raise ValueError(f"{key[0]!r} has two attempts of seq {seqs[order][repeated[0]]}")
    for lo in range(0, len(order), PIECE):
        status, after, part = [], [], order[lo : lo + PIECE]
        for expected in named[part].tolist():
            if current is None:
                status.append(404)
            elif expected == current:  # NaN, a missing revision, equals nothing
                current += 1
                status.append(200)
            else:
                status.append(409)
            after.append(current)
        yield pd.DataFrame({"id": key[0], "seq": seqs[part], "status": status, "revision": pd.array(after, dtype="Int64")})
    if current is not None:
        state.update((current,))


def revise_stream(attempts: DataFrame, records: DataFrame) -> DataFrame:
    """Streaming outcomes (id, seq, status, revision) of streaming attempts against the static records.

    A record's stored revision seeds the state at its first attempt; an id that
    ``records`` lacks gets 404 each time.
    """
    seeded = attempts.join(records.select("id", "revision"), "id", "left").select(
        "id", "seq", F.col("expected").cast("double").alias("expected"), "revision"
    )
    return seeded.groupBy("id").applyInPandasWithState(_step, OUT, "revision bigint", "append", GroupStateTimeout.NoTimeout)
