"""Parcel edits as a stream: optimistic locking with one version per parcel as state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SCHEMA = "parcel long, seq long, accepted boolean, version long"


def _apply(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    version = state.get[0] if state.exists else 1
    rows = pd.concat(list(frames)).sort_values("seq")
    out = []
    for seq, named in zip(rows["seq"], rows["version"], strict=True):
        accepted = named == version
        version += int(accepted)
        out.append((key[0], seq, bool(accepted), version))
    state.update((int(version),))
    yield pd.DataFrame(out, columns=["parcel", "seq", "accepted", "version"])


def accepted_edits(edits: DataFrame) -> DataFrame:
    """Each edit of ``parcel, seq, version`` with its verdict and the version after it.

    An edit is accepted if it names the parcel's current version, which begins at 1. Edits of one
    micro-batch are taken in the order of ``seq``.
    """
    return edits.groupBy("parcel").applyInPandasWithState(_apply, SCHEMA, "version long", "append", GroupStateTimeout.NoTimeout)
