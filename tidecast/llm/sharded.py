"""A sharded index in the shared folder: one minimal perfect hash with arrays by slot for each shard.

Entries are (h, f, values...): h is a 64-bit hash that picks shard and slot, f a
stored fingerprint that tells members from strangers. Distinct entries with one
h are rare; all but one of them are kept beside the slots and found exactly.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidecast.llm import mph
from tidecast.llm.common import put_file, read_file, written

SHARD_KEYS = 262_144


def shard_of(shards: int) -> Column:
    return F.expr(f"pmod(h, {shards}L)")


def file_name(shard: int) -> str:
    return f"shard-{shard:07d}.idx"


def build(entries: DataFrame, shards: int, folder: str) -> DataFrame:
    """Write a file for each shard; returns the written table (shard, n_keys, n_bytes). All columns of ``entries`` are longs."""
    values = [c for c in entries.columns if c not in ("h", "f")]

    def one(number: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        h = rows["h"].to_numpy(np.int64).view(np.uint64)
        _, first = np.unique(h, return_index=True)
        index = mph.PerfectHash.build(h[first])
        at = first[np.argsort(index.slots(h[first]))]
        more = np.setdiff1d(np.arange(len(h)), first)
        columns = {c: rows[c].to_numpy(np.int64) for c in ("h", "f", *values)}
        arrays = {c: x[at] for c, x in columns.items() if c != "h"} | {f"more_{c}": x[more] for c, x in columns.items()}
        blob, k = mph.pack(index, **arrays), int(number["shard"].iloc[0])
        put_file(folder, file_name(k), iter([blob]))
        return pd.DataFrame({"shard": [k], "n_keys": [len(h)], "n_bytes": [len(blob)]})

    numbers = entries.sparkSession.range(shards).withColumnRenamed("id", "shard")  # a shard without keys has a file too
    dealt = entries.withColumn("shard", shard_of(shards))
    made = numbers.groupBy("shard").cogroup(dealt.groupBy("shard")).applyInPandas(one, "shard long, n_keys long, n_bytes long")
    return written(made, "index-shards")


class Reader:
    """Looks up hashes; holds one shard at a time, so callers sort by shard."""

    def __init__(self, folder: str):
        self.folder, self.held = folder, None

    def find(self, shard: np.ndarray, h: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """Which entries are members, and their values (zero for strangers)."""
        member = np.zeros(len(h), bool)
        out: dict[str, np.ndarray] = {}
        for k in np.unique(shard):
            if k != self.held:
                (self.index, self.arrays), self.held = mph.unpack(read_file(self.folder, file_name(int(k)))), k
            own = np.flatnonzero(shard == k)
            slot = self.index.slots(h[own].view(np.uint64))
            fit = slot >= 0
            fit[fit] = self.arrays["f"][slot[fit]] == f[own[fit]]
            names = [c for c in self.arrays if c != "f" and not c.startswith("more_")]
            for c in names:
                out.setdefault(c, np.zeros(len(h), np.int64))[own[fit]] = self.arrays[c][slot[fit]]
            member[own[fit]] = True
            for i in range(len(self.arrays["more_h"])):
                same = own[(h[own] == self.arrays["more_h"][i]) & (f[own] == self.arrays["more_f"][i])]
                member[same] = True
                for c in names:
                    out[c][same] = self.arrays[f"more_{c}"][i]
        return member, out
