"""Best-fit packing of documents into training sequences, with conflicts.

Documents are dealt into groups of bounded size by a hash, so that a source or a duplicate cluster spreads over all
groups. In a group, longest pieces first, each goes to the open bin with the least room that still holds it and that has
neither its source nor its duplicate cluster; bins stand in order of room and the search goes on to the next until one
is compatible.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from limpid.llm.dedup import normalized
from limpid.llm.words import Words, parts

#: Tokens a sequence holds.
CAPACITY = 1024
#: Expected documents of a packing group.
GROUP_ROWS = 10_000


class Bins:
    """Open bins in order of room. Sources and clusters are small integers; a bin has a bitmap of each."""

    def __init__(self, capacity: int):
        self.capacity, self.open, self.sources, self.clusters = capacity, [], [], []

    def place(self, size: int, source: int | None, cluster: int | None) -> int:
        """The bin that takes a piece; None conflicts with nothing."""
        s = 0 if source is None else 1 << source
        c = 0 if cluster is None else 1 << cluster
        at = bisect_left(self.open, (size, -1))
        while at < len(self.open):
            room, b = self.open[at]
            if not (self.sources[b] & s or self.clusters[b] & c):
                del self.open[at]
                break
            at += 1
        else:
            room, b = self.capacity, len(self.sources)
            self.sources.append(0)
            self.clusters.append(0)
        self.sources[b] |= s
        self.clusters[b] |= c
        if room > size:
            insort(self.open, (room - size, b))
        return b


def _numbers(values: pd.Series) -> list[int | None]:
    """Small integers for the values; None for null, and for values that occur once, which conflict with nothing."""
    codes, _ = pd.factorize(values)
    often = pd.Series(codes).map(pd.Series(codes).value_counts()).to_numpy() > 1
    again, _ = pd.factorize(pd.Series(codes).where(often & (codes >= 0)))
    return [None if x < 0 else int(x) for x in again]


def pack_group(rows: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """Rows of (group, doc_id, n_tokens, source, cluster) to pieces of (doc_id, piece, first_token, n_tokens, bin_id)."""
    rows = rows.sort_values(["n_tokens", "doc_id", "cluster", "source"], ascending=[False, True, True, True], kind="stable").reset_index(drop=True)
    out, pending = [], []
    bins = Bins(capacity)
    whole = 0
    for i, (key, n, source, cluster) in enumerate(zip(rows["doc_id"].tolist(), rows["n_tokens"].tolist(), _numbers(rows["source"]), _numbers(rows["cluster"]))):
        full, rest = divmod(int(n), capacity)
        for piece in range(full):  # full pieces fill a bin each
            out.append((i, piece, piece * capacity, capacity, -1 - whole))
            whole += 1
        if rest:
            pending.append((rest, i, full, source, cluster))
    pending.sort(key=lambda x: (-x[0], x[1]))
    for rest, i, piece, source, cluster in pending:
        out.append((i, piece, piece * capacity, rest, bins.place(rest, source, cluster)))
    found = pd.DataFrame(out, columns=["row", "piece", "first_token", "n_tokens", "bin_id"])
    used = len(bins.sources)
    found.loc[found["bin_id"] < 0, "bin_id"] = used - 1 - found["bin_id"]
    found["bin_id"] += int(rows["group"].iloc[0]) << 32
    found["doc_id"] = rows["doc_id"].to_numpy()[found["row"]] if len(found) else pd.Series(dtype="Int64")
    return found[["doc_id", "piece", "first_token", "n_tokens", "bin_id"]]


def sized(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", cluster: str | None = None) -> DataFrame:
    """doc_id, source, cluster and n_tokens (words, and one end) of every row.

    ``cluster`` names a column of duplicate clusters; without it equal texts, A-Z lower-cased, are a cluster.
    """
    group = F.sha2(normalized(text), 256) if cluster is None else F.col(cluster).cast("string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches):
            n = pa.array(Words(part.column("text")).counts() + 1, pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), n], ["doc_id", "source", "cluster", "n_tokens"])

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(source).alias("source"), group.alias("cluster"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, source string, cluster string, n_tokens long")


def pack(rows: DataFrame, n_rows: int, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of all documents in bins: doc_id, piece, first_token, n_tokens, bin_id, bin_fill.

    ``rows`` has doc_id, source, cluster and n_tokens and ``n_rows`` of them, about. A document longer than a bin is cut
    into full pieces, which fill bins of their own, and a rest. No bin has two pieces of a source or of a cluster; a null
    source or cluster conflicts with nothing. A document of no tokens has no pieces. Equal rows are packed one by one.
    """
    groups = max(1, -(-n_rows // GROUP_ROWS))
    dealt = rows.withColumn("group", F.pmod(F.xxhash64("doc_id", "cluster"), F.lit(groups)))

    def run(batch: pa.Table) -> pa.Table:
        frame = batch.to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get)
        found = pack_group(frame, capacity)
        found["bin_fill"] = found.groupby("bin_id")["n_tokens"].transform("sum") / capacity
        return pa.Table.from_pandas(found, pa.schema([("doc_id", pa.int64()), ("piece", pa.int64()), ("first_token", pa.int64()), ("n_tokens", pa.int64()),
                                                      ("bin_id", pa.int64()), ("bin_fill", pa.float64())]), preserve_index=False)

    return dealt.groupBy("group").applyInArrow(run, "doc_id long, piece long, first_token long, n_tokens long, bin_id long, bin_fill double")
