"""Assets and their masters paired in the stream, whichever comes first.

Two stateful steps.  The first keeps the folded record of each name, as a tombstone says
neither what it ends nor which master it had.  The second keeps, for each master, its live
payload and the assets that name it; whatever changes there is derived again.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.ingest import ASSET, MASTER
from ..session import ship

ROUTED = "master string, role string, name string, json string, zone string, live boolean, seq long"
PAIRED = "name string, json string, zone string, master_id string, master_json string, live boolean, seq long"
_FIELDS = ("type", "master_ref", "json", "zone")


class Fold(StatefulProcessor):
    """Records of a name, folded; each change is sent to the master that it concerns."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        columns = ", ".join(f"{f} string, {f}_seq long" for f in _FIELDS)
        self.state = handle.getValueState("folded", f"{columns}, deleted boolean, seq long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        old = self.state.get() if self.state.exists() else None
        now = dict(zip([c for f in _FIELDS for c in (f, f"{f}_seq")] + ["deleted", "seq"], old or [None] * (2 * len(_FIELDS) + 2), strict=True))
        was = now["master_ref"] if now["type"] == ASSET else None
        for r in sorted(rows, key=lambda r: r.seq):
            for f in _FIELDS:
                if r[f] is not None and (now[f"{f}_seq"] is None or r.seq >= now[f"{f}_seq"]):
                    now[f], now[f"{f}_seq"] = r[f], r.seq
            if now["seq"] is None or r.seq >= now["seq"]:
                now["deleted"], now["seq"] = r.deleted, r.seq
        self.state.update(tuple(now.values()))
        if now["type"] == MASTER:
            yield Row(master=key[0], role="master", name=key[0], json=now["json"], zone=now["zone"], live=not now["deleted"], seq=now["seq"])
        elif now["type"] == ASSET:
            to = now["master_ref"]
            if was is not None and was != to:
                yield Row(master=was, role="moved", name=key[0], json=None, zone=now["zone"], live=False, seq=now["seq"])
            if to is not None:
                yield Row(master=to, role="asset", name=key[0], json=now["json"], zone=now["zone"], live=not now["deleted"], seq=now["seq"])

    def close(self) -> None:
        pass


class Pair(StatefulProcessor):
    """A master and the live assets that name it, waiting for it or not."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.master = handle.getValueState("master", "json string, live boolean, seq long")
        self.assets = handle.getMapState("assets", "name string", "json string, zone string, seq long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        had = self.master.get() if self.master.exists() else (None, False, -1)
        master, changed, gone = had, {}, {}
        for r in sorted(rows, key=lambda r: r.seq):
            if r.role == "master":
                master = (r.json, r.live, r.seq)
            elif r.live:
                changed[r.name] = (r.json, r.zone, r.seq)
                gone.pop(r.name, None)
            else:
                changed.pop(r.name, None)
                gone[r.name] = (r.zone, r.seq)
        for name, x in changed.items():
            self.assets.updateValue((name,), x)
        for name in gone:
            if self.assets.containsKey((name,)):
                self.assets.removeKey((name,))
        if master != had:
            self.master.update(master)
            concerned = ((n[0], tuple(v)) for n, v in self.assets.iterator())
        else:
            concerned = changed.items()
        json, live, seq = master
        if live or had[1]:  # waiting assets give no rows
            for name, (own, zone, at) in concerned:
                yield Row(name=name, json=own, zone=zone, master_id=key[0], master_json=json if live else None, live=live, seq=max(at, seq))
        for name, (zone, at) in gone.items():
            yield Row(name=name, json=None, zone=zone, master_id=key[0], master_json=None, live=False, seq=at)

    def close(self) -> None:
        pass


def paired(stream: DataFrame) -> DataFrame:
    """Changes of live pairs, as a stream: name, json, zone, master_id, master_json, live, seq.

    Of each asset the row with the greatest (seq, live) counts (`latest`).  The checkpoint's
    state store must be RocksDB's (spark.sql.streaming.stateStore.providerClass).
    """
    ship(stream.sparkSession)
    kept = stream.where(F.col("name").isNotNull() & (F.col("type").isin(MASTER, ASSET) | F.col("type").isNull()))
    routed = kept.groupBy("name").transformWithState(Fold(), ROUTED, "Append", "None")
    return routed.groupBy("master").transformWithState(Pair(), PAIRED, "Append", "None")


def latest(changes: DataFrame) -> DataFrame:
    """Live pairs after all changes, as `ingest.pair` gives them."""
    rows = changes.groupBy("name").agg(F.max_by(F.struct("json", "zone", "master_id", "master_json", "live"), F.struct("seq", "live")).alias("x"))
    return rows.select("name", "x.*").where("live").drop("live")
