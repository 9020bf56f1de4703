"""Average cost as keyed stream state: four numbers per (tenant, instrument).

Reads a ledger whose events are already unique. Within a micro-batch a key's
trades are applied in id order; a trade at or below the key's watermark has been
applied before and is skipped, so redelivery changes nothing. Cap the batch with
``bounded_poll`` to bound what one key brings at once.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ledgerloom.functions import wacfold
from ledgerloom.functions.amounts import signed_quantity

cloudpickle.register_pickle_by_value(sys.modules[__name__])
cloudpickle.register_pickle_by_value(wacfold)

STATE = "position long, average_cost long, realized_pnl long, last_transaction_id long"
OUTPUT = f"tenant_id string, instrument string, {STATE}, applied long, skipped long, rejected long"


class AverageCost(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues):
        stored = self.state.get() if self.state.exists() else (0, 0, 0, -1)
        position, cost, pnl, last = (int(v) for v in stored)
        batch = pd.concat(list(rows)).sort_values("id", kind="stable")
        applied = skipped = rejected = 0
        for trade, quantity, price in zip(
            batch["id"].tolist(), batch["quantity"].tolist(), batch["price"].tolist()
        ):
            if trade <= last:
                skipped += 1
                continue
            quantity = None if pd.isna(quantity) else int(quantity)
            after, cost, realized, problem = wacfold.apply_trade(
                position, cost, pnl, quantity, int(price)
            )
            if problem is not None:
                rejected += 1
                continue
            position, pnl, last = after, pnl + realized, trade
            applied += 1
        if applied:
            self.state.update((position, cost, pnl, last))
        yield pd.DataFrame(
            {
                "tenant_id": [key[0]], "instrument": [key[1]], "position": [position],
                "average_cost": [cost], "realized_pnl": [pnl], "last_transaction_id": [last],
                "applied": [applied], "skipped": [skipped], "rejected": [rejected],
            }
        )

    def close(self) -> None:
        pass


def wac_stream(ledger: DataFrame) -> DataFrame:
    """One row per key and micro-batch: the key's state after it. Needs the RocksDB state store."""
    rows = ledger.select(
        "tenant_id", "instrument", "id",
        signed_quantity(F.col("side"), F.col("quantity")).alias("quantity"), "price",
    )
    return rows.groupBy("tenant_id", "instrument").transformWithStateInPandas(
        statefulProcessor=AverageCost(),
        outputStructType=OUTPUT,
        outputMode="Update",
        timeMode="None",
    )
