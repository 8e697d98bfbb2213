"""A stateful processor that sees the rows of a key in the order of their time, each once and when it is final.

Rows wait in the state store until the watermark has passed them; later rows than that were dropped before.  So what a processor
makes of a key does not depend on how rows were dealt to micro-batches or in which order they came.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def _packed(rows: pd.DataFrame) -> bytes:
    table = pa.Table.from_pandas(rows, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(raw: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(raw).read_pandas()


class Ordered(StatefulProcessor):
    """Subclasses give `advance`; `order` names the columns that sort rows.

    Rows need `at`, the microseconds of the time that has the watermark, so that no time zone of a session gets in between.
    """

    order: tuple[str, ...] = ("at",)

    def advance(self, key: tuple, memory: dict, rows: pd.DataFrame | None, upto: int) -> tuple[pd.DataFrame, int | None]:
        """Take in `rows`, which are final and sorted, and all time up to the watermark `upto`, in microseconds.

        Returns what to emit and when to be woken even if no row comes; `memory` is kept as JSON.
        """
        raise NotImplementedError

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.memory = handle.getValueState("memory", "doc string")
        self.waiting = handle.getListState("waiting", "rows binary")  # one value per micro-batch

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows), ignore_index=True)
        new = new[new["at"].notna()].astype({"at": "int64"})
        if len(new):
            self.waiting.appendValue((_packed(new),))
            self._wake(int(new["at"].min()))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        upto = 1000 * timerValues.getCurrentWatermarkInMs()
        held = [_unpacked(r) for (r,) in self.waiting.get()] if self.waiting.exists() else []
        rows = pd.concat(held, ignore_index=True) if held else None
        final = rows[rows["at"] <= upto] if rows is not None else None
        memory = json.loads(self.memory.get()[0]) if self.memory.exists() else {}
        if rows is not None:
            late = rows[rows["at"] > upto]
            self.waiting.clear()
            if len(late):
                self.waiting.appendValue((_packed(late),))
                self._wake(int(late["at"].min()))
            final = final.sort_values(list(self.order), kind="stable").reset_index(drop=True)
        out, again = self.advance(key, memory, final, upto)
        self.memory.update((json.dumps(memory),))
        if again is not None:
            self._wake(again)
        yield out

    def _wake(self, at: int) -> None:
        self.handle.registerTimer(-(-at // 1000))

    def close(self) -> None:
        pass
