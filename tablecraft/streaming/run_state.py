"""State of runs while their log lines arrive."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUTPUT = "line string, logger_name string, ts timestamp, _level string"
LEVELS = {"warning": "WARNING", "error": "ERROR", "fatal": "ERROR", "info": "INFO"}


class RunState(StatefulProcessor):
    """Keeps of each run whether it has failed and whether it has ended.

    A run that has been silent for ``keep_ms`` is forgotten; until then lines after its end are known as such. Time goes by
    the arrival of lines, which is the watermark, so no line is ever late.
    """

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("run", "failed boolean, ended boolean, seen_ms long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802
        rows = sorted(rows, key=lambda r: (r.ts is not None, r.ts, -1 if r.line_number is None else r.line_number) if r.ts is not None else (False,))
        if not rows[0].in_run:
            yield from (Row(line=r.line, logger_name=r.logger_name, ts=r.ts, _level=LEVELS[r.kind]) for r in rows if r.kind in LEVELS)
            return
        known = self.state.exists()
        failed, ended, _ = self.state.get() if known else (False, False, 0)
        for r in rows:
            if ended:
                break
            if r.kind != "end":
                level = "ERROR" if failed and r.kind != "warning" else LEVELS.get(r.kind)
                if level:
                    yield Row(line=r.line, logger_name=r.logger_name, ts=r.ts, _level=level)
            failed = failed or r.kind in ("error", "fatal")
            ended = r.kind in ("end", "fatal")
        seen = max(int(r.arrived.timestamp() * 1000) for r in rows)
        self.state.update((failed, ended, seen))
        if not known:
            self.handle.registerTimer(seen + self.keep_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802
        seen = self.state.get()[2] if self.state.exists() else 0
        if seen + self.keep_ms > expiredTimerInfo.getExpiryTimeInMs():
            self.handle.registerTimer(seen + self.keep_ms)
        else:
            self.state.clear()
        yield from ()

    def close(self) -> None:
        pass
