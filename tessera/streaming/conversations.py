"""Conversations as keyed state: the latest turns that fit the budget, kept message by message.

Per conversation the state holds the turns of the suffix that still fits, so it is bounded by the budget, however long the conversation is.  A suffix's cost
grows with every turn, so a turn that has fallen out never comes back.  A conversation that is idle for long is let go by a timer.

The messages of a conversation are expected in the order of their turns; one that is not later than the last seen is a
repeated one and is passed over, so a batch may be run again.  Those of one batch are put in order.  State stores need a provider with column families (RocksDB).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..config import ASSISTANT_LABEL, USER_LABEL, Budget
from ..functions.text import is_blank, strip

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: What is told of a conversation after each batch that brought it messages, and when it ends.
SUFFIX = "conv_id long, last_turn long, turns array<long>, history string, history_tokens int, ended boolean"
_TURNS = "turn long, said string, chars long"
_LAST = "turn long, role string"


def cost(chars: int, chars_per_token: float) -> int:
    """Tokens of a rendering of so many characters, each line counted with a line break."""
    return max(1, int((chars - 1) / chars_per_token)) if chars > 1 else 0


class Suffix(StatefulProcessor):
    """``turns``: a list of (turn, what was said, characters); ``last``: the last message's turn and role."""

    def __init__(self, budget: Budget, idle_ms: int | None):
        self.budget, self.idle_ms = budget, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.turns, self.last = handle.getListState("turns", _TURNS), handle.getValueState("last", _LAST)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        turns = [list(t) for t in self.turns.get()] if self.turns.exists() else []
        last, role = self.last.get() if self.last.exists() else (-math.inf, None)
        messages = sorted((t, r, s) for part in rows for t, r, s in zip(part["turn"], part["role"], part["said"].where(part["said"].notna(), "")))
        for turn, who, said in messages:
            if turn <= last:
                continue
            if who == "user":
                turns.append([int(turn), said, 0])
            elif who == "assistant" and role == "user" and turns and turns[-1][0] == last:
                turns[-1][1] = "\n".join(x for x in (turns[-1][1], said) if x)
            last, role = int(turn), who
            if turns:
                turns[-1][2] = len(turns[-1][1]) + 1 if turns[-1][1] else 0
            while turns and cost(sum(t[2] for t in turns), self.budget.chars_per_token) > self.budget.history:
                turns.pop(0)
        if last == -math.inf:
            return
        self.turns.put([tuple(t) for t in turns]) if turns else self.turns.clear()
        self.last.update((last, role))
        if self.idle_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield self._told(key, last, turns, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.last.exists():
            last = self.last.get()[0]
            self.turns.clear()
            self.last.clear()
            yield self._told(key, last, [], True)

    def _told(self, key, last: int, turns: list[list], ended: bool) -> pd.DataFrame:
        said = [t[1] for t in turns if t[1]]
        row = {"conv_id": key[0], "last_turn": last, "turns": [t[0] for t in turns], "history": "\n".join(said), "history_tokens": cost(sum(t[2] for t in turns), self.budget.chars_per_token), "ended": ended}
        return pd.DataFrame({name: [value] for name, value in row.items()})

    def close(self) -> None:
        pass


def histories(messages: DataFrame, budget: Budget | None = None, idle_ms: int | None = None) -> DataFrame:
    """A stream of messages (``conv_id, turn, role, text``) -> a stream of SUFFIX rows, the last of a conversation being what holds."""
    label = F.when(F.col("role") == "user", USER_LABEL).otherwise(ASSISTANT_LABEL)
    said = messages.filter("conv_id is not null and turn is not null and role <> 'system'").select("conv_id", "turn", "role", F.when(~is_blank(F.col("text")), F.concat(label, strip(F.col("text")))).alias("said"))
    return said.groupBy("conv_id").transformWithStateInPandas(Suffix(budget or Budget(), idle_ms), SUFFIX, "update", "none" if idle_ms is None else "processingTime")
