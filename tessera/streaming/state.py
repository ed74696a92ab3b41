"""Streams with a state a key: circuit breakers for targets, and whole lines out of pieces of logs. Drain them with rocksdb=True."""

import sys
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of the package


def breaker(df: DataFrame, target: str, order: str, call: Callable[[tuple], tuple[bool, bool, str | None]], patience: int = 3, retry_after_ms: int | None = None) -> DataFrame:
    """Requests with called, ok and answer: a circuit breaker for each target.

    call takes a request (a named tuple of its columns) and returns whether it went well, whether the connection failed, and an answer.
    `patience` failed connections in a row open a target's circuit: later requests are answered without a call (called is false), in this
    micro-batch and in later ones. Any other outcome resets the count. After retry_after_ms a timer closes the circuit, and the next request
    is a call again; without it the circuit stays open. A stream with timers doesn't end with its input: run it with a trigger, or a limit.

    State is a counter and a flag a target. Within a micro-batch a target's requests are taken in their order.
    """
    names, target_type = df.columns, df.schema[target].dataType.simpleString()
    others = [c for c in names if c != target]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name != target)
    columns = [target, *others, "called", "ok", "answer"]

    class Breaker(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            self.state = handle.getValueState("circuit", "failures long, open boolean")

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            failures, open_ = self.state.get() if self.state.exists() else (0, False)
            out = []
            for request in pd.concat(list(rows)).sort_values(order, kind="stable")[names].itertuples(index=False, name="Request"):
                values = [v for c, v in zip(names, request, strict=True) if c != target]
                if open_:
                    out.append((key[0], *values, False, False, "circuit open"))
                    continue
                ok, lost, answer = call(request)
                failures = failures + 1 if lost else 0
                out.append((key[0], *values, True, ok, answer))
                if failures >= patience:
                    open_ = True
                    if retry_after_ms is not None:
                        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + retry_after_ms)
            self.state.update((failures, open_))
            yield pd.DataFrame(out, columns=columns)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            self.state.clear()
            yield pd.DataFrame(columns=columns)

        def close(self) -> None:
            pass

    schema = f"`{target}` {target_type}, {fields}, called boolean, ok boolean, answer string"
    return df.groupBy(target).transformWithStateInPandas(Breaker(), schema, "Append", "None" if retry_after_ms is None else "ProcessingTime")


def carried(before: str, chunk: str) -> tuple[list[str], str]:
    """Whole lines of a log chunk after what was carried over to it, each with only what follows its last carriage return, and the partial
    line to carry over to the next chunk. A carriage return right before a line's end belongs to that."""
    *lines, rest = (before + chunk).replace("\r\n", "\n").split("\n")
    return [line.rsplit("\r", 1)[-1] for line in lines], rest


def _needed(rest: str) -> str:
    """Of a partial line what can still be shown: from its last carriage return on, but for one at the very end, which may belong to a line's end."""
    return rest[rest.rfind("\r", 0, max(0, len(rest) - 1)) + 1 :]


def log_lines(df: DataFrame, file: str = "file", offset: str = "offset", text: str = "text", last: str = "last") -> DataFrame:
    """Whole lines (file, line_number from 0, line) out of pieces of logs, each with its offset in characters and whether it is the file's last.

    Pieces may be cut anywhere and may come in any order and more than once. A line is given when its end has come, as a terminal
    shows it; see carried(). The last piece's rest without a line end is a line if it isn't empty.

    State a file is the next offset, the line number, what there is of the unfinished line (after its last carriage return), and pieces that
    came too early. A file that has ended keeps its numbers alone, so that pieces that are sent again give nothing.
    """
    kind = df.schema[file].dataType.simpleString()

    class Lines(StatefulProcessor):
        def init(self, handle) -> None:
            self.at = handle.getValueState("at", "next long, line long, rest string, ended boolean")
            self.early = handle.getMapState("early", "offset long", "text string, last boolean")

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            upto, number, rest, ended = self.at.get() if self.at.exists() else (0, 0, "", False)
            pieces: dict[int, tuple] = {}
            for pdf in rows:
                for o, t, end in pdf[[offset, text, last]].itertuples(index=False):
                    o, t = int(o), t or ""
                    if o >= upto and not ended and (o not in pieces or len(t) > len(pieces[o][0])):
                        pieces[o] = (t, bool(end))
            out: list[tuple] = []
            while not ended:
                if upto in pieces:
                    piece, end = pieces.pop(upto)
                elif self.early.containsKey((upto,)):
                    piece, end = self.early.getValue((upto,))
                    self.early.removeKey((upto,))
                else:
                    break
                upto += len(piece)
                whole, rest = carried(rest, piece)
                out += [(key[0], number + k, line) for k, line in enumerate(whole)]
                number += len(whole)
                if end:
                    ended, rest = True, rest.rsplit("\r", 1)[-1]
                    if rest:
                        out.append((key[0], number, rest))
                        number, rest = number + 1, ""
                elif not piece:
                    break
            if not ended:
                for o, value in pieces.items():
                    self.early.updateValue((o,), value)
            self.at.update((upto, number, _needed(rest), ended))
            yield pd.DataFrame(out, columns=[file, "line_number", "line"])

        def close(self) -> None:
            pass

    return df.select(file, offset, text, last).groupBy(file).transformWithStateInPandas(Lines(), f"`{file}` {kind}, line_number long, line string", "Append", "None")
