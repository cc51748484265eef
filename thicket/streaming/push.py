"""Documents in chunks, in the state of a stream: put together, or parsed as they arrive.

State is a map of the chunks that wait for an earlier one and one value, so a chunk costs its
own size however many came before.  It needs the RocksDB state store, which is set for the
session where nothing else is.
"""

from __future__ import annotations

from collections.abc import Iterator
from xml.parsers import expat
from xml.sax.saxutils import quoteattr

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Chunks(StatefulProcessor):
    """Takes a key's chunks in turn; what subclasses make of them goes on in ``seen``, ``ended`` and ``late``."""

    def __init__(self, time_col: str, seconds: int):
        self.time_col, self.seconds = time_col, seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "seq long", "chunk string")
        self.progress = handle.getValueState("progress", "next long, last long, newest long, timer long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        following, last, newest, timer = self.progress.get() if self.progress.exists() else (0, -1, 0, 0)
        for f in rows:
            for seq, chunk, end, ts in zip(f["seq"], f["chunk"], f["last"], f[self.time_col], strict=True):
                newest = max(newest, int(ts.timestamp() * 1000))
                last = max(last, int(seq)) if end else last
                if seq >= following:
                    self.waiting.updateValue((int(seq),), (chunk,))
        ready = []
        while self.waiting.containsKey((following,)):
            ready.append(self.waiting.getValue((following,))[0] or "")
            self.waiting.removeKey((following,))
            following += 1
        whole = 0 <= last < following
        out = self.seen(key[0], following - len(ready), ready, whole)
        if timer:
            self.handle.deleteTimer(timer)
        if whole:
            self.forget()
        else:
            timer = max(newest + self.seconds * 1000, timerValues.getCurrentWatermarkInMs() + 1)
            self.handle.registerTimer(timer)
            self.progress.update((following, last, newest, timer))
        if out is not None:
            yield out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = self.late(key[0])
        self.forget()
        if out is not None:
            yield out

    def forget(self) -> None:
        self.waiting.clear()
        self.progress.clear()

    def close(self) -> None:
        pass


class _Assembler(_Chunks):
    def init(self, handle):
        super().init(handle)
        self.text = handle.getMapState("text", "seq long", "chunk string")

    def seen(self, key, first: int, ready: list[str], whole: bool):
        for k, chunk in enumerate(ready):
            self.text.updateValue((first + k,), (chunk,))
        return self._all(key, True) if whole else None

    def late(self, key):
        return self._all(key, False)

    def _all(self, key, complete: bool):
        parts = {k[0]: v[0] for state in (self.text, self.waiting) for k, v in state.iterator()}
        return pd.DataFrame({"doc_id": [key], "text": ["".join(parts[k] for k in sorted(parts))], "complete": [complete]})

    def forget(self):
        super().forget()
        self.text.clear()


class _Parser(_Chunks):
    """Gives out events as soon as they are sure.

    State holds the start tags of what is open and the text from the last event on, which is
    read again with what follows; so neither the parser nor what it has read is kept.
    """

    def init(self, handle):
        super().init(handle)
        self.state = handle.getValueState("parser", "doctype string, opened array<string>, tail string, number long, failed boolean")

    def seen(self, key, first: int, ready: list[str], whole: bool):
        doctype, opened, tail, number, failed = self.state.get() if self.state.exists() else ("", [], "", 0, False)
        if failed or not (ready or whole):
            return None
        events, state = feed(doctype, list(opened), tail + "".join(ready), whole)
        for e in events:
            e["number"], number = number, number + 1
        self.state.update((*state[:3], number, state[3]))
        return self._rows(key, events)

    def late(self, key):
        number = self.state.get()[3] if self.state.exists() else 0
        return self._rows(key, [{"event": "error", "depth": 0, "name": None, "value": "the document didn't end in time", "number": number}])

    @staticmethod
    def _rows(key, events: list[dict]):
        if not events:
            return None
        columns = ("number", "event", "depth", "name", "value")
        return pd.DataFrame({"doc_id": [key] * len(events), **{c: [e[c] for e in events] for c in columns}})

    def forget(self):
        super().forget()
        self.state.clear()


#: Stands among the start tags while a section is open.
_CDATA = "<![CDATA["


def feed(doctype: str, opened: list[str], text: str, last: bool) -> tuple[list[dict], tuple[str, list[str], str, bool]]:
    """The sure events of a document's next part, and the state for what comes then.

    ``opened`` are the start tags of the open elements; ``text`` begins where an event
    begins.  Unless it is the last part, what begins with the last event is held back.
    """
    p = expat.ParserCreate()
    p.ordered_attributes = True
    lead = (doctype + "".join(opened)).encode()
    body = text.encode("utf-8", "surrogatepass")
    found: list[tuple[int, dict, str | None]] = []  # where in the text an event begins, it, and a start tag
    subset: list[int] = []
    depth = [len(opened) - opened.count(_CDATA)]

    def event(kind, name=None, value=None, tag=None):
        at = p.CurrentByteIndex - len(lead)
        if at >= 0 and (not subset or len(subset) == 2):
            found.append((at, {"event": kind, "depth": depth[0], "name": name, "value": value}, tag))

    def start(name, attrs):
        if p.CurrentByteIndex < len(lead):
            return
        tag = f"<{name}{''.join(f' {k}={quoteattr(v)}' for k, v in zip(attrs[::2], attrs[1::2], strict=True))}>"
        event("start_element", name, tag, tag)
        depth[0] += 1

    def end(name):
        depth[0] -= 1
        event("end_element", name, None, "")
        at = found[-1][0]
        if body[at : at + 2] != b"</":  # an empty element ends where its tag does: one with its start
            found[-1] = (found[-2][0], *found[-1][1:])

    def doctype_end():
        subset.append(p.CurrentByteIndex)

    p.StartElementHandler, p.EndElementHandler = start, end
    p.CharacterDataHandler = lambda data: event("characters", None, data)
    p.CommentHandler = lambda data: event("comment", None, data)
    p.ProcessingInstructionHandler = lambda name, data: event("processing_instruction", name, data)
    p.StartCdataSectionHandler, p.EndCdataSectionHandler = lambda: event("start_cdata", tag=_CDATA), lambda: event("end_cdata", tag="")
    p.StartDoctypeDeclHandler, p.EndDoctypeDeclHandler = lambda *a: subset.append(p.CurrentByteIndex), doctype_end
    error = None
    try:
        p.Parse(lead + body, last)
    except expat.ExpatError as e:
        error = str(e)
    if not doctype and len(subset) == 1 and error is None:
        return [], (doctype, opened, text, False)  # the doctype hasn't ended: all of it is read again
    keep = len(found)
    cut = len(body)
    if not last and error is None:
        if not found:
            return [], (doctype, opened, text, False)
        cut = found[-1][0]
        keep = next(k for k, (at, _, _) in enumerate(found) if at >= cut)
    out = []
    for _, e, tag in found[:keep]:
        if tag:
            opened.append(tag)
        elif tag == "":
            opened.pop()
        out.append(e)
    if error is not None:
        out.append({"event": "error", "depth": len(opened) - opened.count(_CDATA), "name": None, "value": error})
    if not doctype and len(subset) == 2 and subset[1] < cut:
        doctype = body[: subset[1] + 1].decode()  # what comes before it is no element
        doctype = doctype[doctype.index("<!DOCTYPE") :]
    return out, (doctype, opened, body[cut:].decode(), error is not None)


def _with_state(chunks: DataFrame, time_col: str, timeout: str, processor, schema: str) -> DataFrame:
    spark = chunks.sparkSession
    if spark.conf.get(_PROVIDER, None) != _ROCKS:
        spark.conf.set(_PROVIDER, _ROCKS)
    seconds = int(pd.Timedelta(timeout).total_seconds())
    rows = chunks.select("doc_id", "seq", "chunk", "last", time_col)
    return rows.withWatermark(time_col, timeout).groupBy("doc_id").transformWithStateInPandas(processor(time_col, seconds), schema, "append", "eventTime")


def assemble_stream(chunks: DataFrame, timeout: str = "10 minutes", time_col: str = "ts") -> DataFrame:
    """(doc_id, text, complete) of documents that arrive as (doc_id, seq, chunk, last, ts), in any order.

    A document is given out when all chunks up to the last have come; one whose last chunk is
    more than ``timeout`` behind the watermark is given out as it is, complete = false, and
    its state goes, so state is bounded by what is under way.  A chunk that comes again counts once.
    """
    return _with_state(chunks, time_col, timeout, _Assembler, "doc_id long, text string, complete boolean")


def push_events(chunks: DataFrame, timeout: str = "10 minutes", time_col: str = "ts") -> DataFrame:
    """(doc_id, number, event, depth, name, value) of documents in chunks, parsed as these arrive.

    event is start_element (value: the tag), end_element, characters (a text may come in
    pieces), start_cdata, end_cdata, comment, processing_instruction or error, which is a
    document's last; number counts a document's events from 0.  An event is given out when
    what follows can't change it, so all but the last one of what has come; chunks that come
    too early wait.  A document that doesn't end in time has an error.
    """
    return _with_state(chunks, time_col, timeout, _Parser, "doc_id long, number long, event string, depth int, name string, value string")
