"""Streams of model output: marker lines taken out, and partial lines of event streams joined."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.fixed import MARKER_LINE

MARKER = re.compile(MARKER_LINE)


class MarkerFilter:
    """Passes whole lines on but for markers, however they are cut into chunks; a line is held back until it ends."""

    def __init__(self, held: str = ""):
        self.held, self.addresses = held, []

    def feed(self, chunk: str) -> str:
        *lines, self.held = (self.held + chunk).split("\n")
        return "".join(x + "\n" for x in lines if self._passes(x))

    def finish(self) -> str:
        last, self.held = self.held, ""
        return last if self._passes(last) else ""

    def _passes(self, line: str) -> bool:
        if found := MARKER.match(line):
            self.addresses.append(found[1])
        return found is None


class DeltaParser:
    """Z3: the text deltas of a stream of JSON lines or server-sent events; bad lines are skipped, ``[DONE]`` ends it."""

    def __init__(self, held: str = "", done: bool = False):
        self.held, self.done = held, done

    def feed(self, chunk: str) -> str:
        *lines, self.held = (self.held + chunk).split("\n")
        return "".join(self._delta(x) for x in lines)

    def finish(self) -> str:
        last, self.held = self.held, ""
        return self._delta(last)

    def _delta(self, line: str) -> str:
        body = line.strip().removeprefix("data:").strip()
        if self.done or not body:
            return ""
        if body == "[DONE]":
            self.done = True
            return ""
        try:
            j = json.loads(body)
        except ValueError:
            return ""
        if not isinstance(j, dict):
            return ""
        choices = j.get("choices") or [{}]
        for found in (choices[0].get("delta", {}).get("content"), j.get("message", {}).get("content"), j.get("response")):
            if isinstance(found, str):
                return found
        return ""


def filter_markers(chunks: DataFrame) -> DataFrame:
    """Z2 over a stream of (session, seq, chunk): (session, text, addresses) per micro-batch; the state is the held-back text.

    Chunks of a session that arrive in one micro-batch are taken in order of ``seq``.
    """

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        f = MarkerFilter(*state.get) if state.exists else MarkerFilter()
        rows = pd.concat(list(frames)).sort_values("seq")
        text = "".join(f.feed(c or "") for c in rows["chunk"])
        state.update((f.held,))
        yield pd.DataFrame({"session": [key[0]], "text": [text], "addresses": [f.addresses]})

    return chunks.groupBy("session").applyInPandasWithState(update, "session string, text string, addresses array<string>", "held string", "append", GroupStateTimeout.NoTimeout)


def filter_transcripts(chunks: DataFrame) -> DataFrame:
    """Z2 in batch: (session, text, addresses) of whole sessions."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        f = MarkerFilter()
        text = "".join(f.feed(c or "") for c in pdf.sort_values("seq")["chunk"]) + f.finish()
        return pd.DataFrame({"session": [pdf["session"].iloc[0]], "text": [text], "addresses": [f.addresses]})

    return chunks.groupBy("session").applyInPandas(run, "session string, text string, addresses array<string>")


def parse_deltas(chunks: DataFrame) -> DataFrame:
    """Z3 in batch: (session, text) of whole event streams."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        p = DeltaParser()
        return pd.DataFrame({"session": [pdf["session"].iloc[0]], "text": ["".join(p.feed(c or "") for c in pdf.sort_values("seq")["chunk"]) + p.finish()]})

    return chunks.groupBy("session").applyInPandas(run, "session string, text string")
