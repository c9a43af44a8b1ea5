"""Sessions in which a model asks for slices of code, answer by answer (Z4): stateful over a stream, by the same rule over whole tables."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.text import marker_addresses
from .session import eviction, ledger

#: What happens in a session: a slice is fetched, one fetched before is asked for again, one leaves the window, the session ends.
EVENTS = "session string, round int, event string, address string, ok boolean, tokens long, file_tokens long, reason string"
_SLICE = "round int, tokens long, file_tokens long, hits long"
_SEEN = "seq long, rounds int, ended boolean"


@dataclass
class Slice:
    """A slice that was asked for; a failed one has no tokens and isn't asked for again."""

    round: int
    tokens: int
    file_tokens: int | None
    hits: int = 0
    evicted: bool = False


def markers_of(answers: DataFrame, slices: DataFrame) -> DataFrame:
    """(session, seq, pos, address, kind, tokens, file_tokens, reason): a row for each marker of each answer, one without address if it has none.

    ``answers``: (session, seq, text); null texts have no marker. ``slices``: (address, kind, tokens, file_tokens, reason), each address once;
    what it lacks is ``invalid`` for the reason ``not-found``. The join is left to Spark, and works on a stream as it does on a table.
    """
    asked = answers.select(F.col("session").cast("string").alias("session"), F.col("seq").cast("long").alias("seq"), F.posexplode_outer(marker_addresses(F.coalesce("text", F.lit("")))).alias("pos", "address"))
    known = slices.select("address", "kind", F.col("tokens").cast("long").alias("tokens"), F.col("file_tokens").cast("long").alias("file_tokens"), "reason")
    lacking = F.col("kind").isNull()
    return asked.join(known, "address", "left").select("session", "seq", "pos", "address", F.coalesce("kind", F.lit("invalid")).alias("kind"), "tokens", "file_tokens", F.when(lacking, "not-found").otherwise(F.col("reason")).alias("reason"))


def _over(asked: dict[str, Slice], cap: int) -> list[str]:
    """Z5 for the few slices of one session: the least asked for and oldest go first, never the newest."""
    left = sum(s.tokens for s in asked.values())
    if cap <= 0:
        return []
    gone = []
    for a in sorted(list(asked)[:-1], key=lambda a: asked[a].hits * 1000 + asked[a].round):
        if left <= cap:
            break
        gone.append(a)
        left -= asked[a].tokens
    return gone


def answer(asked: dict[str, Slice], n: int, wanted: list[tuple], max_rounds: int, cap: int) -> tuple[list[tuple], bool]:
    """The events of answer ``n`` (from 0), and whether the session goes on; ``asked`` is brought up to date.

    Every marker of a slice that was asked for before counts as a hit. The first other one is fetched, unless ``max_rounds`` answers
    went before; without one the session ends. A slice that leaves the window is told once.
    """
    events: list[tuple] = []
    for address, *_ in wanted:
        if address in asked:
            asked[address].hits += 1
            events.append((n, "hit", address, None, None, None, None))
    new = next((w for w in wanted if w[0] not in asked), None)
    if new is None or n >= max_rounds:
        return [*events, (n, "end", None, None, None, None, None)], False
    address, kind, tokens, file_tokens, reason = new
    ok = kind not in ("invalid", "ambiguous")
    asked[address] = Slice(n, int(tokens or 0) if ok else 0, int(file_tokens) if kind == "ok" and file_tokens is not None else None)
    why = None if ok else reason if kind == "invalid" else "ambiguous"
    events.append((n, "slice", address, ok, asked[address].tokens, asked[address].file_tokens, why))
    for a in _over(asked, cap):
        if not asked[a].evicted:
            asked[a].evicted = True
            events.append((n, "evict", a, None, None, None, None))
    return events, True


def _answers(rows: pd.DataFrame) -> Iterator[tuple[int, list[tuple]]]:
    plain = rows.astype(object).where(rows.notna(), None)
    for seq, g in plain.sort_values(["seq", "pos", "address"]).groupby("seq", sort=True):
        g = g[g["address"].notna()].drop_duplicates("pos")
        yield int(seq), list(g[["address", "kind", "tokens", "file_tokens", "reason"]].itertuples(index=False, name=None))


def _frame(session: str, events: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame([(session, *e) for e in events], columns=["session", "round", "event", "address", "ok", "tokens", "file_tokens", "reason"])
    return out.astype({"round": "int32", "ok": "object", "tokens": "Int64", "file_tokens": "Int64"})


class Expander(StatefulProcessor):
    """The sessions of a stream: a map of slices by address, and a value with the last answer seen.

    The map has no more than ``max_rounds`` entries, so state is bounded for each session. An answer that is not after the last
    one seen is a repetition and changes nothing; so a replayed batch is harmless.
    """

    def __init__(self, max_rounds: int, cap: int):
        self.max_rounds, self.cap = max_rounds, cap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.slices = handle.getMapState("slices", "address string", f"{_SLICE}, evicted boolean")
        self.seen = handle.getValueState("seen", _SEEN)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        seq, n, ended = tuple(self.seen.get()) if self.seen.exists() else (None, 0, False)
        asked = {k[0]: Slice(*v) for k, v in sorted(self.slices.iterator(), key=lambda kv: kv[1][0])}
        events: list[tuple] = []
        for at, wanted in _answers(pd.concat(list(rows))):
            if ended or (seq is not None and at <= seq):
                continue
            more, goes_on = answer(asked, n, wanted, self.max_rounds, self.cap)
            events += more
            seq, n, ended = at, n + 1, not goes_on
        if events:
            self.seen.update((seq, n, ended))
            for a, s in asked.items():
                self.slices.updateValue((a,), (s.round, s.tokens, s.file_tokens, s.hits, s.evicted))
            yield _frame(key[0], events)

    def close(self) -> None:
        pass


def expand_stream(answers: DataFrame, slices: DataFrame, max_rounds: int = 3, cap: int = 0) -> DataFrame:
    """Z4 over a stream of answers (session, seq, text): the events as they happen.

    Needs the RocksDB state store. Answers of a session that come in one micro-batch are taken in the order of ``seq``.
    """
    rows = markers_of(answers, slices)
    return rows.groupBy("session").transformWithStateInPandas(Expander(max_rounds, cap), outputStructType=EVENTS, outputMode="Append", timeMode="None")


def expand(answers: DataFrame, slices: DataFrame, max_rounds: int = 3, cap: int = 0) -> DataFrame:
    """Z4 over a table of answers: the same events. Markers of one place in repeated (session, seq) rows count once, the
    least address first; rows without ``seq`` are left out; a null session is one session.

    Only the first ``max_rounds`` + 1 answers of a session can matter, so no more reach a worker; they are found by merging small
    arrays, not by a window, so a long session is spread over tasks.
    """
    first = F.slice(F.array_sort(F.collect_set("seq")), 1, max_rounds + 1)
    rows = markers_of(answers, slices)
    parts = rows.select("session", "seq").groupBy("session", F.pmod(F.xxhash64("seq"), F.lit(64)).alias("part")).agg(first.alias("seqs"))
    kept = parts.groupBy("session").agg(F.slice(F.array_sort(F.flatten(F.collect_list("seqs"))), 1, max_rounds + 1).alias("seqs")).select("session", F.explode("seqs").alias("seq"))
    rows = rows.join(kept.withColumnRenamed("session", "s").withColumnRenamed("seq", "q"), F.col("session").eqNullSafe(F.col("s")) & (F.col("seq") == F.col("q"))).drop("s", "q")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        asked: dict[str, Slice] = {}
        events: list[tuple] = []
        for n, (_, wanted) in enumerate(_answers(pdf)):
            more, goes_on = answer(asked, n, wanted, max_rounds, cap)
            events += more
            if not goes_on:
                break
        return _frame(pdf["session"].iloc[0], events)

    return rows.groupBy("session").applyInPandas(run, EVENTS)


def slices_of(events: DataFrame) -> DataFrame:
    """(session, address, ord, round, ok, tokens, file_tokens, reason, hits): every slice of every session, with the hits after it."""
    fetched = events.filter("event = 'slice'").select("session", "address", F.col("round").alias("ord"), "round", "ok", "tokens", "file_tokens", "reason")
    hits = events.filter("event = 'hit'").groupBy("session", "address").agg(F.count(F.lit(1)).alias("hits"))
    return fetched.join(hits, ["session", "address"], "left").fillna(0, ["hits"])


def ledgers(events: DataFrame, pack_tokens: int = 0, cap: int = 0) -> DataFrame:
    """Z6 after the last answer of every session that fetched something."""
    return ledger(eviction(slices_of(events), cap), pack_tokens)
