"""Session folds: an event log per session, folded in batch or as a stream by the same state machine.

Events are ``(session, seq, action, text)`` with actions seed, accept, replace, reject and save.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

TRIGGER, KEEP, LEAST, EXCERPT = 4000, 2000, 20, 200
TARGET, ROUNDS, SHORT, SEEN_CHARS = 2300, 8, 5, 10

Summarise = Callable[[str], str]


def no_summary(text: str) -> str:
    """The offline default: every compression falls back to an excerpt."""
    return ""


@dataclass
class Session:
    """Z1, Z2."""

    summary: str = ""
    tail: str = ""
    last: str = ""
    accepted: int = 0
    saved: int = 0
    compressed: int = 0

    def apply(self, action: str, text: str | None, summarise: Summarise = no_summary) -> None:
        text = text or ""
        if action == "seed":
            self.summary, self.tail, self.last = "", text, ""
        elif action == "accept":
            self.tail += ("\n" if self.tail else "") + text
            self.last = text
            self.accepted += 1
            self.compress(summarise)
        elif action == "replace" and self.last and self.tail.endswith(self.last):
            self.tail = self.tail[: len(self.tail) - len(self.last)] + text
            self.last = text
            self.compress(summarise)
        elif action == "save":
            self.saved += 1
        # reject: what was offered is dropped, nothing changes

    def compress(self, summarise: Summarise) -> None:
        if len(self.tail) <= TRIGGER:
            return
        old, self.tail = self.tail[:-KEEP], self.tail[-KEEP:]
        try:
            made = summarise(old)
        except Exception:  # noqa: BLE001 - a model that fails counts as one that says nothing
            made = ""
        if len(made) < LEAST:
            made = f"[前情节选] {old[:EXCERPT].strip()}"
        self.summary = f"{self.summary}\n{made}".strip() if self.summary else made
        self.compressed += 1


@dataclass
class Rounds:
    """Rounds of generated text; a round is cut at its first paragraph already seen, and paragraphs count as
    seen only once their round is accepted. Ends at the target length, the last round, or a round too short."""

    seen: set[str] = field(default_factory=set)
    kept: list[str] = field(default_factory=list)
    rounds: int = 0
    over: bool = False
    chars: int = 0

    def seed(self, context: str) -> None:
        self.seen.update(k for k, _ in _paragraphs(context))

    def add(self, text: str) -> str:
        """What is kept of a round."""
        if self.over:
            return ""
        self.rounds += 1
        out, keys = [], []
        for k, p in _paragraphs(text):
            if len(k) >= SEEN_CHARS and k in self.seen:
                break
            out.append(p)
            keys.append(k)
        kept = "\n\n".join(out)
        if len(text.strip()) < SHORT or self.rounds >= ROUNDS:
            self.over = True
        if kept and len(text.strip()) >= SHORT:
            self.kept.append(kept)
            self.chars += len(kept)
            self.seen.update(keys)
        if self.chars >= TARGET:
            self.over = True
        return kept if kept and len(text.strip()) >= SHORT else ""


def _paragraphs(text: str) -> list[tuple[str, str]]:
    import re

    parts = [p.strip() for p in re.split(r"\n[ \t\f\v]*\n(?:[ \t\f\v]*\n)*", text.replace("\r\n", "\n").replace("\r", "\n").strip())]
    return [("".join(p.split()), p) for p in parts if p]


FOLD = "session string, summary string, tail string, accepted long, saved long, compressed long"
_ROW = ["session", "summary", "tail", "accepted", "saved", "compressed"]


def fold_sessions(events: DataFrame, summarise: Summarise = no_summary) -> DataFrame:
    """The batch twin: one row a session. A session is one author's log, folded in order by one task."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        s = Session()
        for action, text in rows.sort_values("seq")[["action", "text"]].itertuples(index=False):
            s.apply(action, text, summarise)
        return pd.DataFrame([(key[0], s.summary, s.tail, s.accepted, s.saved, s.compressed)], columns=_ROW)

    return events.select(F.col("session").cast("string").alias("session"), "seq", "action", "text").groupBy("session").applyInPandas(run, FOLD)


class SessionProcessor(StatefulProcessor):
    """The streaming form: state is one small struct a session."""

    def __init__(self, summarise: Summarise = no_summary):
        self.summarise = summarise

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("session", "summary string, tail string, last string, accepted long, saved long, compressed long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        s = Session(*self.state.get()) if self.state.exists() else Session()
        for action, text in pd.concat(list(rows)).sort_values("seq")[["action", "text"]].itertuples(index=False):
            s.apply(action, text, self.summarise)
        self.state.update((s.summary, s.tail, s.last, s.accepted, s.saved, s.compressed))
        yield pd.DataFrame([(key[0], s.summary, s.tail, s.accepted, s.saved, s.compressed)], columns=_ROW)

    def close(self) -> None:
        pass


def stream_sessions(events: DataFrame, summarise: Summarise = no_summary) -> DataFrame:
    """Z1, Z2 over a stream: the state of every session that a batch touched. Needs the RocksDB state store."""
    rows = events.select(F.col("session").cast("string").alias("session"), "seq", "action", "text")
    return rows.groupBy("session").transformWithStateInPandas(SessionProcessor(summarise), FOLD, "Update", "None")


def fold_rounds(rounds: DataFrame, context: DataFrame | None = None) -> DataFrame:
    """Z3: ``session, text, rounds``; ``context(session, text)`` seeds what was seen, if given."""
    rows = rounds.select("session", "seq", "text", F.lit(False).alias("ctx"))
    if context is not None:
        rows = rows.union(context.select("session", F.lit(-1).cast(rounds.schema["seq"].dataType), "text", F.lit(True)))

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        r = Rounds()
        for text, ctx in rows.sort_values("seq")[["text", "ctx"]].itertuples(index=False):
            r.seed(text or "") if ctx else r.add(text or "")
        return pd.DataFrame([(key[0], "\n\n".join(r.kept), r.rounds)], columns=["session", "text", "rounds"])

    return rows.groupBy("session").applyInPandas(run, f"session {dict(rounds.dtypes)['session']}, text string, rounds long")


ROUNDS_OUT = "session string, seq long, kept string, rounds long, chars long, over boolean"


class RoundProcessor(StatefulProcessor):
    """Z3 as a stream: a paragraph is one key of a map, so a batch touches only the paragraphs that it holds, whatever the
    session has seen before. What was seen before the first round comes as the initial state. State doesn't expire."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "key string", "known boolean")
        self.done = handle.getValueState("done", "rounds long, chars long, over boolean")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        for text in initialState["text"]:
            self.learn(k for k, _ in _paragraphs(text or ""))

    def learn(self, keys) -> None:
        for k in keys:
            if len(k) >= SEEN_CHARS:  # shorter ones are never looked up
                self.seen.updateValue((k,), (True,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        rounds, chars, over = self.done.get() if self.done.exists() else (0, 0, False)
        out = []
        for seq, text in pd.concat(list(rows)).sort_values("seq")[["seq", "text"]].itertuples(index=False):
            r = Rounds(rounds=rounds, over=over, chars=chars)
            parts = [k for k, _ in _paragraphs(text or "")]
            r.seen = {k for k in parts if len(k) >= SEEN_CHARS and self.seen.containsKey((k,))}
            before = set(r.seen)
            kept = r.add(text or "")
            self.learn(r.seen - before)
            rounds, chars, over = r.rounds, r.chars, r.over
            out.append((key[0], seq, kept, rounds, chars, over))
        self.done.update((rounds, chars, over))
        yield pd.DataFrame(out, columns=["session", "seq", "kept", "rounds", "chars", "over"])

    def close(self) -> None:
        pass


def stream_rounds(rounds: DataFrame, context: DataFrame | None = None) -> DataFrame:
    """Z3, W5 over a stream of ``session, seq, text``: what is kept of every round as it comes, with the counts so far; the
    kept texts of a session, joined in order, are :func:`fold_rounds`'s text. ``context(session, text)``, a batch table,
    seeds what was seen before the first round. Rounds of a session must come in order from batch to batch; a null text is
    an empty round. Needs the RocksDB state store."""
    rows = rounds.select(F.col("session").cast("string").alias("session"), F.col("seq").cast("long").alias("seq"), "text").groupBy("session")
    seeds = None if context is None else context.select(F.col("session").cast("string").alias("session"), "text").groupBy("session")
    return rows.transformWithStateInPandas(RoundProcessor(), ROUNDS_OUT, "Append", "None", seeds)


def windowed(events: DataFrame, time: str = "ts", late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """An addition for event streams: counts by type over tumbling windows, late rows up to the watermark."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
