"""Stateful forms: deduplicated logs, incremental folds, poke sessions, redaction across chunks."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.text import CREDENTIAL, REDACTED
from ..operators import events
from ..sources.store import Generations


def unique_events(stream: DataFrame) -> DataFrame:
    """A stream of events without repeated ids; malformed rows (no id) are left out."""
    return stream.where("id is not null").dropDuplicates(["id"])


def fold_into(store: Generations):  # noqa: ANN201
    """A foreachBatch sink that merges a batch's fold into the newest state; a batch that comes twice changes nothing."""

    def sink(batch: DataFrame, _: int) -> None:
        folded = events.fold(batch)
        store.commit(lambda state: events.fold(state.unionByName(folded.select(state.columns))).select(state.columns))

    return sink


def pokes(calls: DataFrame, least: int = 2) -> DataFrame:
    """session, pos, scope of the first call in a session whose run of one scope reaches `least`.

    calls: session, pos, scope (null: no navigation, which lengthens the run of the scope one is in).
    The state is the current scope, its run and the scopes already poked.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        scope, run, done = state.get if state.exists else (None, 0, [])
        out = []
        for row in pd.concat(list(batches)).sort_values("pos").itertuples():
            if row.scope is not None and row.scope != scope:
                scope, run = row.scope, 0
            run += scope is not None
            if run >= least and scope not in done:
                done = [*done, scope]
                out.append((key[0], row.pos, scope))
        state.update((scope, run, list(done)))
        yield pd.DataFrame(out, columns=["session", "pos", "scope"])

    return calls.groupBy("session").applyInPandasWithState(step, "session string, pos long, scope string", "scope string, run int, done array<string>", "append", GroupStateTimeout.NoTimeout)


_SHAPE = re.compile(CREDENTIAL)
#: Characters that may belong to a credential or its prefix; any other ends it.
_BODY = re.compile(r"[A-Za-z0-9_-]*\Z")


def scrub_chunk(carry: str, chunk: str, last: bool) -> tuple[str, str]:
    """(what can be written, what must wait): a credential that a chunk's end cuts waits for the rest.

    All that is after the last character outside every body class waits, so that the chunks together
    read as the whole text would.  The carry is as long as the longest run of body characters.
    """
    text = carry + chunk
    keep = len(text) if last else _BODY.search(text).start()
    return _SHAPE.sub(REDACTED, text[:keep]), text[keep:]


def scrub_stream(chunks: DataFrame) -> DataFrame:
    """stream, pos, text of a stream of chunks (stream, pos, text, last) without credentials."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        carry = state.get[0] if state.exists else ""
        out = []
        for row in pd.concat(list(batches)).sort_values("pos").itertuples():
            text, carry = scrub_chunk(carry, row.text or "", bool(row.last))
            out.append((key[0], row.pos, text))
        state.update((carry,))
        yield pd.DataFrame(out, columns=["stream", "pos", "text"])

    return chunks.groupBy("stream").applyInPandasWithState(step, "stream string, pos long, text string", "carry string", "append", GroupStateTimeout.NoTimeout)


def latest(stream: DataFrame, key: str) -> DataFrame:
    """The last entry of each key by position, for sinks in complete or update mode."""
    return stream.groupBy(key).agg(F.max_by("entry", "pos").alias("current"))
