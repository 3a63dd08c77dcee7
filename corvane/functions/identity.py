"""Content addresses: canonical text of values and its digest, as column expressions."""

from __future__ import annotations

import json
import unicodedata
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

#: Keys that are beside a value's identity, at any depth.
SIDE_KEYS = ("grounding", "status", "freshness")


def digest(text: Column | str) -> Column:
    """64 hex digits of a canonical text."""
    return F.sha2(F.col(text) if isinstance(text, str) else text, 256)


def canonical_value(value: Any) -> str:
    """JSON with NFC strings, keys sorted by code unit, side keys left out; floats and colliding keys are refused."""

    def clean(v: Any) -> Any:
        if isinstance(v, bool) or v is None or isinstance(v, int):
            return v
        if isinstance(v, float):
            raise ValueError("a float has no identity")
        if isinstance(v, str):
            return unicodedata.normalize("NFC", v)
        if isinstance(v, list):
            return [clean(x) for x in v]
        out: dict[str, Any] = {}
        for k, x in v.items():
            key = unicodedata.normalize("NFC", k)
            if key in out:
                raise ValueError(f"keys collide after normalisation: {key}")
            out[key] = clean(x)
        ordered = sorted((k for k in out if k not in SIDE_KEYS), key=lambda k: k.encode("utf-16-be"))
        return {k: out[k] for k in ordered}

    return json.dumps(clean(value), ensure_ascii=False, separators=(",", ":"))


@pandas_udf(StringType())
def canonical_json(text: pd.Series) -> pd.Series:
    """The canonical form of JSON texts; null where a text is no JSON or its value has no identity."""

    def one(t: str | None) -> str | None:
        try:
            return None if t is None else canonical_value(json.loads(t))
        except ValueError:
            return None

    return text.map(one)


@pandas_udf(StringType())
def nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def event_id(node_key: Column, content_hash: Column, fresh: Column, supersedes: Column, payload: Column) -> Column:
    """An event's id: its content without id and with the sequence number 0."""
    return digest(F.to_json(F.struct(content_hash.alias("contentHash"), fresh.alias("fresh"), node_key.alias("nodeKey"), payload.alias("payload"), F.lit(0).alias("seq"), supersedes.alias("supersedes"))))


def _said(*parts: Column) -> Column:
    ok = F.lit(True)
    for p in parts:
        ok = ok & F.coalesce(F.length(p) > 0, F.lit(False))
    return ok


def node_key(anchor: Column, slot: Column, check: Column | None = None) -> Column:
    """Advisory key from anchor and slot; a predicate's also from its normalised check.  Null without an anchor: no fact is everywhere."""
    parts = [anchor.alias("a"), *([check.alias("c")] if check is not None else []), slot.alias("s")]
    return F.when(_said(anchor), digest(F.to_json(F.struct(*parts))))


def relation_key(a: Column, kind: Column, b: Column) -> Column:
    """The digest of an ordered pair and its kind; null if a part is empty or both ends are one."""
    return F.when(_said(a, kind, b) & (a != b), digest(F.to_json(F.struct(a.alias("a"), b.alias("b"), kind.alias("k")))))


def negation_key(kind: Column, target: Column, scope: Column) -> Column:
    """The digest of a kind, a target and a scope; null if one is empty."""
    return F.when(_said(kind, target, scope), digest(F.to_json(F.struct(kind.alias("neg"), scope.alias("s"), target.alias("t")))))


def minted_key(path: Column, parent_key: Column, parent_path: Column) -> Column:
    """A node's key: its path with % and : escaped in every part; a unit's is its file's key and its own escaped name."""
    from .text import escape_key

    own = F.array_join(F.transform(F.split(path, "/"), lambda p: escape_key(p)), "/")
    unit = F.startswith(path, F.concat(parent_path, F.lit("::")))
    local = F.substring(path, F.length(parent_path) + 3, F.lit(1 << 20))
    return F.when(F.coalesce(unit, F.lit(False)), F.concat(parent_key, F.lit("::"), escape_key(local))).otherwise(own)


def seat_id(brief: Column) -> Column:
    """A seat's id is that of its brief, so that who is called again is the same seat."""
    return digest(F.to_json(F.struct(brief.alias("brief"), F.lit("Seat").alias("kind"))))
