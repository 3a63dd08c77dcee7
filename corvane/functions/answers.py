"""Answers, checks, spans, faults and placements as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The answer that abstains, the forms of claims, the reasons of those that don't parse.
ABSTAIN = "NO-FACT"
DEPENDS_ON, COUNT = r"(?i)^DEPENDS-ON:\s*(\S+)\s*$", r"(?i)^COUNT:\s*(\S+)\s*$"
DEPENDENCY_UNPARSEABLE, COUNT_UNPARSEABLE = "dependency-answer-unparseable", "count-answer-unparseable"
# The classes of faults, and the errors of an engine.
MALFORMED, INTERNAL = "malformed-args", "internal-fault"
ENGINE_FAULTS = ("TypeError", "RangeError", "ReferenceError")
#: What can stand around an answer without being part of it.
_AROUND = r"^[\s`'\"*.\[\](){}]+|[\s`'\"*.\[\](){}]+$"


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def abstains(answer: Column) -> Column:
    """Whether an answer is the abstaining word, whatever its case and what stands around it."""
    return F.coalesce(F.upper(F.regexp_replace(answer, _AROUND, "")) == ABSTAIN, F.lit(False))


def admit_answer(answer: Column) -> tuple[Column, Column]:
    """(claim, reason): the trimmed answer, or null with the reason, null too where the answer abstains or is empty.

    A control character but for tab, line feed and carriage return splices several responses.
    """
    whole = trimmed(answer)
    spliced = F.coalesce(answer.rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"), F.lit(False))
    none = answer.isNull() | (whole == "") | abstains(answer)
    return F.when(~none & ~spliced, whole), F.when(~none & spliced, "answer-malformed:multi-response")


def claimed_name(answer: Column, form: str) -> Column:
    """The name in a claim of a form; null if it has another."""
    name = F.regexp_extract(trimmed(answer), form, 1)
    return F.when(name != "", name)


def admit_check(kind: Column, text: Column) -> Column:
    """evaluable, or why a proposed check isn't: code-exec, runtime, malformed-check.

    An index-query is exists, absent or has-object and all after the first bar as its argument; an
    assertion is child-count with a key and a whole number, or subtree-hash with a key and a hash.
    """
    op, arg = F.trim(F.substring_index(text, "|", 1)), trimmed(F.regexp_extract(text, r"(?s)^[^|]*\|(.*)$", 1))
    parts = F.transform(F.split(text, r"\|"), lambda p: trimmed(p))
    of = lambda i: F.coalesce(F.get(parts, i), F.lit(""))
    query = op.isin("exists", "absent", "has-object") & (arg != "")
    counted = (of(0) == "child-count") & of(2).rlike(r"^\d+$")
    assertion = (F.size(parts) == 3) & (of(1) != "") & (counted | ((of(0) == "subtree-hash") & (of(2) != "")))
    sound = F.when(kind == "index-query", query).when(kind == "assertion", assertion)
    return F.when(kind.isin("code-exec", "runtime"), kind).when(F.coalesce(sound, F.lit(False)), "evaluable").otherwise("malformed-check")


# --- spans of bytes


def _inside(data: Column, at: Column) -> Column:
    """Whether a place is within a character of UTF-8: its byte continues one."""
    byte = F.conv(F.hex(F.substring(data, at + 1, F.lit(1))), 16, 10).cast("int")
    return F.coalesce((byte >= 128) & (byte < 192), F.lit(False))


def _bounded(data: Column, start: Column, end: Column) -> Column:
    return F.coalesce((start >= 0) & (start < end) & (end <= F.octet_length(data)), F.lit(False))


def mint_span(text: Column, start: Column, end: Column) -> Column:
    """The digest that a span of a text's bytes is bound to; null if it is empty, out of bounds or cuts a character."""
    data = F.encode(text, "UTF-8")
    return F.when(_bounded(data, start, end) & ~_inside(data, start) & ~_inside(data, end), F.sha2(data, 256))


def read_span(text: Column, digest: Column, start: Column, end: Column) -> Column:
    """A span's bytes as text; null if the text has another digest or the span is out of bounds."""
    data = F.encode(text, "UTF-8")
    return F.when(_bounded(data, start, end) & F.coalesce(F.sha2(data, 256) == digest, F.lit(False)), F.decode(F.substring(data, start + 1, end - start), "UTF-8"))


# --- faults


def fault_of(ok: Column, rejected: Column) -> Column:
    """The class of a verdict: null if it is ok, else what stands before the first colon if that is a class, else refused."""
    head = F.substring_index(rejected, ":", 1)
    return F.when(~ok, F.when(head.isin(MALFORMED, INTERNAL), head).otherwise("refused"))


def thrown(tag: Column, name: Column) -> Column:
    """The class of what was thrown: its tag, else internal for an engine's error or what is no error (null name)."""
    return F.coalesce(tag, F.when(name.isNull() | name.isin(*ENGINE_FAULTS), INTERNAL).otherwise("refused"))


def malformed_reason(message: Column) -> Column:
    return F.when(F.substring_index(message, ":", 1) == MALFORMED, message).otherwise(F.concat(F.lit(f"{MALFORMED}: "), message))


def missing_reason(tool: Column, required: Column, given: Column) -> Column:
    """Why a call lacks arguments, in the order in which they are required; null if it has all."""
    missing = F.transform(F.filter(required, lambda k: ~F.array_contains(given, k)), lambda k: F.concat(F.lit("'"), k, F.lit("'")))
    told = F.concat(F.lit(f"{MALFORMED}: '"), tool, F.lit("' requires "), F.array_join(missing, ", "), F.lit("; not supplied"))
    return F.when(F.size(missing) > 0, told)


def identity_verdict(stamp: Column, schema: str) -> Column:
    """Whether a store speaks an identity schema: current, foreign, or unstamped; only a current one is written to."""
    return F.when(F.coalesce(F.length(stamp) == 0, F.lit(True)), "unstamped").when(stamp == schema, "current").otherwise("foreign")


def names_candidate(name: Column, keywords: tuple[str, ...]) -> Column:
    """Whether a territory's name holds one of a policy's keywords, anywhere in it."""
    out = F.lit(False)
    for k in keywords:
        out = out | F.contains(name, F.lit(k))
    return out


# --- where provenance lives


def place(clone_required: Column) -> Column:
    """What a clone must have is a trailer, anything else a note."""
    return F.when(clone_required, "trailer").otherwise("note")


def note_orphaned(sha: Column, note_key: Column) -> Column:
    """A rewritten commit keeps its note's key and so loses the note."""
    return ~sha.eqNullSafe(note_key)


def read_after_clone(trailer: Column, note: Column, sha: Column, note_key: Column, refspec: Column) -> tuple[Column, Column]:
    """(from, value): the trailer's if there is one, else the note's if notes are fetched and it isn't orphaned."""
    noted = note.isNotNull() & refspec & ~note_orphaned(sha, note_key)
    return F.when(trailer.isNotNull(), "trailer").when(noted, "note"), F.when(trailer.isNotNull(), trailer).when(noted, note)


def git_pointer(sha: Column) -> Column:
    return F.concat(F.lit("cas:"), sha)


def grounding_source(level: Column) -> Column:
    return F.when(level.isin("crate", "module"), "tree").otherwise("manifest")
