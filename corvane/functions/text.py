"""Paths, globs, tiers, claims and credential patterns as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

TIERS = ("T0", "T1", "T2")
#: Path segments that mark a candidate for the strictest tier.
CRITICAL_SEGMENTS = ("auth", "payments", "secrets", "kms", "crypto", "billing")
CLAIM_BYTES = 512
#: The closed vocabulary of predicate slots.
SLOTS = (
    "invariant", "contract", "precondition", "postcondition", "sideeffect", "ownership", "perf-bound",
    "security-property", "gotcha", "rationale", "dependency", "count", "definition",
)
#: The closed vocabulary of relation kinds, and the axes.
RELATION_KINDS = ("depends-on", "calls")
AXES = ("spatial", "territory", "dependency")


def path_segments(path: Column) -> Column:
    return F.filter(F.transform(F.split(path, "/"), lambda s: F.trim(s)), lambda s: s != "")


def file_part(path: Column) -> Column:
    """What stands before the first `::`."""
    return F.substring_index(path, "::", 1)


def under_scope(path: Column, scope: Column) -> Column:
    """Whether a file part is the scope or below it, by whole segments; an empty scope holds everything."""
    part, top = file_part(path), F.rtrim(scope, F.lit("/"))
    return (top == "") | (part == top) | F.startswith(part, F.concat(top, F.lit("/")))


def is_prefix(short: Column, long: Column) -> Column:
    return F.slice(long, 1, F.size(short)) == short


def escape_key(part: Column) -> Column:
    return F.replace(F.replace(part, F.lit("%"), F.lit("%25")), F.lit(":"), F.lit("%3A"))


def unescape_key(part: Column) -> Column:
    return F.replace(F.replace(part, F.lit("%3A"), F.lit(":")), F.lit("%25"), F.lit("%"))


def glob_regex(glob: Column) -> Column:
    """`**` stands for anything, `*` for anything within a segment; all else is literal."""
    plain = F.regexp_replace(glob, r"[^A-Za-z0-9_/*]", r"\\$0")
    stars = F.replace(F.replace(plain, F.lit("**"), F.lit("\x00")), F.lit("*"), F.lit("[^/]*"))
    return F.concat(F.lit("^"), F.replace(stars, F.lit("\x00"), F.lit(".*")), F.lit("$"))


def glob_literal_length(glob: Column) -> Column:
    return F.when(F.instr(glob, "*") > 0, F.instr(glob, "*") - 1).otherwise(F.length(glob))


def glob_folder(glob: Column) -> Column:
    """The folder that all paths of a glob lie in; '' if its literal part names none."""
    return F.regexp_extract(F.substring(glob, F.lit(1), glob_literal_length(glob)), r"^(.*)/[^/]*$", 1)


def glob_zone(glob: Column) -> Column:
    """The directory that a glob's literal part names: the whole of a glob without stars."""
    return F.when(F.instr(glob, "*") == 0, F.rtrim(glob, F.lit("/"))).otherwise(glob_folder(glob))


def folders(path: Column) -> Column:
    """A path and all folders above it, and ''."""
    parts = F.split(path, "/")
    return F.array_distinct(F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))))


def tier_rank(tier: Column) -> Column:
    """T0 0, T1 1, T2 2, anything else 3."""
    return F.when(tier == "T0", 0).when(tier == "T1", 1).when(tier == "T2", 2).otherwise(3)


def strictest(a: Column, b: Column) -> Column:
    """The stricter of two tiers; one that is off the lattice counts as T0."""
    rank = lambda t: F.when(tier_rank(t) > 2, 0).otherwise(tier_rank(t))
    least = F.least(rank(a), rank(b))
    return F.element_at(F.array(*map(F.lit, TIERS)), least + 1)


def weaker(new: Column, old: Column) -> Column:
    return (tier_rank(new) > 2) | (tier_rank(old) > 2) | (tier_rank(new) > tier_rank(old))


def is_critical(path: Column) -> Column:
    return F.arrays_overlap(path_segments(F.lower(path)), F.array(*map(F.lit, CRITICAL_SEGMENTS)))


def canonical_symbol(symbol: Column) -> Column:
    """A declaration file of the build names its source."""
    return F.regexp_replace(symbol, r"dist/(.*)\.d\.ts", "src/$1.ts")


def terminal_name(symbol: Column) -> Column:
    return F.regexp_extract(symbol, r"([A-Za-z_$][\w$]*)[^\w$]*$", 1)


def one_line(text: Column) -> Column:
    return F.trim(F.element_at(F.split(text, "\n"), 1))


def words(text: Column) -> Column:
    """White-space separated words."""
    return F.when(F.trim(text) == "", 0).otherwise(F.size(F.split(F.regexp_replace(text, r"^\s+|\s+$", ""), r"\s+")))


def claim_key(claim: Column) -> Column:
    """Claims are the same if equal after trimming; NFC texts are assumed (see identity.nfc)."""
    return F.regexp_replace(claim, r"^\s+|\s+$", "")


def known_slot(slot: Column) -> Column:
    """Whether a slot is in the closed vocabulary; an absent one isn't."""
    return F.coalesce(slot.isin(*SLOTS), F.lit(False))


def known_relation_kind(kind: Column) -> Column:
    return F.coalesce(kind.isin(*RELATION_KINDS), F.lit(False))


def is_tier(tier: Column) -> Column:
    return F.coalesce(tier.isin(*TIERS), F.lit(False))


def is_axis(axis: Column) -> Column:
    return F.coalesce(axis.isin(*AXES), F.lit(False))


def is_scope(scope: Column) -> Column:
    """A scope is a text that isn't empty."""
    return F.coalesce(F.length(scope) > 0, F.lit(False))


def valid_template(claim: Column, slot: Column, *required: Column) -> Column:
    """All required fields, a claim of at most CLAIM_BYTES bytes of UTF-8, a slot of the closed vocabulary."""
    present = F.lit(True)
    for r in required:
        present = present & F.coalesce(F.length(r) > 0, F.lit(False))
    return present & F.coalesce(F.octet_length(claim) <= CLAIM_BYTES, F.lit(False)) & known_slot(slot)


def closed_slot_refusal(slot: Column) -> Column:
    """Why an unknown slot is refused; null for a known one."""
    told = F.concat(F.lit("closed-slot: '"), slot, F.lit("' is none of "), F.lit(", ".join(SLOTS)))
    return F.when(~known_slot(slot), F.coalesce(told, F.lit("closed-slot: null is none of " + ", ".join(SLOTS))))


def deepest_common_unit(paths: Column) -> Column:
    """The longest common prefix of an array of paths, by units between ::; '' if there is none."""
    return F.coalesce(common_prefix(F.filter(paths, lambda p: p.isNotNull()), "::"), F.lit(""))


def primary_anchor(paths: Column) -> Column:
    """The deepest common unit; null where it is empty: a fact without a place of its own is refused."""
    unit = deepest_common_unit(paths)
    return F.when(unit != "", unit)


def unit_scope(path: Column) -> Column:
    """The folder of a unit's file; '' for a file at the top."""
    return F.regexp_extract(file_part(path), r"^(.*)/[^/]*$", 1)


def tool_name(scope: Column) -> Column:
    """own_ and the last part of a scope, between / or :."""
    parts = F.filter(F.split(scope, "[/:]"), lambda p: p != "")
    return F.concat(F.lit("own_"), F.coalesce(F.get(parts, F.size(parts) - 1), scope))


def normal_check(kind: Column, body: Column) -> Column:
    """A check's part of an identity: its kind and its trimmed NFC body, a unit separator between."""
    from .identity import nfc

    return F.concat(kind, F.lit("\x1f"), F.regexp_replace(nfc(body), r"^\s+|\s+$", ""))


def common_prefix(paths: Column, mark: str) -> Column:
    """The longest common prefix, by segments between marks, of an array of paths; '' if there is none."""
    split = F.transform(F.array_distinct(paths), lambda p: F.split(p, re.escape(mark)))

    def both(a: Column, b: Column) -> Column:
        same = F.transform(F.sequence(F.lit(1), F.greatest(F.least(F.size(a), F.size(b)), F.lit(1))), lambda i: F.slice(a, 1, i) == F.slice(b, 1, i))
        return F.when((F.size(a) == 0) | (F.size(b) == 0), F.array().cast("array<string>")).otherwise(F.slice(a, 1, F.size(F.filter(same, lambda x: x))))

    return F.array_join(F.aggregate(F.slice(split, 2, F.greatest(F.size(split) - 1, F.lit(1))), F.element_at(split, 1), both), mark)


#: The prefix, body class and number of body characters of each credential family.
CREDENTIALS = (
    ("gh[pousr]_", "[A-Za-z0-9]", "{6,}"),
    ("xox[baprs]-", "[A-Za-z0-9-]", "{6,}"),
    ("github_pat_", "[A-Za-z0-9_]", "{22,}"),
    ("AKIA", "[A-Z0-9]", "{16,16}"),
)
REDACTED = "[REDACTED]"
_OPENS = "|".join(p for p, _, _ in CREDENTIALS)
#: A body character opens no other credential, so that one never swallows its neighbour.
CREDENTIAL = "|".join(f"{prefix}(?:(?!{_OPENS}){body}){times}" for prefix, body, times in CREDENTIALS)


def scrub(text: Column) -> Column:
    """Every credential, leftmost first and without overlaps, replaced by one mark."""
    return F.regexp_replace(text, CREDENTIAL, REDACTED)
