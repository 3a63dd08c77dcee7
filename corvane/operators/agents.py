"""Memory of agents: templates, logbook, rule sets, closing folds, orientation, what is injected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import words
from . import memory

# Required and optional fields of each kind of memory, in the order in which they are rendered.
REQUIRED = {
    "project": ("rule", "scope", "frecency"),
    "task": ("taskId", "attempted", "failedWith", "stoppedAt", "lesson"),
    "pr": ("prId", "decisions", "reviewOutcomes", "knowledgeDelta"),
    "logbook": ("prId", "at", "territories", "shipped", "decisions", "tradeoffs", "risks", "openThreads", "links"),
}
OPTIONAL = {"project": ("grounding",), "task": ("ref",), "pr": ("ref",), "logbook": ()}
# The prose sections of a logbook entry, their cap in characters, and who writes them.
SECTIONS, SECTION_CAP, AUTHOR = ("shipped", "decisions", "tradeoffs", "risks", "openThreads"), 280, "orch"
ORIENTATION_CAP, PROJECT_CAP = 250, 500


def _names(of: dict, kind: Column) -> Column:
    out = F.array().cast("array<string>")
    for k, names in of.items():
        out = F.when(kind == k, F.array(*map(F.lit, names)) if names else F.array().cast("array<string>")).otherwise(out)
    return out


def template_faults(kind: Column, keys: Column) -> Column:
    """Why an entry with some keys isn't of its kind's template: required keys that it lacks, then keys that it may not have."""
    required, allowed = _names(REQUIRED, kind), F.concat(_names(REQUIRED, kind), _names(OPTIONAL, kind))
    lacks = F.transform(F.filter(required, lambda k: ~F.array_contains(keys, k)), lambda k: F.concat(F.lit("missing field: "), k))
    over = F.transform(F.filter(keys, lambda k: ~F.array_contains(allowed, k)), lambda k: F.concat(F.lit("out-of-section prose: "), k))
    return F.concat(lacks, over)


def logbook_faults(entry: Column) -> Column:
    """The faults of a logbook entry (a JSON object): of its template, then sections that are blank or over their cap."""
    faults = template_faults(F.lit("logbook"), F.coalesce(F.json_object_keys(entry), F.array().cast("array<string>")))
    for s in SECTIONS:
        text = F.coalesce(F.get_json_object(entry, f"$.{s}"), F.lit(""))
        fault = F.when(F.trim(text) == "", f"unfilled section: {s}").when(F.length(text) > SECTION_CAP, f"section over cap: {s}")
        faults = F.concat(faults, F.array_compact(F.array(fault)))
    return faults


def render(kind: str, entry: Column) -> Column:
    """Lines key=value of an entry (a JSON object of texts) in its template's order, values as JSON; absent keys are left out."""
    lines = []
    for k in (*REQUIRED[kind], *OPTIONAL[kind]):
        value = F.get_json_object(entry, f"$.{k}")
        lines.append(F.when(value.isNotNull(), F.concat(F.lit(f"{k}="), F.regexp_extract(F.to_json(F.struct(value.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1))))
    return F.concat_ws("\n", *lines)


def partition(kind: Column) -> Column:
    """knowledge for a fact's kinds, memory for any other."""
    return F.when(F.coalesce(kind.isin("advisory", "predicate"), F.lit(False)), "knowledge").otherwise("memory")


def append_logbook(log: DataFrame, entries: DataFrame) -> DataFrame:
    """log (pr_id, pos, author, entry) with the entries that may be added: by the author, sound, the first of their PR."""
    sound = entries.where((F.col("author") == AUTHOR) & (F.size(logbook_faults(F.col("entry"))) == 0))
    first = sound.groupBy("pr_id").agg(F.min(F.struct("pos", "author", "entry")).alias("e")).select("pr_id", "e.*")
    return log.select("pr_id", "pos", "author", "entry").unionByName(first.join(log.select("pr_id"), "pr_id", "left_anti"))


def consult(log: DataFrame, pr_id: str | None = None, date: str | None = None, territory: str | None = None) -> DataFrame:
    """The entries (pr_id, at, territories) that are equal in all that is asked; without a question none."""
    if pr_id is None and date is None and territory is None:
        return log.limit(0)
    out = log if pr_id is None else log.where(F.col("pr_id") == pr_id)
    out = out if date is None else out.where(F.col("at") == date)
    return out if territory is None else out.where(F.array_contains("territories", territory))


def inject_for(records: DataFrame, seat: str) -> DataFrame:
    """A seat is given its own records only; whoever reads the store reads all."""
    return records.where(F.col("owner") == seat)


def apply_ranking(rules: DataFrame, events: DataFrame, slab: str) -> DataFrame:
    """rules (slab, id, state) with the state after a ranking: active ones compete; what isn't injected is archived, never deleted."""
    ranked = memory.rank_rules(rules.where("state = 'active'").select(slab, "id"), events, slab).select("id", "injected")
    rows = rules.join(ranked, "id", "left")
    return rows.withColumn("state", F.when(F.col("injected"), "active").otherwise("archived")).drop("injected")


def respawn_rules(rules: DataFrame, asked: DataFrame) -> DataFrame:
    """rules with the archived ones that are asked for (id) active again."""
    back = asked.select("id").distinct().withColumn("_back", F.lit(True))
    return rules.join(back, "id", "left").withColumn("state", F.when(F.col("_back"), "active").otherwise(F.col("state"))).drop("_back")


def closing_folds(records: DataFrame) -> DataFrame:
    """owner, task_id, attempted, failed_with, stopped_at, lesson of the task records."""
    return records.where("kind = 'task'").select("owner", "task_id", "attempted", "failed_with", "stopped_at", "lesson")


def spawn_recall(folds: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (owner, task_id) with a seat's own fold; found says whether it has one: a miss is refused, not made up."""
    mine = folds.groupBy("owner", "task_id").agg(F.min(F.struct("attempted", "failed_with", "stopped_at", "lesson")).alias("f"))
    rows = asked.join(mine, ["owner", "task_id"], "left")
    return rows.select("owner", "task_id", F.col("f").isNotNull().alias("found"), "f.attempted", "f.failed_with", "f.stopped_at", "f.lesson")


def orientation_tokens(goal: Column, last: Column, current: Column, state: Column) -> Column:
    return sum((F.coalesce(words(c), F.lit(0)) for c in (goal, last, current, state)), F.lit(0))


def injected_orientation(tokens: Column) -> Column:
    """Whether an orientation may be injected: at most ORIENTATION_CAP words."""
    return tokens <= ORIENTATION_CAP


def orient_event(channel: Column, label: Column) -> Column:
    """The id of an event on a channel: the digest of its payload's canonical text."""
    return F.sha2(F.to_json(F.struct(channel.alias("channel"), label.alias("label"))), 256)


def facet_memo(before: DataFrame, now: DataFrame) -> DataFrame:
    """facet, key, rerolled, moved: a facet is rolled again only if its source's key moved; one seen before has then drifted."""
    rows = now.select("facet", "key").join(before.select("facet", F.col("key").alias("_key")), "facet", "left")
    again = ~F.col("key").eqNullSafe(F.col("_key"))
    return rows.select("facet", "key", again.alias("rerolled"), (again & F.col("_key").isNotNull()).alias("moved"))


def surface_budget(kind: Column) -> Column:
    return F.when(kind == "projectMem", PROJECT_CAP).otherwise(0)


def turn_header(records: DataFrame, awareness: DataFrame, orientation: DataFrame) -> DataFrame:
    """owner, rules (how many of its own project records), facets, oriented: the three slabs of each seat's turn."""
    own = records.where("kind = 'project'").groupBy("owner").agg(F.count("*").alias("rules"))
    facets = awareness.groupBy("owner").agg(F.count("*").alias("facets"))
    seats = records.select("owner").distinct()
    rows = seats.join(own, "owner", "left").join(facets, "owner", "left").join(orientation.select("owner", F.lit(True).alias("_o")), "owner", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return rows.select("owner", zero("rules"), zero("facets"), F.coalesce("_o", F.lit(False)).alias("oriented"))


def memory_log(records: DataFrame) -> DataFrame:
    """id, owner, kind, entry of records (owner, kind, entry) as a log: equal records are one event."""
    made = F.sha2(F.to_json(F.struct("entry", "kind", "owner")), 256)
    return records.select(made.alias("id"), "owner", "kind", "entry").dropDuplicates(["id"])


def kinds_in(log: DataFrame) -> DataFrame:
    return log.select("kind").distinct()
