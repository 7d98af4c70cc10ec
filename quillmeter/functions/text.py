"""Small text functions of transcripts and reports."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Openings of user texts that tools write, and of the text left by an interruption. Fixed values.
TOOL_WRITTEN = ("<bash-input>", "<bash-stdout>", "<bash-stderr>", "<local-command-caveat>", "<local-command-stdout>", "<local-command-stderr>", "<command-name>", "<command-message>", "<command-args>")
INTERRUPTED = "[Request interrupted by user"


def line_count(text: Column) -> Column:
    """Lines of a text, one that lacks its line feed included; 0 for null and empty."""
    feeds = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return F.coalesce(F.when(text == "", 0).otherwise(feeds + F.when(text.endswith("\n"), 0).otherwise(1)), F.lit(0)).cast("long")


def prompt_kind(text: Column) -> Column:
    """blank, tool, interrupt or prompt."""
    start = F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+", "")
    tool = reduce(or_, (start.startswith(p) for p in TOOL_WRITTEN))
    return F.when(start == "", "blank").when(tool, "tool").when(start.startswith(INTERRUPTED), "interrupt").otherwise("prompt")


def short_model(model: Column) -> Column:
    """A model's name without the vendor prefix, a bracketed mode and a date."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(model, r"^claude-", ""), r"\[[^\]]*\]", ""), r"-\d{8}$", "")


def human_number(x: Column) -> Column:
    """12.3B, 4.5M, 6.7K or the whole number."""
    size = F.abs(x)
    unit = lambda n, s: F.format_string(f"%.1f{s}", x / n)
    return F.when(size >= 1e9, unit(1e9, "B")).when(size >= 1e6, unit(1e6, "M")).when(size >= 1e3, unit(1e3, "K")).otherwise(F.format_string("%.0f", x.cast("double")))


#: What names a stored result's folder, an agent, and the tag of a notification. Fixed values.
STORED_IN, AGENT, NOTIFIED = "tool-results/", "agent-", "task-notification"
#: Tags of a notification's fields. Fixed values.
NOTIFIED_FIELDS = ("task-id", "tool-use-id", "output-file", "event")


def references(text: Column) -> Column:
    """Names of stored results (a file with a suffix of letters in their folder) and of agents that a text mentions.

    The text is cut into runs of name characters; a run counts by what it begins with. What follows the last letter of a
    suffix, like the dot of a sentence, is no part of a name.
    """
    runs = F.split(F.regexp_replace(text, r"[^A-Za-z0-9._/-]+", " "), " ")
    names = F.transform(F.filter(runs, lambda w: w.startswith(STORED_IN)), lambda w: F.regexp_replace(F.element_at(F.split(F.substring(w, len(STORED_IN) + 1, 10_000), "/"), 1), r"[^A-Za-z]+$", ""))
    suffix = lambda n: F.element_at(F.split(n, r"\."), -1)
    stored = F.filter(names, lambda n: (F.instr(n, ".") > 1) & (F.regexp_replace(suffix(n), "[A-Za-z]", "") == ""))
    bare = F.flatten(F.transform(runs, lambda w: F.split(w, "[./_]")))
    digits = lambda w: F.substring(w, len(AGENT) + 1, 10_000)
    agents = F.filter(bare, lambda w: w.startswith(AGENT) & (F.length(w) >= len(AGENT) + 12) & (F.translate(digits(w), "0123456789abcdef", "") == ""))
    return F.array_distinct(F.concat(F.transform(stored, lambda n: F.concat(F.lit(STORED_IN), n)), agents))


def notifications(text: Column) -> Column:
    """An array of (task_id, tool_use_id, output_file, event) of the task notifications in a text; missing fields are
    empty. Each notification is cut at its tags into a map from tag to text, of which the named fields are taken."""
    opening = F.transform(F.split(text, f"<{NOTIFIED}>"), lambda part: F.when(F.instr(part, f"</{NOTIFIED}>") > 0, F.substring_index(part, f"</{NOTIFIED}>", 1)))
    blocks = F.array_compact(F.slice(opening, 2, F.greatest(F.size(opening) - 1, F.lit(0))))
    pairs = lambda b: F.filter(F.transform(F.split(b, "<"), lambda p: F.struct(F.substring_index(p, ">", 1).alias("tag"), F.substring(p, F.instr(p, ">") + 1, 1_000_000).alias("said"))), lambda p: p["said"] != "")
    field = lambda b, tag: F.coalesce(F.try_element_at(F.filter(pairs(b), lambda p: p["tag"] == tag), F.lit(1))["said"], F.lit("")).alias(tag.replace("-", "_"))
    return F.transform(blocks, lambda b: F.struct(*(field(b, tag) for tag in NOTIFIED_FIELDS)))
