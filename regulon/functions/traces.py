"""Agent trajectories (``map<string,string>``) and multi-agent traces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import strip

# Trajectory key prefixes and the submit tool's name.
TOOL_NAME = "tool_name_"
TOOL_ARGS = "tool_args_"
SUBMIT_TOOL = "submit_answer"


def submitted_answer(traj: Column, lexical: bool = False) -> Column:
    """PRS-12: the answer of the last ``submit_answer`` step, stripped and
    upper-cased (may be invalid; PRS-9 then falls through).

    Steps are ordered numerically; ``lexical=True`` orders the step keys as
    strings (so step 9 beats step 10), which is the reference's behaviour.
    """
    subs = F.filter(F.map_entries(traj), lambda e: e["key"].startswith(TOOL_NAME) & (e["value"] == SUBMIT_TOOL))

    def entry(e):
        step = F.substring_index(e["key"], "_", -1)
        args = F.element_at(traj, F.concat(F.lit(TOOL_ARGS), step))
        answer = F.upper(strip(F.coalesce(F.get_json_object(args, "$.answer"), F.lit(""))))
        order = step if lexical else step.try_cast("long")
        return F.struct(order.alias("o"), answer.alias("answer"))

    return F.array_max(F.transform(subs, entry))["answer"]


def tool_calls(traj: Column) -> Column:
    """AGG-13: number of keys starting with ``tool_name``."""
    return F.size(F.filter(F.map_keys(traj), lambda k: k.startswith("tool_name")))


def distinct_tools(traj: Column) -> Column:
    """Distinct tool names used in a trajectory."""
    names = F.transform(
        F.filter(F.map_entries(traj), lambda e: e["key"].startswith(TOOL_NAME)), lambda e: e["value"]
    )
    return F.size(F.array_distinct(names))


def stringify_trajectory(raw: Column) -> Column:
    """PRS-16: JSON object text -> map<string,string> (values as text);
    anything that is not an object -> ``{'raw': text}``."""
    m = F.from_json(raw, "map<string,string>")
    return F.when(m.isNotNull(), m).otherwise(F.create_map(F.lit("raw"), raw))


def total_tool_calls(coordinator: Column, sub_agents: Column) -> Column:
    """Coordinator tool calls plus the sum over sub-agents."""
    return tool_calls(coordinator) + F.aggregate(
        sub_agents, F.lit(0).cast("long"), lambda acc, s: acc + F.coalesce(s["tool_calls"], F.lit(0)).cast("long")
    )


def history_tokens(history: DataFrame, keys: list[str], position: str, start: Column, usage: str = "usage") -> DataFrame:
    """AGG-13: ``total_tokens`` of the history entries from ``start`` on, per key.

    ``history`` is long, a row an entry, with the entry's usage as JSON text;
    missing, null or other usage counts 0.
    """
    tokens = F.coalesce(F.get_json_object(usage, "$.total_tokens").try_cast("double"), F.lit(0.0)).cast("long")
    return history.groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(F.col(position) >= start, tokens)), F.lit(0)).alias("tokens_used"))
