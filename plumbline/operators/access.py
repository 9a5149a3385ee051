"""Who may see what: read scopes, roles, the allowlist of repositories, and bounds of arguments."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The tools, and which of them the roles may call; an operator may call all.
FILTERED = ("search", "related", "topics", "recent", "show", "trace_list", "trace_show", "trace_search", "trace_compare")
GLOBAL = ("status", "stats", "tool")
ROLES = {
    "operator": (*FILTERED, *GLOBAL),
    "primary": ("search", "related", "topics", "recent", "status", "show"),
    "investigator": ("search", "topics", "recent", "status", "show", "trace_list", "trace_show", "trace_search", "trace_compare"),
    "validator": ("search", "status", "show", "trace_list", "trace_show", "trace_search", "trace_compare"),
}


@dataclass(frozen=True)
class ReadScope:
    """Allow-lists; an empty one allows everything, and all must allow a row."""

    repos: tuple[str, ...] = ()
    campaigns: tuple[str, ...] = ()
    roles: tuple[str, ...] = ()
    sources: tuple[str, ...] = ()

    @property
    def restricted(self) -> bool:
        """Whether it keeps anything back."""
        return bool(self.repos or self.campaigns or self.roles or self.sources)

    def predicate(self, columns: list[str]) -> Column:
        """The condition on a row. The source it was captured from counts, and its own one where that is empty."""
        out = F.lit(True)
        for name, values in (("repo", self.repos), ("campaign", self.campaigns), ("role", self.roles)):
            if values:
                out = out & F.coalesce(F.col(name).isin(*values), F.lit(False))
        if self.sources:
            own = F.col("source")
            if "capture_source" in columns:
                own = F.when(F.coalesce("capture_source", F.lit("")) != "", F.col("capture_source")).otherwise(own)
            out = out & F.coalesce(own.isin(*self.sources), F.lit(False))
        return out


def scope_filter(rows: DataFrame, scope: ReadScope) -> DataFrame:
    """Rows that a reader may see."""
    return rows.where(scope.predicate(rows.columns))


def may_call(role: str, tool: str, scope: ReadScope | None = None) -> bool:
    """Whether a role may call a tool; a restricted scope hides those whose figures are of the whole fleet."""
    if tool not in ROLES.get(role, ()):
        return False
    return tool in FILTERED or scope is None or not scope.restricted


def role_matrix() -> list[tuple[str, str, bool]]:
    """Every role and tool, and whether it may be called."""
    return [(role, tool, may_call(role, tool)) for role in ROLES for tool in (*FILTERED, *GLOBAL)]


def clamped(value: int, least: int, most: int) -> int:
    """An argument within its bounds."""
    return max(least, min(most, value))


def needle_of(query: str, most: int = 4096) -> str:
    """A query text, if it isn't too long."""
    if len(query) > most:
        raise ValueError(f"a query has at most {most} characters")
    return query


def allowed_events(events: DataFrame, repos: list[str], known: DataFrame) -> DataFrame:
    """Events of sessions whose start lies in an allowed repository; whatever can't be told stays out.

    A start names its repository, or its cwd does. All starts are looked at, also those that come after other events. An
    empty allowlist allows everything.
    """
    from plumbline.operators.sessions import repo_of

    if not repos:
        return events
    starts = events.where((F.col("kind") == "session_start") & (F.coalesce("session_id", F.lit("")) != ""))
    said = F.coalesce(F.when(F.coalesce(F.get_json_object("payload", "$.repo"), F.lit("")) != "", F.get_json_object("payload", "$.repo")), F.get_json_object("payload", "$.cwd"), F.lit(""))
    named = starts.select("session_id", said.alias("said"))
    found = named.join(repo_of(named, known, "said"), "said", "left").select("session_id", F.coalesce("repo", "said").alias("repo"))
    return events.join(found.where(F.col("repo").isin(*repos)).select("session_id").distinct(), "session_id", "left_semi")


def facet(topics: DataFrame, repo: str = "", author: str = "") -> DataFrame:
    """Topics whose repositories and authors (arrays) hold the chosen ones."""
    for column, value in (("repos", repo), ("authors", author)):
        if value:
            topics = topics.where(F.array_contains(column, value))
    return topics


def resolved_actor(pinned: str = "", email: str = "", user: str = "") -> str:
    """Who acts here: the pinned login, the local part of an address, the user, or unknown."""
    return pinned.strip() or email.split("@")[0].strip() or user.strip() or "unknown"
