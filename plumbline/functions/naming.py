"""Names and summaries of topics: cleaning of generated text, grounding, bans and fallbacks."""

from __future__ import annotations

import re
from collections.abc import Callable
from itertools import product

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Subjects and verbs of openings, acronyms, brands, function words, endings and words that name nothing.
SUBJECTS = (
    "this theme", "the theme", "this cluster", "the cluster", "this area", "the area", "this project", "the project", "this work", "the work", "this group", "the group",
    "this collection", "the collection", "this set", "the set", "this topic", "the topic", "this effort", "the effort", "this",
)
VERBS = (
    "focuses on", "focuses around", "is focused on", "centers on", "centers around", "is centered on", "revolves around", "is about", "is", "involves", "covers",
    "includes", "describes", "addresses", "explores", "examines", "deals with", "relates to", "pertains to", "concerns", "regards", "encompasses", "captures",
    "represents", "consists of", "comprises", "contains", "groups", "handles", "details", "documents", "tracks",
)
ACRONYMS = (
    "GPU", "CPU", "AWS", "GCP", "TEI", "API", "SIE", "NATS", "OCR", "CLI", "UI", "UX", "JSON", "LLM", "TLS", "VDB", "CTA", "SDK", "HTTP", "AI", "ML", "RAG", "SQL", "K8S", "GHCR", "TUI",
    "MTP", "PR", "CI", "CD", "BYO", "VM", "VMS", "CUDA", "JIT", "EKS", "GKE", "AKS", "GCS", "MTEB", "NPM", "VPC", "TTL", "DNS", "GPT", "MCP", "GTM", "GPC",
)
BRANDS = {"colbert": "ColBERT", "deepseek": "DeepSeek", "github": "GitHub", "lora": "LoRA", "pypi": "PyPI", "qwen3": "Qwen3", "sglang": "SGLang", "vectorhub": "VectorHub"}
FUNCTION_WORDS = ("and", "or", "for", "to", "the", "a", "an", "of", "in", "on", "at", "with", "by", "vs", "from", "into")
ENDINGS = (
    "and", "or", "the", "a", "an", "to", "of", "for", "with", "in", "on", "at", "by", "via", "from", "into", "through", "then", "that", "which", "was", "were", "is", "are", "as", "using", "more", "etc",
)
NOTHING = ("cluster", "chores", "update", "fix", "main", "misc", "various", "general")
NAME_ECHOES = ("keyphrase", "items", "title", "repo", "update:", "description")
SUMMARY_ECHOES = ("repo:", "files changed:", "initial request:", "messages")

_OPENING = re.compile("|".join(re.escape(x) for x in sorted([*(f"{s} {v} " for s, v in product(SUBJECTS, VERBS)), "about "], key=len, reverse=True)))
_CAMEL = re.compile(r"(?<=[^\W\d_])(?=[^\W\d_])")


def said(raw: str) -> str:
    """What is left of a generation: behind its reasoning, without quotes, its first line that isn't blank."""
    body = raw.rpartition("</think>")[2].strip().strip('"').strip()
    return next((line for line in body.splitlines() if line.strip()), body)


def without_opening(line: str) -> str:
    """A line without up to three openings like 'This theme focuses on'; what follows gets a capital."""
    for _ in range(3):
        opening = _OPENING.match(line.lower())
        if not opening:
            break
        line = line[opening.end() :].lstrip()
        line = line[:1].upper() + line[1:]
    return line


def shortened(line: str, most: int) -> str:
    """White space collapsed, cut with an ellipsis."""
    line = " ".join(line.split())
    return line if len(line) <= most else line[:most] + "…"


def clean_summary(raw: str) -> str:
    """A generated summary as one line, or nothing if it is too short or repeats the prompt."""
    line = without_opening(shortened(said(raw), 240))
    return "" if len(line.encode()) < 15 or line.lower().startswith(SUMMARY_ECHOES) else line


def _wordlike(piece: str) -> bool:
    return sum(c.isalpha() for c in piece) >= 2 and not any("0" <= c <= "9" for c in piece)


def _camel(piece: str) -> str:
    """Spaces where a small letter meets a capital, and before the last capital of a run that goes on in small letters."""

    def gap(m: re.Match) -> str:
        at = m.start()
        before, after, then = piece[at - 1], piece[at], piece[at + 1 : at + 2]
        return " " if after.isupper() and (before.islower() or before.isupper() and then.islower()) else ""

    return _CAMEL.sub(gap, piece)


def spaced(line: str) -> str:
    """A slug or CamelCase heading as words; codes and versions stay as they are, a last 'cluster' goes."""
    out = []
    for token in line.split():
        pieces = token.split("-")
        text = ""
        for k, piece in enumerate(pieces):
            if k:
                text += " " if _wordlike(pieces[k - 1]) and _wordlike(piece) else "-"
            text += piece if any("0" <= c <= "9" for c in piece) else _camel(piece)
        out += text.split()
    if len(out) > 1 and out[-1].lower() in ("cluster", "clusters"):
        out.pop()
    return " ".join(_rejoined(out))


def _rejoined(words: list[str]) -> list[str]:
    """Runs of two or three words that make up a brand are put together again."""
    out, at = [], 0
    while at < len(words):
        take = next((n for n in (3, 2) if at + n <= len(words) and "".join(words[at : at + n]).lower() in BRANDS), 1)
        out.append("".join(words[at : at + take]))
        at += take
    return out


def _known_case(word: str) -> str | None:
    """The case of a brand, an acronym or a short code."""
    if word.lower() in BRANDS:
        return BRANDS[word.lower()]
    core = "".join(c for c in word.upper() if c.isalnum())
    code = len(core.encode()) <= 6 and any(c.isnumeric() for c in core) and all(c.isupper() or c.isnumeric() for c in core)
    return word.upper() if word and (core in ACRONYMS or code) else None


def _capital(word: str, first: bool) -> str:
    if not first and word.lower() in FUNCTION_WORDS:
        return word.lower()
    return word[:1].upper() + word[1:].lower()


def title_case(phrase: str) -> str:
    """Brands, acronyms and codes in their case, function words small but for the first, all else with a capital."""
    out = []
    for place, word in enumerate(phrase.split()):
        known = _known_case(word)
        if known is None:
            parts = re.split(r"([-/])", word)
            known = "".join(p if p in ("-", "/") else (_known_case(p) or _capital(p, place == 0 and k == 0)) for k, p in enumerate(parts))
        out.append(known)
    return " ".join(out)


def is_slug(name: str) -> bool:
    """One token of two or more parts with letters, tied by hyphens."""
    return len(name.split()) == 1 and sum(any("a" <= c.lower() <= "z" for c in part) for part in name.split("-")) >= 2


def clean_name(raw: str) -> str:
    """A generated name as a title of one to nine words, or nothing if it isn't one."""
    line = " ".join(said(raw).replace("_", " ").split()).rstrip(".:,").strip()
    line = spaced(line)
    if not line or line.lower().startswith(NAME_ECHOES) or not 1 <= len(line.split()) <= 9 or len(line) > 64:
        return ""
    title = title_case(line)
    while title.endswith(" Cluster"):
        title = title.removesuffix(" Cluster")
    while title.endswith("-Cluster"):
        title = title.removesuffix("-Cluster")
    title = title.strip()
    return "" if not title or title.lower() in NOTHING or is_slug(title) else title


def summary_heading(summary: str) -> str:
    """The first clause of a summary as a title of two to ten words, or nothing."""
    words = re.split(r"[,;:.]", summary.strip(), maxsplit=1)[0].split()[:10]
    while words and words[-1].lower() in ENDINGS:
        words.pop()
    return title_case(" ".join(words)) if 2 <= len(words) <= 10 else ""


def normal_slug(text: str) -> str:
    """Letters and digits in small letters."""
    return "".join(c for c in text.lower() if c.isalnum())


def banned(repos: list[str]) -> set[str]:
    """Names that say no more than a repository does: its own and its parts of three bytes or more."""
    parts = {p for repo in repos for p in re.split(r"[\W_]+", repo.lower()) if len(p.encode()) >= 3}
    return parts | {normal_slug(repo) for repo in repos}


def grounded(name: str, terms: list[str]) -> bool:
    """Whether a name shares a part of three bytes or more with one of the terms."""
    split = lambda text: {p for p in re.split(r"[\W_]+", text) if len(p.encode()) >= 3}
    return bool(split(name.lower()) & set().union(*map(split, terms))) if name and terms else False


def keyword_label(terms: list[str], ban: set[str]) -> str:
    """The first three terms that aren't banned, as titles."""
    return shortened(" · ".join([title_case(t) for t in terms if normal_slug(t) not in ban][:3]), 48)


def fallback_name(summary: str | None, terms: list[str], ban: set[str]) -> str:
    """The lead clause of the summary, else the label of keywords."""
    return summary_heading(summary or "") or keyword_label(terms, ban)


def finished_name(raw: str, summary: str | None, terms: list[str] | None, repos: list[str]) -> str:
    """A generated name that is well formed, grounded and not banned, or the fallback."""
    name, ban = clean_name(raw), banned(repos)
    ok = bool(name) and (terms is None or grounded(name, terms)) and normal_slug(name) not in ban
    return name if ok else fallback_name(summary, terms or [], ban)


def _each(rule: Callable[[str], str]) -> Callable[[Column], Column]:
    """A rule for a text as a vectorised function of a column; null counts as empty."""

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: rule(x or ""))

    return F.pandas_udf(run, StringType())


cleaned_names = _each(clean_name)
cleaned_summaries = _each(clean_summary)
headings = _each(summary_heading)


def _finish(raw: pd.Series, summary: pd.Series, terms: pd.Series, repos: pd.Series) -> pd.Series:
    rows = zip(raw, summary, terms, repos, strict=True)
    return pd.Series([finished_name(r or "", s, None if t is None else list(t), [] if p is None else list(p)) for r, s, t, p in rows], dtype="object")


#: `finished_name` of columns; terms and repositories are arrays, null terms ask for no grounding.
finished_names = F.pandas_udf(_finish, StringType())


def input_hash(version: str, *parts: Column) -> Column:
    """What a summary is cached by: 16 digits of the SHA-256 of the prompt's version and its parts; null parts are empty."""
    return F.left(F.sha2(F.concat_ws("\0", F.lit(version), *[F.coalesce(p, F.lit("")) for p in parts]), 256), F.lit(16))


#: The fraction of the median below which a name is rejected, and how many scored names that takes.
MEDIAN_FLOOR, MEDIAN_NAMES = 0.6, 8


def rejected_by_median(scores: DataFrame) -> DataFrame:
    """The run-relative gate: topic, score and whether the score lies below MEDIAN_FLOOR of the median of all (the upper
    one of two). With fewer than MEDIAN_NAMES names nothing is rejected. One number a topic is sorted."""
    sorted_scores = F.array_sort(F.collect_list("score"))
    middle = scores.agg(F.count(F.lit(1)).alias("names"), F.try_element_at(sorted_scores, F.floor(F.size(sorted_scores) / 2).cast("int") + 1).alias("median"))
    return scores.join(F.broadcast(middle)).select("topic", "score", ((F.col("names") >= MEDIAN_NAMES) & (F.col("score") < MEDIAN_FLOOR * F.col("median"))).alias("rejected"))  # one row


def rejects_at(rows: DataFrame, beta: float, floor: float = 0.5, least: int = 5) -> DataFrame:
    """How many names would be rejected at a fraction beta of their members' low coherence (score, low, members)."""
    limit = F.when(F.col("members") < least, floor).otherwise(F.greatest(F.lit(floor), F.lit(beta) * F.col("low")))
    return rows.agg(F.count_if(F.col("score") < limit).alias("rejected"))


def gated_names(cached: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Cached names (topic, name, fallback) after the gate: rejected ones fall back, fallbacks and names without a verdict stay."""
    joined = cached.join(verdicts.select("topic", "accepted"), "topic", "left")
    replaced = (F.coalesce("name", F.lit("")) != "") & (F.col("name") != F.col("fallback")) & ~F.coalesce("accepted", F.lit(True))
    return joined.select("topic", F.when(replaced, F.col("fallback")).otherwise(F.col("name")).alias("name"), replaced.alias("replaced"))


def name_report(rows: DataFrame, betas: tuple[float, ...] = (0.7, 0.8, 0.9)) -> DataFrame:
    """One row about all topics' names (name, score, low, members, scored, is_fallback, rejected, rating): medians, fallbacks,
    names that several topics share, slugs, rejections at each beta, and verdicts against people's ratings."""
    judged = F.col("scored") & ~F.col("is_fallback")
    shared = F.count(F.lit(1)).over(Window.partitionBy("name")) > 1
    rows = rows.withColumn("shared", shared)

    def median(value: Column, condition: Column) -> Column:
        found = F.array_sort(F.collect_list(F.when(condition, value)))  # a number a topic
        return F.coalesce(F.try_element_at(found, F.floor(F.size(found) / 2).cast("int") + 1), F.lit(0.0))

    limit = lambda beta: F.when(F.col("members") < 5, 0.5).otherwise(F.greatest(F.lit(0.5), F.lit(beta) * F.col("low")))
    wrong, rated = F.col("rating") == "wrong", judged & F.col("rating").isNotNull()
    tokens = F.split("name", "-")
    slug = (F.size(F.split(F.trim("name"), r"\s+")) == 1) & (F.size(F.filter(tokens, lambda t: t.rlike("[A-Za-z]"))) >= 2)
    return rows.agg(
        F.count(F.lit(1)).alias("topics"), F.count_if(judged).alias("scored"), F.round(median(F.col("score"), judged), 6).alias("score_median"), F.round(median(F.col("low"), judged), 6).alias("low_median"),
        F.round(median(F.col("score") / F.col("low"), judged & (F.col("low") > 0)), 6).alias("ratio_median"), F.count_if(judged & F.col("rejected")).alias("rejected"), F.count_if("is_fallback").alias("fallbacks"),
        F.count_if("shared").alias("shared"), F.count_if(slug).alias("slugs"), *[F.count_if(judged & (F.col("score") < limit(b))).alias(f"rejected_at_{round(100 * b)}") for b in betas],
        F.count_if(rated & F.col("rejected") & wrong).alias("true_rejections"), F.count_if(rated & F.col("rejected") & ~wrong).alias("false_rejections"), F.count_if(rated & ~F.col("rejected") & wrong).alias("missed"),
    )
