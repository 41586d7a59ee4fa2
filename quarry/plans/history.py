"""Conversation history and message assembly for a model."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.chats import role_list
from ..session import stored, unstored
from ..sources.ledger import Change, Ledger

# Pairs kept verbatim, letters of the older transcript that are summarised, summaries kept, provider limits
# (context, simple prompt, listing characters) and output tokens of the modes.
PAIRS, TRANSCRIPT, SUMMARIES = 6, 4_000, 200
LIMITS = {
    "groq": (50_000, 15_000, 25_000), "ollama": (500_000, 100_000, 50_000), "gemini": (500_000, 100_000, 50_000),
    "openai": (400_000, 100_000, 50_000), "xai": (400_000, 100_000, 50_000), "anthropic": (600_000, 100_000, 50_000),
}
CACHED = "session_id long, older long, summary string, used long"
#: Shares of a session whose older pairs are looked through apart.
SALTS = 64
OUTPUT_TOKENS = {"listing": 2_048, "short": 200, "search": 8_192}


def last_line(transcript: Column) -> Column:
    """Default summariser: the end of the transcript."""
    return F.concat(F.lit("Earlier: "), F.substr(transcript, F.greatest(F.length(transcript) - 199, F.lit(1))))


def _tie() -> Column:
    """Orders pairs at one position."""
    return F.xxhash64("position", "user_message", "ai_response")


def older_ends(pairs: DataFrame, keep: int = PAIRS, most: int = TRANSCRIPT) -> DataFrame:
    """(session_id, older, transcript): how many pairs there are before the last keep, and the last most letters of what was said in them; sessions without such pairs have no row.

    Only pairs that can reach into these letters are gathered, so a session of any length costs the row at most its last letters: a running length from the end, first within
    SALTS shares of a session and then over what these leave, tells how much comes after a pair. A share lacks some of the later pairs, never adds one, so what it drops is out of reach.
    Blank and null sides of a pair are left out; a pair of which both are is counted and says nothing. Pairs at one position come in the order of a hash of their texts.
    """
    side = lambda who, c: F.when(F.trim(c) != "", F.concat(F.lit(f"{who}: "), F.trim(c)))
    line = F.concat_ws("\n", side("User", "user_message"), side("Assistant", "ai_response"))
    lines = pairs.select("session_id", "position", _tie().alias("tie"), F.substring(line, -most, most).alias("l")).withColumn("salt", F.pmod("tie", F.lit(SALTS)))

    def reach(rows: DataFrame, *by: str) -> DataFrame:
        back = Window.partitionBy(*by).orderBy(F.desc("position"), F.desc("tie"))
        ranked = rows.withColumn("k", F.row_number().over(back))
        told = F.when((F.col("k") > keep) & (F.col("l") != ""), F.length("l") + 1).otherwise(0)
        after = F.coalesce(F.sum(told).over(back.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        return ranked.withColumn("after", after).filter((F.col("k") <= keep) | (F.col("after") <= most) & (F.col("l") != ""))

    near = reach(reach(lines, "session_id", "salt").drop("k", "after"), "session_id").filter(F.col("k") > keep)
    said = F.array_join(F.transform(F.reverse(F.array_sort(F.collect_list(F.struct("k", "l")))), lambda x: x["l"]), "\n")  # lines of no more than 2 * most letters
    ends = near.groupBy("session_id").agg(said.alias("t")).select(F.col("session_id").alias("_session"), F.substring("t", -most, most).alias("transcript"))
    counted = pairs.groupBy("session_id").agg((F.count("*") - keep).alias("older")).filter("older > 0")
    return counted.join(ends, F.col("session_id").eqNullSafe(F.col("_session")), "left").select("session_id", "older", F.coalesce("transcript", F.lit("")).alias("transcript"))


@dataclass
class Summaries:
    """Summaries of older pairs, kept in a ledger for the sessions that were asked for last: a session is summarised again only when more pairs have become old.

    At most `most` are kept, those used last (of one use: the larger session id). Sessions without an id are summarised each time.
    """

    ledger: Ledger
    most: int = SUMMARIES
    name: str = "summaries"

    def of(self, older: DataFrame, summarise: Callable[[Column], Column]) -> DataFrame:
        """(session_id, summary) of older_ends rows; what had to be summarised and the time of use are stored before this returns."""
        older = stored(older, "older")
        found: list[DataFrame] = []

        def work(change: Change) -> None:
            known = change.table(self.name, CACHED)
            now = change.base.version + 1
            joined = older.join(known.select("session_id", "older", "summary"), ["session_id", "older"], "left")
            # Told apart before they are summarised, so that nothing known goes through the model.
            hits, misses = joined.filter("summary is not null"), joined.filter("summary is null")
            made = stored(hits.select("session_id", "older", "summary").unionByName(misses.select("session_id", "older", F.coalesce(summarise(F.col("transcript")), F.lit("")).alias("summary"))), "summaries")
            found[:] = [made]
            used = made.filter("session_id is not null").select("session_id", "older", "summary", F.lit(now).cast("long").alias("used"))
            rows = known.join(used, "session_id", "left_anti").unionByName(used).orderBy(F.desc("used"), F.desc("session_id")).limit(self.most)
            if not used.isEmpty():
                change.replace(self.name, rows, key="session_id")

        self.ledger.change("summaries", work)
        unstored(older)
        return found[0].select("session_id", "summary")


def history(pairs: DataFrame, keep: int = PAIRS, summarise: Callable[[Column], Column] = last_line, cache: Summaries | None = None) -> DataFrame:
    """(session_id, position, role, content): a system row that summarises older pairs, if there are any with texts, and the last pairs verbatim."""
    back = Window.partitionBy("session_id").orderBy(F.desc("position"), _tie().desc())
    recent = role_list(pairs.withColumn("_k", F.row_number().over(back)).filter(F.col("_k") <= keep))
    older = older_ends(pairs, keep).filter("transcript <> ''")
    told = cache.of(older, summarise) if cache else older.select("session_id", summarise(F.col("transcript")).alias("summary"))
    notes = told.filter(F.trim("summary") != "").select("session_id", F.lit(-1).cast("long").alias("position"), F.lit("system").alias("role"), F.col("summary").alias("content"))
    return notes.unionByName(recent.withColumn("position", F.col("position").cast("long")))


def messages(system: str, rows: DataFrame, question: str) -> DataFrame:
    """(session_id, messages): system message (with the summaries of the history), the history and the question."""
    said = rows.filter(F.trim("content") != "").groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct("position", "role", "content"))).alias("h"))
    plain = lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))
    notes = F.array_join(F.transform(F.filter("h", lambda x: x["role"] == "system"), lambda x: F.concat(F.lit("\n"), x["content"])), "")
    one = lambda role, content: F.array(F.struct(F.lit(role).alias("role"), content.alias("content")))
    turns = F.transform(F.filter("h", lambda x: x["role"] != "system"), plain)
    return said.select("session_id", F.concat(one("system", F.concat(F.lit(system), notes)), turns, one("user", F.lit(question))).alias("messages"))


def limit(provider: str, kind: str) -> int:
    """Characters a provider takes: context, prompt or listing."""
    return LIMITS[provider][("context", "prompt", "listing").index(kind)]


def truncated_prompt(prompt: Column, provider: str) -> Column:
    n = limit(provider, "prompt")
    return F.when(F.length(prompt) <= n, prompt).otherwise(F.concat(F.regexp_replace(F.substring(prompt, 1, n), r"\s+$", ""), F.lit("\n\n[Truncated.]")))


def listing_budget(provider: str, documents: int) -> int:
    """Characters of each document's preview in a listing."""
    return max(80, limit(provider, "listing") // max(1, documents))


def token_usage(calls: DataFrame) -> DataFrame:
    """Sums over model calls (prompt_tokens, completion_tokens)."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return calls.agg(total("prompt_tokens").alias("prompt_tokens"), total("completion_tokens").alias("completion_tokens")).withColumn("total_tokens", F.col("prompt_tokens") + F.col("completion_tokens"))
