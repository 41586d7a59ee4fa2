"""Sessions, messages and the use of documents in chats."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import chat_title


def sessions_with_counts(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """Every session with its number of messages, latest first. Messages are counted before the join."""
    counts = messages.groupBy("session_id").agg(F.count("*").alias("n"))
    return sessions.join(counts, sessions["id"] == counts["session_id"], "left").select("id", "title", "directory_path", "created_at", "updated_at", F.coalesce("n", F.lit(0)).alias("message_count")).orderBy(F.desc("updated_at"), F.desc("id"))


def history(messages: DataFrame, session_id: int) -> DataFrame:
    return messages.filter(F.col("session_id") == session_id).orderBy("timestamp", "id")


def last_message(messages: DataFrame) -> DataFrame:
    """The latest message of each session."""
    return messages.groupBy("session_id").agg(F.max_by(F.struct(*messages.columns), F.struct("timestamp", "id")).alias("m")).select("m.*")


def message_pairs(turns: DataFrame) -> DataFrame:
    """Question and answer: each user turn with the turn after it, if the assistant speaks there."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    nexts = turns.select("conv_id", "turn", "role", "text", F.lead("role").over(w).alias("next_role"), F.lead("text").over(w).alias("answer"))
    return nexts.filter((F.col("role") == "user") & (F.col("next_role") == "assistant")).select(F.col("conv_id").alias("session_id"), F.col("turn").alias("position"), F.trim("text").alias("user_message"), F.trim("answer").alias("ai_response"))


def role_list(pairs: DataFrame) -> DataFrame:
    """Pairs as one role/content row each, blank contents left out."""
    rows = F.array(F.struct(F.lit(0).alias("k"), F.lit("user").alias("role"), F.col("user_message").alias("content")), F.struct(F.lit(1).alias("k"), F.lit("assistant").alias("role"), F.col("ai_response").alias("content")))
    return pairs.select("session_id", "position", F.explode(rows).alias("m")).filter(F.trim("m.content") != "").select("session_id", (F.col("position") * 2 + F.col("m.k")).alias("position"), "m.role", "m.content")


def last_pairs(pairs: DataFrame, n: int = 6) -> DataFrame:
    """The last n pairs of each session; the group limit works before the shuffle."""
    w = Window.partitionBy("session_id").orderBy(F.desc("position"))
    return pairs.withColumn("back", F.row_number().over(w)).filter(F.col("back") <= n).drop("back")


def titles(turns: DataFrame) -> DataFrame:
    first = turns.filter(F.col("role") == "user").groupBy("conv_id").agg(F.min_by("text", "turn").alias("message"))
    return first.select("conv_id", chat_title(F.col("message")).alias("title"))


def usage_merge(usage: DataFrame, links: DataFrame) -> DataFrame:
    """Usage after new links (document_id, chat_session_id, used_at): counts add up, first and last use widen."""
    new = links.groupBy("document_id", "chat_session_id").agg(F.count("*").alias("usage_count"), F.min("used_at").alias("first_used"), F.max("used_at").alias("last_used"))
    return usage.select(new.columns).unionByName(new).groupBy("document_id", "chat_session_id").agg(F.sum("usage_count").alias("usage_count"), F.min("first_used").alias("first_used"), F.max("last_used").alias("last_used"))


def most_used(docs: DataFrame, usage: DataFrame, most: int = 10) -> DataFrame:
    """Documents by the number of sessions that used them (and the number of uses)."""
    counts = usage.groupBy("document_id").agg(F.count("*").alias("sessions"), F.sum("usage_count").alias("uses"))
    return counts.join(docs, counts["document_id"] == docs["id"]).select("id", "file_path", "sessions", "uses").orderBy(F.desc("sessions"), "id").limit(most)


def since(as_of: str, days: int):
    return F.to_timestamp(F.lit(as_of)) - F.make_dt_interval(F.lit(days))


def message_totals(messages: DataFrame, sessions: DataFrame) -> DataFrame:
    return messages.agg(F.count("*").alias("messages"), F.coalesce(F.avg("response_time"), F.lit(0.0)).alias("average_response_time")).select(sessions.agg(F.count("*")).scalar().alias("sessions"), "*")


def recent_activity(messages: DataFrame, sessions: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    return messages.agg(F.count_if(F.col("timestamp") >= since(as_of, days)).alias("messages")).select(sessions.agg(F.count_if(F.col("created_at") >= since(as_of, days))).scalar().alias("sessions"), "messages")


def daily(messages: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Messages and mean response time by day; days without messages have no row."""
    return messages.filter(F.col("timestamp") >= since(as_of, days)).groupBy(F.to_date("timestamp").alias("day")).agg(F.count("*").alias("messages"), F.avg("response_time").alias("average_response_time")).orderBy("day")


def active_directories(sessions: DataFrame, as_of: str, days: int = 30, most: int = 10) -> DataFrame:
    return sessions.filter(F.col("created_at") >= since(as_of, days)).groupBy("directory_path").agg(F.count("*").alias("sessions")).orderBy(F.desc("sessions"), "directory_path").limit(most)


def cascade_session(session_id: int, *tables: tuple[DataFrame, str]) -> list[DataFrame]:
    """The tables without a session's rows."""
    return [t.filter(~F.col(c).eqNullSafe(F.lit(session_id))) for t, c in tables]


def link_sources(messages: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(links of every cited source to its document, stub documents for unknown paths) from messages with sources."""
    cited = messages.select("session_id", "timestamp", F.explode("sources").alias("s")).filter(F.coalesce(F.trim("s.file_path"), F.lit("")) != "")
    known = cited.join(docs.select(F.col("id").alias("document_id"), F.col("file_path").alias("path")), F.col("s.file_path") == F.col("path"), "left")
    stubs = known.filter("document_id is null").groupBy(F.col("s.file_path").alias("file_path")).agg(F.max(F.substring("s.content_snippet", 1, 500)).alias("content_preview"))
    number = F.coalesce("document_id", F.xxhash64("s.file_path"))
    return known.select(number.alias("document_id"), F.col("session_id").alias("chat_session_id"), F.col("timestamp").alias("used_at")), stubs.select(F.xxhash64("file_path").alias("id"), "file_path", "content_preview", F.lit("metadata_only").alias("processing_status"))


def last_source(messages: DataFrame) -> DataFrame:
    """First usable source path of each session's latest message."""
    usable = F.filter("sources", lambda s: F.coalesce(F.trim(s["file_path"]), F.lit("")) != "")
    return last_message(messages).select("session_id", F.try_element_at(usable, F.lit(1))["file_path"].alias("file_path"))


def create_session(sessions: DataFrame, session_id: int, directory: str, as_of: str, title: str = "New Chat") -> DataFrame:
    """sessions with a new one; the directory is normalised."""
    import posixpath

    row = sessions.sparkSession.createDataFrame([(session_id, title, posixpath.normpath(directory), as_of)], "id long, title string, directory_path string, t string")
    new = row.select("id", "title", "directory_path", F.to_timestamp("t").alias("created_at"), F.to_timestamp("t").alias("updated_at"))
    return sessions.select(new.columns).unionByName(new)


def set_title(sessions: DataFrame, session_id: int, title: str, as_of: str) -> DataFrame:
    hit = F.col("id") == session_id
    return sessions.withColumn("title", F.when(hit, F.lit(title)).otherwise(F.col("title"))).withColumn("updated_at", F.when(hit, F.to_timestamp(F.lit(as_of))).otherwise(F.col("updated_at")))


def set_answers(messages: DataFrame, answers: DataFrame) -> DataFrame:
    """messages whose answer, sources and response time are now known (answers: id, ai_response, sources, response_time)."""
    a = answers.select(F.col("id").alias("_id"), *(F.col(c).alias(f"_{c}") for c in ("ai_response", "sources", "response_time")))
    known = F.col("_id").isNotNull()
    out = messages.join(a, messages["id"] == a["_id"], "left")
    return out.select(*(F.when(known, F.col(f"_{c}")).otherwise(messages[c]).alias(c) if c in ("ai_response", "sources", "response_time") else messages[c] for c in messages.columns))
