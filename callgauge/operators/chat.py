"""Users, sessions and messages of the conversation store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from callgauge.functions.joins import group_join
from callgauge.functions.text import non_empty, strip
from callgauge.operators import validation
from callgauge.schema import AUTO_TITLE_CHARS, LIST_PREVIEW_CHARS
from callgauge.session import BROADCAST_ROWS


def _name_id(name: Column) -> Column:
    """A UUID-shaped id derived from a name: the same name always gets the same id."""
    digest = F.md5(name)
    parts = [F.substring(digest, start, size) for start, size in _UUID_PARTS]
    return F.concat_ws("-", *parts)


_UUID_PARTS = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))


# --- users ---------------------------------------------------------------------------


def upsert_users(users: DataFrame, seen: DataFrame) -> DataFrame:
    """Insert names seen for the first time, refresh ``last_seen_at`` of the others.

    ``seen`` has (username, seen_at), any number of rows per name; names are
    trimmed, and blank or missing ones are left out. New users get an id derived from
    their name.
    """
    arrivals = (
        seen.select(strip(F.col("username")).alias("username"), "seen_at")
        .where(F.col("username") != "")
        .groupBy("username")
        .agg(F.min("seen_at").alias("_first"), F.max("seen_at").alias("_last"))
    )
    return users.join(arrivals, "username", "full_outer").select(
        F.coalesce("id", _name_id(F.col("username"))).alias("id"),
        "username",
        F.coalesce("created_at", "_first").alias("created_at"),
        F.greatest("last_seen_at", "_last").alias("last_seen_at"),
    )


def find_user(users: DataFrame, username: str) -> DataFrame:
    """The user of that name, whatever its case; the earliest one if several match."""
    matches = users.where(F.lower("username") == F.lower(F.lit(username)))
    return matches.orderBy("created_at", "id").limit(1)


def users_by_name(users: DataFrame) -> DataFrame:
    """What ``find_user`` answers for every name: one row per case-folded name."""
    first = F.min(F.struct("created_at", "id", "username", "last_seen_at"))
    return (
        users.groupBy(F.lower("username").alias("name"))
        .agg(first.alias("u"))
        .select("name", "u.id", "u.username", "u.created_at", "u.last_seen_at")
    )


# --- sessions ------------------------------------------------------------------------


def create_sessions(requests: DataFrame) -> DataFrame:
    """Session rows for (id, user_id, title, created_at) requests; title may be NULL."""
    return requests.select(
        "id", "user_id", "title", "created_at", F.col("created_at").alias("updated_at")
    )


def accepted_messages(messages: DataFrame, sessions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, refused): the messages to store, and those that break a rule.

    Refused ones carry their ``errors``; a message of an unknown session is one of them.
    """
    known = sessions.select(F.col("id").alias("session_id"), F.lit(True).alias("_known"))
    checked = validation.check_messages(messages).join(known, "session_id", "left")
    unknown = F.when(F.col("_known").isNull(), F.array(F.lit("session_id:unknown")))
    marked = checked.withColumn(
        "errors", F.concat("errors", F.coalesce(unknown, F.array().cast("array<string>")))
    ).select(*messages.columns, "errors")
    good = F.size("errors") == 0
    return marked.where(good).drop("errors"), marked.where(~good)


def append_messages(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """Sessions after ``messages`` were added; see ``accepted_messages`` for the rows.

    ``updated_at`` moves to the newest message; a session without a title takes the
    first 60 characters of its first user message. Contents are cut to that length
    before anything is grouped.
    """
    short = messages.select(
        F.col("session_id"),
        "created_at",
        F.when(
            F.col("role") == "user",
            F.struct("created_at", "id", F.left("content", F.lit(AUTO_TITLE_CHARS)).alias("title")),
        ).alias("_opening"),
    )
    added = short.groupBy("session_id").agg(
        F.max("created_at").alias("_newest"), F.min("_opening").alias("_opening")
    )
    return sessions.join(added, sessions["id"] == added["session_id"], "left").select(
        sessions["id"],
        "user_id",
        F.coalesce("title", F.col("_opening.title")).alias("title"),
        "created_at",
        F.greatest("updated_at", "_newest").alias("updated_at"),
    )


def _message_stats(messages: DataFrame) -> DataFrame:
    """Per session: message count and the start of the newest message.

    The newest message is a maximum over (created_at, id), so each task hands on a
    single short row per session however many messages it read.
    """
    newest = F.struct("created_at", "id", F.left("content", F.lit(LIST_PREVIEW_CHARS)).alias("text"))
    return messages.groupBy("session_id").agg(
        F.count("*").alias("message_count"), F.max(newest)["text"].alias("preview")
    )


def _listed(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """Sessions with message count (0 if none) and preview of the newest message."""
    stats = _message_stats(messages)
    return sessions.join(stats, sessions["id"] == stats["session_id"], "left").select(
        *sessions.columns,
        F.coalesce("message_count", F.lit(0)).alias("message_count"),
        "preview",
    )


def session_list(
    sessions: DataFrame, messages: DataFrame, user_id: str, limit: int = 50
) -> DataFrame:
    """One user's most recently used sessions, with message count and preview.

    The page of at most ``limit`` sessions is taken first; it is small by
    construction and reduces the messages to those sessions before they are grouped.
    """
    newest_first = [F.col("updated_at").desc(), F.col("id")]
    page = sessions.where(F.col("user_id") == user_id).orderBy(*newest_first).limit(limit)
    wanted = page.select(F.col("id").alias("session_id"))
    if limit <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    mine = messages.join(wanted, "session_id", "left_semi")
    listed = _listed(page, mine).withColumn("preview", non_empty(F.col("preview")))
    return listed.orderBy(*newest_first)


def session_lists(sessions: DataFrame, messages: DataFrame, limit: int = 50) -> DataFrame:
    """The session list of every user: at most ``limit`` sessions each."""
    newest_first = W.partitionBy("user_id").orderBy(F.col("updated_at").desc(), F.col("id"))
    pages = (
        sessions.where(F.col("user_id").isNotNull())
        .withColumn("position", F.row_number().over(newest_first))
        .where(F.col("position") <= limit)
    )
    return _listed(pages, messages).withColumn("preview", non_empty(F.col("preview")))


def session_detail(
    sessions: DataFrame, messages: DataFrame, session_id: str | None = None
) -> DataFrame:
    """Sessions with their messages: one row per message.

    ``position`` counts a session's messages from 1, oldest first. It is the number of
    messages of earlier days, from a table of counts, plus the place within the day, so a
    session that holds most messages is numbered by many tasks. Header columns repeat on each row. A session without messages has one row whose
    message columns are NULL; an empty newest message gives an empty preview here
    and none in the lists. The transcript stays a set of rows, so a very long
    session never has to fit into one array. The messages drive the join, which
    lets adaptive execution split a session that holds most of them.
    """
    if session_id is not None:
        sessions = sessions.where(F.col("id") == session_id)
        messages = messages.where(F.col("session_id") == session_id)
    headers = _listed(sessions, messages)
    day = ["session_id", "_day"]
    dated = messages.withColumn("_day", F.to_date("created_at"))
    before = W.partitionBy("session_id").orderBy("_day").rowsBetween(W.unboundedPreceding, -1)
    earlier = (
        dated.groupBy(*day)
        .agg(F.count("*").alias("_n"))
        .select(*day, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_earlier"))
    )
    place = F.row_number().over(W.partitionBy(*day).orderBy("created_at", "id"))
    rows = group_join(dated.withColumn("_place", place), earlier, day, "inner").select(
        F.col("session_id"),
        F.col("id").alias("message_id"),
        "role",
        "content",
        F.col("created_at").alias("sent_at"),
        (F.col("_earlier") + F.col("_place")).alias("position"),
    )
    filled = rows.join(headers, rows["session_id"] == headers["id"]).drop("session_id")
    empty = headers.where(F.col("message_count") == 0).select(
        "*",
        *[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in rows.columns if c != "session_id"],
    )
    return filled.select(*empty.columns).unionByName(empty)


def transcript(messages: DataFrame, session_id: str) -> DataFrame:
    """The messages of one session, oldest first."""
    return messages.where(F.col("session_id") == session_id).orderBy("created_at", "id")


def link_calls(calls: DataFrame, sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """Calls with the title of their session and the role of their stored message.

    Calls without a message, most of them as a rule, stay out of the join by message: one
    NULL key would gather them all.
    """
    titles = sessions.select(F.col("id").alias("session_id"), "user_id", "title")
    stored = messages.select(F.col("id").alias("message_id"), F.col("role").alias("message_role"))
    titled = calls.join(titles, "session_id", "left")
    with_message = titled.where(F.col("message_id").isNotNull()).join(stored, "message_id", "left")
    without = titled.where(F.col("message_id").isNull()).withColumn(
        "message_role", F.lit(None).cast(stored.schema["message_role"].dataType)
    )
    return with_message.unionByName(without)


def purge_users(
    users: DataFrame, sessions: DataFrame, messages: DataFrame, doomed: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(users, sessions, messages) without the doomed users and what hangs on them.

    ``doomed`` has (user_id). Calls are not part of the cascade.
    """
    gone = doomed.select("user_id").distinct()
    lost = sessions.join(gone, "user_id", "left_semi").select(F.col("id").alias("session_id"))
    return (
        users.join(gone, users["id"] == gone["user_id"], "left_anti"),
        sessions.join(gone, "user_id", "left_anti").select(*sessions.columns),
        messages.join(lost, "session_id", "left_anti").select(*messages.columns),
    )
