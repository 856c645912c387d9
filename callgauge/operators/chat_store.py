"""The conversation store kept as keyed tables: stored upsert, append and purge.

The rules are those of ``operators.chat``; here they are applied to the rows a change needs,
and only the buckets it touches are written. Messages lie by session, so that a session is
read from, or removed as, one bucket.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callgauge.functions.text import strip
from callgauge.operators import chat
from callgauge.schema import MESSAGES_SCHEMA, SESSIONS_SCHEMA, USERS_SCHEMA
from callgauge.session import materialize
from callgauge.sources import keyed


@dataclass(frozen=True)
class Store:
    """The three tables below one folder."""

    users: keyed.Table
    sessions: keyed.Table
    messages: keyed.Table


def store(root: str, buckets: int = 64) -> Store:
    root = root.rstrip("/")
    return Store(
        keyed.Table(f"{root}/users", USERS_SCHEMA, "username", "username", buckets),
        keyed.Table(f"{root}/sessions", SESSIONS_SCHEMA, "id", "id", buckets),
        keyed.Table(f"{root}/messages", MESSAGES_SCHEMA, "id", "session_id", buckets),
    )


def upsert_users(kept: Store, seen: DataFrame) -> None:
    """See ``chat.upsert_users``; users who were not seen are neither read whole nor written."""
    spark = seen.sparkSession
    names = seen.select(strip(F.col("username")).alias("username"))

    def merged(base):
        known = keyed.read(spark, kept.users, names, base)
        rows = chat.upsert_users(known, seen)
        return keyed.bucketed(kept.users, rows)

    keyed.change(spark, kept.users, merged)


def append_messages(kept: Store, messages: DataFrame) -> DataFrame:
    """Store messages that obey the rules and bump their sessions; returns the refused ones.

    Messages go first: when the bump is lost with the driver, the same call again repeats
    both and changes nothing else.
    """
    spark = messages.sparkSession
    ids = messages.select(F.col("session_id").alias("id")).where(F.col("id").isNotNull())
    # what was judged is kept, as the sessions change below
    sessions = materialize(keyed.read(spark, kept.sessions, ids))
    good, refused = chat.accepted_messages(messages, sessions)
    refused = materialize(refused)
    keyed.put(good, kept.messages)

    def bumped(base):
        rows = chat.append_messages(keyed.read(spark, kept.sessions, ids, base), good)
        return keyed.bucketed(kept.sessions, rows)

    keyed.change(spark, kept.sessions, bumped)
    return refused


def purge_users(kept: Store, doomed: DataFrame) -> None:
    """Remove users and what hangs on them; ``doomed`` has (user_id).

    Messages cost one tombstone per session. The users go last, so a purge that was cut
    short finds the rest when it is run again.
    """
    spark = doomed.sparkSession
    gone = doomed.select("user_id").distinct()
    sessions = keyed.read(spark, kept.sessions)
    lost = materialize(sessions.join(gone, "user_id", "left_semi").select("id"))
    keyed.remove_groups(lost.select(F.col("id").alias("session_id")), kept.messages)
    keyed.remove(lost, kept.sessions)
    users = keyed.read(spark, kept.users)
    keyed.remove(users.join(gone, users["id"] == gone["user_id"], "left_semi"), kept.users)


def transcript(spark: SparkSession, kept: Store, session_id: str) -> DataFrame:
    """The messages of one session, oldest first, from its bucket alone."""
    wanted = spark.range(1).select(F.lit(session_id).alias("session_id"))
    return keyed.read(spark, kept.messages, wanted).orderBy("created_at", "id")
