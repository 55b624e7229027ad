"""Contacts, senders, conversations and message checks.

Conversations are keyed by a canonical pair key (``least``/``greatest`` of the
two ``type:id`` parties) so both directions land on one equi-join/group key
instead of an OR predicate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gymlake.functions.text import strip, valid_message
from gymlake.functions.text import MAX_MESSAGE_CHARS

# Message rejection reasons.
MESSAGE_REASONS = {"empty": "empty_message", "long": "message_too_long", "contact": "invalid_contact"}


def party(type_col, id_col) -> Column:
    t = F.col(type_col) if isinstance(type_col, str) else type_col
    i = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.concat(t, F.lit(":"), i.cast("string"))


def users(gyms: DataFrame, coaches: DataFrame, members: DataFrame) -> DataFrame:
    """Every addressable party as (user_id, user_type, name)."""
    return (gyms.select(F.col("id").alias("user_id"), F.lit("gym").alias("user_type"), "name")
            .unionByName(coaches.select(F.col("id").alias("user_id"), F.lit("coach").alias("user_type"), "name"))
            .unionByName(members.select(F.col("id").alias("user_id"), F.lit("member").alias("user_type"), "name")))


def message_contacts(gyms: DataFrame, coaches: DataFrame, members: DataFrame,
                     member_coach: DataFrame) -> DataFrame:
    """Who may message whom, for every owner at once (owner -> contact rows).

    coach -> its gym and its members; gym -> its coaches and members; member ->
    its gym and one coach (the lowest coach id, where the reference takes any).
    """
    g = gyms.select(F.col("id").alias("gym_id"), F.col("name").alias("gym_name"))
    c = coaches.select(F.col("id").alias("coach_id"), "gym_id", F.col("name").alias("coach_name"))
    m = members.select(F.col("id").alias("member_id"), "gym_id", F.col("name").alias("member_name"))

    def rows(df, owner_id, owner_type, cid, ctype, cname):
        return df.select(F.col(owner_id).alias("owner_id"), F.lit(owner_type).alias("owner_type"),
                         F.col(cid).alias("contact_id"), F.lit(ctype).alias("contact_type"),
                         F.col(cname).alias("contact_name"))

    coach_gym = rows(c.join(g, "gym_id"), "coach_id", "coach", "gym_id", "gym", "gym_name")
    coach_mem = rows(member_coach.select("coach_id", "member_id").join(m.drop("gym_id"), "member_id"),
                     "coach_id", "coach", "member_id", "member", "member_name")
    gym_coach = rows(c, "gym_id", "gym", "coach_id", "coach", "coach_name")
    gym_mem = rows(m, "gym_id", "gym", "member_id", "member", "member_name")
    mem_gym = rows(m.join(g, "gym_id"), "member_id", "member", "gym_id", "gym", "gym_name")
    first_coach = (member_coach.groupBy("member_id").agg(F.min("coach_id").alias("coach_id"))
                   .join(c.drop("gym_id"), "coach_id"))
    mem_coach = rows(first_coach, "member_id", "member", "coach_id", "coach", "coach_name")
    return (coach_gym.unionByName(coach_mem).unionByName(gym_coach).unionByName(gym_mem)
            .unionByName(mem_gym).unionByName(mem_coach))


RUN = 10_000  # messages of a conversation that stay in one task


def messages_with_sender(messages: DataFrame, all_parties: DataFrame) -> DataFrame:
    """Sender name through one join on (id, type) against the unioned parties."""
    u = all_parties.select(F.col("user_id").alias("sender_id"), F.col("user_type").alias("sender_type"),
                           F.col("name").alias("sender_name"))
    return messages.join(u, ["sender_id", "sender_type"], "left")


def conversation_key(df: DataFrame) -> DataFrame:
    """Canonical pair key, identical for both directions."""
    a = party("sender_type", "sender_id")
    b = party("receiver_type", "receiver_id")
    return df.withColumn("conversation_key", F.concat(F.least(a, b), F.lit("|"), F.greatest(a, b)))


def conversations(messages: DataFrame, all_parties: DataFrame) -> DataFrame:
    """Messages with sender names and their conversation key, in time order within
    each conversation (runs of ``RUN`` messages are kept together, so a busy pair is
    spread over tasks; there is no global sort)."""
    return (conversation_key(messages_with_sender(messages, all_parties))
            .select("conversation_key", "seq", "id", "sender_type", "sender_id", "sender_name",
                    "receiver_type", "receiver_id", "message")
            .repartition("conversation_key", F.floor(F.col("seq") / RUN))
            .sortWithinPartitions("conversation_key", "seq", "id"))


def conversation_summary(messages: DataFrame) -> DataFrame:
    """X21 summary: messages and first/last position per conversation."""
    return (conversation_key(messages).groupBy("conversation_key")
            .agg(F.count(F.lit(1)).alias("messages"), F.min("seq").alias("first_seq"),
                 F.max("seq").alias("last_seq"),
                 F.max(F.length("message")).alias("longest_message")))


def validate_messages(batch: DataFrame, contacts: DataFrame) -> DataFrame:
    """A message is sent only with a non-blank body of at most 1000 characters
    to one of the sender's contacts (semi join with U1); else a reason."""
    ok = (contacts.select(F.col("owner_id").alias("sender_id"), F.col("owner_type").alias("sender_type"),
                          F.col("contact_id").alias("receiver_id"),
                          F.col("contact_type").alias("receiver_type"))
          .distinct().withColumn("_contact", F.lit(True)))
    r = batch.join(ok, ["sender_id", "sender_type", "receiver_id", "receiver_type"], "left")
    n = F.coalesce(F.length(strip("message")), F.lit(0))
    reason = (F.when(n == 0, F.lit(MESSAGE_REASONS["empty"]))
              .when(n > MAX_MESSAGE_CHARS, F.lit(MESSAGE_REASONS["long"]))
              .when(F.col("_contact").isNull(), F.lit(MESSAGE_REASONS["contact"])))
    return r.select("id", "sender_type", "sender_id", "receiver_type", "receiver_id",
                    valid_message("message").alias("valid_body"),
                    reason.isNull().alias("accepted"), reason.alias("reason"))
