"""Registered queries: contacts, senders, conversations and message checks."""

from __future__ import annotations

from gymlake.operators import messages as ms
from gymlake.plans.catalog import register
from gymlake.plans.sqltext import q

_CONTACTS = """
contacts AS (
  SELECT c.id AS owner_id, 'coach' AS owner_type, g.id AS contact_id, 'gym' AS contact_type,
         g.name AS contact_name FROM coaches c JOIN gyms g ON g.id = c.gym_id
  UNION ALL SELECT mc.coach_id, 'coach', m.id, 'member', m.name
            FROM member_coach mc JOIN members m ON m.id = mc.member_id
  UNION ALL SELECT c.gym_id, 'gym', c.id, 'coach', c.name FROM coaches c
  UNION ALL SELECT m.gym_id, 'gym', m.id, 'member', m.name FROM members m
  UNION ALL SELECT m.id, 'member', g.id, 'gym', g.name FROM members m JOIN gyms g ON g.id = m.gym_id
  UNION ALL SELECT f.member_id, 'member', c.id, 'coach', c.name
            FROM (SELECT member_id, min(coach_id) AS coach_id FROM member_coach GROUP BY member_id) f
            JOIN coaches c ON c.id = f.coach_id)"""

_PARTIES = """
parties AS (
  SELECT id AS user_id, 'gym' AS user_type, name FROM gyms
  UNION ALL SELECT id, 'coach', name FROM coaches
  UNION ALL SELECT id, 'member', name FROM members)"""

_KEY = ("least(sender_type || ':' || CAST(sender_id AS VARCHAR), receiver_type || ':' || "
        "CAST(receiver_id AS VARCHAR)) || '|' || greatest(sender_type || ':' || CAST(sender_id AS VARCHAR), "
        "receiver_type || ':' || CAST(receiver_id AS VARCHAR))")


def _parties(t):
    return ms.users(t.gyms, t.coaches, t.members)


@register("message_contacts", f"""
WITH {_CONTACTS}
SELECT * FROM contacts
""", ["gyms", "coaches", "members", "member_coach"], "U1 J7 W3")
def _message_contacts(t):
    return ms.message_contacts(t.gyms, t.coaches, t.members, t.member_coach)


@register("conversations", f"""
WITH {_PARTIES}
SELECT {_KEY} AS conversation_key, m.seq, m.id, m.sender_type, m.sender_id, p.name AS sender_name,
       m.receiver_type, m.receiver_id, m.message
FROM messages m LEFT JOIN parties p ON p.user_id = m.sender_id AND p.user_type = m.sender_type
""", ["messages", "gyms", "coaches", "members"], "X21 J14 J15")
def _conversations(t):
    return ms.conversations(t.messages, _parties(t))


@register("conversation_summary", f"""
SELECT {_KEY} AS conversation_key, COUNT(*) AS messages, min(seq) AS first_seq, max(seq) AS last_seq,
       CAST(max(length(message)) AS INTEGER) AS longest_message
FROM messages GROUP BY 1
""", ["messages"], "X21 J15")
def _conversation_summary(t):
    return ms.conversation_summary(t.messages)


@register("validate_messages", f"""
WITH {_CONTACTS},
ok AS (SELECT DISTINCT owner_id, owner_type, contact_id, contact_type FROM contacts),
b AS (SELECT m.*, length(regexp_replace(m.message, '^\\s+|\\s+$', '', 'g')) AS n,
             EXISTS (SELECT 1 FROM ok WHERE ok.owner_id = m.sender_id AND ok.owner_type = m.sender_type
                     AND ok.contact_id = m.receiver_id AND ok.contact_type = m.receiver_type) AS has_contact
      FROM messages m)
SELECT id, sender_type, sender_id, receiver_type, receiver_id,
       COALESCE(n > 0 AND n <= 1000, false) AS valid_body,
       CASE WHEN COALESCE(n, 0) = 0 THEN {q(ms.MESSAGE_REASONS['empty'])}
            WHEN n > 1000 THEN {q(ms.MESSAGE_REASONS['long'])}
            WHEN NOT has_contact THEN {q(ms.MESSAGE_REASONS['contact'])} END AS reason,
       CASE WHEN COALESCE(n, 0) = 0 OR n > 1000 OR NOT has_contact THEN false ELSE true END AS accepted
FROM b
""", ["messages", "gyms", "coaches", "members", "member_coach"], "X22 F6 U1")
def _validate_messages(t):
    c = ms.message_contacts(t.gyms, t.coaches, t.members, t.member_coach)
    return ms.validate_messages(t.messages, c)
