"""Types and constants of the event model."""

from __future__ import annotations

#: An event as the views compute on it. Node numbers are unsigned 32 bit, hence bigint.
TAG = "struct<label: string, node: bigint, address: bigint, amount: bigint>"
EVENT = f"id bigint, pubkey bigint, kind int, created_at bigint, tags array<{TAG}>"
#: An event as it comes from a source; change records add op and lsn.
RAW = "id binary, pubkey binary, created_at bigint, kind int, tags string, content string, sig binary"
CHANGE = f"{RAW}, op string, lsn bigint"

#: Tag labels by their place in index order.
LABELS = {name: place for place, name in enumerate("RootReply Reply Mention Pubkey PubkeyUpper Quote QuoteAddress Address Topic Bolt11 DTag".split())}

PROFILE, NOTE, FOLLOWS, REPOST, REACTION = 0, 1, 3, 6, 7
COMMENT, REPORT, ZAP, ARTICLE = 1111, 1984, 9735, 30023
USER_CARD, EVENT_CARD, RANKED_LIST = 30382, 30383, 30392
#: The kinds that the views read.
CONSUMED = frozenset({NOTE, FOLLOWS, REPOST, REACTION, COMMENT, REPORT, ZAP, ARTICLE, USER_CARD, EVENT_CARD, RANKED_LIST})

PAGERANK_ITERATIONS = 30
TOP = 500
QUERY_LIMIT = 500
