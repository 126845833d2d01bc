"""Schemas and fixed values of the memory store."""

from __future__ import annotations

#: Columns of `memories`.
MEMORIES = "id long, content string, l0_content string, l1_content string, namespace string, type string, importance double, source string, tags array<string>, metadata string, created_at timestamp, updated_at timestamp, accessed_at timestamp, access_count long"

#: Typed metadata by memory type; stored as JSON text and read with from_json.
METADATA = {
    "general": "project string, confidence double, supersedes string, supersededIds array<string>, expiresAt string, files array<string>, urls array<string>, commits array<string>, deployed boolean, isSummary boolean, exchangeCount int",
    "belief": "confidence double, domain string, holder string, status string, evidence_for array<string>, evidence_against array<string>, last_challenged timestamp, times_confirmed int, times_refuted int, stated_confidence double, revealed_confidence double, gap double, history array<struct<date:timestamp,confidence:double,reason:string>>",
    "prediction": "confidence double, holder string, deadline date, domain string, status string, resolution string, resolved_at timestamp",
    "behavior": "holder string, relatedBeliefs array<string>",
    "attention": "holder string, topics array<string>, durationMinutes double, timestamp timestamp",
    "follow-up": "holder string, source string, status string, created_from string, resolution string, resolved_at timestamp",
}

# Memory types, their default importance and their boost in the hybrid score.
TYPES = "episodic semantic procedural decision lesson fact preference project-state person session belief reflection shadow prediction behavior follow-up attention".split()
TOOL_TYPES = TYPES[:9]
DEFAULT_IMPORTANCE = {
    "belief": 0.8, "reflection": 0.8, "shadow": 0.8, "prediction": 0.8,
    "decision": 0.7, "lesson": 0.7, "episodic": 0.7, "follow-up": 0.7,
    "semantic": 0.5, "fact": 0.5, "procedural": 0.5, "project-state": 0.5, "person": 0.5, "preference": 0.5, "behavior": 0.5,
    "session": 0.3, "attention": 0.3,
}
TYPE_BOOSTS = {
    "decision": 1.0, "lesson": 1.0, "prediction": 0.95, "belief": 0.9, "follow-up": 0.85,
    "reflection": 0.8, "shadow": 0.8, "fact": 0.8, "preference": 0.7, "session": 0.65, "behavior": 0.6,
    "episodic": 0.5, "semantic": 0.5, "procedural": 0.5, "project-state": 0.5, "person": 0.5, "attention": 0.3,
}
#: Weights of vector, text, recency, importance, access and type in the hybrid score, and the decay constant of half-lives.
WEIGHTS = (0.35, 0.3, 0.15, 0.1, 0.05, 0.05)
DECAY = 0.693
