"""Chat exports of several shapes as plain transcripts."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Messages = list[tuple[str, str]]
_ROLES = {"user": "user", "human": "user", "assistant": "assistant", "ai": "assistant"}


def content_text(content) -> str:
    """The text of a message's content: a string, a list of strings and text parts, or an object with a text."""
    if isinstance(content, list):
        parts = (c if isinstance(c, str) else c.get("text") if isinstance(c, dict) and c.get("type") == "text" else None for c in content)
        return " ".join(p for p in parts if isinstance(p, str)).strip()
    if isinstance(content, dict):
        content = content.get("text")
    return content.strip() if isinstance(content, str) else ""


def from_jsonl(text: str) -> Messages:
    """One object a line, of type human or assistant; a line that isn't JSON spoils all."""
    out = []
    for line in filter(None, map(str.strip, text.splitlines())):
        entry = json.loads(line)
        role = {"human": "user", "assistant": "assistant"}.get(entry.get("type")) if isinstance(entry, dict) else None
        message = entry.get("message") if role else None
        body = content_text(message.get("content")) if isinstance(message, dict) else ""
        if body:
            out.append((role, body))
    return out


def from_list(data) -> Messages:
    """Messages with role and content: a list, or under messages or chat_messages."""
    if isinstance(data, dict):
        data = next((data[k] for k in ("messages", "chat_messages") if isinstance(data.get(k), list)), None)
    rows = [m for m in data or [] if isinstance(m, dict)]
    out = ((_ROLES.get(m.get("role")), content_text(m.get("content"))) for m in rows)
    return [(r, t) for r, t in out if r and t]


def from_tree(data) -> Messages:
    """The path of first children from the root of a tree of nodes; a root without a message comes first."""
    nodes = data.get("mapping") if isinstance(data, dict) else None
    if not isinstance(nodes, dict):
        return []
    roots = [k for k in sorted(nodes) if nodes[k].get("parent") is None]
    at = next((k for k in roots if nodes[k].get("message") is None), roots[0] if roots else None)
    out, seen = [], set()
    while at in nodes and at not in seen:
        seen.add(at)
        message = nodes[at].get("message") or {}
        role = (message.get("author") or {}).get("role")
        parts = (message.get("content") or {}).get("parts") or []
        body = " ".join(p for p in parts if isinstance(p, str)).strip()
        if role in ("user", "assistant") and body:
            out.append((role, body))
        at = next(iter(nodes[at].get("children") or []), None)
    return out


def from_workspace(data) -> Messages:
    """Messages of a workspace: the first writer is the user, each new one takes the other part than who spoke last."""
    parts: dict[str, str] = {}
    out: Messages = []
    for m in data if isinstance(data, list) else []:
        who = (m.get("user") or m.get("username")) if isinstance(m, dict) and m.get("type") == "message" else None
        body = (m.get("text") or "").strip() if who else ""
        if body:
            part = parts.setdefault(who, "assistant" if out and out[-1][0] == "user" else "user")
            out.append((part, body))
    return out


def transcript(messages: Messages) -> str:
    """Each user message after >, its answer below it, a blank line between."""
    blocks, k = [], 0
    while k < len(messages):
        role, body = messages[k]
        block = [f"> {body}" if role == "user" else body]
        if role == "user" and k + 1 < len(messages) and messages[k + 1][0] == "assistant":
            k += 1
            block.append(messages[k][1])
        blocks.append("\n".join(block))
        k += 1
    return "\n\n".join(blocks).strip()


def normalised(text: str | None) -> str | None:
    """The transcript of a chat export of a known shape with two messages or more; any other text as it is."""
    if not text or not text.strip() or sum(line.lstrip().startswith(">") for line in text.splitlines()) >= 3 or text.strip()[0] not in "{[":
        return text
    try:
        found = from_jsonl(text)
    except (ValueError, AttributeError):
        found = []
    if len(found) >= 2:
        return transcript(found)
    try:
        data = json.loads(text)
    except ValueError:
        return text
    for shape in (from_list, from_tree, from_workspace):
        try:
            found = shape(data)
        except AttributeError:
            continue
        if len(found) >= 2:
            return transcript(found)
    return text


def transcripts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, transcript). A tree is walked and parts depend on those before, so this is made in Arrow batches."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array(map(normalised, batch.column(1).to_pylist()), pa.string())], names=["id", "transcript"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, transcript string")


def joined_messages(messages: DataFrame, id_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """(id, transcript) of messages in rows (role user or assistant, text), in order of their turns."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(turn_col).alias("turn"), "role", "text")))
    rows = messages.where(F.col("role").isin("user", "assistant")).groupBy(F.col(id_col).alias("id")).agg(ordered.alias("m"))
    paired = lambda m, i: (m["role"] == "assistant") & (i > 0) & (F.get(F.col("m"), i - 1)["role"] == "user")
    parts = F.transform("m", lambda m, i: F.concat(F.when(i == 0, "").when(paired(m, i), "\n").otherwise("\n\n"), F.when(m["role"] == "user", F.concat(F.lit("> "), m["text"])).otherwise(m["text"])))
    return rows.select("id", F.array_join(parts, "").alias("transcript"))
