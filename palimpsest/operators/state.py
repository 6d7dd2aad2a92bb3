"""Sequential state per key, each as one pure function (state, row) -> (state, output), and its batch form.

The same functions run in batches here (``applyInPandas`` by key, rows in order) and over streams in ``streaming``.
States are plain dicts of JSON values.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from palimpsest.functions.text import ACCOUNT_NUMBER, bigram_overlap, change_ratio, fold_text
from palimpsest.functions.time import DAY_MS

#: The pandas types of columns without rows.
EMPTY = {"bigint": "int64", "int": "int32", "double": "float64", "boolean": "bool", "string": "object"}
ACCOUNT = re.compile(ACCOUNT_NUMBER)
Step = Callable[[dict, dict], tuple[dict, list[dict]]]


def fold_groups(df: DataFrame, key: str, order: list[str], step: Step, schema: str, finish: Callable[[dict], list[dict]] | None = None) -> DataFrame:
    """Run ``step`` over each key's rows in order; outputs are rows of ``schema``.

    A key is one task's work, by nature, but its rows come in batches: only its state is held, not its history.
    """
    kinds = dict(f.split() for f in schema.split(", "))

    def framed(out: list[dict]) -> pd.DataFrame:
        if not out:
            return pd.DataFrame({n: pd.Series([], dtype=EMPTY[k]) for n, k in kinds.items()})
        return pd.DataFrame({n: [r[n] for r in out] for n in kinds}, columns=list(kinds))

    def run(frames):
        open_, state = False, {}
        for frame in frames:
            out: list[dict] = []
            for row in frame.to_dict("records"):
                own = None if pd.isna(row[key]) else row[key]
                if open_ and own != now:
                    out += finish(state) if finish is not None else []
                    state = {}
                open_, now = True, own
                state, rows = step(state, row)
                out += rows
            yield framed(out)
        if open_ and finish is not None:
            yield framed(finish(state))

    return df.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema)


# Boundaries: one message at a time.


def boundary_step(state: dict, row: dict, messages: int = 50, tokens: int = 8192, bridge_over: int = 5) -> tuple[dict, list[dict]]:
    """Close a segment by a hard limit that the held messages reach with the new one, or by the model's reply in ``row['should_end']``.

    With fewer than two messages held nothing closes. A segment of more than ``bridge_over`` messages that closes, for
    either cause, carries its last one into the next segment. Outputs are the segments that closed, as [start, end).
    """
    held = state.get("n", 0)
    start, size, last = state.get("start", 0), state.get("tokens", 0), state.get("last", 0)
    pos, own = int(row["pos"]), int(row["n_tokens"])
    out = []
    if held >= 2:
        limit = held + 1 >= messages or size + own >= tokens
        if limit or bool(row.get("should_end")):
            bridge = held > bridge_over
            out.append({"conv_id": row["conv_id"], "start_pos": start, "end_pos": pos, "cause": "limit" if limit else "reply"})
            start, held, size = (pos - 1, 1, last) if bridge else (pos, 0, 0)
    if held == 0:
        start = pos
    return {"n": held + 1, "start": start, "tokens": size + own, "last": own, "conv_id": int(row["conv_id"]), "end": pos + 1}, out


def boundary_finish(state: dict) -> list[dict]:
    """The open tail, closed at the end of a conversation."""
    return [{"conv_id": state["conv_id"], "start_pos": state["start"], "end_pos": state["end"], "cause": "end"}] if state.get("n") else []


BOUNDARY_SCHEMA = "conv_id bigint, start_pos bigint, end_pos bigint, cause string"


def boundaries(items: DataFrame, **limits) -> DataFrame:
    """items: conv_id, pos, n_tokens, should_end."""
    return fold_groups(items, "conv_id", ["pos"], lambda s, r: boundary_step(s, r, **limits), BOUNDARY_SCHEMA, boundary_finish)


# Clusters by geometry and time.


def _cosine(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    return c @ v / ((np.linalg.norm(v) + 1e-9) * (np.linalg.norm(c, axis=1) + 1e-9))


def cluster_step(state: dict, row: dict, threshold: float = 0.65, days: float = 7.0) -> tuple[dict, list[dict]]:
    """Assign a vector to the most similar cluster within the time window, or open one. First of equals wins.

    A merge weighs centroids by count and keeps the latest time. Similarities are rounded to nine digits, so equal ones tie.
    """
    clusters = state.setdefault("clusters", [])
    v, t = np.asarray(row["vec"], np.float64), int(row["ts"])
    near = [i for i, c in enumerate(clusters) if abs(t - c["last_ts"]) <= int(days * DAY_MS) and len(c["centroid"]) == len(v)]
    best, score = None, None
    if near:
        scores = np.round(_cosine(v, np.array([clusters[i]["centroid"] for i in near])), 9)
        k = int(np.argmax(scores))
        best, score = near[k], float(scores[k])
    if best is None or score < threshold:
        clusters.append({"centroid": v.tolist(), "count": 1, "last_ts": t, "members": [int(row["id"])], "preview": [int(row["id"])]})
        best, score = len(clusters) - 1, None
    else:
        c = clusters[best]
        c["centroid"] = ((np.asarray(c["centroid"]) * c["count"] + v) / (c["count"] + 1)).tolist()
        c["count"], c["last_ts"] = c["count"] + 1, max(c["last_ts"], t)
        c["members"].append(int(row["id"]))
        c["preview"] = [*c["preview"], int(row["id"])][-5:]
    return state, [{"key": row["key"], "id": row["id"], "cluster_id": f"cluster_{best}", "similarity": None if score is None else round(score, 6)}]


CLUSTER_SCHEMA = "key bigint, id bigint, cluster_id string, similarity double"


def clusters(vectors: DataFrame, threshold: float = 0.65, days: float = 7.0) -> DataFrame:
    """vectors: key, id, ts, vec."""
    return fold_groups(vectors, "key", ["ts", "id"], lambda s, r: cluster_step(s, r, threshold, days), CLUSTER_SCHEMA)


# Profiles: operations on items, with evidence that may come late.


def identity(description: str | None) -> str | None:
    folded = fold_text(description or "")
    return folded or None


#: The two kinds of items and the field that names their group.
BUCKETS = {"explicit_info": "category", "implicit_traits": "trait"}
_STOPS = ".!?。！？"


def description_change(old: str, new: str | None, stale: bool) -> str:
    """``kept``; ``history`` if a batch older than the item adds an earlier value in brackets; else ``rewrite``."""
    was, now = identity(old), identity(new)
    if now is None or now == was:
        return "kept"
    stem = (was or "").rstrip(_STOPS)
    appends = bool(stem) and now.startswith(stem) and now[len(stem) :].lstrip().startswith(("(", "（"))
    return "history" if stale and appends else "rewrite"


def _scrubbed(op: dict) -> dict | None:
    """The fields that an operation sets, account numbers masked in the grounding; None if the description holds one."""
    if ACCOUNT.search(op["description"] or ""):
        return None
    grounding = op["grounding"]
    given = {"description": op["description"], "label": op.get("label"), "grounding": ACCOUNT.sub("***", grounding) if grounding else grounding}
    return {k: v for k, v in given.items() if v is not None}


def profile_step(state: dict, row: dict, new_traits: bool = False) -> tuple[dict, list[dict]]:
    """Apply one batch of operations (``row['ops']``: action, type, index, description, label, grounding) observed at ``row['ts']``.

    Indexes mean the bucket's items as they were before the batch. A delete beats updates of the same index; updates of one
    index add up. Evidence older than an item may neither delete nor rewrite it; it may add grounding, or append history to
    the description. Adds go to the end, their label spelled as on file, unless their folded description is there already;
    traits are added only with ``new_traits``. An operation without a known bucket or action is refused, ``none`` is
    passed over, and what holds an account number in its description is dropped.
    """
    ts = int(row["ts"])
    held = {b: [dict(i) for i in state.get("items", {}).get(b, [])] for b in BUCKETS}
    updates, gone, adds = ({b: kind() for b in BUCKETS} for kind in (dict, set, list))
    counts = dict.fromkeys(("added", "updated", "deleted", "refused", "rewrote", "history"), 0)

    def queue(op: dict) -> bool:
        bucket = op.get("type", "explicit_info")
        if bucket not in BUCKETS:
            return False
        items = held[bucket]
        if op["action"] == "add":
            if identity(op["description"]) is None or (bucket == "implicit_traits" and not new_traits):
                return False
            label = op.get("label")
            same = [i["label"] for i in items if label and i.get("label") and fold_text(i["label"]) == fold_text(label)]
            adds[bucket].append({**op, "label": same[0] if same else label})
            return True
        i = op["index"]
        if op["action"] not in ("update", "delete") or i is None or i != i or not 0 <= int(i) < len(items):
            return False
        i = int(i)
        stale = ts < items[i]["observed_at"]
        if op["action"] == "delete":
            gone[bucket] |= set() if stale else {i}
            return not stale
        patch = _scrubbed(op)
        if patch is None or (stale and description_change(items[i]["description"], patch.get("description"), stale) == "rewrite"):
            return False
        updates[bucket][i] = {**updates[bucket].get(i, {}), **patch}
        return True

    for op in row["ops"] if row["ops"] is not None else []:
        if op is not None and op["action"] != "none" and not queue(dict(op)):
            counts["refused"] += 1
    now = {}
    for bucket, items in held.items():
        counts["refused"] += len(updates[bucket].keys() & gone[bucket])
        for i in updates[bucket].keys() - gone[bucket]:
            patch = updates[bucket][i]
            change = description_change(items[i]["description"], patch.get("description"), ts < items[i]["observed_at"])
            items[i] = {**items[i], **patch, **({"observed_at": ts} if change == "rewrite" else {})}
            counts["updated"] += 1
            counts["rewrote"] += change == "rewrite"
            counts["history"] += change == "history"
        counts["deleted"] += len(gone[bucket])
        new = [{"label": None, "grounding": "", **fields, "observed_at": ts} for fields in map(_scrubbed, adds[bucket]) if fields is not None]
        counts["added"] += len(new)
        seen, now[bucket] = set(), []
        for x in [*(x for i, x in enumerate(items) if i not in gone[bucket]), *new]:
            name = identity(x["description"])
            if name is None or name not in seen:
                now[bucket].append(x)
                seen.add(name)
    summary = next((x["description"] for x in now["explicit_info"] if x["description"].strip()), "")
    out = {"owner_id": row["owner_id"], "ts": ts, **counts, "n_items": sum(map(len, now.values())), "summary": summary}
    return {"items": now, "ts": max(state.get("ts", 0), ts)}, [out]


PROFILE_SCHEMA = "owner_id string, ts bigint, added int, updated int, deleted int, refused int, rewrote int, history int, n_items int, summary string"


def profiles(batches: DataFrame) -> DataFrame:
    """batches: owner_id, arrival, ts, ops; in order of arrival, which may differ from that of ts."""
    return fold_groups(batches, "owner_id", ["arrival"], profile_step, PROFILE_SCHEMA)


def pending_step(state: dict, row: dict, least: float = 0.6, ttl_days: int = 120, most: int = 30) -> tuple[dict, list[dict]]:
    """Hold a candidate pattern until it is seen again: an overlap of ``least`` with a held one confirms and removes it.

    Held patterns expire by the time of the batch, and only the newest ``most`` are held.
    """
    ts, text = int(row["ts"]), row["text"] or ""
    held = [h for h in state.get("held", []) if ts - h["observed_at"] <= ttl_days * DAY_MS]
    match = next((i for i, h in enumerate(held) if bigram_overlap(h["text"], text) >= least), None)
    verdict = "held"
    if match is not None:
        held.pop(match)
        verdict = "confirmed"
    else:
        held.append({"text": text, "observed_at": ts})
    held = held[-most:]
    return {"held": held}, [{"owner_id": row["owner_id"], "ts": ts, "verdict": verdict, "n_held": len(held)}]


PENDING_SCHEMA = "owner_id string, ts bigint, verdict string, n_held int"


def pending(rows: DataFrame) -> DataFrame:
    """rows: owner_id, ts, seq, text."""
    return fold_groups(rows, "owner_id", ["ts", "seq"], pending_step, PENDING_SCHEMA)


def matter_step(state: dict, row: dict) -> tuple[dict, list[dict]]:
    """Topics not to be recorded: entering refreshes the date, a withdrawal counts only if it is strictly later."""
    topics = dict(state.get("topics", {}))
    name, ts = identity(row["topic"]), int(row["ts"])
    action = "ignored"
    if name is not None and row["action"] == "enter":
        action = "refreshed" if name in topics else "entered"
        topics[name] = max(ts, topics.get(name, ts))
    elif name is not None and row["action"] == "withdraw" and name in topics and ts > topics[name]:
        del topics[name]
        action = "withdrawn"
    return {"topics": topics}, [{"owner_id": row["owner_id"], "ts": ts, "action": action, "n_topics": len(topics)}]


MATTER_SCHEMA = "owner_id string, ts bigint, action string, n_topics int"


def matters(rows: DataFrame) -> DataFrame:
    return fold_groups(rows, "owner_id", ["ts", "seq"], matter_step, MATTER_SCHEMA)


# Skills.


def skill_step(state: dict, row: dict, retire: float = 0.1, minor: float = 0.2, major: float = 0.4, mature: float = 0.6) -> tuple[dict, list[dict]]:
    """Apply one operation (add or update of a skill by index) with the bands that decide whether maturity is scored anew.

    Confidence under ``retire`` retires a skill: only that and its sources change. Small changes keep maturity, large ones
    and promotions score it again; in between mature skills keep it unless confidence drops, and immature ones keep it for weak sources.
    """
    skills = [dict(s) for s in state.get("skills", [])]
    confidence = min(max(float(row["confidence"]), 0.0), 1.0)
    outcome = "rejected"
    if row["action"] == "add":
        if (row["content"] or "").strip():
            skills.append({"content": row["content"], "confidence": confidence, "maturity": float(row["maturity"]), "sources": [row["source_id"]]})
            outcome = "added"
    elif row["index"] is not None and 0 <= int(row["index"]) < len(skills):
        s = skills[int(row["index"])]
        sources = s["sources"] if row["source_id"] in s["sources"] else [*s["sources"], row["source_id"]]
        if confidence < retire:
            s.update(confidence=confidence, sources=sources)
            outcome = "retired"
        elif row["content"] in (None, s["content"]) and confidence == s["confidence"]:
            outcome = "unchanged"
        else:
            content = row["content"] if row["content"] is not None else s["content"]
            ratio = change_ratio(s["content"], content)
            promoted = s["content"].startswith("# Hypothesis") and not content.startswith("# Hypothesis")
            if promoted or ratio >= major:
                again = True
            elif ratio < minor:
                again = False
            elif s["maturity"] >= mature:
                again = confidence < s["confidence"] and confidence < 0.5
            else:
                again = float(row["quality"]) >= 0.3
            s.update(content=content, sources=sources, maturity=float(row["maturity"]) if again else s["maturity"], confidence=confidence)
            outcome = "rescored" if again else "updated"
    return {"skills": skills}, [{"key": row["key"], "seq": int(row["seq"]), "outcome": outcome, "n_skills": len(skills), "n_retired": sum(s["confidence"] < retire for s in skills)}]


SKILL_SCHEMA = "key bigint, seq bigint, outcome string, n_skills int, n_retired int"


def skills(rows: DataFrame) -> DataFrame:
    """rows: key, seq, action, index, content, confidence, maturity, quality, source_id."""
    return fold_groups(rows, "key", ["seq"], skill_step, SKILL_SCHEMA)


def patch_apply(body: str, old: str | None, new: str, budget: int = 8000) -> tuple[str, str]:
    """(text, verdict): a change needs exactly one place, an addition none; a text over budget characters is left alone."""
    if len(body) > budget:
        return body, "too large"
    if old is None:
        return (body, "present") if new in body else (f"{body.rstrip()}\n{new}\n".lstrip("\n"), "added")
    n = body.count(old)
    return (body.replace(old, new), "changed") if n == 1 else (body, "absent" if n == 0 else "ambiguous")


def dumps(state: dict) -> str:
    return json.dumps(state, separators=(",", ":"))
