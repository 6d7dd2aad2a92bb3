"""Profiles beyond the step function: which pass a narrative belongs to, compaction, merges of topics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.operators.state import identity


def passes(episodes: DataFrame, profiles: DataFrame) -> DataFrame:
    """episodes (owner_id, ts, ...) with ``pass_no``: 0 for those older than the owner's stored profile, 1 for the others.

    Older narratives are worked first, as history; without a stored profile all are current.
    """
    stored = profiles.select("owner_id", F.col("ts").alias("_stored"))
    return episodes.join(stored, "owner_id", "left").withColumn("pass_no", F.when(F.col("ts") < F.col("_stored"), 0).otherwise(1)).drop("_stored")


def needs_care(items: DataFrame, most: int = 60) -> DataFrame:
    """owner_id, n_items of the profiles that are to be compacted."""
    return items.groupBy("owner_id").agg(F.count(F.lit(1)).alias("n_items")).filter(F.col("n_items") > most)


def compact(items: list[dict], ops: list[dict]) -> tuple[list[dict], list[str]]:
    """(items, verdict of each operation): merge, split, move, update and delete on indexed items.

    Indexes mean the items as given; an index serves one operation only, a later claim is refused. Host keys of an item ride
    through; a merge keeps those of its first item, unites grounding, and takes the latest date.
    """
    out: list[list[dict] | None] = [[dict(i)] for i in items]
    claimed: set[int] = set()
    verdicts = []
    for op in ops:
        held = [i for i in dict.fromkeys(op.get("indexes", [])) if isinstance(i, int)]
        kind = op.get("action")
        least = 2 if kind == "merge" else 1
        if len(held) < least or any(not 0 <= i < len(items) or i in claimed for i in held) or (kind != "merge" and len(held) != 1):
            verdicts.append("refused")
            continue
        first = items[held[0]]
        if kind == "merge":
            grounding = list(dict.fromkeys(g for i in held for g in items[i].get("grounding", [])))
            date = max((items[i].get("observed_at") or 0) for i in held)
            out[held[0]] = [{**first, "description": op.get("description") or first["description"], "grounding": grounding, "observed_at": date}]
            for i in held[1:]:
                out[i] = None
        elif kind == "split" and len(op.get("parts") or []) >= 2:
            out[held[0]] = [{**first, "description": p} for p in op["parts"]]
        elif kind == "move" and op.get("label"):
            out[held[0]] = [{**first, "label": op["label"]}]
        elif kind == "update" and op.get("description"):
            out[held[0]] = [{**first, "description": op["description"]}]
        elif kind == "delete":
            out[held[0]] = None
        else:
            verdicts.append("refused")
            continue
        claimed |= set(held)
        verdicts.append("done")
    return [x for group in out if group for x in group], verdicts


def merge_topics(topics: list[dict], ops: list[dict]) -> list[dict]:
    """Topics not to be recorded, after a model's merges: ``same`` unites two, ``inside`` lets the wider one stand.

    A topic is used once; names are compared folded; the later date is kept.
    """
    by = {identity(t["topic"]): dict(t) for t in topics if identity(t["topic"])}
    used: set[str] = set()
    for op in ops:
        keep, gone = identity(op.get("keep")), identity(op.get("drop"))
        if op.get("relation") not in ("same", "inside") or keep == gone or keep not in by or gone not in by or {keep, gone} & used:
            continue
        by[keep]["ts"] = max(by[keep]["ts"], by[gone]["ts"])
        del by[gone]
        used |= {keep, gone}
    return list(by.values())
