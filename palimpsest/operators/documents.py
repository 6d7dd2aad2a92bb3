"""Documents as blocks and topic trees.

Blocks: each trimmed line that is not blank is an atom, but neighbouring table rows (lines that start with ``|``) and
neighbouring list items (``-`` or ``*`` and white space) make one. A tree is rows (doc_id, path, refs, ...), where path is
the array of child places from the root; sorting by path is a walk in depth-first order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HEADING = r"^#{2,5}\s+"
SEPARATOR = r"^[-*=]{3,}$"


def _kind(line: Column) -> Column:
    return F.when(F.startswith(line, F.lit("|")), "table").when(line.rlike(r"^[-*]\s"), "list").otherwise("line")


def lines(docs: DataFrame) -> DataFrame:
    """doc_id, line_no, line (trimmed), kind; blank lines are absent, but their numbers are not."""
    split = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_no", "raw"))
    return split.select("doc_id", "line_no", F.btrim("raw", F.lit(" \t\r\x0b\x0c")).alias("line")).filter(F.col("line") != "").withColumn("kind", _kind(F.col("line")))


#: Lines between which everything is one block.
MARKS = ("TABLE_START", "TABLE_END")


def atoms(docs: DataFrame) -> DataFrame:
    """doc_id, atom_id (dense, from 0), text, n_lines.

    Islands: a line joins the one before if both are of one kind and no blank line lies between. Lines between two marks are one
    block, blank lines left out; a mark opens only outside of a block and closes only inside; an open block ends with its text.
    """
    w = Window.partitionBy("doc_id").orderBy("line_no")
    before, upto = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(Window.unboundedPreceding, 0)
    mark = F.when(F.col("line").isin(*MARKS), F.col("line"))
    held = lines(docs).withColumn("_inside", F.coalesce(F.last(mark, ignorenulls=True).over(before) == MARKS[0], F.lit(False)))
    opens, closes = (F.col("line") == MARKS[0]) & ~F.col("_inside"), (F.col("line") == MARKS[1]) & F.col("_inside")
    held = held.withColumn("_block", F.when(F.col("_inside"), F.sum(opens.cast("int")).over(upto))).filter(~opens & ~closes)
    held = held.withColumn("kind", F.when(F.col("_inside"), F.lit("marked")).otherwise(F.col("kind")))
    apart = F.when(F.col("_inside"), ~F.lag("_block").over(w).eqNullSafe(F.col("_block"))).otherwise((F.col("kind") == "line") | (F.lag("line_no").over(w) != F.col("line_no") - 1))
    new = apart | (F.lag("kind").over(w) != F.col("kind")) | F.lag("kind").over(w).isNull()
    marked = held.withColumn("atom_id", F.sum(new.cast("int")).over(upto) - 1)
    by = marked.groupBy("doc_id", "atom_id").agg(F.sort_array(F.collect_list(F.struct("line_no", "line"))).alias("ls"))
    return by.select("doc_id", "atom_id", F.array_join(F.transform("ls", lambda x: x["line"]), "\n").alias("text"), F.size("ls").cast("bigint").alias("n_lines"))


def flatten(nodes: DataFrame) -> DataFrame:
    """doc_id, topic_index, depth, parent_index, n_children, path: nodes numbered in depth-first order from 0.

    The parent is the node whose path is one shorter; -1 for a root. Paths compare place by place, so no recursion is needed.
    """
    numbered = nodes.withColumn("topic_index", (F.row_number().over(Window.partitionBy("doc_id").orderBy("path")) - 1).cast("bigint"))
    up = numbered.select("doc_id", F.col("path").alias("_up"), F.col("topic_index").alias("parent_index"))
    joined = numbered.withColumn("_up", F.slice("path", 1, F.greatest(F.size("path") - 1, F.lit(0)))).join(up, ["doc_id", "_up"], "left")
    kids = joined.groupBy("doc_id", "parent_index").agg(F.count(F.lit(1)).alias("n_children")).select("doc_id", F.col("parent_index").alias("topic_index"), "n_children")
    out = joined.join(kids, ["doc_id", "topic_index"], "left")
    return out.select("doc_id", "topic_index", F.size("path").cast("bigint").alias("depth"), F.coalesce("parent_index", F.lit(-1).cast("bigint")).alias("parent_index"), F.coalesce("n_children", F.lit(0).cast("bigint")).alias("n_children"), "path", "refs")


def within_depth(nodes: DataFrame, depth: int = 5) -> DataFrame:
    """Nodes whose path is of ``depth`` places at most; deeper ones go with all below them."""
    return nodes.filter(F.size("path") <= depth)


def own_refs(flat: DataFrame) -> DataFrame:
    """doc_id, topic_index, ref: a node's references less those that a descendant has. A reference stays where the path is longest."""
    held = flat.select("doc_id", "topic_index", "path", F.explode("refs").alias("ref"))
    below = held.select(F.col("doc_id").alias("d"), F.col("path").alias("p"), F.col("ref").alias("r"))
    inside = (F.col("doc_id") == F.col("d")) & (F.col("ref") == F.col("r")) & (F.size("p") > F.size("path")) & (F.slice(F.col("p"), F.lit(1), F.size("path")) == F.col("path"))
    return held.join(below, inside, "left_anti").select("doc_id", "topic_index", "ref").distinct()


def uncovered(atoms_: DataFrame, flat: DataFrame) -> DataFrame:
    """doc_id, atom_id of atoms that no node refers to and that are no separators."""
    claimed = flat.select("doc_id", F.explode("refs").alias("atom_id")).distinct()
    return atoms_.filter(~F.col("text").rlike(SEPARATOR)).join(claimed, ["doc_id", "atom_id"], "left_anti").select("doc_id", "atom_id")


def content(flat: DataFrame, atoms_: DataFrame) -> DataFrame:
    """doc_id, topic_index, content: the referenced atoms in the order of references, joined by newline; missing ones skipped."""
    held = flat.select("doc_id", "topic_index", F.posexplode("refs").alias("i", "atom_id")).join(atoms_.select("doc_id", "atom_id", "text"), ["doc_id", "atom_id"])
    by = held.groupBy("doc_id", "topic_index").agg(F.sort_array(F.collect_list(F.struct("i", "text"))).alias("t"))
    return by.select("doc_id", "topic_index", F.array_join(F.transform("t", lambda x: x["text"]), "\n").alias("content"))


def unsplit(flat: DataFrame, atoms_: DataFrame, headings: int = 2, chars: int = 2000, per_heading: int = 500, heading: str = HEADING) -> DataFrame:
    """doc_id, topic_index, n_headings, n_chars of leaves that hold several long sections."""
    held = flat.filter("n_children = 0").select("doc_id", "topic_index", F.explode("refs").alias("atom_id")).join(atoms_.select("doc_id", "atom_id", "text"), ["doc_id", "atom_id"])
    by = held.groupBy("doc_id", "topic_index").agg(F.count_if(F.col("text").rlike(heading)).alias("n_headings"), F.sum(F.length("text")).cast("bigint").alias("n_chars"))
    return by.filter((F.col("n_headings") >= headings) & (F.col("n_chars") >= chars) & (F.col("n_chars") / F.col("n_headings") >= per_heading))


def collapse(tree: dict) -> dict:
    """Simplify a nested topic {topic, refs, children} from the bottom up.

    Children whose distinct references are fewer than they are get absorbed (references united and sorted); an only child
    takes its parent's place if the parent has one reference at most.
    """
    children = [collapse(c) for c in tree.get("children", [])]
    refs = list(tree.get("refs", []))
    if children and len({r for c in children for r in _all_refs(c)}) < len(children):
        refs = sorted({*refs, *(r for c in children for r in _all_refs(c))})
        children = []
    if len(children) == 1 and len(refs) <= 1:
        return children[0]
    return {**tree, "refs": refs, "children": children}


def _all_refs(tree: dict) -> list[int]:
    return [*tree.get("refs", []), *(r for c in tree.get("children", []) for r in _all_refs(c))]


def limited(tree: dict, depth: int = 5) -> dict:
    """The tree without nodes deeper than ``depth``; the root's children have depth 1."""
    kept = [limited(c, depth - 1) for c in tree.get("children", [])] if depth > 0 else []
    return {**tree, "children": kept}


def merged_topics(topics: list[dict], groups: list[list[int]]) -> tuple[list[dict], dict[int, int]]:
    """(surviving topics, old index to survivor): each group unites into its smallest index; a later group overrides the map."""
    survivor: dict[int, int] = {}
    for g in groups:
        valid = [i for i in dict.fromkeys(g) if 0 <= i < len(topics)]
        if len(valid) >= 2:
            for i in valid:
                survivor[i] = min(valid)
    out = {}
    for i, t in enumerate(topics):
        to = survivor.get(i, i)
        held = out.setdefault(to, {**topics[to], "refs": [], "labels": []})
        held["refs"] = list(dict.fromkeys([*held["refs"], *t.get("refs", [])]))
        held["labels"] = list(dict.fromkeys([*held["labels"], *t.get("labels", [])]))
    return [out[k] for k in sorted(out)], {i: survivor.get(i, i) for i in range(len(topics))}
