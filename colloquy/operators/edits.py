"""Concurrent edits: compare-and-swap by revision with a history, and merges of several copies of one text."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import state as G
from .sequence import Fold, fold

ACTOR_LENGTH = 200
CONFLICT = "patch_text_merge_conflict"
RUN = 8
_TOKENS = re.compile(r"\s+|\S+")


class Revisions(Fold):
    """Edits of one object in order; the first that knows the current revision wins."""

    def __init__(self) -> None:
        self.revision, self.patch = None, {}

    def row(self, r: dict) -> Iterable[dict]:
        if r["_revision"] is None:
            return ({"edit_id": r["edit_id"], "outcome": "unknown", "revision": None, "patch": None},)
        if self.revision is None:
            self.revision, self.patch = r["_revision"], dict(r["_patch"] or ())
        changes, actor = dict(r["changes"] or ()), (r["actor"] or "").strip()
        if r["expected_revision"] is None or r["expected_revision"] < 0 or not changes or not 0 < len(actor) <= ACTOR_LENGTH:
            outcome = "invalid"
        elif r["expected_revision"] != self.revision:
            outcome = "revision_conflict"
        elif all(k in self.patch and self.patch[k] == v for k, v in changes.items()):
            outcome = "unchanged"
        else:
            outcome, self.patch, self.revision = "applied", {**self.patch, **changes}, self.revision + 1
        return ({"edit_id": r["edit_id"], "outcome": outcome, "revision": self.revision, "patch": list(self.patch.items())},)


def compare_and_swap(current: DataFrame, edits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, edit_id, outcome, revision, patch after it): applied, unchanged, revision_conflict, invalid, or unknown.

    current: keys, revision, patch (map); edits: keys, edit_id, expected_revision, changes (map), actor, edited_at.  An object's edits
    are taken one after another, by edited_at and edit_id; a batch of edits is decided as if each had come alone.
    """
    held = current.select(*keys, F.col("revision").cast("long").alias("_revision"), F.col("patch").alias("_patch"))
    rows = edits.select(*keys, "edit_id", F.col("expected_revision").cast("long").alias("expected_revision"), "changes", "actor", "edited_at").join(held, list(keys), "left")
    kind = edits.schema["edit_id"].dataType.simpleString()
    return fold(rows, keys, ["edited_at", "edit_id"], Revisions, f"edit_id {kind}, outcome string, revision bigint, patch map<string,string>")


def revised(current: DataFrame, outcomes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``current`` after the edits: revision and patch of the last one that was applied."""
    return G.upsert(current.select(*keys, "revision", "patch"), outcomes.where("outcome = 'applied'").select(*keys, "revision", "patch"), keys, ["revision"])


def history(outcomes: DataFrame, edits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A row for each applied edit, to be appended: keys, revision, actor, edited_at, changes."""
    done = outcomes.where("outcome = 'applied'").select(*keys, "edit_id", "revision")
    return done.join(edits, [*keys, "edit_id"]).select(*keys, "revision", F.trim("actor").alias("actor"), "edited_at", "changes")


# ---------------------------------------------------------------- merges


def _edits(base: Sequence[str], variant: Sequence[str]) -> set[tuple[int, int, tuple[str, ...]]]:
    """Stretches of ``base`` and what takes their place."""
    head, tail = _ends(base, variant)
    old, new = base[head : len(base) - tail], variant[head : len(variant) - tail]
    if not old or not new:
        return {(head, head + len(old), tuple(new))} if old or new else set()
    return {(head + a, head + b, tuple(new[c:d])) for tag, a, b, c, d in SequenceMatcher(None, old, new, autojunk=False).get_opcodes() if tag != "equal"}


def _ends(base: Sequence[str], variant: Sequence[str]) -> tuple[int, int]:
    """How many tokens at the start and at the end are equal and sure to be matched with each other by SequenceMatcher too.

    It takes the longest common stretch first, the first of ``base`` on ties.  Where no RUN tokens come twice in ``base``, a stretch that covers
    RUN of an equal end belongs to that end; all others are shorter than the new tokens and RUN - 1 of each end together.
    """
    n, m = len(base), len(variant)
    most = min(n, m)
    head = next((i for i in range(most) if base[i] != variant[i]), most)
    tail = next((i for i in range(most) if base[n - 1 - i] != variant[m - 1 - i]), most)
    if head == n == m:
        return head, 0
    new = max(0, m - head - tail)
    if max(head, tail) <= new + 2 * (RUN - 1) or len(set(zip(*(base[i:] for i in range(RUN)), strict=False))) < n - RUN + 1:
        return 0, 0
    if head >= tail:
        tail = min(tail, most - head)
        return head, tail if tail > new + RUN - 1 else 0
    head = min(head, most - tail)
    return head if head > new + RUN - 1 else 0, tail


def _collide(x: tuple[int, int, tuple], y: tuple[int, int, tuple]) -> bool:
    """Whether two different edits touch: stretches that overlap, insertions at one place, an insertion inside a stretch."""
    (a, b, _), (c, d, _) = sorted((x, y), key=lambda e: (e[0], e[1]))
    if a == b == c == d:
        return True
    return c < b if c < d else a < c < b


def merged(base: str, variants: Sequence[str]) -> str | None:
    """``base`` with the edits of all ``variants``: equal ones once; None where two different ones collide."""
    tokens = _TOKENS.findall(base)
    found = sorted(set().union(*(_edits(tokens, _TOKENS.findall(v)) for v in set(variants))), key=lambda e: (e[0], e[1]))
    reach: list[tuple[int, int, tuple]] = []  # an edit can only collide with those that start before it and end at or after its start
    for e in found:
        reach = [x for x in reach if x[1] >= e[0]]
        if any(_collide(x, e) for x in reach):
            return None
        reach.append(e)
    out, at = [], 0
    for a, b, new in found:
        out += [*tokens[at:a], *new]
        at = b
    return "".join(out + tokens[at:])


def merge_texts(base: Column, variants: Column) -> Column:
    """Text of a base and an array of its edited copies, merged word by word; null where they conflict.  Null copies count for nothing."""

    @F.pandas_udf("string")
    def run(b: pd.Series, v: pd.Series) -> pd.Series:
        return pd.Series([merged(x or "", [y for y in (ys if ys is not None else ()) if y is not None]) for x, ys in zip(b, v, strict=True)], dtype=object)

    return run(base, variants)


def merge_bundles(bases: DataFrame, patches: DataFrame, links: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(merged surfaces, rejected bundles) of patches that come in bundles; a bundle goes in whole or not at all.

    bases: surface_id, text; patches: bundle_id, surface_id, text; links: bundle_id, needs (bundles that another one depends on).
    A surface whose patches conflict, or that doesn't exist, rejects all bundles that touch it, and with them all that are
    connected with those by dependencies.
    """
    per = patches.groupBy("surface_id").agg(F.sort_array(F.collect_set("text")).alias("_v"))
    tried = per.join(bases.withColumnRenamed("text", "_base"), "surface_id", "left").withColumn("text", merge_texts(F.col("_base"), F.col("_v")))
    bad = tried.where("_base is null or text is null").select("surface_id", F.when(F.col("_base").isNull(), "unknown_surface").otherwise(CONFLICT).alias("reason"))
    hit = patches.select("bundle_id", "surface_id").distinct().join(bad, "surface_id").groupBy("bundle_id").agg(F.min("reason").alias("reason"))
    if links is not None:
        known = patches.select("bundle_id").distinct()
        # links whose other end doesn't exist reject their bundle too
        missing = links.join(known.withColumnRenamed("bundle_id", "needs"), "needs", "left_anti").select("bundle_id", F.lit("unknown_dependency").alias("reason"))
        hit = hit.unionByName(missing).groupBy("bundle_id").agg(F.min("reason").alias("reason"))
        group = G.components(links.select(F.col("bundle_id").alias("a"), F.col("needs").alias("b")).where("a <> b"))
        gone = hit.join(group, F.col("bundle_id") == F.col("node")).select("root").distinct()
        dragged = group.join(gone, "root").select(F.col("node").alias("bundle_id"), F.lit("dependency_rejected").alias("_r"))
        both = hit.join(dragged, "bundle_id", "full").select("bundle_id", F.coalesce("reason", "_r").alias("reason"))
        hit = both.join(known, "bundle_id", "left_semi")
    left = patches.join(hit.select("bundle_id"), "bundle_id", "left_anti").groupBy("surface_id").agg(F.sort_array(F.collect_set("text")).alias("_v"))
    out = bases.join(left, "surface_id", "left")
    return out.select("surface_id", F.when(F.col("_v").isNull(), F.col("text")).otherwise(merge_texts(F.col("text"), F.col("_v"))).alias("text"), F.col("_v").isNotNull().alias("changed")), hit
