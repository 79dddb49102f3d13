"""Repair of conversation structure by least-cost edits.

Rows are marked by Spark: blank, duplicate or truncated, in order within their
conversation. A dynamic program over (rows left, role of the last turn) gives
the least cost from every node to the end. The arcs that lie on a least-cost path
are then ranked by their audits, the initials of the edits along them: first by
one edit, then by two, four, eight, each time by the pair (own rank, rank of the
arc that the doubled pointer reaches). The final ranks select the least path,
and the doubled pointers write it out.

A legal conversation is ``(s?(ua)+)?`` by role initials. From a node each edit leads to one
node only, so an arc's least continuation is known from the first ranks on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Costs of the edits; their initials in ASCII order, after the end of an audit.
DELETE, REROLE, INSERT, KEPT_TRUNCATED = 3, 2, 2, 1
LABELS = np.array(["", "D", "I", "K", "R"])
D, I, K, R = 1, 2, 3, 4
#: Last role: none yet, system, user, assistant. A conversation may end with none or assistant.
NONE, SYSTEM, USER, ASSISTANT = range(4)
ROLES = {USER: "user", ASSISTANT: "assistant"}
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
NEVER = 1 << 40

RESULT = ("conv string, n_rows bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, "
          "audit string, repaired_roles array<string>, repaired_texts array<string>")


def damage(rows: DataFrame) -> DataFrame:
    """Rows with known faults, by crc32 of ``conv_id:turn`` % 20: 0 drops, 1 empties the text, 2 removes its ends
    of sentences, 3 repeats the row, 4 makes it the user's. Nulls, in this text too, become one space; a null turn stays null."""
    as_text = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    kind = F.pmod(F.crc32(F.encode(F.concat(as_text[0], F.lit(":"), as_text[1]), "UTF-8")), F.lit(20))
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    hit = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), kind.alias("kind")).filter("kind != 0")
    return (hit.withColumn("text", F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")))
            .withColumn("role", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")))
            .withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
            .select("conv_id", "turn", "role", "text"))


def _fault(nth: Column) -> Column:
    said = F.rtrim(F.col("text"), F.lit(" \t\n\x0b\x0c\r"))
    return (F.when(said == "", BLANK).when(nth > 1, DUPLICATE)
            .when(~F.right(said, F.lit(1)).isin(".", "!", "?"), TRUNCATED).otherwise(0))


def repair(rows: DataFrame) -> DataFrame:
    """One row per conversation of ``rows`` (conv_id, turn, role, text), with its faults and its cheapest repair.

    conv_id, n_rows, gaps, blank, duplicate, truncated, illegal, cost, audit, and the repaired turns as
    repaired_roles and repaired_texts. Rows go by turn, null turns first; equal turns by role and text. Null roles and
    texts are empty, null conv_ids one conversation. A row has its first fault only: blank (white space alone), duplicate (role
    and text seen earlier), truncated (doesn't end in . ! or ?). Further columns are dropped; an empty table gives none.

    One shuffle by conversation; the windows and the order below reuse it. A conversation is the unit of
    work, as its audit is one value; a task holds the whole conversations of one Arrow batch, some 500 bytes a row
    besides its text.
    """
    base = rows.select(
        "conv_id", F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("conv"), F.col("turn").isNotNull().alias("has_turn"),
        F.coalesce(F.col("turn").cast("bigint"), F.lit(0)).alias("turn"),
        *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")]).repartition("conv")
    same = Window.partitionBy("conv", "role", "text").orderBy("has_turn", "turn")
    marked = base.select("conv", "has_turn", "turn", "role", "text", F.row_number().over(same).alias("nth"))
    marked = marked.withColumn("fault", _fault(F.col("nth")))
    done = marked.sortWithinPartitions("conv", "has_turn", "turn", "role", "text", "nth").mapInPandas(_repairs, RESULT)
    conv_type = rows.schema["conv_id"].dataType
    return done.select(F.when(F.col("conv") != "", F.col("conv")).cast(conv_type).alias("conv_id"), *done.columns[1:])


def _repairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Repairs of whole conversations; the last one of a batch waits for the next batch, which may go on with it."""
    held: list[pd.DataFrame] = []
    for b in batches:
        if not len(b):
            continue
        last = b["conv"].iloc[-1]
        ends = int((b["conv"] != last).to_numpy().sum())  # sorted, so the last conversation's rows are a suffix
        if ends or (held and held[-1]["conv"].iloc[-1] != last):
            yield _repair(pd.concat([*held, b.iloc[:ends]], ignore_index=True))
            held = []
        held.append(b.iloc[ends:])
    if held:
        yield _repair(pd.concat(held, ignore_index=True))


def _repair(rows: pd.DataFrame) -> pd.DataFrame:
    conv, turn, fault = rows["conv"].to_numpy(), rows["turn"].to_numpy(), rows["fault"].to_numpy()
    has_turn, roles, texts = rows["has_turn"].to_numpy(), rows["role"].to_list(), rows["text"].to_list()
    first = np.r_[True, conv[1:] != conv[:-1]]
    starts = np.flatnonzero(first)
    number = np.cumsum(first) - 1
    initial = np.array([" sua".find(r[:1]) if r else 0 for r in roles]).clip(0)
    legal = np.isin(initial[:-1] * 4 + initial[1:], [SYSTEM * 4 + USER, USER * 4 + ASSISTANT, ASSISTANT * 4 + USER])
    per_conv = lambda flags: np.add.reduceat(flags.astype(np.int64), starts)
    other = has_turn & (first | np.r_[True, (turn[1:] != turn[:-1]) | ~has_turn[:-1]])
    lowest = np.minimum.reduceat(np.where(has_turn, turn, np.iinfo(np.int64).max), starts)
    highest = np.maximum.reduceat(np.where(has_turn, turn, np.iinfo(np.int64).min), starts)
    known = per_conv(other)

    cost, arcs, path, of = least_audits(initial, fault, starts)
    labels, rows_at, heads = arcs
    audits = np.split(LABELS[labels[path]], np.searchsorted(of, np.arange(1, len(starts))))
    repaired_roles: list[list[str]] = [[] for _ in starts]
    repaired_texts: list[list[str]] = [[] for _ in starts]
    kept = labels[path] != D
    for c, label, row, head in zip(of[kept].tolist(), labels[path][kept].tolist(), rows_at[path][kept].tolist(), heads[path][kept].tolist()):
        repaired_roles[c].append(roles[row] if label == K else ROLES[head])
        repaired_texts[c].append("" if label == I else texts[row])
    return pd.DataFrame({
        "conv": conv[starts], "n_rows": np.bincount(number), "gaps": np.where(known > 0, highest - lowest + 1 - known, 0),
        "blank": per_conv(fault == BLANK), "duplicate": per_conv(fault == DUPLICATE), "truncated": per_conv(fault == TRUNCATED),
        "illegal": per_conv(np.r_[False, ~legal] & ~first), "cost": cost,
        "audit": ["".join(a) for a in audits], "repaired_roles": repaired_roles, "repaired_texts": repaired_texts})


def _to_end(initial: np.ndarray, fault: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Least cost to the end from (conversation, row, last role); a conversation has one node row more than it has rows."""
    n, at_start = len(initial), set(starts.tolist())
    costs = np.empty((n + len(starts), 4), dtype=np.int64)
    at = len(costs) - 1
    end = (0, 2 * INSERT, INSERT, 0)
    costs[at] = none, system, user, assistant = end
    initials, faults = initial.tolist(), fault.tolist()
    for i in range(n - 1, -1, -1):
        if faults[i] in (BLANK, DUPLICATE):
            none, system, user, assistant = none + DELETE, system + DELETE, user + DELETE, assistant + DELETE
        else:
            stays = KEPT_TRUNCATED if faults[i] == TRUNCATED else 0
            to_user = user + stays + (0 if initials[i] == USER else REROLE)
            to_assistant = assistant + stays + (0 if initials[i] == ASSISTANT else REROLE)
            to_system = system + stays if initials[i] == SYSTEM else NEVER
            none, system, user, assistant = (min(none + DELETE, to_user, to_system), min(system + DELETE, to_user),
                                             min(user + DELETE, to_assistant), min(assistant + DELETE, to_user))
        user, assistant = min(user, assistant + INSERT), min(assistant, user + INSERT)
        none, system = min(none, user + INSERT), min(system, user + INSERT)
        at -= 1
        costs[at] = none, system, user, assistant
        if i in at_start and i:
            at -= 1
            costs[at] = none, system, user, assistant = end
    return costs


def least_audits(initial: np.ndarray, fault: np.ndarray, starts: np.ndarray) -> tuple:
    """Costs of conversations, optimal arcs (labels, rows, last roles after them), and the arcs of the
    least paths with the conversation of each. ``starts`` has the first row of each conversation."""
    n, n_convs = len(initial), len(starts)
    to_end = _to_end(initial, fault, starts).ravel()
    number = np.searchsorted(starts, np.arange(n), side="right") - 1
    row_node = (np.arange(n) + number)[:, None] * 4 + np.arange(4)  # node of (row, last role)
    last = np.arange(4)
    stays = (fault == TRUNCATED) * KEPT_TRUNCATED
    whole = ~np.isin(fault, (BLANK, DUPLICATE))
    follows = np.where(last == USER, ASSISTANT, USER)
    found = []  # (tail, label, row, last role after, head)

    def add(tail: np.ndarray, label: int, row: np.ndarray, role: np.ndarray, head: np.ndarray, cost: np.ndarray | int, may: np.ndarray | bool) -> None:
        best = (to_end[tail] == cost + to_end[head]) & may
        found.append([np.broadcast_to(x, tail.shape)[best] for x in (tail, label, row, role, head)])

    below, rows = row_node + 4 - last, np.arange(n)[:, None]  # below: node of (row + 1, none)
    add(row_node, D, rows, last, below + last, DELETE, True)
    add(row_node, K, rows, follows, below + follows, stays[:, None], whole[:, None] & (initial[:, None] == follows))
    add(row_node, K, rows, SYSTEM, below + SYSTEM, stays[:, None], (whole & (initial == SYSTEM))[:, None] & (last == NONE))
    add(row_node, R, rows, follows, below + follows, stays[:, None] + REROLE, whole[:, None])
    nodes = np.arange(n + n_convs)[:, None] * 4 + last
    add(nodes, I, np.int64(0), follows, nodes - last + follows, INSERT, True)
    tail, label, row, role, head = (np.concatenate(x) for x in zip(*found))

    # arcs in order of (tail, label): the first of a node is its least; one more arc stands for the end
    order = np.lexsort((label, tail))
    tail, label, row, role, head = (x[order] for x in (tail, label, row, role, head))
    end = len(tail)
    least = np.full(len(to_end), end)
    least[tail[::-1]] = np.arange(end)[::-1]
    rank = np.r_[label, 0]
    pointers = [np.r_[least[head], end]]
    while (pointers[-1] != end).any():
        to = pointers[-1]
        rank = np.unique(rank * (rank.max() + 1) + rank[to], return_inverse=True)[1]
        pointers.append(to[to])

    roots = (starts + np.arange(n_convs)) * 4
    out = np.flatnonzero(np.isin(tail, roots))
    out = out[np.lexsort((rank[out], tail[out]))]
    path = np.full(n_convs, end)
    path[np.searchsorted(roots, tail[out])[::-1]] = out[::-1]  # the first in rank of each root
    of = np.arange(n_convs)
    of, path = of[path != end], path[path != end]
    for to in reversed(pointers):
        path, of = np.stack([path, to[path]], axis=1).ravel(), np.repeat(of, 2)
        path, of = path[path != end], of[path != end]
    return to_end[roots], (label, row, role), path, of
