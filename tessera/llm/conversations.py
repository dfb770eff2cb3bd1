"""Repair of conversations: the cheapest edits that give a regular order of turns.

A regular conversation is empty or an optional system turn and then one or
more pairs of a user's and an assistant's turn. Turns are first read without
their texts, as one code each: the role's initial and the first fault. Whole
conversations are bucketed by length into tensors, turn by conversation by
state, and a dynamic program goes through the turns from the last to the
first, for all conversations of a tensor at once. The costs it stores are then
followed forwards, again for all at once, which gives the edits.

Texts move once: sorted by conversation and turn behind their conversation's
edits, they are repaired as they pass, so no task holds a conversation's texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.shared import read, shuffle_partitions, stored

SPACES = " \t\n\x0b\f\r"
#: Codes of a turn: its role's initial, and four times its fault.
SYSTEM, USER, ASSISTANT, OTHER = range(4)
SOUND, BLANK, TRUNCATED, DUPLICATE = 0, 4, 8, 12
LEGAL = np.zeros(16, dtype=bool)
LEGAL[[SYSTEM * 4 + USER, USER * 4 + ASSISTANT, ASSISTANT * 4 + USER]] = True

#: States: nothing yet, behind the system turn, behind a user's, behind an assistant's; the last column stands for "not allowed".
START, AFTER_SYSTEM, AFTER_USER, AFTER_ASSISTANT, NOWHERE = range(5)
#: Where keeping a turn of an initial leads to from each state, and where an inserted or re-roled turn does.
KEEP_TO = np.full((4, 4), NOWHERE)
KEEP_TO[SYSTEM, START] = AFTER_SYSTEM
KEEP_TO[USER, [START, AFTER_SYSTEM, AFTER_ASSISTANT]] = AFTER_USER
KEEP_TO[ASSISTANT, AFTER_USER] = AFTER_ASSISTANT
STEP_TO = np.array([AFTER_USER, AFTER_USER, AFTER_ASSISTANT, AFTER_USER])
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 3, 4, 3, 3
NEVER = 1 << 30
#: What a turn adds to keeping or re-roling it.
PENALTY = np.repeat([0, NEVER, TRUNCATED_COST, NEVER], 4)
#: Rows that a tensor of several conversations holds, with its padding.
TENSOR_CELLS = 1 << 19
#: Whole conversations are solved when so many turns have been read.
TURNS_AT_ONCE = 1 << 18


def _with_inserts(costs: np.ndarray) -> np.ndarray:
    """Costs from each state where turns may be inserted first; a third insertion would only lead back."""
    once = costs[:, STEP_TO] + INSERT_COST
    twice = costs[:, STEP_TO[STEP_TO]] + 2 * INSERT_COST
    return np.minimum(np.minimum(costs, once), twice)


def cheapest_edits(codes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The cost and the edits, three letters or zeros a turn and at the end, of each conversation.

    ``codes`` is turn by conversation; a conversation stands at the end of its
    column. Of edits that cost the same, those first in ASCII order.
    """
    turns, many = codes.shape
    costs = np.empty((turns + 1, many, 4), dtype=np.int32)
    ended = np.full((1, 4), NEVER, dtype=np.int64)
    ended[0, [START, AFTER_ASSISTANT]] = 0
    costs[turns] = _with_inserts(ended)
    padded = np.full((many, 5), NEVER, dtype=np.int64)
    for t in range(turns - 1, -1, -1):
        padded[:, :4] = costs[t + 1]
        penalty = PENALTY[codes[t]][:, None]
        kept = np.take_along_axis(padded, KEEP_TO[codes[t] & 3], 1) + penalty
        best = np.minimum(np.minimum(padded[:, :4] + DELETE_COST, kept), padded[:, STEP_TO] + REROLE_COST + penalty)
        costs[t] = np.minimum(_with_inserts(best), NEVER)

    edits = np.zeros((turns + 1, 3, many), dtype=np.uint8)
    state = np.zeros(many, dtype=np.int64)
    starts = turns - lengths
    column = np.arange(many)
    for t in range(turns):
        left = t >= starts
        ahead, code = costs[t + 1], codes[t]
        penalty = PENALTY[code]
        for slot in range(3):
            due = costs[t, column, state]
            deleted = left & (ahead[column, state] + DELETE_COST == due)
            left &= ~deleted
            inserted = left & (costs[t, column, STEP_TO[state]] + INSERT_COST == due)
            left &= ~inserted
            to = KEEP_TO[code & 3, state]
            kept = left & (to != NOWHERE) & (ahead[column, to % NOWHERE] + penalty == due)
            reroled = left & ~kept
            edits[t, slot] = deleted * ord("D") + inserted * ord("I") + kept * ord("K") + reroled * ord("R")
            state = np.where(kept, to, np.where(inserted | reroled, STEP_TO[state], state))
            left = inserted
            if not left.any():
                break
    for slot in range(2):
        missing = (state == AFTER_SYSTEM) | (state == AFTER_USER)
        edits[turns, slot] = missing * ord("I")
        state = np.where(missing, STEP_TO[state], state)
    return costs[starts, column, START].astype(np.int64), edits.reshape(-1, many)


def solve(codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """The cost and audit of each conversation, whose codes begin at ``starts``."""
    costs = np.zeros(len(starts), dtype=np.int64)
    audits = [b""] * len(starts)
    bucket = np.ceil(np.log2(np.maximum(lengths, 1))).astype(np.int64)
    for size in np.unique(bucket).tolist():
        own = np.flatnonzero(bucket == size)
        turns = int(lengths[own].max())
        for some in np.array_split(own, max(1, len(own) * turns // TENSOR_CELLS)):
            place = np.arange(turns)[:, None] - (turns - lengths[some])[None, :]
            tensor = np.where(place >= 0, codes[np.maximum(place, 0) + starts[some][None, :]], 0)
            costs[some], edits = cheapest_edits(tensor, lengths[some])
            edits = np.ascontiguousarray(edits.T)
            data = edits[edits != 0].tobytes()
            ends = np.cumsum((edits != 0).sum(axis=1)).tolist()
            for i, a, b in zip(some.tolist(), [0, *ends], ends, strict=False):
                audits[i] = data[a:b]
    return costs, audits


_FAULTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def _audited(rows: pa.Table, names: list[str]) -> pa.RecordBatch:
    """One row for each conversation of ``rows``, which are whole conversations in order."""
    conv = rows.column("conv").combine_chunks()
    starts = _starts(conv)
    lengths = np.diff(np.append(starts, len(conv)))
    which = np.repeat(np.arange(len(starts)), lengths)
    code = np.asarray(rows.column("code").combine_chunks()).astype(np.int64)
    digests = np.asarray(rows.column("digest").combine_chunks().dictionary_encode().indices).astype(np.int64)
    first = np.zeros(len(code), dtype=bool)
    first[np.unique(which * (digests.max() + 1) + digests, return_index=True)[1]] = True
    code = np.where(first | ((code & 12) == BLANK), code, (code & 3) + DUPLICATE)
    fault = code & 12

    together = which[1:] == which[:-1]
    initials = code & 3
    illegal = np.append(together & ~LEGAL[initials[:-1] * 4 + initials[1:]], False)
    turn = rows.column("turn").combine_chunks()
    known = np.asarray(turn.is_valid())
    at = np.asarray(turn.fill_null(0))
    fresh = known.copy()
    fresh[1:] &= ~(together & known[:-1] & (at[1:] == at[:-1]))
    # Null turns come first, so a conversation's known turns are its last.
    count = np.add.reduceat(known.astype(np.int64), starts)
    last = starts + lengths - 1
    spans = np.where(count > 0, at[last] - at[np.minimum(starts + lengths - count, last)] + 1, 0)
    cost, audits = solve(code, starts, lengths)
    counts = [np.add.reduceat(x.astype(np.int64), starts) for x in (fault == BLANK, fault == DUPLICATE, fault == TRUNCATED, illegal)]
    gaps = spans - np.add.reduceat(fresh.astype(np.int64), starts)
    columns = [conv.take(pa.array(starts)), *(pa.array(c, pa.int64()) for c in (gaps, *counts, cost)), pa.array([a.decode() for a in audits], pa.string())]
    return pa.RecordBatch.from_arrays(columns, names=names)


def _starts(conv: pa.Array) -> np.ndarray:
    """Where another conversation begins; null is one, too."""
    codes = np.asarray(conv.dictionary_encode("encode").indices)
    return np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))


def _audit_stream(at_once: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Audits whole conversations whenever about so many turns have been read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv", *_FAULTS, "audit"]
        held: list[pa.RecordBatch] = []
        rows = 0
        enough = at_once
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows < enough:
                continue
            table = pa.Table.from_batches(held)
            cut = int(_starts(table.column("conv").combine_chunks())[-1])
            if cut:
                yield _audited(table.slice(0, cut), names)
            held = table.slice(cut).combine_chunks().to_batches()
            rows -= cut
            # A conversation that is longer than the limit is looked at again when it has doubled.
            enough = max(at_once, 2 * rows)
        if rows:
            yield _audited(pa.Table.from_batches(held), names)

    return run


def _repair_stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Conversations' edits followed by their turns, as repaired turns."""
    conv, audit, at, place, role_due = None, "", 0, 0, "user"
    out: dict[str, list] = {}

    def put(role: str, text: str) -> None:
        nonlocal place, role_due
        place += 1
        role_due = "assistant" if role[:1] == "u" else "user"
        for name, value in (("conv", conv), ("place", place), ("role", role), ("text", text)):
            out[name].append(value)

    def inserts() -> None:
        nonlocal at
        while at < len(audit) and audit[at] == "I":
            at += 1
            put(role_due, "")

    def batch_of(kind: pa.DataType) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(out["conv"], kind), pa.array(out["place"], pa.int64()), pa.array(out["role"], pa.string()), pa.array(out["text"], pa.string())],
            names=["conv", "place", "role", "text"],
        )

    kind = None
    for batch in batches:
        kind = batch.schema.field("conv").type
        out = {name: [] for name in ("conv", "place", "role", "text")}
        for key, edits, role, text in zip(*(batch.column(n).to_pylist() for n in ("conv", "audit", "role", "text")), strict=True):
            if edits is not None:
                inserts()
                conv, audit, at, place, role_due = key, edits, 0, 0, "user"
                continue
            inserts()
            edit = audit[at]
            at += 1
            if edit != "D":
                put(role if edit == "K" else role_due, text)
        yield batch_of(kind)
    if kind is not None:
        out = {name: [] for name in ("conv", "place", "role", "text")}
        inserts()
        yield batch_of(kind)


def _digest_stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each conversation's repaired turns, which come together and in order."""
    digest = kind = None
    conv = None
    for batch in batches:
        done, digests = [], []
        kind = batch.schema.field("conv").type
        for key, place, role, text in zip(*(batch.column(n).to_pylist() for n in ("conv", "place", "role", "text")), strict=True):
            if place == 1:
                if digest is not None:
                    done.append(conv)
                    digests.append(digest.hexdigest())
                conv, digest = key, hashlib.sha256()
            else:
                digest.update(b"\n")
            digest.update(f"{role}:{text}".encode())
        yield pa.RecordBatch.from_arrays([pa.array(done, kind), pa.array(digests, pa.string())], names=["conv", "sha256"])
    if digest is not None:
        yield pa.RecordBatch.from_arrays([pa.array([conv], kind), pa.array([digest.hexdigest()], pa.string())], names=["conv", "sha256"])


def _digest(role: Column, text: Column) -> Column:
    return F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))


def _turns(turns: DataFrame, conv_col: str) -> DataFrame:
    """conv, turn, role, text and digest; null roles and texts are one space."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    plain = turns.select(F.col(conv_col).alias("conv"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    return plain.withColumn("digest", _digest(F.col("role"), F.col("text")))


def _order(*before: Column) -> list[Column]:
    """By conversation, then ``before``, then in the order of turns."""
    return [F.col("conv").asc_nulls_first(), *before, F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]


def audit_conversations(turns: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """One row for each conversation of ``turns(conv_id, turn, role, text)``: the id, gaps, blank, duplicate, truncated, illegal, cost, audit.

    Turns stand in ascending order of ``turn``, nulls first; of one number, by
    role and then by a digest of the text, so that equal turns are neighbours.
    A turn's first fault counts: blank (white space only), duplicate (role and
    text seen earlier in the conversation), truncated (its last character that
    is not white space is none of ``.!?``). ``illegal`` counts neighbours whose
    roles' initials are not su, ua or au; ``gaps`` the numbers missing between
    the first and the last turn. ``cost`` and ``audit`` are those of the
    cheapest edits, a letter each: Keep 0, Rerole 3, Delete 4 (a must for blank
    and duplicate turns), Insert 3, and 3 for each truncated turn that is not
    deleted; of equal costs the audit first in ASCII order.

    Null roles and texts count as one space; turns with a null id are one
    conversation; repeated rows are duplicates; very long texts are read as
    codes and digests only. Other columns are ignored, whatever their names.
    No rows give no rows. A conversation is solved by one task, which holds
    some 100 bytes for each of its turns, and none of its texts.
    """
    rows = _turns(turns, conv_col)
    shown = F.rtrim(F.col("text"), F.lit(SPACES))
    initial = F.substring("role", 1, 1)
    who = F.when(initial == "s", SYSTEM).when(initial == "u", USER).when(initial == "a", ASSISTANT).otherwise(OTHER)
    fault = F.when(shown == "", BLANK).when(F.substring(shown, -1, 1).isin(".", "!", "?"), SOUND).otherwise(TRUNCATED)
    coded = rows.select("conv", "turn", "role", "digest", (who + fault).cast("byte").alias("code"))
    dealt = coded.repartition(shuffle_partitions(turns.sparkSession), "conv").sortWithinPartitions(*_order())
    kind = rows.schema["conv"].dataType
    schema = T.StructType([T.StructField("conv", kind), *(T.StructField(n, T.LongType()) for n in _FAULTS), T.StructField("audit", T.StringType())])
    return dealt.select("conv", "turn", "digest", "code").mapInArrow(_audit_stream(TURNS_AT_ONCE), schema).withColumnRenamed("conv", conv_col)


def repaired_turns(turns: DataFrame, audits: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """The repaired turns: id, place (from 1), role, text, by ``audits`` of the same rows, stored.

    A partition holds whole conversations, each together and in order. Kept
    turns stay as they are (a null as one space), re-roled ones change their
    role, inserted ones have an empty text. A conversation whose turns are all
    deleted has no rows. Turns stream past: one task reads a conversation but
    does not hold it.
    """
    rows = _turns(turns, conv_col)
    marks = audits.select(F.col(conv_col).alias("conv"), "audit")
    both = rows.withColumn("audit", F.lit(None).cast("string")).unionByName(marks, allowMissingColumns=True)
    dealt = both.repartition(shuffle_partitions(turns.sparkSession), "conv")
    ordered = dealt.sortWithinPartitions(*_order(F.col("audit").isNull()))
    text = T.StringType()
    schema = T.StructType([T.StructField("conv", rows.schema["conv"].dataType), T.StructField("place", T.LongType()), T.StructField("role", text), T.StructField("text", text)])
    return ordered.select("conv", "audit", "role", "text").mapInArrow(_repair_stream, schema).withColumnRenamed("conv", conv_col)


def repaired_digests(repaired: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """id and sha256 of each conversation's ``role:text`` joined by line feeds, from the rows of :func:`repaired_turns` as they come."""
    schema = T.StructType([T.StructField("conv", repaired.schema[conv_col].dataType), T.StructField("sha256", T.StringType())])
    return repaired.withColumnRenamed(conv_col, "conv").mapInArrow(_digest_stream, schema).withColumnRenamed("conv", conv_col)


def damaged(turns: DataFrame) -> DataFrame:
    """``turns`` with faults put in by a checksum of their id and number: dropped, emptied, cut short, repeated or made the user's."""
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    named = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    kind = F.crc32(F.concat(named[0], F.lit(":"), named[1])) % 20
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), kind.alias("kind")).where("kind <> 0")
    cut = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), cut.alias("text"), times.alias("copy")).drop("copy")


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations")
    rows = damaged(turns)
    audits = stored(audit_conversations(rows))
    digests = repaired_digests(repaired_turns(rows, audits)).withColumnRenamed("conv_id", "d_id")
    ids = turns.select(F.col("conv_id").alias("o_id")).distinct()
    found = ids.join(audits, F.col("o_id").eqNullSafe(F.col("conv_id")), "left").join(digests, F.col("o_id").eqNullSafe(F.col("d_id")), "left")
    nothing = hashlib.sha256().hexdigest()
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in _FAULTS]
    return found.select(
        F.col("o_id").alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.lit(nothing)).alias("repaired_sha256")
    )
