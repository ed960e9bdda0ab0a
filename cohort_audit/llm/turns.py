"""Operator 11 - repair of the structure of conversations by a rank-compressed dynamic program.

A conversation is legal if its role initials read ``(s?(ua)+)?``. Rows are edited in order: Keep (K), Rerole (R), Delete (D), and
Insert (I) of an empty turn. The edits of a row are one *macro edit*: a run of at most two inserts, then what is done with the
row. The nine macros ``D ID IID IIK IIR IK IR K R`` are a prefix-free code, listed in ASCII order. So of two audit strings with
equally many macros none begins the other, and their order is that of the macros before the last, then of the last. A state
therefore needs no string: its cost, its *rank* among the states of its layer (a layer a row), and a pointer to the state
and macro it came from. Strings and repaired texts are rebuilt from the pointers afterwards.

States are what may follow: nothing yet, after ``s``, after ``u``, after ``a``. A letter leads from a state to one state, so
different states have different strings and ranks have no ties.

Costs and ranks of the four states for each of the four states at entry sum up any stretch of rows in 32 numbers, and such
summaries compose. Spark sorts all rows by ranges of (conversation, turn), so that a conversation of any size is spread over
tasks; one that lies inside a task is solved there, layer by layer with all others of a batch. Of those that cross tasks or have
over ``BLOCK`` rows, blocks are summarized, the summaries composed along the conversation, and each block is solved again between
the states that this gives it. What is left in order is the hash of the repaired text, fed block by block: SHA-256 allows no
other way, and it holds one block at a time.

Defined results: a null conversation id is a conversation; null roles and texts are one space, null ids and turns are one space
in the damage's key; rows go by turn (nulls first), rows of one turn by the hash of role and text, then role, then text, so equal
rows are neighbours whatever their order in the table; a row whose role is empty has no initial and cannot be kept as it is;
very long texts are taken whole; without rows after the damage all numbers are zero, the audit is empty and the hash that of the
empty text; an empty table gives no rows; only the four columns are read, so further columns of any name do no harm.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import base

#: Most rows of a block, and bytes of text after which one is closed; bytes of text that are solved together.
BLOCK, BLOCK_BYTES, BATCH_BYTES = 1000, 4 << 20, 4 << 20
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5

#: Macro edits in ASCII order.
MACROS = ["D", "ID", "IID", "IIK", "IIR", "IK", "IR", "K", "R"]
#: States: nothing yet, after s, after u, after a. Where an inserted turn leads, and the role it has.
_NEXT, _ROLE = [2, 2, 3, 2], ["user", "user", "assistant", "user"]
_KEPT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
#: Inserts that end a conversation in each state.
LAST = np.array([0, 2, 1, 0])
FAR = 1 << 50
#: Faults of a row.
SOUND, BLANK, DUPLICATE, CUT = range(4)
FAULTS = ["blank", "duplicate", "truncated"]
INITIALS = "sua"
LEGAL = {"su", "ua", "au"}
NUMBERS = ["gaps", *FAULTS, "illegal", "cost"]
RESULT = "conv_id long, " + ", ".join(f"{c} long" for c in NUMBERS) + ", audit string, repaired_sha256 string"
#: Rows of conversations that are not solved where they lie: ``place`` orders the blocks.
PARTIAL = "place long, turns array<long>, roles array<string>, texts array<string>, copies array<long>"


def _moves() -> tuple[np.ndarray, np.ndarray]:
    """For each kind of row (initial, must go, truncated), target state and move (entry state, macro): the cost, and the moves' order."""
    cost = np.full((4, 2, 2, 4, 4 * len(MACROS)), FAR, np.int64)
    for kind in np.ndindex(4, 2, 2):
        initial, gone, short = "sua-"[kind[0]], kind[1], kind[2]
        for entry in range(4):
            for m, macro in enumerate(MACROS):
                state, paid = entry, INSERT * (len(macro) - 1)
                for _ in macro[:-1]:
                    state = _NEXT[state]
                if macro[-1] == "D":
                    target, paid = state, paid + DELETE
                elif gone:
                    continue
                elif macro[-1] == "K":
                    target, paid = _KEPT.get((state, initial)), paid + KEEP + TRUNCATED * short
                else:
                    target, paid = _NEXT[state], paid + REROLE + TRUNCATED * short
                if target is not None:
                    cost[(*kind, target, entry * len(MACROS) + m)] = paid
    return cost.reshape(16, 4, -1), np.repeat(np.arange(4), len(MACROS))


COST, ENTRY = _moves()


def kinds(initial: np.ndarray, fault: np.ndarray) -> np.ndarray:
    """Number of the kind of each row, as COST has it."""
    return initial * 4 + np.isin(fault, (BLANK, DUPLICATE)) * 2 + (fault == CUT)


def layers(kind: np.ndarray, more: np.ndarray, off: np.ndarray, cost: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Costs and ranks of the states after the rows of each stretch [off[t], off[t + 1]), and each row's pointers (row, state).

    ``cost`` and ``rank`` (stretch, state) are those at entry; ``more`` is how many copies of a row are deleted after it.
    """
    cost, rank, size = cost.copy(), rank.copy(), np.diff(off)
    pointer = np.zeros((len(kind), 4), np.int8)
    order = np.argsort(-size, kind="stable")
    live = np.searchsorted(-size[order], -np.arange(int(size.max(initial=0))), "left")  # stretches with a row in the layer
    wide, place = 4 * len(MACROS) + 1, np.arange(4 * len(MACROS)) % len(MACROS)
    for layer, k in enumerate(live.tolist()):
        of = order[:k]
        row = off[of] + layer
        key = (cost[of] * wide + rank[of] * len(MACROS))[:, None, ENTRY] + place + COST[kind[row]] * wide
        move = key.argmin(2)
        best = np.take_along_axis(key, move[:, :, None], 2)[:, :, 0]
        pointer[row] = move
        reached = best < FAR * wide
        cost[of] = np.where(reached, best // wide + DELETE * more[row][:, None], FAR)
        rank[of] = np.where(reached, best % wide, wide).argsort(1, kind="stable").argsort(1, kind="stable")
    return cost, rank, pointer


def final_state(cost: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The state in which each conversation ends: cheapest with the inserts that end it, then least string."""
    return ((cost + INSERT * LAST) * 4 + rank).argmin(1)


def rebuilt(pointer: np.ndarray, off: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Macro of each row and the state before it, and the state at entry of each stretch, from the states at the ends."""
    state, size = state.copy(), np.diff(off)
    macro, before = np.zeros(len(pointer), np.int64), np.zeros(len(pointer), np.int64)
    order = np.argsort(-size, kind="stable")
    for layer in range(int(size.max(initial=0)) - 1, -1, -1):
        of = order[: np.searchsorted(-size[order], -layer, "left")]
        row = off[of] + layer
        move = pointer[row, state[of]]
        macro[row], before[row] = move % len(MACROS), move // len(MACROS)
        state[of] = before[row]
    return macro, before, state


def at_start(n: int) -> tuple[np.ndarray, np.ndarray]:
    cost = np.full((n, 4), FAR, np.int64)
    cost[:, 0] = 0
    return cost, np.tile(np.arange(4), (n, 1))


def lines(macro: int, state: int, role: str, text: str) -> list[str]:
    """The repaired rows of a macro edit from a state."""
    out = []
    for letter in MACROS[macro]:
        if letter == "K":
            out.append(f"{role}:{text}")
        elif letter != "D":
            out.append(f"{_ROLE[state]}:{text if letter == 'R' else ''}")
        state = _NEXT[state]
    return out


def endings(state: int) -> list[str]:
    return ["user:", "assistant:"][2 - LAST[state] :]


class Stretch:
    """Rows of one conversation, or of a block of it, in order; equal neighbours are one row with ``copies``."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.turns, self.roles, self.texts, self.copies, self.bytes = conv_id, [], [], [], [], 0

    def add(self, turn: int | None, role: str, text: str, copies: int) -> None:
        if copies and self.turns and (turn, role, text) == (self.turns[-1], self.roles[-1], self.texts[-1]):
            self.copies[-1] += copies
        elif copies:
            self.bytes += len(text)
            for to, x in ((self.turns, turn), (self.roles, role), (self.texts, text), (self.copies, copies)):
                to.append(x)

    def faults(self, earlier: set[int] = frozenset()) -> list[int]:
        """Each row's first fault; ``earlier``: places of rows seen in earlier blocks."""
        seen, out = set(), []
        for i, x in enumerate(zip(self.roles, self.texts, strict=True)):
            tail = x[1].rstrip(" \t\n\v\f\r")
            out.append(BLANK if not tail else DUPLICATE if i in earlier or x in seen else SOUND if tail[-1] in ".!?" else CUT)
            seen.add(x)
        return out

    def counts(self, faults: list[int]) -> tuple[list[int], int]:
        """Numbers of blank, duplicate and truncated rows, and of illegal neighbours."""
        n = [0, 0, 0, 0]
        for fault, copies in zip(faults, self.copies, strict=True):
            n[fault] += 1
            n[BLANK if fault == BLANK else DUPLICATE] += copies - 1
        pairs = [a[:1] + b[:1] for a, b in zip(self.roles, self.roles[1:])]
        return n[1:], sum(p not in LEGAL for p in pairs) + sum(self.copies) - len(self.copies)  # a row and its copy have one initial

    def distinct_turns(self) -> int:
        return len({t for t in self.turns if t is not None})


def _arrays(stretches: list[Stretch], faults: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    off = np.concatenate([[0], np.cumsum([len(s.turns) for s in stretches])]).astype(np.int64)
    initial = np.array([INITIALS.find(r[:1]) if r[:1] in INITIALS and r else 3 for s in stretches for r in s.roles], np.int64)
    more = np.array([c - 1 for s in stretches for c in s.copies], np.int64)
    return kinds(initial, np.array([f for x in faults for f in x], np.int64)), more, off


def pieces(s: Stretch, macro: list[int], before: list[int]) -> tuple[str, list[str]]:
    """Audit and repaired rows of a stretch."""
    audit = "".join(MACROS[m] + "D" * (c - 1) for m, c in zip(macro, s.copies, strict=True))
    return audit, [x for m, e, r, t in zip(macro, before, s.roles, s.texts, strict=True) for x in lines(m, e, r, t)]


def solve(whole: list[Stretch]) -> list[tuple]:
    """Results of whole conversations."""
    faults = [s.faults() for s in whole]
    kind, more, off = _arrays(whole, faults)
    cost, rank, pointer = layers(kind, more, off, *at_start(len(whole)))
    end = final_state(cost, rank)
    macro, before, _ = rebuilt(pointer, off, end)
    out = []
    for t, s in enumerate(whole):
        audit, text = pieces(s, macro[off[t] : off[t + 1]].tolist(), before[off[t] : off[t + 1]].tolist())
        n, illegal = s.counts(faults[t])
        turns = [x for x in s.turns if x is not None]
        gaps = turns[-1] - turns[0] + 1 - s.distinct_turns() if turns else 0
        text += endings(end[t])
        total = int(cost[t, end[t]] + INSERT * LAST[end[t]])
        out.append((s.conv_id, gaps, *n, illegal, total, audit + "I" * int(LAST[end[t]]), hashlib.sha256("\n".join(text).encode()).hexdigest()))
    return out


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows with the query's damage; ``copies`` is 0 for a dropped row, 2 for a repeated one."""
    space = F.lit(" ")
    keyed = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), space).alias("role"), F.coalesce(F.col("text").cast("string"), space).alias("text"))
    fate = F.crc32(F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), space), F.coalesce(F.col("turn").cast("string"), space))) % 20
    keyed = keyed.withColumn("fate", fate)
    text = F.when(F.col("fate") < 2, "").when(F.col("fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("fate") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("fate") == 0, 0).when(F.col("fate") == 3, 2).otherwise(1).cast("long")
    return keyed.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copies"))


def undamaged(conversations: DataFrame) -> DataFrame:
    """The rows as they are, nulls as one space."""
    space = F.lit(" ")
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), space).alias("role"), F.coalesce(F.col("text").cast("string"), space).alias("text"), F.lit(1).cast("long").alias("copies"))


def _schema(fields: str) -> pa.Schema:
    kind = {"long": pa.int64(), "string": pa.string(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}
    return pa.schema([(x.split(" ")[0], kind[x.split(" ")[1]]) for x in fields.split(", ")])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def sorted_rows(rows: DataFrame) -> DataFrame:
    """The rows sorted by ranges of (conversation, turn), a conversation over as many tasks as it needs.

    The salt lets even many equal rows be split; equal rows may lie in any order.
    """
    rows = base.batched(rows).withColumns({"h": F.xxhash64("role", "text"), "salt": F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 20))})
    return rows.repartitionByRange("conv_id", "turn", "h", "salt").sortWithinPartitions("conv_id", "turn", "h", "role", "text").drop("h", "salt")


def solved_or_blocks(rows: DataFrame) -> DataFrame:
    """Results of the conversations that lie inside a task; of all others, blocks of rows (``place`` is not null)."""
    result, partial = _schema(RESULT), _schema(PARTIAL)
    none_r, none_p = (None,) * (len(result) - 1), (None,) * len(partial)
    schema = pa.schema([*result, *partial])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = TaskContext.get().partitionId() << 32  # tasks lie in the order of their ranges
        whole: list[Stretch] = []
        now, cut, held = None, True, 0  # the first conversation may have begun in the task before

        def block(s: Stretch) -> pa.RecordBatch:
            nonlocal place
            place += 1
            return _batch([(s.conv_id, *none_r, place, s.turns, s.roles, s.texts, s.copies)], schema)

        for batch in batches:
            for conv, turn, role, text, copies in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is None or conv != now.conv_id:
                    if now is not None and cut:
                        yield block(now)
                    elif now is not None:
                        whole.append(now)
                        held += now.bytes
                    if held > BATCH_BYTES or len(whole) > 20 * BLOCK:
                        yield _batch([(*r, *none_p) for r in solve(whole)], schema)
                        whole, held = [], 0
                    cut, now = now is None, Stretch(conv)
                elif len(now.turns) >= BLOCK or now.bytes > BLOCK_BYTES:
                    yield block(now)
                    cut, now = True, Stretch(conv)
                now.add(turn, role, text, copies)
        if now is not None:
            yield block(now)  # the last one may go on in the next task
        if whole:
            yield _batch([(*r, *none_p) for r in solve(whole)], schema)

    return rows.mapInArrow(run, f"{RESULT}, {PARTIAL}")


def _stretch(r: dict) -> Stretch:
    s = Stretch(r["conv_id"])
    s.turns, s.roles, s.texts, s.copies = r["turns"], r["roles"], r["texts"], r["copies"]
    return s


def _in_order(df: DataFrame, descending: bool = False) -> DataFrame:
    """The blocks of a conversation one after the other in one task."""
    return df.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("place") if descending else F.col("place"))


def summaries(blocks: DataFrame) -> DataFrame:
    """Costs and ranks of each block's states for each state at entry."""
    schema = _schema("conv_id long, place long, costs array<long>, ranks array<long>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                s = _stretch(r)
                kind, more, off = _arrays([s], [s.faults(set(r["earlier"] or ()))])
                cost = np.full((4, 4), FAR, np.int64)
                np.fill_diagonal(cost, 0)
                n = len(kind)
                cost, rank, _ = layers(np.tile(kind, 4), np.tile(more, 4), np.arange(5) * n, cost, np.tile(np.arange(4), (4, 1)))
                yield _batch([(s.conv_id, r["place"], cost.ravel().tolist(), rank.ravel().tolist())], schema)

    return blocks.mapInArrow(run, "conv_id long, place long, costs array<long>, ranks array<long>")


def compose(cost: np.ndarray, rank: np.ndarray, costs: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Costs and ranks after a block, and for each state the entry state it comes from."""
    total = np.minimum(cost[:, None] + costs, FAR)
    entry = (total * 4 + rank[:, None]).argmin(0)
    out = total[entry, np.arange(4)]
    rank = np.where(out < FAR, rank[entry] * 4 + ranks[entry, np.arange(4)], 16).argsort(kind="stable").argsort(kind="stable")
    return out, rank, entry


def paths(summary: DataFrame) -> DataFrame:
    """State at entry and exit of each block on the cheapest, least path. One pass along each conversation, one back."""

    def forth(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, cost, rank = (), None, None
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if last != (r["conv_id"],):
                    last, (cost, rank) = (r["conv_id"],), (x[0] for x in at_start(1))
                cost, rank, entry = compose(cost, rank, np.array(r["costs"]).reshape(4, 4), np.array(r["ranks"]).reshape(4, 4))
                end = int(final_state(cost[None], rank[None])[0])
                out.append((r["conv_id"], r["place"], entry.tolist(), end, int(cost[end] + INSERT * LAST[end])))
            if out:
                yield _batch(out, forth_schema)

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = (), 0
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                ends = last != (r["conv_id"],)
                if ends:
                    last, state = (r["conv_id"],), r["end"]
                leave, state = state, r["entries"][state]
                out.append((r["conv_id"], r["place"], state, leave, r["cost"] if ends else None))
            if out:
                yield _batch(out, back_schema)

    forth_fields, back_fields = "conv_id long, place long, entries array<long>, end long, cost long", "conv_id long, place long, entry long, leave long, cost long"
    forth_schema, back_schema = _schema(forth_fields), _schema(back_fields)
    return _in_order(_in_order(summary).mapInArrow(forth, forth_fields), descending=True).mapInArrow(back, back_fields)


def repaired_blocks(blocks: DataFrame) -> DataFrame:
    """Each block's counts, audit and repaired rows, between the states that :func:`paths` gives it."""
    fields = "conv_id long, place long, first_turn long, last_turn long, turns long, blank long, duplicate long, truncated long, illegal long, cost long, first_role string, last_role string, audit string, rows array<string>"
    schema = _schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                s = _stretch(r)
                faults = s.faults(set(r["earlier"] or ()))
                kind, more, off = _arrays([s], [faults])
                cost = np.full((1, 4), FAR, np.int64)
                cost[0, r["entry"]] = 0
                _, _, pointer = layers(kind, more, off, cost, np.arange(4)[None])
                macro, before, _ = rebuilt(pointer, off, np.array([r["leave"]]))
                audit, text = pieces(s, macro.tolist(), before.tolist())
                if r["cost"] is not None:  # the last block
                    audit, text = audit + "I" * int(LAST[r["leave"]]), text + endings(r["leave"])
                n, illegal = s.counts(faults)
                turns = [x for x in s.turns if x is not None]
                edge = (s.roles[0], s.roles[-1]) if s.roles else (None, None)
                yield _batch([(s.conv_id, r["place"], *((turns[0], turns[-1]) if turns else (None, None)), s.distinct_turns(), *n, illegal, r["cost"], *edge, audit, text)], schema)

    return blocks.mapInArrow(run, fields)


def joined(done: DataFrame) -> DataFrame:
    """One result a conversation from its blocks in order; a block's rows are hashed and forgotten."""
    schema = _schema(RESULT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None

        def result() -> pa.RecordBatch:
            gaps = now["hi"] - now["lo"] + 1 - now["turns"] if now["lo"] is not None else 0
            return _batch([(now["id"], gaps, *now["n"], now["cost"], "".join(now["audit"]), now["sha"].hexdigest())], schema)

        for batch in batches:
            for r in batch.to_pylist():
                if now is None or now["id"] != r["conv_id"]:
                    if now is not None:
                        yield result()
                    now = {"id": r["conv_id"], "lo": None, "hi": None, "turns": 0, "n": [0] * 4, "cost": 0, "audit": [], "sha": hashlib.sha256(), "any": False, "role": None}
                if r["turns"]:
                    now["turns"] += r["turns"] - (now["hi"] == r["first_turn"])
                    now["lo"], now["hi"] = r["first_turn"] if now["lo"] is None else now["lo"], r["last_turn"]
                now["n"] = [x + r[c] for x, c in zip(now["n"], [*FAULTS, "illegal"], strict=True)]
                if r["first_role"] is not None:
                    now["n"][3] += now["role"] is not None and now["role"][:1] + r["first_role"][:1] not in LEGAL
                    now["role"] = r["last_role"]
                now["cost"] = r["cost"] if r["cost"] is not None else now["cost"]
                now["audit"].append(r["audit"])
                for line in r["rows"]:
                    now["sha"].update((("\n" if now["any"] else "") + line).encode())
                    now["any"] = True
        if now is not None:
            yield result()

    return _in_order(done).mapInArrow(run, RESULT)


def seen_earlier(blocks: DataFrame) -> DataFrame:
    """The blocks with ``earlier``: places of rows whose role and text an earlier block of the conversation has too."""
    item = F.posexplode(F.zip_with("roles", "texts", lambda r, t: F.struct(r.alias("role"), t.alias("text")))).alias("at", "item")
    rows = blocks.select("conv_id", "place", item).select("conv_id", "place", F.col("at").cast("long").alias("at"), F.sha2(F.concat_ws(":", F.length("item.role").cast("string"), "item.role", "item.text"), 256).alias("h"))
    first = rows.groupBy("conv_id", "h").agg(F.min("place").alias("lo"), F.max("place").alias("hi")).where("lo < hi").select(F.col("conv_id").alias("c"), "h", "lo")
    later = rows.join(first, (rows["conv_id"].eqNullSafe(first["c"])) & (rows["h"] == first["h"]) & (rows["place"] > F.col("lo")))
    return blocks.join(later.groupBy("place").agg(F.collect_list("at").alias("earlier")), "place", "left")  # at most a block's rows


def repair(rows: DataFrame) -> DataFrame:
    """One row a conversation: gaps, faults, illegal neighbours, the cheapest edits' cost and audit, hash of the repaired text.

    ``rows``: conv_id, turn, role, text, copies, as :func:`undamaged` or :func:`damaged` give them.
    """
    scratch = base.Scratch(rows.sparkSession)
    table = base.stored(solved_or_blocks(sorted_rows(rows)), "turns")
    names = [c.split(" ")[0] for c in RESULT.split(", ")]
    blocks = scratch.stored(seen_earlier(table.where("place is not null").select("conv_id", *_schema(PARTIAL).names)), "blocks")
    path = scratch.stored(paths(summaries(blocks)), "paths").drop("conv_id")
    split = base.stored(joined(repaired_blocks(blocks.join(path, "place"))), "turns")
    scratch.clear()
    return table.where("place is null").select(*names).union(split)
