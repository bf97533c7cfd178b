"""Conversation structure repair: the cheapest edits that turn a conversation's roles into ``(s?(ua)+)?``.

A conversation's turns are layers of a graph with four states (nothing yet, after system, after user, after assistant). Arcs
between layers keep (0), rerole (1) or delete (2) a turn, arcs within a layer insert an empty one (5); a truncated turn that
stays costs 5 more, and a blank or repeated one must go. Minimum costs run forward from the start and backward from the end; an arc is tight
if the costs before it, of it and after it make the minimum of all. The tight arcs are all cheapest repairs, and a traversal of
their frontier sets takes the least letter (D, I, K, R) at each step.

Only a letter for each turn comes to one task: turns are sorted by ranges, so a conversation of any length lies in as
many tasks as it needs; repeats are found by a shuffle of text digests; blocks of at most 1,024 turns become strings of letters, and a
conversation is the string of those, as long as the audit that the result must hold anyway. The costs take four bytes a
turn. Edits go back to the turns as a row for each block, which is merged into the sorted stream of turns; the digest is taken while that
streams past, so no task holds a conversation's texts.

Defined cases: null roles and texts are one space, a null turn comes first; turns that share a number go by role, then text;
repeated rows are repeated turns; a null conv_id is a conversation of its own; a role counts by its first character, and one that isn't s, u
or a can't be kept; a conversation without turns needs no edit; texts of any length are taken whole; texts are held equal if
their 128-bit digests are; no rows give no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rinsework.llm.workers import tidy
from rinsework.session import staged

BLOCK = 1024
#: A turn's letter: three for each of the initials s, u, a and others: sound, to be deleted, truncated.
LETTERS = "abcdefghijkl"
INITIALS = "sua?"
#: The state after a kept s, u, a in each state; -1: not allowed. States: 0 nothing yet, 1 after s, 2 after u, 3 after a.
KEEP = [[1, 2, -1, -1], [-1, 2, -1, -1], [-1, -1, 3, -1], [-1, 2, -1, -1]]
NEXT = [2, 2, 3, 2]  # after an inserted turn, or one whose role was set
ENDS = (0, 3)
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
FAR = 200  # from the least cost of a layer: what is as far off is never part of a cheapest repair
ROLE_OF = {2: "user", 3: "assistant"}


def damage(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with faults put in by the checksum of ``conv_id:turn``: dropped, emptied, without its ends, repeated, or said by the user."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn"))) % 20
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    hurt = rows.select("conv_id", "turn", said("role").alias("role"), said("text").alias("text"), fault.alias("fault")).filter("fault <> 0")
    out = hurt.select("conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy"))
    return out.drop("_copy")


def _sorted(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, id: ids rise in the order of conversations and turns. The last key deals equal rows to several tasks."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    keys = ["conv_id", "turn", "role", "text"]
    dealt = rows.select("conv_id", "turn", said("role"), said("text")).withColumn("_same", F.monotonically_increasing_id())
    return staged(dealt.repartitionByRange(*keys, "_same").sortWithinPartitions(*keys).drop("_same").withColumn("id", F.monotonically_increasing_id()), "turns")


def _fault(repeated: Column) -> Column:
    """0 blank, 1 duplicate, 2 truncated, or null: the first that holds."""
    bare = F.rtrim(F.translate("text", "\t\n\u000b\u000c\r", "     "))
    return F.when(bare == "", 0).when(repeated, 1).when(~F.substring(bare, -1, 1).isin(".", "!", "?"), 2)


def letters(turns: DataFrame) -> DataFrame:
    """conv_id, id, block, letter, fault. The block is that of the least turn's id."""
    text_key = F.unhex(F.md5("text"))
    keyed = turns.select("conv_id", "id", "role", text_key.alias("text_key"), _fault(F.lit(False)).alias("own"))
    firsts = keyed.groupBy("conv_id", "role", "text_key").agg(F.min("id").alias("id")).select("id", F.lit(True).alias("first"))
    marked = keyed.join(firsts, "id", "left")
    fault = F.when(F.col("own") == 0, 0).when(F.col("first").isNull(), 1).otherwise(F.col("own"))
    initial = F.substring("role", 1, 1)
    place = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    kind = F.when(fault.isin(0, 1), 1).when(fault == 2, 2).otherwise(0)
    return marked.select("conv_id", "id", F.shiftright("id", 10).alias("block"), F.substring(F.lit(LETTERS), 3 * place + kind + 1, F.lit(1)).alias("letter"), fault.alias("fault"))


def strings(marked: DataFrame) -> DataFrame:
    """conv_id, blocks (block and its number of turns, in order), said (all letters), and the number of each fault."""
    joined = lambda *c: F.concat_ws("", F.transform(F.sort_array(F.collect_list(F.struct(*c))), lambda x: x["letter"]))
    faults = ("blank", "duplicate", "truncated")
    counts = [F.count_if(F.col("fault") == i).alias(name) for i, name in enumerate(faults)]
    blocks = marked.groupBy("conv_id", "block").agg(joined("id", "letter").alias("letter"), F.count("*").cast("int").alias("n"), *counts)
    return blocks.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("block", "n"))).alias("blocks"), joined("block", "letter").alias("said"), *(F.sum(n).alias(n) for n in faults))


def _arcs(code: int) -> list[tuple[str, int, int, int]]:
    """(letter, state, next state, cost) of the arcs that take a turn."""
    initial, kind = divmod(code, 3)
    out = [("D", s, s, DELETE) for s in range(4)]
    if kind != 1:
        more = TRUNCATED if kind == 2 else 0
        out += [("K", s, KEEP[s][initial], more) for s in range(4) if initial < 3 and KEEP[s][initial] >= 0]
        out += [("R", s, NEXT[s], REROLE + more) for s in range(4)]
    return out


ARCS = [_arcs(c) for c in range(len(LETTERS))]
INSERTS = [("I", s, NEXT[s], INSERT) for s in range(4)]


def _relax(cost: list[int], arcs: list[tuple[str, int, int, int]], back: bool) -> list[int]:
    out = [2 * FAR] * 4
    for _, s, t, c in arcs:
        a, b = (t, s) if back else (s, t)
        out[b] = min(out[b], cost[a] + c)
    return out


def _inserted(cost: list[int], back: bool) -> list[int]:
    """The same layer after any number of insertions: three reach whatever more could."""
    for _ in range(3):
        cost = [min(x, y) for x, y in zip(cost, _relax(cost, INSERTS, back), strict=True)]
    return cost


def _layers(codes: list[int], back: bool) -> tuple[np.ndarray, np.ndarray]:
    """Minimum costs of each layer, less the layer's least (which is the second array): differences fit in a byte."""
    n = len(codes)
    costs, least = np.zeros((n + 1, 4), np.uint8), np.zeros(n + 1, np.int64)
    now, base = _inserted([0 if s in (ENDS if back else (0,)) else FAR for s in range(4)], back), 0
    known: dict[tuple[int, ...], tuple[list[int], int]] = {}
    costs[n if back else 0] = now
    for i in range(n - 1, -1, -1) if back else range(1, n + 1):
        key = (codes[i if back else i - 1], *now)
        if key not in known:
            step = _inserted(_relax(now, ARCS[key[0]], back), back)
            known[key] = ([min(x - min(step), FAR) for x in step], min(step))
        now, low = known[key]
        base += low
        costs[i], least[i] = now, base
    return costs, least


def cheapest(codes: list[int]) -> tuple[str, int]:
    """The audit and its cost. codes: places in LETTERS."""
    ahead, ahead_least = _layers(codes, False)
    after, after_least = _layers(codes, True)
    cost = int(after[0][0]) + int(after_least[0])
    spent = lambda i, s: int(ahead[i][s]) + int(ahead_least[i])
    left = lambda i, s: int(after[i][s]) + int(after_least[i])
    audit, frontier = [], {(0, 0)}
    while not any(i == len(codes) and s in ENDS and spent(i, s) == cost for i, s in frontier):
        found: dict[str, set[tuple[int, int]]] = {}
        for i, s in frontier:
            arcs = [(letter, i, t, c) for letter, a, t, c in INSERTS if a == s]
            if i < len(codes):
                arcs += [(letter, i + 1, t, c) for letter, a, t, c in ARCS[codes[i]] if a == s]
            for letter, j, t, c in arcs:
                if spent(i, s) + c + left(j, t) == cost:  # tight
                    found.setdefault(letter, set()).add((j, t))
        letter = min(found)
        audit.append(letter)
        frontier = found[letter]
    return "".join(audit), cost


def audits(said: DataFrame) -> DataFrame:
    """conv_id, blocks, the counts of faults, and illegal, cost, audit, and edits: the letters of each block, insertions with the turn they precede."""
    counted = ["conv_id", "blocks", "blank", "duplicate", "truncated"]
    names = [*counted, "illegal", "cost", "audit", "edits"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for blocks, text in zip(b.column(b.schema.get_field_index("blocks")).to_pylist(), b.column(b.schema.get_field_index("said")).to_pylist(), strict=True):
                codes = [LETTERS.index(c) for c in text]
                initials = [INITIALS[c // 3] for c in codes]
                audit, cost = cheapest(codes)
                rows.append((sum(x + y not in ("su", "ua", "au") for x, y in zip(initials, initials[1:])), cost, audit, _dealt(audit, [x["n"] for x in blocks])))
            more = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.list_(pa.string())))]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in counted), *more], names)

    kinds = {f.name: f.dataType.simpleString() for f in said.schema.fields}
    return said.select(*counted, "said").mapInArrow(tidy(run), ", ".join(f"{c} {kinds[c]}" for c in counted) + ", illegal long, cost long, audit string, edits array<string>")


def _dealt(audit: str, sizes: list[int]) -> list[str]:
    """The audit cut by blocks; what is inserted at the end stays with the last one."""
    out, at = [], 0
    for size in sizes:
        begin = at
        while size:
            size -= audit[at] != "I"
            at += 1
        out.append(audit[begin:at])
    if out:
        out[-1] += audit[at:]
    return out


class _Writer:
    """Repaired lines of one conversation after another, from a sorted stream of blocks' edits and turns."""

    def __init__(self) -> None:
        self.conversation: object = self
        self.state, self.edits, self.at = 0, "", 0

    def _one(self, role: str, text: str) -> tuple[str, str]:
        self.state = {"s": 1, "u": 2, "a": 3}[role[:1]]
        return role, text

    def _inserted(self) -> Iterator[tuple[str, str]]:
        while self.at < len(self.edits) and self.edits[self.at] == "I":
            self.at += 1
            yield self._one(ROLE_OF[NEXT[self.state]], "")

    def begin(self, conversation: object) -> None:
        self.conversation, self.state, self.edits, self.at = conversation, 0, "", 0

    def block(self, edits: str) -> Iterator[tuple[str, str]]:
        self.edits, self.at = edits, 0
        yield from self._inserted()

    def turn(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        yield from self._inserted()
        letter = self.edits[self.at]
        self.at += 1
        if letter != "D":
            yield self._one(role if letter == "K" else ROLE_OF[NEXT[self.state]], text)
        yield from self._inserted()


def _stream(turns: DataFrame, found: DataFrame) -> DataFrame:
    """Each block's edits right before its turns, in the order of conversations; a conversation streams through one task."""
    blocks = found.select("conv_id", F.explode(F.arrays_zip("blocks", "edits")).alias("b")).select("conv_id", F.col("b.blocks.block").alias("block"), F.lit(-1).cast("long").alias("id"), F.col("b.edits").alias("edits"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"))
    rows = turns.select("conv_id", F.shiftright("id", 10).alias("block"), "id", F.lit(None).cast("string").alias("edits"), "role", "text")
    return blocks.unionByName(rows).repartition("conv_id").sortWithinPartitions("conv_id", "block", "id").select("conv_id", "edits", "role", "text")


def _events(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, bool, str, str]]:
    """(conv_id, whether the conversation begins, role, text) of each repaired turn; a conversation without one begins with an empty role."""
    writer = _Writer()
    for b in batches:
        for conv, edits, role, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if conv != writer.conversation:
                writer.begin(conv)
                yield conv, True, "", ""
            for x in writer.block(edits) if edits is not None else writer.turn(role, text):
                yield conv, False, *x


def repaired(turns: DataFrame, found: DataFrame) -> DataFrame:
    """conv_id, place (from 0), role, text of the repaired conversations."""
    kind = turns.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, place, names = [], 0, ("conv_id", "place", "role", "text")
        for conv, begins, role, text in _events(batches):
            if begins:
                place = 0
                continue
            rows.append((conv, place, role, text))
            place += 1
            if len(rows) == 1000:
                yield _batch(rows, *names)
                rows = []
        if rows:
            yield _batch(rows, *names)

    return _stream(turns, found).mapInArrow(tidy(run), f"conv_id {kind}, place long, role string, text string")


def _batch(rows: list[tuple], *names: str) -> pa.RecordBatch:
    kinds = {"place": pa.int64(), "role": pa.string(), "text": pa.string()}
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds.get(n)) for i, n in enumerate(names)], list(names))


def digests(turns: DataFrame, found: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256: taken while the turns stream past."""
    kind = turns.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, now, digest, empty = [], None, None, True
        for conv, begins, role, text in chain(_events(batches), [(None, True, "", "")]):
            if begins:
                if digest is not None:
                    rows.append((now, digest.hexdigest()))
                now, digest, empty = conv, hashlib.sha256(), True
                if len(rows) == 1000:
                    yield _batch(rows, "conv_id", "repaired_sha256")
                    rows = []
            else:
                digest.update((("" if empty else "\n") + f"{role}:{text}").encode())
                empty = False
        if rows:
            yield _batch(rows, "conv_id", "repaired_sha256")

    return _stream(turns, found).mapInArrow(tidy(run), f"conv_id {kind}, repaired_sha256 string")


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, found): the turns in order with their ids, and each conversation's audit with what was found. repaired() gives the turns after the edits."""
    turns = _sorted(rows)
    return turns, staged(audits(strings(letters(turns))), "audits")


def digest(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """What the contract of op12 asks for. ids: conv_id, each of which gets a row."""
    turns, found = repair(rows)
    span = turns.groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps"))
    all_ids = ids.select("conv_id").distinct()
    key = lambda df, n: df.withColumnRenamed("conv_id", n)
    out = all_ids
    for i, df in enumerate((found.drop("blocks", "edits"), span, digests(turns, found))):
        out = out.join(key(df, f"_c{i}"), F.col("conv_id").eqNullSafe(F.col(f"_c{i}")), "left").drop(f"_c{i}")
    whole = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return out.select("conv_id", *map(whole, ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
