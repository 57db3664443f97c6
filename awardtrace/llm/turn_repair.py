"""Conversation structure repair.

Rows of a conversation, in order, are kept, given another role or deleted, and empty
turns inserted, so that the roles read as an optional system turn and pairs of user and
assistant. A node is a place between rows and the last role there; an edit is an arc
with a cost. The cost program runs backwards and marks the arcs of cheapest ways. These
arcs are then ranked by the least audit of 1, 2, 4, ... letters that begins with them,
each round from the ranks of the last and its doubled pointers, and the way of the least
rank is read off through the pointers.

Rows are dealt out in ranges of (conversation, turn) and worked on in blocks, so that a
conversation may be of any length. What a block does to a conversation that goes on in
the next one is a table of costs from role to role; passing along these tables, which is
a row per block, gives the cost behind each block and the role at its start.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from awardtrace.llm.common import quoted, stage

#: Costs of the edits; an undeleted truncated row adds one.
RENAME, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: Rows that are worked on together.
BLOCK = 4096

# Initials of roles by number; any other one is 3.
_INITIALS = "sua"
# States: nothing yet, behind system, behind user, behind assistant.
NEXT = np.array([2, 2, 3, 2])  # what an inserted or renamed turn leads to
AT_END = np.array([0, 4, 2, 0])  # cheapest insertions up to a complete conversation
_LEADS = np.array([[1, -1, -1, -1], [2, 2, -1, 2], [-1, -1, 3, -1], [-1, -1, -1, -1]])  # kept rows, by initial and state
_LEGAL = np.zeros((4, 4), dtype=bool)
_LEGAL[[0, 1, 2], [1, 2, 1]] = True  # su, ua, au
#: Faults by number.
SOUND, BLANK, DUPLICATE, CUT_OFF = range(4)
#: In their place, rows that say something of others: the one at the same position is the first of its kind; costs.
MARK, GIVEN = -1, -2
_NEVER = 1 << 40
# Letters in ASCII order: delete, insert, keep, rename.
LETTERS = np.frombuffer(b"DIKR", dtype=np.uint8)
_NAMES = {1: "user", 2: "user", 3: "assistant"}


# --- rows -----------------------------------------------------------------------------------------


def damaged(rows: DataFrame) -> DataFrame:
    """The rows with ``_conv, _turn, _role, _text`` after damage, and ``_gone`` for those it drops.

    CRC-32 of ``conversation:turn`` modulo 20 decides: 0 drops a row, 1 empties its text, 2
    takes the marks ``.!?`` out, 3 repeats it, 4 makes its role user. A null is one space.
    """
    conv = F.when(F.col("_conv") == "", " ").otherwise(F.substring("_conv", 2, F.length("_conv")))
    turn = F.coalesce(F.col("_turn").cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(conv, F.lit(":"), turn).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace("_text", "[.!?]", "")).otherwise(F.col("_text"))
    role = F.when(kind == 4, "user").otherwise(F.col("_role"))
    done = rows.withColumns({"_gone": kind == 0, "_times": F.when(kind == 3, 2).otherwise(1), "_new": text, "_as": role})
    again = done.withColumn("_time", F.explode(F.sequence(F.lit(1), F.col("_times"))))
    return again.select("_conv", "_turn", F.col("_as").alias("_role"), F.col("_new").alias("_text"), "_gone")


def read(rows: DataFrame, conversation: str, turn: str, role: str, text: str) -> DataFrame:
    """``_conv, _turn, _role, _text``; a null role or text is one space. Conversations are texts here, null the empty one."""
    name = F.coalesce(F.concat(F.lit("="), quoted(conversation).cast("string")), F.lit(""))
    return rows.select(name.alias("_conv"), quoted(turn).cast("long").alias("_turn"),
                       F.coalesce(quoted(role).cast("string"), F.lit(" ")).alias("_role"),
                       F.coalesce(quoted(text).cast("string"), F.lit(" ")).alias("_text"))


#: The order of a conversation's rows; those of one turn stand by role, then by the hash of their text.
_ORDER = ["_known", "_turn", "_role", "_hash"]


def _order_columns() -> dict[str, Column]:
    return {"_known": F.col("_turn").isNotNull(), "_turn": F.coalesce("_turn", F.lit(0).cast("long")),
            "_hash": F.unhex(F.sha2("_text", 256))}


def _ordered(rows: DataFrame) -> DataFrame:
    """Rows without texts in order, written with their ``pos``, which grows along the order."""
    initial = F.substring("_role", 1, 1)
    number = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    last = F.substring(F.rtrim("_text", F.lit(" \t\n\x0b\x0c\r")), -1, 1)
    fault = F.when(last == "", BLANK).when(last.isin(".", "!", "?"), SOUND).otherwise(CUT_OFF)
    narrow = rows.withColumns({**_order_columns(), "initial": number, "fault": fault}).drop("_text")
    narrow = narrow.withColumn("_place", F.monotonically_increasing_id())  # spreads rows that are alike
    keys = ["_conv", *_ORDER, "_place"]
    ranged = narrow.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_place")
    return stage(ranged.withColumn("pos", F.monotonically_increasing_id()), "repair-rows")


def _in_blocks(ordered: DataFrame) -> DataFrame:
    """Rows with ``block``, and a marker row beside each that is the first of its conversation, role and text."""
    seen = ordered.where(F.col("fault") != BLANK).groupBy("_conv", "_role", "_hash").agg(F.min("pos").alias("pos"))
    # Whole numbers have no nulls, as these would turn them into doubles in Python.
    marks = seen.select("_conv", F.lit(False).alias("_known"), F.lit(0).cast("long").alias("_turn"),
                        F.lit(0).alias("initial"), F.lit(MARK).alias("fault"), "pos")
    rows = ordered.select("_conv", "_known", "_turn", "initial", "fault", "pos").unionByName(marks)
    within = F.floor(F.col("pos").bitwiseAND((1 << 33) - 1) / F.lit(BLOCK))
    return rows.withColumn("block", F.shiftright("pos", 33) * F.lit(1 << 33) + within)


# --- one block ------------------------------------------------------------------------------------


class Block:
    """Rows of a block in order, as arrays, with the bounds of its conversations."""

    def __init__(self, df: pd.DataFrame):
        df = df.sort_values("pos", kind="stable")
        marker = df["fault"].to_numpy() == MARK
        rows, pos = df[~marker], df["pos"].to_numpy()
        first = np.isin(pos[~marker], pos[marker])
        self.initial = rows["initial"].to_numpy(dtype=np.int64)
        fault = rows["fault"].to_numpy(dtype=np.int64)
        self.fault = np.where((fault != BLANK) & ~first, DUPLICATE, fault)
        self.turn, self.known = rows["_turn"].to_numpy(), rows["_known"].to_numpy(dtype=bool)
        conv = rows["_conv"].to_numpy()
        self.begin = np.flatnonzero(np.r_[True, conv[1:] != conv[:-1]])
        self.end = np.r_[self.begin[1:], len(rows)]
        self.conv = conv[self.begin]

    def part(self, chosen: list[int]) -> "Block":
        """The same with some of the conversations only."""
        rows = np.concatenate([np.arange(self.begin[i], self.end[i]) for i in chosen])
        own = object.__new__(Block)
        for name in ("initial", "fault", "turn", "known"):
            setattr(own, name, getattr(self, name)[rows])
        size = (self.end - self.begin)[chosen]
        own.end = np.cumsum(size)
        own.begin, own.conv = own.end - size, self.conv[chosen]
        return own

    def nodes(self) -> np.ndarray:
        """The place before each row among all places; a conversation has one more behind its last row."""
        return np.arange(len(self.initial)) + np.repeat(np.arange(len(self.begin)), self.end - self.begin)

    def step_costs(self) -> tuple[np.ndarray, np.ndarray]:
        """For rows and states: what keeping costs and what renaming costs."""
        lost = np.where(self.fault == CUT_OFF, TRUNCATED, 0)
        lost = np.where((self.fault == BLANK) | (self.fault == DUPLICATE), _NEVER, lost)[:, None]
        keep = np.where(_LEADS[self.initial] >= 0, lost, _NEVER)
        return keep, np.broadcast_to(lost + RENAME, keep.shape)

    def costs(self, at_end: np.ndarray) -> np.ndarray:
        """The cheapest way from each place and state on, given the costs behind the last row of each conversation."""
        places = len(self.initial) + len(self.begin)
        cost = np.full((places, 4), _NEVER, dtype=np.int64)
        behind = self.end + np.arange(len(self.begin))
        cost[behind] = at_end
        keep, rename = self.step_costs()
        size, node = self.end - self.begin, self.nodes()
        by_size = np.argsort(-size, kind="stable")
        for back in range(1, int(size.max()) + 1):
            own = by_size[:np.searchsorted(-size[by_size], -back, side="right")]
            row = self.end[own] - back
            after = cost[node[row] + 1]
            kept = np.take_along_axis(after, np.maximum(_LEADS[self.initial[row]], 0), 1) + keep[row]
            best = np.minimum(np.minimum(kept, after[:, NEXT] + rename[row]), after + DELETE)
            once = np.minimum(best, best[:, NEXT] + INSERT)
            cost[node[row]] = np.minimum(np.minimum(once, once[:, NEXT] + INSERT), _NEVER)
        return cost

    def audits(self, at_end: np.ndarray, closed: np.ndarray) -> tuple[np.ndarray, list[list[str]], np.ndarray]:
        """Cost from each conversation's start, and for each state there the least cheapest audit and where it leads.

        ``closed`` tells which conversations end in this block; behind the others no turn is inserted here.
        """
        cost = self.costs(at_end)
        arcs = _arcs(self, cost, closed)
        first = self.begin + np.arange(len(self.begin))
        entries = (first[:, None] * 4 + np.arange(4)).ravel()
        words, ends = least_ways(*arcs, entries, cost.size)
        leads = np.where(ends >= 0, ends % 4, -1).reshape(-1, 4)
        return cost[first], [words[i:i + 4] for i in range(0, len(words), 4)], leads


def _arcs(block: Block, cost: np.ndarray, closed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``tail, letter, head`` of all arcs on cheapest ways; a node is four times its place plus its state."""
    keep, rename = block.step_costs()
    node = block.nodes()
    own, after = cost[node], cost[node + 1]
    state = np.broadcast_to(np.arange(4), own.shape)
    lead = _LEADS[block.initial]
    kept = np.take_along_axis(after, np.maximum(lead, 0), 1) + keep
    inner = np.concatenate([node, (block.end + np.arange(len(block.begin)))[closed]])
    found = []
    for letter, place, fits, to_place, to_state in (
            (0, node, own == after + DELETE, node + 1, state),
            (1, inner, cost[inner] == cost[inner][:, NEXT] + INSERT, inner, np.broadcast_to(NEXT, (len(inner), 4))),
            (2, node, (lead >= 0) & (own == kept), node + 1, lead),
            (3, node, own == after[:, NEXT] + rename, node + 1, np.broadcast_to(NEXT, own.shape))):
        row, q = np.nonzero(fits & (cost[place] < _NEVER))
        found.append((place[row] * 4 + q, np.full(len(row), letter), to_place[row] * 4 + to_state[row, q]))
    return tuple(np.concatenate(c) for c in zip(*found))


def least_ways(tail: np.ndarray, letter: np.ndarray, head: np.ndarray, entries: np.ndarray,
               nodes: int) -> tuple[list[str], np.ndarray]:
    """The least word along arcs from each entry to a node without arcs, and that node (-1: no arc to begin with).

    Arcs are ranked by the least word of 1, 2, 4, ... letters that begins with them; an
    ended word is the less. An arc points to the best-ranked arc of its head, then to the
    arc two, four, ... letters on. Arcs out of one node differ in their letter, so the
    pointer chosen by the first letter stays the best one in all rounds.
    """
    count = len(tail)
    rank = letter + 1  # 0 is the end of a word
    order = np.lexsort((rank, tail))
    opens = np.r_[True, tail[order][1:] != tail[order][:-1]] if count else np.zeros(0, dtype=bool)
    best = np.full(nodes, count)  # the arc number ``count`` stands for the end
    best[tail[order][opens]] = order[opens]
    rank = np.r_[rank, 0]
    pointers = [np.r_[best[head], count]]
    left = np.r_[np.ones(count, dtype=np.int64), 0]  # letters up to the pointer
    while (pointers[-1] != count).any():
        there = pointers[-1]
        rank = np.unique(rank * np.int64(count + 2) + rank[there], return_inverse=True)[1]
        left = left + left[there]
        pointers.append(there[there])
    left = left + left[pointers[-1]]
    # The best-ranked arc out of each entry; ranks now cover whole words.
    order = np.lexsort((rank[:count], tail))
    opens = np.r_[True, tail[order][1:] != tail[order][:-1]] if count else np.zeros(0, dtype=bool)
    best[tail[order][opens]] = order[opens]
    start = best[entries]
    sizes = left[start]
    owner = np.repeat(np.arange(len(entries)), sizes)
    step = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    at = start[owner]
    for k, pointer in enumerate(pointers):  # the arc ``step`` letters on, by the bits of ``step``
        at = np.where(step >> k & 1, pointer[at], at)
    word = LETTERS[letter[at]].tobytes().decode("ascii") if len(at) else ""
    edges = np.r_[0, np.cumsum(sizes)]
    ends = np.full(len(entries), -1)
    some = sizes > 0
    ends[some] = head[at[edges[1:][some] - 1]]
    return [word[a:b] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())], ends


def _summary(block: Block) -> dict[str, np.ndarray]:
    """Numbers of each conversation's rows in the block, and what is needed to add up those of several blocks."""
    apart = np.zeros(len(block.initial), dtype=bool)  # rows that the one before them may not precede
    apart[1:] = ~_LEGAL[block.initial[:-1], block.initial[1:]]
    apart[block.begin] = False
    fresh = block.known.copy()  # rows with a turn that the one before them has not
    fresh[1:] &= ~block.known[:-1] | (block.turn[1:] != block.turn[:-1])
    fresh[block.begin] = block.known[block.begin]
    count = lambda flags: np.add.reduceat(flags.astype(np.int64), block.begin)
    low, high = np.iinfo(np.int64).min, np.iinfo(np.int64).max
    return {
        "blank": count(block.fault == BLANK), "duplicate": count(block.fault == DUPLICATE),
        "truncated": count(block.fault == CUT_OFF), "illegal": count(apart), "turns": count(fresh),
        "least_turn": np.minimum.reduceat(np.where(block.known, block.turn, high), block.begin),
        "most_turn": np.maximum.reduceat(np.where(block.known, block.turn, low), block.begin),
        "first_initial": block.initial[block.begin], "last_initial": block.initial[block.end - 1],
    }


# --- conversations over several blocks ------------------------------------------------------------

_SUMMARY = ("blank long, duplicate long, truncated long, illegal long, turns long, least_turn long, most_turn long, "
            "first_initial int, last_initial int")
_COUNTS = ["blank", "duplicate", "truncated", "illegal"]


def _edges(block: Block) -> list[int]:
    """The first and the last conversation of a block, which may go on in others."""
    return sorted({0, len(block.begin) - 1})


def _tables(df: pd.DataFrame) -> pd.DataFrame:
    """What a block costs those of its conversations that may go on elsewhere, from each state to each state."""
    block = Block(df)
    part = block.part(_edges(block))
    first = part.begin + np.arange(len(part.begin))
    ways = [part.costs(np.where(np.arange(4) == q, 0, _NEVER))[first] for q in range(4)]
    table = np.stack(ways, axis=-1)  # conversation, state at the start, state at the end
    return pd.DataFrame({"_conv": part.conv, "block": df["block"].iloc[0], "costs": [t.astype("<i8").tobytes() for t in table]})


def _behind(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Tables in the order of (conversation, descending block) to the costs behind each block."""
    conv, costs = None, AT_END
    for df in batches:
        out = []
        for own, block, table in zip(df["_conv"], df["block"].tolist(), df["costs"]):
            closes = own != conv
            if closes:
                conv, costs = own, AT_END
            out.append((own, block, costs.astype("<i8").tobytes(), closes))
            costs = np.minimum((np.frombuffer(table, dtype="<i8").reshape(4, 4) + costs).min(1), _NEVER)
        yield pd.DataFrame(out, columns=["_conv", "block", "costs", "closes"])


def _solved(df: pd.DataFrame) -> pd.DataFrame:
    """The rows of a block and the costs behind it to audits and numbers."""
    given = (df["fault"] == GIVEN).to_numpy()
    block = Block(df[~given])
    at_end, closed = np.tile(AT_END, (len(block.begin), 1)), np.ones(len(block.begin), dtype=bool)
    edges = _edges(block)
    known = {conv: (costs, closes) for conv, costs, closes in zip(*(df[c][given] for c in ("_conv", "costs", "closes")))}
    for i in edges:
        at_end[i] = np.frombuffer(known[block.conv[i]][0], dtype="<i8")
        closed[i] = known[block.conv[i]][1]
    cost, audits, leads = block.audits(at_end, closed)
    alone = np.ones(len(block.begin), dtype=bool)
    alone[edges] = False
    audits = [words[:1] if one else words for words, one in zip(audits, alone)]
    return pd.DataFrame({"_conv": block.conv, "block": df["block"].iloc[0], "alone": alone, "cost": cost[:, 0],
                         "audits": audits, "leads": list(leads.astype(np.int32)), **_summary(block)})


def _gaps(turns: int, least: int, most: int) -> int:
    return min(most - least + 1 - turns, np.iinfo(np.int64).max) if turns else 0


_REPORT = "_conv string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Results of blocks in the order of (conversation, block) to one row per conversation."""
    def report(of: dict) -> tuple:
        return (of["_conv"], _gaps(of["turns"], of["least_turn"], of["most_turn"]), *(of[c] for c in _COUNTS), of["cost"],
                "".join(of["audit"]))

    columns, total = [c.split()[0] for c in _REPORT.split(", ")], None
    for df in batches:
        out = []
        for own in df.to_dict("records"):
            if total is None or own["_conv"] != total["_conv"]:
                if total is not None:
                    out.append(report(total))
                total, state = dict(own, audit=[own["audits"][0]]), 0
            else:
                state = total["state"]
                for c in _COUNTS:
                    total[c] += own[c]
                total["illegal"] += not _LEGAL[total["last_initial"], own["first_initial"]]
                if total["turns"] and own["turns"]:
                    total["turns"] += own["turns"] - (total["most_turn"] == own["least_turn"])
                else:
                    total["turns"] += own["turns"]
                total["least_turn"] = min(total["least_turn"], own["least_turn"])
                total["most_turn"] = max(total["most_turn"], own["most_turn"])
                total["last_initial"] = own["last_initial"]
                total["audit"].append(own["audits"][state])
            total["state"] = int(own["leads"][state])
        yield pd.DataFrame(out, columns=columns)
    if total is not None:
        yield pd.DataFrame([report(total)], columns=columns)


def audited(rows: DataFrame) -> DataFrame:
    """``_conv, gaps, blank, duplicate, truncated, illegal, cost, audit`` of the conversations that have rows."""
    blocks = _in_blocks(_ordered(rows))
    tables = blocks.groupBy("block").applyInPandas(_tables, "_conv string, block long, costs binary")
    ends = tables.repartition("_conv").sortWithinPartitions("_conv", F.desc("block")).mapInPandas(
        _behind, "_conv string, block long, costs binary, closes boolean")
    given = {"_known": F.lit(False), "_turn": F.lit(0).cast("long"), "initial": F.lit(0), "fault": F.lit(GIVEN),
             "pos": F.lit(0).cast("long")}
    both = blocks.withColumns({"costs": F.lit(None).cast("binary"), "closes": F.lit(False)}).unionByName(ends.withColumns(given))
    solved = stage(both.groupBy("block").applyInPandas(
        _solved, f"_conv string, block long, alone boolean, cost long, audits array<string>, leads array<int>, {_SUMMARY}"),
        "repair-blocks")
    some = F.col("turns") > 0
    gaps = F.when(some, F.try_subtract("most_turn", "least_turn") + 1 - F.col("turns")).otherwise(0).cast("long")
    alone = solved.where("alone").select("_conv", gaps.alias("gaps"), *_COUNTS, "cost", F.col("audits")[0].alias("audit"))
    shared = solved.where("NOT alone").repartition("_conv").sortWithinPartitions("_conv", "block")
    return alone.unionByName(shared.mapInPandas(_joined, _REPORT))


# --- repaired conversations -----------------------------------------------------------------------


def _walked(digest_only: bool):
    """Each conversation's report, then its rows in order, to the repaired turns, or their hash only.

    A conversation passes through as a stream: nothing is held of it but its audit.
    """
    columns = ["_conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]

    class Walk:
        def __init__(self, report: dict):
            self.report, self.at, self.state = report, 0, 0
            self.audit = report["audit"] or ""
            self.hash, self.lines = hashlib.sha256(), 0

        def add(self, role: str, text: str) -> tuple:
            line = f"{role}:{text}"
            self.hash.update((("\n" if self.lines else "") + line).encode("utf-8", "surrogatepass"))
            self.lines += 1
            return self.report["_conv"], self.lines - 1, role, text

        def inserted(self) -> Iterator[tuple]:
            while self.audit[self.at:self.at + 1] == "I":
                self.at, self.state = self.at + 1, int(NEXT[self.state])
                yield self.add(_NAMES[self.state], "")

        def row(self, role: str, text: str) -> Iterator[tuple]:
            yield from self.inserted()
            edit = self.audit[self.at]
            self.at += 1
            if edit == "K":
                self.state = int(_LEADS[_INITIALS.index(role[0]), self.state])
                yield self.add(role, text)
            elif edit == "R":
                self.state = int(NEXT[self.state])
                yield self.add(_NAMES[self.state], text)

    def walked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        walk: Walk | None = None
        for df in batches:
            turns, reports = [], []
            for own in df.to_dict("records"):
                if walk is None or own["_conv"] != walk.report["_conv"]:
                    if walk is not None:
                        turns += walk.inserted()
                        reports.append(walk)
                    walk = Walk(own if own["audit"] is not None else dict.fromkeys(columns, 0) | {"_conv": own["_conv"], "audit": ""})
                if own["audit"] is None and not own["_gone"]:
                    turns += walk.row(own["_role"], own["_text"])
            yield frame(turns, reports)
        if walk is not None:
            yield frame(list(walk.inserted()), [walk])

    def frame(turns: list[tuple], reports: list) -> pd.DataFrame:
        if digest_only:
            return pd.DataFrame([[w.report[c] for c in columns[:-1]] + [w.hash.hexdigest()] for w in reports], columns=columns)
        return pd.DataFrame(turns, columns=["_conv", "place", "role", "text"])

    return walked


def _walks(rows: DataFrame, digest_only: bool, schema: str) -> DataFrame:
    reports = audited(rows.where(~F.col("_gone")).drop("_gone"))
    texts = rows.withColumns(_order_columns())
    # A conversation's report stands before its rows; dropped rows only say that there is one.
    both = reports.unionByName(texts, allowMissingColumns=True)
    order = ["_conv", F.col("audit").isNull(), *_ORDER]
    needed = ["_conv", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", *_COUNTS, "cost")], "audit", "_gone",
              "_role", "_text"]
    return both.repartition("_conv").sortWithinPartitions(*order).select(*needed).mapInPandas(_walked(digest_only), schema)


def _named(df: DataFrame, rows: DataFrame, conversation: str) -> DataFrame:
    kind = rows.schema[conversation].dataType
    own = F.when(F.col("_conv") != "", F.substring("_conv", F.lit(2), F.length("_conv")).cast(kind))
    return df.select(own.alias(conversation), *[c for c in df.columns if c != "_conv"])


def _prepared(rows: DataFrame, names: tuple[str, str, str, str], damage: bool) -> DataFrame:
    own = read(rows, *names)
    return damaged(own) if damage else own.withColumn("_gone", F.lit(False))


def reports(rows: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
            damage: bool = False) -> DataFrame:
    """Per conversation ``gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``.

    Rows go by turn, null first, then role, then SHA-256 of the text; rows alike in all are
    interchangeable. A null role or text is one space, null conversations are one. A role
    is known by its first letter; s, u and a are. A conversation whose rows are all dropped
    by ``damage`` has zeros, an empty audit and the hash of no text. Conversations and
    texts may be of any length: rows are worked on in blocks, texts pass as a stream to one
    hash, which no machine can share. An empty table gives no rows. Other columns are ignored.
    """
    schema = f"{_REPORT}, repaired_sha256 string"
    own = _prepared(rows, (conversation, turn, role, text), damage)
    return _named(_walks(own, True, schema), rows, conversation)


def repaired(rows: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
             damage: bool = False) -> DataFrame:
    """``conversation, place, role, text``: the turns of each conversation after its cheapest repair, from place 0 on."""
    own = _prepared(rows, (conversation, turn, role, text), damage)
    return _named(_walks(own, False, "_conv string, place long, role string, text string"), rows, conversation)


def op11_turn_repair(spark, sf_dir):
    return reports(spark.read.parquet(f"{sf_dir}/conversations.parquet"), damage=True)


def _sql() -> str:
    """The repair as a forward program over (cost, audit, turns so far) of each state, in place of ranks of arcs."""
    def put(of: str, cost: str, letter: str, line: str = "") -> str:
        line = f" || chr(10) || {line}" if line else ""
        return f"CASE WHEN {of} IS NOT NULL THEN {{'c': {of}.c + {cost}, 'a': {of}.a || '{letter}', 't': {of}.t{line}}} END"

    def least(*of: str) -> str:
        return f"list_min([{', '.join(of)}])"

    keep, user, reply = "x.role || ':' || x.text", "'user:' || x.text", "'assistant:' || x.text"
    step = {q: [put(f"z.{q}", str(DELETE), "D")] for q in "nspa"}  # n: nothing yet, s: system, p: user, a: assistant
    for q, initial, sources in (("s", "s", "n"), ("p", "u", "nsa"), ("a", "a", "p")):
        for source in sources:
            way = put(f"z.{source}", "x.late", "K", keep)
            step[q].append(f"CASE WHEN NOT x.out AND x.role[1] = '{initial}' THEN {way} END")
    for q, line, sources in (("p", user, "nsa"), ("a", reply, "p")):
        for source in sources:
            step[q].append(f"CASE WHEN NOT x.out THEN {put(f'z.{source}', f'{RENAME} + x.late', 'R', line)} END")
    rows = ", ".join(f"'{q}': {least(*ways)}" for q, ways in step.items())
    insert = lambda source, line: put(source, str(INSERT), "I", f"'{line}:'")
    closed = f"""list_transform([list_transform([list_transform([Z],
      lambda z: {{'n': z.n, 's': z.s, 'p': {least('z.p', *(insert(f'z.{q}', 'user') for q in 'nsa'))}, 'a': z.a}})[1]],
      lambda z: {{'n': z.n, 's': z.s, 'p': z.p, 'a': {least('z.a', insert('z.p', 'assistant'))}}})[1]],
      lambda z: {{'n': z.n, 's': z.s, 'p': {least('z.p', insert('z.a', 'user'))}, 'a': z.a}})[1]"""
    way = "STRUCT(c BIGINT, a VARCHAR, t VARCHAR)"
    state = f"STRUCT(n {way}, s {way}, p {way}, a {way})"
    start = f"{{'n': {{'c': 0, 'a': '', 't': ''}}, 's': NULL, 'p': NULL, 'a': NULL}}::{state}"
    return rf"""
WITH RECURSIVE bits(b, v, n) AS (
  SELECT range, range, 0 FROM range(256)
  UNION ALL SELECT b, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, n + 1 FROM bits WHERE n < 8),
crc AS (SELECT list(v ORDER BY b) AS tab FROM bits WHERE n = 8),
named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
kinds AS (
  SELECT * EXCLUDE (name), xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(
           regexp_extract_all(hex(encode(name)), '..'), lambda x: ('0x' || x)::BIGINT)),
           lambda a, x: xor(a >> 8, tab[(xor(a, x) & 255) + 1])), 4294967295) % 20 AS k
  FROM named, crc),
damaged AS (
  SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN k = 1 THEN '' WHEN k = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE WHEN k = 3 THEN 2 ELSE 1 END)) AS again
  FROM kinds WHERE k <> 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), again) AS i,
         regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS last FROM damaged),
faulty AS (
  SELECT *, CASE WHEN last = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
                 WHEN last NOT IN ('.', '!', '?') THEN 'truncated' END AS fault,
         role[1] AS own, lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM placed),
sums AS (
  SELECT conv_id, CASE WHEN count(turn) > 0 THEN max(turn) - min(turn) + 1 - count(DISTINCT turn) ELSE 0 END AS gaps,
         count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (i > 1 AND before || own NOT IN ('su', 'ua', 'au')) AS illegal,
         list({{'role': role, 'text': text, 'out': coalesce(fault IN ('blank', 'duplicate'), false),
               'late': CASE WHEN fault = 'truncated' THEN {TRUNCATED} ELSE 0 END}} ORDER BY i) AS own
  FROM faulty GROUP BY conv_id),
solved AS (
  SELECT * EXCLUDE (own), list_reduce(own, lambda z, x: ({closed.replace('Z', '{' + rows + '}')})::{state},
    ({closed.replace('Z', start)})::{state}) AS z FROM sums),
best AS (SELECT * EXCLUDE (z), list_min([z.n, z.a]) AS best FROM solved)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.c, 0)::BIGINT AS cost,
       coalesce(best.a, '') AS audit, sha256(coalesce(substr(best.t, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) AS c LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM c.conv_id
"""


OP11_SQL = _sql()
