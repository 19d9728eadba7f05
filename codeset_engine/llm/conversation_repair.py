"""Conversation structure repair over a suffix-shared automaton of all conversations.

A conversation's rows become one letter each (role initial and fault), its signature. Signatures
are range-sorted by their reversed form, so conversations that end alike lie next to each other.
A task walks its range with a stack of automaton nodes: one node is one suffix, and what the next
signature shares from the end with the one before stays on the stack. So the cost to go, and the
first edit of the best audit, are found once per node and grammar state, not once per conversation.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import Scratch

BLANKS = " \t\n\x0b\f\r"
REROLE, INSERT, DELETE, TRUNCATED = 3, 3, 4, 3   # costs of edits, and of a truncated row that stays
ROLES = {"u": "user", "a": "assistant"}
DOOMED = "x"    # the letter of a blank or duplicate row; truncated rows have a capital letter

# Grammar states: 0 nothing yet, 1 after system, 2 after user, 3 after assistant; 0 and 3 may end.
# The role that may come next, besides a system at the start, and the state it leads to.
_NEXT = (("u", 2), ("u", 2), ("a", 3), ("u", 2))
_NEVER = 1 << 60

Node = tuple[tuple[int, ...], str]     # cost to go and first edit ("." for none) by state


def _closed(costs: list[int], edits: list[str]) -> Node:
    """The node once rows may be inserted in front of it; the smaller letter wins a tie."""
    before = [*costs]
    for state in (2, 3, 0, 1):          # an insertion after another leads to 2 or 3 only
        to = _NEXT[state][1]
        cost = INSERT + (before[to] if state > 1 else costs[to])
        if (cost, "I") < (costs[state], edits[state]):
            costs[state], edits[state] = cost, "I"
    return tuple(costs), "".join(edits)


END: Node = _closed([0, _NEVER, _NEVER, 0], [".", "~", "~", "."])


def extend(letter: str, after: Node) -> Node:
    """The node of a row in front of the suffix of ``after``."""
    costs, edits, role = [], [], letter.lower()
    stays = TRUNCATED if letter.isupper() else 0
    for state, (wanted, to) in enumerate(_NEXT):
        options = [(DELETE + after[0][state], "D")]
        if letter != DOOMED:
            options.append((stays + REROLE + after[0][to], "R"))
            if role == wanted:
                options.append((stays + after[0][to], "K"))
            elif role == "s" and state == 0:
                options.append((stays + after[0][1], "K"))
        cost, edit = min(options)
        costs.append(cost)
        edits.append(edit)
    return _closed(costs, edits)


def best_edits(signature: str, nodes: list[Node]) -> Iterator[tuple[str, str, int]]:
    """(edit, role initial or "", row number or 0) in order; ``nodes[k]`` has the last k rows."""
    state, left = 0, len(signature)
    while (edit := nodes[left][1][state]) != ".":
        row = len(signature) - left + 1
        if edit == "D":
            yield edit, "", row
        elif edit == "K" and state == 0 and signature[row - 1].lower() == "s":
            yield edit, "s", row
            state = 1
        else:
            wanted, state = _NEXT[state]
            yield edit, wanted, 0 if edit == "I" else row
        left -= edit != "I"


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    nodes, last = [END], ""
    for batch in batches:
        out = []
        for reverse in batch["reverse"].to_pylist():
            same = 0
            for x, y in zip(last, reverse):
                if x != y:
                    break
                same += 1
            del nodes[same + 1:]
            for letter in reverse[same:]:
                nodes.append(extend(letter, nodes[-1]))
            last = reverse
            edits = list(best_edits(reverse[::-1], nodes))
            out.append({"cost": nodes[-1][0][0], "audit": "".join(e for e, _, _ in edits),
                        "edits": [{"edit": e, "role": r, "row": n or None} for e, r, n in edits if e != "D"]})
        solved = pa.array(out, pa.struct([("cost", pa.int64()), ("audit", pa.string()), ("edits", pa.list_(
            pa.struct([("edit", pa.string()), ("role", pa.string()), ("row", pa.int32())])))]))
        yield pa.RecordBatch.from_arrays([*batch.columns, solved], [*batch.schema.names, "solved"])


def _letters(rows: DataFrame) -> DataFrame:
    """The rows numbered within their conversation, with initial, faults and letter."""
    bare = F.rtrim("text", F.lit(BLANKS))
    in_order = Window.partitionBy("id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    seen = Window.partitionBy("id", "role", "text").orderBy("n")
    numbered = rows.withColumn("n", F.row_number().over(in_order))
    blank = bare == ""
    again = F.row_number().over(seen) > 1
    cut = ~F.right(bare, F.lit(1)).isin(".", "!", "?")
    fault = F.when(blank, "blank").when(again, "duplicate").when(cut, "truncated")
    initial = F.substring("role", 1, 1)
    known = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    letter = (F.when(F.col("fault").isin("blank", "duplicate"), DOOMED)
              .when(F.col("fault") == "truncated", F.upper(known)).otherwise(known))
    return (numbered.withColumn("fault", fault).withColumn("initial", initial)
            .withColumn("letter", letter))


def repair_conversations(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn",
                         role_col: str = "role", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(report, repaired): one row per conversation, and the rows of the repaired conversations.

    ``report``: ``id_col``, gaps, blank, duplicate, truncated, illegal, cost, audit. Rows are
    taken by turn (null first), then role and text. A row's first fault counts: blank (only ASCII
    white space), duplicate (role and text seen earlier in the conversation) or truncated (its last
    other character is not ``.``, ``!`` or ``?``). ``gaps`` counts turn numbers that are missing
    between the least and the largest, ``illegal`` neighbours whose role initials are not su, ua or
    au. ``audit`` has the initials of the cheapest edits (Keep, Rerole, Delete, Insert) that lead
    to an optional system row and one or more pairs of user and assistant, or to nothing; of equally
    cheap ones it is the least in ASCII order.

    ``repaired``: ``id_col``, position (from 1), role, text, edit. Inserted rows have empty texts.
    A conversation of which all rows are deleted has none.

    Null roles and texts count as one space, null turns come first and count for no gap, rows with
    a null id form one conversation, repeated rows are duplicates. Roles of other initials than s,
    u and a can only be reroled or deleted. An empty table gives empty results; other columns are
    ignored. A task holds the letters of a conversation, one per row, never its texts.
    """
    scratch = Scratch(turns.sparkSession, "repair")
    rows = scratch.save(_letters(turns.select(
        F.col(id_col).alias("id"), F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit(" ")).alias("text"))), "rows")

    in_order = Window.partitionBy("id").orderBy("n")
    pair = F.concat(F.lag("initial").over(in_order), "initial")
    told = rows.select(
        "id", "n", "turn", "fault", "letter", (~pair.isin("su", "ua", "au")).alias("illegal"),
        (F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(F.lag("turn").over(in_order))).alias("new_turn"))
    number = lambda condition: F.count_if(condition).alias
    counted = told.groupBy("id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_if("new_turn"), F.lit(0)).alias("gaps"),
        *[number(F.col("fault") == f)(f) for f in ("blank", "duplicate", "truncated")],
        number(F.col("illegal"))("illegal"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.negative("n"), "letter"))),
                                 lambda x: x["letter"]), "").alias("reverse"))
    solved_type = "struct<cost:bigint,audit:string,edits:array<struct<edit:string,role:string,row:int>>>"
    ranged = counted.repartitionByRange("reverse", F.xxhash64("id")).sortWithinPartitions("reverse")
    solved = scratch.save(ranged.mapInArrow(
        _walk, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in counted.schema)
        + f", solved {solved_type}"), "solved")
    report = solved.select(F.col("id").alias(id_col), "gaps", "blank", "duplicate", "truncated", "illegal",
                           "solved.cost", "solved.audit")
    return report, _repaired(solved, rows, id_col)


def _repaired(solved: DataFrame, rows: DataFrame, id_col: str) -> DataFrame:
    edits = solved.select("id", F.posexplode("solved.edits").alias("at", "e"))
    own = rows.select(F.col("id").alias("own_id"), F.col("n").alias("own_n"),
                      F.col("role").alias("own_role"), "text")
    named: Column = F.when(F.col("e.role") == "u", ROLES["u"]).otherwise(ROLES["a"])
    return (edits.join(own, F.col("id").eqNullSafe(F.col("own_id")) & (F.col("e.row") == F.col("own_n")), "left")
            .select(F.col("id").alias(id_col), (F.col("at") + 1).alias("position"),
                    F.when(F.col("e.edit") == "K", F.col("own_role")).otherwise(named).alias("role"),
                    F.coalesce("text", F.lit("")).alias("text"), F.col("e.edit").alias("edit")))
