"""Repair of the turn structure of conversations, by an auction algorithm for shortest paths.

A repaired conversation has the role initials `(s?(ua)+)?`. Its lattice has a node for each number of rows passed and each
state of that pattern; the arcs are the edits, with costs in whole numbers: Keep 0, Rerole to user or assistant 3, Delete 4
(the only edit of a blank or duplicate row), Insert an empty turn of user or assistant 3; a truncated row that stays adds 3.

The auction holds a price per node and one path from the start. Where the path's last node is cheaper than its best arc,
its price rises to that and the path contracts by it; otherwise the path extends along the best arc. Prices never exceed
the distance to the end, and reach it at the start when the path arrives. Then every cheapest repair runs along arcs whose
price difference is their cost, and the one with the least audit string (D < I < K < R) is traced along those, depth first;
nodes that turn out to lead nowhere are left for good.

A lattice is cut into pieces of PIECE rows. The four prices at a piece's first nodes are the costs at the end of the piece before
it, so the work is in proportion to the rows, and pieces seen before are looked up.

Conversations of more than PART rows are dealt out in parts over all tasks: each part yields its sixteen costs from state to
state, a stream over these (a narrow row per part) gives the costs behind each part, the parts are traced from all four states
in parallel, and a second stream says which trace holds. Costs behind two states never differ by more than 10 (an insertion or two
lead from any state to user and assistant, and a kept system turn can be deleted at 4), so FAR = 20 stands for "not from here".

Edge cases: a null role or text counts as one blank; rows come by turn, null first, then by role and text; a row whose role
starts with none of s, u, a (case counts; an empty role is none) can't be kept as it is; a null conv_id is one conversation; repeated
rows are duplicates of the first; a conversation without rows costs nothing; an empty table gives an empty result; other
columns are not looked at.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchloom.llm.tables import materialize, slices

START, SYSTEM, USER, ASSISTANT = range(4)
_NEXT = (USER, USER, ASSISTANT, USER)
_ROLES = {SYSTEM: "system", USER: "user", ASSISTANT: "assistant"}
_KEEP = {
    "s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}, "o": {},
}
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Costs after the last row: what must still be inserted.
FINAL = (0, 2 * INSERT, INSERT, 0)
FAR = 20
#: Rows solved at a time, and rows of a conversation that one task takes.
PIECE, PART = 16, 1024
#: Solved pieces kept by a worker.
KNOWN = 1 << 15

#: A row as one letter: its role, in capitals if truncated; blank and duplicate rows have no role to keep.
GONE = "."
_LEGAL = ("su", "ua", "au")
_WHITE = " \t\n\x0b\x0c\r"


# ---------------------------------------------------------------- the auction


def _arcs(codes: str, end: tuple[int, ...]) -> list[list[tuple[int, int, str]]]:
    """(cost, node, letter) of the arcs of each node, least letter first; the last node is the end."""
    arcs = []
    for i, code in enumerate(codes):
        more = TRUNCATED if code.isupper() else 0
        keep = {} if code == GONE else _KEEP[code.lower()]
        for state in range(4):
            out = [(DELETE, 4 * i + 4 + state, "D"), (INSERT, 4 * i + _NEXT[state], "I")]
            if state in keep:
                out.append((more, 4 * i + 4 + keep[state], "K"))
            if code != GONE:
                out.append((REROLE + more, 4 * i + 4 + _NEXT[state], "R"))
            arcs.append(out)
    return arcs + [[(cost, 4 * len(codes) + 4, "")] for cost in end]


def _auction(arcs: list[list[tuple[int, int, str]]], prices: list[int], start: int) -> None:
    """Raises `prices` until they show a cheapest path from `start` to the end."""
    path, end = [start], len(arcs)
    while (node := path[-1]) != end:
        least, best = None, None
        for cost, to, _ in arcs[node]:
            value = cost + prices[to]
            if least is None or value < least:
                least, best = value, to
        if prices[node] < least:
            prices[node] = least
            if len(path) > 1:
                path.pop()
        else:
            path.append(best)


def _trace(arcs: list[list[tuple[int, int, str]]], prices: list[int], start: int) -> tuple[str, int]:
    """Letters of the first tight path from `start` to the end in the order of letters, and the state it leaves in."""
    path, tried, letters, dead, end = [start], [0], [], set(), len(arcs)
    while (node := path[-1]) != end:
        for k in range(tried[-1], len(arcs[node])):
            cost, to, letter = arcs[node][k]
            if to not in dead and prices[node] == cost + prices[to]:
                tried[-1] = k + 1
                path.append(to)
                tried.append(0)
                letters.append(letter)
                break
        else:
            dead.add(node)
            for kept in (path, tried, letters):
                kept.pop()
    return "".join(letters), path[-2] % 4


@functools.lru_cache(maxsize=KNOWN)
def _piece(codes: str, end: tuple[int, ...], states: tuple[int, ...]) -> tuple[tuple[int, str, int], ...]:
    """(cost, letters, state left in) of a piece from each of `states`, given the costs behind it."""
    arcs = _arcs(codes, end)
    prices = [0] * (len(arcs) + 1)
    for state in states:
        _auction(arcs, prices, state)
    return tuple((prices[s], *_trace(arcs, prices, s)) for s in states)


def _solve(codes: str, end: tuple[int, ...], states: tuple[int, ...]) -> list[tuple[int, str, int]]:
    """The same for rows of any number."""
    pieces, base, solved = [codes[k : k + PIECE] for k in range(0, len(codes), PIECE)], 0, []
    for k in reversed(range(len(pieces))):
        least = min(end)
        base += least
        found = _piece(pieces[k], tuple(e - least for e in end), states if k == 0 else (0, 1, 2, 3))
        end = tuple(cost for cost, _, _ in found)
        solved.append(found)
    out = []
    for at, state in enumerate(states):
        letters, total = [], base + (end[at] if pieces else end[state])
        for k, found in enumerate(reversed(solved)):
            _, some, state = found[at if k == 0 else state]
            letters.append(some)
        out.append((total, "".join(letters), state))
    return out


def cheapest(codes: str) -> tuple[int, str]:
    """Cost and audit of the repair of one whole conversation."""
    (cost, letters, state), = _solve(codes, FINAL, (START,))
    return cost, letters + _last(state)


def _last(state: int) -> str:
    return "I" * (FINAL[state] // INSERT)


def apply(audit: str, state: int, rows: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """(role, text) of each turn after the edits of `audit`, from a state on."""
    out, left = [], iter(rows)
    for letter in audit:
        if letter == "I":
            role, text = _ROLES[_NEXT[state]], ""
        else:
            role, text = next(left)
            if letter == "D":
                continue
            if letter == "R":
                role = _ROLES[_NEXT[state]]
        state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[0]]
        out.append((role, text))
    return out


# ---------------------------------------------------------------- rows and parts

_ROW = ["_key", "_part", "_kind", "conv_id", "turn", "role", "text", "_code", "_again", "_audit", "_state"]
_PER_PART = ["blank", "duplicate", "truncated"]


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """The rows of each (_key, _part), which follow on each other."""
    held: list[tuple] = []
    for batch in slices(batches, text=_ROW.index("text")):
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if held and row[:2] != held[0][:2]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _examined(rows: list[tuple]) -> tuple[str, list[tuple], dict]:
    """Codes and rows of a part, and what is counted in it. Rows of a conversation without any have no code."""
    seen, codes, turns, kept = set(), [], [], []
    counts = dict.fromkeys(_PER_PART, 0)
    for _, _, _, _, turn, role, text, code, again, _, _ in rows:
        if code is None:
            continue
        if code == GONE:
            counts["blank"] += 1
        elif again or (role, text) in seen:
            code = GONE
            counts["duplicate"] += 1
        elif code.isupper():
            counts["truncated"] += 1
        seen.add((role, text))
        codes.append(code)
        kept.append((role, text))
        if turn is not None:
            turns.append(turn)
    initials = [role[:1] for role, _ in kept]
    counts["illegal"] = sum(a + b not in _LEGAL for a, b in zip(initials, initials[1:]))
    counts["ends"] = (initials[0], initials[-1]) if initials else (None, None)
    counts["turns"] = (min(turns), max(turns), len(set(turns))) if turns else (None, None, 0)
    return "".join(codes), kept, counts


def _turns(turns: DataFrame, present: str | None) -> DataFrame:
    """The rows with their codes."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit(" ")), F.coalesce(F.col("text").cast("string"), F.lit(" "))
    ended = F.rtrim(F.col("text"), F.lit(_WHITE))
    first = F.substring("role", 1, 1)
    code = F.when(first.isin("s", "u", "a"), first).otherwise("o")
    code = F.when(ended == "", GONE).when(F.substring(ended, -1, 1).isin(".", "!", "?"), code).otherwise(F.upper(code))
    key = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))
    rows = turns.select(
        key.alias("_key"), "conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"),
        (F.col(f"`{present}`") if present else F.lit(True)).alias("_present"),
    )
    return rows.select("*", F.when(F.col("_present"), code).alias("_code")).drop("_present")


def _dealt(rows: DataFrame, order: list[str]) -> DataFrame:
    """The rows of each part together and in order."""
    blank = {"_part": "long", "_kind": "int", "_again": "boolean", "_audit": "string", "_state": "int"}
    for name, kind in blank.items():
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(0 if name in ("_part", "_kind") else None).cast(kind))
    together = rows.repartition("_key", "_part").sortWithinPartitions("_key", "_part", "_kind", *order)
    return together.select(*_ROW)


def _out(rows: DataFrame) -> str:
    kind = rows.schema["conv_id"].dataType.simpleString()
    return (
        f"conv_id {kind}, _key string, part long, gaps long, blank long, duplicate long, truncated long, illegal long,"
        " cost long, audit string, messages array<struct<role: string, text: string>>"
    )


def _frame(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def _schema_of(df: DataFrame, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def _gaps(least, most, distinct: int) -> int:
    return 0 if least is None else most - least + 1 - distinct


#: Rows of output that are sent on together, by the number of turns in them.
_AT_ONCE = 4096


def _short(rows: DataFrame) -> DataFrame:
    """Conversations of one part each."""
    ddl = _out(rows)
    schema = _schema_of(rows, ddl)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held = [], 0
        for group in _groups(batches):
            codes, kept, counts = _examined(group)
            cost, audit = cheapest(codes)
            out.append({
                "conv_id": group[0][3], "_key": group[0][0], "part": 0, "gaps": _gaps(*counts["turns"]),
                **{n: counts[n] for n in (*_PER_PART, "illegal")}, "cost": cost, "audit": audit,
                "messages": [{"role": r, "text": t} for r, t in apply(audit, START, kept)],
            })
            held += len(kept)
            if held > _AT_ONCE:
                yield _frame(out, schema)
                out, held = [], 0
        yield _frame(out, schema)

    return _dealt(rows, ["turn", "role", "text"]).mapInArrow(work, ddl)


# ---------------------------------------------------------------- long conversations

_SUMMARY = (
    "_key string, _part long, codes string, blank long, duplicate long, truncated long, illegal long, first string, last string,"
    " least long, most long, distinct long, costs array<int>"
)


def _in_parts(rows: DataFrame) -> DataFrame:
    """The rows of long conversations with their part, and whether role and text came before in another part.

    Ranges of (conversation, turn, role, text) are dealt out, equal rows by a hash of their place; parts are cut from
    the numbers of the rows, which grow from range to range.
    """
    spread = rows.withColumn("_tie", F.xxhash64(F.monotonically_increasing_id()))
    order = ["_key", "turn", "role", "text", "_tie"]
    sorted_rows = spread.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = materialize(
        sorted_rows.withColumn("_at", F.monotonically_increasing_id())
        .withColumn("_part", F.floor(F.col("_at") / PART).cast("long")).drop("_tie")
    )
    same = ["_key", "role", F.md5(F.encode("text", "utf-8")).alias("_md5")]
    firsts = placed.filter("_code IS NOT NULL").groupBy(*same).agg(F.min("_at").alias("_first"), F.count("*").alias("n"))
    firsts = firsts.filter("n > 1").drop("n")
    marked = placed.withColumn("_md5", F.md5(F.encode("text", "utf-8"))).join(firsts, ["_key", "role", "_md5"], "left")
    return marked.withColumn("_again", F.coalesce(F.col("_at") > F.col("_first"), F.lit(False))).drop("_md5", "_first")


def _summaries(rows: DataFrame) -> DataFrame:
    """One narrow row per part: its codes, counts, and costs from each state to each state."""
    schema = _schema_of(rows, _SUMMARY)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches):
            codes, _, counts = _examined(group)
            ends = [tuple(0 if r == q else FAR for r in range(4)) for q in range(4)]
            costs = [[cost for cost, _, _ in _solve(codes, end, (0, 1, 2, 3))] for end in ends]
            least, most, distinct = counts["turns"]
            yield _frame([{
                "_key": group[0][0], "_part": group[0][1], "codes": codes, **{n: counts[n] for n in (*_PER_PART, "illegal")},
                "first": counts["ends"][0], "last": counts["ends"][1], "least": least, "most": most, "distinct": distinct,
                "costs": [costs[r][q] for q in range(4) for r in range(4)],
            }], schema)

    return _dealt(rows, ["_at"]).mapInArrow(work, _SUMMARY)


def _behind(summaries: DataFrame) -> DataFrame:
    """(_key, _part, end, after): the costs behind each part, least 0, and what was taken off; a stream with four numbers as state."""
    ddl = "_key string, _part long, end array<int>, after long"
    schema = _schema_of(summaries, ddl)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, end, base = None, FINAL, 0
        for batch in slices(batches):
            out = []
            for now, part, costs in zip(*(c.to_pylist() for c in batch.columns)):
                if now != key:
                    key, end, base = now, FINAL, 0
                out.append({"_key": now, "_part": part, "end": list(end), "after": base})
                total = [min(costs[4 * q + r] + end[r] for r in range(4)) for q in range(4)]
                base += min(total)
                end = tuple(t - min(total) for t in total)
            yield _frame(out, schema)

    stream = summaries.select("_key", "_part", "costs").repartition("_key").sortWithinPartitions("_key", F.desc("_part"))
    return stream.mapInArrow(work, ddl)


def _traces(summaries: DataFrame, behind: DataFrame) -> DataFrame:
    """The audit of each part from each of the four states, the state after it, and the cost from there to the very end."""
    ddl = "_key string, _part long, audits array<string>, states array<int>, costs array<long>"
    schema = _schema_of(summaries, ddl)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, rows=64):
            out = []
            for key, part, codes, end, after in zip(*(c.to_pylist() for c in batch.columns)):
                found = _solve(codes, tuple(end), (0, 1, 2, 3))
                out.append({
                    "_key": key, "_part": part, "audits": [a for _, a, _ in found], "states": [s for _, _, s in found],
                    "costs": [after + c for c, _, _ in found],
                })
            yield _frame(out, schema)

    joined = summaries.select("_key", "_part", "codes").join(behind, ["_key", "_part"])
    return joined.select("_key", "_part", "codes", "end", "after").mapInArrow(work, ddl)


def _chosen(summaries: DataFrame, traces: DataFrame) -> DataFrame:
    """The state before each part, its audit, and the counts that need the part before it; a stream along each conversation."""
    ddl = (
        "_key string, _part long, part long, state int, audit string, cost long, illegal_before long, turns_shared long"
    )
    schema = _schema_of(summaries, ddl)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, number, last, most = None, START, 0, None, None
        for batch in slices(batches, rows=256):
            out = []
            for now, part, first, final, low, high, audits, states, costs, ends_here in zip(*(c.to_pylist() for c in batch.columns)):
                if now != key:
                    key, state, number, last, most = now, START, 0, None, None
                after = states[state]
                out.append({
                    "_key": now, "_part": part, "part": number, "state": state, "audit": audits[state] + (_last(after) if ends_here else ""),
                    "cost": costs[state] if number == 0 else None,
                    "illegal_before": int(last is not None and first is not None and last + first not in _LEGAL),
                    "turns_shared": int(most is not None and low == most),
                })
                state, number = after, number + 1
                last, most = (final if final is not None else last), (high if high is not None else most)
            yield _frame(out, schema)

    ends = summaries.groupBy("_key").agg(F.max("_part").alias("_end"))
    rows = summaries.select("_key", "_part", "first", "last", "least", "most").join(traces, ["_key", "_part"]).join(ends, "_key")
    stream = rows.repartition("_key").sortWithinPartitions("_key", "_part").select(
        "_key", "_part", "first", "last", "least", "most", "audits", "states", "costs", (F.col("_part") == F.col("_end")).alias("ends")
    )
    return stream.mapInArrow(work, ddl)


def _long(rows: DataFrame) -> DataFrame:
    """Conversations of several parts: a row per part with the counts of the whole conversation."""
    rows = materialize(_in_parts(rows))
    summaries = materialize(_summaries(rows))
    chosen = materialize(_chosen(summaries, _traces(summaries, _behind(summaries))))
    sums = summaries.join(chosen.select("_key", "_part", "cost", "illegal_before", "turns_shared"), ["_key", "_part"]).groupBy("_key").agg(
        *(F.sum(c).alias(c) for c in _PER_PART), F.sum(F.col("illegal") + F.col("illegal_before")).alias("illegal"),
        F.coalesce(F.max("most") - F.min("least") + 1 - F.sum(F.col("distinct") - F.col("turns_shared")), F.lit(0)).alias("gaps"),
        F.max("cost").alias("cost"),
    )
    orders = chosen.select("_key", "_part", F.lit(-1).alias("_kind"), F.col("audit").alias("_audit"), F.col("state").alias("_state"))
    ddl = f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, _key string, _part long, audit string, messages array<struct<role: string, text: string>>"
    schema = _schema_of(rows, ddl)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for order, *group in _groups(batches):
            _, kept, _ = _examined(group)
            messages = [{"role": r, "text": t} for r, t in apply(order[9], order[10], kept)]
            yield _frame([{"conv_id": group[0][3], "_key": order[0], "_part": order[1], "audit": order[9], "messages": messages}], schema)

    both = rows.withColumn("_kind", F.lit(0)).unionByName(orders, allowMissingColumns=True)
    parts = _dealt(both, ["_at"]).mapInArrow(work, ddl)
    numbers = chosen.select("_key", "_part", "part")
    joined = parts.join(numbers, ["_key", "_part"]).join(sums, "_key")
    return joined.select("conv_id", "_key", "part", "gaps", *_PER_PART, "illegal", "cost", "audit", "messages")


def repair(turns: DataFrame, present: str | None = None) -> DataFrame:
    """Parts of conversations, at most PART rows each: the edits and the repaired turns of the part, and the counts of the whole.

    `turns` has conv_id, turn, role and text. A row whose column `present` is false only makes its conversation known. Columns:
    conv_id, _key (its text), part (from 0), gaps (turn numbers that lack), blank, duplicate, truncated (rows by their first
    fault), illegal (neighbours whose roles do not follow on each other), cost, audit, messages (role, text).
    """
    rows = _turns(turns, present)
    counts = materialize(rows.groupBy("_key").agg(F.count("*").alias("n")).filter(F.col("n") > PART).select("_key"))
    short = _short(rows.join(counts, "_key", "left_anti"))
    if counts.isEmpty():
        return short
    return short.unionByName(_long(rows.join(counts, "_key", "left_semi")))


def digests(parts: DataFrame) -> DataFrame:
    """One row per conversation of `parts`, with the whole audit and the SHA-256 of its `role:text` lines.

    Parts of one conversation follow each other through one hash, which no part's text outlives; most have one part only
    and are hashed where they are.
    """
    stored = materialize(parts)
    several = materialize(stored.filter("part > 0").select("_key").distinct())
    lines = F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["text"]))
    columns = ["conv_id", "gaps", *_PER_PART, "illegal", "cost", "audit"]
    one = stored.join(several, "_key", "left_anti").select(
        *columns, F.sha2(F.encode(F.array_join(lines, "\n"), "utf-8"), 256).alias("repaired_sha256")
    )
    if several.isEmpty():
        return one
    kind = stored.schema["conv_id"].dataType.simpleString()
    ddl = f"conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    schema = _schema_of(stored, ddl)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, row, audit, digest, begun = None, None, [], None, False

        def done() -> pa.RecordBatch:
            return _frame([{**row, "audit": "".join(audit), "repaired_sha256": digest.hexdigest()}], schema)

        for batch in slices(batches, rows=16):
            for now in batch.to_pylist():
                if now["_key"] != key:
                    if row is not None:
                        yield done()
                    key, audit, digest, begun = now["_key"], [], hashlib.sha256(), False
                    row = {c: now[c] for c in columns if c != "audit"}
                audit.append(now["audit"])
                for message in now["messages"]:
                    digest.update((("\n" if begun else "") + f"{message['role']}:{message['text']}").encode())
                    begun = True
        if row is not None:
            yield done()

    followed = stored.join(several, "_key", "left_semi").repartition("_key").sortWithinPartitions("_key", "part")
    return one.unionByName(followed.mapInArrow(work, ddl))


# ---------------------------------------------------------------- damage, for checks


def damaged(conversations: DataFrame) -> DataFrame:
    """`conversations` with faults made by the checksum of `conv_id:turn`; nulls become one blank. Dropped rows have `present` false."""

    def blank(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    fault = F.crc32(F.encode(F.concat_ws(":", blank("conv_id"), blank("turn")), "utf-8")) % 20
    text = F.when(fault == 1, "").when(fault == 2, F.translate(blank("text"), ".!?", "")).otherwise(blank("text"))
    copies = F.when(fault == 3, F.array(F.lit(True), F.lit(True))).otherwise(F.array(fault != 0))
    return conversations.select(
        "conv_id", "turn", F.when(fault == 4, "user").otherwise(blank("role")).alias("role"), text.alias("text"),
        F.explode(copies).alias("present"),
    )
