"""Repair of conversation structure at least cost, over signatures that all conversations share.

A row's role initial and first fault are one symbol; a conversation is a string of symbols,
cut into pieces of at most ``PIECE`` rows. The distinct pieces, read from their ends, share
their suffixes: a node of the automaton is a suffix, and with it go, for every grammar state
at its start and every one at its end, the cheapest edits and the ASCII-least audit of them.
Each node is made once, from the node of the suffix one shorter. A piece then is a small
table (state in, state out): tables of neighbouring pieces compose, 256 at a time, so that a
conversation of any length is repaired without being in one place.

Grammar states: 0 nothing yet, 1 after ``s``, 2 after ``u``, 3 after ``a``; 0 and 3 may end.
From a state, an audit letter leads to one state only (an inserted or changed row is the
user's, or the assistant's after ``u``), so audits of one piece between the same states differ
before either ends, and ties between whole conversations are settled inside pieces.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, join_groups, materialize, read_table
from .ordering import number_runs

PIECE = 512  # rows in a piece
STEP = 8  # bits: 256 tables are composed in a group
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
NEVER = 1 << 40
WHITE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]"

FINE, BLANK, DUPLICATE, CUT = range(4)
INITIALS = "sua"  # a fourth class holds all others
_NEXT = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}
_ADDED = [2, 2, 3, 2]  # where an inserted or changed row leads
_END = {0: (0, ""), 1: (2 * INSERT, "II"), 2: (INSERT, "I"), 3: (0, "")}  # what closes a conversation


def symbol(initial: int, fault: int) -> str:
    """One hex digit: the class of the role initial and the first fault."""
    return "0123456789abcdef"[initial * 4 + fault]


def _moves(x: str) -> list[list[tuple[int, str, int]]]:
    """(cost, letters, next state) of what can be done with a row, insertions before it included, by state."""
    initial, fault = divmod(int(x, 16), 4)
    extra = TRUNCATED if fault == CUT else 0
    out = []
    for start in range(4):
        best: dict[int, tuple[int, str]] = {}
        state, cost, letters = start, 0, ""
        for _ in range(3):  # more than two insertions only come back to a state
            options = [(DELETE, "D", state)]
            if fault in (FINE, CUT):
                options.append((REROLE + extra, "R", _ADDED[state]))
                if initial < 3 and (INITIALS[initial], state) in _NEXT:
                    options.append((KEEP + extra, "K", _NEXT[INITIALS[initial], state]))
            for c, letter, to in options:
                found = (cost + c, letters + letter)
                if to not in best or found < best[to]:
                    best[to] = found
            state, cost, letters = _ADDED[state], cost + INSERT, letters + "I"
        out.append([(c, s, to) for to, (c, s) in best.items()])
    return out


MOVES = {x: _moves(x) for x in "0123456789abcdef"}
_LEAF = [[(0, "") if q == e else (NEVER, "") for e in range(4)] for q in range(4)]


def longer(x: str, node: list) -> list:
    """The node of a suffix with one more row before it: cost-to-go and best audit by state in and out."""
    out = []
    for moves in MOVES[x]:
        row = []
        for e in range(4):
            best = (NEVER, "")
            for cost, letters, to in moves:
                rest = node[to][e]
                if rest[0] < NEVER:
                    found = (cost + rest[0], letters + rest[1])
                    if found < best:
                        best = found
            row.append(best)
        out.append(row)
    return out


#: Rows that must go are alike, whoever wrote them; so the automaton is the smallest.
_GONE = "".join(symbol(i, f) for i in range(4) for f in (BLANK, DUPLICATE))


def suffix_nodes(backs: Iterator[str]) -> Iterator[list]:
    """The nodes of pieces whose reversed texts come in order.

    The stack holds the nodes of the last piece; a next one takes up the suffix that it shares.
    """
    stack, last = [_LEAF], ""
    for back in backs:
        shared = 0
        most = min(len(back), len(last))
        while shared < most and back[shared] == last[shared]:
            shared += 1
        del stack[shared + 1 :]
        for x in back[shared:]:
            stack.append(longer(x, stack[-1]))
        last = back
        yield stack[-1]


def ranks(node: list) -> list[int]:
    """Places of the audits among those of the same state in."""
    out = []
    for row in node:
        order = sorted(range(4), key=lambda e: row[e][1])
        at = [0] * 4
        for i, e in enumerate(order):
            at[e] = at[order[i - 1]] if i and row[e][1] == row[order[i - 1]][1] else i
        out += at
    return out


def compose(left: tuple[list, list], right: tuple[list, list]) -> tuple[list, list, list]:
    """(costs, ranks, state between) of two neighbouring tables, 16 numbers each (state in x 4 + state out)."""
    (lc, lr), (rc, rr) = left, right
    costs, keys, mids = [], [], []
    for q in range(4):
        for e in range(4):
            best = min((lc[4 * q + m] + rc[4 * m + e], lr[4 * q + m], rr[4 * m + e], m) for m in range(4))
            costs.append(min(best[0], NEVER))
            keys.append(best[1:3])
            mids.append(best[3])
    order = [sorted(set(keys[4 * q : 4 * q + 4])) for q in range(4)]
    return costs, [order[i // 4].index(k) for i, k in enumerate(keys)], mids


def last_state() -> Column:
    """The state in which the cheapest repair of a whole conversation (a table) leaves its last row."""
    each = [F.struct((F.col("costs")[e] + _END[e][0]).alias("cost"), F.col("ranks")[e].alias("rank"), F.lit(e).alias("e")) for e in range(4)]
    return F.array_min(F.array(*each))["e"]


def _counts(piece: str) -> tuple[int, int, int, int]:
    """Blank, duplicate and truncated rows, and neighbours with roles that may not follow each other."""
    v = [int(x, 16) for x in piece]
    faults, first = [x % 4 for x in v], [x // 4 for x in v]
    return faults.count(BLANK), faults.count(DUPLICATE), faults.count(CUT), sum(not legal(a, b) for a, b in zip(first, first[1:], strict=False))


def legal(a: int, b: int) -> bool:
    return (a, b) in ((0, 1), (1, 2), (2, 1))


# ---------------------------------------------------------------- the jobs


def damage(rows: DataFrame) -> DataFrame:
    """``conv, turn, role, text``: the rows with the faults that crc32(`conv_id:turn`) % 20 says, null as one space."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(space("text"), "[.!?]", "")).otherwise(space("text"))
    rows = rows.select(conversation_key().alias("conv"), "turn", F.when(kind == 4, "user").otherwise(space("role")).alias("role"), text.alias("text"), kind.alias("_kind"))
    copies = F.when(F.col("_kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.where("_kind <> 0").select("conv", "turn", "role", "text", F.explode(copies).alias("_copy")).drop("_copy")


def conversation_key() -> Column:
    """A text for each conv_id, null too."""
    return F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))


def _row_key() -> Column:
    """Rows alike in conversation, role and text have one key; lengths keep the parts apart."""
    return F.md5(F.concat_ws(":", F.length("conv"), F.length("role"), F.concat("conv", "role", "text")))


def _initial(c: str = "role") -> Column:
    first = F.substring(c, 1, 1)
    return F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3)


def signatures(rows: DataFrame, piece: int = PIECE) -> DataFrame:
    """``conv, pid, sig, turn, key``: the symbols of each piece, and the place of its first row.

    ``rows(conv, turn, role, text)``; pid ascends with the pieces of a conversation.
    """
    white = F.lit(WHITE)
    fault = F.when(~F.col("text").rlike(WORD), BLANK).when(F.substring(F.rtrim("text", white), -1, 1).isin(".", "!", "?"), FINE).otherwise(CUT)
    slim = rows.select("conv", "turn", _row_key().alias("key"), _initial().cast("int").alias("initial"), fault.cast("int").alias("fault"))
    slim = number_runs(slim, "conv", ["turn", "key"], "turns")
    at = F.struct("part", "nth")
    again = slim.where(f"fault <> {BLANK}").groupBy("key").agg(F.min(at).alias("earliest"), F.count("*").alias("n")).where("n > 1")
    again = materialize(again, "repeated")
    total = slim.count()
    told = join_groups(slim, again, "key", total).select("conv", "turn", "key", "initial", "part", "nth", F.when((F.col("fault") != BLANK) & (at > F.col("earliest")), DUPLICATE).otherwise(F.col("fault")).alias("fault"))
    rest = slim.join(again.select("key").hint("merge"), "key", "left_anti").select(told.columns)
    x = F.substring(F.lit("0123456789abcdef"), (F.col("initial") * 4 + F.col("fault") + 1).cast("int"), F.lit(1))
    blocks = told.unionByName(rest).groupBy("conv", "part", F.floor(F.col("nth") / piece).alias("block"))
    rows_ = F.array_sort(F.collect_list(F.struct("nth", x.alias("x"))))
    first = F.min_by(F.struct("turn", "key"), "nth")
    out = blocks.agg(F.array_join(F.transform(rows_, lambda r: r["x"]), "").alias("sig"), first.alias("f"))
    out = materialize(out.select("conv", (F.col("part") * (1 << 32) + F.col("block")).alias("pid"), "sig", "f.turn", "f.key"), "pieces")
    discard(slim, again)
    return out


_NODE = "sig string, n long, costs array<long>, ranks array<int>, audits array<string>, counts array<long>"
_LONGS, _INTS = pa.list_(pa.int64()), pa.list_(pa.int32())


def automaton(pieces: DataFrame) -> DataFrame:
    """One row for each distinct signature: its node, and how many pieces have it.

    Signatures are range partitioned by their reversed text, so that those with a common end
    are neighbours; a task keeps the nodes of one signature.
    """
    kind = pa.schema([("sig", pa.string()), ("n", pa.int64()), ("costs", _LONGS), ("ranks", _INTS), ("audits", pa.list_(pa.string())), ("counts", _LONGS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = deque()

        def texts():
            for b in batches:
                for row in zip(b.column("sig").to_pylist(), b.column("n").to_pylist(), b.column("back").to_pylist(), strict=True):
                    rows.append(row[:2])
                    yield row[2]

        held, size = [], 0
        for node in suffix_nodes(texts()):
            sig, n = rows.popleft()
            flat = [cell for row in node for cell in row]
            held.append({"sig": sig, "n": n, "costs": [c for c, _ in flat], "ranks": ranks(node), "audits": [a for _, a in flat], "counts": list(_counts(sig))})
            size += 16 * len(sig)
            if size > 1 << 20 or len(held) >= 1_000:
                yield pa.RecordBatch.from_pylist(held, schema=kind)
                held, size = [], 0
        yield pa.RecordBatch.from_pylist(held, schema=kind)

    distinct = pieces.groupBy("sig").agg(F.count("*").alias("n")).withColumn("back", F.reverse(F.translate("sig", _GONE, _GONE[0] * len(_GONE))))
    return materialize(distinct.repartitionByRange("back").sortWithinPartitions("back").mapInArrow(run, _NODE), "nodes")


def choose(tables: DataFrame) -> DataFrame:
    """``conv, pid, q, e``: the states in which the best repair enters and leaves each piece.

    ``tables(conv, pid, costs, ranks)``. Where a conversation has several pieces, their tables are
    composed in groups of 2^STEP, round by round; then states go back from the top.
    """
    many = lambda t: t.groupBy("conv").agg(F.count("*").alias("n")).where("n > 1").select("conv")
    more = materialize(many(tables), "several")
    single = tables.join(more.hint("merge"), "conv", "left_anti").select("conv", "pid", F.lit(0).alias("q"), last_state().alias("e"))
    if more.isEmpty():
        return single
    current = materialize(tables.join(more.hint("merge"), "conv", "left_semi"), "tables")
    rounds = [current]

    def up(t: pa.Table) -> pa.Table:
        t = t.sort_by("pid")
        got = None
        for costs, rank in zip(t["costs"].to_pylist(), t["ranks"].to_pylist(), strict=True):
            got = (costs, rank) if got is None else compose(got, (costs, rank))[:2]
        return pa.table({"conv": t["conv"][:1].combine_chunks(), "pid": pa.array([t["pid"][0].as_py() >> STEP], pa.int64()), "costs": pa.array([got[0]], _LONGS), "ranks": pa.array([got[1]], _INTS)})

    while True:
        grouped = current.groupBy("conv", F.shiftright("pid", STEP).alias("group"))
        current = materialize(grouped.applyInArrow(up, "conv string, pid long, costs array<long>, ranks array<int>"), "tables")
        rounds.append(current)
        if many(current).isEmpty():
            break

    def down(t: pa.Table) -> pa.Table:
        t = t.sort_by("pid")
        both = list(zip(t["costs"].to_pylist(), t["ranks"].to_pylist(), strict=True))
        suffix = [both[-1]]  # composed from the right, so that the state between comes at once
        mids = [None]
        for own in reversed(both[:-1]):
            costs, rank, mid = compose(own, suffix[-1])
            suffix.append((costs, rank))
            mids.append(mid)
        q, e, out = t["q"][0].as_py(), t["e"][0].as_py(), []
        for mid in reversed(mids):
            to = e if mid is None else mid[4 * q + e]
            out.append((q, to))
            q = to
        return pa.table({"conv": t["conv"].combine_chunks(), "pid": t["pid"].combine_chunks(), "q": pa.array([a for a, _ in out], pa.int32()), "e": pa.array([b for _, b in out], pa.int32())})

    known = rounds[-1].select("conv", "pid", F.lit(0).alias("q"), last_state().alias("e"))
    for t in reversed(rounds[:-1]):
        own = known.withColumnRenamed("pid", "group")
        with_states = t.withColumn("group", F.shiftright("pid", STEP)).join(own.hint("merge"), ["conv", "group"])
        known = materialize(with_states.groupBy("conv", "group").applyInArrow(down, "conv string, pid long, q int, e int"), "states")
    return single.unionByName(known)


def _frame_of(rows: DataFrame, picked: DataFrame, heads: DataFrame) -> DataFrame:
    """Conversations, their pieces and their rows as one kind of record, in reading order."""
    lines = rows.select("conv", F.lit(2).alias("kind"), "turn", _row_key().alias("key"), F.lit(0).cast("long").alias("pid"), "role", "text", F.lit(None).cast("array<long>").alias("facts"), F.lit(None).cast("string").alias("audit"))
    pieces = picked.select("conv", F.lit(1).alias("kind"), "turn", "key", "pid", F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), "facts", "audit")
    first = heads.select("conv", F.lit(0).alias("kind"), F.lit(None).cast(rows.schema["turn"].dataType).alias("turn"), F.lit("").alias("key"), F.lit(-1).cast("long").alias("pid"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), F.array("gaps").alias("facts"), F.lit(None).cast("string").alias("audit"))
    # nulls first: a conversation's head (no turn, no key) comes before all, a piece before its first row
    return lines.unionByName(pieces).unionByName(first).repartition("conv").sortWithinPartitions("conv", F.when(F.col("kind") == 0, 0).otherwise(1), "turn", "key", "kind", "pid")


class _Reader:
    """One conversation at a time: applies the audit to the rows and hashes what is left."""

    def __init__(self, conv: str, gaps: int):
        self.conv, self.facts = conv, [gaps, 0, 0, 0, 0, 0]
        self.audit, self.ops, self.at = [], "", 0
        self.state, self.last, self.lines, self.hash = 0, None, 0, hashlib.sha256()

    def piece(self, facts: list[int], audit: str) -> None:
        cost, first, last, *counts = facts
        for i, n in enumerate(counts, 1):
            self.facts[i] += n
        if self.last is not None and not legal(self.last, first):
            self.facts[4] += 1
        self.last = last
        self.facts[5] += cost
        self.audit.append(audit)
        self.ops, self.at = self.ops[self.at :] + audit, 0

    def _put(self, role: str, text: str) -> None:
        self.hash.update((("\n" if self.lines else "") + role + ":" + text).encode("utf-8", "surrogatepass"))
        self.lines += 1

    def _added(self, text: str) -> None:
        self.state = _ADDED[self.state]
        self._put("user" if self.state == 2 else "assistant", text)

    def row(self, role: str, text: str) -> None:
        while self.ops[self.at] == "I":
            self._added("")
            self.at += 1
        letter = self.ops[self.at]
        self.at += 1
        if letter == "K":
            self.state = _NEXT[role[0], self.state]
            self._put(role, text)
        elif letter == "R":
            self._added(text)

    def end(self) -> tuple:
        cost, letters = _END[self.state]
        for _ in letters:
            self._added("")
        self.facts[5] += cost
        return (self.conv, *self.facts, "".join(self.audit) + letters, self.hash.hexdigest())


_RESULT = ["conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.schema([("conv", pa.string()), *[(c, pa.int64()) for c in _RESULT[1:7]], ("audit", pa.string()), ("repaired_sha256", pa.string())])
    reader, done, size = None, [], 0

    def out():
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), kind.types, strict=True)], schema=kind)

    for b in batches:
        for i, (what, conv) in enumerate(zip(b.column("kind").to_pylist(), b.column("conv").to_pylist(), strict=True)):
            if what == 0:
                if reader:
                    done.append(reader.end())
                    size += len(done[-1][7])
                    if len(done) >= 5_000 or size > 1 << 20:
                        yield out()
                        done, size = [], 0
                reader = _Reader(conv, b.column("facts")[i].as_py()[0])
            elif what == 1:
                reader.piece(b.column("facts")[i].as_py(), b.column("audit")[i].as_py())
            else:
                reader.row(b.column("role")[i].as_py(), b.column("text")[i].as_py())
    if reader:
        done.append(reader.end())
    if done:
        yield out()


def repair(rows: DataFrame, heads: DataFrame, piece: int = PIECE) -> DataFrame:
    """Repairs the conversations of ``rows(conv, turn, role, text)``; ``heads(conv, gaps)`` has a row for each.

    Returns ``conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``.
    Rows are in the order of turn (null first); rows of one turn in that of a hash of role and
    text, so a copy follows its original. Role and text hold no nulls. Blank rows (empty or
    only white space) and rows whose role and text came before are deleted. A head without rows
    has zeros, an empty audit and the hash of nothing. Texts may be of any length. A
    conversation of any length is repaired piece by piece; only its hash, which is one stream
    by definition, and its audit, one letter a row, are made in one task.
    """
    pieces = signatures(rows, piece)
    nodes = automaton(pieces)
    known = materialize(join_groups(pieces, nodes, "sig", pieces.count()), "known")
    states = choose(known.select("conv", "pid", "costs", "ranks"))
    cell = F.col("q") * 4 + F.col("e")
    first, last = (F.floor(F.conv(F.substring("sig", i, 1), 16, 10).cast("long") / 4) for i in (1, -1))
    picked = known.join(states.hint("merge"), ["conv", "pid"]).select(
        "conv", "pid", "turn", "key", F.element_at("audits", cell + 1).alias("audit"), F.concat(F.array(F.element_at("costs", cell + 1), first, last), "counts").alias("facts")
    )
    picked = materialize(picked, "picked")
    discard(pieces, nodes)
    schema = T.StructType([T.StructField("conv", T.StringType()), *[T.StructField(c, T.LongType()) for c in _RESULT[1:7]], T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())])
    return _frame_of(rows, picked, heads).mapInArrow(_read, schema)


def repair_all(original: DataFrame, piece: int = PIECE) -> DataFrame:
    """``damage``s and repairs ``original(conv_id, turn, role, text)``; a row for each of its conv_ids, null too.

    ``gaps`` counts the turns that lack between the first and the last one after the damage.
    Further columns are ignored; an empty table gives no rows.
    """
    original = original.select("conv_id", "turn", "role", "text")
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    left = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20 != 0
    turns = original.select("conv_id", F.when(left, F.col("turn")).alias("turn")).distinct()  # a distinct turn counts once
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long")
    heads = turns.groupBy("conv_id").agg(gaps.alias("gaps")).withColumn("conv", conversation_key())
    done = repair(damage(original), heads, piece)
    own = F.when(F.col("conv") != "", F.expr("substring(conv, 2)")).cast(original.schema["conv_id"].dataType)
    return done.select(own.alias("conv_id"), *_RESULT[1:])


def op11_repair_conversations(spark, sf_dir: str) -> DataFrame:
    """Contract query: the damaged ``conversations``, one row for each original conv_id."""
    return repair_all(read_table(spark, sf_dir, "conversations"))


_SQL_CRC = """xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, length(id) + 1), lambda i: ascii(id[i])::BIGINT)),
    lambda c, b: list_reduce(list_concat([xor(c, b)], list_transform(range(8), lambda j: 0::BIGINT)), lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"""

ORACLE_SQL = rf"""WITH RECURSIVE o AS (SELECT conv_id, coalesce('=' || conv_id, '') AS conv, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS id FROM conversations),
k AS (SELECT *, {_SQL_CRC} % 20 AS kind FROM o),
d AS (SELECT conv, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS copy FROM k WHERE kind <> 0),
n AS (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, md5(length(conv) || ':' || length(role) || ':' || conv || role || text), copy) AS i, count(*) OVER (PARTITION BY conv) AS rows_ FROM d),
f AS (SELECT *, left(role, 1) AS ini, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv, role, text ORDER BY i) > 1 THEN 'duplicate'
    WHEN right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM n),
ins(q, now, cost, letters, lines) AS (VALUES (0, 0, 0, '', ''), (1, 1, 0, '', ''), (2, 2, 0, '', ''), (3, 3, 0, '', ''), (0, 2, 3, 'I', chr(10) || 'user:'), (1, 2, 3, 'I', chr(10) || 'user:'), (2, 3, 3, 'I', chr(10) || 'assistant:'), (3, 2, 3, 'I', chr(10) || 'user:'),
    (0, 3, 6, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'), (1, 3, 6, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'), (2, 2, 6, 'II', chr(10) || 'assistant:' || chr(10) || 'user:'), (3, 3, 6, 'II', chr(10) || 'user:' || chr(10) || 'assistant:')),
edits(op, ini, now, next, role) AS (VALUES ('D', NULL, 0, 0, NULL), ('D', NULL, 1, 1, NULL), ('D', NULL, 2, 2, NULL), ('D', NULL, 3, 3, NULL), ('K', 's', 0, 1, NULL), ('K', 'u', 0, 2, NULL), ('K', 'u', 1, 2, NULL), ('K', 'u', 3, 2, NULL), ('K', 'a', 2, 3, NULL),
    ('R', NULL, 0, 2, 'user'), ('R', NULL, 1, 2, 'user'), ('R', NULL, 3, 2, 'user'), ('R', NULL, 2, 3, 'assistant')),
e AS (SELECT f.conv, f.i, ins.q, edits.next, ins.letters || op AS letters, ins.cost + CASE op WHEN 'D' THEN 4 WHEN 'R' THEN 3 ELSE 0 END + CASE WHEN op <> 'D' AND fault = 'truncated' THEN 3 ELSE 0 END AS cost,
    lines || CASE op WHEN 'D' THEN '' ELSE chr(10) || CASE op WHEN 'K' THEN f.role ELSE edits.role END || ':' || text END AS lines
    FROM f JOIN edits ON op = 'D' OR fault NOT IN ('blank', 'duplicate') AND (op = 'R' OR edits.ini = f.ini) JOIN ins USING (now)),
g(conv, i, q, best) AS (SELECT conv, any_value(rows_) + 1, q, any_value(struct_pack(cost := c, audit := a, lines := l)) FROM f, (VALUES (0, 0, '', ''), (1, 6, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'), (2, 3, 'I', chr(10) || 'assistant:'), (3, 0, '', '')) t(q, c, a, l) GROUP BY conv, q
    UNION ALL SELECT e.conv, e.i, e.q, min(struct_pack(cost := e.cost + best.cost, audit := e.letters || best.audit, lines := e.lines || best.lines)) FROM g JOIN e ON e.conv = g.conv AND e.i = g.i - 1 AND e.next = g.q GROUP BY e.conv, e.i, e.q),
b AS (SELECT conv, best FROM g WHERE i = 1 AND q = 0),
p AS (SELECT *, lag(ini) OVER (PARTITION BY conv ORDER BY i) || '>' || ini AS pair FROM f),
c AS (SELECT conv, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated,
    count(*) FILTER (WHERE pair NOT IN ('s>u', 'u>a', 'a>u')) AS illegal FROM p GROUP BY conv)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(best.cost, 0) AS BIGINT) AS cost, coalesce(best.audit, '') AS audit, sha256(coalesce(best.lines[2:], '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, conv FROM o) a LEFT JOIN c USING (conv) LEFT JOIN b USING (conv)"""
