"""Conversation repair against a plain version that takes one conversation at a time."""

import hashlib
import random
import re
import zlib
from functools import cache

from pyspark.sql import functions as F

from trajecta.llm import conversations as C

WHITE = " \t\n\x0b\x0c\r"


def spoiled(rows):
    """(conv_id, turn, role, text) after damage."""
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if k == 0:
            continue
        row = (conv, turn, "user" if k == 4 else role, "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text)
        out += [row, row] if k == 3 else [row]
    return out


def order_key(row):
    conv = "" if row[0] is None else f"={row[0]}"
    text = f"{len(conv)}:{len(row[2])}:{conv}{row[2]}{row[3]}"
    return (row[1] is not None, row[1] or 0, hashlib.md5(text.encode()).hexdigest())


def mended(rows):
    """One conversation's rows in order: (blank, duplicate, truncated, illegal, cost, audit, hash)."""
    faults, seen = [], set()
    for _, _, role, text in rows:
        kept = text.strip(WHITE)
        faults.append("blank" if not kept else "duplicate" if (role, text) in seen else "" if kept[-1] in ".!?" else "truncated")
        seen.add((role, text))
    n = len(rows)

    def after(state, letter):
        return {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}.get((state, letter))

    @cache
    def best(i, state, added):
        options = []
        if i == n and state in ("", "a"):
            options.append((0, "", ()))
        if added < 3:
            role = "assistant" if state == "u" else "user"
            c, a, r = best(i, role[0], added + 1)
            options.append((c + 3, "I" + a, (f"{role}:", *r)))
        if i < n:
            _, _, role, text = rows[i]
            c, a, r = best(i + 1, state, 0)
            options.append((c + 4, "D" + a, r))
            if faults[i] not in ("blank", "duplicate"):
                more = 3 if faults[i] == "truncated" else 0
                for letter, cost, name in (("K", 0, role), ("R", 3, "user"), ("R", 3, "assistant")):
                    to = after(state, name[:1])
                    if to:
                        c, a, r = best(i + 1, to, 0)
                        options.append((c + cost + more, letter + a, (f"{name}:{text}", *r)))
        return min(options, default=(10**9, "", ()))

    cost, audit, lines = best(0, "", 0)
    letters = [r[2][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(letters, letters[1:], strict=False))
    return (*(faults.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def plain(rows):
    by = {r[0]: [] for r in rows}
    for r in spoiled(rows):
        by[r[0]].append(r)
    out = []
    for conv, own in by.items():
        turns = {r[1] for r in own} - {None}
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *mended(sorted(own, key=order_key))))
    return out


def ordered(rows):
    return sorted(map(tuple, rows), key=lambda r: (r[0] is None, r[0] or 0))


def made(seed, convs, longest):
    rng, rows = random.Random(seed), []
    for c in range(convs):
        for t in range(rng.randrange(1, longest)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "S"]) if rng.random() < 0.4 else ["user", "assistant"][t % 2]
            rows.append((c if c else None, rng.choice([t, t, t, t + 1, None]), role, rng.choice(["Yes.", "no", "So?! ", "", " \n", None, "Été!", "x" * 3000 + ".", f"row {t}."])))
    return rows


def frame(spark, rows):
    schema = "conv_id long, turn long, role string, text string, conv string, key string, sig string, n long, kind int"
    return spark.createDataFrame([(*r, "c", "k", "s", 1, 2) for r in rows], schema).repartition(3)


def repaired(spark, rows, tmp_path_factory, piece=None):
    d = str(tmp_path_factory.mktemp("conv"))
    frame(spark, rows).write.parquet(f"{d}/conversations.parquet")
    return C.op11_repair_conversations(spark, d) if piece is None else C.repair_all(C.read_table(spark, d, "conversations"), piece)


def test_repair_equals_plain_version(spark, tmp_path_factory):
    rows = made(5, 60, 9)
    got = repaired(spark, rows, tmp_path_factory)
    assert got.columns[:9] == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert ordered(got.collect()) == ordered(plain(rows))


def test_long_conversations_in_many_pieces(spark, tmp_path_factory, monkeypatch):
    rows = made(6, 6, 90)
    monkeypatch.setattr(C, "STEP", 2)  # groups of four tables, so several rounds
    got = repaired(spark, rows, tmp_path_factory, piece=3)
    assert ordered(got.collect()) == ordered(plain(rows))


def test_empty_table_and_conversations_without_rows(spark, tmp_path_factory):
    assert repaired(spark, [], tmp_path_factory).count() == 0
    lost = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    got = repaired(spark, [(lost, 0, "user", "Hi.")], tmp_path_factory).collect()
    assert [tuple(r) for r in got] == [(lost, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_nodes_are_shared_by_their_ends():
    made_, longer = [], C.longer
    try:
        C.longer = lambda x, node: made_.append(x) or longer(x, node)
        list(C.suffix_nodes(sorted(p[::-1] for p in ["48", "848", "048", "4848"])))
    finally:
        C.longer = longer
    assert len(made_) == 5  # 8, 48, 048, 848, 4848


def test_registered_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert ordered(C.op11_repair_conversations(spark, sf_dir).collect()) == ordered(plain(rows))


def test_damage_leaves_the_key_in_place(spark):
    rows = made(8, 5, 6)
    got = C.damage(frame(spark, rows)).select(F.col("conv"), "turn", "role", "text").collect()
    want = [("" if r[0] is None else f"={r[0]}", *r[1:]) for r in spoiled(rows)]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
