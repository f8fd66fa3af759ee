"""Conversation repair against an exhaustive search and a plain dynamic program."""

import hashlib
import itertools
import random
import re
import zlib
from functools import cache

from pyspark.sql import functions as F

from helixframe.llm import conversations

SCHEMA = "conv_id long, turn long, role string, text string, key string, again boolean, absent boolean"
BLANK = " \t\n\v\f\r"


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        end = text.rstrip(BLANK)[-1:]
        out.append("blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end not in ".!?" else None)
        seen.add((role, text))
    return out


def cheapest(rows, marks):
    """(cost, audit, repaired rows) by a search from the end over (row, initials' place)."""
    after = {"": "su", "s": "u", "u": "a", "a": "u"}

    @cache
    def rest(i, last, inserted):
        options = []
        if i == len(rows) and last in ("", "a"):
            options.append((0, "", ()))
        if inserted < 3:
            for c in after[last]:
                if c != "s":
                    cost, audit, tail = rest(i, c, inserted + 1)
                    options.append((cost + 5, "I" + audit, (("user" if c == "u" else "assistant", ""), *tail)))
        if i < len(rows):
            _, role, text = rows[i]
            cost, audit, tail = rest(i + 1, last, 0)
            options.append((cost + 2, "D" + audit, tail))
            if marks[i] not in ("blank", "duplicate"):
                late = 5 if marks[i] == "truncated" else 0
                if role[:1] and role[:1] in after[last]:
                    cost, audit, tail = rest(i + 1, role[:1], 0)
                    options.append((cost + late, "K" + audit, ((role, text), *tail)))
                for c in after[last]:
                    if c != "s":
                        cost, audit, tail = rest(i + 1, c, 0)
                        options.append((cost + 1 + late, "R" + audit, (("user" if c == "u" else "assistant", text), *tail)))
        return min(options, default=(10 ** 9, "", ()))

    return rest(0, "", 0)


def damaged(rows):
    out = []
    for conv, turn, role, text, *_ in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def brute(rows, ids):
    groups = {i: [] for i in ids}
    for conv, *row in rows:
        groups[conv].append(tuple(row))
    out, repaired = [], {}
    for conv, held in groups.items():
        held.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        marks = faults(held)
        cost, audit, kept = cheapest(held, marks)
        turns = [t for t, *_ in held if t is not None]
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(held, held[1:]))
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()
        out.append((conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, marks.count("blank"), marks.count("duplicate"),
                    marks.count("truncated"), illegal, cost, audit, digest))
        repaired[conv] = list(kept)
    return sorted(out, key=str), repaired


def sample(n, seed, longest=9):
    rng, rows = random.Random(seed), []
    texts = ["Yes.", "No!", "Why?", "cut off", "", " \n", "Long ago. \n", "a.b", None, "x" * 3000 + "."]
    for conv in [None, *range(n)]:
        turn = rng.randint(-3, 3)
        for _ in range(rng.randint(1, longest)):
            turn += rng.choice([0, 1, 1, 1, 2, 40])
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "User", "u"])
            rows.append((conv, None if rng.random() < 0.05 else turn, role, rng.choice(texts), "k", True, None))
    return rows


def test_query_against_brute_force(spark):
    rows = sample(400, 1)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = conversations.repair(conversations.damage(df), absent=F.col("absent")).collect()
    want, _ = brute(damaged(rows), {r[0] for r in rows})
    assert sorted(map(tuple, got), key=str) == want
    assert any(not r[7] for r in want)  # a conversation whose rows are all dropped


def test_repaired_rows_and_spills(spark):
    rows = sample(30, 2, 60)
    df = spark.createDataFrame([r[:4] for r in rows], "conv_id long, turn long, role string, text string")
    plain = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x, *_ in rows]
    want, repaired = brute(plain, {r[0] for r in rows})
    for buffer in (1 << 20, 2_000):
        got = conversations.repair(df, messages=True, buffer=buffer).collect()
        assert sorted([tuple(r)[:9] for r in got if r.seq is None], key=str) == want
        for conv, kept in repaired.items():
            assert [(r.role, r.text) for r in sorted((r for r in got if r.conv_id == conv and r.seq is not None), key=lambda r: r.seq)] == kept


def test_all_short_conversations():
    """Every sequence of up to five row classes costs and reads as the exhaustive search says."""
    classes = {"s.": ("system", "a."), "u.": ("user", "b."), "u!": ("user", "c"), "a.": ("assistant", "d."), "a!": ("assistant", "e"), "?.": ("tool", "f."),
               "-": ("user", "")}
    for n in range(6):
        for kinds in itertools.product(classes, repeat=n):
            rows = [(i, classes[k][0], classes[k][1] and f"{i}{classes[k][1]}") for i, k in enumerate(kinds)]
            marks = faults(rows)
            state, total, pointers = conversations.FIRST, 0, []
            for k in kinds:
                state, grown, pointer = conversations.step(state, k)
                total += grown
                pointers.append(conversations.POINTERS[pointer])
            above, place, last = conversations.ending(state)
            edits, start = conversations.trace(pointers, place)
            assert start == conversations.START
            assert (total + above, "".join(edits) + last) == cheapest(rows, marks)[:2], kinds


def test_giant_conversation(spark):
    n = 60_000
    rows = spark.range(n).select(F.lit("big").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"),
                                 F.concat(F.lit("text "), "id", F.lit(".")).alias("text"))
    got = conversations.repair(rows, buffer=200_000).collect()
    assert len(got) == 1 and got[0].audit == "K" * n and got[0].cost == 0 and got[0].gaps == 0
    text = "\n".join(f"{'user' if i % 2 == 0 else 'assistant'}:text {i}." for i in range(n))
    assert got[0].repaired_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert conversations.repair(conversations.damage(df), absent=F.col("absent")).count() == 0
