import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from contexture.llm import repair

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
EMPTY = hashlib.sha256(b"").hexdigest()


def brute_edits(rows):
    """Every way of editing ``(role, text, fault)``; the least (cost, audit, result)."""

    # Plain recursion with a bound on insertions in a row; more than three in a row never pay.
    @lru_cache(None)
    def cached(done, last, inserted):
        found = []
        if done == len(rows) and last in ("", "a"):
            found.append((0, "", ()))
        step = "a" if last == "u" else "u"
        role = {"u": "user", "a": "assistant"}[step]
        if inserted < 3:
            c, a, w = cached(done, step, inserted + 1)
            found.append((c + 3, "I" + a, (f"{role}:",) + w))
        if done < len(rows):
            own, text, fault = rows[done]
            c, a, w = cached(done + 1, last, 0)
            found.append((c + 4, "D" + a, w))
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                c, a, w = cached(done + 1, step, 0)
                found.append((c + 3 + more, "R" + a, (f"{role}:{text}",) + w))
                initial = own[:1]
                if initial == step or (initial == "s" and last == ""):
                    c, a, w = cached(done + 1, initial, 0)
                    found.append((c + more, "K" + a, (f"{own}:{text}",) + w))
        return min(found) if found else (10**9, "", ())

    cost, audit, written = cached(0, "", 0)
    return cost, audit, "\n".join(written)


def damage(rows):
    out, ids = [], []
    for conv, turn, role, text, *_ in rows:
        ids.append(conv)
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(kind, text)
        role = "user" if kind == 4 else role
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out, set(ids)


def brute(rows):
    rows, ids = damage(rows)
    out = []
    for conv in ids:
        own = [r for r in rows if r[0] == conv]
        own.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.md5(r[3].encode()).digest()))
        seen, faults = set(), []
        for _, _, role, text in own:
            shown = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = "blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else ""
            seen.add((role, text))
            faults.append(fault)
        turns = [r[1] for r in own if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        initials = [r[2][:1] for r in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        cost, audit, text = brute_edits(tuple((r[2], r[3], f) for r, f in zip(own, faults, strict=True)))
        counts = [faults.count(x) for x in ("blank", "duplicate", "truncated")]
        out.append((conv, gaps, *counts, illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


def conversations(seed=1, count=150):
    pick = random.Random(seed)
    roles = ["user", "assistant", "system", "user", "assistant", "", None, "tool", "umpire", "ström"]
    texts = ["a.", "b", "c? \n", "", " \t\r\x0b", None, "é!", "x\ny.", "a.", "ß \f", "…", "🙂."]
    rows = []
    for conv in range(count):
        for turn in range(pick.randint(1, 9)):
            turn = None if pick.random() < 0.1 else turn * pick.choice([1, 1, 1, 3]) - pick.choice([0, 0, 5])
            rows.append((conv, turn, pick.choice(roles), pick.choice(texts)))
    rows += [(None, k, pick.choice(roles), f"{k}.") for k in range(7)]
    return rows + [(7000, None, None, None), (7001, 1, "user", "hi."), (7001, 1, "user", "hi.")]


def frame(spark, rows, parts=3):
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_rows_are_those_of_brute_force(spark, seed):
    rows = conversations(seed)
    found = repair.repaired(repair.damaged(frame(spark, rows)))
    assert sorted((tuple(r) for r in found.collect()), key=repr) == brute(rows)


def test_search_against_brute_force_on_many_short_conversations():
    pick = random.Random(9)
    faults = {"": repair.SOUND, "blank": repair.BLANK, "duplicate": repair.DUPLICATE, "truncated": repair.CUT}
    for _ in range(1500):
        rows = tuple((pick.choice(["s", "u", "a", "t"]), "x", pick.choice(["", "", "", *faults])) for _ in range(pick.randint(0, 9)))
        cost, audit, _ = brute_edits(rows)
        assert repair.Search([(r, faults[f]) for r, _, f in rows]).solve() == (cost, audit)


def test_the_search_proves_its_result_in_few_steps():
    pick = random.Random(4)
    turns = [(pick.choice("suat"), pick.choice([0, 0, 0, 1, 2, 3])) for _ in range(20_000)]
    search = repair.Search(turns)
    cost, audit = search.solve()
    assert cost == search.bounds[0][repair.START] and search.pushed <= 12 * len(turns)
    assert len(audit) - audit.count("I") == len(turns)


def test_order_of_prefixes_is_that_of_their_letters():
    search = repair.Search([])
    pick = random.Random(2)
    known = {0: ""}
    for _ in range(300):
        before = pick.choice(list(known))
        letter = pick.choice("DIKR")
        known[search._prefix(letter, before)] = known[before] + letter
    for one in known:
        for two in known:
            assert search.comes_first(one, two) == (known[one] < known[two])


def gone():
    """Conversations of one turn that damage drops."""
    return [c for c in range(2000) if zlib.crc32(f"{c}:1".encode()) % 20 == 0]


def test_a_conversation_without_rows_after_damage(spark):
    rows = [(c, 1, "user", "hi.") for c in gone()]
    found = repair.repaired(repair.damaged(frame(spark, rows)))
    assert sorted(tuple(r) for r in found.collect()) == [(c, 0, 0, 0, 0, 0, 0, "", EMPTY) for c in gone()]


def test_long_texts_and_conversations(spark):
    rows = [(1, k, "user" if k % 2 == 0 else "assistant", f"{k % 50}.") for k in range(150)]
    rows += [(2, 0, "user", "x" * 3_000_000), (2, 1, "assistant", " " * 1_000_000 + "y.")]
    found = repair.repaired(repair.damaged(frame(spark, rows, 5)))
    assert sorted((tuple(r) for r in found.collect()), key=repr) == brute(rows)


def test_extra_columns_with_clashing_names(spark):
    rows = conversations(5, 20)
    turns = frame(spark, rows)
    for name in ("kind", "gone", "phase", "digest", "fault", "half", "copy"):
        turns = turns.withColumn(name, F.lit("x"))
    found = repair.repaired(repair.damaged(turns))
    assert sorted((tuple(r) for r in found.collect()), key=repr) == brute(rows)


def test_empty_table(spark):
    assert repair.repaired(repair.damaged(frame(spark, []))).collect() == []
