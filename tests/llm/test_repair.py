"""Conversation repair against a forward search that keeps the best edits of each state."""

import hashlib
import random
import re
import zlib

import pytest

from tidewater.llm import repair

CONV = "conv_id long, turn long, role string, text string"
WS = " \t\n\x0b\x0c\r"
STEP = {("0", "s"): "S", ("0", "u"): "U", ("S", "u"): "U", ("U", "a"): "A", ("A", "u"): "U"}
NEW = (("u", "user"), ("a", "assistant"))


def better(some, state, edits):
    if state not in some or edits[:2] < some[state][:2]:
        some[state] = edits


def with_inserts(some):
    for _ in range(3):
        for q, (cost, audit, lines) in list(some.items()):
            for letter, role in NEW:
                if (q, letter) in STEP:
                    better(some, STEP[q, letter], (cost + 5, audit + "I", lines + (role + ":",)))
    return some


def cheapest(rows, fault):
    now = with_inserts({"0": (0, "", ())})
    for (_, role, text), f in zip(rows, fault):
        then = {}
        for q, (cost, audit, lines) in now.items():
            better(then, q, (cost + 2, audit + "D", lines))
            if f in ("b", "d"):
                continue
            cost += 5 * (f == "t")
            if (q, role[:1]) in STEP:
                better(then, STEP[q, role[:1]], (cost, audit + "K", lines + (f"{role}:{text}",)))
            for letter, name in NEW:
                if (q, letter) in STEP:
                    better(then, STEP[q, letter], (cost + 1, audit + "R", lines + (f"{name}:{text}",)))
        now = with_inserts(then)
    return min((now[q] for q in "0A" if q in now), key=lambda v: v[:2])


def brute(data):
    by, out = {}, {}
    for c, t, r, x in data:
        rows = by.setdefault(c, [])
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = (" " if v is None else v for v in (r, x))
        x = "" if k == 1 else re.sub("[.!?]", "", x) if k == 2 else x
        rows += [(t, "user" if k == 4 else r, x)] * (0 if k == 0 else 2 if k == 3 else 1)
    for c, rows in by.items():
        rows.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode()))
        seen, fault = set(), []
        for _, r, x in rows:
            y = x.strip(WS)
            fault.append("b" if not y else "d" if (r, x) in seen else "t" if y[-1] not in ".!?" else "")
            seen.add((r, x))
        turns = [t for t, _, _ in rows if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        cost, audit, lines = cheapest(rows, fault)
        out[c] = (gaps, *(fault.count(f) for f in "bdt"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def odd_rows():
    r = random.Random(3)
    rows = []
    for c in [None, *range(40)]:
        for _ in range(r.choice([1, 2, 5, 9, 30])):
            role = r.choice([None, "system", "user", "assistant", "user", "assistant", "tool", "ugly"])
            rows.append((c, r.choice([None, *range(-3, 12)]), role, r.choice([None, "", "\t", "Hi.", "Hi.", "hello", "ok?", "x\n", "é!", "z" * 30_000 + "." * r.randint(0, 1), f"n{r.random()}."])))
    rows += [(77, 5, "user", "same.")] * 50  # a hot row
    return rows + [(78, i // 2, ("user", "assistant")[i % 2], f"long {i}.") for i in range(400)]  # a hot conversation


@pytest.mark.parametrize("chunk_rows, chunk_bytes", [(4096, 1 << 20), (3, 1 << 20), (4096, 100)])
def test_repair_against_search(spark, chunk_rows, chunk_bytes):
    rows = odd_rows()
    df = spark.createDataFrame(rows, CONV).repartition(5)
    got = repair.repair(repair.damage(df), df.selectExpr("conv_id as conv"), chunk_rows, chunk_bytes).collect()
    assert {r[0]: tuple(r)[1:] for r in got} == brute(rows) and len(got) == len({r[0] for r in rows})


def test_extra_columns_and_no_rows(spark, tmp_path):
    rows = [(9, 1, "user", "Hi.", "x", 1), (9, 2, "assistant", "Yes.", "x", 1)]
    for name, data in (("some", rows), ("none", [])):
        spark.createDataFrame(data, CONV + ", conv string, m int").write.parquet(f"{tmp_path}/{name}/conversations.parquet")
    assert {r.conv_id: tuple(r)[1:] for r in repair.op11(spark, f"{tmp_path}/some").collect()} == brute([r[:4] for r in rows])
    assert repair.op11(spark, f"{tmp_path}/none").count() == 0


@pytest.mark.parametrize("codes, cost, audit", [("", 0, ""), ("ua", 0, "KK"), ("sua", 0, "KKK"), ("u", 2, "D"), ("ss", 2, "RR"), ("uu", 1, "KR"), ("suaus", 1, "KKKKR"), ("uaua", 0, "KKKK")])
def test_paths(codes, cost, audit):
    assert repair.audit_of(bytes("xsua".index(c) for c in codes)) == (cost, audit)
