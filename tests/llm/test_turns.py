import hashlib
import heapq
import itertools
import random
import zlib

import pytest

from lodestrand.llm import queries, turns

SCHEMA = "conv_id long, turn long, role string, text string"
SPACE = " \t\n\x0b\x0c\r"


def brute_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        case = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if case == 1 else "".join(c for c in text if c not in ".!?") if case == 2 else text
        out += [(conv, turn, "user" if case == 4 else role, text)] * (0 if case == 0 else 2 if case == 3 else 1)
    return out


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        ink = [c for c in text if c not in SPACE]
        out.append("blank" if not ink else "duplicate" if (role, text) in seen else "truncated" if ink[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, found):
    """(cost, audit, repaired rows) by a search over whole edit strings in order of cost and letters."""
    step = {"": "u", "s": "u", "a": "u", "u": "a"}
    full = {"u": "user", "a": "assistant"}
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, k, last, kept = heapq.heappop(heap)
        if k == len(rows) and last in ("", "a"):
            return cost, audit, kept
        if (k, last) in done:
            continue
        done.add((k, last))
        need = step[last]
        heapq.heappush(heap, (cost + 3, audit + "I", k, need, kept + ((full[need], ""),)))
        if k < len(rows):
            role, text = rows[k]
            heapq.heappush(heap, (cost + 4, audit + "D", k + 1, last, kept))
            if found[k] in ("", "truncated"):
                more = 3 * (found[k] == "truncated")
                for initial in {need} | ({"s"} if last == "" else set()):
                    if role[:1] == initial:
                        heapq.heappush(heap, (cost + more, audit + "K", k + 1, initial, kept + ((role, text),)))
                heapq.heappush(heap, (cost + 3 + more, audit + "R", k + 1, need, kept + ((full[need], text),)))


def brute(rows, damage=True):
    original = {r[0] for r in rows}
    rows = brute_damage(rows) if damage else [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    out = {}
    for conv in original:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        at = [r[1] for r in own if r[1] is not None]
        plain = [(r[2], r[3]) for r in own]
        found = faults(plain)
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(plain, plain[1:]))
        cost, audit, kept = cheapest(plain, found)
        out[conv] = (max(at) - min(at) + 1 - len(set(at)) if at else 0, *[found.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest())
    return out


def rows_of(df):
    return {r.conv_id: tuple(r[1:]) for r in df.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()}


def query(spark, rows, tmp_path, schema=SCHEMA):
    spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(str(tmp_path / "conversations.parquet"))
    return rows_of(queries.queries()["op13_repair"](spark, str(tmp_path)))


def hostile():
    """Conversations of every kind of turn, with nulls, ties, gaps and repeated rows."""
    r = random.Random(3)
    roles, texts = ["user", "assistant", "system", "tool", "", None, "User", "u", "s"], ["Hi.", "Hi", "What? ", "no\n\t", "", None, "é！", "Hi.", "Yes!", "x." * 50]
    rows = []
    for conv in [*range(120), None, -7]:
        for k in range(r.randrange(1, 12)):
            rows.append((conv, r.choice([k, k, k, k + 3, 2, None]), r.choice(roles[: r.choice([2, 3, 9])]), r.choice(texts[: r.choice([3, 10])])))
    return rows + rows[:9] + rows[:3]


def test_brute_force(spark, tmp_path):
    assert query(spark, hostile(), tmp_path) == brute(hostile())


def test_chunks_and_branches_change_nothing(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(turns, "CHUNK", 3)
    monkeypatch.setattr(turns, "FAN", 2)
    r = random.Random(4)
    rows = hostile() + [(500, k, r.choice(["user", "assistant", "system", "user"]), r.choice(["a.", "b", f"{k}!", f"{k}."])) for k in range(300)]
    assert query(spark, rows, tmp_path) == brute(rows)


def test_given_tables(spark, sf_dir):
    given = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert rows_of(queries.queries()["op13_repair"](spark, sf_dir)) == brute(given)


def test_matrices_find_the_least_of_all_edit_strings():
    """Every conversation of up to four turns, against the search; and products in any order."""
    initials = {"s": "system", "u": "user", "a": "assistant", "": "tool"}
    names = {turns.CLEAN: "", turns.GONE: "blank", turns.CUT: "truncated"}
    for n in range(5):
        for kinds in itertools.product(turns.TURNS, repeat=n) if n < 4 else random.Random(1).sample(list(itertools.product(turns.TURNS, repeat=4)), 1500):
            total = turns._closure()
            for k in kinds:
                total = turns.times(total, turns.TURNS[k])
            cost, audit, _ = cheapest([(initials[i], "t") for i, _ in kinds], [names[f] for _, f in kinds])
            assert min(total[turns.START], total[turns.ANSWERED]) == (cost, audit), kinds
            if n == 4:
                a, b, c, d = (turns.TURNS[k] for k in kinds)
                assert turns.times(turns.times(a, b), turns.times(c, d)) == turns.times(a, turns.times(turns.times(b, c), d))


def test_repaired_turns_are_legal(spark):
    rows = spark.createDataFrame(hostile(), SCHEMA)
    summary, repaired = turns.repair(rows)
    assert repaired.columns == ["conv_id", "lo", "place", "role", "text", "edit"]
    by = {}
    for r in repaired.orderBy("lo", "place").collect():
        by.setdefault(r.lo, []).append(r)
    for own in by.values():
        said = "".join(r.role[:1] for r in own)
        assert [r.place for r in own] == list(range(len(own))) and said.lstrip("s").replace("ua", "") == "" and said.count("s") <= 1
    audits = {r.lo: r.audit for r in summary.collect()}
    assert all("".join(r.edit for r in by.get(lo, [])) == a.replace("D", "") for lo, a in audits.items())


def test_dropped_conversations_empty_tables_and_extra_columns(spark, tmp_path):
    gone = next(k for k in range(10_000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    assert query(spark, [(gone, 0, "user", "Hi.")], tmp_path) == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert query(spark, [], tmp_path) == {}
    rows = [(1, k, "user", "Hi.", k, "z") for k in range(5)]
    assert query(spark, rows, tmp_path, SCHEMA + ", at long, lo string") == brute([r[:4] for r in rows])
