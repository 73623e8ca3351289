"""Conversation repair against a brute-force search that keeps the least (cost, audit) per state."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from tracetally.llm import turn_repair
from tracetally.llm.queries import QUERIES

SCHEMA = "conv_id long, turn long, role string, text string"
NEXT = {"": "u", "s": "u", "a": "u", "u": "a"}


def broken(rows):
    """The damage of the query's contract."""
    for c, t, r, x in rows:
        r, x, c_, t_ = (" " if v is None else str(v) for v in (r, x, c, t))
        lot = zlib.crc32(f"{c_}:{t_}".encode()) % 20
        x = "" if lot == 1 else x.translate(dict.fromkeys(map(ord, ".!?"))) if lot == 2 else x
        for _ in range((lot != 0) + (lot == 3)):
            yield c, t, "user" if lot == 4 else r, x


def plain(rows):
    return ((c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows)


def cheapest(rows):
    """(cost, audit, lines) of the least way over (initial, must go, cut, role, text) rows."""
    line = {"u": "user:", "a": "assistant:"}

    def put(best, state, value):
        if state not in best or value[:2] < best[state][:2]:
            best[state] = value

    def inserted(best):
        for _ in range(3):
            for state, (cost, audit, lines) in list(best.items()):
                put(best, NEXT[state], (cost + 3, audit + "I", lines + [line[NEXT[state]]]))
        return best

    best = inserted({"": (0, "", [])})
    for first, gone, cut, role, text in rows:
        new = {}
        for state, (cost, audit, lines) in best.items():
            put(new, state, (cost + 4, audit + "D", lines))
            if not gone:
                if first and (first == NEXT[state] or (first == "s" and state == "")):
                    put(new, first, (cost + 3 * cut, audit + "K", [*lines, f"{role}:{text}"]))
                put(new, NEXT[state], (cost + 3 + 3 * cut, audit + "R", lines + [line[NEXT[state]] + text]))
        best = inserted(new)
    return min(best[k] for k in ("", "a") if k in best)


def brute(rows, damage):
    white, convs = " \t\n\x0b\x0c\r", defaultdict(list)
    for c in {r[0] for r in rows}:
        convs[c] = []
    for c, t, r, x in damage(rows):
        convs[c].append((t, r, x))
    out = {}
    for c, turns in convs.items():
        turns.sort(key=lambda z: (z[0] is not None, z[0] or 0, z[1], hashlib.sha256(z[2].encode()).hexdigest()))
        seen, coded, found = set(), [], [0, 0, 0]
        for _, r, x in turns:
            body = x.strip(white)
            fault = 0 if not body else 1 if (r, x) in seen else 2 if body[-1] not in ".!?" else 3
            if fault < 3:
                found[fault] += 1
            seen.add((r, x))
            coded.append((r[:1] if r[:1] in "sua" else None, fault < 2, fault == 2, r, x))
        numbers = [t for t, _, _ in turns if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        cost, audit, lines = cheapest(coded)
        out[c] = (gaps, *found, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def repaired(df, **how):
    got = turn_repair.repair(df, **how).collect()
    out = {r[0]: tuple(r)[1:] for r in got}
    assert len(out) == len(got)
    return out


def made(seed, longest):
    rng, rows = random.Random(seed), []
    for conv in [*range(40), None]:
        for t in range(rng.choice([1, 2, 5, 30, longest])):
            role = rng.choice(["user", "assistant", "system", "tool", "", None, "user", "assistant", "umpire"])
            text = rng.choice(["a.", "b!", None, " \t", "", "no end", f"x{t}.", f"y{t}", f"z{t}?\n", "q\n."])
            rows.append((conv, rng.choice([None, t, t, t, t + 3]), role, text))
    return rows


@pytest.mark.parametrize("damage, plainly", [(turn_repair.damaged, broken), (turn_repair.undamaged, plain)])
def test_repair_is_cheapest_and_least(spark, damage, plainly):
    rows = made(5, 300)
    got = repaired(spark.createDataFrame(rows, SCHEMA), damage=damage)
    assert got == brute(rows, plainly)


def test_blocks_and_pieces_change_nothing(spark):
    rows = made(9, 150)
    df = spark.createDataFrame(rows, SCHEMA)
    assert repaired(df, block=16, piece=5) == brute(rows, plain)


def test_one_conversation_with_many_equal_rows(spark):
    rows = [(1, 7, "user", "same.")] * 500 + [(1, t, "assistant", "same.") for t in range(8, 200)] + [(1, 300, "user", "end")]
    assert repaired(spark.createDataFrame(rows, SCHEMA), block=64) == brute(rows, plain)


def test_extra_columns_and_empty_table(spark):
    df = spark.createDataFrame([(1, 1, "user", "hi.", 3, "x")], SCHEMA + ", block int, digest string")
    assert repaired(df) == brute([(1, 1, "user", "hi.")], plain)
    assert repaired(spark.createDataFrame([], SCHEMA)) == {}


def test_text_ids(spark):
    df = spark.createDataFrame([("a", 1, "user", "hi."), ("b", 1, "assistant", "so.")], SCHEMA.replace("conv_id long", "conv_id string"))
    assert {k: v[6] for k, v in repaired(df).items()} == {"a": "KI", "b": "IK"}


def test_auction_prices_on_a_piece():
    """Every arc's cost is at least the difference of its prices, and the way from the start is tight."""
    codes = "".join(chr(65 + 3 * k + f) for k, f in [(1, 0), (1, 2), (0, 0), (3, 0), (2, 1), (2, 0)])
    auction = turn_repair.Auction(turn_repair.arcs_of(codes), list(turn_repair.END_COST))
    audit, _ = auction.trace(0)
    for node, arcs in enumerate(auction.arcs):
        assert all(auction.price[node] <= cost + auction.price[t] for _, cost, t in arcs)
    assert sum(letter != "I" for letter in audit) == len(codes)


def test_registered_query(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r[0]: tuple(r)[1:] for r in QUERIES["op13_turn_repair"](spark, folder).collect()}
    assert got == brute(rows, broken)
