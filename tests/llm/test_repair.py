"""Conversation repair against a search over all edits, and its query against a plain loop."""

import hashlib
import heapq
import itertools
import os
import re
import zlib
from collections import defaultdict

import pytest

from lantern.llm import queries, repair

SF = "/root/testdata/sf0.001"


def searched(symbols: str) -> tuple[int, str]:
    """Cheapest edits by best-first search over (row, roles so far are legal up to here)."""
    queue = [(0, "", 0, "")]
    done = set()
    while queue:
        cost, audit, at, roles = heapq.heappop(queue)
        if at == len(symbols) and re.fullmatch("(s?(ua)+)?", roles):
            return cost, audit
        # What matters of the roles: whether any stand, and the last.
        state = (at, roles[-1:], audit)
        if state in done or not re.fullmatch("s?(ua)*u?", roles):
            continue
        done.add(state)
        if audit[-3:] != "III":
            for r in "ua":
                heapq.heappush(queue, (cost + 3, audit + "I", at, roles + r))
        if at < len(symbols):
            s = symbols[at]
            heapq.heappush(queue, (cost + 4, audit + "D", at + 1, roles))
            if s != "d":
                more = 3 * s.isupper()
                heapq.heappush(queue, (cost + more, audit + "K", at + 1, roles + s.lower()))
                for r in "ua":
                    heapq.heappush(queue, (cost + 3 + more, audit + "R", at + 1, roles + r))
    raise AssertionError


@pytest.mark.parametrize("n", range(5))
def test_solved_by_search(n):
    for symbols in itertools.product("suaxUAd", repeat=n):
        assert repair.solve("".join(symbols)) == searched("".join(symbols))


@pytest.mark.parametrize("symbols", ["uuaaxxSd", "sdxuAAuu", "auauauau", "dsuusaUd", "xxxxxxxx", "aaasuaau"])
def test_longer_by_search(symbols):
    assert repair.solve(symbols) == searched(symbols)


def test_very_long():
    cost, audit = repair.solve("sua" + "ua" * 50_000 + "u")
    assert cost == 3 and audit == "K" * 100_004 + "I"
    assert len(repair.script("sua" + "ua" * 50_000 + "u", audit)) == len(audit)


def expected(rows):
    """A plain loop over (conv, turn, role, text) rows after damage."""
    talks = defaultdict(list)
    for c, t, r, x in rows:
        talks[c].append((t is not None, t or 0, " " if r is None else r, " " if x is None else x))
    out = {}
    for c, own in talks.items():
        own.sort()
        seen, symbols, counts = set(), "", {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, _, r, x in own:
            body = x.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not body else "duplicate" if (r, x) in seen else "truncated" if body[-1] not in ".!?" else None
            seen.add((r, x))
            if fault:
                counts[fault] += 1
            known = r[:1] if r[:1] in ("s", "u", "a") else "x"
            symbols += "d" if fault in ("blank", "duplicate") else known.upper() if fault else known
        turns = [t for has, t, _, _ in own if has]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, audit = repair.solve(symbols)
        lines, at = [], 0
        roles = []
        for e in audit:
            _, _, r, x = own[at] if e != "I" else (0, 0, "", "")
            at += e != "I"
            if e == "D":
                continue
            r = r if e == "K" else "assistant" if roles and roles[-1] == "u" else "user"
            roles.append(r[:1])
            lines.append(f"{r}:{x}")
        out[c] = (gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")

ODD = [
    (1, 0, "system", "Be brief."), (1, 1, "user", "Hello!"), (1, 4, "assistant", "Yes"), (1, 4, "assistant", "Yes"),
    (2, None, None, None), (2, None, "user", "what?"), (2, 7, "tool", "x."), (2, 7, "", "y."),
    (None, 3, "user", "orphan."), (None, 1, "assistant", "Żółw…"), (None, 2, "User", "Big."),
    (3, 0, "user", "a.  \x0b\n"), (3, 1, "assistant", "\x1c"), (3, 2, "user", "long " * 20_000 + "."),
    (4, 5, "assistant", "only!"),
    (5, 0, "user", " "), (5, 1, "user", " "),
]


def test_odd_rows(spark):
    rows = spark.createDataFrame([(*r, 1, "x") for r in ODD], "conv_id long, turn long, role string, text string, cost int, signature string").repartition(3)
    report, turns = repair.repair(rows)
    assert {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in report.collect()} == expected(ODD)
    left = defaultdict(list)
    for r in sorted(turns.collect(), key=lambda r: r["step"]):
        left[r["conv_id"]].append(r["role"][0])
    assert all(re.fullmatch("(s?(ua)+)?", "".join(x)) for x in left.values())


def test_no_rows(spark):
    report, turns = repair.repair(spark.createDataFrame([], "conv_id string, turn int, role string, text string"))
    assert report.count() == 0 and turns.count() == 0


def damaged(rows):
    for c, t, r, x in rows:
        r, x = (" " if v is None else v for v in (r, x))
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if kind:
            one = (c, t, "user" if kind == 4 else r, "" if kind == 1 else re.sub("[.!?]", "", x) if kind == 2 else x)
            yield from [one] * (1 + (kind == 3))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_query_by_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    wanted = expected(list(damaged(rows)))
    empty = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    found = queries.QUERIES["op12_conversation_repair"](spark, SF).collect()
    assert {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in found} == {c: wanted.get(c, empty) for c in {r[0] for r in rows}}


def test_all_rows_dropped(spark):
    turn = next(t for t in range(1000) if zlib.crc32(f"9:{t}".encode()) % 20 == 0)
    rows = spark.createDataFrame([(9, turn, "user", "gone.")], "conv_id long, turn long, role string, text string")
    report, _ = repair.repair(repair.damaged(rows))
    assert [tuple(r) for r in repair.with_every(report, rows).collect()] == [(9, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
