"""The change applier's rules as one loop, row by row."""

from __future__ import annotations

import math
import zlib
from collections import defaultdict
from datetime import datetime


def plain(rows: list[tuple]) -> list[tuple]:
    """Results of (change_id, client_id, seq, op, valid_at, city, balance, ...) rows."""
    rows = list(dict.fromkeys(rows))
    ranks: dict = defaultdict(set)
    for r in rows:
        ranks[r[1]].add(r[2])
    number = {c: {s: i for i, s in enumerate(sorted(x, key=lambda v: (v is None, v)), 1)} for c, x in ranks.items()}
    fed = defaultdict(list)
    for r in rows:
        h = zlib.crc32(str(r[0]).encode()) if r[0] is not None else 0
        if r[4] is None or h % 11 == 0:
            continue
        day = (r[4].date() - datetime(1970, 1, 1).date()).days + 5 * (h % 4)
        fed[max(1, min(10, 1 + (day - 19723) * 10 // 160))].append((day, r[0], number[r[1]][r[2]], *r[1:2], r[3], r[5], r[6]))
    state: dict = defaultdict(lambda: {"next": 1, "held": {}, "city": None, "balance": None, "last": None})
    out, latest = [], None

    def put(s: dict, n: int, batch: int, missed: int) -> None:
        _, change_id, client, op, city, balance = s["held"].pop(n)
        if op in ("I", "D"):
            s["city"], s["balance"] = (city, balance) if op == "I" else (None, None)
        elif op == "U":
            s["city"] = s["city"] if city is None else city
            s["balance"] = s["balance"] if balance is None else balance
        cents = None if s["balance"] is None else math.floor(100 * s["balance"] + 0.5)
        out.append([change_id, client, "applied", batch, missed, s["city"], cents, False])
        s["next"], s["last"] = n + 1, (len(out) - 1, op)

    def follow(s: dict, batch: int) -> None:
        while s["next"] in s["held"]:
            put(s, s["next"], batch, 0)

    for batch in range(1, 12):
        for s in state.values():
            while s["held"] and (batch == 11 or latest is not None and min(x[0] for x in s["held"].values()) + 8 <= latest):
                n = min(s["held"])
                put(s, n, batch, n - s["next"])
                follow(s, batch)
        for day, change_id, n, client, op, city, balance in sorted(fed[batch], key=lambda r: (r[0], r[1], r[2], str(r[3:]))):
            s = state[client]
            if n < s["next"] or n in s["held"]:
                out.append([change_id, client, "rejected", batch, 0, None, None, False])
                continue
            s["held"][n] = (day, change_id, client, op, city, balance)
            follow(s, batch)
        latest = max([x for x in [latest] if x is not None] + [r[0] for r in fed[batch]], default=None)
    for s in state.values():
        if s["last"] and s["last"][1] != "D":
            out[s["last"][0]][-1] = True
    return [tuple(r) for r in out]
