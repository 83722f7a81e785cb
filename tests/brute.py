"""Plain Python versions of operators, for small fixtures only."""

from __future__ import annotations

import ipaddress
from collections import defaultdict


def plain_ip(text):
    t = text.strip().lower()
    if not t:
        return None
    if t.startswith("::ffff:") and "." in t:
        t = t[7:]
    if "." in t:
        return ".".join(str(int(p)) for p in t.split("."))
    return str(ipaddress.ip_address(t))


def sessions(packets, gap_us):
    """packets: dicts of key, us, id, opens, token -> {(first id, last id, count)}"""
    by = defaultdict(dict)
    for p in packets:
        if p["key"] is not None and p["us"] is not None and p["id"] is not None:
            by[p["key"]].setdefault((p["us"], p["id"]), p)
    found = []
    for key, rows in by.items():
        run, began, last = [], None, None
        for at in sorted(rows):
            p = rows[at]
            opens = bool(p["opens"])
            fresh = last is None or at[0] - last > gap_us
            if fresh or (opens and (began is None or began[0] != p["token"])):
                if run:
                    found.append((run[0], run[-1], len(run)))
                run, began = [], (p["token"],) if opens else None
            run.append(p["id"])
            last = at[0]
        if run:
            found.append((run[0], run[-1], len(run)))
    return found


def packed(text, separators="|;,/&+·•；，、｜／", brackets="()[]{}<>（）［］【】"):
    """Values of a packed text, one character at a time."""
    if text is None:
        return []
    out, cur, i, quoted = [], "", 0, False
    while i < len(text):
        c = text[i]
        if c in "'\"":
            if cur.strip():
                out.append(cur.strip())
            cur, i = "", i + 1
            while i < len(text):
                if text[i] == c:
                    if text[i + 1 : i + 2] == c:
                        cur += c
                        i += 2
                        continue
                    break
                cur += text[i]
                i += 1
            out.append(cur.strip())
            cur = ""
        elif c.isspace() or c in separators or c in brackets or c in "﻿​":
            out.append(cur)
            cur = ""
        else:
            cur += c
        i += 1
    out.append(cur)
    return [v for v in out if v]
