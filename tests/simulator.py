"""The metering rules one event at a time, as an independent answer for tests."""

from collections import defaultdict


def level(quota, used):
    if quota <= 0:
        return 101
    left = max(0, quota - used)
    pct = left * 100 // quota
    return 0 if left == 0 else 10 if pct <= 10 else 30 if pct <= 30 else 50 if pct <= 50 else 101


def simulate(events, plans, families, members, gifts, opening=None):
    """events: dicts in any order. Returns takes by event id and alerts as a set of (kind, key, event id, level)."""
    opening = opening or {}
    plan, member, pool, gift = (defaultdict(int, opening.get(k, {})) for k in ("plan", "member", "pool", "gift"))
    last, out, alerts = {}, {}, set()

    def fire(kind, key, event, quota, used):
        th = level(quota, used)
        if th != 101 and th < last.get((kind, key), 101):
            last[kind, key] = th
            alerts.add((kind, key, event, th))

    for e in sorted(events, key=lambda e: (e["kst"], e["event_id"])):
        rest, s, f, month = e["bytes"], e["sub_id"], e["family_id"], e["yyyymm"]
        g_take = 0
        for gid, limit, _ in sorted(gifts.get((s, month), []), key=lambda g: (g[2], g[0])):
            take = min(rest, max(0, limit - gift[s, gid, month]))
            if take > 0:
                gift[s, gid, month] += take
                rest -= take
                g_take += take
                fire("gift", (s, gid, month), e["event_id"], limit, gift[s, gid, month])
        limit = plans.get(s, 0)
        period = e["yyyymmdd"] if limit == 1048576 else month
        p_take = rest if limit < 0 else min(rest, max(0, limit - plan[s, period]))
        plan[s, period] += p_take
        rest -= p_take
        m = members.get((f, s), 0)
        asked = min(rest, max(0, m - member[f, s, month])) if m > 0 else rest
        f_take = min(asked, max(0, families.get(f, 0) - pool[f, month]))
        member[f, s, month] += f_take
        pool[f, month] += f_take
        if p_take > 0:
            fire("plan", (s, month), e["event_id"], limit, plan[s, period])
        if f_take > 0:
            fire("pool", (f, month), e["event_id"], families.get(f, 0), pool[f, month])
        out[e["event_id"]] = (g_take, p_take, f_take, rest - f_take)
    return out, alerts
