from collections import Counter, defaultdict
from datetime import timedelta

from weftline.plans.streams import QUERIES
from weftline.session import table


def test_sessions_and_windows_hold_every_event(spark, sf):
    events = table(spark, sf, "events").selectExpr("cast(ts as timestamp) ts", "user_id", "event_type").collect()
    users, want = defaultdict(list), []
    for e in events:
        users[e.user_id].append(e.ts)
    for u, ts in users.items():
        open_ = []
        for t in sorted(ts):
            if open_ and t - open_[-1] >= timedelta(days=1):
                want.append((u, len(open_), open_[0], open_[-1]))
                open_ = []
            open_.append(t)
        want.append((u, len(open_), open_[0], open_[-1]))
    assert Counter(map(tuple, QUERIES["stream_sessions"](spark, sf).collect())) == Counter(want)
    got = QUERIES["stream_windows"](spark, sf).collect()
    assert sum(r.n for r in got) == len(events)
    assert Counter(r.event_type for r in events) == sum((Counter({r.event_type: r.n}) for r in got), Counter())
