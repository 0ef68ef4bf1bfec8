"""Order semantics of O-P1 (cap, counters, keep-first) against a brute-force loop
that follows the reference item by item, on small random feeds."""

import datetime as dt
import random
import re

import pytest

from trendspark.operators import ingest as I
from trendspark.params import Params

HOSTS = ["a.ru", "news.x.ru", "guru.com", "b.com", "c.co.uk", "ru", "d.org"]


def host_of(url):
    m = re.match(r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:\[\]]+)", url or "")
    return m.group(1).lower() if m else ""


def brute_force(items, news, stored, min_traffic, cap, tlds):
    """The reference's loop: cap check, traffic, date, TLD, stored/inserted key."""
    keys = set(stored)
    status, imported, accepted = {}, 0, []
    for pos, title, traffic, pub in sorted(items):
        if imported >= cap:
            break
        if min_traffic and traffic < min_traffic:
            status[pos] = "skipped_traffic"
            continue
        if pub is None:
            status[pos] = "bad_date"
            continue
        hit = False
        for url in news.get(pos, []):
            h = host_of(url)
            if url and h and any(h == t or h.endswith("." + t) for t in tlds):
                hit = True
                break
        if hit:
            status[pos] = "filtered_tld"
            continue
        if (title, pub) in keys:
            status[pos] = "duplicate"
            continue
        keys.add((title, pub))
        status[pos] = "accepted"
        accepted.append(pos)
        imported += 1
    for pos, *_ in items:
        status.setdefault(pos, "after_cap")
    return status, accepted


def make_feed(seed, n=150, hot=False):
    r = random.Random(seed)
    items, news = [], {}
    for pos in range(n):
        title = f"t{r.randrange(12)}"
        pub = None if r.random() < 0.08 else dt.datetime(2025, 1, 1 + r.randrange(4))
        if hot and r.random() < 0.34:  # one key holds about a third of the feed
            title, pub = "hot", dt.datetime(2025, 1, 1)
        items.append((pos * 3 + 1, title, r.randrange(0, 400), pub))
        news[pos * 3 + 1] = [r.choice(["", "nohost/x"] + [f"https://{h}/p" for h in HOSTS]) for _ in range(r.randrange(0, 4))]
    stored = {(f"t{r.randrange(12)}", dt.datetime(2025, 1, 1 + r.randrange(4))) for _ in range(6)}
    return items, news, stored


@pytest.mark.parametrize("seed,min_traffic,cap,tlds,hot", [
    (1, 100, 5, "ru", False), (2, None, 5, "", False), (3, 0, 3, "co.uk, RU", False), (4, 250, 50, "org", False),
    (5, 50, 1000, "ru,com", False), (6, 100, 1000, "ru", True), (7, None, 4, "org", True),
])
def test_status_cap_counters_match_loop(spark, seed, min_traffic, cap, tlds, hot):
    items, news, stored = make_feed(seed, hot=hot)
    p = Params(min_traffic=min_traffic, max_trends=cap, filtered_tlds=tlds)
    idf = spark.createDataFrame(items, "feed_pos long, title string, traffic long, pub_date timestamp")
    ndf = spark.createDataFrame([(k, u) for k, us in news.items() for u in us], "feed_pos long, url string")
    sdf = spark.createDataFrame(list(stored), "title string, pub_date timestamp")
    st = I.item_status(idf, ndf, sdf, p)
    run = {r.feed_pos: r.status for r in I.with_run_status(st, p).collect()}
    run = {k: ("duplicate" if v.startswith("duplicate") else v) for k, v in run.items()}
    want, accepted = brute_force(items, news, stored, min_traffic, p.cap, [t.strip().lower() for t in tlds.split(",") if t.strip()])
    assert run == want
    assert [r.feed_pos for r in I.ingest_cap(st, p).collect()] == accepted
    summary = {r.status: r.n_items for r in I.ingest_summary(st, p).collect()}
    assert sum(summary.values()) == len(items)
    assert summary.get("accepted", 0) == len(accepted)


def test_cap_reached_exactly_on_last_item(spark):
    items = [(1, "a", 10, dt.datetime(2025, 1, 1)), (2, "b", 10, dt.datetime(2025, 1, 1))]
    idf = spark.createDataFrame(items, "feed_pos long, title string, traffic long, pub_date timestamp")
    empty = spark.createDataFrame([], "feed_pos long, url string")
    none = spark.createDataFrame([], "title string, pub_date timestamp")
    st = I.item_status(idf, empty, none, Params(max_trends=2))
    assert {r.status: r.n_items for r in I.ingest_summary(st, Params(max_trends=2)).collect()} == {"accepted": 2}


def test_first_duplicate_removed_by_traffic_lets_second_in(spark):
    items = [(1, "a", 5, dt.datetime(2025, 1, 1)), (2, "a", 500, dt.datetime(2025, 1, 1)), (3, "a", 500, dt.datetime(2025, 1, 1))]
    idf = spark.createDataFrame(items, "feed_pos long, title string, traffic long, pub_date timestamp")
    empty = spark.createDataFrame([], "feed_pos long, url string")
    none = spark.createDataFrame([], "title string, pub_date timestamp")
    st = {r.feed_pos: r.status for r in I.item_status(idf, empty, none, Params(min_traffic=100)).collect()}
    assert st == {1: "skipped_traffic", 2: "accepted", 3: "duplicate_in_feed"}
