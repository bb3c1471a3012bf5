"""Temporal URL filter against a day-by-day replay of the list log."""

import datetime as dt
import random
import re

from tongueloom.llm.urlfilter import judge


def stands_for(url):
    m = re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)([^?#]*)", url or "")
    host = re.sub(r"\.?(:[0-9]*)?$", "", re.sub("^.*@", "", m.group(1)), count=1).lower() if m else ""
    if not host:
        return set()
    labels, path = host.split("."), [s.lower() for s in m.group(2).split("/") if s]
    return {".".join(labels[i:]) for i in range(max(1, len(labels) - 1))} | {"/".join([host, *path[:i]]) for i in range(1, min(2, len(path)) + 1)}


def replay(captures, log):
    out = {}
    for i, url, day in captures:
        state = {}
        for lst, kind, pattern, at, action in sorted((r for r in log if None not in r), key=lambda r: (r[3], r[4])):
            if day is not None and at <= day and action in ("add", "remove"):
                state[lst, kind, pattern.lower()] = action
        on = [k for k, a in state.items() if a == "add" and k[2] in stands_for(url)] if day is not None else []
        blocked = bool(on) and max((len(k[2]), k[1] == "allow") for k in on)[1] is False
        out[i] = (len(on), sorted(":".join(k) for k in on), blocked)
    return out


def test_against_replay(spark):
    rnd, day = random.Random(8), dt.date(2024, 1, 1)
    hosts = ["a.example.com", "b.a.example.com", "example.org", "localhost", "X.Example.com"]
    urls = [f"http{s}://{u}{h}{p}{t}" for s in ("", "s") for u in ("", "me@") for h in hosts for p in ("", ":80") for t in ("", "/", "/p/q/r?x=1", "/P#f", "?y")]
    urls += [None, "", "not a url", "ftp:///x", "http://"]
    captures = [(i, rnd.choice(urls), rnd.choice([None] + [day + dt.timedelta(k) for k in range(0, 200, 3)])) for i in range(300)]
    pool = ["a.example.com", "example.com", "EXAMPLE.org", "example.org/p", "example.org/p/q", "localhost", "x.example.com/p", None]
    log = [(rnd.choice(["l1", "l2"]), rnd.choice(["block", "allow"]), rnd.choice(pool), day + dt.timedelta(rnd.randint(-20, 190)),
            rnd.choice(["add", "add", "remove", "oops"])) for _ in range(160)]
    cap = spark.createDataFrame(captures, "page_id long, url string, day date").selectExpr("*", "1 as pattern", "2 as bucket", "3 as active")
    got = {r.page_id: (r.n_active, r.active, r.blocked) for r in judge(cap, spark.createDataFrame(log, "list string, kind string, pattern string, day date, action string")).collect()}
    assert got == replay(captures, log)


def test_empty_and_repeated(spark):
    cap = spark.createDataFrame([(1, "http://a.b/", dt.date(2024, 1, 1))] * 2, "page_id long, url string, day date")
    log = spark.createDataFrame([], "list string, kind string, pattern string, day date, action string")
    assert [r.blocked for r in judge(cap, log).collect()] == [False, False] and judge(cap.limit(0), log).count() == 0
    one = spark.createDataFrame([("l", "block", "a.b", dt.date(2023, 1, 1), "add")], log.schema)
    assert [(r.page_id, r.pattern, r.blocked) for r in judge(cap.selectExpr("*", "7 as pattern"), one).collect()] == [(1, 7, True)] * 2


def test_entries_of_any_depth(spark):
    day = dt.date(2024, 1, 1)
    urls = ["http://h.com/a/b/c/d/e.html?q", "http://h.com/a/b/c", "http://H.com//A/b/", "http://h.com/a/b/cc", "http://h.com", "http://h.com/" + "s/" * 40]
    cap = spark.createDataFrame([(i, u, day) for i, u in enumerate(urls)], "page_id long, url string, day date")
    schema = "list string, kind string, pattern string, day date, action string"
    entries = ["h.com/a/b/c", "h.com/A/b/c/d/e.html", "h.com/" + "/".join("s" * 40)]
    got = {r.page_id: r.active for r in judge(cap, spark.createDataFrame([("l", "block", e, day, "add") for e in entries], schema)).collect()}
    assert got == {0: ["l:block:h.com/a/b/c", "l:block:h.com/a/b/c/d/e.html"], 1: ["l:block:h.com/a/b/c"], 2: [], 3: [], 4: [],
                   5: ["l:block:h.com/" + "/".join("s" * 40)]}
    host = [("l", "block", "h.com", day, "add")]
    assert all(r.blocked for r in judge(cap, spark.createDataFrame(host, schema)).collect())
