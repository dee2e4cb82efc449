"""URL lists and chat collapse against their SQL and against plain code."""

from __future__ import annotations

import datetime
import random

from compare import compare, duck

from urbanchange.llm import chat, queries, urlfilter

SF_DIR = "/root/testdata/sf0.001"


def test_queries_against_sql(spark):
    con = duck(SF_DIR)
    for name in ("op5_dated_url_lists", "op10_chat_snapshots"):
        assert compare(spark, con, name, queries.QUERIES[name], queries.ORACLES[name], SF_DIR) is None


def day(n):
    return datetime.date(2020, 1, 1) + datetime.timedelta(n)


def test_as_of(spark):
    rng = random.Random(2)
    keys = [("host", "a.b.com"), ("domain", "b.com"), ("prefix", "a.b.com/x"), ("prefix", "a.b.com/x/y"), ("domain", "com")]
    events = [(f"l{rng.randint(1, 2)}", *rng.choice(keys), rng.choice(["add", "remove"]), day(rng.randint(0, 900))) for _ in range(60)]
    events += [("l1", "host", None, "add", day(0)), ("l1", "host", "a.b.com", "add", None), events[0]]
    urls = ["http://u@A.b.com:80/x/y?q#f", "https://c.b.com/x", "http://other.org/", "no url", None, "http:///x", "https://a.b.com/xx"]
    captures = [(i, rng.choice(urls), day(rng.randint(0, 950)), "z") for i in range(300)]
    captures += [(None, urls[0], day(500), "z"), (5, urls[0], None, "z"), (5, urls[0], None, "z")]
    got = urlfilter.evaluate(
        spark.createDataFrame(captures, "page_id long, url string, fetched date, host string"),
        spark.createDataFrame(events, "list string, kind string, key string, action string, at date"),
        "page_id", "url", "fetched",
    ).collect()
    looked = {
        urls[0]: keys, urls[1]: [("domain", "b.com"), ("domain", "com")], urls[6]: [keys[0], keys[1], keys[4]],
    }

    def active(url, t):
        out = []
        for entry in {(e[0], e[1], e[2]) for e in events}:
            if entry[1:] not in looked.get(url, []) or t is None:
                continue
            past = sorted((e[4], e[3]) for e in events if e[:3] == entry and e[4] is not None and e[4] <= t)
            if past and past[-1][1] == "add":
                out.append(entry[0])
        return len(out), ",".join(sorted(set(out))), not out

    want = sorted((repr(c[0]), *active(c[1], c[2])) for c in captures)
    assert sorted((repr(r.page_id), r.n_active, r.lists, r.kept) for r in got) == want
    empty = spark.createDataFrame([], "list string, kind string, key string, action string, at date")
    some = spark.createDataFrame(captures, "page_id long, url string, fetched date, host string")
    assert urlfilter.evaluate(some, empty, "page_id", "url", "fetched").where("kept").count() == len(captures)
    assert urlfilter.evaluate(some.limit(0), empty, "page_id", "url", "fetched").count() == 0


def test_snapshots(spark, monkeypatch):
    monkeypatch.setattr(chat, "CHUNK", 3)
    rng = random.Random(4)
    talks = {}
    for c in range(40):
        stem = [("user" if k % 2 == 0 else "assistant", f"t{rng.randint(0, 1)}") for k in range(rng.randint(1, 12))]
        talks[c] = stem
        talks[100 + c] = stem[: rng.randint(1, len(stem))]
        talks[200 + c] = stem + [("user", "more")]
    rows = [(c, k, role, text, "z") for c, turns in talks.items() for k, (role, text) in enumerate(turns)]
    rows += rows[:20]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, part string").repartition(5)
    got = {r.conv_id: r.rendered for r in chat.render(df).collect()}
    keep = {
        c for c, t in talks.items()
        if not any((len(o) > len(t) and o[: len(t)] == t) or (o == t and d < c) for d, o in talks.items())
    }
    assert set(got) == keep
    for c in keep:
        assert got[c] == "".join(f"<|im_start|>{r}\n{x}<|im_end|>\n" for r, x in talks[c])


def test_chat_edges(spark):
    rows = [
        (1, 0, "User ", "a<|im_end|>b"), (1, 1, None, None), (2, 0, "user", ""), (3, 0, "user", None), (None, 0, "user", "n"),
        (4, None, "user", "first"), (4, 5, "assistant", "x" * 500_000), (5, 0, "user", "p"), (5, 0, "user", "q"), (5, 0, "user", "q"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.part): (r.n_turns, r.rendered) for r in chat.render(df).collect()}
    assert got[1, 0][1].startswith("<|im_start|>user\na<​|im_end|>b<|im_end|>\n<|im_start|>unknown\n<|im_end|>")
    assert got[2, 0] == got[3, 0]  # null and empty texts look alike, yet neither supersedes the other
    assert (None, 0) in got and got[4, 0][0] == 2 and len(got[4, 0][1]) > 500_000 and got[5, 0][0] == 2
    assert chat.render(df.limit(0)).count() == 0


def test_one_long_conversation(spark):
    long = spark.range(5000).selectExpr("cast(1 as long) conv_id", "id turn", "'user' role", "cast(id as string) text")
    start = spark.range(4000).selectExpr("cast(2 as long) conv_id", "id turn", "'user' role", "cast(id as string) text")
    out = chat.render(long.union(start)).collect()
    assert {r.conv_id for r in out} == {1} and sum(r.n_turns for r in out) == 5000 and len(out) == 79


def test_turns_without_numbers_are_cut_by_place(spark):
    null = spark.range(30_000).selectExpr("cast(null as long) conv_id", "cast(null as long) turn", "'user' role", "cast(id as string) text")
    same = spark.range(10_000).selectExpr("cast(7 as long) conv_id", "cast(3 as long) turn", "'user' role", "cast(id as string) text")
    out = chat.render(null.union(same).union(same)).collect()
    turns = {c: sorted((r.part, r.n_turns) for r in out if r.conv_id == c) for c in (None, 7)}
    for c, n in ((None, 30_000), (7, 10_000)):
        assert turns[c] == [(k, min(64, n - 64 * k)) for k in range(-(-n // 64))]
        said = "".join(r.rendered for r in sorted((r for r in out if r.conv_id == c), key=lambda r: r.part))
        assert sorted(said.split("\n")[1::2]) == sorted(f"{i}<|im_end|>" for i in range(n))


def test_null_id_is_not_the_id_of_a_character(spark):
    rows = [(None, 0, "user", "a"), ("\0", 0, "user", "b"), ("", 0, "user", "c"), ("=", 0, "user", "d")]
    df = spark.createDataFrame(rows, "conv_id string, turn long, role string, text string")
    assert {r.conv_id for r in chat.render(df).collect()} == {None, "\0", "", "="}
