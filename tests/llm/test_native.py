"""Licence digests, sharding and revisits."""

import hashlib

import pytest

from tillwork.llm import licenses, sharding, warc_revisits
from tillwork.llm.queries import SHARDS


def test_licenses(spark):
    mit = licenses.KNOWN[0][1]
    rows = [(1, "Copyright (c) 2020 Someone\n\n" + mit.upper().replace("SUBLICENSE", "Sub-License") + "\n(C) me"),
            (2, mit + " extra"), (3, "some prose\nReleased under the MIT licence\n  licensed under CC BY-NC 4.0"), (4, None), (4, ""), (None, mit),
            (6, "copyright line only\n" * 5000)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, license string")
    got = {r["doc_id"]: (r["license"], r["notices"]) for r in licenses.scan_licenses(docs).collect()}
    assert got[1] == ("MIT", []) and got[2][0] is None and got[None][0] == "MIT"
    assert got[3] == (None, ["CC-BY-NC-4.0", "MIT"]) and got[4] == (None, []) and got[6] == (None, [])
    assert licenses.scan_licenses(docs).count() == 7 and licenses.scan_licenses(docs.limit(0)).count() == 0
    assert licenses.scan_licenses(docs, licenses.known_digests(spark).limit(0)).where("license is not null").count() == 0


def fill(names, slots):
    """The table by plain loops."""
    def number(text):
        return int(hashlib.md5(text.encode()).hexdigest()[:8], 16)
    names, taken, t = sorted(names), [None] * slots, 0
    while None in taken:
        name = names[t % len(names)]
        start, step = number("offset|" + name) % slots, number("step|" + name) % (slots - 1) + 1
        slot = next(s for k in range(slots) if taken[s := (start + k * step) % slots] is None)
        taken[slot] = name
        t += 1
    return taken


@pytest.mark.parametrize("count, slots", [(1, 7), (3, 101), (16, 499)])
def test_lookup_table(spark, count, slots):
    names = SHARDS[:count]
    shards = spark.createDataFrame([(n,) for n in [*names, names[0], None]], "shard string")
    got = {r["slot"]: r["shard"] for r in sharding.lookup_table(shards, slots=slots).collect()}
    assert [got[s] for s in range(slots)] == fill(names, slots)


def test_few_slots_move():
    before, after = fill(SHARDS, 499), fill(SHARDS[:-1], 499)
    moved = sum(a != b for a, b in zip(before, after) if a != SHARDS[-1])
    assert moved < 0.2 * 499
    sizes = [before.count(s) for s in SHARDS]
    assert max(sizes) - min(sizes) <= 1


def test_assignment_edges(spark):
    table = sharding.lookup_table(spark.createDataFrame([("a",), ("b",)], "shard string"), slots=7)
    rows = spark.createDataFrame([(1, "x"), (1, "y"), (None, "z")], "doc_id long, slot string")
    got = sharding.assign(rows, table, "doc_id", 7, keep=("doc_id",)).collect()
    assert len(got) == 3 and len({r["shard"] for r in got if r["doc_id"] == 1}) == 1 and all(r["shard"] for r in got)
    none = sharding.lookup_table(spark.createDataFrame([], "shard string"), slots=7)
    assert none.count() == 0 and sharding.assign(rows, none, "doc_id", 7, keep=("doc_id",)).where("shard is null").count() == 3
    with pytest.raises(ValueError):
        sharding.lookup_table(rows, "slot", slots=8)
    with pytest.raises(Exception, match="more shards"):
        sharding.lookup_table(spark.createDataFrame([(str(i),) for i in range(9)], "shard string"), slots=7).count()


CASES = [
    ("HTTP://User@WWW.Example.com:80/A/b/?b=2&a=1&utm_x=1#frag", "example.com/A/b?a=1&b=2"), ("https://example.com", "example.com"),
    ("https://example.com:8080/", "example.com:8080"), ("//x.org/p?ref=1", "x.org/p"), ("not a url", "not a url"), (None, None), ("", "")]


def test_canonical_urls(spark):
    rows = spark.createDataFrame([(u,) for u, _ in CASES], "url string")
    assert [r[0] for r in rows.select(warc_revisits.canonical_url(rows["url"])).collect()] == [c for _, c in CASES]


def plain_resolve(records, canonical):
    out = []
    for i, url, at, status, headers in records:
        if status != 304:
            continue
        headers, key = headers or {}, canonical.get(url)
        earlier = [r for r in records if r[3] == 200 and None not in (key, at, r[2]) and canonical.get(r[1]) == key and (r[2], r[0]) < (at, i)]
        if not earlier:
            out.append((i, "orphan", None, headers))
            continue
        stored = max(earlier, key=lambda r: (r[2], r[0]))
        old = stored[4] or {}
        tags = [h.get("etag", "").removeprefix("W/") for h in (headers, old)]
        if all(tags):
            same = tags[0] == tags[1]
        elif "etag" not in headers and "last-modified" not in headers:
            same = True
        else:
            same = "last-modified" in headers and headers["last-modified"] == old.get("last-modified")
        fresh = {k: v for k, v in headers.items() if k in warc_revisits.PERMITTED}
        out.append((i, "resolved", stored[0], old | fresh) if same else (i, "changed", None, headers))
    return sorted(out, key=str)


@pytest.mark.parametrize("limit", [None, "3"])
def test_revisits(spark, limit):
    import random
    rnd = random.Random(5)
    urls = ["http://a.com/x", "https://www.a.com/x/", "http://b.com/?utm_a=1", "http://b.com", None]
    canonical = {"http://a.com/x": "a.com/x", "https://www.a.com/x/": "a.com/x", "http://b.com/?utm_a=1": "b.com", "http://b.com": "b.com"}
    options = [None, {}, {"etag": '"1"'}, {"etag": 'W/"1"', "date": "d"}, {"etag": '"2"', "content-type": "t"}, {"last-modified": "m", "vary": "v"},
               {"last-modified": "n", "cache-control": "c"}]
    records = [(i, rnd.choice(urls), rnd.choice([*range(20), None]), rnd.choice([200, 304, 404]), rnd.choice(options)) for i in range(150)]
    table = spark.createDataFrame([(*r, "z") for r in records], "record_id long, url string, at long, status int, headers map<string,string>, latest string")
    if limit:
        spark.conf.set("spark.tillwork.hotGroupRows", limit)
    try:
        got = [(r["record_id"], r["outcome"], r["response_id"], r["headers"]) for r in warc_revisits.resolve_revisits(table).collect()]
    finally:
        spark.conf.unset("spark.tillwork.hotGroupRows")
    key = lambda r: (*r[:3], sorted(r[3].items()))
    assert sorted(map(str, map(key, got))) == sorted(map(str, map(key, plain_resolve(records, canonical))))
    assert warc_revisits.resolve_revisits(table.limit(0)).count() == 0


def test_licenses_with_title_lines(spark):
    texts = {name: text for name, text in licenses.KNOWN[:6]}
    body = licenses.KNOWN[0][1]
    bsd = next(text for name, text in licenses.KNOWN if name == "BSD-3-Clause" and "1. " in text)
    rows = [(1, "MIT License\n\nCopyright (c) 2020 Someone\n\n" + body), (2, "The MIT License (MIT)\n\n" + body),
            (3, "ISC License\n\nCopyright (c) 2020\n\n" + texts["ISC"]),
            (4, "BSD 3-Clause License\n\nCopyright (c) 2020, Someone\nAll rights reserved.\n\n" + bsd), (5, "Other title\n\n" + body)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["license"] for r in licenses.scan_licenses(docs).collect()}
    assert got == {1: "MIT", 2: "MIT", 3: "ISC", 4: "BSD-3-Clause", 5: None}
