import random

from pyspark.sql import functions as F

from loopwright.llm.warc import RENEWED, canonical_url, resolve_revisits

RECORD = "record_id long, url string, ts long, kind string, headers map<string,string>, page string"


def solve(llm, rows, **options):
    df = llm.createDataFrame([(*r, "clash") for r in rows], RECORD)
    return {r["record_id"]: r for r in resolve_revisits(df, **options).collect()}


def test_canonical_urls(llm):
    urls = [
        "HTTP://WWW.Example.com:80/a/b/?utm_source=x&b=2&a=1#top", "https://example.com/a/b?a=1&b=2",
        "example.com", "https://example.com/?ref=1", None, "",
    ]
    df = llm.createDataFrame([(u,) for u in urls], "url string")
    found = [r[0] for r in df.select(canonical_url(F.col("url"))).collect()]
    assert found == ["example.com/a/b?a=1&b=2"] * 2 + ["example.com"] * 2 + [None, ""]


def brute(rows):
    found = {}
    for i, url, ts, kind, headers in rows:
        if kind != "revisit":
            continue
        before = [r for r in rows if r[3] == "response" and r[1] == url and r[2] < ts]
        full = max(before, key=lambda r: (r[2], r[0]), default=None)
        if not full:
            found[i] = (None, "no_response", None)
            continue
        a, b = full[4].get("etag"), headers.get("etag")
        state = "unverified" if not (a and b) else "resolved" if a == b else "mismatch"
        merged = {**full[4], **{k: v for k, v in headers.items() if k in RENEWED and v is not None}}
        found[i] = (full[0], state, None if state == "mismatch" else merged)
    return found


def test_as_of_join_matches_brute_force_at_any_slicing(llm):
    draw = random.Random(6)
    rows = []
    for i in range(300):
        url = "hot.example.com/" if draw.random() < 0.4 else f"h{draw.randint(0, 9)}.example.com/p"
        kind = draw.choice(["response", "revisit"])
        tag = draw.choice(["1", "2", None])
        headers = {"etag": tag, "content-length": str(i), "date": str(i)}
        rows.append((i, url, draw.randint(0, 80), kind, headers))
    expected = brute(rows)
    for slice_rows in (10_000, 20, 3):
        found = solve(llm, rows, slice_rows=slice_rows)
        assert {i: (r["response_id"], r["outcome"], r["headers"]) for i, r in found.items()} == expected


def test_validators_and_headers(llm):
    full = {"etag": 'W/"1"', "content-type": "text/html", "cache-control": "old"}
    again = {"etag": '"1"', "content-type": "none", "cache-control": "new", "set-cookie": "x"}
    found = solve(llm, [
        (1, "http://a.com/", 10, "response", full), (2, "https://www.a.com", 20, "revisit", again),
        (3, "a.com", 10, "revisit", again), (4, "a.com", 30, "revisit", {"last-modified": "x"}),
        (5, "a.com", 40, "revisit", None),
    ])
    assert found[2]["outcome"] == "resolved"
    assert found[2]["headers"] == {"etag": '"1"', "content-type": "text/html", "cache-control": "new"}
    assert found[3]["outcome"] == "no_response"  # not strictly earlier
    assert found[4]["outcome"] == found[5]["outcome"] == "unverified" and found[5]["headers"] == full


def test_odd_records(llm):
    rows = [
        (1, None, 5, "response", {"etag": "1"}), (2, None, 6, "revisit", {"etag": "1"}),
        (3, "a.com", None, "revisit", None), (None, "a.com", 7, "revisit", {}), (4, "a.com", 1, None, None),
        (5, "a.com", 3, "response", None), (None, "a.com", 7, "revisit", {}),
    ]
    df = llm.createDataFrame([(*r, "clash") for r in rows], RECORD)
    found = resolve_revisits(df).collect()
    assert len(found) == 4
    assert {r["record_id"]: r["outcome"] for r in found} == {2: "no_response", 3: "no_response", None: "unverified"}
    assert resolve_revisits(df.limit(0)).collect() == []


def test_query_agrees_with_sql(llm, sf_dir):
    import check

    from loopwright.llm.queries import ORACLES, QUERIES

    name = "op9_revisit_resolution"
    assert check.difference(QUERIES[name](llm, sf_dir), check.duck(sf_dir), ORACLES[name]) is None
