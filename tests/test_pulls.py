"""Pull requests from recorded responses, and the client against a fake server."""

import json

import pytest

from gritsieve.sources import pulls


def pull(n, updated, merged="2024-01-02T00:00:00Z", body="", labels=()):
    return {"number": n, "title": f"Fix {n}", "body": body, "html_url": f"https://github.com/o/r/pull/{n}", "merged_at": merged, "merge_commit_sha": f"m{n}" if merged else None,
            "updated_at": updated, "labels": [{"name": x} for x in labels], "base": {"ref": "main", "sha": "b"}, "head": {"sha": f"h{n}"}}


FILES = [
    {"filename": "src/a.py", "status": "modified", "additions": 1, "deletions": 1, "patch": "@@ -1 +1 @@\n-a = 1\n+a = 2"},
    {"filename": "b.png", "status": "added", "additions": 0, "deletions": 0}, {"filename": "c.py", "previous_filename": "d.py", "status": "renamed", "additions": 0, "deletions": 0},
    {"filename": "big.py", "status": "modified", "additions": 900, "deletions": 0}, {"filename": "cut.py", "status": "modified", "additions": 5, "deletions": 0, "patch": "@@ -0,0 +1 @@\n+a"},
]


class Server:
    """Answers by path; the listing has two pages."""

    def __init__(self):
        self.asked, self.listing = [], [pull(4, "2024-02-04"), pull(3, "2024-02-03", None), pull(4, "2024-02-04"), pull(2, "2024-02-02", body="Closes #9\r\nand", labels=("bug", "a")), pull(1, "2024-02-01")]

    def __call__(self, url, headers, timeout):
        self.asked.append((url, headers))
        path, link = url.split("?")[0].removeprefix("https://x"), {}
        if headers.get("If-None-Match") == '"e"':
            return pulls.Reply(304, {}, b"")
        if path.endswith("/pulls"):
            two = "page=2" in url
            data, link = (self.listing[3:], {}) if two else (self.listing[:3], {"link": f'<{url}&page=2>; rel="next"'})
        else:
            data = FILES if path.endswith("/files") else [{"sha": "c1", "commit": {"message": "fixes o/r#7"}, "noise": 1}]
        return pulls.Reply(200, {"etag": '"e"', **link}, json.dumps(data).encode())


def test_recorded_and_replayed(spark, tmp_path):
    server, folder = Server(), str(tmp_path / "f")
    client = pulls.Client(api="https://x", send=server)
    assert pulls.record(client, "o/r", folder, 10) == 3
    rows = {r["sha"]: r for r in pulls.replayed(spark, folder).collect()}
    assert set(rows) == {"m4", "m2", "m1"} and [rows[s]["pos"] for s in ("m4", "m2", "m1")] == [0, 1, 2]
    two = rows["m2"]
    assert two["message"] == "Fix 2\n\nCloses #9\nand\n" and two["date"] == "2024-01-02T00:00:00+00:00" and two["parents"] == ["b"]
    assert two["pull_request"]["labels"] == ["a", "bug"] and two["pull_request"]["linked_issues"] == ["#7", "#9"] and two["pull_request"]["commits"] == ["c1"]
    files = {f["path"]: f for f in two["files"]}
    assert [f["path"] for f in two["files"]] == [f["filename"] for f in FILES]
    assert files["src/a.py"]["patch"]["code_hunks"] == 1 and files["b.png"]["added"] is None and files["c.py"]["patch"]["hunks"] == 0
    assert files["big.py"]["patch"] is None and files["big.py"]["added"] == 900 and files["cut.py"]["patch"] is None
    newer = pulls.replayed(spark, folder, since="2024-02-02")
    assert [r["sha"] for r in newer.collect()] == ["m4"]
    seen = spark.createDataFrame([("m4",)], "sha string")
    assert [r["sha"] for r in pulls.replayed(spark, folder, seen=seen, limit=1).collect()] == ["m2"]
    assert pulls.replayed(spark, folder, max_files=4).count() == 0


def test_client_waits_retries_and_caches(tmp_path):
    slept, replies = [], [pulls.Reply(502, {}, b""), pulls.Reply(403, {"x-ratelimit-remaining": "0", "x-ratelimit-reset": "110"}, b""), pulls.Reply(429, {"retry-after": "7"}, b""), pulls.Reply(200, {"etag": "e"}, b"[1]")]
    client = pulls.Client(cache=pulls.Cache(str(tmp_path)), send=lambda *a: replies.pop(0), clock=pulls.Clock(lambda: 100.0, slept.append))
    assert client.get("https://api.github.com/x") == ([1], None) and slept == [1.0, 11.0, 7.0]
    replies.append(pulls.Reply(304, {}, b""))
    assert client.get("https://api.github.com/x") == ([1], None) and client.stats.cached == 1
    replies.append(pulls.Reply(404, {}, b"no"))
    with pytest.raises(pulls.RequestError, match="404"):
        client.get("https://api.github.com/y")
    replies.append(pulls.Reply(429, {"retry-after": "9999"}, b""))
    with pytest.raises(pulls.RequestError, match="to wait"):
        client.get("https://api.github.com/z")


def test_client_reads_dates_and_waits_for_a_new_budget():
    slept, day = [], "Thu, 01 Jan 1970 00:02:10 GMT"
    replies = [pulls.Reply(429, {"retry-after": day}, b""), pulls.Reply(429, {"retry-after": "soon"}, b""), pulls.Reply(200, {"x-ratelimit-remaining": "0", "x-ratelimit-reset": "140"}, b"[]"), pulls.Reply(200, {}, b"[2]")]
    client = pulls.Client(send=lambda *a: replies.pop(0), clock=pulls.Clock(lambda: 100.0, slept.append))
    assert client.get("https://x/a") == ([], None) and slept == [30.0, 60.0]
    assert client.get("https://x/b") == ([2], None) and slept == [30.0, 60.0, 41.0]


def test_keys_are_sorted():
    assert pulls.key_of("https://h/a/b?z=1&a=2") == "GET /a/b?a=2&z=1"
    with pytest.raises(ValueError):
        pulls.record(pulls.Client(), "nope", "/tmp/x", 1)
