"""Pull requests over HTTP: the listing as a source and a stream, details fetched by tasks, runs that go on."""

import json
import threading
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from gritsieve.plans.engine import Engine
from gritsieve.sources import pull_source, pulls
from tests.test_pulls import FILES, pull


class Handler(BaseHTTPRequestHandler):
    def do_GET(self):
        server = self.server
        path, _, query = self.path.partition("?")
        asked = dict(x.split("=") for x in query.split("&") if "=" in x)
        with server.lock:
            server.asked[path] += 1
        if path in server.broken:
            return self.answer(500, b"no")
        if path.endswith("/pulls"):
            size, page = min(int(asked["per_page"]), server.page), int(asked.get("page", 1))
            data = server.listing[(page - 1) * size : page * size]
            more = len(server.listing) > page * size
            link = {"Link": f'<http://127.0.0.1:{server.server_port}{path}?{query.split("&page=")[0]}&page={page + 1}>; rel="next"'} if more else {}
            return self.answer(200, json.dumps(data).encode(), link)
        data = FILES if path.endswith("/files") else [{"sha": "c1", "commit": {"message": "fixes o/r#7"}, "noise": 1}]
        self.answer(200, json.dumps(data).encode())

    def answer(self, code, body, headers=()):
        self.send_response(code)
        for name, value in dict(headers).items():
            self.send_header(name, value)
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *args):
        pass


@pytest.fixture
def server():
    held = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    held.asked, held.broken, held.page, held.lock = Counter(), set(), 2, threading.Lock()
    held.listing = [pull(4, "2024-02-04"), pull(3, "2024-02-03", None), pull(4, "2024-02-04"), pull(2, "2024-02-02", body="Closes #9\r\nand", labels=("bug", "a")), pull(1, "2024-02-01")]
    held.options = {"api": f"http://127.0.0.1:{held.server_port}", "max_wait": "0.1"}
    threading.Thread(target=held.serve_forever, daemon=True).start()
    yield held
    held.shutdown()


def test_rows_are_those_of_recorded_responses(spark, server, tmp_path):
    client = pulls.Client(api=server.options["api"])
    pulls.record(client, "o/r", str(tmp_path / "f"), 10)
    want = pulls.replayed(spark, str(tmp_path / "f")).collect()
    before = Counter(server.asked)
    got, listing = pull_source.pull_requests(spark, "o/r", server.options, limit=10, tasks=2)
    assert sorted(got.collect(), key=lambda r: r["pos"]) == sorted(want, key=lambda r: r["pos"])
    assert listing.count() == 5 and server.asked - before == before  # each request once


def test_requests_are_dealt_to_tasks_and_written_in_rounds(spark, server, tmp_path):
    server.listing = [pull(n, f"2024-03-{n:02d}") for n in range(20, 0, -1)]
    folder = f"file://{tmp_path}/responses"
    rows, _ = pull_source.pull_requests(spark, "o/r", server.options, limit=12, folder=folder, tasks=2)
    assert rows.count() == 12 and {r["sha"] for r in rows.select("sha").collect()} == {f"m{n}" for n in range(9, 21)}
    assert len(list((tmp_path / "responses").glob("part-*"))) == 2 and server.asked["/repos/o/r/pulls"] == 6
    seen = spark.createDataFrame([("m20",), ("m18",)], "sha string")
    rows, _ = pull_source.pull_requests(spark, "o/r", server.options, since="2024-03-15", seen=seen, limit=3, folder=folder)
    assert {r["sha"] for r in rows.select("sha").collect()} == {"m19", "m17", "m16"}
    details = [p for p in server.asked if p.count("/") > 4]
    assert len(details) == 24 and all(server.asked[p] == 1 for p in details)  # those on file are not asked for again


def test_a_run_that_failed_goes_on_where_it_was(spark, server, tmp_path):
    server.listing = [pull(n, f"2024-03-{n:02d}") for n in range(9, 0, -1)]
    chosen = spark.createDataFrame([("o/r", n) for n in range(1, 10)], "repo string, number long")
    server.broken.add("/repos/o/r/pulls/4/files")
    folder = f"file://{tmp_path}/r"
    with pytest.raises(Exception, match="to wait"):
        pull_source.fetch_details(chosen, server.options, folder, tasks=1, size=2)
    server.broken.clear()
    done = Counter(server.asked)
    assert pull_source.fetch_details(chosen, server.options, folder, tasks=1, size=2).count() == 18
    for n in (9, 8, 7, 6):  # the first two rounds were kept
        assert server.asked[f"/repos/o/r/pulls/{n}/files"] == done[f"/repos/o/r/pulls/{n}/files"] == 1
    assert pull_source.fetch_details(chosen.limit(0), server.options, f"file://{tmp_path}/none").count() == 0


def test_listing_as_a_stream(spark, server, tmp_path):
    pull_source.register(spark)
    got = []

    def run():
        stream = spark.readStream.format("pull_requests").options(repos="o/r", **server.options).load()
        query = stream.writeStream.foreachBatch(lambda df, n: got.append([r["item"]["number"] for r in pulls.listing(df).collect()])).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        query.awaitTermination(120)

    run()
    server.listing = [pull(6, "2024-02-06"), pull(5, "2024-02-05"), *server.listing]
    run()
    run()
    assert [sorted(set(b)) for b in got if b] == [[1, 2, 3, 4], [5, 6]]


def test_names_are_checked(spark):
    with pytest.raises(ValueError):
        pull_source.ListingReader({"repos": "nope"})
    with pytest.raises(ValueError):
        pull_source.ListingReader({})


def test_batches_read_live_requests(spark, server, tmp_path):
    from gritsieve.streaming.ledger import Ledger

    engine = Engine(spark, make_client=lambda spec: pulls.Client(api=server.options["api"]))
    ledger = Ledger(spark, str(tmp_path / "ledger"))
    from types import SimpleNamespace

    spec = SimpleNamespace(name="o/r", source="pull-requests", target="o/r", url=None, replay=None, limit=10, max_files=300)
    kept, resume, url, _ = engine._walk(spec, ledger, False)
    assert kept.count() == 3 and resume.watermark == "2024-02-04" and url == "https://github.com/o/r"
