"""Options of the command line that reach the engine, without a session."""

from types import SimpleNamespace

from gritsieve import cli
from gritsieve.plans import engine, export
from gritsieve.sources import pulls
from gritsieve.streaming import ledger


def test_options_reach_the_settings():
    a = cli._parser().parse_args(["mine", "--history", "h", "--repo-name", "n", "--url", "u", "--test-lines-cap", "7", "--max-lines", "9"])
    assert (a.name, a.url) == ("n", "u")
    settings = cli._settings(a)
    assert (settings.test_lines_cap, settings.max_lines) == (7, 9)


def test_partial_matches_can_be_added(monkeypatch):
    asked = []
    row = {"repo": "a", "sha": "b" * 40, "subject": "s", "fingerprint": {"hunks": ["x"]}}

    class Rows:
        orderBy = limit = lambda self, *_: self
        toLocalIterator = lambda self: iter([row])

    class Ledger:
        def __init__(self, *_, **__):
            pass

        def add(self, proposal, status, owner, least):
            asked.append(least)
            return {"id": 1}, {"status": "new"}

    monkeypatch.setattr(cli, "_session", lambda: None)
    monkeypatch.setattr(engine, "Engine", lambda spark: SimpleNamespace(spark=spark))
    monkeypatch.setattr(export, "read_candidates", lambda *_: Rows())
    monkeypatch.setattr(ledger, "Ledger", Ledger)
    assert cli.main(["ledger-add", "l", "c"]) == 0 and cli.main(["ledger-add", "l", "c", "--allow-overlap"]) == 0
    assert asked == [0.5, None]


def test_waits_and_cache(monkeypatch):
    made = []

    def client(token, url, cache, max_wait):
        made.append((cache is None, max_wait))
        raise ValueError("stop")

    monkeypatch.setattr(cli, "_session", lambda: None)
    monkeypatch.setattr(engine, "Engine", lambda spark: SimpleNamespace(spark=spark))
    monkeypatch.setattr(pulls, "Client", client)
    monkeypatch.setattr(pulls, "Cache", lambda folder: folder)
    assert cli.main(["prs", "o/r", "--record", "f", "--cache-dir", "c", "--max-wait", "5"]) == 2
    assert cli.main(["prs", "o/r", "--record", "f", "--cache-dir", "c", "--no-cache"]) == 2
    assert made == [(False, 5.0), (True, 900.0)]
