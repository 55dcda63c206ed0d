import os
import subprocess
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.default.parallelism", "4")
        .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g")
        .config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


class Repo:
    """A small repository with fixed authors and dates one hour apart."""

    def __init__(self, path):
        self.path, self.n = str(path), 0
        self.git("init", "-q", "-b", "main")

    def git(self, *args, **env):
        fixed = {"GIT_AUTHOR_NAME": "a", "GIT_AUTHOR_EMAIL": "a@b", "GIT_COMMITTER_NAME": "a", "GIT_COMMITTER_EMAIL": "a@b"}
        return subprocess.run(["git", "-C", self.path, *args], check=True, capture_output=True, env=os.environ | fixed | env).stdout.decode().strip()

    def commit(self, message, files):
        for name, content in files.items():
            path = os.path.join(self.path, name)
            if content is None:
                os.remove(path)
                continue
            os.makedirs(os.path.dirname(path), exist_ok=True)
            with open(path, "wb") as out:
                out.write(content if isinstance(content, bytes) else content.encode())
        self.n += 1
        date = f"2024-01-{1 + self.n // 24:02d}T{self.n % 24:02d}:00:00+00:00"
        self.git("add", "-A")
        self.git("commit", "-q", "--allow-empty", "-m", message, GIT_AUTHOR_DATE=date, GIT_COMMITTER_DATE=date)
        return self.git("rev-parse", "HEAD")


@pytest.fixture
def make_repo(tmp_path):
    def make(name):
        (tmp_path / name).mkdir()
        return Repo(tmp_path / name)

    return make


PARSER = "def parse(text):\n    return text\n\n\ndef helper(x):\n    return x + 1\n"
TESTS = "from app import parse\n\n\ndef test_parse():\n    assert parse('a') == 'a'\n"


@pytest.fixture
def project(make_repo):
    """A repository with one fix, a documentation change, a cosmetic one and a change without tests."""
    repo = make_repo("project")
    repo.commit("Initial import", {"src/app.py": PARSER, "tests/test_app.py": TESTS, "README.md": "# App\n"})
    repo.commit("Describe the app", {"README.md": "# App\n\nParses.\n"})
    repo.commit("Reword a comment", {"src/app.py": PARSER.replace("return x + 1", "return x + 1  # next")})
    repo.commit("Speed up", {"src/app.py": PARSER.replace("return x + 1", "return 1 + x")})
    repo.fix = repo.commit("Fix crash on empty text\n\nCloses #12", {
        "src/app.py": PARSER.replace("return text", "return text or ''").replace("return x + 1", "return 1 + x"),
        "tests/test_app.py": TESTS + "\n\ndef test_empty():\n    assert parse(None) == ''\n    assert parse('') == ''\n",
    })
    return repo
