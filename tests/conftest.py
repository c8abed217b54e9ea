"""One session for all tests, and a small source tree."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    made = (
        SparkSession.builder.master("local[4]")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('checkpoints')}")
        .getOrCreate()
    )
    made.sparkContext.setLogLevel("ERROR")
    yield made
    made.stop()


TREE = {
    "pkg/__init__.py": "",
    "pkg/auth.py": '''"""Sessions and tokens."""
from pkg.utils import hash_token

DEFAULT_TTL = FALLBACK_TTL


class Session:
    """A signed-in user."""

    LIMIT = 3

    def refresh(self, seconds: int = 5) -> None:
        """Extend the session; the token is hashed again so that old ones end."""
        self.check()
        hash_token(str(seconds))

    def check(self):
        return DEFAULT_TTL


def login(name):
    # checks the transaction.atomic marker
    return Session()
''',
    "pkg/utils.py": '''"""Helpers."""
FALLBACK_TTL = 60


def hash_token(token):
    """Hash a token."""
    return len(token)
''',
    "web/urls.py": '''from django.urls import path, include
from . import views

urlpatterns = [
    path("login/", views.login_view),
    path("api/", include("api.urls")),
]
''',
    "web/views.py": "def login_view(request):\n    return 1\n",
    "app/api/items/route.ts": "export async function GET(req: Request) { return list(); }\nexport const POST = async () => 1;\nfunction list() { return []; }\n",
    "docs/guide.md": "Intro line.\n\n# Start\ntext\n## Deep\n```\n# not a heading\n```\n# End\n",
    "conf/app.toml": '# Settings\n[server]\nport = 1\n',
    ".gitignore": "ignored/\n*.log.py\n",
    "ignored/secret.py": "X = 1\n",
    "pkg/a.log.py": "Y = 1\n",
    "node_modules/lib/index.js": "export function z() {}\n",
}


@pytest.fixture
def tree(tmp_path):
    for rel, text in TREE.items():
        path = tmp_path / rel
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    (tmp_path / ".git").mkdir()
    return tmp_path
